"""Operator 5: secret scan with fixed patterns and character Markov models.

The base patterns (kinds assign, access, hex) are matched over the whole text;
the method adds spans of kind ``random``: runs of token characters that a first-order
Markov model of random strings explains better than one of ordinary
identifiers, by log-likelihood ratio per character. Both models are trained in
Spark from four fifths of the labelled samples (character-pair counts; at most 66 x 66 x 2 sums reach
the driver); the other fifth sets the least ratio of a secret and measures recall and false
positives (histograms of the ratio, a few thousand sums). All base and random spans lie in words of 20 characters or
more, or behind a keyword, so other texts are dismissed by two cheap tests.

Defined results: null is the empty text, which has no spans (hash of the
empty string); repeated rows are scanned each; an empty table gives no
rows; extra columns are carried, those named like an output are replaced.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import drop, fewest_hash, input_slices, read, stored, worker_cache

#: Fixed by the contract: kinds in order, their patterns and least lengths.
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")      # of all runs [0-9a-f]+, those of 24 or more
ASSIGN_LEAST, ACCESS_LEAST = 6, 20
KEYWORDS = ("passw", "secret", "token", "api")

#: Candidates of the method: runs of at least LEAST_LENGTH token characters.
LEAST_LENGTH = 20
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
LETTERS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
#: Calibration on held-out samples: at most FALSE_RATE of the ordinary ones above the least ratio, and, if that
#: leaves room, RECALL of the random ones. Without held-out samples of both labels the least ratio is LEAST_RATE
#: (nats per character).
FALSE_RATE, RECALL, LEAST_RATE, STEP = 1e-4, 0.99, 0.4, 0.01
#: Documents (smallest hash of doc_id) whose words give the labelled samples.
SAMPLE_DOCS = 2000


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base matches, by start and kind."""
    found = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def rate(text: str, ratio: dict) -> float:
    """Log-likelihood ratio per character of a string of LETTERS."""
    word = "^" + text
    return sum(map(ratio.get, map("".join, zip(word, word[1:])))) / len(text)


def random_spans(text: str, model: dict, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(start, 3, end) of candidates that look random and touch no base span."""
    ratio, found = model["ratio"], []
    starts, ends = [s for s, _, _ in base], list(accumulate((e for _, _, e in base), max))
    for m in CANDIDATE.finditer(text):
        a, b = m.span()
        before = bisect_left(starts, b)         # base spans that start before the candidate ends
        if (not before or ends[before - 1] <= a) and rate(m[0], ratio) >= model["least"]:
            found.append((a, 3, b))
    return found


def spans(text: str, model: dict | None) -> tuple[list, list]:
    if max(map(len, text.split()), default=0) < 20:     # only assign fits in shorter words
        low = text.lower()
        if not any(k in low for k in KEYWORDS):
            return [], []
    base = base_spans(text)
    return base, random_spans(text, model, base) if model else []


def samples(docs: DataFrame, limit: int = SAMPLE_DOCS, scratch: list[str] | None = None) -> DataFrame:
    """Labelled samples (text, label): label 1 are random strings (digests of
    the sampled documents' ids in base 64, whole and cut, and 16, and values that the base patterns
    find behind keywords), label 0 ordinary identifiers (the documents' words of one case, or numbers, outside base matches, also
    upper-cased, joined to names and paths, and numbers). The sample's path goes to ``scratch``."""
    some = fewest_hash(docs.select("doc_id", "text"), "doc_id", limit)
    some = stored(some.repartition(input_slices(docs.sparkSession)), "secret-samples", scratch)      # one scan for all samples
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    short = F.base64(F.unhex(F.sha2(F.concat(key, F.lit("s")), 512)))       # cut to the lengths of usual keys
    digests = some.select(F.explode(F.array(
        F.substring(short, 1, 20), F.substring(short, 21, 24), F.substring(short, 45, 32),
        F.base64(F.unhex(F.sha2(key, 512))), F.sha2(key, 256),
        F.regexp_replace(F.base64(F.unhex(F.sha2(F.concat(key, F.lit("k")), 512))), "[+/=]", "")))
        .alias("text"), F.lit(1).alias("label"))
    values = some.select(F.explode(F.regexp_extract_all("text", F.lit(r"""(?i)(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_=-]{16,})"""),
                                                        F.lit(1))).alias("text"), F.lit(1).alias("label"))
    # no base matches and no pieces of other secrets, which mix cases and digits: a secret labelled ordinary would lift the threshold
    plain = F.regexp_replace(F.coalesce("text", F.lit("")), r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+|AKIA[A-Z0-9]+|[0-9a-f]{24,}""", " ")
    words = some.select(F.filter(F.split(plain, r"[^A-Za-z0-9]+"), lambda w: w.rlike("^([a-z]{2,19}|[A-Z]{2,19}|[A-Z][a-z]{1,18}|[0-9]{2,19})$"))
                        .alias("w")).where(F.size("w") > 3)
    names = words.select(F.explode(F.flatten(F.transform(F.sequence(F.lit(1), F.size("w") - 2, F.lit(3)), lambda i: F.array(
        F.element_at("w", i), F.upper(F.element_at("w", i)),
        F.concat(F.element_at("w", i), F.initcap(F.element_at("w", i + 1)), F.initcap(F.element_at("w", i + 2))),
        F.concat_ws("_", F.element_at("w", i), F.element_at("w", i + 1), F.element_at("w", i + 2)),
        F.concat_ws("-", F.element_at("w", i), F.element_at("w", i + 1), i.cast("string")),
        F.concat_ws("/", F.element_at("w", i), F.element_at("w", i + 1)),
        F.lpad((i * 7919).cast("string"), 9, "20"))))).alias("text"), F.lit(0).alias("label"))
    rules = some.select(F.lit("=" * 40 + "-" * 40 + "_" * 40).alias("text"), F.lit(0).alias("label"))
    return digests.unionByName(values).unionByName(names).unionByName(rules)


def train(labelled: DataFrame, least: float | None = None) -> dict | None:
    """Both Markov models as one table of log-likelihood ratios by character
    pair ("^" starts a string; add-one smoothing), from the samples (text, label) whose hash is not held
    out, and the ``least`` ratio of a secret, calibrated on the held-out ones if not given. None
    without both labels. ``held_out`` counts the held-out samples that are long enough and those found."""
    held = F.pmod(F.xxhash64("text"), F.lit(5)) == 0         # equal strings are on one side
    text = F.concat(F.lit("^"), "text")
    pairs = labelled.where(~held).select("label", F.explode(F.transform(F.sequence(F.lit(1), F.length("text")),
                                                                        lambda i: F.substr(text, i, F.lit(2)))).alias("pair")) \
        .where(F.length("pair") == 2).groupBy("label", "pair").count()
    counts: list[dict] = [{}, {}]
    for r in pairs.where(F.col("pair").rlike(r"^[\^A-Za-z0-9+/_=-][A-Za-z0-9+/_=-]$")).collect():
        counts[r["label"]][r["pair"]] = r["count"]
    if not all(counts):
        return None
    ratio = {}
    for a in "^" + LETTERS:
        total = [sum(c.get(a + b, 0) for b in LETTERS) + len(LETTERS) for c in counts]
        for b in LETTERS:
            p0, p1 = ((c.get(a + b, 0) + 1) / t for c, t in zip(counts, total))
            ratio[a + b] = math.log(p1 / p0)
    return calibrated(labelled.where(held), ratio, least)


def calibrated(labelled: DataFrame, ratio: dict, least: float | None = None) -> dict:
    """The model of ``ratio`` with its threshold. ``low`` is the smallest ratio (in STEPs) that at most FALSE_RATE of the
    ordinary samples reach, ``high`` the largest that RECALL of the random ones reach. The threshold
    lies halfway between them; where they overlap it is ``low``: false alarms weigh more."""

    @F.arrow_udf("int")
    def step(texts: pa.Array) -> pa.Array:
        return pa.array([math.floor(rate(t, ratio) / STEP) for t in texts.to_pylist()], pa.int32())

    fit = labelled.where(F.col("text").rlike(f"^[A-Za-z0-9+/_=-]{{{LEAST_LENGTH},}}$"))
    found = sorted((r["label"], r["step"], r["count"]) for r in fit.groupBy("label", step("text").alias("step")).count().collect())
    ordinary, random = ([(s, n) for label, s, n in found if label == k] for k in (0, 1))
    reach = lambda some, s: sum(n for t, n in some if t >= s)       # noqa: E731
    if least is None and ordinary and random:
        steps = range(min(s for s, _ in ordinary + random), max(s for s, _ in ordinary + random) + 2)
        low = next(s for s in steps if reach(ordinary, s) <= FALSE_RATE * reach(ordinary, steps[0]))
        high = next(s for s in reversed(steps) if reach(random, s) >= RECALL * reach(random, steps[0]))
        least = STEP * (max(low, high) + low) / 2
    elif least is None:
        least = LEAST_RATE
    at = math.ceil(least / STEP - 1e-9)
    return {"ratio": ratio, "least": least, "held_out": {
        "random": reach(random, -1 << 31), "random_found": reach(random, at), "ordinary": reach(ordinary, -1 << 31), "ordinary_found": reach(ordinary, at)}}


def joined(found: list[tuple[int, int, int]]) -> str:
    names = (*KINDS, "random")
    return ",".join(f"{names[k]}:{a}:{b}" for a, k, b in found)


FOUND = T.StructType([T.StructField(c, T.LongType()) for c in ("n_assign", "n_access", "n_hex")]
                     + [T.StructField(c, T.StringType()) for c in ("base_sha256", "spans")])


def scanner(model: dict | None):
    @F.arrow_udf(FOUND)
    def scan(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        worker_cache("secret_scan")     # releases what other operators left in the worker
        fields = [pa.field(c, pa.int64()) for c in ("n_assign", "n_access", "n_hex")] \
            + [pa.field(c, pa.string()) for c in ("base_sha256", "spans")]
        for batch in batches:
            rows = []
            for text in pc.fill_null(batch, ""):
                base, more = spans(text.as_py(), model)
                kinds = [k for _, k, _ in base]
                rows.append((*map(kinds.count, range(3)), hashlib.sha256(joined(base).encode()).hexdigest(),
                             joined(sorted(base + more))))
            cols = list(zip(*rows)) if rows else [()] * 5
            yield pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(cols, fields)], fields=fields)

    return scan


def scan_secrets(docs: DataFrame, model: dict | None, text: str = "text") -> DataFrame:
    """``docs`` with n_assign, n_access, n_hex, base_sha256 and spans."""
    found = docs.drop(*[f.name for f in FOUND]).withColumn("_found", scanner(model)(F.col(text)))
    return found.select("*", "_found.*").drop("_found")


def redact(docs: DataFrame, model: dict | None, text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span of ``text`` replaced by ``mark`` (overlapping
    spans by one mark); texts without spans, null ones too, stay as they are."""

    @F.arrow_udf("string")
    def cover(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        worker_cache("secret_scan")
        for batch in batches:
            out = []
            for value in batch:
                value, parts, end = value.as_py(), [], 0
                if value:
                    base, more = spans(value, model)
                    for a, _, b in sorted(base + more):
                        if a >= end:
                            parts += [value[end:a], mark]
                        end = max(end, b)
                out.append("".join(parts) + value[end:] if parts else value)
            yield pa.array(out, pa.string())

    return docs.withColumn(text, cover(F.col(text)))


def op5_secret_scan(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    scratch: list[str] = []
    model = train(samples(docs, scratch=scratch))
    drop(spark, scratch)
    return scan_secrets(docs, model).drop("text")
