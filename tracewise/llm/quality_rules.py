"""Operator 8: quality rules and a calibrated n-gram logistic regression.

An Arrow function computes the base figures of every whole text and its score
under a logistic regression over hashed n-grams: word one- and two-grams
and byte three- and five-grams, each as share of the text's n-grams, so a score
is a mean of table entries and costs the same for any model. The model is fitted by
Spark ML on a bounded sample of labelled rows (MAX_LABELS, smallest hash of
doc_id first), calibrated by a second, one-dimensional regression on a
held-out fifth of it, and applied against a fixed probability.

Defined results: null or empty text has no words, fails the base rule and is not
kept; repeated rows are scored each; without labels of both classes the base
rule alone decides; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fewest_hash, read, worker_cache

#: Buckets (a power of two) per n-gram family; labelled rows used at most; least probability of good text.
BITS, MAX_LABELS, LEAST_PROBABILITY = 12, 6000, 0.5
WORD_NGRAMS, BYTE_NGRAMS = (1, 2), (3, 5)
MIN_WORDS, REPEAT_PERCENT = 50, 50      # fixed by the contract
SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"
MIX = np.uint64(0x9E3779B97F4A7C15)
SLICE = 1 << 18       # bytes whose n-grams are hashed at once
MEMO_WORDS = 200_000


class WordHashes(dict):
    """Memo of 64-bit hashes of words (bytes); bounded, refilled at need."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > MEMO_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def bucket(h: np.ndarray) -> np.ndarray:
    return ((h * MIX) >> np.uint64(64 - BITS)).astype(np.int64)


def byte_grams(data: bytes, n: int) -> Iterator[np.ndarray]:
    """Buckets of all byte n-grams of ``data``, slice by slice."""
    a = np.frombuffer(data, np.uint8)
    for s in range(0, len(a) - n + 1, SLICE):
        part = a[s:s + SLICE + n - 1].astype(np.uint64)
        h = np.zeros(len(part) - n + 1, np.uint64)
        for k in range(n):
            h = h * np.uint64(257) + part[k:len(part) - n + 1 + k]
        yield bucket(h + np.uint64(n))


def word_grams(words: np.ndarray, n: int) -> np.ndarray:
    h = words[:len(words) - n + 1].copy()
    for k in range(1, n):
        h = h * np.uint64(0xD6E8FEB86659FD93) + words[k:len(words) - n + 1 + k]
    return bucket(h ^ np.uint64(n))


def families(data: bytes, words: np.ndarray):
    """(family number, iterator of bucket arrays) of a text."""
    for i, n in enumerate(WORD_NGRAMS):
        yield i, [word_grams(words, n)] if len(words) >= n else []
    for i, n in enumerate(BYTE_NGRAMS):
        yield len(WORD_NGRAMS) + i, byte_grams(data, n)


def hashes(words: list[bytes]) -> np.ndarray:
    memo = worker_cache("quality_rules").setdefault("words", WordHashes())
    return np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))


def repeated_words(words: np.ndarray) -> int:
    """Words in 3-word windows that occur twice or more."""
    n = len(words) - 2
    if n < 2:
        return 0
    h = (words[:n] * MIX + words[1:n + 1]) * np.uint64(0xD6E8FEB86659FD93) + words[2:]
    order = np.sort(h)
    again = order[1:][order[1:] == order[:-1]]
    if not len(again):
        return 0
    again = np.unique(again)
    at = np.searchsorted(again, h)
    twice = again[np.minimum(at, len(again) - 1)] == h
    covered = np.zeros(len(words), bool)
    for k in range(3):
        covered[k:k + n] |= twice
    return int(covered.sum())


def duplicate_lines(text: str) -> int:
    if "\n" not in text:
        return 0
    lines = [x for x in text.split("\n") if x.strip(BLANKS)]
    return len(lines) - len(set(lines))


def figures(text: str) -> tuple:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words), UTF-8 bytes, word hashes."""
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()        # bytes split at exactly the six blanks
    h = hashes(words)
    return (len(words), len(text) - sum(map(text.count, BLANKS)), sum(map(text.count, SYMBOLS)),
            duplicate_lines(text), repeated_words(h)), data, h


def vector(text: str | None) -> np.ndarray:
    """Shares of the n-grams by family and bucket."""
    _, data, h = figures(text or "")
    out = np.zeros((len(WORD_NGRAMS) + len(BYTE_NGRAMS), 1 << BITS))
    for i, parts in families(data, h):
        for part in parts:
            out[i] += np.bincount(part, minlength=1 << BITS)
    return (out / np.maximum(out.sum(axis=1, keepdims=True), 1)).ravel()


def logit(data: bytes, words: np.ndarray, weights: np.ndarray, intercept: float) -> float:
    total = intercept
    for i, parts in families(data, words):
        count, score, row = 0, 0.0, weights[i]
        for part in parts:
            count += len(part)
            score += float(row[part].sum())
        total += score / max(count, 1)
    return total


def train(docs: DataFrame, labels: DataFrame, most: int = MAX_LABELS) -> dict | None:
    """Weights and calibration from at most ``most`` labelled rows; None without both classes."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import vector_to_array
    from pyspark.ml.linalg import SparseVector, VectorUDT

    rows = fewest_hash(labels.where("quality is not null and doc_id is not null").groupBy("doc_id")
                       .agg(F.max("quality").alias("quality")), "doc_id", most)
    if rows.select("quality").distinct().count() < 2:
        return None

    @F.udf(VectorUDT())
    def sparse(text):
        v = vector(text)
        at = np.flatnonzero(v)
        return SparseVector(len(v), at.tolist(), v[at].tolist())

    # the labelled ids are at most ``most`` rows: a bounded broadcast
    some = docs.select("doc_id", "text").join(F.broadcast(rows), "doc_id") \
        .select(sparse("text").alias("features"), F.col("quality").cast("double").alias("label"),
                F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(5)).alias("fold")).repartition(8).cache()
    try:
        fitted = LogisticRegression(maxIter=40, regParam=0.01).fit(some.where("fold > 0"))
        held = fitted.transform(some.where("fold = 0")).select("label", vector_to_array("rawPrediction")[1].alias("x")).toPandas()
    finally:
        some.unpersist()
    slope, offset = platt(held["x"].to_numpy(), held["label"].to_numpy())
    weights = np.array(fitted.coefficients.toArray()).reshape(len(WORD_NGRAMS) + len(BYTE_NGRAMS), 1 << BITS)
    return {"weights": weights, "intercept": float(fitted.intercept), "slope": slope, "offset": offset}


def platt(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of P(y=1) = sigmoid(slope x + offset) by Newton steps with
    smoothed targets; (1, 0) if a class is missing."""
    if len(x) == 0 or y.min() == y.max():
        return 1.0, 0.0
    n1, n0 = y.sum(), (1 - y).sum()
    t = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    m, s = float(x.mean()), float(x.std()) or 1.0
    z, w = np.stack([(x - m) / s, np.ones_like(x)], 1), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + 1e-3 * np.eye(2), z.T @ (p - t) + 1e-3 * w)
        w -= np.clip(step, -2, 2)
    return float(w[0] / s), float(w[1] - w[0] * m / s)


OUT = T.StructType([T.StructField(c, T.LongType()) for c in (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")] + [T.StructField("probability", T.DoubleType())])


def scorer(spark, model: dict | None):
    shared = spark.sparkContext.broadcast(model)        # 4 x 2**BITS weights: fixed size

    @F.arrow_udf(OUT)
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = shared.value
        fields = [pa.field(c, pa.int64()) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")] \
            + [pa.field("probability", pa.float64())]
        for batch in batches:
            rows = []
            for value in batch:
                found, data, h = figures(value.as_py() or "")
                p = None
                if model:
                    x = model["slope"] * logit(data, h, model["weights"], model["intercept"]) + model["offset"]
                    p = float(1 / (1 + np.exp(-np.clip(x, -40, 40))))
                rows.append((*found, p))
            cols = list(zip(*rows)) if rows else [()] * len(fields)
            yield pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(cols, fields)], fields=fields)

    return score


def score_quality(docs: DataFrame, model: dict | None, least: float = LEAST_PROBABILITY) -> DataFrame:
    """``docs`` with the figures, probability, base_failed and kept."""
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    return (docs.drop(*[f.name for f in OUT], "base_failed", "kept")
            .withColumn("_q", scorer(docs.sparkSession, model)(F.col("text"))).select("*", "_q.*").drop("_q")
            .withColumn("base_failed", failed)
            .withColumn("kept", ~F.col("base_failed") & (F.coalesce("probability", F.lit(1.0)) >= least)))


def op8_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return score_quality(docs, train(docs, read(spark, sf_dir, "labels"))).drop("text")
