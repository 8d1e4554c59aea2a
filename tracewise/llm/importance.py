"""Operator 3: quality classifier by importance resampling.

Two generative models over hashed word one- and two-grams, one of the target
text (labelled good documents) and one of all raw text, give every document
a log importance weight; adding Gumbel noise (hash-seeded) to the weights and
taking the k largest sums samples k documents without replacement with
probability in proportion to their weights.

The raw model counts all documents, the target model a bounded number of
labelled rows (MAX_TARGET, smallest hash of doc_id first). Weights are the mean
log ratio per n-gram times LENGTH, as if all texts were LENGTH n-grams long;
summed ratios would let the length decide. The k-th largest sum is found by
histograms over a narrow stored table, never by one sort of all rows.

Defined results: null texts and texts without words have no weight and are not
kept; repeated rows have the same noise and are kept or dropped together
(k may be passed by rows that tie in both sum and doc_id); without
target documents all weights are 0; an empty table gives no rows;
extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fewest_hash, read, stored, worker_cache
from .mixing import draw
from .quality_rules import WordHashes

BITS, MAX_TARGET, LENGTH, FRACTION = 14, 20_000, 100.0, 0.8
MIX = np.uint64(0x9E3779B97F4A7C15)


def buckets(text: str) -> np.ndarray:
    """Hash buckets of the one- and two-grams of the lower-cased words (a text
    of one word has one n-gram)."""
    words = text.lower().encode("utf-8", "surrogatepass").split()
    memo = worker_cache("importance").setdefault("words", WordHashes())
    h = np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))
    both = np.concatenate((h, (h[:-1] * np.uint64(0xD6E8FEB86659FD93) + h[1:]) ^ MIX))
    return ((both * MIX) >> np.uint64(64 - BITS)).astype(np.int64)


def fit(docs: DataFrame, target_ids: DataFrame) -> np.ndarray:
    """log(target / raw) per bucket, add-one smoothed; at most 2**BITS sums reach the driver.
    ``target_ids`` (doc_id) has at most MAX_TARGET rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, 1 << BITS), np.int64)
        for batch in batches:
            for text, target in zip(batch.column(0), batch.column(1).to_pylist()):
                found = np.bincount(buckets(text.as_py() or ""), minlength=1 << BITS)
                sums[0] += found
                if target:
                    sums[1] += found
        at = np.flatnonzero(sums[0])
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sums[0][at]), pa.array(sums[1][at])], names=["bucket", "raw", "target"])

    flagged = docs.select("doc_id", "text").join(F.broadcast(target_ids.distinct().withColumn("_target", F.lit(True))), "doc_id", "left")
    rows = flagged.select("text", F.coalesce("_target", F.lit(False)).alias("t")) \
        .mapInArrow(count, "bucket long, raw long, target long") \
        .groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).collect()
    sums = np.zeros((2, 1 << BITS))
    for r in rows:
        sums[:, r["bucket"]] = r["raw"], r["target"]
    if not sums[1].any():
        return np.zeros(1 << BITS)
    p = (sums + 1) / (sums.sum(axis=1, keepdims=True) + sums.shape[1])
    return np.log(p[1] / p[0])


def weigh(docs: DataFrame, ratio: np.ndarray, seed: str = "gumbel") -> DataFrame:
    """``docs`` with n_grams, log_weight and gumbel_key (null without words)."""
    shared = docs.sparkSession.sparkContext.broadcast(ratio)        # 2**BITS doubles

    @F.arrow_udf("struct<n_grams:bigint,log_weight:double>")
    def weight(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            n, w = [], []
            for text in batch:
                at = buckets(text.as_py() or "")
                n.append(len(at))
                w.append(float(shared.value[at].mean()) * LENGTH if len(at) else None)
            yield pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(w, pa.float64())], names=["n_grams", "log_weight"])

    u = draw(F.col("doc_id"), F.col("text"), seed) + F.lit(0.5 / (1 << 52))
    return (docs.drop("n_grams", "log_weight", "gumbel_key").withColumn("_w", weight(F.col("text")))
            .select("*", "_w.*").drop("_w")
            .withColumn("gumbel_key", F.col("log_weight") - F.log(-F.log(u))))


def threshold(keys: DataFrame, k: int) -> tuple[float, int | None] | None:
    """(key, doc_id) of the k-th row by key descending, doc_id ascending, of a
    stored table (gumbel_key, doc_id). Each round counts rows per 2**16th of the
    range that holds the k-th key, so at most 2**16 counts reach the driver."""
    low, high = keys.agg(F.min("gumbel_key"), F.max("gumbel_key")).first()
    if low is None:
        return None
    left = k
    for _ in range(4):
        width = (high - low) / (1 << 16)
        if not width or low + width == low:
            break
        inside = keys.where((F.col("gumbel_key") >= low) & (F.col("gumbel_key") <= high))
        slot = F.least(F.floor((F.col("gumbel_key") - low) / width), F.lit((1 << 16) - 1))
        counts = {r["s"]: (r["n"], r["a"], r["b"]) for r in inside.groupBy(slot.alias("s")).agg(
            F.count("*").alias("n"), F.min("gumbel_key").alias("a"), F.max("gumbel_key").alias("b")).collect()}
        for s in sorted(counts, reverse=True):
            n, a, b = counts[s]
            if n >= left:
                low, high = a, b
                break
            left -= n
    # rows that tie share a doc_id, but for chance; they come as one count, and one group at a time
    rest = keys.where((F.col("gumbel_key") >= low) & (F.col("gumbel_key") <= high)) \
        .groupBy("gumbel_key", "doc_id").agg(F.count("*").alias("n")).orderBy(F.desc("gumbel_key"), F.asc_nulls_first("doc_id"))
    for last in rest.toLocalIterator():
        left -= last["n"]
        if left <= 0:
            break
    return last["gumbel_key"], last["doc_id"]


def resample(docs: DataFrame, ratio: np.ndarray, fraction: float = FRACTION) -> DataFrame:
    """(doc_id, n_grams, log_weight, gumbel_key, kept) of every document: ``fraction`` of
    those with words are kept."""
    keys = stored(weigh(docs.select("doc_id", "text"), ratio).drop("text"), "importance-keys")
    n = keys.where("gumbel_key is not null").count()
    last = threshold(keys.where("gumbel_key is not null").select("gumbel_key", "doc_id"), max(1, math.ceil(n * fraction))) if n else None
    if last is None:
        return keys.withColumn("kept", F.lit(False))
    key, doc_id = F.lit(last[0]), F.lit(last[1]).cast("long")
    before = F.col("doc_id").isNull() | (F.col("doc_id") <= doc_id) if last[1] is not None else F.col("doc_id").isNull()
    return keys.withColumn("kept", F.coalesce((F.col("gumbel_key") > key) | ((F.col("gumbel_key") == key) & before), F.lit(False)))


def op3_importance_resampling(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    good = fewest_hash(read(spark, sf_dir, "labels").where("quality = 1 and doc_id is not null").select("doc_id").distinct(),
                       "doc_id", MAX_TARGET)
    return resample(docs, fit(docs, good))
