"""Operator 2: mixing sources to target weights.

Words are summed per source (map-side partial sums, so a source with a third
of all rows is no hot task), the weights are water-filled into target sizes, and
every document is taken ``floor(rate)`` times plus one more if a hash-seeded
draw falls below the fraction of its source's rate. All DataFrame
functions; the draw depends only on (doc_id, seed), so reruns agree.

Defined results: null or empty text has size 0 and is taken 0 words; null
source is a source of its own (last in code point order); repeated rows are
mixed each (same doc_id, same draw); an empty table gives no rows; extra
columns are carried, columns named like an output are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD_SQL, drop, join_small, read, stored

#: Fixed by the contract of the registered query.
WEIGHTS, SHARE, MOST = (5, 2, 1), 1.5, 2


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_SQL)), F.lit(0)).cast("long")


def draw(doc_id: Column, text: Column, seed: str) -> Column:
    """Uniform in [0, 1) from 52 bits of an MD5 (rows without an id draw by text)."""
    key = F.coalesce(doc_id.cast("string"), F.md5(F.coalesce(text, F.lit(""))))
    return F.conv(F.substring(F.md5(F.concat(key, F.lit(f":{seed}"))), 1, 13), 16, 10) \
        .cast("double") / F.lit(float(1 << 52))


def targets(sizes: DataFrame, weights: tuple[int, ...], share: float, most: int) -> DataFrame:
    """(source, source_size) to target per source: ``share`` of all words by
    weight, no target above ``most`` times its source, the excess reshared by
    weight. Sources in order of cap/weight fill up first; the level of the
    rest is what is left over their weights. One row per source, so the
    windows over the source table stay small.
    """
    by_source = W.orderBy(F.col("source").asc_nulls_last())
    cycle = F.create_map(*[F.lit(x) for i, w in enumerate(weights) for x in (i, w)])
    s = (sizes.withColumn("weight", F.element_at(cycle, F.pmod(F.row_number().over(by_source) - 1,
                                                            F.lit(len(weights)))).cast("long"))
         .withColumn("cap", F.col("source_size") * most))
    fill = W.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before = fill.rowsBetween(W.unboundedPreceding, -1)
    rest = fill.rowsBetween(0, W.unboundedFollowing)
    every = W.partitionBy()
    s = (s.withColumn("_full", F.coalesce(F.sum("cap").over(before), F.lit(0)))
         .withColumn("_rest", F.sum("weight").over(rest))
         .withColumn("_all", F.sum("source_size").over(every)))
    # the level if exactly the sources before this one are full
    s = s.withColumn("_level", (F.col("_all") * F.lit(float(share)) - F.col("_full")) / F.col("_rest"))
    # the first source that its level does not fill fixes the level of the rest
    s = s.withColumn("_open", F.col("_level") * F.col("weight") <= F.col("cap"))
    level = F.min(F.when(F.col("_open"), F.struct(F.col("_full"), F.col("_level")))).over(every)["_level"]
    return (s.withColumn("_fixed", level)
            .withColumn("target", F.when(F.col("_fixed").isNull(), F.col("cap").cast("double"))
                        .otherwise(F.least(F.col("cap").cast("double"), F.col("_fixed") * F.col("weight"))))
            .select("source", "source_size", "target"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST,
        seed: str = "mix", scratch: list[str] | None = None) -> DataFrame:
    """``docs`` with size, source_size, target, rate and ``copies`` (how often the mix takes the row)."""
    out = ("size", "source_size", "target", "rate", "copies")
    docs = docs.drop(*out).withColumn("size", word_count(F.col("text")))
    sizes = stored(docs.groupBy("source").agg(F.sum("size").alias("source_size")), "mix-sources", scratch)
    table = stored(targets(sizes, weights, share, most), "mix-targets", scratch)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    extra = (draw(F.col("doc_id"), F.col("text"), seed) < F.col("rate") - F.floor("rate")).cast("int")
    return (join_small(docs, table, "source").withColumn("rate", rate)
            .withColumn("copies", (F.floor("rate") + extra).cast("int")))


def emit(mixed: DataFrame) -> DataFrame:
    """Each row of :func:`mix` repeated ``copies`` times (rows taken 0 times go)."""
    return (mixed.where("copies > 0")
            .withColumn("_copy", F.explode(F.array_repeat(F.lit(1), F.col("copies")))).drop("_copy"))


def op2_mix_sources(spark, sf_dir: str) -> DataFrame:
    """taken = size x copies of every document. The sizes are counted once into
    a narrow stored table; texts are not carried further."""
    docs = read(spark, sf_dir, "documents")
    mixed = mix(docs)
    return mixed.select("doc_id", "size", "source_size", "target",
                        (F.col("size") * F.col("copies")).alias("taken"))


OP2_SQL = r"""
WITH d AS (
  SELECT doc_id, text, source,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS k
  FROM d GROUP BY source),
w AS (SELECT *, CASE k % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight,
             (SELECT sum(size) FROM d) * 1.5::DOUBLE AS total FROM s),
level AS (  -- the level at which the capped shares use up the total
  SELECT arg_min((a.total - b.used) / b.open_weight, 2.0::DOUBLE * a.source_size / a.weight) AS lv
  FROM w a, (SELECT c.k, coalesce(sum(2 * o.source_size) FILTER (
                      WHERE 2.0::DOUBLE * o.source_size / o.weight < 2.0::DOUBLE * c.source_size / c.weight), 0)::DOUBLE AS used,
                    (sum(o.weight) FILTER (
                      WHERE 2.0::DOUBLE * o.source_size / o.weight >= 2.0::DOUBLE * c.source_size / c.weight))::DOUBLE AS open_weight
             FROM w c, w o GROUP BY c.k, c.source_size, c.weight) b
  WHERE a.k = b.k AND (a.total - b.used) / b.open_weight * a.weight <= 2.0::DOUBLE * a.source_size),
t AS (SELECT source, source_size, least(2.0::DOUBLE * source_size,
             coalesce((SELECT lv FROM level), 'inf'::DOUBLE) * weight) AS target FROM w),
r AS (
  SELECT d.doc_id, d.size, t.source_size, t.target,
         CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0::DOUBLE END AS rate,
         ('0x' || substr(md5(coalesce(d.doc_id::VARCHAR, md5(coalesce(d.text, ''))) || ':mix'), 1, 13))::BIGINT
           / 4503599627370496.0::DOUBLE AS u
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       (size * (floor(rate)::BIGINT + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM r
"""
