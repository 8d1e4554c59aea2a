"""Operator 12: prefix trie of conversations, subtree totals by parallel tree contraction.

A node is a distinct sequence of first turns. Its name is (smallest member
conversation, depth): a conversation has one node at each depth, so no two nodes share a name.

1. Every turn becomes three hashes of (role, text) and the text's size; texts are read
   once and never shuffled. Turns are numbered by prefix sums over range partitions, so
   a conversation with a third of all rows is split.
2. The running sums of three 40-bit hashes of (position, turn) name a prefix: rows with
   equal (depth, sums) are one node, counted by a partial aggregate, so a very common
   first turn is reduced before the shuffle.
3. Contraction, in rounds of joins over stored tables. Rake: childless nodes are done, their
   totals are added to their parents by a partial aggregate. Compress: in chains of nodes
   with one child each, those whose depth has fewer trailing zero bits than both
   neighbours' are cut out, their totals added to the parent, their child handed to it: about
   half of a chain a round. A tree of n nodes takes about log n rounds, however deep.
4. Expansion, last round first: a node cut out has its own total at that time plus the
   total of the child it had, which is known from a later round.

A round reads only what the round before left, so the work of all rounds is a small
multiple of the first. Tables lie below ``spark.checkpoint.dir``; nothing but row
counts reaches the driver. The numbers of a node's ending conversations are hashed as a
stream of sorted batches; they are never held together, but the hash of one
node is one task's work by its definition.

Defined results: rows without a conversation number are left out; turns are ordered by number
(null first), equal numbers by the hashes of (role, text), so equal rows may trade
places; null role or text is empty; repeated rows are turns of their own; an empty table
gives no node; extra columns are ignored. Sums of hashes need conversations of fewer
than 2**22 turns; beyond that the sum raises an error rather than wrap.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ranking import running_within
from ..operators.skew import plain
from .common import drop, read, stored

#: The rebuilt conversations share their first turns in groups of GROUP, MOST - 1 turns at most.
GROUP, MOST = 5, 9
KEY = ("s1", "s2", "s3")


def digests(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, k1, k2, k3, n_bytes) of every turn with a conversation number."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn",
        *[F.xxhash64(F.lit(i), text("role"), text("text")).alias(f"k{i}") for i in (1, 2, 3)],
        F.octet_length(text("text")).cast("long").alias("n_bytes"))


def numbered(turns: DataFrame, scratch: list[str]) -> DataFrame:
    """``turns`` with ``depth``, the 1-based place in the conversation."""
    return running_within(turns, "conv_id", ["turn", "k1", "k2", "k3"], "depth", scratch=scratch)


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(turns, conversations) of the rebuilt conversations, from numbered turns.

    Conversation c takes the first h turns of c - c % GROUP, h = crc32(c) % MOST, then its
    own after its first h. One join per turn with its group's row of at most 2 * GROUP
    members; turns are dealt to the members that take them.
    """
    base = F.col("conv_id") - F.col("conv_id") % GROUP
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % MOST).cast("long")
    convs = turns.groupBy("conv_id").agg(F.count("*").alias("n")).withColumn("base", base).withColumn("h", h)
    groups = convs.groupBy("base").agg(
        F.coalesce(F.max(F.when(F.col("conv_id") == F.col("base"), F.col("n"))), F.lit(0)).alias("first"),
        F.collect_list(F.struct("conv_id", "n", "h")).alias("members"))
    total = lambda m, first: F.least(m["h"], first) + F.greatest(F.lit(0), m["n"] - m["h"])
    groups = groups.withColumn("members", F.transform("members", lambda m: F.struct(
        m["conv_id"].alias("conv_id"), m["h"].alias("h"), total(m, F.col("first")).alias("total"))))
    rows = turns.withColumn("base", base).withColumn("h", h).join(plain(groups), "base")
    place = lambda c, d, t: F.struct(c.alias("conv_id"), d.alias("depth"), t.alias("total"))
    none = F.array().cast("array<struct<conv_id:bigint,depth:bigint,total:bigint>>")
    given = F.when((F.col("conv_id") == F.col("base")) & (F.col("depth") < MOST), F.transform(
        F.filter("members", lambda m: m["h"] >= F.col("depth")), lambda m: place(m["conv_id"], F.col("depth"), m["total"])))
    own = F.when(F.col("depth") > F.col("h"), F.transform(
        F.filter("members", lambda m: m["conv_id"] == F.col("conv_id")),
        lambda m: place(m["conv_id"], F.least("h", "first") + F.col("depth") - F.col("h"), m["total"])))
    out = rows.select(F.explode(F.concat(F.coalesce(given, none), F.coalesce(own, none))).alias("to"), "k1", "k2", "k3", "n_bytes")
    return (out.select("to.conv_id", "to.depth", "to.total", "k1", "k2", "k3", "n_bytes"),
            groups.select(F.explode("members").alias("m")).select("m.conv_id", "m.total"))


def prefixes(turns: DataFrame, scratch: list[str]) -> DataFrame:
    """Turns (conv_id, depth, total, k1, k2, k3, n_bytes) with the name of the prefix that ends there (s1, s2, s3)
    and of the one before it (p1, p2, p3)."""
    part = lambda i: F.shiftrightunsigned(F.xxhash64(F.lit(i), "depth", "k1", "k2", "k3"), 24)
    rows = turns.select("conv_id", "depth", "total", "n_bytes", *[part(i).alias(f"f{i}") for i in (1, 2, 3)])
    summed = running_within(rows, "conv_id", ["depth"], "_at", {f"s{i}": f"f{i}" for i in (1, 2, 3)}, scratch=scratch)
    return summed.select("conv_id", "depth", "total", "n_bytes", *KEY, *[(F.col(f"s{i}") - F.col(f"f{i}")).alias(f"p{i}") for i in (1, 2, 3)])


def end_hashes(ends: DataFrame) -> DataFrame:
    """(depth, s1, s2, s3, ends_sha256): SHA-256 of the conversation numbers of each prefix in
    ascending order, joined by commas; sorted rows pass through as a stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        import numpy as np

        key = digest = None

        def out(found):
            cols = list(zip(*found)) if found else [()] * 5
            kinds = [pa.int64()] * 4 + [pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["depth", *KEY, "ends_sha256"])

        for batch in batches:
            if not batch.num_rows:
                continue
            found = []
            cols = [np.asarray(batch.column(i)) for i in range(4)]
            ids = batch.column(4).to_pylist()
            cut = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols], axis=0)) + 1
            for lo, hi in zip([0, *cut], [*cut, len(ids)]):
                now = tuple(int(c[lo]) for c in cols)
                text = ",".join(map(str, ids[lo:hi])).encode()
                if now == key:
                    digest.update(b"," + text)
                    continue
                if key is not None:
                    found.append((*key, digest.hexdigest()))
                key, digest = now, hashlib.sha256(text)
            yield out(found)
        if key is not None:
            yield out([(*key, digest.hexdigest())])

    return ends.select("depth", *KEY, "conv_id").repartition("depth", *KEY).sortWithinPartitions("depth", *KEY, "conv_id") \
        .mapInArrow(run, "depth long, s1 long, s2 long, s3 long, ends_sha256 string")


def nodes(turns: DataFrame, convs: DataFrame, scratch: list[str]) -> DataFrame:
    """Stored (conv_id, depth, parent_conv_id, n_convs, n_bytes, n_children, ends_sha256) of every node.

    ``turns``: conv_id, depth (1, 2, ...), total (the conversation's length), k1, k2, k3, n_bytes; ``convs``: conv_id, total."""
    rows = stored(prefixes(turns, scratch), "trie-rows", scratch)
    zero = [F.lit(0).cast("long").alias(k) for k in KEY]
    found = rows.groupBy("depth", *KEY).agg(
        F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.max("n_bytes").alias("n_bytes"),
        *[F.max(p).alias(p) for p in ("p1", "p2", "p3")])
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0").select(
        F.lit(0).cast("long").alias("depth"), *zero, "conv_id", "n_convs", F.lit(0).cast("long").alias("n_bytes"),
        *[F.lit(None).cast("long").alias(p) for p in ("p1", "p2", "p3")])
    ends = rows.where("depth = total").select("depth", *KEY, "conv_id").unionByName(
        convs.where("total = 0").select(F.lit(0).cast("long").alias("depth"), *zero, "conv_id"))
    named = stored(found.unionByName(root).join(end_hashes(ends), ["depth", *KEY], "left"), "trie-named", scratch)
    # a hot parent's children are split: both sides are plain scans, the parents are unique
    parent = named.select((F.col("depth") + 1).alias("depth"), *[F.col(f"s{i}").alias(f"p{i}") for i in (1, 2, 3)],
                          F.col("conv_id").alias("parent_conv_id"))
    linked = stored(named.drop(*KEY).join(parent, ["depth", "p1", "p2", "p3"], "left").drop("p1", "p2", "p3"), "trie-linked", scratch)
    kids = linked.where("depth > 0").groupBy(F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("depth")) \
        .agg(F.count("*").alias("n_children"))
    empty = F.sha2(F.lit("").cast("binary"), 256)
    return stored(linked.join(kids, ["conv_id", "depth"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
                  .withColumn("ends_sha256", F.coalesce("ends_sha256", empty)), "trie-nodes", scratch)


def order_of(depth):
    """Place of a node in the choice of chain nodes: lowest set bit of the depth, then the depth."""
    return F.struct(depth.bitwiseAND(-depth).alias("bit"), depth.alias("depth"))


def rake(active: DataFrame, values: list[str]) -> DataFrame:
    """``active`` without its childless nodes: their values go to their parents. ``only_c``, ``only_d`` name
    a child that stays (the only one where n is 1)."""
    sums = active.where("pc is not null").groupBy(F.col("pc").alias("c"), F.col("pd").alias("d")).agg(
        F.count_if(F.col("n") > 0).alias("stay"), F.max(F.when(F.col("n") > 0, F.struct("c", "d"))).alias("only"),
        *[F.sum(F.when(F.col("n") == 0, F.col(v)).otherwise(0)).alias(f"+{v}") for v in values])
    return active.where("n > 0").join(sums, ["c", "d"]).select(
        "c", "d", "pc", "pd", F.col("stay").alias("n"), *[(F.col(v) + F.col(f"+{v}")).alias(v) for v in values],
        F.col("only.c").alias("only_c"), F.col("only.d").alias("only_d"))


def chosen(raked: DataFrame, values: list[str]) -> DataFrame:
    """Chain nodes to cut out this round, no two of them neighbours."""
    parent = raked.select(F.col("c").alias("pc"), F.col("d").alias("pd"),
                          ((F.col("n") == 1) & F.col("pc").isNotNull()).alias("in_chain"))
    single = raked.where("n = 1 and pc is not null")
    mine = order_of(F.col("d"))
    return single.join(parent, ["pc", "pd"]).where(
        (mine < order_of(F.col("only_d"))) & (~F.col("in_chain") | (mine < order_of(F.col("pd"))))) \
        .select("c", "d", "pc", "pd", "only_c", "only_d", *values)


def compress(raked: DataFrame, cut: DataFrame, values: list[str]) -> DataFrame:
    """``raked`` without the nodes of ``cut``: parents take their values, children their parents."""
    no = F.lit(None).cast("long")
    changes = cut.select("c", "d", F.lit(True).alias("gone"), no.alias("to_c"), no.alias("to_d"), *[F.lit(0).cast("long").alias(f"+{v}") for v in values]) \
        .unionByName(cut.select(F.col("only_c").alias("c"), F.col("only_d").alias("d"), F.lit(False).alias("gone"), F.col("pc").alias("to_c"),
                                F.col("pd").alias("to_d"), *[F.lit(0).cast("long").alias(f"+{v}") for v in values])) \
        .unionByName(cut.select(F.col("pc").alias("c"), F.col("pd").alias("d"), F.lit(False).alias("gone"), no.alias("to_c"), no.alias("to_d"),
                                *[F.col(v).alias(f"+{v}") for v in values]))
    changes = changes.groupBy("c", "d").agg(F.max("gone").alias("gone"), F.max("to_c").alias("to_c"), F.max("to_d").alias("to_d"),
                                            *[F.sum(f"+{v}").alias(f"+{v}") for v in values])
    return raked.join(changes, ["c", "d"], "left").where("gone is null or not gone").select(
        "c", "d", F.coalesce("to_c", "pc").alias("pc"), F.coalesce("to_d", "pd").alias("pd"), "n",
        *[(F.col(v) + F.coalesce(F.col(f"+{v}"), F.lit(0))).alias(v) for v in values])


def subtree_totals(forest: DataFrame, values: list[str], scratch: list[str]) -> DataFrame:
    """(c, d, values...): of every node the sums of ``values`` over its subtree, itself included.

    ``forest``: node (c, d), its parent (pc, pd; null at a root), n (number of children), long columns ``values``.
    d is the depth and grows along every path."""
    active = stored(forest.select("c", "d", "pc", "pd", "n", *values), "trie-active", scratch)
    rounds: list[tuple[DataFrame, DataFrame | None]] = []
    while not active.isEmpty():
        raked = stored(rake(active, values), "trie-raked", scratch)
        if raked.isEmpty():
            rounds.append((active.where("n = 0"), None))
            break
        cut = stored(chosen(raked, values), "trie-cut", scratch)
        rounds.append((active.where("n = 0"), cut))
        active = stored(compress(raked, cut, values), "trie-active", scratch)
    done: list[DataFrame] = []
    for leaves, cut in reversed(rounds):
        if cut is not None and done:
            known = done[0]
            for later in done[1:]:
                known = known.unionByName(later)
            known = known.select(F.col("c").alias("only_c"), F.col("d").alias("only_d"), *[F.col(v).alias(f"+{v}") for v in values])
            done.append(stored(cut.join(known, ["only_c", "only_d"]).select(
                "c", "d", *[(F.col(v) + F.col(f"+{v}")).alias(v) for v in values]), "trie-known", scratch))
        done.append(leaves.select("c", "d", *values))
    out = forest.limit(0).select("c", "d", *values)
    for part in done:
        out = out.unionByName(part)
    return out


def prefix_trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of
    every node; ``turns`` and ``convs`` as :func:`nodes` takes them."""
    scratch: list[str] = []
    found = nodes(turns, convs, scratch)
    forest = found.select(F.col("conv_id").alias("c"), F.col("depth").alias("d"), F.col("parent_conv_id").alias("pc"),
                          F.when(F.col("depth") > 0, F.col("depth") - 1).alias("pd"), F.col("n_children").alias("n"),
                          F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long").alias("n_leaves"),
                          ((F.col("n_convs") - 1) * F.col("n_bytes")).alias("saved_tokens"))
    totals = subtree_totals(forest, ["n_leaves", "saved_tokens"], scratch)
    out = found.join(totals.withColumnsRenamed({"c": "conv_id", "d": "depth"}), ["conv_id", "depth"]).select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    out = stored(out, "trie-result")
    drop(turns.sparkSession, scratch)
    return out


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch: list[str] = []
    turns = stored(numbered(digests(read(spark, sf_dir, "conversations")), scratch), "trie-turns", scratch)
    out = prefix_trie(*rebuilt(turns))
    drop(spark, scratch)
    return out


#: CRC-32 of the decimal text of a number, for DuckDB: the table of 256 steps, then one step a digit.
CRC_SQL = r"""crc AS (
  SELECT list(v ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END) AS v
    FROM (SELECT unnest(range(256)) AS i)))"""
CRC_OF = r"""xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({}::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
  lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295::BIGINT)"""

OP12_SQL = "WITH " + CRC_SQL + r""",
o AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
        row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, count(*) AS n FROM o GROUP BY conv_id),
h AS (SELECT conv_id, n, conv_id - conv_id % 5 AS base, """ + CRC_OF.format("conv_id") + r""" % 9 AS h FROM c, crc),
g AS (SELECT h.*, coalesce(b.n, 0) AS bn FROM h LEFT JOIN c b ON b.conv_id = h.base),
r AS (
  SELECT g.conv_id, o.pos AS d, o.role, o.text FROM g JOIN o ON o.conv_id = g.base AND o.pos <= g.h
  UNION ALL
  SELECT g.conv_id, least(g.h, g.bn) + o.pos - g.h, o.role, o.text FROM g JOIN o ON o.conv_id = g.conv_id AND o.pos > g.h),
len AS (SELECT conv_id, least(h, bn) + greatest(0, n - h) AS total FROM g),
p AS (SELECT conv_id, d, text, list({'r': role, 't': text}) OVER (PARTITION BY conv_id ORDER BY d) AS path FROM r
  UNION ALL SELECT conv_id, 0, '', []::STRUCT(r VARCHAR, t VARCHAR)[] FROM g),
named AS (SELECT conv_id AS member, d, text, min(conv_id) OVER (PARTITION BY d, path) AS node FROM p),
v AS (SELECT node, d, count(*) AS n_convs, (count(*) - 1) * max(strlen(text)) AS saved,
        string_agg(member::VARCHAR, ',' ORDER BY member) FILTER (WHERE d = len.total) AS ends
      FROM named JOIN len ON len.conv_id = member GROUP BY node, d),
e AS (SELECT DISTINCT a.node, a.d, b.node AS parent FROM named a JOIN named b ON b.member = a.member AND b.d = a.d - 1),
k AS (SELECT parent AS node, d - 1 AS d, count(*) AS n_children FROM e GROUP BY 1, 2),
under AS (SELECT DISTINCT a.node, a.d, b.node AS sub, b.d AS sub_d FROM named a JOIN named b ON b.member = a.member AND b.d >= a.d),
t AS (SELECT under.node, under.d, count(*) FILTER (WHERE k.node IS NULL) AS n_leaves, sum(v.saved)::BIGINT AS saved_tokens
      FROM under JOIN v ON v.node = sub AND v.d = sub_d LEFT JOIN k ON k.node = sub AND k.d = sub_d GROUP BY 1, 2)
SELECT v.node AS conv_id, v.d AS depth, e.parent AS parent_conv_id, v.n_convs, coalesce(k.n_children, 0) AS n_children,
  t.n_leaves, t.saved_tokens, sha256(coalesce(v.ends, '')) AS ends_sha256
FROM v JOIN t USING (node, d) LEFT JOIN e USING (node, d) LEFT JOIN k USING (node, d)
"""
