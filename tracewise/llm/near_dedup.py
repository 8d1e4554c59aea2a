"""Operator 7: near-duplicate groups by fast similarity sketching.

Sketch: in round i every shingle is hashed into one of T bins with a value in
[i, i+1), and a bin keeps its smallest value; after T such rounds, T more each put
all shingles in one bin in turn, so every bin is sure to fill. Rounds stop as soon
as all bins are full: a long text needs one to three, a short one
more. Two sets agree in a bin with the probability of their Jaccard similarity,
with the concentration of a sum of T nearly independent draws.

1. Documents with equal shingle sets are one class, represented by its smallest
   doc_id (copies meet in a partial aggregate, not in a task).
2. BANDS bands of ROWS bins are hashed to buckets. At similarity 0.8 a pair shares a
   bucket but for a chance of 3e-7.
3. Every member of a bucket is compared with the bucket's smallest doc_id: first by
   the share of agreeing bins (MARGIN is 4.5 standard deviations below the threshold,
   so a link passes but for a chance of about 1e-5), then exactly on the full sets.
4. Components of these links. Buckets whose members are still in different components
   are searched again, by sketches alone, in blocks of BLOCK members: each member proposes its
   best-agreeing pairs with other components, the pairs not tried before are
   confirmed on full sets and merged, and the next of ROUNDS proposes more. The last compares every
   likely pair left, so no link that joins components is lost: full sets travel to the groups in which
   a member has such a pair, and the pairs are confirmed there without a row for each.
5. Components of all links, by alternating large-star and small-star steps on
   stored tables; nothing but counts reaches the driver.

Full sets are computed again only for documents that a Bloom filter of fixed size
names; the exact join follows.

Defined results: words are split at space, \\t \\n \\v \\f \\r after lower-casing A-Z; a text
with fewer words than a shingle has its whole word sequence as one; null, empty or
blank text has the empty set and is linked with nothing; rows without a
doc_id are classed with equal texts but never represent or link a class;
repeated doc_ids count as one document with all its texts; an empty
table gives no rows; extra columns are ignored (keep_representatives: carried).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop, read, stored, worker_cache
from .quality_rules import WordHashes

T, BANDS, ROWS, MARGIN, BLOCK = 288, 38, 5, 0.107, 4096
#: Bytes of full sets in a block of the last round.
BLOCK_BYTES = 8 << 20
#: Pairs that a member proposes per bucket (or pair of blocks) and round; the last round takes all that are left.
ROUNDS = (2, 16, None)
#: With fewer than one link in FEW proposed pairs, the rounds between are left out.
FEW = 20
FILTER_BITS = 26        # 8 MB Bloom filter of the documents whose full sets are needed
PRIME, OTHER = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
EMPTY = np.iinfo(np.uint64).max


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * OTHER
    h = (h ^ (h >> np.uint64(29))) * PRIME
    return h ^ (h >> np.uint64(32))


def shingles(text: str | None, n: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word n-grams."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()     # bytes: A-Z and the six blanks only
    if not words:
        return np.zeros(0, np.uint64)
    memo = worker_cache("near_dedup").setdefault("words", WordHashes())
    h = np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))
    k = min(n, len(h))
    out = h[:len(h) - k + 1].copy()
    for i in range(1, k):
        out = out * OTHER + h[i:len(h) - k + 1 + i]
    return np.unique(mixed(out + np.uint64(k)))


def seeds() -> np.ndarray:
    return mixed((np.arange(2 * T, dtype=np.uint64) + np.uint64(1)) * PRIME)


def sketch(values: np.ndarray) -> np.ndarray:
    """T bins of a non-empty set: round number in the top 16 bits, then 48 bits of hash."""
    bins = np.full(T, EMPTY, np.uint64)
    step = max(1, min(2 * T, -(-6 * T // len(values))))
    for first in range(0, 2 * T, step):
        rounds = np.arange(first, min(first + step, 2 * T))
        h = mixed(values[None, :] ^ SEEDS[rounds][:, None])
        at = ((h & np.uint64(0xFFFFFFFF)) * np.uint64(T) >> np.uint64(32)).astype(np.int64)
        sure = rounds >= T
        at[sure] = (rounds[sure] - T)[:, None]
        value = (rounds.astype(np.uint64)[:, None] << np.uint64(48)) | (mixed(h) >> np.uint64(16))
        np.minimum.at(bins, at.ravel(), value.ravel())
        if bins.max() != EMPTY:
            break
    return bins


SEEDS = seeds()


def buckets(bins: np.ndarray) -> np.ndarray:
    rows = bins[:BANDS * ROWS].reshape(BANDS, ROWS)
    h = np.arange(1, BANDS + 1, dtype=np.uint64) * PRIME
    for k in range(ROWS):
        h = mixed(h ^ rows[:, k])
    return h


SKETCH = "doc_id long, n long, h1 long, h2 long, sig binary, bands array<long>, row1 long, row2 long"


def sketches(docs: DataFrame, n: int) -> DataFrame:
    """Per row of (doc_id, text, row1, row2): size and 128-bit hash of the shingle set, one byte per bin, bucket of each band."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                values = shingles(text.as_py(), n)
                if not len(values):
                    rows.append((doc_id, 0, None, None, None, None))
                    continue
                bins = sketch(values)
                h = xxhash.xxh3_128_digest(values.tobytes())
                rows.append((doc_id, len(values), int.from_bytes(h[:8], "little", signed=True), int.from_bytes(h[8:], "little", signed=True),
                             (bins & np.uint64(255)).astype(np.uint8).tobytes(), buckets(bins).view(np.int64)))
            cols = list(zip(*rows)) if rows else [()] * 6
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)] + [batch.column(2), batch.column(3)],
                                             names=["doc_id", "n", "h1", "h2", "sig", "bands", "row1", "row2"])

    return docs.select(F.col("doc_id").cast("long"), "text", "row1", "row2").mapInArrow(run, SKETCH)


def agree_count(a: pa.Array, b: pa.Array) -> np.ndarray:
    x, y = (np.frombuffer(b"".join(v.to_pylist()), np.uint8).reshape(-1, T) for v in (a, b))
    return (x == y).sum(1)


def likely(percent: int):
    """Column function (sig, n, sig, n): enough bins agree and the sizes allow the similarity."""
    least = (percent / 100 - MARGIN) * T

    @F.arrow_udf("boolean")
    def check(s1: pa.Array, n1: pa.Array, s2: pa.Array, n2: pa.Array) -> pa.Array:
        a, b = np.array(n1), np.array(n2)
        ok = 100 * np.minimum(a, b) >= percent * np.maximum(a, b)
        return pa.array(ok & (agree_count(s1, s2) >= least))

    return check


def similar(percent: int):
    """Column function on two sets (bytes of sorted hashes): 100 * both >= percent * either."""

    @F.arrow_udf("boolean")
    def check(s1: pa.Array, s2: pa.Array) -> pa.Array:
        out = []
        for a, b in zip(s1, s2):
            x, y = np.frombuffer(a.as_py(), np.uint64), np.frombuffer(b.as_py(), np.uint64)
            both = len(x) + len(y) - len(np.union1d(x, y))
            out.append(100 * both >= percent * (len(x) + len(y) - both))
        return pa.array(out, pa.bool_())

    return check


def id_slot(column):
    return F.pmod(F.xxhash64(column), F.lit(1 << FILTER_BITS))


def bloom(ids: DataFrame) -> bytes:
    """Bit set of the hash slots of ``ids`` (doc_id): 2**FILTER_BITS bits whatever
    their number, merged per 64 KB piece in Spark."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(1 << FILTER_BITS, bool)
        for batch in batches:
            bits[np.array(batch.column(0))] = True
        packed = np.packbits(bits, bitorder="little").reshape(-1, 1 << 16)
        at = np.flatnonzero(packed.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array([packed[i].tobytes() for i in at], pa.binary())], names=["piece", "bits"])

    def merge(table: pa.Table) -> pa.Table:
        whole = np.bitwise_or.reduce([np.frombuffer(b, np.uint8) for b in table["bits"].to_pylist()])
        return pa.table({"piece": table["piece"].slice(0, 1), "bits": pa.array([whole.tobytes()], pa.binary())})

    out = np.zeros((1 << FILTER_BITS) // 8, np.uint8).reshape(-1, 1 << 16)
    parts = ids.select(id_slot("doc_id").alias("slot")).mapInArrow(pieces, "piece long, bits binary") \
        .groupBy("piece").applyInArrow(merge, "piece long, bits binary")
    for r in parts.collect():
        out[r["piece"]] = np.frombuffer(r["bits"], np.uint8)
    return out.tobytes()


def full_sets(docs: DataFrame, ids: DataFrame, n: int) -> DataFrame:
    """(doc_id, set) of at least the documents in ``ids``: one more scan, no shuffle of texts."""
    shared = docs.sparkSession.sparkContext.broadcast(bloom(ids))       # 2**FILTER_BITS / 8 bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(shared.value, np.uint8)
        for batch in batches:
            slots = np.array(batch.column(2))
            at = np.flatnonzero((bits[slots >> 3] >> (slots & 7).astype(np.uint8)) & 1)
            doc_ids, texts = batch.column(0).take(pa.array(at)), batch.column(1).take(pa.array(at))
            yield pa.RecordBatch.from_arrays([doc_ids, pa.array([shingles(t.as_py(), n).tobytes() for t in texts], pa.binary())], names=["doc_id", "set"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null") \
        .withColumn("slot", id_slot("doc_id")).mapInArrow(run, "doc_id long, set binary")


def verified(pairs: DataFrame, docs: DataFrame, n: int, percent: int, name: str, own: list[str], scratch: list[str]) -> DataFrame:
    """The stored (a, b) pairs that are links on the full sets. The sets' path goes to
    ``own``, the links' to ``scratch``."""
    # each side's ids once, so no row is made per pair and side
    ids = pairs.select(F.col("a").alias("doc_id")).distinct().unionByName(pairs.select(F.col("b").alias("doc_id")).distinct()).distinct()
    sets = stored(full_sets(docs, ids, n), f"{name}-sets", own)
    links = pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("set").alias("set_a")), "a") \
        .join(sets.select(F.col("doc_id").alias("b"), F.col("set").alias("set_b")), "b") \
        .where(similar(percent)(F.col("set_a"), F.col("set_b"))).select("a", "b")
    return stored(links, f"{name}-links", scratch)


def components(links: DataFrame, scratch: list[str]) -> DataFrame:
    """(id, component) of every id in the stored links (a, b): component is the smallest
    id reachable. Large-star steps point all larger neighbours of a node to its smallest
    neighbour, small-star steps all smaller ones; until nothing changes."""
    spark = links.sparkSession

    def settled(e: DataFrame) -> bool:
        """Every node points to one other that points nowhere: as edges lead to smaller ids, each component is a star around its smallest."""
        ends = e.select("u", F.lit(1).alias("out"), F.lit(0).alias("into")).unionByName(e.select(F.col("v").alias("u"), F.lit(0).alias("out"), F.lit(1).alias("into")))
        return ends.groupBy("u").agg(F.sum("out").alias("out"), F.max("into").alias("into")).where("out > 1 or (out = 1 and into = 1)").isEmpty()

    def star(e: DataFrame, large: bool, name: str, own: list[str]) -> DataFrame:
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else \
            e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = stored(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), f"{name}-least", own)
        # both sides are plain: a hub with very many edges is split as a skewed join
        moved = (both.where("v > u") if large else both).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        if not large:
            moved = moved.unionByName(least.select("u", F.col("m").alias("v")))
        return stored(moved.where("u <> v").distinct(), name, own)

    edges, owned = links.select(F.col("a").alias("u"), F.col("b").alias("v")).where("a <> b"), []
    while True:
        own: list[str] = []
        edges = star(star(edges, True, "large-star", own), False, "small-star", own)
        drop(spark, owned)
        owned = own
        if settled(edges):
            break
    scratch += owned
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component"))


def in_blocks(members: DataFrame, *more: str) -> DataFrame:
    """(id, component, n, own, sig, hub, bucket, lo, hi, band) and ``more`` of ``members``, dealt and sorted by (bucket, lo, hi).
    Input rows: bucket, band, hub, blocks, id, component, n, sig. A bucket of one block is one group; one of
    several is dealt over its blocks by id, every pair of blocks a group."""
    rows = (members.withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
            .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
            .withColumn("lo", F.least("own", "other")).withColumn("hi", F.greatest("own", "other")))
    return rows.select("id", "component", "n", "own", "sig", "hub", "bucket", "lo", "hi", "band", *more)


def dealt(rows: DataFrame) -> DataFrame:
    return rows.repartition("bucket", "lo", "hi").sortWithinPartitions("bucket", "lo", "hi")


def groups_of(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """Groups of two rows or more of :func:`in_blocks`, one after the other."""
    key, group = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if row[6:9] != key:
                if len(group) > 1:
                    yield group
                key, group = row[6:9], []
            group.append(row)
    if len(group) > 1:
        yield group


class Group:
    """Rows of one group as arrays; ``likely_with`` names the members that a member probably links to."""

    def __init__(self, rows: list[tuple], percent: int):
        self.ids, self.comps, self.sizes, self.owns = (np.array([g[k] for g in rows]) for k in range(4))
        self.sig = np.frombuffer(b"".join(g[4] for g in rows), np.uint8).reshape(-1, T)
        self.hub, (self.bucket, self.lo, self.hi), self.band = rows[0][5], rows[0][6:9], rows[0][9]
        self.percent, self.least = percent, (percent / 100 - MARGIN) * T

    def others(self) -> np.ndarray:
        return np.flatnonzero(self.ids != self.hub)      # the hub was compared with all members before

    def likely_with(self, i: int, later: bool) -> tuple[np.ndarray, np.ndarray]:
        """Members of other components (with larger ids only, if ``later``) and the bins that agree."""
        sizes, i_size = self.sizes, self.sizes[i]
        fits = (self.comps != self.comps[i]) & (self.ids != self.hub) & (100 * np.minimum(sizes, i_size) >= self.percent * np.maximum(sizes, i_size))
        if self.lo != self.hi:
            fits &= self.owns != self.owns[i]
        if later:
            fits &= self.ids > self.ids[i]
        j = np.flatnonzero(fits)
        same = self.sig[j] == self.sig[i]
        agree = same.sum(1)
        # a pair belongs to its first common bucket: the one of the first band with equal bins
        fits = (agree >= self.least) & ~same[:, :self.band * ROWS].reshape(len(j), self.band, ROWS).all(2).any(1)
        return j[fits], agree[fits]


def cross_pairs(members: DataFrame, percent: int, most: int) -> DataFrame:
    """Likely pairs (a, b) of different components in one bucket: of every member the
    ``most`` with the best agreement in each block pair. Input rows:
    bucket, band, hub, size (members of the bucket), id, component, n, sig. A pair is found in one bucket
    only, by the bins' bytes (a chance of 1e-12 per band to take an earlier bucket for common). A bucket of up to BLOCK
    members is one group; a larger one is dealt over blocks, every pair of blocks a group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in groups_of(batches):
            group, found, waiting = Group(rows, percent), [], 0
            ids = group.ids
            for i in group.others():
                j, agree = group.likely_with(i, False)
                if len(j) > most:
                    j = j[np.lexsort((ids[j], -agree))[:most]]
                found.append(np.stack((np.minimum(ids[j], ids[i]), np.maximum(ids[j], ids[i]))))
                waiting += len(j)
                if waiting > 1 << 16:
                    yield pairs_of(found)
                    found, waiting = [], 0
            if waiting:
                yield pairs_of(found)

    rows = members.withColumn("blocks", F.ceil(F.col("size") / F.lit(BLOCK)).cast("int"))
    return dealt(in_blocks(rows)).mapInArrow(run, "a long, b long").distinct()


def pairs_of(found: list[np.ndarray]) -> pa.RecordBatch:
    a, b = np.concatenate(found, axis=1)
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def asking(rows: DataFrame, percent: int) -> DataFrame:
    """(bucket, lo, hi, id) of the members of :func:`in_blocks` that have a likely pair in their group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in groups_of(batches):
            group = Group(rows, percent)
            asks = np.zeros(len(rows), bool)
            for i in group.others():
                j, _ = group.likely_with(i, True)
                asks[j] = True
                asks[i] |= len(j) > 0
            ids = group.ids[asks]
            cols = [pa.array([v] * len(ids), t) for v, t in ((group.bucket, pa.int64()), (group.lo, pa.int32()), (group.hi, pa.int32()))]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(ids, pa.int64())], names=["bucket", "lo", "hi", "id"])

    return dealt(rows).mapInArrow(run, "bucket long, lo int, hi int, id long").distinct()


def joining_links(rows: DataFrame, percent: int) -> DataFrame:
    """Links (a, b), confirmed on the full sets, that join all components that any likely pair of a group joins.
    Input: :func:`in_blocks` with the column set. Each pair of members still apart is compared in place, so no row is made per pair,
    and a group gives fewer links than it has members."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in groups_of(batches):
            group, found = Group(rows, percent), []
            ids, comps = group.ids, group.comps
            sets = [np.frombuffer(g[10], np.uint64) for g in rows]
            ends = np.cumsum([len(s) for s in sets])
            numbers, codes = np.unique(np.concatenate(sets), return_inverse=True)
            codes = np.split(codes.astype(np.int32), ends[:-1])
            own = np.zeros(len(numbers), bool)
            for i in group.others():
                j, _ = group.likely_with(i, True)
                if not len(j):
                    continue
                own[codes[i]] = True
                for first in range(0, len(j), 256):
                    k = j[first:first + 256]
                    k = k[comps[k] != comps[i]]
                    if not len(k):
                        continue
                    sizes = np.array([len(codes[x]) for x in k])
                    both = np.add.reduceat(own[np.concatenate([codes[x] for x in k])], np.concatenate(([0], np.cumsum(sizes)[:-1])), dtype=np.int64)
                    for x in k[100 * both >= percent * (len(codes[i]) + sizes - both)]:
                        if comps[x] != comps[i]:
                            found.append(np.array([[ids[i]], [ids[x]]]))
                            comps[comps == comps[x]] = comps[i]
                own[codes[i]] = False
            if found:
                yield pairs_of(found)

    return dealt(rows).mapInArrow(run, "a long, b long").distinct()


def last_links(wide: DataFrame, docs: DataFrame, n: int, percent: int, own: list[str], scratch: list[str]) -> DataFrame:
    """The last round: links that join all components that any likely pair left joins. The full sets of members
    with such a pair go to the groups of these pairs; a block holds BLOCK members and about BLOCK_BYTES of sets."""
    blocks = wide.groupBy("bucket").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") * 8 / BLOCK_BYTES)).cast("int").alias("blocks"))
    rows = in_blocks(wide.join(blocks, "bucket"))
    asked = stored(asking(rows, percent), "dedup-asking", own)
    sets = stored(full_sets(docs, asked.select(F.col("id").alias("doc_id")).distinct(), n), "dedup-last-sets", own)
    rows = rows.join(asked, ["bucket", "lo", "hi", "id"], "left_semi").join(sets.withColumnRenamed("doc_id", "id").distinct(), "id")
    rows = rows.select("id", "component", "n", "own", "sig", "hub", "bucket", "lo", "hi", "band", "set")
    return stored(joining_links(rows, percent), "dedup-last-links", scratch)


def cross_links(members: DataFrame, reps: DataFrame, docs: DataFrame, links: DataFrame, found: DataFrame, tried: DataFrame,
                n: int, percent: int, owned: list[str], scratch: list[str]) -> DataFrame:
    """Step 4: ``found`` after all links between members of one bucket. ``tried`` (a, b)
    holds the pairs confirmed or refused so far."""
    spark = docs.sparkSession
    kept: list[str] = []        # tables of all rounds: links and tried pairs
    rounds, near = list(ROUNDS), None
    while rounds:
        most = rounds.pop(0)
        own: list[str] = []
        member = stored(members.where("size > 2").join(found, "id", "left").withColumn("component", F.coalesce("component", "id")),
                        "dedup-labelled", own)
        open_ = stored(member.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi"))
                       .where("lo <> hi").select("bucket"), "dedup-open", own)
        if open_.isEmpty():
            drop(spark, own)
            break
        wide = stored(member.join(open_, "bucket"), "dedup-wide", own)
        if near is None:        # members of open buckets; later rounds have no others
            near = stored(reps.select(F.col("doc_id").alias("id"), "n", "sig").join(wide.select("id").distinct(), "id", "left_semi"),
                          "dedup-near", kept)
        wide = wide.join(near, "id")
        if most is None:
            joining = last_links(wide, docs, n, percent, own, kept)
            if not joining.isEmpty():
                links = links.unionByName(joining)
                drop(spark, owned)
                found = components(links, owned)
            drop(spark, own)
            break
        pairs = stored(cross_pairs(wide, percent, most).join(tried, ["a", "b"], "left_anti"), "dedup-proposed", kept)
        if not pairs.isEmpty():
            joining = verified(pairs, docs, n, percent, "dedup-cross", own, kept)
            tried = tried.unionByName(pairs)
            new = joining.count()
            if new * FEW < pairs.count():       # little left to join: the last round comes next
                rounds = rounds[-1:]
            if new:
                links = links.unionByName(joining)
                drop(spark, owned)
                found = components(links, owned)
        drop(spark, own)
    scratch += kept
    return found


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of (doc_id, text)."""
    none = F.lit(None).cast("long")
    return grouped(docs.select("doc_id", "text", none.alias("row1"), none.alias("row2")), shingle, percent) \
        .select("doc_id", "n_shingles", "component_id", "kept")


def grouped(docs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """near_duplicates with the class (h1, h2) and the row name (row1, row2) of every row."""
    spark, scratch, owned = docs.sparkSession, [], []
    rows = stored(sketches(docs, shingle), "dedup-sketches", scratch)
    classes = stored(rows.where("n > 0").groupBy("h1", "h2").agg(F.min("doc_id").alias("rep")), "dedup-classes", scratch)
    reps = stored(rows.where("n > 0 and doc_id is not null").join(classes.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi")
                  .select("doc_id", "n", "sig", "bands").dropDuplicates(["doc_id", "n", "sig"]), "dedup-representatives", scratch)
    banded = reps.select(F.col("doc_id").alias("id"), F.posexplode("bands").alias("band", "bucket"))
    # of buckets with equal members (by count and hash sums of 32 bits each) the first band's is searched
    h = F.xxhash64("id")
    hubs = banded.groupBy("bucket").agg(F.min("band").alias("band"), F.min("id").alias("hub"), F.count("*").alias("size"), F.sum(F.shiftrightunsigned(h, 32)).alias("s1"),
                                        F.sum(h.bitwiseAND(F.lit(0xFFFFFFFF))).alias("s2")).where("size > 1")
    hubs = stored(hubs.groupBy("hub", "size", "s1", "s2").agg(F.min(F.struct("band", "bucket")).alias("first"))
                  .select("first.bucket", "hub", "size"), "dedup-hubs", scratch)
    members = stored(banded.join(hubs, "bucket"), "dedup-members", scratch)

    # step 3: every member against its bucket's smallest id
    pairs = members.where("id <> hub").select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct()
    side = lambda c: reps.select(F.col("doc_id").alias(c), F.col("n").alias(f"n_{c}"), F.col("sig").alias(f"sig_{c}"))
    pairs = stored(pairs.join(side("a"), "a").join(side("b"), "b")
                   .where(likely(percent)(F.col("sig_a"), F.col("n_a"), F.col("sig_b"), F.col("n_b"))).select("a", "b").distinct(),
                   "dedup-pairs", scratch)
    own: list[str] = []
    links = verified(pairs, docs, shingle, percent, "dedup", own, scratch)
    drop(spark, own)
    found = components(links, owned)

    found = cross_links(members, reps, docs, links, found, pairs, shingle, percent, owned, scratch)

    # step 5: component of every class, then of every row
    labelled = stored(classes.join(found, classes["rep"] == found["id"], "left")
                      .select("h1", "h2", F.coalesce("component", "rep").alias("component_id")), "dedup-components", scratch)
    own_columns = ("doc_id", F.col("n").alias("n_shingles"), "h1", "h2", "row1", "row2")
    out = rows.where("n > 0").select(*own_columns).join(labelled, ["h1", "h2"]) \
        .unionByName(rows.where("n = 0").select(*own_columns, F.col("doc_id").alias("component_id")))
    out = stored(out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id"))), "dedup-result")
    drop(spark, scratch)
    drop(spark, owned)
    return out


def keep_representatives(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """``docs``, all columns, with one row of each group and all rows without words.

    Rows are named by two hashes of all their columns (maps apart). Of a group its smallest
    doc_id stays, with one row per distinct set of shingles (the smallest name; of rows equal in
    all columns one); of equal texts without any doc_id one row stays."""
    plain = [f.name for f in docs.schema.fields if "map<" not in f.dataType.simpleString()]
    every = [F.col(f"`{c}`") for c in plain]
    name = lambda seed: F.xxhash64(F.lit(seed), *every, *[c.isNull() for c in every])
    named = docs.withColumn("_dedup_row1", name(1)).withColumn("_dedup_row2", name(2))
    flags = grouped(named.select("doc_id", "text", F.col("_dedup_row1").alias("row1"), F.col("_dedup_row2").alias("row2")), shingle, percent)
    words = flags.where("n_shingles > 0").withColumn("row", F.struct("row1", "row2"))
    stay = words.where("kept").groupBy("h1", "h2").agg(F.min("row").alias("row")).select("row.row1", "row.row2")
    spark, scratch = docs.sparkSession, []
    stay = stored(stay.withColumn("stays", F.lit(True)), "dedup-stay", scratch)
    rows = words.groupBy("row1", "row2").agg(F.count("*").alias("copies")).join(stay, ["row1", "row2"], "left")
    marked = stored(rows.where("stays is null or copies > 1").select(
        F.col("row1").alias("_dedup_row1"), F.col("row2").alias("_dedup_row2"), F.col("stays").isNotNull().alias("_dedup_again")), "dedup-marked")
    keys = ["_dedup_row1", "_dedup_row2"]
    once = named.join(marked, keys, "left_anti")
    again = marked.where("_dedup_again").select(*keys)
    if not again.isEmpty():         # rows with an equal twin: only these are compared
        once = once.unionByName(named.join(again, keys).dropDuplicates(keys))
    drop(spark, scratch)
    return once.select(*[F.col(f"`{c}`") for c in docs.columns])


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"), shingle=4, percent=80)


OP7_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN []::VARCHAR[] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
         ELSE list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' ')) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
e AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id
  GROUP BY 1, 2
  HAVING 100 * count(*) >= 80 * ((SELECT n FROM n WHERE n.doc_id = a.doc_id) + (SELECT n FROM n WHERE n.doc_id = b.doc_id) - count(*))),
r AS (SELECT doc_id, doc_id AS c FROM documents UNION SELECT e.y, r.c FROM r JOIN e ON e.x = r.doc_id AND r.c < e.y)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, min(r.c) AS component_id, d.doc_id = min(r.c) AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN r ON r.doc_id = d.doc_id
GROUP BY d.doc_id, n.n
"""
