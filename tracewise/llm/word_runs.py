"""Operator 11: periodic runs of words by internal pattern matching.

A run is a maximal stretch with smallest period q and at least max(6, 4 q) words.

1. The texts of a slice of rows become one sequence of word numbers with a separator of its own after each text. Prefix doubling ranks the
   blocks of 1, 2, 4, ... words that start at every place and ends with the suffix array; only places whose block is not yet unique are sorted again.
2. A wavelet tree over the suffix array answers range successor queries: the occurrences of a block (an interval of the
   array) at or after a place.
3. A run of period q with b <= q < 2 b, b a power of two, holds a block of b words that starts at a multiple of b
   in the run's first b words, and the block occurs again q words later. So every such dyadic block asks for
   its occurrences in the neighbouring window [b, 2 b) words on. Two or fewer are candidates themselves. Three or more form an arithmetic
   progression whose step d is the block's period: the run's period then is the distance between the ends of the two stretches
   of period d that hold the block and its occurrences, if that lies on the progression.
4. A candidate (place, q) is extended both ways by the ranks of the doubling (common extensions in log steps) and kept if the
   stretch is long enough; of equal stretches the smallest period stays.

At most two candidates come from a block and 2 n blocks from n words, so a text takes about n log n steps whatever its
repetitions. Rows are taken in slices of about SLICE_BYTES of text, a longer text alone; memory is about 150 bytes a word.

Defined results: words are split at space, \\t \\n \\v \\f \\r; null, empty and blank texts have no word and no run;
planted repetition (the query's) needs a doc_id, rows without one are taken as they are; repeated rows count each; an
empty table gives no rows; ``find_runs`` keeps all columns (one of the output's name is replaced), the query reads doc_id and text only.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import read, row_slices
from .prefix_trie import CRC_OF, CRC_SQL

SLICE_BYTES = 1 << 19
#: A run has at least LEAST words and TIMES periods.
LEAST, TIMES = 6, 4


class Index:
    """Block ranks, suffix array and wavelet tree of a sequence of numbers in which the last is unique."""

    def __init__(self, values: np.ndarray):
        n = len(values)
        order = np.argsort(values, kind="stable")
        rank, group = self._ranks(values[order], order, np.zeros(n, np.int64))
        self.ranks, self.sizes = [rank], [group]
        width = 1
        while True:
            open_ = np.flatnonzero(group[order] > 1)          # places in the array whose blocks are not unique
            if not len(open_):
                break
            at = order[open_]
            after = np.minimum(at + width, n - 1)             # a block that is not unique ends before the last separator
            by = np.lexsort((rank[after], rank[at]))
            at = at[by]
            order[open_] = at
            head, tail = rank[at], rank[np.minimum(at + width, n - 1)]
            new = np.empty(len(at), bool)
            new[0] = True
            new[1:] = (head[1:] != head[:-1]) | (tail[1:] != tail[:-1])
            first = np.flatnonzero(new)
            size = np.diff(np.append(first, len(at)))
            rank, group = rank.copy(), group.copy()
            which = np.cumsum(new) - 1
            rank[at], group[at] = open_[first][which], size[which]
            self.ranks.append(rank)
            self.sizes.append(group)
            width *= 2
        self.array = order
        self.bits = max(1, int(n - 1).bit_length())
        level, self.zeros, self.total = order, [], []
        for k in range(self.bits - 1, -1, -1):
            one = (level >> k) & 1
            zeros = np.zeros(n + 1, np.int32)
            np.cumsum(1 - one, out=zeros[1:])
            self.zeros.append(zeros)
            self.total.append(int(zeros[-1]))
            level = np.concatenate([level[one == 0], level[one == 1]])

    @staticmethod
    def _ranks(sorted_values: np.ndarray, order: np.ndarray, out: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        new = np.append(True, sorted_values[1:] != sorted_values[:-1])
        first = np.flatnonzero(new)
        which = np.cumsum(new) - 1
        size = np.diff(np.append(first, len(order)))
        group = np.empty(len(order), np.int64)
        out[order], group[order] = first[which], size[which]
        return out, group

    def below(self, lo: np.ndarray, hi: np.ndarray, x: np.ndarray) -> np.ndarray:
        """How many of array[lo:hi] are smaller than x (x at most the length)."""
        out, whole = np.zeros(len(lo), np.int64), hi - lo
        for k, (zeros, total) in enumerate(zip(self.zeros, self.total)):
            a, b = zeros[lo], zeros[hi]
            one = (x >> (self.bits - 1 - k)) & 1 == 1
            out += np.where(one, b - a, 0)
            lo, hi = np.where(one, total + lo - a, a), np.where(one, total + hi - b, b)
        return np.where(x >> self.bits > 0, whole, out)

    def nth(self, lo: np.ndarray, hi: np.ndarray, place: np.ndarray) -> np.ndarray:
        """The place-th smallest (from 0) of array[lo:hi]."""
        place, out = place.copy(), np.zeros(len(lo), np.int64)
        for k, (zeros, total) in enumerate(zip(self.zeros, self.total)):
            a, b = zeros[lo], zeros[hi]
            one = place >= b - a
            place -= np.where(one, b - a, 0)
            out |= np.where(one, 1 << (self.bits - 1 - k), 0)
            lo, hi = np.where(one, total + lo - a, a), np.where(one, total + hi - b, b)
        return out

    def forward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Length of the longest common extension to the right of places i < j."""
        i, j, n = i.copy(), j.copy(), len(self.array)
        start = i.copy()
        for k in range(len(self.ranks) - 1, -1, -1):
            # a longer block may match again: the highest one as long as it does
            while True:
                same = (j < n) & (self.ranks[k][np.minimum(i, n - 1)] == self.ranks[k][np.minimum(j, n - 1)])
                if not same.any():
                    break
                i, j = i + (same << k), j + (same << k)
                if k < len(self.ranks) - 1:
                    break
        return i - start

    def backward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Length of the longest common extension to the left of places i < j, themselves not included."""
        i, j = i.copy(), j.copy()
        start = i.copy()
        for k in range(len(self.ranks) - 1, -1, -1):
            while True:
                a, b = i - (1 << k), j - (1 << k)
                same = (a >= 0) & (self.ranks[k][np.maximum(a, 0)] == self.ranks[k][np.maximum(b, 0)])
                if not same.any():
                    break
                i, j = np.where(same, a, i), np.where(same, b, j)
                if k < len(self.ranks) - 1:
                    break
        return start - i


def candidates(index: Index, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, periods) that may be runs: w[place:place + b] occurs again one period on."""
    n, places, periods = len(index.array), [], []
    for k, (rank, size) in enumerate(zip(index.ranks, index.sizes)):
        b = 1 << k
        if TIMES * b > longest:
            break
        at = np.arange(0, n, b)
        at = at[size[at] > 1]
        lo, hi = rank[at], rank[at] + size[at]
        # the window's occurrences: the from-th to the to-th smallest place of the interval
        start, end = index.below(lo, hi, np.minimum(at + b, n)), index.below(lo, hi, np.minimum(at + 2 * b, n))
        found = np.flatnonzero(end > start)
        at, lo, hi, start, end = at[found], lo[found], hi[found], start[found], end[found]
        first = index.nth(lo, hi, start)
        last = index.nth(lo, hi, end - 1)
        few = end - start <= 2
        places += [at[few], at[few]]
        periods += [(first - at)[few], (last - at)[few]]
        many = np.flatnonzero(~few)
        if len(many):
            p, f, z = at[many], first[many], last[many]
            step = index.nth(lo[many], hi[many], start[many] + 1) - f
            q = (z + index.forward(z, z + step)) - (p + index.forward(p, p + step))
            good = (q >= f - p) & (q <= z - p) & ((q - (f - p)) % step == 0)
            places.append(p[good])
            periods.append(q[good])
    empty = np.zeros(0, np.int64)
    return np.concatenate([empty, *places]).astype(np.int64), np.concatenate([empty, *periods]).astype(np.int64)


def runs_of(texts: list[list]) -> list[np.ndarray]:
    """Per list of words its runs as rows (start, length, period), by start, then period."""
    lengths = np.array([len(t) for t in texts], np.int64)
    numbers: dict = {}
    number = numbers.setdefault
    flat: list[int] = []
    for i, words in enumerate(texts):
        flat += [number(w, len(numbers)) for w in words]
        flat.append(-1 - i)
    out = [np.zeros((0, 3), np.int64)] * len(texts)
    longest = int(lengths.max(initial=0))
    if longest < LEAST:
        return out
    index = Index(np.array(flat, np.int64))
    place, q = candidates(index, longest)
    key = np.unique(np.stack([place, q]), axis=1)
    place, q = key[0], key[1]
    start = place - index.backward(place, place + q)
    length = place + q + index.forward(place, place + q) - start
    good = length >= np.maximum(LEAST, TIMES * q)
    start, length, q = start[good], length[good], q[good]
    by = np.lexsort((q, length, start))
    start, length, q = start[by], length[by], q[by]
    if len(start):
        new = np.append(True, (start[1:] != start[:-1]) | (length[1:] != length[:-1]))       # the smallest period of a stretch
        start, length, q = start[new], length[new], q[new]
        first = np.append(0, np.cumsum(lengths + 1))
        text = np.searchsorted(first, start, side="right") - 1
        rows = np.stack([start - first[text], length, q], axis=1)
        rows = rows[np.lexsort((rows[:, 2], rows[:, 0], text))]
        ends = np.searchsorted(text, np.arange(len(texts) + 1))
        out = [rows[a:b] for a, b in zip(ends, ends[1:])]
    return out


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()       # bytes: the six blanks only


def planted(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """``words`` with a repeated tail in one document of ten, by the CRC-32 of its number."""
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


def collapsed(words: list[bytes], runs: np.ndarray) -> list[bytes]:
    """The words that no run holds after its first period."""
    if not len(runs):
        return words
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edge, runs[:, 0] + runs[:, 1], -1)
    return [words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0)]


def greatest(runs: np.ndarray) -> tuple | None:
    """The run of the greatest length / period, exactly; ties to the smallest start, then period."""
    best = None
    for start, length, q in runs.tolist():      # in that order, so only a greater one replaces
        if best is None or length * best[2] > best[1] * q:
            best = (start, length, q)
    return best


RUNS = "runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string"


def find_runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", plant: bool = False) -> DataFrame:
    """``docs`` with ``runs`` (every run's start, length, period) and ``collapsed`` (the words kept, joined by one
    space). ``plant`` repeats the tail of one text of ten first."""
    kept = [c for c in docs.columns if c not in ("runs", "collapsed")]
    schema = docs.select(*kept).schema
    ids, texts = kept.index(doc_id), kept.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
        for batch in batches:
            sizes = [len(t) for t in batch.column(texts).cast(pa.binary()).fill_null(b"").to_pylist()]
            for a, b in row_slices(sizes, SLICE_BYTES):
                part = batch.slice(a, b - a)
                words = [words_of(t.as_py()) for t in part.column(texts)]
                if plant:
                    words = [planted(w, d) for w, d in zip(words, part.column(ids).to_pylist())]
                found = runs_of(words)
                rows = np.concatenate(found) if found else np.zeros((0, 3), np.int64)
                offsets = np.cumsum([0] + [len(f) for f in found]).astype(np.int32)
                lists = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([pa.array(c) for c in rows.T.copy()], fields=list(kind.value_type)))
                left = pa.array([b" ".join(collapsed(w, f)) for w, f in zip(words, found)], pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns, lists, left], names=[*kept, "runs", "collapsed"])

    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    return docs.select(*kept).mapInArrow(run, f"{columns}, {RUNS}")


def op11_word_runs(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = find_runs(docs, plant=True)
    # length / period compared exactly: a fold that replaces only by a greater one
    best = F.aggregate("runs", F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>"), lambda best, r: F.when(
        best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"]), r).otherwise(best))
    line = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    every = F.concat(F.array_join(line, "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
        F.sha2(every.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))


#: Pairs of equal words of a text at most n / 4 apart, their islands, the smallest period of each stretch.
OP11_SQL = "WITH " + CRC_SQL + r""",
a AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws, """ + CRC_OF.format("doc_id") + r""" AS h
  FROM documents, crc),
b AS (SELECT doc_id, ws, len(ws) AS n, h, h // 10 AS g, CASE WHEN len(ws) > 0 THEN (h // 10) % len(ws) END AS s FROM a),
c AS (SELECT *, 1 + (n - s) // (3 + g % 8) AS p FROM b),
d AS (SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_concat(ws[1:s], list_transform(range(n - s), lambda i: ws[s + i % p + 1])) ELSE ws END AS ws FROM c),
w AS (SELECT doc_id, n, unnest(ws) AS word, unnest(range(n)) AS i FROM d),
m AS (SELECT x.doc_id, x.i, y.i - x.i AS q FROM w x JOIN w y ON x.doc_id = y.doc_id AND x.word = y.word AND y.i > x.i AND 4 * (y.i - x.i) <= x.n),
isl AS (SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM m),
st AS (SELECT doc_id, q, min(i) AS start, count(*) + q AS length FROM isl GROUP BY doc_id, q, island HAVING count(*) + q >= greatest(6, 4 * q)),
r AS (SELECT doc_id, start, length, min(q) AS period FROM st GROUP BY doc_id, start, length),
best AS (SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines FROM r GROUP BY doc_id),
top AS (SELECT doc_id, start, length, period FROM r WHERE NOT EXISTS (SELECT 1 FROM r z WHERE z.doc_id = r.doc_id
  AND (z.length * r.period > r.length * z.period OR z.length * r.period = r.length * z.period AND (z.start < r.start OR z.start = r.start AND z.period < r.period)))),
gone AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM r),
kept AS (SELECT w.doc_id, string_agg(word, ' ' ORDER BY w.i) AS text FROM w LEFT JOIN gone ON gone.doc_id = w.doc_id AND gone.i = w.i WHERE gone.i IS NULL GROUP BY w.doc_id)
SELECT d.doc_id, coalesce(n_runs, 0) AS n_runs, start, length, period, 1000 * length // period AS exponent_milli,
  sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept.text, '')) AS collapsed_sha256
FROM d LEFT JOIN best USING (doc_id) LEFT JOIN top USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
