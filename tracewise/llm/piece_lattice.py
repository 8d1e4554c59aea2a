"""Operator 6: SentencePiece encoding and decoding by a relational lattice.

1. All documents are split into words that no piece of the vocabulary crosses, and counted: runs of
   blanks with the letters, the digit or the other characters after them, line feeds apart.
2. The lattice of distinct words is relational: substrings of bounded
   length are exploded and equi-joined to the piece table, edges are grouped by
   word, and a fold takes each word's edges to its ids. Words
   beyond MAX_CHARS go through the same join window by window, and an Arrow function folds each one's edges.
3. The ids of the MAX_WORDS most frequent words are broadcast (their number bounds the dictionary).
   Every other word goes through the lattice too: the distinct words of each text that the dictionary
   lacks are joined to their ids, grouped by a hash of the text and joined back to the documents,
   whose texts are compressed for that join.

Two folds: ``path`` is Viterbi, the path of the largest sum of scores, by a Spark higher-order ``aggregate``, right
for unigram vocabularies; ``merge`` joins the best-scored adjacent pair until none is left, for all
words of an Arrow batch in step, right for BPE vocabularies such as piece_bpe_32k.model, whose scores are merge ranks:
there the Viterbi path differs from what SentencePiece returns.

Decoding concatenates pieces, puts byte pieces together as UTF-8 (invalid bytes as
U+FFFD) and drops the blank that encoding adds in front.

Defined results: null and empty texts have no ids and decode to the empty text;
characters outside the vocabulary become byte pieces (the unknown id if there are none);
repeated rows are encoded each; an empty table gives no rows; extra columns are
carried, columns named like an output are replaced. U+2581 in a text decodes to a blank.
"""

from __future__ import annotations

import heapq
import re
from collections import Counter
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop, input_slices, read, stored, worker_cache

BLANK = "▁"
#: Dictionary words at most, characters at most of words in it and in the folds of whole words; words counted per worker before flushing;
#: characters per window of longer words; texts a task remembers and rows it holds of the words beyond the dictionary.
MAX_WORDS, MAX_CHARS, MEMO_WORDS, WINDOW, SEEN = 1 << 17, 48, 150_000, 256, 1 << 15
#: Rows of a batch that are Python objects at once; rounds, over a share of the texts each, in which the words beyond the
#: dictionary get their ids: a round's shuffle files go before the next begins.
SLICE, ROUNDS = 512, 4
#: Words from the finest cut on: letters, single digits and other characters apart; blanks and line feeds only.
WORDS = (re.compile(rf"\n|{BLANK}*(?:[^\W\d_²³¹]+|\d|(?:[^\w{BLANK}\n]|[_²³¹])+)|{BLANK}+"), re.compile(rf"\n|{BLANK}*[^{BLANK}\n]+|{BLANK}+"))


def words_of(text: str, words: re.Pattern = WORDS[-1]) -> list[str]:
    """Words of a text with its blanks escaped and the blank in front; [] if empty."""
    return words.findall(BLANK + text.replace(" ", BLANK)) if text else []


@contextmanager
def released(spark: SparkSession) -> Iterator[None]:
    """Within it Spark removes the shuffle files of every query when it ends; they would stay until the driver collects garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def vocabulary(path: str) -> dict:
    """Pieces with ids and scores, the byte pieces, and the finest of WORDS that no piece crosses."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    n = sp.vocab_size()
    special = [sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i) for i in range(n)]
    pieces = {sp.id_to_piece(i): (i, sp.get_score(i)) for i in range(n) if not special[i]}
    crossed = [[p for p in pieces if w.findall(p) != [p]] for w in WORDS]
    if all(crossed):
        raise ValueError(f"pieces cross words: {crossed[-1][:3]}")
    return {"pieces": pieces, "bytes": [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)] if any(map(sp.is_byte, range(n))) else None,
            "unknown": sp.unk_id(), "longest": max(map(len, pieces)), "words": WORDS[[bool(c) for c in crossed].index(False)]}


def piece_table(spark: SparkSession, vocab: dict) -> DataFrame:
    rows = [(p, i, s) for p, (i, s) in vocab["pieces"].items()]
    return spark.createDataFrame(rows, "piece string, id int, score double")


EDGES = "array<struct<cost:double,start:int,size:int,id:int,score:double,ends:bigint,inside:bigint>>"


def spans(words: DataFrame, pieces: DataFrame, longest: int) -> DataFrame:
    """(word, start, size, id, score) of distinct words of MAX_CHARS at most: each word's row, then those of its edges. Words are
    dealt once; the piece table has as many rows as the vocabulary file, so it is broadcast and the edges of a word stay together."""
    starts = words.select("word").repartition(input_slices(words.sparkSession), "word").select("word", F.expr("explode(sequence(0, length(word)))").alias("start"))
    # the span of size 0 joins the row put in front of the pieces: each word's rows begin with it
    parts = starts.select("word", "start", F.expr(f"explode(if(start = 0, array(0), sequence(1, least({longest}, length(word) - start + 1))))").alias("size")) \
        .select(F.expr("if(start = 0, word, null)").alias("word"), "start", "size", F.expr("substring(word, start, size)").alias("piece"))
    return parts.join(F.broadcast(with_none(pieces)), "piece").select("word", "start", "size", "id", "score")


def lattice(words: DataFrame, pieces: DataFrame, longest: int) -> DataFrame:
    """(word, edges) of distinct words of MAX_CHARS at most: edges are (cost, start, size, id, score, ends, inside), start
    counted from 1, cost the score negated, ends and inside the bits of the cuts at the edge's ends and within it."""
    return spans(words, pieces, longest).mapInArrow(gathered, f"word string, edges {EDGES}")


def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, edges) from the rows of one word behind the other, the first with the word: no sort, and no more than a batch is held."""
    rest = None
    for batch in batches:
        table = pa.Table.from_batches([batch] if rest is None else [rest, batch]).combine_chunks()
        heads = np.flatnonzero(table["word"].is_valid().to_numpy())
        if len(table) and (not len(heads) or heads[0]):
            raise ValueError("the edges of a word are not together")
        if len(heads) > 1:
            yield gathered_rows(table.slice(0, heads[-1]), heads[:-1])
        rest = table.slice(heads[-1]).to_batches()[0] if len(heads) else None
    if rest is not None:
        yield gathered_rows(pa.Table.from_batches([rest]), np.zeros(1, np.int64))


def gathered_rows(table: pa.Table, heads: np.ndarray) -> pa.RecordBatch:
    words = table["word"].take(pa.array(heads)).combine_chunks()
    keep = np.ones(len(table), bool)
    keep[heads] = False
    start, size = (table[c].to_numpy()[keep].astype(np.int64) for c in ("start", "size"))
    edges = table.filter(pa.array(keep))
    score = edges["score"].to_numpy()
    columns = [(-score, pa.float64()), (start, pa.int32()), (size, pa.int32()), (edges["id"].to_numpy(), pa.int32()), (score, pa.float64()),
               ((1 << (start - 1)) | (1 << (start + size - 1)), pa.int64()), (((1 << (size - 1)) - 1) << start, pa.int64())]
    names = ["cost", "start", "size", "id", "score", "ends", "inside"]
    offsets = np.append(heads - np.arange(len(heads)), keep.sum()).astype(np.int32)
    values = pa.StructArray.from_arrays([pa.array(v, t) for v, t in columns], names)
    return pa.RecordBatch.from_arrays([words, pa.ListArray.from_arrays(pa.array(offsets), values)], names=["word", "edges"])


def with_none(pieces: DataFrame) -> DataFrame:
    """The piece table and an empty piece without id."""
    return pieces.unionByName(pieces.sparkSession.createDataFrame([("", None, None)], pieces.schema))


#: Key of an edge in the maps below: start and size in one number.
KEY = "({start}) * 1024 + ({size})"


def ids_by_merges(vocab: dict):
    """Fold of (word, edges) batches: per word the set of cuts as bits, first one around every character; each turn removes,
    for all words at once, the cut inside the best-scored edge that covers two adjacent pieces (the leftmost of equals).
    The edges between neighbouring cuts are the pieces left; a character without any becomes bytes or the unknown id."""
    data, unknown = vocab["bytes"], vocab["unknown"]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        words, edges = batch.column(0), batch.column(1)
        length = pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
        at = np.repeat(np.arange(len(words)), pc.list_value_length(edges).to_numpy(zero_copy_only=False))
        cost, start, size, ids, ends, inside = (edges.flatten().field(c).to_numpy(zero_copy_only=False) for c in ("cost", "start", "size", "id", "ends", "inside"))
        cuts = (np.int64(1) << (length + 1)) - 1
        order = np.lexsort((size, start, cost, at))
        order = order[size[order] > 1]
        word, outer, inner = at[order], ends[order], inside[order]
        while len(word):        # pairs that can still be joined, of each word the best first
            now = cuts[word]
            live = np.flatnonzero(((now & outer) == outer) & ((now & inner) != 0))
            word, outer, inner = word[live], outer[live], inner[live]
            cut = cuts[word] & inner
            pairs = np.flatnonzero((cut & (cut - 1)) == 0)
            if not len(pairs):
                break
            first = pairs[np.append(True, word[pairs][1:] != word[pairs][:-1])]
            cuts[word[first]] &= ~inner[first]
        now = cuts[at]
        left = np.flatnonzero(((now & ends) == ends) & ((now & inside) == 0))
        base = np.cumsum(length) - length
        alone = np.ones(int(length.sum()), bool)        # characters that are no piece
        alone[(base[at] + start - 1)[size == 1]] = False
        alone = np.flatnonzero(alone)
        owner = np.searchsorted(base + length, alone, "right")
        place = alone - base[owner]
        none = [(w, i) for w, i in zip(owner.tolist(), place.tolist()) if int(cuts[w]) >> i & 3 == 3]
        more = [(w, i + 1, x) for w, i in none for x in (data_of(words[w].as_py()[i]))]
        rows = np.array(more, np.int64).reshape(-1, 3)
        of, begin, out = (np.concatenate((x, y)) for x, y in zip((at[left], start[left], ids[left]), rows.T))
        order = np.lexsort((begin, of))     # stable: the bytes of a character stay in their order
        offsets = np.concatenate(([0], np.cumsum(np.bincount(of, minlength=len(words))))).astype(np.int32)
        return pa.RecordBatch.from_arrays([words, pa.ListArray.from_arrays(pa.array(offsets), pa.array(out[order], pa.int32()))], names=["word", "ids"])

    def data_of(ch: str) -> list[int]:
        return [data[b] for b in ch.encode()] if data else [unknown]

    return lambda batches: (run(b) for b in batches if len(b))


def cuts_by_path() -> str:
    """Fold: Viterbi over end positions. The state holds, per position, the best sum
    and the start of the last piece; a character that is no piece costs the least score less 10."""
    options = f"""transform(sequence(1, least(longest, e)), l -> struct(
        element_at(state, e - l + 1).sum + coalesce(element_at(scores, {KEY.format(start='e - l + 1', size='l')}), if(l = 1, unknown, double('-Infinity'))) AS sum,
        -l AS size))"""
    state = f"""aggregate(sequence(1, length(word)), array(struct(double(0) AS sum, 0 AS size)),
        (state, e) -> concat(state, array(array_max({options}))))"""
    return f"""transform(array({state}), state -> aggregate(sequence(1, length(word)), array(length(word) + 1),
        (cuts, turn) -> if(cuts[0] = 1, cuts, concat(array(cuts[0] + element_at(state, cuts[0]).size), cuts))))[0]"""


def fold(edges: DataFrame, vocab: dict, kind: str = "merge") -> DataFrame:
    """(word, ids) from (word, edges)."""
    if kind == "merge":
        return edges.mapInArrow(ids_by_merges(vocab), "word string, ids array<int>")
    data = vocab["bytes"]
    if data and data != list(range(data[0], data[0] + 256)):
        raise ValueError("byte pieces are not in order")
    other = f"transform(sequence(1, octet_length(ch)), k -> {data[0]} + int(conv(substring(hex(ch), 2 * k - 1, 2), 16, 10)))" if data \
        else f"array({vocab['unknown']})"
    entry = lambda field: f"map_from_entries(transform(edges, e -> struct({KEY.format(start='e.start', size='e.size')}, e.{field})))"
    lowest = min(s for _, s in vocab["pieces"].values()) - 10
    at = KEY.format(start="cuts[i - 1]", size="cuts[i] - cuts[i - 1]")
    ids = f"""flatten(transform(sequence(1, size(cuts) - 1), i -> if(element_at(ids_of, {at}) IS NOT NULL, array(element_at(ids_of, {at})),
        transform(array(substring(word, cuts[i - 1], 1)), ch -> {other})[0])))"""
    # transform(array(x), name -> ...)[0] binds x once; a plain column would be put
    # into the lambdas and computed again for every element
    bound = f"""transform(array({entry('score')}), scores -> transform(array({cuts_by_path()}), cuts ->
        transform(array({entry('id')}), ids_of -> {ids})[0])[0])[0]"""
    return edges.select("word", F.expr(bound.replace("longest", str(vocab["longest"])).replace("unknown", f"double({lowest})")).alias("ids"))


def merged(word: str, edges: dict) -> list[tuple[int, int]]:
    """(start, size) of the pieces of a word from 0 on: as :func:`ids_by_merges`, with a heap."""
    size, before, after = [1] * len(word), list(range(-1, len(word) - 1)), list(range(1, len(word) + 1))
    heap: list[tuple[float, int, int]] = []

    def propose(i: int) -> None:
        j = after[i]
        if j < len(word) and (i, size[i] + size[j]) in edges:
            heapq.heappush(heap, (-edges[i, size[i] + size[j]][1], i, size[i] + size[j]))

    for i in range(len(word)):
        propose(i)
    while heap:
        _, i, both = heapq.heappop(heap)
        j = after[i] if size[i] else len(word)
        if j == len(word) or size[i] + size[j] != both:     # one of the two was merged before
            continue
        size[i], size[j], after[i] = both, 0, after[j]
        if after[j] < len(word):
            before[after[j]] = i
        propose(i)
        if before[i] >= 0:
            propose(before[i])
    return [(i, n) for i, n in enumerate(size) if n]


def best_path(word: str, edges: dict, longest: int, unknown: float) -> list[tuple[int, int]]:
    """(start, size) of the pieces of a word from 0 on: as :func:`cuts_by_path`."""
    best: list[tuple[float, int]] = [(0.0, 0)]
    for e in range(1, len(word) + 1):
        best.append(max((best[e - n][0] + (edges[e - n, n][1] if (e - n, n) in edges else unknown), -n)
                        for n in range(1, min(longest, e) + 1) if n == 1 or (e - n, n) in edges))
    cuts, at = [], len(word)
    while at:
        cuts.append((at + best[at][1], -best[at][1]))
        at += best[at][1]
    return cuts[::-1]


def fold_long(words: DataFrame, pieces: DataFrame, vocab: dict, kind: str = "merge") -> DataFrame:
    """(word, ids) of distinct words of any length: the lattice by windows of WINDOW start
    positions, so that no row holds a word's spans. The edges of one word meet in one group."""
    data, unknown, longest = vocab["bytes"], vocab["unknown"], vocab["longest"]
    lowest = min(s for _, s in vocab["pieces"].values()) - 10
    keyed = words.select("word", F.sha2("word", 256).alias("key"))
    windows = keyed.repartition(input_slices(words.sparkSession), "key") \
        .select("key", F.expr(f"explode(sequence(0, (length(word) - 1) div {WINDOW}))").alias("part"), "word") \
        .select("key", (F.col("part") * WINDOW).cast("int").alias("at"), F.expr(f"substring(word, part * {WINDOW} + 1, {WINDOW + longest - 1})").alias("window"))
    parts = windows.select("key", "at", "window", F.expr(f"explode(sequence(1, least({WINDOW}, length(window))))").alias("s")) \
        .select("key", "at", "window", "s", F.expr(f"explode(sequence(1, least({longest}, length(window) - s + 1)))").alias("size")) \
        .select("key", (F.col("at") + F.col("s") - 1).cast("int").alias("start"), "size", F.expr("substring(window, s, size)").alias("piece"))
    edges = parts.join(F.broadcast(pieces), "piece").select("key", F.lit(None).cast("string").alias("word"), "start", "size", "id", "score")
    none = [F.lit(None).cast(t).alias(c) for c, t in (("start", "int"), ("size", "int"), ("id", "int"), ("score", "double"))]

    def run(group: pa.Table) -> pa.Table:
        of = {(s, n): (i, x) for s, n, i, x in zip(*(group[c].to_pylist() for c in ("start", "size", "id", "score"))) if s is not None}
        word = next(w for w in group["word"].to_pylist() if w is not None)
        ids: list[int] = []
        for s, n in merged(word, of) if kind == "merge" else best_path(word, of, longest, lowest):
            ids += [of[s, n][0]] if (s, n) in of else [data[b] for b in word[s:s + n].encode()] if data else [unknown]
        return pa.table({"word": pa.array([word], pa.string()), "ids": pa.array([ids], pa.list_(pa.int32()))})

    return edges.unionByName(keyed.select("key", "word", *none)).groupBy("key").applyInArrow(run, "word string, ids array<int>")


def ids_of(words: DataFrame, vocab: dict, kind: str = "merge") -> DataFrame:
    """(word, ids) of stored distinct words by the lattice."""
    pieces = piece_table(words.sparkSession, vocab)
    short, merges = words.where(F.length("word") <= MAX_CHARS), ids_by_merges(vocab)
    if kind == "merge":     # gathered and folded in one pass, so that edges do not travel back and forth
        found = spans(short, pieces, vocab["longest"]).mapInArrow(lambda rows: merges(gathered(rows)), "word string, ids array<int>")
    else:
        found = fold(lattice(short, pieces, vocab["longest"]), vocab, kind)
    long = words.where(F.length("word") > MAX_CHARS)
    return found if long.isEmpty() else found.unionByName(fold_long(long, pieces, vocab, kind))


def count_words(docs: DataFrame, text: str = "text", words: re.Pattern = WORDS[-1]) -> DataFrame:
    """(word, n) over all documents, pre-counted per task in bounded tables."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        worker_cache("piece_lattice")       # releases what other operators left in the worker

        def flush():
            return pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.string()), pa.array(found.values(), pa.int64())], names=["word", "n"])

        for batch in batches:
            for value in batch.column(0):
                found.update(words_of(value.as_py() or "", words))
                if len(found) > MEMO_WORDS:
                    yield flush()
                    found.clear()
        yield flush()

    return docs.select(text).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def dictionary(docs: DataFrame, path: str, most: int = MAX_WORDS, kind: str = "merge") -> dict[str, bytes]:
    """ids (int32 bytes) of the ``most`` most frequent words of the documents, by the lattice."""
    spark, vocab, scratch = docs.sparkSession, vocabulary(path), []
    # words by steps of their count, from the most frequent step down as far as the bound
    # allows: a few hundred sums, no sort of all words
    with released(spark):
        counted = stored(count_words(docs, words=vocab["words"]).where(F.length("word").between(1, MAX_CHARS))
                         .withColumn("step", F.floor(F.log2("n") * 64)), "piece-counts", scratch)
    least, total = None, 0
    for r in sorted(counted.groupBy("step").count().collect(), key=lambda r: -r["step"]):
        total += r["count"]
        if total > most:
            break
        least = r["step"]
    words = counted.where(F.col("step") >= F.lit(least)).select("word") if least is not None else counted.limit(0).select("word")
    known = stored(ids_of(words, vocab, kind), "piece-known", scratch)
    found = {}
    for batch in known.toArrow().to_batches(SEEN):
        ids = batch.column(1)
        flat, ends = np.asarray(ids.values).astype("<i4"), np.asarray(ids.offsets).tolist()
        found.update((w, flat[i:j].tobytes()) for w, i, j in zip(batch.column(0).to_pylist(), ends, ends[1:]))
    drop(spark, scratch)
    return found


def other_words(docs: DataFrame, known, words: re.Pattern, text: str = "text") -> DataFrame:
    """(text_hash, word): distinct words of every text that the broadcast dictionary lacks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("piece_lattice")
        first, seen, keys, out = known.value, set(), [], []

        def flush():
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(out, pa.string())], names=["text_hash", "word"])

        for batch in batches:
            for key, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                value = value.as_py() or ""
                if (key, hash(value)) in seen:      # a copy of a text in this task
                    continue
                if len(seen) > SEEN:
                    seen.clear()
                seen.add((key, hash(value)))
                rest = [w for w in set(words_of(value, words)) if w not in first]
                keys += [key] * len(rest)
                out += rest
                if len(out) > SEEN:
                    yield flush()
                    keys, out = [], []
        yield flush()

    return docs.select(F.xxhash64(text), text).mapInArrow(run, "text_hash long, word string")


def slices(batch: tuple[pa.Array, ...]) -> Iterator[list[pa.Array]]:
    """The columns of a batch in slices of SLICE rows (one slice of none, if empty), so that few rows at a time are Python objects."""
    for at in range(0, max(1, len(batch[0])), SLICE):
        rows = pa.array(np.arange(at, min(at + SLICE, len(batch[0]))))
        yield [c.take(rows) for c in batch]     # copied, so that values and offsets of nested columns are the slice's own


def encode(docs: DataFrame, known: dict[str, bytes], path: str, text: str = "text", ids: str = "ids", kind: str = "merge") -> DataFrame:
    """``docs`` with the ids of every text as array<int>. ``known`` has MAX_WORDS entries at most;
    all other words get theirs by the lattice here. Texts of equal hash share their words, so a collision loses none."""
    spark, vocab, scratch = docs.sparkSession, vocabulary(path), []
    shared, pattern = spark.sparkContext.broadcast(known), vocab["words"]
    with released(spark):
        rest = stored(other_words(docs, shared, pattern, text), "piece-words", scratch)
        distinct: list[str] = []
        folded = stored(ids_of(stored(rest.select("word").distinct(), "piece-distinct", distinct), vocab, kind), "piece-ids", scratch)
        drop(spark, distinct)
        found = reduce(DataFrame.unionByName, [
            stored(rest.where(F.pmod("text_hash", F.lit(ROUNDS)) == k).join(folded, "word").groupBy("text_hash").agg(F.collect_set(F.struct("word", "ids")).alias("found"))
                   .select(F.col("text_hash").alias("_text_hash"), F.col("found.word").alias("_words"), F.col("found.ids").alias("_word_ids")), "piece-found")
            for k in range(ROUNDS)])
        drop(spark, scratch)

    # the join back deals texts out compressed, each for itself
    @F.arrow_udf("binary")
    def packed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        codec = pa.Codec("zstd", 1)
        for batch in batches:
            yield pa.concat_arrays([pa.array([None if v is None else len(v).to_bytes(4, "little") + codec.compress(v, asbytes=True)
                                              for v in (t.as_py() for t in cut)], pa.binary()) for cut, in slices((batch.cast(pa.binary()),))])

    def texts_of(batch: pa.Array) -> Iterator[str | None]:
        codec = pa.Codec("zstd")
        for data in (d.as_py() for d in batch):
            yield None if data is None else codec.decompress(data[4:], int.from_bytes(data[:4], "little"), asbytes=True).decode()

    @F.arrow_udf("string")
    def unpacked(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.concat_arrays([pa.array(texts_of(cut), pa.string()) for cut, in slices((batch,))])

    @F.arrow_udf("array<int>")
    def run(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        worker_cache("piece_lattice")
        first = shared.value
        for batch in batches:
            yield pa.concat_arrays([part(first, *cut) for cut in slices(batch)])

    def part(first: dict[str, bytes], texts: pa.Array, words: pa.Array, word_ids: pa.Array) -> pa.Array:
        rows, flat, per_word = [], words.values.to_pylist(), word_ids.values
        more, more_ids = np.asarray(words.offsets).tolist(), np.asarray(word_ids.offsets).tolist()
        data = np.asarray(per_word.values).astype("<i4")
        ends = np.asarray(per_word.offsets).tolist()
        for k, value in enumerate(texts_of(texts)):
            own = {w: data[ends[i]:ends[i + 1]].tobytes() for w, i in zip(flat[more[k]:more[k + 1]], range(more_ids[k], more_ids[k + 1]))}
            rows.append(b"".join([first[w] if w in first else own[w] for w in words_of(value or "", pattern)]))
        offsets = np.concatenate(([0], np.cumsum([len(r) // 4 for r in rows]))).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(rows), "<i4")))

    # copies of one text meet in one key: the documents' side is plain, so it is split as a skewed join
    joined = docs.withColumn("_hash_of_text", F.xxhash64(text)).withColumn(text, packed(F.col(text))).join(found, F.col("_hash_of_text") == F.col("_text_hash"), "left")
    return joined.withColumns({ids: run(F.col(text), F.col("_words"), F.col("_word_ids")), text: unpacked(F.col(text))}) \
        .drop("_hash_of_text", "_text_hash", "_words", "_word_ids")


def decode(docs: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """``docs`` with the text of every array of ids (null for null)."""

    @F.arrow_udf("string")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        cache, key = worker_cache("piece_lattice"), ("pieces", path)
        if key not in cache:
            import sentencepiece

            sp = sentencepiece.SentencePieceProcessor(model_file=path)
            cache[key] = pa.array([bytes([int(p[3:5], 16)]) if sp.is_byte(i) else b"" if sp.is_control(i) else " ⁇ ".encode() if sp.is_unknown(i)
                                   else p.replace(BLANK, " ").encode() for i, p in enumerate(map(sp.id_to_piece, range(sp.vocab_size())))], pa.binary())
        table = cache[key]
        for batch in batches:
            yield pa.concat_arrays([part(table, *cut) for cut in slices((batch,))])

    def part(table: pa.Array, rows: pa.Array) -> pa.Array:
        out = []
        for value in rows:
            if not value.is_valid:
                out.append(None)
                continue
            pieces = table.take(value.values)           # their bytes lie one behind the other
            found = pieces.buffers()[2].to_pybytes().decode("utf-8", "replace") if len(pieces) else ""
            out.append(found[1:] if found[:1] == " " else found)
        return pa.array(out, pa.string())

    return docs.withColumn(text, run(F.col(ids)))


def op6_sentencepiece(spark, sf_dir: str, path: str | None = None) -> DataFrame:
    """Per document: number of pieces, a hash of its ids, and whether decoding gives the text back."""
    import public_tokenizers

    path = path or public_tokenizers.path("piece_bpe_32k.model")
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    known = dictionary(docs, path)
    # the decoded text is held against the SHA-256 of the text, so that the text itself need not come back from the join
    found = decode(encode(docs.withColumn("text_sha", F.sha2(F.coalesce("text", F.lit("")), 256)), known, path), path)
    return found.select("doc_id", F.size("ids").cast("long").alias("n_pieces"), F.xxhash64("ids").alias("ids_hash"),
                        (F.sha2("decoded", 256) == F.col("text_sha")).alias("decoded_equal"))
