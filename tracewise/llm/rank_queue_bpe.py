"""Operator 13: byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

A pre-token's bytes form a linked list of symbols. Every adjacent pair that has a
merge rank stands in the bucket of that rank by its left position; two levels of
bit words mark the ranks whose bucket is not empty, so find-first-set on two words gives
the next rank, and the bucket's heap its leftmost position. A merge links the list anew and
pushes the two new pairs; entries whose pair has changed meanwhile are stale and are skipped
when they come up. Every step costs a constant number of word operations and one heap step, so a
pre-token of n bytes takes about n log n however long it is, where a search of all pairs for each merge
takes the square. A pre-token that is a token itself is taken at once, as the library does.

Distinct pre-tokens are encoded once per worker (a memo of bounded size and bounded keys).
Memory per pre-token is about 100 bytes a byte; ids and texts go through in Arrow batches.

Defined results: null is empty (no id); special strings inside texts are ordinary
text; an empty table gives no rows; repeated rows are encoded each; ``encode`` keeps all columns (one
of the output's name is replaced), the query reads doc_id and text only; decoding an id that the
vocabulary does not hold raises KeyError; a null list of ids is empty.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import read, worker_cache

#: Pre-tokens kept in a worker's memo, the longest of them, and the length from which links are compact arrays.
MEMO_PIECES, MEMO_CHARS, LONG = 1_000_000, 64, 4096
#: Bits in a word of the bitmap: 256 words of 256 bits hold 65,536 ranks (more ranks: a longer top word).
WORD = 256
BIT = [1 << k for k in range(WORD * 8)]


def load_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a .tiktoken file: one line per token, its bytes in base64 and its rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


class RankQueue:
    """Positions in buckets by rank. ``low`` has one bit for each rank whose bucket is not empty, in words of
    WORD bits; ``top`` has one bit for each word of ``low`` that is not zero."""

    def __init__(self, ranks: int):
        self.buckets: dict[int, list[int]] = {}
        self.low, self.top = [0] * (ranks // WORD + 1), 0

    def push(self, rank: int, position: int) -> None:
        bucket = self.buckets.get(rank)
        if bucket is not None:
            heappush(bucket, position)
            return
        self.buckets[rank] = [position]
        word = rank // WORD
        if not self.low[word]:
            self.top |= BIT[word]
        self.low[word] |= BIT[rank % WORD]

    def pop(self) -> tuple[int, int]:
        """Smallest rank and its leftmost position; the queue must not be empty (``top`` not 0)."""
        top, low = self.top, self.low
        word = (top & -top).bit_length() - 1
        bits = low[word]
        bit = bits & -bits
        rank = word * WORD + bit.bit_length() - 1
        bucket = self.buckets[rank]
        if len(bucket) > 1:
            return rank, heappop(bucket)
        del self.buckets[rank]
        low[word] = bits = bits ^ bit
        if not bits:
            self.top = top & (top - 1)
        return rank, bucket[0]


class Ranks(dict):
    """Rank of every token by its bytes; those of single bytes and of pairs of bytes also in lists."""

    def __init__(self, ranks: dict[bytes, int]):
        super().__init__(ranks)
        self.one = [ranks.get(bytes([b]), -1) for b in range(256)]
        self.two = [-1] * 65536
        for token, rank in ranks.items():
            if len(token) == 2:
                self.two[token[0] << 8 | token[1]] = rank


def merge(piece: bytes, ranks: Ranks, queue: RankQueue) -> list[int]:
    """Ids of one pre-token; a merged symbol's id is the rank of its merge."""
    n, rank_of, push, pop = len(piece), ranks.get, queue.push, queue.pop
    right, left = range(1, n + 1), range(-1, n - 1)
    ids, two = map(ranks.one.__getitem__, piece), ranks.two
    pair = (two[a << 8 | b] for a, b in zip(piece, piece[1:] + b"\0"))
    right, left, ids, pair = [array("q", x) if n > LONG else list(x) for x in (right, left, ids, pair)]
    pair[n - 1] = -1
    for i, rank in enumerate(pair):
        if rank >= 0:
            push(rank, i)
    while queue.top:
        rank, i = pop()
        if pair[i] != rank:
            continue        # stale: the pair has changed or is gone
        ids[i] = rank
        gone = right[i]
        right[i] = end = right[gone]
        pair[gone] = pair[i] = -1
        if end < n:
            left[end] = i
            rank = rank_of(piece[i:right[end]])
            if rank is not None:
                pair[i] = rank
                push(rank, i)
        before = left[i]
        if before >= 0:
            rank = rank_of(piece[before:end])
            if rank is None:
                pair[before] = -1
            else:
                pair[before] = rank
                push(rank, before)
    out, i = [], 0
    while i < n:
        if ids[i] < 0:
            raise KeyError(piece[i:i + 1])
        out.append(ids[i])
        i = right[i]
    return out


#: The pattern under which a text may be cut at white space as ``Encoder.encode`` does (fixed: the public GPT-2 pattern).
CUT_AT_BLANKS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Encoder(dict):
    """Ids of texts (as little-endian 32-bit numbers) for one vocabulary and one pattern; as a
    dict the memo of strings already encoded.

    Under the pattern CUT_AT_BLANKS a pre-token holds a blank only as its first character or in a
    run of white space. So a text falls apart before every single space, around every
    single line feed, and before the last character of a longer run; the strings between hold
    whole pre-tokens and are looked up before they are matched. Other patterns are matched over the whole text.
    """

    def __init__(self, path: str, pattern: str):
        import regex

        super().__init__()
        self.ranks = Ranks(load_ranks(path))
        self.queue = RankQueue(max(self.ranks.values()) + 1)
        self.matches = regex.compile(pattern).finditer
        self.runs = regex.compile(r"\s{2,}").finditer if pattern == CUT_AT_BLANKS else None

    def remember(self, text: str, ids: bytes) -> bytes:
        if len(text) <= MEMO_CHARS:
            if len(self) >= MEMO_PIECES:
                self.clear()
            self[text] = ids
        return ids

    def encode_piece(self, piece: str) -> bytes:
        """Ids of one pre-token."""
        raw = piece.encode("utf-8", "surrogatepass")
        whole = self.ranks.get(raw)
        return array("I", [whole] if whole is not None else merge(raw, self.ranks, self.queue)).tobytes()

    def __missing__(self, text: str) -> bytes:
        """Ids of a string of whole pre-tokens. Only single ones are remembered; a full stop or comma after an
        ASCII letter is one of its own."""
        if len(text) > 1 and text[-1] in ",." and text[-2].isascii() and text[-2].isalpha():
            return self[text[:-1]] + self[text[-1]]
        pieces = [m[0] for m in self.matches(text)]
        if len(pieces) == 1:
            return self.remember(text, self.encode_piece(text))
        return b"".join([self.get(p) or self.remember(p, self.encode_piece(p)) for p in pieces])

    def encode(self, text: str) -> bytes:
        if self.runs is None or "\0" in text:
            return b"".join([self.get(p) or self.remember(p, self.encode_piece(p)) for p in (m[0] for m in self.matches(text))])
        out, done = [], 0
        for run in self.runs(text):
            start, end = run.span()
            cut = end if end == len(text) else end - 1
            out += (self.between(text[done:start]), self[text[start:cut]])
            done = cut
        out.append(self.between(text[done:]))
        return b"".join(out)

    def between(self, text: str) -> bytes:
        """Ids of a text without NUL and without runs of white space inside."""
        return b"".join(map(self.__getitem__, text.replace(" ", "\0 ").replace("\n", "\0\n\0").split("\0")))


def encoder(path: str, pattern: str):
    """Arrow function: text column to list of ids."""

    @F.arrow_udf("array<int>")
    def ids(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        import numpy as np

        cache = worker_cache("rank_queue_bpe:" + path)
        if "encoder" not in cache:
            cache["encoder"] = Encoder(path, pattern)
        encode = cache["encoder"].encode
        for batch in batches:
            found = [encode(t.as_py() or "") for t in batch]
            offsets = np.cumsum([0] + [len(f) // 4 for f in found]).astype(np.int32)
            yield pa.ListArray.from_arrays(offsets, np.frombuffer(b"".join(found), "<i4"))

    return ids


def rows_of(lists: pa.ListArray) -> Iterator:
    """The lists of an array as numpy slices (null: an empty one)."""
    import numpy as np

    values = np.asarray(lists.values.fill_null(-1) if lists.values.null_count else lists.values)
    bounds, valid = np.asarray(lists.offsets).tolist(), lists.is_valid().to_pylist()
    for a, b, ok in zip(bounds, bounds[1:], valid):
        yield values[a:b if ok else a]


def decoder(path: str):
    """Arrow function: list of ids to the bytes they stand for."""

    @F.arrow_udf("binary")
    def text(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        cache = worker_cache("rank_queue_bpe:" + path)
        if "tokens" not in cache:
            cache["tokens"] = {rank: token for token, rank in load_ranks(path).items()}
        tokens = cache["tokens"]
        for batch in batches:
            yield pa.array([b"".join(map(tokens.__getitem__, ids.tolist())) for ids in rows_of(batch)], pa.binary())

    return text


def digests(path: str, pattern: str):
    """Arrow function: text to (number of ids, SHA-256 of the ids as little-endian unsigned 32-bit numbers, SHA-256 of the
    bytes decoded from them). Encoding and decoding run in one worker, so no list of ids leaves it."""

    @F.arrow_udf("struct<n_tokens:bigint,ids_sha256:string,decoded_sha256:string>")
    def found(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        from hashlib import sha256

        import numpy as np

        cache = worker_cache("rank_queue_bpe:" + path)
        if "encoder" not in cache:
            cache["encoder"] = Encoder(path, pattern)
        encode = cache["encoder"].encode
        if "tokens" not in cache:
            cache["tokens"] = {rank: token for token, rank in cache["encoder"].ranks.items()}
        token = cache["tokens"].__getitem__
        for batch in batches:
            rows: list[tuple] = []
            for text in batch:
                ids = encode(text.as_py() or "")
                back = b"".join(map(token, np.frombuffer(ids, "<u4").tolist()))
                rows.append((len(ids) // 4, sha256(ids).hexdigest(), sha256(back).hexdigest()))
            n, ids_sha, back_sha = zip(*rows) if rows else ((), (), ())
            yield pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(back_sha, pa.string())],
                                             names=["n_tokens", "ids_sha256", "decoded_sha256"])

    return found


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", out: str = "ids") -> DataFrame:
    """``docs`` with the ids of every text (column ``out``)."""
    return docs.withColumn(out, encoder(path, pattern)(F.col(text)))


def decode(ids: str | Column, path: str) -> Column:
    """The bytes of a list of ids."""
    return decoder(path)(F.col(ids) if isinstance(ids, str) else ids)


def op13_byte_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    found = digests(path, public_tokenizers.PATTERN)(F.col("text"))
    return read(spark, sf_dir, "documents").select("doc_id", found.alias("found")).select("doc_id", "found.*")
