"""Operator 9: token-ID files in a seekable zstandard format.

File format (all integers little-endian): one zstandard frame per document
holding its ids as unsigned 32-bit integers, in ascending doc_id order; then a
skippable frame (magic 0x184D2A50) with the doc_id (int64; flag byte 1 =
null) of every frame; then a trailing seek table as a skippable frame
(magic 0x184D2A5E): per frame compressed size, content size and the low 32
bits of the content's XXH64 as checksum; its last 9 bytes are frame count, flag byte and magic
0x8F92EAB1. A reader takes the tail, then only the frames that it wants, and
checks each against its checksum.

Documents are range-partitioned by doc_id, sorted within partitions, encoded
and written by the tasks under unique names in the shared folder; a file counts
only if its name is in the manifest that the tasks return, so a
lost or repeated task leaves no wrong data. Only file names and totals (one row
per file) pass between the stages.

Defined results: null text is empty (the end id alone); null doc_ids come
first; repeated rows each get a frame; an empty table gives no files and no
rows; extra columns are ignored.
"""

from __future__ import annotations

import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import scratch_path
from .common import input_slices, read, row_slices, stored, worker_cache

#: A file is closed beyond this many bytes; rows are encoded in slices of this much text.
FILE_BYTES, SLICE_BYTES, MEMO_PIECES = 32 << 20, 4 << 20, 600_000
LEVEL = 1
#: Fixed values of the seekable format.
DOC_MAGIC, SEEK_MAGIC, SEEK_END, CHECKSUM_FLAG = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1, 0x80

#: Pieces that the pre-tokenizer treats alone: a word with the one space or line
#: feed before it; white space up to such a piece; other white space with its word.
PIECES = re.compile(r"[ \n]?\S+|\s+?(?=[ \n]\S)|\s+\S*")
#: Characters on which this pattern's white space and the tokenizer's may differ.
ODD = ("\x1c", "\x1d", "\x1e", "\x1f", "\x85")
#: ASCII characters that end a word's token: all but letters, digits, blanks and the apostrophe of contractions.
MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


# -- file system ---------------------------------------------------------------

def filesystem(uri: str):
    """(pyarrow file system, path) of a folder named by URI or plain path."""
    from pyarrow import fs

    uri = re.sub(r"^file:/*", "file:///", uri)
    return fs.FileSystem.from_uri(uri if "://" in uri else "file://" + os.path.abspath(uri))


# -- format --------------------------------------------------------------------

class FrameWriter:
    """Writes documents as frames to one file; ``close`` appends the doc ids and the seek table."""

    def __init__(self, uri: str, level: int = LEVEL):
        import zstandard

        system, path = filesystem(uri)
        system.create_dir(os.path.dirname(path), recursive=True)
        self.out = system.open_output_stream(path, compression=None)   # frames are compressed here
        self.compress = zstandard.ZstdCompressor(level=level, write_content_size=True).compress
        self.seek, self.docs, self.size, self.count, self.values = [], [], 0, 0, 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        import xxhash

        frame = self.compress(ids)
        self.out.write(frame)
        self.seek.append(struct.pack("<III", len(frame), len(ids), xxhash.xxh64_intdigest(ids) & 0xFFFFFFFF))
        self.docs.append(struct.pack("<Bq", doc_id is None, doc_id or 0))
        self.size += len(frame)
        self.count += 1
        self.values += len(ids) // 4

    def close(self) -> None:
        for magic, body in ((DOC_MAGIC, b"".join(self.docs)),
                            (SEEK_MAGIC, b"".join(self.seek) + struct.pack("<IBI", self.count, CHECKSUM_FLAG, SEEK_END))):
            self.out.write(struct.pack("<II", magic, len(body)) + body)
        self.out.close()


class FrameReader:
    """Random access to the documents of one file."""

    def __init__(self, uri: str):
        import zstandard

        system, path = filesystem(uri)
        self.file = system.open_input_file(path)
        self.decompress = zstandard.ZstdDecompressor().decompress
        end = self.file.size()
        self.count, flag, magic = struct.unpack("<IBI", self.at(end - 9, 9))
        if magic != SEEK_END or flag != CHECKSUM_FLAG:
            raise ValueError(f"{uri}: no seek table")
        table = end - 9 - 12 * self.count
        self.seek = list(struct.iter_unpack("<III", self.at(table, 12 * self.count)))
        self.docs = [None if null else i for null, i in
                     struct.iter_unpack("<Bq", self.at(table - 8 - 9 * self.count, 9 * self.count))]
        self.starts = [0]
        for size, _, _ in self.seek:
            self.starts.append(self.starts[-1] + size)

    def at(self, offset: int, size: int) -> bytes:
        self.file.seek(offset)
        return self.file.read(size)

    def ids(self, k: int) -> bytes:
        """Ids of the k-th document; reads and decompresses its frame only."""
        import xxhash

        size, content, checksum = self.seek[k]
        data = self.decompress(self.at(self.starts[k], size), max_output_size=max(1, content)) if content else b""
        if len(data) != content or xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != checksum:
            raise ValueError(f"frame {k}: checksum differs")
        return data

    def close(self) -> None:
        self.file.close()


# -- encoding ------------------------------------------------------------------

def whole_texts(path: str) -> list[str]:
    """Strings of which a text that is to be encoded whole holds any: odd characters
    and added tokens (they end the white space before them); the empty string, that is all texts, unless
    the tokenizer is byte-level with its own pattern and has no normalizer."""
    import json

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pre = spec.get("pre_tokenizer") or {}
    if spec.get("normalizer") or spec.get("post_processor") or pre.get("type") != "ByteLevel" \
            or not pre["use_regex"] or pre["add_prefix_space"]:
        return [""]
    return [*ODD, *(t["content"] for t in spec.get("added_tokens", []))]


def byte_letters() -> dict[int, str]:
    """Fixed: the letter that byte-level vocabularies write for each byte. Printable
    bytes stand for themselves, the others for the letters from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


class Pieces(dict):
    """Memo of a tokenizer: piece to its ids as little-endian bytes. A key is a piece
    without the one space before it, a piece with a line feed before it, or
    FIRST and a piece that stands without either."""

    FIRST = "\x1c"

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"      # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.model, self.letters = self.tok.model, byte_letters()
        self.odd = whole_texts(path)

    def whole(self, text: str) -> bool:
        return any([odd in text for odd in self.odd])

    def encode(self, text: str) -> bytes:
        ids = self.tok.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def tokens(self, letters: str) -> bytes:
        """Ids of one word in byte letters."""
        ids = [t.id for t in self.model.tokenize(letters)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def __missing__(self, key: str) -> bytes:
        if len(self) > MEMO_PIECES:
            self.clear()
        if key.isascii() and key.isalpha():     # one plain word after its space, the most frequent case
            ids = self.tokens(self.letters[32] + key)
            self[key] = ids
            return ids
        text = key[1:] if key[0] == self.FIRST else key if key[0] == "\n" else " " + key
        word = key.rstrip(MARKS)
        if len(word) < len(key) and word[-1:].isalpha():        # a letter ends a token here
            ids = self[word] + self[self.FIRST + key[len(word):]]
        elif key[0] == "\n" and key[1:].isalpha():      # so does a line feed
            ids = self[self.FIRST + "\n"] + self[self.FIRST + key[1:]]
        elif (letters := text.removeprefix(" ")).isalpha() and max(letters) < "\u0250":     # one word: no splitting left to do
            ids = self.tokens(text.encode().decode("latin-1").translate(self.letters))
        else:
            ids = self.encode(text)
        self[key] = ids
        return ids

    def keys_of(self, text: str) -> list[str]:
        spaced = text.replace("\n", " \n")
        # one blank or line feed between words, no other white space
        if spaced and spaced[0] != " " and spaced[-1] not in " \n" and "  " not in spaced and "\n " not in spaced \
                and text.replace("\n", "").isprintable():
            keys = spaced.split(" ")
            if keys[0][0] != "\n":
                keys[0] = self.FIRST + keys[0]
            return keys
        return [p[1:] if p[0] == " " and len(p) > 1 and not p[1].isspace()
                else p if p[0] == "\n" and len(p) > 1 and not p[1].isspace() else self.FIRST + p
                for p in PIECES.findall(text)]


def encode_texts(texts: list[str], pieces: Pieces) -> list[bytes]:
    """Ids of each text as little-endian bytes; distinct pieces are encoded once per worker."""
    return [pieces.encode(t) if pieces.whole(t) else b"".join(map(pieces.__getitem__, pieces.keys_of(t)))
            for t in texts]


MANIFEST = "path string, part long, file long, first_doc long, documents long, ids long"
DOCUMENTS = "doc_id long, start long, n_tokens long, ids_crc32 long"


def write_token_files(docs: DataFrame, folder: str, path: str, end_id: int | None = None) -> DataFrame:
    """Write (doc_id, text) of ``docs`` as token-ID files below ``folder``;
    returns the manifest (path, part, file, first_doc, documents, ids), one row per file: the file-th of range
    partition ``part``, which orders files even where one doc_id fills several."""
    end = b"" if end_id is None else struct.pack("<I", end_id)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = worker_cache("token_file")
        if path not in cache:
            cache[path] = Pieces(path)
        pieces = cache[path]
        writer, part, files = None, TaskContext.get().partitionId(), 0

        def closed():
            writer.close()
            return pa.RecordBatch.from_pylist([{"path": name, "part": part, "file": files, "first_doc": first,
                                                "documents": writer.count, "ids": writer.values}], schema=schema)

        schema = pa.schema([("path", pa.string()), ("part", pa.int64()), ("file", pa.int64()), ("first_doc", pa.int64()), ("documents", pa.int64()), ("ids", pa.int64())])
        for batch in batches:
            doc_ids, col = batch.column(0).to_pylist(), batch.column(1)
            for a, b in row_slices(pc.fill_null(pc.binary_length(col), 0).to_pylist(), SLICE_BYTES):
                texts = pc.fill_null(col.slice(a, b - a), "").to_pylist()
                for doc_id, data in zip(doc_ids[a:b], encode_texts(texts, pieces)):
                    if writer is None:
                        name, first = f"{folder}/part-{uuid.uuid4().hex}.zst", doc_id
                        writer = FrameWriter(name)
                    writer.add(doc_id, data + end)
                    if writer.size >= FILE_BYTES:
                        yield closed()
                        writer, files = None, files + 1
        if writer is not None:
            yield closed()

    ordered = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return ordered.mapInArrow(write, MANIFEST)


def read_token_files(manifest: DataFrame) -> DataFrame:
    """Every document of a (stored) manifest's files: doc_id, start (ids of all
    documents before it, over all files by part and file), n_tokens, ids_crc32.
    One manifest row stands for up to FILE_BYTES of data."""
    before = W.orderBy("part", "file").rowsBetween(W.unboundedPreceding, -1)
    files = manifest.withColumn("before", F.coalesce(F.sum("ids").over(before), F.lit(0)))
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                reader, rows = FrameReader(uri), []
                for k, doc_id in enumerate(reader.docs):
                    data = reader.ids(k)
                    rows.append((doc_id, start, len(data) // 4, zlib.crc32(data)))
                    start += len(data) // 4
                reader.close()
                for a in range(0, len(rows), 10_000):
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows[a:a + 10_000])], schema=schema)

    # a stated number of partitions: rows are tiny, each stands for a file
    spread = files.select("path", "before").repartition(input_slices(manifest.sparkSession), "path")
    return spread.mapInArrow(documents, DOCUMENTS)


def read_documents(manifest: DataFrame, doc_ids: list[int]) -> dict[int, list[int]]:
    """Ids of a few documents: only files whose range holds them are opened,
    only their frames decompressed."""
    out: dict[int, list[int]] = {}
    files = manifest.orderBy("part", "file").select("path", "first_doc").toLocalIterator()
    files = [(r.path, r.first_doc) for r in files]
    for wanted in doc_ids:
        for k, (path, first) in enumerate(files):
            if (first is None or first <= wanted) and (k + 1 == len(files) or files[k + 1][1] is None or wanted <= files[k + 1][1]):
                reader = FrameReader(path)
                if wanted in reader.docs:
                    data = reader.ids(reader.docs.index(wanted))
                    out[wanted] = list(struct.unpack(f"<{len(data) // 4}I", data))
                reader.close()
    return out


def op9_token_files(spark, sf_dir: str, path: str | None = None) -> DataFrame:
    import public_tokenizers

    docs = read(spark, sf_dir, "documents")
    folder = scratch_path(spark, "token-files")
    manifest = stored(write_token_files(docs, folder, path or public_tokenizers.path("byte_bpe_50k.json"), end_id=2),
                      "token-manifest")
    return read_token_files(manifest)
