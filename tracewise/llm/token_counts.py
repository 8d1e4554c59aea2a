"""Operator 4: token counts.

An Arrow function returns only lengths. Rows are taken in slices of about
``BATCH_BYTES`` of text, texts beyond that are split at white space, and each
slice is split at safe boundaries into words, of which every distinct one is
encoded once per worker (a bounded memo of lengths), in batches balanced by bytes.

Safe boundaries: the tokenizer's pre-tokenizer drops white space, its
normalizer works within runs of other characters, and its added
tokens hold no white space, so white space separates tokens for certain. The code
checks these properties in the tokenizer file and encodes texts whole if
they do not hold.

Defined results: null counts as empty (0 bytes, 0 tokens); special strings in
a text are handled as the library's default; repeated rows count each; an
empty table gives no rows; extra columns are ignored by the query.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import read, row_slices, worker_cache

#: Bytes of text per slice and per call of the tokenizer; words kept in the memo.
BATCH_BYTES, CALL_BYTES, MEMO_WORDS = 4 << 20, 1 << 18, 600_000
#: Characters that str.split() takes for white space and the tokenizer does not.
ODD = re.compile("[\x1c-\x1f]")
BLANK = re.compile(r"[ \t\n\r\x0b\x0c]+")


def splits_at_space(spec: dict) -> bool:
    """Whether white space always ends a token under this tokenizer file."""
    def kinds(node):
        if not node:
            return []
        return [x for sub in node.get("normalizers", node.get("pretokenizers", [node])) for x in
                (kinds(sub) if "normalizers" in sub or "pretokenizers" in sub else [sub])]

    normal = all(n["type"] in ("NFC", "Lowercase") or (n["type"] == "Replace" and n.get("pattern") == {"Regex": "\\s+"}
                 and n.get("content") == " ") for n in kinds(spec.get("normalizer")))
    pre = kinds(spec.get("pre_tokenizer"))
    dropped = bool(pre) and pre[0]["type"] == "Split" and pre[0].get("invert") and pre[0]["behavior"] == "Removed" \
        and "[^\\s" in pre[0]["pattern"].get("Regex", "") and not re.search(r"(?<!\^)\\s", pre[0]["pattern"]["Regex"])
    rest = all(x["type"] == "ByteLevel" and not x["use_regex"] and not x["add_prefix_space"] for x in pre[1:])
    added = all(not re.search(r"\s", t["content"]) and not (t["lstrip"] or t["rstrip"] or t["single_word"])
                for t in spec.get("added_tokens", []))
    return bool(normal and dropped and rest and added and not spec.get("post_processor"))


def load(path: str, library: str = "json"):
    """(lengths of a list of texts, whether white space is safe) for a vocabulary file."""
    if path.endswith(".model"):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        return (lambda xs: [len(x) for x in sp.encode(xs, num_threads=1)]), False
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"      # Spark's tasks are the parallelism
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    encode = getattr(tok, "encode_batch_fast", tok.encode_batch)
    with open(path, encoding="utf-8") as f:
        safe = splits_at_space(json.load(f))
    return (lambda xs: [len(e) for e in encode(xs, add_special_tokens=False)]), safe


def encode_lengths(lengths, words: list[str], memo: dict) -> None:
    """Put the lengths of ``words`` into ``memo``. A letter before a last comma or
    full stop ends a token, so such words share their stem's length."""
    tails, todo = [], {}
    for w in words:
        if len(w) > 1 and w[-1] in ".," and w[-2].lower()[-1].isalpha():
            tails.append(w)
            for part in (w[:-1], w[-1]):
                if part not in memo:
                    todo[part] = None
        else:
            todo[w] = None
    todo = list(todo)
    for a, b in row_slices([len(w) for w in todo], CALL_BYTES):
        memo.update(zip(todo[a:b], lengths(todo[a:b])))
    for w in tails:
        memo[w] = memo[w[:-1]] + memo[w[-1]]


def parts(text: str, limit: int) -> Iterator[str]:
    """``text`` in parts of about ``limit`` characters, cut only after a blank
    (a longer run without blanks stays whole)."""
    start = 0
    while len(text) - start > limit:
        cut = max(text.rfind(" ", start, start + limit), text.rfind("\n", start, start + limit))
        if cut < start:
            m = BLANK.search(text, start + limit)
            if not m:
                break
            cut = m.start()
        yield text[start:cut + 1]
        start = cut + 1
    yield text[start:]


def text_lengths(texts: list[str], sizes: list[int], lengths, safe: bool, memo: dict) -> Iterator[int]:
    for a, b in row_slices(sizes, BATCH_BYTES):
        if not safe:
            yield from lengths(texts[a:b])
            continue
        totals = [0] * (b - a)
        for k in range(a, b):
            for part in parts(texts[k], BATCH_BYTES) if sizes[k] > BATCH_BYTES else (texts[k],):
                words = BLANK.split(part) if ODD.search(part) else part.split()
                new = set(words).difference(memo)
                if new:
                    encode_lengths(lengths, list(new), memo)
                totals[k - a] += sum(map(memo.__getitem__, words))
                if len(memo) > MEMO_WORDS:
                    memo.clear()
        yield from totals


def counter(path: str):
    """Arrow function: text column to number of tokens."""

    @F.arrow_udf("long")
    def n_tokens(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        cache = worker_cache("token_counts:" + path)
        if "load" not in cache:
            cache["load"], cache["memo"] = load(path), {"": 0}
        lengths, safe = cache["load"]
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch), 0).to_pylist()
            texts = pc.fill_null(batch, "").to_pylist()
            cache["memo"].setdefault("", 0)
            yield pa.array(text_lengths(texts, sizes, lengths, safe, cache["memo"]), pa.int64())

    return n_tokens


def count_tokens(docs: DataFrame, path: str, limit: int = 2048, text: str = "text") -> DataFrame:
    """``docs`` with n_bytes, n_tokens and over_limit (columns of these names are replaced)."""
    return (docs.withColumn("n_bytes", F.coalesce(F.octet_length(text), F.lit(0)).cast("long"))
            .withColumn("n_tokens", counter(path)(F.col(text)))
            .withColumn("over_limit", F.col("n_tokens") > limit))


def op4_token_counts(spark, sf_dir: str, path: str | None = None) -> DataFrame:
    import public_tokenizers

    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return count_tokens(docs, path or public_tokenizers.path("word_bpe_49k.json")).drop("text")
