"""Rank-queue BPE against the tiktoken library, brute-force merging and round trips."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest

from tracewise.llm import rank_queue_bpe as bpe

from .test_llm import ODD, SCHEMA, prose, table

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    import tiktoken

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(PATH), special_tokens={})


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(PATH, public_tokenizers.PATTERN)


def ids(encoder, text):
    return np.frombuffer(encoder.encode(text), "<u4").tolist()


def slow(piece, ranks):
    """The lowest rank first, the leftmost of equal ones, by looking at all pairs each time."""
    parts = [bytes([b]) for b in piece]
    while True:
        found = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]
        if not found:
            return [ranks[p] for p in parts]
        i = min(found)[1]
        parts[i:i + 2] = [parts[i] + parts[i + 1]]


def test_queue_order():
    queue, rng = bpe.RankQueue(50_000), random.Random(2)
    held, out, want = [], [], []
    for _ in range(3000):
        if held and rng.random() < 0.45:
            held.sort()
            want.append(held.pop(0))
            out.append(queue.pop())
        else:
            held.append((rng.choice([rng.randrange(50_000), 7, 49_999]), rng.randrange(100)))
            queue.push(*held[-1])
    assert out == want
    while queue.top:
        out.append(queue.pop())
    assert out[len(want):] == sorted(held) and not queue.buckets and not any(queue.low)


def test_merge_equals_brute_force_on_any_vocabulary():
    """Also where a merge makes a pair of lower rank than its own."""
    rng = random.Random(3)
    for _ in range(150):
        tokens = {bytes([c]) for c in b"abc"} | {bytes(rng.choices(b"abc", k=rng.randint(2, 5))) for _ in range(25)}
        order = sorted(tokens, key=lambda t: (len(t) > 1, rng.random()))
        ranks = bpe.Ranks({t: i for i, t in enumerate(order)})
        queue = bpe.RankQueue(len(ranks))
        for n in (1, 2, 5, 30):
            piece = bytes(rng.choices(b"abc", k=n))
            assert bpe.merge(piece, ranks, queue) == slow(piece, ranks)
            assert not queue.top


def test_texts_equal_library(encoder, library):
    for text in [t or "" for t in ODD] + [prose(i, 60) for i in range(20)]:
        assert ids(encoder, text) == library.encode_ordinary(text)


def test_blanks_of_every_kind(encoder, library):
    """Runs of white space at every place, NUL, and another pattern."""
    rng = random.Random(6)
    for _ in range(3000):
        text = "".join(rng.choices(["a", "bc", "1", ",", "'s", " ", "  ", "\n", "\n\n", "\t", "\x85", "\u3000", "\x1c", "\0", "é"], k=rng.randint(1, 14)))
        assert ids(encoder, text) == library.encode_ordinary(text), repr(text)
    import tiktoken

    pattern = r"\p{L}+|\P{L}"
    other = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.load_ranks(PATH), special_tokens={})
    assert ids(bpe.Encoder(PATH, pattern), "one  two, three") == other.encode_ordinary("one  two, three")


def test_code_points_equal_library(encoder, library):
    points = [c for c in range(0x3100) if not 0xD800 <= c < 0xE000] + list(range(0x3100, 0x110000, 211))
    for c in points:
        if not 0xD800 <= c < 0xE000:
            text = f"a{chr(c)}b {chr(c)} 1{chr(c) * 2}"
            assert ids(encoder, text) == library.encode_ordinary(text), hex(c)


def test_very_long_pre_tokens(encoder, library):
    rng = random.Random(4)
    for alphabet in ("ab", "abcdefghijklmnopqrstuvwxyz", "=-"):
        text = "".join(rng.choices(alphabet, k=bpe.LONG * 5))
        got = ids(encoder, text)
        assert got == library.encode_ordinary(text)
    same = ids(encoder, "a" * 200_000)
    tokens = {r: t for t, r in encoder.ranks.items()}
    assert b"".join(tokens[i] for i in same) == b"a" * 200_000


def test_memo_is_bounded(monkeypatch, library):
    monkeypatch.setattr(bpe, "MEMO_PIECES", 50)
    small = bpe.Encoder(PATH, public_tokenizers.PATTERN)
    for i in range(10):
        text = prose(i, 100, 3000)
        assert ids(small, text) == library.encode_ordinary(text)
        assert len(small) <= 50


def test_query(spark, tmp_path, library):
    texts = ODD + [prose(i, 300) for i in range(30)] + ["same text"] * 3
    table(spark, texts).withColumnsRenamed({"lang": "ids", "n_chars": "n_tokens"}).repartition(4) \
        .write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in bpe.op13_byte_bpe(spark, str(tmp_path)).collect()}
    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        want = library.encode_ordinary(text or "")
        assert got[i]["n_tokens"] == len(want)
        assert got[i]["ids_sha256"] == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256((text or "").encode()).hexdigest()


def test_empty_table_and_kept_columns(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert bpe.encode(empty, PATH, public_tokenizers.PATTERN).count() == 0
    df = table(spark, ["one two", None])
    out = bpe.encode(df, PATH, public_tokenizers.PATTERN, out="lang")     # a clashing column is replaced
    assert out.columns == df.columns
    back = out.select(bpe.decode("lang", PATH).alias("text")).collect()
    assert [bytes(r["text"]) for r in back] == [b"one two", b""]
