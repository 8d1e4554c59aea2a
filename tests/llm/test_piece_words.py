"""Every word of op6 goes through the lattice: no library call encodes one, whatever the dictionary holds."""

import random
import time
from pathlib import Path

import pytest
import public_tokenizers
import sentencepiece
import pyarrow as pa
from pyspark.sql import functions as F

from tracewise.llm import piece_lattice


def test_words_beyond_the_dictionary_use_the_lattice(spark):
    path = public_tokenizers.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    rng = random.Random(3)
    texts = [None, "", "the the house 1234, x².", "the the house 1234, x².", "abc" * 400 + "é漢" * 50 + " " + "-" * 70 + "\n" + "ing" * 17,
             *[" ".join("".join(rng.choices("abeinrst漢,.7", k=rng.randint(1, 60))) for _ in range(6)) for _ in range(30)]]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    vocab = piece_lattice.vocabulary(path)
    asked = {w for t in texts for w in piece_lattice.words_of(t or "", vocab["words"])}
    folded = []

    def ids_of(words, *more):
        folded.extend(r["word"] for r in words.collect())
        return original(words, *more)

    original, piece_lattice.ids_of = piece_lattice.ids_of, ids_of
    try:
        rows = piece_lattice.encode(docs, piece_lattice.dictionary(docs, path, most=5), path).collect()
    finally:
        piece_lattice.ids_of = original
    assert sorted(folded) == sorted(asked)      # each once
    assert not hasattr(piece_lattice, "Encoder")
    assert {r["doc_id"]: list(r["ids"]) for r in rows} == {i: sp.encode(t or "") for i, t in enumerate(texts)}


def test_long_words_fold_as_short_ones(spark):
    path = public_tokenizers.path("piece_bpe_32k.model")
    vocab, rng = piece_lattice.vocabulary(path), random.Random(4)
    pieces = piece_lattice.piece_table(spark, vocab)
    words = spark.createDataFrame([("".join(rng.choices("▁aehinorst漢", k=rng.randint(1, 24))),) for _ in range(60)], "word string").distinct()
    for kind in ("merge", "path"):
        short = piece_lattice.fold(piece_lattice.lattice(words, pieces, vocab["longest"]), vocab, kind)
        long = piece_lattice.fold_long(words, pieces, vocab, kind).select("word", F.col("ids").alias("long_ids"))
        assert short.join(long, "word").where("ids <> long_ids").count() == 0 and long.count() == words.count()


def test_edges_are_gathered_without_a_sort(spark):
    """Each word's edges come together from rows that lie behind each other, also across batches."""
    rows = [("ab", 0, 0, None, None), (None, 1, 1, 5, -1.0), (None, 1, 2, 7, -0.5), (None, 2, 1, 6, -2.0), ("x", 0, 0, None, None), ("cd", 0, 0, None, None), (None, 1, 2, 9, -3.0)]
    schema = pa.schema([("word", pa.string()), ("start", pa.int32()), ("size", pa.int32()), ("id", pa.int32()), ("score", pa.float64())])
    batch = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
    want = [("ab", [(1, 1, 5), (1, 2, 7), (2, 1, 6)]), ("x", []), ("cd", [(1, 2, 9)])]
    for n in (1, 2, 3, 7):
        got = [(r["word"], [(e["start"], e["size"], e["id"]) for e in r["edges"]])
               for b in piece_lattice.gathered(batch.slice(at, n) for at in range(0, 7, n)) for r in b.to_pylist()]
        assert got == want
    edges = [e for b in piece_lattice.gathered([batch]) for e in b.to_pylist()[0]["edges"]][:3]
    assert [(e["cost"], e["ends"], e["inside"]) for e in edges] == [(1.0, 0b11, 0), (0.5, 0b101, 0b10), (2.0, 0b110, 0)]
    with pytest.raises(ValueError):
        list(piece_lattice.gathered([batch.slice(1, 2)]))
    path = public_tokenizers.path("piece_bpe_32k.model")
    vocab = piece_lattice.vocabulary(path)
    words = spark.createDataFrame([("the",)], "word string")
    plan = piece_lattice.lattice(words, piece_lattice.piece_table(spark, vocab), vocab["longest"])._jdf.queryExecution().toString()
    assert "Aggregate" not in plan and "Sort " not in plan


def test_batches_are_taken_in_slices(spark, monkeypatch):
    path = public_tokenizers.path("piece_bpe_32k.model")
    texts = [None, "", "the house", "of an unheardofword 12", None, "the unheardofword", "x" * 60]
    batch = (pa.array(texts, pa.string()), pa.array([None, [], ["a"], ["b", "c"], None, ["d"], []], pa.list_(pa.string())))
    monkeypatch.setattr(piece_lattice, "SLICE", 3)
    cuts = list(piece_lattice.slices(batch))
    assert [len(c[0]) for c in cuts] == [3, 3, 1] and cuts[1][1].values.to_pylist() == ["b", "c", "d"] and cuts[1][1].offsets[0].as_py() == 0
    assert [len(c[0]) for c in piece_lattice.slices((batch[0][:0],))] == [0]


def test_texts_are_dealt_out_compressed_and_shuffle_files_go(spark, tmp_path):
    """The join back shuffles no plain text, and the steps before it leave no shuffle files behind."""
    path = public_tokenizers.path("piece_bpe_32k.model")
    rng = random.Random(5)
    texts = [None, ""] + [" ".join("".join(rng.choices("abeinrst", k=5)) for _ in range(400)) for _ in range(40)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    local = Path(spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()[0]).parent
    held = lambda: {f for f in local.rglob("shuffle_*.data")}
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    known = piece_lattice.dictionary(docs, path, most=5)
    conf, before = spark.conf.get(name), held()
    found = piece_lattice.encode(docs, known, path)
    until = time.time() + 15        # Spark removes them in the background
    while held() - before and time.time() < until:
        time.sleep(0.2)
    assert not held() - before and spark.conf.get(name) == conf
    join = next(line for line in found._jdf.queryExecution().optimizedPlan().toString().splitlines() if "packed(" in line)
    assert "packed(text" in join and {r["doc_id"]: r["text"] for r in found.collect()} == dict(enumerate(texts))
    assert found.columns == ["doc_id", "text", "ids"] and dict(found.dtypes)["text"] == "string"


def test_merges_of_a_batch_are_those_of_each_word(spark):
    path = public_tokenizers.path("piece_bpe_32k.model")
    sp, vocab, rng = sentencepiece.SentencePieceProcessor(model_file=path), piece_lattice.vocabulary(path), random.Random(9)
    words = sorted({w for _ in range(300) for w in piece_lattice.words_of("".join(rng.choices(["th", "e", "in", "g", "漢", "🙂", "é", "x", "\x01", "7"], k=rng.randint(1, 20))), vocab["words"])
                    if len(w) <= piece_lattice.MAX_CHARS and w[0] == piece_lattice.BLANK})
    edges = piece_lattice.lattice(spark.createDataFrame([(w,) for w in words], "word string"), piece_lattice.piece_table(spark, vocab), vocab["longest"])
    batches = edges.toArrow().to_batches()
    got = {r["word"]: r["ids"] for b in piece_lattice.ids_by_merges(vocab)(iter(batches)) for r in b.to_pylist()}
    assert got == {w: sp.encode(w[1:]) for w in words}
