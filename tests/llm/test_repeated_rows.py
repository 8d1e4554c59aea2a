"""Repeated numbers and rows: token files of one doc_id over several files, repeated query vectors."""

import numpy as np
import pytest

from tracewise.llm import neighbours, token_file

from .test_llm import prose


@pytest.mark.parametrize("number", [5, None])
def test_starts_where_one_number_fills_several_files(spark, tmp_path, monkeypatch, number):
    monkeypatch.setattr(token_file, "FILE_BYTES", 400)
    monkeypatch.setattr(token_file, "SLICE_BYTES", 300)
    texts = [prose(i, 40) for i in range(60)]
    df = spark.createDataFrame([(number if 10 <= i < 50 else i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = [r for _ in range(2) for r in [token_file.op9_token_files(spark, str(tmp_path)).collect()]]
    first, again = (sorted((r["start"], r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in g) for g in got)
    assert first == again and len(first) == 60
    starts = [r[0] for r in first]
    assert starts == [0, *np.cumsum([r[2] for r in first])[:-1].tolist()]
    ids = [(r[1] is not None, r[1] or 0) for r in first]
    assert ids == sorted(ids)                       # ascending doc_id, null first


def test_repeated_query_rows_are_one_query(spark, tmp_path):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(120)]
    df = spark.createDataFrame(rows + [rows[20]] * 2, "vec_id long, embedding array<double>")
    index, shards = neighbours.build_index(spark.createDataFrame(rows, df.schema))
    got = neighbours.search(index, shards, df.where("vec_id % 20 = 0")).collect()
    mine = sorted((r["rank"], r["vec_id"]) for r in got if r["query_id"] == 20)
    assert [m[0] for m in mine] == list(range(1, 21)) and len({m[1] for m in mine}) == 20
    want = sorted(((-float(np.dot(rows[20][1], v)), i) for i, v in rows if i != 20))[:20]
    assert len({m[1] for m in mine} & {i for _, i in want}) >= 18


def test_marks_behind_words_are_encoded_apart():
    """Words with marks or a line feed at them give the library's ids without a call of its own per word."""
    import public_tokenizers

    pieces = token_file.Pieces(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["a word### and,%%% it's\nLine (x)... ÄÖ!! 漢字。 foo'!\n\nbar_ baz__9 x²; don't''s!? --- ' '", "\nhello\n", "one<|endoftext|>!", "zeb\x1c ra&"]
    whole, encode = [pieces.encode(t) for t in texts], pieces.encode
    asked = []
    pieces.encode = lambda text: asked.append(text) or encode(text)
    assert token_file.encode_texts(texts, pieces) == whole
    assert " word###" not in asked and "\nLine" not in asked and texts[2] in asked and texts[3] in asked
    assert isinstance(pieces.odd, list)


def test_plain_words_go_to_the_model_as_they_are():
    """A word of ASCII letters is neither searched for marks nor turned into byte letters; other texts are cut as before."""
    import public_tokenizers

    pieces = token_file.Pieces(public_tokenizers.path("byte_bpe_50k.json"))
    asked, tokens = [], pieces.tokens
    pieces.tokens = lambda letters: asked.append(letters) or tokens(letters)
    texts = ["The plain words, here", "two  blanks", " front", "end ", "line\n feed", "feed\n", "\n\n", "\tx　y", "größer\nThe", "", " "]
    assert token_file.encode_texts(texts, pieces) == [pieces.encode(t) for t in texts]
    assert "Ġplain" in asked and "Ġwords" in asked
