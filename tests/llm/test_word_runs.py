"""Word runs against trying every period, on texts full of repetitions."""

import hashlib
import random

import numpy as np
from tracewise.llm import word_runs

from .test_llm import ODD, SCHEMA, prose, table


def brute(words):
    """Every period up to a quarter of the text, every stretch of equal words that far apart."""
    n, found = len(words), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i < n - q:
            if words[i] != words[i + q]:
                i += 1
                continue
            start = i
            while i < n - q and words[i] == words[i + q]:
                i += 1
            if i + q - start >= max(6, 4 * q):
                found.setdefault((start, i + q - start), q)     # smaller periods come first
    return sorted((s, n, q) for (s, n), q in found.items())


def fibonacci(n):
    a, b = "a", "ab"
    while len(b) < n:
        a, b = b, b + a
    return list(b[:n])


def repetitive(rng):
    """Words of a small alphabet with repeated stretches, also nested ones."""
    words = []
    while len(words) < rng.randint(1, 120):
        block = rng.choices("abc", k=rng.randint(1, 7))
        if rng.random() < 0.3:
            block = block * rng.randint(1, 5) + rng.choices("abc", k=rng.randint(0, 2))
        words += block * rng.choice([1, 1, 2, 4, 5, 9])
    return words


def test_runs_equal_brute_force():
    rng = random.Random(1)
    for _ in range(250):
        texts = [repetitive(rng) for _ in range(rng.randint(1, 6))] + [[]]
        got = word_runs.runs_of(texts)
        assert [list(map(tuple, g.tolist())) for g in got] == [brute(t) for t in texts]


def test_special_words():
    texts = [["a"] * 1000, fibonacci(800), list("ab" * 300), list("aab" * 100 + "aab"), ["a"] * 5, ["a"] * 6, [], ["x"],
             list("abcde" * 4), list("abcde" * 4)[:-1], [str(i) for i in range(500)], (list("aaaab") * 40 + ["z"]) * 5]
    for together in (texts, *[[t] for t in texts]):
        got = word_runs.runs_of(together)
        assert [list(map(tuple, g.tolist())) for g in got] == [brute(t) for t in together]
    period = [str(i) for i in range(257)]
    assert word_runs.runs_of([["s"] + period * 6])[0].tolist() == [[1, 257 * 6, 257]]


def test_index_queries():
    rng = np.random.default_rng(2)
    for _ in range(40):
        n = int(rng.integers(2, 90))
        index = word_runs.Index(np.append(rng.integers(0, 3, n - 1), -1))
        values = index.array
        assert sorted(values.tolist()) == list(range(n))
        lo = rng.integers(0, n, 50)
        hi = np.array([rng.integers(a + 1, n + 1) for a in lo])
        x = rng.integers(0, n + 1, 50)
        assert index.below(lo, hi, x).tolist() == [int((values[a:b] < v).sum()) for a, b, v in zip(lo, hi, x)]
        nth = np.array([rng.integers(0, b - a) for a, b in zip(lo, hi)])
        assert index.nth(lo, hi, nth).tolist() == [sorted(values[a:b].tolist())[k] for a, b, k in zip(lo, hi, nth)]


def expected(doc_id, text):
    words = word_runs.planted(word_runs.words_of(text), doc_id)
    runs = brute(words)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2])) if runs else (None, None, None)
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None, hashlib.sha256(lines.encode()).hexdigest(),
            hashlib.sha256(b" ".join(w for i, w in enumerate(words) if i not in gone)).hexdigest())


OUT = ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


def test_query(spark, tmp_path, monkeypatch):
    rng = random.Random(7)
    texts = [t for t in ODD if t is None or len(t) < 10000] + [prose(i, 150) for i in range(40)] + [" ".join(repetitive(rng)) for _ in range(40)]
    texts += [texts[-1]] * 3
    df = table(spark, texts).withColumnsRenamed({"lang": "runs", "source": "start"}).repartition(3)
    df.unionByName(df.where("doc_id < 20")).write.parquet(f"{tmp_path}/documents.parquet")       # repeated rows
    got = sorted(tuple(r[c] for c in OUT) for r in word_runs.op11_word_runs(spark, str(tmp_path)).collect())
    want = [expected(i, t) for i, t in enumerate(texts)]
    assert got == sorted(want + want[:20])


def test_rows_without_number_and_empty_table(spark, tmp_path):
    df = spark.createDataFrame([(None, "a b " * 20, None, None, None)], SCHEMA)
    out = word_runs.find_runs(df, plant=True)
    assert out.columns == [*df.columns, "runs", "collapsed"]
    row = out.first()
    assert [tuple(r) for r in row["runs"]] == [(0, 40, 2)] and row["collapsed"] == "a b"
    df.limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert word_runs.op11_word_runs(spark, str(tmp_path)).count() == 0


def test_sql_agrees(spark):
    import duckdb

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = con.sql(f"SELECT {', '.join(OUT)} FROM ({word_runs.OP11_SQL})").fetchall()
    got = word_runs.op11_word_runs(spark, sf).select(*OUT).collect()
    assert sorted(map(tuple, got)) == sorted(want)
