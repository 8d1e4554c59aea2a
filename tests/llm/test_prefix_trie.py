"""Conversation trie and tree contraction against direct counting."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from tracewise.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string"
OUT = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def brute(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(v)] for c, v in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = own.get(c - c % 5, [])[:h] + turns[h:]
    members = {}
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    kids = {}
    for path in members:
        if path:
            kids.setdefault(path[:-1], []).append(path)
    out = {}
    for path in sorted(members, key=len, reverse=True):
        size = len(path[-1][1].encode()) if path else 0
        leaves, saved = (0 if path in kids else 1), (len(members[path]) - 1) * size
        for k in kids.get(path, []):
            leaves, saved = leaves + out[k][5], saved + out[k][6]
        ends = ",".join(map(str, sorted(c for c in members[path] if len(built[c]) == len(path))))
        out[path] = (min(members[path]), len(path), min(members[path[:-1]]) if path else None, len(members[path]),
                     len(kids.get(path, [])), leaves, saved, hashlib.sha256(ends.encode()).hexdigest())
    return sorted(out.values(), key=str)


def run(spark, tmp_path, rows, schema=SCHEMA):
    spark.createDataFrame(rows, schema).repartition(5).write.parquet(f"{tmp_path}/conversations.parquet")
    got = prefix_trie.op12_prefix_trie(spark, str(tmp_path))
    return sorted((tuple(r[c] for c in OUT) for r in got.collect()), key=str)


def test_trie_equals_direct_counting(spark, tmp_path):
    rng = random.Random(5)
    rows = []
    for c in range(150):
        if c % 17 == 3:
            continue        # some groups have no first conversation
        for t in range(rng.choice([1, 2, 3, 5, 9, 14])):
            same = c % 3 == 0
            rows.append((c, t + (0 if rng.random() < 0.9 else 100), ["user", "assistant", None][t % 3 if t < 11 else 2],
                         "common" if same else rng.choice(["a", "b", "", None, "é漢", "long " * 50])))
    rows += [(200, None, "user", "first"), (200, 0, "user", "second"), (None, 0, "user", "no conversation"), (200, 0, "user", "second")]
    rows += [(301, t, "user", f"turn {t}") for t in range(300)]      # one long unary chain
    assert run(spark, tmp_path, rows) == brute(rows)


def test_empty_table(spark, tmp_path):
    assert run(spark, tmp_path, []) == []


def test_only_turnless_conversations(spark, tmp_path):
    """Without its group's first conversation, a short conversation loses its turns and ends at the root."""
    c = next(c for c in range(1, 400) if c % 5 and zlib.crc32(str(c).encode()) % 9 > 3)
    rows = [(c, 0, "user", "gone"), (c, 1, "user", "gone too")]
    assert run(spark, tmp_path, rows) == brute(rows) == [(c, 0, None, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())]


def test_extra_columns_with_clashing_names(spark, tmp_path):
    rows = [(c, t, "user", f"t{t % 2}", c * 10 + t) for c in range(12) for t in range(4)]
    schema = SCHEMA + ", depth long"
    assert run(spark, tmp_path, rows, schema) == brute([r[:4] for r in rows])


@pytest.mark.parametrize("shape", ["chain", "star", "comb", "random"])
def test_contraction_of_single_shapes(spark, shape):
    """Subtree sums of any forest; a chain of 700 needs about log2 rounds."""
    n, rng = 700, random.Random(1)
    parent = {"chain": lambda i: i - 1, "star": lambda i: 0, "comb": lambda i: i - 1 if i % 2 else max(0, i - 2),
              "random": lambda i: rng.randrange(max(0, i - 4), i)}[shape]
    up = [None] + [parent(i) for i in range(1, n)]
    depth = [0]
    for i in range(1, n):
        depth.append(depth[up[i]] + 1)
    total = [i % 7 for i in range(n)]
    for i in range(n - 1, 0, -1):
        total[up[i]] += total[i]
    kids = [up.count(i) for i in range(n)]
    rows = [(i, depth[i], up[i], depth[up[i]] if i else None, kids[i], i % 7) for i in range(n)]
    scratch = []
    df = spark.createDataFrame(rows, "c long, d long, pc long, pd long, n long, v long")
    got = prefix_trie.subtree_totals(df, ["v"], scratch)
    assert sorted((r["c"], r["v"]) for r in got.collect()) == list(enumerate(total))
    assert sum("trie-active" in p for p in scratch) <= 16


def test_sql_agrees(spark):
    import duckdb

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{sf}/conversations.parquet'")
    want = con.sql(f"SELECT {', '.join(OUT)} FROM ({prefix_trie.OP12_SQL})").fetchall()
    got = prefix_trie.op12_prefix_trie(spark, sf).select(*OUT).collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
