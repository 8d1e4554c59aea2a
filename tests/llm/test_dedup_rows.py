"""Near-duplicate groups of buckets with many components, and what the pipeline keeps row by row."""

import random

from pyspark.sql import functions as F

from tracewise.llm import near_dedup

from .test_llm import SCHEMA, table


def components_by_pairs(sets):
    comp = list(range(len(sets)))
    for i, a in enumerate(sets):
        for j in range(i):
            if comp[i] != comp[j] and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                lo, hi = sorted((comp[i], comp[j]))
                comp = [lo if c == hi else c for c in comp]
    return comp


def family(seed, members=140, shared=200):
    """Texts that share a long passage (so they meet in buckets) and differ behind it by more or
    less, some of them in chains of small steps."""
    rng = random.Random(seed)
    passage = [f"p{i}" for i in range(shared)]
    texts, last = [], None
    for k in range(members):
        tail = [f"t{rng.randrange(10 ** 7)}" for _ in range(rng.randrange(30, 80))]
        if last and rng.random() < 0.4:
            tail = list(last)
            for _ in range(rng.randrange(1, 7)):
                tail[rng.randrange(len(tail))] = f"c{rng.randrange(10 ** 7)}"
        texts.append(" ".join(passage + tail))
        last = tail
    return texts


def test_links_beyond_the_hub_are_found_in_every_round(spark, monkeypatch):
    texts = family(5)
    sets = [frozenset(zip(*(t.split()[i:] for i in range(4)))) for t in texts]
    want = components_by_pairs(sets)
    assert 5 < len(set(want)) < len(texts)                 # neither all apart nor all joined
    docs = table(spark, texts)
    for block, rounds in ((4096, (1, 8, 64, None)), (16, (1, None)), (4096, (None,))):
        monkeypatch.setattr(near_dedup, "BLOCK", block)
        monkeypatch.setattr(near_dedup, "ROUNDS", rounds)
        got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(docs, 4, 80).collect()}
        assert got == dict(enumerate(want))


def test_rows_that_stay(spark):
    long = " ".join(f"w{i}" for i in range(60))
    near = long.replace("w3 ", "x ")
    other = " ".join(f"o{i}" for i in range(60))
    lone = " ".join(f"n{i}" for i in range(60))
    rows = [(1, long, "en", "a", 1), (2, near, "en", "a", 1), (None, long, "en", "a", 1),      # copies under another and no id
            (5, other, "en", "b", 2), (5, other, "en", "b", 2), (5, other, "en", "c", 2),       # equal rows, equal texts of one id
            (6, lone, None, "d", 3), (6, long + " tail", "d", None, 3),                          # one id with two texts
            (None, "only here " * 9, "en", "e", 4), (None, "only here " * 9, "en", "e", 4),
            (None, None, None, None, None), (None, None, None, None, None), (9, " ", "en", "f", 5)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("row1", F.lit("own")).withColumn("tags", F.create_map(F.lit("k"), F.lit("v")))
    kept = near_dedup.keep_representatives(docs, 5, 80)
    assert kept.columns == docs.columns
    got = kept.collect()
    texts = [(r["doc_id"], r["text"]) for r in got]
    assert texts.count((5, other)) == 1 and texts.count((None, "only here " * 9)) == 1
    assert texts.count((None, None)) == 2 and texts.count((9, " ")) == 1
    assert (None, long) not in texts and (2, near) not in texts and texts.count((1, long)) == 1
    assert all(r["row1"] == "own" and r["tags"] == {"k": "v"} for r in got)
    assert near_dedup.keep_representatives(docs.limit(0), 5, 80).count() == 0


def test_ids_of_pairs_are_not_exploded(spark, monkeypatch):
    """The ids whose full sets are read come once from each side, not as two rows a pair."""
    seen, original = [], near_dedup.full_sets

    def full_sets(docs, ids, n):
        seen.append((ids._jdf.queryExecution().toString(), sorted(r["doc_id"] for r in ids.collect())))
        return original(docs, ids, n)

    monkeypatch.setattr(near_dedup, "full_sets", full_sets)
    docs = table(spark, family(5))
    assert near_dedup.near_duplicates(docs, 4, 80).where("not kept").count() > 0
    assert seen and all("Generate" not in plan and len(set(ids)) == len(ids) > 0 for plan, ids in seen)


def test_last_round_makes_no_row_per_pair(spark, monkeypatch):
    """Texts just below the similarity, each likely to be linked with each other, are refused without a row per pair."""
    rng, members = random.Random(8), 120
    passage = " ".join(f"p{i}" for i in range(460))
    texts = [passage + " " + " ".join(f"t{rng.randrange(10 ** 9)}" for _ in range(64)) for _ in range(members)]
    texts += [texts[7] + " one more", texts[8] + " other end"]
    sets = [frozenset(zip(*(t.split()[i:] for i in range(4)))) for t in texts]
    want = components_by_pairs(sets)
    assert len(set(want)) == members
    pairs, asked, verified, asking = [], [], near_dedup.verified, near_dedup.asking

    def counted(proposed, *more):
        pairs.append(proposed.count())
        return verified(proposed, *more)

    def seen(rows, percent):
        out = asking(rows, percent)
        asked.append(out.select("id").distinct().count())
        return out

    monkeypatch.setattr(near_dedup, "verified", counted)
    monkeypatch.setattr(near_dedup, "asking", seen)
    monkeypatch.setattr(near_dedup, "ROUNDS", (None,))
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(table(spark, texts), 4, 80).collect()}
    assert got == dict(enumerate(want))
    assert sum(asked) > members / 2             # likely pairs were left to the last round
    assert sum(pairs) < 8 * members
