"""The Markov models of the secret scan: calibrated threshold, held-out counts, planted secrets that no base pattern finds."""

import base64
import hashlib
import random

from pyspark.sql import functions as F

from tracewise.llm import secret_scan

SCHEMA = "doc_id long, text string, spans string, n_hex string"
WORDS = ("river", "Garden", "compute", "history", "buffer", "window", "Measure", "yellow", "station", "library", "orange", "network")


def sentence(rng):
    return " ".join(rng.choices(WORDS, k=40)) + " " + "_".join(rng.choices(WORDS, k=4)) + " /" + "/".join(rng.choices(WORDS, k=5))


def planted(i):
    return base64.b64encode(hashlib.sha512(b"planted %d" % i).digest())[:32].decode()


def corpus(spark):
    """600 rows with names and paths of 20 characters or more; every third holds one secret outside all base patterns."""
    rng = random.Random(5)
    rows = []
    for i in range(600):
        a = sentence(rng)
        rows.append((i, f"{a} {planted(i)} {sentence(rng)}" if i % 3 == 0 else a, "x", None))
    return spark.createDataFrame(rows + rows[:5] + [(None, None, None, None), (None, "", None, None)], SCHEMA)


def test_planted_secrets_are_found_and_clean_texts_left_alone(spark):
    docs = corpus(spark)
    scratch = []
    model = secret_scan.train(secret_scan.samples(docs, scratch=scratch))
    assert len(scratch) == 1
    held = model["held_out"]
    assert held["random"] > 50 and held["ordinary"] > 500
    assert held["random_found"] >= 0.99 * held["random"] and held["ordinary_found"] <= 1e-4 * held["ordinary"]
    found = secret_scan.scan_secrets(docs, model)
    assert sorted(found.columns) == sorted(["doc_id", "text", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])
    rows = found.collect()
    assert len(rows) == 607
    hits = 0
    for r in rows:
        if r["doc_id"] is None or r["doc_id"] % 3:
            assert r["spans"] == "", r["text"]
        else:
            at = r["text"].index(planted(r["doc_id"]))
            hits += r["spans"] == f"random:{at}:{at + 32}"
    assert hits >= 0.99 * 202


def test_threshold_lies_between_separate_samples(spark):
    ratio = {a + b: (1.0 if b == "z" else -1.0) for a in "^" + secret_scan.LETTERS for b in secret_scan.LETTERS}
    rows = [("z" * 30 + "a" * k, 1) for k in range(3)] + [("a" * 30 + "z" * k, 0) for k in range(3)] + [("short", 0), ("no token!" * 9, 0)]
    model = secret_scan.calibrated(spark.createDataFrame(rows, "text string, label int"), ratio)
    assert -0.87 < model["least"] < 0.87
    assert model["held_out"] == {"random": 3, "random_found": 3, "ordinary": 3, "ordinary_found": 0}
    some = spark.createDataFrame(rows, "text string, label int").where(F.col("label") == 1)
    assert secret_scan.calibrated(some, ratio)["least"] == secret_scan.LEAST_RATE
    assert secret_scan.calibrated(some, ratio, 0.1)["least"] == 0.1


def test_overlap_with_base_spans():
    ratio = {a + b: 1.0 for a in "^" + secret_scan.LETTERS for b in secret_scan.LETTERS}
    model = {"ratio": ratio, "least": 0.5}
    rng = random.Random(1)
    for _ in range(300):
        text = " ".join(rng.choice(("k" * 25, "ab12" * 7, "token=" + "q" * 22, "w", "AKIA" + "Z" * 18 + "-" * 6, "x" * 30 + "=password=abcdefg")) for _ in range(8))
        base = secret_scan.base_spans(text)
        want = [(m.start(), 3, m.end()) for m in secret_scan.CANDIDATE.finditer(text)
                if all(m.end() <= s or e <= m.start() for s, _, e in base)]
        assert secret_scan.random_spans(text, model, base) == want
