"""Corpus pipeline: five stages from raw documents to encoded, mixed text.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before
kept; its result is written as Parquet and reread as the next stage's
``docs``. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewise.llm import language, mixing, near_dedup, piece_lattice, secret_scan
from tracewise.llm.common import drop, read, stored

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Least share of n-grams that the predicted language knows.
LEAST_SCORE = 0.4


def _documents(df: DataFrame) -> DataFrame:
    return df.select(*COLUMNS)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or in none of the languages that the filter knows, go."""
    model = language.train(docs.where(~language.held_out()))
    found = language.identify(docs, model)
    if not model["names"]:
        return _documents(docs)     # nothing was learned, so nothing can be rejected
    return _documents(found.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8) stays."""
    return _documents(near_dedup.keep_representatives(docs, shingle=5, percent=80))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are covered by a mark; n_chars follows the text."""
    scratch: list[str] = []
    model = secret_scan.train(secret_scan.samples(docs, scratch=scratch))
    drop(spark, scratch)
    return _documents(secret_scan.redact(docs, model).withColumn("n_chars", F.length("text").cast("long")))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it."""
    return _documents(mixing.emit(mixing.mix(docs)))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_pieces and ids of every row."""
    import public_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    found = piece_lattice.encode(docs, piece_lattice.dictionary(docs, path), path)
    return found.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_pieces"), "ids")


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_duplicates),
    ("secret_scan", secrets),
    ("mix_sources", mix_sources),
    ("sentencepiece", encode),
]

#: Trained models and similarity sketches are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        docs = out if k == len(STAGES) - 1 else stored(out, f"pipeline-{name}")
    return docs
