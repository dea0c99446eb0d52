"""A corpus pipeline of five stages: every stage takes `(spark, docs, sf_dir)` and works on all it is given."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docfields.llm import language, mixing, pieces, secrets, simhash
from docfields.llm.common import remainder, written

# A document whose best language is less probable than this is rejected.
LEAST_SCORE = 0.4

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def keep_identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is found; the model learns from the labelled three quarters of them.

    Null texts and texts without a letter go; null ids, very long texts, repeated rows and all columns stay.
    """
    model = language.learn(docs.where(remainder("doc_id", 4) != 2))
    found = language.identify(docs, model)
    kept = found.where((F.col("lang_pred") != language.UNDETERMINED) & (F.col("score") >= LEAST_SCORE))
    return kept.select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8 or more), that of the smallest id.

    Repeated rows are such a group. A text that repeats another many times over has nearly its fingerprint and counts as its copy.
    """
    return simhash.one_of_each(docs, width=5, similarity=0.8)


def remove_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with a mark in the place of each secret; null texts stay null, `n_chars` follows the text."""
    return secrets.redact_secrets(docs).withColumn("n_chars", F.coalesce(F.length("text"), F.col("n_chars")))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as drawn for their sources' weights, in mixed order.

    The draw depends on the id alone, so rows of one id, null too, are drawn alike; a null source is a source of its own.
    """
    return mixing.mix(docs).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sampled segmentations of every document; null and empty texts have the empty one, repeated rows repeat theirs."""
    return pieces.sample_pieces(docs)


STAGES: list[tuple[str, Stage]] = [
    ("language_id", keep_identified),
    ("simhash_near_dedup", drop_near_copies),
    ("secret_scan", remove_secrets),
    ("mix_sources", mix_sources),
    ("sentencepiece", encode),
]

# Models, fingerprints and segmentations have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
