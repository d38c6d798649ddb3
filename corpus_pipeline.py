"""From raw documents to token ids: language, near-duplicates, benchmark passages, personal data, byte-level BPE.

Each stage takes (spark, docs, sf_dir) and gives the documents that go on, as Parquet is written and read between stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from minutewise.llm import byte_bpe, containment, language, near_copies, pii
from minutewise.llm.common import read, saved

# A worker serves all stages, and what it keeps in one takes room in the others; so it keeps fewer pieces, and cuts fewer bytes at a time, than
# byte_bpe alone.
KEPT_PIECES, AT_ONCE = 50_000, 1 << 20

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def in_a_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages that the labelled ones among them teach; rejected ones go."""
    model = language.fit(language.learnable(docs))
    told = language.with_language(docs.select(*COLUMNS), F.col("text"), model, "_language")
    return told.where("NOT _language.rejected").select(*COLUMNS)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (Jaccard index of five-word shingles of 0.8 or more): the one with the smallest id."""
    return near_copies.one_of_each(docs.select(*COLUMNS))


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return containment.decontaminated(docs.select(*COLUMNS), read(spark, sf_dir, "benchmark"))


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with identifiers in their text replaced by their kind; n_chars follows the text."""
    masked = docs.select("doc_id", pii.masked()(F.col("text")).alias("text"), "lang", "source")
    return masked.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def as_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of every document, their number, and digests of ids and decoded text."""
    return byte_bpe.digested(byte_bpe.round_trip(docs, kept=KEPT_PIECES, at_once=AT_ONCE), "ids")


STAGES = [
    ("language", in_a_language),
    ("near_duplicates", without_near_duplicates),
    ("decontamination", without_benchmark),
    ("pii", without_personal_data),
    ("tokens", as_tokens),
]

# Language model, fingerprints and merges are beyond SQL; tests/llm holds the result against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
