"""A corpus pipeline: language ID, near-duplicates, decontamination, secrets, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from featherloom.llm import decontam, langid, neardup, packing, secrets
from featherloom.llm.common import cut, read_table
from featherloom.llm.queries import tokenizer_path

#: Out-of-place distance, as a share of the largest one, beyond which a text is like none of the learned languages.
MAX_DISTANCE = 0.8
#: Near-duplicates share this percentage of the five-word shingles of both, or more.
NEAR_PERCENT = 80


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages of the labelled documents; texts without letters, or like no language, go."""
    profiles = langid.learn_profiles(docs)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("text").alias("whole"))
    found = langid.identify(rows, profiles, text_col="whole", keep=["row"])
    return found.where((F.col("lang_pred") != "und") & (F.col("distance") <= MAX_DISTANCE)).select("row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return neardup.drop_near_duplicates(docs, percent=NEAR_PERCENT)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of any benchmark item: one quoted item is enough to go."""
    return decontam.drop_contaminated(docs, read_table(spark, sf_dir, "benchmark"), min_items=1)


def scan_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets in the texts replaced by a mark."""
    return secrets.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences."""
    return packing.pack_documents(docs, tokenizer_path())


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("scan_secrets", scan_secrets),
    ("pack", pack),
]

#: Tokenization, MinHash and packing are beyond SQL; tests hold the rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
