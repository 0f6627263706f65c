"""The training-corpus pipeline: language ID, near-duplicate removal, benchmark decontamination, packing.

Every stage but the last returns rows as they came, with all their columns, whatever these are called. Cases: rows with a null or blank
text, or one without letters, have no language and go in the first stage; if nothing can be learned, no language can be told and all go. Rows
that repeat a doc_id and its words are copies of one another: one stays. Rows without doc_id are judged for language and leaks only. An empty
table, or an empty benchmark, is no error. Of equal texts the one of the least doc_id stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossweave.llm import decontaminate, language_id, near_dedup, packing
from glossweave.llm.queries import CONTEXT, LIMITS
from glossweave.llm.storage import materialise

#: The least posterior of a document's language with which it stays.
LEAST_SCORE = 0.5


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told: not `und`, and sure enough."""
    # columns of docs that are called like the verdicts step aside
    aside = [f"__{c}" if c.lower() in ("lang_pred", "score") else c for c in docs.columns]
    found = language_id.identify(docs.toDF(*aside), language_id.fit(docs))
    return found.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)).select(*[F.col(a).alias(c) for a, c in zip(aside, docs.columns, strict=True)])


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    return near_dedup.drop_near_duplicates(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, with their ids, in sequences of at most 4096 ids."""
    # workers hold what earlier stages left, so the encoder keeps less than in a job of its own
    return packing.pack(docs, limits=LIMITS, prompt_tokens=CONTEXT, chunks=400_000)


STAGES = [("language_id", keep_languages), ("near_dedup", drop_copies), ("decontamination", drop_leaks), ("packing", pack)]

#: Tokenisation and language scores have no SQL form: tests/llm holds the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
