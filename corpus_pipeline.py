"""From raw documents to token ids: language, near-duplicates, benchmark passages, personal data, byte-pair encoding.

Each stage takes (spark, docs, sf_dir); its result is written as Parquet and read again as the next one's docs. All but the
last return the columns of documents. Rows that a stage drops stay dropped and texts that it changes stay changed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import bpe, decontam, langid, pii, simhash
from gridloom.llm.common import cut, documents, release, scratch
from gridloom.llm.queries import tokenizer_path


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the model of the documents themselves knows."""
    return langid.keep_identified(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the one with the least doc_id."""
    return simhash.deduplicate(docs)


def drop_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontam.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data and disclosing terms replaced by their kind."""
    return pii.sanitise(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, n_tokens, ids, exact): token ids, and whether they decode to the text."""
    coded = bpe.encode_decode(docs, tokenizer_path(), as_array=True, keep=("doc_id", "lang", "source", "text"))
    exact = F.col("decoded") == F.coalesce("text", F.lit(""))
    return coded.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", exact.alias("exact"))


STAGES = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_benchmark_passages),
    ("pii", replace_personal_data),
    ("bpe", encode),
]

#: The first stage is a trained model, so SQL cannot express the rows; tests compare each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the whole documents table."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        with scratch(spark):  # a stage's own tables, and what it read, go when its result is written
            release(docs)
            docs = cut(stage(spark, docs, sf_dir), f"stage-{name}", kept=True)
    return docs
