"""The corpus pipeline: toxicity, near-duplicates, benchmark leaks, mix, token files. Each stage calls one operator of tidemark.llm."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, mixing, simhash, tokens, toxicity
from tidemark.llm.common import remove, staged
from tidemark.llm.queries import byte_bpe

#: Toxicity from which a document is rejected.
REJECT = 0.5


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model scores below ``REJECT``, each row by its own text; without text the score is that of no word."""
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), REJECT)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of similar documents (0.8 or more over five-word shingles): that with the smallest id, nulls last.

    Texts without words are no copies of each other and all stay."""
    return simhash.drop_similar(docs, width=5, similarity=0.8)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark, each row by its own text."""
    return decontaminate.drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a row for each time that a document is taken."""
    return mixing.mix(docs)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token files, read back: doc_id, start, n_tokens, ids_crc32 of each row of the mix."""
    read = tokens.tokenize(docs, byte_bpe())
    return read.select("doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_leaks),
    ("mixing", mix_sources),
    ("token_files", token_files),
]

#: No stage but the third could be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn; each one's documents are written to the shared folder and read again. What a stage needed on the way,
    and the documents before it, are removed when it is done."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in STAGES[:-1]:
        docs, path = staged(spark, name, lambda stage=stage, docs=docs: stage(spark, docs, sf_dir))
        remove(spark, before)
        before = [path]
    return STAGES[-1][1](spark, docs, sf_dir)
