"""The corpus pipeline: toxicity, line dedup, near-dedup, benchmark decontamination, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and
read again as the next one's documents. All but the last return the columns of documents; a
stage keeps clean documents whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from duologue.llm import decontam, linededup, neardup, packing, toxicity
from duologue.llm.store import Scratch


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that score 0.5 or more; the model is fitted on labelled rows of these documents."""
    grammar, weights = toxicity.fitted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.without_toxic(docs, (grammar, weights))


def lines_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes repeated lines out of the texts; n_chars follows."""
    kept = linededup.dedup_lines(docs)
    return kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def copies_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates: the one with the smallest doc_id.

    Of rows that repeat a doc_id, one stays too: the one whose text comes first. Rows without a
    doc_id have no group and stay.
    """
    gone = neardup.near_duplicates(docs).filter("id <> group").select(F.col("id").alias("doc_id"))
    kept = docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    again = docs.filter("doc_id IS NOT NULL").groupBy("doc_id").count().filter("count > 1").select("doc_id")
    if again.isEmpty():
        return kept
    first = Window.partitionBy("doc_id").orderBy(*(F.col(f"`{c}`") for c in ["text", *(c for c in docs.columns if c not in ("doc_id", "text"))]))
    one = kept.join(again, "doc_id", "left_semi").withColumn("__row", F.row_number().over(first)).filter("__row = 1")
    return kept.join(again, "doc_id", "left_anti").select(*docs.columns).unionByName(one.select(*docs.columns))


def leaks_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item."""
    found = decontam.contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return docs.join(found.select(F.col("id").alias("doc_id")).distinct(), "doc_id", "left_anti").select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences."""
    return packing.digest(packing.pack(docs))


STAGES = [("toxicity", toxic_out), ("line_dedup", lines_out), ("near_dedup", copies_out), ("decontamination", leaks_out), ("packing", packed)]
#: Tokenisation, learned toxicity and alignment are not SQL; what each stage keeps is tested against brute force on a fixture.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch, docs = Scratch(spark, "pipeline"), spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
