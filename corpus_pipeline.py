"""A corpus pipeline: five stages over ``documents``, each an operator of ``rulespan.llm``."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rulespan.llm.common import delete_folder, shared_folder
from rulespan.llm.decontamination import decontaminate
from rulespan.llm.jaccard_join import jaccard_components
from rulespan.llm.line_dedup import LONG_DOCS, SHORT_DOCS, drop_recurring_lines
from rulespan.llm.queries import QUALITY_CUT, mixed, quality_scores

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score reaches the cut."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality_scores(docs, labels, COLUMNS, name="__score").where(F.col("__score") >= QUALITY_CUT).select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their recurring lines; those go that have lost lines and have no text left."""
    out = drop_recurring_lines(docs.select(*COLUMNS), long_docs=LONG_DOCS, short_docs=SHORT_DOCS)
    return out.where((F.col("n_dropped") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]")).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents that links of five-word shingles connect, the one with the smallest id; a row
    without an id stays only where no other has one, and of rows that repeat an id and its text one counts."""
    docs = docs.select(*COLUMNS)
    ids = docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 OR doc_id IS NULL")
    if ids.isEmpty():
        copies = jaccard_components(docs, width=5, num=80, den=100).where("component_id <> doc_id")
        return docs.join(copies.select("doc_id"), "doc_id", "left_anti").select(*COLUMNS)
    # ids don't tell rows apart, but ids and texts do
    rows = docs.withColumn("__row", F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("hash")))
    found = jaccard_components(rows.select("__row", "text"), doc_id="__row", width=5, num=80, den=100).where("n_shingles > 0")
    found = found.groupBy(F.col("doc_id").alias("__own")).agg(F.count("*").alias("n"), F.min("component_id").alias("__least"))
    copies, repeated = found.where("__own <> __least").select("__own"), found.where("__own = __least AND n > 1").select("__own")
    rows = rows.join(copies, F.col("__row") == F.col("__own"), "left_anti")
    one = rows.join(repeated, F.col("__row") == F.col("__own"), "left_semi").dropDuplicates(["__row"])
    return rows.join(repeated, F.col("__row") == F.col("__own"), "left_anti").unionByName(one).select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap with no benchmark item."""
    return decontaminate(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample in the target mixture, with each document's topic, tokens and probability."""
    return mixed(docs.select(*COLUMNS)).where("sampled").select(*COLUMNS, "topic", "n_tokens", "probability")


STAGES = [("quality", quality), ("line_dedup", line_dedup), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("mixing", mixing)]
#: The quality classifier can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; between stages, rows are Parquet files in the shared folder. The input of
    the last stage stays there, as the result reads it. Empty tables give an empty result."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES[:-1]:
        path = f"{shared_folder(spark)}/pipeline-{uuid.uuid4()}"
        try:
            stage(spark, docs, sf_dir).write.parquet(path)
        except BaseException:
            delete_folder(spark, path)
            raise
        finally:
            if before:
                delete_folder(spark, before)
        docs, before = spark.read.parquet(path), path
    return STAGES[-1][1](spark, docs, sf_dir)
