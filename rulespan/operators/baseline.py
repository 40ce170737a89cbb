"""Baselines: accepted violations that later runs leave out. Lines don't count, so moved code stays accepted."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rulespan import schemas
from rulespan.functions.names import told

_PAIRS = (("rule_key", "rule"), ("message", "message"), ("file", "file"), ("class_name", "class"), ("layer", "layer"))


def _relative(text: Column, base: str) -> Column:
    """Paths in a text, told from the base; longer paths that hold the base somewhere inside stay."""
    return F.regexp_replace(text, rf"(?<![\w./\\~-])\Q{base}/\E", "") if base else text


def signatures(violations: DataFrame, base_path: str = "") -> DataFrame:
    """(rule, message, file, class, layer) of violations, paths relative to the base, each once."""
    base = told(base_path) if base_path else ""
    file = F.when(F.col("file").startswith(base + "/"), F.substr("file", F.lit(len(base) + 2))).otherwise(F.col("file")) if base else F.col("file")
    return violations.select(F.col("rule_key").alias("rule"), _relative(F.col("message"), base).alias("message"), file.alias("file"), F.col("class_name").alias("class"), "layer").distinct()


def without_accepted(violations: DataFrame, baseline: DataFrame, base_path: str = "") -> DataFrame:
    """Violations with no equal signature in the baseline; one entry silences all that are equal."""
    base = told(base_path) if base_path else ""
    file = F.when(F.col("file").startswith(base + "/"), F.substr("file", F.lit(len(base) + 2))).otherwise(F.col("file")) if base else F.col("file")
    left = violations.withColumns({"__message": _relative(F.col("message"), base), "__file": file})
    right = baseline.select(*(F.col(b).alias(f"b_{b}") for _, b in _PAIRS)).distinct()
    # a violation of no file, class or layer is equal to an entry of none
    on = reduce(Column.__and__, (F.col(a).eqNullSafe(F.col(b)) for a, b in (("rule_key", "b_rule"), ("__message", "b_message"), ("__file", "b_file"), ("class_name", "b_class"), ("layer", "b_layer"))))
    return left.join(right, on, "left_anti").drop("__message", "__file")


def write(violations: DataFrame, path: str, base_path: str = "", format: str = "parquet") -> None:
    signatures(violations, base_path).write.mode("overwrite").format(format).save(path)


def read(spark: SparkSession, path: str, format: str = "parquet") -> DataFrame:
    """A baseline with its schema; a missing one is an error, and rows that aren't entries are left out."""
    return spark.read.format(format).schema(schemas.BASELINE).load(path).where("rule is not null and message is not null")
