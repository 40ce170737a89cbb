"""Namespace mappings: which names a file's path allows, and which paths are mapped."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rulespan.functions.names import normalised, told
from rulespan.operators.layers import ancestors


def mapped_paths(psr4: DataFrame) -> DataFrame:
    """(ordinal, path): the distinct mapped paths, the root left out, in the order in which they are declared.
    ``psr4`` is a project's own mapping, a few rows."""
    rows = psr4.select("ordinal", normalised(F.trim("path")).alias("path")).where("path not in ('', '.')")
    return rows.groupBy("path").agg(F.min("ordinal").alias("ordinal"))


def expected_names(rows: DataFrame, psr4: DataFrame, base_path: str, *, file: str = "file") -> DataFrame:
    """``rows`` with ``candidates``: the names that the mapping allows for each file, that of the longest
    mapped folder first. A file is found by its ancestor folders, so the join is by equality."""
    base = told(base_path)
    root = F.concat(F.lit(base + "/" if base else ""), F.col("folder"))
    folders = psr4.select("namespace", normalised(F.trim("path")).alias("folder"), "ordinal")
    folders = folders.select("namespace", "ordinal", F.when(F.col("folder").isin("", "."), F.lit(base)).otherwise(root).alias("__folder"))
    files = rows.select(normalised(file).alias("__file")).distinct().where(F.col("__file").endswith(".php"))
    pairs = files.select("__file", F.explode(ancestors("__file")).alias("__folder")).join(folders, "__folder")
    inner = F.substr("__file", F.length("__folder") + 2)
    inner = F.regexp_replace(F.regexp_replace(inner, r"\.php\z", ""), r"(?i)\.class\z", "")
    name = F.concat("namespace", F.regexp_replace(F.translate(inner, "/", "\\"), r"^\\+", ""))
    pairs = pairs.where(F.col("__file") != F.col("__folder")).select("__file", name.alias("name"), F.struct(-F.length("__folder"), F.col("ordinal")).alias("order"))
    best = pairs.groupBy("__file", "name").agg(F.min("order").alias("order")).groupBy("__file").agg(F.transform(F.array_sort(F.collect_list(F.struct("order", "name"))), lambda x: x["name"]).alias("candidates"))
    out = rows.withColumn("__at", normalised(file)).join(best, F.col("__at") == F.col("__file"), "left").drop("__at", "__file")
    return out.withColumn("candidates", F.coalesce("candidates", F.array().cast("array<string>")))


def nearest_folder(files: DataFrame, folders: DataFrame, *, file: str = "file") -> DataFrame:
    """(file, folder): of each file the deepest of ``folders`` (path) above it; files without one have no row."""
    pairs = files.select(F.col(file).alias("file")).distinct().select("file", F.explode(F.slice(ancestors("file"), 2, 10_000)).alias("path"))
    return pairs.join(folders.select("path"), "path").groupBy("file").agg(F.max_by("path", F.length("path")).alias("folder"))
