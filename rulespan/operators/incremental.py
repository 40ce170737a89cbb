"""What has changed between two snapshots, by the hash of their contents, and reuse of old facts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def changes(old: DataFrame, new: DataFrame, *, key: str, content: str) -> DataFrame:
    """(key, change): added, removed, changed or same for every key of the two snapshots."""
    a = old.select(F.col(key).alias("__old"), F.md5(F.col(content).cast("binary")).alias("__old_hash"))
    b = new.select(F.col(key).alias("__new"), F.md5(F.col(content).cast("binary")).alias("__new_hash"))
    change = F.when(F.col("__old").isNull(), "added").when(F.col("__new").isNull(), "removed").when(F.col("__old_hash").eqNullSafe(F.col("__new_hash")), "same").otherwise("changed")
    return a.join(b, F.col("__old") == F.col("__new"), "full_outer").select(F.coalesce("__new", "__old").alias(key), change.alias("change"))


def split_by_cache(files: DataFrame, cached: DataFrame, *, key: str = "file", hash_column: str = "hash") -> tuple[DataFrame, DataFrame]:
    """The files whose cached facts still hold, and those to extract anew. Both have (key, hash)."""
    valid = cached.select(key, hash_column).distinct()
    return files.join(valid, [key, hash_column], "left_semi"), files.join(valid, [key, hash_column], "left_anti")
