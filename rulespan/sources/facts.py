"""Facts in Parquet, keyed by each file's content, so that only changed files are extracted again."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rulespan import schemas

TABLES = {"nodes": schemas.CLASS_NODES, "anonymous": schemas.ANONYMOUS_CLASSES, "references": schemas.FILE_REFERENCES,
          "instantiations": schemas.FILE_INSTANTIATIONS, "analyses": schemas.FILE_ANALYSES}


def with_defaults(rows: DataFrame, defaults: Mapping[str, str] = schemas.NODE_DEFAULTS) -> DataFrame:
    """Class facts completed by default values; ``layers`` is ``[layer]`` where it is missing."""
    out = rows
    for name, sql in defaults.items():
        default = F.expr(sql)
        out = out.withColumn(name, F.coalesce(F.col(name), default) if name in out.columns else default)
    layers = F.when(F.coalesce(F.size("layers"), F.lit(0)) > 0, F.col("layers")).otherwise(F.array_compact(F.array("layer")))
    out = out.withColumn("layers", layers)
    return out.select(*(c for c in out.columns if c in {f.split()[0] for f in _fields(schemas.CLASS_NODES)}))


def _fields(ddl: str) -> list[str]:
    """Top-level fields of a DDL string."""
    out, depth, start = [], 0, 0
    for i, c in enumerate(ddl):
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(ddl[start:i].strip())
            start = i + 1
    return [*out, ddl[start:].strip()]


class FactStore:
    """Tables of facts below a folder, one folder for each configuration."""

    def __init__(self, spark: SparkSession, path: str, namespace: str = "default"):
        self.spark, self.path = spark, f"{path.rstrip('/')}/{namespace}"

    def _exists(self, name: str) -> bool:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(where)

    def read(self, name: str) -> DataFrame:
        """Facts with the hash of the content that they are from; a missing table counts as empty."""
        ddl = f"{TABLES[name]}, hash string, batch string"
        if not self._exists(name):
            return self.spark.createDataFrame([], ddl).drop("batch")
        return self.spark.read.schema(ddl).parquet(f"{self.path}/{name}").join(self._committed(), ["file", "hash", "batch"], "left_semi").drop("batch")

    def _committed(self) -> DataFrame:
        """(file, hash, batch) of what is here in full: a run that fails leaves no entry, so its rows don't
        count, and of several runs that extracted the same file one counts."""
        ddl = "file string, hash string, batch string"
        here = self.spark.read.schema(ddl).parquet(f"{self.path}/files") if self._exists("files") else self.spark.createDataFrame([], ddl)
        return here.groupBy("file", "hash").agg(F.min("batch").alias("batch"))

    def files(self) -> DataFrame:
        """(file, hash) of all files whose facts are here."""
        return self._committed().select("file", "hash")

    def refresh(self, files: DataFrame, extract: Callable[[DataFrame], Mapping[str, DataFrame]]) -> dict[str, DataFrame]:
        """Facts of ``files`` (file, content, hash): those that are here and still hold, and new ones, which
        are added. Returns the tables without hashes. The files' own entries are written last, which makes the
        batch count."""
        batch = F.lit(str(uuid.uuid4())).alias("batch")
        stale = files.join(self.files(), ["file", "hash"], "left_anti")
        fresh = extract(stale)
        hashes = files.select("file", "hash").distinct()
        for name, ddl in TABLES.items():
            # rows of older contents stay behind; the join with the current hashes leaves them out
            columns = [f.split()[0] for f in _fields(ddl)]
            fresh[name].join(hashes, "file").select(*columns, "hash", batch).write.mode("append").parquet(f"{self.path}/{name}")
        stale.select("file", "hash", batch).write.mode("append").parquet(f"{self.path}/files")
        return {name: self.read(name).join(hashes, ["file", "hash"], "left_semi").drop("hash") for name in TABLES}

    def clear(self) -> None:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)
