"""Violations of earlier runs, so that a run on unchanged files with an unchanged configuration is a read."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rulespan import schemas


def content_key(files: DataFrame, configuration: Mapping) -> str:
    """A key of what ``files`` (file, hash) hold and of a configuration, whatever the order of either. The
    files' hashes are summed, so nothing is sorted or gathered."""
    parts = [F.sum(F.xxhash64(F.lit(salt), "file", "hash").cast("decimal(38,0)")).alias(f"s{salt}") for salt in range(3)]
    told = files.agg(F.count("*").alias("n"), *parts).first()
    return hashlib.sha256(json.dumps([str(x) for x in told] + [configuration], sort_keys=True, default=str).encode()).hexdigest()


class ResultCache:
    """Results below a folder, each by its key, with the metadata that a reader must have too."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _index(self) -> DataFrame:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/index")
        ddl = "key string, metadata string, batch string"
        return self.spark.read.schema(ddl).parquet(f"{self.path}/index") if where.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(where) else self.spark.createDataFrame([], ddl)

    def load(self, key: str, metadata: Mapping) -> DataFrame | None:
        """The violations saved under ``key``; None where there are none, or their metadata differ in anything."""
        told = json.dumps(metadata, sort_keys=True, default=str)
        batch = self._index().where((F.col("key") == key) & (F.col("metadata") == told)).agg(F.max("batch")).first()[0]
        return None if batch is None else self.spark.read.schema(schemas.VIOLATIONS).parquet(f"{self.path}/results/{batch}")

    def save(self, key: str, metadata: Mapping, violations: DataFrame) -> None:
        """The index's entry is written last; a result without one doesn't count."""
        batch = str(uuid.uuid4())
        violations.write.parquet(f"{self.path}/results/{batch}")
        entry = [(key, json.dumps(metadata, sort_keys=True, default=str), batch)]
        self.spark.createDataFrame(entry, "key string, metadata string, batch string").coalesce(1).write.mode("append").parquet(f"{self.path}/index")

    def clear(self) -> None:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)
