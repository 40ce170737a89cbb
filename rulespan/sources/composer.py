"""The namespace mapping of ``composer.json``."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAPPING = "ordinal int, section string, namespace string, path string"
_PATHS = ("autoload", "autoload-dev")


def parse(text: str | None) -> dict | None:
    """The configuration; None where it is missing, isn't JSON or is a list."""
    if text is None:
        return None
    try:
        out = json.loads(text)
    except ValueError:
        return None
    return out if isinstance(out, dict) else None


def mapping(spark: SparkSession, config: dict | None) -> DataFrame:
    """(ordinal, section, namespace, path) of one project's configuration, in its order."""
    rows = []
    for section in _PATHS:
        autoload = (config or {}).get(section)
        psr4 = autoload.get("psr-4") if isinstance(autoload, dict) else None
        for namespace, paths in psr4.items() if isinstance(psr4, dict) else ():
            for path in paths if isinstance(paths, list) else [paths]:
                if isinstance(path, str):
                    rows.append((len(rows), section, namespace, path))
    return spark.createDataFrame(rows, MAPPING)


def mappings(projects: DataFrame, *, key: str, config: str) -> DataFrame:
    """The same for many projects, without leaving the JVM: (key, section, namespace, path); ``config`` is JSON."""
    parsed = F.from_json(F.col(config), "autoload struct<`psr-4` map<string,variant>>, `autoload-dev` struct<`psr-4` map<string,variant>>")
    rows = projects.select(F.col(key), parsed.alias("c"))
    parts = []
    for section in _PATHS:
        entries = rows.select(F.col(key), F.lit(section).alias("section"), F.explode(F.col("c").getField(section).getField("psr-4")).alias("namespace", "paths"))
        # a path is a string or a list of strings
        one = F.try_variant_get("paths", "$", "string")
        many = F.try_variant_get("paths", "$", "array<string>")
        paths = F.when(F.schema_of_variant("paths").startswith("ARRAY"), many).otherwise(F.array(one))
        parts.append(entries.select(key, "section", "namespace", F.explode(paths).alias("path")).where("path is not null"))
    return parts[0].unionByName(parts[1])


def read(spark: SparkSession, base_path: str) -> tuple[DataFrame, str]:
    """The mapping below ``base_path``, and whether its file was found, missing or invalid. The file is
    read by Spark, so it may lie in any store."""
    name = f"{base_path.rstrip('/')}/composer.json"
    where = spark._jvm.org.apache.hadoop.fs.Path(name)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return mapping(spark, None), "missing"
    config = parse(spark.read.text(name, wholetext=True).first()[0])
    return mapping(spark, config), "invalid" if config is None else "found"
