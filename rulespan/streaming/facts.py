"""Streams of facts (an extension): new fact files are judged as they come."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rulespan import schemas
from rulespan.rules.base import Facts, Rule
from rulespan.sources.facts import with_defaults


def read_nodes(spark: SparkSession, path: str, *, files_per_trigger: int = 100, format: str = "parquet") -> DataFrame:
    return spark.readStream.format(format).schema(schemas.CLASS_NODES).option("maxFilesPerTrigger", files_per_trigger).load(path)


def row_violations(nodes: DataFrame, rules: dict[str, Rule]) -> DataFrame:
    """Violations of rules that look at one class at a time; works on streams, stateless. Rules that need
    usage flags or other classes must be run in batches."""
    if bad := sorted(k for k, r in rules.items() if r.needs or r.scope != "class"):
        raise ValueError(f"rules {bad} need all facts")
    empty = F.array().cast("array<string>")
    nodes = with_defaults(nodes).withColumns({"parent_classes": empty, "parent_interfaces": empty})
    out = None
    for key, rule in rules.items():
        found = rule.violations(Facts(nodes), key)
        out = found if out is None else out.unionByName(found)
    return out


def windowed_counts(events: DataFrame, *, at: str, by: str, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(window_start, by, n) per window, closed when the watermark has passed."""
    counted = events.withWatermark(at, late).groupBy(F.window(at, window).alias("w"), by).agg(F.count("*").alias("n"))
    return counted.select(F.col("w.start").alias("window_start"), by, "n")


def write_each(found: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str):
    """Starts the stream; ``sink`` gets each batch and its number, and must be idempotent by it."""
    return found.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
