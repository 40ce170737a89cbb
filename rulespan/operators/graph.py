"""Closures over inheritance and trait use: set semantics, cycles allowed.

Every round joins the pairs at the largest distance so far with all pairs, which doubles the distance; a
round writes what it finds, and only that, to the shared folder, so that lineage is cut.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rulespan.functions.names import ascii_lower


def _temporary_folder() -> str:
    """A folder that goes with the driver's process."""
    folder = tempfile.mkdtemp()
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where that is unset, one in the warehouse, or in local mode a
    temporary one."""
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
        if not folder:
            folder = _temporary_folder() if context.master.startswith("local[") else spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
        context.setCheckpointDir(folder)
    return context._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def closure(edges: DataFrame) -> DataFrame:
    """(src, dst): all pairs that a path of one edge or more connects. ``edges``: (src, dst).

    A pair at a distance of n to 2n edges goes through one at exactly n, so rounds are few, however long the
    longest way is, and on trees each pair is found once.
    """
    parts = [cut(edges.select("src", "dst").where("src is not null and dst is not null").distinct().withColumn("distance", F.lit(1).cast("long")))]
    farthest, n = parts[0], 1
    while not farthest.isEmpty():
        every = reduce(DataFrame.unionByName, parts)
        onward = every.select(F.col("src").alias("via"), F.col("dst").alias("next"), F.col("distance").alias("more"))
        found = farthest.join(onward, F.col("dst") == F.col("via")).groupBy("src", F.col("next").alias("dst")).agg((F.min("more") + n).alias("distance"))
        parts.append(cut(found.join(every.select("src", "dst"), ["src", "dst"], "left_anti")))
        n *= 2
        farthest = parts[-1].where(F.col("distance") == n)
    return reduce(DataFrame.unionByName, parts).select("src", "dst")


def last_by_key(nodes: DataFrame, key: str = "class_name") -> DataFrame:
    """One row of each name: the last in the order of files and lines, as later declarations hide earlier ones."""
    rest = [c for c in nodes.columns if c not in (key, "file", "line")]
    # one shuffle; rows of the same place are told apart by their other columns
    last = nodes.groupBy(key).agg(F.max(F.struct("file", "line", *rest)).alias("__last"))
    return last.select(key, "__last.*").select(*nodes.columns)


def _edges(nodes: DataFrame, kind: str, items: str, *, single: bool = False) -> DataFrame:
    target = F.array_compact(F.array(items)) if single else F.col(items)
    return nodes.select(F.col("class_name").alias("src"), F.explode(target).alias("dst"), F.lit(kind).alias("kind"))


def inheritance(nodes: DataFrame) -> DataFrame:
    """(src, dst, kind): who extends or implements whom; kind is class, interface, or super (of interfaces)."""
    return _edges(nodes, "class", "extends", single=True).unionByName(_edges(nodes, "interface", "implements")).unionByName(_edges(nodes, "super", "interface_extends"))


def with_ancestors(nodes: DataFrame) -> DataFrame:
    """``nodes`` with ``parent_classes`` and ``parent_interfaces``: all ancestors but the row itself, compared
    without regard to case, spelled as where they are named, sorted."""
    edges = inheritance(nodes).where("dst is not null")
    keyed = cut(edges.select(ascii_lower("src").alias("src"), ascii_lower("dst").alias("dst"), "kind", F.col("dst").alias("spelling")))
    # of several spellings of one name the first in order stands for all
    spelling = keyed.groupBy("dst").agg(F.min("spelling").alias("spelling"))
    classes = closure(keyed.where("kind = 'class'"))
    # interfaces of the class and of its ancestors, and from there super-interfaces only
    named = keyed.where("kind <> 'class'").select("src", "dst")
    through = classes.select("src", F.col("dst").alias("via")).join(named.select(F.col("src").alias("via"), "dst"), "via").select("src", "dst")
    direct = named.unionByName(through).distinct()
    above = closure(keyed.where("kind = 'super'")).select(F.col("src").alias("via"), F.col("dst").alias("up"))
    interfaces = direct.unionByName(direct.join(above, F.col("dst") == F.col("via")).select("src", F.col("up").alias("dst"))).distinct()

    def listed(pairs: DataFrame, name: str) -> DataFrame:
        named = pairs.where("src <> dst").join(spelling, "dst")
        return named.groupBy("src").agg(F.sort_array(F.collect_set("spelling")).alias(name))

    out = nodes.withColumn("__key", ascii_lower("class_name"))
    for pairs, name in ((classes, "parent_classes"), (interfaces, "parent_interfaces")):
        found = listed(pairs, name).withColumnRenamed("src", "__src")
        out = out.drop(name).join(found, F.col("__key") == F.col("__src"), "left").drop("__src")
        out = out.withColumn(name, F.coalesce(name, F.array().cast("array<string>")))
    return out.drop("__key")


def inherited_dependencies(nodes: DataFrame) -> DataFrame:
    """(class_name, dependency): own dependencies, every ancestor reached through any clause, and what those
    depend on. Names are compared by case."""
    kinds = inheritance(nodes).select("src", "dst").unionByName(_edges(nodes, "trait", "traits").select("src", "dst")).where("dst is not null")
    reached = closure(kinds)
    own = nodes.select(F.col("class_name"), F.explode("dependencies").alias("dependency"))
    last = last_by_key(nodes.select("class_name", "file", "line", "dependencies")).select(F.col("class_name").alias("dst"), F.explode("dependencies").alias("dependency"))
    through = reached.join(last, "dst").select(F.col("src").alias("class_name"), "dependency")
    clauses = reached.select(F.col("src").alias("class_name"), F.col("dst").alias("dependency"))
    return own.unionByName(clauses).unionByName(through).distinct()


def trait_users(uses: DataFrame, traits: DataFrame) -> DataFrame:
    """(trait, user): who composes a trait, directly or through other traits. ``uses``: (user, trait);
    ``traits``: (name) of what is a trait itself and so passes its own on."""
    reached = closure(uses.select(F.col("user").alias("src"), F.col("trait").alias("dst")))
    return reached.join(traits.select(F.col("name").alias("src")), "src", "left_anti").select(F.col("dst").alias("trait"), F.col("src").alias("user"))
