"""Whether abstractions are used: extended, implemented, referenced, instantiated. Names are compared
without regard to case."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rulespan.functions.names import ascii_lower
from rulespan.operators.graph import closure, inheritance, trait_users


def _names(df: DataFrame, items: str) -> DataFrame:
    return df.select(F.explode(items).alias("x")).select(ascii_lower("x").alias("name"))


def _single(df: DataFrame, item: str) -> DataFrame:
    return df.where(F.col(item).isNotNull()).select(ascii_lower(item).alias("name"))


def _all(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts).where("name is not null").distinct()


def instantiated_names(nodes: DataFrame, anonymous: DataFrame, instantiations: DataFrame) -> DataFrame:
    """(name): classes that something creates. A target without keyword or with ``self`` or ``parent`` of a
    class is that class; ``static`` also its descendants. In a trait the keywords speak of the classes
    that compose it: ``parent`` of what they extend, ``self`` of themselves, ``static`` of their descendants too."""
    targets = instantiations.select("file", F.explode("targets").alias("t")).select("file", F.col("t.keyword").alias("keyword"), ascii_lower("t.class_name").alias("name"))
    plain = targets.where("keyword is null").select("name")
    kept = targets.where("keyword is not null").select("keyword", "name").distinct()
    traits = nodes.where("is_trait").select(ascii_lower("class_name").alias("name")).distinct()
    of_class = kept.join(traits, "name", "left_anti")
    of_trait = kept.join(traits, "name", "left_semi").withColumnRenamed("name", "trait")

    # an anonymous user can't be named, so only its parent matters
    named = nodes.select(ascii_lower("class_name").alias("user"), F.explode("traits").alias("t")).select("user", ascii_lower("t").alias("trait"))
    unnamed = anonymous.select(F.concat_ws(":", F.lit("class@anonymous"), "file", F.col("line").cast("string"), ascii_lower("extends")).alias("user"), ascii_lower("extends").alias("parent"), F.explode("traits").alias("t"))
    users = trait_users(named.unionByName(unnamed.select("user", ascii_lower("t").alias("trait"))), traits)
    parents = nodes.select(ascii_lower("class_name").alias("user"), ascii_lower("extends").alias("parent")).unionByName(unnamed.select("user", "parent")).where("parent is not null").distinct()
    composed = of_trait.join(users, "trait")
    is_named = ~F.col("user").startswith("class@anonymous:")
    by_parent = composed.where("keyword = 'parent'").join(parents, "user").select(F.col("parent").alias("name"))
    by_self = composed.where(is_named & (F.col("keyword") == "self")).select(F.col("user").alias("name"))
    late = composed.where(is_named & (F.col("keyword") == "static")).select(F.col("user").alias("name"))

    late = _all(late, of_class.select("name"))
    ancestors = closure(inheritance(nodes).where("kind = 'class'").select(ascii_lower("src").alias("src"), ascii_lower("dst").alias("dst")))
    descendants = ancestors.join(late.withColumnRenamed("name", "dst"), "dst").select(F.col("src").alias("name"))
    return _all(plain, by_parent, by_self, late, descendants)


def with_usage(nodes: DataFrame, anonymous: DataFrame, references: DataFrame, instantiations: DataFrame, flags: set[str]) -> DataFrame:
    """``nodes`` (with ancestors) with the four flags; those not in ``flags`` are false and cost nothing."""
    key = ascii_lower("class_name")
    sets: dict[str, DataFrame] = {}
    instantiated = instantiated_names(nodes, anonymous, instantiations) if flags & {"is_instantiated", "is_referenced"} else None
    if "is_extended" in flags:
        sets["is_extended"] = _all(_names(nodes, "parent_classes"), _single(anonymous, "extends"))
    if "is_implemented" in flags:
        sets["is_implemented"] = _all(_names(nodes, "parent_interfaces"), _names(anonymous, "implements"))
    if "is_instantiated" in flags:
        sets["is_instantiated"] = instantiated
    if "is_referenced" in flags:
        # a class's own name and those in its own clauses don't count among its dependencies
        clauses = F.concat(F.array(key), F.transform(F.concat("implements", "interface_extends", F.array_compact(F.array("extends"))), ascii_lower))
        outer = nodes.select(F.explode(F.array_except(F.transform("dependencies", ascii_lower), clauses)).alias("name"))
        sets["is_referenced"] = _all(_names(nodes, "traits"), _names(anonymous, "traits"), outer, _names(references, "references"), instantiated)
    out = nodes.withColumn("__key", key)
    for flag in ("is_extended", "is_implemented", "is_referenced", "is_instantiated"):
        out = out.drop(flag)
        if flag in sets:
            hit = sets[flag].select(F.col("name").alias("__name"), F.lit(True).alias(flag))
            out = out.join(hit, F.col("__key") == F.col("__name"), "left").drop("__name").withColumn(flag, F.coalesce(flag, F.lit(False)))
        else:
            out = out.withColumn(flag, F.lit(False))
    concrete = ~(F.col("is_interface") | F.col("is_trait") | F.col("is_enum") | F.col("is_abstract"))
    return out.withColumn("is_instantiated", F.col("is_instantiated") & concrete).drop("__key")
