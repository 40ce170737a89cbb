"""Which layers a layer may depend on."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rulespan.operators.graph import last_by_key
from rulespan.operators.layers import Layers
from rulespan.rules.base import columns, report, said


def expanded(ruleset: Mapping[str, Sequence[str]]) -> dict[str, list[str]]:
    """Allowed layers with each ``+X`` replaced by what X may depend on, and X itself. What leads back to a
    layer that is being expanded adds nothing more."""

    def allowed(layer: str, above: frozenset[str]) -> list[str]:
        out: list[str] = []
        for entry in ruleset.get(layer, ()):
            if entry.startswith("+"):
                name = entry[1:]
                if name not in above:
                    out += [name, *allowed(name, above | {name})]
            else:
                out.append(entry)
        return list(dict.fromkeys(out))

    return {layer: allowed(layer, frozenset({layer})) for layer in ruleset}


def violations(edges: DataFrame, nodes: DataFrame, layers: Layers, ruleset: Mapping[str, Sequence[str]], *, skips: DataFrame | None = None,
               scan_scope: Sequence[str] = (), skipped_file: Column | None = None) -> DataFrame:
    """Dependencies on layers that the ruleset doesn't allow.

    ``edges``: (class_name, dependency), inherited ones included; ``skips``: (class_name, dependency)
    pairs to leave out; ``scan_scope``: layers that stand for the whole scan and so say nothing
    about a dependency; ``skipped_file``: a condition on ``file``. Layers without an entry may
    depend on everything, and what has no layer is external and allowed.
    """
    rules = expanded(ruleset)
    own = nodes.select("class_name", "file", "line", "layer").where(F.col("layer").isin(*rules) if rules else F.lit(False))
    if skipped_file is not None:
        own = own.where(~skipped_file)
    if skips is not None:
        edges = edges.join(skips, ["class_name", "dependency"], "left_anti")
    known = last_by_key(nodes.select("class_name", "file", "line", "layer", "layers"))
    known = known.where(F.col("layer").isNotNull() & ~F.col("layer").isin(*scan_scope)).select(F.col("class_name").alias("__known"), F.col("layer").alias("__layer"), F.col("layers").alias("__layers"))
    rows = own.join(edges, "class_name").join(known, F.col("dependency") == F.col("__known"), "left")
    # what wasn't scanned, or only as part of everything, has the layers that its name tells
    rows = rows.withColumn("to_layers", F.coalesce("__layers", layers.all_by_pattern("dependency"))).withColumn("to_layer", F.coalesce("__layer", layers.by_pattern("dependency"), F.get("to_layers", F.lit(0))))
    rows = rows.where(F.size("to_layers") > 0)
    # the ruleset is configuration: a literal map
    allowed = F.lit(None).cast("array<string>")
    for layer, names in rules.items():
        allowed = F.when(F.col("layer") == layer, F.array(*(F.lit(n) for n in names)).cast("array<string>")).otherwise(allowed)
    same = (F.col("to_layer") == F.col("layer")) | F.array_contains("to_layers", F.col("layer"))
    rows = rows.where(~F.coalesce(same, F.lit(False)) & ~F.arrays_overlap("to_layers", allowed))
    text = said("Class [%s] in layer [%s] must not depend on [%s] which belongs to layer [%s]", F.col("class_name"), F.col("layer"), F.col("dependency"), F.col("to_layer"))
    found = report(rows, text)
    return found.withColumn("rule_key", F.concat(F.lit("ruleset."), F.col("layer"))).select(*columns())
