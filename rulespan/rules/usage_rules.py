"""Rules on what a class uses."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rulespan.functions import predicates as P
from rulespan.functions.names import normalise
from rulespan.operators.graph import last_by_key
from rulespan.rules.base import Facts, Rule, report, said


@dataclass(frozen=True)
class MayNotCallFunction(Rule):
    layer: str
    function: str

    def found(self, facts: Facts) -> DataFrame:
        return report(facts.nodes.where(P.in_layer(self.layer) & P.calls_function(self.function)), said("Class [%s] must not call function [%s()]", F.col("class_name"), self.function))


@dataclass(frozen=True)
class MayNotUseClass(Rule):
    layer: str
    forbidden: str
    pattern: str | None = None

    def found(self, facts: Facts) -> DataFrame:
        rows = facts.nodes.where(P.in_layer(self.layer) & P.name_matches(self.pattern) & P.depends_on(self.forbidden))
        return report(rows, said("Class [%s] must not use [%s]", F.col("class_name"), self.forbidden))


@dataclass(frozen=True)
class MayNotUseLanguageConstruct(Rule):
    layer: str
    construct: str

    def found(self, facts: Facts) -> DataFrame:
        rows = facts.nodes.where(P.in_layer(self.layer) & P.uses_construct(self.construct))
        return report(rows, said("Class [%s] must not use language construct [%s]", F.col("class_name"), self.construct))


@dataclass(frozen=True)
class MayNotUseNamespace(Rule):
    layer: str
    namespace: str
    pattern: str | None = None

    def found(self, facts: Facts) -> DataFrame:
        rows = facts.nodes.where(P.in_layer(self.layer) & P.name_matches(self.pattern) & P.depends_on_namespace(self.namespace))
        return report(rows, said("Class [%s] must not use namespace [%s]", F.col("class_name"), self.namespace))


@dataclass(frozen=True)
class MayNotUseSuperglobals(Rule):
    layer: str

    def found(self, facts: Facts) -> DataFrame:
        rows = facts.nodes.where(P.in_layer(self.layer) & P.accesses_superglobals())
        return report(rows, said("Class [%s] must not access superglobals directly (%s)", F.col("class_name"), F.array_join("superglobals", ", ")))


@dataclass(frozen=True)
class MayNotDependOn(Rule):
    """Direct dependencies on another layer: of scanned classes by their layers, of others by their names."""

    source: str
    target: str
    target_path: str | None = None

    def found(self, facts: Facts) -> DataFrame:
        known = last_by_key(facts.nodes.select("class_name", "file", "line", "layers")).select(F.col("class_name").alias("__known"), F.col("layers").alias("__layers"))
        edges = facts.nodes.where(P.in_layer(self.source)).select("class_name", "file", "line", "layer", F.explode("dependencies").alias("dependency"))
        path = F.concat(F.regexp_replace(F.translate("dependency", "\\", "/"), "/+", "/"), F.lit("/"))
        part = normalise(self.target_path if self.target_path is not None else self.target)
        by_name = F.contains(path, F.lit(f"/{part}/")) | path.startswith(f"{part}/")
        hit = F.when(F.size("__layers") > 0, F.array_contains("__layers", self.target)).otherwise(by_name)
        rows = edges.join(known, F.col("dependency") == F.col("__known"), "left").where(hit)
        text = said("Class [%s] in layer [%s] must not depend on [%s] which belongs to layer [%s]", F.col("class_name"), self.source, F.col("dependency"), self.target)
        return report(rows, text)
