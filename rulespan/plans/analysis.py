"""A run: an architecture and facts become one plan of violations."""

from __future__ import annotations

import time
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rulespan import schemas
from rulespan.functions.names import is_absolute, told
from rulespan.operators import baseline as baselines
from rulespan.operators import ruleset as rulesets
from rulespan.operators.graph import inherited_dependencies, with_ancestors
from rulespan.operators.psr4 import mapped_paths
from rulespan.operators.skips import skipped
from rulespan.operators.usage import with_usage
from rulespan.plans.architecture import Architecture
from rulespan.rules.base import Facts, columns
from rulespan.sources.facts import with_defaults


def _empty(facts: Facts, ddl: str) -> DataFrame:
    return facts.spark.createDataFrame([], ddl)


def annotated(architecture: Architecture, facts: Facts) -> Facts:
    """``facts`` with layers, ancestors and the usage flags that active rules ask for."""
    mapped = [r.path for r in mapped_paths(facts.psr4).orderBy("ordinal").collect()] if facts.psr4 is not None else []
    prefix = f"{told(facts.base_path).rstrip('/')}/" if facts.base_path else ""
    layers = architecture.resolved_layers(mapped)
    if prefix:
        layers = replace(layers, paths={k: [told(p) if is_absolute(p) else prefix + p for p in v] for k, v in layers.paths.items()})
    nodes = with_defaults(facts.nodes)
    if layers.paths or layers.patterns:
        nodes = layers.assigned(nodes)
    if architecture.skip_paths:
        nodes = nodes.where(~skipped("file", architecture.skip_paths, facts.base_path))
    if architecture.needs():
        nodes = with_ancestors(nodes)
    else:
        nodes = nodes.withColumns({name: F.array().cast("array<string>") for name in ("parent_classes", "parent_interfaces")})
    anonymous = facts.anonymous if facts.anonymous is not None else _empty(facts, schemas.ANONYMOUS_CLASSES)
    references = facts.references if facts.references is not None else _empty(facts, schemas.FILE_REFERENCES)
    instantiations = facts.instantiations if facts.instantiations is not None else _empty(facts, schemas.FILE_INSTANTIATIONS)
    nodes = with_usage(nodes, anonymous, references, instantiations, architecture.needs())
    analyses = facts.analyses if facts.analyses is not None else _empty(facts, schemas.FILE_ANALYSES)
    if architecture.skip_paths:
        analyses = analyses.where(~skipped("file", architecture.skip_paths, facts.base_path))
    psr4 = facts.psr4 if facts.psr4 is not None else _empty(facts, "ordinal int, section string, namespace string, path string")
    directories = facts.directories if facts.directories is not None else _empty(facts, "path string")
    return replace(facts, nodes=nodes, anonymous=anonymous, references=references, instantiations=instantiations, analyses=analyses, psr4=psr4, directories=directories)


def violations(architecture: Architecture, facts: Facts, *, accepted: DataFrame | None = None) -> DataFrame:
    """All violations but those that the baseline accepts: a bag, in no order. ``facts`` needs no annotations."""
    facts = annotated(architecture, facts)
    parts = []
    for key, rule in architecture.active_rules().items():
        found = rule.violations(facts, key)
        if paths := architecture.rule_skip_paths.get(key):
            found = found.where((F.col("file") == "") | ~skipped("file", paths, facts.base_path))
        parts.append(found)
    if architecture.rulesets:
        pairs = architecture.class_skips
        parts.append(rulesets.violations(
            inherited_dependencies(facts.nodes), facts.nodes, architecture.resolved_layers(), architecture.rulesets,
            skips=facts.spark.createDataFrame(pairs, "class_name string, dependency string") if pairs else None, scan_scope=architecture.scan_scope(),
            skipped_file=skipped("file", architecture.ruleset_skip_paths, facts.base_path) if architecture.ruleset_skip_paths else None))
    out = reduce(DataFrame.unionByName, parts) if parts else _empty(facts, schemas.VIOLATIONS)
    out = out.select(*columns())
    return out if accepted is None else baselines.without_accepted(out, accepted, facts.base_path)


def first_of_class(found: DataFrame) -> DataFrame:
    """Of each rule and class the first violation, by line, then message."""
    key = F.struct("line", "message")
    return found.groupBy("rule_key", "class_name").agg(F.min_by(F.struct(*found.columns), key).alias("v")).select("v.*")


def counts(found: DataFrame) -> DataFrame:
    """Violations by rule and layer, with subtotals (an extension: null stands for all)."""
    return found.rollup("rule_key", "layer").agg(F.count("*").alias("n"), F.grouping_id().alias("level"))


@dataclass(frozen=True)
class Result:
    violations: list
    elapsed: float

    @property
    def passed(self) -> bool:
        return not self.violations

    @property
    def exit_code(self) -> int:
        return 0 if self.passed else 1


def run(architecture: Architecture, facts: Facts, *, accepted: DataFrame | None = None) -> Result:
    """Violations for a report, sorted. For large results use ``violations`` and write them."""
    began = time.perf_counter()
    rows = violations(architecture, facts, accepted=accepted).orderBy("file", "line", "rule_key", "message").collect()
    return Result(rows, time.perf_counter() - began)


def fix_plan(architecture: Architecture, found: DataFrame) -> DataFrame:
    """(file, action, class_name, member): what would mend the fixable violations; nothing is rewritten here."""
    actions = {k: r.fix_action() for k, r in architecture.rules.items() if r.fixable and r.fix_action()}
    action = F.lit(None).cast("string")
    for key, name in actions.items():
        action = F.when(F.col("rule_key") == key, F.lit(name)).otherwise(action)
    rows = found.where("fixable").withColumn("action", action).where("action is not null")
    return rows.select("file", "action", "class_name", F.coalesce("method_name", "constant_name", "property_name").alias("member")).distinct()
