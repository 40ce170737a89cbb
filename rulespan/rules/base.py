"""What all rules share: they turn facts into violations, as plans."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rulespan import schemas


@dataclass
class Facts:
    """A codebase's facts, all lazy. ``nodes`` has ancestors and flags as far as the active rules need them."""

    nodes: DataFrame
    anonymous: DataFrame | None = None
    references: DataFrame | None = None
    instantiations: DataFrame | None = None
    analyses: DataFrame | None = None
    #: (section, namespace, path) of the project's mapping, what its file's state is (found, missing, invalid), and its folder
    psr4: DataFrame | None = None
    composer_state: str = "missing"
    base_path: str = ""
    #: (path) of the project's folders
    directories: DataFrame | None = None

    @property
    def spark(self) -> SparkSession:
        return self.nodes.sparkSession


@dataclass(frozen=True)
class Rule:
    """Subclasses give ``found``; ``needs`` are the usage flags that it looks at, or ``ancestors``
    (``parent_classes`` and ``parent_interfaces``), ``fixable`` is whether a fix is planned. What no active
    rule needs isn't computed."""

    needs = frozenset()
    fixable = False
    #: class, file or project: what its violations are about, which tells how skipped paths apply
    scope = "class"

    def found(self, facts: Facts) -> DataFrame:
        raise NotImplementedError

    def violations(self, facts: Facts, key: str) -> DataFrame:
        return self.found(facts).withColumn("rule_key", F.lit(key)).select(*columns())

    def fix_action(self) -> str | None:
        return None


def columns() -> list[str]:
    return [part.split()[0] for part in schemas.VIOLATIONS.split(", ")]


def report(rows: DataFrame, message: Column, *, fixable: bool = False, line: Column | str = "line", file: Column | str = "file", class_name: Column | str = "class_name",
           layer: Column | str = "layer", method: Column | None = None, constant: Column | None = None, prop: Column | None = None) -> DataFrame:
    """Violations of these rows, but for the rule's key."""
    as_col = lambda c: F.col(c) if isinstance(c, str) else c
    text = lambda c: (F.lit(None) if c is None else c).cast("string")
    return rows.select(
        message.alias("message"), as_col(file).alias("file"), as_col(line).cast("int").alias("line"), as_col(class_name).alias("class_name"), as_col(layer).cast("string").alias("layer"),
        F.lit(fixable).alias("fixable"), text(method).alias("method_name"), text(constant).alias("constant_name"), text(prop).alias("property_name"))


def said(template: str, *values: Column | str | int) -> Column:
    """The message with each ``%s`` and ``%d`` replaced in turn; names are columns, other values are as given."""
    parts, rest = [], template
    for v in values:
        before, _, rest = rest.replace("%d", "%s").partition("%s")
        parts += [F.lit(before), v if isinstance(v, Column) else F.lit(str(v))]
    # a null in a name would null the message
    return F.concat(*(F.coalesce(p.cast("string"), F.lit("")) for p in [*parts, F.lit(rest)]))


def member_line() -> Column:
    """A member's line, or its class's where it has none."""
    return F.coalesce(F.nullif(F.col("m.line"), F.lit(0)), F.col("line"))


def members(nodes: DataFrame, items: str) -> DataFrame:
    return nodes.select("class_name", "file", "line", "layer", F.explode(items).alias("m"))
