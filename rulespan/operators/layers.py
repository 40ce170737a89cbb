"""Layers of names and paths: longest prefixes, patterns with excludes, and both in a chain.

Layer declarations are configuration, a few dozen; they become literals of the plan, so a layer
costs a scan's projection and no join. Where they are data, ``prefix_layers_join`` explodes each
path into its ancestors and joins by equality.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rulespan.functions.names import any_of, below, col, matches, normalise


@dataclass(frozen=True)
class LayerPattern:
    patterns: tuple[str, ...]
    excludes: tuple[str, ...] = ()

    def condition(self, name: Column | str) -> Column:
        return any_of(*(matches(name, p) for p in self.patterns)) & ~any_of(*(matches(name, p) for p in self.excludes))


@dataclass(frozen=True)
class Layers:
    """Declared layers in their order: paths (a file or a folder each) and patterns of full names."""

    paths: Mapping[str, Sequence[str]] = field(default_factory=dict)
    patterns: Mapping[str, LayerPattern] = field(default_factory=dict)

    def _declared(self) -> list[tuple[int, str, str]]:
        return [(i, layer, normalise(p)) for i, (layer, paths) in enumerate(self.paths.items()) for p in paths]

    def by_path(self, file: Column | str) -> Column:
        """The layer of the longest path that covers the file; of equally long ones the first declared."""
        out = F.lit(None).cast("string")
        # longest first, then the order of declaration: the first hit is the answer
        for _, layer, path in sorted(self._declared(), key=lambda x: (len(x[2]), -x[0])):
            out = F.when(below(file, path), F.lit(layer)).otherwise(out)
        return out

    def all_by_path(self, file: Column | str) -> Column:
        """All layers that cover the file, in the order of declaration."""
        found = {}
        for _, layer, path in self._declared():
            found.setdefault(layer, []).append(below(file, path))
        return _present([(layer, any_of(*hits)) for layer, hits in found.items()])

    def by_pattern(self, name: Column | str) -> Column:
        out = F.lit(None).cast("string")
        for layer, pattern in reversed(self.patterns.items()):
            out = F.when(pattern.condition(name), F.lit(layer)).otherwise(out)
        return out

    def all_by_pattern(self, name: Column | str) -> Column:
        return _present([(layer, pattern.condition(name)) for layer, pattern in self.patterns.items()])

    def primary(self, name: Column | str, file: Column | str) -> Column:
        """Patterns go before paths."""
        return F.coalesce(self.by_pattern(name), self.by_path(file))

    def all(self, name: Column | str, file: Column | str) -> Column:
        return F.array_distinct(F.concat(self.all_by_pattern(name), self.all_by_path(file)))

    def assigned(self, nodes: DataFrame, name: str = "class_name", file: str = "file") -> DataFrame:
        """``nodes`` with ``layer`` and ``layers``."""
        return nodes.withColumns({"layer": self.primary(name, file), "layers": self.all(name, file)})


def _present(hits: list[tuple[str, Column]]) -> Column:
    if not hits:
        return F.array().cast("array<string>")
    return F.filter(F.array(*(F.when(hit, F.lit(layer)) for layer, hit in hits)), lambda x: x.isNotNull())


def ancestors(path: Column | str) -> Column:
    """The path and all folders above it: ``a/b/c``, ``a/b``, ``a``."""
    parts = F.split(col(path), "/")
    every = F.transform(F.sequence(F.size(parts), F.lit(1), F.lit(-1)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    return F.filter(every, lambda x: x != "")


def prefix_layers_join(files: DataFrame, layer_paths: DataFrame, *, key: str, file: str) -> DataFrame:
    """(key, layer, layers) for layers that are data: (layer, ordinal, path). An equi-join on ancestors, so
    neither side must be small; files without a layer have no row."""
    hits = files.select(F.col(key), F.explode(ancestors(file)).alias("path")).join(layer_paths.select("layer", "ordinal", "path"), "path")
    best = F.max_by("layer", F.struct(F.length("path"), -F.col("ordinal"))).alias("layer")
    every = F.array_distinct(F.transform(F.array_sort(F.collect_set(F.struct("ordinal", "layer"))), lambda x: x["layer"])).alias("layers")
    return hits.groupBy(key).agg(best, every)
