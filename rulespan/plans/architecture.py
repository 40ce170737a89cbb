"""The description of an architecture: layers, rules, what they leave out, and presets."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence

from rulespan.functions.names import normalise
from rulespan.operators.layers import LayerPattern, Layers
from rulespan.rules.base import Rule


class UnknownRule(KeyError):
    """A rule key that doesn't exist."""


def _listed(x: str | Iterable[str] | None) -> list[str]:
    return [] if x is None else [x] if isinstance(x, str) else list(x)


class Architecture:
    """A fluent builder; every method returns the builder. Nothing is computed before a run."""

    def __init__(self) -> None:
        self.layers: dict[str, list[str]] = {}
        self.patterns: dict[str, LayerPattern] = {}
        self.rules: dict[str, Rule] = {}
        self.rulesets: dict[str, list[str]] = {}
        self.class_skips: list[tuple[str, str]] = []
        self.rule_skip_paths: dict[str, list[str]] = {}
        self.ruleset_skip_paths: list[str] = []
        self.baseline_path: str | None = None
        self.cache_path: str | None = None
        #: strings that are keys of rules if such rules exist when a run starts, and else paths
        self._skips: list[str] = []
        self._source_paths: dict[str, list[str] | None] = {}

    def layer(self, name: str, paths: str | Sequence[str] = ()) -> Architecture:
        """A layer of a path or several; without any, of everything that the project's mapping names."""
        self.layers[name] = _listed(paths)
        return self

    def layer_pattern(self, name: str, patterns: str | Sequence[str], excludes: str | Sequence[str] | None = None) -> Architecture:
        """A layer of the classes whose full names match a delimited pattern, and no excluding one."""
        self.patterns[name] = LayerPattern(tuple(_listed(patterns)), tuple(_listed(excludes)))
        return self

    def rule(self, key: str, rule: Rule) -> Architecture:
        """A rule by its key; a later one of the same key takes its place."""
        self.rules[key] = rule
        return self

    def remove_rule(self, key: str) -> Architecture:
        if key not in self.rules:
            raise UnknownRule(key)
        del self.rules[key]
        return self

    def ruleset(self, allowed: Mapping[str, Sequence[str]]) -> Architecture:
        """Which layers each layer may depend on; ``+X`` stands for X and all that X may depend on."""
        self.rulesets |= {k: list(v) for k, v in allowed.items()}
        return self

    def skip_class_violations(self, pairs: Mapping[str, str | Sequence[str]]) -> Architecture:
        """Dependencies of single classes that the ruleset leaves out."""
        self.class_skips += [(k, d) for k, v in pairs.items() for d in _listed(v)]
        return self

    def skip(self, entries: Iterable[str] | Mapping[str, str | Sequence[str]]) -> Architecture:
        """Rule keys or paths to skip everywhere; as a mapping, paths that single rules skip."""
        if isinstance(entries, Mapping):
            for key, paths in entries.items():
                self.rule_skip_paths.setdefault(key, []).extend(_listed(paths))
        else:
            self._skips += _listed(entries)
        return self

    def skip_rules(self, keys: str | Sequence[str]) -> Architecture:
        self._skips += _listed(keys)
        return self

    def skip_ruleset_paths(self, paths: str | Sequence[str]) -> Architecture:
        self.ruleset_skip_paths += _listed(paths)
        return self

    def baseline(self, path: str | None) -> Architecture:
        self.baseline_path = path
        return self

    def cache_directory(self, path: str | None) -> Architecture:
        self.cache_path = path
        return self

    def with_preset(self, *presets: Callable[[Architecture], None]) -> Architecture:
        for preset in presets:
            preset(self)
        return self

    def register_source_paths(self, preset: str, paths: Sequence[str] | None) -> list[str] | None:
        """A preset's paths so far: those of all its uses together; None, everything, absorbs the rest."""
        old = self._source_paths.get(preset, [])
        self._source_paths[preset] = None if paths is None or old is None else list(dict.fromkeys([*old, *paths]))
        return self._source_paths[preset]

    def source_layer(self, paths: Sequence[str] | None) -> str:
        """``Source``, or a name of its own where ``Source`` has other paths."""
        slashed = lambda items: sorted(normalise(p) + "/" for p in items)
        wanted = slashed(paths or [])
        return "Source" if "Source" not in self.layers or slashed(self.layers["Source"]) == wanted else f"Source[{','.join(wanted)}]"

    @property
    def skipped_rules(self) -> list[str]:
        return [s for s in dict.fromkeys(self._skips) if s in self.rules]

    @property
    def skip_paths(self) -> list[str]:
        return [s for s in dict.fromkeys(self._skips) if s not in self.rules]

    def active_rules(self) -> dict[str, Rule]:
        return {k: r for k, r in self.rules.items() if k not in set(self.skipped_rules)}

    def needs(self) -> set[str]:
        """Usage flags that the active rules look at."""
        return set().union(*(r.needs for r in self.active_rules().values())) if self.rules else set()

    def scan_scope(self) -> list[str]:
        """Layers that stand for the whole scan, as they have no paths of their own."""
        return [name for name, paths in self.layers.items() if not paths]

    def resolved_layers(self, mapped: Sequence[str] = ()) -> Layers:
        """Layers with paths; those without have the mapped ones."""
        return Layers({name: paths or list(mapped) for name, paths in self.layers.items()}, dict(self.patterns))

    def scan_paths(self, mapped: Sequence[str] = ()) -> list[str]:
        """Where a run looks when it isn't told: in the paths of all layers."""
        return list(dict.fromkeys(p for paths in self.resolved_layers(mapped).paths.values() for p in paths))
