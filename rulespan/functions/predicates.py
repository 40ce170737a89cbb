"""Predicates on a row of class facts, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rulespan.functions.names import ascii_lower, has_item, matches, short_name, uses_namespace

#: Constructs that are one and the same.
_SAME = {"exit": ("exit", "die"), "die": ("exit", "die")}


def in_layer(layer: str) -> Column:
    return has_item("layers", layer)


def is_class() -> Column:
    return ~(F.col("is_interface") | F.col("is_trait") | F.col("is_enum"))


def name_matches(pattern: str | None, *, full: bool = True) -> Column:
    """Without a pattern, everything matches."""
    return F.lit(True) if pattern is None else matches("class_name" if full else short_name(), pattern)


def depends_on(name: str) -> Column:
    return has_item("dependencies", name)


def depends_on_namespace(namespace: str) -> Column:
    return uses_namespace("dependencies", namespace)


def _either(*lists: str, name: str) -> Column:
    out = F.lit(False)
    for x in lists:
        out = out | has_item(x, name, fold=True)
    return out


def implements_interface(name: str) -> Column:
    """Directly or through ancestors."""
    return _either("implements", "parent_interfaces", name=name)


def extends_class(name: str) -> Column:
    own = F.coalesce(ascii_lower("extends") == ascii_lower(F.lit(name)), F.lit(False))
    return own | _either("parent_classes", name=name)


def extends_interface(name: str) -> Column:
    return _either("interface_extends", "parent_interfaces", name=name)


def calls_function(name: str) -> Column:
    return has_item("function_calls", name.lstrip("\\"), fold=True)


def uses_construct(name: str) -> Column:
    same = F.array(*(F.lit(x) for x in _SAME.get(name, (name,))))
    return F.coalesce(F.arrays_overlap("language_constructs", same), F.lit(False))


def accesses_superglobals() -> Column:
    return F.coalesce(F.size("superglobals") > 0, F.lit(False))


def constructor_parameters() -> Column:
    """The first constructor's parameters, or 0."""
    own = F.filter("methods", lambda m: ascii_lower(m["name"]) == "__construct")
    return F.coalesce(F.get(own, 0)["param_count"], F.lit(0))


def is_public(m: Column) -> Column:
    return m["visibility"] == "public"


def is_constructor(m: Column) -> Column:
    return ascii_lower(m["name"]) == "__construct"


def is_destructor(m: Column) -> Column:
    return ascii_lower(m["name"]) == "__destruct"
