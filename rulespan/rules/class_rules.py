"""Rules on classes, their members' names and visibility, and whether they are used."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rulespan.functions import predicates as P
from rulespan.functions.names import matches, short_name
from rulespan.rules.base import Facts, Rule, member_line, members, report, said

# The naming styles that rules ask for, and their messages.
STUDLY_CAPS = r"^[A-Z][A-Za-z0-9]*\z"
UPPER_CASE = r"^[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)*\z"
NAME = F.col


@dataclass(frozen=True)
class ClassConstantNameMustBeUpperCase(Rule):
    layer: str

    def found(self, facts: Facts) -> DataFrame:
        rows = members(facts.nodes.where(P.in_layer(self.layer)), "constants").where(~F.col("m.name").rlike(UPPER_CASE))
        text = said("Class constant [%s::%s] must be declared in upper case with underscore separators", NAME("class_name"), NAME("m.name"))
        return report(rows, text, line=member_line())


@dataclass(frozen=True)
class ClassImplementingInterfaceMustHaveSuffix(Rule):
    layer: str
    interface: str
    suffix: str
    needs = frozenset({"ancestors"})

    def found(self, facts: Facts) -> DataFrame:
        rows = facts.nodes.where(P.is_class() & P.in_layer(self.layer) & P.implements_interface(self.interface) & ~short_name().endswith(self.suffix))
        return report(rows, said("Class [%s] implementing interface [%s] must have suffix [%s]", NAME("class_name"), self.interface, self.suffix))


@dataclass(frozen=True)
class ClassNameMustBeStudlyCaps(Rule):
    layer: str

    def found(self, facts: Facts) -> DataFrame:
        return report(facts.nodes.where(P.in_layer(self.layer) & ~short_name().rlike(STUDLY_CAPS)), said("Class [%s] must be declared in StudlyCaps", NAME("class_name")))


@dataclass(frozen=True)
class ClassNameMustHaveSuffix(Rule):
    layer: str
    suffix: str

    def found(self, facts: Facts) -> DataFrame:
        return report(facts.nodes.where(P.in_layer(self.layer) & ~short_name().endswith(self.suffix)), said("Class [%s] must have suffix [%s]", NAME("class_name"), self.suffix))


@dataclass(frozen=True)
class ClassNameMustNotHavePrefix(Rule):
    layer: str
    prefix: str

    def found(self, facts: Facts) -> DataFrame:
        return report(facts.nodes.where(P.in_layer(self.layer) & short_name().startswith(self.prefix)), said("Class [%s] must not have prefix [%s]", NAME("class_name"), self.prefix))


@dataclass(frozen=True)
class ExtendedClassMustBeAbstractOrInstantiated(Rule):
    layer: str
    pattern: str | None = None
    needs = frozenset({"is_extended", "is_instantiated"})
    fixable = True

    def found(self, facts: Facts) -> DataFrame:
        rows = facts.nodes.where(P.is_class() & ~F.col("is_abstract") & P.in_layer(self.layer) & P.name_matches(self.pattern) & F.col("is_extended") & ~F.col("is_instantiated"))
        # a final class can't be made abstract
        return report(rows, said("Extended class [%s] must be declared abstract or instantiated", NAME("class_name")), fixable=True)

    def fix_action(self) -> str:
        return "add_abstract"


@dataclass(frozen=True)
class MaxDependencyCount(Rule):
    layer: str
    most: int

    def found(self, facts: Facts) -> DataFrame:
        n = P.constructor_parameters()
        rows = facts.nodes.where(P.in_layer(self.layer) & ~F.col("is_interface") & (n > self.most))
        return report(rows, said("Class [%s] has %d constructor dependencies, maximum allowed is %d", NAME("class_name"), n, self.most))


@dataclass(frozen=True)
class MayNotImplementInterface(Rule):
    layer: str
    interface: str
    needs = frozenset({"ancestors"})

    def found(self, facts: Facts) -> DataFrame:
        return report(facts.nodes.where(P.in_layer(self.layer) & P.implements_interface(self.interface)), said("Class [%s] must not implement interface [%s]", NAME("class_name"), self.interface))


@dataclass(frozen=True)
class MustBeFinal(Rule):
    layer: str
    pattern: str | None = None
    needs = frozenset({"is_extended"})
    fixable = True

    def found(self, facts: Facts) -> DataFrame:
        rows = facts.nodes.where(P.is_class() & ~F.col("is_abstract") & P.in_layer(self.layer) & P.name_matches(self.pattern) & ~F.col("is_final") & ~F.col("is_extended"))
        return report(rows, said("Class [%s] must be declared final", NAME("class_name")), fixable=True)

    def fix_action(self) -> str:
        return "add_final"


@dataclass(frozen=True)
class MustBeInterface(Rule):
    layer: str
    pattern: str | None = None

    def found(self, facts: Facts) -> DataFrame:
        return report(facts.nodes.where(P.in_layer(self.layer) & P.name_matches(self.pattern) & ~F.col("is_interface")), said("Class [%s] must be an interface", NAME("class_name")))


@dataclass(frozen=True)
class _Unused(Rule):
    layer: str
    pattern: str | None = None
    fixable = True

    def kind(self):
        raise NotImplementedError

    def text(self) -> str:
        raise NotImplementedError

    def found(self, facts: Facts) -> DataFrame:
        used = F.lit(False)
        for flag in sorted(self.needs - {"is_instantiated"}):
            used = used | F.col(flag)
        return report(facts.nodes.where(self.kind() & P.in_layer(self.layer) & P.name_matches(self.pattern) & ~used), said(self.text(), NAME("class_name")), fixable=True)

    def fix_action(self) -> str:
        return "remove_class"


@dataclass(frozen=True)
class MustBeUsedAbstractClass(_Unused):
    needs = frozenset({"is_extended", "is_referenced"})

    def kind(self):
        return P.is_class() & F.col("is_abstract")

    def text(self) -> str:
        return "Abstract class [%s] must be extended by a class or referenced as a dependency"


@dataclass(frozen=True)
class MustBeUsedInterface(_Unused):
    needs = frozenset({"is_implemented", "is_referenced"})

    def kind(self):
        return F.col("is_interface")

    def text(self) -> str:
        return "Interface [%s] must be implemented by a class, extended by another interface, or referenced as a dependency"


@dataclass(frozen=True)
class MustBeUsedTrait(_Unused):
    needs = frozenset({"is_referenced"})

    def kind(self):
        return F.col("is_trait")

    def text(self) -> str:
        return "Trait [%s] must be used by a class, trait, or enum, or referenced as a dependency"


@dataclass(frozen=True)
class MustDeclareConstantVisibility(Rule):
    layer: str
    fixable = True

    def found(self, facts: Facts) -> DataFrame:
        rows = members(facts.nodes.where(P.in_layer(self.layer)), "constants").where(~F.col("m.has_explicit_visibility"))
        text = said("Constant [%s::%s] must declare an explicit visibility (public, protected, or private)", NAME("class_name"), NAME("m.name"))
        return report(rows, text, line=member_line(), fixable=True, constant=NAME("m.name"))

    def fix_action(self) -> str:
        return "add_public_constant"


@dataclass(frozen=True)
class MustDeclareMethodVisibility(Rule):
    layer: str
    fixable = True

    def found(self, facts: Facts) -> DataFrame:
        rows = members(facts.nodes.where(P.in_layer(self.layer)), "methods").where(~F.col("m.has_explicit_visibility"))
        text = said("Method [%s::%s()] must declare an explicit visibility (public, protected, or private)", NAME("class_name"), NAME("m.name"))
        return report(rows, text, line=member_line(), fixable=True, method=NAME("m.name"))

    def fix_action(self) -> str:
        return "add_public_method"


@dataclass(frozen=True)
class MustDeclarePropertyVisibility(Rule):
    layer: str
    fixable = True

    def found(self, facts: Facts) -> DataFrame:
        rows = members(facts.nodes.where(P.in_layer(self.layer)), "properties").where(~F.col("m.has_explicit_visibility"))
        text = said("Property [%s::$%s] must declare an explicit visibility (public, protected, or private)", NAME("class_name"), NAME("m.name"))
        return report(rows, text, line=member_line(), fixable=True, prop=NAME("m.name"))

    def fix_action(self) -> str:
        return "add_public_property"


@dataclass(frozen=True)
class MustImplementInterface(Rule):
    layer: str
    interface: str
    pattern: str | None = None
    needs = frozenset({"ancestors"})

    def found(self, facts: Facts) -> DataFrame:
        rows = facts.nodes.where(P.is_class() & P.in_layer(self.layer) & P.name_matches(self.pattern) & ~P.implements_interface(self.interface))
        return report(rows, said("Class [%s] must implement interface [%s]", NAME("class_name"), self.interface))


@dataclass(frozen=True)
class NamingConvention(Rule):
    pattern: str
    must_be_in: str
    exclude_interfaces: bool = False
    exclude: str | None = None

    def found(self, facts: Facts) -> DataFrame:
        applies = matches("class_name", self.pattern)
        if self.exclude_interfaces:
            applies = applies & ~F.col("is_interface")
        if self.exclude is not None:
            applies = applies & ~matches("class_name", self.exclude)
        text = said("Class [%s] matching pattern [%s] must live in layer [%s], found in layer [%s]", NAME("class_name"), self.pattern, self.must_be_in, F.coalesce("layer", F.lit("unknown")))
        return report(facts.nodes.where(applies & ~P.in_layer(self.must_be_in)), text)
