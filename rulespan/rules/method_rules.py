"""Rules on methods."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rulespan.functions import predicates as P
from rulespan.functions.names import ascii_lower
from rulespan.rules.base import Facts, Rule, member_line, members, report, said

# The style, and hooks of the SOAP extension that are allowed to differ from it.
CAMEL_CASE = r"^[a-z][A-Za-z0-9]*\z"
SOAP_HOOKS = ("__dorequest", "__getcookies", "__getfunctions", "__getlastrequest", "__getlastrequestheaders", "__getlastresponse", "__getlastresponseheaders", "__gettypes",
              "__setcookie", "__setlocation", "__setsoapheaders", "__soapcall")


def _methods(facts: Facts, layer: str, pattern: str | None = None) -> DataFrame:
    return members(facts.nodes.where(P.in_layer(layer) & P.name_matches(pattern)), "methods")


@dataclass(frozen=True)
class MaxCyclomaticComplexity(Rule):
    layer: str
    most: int

    def found(self, facts: Facts) -> DataFrame:
        n = F.col("m.cyclomatic_complexity")
        text = said("Method [%s::%s()] has cyclomatic complexity of %d, maximum allowed is %d", F.col("class_name"), F.col("m.name"), n, self.most)
        return report(_methods(facts, self.layer).where(n > self.most), text, line=member_line())


@dataclass(frozen=True)
class MaxMethodLength(Rule):
    layer: str
    most: int

    def found(self, facts: Facts) -> DataFrame:
        n = F.col("m.line_count")
        text = said("Method [%s::%s()] is %d lines long, maximum allowed is %d", F.col("class_name"), F.col("m.name"), n, self.most)
        return report(_methods(facts, self.layer).where(n > self.most), text, line=member_line())


@dataclass(frozen=True)
class MethodNameMustBeCamelCase(Rule):
    layer: str

    def found(self, facts: Facts) -> DataFrame:
        rows = _methods(facts, self.layer).where(~F.col("m.is_magic") & ~ascii_lower("m.name").isin(*SOAP_HOOKS) & ~F.col("m.name").rlike(CAMEL_CASE))
        return report(rows, said("Method [%s::%s()] must be declared in camelCase", F.col("class_name"), F.col("m.name")), line=member_line())


@dataclass(frozen=True)
class MustHaveReturnType(Rule):
    layer: str
    pattern: str | None = None

    def found(self, facts: Facts) -> DataFrame:
        m = F.col("m")
        rows = _methods(facts, self.layer, self.pattern).where(P.is_public(m) & ~P.is_constructor(m) & ~P.is_destructor(m) & ~F.col("m.has_return_type"))
        return report(rows, said("Public method [%s::%s()] must declare a return type", F.col("class_name"), F.col("m.name")), line=member_line())
