"""Rules on the project's namespace mapping and on files."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rulespan import schemas
from rulespan.functions import predicates as P
from rulespan.functions.names import any_of, below, told
from rulespan.operators.psr4 import expected_names, mapped_paths
from rulespan.rules.base import Facts, Rule, columns, report, said

NOT_FOUND, NOT_VALID = "composer.json was not found", "composer.json is not valid JSON"


@dataclass(frozen=True)
class _MappingRule(Rule):
    scope = "project"

    def state(self, facts: Facts) -> DataFrame | None:
        """What there is to say where there is no mapping to look at."""
        text = {"missing": NOT_FOUND, "invalid": NOT_VALID}.get(facts.composer_state)
        return None if text is None else self.told(facts, facts.spark.range(1), F.lit(text))

    def told(self, facts: Facts, rows: DataFrame, message) -> DataFrame:
        return report(rows, message, line=F.lit(1), file=F.lit(f"{told(facts.base_path).rstrip('/')}/composer.json"), class_name=F.lit(""), layer=F.lit("Source"), fixable=self.fixable)

    def nothing(self, facts: Facts) -> DataFrame:
        return facts.spark.createDataFrame([], schemas.VIOLATIONS).select(*(c for c in columns() if c != "rule_key"))


@dataclass(frozen=True)
class Psr4DirectoryExists(_MappingRule):
    fixable = True

    def found(self, facts: Facts) -> DataFrame:
        if (out := self.state(facts)) is not None:
            return out
        paths = mapped_paths(facts.psr4)
        missing = paths.join(facts.directories.select("path").distinct(), "path", "left_anti")
        joined = missing.agg(F.sort_array(F.collect_list(F.struct("ordinal", "path"))).alias("all")).where(F.size("all") > 0)
        text = F.array_join(F.transform("all", lambda x: x["path"]), ", ")
        return self.told(facts, joined, said("PSR-4 source path(s) [%s] declared in composer.json do not exist on disk", text))

    def fix_action(self) -> str:
        return "remove_mapping"


@dataclass(frozen=True)
class Psr4EmptyNamespacePrefix(_MappingRule):
    def found(self, facts: Facts) -> DataFrame:
        if facts.composer_state != "found":
            return self.nothing(facts)
        rows = facts.psr4.where(F.regexp_replace("namespace", r"\\", "") == "").select("section", "namespace").distinct()
        return self.told(facts, rows, said('PSR-4 entry ["%s"] in %s has an empty namespace prefix; declare a specific namespace prefix such as "App\\\\"', F.col("namespace"), F.col("section")))


@dataclass(frozen=True)
class Psr4RootPath(_MappingRule):
    def found(self, facts: Facts) -> DataFrame:
        if facts.composer_state != "found":
            return self.nothing(facts)
        trimmed = F.regexp_replace("path", r"^[ \t\n\r\x00\x0B]+|[ \t\n\r\x00\x0B]+\z", "")
        rows = facts.psr4.where((trimmed == "") | (F.regexp_replace(trimmed, r"[/\\]+\z", "") == "."))
        return self.told(facts, rows, said('PSR-4 entry ["%s"] => ["%s"] in %s maps to the project root; declare a specific directory instead', F.col("namespace"), F.col("path"), F.col("section")))


@dataclass(frozen=True)
class Psr4SourcePaths(_MappingRule):
    paths: Sequence[str] | None = None

    def found(self, facts: Facts) -> DataFrame:
        if (out := self.state(facts)) is not None:
            return out
        if self.paths is None:
            return self.nothing(facts)
        base = told(facts.base_path)
        wanted = [told(p.strip()) for p in self.paths]
        wanted = [p[len(base) + 1 :] if base and p.startswith(base + "/") else p for p in wanted]
        rows = facts.spark.createDataFrame([(i, p) for i, p in enumerate(wanted)], "ordinal int, path string").join(mapped_paths(facts.psr4).select("path"), "path", "left_anti")
        joined = rows.agg(F.sort_array(F.collect_list(F.struct("ordinal", "path"))).alias("all")).where(F.size("all") > 0)
        text = F.array_join(F.transform("all", lambda x: x["path"]), ", ")
        return self.told(facts, joined, said("PSR-4 source path(s) [%s] must exist in composer.json autoload or autoload-dev", text))


@dataclass(frozen=True)
class Psr4Namespace(Rule):
    layer: str

    def found(self, facts: Facts) -> DataFrame:
        if facts.composer_state != "found":
            return report(facts.nodes.where(F.lit(False)), F.lit(""))
        rows = facts.nodes.where(P.in_layer(self.layer)).select("class_name", "file", "line", "layer")
        rows = expected_names(rows, facts.psr4, facts.base_path).where((F.size("candidates") > 0) & ~F.array_contains("candidates", F.col("class_name")))
        return report(rows, said("Class [%s] must match PSR-4 class [%s]", F.col("class_name"), F.get("candidates", F.lit(0))))


@dataclass(frozen=True)
class _FileRule(Rule):
    """One violation for each file; without paths, of all analysed files."""

    paths: Sequence[str] | None = None
    scope = "file"

    def told(self, facts: Facts, condition, template: str, line=None) -> DataFrame:
        rows = facts.analyses.where(condition)
        if self.paths is not None:
            rows = rows.where(any_of(*(below("file", told(p)) for p in self.paths)))
        return report(rows, said(template, F.col("file")), line=F.lit(1) if line is None else line, class_name=F.lit(""), layer=F.lit(None), fixable=self.fixable)


@dataclass(frozen=True)
class Psr1PhpTags(_FileRule):
    fixable = True

    def found(self, facts: Facts) -> DataFrame:
        return self.told(facts, F.col("invalid_php_tag_line").isNotNull(), "File [%s] must use only <?php and <?= PHP tags", F.col("invalid_php_tag_line"))

    def fix_action(self) -> str:
        return "normalise_tags"


@dataclass(frozen=True)
class Psr1SymbolsOrSideEffects(_FileRule):
    def found(self, facts: Facts) -> DataFrame:
        both = F.col("has_valid_ast") & F.col("declares_symbols") & F.col("has_side_effects")
        return self.told(facts, both, "File [%s] should either declare symbols or cause side effects, not both", F.col("side_effect_line"))


@dataclass(frozen=True)
class Psr1Utf8WithoutBom(_FileRule):
    fixable = True

    def found(self, facts: Facts) -> DataFrame:
        return self.told(facts, F.col("has_utf8_bom"), "File [%s] must use UTF-8 without BOM")

    def fix_action(self) -> str:
        return "strip_bom"


@dataclass(frozen=True)
class Psr1ValidUtf8(_FileRule):
    def found(self, facts: Facts) -> DataFrame:
        return self.told(facts, ~F.col("has_valid_utf8"), "File [%s] must use valid UTF-8 encoding")
