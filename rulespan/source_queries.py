"""Queries over PHP sources: parts are files, whose text is made from their row, so that SQL can tell what
the extractor, the file rules and the fixes must find in it."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rulespan import cli, rules as R
from rulespan.functions import predicates as P
from rulespan.operators import baseline, graph, incremental, psr4
from rulespan.operators.graph import shared_folder
from rulespan.plans import analysis, fixes, presets, report
from rulespan.plans.architecture import Architecture
from rulespan.queries import REGIONS, _EDGES, _PAGE_FILE, _PARTIES, _PART_RUN, _RULESET_SQL, _TALK, _as_nodes, _flagship, _pages, _part_run, _t, _told, _turns, query
from rulespan.rules.base import Facts
from rulespan.sources import composer, scan
from rulespan.sources.facts import FactStore
from rulespan.sources.php_facts import extract
from rulespan.sources.results import ResultCache, content_key

# --- sources from rows ---

#: What templates may name: the part's key, size, brand's number and type.
_P = "p AS (SELECT CAST(p_partkey AS VARCHAR) AS k, CAST(p_size AS VARCHAR) AS s, replace(p_brand, 'Brand#', '') AS b, p_type AS t, p_partkey AS kn, p_size AS sn, 'src/' || p_type || '/C' || p_partkey || '.php' AS file FROM part)"


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "part").select(
        F.col("p_partkey").cast("string").alias("k"), F.col("p_size").cast("string").alias("s"), F.replace("p_brand", F.lit("Brand#"), F.lit("")).alias("b"), F.col("p_type").alias("t"), F.col("p_partkey").alias("kn"),
        F.col("p_size").alias("sn"), F.concat(F.lit("src/"), "p_type", F.lit("/C"), "p_partkey", F.lit(".php")).alias("file"))


def _text(template: str, **pieces: Column) -> Column:
    """A text in which ``<k>`` stands for the column k, or for one of ``pieces``."""
    out, rest = [], template
    while "<" in rest and (start := next((i for i, c in enumerate(rest) if c == "<" and rest[i + 1 : i + 2].isalpha() and rest[i + 1 :].split(">")[0] in {"k", "s", "b", "t", *pieces}), -1)) >= 0:
        name = rest[start + 1 :].split(">")[0]
        out += [F.lit(rest[:start]), pieces.get(name, F.col(name))]
        rest = rest[start + len(name) + 2 :]
    return F.concat(*out, F.lit(rest))


def _when(condition: str, template: str) -> Column:
    return F.when(F.expr(condition), _text(template)).otherwise("")


def _sources(spark: SparkSession, sf_dir: str, code: Column) -> DataFrame:
    """(file, content): a file for each part."""
    return _parts(spark, sf_dir).select("file", code.cast("binary").alias("content"))


def _list(name: str) -> Column:
    return F.array_join(name, ",").alias(name)


def _extracted(spark: SparkSession, sf_dir: str, table: str, code: Column) -> DataFrame:
    return extract(_sources(spark, sf_dir, code), only=[table])[table]


# --- the extractor ---


@query(rf"""WITH {_P} SELECT 'App\First' || k AS class_name, 'Lib\Tool' || b || ',Lib\Deep\Other' || s || ',Lib\f' || b || ',Lib\C' || s AS dependencies FROM p
  UNION ALL SELECT 'App\Second' || k, 'Lib\Tool' || b || ',Lib\Deep\Other' || s || ',Lib\f' || b || ',Lib\C' || s || ',Late\Import' || k FROM p UNION ALL SELECT 'Other\Third' || k, '' FROM p""")
def php_imports(spark, sf_dir):
    code = _text("<?php\nnamespace App;\nuse Lib\\{Tool<b>, Deep\\Other<s> as O};\nuse function Lib\\f<b>;\nuse const Lib\\C<s>;\nclass First<k> {}\nuse Late\\Import<k>;\nclass Second<k> {}\nnamespace Other;\nclass Third<k> {}\n")
    return _extracted(spark, sf_dir, "nodes", code).select("class_name", _list("dependencies"))


@query(rf"""WITH {_P} SELECT 'App\C' || k AS class_name, 'App\Base' || b || ',Countable,App\Shape' || s || ',App\Mixed' || s || ',App\Model' || b || ',App\Arg' || s || ',App\Result' || k || ',App\Made' || k || ',App\Bad' || b || ',Worse'
    || CASE WHEN sn % 2 = 1 THEN ',App\Check' || k ELSE '' END AS dependencies, 'App\Base' || b AS extends, 'Countable,App\Shape' || s AS implements, 'App\Mixed' || s AS traits FROM p""")
def php_dependencies(spark, sf_dir):
    code = _text("<?php namespace App;\nclass C<k> extends Base<b> implements \\Countable, Shape<s> {\n use Mixed<s>;\n private ?Model<b> $m = null;\n"
                 " function go(Arg<s> $a): Result<k> { try { return new Made<k>(true, null); } catch (Bad<b> | \\Worse $e) { <check> } }\n}", check=_when("sn % 2 = 1", "if ($a instanceof Check<k>) { throw $e; }"))
    return _extracted(spark, sf_dir, "nodes", code).select("class_name", _list("dependencies"), "extends", _list("implements"), _list("traits"))


@query(rf"""WITH {_P} SELECT file, 'N' || b || '\Z' || k || ',g' || s || ',App\Thing' || k || ',In\Name' || s AS "references" FROM p""")
def php_references(spark, sf_dir):
    code = _text("<?php namespace N<b>; use X\\Y; $a = new Z<k>; \\g<s>(); $s = '\\App\\Thing<k>'; $t = \"not a name!\"; $u = 'true'; class K<k> { const S = 'In\\Name<s>'; }")
    return _extracted(spark, sf_dir, "references", code).select("file", _list("references"))


@query(rf"""WITH {_P} SELECT 'C' || k AS class_name, CAST(1 + sn % 4 + 2 * (sn % 3) + kn % 2 + CASE WHEN kn % 5 = 0 THEN 4 ELSE 0 END + CASE WHEN kn % 7 = 0 THEN 3 ELSE 0 END + CASE WHEN kn % 3 = 0 THEN 1 ELSE 0 END AS INTEGER) AS complexity,
    kn % 5 = 0 AS arms FROM p""")
def php_complexity(spark, sf_dir):
    # branches in closures and anonymous classes count for the method around them; ?? and ?-> and xor don't count
    code = _text(
        "<?php class C<k> { function m($a, $b) { <ifs> <loops> <choice> <arms> <closure> <inner> return $a ?? $b?->c xor $a; } }",
        ifs=F.expr("repeat('if ($a) { } ', CAST(sn % 4 AS INT))"), loops=F.expr("repeat('while ($a && $b) { } ', CAST(sn % 3 AS INT))"), choice=_when("kn % 2 = 1", "$c = $a ? 1 : 2;"),
        arms=_when("kn % 5 = 0", "$d = match ($a) { 1, 2 => 3, 4 => 5, default => 6 }; do { } while ($b);"), closure=_when("kn % 7 = 0", "$f = function ($x) { if ($x) { } elseif ($x or $y) { } };"),
        inner=_when("kn % 3 = 0", "$g = new class { function n($z) { foreach ($z as $q) { } } };"))
    nodes = _extracted(spark, sf_dir, "nodes", code)
    return nodes.select("class_name", F.inline("methods")).select("class_name", F.col("cyclomatic_complexity").alias("complexity"), (F.regexp_extract("class_name", r"(\d+)", 1).cast("long") % 5 == 0).alias("arms"))


@query(rf"""WITH {_P} SELECT 'App' || b || '\C' || k AS class_name, 'App' || b || '\own' || k || ',other' || s || ',Full\f' || b AS function_calls,
    concat_ws(',', CASE WHEN kn % 2 = 0 THEN '$_GET' END, CASE WHEN sn % 2 = 0 THEN '$_POST' END, CASE WHEN kn % 5 = 0 THEN '$GLOBALS' END) AS superglobals,
    concat_ws(',', CASE WHEN kn % 2 = 0 THEN 'echo' END, CASE WHEN kn % 3 = 0 THEN 'exit' END, CASE WHEN sn % 2 = 0 THEN 'isset,print' END, 'list') AS language_constructs FROM p""")
def php_uses(spark, sf_dir):
    code = _text("<?php namespace App<b>; function own<k>() {} class C<k> { function m() { own<k>(); other<s>(); \\Full\\f<b>(); $this->method(); <echo> <exit> <isset> <globals> list($q) = [1]; } }",
                 echo=_when("kn % 2 = 0", "echo $_GET['x'], $_GET['y'];"), exit=_when("kn % 3 = 0", "exit(1);"), isset=_when("sn % 2 = 0", "isset($a) && print $_POST['y'];"), globals=_when("kn % 5 = 0", "$GLOBALS['z'] = 1;"))
    return _extracted(spark, sf_dir, "nodes", code).select("class_name", _list("function_calls"), _list("superglobals"), _list("language_constructs"))


_CREATES = (r"<?php namespace N<b>;" "\n" r"class A<k> extends P<s> { function m() { new B<k>; new self; new static; new parent; new ('C' . 'D<k>'); new (E<s>::class); new $dynamic; (new \ReflectionClass(F<k>::class))->newInstanceArgs([]); } }" "\n"
            r"trait T<k> { function m() { new self; new parent; new static; } }" "\n" r"$o = new class(1) extends Q<k> implements R<s>, \S { use T<k>; function m() { new parent; new self; } };")


@query(rf"""WITH {_P}, n AS (SELECT *, 'N' || b || '\' AS n FROM p)
  SELECT file, NULL AS keyword, unnest([n || 'B' || k, n || 'A' || k, n || 'P' || s, 'CD' || k, n || 'E' || s, 'ReflectionClass', n || 'F' || k, n || 'Q' || k]) AS class_name FROM n
  UNION ALL SELECT file, 'static', n || 'A' || k FROM n UNION ALL SELECT file, unnest(['self', 'parent', 'static']), n || 'T' || k FROM n""")
def php_instantiations(spark, sf_dir):
    return _extracted(spark, sf_dir, "instantiations", _text(_CREATES)).select("file", F.inline("targets"))


@query(rf"""WITH {_P} SELECT file, CAST(4 AS INTEGER) AS line, 'N' || b || '\Q' || k AS extends, 'N' || b || '\R' || s || ',S' AS implements, 'N' || b || '\T' || k AS traits FROM p""")
def php_anonymous_classes(spark, sf_dir):
    return _extracted(spark, sf_dir, "anonymous", _text(_CREATES)).select("file", "line", "extends", _list("implements"), _list("traits"))


@query(rf"""WITH {_P}, m AS (SELECT *, CASE kn % 4 WHEN 0 THEN 'public' WHEN 1 THEN 'protected' WHEN 2 THEN 'private' END AS v FROM p)
  SELECT 'C' || k AS class_name, CASE WHEN kn % 7 = 0 THEN '__toString' ELSE 'm' || s END AS name, coalesce(v, 'public') AS visibility, v IS NOT NULL AS has_explicit_visibility, sn % 2 = 0 AS is_static, kn % 3 = 0 AS has_return_type,
    CAST(sn % 4 AS INTEGER) AS param_count, CAST(sn % 6 AS INTEGER) AS line_count, CAST(3 + kn % 5 AS INTEGER) AS line, kn % 7 = 0 AS is_magic FROM m
  UNION ALL SELECT 'C' || k, 'nothing', 'protected', true, false, false, 0, 0, CAST(2 AS INTEGER), false FROM p""")
def php_methods(spark, sf_dir):
    visibility = F.expr("CASE kn % 4 WHEN 0 THEN 'public ' WHEN 1 THEN 'protected ' WHEN 2 THEN 'private ' ELSE '' END")
    code = _text("<?php abstract class C<k> {\n abstract protected function nothing();\n<gap><visibility><static>function <name>(<params>)<type> {\n\n<body>\n\n}\n}", gap=F.expr("repeat('\\n', CAST(kn % 5 AS INT))"), visibility=visibility,
                 static=_when("sn % 2 = 0", "static "), name=F.expr("CASE WHEN kn % 7 = 0 THEN '__toString' ELSE concat('m', s) END"), params=F.expr("array_join(transform(slice(array('$a', 'int $b = 1', '?X &$c', '$d'), 1, CAST(sn % 4 AS INT)), x -> x), ', ')"),
                 type=_when("kn % 3 = 0", ": int"), body=F.expr("concat(repeat('$x = [\\n', CAST(sn % 6 > 1 AS INT)), repeat('1,\\n', CAST(greatest(sn % 6 - 2, 0) AS INT)), repeat(CASE WHEN sn % 6 = 1 THEN '$x = 1;' ELSE '];' END, CAST(sn % 6 > 0 AS INT)))"))
    rows = _extracted(spark, sf_dir, "nodes", code).select("class_name", F.inline("methods"))
    return rows.select("class_name", "name", "visibility", "has_explicit_visibility", "is_static", "has_return_type", "param_count", "line_count", "line", "is_magic")


@query(rf"""WITH {_P} SELECT 'C' || k AS class_name, unnest([{{'kind': 'constant', 'name': 'A' || s, 'v': CASE WHEN sn % 2 = 0 THEN 'private' ELSE 'public' END, 'e': sn % 2 = 0, 'l': 3}}, {{'kind': 'constant', 'name': 'B', 'v': CASE WHEN sn % 2 = 0 THEN 'private' ELSE 'public' END, 'e': sn % 2 = 0, 'l': 3}},
    {{'kind': 'property', 'name': 'p' || b, 'v': 'protected', 'e': true, 'l': 4}}, {{'kind': 'property', 'name': 'old' || s, 'v': 'public', 'e': false, 'l': 5}}, {{'kind': 'property', 'name': 'q' || k, 'v': CASE WHEN kn % 2 = 0 THEN 'private' ELSE 'public' END, 'e': kn % 2 = 0, 'l': 6}},
    {{'kind': 'trait', 'name': 'T' || s, 'v': NULL, 'e': NULL, 'l': NULL}}, {{'kind': 'trait', 'name': 'U', 'v': NULL, 'e': NULL, 'l': NULL}}], recursive := true) FROM p""")
def php_members(spark, sf_dir):
    code = _text("<?php class C<k> {\n use T<s>, U;\n <private>const A<s> = 1, B = 2;\n protected ?int $p<b> = 1;\n var $old<s>;\n function __construct(<own>readonly int $q<k>, $plain = 0) {}\n}", private=_when("sn % 2 = 0", "private "), own=_when("kn % 2 = 0", "private "))
    nodes = _extracted(spark, sf_dir, "nodes", code)
    told = lambda kind, items: nodes.select("class_name", F.lit(kind).alias("kind"), F.inline(items)).select("class_name", "kind", "name", F.col("visibility").alias("v"), F.col("has_explicit_visibility").alias("e"), F.col("line").alias("l"))
    traits = nodes.select("class_name", F.lit("trait").alias("kind"), F.explode("traits").alias("name"), F.lit(None).cast("string").alias("v"), F.lit(None).cast("boolean").alias("e"), F.lit(None).cast("int").alias("l"))
    return told("constant", "constants").unionByName(told("property", "properties")).unionByName(traits)


@query(rf"""WITH {_P} SELECT 'C' || k AS class_name, kn % 6 = 0 AS is_final, kn % 6 = 1 AS is_abstract, kn % 6 = 2 AS is_interface, kn % 6 = 3 AS is_trait, kn % 6 = 4 AS is_enum, kn % 6 = 5 AS is_readonly,
    CASE WHEN kn % 6 = 2 THEN 'Up' || s || ',Countable' ELSE '' END AS interface_extends, CAST(2 + sn % 3 AS INTEGER) AS line FROM p""")
def php_kinds(spark, sf_dir):
    code = _text("<?php\n<gap><kind><k><above> { }", gap=F.expr("repeat('\\n', CAST(sn % 3 AS INT))"), kind=F.expr("CASE kn % 6 WHEN 0 THEN 'final class C' WHEN 1 THEN 'abstract class C' WHEN 2 THEN 'interface C' WHEN 3 THEN 'trait C' WHEN 4 THEN 'enum C' ELSE 'readonly class C' END"), above=_when("kn % 6 = 2", " extends Up<s>, \\Countable"))
    return _extracted(spark, sf_dir, "nodes", code).select("class_name", "is_final", "is_abstract", "is_interface", "is_trait", "is_enum", "is_readonly", _list("interface_extends"), "line")


@query(rf"""WITH {_P} SELECT file, CAST(CASE kn % 6 WHEN 1 THEN sn + 1 WHEN 2 THEN 1 WHEN 5 THEN sn + 2 END AS INTEGER) AS line FROM p""")
def php_tags(spark, sf_dir):
    lines = F.expr("repeat('\\n', CAST(sn AS INT))")
    code = F.expr("kn % 6")
    code = (F.when(code == 0, _text("<?php echo 1 ?>\n<?= <k> ?>")).when(code == 1, F.concat(lines, F.lit("<? echo 1;"))).when(code == 2, F.lit("<?PHP echo 1;"))
            .when(code == 3, F.lit("<?xml version='1'?>\n<?php echo 2;")).when(code == 4, F.lit("plain text")).otherwise(F.concat(F.lit("<?php ?>\n"), lines, F.lit("<?hh"))))
    return _extracted(spark, sf_dir, "analyses", code).select("file", F.col("invalid_php_tag_line").alias("line"))


@query(rf"""WITH {_P} SELECT file, kn % 8 IN (0, 2, 3, 4, 7) AS declares_symbols, kn % 8 IN (1, 2, 5, 7) AS has_side_effects, CAST(CASE kn % 8 WHEN 1 THEN sn + 2 WHEN 2 THEN sn + 3 WHEN 5 THEN 3 ELSE 1 END AS INTEGER) AS side_effect_line FROM p""")
def php_side_effects(spark, sf_dir):
    lines = F.expr("repeat('\\n', CAST(sn AS INT))")
    kind = F.expr("kn % 8")
    code = (F.when(kind == 0, _text("<?php namespace N; use A\\B; class C<k> { function m() { echo 1; } }")).when(kind == 1, F.concat(F.lit("<?php\n"), lines, F.lit("echo 1;"))).when(kind == 2, F.concat(_text("<?php\nclass C<k> {}\n"), lines, F.lit("$x = 1; echo 2;")))
            .when(kind == 3, _text("<?php if (!function_exists('f<k>')) { function f<k>() { echo 1; } }")).when(kind == 4, _text("<?php declare(strict_types=1); defined('A<k>') || define('A<k>', 1);"))
            .when(kind == 5, F.lit("<?php\nif (true) {\n  include 'x';\n}")).when(kind == 6, _text("<?php return ['a' => <k>];")).otherwise(_text("text <?php class C<k> {}")))
    return _extracted(spark, sf_dir, "analyses", code).select("file", "declares_symbols", "has_side_effects", "side_effect_line")


@query(rf"""WITH {_P} SELECT file, kn % 4 = 0 AS has_valid_ast, CASE WHEN kn % 4 = 0 THEN 2 ELSE 0 END AS classes FROM p""")
def php_broken_files(spark, sf_dir):
    code = F.expr("kn % 4")
    code = F.when(code == 0, _text("<?php class A<k> {} class B<k> { const H = <<<'T'\n  class X {}\n  T; }")).when(code == 1, _text("<?php class A<k> {} class B<k> {")).when(code == 2, _text("<?php class A<k> {} $x = 'open")).otherwise(_text("<?php class A<k> {} f(];"))
    tables = extract(_sources(spark, sf_dir, code))
    count = tables["nodes"].groupBy("file").agg(F.count("*").cast("int").alias("n"))
    return tables["analyses"].join(count, "file", "left").select("file", "has_valid_ast", F.coalesce("n", F.lit(0)).alias("classes"))


# --- rules on sources ---

_BYTES = "CASE WHEN kn % 5 = 0 THEN X'EFBBBF' ELSE X'' END"


def _odd_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    tag = F.expr("CASE WHEN kn % 3 = 0 THEN '<?PHP' ELSE '<?php' END")
    code = _text("<tag>\nclass C<k> { public $a; var $p<s>; }\n<effect>", tag=tag, effect=_when("kn % 4 = 0", "\necho 1;"))
    return _parts(spark, sf_dir).select("file", F.concat(F.expr(_BYTES), code.cast("binary"), F.expr("CASE WHEN kn % 7 = 0 THEN X'2F2FFF' ELSE X'' END")).alias("content"))


_FILE_RULE = "'' AS class_name, NULL AS layer FROM p WHERE"


@query(rf"""WITH {_P}
  SELECT 'files.tags' AS rule_key, 'File [' || file || '] must use only <?php and <?= PHP tags' AS message, file, CAST(1 AS INTEGER) AS line, {_FILE_RULE} kn % 3 = 0 AND t IN ('ECONOMY', 'PROMO')
  UNION ALL SELECT 'files.effects', 'File [' || file || '] should either declare symbols or cause side effects, not both', file, CAST(4 AS INTEGER), {_FILE_RULE} kn % 4 = 0
  UNION ALL SELECT 'files.bom', 'File [' || file || '] must use UTF-8 without BOM', file, CAST(1 AS INTEGER), {_FILE_RULE} kn % 5 = 0 AND NOT starts_with(file, 'src/SMALL/C1')
  UNION ALL SELECT 'files.utf8', 'File [' || file || '] must use valid UTF-8 encoding', file, CAST(1 AS INTEGER), {_FILE_RULE} kn % 7 = 0""")
def php_file_rules(spark, sf_dir):
    tables = extract(_odd_files(spark, sf_dir))
    a = Architecture().rule("files.tags", R.Psr1PhpTags(["src/ECONOMY", "./src/PROMO/"])).rule("files.effects", R.Psr1SymbolsOrSideEffects()).rule("files.bom", R.Psr1Utf8WithoutBom()).rule("files.utf8", R.Psr1ValidUtf8())
    return _told(analysis.violations(a.skip({"files.bom": "src/SMALL/C1*"}), Facts(**tables)))


@query(rf"""WITH {_P} SELECT 'property.visibility' AS rule_key, 'Property [C' || k || '::$p' || s || '] must declare an explicit visibility (public, protected, or private)' AS message, file, CAST(2 AS INTEGER) AS line, 'C' || k AS class_name, 'Small' AS layer FROM p WHERE t = 'SMALL'""")
def property_visibility(spark, sf_dir):
    a = Architecture().layer("Small", "src/SMALL/").rule("property.visibility", R.MustDeclarePropertyVisibility("Small"))
    return _told(analysis.violations(a, Facts(**extract(_odd_files(spark, sf_dir)))))


@query(rf"""WITH {_P} SELECT 'Wrong\C' || k AS class_name, 'Class [Wrong\C' || k || '] must match PSR-4 class [' || CASE WHEN t = 'SMALL' THEN 'Small\C' ELSE 'App\' || t || '\C' END || k || ']' AS message, '/p/' || file AS file FROM p WHERE kn % 4 = 0 AND t <> 'PROMO'
  UNION ALL SELECT 'App\SMALL\D' || k, 'Class [App\SMALL\D' || k || '] must match PSR-4 class [Small\C' || k || ']', '/p/' || file FROM p WHERE t = 'SMALL' AND kn % 4 = 1""")
def psr4_namespace(spark, sf_dir):
    # a class fits any mapping of its file; the folder that is deepest is told
    mapping = composer.mapping(spark, {"autoload": {"psr-4": {"App\\": ["src/"], "Small\\": "src/SMALL"}}, "autoload-dev": {"psr-4": {"Wrong\\": "src/PROMO/"}}})
    own = F.expr("CASE WHEN kn % 4 = 0 THEN concat('namespace Wrong; class C', k) WHEN t = 'SMALL' AND kn % 4 = 1 THEN concat('namespace App\\\\SMALL; class D', k) WHEN t = 'PROMO' THEN concat('namespace App\\\\PROMO; class C', k) WHEN t = 'SMALL' AND kn % 4 = 2 THEN concat('namespace Small; class C', k) ELSE concat('namespace App\\\\', t, '; class C', k) END")
    files = _sources(spark, sf_dir, F.concat(F.lit("<?php "), own, F.lit(" {}"))).withColumn("file", F.concat(F.lit("/p/"), "file"))
    a = Architecture().layer("Source", "src/").rule("psr4", R.Psr4Namespace("Source"))
    return analysis.violations(a, Facts(**extract(files), psr4=mapping, composer_state="found", base_path="/p")).select("class_name", "message", "file")


@query(rf"""WITH {_P}, d AS (SELECT *, 'src/Domain/' || CASE kn % 3 WHEN 0 THEN 'X' || k || 'Entity' WHEN 1 THEN 'X' || k || 'Repository' ELSE 'X' || k || 'Event' END || '.php' AS f, 'Domain\X' || k || CASE kn % 3 WHEN 0 THEN 'Entity' WHEN 1 THEN 'Repository' ELSE 'Event' END AS c FROM p)
  SELECT 'ddd.entity.must_be_final' AS rule_key, c AS class_name FROM d WHERE kn % 3 = 0 AND sn % 2 = 0 UNION ALL SELECT 'ddd.event.must_be_final', c FROM d WHERE kn % 3 = 2 AND sn % 2 = 0
  UNION ALL SELECT 'ddd.entity.must_have_return_types', c FROM d WHERE kn % 3 = 0 AND sn % 5 = 0 UNION ALL SELECT 'ddd.repository.must_be_interface', c FROM d WHERE kn % 3 = 1 UNION ALL SELECT 'ddd.repository.implementation_in_infrastructure', c FROM d WHERE kn % 3 = 1
  UNION ALL SELECT unnest(['ddd.safety.domain_no_dump', 'ddd.safety.domain_no_datetime']), c FROM d WHERE sn % 7 = 0 UNION ALL SELECT 'ddd.event.no_datetime', c FROM d WHERE sn % 7 = 0 AND kn % 3 = 2
  UNION ALL SELECT unnest(['ddd.safety.domain_no_die', 'ddd.safety.domain_no_exit']), c FROM d WHERE sn % 11 = 0 UNION ALL SELECT 'ddd.safety.domain_max_complexity', c FROM d WHERE sn % 13 = 0 UNION ALL SELECT 'ddd.safety.domain_no_json_serializable', c FROM d WHERE kn % 11 = 0
  UNION ALL SELECT 'ddd.layer.domain_not_depend_application', c FROM d WHERE kn % 13 = 0 UNION ALL SELECT 'ddd.safety.domain_max_method_length', c FROM d WHERE sn > 20""")
def ddd_findings(spark, sf_dir):
    suffix = F.expr("CASE kn % 3 WHEN 0 THEN 'Entity' WHEN 1 THEN 'Repository' ELSE 'Event' END")
    # all statements start on the body's first line, so that a method's length is sn whatever comes before the body
    code = _text("<?php namespace Domain; <final>class X<k><suffix> <json>{ public function m($a)<type> { <dump> <die> <ifs> <app> <body> } }", suffix=suffix, final=_when("sn % 2 = 1", "final "), json=_when("kn % 11 = 0", "implements \\JsonSerializable "),
                 type=_when("sn % 5 <> 0", ": int"), dump=_when("sn % 7 = 0", "dump(new \\DateTime);"), die=_when("sn % 11 = 0", "die;"), ifs=_when("sn % 13 = 0", "if ($a && $a && $a && $a && $a) { }"), app=_when("kn % 13 = 0", "\\Application\\Run::go();"),
                 body=F.expr("repeat('$a;\\n', CAST(sn AS INT))"))
    files = _sources(spark, sf_dir, code).select(F.concat(F.lit("src/Domain/"), F.substring_index("file", "/", -1)).alias("file"), "content")
    run = spark.createDataFrame([("src/Application/Run.php", bytearray(b"<?php namespace Application; class Run {}"))], "file string, content binary")
    return analysis.violations(Architecture().with_preset(presets.Ddd()), Facts(**extract(files.unionByName(run)))).select("rule_key", "class_name")


# --- fixes ---


def _fixed(spark: SparkSession, sf_dir: str, code: Column, *actions: tuple[str, str, Column | None]) -> DataFrame:
    """(file, text, removed) of the part files that a plan with these actions for each changes."""
    parts = _parts(spark, sf_dir)
    plan = parts.select("file", F.inline(F.array(*(F.struct(F.lit(a).alias("action"), _text(name).alias("class_name"), (F.lit(None) if m is None else m).cast("string").alias("member")) for a, name, m in actions))))
    out = fixes.apply(_sources(spark, sf_dir, code), plan)
    return out.select("file", F.decode("content", "UTF-8").alias("text"), "removed")


@query(rf"""WITH {_P} SELECT file, '<?php' || chr(10) || '#[A]' || chr(10) || 'final ' || CASE kn % 3 WHEN 0 THEN '' ELSE 'readonly ' END || 'class C' || k || ' {{}} class Other {{}}' AS text, false AS removed FROM p WHERE kn % 3 <> 2""")
def fix_final(spark, sf_dir):
    kind = F.expr("CASE kn % 3 WHEN 0 THEN '' WHEN 1 THEN 'readonly ' ELSE 'abstract ' END")
    return _fixed(spark, sf_dir, _text("<?php\n#[A]\n<kind>class C<k> {} class Other {}", kind=kind), ("add_final", "C<k>", None))


@query(rf"""WITH {_P} SELECT file, '<?php namespace N; class Other {{}} abstract class C' || k || ' {{ }}' AS text, false AS removed FROM p WHERE sn % 2 = 0""")
def fix_abstract(spark, sf_dir):
    return _fixed(spark, sf_dir, _text("<?php namespace N; class Other {} <kind>class C<k> { }", kind=_when("sn % 2 = 1", "final ")), ("add_abstract", "N\\C<k>", None))


@query(rf"""WITH {_P} SELECT file, '<?php class C' || k || ' {{ public const A' || s || ' = 1; public $p' || b || '; public static function m' || k || '() {{}} function __construct(public readonly int $q' || s || ') {{}} function rest() {{}} }}' AS text, false AS removed FROM p""")
def fix_member_visibility(spark, sf_dir):
    code = _text("<?php class C<k> { const A<s> = 1; var $p<b>; static function m<k>() {} function __construct(readonly int $q<s>) {} function rest() {} }")
    name = lambda prefix, c: F.concat(F.lit(prefix), c)
    return _fixed(spark, sf_dir, code, ("add_public_constant", "C<k>", name("A", "s")), ("add_public_property", "C<k>", name("p", "b")), ("add_public_method", "C<k>", name("m", "k")), ("add_public_property", "C<k>", name("q", "s")))


@query(rf"""WITH {_P} SELECT file, CASE WHEN kn % 2 = 0 THEN '' ELSE '<?php use A\B;' || chr(10) || chr(10) || 'class Kept' || k || ' {{}}' END AS text, kn % 2 = 0 AS removed FROM p""")
def fix_remove_class(spark, sf_dir):
    return _fixed(spark, sf_dir, _text("<?php use A\\B;\n<kind> C<k> { const X = 1; }\n<rest>", kind=F.expr("CASE WHEN sn % 2 = 0 THEN 'interface' ELSE 'trait' END"), rest=_when("kn % 2 = 1", "class Kept<k> {}")), ("remove_class", "C<k>", None)).withColumn("text", F.regexp_replace("text", r"\n\n\n", "\n\n"))


@query(rf"""WITH {_P} SELECT file, '<?php echo ' || k || ' ?><i><?php echo 2 ?><?= 3 ?>' AS text, false AS removed FROM p WHERE kn % 4 <> 0""")
def fix_tags_and_bom(spark, sf_dir):
    code = F.concat(_when("kn % 4 IN (1, 2)", "﻿"), F.expr("CASE WHEN kn % 4 IN (2, 3) THEN '<?PHP' ELSE '<?php' END"), _text(" echo <k> ?><i>"), F.expr("CASE WHEN kn % 4 IN (2, 3) THEN '<?' ELSE '<?php' END"), F.lit(" echo 2 ?><?= 3 ?>"))
    return _fixed(spark, sf_dir, code, ("strip_bom", "", None), ("normalise_tags", "", None))


@query(r"""SELECT 'N' || n_nationkey || '\' AS namespace, CASE WHEN n_nationkey % 4 = 0 THEN 'lib/' || n_nationkey ELSE n_name END AS path FROM nation WHERE n_nationkey % 5 <> 0 OR n_nationkey % 4 = 0
  UNION ALL SELECT 'N' || n_nationkey || '\', n_name FROM nation WHERE n_nationkey % 5 <> 0 AND n_nationkey % 4 = 0""")
def fix_missing_paths(spark, sf_dir):
    nations = _t(spark, sf_dir, "nation").orderBy("n_nationkey").collect()  # the fixed 25 nations
    config = {"autoload": {"psr-4": {f"N{n.n_nationkey}\\": [n.n_name, f"lib/{n.n_nationkey}"] if n.n_nationkey % 4 == 0 else n.n_name for n in nations}}, "autoload-dev": {"psr-4": {"T\\": "NATION_5"}}}
    gone = {n.n_name for n in nations if n.n_nationkey % 5 == 0}
    fixed = fixes.without_missing_paths(config, lambda p: p not in gone)
    return composer.mapping(spark, json.loads(json.dumps(fixed))).select("namespace", "path")


@query(rf"""WITH {_P} SELECT file, '<?php class U' || k || ' {{ public const A = 1; }} $u = new U' || k || ';' AS text FROM p WHERE kn % 5 = 0
  UNION ALL SELECT file, '<?php class H' || k || ' extends B' || (kn - 1) || ' {{}}' FROM p WHERE kn % 5 = 4 UNION ALL SELECT file, '<?php abstract class B' || k || ' {{}}' FROM p WHERE kn % 5 = 3 AND kn + 1 IN (SELECT kn FROM p)""")
def fix_until_stable(spark, sf_dir):
    # 1 is unused as soon as 2, its only heir, is gone; 3 has an heir that stays
    kind = F.expr("kn % 5")
    code = F.when(kind == 0, _text("<?php class U<k> { const A = 1; } $u = new U<k>;")).when(kind == 1, _text("<?php abstract class A<k> {}")).when(kind == 2, F.expr("concat('<?php abstract class A', k, ' extends A', kn - 1, ' {}')")).when(kind == 3, _text("<?php abstract class B<k> {}")).otherwise(F.expr("concat('<?php class H', k, ' extends B', kn - 1, ' {}')"))
    a = Architecture().layer_pattern("L", "/./").rule("unused", R.MustBeUsedAbstractClass("L")).rule("visibility", R.MustDeclareConstantVisibility("L"))
    out, _ = fixes.fix_until_stable(_sources(spark, sf_dir, code), lambda files: analysis.fix_plan(a, analysis.violations(a, Facts(**extract(files)))))
    return out.select("file", F.decode("content", "UTF-8").alias("text"))


# --- caches, baselines and scans ---


@query(rf"""WITH {_P} SELECT 'C' || k || CASE WHEN kn % 3 = 0 THEN 'New' ELSE '' END AS class_name, file FROM p WHERE kn % 5 <> 0""")
def fact_store_refresh(spark, sf_dir):
    store = FactStore(spark, f"{shared_folder(spark)}/facts-{uuid.uuid4()}")
    hashed = lambda df: df.withColumn("hash", F.sha2("content", 256))
    store.refresh(hashed(_sources(spark, sf_dir, _text("<?php class C<k> {}"))), extract)
    # a third has changed, a fifth is gone
    now = _sources(spark, sf_dir, _text("<?php class C<k><new> {}", new=_when("kn % 3 = 0", "New"))).where(~F.regexp_extract("file", r"C(\d+)", 1).endswith("0") & ~F.regexp_extract("file", r"C(\d+)", 1).endswith("5"))
    return store.refresh(hashed(now), extract)["nodes"].select("class_name", "file")


@query("""SELECT doc_id, doc_id % 3 <> 0 AND doc_id % 4 <> 1 AS cached FROM documents""")
def cache_split(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents").select("doc_id", F.md5(F.col("text").cast("binary")).alias("hash"))
    cached = docs.where("doc_id % 3 <> 0").withColumn("hash", F.when(F.col("doc_id") % 4 == 1, "stale").otherwise(F.col("hash")))
    hit, miss = incremental.split_by_cache(docs, cached.unionByName(cached), key="doc_id")
    return hit.select("doc_id", F.lit(True).alias("cached")).unionByName(miss.select("doc_id", F.lit(False).alias("cached")))


@query(f"""{_PART_RUN} SELECT rule_key, class_name FROM w WHERE NOT (class_name LIKE '%3%') UNION ALL SELECT 'project', NULL UNION ALL SELECT 'file', ''""")
def baseline_round_trip(spark, sf_dir):
    found = _part_run(spark, sf_dir)
    # violations of no class, file or layer, of which the last one isn't accepted
    none = F.lit(None).cast("string")
    whole = spark.range(2).select(F.lit("project").alias("rule_key"), F.concat(F.lit("m"), F.col("id").cast("string")).alias("message"), none.alias("file"), F.lit(1).alias("line"), none.alias("class_name"), none.alias("layer"), F.lit(False).alias("fixable"), none.alias("method_name"), none.alias("constant_name"), none.alias("property_name"))
    own = whole.withColumns({"rule_key": F.lit("file"), "file": F.concat(F.lit("/base/src/"), "message"), "message": F.concat(F.lit("File [/base/src/"), "message", F.lit("] of /other/base/src")), "class_name": F.lit("")})
    found = found.unionByName(whole).unionByName(own)
    path = f"{shared_folder(spark)}/baseline-{uuid.uuid4()}"
    baseline.write(found.where("class_name LIKE '%3%' OR message = 'm0' OR message LIKE '%src/m0]%'"), path, "/base")
    return baseline.without_accepted(found, baseline.read(spark, path), "/base").select("rule_key", "class_name")


@query(f"{_PART_RUN} SELECT * FROM w")
def result_cache(spark, sf_dir):
    files = _parts(spark, sf_dir).select("file", F.col("s").alias("hash"))
    cache, wanted = ResultCache(spark, f"{shared_folder(spark)}/results-{uuid.uuid4()}"), {"version": 1, "rules": ["a", "b"]}
    key = content_key(files, wanted)
    cache.save(key, wanted, _part_run(spark, sf_dir))
    cache.save(content_key(files.where("hash <> '7'"), wanted), wanted, _part_run(spark, sf_dir).where("false"))
    # the same files in another order are the same; other metadata aren't
    again = content_key(files.orderBy(F.desc("file")), dict(reversed(wanted.items())))
    return _told(cache.load(again, wanted) if cache.load(again, wanted | {"version": 2}) is None else _part_run(spark, sf_dir).where("false"))


@query(rf"""SELECT page_id, CASE WHEN starts_with(file, 'site/en/8/') THEN 'site/en/8' WHEN starts_with(file, 'site/en/') THEN 'site/en' WHEN starts_with(file, 'site/fr/') THEN 'site/fr' END AS folder FROM (SELECT page_id, {_PAGE_FILE} AS file FROM pages) WHERE starts_with(file, 'site/en/') OR starts_with(file, 'site/fr/')""")
def nearest_config_folder(spark, sf_dir):
    pages = _pages(spark, sf_dir)
    folders = spark.createDataFrame([("site/en",), ("site/en/8",), ("site/fr",), ("sit",), ("site/e",)], "path string")
    return pages.join(psr4.nearest_folder(pages, folders), "file").select("page_id", "folder")


@query(rf"WITH {_PARTIES}, {_EDGES} {_RULESET_SQL} AND r2 <> 'ASIA'")
def ruleset_scan_scope(spark, sf_dir):
    # Asia stands for the whole scan, so being in it says nothing about a dependency
    return _flagship(spark, sf_dir, scan_scope=["Asia"])


@query(f"""WITH {_TALK} SELECT class_name, conv_id = 3 AND turn > 0 AS extends_class, EXISTS (SELECT 1 FROM t b WHERE b.conv_id = t.conv_id AND b.turn <= t.turn AND b.role = 'user') AND conv_id = 5 AS implements_interface FROM t""")
def extends_and_implements(spark, sf_dir):
    nodes = graph.with_ancestors(_as_nodes(_turns(spark, sf_dir)))
    return nodes.select("class_name", P.extends_class("c3T0").alias("extends_class"), P.implements_interface("talk5").alias("implements_interface"))


@query(rf"""WITH {_P} SELECT unnest(['Mid' || k, 'I' || k, 'C' || k]) AS class_name, kn % 2 = 0 AS extends_interface FROM p""")
def extends_interface(spark, sf_dir):
    code = _text("<?php interface Mid<k> extends \\<top> {} interface I<k> extends Mid<k> {} class C<k> implements I<k> {}", top=F.expr("CASE WHEN kn % 2 = 0 THEN 'Base' ELSE 'Other' END"))
    nodes = graph.with_ancestors(_extracted(spark, sf_dir, "nodes", code))
    return nodes.select("class_name", P.extends_interface("BASE").alias("extends_interface"))


@query("""SELECT * FROM (VALUES ('a.php', '1'), ('_b.php', '2'), ('.c.php', '3'), ('d/e.php', '4'), ('_d/e.php', '5'), ('_d/f/g.php', '6'), ('_d/.h/_i.php', '7'), ('d/.j/k.php', '8')) AS v(file, content)""")
def scan_files(spark, sf_dir):
    # files whose names Spark's readers leave out, too; the list and a skipped folder aren't PHP files to look at
    base = f"{shared_folder(spark)}/scan-{uuid.uuid4()}"
    for i, name in enumerate(["a.php", "_b.php", ".c.php", "d/e.php", "_d/e.php", "_d/f/g.php", "_d/.h/_i.php", "d/.j/k.php", "d/l.txt", "_m.inc", "skip/n.php", "skip/_o.php", "_skip/p.php"]):
        scan.write_file(spark, f"{base}/{name}", str(i + 1).encode())
    files = scan.scan(spark, [".", "d", "missing"], base_path=base, skip=["skip", "_skip/*"])
    return files.select(F.regexp_extract("file", r"/scan-[0-9a-f-]+/(.*)", 1).alias("file"), F.decode("content", "UTF-8").alias("content"))


PROJECT = {
    "composer.json": '{"autoload": {"psr-4": {"App\\\\": "src/"}}, "autoload-dev": {"psr-4": {"Tests\\\\": "tests"}}}',
    "src/Good.php": "<?php\nnamespace App;\nclass Good { public function run(): int { return 1; } }\n", "src/bad_one.php": "<?php\nnamespace App;\nclass bad_one {\n    const low = 1;\n    function Run() {}\n}\n",
    "tests/_Hidden.php": "<?php\nnamespace Tests;\nclass Hidden_ {}\n", "other/Unmapped.php": "<?php class unmapped {}",
}


@query(r"""SELECT * FROM (VALUES
  ('psr12.constants.must_declare_visibility', 'Constant [App\bad_one::low] must declare an explicit visibility (public, protected, or private)', 'src/bad_one.php', 4, 'Source', 1), ('psr12.methods.must_declare_visibility', 'Method [App\bad_one::Run()] must declare an explicit visibility (public, protected, or private)', 'src/bad_one.php', 5, 'Source', 1),
  ('psr1.class_constants.must_be_upper_case', 'Class constant [App\bad_one::low] must be declared in upper case with underscore separators', 'src/bad_one.php', 4, 'Source', 1), ('psr1.methods.must_be_camel_case', 'Method [App\bad_one::Run()] must be declared in camelCase', 'src/bad_one.php', 5, 'Source', 1),
  ('psr1.classes.must_be_studly_caps', 'Class [App\bad_one] must be declared in StudlyCaps', 'src/bad_one.php', 3, 'Source', 1), ('psr1.classes.must_be_studly_caps', 'Class [Tests\Hidden_] must be declared in StudlyCaps', 'tests/_Hidden.php', 3, 'Source', 1),
  ('psr4.classes.must_match_composer', 'Class [Tests\Hidden_] must match PSR-4 class [Tests\_Hidden]', 'tests/_Hidden.php', 3, 'Source', 1)) AS v(rule_key, message, file, line, layer, exit_code)""".replace("\\\\", "\\"))
def project_run(spark, sf_dir):
    # without paths, the source layer and what is scanned are what the project's mapping names
    base = f"{shared_folder(spark)}/project-{uuid.uuid4()}".removeprefix("file:")
    for name, text in PROJECT.items():
        scan.write_file(spark, f"{base}/{name}", text.encode())
    architecture = Architecture().with_preset(presets.Psr12())
    result = analysis.run(architecture, cli.project_facts(spark, architecture, base))
    told = report.console_report(result)
    rows = [(r.rule_key, r.message, r.file.removeprefix(base + "/"), r.line, r.layer, result.exit_code) for r in result.violations if f"[{r.rule_key}]" in told and f"{r.file}:{r.line}" in told]
    return spark.createDataFrame(rows, "rule_key string, message string, file string, line int, layer string, exit_code int")


_MVC = r"""m AS (SELECT *, CASE kn % 4 WHEN 0 THEN 'controller' WHEN 1 THEN 'model' WHEN 2 THEN 'view' ELSE 'service' END AS l,
    'App\' || CASE kn % 4 WHEN 0 THEN 'Controllers' WHEN 1 THEN 'Model' WHEN 2 THEN 'Views' ELSE 'Service' END || '\' || CASE WHEN kn % 4 = 1 AND sn % 2 = 0 THEN 'Model' ELSE 'X' END || k
    || CASE WHEN sn % 2 = 1 THEN '' WHEN kn % 4 = 0 THEN 'Controller' WHEN kn % 4 = 3 THEN 'Service' ELSE '' END AS c FROM p)"""


@query(rf"""WITH {_P}, {_MVC}
  SELECT 'mvc.controller.name_must_end_with_controller' AS rule_key, c AS class_name FROM m WHERE l = 'controller' AND sn % 2 = 1 UNION ALL SELECT 'mvc.' || l || '.must_be_final', c FROM m WHERE l IN ('controller', 'service') AND sn % 2 = 0
  UNION ALL SELECT 'mvc.' || l || '.no_pdo', c FROM m WHERE l IN ('controller', 'view') AND sn % 5 = 0 UNION ALL SELECT 'mvc.' || l || '.no_superglobals', c FROM m WHERE sn % 3 = 0 UNION ALL SELECT 'mvc.' || l || '.no_echo', c FROM m WHERE l IN ('model', 'service') AND sn % 7 = 0
  UNION ALL SELECT 'mvc.' || l || '.no_header', c FROM m WHERE l <> 'controller' AND sn % 4 = 3 UNION ALL SELECT 'mvc.' || l || '.must_have_return_types', c FROM m WHERE l <> 'view' AND sn % 5 = 1 UNION ALL SELECT 'mvc.model.name_must_not_start_with_model', c FROM m WHERE l = 'model' AND sn % 2 = 0
  UNION ALL SELECT 'mvc.safety.' || l || '_no_var_export', c FROM m WHERE sn % 11 = 0 UNION ALL SELECT 'mvc.view.max_complexity', c FROM m WHERE l = 'view' AND sn % 6 = 0 UNION ALL SELECT 'mvc.layer.' || l || '_not_depend_controller', c FROM m WHERE l IN ('model', 'view') AND kn % 13 < 2
  UNION ALL SELECT 'mvc.controller.no_doctrine_orm', c FROM m WHERE l = 'controller' AND sn % 9 = 0 UNION ALL SELECT 'mvc.controller.max_dependencies', c FROM m WHERE l = 'controller' AND sn > 40""")
def mvc_findings(spark, sf_dir):
    place = F.expr("CASE kn % 4 WHEN 0 THEN 'Controllers' WHEN 1 THEN 'Model' WHEN 2 THEN 'Views' ELSE 'Service' END")
    suffix = F.expr("CASE WHEN sn % 2 = 1 THEN '' WHEN kn % 4 = 0 THEN 'Controller' WHEN kn % 4 = 3 THEN 'Service' ELSE '' END")
    code = _text("<?php namespace App\\<place>; <orm>class <prefix><k><suffix> { public function __construct($a<more>) {} public function m($a)<type> { <pdo> <get> <echo> <header> <export> <ifs> <known> } }", place=place, suffix=suffix,
                 prefix=F.expr("CASE WHEN kn % 4 = 1 AND sn % 2 = 0 THEN 'Model' ELSE 'X' END"), orm=_when("sn % 9 = 0 AND kn % 4 = 0", "use Doctrine\\ORM\\EntityManager; "), more=_when("sn > 40", ", $b, $c, $d, $e, $f"), type=_when("sn % 5 <> 1", ": int"),
                 pdo=_when("sn % 5 = 0", "new \\PDO('x');"), get=_when("sn % 3 = 0", "$b = $_GET['b'];"), echo=_when("sn % 7 = 0", "echo 1;"), header=_when("sn % 4 = 3", "header('x');"), export=_when("sn % 11 = 0", "var_export($a);"),
                 ifs=_when("sn % 6 = 0", "if ($a) { } if ($a) { } if ($a) { }"), known=_when("kn % 13 < 2", "\\App\\Controllers\\KnownController::go();"))
    known = spark.createDataFrame([("src/Known.php", bytearray(b"<?php namespace App\\Controllers; final class KnownController {}"))], "file string, content binary")
    return analysis.violations(Architecture().with_preset(presets.Mvc()), Facts(**extract(_sources(spark, sf_dir, code).unionByName(known)))).select("rule_key", "class_name")
