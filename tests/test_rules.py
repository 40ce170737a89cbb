"""Rules on hand-built facts: pass, at the limit, over it, in another layer; and whole runs."""

import json

import pytest
from pyspark.sql import functions as F

from rulespan import rules as R
from rulespan import schemas
from rulespan.operators import baseline
from rulespan.plans import analysis, presets, report
from rulespan.plans.architecture import Architecture, UnknownRule
from rulespan.rules.base import Facts
from rulespan.sources import composer
from rulespan.sources.facts import FactStore, with_defaults

METHOD = dict(name="run", visibility="public", has_return_type=True, is_static=False, param_count=0, cyclomatic_complexity=1, line_count=1, has_explicit_visibility=True, line=5, is_magic=False)
FIELDS = [f.split()[0] for f in __import__("rulespan.sources.facts", fromlist=["_fields"])._fields(schemas.CLASS_NODES)]


def node(name, **fields):
    return dict(class_name=name, file=f"src/{name}.php", line=3, layer="L", layers=["L"], **fields)


def method(**fields):
    m = METHOD | fields
    return tuple(m[k] for k in METHOD)


def frame(spark, rows):
    return with_defaults(spark.createDataFrame([tuple(r.get(f) for f in FIELDS) for r in rows], schemas.CLASS_NODES))


def found(spark, rule, *rows, **facts):
    return [tuple(r) for r in analysis.violations(Architecture().rule("k", rule), Facts(frame(spark, rows), **facts)).select("class_name", "line", "message").collect()]


@pytest.mark.parametrize("rule,good,bad,message", [
    (R.ClassNameMustHaveSuffix("L", "Entity"), node("A\\UserEntity"), node("A\\User"), "Class [A\\User] must have suffix [Entity]"),
    (R.ClassNameMustNotHavePrefix("L", "Abs"), node("Abs\\User"), node("A\\AbsUser"), "Class [A\\AbsUser] must not have prefix [Abs]"),
    (R.ClassNameMustBeStudlyCaps("L"), node("A\\UserName9"), node("A\\user_name"), "Class [A\\user_name] must be declared in StudlyCaps"),
    (R.MustBeInterface("L", "/Repository$/"), node("ARepository", is_interface=True), node("BRepository"), "Class [BRepository] must be an interface"),
    (R.MayNotCallFunction("L", "Dump"), node("A", function_calls=["dd"]), node("B", function_calls=["DUMP"]), "Class [B] must not call function [Dump()]"),
    (R.MayNotUseClass("L", "DateTime"), node("A", dependencies=["datetime"]), node("B", dependencies=["DateTime"]), "Class [B] must not use [DateTime]"),
    (R.MayNotUseNamespace("L", "Doctrine\\ORM\\"), node("A", dependencies=["Doctrine\\ORMX"]), node("B", dependencies=["Doctrine\\ORM\\Em"]), "Class [B] must not use namespace [Doctrine\\ORM\\]"),
    (R.MayNotUseLanguageConstruct("L", "exit"), node("A", language_constructs=["echo"]), node("B", language_constructs=["die"]), "Class [B] must not use language construct [exit]"),
    (R.MayNotUseSuperglobals("L"), node("A"), node("B", superglobals=["$_POST", "$_GET"]), "Class [B] must not access superglobals directly ($_POST, $_GET)"),
    (R.MustBeFinal("L"), node("A", is_final=True), node("B"), "Class [B] must be declared final"),
    (R.MaxDependencyCount("L", 2), node("A", methods=[method(name="__CONSTRUCT", param_count=2)]), node("B", methods=[method(name="__construct", param_count=3)]), "Class [B] has 3 constructor dependencies, maximum allowed is 2"),
    (R.NamingConvention("/Service$/", "L", exclude="/DomainService$/"), node("AService"), node("BService") | {"layer": None, "layers": []}, "Class [BService] matching pattern [/Service$/] must live in layer [L], found in layer [unknown]"),
])
def test_class_rules(spark, rule, good, bad, message):
    elsewhere = bad | {"class_name": "E\\" + bad["class_name"].split("\\")[-1], "layer": "M", "layers": ["M"]}
    got = found(spark, rule, good, bad, *([] if isinstance(rule, R.NamingConvention) else [elsewhere]))
    assert got == [(bad["class_name"], 3, message)]


@pytest.mark.parametrize("rule,at,over,message", [
    (R.MaxCyclomaticComplexity("L", 5), method(cyclomatic_complexity=5), method(cyclomatic_complexity=6), "Method [A::run()] has cyclomatic complexity of 6, maximum allowed is 5"),
    (R.MaxMethodLength("L", 20), method(line_count=20), method(line_count=21, line=0), "Method [A::run()] is 21 lines long, maximum allowed is 20"),
    (R.MethodNameMustBeCamelCase("L"), method(name="__soapCall"), method(name="Run_it"), "Method [A::Run_it()] must be declared in camelCase"),
    (R.MustHaveReturnType("L"), method(name="__Construct", has_return_type=False), method(has_return_type=False), "Public method [A::run()] must declare a return type"),
    (R.MustDeclareMethodVisibility("L"), method(), method(has_explicit_visibility=False), "Method [A::run()] must declare an explicit visibility (public, protected, or private)"),
])
def test_method_rules(spark, rule, at, over, message):
    assert found(spark, rule, node("A", methods=[at, over])) == [("A", 5 if over[8] else 3, message)]


def test_member_rules(spark):
    rows = node("A", constants=[("GOOD_1", "public", True, 0), ("bad_name", "public", False, 7)], properties=[("p", "public", False, 9)])
    assert found(spark, R.ClassConstantNameMustBeUpperCase("L"), rows) == [("A", 7, "Class constant [A::bad_name] must be declared in upper case with underscore separators")]
    assert found(spark, R.MustDeclareConstantVisibility("L"), rows)[0][:2] == ("A", 7)
    assert found(spark, R.MustDeclarePropertyVisibility("L"), rows) == [("A", 9, "Property [A::$p] must declare an explicit visibility (public, protected, or private)")]


def test_interfaces_through_ancestors_in_any_case(spark):
    rows = [node("I", is_interface=True, interface_extends=["Base"]), node("Base", is_interface=True), node("P", implements=["i"]), node("C", extends="p"), node("D")]
    assert {x[0] for x in found(spark, R.MayNotImplementInterface("L", "BASE"), *rows)} == {"P", "C", "I"}
    assert {x[0] for x in found(spark, R.MustImplementInterface("L", "base"), *rows)} == {"D"}
    assert {x[0] for x in found(spark, R.ClassImplementingInterfaceMustHaveSuffix("L", "I", "C"), *rows)} == {"P"}


def test_usage_rules(spark):
    rows = [node("Parent", dependencies=[]), node("Child", extends="PARENT", dependencies=["Parent"]), node("Self", is_abstract=True, dependencies=["Self"]), node("Named", is_trait=True), node("ByText", is_interface=True)]
    texts = spark.createDataFrame([("x.php", ["bytext"])], schemas.FILE_REFERENCES)
    made = spark.createDataFrame([("x.php", [(None, "parent")])], schemas.FILE_INSTANTIATIONS)
    extended = R.ExtendedClassMustBeAbstractOrInstantiated("L")
    assert [x[0] for x in found(spark, extended, *rows)] == ["Parent"] and found(spark, extended, *rows, instantiations=made) == []
    assert [x[0] for x in found(spark, R.MustBeUsedAbstractClass("L"), *rows)] == ["Self"], "a class's own name is no use of it"
    assert [x[0] for x in found(spark, R.MustBeUsedTrait("L"), *rows)] == ["Named"]
    assert found(spark, R.MustBeUsedInterface("L"), *rows, references=texts) == [] and len(found(spark, R.MustBeUsedInterface("L"), *rows)) == 1
    anonymous = spark.createDataFrame([("x.php", 1, None, ["ByText"], ["named"])], schemas.ANONYMOUS_CLASSES)
    assert found(spark, R.MustBeUsedInterface("L"), *rows, anonymous=anonymous) == [] and found(spark, R.MustBeUsedTrait("L"), *rows, anonymous=anonymous) == []


def test_may_not_depend_on_falls_back_to_names(spark):
    rows = [node("A", dependencies=["Scanned", "App\\Infra\\X", "Infra\\Y", "AppInfra\\Z", "Bare"]), node("Scanned") | {"layer": "Infra", "layers": ["Infra"]}, node("Bare") | {"layer": None, "layers": []}]
    assert len(found(spark, R.MayNotDependOn("L", "Infra"), *rows)) == 3


def test_skips_rules_and_paths(spark):
    a = Architecture().skip(["late", "src/A.php"]).rule("late", R.MustBeFinal("L")).rule("k", R.MustBeFinal("L")).skip({"k": "src/B*"})
    assert a.skipped_rules == ["late"] and a.skip_paths == ["src/A.php"]
    out = analysis.violations(a, Facts(frame(spark, [node("A"), node("Bb"), node("C")]))).collect()
    assert [(r.rule_key, r.class_name) for r in out] == [("k", "C")]
    with pytest.raises(UnknownRule):
        a.remove_rule("none")


def test_ruleset_with_scan_scope_and_class_skips(spark):
    rows = [node("App\\Http\\A", dependencies=["App\\Db\\Q", "App\\Db\\S", "Other"]), node("App\\Db\\Q"), node("App\\Db\\S"), node("Other")]
    a = Architecture().layer("Source").layer_pattern("Http", r"/^App\\Http/").layer_pattern("Db", r"/^App\\Db/").ruleset({"Http": []}).skip_class_violations({"App\\Http\\A": "App\\Db\\S"})
    out = analysis.violations(a, Facts(frame(spark, rows))).collect()
    assert [(r.rule_key, r.class_name, r.layer) for r in out] == [("ruleset.Http", "App\\Http\\A", "Http")] and "[App\\Db\\Q]" in out[0].message


def test_baseline_survives_line_shifts_and_null_layers(spark, tmp_path):
    a = Architecture().rule("k", R.MustBeFinal("L"))
    old = analysis.violations(a, Facts(frame(spark, [node("A"), node("A") | {"line": 9}]), base_path="/p"))
    baseline.write(old, str(tmp_path / "base"), "/p")
    accepted = baseline.read(spark, str(tmp_path / "base"))
    assert accepted.count() == 1
    now = Facts(frame(spark, [node("A") | {"line": 70, "file": "/p/src/A.php"}, node("B")]), base_path="/p")
    assert [r.class_name for r in analysis.violations(a, now, accepted=accepted).collect()] == ["B"]
    entry = spark.createDataFrame([("r", "m", 1, "f", "", None)], "rule_key string, message string, line int, file string, class_name string, layer string")
    assert baseline.without_accepted(entry, baseline.signatures(entry)).count() == 0


def test_reports(spark):
    a = Architecture().rule("k", R.MustDeclarePropertyVisibility("L"))
    result = analysis.run(a, Facts(frame(spark, [node("A", properties=[("p", "public", False, 9)])])))
    entry = json.loads(report.json_report(result))["violations"][0]
    assert entry == {"rule": "k", "message": result.violations[0].message, "file": "src/A.php", "line": 9, "class": "A", "layer": "L", "fixable": True, "property": "p"}
    text = report.console_report(result)
    assert "Found 1 violation(s):" in text and "→ src/A.php:9" in text and "   Layer: L" in text and result.exit_code == 1
    empty = analysis.run(a, Facts(frame(spark, [node("A")])))
    assert empty.passed and "No violations found" in report.console_report(empty)
    df = analysis.violations(a, Facts(frame(spark, [node("A", properties=[("p", "public", False, 9)])]))).withColumn("layer", F.lit(None).cast("string"))
    assert json.loads(report.json_lines(df).first().value) == entry | {"layer": None}
    assert analysis.fix_plan(a, df).collect()[0].asDict() == {"file": "src/A.php", "action": "add_public_property", "class_name": "A", "member": "p"}


def test_mapping_states(spark):
    nodes = frame(spark, [])
    for state, n in (("missing", 2), ("invalid", 2), ("found", 1)):
        a = Architecture().with_preset(presets.Psr4(["src"]))
        out = analysis.violations(a, Facts(nodes, psr4=composer.mapping(spark, {}), composer_state=state, base_path="/p")).collect()
        assert len(out) == n and all(r.file == "/p/composer.json" and r.layer == "Source" for r in out)
    assert composer.parse("[1]") is None and composer.parse("{") is None and composer.parse(None) is None and composer.parse("{}") == {}


def test_psr4_names(spark):
    mapping = composer.mapping(spark, composer.parse('{"autoload": {"psr-4": {"App\\\\": "src", "App\\\\Deep\\\\": "src/deep/"}}}'))
    rows = [("App\\A", "/p/src/A.php"), ("App\\Wrong", "/p/src/B.php"), ("App\\deep\\C", "/p/src/deep/C.class.php"), ("App\\Deep\\D", "/p/src/deep/D.php"), ("Free", "/p/other/F.php"), ("App\\X", "/p/srcx/X.php")]
    nodes = with_defaults(spark.createDataFrame([(c, f, "L") for c, f in rows], "class_name string, file string, layer string"))
    out = analysis.violations(Architecture().rule("k", R.Psr4Namespace("L")), Facts(nodes, psr4=mapping, composer_state="found", base_path="/p")).collect()
    assert [r.message for r in out] == ["Class [App\\Wrong] must match PSR-4 class [App\\B]"]


def test_source_layer_names_and_scopes():
    a = Architecture().with_preset(presets.Yagni(["src", "lib"]))
    assert a.source_layer(["lib/", "./src"]) == "Source" and a.source_layer(["other"]) == "Source[other/]"
    assert a.register_source_paths("x", ["a"]) == ["a"] and a.register_source_paths("x", ["a", "b"]) == ["a", "b"] and a.register_source_paths("x", None) is None and a.register_source_paths("x", ["c"]) is None


def test_fact_store_extracts_changed_files_only(spark, tmp_path):
    seen = []

    def extract(files):
        seen.append(sorted(r.file for r in files.collect()))
        nodes = frame(spark, []).unionByName(with_defaults(files.select(F.concat(F.lit("C"), "hash").alias("class_name"), "file")))
        empty = {k: spark.createDataFrame([], ddl) for k, ddl in (("anonymous", schemas.ANONYMOUS_CLASSES), ("references", schemas.FILE_REFERENCES), ("instantiations", schemas.FILE_INSTANTIATIONS), ("analyses", schemas.FILE_ANALYSES))}
        return {"nodes": nodes, **empty}

    store = FactStore(spark, str(tmp_path / "facts"))
    files = lambda *rows: spark.createDataFrame([(f, b"", h) for f, h in rows], "file string, content binary, hash string")
    assert store.refresh(files(("a", "1"), ("b", "1")), extract)["nodes"].count() == 2
    out = store.refresh(files(("a", "1"), ("b", "2")), extract)["nodes"]
    assert seen == [["a", "b"], ["b"]] and sorted(r.class_name for r in out.collect()) == ["C1", "C2"]
    store.clear()
    assert store.files().count() == 0
