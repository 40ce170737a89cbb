"""Helpers and operators on small inputs."""

import random

import pytest
from pyspark.sql import functions as F

from rulespan.functions import names
from rulespan.operators import baseline, files, graph, incremental, psr4, ruleset, skips
from rulespan.operators.layers import LayerPattern, Layers, prefix_layers_join
from rulespan.sources.php_facts import extract
from rulespan.sources.scan import in_scope, scan
from rulespan.streaming import facts as streams


def values(spark, column, rows, ddl="x string"):
    return [r[0] for r in spark.createDataFrame([(x,) for x in rows], ddl).select(column).collect()]


def test_paths():
    for given, want in (("./a//b/", "a/b"), ("a\\b", "a/b"), ("//server/x", "//server/x"), ("/", "/"), ("", ""), ("././a", "a")):
        assert names.normalise(given) == want
    assert names.resolve("src/", "/p/") == "/p/src" and names.resolve("C:\\x", "/p") == "C:/x"


def test_normalised_column_agrees(spark):
    rows = ["./a//b/", "a\\b", "//server/x", "/", "", "././a", "/a/b//", "a"]
    assert values(spark, names.normalised("x"), rows) == [names.normalise(x) for x in rows]


def test_case_folding_is_ascii(spark):
    assert values(spark, names.ascii_lower("x"), ["ÀBC", "İI"]) == ["Àbc", "İi"]


def test_globs(spark):
    for glob, hit, miss in (("*.php", "a/b.php", "a.phpx"), ("a?c", "a/c", "ac"), ("x[!ab]", "xc", "xa"), ("x[a-c]*", "xb/d", "xd"), ("a.b*", "a.b", "acb"), ("p\\*[q]", "p*q", "pxq")):
        assert values(spark, F.col("x").rlike(names.glob_to_regex(glob)), [hit, miss]) == [True, False], glob


def test_patterns(spark):
    for pattern, hit, miss in (("/Entity$/", "AEntity", "EntityA"), ("#^App\\\\#", "App\\X", "MyApp\\X"), ("{x}i", "aXb", "ab"), ("/a.b/s", "a\nb", "ab")):
        assert values(spark, names.matches("x", pattern), [hit, miss, None]) == [True, False, False]
    for bad in ("abc", "/abc", "/a/q", ""):
        with pytest.raises(ValueError):
            names.pattern_to_regex(bad)


def test_layers(spark):
    layers = Layers({"App": ["src/App"], "Sub": ["src/App/Sub/", "lib"], "Twin": ["src/App"], "File": ["src/one.php"]}, {"Pat": LayerPattern(("/X$/", "/Y$/"), ("/^No/",))})
    rows = [("AX", "src/App/Sub/a.php"), ("A", "src/Application/a.php"), ("NoX", "src/App/b.php"), ("F", "src/one.php"), ("Y", "")]
    got = layers.assigned(spark.createDataFrame(rows, "class_name string, file string")).collect()
    assert [(r.layer, r.layers) for r in got] == [("Pat", ["Pat", "App", "Sub", "Twin"]), (None, []), ("App", ["App", "Twin"]), ("File", ["File"]), ("Pat", ["Pat"])]
    declared = [(name, i, names.normalise(p)) for i, (name, ps) in enumerate(layers.paths.items()) for p in ps]
    joined = {r.file: (r.layer, r.layers) for r in prefix_layers_join(spark.createDataFrame(rows, "class_name string, file string"), spark.createDataFrame(declared, "layer string, ordinal int, path string"), key="file", file="file").collect()}
    assert joined == {"src/App/Sub/a.php": ("Sub", ["App", "Sub", "Twin"]), "src/App/b.php": ("App", ["App", "Twin"]), "src/one.php": ("File", ["File"])}


def test_closures(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 1), (5, 5), (None, 1)], "src int, dst int")
    assert {tuple(r) for r in graph.closure(edges).collect()} == {(a, b) for a in (1, 2, 3, 4) for b in (1, 2, 3)} | {(5, 5)}
    assert graph.closure(edges.where("false")).count() == 0


def test_closure_of_a_long_chain_and_of_any_graph(spark):
    n = 300
    chain = graph.closure(spark.createDataFrame([(i, i + 1) for i in range(n)], "src int, dst int"))
    assert chain.count() == n * (n + 1) // 2 == chain.distinct().count()
    r = random.Random(3)
    edges = {(r.randrange(40), r.randrange(40)) for _ in range(50)} | {(100 + i, 100 + (i + 1) % 11) for i in range(11)}
    reached = set(edges)
    while more := {(a, d) for a, b in reached for c, d in edges if b == c} - reached:
        reached |= more
    assert {tuple(x) for x in graph.closure(spark.createDataFrame(sorted(edges), "src int, dst int")).collect()} == reached


def test_last_declaration_counts(spark):
    df = spark.createDataFrame([("A", "x", 1, 1), ("A", "x", 9, 2), ("A", "a", 99, 3), ("B", "x", 1, 4)], "class_name string, file string, line int, v int")
    assert {(r.class_name, r.v) for r in graph.last_by_key(df).collect()} == {("A", 2), ("B", 4)}


def test_ruleset_expansion():
    assert ruleset.expanded({"A": ["+B", "X"], "B": ["+C"], "C": ["+B", "Y"], "D": ["+Z"]}) == {"A": ["B", "C", "Y", "X"], "B": ["C", "Y"], "C": ["B", "Y"], "D": ["Z"]}


def test_skips(spark):
    rows = ["/p/src/a.php", "/p/srcx/a.php", "/p/lib/gen/x.php", "/other/src/a.php"]
    assert values(spark, skips.skipped("x", ["src/", "lib/*/x.php"], "/p"), rows) == [True, False, True, False]
    assert values(spark, skips.skipped("x", []), rows) == [False] * 4


def test_incremental(spark):
    old, new = (spark.createDataFrame(r, "file string, text string") for r in ([("a", "1"), ("b", "1"), ("c", None)], [("a", "1"), ("b", "2"), ("c", None), ("d", "1")]))
    assert {tuple(r) for r in incremental.changes(old, new, key="file", content="text").collect()} == {("a", "same"), ("b", "changed"), ("c", "same"), ("d", "added")}
    hits, misses = incremental.split_by_cache(new.withColumnRenamed("text", "hash"), old.withColumnRenamed("text", "hash"))
    assert [r.file for r in hits.collect()] == ["a"] and {r.file for r in misses.collect()} == {"b", "c", "d"}


def test_file_facts(spark):
    df = spark.createDataFrame([(b"\xef\xbb\xbfa",), (b"\xff",), (b"",), (None,)], "x binary")
    assert [tuple(r) for r in df.select(files.has_bom("x"), files.is_utf8("x")).collect()] == [(True, True), (False, False), (False, True), (False, True)]
    assert values(spark, files.first_match_line("x", "z"), ["z", "a\nb\nz z", "no"]) == [1, 3, None]


def test_nearest_folder(spark):
    folders = spark.createDataFrame([("a",), ("a/b",), ("z",)], "path string")
    got = psr4.nearest_folder(spark.createDataFrame([("a/b/c/d.php",), ("a/x.php",), ("q/x.php",)], "file string"), folders)
    assert {tuple(r) for r in got.collect()} == {("a/b/c/d.php", "a/b"), ("a/x.php", "a")}


def test_scan(spark, tmp_path):
    for name in ("src/A.php", "src/_B.php", "src/gen/C.php", "src/d.txt", "lib/E.php"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("<?php\n")
    out = scan(spark, ["src", "src/gen", "lib", "none"], base_path=str(tmp_path), skip=["lib"])
    names_ = sorted(r.file.rpartition("/")[2] for r in out.collect())
    assert names_ in (["A.php", "C.php"], ["A.php", "C.php", "_B.php"])
    assert scan(spark, ["none"], base_path=str(tmp_path)).count() == 0
    assert in_scope(out, out.where(F.col("file").endswith("A.php"))).count() == 1


def test_stream_of_facts(spark, tmp_path):
    from rulespan import rules as R
    from rulespan.sources.facts import with_defaults

    nodes = with_defaults(spark.createDataFrame([("A\\ok_not", "a.php", "L"), ("A\\Fine", "b.php", "L")], "class_name string, file string, layer string"))
    nodes.write.parquet(str(tmp_path / "in"))
    got = []
    stream = streams.row_violations(streams.read_nodes(spark, str(tmp_path / "in")), {"studly": R.ClassNameMustBeStudlyCaps("L"), "final": R.ClassNameMustHaveSuffix("L", "Fine")})
    streams.write_each(stream, lambda df, _: got.extend(df.collect()), str(tmp_path / "checkpoint")).awaitTermination(120)
    assert sorted((r.rule_key, r.class_name) for r in got) == [("final", "A\\ok_not"), ("studly", "A\\ok_not")]
    with pytest.raises(ValueError):
        streams.row_violations(nodes, {"x": R.MustBeFinal("L")})


def test_a_failed_refresh_leaves_no_facts(spark, tmp_path):
    from rulespan.sources.facts import TABLES, FactStore

    files = spark.createDataFrame([("a.php", bytearray(b"<?php class A {}"), "1"), ("b.php", bytearray(b"<?php class B {}"), "2")], "file string, content binary, hash string")
    store = FactStore(spark, str(tmp_path))

    def broken(stale):
        tables = extract(stale)
        tables["analyses"] = tables["analyses"].select("file", F.raise_error(F.lit("lost")).cast("boolean").alias("has_utf8_bom"), *tables["analyses"].columns[2:])
        return tables

    with pytest.raises(Exception, match="lost"):
        store.refresh(files, broken)
    assert list(TABLES)[-1] == "analyses" and (tmp_path / "default" / "nodes").exists() and store.files().count() == 0 and store.read("nodes").count() == 0
    for _ in range(2):
        tables = store.refresh(files, extract)
        assert sorted(r.class_name for r in tables["nodes"].collect()) == ["A", "B"] and tables["analyses"].count() == 2


def test_a_baseline_holds_violations_without_class_file_or_layer(spark):
    columns = "rule_key string, message string, file string, line int, class_name string, layer string"
    found = spark.createDataFrame([("r", "File [/p/a.php] in /x/p/a.php", "/p/a.php", 1, None, None), ("r", "m", None, 1, None, "L"), ("r", "m", None, 1, "C", "L")], columns)
    accepted = baseline.signatures(found.where("class_name IS NULL"), "/p")
    assert {tuple(r) for r in accepted.collect()} == {("r", "File [a.php] in /x/p/a.php", "a.php", None, None), ("r", "m", None, None, "L")}
    assert [r.class_name for r in baseline.without_accepted(found, accepted, "/p").collect()] == ["C"]
