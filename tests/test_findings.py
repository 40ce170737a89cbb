"""Queries against their SQL on rows that the smallest tables lack, and what else findings of reviews were about."""

import duckdb
from pyspark.sql import functions as F

from rulespan.catalogue import QUERIES, SQL
from rulespan.functions.names import is_absolute, normalise, normalised, resolve, told
from rulespan.operators import baseline
from rulespan.operators.skips import skipped
from rulespan.sources import php_facts
from rulespan.sources.php_tokens import tokenize
from rulespan.sources.scan import scan


def test_ddd_findings_at_the_limits(spark, tmp_path):
    # all sizes, with each combination of what depends on a key's remainders by 3, 11 and 13
    rows = [(size * 429 + key, f"Brand#{key}", "SMALL", size) for size in range(1, 51) for key in (0, 1, 2, 11, 13, 22, 26, 33, 39, 143)]
    spark.createDataFrame(rows, "p_partkey long, p_brand string, p_type string, p_size int").write.parquet(str(tmp_path / "part.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet/*.parquet'")
    want = sorted(con.execute(f"SELECT rule_key, class_name FROM ({SQL['ddd_findings']})").fetchall())
    assert sorted(tuple(r) for r in QUERIES["ddd_findings"](spark, str(tmp_path)).select("rule_key", "class_name").collect()) == want


def test_paths_with_a_store(spark):
    paths = {"hdfs://n:1//a//b/": "hdfs://n:1/a/b", "file:///a/b": "file:/a/b", "file:/": "file:/", "s3a://x/": "s3a://x/", "C:/a//b": "C:/a/b", "./a/b/": "a/b", "//x//y": "//x/y", "a:b/c": "a:b/c"}
    assert {p: normalise(p) for p in paths} == paths
    rows = spark.createDataFrame([(p,) for p in paths if p != "s3a://x/"], "p string").select("p", normalised("p").alias("n")).collect()
    assert {r.p: r.n for r in rows} == {p: n for p, n in paths.items() if p != "s3a://x/"}
    assert resolve("src", "file:///p/") == "file:/p/src" and resolve("hdfs://n/q/", "/p") == "hdfs://n/q" and is_absolute("file:/p") and not is_absolute("a:b/c")
    assert (told("file:///p/"), told("/p"), told("hdfs://n/p")) == ("/p", "/p", "hdfs://n/p")


def test_base_with_a_store(spark, tmp_path):
    for name in ("a.php", "d/e.php", "skip/n.php", "skip/_o.php", "_skip/p.php", "gone/q.php"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("<?php\n")
    for base in (str(tmp_path), f"file:{tmp_path}", f"file://{tmp_path}/"):
        found = scan(spark, [".", "d", f"file:{tmp_path}/d"], base_path=base, skip=["skip", "_skip/*", f"file:{tmp_path}/gone"])
        assert sorted(r.file for r in found.collect()) == [f"{tmp_path}/a.php", f"{tmp_path}/d/e.php"]
        found = scan(spark, [".", "d"], base_path=f"{base}/d/..", skip=["d/x*"])
        assert sorted(r.file for r in found.where("file not like '%skip%' and file not like '%gone%'").collect()) == [f"{tmp_path}/a.php", f"{tmp_path}/d/e.php"]
    files = spark.createDataFrame([("hdfs://n/p/skip/a.php",), ("hdfs://n/p/b.php",)], "file string")
    assert [r[0] for r in files.select(skipped("file", ["skip"], "hdfs://n/p")).collect()] == [True, False]
    found = spark.createDataFrame([("k", "File [/p/a.php]", "/p/a.php", "", "")], "rule_key string, message string, file string, class_name string, layer string")
    assert tuple(baseline.signatures(found, "file:///p").first()) == ("k", "File [a.php]", "a.php", "", "")


def test_files_of_one_partition_are_parsed_by_many_tasks(spark):
    code = "<?php class C%d extends B { function m() { return new class extends D { use T; }; } }"
    rows = [(f"C{i}.php", bytearray((code % i).encode())) for i in range(64)] + [("empty.php", None), ("broken.php", bytearray(b"<?php 'x"))]
    files = spark.createDataFrame(rows, "file string, content binary").coalesce(1)
    tables = php_facts.extract(files, only=["anonymous", "analyses"])
    assert sorted(tables) == ["analyses", "anonymous"]
    assert tables["anonymous"].select(F.spark_partition_id()).distinct().count() > 1
    assert sorted(tuple(r) for r in tables["anonymous"].collect()) == sorted((f"C{i}.php", 1, "D", [], ["T"]) for i in range(64))
    assert {r.file: (r.has_valid_utf8, r.has_valid_ast) for r in tables["analyses"].collect()} == {f: (True, f != "broken.php") for f, _ in rows}


def test_a_file_is_tokenized_once(monkeypatch):
    seen = []
    monkeypatch.setattr(php_facts, "tokenize", lambda source: seen.append(source) or tokenize(source))
    assert php_facts.facts_of("a.php", b"<?php new A; ?><? x")["analyses"][0]["invalid_php_tag_line"] == 1 and len(seen) == 1
