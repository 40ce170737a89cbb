"""The catalogue of queries: the operators on the driver's tables, read as a codebase, and on small
literal fact rows; and the same in SQL.

Customers and suppliers are classes that live in region/nation folders, orders are their
dependencies, orders with lineitems are classes with methods, conversations are chains of
inheritance, parts are named things. This is an adaptation: the operators are made for source code.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rulespan import rules as R
from rulespan import schemas
from rulespan.functions import predicates as P
from rulespan.functions.names import short_name
from rulespan.operators import baseline, files, graph, incremental, psr4, ruleset, skips, usage
from rulespan.operators.layers import LayerPattern, Layers, prefix_layers_join
from rulespan.plans import analysis, presets, report
from rulespan.plans.architecture import Architecture
from rulespan.rules.base import Facts
from rulespan.sources import composer
from rulespan.sources.facts import with_defaults

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _rows(spark: SparkSession, rows: list, ddl: str) -> DataFrame:
    return spark.createDataFrame(rows, ddl)


def _as_nodes(df: DataFrame) -> DataFrame:
    return with_defaults(df)


def _facts(nodes: DataFrame) -> Facts:
    """Facts without inheritance."""
    empty = F.array().cast("array<string>")
    return Facts(_as_nodes(nodes).withColumns({"parent_classes": empty, "parent_interfaces": empty}))


def _told(found: DataFrame) -> DataFrame:
    return found.select("rule_key", "message", "file", "line", "class_name", "layer")


# --- layers ---

PAGE_LAYERS = {"site": ["site"], "english": ["site/en"], "romance": ["site/fr", "site/es"], "anglophone": ["site/en/"], "eights": ["site/en/8"]}
_PAGE_FILE = "regexp_replace(url, '^https?://[^/]+/', 'site/')"
_PAGE_VALUES = "(VALUES ('site', 0, 'site'), ('english', 1, 'site/en'), ('romance', 2, 'site/fr'), ('romance', 2, 'site/es'), ('anglophone', 3, 'site/en'), ('eights', 4, 'site/en/8')) AS l(layer, ordinal, path)"


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "pages").select("page_id", F.regexp_replace("url", "^https?://[^/]+/", "site/").alias("file"))


@query(f"""SELECT page_id, arg_max(layer, length(path) * 100 - ordinal) AS layer
           FROM (SELECT page_id, {_PAGE_FILE} AS file FROM pages) p JOIN {_PAGE_VALUES} ON starts_with(file || '/', path || '/') GROUP BY page_id""")
def layer_primary_prefix(spark, sf_dir):
    pages = _pages(spark, sf_dir)
    return pages.select("page_id", Layers(PAGE_LAYERS).by_path("file").alias("layer")).where("layer is not null")


@query(f"""SELECT page_id, string_agg(layer, ',' ORDER BY ordinal) AS layers FROM (
             SELECT DISTINCT page_id, layer, ordinal FROM (SELECT page_id, {_PAGE_FILE} AS file FROM pages) p JOIN {_PAGE_VALUES} ON starts_with(file || '/', path || '/')) GROUP BY page_id""")
def layer_all_prefix(spark, sf_dir):
    pages = _pages(spark, sf_dir)
    return pages.select("page_id", F.array_join(Layers(PAGE_LAYERS).all_by_path("file"), ",").alias("layers")).where("layers <> ''")


@query(f"""SELECT page_id, arg_max(layer, length(path) * 100 - ordinal) AS layer, string_agg(DISTINCT ordinal || ':' || layer, ',' ORDER BY ordinal || ':' || layer) AS layers
           FROM (SELECT page_id, {_PAGE_FILE} AS file FROM pages) p JOIN {_PAGE_VALUES} ON starts_with(file || '/', path || '/') GROUP BY page_id""")
def layer_prefix_join(spark, sf_dir):
    declared = [(layer, i, p.rstrip("/")) for i, (layer, paths) in enumerate(PAGE_LAYERS.items()) for p in paths]
    ordinals = F.create_map(*(F.lit(x) for i, layer in enumerate(PAGE_LAYERS) for x in (layer, str(i))))
    out = prefix_layers_join(_pages(spark, sf_dir), _rows(spark, declared, "layer string, ordinal int, path string"), key="page_id", file="file")
    return out.select("page_id", "layer", F.array_join(F.transform("layers", lambda x: F.concat(ordinals[x], F.lit(":"), x)), ",").alias("layers"))


PART_PATTERNS = {"Round": LayerPattern(("/(ring|gear|bolt)$/",), ("/^old/",)), "Small": LayerPattern(("/^small/", "/^tiny/")), "Metal": LayerPattern(("/BOLT|ANVIL/i",), ("/^(red|blue) /",))}
_PART_HITS = """regexp_matches(p_name, '(ring|gear|bolt)$') AND NOT regexp_matches(p_name, '^old') AS a,
  (regexp_matches(p_name, '^small') OR regexp_matches(p_name, '^tiny')) AS b, regexp_matches(p_name, '(?i)BOLT|ANVIL') AND NOT regexp_matches(p_name, '^(red|blue) ') AS c"""


@query(f"""SELECT p_partkey, CASE WHEN a THEN 'Round' WHEN b THEN 'Small' WHEN c THEN 'Metal' END AS layer,
             concat_ws(',', CASE WHEN a THEN 'Round' END, CASE WHEN b THEN 'Small' END, CASE WHEN c THEN 'Metal' END) AS layers FROM (SELECT p_partkey, {_PART_HITS} FROM part)""")
def layer_regex_exclude(spark, sf_dir):
    layers = Layers({}, PART_PATTERNS)
    return _t(spark, sf_dir, "part").select("p_partkey", layers.by_pattern("p_name").alias("layer"), F.array_join(layers.all_by_pattern("p_name"), ",").alias("layers"))


def _parties(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    """Customers or suppliers as (key, class_name, file): region/nation/name."""
    p = kind[0]
    places = _t(spark, sf_dir, "nation").join(_t(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = _t(spark, sf_dir, kind).join(places, F.col(f"{p}_nationkey") == F.col("n_nationkey"))
    return rows.select(F.col(f"{p}_{'custkey' if p == 'c' else 'suppkey'}").alias("key"), F.concat_ws("\\", "r_name", "n_name", f"{p}_name").alias("class_name"), F.concat_ws("/", "r_name", "n_name", f"{p}_name").alias("file"))


_PARTIES = r"""customers AS (SELECT c_custkey AS key, r_name || '\' || n_name || '\' || c_name AS class_name, r_name || '/' || n_name || '/' || c_name AS file, r_name, n_name, c_name AS name
    FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
  suppliers AS (SELECT s_suppkey AS key, r_name || '\' || n_name || '\' || s_name AS class_name, r_name || '/' || n_name || '/' || s_name AS file, r_name, n_name, s_name AS name
    FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""
REGIONS = {"Africa": ["AFRICA"], "America": ["AMERICA"], "Asia": ["ASIA"], "Europe": ["EUROPE"], "Gulf": ["MIDDLE EAST"]}
_REGION_VALUES = "(VALUES ('AFRICA', 'Africa'), ('AMERICA', 'America'), ('ASIA', 'Asia'), ('EUROPE', 'Europe'), ('MIDDLE EAST', 'Gulf')) AS v(r, layer)"


@query(rf"""WITH {_PARTIES}
  SELECT class_name, CASE WHEN regexp_matches(class_name, '\\NATION_1[0-9]\\') AND NOT regexp_matches(class_name, '[02468]$') THEN 'Teens' ELSE layer END AS layer,
    concat_ws(',', CASE WHEN regexp_matches(class_name, '\\NATION_1[0-9]\\') AND NOT regexp_matches(class_name, '[02468]$') THEN 'Teens' END, layer) AS layers
  FROM suppliers LEFT JOIN {_REGION_VALUES} ON r_name = r""")
def layer_chain_priority(spark, sf_dir):
    layers = Layers(REGIONS, {"Teens": LayerPattern((r"/\\NATION_1[0-9]\\/",), ("/[02468]$/",))})
    out = layers.assigned(_parties(spark, sf_dir, "supplier"))
    return out.select("class_name", "layer", F.array_join("layers", ",").alias("layers"))


# --- the ruleset ---

RULESET = {"Africa": ["+Europe"], "America": ["Asia", "+Africa"], "Asia": [], "Europe": ["Gulf"]}
_ALLOWED = "(VALUES ('Africa', 'Europe'), ('Africa', 'Gulf'), ('America', 'Asia'), ('America', 'Africa'), ('America', 'Europe'), ('America', 'Gulf'), ('Europe', 'Gulf')) AS a(a_layer, a_to)"
_EDGES = "edges AS (SELECT DISTINCT c.class_name, s.class_name AS dependency, c.file, c.r_name AS r1, s.r_name AS r2, s.key AS s_key FROM customers c JOIN orders ON o_custkey = c.key JOIN lineitem ON l_orderkey = o_orderkey JOIN suppliers s ON l_suppkey = s.key)"


def _edges(spark: SparkSession, sf_dir: str, orders=None) -> DataFrame:
    """(class_name, dependency): which customers have bought from which suppliers. Names are joined last, to distinct key pairs."""
    orders = _t(spark, sf_dir, "orders") if orders is None else orders
    pairs = orders.join(_t(spark, sf_dir, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).select("o_custkey", "l_suppkey").distinct()
    customers = _parties(spark, sf_dir, "customer").select(F.col("key").alias("o_custkey"), "class_name")
    suppliers = _parties(spark, sf_dir, "supplier").select(F.col("key").alias("l_suppkey"), F.col("class_name").alias("dependency"))
    return pairs.join(customers, "o_custkey").join(suppliers, "l_suppkey").select("class_name", "dependency")


def _party_nodes(spark: SparkSession, sf_dir: str, layers: Layers, suppliers=None) -> DataFrame:
    suppliers = _parties(spark, sf_dir, "supplier") if suppliers is None else suppliers
    rows = _parties(spark, sf_dir, "customer").unionByName(suppliers).select("class_name", "file", F.lit(1).alias("line"))
    return layers.assigned(rows)


_RULESET_SQL = f"""SELECT 'ruleset.' || v1.layer AS rule_key, 'Class [' || class_name || '] in layer [' || v1.layer || '] must not depend on [' || dependency || '] which belongs to layer [' || v2.layer || ']' AS message,
    file, CAST(1 AS INTEGER) AS line, class_name, v1.layer AS layer
  FROM edges JOIN {_REGION_VALUES.replace('AS v(r, layer)', 'AS v1(r, layer)')} ON r1 = v1.r JOIN {_REGION_VALUES.replace('AS v(r, layer)', 'AS v2(r, layer)')} ON r2 = v2.r
  WHERE v1.layer IN ('Africa', 'America', 'Asia', 'Europe') AND v1.layer <> v2.layer AND NOT EXISTS (SELECT 1 FROM {_ALLOWED} WHERE a_layer = v1.layer AND a_to = v2.layer)"""


def _flagship(spark, sf_dir, **options):
    layers = Layers(REGIONS)
    return _told(ruleset.violations(_edges(spark, sf_dir), _party_nodes(spark, sf_dir, layers), layers, RULESET, **options))


@query(f"WITH {_PARTIES}, {_EDGES} {_RULESET_SQL}")
def layer_dependency_violations(spark, sf_dir):
    return _flagship(spark, sf_dir)


@query(rf"WITH {_PARTIES}, {_EDGES} {_RULESET_SQL} AND NOT (regexp_matches(file, '^ASIA/.*_[0-9]/.*$') OR starts_with(file || '/', 'AMERICA/NATION_1/'))")
def ruleset_skip_paths(spark, sf_dir):
    return _flagship(spark, sf_dir, skipped_file=skips.skipped("file", ["ASIA/*_[0-9]/*", "AMERICA/NATION_1/"]))


@query(rf"""WITH {_PARTIES}, {_EDGES} {_RULESET_SQL} AND NOT (class_name LIKE '%7' AND s_key % 2 = 0)""")
def ruleset_class_skips(spark, sf_dir):
    pairs = _edges(spark, sf_dir)
    suppliers = _parties(spark, sf_dir, "supplier").where("key % 2 = 0").select(F.col("class_name").alias("dependency"))
    return _flagship(spark, sf_dir, skips=pairs.where(F.col("class_name").endswith("7")).join(suppliers, "dependency", "left_semi"))


@query(rf"WITH {_PARTIES}, {_EDGES} {_RULESET_SQL} AND r2 = 'EUROPE'")
def external_dependency_allowed(spark, sf_dir):
    layers = Layers(REGIONS)
    nodes = _party_nodes(spark, sf_dir, layers, _parties(spark, sf_dir, "supplier").where(F.col("file").startswith("EUROPE/")))
    return _told(ruleset.violations(_edges(spark, sf_dir), nodes, layers, RULESET))


@query("""WITH RECURSIVE given(layer, entry) AS (VALUES ('Africa', '+Europe'), ('America', 'Asia'), ('America', '+Africa'), ('Europe', 'Gulf'), ('Loop', '+Pool'), ('Pool', '+Loop'), ('Pool', 'Asia'), ('Pool', '+Unknown')),
  walk(layer, entry, seen) AS (
    SELECT layer, entry, [layer] FROM given
    UNION ALL
    SELECT w.layer, g.entry, list_append(w.seen, substr(w.entry, 2)) FROM walk w JOIN given g ON starts_with(w.entry, '+') AND g.layer = substr(w.entry, 2) AND NOT list_contains(w.seen, substr(w.entry, 2)))
  SELECT DISTINCT layer, CASE WHEN starts_with(entry, '+') THEN substr(entry, 2) ELSE entry END AS allowed FROM walk WHERE NOT (starts_with(entry, '+') AND list_contains(seen, substr(entry, 2)))""")
def ruleset_expand_plus(spark, sf_dir):
    rules = {"Africa": ["+Europe"], "America": ["Asia", "+Africa"], "Asia": [], "Europe": ["Gulf"], "Loop": ["+Pool"], "Pool": ["+Loop", "Asia", "+Unknown"]}
    return _rows(spark, [(k, a) for k, v in ruleset.expanded(rules).items() for a in v], "layer string, allowed string")


@query(rf"""WITH {_PARTIES}, {_EDGES}
  SELECT 'layer.asia_not_europe' AS rule_key, 'Class [' || class_name || '] in layer [Asia] must not depend on [' || dependency || '] which belongs to layer [Europe]' AS message, file, CAST(1 AS INTEGER) AS line, class_name, 'Asia' AS layer
  FROM edges WHERE r1 = 'ASIA' AND CASE WHEN s_key % 2 = 0 THEN r2 = 'EUROPE' ELSE contains(replace(dependency, '\', '/') || '/', '/NATION_3/') END""")
def may_not_depend_on(spark, sf_dir):
    # only even suppliers are scanned; the others are told by their names
    nodes = _party_nodes(spark, sf_dir, Layers(REGIONS), _parties(spark, sf_dir, "supplier").where("key % 2 = 0"))
    needed = _edges(spark, sf_dir).groupBy("class_name").agg(F.collect_list("dependency").alias("dependencies"))
    nodes = nodes.join(needed, "class_name", "left")
    return _told(R.MayNotDependOn("Asia", "Europe", "NATION_3").violations(_facts(nodes), "layer.asia_not_europe"))


# --- names ---

_PART_SHORT = r"""CASE p_partkey % 4 WHEN 0 THEN upper(left(p_name, 1)) || replace(substr(p_name, 2), ' ', '') WHEN 1 THEN replace(p_name, ' ', '_') WHEN 2 THEN upper(replace(p_name, ' ', '_')) ELSE replace(p_name, ' ', '') END
  || CASE WHEN p_size > 25 THEN 'Entity' ELSE '' END"""
_PART_NODES = rf"""nodes AS (SELECT p_partkey, p_type || '\' || p_brand || '\' || ({_PART_SHORT}) AS class_name, ({_PART_SHORT}) AS short, 'src/' || p_type || '/' || p_partkey || '.php' AS file, p_size AS line, p_type AS layer,
   p_size % 5 = 0 AS is_interface, p_size % 7 = 0 AS is_abstract, p_brand FROM part)"""


def _part_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.replace("p_name", F.lit(" "), F.lit(""))
    snake = F.replace("p_name", F.lit(" "), F.lit("_"))
    kind = F.col("p_partkey") % 4
    short = F.when(kind == 0, F.concat(F.upper(F.substr("p_name", F.lit(1), F.lit(1))), F.replace(F.substr("p_name", F.lit(2)), F.lit(" "), F.lit("")))).when(kind == 1, snake).when(kind == 2, F.upper(snake)).otherwise(name)
    short = F.concat(short, F.when(F.col("p_size") > 25, "Entity").otherwise(""))
    return _t(spark, sf_dir, "part").select(
        "p_partkey", F.concat_ws("\\", "p_type", "p_brand", short).alias("class_name"), F.concat(F.lit("src/"), "p_type", F.lit("/"), "p_partkey", F.lit(".php")).alias("file"), F.col("p_size").alias("line"), F.col("p_type").alias("layer"),
        (F.col("p_size") % 5 == 0).alias("is_interface"), (F.col("p_size") % 7 == 0).alias("is_abstract"),
        F.array(F.struct(F.upper(snake).alias("name"), F.lit("public").alias("visibility"), F.lit(True).alias("has_explicit_visibility"), F.lit(0).alias("line")), F.struct(snake.alias("name"), F.lit("public").alias("visibility"), F.lit(False).alias("has_explicit_visibility"), F.lit(3).alias("line"))).alias("constants"))


def _violations(key: str, message: str, where: str, line: str = "line") -> str:
    return f"SELECT '{key}' AS rule_key, {message} AS message, file, CAST({line} AS INTEGER) AS line, class_name, layer FROM nodes WHERE {where}"


def _rule(name: str, rule: R.Rule, key: str, nodes, sql: str) -> None:
    """A query that applies one rule."""

    def run(spark, sf_dir):
        return _told(rule.violations(_facts(nodes(spark, sf_dir)), key))

    run.__name__ = name
    query(sql)(run)


_rule("name_suffix", R.ClassNameMustHaveSuffix("PROMO", "Entity"), "name.suffix", _part_nodes, f"WITH {_PART_NODES} " + _violations("name.suffix", "'Class [' || class_name || '] must have suffix [Entity]'", "layer = 'PROMO' AND NOT suffix(short, 'Entity')"))
_rule("name_prefix", R.ClassNameMustNotHavePrefix("SMALL", "small"), "name.prefix", _part_nodes, f"WITH {_PART_NODES} " + _violations("name.prefix", "'Class [' || class_name || '] must not have prefix [small]'", "layer = 'SMALL' AND starts_with(short, 'small')"))
_rule("name_studly", R.ClassNameMustBeStudlyCaps("MEDIUM"), "name.studly", _part_nodes, f"WITH {_PART_NODES} " + _violations("name.studly", "'Class [' || class_name || '] must be declared in StudlyCaps'", "layer = 'MEDIUM' AND NOT regexp_full_match(short, '[A-Z][A-Za-z0-9]*')"))
_rule("name_upper", R.ClassConstantNameMustBeUpperCase("LARGE"), "name.upper", _part_nodes, rf"""WITH {_PART_NODES}, m AS (SELECT n.*, c, l FROM nodes n JOIN (SELECT p_partkey, upper(replace(p_name, ' ', '_')) AS c, 0 AS l FROM part UNION ALL SELECT p_partkey, replace(p_name, ' ', '_'), 3 FROM part) USING (p_partkey))
  SELECT 'name.upper' AS rule_key, 'Class constant [' || class_name || '::' || c || '] must be declared in upper case with underscore separators' AS message, file, CAST(CASE WHEN l = 0 THEN line ELSE l END AS INTEGER) AS line, class_name, layer
  FROM m WHERE layer = 'LARGE' AND NOT regexp_full_match(c, '[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)*')""")
_rule("naming_in_layer", R.NamingConvention("/Entity$/", "ECONOMY", True, "/Brand#1[0-9]/"), "naming.entity", _part_nodes, f"WITH {_PART_NODES} " + _violations(
    "naming.entity", "'Class [' || class_name || '] matching pattern [/Entity$/] must live in layer [ECONOMY], found in layer [' || layer || ']'", "suffix(class_name, 'Entity') AND NOT is_interface AND NOT regexp_matches(class_name, 'Brand#1[0-9]') AND layer <> 'ECONOMY'"))
_rule("must_be_interface", R.MustBeInterface("STANDARD", "/bolt/i"), "class.interface", _part_nodes, f"WITH {_PART_NODES} " + _violations("class.interface", "'Class [' || class_name || '] must be an interface'", "layer = 'STANDARD' AND regexp_matches(class_name, '(?i)bolt') AND NOT is_interface"))
_rule("constant_visibility", R.MustDeclareConstantVisibility("SMALL"), "constants.visibility", _part_nodes, rf"""WITH {_PART_NODES}
  SELECT 'constants.visibility' AS rule_key, 'Constant [' || class_name || '::' || replace(p_name, ' ', '_') || '] must declare an explicit visibility (public, protected, or private)' AS message, file, CAST(3 AS INTEGER) AS line, class_name, layer
  FROM nodes JOIN part USING (p_partkey) WHERE layer = 'SMALL'""")


# --- members: orders are classes, lineitems their methods ---


def _order_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = _t(spark, sf_dir, "lineitem")
    name = F.concat(F.when(F.col("l_linestatus") == "F", "line").otherwise("Line_"), F.col("l_linenumber"))
    method = F.struct(
        name.alias("name"), F.when(F.col("l_returnflag") == "R", "private").otherwise("public").alias("visibility"), (F.col("l_linestatus") == "F").alias("has_return_type"), F.lit(False).alias("is_static"),
        F.col("l_linenumber").alias("param_count"), F.col("l_quantity").cast("int").alias("cyclomatic_complexity"), F.floor(F.col("l_extendedprice") / 1000).cast("int").alias("line_count"),
        (F.col("l_discount") > 0.02).alias("has_explicit_visibility"), F.col("l_linenumber").alias("line"), (F.col("l_tax") == 0).alias("is_magic"))
    methods = line.groupBy("l_orderkey").agg(F.collect_list(method).alias("methods"))
    orders = _t(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("Order\\O"), F.col("o_orderkey").cast("string")).alias("class_name"), F.concat(F.lit("orders/"), "o_orderpriority").alias("file"), F.lit(1).alias("line"), F.col("o_orderstatus").alias("layer"))
    return orders.join(methods, F.col("o_orderkey") == F.col("l_orderkey"), "left")


_METHODS = r"""m AS (SELECT 'Order\O' || o_orderkey AS class_name, 'orders/' || o_orderpriority AS file, o_orderstatus AS layer, CASE WHEN l_linestatus = 'F' THEN 'line' ELSE 'Line_' END || l_linenumber AS name, l_returnflag <> 'R' AS public,
   l_linestatus = 'F' AS typed, CAST(l_quantity AS INTEGER) AS complexity, CAST(floor(l_extendedprice / 1000) AS INTEGER) AS length, l_discount > 0.02 AS explicit, CASE WHEN l_linenumber = 0 THEN 1 ELSE l_linenumber END AS line, l_tax = 0 AS magic FROM orders JOIN lineitem ON o_orderkey = l_orderkey)"""


def _method_rule(name: str, rule: R.Rule, key: str, message: str, where: str) -> None:
    _rule(name, rule, key, _order_nodes, f"WITH {_METHODS} SELECT '{key}' AS rule_key, {message} AS message, file, CAST(line AS INTEGER) AS line, class_name, layer FROM m WHERE {where}")


_method_rule("method_complexity", R.MaxCyclomaticComplexity("F", 40), "method.complexity", "'Method [' || class_name || '::' || name || '()] has cyclomatic complexity of ' || complexity || ', maximum allowed is 40'", "layer = 'F' AND complexity > 40")
_method_rule("method_length", R.MaxMethodLength("O", 80), "method.length", "'Method [' || class_name || '::' || name || '()] is ' || length || ' lines long, maximum allowed is 80'", "layer = 'O' AND length > 80")
_method_rule("name_camel", R.MethodNameMustBeCamelCase("P"), "method.camel", "'Method [' || class_name || '::' || name || '()] must be declared in camelCase'", "layer = 'P' AND NOT magic AND NOT regexp_full_match(name, '[a-z][A-Za-z0-9]*')")
_method_rule("must_have_return_type", R.MustHaveReturnType("F"), "method.typed", "'Public method [' || class_name || '::' || name || '()] must declare a return type'", "layer = 'F' AND public AND NOT typed")
_method_rule("method_visibility", R.MustDeclareMethodVisibility("O"), "method.visibility", "'Method [' || class_name || '::' || name || '()] must declare an explicit visibility (public, protected, or private)'", "layer = 'O' AND NOT explicit")


@query(rf"""WITH {_METHODS}, v AS (SELECT 'method.length' AS rule_key, 'Method [' || class_name || '::' || name || '()] is ' || length || ' lines long, maximum allowed is 60' AS message, file, CAST(line AS INTEGER) AS line, class_name, layer FROM m WHERE layer = 'O' AND length > 60)
  SELECT * EXCLUDE (k) FROM (SELECT *, row_number() OVER (PARTITION BY class_name ORDER BY line, message) AS k FROM v) WHERE k = 1""")
def first_violation_per_class(spark, sf_dir):
    return _told(analysis.first_of_class(R.MaxMethodLength("O", 60).violations(_facts(_order_nodes(spark, sf_dir)), "method.length")))


@query(r"""WITH m AS (SELECT 'Order\O' || o_orderkey AS class_name, o_orderstatus AS layer, CAST(count(DISTINCT l_suppkey) AS INTEGER) AS n FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL)
  SELECT 'class.dependencies' AS rule_key, 'Class [' || class_name || '] has ' || n || ' constructor dependencies, maximum allowed is 4' AS message, '' AS file, CAST(1 AS INTEGER) AS line, class_name, layer FROM m WHERE layer = 'F' AND n > 4""")
def dependency_count_over_limit(spark, sf_dir):
    n = _t(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.countDistinct("l_suppkey").cast("int").alias("n"))
    method = F.expr(f"CAST(named_struct('name', '__Construct', 'visibility', 'public', 'has_return_type', false, 'is_static', false, 'param_count', n, 'cyclomatic_complexity', 1, 'line_count', 1, 'has_explicit_visibility', true, 'line', 1, 'is_magic', true) AS {schemas.METHOD})")
    rows = _t(spark, sf_dir, "orders").join(n, F.col("o_orderkey") == F.col("l_orderkey"))
    nodes = rows.select(F.concat(F.lit("Order\\O"), F.col("o_orderkey").cast("string")).alias("class_name"), F.lit("").alias("file"), F.col("o_orderstatus").alias("layer"), F.array(method).alias("methods"))
    return _told(R.MaxDependencyCount("F", 4).violations(_facts(nodes), "class.dependencies"))


# --- what classes use ---


def _buyers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with their parts as dependencies: brand\\name."""
    part = _t(spark, sf_dir, "part").select("p_partkey", F.concat_ws("\\", "p_brand", "p_name").alias("dependency"))
    needed = _t(spark, sf_dir, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey")).groupBy("l_orderkey").agg(F.collect_set("dependency").alias("dependencies"))
    orders = _t(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("Order\\O"), F.col("o_orderkey").cast("string")).alias("class_name"), F.lit("o").alias("file"), F.col("o_orderstatus").alias("layer"))
    return orders.join(needed, F.col("o_orderkey") == F.col("l_orderkey"))


_USES = r"""u AS (SELECT DISTINCT 'Order\O' || o_orderkey AS class_name, o_orderstatus AS layer, p_brand, p_name FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN part ON l_partkey = p_partkey)"""
_rule("forbidden_dependency", R.MayNotUseClass("P", "Brand#3\\red bolt"), "use.class", _buyers, rf"""WITH {_USES} SELECT DISTINCT 'use.class' AS rule_key, 'Class [' || class_name || '] must not use [Brand#3\red bolt]' AS message, 'o' AS file, CAST(1 AS INTEGER) AS line, class_name, layer
  FROM u WHERE layer = 'P' AND p_brand = 'Brand#3' AND p_name = 'red bolt'""")
_rule("forbidden_namespace", R.MayNotUseNamespace("F", "Brand#1\\", "/[05]$/"), "use.namespace", _buyers, rf"""WITH {_USES} SELECT DISTINCT 'use.namespace' AS rule_key, 'Class [' || class_name || '] must not use namespace [Brand#1\]' AS message, 'o' AS file, CAST(1 AS INTEGER) AS line, class_name, layer
  FROM u WHERE layer = 'F' AND p_brand = 'Brand#1' AND regexp_matches(class_name, '[05]$')""")


def _users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users and days as classes: their kinds of events are calls, constructs and globals."""
    day = _t(spark, sf_dir, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.array_sort(F.collect_set("event_type")).alias("kinds"))
    construct = F.transform(F.filter("kinds", lambda k: k.isin("error", "view")), lambda k: F.when(k == "error", "die").otherwise("echo"))
    return day.select(F.concat(F.lit("U\\"), F.col("user_id").cast("string"), F.lit("\\D"), F.date_format("day", "yyyyMMdd")).alias("class_name"), F.lit("u").alias("file"), F.lit("App").alias("layer"),
                      F.transform("kinds", lambda k: F.upper(k)).alias("function_calls"), construct.alias("language_constructs"), F.transform(F.filter("kinds", lambda k: k.isin("click", "signup", "view")), lambda k: F.concat(F.lit("$_"), F.upper(k))).alias("superglobals"))


_KINDS = r"""k AS (SELECT 'U\' || user_id || '\D' || strftime(ts, '%Y%m%d') AS class_name, list_sort(list(DISTINCT event_type)) AS kinds FROM events GROUP BY ALL)"""
_USER = "'u' AS file, CAST(1 AS INTEGER) AS line, class_name, 'App' AS layer FROM k WHERE"
_rule("forbidden_call", R.MayNotCallFunction("App", "Purchase"), "use.function", _users, f"WITH {_KINDS} SELECT 'use.function' AS rule_key, 'Class [' || class_name || '] must not call function [Purchase()]' AS message, {_USER} list_contains(kinds, 'purchase')")
_rule("forbidden_construct", R.MayNotUseLanguageConstruct("App", "exit"), "use.construct", _users, f"WITH {_KINDS} SELECT 'use.construct' AS rule_key, 'Class [' || class_name || '] must not use language construct [exit]' AS message, {_USER} list_contains(kinds, 'error')")
_rule("accessed_globals", R.MayNotUseSuperglobals("App"), "use.globals", _users, f"""WITH {_KINDS}, g AS (SELECT class_name, list_filter(kinds, lambda x: x IN ('click', 'signup', 'view')) AS globals FROM k)
  SELECT 'use.globals' AS rule_key, 'Class [' || class_name || '] must not access superglobals directly (' || array_to_string(list_transform(globals, lambda x: '$_' || upper(x)), ', ') || ')' AS message, 'u' AS file, CAST(1 AS INTEGER) AS line, class_name, 'App' AS layer FROM g WHERE len(globals) > 0""")


# --- graphs ---


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A turn extends the one before it, spelled in upper case; every user turn implements its conversation."""
    name = F.concat(F.lit("c"), "conv_id", F.lit("t"), "turn")
    before = F.when(F.col("turn") > 0, F.upper(F.concat(F.lit("c"), "conv_id", F.lit("t"), F.col("turn") - 1)))
    talk = F.when(F.col("role") == "user", F.array(F.concat(F.lit("Talk"), "conv_id"))).otherwise(F.array().cast("array<string>"))
    return _t(spark, sf_dir, "conversations").select(name.alias("class_name"), F.lit("talk").alias("file"), F.lit("Talk").alias("layer"), before.alias("extends"), talk.alias("implements"), (F.col("turn") % 2 == 1).alias("is_abstract"))


@query("""WITH RECURSIVE t AS (SELECT 'c' || conv_id || 't' || turn AS class_name, conv_id, turn, role FROM conversations),
    up(class_name, conv_id, step) AS (SELECT class_name, conv_id, turn FROM t UNION SELECT u.class_name, u.conv_id, u.step - 1 FROM up u WHERE u.step > 0),
    classes AS (SELECT u.class_name, list_sort(list('C' || u.conv_id || 'T' || u.step) FILTER (WHERE u.step < t.turn)) AS c, count(*) FILTER (WHERE o.role = 'user') AS n, any_value(t.conv_id) AS conv
      FROM up u JOIN t ON u.class_name = t.class_name LEFT JOIN t o ON o.conv_id = u.conv_id AND o.turn = u.step GROUP BY u.class_name)
  SELECT class_name, coalesce(array_to_string(c, ','), '') AS parent_classes, CASE WHEN n > 0 THEN 'Talk' || conv ELSE '' END AS parent_interfaces FROM classes""")
def ancestors(spark, sf_dir):
    out = graph.with_ancestors(_as_nodes(_turns(spark, sf_dir)))
    return out.select("class_name", F.array_join("parent_classes", ",").alias("parent_classes"), F.array_join("parent_interfaces", ",").alias("parent_interfaces"))


@query(rf"""WITH {_PARTIES}, own AS (SELECT DISTINCT r_name || '\' || n_name AS class_name, 'dep ' || n_name AS d FROM suppliers UNION SELECT DISTINCT r_name, 'dep ' || r_name FROM suppliers UNION SELECT class_name, 'dep ' || name FROM suppliers),
    up AS (SELECT class_name, r_name || '\' || n_name AS p FROM suppliers UNION SELECT class_name, r_name FROM suppliers UNION SELECT r_name || '\' || n_name, r_name FROM suppliers)
  SELECT class_name, d AS dependency FROM own UNION SELECT class_name, p FROM up UNION SELECT u.class_name, o.d FROM up u JOIN own o ON u.p = o.class_name""")
def inherited_dependencies(spark, sf_dir):
    parts = F.split("class_name", r"\\")
    suppliers = _parties(spark, sf_dir, "supplier").select("class_name", F.array_join(F.slice(parts, 1, 2), "\\").alias("extends"), F.get(parts, F.lit(2)).alias("short"))
    nations = suppliers.select(F.col("extends").alias("class_name")).distinct().withColumns({"extends": F.substring_index("class_name", "\\", 1), "short": F.substring_index("class_name", "\\", -1)})
    regions = nations.select(F.col("extends").alias("class_name")).distinct().withColumns({"extends": F.lit(None).cast("string"), "short": F.col("class_name")})
    nodes = reduce(DataFrame.unionByName, (suppliers, nations, regions)).select("class_name", "extends", F.col("class_name").alias("file"), F.array(F.concat(F.lit("dep "), "short")).alias("dependencies"))
    return graph.inherited_dependencies(_as_nodes(nodes))


@query("""SELECT * FROM (VALUES ('t1', 'A'), ('t1', 'B'), ('t2', 'B'), ('t2', 'A'), ('t3', 'A'), ('t4', 'C'), ('t5', 'C')) AS v(trait, "user")""")
def trait_users(spark, sf_dir):
    # t2 composes t1, t3 composes t2, t4 and t5 compose each other
    uses = [("A", "t3"), ("t3", "t2"), ("t2", "t1"), ("B", "t2"), ("t4", "t5"), ("t5", "t4"), ("C", "t4")]
    return graph.trait_users(_rows(spark, uses, "user string, trait string"), _rows(spark, [(f"t{i}",) for i in range(1, 6)], "name string"))


@query("""WITH o AS (SELECT o_orderkey, o_custkey, o_orderkey % 3 AS k FROM orders), used AS (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_shipdate < TIMESTAMP '1997-01-01')
  SELECT 'o' || o_orderkey AS class_name, k = 0 AND o_orderkey + 1 IN (SELECT o_orderkey FROM o) AS is_extended, k = 1 AND o_orderkey + 1 IN (SELECT o_orderkey FROM o) AS is_implemented, o_orderkey IN (SELECT l_orderkey FROM used) AS is_referenced FROM o""")
def usage_flags(spark, sf_dir):
    # of three orders in a row the second extends the first and the third implements the second; early lineitems refer to their orders
    key = F.col("o_orderkey")
    kind = key % 3
    before = F.concat(F.lit("O"), (key - 1).cast("string"))
    nodes = _t(spark, sf_dir, "orders").select(
        F.concat(F.lit("o"), key.cast("string")).alias("class_name"), F.lit("o").alias("file"), (kind == 1).alias("is_interface"), F.when(kind == 1, before).alias("extends"),
        F.when(kind == 2, F.array(before)).otherwise(F.array().cast("array<string>")).alias("implements"))
    early = _t(spark, sf_dir, "lineitem").where("l_shipdate < timestamp'1997-01-01'").select(F.lit("l").alias("file"), F.array(F.concat(F.lit("O"), F.col("l_orderkey").cast("string"))).alias("references"))
    nodes = graph.with_ancestors(_as_nodes(nodes))
    out = usage.with_usage(nodes, _rows(spark, [], schemas.ANONYMOUS_CLASSES), early, _rows(spark, [], schemas.FILE_INSTANTIATIONS), {"is_extended", "is_implemented", "is_referenced"})
    return out.select("class_name", "is_extended", "is_implemented", "is_referenced")


def _unused(rule: R.Rule, key: str, kind: str):
    def run(spark, sf_dir):
        nodes = _t(spark, sf_dir, "orders").select(F.concat(F.lit("Order"), F.col("o_orderkey").cast("string")).alias("class_name"), F.lit("o").alias("file"), F.col("o_orderstatus").alias("layer"), F.lit(True).alias(kind))
        lines = _t(spark, sf_dir, "lineitem").select(F.lit("l").alias("file"), F.array(F.concat(F.lit("ORDER"), F.col("l_orderkey").cast("string"))).alias("references"))
        a = Architecture().rule(key, rule)
        return _told(analysis.violations(a, Facts(nodes, references=lines)))

    return run


for _name, _r, _kind, _text in (
    ("unused_abstract", R.MustBeUsedAbstractClass("P", "/[0-4]$/"), "is_abstract", "Abstract class [' || class_name || '] must be extended by a class or referenced as a dependency"),
    ("unused_interface", R.MustBeUsedInterface("P"), "is_interface", "Interface [' || class_name || '] must be implemented by a class, extended by another interface, or referenced as a dependency"),
    ("unused_trait", R.MustBeUsedTrait("F"), "is_trait", "Trait [' || class_name || '] must be used by a class, trait, or enum, or referenced as a dependency"),
):
    _f = _unused(_r, f"yagni.{_name}", _kind)
    _f.__name__ = _name
    query(f"""WITH n AS (SELECT 'Order' || o_orderkey AS class_name, o_orderstatus AS layer FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey))
      SELECT 'yagni.{_name}' AS rule_key, '{_text}' AS message, 'o' AS file, CAST(1 AS INTEGER) AS line, class_name, layer FROM n WHERE layer = '{_r.layer}'{" AND regexp_matches(class_name, '[0-4]$')" if _r.pattern else ""}""")(_f)


def _talk_facts(spark: SparkSession, sf_dir: str) -> Facts:
    created = _t(spark, sf_dir, "conversations").where("turn % 4 = 2").select(F.lit("x").alias("file"), F.array(F.struct(F.lit(None).cast("string").alias("keyword"), F.concat(F.lit("C"), "conv_id", F.lit("T"), "turn").alias("class_name"))).alias("targets"))
    return Facts(_turns(spark, sf_dir), instantiations=created)


_TALK = "t AS (SELECT 'c' || conv_id || 't' || turn AS class_name, conv_id, turn, role, turn < max(turn) OVER (PARTITION BY conv_id) AS extended FROM conversations)"
_TALK_ROW = "'talk' AS file, CAST(1 AS INTEGER) AS line, class_name, 'Talk' AS layer FROM t WHERE"


@query(f"WITH {_TALK} SELECT 'yagni.extended' AS rule_key, 'Extended class [' || class_name || '] must be declared abstract or instantiated' AS message, {_TALK_ROW} turn % 2 = 0 AND extended AND turn % 4 <> 2")
def extended_not_instantiated(spark, sf_dir):
    a = Architecture().rule("yagni.extended", R.ExtendedClassMustBeAbstractOrInstantiated("Talk"))
    return _told(analysis.violations(a, _talk_facts(spark, sf_dir)))


@query(f"WITH {_TALK} SELECT 'class.final' AS rule_key, 'Class [' || class_name || '] must be declared final' AS message, {_TALK_ROW} turn % 2 = 0 AND NOT extended")
def must_be_final(spark, sf_dir):
    return _told(analysis.violations(Architecture().rule("class.final", R.MustBeFinal("Talk")), _talk_facts(spark, sf_dir)))


_TALK_IMPL = "i AS (SELECT a.class_name, a.turn, a.conv_id, EXISTS (SELECT 1 FROM t b WHERE b.conv_id = a.conv_id AND b.turn <= a.turn AND b.role = 'user') AS talks FROM t a)"


@query(f"WITH {_TALK}, {_TALK_IMPL} SELECT 'must.implement' AS rule_key, 'Class [' || class_name || '] must implement interface [talk7]' AS message, 'talk' AS file, CAST(1 AS INTEGER) AS line, class_name, 'Talk' AS layer FROM i WHERE regexp_matches(class_name, 't[13]$') AND NOT (talks AND conv_id = 7)")
def must_implement(spark, sf_dir):
    return _told(analysis.violations(Architecture().rule("must.implement", R.MustImplementInterface("Talk", "talk7", "/t[13]$/")), Facts(_turns(spark, sf_dir))))


@query(f"WITH {_TALK}, {_TALK_IMPL} SELECT 'may.not' AS rule_key, 'Class [' || class_name || '] must not implement interface [TALK5]' AS message, 'talk' AS file, CAST(1 AS INTEGER) AS line, class_name, 'Talk' AS layer FROM i WHERE talks AND conv_id = 5")
def may_not_implement(spark, sf_dir):
    return _told(analysis.violations(Architecture().rule("may.not", R.MayNotImplementInterface("Talk", "TALK5")), Facts(_turns(spark, sf_dir))))


@query(f"WITH {_TALK}, {_TALK_IMPL} SELECT 'suffix' AS rule_key, 'Class [' || class_name || '] implementing interface [Talk9] must have suffix [t0]' AS message, 'talk' AS file, CAST(1 AS INTEGER) AS line, class_name, 'Talk' AS layer FROM i WHERE talks AND conv_id = 9 AND NOT suffix(class_name, 't0')")
def implementer_suffix(spark, sf_dir):
    return _told(analysis.violations(Architecture().rule("suffix", R.ClassImplementingInterfaceMustHaveSuffix("Talk", "Talk9", "t0")), Facts(_turns(spark, sf_dir))))


@query("SELECT * FROM (VALUES ('base'), ('plain'), ('heir'), ('late'), ('lateheir'), ('user'), ('userheir')) AS v(name)")
def deferred_instantiation(spark, sf_dir):
    # user composes trait T; T creates its parent (Base), itself and static; Late is created as static of a class
    nodes = _as_nodes(_rows(spark, [("Base", None, [], False), ("Plain", None, [], False), ("Heir", "Plain", [], False), ("Late", None, [], False), ("LateHeir", "Late", [], False), ("User", "base", ["T"], False),
                                    ("UserHeir", "User", [], False), ("T", None, [], True), ("Idle", None, [], False)], "class_name string, extends string, traits array<string>, is_trait boolean").withColumn("file", F.lit("f")))
    anonymous = _rows(spark, [("f", 3, "Heir", [], ["T"])], schemas.ANONYMOUS_CLASSES)
    targets = _rows(spark, [("f", [(None, "Plain"), ("static", "Late"), ("parent", "T"), ("self", "T"), ("static", "T")])], schemas.FILE_INSTANTIATIONS)
    return usage.instantiated_names(nodes, anonymous, targets)


# --- mappings, paths and files ---

COMPOSER = '{"autoload": {"psr-4": {"App\\\\": "src/", "": "lib", "\\\\": ["./", "one//two/"], "Data\\\\": ["data", "data/"]}}, "autoload-dev": {"psr-4": {"Tests\\\\": ["tests", 5, "."]}}}'


@query(r"""SELECT * FROM (VALUES ('psr4.empty', 'PSR-4 entry [""] in autoload has an empty namespace prefix; declare a specific namespace prefix such as "App\\"'),
  ('psr4.empty', 'PSR-4 entry ["\"] in autoload has an empty namespace prefix; declare a specific namespace prefix such as "App\\"'),
  ('psr4.root', 'PSR-4 entry ["\"] => ["./"] in autoload maps to the project root; declare a specific directory instead'), ('psr4.root', 'PSR-4 entry ["Tests\"] => ["."] in autoload-dev maps to the project root; declare a specific directory instead')) AS v(rule_key, message)""")
def json_mapping_checks(spark, sf_dir):
    facts = Facts(_as_nodes(_rows(spark, [], "class_name string, file string")), psr4=composer.mapping(spark, composer.parse(COMPOSER)), composer_state="found", base_path="/p")
    a = Architecture().rule("psr4.empty", R.Psr4EmptyNamespacePrefix()).rule("psr4.root", R.Psr4RootPath())
    return analysis.violations(a, facts).select("rule_key", "message")


@query("SELECT event_id, 'autoload' AS section, 'k' || substr(event_type, 1, 2) AS namespace, json_extract_string(props, '$.k') AS path FROM events UNION ALL SELECT event_id, 'autoload-dev', 'dev', 'tests' FROM events WHERE event_type = 'click' UNION ALL SELECT event_id, 'autoload-dev', 'dev', 'more' FROM events WHERE event_type = 'click'")
def mappings_from_json(spark, sf_dir):
    k = F.get_json_object("props", "$.k")
    dev = F.when(F.col("event_type") == "click", F.lit(', "autoload-dev": {"psr-4": {"dev": ["tests", "more"]}}')).otherwise("")
    config = F.concat(F.lit('{"autoload": {"psr-4": {"k'), F.substr("event_type", F.lit(1), F.lit(2)), F.lit('": "'), k, F.lit('"}}'), dev, F.lit("}"))
    return composer.mappings(_t(spark, sf_dir, "events").select("event_id", config.alias("config")), key="event_id", config="config")


@query("SELECT * FROM (VALUES ('psr4.sources', 'PSR-4 source path(s) [NATION_99, nowhere] must exist in composer.json autoload or autoload-dev'), ('psr4.exists', 'PSR-4 source path(s) [NATION_3] declared in composer.json do not exist on disk')) AS v(rule_key, message)")
def source_paths_missing(spark, sf_dir):
    nations = [r.n_name for r in _t(spark, sf_dir, "nation").orderBy("n_nationkey").select("n_name").collect()]  # the fixed 25 nations
    mapping = composer.mapping(spark, {"autoload": {"psr-4": {f"N{i}\\": n + "/" for i, n in enumerate(nations)}}})
    facts = Facts(_as_nodes(_rows(spark, [], "class_name string, file string")), psr4=mapping, composer_state="found", base_path="/p", directories=_t(spark, sf_dir, "nation").where("n_nationkey <> 3").select(F.col("n_name").alias("path")))
    a = Architecture().rule("psr4.sources", R.Psr4SourcePaths(["/p/NATION_1", "NATION_99", "./NATION_2/", "nowhere"])).rule("psr4.exists", R.Psr4DirectoryExists())
    return analysis.violations(a, facts).select("rule_key", "message")


@query(r"""WITH p AS (SELECT page_id, regexp_replace(url, '^https?://[^/]+/', 'site/') || '.php' AS file FROM pages),
    c AS (SELECT page_id, file, ns || regexp_replace(replace(regexp_replace(regexp_replace(substr(file, length(dir) + 2), '\.php$', ''), '(?i)\.class$', ''), '/', '\'), '^\\+', '') AS name, length(dir) AS n
      FROM p JOIN (VALUES ('Site\', 'site'), ('En\', 'site/en'), ('Fr\', 'site/fr')) AS m(ns, dir) ON starts_with(file, dir || '/'))
  SELECT page_id, first(name ORDER BY n DESC) AS expected, CAST(count(*) AS INTEGER) AS candidates FROM c GROUP BY page_id""")
def expected_name_from_path(spark, sf_dir):
    mapping = _rows(spark, [(0, "autoload", "Site\\", "site/"), (1, "autoload", "En\\", "site/en"), (2, "autoload", "Fr\\", "./site//fr")], composer.MAPPING)
    pages = _pages(spark, sf_dir).withColumn("file", F.concat("file", F.lit(".php"))).where(~F.col("file").contains("//") & F.col("file").startswith("site/"))
    out = psr4.expected_names(pages, mapping, "").where(F.size("candidates") > 0)
    return out.select("page_id", F.get("candidates", F.lit(0)).alias("expected"), F.size("candidates").alias("candidates"))


@query("""SELECT doc_id, starts_with(text, chr(65279)) AS has_bom, true AS is_utf8 FROM documents UNION ALL SELECT * FROM (VALUES (-1, true, true), (-2, false, false), (-3, true, false), (-4, false, true)) AS v(a, b, c)""")
def file_encoding(spark, sf_dir):
    rows = _t(spark, sf_dir, "documents").select("doc_id", F.col("text").cast("binary").alias("content"))
    odd = _rows(spark, [(-1, b"\xef\xbb\xbfx"), (-2, b"a\xff"), (-3, b"\xef\xbb\xbf\x80"), (-4, b"")], "doc_id long, content binary")
    return rows.unionByName(odd).select("doc_id", files.has_bom("content").alias("has_bom"), files.is_utf8("content").alias("is_utf8"))


@query(r"""WITH p AS (SELECT page_id, html, regexp_extract(html, '(?s)^(.*?)<(?:nav|footer|div)[ >]', 1) AS before, regexp_matches(html, '<(?:nav|footer|div)[ >]') AS hit FROM pages)
  SELECT page_id, CAST(length(before) - length(replace(before, chr(10), '')) + 1 AS INTEGER) AS line FROM p WHERE hit""")
def first_bad_tag_line(spark, sf_dir):
    return _t(spark, sf_dir, "pages").select("page_id", files.first_match_line("html", "<(?:nav|footer|div)[ >]").alias("line")).where("line is not null")


@query("""WITH g AS (SELECT user_id, CAST(ts AS DATE) AS day, bool_or(event_type = 'purchase') AS declares, bool_or(event_type = 'error') AS effects, min(event_id) FILTER (WHERE event_type = 'error') AS first FROM events GROUP BY ALL)
  SELECT 'file.symbols' AS rule_key, 'File [u' || user_id || '/' || strftime(day, '%Y-%m-%d') || '] should either declare symbols or cause side effects, not both' AS message, CAST(first AS INTEGER) AS line FROM g WHERE declares AND effects""")
def symbols_xor_effects(spark, sf_dir):
    kind = F.col("event_type")
    day = _t(spark, sf_dir, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.bool_or(kind == "purchase").alias("declares_symbols"), F.bool_or(kind == "error").alias("has_side_effects"), F.min(F.when(kind == "error", F.col("event_id"))).cast("int").alias("side_effect_line"))
    analyses = day.select(F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit("/"), F.date_format("day", "yyyy-MM-dd")).alias("file"), F.lit(False).alias("has_utf8_bom"), F.lit(True).alias("has_valid_utf8"), F.lit(None).cast("int").alias("invalid_php_tag_line"), F.lit(True).alias("has_valid_ast"), "declares_symbols", "has_side_effects", "side_effect_line")
    return R.Psr1SymbolsOrSideEffects().violations(Facts(analyses, analyses=analyses), "file.symbols").select("rule_key", "message", "line")


@query(f"SELECT page_id FROM (SELECT page_id, {_PAGE_FILE} AS file FROM pages) WHERE NOT (regexp_full_match(file, '(?s)site/.*[13579]') OR regexp_full_match(file, '(?s)site/[^ef]./..*') OR regexp_full_match(file, '(?s)/w/site/[^ef]./..*'))")
def skip_glob(spark, sf_dir):
    return _pages(spark, sf_dir).where(~skips.skipped("file", ["site/*[13579]", "site/[!ef]?/?*"], "/w")).select("page_id")


@query(f"SELECT page_id FROM (SELECT page_id, {_PAGE_FILE} AS file FROM pages) WHERE NOT starts_with(file || '/', 'site/en/') AND NOT starts_with(file || '/', 'site/fr/8/')")
def skip_prefix(spark, sf_dir):
    return _pages(spark, sf_dir).where(~skips.skipped("file", ["site/en", "./site/fr/8/"])).select("page_id")


# --- runs ---


@query(rf"""WITH {_PARTIES}, old AS (SELECT DISTINCT c.class_name, s.class_name AS dependency FROM customers c JOIN orders ON o_custkey = c.key JOIN lineitem ON l_orderkey = o_orderkey JOIN suppliers s ON l_suppkey = s.key WHERE o_orderdate < TIMESTAMP '1998-01-01'), {_EDGES}
  {_RULESET_SQL} AND NOT EXISTS (SELECT 1 FROM old o WHERE o.class_name = edges.class_name AND o.dependency = edges.dependency)""")
def baseline_filter(spark, sf_dir):
    layers = Layers(REGIONS)
    nodes = _party_nodes(spark, sf_dir, layers)
    before = ruleset.violations(_edges(spark, sf_dir, _t(spark, sf_dir, "orders").where("o_orderdate < timestamp'1998-01-01'")), nodes, layers, RULESET)
    now = ruleset.violations(_edges(spark, sf_dir), nodes, layers, RULESET)
    return _told(baseline.without_accepted(now, baseline.signatures(before)))


@query("""WITH old AS (SELECT doc_id, md5(text) AS h FROM documents WHERE doc_id % 5 <> 0), new AS (SELECT doc_id, md5(CASE WHEN doc_id % 7 = 0 THEN text || '!' ELSE text END) AS h FROM documents WHERE doc_id % 3 <> 0)
  SELECT coalesce(n.doc_id, o.doc_id) AS doc_id, CASE WHEN o.doc_id IS NULL THEN 'added' WHEN n.doc_id IS NULL THEN 'removed' WHEN o.h = n.h THEN 'same' ELSE 'changed' END AS change FROM old o FULL JOIN new n ON o.doc_id = n.doc_id""")
def incremental_changes(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents").select("doc_id", "text")
    new = docs.where("doc_id % 3 <> 0").withColumn("text", F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    return incremental.changes(docs.where("doc_id % 5 <> 0"), new, key="doc_id", content="text")


def _part_architecture() -> Architecture:
    a = Architecture().rule("name.suffix", R.ClassNameMustHaveSuffix("PROMO", "Entity")).rule("name.studly", R.ClassNameMustBeStudlyCaps("MEDIUM")).rule("naming.entity", R.NamingConvention("/Entity$/", "ECONOMY", True, "/Brand#1[0-9]/"))
    return a.rule("off", R.MustBeInterface("LARGE")).skip(["off", "src/*/1?.php"]).skip({"name.studly": "src/MEDIUM/2*"})


_PART_RUN = f"""WITH {_PART_NODES}, v AS (
  {_violations('name.suffix', "'Class [' || class_name || '] must have suffix [Entity]'", "layer = 'PROMO' AND NOT suffix(short, 'Entity')")}
  UNION ALL {_violations('name.studly', "'Class [' || class_name || '] must be declared in StudlyCaps'", "layer = 'MEDIUM' AND NOT regexp_full_match(short, '[A-Z][A-Za-z0-9]*') AND NOT starts_with(file, 'src/MEDIUM/2')")}
  UNION ALL {_violations('naming.entity', "'Class [' || class_name || '] matching pattern [/Entity$/] must live in layer [ECONOMY], found in layer [' || layer || ']'", "suffix(class_name, 'Entity') AND NOT is_interface AND NOT regexp_matches(class_name, 'Brand#1[0-9]') AND layer <> 'ECONOMY'")}),
  w AS (SELECT * FROM v WHERE NOT regexp_full_match(file, 'src/.*/1.[.]php'))"""


def _part_run(spark, sf_dir):
    return analysis.violations(_part_architecture(), Facts(_part_nodes(spark, sf_dir)))


@query(f"{_PART_RUN} SELECT * FROM w")
def violations_union(spark, sf_dir):
    return _told(_part_run(spark, sf_dir))


@query(f"{_PART_RUN} SELECT rule_key, count(*) AS n FROM w GROUP BY rule_key")
def report_counts(spark, sf_dir):
    return _part_run(spark, sf_dir).groupBy("rule_key").agg(F.count("*").alias("n"))


@query(f"{_PART_RUN} SELECT rule_key, layer, count(*) AS n, CAST(grouping(rule_key, layer) AS BIGINT) AS level FROM w GROUP BY ROLLUP (rule_key, layer)")
def report_rollup(spark, sf_dir):
    return analysis.counts(_part_run(spark, sf_dir)).withColumn("level", F.col("level").cast("long"))


@query(f"""{_PART_RUN} SELECT class_name, json_object('rule', rule_key, 'message', message, 'file', file, 'line', line, 'class', class_name, 'layer', layer)::VARCHAR AS value FROM w""")
def report_json(spark, sf_dir):
    return report.json_lines(_part_run(spark, sf_dir)).select(F.get_json_object("value", "$.class").alias("class_name"), "value")


@query(f"""{_PART_RUN}, f AS (SELECT DISTINCT file, 'add_final' AS action, class_name, CAST(NULL AS VARCHAR) AS member FROM nodes WHERE layer = 'LARGE' AND NOT is_interface AND NOT is_abstract)
  SELECT * FROM f UNION ALL SELECT DISTINCT file, 'add_public_constant', class_name, replace(p_name, ' ', '_') FROM nodes JOIN part USING (p_partkey) WHERE layer = 'SMALL'""")
def fix_plan(spark, sf_dir):
    a = Architecture().rule("final", R.MustBeFinal("LARGE")).rule("constants", R.MustDeclareConstantVisibility("SMALL")).rule("name", R.ClassNameMustBeStudlyCaps("SMALL"))
    return analysis.fix_plan(a, analysis.violations(a, Facts(_part_nodes(spark, sf_dir))))


# --- small literal facts, as in unit tests of source checkers ---


def _node(name: str, **fields) -> dict:
    return {"class_name": name, "file": f"src/{name}.php", **fields}


def _nodes(spark: SparkSession, rows: list[dict]) -> DataFrame:
    plain = {"class_name": "string", "file": "string", "extends": "string", "implements": "array<string>", "interface_extends": "array<string>", "traits": "array<string>", "dependencies": "array<string>",
             "is_abstract": "boolean", "is_interface": "boolean", "is_trait": "boolean", "layer": "string"}
    return spark.createDataFrame([tuple(r.get(c) for c in plain) for r in rows], ", ".join(f"{c} {t}" for c, t in plain.items()))


@query("""SELECT * FROM (VALUES ('yagni.interface.must_be_used', 'UnusedInterface'), ('yagni.interface.must_be_used', 'UnusedChildInterface'), ('yagni.abstract_class.must_be_used', 'UnusedAbstract'), ('yagni.trait.must_be_used', 'UnusedTrait')) AS v(rule_key, class_name)""")
def yagni_fixture(spark, sf_dir):
    nodes = _nodes(spark, [
        _node("UsedInterface", is_interface=True), _node("UnusedInterface", is_interface=True), _node("ParentInterface", is_interface=True), _node("UnusedChildInterface", is_interface=True, interface_extends=["ParentInterface"], dependencies=["ParentInterface"]),
        _node("UsedAbstract", is_abstract=True), _node("UnusedAbstract", is_abstract=True), _node("UsedTrait", is_trait=True), _node("UnusedTrait", is_trait=True),
        _node("Consumer", extends="UsedAbstract", implements=["UsedInterface"], traits=["UsedTrait"], dependencies=["UsedAbstract", "UsedInterface", "UsedTrait"])])
    return analysis.violations(Architecture().with_preset(presets.Yagni(["src/"])), Facts(nodes)).select("rule_key", "class_name")


@query(r"SELECT * FROM (VALUES ('ruleset.HTTP', 'App\Http\Page', 'HTTP', 'Class [App\Http\Page] in layer [HTTP] must not depend on [App\Database\Query] which belongs to layer [Database]')) AS v(rule_key, class_name, layer, message)")
def ruleset_fixture(spark, sf_dir):
    nodes = _nodes(spark, [_node("App\\Http\\Page", dependencies=["App\\Database\\Query", "Vendor\\Tool"]), _node("App\\Database\\Query", dependencies=["App\\Http\\Page"])])
    a = Architecture().layer_pattern("HTTP", r"/^App\\Http\\/").layer_pattern("Database", r"/^App\\Database\\/").ruleset({"HTTP": [], "Database": ["HTTP"]})
    return analysis.violations(a, Facts(nodes)).select("rule_key", "class_name", "layer", "message")


@query(r"""SELECT * FROM (VALUES ('A\One', 'Class [A\One] in layer [A] must not depend on [B\Two] which belongs to layer [B]'), ('A\One', 'Class [A\One] in layer [A] must not depend on [C\Far] which belongs to layer [C]'),
  ('B\Two', 'Class [B\Two] in layer [B] must not depend on [A\One] which belongs to layer [A]'), ('B\Two', 'Class [B\Two] in layer [B] must not depend on [C\Far] which belongs to layer [C]')) AS v(class_name, message)""")
def cyclic_fixture(spark, sf_dir):
    # two classes that extend each other; what one depends on, both do
    nodes = _nodes(spark, [_node("A\\One", extends="B\\Two", dependencies=["B\\Two"]), _node("B\\Two", extends="A\\One", dependencies=["A\\One", "C\\Far"]), _node("C\\Far")])
    a = Architecture()
    for layer in "ABC":
        a.layer_pattern(layer, rf"/^{layer}\\/")
    return analysis.violations(a.ruleset({"A": [], "B": [], "C": []}), Facts(nodes)).select("class_name", "message")


@query("""SELECT * FROM (VALUES ('ddd', 33), ('mvc', 58), ('psr1', 12), ('psr12', 15), ('psr15', 4), ('psr4', 5), ('yagni', 4)) AS v(preset, n)""")
def preset_rules(spark, sf_dir):
    made = {"psr4": presets.Psr4(), "psr1": presets.Psr1(), "psr12": presets.Psr12(), "psr15": presets.Psr15(), "yagni": presets.Yagni(), "ddd": presets.Ddd(), "mvc": presets.Mvc()}
    return _rows(spark, [(k, len(Architecture().with_preset(p).rules)) for k, p in made.items()], "preset string, n int")
