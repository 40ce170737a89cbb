"""The corpus operators' queries on the driver's tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rulespan.llm import decontamination, html_extract, jaccard_join, knn_join, line_dedup, quality, secret_scan, source_mixing, token_counts, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_knn_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long").alias("id"), knn_join.scaled(F.col("embedding"), 256.0).alias("v"))
    return knn_join.knn_join(rows.where(F.col("id") % 50 == 0), rows, 5)


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(_table(spark, sf_dir, "documents"), width=4, num=85, den=100)


def op3_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(_table(spark, sf_dir, "pages"), ["page_id", "url"])


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(_table(spark, sf_dir, "documents"), ["doc_id"])


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(_table(spark, sf_dir, "documents"), ["doc_id"])
    return found.select("doc_id", "place", F.md5("core").alias("core_md5"), F.length("core").alias("n_chars"), "vote", "is_secret")


#: Target shares by language and topic; sources are tempered.
LANGUAGES = {"en": 0.5, "fr": 0.2, "de": 0.2, "es": 0.1}
TOPICS = {"tabular": 0.1, "brief": 0.2, "article": 0.4, "long": 0.3}


def with_topic(docs: DataFrame) -> DataFrame:
    """``docs`` with ``n_tokens`` (words) and ``topic``. The tables have no topics, so a text's form stands for one."""
    words = F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).cast("long"), F.lit(0))
    out = docs.withColumn("n_tokens", words)
    return out.withColumn("topic", F.when(F.contains("text", F.lit(" | ")), "tabular").when(F.col("n_tokens") < 100, "brief").when(F.col("n_tokens") < 600, "article").otherwise("long"))


def mixed(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    docs = with_topic(docs)
    sources = source_mixing.tempered(docs.groupBy("source").agg(F.sum("n_tokens").alias("tokens")), "source")
    return source_mixing.mix(docs, {"topic": TOPICS, "lang": LANGUAGES, "source": sources}, key=key)


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixed(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "source", "lang", "topic", "n_tokens", F.round(F.col("probability") * 1_000_000).cast("long").alias("probability_ppm"), "sampled")


def mixing_sql() -> str:
    """The mixing query for DuckDB: a common table expression for each raking and each step of the scale."""
    case = lambda name, shares: f"CASE {name} " + " ".join(f"WHEN '{v}' THEN {t}" for v, t in shares.items()) + " END"
    target = {"topic": case("topic", TOPICS), "lang": case("lang", LANGUAGES), "source": "sqrt(CAST(sum(tokens) OVER (PARTITION BY source) AS DOUBLE))"}
    steps, name, n = [], "raked0", 0
    for _ in range(source_mixing.ROUNDS):
        for dimension, share in target.items():
            n += 1
            steps.append(f"""
        sums{n} AS (SELECT *, {share} AS target, sum(weight) OVER (PARTITION BY {dimension}) AS now, count(*) OVER (PARTITION BY {dimension}) AS n FROM {name}),
        raked{n} AS MATERIALIZED (
          SELECT topic, lang, source, tokens,
                 weight * CASE WHEN target IS NOT NULL AND now > 0 THEN target / sum(target / n) OVER () * sum(weight) FILTER (target IS NOT NULL) OVER () / now ELSE 1 END AS weight FROM sums{n}),""")
            name = f"raked{n}"
    scales = ["scale0 AS (SELECT 0.0::DOUBLE AS scale)"]
    for k in range(1, source_mixing.SCALE_STEPS + 2):
        capped = "scale > 0 AND scale * weight >= tokens"
        scales.append(f"""scale{k} AS MATERIALIZED (
          SELECT coalesce(({source_mixing.KEEP} * sum(tokens) - coalesce(sum(tokens) FILTER ({capped}), 0)) / sum(weight) FILTER (NOT ({capped})), any_value(scale)) AS scale FROM {name}, scale{k - 1})""")
    return rf"""
        WITH docs AS (
          SELECT *, CASE WHEN contains(text, ' | ') THEN 'tabular' WHEN n_tokens < 100 THEN 'brief' WHEN n_tokens < 600 THEN 'article' ELSE 'long' END AS topic
          FROM (SELECT doc_id, source, lang, text, CAST(len(regexp_extract_all(text, '[^ 	-
]+')) AS BIGINT) AS n_tokens FROM documents)),
        raked0 AS (SELECT topic, lang, source, sum(n_tokens) AS tokens, CAST(sum(n_tokens) AS DOUBLE) AS weight FROM docs GROUP BY ALL),{''.join(steps)}
        {', '.join(scales)},
        shares AS (SELECT topic, lang, source, CASE WHEN tokens > 0 THEN least(1.0, scale * weight / tokens) ELSE 0 END AS p FROM {name}, scale{source_mixing.SCALE_STEPS + 1})
        SELECT d.doc_id, d.source, d.lang, d.topic, d.n_tokens, CAST(round(p * 1000000) AS BIGINT) AS probability_ppm,
               CAST('0x' || substr(md5(CAST(d.doc_id AS VARCHAR)), 1, 8) AS BIGINT) / 4294967296.0 < p AS sampled
        FROM docs d JOIN shares s ON d.topic = s.topic AND d.lang = s.lang AND d.source = s.source"""


def op7_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.responses(_table(spark, sf_dir, "pages"), "page_id")
    return warc.derive(records, ["page_id"]).drop("record", "source_headers")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.drop_recurring_lines(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.length("text").cast("long").alias("n_chars"), F.md5("text").alias("text_md5"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.find_overlaps(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


#: A text's lower-cased words, for DuckDB.
_WORDS = r"list_filter(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '')"


def jaccard_sql(width: int, num: int, den: int) -> str:
    """The components for DuckDB: intersections counted shingle by shingle, and all that links reach."""
    return f"""
        WITH RECURSIVE d AS (SELECT doc_id, coalesce({_WORDS}, []) AS w FROM documents),
        s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= {width} THEN list_transform(range(len(w) - {width - 1}), lambda k: array_to_string(w[k + 1 : k + {width}], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM d),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
        links AS (SELECT a, b FROM pairs JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE {den} * common >= {num} * (x.n + y.n - common)),
        ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
        reached(doc_id, seen) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.doc_id, w.b FROM reached r JOIN ways w ON r.seen = w.a)
        SELECT doc_id, coalesce(any_value(n), 0) AS n_shingles, min(seen) AS component_id FROM reached LEFT JOIN n USING (doc_id) GROUP BY doc_id"""


def decontamination_sql() -> str:
    """The overlaps for DuckDB: seeds as strings, and every stretch of every alignment that is hit."""

    def seeds(table: str) -> str:
        parts = []
        for number, mask in enumerate(decontamination.MASKS):
            key = " || ' ' || ".join(f"w[p + {i + 1}]" for i, c in enumerate(mask) if c == "1")
            parts.append(f"SELECT id, {number} AS mask, p, {key} AS key FROM (SELECT id, w, unnest(range(len(w) - {len(mask) - 1})) AS p FROM {table})")
        return " UNION ALL ".join(parts)

    return f"""
        WITH d AS (SELECT row_number() OVER () AS id, doc_id, {_WORDS} AS w FROM documents WHERE text IS NOT NULL),
        i AS (SELECT row_number() OVER () AS id, item_id, {_WORDS} AS w FROM benchmark WHERE text IS NOT NULL),
        ds AS ({seeds('d')}), i_s AS ({seeds('i')}),
        hits AS (SELECT ds.id AS d, i_s.id AS i, ds.p - i_s.p AS shift, count(*) AS n FROM ds JOIN i_s ON ds.mask = i_s.mask AND ds.key = i_s.key GROUP BY ALL),
        places AS (
          SELECT h.d, h.i, shift, d.w AS dw, i.w AS iw, least({decontamination.MIN_TOKENS}, len(i.w)) AS fewest, unnest(range(greatest(0, shift), least(len(d.w), shift + len(i.w)))) AS pos
          FROM hits h JOIN d ON h.d = d.id JOIN i ON h.i = i.id),
        sums AS (SELECT d, i, shift, fewest, pos, sum(CAST(dw[pos + 1] = iw[pos - shift + 1] AS INTEGER)) OVER (PARTITION BY d, i, shift ORDER BY pos) AS upto, CAST(dw[pos + 1] = iw[pos - shift + 1] AS INTEGER) AS same FROM places),
        stretches AS (
          SELECT a.d, a.i, b.pos - a.pos + 1 AS tokens, b.upto - a.upto + a.same AS equal, a.pos AS start FROM sums a JOIN sums b ON a.d = b.d AND a.i = b.i AND a.shift = b.shift AND b.pos - a.pos + 1 >= a.fewest
          WHERE (b.upto - a.upto + a.same) * 100 >= {round(100 * decontamination.MIN_SHARE)} * (b.pos - a.pos + 1)),
        best AS (SELECT d, i, max((tokens, equal, -start)) AS x FROM stretches GROUP BY d, i)
        SELECT d.doc_id, i.item_id, CAST(n AS INTEGER) AS n_hits, CAST(-x[3] AS INTEGER) AS overlap_start, CAST(x[1] AS INTEGER) AS overlap_tokens, CAST(x[2] AS INTEGER) AS equal_tokens
        FROM best JOIN (SELECT d, i, sum(n) AS n FROM hits GROUP BY d, i) h ON best.d = h.d AND best.i = h.i JOIN d ON best.d = d.id JOIN i ON best.i = i.id"""


def held_out(key) -> F.Column:
    return F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(5)) == 0


#: Documents with at least this score are kept.
QUALITY_CUT = 0.3


def quality_scores(docs: DataFrame, labels: DataFrame, keys: list[str] | None = None, name: str = "score") -> DataFrame:
    usable = labels.where(~held_out(F.col("doc_id"))).select("doc_id", F.col("quality").alias("label"))
    return quality.score(docs, quality.fit(docs, usable), keys, name=name)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return scores.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= QUALITY_CUT).cast("int").alias("predicted"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    op1_knn_join, op2_jaccard_join, op3_html_extract, op4_token_counts, op5_secret_scan, op6_source_mixing, op7_warc_derivatives, op8_line_dedup, op9_decontamination, op10_quality,
)}

SQL: dict[str, str] = {
    "op6_source_mixing": mixing_sql(),
    "op5_secret_scan": secret_scan.duckdb_sql(),
    "op2_jaccard_join": jaccard_sql(4, 85, 100),
    "op9_decontamination": decontamination_sql(),
    "op8_line_dedup": r"""
        WITH lines AS (
          SELECT doc_id, line - 1 AS line, raw,
                 list_filter(string_split_regex(regexp_replace(raw, '[^\x20\x09-\x0D]*[0-9][^\x20\x09-\x0D]*', '<*>', 'g'), '[\x20\x09-\x0D]+'), lambda t: t <> '') AS tokens
          FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents)),
        kept AS (SELECT *, len(tokens) AS size, tokens[1] AS a, tokens[2] AS b FROM lines WHERE len(tokens) >= 5),
        tokens AS (SELECT doc_id, line, size, a, b, unnest(tokens) AS token, generate_subscripts(tokens, 1) AS place FROM kept),
        constants AS (SELECT size, a, b, place, token FROM tokens GROUP BY ALL HAVING count(DISTINCT doc_id) >= 10),
        made AS (
          SELECT t.doc_id, t.line, t.size, t.a, t.b, list(t.place || ' ' || t.token ORDER BY t.place) AS fixed
          FROM tokens t JOIN constants c ON t.size = c.size AND t.a = c.a AND t.b = c.b AND t.place = c.place AND t.token = c.token
          GROUP BY ALL HAVING count(*) FILTER (t.token <> '<*>') * 100 >= t.size * 80),
        spread AS (SELECT size, a, b, fixed, min((doc_id, line)) AS first FROM made GROUP BY ALL HAVING count(DISTINCT doc_id) >= 10),
        gone AS (SELECT m.doc_id, m.line FROM made m JOIN spread s ON m.size = s.size AND m.a = s.a AND m.b = s.b AND m.fixed = s.fixed WHERE (m.doc_id, m.line) <> s.first),
        texts AS (
          SELECT l.doc_id, CAST(count(*) AS INTEGER) AS n_lines, CAST(count(g.line) AS INTEGER) AS n_dropped,
                 coalesce(string_agg(l.raw, chr(10) ORDER BY l.line) FILTER (WHERE g.line IS NULL), '') AS text
          FROM lines l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.line = g.line GROUP BY l.doc_id)
        SELECT doc_id, n_lines, n_dropped, CAST(length(text) AS BIGINT) AS n_chars, md5(text) AS text_md5 FROM texts""",
    "op1_knn_join": """
        WITH v AS (
          SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
          WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (
          SELECT q.vec_id AS query_id, d.vec_id, CAST(list_inner_product(q.v, d.v) AS BIGINT) AS score
          FROM v q JOIN v d ON q.vec_id <> d.vec_id WHERE q.vec_id % 50 = 0),
        r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
}
