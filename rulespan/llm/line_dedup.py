"""Line dedup with a log-template tree, in DataFrame operations only.

A line goes down a tree of fixed depth: its number of tokens, then its leading tokens, tokens with
a digit being variable fields. In a leaf, the tokens that many documents have at a place are
constants of the template and all others are wildcards. Templates that recur across documents
are boilerplate: of their lines the first stays and the others are dropped.

Lines that recur word for word have rules of their own, if asked for: long ones (passages) from a
few documents on that are no versions of each other, short ones from more documents on. Then a
document that shares a line with a shorter one, and is much like it, is a version of that one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rulespan.llm.common import cut

#: Documents in which a template, and each of its constants, must occur.
MIN_DOCS = 10
#: Leading tokens on the way to a leaf; shorter lines than ``MIN_TOKENS`` are never templates.
DEPTH, MIN_TOKENS = 2, 5
#: The least share of constants without a digit among a template's tokens, in percent.
CONSTANT_PERCENT = 80
#: What the pipeline asks for besides: lines of so many tokens recur from so many documents on that are no
#: versions of each other, lines too short for a template, if they have a letter, from so many documents on.
LONG_TOKENS, LONG_DOCS, SHORT_DOCS = 50, 2, 50
#: Documents are compared if they share a line of so many tokens. They are versions of each other if lines that
#: both have hold so large a share of their characters, or so large a share of the other lines' shingles is common.
VERSION_TOKENS, SAME_SHARE, REST_SHARE, REST_WIDTH = 20, 0.8, 0.2, 3
#: Up to so many leaves (16 bytes each) and constants (some 100 bytes each) are sent to all tasks; more are joined by a shuffle.
BROADCAST_LEAVES, BROADCAST_CONSTANTS = 100_000, 200_000

#: A token with a digit. Only a token's start is tried, so long tokens take linear time.
_VARIABLE = r"(?<![^ ])[^ 0-9]*+[0-9][^ ]*+"
_BLANKS = " \t\x0b\x0c\r"
#: A row: its document, and a hash of its text, as rows of one id may have unlike texts.
_ROW = ["__doc", "__hash"]


def masked_tokens(line: Column) -> Column:
    """The line's tokens, those with a digit as ``<*>``. White space is ASCII's."""
    # most lines have neither digits nor white space but single blanks
    odd = line.rlike("[\t\x0b\x0c\r0-9]|  |^ | $")
    marked = F.regexp_replace(F.translate(line, "\t\x0b\x0c\r", "    "), _VARIABLE, "<*>")
    return F.when(odd, F.filter(F.split(marked, " "), lambda t: t != "")).otherwise(F.split(line, " "))


def _same(left: list[str], right: list[str]) -> Column:
    """Whether columns are equal, nulls included."""
    out = F.lit(True)
    for a, b in zip(left, right, strict=True):
        out = out & F.col(a).eqNullSafe(F.col(b))
    return out


def _tokenized(min_tokens: int) -> Column:
    """Of each line its masked tokens, none for those that are too short for a template."""
    # a line of so many tokens has twice as many characters less one
    return F.transform(F.split("__text", "\n"), lambda x: F.when(F.length(x) >= 2 * min_tokens - 1, masked_tokens(x)).otherwise(F.array().cast("array<string>")))


def _leaf(tokens: Column, least: int, depth: int) -> Column:
    """A hash of the tokens' path down the tree; null for lines that are too short."""
    return F.when(F.size(tokens) >= least, F.xxhash64(F.size(tokens), *(F.get(tokens, F.lit(i)) for i in range(depth))))


def _exact_lines(source: DataFrame, min_tokens: int, long_tokens: int, short_docs: int | None) -> DataFrame:
    """(doc, hash, line, template, n_tokens, n_chars, kind, size) of the lines that may matter word for word: kind
    is long, short, or none for those that only tell versions; template is a hash of the line, size the text's length."""
    lines = source.select(*_ROW, F.length("__text").alias("__size"), F.posexplode(F.split("__text", "\n")).alias("__line", "__raw")).where("__raw <> ''")
    lines = lines.withColumn("__raw", F.btrim("__raw", F.lit(_BLANKS))).withColumn("__tokens", F.regexp_count("__raw", F.lit(r"[^\x20\x09-\x0D]+")))
    short = (F.col("__tokens") < min_tokens) & F.col("__raw").rlike(r"\p{L}") if short_docs is not None else F.lit(False)
    kind = F.when(F.col("__tokens") >= long_tokens, "long").when(short, "short").when(F.col("__tokens") >= VERSION_TOKENS, "none")
    template = F.xxhash64(F.lit("exact"), "__raw")
    return lines.select(*_ROW, "__line", template.alias("__template"), "__tokens", F.length("__raw").alias("__chars"), kind.alias("__kind"), "__size").where("__kind is not null")


def _shingles(lines: Column) -> Column:
    """Hashes of the shingles of lines' words; of fewer words, of all of them."""
    words = lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - F.lit(REST_WIDTH - 1), F.lit(1))), lambda i: F.xxhash64(F.slice(w, i, REST_WIDTH)))
    # the outer function evaluates the words once
    return F.get(F.transform(F.array(F.split(F.array_join(lines, " "), r"[\x20\x09-\x0D]+")), words), 0)


def _alike(mine: str, other: str) -> Column:
    """Whether two columns of lines are those of versions of one document."""

    def told(x: Column) -> Column:
        a, b, both = x["a"], x["b"], x["both"]
        length = lambda y: F.length(F.array_join(y, ""))
        enough = length(both) >= SAME_SHARE * (length(both) + length(a) + length(b))
        common = lambda y: F.size(F.array_intersect(y["p"], y["q"])) >= REST_SHARE * F.size(F.array_union(y["p"], y["q"]))
        rest = F.get(F.transform(F.array(F.struct(_shingles(a).alias("p"), _shingles(b).alias("q"))), common), 0)
        return F.when(enough, True).when((F.size(a) == 0) | (F.size(b) == 0), False).otherwise(rest)

    sides = F.struct(F.array_except(mine, other).alias("a"), F.array_except(other, mine).alias("b"), F.array_intersect(mine, other).alias("both"))
    return F.get(F.transform(F.array(sides), told), 0)


def _versions(source: DataFrame, exact: DataFrame) -> DataFrame:
    """(doc, hash, group_doc, group_hash): the rows that are versions of a shorter document, and the shortest one.

    Of each line that several documents have, the shortest of them stands for the others; each document is
    compared with the one of these with which it shares most characters, so with one at most, that is no longer.
    """
    by_row = exact.where(F.col("__tokens") >= VERSION_TOKENS).groupBy("__template", *_ROW).agg(F.max("__chars").alias("__chars"), F.max("__size").alias("__size"))
    by_row = cut(by_row)
    least = by_row.groupBy("__template").agg(F.count("*").alias("__rows"), F.min(F.struct("__size", *_ROW)).alias("__least")).where("__rows > 1")
    # written, so that the join's sides are plain shuffles, of which a hot line's can be split
    least = cut(least.select("__template", F.col("__least.__doc").alias("__group_doc"), F.col("__least.__hash").alias("__group_hash")))
    shared = by_row.join(least, "__template").groupBy(*_ROW, "__group_doc", "__group_hash").agg(F.sum("__chars").alias("__chars"))
    closest = shared.groupBy(*_ROW).agg(F.max_by(F.struct("__group_doc", "__group_hash"), F.struct("__chars", "__group_hash", "__group_doc")).alias("__group")).select(*_ROW, "__group.*")
    closest = cut(closest.where(~_same(_ROW, ["__group_doc", "__group_hash"])))

    lines = lambda name: F.array_distinct(F.transform(F.split("__text", "\n"), lambda x: F.btrim(x, F.lit(_BLANKS)))).alias(name)
    unlike = closest.where("__hash <> __group_hash")
    firsts = unlike.select(F.col("__group_doc").alias("__d"), F.col("__group_hash").alias("__h"))
    # one shuffle of all texts; what is compared is written
    texts = cut(source.join(firsts.unionByName(unlike.toDF("__d", "__h", "__x", "__y").select("__d", "__h")).distinct(), _same(_ROW, ["__d", "__h"]), "left_semi"))
    firsts = texts.join(firsts.distinct(), _same(_ROW, ["__d", "__h"]), "left_semi").groupBy(*_ROW).agg(F.first("__text").alias("__text")).select(F.col("__doc").alias("__d"), F.col("__hash").alias("__h"), lines("__theirs"))
    # the large sides of both joins are plain shuffles, of which those of a hot line's shortest document can be split
    pairs = unlike.join(cut(firsts), _same(["__group_doc", "__group_hash"], ["__d", "__h"])).drop("__d", "__h").toDF("__d", "__h", "__group_doc", "__group_hash", "__theirs")
    compared = texts.join(pairs, _same(_ROW, ["__d", "__h"])).select(*_ROW, "__group_doc", "__group_hash", "__theirs", lines("__mine"))
    compared = compared.select(*_ROW, "__group_doc", "__group_hash", _alike("__mine", "__theirs").alias("__alike"))
    found = cut(closest.where("__hash = __group_hash").unionByName(compared.where("__alike").drop("__alike")).distinct())
    # a version's shortest document may be a version itself; lengths shrink on the way, so this ends
    while True:
        above = found.toDF("__d", "__h", "__up_doc", "__up_hash")
        now = found.join(above, _same(["__group_doc", "__group_hash"], ["__d", "__h"]), "left")
        moved = F.col("__up_hash").isNotNull()
        now = cut(now.select(*_ROW, F.when(moved, F.col("__up_doc")).otherwise(F.col("__group_doc")).alias("__group_doc"), F.coalesce("__up_hash", "__group_hash").alias("__group_hash"), moved.alias("__moved")))
        done = now.where("__moved").isEmpty()
        found = now.drop("__moved")
        if done:
            return found


def recurring_lines(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", min_docs: int = MIN_DOCS, depth: int = DEPTH,
                    min_tokens: int = MIN_TOKENS, constant_percent: int = CONSTANT_PERCENT, long_tokens: int = LONG_TOKENS,
                    long_docs: int | None = None, short_docs: int | None = None) -> DataFrame:
    """(__doc, __hash, __line): every line, counted from 0, of a recurring template but for the template's first one.

    ``__hash`` is the hash of the row's text. First is the smallest (document id, line); a null id is the
    smallest. Rows with equal ids are one document where documents are counted, whatever their texts; rows that
    repeat wholly are told once.

    With ``long_docs``, lines of ``long_tokens`` or more that are equal but for white space around them
    recur from so many documents on; with ``short_docs``, lines of less than ``min_tokens`` that have a letter.
    With either, versions of one document are found first: a long line is counted once for all of them, they come
    last where lines' first is chosen, and those of the first one keep the line like it, so that they stay versions.
    """
    body = F.col(text).cast("string")
    source = docs.select(F.col(doc_id).alias("__doc"), F.xxhash64(body).alias("__hash"), body.alias("__text")).where("__text is not null")
    least = max(min_tokens, depth)
    counted = source.select(F.explode(F.transform(_tokenized(min_tokens), lambda x: _leaf(x, least, depth))).alias("__leaf")).where("__leaf is not null")
    leaves = cut(counted.groupBy("__leaf").agg(F.count("*").alias("__n")).where(F.col("__n") >= min_docs).select(F.col("__leaf").alias("__kept_leaf")))
    few = leaves.limit(BROADCAST_LEAVES + 1).count() <= BROADCAST_LEAVES
    lines = source.select(*_ROW, F.posexplode(_tokenized(min_tokens)).alias("__line", "__tokens")).where(F.size("__tokens") >= least)
    lines = lines.select(*_ROW, "__line", "__tokens", _leaf(F.col("__tokens"), least, depth).alias("__leaf"))
    # the few lines of well-filled leaves; written, as they are read several times
    lines = cut(lines.join(F.broadcast(leaves) if few else leaves, F.col("__leaf") == F.col("__kept_leaf"), "left_semi"))
    tokens = lines.select(*_ROW, "__line", "__leaf", F.size("__tokens").alias("__size"), F.posexplode("__tokens").alias("__place", "__token"))
    place = ["__leaf", "__place", "__token"]
    constants = tokens.groupBy(*place, "__doc").agg(F.first(F.lit(1)).alias("__one")).groupBy(*place).agg(F.count("*").alias("__docs"))
    constants = cut(constants.where(F.col("__docs") >= min_docs).select(*place))
    few = constants.limit(BROADCAST_CONSTANTS + 1).count() <= BROADCAST_CONSTANTS
    # inner: a line's wildcards are gone, its constants make the template
    fixed = tokens.join(F.broadcast(constants) if few else constants, place)
    made = fixed.groupBy(*_ROW, "__line", "__leaf", "__size").agg(F.sort_array(F.collect_set(F.struct("__place", "__token"))).alias("__fixed"))
    # variable fields are part of the template, but lines of nothing else (rows of numbers) are no template's
    literals = F.size(F.filter("__fixed", lambda x: x["__token"] != "<*>"))
    made = made.where(literals * 100 >= F.col("__size") * constant_percent)
    made = cut(made.select(*_ROW, "__line", F.xxhash64("__leaf", "__size", "__fixed").alias("__template")))
    if long_docs is not None or short_docs is not None:
        return _recurring_in_groups(source, made, cut(_exact_lines(source, min_tokens, long_tokens, short_docs)), min_docs, long_docs, short_docs)
    by_doc = made.groupBy("__template", "__doc").agg(F.min(F.struct("__line", "__hash")).alias("__at"))
    spread = by_doc.groupBy("__template").agg(F.count("*").alias("__docs"), F.min(F.struct("__doc", "__at")).alias("__first")).where(F.col("__docs") >= min_docs)
    # written, so that the join's sides are plain shuffles, of which a hot template's can be split
    spread = cut(spread.select("__template", F.col("__first.__doc").alias("__first_doc"), F.col("__first.__at.__hash").alias("__first_hash"), F.col("__first.__at.__line").alias("__first_line")))
    out = made.join(spread, "__template")
    return out.where(~_same([*_ROW, "__line"], ["__first_doc", "__first_hash", "__first_line"])).select(*_ROW, "__line")


def _recurring_in_groups(source: DataFrame, made: DataFrame, exact: DataFrame, min_docs: int, long_docs: int | None, short_docs: int | None) -> DataFrame:
    """(doc, hash, line) of the templates' lines ``made`` and of ``exact`` ones, with regard to versions."""
    least = F.when(F.col("__kind") == "long", F.lit(long_docs).cast("int")).when(F.col("__kind") == "short", F.lit(short_docs).cast("int"))
    told = exact.select(*_ROW, "__line", "__template", (F.col("__kind") == "long").alias("__long"), least.alias("__least")).where("__least is not null")
    found = made.withColumns({"__long": F.lit(False), "__least": F.lit(min_docs)}).unionByName(told)
    groups = _versions(source, exact).toDF("__d", "__h", "__group_doc", "__group_hash")
    found = found.join(groups, _same(_ROW, ["__d", "__h"]), "left")
    copy = F.col("__group_hash").isNotNull()
    found = cut(found.select(*_ROW, "__line", "__template", "__long", "__least", copy.alias("__copy"),
                             F.when(copy, F.col("__group_doc")).otherwise(F.col("__doc")).alias("__group_doc"), F.coalesce("__group_hash", "__hash").alias("__group_hash")))
    by_doc = found.groupBy("__template", "__doc", "__long", "__least").agg(F.min(F.struct("__copy", "__line", "__hash", "__group_doc", "__group_hash")).alias("__at"))
    # a version counts where the document that it is a version of hasn't got the line
    holders = found.where("__long").groupBy("__template", "__group_doc", "__group_hash").agg(F.count("*").alias("__n")).groupBy("__template").agg(F.count("*").alias("__groups"))
    first = F.min(F.struct(F.col("__at.__copy"), F.col("__doc"), F.col("__at.__line"), F.col("__at.__hash"), F.col("__at.__group_doc"), F.col("__at.__group_hash"))).alias("__first")
    spread = by_doc.groupBy("__template", "__long", "__least").agg(F.count("*").alias("__docs"), first).join(holders, "__template", "left")
    spread = spread.where(F.when(F.col("__long"), F.least("__groups", "__docs")).otherwise(F.col("__docs")) >= F.col("__least"))
    spread = cut(spread.select("__template", *(F.col(f"__first.__{c}").alias(f"__first_{c}") for c in ("doc", "hash", "line", "group_doc", "group_hash"))))
    out = found.join(spread, "__template")
    version = _same(["__group_doc", "__group_hash"], ["__first_group_doc", "__first_group_hash"])
    stays = F.when(_same(_ROW, ["__first_doc", "__first_hash"]) & ~F.col("__long"), F.col("__line") == F.col("__first_line")).otherwise(version)
    return out.where(~stays).select(*_ROW, "__line")


def drop_recurring_lines(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` with its recurring lines dropped from ``text``, and with ``n_lines int`` and ``n_dropped int``.

    A line ends with a line feed. A null text stays null and has 0 lines, an empty text has one.
    Lines are dropped whole, whatever their length; documents all of whose lines go have the text
    ``''``. Rows that repeat wholly lose the same lines; rows of one id (or of none) with unlike texts each lose
    their own. Names that start with ``__`` are this operator's own.
    """
    dropped = recurring_lines(docs, doc_id=doc_id, text=text, **options)
    dropped = dropped.groupBy(*_ROW).agg(F.collect_set("__line").alias("__dropped"))
    out = docs.withColumn("__own", F.xxhash64(F.col(text).cast("string")))
    out = out.join(dropped, F.col(doc_id).eqNullSafe(F.col("__doc")) & (F.col("__own") == F.col("__hash")), "left").drop("__doc", "__hash", "__own")
    lines = F.split(F.col(text).cast("string"), "\n")
    # linear in the lines: places are taken away as a set, and the outer function evaluates the lines once
    left = lambda x: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(x) - 1), F.col("__dropped")), lambda i: F.get(x, i)), "\n")
    kept = F.get(F.transform(F.array(lines), left), 0)
    out = out.withColumn("n_lines", F.when(F.col(text).isNull(), 0).otherwise(F.size(lines))).withColumn("n_dropped", F.coalesce(F.size("__dropped"), F.lit(0)))
    return out.withColumn(text, F.when(F.col("__dropped").isNull(), F.col(text)).otherwise(kept)).drop("__dropped")
