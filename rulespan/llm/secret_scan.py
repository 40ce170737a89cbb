"""Secret scans: candidates by shape, false positives removed by a random forest.

Candidates are long words of key characters, shorter values that a word like password is assigned, passwords
in URLs, and the heads of private keys. They, their features and the forest's votes are DataFrame expressions;
a forest is fitted on the driver from labelled findings, a few thousand rows at most, and compiled to nested
CASEs. All features are whole numbers, so every engine comes to the same votes.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterable, Sequence
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled findings that a forest is fitted on at most; of more, the first.
MAX_FINDINGS = 4000
TREES, TREE_DEPTH, LEAST_LEAF, SEED = 15, 6, 4, 11
#: A finding counts as a secret from this vote on, in thousandths.
VOTE = 500

# What a candidate looks like, and words that tell of secrets or of their like.
SPACE = r"[\x20\x09-\x0D]+"
CORE = r"[A-Za-z0-9+/_-]{16,}"
#: What a short value is assigned to; its characters are printable ASCII but quotes, commas and semicolons.
NAMED = r"(?:passw(?:or)?d|passphrase|pwd|secret|token|api_?key)"
VALUE = r"[!#-&(-+\x2D-:<-~]{8,}"
ASSIGNED = rf"(?i){NAMED}[\x22\x27]?[=:]+[\x22\x27]?({VALUE})"
ASSIGNED_BEFORE = rf"(?i){NAMED}[\x22\x27]? ?[=:]$"
AROUND_VALUE = r"^[\x22\x27(]+|[\x22\x27);,.]+$"
URL_PASSWORD = r"://[^/:@\x22\x27]+:([!#-&(-.0-?A-~]{3,})@"
KEY_HEAD, KEY_WORDS = "-----BEGIN", r"\bPRIVATE KEY"
SECRET_WORDS = r"token|secret|passw|passphrase|pwd|api_?key|apikey|access_?key|auth|credential|bearer|private|signing"
DIGEST_WORDS = r"commit|sha[0-9]|sha-|md5|checksum|digest|etag|revision|hash|blob|uuid|guid|fingerprint|build"
SAMPLE_WORDS = r"example|sample|dummy|placeholder|changeme|change_me|your[_-]|xxxx|test|fake|redacted|required|undefined|optional|none|null|true|false|invalid|incorrect|expired"
TEMPLATE = r"[$<{}%*\[(]|\.\.\.|->|::|^[a-z]+\.[a-z]+"
PATH = r"://|^/|/[a-z0-9_-]+/|\.(com|org|net|html|php|js|css|png|jpg|json|xml|txt|md|py)\b|\\"
DICTIONARY = tuple(
    "about access account action active address admin after alpha application archive article asset author backup banner base batch beta block branch browser buffer build bundle "
    "button cache call category change channel check class client cloud code column command comment common component config connect console content context control copy count create "
    "current custom data database date debug default delete demo deploy design detail device dialog document domain download draft driver element email engine entry error event "
    "example export feature field file filter final first folder font form format frame function gateway global group handler header height history home host icon image import index "
    "info input install instance internal item java job json key label language last layer layout level library light line link list load local log login long main manager map master "
    "media member menu message method model module name network next node note number object option order output page panel param parent path pattern player plugin point policy port "
    "post prefix price print private process product profile project property public query queue read record region release remote report request reset resource response result "
    "return role root route rule sample save schema screen script search section select server service session setting short simple single size source space stage start state static "
    "status step storage store stream string style submit suffix summary super support switch system table target task temp template test text theme time title token tool total trace "
    "track type unit update upload user util value version video view web widget width window word work world write zone".split()
)

#: Pairs of letters that follow each other in words, each after a blank.
PAIRS = " " + " ".join(sorted({w[i : i + 2] for w in DICTIONARY for i in range(len(w) - 1)}))

FEATURES = ("f_length", "f_digits", "f_upper", "f_lower", "f_runs", "f_distinct", "f_covered_percent", "f_hex", "f_path", "f_secret_near", "f_digest_near", "f_sample_near", "f_assigned", "f_same_run", "f_dashes", "f_transitions_percent", "f_signs", "f_template", "f_kind")


def feature_sql(dialect: str) -> dict[str, str]:
    """SQL of each feature over ``core``, ``token``, ``before`` (two words) and ``after`` (one word), for ``spark`` or ``duckdb``."""
    if dialect == "spark":
        count = lambda s, p: f"regexp_count({s}, r'{p}')"
        has = lambda s, p: f"CAST({s} RLIKE r'{p}' AS INT)"
        without = lambda s, p: f"regexp_replace({s}, r'{p}', '')"
        letters = "size(array_distinct(split(core, '')))"
        divide = lambda a, b: f"({a}) DIV ({b})"
        pairs = f"size(filter(sequence(1, greatest(length(core) - 1, 1)), i -> instr('{PAIRS}', concat(' ', lower(substr(core, i, 2)))) > 0))"
    else:
        count = lambda s, p: f"len(regexp_extract_all({s}, '{p}'))"
        has = lambda s, p: f"CAST(regexp_matches({s}, '{p}') AS INT)"
        without = lambda s, p: f"regexp_replace({s}, '{p}', '', 'g')"
        letters = "len(list_distinct(string_split(core, '')))"
        divide = lambda a, b: f"({a}) // ({b})"
        pairs = f"len(list_filter(range(1, length(core)), lambda i: contains('{PAIRS}', ' ' || lower(substr(core, i, 2)))))"
    words = "|".join(sorted((w for w in DICTIONARY if len(w) > 3), key=lambda w: (-len(w), w)))
    around = "lower(before || ' ' || token)"
    return {
        "f_length": "length(core)",
        "f_digits": count("core", "[0-9]"),
        "f_upper": count("core", "[A-Z]"),
        "f_lower": count("core", "[a-z]"),
        "f_runs": " + ".join(count("core", p) for p in ("[0-9]+", "[A-Z]+", "[a-z]+", "[^0-9A-Za-z]+")),
        "f_distinct": letters,
        "f_covered_percent": divide(f"100 * (length(core) - length({without('lower(core)', words)}))", "length(core)"),
        "f_hex": has("core", "^([0-9a-f]+|[0-9A-F]+)$"),
        "f_path": has("lower(token)", PATH),
        "f_secret_near": has(around, SECRET_WORDS),
        "f_digest_near": has(around, DIGEST_WORDS),
        "f_sample_near": has("lower(before || ' ' || token || ' ' || after)", SAMPLE_WORDS),
        "f_assigned": has("before || ' ' || token", "[=:]"),
        "f_same_run": has("core", "|".join(f"{c}{c}{c}{c}" for c in "0123456789abcdefxABCDEFX_-")),
        "f_dashes": count("core", "[_-]"),
        "f_transitions_percent": divide(f"100 * {pairs}", "length(core) - 1"),
        "f_signs": count("core", "[^A-Za-z0-9]"),
        "f_template": has("core", TEMPLATE),
        "f_kind": "kind",
    }


def features(core: str, token: str, before: str, after: str, kind: int = 0) -> list[int]:
    """The same features of one finding, for fitting and for tests."""
    words = "|".join(sorted((w for w in DICTIONARY if len(w) > 3), key=lambda w: (-len(w), w)))
    around = f"{before} {token}".lower()
    return [
        len(core), len(re.findall("[0-9]", core)), len(re.findall("[A-Z]", core)), len(re.findall("[a-z]", core)),
        sum(len(re.findall(p, core)) for p in ("[0-9]+", "[A-Z]+", "[a-z]+", "[^0-9A-Za-z]+")), len(set(core)),
        100 * (len(core) - len(re.sub(words, "", core.lower()))) // len(core), int(bool(re.fullmatch("[0-9a-f]+|[0-9A-F]+", core))),
        int(bool(re.search(PATH, token.lower()))), int(bool(re.search(SECRET_WORDS, around))), int(bool(re.search(DIGEST_WORDS, around))),
        int(bool(re.search(SAMPLE_WORDS, f"{around} {after.lower()}"))), int(bool(re.search("[=:]", f"{before} {token}"))),
        int(bool(re.search(r"([0-9a-fxA-FX_-])\1{3}", core))), len(re.findall("[_-]", core)),
        100 * sum(f" {core[i : i + 2].lower()}" in PAIRS for i in range(len(core) - 1)) // (len(core) - 1), len(re.findall("[^A-Za-z0-9]", core)), int(bool(re.search(TEMPLATE, core))), kind,
    ]


def _short_finding(r: random.Random, label: bool) -> tuple[str, str, str, str, int, int]:
    """A password of a few characters, a URL's, or the head of a private key; or what looks like it."""
    pick = lambda letters, n: "".join(r.choice(letters) for _ in range(n))
    alnum = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    word = lambda: r.choice([w for w in DICTIONARY if len(w) > 3])
    name = r.choice(["password", "passwd", "pwd", "secret", "token", "Password", "PASSWORD", "api_key", "passphrase", "db_password"])
    shape = r.randrange(10)
    if shape == 0 and label:
        return KEY_HEAD, KEY_HEAD, r.choice(["", "key:", "-- cut"]), r.choice(["RSA", "EC", "OPENSSH", "PRIVATE"]), 3, 1
    if shape < 4:
        value = pick(alnum + "!#_-", r.randint(6, 14)) if label else r.choice(["password", "$PASS", "<password>", "{pass}", "pass", "secret", "user", "xxxx", "***", "%s"])
        return value, f"{r.choice(['https', 'postgres', 'mysql', 'ftp', 'amqp', 'redis'])}://{word()}:{value}@{word()}{r.choice(['.example.org', '.com', '', ':5432'])}/{word()}", r.choice(["the", "=", "url:", ""]), "and", 2, int(label)
    if label:
        value = r.choice([lambda: pick(alnum, r.randint(8, 15)), lambda: pick(alnum + "!@#%^&*?_-", r.randint(8, 15)), lambda: word().title() + pick("0123456789", r.randint(2, 4)) + pick("!#?$", r.randint(0, 2)),
                          lambda: word()[:5] + pick("0123456789", 3) + word()[:4].upper(), lambda: pick("abcdefghijklmnopqrstuvwxyz", r.randint(10, 14)) + pick("0123456789", 1)])()[:15]
        value += pick("23456789", max(0, 8 - len(value)))
    else:
        value = r.choice([lambda: word() + word(), lambda: "${" + word().upper() + "_PASS}", lambda: "<" + word() + "-" + word() + ">", lambda: "*" * r.randint(8, 14), lambda: word() + "." + word(), lambda: "get" + word().title() + "()", lambda: word() + "_" + word(),
                          lambda: r.choice(["required", "undefined", "changeme", "incorrect", "optional", "your_password", "password", "xxxxxxxx", "placeholder", "your-token", "validation", "necessary", "generated", "encrypted", "authentication"]),
                          lambda: "process.env." + word().upper(), lambda: "%" + word() + "%pass", lambda: "$this->" + word(), lambda: word().title() + word().title() + "::" + word(), lambda: "{{" + word() + "}}"])()[:15]
        value += "er" * max(0, -(-(8 - len(value)) // 2))
    if r.random() < 0.5:
        return value, r.choice(['"{}"', "{}", "'{}'", "{},", "{};"]).replace("{}", value), f"{name} {r.choice(['=', ':'])}" if r.random() < 0.6 else f"the {name}{r.choice(['=', ':'])}", r.choice(["and", "", "the"]), 1, int(label)
    return value, name + r.choice(["={}", ':"{}"', '="{}"', ":{}", "='{}';"]).replace("{}", value), r.choice(["the login", "set export", "", "with"]), r.choice(["and", "", "the"]), 1, int(label)


def example_findings(count: int = 3000, seed: int = SEED) -> list[tuple[str, str, str, str, int, int]]:
    """(core, token, before, after, kind, label) made by rule: credentials in their usual places (1), and the
    digests, identifiers, paths, numbers, words and placeholders that scanners take for them (0). Kinds are 0 for
    long words, 1 for assigned values, 2 for URLs' passwords and 3 for heads of private keys."""
    r = random.Random(seed)
    pick = lambda letters, n: "".join(r.choice(letters) for _ in range(n))
    hexes, digits = "0123456789abcdef", "0123456789"
    alnum = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    words = lambda n, gap: gap.join(r.choice(DICTIONARY) for _ in range(n))
    prose = lambda: r.choice(["the", "and", "in", "of", "was", "here", "see", "from", "with", "then", "", "line", "on"])
    out = []
    for i in range(count):
        before, after = f"{prose()} {prose()}", prose()
        if i % 5 > 2:
            out.append(_short_finding(r, bool(i % 2)))
            continue
        if i % 2:
            core = r.choice([lambda: pick(hexes, r.choice([32, 40, 40, 64])), lambda: pick(hexes, 40).upper(), lambda: pick(alnum, r.randint(20, 48)), lambda: pick(alnum + "+/", r.choice([40, 43, 64])),
                             lambda: r.choice(["sk-", "ghp_", "key-", "xoxb-"]) + pick(alnum, r.randint(24, 40)), lambda: "AKIA" + pick(alnum[:26] + digits, 16)])()
            name = r.choice(["token", "api_key", "secret", "password", "access_key", "auth", "apikey", "client_secret", "private_key", "TOKEN", "API_KEY", "Secret"])
            shape = r.randrange(10)
            if shape < 4:
                before, token = f"{name} {r.choice(['=', ':'])}", r.choice(['"{}"', "'{}'", "{}", '"{}"!!', '"{}",', '"{}".'])
            elif shape < 8:
                before, token = f"{prose()} {prose()}", name + r.choice(["={}", ':"{}"', '="{}"', "={};", ":{}"])
            elif shape < 9:
                before, token = "Authorization: Bearer", "{}"
            else:
                token = "{}"  # only random letters in mixed case tell without context
                core = pick(alnum + "+/", 48)
            label = 1
        else:
            label = 0
            core, token = r.choice([
                lambda: (pick(hexes, 40), "{}"), lambda: (words(r.randint(3, 5), r.choice(["_", "-", ""])) + r.choice(["", pick(digits, 2)]), r.choice(["{}", "{}()", "{}.py", "{},"])),
                lambda: ("-".join([pick(hexes, 8), pick(hexes, 4), pick(hexes, 4), pick(hexes, 4), pick(hexes, 12)]), "{}"), lambda: (pick(digits, r.randint(16, 20)), "{}"),
                lambda: ("/" + words(4, "/"), "https://www.example.com{}.html"), lambda: (words(1, "") + "/" + words(4, "-") + pick(digits, 4), "/{}"),
                lambda: (r.choice(["xxxxxxxxxxxxxxxxxxxx", "your_api_key_goes_here", "0000000000000000000000", "test_token_placeholder1", "EXAMPLEKEYEXAMPLEKEY12"]), r.choice(['"{}"', "{}", "key={}"])),
                lambda: ("-" * r.randint(16, 60), "{}"), lambda: ("_".join(words(3, "") for _ in range(2)) + pick(digits, 3), "{}"), lambda: (words(4, "").title() + pick(digits, 1), "{};"),
                lambda: (pick(hexes, 32), "md5:{}"), lambda: (pick(hexes, 64), "sha256:{}"),
            ])()
            if re.fullmatch(r"[0-9a-f]{40}", core):
                before = r.choice(["commit", "revision", "sha1", "git checkout", "build id", "checksum:"])
            elif r.random() < 0.25:
                before = f"{r.choice(['name', 'id', 'path', 'value', 'class', 'file', 'label', 'number'])} {r.choice(['=', ':'])}"
        out.append((core, token.replace("{}", core), before.strip(), after, 0, label))
    return out


def _gini(ones: float, n: float) -> float:
    return 2 * ones * (n - ones) / n if n else 0.0


def _grown(rows: list[tuple[list[int], int]], r: random.Random, depth: int) -> tuple | int:
    """A tree: a leaf is its share of ones in thousandths, a node (feature, threshold, at most, above)."""
    ones, n = sum(y for _, y in rows), len(rows)
    if not depth or not 0 < ones < n or n < 2 * LEAST_LEAF:
        return round(1000 * ones / n)
    found = None
    for f in sorted(r.sample(range(len(FEATURES)), 5)):
        ordered = sorted((x[f], y) for x, y in rows)
        left = 0
        for i in range(1, n):
            left += ordered[i - 1][1]
            if ordered[i][0] != ordered[i - 1][0] and LEAST_LEAF <= i <= n - LEAST_LEAF:
                impurity = _gini(left, i) + _gini(ones - left, n - i)
                if found is None or impurity < found[0] - 1e-12:
                    found = impurity, f, ordered[i - 1][0]
    if found is None or found[0] >= _gini(ones, n) - 1e-12:
        return round(1000 * ones / n)
    _, f, at = found
    return f, at, _grown([x for x in rows if x[0][f] <= at], r, depth - 1), _grown([x for x in rows if x[0][f] > at], r, depth - 1)


def fit_forest(findings: Iterable[Sequence], trees: int = TREES, depth: int = TREE_DEPTH, seed: int = SEED) -> list:
    """A random forest from labelled findings (core, token, before, after, kind, label), as ``candidates`` has
    them and people judge them; ``MAX_FINDINGS`` at most."""
    rows = []
    for core, token, before, after, kind, label in findings:
        if len(rows) == MAX_FINDINGS:
            break
        if core and len(core) > 1 and label is not None:
            rows.append((features(core, token or "", before or "", after or "", kind or 0), int(label)))
    if not rows:
        raise ValueError("a forest needs labelled findings")
    r = random.Random(seed)
    return [_grown([rows[r.randrange(len(rows))] for _ in rows], r, depth) for _ in range(trees)]


@lru_cache(maxsize=1)
def default_forest() -> tuple:
    return tuple(fit_forest(example_findings()))


def vote(tree: tuple | int, x: Sequence[int]) -> int:
    while not isinstance(tree, int):
        tree = tree[2] if x[tree[0]] <= tree[1] else tree[3]
    return tree


def tree_sql(tree: tuple | int) -> str:
    if isinstance(tree, int):
        return str(tree)
    return f"CASE WHEN {FEATURES[tree[0]]} <= {tree[1]} THEN {tree_sql(tree[2])} ELSE {tree_sql(tree[3])} END"


def candidates(docs: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """``keys``, ``place`` (of the white-space word, from 0), ``core``, ``kind``, ``token``, ``before`` and ``after``."""
    rows = docs.select(*keys, F.filter(F.split(F.col(text).cast("string"), SPACE), lambda t: t != "").alias("__words"))

    def wanted(i: Column) -> Column:
        word, last = F.get("__words", i), F.get("__words", i - 1)
        named = word.rlike(ASSIGNED) | word.rlike(URL_PASSWORD) | (last.endswith("=") | last.endswith(":")) & F.concat_ws(" ", F.get("__words", i - 2), last).rlike(ASSIGNED_BEFORE)
        return (F.length(word) >= 8) & ((F.length(word) >= 16) & word.rlike(CORE) | (word == KEY_HEAD) | F.coalesce(named, F.lit(False)))

    places = F.filter(F.sequence(F.lit(0), F.size("__words") - 1), wanted)
    rows = rows.where(F.size("__words") > 0).select(*keys, "__words", F.explode(places).alias("place"))
    word = lambda k: F.coalesce(F.get("__words", F.col("place") + k), F.lit(""))
    rows = rows.select(*keys, "place", word(0).alias("token"), F.concat_ws(" ", word(-2), word(-1)).alias("before"), word(1).alias("after"), F.concat_ws(" ", *(word(k) for k in range(1, 4))).alias("__next"))
    # a long candidate has a digit, or letters of both cases
    cores: Column = F.filter(F.regexp_extract_all("token", F.lit(CORE), F.lit(0)), lambda c: c.rlike("[0-9]") | (c.rlike("[A-Z]") & c.rlike("[a-z]") & ~c.rlike("^[A-Z]?[a-z]+$")))
    found = lambda core, kind: F.struct(core.alias("core"), F.lit(kind).alias("kind"))
    none = F.array().cast("array<struct<core: string, kind: int>>")
    short = lambda core: (core != "") & ~core.rlike(CORE)
    own, url, bare = F.regexp_extract("token", ASSIGNED, 1), F.regexp_extract("token", URL_PASSWORD, 1), F.regexp_replace("token", AROUND_VALUE, "")
    head = (F.col("token") == KEY_HEAD) & F.col("__next").rlike(KEY_WORDS)
    value = F.when(short(own), F.array(found(own, 1))).when(F.col("before").rlike(ASSIGNED_BEFORE) & short(bare) & bare.rlike(f"^{VALUE}$") & (own == ""), F.array(found(bare, 1))).otherwise(none)
    every = F.concat(F.transform(cores, lambda c: found(c, 0)), value, F.when(short(url), F.array(found(url, 2))).otherwise(none), F.when(head, F.array(found(F.lit(KEY_HEAD), 3))).otherwise(none))
    return rows.select(*keys, "place", F.inline(every), "token", "before", "after")


def scan(docs: DataFrame, keys: list[str], *, text: str = "text", forest: Sequence | None = None, threshold: int = VOTE) -> DataFrame:
    """``keys``, then ``place int, core string, vote int, is_secret boolean`` of every candidate.

    ``forest`` is what ``fit_forest`` makes of labelled findings; by default one of findings made by rule.
    ``vote`` is the trees' mean in thousandths, ``is_secret`` says whether it reaches ``threshold``.
    Null and empty texts have no candidates; of several cores in a word each has its row; repeated
    rows each count; other columns are ignored. Nothing is shuffled.
    """
    forest = list(default_forest() if forest is None else forest)
    found = candidates(docs, keys, text)
    found = found.select("*", *(F.expr(sql).cast("int").alias(name) for name, sql in feature_sql("spark").items()))
    votes = F.expr("(" + " + ".join(f"({tree_sql(t)})" for t in forest) + f") DIV {len(forest)}").cast("int")
    return found.select(*keys, "place", "core", votes.alias("vote")).withColumn("is_secret", F.col("vote") >= threshold)


def duckdb_sql(table: str = "documents") -> str:
    """The scan with the default forest over ``doc_id`` and ``text``, for DuckDB."""
    forest = default_forest()
    votes = " + ".join(f"({tree_sql(t)})" for t in forest)
    return f"""
        WITH words AS (SELECT doc_id, list_filter(string_split_regex(text, '{SPACE}'), lambda t: t <> '') AS words FROM {table}),
        long AS (SELECT doc_id, words, unnest(list_filter(range(len(words)), lambda i: length(words[i + 1]) >= 8 AND
          (length(words[i + 1]) >= 16 AND regexp_matches(words[i + 1], '{CORE}') OR words[i + 1] = '{KEY_HEAD}' OR regexp_matches(words[i + 1], '{ASSIGNED}') OR regexp_matches(words[i + 1], '{URL_PASSWORD}')
           OR i > 0 AND regexp_matches(concat_ws(' ', CASE WHEN i > 1 THEN words[i - 1] END, words[i]), '{ASSIGNED_BEFORE}')))) AS place FROM words),
        found AS (
          SELECT doc_id, place, words[place + 1] AS token, coalesce(CASE WHEN place > 1 THEN words[place - 1] END, '') || ' ' || coalesce(CASE WHEN place > 0 THEN words[place] END, '') AS before,
                 coalesce(words[place + 2], '') AS after, array_to_string(words[place + 2 : place + 4], ' ') AS next FROM long),
        pieces AS (
          SELECT *, regexp_extract(token, '{ASSIGNED}', 1) AS own, regexp_extract(token, '{URL_PASSWORD}', 1) AS url, regexp_replace(token, '{AROUND_VALUE}', '', 'g') AS bare FROM found),
        cores AS (
          SELECT doc_id, place, token, before, after, unnest(list_concat(
            list_transform(list_filter(regexp_extract_all(token, '{CORE}'), lambda c: regexp_matches(c, '[0-9]') OR (regexp_matches(c, '[A-Z]') AND regexp_matches(c, '[a-z]') AND NOT regexp_matches(c, '^[A-Z]?[a-z]+$'))), lambda c: {{'core': c, 'kind': 0}}),
            CASE WHEN own <> '' AND NOT regexp_matches(own, '{CORE}') THEN [{{'core': own, 'kind': 1}}]
                 WHEN regexp_matches(before, '{ASSIGNED_BEFORE}') AND own = '' AND NOT regexp_matches(bare, '{CORE}') AND regexp_matches(bare, '^{VALUE}$') THEN [{{'core': bare, 'kind': 1}}] ELSE [] END,
            CASE WHEN url <> '' AND NOT regexp_matches(url, '{CORE}') THEN [{{'core': url, 'kind': 2}}] ELSE [] END,
            CASE WHEN token = '{KEY_HEAD}' AND regexp_matches(next, '{KEY_WORDS}') THEN [{{'core': token, 'kind': 3}}] ELSE [] END), recursive := true) FROM pieces),
        features AS (SELECT doc_id, place, core, {', '.join(f'{sql} AS {name}' for name, sql in feature_sql('duckdb').items())} FROM cores),
        votes AS (SELECT doc_id, place, core, ({votes}) // {len(forest)} AS vote FROM features)
        SELECT doc_id, CAST(place AS INTEGER) AS place, md5(core) AS core_md5, CAST(length(core) AS INTEGER) AS n_chars, CAST(vote AS INTEGER) AS vote, vote >= {VOTE} AS is_secret FROM votes"""
