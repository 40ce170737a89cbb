"""Column helpers for names, paths and patterns."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ascii_lower(c: Column | str) -> Column:
    """Lower case of A to Z only, which is how names are compared without regard to case."""
    return F.translate(col(c), _UPPER, _LOWER)


def lower_text(text: str) -> str:
    return text.translate(str.maketrans(_UPPER, _LOWER))


def short_name(c: Column | str = "class_name") -> Column:
    """What follows a qualified name's last backslash."""
    return F.substring_index(col(c), "\\", -1)


def any_of(*conditions: Column) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def has_item(items: Column | str, value: str, *, fold: bool = False) -> Column:
    """Membership in a list of names, by case unless ``fold``."""
    if not fold:
        return F.coalesce(F.array_contains(col(items), value), F.lit(False))
    key = lower_text(value)
    return F.coalesce(F.exists(col(items), lambda x: ascii_lower(x) == key), F.lit(False))


def namespace_prefix(namespace: str) -> str:
    return namespace.rstrip("\\") + "\\"


def uses_namespace(items: Column | str, namespace: str) -> Column:
    prefix = namespace_prefix(namespace)
    return F.coalesce(F.exists(col(items), lambda x: x.startswith(prefix)), F.lit(False))


#: A store's name and host; one letter is a drive.
_STORE = re.compile(r"^[A-Za-z][A-Za-z0-9+.-]+:(?://[^/]+)?(?=/)")


def normalise(path: str) -> str:
    """Forward slashes, no doubled ones (but a leading pair), no leading ``./`` or trailing slash. A store's name and
    host stay as they are."""
    path = path.replace("\\", "/")
    if store := _STORE.match(path):
        return f"{store[0]}/{re.sub('/+', '/', path[store.end() :]).strip('/')}"
    head = "//" if path.startswith("//") else ""
    path = re.sub("/+", "/", path[len(head):] if head else path)
    while path.startswith("./"):
        path = path[2:]
    path = path if path == "/" else path.rstrip("/")
    return head + path.lstrip("/") if head else path


def told(path: str) -> str:
    """``normalise``, and without a store's name where that is the local one: how files of a scan are named."""
    return re.sub("^file:/+", "/", normalise(path))


def normalised(c: Column | str) -> Column:
    """``normalise`` of a column."""
    slashed = F.translate(col(c), "\\", "/")
    unc = slashed.startswith("//")
    store = F.regexp_extract(slashed, _STORE.pattern, 0)
    body = F.regexp_replace(F.regexp_replace(F.substr(slashed, F.length(store) + 1), "/+", "/"), r"^(\./)+", "")
    body = F.when(body == "/", body).otherwise(F.regexp_replace(body, "/$", ""))
    return F.when(unc, F.concat(F.lit("/"), body)).otherwise(F.concat(store, body))


def is_absolute(path: str) -> bool:
    return path.startswith(("/", "\\")) or bool(re.match(r"[A-Za-z]:[\\/]", path) or _STORE.match(path))


def resolve(path: str, base: str) -> str:
    """``path`` below ``base`` unless it is absolute."""
    return normalise(path) if is_absolute(path) or not base else normalise(f"{base.rstrip('/')}/{path}")


def below(path: Column | str, prefix: str) -> Column:
    """Whether a path is ``prefix`` or lies below it; a sibling that starts alike doesn't."""
    return F.concat(col(path), F.lit("/")).startswith(prefix.rstrip("/") + "/")


def glob_to_regex(glob: str) -> str:
    """An anchored expression for a shell pattern; ``*`` and ``?`` match slashes too."""
    out, i = [], 0
    while i < len(glob):
        c = glob[i]
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif c == "[" and (end := glob.find("]", i + 2)) > 0:
            body = glob[i + 1 : end]
            negated = body[:1] in ("!", "^")
            body = (body[1:] if negated else body).replace("\\", "\\\\").replace("[", "\\[").replace("&&", "&\\&")
            out.append(f"[{'^' if negated else ''}{body}]")
            i = end
        elif c == "\\" and i + 1 < len(glob):
            i += 1
            out.append(re.escape(glob[i]))
        else:
            out.append(re.escape(c))
        i += 1
    return "(?s)^" + "".join(out) + r"\z"


def is_glob(entry: str) -> bool:
    return any(c in entry for c in "*?[")


#: Closing delimiters of bracket-delimited patterns, and modifiers with their inline form.
_CLOSING = {"(": ")", "{": "}", "[": "]", "<": ">"}
_MODIFIERS = {"i": "i", "m": "m", "s": "s", "x": "x", "u": ""}


def pattern_to_regex(pattern: str) -> str:
    """Java syntax of a delimited pattern such as ``/Entity$/i``. Raises ValueError for what isn't one."""
    pattern = pattern.lstrip()
    if len(pattern) < 2 or pattern[0].isalnum() or pattern[0] in "\\ ":
        raise ValueError(f"pattern {pattern!r} has no delimiters")
    end = pattern.rfind(_CLOSING.get(pattern[0], pattern[0]))
    if end <= 0:
        raise ValueError(f"pattern {pattern!r} has no closing delimiter")
    body, modifiers = pattern[1:end], pattern[end + 1 :]
    flags = ""
    for m in modifiers:
        if m == "D":
            body = re.sub(r"(?<!\\)\$$", r"\\z", body)
        elif m == "A":
            body = rf"\G(?:{body})"
        elif m in _MODIFIERS:
            flags += _MODIFIERS[m]
        else:
            raise ValueError(f"modifier {m!r} isn't supported")
    return f"(?{''.join(sorted(set(flags)))}){body}" if flags else body


def matches(c: Column | str, pattern: str) -> Column:
    """Whether the delimited pattern is found in the column; null counts as no."""
    return F.coalesce(col(c).rlike(pattern_to_regex(pattern)), F.lit(False))
