"""Fixes: planned changes applied to source texts. New contents are rows; writing them back is the caller's
choice, so executors never rewrite a project."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rulespan.operators.graph import cut
from rulespan.sources.php_facts import TAG, FileFacts
from rulespan.sources.php_tokens import SyntaxProblem, Token, tokenize

#: A run fixes and looks again at most so often.
MAX_PASSES = 10
FIXED = "file string, content binary, removed boolean"
_BOM = "﻿"
_MEMBERS = {"add_public_method": "method", "add_public_constant": "constant", "add_public_property": "property"}


def _tag_edits(tokens: Sequence[Token]) -> Iterator[tuple[int, int, str]]:
    for t in tokens:
        if t.kind == "open" and t.text not in ("<?php", "<?="):
            yield t.pos, t.stop, "<?php"
        elif t.kind == "html":
            for m in TAG.finditer(t.text):
                if not m[1]:
                    yield t.pos + m.start(), t.pos + m.end(), "<?php" if t.text[m.end() : m.end() + 1].isspace() else "<?php "


def _is_boilerplate(source: str) -> bool:
    """Whether nothing is left but tags, namespaces, imports and declares."""
    f = FileFacts(tokenize(source)).read()
    return not f.declares and f.effect is None


def fixed(source: str, actions: Sequence[tuple[str, str, str | None]]) -> str | None:
    """The text after ``actions`` (action, class name, member); None if the file is to go. A text that can't
    be read as PHP only loses its byte order mark."""
    bom = source.startswith(_BOM)
    source = source.removeprefix(_BOM)
    keep = bom and not any(a == "strip_bom" for a, _, _ in actions)
    try:
        tokens = tokenize(source)
        facts = FileFacts(tokens).read()
    except (SyntaxProblem, IndexError, RecursionError):
        return (_BOM if keep else "") + source
    classes = {c.name: c for c in facts.classes}
    edits: dict[tuple[int, int], str] = {}
    removed = False
    for action, name, member in actions:
        if action == "normalise_tags":
            edits |= {(a, b): text for a, b, text in _tag_edits(tokens)}
        c = classes.get(name)
        if c is None:
            continue
        start = tokens[c.start].pos
        if action in ("add_final", "add_abstract") and not c.flags & {"final", "abstract"}:
            edits[start, start] = action.removeprefix("add_") + " "
        elif action == "remove_class":
            edits[start, tokens[c.stop - 1].stop] = ""
            removed = True
        elif action in _MEMBERS:
            for kind, own, at in c.spots:
                if (kind, own) == (_MEMBERS[action], member):
                    t = tokens[at]
                    if t.low() == "var":
                        edits[t.pos, t.stop] = "public"
                    else:
                        edits[t.pos, t.pos] = "public "
    for (a, b), text in sorted(edits.items(), reverse=True):
        source = source[:a] + text + source[b:]
    if removed and _is_boilerplate(source):
        return None
    return (_BOM if keep else "") + source


def without_missing_paths(config: dict, is_folder: Callable[[str], bool]) -> dict:
    """A project's configuration without mapped folders that aren't there, and without what that empties."""
    out = json.loads(json.dumps(config))
    for section in ("autoload", "autoload-dev"):
        autoload = out.get(section)
        psr4 = autoload.get("psr-4") if isinstance(autoload, dict) else None
        if not isinstance(psr4, dict):
            continue
        for namespace, paths in list(psr4.items()):
            kept = [p for p in (paths if isinstance(paths, list) else [paths]) if not isinstance(p, str) or is_folder(p)]
            if not kept:
                del psr4[namespace]
            elif isinstance(paths, list):
                psr4[namespace] = kept
        if not psr4:
            del autoload["psr-4"]
        if not autoload:
            del out[section]
    return out


def apply(files: DataFrame, plan: DataFrame) -> DataFrame:
    """(file, content, removed) of the files that the plan changes. ``files``: (file, content); ``plan`` as
    ``analysis.fix_plan`` makes it."""
    grouped = plan.where("action <> 'remove_mapping'").groupBy("file").agg(F.sort_array(F.collect_set(F.struct("action", "class_name", "member"))).alias("actions"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for file, content, actions in zip(batch["file"], batch["content"], batch["actions"], strict=True):
                # bytes that aren't UTF-8 go through unchanged
                text = fixed(bytes(content).decode("utf-8", "surrogateescape"), [(a["action"], a["class_name"], a["member"]) for a in actions])
                new = b"" if text is None else text.encode("utf-8", "surrogateescape")
                if text is None or new != bytes(content):
                    rows.append((file, new, text is None))
            yield pd.DataFrame(rows, columns=["file", "content", "removed"]).astype({"removed": bool})

    return files.join(grouped, "file").select("file", "content", "actions").mapInPandas(run, FIXED)


def fix_until_stable(files: DataFrame, plan_of: Callable[[DataFrame], DataFrame], *, max_passes: int = MAX_PASSES) -> tuple[DataFrame, int]:
    """Files (file, content) after fixing and looking again until nothing changes, and how many passes
    changed something. ``plan_of`` makes a plan from files."""
    files = files.select("file", "content")
    for done in range(max_passes):
        changed = cut(apply(files, plan_of(files)))
        if changed.isEmpty():
            return files, done
        files = cut(files.join(changed.select("file"), "file", "left_anti").unionByName(changed.where("not removed").select("file", "content")))
    return files, max_passes
