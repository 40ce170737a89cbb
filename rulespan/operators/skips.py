"""Skipped paths: folders and shell patterns, as conditions on a column."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from rulespan.functions.names import any_of, below, col, glob_to_regex, is_glob, resolve, told


def skipped(file: Column | str, entries: Iterable[str], base_path: str = "") -> Column:
    """Whether a file is skipped: below an entry without wildcards, or matched by one with them; entries
    are tried as they are and below the base, and wildcards on the path relative to the base too."""
    base = told(base_path) if base_path else ""
    file = col(file)
    relative = F.when(file.startswith(base + "/"), F.substr(file, F.lit(len(base) + 2))).otherwise(file) if base else file
    hits = []
    for entry in dict.fromkeys(entries):
        if is_glob(entry):
            for pattern in dict.fromkeys([told(entry), told(resolve(entry, base))]):
                regex = glob_to_regex(pattern)
                hits += [file.rlike(regex), relative.rlike(regex)]
        else:
            for path in dict.fromkeys([told(entry), told(resolve(entry, base))]):
                if path:
                    hits.append(below(file, path))
    return F.coalesce(any_of(*hits), F.lit(False))
