"""Reports of a run."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rulespan.plans.analysis import Result

_OPTIONAL = (("method_name", "method"), ("constant_name", "constant"), ("property_name", "property"))


def as_entry(row) -> dict:
    """A violation as reports tell it; what doesn't apply is left out, but for the layer."""
    out = {"rule": row["rule_key"], "message": row["message"], "file": row["file"], "line": row["line"], "class": row["class_name"], "layer": row["layer"]}
    if row["fixable"]:
        out["fixable"] = True
    return out | {name: row[column] for column, name in _OPTIONAL if row[column] is not None}


def json_report(result: Result) -> str:
    return json.dumps({"violations": [as_entry(r) for r in result.violations], "total": len(result.violations), "passed": result.passed, "elapsed": round(result.elapsed, 4)}, indent=4, ensure_ascii=False)


def json_lines(found: DataFrame) -> DataFrame:
    """(value): a JSON object for each violation, made on the executors, for results of any size."""
    fields = [F.col("rule_key").alias("rule"), "message", "file", "line", F.col("class_name").alias("class"), F.when(F.col("fixable"), F.lit(True)).alias("fixable"), *(F.col(c).alias(n) for c, n in _OPTIONAL)]
    body = F.to_json(F.struct(*fields))
    # null fields vanish, but the layer is always told
    layer = F.coalesce(F.regexp_extract(F.to_json(F.struct("layer")), r"^\{(.*)\}$", 1), F.lit(""))
    layer = F.when(layer == "", F.lit('"layer":null')).otherwise(layer)
    return found.select(F.concat(F.substr(body, F.lit(1), F.length(body) - 1), F.lit(","), layer, F.lit("}")).alias("value"))


def console_report(result: Result, title: str = "Architecture rules") -> str:
    lines = ["", title, "=" * len(title), ""]
    if result.passed:
        return "\n".join([*lines, f"✅  No violations found. ({result.elapsed:.2f}s)", ""])
    lines += [f"Found {len(result.violations)} violation(s):", "─" * len(title)]
    for r in result.violations:
        lines += ["", f"✗  [{r['rule_key']}]", f"   {r['message']}", f"   → {r['file']}:{r['line']}"]
        if r["layer"] is not None:
            lines.append(f"   Layer: {r['layer']}")
        if r["fixable"]:
            lines.append("   Hint: a fix is planned for this violation.")
    return "\n".join([*lines, "", "─" * len(title), f"Time: {result.elapsed:.2f}s", ""])
