"""Mixing sources to target weights by iterative proportional fitting.

Token weights of the cells source x language x topic are raked until every marginal has its target
share; a document of a cell is then kept with the cell's calibrated probability.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rulespan.llm.common import cut

ROUNDS = 8
#: The share of all tokens that the sample is to have, and steps of fitting the scale to it.
KEEP, SCALE_STEPS = 0.5, 5
#: Up to so many cells (a few MB) are raked on the driver and broadcast; more stay distributed.
LOCAL_CELLS = 50_000
#: Lineage of distributed cells is cut after so many rakings.
CUT_EVERY = 3


def uniform(key: Column) -> Column:
    """A number in [0, 1) from the first 32 bits of the key's MD5, the same in every run."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def _factors(now: Mapping, target: Mapping) -> dict:
    """Of each value its raking factor; 1 for values without a target or tokens."""
    known = {v: n for v, n in now.items() if target.get(v) is not None}
    goals, total = sum(target[v] for v in known), sum(known.values())
    return {v: target[v] / goals * total / n if goals > 0 and n > 0 else 1.0 for v, n in known.items()}


def _raked_rows(rows: list, dimensions: list[str], targets: Mapping[str, Mapping], rounds: int) -> list[float]:
    weights = [float(r["tokens"]) for r in rows]
    for _ in range(rounds):
        for name in dimensions:
            now: dict = {}
            for r, w in zip(rows, weights, strict=True):
                now[r[name]] = now.get(r[name], 0.0) + w
            factor = _factors(now, targets[name])
            weights = [w * factor.get(r[name], 1.0) for r, w in zip(rows, weights, strict=True)]
    return weights


def _raked_frame(cells: DataFrame, dimensions: list[str], targets: Mapping[str, Mapping | DataFrame], rounds: int) -> DataFrame:
    spark, out, done = cells.sparkSession, cells.withColumn("weight", F.col("tokens").cast("double")), 0
    for _ in range(rounds):
        for name in dimensions:
            goal = targets[name]
            if isinstance(goal, DataFrame):
                goal = goal.toDF("__value", "__target")
            else:
                goal = spark.createDataFrame([(v, None if t is None else float(t)) for v, t in goal.items()], f"__value {cells.schema[name].dataType.simpleString()}, __target double")
            sums = out.groupBy(name).agg(F.sum("weight").alias("__now")).join(goal, F.col(name).eqNullSafe(F.col("__value")))
            sums = sums.select(F.col(name).alias("__of"), "__now", "__target")
            goals, total = sums.agg(F.sum("__target"), F.sum("__now")).first()
            factor = sums.select("__of", F.when((F.lit(goals or 0.0) > 0) & (F.col("__now") > 0), F.col("__target") / F.lit(goals or 1.0) * F.lit(total or 0.0) / F.col("__now")).otherwise(1.0).alias("__factor"))
            out = out.join(factor, F.col(name).eqNullSafe(F.col("__of")), "left").withColumn("weight", F.col("weight") * F.coalesce("__factor", F.lit(1.0))).select(*cells.columns, "weight")
            done += 1
            out = cut(out) if done % CUT_EVERY == 0 else out
    return out


def _scale(sums, budget: float) -> float:
    """The scale at which the cells' tokens, capped at what they have, come to the budget. ``sums(scale)``
    gives the tokens of the capped cells and the weight of the others."""
    scale = 0.0
    for _ in range(SCALE_STEPS + 1):
        tokens, weight = sums(scale)
        if not weight or weight <= 0:
            break
        scale = (budget - tokens) / weight
    return scale


def calibrated(cells: DataFrame, targets: Mapping[str, Mapping], *, rounds: int = ROUNDS, keep: float = KEEP, local_cells: int = LOCAL_CELLS) -> tuple[DataFrame, bool]:
    """``cells`` (the dimensions in ``targets`` and ``tokens``) with ``weight`` and ``probability``, and whether they are few.

    ``targets``: of each dimension value -> target share, or a table of both for very many values, raked in this order ``rounds`` times, so
    the last dimension fits best. Values without a target keep the share that they have, and the
    others' targets are scaled to the rest; a null is a value like others.
    """
    dimensions = list(targets)
    cells = cells.select(*dimensions, F.col("tokens").cast("long"))
    many = any(isinstance(t, DataFrame) for t in targets.values())
    rows = [] if many else cells.limit(local_cells + 1).collect()
    if not many and len(rows) <= local_cells:
        rows.sort(key=lambda r: [(r[n] is None, r[n]) for n in dimensions])
        weights = _raked_rows(rows, dimensions, targets, rounds)
        budget = keep * sum(r.tokens for r in rows)

        def sums(scale):
            capped = [scale * w >= r.tokens for r, w in zip(rows, weights, strict=True)]
            return sum(r.tokens for r, c in zip(rows, capped, strict=True) if c and scale), sum(w for w, c in zip(weights, capped, strict=True) if not (c and scale))

        scale = _scale(sums, budget)
        kinds = ", ".join(f"`{n}` {cells.schema[n].dataType.simpleString()}" for n in dimensions)
        data = [(*(r[n] for n in dimensions), r.tokens, w, min(1.0, scale * w / r.tokens) if r.tokens else 0.0) for r, w in zip(rows, weights, strict=True)]
        return cells.sparkSession.createDataFrame(data, f"{kinds}, tokens long, weight double, probability double"), True
    out = cut(_raked_frame(cut(cells), dimensions, targets, rounds))
    budget = keep * (out.agg(F.sum("tokens")).first()[0] or 0)

    def sums(scale):
        capped = (F.col("weight") * scale >= F.col("tokens")) & F.lit(scale > 0)
        a, b = out.agg(F.sum(F.when(capped, F.col("tokens"))), F.sum(F.when(~capped, F.col("weight")))).first()
        return a or 0, b or 0.0

    scale = _scale(sums, budget)
    return out.withColumn("probability", F.when(F.col("tokens") > 0, F.least(F.lit(1.0), F.col("weight") * scale / F.col("tokens"))).otherwise(0.0)), False


def tempered(cells: DataFrame, dimension: str, power: float = 0.5, *, local_values: int = LOCAL_CELLS) -> dict | DataFrame:
    """Target shares in proportion to a power of each value's tokens (1: as they are, 0: all alike); of more than
    ``local_values`` values a table of (value, share), which stays distributed."""
    shares = cells.groupBy(dimension).agg(F.sum("tokens").alias("t"))
    rows = shares.limit(local_values + 1).collect()
    if len(rows) > local_values:
        shares = cut(shares.withColumn("t", F.pow("t", F.lit(power))))
        total = shares.agg(F.sum("t")).first()[0] or 1.0
        return shares.select(dimension, (F.col("t") / total).alias("share"))
    total = sum(r.t**power for r in rows) or 1.0
    return {r[dimension]: r.t**power / total for r in rows}


def mix(docs: DataFrame, targets: Mapping[str, Mapping], *, key: str, tokens: str = "n_tokens", **options) -> DataFrame:
    """``docs`` with ``probability`` and ``sampled boolean``: a Poisson sample whose token shares have the targets as
    expectation, as far as the cells have enough tokens; a cell that hasn't is kept whole.

    Null dimensions are values of their own; null token counts count as 0; documents of a cell
    without tokens are never sampled. Equal keys fall in or out together. Other columns stay; those
    named as the two new ones are replaced, and names that start with ``__`` are this operator's own.
    """
    dimensions = list(targets)
    cells = docs.groupBy(*dimensions).agg(F.sum(F.coalesce(F.col(tokens), F.lit(0))).alias("tokens"))
    cells, few = calibrated(cells, targets, **options)
    cells = cells.select(*(F.col(n).alias(f"__{n}") for n in dimensions), F.col("probability").alias("__probability"))
    on = [docs[n].eqNullSafe(F.col(f"__{n}")) for n in dimensions]
    out = docs.join(F.broadcast(cells) if few else cells, on, "left").withColumn("probability", F.col("__probability"))
    return out.drop("__probability", *(f"__{n}" for n in dimensions)).withColumn("sampled", uniform(F.col(key)) < F.col("probability"))
