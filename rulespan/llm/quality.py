"""Quality classifier: a Gaussian-kernel ridge model over document statistics.

Random Fourier features approximate the kernel; every partition sums its part of the normal
equations, the driver adds the sums and solves them; isotonic regression turns the ridge scores
into probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rulespan.llm.common import byte_values, chunks

#: Labelled rows that a model is fitted on at most; of more, those with the smallest hashes.
MAX_LABELLED = 20_000
#: Of each five labelled rows for fitting, one is kept for the calibration.
CALIBRATION_FOLDS = 5
N_FEATURES, BANDWIDTH, RIDGE, SEED = 256, 5.0, 1e-2, 7
#: Partial sums that one task adds before they reach the driver.
FAN_IN = 16

_LETTER, _UPPER, _DIGIT, _SPACE, _PUNCT, _HIGH = 1, 2, 4, 8, 16, 32
_KIND = np.zeros(256, np.uint8)
for _b in range(256):
    _c = chr(_b)
    if _b >= 128:
        _KIND[_b] = _HIGH
    elif _c.isalpha():
        _KIND[_b] = _LETTER | (_UPPER if _c.isupper() else 0)
    elif _c.isdigit():
        _KIND[_b] = _DIGIT
    elif _c in " \t\n\r\x0b\x0c":
        _KIND[_b] = _SPACE
    else:
        _KIND[_b] = _PUNCT
#: Punctuation of prose, and the other ASCII signs.
_PROSE = np.zeros(256, bool)
_PROSE[[ord(c) for c in ".,;:'\"-()?!"]] = True

N_STATISTICS = 21


def statistics(text: bytes | None) -> list[float]:
    """Numbers that describe a whole text's form; all 0 for an empty one."""
    if not text or not (words := text.split()):
        return [0.0] * N_STATISTICS
    raw = np.frombuffer(text, np.uint8)
    by_byte = np.bincount(raw, minlength=256).astype(float)
    n, kinds = len(raw), _KIND
    share = lambda flag: float(by_byte[(kinds & flag) > 0].sum()) / n
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    total = len(words)
    distinct = set(words)
    again = sum(a == b for a, b in zip(words, words[1:], strict=False)) / total
    lines = [x for x in text.split(b"\n") if x.strip()]
    line_words = np.fromiter((x.count(b" ") + 1 for x in lines), np.int64, len(lines))
    first = np.frombuffer(b"".join(w[:1] for w in words), np.uint8)
    last = np.frombuffer(b"".join(w[-1:] for w in words), np.uint8)
    present = by_byte[by_byte > 0] / n
    # how evenly distinct words spread over equal parts of the text: repeats far apart show up here
    half = total // 2
    common = len(set(words[:half]) & set(words[half:])) / max(1, len(distinct))
    return [
        np.log1p(total), np.log1p(n), float(lengths.mean()), float(lengths.std()), float(min(lengths.max(), 200)) ** 0.5,
        len(distinct) / total, (len(distinct) / total) * np.log1p(total), again, common,
        share(_LETTER), share(_UPPER), share(_DIGIT), share(_PUNCT), share(_HIGH),
        float(by_byte[(kinds & _PUNCT > 0) & ~_PROSE].sum()) / n,
        float(by_byte[_PROSE].sum()) / n, float((kinds[first] & _UPPER > 0).mean()), float((kinds[last] & _PUNCT > 0).mean()),
        float(-(present * np.log2(present)).sum()), np.log1p(len(lines)), float(np.log1p(line_words.mean())) if len(lines) else 0.0,
    ]


def described(docs: DataFrame, keys: list[str]) -> DataFrame:
    """``keys`` and ``stats array<double>`` of every row of ``docs`` (which has ``text``)."""
    types = {f.name: f.dataType.simpleString() for f in docs.schema.fields}

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in chunks(batch, "text"):
                stats = [statistics(t) for t in byte_values(chunk.column("text"))]
                yield pa.RecordBatch.from_arrays([*(chunk.column(k) for k in keys), pa.array(stats, pa.list_(pa.float64()))], names=[*keys, "stats"])

    return docs.select(*keys, "text").mapInArrow(describe, ", ".join(f"`{k}` {types[k]}" for k in keys) + ", stats array<double>")


def isotonic(score: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: knots (score, probability), both rising; ties of a score are pooled first."""
    at, where = np.unique(score, return_inverse=True)
    weight = np.bincount(where).astype(float)
    mean = np.bincount(where, label) / weight
    blocks: list[list[float]] = []  # mean, weight, first, last
    for x, m, w in zip(at, mean, weight, strict=True):
        blocks.append([m, w, x, x])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            m2, w2, _, z = blocks.pop()
            m1, w1, a, _ = blocks[-1]
            blocks[-1] = [(m1 * w1 + m2 * w2) / (w1 + w2), w1 + w2, a, z]
    knots = [(x, b[0]) for b in blocks for x in dict.fromkeys((b[2], b[3]))]
    return np.array([k[0] for k in knots]), np.array([k[1] for k in knots])


def fourier(stats: np.ndarray, model: dict) -> np.ndarray:
    """Random Fourier features of standardised statistics, and a constant."""
    z = np.clip((stats - model["mean"]) / model["scale"], -8, 8)
    return np.hstack([np.sqrt(2.0 / len(model["shift"])) * np.cos(z @ model["turn"] + model["shift"]), np.ones((len(z), 1))])


def scored(stats: np.ndarray, model: dict) -> np.ndarray:
    """Calibrated probabilities in [0, 1]."""
    if model["weights"] is None:
        return np.full(len(stats), model["prior"])
    raw = fourier(stats, model) @ model["weights"]
    return np.clip(np.interp(raw, *model["knots"]), 0.0, 1.0)


def _summed(rows: DataFrame, column: str) -> np.ndarray:
    """The element-wise sum of packed double vectors. Tasks add up to ``FAN_IN`` partial sums each
    until few are left, so no task and no driver gets one vector for each partition."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for v in batch.column(0).to_pylist():
                x = np.frombuffer(v)
                total = x.copy() if total is None else total + x
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["v"])

    rows = rows.select(F.col(column).alias("v"))
    parts = rows.rdd.getNumPartitions()
    while parts > FAN_IN:
        parts = -(-parts // FAN_IN)
        rows = rows.repartition(parts).mapInArrow(add, "v binary")
    vectors = [np.frombuffer(r.v) for r in rows.collect()]
    return np.sum(vectors, axis=0) if vectors else np.zeros(0)


def fit(docs: DataFrame, labels: DataFrame, *, max_labelled: int = MAX_LABELLED, n_features: int = N_FEATURES,
        bandwidth: float = BANDWIDTH, ridge: float = RIDGE, seed: int = SEED) -> dict:
    """A model of P(label = 1), from ``labels`` (doc_id, label) and the texts of ``docs`` (doc_id, text).

    At most about ``max_labelled`` labelled rows are used: with more, a share chosen by the ids'
    hashes. Null labels and ids are left out, of a doc_id with several labels the largest counts, of one
    with several texts the smallest,
    and without any usable row, or with one class only, every score is the labels' mean (0.5 with
    no label).
    """
    usable = labels.select(F.col("doc_id").alias("__id"), F.col("label").cast("double").alias("__label")).where("__id is not null and __label is not null")
    usable = usable.groupBy("__id").agg(F.max("__label").alias("__label"))
    count = usable.count()
    if count > max_labelled:
        usable = usable.where(F.pmod(F.xxhash64(F.col("__id").cast("string")), F.lit(1_000_000)) < int(1_000_000 * max_labelled / count))
    # at most about max_labelled rows of two numbers: small by construction
    joined = docs.select("doc_id", "text").join(F.broadcast(usable), F.col("doc_id") == F.col("__id"))
    # of the texts of an id one stands for all, so the sample stays bounded
    joined = joined.groupBy("__id").agg(F.max("__label").alias("__label"), F.min("text").alias("text"))
    rows = described(joined.select(F.col("__label").alias("label"), F.pmod(F.crc32(F.concat(F.lit("fold "), F.col("__id").cast("string"))), F.lit(CALIBRATION_FOLDS)).cast("int").alias("fold"), "text"), ["label", "fold"])
    rows = rows.persist()
    try:
        return _fitted(rows, n_features, bandwidth, ridge, seed)
    finally:
        rows.unpersist()


def _fitted(rows: DataFrame, n_features: int, bandwidth: float, ridge: float, seed: int) -> dict:
    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(2 + 2 * N_STATISTICS)
        for batch in batches:
            x = np.array(batch.column("stats").to_pylist()).reshape(-1, N_STATISTICS)
            total += np.concatenate([[len(x), sum(batch.column("label").to_pylist())], x.sum(0), (x * x).sum(0)])
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["v"])

    total = _summed(rows.mapInArrow(moments, "v binary"), "v")
    n, ones = (total[0], total[1]) if len(total) else (0, 0)
    model = {"weights": None, "prior": ones / n if n else 0.5}
    if not 0 < ones < n:
        return model
    mean, square = total[2 : 2 + N_STATISTICS] / n, total[2 + N_STATISTICS :] / n
    scale = np.sqrt(np.maximum(square - mean * mean, 0))
    random = np.random.default_rng(seed)
    model |= {"mean": mean, "scale": np.where(scale > 1e-9, scale, 1.0), "turn": random.normal(size=(N_STATISTICS, n_features)) / bandwidth,
              "shift": random.uniform(0, 2 * np.pi, n_features)}
    d = n_features + 1

    def equations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left, right = np.zeros((d, d)), np.zeros(d)
        for batch in batches:
            x = np.array(batch.column("stats").to_pylist()).reshape(-1, N_STATISTICS)
            use = np.array(batch.column("fold").to_pylist(), int) != 0
            phi, y = fourier(x[use], model), np.array(batch.column("label").to_pylist(), float)[use]
            left += phi.T @ phi
            right += phi.T @ y
        yield pa.RecordBatch.from_arrays([pa.array([np.concatenate([left.ravel(), right]).tobytes()], pa.binary())], names=["v"])

    total = _summed(rows.mapInArrow(equations, "v binary"), "v")
    left, right = total[: d * d].reshape(d, d), total[d * d :]
    penalty = ridge * np.eye(d)
    penalty[-1, -1] = 1e-9
    model["weights"] = np.linalg.solve(left + penalty, right)
    # a fifth of the bounded sample, as (statistics, label); at most about max_labelled / 5 rows
    held = rows.where("fold = 0").select("stats", "label").collect()
    if held:
        raw = fourier(np.array([r.stats for r in held]), model) @ model["weights"]
        model["knots"] = isotonic(raw, np.array([r.label for r in held]))
    else:
        model["knots"] = (np.array([0.0, 1.0]), np.array([0.0, 1.0]))
    return model


def score(docs: DataFrame, model: dict, keys: list[str] | None = None, *, name: str = "score") -> DataFrame:
    """``keys`` (default: doc_id; may include text) and the score as ``name`` of every row, from its
    whole text; null texts count as empty."""
    keys = keys or ["doc_id"]
    shared = docs.sparkSession.sparkContext.broadcast(model)  # some 50 KB, whatever the input

    # a pickled function, a hundred rows at a time, that gives back the score alone: an Arrow one would hold 10,000 texts
    # at once in the executor and its worker, and a map over batches hand all columns back besides
    def rate(text: bytes | None) -> float:
        return float(scored(np.array([statistics(bytes(text) if text else None)]), shared.value)[0])

    return docs.select(*keys, F.udf(rate, "double", useArrow=False)(F.col("text").cast("binary")).alias(name))
