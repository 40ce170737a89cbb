"""Exact top-k inner products by a Voronoi kNN join.

One more coordinate, the square root of what a vector's squared length lacks to the largest one,
turns the largest inner product into the smallest Euclidean distance. Queries and data go to the
cells of their nearest pivots. Summaries of the cells (counts, radii, the few smallest distances to
the pivot) bound how far each group of queries must look; a data row is replicated to those groups
only that its distance to its pivot lets it reach, in blocks of bounded size, and each block is
solved in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rulespan.llm.common import cut

#: Pivots: twice the root of the rows, in these bounds.
PIVOTS = (16, 512)
#: Queries in a group and data rows in a block at most (twice that, at worst, as hashes deal them out).
GROUP_QUERIES, BLOCK_ROWS = 1024, 16_384


def matrix(column: pa.Array, width: int, kind: type = float) -> np.ndarray:
    """Lists of numbers as rows of doubles, or of another ``kind``; shorter lists are filled with zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    values = column.flatten().to_numpy(zero_copy_only=False).astype(kind)
    sizes = np.asarray(pa.compute.list_value_length(column).fill_null(0), np.int64) if len(column) else np.zeros(0, np.int64)
    if (sizes == width).all():
        return values.reshape(-1, width)
    out = np.zeros((len(sizes), width), kind)
    rows = np.repeat(np.arange(len(sizes)), sizes)
    starts = np.cumsum(sizes) - sizes
    out[rows, np.arange(len(values)) - np.repeat(starts, sizes)] = values
    return out


def lifted(v: np.ndarray, squared: float) -> np.ndarray:
    """The coordinate that fills each row's squared length up to ``squared``."""
    return np.sqrt(np.maximum(squared - (v * v).sum(1), 0.0))


def distances(a: np.ndarray, a_up: np.ndarray, b: np.ndarray, b_up: np.ndarray) -> np.ndarray:
    """All Euclidean distances of lifted vectors."""
    d = ((a * a).sum(1) + a_up**2)[:, None] + ((b * b).sum(1) + b_up**2)[None, :] - 2 * (a @ b.T + np.outer(a_up, b_up))
    return np.sqrt(np.maximum(d, 0.0))


def grouped_cells(counts: np.ndarray, between: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each query cell its group, and of each group how many equal parts its queries are dealt into.
    Neighbouring cells share a group while their queries fit; a fuller cell is a group of several parts."""
    group, parts, n = np.full(len(counts), -1), [], 0
    for start in np.argsort(-counts, kind="stable"):
        if group[start] >= 0 or not counts[start]:
            continue
        total = 0
        for cell in np.argsort(between[start], kind="stable"):
            if group[cell] < 0 and counts[cell] and (cell == start or total + counts[cell] <= most):
                group[cell] = n
                total += counts[cell]
            if total >= most:
                break
        parts.append(max(1, -(-int(total) // most)))
        n += 1
    return group, np.array(parts, np.int64)


def _assigned(rows: DataFrame, shared, is_data: bool) -> DataFrame:
    """``rows`` (id, v) with their cell and their distance to its pivot."""

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = shared.value
        for batch in batches:
            if batch.num_rows:
                v = matrix(batch.column("v"), s["width"])
                d = distances(v, lifted(v, s["squared"]) if is_data else np.zeros(len(v)), s["pivots"], s["up"])
                cell = d.argmin(1)
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("v"), pa.array(cell, pa.int32()), pa.array(d[np.arange(len(d)), cell])], names=["id", "v", "cell", "dist"])

    return rows.mapInArrow(assign, f"id long, v {rows.schema['v'].dataType.simpleString()}, cell int, dist double")


def nearest_ids(dist: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """The places of the ``k`` smallest distances of distinct ids, of each id its smallest."""
    order = np.argsort(dist, kind="stable")
    _, first = np.unique(ids[order], return_index=True)
    return order[np.sort(first)[:k]]


def _nearest(data: DataFrame, k: int) -> DataFrame:
    """(cell, id, dist): each cell's ``k`` smallest distances of distinct ids and perhaps some more, at most ``k`` of each task's rows."""

    def least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            cells, ids, dist = (batch.column(c).to_numpy() for c in ("cell", "id", "dist"))
            for c in np.unique(cells).tolist():
                own_ids, own = kept.get(c, (np.zeros(0, np.int64), np.zeros(0)))
                own_ids, own = np.concatenate([own_ids, ids[cells == c]]), np.concatenate([own, dist[cells == c]])
                at = nearest_ids(own, own_ids, k)
                kept[c] = own_ids[at], own[at]
        if kept:
            columns = pa.array(np.repeat(list(kept), [len(x) for _, x in kept.values()]), pa.int32()), *(pa.array(np.concatenate([x[i] for x in kept.values()])) for i in (0, 1))
            yield pa.RecordBatch.from_arrays(list(columns), names=["cell", "id", "dist"])

    return data.select("cell", "id", "dist").mapInArrow(least, "cell int, id long, dist double").groupBy("cell", "id").agg(F.min("dist").alias("dist"))


def best(scores: np.ndarray, ids: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` best (score, id) of one query, ties to smaller ids; of rows with the same id the best counts."""
    use = ids != own
    scores, ids = scores[use], ids[use]
    if len(scores) > k:
        # with repeated ids, k distinct ones may take more than k rows
        floor = np.partition(scores, len(scores) - k)[len(scores) - k]
        top = np.flatnonzero(scores >= floor)
        if len(np.unique(ids[top])) >= k:
            scores, ids = scores[top], ids[top]
    order = np.lexsort((ids, -scores))
    scores, ids = scores[order], ids[order]
    _, first = np.unique(ids, return_index=True)
    first = np.sort(first)[:k]
    return scores[first], ids[first]


def knn_join(queries: DataFrame, data: DataFrame, k: int, *, pivots: tuple[int, int] = PIVOTS, group_queries: int = GROUP_QUERIES, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(query_id long, rank int, vec_id long, score long): the ``k`` highest integer inner products of each query.

    ``queries`` and ``data`` have ``id long`` and ``v array<long>``. Ties go to the smaller id, fewer
    than ``k`` candidates are all given, and a query has no rows where there is none. A row is no
    candidate of a query with its own id. Rows with a null id or vector take no part; a vector that
    is shorter than another counts as filled up with zeros; rows that repeat an id count once, with
    their best score. Scores are exact: doubles do while no two vectors' lengths multiply to 2^53, then
    64-bit integers; from 2^62 on ``ValueError`` is raised. Other columns are ignored.
    """
    spark = data.sparkSession
    clean = lambda df: df.select(F.col("id").cast("long"), F.col("v").cast("array<bigint>")).where("id is not null and v is not null")
    data, queries = clean(data), clean(queries)
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    count, squared, width = data.agg(F.count("*"), F.max(square), F.max(F.size("v"))).first()
    query_width, query_squared = queries.agg(F.max(F.size("v")), F.max(square)).first()
    if not count or query_width is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    # no partial sum of an inner product is larger
    largest = (squared * query_squared) ** 0.5 * (1 + 1e-9)
    if largest >= 2**62:
        raise ValueError("inner products may not fit 64 bits; scale the vectors down")
    kind = float if largest < 2**53 else np.int64
    width = max(width, query_width, 1)
    m = int(min(max(pivots[0], 2 * count**0.5), pivots[1]))
    # a bounded sample by hash; the same vector is a pivot once only
    chosen = np.unique(np.array([r.v + [0] * (width - len(r.v)) for r in data.orderBy(F.xxhash64("id"), "id", "v").limit(m).collect()], float), axis=0)
    shared = spark.sparkContext.broadcast({"pivots": chosen, "up": lifted(chosen, squared), "squared": squared, "width": width})
    data, queries = cut(_assigned(data, shared, True)), cut(_assigned(queries, shared, False))

    # summaries: a row or a few for each cell
    cells = len(chosen)
    n_data, reach = np.zeros(cells, np.int64), np.zeros(cells)
    for r in data.groupBy("cell").agg(F.count("*").alias("n"), F.max("dist").alias("far")).collect():
        n_data[r.cell], reach[r.cell] = r.n, r.far
    n_queries, radius = np.zeros(cells, np.int64), np.zeros(cells)
    for r in queries.groupBy("cell").agg(F.count("*").alias("n"), F.max("dist").alias("far")).collect():
        n_queries[r.cell], radius[r.cell] = r.n, r.far
    by_cell = Window.partitionBy("cell").orderBy("dist")
    near = _nearest(data, k + 1).withColumn("i", F.row_number().over(by_cell)).where(F.col("i") <= k + 1).select("cell", "id", "dist").collect()
    near_cell, near_id, near_dist = np.array([r.cell for r in near], int), np.array([r.id for r in near], np.int64), np.array([r.dist for r in near])

    between = distances(chosen, shared.value["up"], chosen, shared.value["up"])
    slack = 1e-6 * (1 + squared**0.5)
    # k + 1 ids, as the query's own may be one of them, lie within this of every query of the cell
    through = radius[:, None] + between[:, near_cell] + near_dist[None, :]
    bound = np.full(cells, np.inf)
    if len(np.unique(near_id)) > k:
        for i in range(cells):
            bound[i] = through[i, nearest_ids(through[i], near_id, k + 1)[k]]
    # a row of cell j at less than this from its pivot is too far from all queries of cell i
    floor = between - radius[:, None] - bound[:, None] - slack
    group, parts = grouped_cells(n_queries, between, group_queries)
    floors = np.full((len(parts), cells), np.inf)
    for i in np.flatnonzero(group >= 0):
        floors[group[i]] = np.minimum(floors[group[i]], floor[i])
    blocks = np.maximum(1, -(-(np.where(reach[None, :] >= floors, n_data[None, :], 0).sum(1)) // block_rows)).astype(np.int64)
    plan = spark.sparkContext.broadcast({"group": group, "parts": parts, "floors": floors, "blocks": blocks, "first": np.cumsum(parts) - parts})
    dealt_type = "g int, b int, id long, v array<bigint>"

    def scattered(ids: np.ndarray, salt: int) -> np.ndarray:
        x = (ids.astype(np.uint64) ^ np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15)
        return ((x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(33)).astype(np.int64)

    def emitted(batch: pa.RecordBatch, rows: np.ndarray, g: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        at = pa.array(rows)
        return pa.RecordBatch.from_arrays([pa.array(g, pa.int32()), pa.array(b, pa.int32()), batch.column("id").take(at), batch.column("v").take(at)], names=["g", "b", "id", "v"])

    def deal_queries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = plan.value
        for batch in batches:
            g = p["group"][batch.column("cell").to_numpy()]
            own = p["first"][g] + scattered(batch.column("id").to_numpy(), 1) % p["parts"][g]
            n = p["blocks"][g]
            rows = np.repeat(np.arange(len(g)), n)
            yield emitted(batch, rows, own[rows], np.arange(len(rows)) - np.repeat(np.cumsum(n) - n, n))

    def deal_data(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = plan.value
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                batch = whole.slice(at, 2048)
                cell, dist, salt = batch.column("cell").to_numpy(), batch.column("dist").to_numpy(), scattered(batch.column("id").to_numpy(), 2)
                for g in range(len(p["parts"])):
                    rows = np.flatnonzero(dist >= p["floors"][g][cell])
                    if len(rows):
                        n = int(p["parts"][g])
                        copies = np.tile(rows, n)
                        yield emitted(batch, copies, p["first"][g] + np.repeat(np.arange(n), len(rows)), salt[copies] % p["blocks"][g])

    def solve(q: pa.Table, d: pa.Table) -> pa.Table:
        out: list[list] = [[], [], []]
        if q.num_rows and d.num_rows:
            a, b = matrix(q.column("v"), width, kind), matrix(d.column("v"), width, kind)
            ids = d.column("id").to_numpy()
            for at in range(0, len(a), 256):
                scores = a[at : at + 256] @ b.T
                for own, row in zip(q.column("id")[at : at + 256].to_pylist(), scores, strict=True):
                    s, i = best(row, ids, own, k)
                    out[0].append(np.full(len(s), own, np.int64))
                    out[1].append(i)
                    out[2].append(s.astype(np.int64))
        return pa.table([pa.array(np.concatenate(x) if x else [], pa.int64()) for x in out], names=["query_id", "vec_id", "score"])

    dealt_q = queries.mapInArrow(deal_queries, dealt_type).groupBy("g", "b")
    dealt_d = data.mapInArrow(deal_data, dealt_type).groupBy("g", "b")
    found = dealt_q.cogroup(dealt_d).applyInArrow(solve, "query_id long, vec_id long, score long")
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def scaled(vector: Column, factor: float) -> Column:
    """``array<long>`` of floor(factor * x), x as double; null if the vector is null or has a null or non-finite component."""
    wide = F.transform(vector, lambda x: x.cast("double"))
    whole = F.forall(wide, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(vector.isNotNull() & whole, F.transform(wide, lambda x: F.floor(x * F.lit(float(factor))).cast("long")))
