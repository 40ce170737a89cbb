"""N-gram Jaccard join in metric space, exact, with the linked documents' components.

Jaccard distance is a metric, but unrelated documents are all at distance 1, so pivots taken at
random tell nothing about most of them. Pivots are therefore elected where documents are near:

1. A set is cut by hash into parts. Two sets within the threshold differ in fewer shingles than
   there are parts, so they have a part in common. The document with the smallest hash among those
   with a part in common is their pivot; its Voronoi region holds all of them, boundary documents
   being replicated to each region that they may have a partner in. No link is lost.
2. Inside a region, documents' shingle counts in hash ranges are their distances to fixed pivots
   (the ranges' complements); the triangle inequality on them bounds the size of the symmetric
   difference from below and splits the region into subregions without links between. Subregions
   that share members are joined, so that every document is in one.
3. A subregion is solved in one task: pivot by pivot, distances to a pivot link documents or, by
   triangle-inequality windows, exclude pairs; what is connected already is not compared again.

In both steps, regions too large for one task are dealt over blocks that all meet the region's
pivots; then only documents outside the largest component found meet all blocks. So a region of
copies of one document costs what it holds, and not its square.

Sets stand for themselves by 64-bit hashes of their content, so exact copies are one member
wherever they are many. Hash collisions (odds of 2^-64 a pair) are the only inexactness: among
10^9 different sets 0.03 pairs are expected to be taken for one, among 10^10 about three.
"""

from __future__ import annotations

import bisect
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rulespan.llm.common import U64, WordHashes, byte_values, chunks, cut, estimated_bytes, key_filter, maybe_in, mixed, shingle_sets, shuffle_partitions

#: Sizes of successive classes differ by this factor; each class has its own number of parts.
CLASS_RATIO = 1.3
#: Ranges of a sketch: a power of two near a quarter of the shingles, in these bounds.
RANGES = (64, 65536)
#: One task compares the sketches of at most about so many members of a region, or twice so many of a large one.
SPLIT_MEMBERS = 1000
#: A region that one task solves has at most so many members and shingles in all.
REGION_MEMBERS, REGION_SHINGLES = 1000, 1_000_000
#: Pivots that a larger region's blocks meet first.
BLOCK_PIVOTS = 32
#: Keys that a task gathers before it hands them on; keys and bytes of text that a bucket is planned for.
FLUSH_KEYS, BUCKET_TEXT = 500_000, 64 << 20

_ENTRY = np.dtype([("key", "<u4"), ("sid", "<u8")])


class Classes:
    """Set sizes' classes: upper bounds, parts, and how many parts may be empty."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        self.bounds, self.parts, self.slack = [1], [1], [0]

    def _grow(self, most: int) -> None:
        while self.bounds[-1] < most:
            low, b = self.bounds[-1] + 1, max(self.bounds[-1] + 1, int(self.bounds[-1] * CLASS_RATIO))
            # most shingles in which two linked sets of up to b shingles differ
            differ = (self.den - self.num) * 2 * b // (self.den + self.num)
            slack = 0
            for _ in range(4 if differ > 3 else 0):
                parts = differ + 1 + slack
                empty = parts * math.exp(-max(1, low * self.num // self.den) / parts)
                slack = min(max(slack, math.ceil(empty + 3 * math.sqrt(empty))), differ // 3 + 1)
            self.bounds.append(b)
            self.parts.append(differ + 1 + slack if differ else 1)
            self.slack.append(slack)

    def of(self, n: int) -> range:
        """The classes in which a set of ``n`` shingles meets sets as large or larger, or smaller ones that look up here."""
        most = n * self.den // self.num
        self._grow(most)
        return range(bisect.bisect_left(self.bounds, n), bisect.bisect_left(self.bounds, most) + 1)


def set_id(s: np.ndarray) -> int:
    """A set's 64-bit identity."""
    return int(mixed(np.array([np.sum(mixed(s + U64(77)), dtype=np.uint64) ^ U64(len(s) * 0x9E3779B97F4A7C15 & (2**64 - 1))]))[0])


def part_keys(s: np.ndarray, classes: Classes) -> np.ndarray:
    """A key of every part in every class of the set. Sets that are linked and not equal share one."""
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(s ^ U64(99)), dtype=np.uint64)])
    out = []
    for c in classes.of(len(s)):
        parts = classes.parts[c]
        if parts == 1:
            continue  # so small that only equal sets are linked
        edges = np.searchsorted(s >> U64(32), (np.arange(parts + 1, dtype=np.uint64) << U64(32)) // U64(parts))
        full = edges[1:] > edges[:-1]
        if parts - int(full.sum()) > classes.slack[c]:
            full[:] = True  # then its common parts may all be empty ones
        own = total[edges[1:]] - total[edges[:-1]] + mixed(np.arange(parts, dtype=np.uint64) + U64(c * 1_000_003 + 1))
        out.append(mixed(own[full]))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def ranges_of(n: int) -> int:
    return min(max(1 << max(0, (n // 3).bit_length() - 1), RANGES[0]), RANGES[1])


def sketch(s: np.ndarray) -> np.ndarray:
    """Shingles in each of some hash ranges, up to 255; sketches differ by no more than the sets."""
    ranges = ranges_of(len(s))
    counts = np.bincount((mixed(s ^ U64(5)) >> U64(65 - ranges.bit_length())).astype(np.int64), minlength=ranges)
    return np.minimum(counts, 255).astype(np.uint8)


def _described(docs: DataFrame, width: int) -> DataFrame:
    kind = docs.schema["doc_id"].dataType.simpleString()

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in batches:
            for chunk in chunks(batch, "text"):
                sets = shingle_sets(byte_values(chunk.column("text")), width, known)
                ids = np.array([set_id(s) for s in sets], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([chunk.column("doc_id"), pa.array(map(len, sets), pa.int64()), pa.array(ids), pa.array([sketch(s).tobytes() for s in sets], pa.binary())], names=["doc_id", "n", "sid", "sketch"])

    return docs.mapInArrow(describe, f"doc_id {kind}, n long, sid long, sketch binary")


def _regions(docs: DataFrame, width: int, num: int, den: int, buckets: int) -> DataFrame:
    """(pivot, member): the regions, each with its pivot as a member; a pair may repeat."""

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, classes = WordHashes(), Classes(num, den)
        keys: list[np.ndarray] = []
        ids: list[int] = []
        seen: set[int] = set()

        def flush() -> Iterator[pa.RecordBatch]:
            if keys:
                flat = np.concatenate(keys)
                bucket = (flat % U64(buckets)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                entries = np.empty(len(flat), _ENTRY)
                entries["key"] = flat >> U64(32)
                entries["sid"] = np.repeat(np.array(ids, np.uint64), [len(k) for k in keys])
                entries = entries[order]
                there, first = np.unique(bucket[order], return_index=True)
                packed = [entries[a:b].tobytes() for a, b in zip(first, [*first[1:], len(entries)], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(there, pa.int32()), pa.array(packed, pa.binary())], names=["bucket", "entries"])
            keys.clear()
            ids.clear()
            seen.clear()

        gathered = 0
        for batch in batches:
            for chunk in chunks(batch, "text"):
                for s in shingle_sets(byte_values(chunk.column("text")), width, known):
                    if len(s) and (own := set_id(s)) not in seen:
                        seen.add(own)
                        if len(k := part_keys(s, classes)):
                            keys.append(k)
                            ids.append(own)
                            gathered += len(k)
                if gathered >= FLUSH_KEYS:
                    yield from flush()
                    gathered = 0
        yield from flush()

    def elect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a bucket's entries come in bounded lots; between lots only each key's pivot stays
        kept: dict[int, np.ndarray] = {}
        lots: dict[int, list[np.ndarray]] = {}
        size = 0

        def settle() -> Iterator[pa.RecordBatch]:
            for bucket, new in lots.items():
                old = kept.get(bucket, np.zeros(0, _ENTRY))
                every = np.concatenate([old, *new])
                rank = mixed(every["sid"])
                rank[: len(old)] = 0  # who is pivot stays pivot
                every = every[np.lexsort((rank, every["key"]))]
                first = np.flatnonzero(np.concatenate([[True], every["key"][1:] != every["key"][:-1]]))
                kept[bucket] = every[first]
                pivot = np.repeat(every["sid"][first], np.diff(np.append(first, len(every))))
                pairs = np.unique(np.stack([pivot, every["sid"]], 1)[pivot != every["sid"]], axis=0).view(np.int64)
                own = np.unique(pairs[:, 0])
                pairs = np.concatenate([pairs, np.stack([own, own], 1)])
                for at in range(0, len(pairs), 50_000):
                    yield pa.RecordBatch.from_arrays([pa.array(pairs[at : at + 50_000, i].copy()) for i in (0, 1)], names=["pivot", "member"])
            lots.clear()

        for batch in batches:
            for bucket, entries in zip(batch.column("bucket").to_pylist(), batch.column("entries").to_pylist(), strict=True):
                lots.setdefault(bucket, []).append(np.frombuffer(entries, _ENTRY))
                size += len(lots[bucket][-1])
                if size >= 4 * FLUSH_KEYS:
                    yield from settle()
                    size = 0
        yield from settle()

    dealt = docs.select("text").mapInArrow(keyed, "bucket int, entries binary").repartitionById(buckets, F.col("bucket"))
    return dealt.mapInArrow(elect, "pivot long, member long")


def merged(parent: list[int], a: int, b: int) -> None:
    a, b = root(parent, a), root(parent, b)
    if a != b:
        parent[max(a, b)] = min(a, b)


def root(parent: list[int], i: int) -> int:
    while parent[i] != i:
        parent[i] = parent[parent[i]]
        i = parent[i]
    return i


def folded(counts: np.ndarray, ranges: int) -> np.ndarray:
    """A sketch with fewer ranges, each the sum of neighbouring ones."""
    return counts.reshape(ranges, -1).sum(1, dtype=np.int32)


def near_in_sketches(sketches: list[np.ndarray], sizes: np.ndarray, num: int, den: int) -> Callable[[np.ndarray, int], list[int]]:
    """Of one set's sketch and size, the places of those in ``sketches`` that it doesn't tell apart."""
    coarse = np.array([folded(x, RANGES[0]) for x in sketches]).reshape(len(sketches), RANGES[0])

    def near(own: np.ndarray, size: int) -> list[int]:
        both = sizes + size
        apart = np.abs(coarse - folded(own, RANGES[0])).sum(1)
        out = []
        for i in np.flatnonzero((both - apart) * den >= num * (both + apart)).tolist():
            ranges = min(len(own), len(sketches[i]))
            d = int(np.abs(folded(own, ranges) - folded(sketches[i], ranges)).sum()) if ranges > RANGES[0] else int(apart[i])
            if (int(both[i]) - d) * den >= num * (int(both[i]) + d):
                out.append(i)
        return out

    return near


def near_in_sets(sets: list[np.ndarray], num: int, den: int) -> Callable[[np.ndarray], list[int]]:
    """Of one set, the places of those in ``sets`` that it is linked with."""
    sizes = np.array([len(s) for s in sets])
    starts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)

    def near(own: np.ndarray) -> list[int]:
        inter = _intersections(own, flat, starts)
        return np.flatnonzero(den * inter >= num * (len(own) + sizes - inter)).tolist()

    return near


def possible_links(sketches: list[np.ndarray], sizes: np.ndarray, num: int, den: int, only: int | None = None) -> list[tuple[int, int]]:
    """Pairs that connect what all pairs connect that the sketches don't tell apart. ``only``: pairs with at
    least one of the first so many sketches."""
    parent = list(range(len(sizes)))
    order = np.argsort(sizes, kind="stable").tolist()
    ordered = sizes[order]
    coarse = np.array([folded(sketches[i], RANGES[0]) for i in order]).reshape(len(order), RANGES[0])
    wanted = np.array(order) < (len(order) if only is None else only)
    links = []
    for i, a in enumerate(order):
        # sizes' windows first: a partner is at most 1 / threshold times as large
        end = int(np.searchsorted(ordered, ordered[i] * den // num, "right"))
        if end <= i + 1:
            continue
        both = ordered[i + 1 : end] + ordered[i]
        apart = np.abs(coarse[i + 1 : end] - coarse[i]).sum(1)
        for j in np.flatnonzero(((both - apart) * den >= num * (both + apart)) & (wanted[i + 1 : end] | wanted[i])).tolist():
            b = order[i + 1 + j]
            if root(parent, a) == root(parent, b):
                continue
            ranges = len(sketches[a])  # the smaller set's: partners have as many or twice as many
            d = int(np.abs(folded(sketches[a], ranges) - folded(sketches[b], ranges)).sum()) if ranges > RANGES[0] else int(apart[j])
            if (int(both[j]) - d) * den >= num * (int(both[j]) + d):
                merged(parent, a, b)
                links.append((a, b))
    return links


def stars(ids: list[int], links: list[tuple[int, int]]) -> pa.Table:
    """(a, b): of each member of the links' components the component's smallest id. Regions that overlap
    then name the same pairs."""
    parent, order = list(range(len(ids))), sorted(range(len(ids)), key=ids.__getitem__)
    place = {i: k for k, i in enumerate(order)}
    for a, b in links:
        merged(parent, place[a], place[b])
    roots = [root(parent, k) for k in range(len(ids))]
    pairs = [(ids[order[k]], ids[order[r]]) for k, r in enumerate(roots) if r != k]
    return pa.table([pa.array([x[k] for x in pairs], pa.int64()) for k in (0, 1)], names=["a", "b"])


def _intersections(pivot: np.ndarray, flat: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sizes of the pivot's intersections with the sets that lie one after the other in ``flat``."""
    at = np.minimum(np.searchsorted(pivot, flat), len(pivot) - 1)
    total = np.concatenate([[0], np.cumsum(pivot[at] == flat)])
    return total[starts[1:]] - total[starts[:-1]]


def local_links(sets: list[np.ndarray], num: int, den: int, only: int | None = None) -> list[tuple[int, int]]:
    """Links that connect what all links connect. ``only``: pairs with at least one of the first so many sets.

    Each set in turn is pivot of those that follow. A link makes one component; of a component's
    members no two are compared again. Other pairs are left out where their sizes, or their
    distances to an earlier pivot, differ by more than the threshold allows.
    """
    n = len(sets)
    sizes = np.array([len(s) for s in sets])
    parent = list(range(n))
    label = np.arange(n)
    # dense numbers of the sets' shingles make marking a pivot's shingles a lookup
    flat = np.concatenate(sets) if n else np.zeros(0, np.uint64)
    distinct, numbers = np.unique(flat, return_inverse=True)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    seen_from: list[np.ndarray] = []
    links = []
    mark = np.zeros(len(distinct), bool)
    for p in range(n if only is None else min(only, n)):
        rest = np.arange(p + 1, n)
        near = (label[rest] != label[p]) & (sizes[rest] * den >= sizes[p] * num) & (sizes[p] * den >= sizes[rest] * num)
        for d in seen_from:
            near &= ~(np.abs(d[rest] - d[p]) > (den - num) / den + 1e-9)  # unknown distances exclude nothing
        rest = rest[near]
        if not len(rest):
            continue
        own = numbers[starts[p] : starts[p + 1]]
        mark[own] = True
        if len(rest) * 4 > n:
            total = np.concatenate([[0], np.cumsum(mark[numbers])])
            inter = (total[starts[1:]] - total[starts[:-1]])[rest]
        else:
            inter = np.array([np.count_nonzero(mark[numbers[starts[r] : starts[r + 1]]]) for r in rest.tolist()])
        mark[own] = False
        union = sizes[p] + sizes[rest] - inter
        linked = rest[den * inter >= num * union]
        if len(seen_from) < 8:
            d = np.full(n, np.nan)
            d[rest], d[p] = 1 - inter / union, 0.0
            seen_from.append(d)
        for r in linked.tolist():
            links.append((p, r))
            merged(parent, p, r)
        if len(linked):
            label = np.array([root(parent, i) for i in range(n)])
    return links


def components(edges: DataFrame) -> DataFrame:
    """(node, root): each node's smallest connected node. ``edges``: (a, b), long, in any direction and number.

    Labels sink along the edges and jump to their labels' labels until nothing changes; every
    round's labels are written to the checkpoint folder. Nothing of the graph reaches the driver.
    """
    ways = F.inline(F.array(F.struct(F.col("a").alias("x"), F.col("b").alias("y")), F.struct(F.col("b").alias("x"), F.col("a").alias("y"))))
    both = cut(edges.where("a <> b").select(ways).distinct())
    labels = cut(both.groupBy(F.col("x").alias("node")).agg(F.least(F.min("y"), F.col("node")).alias("root")))
    while True:
        sunk = both.join(labels.select(F.col("node").alias("y"), "root"), "y").groupBy(F.col("x").alias("node")).agg(F.min("root").alias("seen"))
        now = labels.join(sunk, "node").select("node", F.least("root", "seen").alias("root"), F.col("root").alias("was"))
        above = labels.select(F.col("node").alias("root"), F.col("root").alias("above"))
        now = cut(now.join(above, "root", "left").select("node", F.least("root", F.coalesce("above", "root")).alias("root"), "was"))
        changed = now.where("root <> was").limit(1).count()
        labels = now.select("node", "root")
        if not changed:
            return labels


def _solved(members: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b) of the links in each small ``region``: (region, sid, shingles)."""

    def solve(group: pa.Table) -> pa.Table:
        ids = group.column("sid").to_pylist()
        order = sorted(range(len(ids)), key=ids.__getitem__)
        packed = group.column("shingles").to_pylist()
        return stars([ids[i] for i in order], local_links([np.frombuffer(packed[i], np.uint64) for i in order], num, den))

    return members.groupBy("region").applyInArrow(solve, "a long, b long")


def _linked_in_blocks(members: DataFrame, near: Callable, links: Callable) -> DataFrame:
    """(a, b) of links in regions too large for one task, that connect what all links connect.

    ``members``: (region, sid, blocks, size, packed): into how many blocks the region is dealt, and a set by its
    size and content. ``near`` of a block's sizes and contents is a function of one size and content that gives
    the places of its partners; ``links`` of sizes, contents and a number gives the links of the first so many.
    """
    members = members.withColumn("block", F.pmod(F.xxhash64("sid"), F.col("blocks")))
    order = Window.partitionBy("region").orderBy(F.xxhash64("sid", F.lit(1)), "sid")
    pivots = members.withColumn("i", F.row_number().over(order)).where(F.col("i") <= BLOCK_PIVOTS).drop("i")
    everywhere = lambda df: df.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    # the second side of a cogroup gets columns of its own: both come from the same rows
    other = lambda df: df.toDF(*(f"o_{c}" for c in df.columns))
    held = lambda t, prefix="": (np.array(t.column(f"{prefix}size").to_pylist(), np.int64), t.column(f"{prefix}packed").to_pylist())

    def meet(block: pa.Table, chosen: pa.Table) -> pa.Table:
        ids, partners = block.column("sid").to_pylist(), near(*held(block))
        both = list(dict.fromkeys(ids + chosen.column("o_sid").to_pylist()))  # a pivot is a member of one block
        place = {sid: i for i, sid in enumerate(both)}
        # a member names one other, however many pivots it is linked with
        return stars(both, [(place[p], i) for p, size, own in zip(chosen.column("o_sid").to_pylist(), *held(chosen, "o_"), strict=True) for i in partners(int(size), own)] if ids else [])

    met = cut(members.groupBy("region", "block").cogroup(other(everywhere(pivots)).groupBy("o_region", "o_block")).applyInArrow(meet, "a long, b long"))
    labels = components(met)
    # in each region the component with most members is settled; the others' members and the unlinked ones meet all
    known = members.select("region", "sid").join(labels.withColumnRenamed("node", "sid"), "sid", "left")
    size = known.where("root is not null").groupBy("region", "root").agg(F.count("*").alias("size"))
    largest = size.groupBy("region").agg(F.max_by("root", F.struct("size", "root")).alias("largest"))
    loose = known.join(largest, "region", "left").where("root is null or largest is null or root <> largest").select("region", "sid")
    loose = members.join(loose.distinct(), ["region", "sid"], "left_semi").withColumn("own", F.col("block"))

    def cross(few: pa.Table, block: pa.Table) -> pa.Table:
        ids = few.column("sid").to_pylist() + block.column("o_sid").to_pylist()
        (sizes, contents), (more, others) = held(few), held(block, "o_")
        return stars(ids, links(np.concatenate([sizes, more]), contents + others, few.num_rows))

    spread = everywhere(loose).groupBy("region", "own", "block")
    against = everywhere(members.withColumn("other", F.col("block"))).select("region", F.col("block").alias("own"), F.col("other").alias("block"), "sid", "size", "packed")
    against = against.join(loose.select("region", "own").distinct(), ["region", "own"], "left_semi").repartition("region", "own", "block")
    found = spread.cogroup(other(against).groupBy("o_region", "o_own", "o_block")).applyInArrow(cross, "a long, b long")
    return met.unionByName(found)


def _unpacked(contents: list[bytes], kind: type) -> list[np.ndarray]:
    return [np.frombuffer(x, kind) for x in contents]


def _solved_in_blocks(members: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b) of the links in regions too large for one task. ``members``: (region, sid, n, shingles);
    ``n``: into how many blocks the region is dealt."""

    def near(sizes: np.ndarray, contents: list[bytes]) -> Callable:
        partners = near_in_sets(_unpacked(contents, np.uint64), num, den)
        return lambda size, own: partners(np.frombuffer(own, np.uint64))

    def links(sizes: np.ndarray, contents: list[bytes], only: int) -> list[tuple[int, int]]:
        return local_links(_unpacked(contents, np.uint64), num, den, only=only)

    return _linked_in_blocks(members.select("region", "sid", F.col("n").alias("blocks"), F.octet_length("shingles").alias("size"), F.col("shingles").alias("packed")), near, links)


def _subregions(members: DataFrame, num: int, den: int, split_members: int) -> DataFrame:
    """(region, sid): disjoint regions of at least two members, without links between them.
    ``members``: (region, sid, n, sketch)."""
    # written, so that the join's sides are plain shuffles, of which a large region's can be split
    counted = cut(members.groupBy("region").agg(F.ceil(F.count("*") / split_members).alias("blocks")))
    large = counted.where("blocks > 1")

    def link(group: pa.Table) -> pa.Table:
        sizes = np.array(group.column("n").to_pylist(), np.int64)
        return stars(group.column("sid").to_pylist(), possible_links(_unpacked(group.column("sketch").to_pylist(), np.uint8), sizes, num, den))

    if large.isEmpty():
        edges = members.groupBy("region").applyInArrow(link, "a long, b long")
    else:

        def near(sizes: np.ndarray, contents: list[bytes]) -> Callable:
            partners = near_in_sketches(_unpacked(contents, np.uint8), sizes, num, den)
            return lambda size, own: partners(np.frombuffer(own, np.uint8), size)

        def links(sizes: np.ndarray, contents: list[bytes], only: int) -> list[tuple[int, int]]:
            return possible_links(_unpacked(contents, np.uint8), sizes, num, den, only=only)

        dealt = members.join(counted, "region")
        # dealt anew, else the large regions' rows would stay in the tasks of their join
        edges = dealt.where("blocks = 1").drop("blocks").repartition("region").groupBy("region").applyInArrow(link, "a long, b long")
        edges = edges.unionByName(_linked_in_blocks(cut(dealt.where("blocks > 1").select("region", "sid", "blocks", F.col("n").alias("size"), F.col("sketch").alias("packed"))), near, links))
    return components(edges).select(F.col("root").alias("region"), F.col("node").alias("sid"))


def jaccard_components(docs: DataFrame, *, width: int = 5, num: int = 80, den: int = 100, doc_id: str = "doc_id", text: str = "text",
                       split_members: int = SPLIT_MEMBERS, region_members: int = REGION_MEMBERS, region_shingles: int = REGION_SHINGLES) -> DataFrame:
    """(doc_id, n_shingles long, component_id): a row for each row of ``docs``.

    A document's set has its distinct ``width``-word shingles, or with fewer words its whole
    sequence; words are cut at ASCII white space and lower-cased in ASCII. Two documents are linked
    when ``den`` * intersection >= ``num`` * union; the component id is the smallest document id that
    links lead to. Documents without words (also null and empty texts) are linked with nothing.
    Repeated rows each have their row; among a component's null ids any other id is smaller, and
    null stands where there is no other. Other columns are ignored.
    """
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    texts = docs.where("text is not null")
    described = cut(_described(docs, width))
    size = estimated_bytes(docs) or int(texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0])
    buckets = max(shuffle_partitions(docs.sparkSession), -(-size // BUCKET_TEXT))
    regions = cut(_regions(texts, width, num, den, buckets).groupBy("pivot", "member").agg(F.first(F.lit(1)).alias("one")).select(F.col("pivot").alias("region"), F.col("member").alias("sid")))

    sets = described.where("n > 0").groupBy("sid").agg(F.min("n").alias("n"), F.min("sketch").alias("sketch"))
    members = cut(regions.join(sets, "sid"))
    regions = _subregions(members, num, den, split_members)
    sizes = regions.join(sets.select("sid", "n"), "sid").groupBy("region").agg(F.count("*").alias("members"), F.sum("n").alias("shingles"))
    parts = F.greatest(F.ceil(F.col("members") / region_members), F.ceil(F.col("shingles") / region_shingles)).cast("long")
    regions = cut(regions.join(sizes.select("region", parts.alias("n")), "region"))

    def with_shingles(wanted: DataFrame) -> DataFrame:
        """``wanted`` (with sid) and the sets: one document's text of each is read again, and a filter
        keeps most others from being cut into words."""
        wanted_ids = wanted.select("sid").distinct()
        holders = described.where("n > 0").join(wanted_ids, "sid", "left_semi").groupBy("sid").agg(F.min(F.xxhash64("doc_id")).alias("h")).select("h")
        bitmap, mask = key_filter(holders, wanted_ids.count())
        shared = docs.sparkSession.sparkContext.broadcast(bitmap)

        def shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = WordHashes()
            for batch in batches:
                batch = batch.filter(pa.array(maybe_in(batch.column("h").to_numpy(), shared.value, mask)))
                for chunk in chunks(batch, "text"):
                    found = shingle_sets(byte_values(chunk.column("text")), width, known)
                    yield pa.RecordBatch.from_arrays([pa.array(np.array([set_id(s) for s in found], np.uint64).view(np.int64)), pa.array([s.tobytes() for s in found], pa.binary())], names=["sid", "shingles"])

        shingles = texts.select(F.xxhash64("doc_id").alias("h"), "text").mapInArrow(shingled, "sid long, shingles binary").dropDuplicates(["sid"])
        return wanted.join(shingles, "sid")

    edges = _solved(with_shingles(regions.where("n = 1")), num, den)
    large = regions.where("n > 1")
    if not large.isEmpty():
        edges = edges.unionByName(_solved_in_blocks(cut(with_shingles(large)), num, den))
    roots = components(edges)
    # of each component with several sets, or of each set, the smallest document
    named = described.where("n > 0").groupBy("sid").agg(F.min("doc_id").alias("first")).join(roots.withColumnRenamed("node", "sid"), "sid", "left")
    named = named.withColumn("root", F.coalesce("root", "sid"))
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    named = named.select("sid", "root").join(least, "root").select("sid", "component_id")
    linked = described.where("n > 0").select("doc_id", "n", "sid").join(named, "sid", "left").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return linked.unionByName(described.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))
