"""Benchmark decontamination by spaced seeds.

Fixed masks of token positions, some of which are ignored, are laid over every place of the
training texts and of the benchmark items. Equal hashes of the regarded positions are hits;
around each hit the two texts are aligned without gaps and the overlap is verified, so that
substituted tokens neither hide a leak (the masks ignore some positions) nor make one up (the
verified overlap must be long and mostly equal).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rulespan.llm.common import U64, WordHashes, byte_values, chunks, hashed_words, mixed, odd_factors

#: 1 regards a token, 0 ignores it. Every mask regards six tokens.
MASKS = ("111111", "1110111", "110110011", "1010011011")
#: An overlap has at least so many tokens in all and so large a share of equal ones.
MIN_TOKENS, MIN_SHARE = 13, 0.75
#: The benchmark goes to every executor in parts of at most so many bytes of text (an index is about 16 times as large).
PART_BYTES = 4 << 20
#: Parts that are probed in one scan of the documents; a task holds so many indexes.
PARTS_A_SCAN = 4

SCHEMA = "item_id long, n_hits int, overlap_start int, overlap_tokens int, equal_tokens int"


def seeds(flat: np.ndarray, mask: str, salt: int) -> np.ndarray:
    """The masked hash at every place of ``flat`` at which the mask fits."""
    count = len(flat) - len(mask) + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(count, U64(salt * 2 + 1))
    for factor, i in zip(odd_factors(len(mask)), range(len(mask)), strict=True):
        if mask[i] == "1":
            out += flat[i : i + count] * factor
    return mixed(out)


def index_items(items: list[tuple[int, bytes | None]], masks: tuple[str, ...]) -> dict:
    """Sorted seed hashes of all items, with the item and place of each. Entries of one hash are sorted by the
    hash at the place before, by its rank among all; -1 where there is none."""
    flat, starts = hashed_words([t for _, t in items], WordHashes())
    keys, owners, places, before = [], [], [], []
    for number, (a, b) in enumerate(zip(starts[:-1], starts[1:], strict=True)):
        for salt, mask in enumerate(masks):
            own = seeds(flat[a:b], mask, salt)
            keys.append(own)
            owners.append(np.full(len(own), number, np.int64))
            places.append(np.arange(len(own), dtype=np.int64))
            before.append(own[:-1] if len(own) else own)
    heads = np.concatenate([np.zeros(0, bool), *(np.arange(len(k)) == 0 for k in keys)]).astype(bool)
    keys, owners, places, before = (np.concatenate([np.zeros(0, kind), *x]) for x, kind in ((keys, np.uint64), (owners, np.int64), (places, np.int64), (before, np.uint64)))
    distinct, rank = np.unique(keys, return_inverse=True)
    prior = np.full(len(keys), -1, np.int64)
    prior[~heads] = np.searchsorted(distinct, before)
    order = np.lexsort((prior, rank))
    size = 1 << max(16, int(len(keys) * 8).bit_length())
    seen = np.zeros(size, bool)
    seen[keys & U64(size - 1)] = True
    # a place in ``codes`` stands for the pair of a hash and the hash before it
    return {"distinct": distinct, "codes": (rank * (len(distinct) + 1) + prior + 1)[order], "owners": owners[order], "places": places[order],
            "flat": flat, "starts": starts, "ids": [i for i, _ in items], "filter": seen}


def longest_stretch(equal: np.ndarray, min_share: float) -> tuple[int, int]:
    """The longest stretch of the aligned tokens whose share of equal ones is ``min_share`` at least:
    [start, end), of equally long ones that with more equal tokens, then the first; [0, 0) where there is none."""
    same = np.concatenate([[0], np.cumsum(equal)])
    places = np.arange(len(same))
    gained = same - min_share * places
    # of each end, the first start with no higher sum before it; sums that are equal but for rounding are equal
    start = np.searchsorted(-np.minimum.accumulate(gained), -gained - 1e-9)
    end = int(np.lexsort((places, same[start] - same, start - places))[0])
    return int(start[end]), end


def spread(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All places of the ranges [first, last), and the range of each."""
    n = last - first
    owner = np.repeat(np.arange(len(n)), n)
    return np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n) + first[owner], owner


def seed_hits(flat: np.ndarray, starts: np.ndarray, index: dict, masks: tuple[str, ...]) -> Iterator[tuple[np.ndarray, ...]]:
    """For each mask: text, item and number of hits; and text, item and shift of the alignments that are hit.

    A hit that only goes on from one at the places before, in text and item, has the same alignment, and isn't
    looked up: a word that is repeated n times in a text and m times in an item has n * m hits, but n + m are seen.
    """
    distinct, codes = index["distinct"], index["codes"]
    base = len(distinct) + 1
    for salt, mask in enumerate(masks):
        own = seeds(flat, mask, salt)
        at = np.flatnonzero(index["filter"][own & U64(len(index["filter"]) - 1)])  # most places end here
        texts = np.searchsorted(starts, at, "right") - 1
        inside = at + len(mask) <= starts[texts + 1]
        at, texts = at[inside], texts[inside]
        rank = np.minimum(np.searchsorted(distinct, own[at]), len(distinct) - 1)
        real = distinct[rank] == own[at]
        at, texts, rank = at[real], texts[real], rank[real]
        if not len(at):
            continue
        # how often each text hits each hash
        pairs, times = np.unique(texts * base + rank, return_counts=True)
        where, k = spread(np.searchsorted(codes, pairs % base * base), np.searchsorted(codes, (pairs % base + 1) * base))
        hits = pairs[k] // base, index["owners"][where], times[k]
        # the hash at the place before, of the same text
        before = np.full(len(at), -1, np.int64)
        later = at > starts[texts]
        prior = np.minimum(np.searchsorted(distinct, own[at[later] - 1]), len(distinct) - 1)
        before[later] = np.where(distinct[prior] == own[at[later] - 1], prior, -1)
        first, last = np.searchsorted(codes, rank * base), np.searchsorted(codes, (rank + 1) * base)
        goes_on = rank * base + before + 1
        a = np.where(before < 0, first, np.searchsorted(codes, goes_on))
        b = np.where(before < 0, first, np.searchsorted(codes, goes_on, "right"))
        where, k = spread(np.concatenate([first, b]), np.concatenate([a, last]))
        k %= len(at)
        yield *hits, texts[k], index["owners"][where], at[k] - starts[texts[k]] - index["places"][where]


def overlaps(flat: np.ndarray, starts: np.ndarray, index: dict, masks: tuple[str, ...], min_tokens: int, min_share: float) -> Iterator[tuple]:
    """(text number, item number, hits, start in the text, tokens, equal tokens) of each text's and item's best verified overlap."""
    if not len(index["distinct"]):
        return
    found = list(seed_hits(flat, starts, index, masks))
    if not found:
        return
    hits: dict[tuple[int, int], int] = {}
    for text, number, n in (x for f in found for x in zip(*(c.tolist() for c in f[:3]), strict=True)):
        hits[text, number] = hits.get((text, number), 0) + n
    aligned = np.unique(np.stack([np.concatenate([f[i] for f in found]) for i in (3, 4, 5)], 1), axis=0)
    texts, numbers, shifts = aligned.T
    lengths = index["starts"][numbers + 1] - index["starts"][numbers]
    low, high = np.maximum(0, shifts), np.minimum(starts[texts + 1] - starts[texts], shifts + lengths)
    # the longest alignments first; what can't be better than what is found isn't looked at
    order = np.lexsort((shifts, low - high, numbers, texts))
    best: dict[tuple[int, int], tuple] = {}
    for text, number, shift, a, b in zip(*(x[order].tolist() for x in (texts, numbers, shifts, low, high)), strict=True):
        top = best.get((text, number))
        if top and (top[0] > b - a or top[0] == top[1] == b - a):
            continue
        item = index["flat"][index["starts"][number] : index["starts"][number + 1]]
        equal = flat[starts[text] + a : starts[text] + b] == item[a - shift : b - shift]
        start, end = longest_stretch(equal, min_share)
        # an item shorter than the least overlap counts if it is there in full length
        if end - start >= min(min_tokens, len(item)):
            one = (end - start, int(equal[start:end].sum()), -(a + start))
            best[text, number] = max(top or one, one)
    for (text, number), (length, same, start) in sorted(best.items()):
        yield text, number, hits[text, number], -start, length, same


def _indexes(benchmark: DataFrame, item_id: str, item_text: str, masks: tuple[str, ...], part_bytes: int) -> list[list]:
    """Broadcast indexes of the benchmark's parts, each of at most about ``part_bytes`` of text, by scan."""
    items = benchmark.select(F.col(item_id).cast("long").alias("item_id"), F.col(item_text).cast("string").alias("text")).where("text is not null")
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    parts = max(1, -(-int(total) // part_bytes))
    out = []
    for part in range(parts):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part) if parts > 1 else items
        texts = sorted(((r.item_id, r.text.encode()) for r in rows.collect()), key=lambda x: (x[0] is None, x[0] or 0, x[1]))
        out.append(benchmark.sparkSession.sparkContext.broadcast(index_items(texts, masks)))
    return [out[i : i + PARTS_A_SCAN] for i in range(0, len(out), PARTS_A_SCAN)]


def find_overlaps(docs: DataFrame, benchmark: DataFrame, *, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
                  item_text: str = "text", masks: tuple[str, ...] = MASKS, min_tokens: int = MIN_TOKENS,
                  min_share: float = MIN_SHARE, part_bytes: int = PART_BYTES) -> DataFrame:
    """One row per document and benchmark item that overlap: the document's id as ``doc_id``, then ``SCHEMA``.

    ``n_hits`` counts seed hits; ``overlap_start`` is the first overlapping token's place in the
    document, counted from 0; the longest overlap is told, then the one with more equal tokens,
    then the first. Any stretch of the aligned tokens that is long and equal enough is an overlap. Words are
    cut at ASCII white space and compared without regard to ASCII case.

    The benchmark goes to the executors in parts of at most ``part_bytes`` of text, one scan of the
    documents for every ``PARTS_A_SCAN`` parts; documents are neither shuffled nor gathered. Null or empty texts
    overlap with nothing, as do items without words; null ids are kept as null; repeated rows each
    count, as do items of one id; other columns are ignored, whatever their names. Items of fewer tokens than the shortest
    mask can't be hit.
    """
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")).where("text is not null")
    id_type = own.schema["doc_id"].dataType.simpleString()
    out = None
    for indexes in _indexes(benchmark, item_id, item_text, masks, part_bytes):

        def search(batches: Iterator[pa.RecordBatch], indexes=indexes) -> Iterator[pa.RecordBatch]:
            known = WordHashes()
            for batch in batches:
                for chunk in chunks(batch, "text"):
                    flat, starts = hashed_words(byte_values(chunk.column("text")), known)
                    for table in (x.value for x in indexes):
                        found = list(overlaps(flat, starts, table, masks, min_tokens, min_share))
                        if found:
                            rows, numbers, n, start, length, same = zip(*found, strict=True)
                            yield pa.RecordBatch.from_arrays(
                                [chunk.column("doc_id").take(pa.array(rows)), pa.array([table["ids"][k] for k in numbers], pa.int64()),
                                 *(pa.array(x, pa.int32()) for x in (n, start, length, same))],
                                names=["doc_id", "item_id", "n_hits", "overlap_start", "overlap_tokens", "equal_tokens"])

        found = own.mapInArrow(search, f"doc_id {id_type}, {SCHEMA}")
        out = found if out is None else out.unionByName(found)
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", item_id: str = "item_id", item_text: str = "text", masks: tuple[str, ...] = MASKS,
                  min_tokens: int = MIN_TOKENS, min_share: float = MIN_SHARE, part_bytes: int = PART_BYTES) -> DataFrame:
    """``docs``, all columns, without the rows that ``find_overlaps`` has an item for; in as many scans, without a
    shuffle."""
    schema = docs.schema
    at = schema.names.index(text)
    for indexes in _indexes(benchmark, item_id, item_text, masks, part_bytes):

        def keep(batches: Iterator[pa.RecordBatch], indexes=indexes) -> Iterator[pa.RecordBatch]:
            known = WordHashes()
            for batch in batches:
                named = batch.rename_columns([f"c{i}" for i in range(batch.num_columns)])
                for chunk in chunks(named, f"c{at}"):
                    flat, starts = hashed_words(byte_values(chunk.column(at)), known)
                    leaked = {x[0] for index in indexes for x in overlaps(flat, starts, index.value, masks, min_tokens, min_share)}
                    rows = [i for i in range(chunk.num_rows) if i not in leaked]
                    yield pa.RecordBatch.from_arrays(chunk.take(pa.array(rows, pa.int64())).columns, schema=batch.schema)

        docs = docs.mapInArrow(keep, schema)
    return docs
