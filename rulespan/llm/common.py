"""What several corpus operators share: cutting lineage, words and their hashes, Arrow helpers."""

from __future__ import annotations

import atexit
import html
import re
import shutil
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Distinct words whose hashes one Python worker keeps; then it starts afresh.
WORD_CACHE = 200_000
#: Bytes of text that a worker looks at together.
CHUNK_BYTES = 2 << 20

U64 = np.uint64


def _temporary_folder() -> str:
    """A folder that goes with the driver's process."""
    folder = tempfile.mkdtemp()
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: that of ``spark.checkpoint.dir``; where that
    is unset, one in the warehouse, or in local mode a temporary one."""
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
        if not folder:
            local = context.master.startswith("local[") or context.master == "local"
            folder = _temporary_folder() if local else spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
        context.setCheckpointDir(folder)
    return context._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder, so that lost executors cost no recomputation."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def delete_folder(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def estimated_bytes(df: DataFrame) -> int:
    """The optimizer's estimate of what ``df`` holds, 0 where it has none; costs no job."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < 1 << 60 else 0


#: A filter of keys has at most so many bits (64 MB), in segments of so many.
FILTER_BITS, SEGMENT_BITS = 1 << 29, 1 << 19


def key_filter(keys: DataFrame, count: int) -> tuple[np.ndarray, int]:
    """A bitmap of the hashes in ``keys`` (h long), two of 16 bits a key while ``FILTER_BITS`` allow, and its
    mask. What it says isn't there isn't; beyond the bound it lets more through, and stays correct."""
    bits = SEGMENT_BITS
    while bits < min(16 * count, FILTER_BITS):
        bits *= 2

    def segment(group: pa.Table) -> pa.Table:
        at = group.column("h").to_numpy() & (SEGMENT_BITS - 1)
        own = np.zeros(SEGMENT_BITS, np.uint8)
        own[at] = 1
        return pa.table([group.column("s").slice(0, 1), pa.array([np.packbits(own, bitorder="little").tobytes()], pa.binary())], names=["s", "bits"])

    both = F.array(F.col("h"), F.shiftrightunsigned("h", 32))
    parts = keys.select(F.explode(F.transform(both, lambda h: h.bitwiseAND(bits - 1))).alias("h")).select("h", F.shiftright("h", SEGMENT_BITS.bit_length() - 1).alias("s")).distinct().groupBy("s").applyInArrow(segment, "s long, bits binary").collect()
    out = np.zeros(bits // 8, np.uint8)
    size = SEGMENT_BITS // 8
    for r in parts:
        out[r.s * size : (r.s + 1) * size] = np.frombuffer(r.bits, np.uint8)
    return out, bits - 1


def maybe_in(hashes: np.ndarray, bitmap: np.ndarray, mask: int) -> np.ndarray:
    out = np.ones(len(hashes), bool)
    for at in (hashes & mask, (hashes.view(np.uint64) >> U64(32)).view(np.int64) & mask):
        out &= (bitmap[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
    return out


class WordHashes(dict):
    """64-bit hashes of words, kept for the words seen lately."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORD_CACHE:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose output bits all depend on all input bits."""
    x = x ^ (x >> U64(32))
    x = x * U64(0xD6E8FEB86659FD93)
    x = x ^ (x >> U64(32))
    x = x * U64(0xD6E8FEB86659FD93)
    return x ^ (x >> U64(32))


def odd_factors(n: int) -> list[np.uint64]:
    """``n`` odd 64-bit factors, made by rule."""
    return [U64(int(v) | 1) for v in mixed(np.arange(1, n + 1, dtype=np.uint64) * U64(0x9E3779B97F4A7C15))]


def byte_values(column: pa.Array) -> list[bytes | None]:
    """A string column's values as UTF-8."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def chunks(batch: pa.RecordBatch, text: str, most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of ``batch`` with about ``most`` bytes of text each (one row at least)."""
    at, size = 0, 0
    lengths = pa.compute.binary_length(batch.column(text)).fill_null(0).to_pylist()
    for i, n in enumerate(lengths):
        if i > at and size + n > most:
            yield batch.slice(at, i - at)
            at, size = i, 0
        size += n
    if at < len(lengths):
        yield batch.slice(at)


_ZEROS, _HUGE = re.compile("&#0+(?=[0-9])"), re.compile("&#[0-9]{8,};?")


def bounded_references(page: str) -> str:
    """The page with numeric references that stand for no character as U+FFFD, which is how they are decoded;
    the standard library refuses to read very long ones."""
    return _HUGE.sub("\ufffd", _ZEROS.sub("&#", page)) if "&#" in page else page


def unescaped(text: str) -> str:
    """The text with its character references decoded, however long their numbers are."""
    return html.unescape(bounded_references(text))


def words_of(text: bytes | None) -> list[bytes]:
    """ASCII-lower-cased words, cut at the six ASCII white-space characters."""
    return text.lower().split() if text else []


def hashed_words(texts: list[bytes | None], known: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts, and where each text starts (one more entry at the end)."""
    per_text = [words_of(t) for t in texts]
    starts = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(w) for w in per_text], out=starts[1:])
    flat = np.fromiter((known[w] for words in per_text for w in words), np.uint64, int(starts[-1]))
    return flat, starts


def shingle_sets(texts: list[bytes | None], width: int, known: WordHashes) -> list[np.ndarray]:
    """Each text's sorted distinct shingle hashes. A text with fewer words than ``width`` has one
    shingle, its whole sequence; one without words has none."""
    flat, starts = hashed_words(texts, known)
    factors = odd_factors(width)
    rolled = np.zeros(len(flat), np.uint64)
    count = max(0, len(flat) - width + 1)
    for i in range(width):
        rolled[:count] += flat[i : i + count] * factors[i]
    rolled = mixed(rolled)
    sets = []
    for a, b in zip(starts[:-1], starts[1:], strict=True):
        n = b - a
        if n >= width:
            sets.append(np.unique(rolled[a : b - width + 1]))
        elif n:
            # a shorter sequence differs from every full shingle by its length
            whole = np.sum(flat[a:b] * np.array(factors[:n], np.uint64), dtype=np.uint64) + U64(int(n))
            sets.append(mixed(np.array([whole], np.uint64)))
        else:
            sets.append(np.zeros(0, np.uint64))
    return sets
