"""Vectorised word and shingle hashing, and document frequencies of hashed keys."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lexgraph.session import drop_tables, write_table

BLOCK = 1 << 20
_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MULT = _rng.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE_LOWER = _BYTE[_LOWER]
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _powers(n: int) -> np.ndarray:
    out = np.full(max(n, 1), _STEP, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string array; null rows are empty."""
    texts = texts.cast(pa.large_string()) if not pa.types.is_large_string(texts.type) else texts
    if texts.null_count:
        texts = texts.fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), offsets


def blocks(offsets: np.ndarray, limit: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes each; a longer row stands alone."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def slices(texts: pa.Array, rows: int = 512) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, row offsets in them): blocks() of the texts, ``rows`` of them at a time."""
    for base in range(0, len(texts), rows):
        data, offsets = buffers(texts.slice(base, rows))
        for lo, hi in blocks(offsets):
            yield base + lo, base + hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]


def hashed_words(texts: pa.Array, space: np.ndarray = _SPACE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, 64-bit hashes of all words, word bounds of each row).

    Words are runs of bytes other than ``space`` (0x20 and 0x09-0x0D); A-Z count as a-z.
    """
    for lo, hi, part, at in slices(texts):
        if not len(part):
            yield lo, hi, np.zeros(0, np.uint64), np.zeros(hi - lo + 1, np.int64)
            continue
        solid = ~space[part]
        start = solid.copy()
        start[1:] &= ~solid[:-1]
        first = at[:-1][at[:-1] < len(part)]
        start[first] = solid[first]
        where = np.flatnonzero(start)
        if not len(where):
            yield lo, hi, np.zeros(0, np.uint64), np.zeros(hi - lo + 1, np.int64)
            continue
        rank = np.cumsum(start) - 1
        depth = np.arange(len(part)) - where[np.maximum(rank, 0)]
        depth[~solid] = 0
        terms = _BYTE_LOWER[part]
        terms *= _powers(int(depth.max()) + 1)[depth]
        terms[~solid] = 0
        yield lo, hi, mix(np.add.reduceat(terms, where)), np.searchsorted(where, at)


def shingles(words: np.ndarray, bounds: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the ``width``-word windows of each row, in order, and their bounds.

    A row with fewer words, but at least one, has its whole sequence as one shingle.
    """
    counts = np.diff(bounds)
    n = len(words)
    body = np.zeros(max(n - width + 1, 0), np.uint64)
    for j in range(width):
        body += words[j : j + len(body)] * _MULT[j]
    sizes = np.maximum(counts - width + 1, (counts > 0).astype(np.int64))
    out_bounds = np.concatenate([[0], np.cumsum(sizes)])
    row = np.repeat(np.arange(len(sizes)), sizes)
    pos = np.arange(out_bounds[-1]) - out_bounds[:-1][row] + bounds[:-1][row]
    out = np.zeros(len(pos), np.uint64)
    short = counts[row] < width
    out[~short] = body[pos[~short]]
    for i in np.flatnonzero(short):
        r = row[i]
        own = words[bounds[r] : bounds[r + 1]]
        out[i] = np.concatenate([own * _MULT[: len(own)], _MULT[40 : 40 + len(own)]]).sum(dtype=np.uint64)
    return mix(out), out_bounds


#: Bits of the bitmap of key_frequencies(), and how many frequent keys and counted keys of a bucket it aims at.
BITS, HOT_KEYS, KEYS_PER_BUCKET = 27, 1 << 19, 1 << 20


class Frequencies:
    """What key_frequencies() found: a fixed-size bitmap of keys that at least two
    documents hold (false positives possible, false negatives not), and the counts
    of the most frequent keys."""

    def __init__(self, bitmap: np.ndarray, hot: np.ndarray, hot_count: np.ndarray, stats: dict):
        self.bitmap, self.hot, self.hot_count, self.stats = bitmap, hot, hot_count, stats

    def shared(self, keys: np.ndarray) -> np.ndarray:
        bit = (keys >> np.uint64(64 - BITS)).astype(np.int64)
        return (self.bitmap[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 == 1

    def count(self, keys: np.ndarray) -> np.ndarray:
        """The document count of frequent keys, 0 for all others."""
        if not len(self.hot):
            return np.zeros(len(keys), np.int64)
        short = keys >> np.uint64(24)
        at = np.minimum(np.searchsorted(self.hot, short), len(self.hot) - 1)
        return np.where(self.hot[at] == short, self.hot_count[at], 0)


def key_frequencies(df: DataFrame, keys_of: Callable[[pa.RecordBatch], Iterator[np.ndarray]], keys: int, hot_over: int = 32, flush: int = 1_000_000) -> Frequencies:
    """Count, over all rows, in how many documents each hashed key stands.

    ``keys_of`` yields arrays of keys, each document's own keys distinct; ``keys``
    is about how many there are in all. Tasks pre-aggregate, pack the counts of each
    hash bucket into one binary value, and shuffle those; a key of any frequency
    adds one entry for each flush, so no key is hot. Buckets are as many as the
    input asks for, and a task holds one at a time. What comes to the driver has a
    fixed size: a bitmap of 2**BITS bits, and about HOT_KEYS frequent keys. Keys
    are told apart by their first 40 bits here. Callers may use both only to skip
    keys that cannot match and to choose an order, never to decide a result, so a
    full bitmap costs time and not rows.
    """
    spark = df.sparkSession
    bits = min(max(8, math.ceil(math.log2(max(keys, 1) / KEYS_PER_BUCKET))), 22)
    hot_per_bucket = max(HOT_KEYS >> bits, 1)

    def pack(kept: list[np.ndarray]) -> pa.RecordBatch:
        found, counts = np.unique(np.concatenate(kept) >> np.uint64(24), return_counts=True)
        bucket = (found >> np.uint64(40 - bits)).astype(np.int64)
        full, first = np.unique(bucket, return_index=True)
        cut = np.append(first, len(found))
        low = (found & np.uint64((1 << (40 - bits)) - 1)).astype(np.uint32)
        counts = counts.astype(np.uint32)
        return pa.RecordBatch.from_arrays(
            [pa.array(full.astype(np.int32)), pa.array([low[x:y].tobytes() for x, y in zip(cut, cut[1:])], pa.binary()), pa.array([counts[x:y].tobytes() for x, y in zip(cut, cut[1:])], pa.binary())], ["bucket", "keys", "counts"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, size = [], 0
        for batch in batches:
            for own in keys_of(batch):
                kept.append(own)
                size += len(own)
                if size >= flush:
                    yield pack(kept)
                    kept, size = [], 0
        if size:
            yield pack(kept)

    def close(b: int, parts: list) -> pa.RecordBatch:
        low, counts = (np.concatenate(x) for x in zip(*parts))
        order = np.argsort(low, kind="stable")
        low, counts = low[order], counts[order].astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], low[1:] != low[:-1]]))
        low, counts = low[first], np.add.reduceat(counts, first)
        two = counts > 1
        marked = np.unique(low[two] >> np.uint32(40 - BITS)).astype(np.int64)
        hot = np.flatnonzero(counts > hot_over)
        hot = np.sort(hot[np.argsort(-counts[hot], kind="stable")[:hot_per_bucket]])
        cold = counts[two & (counts <= hot_over)]
        packed = np.zeros(1 << max(BITS - bits, 0), bool)
        packed[marked] = True
        return pa.RecordBatch.from_arrays(
            [pa.array([b], pa.int32()), pa.array([np.packbits(packed, bitorder="little").tobytes()], pa.binary()), pa.array([low[hot].tobytes()], pa.binary()), pa.array([counts[hot].tobytes()], pa.binary()),
             pa.array([int(counts.sum())]), pa.array([int(cold.sum())]), pa.array([int((cold * (cold - 1)).sum())])],
            ["bucket", "bits", "hot", "hot_counts", "total", "cold", "partners"])

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts = -1, []
        for batch in batches:
            for b, k, c in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                if b != now and parts:
                    yield close(now, parts)
                    parts = []
                now = b
                parts.append((np.frombuffer(k.as_py(), np.uint32), np.frombuffer(c.as_py(), np.uint32)))
        if parts:
            yield close(now, parts)

    packed = df.mapInArrow(gather, "bucket int, keys binary, counts binary")
    spread = packed.repartition(min(1 << bits, int(spark.conf.get("spark.sql.shuffle.partitions"))), "bucket").sortWithinPartitions("bucket")
    found = write_table(spread.mapInArrow(reduce, "bucket int, bits binary, hot binary, hot_counts binary, total long, cold long, partners long"), "frequencies")
    rows = sorted(found.collect(), key=lambda r: r["bucket"])
    drop_tables(found)
    step = 1 << (BITS - bits)
    bitmap = np.zeros(1 << (BITS - 3), np.uint8)
    hot, hot_counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for r in rows:
        at = r["bucket"] * step >> 3
        bitmap[at : at + (step >> 3)] = np.frombuffer(r["bits"], np.uint8)
        hot.append(np.frombuffer(r["hot"], np.uint32).astype(np.uint64) + (np.uint64(r["bucket"]) << np.uint64(40 - bits)))
        hot_counts.append(np.frombuffer(r["hot_counts"], np.int64))
    stats = {k: sum(r[k] for r in rows) for k in ("total", "cold", "partners")}
    return Frequencies(bitmap, np.concatenate(hot), np.concatenate(hot_counts), stats)


def digest128(keys: np.ndarray, bounds: np.ndarray) -> list[bytes]:
    """A 128-bit digest of each row's set of keys, whatever their order."""
    a, b = mix(keys * _MULT[50]), mix(keys ^ _MULT[51])
    total = np.zeros((len(bounds) - 1, 2), np.uint64)
    full = np.flatnonzero(np.diff(bounds))
    if len(full):
        total[full, 0] = np.add.reduceat(a, bounds[:-1][full])
        total[full, 1] = np.add.reduceat(b, bounds[:-1][full])
    total[:, 1] += np.diff(bounds).astype(np.uint64) * _MULT[52]
    return [x.tobytes() for x in total]


def with_text(df: DataFrame, text: str = "text") -> DataFrame:
    """Only the columns the operators read, so that extra ones cannot clash."""
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
