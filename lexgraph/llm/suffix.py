"""Removal of repeated byte strings, by suffix arrays over shards of candidate stretches."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from lexgraph.llm.common import _BYTE, _MULT, _STEP, _powers, slices, mix, with_text
from lexgraph.session import drop_tables, ensure_importable, write_table

GRAM = 20
LONGEST = 256
SHARD = 2 << 20
#: Stretches of one minimiser, each once for each block of text, that one task may judge.
MOST = 20_000
#: Minimisers with more of them that the driver may hold.
HOT_KEYS = 2_000_000
#: Bits of a bitmap of minimisers, and of a slice of it.
BITS, SLICE_BITS = 27, 19
LANE = 512
FAR = np.iinfo(np.int64).max
_BACK = np.uint64(pow(int(_STEP), -1, 1 << 64))


@functools.lru_cache(1)
def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers of the hash's base and of its inverse."""
    back = np.full(max(n, 1), _BACK, np.uint64)
    back[0] = 1
    return _powers(n), np.multiply.accumulate(back)


def _up_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    power, back = _tables(1 << max(20, (n - 1).bit_length()))
    return power[:n], back[:n]


def stretches(texts: pa.Array, length: int) -> Iterator[tuple]:
    """Cut every row's windows of ``length`` bytes into runs that share a minimiser.

    A window's minimiser is the least hash among its ``GRAM``-byte pieces, so equal
    windows have equal minimisers wherever they stand. Yields (first row, end row,
    bytes, and for each run: row, start in the row, start in the bytes, windows,
    minimiser, hash of the run's bytes; and a function that hashes the windows at
    given places of the bytes). A run has at most ``LONGEST`` windows.
    """
    for lo, hi, part, at in slices(texts):
        n = len(part)
        if n < length:
            continue
        power, back = _up_to(n)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[part] * power, dtype=np.uint64, out=sums[1:])
        least = mix((sums[GRAM:] - sums[:-GRAM]) * back[: n - GRAM + 1])
        width, have = length - GRAM + 1, 1
        while have * 2 <= width:
            least = np.minimum(least[:-have], least[have:])
            have *= 2
        if have < width:
            least = np.minimum(least[: -(width - have)], least[width - have :])
        sizes = np.diff(at)
        row = np.repeat(np.arange(hi - lo), sizes)[: len(least)]
        fits = np.arange(length, length + len(least)) <= np.repeat(at[1:], sizes)[: len(least)]
        new = fits.copy()
        new[1:] &= (least[1:] != least[:-1]) | (row[1:] != row[:-1]) | ~fits[:-1]
        first = np.flatnonzero(new)
        if not len(first):
            continue
        rank = np.cumsum(fits)
        size = np.diff(np.append(rank[first], rank[-1] + 1))
        pieces = -(-size // LONGEST)
        k = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        start = first.repeat(pieces) + k * LONGEST
        windows = np.minimum(size.repeat(pieces) - k * LONGEST, LONGEST)
        end = start + windows - 1 + length
        text_hash = mix((sums[end] - sums[start]) * back[start] + windows.astype(np.uint64) * _MULT[53])

        def hashes(places: np.ndarray, sums=sums, back=back) -> np.ndarray:
            return mix((sums[places + length] - sums[places]) * back[places] + _MULT[54])

        yield lo, hi, part, row[start], start - at[row[start]], start, windows, least[start], text_hash, hashes


def suffix_array(text: np.ndarray, ahead: int) -> tuple[np.ndarray, np.ndarray]:
    """(order of all suffixes, eight bytes from each place on as a number, ``ahead`` places past the end).

    Larsson-Sadakane refinement: suffixes are grouped by eight bytes, then only
    groups of more than one are sorted again, by the groups of what follows, with
    the compared length doubling each time, until every suffix has its own place.
    """
    n = len(text)
    padded = np.concatenate([text, np.zeros(ahead + 16, np.uint8)]).astype(np.uint64)
    word = np.zeros(n + ahead + 8, np.uint64)
    for j in range(8):
        word |= padded[j : j + len(word)] << np.uint64(56 - 8 * j)
    left = np.minimum(n - np.arange(n), 8)
    order = np.lexsort((left, word[:n])) if 0 in text[-8:] else np.argsort(word[:n], kind="stable")
    new = np.ones(n, bool)
    new[1:] = (word[order[1:]] != word[order[:-1]]) | (left[order[1:]] != left[order[:-1]])
    group = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank = np.full(n + 1, -1, np.int64)
    rank[order] = group
    h = 8
    while True:
        many = ~new
        many[:-1] |= ~new[1:]
        places = np.flatnonzero(many)
        if not len(places):
            return order, word
        own = order[places]
        key = group[places] * (n + 2) + rank[np.minimum(own + h, n)] + 1
        by = np.argsort(key, kind="stable")
        own, key = own[by], key[by]
        order[places] = own
        fresh = np.ones(len(places), bool)
        fresh[1:] = key[1:] != key[:-1]
        new[places] |= fresh
        group[places] = np.maximum.accumulate(np.where(fresh, places, 0))
        rank[own] = group[places]
        h *= 2


def common_prefixes(order: np.ndarray, word: np.ndarray, cap: int) -> np.ndarray:
    """Bytes, ``cap`` at most, that each suffix in ``order`` shares with the one before it.

    Kasai's rule: from one text position to the next the common prefix shrinks by
    one at most. The text is cut into lanes that step side by side, eight bytes a
    comparison.
    """
    n = len(order)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    lanes = np.arange(0, n, LANE)
    have = np.zeros(len(lanes), np.int64)
    found = np.zeros(n, np.int64)
    limits = np.uint64(1) << np.arange(8, 64, 8, dtype=np.uint64)
    for s in range(min(LANE, n)):
        i = lanes + s
        if i[-1] >= n:
            lanes, have, i = lanes[:-1], have[:-1], i[:-1]
        j = before[i]
        have = np.where(j < 0, 0, have)
        go = np.flatnonzero((j >= 0) & (have < cap))
        while len(go):
            differ = word[i[go] + have[go]] ^ word[j[go] + have[go]]
            same = 7 - np.searchsorted(limits, differ, "right") + (differ == 0)
            have[go] += same
            go = go[(same == 8) & (have[go] < cap)]
        found[i] = np.minimum(have, cap)
        have = np.maximum(np.minimum(have, cap) - 1, 0)
    return found[order]


def _ranges(at: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """at[0], at[0] + 1, ... at[0] + sizes[0] - 1, at[1], ..."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(at - ends + sizes, sizes)


class Judged:
    """Rows (key, tid, stretch, first, n) in order of key and tid, equal ones made one, and their windows' least documents."""

    def __init__(self, rows: pa.RecordBatch, length: int):
        key, tid = rows.column(0).to_numpy(), rows.column(1).to_numpy()
        new = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (tid[1:] != tid[:-1])]))
        self.length, self.key, self.tid = length, key[new], tid[new]
        self.first = np.minimum.reduceat(rows.column(3).to_numpy(), new)
        self.n = np.add.reduceat(rows.column(4).to_numpy(), new)
        self.texts = rows.column(2).take(pa.array(new)).to_pylist()
        self.windows = np.array([len(t) for t in self.texts]) - length + 1
        self.at = np.cumsum(self.windows) - self.windows
        self.least = np.repeat(self.first, self.windows)

    def contested(self) -> np.ndarray:
        """Rows whose key has other stretches too; for the rest the least document is their own first."""
        same = self.key[1:] == self.key[:-1]
        return np.flatnonzero(np.concatenate([same, [False]]) | np.concatenate([[False], same]))

    def shard(self, which: np.ndarray) -> Shard:
        return Shard([self.texts[k] for k in which], self.first[which], self.length)

    def fill(self, shard: Shard, which: np.ndarray | None = None) -> None:
        which = np.arange(len(self.key)) if which is None else which
        self.least[_ranges(self.at[which], self.windows[which])] = shard.all_least()

    def runs(self) -> pa.RecordBatch:
        """(key, tid, least, lo, hi): runs of windows with one least document, of stretches that may lose bytes."""
        row = np.repeat(np.arange(len(self.key)), self.windows)
        edge = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (self.least[1:] != self.least[:-1])]))
        end = np.append(edge[1:], len(row))
        row, least = row[edge], self.least[edge]
        keep = (self.n[row] > 1) | (least < self.first[row])
        row, least, edge, end = row[keep], least[keep], edge[keep], end[keep]
        return pa.RecordBatch.from_arrays([pa.array(self.key[row]), pa.array(self.tid[row]), pa.array(least), pa.array((edge - self.at[row]).astype(np.int32)), pa.array((end - self.at[row]).astype(np.int32))], ["key", "tid", "least", "lo", "hi"])


class Shard:
    """Distinct stretches, their suffix array, and the least document of each of their windows."""

    def __init__(self, texts: list[bytes], firsts: np.ndarray, length: int):
        self.length = length
        joined = np.frombuffer(b"".join(texts), np.uint8)
        sizes = np.array([len(t) for t in texts])
        ends = np.cumsum(sizes)
        owner = np.repeat(np.arange(len(texts)), sizes)
        order, word = suffix_array(joined, length)
        shared = common_prefixes(order, word, length)
        whole = order + length <= ends[owner[order]]
        starts = np.flatnonzero(shared < length)
        least = np.minimum.reduceat(np.where(whole, firsts[owner[order]], FAR), starts)
        self.least = np.full(len(joined), FAR)
        self.least[order] = least[np.cumsum(shared < length) - 1]
        self.at = ends - sizes
        self.windows = sizes - length + 1
        self.joined = joined

    def all_least(self) -> np.ndarray:
        """The least document of every window, stretch by stretch."""
        return self.least[_ranges(self.at, self.windows)]

    def classes(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(window starts, their distinct strings in order, their least documents) of some stretches."""
        places = np.concatenate([self.at[k] + np.arange(self.windows[k]) for k in which])
        strings = np.lib.stride_tricks.sliding_window_view(self.joined, self.length)[places]
        strings = np.ascontiguousarray(strings).view(f"S{self.length}").ravel()
        return places, strings, self.least[places]


def merge_shards(shards: list[tuple[Shard, np.ndarray]]) -> None:
    """Give equal windows of several shards the least document of all of them.

    Each shard's distinct windows stand in order, so a window of one is looked up
    in the others by binary search.
    """
    sides = []
    for shard, which in shards:
        places, strings, least = shard.classes(which)
        distinct, first = np.unique(strings, return_index=True)
        sides.append([shard, places, strings, distinct, least[first]])
    for a in sides:
        best = a[4].copy()
        for b in sides:
            if a is not b:
                at = np.minimum(np.searchsorted(b[3], a[3]), len(b[3]) - 1)
                best = np.where(b[3][at] == a[3], np.minimum(best, b[4][at]), best)
        a.append(best)
    for shard, places, strings, distinct, _, best in sides:
        shard.least[places] = best[np.searchsorted(distinct, strings)]


class Bits:
    """A fixed-size bitmap of 64-bit keys: false positives possible, false negatives not."""

    def __init__(self, keys: DataFrame):
        """From a column ``key``, by the low bits (minimisers have small high ones); 2**(BITS - SLICE_BITS) slices come to the driver."""

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[int, np.ndarray] = {}
            for batch in batches:
                bit = batch.column(0).to_numpy() & ((1 << BITS) - 1)
                for k in np.unique(bit >> SLICE_BITS).tolist():
                    held.setdefault(k, np.zeros(1 << SLICE_BITS, bool))[bit[bit >> SLICE_BITS == k] & ((1 << SLICE_BITS) - 1)] = True
            for k, bits in held.items():
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())], ["part", "bits"])

        part = F.shiftright("key", SLICE_BITS).bitwiseAND(F.lit((1 << (BITS - SLICE_BITS)) - 1)).cast("int")
        rows = keys.select("key", part.alias("part")).repartition("part").select("key").mapInArrow(pack, "part int, bits binary").collect()
        self.bitmap = np.zeros(1 << (BITS - 3), np.uint8)
        step = 1 << (SLICE_BITS - 3)
        for r in rows:
            self.bitmap[r["part"] * step : (r["part"] + 1) * step] = np.frombuffer(r["bits"], np.uint8)

    def has(self, keys: np.ndarray) -> np.ndarray:
        bit = (keys & np.uint64((1 << BITS) - 1)).astype(np.int64)
        return (self.bitmap[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 == 1


def shared_minimisers(texts: DataFrame, length: int) -> DataFrame:
    """(key, first, tid, n) of minimisers that two documents hold.

    first is their least doc_id, tid the one stretch that all hold (null: there are
    several), n how often they stand, each stretch once for each block of text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).fill_null(FAR).to_numpy()
            for lo, _, _, row, _, _, _, key, digest, _ in stretches(batch.column(1), length):
                order = np.lexsort((digest, key))
                key, digest, own = key[order], digest[order], ids[lo + row[order]]
                new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
                last = np.append(new[1:], len(key)) - 1
                other = np.concatenate([[True], (key[1:] != key[:-1]) | (digest[1:] != digest[:-1])])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key[new].view(np.int64)), pa.array(np.minimum.reduceat(own, new)), pa.array(np.maximum.reduceat(own, new)), pa.array(digest[new].view(np.int64)), pa.array(digest[last].view(np.int64)), pa.array(np.add.reduceat(other.astype(np.int64), new))],
                    ["key", "first", "last", "t0", "t1", "n"])

    rows = texts.mapInArrow(run, "key long, first long, last long, t0 long, t1 long, n long")
    # t0 and t1 are the ends of the unsigned order within a block, of the signed one across blocks: equal only if there is one.
    ends = rows.groupBy("key").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.min(F.least("t0", "t1")).alias("t0"), F.max(F.greatest("t0", "t1")).alias("t1"), F.sum("n").alias("n"))
    return ends.where("first < last").select("key", "first", F.when(F.col("t0") == F.col("t1"), F.col("t0")).alias("tid"), "n")


def _hot_keys(shared: DataFrame) -> np.ndarray:
    """Minimisers that stand more than ``MOST`` times with several stretches; HOT_KEYS of them at most, beyond that the limit rises."""
    many = shared.where("tid is null")
    most = max(MOST, (many.agg(F.sum("n")).first()[0] or 0) // HOT_KEYS)
    return np.array([r["key"] for r in many.where(F.col("n") > most).select("key").collect()], np.int64).view(np.uint64)


def dedup_substrings(docs: DataFrame, length: int = 50) -> DataFrame:
    """Remove every byte under a string of ``length`` bytes that also starts in a document with a smaller doc_id.

    Texts are UTF-8 bytes, null as empty; strings never cross documents, overlaps
    count, and they are judged on the input. Rows without a doc_id neither remove
    nor lose anything; rows with equal doc_ids do not remove from each other.
    Returns doc_id, n_bytes, n_removed, n_spans, spans (array of start and end
    bytes) and kept (binary), one row per input row.

    A first pass aggregates minimisers, to find those that two documents hold, and
    which of them have one stretch alone; that one's windows all have its least
    document. The others' stretches are made distinct, dealt by minimiser, and cut
    into shards of ``SHARD`` bytes with a suffix array each; a minimiser that spans
    shards has them merged by binary search. Results then go back to all documents
    that hold a stretch, by a join. Bitmaps of fixed size leave out most of the
    other stretches before the exchanges; they decide no result. The windows of a
    minimiser with more than ``MOST`` stretches are not judged in one task: each is
    a stretch of its own, dealt by its own hash. Stretches are told apart by 128
    bits of hashes.
    """
    ensure_importable(docs.sparkSession)
    texts = with_text(docs).withColumn("rid", F.xxhash64("text"))
    shared = write_table(shared_minimisers(texts, length), "minimisers")
    held_twice, contested = Bits(shared.select("key")), Bits(shared.where("tid is null").select("key"))
    hot = _hot_keys(shared)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key", "tid", "stretch", "first", "n"]
        for batch in batches:
            ids = batch.column(0).fill_null(FAR).to_numpy()
            for lo, _, part, row, _, start, windows, key, digest, hashes in stretches(batch.column(1), length):
                keep = np.flatnonzero(contested.has(key))
                if len(hot) and len(keep):
                    is_hot = np.isin(key[keep], hot)
                    some, keep = keep[is_hot], keep[~is_hot]
                    tid = hashes(_ranges(start[some], windows[some]))
                    by = mix(tid ^ np.repeat(key[some], windows[some]))
                    order = np.argsort(by, kind="stable")
                    by, tid, own = by[order], tid[order], ids[lo + np.repeat(row[some], windows[some])[order]]
                    new = np.flatnonzero(np.concatenate([[True], (by[1:] != by[:-1]) | (tid[1:] != tid[:-1])])) if len(tid) else order
                    if len(new):
                        n = np.diff(np.append(new, len(tid)))
                        yield pa.RecordBatch.from_arrays([pa.array(by[new].view(np.int64)), pa.array(tid[new].view(np.int64)), pa.nulls(len(new), pa.binary()), pa.array(np.minimum.reduceat(own, new)), pa.array(n)], names)
                keep = keep[np.lexsort((digest[keep], key[keep]))]
                new = np.flatnonzero(np.concatenate([[True], (key[keep[1:]] != key[keep[:-1]]) | (digest[keep[1:]] != digest[keep[:-1]])])) if len(keep) else keep
                if not len(new):
                    continue
                first = np.minimum.reduceat(ids[lo + row[keep]], new)
                n = np.diff(np.append(new, len(keep)))
                keep = keep[new]
                raw = part.tobytes()
                strings = [raw[a : a + w + length - 1] for a, w in zip(start[keep].tolist(), windows[keep].tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(key[keep].view(np.int64)), pa.array(digest[keep].view(np.int64)), pa.array(strings, pa.binary()), pa.array(first), pa.array(n)], names)

    def single(rows: pa.RecordBatch) -> pa.RecordBatch:
        """Windows that stand for themselves. What one batch holds of a window may do: its place loses bytes if any batch has a lesser document."""
        key, tid = rows.column(0).to_numpy(), rows.column(1).to_numpy()
        new = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (tid[1:] != tid[:-1])]))
        least = np.minimum.reduceat(rows.column(3).to_numpy(), new)
        return pa.RecordBatch.from_arrays([pa.array(key[new]), pa.array(tid[new]), pa.array(least), pa.array(np.zeros(len(new), np.int32)), pa.array(np.ones(len(new), np.int32))], ["key", "tid", "least", "lo", "hi"])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        chain: list[tuple[Judged, Shard]] = []

        def settle() -> Iterator[pa.RecordBatch]:
            """The shards that one minimiser spans, once it has ended."""
            if chain:
                merge_shards([(shard, np.arange(len(shard.at))) for _, shard in chain])
                for judged, shard in chain:
                    judged.fill(shard)
                    yield judged.runs()
                chain.clear()

        def close(last: bool) -> Iterator[pa.RecordBatch]:
            """Judge whole minimisers; hold back the last one, or, if it fills a shard, all but its last stretch."""
            nonlocal held, size
            rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            key, tid = rows.column(0).to_numpy(), rows.column(1).to_numpy()
            edge = rows.num_rows if last else int(np.searchsorted(key == key[-1], True))
            if chain:
                own = int((key == chain[0][0].key[0]).sum())
                if own < rows.num_rows or last:
                    if own:
                        judged = Judged(rows.slice(0, own), length)
                        chain.append((judged, judged.shard(np.arange(len(judged.key)))))
                    yield from settle()
                    rows, edge = rows.slice(own), edge - own
                else:
                    edge = 0
            if edge > 0:
                judged = Judged(rows.slice(0, edge), length)
                many = judged.contested()
                if len(many):
                    judged.fill(judged.shard(many), many)
                yield judged.runs()
                rows = rows.slice(edge)
            if not last and rows.nbytes >= SHARD:
                edge = int(np.flatnonzero(rows.column(1).to_numpy() == tid[-1])[0])
                if edge:
                    judged = Judged(rows.slice(0, edge), length)
                    chain.append((judged, judged.shard(np.arange(len(judged.key)))))
                    rows = rows.slice(edge)
            held, size = ([rows], 0) if rows.num_rows else ([], 0)

        for batch in batches:
            alone = batch.column(2).is_null()
            if batch.column(2).null_count:
                yield single(batch.filter(alone))
                batch = batch.filter(pc.invert(alone))
            for lo in range(0, batch.num_rows, 2000):
                part = batch.slice(lo, 2000)
                held.append(part)
                size += part.nbytes
                if size >= SHARD:
                    yield from close(False)
        if held:
            yield from close(True)
        yield from settle()

    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cuts = texts.mapInArrow(cut, "key long, tid long, stretch binary, first long, n long")
    judged = write_table(cuts.repartition(parts, "key").sortWithinPartitions("key", "tid").mapInArrow(judge, "key long, tid long, least long, lo int, hi int"), "stretches")

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key", "tid", "doc_id", "rid", "start", "windows"]
        for batch in batches:
            for lo, _, _, row, start, at, windows, key, digest, hashes in stretches(batch.column(1), length):
                keep = np.flatnonzero(held_twice.has(key))
                if len(hot) and len(keep):
                    is_hot = np.isin(key[keep], hot)
                    some, keep = keep[is_hot], keep[~is_hot]
                    if len(some):
                        tid, rows = hashes(_ranges(at[some], windows[some])), pa.array(lo + np.repeat(row[some], windows[some]))
                        yield pa.RecordBatch.from_arrays([pa.array(mix(tid ^ np.repeat(key[some], windows[some])).view(np.int64)), pa.array(tid.view(np.int64)), batch.column(0).take(rows), batch.column(2).take(rows), pa.array(_ranges(start[some], windows[some])), pa.array(np.ones(len(tid), np.int32))], names)
                rows = pa.array(lo + row[keep])
                yield pa.RecordBatch.from_arrays([pa.array(key[keep].view(np.int64)), pa.array(digest[keep].view(np.int64)), batch.column(0).take(rows), batch.column(2).take(rows), pa.array(start[keep]), pa.array(windows[keep].astype(np.int32))], names)

    held = texts.where("doc_id is not null").mapInArrow(places, "key long, tid long, doc_id long, rid long, start long, windows int")
    alone = shared.where("tid is not null").select("key", "tid", F.col("first").alias("least"), F.lit(0).alias("lo"), F.lit(LONGEST).alias("hi"))
    spans = held.join(judged.unionByName(alone), ["key", "tid"]).where("least < doc_id")
    spans = spans.select("doc_id", "rid", (F.col("start") + F.col("lo")).alias("lo"), (F.col("start") + F.least("hi", "windows") + (length - 1)).alias("hi"))
    spans = write_table(spans.groupBy("doc_id", "rid").agg(F.collect_set(F.struct("lo", "hi")).alias("found")), "spans")
    drop_tables(shared, judged)

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = {k: [] for k in ("n_bytes", "n_removed", "n_spans", "spans", "kept")}
            for value, marked in zip(batch.column(1), batch.column(2).to_pylist()):
                raw = (value.as_py() or "").encode()
                joined: list[list[int]] = []
                for lo, hi in sorted((s["lo"], s["hi"]) for s in marked or []):
                    if joined and lo <= joined[-1][1]:
                        joined[-1][1] = max(joined[-1][1], hi)
                    else:
                        joined.append([lo, hi])
                cuts = [0, *(x for s in joined for x in s), len(raw)]
                out["n_bytes"].append(len(raw))
                out["n_removed"].append(sum(b - a for a, b in joined))
                out["n_spans"].append(len(joined))
                out["spans"].append([{"lo": a, "hi": b} for a, b in joined])
                out["kept"].append(b"".join(raw[a:b] for a, b in zip(cuts[::2], cuts[1::2])))
            types = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())])), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(v, t) for v, t in zip(out.values(), types))], ["doc_id", *out])

    return texts.join(spans, ["doc_id", "rid"], "left").select("doc_id", "text", "found").mapInArrow(remove, "doc_id long, n_bytes long, n_removed long, n_spans long, spans array<struct<lo:long,hi:long>>, kept binary")
