"""Ranked lexical search: documents of one length normaliser form a stratum, and strata are visited by their bounds."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from lexgraph.llm.common import hashed_words, slices, with_text
from lexgraph.session import drop_tables, ensure_importable, write_table

#: Bytes that part terms: all ASCII but letters and digits.
_PART = np.array([c < 128 and not chr(c).isalnum() for c in range(256)])
#: Terms and documents of a block of the index at most (a longer document is a block of its own).
BLOCK_TERMS, BLOCK_DOCS = 1 << 18, 1 << 15
#: Rows of 24 bytes that may be broadcast, items and terms that are searched at a time, and items scored at a time.
BROADCAST_ROWS, CHUNK_ITEMS, CHUNK_TERMS, GROUP = 200_000, 4096, 200_000, 64
#: Strata an item visits first, those with its highest bounds, to learn which others can be left out.
FIRST_STRATA = 4
NO_ID = np.iinfo(np.int64).max
_COLUMNS = {"m": "long", "doc_ids": "binary", "terms": "binary", "df": "binary", "most": "binary", "groups": "binary", "tfs": "binary", "sizes": "binary", "places": "binary"}


@dataclass
class Index:
    """Blocks of documents with equal m and their postings, a written table; documents with a term (N), and terms (L)."""

    blocks: DataFrame
    documents: int
    terms: int


def impact(tf: np.ndarray, m: int) -> np.ndarray:
    """What one unit of weight earns from a term that stands ``tf`` times; computed once for each tf of a stratum."""
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


def _count_terms(texts: pa.Array) -> np.ndarray:
    out = np.zeros(len(texts), np.int64)
    for lo, hi, part, at in slices(texts):
        if len(part):
            solid = ~_PART[part]
            start = solid.copy()
            start[1:] &= ~solid[:-1]
            first = at[:-1][at[:-1] < len(part)]
            start[first] = solid[first]
            out[lo:hi] = np.diff(np.searchsorted(np.flatnonzero(start), at))
    return out


def _block(m: int, doc_ids: np.ndarray, keys: list[np.ndarray], n: list[int]) -> list:
    """One row of the index: terms in order of hash, each with its postings grouped by tf, the documents by place."""
    doc = np.repeat(np.arange(len(n)), n)
    key = np.concatenate(keys)
    order = np.argsort(key, kind="stable")
    key, doc = key[order], doc[order]
    new = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])]))
    tf = np.diff(np.append(new, len(key)))
    key, doc = key[new], doc[new]
    order = np.lexsort((doc, tf, key))
    key, doc, tf = key[order], doc[order], tf[order]
    term = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    group = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (tf[1:] != tf[:-1])]))
    ends = np.append(term, len(key))
    arrays = (doc_ids.astype("<i8"), key[term], np.diff(ends).astype("<u4"), tf[ends[1:] - 1].astype("<u4"), np.diff(np.searchsorted(group, ends)).astype("<u4"), tf[group].astype("<u4"), np.diff(np.append(group, len(key))).astype("<u4"), doc.astype("<u2"))
    return [m, *(x.tobytes() for x in arrays)]


def build_index(docs: DataFrame) -> Index:
    """Index every whole text (doc_id, text); null texts and those without terms are in no block.

    A first pass counts terms, from which N, L and each length's m follow; then texts
    are dealt by m and, where a stratum is larger than a block, by a hash of the row,
    so no stratum needs one task. A task holds the terms of one block.
    """
    spark = docs.sparkSession
    ensure_importable(spark)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, times = np.unique(_count_terms(batch.column(0)), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(times.astype(np.int64))], ["n", "docs"])

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(_count_terms(batch.column(1)))], ["doc_id", "text", "n"])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, keys, n, rows = None, [], [], [], []

        def close() -> None:
            if n:
                rows.append(_block(now, np.array(ids, np.int64), keys, n))
            ids.clear(), keys.clear(), n.clear()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if i == 0 else pa.binary()) for i, c in enumerate(zip(*rows))], list(_COLUMNS))
            rows.clear()
            return out

        for batch in batches:
            doc_ids, ms = batch.column(0).fill_null(NO_ID).to_pylist(), batch.column(2).to_pylist()
            held = sum(map(len, keys))
            for lo, hi, words, bounds in hashed_words(batch.column(1), _PART):
                for r in range(lo, hi):
                    own = words[bounds[r - lo] : bounds[r - lo + 1]]
                    if ms[r] != now or held + len(own) > BLOCK_TERMS or len(n) == BLOCK_DOCS:
                        close()
                        now, held = ms[r], 0
                        if rows:
                            yield flush()
                    ids.append(doc_ids[r])
                    keys.append(own.copy())
                    n.append(len(own))
                    held += len(own)
        close()
        if rows:
            yield flush()

    rows = with_text(docs)
    lengths = write_table(rows.select("text").mapInArrow(count, "n long, docs long").groupBy("n").agg(F.sum("docs").alias("docs")).where("n > 0"), "lengths")
    total = lengths.agg(F.sum("docs").alias("docs"), F.sum(F.col("n") * F.col("docs")).alias("terms")).first()
    n_docs, n_terms = total["docs"] or 0, total["terms"] or 0
    own = lengths.withColumn("m", F.expr(f"25 + (75L * n * {n_docs}L) div {max(n_terms, 1)}L"))
    parts = own.groupBy("m").agg(F.greatest(F.ceil(F.sum(F.col("n") * F.col("docs")) / BLOCK_TERMS), F.ceil(F.sum("docs") / BLOCK_DOCS)).alias("parts"))
    strata = own.join(parts, "m").select("n", "m", "parts")
    sized = rows.mapInArrow(measure, "doc_id long, text string, n long").where("n > 0")
    placed = sized.join(F.broadcast(strata) if lengths.count() <= BROADCAST_ROWS else strata, "n")
    dealt = placed.withColumn("part", F.pmod(F.xxhash64("doc_id", "text"), F.col("parts"))).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "m", "part").sortWithinPartitions("m", "part")
    blocks = write_table(dealt.select("doc_id", "text", "m").mapInArrow(build, ", ".join(f"{c} {t}" for c, t in _COLUMNS.items())), "ranked-index")
    drop_tables(lengths)
    return Index(blocks, n_docs, n_terms)


class _Chunk:
    """Some items' terms: the sorted distinct ones, and for each the items that hold it and how often."""

    def __init__(self, items: list[list[int]]):
        term = np.array([t for x in items for t in x], np.int64).view(np.uint64)
        item = np.repeat(np.arange(len(items)), [len(x) for x in items])
        order = np.lexsort((item, term))
        term, item = term[order], item[order]
        new = np.flatnonzero(np.concatenate([[True], (term[1:] != term[:-1]) | (item[1:] != item[:-1])])) if len(term) else np.zeros(0, np.int64)
        times, self.item = np.diff(np.append(new, len(term))), item[new]
        self.vocabulary, first = np.unique(term[new], return_index=True)
        self.bounds = np.append(first, len(new))
        self.times, self.n = times.astype(np.int64), len(items)
        self.weights = np.zeros(len(self.vocabulary), np.int64)

    def weigh(self, df: dict[int, int], documents: int) -> None:
        for i, t in enumerate(self.vocabulary.view(np.int64).tolist()):
            if t in df:
                self.weights[i] = math.floor(1000 * math.log((2 * documents + 2) / (2 * df[t] + 1)))

    def found(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the asked terms that a block holds: in the vocabulary, and in the block."""
        at = np.minimum(np.searchsorted(terms, self.vocabulary), len(terms) - 1)
        own = np.flatnonzero(terms[at] == self.vocabulary)
        return own, at[own]

    def limits(self, m: int, own: np.ndarray, most: np.ndarray) -> np.ndarray:
        """For each item, what no document of the block can exceed: every term as often as any document has it."""
        gain = self.weights[own] * impact(most, m)
        size = self.bounds[own + 1] - self.bounds[own]
        at = np.repeat(self.bounds[own] - np.cumsum(size) + size, size) + np.arange(size.sum())
        out = np.zeros(self.n, np.int64)
        np.add.at(out, self.item[at], self.times[at] * np.repeat(gain, size))
        return out


def _column(batch: pa.RecordBatch, name: str, row: int, kind: str) -> np.ndarray:
    return np.frombuffer(batch.column(name)[row].as_py(), kind)


def _merge(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The best ``k``: highest score first, then least id."""
    if len(scores) > k:
        keep = scores >= np.partition(scores, len(scores) - k)[len(scores) - k]
        scores, ids = scores[keep], ids[keep]
    order = np.lexsort((ids, -scores))[:k]
    return scores[order], ids[order]


def _scan(blocks: DataFrame, chunk: _Chunk, k: int, floors: np.ndarray, chosen: dict[int, np.ndarray] | None) -> DataFrame:
    """(item, doc_id, score): each task's best ``k`` of every item, from strata whose bounds reach the item's floor.

    ``chosen`` maps m to the items that visit it (None: all). A task's own k-th best
    raises its floors as it goes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        floor = floors.copy()
        for batch in batches:
            for row in range(len(batch)):
                m = batch.column("m")[row].as_py()
                own, at = chunk.found(_column(batch, "terms", row, "<u8"))
                if not len(own):
                    continue
                limit = chunk.limits(m, own, _column(batch, "most", row, "<u4")[at].astype(np.int64))
                wanted = (limit > 0) & (limit >= floor)
                if chosen is not None:
                    asked = np.zeros(chunk.n, bool)
                    asked[chosen[m]] = True
                    wanted &= asked
                if not wanted.any():
                    continue
                doc_ids, sizes = _column(batch, "doc_ids", row, "<i8"), _column(batch, "sizes", row, "<u4").astype(np.int64)
                group = np.concatenate([[0], np.cumsum(_column(batch, "groups", row, "<u4").astype(np.int64))])
                place, cut = _column(batch, "places", row, "<u2"), np.concatenate([[0], np.cumsum(sizes)])
                worth = impact(_column(batch, "tfs", row, "<u4").astype(np.int64), m)
                listed = np.flatnonzero(wanted)
                for lo in range(0, len(listed), GROUP):
                    some = listed[lo : lo + GROUP]
                    line = np.full(chunk.n, -1)
                    line[some] = np.arange(len(some))
                    score = np.zeros((len(some), len(doc_ids)), np.int64)
                    for t, a in zip(own.tolist(), at.tolist()):
                        of = slice(chunk.bounds[t], chunk.bounds[t + 1])
                        mine = line[chunk.item[of]]
                        if not (held := mine >= 0).any() or not chunk.weights[t]:
                            continue
                        g = slice(group[a], group[a + 1])
                        docs = place[cut[group[a]] : cut[group[a + 1]]]
                        gain = np.repeat(worth[g], sizes[g]) * chunk.weights[t]
                        for i, times in zip(mine[held].tolist(), chunk.times[of][held].tolist()):
                            score[i, docs] += gain if times == 1 else gain * times
                    for i, item in enumerate(some.tolist()):
                        good = np.flatnonzero(score[i] >= max(floor[item], 1))
                        if len(good):
                            s, d = best.get(item, (np.zeros(0, np.int64), np.zeros(0, np.int64)))
                            best[item] = _merge(np.concatenate([s, score[i, good]]), np.concatenate([d, doc_ids[good]]), k)
                            if len(best[item][0]) == k:
                                floor[item] = max(floor[item], best[item][0][-1])
        if best:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in ([np.full(len(s), i) for i, (s, _) in best.items()], [d for _, d in best.values()], [s for s, _ in best.values()])], ["item", "doc_id", "score"])

    return blocks.mapInArrow(run, "item long, doc_id long, score long")


def _best(found: DataFrame, k: int) -> DataFrame:
    order = F.row_number().over(W.partitionBy("item").orderBy(F.desc("score"), "doc_id"))
    return found.withColumn("rank", order).where(F.col("rank") <= k)


def _frequencies(blocks: DataFrame, chunk: _Chunk) -> dict[int, int]:
    """How many documents hold each asked term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(chunk.vocabulary), np.int64)
        for batch in batches:
            for row in range(len(batch)):
                own, at = chunk.found(_column(batch, "terms", row, "<u8"))
                total[own] += _column(batch, "df", row, "<u4")[at]
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(chunk.vocabulary[some].view(np.int64)), pa.array(total[some])], ["term", "df"])

    rows = blocks.select("terms", "df").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))
    return {r["term"]: r["df"] for r in rows.collect()}


def _first_strata(blocks: DataFrame, chunk: _Chunk) -> dict[int, np.ndarray]:
    """For each stratum that some item visits first the items that do: those that have one of their highest bounds there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        high = np.zeros((chunk.n, FIRST_STRATA), np.int64)
        where = np.full((chunk.n, FIRST_STRATA), -1)
        for batch in batches:
            for row in range(len(batch)):
                m = batch.column("m")[row].as_py()
                own, at = chunk.found(_column(batch, "terms", row, "<u8"))
                limit = chunk.limits(m, own, _column(batch, "most", row, "<u4")[at].astype(np.int64))
                # A stratum of several blocks has the highest of their bounds.
                seen = where == m
                line = np.where(seen.any(axis=1), seen.argmax(axis=1), high.argmin(axis=1))
                up = np.flatnonzero(limit > high[np.arange(chunk.n), line])
                high[up, line[up]], where[up, line[up]] = limit[up], m
        item, column = np.nonzero(high)
        yield pa.RecordBatch.from_arrays([pa.array(item), pa.array(where[item, column]), pa.array(high[item, column])], ["item", "m", "high"])

    rows = blocks.select("m", "terms", "most").mapInArrow(run, "item long, m long, high long").groupBy("item", "m").agg(F.max("high").alias("high"))
    best = rows.withColumn("k", F.row_number().over(W.partitionBy("item").orderBy(F.desc("high"), "m"))).where(F.col("k") <= FIRST_STRATA)
    out: dict[int, list[int]] = {}
    for r in best.collect():
        out.setdefault(r["m"], []).append(r["item"])
    return {m: np.array(x) for m, x in out.items()}


def _query_terms(items: DataFrame, key: str) -> DataFrame:
    """(key, terms): each item's terms as hashes, repeats included."""
    ensure_importable(items.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, words, bounds in hashed_words(batch.column(1), _PART):
                terms = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(words.view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), terms], ["item_id", "terms"])

    return items.select(F.col(key).cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "item_id long, terms array<long>").where(F.size("terms") > 0)


def search(index: Index, items: DataFrame, k: int = 10, key: str = "item_id") -> DataFrame:
    """(item_id, rank, doc_id, score): each item's ``k`` best documents with a score above 0, ties by ascending doc_id.

    Items are taken so many at a time (CHUNK_ITEMS, CHUNK_TERMS), each chunk by four
    reads of the index: document frequencies; the strata with each item's highest
    bounds; scores in those, whose k-th best is the item's floor; and all strata but
    those whose bounds stay below it. What goes to the tasks, and what comes back, is
    bounded by the chunk and k. An item without terms has no rows, rows that share an
    id are searched each, and documents without a doc_id rank last among equals.
    """
    spark = items.sparkSession
    chunks: list[list] = [[]]
    held, out = 0, []

    def run_chunk(rows: list) -> DataFrame:
        chunk = _Chunk([r["terms"] for r in rows])
        chunk.weigh(_frequencies(index.blocks, chunk), index.documents)
        chosen = _first_strata(index.blocks, chunk)
        floors = np.zeros(chunk.n, np.int64)
        if chosen:
            for r in _best(_scan(index.blocks.where(F.col("m").isin(list(chosen))), chunk, k, floors, chosen), k).where(F.col("rank") == k).collect():
                floors[r["item"]] = r["score"]
        found = write_table(_best(_scan(index.blocks, chunk, k, floors, None), k), "ranked")
        names = spark.createDataFrame([(i, r["item_id"]) for i, r in enumerate(rows)], "item long, item_id long")
        return found.join(F.broadcast(names), "item").select("item_id", F.col("rank").cast("int").alias("rank"), F.when(F.col("doc_id") != int(NO_ID), F.col("doc_id")).alias("doc_id"), "score")

    for row in write_table(_query_terms(items, key), "items").toLocalIterator():
        if chunks[-1] and (len(chunks[-1]) == CHUNK_ITEMS or held + len(row["terms"]) > CHUNK_TERMS):
            out.append(run_chunk(chunks.pop()))
            chunks.append([])
            held = 0
        chunks[-1].append(row)
        held += len(row["terms"])
    if chunks[-1]:
        out.append(run_chunk(chunks[-1]))
    if not out:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    total = out[0]
    for more in out[1:]:
        total = total.unionByName(more)
    return total


def rank_documents(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """Index the documents, search the items, and drop the index.

    Null and empty texts have no terms; repeated rows are documents of their own,
    with a rank each; an empty table of either kind gives an empty result.
    """
    index = build_index(docs)
    found = search(index, items, k)
    drop_tables(index.blocks)
    return found
