"""Exact n-gram Jaccard join: subset enumeration for small sets, inverted lists for large ones."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from lexgraph.llm.common import Frequencies, digest128, hashed_words, key_frequencies, mix, shingles, with_text
from lexgraph.operators.components import FEW, connected_components
from lexgraph.session import drop_tables, ensure_importable, write_table

LARGEST_BOUNDARY = 256
LEADERS = 64
PARITY_BITS = 1024
#: Rows of at most 64 bytes that may be broadcast.
BROADCAST_ROWS = 200_000
#: Leaders of a round: as many as Spark picks before the exchange, so that a common key is not ranked in one task.
MOST_LEADERS = 1000
SIZE_MASK = (1 << 32) - 1


def _document_sets(batch: pa.RecordBatch, width: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, distinct shingle hashes sorted within each row, bounds)."""
    for lo, hi, words, bounds in hashed_words(batch.column(1)):
        keys, at = shingles(words, bounds, width)
        row = np.repeat(np.arange(hi - lo), np.diff(at))
        order = np.lexsort((keys, row))
        keys = keys[order]
        new = np.ones(len(keys), bool)
        new[1:] = (keys[1:] != keys[:-1]) | (row[1:] != row[:-1])
        yield lo, hi, keys[new], np.searchsorted(row[new], np.arange(hi - lo + 1))


def document_sets(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, n (set size), sid (a 128-bit digest of the set; null for the empty set) and parity.

    ``parity`` has PARITY_BITS bits; each element flips one. The bits in which two
    sets differ are at most as many as the elements in which they differ.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, keys, at in _document_sets(batch, width):
                n = np.diff(at)
                sids = [s if k else None for s, k in zip(digest128(keys, at), n)]
                row = np.repeat(np.arange(hi - lo), n)
                flips = np.bincount(row * PARITY_BITS + (keys & np.uint64(PARITY_BITS - 1)).astype(np.int64), minlength=(hi - lo) * PARITY_BITS) & 1
                parity = [p.tobytes() for p in np.packbits(flips.astype(bool).reshape(-1, PARITY_BITS), axis=1)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(n, pa.int64()), pa.array(sids, pa.binary()), pa.array(parity, pa.binary())], ["doc_id", "n", "sid", "parity"])

    return with_text(docs).mapInArrow(run, "doc_id long, n long, sid binary, parity binary")


def cost_boundary(found: Frequencies, need: float) -> int:
    """The largest set size up to which enumerating pairs costs no more than scanning lists.

    A set of n has n - ceil(need n) + 1 prefix elements to look up, each with a
    list of as many partners as a shared key has on average; or C(p, 2) pairs of
    its p = n - ceil(need n) + 2 prefix elements to emit. Only shared keys count.
    """
    share = found.stats["cold"] / max(found.stats["total"], 1)
    partners = found.stats["partners"] / max(found.stats["cold"], 1)
    best = 0
    for n in range(2, LARGEST_BOUNDARY + 1):
        p = n - math.ceil(need * n) + 1
        pairs = max(share * (p + 1), 2) * max(share * (p + 1) - 1, 1) / 2
        if pairs > max(share * p, 1) * (1 + partners):
            break
        best = n
    return best


def candidate_keys(texts: DataFrame, found: Broadcast[Frequencies], width: int, num: int, den: int, boundary: int) -> DataFrame:
    """(key, place, sno): what two linked sets must share at least one of.

    In one global order of elements, rare ones first, sets that share t elements
    share l of them among the first n - t + l. Two sets of at most ``boundary``
    elements therefore share a pair (l = 2); with a larger one, a single (l = 1).
    Elements that only one set holds are left out by the bitmap, which goes to the
    workers once, apart from the function. ``place`` is
    pos * 2**32 + n for a set of n elements: pos is how many elements come before
    the key's last one, less those of the key itself, so at the first key that two
    linked sets share, n - pos bounds their overlap.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, keys, at in _document_sets(batch, width):
                counts, shared = found.value.count(keys), found.value.shared(keys)
                row = np.repeat(np.arange(hi - lo), np.diff(at))
                order = np.lexsort((keys, counts, row))
                keys, shared = keys[order], shared[order]
                out_keys, out_row, out_place = [], [], []
                for r in range(hi - lo):
                    n = int(at[r + 1] - at[r])
                    t = -(-num * n // den)
                    own, ok = keys[at[r] : at[r + 1]], shared[at[r] : at[r + 1]]
                    made = []
                    if n <= boundary and n > 1:
                        at2 = np.flatnonzero(ok[: n - t + 2])
                        i, j = np.triu_indices(len(at2), 1)
                        low, high = np.minimum(own[at2[i]], own[at2[j]]), np.maximum(own[at2[i]], own[at2[j]])
                        made.append((mix(low * np.uint64(3) ^ mix(high)), at2[j] - 1))
                    if n * den >= num * (boundary + 1):
                        at1 = np.flatnonzero(ok[: n - t + 1])
                        made.append((own[at1], at1))
                    for k, pos in made:
                        out_keys.append(k)
                        out_place.append((pos.astype(np.int64) << 32) + n)
                        out_row.append(np.full(len(k), r))
                if out_keys:
                    sno = batch.column(3).slice(lo, hi - lo).take(pa.array(np.concatenate(out_row).astype(np.int64)))
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_keys).view(np.int64)), pa.array(np.concatenate(out_place)), sno], ["key", "place", "sno"])

    return texts.mapInArrow(run, "key long, place long, sno long")


def _narrow(df: DataFrame, ids: DataFrame, on: str, how: str) -> DataFrame:
    """``df`` joined with a written table of ids, broadcast only if its count is within BROADCAST_ROWS."""
    return df.join(F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids, on, how)


def _texts_of(docs: DataFrame, chosen: DataFrame, width: int) -> DataFrame:
    """doc_id, text, sid, sno: one text for each set, that of the document chosen to stand for it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sids = batch.column(2).to_pylist()
            for lo, hi, keys, at in _document_sets(batch, width):
                yield batch.slice(lo, hi - lo).filter(pa.array([a == b for a, b in zip(digest128(keys, at), sids[lo:hi])], pa.bool_()))

    rows = with_text(docs).join(chosen, "doc_id").select("doc_id", "text", "sid", "sno")
    # Only rows that share a doc_id can have another set than the chosen one, or repeat it.
    return rows.mapInArrow(run, "doc_id long, text string, sid binary, sno long").dropDuplicates(["sno"]) if _repeats(docs) else rows


def _repeats(docs: DataFrame) -> bool:
    """Whether any doc_id stands twice."""
    return not docs.groupBy("doc_id").count().where("count > 1").isEmpty()


def _elements(texts: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """(sno, elements): the elements of each wanted set, from the text that stands for it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, keys, at in _document_sets(batch, width):
                lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(keys.view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(3).slice(lo, hi - lo), lists], ["sno", "elements"])

    return _narrow(texts, wanted, "sno", "left_semi").select("doc_id", "text", "sid", "sno").mapInArrow(run, "sno long, elements array<long>")


def _likely(pairs: DataFrame, parities: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) that their sizes and parities do not rule out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for i in (2, 4))
                n = batch.column(3).to_numpy() + batch.column(5).to_numpy()
                differ = np.bitwise_count(x ^ y).sum(1, dtype=np.int64)
                yield batch.select([0, 1]).filter(pa.array(differ * (den + num) <= n * (den - num)))

    left = parities.select(F.col("sno").alias("a"), F.col("parity").alias("x"), F.col("n").alias("nx"))
    right = parities.select(F.col("sno").alias("b"), F.col("parity").alias("y"), F.col("n").alias("ny"))
    return pairs.join(right, "b").join(left, "a").select("a", "b", "x", "nx", "y", "ny").mapInArrow(run, "a long, b long")


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("sno")).distinct()


def _verified(pairs: DataFrame, texts: DataFrame, numbered: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """The pairs (a, b) with den * intersection >= num * union, as a written table."""
    wanted = write_table(_ends(pairs), "jaccard-ends")
    likely = write_table(_likely(pairs, _narrow(numbered.select("sno", "n", "parity"), wanted, "sno", "left_semi"), num, den), "jaccard-likely")
    asked = write_table(_ends(likely), "jaccard-ends")
    elements = write_table(_elements(texts, asked, width), "jaccard-elements")
    left = elements.select(F.col("sno").alias("a"), F.col("elements").alias("x"))
    right = elements.select(F.col("sno").alias("b"), F.col("elements").alias("y"))
    same = F.size(F.array_intersect("x", "y"))
    links = write_table(likely.join(right, "b").join(left, "a").where(den * same >= num * (F.size("x") + F.size("y") - same)).select("a", "b"), "jaccard-links")
    drop_tables(wanted, likely, asked, elements)
    return links


def jaccard_components(docs: DataFrame, width: int = 4, num: int = 85, den: int = 100) -> DataFrame:
    """Exact components of the documents that Jaccard similarity num/den or more links.

    Returns doc_id, n_shingles, component_id (the least doc_id reachable by links).
    Documents without words have size 0, link with nothing and are their own
    component; fewer words than ``width`` make one shingle. Rows without a doc_id
    link nothing and get a null component. Repeated rows give repeated results.

    Equal sets are first joined into one, which gets a number; one document stands
    for it. Candidates come from candidate_keys(). Within a key, every set is first
    compared with one only, that with the fewest rarer elements, which is nearest to
    most. After components are known, only keys whose sets are still in different
    components go on: ``LEADERS`` of their sets are compared with all others of the
    key, where sizes and places allow a link, and are then done; four times as many
    follow in each further round on what is left, until nothing is. So a group of
    copies costs about one comparison for each, each round is smaller than the one
    before, and no link is lost. The sets of a key that never link are all compared
    in the end, as far as sizes and places allow; leaders are picked before the
    exchange and joined to the others, so no key is one task.
    """
    ensure_importable(docs.sparkSession)
    nameless = document_sets(docs.where("doc_id is null"), width).select("doc_id", F.col("n").alias("n_shingles"), F.lit(None).cast("long").alias("component_id"))
    docs = with_text(docs).where("doc_id is not null")
    sets = write_table(document_sets(docs, width), "jaccard-sets")
    distinct = sets.where("sid is not null").groupBy("sid").agg(F.min("doc_id").alias("doc_id"), F.min("n").alias("n"), F.any_value("parity").alias("parity"))
    numbered = write_table(distinct.withColumn("sno", F.monotonically_increasing_id()), "jaccard-numbered")
    texts = write_table(_texts_of(docs, numbered.select("doc_id", "sid", "sno"), width), "jaccard-texts")

    def keys_of(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        for _, _, keys, _ in _document_sets(batch, width):
            yield keys

    found = key_frequencies(texts.select("doc_id", "text"), keys_of, numbered.agg(F.sum("n")).first()[0] or 0)
    boundary = cost_boundary(found, num / den)
    # Some 24 MB: the driver holds them in no plan, and no longer than they are read.
    sent = docs.sparkSession.sparkContext.broadcast(found)
    del found
    keys = write_table(candidate_keys(texts, sent, width, num, den, boundary), "jaccard-keys")
    sent.destroy()
    heads = keys.groupBy("key").agg(F.min("place").alias("top"), F.min_by("sno", "place").alias("a"), F.count("*").alias("size")).where("size > 1").drop("size")
    lists = write_table(keys.join(heads, "key"), "jaccard-lists")
    drop_tables(keys)

    def fits(x: str, y: str) -> Column:
        n, m = F.col(x).bitwiseAND(SIZE_MASK), F.col(y).bitwiseAND(SIZE_MASK)
        rest = F.least(n - F.shiftright(x, 32), m - F.shiftright(y, 32))
        return (den * F.least(n, m) >= num * F.greatest(n, m)) & ((den + num) * rest >= num * (n + m))

    def ordered(pairs: DataFrame) -> DataFrame:
        return pairs.select(F.least("a", "sno").alias("a"), F.greatest("a", "sno").alias("b")).distinct()

    tested = write_table(ordered(lists.where((F.col("sno") != F.col("a")) & fits("place", "top"))), "jaccard-pairs")
    links = _verified(tested, texts, numbered, width, num, den)
    roots = write_table(connected_components(links, few=FEW), "jaccard-roots")
    open_, step = lists.select("key", "place", "sno"), LEADERS
    while True:
        now = _narrow(open_, roots.withColumnRenamed("node", "sno"), "sno", "left").withColumn("root", F.coalesce("root", "sno"))
        apart = now.groupBy("key").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 <> r1").select("key")
        left = write_table(now.join(apart, "key"), "jaccard-apart")
        if left.isEmpty():
            break
        ranked = left.withColumn("rank", F.row_number().over(W.partitionBy("key").orderBy("place", "sno"))).where(F.col("rank") <= step)
        lead = write_table(ranked.select("key", F.col("sno").alias("a"), F.col("place").alias("top"), F.col("root").alias("ra")), "jaccard-leaders")
        after = (F.col("place") > F.col("top")) | ((F.col("place") == F.col("top")) & (F.col("sno") > F.col("a")))
        more = ordered(left.join(lead, "key").where(after & (F.col("root") != F.col("ra")) & fits("place", "top")))
        more = write_table(more.join(tested, ["a", "b"], "left_anti"), "jaccard-pairs")
        if not more.isEmpty():
            fresh = _verified(more, texts, numbered, width, num, den)
            tested = tested.unionByName(more)
            if not fresh.isEmpty():
                links = links.unionByName(fresh)
                old, roots = roots, write_table(connected_components(links, few=FEW), "jaccard-roots")
                drop_tables(old)
        open_ = write_table(left.join(lead.select("key", F.col("a").alias("sno")), ["key", "sno"], "left_anti").select("key", "place", "sno"), "jaccard-lists")
        drop_tables(left, lead)
        step = min(step * 4, MOST_LEADERS)
    drop_tables(texts, lists)
    members = numbered.select("sid", "sno").join(roots.withColumnRenamed("node", "sno"), "sno").select("sid", "root")
    labelled = sets.drop("parity").join(members, "sid", "left")
    least = labelled.where("root is not null").groupBy("root").agg(F.min("doc_id").alias("by_links"))
    copies = numbered.select("sid", F.col("doc_id").alias("by_copies"))
    out = labelled.join(least, "root", "left").join(copies, "sid", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("by_links", "by_copies", "doc_id").alias("component_id")).unionByName(nameless)
