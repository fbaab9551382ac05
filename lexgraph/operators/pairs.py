"""Windowed co-occurrence counts of unordered pairs, marginals and totals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F


def pair_events(sents: DataFrame, window: int = 6, self_pairs: bool = False, keep: tuple[str, ...] = ("sent_id",)) -> DataFrame:
    """(*keep, wa, wb), wa <= wb: one row for each two words at most ``window`` places apart."""
    n = F.size("words")
    sides = [F.arrays_zip(F.slice("words", 1, F.greatest(n - d, F.lit(0))).alias("a"), F.slice("words", d + 1, F.greatest(n - d, F.lit(0))).alias("b")) for d in range(1, window + 1)]
    rows = sents.select(*keep, F.explode(F.concat(*sides) if window > 1 else sides[0]).alias("p"))
    out = rows.select(*keep, F.least("p.a", "p.b").alias("wa"), F.greatest("p.a", "p.b").alias("wb"))
    return out if self_pairs else out.where("wa <> wb")


def ordered_pair_counts(rows: DataFrame, sequence: str, order: list[str], word: str, window: int = 6, self_pairs: bool = False) -> DataFrame:
    """(wa, wb, count) of sequences that stand as rows, one word each, in the order of some columns.

    Equal to pair_counts() of the sequences as arrays, but a sequence of any length
    streams through its window, which Spark spills, and is never one row.
    """
    w = W.partitionBy(sequence).orderBy(*order)
    # A struct tells a null word from the sequence's end.
    after = [F.lead(F.struct(F.col(word).alias("w")), d).over(w).alias(f"a{d}") for d in range(1, window + 1)]
    ahead = rows.select(F.col(word).alias("w"), *after).select("w", F.explode(F.filter(F.array(*(f"a{d}" for d in range(1, window + 1))), lambda x: x.isNotNull())).alias("a"))
    out = ahead.select(F.least("w", "a.w").alias("wa"), F.greatest("w", "a.w").alias("wb"))
    return (out if self_pairs else out.where("wa <> wb")).groupBy("wa", "wb").agg(F.count("*").alias("count"))


def pair_counts(sents: DataFrame, window: int = 6, self_pairs: bool = False) -> DataFrame:
    """(wa, wb, count)."""
    return pair_events(sents, window, self_pairs).groupBy("wa", "wb").agg(F.count("*").alias("count"))


def two_phase_counts(sents: DataFrame, compartments: int, window: int = 2, self_pairs: bool = True) -> DataFrame:
    """Counts for each compartment (sent_id mod n) first, then merged: equal to pair_counts()."""
    part = pair_events(sents, window, self_pairs).groupBy(F.pmod("sent_id", F.lit(compartments)).alias("compartment"), "wa", "wb").agg(F.count("*").alias("c"))
    return part.groupBy("wa", "wb").agg(F.sum("c").alias("count"), F.count("*").alias("compartments"))


def count_given(asked: DataFrame, keys: list[str], counts: DataFrame | None = None) -> DataFrame:
    """(*keys, count): one more for each row of a given list, added to ``counts`` where there are some.

    For pairs the keys are wa and wb, whose order in the list does not matter; for
    sections word and disjunct. Keys of ``counts`` that the list lacks stay.
    """
    rows = asked.select(*keys)
    if keys == ["wa", "wb"]:
        rows = rows.select(F.least("wa", "wb").alias("wa"), F.greatest("wa", "wb").alias("wb"))
    rows = rows.withColumn("count", F.lit(1).cast("long"))
    if counts is not None:
        rows = rows.unionByName(counts.select(*keys, "count"))
    return rows.groupBy(*keys).agg(F.sum("count").alias("count"))


def pair_totals(pairs: DataFrame) -> DataFrame:
    """One row: distinct pairs, pair events, and the sum of all marginals, twice the events."""
    return pairs.agg(F.count("*").alias("n_pairs"), F.coalesce(F.sum("count"), F.lit(0)).alias("n_events"), F.coalesce(2 * F.sum("count"), F.lit(0)).alias("marginal_sum"))


def marginals(pairs: DataFrame) -> DataFrame:
    """(word, marginal): pair events of each word; a self-pair counts twice."""
    return pairs.select(F.explode(F.array("wa", "wb")).alias("word"), "count").groupBy("word").agg(F.sum("count").alias("marginal"))


def merge_counts(old: DataFrame, new: DataFrame) -> DataFrame:
    """(wa, wb, count, dirty): counts added up; dirty marks pairs that ``new`` touches."""
    rows = old.select("wa", "wb", "count", F.lit(False).alias("d")).unionByName(new.select("wa", "wb", "count", F.lit(True).alias("d")))
    return rows.groupBy("wa", "wb").agg(F.sum("count").alias("count"), F.max("d").alias("dirty"))


def pool_stats(sents: DataFrame, pairs: DataFrame, sections: DataFrame | None = None) -> DataFrame:
    """One row: distinct words, distinct pairs, pair events and, if given, sections."""
    words = sents.select(F.explode("words").alias("w")).agg(F.countDistinct("w").alias("n_words"))
    out = words.crossJoin(pairs.agg(F.count("*").alias("n_pairs"), F.coalesce(F.sum("count"), F.lit(0)).alias("n_events")))
    return out if sections is None else out.crossJoin(sections.agg(F.count("*").alias("n_sections")))
