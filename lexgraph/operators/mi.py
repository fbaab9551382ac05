"""Mutual information of pairs: full, incremental, statistics, filters and rankings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lexgraph.session import write_table, written

EPS = 1e-10
#: Bytes of words with their marginals that may be broadcast.
BROADCAST_BYTES = 32 << 20


def mi_expr(count: Column, left: Column, right: Column, total: Column) -> Column:
    """log2(count * total / (left * right)); 0 where count < 1; factors floored at 1e-10."""
    floor = lambda c: F.greatest(c.cast("double"), F.lit(EPS))
    value = F.log2(count.cast("double")) + F.log2(floor(total)) - F.log2(floor(left)) - F.log2(floor(right))
    return F.when(count < 1, F.lit(0.0)).otherwise(value)


def with_marginals(pairs: DataFrame) -> DataFrame:
    """Pairs with left, right (both words' marginals) and total (all pair events).

    Pairs are written first, as they are read three times; marginals are broadcast
    if they are within BROADCAST_BYTES, else joined by shuffles that AQE may split.
    """
    from lexgraph.operators.pairs import marginals

    pairs = written(pairs, "pairs")
    m = write_table(marginals(pairs), "marginals")
    row = m.agg(F.sum(F.octet_length(F.col("word").cast("string")) + 32).alias("size"), F.sum("marginal").alias("twice")).first()
    left = m.select(F.col("word").alias("wa"), F.col("marginal").alias("left"))
    right = m.select(F.col("word").alias("wb"), F.col("marginal").alias("right"))
    if (row["size"] or 0) <= BROADCAST_BYTES:
        left, right = F.broadcast(left), F.broadcast(right)
    # Each pair event counts for both of its words.
    return pairs.join(left, "wa").join(right, "wb").withColumn("total", F.lit((row["twice"] or 0) / 2))


def mi_full(pairs: DataFrame) -> DataFrame:
    """(wa, wb, count, left, right, mi) with every value recomputed."""
    rows = with_marginals(pairs)
    return rows.select("wa", "wb", "count", "left", "right", mi_expr(F.col("count"), F.col("left"), F.col("right"), F.col("total")).alias("mi"))


def mi_changes(state: DataFrame, words: DataFrame, total: float, new: DataFrame) -> tuple[DataFrame, DataFrame, float]:
    """What adding the counts ``new`` changes: pairs (wa, wb, count, mi), words (word, marginal), and the total.

    ``state`` holds pairs (wa, wb, count), ``words`` their marginals. Both words of a
    touched pair are touched, so only rows that ``new`` touches are looked up, and no
    marginal is counted again. ``new`` is read twice: write it first.
    """
    from lexgraph.operators.pairs import marginals

    more = marginals(new).join(words.withColumnRenamed("marginal", "old"), "word", "left")
    touched = write_table(more.select("word", (F.col("marginal") + F.coalesce("old", F.lit(0))).alias("marginal")), "touched")
    both = new.select("wa", "wb", F.col("count").alias("more")).join(state.select("wa", "wb", "count"), ["wa", "wb"], "left")
    count = (F.col("more") + F.coalesce("count", F.lit(0))).alias("count")
    side = lambda c, n: touched.select(F.col("word").alias(c), F.col("marginal").alias(n))
    total += new.agg(F.sum("count")).first()[0] or 0
    rows = both.select("wa", "wb", count).join(side("wa", "left"), "wa").join(side("wb", "right"), "wb")
    return rows.select("wa", "wb", "count", mi_expr(F.col("count"), F.col("left"), F.col("right"), F.lit(total)).alias("mi")), touched, total


def mi_incremental(state: DataFrame, new: DataFrame, words: DataFrame | None = None, total: float | None = None) -> DataFrame:
    """(wa, wb, count, mi) after adding the counts ``new`` to ``state`` (wa, wb, count, mi).

    Only pairs that ``new`` touches get a new value; the others keep the one they
    had, though marginals and total have moved for all. ``words`` and ``total`` are
    the state's marginals and events where they are kept; else they are counted.
    """
    from lexgraph.operators.pairs import marginals

    new = written(new, "new")
    if words is None or total is None:
        words, total = marginals(state), state.agg(F.sum("count")).first()[0] or 0
    changed, _, _ = mi_changes(state, words, total, new)
    return state.select("wa", "wb", "count", "mi").join(new.select("wa", "wb"), ["wa", "wb"], "left_anti").unionByName(changed)


def mi_stats(pairs: DataFrame, threshold: float) -> DataFrame:
    """One row: pairs of count 0.5 or more, those of positive value, and those above the threshold."""
    live = pairs.where("count >= 0.5")
    return live.agg(F.count("*").alias("nonzero"), F.count_if(F.col("mi") > 0).alias("positive"), F.count_if(F.col("mi") > threshold).alias("above"))


def mi_filter(pairs: DataFrame, threshold: float, max_output: int | None = None) -> DataFrame:
    """(wa, wb, mi) of pairs with count > 0.5 and value above the threshold, the best first if capped."""
    out = pairs.where((F.col("count") > 0.5) & (F.col("mi") > threshold)).select("wa", "wb", "mi")
    return out if max_output is None else out.orderBy(F.desc("mi"), "wa", "wb").limit(max_output)


def mi_distribution(pairs: DataFrame) -> DataFrame:
    """One row: positive, negative, NaN and infinite values, the mean positive and the greatest."""
    mi = F.col("mi")
    return pairs.agg(F.count_if(mi > 0).alias("positive"), F.count_if(mi < 0).alias("negative"), F.count_if(F.isnan(mi)).alias("nan"), F.count_if(F.abs(mi) == float("inf")).alias("inf"), F.avg(F.when(mi > 0, mi)).alias("mean_positive"), F.max(mi).alias("max_mi"))


def top_pairs(pairs: DataFrame, n: int = 20) -> DataFrame:
    return pairs.orderBy(F.desc(F.round("mi", 6)), "wa", "wb").limit(n).select("wa", "wb", "count", "mi")
