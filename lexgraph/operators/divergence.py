"""Context divergence of words between two corpora."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from lexgraph.operators import pairs
from lexgraph.operators.mi import mi_expr
from lexgraph.session import drop_tables, write_table

TOP_K = 32


def neighbourhoods(mi: DataFrame, k: int = TOP_K, by: tuple[str, ...] = ()) -> DataFrame:
    """(*by, word, partner, mi, rank): each word's ``k`` best partners of positive value, ties by partner."""
    sides = F.explode(F.array(F.struct(F.col("wa").alias("word"), F.col("wb").alias("partner")), F.struct(F.col("wb").alias("word"), F.col("wa").alias("partner"))))
    rows = mi.where("count >= 1 and mi > 0 and wa <> wb").select(*by, sides.alias("e"), "mi").select(*by, "e.word", "e.partner", F.round("mi", 9).alias("mi"))
    return rows.withColumn("rank", F.row_number().over(W.partitionBy(*by, "word").orderBy(F.desc("mi"), "partner"))).where(F.col("rank") <= k)


def sided_neighbourhoods(sents: DataFrame, side: str = "side", window: int = 2, k: int = TOP_K) -> DataFrame:
    """(side, word, partner, mi, rank) of sentences (side, words) of several corpora, by one pass over them: a written table.

    Pairs, marginals and totals are counted by side; each side's values are its own.
    """
    counts = write_table(pairs.pair_events(sents, window, keep=(side,)).groupBy(side, "wa", "wb").agg(F.count("*").alias("count")), "sided")
    marginal = counts.select(side, F.explode(F.array("wa", "wb")).alias("word"), "count").groupBy(side, "word").agg(F.sum("count").alias("m"))
    total = counts.groupBy(side).agg(F.sum("count").alias("total"))
    left, right = (marginal.select(side, F.col("word").alias(w), F.col("m").alias(n)) for w, n in (("wa", "left"), ("wb", "right")))
    rows = counts.join(left, [side, "wa"]).join(right, [side, "wb"]).join(total, side)
    value = mi_expr(F.col("count"), F.col("left"), F.col("right"), F.col("total"))
    found = write_table(neighbourhoods(rows.select(side, "wa", "wb", "count", value.alias("mi")), k, (side,)), "neighbourhoods")
    drop_tables(counts)
    return found


def divergence(a: DataFrame, b: DataFrame, threshold: float = 0.5, least: int = 3) -> DataFrame:
    """(word, na, nb, divergence, polysemous) for words with neighbourhoods in ``a`` or ``b``.

    1 - cosine of the two; 0 and not polysemous where either has fewer than ``least`` partners.
    """
    sums = lambda x, n, s: x.groupBy("word").agg(F.count("*").alias(n), F.sum(F.col("mi") * F.col("mi")).alias(s))
    dots = a.select("word", "partner", F.col("mi").alias("x")).join(b.select("word", "partner", F.col("mi").alias("y")), ["word", "partner"]).groupBy("word").agg(F.sum(F.col("x") * F.col("y")).alias("dot"))
    rows = sums(a, "na", "sa").join(sums(b, "nb", "sb"), "word", "full").join(dots, "word", "left").na.fill(0)
    under = F.sqrt("sa") * F.sqrt("sb")
    value = 1 - F.when(under <= 1e-10, F.lit(1.0)).otherwise(F.col("dot") / under)
    value = F.when((F.col("na") < least) | (F.col("nb") < least), F.lit(0.0)).otherwise(value)
    return rows.select("word", "na", "nb", value.alias("divergence"), (value > threshold).alias("polysemous"))
