"""Removal of boilerplate lines that many distinct sites share, with DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lexgraph.session import write_table

LG_K = 12
WORD = r"[^\x20\x09-\x0D]"
#: Keys of 16 bytes that may be broadcast.
BROADCAST_ROWS = 200_000
KEY = ["k0", "k1"]


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def _line_rows(docs: DataFrame) -> DataFrame:
    """(id, rid, site, pos, k0, k1) of every line that has a word; two hashes stand for the line."""
    rows = docs.select("id", "rid", "site", F.posexplode(_lines(F.col("text"))).alias("pos", "line")).where(F.col("line").rlike(WORD))
    return rows.select("id", "rid", "site", "pos", F.xxhash64("line").alias("k0"), F.xxhash64(F.lit(1), "line").alias("k1"))


def _with_keys(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """``rows`` whose line is among a written table of keys, broadcast only within BROADCAST_ROWS."""
    return rows.join(F.broadcast(keys) if keys.count() <= BROADCAST_ROWS else keys, KEY, "left_semi")


def boilerplate_keys(rows: DataFrame, min_sites: int) -> DataFrame:
    """Keys of lines that stand on at least ``min_sites`` distinct sites, as a written table.

    One HyperLogLog sketch of sites for each line, merged by aggregation. Lines
    whose estimate lies within a tenth of the threshold, and one site at least,
    are counted exactly; the estimate decides the others.
    """
    slack = max(1.0, 0.1 * min_sites)
    spread = rows.groupBy(KEY).agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", LG_K)).alias("sites")).where(F.col("sites") >= min_sites - slack)
    spread = write_table(spread, "lines-spread")
    near = write_table(spread.where(F.col("sites") <= min_sites + slack).select(KEY), "lines-near")
    sites = _with_keys(rows.where("site is not null"), near).groupBy(*KEY, "site").agg(F.lit(1).alias("one"))
    exact = sites.groupBy(KEY).agg(F.count("*").alias("sites")).where(F.col("sites") >= min_sites)
    return write_table(spread.where(F.col("sites") > min_sites + slack).select(KEY).unionByName(exact.select(KEY)), "lines-boilerplate")


def _flags(marked: Column, n: Column) -> Column:
    """An array of n booleans, true at the marked places (sorted); in time linear in n."""
    gap = lambda p, j: F.concat(F.array_repeat(F.lit(False), (p - F.coalesce(F.when(j > 0, F.get(marked, j - 1)), F.lit(-1)) - 1).cast("int")), F.array(F.lit(True)))
    rest = F.array_repeat(F.lit(False), (n - 1 - F.element_at(marked, -1)).cast("int"))
    return F.flatten(F.concat(F.transform(marked, gap), F.array(rest)))


def _judged(docs: DataFrame, site: str, min_sites: int) -> DataFrame:
    """(row, lines, n_removed, kept): each row of ``docs`` as a struct, its lines, how many are spread, and the others (null: as lines)."""
    own = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    own = own.select("row", F.coalesce(F.col("row.doc_id").cast("long"), F.lit(-1)).alias("id"), F.xxhash64("row.text").alias("rid"), F.col("row.text").cast("string").alias("text"), F.col("row").getField(site).cast("string").alias("site"))
    rows = _line_rows(own.select("id", "rid", "site", "text"))
    marked = _with_keys(rows, boilerplate_keys(rows, min_sites)).groupBy("id", "rid").agg(F.sort_array(F.collect_set("pos")).alias("marked"))
    split = own.join(marked, ["id", "rid"], "left").withColumn("lines", _lines(F.col("text")))
    split = split.withColumn("flags", F.when(F.col("marked").isNotNull(), _flags(F.col("marked"), F.size("lines"))))
    kept = F.when(F.col("flags").isNotNull(), F.filter("lines", lambda _, i: ~F.get("flags", i)))
    return split.select("row", "lines", F.coalesce(F.when(F.col("marked").isNotNull(), F.size("marked")), F.lit(0)).cast("long").alias("n_removed"), kept.alias("kept"))


def clean_documents(docs: DataFrame, site: str = "source", min_sites: int = 8) -> DataFrame:
    """``docs`` with spread lines taken out of text, and n_chars, where there is one, counted anew.

    All rows and columns stay, whatever their names. A document without a word of
    its own besides spread lines is a copy of a spread text: it keeps its text, for
    near-duplicate operators to judge. Else as dedup_lines().
    """
    found = _judged(docs, site, min_sites).withColumn("take", F.exists("kept", lambda x: x.rlike(WORD)))
    text = F.array_join("kept", "\n")
    out = []
    for f in docs.schema.fields:
        old = F.col("row").getField(f.name)
        new = {"text": text, "n_chars": F.char_length(text)}.get(f.name)
        out.append((old if new is None else F.when(F.col("take"), new.cast(f.dataType)).otherwise(old)).alias(f.name))
    return found.select(*out)


def dedup_lines(docs: DataFrame, site: str = "source", min_sites: int = 8) -> DataFrame:
    """Remove from every text the lines that stand on at least ``min_sites`` distinct sites.

    Returns doc_id, n_lines, n_removed and kept_text, one row per input row. Lines
    are split at \\n and compared by 128 bits of hashes; lines without a word are
    never removed. A null text has no lines and an empty kept_text; an empty one has
    one line. A null site adds to no spread. Rows without a doc_id are treated alike;
    repeated rows give repeated results.
    """
    found = _judged(docs.select("doc_id", "text", site), site, min_sites)
    text = F.col("row.text").cast("string")
    return found.select(
        F.col("row.doc_id").cast("long").alias("doc_id"), F.when(text.isNull(), 0).otherwise(F.size("lines")).cast("long").alias("n_lines"), "n_removed",
        F.coalesce(F.array_join("kept", "\n"), text, F.lit("")).alias("kept_text"))
