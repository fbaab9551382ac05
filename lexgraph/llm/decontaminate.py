"""Benchmark decontamination by SimHash of item-sized windows, with DataFrame operations only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from lexgraph.session import write_table

WIDTH = 5
BLOCKS, BLOCK_BITS = 8, 16
BROADCAST_ROWS = 200_000


def block_radius(similarity: float) -> int:
    """The bits in which one block at least must be searched, so that windows at ``similarity`` are found but for about one in 400.

    Their shingles have a cosine of 2 s / (1 + s); a bit of two fingerprints differs
    with the angle's share of a half turn. All within BLOCKS * (radius + 1) - 1 bits
    are found.
    """
    p = math.acos(min(1.0, 2 * similarity / (1 + similarity))) / math.pi
    bits = BLOCKS * BLOCK_BITS
    return max(0, math.ceil((bits * p + 2.8 * math.sqrt(bits * p * (1 - p)) + 1) / BLOCKS) - 1)


def _words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")


def _with_words(df: DataFrame) -> DataFrame:
    """Adds w; the generator keeps the words from being computed again for every use."""
    return df.select("*", F.explode(F.array(_words(F.coalesce("text", F.lit(""))))).alias("w"))


def with_shingles(df: DataFrame) -> DataFrame:
    """Adds n_words and keys: hashes of the five-word windows in order (empty with fewer words)."""
    at = lambda i: F.xxhash64(*(F.get("w", i + k) for k in range(WIDTH)))
    keys = F.when(F.size("w") >= WIDTH, F.transform(F.sequence(F.lit(0), F.size("w") - WIDTH), at)).otherwise(F.array().cast("array<bigint>"))
    return _with_words(df).withColumn("keys", keys).withColumn("n_words", F.size("w")).drop("w")


def shingle_rows(df: DataFrame) -> DataFrame:
    """(doc_id, rid, n_words, pos, key): the same windows as rows, within compiled code."""
    count = F.greatest(F.size("w") - (WIDTH - 1), F.lit(0))
    sides = F.arrays_zip(*(F.slice("w", k + 1, count).alias(f"w{k}") for k in range(WIDTH)))
    rows = _with_words(df).select("doc_id", "rid", F.size("w").alias("n_words"), F.posexplode(sides).alias("pos", "s"))
    return rows.select("doc_id", "rid", "n_words", "pos", F.xxhash64(*(F.col("s").getField(f"w{k}") for k in range(WIDTH))).alias("key"))


def simhash(rows: DataFrame, by: list[str]) -> DataFrame:
    """128-bit fingerprints (f0, f1) of groups of keys: each bit is the majority among the weighted keys."""
    sums = []
    for part, key in enumerate((F.col("key"), F.xxhash64("key"))):
        sums += [F.sum(F.shiftright(key, b).bitwiseAND(F.lit(1)) * 2 - 1).alias(f"s{part}_{b}") for b in range(64)]
    out = rows.groupBy(*by).agg(*sums)
    prints = []
    for part in range(2):
        bits = F.array(*(F.when(F.col(f"s{part}_{b}") > 0, F.lit(-(1 << 63) if b == 63 else 1 << b)).otherwise(F.lit(0)).cast("long") for b in range(64)))
        prints.append(F.aggregate(bits, F.lit(0).cast("long"), lambda x, y: x.bitwiseOR(y)).alias(f"f{part}"))
    return out.select(*by, *prints)


def _each(counted: DataFrame, by: str, n: str) -> DataFrame:
    """(by, key): the n-th occurrence of a key has a key of its own, so that weights spread over bits as the similarity has them."""
    rows = counted.select(by, "key", F.explode(F.sequence(F.lit(1).cast("long"), F.col(n))).alias("k"))
    return rows.select(by, F.when(F.col("k") == 1, F.col("key")).otherwise(F.xxhash64("key", "k")).alias("key"))


def _block_keys() -> Column:
    """Array of (block, value) of a fingerprint."""
    per = 64 // BLOCK_BITS
    return F.array(*(F.struct(F.lit(b).alias("block"), F.shiftrightunsigned(F.col(f"f{b // per}"), BLOCK_BITS * (b % per)).bitwiseAND(F.lit((1 << BLOCK_BITS) - 1)).alias("value")) for b in range(BLOCKS)))


def similar_prints(windows: DataFrame, items: DataFrame, radius: int) -> DataFrame:
    """(wkey, item_id) of all fingerprints that differ in at most BLOCKS * (radius + 1) - 1 bits.

    Each fingerprint has BLOCKS blocks; within that distance, one block at least
    differs in at most ``radius`` bits. Items are listed under all block values that
    near; windows look up their own. Both sides are dealt by block and value: the list
    is hundreds of times its items, from whose size Spark would take it to be small
    enough to pass through the driver.
    """
    masks = F.array(*(F.lit(m) for m in range(1 << BLOCK_BITS) if m.bit_count() <= radius))
    listed = items.select("item_id", F.col("f0").alias("g0"), F.col("f1").alias("g1"), F.explode(_block_keys()).alias("b"))
    listed = listed.select("item_id", "g0", "g1", "b.block", "b.value", F.explode(masks).alias("mask")).select("item_id", "g0", "g1", "block", F.col("value").bitwiseXOR(F.col("mask")).alias("value"))
    asked = windows.select("wkey", "f0", "f1", F.explode(_block_keys()).alias("b")).select("wkey", "f0", "f1", "b.block", "b.value")
    near = F.bit_count(F.col("f0").bitwiseXOR(F.col("g0"))) + F.bit_count(F.col("f1").bitwiseXOR(F.col("g1"))) < BLOCKS * (radius + 1)
    return asked.join(listed.hint("merge"), ["block", "value"]).where(near).select("wkey", "item_id").distinct()


def decontaminate(docs: DataFrame, benchmark: DataFrame, similarity: float = 0.8) -> DataFrame:
    """Documents with a window like a benchmark item: doc_id, item_id, similarity, start_word.

    A window has as many words as the item (the whole text where that is shorter);
    it matches if the weighted Jaccard similarity of the two multisets of five-word
    shingles is at least ``similarity``. One row for each document and item, with
    the best window's similarity and the first such start. Null and empty texts,
    rows without an id and items of fewer than five words match nothing.

    A window can only reach the similarity if enough of its shingles stand in some
    item, and then also where it is moved to start at the first of them, or at the
    text's end. So only such windows are fingerprinted; equal ones once. Candidate
    pairs come from the fingerprints alone, then are verified exactly. Shingles,
    windows and texts are told apart by 64-bit hashes, windows by two of them.
    Repeated rows give one result.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null and text is not null").withColumn("rid", F.xxhash64("text"))
    items = with_shingles(benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null and text is not null")).where(F.size("keys") > 0)
    items = write_table(items.groupBy("item_id", "n_words", "keys").agg(F.lit(1).alias("one")).drop("one"), "items")
    item_keys = items.select(F.col("n_words").alias("n"), F.explode("keys").alias("key")).distinct()
    if item_keys.count() <= BROADCAST_ROWS:
        item_keys = F.broadcast(item_keys)
    hits = shingle_rows(texts).join(item_keys, "key")
    found = hits.groupBy("doc_id", "rid", "n_words", "n").agg(F.sort_array(F.collect_set("pos")).alias("p"))
    size = F.least("n", "n_words") - (WIDTH - 1)
    need = F.ceil(similarity / (1 + similarity) * (size + F.col("n") - (WIDTH - 1)) - 1e-9).cast("int")
    last = F.greatest(F.col("n_words") - F.col("n"), F.lit(0))
    starts = F.filter("p", lambda x, i: (x <= F.col("last")) & (F.get("p", i + F.col("need") - 1) <= x + F.col("size") - 1))
    at_end = F.when(F.size(F.filter("p", lambda x: x >= F.col("last"))) >= F.col("need"), F.array("last")).otherwise(F.array().cast("array<int>"))
    placed = found.withColumn("size", size).withColumn("need", need).withColumn("last", last).where(F.size("p") >= F.col("need"))
    placed = write_table(placed.select("doc_id", "rid", "size", "n", F.explode(F.array_union(starts, at_end)).alias("start")), "windows")
    whole = with_shingles(texts.join(placed.select("doc_id", "rid").distinct(), ["doc_id", "rid"], "left_semi").distinct())
    cut = F.slice("keys", F.col("start") + 1, F.col("size"))
    windows = placed.join(whole.select("doc_id", "rid", "keys"), ["doc_id", "rid"]).select("doc_id", "start", cut.alias("cut"))
    windows = write_table(windows.withColumn("wkey", F.concat_ws("-", F.xxhash64("cut"), F.xxhash64(F.reverse("cut")))), "windows")
    distinct = windows.groupBy("wkey").agg(F.any_value("cut").alias("cut"))
    weights = write_table(distinct.select("wkey", F.explode("cut").alias("key")), "window-shingles")
    item_rows = items.select("item_id", F.explode("keys").alias("key"))
    w = write_table(weights.groupBy("wkey", "key").agg(F.count("*").alias("a")), "window-weights")
    i = item_rows.groupBy("item_id", "key").agg(F.count("*").alias("b"))
    near = similar_prints(write_table(simhash(_each(w, "wkey", "a"), ["wkey"]), "window-prints"), write_table(simhash(_each(i, "item_id", "b"), ["item_id"]), "item-prints"), block_radius(similarity))
    both = near.join(w, "wkey").join(i, ["item_id", "key"]).groupBy("wkey", "item_id").agg(F.sum(F.least("a", "b")).alias("same"))
    sizes = both.join(w.groupBy("wkey").agg(F.sum("a").alias("na")), "wkey").join(i.groupBy("item_id").agg(F.sum("b").alias("nb")), "item_id")
    score = F.col("same") / (F.col("na") + F.col("nb") - F.col("same"))
    good = sizes.select("wkey", "item_id", score.alias("similarity")).where(F.col("similarity") >= similarity)
    out = windows.join(good, "wkey").groupBy("doc_id", "item_id").agg(F.min(F.struct((-F.col("similarity")).alias("s"), F.col("start"))).alias("best"))
    return out.select("doc_id", "item_id", (-F.col("best.s")).alias("similarity"), F.col("best.start").cast("long").alias("start_word"))
