"""Stupid-backoff scores of documents under a word-pair model, by joins with n-gram count tables."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from lexgraph.llm.common import with_text
from lexgraph.session import write_table

SPACE = r"[\x20\x09-\x0D]+"
#: Words that may be looked up from a broadcast (16 bytes each): the most frequent ones, as many as are within this.
WORDS_BROADCAST = 200_000


def _words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), SPACE), "")


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text and rid, a hash of both."""
    return with_text(docs).withColumn("rid", F.xxhash64("doc_id", "text"))


def exploded(docs: DataFrame) -> DataFrame:
    """(rid, pos, n, word, pair, after): every word of every text, as 64-bit hashes.

    ``pair`` is the word with the one after it, ``after`` that one's own hash; both
    are null at a text's end. n is how many words the text has.
    """
    w = docs.select("rid", F.explode(F.array(_words(F.coalesce("text", F.lit(""))))).alias("w"))
    n = F.size("w")
    rows = w.select("rid", n.alias("n"), F.posexplode(F.arrays_zip(F.col("w").alias("a"), F.slice("w", 2, F.greatest(n - 1, F.lit(0))).alias("b"))).alias("pos", "s"))
    a, b = F.col("s.a"), F.col("s.b")
    return rows.select("rid", "pos", "n", F.xxhash64(a).alias("word"), F.when(b.isNotNull(), F.xxhash64(a, b)).alias("pair"), F.when(b.isNotNull(), F.xxhash64(b)).alias("after"))


def ngram_counts(docs: DataFrame) -> DataFrame:
    """(key, n): how often each word and each pair of neighbours stands in the texts, by hash."""
    rows = exploded(_keyed(docs)).select(F.explode(F.array("word", "pair")).alias("key")).where("key is not null")
    return rows.groupBy("key").agg(F.count("*").alias("n"))


def _turned(v: str) -> Column:
    """A word's hash turned by one bit: with the next word's hash it makes a pair's key, and gives that word back from the key."""
    return F.shiftleft(v, 1).bitwiseXOR(F.shiftrightunsigned(v, 63))


def _weight() -> Column:
    """How often log c(word) counts in its text if all pairs are in the model.

    The sum of log c(v w) - log c(v) over a text, and log c(first word), leave minus
    one for each word that is neither first nor last.
    """
    return F.when(F.col("n") == 1, 1).when((F.col("pos") > 0) & (F.col("pos") < F.col("n") - 1), -1).otherwise(0)


def _finished(texts: DataFrame, sums: DataFrame, total: int, alpha: float) -> DataFrame:
    """One row for each text from (rid, value, words, copies, backoff), added up by rid."""
    by_text = sums.groupBy("rid").agg(*(F.sum(c).alias(c) for c in ("value", "words", "copies", "backoff")))
    # Equal rows have one rid, so their sums hold each of them.
    each = lambda c: F.coalesce(F.col(c) / F.col("copies"), F.lit(0))
    n, backoff = F.coalesce(F.expr("words div copies"), F.lit(0)), F.coalesce(F.expr("backoff div copies"), F.lit(0))
    base = math.log(max(total, 1))
    score = F.when(n > 0, each("value") - base + backoff * (math.log(alpha) - base)).otherwise(F.lit(0.0))
    out = texts.select("doc_id", "rid").join(by_text, "rid", "left").select("doc_id", n.alias("n_words"), backoff.alias("n_backoff"), score.alias("log_score"))
    return out.withColumn("perplexity", F.when(F.col("n_words") > 0, F.exp(-F.col("log_score") / F.col("n_words"))))


def _frequent(words: DataFrame) -> int:
    """The least count from which no more than WORDS_BROADCAST words have it or more, to an eighth of an octave."""
    step = F.floor(F.log2("c") * 8)
    sizes = {r["k"]: r["n"] for r in words.groupBy(step.alias("k")).agg(F.count("*").alias("n")).collect()}
    held, cut = 0, None
    for k in sorted(sizes, reverse=True):
        held += sizes[k]
        if held > WORDS_BROADCAST:
            break
        cut = k
    # The count itself decides, so no rounding of the octave can let more in.
    return math.ceil(2 ** (cut / 8)) if cut is not None else max([*(2 ** (k / 8 + 1) for k in sizes), 1])


def score_documents(docs: DataFrame, alpha: float = 0.4, slices: int = 3, least: int = 1) -> DataFrame:
    """Stupid-backoff log-score of every whole text under the counts over all of these texts.

    The model has the pairs that stand ``least`` times or more. A word w after v
    scores c(v w) / c(v) if the model has the pair, else alpha c(w) / N, and is
    counted in n_backoff; a text's first word scores c(w) / N. Words are runs of
    non-space in lower case; n-grams stand as 64-bit hashes. Returns doc_id, n_words,
    n_backoff, log_score (sum of natural logs; 0 without words) and perplexity (null
    without words), one row per input row: null and empty texts have no words, and
    repeated rows count and score each.

    Every word is scored as if it backed off, and each pair of the model then adds
    what it has over that, a value of the pair alone. N-grams are exploded to rows
    and dealt by their hashes; there they are counted, pairs get their words' counts,
    and the values are joined back to the rows, which are dealt once for both, and
    summed by text. A task holds the values of its own partition. The hashes are
    taken in so many ``slices``, so that the disk holds the rows of one at a time.
    Frequent words, and pairs that would fill half a partition (two for each
    partition at most), are counted first, with aggregation before the exchange, and
    are looked up from a broadcast.
    """
    spark = docs.sparkSession
    texts = _keyed(docs)
    words = write_table(exploded(texts).groupBy("word").agg(F.count("*").alias("c")), "lm-words")
    total = words.agg(F.sum("c")).first()[0] or 0
    many = max(1000, total // (2 * int(spark.conf.get("spark.sql.shuffle.partitions"))), least)
    common = [r["word"] for r in words.where(F.col("c") > many).select("word").collect()]
    over = math.log(max(total, 1)) - math.log(alpha)
    side = lambda key, n: words.select(F.col("word").alias(key), F.col("c").alias(n))
    both = exploded(texts).where(F.col("word").isin(common) & F.col("after").isin(common)).groupBy("word", "after", "pair").agg(F.count("*").alias("n")).where(F.col("n") > many)
    value = F.ln("n") - F.ln("cv") - F.ln("cw") + over
    pairs = write_table(both.join(side("word", "cv"), "word").join(side("after", "cw"), "after").select("pair", value.alias("gain")), "lm-pairs")
    known = words.where(F.col("c") >= _frequent(words))
    looked_up = lambda rows: rows.join(F.broadcast(known), "word", "left").join(F.broadcast(pairs), "pair", "left")
    sums = looked_up(exploded(texts)).groupBy("rid").agg((F.coalesce(F.sum(F.ln("c")), F.lit(0.0)) + F.coalesce(F.sum("gain"), F.lit(0.0))).alias("value"), F.count("*").alias("words"), F.count_if(F.col("pos") == 0).alias("copies"), F.count("gain").alias("found"))
    # A word alone stands beside its own complement.
    alone = F.bitwise_not("word")
    terms = F.array(F.when(F.col("after").isNotNull() & F.col("gain").isNull(), F.struct(F.col("word").alias("v"), F.col("after").alias("w"))), F.when(F.col("c").isNull(), F.struct(F.col("word").alias("v"), alone.alias("w"))))
    for k in range(slices):
        # Both kinds of terms go by their word, so a slice looks up its own words only.
        own = exploded(texts).where(F.pmod("word", F.lit(slices)) == k)
        dealt = looked_up(own).select("rid", F.explode(terms).alias("t")).where("t is not null").select(_turned("t.v").bitwiseXOR(F.col("t.w")).alias("key"), "t.v", "rid").repartition("key")
        # Both sides of the join read rid and v, so that they are one exchange: the least rid is of no other use.
        counts = dealt.groupBy("key").agg(F.count("*").alias("n"), F.min("v").alias("v"), F.min("rid").alias("r")).where((F.col("n") > 1) | (F.col("n") >= least)).where("r is not null").select("key", "v", _turned("v").bitwiseXOR(F.col("key")).alias("w"), "n")
        valued = counts.join(side("v", "cv"), "v").join(side("w", "cw"), "w", "left").where(F.col("cw").isNull() | (F.col("n") >= least))
        gains = valued.select("key", F.when(F.col("cw").isNull(), F.ln("n")).otherwise(value).alias("gain"))
        # Gains are one for each key, so the rows pass by them unsorted.
        joined = dealt.join(gains.hint("shuffle_hash"), "key")
        made = write_table(joined.groupBy("rid").agg(F.sum("gain").alias("value"), F.count_if(F.col("key") != _turned("v").bitwiseXOR(F.bitwise_not("v"))).alias("found")), "lm-sums")
        sums = sums.unionByName(made.select("rid", "value", F.lit(0).cast("long").alias("words"), F.lit(0).cast("long").alias("copies"), "found"))
    by_text = sums.groupBy("rid").agg(*(F.sum(c).alias(c) for c in ("value", "words", "copies", "found")))
    n, found = F.coalesce(F.expr("words div copies"), F.lit(0)), F.coalesce(F.expr("found div copies"), F.lit(0))
    base = math.log(max(total, 1))
    # As if every word but the first backed off.
    score = F.when(n > 0, F.col("value") / F.col("copies") - n * base + (n - 1) * math.log(alpha)).otherwise(F.lit(0.0))
    out = texts.select("doc_id", "rid").join(by_text, "rid", "left").select("doc_id", n.alias("n_words"), F.greatest(n - 1 - found, F.lit(0)).alias("n_backoff"), score.alias("log_score"))
    return out.withColumn("perplexity", F.when(F.col("n_words") > 0, F.exp(-F.col("log_score") / F.col("n_words"))))


def score_with(docs: DataFrame, counts: DataFrame, total: int, alpha: float = 0.4) -> DataFrame:
    """score_documents() under another corpus: its ngram_counts() and how many words it has.

    A pair that the corpus lacks scores alpha c(w) / N instead, and is counted in
    n_backoff; a word that it lacks counts as one. ``counts`` is read several times:
    write it first.
    """
    texts = _keyed(docs)
    rows = exploded(texts)
    found = rows.join(counts.withColumnRenamed("key", "pair").withColumnRenamed("n", "c2"), "pair", "left").withColumn("lost", F.col("pair").isNotNull() & F.col("c2").isNull())
    # A lost pair (v w) takes back its - log c(v), and adds log c(w).
    terms = F.array(F.struct(F.col("word").alias("key"), _weight().alias("weight")), F.when(F.col("lost"), F.struct(F.col("word").alias("key"), F.lit(1).alias("weight"))), F.when(F.col("lost"), F.struct(F.col("after").alias("key"), F.lit(1).alias("weight"))))
    pairs = found.groupBy("rid").agg(F.coalesce(F.sum(F.ln("c2")), F.lit(0.0)).alias("value"), F.count("*").alias("words"), F.count_if(F.col("pos") == 0).alias("copies"), F.count_if("lost").alias("backoff"))
    single = found.select("rid", F.explode(terms).alias("t")).select("rid", "t.key", "t.weight").where("key is not null").groupBy("rid", "key").agg(F.sum("weight").alias("weight")).where("weight <> 0")
    none = F.lit(0).cast("long")
    singles = single.join(counts, "key").select("rid", (F.col("weight") * F.ln("n")).alias("value"), none.alias("words"), none.alias("copies"), none.alias("backoff"))
    return _finished(texts, pairs.unionByName(singles), total, alpha)
