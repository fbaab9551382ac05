"""Spelling variants: words one edit apart, found by the one-edit neighbourhoods of words in a reduced alphabet."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from lexgraph.llm.common import with_text
from lexgraph.session import drop_tables, write_table

#: Letters of words: a-z, and U+00C0 to U+00FF.
LETTERS = "".join(map(chr, [*range(97, 123), *range(0xC0, 0x100)]))
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Sizes of the reduced alphabet to choose from; with the last one every letter has a symbol of its own.
ALPHABETS = (4, 8, 16, 32, len(LETTERS))


def occurrences(docs: DataFrame, least_length: int = 6, every: int = 199) -> DataFrame:
    """(doc_id, word): every run of letters of every whole text, in lower case, that has ``least_length`` code points or more.

    Where ``every`` divides h, the crc32 of ``<doc_id>:<run>``, the run has lost its
    code point h mod its length; rows without a doc_id lose none.
    """
    runs = with_text(docs).select("doc_id", F.explode(F.split("text", "[^A-Za-zÀ-ÿ]+")).alias("raw")).where(F.length("raw") >= least_length)
    # Of other letters none may change, so only pure ASCII runs go to lower().
    low = runs.select("doc_id", F.when(F.octet_length("raw") == F.length("raw"), F.lower("raw")).otherwise(F.translate("raw", _UPPER, _LOWER)).alias("run"))
    h = low.select("run", F.crc32(F.encode(F.concat(F.col("doc_id").cast("string"), F.lit(":"), F.col("run")), "UTF-8")).alias("h"), "doc_id")
    at = (F.col("h") % F.length("run")).cast("int")
    cut = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))
    return h.select("doc_id", F.when(F.col("h") % every == 0, cut).otherwise(F.col("run")).alias("word")).where(F.length("word") >= least_length)


def vocabulary(docs: DataFrame, least_length: int = 6, least_count: int = 5, every: int = 199) -> DataFrame:
    """(word, n): how often each word stands in all texts, for those that stand ``least_count`` times."""
    return occurrences(docs, least_length, every).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


def symbols(size: int) -> str:
    """The symbol of each of LETTERS in an alphabet of ``size`` symbols, by a multiplicative hash of its place."""
    return "".join(chr(33 + (k if size >= len(LETTERS) else (k * 40503 % 65536) * size >> 16)) for k in range(len(LETTERS)))


def reduced(word: Column, size: int) -> Column:
    return F.translate(word, LETTERS, symbols(size))


def half_neighbourhood(word: Column, size: int) -> Column:
    """A reduced word itself, its one-symbol deletions, and its substitutions by a lesser symbol.

    Being one edit apart goes both ways, so of two reduced words in each other's full
    neighbourhood exactly one has the other here.
    """
    places, listed = F.sequence(F.lit(1), F.length(word)), F.array(*(F.lit(chr(33 + k)) for k in range(size)))
    head, tail = (lambda i: F.substring(word, F.lit(1), i - 1)), (lambda i: F.substring(word, i + 1, F.length(word)))
    less = F.flatten(F.transform(places, lambda i: F.transform(F.filter(listed, lambda s: s < F.substring(word, i, F.lit(1))), lambda s: F.concat(head(i), s, tail(i)))))
    return F.array_distinct(F.concat(F.array(word), F.transform(places, lambda i: F.concat(head(i), tail(i))), less))


def choose_alphabet(words: DataFrame) -> int:
    """The size whose generated rows and expected candidates are fewest together.

    Words that share a reduced word are all candidates of each other, and of those
    of its neighbours. Should a third of all words fall on one reduced word, the
    squares of the sizes show it, and a larger alphabet parts them; with the largest
    one each reduced word is one word.
    """
    sizes = words.select(F.explode(F.array(*(F.struct(F.lit(a).alias("a"), reduced(F.col("word"), a).alias("r")) for a in ALPHABETS))).alias("x")).groupBy("x.a", "x.r").agg(F.count("*").alias("m"))
    found = sizes.groupBy("a").agg(F.count("*").alias("rows"), F.sum(F.col("m") * F.col("m")).alias("squares"), F.avg(F.length("r")).alias("long")).collect()
    cost = {x.a: x.long * (x.a + 1) * (x.rows / 2 + x.squares) for x in found}
    return min(cost, key=lambda a: (cost[a], a), default=ALPHABETS[0])


def near_pairs(words: DataFrame, size: int | None = None) -> DataFrame:
    """(a, b, na, nb): all unordered pairs of ``words`` (word, n) that differ by exactly one edit, once each.

    The reduced words' half neighbourhoods are joined with the reduced vocabulary,
    and each candidate is verified on the words as they are. ``words`` is read
    several times: write it first.
    """
    size = size or choose_alphabet(words)
    keyed = words.select("word", "n", reduced(F.col("word"), size).alias("r"))
    made = keyed.select("r").distinct().select("r", F.explode(half_neighbourhood(F.col("r"), size)).alias("near"))
    to = keyed.select(F.col("word").alias("b"), F.col("n").alias("nb"), F.col("r").alias("near"))
    candidates = made.join(to, "near").join(keyed.select(F.col("word").alias("a"), F.col("n").alias("na"), "r"), "r")
    # Words of one reduced word meet from both sides.
    once = (F.col("r") != F.col("near")) | (F.col("a") < F.col("b"))
    return candidates.where(once & (F.levenshtein("a", "b", 1) == 1)).select("a", "b", "na", "nb")


def roots(forms: DataFrame, most: int, ratio: int = 5) -> DataFrame:
    """(word, root): forms (word, form) followed to the last.

    A form stands at least ``ratio`` times as often as its word, so no chain is
    longer than log(most); each round doubles how far all pointers have gone.
    """
    now = write_table(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    for _ in range(math.ceil(math.log2(max(math.log(max(most, 1), ratio), 1))) + 1):
        onward = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        old, now = now, write_table(now.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "spelling-roots")
        drop_tables(old)
    return now


def spelling_variants(docs: DataFrame, least_length: int = 6, least_count: int = 5, ratio: int = 5, every: int = 199) -> DataFrame:
    """Words of all texts with their most frequent near word as form, where that stands ``ratio`` times as often.

    Returns word, n, n_near (words exactly one inserted, deleted or replaced code
    point away), form (the near word of largest n, the smallest in code-point order
    among equals; null if it is too rare or there is none), form_n and root (forms
    followed to the last; the word itself without one). Null and empty texts have no
    words, repeated rows count each, an empty table gives an empty result, and extra
    columns are not read. A word has a bounded number of near words, so no group
    grows with the input.
    """
    words = write_table(vocabulary(docs, least_length, least_count, every), "spelling-words")
    pairs = near_pairs(words)
    links = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("word"), F.struct((-F.col("nb")).alias("less"), F.col("b").alias("other")).alias("o")), F.struct(F.col("b").alias("word"), F.struct((-F.col("na")).alias("less"), F.col("a").alias("other")).alias("o")))).alias("x"))
    best = links.groupBy("x.word").agg(F.count("*").alias("n_near"), F.min("x.o").alias("o"))
    joined = words.join(best, "word", "left")
    use = -F.col("o.less") >= ratio * F.col("n")
    found = write_table(joined.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(use, F.col("o.other")).alias("form"), F.when(use, -F.col("o.less")).alias("form_n")), "spelling-forms")
    drop_tables(words)
    last = roots(found.where("form is not null"), found.agg(F.max("n")).first()[0] or 1, ratio)
    return found.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
