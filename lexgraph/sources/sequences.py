"""Token sequences from text, baskets and event streams; vocabularies and corpus files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from lexgraph.session import write_table

#: The reference's capacities: words of a sentence, characters of a word, words of a vocabulary.
MAX_WORDS, MAX_CHARS, MAX_VOCABULARY = 64, 63, 8092


def words_of(sentence: Column, max_words: int | None = None, max_chars: int | None = None) -> Column:
    """Lower-case runs of letters and apostrophes; the first ``max_words`` of them and ``max_chars`` of each (None: all)."""
    # Other characters go first: lower-casing some of them would make letters.
    words = F.array_remove(F.split(F.lower(F.regexp_replace(sentence, "[^A-Za-z']+", " ")), " "), "")
    if max_chars is not None:
        words = F.transform(words, lambda w: F.substring(w, 1, max_chars))
    return words if max_words is None else F.slice(words, 1, max_words)


def sentences(docs: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = 2, max_words: int | None = None, max_chars: int | None = None, by_place: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """(sent_id, words): sentences end at . ! ? or a line end; shorter ones than ``min_words`` are dropped.

    sent_id is key * 2**32 + the sentence's number in the text, for keys below 2**31
    (others are an error), or ``by_place`` a struct of both (key, no), for any key.
    ``max_words`` and ``max_chars`` are those of words_of(); ``keep`` names further
    columns to carry.
    """
    cut = docs.select(*keep, F.col(key).cast("long").alias("key"), F.posexplode(F.split(F.col(text), "[.!?\n]")).alias("no", "s"))
    fits = F.coalesce(F.col("key").between(-(1 << 31), (1 << 31) - 1), F.lit(True))
    own = F.struct("key", "no") if by_place else F.when(fits, F.shiftleft("key", 32) + F.col("no")).otherwise(F.raise_error(F.lit("keys of 2**31 and more need by_place")))
    return cut.select(*keep, own.alias("sent_id"), words_of(F.col("s"), max_words, max_chars).alias("words")).where(F.size("words") >= min_words)


def baskets(lineitem: DataFrame) -> DataFrame:
    """(sent_id, words): the parts of each order, in order of line."""
    order = F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice")))
    return lineitem.groupBy(F.col("l_orderkey").alias("sent_id")).agg(order.alias("o")).select("sent_id", F.col("o.l_partkey").alias("words"))


def timelines(events: DataFrame) -> DataFrame:
    """(sent_id, words): each user's event types in order of time."""
    order = F.sort_array(F.collect_list(F.struct("ts", "event_id", "event_type")))
    return events.groupBy(F.col("user_id").alias("sent_id")).agg(order.alias("o")).select("sent_id", F.col("o.event_type").alias("words"))


def body_lines(lines: DataFrame, doc: str = "doc", no: str = "no", line: str = "line") -> DataFrame:
    """Lines of books between their start and end marks.

    Reading begins after a line with ``*** START OF`` and ends for good at the first
    line with ``*** END OF`` after it; without a start mark there is nothing. A later
    start mark is a line like any other. Lines without a letter go, and lines of
    over five characters, the line end counted, without a lower-case letter.
    Marks are found by aggregation and joined to the lines, so a book of any length
    needs no single task.
    """
    has = lambda mark: F.contains(F.col(line), F.lit(mark))
    start = lines.where(has("*** START OF")).groupBy(doc).agg(F.min(no).alias("a__"))
    ends = lines.where(has("*** END OF")).select(doc, F.col(no).alias("e__"))
    marks = start.join(ends, doc, "left").groupBy(doc).agg(F.first("a__").alias("a__"), F.min(F.when(F.col("e__") > F.col("a__"), F.col("e__"))).alias("b__"))
    kept = lines.join(marks, doc).where((F.col(no) > F.col("a__")) & (F.col("b__").isNull() | (F.col(no) < F.col("b__"))))
    return kept.where(F.col(line).rlike("[A-Za-z]") & ~((F.length(line) + 1 > 5) & ~F.col(line).rlike("[a-z]"))).drop("a__", "b__")


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """(doc, no, line) of text files, one row a line, numbered from 0; files are split among tasks.

    Lines are numbered within each block of a file that one task reads, and the
    counts of the blocks before it, a row for each, are added.
    """
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("doc"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("id"), F.col("value").alias("line"))
    sizes = rows.groupBy("doc", "at").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    before = sizes.select("doc", "at", "first", (F.sum("n").over(W.partitionBy("doc").orderBy("at")) - F.col("n")).alias("before"))
    return rows.join(before, ["doc", "at"]).select("doc", (F.col("before") + F.col("id") - F.col("first")).alias("no"), "line")


def vocabulary(sents: DataFrame, cap: int | None = None) -> DataFrame:
    """(word_id, word, count): ids from 0 in order of first appearance, ``cap`` words at most (None: all).

    Without a cap, words are range-partitioned; each partition numbers its own and
    adds the counts of the partitions before it, as in components.class_ids().
    """
    words = sents.select("sent_id", F.posexplode("words").alias("pos", "word")).groupBy("word").agg(F.min(F.struct("sent_id", "pos")).alias("first"), F.count("*").alias("count"))
    if cap is None:
        dealt = write_table(words.repartitionByRange("first").withColumn("part", F.spark_partition_id()), "words")
        sizes = dealt.groupBy("part").agg(F.count("*").alias("n"))
        before = sizes.select("part", (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("before"))
        local = dealt.withColumn("k", F.row_number().over(W.partitionBy("part").orderBy("first")) - 1)
        return local.join(F.broadcast(before), "part").select((F.col("before") + F.col("k")).cast("long").alias("word_id"), "word", "count")
    kept = words.orderBy("first").limit(cap)
    return kept.withColumn("word_id", (F.row_number().over(W.orderBy("first")) - 1).cast("long")).select("word_id", "word", "count")


def encode(sents: DataFrame, vocab: DataFrame) -> DataFrame:
    """Sentences as word ids; words outside the vocabulary are dropped."""
    rows = sents.select("sent_id", F.posexplode("words").alias("pos", "word")).join(vocab.select("word", "word_id"), "word")
    return rows.groupBy("sent_id").agg(F.sort_array(F.collect_list(F.struct("pos", "word_id"))).alias("o")).select("sent_id", F.col("o.word_id").alias("words"))


def corpus_profile(sents: DataFrame, vocab: DataFrame | None = None) -> DataFrame:
    """One row: sentences in all, those with two words or more in the vocabulary, and their lengths.

    Without a vocabulary it is that of all the sentences' words, which leaves none out, so none is looked up.
    """
    n = F.col("n")
    usable = [F.count_if(n >= 2).alias("usable"), F.avg(F.when(n >= 2, n)).alias("avg_len"), F.min(F.when(n >= 2, n)).alias("min_len"), F.max(F.when(n >= 2, n)).alias("max_len")]
    if vocab is None:
        own = sents.groupBy("sent_id").agg(F.sum(F.size("words")).alias("n"), F.count("*").alias("k"))
        return own.agg(F.coalesce(F.sum("k"), F.lit(0)).alias("total"), *usable)
    words = sents.select("sent_id", F.explode("words").alias("word")).join(vocab.select("word"), "word", "left_semi")
    return sents.agg(F.count("*").alias("total")).crossJoin(words.groupBy("sent_id").agg(F.count("*").alias("n")).agg(*usable))


def write_corpus(sents: DataFrame, path: str) -> None:
    """Sentences as Parquet: the corpus file of this engine."""
    sents.select("sent_id", "words").write.mode("overwrite").parquet(path)


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_vocabulary(vocab: DataFrame, path: str) -> None:
    """``id<TAB>word`` lines."""
    vocab.select("word_id", "word").write.mode("overwrite").csv(path, sep="\t")


def read_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", schema="word_id long, word string")
