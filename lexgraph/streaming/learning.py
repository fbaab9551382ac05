"""The learning loop as Structured Streaming: counts, values, classes and convergence by micro-batch."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener
from pyspark.sql.utils import StreamingQueryException

from lexgraph.operators import components, mi, pairs
from lexgraph.session import delete_path, drop_tables, own_folder, write_table

#: The reference's gates of the phased rule: sentences, clusterings, classes, and their greatest share of the words in percent.
GATES = {"sentences": 500, "cc_runs": 5, "classes": 10, "percent": 95}
#: Entropies that a plateau is judged by, and the idle rounds after which the data count as exhausted.
WINDOW, IDLE_ROUNDS = 5, 50
#: Folders of changes that are merged into one once they hold as many rows as the oldest.
FOLDERS = 6
PROGRESS = ("n long, batch long, sentences long, rounds long, cc_runs long, dirty long, pairs long, words long, classes long, entropy double, converged string, "
            "stored array<string>, sizes array<long>, since array<string>, unclustered array<string>, graph string")
_STATE_STORE = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def _rocksdb(spark: SparkSession) -> Iterator[None]:
    """Queries started within keep their state in RocksDB, beyond the executors' heap."""
    before = spark.conf.get(_STATE_STORE)
    spark.conf.set(_STATE_STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(_STATE_STORE, before)


def sentence_stream(spark: SparkSession, path: str, schema, files_per_trigger: int = 1) -> DataFrame:
    """Sentences as they arrive as Parquet files under ``path``."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).option("recursiveFileLookup", "true").parquet(path)


def drop_files(sents: DataFrame, batches: int) -> str:
    """Write sentences as ``batches`` files, by sent_id mod ``batches``, for a stream to pick up in that order; returns the folder."""
    path = own_folder(sents.sparkSession, "feed")
    held = write_table(sents.select("sent_id", "words").withColumn("k", F.pmod("sent_id", F.lit(batches))), "feed")
    for k in range(batches):
        held.where(F.col("k") == k).drop("k").coalesce(1).write.parquet(f"{path}/{k:05d}")
    drop_tables(held)
    return path


def running_pair_counts(sents: DataFrame, window: int = 2, self_pairs: bool = True) -> DataFrame:
    """Pair counts of a stream of sentences as keyed state; in update mode a batch emits the pairs it changed, with their counts."""
    return pairs.pair_events(sents, window, self_pairs).groupBy("wa", "wb").agg(F.count("*").alias("count"))


def stream_pair_counts(sents: DataFrame, batches: int = 3, window: int = 2, self_pairs: bool = True, folder: str | None = None) -> DataFrame:
    """Pair counts kept by a stream over all sentences: equal to the batch counts.

    Counts are state by pair; a micro-batch writes the pairs it changed under its
    number (in ``folder``), so what it writes follows the batch and not the state. A
    batch that runs again starts from the same state and replaces its own file.
    """
    spark = sents.sparkSession
    feed = drop_files(sents.where(F.size("words") >= 2), batches)
    out = folder or own_folder(spark, "counts")
    stream = running_pair_counts(sentence_stream(spark, feed, sents.select("sent_id", "words").schema), window, self_pairs)

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    with _rocksdb(spark):
        started = stream.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", own_folder(spark, "counts-state")).trigger(availableNow=True).start()
    started.awaitTermination()
    # A pair's count only grows.
    return spark.read.parquet(out).groupBy("wa", "wb").agg(F.max("count").alias("count"))


def plateau(entropies: list[float], window: int = WINDOW, spread: float = 0.01) -> bool:
    """Whether the last ``window`` entropies differ by less than ``spread`` of their greatest, which must be positive."""
    last = entropies[-window:]
    return len(last) == window and max(last) > 0 and (max(last) - min(last)) / max(last) < spread


def loop_events(sents: DataFrame, window: int = 2) -> DataFrame:
    """(kind, a, b): for each sentence an 's'; for each two words within the window a 'p' of both, a 'w' of each, and an 'n'.

    Counted by key they are the pairs, the words' marginals, and the totals.
    """
    word = dict(sents.dtypes)["words"].removeprefix("array<").removesuffix(">")
    none = F.lit(None).cast(word)
    n = F.size("words")
    sides = [F.arrays_zip(F.slice("words", 1, F.greatest(n - d, F.lit(0))).alias("a"), F.slice("words", d + 1, F.greatest(n - d, F.lit(0))).alias("b")) for d in range(1, window + 1)]
    rows = sents.where(n >= 2).select(F.explode(F.concat(F.array(F.struct(none.alias("a"), none.alias("b"))), *sides)).alias("p"))
    one = lambda kind, a, b: F.struct(F.lit(kind).alias("kind"), a.alias("a"), b.alias("b"))
    a, b = F.col("p.a"), F.col("p.b")
    both = F.array(one("p", F.least(a, b), F.greatest(a, b)), one("w", a, none), one("w", b, none), one("n", none, none))
    return rows.select(F.explode(F.when(a.isNull(), F.array(one("s", none, none))).otherwise(both)).alias("e")).select("e.kind", "e.a", "e.b")


class NotNow(Exception):
    """The loop takes no batch: it is paused or has converged. The stream keeps the batch for later."""


class _Idle(StreamingQueryListener):
    """Tells the loop of rounds without data."""

    def __init__(self, loop: LearningLoop):
        self.loop = loop

    def onQueryStarted(self, event) -> None: ...

    def onQueryProgress(self, event) -> None:
        if self.loop.mine(event.progress.id) and event.progress.numInputRows > 0:
            self.loop.idle_rounds = 0

    def onQueryIdle(self, event) -> None:
        if self.loop.mine(event.id):
            self.loop.idle()

    def onQueryTerminated(self, event) -> None: ...


class LearningLoop:
    """Count, score, cluster and test for convergence after each micro-batch.

    Pairs that a batch touches stay dirty until at least ``dirty_least`` are; then
    their values are recomputed and, with more than ten pairs, the classes. The end
    of the data (finish(), or idle rounds of an open stream) recomputes what is left.
    ``gated`` asks for enough sentences, clusterings and classes besides a plateau.
    ``whole`` takes all data first, however level the entropies are: each batch has a
    clustering, and a plateau counts from that of the last one.

    State lives under ``path`` in the shared folder as folders of changes: a batch
    adds the pairs and words it touched with their new counts, scoring the pairs it
    scored; what is written follows the batch. Scoring reads the changes since the
    last scoring alone, for they hold every dirty pair, both its words' marginals and
    the total. Classes are kept up to date by the edges that came and went. Folders
    are merged when they have grown as large as the oldest. A row of progress names
    the folders that hold, and its writing commits them; nothing is deleted before. A
    batch that runs again after its commit changes nothing, one that broke off before
    it starts from the state before, and a new loop on the same ``path`` goes on where
    the last one was. While paused or after convergence no batch is taken, and none is
    lost. A loop is fed by its stream or by step(), not by both.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, window: int = 2, dirty_least: int = 100, max_iterations: int = 500, gated: bool = False, min_mi: float = 2.0, min_count: float = 3.0, whole: bool = False):
        self.spark, self.window, self.dirty_least, self.max_iterations, self.gated, self.whole = spark, window, dirty_least, max_iterations, gated, whole
        self.min_mi, self.min_count = min_mi, min_count
        self.path = path or own_folder(spark, "loop")
        self.query: StreamingQuery | None = None
        self.source: tuple | None = None
        self.paused = False
        self.idle_rounds = 0
        self.idle_error: Exception | None = None
        self._made: list[str] = []
        self._busy = threading.RLock()
        self._listener: _Idle | None = None
        self.rows: list[dict] = []
        try:
            found = spark.read.schema(PROGRESS).option("recursiveFileLookup", "true").parquet(f"{self.path}/progress").orderBy("n").collect()
            self.rows = list({r["n"]: r.asDict() for r in found}.values())
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise

    # What the committed rows say.
    def _last(self, key: str, other=0):
        return self.rows[-1][key] if self.rows else other

    @property
    def sentences(self) -> int:
        return self._last("sentences")

    @property
    def rounds(self) -> int:
        """Rounds that had data: the compartments' iteration counter."""
        return self._last("rounds")

    @property
    def cc_runs(self) -> int:
        """Clusterings: the loop's iteration counter."""
        return self._last("cc_runs")

    @property
    def converged(self) -> str | None:
        """Why the loop has ended: 'plateau', 'iterations' or 'exhausted'; None while it has not."""
        return self._last("converged", None)

    @property
    def state(self) -> DataFrame | None:
        """(wa, wb, count, mi, dirty) after the last committed batch."""
        if not self.rows:
            return None
        return self._newest(self.rows[-1]["stored"]).where("kind = 'p'").select(F.col("a").alias("wa"), F.col("b").alias("wb"), "count", F.coalesce("mi", F.lit(0.0)).alias("mi"), "dirty")

    @property
    def classes(self) -> DataFrame | None:
        """(word_id, root, class_id) of the last clustering."""
        if not self._last("graph", None):
            return None
        labels = self._graph("labels").select(F.col("node").alias("word_id"), "root")
        return labels.join(components.class_ids(labels), "root").select("word_id", "root", "class_id")

    # Folders of changes: (kind, a, b, count, mi, dirty, new).
    def _folder(self, name: str) -> str:
        return f"{self.path}/changes/{name}"

    def _graph(self, part: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/graph/{self.rows[-1]['graph']}/{part}")

    def _put(self, changes: DataFrame) -> tuple[str, DataFrame]:
        name = uuid.uuid4().hex
        self._made.append(name)
        changes.write.parquet(self._folder(name))
        return name, self.spark.read.parquet(self._folder(name))

    def _newest(self, names: list[str]) -> DataFrame:
        """The last row of each key in the folders, the later ones winning; a value that a later change lacks stays."""
        rows = None
        for seq, name in enumerate(names):
            part = self.spark.read.parquet(self._folder(name)).withColumn("seq", F.lit(seq))
            rows = part if rows is None else rows.unionByName(part)
        value = F.max_by("mi", F.when(F.col("mi").isNotNull(), F.col("seq")))
        return rows.groupBy("kind", "a", "b").agg(F.max("count").alias("count"), value.alias("mi"), F.max_by("dirty", "seq").alias("dirty"), F.max_by("new", "seq").alias("new"))

    # One batch
    def step(self, batch: DataFrame, number: int | None = None) -> None:
        """Take in one batch of sentences under its number (None: the next)."""
        number = self._last("batch", -1) + 1 if number is None else number
        if self._taken(number):
            return
        fresh = loop_events(batch, self.window).groupBy("kind", "a", "b").agg(F.count("*").alias("count"))
        if self.rows:
            fresh = write_table(fresh, "fresh")
            keys = [F.col(f"x.{c}").eqNullSafe(F.col(f"y.{c}")) for c in ("kind", "a", "b")]
            old = self._newest(self.rows[-1]["stored"]).select("kind", "a", "b", F.col("count").alias("before"))
            fresh = fresh.alias("x").join(old.alias("y"), keys, "left").select("x.kind", "x.a", "x.b", (F.col("count") + F.coalesce("before", F.lit(0))).alias("count"), F.col("before").isNull().alias("new"))
        else:
            fresh = fresh.withColumn("new", F.lit(True))
        with self._busy:
            self._take(fresh, number)

    def _taken(self, number: int) -> bool:
        if number <= self._last("batch", -1):
            return True
        if self.paused or self.converged:
            raise NotNow("paused" if self.paused else self.converged)
        return False

    def _from_stream(self, batch: DataFrame, number: int) -> None:
        with self._busy:
            if self._taken(number):
                # The stream's state must move on all the same.
                batch.write.format("noop").mode("overwrite").save()
            else:
                self._take(batch.select("kind", "a", "b", "count", (F.col("born") == F.col("seen")).alias("new")), number)

    def _take(self, changes: DataFrame, number: int) -> None:
        pair = F.col("kind") == "p"
        name, held = self._put(changes.select("kind", "a", "b", "count", F.lit(None).cast("double").alias("mi"), pair.alias("dirty"), "new"))
        found = held.agg(F.count("*").alias("rows"), F.count_if(pair & F.col("new")).alias("pairs"), F.max(F.when(F.col("kind") == "s", F.col("count"))).alias("sentences")).first()
        row = self._next(batch=number, sentences=found["sentences"] or self.sentences, rounds=self.rounds + (found["rows"] > 0), pairs=self._last("pairs") + found["pairs"])
        row["stored"], row["sizes"] = [*row["stored"], name], [*row["sizes"], found["rows"]]
        row["since"], row["unclustered"] = [*row["since"], name], [*row["unclustered"], name]
        row["dirty"] = self._newest(row["since"]).where("kind = 'p'").count()
        if row["dirty"] >= self.dirty_least:
            self._score(row)
        elif self.whole and not row["dirty"] and self._entropies():
            row.update(self._repeated())
        self._merge(row)
        self._record(row)

    def _next(self, **changed) -> dict:
        """A row that goes on from the last."""
        first = dict(batch=-1, sentences=0, rounds=0, cc_runs=0, dirty=0, pairs=0, stored=[], sizes=[], since=[], unclustered=[], graph=None)
        keep = {**first, **{k: v for k, v in (self.rows[-1] if self.rows else {}).items() if k in first}}
        return {**keep, "words": None, "classes": None, "entropy": None, "converged": None, **changed, "n": len(self.rows)}

    def _score(self, row: dict) -> None:
        """Values of all dirty pairs, from the changes since the last scoring; then the classes."""
        if not row["dirty"]:
            return
        since = self._newest(row["since"])
        total = since.where("kind = 'n'").first()["count"]
        word = since.where("kind = 'w'").select(F.col("a").alias("word"), "count")
        side = lambda c, n: word.select(F.col("word").alias(c), F.col("count").alias(n))
        both = since.where("kind = 'p'").select("kind", "a", "b", "count").join(side("a", "left"), "a").join(side("b", "right"), "b")
        value = mi.mi_expr(F.col("count"), F.col("left"), F.col("right"), F.lit(total))
        name, held = self._put(both.select("kind", "a", "b", "count", value.alias("mi"), F.lit(False).alias("dirty"), F.lit(False).alias("new")))
        row.update(stored=[*row["stored"], name], sizes=[*row["sizes"], held.count()], since=[], unclustered=[*row["unclustered"], name], dirty=0)
        if row["pairs"] > 10:
            self._cluster(row)

    def _cluster(self, row: dict) -> None:
        """Classes after the pairs scored since the last clustering: edges that came meet the old classes, those that went break theirs."""
        changed = write_table(self._newest(row["unclustered"]), "changed")
        scored = changed.where("kind = 'p' and mi is not null and a <> b").select("a", "b", ((F.col("mi") > self.min_mi) & (F.col("count") > self.min_count)).alias("edge"))
        words = changed.where("kind = 'w'").select(F.col("a").alias("node"))
        at = f"{self.path}/graph/{(name := uuid.uuid4().hex)}"
        if row["graph"]:
            edges, labels = self._graph("edges"), self._graph("labels")
            added = scored.where("edge").select("a", "b").join(edges, ["a", "b"], "left_anti")
            removed = edges.join(scored.where("not edge"), ["a", "b"], "left_semi")
            fresh = words.join(labels, "node", "left_anti")
            now = edges.join(removed, ["a", "b"], "left_anti").unionByName(added)
            held = write_table(labels.unionByName(fresh.select("node", F.col("node").alias("root"))), "labels")
        else:
            added = now = scored.where("edge").select("a", "b")
            removed = added.limit(0)
            held = write_table(words.select("node", F.col("node").alias("root")), "labels")
        now.write.parquet(f"{at}/edges")
        components.update_components(held, added, removed, self.spark.read.parquet(f"{at}/edges")).write.parquet(f"{at}/labels")
        found = components.class_entropy(self.spark.read.parquet(f"{at}/labels").withColumnRenamed("root", "class_id")).first()
        row.update(cc_runs=row["cc_runs"] + 1, words=held.count(), classes=int(found["classes"]), entropy=float(found["entropy"]), unclustered=[], graph=name)
        drop_tables(changed, held)
        stable = not self.whole and plateau(self._entropies() + [row["entropy"]])
        if self.gated:
            stable = stable and row["sentences"] >= GATES["sentences"] and row["cc_runs"] >= GATES["cc_runs"] and GATES["classes"] <= row["classes"] < row["words"] * GATES["percent"] // 100
        row["converged"] = "plateau" if stable else "iterations" if row["cc_runs"] >= self.max_iterations else None

    def _merge(self, row: dict) -> None:
        """One folder for all once the younger ones hold as much as the oldest: each row is written again a few times in all."""
        if len(row["stored"]) >= FOLDERS and sum(row["sizes"][1:]) >= row["sizes"][0]:
            name, held = self._put(self._newest(row["stored"]))
            row.update(stored=[name], sizes=[held.count()])

    def _entropies(self) -> list[float]:
        return [r["entropy"] for r in self.rows if r["entropy"] is not None]

    def _record(self, row: dict) -> None:
        """Commit: the row is there or not. Then what only the row before named goes, and what was merged on the way."""
        self.spark.createDataFrame([row], PROGRESS).coalesce(1).write.parquet(f"{self.path}/progress/{row['n']:08d}-{uuid.uuid4().hex}")
        before = self.rows[-1] if self.rows else None
        self.rows.append(row)
        named = lambda r: {*r["stored"], *r["since"], *r["unclustered"]}
        for name in {*self._made, *(named(before) if before else ())} - named(row):
            delete_path(self.spark, self._folder(name))
        self._made.clear()
        if before and before["graph"] and before["graph"] != row["graph"]:
            delete_path(self.spark, f"{self.path}/graph/{before['graph']}")

    def _level(self) -> bool:
        """Whether the entropies have come to a plateau, of a whole loop those since all data were in."""
        return plateau([r["entropy"] for r in self.rows if r["entropy"] is not None and (not self.whole or r["batch"] == self._last("batch"))])

    def _repeated(self) -> dict:
        """What a clustering of what has not changed finds: the last one's results once more."""
        last = [r for r in self.rows if r["entropy"] is not None][-1]
        return {"cc_runs": self.cc_runs + 1, **{k: last[k] for k in ("words", "classes", "entropy")}}

    def _again(self) -> None:
        """A clustering of what has not changed: the last entropy once more."""
        self._record(self._next(**self._repeated()))

    def _flush(self) -> None:
        if self._last("dirty"):
            row = self._next()
            self._score(row)
            self._record(row)

    def finish(self) -> None:
        """The data are at an end: score what is dirty, then cluster on until the window of entropies is full.

        Nothing changes between those clusterings, so they repeat the last entropy.
        A plateau then ends the loop as 'exhausted'.
        """
        with self._busy:
            if not self.rows or self.converged:
                return
            self._flush()
            while not self.converged and self._entropies() and not self._level():
                self._again()
            self._exhaust()

    def _exhaust(self) -> None:
        if not self.converged and self._level():
            self._record({**self.rows[-1], "n": len(self.rows), "entropy": None, "converged": "exhausted"})

    def idle(self) -> None:
        """A round without data: score what is dirty, else cluster again until the window of entropies is level; after IDLE_ROUNDS of them that ends the loop."""
        with self._busy:
            if self.paused or self.converged or not self.rows:
                return
            self.idle_rounds += 1
            try:
                if self._last("dirty"):
                    self._flush()
                elif self._entropies() and not self._level():
                    self._again()
                if self.idle_rounds > IDLE_ROUNDS and self.sentences:
                    self._exhaust()
            except Exception as e:
                self.idle_error = e
            if self.converged or self.idle_error:
                threading.Thread(target=self.stop, daemon=True).start()

    # Running over a stream
    def mine(self, query_id) -> bool:
        return self.query is not None and str(self.query.id) == str(query_id)

    def start(self, feed: str | DataFrame, schema=None, files_per_trigger: int = 1, open_end: str | None = None) -> None:
        """Begin, or go on, with the files under ``feed`` or with a stream of sentences; returns at once.

        The stream ends with its data, or with ``open_end`` (a trigger's interval)
        stays open for more: rounds without data then count as idle, as often as
        Spark reports them (spark.sql.streaming.noDataProgressEventInterval).
        """
        self.source, self.paused = (feed, schema, files_per_trigger, open_end), False
        stream = feed if isinstance(feed, DataFrame) else sentence_stream(self.spark, feed, schema, files_per_trigger)
        # All of a batch has one time, so a key's first time is its last where the batch made it.
        now: Column = F.current_timestamp()
        counts = loop_events(stream, self.window).withColumn("at", now).groupBy("kind", "a", "b").agg(F.count("*").alias("count"), F.min("at").alias("born"), F.max("at").alias("seen"))
        writer = counts.writeStream.outputMode("update").foreachBatch(self._from_stream).option("checkpointLocation", f"{self.path}/offsets")
        writer = writer.trigger(processingTime=open_end) if open_end else writer.trigger(availableNow=True)
        if open_end and self._listener is None:
            self._listener = _Idle(self)
            self.spark.streams.addListener(self._listener)
        with _rocksdb(self.spark):
            self.query = writer.start()

    def wait(self, seconds: int | None = None) -> bool:
        """Wait until the stream has no more files, stops or converges; whether it did in time."""
        try:
            done = self.query.awaitTermination(seconds) is not False
        except StreamingQueryException:
            if not (self.paused or self.converged):
                raise
            done = True
        if self.idle_error:
            raise self.idle_error
        return done

    def poll(self) -> dict:
        """Counters, and whether a stream is running."""
        return {"running": self.query is not None and self.query.isActive, "paused": self.paused, "sentences": self.sentences, "rounds": self.rounds, "cc_runs": self.cc_runs, "idle_rounds": self.idle_rounds, "converged": self.converged}

    def pause(self) -> None:
        """Stop the stream; a batch under way is taken again by resume()."""
        self.paused = True
        self.stop()

    def resume(self) -> None:
        self.paused = False
        if self.source:
            self.start(*self.source)

    def stop(self) -> None:
        if self.query is not None:
            self.query.stop()
        if self._listener is not None:
            self.spark.streams.removeListener(self._listener)
            self._listener = None

    def run(self, sents: DataFrame, batches: int = 6) -> None:
        """Feed all sentences through a stream, ``batches`` files, until the end or convergence."""
        self.start(drop_files(sents, batches), sents.select("sent_id", "words").schema)
        self.wait()
        if not self.paused:
            self.finish()

    def progress(self) -> DataFrame:
        """(iteration, sentences, pairs, words, classes, entropy) of every clustering."""
        rows = [(r["cc_runs"], r["sentences"], r["pairs"], r["words"], r["classes"], r["entropy"]) for r in self.rows if r["entropy"] is not None]
        return self.spark.createDataFrame(rows, "iteration int, sentences long, pairs long, words long, classes long, entropy double")

    def sizes(self) -> DataFrame:
        """(part, size): rows of the state by kind, and of all folders of changes."""
        if not self.rows:
            return self.spark.createDataFrame([], "part string, size long")
        kinds = F.when(F.col("kind") == "p", "pairs").when(F.col("kind") == "w", "words").otherwise("totals")
        own = self._newest(self.rows[-1]["stored"]).groupBy(kinds.alias("part")).agg(F.count("*").alias("size"))
        return own.unionByName(self.spark.createDataFrame([("changes", sum(self.rows[-1]["sizes"]))], "part string, size long"))
