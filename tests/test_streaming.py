import pytest
from pyspark.sql import functions as F

from lexgraph.operators import mi, pairs
from lexgraph.streaming import learning
from lexgraph.streaming.learning import LearningLoop, NotNow


def sents(spark, *lists, first=0):
    return spark.createDataFrame([(first + i, list(x)) for i, x in enumerate(lists)], "sent_id long, words array<long>")


def values(loop):
    return {(r["wa"], r["wb"]): (r["count"], r["mi"], r["dirty"]) for r in loop.state.collect()}


def test_pairs_stay_dirty_until_enough_are(spark):
    loop = LearningLoop(spark, dirty_least=3)
    loop.step(sents(spark, [1, 2]))
    assert values(loop) == {(1, 2): (1, 0.0, True)} and loop.cc_runs == 0
    loop.step(sents(spark, [5, 6, 7, 8], first=1))
    got = values(loop)
    assert got[1, 2][1] > 0 and not any(d for _, _, d in got.values())
    want = {(r["wa"], r["wb"]): r["mi"] for r in mi.mi_full(pairs.pair_counts(sents(spark, [1, 2], [5, 6, 7, 8]), 2, True)).collect()}
    assert {k: v[1] for k, v in got.items()} == pytest.approx(want)


def test_a_batch_counts_once_however_often_it_runs(spark):
    loop = LearningLoop(spark, dirty_least=1)
    batch = sents(spark, [1, 2])
    loop.step(batch, 0)
    loop.step(batch, 0)
    assert values(loop)[1, 2][0] == 1 and loop.sentences == 1
    again = LearningLoop(spark, loop.path, dirty_least=1)
    again.step(batch, 0)
    again.step(sents(spark, [1, 2], [3], first=1), 1)
    assert values(again)[1, 2][0] == 2 and again.sentences == 2 and again.rounds == 2


def test_paused_and_converged_loops_take_nothing(spark):
    loop = LearningLoop(spark, dirty_least=1, max_iterations=1)
    loop.paused = True
    with pytest.raises(NotNow):
        loop.step(sents(spark, [1, 2]))
    loop.paused = False
    loop.step(sents(spark, list(range(1, 9))))
    assert loop.converged == "iterations"
    with pytest.raises(NotNow):
        loop.step(sents(spark, [1, 2], first=9))
    assert loop.sentences == 1


def test_pause_resume_and_restart_lose_no_sentence(spark):
    every = sents(spark, *[[i % 7, i % 5 + 10, i % 3 + 20] for i in range(40)])
    loop = LearningLoop(spark, dirty_least=1)
    feed = learning.drop_files(every, 4)
    loop.paused = True
    loop.source = (feed, every.schema, 1)
    loop.start(feed, every.schema)
    loop.pause()
    loop.resume()
    assert loop.wait(120)
    restarted = LearningLoop(spark, loop.path, dirty_least=1)
    restarted.start(feed, every.schema)
    assert restarted.wait(120) and restarted.sentences == 40
    want = {(r["wa"], r["wb"]): r["count"] for r in pairs.pair_counts(every, 2, True).collect()}
    assert {k: v[0] for k, v in values(restarted).items()} == want
    sizes = {r["part"]: r["size"] for r in restarted.sizes().collect()}
    assert sizes["pairs"] == len(want) and sizes["words"] == 15 and sizes["totals"] == 2
    restarted.finish()
    assert restarted.converged in ("plateau", "exhausted") and restarted.cc_runs >= 5 and restarted.poll()["rounds"] == 4
    assert restarted.classes.count() == 15


def test_finish_scores_what_is_left(spark):
    loop = LearningLoop(spark, dirty_least=1000)
    loop.step(sents(spark, list(range(1, 12))))
    assert loop.cc_runs == 0 and all(d for _, _, d in values(loop).values())
    loop.finish()
    assert loop.converged == "exhausted" and loop.cc_runs == 5 and not any(d for _, _, d in values(loop).values())
    assert LearningLoop(spark, loop.path).converged == "exhausted"


def test_gates(spark):
    loop = LearningLoop(spark, dirty_least=1, gated=True)
    for k in range(6):
        loop.step(sents(spark, list(range(1, 12)), first=k))
    assert loop.converged is None and loop.cc_runs == 6


def fresh_labels(loop):
    """Classes by a run over all edges of the state."""
    from lexgraph.operators import components

    state = loop.state
    words = state.select(F.explode(F.array("wa", "wb")).alias("word_id")).distinct()
    edges = state.where((F.col("mi") > loop.min_mi) & (F.col("count") > loop.min_count) & (F.col("wa") != F.col("wb"))).select(F.col("wa").alias("a"), F.col("wb").alias("b"))
    return {tuple(x) for x in components.components_of(words, edges).collect()}


def test_classes_follow_every_batch(spark):
    """Edges come and go; after each batch the classes are those of a fresh run, and values those the batches left."""
    import random

    r = random.Random(5)
    loop = LearningLoop(spark, dirty_least=1, min_mi=1.0, min_count=1.0, max_iterations=10**6)
    before, lost = set(), 0
    for k in range(7):
        words = [[r.randrange(12) if r.random() < 0.2 * k else 4 * r.randrange(3) + r.randrange(4) for _ in range(6)] for _ in range(8)]
        loop.step(sents(spark, *words, first=10 * k))
        assert {tuple(x) for x in loop.classes.collect()} == fresh_labels(loop)
        now = {p for p, (c, m, _) in values(loop).items() if m > 1.0 and c > 1}
        lost += len(before - now)
        before = now
        if loop.converged:
            break
    assert lost > 0 and loop.cc_runs >= 4


def test_dirty_threshold_across_batches(spark):
    """Pairs of earlier batches are scored with the marginals and total of the batch that fills the threshold."""
    loop = LearningLoop(spark, dirty_least=12)
    every = [[1, 2, 3], [2, 3, 4, 1], [5, 6, 1, 9, 7, 8]]
    for k, words in enumerate(every):
        loop.step(sents(spark, words, first=k))
    got = values(loop)
    want = {(x["wa"], x["wb"]): x["mi"] for x in mi.mi_full(pairs.pair_counts(sents(spark, *every), 2, True)).collect()}
    assert {k: v[1] for k, v in got.items()} == pytest.approx(want) and not any(v[2] for v in got.values())


def test_a_failing_end_loses_nothing(spark, monkeypatch):
    """finish() breaks off in the middle of its writes: the committed state is still there for a new loop, and it goes on."""
    loop = LearningLoop(spark, dirty_least=1000)
    loop.step(sents(spark, [1, 2, 3], list(range(4, 12))))
    before = values(loop)
    real = mi.mi_expr
    monkeypatch.setattr(mi, "mi_expr", lambda *a: F.when(F.rand() < 2, F.raise_error(F.lit("lost")).cast("double")).otherwise(real(*a)))
    with pytest.raises(Exception, match="lost"):
        loop.finish()
    monkeypatch.setattr(mi, "mi_expr", real)
    again = LearningLoop(spark, loop.path, dirty_least=1000)
    assert values(again) == before and again.poll()["sentences"] == 2
    monkeypatch.setattr(LearningLoop, "_record", lambda self, row: (_ for _ in ()).throw(OSError("no commit")))
    with pytest.raises(OSError):
        again.finish()
    monkeypatch.undo()
    last = LearningLoop(spark, loop.path, dirty_least=1000)
    assert values(last) == before
    last.finish()
    assert last.converged == "exhausted" and not any(d for _, _, d in values(last).values())


def size_of(path):
    from pathlib import Path

    return sum(f.stat().st_size for f in Path(path).rglob("*.parquet"))


def test_bytes_written_follow_the_batch(spark, tmp_path):
    """A small batch after a large one writes little, in the counts' stream and in the loop; equal batches count once."""
    large, small = [[i % 97, i % 89 + 100, i % 83 + 200, i % 7 + 300] for i in range(3000)], [[1, 2], [2, 3]]
    rows = [(2 * i, w) for i, w in enumerate(large)] + [(2 * i + 1, w) for i, w in enumerate(small)]
    df = spark.createDataFrame(rows, "sent_id long, words array<long>")
    got = learning.stream_pair_counts(df, 2, folder=str(tmp_path / "counts"))
    want = {(x["wa"], x["wb"]): x["count"] for x in pairs.pair_counts(df, 2, True).collect()}
    assert {(x["wa"], x["wb"]): x["count"] for x in got.collect()} == want
    assert size_of(tmp_path / "counts/batch=1") * 5 < size_of(tmp_path / "counts/batch=0")
    loop = LearningLoop(spark, str(tmp_path / "loop"), dirty_least=1)
    loop.step(sents(spark, *large))
    loop.step(sents(spark, *small, first=9000))
    first, second = (size_of(loop._folder(loop.rows[k]["stored"][-1])) for k in (0, 1))
    assert second * 5 < first and {k: v[0] for k, v in values(loop).items()} == want


def test_folders_are_merged_and_old_ones_go(spark, monkeypatch):
    from pathlib import Path

    monkeypatch.setattr(learning, "FOLDERS", 3)
    loop = LearningLoop(spark, dirty_least=1, max_iterations=10**6)
    every = [[k, k + 1, k + 2, k % 3] for k in range(6)]
    for k, words in enumerate(every):
        loop.step(sents(spark, words, first=k))
        assert len(loop.rows[-1]["stored"]) <= 4
    assert {k: v[0] for k, v in values(loop).items()} == {(x["wa"], x["wb"]): x["count"] for x in pairs.pair_counts(sents(spark, *every), 2, True).collect()}
    row = loop.rows[-1]
    assert {p.name for p in Path(loop.path, "changes").iterdir()} == {*row["stored"], *row["since"], *row["unclustered"]}


def test_an_open_stream_flushes_when_idle_and_ends(spark, monkeypatch, tmp_path):
    """The stream stays open: idle rounds score what is dirty, fill the window of entropies, and end the loop."""
    import time

    monkeypatch.setattr(learning, "IDLE_ROUNDS", 12)
    key = "spark.sql.streaming.noDataProgressEventInterval"
    old = spark.conf.get(key)
    spark.conf.set(key, "20")
    feed = tmp_path / "feed"
    try:
        sents(spark, list(range(1, 12)), [1, 2, 3]).coalesce(1).write.parquet(str(feed / "a"))
        loop = LearningLoop(spark, dirty_least=1000)
        loop.start(str(feed), "sent_id long, words array<long>", open_end="50 milliseconds")
        for _ in range(600):
            if loop.cc_runs >= 1:
                break
            time.sleep(0.1)
        assert loop.cc_runs >= 1 and loop._last("dirty") == 0
        sents(spark, [20, 21], first=50).coalesce(1).write.parquet(str(feed / "b"))
        for _ in range(600):
            if loop.sentences == 3:
                break
            time.sleep(0.1)
        assert loop.wait(120) and loop.converged == "exhausted" and loop.idle_rounds > 12
        assert loop.sentences == 3 and loop.rounds == 2 and not any(d for _, _, d in values(loop).values())
    finally:
        spark.conf.set(key, old)
        loop.stop()
