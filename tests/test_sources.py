"""The binary corpus and the stream of sentence lines."""

import json
import random
import struct

import pytest
from pyspark.sql import functions as F

from lexgraph.operators import pairs
from lexgraph.sources import corpus, sequences
from lexgraph.streaming.learning import LearningLoop


def rows_of(df):
    return sorted(tuple(x.words) for x in df.collect())


def test_round_trip_of_many_splits(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(corpus, "STEP", 7)
    r = random.Random(2)
    sents = [(i, [r.randrange(2**32) for _ in range(r.choice([0, 1, 5, 300]))]) for i in range(500)]
    df = spark.createDataFrame(sents, "sent_id long, words array<long>").repartition(5)
    path = str(tmp_path / "c")
    corpus.write_binary_corpus(df, path)
    got = corpus.read_binary_corpus(spark, path)
    assert got.rdd.getNumPartitions() > 60 and rows_of(got) == sorted(tuple(w) for _, w in sents)
    assert got.select("sent_id").distinct().count() == 500
    note = json.loads((tmp_path / "c/_corpus.json").read_text())
    assert note["sentences"] == 500 and note["words"] == 1 + max(w for _, s in sents for w in s)
    with pytest.raises(Exception, match="FileExists"):
        corpus.write_binary_corpus(df, path)
    assert rows_of(corpus.read_binary_corpus(spark, path)) == sorted(tuple(w) for _, w in sents)
    corpus.write_binary_corpus(df.limit(3), path, "overwrite")
    assert corpus.read_binary_corpus(spark, path).count() == 3


def test_files_of_others_are_walked_for_their_ranges(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(corpus, "STEP", 3)
    sents = [[k, k + 1] * (k % 4) for k in range(20)]
    (tmp_path / "c.bin").write_bytes(struct.pack("<II", 20, 30) + b"".join(struct.pack(f"<{len(s) + 1}I", len(s), *s) for s in sents))
    got = corpus.read_binary_corpus(spark, str(tmp_path / "c.bin"))
    assert sorted((x.sent_id, x.words) for x in got.collect()) == list(enumerate(sents)) and got.rdd.getNumPartitions() == 7
    (tmp_path / "e.bin").write_bytes(struct.pack("<II", 0, 0))
    assert corpus.read_binary_corpus(spark, str(tmp_path / "e.bin")).count() == 0


def test_a_file_beyond_2_gb_is_not_one_row(spark, tmp_path):
    """A sparse file of 2.4 GB whose sentences are zeros: only its ranges are read."""
    long, n = 150_000, 4000
    path = tmp_path / "large.bin"
    with open(path, "wb") as f:
        f.write(struct.pack("<II", n, 1))
        for k in range(n):
            f.seek(8 + k * (4 + 4 * long))
            f.write(struct.pack("<I", long))
        f.truncate(8 + n * (4 + 4 * long))
    offsets = [8 + k * (4 + 4 * long) for k in range(n)]
    (tmp_path / "_corpus.json").write_text(json.dumps({"files": [{"name": "large.bin", "offsets": offsets[:: corpus.STEP], "size": path.stat().st_size}]}))
    assert path.stat().st_size > 2**31
    # Each index entry would be STEP long sentences; a finer note gives small ranges.
    (tmp_path / "_corpus.json").write_text(json.dumps({"files": [{"name": "large.bin", "offsets": offsets, "size": path.stat().st_size}]}))
    got = corpus.read_binary_corpus(spark, str(tmp_path)).limit(2).select(F.size("words").alias("n")).collect()
    assert [x.n for x in got] == [long, long]


def test_a_failing_write_leaves_no_corpus(spark, tmp_path):
    df = spark.range(50).select(F.col("id").alias("sent_id"), F.array(F.when(F.col("id") == 40, F.raise_error(F.lit("lost")).cast("long")).otherwise(F.col("id"))).alias("words")).repartition(4)
    with pytest.raises(Exception, match="lost"):
        corpus.write_binary_corpus(df, str(tmp_path / "c"))
    assert not (tmp_path / "c/_corpus.json").exists()


def test_lines_come_by_the_cap_and_go_on_in_mid_file(spark, tmp_path):
    feed = tmp_path / "feed"
    feed.mkdir()
    lines = [f"w{k} x{k % 5} y{k % 3}" for k in range(50)]
    (feed / "a.txt").write_text("\n".join(lines[:30]) + "\n")
    (feed / "b.txt").write_text("\n\n".join(lines[30:45]) + "\nhalf a li")
    sizes, seen = [], []

    def take(batch, number):
        got = batch.collect()
        sizes.append(len(got))
        seen.extend((x.sent_id, " ".join(x.words)) for x in got)

    def run(batches):
        query = corpus.sentence_lines(spark, str(feed)).writeStream.foreachBatch(take).option("checkpointLocation", str(tmp_path / "state")).start()
        try:
            for _ in range(300):
                if len(sizes) >= batches:
                    break
                query.awaitTermination(0.1)
        finally:
            query.stop()

    run(2)
    assert sizes[:2] == [16, 16]
    done = len(seen)
    with open(feed / "b.txt", "a") as f:
        f.write("ne\n" + "\n".join(lines[46:]) + "\n")
    run(len(sizes) + (50 - done + 15) // 16)
    want = [*lines[:45], "half a line", *lines[46:]]
    assert sorted(set(seen)) == list(enumerate(want)) and len(seen) == 50 and max(sizes) == 16


def test_the_loop_learns_from_lines(spark, tmp_path):
    lines = [f"a{k % 4} b{k % 3} c{k % 2}" for k in range(40)]
    (tmp_path / "feed.txt").write_text("\n".join(lines) + "\n")
    loop = LearningLoop(spark, dirty_least=1, max_iterations=10**6)
    loop.start(corpus.sentence_lines(spark, str(tmp_path / "feed.txt")), open_end="0 seconds")
    try:
        for _ in range(600):
            if loop.sentences == 40 or not loop.poll()["running"]:
                break
            loop.query.awaitTermination(0.1)
    finally:
        loop.stop()
    every = spark.createDataFrame([(i, x.split()) for i, x in enumerate(lines)], "sent_id long, words array<string>")
    want = {(x.wa, x.wb): x["count"] for x in pairs.pair_counts(every, 2, True).collect()}
    assert {(x.wa, x.wb): x["count"] for x in loop.state.collect()} == want and loop.rounds == 3


def test_the_profile_of_all_words_needs_no_vocabulary(spark):
    rows = [(1, ["a", "b", "a"]), (2, ["c"]), (None, ["a", "b"]), (None, ["d"]), (7, ["x", "y"]), (7, ["z"]), (8, ["p"] * 70)]
    s = spark.createDataFrame(rows, "sent_id long, words array<string>")
    got = sequences.corpus_profile(s)
    assert got.first() == sequences.corpus_profile(s, sequences.vocabulary(s)).first() == (7, 4, 19.75, 3, 70)
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert sequences.corpus_profile(s.where("false")).first() == (0, 0, None, None, None)
