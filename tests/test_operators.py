import math

import pytest
from pyspark.sql import functions as F

from lexgraph import store
from lexgraph.functions.hashing import disjunct_hash
from lexgraph.operators import components, divergence, mi, pairs, parse, similarity, substitute
from lexgraph.sources import corpus, sequences
from lexgraph.streaming.learning import plateau


def sents(spark, *lists):
    return spark.createDataFrame([(i, list(x)) for i, x in enumerate(lists)], "sent_id long, words array<long>")


def counts(df):
    return {(r["wa"], r["wb"]): r["count"] for r in df.collect()}


def test_pair_counts_with_and_without_self_pairs(spark):
    s = sents(spark, [0, 0, 1])
    assert counts(pairs.pair_counts(s, 2)) == {(0, 1): 2}
    assert counts(pairs.pair_counts(s, 2, True)) == {(0, 0): 1, (0, 1): 2}


def test_rows_in_order_count_like_arrays(spark):
    import random

    r = random.Random(3)
    lists = [[r.randint(0, 5) for _ in range(n)] for n in (0, 1, 2, 9, 30)]
    rows = [(i, k, w) for i, x in enumerate(lists) for k, w in enumerate(x)]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "s long, k int, w long")
    for window, own in ((1, True), (2, False), (6, True)):
        assert counts(pairs.ordered_pair_counts(df, "s", ["k"], "w", window, own)) == counts(pairs.pair_counts(sents(spark, *lists), window, own))


def test_two_phases_equal_one(spark):
    s = sents(spark, [1, 2, 3, 1], [2, 3], [3, 3, 2])
    assert counts(pairs.two_phase_counts(s, 2)) == counts(pairs.pair_counts(s, 2, True))


def test_mi_formula_and_low_counts(spark):
    p = spark.createDataFrame([(1, 2, 8), (2, 3, 2)], "wa long, wb long, count long")
    got = {(r["wa"], r["wb"]): r["mi"] for r in mi.mi_full(p).collect()}
    assert got[1, 2] == pytest.approx(math.log2(8 * 10 / (8 * 10)))
    assert got[2, 3] == pytest.approx(math.log2(2 * 10 / (10 * 2)))
    zero = spark.createDataFrame([(1, 2, 0), (3, 4, 5)], "wa long, wb long, count long")
    assert {r["wa"]: r["mi"] for r in mi.mi_full(zero).collect()}[1] == 0.0


def test_incremental_values_stay_for_untouched_pairs(spark):
    old = mi.mi_full(spark.createDataFrame([(1, 2, 4), (3, 4, 4)], "wa long, wb long, count long"))
    new = spark.createDataFrame([(1, 2, 4)], "wa long, wb long, count long")
    before = {r["wa"]: r["mi"] for r in old.collect()}
    after = {r["wa"]: r["mi"] for r in mi.mi_incremental(old, new).collect()}
    assert after[3] == before[3] and after[1] == pytest.approx(math.log2(8 * 12 / 64))


def test_changes_touch_only_what_is_new(spark):
    """Marginals and total are kept by their changes, over several batches, and no clean pair is aggregated."""
    import random

    from lexgraph.session import write_table

    r = random.Random(7)
    batches = [[(a, a + r.randint(0, 3), r.randint(1, 4)) for a in {r.randint(1, 20) for _ in range(9)}] for _ in range(4)]
    frame = lambda rows: write_table(spark.createDataFrame(rows, "wa long, wb long, count long"), "batch")
    state = {p: (c, m) for *p, c, m in []}
    words, total = {}, 0
    for batch in batches:
        held = write_table(spark.createDataFrame([(*p, c, m) for p, (c, m) in state.items()], "wa long, wb long, count long, mi double"), "state")
        kept = spark.createDataFrame(list(words.items()), "word long, marginal long")
        changed, touched, total = mi.mi_changes(held, kept, total, frame(batch))
        plan = changed._jdf.queryExecution().optimizedPlan().toString()
        assert "Aggregate" not in plan
        state |= {(x["wa"], x["wb"]): (x["count"], x["mi"]) for x in changed.collect()}
        words |= {x["word"]: x["marginal"] for x in touched.collect()}
    every = spark.createDataFrame([x for b in batches for x in b], "wa long, wb long, count long").groupBy("wa", "wb").agg(F.sum("count").alias("count"))
    want = {(x["wa"], x["wb"]): (x["count"], x["mi"]) for x in mi.mi_full(every).collect()}
    assert {k: v[0] for k, v in state.items()} == {k: v[0] for k, v in want.items()}
    assert {k: state[k][1] for k in ((a, b) for a, b, _ in batches[-1])} == pytest.approx({k: want[k][1] for k in ((a, b) for a, b, _ in batches[-1])})
    assert words == {x["word"]: x["marginal"] for x in pairs.marginals(every).collect()} and total == sum(c for c, _ in want.values())


def test_disjunct_hashes(spark):
    df = spark.sql("SELECT array(named_struct('dir', 1, 'word', 20L)) AS a, array(named_struct('dir', 0, 'word', 10L), named_struct('dir', 1, 'word', 30L)) AS b, array(named_struct('dir', 0, 'word', 20L)) AS c")
    row = df.select(*(F.hex(disjunct_hash(F.col(c))).alias(c) for c in "abc")).first()
    assert [x.lower().rjust(16, "0") for x in row] == ["af63a44c86018d64", "085b8b07b50e7a1a", "af63a54c86018f17"]


def test_tree_takes_best_edges_and_zero_beats_negative(spark):
    s = sents(spark, [1, 2, 3], [1], [])
    m = spark.createDataFrame([(1, 2, -3.0), (2, 3, 5.0)], "wa long, wb long, mi double")
    got = {(r["sent_id"], r["p1"], r["p2"], r["weight"]) for r in parse.word_trees(s, m).collect()}
    assert got == {(0, 1, 2, 5.0), (0, 0, 2, 0.0)}
    looked = parse.word_weights(parse.position_pairs(s), m).collect()
    assert {(r["p1"], r["p2"]): r["weight"] for r in looked} == {(0, 1): -3.0, (0, 2): 0.0, (1, 2): 5.0}


def test_sections_of_a_chain(spark):
    e = spark.createDataFrame([(0, 0, 1, 10, 20), (0, 1, 2, 20, 30)], "sent_id long, p1 int, p2 int, w1 long, w2 long")
    got = {r["word"]: [(c["dir"], c["word"]) for c in r["disjunct"]] for r in parse.sections(e).collect()}
    assert got == {10: [(1, 20)], 20: [(0, 10), (1, 30)], 30: [(0, 20)]}


def test_cosine(spark):
    s = spark.createDataFrame([(1, "a", 3), (1, "b", 4), (2, "a", 3), (2, "b", 4), (3, "c", 1)], "word long, disjunct string, count long")
    rows = similarity.cosine(s).collect()
    assert [(r["wa"], r["wb"], r["dot"]) for r in rows] == [(1, 2, 25)] and rows[0]["cosine"] == pytest.approx(1.0)


def test_components_and_isolated_nodes(spark):
    nodes = spark.createDataFrame([(i,) for i in range(8)], "word_id long")
    edges = spark.createDataFrame([(5, 4), (4, 3), (3, 5), (7, 6), (6, 6), (None, 1)], "a long, b long")
    got = {r["word_id"]: (r["root"], r["class_id"]) for r in components.components_of(nodes, edges).collect()}
    assert got == {0: (0, 0), 1: (1, 1), 2: (2, 2), 3: (3, 3), 4: (3, 3), 5: (3, 3), 6: (6, 4), 7: (6, 4)}


def test_long_chain_is_one_component(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)], "a long, b long")
    assert {r["root"] for r in components.connected_components(edges).collect()} == {0}


def test_sweep_knee(spark):
    nodes = spark.createDataFrame([(i,) for i in range(4)], "word_id long")
    sim = spark.createDataFrame([(0, 1, 0.9), (1, 2, 0.5), (2, 3, 0.5)], "wa long, wb long, cosine double")
    rows = components.threshold_sweep(nodes, sim, [0.95, 0.6, 0.3]).collect()
    assert [r["components"] for r in rows] == [4, 3, 1] and [r["is_knee"] for r in rows] == [False, True, False]


def test_substitution_merges_and_drops(spark):
    p = spark.createDataFrame([(1, 2, 3), (1, 3, 4), (2, 3, 5)], "wa long, wb long, count long")
    c = spark.createDataFrame([(1, 0), (2, 0)], "word long, class_id long")
    assert counts(substitute.substitute_pairs(p, c, 100)) == {(3, 100): 9}
    assert tuple(substitute.substitute_metrics(p, c, 100).first()) == (3, 1, 1)


def test_costs(spark):
    s = spark.createDataFrame([(1, "a", 16), (1, "b", 1), (2, "a", 0)], "word long, disjunct string, count long")
    got = [r["cost"] for r in substitute.grammar_costs(s).orderBy(F.desc("count")).collect()]
    assert got == pytest.approx([0.1, 2.1, 99.0])


def test_divergence_needs_three_partners(spark):
    def side(rows):
        return spark.createDataFrame([(w, p, m, 1) for w, p, m in rows], "word long, partner long, mi double, rank int")
    a = side([(1, i, 1.0) for i in range(3)] + [(2, 1, 1.0)])
    b = side([(1, i + 10, 1.0) for i in range(3)] + [(2, 9, 1.0)])
    got = {r["word"]: (r["divergence"], r["polysemous"]) for r in divergence.divergence(a, b).collect()}
    assert got == {1: (1.0, True), 2: (0.0, False)}


def test_sentences(spark):
    docs = spark.createDataFrame([(1, "It's one. Two words! x\nÉa b?"), (2, None), (3, "")], "doc_id long, text string")
    assert [r["words"] for r in sequences.sentences(docs).orderBy("sent_id").collect()] == [["it's", "one"], ["two", "words"], ["a", "b"]]


def test_book_marks(spark):
    lines = ["front", "*** START OF BOOK", "CHAPTER ONE", "Text here", "1234", "OK", "*** END OF BOOK", "back"]
    df = spark.createDataFrame([("d", i, x) for i, x in enumerate(lines)], "doc string, no int, line string")
    assert [r["line"] for r in sequences.body_lines(df).orderBy("no").collect()] == ["Text here", "OK"]


def test_corpus_and_vocabulary_files(spark, tmp_path):
    docs = spark.createDataFrame([(1, "b a. a c d")], "doc_id long, text string")
    s = sequences.sentences(docs)
    v = sequences.vocabulary(s, 3)
    assert [r["word"] for r in v.orderBy("word_id").collect()] == ["b", "a", "c"]
    sequences.write_vocabulary(v, str(tmp_path / "v"))
    assert sorted(map(tuple, sequences.read_vocabulary(spark, str(tmp_path / "v")).collect())) == [(0, "b"), (1, "a"), (2, "c")]
    sequences.write_corpus(sequences.encode(s, v), str(tmp_path / "c"))
    assert sorted(r["words"] for r in sequences.read_corpus(spark, str(tmp_path / "c")).collect()) == [[0, 1], [1, 2]]
    assert sequences.corpus_profile(s, v).first()["usable"] == 2


def test_store(spark):
    s = store.AtomStore(spark, strict=True)
    s.open()
    with pytest.raises(RuntimeError):
        s.open()
    s.store_nodes(spark.createDataFrame([("a", [1.0, 2.0, 3.0]), ("b", [4.0]), ("z", [0.0, 0.0])], "name string, value array<double>"))
    s.store_links(spark.createDataFrame([("b", "a", [5.0]), ("c", "a", [6.0, 7.0])], "left string, right string, value array<double>"))
    assert {r["name"]: r["value"] for r in s.load_nodes().collect()} == {"a": [1.0, 2.0], "b": [4.0, 0.0], "z": None, "c": None}
    assert {(r["a"], r["b"]) for r in s.incoming(spark.createDataFrame([("a",)], "name string")).collect()} == {("a", "b"), ("a", "c")}
    s.remove_nodes(spark.createDataFrame([("a",)], "name string"), recursive=True)
    assert s.monitor()["links"] == 0 and s.sql("SELECT count(*) FROM nodes").first()[0] == 3
    s.close()
    with pytest.raises(RuntimeError):
        s.load_nodes()


def test_plateau():
    assert plateau([2.0, 2.0, 2.01, 2.0, 2.005]) and not plateau([1.0] * 4 + [1.02]) and not plateau([0.0] * 5)


def test_entry_imports_and_keys_match():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and len(e.queries()) > 40


def test_word_caps_are_optional(spark):
    docs = spark.createDataFrame([(1, "a" * 70 + " b c d")], "doc_id long, text string")
    assert [len(w) for w in sequences.sentences(docs).first()["words"]] == [70, 1, 1, 1]
    assert [len(w) for w in sequences.sentences(docs, max_words=2, max_chars=63).first()["words"]] == [63, 1]
    assert sequences.vocabulary(sequences.sentences(docs), 2).count() == 2


def test_letters_come_from_ascii_only(spark):
    docs = spark.createDataFrame([(1, "\u212aelvin Don't na\u00efve")], "doc_id long, text string")
    assert sequences.sentences(docs).first()["words"] == ["elvin", "don't", "na", "ve"]


def test_body_lines_follow_the_marks(spark):
    books = {"a": ["x", "*** END OF x", "*** START OF book", "one", "TWOSS", "TWO", "2", "*** START OF again", "three", "*** END OF book", "four", "*** START OF more", "five"], "b": ["no mark"], "c": ["*** START OF it", "open end"]}
    rows = spark.createDataFrame([(d, k, x) for d, ls in books.items() for k, x in enumerate(ls)], "doc string, no int, line string")
    assert sorted((r["doc"], r["line"]) for r in sequences.body_lines(rows).collect()) == [("a", "*** START OF again"), ("a", "TWO"), ("a", "one"), ("a", "three"), ("c", "open end")]


def test_text_and_binary_corpora(spark, tmp_path):
    import struct

    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "a.txt").write_text("".join(f"line {i}\n" for i in range(5000)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10000")
    try:
        got = sequences.read_text(spark, str(tmp_path / "t")).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert sorted((r["no"], r["line"]) for r in got) == [(i, f"line {i}") for i in range(5000)]
    sent = [[1, 2, 3], [4], [5, 1]]
    raw = struct.pack("<II", len(sent), 6) + b"".join(struct.pack(f"<I{len(w)}I", len(w), *w) for w in sent)
    (tmp_path / "c.bin").write_bytes(raw)
    assert sorted((r["sent_id"], r["words"]) for r in corpus.read_binary_corpus(spark, str(tmp_path / "c.bin")).collect()) == list(enumerate(sent))


def test_given_lists_are_counted(spark):
    asked = spark.createDataFrame([(2, 1), (1, 2), (3, 3)], "wa long, wb long")
    old = spark.createDataFrame([(1, 2, 5), (7, 8, 1)], "wa long, wb long, count long")
    assert counts(pairs.count_given(asked, ["wa", "wb"], old)) == {(1, 2): 7, (3, 3): 1, (7, 8): 1}
    assert counts(pairs.count_given(asked.where("false"), ["wa", "wb"])) == {}


def test_hot_disjuncts_are_dealt_to_parts(spark, monkeypatch):
    s = spark.createDataFrame([(w, "hot", w % 3 + 1) for w in range(40)] + [(1, "b", 2), (2, "b", 2)], "word long, disjunct string, count long")
    plain = {(r["wa"], r["wb"]): r["dot"] for r in similarity.dot_products(s).collect()}
    monkeypatch.setattr(similarity, "HOT", 10)
    assert {(r["wa"], r["wb"]): r["dot"] for r in similarity.dot_products(s).collect()} == plain and len(plain) == 780


def test_store_values_types_and_uris(spark):
    assert store.parse_uri("gpu://cuda:nvidia:0") == {"scheme": "gpu", "backend": "cuda", "platform": "nvidia", "device": "0"}
    assert store.parse_uri("gpu://opencl:rtx") == {"scheme": "gpu", "backend": "opencl", "platform": "rtx", "device": ""}
    assert store.parse_uri("gpu://amd:gfx")["platform"] == "amd" and store.parse_uri("gpu://")["device"] == ""
    assert store.parse_uri("gpu://nvidia") == {"scheme": "gpu", "backend": "", "platform": "nvidia", "device": ""}
    assert store.parse_uri("gpu://cuda::")["platform"] == "" and store.parse_uri("gpu://a:b:c")["device"] == "b:c" and store.parse_uri("gpu://cuda")["platform"] == "cuda"
    with pytest.raises(ValueError):
        store.parse_uri("nothing")
    s = store.AtomStore(spark)
    s.open()
    s.store_links(spark.createDataFrame([("b", "a", [1.0], 1), ("a", "b", [9.0, 2.0], 2), ("a", "a", [3.0], 1)], "left string, right string, value array<double>, seq int"), order="seq")
    s.store_sections(spark.createDataFrame([("a", 5, 2)], "word string, djh long, count long"))
    s.store_values(spark.createDataFrame([("b", "a", 7.0), ("x", "y", 1.0)], "left string, right string, number double"), 1)
    s.store_values(spark.createDataFrame([("a", 4.0)], "name string, number double"), 1)
    got = {(r["a"], r["b"]): r["value"] for r in s.load_links("pair").collect()}
    assert got == {("a", "b"): [9.0, 7.0], ("a", "a"): [3.0]} and s.load_links("other").count() == 0
    assert {r["name"]: r["value"] for r in s.load_nodes().collect()} == {"a": [0.0, 4.0], "b": None}
    asked = spark.createDataFrame([("b", "a"), ("c", "d")], "left string, right string")
    assert {r["a"]: r["number"] for r in s.load_values(asked, 1).collect()} == {"a": 7.0, "c": None}
    assert s.incoming(spark.createDataFrame([("a",)], "name string"), "pair").count() == 2
    m = s.monitor()
    assert (m["nodes"], m["links"], m["sections"]) == (2, 2, 1)
    with pytest.raises(Exception, match="equal keys need an order"):
        s.store_nodes(spark.createDataFrame([("a", [1.0]), ("a", [2.0])], "name string, value array<double>"))
        s.load_nodes().collect()


def files(path):
    return {str(f.relative_to(path)): f.stat().st_mtime_ns for f in path.rglob("*.parquet")}


def test_a_write_leaves_the_files_of_other_parts(spark, tmp_path):
    s = store.AtomStore(spark, path=str(tmp_path))
    s.open()
    s.store_nodes(spark.createDataFrame([(f"n{i}", [float(i)]) for i in range(200)], "name string, value array<double>"))
    before = files(tmp_path)
    assert len(before) == store.PARTS
    s.store_nodes(spark.createDataFrame([("n7", [70.0]), ("new", [1.0])], "name string, value array<double>"))
    s.store_values(spark.createDataFrame([("n7", 71.0)], "name string, number double"))
    s.remove_nodes(spark.createDataFrame([("n7x",), ("new",)], "name string"))
    after = files(tmp_path)
    same = {f for f in before if after.get(f) == before[f]}
    assert len(same) >= store.PARTS - 3 and s.load_nodes().count() == 200
    s.close()
    # Another store finds it all.
    t = store.AtomStore(spark, path=str(tmp_path))
    t.open()
    assert {r["name"]: r["value"] for r in t.get_nodes(spark.createDataFrame([("n7",), ("n8",), ("new",)], "name string")).collect()} == {"n7": [71.0], "n8": [8.0], "new": None}
    t.store_links(spark.createDataFrame([("n1", "z", [1.0]), ("n1", "n2", [2.0])], "left string, right string, value array<double>"))
    t.remove_nodes(spark.createDataFrame([("z",)], "name string"), recursive=True)
    assert (t.monitor()["nodes"], t.monitor()["links"]) == (200, 1)
    t.erase()
    assert t.load_nodes().count() == 0 == len(files(tmp_path))


def test_a_failing_write_changes_nothing(spark, tmp_path):
    s = store.AtomStore(spark, path=str(tmp_path))
    s.open()
    s.store_nodes(spark.createDataFrame([("a", [1.0]), ("b", [2.0])], "name string, value array<double>"))
    with pytest.raises(Exception, match="equal keys need an order"):
        s.store_nodes(spark.createDataFrame([("c", [1.0]), ("c", [2.0])], "name string, value array<double>"))
    t = store.AtomStore(spark, path=str(tmp_path))
    t.open()
    t.store_nodes(spark.createDataFrame([("a", [5.0])], "name string, value array<double>"))
    # The first store's view is older: its write does not replace what it has not seen.
    with pytest.raises(Exception):
        s.store_nodes(spark.createDataFrame([("a", [6.0])], "name string, value array<double>"))
    u = store.AtomStore(spark, path=str(tmp_path))
    u.open()
    assert {r["name"]: r["value"] for r in u.load_nodes().collect()} == {"a": [5.0], "b": [2.0]}


def test_composites(spark):
    p = spark.createDataFrame([(1, 2, 4), (2, 3, 4), (1, 3, 2)], "wa long, wb long, count long")
    words = spark.createDataFrame([(1, None), (2, 0), (3, 0)], "word long, class_id long")
    updates = spark.createDataFrame([(1, 5)], "word long, class_id long")
    s = spark.createDataFrame([(1, "x", 2), (2, "x", 1), (3, "x", 1)], "word long, disjunct string, count long")
    classes, new_pairs, new_sections = substitute.substitute(p, s, words, updates, 100)
    assert {r["word"]: r["class_id"] for r in classes.collect()} == {1: 5, 2: 0, 3: 0}
    assert counts(new_pairs) == {(100, 105): 6}
    assert {r["word"]: r["count"] for r in new_sections.collect()} == {105: 2, 100: 2}
    m = mi.mi_full(p)
    costs, values = substitute.grammar(s, m, classes)
    assert costs.count() == 3 and values.count() <= 1
    seqs = sents(spark, [1, 2, 3], [2, 3])
    by_words, by_classes, found = parse.parse_and_surprise(seqs, m, classes, values)
    assert by_words.count() == by_classes.count() == 3 and found.count() == 2
