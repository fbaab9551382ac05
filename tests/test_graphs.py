"""Forests, sweeps, components kept up to date, and cosines above a threshold."""

import random

import pytest
from pyspark.sql import functions as F

from lexgraph.operators import components, similarity
from lexgraph.plans.queries import QUERIES
from lexgraph.session import write_table


def some_edges(seed, nodes=60, edges=150):
    r = random.Random(seed)
    return [(r.randrange(nodes), r.randrange(nodes), r.choice([0.1, 0.2, 0.25, 0.5, 0.5, 0.9])) for _ in range(edges)]


def frame(spark, edges):
    return spark.createDataFrame(edges, "a long, b long, weight double")


def brute_roots(nodes, edges):
    up = {x: x for x in nodes}
    for _ in nodes:
        for a, b in edges:
            up[a] = up[b] = min(up[a], up[b])
    return up


@pytest.mark.parametrize("few", [0, 40, 10**6])
def test_forest_equals_kruskal(spark, few):
    edges = some_edges(1)
    best = {}
    for a, b, w in edges:
        if a != b:
            best[min(a, b), max(a, b)] = max(w, best.get((min(a, b), max(a, b)), 0))
    label, want = {x: x for e in edges for x in e[:2]}, set()
    for (a, b), w in sorted(best.items(), key=lambda x: (-x[1], x[0])):
        if label[a] != label[b]:
            want.add((a, b, w))
            old = label[b]
            label = {k: label[a] if v == old else v for k, v in label.items()}
    df = frame(spark, [*edges, (None, 3, 0.9), (3, 3, 0.9), (4, 5, None)])
    assert {tuple(x) for x in components.spanning_forest(df, few=few).collect()} == want
    assert components.spanning_forest(df.limit(0), few=few).count() == 0


@pytest.mark.parametrize("few", [0, 10**6])
def test_sweep_equals_a_run_for_each_threshold(spark, few):
    edges = some_edges(2, 80, 90)
    nodes = spark.createDataFrame([(i,) for i in range(90)], "word_id long")
    sim = frame(spark, edges).selectExpr("a as wa", "b as wb", "weight as cosine")
    steps = [0.95, 0.9, 0.5, 0.3, 0.25, 0.2, 0.1, 0.05]
    rows = components.threshold_sweep(nodes, sim, steps, few=few).collect()
    want = [len(set(brute_roots(range(90), [(a, b) for a, b, w in edges if w >= t]).values())) for t in steps]
    drops = [a - b for a, b in zip(want, want[1:])]
    assert [r["components"] for r in rows] == want
    assert [r["idx"] for r in rows if r["is_knee"]] == [drops.index(max(drops))] != [0]
    assert [r["is_knee"] for r in components.threshold_sweep(nodes, sim, [0.99, 0.98]).collect()] == [True, False]
    assert components.threshold_sweep(nodes, sim, [0.5]).first()["is_knee"]


def test_one_task_and_rounds_find_the_same(spark):
    df = frame(spark, some_edges(3))
    assert sorted(map(tuple, components.connected_components(df).collect())) == sorted(map(tuple, components.connected_components(df, few=10**6).collect()))


def test_components_follow_added_and_removed_edges(spark):
    r = random.Random(6)
    nodes = list(range(40))
    now, labels = set(), {x: x for x in nodes}
    pairs = lambda x: spark.createDataFrame(sorted(x), "a long, b long")
    for step in range(7):
        added = {tuple(sorted(r.sample(nodes, 2))) for _ in range(9)} - now
        removed = set(r.sample(sorted(now), min(len(now), 4)))
        if step == 3:
            nodes += [100, 101]
            added |= {(3, 100), (100, 101)}
        now = (now | added) - removed
        held = write_table(spark.createDataFrame(list(labels.items()), "node long, root long"), "labels")
        got = {x.node: x.root for x in components.update_components(held, pairs(added), pairs(removed), pairs(now)).collect()}
        assert got == brute_roots(nodes, now), step
        labels = got


@pytest.mark.parametrize("threshold", [0.0, 0.2, 0.5, 0.8, 0.99])
def test_cosines_above_equal_all_cosines(spark, threshold):
    r = random.Random(9)
    rows = {(w, f"d{int(r.random() ** 2 * 60)}"): r.randint(0, 6) for w in range(50) for _ in range(r.randint(1, 14))}
    rows |= {(w + 200, f"d{k}"): 1 for w in range(4) for k in range(5)} | {(300, "own"): 9}
    s = spark.createDataFrame([(*k, v) for k, v in rows.items()], "word long, disjunct string, count long")
    full = {(x.wa, x.wb): round(x.cosine, 9) for x in similarity.cosine_filter(similarity.cosine(s), threshold).collect()}
    assert {(x.wa, x.wb): round(x.cosine, 9) for x in similarity.cosine_above(s, threshold).collect()} == full
    made, every = similarity.candidates_above(s, threshold).count(), similarity.dot_products(s).count()
    assert len(full) <= made <= every and (threshold < 0.8 or made < every / 3)


def test_hot_disjuncts_of_prefixes_are_dealt_to_parts(spark, monkeypatch):
    s = spark.createDataFrame([(w, "hot", 3) for w in range(30)] + [(w, f"d{w % 5}", 1) for w in range(30)], "word long, disjunct string, count long")
    want = sorted(map(tuple, similarity.cosine_above(s, 0.5).select("wa", "wb").collect()))
    monkeypatch.setattr(similarity, "HOT", 10)
    assert sorted(map(tuple, similarity.cosine_above(s, 0.5).select("wa", "wb").collect())) == want and len(want) == 435


def test_similar_words_forms_few_pairs(spark):
    """On real sections the candidates are a small part of all pairs that share a disjunct."""
    from lexgraph.operators import parse
    from lexgraph.plans import queries

    found = write_table(parse.sections(queries._turn_parse(spark, "/root/testdata/sf0.01")), "sections")
    made, every = similarity.candidates_above(found, 0.7011).count(), similarity.dot_products(found).count()
    assert 0 < made < every / 2, (made, every)


def test_the_sweeps_knee_is_not_the_first(spark):
    rows = QUERIES["threshold_sweep"](spark, "/root/testdata/sf0.001").orderBy("idx").collect()
    counts = [r["components"] for r in rows]
    assert counts == sorted(counts, reverse=True) and [r["idx"] for r in rows if r["is_knee"]] > [0]


def test_many_products_are_summed_in_slices(spark, monkeypatch):
    s = spark.createDataFrame([(w, d, 1 + (w * d) % 5) for w in range(60) for d in range(12) if (w + d) % 3], "word long, disjunct long, count long")
    rows = lambda df: sorted((r["wa"], r["wb"], r["dot"]) for r in df.collect())
    plain, parts, write = rows(similarity.cosine(s)), [], similarity.write_table
    monkeypatch.setattr(similarity, "SLICE", 100)
    monkeypatch.setattr(similarity, "write_table", lambda df, label: parts.append(write(df, label)) or parts[-1] if label == "dots" else write(df, label))
    assert rows(similarity.cosine(s)) == plain and len(plain) > 1000
    assert len(parts) > 3 and sum(p.count() for p in parts) == len(plain) > 2 * max(p.count() for p in parts)
    monkeypatch.setattr(similarity, "HOT", 10)
    assert rows(similarity.cosine(s)) == plain
