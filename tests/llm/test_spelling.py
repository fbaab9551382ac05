"""Spelling variants against brute force."""

import random
import re
import zlib
from collections import Counter

import pytest

from lexgraph.llm import spelling


def brute_words(rows, every=199):
    count = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate({c: c + 32 for c in range(65, 91)})
            h = zlib.crc32(f"{doc_id}:{run}".encode())
            if doc_id is not None and h % every == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            count[run] += 1
    return {w: n for w, n in count.items() if len(w) >= 6 and n >= 5}


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :] or a[i + 1 :] == b[i:]


def brute(words):
    out, form = [], {}
    near = {w: [x for x in words if one_edit(w, x)] for w in words}
    for w, n in words.items():
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        if best is not None and words[best] >= 5 * n:
            form[w] = best
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        f = form.get(w)
        out.append((w, f, root, n, len(near[w]), words[f] if f else None))
    return sorted(out, key=lambda x: x[0])


def misspelt(r, w):
    i, k = r.randrange(len(w)), r.random()
    return w[:i] + w[i + 1 :] if k < 0.3 else w[:i] + r.choice("abéÿz×") + w[i + (k < 0.7) :]


def some_rows(seed):
    r = random.Random(seed)
    base = ["".join(r.choice("abcdeÀéß×") for _ in range(r.randint(5, 9))) for _ in range(25)]
    rows = []
    for i in range(60):
        words = []
        for _ in range(200):
            w = r.choice(base[: r.randint(1, 25)])
            words.append(w if r.random() < 0.8 else misspelt(random.Random(f"{w}{r.randint(0, 2)}"), w))
        rows.append((i, "".join(w + r.choice([" ", ". ", "-", "\n", " É"]) for w in words).title() if i % 3 else " ".join(words)))
    return rows + [(900, None), (901, ""), (902, "123 .,;"), (None, "abcdef " * 7), (903, "same words "), (903, "same words "), (904, "long" * 30 + " " + "longer " * 9)]


@pytest.mark.parametrize("seed", [1, 2])
def test_variants_equal_brute_force(spark, seed):
    rows = some_rows(seed)
    want = brute(brute_words(rows))
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, word string, n int").repartition(4)
    got = sorted(map(tuple, spelling.spelling_variants(df).select("word", "form", "root", "n", "n_near", "form_n").collect()))
    assert got == want
    assert sum(x[1] is not None for x in want) > 20 and any(x[1] not in (None, x[2]) for x in want)


def test_every_alphabet_finds_the_same_pairs(spark):
    r = random.Random(8)
    words = sorted({"".join(r.choice("abcÀéÿ÷") for _ in range(r.randint(3, 6))) for _ in range(400)})
    df = spark.createDataFrame([(w, 1) for w in words], "word string, n long")
    want = sorted((a, b) for i, a in enumerate(words) for b in words[i + 1 :] if one_edit(a, b))
    for size in spelling.ALPHABETS:
        got = sorted(tuple(sorted((x.a, x.b))) for x in spelling.near_pairs(df, size).collect())
        assert got == want, size


def test_crowded_reduced_words_get_a_larger_alphabet(spark):
    same = [c for c, s in zip(spelling.LETTERS, spelling.symbols(4)) if s == spelling.symbols(4)[0]]
    r = random.Random(2)
    crowd = {"".join(r.choice(same) for _ in range(8)) for _ in range(3000)}
    df = spark.createDataFrame([(w, 1) for w in crowd], "word string, n long")
    assert spelling.choose_alphabet(df) > 4


def test_empty_table(spark):
    assert spelling.spelling_variants(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    assert spelling.spelling_variants(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")).collect() == []


def test_query_equals_sql_on_a_whole_table(spark):
    import duckdb

    from lexgraph.llm.queries import ORACLES, QUERIES

    con = duckdb.connect()
    con.execute("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.001/documents.parquet'")
    cols = ["word", "form", "root", "n", "n_near", "form_n"]
    got = sorted(map(tuple, QUERIES["op12_spelling_variants"](spark, "/root/testdata/sf0.001").select(*cols).collect()))
    assert got == sorted(con.execute(f"SELECT {', '.join(cols)} FROM ({ORACLES['op12_spelling_variants']})").fetchall())
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    assert {x[0]: x[3] for x in got} == brute_words(map(tuple, docs))
