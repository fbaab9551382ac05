"""Ranked search against brute force."""

import math
import random
import re
from collections import Counter

import pytest

from lexgraph.llm import ranked

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return TERM.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))


def brute(docs, items, k=10):
    held = [(i, Counter(terms(t))) for i, t in docs]
    held = [(i, c) for i, c in held if c]
    n_docs, total = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        found = []
        for i, c in held:
            m = 100 - 75 + (75 * sum(c.values()) * n_docs) // total
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m)) for t in terms(text) if t in c)
            if s > 0:
                found.append((-s, math.inf if i is None else i))
        out += [(item, k + 1, None if i == math.inf else i, -s) for k, (s, i) in enumerate(sorted(found)[:k])]
    return sorted(out, key=str)


def some(seed, n):
    r = random.Random(seed)
    vocab = ["".join(r.choice("abcdEFé中0_") for _ in range(r.randint(1, 4))) for _ in range(120)]
    return [(3 * i + 1, "".join(r.choice(vocab[: r.randint(2, 120)]) + r.choice([" ", ",", "\n", "-"]) for _ in range(r.choice([1, 3, 10, 10, 40, 200])))) for i in range(n)], vocab


def frames(spark, docs, items):
    return (spark.createDataFrame([(i, t, 1, "x", 2) for i, t in docs], "doc_id long, text string, m int, item_id string, score int").repartition(5),
            spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, doc_id int"))


def rows(df):
    return sorted(map(tuple, df.select("item_id", "rank", "doc_id", "score").collect()), key=str)


@pytest.mark.parametrize("seed,small", [(1, False), (2, True)])
def test_ranks_equal_brute_force(spark, monkeypatch, seed, small):
    if small:
        for name, value in (("BLOCK_TERMS", 300), ("BLOCK_DOCS", 7), ("CHUNK_ITEMS", 5), ("GROUP", 3), ("FIRST_STRATA", 2), ("BROADCAST_ROWS", 0)):
            monkeypatch.setattr(ranked, name, value)
    docs, vocab = some(seed, 300)
    r = random.Random(seed)
    # Copies tie, and make one stratum hold a third of the documents.
    docs += [(2000 + i, docs[4][1]) for i in range(150)] + [(5000, None), (5001, ""), (5002, " .,;"), (5003, vocab[0] + " " + " ".join(vocab) * 30)]
    items = [(i, " ".join(r.choice(vocab) for _ in range(r.choice([1, 5, 30])))) for i in range(17)] + [(90, None), (91, "..."), (92, "unknownterm"), (93, docs[4][1])]
    assert rows(ranked.rank_documents(*frames(spark, docs, items))) == brute(docs, items)


def test_odd_rows_and_empty_tables(spark):
    docs, items = [(1, "a b"), (1, "a b"), (None, "a b"), (2, "a a c"), (3, None)], [(7, "a"), (7, "a b"), (None, "c")]
    assert rows(ranked.rank_documents(*frames(spark, docs, items))) == brute(docs, items)
    assert rows(ranked.rank_documents(*frames(spark, [], items))) == [] == rows(ranked.rank_documents(*frames(spark, docs, [])))


def test_bounds_leave_strata_out(spark):
    """No document's score exceeds its block's bound, and far strata are not scored."""
    docs = [(i, "rare word here") for i in range(40)] + [(100 + i, "word " * 400 + "x%d" % i) for i in range(40)]
    docs_df, items_df = frames(spark, docs, [(1, "rare word")])
    index = ranked.build_index(docs_df)
    chunk = ranked._Chunk([r["terms"] for r in ranked._query_terms(items_df, "item_id").collect()])
    chunk.weigh(ranked._frequencies(index.blocks, chunk), index.documents)
    first = ranked._first_strata(index.blocks, chunk)
    assert min(first) == min(r["m"] for r in index.blocks.select("m").collect())
    assert rows(ranked.search(index, items_df)) == brute(docs, [(1, "rare word")])


def test_query_equals_sql_on_a_whole_table(spark):
    import duckdb

    from lexgraph.llm.queries import ORACLES, QUERIES

    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '/root/testdata/sf0.01/{name}.parquet'")
    want = con.execute(f"SELECT item_id, rank, doc_id, score FROM ({ORACLES['op11_ranked_search']})").fetchall()
    assert rows(QUERIES["op11_ranked_search"](spark, "/root/testdata/sf0.01")) == sorted(want, key=str) and len(want) == 400
