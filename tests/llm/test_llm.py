import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexgraph.llm import boosting, bpe, decontaminate, html, jaccard, license, linededup, lm, quality, suffix, warc
from lexgraph.llm.queries import word_bpe_path

WORD = re.compile(rb"[^\x20\x09-\x0d]+")
ODD = [(9001, None), (9002, ""), (9003, " \n\t "), (9004, "x"), (9005, "long " * 4000), (9006, "same text here"), (9006, "same text here")]


def docs(spark, rows):
    """Documents with extra columns whose names the operators also use."""
    return spark.createDataFrame([(i, t, "s%d" % (k % 9), 1, "x", 0) for k, (i, t) in enumerate(rows)], "doc_id long, text string, source string, key int, sid string, n_chars long").repartition(3)


def words(t):
    return WORD.findall((t or "").encode().lower())


def test_bpe_equals_the_library(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(word_bpe_path())
    r = random.Random(1)
    alpha = list("abcdethe '’.,!#0123 \n\t\x1c\x85\xa0​ßéÉİΣσKﬁ中🙂👍🏽\u0000")
    rows = [(i, "".join(r.choice(alpha) for _ in range(r.randint(0, 60)))) for i in range(300)] + [(900, "<|endoftext|>x<|startoftext|>"), (901, "'S 'LL"), (902, None)]
    for x in bpe.encode_documents(docs(spark, rows), word_bpe_path(), with_ids=True).collect():
        ids = t.encode(dict(rows)[x.doc_id] or "", add_special_tokens=False).ids
        assert x.ids == ids and x.n_tokens == len(ids)
        assert x.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert x.decoded_sha256 == hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert bpe.encode_documents(docs(spark, ODD), word_bpe_path()).count() == len(ODD)


def test_bpe_merges_words_in_use_once(monkeypatch):
    from tokenizers import Tokenizer

    t, made, merge = Tokenizer.from_file(word_bpe_path()), [], bpe.merge
    monkeypatch.setattr(bpe, "CACHE", 24)
    monkeypatch.setattr(bpe, "merge", lambda symbols, ranks: made.append("".join(symbols)) or merge(symbols, ranks))
    b = bpe.WordBPE(word_bpe_path())
    for k in range(40):
        text = f"often, {chr(97 + k % 26)}x{chr(98 + k % 7)}q again don't often \x1c{k}\x1foften"
        assert b.encode(text) == t.encode(text, add_special_tokens=False).ids
    assert made.count("often</w>") == made.count("again</w>") == 1 and len(b.cache) + len(b.older) <= 48


def test_quality_counts(spark):
    text = "a b c\na b c\n\n x##\na b c"
    counts, _ = quality.statistics(text)
    assert counts == [10, 12, 2, 2, 9]
    assert quality.statistics("")[0] == [0] * 5


def test_quality_keeps_clean_and_rejects_junk(spark):
    r = random.Random(2)
    vocab = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 8))) for _ in range(900)]
    good = [(i, " ".join(r.choice(vocab) for _ in range(120))) for i in range(80)]
    bad = [(i + 1000, " ".join(r.choice(vocab).upper() + "###" for _ in range(120))) for i in range(40)]
    labels = spark.createDataFrame([(i, int(i < 1000), 0) for i, _ in good + bad], "doc_id long, quality int, toxic int")
    got = {x.doc_id: x for x in quality.quality(docs(spark, good + bad + ODD), labels).collect()}
    assert all(got[i].kept for i, _ in good) and not any(got[i].kept for i, _ in bad)
    assert got[9001].base_failed and got[9005].base_failed
    assert quality.keep_good(docs(spark, good + bad), labels).count() == len(good)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert all(x.kept != x.base_failed for x in quality.quality(docs(spark, good), none).collect())


def test_trees_are_monotone():
    rng = np.random.default_rng(0)
    x = rng.random((600, 2))
    y = ((x[:, 0] < 0.5) ^ (rng.random(600) < 0.1)).astype(float)
    f = boosting.fit(x, y, np.array([-1, 0]))
    grid = np.linspace(0, 1, 200)
    for v in (0.1, 0.5, 0.9):
        assert (np.diff(f.raw(np.column_stack([grid, np.full(200, v)]))) <= 1e-12).all()
    assert ((f.score(x) > 0.5) == (x[:, 0] < 0.5)).mean() > 0.95


def test_verdicts_of_a_table_equal_walking_each_tree(spark):
    """kept and score of every document of a small table, by plain Python: statistics, base rule, and each tree walked node by node."""
    import math

    d = "/root/testdata/sf0.001"
    docs_, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    forest, threshold = quality.train(docs_, labels)
    assert len(forest.roots) > 10
    nodes = list(zip(forest.feature.tolist(), forest.threshold.tolist(), forest.left.tolist(), forest.right.tolist(), forest.value.tolist()))
    want = {}
    for doc_id, text in docs_.select("doc_id", "text").collect():
        (n, _, _, _, repeat), x = quality.statistics(text or "")
        raw = forest.base
        for at in forest.roots.tolist():
            while nodes[at][0] >= 0:
                f, cut, left, right, _ = nodes[at]
                at = left if x[f] <= cut else right
            raw += nodes[at][4]
        failed = n < 50 or 100 * repeat > 50 * n
        want[doc_id] = (failed, not failed and raw >= threshold - 1e-12, 1 / (1 + math.exp(-raw)))
    got = {r.doc_id: (r.base_failed, r.kept, r.score) for r in quality.quality(docs_, labels).collect()}
    assert {k: v[:2] for k, v in got.items()} == {k: v[:2] for k, v in want.items()}
    assert [got[k][2] for k in want] == pytest.approx([v[2] for v in want.values()])


def test_license_base_and_fuzzy(spark):
    rows = [(1, "Released under the MIT-License. under the mit license"), (2, "Licensd under the Apache Licence, Version 2.0"), (3, "cc by nc cc BY nc"), (4, "nothing to see"), *ODD]
    got = {x.doc_id: x for x in license.scan_licenses(docs(spark, rows)).collect()}
    assert (got[1].n_base, got[1].first_word, got[1].last_word, got[1].base_labels) == (2, 1, 5, "mit")
    assert got[2].base_labels == "" and got[2].labels == "apache-2" and 0 < got[2].score < 1
    assert (got[3].n_base, got[3].first_word, got[3].last_word) == (2, 0, 3)
    assert got[4].labels == "" and got[4].first_word is None and got[9001].n_words == 0


def test_license_spans_against_scanning_everything():
    """All spans, against the same best-first search over the whole line without seeds."""
    import regex

    r = random.Random(4)
    notice, per = "licensed under the gnu general public license", license.CHARS_PER_EDIT
    pattern = regex.compile(b"(?<![^ ])(?:%s){e<=%d}(?![^ ])" % (notice.encode(), len(notice) // per), regex.BESTMATCH)

    def whole(line, lo, hi):
        m = license._match(pattern, line, lo, hi)
        return [] if m is None else [m, *whole(line, lo, m[1]), *whole(line, m[2], hi)]

    n = 0
    for _ in range(150):
        text = []
        for _ in range(r.randint(1, 4)):
            w = list(notice)
            for _ in range(r.choice([0, 1, 2, 4, 6])):
                w[r.randrange(len(w))] = r.choice(["a", "", "bc", " "])
            text += ["".join(w), *r.choices(["foo", "bar", "the", "licensed", "public license"], k=r.randint(0, 4))]
        line = b" " + b" ".join(" ".join(text).encode().split()) + b" "
        want = sorted((line.count(b" ", 0, a + (line[a : a + 1] == b" ")) - 1, e) for e, a, b in whole(line, 0, len(line)))
        got = sorted((s[1], s[3]) for s in license.scan(" ".join(text), ((notice, "gpl"),), per)[2])
        assert got == want, (text, got, want)
        n += len(got)
    assert n > 150
    both = "licensd under the gnu general publc license licensed under the gnu general public license"
    assert [s[1:4] for s in sorted(license.scan(both, ((notice, "gpl"),), per)[2])] == [(0, 7, 2), (7, 14, 0)]


@pytest.mark.parametrize("notice", license.NOTICES)
def test_each_notice_alone_has_its_own_label(notice):
    """As it is, and with a slip in a word that tells nothing."""
    for text in (notice, f"see here {notice} and more"):
        spans = license.scan(text)[2]
        assert {s[0] for s in spans} == {license.NOTICES[notice]} and spans[0][3] == 0, spans
    plain = [w for w in notice.split() if len(w) > 6 and w not in license.TELLING]
    if plain and len(notice) >= 20:
        spans = license.scan(notice.replace(plain[0], plain[0][:3] + plain[0][4:], 1))[2]
        assert {s[0] for s in spans} == {license.NOTICES[notice]} and spans[0][3] == 1, spans


def test_false_labels_are_gone():
    labels = lambda t: sorted({s[0] for s in license.scan(t)[2]})
    assert labels("licensed under the MIT license") == ["mit"] and labels("Licensed under the ISC license") == ["isc"]
    assert labels("licensed under the city license") == [] == labels("the band released under the ape music")
    assert labels("licensed under cc by nc 4 0") == ["cc-by-nc-4.0"] and labels("licensed under the gplv3") == ["gpl-3"]
    assert labels("licensed under cc by sa 3.0, and licensed under cc by nc") == ["cc-by-nc", "cc-by-sa-3.0"]


def test_labels_of_a_table_equal_scanning_everything():
    """All texts of a small table, and notices with slips, against all notices over whole lines without seeds, by a plain rule for overlaps."""
    import duckdb
    import regex

    r = random.Random(12)
    texts = [t for (t,) in duckdb.sql("SELECT text FROM '/root/testdata/sf0.001/documents.parquet'").fetchall()]
    texts = [t for t in texts if len(t) < 1500][:60]
    for _ in range(60):
        parts = []
        for _ in range(r.randint(1, 3)):
            w = list(r.choice(list(license.NOTICES)))
            for _ in range(r.choice([0, 0, 1, 2, 3])):
                w[r.randrange(len(w))] = r.choice(["", "x", " ", "ab"])
            parts += ["".join(w), *r.choices(["foo", "the", "license", "under cc by", "version 2"], k=r.randint(0, 2))]
        texts.append(" ".join(parts))
    plans = []
    for notice, label in license.NOTICES.items():
        k = len(notice) // license.CHARS_PER_EDIT
        plans.append((notice, label, regex.compile(b"(?<![^ ])(?:%s){e<=%d}(?![^ ])" % (regex.escape(notice.encode()), k), regex.BESTMATCH)))
    near = lambda a, b: a == b or (len(b) > 5 and not b.isdigit() and len(a) in (len(b) - 1, len(b), len(b) + 1) and bool(regex.fullmatch(b"(?:%s){e<=1}" % b, a)))
    n = 0
    for text in texts:
        line = b" " + b" ".join(w for w in re.split(rb"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.encode().lower() if text.isascii() else b"".join(bytes([c + 32]) if 65 <= c <= 90 else bytes([c]) for c in text.encode())) if w) + b" "
        finds = []
        for notice, label, pattern in plans:
            def whole(lo, hi):
                m = license._match(pattern, line, lo, hi)
                return [] if m is None else [m, *whole(lo, m[1]), *whole(m[2], hi)]
            for e, a, b in whole(0, len(line)):
                words, ok = line[a:b].split(), True
                for t in (w.encode() for w in notice.split() if w in license.TELLING or w.isdigit()):
                    at = next((i for i, w in enumerate(words) if near(w, t)), None)
                    ok = ok and at is not None
                    words = words[at + 1 :] if at is not None else []
                if ok:
                    finds.append((e, -len(notice), a, b, label))
        kept = []
        for f in sorted(finds):
            if all(f[3] <= g[2] + 1 or g[3] <= f[2] + 1 for g in kept):
                kept.append(f)
        want = sorted((f[4], f[0]) for f in kept)
        got = sorted((s[0], s[3]) for s in license.scan(text)[2])
        assert got == want, (text, got, want)
        n += len(want)
    assert n > 60


def sql_rows(tables, sql):
    import duckdb

    con = duckdb.connect()
    for name in tables:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '/root/testdata/sf0.01/{name}.parquet'")
    return sorted(con.execute(sql).fetchall())


def test_license_base_columns_equal_sql(spark):
    from lexgraph.llm.queries import QUERIES

    want = sql_rows(["documents"], r"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
p AS (SELECT * FROM (VALUES (['under', 'the', 'mit', 'license'], 'mit'), (['apache', 'license', 'version', '2'], 'apache-2'), (['cc', 'by', 'nc'], 'cc-by-nc')) v(ws, label)),
t AS (SELECT doc_id, w, unnest(range(len(w))) AS i FROM d),
f AS (SELECT doc_id, i, label FROM t JOIN p ON w[i + 1 : i + len(ws)] = ws)
SELECT doc_id, len(w), count(i), min(i), max(i), coalesce(string_agg(DISTINCT label, ',' ORDER BY label), '') FROM d LEFT JOIN f USING (doc_id) GROUP BY 1, 2""")
    got = QUERIES["op4_license_scans"](spark, "/root/testdata/sf0.01").select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")
    assert sorted(map(tuple, got.collect())) == want and any(x[2] for x in want)


def test_quality_base_columns_equal_sql(spark):
    from lexgraph.llm.queries import QUERIES

    want = sql_rows(["documents"], r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d),
dup AS (SELECT doc_id, sum(n - 1) AS n FROM (SELECT doc_id, line, count(*) AS n FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY 1, 2) GROUP BY 1),
g AS (SELECT doc_id, i, w[i : i + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
often AS (SELECT doc_id, g FROM g GROUP BY 1, 2 HAVING count(*) > 1),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM g JOIN often USING (doc_id, g)) GROUP BY 1)
SELECT doc_id, len(w), length(array_to_string(w, '')), length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')), CAST(coalesce(dup.n, 0) AS BIGINT), coalesce(rep.n, 0),
       len(w) < 50 OR 100 * coalesce(rep.n, 0) > 50 * len(w)
FROM d LEFT JOIN dup USING (doc_id) LEFT JOIN rep USING (doc_id)""")
    got = QUERIES["op2_quality_rules"](spark, "/root/testdata/sf0.01").select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert sorted(map(tuple, got.collect())) == want and any(x[5] for x in want)


def test_warc_round_trip_and_small_splits(spark, monkeypatch):
    rows = [(i, f"http://x/{i} ü\n", f"<p>é{i % 5}</p>" * 30 if i % 3 else ("a" if i % 2 else None)) for i in range(90)] + [(3, None, "<p>é1</p>" * 30)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, first int").repartition(3)
    first = {}
    for i, _, h in rows:
        b = (h or "").encode()
        if len(b) >= 100:
            first[b] = min(i, first.get(b, i))
    want = sorted((i, len((h or "").encode()), hashlib.sha256((h or "").encode()).hexdigest(), f if (f := first.get((h or "").encode(), i)) < i else None) for i, _, h in rows) if all(isinstance(i, int) for i, *_ in rows) else None
    read = warc.read_archives
    for split in (41, warc.SPLIT):
        monkeypatch.setattr(warc, "read_archives", lambda f, d, s=split: read(f, d, s))
        got = warc.archive_pages(df).collect()
        assert sorted((x.page_id, x.payload_bytes, x.payload_digest, x.refers_to) for x in got if x.page_id != 3) == [w for w in want if w[0] != 3]
        assert all((x.record_type == "revisit") == (x.refers_to is not None) for x in got) and len(got) == len(rows)
    assert warc.archive_pages(df.where("false")).count() == 0
    odd = spark.createDataFrame([(None, "u", "<p>x</p>" * 40, 1), (None, None, None, 1), (7, "u", "<p>x</p>" * 40, 1), (8, "u", "<p>x</p>" * 40, 1), (9, "v", "y" * 3_000_000, 1)], "page_id long, url string, html string, n int")
    got = sorted(((x.page_id, x.payload_bytes, x.record_type, x.refers_to) for x in warc.archive_pages(odd).collect()), key=str)
    assert got == sorted([(None, 320, "response", None), (None, 0, "response", None), (7, 320, "response", None), (8, 320, "revisit", 7), (9, 3_000_000, "response", None)], key=str)


def test_html_extraction(spark):
    rng = random.Random(99)
    right = n = 0
    model = html.trained()
    for _ in range(150):
        page, labels = html.training_page(rng)
        blocks = html.leaf_blocks(page)
        if len(blocks) == len(labels):
            right += html.main_texts([page], model)[0] == "\n".join(b[0] for b, y in zip(blocks, labels) if y)
            n += 1
    assert right >= 0.8 * n
    page = '<html><head><title>T</title></head><body><nav><a href="/">Home</a></nav><article><h1>A&amp;B</h1><p>One   two &lt;x&gt;</p><script>no</script></article><footer>&copy; us</footer></body></html>'
    df = spark.createDataFrame([(1, "u", page, 5), (2, None, None, 5), (3, "v", "", 5)], "page_id long, url string, html string, n_chars int")
    got = {x.page_id: (x.text, x.n_chars) for x in html.extract(df).collect()}
    assert got == {1: ("A&B\nOne two <x>", 15), 2: ("", 0), 3: ("", 0)}


def test_lstm_gradients():
    rng = np.random.default_rng(1)
    m = html.BiLSTM()
    m.p = {k: v.astype(np.float64) for k, v in m.p.items()}
    paths = rng.normal(size=(3, 2 * html.PATH_DIM)) / 9
    at = np.array([[0, 1, 2, 0], [2, 1, 0, 0]])
    dense = rng.normal(size=(2, 4, html.WORD_DIM + html.NUM_DIM))
    y, mask = np.array([[1, 0, 1, 0], [0, 1, 0, 0]]), np.array([[1, 1, 1, 1], [1, 1, 0, 0]])

    def loss():
        total = 0
        for k, n in enumerate(mask.sum(1)):
            s = m.scores(paths, at[k, :n], dense[k, :n, : html.WORD_DIM], dense[k, :n, html.WORD_DIM :], np.array([n]))
            total -= np.log(np.where(y[k, :n] == 1, s, 1 - s)).sum()
        return total / mask.sum()

    g = m._gradients(paths, at, dense, y, mask)
    for k in ("Wf", "Ub", "o"):
        at_ = tuple(rng.integers(0, s) for s in m.p[k].shape)
        old = m.p[k][at_]
        m.p[k][at_] = old + 1e-2
        up = loss()
        m.p[k][at_] = old - 1e-2
        down = loss()
        m.p[k][at_] = old
        assert (up - down) / 2e-2 == pytest.approx(g[k][at_], rel=0.05, abs=1e-4)


def jaccard_brute(rows, width=4, num=85):
    sets = {i: frozenset(zip(*(w[k:] for k in range(width)))) if len(w) >= width else frozenset([tuple(w)] if w else []) for i, w in ((i, words(t)) for i, t in rows)}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize("boundary", [0, 12, 256])
def test_jaccard_against_all_pairs(spark, monkeypatch, boundary):
    r = random.Random(5)
    vocab = [f"w{i}" for i in range(300)]
    rows = []
    for _ in range(25):
        base = [r.choice(vocab) for _ in range(r.choice([1, 2, 3, 4, 5, 9, 20, 60]))]
        for _ in range(r.choice([1, 3, 12])):
            w = list(base)
            for _ in range(r.choice([0, 0, 1, 2])):
                w[r.randrange(len(w))] = r.choice(vocab)
            rows.append((len(rows), " ".join(w)))
    rows += [r_ for r_ in ODD if r_[0] != 9006]
    monkeypatch.setattr(jaccard, "cost_boundary", lambda *_: boundary)
    monkeypatch.setattr(jaccard, "LEADERS", 4)
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in jaccard.jaccard_components(docs(spark, rows)).collect()}
    assert got == jaccard_brute(rows)


def test_jaccard_repeated_and_nameless_rows(spark):
    got = sorted(map(tuple, jaccard.jaccard_components(docs(spark, [(7, "a b c d e"), (7, "a b c d e"), (3, "A b c d e"), (None, "a b c d e")])).collect()), key=str)
    assert got == [(3, 2, 3), (7, 2, 3), (7, 2, 3), (None, 2, None)]


def test_jaccard_few_links_are_joined_by_one_task(spark, monkeypatch):
    """A chain of near copies, which is no star, needs no rounds over the cluster."""
    rows = [(k, " ".join(f"w{i}" for i in range(k, k + 60))) for k in range(0, 12, 2)] + [(50, "another text with other words")]
    monkeypatch.setattr("lexgraph.operators.components._large_star", None)
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in jaccard.jaccard_components(docs(spark, rows)).collect()}
    assert got == jaccard_brute(rows) and len({c for _, c in got.values()}) == 2


def suffix_brute(rows, n=50):
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        for p in range(len(b) - n + 1):
            first[b[p : p + n]] = min(i, first.get(b[p : p + n], i))
    out = {}
    for i, t in rows:
        b = (t or "").encode()
        m = bytearray(len(b))
        for p in range(len(b) - n + 1):
            if first[b[p : p + n]] < i:
                m[p : p + n] = b"\1" * n
        out[i] = (len(b), sum(m), bytes(x for x, f in zip(b, m) if not f))
    return out


@pytest.mark.parametrize("shard", [700, 2 << 20])
def test_suffix_dedup_against_brute_force(spark, monkeypatch, shard):
    r = random.Random(3)
    parts = ["".join(r.choice("abcdé ") for _ in range(r.choice([30, 49, 50, 51, 80, 400]))) for _ in range(12)]
    rows = [(i, "".join(r.choice(parts) if r.random() < 0.5 else "".join(r.choice("abcdef") for _ in range(r.choice([3, 20, 60]))) for _ in range(r.randint(0, 8)))) for i in range(80)]
    rows += [(200, "a" * 900), (201, "a" * 70 + "b"), (202, None), (203, ""), (204, "xyz" * 300), (205, "yzx" * 30)]
    monkeypatch.setattr(suffix, "SHARD", shard)
    got = {x.doc_id: (x.n_bytes, x.n_removed, bytes(x.kept)) for x in suffix.dedup_substrings(docs(spark, rows)).collect()}
    assert got == suffix_brute(rows)


def test_suffix_dedup_deals_out_a_hot_minimiser(spark, monkeypatch):
    r = random.Random(5)
    noise = lambda n: "".join(r.choice("abcdefghij") for _ in range(n))
    line, long_line = "The line that very many documents hold.", "A longer line, of over fifty bytes, that very many documents hold, too."
    rows = [(i, noise(60) + line + noise(3 if i % 5 else 0) + noise(60) + (long_line if i % 2 else "") + noise(30)) for i in range(300)]
    rows += [(300 + i, rows[i][1]) for i in range(10)] + [(400, line * 3), (401, None), (5, "x" + long_line), (None, rows[7][1])]
    hot = 100

    class Watched(suffix.Judged):
        def __init__(self, rows, length):
            super().__init__(rows, length)
            if np.unique(self.key, return_counts=True)[1].max() > hot:
                raise AssertionError("one task judges all stretches of a hot minimiser")

    monkeypatch.setattr(suffix, "MOST", hot, raising=False)
    monkeypatch.setattr(suffix, "Judged", Watched)
    once = [x for x in rows if x[0] is not None and x != (5, "x" + long_line)]
    got = {x.doc_id: (x.n_bytes, x.n_removed, bytes(x.kept)) for x in suffix.dedup_substrings(docs(spark, once)).collect()}
    assert got == suffix_brute(once)
    named = [x for x in rows if x[0] is not None]
    got = sorted((x.doc_id, x.n_bytes, x.n_removed) for x in suffix.dedup_substrings(docs(spark, rows)).collect() if x.doc_id is not None)
    first = suffix_brute(named + [(1000 + k, t) for k, (i, t) in enumerate(named) if i == 5])
    assert len(got) == len(named) and [x for x in got if x[0] != 5] == sorted((i, n, m) for i, (n, m, _) in first.items() if i < 1000 and i != 5)


def test_suffix_array_and_prefixes():
    for text in (b"banana", b"aaaaaaaaaaaaaaaaaaaa", b"abab\0abab\0\0", bytes(random.Random(1).choices(range(3), k=3000))):
        t = np.frombuffer(text, np.uint8)
        order, word = suffix.suffix_array(t, 50)
        assert order.tolist() == sorted(range(len(text)), key=lambda i: text[i:])
        if 0 not in text:
            got = suffix.common_prefixes(order, word, 50)
            for k in range(1, len(text)):
                a, b = text[order[k - 1] :], text[order[k] :]
                n = next((i for i in range(min(len(a), len(b), 50)) if a[i] != b[i]), min(len(a), len(b), 50))
                assert got[k] == n


def decontaminate_brute(rows, items):
    cut = lambda t: [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower()) if w]
    out = {}
    for i, t in rows:
        w = cut(t)
        sh = list(zip(*(w[k:] for k in range(5))))
        for j, u in items:
            v = cut(u)
            m = Counter(zip(*(v[k:] for k in range(5))))
            for s in range(max(len(w) - len(v), 0) + 1) if m else ():
                c = Counter(sh[s : s + len(v) - 4])
                same = sum((c & m).values())
                if same and same >= 0.8 * (sum(c.values()) + sum(m.values()) - same):
                    out[i, j] = max(out.get((i, j), 0), same / (sum(c.values()) + sum(m.values()) - same))
    return out


def test_decontamination_against_all_windows(spark):
    r = random.Random(6)
    vocab = [f"w{i}" for i in range(500)]
    items = [(k, " ".join(r.choice(vocab) for _ in range(n))) for k, n in enumerate([5, 14, 14, 30, 59, 4])] + [(20, None), (21, "w1 " * 20)]
    rows = []
    for k in range(120):
        w = [r.choice(vocab) for _ in range(r.choice([0, 3, 40, 200]))]
        if k % 2:
            v = r.choice([x for x in items if x[1]])[1].split()
            if r.random() < 0.4:
                v[r.choice([0, -1, len(v) // 2])] = "edit"
            if r.random() < 0.2:
                v = v[1:]
            w[r.randint(0, len(w)) : 0] = v
        rows.append((k, " ".join(w).upper()))
    rows += ODD[:5]
    b = spark.createDataFrame([(*x, 1) for x in items], "item_id long, text string, key int")
    got = {(x.doc_id, x.item_id): x.similarity for x in decontaminate.decontaminate(docs(spark, rows), b).collect()}
    assert got == pytest.approx(decontaminate_brute(rows, items)) and len(got) > 20


def test_decontamination_sends_no_list_through_the_driver(spark):
    prints = spark.range(3).selectExpr("id AS item_id", "id AS wkey", "id AS f0", "id AS f1")
    near = decontaminate.similar_prints(prints.drop("item_id"), prints.drop("wkey"), 1)
    assert near.count() == 9 and "Broadcast" not in near._jdf.queryExecution().executedPlan().toString()


def test_decontamination_recall_near_the_threshold(spark):
    """Windows at a similarity of 0.80 to 0.85, some with a shingle repeated many times: at least 99 in 100 are found."""
    r = random.Random(16)
    items, rows, sims = [], [], {}
    while len(rows) < 400:
        k, n = len(rows), r.choice([60, 90, 140])
        v = [f"i{k}x{j}" for j in range(n)]
        w = list(v)
        cut = r.randint(n // 12, n // 7)
        w[n - cut :] = [f"e{k}"] * cut if r.random() < 0.4 else [f"e{k}x{j}" for j in range(cut)]
        a, b = (Counter(zip(*(t[i:] for i in range(5)))) for t in (v, w))
        same = sum((a & b).values())
        s = same / (sum(a.values()) + sum(b.values()) - same)
        if 0.8 <= s <= 0.85:
            items.append((k, " ".join(v)))
            rows.append((k, " ".join(w)))
            sims[k] = s
    found = decontaminate.decontaminate(docs(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {x.doc_id: x.similarity for x in found} == pytest.approx({x.doc_id: sims[x.doc_id] for x in found})
    print("recall at 0.80 to 0.85:", len(found) / len(rows))
    assert len(found) >= 0.99 * len(rows) and all(x.doc_id == x.item_id for x in found)


def test_lm_scores_against_counting(spark):
    r = random.Random(8)
    rows = [(i, " ".join(r.choice("abcdefghij") * r.randint(1, 2) for _ in range(r.randint(0, 30)))) for i in range(60)] + ODD + [(None, "a b"), (9004, "a b")]
    ws = [(i, words(t)) for i, t in rows]
    one, two = Counter(w for _, x in ws for w in x), Counter(p for _, x in ws for p in zip(x, x[1:]))
    total = sum(one.values())
    want = sorted(((i, len(w), 0, round(sum(float(np.log(two[a, b] / one[a])) for a, b in zip(w, w[1:])) + (float(np.log(one[w[0]] / total)) if w else 0.0), 6)) for i, w in ws), key=str)
    got = lm.score_documents(docs(spark, rows)).collect()
    assert sorted(((x.doc_id, x.n_words, x.n_backoff, round(x.log_score, 6) + 0.0) for x in got), key=str) == want
    assert all((x.perplexity is None) == (x.n_words == 0) for x in got)


@pytest.mark.parametrize("least,broadcast", [(2, 200_000), (2, 3), (3, 0)])
def test_lm_backs_off_where_pairs_are_rare(spark, monkeypatch, least, broadcast):
    monkeypatch.setattr(lm, "WORDS_BROADCAST", broadcast)
    r = random.Random(10)
    rows = [(i, " ".join(r.choice("abcdefghijklmnopq") * r.randint(1, 3) for _ in range(r.randint(0, 12)))) for i in range(50)] + ODD + [(None, "a b"), (9004, "a b"), (9005, "long " * 4000)]
    ws = [(i, words(t)) for i, t in rows]
    one, two = Counter(w for _, x in ws for w in x), Counter(p for _, x in ws for p in zip(x, x[1:]))
    total = sum(one.values())
    want = []
    for i, w in ws:
        lost = [p for p in zip(w, w[1:]) if two[p] < least]
        score = sum(float(np.log(two[a, b] / one[a]) if two[a, b] >= least else np.log(0.4 * one[b] / total)) for a, b in zip(w, w[1:])) + (float(np.log(one[w[0]] / total)) if w else 0.0)
        want.append((i, len(w), len(lost), round(score, 5)))
    got = [(x.doc_id, x.n_words, x.n_backoff, round(x.log_score, 5) + 0.0) for x in lm.score_documents(docs(spark, rows), least=least).collect()]
    assert sorted(got, key=str) == sorted(want, key=str) and sum(x[2] for x in want) > 50


def test_lm_keys_give_the_second_word_back(spark):
    ends = [0, -1, 1, -(1 << 63), (1 << 63) - 1, 1234567890123456789]
    rows = spark.createDataFrame([(v, w) for v in ends for w in ends], "v long, w long").withColumn("key", lm._turned("v").bitwiseXOR(F.col("w")))
    assert all(x.w == x.back for x in rows.withColumn("back", lm._turned("v").bitwiseXOR(F.col("key"))).collect())
    assert len({x.key for x in rows.where("v = 1234567890123456789 or w = 0").collect()}) > 6


def test_lm_rows_are_dealt_once_for_counting_and_joining(spark, monkeypatch):
    finals, write = [], lm.write_table

    def seen(df, label):
        if label == "lm-sums":
            df.collect()
            finals.append(df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].splitlines())
        return write(df, label)

    monkeypatch.setattr(lm, "write_table", seen)
    got = lm.score_documents(docs(spark, [(1, "a b a b c"), (2, "b c d"), (3, "a b")]), slices=2, least=2).collect()
    dealt = [[line for line in plan if "REPARTITION_BY_COL" in line] for plan in finals]
    assert [(len(x), sum("ReusedExchange" in line for line in x)) for x in dealt] == [(2, 1)] * 2
    assert sorted((x.doc_id, x.n_words, x.n_backoff) for x in got) == [(1, 5, 1), (2, 3, 1), (3, 2, 0)]


def test_lm_query_equals_sql(spark):
    import duckdb

    from lexgraph.llm.queries import ORACLES, QUERIES

    con = duckdb.connect()
    con.execute("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.001/documents.parquet'")
    cols = ["doc_id", "n_words", "n_backoff", "log_score", "perplexity"]
    want = sorted(con.execute(f"SELECT {', '.join(cols)} FROM ({ORACLES['op8_lm_scoring']})").fetchall())
    assert sorted(map(tuple, QUERIES["op8_lm_scoring"](spark, "/root/testdata/sf0.001").select(*cols).collect())) == want and sum(x[2] for x in want) > 1000


def test_lm_scores_under_another_corpus(spark):
    r = random.Random(9)
    text = lambda: " ".join(r.choice("abcdefghijkl") for _ in range(r.randint(0, 20)))
    corpus, rows = [(i, text().replace("l", "k")) for i in range(40)], [(i, text()) for i in range(40)] + ODD
    one, two = (Counter(g for _, t in corpus for g in f(words(t))) for f in (lambda w: w, lambda w: zip(w, w[1:])))
    total = sum(one.values())
    counts = lm.ngram_counts(docs(spark, corpus))
    for x in lm.score_with(docs(spark, rows), counts, total).collect():
        w = words(dict(rows)[x.doc_id])
        c = lambda v: max(one[v], 1)
        lost = [p for p in zip(w, w[1:]) if not two[p]]
        score = sum(np.log(two[a, b] / one[a]) if two[a, b] else np.log(0.4 * c(b) / total) for a, b in zip(w, w[1:])) + (np.log(c(w[0]) / total) if w else 0.0)
        assert (x.n_words, x.n_backoff) == (len(w), len(lost)) and x.log_score == pytest.approx(score)


def line_brute(rows, min_sites=8):
    sites = defaultdict(set)
    for _, t, site in rows:
        for line in (t or "").split("\n"):
            if site is not None and line.strip(" \t\n\v\f\r"):
                sites[line].add(site)
    gone = {x for x, s in sites.items() if len(s) >= min_sites}
    return sorted(((i, 0 if t is None else len(t.split("\n")), sum(x in gone for x in (t or "").split("\n")), "\n".join(x for x in (t or "").split("\n") if x not in gone)) for i, t, _ in rows), key=str)


def test_line_dedup_against_brute_force(spark):
    """Lines on 6 to 10 sites, so that exact counts decide too; null sites and ids, repeated rows, very many lines."""
    r = random.Random(12)
    rows = []
    for k in range(6, 11):
        rows += [(100 * k + i, f"own {k} {i}\nspread over {k}\n\nspread over {k}", f"s{i}") for i in range(k)]
    rows += [(1, "spread over 8", "s1"), (2, None, "s1"), (3, "", None), (4, "own\nspread over 9", None), (None, "own\nspread over 9", "s3"), (None, "other\nspread over 9\n", "s3")]
    rows += [(900, "own 9 0\nspread over 9", "s0")] * 2 + [(901, "\n".join(r.choice(["spread over 9", "x", "", "own"]) for _ in range(3000)), "s0")]
    df = spark.createDataFrame([(*x, 1, 2) for x in rows], "doc_id long, text string, source string, rid int, lines int").repartition(3)
    assert sorted(map(tuple, linededup.dedup_lines(df).collect()), key=str) == line_brute(rows)
    cleaned = linededup.clean_documents(df)
    assert cleaned.columns == df.columns and cleaned.count() == len(rows)


def test_cleaning_spares_texts_without_words_of_their_own(spark):
    menu = "Home About Contact Products Support Careers and much more of the menu"
    rows = [(i, f"{menu}\nown words {i}\n \n{menu}") for i in range(9)] + [(100, f"{menu}\n \n{menu}"), (101, menu), (102, None)]
    cleaned = {x.doc_id: x for x in linededup.clean_documents(docs(spark, rows)).collect()}
    for i in range(9):
        assert cleaned[i].text == f"own words {i}\n " and cleaned[i].n_chars == len(cleaned[i].text)
    assert all(cleaned[i].text == t for i, t in rows[9:])


def test_line_dedup_query_equals_sql(spark, tmp_path):
    import duckdb
    from lexgraph.llm.queries import ORACLES, QUERIES

    menu = "Home About Contact Products Support"
    rows = [(i, f"{menu}\nown {i}") for i in range(20)] + [(i, f"{menu}\nand much longer text of the page's own, number {i}") for i in range(20, 30)] + [(40, menu), (41, f"{menu}\n\t")]
    docs(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = QUERIES["op10_line_dedup"](spark, str(tmp_path)).select("doc_id", "n_lines", "n_removed", "kept_sha256").collect()
    assert sorted(map(tuple, got)) == sorted(con.execute(ORACLES["op10_line_dedup"]).fetchall())
    assert sum(x.n_removed for x in got) == 32


def test_html_nulls_and_repeated_rows(spark):
    page = "<main><p>Some text of its own stands here, and it is long enough to be read.</p></main>"
    df = spark.createDataFrame([(1, None, page, "x", 1), (1, None, page, "x", 1), (None, "u", page, None, 2), (2, "u", "<p>" + "word " * 50_000, "x", 3)], "page_id long, url string, html string, text string, n_chars int")
    got = html.extract(df).collect()
    text = "Some text of its own stands here, and it is long enough to be read."
    assert sorted((str(x.page_id), x.text) for x in got if x.page_id != 2) == [("1", text), ("1", text), ("None", text)]
    assert [x.n_chars for x in got if x.page_id == 2] == [50_000 * 5 - 1]


def test_odd_rows_of_the_other_operators(spark):
    """Null and repeated ids, null, empty and very long texts."""
    rows = ODD + [(None, "under the mit license"), (None, "under the mit license"), (9007, "licensed under the mit license " * 3000)]
    df = docs(spark, rows)
    got = license.scan_licenses(df).collect()
    assert len(got) == len(rows) and sum(x.n_base for x in got) == 3002
    assert [len(x.spans) >= 3000 for x in got if x.doc_id == 9007] == [True]
    assert bpe.encode_documents(df, word_bpe_path()).count() == len(rows)
    assert suffix.dedup_substrings(df).count() == len(rows)
    labels = spark.createDataFrame([(9004, 1, 0), (9004, 0, 0), (None, 1, 0), (9005, None, None)], "doc_id long, quality int, toxic int")
    assert quality.quality(df, labels).count() == len(rows)


def test_empty_tables(spark):
    empty = docs(spark, [(1, "x")]).where("false")
    b = spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    pages = spark.createDataFrame([], "page_id long, url string, html string, text string")
    assert quality.keep_good(empty, none).count() == 0 and linededup.clean_documents(empty).count() == 0
    assert decontaminate.decontaminate(docs(spark, ODD), b.where("false")).count() == 0
    assert lm.score_with(empty, lm.ngram_counts(empty), 0).count() == 0
    for df in (html.extract(pages), warc.archive_pages(pages), quality.quality(empty, none), bpe.encode_documents(empty, word_bpe_path()), license.scan_licenses(empty), jaccard.jaccard_components(empty), suffix.dedup_substrings(empty), lm.score_documents(empty), linededup.dedup_lines(empty), decontaminate.decontaminate(empty, b)):
        assert df.count() == 0
