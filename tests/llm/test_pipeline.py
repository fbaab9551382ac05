"""The whole pipeline against a plain Python version of its five stages."""

import hashlib
import random
from collections import defaultdict

import corpus_pipeline
from lexgraph.llm.queries import word_bpe_path
from lexgraph.session import write_table
from test_llm import decontaminate_brute, jaccard_brute, words

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def fixture_rows():
    r = random.Random(11)
    vocab = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 8))) for _ in range(900)]
    prose = lambda n: " ".join(r.choice(vocab) for _ in range(n))
    items = [(k, prose(n)) for k, n in enumerate([12, 30, 45])]
    good = [prose(60) + "\nSubscribe now\n" + prose(60) for _ in range(20)] + [prose(150) for _ in range(30)]
    good += [" ".join("edit" if k == 70 else w for k, w in enumerate(t.split(" "))) for t in good[20:26]] + good[30:33]
    good += [prose(40) + " " + items[k % 3][1] + " " + prose(40) for k in range(6)]
    junk = [" ".join(r.choice(vocab).upper() + "###" for _ in range(120)) for _ in range(30)]
    odd = [None, "", " \n ", "too few words", "word " * 3000]
    texts = [(t, 1) for t in good] + [(t, 0) for t in junk] + [(t, None) for t in odd]
    r.shuffle(texts)
    return [(i, t, "en", f"site{i % 11}", len(t or "")) for i, (t, _) in enumerate(texts)], [(i, q, 0) for i, (_, q) in enumerate(texts) if q is not None], items


def brute(rows, labels, items):
    """Rows labelled good (they are far from junk by design) that pass the base rules, then stages 2 to 5."""
    good = {i for i, q, _ in labels if q}
    rows = [x for x in rows if x[0] in good and len(words(x[1])) >= 50]
    sites = defaultdict(set)
    for _, t, _, site, _ in rows:
        for line in t.split("\n"):
            sites[line].add(site)
    left = []
    for i, t, *_ in rows:
        own = [x for x in t.split("\n") if not words(x) or len(sites[x]) < 8]
        left.append((i, "\n".join(own) if any(map(words, own)) else t))
    found = jaccard_brute(left, 5, 80)
    left = [x for x in left if found[x[0]][1] == x[0]]
    dirty = {i for i, _ in decontaminate_brute(left, items)}
    return [x for x in left if x[0] not in dirty], len(rows)


def test_pipeline_against_plain_python(spark, tmp_path):
    from tokenizers import Tokenizer

    rows, labels, items = fixture_rows()
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    want, passed = brute(rows, labels, items)
    assert passed == 65 and len(want) == 50
    t = Tokenizer.from_file(word_bpe_path())
    expected = {}
    for i, text in want:
        ids = t.encode(text, add_special_tokens=False).ids
        expected[i] = (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest())
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert len(got) == len(expected)
    assert {x.doc_id: (x.n_tokens, x.ids_sha256, x.decoded_sha256) for x in got} == expected


def test_stages_keep_the_columns_of_documents(spark):
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "jaccard_join", "decontamination", "encoding"]


def test_stages_with_odd_rows(spark, tmp_path):
    """Null and repeated ids, null, empty and long texts, clashing extra columns; and no rows at all."""
    r = random.Random(7)
    vocab = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 8))) for _ in range(900)]
    prose = lambda n=90: " ".join(r.choice(vocab) for _ in range(n))
    twin, item = prose(), prose(30)
    rows = [(i, prose()) for i in range(20)] + [(30, twin), (31, twin), (31, twin), (None, twin), (None, prose()), (40, prose(40) + " " + item + " " + prose(40)), (41, None), (42, ""), (43, prose(20000)), (44, prose()), (44, twin + " end")]
    schema = "doc_id long, text string, lang string, source string, n_chars long, rid int, key string, sid int, row int, take int"
    df = spark.createDataFrame([(i, t, "en", None if k % 3 else "s", len(t or ""), 1, "k", 2, 3, 4) for k, (i, t) in enumerate(rows)], schema).repartition(3)
    spark.createDataFrame([(i, 1, 0) for i in range(20)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, seen = df, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = write_table(stage(spark, docs, str(tmp_path)), name)
        assert docs.columns == df.columns
        seen[name] = sorted((x.doc_id for x in docs.collect()), key=str)
    assert seen["quality_rules"] == seen["line_dedup"] == sorted([*range(20), 30, 31, 31, None, None, 40, 43, 44, 44], key=str)
    # 44 shares its id with a near copy of 30, so both its rows go.
    assert seen["jaccard_join"] == sorted([*range(20), 30, None, None, 40, 43], key=str)
    assert seen["decontamination"] == sorted([*range(20), 30, None, None, 43], key=str)
    assert corpus_pipeline.encoding(spark, docs, str(tmp_path)).count() == 24
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, df.where("false"), str(tmp_path)).count() == 0
