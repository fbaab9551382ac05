"""Token files against the tokenizers library, Re-Pair round trips, and reads of parts of a file."""

import io
import random
import zlib

import numpy as np
import pytest
from pyarrow import fs

from lexgraph.llm import tokenfile
from lexgraph.llm.queries import word_bpe_path


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(word_bpe_path())
    t.no_padding()
    t.no_truncation()
    return t


def odd_texts(n):
    r = random.Random(5)
    alpha = list("abcdethe '’.,!?#0123 \n\t\x1c\x85\xa0​ßéÉİΣσKﬁ×÷中🙂👍🏽\u0000́") + ["don't", "it's,", "<|endoftext|>", "É.", "x.'s"]
    return ["".join(r.choice(alpha) for _ in range(r.randint(0, 60))) for _ in range(n)]


def test_encoder_equals_the_library(library):
    import pyarrow as pa

    enc = tokenfile.Encoder(word_bpe_path())
    texts = [*odd_texts(1500), None, "", "  ", "<|endoftext|>x<|startoftext|>Y", "<|EndOfText|> A", "a" * 3000, "word " * 5000, "Ünïcode, ÀÉ."]
    for lo in range(0, len(texts), 400):
        part = texts[lo : lo + 400]
        ids, bounds = enc.encode(pa.array(part, pa.string()))
        for i, t in enumerate(part):
            assert ids[bounds[i] : bounds[i + 1]].tolist() == library.encode(t or "", add_special_tokens=False).ids, t


def test_encoder_forgets_without_harm(library, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(tokenfile, "KNOWN_WORDS", 20)
    enc = tokenfile.Encoder(word_bpe_path())
    for t in odd_texts(60):
        assert enc.encode(pa.array([t]))[0].tolist() == library.encode(t, add_special_tokens=False).ids


def test_grammar_round_trip():
    r = np.random.default_rng(3)
    base = 500
    cases = [r.integers(0, k, n).astype(np.uint32) for k, n in ((3, 5000), (20, 20000), (400, 3000), (2, 10), (1, 1))]
    cases += [np.full(4097, 7, np.uint32), np.zeros(0, np.uint32), np.tile(np.array([5, 6, 7, 1], np.uint32), 900), np.tile(np.array([4, 4, 4, 9], np.uint32), 700)]
    for ids in cases:
        for least in (2, 16):
            symbols, rules = tokenfile.compress(ids, base, least)
            long = tokenfile.lengths(rules, base)
            assert (tokenfile.expand(symbols, rules, long, base) == ids).all() and len(symbols) <= len(ids)
            assert not (rules == tokenfile.END).any()
            bits, data = tokenfile.pack(symbols)
            assert (tokenfile.unpack(data, len(symbols), bits) == symbols).all()
            assert (long == [len(tokenfile.expand(np.array([base + k], np.uint32), rules, long, base)) for k in range(len(rules))]).all()
    assert len(tokenfile.compress(cases[5], base, 2)[0]) < 200 and len(tokenfile.compress(cases[7], base, 2)[0]) <= 2000


def brute(library, rows):
    out, start = [], 0
    for doc_id, text in rows:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 1]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_files_equal_the_library(spark, library, monkeypatch):
    monkeypatch.setattr(tokenfile, "SHARD_IDS", 700)
    texts = [*odd_texts(120), None, "", "the same words again and again " * 3000, "same", "same"]
    rows = [(1000 - 7 * i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, start int, path string").repartition(5)
    got = sorted(map(tuple, tokenfile.token_files(df, word_bpe_path()).select("doc_id", "start", "n_tokens", "ids_crc32").collect()))
    assert got == brute(library, sorted(rows))


def test_null_and_repeated_ids_and_empty_tables(spark, library):
    rows = [(None, "b c"), (5, "x y z"), (5, "x y z"), (None, None), (2, ""), (5, "other")]
    got = tokenfile.token_files(spark.createDataFrame(rows, "doc_id long, text string"), word_bpe_path()).orderBy("start").collect()
    assert [x.doc_id for x in got] == [None, None, 2, 5, 5, 5]
    assert [x.start for x in got] == np.concatenate([[0], np.cumsum([x.n_tokens for x in got])[:-1]]).tolist()
    want = sorted((i or 0, n, c) for i, _, n, c in brute(library, rows))
    assert sorted((x.doc_id or 0, x.n_tokens, x.ids_crc32) for x in got) == want
    assert tokenfile.token_files(spark.createDataFrame([], "doc_id long, text string"), word_bpe_path()).count() == 0


def test_parts_of_a_file_are_read_alone(spark, library, tmp_path):
    rows = [(i, t * 40) for i, t in enumerate(odd_texts(60))]
    files = tokenfile.write_token_files(spark.createDataFrame(rows, "doc_id long, text string"), word_bpe_path(), f"file://{tmp_path}").collect()
    want, r = [i for _, t in rows for i in [*library.encode(t, add_special_tokens=False).ids, 1]], random.Random(1)
    start = 0
    for f in sorted(files):
        with fs.LocalFileSystem().open_input_file(f.path) as file:
            tokens = tokenfile.TokenFile(file)
            assert int(tokens.shards[:, 3].sum()) == f.ids
            for _ in range(20):
                a, b = sorted(r.randint(0, f.ids) for _ in range(2))
                assert tokens.ids(a, b).tolist() == want[start + a : start + b]
        start += f.ids
    assert start == len(want)
    with pytest.raises(Exception):
        tokenfile.TokenFile(type("F", (io.BytesIO,), {"size": lambda self: 64})(bytes(64)))


def test_query_equals_the_library_on_a_whole_table(spark, library):
    from lexgraph.llm.queries import QUERIES

    docs = sorted(map(tuple, spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()))
    got = sorted(map(tuple, QUERIES["op13_token_files"](spark, "/root/testdata/sf0.001").select("doc_id", "start", "n_tokens", "ids_crc32").collect()))
    assert got == brute(library, docs)
