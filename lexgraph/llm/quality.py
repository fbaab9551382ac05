"""Quality rules: exact document statistics, fixed base rules, and boosted trees over the statistics."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lexgraph.llm import boosting
from lexgraph.llm.common import with_text
from lexgraph.session import ensure_importable

WORD = re.compile(r"[^\x20\x09-\x0D]+")
_SYMBOLS = np.frombuffer(b"#*$%&|<>", np.uint8)
_SPACES = [9, 10, 11, 12, 13, 32]
#: Features of the trees, and the constraint on each: the score never rises with the falling ones.
FEATURES = {"symbol_rate": -1, "dup_line_rate": -1, "repeat_rate": -1, "upper_rate": -1, "digit_rate": -1, "mark_rate": 0, "mean_word": 0, "distinct_rate": 0, "words_per_line": 0, "log_words": 0}
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def statistics(text: str) -> tuple[list[int], list[float]]:
    """The five counts of one whole text, and its tree features."""
    words = WORD.findall(text)
    n = len(words)
    hist = np.bincount(np.frombuffer(text.encode(errors="surrogatepass"), np.uint8), minlength=256)
    word_chars = len(text) - int(hist[_SPACES].sum())
    symbols = int(hist[_SYMBOLS].sum())
    lines = text.split("\n")
    seen: set[str] = set()
    dup = 0
    for line in lines:
        if line in seen:
            dup += 1
        elif WORD.search(line):
            seen.add(line)
    repeat = 0
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) < len(windows):
        often = {w for w, c in Counter(windows).items() if c > 1}
        end = 0
        for i, w in enumerate(windows):
            if w in often:
                repeat += i + 3 - max(i, end)
                end = i + 3
    m, chars = max(n, 1), max(word_chars, 1)
    upper = int(hist[65:91].sum())
    letters = upper + int(hist[97:123].sum()) + int(hist[128:].sum()) // 2
    marks = int(hist[33:48].sum() + hist[58:65].sum() + hist[91:97].sum() + hist[123:127].sum())
    features = [symbols / chars, dup / max(len(lines), 1), repeat / m, upper / max(letters, 1), int(hist[48:58].sum()) / chars, (marks - symbols) / chars, word_chars / m, len(set(words)) / m, n / max(len(seen), 1), float(np.log1p(n))]
    return [n, word_chars, symbols, dup, repeat], features


def measure(docs: DataFrame) -> DataFrame:
    """doc_id, the five counts, and ``features`` (array<double>). Null texts have no words."""
    ensure_importable(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [statistics(v.as_py() or "") for v in batch.column(1)]
            counts = np.array([f[0] for f in found], np.int64).reshape(-1, 5)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(counts[:, j]) for j in range(5)), pa.array([f[1] for f in found], pa.list_(pa.float64()))], ["doc_id", *COUNTS, "features"])

    return with_text(docs).mapInArrow(run, "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", features array<double>")


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 8000, miss: float = 0.002) -> tuple[boosting.Forest, float]:
    """Fit the trees on at most ``max_rows`` labelled rows; returns (forest, log-odds threshold).

    The rows are those with the smallest hashes of doc_id, so the same on every
    run. A doc_id with both labels counts as bad; of several texts with one doc_id
    the least features are taken, so the bound holds whatever repeats. The threshold is set by cross-fitting: it lies low enough for at most a
    share ``miss`` of good rows to score below it when they were not fitted on,
    and never above even odds. Without labels of both classes nothing is rejected.
    """
    picked = labels.where("doc_id is not null and quality in (0, 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").cast("int").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    rows = measure(with_text(docs).join(F.broadcast(picked.select("doc_id")), "doc_id", "left_semi")).groupBy("doc_id").agg(F.min("features").alias("features")).join(F.broadcast(picked), "doc_id").orderBy("doc_id").collect()
    x = np.array([r["features"] for r in rows]).reshape(-1, len(FEATURES))
    y = np.array([r["quality"] for r in rows], float)
    monotone = np.array(list(FEATURES.values()))
    forest = boosting.fit(x, y, monotone)
    if not len(forest.roots):
        return forest, -np.inf
    held = np.zeros(len(y))
    fold = np.arange(len(y)) % 4
    for k in range(4):
        held[fold == k] = boosting.fit(x[fold != k], y[fold != k], monotone).raw(x[fold == k])
    return forest, float(min(0.0, np.quantile(held[y == 1], miss)))


def quality(docs: DataFrame, labels: DataFrame, max_rows: int = 8000, min_words: int = 50, max_repeat: float = 50.0) -> DataFrame:
    """Judge every document by its whole text.

    Returns doc_id, the five counts, base_failed (fewer than ``min_words`` words,
    or more than ``max_repeat`` per cent of them in repeated three-word windows),
    kept (not base_failed, and the trees' verdict is good) and score (0 to 1).
    One row per input row, equal for equal texts; null and empty texts fail the base
    rule, and rows without a doc_id are judged like others.
    """
    forest, threshold = train(docs, labels, max_rows)
    measured = measure(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(6).flatten().to_numpy().reshape(-1, len(FEATURES))
            raw = forest.raw(x) if len(x) else np.zeros(0)
            n, repeat = batch.column(1).to_numpy(), batch.column(5).to_numpy()
            failed = (n < min_words) | (100 * repeat > max_repeat * n)
            yield pa.RecordBatch.from_arrays([*batch.columns[:6], pa.array(failed), pa.array(~failed & (raw >= threshold)), pa.array(1 / (1 + np.exp(-raw)))], [*batch.schema.names[:6], "base_failed", "kept", "score"])

    return measured.mapInArrow(run, "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", base_failed boolean, kept boolean, score double")


def keep_good(docs: DataFrame, labels: DataFrame, max_rows: int = 8000, min_words: int = 50, max_repeat: float = 50.0) -> DataFrame:
    """The rows of ``docs``, all columns, that quality() would keep."""
    forest, threshold = train(docs, labels, max_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [statistics(v.as_py() or "") for v in batch.column("text")]
            raw = forest.raw(np.array([f[1] for f in found])) if found else np.zeros(0)
            good = [n >= min_words and 100 * repeat <= max_repeat * n and r >= threshold for ((n, _, _, _, repeat), _), r in zip(found, raw)]
            yield batch.filter(pa.array(good, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
