"""Byte-pair encoding with word ends, by a queue of merge ranks over a linked symbol list."""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from lexgraph.llm.common import with_text
from lexgraph.session import ensure_importable

#: Fixed values of the tokenizer's format: white space, its word pattern, and the ids-to-characters rule of byte-level vocabularies.
SPACE = regex.compile("[\t-\r \x85\xa0  -     　]+")
WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
#: Runs of a cache; there are two.
CACHE = 1 << 18


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte value."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


def merge(symbols: list[str], ranks: dict[tuple[str, str], int]) -> list[str]:
    """Apply merges in order of rank, the leftmost first among equals.

    The symbols form a doubly linked list; the queue holds ranks of pairs with the
    left place in the low bits, and an entry whose pair has another rank by now is
    stale.
    """
    n = len(symbols)
    part, find, pop, push = list(symbols), ranks.get, heapq.heappop, heapq.heappush
    after, before = [*range(1, n + 1)], [*range(-1, n - 1)]
    now = [*map(find, zip(part, part[1:])), None]
    queue = [rank << 32 | i for i, rank in enumerate(now) if rank is not None]
    heapq.heapify(queue)
    while queue:
        first = pop(queue)
        i = first & 0xFFFFFFFF
        if now[i] != first >> 32:
            continue
        j = after[i]
        part[i] = own = part[i] + part[j]
        part[j] = ""
        now[j] = now[i] = None
        k = after[i] = after[j]
        if k < n:
            before[k] = i
            if (rank := find((own, part[k]))) is not None:
                now[i] = rank
                push(queue, rank << 32 | i)
        h = before[i]
        if h >= 0:
            now[h] = rank = find((part[h], own))
            if rank is not None:
                push(queue, rank << 32 | h)
    return [x for x in part if x]


class WordBPE:
    """Encoder and decoder of one vocabulary file (a path, never copied)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = dict(model["vocab"])
        self.ranks = {tuple(pair if isinstance(pair, list) else pair.split(" ")): k for k, pair in enumerate(model["merges"])}
        self.end = model["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names = {i: s for s, i in self.vocab.items()} | {i: s for s, i in self.special.items()}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.bytes = byte_symbols()
        self.decimal = {i: str(i) for i in self.names}
        self.cache: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}

    def _word(self, word: str) -> tuple[int, ...]:
        symbols = [self.bytes[b] for b in word.encode()]
        symbols[-1] += self.end
        return tuple([i for s in merge(symbols, self.ranks) if (i := self.vocab.get(s)) is not None])

    def _learn(self, run: str) -> tuple[int, ...]:
        """Ids of a run without white space; a short one is kept until two caches' worth of others came after its last use."""
        if (found := self.cache.get(run)) is not None:
            return found
        if (found := self.older.get(run)) is None:
            words = WORDS.findall(run)
            # Each word is itself a run of one word.
            found = self._word(run) if words == [run] else tuple(chain.from_iterable(map(self._learn, words)))
        if len(run) <= 64:
            if len(self.cache) >= CACHE:
                self.older, self.cache = self.cache, {}
            self.cache[run] = found
        return found

    def encode(self, text: str) -> list[int]:
        """Ids of a whole text."""
        out: list[int] = []
        for k, part in enumerate(self.cut.split(text) if self.cut else [text]):
            if k % 2:
                out.append(self.special[part])
            elif part:
                part = unicodedata.normalize("NFC", part).replace("Σ", "σ").lower()
                # No word reaches across white space; split() alone would also part at these four.
                runs = [x for x in SPACE.split(part) if x] if any(x in part for x in "\x1c\x1d\x1e\x1f") else part.split()
                found = [*map(self.cache.get, runs)]
                if None in found:
                    found = [x or self._learn(run) for x, run in zip(found, runs)]
                out += chain.from_iterable(found)
        return out

    def decode(self, ids: list[int]) -> str:
        """The vocabulary strings, set side by side with one space."""
        return " ".join([*map(self.names.__getitem__, ids)])

    def digits(self, ids: list[int]) -> str:
        """The ids in decimal, set side by side with one space."""
        return " ".join([*map(self.decimal.__getitem__, ids)])


@functools.lru_cache(2)
def _tokenizer(path: str) -> WordBPE:
    return WordBPE(path)


def encode_documents(docs: DataFrame, path: str, with_ids: bool = False) -> DataFrame:
    """Encode each whole text and decode it again.

    Returns doc_id, n_tokens, ids_sha256, decoded_sha256, and the ids themselves
    (array<int>) where ``with_ids``. Null and empty texts have no tokens; equal
    rows give equal rows; an empty table gives an empty one. ``path`` must be
    readable on the executors.
    """
    ensure_importable(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _tokenizer(path)
        for batch in batches:
            count, ids_sha, text_sha, all_ids = [], [], [], []
            for value in batch.column(1):
                ids = bpe.encode(value.as_py() or "")
                count.append(len(ids))
                ids_sha.append(hashlib.sha256(bpe.digits(ids).encode()).hexdigest())
                text_sha.append(hashlib.sha256(bpe.decode(ids).encode()).hexdigest())
                if with_ids:
                    all_ids.append(ids)
            columns = [batch.column(0), pa.array(count, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(all_ids, pa.list_(pa.int32()))] if with_ids else columns, names)

    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * with_ids
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return with_text(docs).mapInArrow(run, schema)
