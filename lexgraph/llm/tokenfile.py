"""Token ids as binary files: Re-Pair grammars by shard, read back by document without unpacking the rest."""

from __future__ import annotations

import functools
import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window as W, functions as F

from lexgraph.llm.common import _LOWER, _SPACE, buffers, with_text
from lexgraph.llm.warc import open_fs
from lexgraph.session import ensure_importable, own_folder, write_table

MAGIC, VERSION = b"LXGT", 1
#: The id that ends each document.
END = 1
#: Ids of a shard, from which it is closed (a longer document is a shard of its own).
SHARD_IDS = 1 << 18
#: Bytes of texts that are encoded at a time.
ENCODE_BYTES = 12 << 20
#: Uses from which a pair gets a rule, rules of one pass at most, and the share of symbols a pass must save for another to follow.
LEAST_USES, PASS_RULES, LEAST_SAVED = 16, 8192, 0.02
#: Words whose ids an encoder keeps.
KNOWN_WORDS = 1 << 21
_HEAD, _SHARD, _TAIL = "<4sII", "<IIIII", "<QI4s"
_MIX = np.uint64(0x9E3779B97F4A7C15)
_LETTER, _CLOSING = (np.isin(np.arange(256), list(x)) for x in (b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", b".,;:!?"))


class Encoder:
    """Ids of whole texts by the tokenizers library; a word between white space is given to it once.

    Such tokenizers part words at white space, and letters from a closing sign after
    them, and lower-case all but special tokens, so a text's ids are those of its
    parts side by side. New parts that are letters go to the library many in one
    text, where the tokens that end a word tell them apart; all others go one by one.
    Files without word ends, lower-casing or white space in the normaliser are refused.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.suffix = spec["model"].get("end_of_word_suffix")
        if not self.suffix or spec["model"]["type"] != "BPE" or not all(x in json.dumps(spec["normalizer"]) for x in ("\\\\s", "Lowercase")):
            raise ValueError(f"not a tokenizer of words with ends: {path}")
        self.base = 1 + max([*spec["model"]["vocab"].values(), *(t["id"] for t in spec["added_tokens"]), END])
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.ends = np.zeros(self.base, bool)
        for token, i in spec["model"]["vocab"].items():
            self.ends[i] = token.endswith(self.suffix)
        self._forget()

    def _forget(self) -> None:
        self.known = pa.array([], pa.string())
        self.flat, self.starts = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def _encode(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, new: pa.StringArray) -> None:
        words, ids, sizes = new.to_pylist(), [self.flat], [np.zeros(0, np.int64)]
        simple = np.array([w.isalpha() and (w.isascii() or max(w) <= "\xff") for w in words], bool)
        order, other = [np.zeros(0, np.int64)], [np.flatnonzero(~simple)]
        for lo in range(0, int(simple.sum()), 20_000):
            part = np.flatnonzero(simple)[lo : lo + 20_000]
            found = np.array(self._encode([" ".join([words[i] for i in part])])[0], np.uint32)
            last = np.flatnonzero(self.ends[found])
            if len(last) == len(part):
                ids.append(found)
                sizes.append(np.diff(last + 1, prepend=0))
                order.append(part)
            else:
                other.append(part)
        rest = np.concatenate(other)
        for found in self._encode([words[i] for i in rest]) if len(rest) else []:
            ids.append(np.array(found, np.uint32))
            sizes.append(np.array([len(found)]))
        self.known = pa.concat_arrays([self.known, new.take(pa.array(np.concatenate([*order, rest])))])
        self.flat = np.concatenate(ids)
        self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(np.concatenate(sizes))])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts side by side, their bounds by text); a null text has none."""
        data, offsets = buffers(texts)
        data, offsets = data[offsets[0] : offsets[-1]], offsets - offsets[0]
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(texts) + 1, np.int64)
        solid = ~_SPACE[data]
        letter = _LETTER[data]
        # Letters of two bytes, C3 80 to C3 BF, without the signs among them.
        letter[1:] |= (data[:-1] == 0xC3) & (data[1:] != 0x97) & (data[1:] != 0xB7)
        start = solid.copy()
        start[1:] &= ~solid[:-1] | (_CLOSING[data[1:]] & letter[:-1])
        first = offsets[:-1][offsets[:-1] < len(data)]
        start[first] = solid[first]
        where = np.flatnonzero(start)
        # The names of special tokens count as they are written; all else is lower-cased anyway.
        raw = (data if b"<|" in data.tobytes() else _LOWER[data])[solid]
        cut = np.append(np.cumsum(solid)[where] - 1, len(raw)).astype(np.int32)
        words = pa.StringArray.from_buffers(len(where), pa.py_buffer(cut), pa.py_buffer(raw)).dictionary_encode()
        if len(self.known) + len(words.dictionary) > KNOWN_WORDS:
            self._forget()
        own = pc.index_in(words.dictionary, value_set=self.known)
        if own.null_count:
            self._learn(words.dictionary.filter(own.is_null()))
            own = pc.index_in(words.dictionary, value_set=self.known)
        at = own.to_numpy().astype(np.int64)[words.indices.to_numpy(zero_copy_only=False)]
        sizes = self.starts[at + 1] - self.starts[at]
        bounds = np.concatenate([[0], np.cumsum(sizes)])
        take = np.repeat(self.starts[at] - bounds[:-1], sizes) + np.arange(bounds[-1])
        return self.flat[take], bounds[np.searchsorted(where, offsets)]


@functools.lru_cache(2)
def _encoder(path: str) -> Encoder:
    return Encoder(path)


def compress(ids: np.ndarray, base: int, least: int = LEAST_USES) -> tuple[np.ndarray, np.ndarray]:
    """(symbols, rules): ``ids`` with frequent pairs replaced, again and again, by nonterminals from ``base`` on.

    A pass counts all pairs of neighbours, ranks those that stand ``least`` times or
    more, and replaces each where it outranks the pairs that overlap it; pairs left
    with fewer uses wait for a later pass. No rule holds END, so documents stay apart.
    """
    s, rules = ids.astype(np.uint64), [np.zeros((0, 2), np.uint64)]
    top = base
    while len(s) > 2 * least:
        code = (s[:-1] << np.uint64(32)) | s[1:]
        inner = s != END
        live = code[inner[:-1] & inner[1:]]
        live.sort()
        edge = np.flatnonzero(np.concatenate([[True], live[1:] != live[:-1], [True]])) if len(live) else np.zeros(1, np.int64)
        counts = np.diff(edge)
        good = np.flatnonzero(counts >= least)
        if not len(good):
            break
        good = good[np.argsort(-counts[good], kind="stable")[:PASS_RULES]]
        pairs = live[edge[good]]
        # A table by hash: of pairs that share a place the best ranked one is found, the others wait.
        slot = np.full(1 << 16, len(pairs), np.int32)
        place = lambda x: ((x * _MIX) >> np.uint64(48)).astype(np.int64)
        slot[place(pairs)[::-1]] = np.arange(len(pairs), dtype=np.int32)[::-1]
        rank = slot[place(code)]
        rank[np.append(pairs, np.uint64(0))[rank] != code] = len(pairs)
        padded = np.concatenate([[len(pairs)], rank, [len(pairs)]]).astype(np.int32)
        chosen = (rank < len(pairs)) & (rank < padded[:-2]) & (rank < padded[2:])
        if (same := (rank == padded[:-2]) & (rank < len(pairs))).any():
            # Runs of one symbol: every other place of a run that outranks both its neighbours.
            start = np.flatnonzero(~same & np.append(same[1:], False))
            width = np.diff(np.flatnonzero(np.append(~same, True)))[np.searchsorted(np.flatnonzero(~same), start)]
            best = (rank[start] < padded[start]) & (rank[start] < padded[start + width + 1])
            start, width = start[best], (width[best] + 1) // 2
            ends = np.cumsum(width)
            chosen[np.repeat(start - 2 * (ends - width), width) + 2 * np.arange(ends[-1] if len(ends) else 0)] = True
        at = np.flatnonzero(chosen)
        uses = np.bincount(rank[at], minlength=len(pairs))
        kept = uses >= least
        if not kept.any():
            break
        at = at[kept[rank[at]]]
        name = top + np.cumsum(kept) - 1
        before = len(s)
        s[at] = name[rank[at]]
        gone = np.ones(len(s), bool)
        gone[at + 1] = False
        s = s[gone]
        used = pairs[kept]
        rules.append(np.column_stack([used >> np.uint64(32), used & np.uint64(0xFFFFFFFF)]))
        top += len(used)
        if before - len(s) < LEAST_SAVED * before:
            break
    return s.astype(np.uint32), np.concatenate(rules).astype(np.uint32)


def lengths(rules: np.ndarray, base: int) -> np.ndarray:
    """How many ids each rule stands for; a rule only names rules before it."""
    out = np.ones(base + len(rules), np.int64)
    done = 0
    while done < len(rules):
        # As many rules at once as name none among themselves.
        late = np.flatnonzero((rules[done:] >= base + done).any(axis=1))
        end = done + (int(late[0]) if len(late) else len(rules) - done)
        out[base + done : base + end] = out[rules[done:end, 0]] + out[rules[done:end, 1]]
        done = end
    return out[base:]


def expand(symbols: np.ndarray, rules: np.ndarray, long: np.ndarray, base: int) -> np.ndarray:
    """The ids that ``symbols`` stand for; ``long`` has the rules' lengths."""
    # The rules' own ids side by side, by opening all that is left to open at once.
    s = np.arange(base, base + len(rules))
    while len(s) and (big := s >= base).any():
        at = np.cumsum(1 + big) - 1 - big
        out = np.empty(len(s) + int(big.sum()), np.int64)
        pair = rules[s[big] - base]
        out[at[~big]] = s[~big]
        out[at[big]], out[at[big] + 1] = pair[:, 0], pair[:, 1]
        s = out
    opened, starts = s.astype(np.uint32), np.cumsum(long) - long
    big = symbols >= base
    size = np.ones(len(symbols), np.int64)
    own = symbols[big] - base
    size[big] = long[own]
    out = np.repeat(symbols, size)
    at = (np.cumsum(size) - size)[big]
    inner = np.arange(int(size[big].sum())) - np.repeat(np.cumsum(size[big]) - size[big], size[big])
    out[np.repeat(at, size[big]) + inner] = opened[np.repeat(starts[own], size[big]) + inner]
    return out


def pack(s: np.ndarray) -> tuple[int, bytes]:
    """(bits a symbol, bytes): the low 16 bits as they are, then each higher bit as a bitmap."""
    bits = max(16, int(s.max()).bit_length() if len(s) else 16)
    return bits, b"".join([s.astype("<u2").tobytes(), *(np.packbits((s >> np.uint32(b)) & np.uint32(1), bitorder="little").tobytes() for b in range(16, bits))])


def unpack(data: bytes, n: int, bits: int) -> np.ndarray:
    out, step = np.frombuffer(data, "<u2", n).astype(np.uint32), -(-n // 8)
    for b in range(16, bits):
        at = 2 * n + (b - 16) * step
        out |= np.unpackbits(np.frombuffer(data, np.uint8, step, at), count=n, bitorder="little").astype(np.uint32) << np.uint32(b)
    return out


def shard(doc_ids: np.ndarray, known: np.ndarray, sizes: np.ndarray, ids: np.ndarray, base: int) -> bytes:
    """One shard: counts, then doc_ids, whether each is one, ids by document, rules, their lengths, and the symbols."""
    symbols, rules = compress(ids, base)
    bits, packed = pack(symbols)
    return b"".join([struct.pack(_SHARD, len(sizes), len(rules), len(symbols), bits, len(packed)), doc_ids.astype("<i8").tobytes(), np.packbits(known).tobytes(), sizes.astype("<u4").tobytes(), rules.astype("<u4").tobytes(), lengths(rules, base).astype("<u4").tobytes(), packed])


class TokenFile:
    """Reads one file: all documents, or the ids of some, by the directory at its end."""

    def __init__(self, file):
        self.file = file
        size = file.size()
        file.seek(0)
        magic, version, self.base = struct.unpack(_HEAD, file.read(struct.calcsize(_HEAD)))
        file.seek(size - struct.calcsize(_TAIL))
        at, n, end = struct.unpack(_TAIL, file.read(struct.calcsize(_TAIL)))
        if magic != MAGIC or end != MAGIC or version != VERSION:
            raise ValueError("not a token file")
        file.seek(at)
        #: offset, bytes, documents and ids of each shard.
        self.shards = np.frombuffer(file.read(32 * n), "<u8").reshape(n, 4).astype(np.int64)

    def _open(self, k: int) -> tuple:
        self.file.seek(int(self.shards[k, 0]))
        data = self.file.read(int(self.shards[k, 1]))
        docs, n_rules, n, bits, size = struct.unpack_from(_SHARD, data)
        at, out = struct.calcsize(_SHARD), []
        for kind, count in (("<i8", docs), ("u1", -(-docs // 8)), ("<u4", docs), ("<u4", 2 * n_rules), ("<u4", n_rules)):
            out.append(np.frombuffer(data, kind, count, at))
            at += out[-1].nbytes
        doc_ids, known, sizes, rules, long = out
        return doc_ids, np.unpackbits(known, count=docs).astype(bool), sizes.astype(np.int64), rules.reshape(-1, 2), long.astype(np.int64), unpack(data[at : at + size], n, bits)

    def documents(self, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(doc_ids, whether each is one, ids by document, all ids) of shard ``k``."""
        doc_ids, known, sizes, rules, long, symbols = self._open(k)
        return doc_ids, known, sizes, expand(symbols, rules, long, self.base)

    def ids(self, start: int, end: int) -> np.ndarray:
        """The file's ids from ``start`` to ``end``: only the symbols that hold them are expanded."""
        before, out = np.concatenate([[0], np.cumsum(self.shards[:, 3])]), [np.zeros(0, np.uint32)]
        for k in range(len(self.shards)):
            lo, hi = max(start - before[k], 0), min(end, before[k + 1]) - before[k]
            if lo < hi:
                *_, rules, long, symbols = self._open(k)
                size = np.ones(len(symbols), np.int64)
                size[symbols >= self.base] = long[symbols[symbols >= self.base] - self.base]
                ends = np.cumsum(size)
                a, b = np.searchsorted(ends, lo, "right"), np.searchsorted(ends, hi, "left") + 1
                skip = lo - (ends[a] - size[a])
                out.append(expand(symbols[a:b], rules, long, self.base)[skip : skip + hi - lo])
        return np.concatenate(out)


def write_token_files(docs: DataFrame, path: str, folder: str) -> DataFrame:
    """Encode whole texts, and write one file a task under ``folder``; returns (part, path, ids).

    Documents are dealt by range of doc_id (null first, equal ones by their text's
    hash), so files in order of ``part`` hold them in ascending order. Each attempt
    of a task writes a file of its own and reports it when it is complete; files of
    lost attempts are in no row, and are never read. A task holds one shard.
    """
    ensure_importable(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, held, size = _encoder(path), [], 0
        out, name, at, directory = None, "", 0, []

        def put(data: bytes) -> None:
            nonlocal at
            out.write(data)
            at += len(data)

        def close_shard() -> None:
            nonlocal held, size
            doc_ids, known, sizes, ids = (np.concatenate(x) for x in zip(*held))
            data = shard(doc_ids, known, sizes, ids, encoder.base)
            directory.append((at, len(data), len(sizes), len(ids)))
            put(data)
            held, size = [], 0

        def gathered() -> Iterator[pa.RecordBatch]:
            rows, n = [], 0
            for batch in batches:
                rows.append(batch)
                n += batch.nbytes
                if n >= ENCODE_BYTES:
                    yield pa.concat_batches(rows)
                    rows, n = [], 0
            if rows:
                yield pa.concat_batches(rows)

        for batch in gathered():
            if not len(batch):
                continue
            if out is None:
                store, root = open_fs(folder)
                store.create_dir(root, recursive=True)
                name = f"{root}/tokens-{uuid.uuid4().hex}.lxgt"
                out = store.open_output_stream(name, compression=None)
                put(struct.pack(_HEAD, MAGIC, VERSION, encoder.base))
            ids, bounds = encoder.encode(batch.column(1))
            ids = np.insert(ids, bounds[1:], np.uint32(END))
            ends = bounds[1:] + np.arange(1, len(bounds))
            sizes, doc_ids, known = np.diff(ends, prepend=0), batch.column(0).fill_null(0).to_numpy(), batch.column(0).is_valid().to_numpy(zero_copy_only=False)
            lo = 0
            while lo < len(ends):
                base = ends[lo - 1] if lo else 0
                hi = min(int(np.searchsorted(ends, base + max(SHARD_IDS - size, 0), "left")) + 1, len(ends))
                held.append((doc_ids[lo:hi], known[lo:hi], sizes[lo:hi], ids[base : ends[hi - 1]]))
                size += int(ends[hi - 1] - base)
                lo = hi
                if size >= SHARD_IDS:
                    close_shard()
        if out is None:
            return
        if held:
            close_shard()
        listed = np.array(directory, "<u8")
        put(listed.tobytes() + struct.pack(_TAIL, at, len(listed), MAGIC))
        out.close()
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()]), pa.array([name]), pa.array([int(listed[:, 3].sum())])], ["part", "path", "ids"])

    rows = with_text(docs).withColumn("tie", F.xxhash64("text"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(parts, F.col("doc_id").asc_nulls_first(), "tie").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "tie")
    return dealt.select("doc_id", "text").mapInArrow(run, "part long, path string, ids long")


def read_token_files(files: DataFrame, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the listed files; start counts the ids of all before it."""
    ensure_importable(files.sparkSession)
    # One row a file.
    placed = files.select("path", (F.sum("ids").over(W.orderBy("part")) - F.col("ids")).alias("before"))
    spread = placed.repartition(int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")), "path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = open_fs(folder)
        for batch in batches:
            for path, before in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with store.open_input_file(path) as file:
                    tokens = TokenFile(file)
                    for k in range(len(tokens.shards)):
                        doc_ids, known, sizes, ids = tokens.documents(k)
                        ends = np.cumsum(sizes)
                        raw, cut = memoryview(ids.astype("<u4").tobytes()), 4 * np.concatenate([[0], ends])
                        crc = [zlib.crc32(raw[a:b]) for a, b in zip(cut, cut[1:])]
                        yield pa.RecordBatch.from_arrays([pa.array(doc_ids.astype(np.int64), mask=~known), pa.array(before + ends - sizes), pa.array(sizes), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])
                        before += len(ids)

    return spread.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, path: str, folder: str | None = None) -> DataFrame:
    """Write all documents' ids to files and read them back: doc_id, start, n_tokens, ids_crc32, one row per row.

    A null or empty text has the end id alone; rows without a doc_id come first, rows
    that share one follow each other in order of their text's hash, and equal rows
    get a place each. An empty table gives an empty result. ``path`` must be
    readable on the executors.
    """
    folder = folder or own_folder(docs.sparkSession, "tokens")
    if ":" not in folder:
        folder = f"file://{folder}"
    return read_token_files(write_table(write_token_files(docs, path, folder), "token-files"), folder)
