"""Data sources of sentences: the binary corpus format in batches, and lines of text as a stream with a cap of sentences.

Both are registered with a session by register(); their classes are made inside a
function, so that they reach Python workers whole, wherever this package is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Sentences between two entries of a corpus file's index, and those of a batch of rows.
STEP = 4096
#: The reference's cap of sentences for one round.
CAP = 16


def _sources(step: int, cap: int) -> tuple[type, type]:
    import array
    import json
    import posixpath
    import struct
    import uuid

    import pyarrow as pa
    from pyarrow import fs
    from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, SimpleDataSourceStreamReader, WriterCommitMessage

    def opened(uri: str):
        return fs.FileSystem.from_uri(uri if ":" in uri else f"file://{uri}")

    def listed(store, path: str) -> list[str]:
        """Files of a folder in order of name, or the one file."""
        if store.get_file_info(path).type == fs.FileType.File:
            return [path]
        return sorted(f.path for f in store.get_file_info(fs.FileSelector(path)) if f.type == fs.FileType.File and not posixpath.basename(f.path).startswith(("_", ".")))

    class Part(InputPartition):
        def __init__(self, path: str, start: int, end: int, first: int):
            super().__init__((path, start, end, first))

    class Done(WriterCommitMessage):
        def __init__(self, path: str = "", sentences: int = 0, top: int = 0, offsets: tuple = (), size: int = 0):
            self.path, self.sentences, self.top, self.offsets, self.size = path, sentences, top, offsets, size

    class CorpusReader(DataSourceReader):
        def __init__(self, uri: str):
            self.uri = uri

        def partitions(self):
            """A range of bytes for each entry of the index; a file without one is walked by its lengths once, in steps."""
            store, root = opened(self.uri)
            note = posixpath.join(root, "_corpus.json")
            if store.get_file_info(note).type == fs.FileType.File:
                with store.open_input_file(note) as f:
                    files = [(posixpath.join(root, x["name"]), x["offsets"], x["size"]) for x in json.loads(f.read())["files"]]
            else:
                files = [(path, *self.walk(store, path)) for path in listed(store, root)]
            out = []
            for no, (path, offsets, size) in enumerate(files):
                out += [Part(path, a, b, (no << 32) + k * step) for k, (a, b) in enumerate(zip(offsets, [*offsets[1:], size])) if a < b]
            return out

        def walk(self, store, path: str) -> tuple[list[int], int]:
            offsets, at = [], 8
            with store.open_input_stream(path) as f:
                n = struct.unpack("<II", f.read(8))[0]
                for k in range(n):
                    if k % step == 0:
                        offsets.append(at)
                    (long,) = struct.unpack("<I", f.read(4))
                    left = 4 * long
                    while left:
                        left -= len(f.read(min(left, 1 << 20)))
                    at += 4 + 4 * long
            return offsets, at

        def read(self, part):
            if part is None:  # a corpus without sentences
                return
            path, start, end, first = part.value
            store, _ = opened(self.uri)
            with store.open_input_file(path) as f:
                data = array.array("I")
                data.frombytes(f.read_at(end - start, start))
            at, words, ends, n = 0, [], [0], 0
            while at < len(data):
                long = data[at]
                words.extend(data[at + 1 : at + 1 + long])
                ends.append(len(words))
                at += 1 + long
                n += 1
            yield pa.RecordBatch.from_arrays([pa.array(range(first, first + n), pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(words, pa.int64()))], ["sent_id", "words"])

    class CorpusWriter(DataSourceWriter):
        def __init__(self, uri: str, overwrite: bool):
            self.uri, self.overwrite = uri, overwrite

        def write(self, rows):
            """One file a task, under a name of its own; the counts in front are known, and put there, when it is complete."""
            store, root = opened(self.uri)
            store.create_dir(root, recursive=True)
            name = f"part-{uuid.uuid4().hex}.bin"
            body, top, n, at, offsets = f"{root}/_{name}", 0, 0, 8, []
            with store.open_output_stream(body) as f:
                for row in rows:
                    if n % step == 0:
                        offsets.append(at)
                    words = list(row["words"] or [])
                    f.write(struct.pack(f"<{len(words) + 1}I", len(words), *words))
                    top, n, at = max([top, *(w + 1 for w in words)]), n + 1, at + 4 + 4 * len(words)
            with store.open_output_stream(f"{root}/{name}") as f, store.open_input_stream(body) as held:
                f.write(struct.pack("<II", n, top))
                while part := held.read(1 << 20):
                    f.write(part)
            store.delete_file(body)
            return Done(name, n, top, tuple(offsets), at)

        def commit(self, messages) -> None:
            """The note that names the files is what makes them the corpus."""
            store, root = opened(self.uri)
            done = [m for m in messages if m is not None and m.sentences]
            keep = {m.path for m in done}
            note = posixpath.join(root, "_corpus.json")
            if not self.overwrite and store.get_file_info(note).type == fs.FileType.File:
                self.abort(messages)
                raise FileExistsError(self.uri)
            text = json.dumps({"step": step, "sentences": sum(m.sentences for m in done), "words": max([0, *(m.top for m in done)]), "files": [{"name": m.path, "offsets": list(m.offsets), "size": m.size} for m in done]})
            with store.open_output_stream(f"{note}.new") as f:
                f.write(text.encode())
            store.move(f"{note}.new", note)
            for path in listed(store, root):
                if posixpath.basename(path) not in keep:
                    store.delete_file(path)

        def abort(self, messages) -> None:
            store, root = opened(self.uri)
            for m in messages:
                if m is not None and store.get_file_info(f"{root}/{m.path}").type == fs.FileType.File:
                    store.delete_file(f"{root}/{m.path}")

    class BinaryCorpus(DataSource):
        @classmethod
        def name(cls) -> str:
            return "binary_corpus"

        def schema(self) -> str:
            return "sent_id long, words array<long>"

        def reader(self, schema):
            return CorpusReader(self.options["path"])

        def writer(self, schema, overwrite):
            return CorpusWriter(self.options["path"], overwrite)

    class LineReader(SimpleDataSourceStreamReader):
        def __init__(self, uri: str, most: int):
            self.uri, self.most = uri, most

        def initialOffset(self) -> dict:
            return {"file": "", "byte": 0, "sentences": 0}

        def take(self, start: dict, most: int) -> tuple[list, dict]:
            """Up to ``most`` sentences from a place on, and the place after them; an unfinished last line waits."""
            store, root = opened(self.uri)
            files, out, now = listed(store, root), [], dict(start)
            for k, path in enumerate(files):
                if path < now["file"]:
                    continue
                if path > now["file"]:
                    now.update(file=path, byte=0)
                size = store.get_file_info(path).size
                with store.open_input_file(path) as f:
                    f.seek(now["byte"])
                    rest = b""
                    while len(out) < most and (now["byte"] + len(rest) < size or rest):
                        if b"\n" not in rest:
                            more = f.read(1 << 16)
                            rest += more
                            if not more and k + 1 == len(files):
                                break
                            if more and b"\n" not in rest:
                                continue
                        line, mark, rest = rest.partition(b"\n")
                        now["byte"] += len(line) + len(mark)
                        if words := line.decode().split():
                            out.append((now["sentences"], words))
                            now["sentences"] += 1
                if len(out) == most:
                    break
            return out, now

        def read(self, start: dict):
            rows, end = self.take(start, self.most)
            return iter(rows), end

        def readBetweenOffsets(self, start: dict, end: dict):
            return iter(self.take(start, end["sentences"] - start["sentences"])[0])

    class Sentences(DataSource):
        @classmethod
        def name(cls) -> str:
            return "sentences"

        def schema(self) -> str:
            return "sent_id long, words array<string>"

        def simpleStreamReader(self, schema):
            return LineReader(self.options["path"], int(self.options.get("cap", cap)))

    return BinaryCorpus, Sentences


def register(spark: SparkSession) -> None:
    """Let the session read and write the formats ``binary_corpus`` and ``sentences``."""
    for source in _sources(STEP, CAP):
        spark.dataSource.register(source)


def read_binary_corpus(spark: SparkSession, path: str) -> DataFrame:
    """(sent_id, words) of binary corpus files: the counts of sentences and words, then each sentence's length and word ids.

    All numbers are unsigned, of 32 bits, little-endian. A file, or each file of a
    folder, is read by ranges of STEP sentences, which the index of a written corpus
    gives; files of others have none and are walked once for it. Sentences are
    numbered within their file, after file number * 2**32 in order of path.
    """
    register(spark)
    return spark.read.format("binary_corpus").load(path)


def write_binary_corpus(sents: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Encoded sentences as files of that format, one a task, and a note that lists them; without the note none counts."""
    register(sents.sparkSession)
    # The writer itself refuses to replace a corpus unless told to.
    sents.select("sent_id", "words").write.format("binary_corpus").mode("overwrite" if mode == "overwrite" else "append").save(path)


def sentence_lines(spark: SparkSession, path: str, cap: int = CAP) -> DataFrame:
    """A stream of sentences (sent_id, words): lines of words in a file, or in the files of a folder in order of name.

    A trigger takes ``cap`` sentences at most, those after the last one's, wherever
    that was in a file; they pass through the driver, which the cap bounds. Lines may
    be appended to the last file, and files with later names may come.
    """
    register(spark)
    return spark.readStream.format("sentences").option("path", path).option("cap", cap).load()
