"""A keyed store of nodes and unordered two-ended links, as tables in parts by key."""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lexgraph.session import delete_path, drop_tables, own_folder, write_table

TABLES = {"nodes": "name string, type string, value array<double>", "links": "a string, b string, type string, value array<double>", "sections": "word string, djh long, count double"}
KEYS = {"nodes": ["name"], "links": ["a", "b"], "sections": ["word", "djh"]}
#: Parts of each table, by a hash of the key. A write makes anew the parts that hold its keys.
PARTS = 16


def parse_uri(uri: str) -> dict[str, str]:
    """The parts of ``scheme://[backend:]platform[:device]``, missing ones empty.

    ``cuda:`` and ``opencl:`` in front name the backend; the device is all that
    follows the first colon of the rest. On Spark they name nothing; they are kept
    for monitor().
    """
    m = re.fullmatch(r"([A-Za-z][A-Za-z0-9+.-]*)://(?:(cuda|opencl):)?([^:]*):?(.*)", uri)
    if not m:
        raise ValueError(f"not a store URI: {uri}")
    return {"scheme": m[1], "backend": m[2] or "", "platform": m[3], "device": m[4]}


class AtomStore:
    """Nodes by name, links by their two names whatever the order; values are arrays of numbers.

    With ``strict`` only the first two numbers are kept, a missing second one is 0,
    and (0, 0) reads back as no value. A table is PARTS parts by a hash of its key;
    a bulk write reads and writes the parts its keys fall in, and leaves the files of
    all others as they are. A numbered note lists the parts that hold; it is moved
    into place when a write is complete, so a write is there wholly or not at all.
    Without a ``path`` the store lives as long as it is open; with one, open() finds
    what was stored there, and close() leaves it.
    """

    def __init__(self, spark: SparkSession, uri: str = "spark://store", strict: bool = False, path: str | None = None):
        self.where = parse_uri(uri)
        self.spark, self.uri, self.strict = spark, uri, strict
        self.path, self.kept = path, path is not None
        self.note: dict | None = None
        self.stores = self.fetches = 0

    def open(self) -> None:
        if self.connected():
            raise RuntimeError("already open")
        if not self.kept:
            self.path = own_folder(self.spark, "store")
        last = self._notes()[-1:]
        if last:
            self.note = json.loads("\n".join(r[0] for r in self.spark.read.text(f"{self.path}/notes/{last[0]:08d}").collect()))
        else:
            self.note = {"number": 0, "parts": PARTS, **{t: {} for t in TABLES}}

    def close(self) -> None:
        """Let go; without a path of its own everything stored is deleted."""
        if self.connected() and not self.kept:
            delete_path(self.spark, self.path)
        self.note = None

    def connected(self) -> bool:
        return self.note is not None

    def erase(self) -> None:
        self._check()
        self._commit({t: {} for t in TABLES})

    # Notes and parts
    def _files(self):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/notes")
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def _notes(self) -> list[int]:
        store, at = self._files()
        return sorted(int(x.getPath().getName()) for x in store.listStatus(at) if x.getPath().getName().isdigit()) if store.exists(at) else []

    def _commit(self, changed: dict[str, dict[str, str]]) -> None:
        """Write the next note, then drop the folders that no part is read from any more."""
        old, store = self.note, self._files()[0]
        new = {**old, **changed, "number": old["number"] + 1}
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        draft, final = path(f"{self.path}/notes/_{uuid.uuid4().hex}"), path(f"{self.path}/notes/{new['number']:08d}")
        out = store.create(draft)
        out.write(bytearray(json.dumps(new).encode()))
        out.close()
        if not store.rename(draft, final):
            raise RuntimeError(f"another writer has stored at {self.path}")
        self.note = new
        used = lambda n: {(t, f) for t in TABLES for f in n[t].values()}
        for t, f in used(old) - used(new):
            delete_path(self.spark, f"{self.path}/{t}/{f}")
        if old["number"]:
            store.delete(path(f"{self.path}/notes/{old['number']:08d}"), False)

    def _part(self, kind: str) -> Column:
        return F.pmod(F.xxhash64(*KEYS[kind]), F.lit(self.note["parts"])).cast("int")

    def _table(self, kind: str, parts: list[int] | None = None) -> DataFrame:
        """A table, or some parts of it."""
        self._check()
        at = [f"{self.path}/{kind}/{f}/part={k}" for k, f in self.note[kind].items() if parts is None or int(k) in parts]
        return self.spark.read.schema(TABLES[kind]).parquet(*at) if at else self.spark.createDataFrame([], TABLES[kind])

    @property
    def nodes(self) -> DataFrame:
        return self._table("nodes")

    @property
    def links(self) -> DataFrame:
        return self._table("links")

    @property
    def sections(self) -> DataFrame:
        return self._table("sections")

    def _touched(self, kind: str, keys: DataFrame) -> list[int]:
        """The parts that hold the keys: PARTS numbers at most."""
        return [r[0] for r in keys.select(self._part(kind).alias("part")).distinct().collect()]

    def _rewrite(self, kind: str, parts: list[int], rows: DataFrame) -> dict[str, dict[str, str]]:
        """Write ``rows`` as those parts; returns the table's folders by part. Parts without rows are in none."""
        folder, named = uuid.uuid4().hex, self._part(kind).alias("part")
        rows.select(*[f.name for f in self.spark.createDataFrame([], TABLES[kind]).schema], named).repartition(max(len(parts), 1), "part").write.partitionBy("part").parquet(f"{self.path}/{kind}/{folder}")
        store, at = self._files()[0], self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{kind}/{folder}")
        made = {x.getPath().getName().removeprefix("part=") for x in store.listStatus(at) if x.getPath().getName().startswith("part=")}
        kept = {k: f for k, f in self.note[kind].items() if int(k) not in parts}
        # A folder is one write's; it goes when its last part is written again.
        return {kind: kept | {k: folder for k in made}}

    def _upsert(self, kind: str, new: DataFrame) -> dict[str, dict[str, str]]:
        parts = self._touched(kind, new)
        old = self._table(kind, parts).join(new.select(*KEYS[kind]), KEYS[kind], "left_anti")
        return self._rewrite(kind, parts, old.select(*new.columns).unionByName(new))

    def _check(self) -> None:
        if not self.connected():
            raise RuntimeError("not open")

    def _stored(self, value):
        if not self.strict:
            return value
        pair = F.array(F.coalesce(F.get(value, F.lit(0)), F.lit(0.0)), F.coalesce(F.get(value, F.lit(1)), F.lit(0.0)))
        return F.when(pair != F.array(F.lit(0.0), F.lit(0.0)), pair)

    def _newest(self, rows: DataFrame, keys: list[str], order: str | None, kind: str) -> DataFrame:
        """One row for each key: the last by ``order``. Without an order, a key may stand once only."""
        typed = rows if "type" in rows.columns else rows.withColumn("type", F.lit(kind))
        last = F.struct("type", "value")
        if order is None:
            found = typed.groupBy(*keys).agg(F.count("*").alias("n"), F.first(last).alias("v"))
            found = found.withColumn("v", F.when(F.col("n") == 1, F.col("v")).otherwise(F.raise_error(F.lit("equal keys need an order"))))
        else:
            found = typed.groupBy(*keys).agg(F.max_by(last, order).alias("v"))
        return found.select(*keys, "v.type", self._stored(F.col("v.value")).alias("value"))

    def store_nodes(self, rows: DataFrame, order: str | None = None) -> None:
        """Upsert (name, value, and type if there is one); of rows with equal names the last by ``order`` wins."""
        self._check()
        new = write_table(self._newest(rows, ["name"], order, "word"), "new")
        self._commit(self._upsert("nodes", new))
        drop_tables(new)
        self.stores += 1

    def store_links(self, rows: DataFrame, order: str | None = None) -> None:
        """Upsert (left, right, value, and type if there is one); the last by ``order`` wins; missing end nodes are stored with them."""
        self._check()
        ends = rows.withColumn("a", F.least("left", "right")).withColumn("b", F.greatest("left", "right"))
        new = write_table(self._newest(ends, ["a", "b"], order, "pair"), "new")
        names = new.select(F.explode(F.array("a", "b")).alias("name")).distinct()
        parts = self._touched("nodes", names)
        missing = write_table(names.join(self._table("nodes", parts).select("name"), "name", "left_anti").select("name", F.lit("word").alias("type"), F.lit(None).cast("array<double>").alias("value")), "missing")
        made = {} if missing.isEmpty() else self._upsert("nodes", missing)
        self._commit(made | self._upsert("links", new))
        drop_tables(new, missing)
        self.stores += 1

    def store_sections(self, rows: DataFrame) -> None:
        """Upsert (word, djh, count)."""
        self._check()
        new = write_table(rows.groupBy("word", "djh").agg(F.sum("count").cast("double").alias("count")), "new")
        self._commit(self._upsert("sections", new))
        drop_tables(new)
        self.stores += 1

    def store_values(self, rows: DataFrame, position: int = 0) -> None:
        """Set one number, at ``position``, of the values of stored nodes (name, number) or links (left, right, number).

        The other numbers stay; missing ones before it become 0. Keys that are not
        stored are left out, as a value belongs to a stored node or link.
        """
        self._check()
        kind = "nodes" if "name" in rows.columns else "links"
        keys = KEYS[kind]
        if kind == "links":
            rows = rows.select(F.least("left", "right").alias("a"), F.greatest("left", "right").alias("b"), "number")
        new = write_table(rows.groupBy(*keys).agg(F.max("number").cast("double").alias("number")), "new")
        old = F.coalesce("value", F.array().cast("array<double>"))
        head = F.transform(F.sequence(F.lit(0), F.lit(position)), lambda i: F.coalesce(F.get(old, i), F.lit(0.0)))
        put = F.concat(F.slice(head, 1, position), F.array("number"), F.slice(old, position + 2, F.greatest(F.size(old), F.lit(1))))
        parts = self._touched(kind, new)
        table = self._table(kind, parts)
        changed = table.join(new, keys, "left").withColumn("value", F.when(F.col("number").isNull(), F.col("value")).otherwise(self._stored(put))).select(*table.columns)
        self._commit(self._rewrite(kind, parts, changed))
        drop_tables(new)
        self.stores += 1

    def load_values(self, rows: DataFrame, position: int = 0) -> DataFrame:
        """Asked (name) or (left, right) with the number at ``position`` of their value; null where there is none."""
        found = self.get_nodes(rows) if "name" in rows.columns else self.get_links(rows)
        return found.withColumn("number", F.get("value", F.lit(position))).drop("type", "value")

    def get_nodes(self, names: DataFrame) -> DataFrame:
        """Asked names with their value; null where there is none."""
        self._check()
        self.fetches += 1
        return names.select("name").distinct().join(self.nodes, "name", "left")

    def get_links(self, ends: DataFrame) -> DataFrame:
        self._check()
        self.fetches += 1
        return ends.select(F.least("left", "right").alias("a"), F.greatest("left", "right").alias("b")).distinct().join(self.links, ["a", "b"], "left")

    def remove_nodes(self, names: DataFrame, recursive: bool = False) -> None:
        """Delete nodes; with ``recursive`` also the links that end in them."""
        self._check()
        gone = write_table(names.select("name").distinct(), "gone")
        parts = self._touched("nodes", gone)
        changed = self._rewrite("nodes", parts, self._table("nodes", parts).join(gone, "name", "left_anti"))
        if recursive:
            ended = self.links.join(gone.withColumnRenamed("name", "a"), "a", "left_semi").select("a", "b").unionByName(self.links.join(gone.withColumnRenamed("name", "b"), "b", "left_semi").select("a", "b"))
            lost = write_table(ended.distinct(), "lost")
            parts = self._touched("links", lost)
            changed |= self._rewrite("links", parts, self._table("links", parts).join(lost, ["a", "b"], "left_anti"))
            drop_tables(lost)
        self._commit(changed)
        drop_tables(gone)

    def incoming(self, names: DataFrame, kind: str | None = None) -> DataFrame:
        """(name, a, b, value): the links, of one type if given, that end in each name, once each."""
        self._check()
        links = self.links if kind is None else self.links.where(F.col("type") == kind)
        ends = links.select(F.explode(F.array_distinct(F.array("a", "b"))).alias("name"), "a", "b", "value")
        return ends.join(names.select("name").distinct(), "name")

    def load_nodes(self, kind: str | None = None) -> DataFrame:
        """All nodes, or those of one type."""
        self._check()
        return self.nodes if kind is None else self.nodes.where(F.col("type") == kind)

    def load_links(self, kind: str | None = None) -> DataFrame:
        self._check()
        return self.links if kind is None else self.links.where(F.col("type") == kind)

    def sql(self, text: str) -> DataFrame:
        """Spark SQL over the views nodes, links and sections."""
        self._check()
        self.nodes.createOrReplaceTempView("nodes")
        self.links.createOrReplaceTempView("links")
        self.sections.createOrReplaceTempView("sections")
        return self.spark.sql(text)

    def barrier(self) -> None:
        """Writes are complete when they return, so there is nothing to wait for."""
        self._check()

    def monitor(self) -> dict:
        self._check()
        return {"uri": self.uri, **self.where, "connected": True, "nodes": self.nodes.count(), "links": self.links.count(), "sections": self.sections.count(), "stores": self.stores, "fetches": self.fetches}
