"""Keyed-table primitives: upsert, lookup, delete, increment, iterate."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from lexgraph.session import write_table


def upsert(rows: DataFrame, seq: str = "seq") -> DataFrame:
    """(key, value): the value with the greatest ``seq`` of each key."""
    return rows.groupBy("key").agg(F.max_by("value", seq).alias("value"))


def lookup(asked: DataFrame, table: DataFrame, missing: int = -1) -> DataFrame:
    """Asked keys with their value, or ``missing``."""
    return asked.join(table.select("key", "value"), "key", "left").select("key", F.coalesce("value", F.lit(missing)).alias("value"))


def delete(table: DataFrame, gone: DataFrame) -> DataFrame:
    return table.join(gone.select("key").distinct(), "key", "left_anti")


def increment(keys: DataFrame) -> DataFrame:
    """(key, value): how often each key stands in the input."""
    return keys.groupBy("key").agg(F.count("*").alias("value"))


def find_or_create(asked: DataFrame, keys: list[str], table: DataFrame | None = None, id_name: str = "id") -> DataFrame:
    """(*keys, id): the ids of a stored dictionary, and new ones for asked keys that it lacks.

    New ids follow the greatest stored one, in order of the keys. For words the key
    is the word; for pairs both words in order; for sections the word and the hash
    of its disjunct. New keys are range-partitioned and numbered part by part.
    """
    new = asked.select(*keys).distinct()
    if table is not None:
        new = new.join(table.select(*keys), keys, "left_anti")
    dealt = write_table(new.repartitionByRange(*keys).withColumn("part__", F.spark_partition_id()), "new-keys")
    sizes = dealt.groupBy("part__").agg(F.count("*").alias("n__"))
    before = sizes.select("part__", (F.sum("n__").over(W.orderBy("part__")) - F.col("n__")).alias("before__"))
    start = -1 if table is None else table.agg(F.coalesce(F.max(id_name), F.lit(-1))).first()[0]
    rank = F.row_number().over(W.partitionBy("part__").orderBy(*keys))
    made = dealt.withColumn("rank__", rank).join(F.broadcast(before), "part__").select(*keys, (F.col("before__") + F.col("rank__") + start).cast("long").alias(id_name))
    return made if table is None else table.select(*keys, F.col(id_name).cast("long").alias(id_name)).unionByName(made)


def iterate(table: DataFrame, max_output: int | None = None) -> DataFrame:
    """Live entries; if capped, those of the least keys."""
    live = table.where("value is not null")
    return live if max_output is None else live.orderBy("key").limit(max_output)
