"""Connected components, kept up to date or anew; maximum spanning forests; and class summaries."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from lexgraph.session import drop_tables, ensure_importable, write_table

#: Edges up to which one task finishes a graph by union-find; larger ones are contracted by the cluster.
FEW = 200_000


def _least_root(up: dict, i):
    """The root of ``i`` in a union-find whose roots are the least of their parts."""
    while (j := up.setdefault(i, i)) != i:
        up[i] = up[j]
        i = j
    return i


def _join(up: dict, a, b) -> bool:
    """Link the parts of ``a`` and ``b``; whether they were apart."""
    a, b = _least_root(up, a), _least_root(up, b)
    if a != b:
        up[max(a, b)] = min(a, b)
    return a != b


def _with_min(edges: DataFrame) -> DataFrame:
    """Edges (u, v) with the least neighbour of u, u included, as m."""
    least = edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return edges.join(least, "u")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _with_min(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    linked = _with_min(down)
    kept = linked.select(F.col("v").alias("u"), F.col("m").alias("v"))
    heads = linked.select("u", F.col("m").alias("v"))
    return kept.unionAll(heads).where("u <> v").distinct()


def _is_forest_of_stars(edges: DataFrame) -> bool:
    """Whether every node has one edge, down to a node that has none of its own: nothing will change any more."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")), F.struct(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))).alias("e"))
    return ends.groupBy("e.node").agg(F.sum("e.up").alias("up"), F.max("e.down").alias("down")).where("up > 1 or (up = 1 and down = 1)").isEmpty()


def _by_one_task(edges: DataFrame) -> DataFrame:
    """(node, root) of a graph of few edges (u, v)."""
    ensure_importable(edges.sparkSession)
    schema = StructType().add("node", edges.schema["u"].dataType).add("root", edges.schema["u"].dataType)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        up: dict = {}
        for batch in batches:
            for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                _join(up, u, v)
        nodes = list(up)
        yield pa.RecordBatch.from_arrays([pa.array(nodes, arrow[0].type), pa.array([_least_root(up, x) for x in nodes], arrow[1].type)], schema=arrow)

    return edges.select("u", "v").coalesce(1).mapInArrow(run, schema)


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60, few: int = 0) -> DataFrame:
    """(node, root) for every node of ``edges``; root is the least node of its component.

    Up to ``few`` distinct edges, counted first, are linked by one task.

    Null ends and self-loops link nothing; repeated and reversed edges count once.
    Large-star and small-star steps alternate until the edge set is a forest of
    stars. Every step is an aggregation with map-side combine plus an equi-join
    that AQE may split, so a component of any size needs no single task. Each
    round is written to the shared folder, which cuts lineage.
    """
    now = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null and u <> v").distinct()
    now = write_table(now, "cc")
    if few and now.count() <= few:
        return _by_one_task(now)
    down = now.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    if _is_forest_of_stars(down):
        now = write_table(down, "cc")
    else:
        for _ in range(max_rounds):
            old, now = now, write_table(_small_star(_large_star(now)), "cc")
            drop_tables(old)
            if _is_forest_of_stars(now):
                break
        else:
            raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(roots)


def components_of(nodes: DataFrame, edges: DataFrame, node: str = "word_id") -> DataFrame:
    """(node, root, class_id): isolated nodes are components of their own; class ids are dense from 0 in order of root."""
    found = connected_components(edges, few=FEW)
    out = (
        nodes.select(node).distinct()
        .join(found.withColumnRenamed("node", node), node, "left")
        .select(node, F.coalesce("root", node).alias("root"))
    )
    ids = class_ids(out)
    return out.join(ids, "root").select(node, "root", "class_id")


def class_ids(labels: DataFrame) -> DataFrame:
    """(root, class_id): dense from 0 in order of root, without ranking all rows in one task.

    Roots are range-partitioned; each partition numbers its own rows and adds
    the counts of the partitions before it, a table of one row per partition.
    """
    roots = write_table(
        labels.select("root").distinct().repartitionByRange("root").sortWithinPartitions("root")
        .withColumn("part", F.spark_partition_id()), "roots")
    sizes = roots.groupBy("part").agg(F.count("*").alias("n"))
    before = sizes.select("part", (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("before"))
    local = roots.withColumn("k", F.row_number().over(W.partitionBy("part").orderBy("root")) - 1)
    return local.join(F.broadcast(before), "part").select("root", (F.col("before") + F.col("k")).cast("long").alias("class_id"))


def class_sizes(labels: DataFrame) -> DataFrame:
    """(class_id, size)."""
    return labels.groupBy("class_id").agg(F.count("*").alias("size"))


def edges_at(similarity: DataFrame, threshold: float, weight: str = "cosine") -> DataFrame:
    """Edges (a, b) whose weight, as a 32-bit float, reaches the threshold."""
    return similarity.where(F.col(weight).cast("float") >= F.lit(threshold).cast("float")).select(F.col("wa").alias("a"), F.col("wb").alias("b"))


def update_components(labels: DataFrame, added: DataFrame, removed: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, root) after edges (a, b) were added and removed; ``labels`` (node, root) held before, ``edges`` are all that are there now.

    A class that lost an edge falls back to its nodes and is linked again by the
    edges it still has; of all others only the root takes part, where an added edge
    meets it. New nodes may come with added edges. ``labels`` is read several
    times: write it first.
    """
    ends = lambda df: df.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    broken = labels.join(ends(removed), "node", "left_semi").select("root").distinct()
    loose = labels.join(broken, "root", "left_semi").select("node")
    # What stands for each node: itself in a broken class, else its root.
    stand = write_table(labels.join(broken.withColumn("loose", F.lit(True)), "root", "left").select("node", F.when(F.col("loose"), F.col("node")).otherwise(F.col("root")).alias("root")), "stand")
    inner = edges.join(loose.withColumnRenamed("node", "a"), "a", "left_semi")
    met = added.join(stand.select(F.col("node").alias("a"), F.col("root").alias("ra")), "a", "left").join(stand.select(F.col("node").alias("b"), F.col("root").alias("rb")), "b", "left")
    links = inner.select("a", "b").unionByName(met.select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b")))
    # An edge of a broken class that is new stands here by its nodes and by what stands for them.
    moved = write_table(connected_components(links, few=FEW), "moved")
    fresh = ends(added).join(labels, "node", "left_anti")
    every = stand.unionByName(fresh.select("node", F.col("node").alias("root")))
    return every.join(moved.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left").select("node", F.coalesce("top", "root").alias("root"))


def _kruskal(edges: DataFrame) -> DataFrame:
    """(a, b, weight) of the forest of few edges (u, v, k, a, b), by one task."""
    ensure_importable(edges.sparkSession)
    schema = StructType().add("a", edges.schema["a"].dataType).add("b", edges.schema["b"].dataType).add("weight", edges.schema["weight"].dataType)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        up: dict = {}
        rows = [r for batch in batches for r in zip(*(batch.column(i).to_pylist() for i in range(5)))]
        rows.sort(key=lambda r: (-r[2], r[3], r[4]))
        kept = [(a, b, w) for u, v, w, a, b in rows if _join(up, u, v)]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in kept], f.type) for i, f in enumerate(arrow)], schema=arrow)

    return edges.select("u", "v", "weight", "a", "b").coalesce(1).mapInArrow(run, schema)


def spanning_forest(edges: DataFrame, weight: str = "weight", few: int = FEW) -> DataFrame:
    """(a, b, weight), a < b: the maximum spanning forest of edges (a, b, ``weight``), ties by a and b.

    Nodes joined by edges of at least some weight are those that the forest's edges
    of that weight join, for every weight. Borůvka's rounds: each part takes its best
    edge, parts so linked become one, and of parallel edges the best stays; every
    round at least halves the parts. What has ``few`` edges left, counted each
    round, is finished by one task. Self-loops and null ends or weights link nothing.
    """
    pair = edges.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v"), F.col(weight).alias("weight")).where("u < v and weight is not null")
    now = write_table(pair.groupBy("u", "v").agg(F.max("weight").alias("weight")).select("u", "v", "weight", F.col("u").alias("a"), F.col("v").alias("b")), "forest")
    out = None
    best = lambda *more: F.min(F.struct((-F.col("weight")).alias("less"), "a", "b", *more)).alias("e")
    while True:
        last = now.count() <= few
        if last:
            found = write_table(_kruskal(now), "forest")
        else:
            both = now.select(F.col("u").alias("part"), F.col("v").alias("other"), "weight", "a", "b").unionByName(now.select(F.col("v").alias("part"), F.col("u").alias("other"), "weight", "a", "b"))
            chosen = write_table(both.groupBy("part").agg(best("other")).select("part", "e.other", "e.a", "e.b", (-F.col("e.less")).alias("weight")), "chosen")
            found = write_table(chosen.select("a", "b", "weight").distinct(), "forest")
        out = found if out is None else out.unionByName(found)
        if last:
            drop_tables(now)
            return out
        top = write_table(connected_components(chosen, "part", "other", few=few), "parts")
        moved = now.join(top.select(F.col("node").alias("u"), F.col("root").alias("ru")), "u").join(top.select(F.col("node").alias("v"), F.col("root").alias("rv")), "v").where("ru <> rv")
        old, now = now, write_table(moved.groupBy(F.least("ru", "rv").alias("u"), F.greatest("ru", "rv").alias("v")).agg(best()).select("u", "v", (-F.col("e.less")).alias("weight"), "e.a", "e.b"), "forest")
        drop_tables(old, chosen, top)
        if now.isEmpty():
            drop_tables(now)
            return out


def threshold_sweep(nodes: DataFrame, similarity: DataFrame, thresholds: list[float], node: str = "word_id", weight: str = "cosine", few: int = FEW) -> DataFrame:
    """(idx, threshold, components, is_knee) for thresholds from high to low.

    An edge links where its weight, as a 32-bit float, reaches the threshold. All
    counts come from one spanning forest: each of its edges at or above a threshold
    leaves one component less. The knee is the threshold with the largest drop to
    the next one's count; the first wins ties, and without any drop the first
    threshold is the knee.
    """
    edges = similarity.select(F.col("wa").alias("a"), F.col("wb").alias("b"), F.col(weight).cast("float").alias("weight"))
    forest = spanning_forest(edges, few=few)
    reach = [F.count_if(F.col("weight") >= F.lit(float(t)).cast("float")).alias(f"n{i}") for i, t in enumerate(thresholds)]
    total, merged = nodes.select(node).distinct().count(), forest.agg(*reach).first()
    left = [total - merged[i] for i in range(len(thresholds))]
    drops = [a - b for a, b in zip(left, left[1:])]
    knee = drops.index(max(drops)) if drops and max(drops) > 0 else 0
    return nodes.sparkSession.createDataFrame([(i, float(t), n, i == knee) for i, (t, n) in enumerate(zip(thresholds, left))], "idx int, threshold double, components long, is_knee boolean")


def class_entropy(labels: DataFrame) -> DataFrame:
    """One row: -sum p log2 p over class sizes, p against all labelled nodes."""
    sizes = class_sizes(labels)
    total = sizes.agg(F.sum("size").alias("total"))
    p = F.col("size") / F.col("total")
    return sizes.crossJoin(F.broadcast(total)).agg(F.coalesce(-F.sum(p * F.log2(p)), F.lit(0.0)).alias("entropy"), F.count("*").alias("classes"))
