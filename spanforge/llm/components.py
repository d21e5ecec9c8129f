"""Connected components of an edge list by alternating stars, with a checkpoint a round."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanforge.llm.common import checkpointed

#: Edges that a task contracts at once, which bounds its memory.
EDGES_AT_ONCE = 1 << 20
#: Edges that a task gets on average. Tasks follow these and not the session's shuffle partitions: the fewer edges a task holds, the less it contracts.
EDGES_A_TASK = 1 << 16


def local_stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, least node of its component) of all nodes of these edges."""
    nodes, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = ends[: u.size], ends[u.size :]
    least = np.arange(nodes.size)
    while (apart := np.flatnonzero(least[a] != least[b])).size:
        a, b = a[apart], b[apart]
        np.minimum.at(least, np.maximum(least[a], least[b]), np.minimum(least[a], least[b]))
        while not np.array_equal(least, higher := least[least]):
            least = higher
    return nodes, nodes[least]


def contracted(edges: DataFrame) -> DataFrame:
    """The same components from the edges (u, v) of each task, with its chains pulled to stars round their least nodes, which have an edge to themselves."""

    def work(batches):
        held, n = [], 0

        def stars():
            u, v = local_stars(*(np.concatenate([b.column(c).to_numpy() for b in held]) for c in ("u", "v")))
            return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= EDGES_AT_ONCE:
                yield stars()
                held, n = [], 0
        if n:
            yield stars()

    return edges.mapInArrow(work, "u long, v long")


def _both_ways(e: DataFrame) -> DataFrame:
    return e.select(F.inline(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))))


def _to_least(pairs: DataFrame) -> DataFrame:
    """Each (u, v) with the least of u and all v of that u."""
    return pairs.withColumn("m", F.least("u", F.min("v").over(Window.partitionBy("u"))))


def _all_stars(e: DataFrame) -> bool:
    """Whether every node has one edge down at most, and none that has it has one from above."""
    below = F.when(F.col("v") < F.col("u"), F.col("v"))
    ends = _both_ways(e.where("u <> v")).groupBy("u").agg(F.min(below).alias("least"), F.max(below).alias("most"), F.max(F.col("v") > F.col("u")).alias("above"))
    return ends.agg(F.count_if(F.expr("least < most or (least is not null and above)"))).first()[0] == 0


def connected_components(edges: DataFrame, forests: bool = False) -> DataFrame:
    """(node, component) of every node of edges (a, b); a component is its smallest node. Edges from a node to itself name it only.

    Tasks first contract the edges they are given, without a shuffle; not so ``forests``, which Python has just made in the same tasks: there is little to contract in them, and each task
    would hold a second Python worker. What is left goes to as many tasks as it needs, which contract it again; one task of at
    most EDGES_A_TASK edges is done then. With more, a large star links a node's larger neighbours to its least one, a small star the smaller ones; each round of these and of
    contraction keeps the components and brings every node nearer to the least, until all edges are stars. A star takes one shuffle. The edges are computed once.
    """
    given = edges.select(F.greatest("a", "b").cast("long").alias("u"), F.least("a", "b").cast("long").alias("v"))
    e = checkpointed(given if forests else contracted(given))
    tasks = max(1, -(-e.count() // min(EDGES_A_TASK, EDGES_AT_ONCE)))
    e = checkpointed(contracted(e.coalesce(tasks)))
    while tasks > 1 and not _all_stars(e):
        large = _to_least(_both_ways(e)).where("v > u or (v = u and m = u)").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = _to_least(large).select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        e = checkpointed(contracted(small.coalesce(tasks)))
    named = e if tasks == 1 else e.groupBy("u").agg(F.min("v").alias("v"))
    return named.select(F.col("u").alias("node"), F.col("v").alias("component"))
