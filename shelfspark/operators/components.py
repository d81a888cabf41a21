"""Connected components by alternating large-star and small-star rewrites.

Each round rewrites the edge list with a pre-aggregated minimum per node and a
join back, so a hub never meets all its neighbours in one task's memory, and
cuts lineage with a checkpoint. The number of rounds is logarithmic in practice.
A caller may let short edge lists of longs be settled in one task instead.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut


def _linked_min(pairs: DataFrame) -> DataFrame:
    """(u, v) -> (u, v, m) with m the least of u and its listed neighbours."""
    least = pairs.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return pairs.join(least, "u")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return (
        _linked_min(both)
        .filter("v > u")
        .select(F.col("v").alias("u"), F.col("m").alias("v"))
        .filter("u <> v")
        .distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    linked = _linked_min(down)
    return (
        linked.select(F.col("v").alias("u"), F.col("m").alias("v"))
        .unionByName(linked.select("u", F.col("m").alias("v")))
        .filter("u <> v")
        .distinct()
    )


def _all_stars(edges: DataFrame) -> bool:
    """Whether each node is the centre of its edges or has just one edge, to a centre below it."""
    ends = edges.select(F.col("u").alias("n"), F.lit(1).alias("child"), F.lit(0).alias("centre"))
    ends = ends.unionByName(edges.select(F.col("v").alias("n"), F.lit(0).alias("child"), F.lit(1).alias("centre")))
    roles = ends.groupBy("n").agg(F.sum("child").alias("child"), F.max("centre").alias("centre"))
    return roles.filter("child > 1 or (child = 1 and centre = 1)").isEmpty()


def _in_one_task(edges: DataFrame) -> DataFrame:
    """(node, component) of a short list of longs; a root is hung below the least root that it meets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends = [[c.to_numpy() for c in batch.columns] for batch in batches if batch.num_rows]
        if not ends:
            return
        u, v = (np.concatenate(c) for c in zip(*ends, strict=True))
        ids, at = np.unique(np.concatenate([u, v]), return_inverse=True)
        a, b = at[: len(u)], at[len(u) :]
        root = np.arange(len(ids))
        while (root[a] != root[b]).any():
            x, y = root[a], root[b]
            np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
            while (root[root] != root).any():
                root = root[root]
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(ids[root])], names=["node", "component"])

    return edges.coalesce(1).mapInArrow(run, "node long, component long")


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60, at_once: int = 0) -> DataFrame:
    """Rows (node, component) for every node with an edge to another node.

    component is the smallest node of the component. Self loops, repeated edges
    and null ends are ignored; an empty edge list gives no rows. Up to at_once
    different edges between longs are settled in one task, more in rounds.
    """
    e = cut(
        edges.select(F.col(src).alias("u"), F.col(dst).alias("v"))
        .filter("u is not null and v is not null and u <> v")
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct()
    )
    if at_once and {kind for _, kind in e.dtypes} == {"bigint"} and e.count() <= at_once:
        return cut(_in_one_task(e))
    for _ in range(max_rounds):
        if not e.isEmpty() and not _all_stars(e):
            e = cut(_small_star(_large_star(e)))
        else:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
