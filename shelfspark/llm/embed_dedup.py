"""Embedding near-dedup by cross-polytope hashing.

Vectors are rotated by `CHAINS` rounds of random signs and a fast Hadamard
transform; a hash is the signed axis nearest to the rotated vector. A table's
bucket joins `HASHES` such values, and the next-best axes by loss are probed too.
Rows meet in a bucket when one's own bucket is a probe of the other. Distinct
candidate pairs are verified by cosine in double precision.

Equal vectors are one class before hashing, so groups of copies make no pairs;
links count every vector of a class. Classes have numbers of their own, whatever
their ids; rows find their class by a 128-bit hash of the vector. Classes meet on
(bucket, number) keys and pairs are distinct before vectors are read, so nothing
but true neighbours is carried more than once. A bucket that holds many classes
is split by their numbers before it is joined.

Vectors that are null, empty, zero, or hold null or non-finite components, link
with nothing and are kept. Vectors of other lengths never meet. Ids are of any type
that has an order. Each row counts as a vector, also if it repeats another or
shares its id with other vectors: it reports its own vector's class, whose id is the
least that any of the class has. Null ids are rows without links. Very long vectors
are worked off in batches of bounded size. Other columns are not read, so their
names can't clash. Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components
from ..operators.skew import salted_join
from ..session import cut

THRESHOLD = 0.9
TABLES = 12
HASHES = 3
PROBES = 8
CHAINS = 3
SEED = 20


def _hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of the rows; their length is a power of two."""
    n, h = x.shape[1], 1
    while h < n:
        y = x.reshape(len(x), n // (2 * h), 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], 2).reshape(len(x), n)
        h *= 2
    return x


def buckets(x: np.ndarray, tables: int = TABLES, hashes: int = HASHES, probes: int = PROBES, seed: int = SEED) -> np.ndarray:
    """For each unit row and table: 1 own bucket and `probes` next buckets, as integers."""
    rows, dim = x.shape
    wide = 1 << max(1, (dim - 1).bit_length())
    x = np.pad(x, ((0, 0), (0, wide - dim)))
    out = np.zeros((rows, tables, probes + 1), np.int64)
    rng = np.random.default_rng([seed, dim])
    near = min(2 * wide, probes + 1)
    for t in range(tables):
        axes, losses = [], []
        for _ in range(hashes):
            y = x
            for _ in range(CHAINS):
                y = _hadamard(y * rng.choice([-1.0, 1.0], wide)) / np.sqrt(wide)
            both = np.concatenate([y, -y], 1)
            at = np.argpartition(-both, near - 1, axis=1)[:, :near]
            value = np.take_along_axis(both, at, 1)
            order = np.lexsort((at, -value), axis=1)
            at, value = np.take_along_axis(at, order, 1), np.take_along_axis(value, order, 1)
            axes.append(at)
            losses.append((value[:, :1] - value) ** 2)
        codes, loss = axes[0], losses[0]
        for a, b in zip(axes[1:], losses[1:], strict=True):
            codes = (codes[:, :, None] * (2 * wide) + a[:, None, :]).reshape(rows, -1)
            loss = (loss[:, :, None] + b[:, None, :]).reshape(rows, -1)
            best = np.argsort(loss, axis=1, kind="stable")[:, : probes + 1]
            codes, loss = np.take_along_axis(codes, best, 1), np.take_along_axis(loss, best, 1)
        out[:, t, : codes.shape[1]] = codes
        out[:, t, codes.shape[1] :] = codes[:, :1]
    return out


def _usable(v: str) -> F.Column:
    c = F.col(v)
    finite = F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return c.isNotNull() & (F.size(c) > 0) & finite & F.exists(c, lambda x: x != 0)


def _own_and_probes(classes: DataFrame, tables: int, hashes: int, probes: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            lists = batch.column(1)
            size = lists.value_lengths().to_numpy()
            values = lists.flatten().to_numpy().astype(np.float64)
            first = np.cumsum(size) - size
            for dim in np.unique(size).tolist():
                rows = np.flatnonzero(size == dim)
                for part in np.array_split(rows, -(-len(rows) // 2000)):
                    x = values[first[part][:, None] + np.arange(dim)]
                    x = x / np.abs(x).max(1, keepdims=True)
                    code = buckets(x / np.linalg.norm(x, axis=1, keepdims=True), tables, hashes, probes)
                    n, t, p = code.shape
                    yield pa.RecordBatch.from_arrays([
                        pa.array(np.repeat(ids[part], t * p)),
                        pa.array(np.tile(np.repeat(np.arange(t, dtype=np.int32) + tables * dim, p), n), pa.int32()),
                        pa.array(code.ravel()),
                        pa.array(np.tile(np.arange(p) == 0, n * t)),
                    ], names=["c", "t", "b", "own"])

    return classes.mapInArrow(run, "c long, t int, b long, own boolean").distinct()


def _cosine(pairs: DataFrame, threshold: float) -> DataFrame:
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for lo in range(0, len(part), 4000):
                p = part.iloc[lo : lo + 4000]
                for _, q in p.groupby(p["va"].map(len), sort=False):
                    x, y = (np.stack(q[k].to_numpy()).astype(np.float64) for k in ("va", "vb"))
                    x, y = x / np.abs(x).max(1, keepdims=True), y / np.abs(y).max(1, keepdims=True)
                    cos = (x * y).sum(1) / np.sqrt((x * x).sum(1) * (y * y).sum(1))
                    yield q.loc[cos >= threshold, ["a", "b"]]

    return pairs.mapInPandas(run, "a long, b long")


def _rows(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """(id, v, k1, k2) of each row; v and its hash are null where it links with nothing."""
    rows = vectors.select(F.col(vec_id).alias("id"), F.col(embedding).alias("v"))
    plain = F.transform("v", lambda x: x.cast("double") + F.lit(0.0))
    rows = rows.withColumn("v", F.when(_usable("v") & F.col("id").isNotNull(), plain))
    key = lambda seed: F.when(F.col("v").isNotNull(), F.xxhash64(F.lit(seed), "v"))
    return rows.withColumns({"k1": key(1), "k2": key(2)})


def classes_of(rows: DataFrame) -> DataFrame:
    """(c, n, low, k1, k2, v) for each distinct usable vector: its number, count of rows and least id."""
    usable = rows.filter("v is not null")
    grouped = usable.groupBy("k1", "k2").agg(F.min("v").alias("v"), F.min("id").alias("low"), F.count("*").alias("n"))
    return cut(grouped.withColumn("c", F.monotonically_increasing_id()))


def near_vectors(
    vectors: DataFrame,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
    threshold: float = THRESHOLD,
    tables: int = TABLES,
    hashes: int = HASHES,
    probes: int = PROBES,
) -> DataFrame:
    """One row per row of vectors: vec_id, n_links, component_id (of the type of vec_id), kept."""
    rows = _rows(vectors, vec_id, embedding)
    classes = classes_of(rows)
    spread = cut(_own_and_probes(classes.select("c", "v"), tables, hashes, probes))
    mine, probe = spread.filter("own").select("t", "b", F.col("c").alias("x")), spread.select("t", "b", F.col("c").alias("y"))
    met = salted_join(mine, probe, ["t", "b"], "x")
    pairs = met.filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    left, right = classes.select(F.col("c").alias("a"), F.col("v").alias("va")), classes.select(F.col("c").alias("b"), F.col("v").alias("vb"))
    candidates = pairs.join(left, "a").join(right, "b").filter(F.size("va") == F.size("vb")).select("a", "b", "va", "vb")
    links = cut(_cosine(candidates, threshold))
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    size = classes.select("c", "n", "low", "k1", "k2")
    others = both.join(size.select(F.col("c").alias("b"), "n"), "b").groupBy("a").agg(F.sum("n").alias("others")).withColumnRenamed("a", "c")
    comp = connected_components(links, "a", "b").select(F.col("node").alias("c"), "component")
    found = cut(size.join(others, "c", "left").join(comp, "c", "left").withColumn("component", F.coalesce("component", "c")))
    least = found.groupBy("component").agg(F.min("low").alias("component_id"))
    found = found.join(least, "component").select("k1", "k2", (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), "component_id")
    return (
        salted_join(rows.select("id", "k1", "k2"), found, ["k1", "k2"], "id", "left")
        .select(F.col("id").alias(vec_id), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))
        .withColumn("kept", F.coalesce(F.col(vec_id) == F.col("component_id"), F.lit(True)))
    )
