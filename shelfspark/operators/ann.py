"""Cell-pruned and product-quantised vector search over tables.

Centroids and codebooks are learned on a bounded sample; every row is indexed.
The cell is a partition column, so a probe prunes files. A graph index is a graph of
neighbours for each shard of rows, searched best first by its own task. Recall is
measured against exact search.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut
from .retrieval import BROADCAST_ROWS, dense_top_k, recall_at, scan_blocks, sized, top_k
from .retrieval import _blocks as blocks

SAMPLE_ROWS = 20_000
#: Rows of a shard of a graph, and queries that are searched in it at once.
SHARD_ROWS, GRAPH_QUERIES = 8000, 100
#: Digits of scores, so that equal vectors tie whatever the order of summation.
DIGITS = 9


def _lloyd(x: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    """k-means centroids of the rows of x; an empty cell keeps its place."""
    rng = np.random.default_rng(seed)
    k = min(k, len(x))
    c = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        near = (x @ c.T * 2 - (c * c).sum(1)).argmax(1)
        n = np.bincount(near, minlength=k)
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        c[n > 0] = sums[n > 0] / n[n > 0, None]
    return c


def training_sample(rows: DataFrame, most: int = SAMPLE_ROWS) -> np.ndarray:
    """At most `most` vectors, chosen by a hash of the id."""
    got = rows.filter("v is not null").orderBy(F.xxhash64("id"), "id").limit(most).select("v").toPandas()
    return np.stack(got["v"].to_numpy()).astype(np.float64) if len(got) else np.zeros((0, 1))


def train_cells(rows: DataFrame, nlist: int, rounds: int = 10, seed: int = 0, sample: int = SAMPLE_ROWS) -> np.ndarray:
    return _lloyd(training_sample(rows, sample), nlist, rounds, seed)


def assign_cells(rows: DataFrame, centroids: np.ndarray) -> DataFrame:
    """rows (id, v) with the nearest cell."""
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            if len(p):
                x = np.stack(p["v"].to_numpy()).astype(np.float64)
                yield p.assign(cell=(x @ centroids.T * 2 - (centroids**2).sum(1)).argmax(1).astype(np.int32))

    kind = rows.schema["id"].dataType.simpleString()
    return rows.select("id", "v").filter("v is not null").mapInPandas(run, f"id {kind}, v array<float>, cell int")


def write_index(rows: DataFrame, centroids: np.ndarray, path: str) -> None:
    """Vectors partitioned by cell, the centroids and a manifest beside them."""
    spark = rows.sparkSession
    assign_cells(rows, centroids).write.mode("overwrite").partitionBy("cell").parquet(f"{path}/vectors")
    spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centroids)], "cell int, c array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/centroids")
    manifest = {"nlist": len(centroids), "dim": int(centroids.shape[1]), "rows": spark.read.parquet(f"{path}/vectors").count()}
    spark.createDataFrame([(json.dumps(manifest),)], "manifest string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")


def read_manifest(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(f"{path}/manifest").first()[0])


def read_index(spark: SparkSession, path: str) -> tuple[np.ndarray, DataFrame]:
    """Centroids and the rows (id, v, cell) of a written index."""
    got = spark.read.parquet(f"{path}/centroids").orderBy("cell").collect()
    return np.array([r.c for r in got]), spark.read.parquet(f"{path}/vectors")


def merge_indexes(spark: SparkSession, paths: list[str], path: str) -> dict:
    """Vectors of indexes that share their centroids, with summed manifests."""
    rows = [read_manifest(spark, p) for p in paths]
    if len({(m["nlist"], m["dim"]) for m in rows}) != 1:
        raise ValueError("indexes differ in shape")
    whole = None
    for p in paths:
        part = spark.read.parquet(f"{p}/vectors")
        whole = part if whole is None else whole.unionByName(part)
    whole.write.mode("overwrite").partitionBy("cell").parquet(f"{path}/vectors")
    spark.read.parquet(f"{paths[0]}/centroids").write.mode("overwrite").parquet(f"{path}/centroids")
    manifest = rows[0] | {"rows": sum(m["rows"] for m in rows)}
    spark.createDataFrame([(json.dumps(manifest),)], "manifest string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")
    return manifest


def probes(queries: DataFrame, centroids: np.ndarray, nprobe: int) -> DataFrame:
    """(qid, v, cell) of the cells nearest to each query."""
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            if len(p):
                x = np.stack(p["v"].to_numpy()).astype(np.float64)
                near = np.argsort(-(x @ centroids.T * 2 - (centroids**2).sum(1)), axis=1, kind="stable")[:, :nprobe]
                at = np.repeat(np.arange(len(p)), near.shape[1])
                yield p.iloc[at].assign(cell=near.ravel().astype(np.int32))

    kind = queries.schema["qid"].dataType.simpleString()
    return queries.select("qid", "v").mapInPandas(run, f"qid {kind}, v array<float>, cell int")


def _scored(pairs: DataFrame) -> DataFrame:
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            if len(p):
                a, b = (np.stack(p[c].to_numpy()).astype(np.float64) for c in ("qv", "v"))
                yield p[["qid", "id"]].assign(score=np.round((a * b).sum(1), DIGITS))

    q, i = (pairs.schema[c].dataType.simpleString() for c in ("qid", "id"))
    return pairs.select("qid", "id", "qv", "v").mapInPandas(run, f"qid {q}, id {i}, score double")


def ivf_search(queries: DataFrame, index: DataFrame, centroids: np.ndarray, k: int, nprobe: int) -> DataFrame:
    """Top k by inner product among the rows of the probed cells."""
    asked = probes(queries, centroids, nprobe).withColumnRenamed("v", "qv")
    return top_k(_scored(asked.join(index, "cell")), k, ["qid"])


class ProductCodes:
    """Codebooks of equal slices of a vector."""

    def __init__(self, sample: np.ndarray, m: int, bits: int, rounds: int = 8, seed: int = 0):
        if sample.shape[1] % m:
            raise ValueError("the dimension is a multiple of m")
        self.m, self.width = m, sample.shape[1] // m
        self.books = [_lloyd(sample[:, i * self.width : (i + 1) * self.width], 1 << bits, rounds, seed + i) for i in range(m)]

    def encode(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros((len(x), self.m), np.int16)
        for i, c in enumerate(self.books):
            part = x[:, i * self.width : (i + 1) * self.width]
            out[:, i] = (part @ c.T * 2 - (c * c).sum(1)).argmax(1)
        return out

    def table(self, q: np.ndarray) -> list[np.ndarray]:
        """Inner products of a query's slices with all codewords."""
        return [c @ q[i * self.width : (i + 1) * self.width] for i, c in enumerate(self.books)]


def encode_codes(rows: DataFrame, codes: ProductCodes) -> DataFrame:
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            if len(p):
                x = np.stack(p["v"].to_numpy()).astype(np.float64)
                yield pd.DataFrame({"id": p["id"].to_numpy(), "code": list(codes.encode(x))})

    kind = rows.schema["id"].dataType.simpleString()
    return rows.select("id", "v").filter("v is not null").mapInPandas(run, f"id {kind}, code array<short>")


def pq_search(queries: DataFrame, coded: DataFrame, codes: ProductCodes, k: int, rerank: DataFrame | None = None, wide: int = 10) -> DataFrame:
    """Top k by table look-ups over codes; with `rerank` (id, v) the best wide * k are scored exactly."""
    take = k * wide if rerank is not None else k

    def score(x: np.ndarray, q: np.ndarray) -> np.ndarray:
        x, out = x.astype(np.int64), np.zeros((len(x), len(q)))
        for j, v in enumerate(q):
            out[:, j] = sum(t[x[:, i]] for i, t in enumerate(codes.table(v)))
        return np.round(out, DIGITS)

    best = scan_blocks(queries, coded, take, score, "code")
    if rerank is None:
        return best
    pairs = best.select("qid", "id").join(rerank, "id").join(queries.select("qid", F.col("v").alias("qv")), "qid")
    return top_k(_scored(pairs), k, ["qid"])


class Graph:
    """Neighbour graphs of shards: one row (ids, m, near, entries) a shard, with places in its ids; near has `width` places a row, -1 where there are fewer."""

    def __init__(self, shards: DataFrame, width: int):
        self.shards, self.width = shards, width

    @property
    def edges(self) -> DataFrame:
        """(id, near) of all shards."""
        width = self.width
        some = self.shards.select("ids", "near", F.posexplode("ids").alias("at", "id"))
        places = F.filter(F.slice("near", F.col("at") * width + 1, width), lambda x: x >= 0)
        return some.select("id", F.explode(F.transform(places, lambda x: F.get("ids", x))).alias("near"))


def _best(row: np.ndarray, near: np.ndarray, score: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The m best different neighbours of each row, and their places among those of the row."""
    order = np.lexsort((near, -score, row))
    row, near, score = row[order], near[order], score[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (near[1:] != near[:-1])
    row, near, score = row[new], near[new], score[new]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    keep = place < m
    return row[keep], near[keep], score[keep], place[keep]


def _shard_graph(x: np.ndarray, m: int, nlist: int, nprobe: int) -> tuple[np.ndarray, np.ndarray]:
    """(near, entries): the m nearest rows of each within its nearest cells, both ways, at most 2 m each; entries reach every row."""
    n = len(x)
    c = _lloyd(x, nlist, 10, 0)
    probed = np.argsort(-(x @ c.T * 2 - (c * c).sum(1)), axis=1, kind="stable")[:, :nprobe]
    home, found = probed[:, 0], [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    for cell in range(len(c)):
        inside, asking = np.flatnonzero(home == cell), np.flatnonzero((probed == cell).any(1))
        k = min(m + 1, len(inside))
        for lo in range(0, len(asking) if k else 0, 1000):
            some = asking[lo : lo + 1000]
            score = np.round(x[some] @ x[inside].T, DIGITS)
            top = np.argpartition(-score, k - 1, axis=1)[:, :k]
            row, near = np.repeat(some, k), inside[top].ravel()
            other = row != near
            found.append((row[other], near[other], np.take_along_axis(score, top, 1).ravel()[other]))
    row, near, score, _ = _best(*(np.concatenate(f) for f in zip(*found, strict=True)), m)
    row, near, _, place = _best(np.concatenate([row, near]), np.concatenate([near, row]), np.concatenate([score, score]), 2 * m)
    table = np.full((n, 2 * m), -1, np.int32)
    table[row, place] = near
    entries = np.unique(home, return_index=True)[1].tolist()
    seen = np.zeros(n, bool)
    fresh = np.array(entries)
    while True:
        while len(fresh):
            seen[fresh] = True
            fresh = np.unique(table[fresh])
            fresh = fresh[fresh >= 0]
            fresh = fresh[~seen[fresh]]
        if seen.all():
            return table, np.array(entries, np.int32)
        fresh = np.flatnonzero(~seen)[:1]
        entries.append(int(fresh[0]))


def build_graph(rows: DataFrame, m: int = 16, nlist: int = 16, nprobe: int = 4) -> Graph:
    """Graphs of rows (id, v) in shards of some SHARD_ROWS: the m nearest of each within the nearest cells of its shard, both ways, at most 2 m each.

    A row of each cell is an entry, and so is one of each part that these do not reach.
    """
    kind = rows.schema["id"].dataType.simpleString()
    rows = rows.select("id", "v").filter("v is not null")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        p = pd.concat(list(parts) or [pd.DataFrame({"id": [], "v": []})])
        if len(p):
            p = p.sort_values("id", kind="stable")
            x = np.stack(p["v"].to_numpy()).astype(np.float64)
            near, entries = _shard_graph(x, m, nlist, nprobe)
            yield pd.DataFrame({"ids": [p["id"].to_numpy()], "m": [x.astype(np.float32).ravel()], "near": [near.ravel()], "entries": [entries]})

    shards = rows.repartition(max(1, -(-rows.count() // SHARD_ROWS)), "id")
    return Graph(cut(shards.mapInPandas(run, f"ids array<{kind}>, m array<float>, near array<int>, entries array<int>")), 2 * m)


def _walk(x: np.ndarray, near: np.ndarray, entries: np.ndarray, q: np.ndarray, ef: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, scores) of the ef best rows that are reached: those are followed until all have been; ties by the lesser place."""
    seen, done, score = np.zeros(len(x), bool), np.zeros(len(x), bool), np.zeros(len(x))
    pool, new = np.zeros(0, np.int64), np.unique(entries)
    while True:
        seen[new] = True
        score[new] = np.round(x[new] @ q, DIGITS)
        pool = np.concatenate([pool, new])
        if len(pool) > ef:
            pool = pool[np.lexsort((pool, -score[pool]))[:ef]]
        fresh = pool[~done[pool]]
        if not len(fresh):
            return pool, score[pool]
        done[fresh] = True
        new = np.unique(near[fresh])
        new = new[new >= 0]
        new = new[~seen[new]]


def graph_search(queries: DataFrame, graph: Graph, rows: DataFrame, k: int, ef: int) -> DataFrame:
    """Top k by inner product, best first in each shard: the ef best rows seen so far are followed to their neighbours until all have been."""
    kind, qkind = rows.schema["id"].dataType.simpleString(), queries.schema["qid"].dataType.simpleString()
    width, most = graph.width, max(ef, k)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            for ids, m, near, entries, qids, qm in p.itertuples(index=False):
                x, q = np.asarray(m, np.float64).reshape(len(ids), -1), np.asarray(qm).reshape(len(qids), -1)
                near, hits = np.asarray(near).reshape(len(ids), width), []
                for qid, v in zip(qids, q, strict=True):
                    place, score = _walk(x, near, np.asarray(entries), v, most)
                    order = np.lexsort((place, -score))[:k]  # ids rise with places
                    hits.append(pd.DataFrame({"qid": qid, "id": np.asarray(ids)[place[order]], "score": score[order]}))
                if hits:
                    yield pd.concat(hits)

    asked = blocks(queries, "qid", "v", GRAPH_QUERIES, "q", False)
    pairs = graph.shards.crossJoin(sized(asked, BROADCAST_ROWS // GRAPH_QUERIES)).select("ids", "m", "near", "entries", "qids", "qm")
    return top_k(pairs.mapInPandas(run, f"qid {qkind}, id {kind}, score double"), k, ["qid"])


def reaching(search: Callable[[int], DataFrame], truth: DataFrame, k: int, width: int, most: int, least: float = 0.9) -> tuple[int, DataFrame]:
    """(width, recall per query) of a search whose width doubles until its mean recall against exact search is `least`.

    Raises ValueError if the greatest width does not reach it.
    """
    while True:
        recall = cut(recall_at(search(width), truth, k))
        mean = recall.agg(F.avg("recall")).first()[0]
        if mean is None or mean >= least:
            return width, recall
        if width >= most:
            raise ValueError(f"a recall of {mean} at the greatest width")
        width = min(2 * width, most)


def with_match(hits: DataFrame, metadata: DataFrame, key: str = "id") -> DataFrame:
    """Hits with the columns of metadata, prefixed match_."""
    named = metadata.select(F.col(key).alias("id"), *(F.col(c).alias(f"match_{c}") for c in metadata.columns))
    return hits.join(named, "id").orderBy("qid", "rank")


__all__ = ["dense_top_k", "ivf_search", "pq_search", "reaching"]
