"""Retrieval: exact dense top-k, BM25, rank fusion, mode routing.

Query sets are tables against larger corpora. Both are packed into blocks of rows, and
each pair of blocks is scored by one matrix product and reduced to k hits a query before
the shuffle; neither side comes to the driver, and a side is broadcast only after its
size is checked.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import identifiers, vectors
from ..session import cut

#: Rows of a block of queries and of the corpus, and hits that a task holds before it reduces them.
QUERY_BLOCK, CORPUS_BLOCK, HELD_HITS = 500, 4000, 200_000
#: Queries whose pairs with a block of the corpus are given at once.
PAIR_QUERIES = 50
#: Rows of a side that is broadcast.
BROADCAST_ROWS = 50_000


def sized(rows: DataFrame, bound: int | None = None) -> DataFrame:
    """rows, marked for broadcast if they are few enough."""
    return F.broadcast(rows) if rows.count() <= (BROADCAST_ROWS if bound is None else bound) else rows


def with_rank(hits: DataFrame, by: list[str], score: str = "score", tie: str = "id", out: str = "rank") -> DataFrame:
    """1-based rank by score from the top, ties by the lesser id."""
    return hits.withColumn(out, F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(score), F.asc(tie))).cast("int"))


def top_k(hits: DataFrame, k: int, by: list[str], score: str = "score", tie: str = "id") -> DataFrame:
    return with_rank(hits, by, score, tie).filter(F.col("rank") <= k)


def _blocks(rows: DataFrame, key: str, values: str, size: int, prefix: str, unit: bool) -> DataFrame:
    """(ids, m) per block of at most `size` rows: their keys and their vectors one after another; null vectors are left out."""
    kind = rows.schema[key].dataType.simpleString()

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            p = p[p[values].notna()]
            for lo in range(0, len(p), size):
                x = np.stack(p[values].iloc[lo : lo + size].to_numpy()).astype(np.float64)
                if unit:
                    x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
                yield pd.DataFrame({f"{prefix}ids": [p[key].iloc[lo : lo + size].to_numpy()], f"{prefix}m": [x.ravel()]})

    return rows.select(key, values).mapInPandas(run, f"{prefix}ids array<{kind}>, {prefix}m array<double>")


def scan_blocks(queries: DataFrame, corpus: DataFrame, k: int, score, values: str = "v", unit: bool = False) -> DataFrame:
    """(qid, id, score, rank) of the k best corpus rows (id, `values`) for each query (qid, v).

    score(X, Q) gives the scores of the rows of X (corpus) against those of Q.
    """
    kind, qkind = corpus.schema["id"].dataType.simpleString(), queries.schema["qid"].dataType.simpleString()

    def best(hits: list[pd.DataFrame]) -> pd.DataFrame:
        return pd.concat(hits).sort_values(["qid", "score", "id"], ascending=[True, False, True]).groupby("qid", sort=False).head(k)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        n = fresh = 0
        for p in parts:
            for ids, m, qids, qm in zip(p["ids"], p["m"], p["qids"], p["qm"], strict=True):
                s = score(np.asarray(m).reshape(len(ids), -1), np.asarray(qm).reshape(len(qids), -1))
                for j, q in enumerate(qids):
                    column = s[:, j]
                    some = np.flatnonzero(column >= np.partition(column, len(column) - k)[len(column) - k]) if len(column) > k else np.arange(len(column))
                    order = some[np.lexsort((ids[some], -column[some]))[:k]]
                    held.append(pd.DataFrame({"qid": q, "id": ids[order], "score": column[order]}))
                    fresh += len(order)
            if fresh > HELD_HITS:
                held, fresh = [best(held)], 0
                n = len(held[0])
                if n > HELD_HITS:
                    yield held[0]
                    held = []
        if held:
            yield best(held)

    pairs = _blocks(corpus, "id", values, CORPUS_BLOCK, "", unit).crossJoin(sized(_blocks(queries, "qid", "v", QUERY_BLOCK, "q", unit), BROADCAST_ROWS // QUERY_BLOCK))
    return top_k(pairs.mapInPandas(run, f"qid {qkind}, id {kind}, score double"), k, ["qid"])


def dense_top_k(queries: DataFrame, corpus: DataFrame, k: int, metric: str = "cosine", digits: int | None = None) -> DataFrame:
    """(qid, id, score, rank) of the k best corpus rows (id, v) for each query (qid, v); no rows without queries."""

    def score(x: np.ndarray, q: np.ndarray) -> np.ndarray:
        return x @ q.T if digits is None else np.round(x @ q.T, digits)

    return scan_blocks(queries, corpus, k, score, unit=metric == "cosine")


def article_search(queries: DataFrame, corpus: DataFrame, k: int, metric: str = "cosine", digits: int | None = None, wide: int = 4) -> DataFrame:
    """The k best articles of corpus rows (id, v, article) for each query (qid, v).

    Offers are fetched in excess, twice as many until each query has k articles or
    all offers, so an article with many offers loses none of the others.
    """
    owner, total = corpus.select("id", "article"), corpus.count()
    take = k * wide
    while True:
        hits = cut(dense_top_k(queries, corpus, take, metric, digits).join(owner, "id"))
        if take >= total or hits.groupBy("qid").agg(F.countDistinct("article").alias("n")).filter(F.col("n") < k).isEmpty():
            return article_top_k(hits, k)
        take = min(total, 2 * take)


def tokens(text: Column, least: int = 4, most: int = 40) -> Column:
    """Analyzer: white space, lower case, token length."""
    return F.filter(F.split(F.lower(text), r"\s+"), lambda t: F.length(t).between(least, most))


def bm25(queries: DataFrame, corpus: DataFrame, text: str = "text", k1: float = 1.2, b: float = 0.75, least: int = 4, most: int = 40) -> DataFrame:
    """(qid, id, score) of every corpus row that shares a term with the query (qid, text)."""
    toks = corpus.select("id", tokens(F.col(text), least, most).alias("t"))
    stats = toks.agg(F.count("*").alias("n"), F.avg(F.size("t")).alias("avgdl"))
    wanted = queries.select("qid", F.explode(F.array_distinct(tokens(F.col("text"), least, most))).alias("term"))
    # other terms leave before anything is shuffled
    post = toks.select("id", F.size("t").alias("dl"), F.explode("t").alias("term")).join(sized(wanted.select("term").distinct()), "term", "left_semi")
    post = cut(post.groupBy("id", "dl", "term").agg(F.count("*").alias("tf")))
    df = post.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    scored = post.join(df, "term").crossJoin(F.broadcast(stats)).select("id", "term", weight.alias("w"))
    return scored.join(wanted, "term").groupBy("qid", "id").agg(F.sum("w").alias("score"))


def rrf(legs: list[DataFrame], k: int = 60, top: int | None = None) -> DataFrame:
    """Fused (qid, id, score, rank) of ranked legs (qid, id, rank): sum of 1 / (k + rank)."""
    every = legs[0].select("qid", "id", "rank")
    for leg in legs[1:]:
        every = every.unionByName(leg.select("qid", "id", "rank"))
    fused = every.groupBy("qid", "id").agg(F.sum(1.0 / (k + F.col("rank"))).alias("score"))
    ranked = with_rank(fused.withColumn("score", F.round("score", 12)), ["qid"])
    return ranked if top is None else ranked.filter(F.col("rank") <= top)


def within(candidates: DataFrame, allowed: DataFrame) -> DataFrame:
    """Candidates whose id passes the filters, in their order."""
    return candidates.join(allowed.select("id").distinct(), "id", "left_semi")


def route(queries: DataFrame, ranking_variant: bool = False) -> DataFrame:
    """Queries with `path`: vector for several words, strict for an identifier, else hybrid.

    In the ranking variant several words with an identifier among them are strict too.
    """
    q = F.trim("text")
    many = F.size(F.split(q, r"\s+")) > 1
    strict = identifiers.is_strict_identifier(q)
    if ranking_variant:
        strict = strict | F.exists(F.split(q, r"\s+"), identifiers.is_strict_identifier)
        return queries.filter(q != "").withColumn("path", F.when(strict, "strict").when(many, "vector").otherwise("hybrid"))
    return queries.filter(q != "").withColumn("path", F.when(many, "vector").when(strict, "strict").otherwise("hybrid"))


def search(queries: DataFrame, dense: DataFrame, codes: DataFrame, mode: str = "hybrid_classified", k: int = 10, rrf_k: int = 60, fallback: bool = True, ranking_variant: bool = False) -> DataFrame:
    """(qid, id, score, rank, path) under a retrieval mode, from the ranked legs of all queries.

    A strict query without code hits falls back to fusion.
    """
    if mode == "vector":
        return dense.filter(F.col("rank") <= k).select("qid", "id", "score", "rank", F.lit("vector").alias("path"))
    if mode == "bm25":
        return codes.filter(F.col("rank") <= k).select("qid", "id", "score", "rank", F.lit("bm25").alias("path"))
    fused = rrf([dense, codes], rrf_k, k)
    if mode == "hybrid":
        return fused.withColumn("path", F.lit("hybrid"))
    hit = codes.select("qid").distinct().withColumn("_hit", F.lit(True))
    routed = route(queries, ranking_variant).join(hit, "qid", "left")
    empty = (F.col("path") == "strict") & F.col("_hit").isNull()
    routed = routed.withColumn("path", F.when(empty & F.lit(fallback), "fallback").otherwise(F.col("path"))).select("qid", "path")
    legs = [
        dense.join(routed.filter("path = 'vector'"), "qid"),
        codes.join(routed.filter("path = 'strict'"), "qid"),
        fused.join(routed.filter("path in ('hybrid', 'fallback')"), "qid"),
    ]
    out = None
    for leg in legs:
        leg = leg.filter(F.col("rank") <= k).select("qid", "id", "score", "rank", "path")
        out = leg if out is None else out.unionByName(leg)
    return out


def hybrid(queries: DataFrame, corpus: DataFrame, k: int = 10, pool: int = 200, mode: str = "hybrid_classified", metric: str = "cosine", digits: int | None = None, **settings) -> DataFrame:
    """Hits of queries (qid, text, v) in a corpus (id, text, v) under a retrieval mode: vector leg, code leg, fusion and routing."""
    dense = dense_top_k(queries, corpus, pool, metric, digits)
    codes = top_k(bm25(queries, corpus).withColumn("score", F.round("score", 6)), pool, ["qid"])
    return search(queries, cut(dense), cut(codes), mode, k, **settings)


def bound_pool(hits: DataFrame, most: int, floor: float, by: list[str]) -> DataFrame:
    """The best `most` hits, without those below floor times the top score; no floor if the top is not positive."""
    capped = hits.filter(F.col("rank") <= most)
    top = F.max("score").over(Window.partitionBy(*by))
    keep = (top <= 0) | (F.col("score") >= floor * top) if floor > 0 else F.lit(True)
    return capped.withColumn("_keep", keep).filter("_keep").drop("_keep")


def candidate_union(legs: dict[str, DataFrame]) -> DataFrame:
    """One row per (qid, id) with rank and score of each leg and the sorted leg names."""
    every = None
    for name, leg in legs.items():
        part = leg.select("qid", "id", "rank", "score", F.lit(name).alias("leg"))
        every = part if every is None else every.unionByName(part)
    columns = [agg for n in legs for agg in (F.max(F.when(F.col("leg") == n, F.col("rank"))).alias(f"rank_{n}"), F.max(F.when(F.col("leg") == n, F.col("score"))).alias(f"score_{n}"))]
    return every.groupBy("qid", "id").agg(*columns, F.array_sort(F.collect_set("leg")).alias("source_legs"))


def rerank(hits: DataFrame, threshold: float, k: int, by: list[str]) -> DataFrame:
    """Hits of at least a score, from the top, k of each query."""
    return top_k(hits.filter(F.col("score") >= threshold), k, by)


def calibrated_softmax(logits: Column, temperature: float) -> Column:
    scaled = F.transform(logits, lambda x: x / temperature)
    top = F.array_max(scaled)
    powers = F.transform(scaled, lambda x: F.exp(x - top))
    total = F.aggregate(powers, F.lit(0.0), lambda a, x: a + x)
    return F.transform(powers, lambda x: x / total)


def blend(a: Column, b: Column, weight: float) -> Column:
    return F.zip_with(a, b, lambda x, y: weight * x + (1 - weight) * y)


def bundle_scores(text: Column, separator: str) -> Column:
    return F.filter(F.split(text, separator), lambda s: s != "")


def recall_at(found: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """(qid, recall): shared ids over min(k, truth); a query without truth has 1 if it found nothing, else 0."""
    f = found.filter(F.col("rank") <= k).groupBy("qid").agg(F.collect_set("id").alias("f"))
    t = truth.filter(F.col("rank") <= k).groupBy("qid").agg(F.collect_set("id").alias("t"))
    both = f.join(t, "qid", "full_outer")
    none = lambda c: F.coalesce(F.size(c), F.lit(0))
    hit = F.coalesce(F.size(F.array_intersect("f", "t")), F.lit(0))
    return both.select("qid", F.when(none("t") == 0, F.when(none("f") == 0, 1.0).otherwise(0.0)).otherwise(hit / F.greatest(F.lit(1), F.least(F.lit(k), none("t")))).alias("recall"))


def article_top_k(hits: DataFrame, k: int) -> DataFrame:
    """Best articles: the greatest score of an article's offers, then the k best."""
    best = hits.groupBy("qid", "article").agg(F.max("score").alias("score")).withColumnRenamed("article", "id")
    return top_k(best, k, ["qid"])


def quantised_scores(pairs: DataFrame, precision: str) -> Column:
    """Score of columns a and b under a precision."""
    a, b = F.col("a"), F.col("b")
    if precision == "float32":
        return vectors.dot(a, b)
    if precision == "int8":
        return vectors.dot(vectors.quantise_int8(a), vectors.quantise_int8(b)) / F.lit(127.0 * 127.0)
    if precision == "sign":
        return vectors.dot(vectors.sign_codes(a), vectors.sign_codes(b)) / F.size(a)
    if precision == "binary":
        return 1.0 - 2.0 * vectors.hamming(vectors.sign_bits(a), vectors.sign_bits(b)) / F.size(a)
    raise ValueError(precision)


def quantised_pairs(queries: DataFrame, corpus: DataFrame) -> DataFrame:
    """(qid, id, float32, sign, binary) of each query (qid, v) with each corpus row (id, v): `quantised_scores` by matrix products of blocks; null vectors are left out."""
    kind, qkind = corpus.schema["id"].dataType.simpleString(), queries.schema["qid"].dataType.simpleString()

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            for ids, m, qids, qm in zip(p["ids"], p["m"], p["qids"], p["qm"], strict=True):
                x, q = np.asarray(m).reshape(len(ids), -1), np.asarray(qm).reshape(len(qids), -1)
                for lo in range(0, len(qids), PAIR_QUERIES):
                    some = q[lo : lo + PAIR_QUERIES]
                    told = {"qid": np.repeat(qids[lo : lo + PAIR_QUERIES], len(ids)), "id": np.tile(ids, len(some)), "float32": (some @ x.T).ravel()}
                    for name, mark in (("sign", np.greater_equal), ("binary", np.greater)):
                        told[name] = ((2.0 * mark(some, 0) - 1) @ (2.0 * mark(x, 0) - 1).T / x.shape[1]).ravel()
                    yield pd.DataFrame(told)

    pairs = _blocks(corpus, "id", "v", CORPUS_BLOCK, "", False).crossJoin(sized(_blocks(queries, "qid", "v", QUERY_BLOCK, "q", False), BROADCAST_ROWS // QUERY_BLOCK))
    return pairs.mapInPandas(run, f"qid {qkind}, id {kind}, float32 double, sign double, binary double")
