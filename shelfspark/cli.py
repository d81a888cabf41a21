"""Command line: python -m shelfspark.cli COMMAND ..."""

from __future__ import annotations

import argparse
import os
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import registry
from .operators import ann, datasets, retrieval


def _spark() -> SparkSession:
    return SparkSession.builder.appName("shelfspark").getOrCreate()


def _vectors(spark: SparkSession, path: str, key: str, vector: str, out: str) -> DataFrame:
    return spark.read.parquet(path).select(F.col(key).alias(out), F.col(vector).alias("v"))


def _query(name: str):
    every = registry.queries()
    if name not in every:
        raise SystemExit(f"no query {name}; see the list command")
    return every[name]


def show_list(a: argparse.Namespace) -> None:
    sql = registry.oracle_sql()
    for name in sorted(registry.queries()):
        print(name, "" if name in sql else "(no SQL)")


def show_sql(a: argparse.Namespace) -> None:
    _query(a.name)
    print(registry.oracle_sql().get(a.name, "none"))


def run(a: argparse.Namespace) -> None:
    rows = _query(a.name)(_spark(), a.tables)
    rows.write.mode("overwrite").parquet(a.out) if a.out else rows.show(a.rows, truncate=False)


def explain(a: argparse.Namespace) -> None:
    _query(a.name)(_spark(), a.tables).explain("formatted")


def bench(a: argparse.Namespace) -> None:
    spark = _spark()
    for name in a.names:
        began = time.time()
        _query(name)(spark, a.tables).write.format("noop").mode("overwrite").save()
        print(name, round(time.time() - began, 3))


def index_build(a: argparse.Namespace) -> None:
    rows = _vectors(_spark(), a.vectors, a.key, a.vector, "id")
    ann.write_index(rows, ann.train_cells(rows, a.cells), a.index)
    print(ann.read_manifest(rows.sparkSession, a.index))


def index_search(a: argparse.Namespace) -> None:
    spark = _spark()
    centroids, index = ann.read_index(spark, a.index)
    ann.ivf_search(_vectors(spark, a.queries, a.key, a.vector, "qid"), index, centroids, a.k, a.probes).write.mode("overwrite").parquet(a.out)


def mine(a: argparse.Namespace) -> None:
    spark = _spark()
    hits = retrieval.dense_top_k(_vectors(spark, a.queries, a.key, a.vector, "qid"), _vectors(spark, a.vectors, a.key, a.vector, "id"), a.end)
    datasets.mine_negatives(hits, spark.read.parquet(a.positives), a.start, a.end, a.cap).write.mode("overwrite").parquet(a.out)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="shelfspark")
    commands = top.add_subparsers(required=True)

    def command(name: str, f, *words: str, **options: object) -> None:
        p = commands.add_parser(name)
        for w in words:
            p.add_argument(w, nargs="+" if w == "names" else None)
        for k, v in options.items():
            p.add_argument(f"--{k}", default=v, type=type(v) if v is not None else str)
        p.set_defaults(run=f)

    vectors = {"key": "id", "vector": "v"}
    command("list", show_list)
    command("sql", show_sql, "name")
    command("run", run, "name", "tables", out=None, rows=20)
    command("explain", explain, "name", "tables")
    command("bench", bench, "tables", "names")
    command("index-build", index_build, "vectors", "index", cells=64, **vectors)
    command("index-search", index_search, "queries", "index", "out", k=10, probes=8, **vectors)
    command("mine-negatives", mine, "queries", "vectors", "positives", "out", start=0, end=100, cap=8, **vectors)
    return top


def main(words: list[str] | None = None) -> None:
    a = parser().parse_args(words)
    a.run(a)


if __name__ == "__main__":
    os.environ.setdefault("PYARROW_IGNORE_TIMEZONE", "1")
    main()
