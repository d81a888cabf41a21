"""Sinks: chunked and sized Parquet, keyed upsert, checked publication."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.vectors import encode_fp16


def write_chunks(rows: DataFrame, path: str, per_file: int, codec: str = "zstd", row_group: int = 128 << 20) -> None:
    rows.write.mode("overwrite").option("compression", codec).option("maxRecordsPerFile", per_file).option("parquet.block.size", row_group).parquet(path)


def write_sized(rows: DataFrame, path: str, target_bytes: int) -> None:
    """Files near a target size: a rebalancing exchange that runtime statistics split and merge."""
    spark = rows.sparkSession
    name, before = "spark.sql.adaptive.advisoryPartitionSizeInBytes", spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.conf.set(name, str(target_bytes))
    try:
        rows.hint("rebalance").write.mode("overwrite").parquet(path)
    finally:
        spark.conf.set(name, before)


def write_clustered(rows: DataFrame, path: str, by: list[str], bloom_rows: int = 1_000_000) -> None:
    """Parquet in ranges of the look-up columns, sorted within files and with Bloom filters of the first, so that look-ups skip files."""
    out = rows.repartitionByRange(*by).sortWithinPartitions(*by).write.mode("overwrite")
    out.option(f"parquet.bloom.filter.enabled#{by[0]}", "true").option(f"parquet.bloom.filter.expected.ndv#{by[0]}", bloom_rows).parquet(path)


def write_tsv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").csv(path, sep="\t", header=True)


def encode_articles(articles: DataFrame, vector: str | None = None) -> DataFrame:
    """Sink form: numbers as JSON, envelopes in single precision, vectors as half precision bytes."""
    out = articles.withColumn("customer_article_numbers", F.to_json("customer_article_numbers"))
    out = out.withColumns({c: F.col(c).cast("float") for c in out.columns if c.endswith(("_price_min", "_price_max"))})
    return out.withColumn(vector, encode_fp16(vector)) if vector else out


def encode_offers(offers: DataFrame) -> DataFrame:
    out = offers.withColumn("prices", F.to_json("prices"))
    return out.withColumns({c: F.col(c).cast("float") for c in out.columns if c.endswith(("_price_min", "_price_max"))})


def upserted(old: DataFrame, new: DataFrame, key: str, version: str) -> DataFrame:
    """One row per key: the latest by version of both tables."""
    w = Window.partitionBy(key).orderBy(F.desc(version))
    return old.unionByName(new).withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def orphans(articles: DataFrame, offers: DataFrame) -> DataFrame:
    return articles.join(offers.select("article_hash").distinct(), "article_hash", "left_anti")


def put_version(spark: SparkSession, folder: str, text: str, after: int | None = None) -> int:
    """Writes a numbered file after the last one; its name appears only when it is whole, and never stands for another text.

    A writer that knows the last number gives it as `after`, and the folder is not listed again.
    """
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path
    fs = path(folder).getFileSystem(conf)
    fs.mkdirs(path(folder))
    number = (_last_number(spark, folder) if after is None else after) + 1
    hidden, shown = path(f"{folder}/.{uuid.uuid4().hex}"), path(f"{folder}/{number:012d}.json")
    out = fs.create(hidden)
    out.write(bytearray(text.encode()))
    out.close()
    if fs.exists(shown) or not fs.rename(hidden, shown):
        raise RuntimeError(f"version {number} was written by another process")
    return number


def _last_number(spark: SparkSession, folder: str) -> int:
    """Number of the last numbered file, -1 without one."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    place = jvm.org.apache.hadoop.fs.Path(folder)
    fs = place.getFileSystem(conf)
    if not fs.exists(place):
        return -1
    names = [f.getPath().getName() for f in fs.listStatus(place)]
    return max((int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit()), default=-1)


def latest_version(spark: SparkSession, folder: str) -> tuple[int, str | None]:
    """Number and text of the last numbered file; (-1, None) without one."""
    number = _last_number(spark, folder)
    if number < 0:
        return -1, None
    return number, spark.read.text(f"{folder}/{number:012d}.json", wholetext=True).first()[0]


def publish(spark: SparkSession, articles: str, offers: str, pointer: str) -> None:
    """Points readers at a new version after a check that no offer lacks its article.

    The pointer is a numbered file beside the earlier ones, so readers find either
    the last version or this one, never none.
    """
    if not orphans(spark.read.parquet(offers), spark.read.parquet(articles)).isEmpty():
        raise ValueError("offers without an article; nothing is published")
    put_version(spark, pointer, json.dumps({"articles": articles, "offers": offers}))


def published(spark: SparkSession, pointer: str) -> tuple[DataFrame, DataFrame]:
    at = json.loads(latest_version(spark, pointer)[1])
    return spark.read.parquet(at["articles"]), spark.read.parquet(at["offers"])


def with_metadata(rows: DataFrame, metadata: dict[str, dict]) -> DataFrame:
    """rows whose columns carry metadata, which Parquet keeps in its schema."""
    return rows.select(*(F.col(c).alias(c, metadata=metadata[c]) if c in metadata else F.col(c) for c in rows.columns))


def write_with_manifest(rows: DataFrame, path: str, settings: dict | None = None) -> dict:
    """Writes Parquet and, beside it, a manifest: rows and bytes of each file, columns, settings."""
    rows.write.mode("overwrite").parquet(f"{path}/data")
    spark = rows.sparkSession
    found = spark.read.parquet(f"{path}/data").groupBy(F.col("_metadata.file_name").alias("f"), F.col("_metadata.file_size").alias("b")).agg(F.count("*").alias("n")).orderBy("f").collect()
    files = [{"file": r.f, "rows": r.n, "bytes": r.b} for r in found]
    manifest = {"files": files, "rows": sum(f["rows"] for f in files), "columns": {f.name: f.dataType.simpleString() for f in rows.schema}, "settings": settings or {}}
    put_version(spark, f"{path}/manifest", json.dumps(manifest))
    return manifest


def read_with_manifest(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    """The rows and the manifest; raises ValueError if files were lost or changed."""
    manifest = json.loads(latest_version(spark, f"{path}/manifest")[1])
    rows = spark.read.parquet(f"{path}/data")
    if rows.count() != manifest["rows"]:
        raise ValueError("rows differ from the manifest")
    return rows, manifest


def upload(spark: SparkSession, files: list[str], state: str, submit: Callable[[str], str], poll: Callable[[str], str], parallel: int = 4, wait: float = 0.0) -> list[str]:
    """Hands files to a bulk-insert service, a few at a time, and gives those that were handed over in this run.

    submit(file) gives a job, poll(job) its state: running, done, or failed (which
    raises). The number of leading files that are all done is written down after each
    change, so a restart begins behind them; what was done beyond is handed over again.
    """
    number, text = latest_version(spark, state)
    prefix = json.loads(text)["done"] if text else 0
    done = set(range(prefix))
    running: dict[int, str] = {}
    todo, sent = iter(range(prefix, len(files))), []
    while True:
        while len(running) < parallel and (i := next(todo, None)) is not None:
            running[i] = submit(files[i])
            sent.append(files[i])
        if not running:
            return sent
        for i, job in list(running.items()):
            told = poll(job)
            if told == "failed":
                raise RuntimeError(f"{files[i]} could not be inserted")
            if told == "done":
                del running[i]
                done.add(i)
        first = prefix
        while prefix in done:
            prefix += 1
        if prefix != first:
            number = put_version(spark, state, json.dumps({"done": prefix}), number)
        time.sleep(wait)


def bulk_index(rows: DataFrame, key: str, send: Callable[[list[dict]], list[int]], batch: int = 500, tries: int = 5, wait: float = 0.5) -> DataFrame:
    """(key, status) of each row after batched writes to a service; send(documents) gives a status each.

    Documents that are turned away for load (429, 503) are sent again after waits that
    double, so writers slow down with the service; other failures are final.
    """
    kind = rows.schema[key].dataType.simpleString()
    columns = rows.columns

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            for lo in range(0, len(p), batch):
                some = p.iloc[lo : lo + batch]
                documents = [dict(zip(columns, r, strict=True)) for r in some.itertuples(index=False)]
                status = [0] * len(documents)
                left = list(range(len(documents)))
                for t in range(tries):
                    for i, code in zip(left, send([documents[i] for i in left]), strict=True):
                        status[i] = code
                    left = [i for i in left if status[i] in (429, 503)]
                    if not left:
                        break
                    time.sleep(wait * 2**t)
                yield pd.DataFrame({key: some[key].to_numpy(), "status": status})

    return rows.mapInPandas(run, f"`{key}` {kind}, status int")


def differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that only one of two tables has, with repeats."""
    left = a.exceptAll(b.select(*a.columns)).withColumn("side", F.lit("left"))
    return left.unionByName(b.select(*a.columns).exceptAll(a).withColumn("side", F.lit("right")))
