"""Incremental maintenance of the two tables, and event-time windows.

A micro-batch of change events keeps the latest state per offer, upserts it, and
re-aggregates only the articles that it touches: the distinct hashes before and
after the change. Changes are written down before the source's offsets move on, and
versions of the tables are numbered files that are never overwritten, so a crash at
any place loses nothing and a replayed batch changes nothing.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..session import Work, remove, scratch
from ..sources.sinks import latest_version, put_version


def latest(events: DataFrame, key: str = "id", version: str = "version") -> DataFrame:
    """One row per key, the greatest version."""
    w = Window.partitionBy(key).orderBy(F.desc(version))
    return events.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def split_bad(events: DataFrame, schema: str, payload: str = "payload") -> tuple[DataFrame, DataFrame]:
    """Parsed events, and dead letters whose payload is no such record."""
    parsed = events.withColumn("_e", F.from_json(payload, schema, {"mode": "PERMISSIVE"}))
    good = F.col("_e").isNotNull() & F.col("_e.id").isNotNull()
    return parsed.filter(good).select("_e.*"), parsed.filter(~good).drop("_e")


def dirty_keys(old: DataFrame, changes: DataFrame) -> DataFrame:
    """Hashes of changed offers before and after: both sides of a move are dirty."""
    before = old.join(changes.select("id"), "id", "left_semi").select("article_hash")
    after = changes.filter("not deleted").select("article_hash")
    return before.unionByName(after).filter("article_hash is not null").distinct()


def apply_changes(old: DataFrame, changes: DataFrame) -> DataFrame:
    """The offer table after a batch of latest changes (same columns and `deleted`); stale versions are dropped."""
    both = old.withColumn("deleted", F.lit(False)).unionByName(changes.select(*old.columns, "deleted"))
    return latest(both).filter("not deleted").drop("deleted")


def refresh(articles: DataFrame, offers: DataFrame, dirty: DataFrame, aggregate: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Articles with the dirty ones aggregated anew from all their offers; those without offers go."""
    kept = articles.join(dirty, "article_hash", "left_anti")
    return kept.unionByName(aggregate(offers.join(dirty, "article_hash", "left_semi")).select(*kept.columns))


class Tables:
    """Offers and articles in a folder, by buckets of the article hash, and an index (id, article_hash, version) by buckets of the id.

    take() writes a batch of changes down; flush() applies all that were taken, and
    rewrites only the buckets that they touch. What is valid is told by a numbered
    manifest, so a new object for the same folder goes on where the last one ended.
    """

    def __init__(self, spark: SparkSession, folder: str, aggregate: Callable[[DataFrame], DataFrame], buckets: int = 16, max_keys: int = 100_000, max_bytes: int = 256 << 20, max_age: float = 5.0):
        self.spark, self.folder, self.aggregate, self.buckets = spark, folder, aggregate, buckets
        self.max_keys, self.max_bytes, self.max_age = max_keys, max_bytes, max_age
        self.since: float | None = None

    def manifest(self) -> dict:
        number, text = latest_version(self.spark, f"{self.folder}/manifests")
        if text is None:
            raise ValueError("the tables were never started")
        return json.loads(text) | {"number": number}

    def _bucket(self, column: str):
        return F.pmod(F.xxhash64(column), F.lit(self.buckets))

    def _read(self, manifest: dict, name: str, only: list[int] | None = None) -> DataFrame:
        paths = [p for b, p in manifest[name].items() if p and (only is None or int(b) in only)]
        reader = self.spark.read.schema(manifest["schemas"][name])
        return reader.parquet(*paths) if paths else self.spark.createDataFrame([], manifest["schemas"][name])

    def read(self, name: str) -> DataFrame:
        return self._read(self.manifest(), name)

    def _write(self, rows: DataFrame, name: str, number: int, by: str, only: list[int]) -> dict[str, str | None]:
        """Paths of the buckets `only` of a new version; a bucket without rows has none."""
        path = f"{self.folder}/{name}/v{number}"
        rows.withColumn("_b", self._bucket(by)).repartition("_b").write.mode("overwrite").partitionBy("_b").parquet(path)
        have = {r["_b"] for r in self.spark.read.parquet(path).select("_b").distinct().collect()} if not rows.isEmpty() else set()
        return {str(b): f"{path}/_b={b}" if b in have else None for b in only}

    def start(self, offers: DataFrame) -> None:
        """First version, from offers (id, article_hash, version, ...)."""
        every = list(range(self.buckets))
        index = offers.select("id", "article_hash", "version")
        articles = self.aggregate(offers)
        tables = {"offers": (offers, "article_hash"), "articles": (articles, "article_hash"), "index": (index, "id")}
        manifest = {n: self._write(rows, n, 0, by, every) for n, (rows, by) in tables.items()}
        schemas = {n: ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) for n, (rows, _) in tables.items()}
        put_version(self.spark, f"{self.folder}/manifests", json.dumps(manifest | {"schemas": schemas, "batch": -1}))

    def _taken(self, after: int) -> list[int]:
        jvm = self.spark.sparkContext._jvm
        place = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/pending")
        fs = place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        names = [f.getPath().getName() for f in fs.listStatus(place)] if fs.exists(place) else []
        done = lambda n: fs.exists(jvm.org.apache.hadoop.fs.Path(f"{self.folder}/pending/{n}/_SUCCESS"))
        return sorted(int(n) for n in names if n.isdigit() and int(n) > after and done(n))

    def take(self, batch: DataFrame, batch_id: int) -> None:
        """Writes a batch of changes (id, article_hash, version, deleted, ...) down; one that was applied before is left out."""
        if batch_id > self.manifest()["batch"]:
            latest(batch).write.mode("overwrite").parquet(f"{self.folder}/pending/{batch_id}")
            self.since = self.since or time.time()

    def pending(self) -> dict:
        """Batches that are taken but not applied, with their keys and bytes."""
        ids = self._taken(self.manifest()["batch"])
        if not ids:
            return {"batches": 0, "keys": 0, "bytes": 0}
        paths = [f"{self.folder}/pending/{i}" for i in ids]
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        size = sum((p := jvm.org.apache.hadoop.fs.Path(x)).getFileSystem(conf).getContentSummary(p).getLength() for x in paths)
        return {"batches": len(ids), "keys": self.spark.read.parquet(*paths).select("id").distinct().count(), "bytes": size}

    def due(self) -> bool:
        p = self.pending()
        return bool(p["batches"]) and (p["keys"] >= self.max_keys or p["bytes"] >= self.max_bytes or self.since is None or time.time() - self.since >= self.max_age)

    def flush(self) -> int:
        """Applies what is pending; gives the number of articles that were dirty."""
        old = self.manifest()
        ids = self._taken(old["batch"])
        self.since = None
        if not ids:
            return 0
        number = old["number"] + 1
        with Work(self.spark) as work:
            changes = latest(self.spark.read.parquet(*(f"{self.folder}/pending/{i}" for i in ids)))
            id_buckets = sorted(r.b for r in changes.select(self._bucket("id").alias("b")).distinct().collect())
            index = self._read(old, "index", id_buckets)
            before = index.select("id", F.col("article_hash").alias("_old"), F.col("version").alias("_seen"))
            live = work.keep(changes.join(before, "id", "left").filter("_seen is null or version > _seen"))
            dirty = live.select(F.col("_old").alias("article_hash")).unionByName(live.filter("not deleted").select("article_hash"))
            dirty = work.keep(dirty.filter("article_hash is not null").distinct())
            buckets = sorted(r.b for r in dirty.select(self._bucket("article_hash").alias("b")).distinct().collect())
            offers = self._read(old, "offers", buckets)
            kept = offers.join(live.select("id"), "id", "left_anti").unionByName(live.filter("not deleted").select(*offers.columns))
            new_index = index.join(live.select("id"), "id", "left_anti").unionByName(live.select("id", F.when(~F.col("deleted"), F.col("article_hash")).alias("article_hash"), "version"))
            manifest = {"schemas": old["schemas"], "batch": ids[-1]}
            manifest["index"] = old["index"] | self._write(new_index, "index", number, "id", id_buckets)
            manifest["offers"] = old["offers"] | self._write(kept, "offers", number, "article_hash", buckets)
            now = self._read(manifest, "offers", buckets)
            articles = refresh(self._read(old, "articles", buckets), now, dirty, self.aggregate)
            manifest["articles"] = old["articles"] | self._write(articles, "articles", number, "article_hash", buckets)
            put_version(self.spark, f"{self.folder}/manifests", json.dumps(manifest))
            n = dirty.count()
        for i in ids:
            remove(self.spark, f"{self.folder}/pending/{i}")
        return n

    def upsert(self, batch: DataFrame, batch_id: int) -> None:
        """foreachBatch function; a batch that is run again changes nothing."""
        self.take(batch, batch_id)
        if self.due():
            self.flush()


def run_changes(changes: DataFrame, tables: Tables, checkpoint: str, every: str = "5 seconds", once: bool = False) -> StreamingQuery:
    """Starts the upsert of a stream of changes."""
    writer = changes.writeStream.foreachBatch(tables.upsert).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()


def event_stream(spark: SparkSession, path: str, schema: str, per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def tumbling(events: DataFrame, size: str, ts: str = "ts", late: str | None = "1 hour") -> DataFrame:
    """Counts and sums per window and type (our addition; the data model has no event-time windows)."""
    rows = events.withColumn(ts, F.col(ts).cast("timestamp"))
    rows = rows.withWatermark(ts, late) if late and rows.isStreaming else rows
    out = rows.groupBy(F.window(ts, size), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return out.select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sliding(events: DataFrame, size: str, step: str, ts: str = "ts", late: str | None = "1 hour") -> DataFrame:
    rows = events.withColumn(ts, F.col(ts).cast("timestamp"))
    rows = rows.withWatermark(ts, late) if late and rows.isStreaming else rows
    return rows.groupBy(F.window(ts, size, step)).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "n")


def sessions(events: DataFrame, gap: str, ts: str = "ts", late: str | None = "1 hour") -> DataFrame:
    """Counts per user and session; an event at the gap or more after the last one begins a new session. late=None keeps events however late they come."""
    rows = events.withColumn(ts, F.col(ts).cast("timestamp"))
    rows = rows.withWatermark(ts, late) if late and rows.isStreaming else rows
    # Spark's windows hold their end, and times are whole microseconds
    out = rows.groupBy("user_id", F.session_window(ts, f"{gap} -1 microseconds")).agg(F.count("*").alias("n"))
    return out.select("user_id", F.col("session_window.start").alias("start"), "n")


def distinct_events(events: DataFrame, key: str = "event_id", ts: str = "ts", late: str = "1 hour") -> DataFrame:
    """Each event once within the watermark (at-least-once sources)."""
    rows = events.withColumn(ts, F.col(ts).cast("timestamp"))
    return rows.withWatermark(ts, late).dropDuplicatesWithinWatermark([key]) if rows.isStreaming else rows.dropDuplicates([key])


def running_state(events: DataFrame) -> DataFrame:
    """(user_id, n, total) per micro-batch by custom state: running counts and sums of each user."""
    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, total = state.get if state.exists else (0, 0.0)
        for p in parts:
            n, total = n + len(p), total + float(p["value"].sum())
        state.update((n, total))
        yield pd.DataFrame({"user_id": [key[0]], "n": [n], "total": [total]})

    return events.groupBy("user_id").applyInPandasWithState(step, "user_id long, n long, total double", "n long, total double", "update", GroupStateTimeout.NoTimeout)


#: State beyond the heap: it is kept in files of each executor, and each commit writes what it changed.
_STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "300",
}


def drain(stream: DataFrame, name: str, mode: str = "complete") -> DataFrame:
    """Runs a stream over what is there into files of the shared folder (for tests and batch registration); no rows come to the driver."""
    spark = stream.sparkSession
    at = f"{scratch(spark)}/{name}"

    def put(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{at}/rows/{batch_id}")
        if mode == "complete" and batch_id:  # the last batch is the whole result
            remove(spark, f"{at}/rows/{batch_id - 1}")

    spark.createDataFrame([], stream.schema).write.parquet(f"{at}/rows/none")  # a stream without files has no batch
    before = {k: spark.conf.get(k, None) for k in _STATE}
    try:
        for k, v in _STATE.items():
            spark.conf.set(k, v)
        q = stream.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", f"{at}/offsets").trigger(availableNow=True).start()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/rows/*")
