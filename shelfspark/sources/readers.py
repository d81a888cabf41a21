"""Scans with pinned schemas, and a Python data source for binary mapping files."""

from __future__ import annotations

import gzip
import heapq
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..operators.datasets import row_ids
from ..plans.materialise import CAN_SCHEMA, MARKER_SCHEMA, OFFER_SCHEMA, PRICING_SCHEMA, WRAPPER_SCHEMA

#: Object store settings for the object store client of Hadoop 3.4 and later.
S3_OPTIONS = {"spark.hadoop.fs.s3a.aws.credentials.provider": "software.amazon.awssdk.auth.credentials.DefaultCredentialsProvider"}
SCHEMAS = {"offers": OFFER_SCHEMA, "pricings": PRICING_SCHEMA, "markers": MARKER_SCHEMA, "cans": CAN_SCHEMA}


def read_ndjson(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One object a line, gzip or plain; fields that the schema lacks are skipped."""
    return spark.read.schema(schema).option("mode", "PERMISSIVE").json(path)


def read_collections(spark: SparkSession, paths: dict[str, str]) -> dict[str, DataFrame]:
    """Raw collections, Parquet or NDJSON by what the path says."""
    return {n: spark.read.schema(SCHEMAS[n]).parquet(p) if "parquet" in p else read_ndjson(spark, p, SCHEMAS[n]) for n, p in paths.items()}


def read_wrapped(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The collections of wrapper files: one object each, with records of an offer and its side rows."""
    rows = spark.read.schema(WRAPPER_SCHEMA).option("multiLine", True).json(path).select(F.explode("records").alias("r"))
    side = lambda n: rows.select(F.explode(f"r.{n}").alias("x")).select("x.*")
    return {"offers": rows.select("r.offer.*"), "pricings": side("pricings"), "markers": side("markers"), "cans": side("customerArticleNumbers")}


def read_jsonl_with_file(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Lines with the name of their file."""
    return spark.read.schema(schema).json(path).withColumn("filename", F.col("_metadata.file_path"))


def read_tsv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).csv(path, sep="\t", header=True)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).csv(path, header=True)


def canonical(rows: DataFrame, renames: dict[str, str], needed: list[str]) -> DataFrame:
    """Columns under their canonical names; missing ones are empty strings."""
    rows = rows.withColumnsRenamed({a: b for a, b in renames.items() if a in rows.columns})
    return rows.withColumns({c: F.lit("") for c in needed if c not in rows.columns})


def head(rows: DataFrame, order: list[str], n: int | None = None) -> DataFrame:
    """Rows without the helper column _rn, the first n in an order."""
    rows = rows.drop("_rn")
    return rows if n is None else rows.orderBy(*order).limit(n)


def shard(rows: DataFrame, order: list, shards: int, index: int) -> DataFrame:
    """Every `shards`-th row in an order, from the index-th on (0-based)."""
    if not 0 <= index < shards:
        raise ValueError("index is from 0 to shards - 1")
    return row_ids(rows, order, "_n").filter((F.col("_n") - 1) % shards == index).drop("_n")


def list_files(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """(path, bytes) of the files of a glob, by name."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = place.getFileSystem(conf).globStatus(place)
    return sorted((f.getPath().toString(), f.getLen()) for f in found or () if f.isFile())


def select_files(files: list[tuple[str, int]], limit: int | None = None, largest: bool = False) -> list[tuple[str, int]]:
    """The first files by name, or the largest ones, ties by name."""
    ordered = sorted(files, key=lambda f: (-f[1], f[0])) if largest else sorted(files)
    return ordered if limit is None else ordered[:limit]


def balanced_shards(files: list[tuple[str, int]], shards: int) -> list[list[str]]:
    """Files dealt to shards of nearly equal size: the largest first, each to the lightest shard."""
    heap = [(0, i) for i in range(shards)]
    out: list[list[str]] = [[] for _ in range(shards)]
    for path, size in select_files(files, largest=True):
        load, i = heapq.heappop(heap)
        out[i].append(path)
        heapq.heappush(heap, (load + size, i))
    return out


def with_s3(builder: SparkSession.Builder, profile: str | None = None) -> SparkSession.Builder:
    """Session settings for s3a paths: credentials come from the default chain of the cluster, or from a named profile."""
    for k, v in S3_OPTIONS.items():
        builder = builder.config(k, v)
    return builder.config("spark.hadoop.fs.s3a.auth.profile", profile) if profile else builder


def key_values(spark: SparkSession, keys: DataFrame, key: str, fetch, dim: int, batch: int = 1000) -> DataFrame:
    """(key, v) of half-precision vectors that fetch(list of keys) -> list of bytes or None finds; keys without a value are left out.

    fetch is called in batches on the executors; a value of another length than dim raises.
    """
    kind = keys.schema[key].dataType.simpleString()

    def run(parts):
        for p in parts:
            for lo in range(0, len(p), batch):
                some = p[key].iloc[lo : lo + batch]
                raw = fetch(some.tolist())
                if any(r is not None and len(r) != 2 * dim for r in raw):
                    raise ValueError(f"a value is no vector of {dim} numbers")
                got = [(k, np.frombuffer(r, "<f2").astype(np.float32).tolist()) for k, r in zip(some, raw, strict=True) if r is not None]
                yield pd.DataFrame(got, columns=[key, "v"])

    return keys.select(key).mapInPandas(run, f"`{key}` {kind}, v array<float>")


class MappingFile(InputPartition):
    def __init__(self, path: str):
        self.path = path


class MappingReader(DataSourceReader):
    def __init__(self, paths: list[str]):
        self.paths = paths

    def partitions(self) -> list[MappingFile]:
        return [MappingFile(p) for p in self.paths]

    def read(self, partition: MappingFile):
        with gzip.open(partition.path, "rb") as f:
            if f.read(4) != b"MAPP":
                raise ValueError(f"{partition.path} is no mapping file")
            while pair := f.read(8):
                yield struct.unpack(">ii", pair)


class MappingSource(DataSource):
    """spark.read.format("code_mapping").load(path): int pairs of binary mapping files."""

    @classmethod
    def name(cls) -> str:
        return "code_mapping"

    def schema(self) -> str:
        return "from_code int, to_code int"

    def reader(self, schema) -> MappingReader:
        return MappingReader(self.options["path"].split(","))


def scroll(spark: SparkSession, fetch: Callable[[int, int, object], tuple[list[dict], object]], schema: str, slices: int = 8) -> DataFrame:
    """Rows of a service that pages through a fixed state of itself, slice by slice.

    fetch(slice, slices, after) gives a page of rows and the mark to go on from; a page
    without rows ends a slice. Each slice is one task and pages on by itself, so a
    lost task only repeats its slice.
    """
    names = [f.name for f in T._parse_datatype_string(schema).fields]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            for i in p["id"].tolist():
                after = None
                while True:
                    rows, after = fetch(int(i), slices, after)
                    if not rows:
                        break
                    yield pd.DataFrame(rows, columns=names)

    return spark.range(0, slices, 1, slices).mapInPandas(run, schema)


def look_aside(rows: DataFrame, cache: DataFrame, key: str, value: str, compute) -> DataFrame:
    """rows with value from the cache, or from compute(missing keys) -> (key, value) for those it lacks."""
    missing = rows.select(key).distinct().join(cache.select(key), key, "left_anti")
    return rows.join(cache.select(key, value).unionByName(compute(missing).select(key, value)), key, "left")
