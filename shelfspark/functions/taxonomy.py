"""Category paths, classification codes and feature tokens."""

from __future__ import annotations

import gzip
import struct

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .ids import PATH_SEPARATOR, encode_path

#: Fixed value: code of articles that no mapping knows.
DEFAULT_S2CLASS = 90909090


def category_level(paths: Column, depth: int) -> Column:
    """Distinct prefixes of one depth, in source order."""
    deep = F.filter(paths, lambda p: F.coalesce(F.size(p["elements"]) >= depth, F.lit(False)))
    return F.coalesce(F.array_distinct(F.transform(deep, lambda p: encode_path(F.slice(p["elements"], 1, depth)))), F.array().cast("array<string>"))


def starts_with_path(path: Column, prefix: str) -> Column:
    """Prefix by whole elements; every path starts with the empty one."""
    return F.lit(True) if not prefix else (path == prefix) | path.startswith(prefix + PATH_SEPARATOR)


def split_path(path: Column) -> Column:
    return F.when(path == "", F.array().cast("array<string>")).otherwise(F.split(path, PATH_SEPARATOR))


def unwrap_int(json: Column) -> Column:
    """Integer of a plain or wrapped JSON number."""
    at = [F.get_json_object(json, f"$.{k}").try_cast("bigint") for k in ("$numberInt", "$numberLong")]
    wrapped = [F.try_variant_get(F.try_parse_json(json), f'$["{k}"]', "string").try_cast("bigint") for k in ("$numberInt", "$numberLong")]
    return F.coalesce(*wrapped, *at, json.try_cast("bigint"))


def expand_code(code: Column) -> Column:
    """Ancestors of an eight-digit code and itself, zeros left out."""
    levels = F.array(*((F.expr("1") * F.floor(code / step) * step).cast("int") for step in (1_000_000, 10_000, 100, 1)))
    return F.filter(levels, lambda x: x > 0)


def expand_codes(codes: Column) -> Column:
    return F.coalesce(F.array_sort(F.array_distinct(F.flatten(F.transform(codes, expand_code)))), F.array().cast("array<int>"))


def code_depth(code: Column) -> Column:
    """Place of the deepest pair of digits that is not 00; 0 for no code."""
    return F.when(code <= 0, 0).when(code % 100 != 0, 4).when(code % 10_000 != 0, 3).when(code % 1_000_000 != 0, 2).otherwise(1)


def code_parent(code: Column) -> Column:
    """Code one level up; null at the root."""
    d = code_depth(code)
    return F.when(d == 4, code - code % 100).when(d == 3, code - code % 10_000).when(d == 2, code - code % 1_000_000)


def s2class(versions: list[tuple[str, Column]], mapping: DataFrame | Column) -> Column:
    """Expanded target codes of the highest version that has any leaves.

    versions: (key, leaves) from the highest down; mapping: map column from
    "key/leaf" to target codes. Without a target the default code is expanded;
    a lower version is never tried.
    """
    source = F.lit(None).cast("string")
    leaves = F.array().cast("array<int>")
    for key, codes in reversed(versions):
        has = F.coalesce(F.size(codes) > 0, F.lit(False))
        source, leaves = F.when(has, key).otherwise(source), F.when(has, codes).otherwise(leaves)
    hit = F.flatten(F.filter(F.transform(leaves, lambda c: F.try_element_at(mapping, F.concat_ws("/", source, c.cast("string")))), lambda x: x.isNotNull()))
    found = expand_codes(hit)
    return F.when(F.size(found) > 0, found).otherwise(expand_code(F.lit(DEFAULT_S2CLASS)))


def read_mapping(path: str) -> list[tuple[int, int]]:
    """Pairs of a gzip file: the mark MAPP, then big-endian int pairs."""
    with gzip.open(path, "rb") as f:
        raw = f.read()
    if raw[:4] != b"MAPP":
        raise ValueError("not a mapping file")
    return list(struct.iter_unpack(">ii", raw[4:]))


def mapping_frame(spark: SparkSession, path: str, version: str) -> DataFrame:
    """(version_key, from_code, to_code) of a mapping file; the file is a small lookup."""
    rows = [(version, a, b) for a, b in read_mapping(path)]
    return spark.createDataFrame(rows, "version_key string, from_code int, to_code int")


def feature_tokens(features: Column) -> Column:
    """name=value tokens in source order; values that hold = are dropped."""
    def of(f: Column) -> Column:
        values = F.filter(F.coalesce(f["values"], F.array().cast("array<string>")), lambda v: ~F.contains(v, F.lit("=")))
        return F.transform(values, lambda v: F.concat(f["name"], F.lit("="), v))

    return F.coalesce(F.flatten(F.transform(features, of)), F.array().cast("array<string>"))
