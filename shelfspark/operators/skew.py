"""Joins that split hot keys."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut

#: Rows of one key of the left side that go to one task.
ROOM = 20_000
#: Lists of hot keys up to this many are broadcast.
BROADCAST_KEYS = 1_000_000


def salted_join(left: DataFrame, right: DataFrame, keys: list[str], by: str, how: str = "inner", room: int | None = None) -> DataFrame:
    """left joined to right on keys, where rows of a hot key of the left are dealt by a hash of `by`.

    A key with more than `room` rows on the left has as many parts as it needs; the
    right side's rows of that key go to each part. how: inner or left. The number of
    hot keys is at most the left's rows divided by room.
    """
    room = ROOM if room is None else room
    counts = left.groupBy(*keys).agg(F.count("*").alias("_n")).filter(F.col("_n") > room)
    hot = cut(counts.dropna(subset=keys).select(*keys, F.ceil(F.col("_n") / room).cast("int").alias("_parts")))
    many = hot.count()
    if not many:
        return left.join(right, keys, how)
    hot = F.broadcast(hot) if many <= BROADCAST_KEYS else hot
    parts = F.coalesce("_parts", F.lit(1))
    # rows without a key meet nothing, so they may go anywhere
    parts_here = F.when(reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys]), F.lit(1000)).otherwise(parts)
    dealt = left.join(hot, keys, "left").withColumn("_salt", F.pmod(F.xxhash64(by), parts_here).cast("int")).drop("_parts")
    spread = right.join(hot, keys, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_parts")
    return dealt.join(spread, [*keys, "_salt"], how).drop("_salt")
