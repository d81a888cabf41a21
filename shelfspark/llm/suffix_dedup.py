"""Removal of repeated byte strings by distributed prefix doubling.

A byte goes if some string of `length` bytes that covers it also starts elsewhere.
Prefix doubling ranks positions by their first bytes, then by pairs of ranks at
growing offsets, until a position is unique or the prefix has reached `length`.
Here the positions are sampled, and prefixes grow to both sides:

1. In each window of `length` bytes the first `GRAM`-byte string of least hash is
   the anchor. Equal windows have their anchors at equal offsets, whatever stands
   around them, so no repeat is missed. Anchors are ranked by their gram first.
2. An anchor stands for a block of windows, those that hold it at an offset of a
   range. The bytes that all of them share (the core: at first the gram) and the
   bytes that any of them holds (the hull) are its two ranks. Spark groups the
   blocks by both. A hull that occurs twice makes all windows of its block
   repeats; one of its anchors stays as a witness for the others. A core that
   occurs once makes none a repeat. Both leave.
3. The others are split into blocks of fewer offsets, sixteen and then one, whose cores have
   grown towards `length`, and are ranked again, until core, hull and window are
   one.

Ranks are 64-bit fingerprints of byte ranges, so two different strings are taken
for equal with a probability of 2^-64 a pair. Groupings aggregate on the map side
and hold a few longs a row; no group is gathered in one task. Blocks are made
again from the texts in each round rather than kept: what lives on is told by a
bit filter of bounded size, and a wrong yes of the filter only adds a block that is
ranked exactly like the others. Beyond `FILTER_ROWS` survivors the texts are joined
to lists of them by a shuffle instead; both ways give the same rows.

Null is empty; texts shorter than `length` are untouched. Long texts are worked
off in slices, so memory does not grow with them. Repeated rows are repeats of each
other, whatever their ids. Columns named like the results or like those used
within are replaced or kept apart. Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import Work, cut

LENGTH = 200
GRAM = 64
#: Lists of ranges by text, up to this many entries, are broadcast.
BROADCAST_RANGES = 4_000_000
#: Up to this many blocks live on by a bit filter; it has 8 to 16 bits for each, 64 MB at most.
FILTER_ROWS = 1 << 26
FILTER_BITS = 29
SLICE = 1 << 17

_U = np.uint64
_BYTE = np.random.default_rng(61).integers(1, 1 << 63, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15
#: Marks a witness: a block that is known to be repeated itself.
_WITNESS = 0x5851F42D4C957F2D
_power = _inverse = np.ones(1, np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    return x ^ (x >> _U(32))


class Prints:
    """Fingerprints of byte ranges of one piece of text."""

    def __init__(self, raw: bytes):
        global _power, _inverse
        n = self.n = len(raw)
        if len(_power) <= n:
            _power = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(2 * n, _U(_BASE))]))
            _inverse = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(2 * n, _U(pow(_BASE, -1, 1 << 64)))]))
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[np.frombuffer(raw, np.uint8)] * _power[:n], out=self.sums[1:])

    def every(self, length: int) -> np.ndarray:
        """Of the strings of that length at each position."""
        k = self.n - length + 1
        return _mix((self.sums[length:] - self.sums[:k]) * _inverse[:k])

    def ranges(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        return _mix((self.sums[hi] - self.sums[lo]) * _inverse[lo])


def _sliding(x: np.ndarray, width: int, best: np.ufunc) -> np.ndarray:
    """best of x[i : i + width] at each i."""
    have = 1
    while 2 * have <= width:
        x = best(x[:-have], x[have:])
        have *= 2
    return best(x[: len(x) - (width - have)], x[width - have :]) if width > have else x


def sizes(length: int, gram: int) -> list[int]:
    """Offsets in a block, round by round: all, then powers of sixteen down to one."""
    width = length - gram + 1
    return [width, *(16**i for i in range(8, -1, -1) if 16**i < width)]


class Anchors:
    """Anchors of a slice of a text: gram, position in the text, range of offsets at which windows may hold them.

    A window belongs to the first of its smallest grams. So an anchor's offsets reach
    up to the nearest one before it that is as small, and the nearest smaller one after
    it; one that has no window is none.
    """

    def __init__(self, raw: bytes, first: int, last: int, length: int, gram: int):
        self.length, self.total, self.width = length, len(raw), length - gram + 1
        self.base = max(0, first - 2 * length)
        self.prints = Prints(raw[self.base : last + 2 * length])
        grams = self.prints.every(gram)
        order = (grams >> _U(32)).astype(np.uint32)  # half of the hash does for the order, and is faster
        least = _sliding(order, self.width, np.minimum)
        pad = np.zeros(self.width - 1, np.uint32)
        most = _sliding(np.concatenate([pad, least, pad]), self.width, np.maximum)
        at = np.flatnonzero(most == order)
        own, p = order[at], at + self.base
        far = np.minimum(p, self.width - 1)
        near = np.maximum(p - (self.total - length), 0)
        for d in range(1, len(at)):
            gap = at[d:] - at[:-d]
            if gap.min() >= self.width:
                break
            far[d:] = np.where(own[:-d] <= own[d:], np.minimum(far[d:], gap - 1), far[d:])
            near[:-d] = np.where(own[d:] < own[:-d], np.maximum(near[:-d], self.width - gap), near[:-d])
        mine = (p >= first) & (p < last) & (near <= far)
        self.p, self.gram, self.near, self.far = p[mine], grams[at[mine]], near[mine], far[mine]

    def only(self, keep: np.ndarray) -> None:
        self.p, self.gram, self.near, self.far = self.p[keep], self.gram[keep], self.near[keep], self.far[keep]

    def ids(self, key: int) -> np.ndarray:
        return _mix(_U(key % (1 << 64)) ^ _mix(self.p.astype(np.uint64) + _U(_BASE)))

    def blocks(self, of: np.ndarray, j: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Core, hull, first and last window of block j of each anchor `of`."""
        p, low, high = self.p[of], j * size, np.minimum((j + 1) * size, self.width) - 1
        n, at = self.length, p - self.base
        core = self.prints.ranges(at - low, at + n - high)
        lo, hi = np.maximum(p - high, 0), np.minimum(p - low + n, self.total)
        block = _mix((j.astype(np.uint64) + _U(1)) * _U(0x1000193) + _U(size))
        ends = (lo - p + high).astype(np.uint64) * _U(0x2545F4914F6CDD1D) + (p - low + n - hi).astype(np.uint64)
        hull = _mix(self.prints.ranges(lo - self.base, hi - self.base) + _mix(ends + block) + self.gram[of])
        return _mix(core ^ block), hull, p - np.minimum(high, self.far[of]), p - np.maximum(low, self.near[of])


class Filter:
    """Whether a number is among those that a bit table was made of: never a wrong no."""

    def __init__(self, table: bytes):
        self.table = np.frombuffer(table, np.uint8)
        self.mask = _U(8 * len(table) - 1)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        bit = x & self.mask
        return (self.table[(bit >> _U(3)).astype(np.int64)] >> (bit & _U(7)).astype(np.uint8)) & 1 > 0


class Listed:
    """The same by a list of the numbers."""

    def __init__(self, values: np.ndarray):
        self.values = values.view(np.uint64)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return np.isin(x, self.values)


def bit_table(rows: DataFrame, x: str, count: int) -> bytes:
    """Bits of the numbers x, 16 for each of `count` if there is room; made by Spark, of a bounded size."""
    bits = 1 << min(FILTER_BITS, max(15, (16 * count - 1).bit_length()))
    spot = F.pmod(F.col(x), F.lit(bits)) + 1
    made = rows.groupBy(F.bitmap_bucket_number(spot).alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(spot)).alias("m"))
    table = bytearray(bits // 8)
    for r in made.toLocalIterator():
        table[4096 * (r.b - 1) : 4096 * r.b] = r.m
    return bytes(table)


_ROW = [("x", pa.int64()), ("k", pa.int64()), ("core", pa.int64()), ("hull", pa.int64()), ("a", pa.int32()), ("b", pa.int32()), ("open", pa.bool_())]


def _batch(parts: list[tuple]) -> pa.RecordBatch:
    cols = [np.concatenate(c) for c in zip(*parts, strict=True)]
    cols = [c.view(np.int64) if c.dtype == np.uint64 else c for c in cols]
    return pa.RecordBatch.from_arrays([pa.array(c).cast(t) for c, (_, t) in zip(cols, _ROW, strict=True)], names=[n for n, _ in _ROW])


def _keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(k, t): k stands for the id and the text, so that equal rows share positions."""
    return docs.select(F.xxhash64(doc_id, text).alias("k"), F.col(text).alias("t")).filter(F.length("t") > 0)


def _grams(keyed: DataFrame, length: int, gram: int) -> DataFrame:
    """(g) of each anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in batch.column("t"):
                raw = t.as_py().encode()
                for lo in range(0, len(raw) if len(raw) >= length else 0, SLICE):
                    found = Anchors(raw, lo, lo + SLICE, length, gram)
                    yield pa.RecordBatch.from_arrays([pa.array(found.gram.view(np.int64))], names=["g"])

    return keyed.select("t").mapInArrow(run, "g long")


def _block_rows(source: DataFrame, level: int, filters: list, length: int, gram: int) -> DataFrame:
    """Blocks of a round: x (number), k, core, hull, first and last window, whether it is open.

    filters[0] holds the grams, filters[i + 1] the blocks of round i that live on;
    None lets all pass. With a column xs of source, it lists those of the last round.
    """
    listed = "xs" in source.columns
    steps = sizes(length, gram)

    def expand(found: Anchors, key: int, tests: list) -> tuple | None:
        if tests[0] is not None:
            found.only(tests[0](found.gram))
        of = np.arange(len(found.p))
        j, x, opened = np.zeros(len(of), np.int64), found.ids(key), np.ones(len(of), bool)
        for i in range(level):
            if tests[i + 1] is not None:
                opened = tests[i + 1](x)
                live = opened | tests[i + 1](x ^ _U(_WITNESS))
                of, j, opened = of[live], j[live], opened[live]
            big, small = steps[i], steps[i + 1]
            lo, hi = np.maximum(j * big, found.near[of]) // small, np.minimum((j + 1) * big - 1, found.far[of]) // small
            n = np.maximum(hi - lo + 1, 0)
            end = np.cumsum(n)
            j = np.arange(int(n.sum())) + np.repeat(lo - (end - n), n)
            of, opened = np.repeat(of, n), np.repeat(opened, n)
            x = _mix(found.ids(key)[of] + (j.astype(np.uint64) + _U(1)) * _U(0xA0761D6478BD642F) + _U(small))
        if not len(of):
            return None
        core, hull, a, b = found.blocks(of, j, steps[level])
        return x, np.full(len(x), key, np.int64), core if level else found.gram[of], hull, a, b, opened

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = [f and Filter(f.value) for f in filters]
        for batch in batches:
            out, held = [], 0
            for i, (key, t) in enumerate(zip(batch.column("k").to_pylist(), batch.column("t"), strict=True)):
                raw = t.as_py().encode()
                tests = [*made[:-1], Listed(batch.column("xs")[i].values.to_numpy())] if listed else made
                for lo in range(0, len(raw) if len(raw) >= length else 0, SLICE):
                    rows = expand(Anchors(raw, lo, lo + SLICE, length, gram), key, tests)
                    if rows:
                        out.append(rows)
                        held += len(rows[0])
                    if held > 200_000:
                        yield _batch(out)
                        out, held = [], 0
            if out:
                yield _batch(out)

    return source.mapInArrow(run, "x long, k long, core long, hull long, a int, b int, open boolean")


def _repeated(work: Work, rows: DataFrame, twice: DataFrame) -> DataFrame:
    """Windows (k, a, b) of open blocks whose hull is among those that occur twice."""
    return work.keep(rows.filter("open").join(twice.select("hull"), "hull", "left_semi").select("k", "a", "b"))


def _ranked(work: Work, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Windows (k, a, b) of open blocks whose hull occurs twice, and the blocks (v, x) that live on."""
    hulls = rows.groupBy("hull").agg(F.count("*").alias("n"), F.min("x").alias("x"), F.min("core").alias("core"), F.max("open").alias("open"))
    hulls = work.keep(hulls.select("hull", "core", "x", (F.col("n") > 1).alias("twice"), (F.col("open") & (F.col("n") == 1)).alias("open")))
    cores = work.keep(hulls.groupBy("core").agg(F.count("*").alias("n"), F.max("open").alias("open")).filter("n > 1 and open").select("core"))
    value = F.when(F.col("open"), F.col("x")).otherwise(F.col("x").bitwiseXOR(F.lit(_WITNESS)))
    return _repeated(work, rows, hulls.filter("twice")), work.keep(hulls.join(cores, "core", "left_semi").select(value.alias("v"), "x"))


def _last(work: Work, rows: DataFrame) -> DataFrame:
    """Windows (k, a, b) that occur twice, of the last round, where core, hull and window are one."""
    return _repeated(work, rows, work.keep(rows.groupBy("hull").agg(F.count("*").alias("n")).filter("n > 1").select("hull")))


def repeated_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM) -> tuple[DataFrame, int]:
    """(k, starts, ends) with the repeated byte ranges of each text that has any, and how many ranges there are."""
    spark = docs.sparkSession
    keyed = _keyed(docs, doc_id, text)
    rounds = len(sizes(length, gram))
    with Work(spark) as work:
        grams = work.keep(_grams(keyed, length, gram).groupBy("g").agg(F.count("*").alias("n")).filter("n > 1").select("g"))
        many = grams.count()
        few = many <= FILTER_ROWS
        filters = [spark.sparkContext.broadcast(bit_table(grams, "g", many)) if few else None]
        rows = _block_rows(keyed, 0, filters, length, gram)
        rows = work.keep(rows if few else rows.join(grams.withColumnRenamed("g", "core"), "core", "left_semi").select(*rows.columns))
        marked = []
        for level in range(1, rounds):
            marks, alive = _ranked(work, rows)
            marked.append(marks)
            many = alive.count()
            if many <= FILTER_ROWS:
                filters.append(spark.sparkContext.broadcast(bit_table(alive, "v", many)))
                source = keyed
            else:
                filters.append(None)
                lists = alive.join(rows.select("x", "k"), "x").groupBy("k").agg(F.collect_list("v").alias("xs"))
                source = keyed.join(lists, "k")
            rows = work.keep(_block_rows(source, level, filters, length, gram))
        marked.append(_last(work, rows))
        every = marked[0]
        for m in marked[1:]:
            every = every.unionByName(m)
        lists = every.groupBy("k").agg(F.collect_list(F.struct("a", "b")).alias("w"))
        spans = cut(_merged(lists, length))
    return spans, spans.agg(F.sum(F.size("starts"))).first()[0] or 0


def _merged(lists: DataFrame, length: int) -> DataFrame:
    """(k, starts, ends): the windows of each text as disjoint byte ranges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            starts, ends = [], []
            for w in batch.column("w"):
                a, b = (w.values.field(i).to_numpy().astype(np.int64) for i in (0, 1))
                order = np.argsort(a, kind="stable")
                lo, reach = a[order], np.maximum.accumulate(b[order] + length)
                new = np.flatnonzero(np.concatenate([[True], lo[1:] > reach[:-1]]))
                starts.append(lo[new])
                ends.append(reach[np.append(new[1:], len(lo)) - 1])
            yield pa.RecordBatch.from_arrays([batch.column("k"), pa.array(starts, pa.list_(pa.int32())), pa.array(ends, pa.list_(pa.int32()))], names=["k", "starts", "ends"])

    return lists.mapInArrow(run, "k long, starts array<int>, ends array<int>")


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM, carry: list[str] | None = None) -> DataFrame:
    """The carried columns (all if None) with `spans`, the removed byte ranges, and `kept`, the other bytes."""
    spans, entries = repeated_spans(docs, doc_id, text, length, gram)
    keep = [c for c in (docs.columns if carry is None else carry) if c not in ("spans", "kept")]
    source = docs.select(*(F.col(c).alias(f"c{i}") for i, c in enumerate(keep)), F.xxhash64(doc_id, text).alias("k"), F.col(text).alias("t"))
    joined = source.join(F.broadcast(spans) if entries <= BROADCAST_RANGES else spans, "k", "left")
    schema = docs.select(*keep, F.lit(None).cast("array<struct<start:long,end:long>>").alias("spans"), F.lit(None).cast("binary").alias("kept")).schema
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ranges, left = [], []
            for t, a, b in zip(batch.column("t"), batch.column("starts"), batch.column("ends"), strict=True):
                raw = (t.as_py() or "").encode()
                pairs = list(zip(a.as_py() or (), b.as_py() or (), strict=True))
                ranges.append([{"start": x, "end": y} for x, y in pairs])
                edges = [0, *(e for p in pairs for e in p), len(raw)]
                left.append(b"".join(raw[x:y] for x, y in zip(edges[::2], edges[1::2], strict=True)))
            yield pa.RecordBatch.from_arrays([*(batch.column(f"c{i}") for i in range(len(keep))), pa.array(ranges, kind), pa.array(left, pa.binary())], names=[*keep, "spans", "kept"])

    return joined.mapInArrow(run, schema)


def digest(removed: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    gone: Column = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return removed.select(
        doc_id,
        (F.octet_length("kept") + gone).cast("long").alias("n_bytes"),
        gone.alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
