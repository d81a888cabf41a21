"""Near-duplicate documents by BagMinHash over multisets of five-word shingles.

A shingle of weight w owns the unit levels 0..w-1, grouped in blocks that double
in size; each block of each shingle is a Poisson process over its levels and time,
seeded by the shingle alone. A document sees the points below its weight; each
point falls in one register, and a register keeps its earliest time. Registers of
two documents agree with the probability of their weighted Jaccard similarity.
Points are made up to a horizon that covers all registers, which is doubled for
the few documents that it leaves short.

Equal multisets are one set of texts before banding, with a number of its own. In a
bucket each set is compared with a few pivots; then, among sets of a bucket that are
still apart after linking, those outside its largest group are held against the
others by a bitmap of their shingles, which bounds the overlap from above, and only
pairs that the bound lets reach the threshold are made: no bucket is cut, no link is
lost, and groups of copies never make all pairs. Hot buckets are split by set
numbers before they are joined. Every link is verified exactly, on weights and whole
texts, and classes are the connected components of links.

Rows find their set by a 128-bit hash of the text, so each row is a document of its
own: rows may repeat, and an id may come with several texts. Ids are of any type
that has an order. class_id is the least id of a class (null if it has none but null
ids); class_key tells classes apart whose least id is the same. `kept` marks the
rows of the least id, of one text if it has several there, and `keep_one` leaves one
row of each class. A document of one to four words is one shingle; null and wordless
texts have none and stay alone. Very long texts are cut into shingles whole, at some
hundred bytes of worker memory a byte of text. Columns named like the results are not
read. Empty tables give no rows.
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
from ..plans.predicates import all_of
from ..session import Work, cut
from .decontam import normalise
from .memory import give_back

WORDS = 5
THRESHOLD = 0.8
BANDS = 24
ROWS = 4
PIVOTS = 2
#: 64-bit words of a document's bitmap.
BITMAP = 64
CHUNK = 2_000_000
#: Lists of texts up to this many rows (some 20 MB) are broadcast; longer ones are joined by a shuffle.
BROADCAST_IDS = 500_000
#: Links up to this many (8 MB) are made classes in one task; more by rounds of joins.
EDGES_AT_ONCE = 500_000
#: Rows of one bucket, each with its bitmap, that are compared in one task.
BUCKET_ROOM = 1000

_U = np.uint64
_BYTE = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64)
_BYTE[32] = 0
_STEP = np.random.default_rng(8).integers(1, 1 << 63, 64, dtype=np.uint64) | _U(1)
_power = np.ones(1, np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of 64-bit hashes."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _powers(n: int) -> np.ndarray:
    global _power
    if len(_power) < n:
        _power = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(2 * n, _STEP[63])]))
    return _power


def shingles(texts: list[bytes], k: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, hash, weight) of each distinct shingle, by document and hash."""
    flat = np.frombuffer(normalise(b" ".join(texts) + b" "), np.uint8)
    first = np.cumsum([0, *(len(t) + 1 for t in texts)])[:-1]
    word = flat != 32
    starts = np.flatnonzero(word & ~np.concatenate([[False], word[:-1]]))
    none = np.zeros(0, np.int64)
    if not len(starts):
        return none, none.astype(np.uint64), none
    span = np.diff(starts, append=len(flat))
    place = np.arange(starts[0], len(flat)) - np.repeat(starts, span)
    h = mix(np.add.reduceat(_BYTE[flat[starts[0] :]] * _powers(int(span.max()))[place], starts - starts[0]))
    doc = np.searchsorted(first, starts, "right") - 1
    count = np.bincount(doc, minlength=len(texts))
    n = len(h)
    sh = np.zeros(max(0, n - k + 1), np.uint64)
    for i in range(k):
        sh += h[i : n - k + 1 + i] * _STEP[i] if n >= k else _U(0)
    ok = doc[: n - k + 1] == doc[k - 1 :] if n >= k else np.zeros(0, bool)
    sh, owner = mix(sh[ok]), doc[: n - k + 1][ok] if n >= k else none
    short = np.flatnonzero((count > 0) & (count < k))
    if len(short):
        at = np.cumsum(count) - count
        own = np.array([mix(np.array([(h[at[d] : at[d] + count[d]] * _STEP[: count[d]]).sum() + _STEP[20 + count[d]]], np.uint64))[0] for d in short], np.uint64)
        sh, owner = np.concatenate([sh, own]), np.concatenate([owner, short])
    order = np.lexsort((sh, owner))
    sh, owner = sh[order], owner[order]
    new = np.flatnonzero(np.concatenate([[True], (sh[1:] != sh[:-1]) | (owner[1:] != owner[:-1])]))
    return owner[new], sh[new], np.diff(new, append=len(sh))


def _uniform(seed: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
    """A hash for each seed and step, and a float in (0, 1] from it."""
    x = mix(seed + _U((step + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))
    return x, ((x >> _U(11)) + _U(1)).astype(np.float64) * 2.0**-53


def signatures(doc: np.ndarray, sh: np.ndarray, weight: np.ndarray, docs: int, m: int) -> np.ndarray:
    """Earliest time in each of m registers of each document; inf where it has no shingles."""
    out = np.full(docs * m, np.inf)
    total = np.bincount(doc, weight, docs)
    horizon = np.where(total > 0, m * (np.log(m) + 2.0) / np.maximum(total, 1), 0)
    todo = total > 0
    while todo.any():
        use = todo[doc]
        d0, s0, w0 = doc[use], sh[use], weight[use]
        level = 0
        while len(d0):
            low, size = (0, 1) if level == 0 else (1 << (level - 1), 1 << (level - 1))
            seed = mix(s0 ^ _STEP[32 + level % 31])
            d, w, t, step = d0, w0, np.zeros(len(d0)), 0
            limit = horizon[d] * size
            while len(d):
                x, u = _uniform(seed, 2 * step)
                t = t - np.log(u)
                on = t <= limit
                d, w, t, seed, limit, x = d[on], w[on], t[on], seed[on], limit[on], x[on]
                y, v = _uniform(seed, 2 * step + 1)
                seen = low + v * size <= w if size > 1 else np.ones(len(d), bool)
                register = (mix(x ^ y) % _U(m)).astype(np.int64)
                np.minimum.at(out, d[seen] * m + register[seen], t[seen] / size)
                step += 1
            level += 1
            more = w0 > (1 << (level - 1))
            d0, s0, w0 = d0[more], s0[more], w0[more]
        todo &= np.isinf(out.reshape(docs, m)).any(1)
        horizon[todo] *= 2
        out.reshape(docs, m)[todo] = np.inf
    return out.reshape(docs, m)


def band_hashes(times: np.ndarray, bands: int, rows: int) -> np.ndarray:
    x = times.view(np.uint64).reshape(len(times), bands, rows)
    h = np.zeros((len(times), bands), np.uint64)
    for r in range(rows):
        h = mix(h * _STEP[r] + x[:, :, r])
    return h.view(np.int64)


def _texts(docs: DataFrame, text: str) -> DataFrame:
    """(k1, k2, t) of each row with a text."""
    t = F.col(text)
    return docs.select(*_key(t), t.alias("t")).filter("t is not null")


def _key(t: F.Column) -> tuple[F.Column, F.Column]:
    return tuple(F.when(t.isNotNull(), F.xxhash64(F.lit(seed), t)).alias(f"k{seed}") for seed in (1, 2))


def sketch(docs: DataFrame, text: str, bands: int, rows: int) -> DataFrame:
    """(k1, k2, f1, f2, total, bands) of each row with words; (k1, k2) stand for its text, (f1, f2) for its multiset."""

    def chunk(keys: list[pa.Array], texts: list[bytes]) -> pa.RecordBatch:
        doc, sh, w = shingles(texts)
        n = len(texts)
        wu = w.astype(np.uint64)
        f1, f2 = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
        np.add.at(f1, doc, mix(sh ^ _STEP[40]) * wu)
        np.add.at(f2, doc, mix(sh + _STEP[41]) * mix(wu))
        total = np.bincount(doc, w, n).astype(np.int64)
        codes = band_hashes(signatures(doc, sh, w, n, bands * rows), bands, rows)
        keep = np.flatnonzero(total)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(keep) + 1, dtype=np.int32) * bands), pa.array(codes[keep].ravel()))
        cols = [*(k.take(pa.array(keep)) for k in keys), pa.array(f1[keep].view(np.int64)), pa.array(f2[keep].view(np.int64)), pa.array(total[keep]), lists]
        return pa.RecordBatch.from_arrays(cols, names=["k1", "k2", "f1", "f2", "total", "bands"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part: list[bytes] = []
            size = at = 0
            for i, t in enumerate(batch.column("t")):
                part.append(t.as_py().encode())
                size += len(part[-1])
                if size >= CHUNK or i == batch.num_rows - 1:
                    yield chunk([batch.column(k).slice(at, len(part)) for k in ("k1", "k2")], part)
                    at, part, size = i + 1, [], 0
        give_back()

    return _texts(docs, text).mapInArrow(run, "k1 long, k2 long, f1 long, f2 long, total long, bands array<long>")


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard of two multisets given as sorted hashes and weights."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = int(np.minimum(a[1][i], b[1][j]).sum())
    return both / max(1, int(a[1].sum() + b[1].sum()) - both)


def _small(ids: DataFrame, bound: int = BROADCAST_IDS) -> DataFrame:
    """Marks a checkpointed id list for broadcast if it is short enough."""
    return F.broadcast(ids) if ids.count() <= bound else ids


def _fetched(sets: DataFrame, wanted: DataFrame, docs: DataFrame, text: str) -> DataFrame:
    """(c, t): one text of each wanted set."""
    keys = cut(sets.select("c", "k1", "k2").join(wanted, "c"))
    return _texts(docs, text).join(_small(keys), ["k1", "k2"]).groupBy("c").agg(F.min("t").alias("t"))


def _verify(pairs: DataFrame, sets: DataFrame, docs: DataFrame, text: str, threshold: float) -> DataFrame:
    """The pairs (a, b) whose multisets are at least `threshold` alike."""
    ids = pairs.select(F.col("a").alias("c")).unionByName(pairs.select(F.col("b").alias("c"))).distinct()
    texts = cut(_fetched(sets, ids, docs, text))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}

        def bag(key: int, t: str) -> tuple[np.ndarray, np.ndarray]:
            if key not in held:
                if len(held) > 64:
                    held.clear()
                held[key] = shingles([t.encode()])[1:]
            return held[key]

        for p in parts:
            ok = [similarity(bag(a, ta), bag(b, tb)) >= threshold for a, b, ta, tb in zip(p["a"], p["b"], p["ta"], p["tb"], strict=True)]
            yield p.loc[ok, ["a", "b"]]
        held.clear()
        give_back()

    left = texts.select(F.col("c").alias("a"), F.col("t").alias("ta"))
    right = texts.select(F.col("c").alias("b"), F.col("t").alias("tb"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "ta", "tb").mapInPandas(run, "a long, b long")


def _bitmaps(texts: DataFrame) -> DataFrame:
    """(c, spare, bits) of rows (c, t): a bitmap of the hashed elements of each multiset, and how many elements share a bit.

    Two multisets have at most as many elements in common as common bits and the
    lesser of the spares.
    """
    bits = 64 * BITMAP

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 200):
                part = batch.slice(lo, 200)
                doc, sh, w = shingles([t.as_py().encode() for t in part.column(1)])
                copy = np.arange(int(w.sum())) - np.repeat(np.cumsum(w) - w, w)
                element = mix(np.repeat(sh, w) + copy.astype(np.uint64) * _STEP[50])
                flags = np.zeros((part.num_rows, bits), bool)
                flags[np.repeat(doc, w), (element % _U(bits)).astype(np.int64)] = True
                words = np.packbits(flags, axis=1, bitorder="little").view(np.int64)
                spare = np.bincount(doc, w, part.num_rows).astype(np.int64) - flags.sum(1)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(part.num_rows + 1, dtype=np.int32) * BITMAP), pa.array(words.ravel()))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(spare), lists], names=["c", "spare", "bits"])

    return texts.mapInArrow(run, "c long, spare long, bits array<long>")


def _pairs_of_stars(spots: DataFrame, alike) -> DataFrame:
    """Pairs (a, b) of each set of a bucket with the bucket's pivots."""
    return (
        spots.select("c", F.col("total").alias("tb"), F.explode("pivots").alias("x"))
        .filter((F.col("c") != F.col("x.p")) & alike(F.col("x.ta"), F.col("tb")))
        .select(F.least("c", "x.p").alias("a"), F.greatest("c", "x.p").alias("b"))
        .distinct()
    )


def _pairs_apart(work: Work, spots: DataFrame, groups: DataFrame, sets: DataFrame, docs: DataFrame, text: str, threshold: float, bands: int, alike) -> DataFrame:
    """Pairs (a, b) of sets of one bucket that are in different groups and that the bitmap bound lets through."""
    placed = spots.join(groups, spots["c"] == groups["node"], "left").select("band", "h", "c", "total", F.exists("pivots", lambda x: x["p"] == F.col("c")).alias("pivot"), F.coalesce("component", "c").alias("g"))
    placed = work.mark(placed)
    counted = placed.groupBy("band", "h", "g").agg(F.count("*").alias("n"))
    split = work.mark(counted.groupBy("band", "h").agg(F.count("*").alias("groups"), F.max(F.struct("n", "g"))["g"].alias("main")).filter("groups > 1").select("band", "h", "main"))
    apart = work.mark(placed.filter("not pivot").join(split, ["band", "h"]))
    maps = _bitmaps(_fetched(sets, apart.select("c").distinct(), docs, text))
    apart = work.mark(apart.join(work.mark(maps.join(sets.select("c", "bands"), "c")), "c"))
    side = lambda s, *more: ["band", "h", F.col("c").alias(s), *(F.col(x).alias(s + x) for x in ("g", "total", "spare", "bits", "bands")), *more]
    at = lambda name, i: F.get(name, F.lit(i))
    minor, other = apart.filter("g <> main").select(*side("a")), apart.select(*side("b", "main"))
    most = F.least("aspare", "bspare") + sum((F.bit_count(at("abits", i).bitwiseAND(at("bbits", i))) for i in range(BITMAP)), start=F.lit(0))
    # a pair is made in the first band that it shares; if one of it is a pivot there, it has been compared
    first = all_of([(at("abands", i) != at("bbands", i)) | (F.col("band") <= i) for i in range(bands)])
    test = (
        (F.col("ag") != F.col("bg")) & ((F.col("bg") == F.col("main")) | (F.col("a") < F.col("b"))) & alike(F.col("atotal"), F.col("btotal")) & first
        & (most * (1 + threshold) + 1e-6 >= threshold * (F.col("atotal") + F.col("btotal")))
    )
    met = salted_join(minor, other, ["band", "h"], "a", room=BUCKET_ROOM).filter(test)
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def classes(docs: DataFrame, doc_id: str, text: str, threshold: float, bands: int, rows: int) -> DataFrame:
    """(k1, k2, class_id, class_key, first, same, rows) of each distinct text with words.

    first marks the text that stands for its class; rows counts the rows of the
    text, and same those of its least id.
    """
    alike = lambda a, b: F.least(a, b) >= threshold * F.greatest(a, b)
    with Work(docs.sparkSession, free=True) as work:
        sketched = work.mark(sketch(docs, text, bands, rows))
        least = F.min(F.struct("k1", "k2", "total", "bands")).alias("x")
        # numbers given to checkpointed rows stay what they are
        sets = cut(sketched.groupBy("f1", "f2").agg(least).select("f1", "f2", "x.*", F.monotonically_increasing_id().alias("c")))
        member = work.mark(sketched.select("k1", "k2", "f1", "f2").distinct().join(sets.select("f1", "f2", "c"), ["f1", "f2"]).select("k1", "k2", "c"))
        spots = sets.select("c", "total", F.posexplode("bands").alias("band", "h"))
        pivot = lambda r: F.min(F.struct(F.xxhash64("c", F.lit(r)).alias("x"), F.col("c").alias("p"), F.col("total").alias("ta")))
        shared = spots.groupBy("band", "h").agg(F.count("*").alias("n"), F.array_distinct(F.array(*(pivot(r) for r in range(PIVOTS)))).alias("pivots")).filter("n > 1")
        shared = work.mark(shared.select("band", "h", "pivots"))
        spots = work.mark(spots.join(shared, ["band", "h"]))
        links = cut(_verify(work.mark(_pairs_of_stars(spots, alike)), sets, docs, text, threshold))
        groups = connected_components(links, "a", "b", at_once=EDGES_AT_ONCE)
        rest = work.mark(_pairs_apart(work, spots, groups, sets, docs, text, threshold, bands, alike))
        more = cut(_verify(rest, sets, docs, text, threshold))
        if not more.isEmpty():
            groups = connected_components(links.unionByName(more), "a", "b", at_once=EDGES_AT_ONCE)
        counted = docs.select(*_key(F.col(text)), F.col(doc_id).alias("id")).filter("k1 is not null").groupBy("k1", "k2", "id").agg(F.count("*").alias("same"))
        ids = counted.groupBy("k1", "k2").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "same")).alias("y"), F.sum("same").alias("rows"))
        known = member.join(groups, member["c"] == groups["node"], "left").select("k1", "k2", F.coalesce("component", "c").alias("g"))
        known = work.mark(known.join(ids, ["k1", "k2"]).select("k1", "k2", "g", "y.*", "rows"))
        heads = work.mark(known.groupBy("g").agg(F.min(F.struct("none", "id", "k1", "k2")).alias("x")))
        first = (F.col("k1") == F.col("x.k1")) & (F.col("k2") == F.col("x.k2"))
        return cut(salted_join(known, heads, ["g"], "k1").select("k1", "k2", F.col("x.id").alias("class_id"), F.col("x.k1").alias("class_key"), first.alias("first"), "same", "rows"))


def near_duplicates(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    threshold: float = THRESHOLD,
    bands: int = BANDS,
    rows: int = ROWS,
) -> DataFrame:
    """One row per row of docs: its id, class_id (least id of its class), kept and class_key."""
    found = classes(docs, doc_id, text, threshold, bands, rows)
    every = docs.select(F.col(doc_id).alias("id"), *_key(F.col(text)))
    own = F.col("first") & F.col("id").eqNullSafe(F.col("class_id"))
    return salted_join(every, found, ["k1", "k2"], "id", "left").select(
        F.col("id").alias(doc_id),
        F.when(F.col("first").isNull(), F.col("id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce(own, F.lit(True)).alias("kept"),
        "class_key",
    )


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs with one row of each class, of its least id, and all rows without words; same columns."""
    found = classes(docs, doc_id, text, threshold, BANDS, ROWS)
    told = cut(found.filter("not first or rows > 1").select(F.col("k1").alias("__near_k1"), F.col("k2").alias("__near_k2"), F.col("class_id").alias("__near_id"), F.col("first").alias("__near_first"), F.col("same").alias("__near_same")))
    k1, k2 = _key(F.col(text))
    here = docs.join(_small(told), (k1 == F.col("__near_k1")) & (k2 == F.col("__near_k2")), "left")
    head = F.col("__near_first") & F.col(doc_id).eqNullSafe(F.col("__near_id"))
    kept = here.filter(F.col("__near_first").isNull() | (head & (F.col("__near_same") == 1))).select(*docs.columns)
    if told.filter("__near_first and __near_same > 1").isEmpty():
        return kept
    again = here.filter(head & (F.col("__near_same") > 1)).groupBy("__near_k1", "__near_k2").agg(F.first(F.struct(*docs.columns)).alias("__near_row"))
    return kept.unionByName(again.select("__near_row.*"))
