"""Benchmark decontamination: one Aho-Corasick automaton over benchmark windows.

Texts become words by lower-casing A-Z and keeping runs of digits, letters and
non-ASCII characters. Every run of `window` consecutive item words is a pattern;
an item with fewer words, but not none, is one pattern. The automaton's letters are
the numbers of the benchmark's words, so a pattern has `window` nodes at most, whatever
the length of its words. A text is scanned once and each match is mapped back to word
ranges and to code point offsets of the original text.

An automaton takes some 450 bytes a benchmark word in each worker, and is bounded: a
benchmark of more than `block_words` words (some 3 MB of text) is split, and its blocks
are scanned for one after another, with the findings kept in a checkpoint between
them. So workers' memory never grows with the benchmark, at the price of a scan a
block; there is no shuffle.

Null or empty texts have no words and no hits; very long ones are scanned whole, in
memory of a few times their length. Null items are ignored; an item without an id
marks words but is not listed. Repeated items count once. Empty tables give empty or
clean results. Extra columns of documents are kept; one named like the result is
replaced.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut
from .memory import give_back

WINDOW = 10
#: Words of one automaton. Its letters are code points, of which there are more.
BLOCK_WORDS = 500_000
BATCH_BYTES = 4_000_000

_SPACE = 32
_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_TABLE = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else _SPACE for c in range(256)
)
_FOUND = T.StructType([
    T.StructField("n_words", T.LongType()),
    T.StructField("words", T.ArrayType(T.StructType([T.StructField("first", T.LongType()), T.StructField("end", T.LongType())]))),
    T.StructField("chars", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
    T.StructField("items", T.ArrayType(T.StringType())),
])
_ARROW = pa.struct([
    ("n_words", pa.int64()),
    ("words", pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))),
    ("chars", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
    ("items", pa.list_(pa.string())),
])


def normalise(raw: bytes) -> bytes:
    """Same length as raw: lower case, and a space for each byte that is in no word."""
    return raw.translate(_TABLE)


class Patterns:
    """The automaton of benchmark windows: code point of each word, of each pattern its length and items, and words that follow each other."""

    def __init__(self, rows: list[tuple[object, str]], window: int = WINDOW):
        self.letters: dict[bytes, str] = {}
        self.lengths: list[int] = []
        self.items: list[tuple[str, ...]] = []
        self.tree = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        pairs: list[np.ndarray] = []
        for item, text in rows:
            coded = "".join([self._letter(w) for w in normalise(text.encode()).split()])
            own = () if item is None else (str(item),)
            for k in range(max(1, len(coded) - window + 1) if coded else 0):
                at = self.tree.get(coded[k : k + window], -1)
                if at < 0:
                    self.tree.add_word(coded[k : k + window], len(self.items))
                    self.lengths.append(min(window, len(coded)))
                    self.items.append(own)
                elif own and own[0] not in self.items[at]:
                    self.items[at] += own
            codes = np.frombuffer(coded.encode("utf-32-le"), "<u4").astype(np.int64)
            pairs.append((codes[:-1] << 21) | codes[1:])
        self.shortest = min(self.lengths, default=0)
        self.pairs = np.unique(np.concatenate(pairs)) if pairs else np.zeros(0, np.int64)
        if self.items:
            self.tree.make_automaton()

    def stretches(self, line: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(text, first, end) of the stretches of coded words that could hold a pattern.

        Within a pattern each two words that follow each other do so in some item. All
        other words are passed over before the automaton, whose steps cost far more.
        """
        if len(line) and self.items:
            if self.shortest > 1:
                near = (line[:-1] > 0) & (line[1:] > 0)
                some = np.flatnonzero(near)
                pair = (line[some].astype(np.int64) << 21) | line[some + 1]
                spot = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
                near[some[self.pairs[spot] != pair]] = False
                near[ends[(ends > 0) & (ends < len(line))] - 1] = False
            else:
                near = line > 0
                cut = ends[(ends > 0) & (ends < len(line))]
            edge = np.flatnonzero(np.diff(np.concatenate([[0], near.view(np.int8), [0]])))
            begin, stop = edge[::2], edge[1::2] + (self.shortest > 1)
            if self.shortest <= 1:  # stretches of single words end with their text
                begin, stop = np.union1d(begin, cut[near[cut] & near[cut - 1]]), np.union1d(stop, cut[near[cut] & near[cut - 1]])
            long = stop - begin >= self.shortest
            docs = np.searchsorted(ends, begin[long], "right")
            yield from zip(docs.tolist(), begin[long].tolist(), stop[long].tolist(), strict=True)

    def _letter(self, word: bytes) -> str:
        n = len(self.letters) + 1
        return self.letters.setdefault(word, chr(n if n < 0xD800 else n + 0x800))  # no surrogates


_built: dict[str, Patterns] = {}


def _merge(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts one after another, and where each text's words end."""
    texts = pc.fill_null(texts, "")
    if texts.offset or texts.buffers()[2] is None:
        texts = pa.concat_arrays([texts, pa.array([""])]).slice(0, len(texts)) if len(texts) else texts
    buffers = texts.buffers()
    flat = pa.Array.from_buffers(pa.string(), len(texts), [None, buffers[1], pa.py_buffer(normalise(buffers[2].to_pybytes() if buffers[2] else b""))], offset=texts.offset)
    parts = pc.split_pattern(flat, " ")
    words = parts.flatten()
    full = pc.greater(pc.binary_length(words), 0)
    upto = np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False))])
    return words.filter(full), upto[np.cumsum(parts.value_lengths().to_numpy(), dtype=np.int64)]


def scan_texts(texts: pa.Array, known: Patterns, before: list[dict | None]) -> list[dict]:
    """Of each text: word count, merged hit word ranges, their code point ranges and item ids."""
    words, ends = words_of(texts)
    coded = words.dictionary_encode()
    get = known.letters.get
    letter = np.array([ord(get(w, "\0")) for w in coded.dictionary.cast(pa.binary()).to_pylist()] or [0], "<u4")
    line = letter[coded.indices.to_numpy(zero_copy_only=False)] if len(words) else letter[:0]
    found: dict[int, tuple[list, set]] = {}
    for doc, lo, hi in known.stretches(line, ends):
        first = int(ends[doc - 1]) if doc else 0
        for last, at in known.tree.iter(line[lo:hi].tobytes().decode("utf-32-le")):
            ranges, items = found.setdefault(doc, ([], set()))
            end = lo - first + last + 1
            ranges.append((end - known.lengths[at], end))
            items.update(known.items[at])
    count = np.diff(ends, prepend=0).tolist()
    out = [h or {"n_words": n, "words": [], "chars": [], "items": []} for h, n in zip(before, count, strict=True)]
    for doc, (ranges, items) in found.items():
        out[doc] = _mapped(texts[doc].as_py(), ranges, items, out[doc])
    return out


def _mapped(text: str, ranges: list[tuple[int, int]], items: set[str], before: dict) -> dict:
    """Findings with hit word ranges, mapped to code points of the text."""
    raw = text.encode()
    merged = _merge([*ranges, *((r["first"], r["end"]) for r in before["words"])])
    ends = [(m.start(), m.end()) for m in re.finditer(rb"[^ ]+", normalise(raw))]
    point = np.concatenate([[0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)])
    return {
        "n_words": before["n_words"],
        "words": [{"first": a, "end": b} for a, b in merged],
        "chars": [{"start": int(point[ends[a][0]]), "end": int(point[ends[b - 1][1]])} for a, b in merged],
        "items": sorted({*items, *before["items"]}),
    }


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    out: str = "contamination",
    window: int = WINDOW,
    block_words: int = BLOCK_WORDS,
    carry: list[str] | None = None,
) -> DataFrame:
    """docs with a struct column `out`: n_words, hit word ranges, hit code point ranges, item ids.

    An input column named like `out` is replaced. carry: the columns that are kept, all if None.
    """
    spark = docs.sparkSession
    bench = benchmark.select(F.col(item_id).alias("i"), F.col(item_text).alias("t")).filter("t is not null").distinct()
    total = bench.agg(F.sum(F.size(F.regexp_extract_all("t", F.lit(_WORD), F.lit(0))))).first()[0] or 0
    blocks = max(1, -(-total // block_words))
    kept = [c for c in docs.columns if c != out and (carry is None or c in {text, *carry})]
    found = docs.select(*kept).withColumn(out, F.lit(None).cast(_FOUND))
    for b in range(blocks):
        rows = bench.filter(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == b).collect()
        sent = spark.sparkContext.broadcast([(r.i, r.t) for r in rows])
        told = kept if b < blocks - 1 or carry is None else [c for c in kept if c in carry]

        def run(batches: Iterator[pa.RecordBatch], sent=sent, key=uuid.uuid4().hex, told=told) -> Iterator[pa.RecordBatch]:
            if key not in _built:
                _built.clear()
                _built[key] = Patterns(sent.value, window)
            known = _built[key]
            for batch in batches:
                had, column = batch.column(out).to_pylist(), batch.column(text)
                size = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
                part, got = np.cumsum(size) // BATCH_BYTES, []
                for p in np.unique(part):
                    lo, hi = int(np.searchsorted(part, p)), int(np.searchsorted(part, p, "right"))
                    got += scan_texts(column.slice(lo, hi - lo), known, had[lo:hi])
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in told), pa.array(got, _ARROW)], names=[*told, out])
            give_back()

        found = found.mapInArrow(run, found.select(*told, out).schema)
        if b < blocks - 1:
            found = cut(found)  # or the automata of all blocks would be held at once
    return found


def digest(found: DataFrame, doc_id: str = "doc_id", out: str = "contamination") -> DataFrame:
    """One row per document: word and hit counts and a digest of the item ids."""
    c = F.col(out)
    n_hit = F.aggregate(c["words"], F.lit(0).cast("long"), lambda a, r: a + r["end"] - r["first"])
    return found.select(
        F.col(doc_id),
        c["n_words"].alias("n_words"),
        n_hit.alias("n_hit"),
        F.size(c["items"]).cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.array_sort(c["items"])), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """docs without the documents that hold a benchmark window; same columns."""
    mark = "_contamination"
    return find_contamination(docs, benchmark, text, out=mark).filter(F.size(F.col(mark)["words"]) == 0).drop(mark)
