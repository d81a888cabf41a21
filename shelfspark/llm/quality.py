"""Quality classifier: ordinal cumulative-link regression on graded ratings.

P(grade > j | text) = sigmoid(w . x - threshold_j) with one weight vector over
hashed text features and ordered thresholds. Features are the distinct
lower-cased words of the whole text, words that follow themselves, words in
capitals or with runs of marks, and coarse levels of shares (capitals, marks,
repeated words). The expected grade and the probability of the top grade decide.

Ratings are fitted on a bounded sample of at most `sample_rows` ids chosen by a hash
of the id; scoring covers every row. Of an id that is rated more than once the lowest
grade counts, and of one with several texts the least text, so repeated rows change
nothing. Null and empty texts have no word features and get the score of the
thresholds and levels alone. Very long texts count in full; a worker holds some
BATCH_BYTES of text, or one text, with its words. With no ratings every row is kept
with null scores; equal scores need no order, as a threshold decides. Columns named
like the results are replaced. Empty tables give no rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pandas.util import hash_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .memory import give_back

DIMS = 1 << 18
STEMS = (4, 5)
SAMPLE_ROWS = 8000
EPOCHS = 150
LEAST_ROWS = 12
SPARSE = 2e-3
KEEP_TAIL = 0.5
BATCH_BYTES = 4_000_000

_MARKS = r"[^\pL\pN_\s]{2}|^[^\pL\pN_]+$"


def _hashed(strings: pa.Array, kind: str) -> np.ndarray:
    """Cells of strings, each distinct one hashed once."""
    coded = strings.dictionary_encode()
    names = coded.dictionary.to_numpy(zero_copy_only=False)
    cells = hash_array(names, hash_key=f"{kind:16.16}", categorize=False) % np.uint64(DIMS) if len(names) else np.zeros(0, np.uint64)
    return cells.astype(np.int64)[coded.indices.to_numpy(zero_copy_only=False)]


def word_features(words: pa.Array) -> tuple[np.ndarray, np.ndarray, dict[str, np.ndarray]]:
    """(word, cell) of each word and its stems, and which words are in capitals, have marks, have digits."""
    plain = pc.utf8_trim(pc.utf8_lower(words), characters=".,;:!?\"'()")
    of, cells = [np.arange(len(words))], [_hashed(plain, "word")]
    size = pc.utf8_length(plain).to_numpy(zero_copy_only=False)
    for k in STEMS:
        long = np.flatnonzero(size > k)
        of.append(long)
        cells.append(_hashed(pc.utf8_slice_codeunits(plain.take(pa.array(long)), 0, k), f"stem {k}"))
    told = {
        "caps": pc.and_(pc.utf8_is_upper(words), pc.greater(pc.utf8_length(words), 1)),
        "marks": pc.match_substring_regex(words, _MARKS),
        "digits": pc.match_substring_regex(words, r"\p{Nd}"),
    }
    return np.concatenate(of), np.concatenate(cells), {k: v.to_numpy(zero_copy_only=False) for k, v in told.items()}


class Features:
    """Hashed cells of texts, each once in a text; `wanted` leaves only those that carry weight.

    Texts are split and their words numbered in batches, so what a word gives is made
    once in a batch; nothing of a batch is kept.
    """

    def __init__(self, wanted: set[int] | None = None):
        self.wanted = None if wanted is None else np.zeros(DIMS, bool)
        if wanted:
            self.wanted[list(wanted)] = True
        self.levels: dict[str, int] = {}

    def level(self, name: str) -> int:
        if name not in self.levels:
            self.levels[name] = int(_hashed(pa.array([name]), "level")[0])
        return self.levels[name]

    def batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(row, cell), sorted, of the distinct cells of each text."""
        parts = pc.utf8_split_whitespace(pc.utf8_trim_whitespace(pc.fill_null(texts, "")))
        flat, sizes = parts.flatten(), parts.value_lengths().to_numpy()
        full = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
        row = np.repeat(np.arange(len(texts)), sizes)[full]
        coded = flat.filter(pa.array(full)).dictionary_encode()
        code, kinds = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), max(1, len(coded.dictionary))
        of, cell, told = word_features(coded.dictionary)
        n = np.bincount(row, minlength=len(texts))
        share = {k: np.bincount(row, v[code], len(texts)) for k, v in told.items()}
        same = (row[1:] == row[:-1]) & (code[1:] == code[:-1])
        share["again"] = np.bincount(row[1:][same], minlength=len(texts))
        pairs, times = np.unique(row * kinds + code, return_counts=True)
        first, word = pairs // kinds, pairs % kinds
        top, longest = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
        np.maximum.at(top, first, times)
        np.maximum.at(longest, first, pc.utf8_length(coded.dictionary).to_numpy(zero_copy_only=False).astype(np.int64)[word])
        share["top"], share["kinds"] = top, np.bincount(first, minlength=len(texts))
        total = np.maximum(n, 1)
        level = {k: np.where(v > 0, np.maximum(1, 10 + np.floor(np.log2(np.where(v > 0, v / total, 1)))), 0).astype(int) for k, v in share.items()}
        level |= {"words": np.log2(total).astype(int), "longest": np.log2(longest + 1).astype(int)}
        rows, cells = [], []
        for name, values in level.items():
            seen, place = np.unique(values, return_inverse=True)
            rows.append(np.arange(len(texts)))
            cells.append(np.array([self.level(f"{name} {v}") for v in seen.tolist()], np.int64)[place])
        if self.wanted is not None:
            of, cell = of[self.wanted[cell]], cell[self.wanted[cell]]
        order = np.argsort(of, kind="stable")
        of, cell = of[order], cell[order]
        count = np.bincount(of, minlength=kinds)
        begin = np.cumsum(count) - count
        some = count[word] > 0
        first, word = first[some], word[some]
        each = count[word]
        end = np.cumsum(each)
        rows.append(np.repeat(first, each))
        cells.append(cell[np.arange(int(each.sum())) + np.repeat(begin[word] - (end - each), each)])
        key = np.unique(np.concatenate(rows).astype(np.int64) * DIMS + np.concatenate(cells))
        row, cell = key // DIMS, key % DIMS
        if self.wanted is not None:
            row, cell = row[self.wanted[cell]], cell[self.wanted[cell]]
        return row, cell

    def batches(self, texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(first, end, row, cell) of parts of the texts that hold some BATCH_BYTES each."""
        size = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
        part = np.cumsum(size) // BATCH_BYTES
        for p in np.unique(part):
            lo, hi = int(np.searchsorted(part, p)), int(np.searchsorted(part, p, "right"))
            yield lo, hi, *self.batch(texts.slice(lo, hi - lo))

    def __call__(self, text: str | None) -> list[int]:
        return self.batch(pa.array([text], pa.string()))[1].tolist()


class Ordinal:
    """Shared weights and ordered thresholds."""

    def __init__(self, weights: np.ndarray, thresholds: np.ndarray):
        self.weights, self.thresholds = weights, thresholds

    @classmethod
    def fit(cls, owner: np.ndarray, every: np.ndarray, grades: np.ndarray, levels: int, epochs: int = EPOCHS, rate: float = 0.2, sparse: float = SPARSE, least: int = LEAST_ROWS) -> Ordinal:
        """Proximal Adagrad on the log-likelihood of the cumulative-link model.

        owner and every: row and cell of each feature. An L1 penalty and a least
        number of rows keep rare words from being learned by heart.
        """
        n = len(grades)
        seen = np.bincount(every, minlength=DIMS) >= least
        ok = seen[every]
        cells = np.flatnonzero(seen)
        local = (np.cumsum(seen) - 1).astype(np.int32)[every[ok]]
        owner = owner[ok].astype(np.int32)
        w, gw = np.zeros(len(cells)), np.full(len(cells), 1e-8)
        theta, gt = np.concatenate([[-0.5], np.zeros(levels - 2)]), np.full(levels - 1, 1e-8)
        above = (grades[:, None] > np.arange(levels - 1)).astype(float)
        for _ in range(epochs):
            cuts = np.concatenate([[theta[0]], theta[0] + np.cumsum(np.exp(theta[1:]))])
            score = np.bincount(owner, w[local], n)
            p = 1 / (1 + np.exp(-(score[:, None] - cuts)))
            d = p - above
            grad = np.bincount(local, d.sum(1)[owner], len(cells)) / n
            gc = -d.mean(0)
            g = np.concatenate([[gc.sum()], [gc[j:].sum() * np.exp(theta[j]) for j in range(1, levels - 1)]])
            gw += grad**2
            gt += g**2
            step = rate / np.sqrt(gw)
            w -= step * grad
            w = np.sign(w) * np.maximum(np.abs(w) - step * sparse, 0)
            theta -= rate * g / np.sqrt(gt)
        weights = np.zeros(DIMS, np.float32)
        weights[cells] = w
        return cls(weights, np.concatenate([[theta[0]], theta[0] + np.cumsum(np.exp(theta[1:]))]))

    def tails(self, cells: list[int]) -> np.ndarray:
        """P(grade > j) for each j."""
        score = float(self.weights[cells].sum())
        return 1 / (1 + np.exp(-(score - self.thresholds)))


def grade(quality: str = "quality", toxic: str = "toxic") -> Column:
    """0 toxic, 1 poor, 2 good."""
    return F.when(F.col(toxic) == 1, 0).when(F.col(quality) == 0, 1).when(F.col(quality) == 1, 2)


def fit(docs: DataFrame, ratings: DataFrame, doc_id: str = "doc_id", text: str = "text", grades: str = "grade", levels: int = 3, sample_rows: int = SAMPLE_ROWS) -> Ordinal | None:
    """Model from rows of ratings (doc_id, grade); None without any rated text."""
    rated = (
        ratings.select(F.col(doc_id).alias("_id"), F.col(grades).cast("int").alias("_grade"))
        .dropna()
        .groupBy("_id")
        .agg(F.min("_grade").alias("_grade"))
        .orderBy(F.xxhash64("_id"), "_id")
        .limit(sample_rows)
    )
    chosen = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text")).join(F.broadcast(rated), "_id")
    chosen = chosen.groupBy("_id", "_grade").agg(F.min("_text").alias("_text"))  # at most sample_rows rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        for batch in batches:
            for lo, hi, row, cell in features.batches(batch.column(0)):
                upto = np.searchsorted(row, np.arange(hi - lo + 1)).astype(np.int32)
                cells = pa.ListArray.from_arrays(pa.array(upto), pa.array(cell.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([cells, batch.column(1).slice(lo, hi - lo)], names=["cells", "grade"])

    got = chosen.select("_text", "_grade").mapInArrow(run, "cells array<int>, grade int").toArrow()
    if not len(got):
        return None
    cells = got.column("cells").combine_chunks()
    owner = np.repeat(np.arange(len(cells), dtype=np.int32), cells.value_lengths().to_numpy())
    return Ordinal.fit(owner, cells.flatten().to_numpy(), got.column("grade").to_numpy(), levels)


_models: dict[str, tuple[Ordinal, Features]] = {}


def score(docs: DataFrame, model: Ordinal | None, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """The carried columns (all if None) with expected_grade and p_top."""
    keep = [c for c in (docs.columns if carry is None else carry) if c not in ("expected_grade", "p_top")]
    blank = F.lit(None).cast("double")
    shaped = docs.select(*keep, blank.alias("expected_grade"), blank.alias("p_top"))
    if model is None:
        return shaped
    sent, names = docs.sparkSession.sparkContext.broadcast(model), shaped.columns
    token = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if token not in _models:
            _models.clear()
            _models[token] = sent.value, Features(set(np.flatnonzero(sent.value.weights).tolist()))
        m, features = _models[token]
        for batch in batches:
            score = np.zeros(batch.num_rows)
            for lo, hi, row, cell in features.batches(batch.column(text)):
                score[lo:hi] = np.bincount(row, m.weights[cell].astype(np.float64), hi - lo)
            tails = 1 / (1 + np.exp(-(score[:, None] - m.thresholds)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(tails.sum(1)), pa.array(tails[:, -1])], names=names)
        give_back()

    return docs.mapInArrow(run, shaped.schema)


def keep_good(docs: DataFrame, model: Ordinal | None, text: str = "text", least: float = KEEP_TAIL) -> DataFrame:
    """docs without those whose probability of the top grade is below `least`; same columns."""
    if model is None:
        return docs
    return score(docs, model, text).filter(F.col("p_top") >= least).select(*docs.columns)
