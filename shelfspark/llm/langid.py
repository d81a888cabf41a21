"""Language identification by prediction by partial matching over bytes.

Each language has a variable-order context tree of up to `ORDER` bytes with
escape probabilities (an unseen byte escapes to the next shorter context). The
statistics are frozen after learning, so the code length of a byte after a
context is a constant: the trees of all languages share one node numbering and a
table of code lengths per node and byte, and a text is scored with two look-ups
per byte and language over its whole length.

Learning takes at most `docs_per_lang` rows of each language, chosen by a hash
of id and text, and counts their whole texts in Spark; only the counts of
distinct byte runs reach the driver.

Null text or text without a letter is `und` with score 0, and so is everything
when there is nothing to learn from. Ties go to the first language by name.
Empty text is `und`. Repeated rows are judged one by one.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut

ORDER = 3
DOCS_PER_LANG = 300
LEAST_SEEN = 3
BROADCAST_LANGS = 10_000
EDGE = 255  # never a byte of UTF-8: stands before a text
UNKNOWN = "und"
_PAD = bytes([EDGE]) * ORDER
_SLICE = 1 << 20


def count_runs(rows: DataFrame, lang: str, text: str) -> DataFrame:
    """Counts of each run of ORDER + 1 bytes by language; the run is packed into a long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                b = np.frombuffer(_PAD + t.encode(), np.uint8).astype(np.int64)
                grams = (b[:-3] << 24) | (b[1:-2] << 16) | (b[2:-1] << 8) | b[3:]
                keys, n = np.unique(grams, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(keys), pa.string()), pa.array(keys), pa.array(n.astype(np.int64))], names=["lang", "run", "n"])

    counted = rows.select(lang, text).mapInArrow(run, "lang string, run long, n long")
    return counted.groupBy("lang", "run").agg(F.sum("n").alias("n"))


class Trees:
    """Frozen trees of all languages: symbol of a byte, node of a context, code lengths in bits."""

    def __init__(self, langs: list[str], runs: dict[str, tuple[np.ndarray, np.ndarray]]):
        self.langs = langs
        seen = np.unique(np.concatenate([((r[:, None] >> np.array([24, 16, 8, 0])) & 255).ravel() for r, _ in runs.values()]))
        symbols = [b for b in seen.tolist() if b != EDGE]
        self.symbol = np.zeros(256, np.int64)  # 0: a byte that was never seen
        self.symbol[symbols] = np.arange(1, len(symbols) + 1)
        self.symbol[EDGE] = len(symbols) + 1
        a = self.a = len(symbols) + 2
        split = {k: (self.symbol[(r[:, None] >> np.array([24, 16, 8, 0])) & 255], n) for k, (r, n) in runs.items()}
        power = [a**i for i in range(ORDER + 1)]

        def key(s: np.ndarray, order: int) -> np.ndarray:
            """Number of the last `order` bytes before the final one."""
            return sum(s[:, ORDER - 1 - i] * power[i] for i in range(order)) if order else np.zeros(len(s), np.int64)

        contexts = [np.zeros(1, np.int64)]
        for order in range(1, ORDER + 1):
            keys = np.concatenate([key(s, order) for s, _ in split.values()])
            n = np.concatenate([n for _, n in split.values()])
            kinds, inverse = np.unique(keys, return_inverse=True)
            contexts.append(kinds[np.bincount(inverse, n) >= LEAST_SEEN])
        first = np.cumsum([0] + [len(c) for c in contexts])
        node = np.zeros(1, np.int32)  # of each context of the order: its longest kept suffix
        parent = [np.zeros(1, np.int64)]
        for order in range(1, ORDER + 1):
            wide = np.tile(node, a)
            parent.append(wide[contexts[order]].astype(np.int64))
            wide[contexts[order]] = first[order] + np.arange(len(contexts[order]))
            node = wide
        self.node, self.power = node, power[ORDER - 1]
        total = int(first[-1])
        self.bits = np.zeros((len(langs), total * a), np.float32)
        for k, lang in enumerate(langs):
            s, n = split[lang]
            counts = np.zeros((total, a))
            for order in range(ORDER + 1):
                keys = key(s, order)
                at = np.searchsorted(contexts[order], keys)
                at[at == len(contexts[order])] = 0
                ok = contexts[order][at] == keys if len(contexts[order]) else np.zeros(len(keys), bool)
                np.add.at(counts, (first[order] + at[ok], s[ok, ORDER]), n[ok])
            p = np.full((total, a), 1.0 / 256)
            for order in range(ORDER + 1):
                rows = slice(int(first[order]), int(first[order + 1]))
                c = counts[rows]
                base = p[parent[order]] if order else np.full((1, a), 1.0 / 256)
                t, d = c.sum(1, keepdims=True), (c > 0).sum(1, keepdims=True)
                own = np.where(c > 0, c, d * base) / np.maximum(t + d, 1)
                p[rows] = np.where(t > 0, own, base)
            bits = -np.log2(p)
            bits[:, self.symbol[EDGE]] = 0
            self.bits[k] = bits.ravel()

    def code_lengths(self, texts: list[bytes]) -> np.ndarray:
        """Bits of each text under each language, over all its bytes."""
        out = np.zeros((len(texts), len(self.langs)))
        data = np.frombuffer(_PAD + _PAD.join(texts), np.uint8)
        starts = np.cumsum([ORDER] + [len(t) + ORDER for t in texts])[:-1]
        for lo in range(ORDER, len(data), _SLICE):
            hi = min(len(data), lo + _SLICE)
            s = self.symbol[data[lo - ORDER : hi]]
            context = s[:-3] * self.power + s[1:-2] * self.a + s[2:-1]
            at = self.node[context].astype(np.int64) * self.a + s[3:]
            first = max(0, int(np.searchsorted(starts, lo, "right")) - 1)
            last = int(np.searchsorted(starts, hi))
            edges = np.maximum(starts[first:last] - lo, 0)
            for k in range(len(self.langs)):
                out[first:last, k] += np.add.reduceat(self.bits[k][at], edges)
        return out


def has_letter(texts: pa.Array) -> np.ndarray:
    plain = pc.match_substring_regex(texts, r"\p{L}")
    return pc.fill_null(plain, False).to_numpy(zero_copy_only=False)


def learn(rows: DataFrame, lang: str = "lang", text: str = "text", tie: str = "doc_id", docs_per_lang: int = DOCS_PER_LANG) -> Trees | None:
    """Trees from rows with a language and a text; None if there are none."""
    known = rows.filter(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(
        F.col(lang).alias("_lang"), F.col(text).alias("_text"), F.col(tie).alias("_tie"), F.xxhash64(tie).alias("_h")
    )
    # a share of each language by hash, from counts alone, so that few rows and their texts are ranked
    share = cut(known.groupBy("_lang").agg((F.lit(2.0 * docs_per_lang + 50) / F.count("*")).alias("_share")))
    share = F.broadcast(share) if share.count() <= BROADCAST_LANGS else share
    point = F.pmod(F.col("_h"), F.lit(1 << 30)) / F.lit(1 << 30)
    order = Window.partitionBy("_lang").orderBy("_h", "_tie")
    chosen = known.join(share, "_lang").filter(point < F.col("_share")).withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= docs_per_lang)
    got = count_runs(chosen, "_lang", "_text").toPandas()
    langs = sorted(got["lang"].unique().tolist())
    if not langs:
        return None
    return Trees(langs, {k: (g["run"].to_numpy(), g["n"].to_numpy()) for k, g in got.groupby("lang")})


_held: dict[str, Trees | None] = {}


def predict(docs: DataFrame, trees: Trees | None, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """The carried columns (all if None) with lang_pred and score, the posterior of the best language."""
    keep = [c for c in (docs.columns if carry is None else carry) if c not in ("lang_pred", "score")]
    if trees is None:
        return docs.select(*keep, F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    sent = docs.sparkSession.sparkContext.broadcast(trees)
    token = uuid.uuid4().hex
    schema = docs.select(*keep, F.lit("").cast("string").alias("lang_pred"), F.lit(0.0).alias("score")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if token not in _held:
            _held.clear()
            _held[token] = sent.value
        tree = _held[token]
        for batch in batches:
            texts = batch.column(text)
            known = has_letter(texts)
            names, scores = [], []
            part: list[bytes] = []
            bits = []
            size = 0
            for t, ok in zip(texts, known, strict=True):
                raw = t.as_py().encode() if ok else b""
                part.append(raw)
                size += len(raw)
                if size >= 4 * _SLICE:
                    bits.append(tree.code_lengths(part))
                    part, size = [], 0
            if part:
                bits.append(tree.code_lengths(part))
            if len(known):
                b = np.concatenate(bits)
                best = b.argmin(1)
                share = 1.0 / np.exp2(np.clip(b.min(1, keepdims=True) - b, -1000, 0)).sum(1)
                names = [tree.langs[i] if ok else UNKNOWN for i, ok in zip(best, known, strict=True)]
                scores = np.where(known, share, 0.0)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=[*keep, "lang_pred", "score"])

    return docs.mapInArrow(run, schema)


def held_out(doc_id: str = "doc_id") -> Column:
    """True for the fold that is never learned from; a null id is in no fold."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))
