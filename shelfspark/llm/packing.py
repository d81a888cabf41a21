"""Sequence packing by Karmarkar-Karp multiway differencing.

Documents become token ids of a public tokenizer plus an end id. Whole windows
are cut from long documents; the rests of a block of documents are dealt to
windows by multiway differencing: partial partitions with the largest spread are
merged, the fullest window of one with the emptiest of the other. The number of
windows is at first what the tokens need, and rises, with the differencing done
again, as long as any window exceeds the capacity. So up to here no rest is cut and
windows are nearly equal, each with a little room. Then the emptiest windows, those
beyond the number that full ones would need, are cut up: their documents fill the
room of the others, and what is left goes to windows of a power of two. Nothing is
padded, and only the documents of a few windows of a block are cut.

Blocks are bounded by tokens and stay in their input partition: there is no
shuffle and no group grows with the input. A lost task is recomputed from its
input split with the same result.

Null text counts as empty; an empty document is its end id. Ids are of any type;
repeated rows are packed one by one. A very long text is encoded as a whole, at some
ten bytes of worker memory a byte of text. Ties go by place in the input. Only the id
and the text are read, so other names can't clash. An empty table gives no rows.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .memory import give_back

CAPACITY = 4096
END_ID = 2
BLOCK_WINDOWS = 256
BATCH_BYTES = 4_000_000
CACHE_WORDS = 600_000
_PLAIN = "\u0250"  # letters below it stay one letter in lower case, but for U+0130
_LETTER = r"[a-zß-öø-ÿĀ-įı-ɏ]"

COLUMNS = [("start", "long"), ("length", "long"), ("ids_crc32", "long"), ("doc_tokens", "long"), ("sequence_id", "long"), ("offset", "long")]


class WordCache:
    """Token ids of texts, each distinct run between blanks being encoded once.

    Meant for the lower-casing word tokenizers whose tokens never span white
    space and whose words end in a marked token: a text's ids are those of its
    parts in order, and many plain words are encoded in one call and told apart
    by their last tokens. A full stop or comma after a letter is a part of its own.
    """

    def __init__(self, path: str, room: int = CACHE_WORDS):
        from tokenizers import Tokenizer

        self.tokenizer, self.room = Tokenizer.from_file(path), room
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.ends[[i for w, i in self.tokenizer.get_vocab().items() if w.endswith("</w>")]] = True
        self.stops = {c: self._each([c])[0][0] for c in ".,"}
        self._reset()

    def _reset(self) -> None:
        self.known: dict[str, int] = {}
        self.used = self.words = 0
        self.flat, self.first, self.count = np.zeros(1 << 16, np.uint32), np.zeros(1 << 14, np.int32), np.zeros(1 << 14, np.int32)

    def _each(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        got = [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        n = np.fromiter(map(len, got), np.int64, len(got))
        return np.fromiter((i for ids in got for i in ids), np.uint32, int(n.sum())), n

    def _joined(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same for words of letters alone, in one call."""
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, np.uint32)
        last = np.flatnonzero(self.ends[ids])
        if len(last) != len(words) or last[-1] != len(ids) - 1:
            return self._each(words)
        return ids, np.diff(last, prepend=-1)

    def _learn(self, words: list[str], ids: np.ndarray, n: np.ndarray) -> None:
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while self.words + len(words) > len(self.first):
            self.first, self.count = (np.concatenate([x, np.zeros_like(x)]) for x in (self.first, self.count))
        to = slice(self.words, self.words + len(words))
        self.flat[self.used : self.used + len(ids)] = ids
        self.first[to], self.count[to] = self.used + np.cumsum(n) - n, n
        self.known.update(zip(words, range(to.start, to.stop), strict=True))
        self.used, self.words = self.used + len(ids), to.stop

    def _table(self, uniques: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Flat ids of the distinct parts, where each begins, how many it has."""
        stop = np.zeros(len(uniques), np.uint32)
        for c, i in self.stops.items():
            stop[pc.match_substring_regex(uniques, f"{_LETTER}[{c}]$").to_numpy(zero_copy_only=False)] = i
        words = pc.if_else(pa.array(stop > 0), pc.utf8_slice_codeunits(uniques, 0, -1), uniques).to_pylist()
        if len(self.known) + len(words) > self.room:
            self._reset()
        found = list(map(self.known.get, words))
        if missing := [w for w in dict.fromkeys(w for w, k in zip(words, found, strict=True) if k is None)]:
            plain = [w for w in missing if w.isalpha() and (w.isascii() or (max(w) < _PLAIN and "\u0130" not in w))]
            for lo in range(0, len(plain), 2000):
                self._learn(part := plain[lo : lo + 2000], *self._joined(part))
            if other := list(dict.fromkeys(missing).keys() - set(plain)):
                self._learn(other, *self._each(other))
            found = list(map(self.known.get, words))
        of = np.array(found, np.int32)
        n = self.count[of]
        end = np.cumsum(n, dtype=np.int32)
        take = np.repeat(self.first[of] - (end - n), n)
        take += np.arange(len(take), dtype=np.int32)
        flat, n = np.insert(self.flat[take], end[stop > 0], stop[stop > 0]), n + (stop > 0).astype(np.int32)
        return flat, np.cumsum(n, dtype=np.int32) - n, n

    def encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids, each text followed by end_id, and the number of ids of each text."""
        low = pc.ascii_lower(pc.fill_null(texts, ""))
        parts = pc.split_pattern(pc.replace_substring(low, "\n", " "), " ")
        words = pc.dictionary_encode(parts.flatten())
        flat, first, count = self._table(words.dictionary)
        code = words.indices.to_numpy(zero_copy_only=False)
        # the end id is a part of its own after each text
        ends = np.cumsum(np.diff(parts.offsets.to_numpy()))
        code = np.insert(code, ends, len(first))
        flat, first, count = np.append(flat, np.uint32(end_id)).astype("<u4"), np.append(first, np.int32(len(flat))), np.append(count, np.int32(1))
        n = count[code]
        upto = np.cumsum(n, dtype=np.int32)
        take = np.repeat(first[code] - (upto - n), n)
        take += np.arange(len(take), dtype=np.int32)
        return flat[take], np.diff(upto[ends + np.arange(len(ends))].astype(np.int64), prepend=0)


_caches: dict[str, WordCache] = {}


def differencing(lengths: list[int], k: int) -> list[list[int]]:
    """Indexes of lengths in k groups of nearly equal sums (Karmarkar-Karp, largest spread first)."""
    heap = []
    for i, n in enumerate(lengths):
        heap.append((-n, i, [(n, i)]))
    heapq.heapify(heap)
    tick = len(heap)
    while len(heap) > 1:
        a = heapq.heappop(heap)[2]
        b = heapq.heappop(heap)[2]
        over = len(a) + len(b) - k
        if over <= 0:
            merged = [*a, *b]
        else:  # both lists are in descending order: the smallest of each meet the largest of the other's tail
            a_free, b_free = len(a) - over, len(b) - over
            merged = [*a[:a_free], *b[:b_free]]
            merged += [(x[0] + y[0], (x[1], y[1])) for x, y in zip(a[a_free:], reversed(b[b_free:]), strict=True)]
        merged.sort(key=lambda x: -x[0])
        low = merged[-1][0] if len(merged) == k else 0
        heapq.heappush(heap, (low - merged[0][0], tick, merged))
        tick += 1

    def members(node) -> list[int]:
        out, stack = [], [node]
        while stack:
            x = stack.pop()
            if isinstance(x, tuple):
                stack += x
            else:
                out.append(x)
        return sorted(out)

    groups = [members(node) for _, node in heap[0][2]] if heap else []
    return groups + [[] for _ in range(k - len(groups))]


def pack_lengths(lengths: np.ndarray, capacity: int) -> list[list[tuple[int, int, int]]]:
    """Sequences of pieces (document, start, length), covering each document once."""
    sequences, rests = [], []
    for d, n in enumerate(lengths.tolist()):
        for start in range(0, n - capacity + 1, capacity):
            sequences.append([(d, start, capacity)])
        if n % capacity:
            rests.append((d, n - n % capacity, n % capacity))
    total = sum(r[2] for r in rests)
    k, full = -(-total // capacity), total // capacity
    groups = differencing([r[2] for r in rests], k) if k else []
    while over := sum(sum(rests[i][2] for i in g) > capacity for g in groups):
        k += -(-over // 2)
        groups = differencing([r[2] for r in rests], k)
    loads = [sum(rests[i][2] for i in g) for g in groups]
    order = sorted(range(k), key=lambda g: (-loads[g], g))
    spare = [rests[i] for g in order[full:] for i in groups[g]]

    def take(room: int) -> list[tuple[int, int, int]]:
        """Pieces of spare rests of that many tokens, as long as there are any; the end of the last one is cut off."""
        out = []
        while room and spare:
            d, start, n = spare.pop()
            own = min(n, room)
            if own < n:
                spare.append((d, start, n - own))
            out.append((d, start + n - own, own))
            room -= own
        return out

    for g in order[:full]:
        sequences.append([*(rests[i] for i in groups[g]), *take(capacity - loads[g])])
    beyond = sum(r[2] for r in spare)
    while beyond:
        room = 1 << (beyond.bit_length() - 1)
        sequences.append(take(room))
        beyond -= room
    return sequences


def pack_documents(
    docs: DataFrame,
    tokenizer_path: str,
    doc_id: str = "doc_id",
    text: str = "text",
    capacity: int = CAPACITY,
    end_id: int = END_ID,
    block_windows: int = BLOCK_WINDOWS,
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    sequence_id holds the input partition in its upper bits and is not dense.
    """
    rows = docs.select(doc_id, text)
    kind = rows.schema[doc_id].dataType.simpleString()
    schema = f"`{doc_id}` {kind}, " + ", ".join(f"{c} {t}" for c, t in COLUMNS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer_path not in _caches:
            _caches[tokenizer_path] = WordCache(tokenizer_path)
        cache = _caches[tokenizer_path]
        pa.set_memory_pool(pa.system_memory_pool())  # gives large buffers back as soon as they are free
        sequence = TaskContext.get().partitionId() << 40
        held: list[tuple[pa.Array, np.ndarray, np.ndarray]] = []
        total = 0

        def flush() -> pa.RecordBatch:
            nonlocal sequence
            keys = pa.concat_arrays([h[0] for h in held])
            flat, lengths = np.concatenate([h[1] for h in held]), np.concatenate([h[2] for h in held])
            base = np.cumsum(lengths) - lengths
            out = []
            for pieces in pack_lengths(lengths, capacity):
                offset = 0
                for d, start, n in pieces:
                    a = int(base[d]) + start
                    out.append((d, start, n, zlib.crc32(flat[a : a + n].tobytes()), int(lengths[d]), sequence, offset))
                    offset += n
                sequence += 1
            cols = list(zip(*out, strict=True))
            arrays = [keys.take(pa.array(cols[0], pa.int64())), *(pa.array(c, pa.int64()) for c in cols[1:])]
            return pa.RecordBatch.from_arrays(arrays, names=[doc_id, *(c for c, _ in COLUMNS)])

        for batch in batches:
            size = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
            part = np.cumsum(size) // BATCH_BYTES
            for p in np.unique(part):
                lo, hi = int(np.searchsorted(part, p)), int(np.searchsorted(part, p, "right"))
                keys, texts = batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo)
                flat, lengths = cache.encode(texts, end_id)
                edge = np.concatenate([[0], np.cumsum(lengths)])
                at = 0
                while at < len(lengths):  # a block ends at the first document that fills it
                    to = min(len(lengths), int(np.searchsorted(edge, edge[at] + block_windows * capacity - total)))
                    to = max(to, at + 1)
                    held.append((keys.slice(at, to - at), flat[edge[at] : edge[to]], lengths[at:to]))
                    total += int(edge[to] - edge[at])
                    if total >= block_windows * capacity:
                        yield flush()
                        held, total = [], 0
                    at = to
        if held:
            yield flush()
        cache._reset()  # another task learns its words anew in little time, and other stages need the memory
        give_back()

    return rows.mapInArrow(run, schema)
