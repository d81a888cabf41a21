import random
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from shelfspark.llm import packing

from .common import TEXTS, crc, docs

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = ["Don't stop! it's 12.5%, a.b,c", "İİ. İ, ΣΑΣ. ŉ, ǆ.", "café cafe\u0301.", "日本語, ok.", "...", ",", "tab\tand\u00a0nbsp  two", "x" * 300, "A.\nB,\n\n C"]


def check(spark, rows, capacity=packing.CAPACITY, **kw):
    tokenizer = Tokenizer.from_file(PATH)
    want = sorted(([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2] for _, t in rows), key=str)
    got = packing.pack_documents(docs(spark, rows), PATH, capacity=capacity, **kw).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    ids = defaultdict(list)
    for (d, t) in rows:
        ids[d].append([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2])
    for d, texts in ids.items():
        if len(texts) == 1:
            at = 0
            for r in sorted(by_doc[d], key=lambda r: r.start):
                assert r.start == at and r.doc_tokens == len(texts[0]) and r.ids_crc32 == crc(texts[0][at : at + r.length])
                at += r.length
            assert at == len(texts[0])
    loads = []
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        loads.append(at)
    assert sum(loads) == sum(map(len, want)) and max(loads, default=0) <= capacity
    return loads


def test_round_trip_with_odd_texts(spark):
    check(spark, [*TEXTS, *((100 + i, t) for i, t in enumerate(ODD))])


def test_nothing_is_padded(spark):
    rng = random.Random(0)
    rows = [(i, " ".join(rng.choice(["red", "green", "Blueish,", "x9"]) for _ in range(rng.randrange(80)))) for i in range(300)]
    loads = check(spark, rows, 128, block_windows=8)
    assert all(n == 128 or n & (n - 1) == 0 for n in loads)


def test_empty_table(spark):
    assert check(spark, []) == []


def test_differencing_balances():
    rng = random.Random(2)
    n = [rng.randrange(1, 1000) for _ in range(200)]
    groups = packing.differencing(n, 10)
    sums = [sum(n[i] for i in g) for g in groups]
    assert sorted(i for g in groups for i in g) == list(range(200)) and max(sums) - min(sums) <= 20
    assert [len(g) for g in packing.differencing([5, 4], 4)].count(0) == 2


def test_the_number_of_windows_rises_until_all_fit(monkeypatch):
    asked, real = [], packing.differencing
    monkeypatch.setattr(packing, "differencing", lambda n, k: asked.append(k) or real(n, k))
    windows = packing.pack_lengths(np.array([60] * 20), 100)
    assert asked[0] == 12 and asked[-1] == 20 and sorted(sum(n for *_, n in w) for w in windows) == [100] * 12
    whole = sum(n == 60 for w in windows for *_, n in w)
    assert whole >= 12
    asked.clear()
    windows = packing.pack_lengths(np.array([25] * 40), 100)
    assert asked == [10] and all(n == 25 for w in windows for *_, n in w)


def test_few_documents_are_cut():
    rng = np.random.default_rng(8)
    lengths = rng.integers(50, 1500, 1400)
    windows = packing.pack_lengths(lengths, 4096)
    pieces = sum(len(w) for w in windows)
    assert pieces < 1.35 * len(lengths) and all(sum(n for *_, n in w) in (4096, *(1 << i for i in range(12))) for w in windows)


def test_each_length_is_covered_once():
    rng = np.random.default_rng(5)
    for _ in range(30):
        lengths = rng.integers(1, 300, rng.integers(1, 40))
        seen = [np.zeros(n, int) for n in lengths]
        for window in packing.pack_lengths(lengths, 64):
            assert sum(n for *_, n in window) <= 64
            for d, start, n in window:
                seen[d][start : start + n] += 1
        assert all((s == 1).all() for s in seen)


def test_cache_reset_changes_nothing():
    import pyarrow as pa

    texts = pa.array([*ODD, *(t for _, t in TEXTS)])
    small, large = packing.WordCache(PATH, 5), packing.WordCache(PATH)
    for _ in range(2):
        a, b = small.encode(texts, 2), large.encode(texts, 2)
        assert (a[0] == b[0]).all() and (a[1] == b[1]).all()
