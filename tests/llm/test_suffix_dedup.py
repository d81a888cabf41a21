import random
from collections import Counter

from shelfspark.llm import suffix_dedup

from .common import docs, sha


def brute(rows, n=200):
    raw = [(t or "").encode() for _, t in rows]
    seen = Counter(b[i : i + n] for b in raw for i in range(len(b) - n + 1))
    out = []
    for (d, _), b in zip(rows, raw, strict=True):
        gone = bytearray(len(b))
        for i in range(len(b) - n + 1):
            if seen[b[i : i + n]] > 1:
                gone[i : i + n] = b"\x01" * n
        runs = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((d, len(b), sum(gone), runs, sha(bytes(c for c, g in zip(b, gone, strict=True) if not g))))
    return sorted(out, key=str)


def run(spark, rows):
    got = suffix_dedup.digest(suffix_dedup.remove_repeats(docs(spark, rows), carry=["doc_id"])).collect()
    return sorted((tuple(r) for r in got), key=str)


def cases():
    rng = random.Random(3)
    prose = lambda n: "".join(rng.choice("abcdeé ") for _ in range(n))
    passage, other = prose(260), prose(205)
    rows = [(i, prose(rng.randrange(600))) for i in range(25)]
    rows += [(100 + i, prose(rng.randrange(150)) + passage[rng.randrange(40) :] + prose(rng.randrange(150))) for i in range(10)]
    rows += [(200, other), (201, "x" + other), (202, other[:199] + "?"), (203, "ab" * 300), (204, "z" * 700), (205, passage + passage)]
    near = list(prose(900))
    for i in range(8):
        t = list(near)
        for _ in range(3):
            t[rng.randrange(900)] = "#"
        rows.append((300 + i, "".join(t)))
    return [*rows, (1, rows[1][1]), (400, None), (401, ""), (None, passage), (402, prose(200)), (403, "é" * 150)]


def test_against_brute_force(spark):
    rows = cases()
    assert run(spark, rows) == brute(rows)


def test_shuffle_joins_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "BROADCAST_RANGES", -1)
    monkeypatch.setattr(suffix_dedup, "FILTER_ROWS", -1)
    rows = cases()
    assert run(spark, rows) == brute(rows)


def test_slices_of_long_texts_give_the_same(spark):
    rng = random.Random(9)
    a, b = ("".join(rng.choice("abcdefgh é") for _ in range(n)) for n in (90_000, 700))
    rows = [(1, a), (2, b), (3, "x" + a[40_000:40_900] + "y" + b[:300]), (4, b[150:] + a[:199])]
    want = brute(rows)
    assert run(spark, rows) == want
    raw = a.encode()
    whole = suffix_dedup.Anchors(raw, 0, len(raw), 200, 64)
    for step in (1000, 333, 40_000):
        parts = [suffix_dedup.Anchors(raw, lo, lo + step, 200, 64) for lo in range(0, len(raw), step)]
        assert [p for x in parts for p in x.p.tolist()] == whole.p.tolist()
        assert [g for x in parts for g in x.gram.tolist()] == whole.gram.tolist()


def test_copies_of_one_text_and_a_common_passage(spark):
    """A hot group of copies, and a passage within many different texts whose edges differ."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(6))
    passage = " ".join(word() for _ in range(60))
    rows = [(i, "copy " + passage[:250]) for i in range(60)] + [(100 + i, f"{word()} {passage[i % 9 : 380 - i % 7]} {word()} {word()}") for i in range(60)]
    assert run(spark, rows) == brute(rows)


def test_empty_and_short(spark):
    assert run(spark, []) == []
    assert run(spark, [(1, "short"), (2, None)]) == brute([(1, "short"), (2, None)])


def test_spans_and_columns(spark):
    d = docs(spark, [(1, "q" + "abcd" * 60), (2, "abcd" * 60 + "r")])
    got = {r.doc_id: r for r in suffix_dedup.remove_repeats(d).collect()}
    assert [(s.start, s.end) for s in got[1].spans] == [(1, 241)] and bytes(got[2].kept) == b"r" and got[1].n_words == "own n_words"
