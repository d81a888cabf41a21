import random
import time
from collections import Counter

import numpy as np

from shelfspark.llm import minhash

from .common import TEXTS, docs


def bag(t):
    w = minhash.normalise((t or "").encode()).split()
    return Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else [])


def likeness(a, b):
    return sum((a & b).values()) / max(1, sum((a | b).values()))


def brute(rows):
    root = {d: d for d, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    bags = [(d, bag(t)) for d, t in rows]
    for i, (a, x) in enumerate(bags):
        for b, y in bags[:i]:
            if x and y and likeness(x, y) >= 0.8:
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return {d: find(d) for d in root}


def family(rng, size, words, changes, first):
    base = [f"w{rng.randrange(400)}" for _ in range(words)]
    out = []
    for i in range(size):
        w = list(base)
        for _ in range(rng.randrange(changes + 1)):
            w[rng.randrange(words)] = f"z{rng.randrange(10**6)}"
        out.append((first + i, " ".join(w)))
    return out


def test_classes_against_brute_force(spark):
    rng = random.Random(7)
    rows = [r for i in range(6) for r in family(rng, 30, 60 + 20 * i, 1 + i, 100 * i)]
    rows += [(900, rows[3][1]), (901, rows[3][1].upper()), (902, "one two"), (903, "One, two!"), (904, "a a a a a a a a a a"), (905, "a a a a a a a a a a a")]
    got = {r.doc_id: r.class_id for r in minhash.near_duplicates(docs(spark, rows)).collect()}
    assert got == brute(rows)


def test_shuffle_joins_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BROADCAST_IDS", -1)
    rows = family(random.Random(8), 40, 80, 3, 0)
    got = {r.doc_id: r.class_id for r in minhash.near_duplicates(docs(spark, rows)).collect()}
    assert got == brute(rows)


def test_classes_by_rounds_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(minhash, "EDGES_AT_ONCE", 1)
    rows = family(random.Random(9), 40, 80, 3, 0)
    assert {r.doc_id: r.class_id for r in minhash.near_duplicates(docs(spark, rows)).collect()} == brute(rows)


def test_shuffle_files_go_with_their_queries(spark):
    """what one step has shuffled does not stay on disk through the next ones."""

    def files():
        found = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {x for i in range(found.size()) if (x := found.apply(i).getName()).startswith("shuffle_")}

    rows, key = family(random.Random(12), 40, 80, 6, 0), "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, setting = files(), spark.conf.get(key)
    found = minhash.classes(docs(spark, rows), "doc_id", "text", 0.8, minhash.BANDS, minhash.ROWS)
    end = time.time() + 5
    while (left := files() - before) and time.time() < end:
        time.sleep(0.1)
    assert not left and spark.conf.get(key) == setting and found.count() > 30


def test_a_class_needs_few_jobs(spark):
    """short lists of links are not joined round after round."""
    from shelfspark.operators.components import connected_components

    rng = random.Random(13)
    edges = [(rng.randrange(-300, 300), rng.randrange(-300, 300)) for _ in range(250)] + [(i, i + 1) for i in range(1000, 1400)]
    frame = spark.createDataFrame([*edges, (5, None), (7, 7), edges[0]], "a long, b long")
    slow = {tuple(r) for r in connected_components(frame, "a", "b").collect()}
    spark.sparkContext.setJobGroup("few", "")
    try:
        fast = connected_components(frame, "a", "b", at_once=1000)
        assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("few")) <= 8
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert {tuple(r) for r in fast.collect()} == slow and len(slow) > 600
    assert connected_components(frame.filter("false"), "a", "b", at_once=1000).collect() == []


def test_awkward_rows(spark):
    got = [(r.doc_id, r.class_id, r.kept) for r in minhash.near_duplicates(docs(spark)).collect()]
    assert len(got) == len(TEXTS)
    found = {d: c for d, c, _ in got if d is not None}
    assert found[2] == 1 and found[9] == 7 and all(found[d] == d for d in (3, 4, 5, 6, 8)) and (None, None, True) in got
    assert minhash.near_duplicates(docs(spark, [])).collect() == []


A, B = ("a quick test of some words that repeat here", "other text with nothing in common at all")


def test_an_id_with_two_texts(spark):
    got = {(r.doc_id, r.class_id, r.kept): r.class_key for r in minhash.near_duplicates(docs(spark, [(5, B), (5, A), (9, B), (12, A), (None, A)])).collect()}
    assert set(got) == {(5, 5, True), (9, 5, False), (12, 5, False), (None, 5, False)} and got[9, 5, False] != got[12, 5, False] == got[None, 5, False]


def test_ids_of_other_types(spark):
    got = {r.doc_id: r.class_id for r in minhash.near_duplicates(docs(spark, [("x", A), ("b", A + "!"), ("c", B)], "doc_id string, text string")).collect()}
    assert got == {"x": "b", "b": "b", "c": "c"}


def test_repeated_rows_leave_one(spark):
    rows = [(1, A), (1, A), (2, A), (3, None), (3, None), (4, B), (None, B), (None, "third text of five words"), (None, "third text of five words")]
    left = minhash.keep_one(docs(spark, rows)).select("doc_id", "text").collect()
    assert sorted(map(str, map(tuple, left))) == sorted(map(str, [(1, A), (3, None), (3, None), (4, B), (None, "third text of five words")]))


def test_hot_buckets_are_split(spark, monkeypatch):
    from shelfspark.operators import skew

    monkeypatch.setattr(minhash, "BUCKET_ROOM", 2)
    monkeypatch.setattr(skew, "ROOM", 3)
    rows = family(random.Random(11), 50, 90, 8, 0) + [(100 + i, A) for i in range(30)]
    assert {r.doc_id: r.class_id for r in minhash.near_duplicates(docs(spark, rows)).collect()} == brute(rows)


def test_one_document_stays(spark):
    d = docs(spark)
    kept = minhash.keep_one(d)
    assert kept.columns == d.columns and sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(x) for x in (1, 3, 4, 5, 6, 7, 8, None))


def test_registers_estimate_weighted_jaccard():
    rng = random.Random(1)
    errors = []
    for trial in range(40):
        a = [f"t{trial}w{rng.randrange(30)}" for _ in range(rng.randrange(40, 200))]
        b = list(a)
        for _ in range(rng.randrange(1, 8)):
            b[rng.randrange(len(b))] = f"y{rng.randrange(10**6)}"
        texts = [" ".join(x).encode() for x in (a, b)]
        s = minhash.signatures(*minhash.shingles(texts), 2, 384)
        errors.append((s[0] == s[1]).mean() - likeness(bag(texts[0].decode()), bag(texts[1].decode())))
    assert abs(np.mean(errors)) < 0.01 and np.std(errors) < 0.035


def test_weights_of_shingles():
    d, h, w = minhash.shingles([b"a a a a a a a", b"", b"x y", b"a b c d e"])
    assert d.tolist() == [0, 2, 3] and w.tolist() == [3, 1, 1] and len(set(h.tolist())) == 3
