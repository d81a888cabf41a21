import numpy as np
from pyspark.sql import functions as F

from shelfspark.llm import embed_dedup


def brute(rows):
    usable = [(i, np.array(v, float)) for i, v in rows if v and None not in v and np.isfinite(v).all() and np.any(v)]
    links = {i: 0 for i, _ in rows}
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, (a, x) in enumerate(usable):
        for b, y in usable[:k]:
            if len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.9:
                links[a] += 1
                links[b] += 1
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return sorted((i, links[i], find(i), find(i) == i) for i in links)


def cases():
    rng = np.random.default_rng(2)
    base = rng.normal(size=(12, 32))
    rows = []
    for i in range(240):
        v = base[i % 12] + rng.normal(size=32) * [0.01, 0.15, 0.3, 0.8][i // 60]
        rows.append((i, [float(np.float32(x)) for x in v]))
    rows += [(300, None), (301, []), (302, [0.0] * 32), (303, [1.0, float("nan")]), (304, [1.0, None]), (305, [float("inf"), 1.0]), (306, rows[0][1]), (307, rows[0][1]), (308, [x * 1000 for x in rows[0][1]]), (309, [1.0, 2.0]), (310, [2.0, 4.0])]
    return rows


def run(spark, rows, kind="long"):
    frame = spark.createDataFrame(rows, f"vec_id {kind}, embedding array<float>").withColumn("c", F.lit(1)).withColumn("n_links", F.lit(1))
    return sorted(tuple(r) for r in embed_dedup.near_vectors(frame).collect())


def test_against_brute_force(spark):
    rows = cases()
    got, want = run(spark, rows), brute(rows)
    assert [(a[0], a[2]) for a in got] == [(a[0], a[2]) for a in want]
    assert sum(a[1] for a in got) >= 0.999 * sum(a[1] for a in want) and all(a[1] <= b[1] for a, b in zip(got, want, strict=True))


def test_empty_and_repeated_rows(spark):
    assert run(spark, []) == []
    assert run(spark, [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0])]) == [(1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False)]
    one, two = [1.0, 0.0], [0.0, 1.0]
    got = run(spark, [(5, one), (5, two), (7, [1.0, 0.01]), (6, [0.01, 1.0]), (8, [-1.0, -1.0])])
    assert got == [(5, 1, 5, True), (5, 1, 5, True), (6, 1, 5, False), (7, 1, 5, False), (8, 0, 8, True)]


def test_ids_of_other_types(spark):
    assert run(spark, [("b", [1.0, 0.0]), ("a", [1.0, 0.01]), ("c", None)], "string") == [("a", 1, "a", True), ("b", 1, "a", False), ("c", 0, "c", True)]


def test_hot_buckets_are_split(spark, monkeypatch):
    from shelfspark.operators import skew

    monkeypatch.setattr(skew, "ROOM", 3)
    rng = np.random.default_rng(5)
    base = rng.normal(size=16)
    rows = [(i, [float(np.float32(x)) for x in base + rng.normal(size=16) * 0.02]) for i in range(60)] + [(100 + i, [1.0] * 16) for i in range(20)]
    assert run(spark, rows) == brute(rows)


def test_recall_of_hashing():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    r = rng.normal(size=x.shape)
    r -= (r * x).sum(1, keepdims=True) * x
    r /= np.linalg.norm(r, axis=1, keepdims=True)
    a, b = embed_dedup.buckets(x), embed_dedup.buckets(0.9 * x + np.sqrt(0.19) * r)
    assert ((a[:, :, :1] == b) | (b[:, :, :1] == a)).any((1, 2)).mean() > 0.99


def test_hadamard_keeps_lengths():
    x = np.random.default_rng(1).normal(size=(5, 16))
    assert np.allclose(np.linalg.norm(embed_dedup._hadamard(x), axis=1), 4 * np.linalg.norm(x, axis=1))
