"""Quality classifier and language identification: held-out accuracy and awkward rows."""

import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from shelfspark.llm import langid, quality

from .common import TEXTS, docs

SF = "/root/testdata/sf0.1"


def test_language_held_out_accuracy(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    trees = langid.learn(rows.filter(~langid.held_out()), docs_per_lang=60)
    found = langid.predict(rows.filter(langid.held_out()), trees, carry=["doc_id", "lang"])
    assert found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0] > 0.97


def test_language_awkward_rows(spark):
    train = docs(spark, [(i, "the cat sat on the mat " * 3, "en") for i in range(4)] + [(9, "der hund und die katze " * 3, "de"), (10, None, "fr"), (11, "x", None)], "doc_id long, text string, lang string")
    trees = langid.learn(train)
    assert trees.langs == ["de", "en"]
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(docs(spark, [*TEXTS, (20, "12 34 !"), (21, "und die katze")]), trees).collect()}
    assert all(got[d] == ("und", 0.0) for d in (3, 4, 5, 20)) and got[21][0] == "de" and all(0 <= s <= 1 for _, s in got.values())
    assert {r.lang_pred for r in langid.predict(docs(spark), langid.learn(train.limit(0))).collect()} == {"und"}
    assert langid.predict(docs(spark, []), trees).collect() == []


def test_fold(spark):
    rows = spark.range(50).select(F.col("id").alias("doc_id")).select("doc_id", langid.held_out().alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)


def slow_bits(trees, counts, text):
    """Code length by the definition: escape to shorter contexts until the byte was seen."""
    data = langid._PAD + text
    total = 0.0
    kept = {}
    for order in range(4):
        sums = {}
        for lang_counts in counts.values():
            for g, n in lang_counts.items():
                c = g[3 - order : 3]
                sums[c] = sums.get(c, 0) + n
        kept |= {c: None for c, n in sums.items() if n >= langid.LEAST_SEEN or order == 0}
    own = counts["a"]

    def p(c, b):
        seen = {}
        for g, n in own.items():
            if g[3 - len(c) : 3] == c:
                seen[g[3]] = seen.get(g[3], 0) + n
        shorter = p(next(c[i:] for i in range(1, len(c) + 1) if c[i:] in kept), b) if c else 1 / 256
        t, d = sum(seen.values()), len(seen)
        if not t:
            return shorter
        return seen[b] / (t + d) if b in seen else d / (t + d) * shorter

    for i in range(3, len(data)):
        c = next(data[k:i] for k in range(i - 3, i + 1) if data[k:i] in kept)
        total -= np.log2(p(c, data[i]))
    return total


def test_code_lengths_against_the_definition():
    rng = random.Random(1)
    texts = {"a": bytes(rng.choice(b"abca ") for _ in range(300)), "b": bytes(rng.choice(b"xyab") for _ in range(300))}
    counts = {}
    for k, t in texts.items():
        d = langid._PAD + t
        counts[k] = {}
        for i in range(len(t)):
            counts[k][d[i : i + 4]] = counts[k].get(d[i : i + 4], 0) + 1
    runs = {k: (np.array([int.from_bytes(g, "big") for g in c]), np.array(list(c.values()))) for k, c in counts.items()}
    trees = langid.Trees(["a", "b"], runs)
    for t in (b"abcabc", b"xx", b"a", b"hello world", b"\xff\x00"[1:]):
        assert abs(trees.code_lengths([t])[0, 0] - slow_bits(trees, counts, t)) < 1e-3
    many = [bytes(rng.choice(b"abxy ") for _ in range(rng.randrange(50))) for _ in range(40)]
    assert np.allclose(trees.code_lengths(many), np.concatenate([trees.code_lengths([m]) for m in many]), atol=1e-3)


def test_quality_rejects_toxic_and_poor_and_keeps_good(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    ratings = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", quality.grade().alias("grade"))
    test = F.crc32(F.col("doc_id").cast("string")) % 4 == 0
    model = quality.fit(rows.filter(~test), ratings.filter(~test))
    assert (np.diff(model.thresholds) > 0).all()
    got = quality.score(rows.filter(test), model, carry=["doc_id"]).join(ratings, "doc_id")
    share = {r.grade: r.x for r in got.groupBy("grade").agg(F.avg((F.col("p_top") >= quality.KEEP_TAIL).cast("double")).alias("x")).collect()}
    assert share[2] > 0.97 and share[0] < 0.2 and share[1] < 0.2


def test_quality_awkward_rows(spark):
    ratings = spark.createDataFrame([(1, 2), (7, 1), (8, 0), (8, 2), (3, 1), (None, 1), (9, None)], "doc_id long, grade int")
    model = quality.fit(docs(spark), ratings)
    got = quality.score(docs(spark), model)
    assert got.count() == len(TEXTS) and got.filter("p_top is null or expected_grade is null").count() == 0
    assert quality.fit(docs(spark), ratings.limit(0)) is None
    assert quality.score(docs(spark), None).filter("p_top is null").count() == len(TEXTS)
    d = docs(spark)
    assert quality.keep_good(d, model).columns == d.columns and quality.keep_good(d, None).count() == len(TEXTS)
    assert quality.score(docs(spark, []), model).collect() == []


def test_ordinal_fit_against_the_likelihood():
    """Probabilities follow the definition, and no small step of a weight or threshold betters the penalised likelihood by much."""
    rng = np.random.default_rng(3)
    n, cells = 400, 12
    x = rng.random((n, cells)) < 0.4
    grades = np.clip(np.round(x[:, 0] * 1.2 - x[:, 1] * 1.1 + 1 + rng.normal(size=n) * 0.4), 0, 2).astype(int)
    owner, cell = np.nonzero(x)
    model = quality.Ordinal.fit(owner, cell, grades, 3, epochs=4000, sparse=0.01)
    w, theta = model.weights[:cells].astype(float), model.thresholds

    def loss(w, theta):
        tail = np.concatenate([np.ones((n, 1)), 1 / (1 + np.exp(-((x @ w)[:, None] - theta))), np.zeros((n, 1))], 1)
        above = grades[:, None] > np.arange(2)
        binary = -(above * np.log(tail[:, 1:3]) + ~above * np.log(1 - tail[:, 1:3])).sum(1).mean()
        return binary + 0.01 * np.abs(w).sum()

    here = loss(w, theta)
    for i in range(cells):
        for step in (-0.05, 0.05):
            assert loss(w + step * (np.arange(cells) == i), theta) > here - 1e-4
    for j in range(2):
        for step in (-0.05, 0.05):
            assert loss(w, theta + step * (np.arange(2) == j)) > here - 1e-4
    assert w[0] > 0.5 and w[1] < -0.5
    for i in range(20):
        want = 1 / (1 + np.exp(-(w[x[i]].sum() - theta)))
        assert np.allclose(model.tails(np.flatnonzero(x[i]).tolist()), want)


def test_scores_are_those_of_the_model_on_plain_features(spark):
    ratings = spark.createDataFrame([(i, i % 3) for i in range(90)], "doc_id long, grade int")
    rows = [(i, ("fine words here " if i % 3 == 2 else "BUY NOW !!! " if i % 3 == 1 else "awful nasty text ") * 3 + f"number {i}") for i in range(90)]
    model = quality.fit(docs(spark, rows), ratings)
    got = {r.doc_id: (r.expected_grade, r.p_top) for r in quality.score(docs(spark, rows), model).collect()}
    for i, t in rows:
        tails = 1 / (1 + np.exp(-(sum(float(model.weights[c]) for c in quality.Features()(t)) - model.thresholds)))
        assert np.allclose(got[i], (tails.sum(), tails[-1]), atol=1e-5)


def test_repeated_ids_do_not_change_the_fit(spark):
    ratings = spark.createDataFrame([(i, i % 3) for i in range(60)], "doc_id long, grade int")
    rows = [(i, f"{'good fine' if i % 3 == 2 else 'bad poor' if i % 3 == 1 else 'awful'} text of row {i}") for i in range(60)]
    one = quality.fit(docs(spark, rows), ratings, sample_rows=50)
    many = quality.fit(docs(spark, rows + rows * 5 + [(3, "zzz other text")]), ratings, sample_rows=50)
    assert np.allclose(one.weights, many.weights, atol=1e-5) and np.allclose(one.thresholds, many.thresholds, atol=1e-5)


def test_language_shuffle_joins_give_the_same(spark, monkeypatch):
    rows = docs(spark, [(i, t, k) for i, (t, k) in enumerate([("the cat sat on the mat ", "en"), ("der hund und die katze ", "de")] * 20)], "doc_id long, text string, lang string")
    want = langid.learn(rows, docs_per_lang=5)
    monkeypatch.setattr(langid, "BROADCAST_LANGS", -1)
    got = langid.learn(rows, docs_per_lang=5)
    assert got.langs == want.langs and (got.bits == want.bits).all()


def plain_cells(text):
    """Cells of one text, word by word."""
    raw = (text or "").split()
    counts = {w: raw.count(w) for w in raw}
    total = max(1, len(raw))
    level = lambda share: 0 if share <= 0 else max(1, 10 + int(np.floor(np.log2(share))))
    one = {w: quality.word_features(quality.pa.array([w])) for w in counts}
    cells = {c for w in counts for c in one[w][1].tolist()}
    flagged = [sum(n for w, n in counts.items() if one[w][2][k][0]) for k in ("caps", "marks", "digits")]
    shares = dict(zip(("caps", "marks", "digits"), flagged, strict=True)) | {"again": sum(a == b for a, b in zip(raw, raw[1:], strict=False)), "top": max(counts.values(), default=0), "kinds": len(counts)}
    names = [f"{k} {level(v / total)}" for k, v in shares.items()] + [f"words {int(np.log2(total))}", f"longest {int(np.log2(max(map(len, counts), default=0) + 1))}"]
    return sorted(cells | {quality.Features().level(n) for n in names})


def test_features_of_batches_against_plain_code(monkeypatch):
    import pyarrow as pa

    rng = random.Random(2)
    words = ["Buy", "NOW", "!!!", "running", "runner", "x1", "a", "a", "the", "Ünder", "日本", "(so)", "..."]
    texts = [t for _, t in TEXTS] + [rng.choice([" ", "\n", "  ", "\t "]).join(rng.choice(words) for _ in range(rng.randrange(60))) for _ in range(80)]
    monkeypatch.setattr(quality, "BATCH_BYTES", 500)
    features, got = quality.Features(), {}
    for lo, hi, row, cell in features.batches(pa.array(texts, pa.string())):
        for i in range(lo, hi):
            got[i] = cell[row == i - lo].tolist()
    assert [got[i] for i in range(len(texts))] == [plain_cells(t) for t in texts]
    flags = quality.word_features(pa.array(["NOW", "I", "a1", "!!", "x.", "Ünder"]))[2]
    assert [flags[k].tolist() for k in ("caps", "digits", "marks")] == [[True] + [False] * 5, [False, False, True, False, False, False], [False, False, False, True, False, False]]
    some = set(plain_cells(texts[-1])[:3])
    assert quality.Features(some)(texts[-1]) == sorted(some)
