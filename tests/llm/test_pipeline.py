import glob

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from shelfspark.llm import decontam, minhash, pii, quality, queries

from ..conftest import SMALL
from . import test_decontam, test_minhash, test_pii
from .common import crc


@pytest.fixture
def tables(spark, tmp_path):
    """A folder with small documents, labels and benchmark that have extra columns."""
    for f in glob.glob(f"{SMALL}/*.parquet"):
        name = f.split("/")[-1]
        if name in ("documents.parquet", "labels.parquet", "benchmark.parquet"):
            spark.read.parquet(f).withColumn("spans", F.lit("own")).write.parquet(f"{tmp_path}/{name}")
    return str(tmp_path)


def test_stages_keep_columns_and_take_effect(spark, tables):
    start = docs = spark.read.parquet(f"{tables}/documents.parquet").cache()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, tables).cache()
        assert got.columns == start.columns and 0 < got.count() <= docs.count(), name
        docs = got
    assert minhash.near_duplicates(docs).filter("not kept").count() == 0
    assert decontam.remove_contaminated(docs, spark.read.parquet(f"{tables}/benchmark.parquet")).count() == docs.count()
    assert pii.digest(pii.find_personal_data(docs)).agg(F.sum(F.col("n_email") + F.col("n_ip"))).first()[0] == 0


def test_run(spark, tables):
    pieces = corpus_pipeline.run(spark, tables)
    assert pieces.groupBy("sequence_id").agg(F.sum("length").alias("n")).agg(F.max("n")).first()[0] <= 4096
    assert pieces.count() > 0 and set(queries.queries()) >= {"op1_decontaminate", "op9_pack"}


def test_empty_tables(spark, tables, tmp_path):
    for n in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{tables}/{n}.parquet").limit(0).write.parquet(f"{tmp_path}/empty/{n}.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/empty").count() == 0


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_rows_as_sql(spark, duck, name):
    got = queries.queries()[name](spark, SMALL).toPandas()
    want = duck.execute(queries.oracle_sql()[name]).fetchdf()[list(got.columns)]
    assert sorted(map(tuple, got.itertuples(index=False))) == sorted(map(tuple, want.itertuples(index=False))) and len(got)


def test_whole_pipeline_against_plain_code(spark, tables, tmp_path):
    """Documents of the small tables and awkward rows: each stage by plain code, then the pieces."""
    from collections import defaultdict

    docs = spark.read.parquet(f"{tables}/documents.parquet")
    some = docs.filter("text is not null").orderBy("doc_id").first()
    odd = [(10_000, None), (10_001, ""), (some.doc_id, some.text), (10_002, some.text + " tail"), (None, some.text), (10_003, "call +1 (800) 555-0199 or a@b.cd " + some.text[:300])]
    extra = spark.createDataFrame(odd, "doc_id long, text string")
    whole = docs.unionByName(extra, allowMissingColumns=True)
    for n in ("labels", "benchmark"):
        spark.read.parquet(f"{tables}/{n}.parquet").write.parquet(f"{tmp_path}/odd/{n}.parquet")
    whole.write.parquet(f"{tmp_path}/odd/documents.parquet")
    at = f"{tmp_path}/odd"

    rows = [(r.doc_id, r.text) for r in whole.select("doc_id", "text").collect()]
    ratings = spark.read.parquet(f"{at}/labels.parquet").select("doc_id", quality.grade().alias("grade"))
    model, features = quality.fit(spark.read.parquet(f"{at}/documents.parquet"), ratings), quality.Features()
    p_top = lambda t: 1 / (1 + np.exp(-(sum(float(model.weights[c]) for c in features(t)) - model.thresholds[-1])))
    rows = [(d, t) for d, t in rows if p_top(t) >= quality.KEEP_TAIL]

    texts = list(dict.fromkeys(t for _, t in rows if test_minhash.bag(t)))
    found = test_minhash.brute(list(enumerate(texts)))
    classes = defaultdict(list)
    for n, c in found.items():
        classes[c] += [(d is None, d or 0, texts[n]) for d, t in rows if t == texts[n]]
    heads = {(None if none else d, t) for none, d, t in (min(c) for c in classes.values())}
    rows = [(d, t) for d, t in rows if not test_minhash.bag(t)] + sorted(heads, key=str)

    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{at}/benchmark.parquet").collect()]
    bad = {(r[0], t) for (d, t) in rows for r in test_decontam.brute([(d, t)], items) if r[5]}
    rows = [r for r in rows if r not in bad]

    masked = []
    for d, t in rows:
        for s in sorted((s for s in test_pii.base(t) if s), key=lambda s: -int(s.split(":")[1])):
            kind, a, b = s.split(":")
            t = t[: int(a)] + f"[{kind.upper()}]" + t[int(b) :]
        masked.append((d, t))

    tokenizer = Tokenizer.from_file(queries.TOKENIZER)
    want = defaultdict(list)
    for d, t in masked:
        want[d].append([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2])
    pieces = defaultdict(list)
    for r in corpus_pipeline.run(spark, at).collect():
        pieces[r.doc_id].append(r)
    assert set(pieces) == set(want)
    for d, lists in want.items():
        assert sum(r.length for r in pieces[d]) == sum(map(len, lists))
        if len(lists) == 1:
            for r in pieces[d]:
                assert r.ids_crc32 == crc(lists[0][r.start : r.start + r.length]) and r.doc_tokens == len(lists[0])
