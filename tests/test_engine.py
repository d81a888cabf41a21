"""Behaviour that SQL checks do not reach: requests, edge cases, splits, components, files."""

import gzip
import hashlib
import random
import struct
import uuid
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfspark import registry
from shelfspark.functions import identifiers, ids, prices, taxonomy, text, vectors
from shelfspark.operators import ann, datasets, metrics, retrieval
from shelfspark.operators.components import connected_components
from shelfspark.plans import predicates, request, search
from shelfspark.queries import catalog, flows
from shelfspark.sources import readers, sinks
from shelfspark.streaming import incremental

from .conftest import SMALL


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return row.select(column.alias("x")).first().x


def test_request_checks():
    for bad in ({"currency": "eur"}, {"page": 0}, {"page_size": 501}, {"sort": ("size",)}, {"mode": "ALL"}, {"strange": 1}):
        with pytest.raises(ValueError):
            request.request_from(bad)
    r = request.from_legacy({"searchQuery": "x", "vendorIdsFilter": None, "priceFilter": {"min": 5, "currencyCode": "EUR"}, "selectedArticleSources": {"sourcePriceListIds": ["p"]}})
    assert r.vendors == () and r.price_min == 5 and r.sources.price_lists == ("p",)
    assert request.sort_plan(("price,desc", "name")) == request.SortPlan("price", True)
    with pytest.raises(ValueError):
        request.SearchParameters(num_candidates=10)


def test_absent_filters_do_not_filter():
    assert predicates.article_side(request.SearchRequest()) is None
    assert predicates.blocked_classes(request.SearchRequest(blocked=(request.BlockedClasses("S2CLASS", (), (1,)),))) is None


def test_more_filters_never_add_hits(spark):
    o, a = catalog.offers(spark, SMALL), catalog.articles(spark, SMALL)
    r = request.SearchRequest(sources=request.ArticleSources(("cv0", "cv1", "cv2"), (), ("plO", "plX")))
    n = [search.filtered(o, a, x).count() for x in (r, r.without(max_delivery_time=20), r.without(max_delivery_time=20, features=(("flag", ("A",)),)))]
    assert n[0] > n[1] > n[2] > 0


def test_facet_without_its_own_filter_is_no_smaller(spark):
    o, a = catalog.offers(spark, SMALL), catalog.articles(spark, SMALL)
    r = request.SearchRequest(sources=request.ArticleSources(("cv0", "cv1"), (), ("plO",)), vendors=("v0", "v1"))
    wide, own = search.summaries(o, a, r)["vendors"].count(), search.vendor_facet(search.filtered(o, a, r)).count()
    assert wide >= own and own <= 2


def test_prices_by_hand(spark):
    entry = "array<struct<price:double,currency:string,priority:int,sourcePriceListId:string>>"
    rows = spark.createDataFrame([([(5.0, "EUR", 2, "a"), (4.0, "eur", 2, "b"), (1.0, "CHF", 9, "a")],), ([],), (None,)], f"p {entry}")
    assert [r.x for r in rows.select(prices.resolve_price(F.col("p"), "EUR", ["a", "b"]).alias("x")).collect()] == [5.0, None, None]
    assert [r.x for r in rows.select(prices.passes_price_filter(F.col("p"), "EUR", ["b"], "EUR", 400, 400).alias("x")).collect()] == [True, False, False]
    assert prices.decode_minor_units(1234, "EUR") == Decimal("12.34") and prices.decode_minor_units(7, "JPY") == 7
    with pytest.raises(ValueError):
        prices.decode_minor_units(1, "XXX")


def test_ids_by_hand(spark):
    us = [str(uuid.UUID(int=i)) for i in (0, 61, 62, (1 << 128) - 1)]
    rows = spark.createDataFrame([(u,) for u in [*us, "no uuid", None]], "u string").select("u", ids.friendly_id("u").alias("f"), ids.sort_id("u").alias("s")).collect()
    assert [r.s for r in rows[:3]] == ["0", "z", "10"] and all(len(r.f) == 22 for r in rows[:4]) and rows[4].f is None and rows[5].f is None
    back = spark.createDataFrame([(r.f,) for r in rows[:4]], "f string").select(ids.uuid_of_friendly("f").alias("u")).collect()
    assert [r.u for r in back] == us
    long = "Ø" * 100
    assert one(spark, ids.b64url_no_pad(F.lit(long))) == __import__("base64").urlsafe_b64encode(long.encode()).decode().rstrip("=")


def test_text_by_hand(spark):
    assert one(spark, text.normalize_text(F.lit("  a\x00 b \r\n\n\n\n c "))) == "a b\n\nc"
    assert one(spark, text.clean_html_text(F.lit("<b>x</b>&amp;y<br>z"))) == "x &y z"
    assert one(spark, text.trigram_jaccard(F.lit("ab"), F.lit(""))) == 0.0


def test_gtin_and_slots(spark):
    def digit(body):
        return str(-sum(int(c) * (3 if i % 2 == 0 else 1) for i, c in enumerate(reversed(body))) % 10)

    rng = random.Random(4)
    cases = []
    for n in (8, 12, 13, 14, 10):
        for _ in range(20):
            body = "".join(rng.choice("0123456789") for _ in range(n - 1))
            cases += [(body + digit(body), n != 10), (body + str((int(digit(body)) + 1) % 10), False)]
    rows = spark.createDataFrame(cases, "d string, ok boolean")
    assert rows.filter(identifiers.gtin_ok(F.col("d")) != F.col("ok")).count() == 0
    assert one(spark, identifiers.spec_state(F.lit("M8 x"), [F.lit("bolt")])) == "[SPEC_MISMATCH]"


def test_s2class_never_falls_to_a_lower_version(spark):
    mapping = F.create_map(F.lit("lo/5"), F.array(F.lit(21_000_000)))
    got = one(spark, taxonomy.s2class([("hi", F.array(F.lit(5))), ("lo", F.array(F.lit(5)))], mapping))
    assert got[-1] == taxonomy.DEFAULT_S2CLASS


def test_components_against_union_find(spark):
    rng = random.Random(3)
    for edges in ([(i, i + 1) for i in range(40)], [(rng.randrange(200), rng.randrange(200)) for _ in range(150)], []):
        root = {}

        def find(x):
            while root.setdefault(x, x) != x:
                x = root[x]
            return x

        for a, b in edges:
            if a != b:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
        got = {r.node: r.component for r in connected_components(spark.createDataFrame([*edges, (None, 1), (7, 7)], "src long, dst long")).collect()}
        assert got == {x: find(x) for e in edges if e[0] != e[1] for x in e}


def test_splits_do_not_leak(spark):
    rows = spark.createDataFrame([(q, o) for q, o in [("a", "1"), ("a", "2"), ("b", "2"), ("c", "3"), ("d", "4"), ("", "1"), ("e", "")]], "q string, o string")
    split = datasets.split_by_component(rows, "q", "o", 0.3, 1)
    assert split.count() == 7 and datasets.leaks(split.filter("q <> ''"), "q").count() == 0
    assert datasets.leaks(split.filter("q <> '' and o <> ''"), "o").count() == 0
    assert split.filter("q = '' and split = 'validation'").count() == 0


def test_unknown_label_is_an_error(spark):
    with pytest.raises(Exception, match="unknown label"):
        spark.createDataFrame([("Odd",)], "l string").select(metrics.gain(F.col("l"))).collect()


def test_dense_top_k_against_numpy(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 16))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>").repartition(5)
    q = spark.createDataFrame([(i, x[i].tolist()) for i in range(7)], "qid long, v array<double>")
    got = {(r.qid, r["rank"]): r.id for r in retrieval.dense_top_k(q, rows, 4, "ip").collect()}
    want = np.argsort(-(x[:7] @ x.T), axis=1)[:, :4]
    assert got == {(i, k + 1): want[i, k] for i in range(7) for k in range(4)}


def test_cells_find_all_with_all_probes(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 8)).astype(np.float32)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<float>")
    q = rows.filter("id < 5").withColumnRenamed("id", "qid")
    c = ann.train_cells(rows, 6)
    found = ann.ivf_search(q, ann.assign_cells(rows, c), c, 5, 6)
    assert retrieval.recall_at(found, retrieval.dense_top_k(q, rows, 5, "ip"), 5).filter("recall < 1").count() == 0


def test_index_files(spark, tmp_path):
    rows = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(20)], "id long, v array<float>")
    c = ann.train_cells(rows, 3)
    for n, part in (("a", rows.filter("id < 9")), ("b", rows.filter("id >= 9"))):
        ann.write_index(part, c, f"{tmp_path}/{n}")
    assert ann.merge_indexes(spark, [f"{tmp_path}/a", f"{tmp_path}/b"], f"{tmp_path}/c")["rows"] == 20
    assert "PartitionFilters: [isnotnull(cell" in spark.read.parquet(f"{tmp_path}/c/vectors").filter("cell = 1")._jdf.queryExecution().toString()


def test_mapping_source(spark, tmp_path):
    path = f"{tmp_path}/m.gz"
    with gzip.open(path, "wb") as f:
        f.write(b"MAPP" + struct.pack(">iiii", 1, 2, 3, 4))
    spark.dataSource.register(readers.MappingSource)
    assert [tuple(r) for r in spark.read.format("code_mapping").load(path).collect()] == [(1, 2), (3, 4)]
    assert taxonomy.mapping_frame(spark, path, "v").count() == 2


def test_publish_refuses_orphans(spark, tmp_path):
    spark.createDataFrame([("a",)], "article_hash string").write.parquet(f"{tmp_path}/a")
    spark.createDataFrame([("a",), ("b",)], "article_hash string").write.parquet(f"{tmp_path}/o")
    with pytest.raises(ValueError):
        sinks.publish(spark, f"{tmp_path}/a", f"{tmp_path}/o", f"{tmp_path}/now")


def test_zero_vectors(spark):
    assert one(spark, vectors.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0)))) is None
    assert one(spark, vectors.l2_normalise(F.array(F.lit(0.0)))) == [0.0]
    with pytest.raises(ValueError):
        ann.ProductCodes(np.zeros((4, 5)), 2, 2)


def test_filters_reach_the_scan(spark):
    plan = catalog.offers(spark, SMALL).filter("delivery_time_days_max <= 3").select("id")._jdf.queryExecution().toString()
    assert "l_shipdate" not in plan.split("ReadSchema")[-1]


def test_whole_searches_ask_every_hundredth_id(spark):
    rows = spark.read.parquet(f"{SMALL}/embeddings.parquet").orderBy("vec_id").collect()
    x = np.array([r.embedding for r in rows], np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    got = {(r.qid, r["rank"]): r.id for r in registry.queries()["R01_dense_top_k"](spark, SMALL).collect()}
    asked = [i for i, r in enumerate(rows) if r.vec_id % 100 == 0]
    want = np.argsort(-np.round(x[asked] @ x.T, 9), axis=1, kind="stable")[:, :10]
    assert got == {(rows[i].vec_id, k + 1): rows[want[j, k]].vec_id for j, i in enumerate(asked) for k in range(10)}


def test_no_search_asks_a_fixed_number_of_queries():
    assert not any("vec_id < " in s for s in registry.oracle_sql().values())


def test_recall_is_at_least_nine_tenths(spark):
    for name in ("R16_cells_recall", "R17_product_codes_recall", "R18_graph_recall"):
        r = registry.queries()[name](spark, SMALL).first()
        assert r.queries == 5 and r.recall >= 0.9
    low = spark.createDataFrame([(0, 5, 1)], "qid long, id long, rank int")
    with pytest.raises(ValueError, match="recall"):
        ann.reaching(lambda n: low.withColumn("id", F.lit(9).cast("long")), low, 10, 2, 4)


def test_graph_search_finds_exact_neighbours(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 8)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<float>")
    q = rows.filter("id % 60 = 0").withColumnRenamed("id", "qid")
    graph = ann.build_graph(rows, 8, 6, 3)
    assert graph.edges.groupBy("id").count().agg(F.max("count")).first()[0] <= 16
    found = ann.graph_search(q, graph, rows, 5, 60)
    assert retrieval.recall_at(found, retrieval.dense_top_k(q, rows, 5, "ip"), 5).agg(F.avg("recall")).first()[0] >= 0.9


def test_graph_of_shards_reaches_every_row(spark, monkeypatch):
    monkeypatch.setattr(ann, "SHARD_ROWS", 60)
    monkeypatch.setattr(ann, "GRAPH_QUERIES", 3)
    rng = np.random.default_rng(5)
    x = np.repeat(np.eye(8), 25, 0) + rng.normal(scale=1e-3, size=(200, 8))  # groups far apart, and copies
    x[::25], x[1::25] = np.eye(8), np.eye(8)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(200, None)], "id long, v array<float>")
    q = rows.filter("id % 20 = 0 and v is not null").withColumnRenamed("id", "qid")
    graph = ann.build_graph(rows, 2, 2, 1)
    assert graph.shards.count() == 4 and graph.edges.groupBy("id").count().agg(F.max("count")).first()[0] <= 4
    found = ann.graph_search(q, graph, rows, 5, 200).select("qid", "id", "rank")
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, retrieval.dense_top_k(q, rows, 5, "ip", ann.DIGITS).select("qid", "id", "rank").collect()))
    assert ann.build_graph(rows.limit(0)).shards.isEmpty()


def test_quantised_pairs_are_the_scores_of_each_pair(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "CORPUS_BLOCK", 7)
    monkeypatch.setattr(retrieval, "PAIR_QUERIES", 2)
    x = np.random.default_rng(4).integers(-2, 3, (30, 8)).astype(np.float32)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<float>")
    q = rows.filter("id % 6 = 0").withColumnRenamed("id", "qid")
    pairs = q.withColumnRenamed("v", "a").crossJoin(rows.withColumnRenamed("v", "b"))
    want = pairs.select("qid", "id", *(retrieval.quantised_scores(pairs, p).alias(p) for p in ("float32", "sign", "binary"))).collect()
    assert sorted(map(tuple, retrieval.quantised_pairs(q, rows).collect())) == sorted(map(tuple, want)) and len(want) == 150


def test_dense_top_k_of_blocks_ties_and_no_queries(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 2)
    monkeypatch.setattr(retrieval, "CORPUS_BLOCK", 7)
    monkeypatch.setattr(retrieval, "HELD_HITS", 10)
    monkeypatch.setattr(retrieval, "BROADCAST_ROWS", -1)
    rng = np.random.default_rng(4)
    x = np.round(rng.normal(size=(50, 3)))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(90, None)], "id long, v array<double>").repartition(3)
    q = spark.createDataFrame([(i, x[i].tolist()) for i in range(5)] + [(9, None)], "qid long, v array<double>")
    got = {(r.qid, r["rank"]): r.id for r in retrieval.dense_top_k(q, rows, 6, "ip").collect()}
    want = [sorted(range(50), key=lambda j: (-(x[i] @ x[j]), j))[:6] for i in range(5)]
    assert got == {(i, k + 1): want[i][k] for i in range(5) for k in range(6)}
    assert retrieval.dense_top_k(q.limit(0), rows, 4).collect() == [] and retrieval.dense_top_k(q, rows.limit(0), 4).collect() == []


def test_article_search_fetches_until_it_has_enough(spark):
    rows = spark.createDataFrame([(i, [1.0 - i / 1000], 0 if i < 90 else i) for i in range(100)], "id long, v array<double>, article long")
    q = spark.createDataFrame([(1, [1.0])], "qid long, v array<double>")
    got = retrieval.article_search(q, rows, 4, "ip").orderBy("rank").collect()
    assert [r.id for r in got] == [0, 90, 91, 92]


def test_synthetic_negatives_reach_all_offers(spark):
    q, o = spark.range(400).withColumnRenamed("id", "qid"), spark.range(300)
    known = q.withColumn("id", F.col("qid") % 300)
    got = datasets.synthetic_negatives(q, o, known, 5, 3)
    assert got.count() == 2000 and got.join(known, ["qid", "id"]).count() == 0 and got.select("id").distinct().count() > 290
    few = datasets.synthetic_negatives(q.limit(3), spark.range(4), known, 5, 3)
    assert few.groupBy("qid").count().filter("count < 3").count() == 0


def test_given_split_names(spark):
    rows = spark.createDataFrame([(1, " Train"), (2, None), (3, "")], "id long, split string")
    assert [tuple(r) for r in datasets.given_split(rows, "split").collect()] == [(1, "train")]
    with pytest.raises(Exception, match="unknown split"):
        datasets.given_split(rows.withColumn("split", F.lit("other")), "split").collect()


def test_file_selection():
    files = [("b", 5), ("a", 9), ("c", 9), ("d", 1), ("e", 6)]
    assert [f for f, _ in readers.select_files(files, 2)] == ["a", "b"]
    assert [f for f, _ in readers.select_files(files, 3, largest=True)] == ["a", "c", "e"]
    shards = readers.balanced_shards(files, 2)
    size = dict(files)
    assert sorted(x for s in shards for x in s) == ["a", "b", "c", "d", "e"] and abs(sum(map(size.get, shards[0])) - sum(map(size.get, shards[1]))) <= 4


def test_listed_files_and_metadata(spark, tmp_path):
    rows = sinks.with_metadata(spark.range(10), {"id": {"unit": "piece"}})
    rows.coalesce(1).write.parquet(f"{tmp_path}/m")
    assert spark.read.parquet(f"{tmp_path}/m").schema["id"].metadata == {"unit": "piece"}
    assert [b > 0 for _, b in readers.list_files(spark, f"{tmp_path}/m/*.parquet")] == [True]


def test_manifest_sees_lost_files(spark, tmp_path):
    sinks.write_with_manifest(spark.range(10).repartition(2), str(tmp_path / "x"))
    for f in (tmp_path / "x" / "data").glob("part-00000*"):
        f.unlink()
    with pytest.raises(ValueError, match="manifest"):
        sinks.read_with_manifest(spark, str(tmp_path / "x"))


def test_upload_goes_on_behind_the_prefix(spark, tmp_path):
    polls = {}

    def poll(job):
        polls[job] = polls.get(job, 0) + 1
        return "failed" if job == "c" and polls[job] == 1 else "done" if polls[job] > (2 if job == "a" else 0) else "running"

    with pytest.raises(RuntimeError):
        sinks.upload(spark, list("abcd"), f"{tmp_path}/s", lambda f: f, poll, 3)
    assert sinks.upload(spark, list("abcd"), f"{tmp_path}/s", lambda f: f, poll, 3)[-1] == "d"
    assert sinks.upload(spark, list("abcd"), f"{tmp_path}/s", lambda f: f, poll) == []


def test_upload_looks_for_its_last_state_once(spark, tmp_path, monkeypatch):
    looks, latest = [], sinks.latest_version
    monkeypatch.setattr(sinks, "latest_version", lambda *a: looks.append(a) or latest(*a))
    files = [str(i) for i in range(20)]
    assert sinks.upload(spark, files, f"{tmp_path}/s", lambda f: f, lambda job: "done", 1) == files
    assert len(looks) == 1 and latest(spark, f"{tmp_path}/s") == (19, '{"done": 20}')
    with pytest.raises(RuntimeError, match="another process"):
        sinks.put_version(spark, f"{tmp_path}/s", "x", 4)
    assert sinks.put_version(spark, f"{tmp_path}/s", "x") == 20


def test_store_settings_and_values(spark):
    class Builder(dict):
        def config(self, k, v):
            self[k] = v
            return self

    assert readers.with_s3(Builder(), "me")["spark.hadoop.fs.s3a.auth.profile"] == "me"
    with pytest.raises(Exception, match="no vector"):
        readers.key_values(spark, spark.range(3), "id", lambda keys: [b"abc"] * len(keys), 2).collect()


def test_tables_go_on_after_a_restart(spark, tmp_path):
    from shelfspark.streaming import incremental

    make = lambda: incremental.Tables(spark, str(tmp_path / "t"), lambda o: o.groupBy("article_hash").agg(F.count("*").alias("n")), 4, max_keys=3, max_age=1e9)
    kind = "id long, article_hash long, version long, deleted boolean"
    t = make()
    with pytest.raises(ValueError):
        t.read("offers")
    t.start(spark.createDataFrame([(i, i % 3, 1) for i in range(9)], "id long, article_hash long, version long"))
    t.upsert(spark.createDataFrame([(0, 7, 2, False)], kind), 0)
    assert t.pending()["keys"] == 1 and t.read("articles").filter("article_hash = 7").count() == 0
    t = make()
    t.upsert(spark.createDataFrame([(0, 7, 2, False)], kind), 0)
    t.upsert(spark.createDataFrame([(1, 1, 2, True), (2, 2, 0, True), (3, 8, 5, False)], kind), 1)
    assert {(r.article_hash, r.n) for r in t.read("articles").collect()} == {(7, 1), (8, 1), (0, 1), (1, 2), (2, 3)}
    t.upsert(spark.createDataFrame([(1, 5, 1, False), (3, 0, 4, False)], kind), 2)  # both are older than what was applied
    t.flush()
    assert t.read("offers").filter("id = 1").count() == 0 and t.read("offers").filter("id = 3").first().article_hash == 8
    t.upsert(spark.createDataFrame([(9, 9, 9, False)], kind), 1)  # replayed
    assert t.pending()["batches"] == 0 and t.read("offers").count() == 8


def test_legacy_response(spark):
    o, a = catalog.offers(spark, SMALL), catalog.articles(spark, SMALL)
    r = request.SearchRequest(sources=request.ArticleSources(("cv0", "cv1"), (), ("plO",)), mode="BOTH", query="x", sort=("name,asc",))
    out = search.legacy_response(search.search(o, a, r, sets=[("one", (1_000_000,))]), r, explain=True)
    assert out["articles"].columns == ["articleId", "explanation"] and out["eClassesAggregations"].columns == ["id", "count"]
    assert set(out) == {"articles", "metadata", *search.LEGACY_SUMMARIES.values()}
    none = search.legacy_response(search.search(o, a, r.without(sources=request.ArticleSources())), r)["metadata"].first()
    assert none.pageCount == 1 and none.hitCount == 0 and none.term == "x"


def test_legacy_ids_of_raw_and_encoded_numbers(spark):
    u = str(uuid.UUID(int=62))
    rows = spark.createDataFrame([(f"{u}:{n}:{u}",) for n in ("ab-1", "YWItMQ", "123", "a b", "Ø")] + [("x:y:z",), (f"{u}:a",), (None,)], "i string")
    got = [r.x for r in rows.select(ids.legacy_offer_id(F.col("i")).alias("x")).collect()]
    head = "0" * 20 + "10"
    assert got == [f"{head}:YWItMQ", f"{head}:YWItMQ", f"{head}:MTIz", f"{head}:YSBi", f"{head}:w5g", "x:y:z", f"{u}:a", None]


def test_command_line(spark, tmp_path, capsys):
    from shelfspark import cli

    rows = spark.read.parquet(f"{SMALL}/embeddings.parquet")
    rows.write.parquet(f"{tmp_path}/v")
    rows.filter("vec_id % 100 = 0").write.parquet(f"{tmp_path}/q")
    spark.createDataFrame([(0, 0)], "qid long, id long").write.parquet(f"{tmp_path}/p")
    own = ["--key", "vec_id", "--vector", "embedding"]
    cli.main(["list"])
    cli.main(["sql", "S03_parquet_scan"])
    cli.main(["run", "S03_parquet_scan", SMALL])
    cli.main(["explain", "S03_parquet_scan", SMALL])
    cli.main(["bench", SMALL, "S03_parquet_scan"])
    cli.main(["index-build", f"{tmp_path}/v", f"{tmp_path}/i", "--cells", "4", *own])
    cli.main(["index-search", f"{tmp_path}/q", f"{tmp_path}/i", f"{tmp_path}/hits", "--k", "3", *own])
    cli.main(["mine-negatives", f"{tmp_path}/q", f"{tmp_path}/v", f"{tmp_path}/p", f"{tmp_path}/mined", "--cap", "2", *own])
    assert spark.read.parquet(f"{tmp_path}/hits").count() == 15 and spark.read.parquet(f"{tmp_path}/mined").count() == 10
    assert "R02_bm25" in capsys.readouterr().out
    with pytest.raises(SystemExit):
        cli.main(["run", "nothing", SMALL])


def test_salted_join_gives_the_same(spark):
    from shelfspark.operators import skew

    a = spark.createDataFrame([(1 if i % 3 else None if i % 2 else i, i) for i in range(200)], "k long, i long")
    b = spark.createDataFrame([(k, f"v{k}") for k in (1, 1, 6, 12)], "k long, v string")
    for how in ("inner", "left"):
        want = sorted(map(str, a.join(b, "k", how).collect()))
        assert sorted(map(str, skew.salted_join(a, b, ["k"], "i", how, room=10).select("k", "i", "v").collect())) == want


def test_every_lineitem_is_split_by_its_component(spark, tmp_path):
    """Against union-find: seven chains, orders and parts with the same numbers, one component of most rows."""
    rng = random.Random(5)
    rows = [(100 * c + rng.randrange(12), n, 100 * c + rng.randrange(8)) for c in range(7) for n in range(10)]
    rows += [(2000 + rng.randrange(60), n, 2000 + rng.randrange(9)) for n in range(200)] + [(1, 900, 3000), (3000, 901, 1)]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_partkey long").repartition(3).write.parquet(f"{tmp_path}/lineitem.parquet")
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for o, _, p in rows:
        x, y = find(f"q:{o}"), find(f"o:{p}")
        root[max(x, y)] = min(x, y)
    members = {}
    for o, _, _ in rows:
        members.setdefault(find(f"q:{o}"), set()).add(o)
    target, held, chosen = max(1, int(0.2 * len({o for o, _, _ in rows}))), 0, set()
    for c in sorted(members, key=lambda c: (hashlib.md5(f"{c}#3".encode()).hexdigest(), c)):
        if held < target:
            chosen.add(c)
            held += len(members[c])
    got = registry.queries()["D03_split_lineitem"](spark, str(tmp_path)).collect()
    want = sorted((o, n, p, "validation" if find(f"q:{o}") in chosen else "train") for o, n, p in rows)
    assert sorted(tuple(r) for r in got) == want and {w[3] for w in want} == {"train", "validation"}


def test_leg_ranks_score_the_whole_corpus(spark):
    got = registry.queries()["W09_leg_ranks"](spark, SMALL)
    assert got.filter("id >= 50").count() > 0 and got.groupBy("qid").count().filter("count <> 50").count() == 0


def test_wrapped_scan_reads_all_offers_from_several_files(spark, monkeypatch):
    monkeypatch.setattr(flows, "WRAPPED_RECORDS", 400)
    at = []
    monkeypatch.setattr(flows, "folder", lambda s, f=flows.folder: at.append(f(s)) or at[-1])
    got = registry.queries()["S02_wrapped_scan"](spark, SMALL).agg(F.sum("offers")).first()[0]
    li = spark.read.parquet(f"{SMALL}/lineitem.parquet")
    n = [r.n for r in spark.read.option("multiLine", True).json(at[0]).select(F.size("records").alias("n")).collect()]
    assert got == li.filter("l_linenumber = 1").count() == sum(n) and len(n) > 1 and max(n) <= 400


def test_drained_streams_leave_their_rows_in_files(spark, tmp_path):
    kind, at = "user_id long, ts timestamp_ntz, event_type string, value double", str(tmp_path / "in")
    spark.createDataFrame([], kind).write.parquet(at)
    stream = incremental.event_stream(spark, at, kind)
    kept = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    assert incremental.drain(stream.select("user_id"), f"d{uuid.uuid4().hex}", "append").count() == 0
    for k in range(3):
        spark.range(2).selectExpr("id as user_id", f"timestamp_ntz'2024-01-0{k + 1}' as ts", "'a' as event_type", "1D as value").coalesce(1).write.mode("append").parquet(at)
    out = incremental.drain(stream.groupBy("user_id").agg(F.count("*").alias("n")), f"d{uuid.uuid4().hex}")
    assert out.inputFiles() and sorted(map(tuple, out.collect())) == [(0, 3), (1, 3)]
    each = incremental.drain(stream.select("user_id"), f"d{uuid.uuid4().hex}", "append")
    assert each.inputFiles() and each.count() == 6
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == kept


def test_sessions_end_at_the_gap_and_late_events_stay(spark, tmp_path):
    kind, at = "user_id long, ts timestamp_ntz", str(tmp_path)
    files = [["(1, '2024-01-20 05:00:00'), (1, '2024-01-20 07:00:00'), (2, '2024-01-20 05:00:00'), (2, '2024-01-20 06:59:59.999999')"], ["(1, '2024-01-01 05:00:00')"], ["(3, '2024-01-02 01:00:00')"]]
    for (v,) in files:
        spark.sql(f"select cast(col1 as long) as user_id, cast(col2 as timestamp_ntz) as ts from values {v}").coalesce(1).write.mode("append").parquet(at)
    out = incremental.drain(incremental.sessions(incremental.event_stream(spark, at, kind), "2 hours", late=None), f"d{uuid.uuid4().hex}")
    assert sorted((r.user_id, r.start.day, r.start.hour, r.n) for r in out.collect()) == [(1, 1, 5, 1), (1, 20, 5, 1), (1, 20, 7, 1), (2, 20, 5, 2), (3, 2, 1, 1)]
