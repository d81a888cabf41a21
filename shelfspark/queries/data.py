"""Queries of retrieval, metrics, aggregations, windows, datasets, joins and set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import identifiers, text, vectors
from ..operators import ann, datasets, metrics, retrieval
from ..session import cut, table
from . import query

# retrieval over embeddings: queries are the ids divisible by 100, relevant rows share the label
VEC = "with e as (select vec_id, label, list_transform(embedding, lambda x: cast(x as double)) as v from embeddings), qs as (select * from e where vec_id % 100 = 0)"
SCORES = VEC + ", s as (select q.vec_id as qid, e.vec_id as id, round(list_cosine_similarity(q.v, e.v), 9) as score, q.label = e.label as relevant from qs q cross join e)"
RANKED = SCORES + ", r as (select *, row_number() over (partition by qid order by score desc, id) as rank from s)"


def corpus(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), "label")


def asked(spark, sf_dir):
    """The query set: every id divisible by 100."""
    return corpus(spark, sf_dir).filter(F.col("id") % 100 == 0).select(F.col("id").alias("qid"), "v", F.col("label").alias("qlabel"))


def dense(spark, sf_dir, k: int):
    return retrieval.dense_top_k(asked(spark, sf_dir), corpus(spark, sf_dir), k, digits=9)


def judged_hits(spark, sf_dir, k: int):
    hits = dense(spark, sf_dir, k).join(asked(spark, sf_dir).select("qid", "qlabel"), "qid").join(corpus(spark, sf_dir).select("id", "label"), "id")
    return hits.select("qid", "id", "score", "rank", (F.col("label") == F.col("qlabel")).alias("relevant"))


@query("R01_dense_top_k", f"{RANKED} select qid, id, round(score, 6) as score, cast(rank as integer) as rank from r where rank <= 10")
def dense_top_k(spark, sf_dir):
    return dense(spark, sf_dir, 10).select("qid", "id", F.round("score", 6).alias("score"), "rank")


@query("R15_inner_product", f"{VEC}, s as (select q.vec_id as qid, e.vec_id as id, round(list_inner_product(q.v, e.v), 9) as score from qs q cross join e) select qid, id, cast(rank as integer) as rank from (select *, row_number() over (partition by qid order by score desc, id) as rank from s) where rank <= 5")
def inner_product(spark, sf_dir):
    return retrieval.dense_top_k(asked(spark, sf_dir), corpus(spark, sf_dir), 5, "ip", digits=9).select("qid", "id", "rank")


@query("J20_all_pairs_scores", f"{VEC} select q.vec_id as qid, e.vec_id as id, round(list_cosine_similarity(q.v, e.v), 6) as score from qs q cross join e")
def all_pairs(spark, sf_dir):
    q = asked(spark, sf_dir).select("qid", F.col("v").alias("qv"))
    return corpus(spark, sf_dir).crossJoin(retrieval.sized(q)).select("qid", "id", F.round(vectors.cosine(F.col("qv"), F.col("v")), 6).alias("score"))


@query("R23_filtered_exact", f"{SCORES} select qid, id, cast(rank as integer) as rank from (select *, row_number() over (partition by qid order by score desc, id) as rank from s where id % 3 = 0) where rank <= 5")
def filtered_exact(spark, sf_dir):
    return retrieval.dense_top_k(asked(spark, sf_dir), corpus(spark, sf_dir).filter("id % 3 = 0"), 5, digits=9).select("qid", "id", "rank")


def articled(spark, sf_dir):
    return corpus(spark, sf_dir).withColumn("article", F.floor(F.col("id") / 4))


@query("R24_article_top_k", f"{SCORES}, b as (select qid, id // 4 as id, max(score) as score from s group by 1, 2) select qid, id, cast(rank as integer) as rank from (select *, row_number() over (partition by qid order by score desc, id) as rank from b) where rank <= 5")
def article_top(spark, sf_dir):
    return retrieval.article_search(asked(spark, sf_dir), articled(spark, sf_dir), 5, digits=9).select("qid", "id", "rank")


def text_legs(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    bench = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), "text")
    return retrieval.bm25(bench, docs).withColumn("score", F.round("score", 6))


BM25 = """with t as (select doc_id, list_filter(string_split_regex(lower(text), '\\s+'), lambda w: length(w) between 4 and 40) as w from documents),
st as (select count(*) as n, avg(len(w)) as avgdl from t), p as (select doc_id, len(w) as dl, unnest(w) as term from t), tf as (select doc_id, dl, term, count(*) as tf from p group by all),
df as (select term, count(*) as df from tf group by 1), q as (select distinct item_id, term from (select item_id, unnest(string_split_regex(lower(text), '\\s+')) as term from benchmark) where length(term) between 4 and 40),
b as (select item_id as qid, doc_id as id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / avgdl))), 6) as score from q join tf using (term) join df using (term) cross join st group by 1, 2),
br as (select *, row_number() over (partition by qid order by score desc, id) as rank from b)"""


@query("R02_bm25", f"{BM25} select qid, id, round(score, 4) as score from br where rank <= 10")
def bm25(spark, sf_dir):
    return retrieval.top_k(text_legs(spark, sf_dir), 10, ["qid"]).select("qid", "id", F.round("score", 4).alias("score"))


@query("R03_rrf", f"""{RANKED}, p as (select q.vec_id as qid, e.vec_id as id, round(list_inner_product(q.v, e.v), 9) as score from qs q cross join e),
x as (select qid, id, rank from r where rank <= 20 union all select * from (select qid, id, row_number() over (partition by qid order by score desc, id) as rank from p) where rank <= 20),
f as (select qid, id, round(sum(1.0 / (60 + rank)), 12) as score from x group by 1, 2) select qid, id, round(score, 9) as score, cast(rank as integer) as rank from (select *, row_number() over (partition by qid order by score desc, id) as rank from f) where rank <= 10""")
def rrf(spark, sf_dir):
    other = retrieval.dense_top_k(asked(spark, sf_dir), corpus(spark, sf_dir), 20, "ip", digits=9)
    return retrieval.rrf([dense(spark, sf_dir, 20), other], 60, 10).select("qid", "id", F.round("score", 9).alias("score"), "rank")


ROUTE = "select p_partkey as qid, case p_partkey % 4 when 0 then p_name when 1 then 'tze-' || (p_partkey + 100) when 2 then 'rj45' else 'ring' end as text from part"


def routed(spark, sf_dir):
    k = F.col("p_partkey") % 4
    q = F.when(k == 0, F.col("p_name")).when(k == 1, F.concat(F.lit("tze-"), (F.col("p_partkey") + 100).cast("string"))).when(k == 2, "rj45").otherwise("ring")
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("qid"), q.alias("text"))


@query("R05_route_modes", f"with q as ({ROUTE}) select qid, case when contains(text, ' ') then 'vector' when starts_with(text, 'tze') then 'strict' else 'hybrid' end as path from q")
def route(spark, sf_dir):
    return retrieval.route(routed(spark, sf_dir)).select("qid", "path")


@query("R06_route_with_identifier", f"with q as ({ROUTE}) select qid, case when starts_with(text, 'tze') then 'strict' when contains(text, ' ') then 'vector' else 'hybrid' end as path from q")
def route_variant(spark, sf_dir):
    return retrieval.route(routed(spark, sf_dir), True).select("qid", "path")


@query("R05_search_modes", f"""{RANKED}, k as (select distinct qid, qid // 100 % 4 as kind from r),
c as (select k.qid, e.vec_id as id, 1 as rank from k join e on e.vec_id = k.qid where kind = 0
  union all select * from (select k.qid, e.vec_id, row_number() over (partition by k.qid order by e.vec_id) as rank from k cross join e where kind = 3 and e.vec_id % 50 = 7) where rank <= 30),
x as (select qid, id, rank from r where rank <= 30 union all select * from c), f as (select qid, id, round(sum(1.0 / (60 + rank)), 12) as score from x group by 1, 2), fr as (select *, row_number() over (partition by qid order by score desc, id) as rank from f)
select qid, 'strict' as path, id, cast(rank as integer) as rank from c join k using (qid) where kind = 0 union all select qid, 'fallback', id, rank from fr join k using (qid) where kind = 1 and rank <= 10
union all select qid, 'vector', id, rank from r join k using (qid) where kind = 2 and rank <= 10 union all select qid, 'hybrid', id, rank from fr join k using (qid) where kind = 3 and rank <= 10""")
def search_modes(spark, sf_dir):
    """Hybrid search as a whole: identifiers go to the code leg, or to fusion without hits there; several words to vectors; others to fusion."""
    kind = F.floor(F.col("qid") / 100) % 4
    words = F.when(kind == 0, F.concat(F.lit("tze-"), (F.col("qid") + 1000).cast("string"))).when(kind == 1, "tze-99999999").when(kind == 2, "red ring").otherwise("ring")
    codes = F.concat(F.lit("tze-"), (F.col("id") + 1000).cast("string"), F.when(F.col("id") % 50 == 7, " ring").otherwise(" part"))
    return retrieval.hybrid(asked(spark, sf_dir).withColumn("text", words), corpus(spark, sf_dir).withColumn("text", codes), 10, 30, digits=9).select("qid", "path", "id", "rank")


@query("J08_within_filter", f"{RANKED} select qid, id from r where rank <= 50 and id in (select vec_id from embeddings where label < 3)")
def within(spark, sf_dir):
    return retrieval.within(dense(spark, sf_dir, 50), corpus(spark, sf_dir).filter("label < 3")).select("qid", "id")


@query("R09_bounded_pool", f"{RANKED}, c as (select *, max(score) over (partition by qid) as top from r where rank <= 40) select qid, id from c where score >= 0.3 * top")
def bounded_pool(spark, sf_dir):
    return retrieval.bound_pool(dense(spark, sf_dir, 60), 40, 0.3, ["qid"]).select("qid", "id")


@query("R22_quantised_scores", f"""{VEC} select q.vec_id as qid, e.vec_id as id, round(list_inner_product(q.v, e.v), 6) as f32, list_sum(list_transform(list_zip(q.v, e.v), lambda p: case when p[1] >= 0 then 1 else -1 end * case when p[2] >= 0 then 1 else -1 end)) / 64.0 as sg,
 1.0 - 2.0 * len(list_filter(list_zip(q.v, e.v), lambda p: (p[1] > 0) <> (p[2] > 0))) / 64.0 as bn from qs q cross join e""")
def quantised(spark, sf_dir):
    pairs = retrieval.quantised_pairs(asked(spark, sf_dir).select("qid", "v"), corpus(spark, sf_dir).select("id", "v"))
    return pairs.select("qid", "id", F.round("float32", 6).alias("f32"), F.col("sign").alias("sg"), F.col("binary").alias("bn"))


@query("R22_int8_codes", "select vec_id, cast(list_sum(list_transform(embedding, lambda x: cast(round_even(cast(x as double) * 127, 0) as integer))) as bigint) as s from embeddings")
def int8(spark, sf_dir):
    codes = vectors.quantise_int8(F.col("embedding"))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.aggregate(codes, F.lit(0).cast("long"), lambda a, x: a + x).alias("s"))


@query("R25_recall", f"{RANKED}, f as (select qid, count(*) filter (where id % 2 = 0) as n from r where rank <= 10 group by 1) select qid, n / 10.0 as recall from f")
def recall(spark, sf_dir):
    truth = dense(spark, sf_dir, 10)
    return retrieval.recall_at(truth.filter("id % 2 = 0"), truth, 10)


@query("R26_rerank", f"{RANKED} select qid, id from r where score >= 0.5 and rank <= 5")
def rerank(spark, sf_dir):
    return retrieval.rerank(dense(spark, sf_dir, 50).drop("rank"), 0.5, 5, ["qid"]).select("qid", "id")


@query("R27_calibrated_softmax", "select vec_id, round(exp(embedding[1] / 2.0) / (exp(embedding[1] / 2.0) + exp(embedding[2] / 2.0)), 6) as p, round(cast(embedding[1] as double) * 0.25 + cast(embedding[2] as double) * 0.75, 6) as b from embeddings")
def softmax(spark, sf_dir):
    d = F.transform(F.slice("embedding", 1, 2), lambda x: x.cast("double"))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(F.get(retrieval.calibrated_softmax(d, 2.0), F.lit(0)), 6).alias("p"), F.round(F.get(retrieval.blend(F.slice(d, 1, 1), F.slice(d, 2, 1), 0.25), F.lit(0)), 6).alias("b"))


@query("R28_candidate_union", f"{RANKED}, u as (select qid, id, cast(rank as integer) as rank, 'a' as leg from r where rank <= 5 union all select qid, id, cast(rank as integer), 'b' from r where rank between 3 and 8) select qid, id, max(rank) filter (where leg = 'a') as rank_a, max(rank) filter (where leg = 'b') as rank_b, string_agg(leg, ',' order by leg) as legs from u group by 1, 2")
def union_legs(spark, sf_dir):
    hits = dense(spark, sf_dir, 8)
    return retrieval.candidate_union({"a": hits.filter("rank <= 5"), "b": hits.filter("rank >= 3")}).select("qid", "id", "rank_a", "rank_b", F.array_join("source_legs", ",").alias("legs"))


EXACT = f"{VEC}, s as (select q.vec_id as qid, e.vec_id as id, round(list_inner_product(q.v, e.v), 9) as score from qs q cross join e) select qid, id, cast(rank as integer) as rank from (select *, row_number() over (partition by qid order by score desc, id) as rank from s) where rank <= 10"


def measured(width, recall):
    return recall.agg(F.round(F.avg("recall"), 6).alias("recall"), F.count("*").alias("queries")).withColumn("width", F.lit(width))


def _cells(spark, sf_dir):
    rows, q = corpus(spark, sf_dir).select("id", "v"), asked(spark, sf_dir).select("qid", "v")
    centroids = ann.train_cells(rows, 16)
    index, truth = cut(ann.assign_cells(rows, centroids)), cut(retrieval.dense_top_k(q, rows, 10, "ip"))
    return (lambda n: ann.ivf_search(q, index, centroids, 10, n)), truth, 16


def _codes(spark, sf_dir):
    rows, q = corpus(spark, sf_dir).select("id", "v"), asked(spark, sf_dir).select("qid", "v")
    codes = ann.ProductCodes(ann.training_sample(rows), 8, 6)
    coded, truth = cut(ann.encode_codes(rows, codes)), cut(retrieval.dense_top_k(q, rows, 10, "ip"))
    return (lambda n: ann.pq_search(q, coded, codes, 10, rows, n)), truth, max(5, -(-rows.count() // 10))


def _graph(spark, sf_dir):
    rows, q = corpus(spark, sf_dir).select("id", "v"), asked(spark, sf_dir).select("qid", "v")
    graph, truth = ann.build_graph(rows, 16), cut(retrieval.dense_top_k(q, rows, 10, "ip", ann.DIGITS))
    return (lambda n: ann.graph_search(q, graph, rows, 10, n)), truth, rows.count()


def _index(name: str, made, first: int) -> None:
    """Two queries of an index: its hits at the width where they are all exact, and the width and recall where the mean recall is 0.9."""

    @query(name, EXACT)
    def exact(spark, sf_dir):
        search, truth, most = made(spark, sf_dir)
        return search(ann.reaching(search, truth, 10, first, most, 1.0)[0]).select("qid", "id", "rank")

    @query(f"{name}_recall")
    def recall(spark, sf_dir):
        search, truth, most = made(spark, sf_dir)
        return measured(*ann.reaching(search, truth, 10, first, most))


_index("R16_cells", _cells, 6)
_index("R17_product_codes", _codes, 5)
_index("R18_graph", _graph, 16)


@query("J19_match_metadata", f"{RANKED} select r.qid, r.id, e.label as match_label from r join embeddings e on e.vec_id = r.id where rank <= 3")
def metadata(spark, sf_dir):
    hits = dense(spark, sf_dir, 3)
    return ann.with_match(hits, corpus(spark, sf_dir)).select("qid", "id", "match_label")


# metrics

GAIN = "case when relevant then 1.0 when id % 5 = 0 then 0.1 when id % 5 = 1 then 0.01 else 0.0 end"


def graded(spark, sf_dir):
    label = F.when(F.col("relevant"), "Exact").when(F.col("id") % 5 == 0, "Substitute").when(F.col("id") % 5 == 1, "Complement").otherwise("Irrelevant")
    return judged_hits(spark, sf_dir, 30).withColumn("label", label).withColumn("gain", metrics.gain(F.col("label")))


@query("M01_ndcg", f"""{RANKED}, g as (select *, {GAIN} as gain, row_number() over (partition by qid order by {GAIN} desc, id) as ideal from r where rank <= 30)
select qid, round(sum(case when rank <= 10 then gain / log2(rank + 1) else 0 end) / sum(case when ideal <= 10 then gain / log2(ideal + 1) else 0 end), 6) as ndcg from g group by 1 having max(gain) > 0""")
def ndcg(spark, sf_dir):
    return metrics.ndcg(graded(spark, sf_dir), 10).select("qid", F.round("ndcg", 6).alias("ndcg"))


FIRST = f"{RANKED}, f as (select vec_id as qid, min(rank) as rank from qs left join (select qid, rank from r where rank <= 20 and relevant and id <> qid) x on x.qid = vec_id group by 1)"


@query("M02_mrr_success", f"{FIRST} select round(avg(coalesce(1.0 / rank, 0)), 6) as mrr, round(avg(case when rank <= 3 then 1.0 else 0 end), 6) as success from f")
def mrr(spark, sf_dir):
    rows = judged_hits(spark, sf_dir, 20).filter("id <> qid")
    out = metrics.mrr_and_success(rows, asked(spark, sf_dir), 3)
    return out.select(F.round("mrr", 6).alias("mrr"), F.round("success", 6).alias("success"))


@query("W11_first_relevant", f"{RANKED} select qid, cast(min(rank) filter (where relevant and id <> qid) as integer) as rank from r where rank <= 20 and id <> qid group by 1")
def first_relevant(spark, sf_dir):
    return metrics.first_relevant(judged_hits(spark, sf_dir, 20).filter("id <> qid"))


@query("M03_precision", f"{RANKED} select qid, count(*) filter (where relevant and rank <= 5) / 5.0 as precision from r where rank <= 20 group by 1")
def precision(spark, sf_dir):
    return metrics.precision_at(judged_hits(spark, sf_dir, 20), 5)


@query("M04_catalog_benchmark", f"{FIRST} select round(avg(case when rank <= 10 then 1.0 else 0 end), 6) as hit_rate from f")
def catalog_benchmark(spark, sf_dir):
    rows = judged_hits(spark, sf_dir, 20).filter("id <> qid")
    return metrics.hit_rate_at(rows, asked(spark, sf_dir), 10).select(F.round("hit_rate", 6).alias("hit_rate"))


@query("M05_precision_delta", f"""{RANKED} select round(avg(case when relevant and rank <= 5 then 1.0 else 0 end) - avg(case when relevant and rank <= 10 then 1.0 else 0 end), 6) as delta_p from r where rank <= 20""")
def precision_delta(spark, sf_dir):
    rows = judged_hits(spark, sf_dir, 20)
    p = lambda k: rows.agg(F.avg((F.col("relevant") & (F.col("rank") <= k)).cast("double")).alias("p"))
    return metrics.delta(p(10), p(5), ["p"]).select(F.round("delta_p", 6).alias("delta_p"))


@query("M06_unlabelled_hits", f"{RANKED} select qid, id, case when id % 3 = 0 then 'Exact' when id % 3 = 1 then 'Complement' else 'Irrelevant' end as label from r where rank <= 10")
def unlabelled(spark, sf_dir):
    hits = dense(spark, sf_dir, 10)
    known = hits.filter("id % 3 < 2").select("qid", "id", F.when(F.col("id") % 3 == 0, "Exact").otherwise("Complement").alias("label"))
    return metrics.labelled(hits, known.unionByName(known.withColumn("label", F.lit("Irrelevant")))).select("qid", "id", "label")


PRED = "with x as (select case when quality = 1 then 'good' else 'bad' end as target, case when doc_id % 5 = 0 then 'bad' when toxic = 1 then 'toxic' else 'good' end as pred from labels)"


def predictions(spark, sf_dir):
    return table(spark, sf_dir, "labels").select(F.when(F.col("quality") == 1, "good").otherwise("bad").alias("target"), F.when(F.col("doc_id") % 5 == 0, "bad").when(F.col("toxic") == 1, "toxic").otherwise("good").alias("pred"))


@query("M07_confusion", f"{PRED} select target, pred, count(*) as n from x group by 1, 2")
def confusion(spark, sf_dir):
    return metrics.confusion(predictions(spark, sf_dir))


@query("M07_class_report", f"""{PRED}, l as (select target as label from x union select pred from x), c as (select label, count(*) filter (where target = label and pred = label) as tp, count(*) filter (where pred = label) as said, count(*) filter (where target = label) as support from l cross join x group by 1),
p as (select *, case when said = 0 then 0 else tp / said end as precision, case when support = 0 then 0 else tp / support end as recall from c)
select label, round(precision, 6) as precision, round(recall, 6) as recall, round(case when precision + recall = 0 then 0 else 2 * precision * recall / (precision + recall) end, 6) as f1, support from p""")
def class_report(spark, sf_dir):
    r = metrics.class_report(predictions(spark, sf_dir))
    return r.select("label", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"), F.round("f1", 6).alias("f1"), "support")


@query("M07_micro", f"{PRED} select round(avg(case when target = pred then 1.0 else 0 end), 6) as micro from x")
def micro(spark, sf_dir):
    return metrics.overall_report(predictions(spark, sf_dir)).select(F.round("micro", 6).alias("micro"))


@query("M08_judged_kept", """with j as (select distinct doc_id from labels), o as (select doc_id, row_number() over (order by md5(doc_id || '#7'), doc_id) as r from documents where doc_id not in (select doc_id from j))
select doc_id as id from documents where doc_id in (select doc_id from j) union all select doc_id from o where r <= 600 - (select count(*) from documents where doc_id in (select doc_id from j))""")
def judged_kept(spark, sf_dir):
    docs, judged = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id")), table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"))
    return datasets.catalog_subsample(docs, judged, 600, 7)


@query("M09_classifier_share", f"with q as ({ROUTE}) select round(avg(case when starts_with(text, 'tze') then 1.0 else 0 end), 6) as strict_share from q")
def classifier_share(spark, sf_dir):
    return routed(spark, sf_dir).agg(F.round(F.avg(identifiers.is_strict_identifier(F.col("text")).cast("double")), 6).alias("strict_share"))


@query("U06_overlap_sizes", f"{RANKED} select qid, count(*) filter (where rank <= 10 and rank > 4) as shared from r where rank <= 14 group by 1")
def overlap_sizes(spark, sf_dir):
    hits = dense(spark, sf_dir, 14)
    a, b = hits.filter("rank <= 10").groupBy("qid").agg(F.collect_set("id").alias("a")), hits.filter("rank > 4").groupBy("qid").agg(F.collect_set("id").alias("b"))
    return a.join(b, "qid").select("qid", F.size(F.array_intersect("a", "b")).cast("long").alias("shared"))


# aggregations

CODES = "with x as (select doc_id as id, source as a, lang as b, source || lang as c from documents), u as (select distinct id, v from (select id, a as v from x union all select id, b from x union all select id, c from x))"


@query("A16_frequency_denylist", f"{CODES} select v, count(*) as n from u group by 1 having count(*) > 40")
def denylist(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.explode(F.array_distinct(F.array("source", "lang", F.concat("source", "lang")))).alias("v"))
    return d.distinct().groupBy("v").agg(F.count("*").alias("n")).filter("n > 40")


@query("A01_grouped_lists", "select l_orderkey, count(*) as n, string_agg(l_returnflag || l_linenumber, ',' order by l_returnflag || l_linenumber) as xs from lineitem group by 1")
def grouped_lists(spark, sf_dir):
    xs = F.array_sort(F.collect_list(F.concat("l_returnflag", F.col("l_linenumber").cast("string"))))
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.array_join(xs, ",").alias("xs"))


@query("A05_partial_aggregates", "select l_partkey, count(*) as n, min(l_extendedprice) as low, max(l_extendedprice) as high from lineitem group by 1")
def partial(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("n"), F.min("l_extendedprice").alias("low"), F.max("l_extendedprice").alias("high"))


@query("A17_label_cross_tab", "select source, count(*) filter (where quality = 1) as good, count(*) filter (where toxic = 1) as toxic, count(*) filter (where quality is null) as unrated from documents left join labels using (doc_id) group by 1")
def cross_tab(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return rows.groupBy("source").agg(F.count_if(F.col("quality") == 1).alias("good"), F.count_if(F.col("toxic") == 1).alias("toxic"), F.count_if(F.col("quality").isNull()).alias("unrated"))


@query("A18_two_level_counts", "with q as (select conv_id, count(*) filter (where role = 'user') as u, count(*) as n from conversations group by 1) select count(*) filter (where u = 0) as none, count(*) filter (where u >= 1) as some, count(*) as total from q")
def two_level(spark, sf_dir):
    q = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count_if(F.col("role") == "user").alias("u"))
    return q.agg(F.count_if(F.col("u") == 0).alias("none"), F.count_if(F.col("u") >= 1).alias("some"), F.count("*").alias("total"))


@query("A19_single_label_queries", "select source, count(*) as n, count(distinct lang) as langs from documents join labels using (doc_id) where quality = 1 group by 1 having count(distinct lang) filter (where toxic = 0) >= 2")
def single_label(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").filter("quality = 1")
    out = rows.groupBy("source").agg(F.count("*").alias("n"), F.countDistinct("lang").alias("langs"), F.countDistinct(F.when(F.col("toxic") == 0, F.col("lang"))).alias("c"))
    return out.filter("c >= 2").drop("c")


@query("A20_discrete_quantiles", "select quantile_disc(length(text), 0.5) as p50, quantile_disc(length(text), 0.9) as p90, quantile_disc(length(text), 0.99) as p99 from documents")
def quantiles(spark, sf_dir):
    table(spark, sf_dir, "documents").select(F.length("text").cast("long").alias("n")).createOrReplaceTempView("_lengths")
    at = lambda p: f"cast(percentile_disc({p}) within group (order by n) as bigint)"
    return spark.sql(f"select {at(0.5)} as p50, {at(0.9)} as p90, {at(0.99)} as p99 from _lengths")


@query("A21_length_histogram", "select length(text) // 500 as bin, count(*) as n from documents group by 1")
def histogram(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy(F.floor(F.length("text") / 500).alias("bin")).agg(F.count("*").alias("n"))


@query("A22_distinct_counts", "select count(distinct source) as a, count(distinct (source, lang)) as b, count(distinct trim(lower(text))) as c from documents")
def distinct_counts(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.agg(F.countDistinct("source").alias("a"), F.countDistinct(F.struct("source", "lang")).alias("b"), F.countDistinct(F.trim(F.lower("text"))).alias("c"))


@query("A23_top_values", "select source, count(*) as n from documents group by 1 order by n desc, source limit 5")
def top_values(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "source").limit(5)


@query("A24_per_query_stats", "with q as (select conv_id, count(*) as n, sum(length(text)) as s from conversations group by 1) select round(avg(n), 6) as mean, min(n) as low, max(n) as high, cast(sum(s) as bigint) as chars, (select count(*) from benchmark) as items from q")
def per_query(spark, sf_dir):
    q = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("s"))
    out = q.agg(F.round(F.avg("n"), 6).alias("mean"), F.min("n").alias("low"), F.max("n").alias("high"), F.sum("s").alias("chars"))
    return out.crossJoin(table(spark, sf_dir, "benchmark").agg(F.count("*").alias("items")))


@query("A25_query_log_rollup", "select event_type, user_id % 20 as u, count(*) as n, count(distinct user_id) as users, arg_max(event_id, (ts, event_id)) as last_id from events group by 1, 2")
def rollup(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type", (F.col("user_id") % 20).alias("u")).agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"), F.max_by("event_id", F.struct("ts", "event_id")).alias("last_id"))


@query("A26_first_row_inputs", "select md5(text) as h, min(doc_id) as doc_id, arg_min(source, doc_id) as source from documents group by 1")
def first_rows(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy(F.md5("text").alias("h")).agg(F.min("doc_id").alias("doc_id"), F.min_by("source", "doc_id").alias("source"))


@query("A27_hash_sets", "select lang, count(distinct md5(text)) as n from documents group by 1")
def hash_sets(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.size(F.collect_set(F.md5("text"))).cast("long").alias("n"))


@query("A28_brand_dictionary", "select lower(trim(p_brand)) as brand, count(*) as n from part group by 1 having count(*) >= 70 order by n desc, brand limit 2000")
def brands(spark, sf_dir):
    raw = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.count("*").alias("n"))
    rows = raw.groupBy(F.lower(F.trim(text.nfkc("p_brand"))).alias("brand")).agg(F.sum("n").alias("n"))
    return rows.filter("n >= 70").orderBy(F.desc("n"), "brand").limit(2000)


@query("A29_majority_label", """with t as (select source, quality as l from documents join labels using (doc_id) where doc_id % 2 = 0), g as (select source, l, count(*) as n from t group by 1, 2), b as (select source, l from (select *, row_number() over (partition by source order by n desc, l) as r from g) where r = 1),
a as (select l from (select l, count(*) as n from t group by 1) order by n desc, l limit 1) select doc_id, coalesce(b.l, (select l from a)) as pred from documents left join b using (source) where doc_id % 2 = 1""")
def majority(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "source")
    train = d.filter("doc_id % 2 = 0").join(table(spark, sf_dir, "labels"), "doc_id").select("source", F.col("quality").alias("l"))
    return datasets.majority_labels(train, d.filter("doc_id % 2 = 1"), "source", "l").select("doc_id", "pred")


@query("A30_contingency", """with c as (select quality as a, toxic as b, count(*) as n from labels group by 1, 2), x as (select *, sum(n) over (partition by a) as na, sum(n) over (partition by b) as nb, sum(n) over () as t from c),
s as (select sum(n / t * ln((n / t) / ((na / t) * (nb / t)))) as mi, sum(-(n / t) * ln(na / t)) as ha, sum(-(n / t) * ln(nb / t)) as hb, sum(n * n / (na * nb / t)) - max(t) as chi2, max(t) as t from x)
select round(sqrt(greatest(chi2 / t, 0)), 6) as v, round(mi, 6) as mi, round(ha, 6) as ha, round(hb, 6) as hb, round(mi / sqrt(ha * hb), 6) as nmi from s""")
def contingency(spark, sf_dir):
    r = metrics.contingency(table(spark, sf_dir, "labels"), "quality", "toxic")
    return r.select(*(F.round(a, 6).alias(b) for a, b in (("cramers_v", "v"), ("mi", "mi"), ("ha", "ha"), ("hb", "hb"), ("nmi", "nmi"))))


@query("A30_overlap", "select count(*) filter (where quality = 1 and toxic = 1) / count(*) filter (where quality = 1 or toxic = 1) as jaccard, count(*) filter (where quality = 1 and toxic = 1) / count(*) filter (where quality = 1) as a_in_b, count(*) filter (where quality = 1 and toxic = 1) / count(*) filter (where toxic = 1) as b_in_a from labels")
def overlap(spark, sf_dir):
    return metrics.overlap(table(spark, sf_dir, "labels"), F.col("quality") == 1, F.col("toxic") == 1)


@query("A31_dedup_rate", "with c as (select sha256(text) as h, count(*) as n from documents group by 1) select cast(sum(n) as bigint) as rows, count(*) as uniques, round(1 - count(*) / sum(n), 9) as dup_rate, max(n) as largest from c")
def dedup_rate(spark, sf_dir):
    return datasets.dedup_rate(table(spark, sf_dir, "documents"), F.col("text")).withColumn("dup_rate", F.round("dup_rate", 9))


@query("A31_cluster_histogram", "with c as (select sha256(text) as h, count(*) as size from documents group by 1) select size, count(*) as clusters from c group by 1")
def clusters(spark, sf_dir):
    return datasets.cluster_histogram(table(spark, sf_dir, "documents"), F.col("text"))


@query("Z03_dedup_delta", "with a as (select 1 - count(distinct sha256(text)) / count(*) as r from documents), b as (select 1 - count(distinct sha256(substr(text, 1, 40))) / count(*) as r from documents) select round(b.r - a.r, 9) as delta_dup_rate from a, b")
def dedup_delta(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    out = metrics.delta(datasets.dedup_rate(d, F.col("text")), datasets.dedup_rate(d, F.col("text"), 40), ["dup_rate"])
    return out.select(F.round("delta_dup_rate", 9).alias("delta_dup_rate"))


@query("A33_bundle_scores", "with b as (select doc_id, unnest(string_split(text, chr(10))) as part from documents) select doc_id, max(length(part)) as best, round(avg(length(part)), 6) as mean from b where part <> '' group by 1")
def bundles(spark, sf_dir):
    parts = table(spark, sf_dir, "documents").select("doc_id", F.explode(retrieval.bundle_scores(F.col("text"), "\n")).alias("part"))
    return parts.groupBy("doc_id").agg(F.max(F.length("part")).cast("long").alias("best"), F.round(F.avg(F.length("part")), 6).alias("mean"))


@query("A34_class_weights", "select l as label, round(case when n = 0 then 0 else t / (3.0 * n) end, 9) as weight from (select l, (select count(*) from labels) as t, (select count(*) from labels where quality = l) as n from (values (0), (1), (2)) v(l))")
def class_weights(spark, sf_dir):
    return datasets.class_weights(table(spark, sf_dir, "labels"), "quality", [0, 1, 2]).withColumn("weight", F.round("weight", 9))


@query("A35_leakage", "select text from (select text, count(distinct doc_id % 2) as s from documents group by 1) where s > 1")
def leakage(spark, sf_dir):
    return datasets.leaks(table(spark, sf_dir, "documents").withColumn("split", F.col("doc_id") % 2), "text").select("text")


@query("A36_percentiles", "select round(quantile_cont(value, 0.5), 6) as p50, round(quantile_cont(value, 0.95), 6) as p95, round(quantile_cont(value, 0.99), 6) as p99 from events")
def percentiles(spark, sf_dir):
    at = lambda p: F.round(F.percentile("value", p), 6)
    return table(spark, sf_dir, "events").agg(at(0.5).alias("p50"), at(0.95).alias("p95"), at(0.99).alias("p99"))


# windows

@query("W01_global_row_ids", "select o_orderkey, row_number() over (order by o_totalprice desc, o_orderkey) as rid from orders")
def row_ids(spark, sf_dir):
    return datasets.row_ids(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), F.asc("o_orderkey")], "rid").select("o_orderkey", F.col("rid").cast("long").alias("rid"))


@query("W02_continued_ids", "select o_orderkey, 1000 + row_number() over (order by o_orderkey) as rid from orders")
def continued_ids(spark, sf_dir):
    return datasets.row_ids(table(spark, sf_dir, "orders").select("o_orderkey"), [F.asc("o_orderkey")], "rid", 1000).select("o_orderkey", F.col("rid").cast("long").alias("rid"))


@query("W03_stratified_sample", "select doc_id from (select doc_id, row_number() over (partition by source order by md5(doc_id || '#5'), doc_id) as r from documents) where r <= 20")
def stratified_sample(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "source")
    return datasets.per_group(d, ["source"], [datasets.shuffled(F.col("doc_id"), 5), F.asc("doc_id")], 20).select("doc_id")


@query("W04_percent_split", "select doc_id, case when t <= 80 then 'train' when t <= 90 then 'validation' else 'test' end as split from (select doc_id, ntile(100) over (partition by source, lang order by md5(doc_id || '#1'), doc_id) as t from documents)")
def percent_split(spark, sf_dir):
    return datasets.percent_split(table(spark, sf_dir, "documents"), ["source", "lang"], "doc_id", 1).select("doc_id", "split")


@query("W05_first_of_pair", "select l_partkey, l_suppkey, min(l_orderkey * 10 + l_linenumber) as k from lineitem group by 1, 2")
def first_of_pair(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").withColumn("k", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    return datasets.keep_first(rows, ["l_partkey", "l_suppkey"], [F.asc("k")]).select("l_partkey", "l_suppkey", "k")


@query("W06_surrogate_ids", "select distinct p_name, dense_rank() over (order by p_name) as sid from part")
def surrogate(spark, sf_dir):
    names = table(spark, sf_dir, "part").select("p_name").distinct()
    return datasets.row_ids(names, [F.asc("p_name")], "sid").select("p_name", F.col("sid").cast("long").alias("sid"))


@query("W07_list_features", """select l_orderkey, l_linenumber, l_partkey, count(*) over w as group_size, dense_rank() over (partition by l_orderkey order by l_extendedprice desc) as rk, round(max(l_extendedprice) over w - l_extendedprice, 4) as gap,
 round((l_extendedprice - avg(l_extendedprice) over w) / coalesce(nullif(stddev_samp(l_extendedprice) over w, 0), 1), 5) as z from lineitem window w as (partition by l_orderkey)""")
def list_features(spark, sf_dir):
    rows = datasets.list_features(table(spark, sf_dir, "lineitem"), "l_orderkey", ["l_extendedprice"])
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "group_size", F.col("l_extendedprice_rank").cast("long").alias("rk"), F.round("l_extendedprice_gap", 4).alias("gap"), F.round("l_extendedprice_z", 5).alias("z"))


@query("W08_label_caps", "select l_orderkey, l_linenumber, l_partkey from (select *, row_number() over (partition by l_orderkey, l_returnflag order by l_partkey, l_linenumber, l_suppkey) as r, count(*) filter (where l_returnflag = 'A') over (partition by l_orderkey) as a from lineitem) where r <= 2 and a >= 2")
def label_caps(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").withColumn("a", F.count_if(F.col("l_returnflag") == "A").over(Window.partitionBy("l_orderkey"))).filter("a >= 2")
    return datasets.per_group(rows, ["l_orderkey", "l_returnflag"], [F.asc("l_partkey"), F.asc("l_linenumber"), F.asc("l_suppkey")], 2).select("l_orderkey", "l_linenumber", "l_partkey")


@query("W09_leg_ranks", f"{RANKED} select qid, id, rank from r where rank <= 50")
def leg_ranks(spark, sf_dir):
    return retrieval.with_rank(dense(spark, sf_dir, 50).drop("rank"), ["qid"]).select("qid", "id", F.col("rank").cast("long").alias("rank"))


MINED = f"{RANKED}, n as (select qid, id, row_number() over (partition by qid order by score desc, id) - 1 as place from r where rank <= 100 and not relevant)"


@query("W10_rank_band", f"{MINED} select qid, id, place from n where place >= 5 and place < 15")
def rank_band(spark, sf_dir):
    hits = judged_hits(spark, sf_dir, 100)
    return datasets.mine_negatives(hits, hits.filter("relevant"), 5, 40, 10).select("qid", "id", F.col("place").cast("long").alias("place"))


@query("D07_mined_negatives", f"{MINED} select qid, id from n where place < 8")
def mined(spark, sf_dir):
    hits = judged_hits(spark, sf_dir, 100)
    return datasets.mine_negatives(hits, hits.filter("relevant"), 0, 50, 8).select("qid", "id")


@query("J17_positives_out", f"{RANKED} select qid, id from r where rank <= 100 and not relevant")
def positives_out(spark, sf_dir):
    hits = judged_hits(spark, sf_dir, 100)
    return datasets.sidecar(hits.select("qid", "id"), hits.filter("relevant")).select("qid", "id")


# datasets

@query("D01_records", "select doc_id, quality = 1 as label, length(text) as n from documents join labels using (doc_id) where trim(text) <> ''")
def records(spark, sf_dir):
    from ..functions.text import render

    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").withColumn("rendered", render([("", F.col("text"))]))
    return rows.filter("rendered is not null").select("doc_id", (F.col("quality") == 1).alias("label"), F.length("text").cast("long").alias("n"))


@query("D02_split_by_query", "with q as (select distinct conv_id from conversations), r as (select conv_id, row_number() over (order by md5(conv_id || '#3'), conv_id) as r from q), n as (select greatest(1, floor(count(*) * 0.2)) as n from q) select conv_id, turn, case when r <= n then 'validation' else 'train' end as split from conversations join r using (conv_id) cross join n")
def split_by_query(spark, sf_dir):
    return datasets.split_by_query(table(spark, sf_dir, "conversations"), "conv_id", 0.2, 3).select("conv_id", "turn", "split")


@query("D03_split_by_component", """with c as (select o_custkey as c, count(*) as n from orders group by 1), o as (select c, coalesce(sum(n) over (order by md5('o:' || c || '#3'), 'o:' || c rows between unbounded preceding and 1 preceding), 0) as before from c),
t as (select greatest(1, floor(count(*) * 0.2)) as target from orders) select o_orderkey, case when before < target then 'validation' else 'train' end as split from orders join o on c = o_custkey cross join t""")
def split_by_component(spark, sf_dir):
    """Orders linked by their customer: a component is a customer with all orders."""
    return datasets.split_by_component(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "o_orderkey", "o_custkey", 0.2, 3).select("o_orderkey", "split")


@query("D03_split_lineitem")
def split_lineitem(spark, sf_dir):
    """The split of every lineitem, by the components of its orders and parts."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    return datasets.split_by_component(rows, "l_orderkey", "l_partkey", 0.2, 3)


@query("D04_given_split", "select doc_id, case source when 'src1' then 'validation' when 'src2' then 'test' else 'train' end as split from documents where source <> 'src3'")
def given_split(spark, sf_dir):
    s = F.col("source")
    rows = table(spark, sf_dir, "documents").filter("source is not null").select("doc_id", F.when(s == "src1", "Validation ").when(s == "src2", "test").when(s == "src3", None).otherwise("train").alias("split"))
    return datasets.given_split(rows, "split").select("doc_id", "split")


@query("D05_eligible_queries", "select source as qid, count(*) filter (where quality = 1) as positives, count(*) filter (where quality = 0) as negatives from documents join labels using (doc_id) group by 1 having count(*) filter (where quality = 1) >= 10")
def eligible(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").select(F.col("source").alias("qid"), F.col("quality").alias("label"))
    return datasets.eligible_queries(rows, 10)


@query("D06_sidecar", f"{RANKED} select qid, id, 'hard' as provenance from r where rank <= 30 and not relevant")
def sidecar(spark, sf_dir):
    hits = judged_hits(spark, sf_dir, 30)
    return datasets.sidecar(hits.select("qid", "id"), hits.filter("relevant")).select("qid", "id", "provenance")


@query("D08_anchor_batches", f"""{RANKED}, p as (select qid, count(*) filter (where relevant) as p, count(*) filter (where not relevant and rank <= 20) as h, count(*) filter (where not relevant and rank > 20) as m from r where rank <= 60 group by 1)
select qid, least(40, p) as positives, least(40 - least(40, p), h) as hard, least(40 - least(40, p) - least(40 - least(40, p), h), m) as semi from p where p + h + m >= 8""")
def anchor_batches(spark, sf_dir):
    hits = judged_hits(spark, sf_dir, 60)
    rest = hits.filter("not relevant")
    rows = datasets.anchor_batches(hits.filter("relevant"), rest.filter("rank <= 20"), rest.filter("rank > 20"), hits.limit(0), 40, 8, 1)
    n = lambda x: F.count_if(F.col("source") == x)
    return rows.groupBy("qid").agg(n("positive").alias("positives"), n("hard").alias("hard"), n("semi").alias("semi"))


@query("D09_query_pool", f"{RANKED}, x as (select qid, id, 0 as prio, 'positive' as source from r where rank <= 60 and relevant union all select qid, id, 1, 'mined' from r where rank <= 60), o as (select * from (select *, row_number() over (partition by qid, id order by prio) as k from x) where k = 1) select qid, id, source, slot from (select *, row_number() over (partition by qid order by prio, md5(qid || '#' || id || '#2'), id) as slot from o) where slot <= 12")
def pool(spark, sf_dir):
    hits = judged_hits(spark, sf_dir, 60)
    return datasets.fill_by_priority([("positive", hits.filter("relevant")), ("mined", hits)], 12, 2).select("qid", "id", "source", F.col("slot").cast("long").alias("slot"))


@query("D10_batch_stats", "select source, count(*) as n, count(distinct lang) as batches from documents group by 1")
def batch_stats(spark, sf_dir):
    return datasets.batch_stats(table(spark, sf_dir, "documents").select("source", F.col("lang").alias("qid")))


def curated(spark, sf_dir):
    k = F.concat_ws("-", "event_type", F.col("user_id").cast("string"))
    rows = table(spark, sf_dir, "events").groupBy(k.alias("key")).agg(F.count("*").alias("n"), F.max("value").alias("v"))
    band = F.when(F.col("n") >= 18, "head").when(F.col("n") >= 13, "torso").otherwise("tail")
    return rows.select("key", band.alias("band"), F.when(F.col("v") < 60, "low").otherwise("high").alias("hits"), (F.length("key") % 2 == 0).alias("mpn"))


CURATED = "with k as (select event_type || '-' || user_id as key, count(*) as n, max(value) as v from events group by 1), c as (select key, case when n >= 18 then 'head' when n >= 13 then 'torso' else 'tail' end as band, case when v < 60 then 'low' else 'high' end as hits, length(key) % 2 = 0 as mpn from k)"


QUOTA = f"""{CURATED}, g as (select *, case hits when 'low' then 60 else 40 end as t, case band when 'head' then 0.05 when 'torso' then 0.25 else 0.7 end as q, md5(key || '#0') as h from c),
w as (select *, row_number() over (partition by hits, band order by h, key) as r from g), x as (select *, case when band = 'tail' then 1 when r <= floor(t * q) then 0 else 2 end as leftover from w),
picked as (select key, hits, band, mpn, h from (select *, row_number() over (partition by hits order by leftover, h, key) as p from x) where p <= t)"""


def picked(spark, sf_dir):
    return datasets.stratified_quota(curated(spark, sf_dir), "hits", "band", {"low": 60, "high": 40}, {"head": 0.05, "torso": 0.25, "tail": 0.7}, "key", 0)


@query("D12_stratified_quota", f"{QUOTA} select key, hits, band from picked")
def quota(spark, sf_dir):
    return picked(spark, sf_dir).select("key", "hits", "band")


@query("D12_floor_swap", f"""{QUOTA}, spare as (select key, row_number() over (order by h, key) as r from g where mpn and key not in (select key from picked)), need as (select greatest(0, 75 - count(*)) as n from picked where mpn),
victim as (select key, row_number() over (order by h, key) as r from picked where not mpn), swap as (select v.key as gone, s.key as new from victim v join spare s using (r) where r <= (select n from need))
select key from picked where key not in (select gone from swap) union all select new from swap""")
def floor_swap(spark, sf_dir):
    return datasets.swap_for_floor(picked(spark, sf_dir), curated(spark, sf_dir), "key", "mpn", 75, F.lit(True), 0).select("key")


@query("D13_balanced_build", "select l_orderkey, least(count(*) filter (where l_returnflag = 'A'), 3) as pos, least(count(*) filter (where l_returnflag <> 'A'), 3) as neg from lineitem group by 1 having count(*) filter (where l_returnflag = 'A') >= 2")
def balanced(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").withColumn("pos", F.col("l_returnflag") == "A")
    kept = datasets.per_group(rows, ["l_orderkey", "pos"], [F.asc("l_partkey"), F.asc("l_suppkey"), F.asc("l_linenumber")], 3)
    n = rows.groupBy("l_orderkey").agg(F.count_if("pos").alias("have")).filter("have >= 2").select("l_orderkey")
    return kept.join(n, "l_orderkey", "left_semi").groupBy("l_orderkey").agg(F.count_if("pos").alias("pos"), F.count_if(~F.col("pos")).alias("neg"))


@query("D14_deep_negatives", f"{RANKED} select qid, id from (select qid, id, row_number() over (partition by qid order by md5(qid || '#' || id || '#4'), id) as k from r where rank <= 200 and score < 0.2 and not relevant) where k <= 6")
def deep_negatives(spark, sf_dir):
    hits = judged_hits(spark, sf_dir, 200)
    return datasets.deep_negatives(hits, hits.filter("relevant"), 0.2, 6, 4).select("qid", "id")


@query("D15_dataset_stats", "select count(*) as rows, count(distinct source) as queries, count(distinct text) as texts, round(avg(case when lang = 'en' then 1.0 else 0 end), 6) as en_rate from documents")
def dataset_stats(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.agg(F.count("*").alias("rows"), F.countDistinct("source").alias("queries"), F.countDistinct("text").alias("texts"), F.round(F.avg((F.col("lang") == "en").cast("double")), 6).alias("en_rate"))


@query("D08_synthetic_negatives", """with n as (select greatest(1, ceil(count(*) / 36.0)) as b from documents), o as (select doc_id as id, ('0x' || substr(md5(doc_id || '#1'), 1, 12))::bigint % b as b from documents cross join n),
q as (select item_id as qid, (('0x' || substr(md5(item_id || '#2'), 1, 12))::bigint + x) % b as b from benchmark cross join n, unnest([0, 1]) as u(x))
select qid, id from (select distinct qid, id, row_number() over (partition by qid order by md5(qid || '#' || id || '#1'), id) as r from (select distinct qid, id from q join o using (b) where id <> qid * 3)) where r <= 5""")
def synthetic(spark, sf_dir):
    q = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"))
    offers = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"))
    return datasets.synthetic_negatives(q, offers, q.withColumn("id", F.col("qid") * 3), 5, 1)


# joins, sets and limits

@query("J05_mapped_codes", "select p_partkey, array_to_string(list_sort([p_size % 5 * 10, p_size % 5 * 10 + 1]), ',') as codes from part where p_size % 5 <> 0")
def mapped(spark, sf_dir):
    mapping = F.create_map(*(F.lit(x) for i in range(1, 5) for x in (i, [i * 10, i * 10 + 1])))
    found = F.try_element_at(mapping, (F.col("p_size") % 5).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(found, ",").alias("codes")).filter("codes is not null")


@query("J06_dedup_then_join", "select p_partkey, upper(p_type) || '!' as t from part")
def dedup_then_join(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    derived = p.select("p_type").distinct().withColumn("t", F.concat(F.upper("p_type"), F.lit("!")))
    return p.join(derived, "p_type").select("p_partkey", "t")


@query("J03_hash_join", "select o_orderkey, l_linenumber, l_partkey from orders join lineitem on o_orderkey = l_orderkey where o_orderstatus = 'F'")
def hash_join(spark, sf_dir):
    o = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select("o_orderkey").hint("shuffle_hash")
    return table(spark, sf_dir, "lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey")).select("o_orderkey", "l_linenumber", "l_partkey")


@query("J11_inner_then_left", "select l_orderkey, l_linenumber, l_partkey, p_name, o_orderstatus from lineitem join part on l_partkey = p_partkey left join orders on l_orderkey = o_orderkey and o_orderstatus = 'F'")
def inner_then_left(spark, sf_dir):
    o = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderstatus")
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey")).join(o, "l_orderkey", "left")
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "p_name", "o_orderstatus")


@query("J12_labels_left", "select doc_id, quality, toxic from documents left join labels using (doc_id)")
def labels_left(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels"), "doc_id", "left")


@query("J13_cache_look_aside", "select doc_id, case when doc_id % 2 = 0 then 'cached' else 'computed' end as origin from documents")
def look_aside(spark, sf_dir):
    from ..sources.readers import look_aside as f

    d = table(spark, sf_dir, "documents").select("doc_id")
    cache = d.filter("doc_id % 2 = 0").withColumn("origin", F.lit("cached"))
    return f(d, cache, "doc_id", "origin", lambda missing: missing.withColumn("origin", F.lit("computed")))


@query("J14_four_key_join", "select a.doc_id from documents a join documents b on a.doc_id = b.doc_id and a.text = b.text and a.lang = b.lang and a.source = b.source")
def four_keys(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return datasets.keep_first(d.join(d, ["doc_id", "text", "lang", "source"]), ["doc_id"], [F.asc("source")]).select("doc_id")


@query("J15_missing_either_side", "select (select count(*) from documents where doc_id not in (select doc_id from labels)) as a, (select count(*) from labels where doc_id not in (select doc_id from documents)) as b")
def missing(spark, sf_dir):
    d, lab = table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels").select("doc_id")
    return d.join(lab, "doc_id", "left_anti").agg(F.count("*").alias("a")).crossJoin(lab.join(d, "doc_id", "left_anti").agg(F.count("*").alias("b")))


@query("J16_anti_by_value", "select distinct p_name from part where p_partkey % 2 = 0 and p_name not in (select p_name from part where p_partkey % 3 = 1 and p_size < 5)")
def anti_by_value(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.filter("p_partkey % 2 = 0").select("p_name").distinct().join(p.filter("p_partkey % 3 = 1 and p_size < 5").select("p_name"), "p_name", "left_anti")


@query("J18_checked_lookup", "select l_orderkey, l_linenumber, l_partkey, p_type from lineitem join part on l_partkey = p_partkey")
def checked_lookup(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_type")
    rows = table(spark, sf_dir, "lineitem").join(p, "l_partkey", "left")
    checked = F.when(F.assert_true(F.col("p_type").isNotNull(), F.lit("no such part")).isNull(), F.col("p_type"))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", checked.alias("p_type"))


@query("J21_zip_by_id", "select doc_id, length(text) as n, lang from documents")
def zip_by_id(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.length("text").cast("long").alias("n")).join(d.select("doc_id", "lang"), "doc_id")


@query("J04_one_aggregation", "select l_partkey, min(l_extendedprice) filter (where l_returnflag = 'A') as a, max(l_extendedprice) filter (where l_returnflag = 'N') as n from lineitem group by 1")
def one_aggregation(spark, sf_dir):
    v = lambda f: F.when(F.col("l_returnflag") == f, F.col("l_extendedprice"))
    return table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.min(v("A")).alias("a"), F.max(v("N")).alias("n"))


@query("O02_top_k", "select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 25")
def top(spark, sf_dir):
    return table(spark, sf_dir, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25).select("o_orderkey", "o_totalprice")


@query("O03_nulls_last", "select doc_id, quality from documents left join labels using (doc_id) order by quality desc nulls last, doc_id limit 500")
def nulls_last(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    return rows.orderBy(F.desc_nulls_last("quality"), "doc_id").limit(500)


@query("O04_seeded_sample", "select doc_id from documents order by md5(doc_id || '#9'), doc_id limit 30")
def seeded(spark, sf_dir):
    return table(spark, sf_dir, "documents").orderBy(datasets.shuffled(F.col("doc_id"), 9), "doc_id").limit(30).select("doc_id")


@query("U01_union_all", "select doc_id from documents union all select doc_id from labels")
def union_all(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id").unionByName(table(spark, sf_dir, "labels").select("doc_id"))


@query("U02_joined_and_inline", "select o_orderkey, count(l_partkey) + 1 as n from orders left join lineitem on o_orderkey = l_orderkey group by 1")
def joined_inline(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_list("l_partkey").alias("xs"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey").join(li, "o_orderkey", "left")
    return rows.select("o_orderkey", F.size(F.concat(F.coalesce("xs", F.array().cast("array<bigint>")), F.array(F.col("o_orderkey")))).cast("long").alias("n"))


@query("U03_distinct", "select distinct source, lang from documents")
def distinct(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("source", "lang").distinct()


@query("U04_keep_first", "select text, min(doc_id) as doc_id from documents group by 1")
def keep_first(spark, sf_dir):
    return datasets.keep_first(table(spark, sf_dir, "documents").select("text", "doc_id"), ["text"], [F.asc("doc_id")])


@query("U05_key_difference", "select doc_id from documents except select doc_id from labels")
def difference(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id").subtract(table(spark, sf_dir, "labels").select("doc_id"))


@query("U07_first_by_converted_id", "select lower(p_name) as i, min(p_partkey) as p from part group by 1")
def converted(spark, sf_dir):
    return datasets.keep_first(table(spark, sf_dir, "part").select(F.lower("p_name").alias("i"), F.col("p_partkey").alias("p")), ["i"], [F.asc("p")])


@query("Z01_transition_matrix", "select quality as a, toxic as b, count(*) as n, count(*) filter (where quality <> toxic) as changed from labels group by 1, 2")
def transitions(spark, sf_dir):
    lab = table(spark, sf_dir, "labels")
    rows = lab.select("doc_id", F.col("quality").alias("a")).join(lab.select("doc_id", F.col("toxic").alias("b")), "doc_id")
    return rows.groupBy("a", "b").agg(F.count("*").alias("n"), F.count_if(F.col("a") != F.col("b")).alias("changed"))


@query("Z02_inspection", "select count(*) as rows, count(*) - count(lang) as null_langs, count(*) - count(distinct doc_id) as dup_keys, quantile_cont(length(text), 0.5) as median, (select count(*) from benchmark where item_id not in (select doc_id from documents)) as without from documents")
def inspection(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    out = d.agg(F.count("*").alias("rows"), (F.count("*") - F.count("lang")).alias("null_langs"), (F.count("*") - F.countDistinct("doc_id")).alias("dup_keys"), F.percentile(F.length("text"), 0.5).alias("median"))
    lost = table(spark, sf_dir, "benchmark").join(d.select(F.col("doc_id").alias("item_id")), "item_id", "left_anti")
    return out.crossJoin(lost.agg(F.count("*").alias("without")))


@query("Z04_two_stage_mask", "select l_orderkey, l_linenumber, l_partkey from lineitem where l_partkey in (select p_partkey from part where p_size > 45)")
def two_stage(spark, sf_dir):
    keep = table(spark, sf_dir, "part").filter("p_size > 45").select(F.col("p_partkey").alias("l_partkey"))
    return table(spark, sf_dir, "lineitem").join(keep, "l_partkey", "left_semi").select("l_orderkey", "l_linenumber", "l_partkey")


@query("Z05_filtered_article_recall", f"""{SCORES}, o as (select *, row_number() over (partition by qid order by score desc, id) as place from s where id % 3 = 0),
b as (select qid, id // 4 as id, max(score) as score from o group by 1, 2), t as (select *, row_number() over (partition by qid order by score desc, id) as rank from b),
c as (select qid, id // 4 as id, max(score) as score from o where place <= 6 group by 1, 2), f as (select *, row_number() over (partition by qid order by score desc, id) as rank from c)
select t.qid, count(f.id) / 5.0 as recall from t left join f on f.qid = t.qid and f.id = t.id and f.rank <= 5 where t.rank <= 5 group by 1""")
def article_recall(spark, sf_dir):
    """Articles among the six best offers, held against the exact five best articles."""
    rows = articled(spark, sf_dir).filter("id % 3 = 0")
    few = retrieval.dense_top_k(asked(spark, sf_dir), rows, 6, digits=9).join(rows.select("id", "article"), "id")
    return retrieval.recall_at(retrieval.article_top_k(few, 5), retrieval.article_search(asked(spark, sf_dir), rows, 5, digits=9), 5)


@query("Z07_prewarmed_cache", "select md5(text) as h, min(doc_id) as doc_id from documents group by 1")
def prewarmed(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy(F.md5("text").alias("h")).agg(F.min("doc_id").alias("doc_id"))


@query("Z08_key_lookup", "select d.doc_id from documents d where md5(d.text) in (select md5(text) from documents where doc_id % 100 = 0)")
def key_lookup(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("h"))
    return d.join(d.filter("doc_id % 100 = 0").select("h").distinct(), "h").select("doc_id")


@query("Z10_rule_counts", "select count(*) filter (where regexp_matches(text, '[0-9]{16}')) as digits, count(*) filter (where contains(text, '@')) as mails, round(avg(case when regexp_matches(text, '[0-9]{16}') or contains(text, '@') then 1.0 else 0 end), 6) as share from documents")
def rule_counts(spark, sf_dir):
    a, b = F.col("text").rlike("[0-9]{16}"), F.contains("text", F.lit("@"))
    return table(spark, sf_dir, "documents").agg(F.count_if(a).alias("digits"), F.count_if(b).alias("mails"), F.round(F.avg((a | b).cast("double")), 6).alias("share"))


@query("Z11_slot_cross_tab", "select case p_partkey % 4 when 0 then 'NONE' when 1 then 'EXACT' when 2 then 'SUBSTRING_ONLY' else 'OFFER_INVALID' end as state, p_type as label, count(*) as n from part group by 1, 2")
def slots(spark, sf_dir):
    n = F.concat(F.lit("ab-"), (F.col("p_partkey") + 10000).cast("string"))
    kind = F.col("p_partkey") % 4
    q = F.when(kind == 0, "red ring").otherwise(n)
    own = F.when(kind == 1, n).when(kind == 2, F.concat(n, F.lit("-9"))).when(kind == 3, "n/a").otherwise(n)
    state = F.regexp_extract(identifiers.article_state(q, [own]), r"\[ART_(.*)\]", 1)
    return table(spark, sf_dir, "part").groupBy(state.alias("state"), F.col("p_type").alias("label")).agg(F.count("*").alias("n"))


@query("Z13_pair_metrics", f"{FIRST} select round(avg(coalesce(1.0 / rank, 0)), 6) as mrr from f")
def pair_metrics(spark, sf_dir):
    rows = judged_hits(spark, sf_dir, 20).filter("id <> qid")
    return metrics.mrr_and_success(rows, asked(spark, sf_dir), 1).select(F.round("mrr", 6).alias("mrr"))
