"""Registered queries of the training-data operators and their SQL checks."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from . import decontam, embed_dedup, html_text, langid, minhash, packing, pii, quality, suffix_dedup, url_filter

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, bench = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return decontam.digest(decontam.find_contamination(docs, bench, carry=["doc_id"]))


def op2_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find_personal_data(table(spark, sf_dir, "documents"), carry=["doc_id"]))


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_text(table(spark, sf_dir, "pages"), carry=["page_id"])


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), carry=["page_id"])


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ratings = table(spark, sf_dir, "labels").select("doc_id", quality.grade().alias("grade"))
    scored = quality.score(docs, quality.fit(docs, ratings), carry=["doc_id"])
    return scored.withColumn("keep", F.coalesce(F.col("p_top") >= quality.KEEP_TAIL, F.lit(True)))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digest(suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"), carry=["doc_id"]))


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    trees = langid.learn(docs.filter(~langid.held_out()))
    found = langid.predict(docs.select("doc_id", "text"), trees, carry=["doc_id"])
    return found.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


def op9_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), TOKENIZER)


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_vectors(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_decontaminate, op2_personal_data, op3_html_text, op4_url_filter, op5_quality, op6_suffix_dedup, op7_near_duplicates, op8_language, op9_pack, op10_embedding_dedup)}


_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP1_SQL = f"""
with w as (select row_number() over () as rid, doc_id, coalesce({_WORDS}, []) as ws from documents),
i as (select item_id, {_WORDS} as ws from benchmark where text is not null),
windows as (
  select distinct item_id, len(p) as n, array_to_string(p, ' ') as s from (
    select item_id, unnest(list_transform(range(1, greatest(len(ws) - 9, 1) + 1), lambda k: list_slice(ws, k, k + 9))) as p from i where len(ws) > 0)
), places as (
  select rid, n, unnest(list_transform(range(1, len(ws) - n + 2), lambda k: {{'k': k, 's': array_to_string(list_slice(ws, k, k + n - 1), ' ')}})) as x
  from w cross join (select distinct n from windows) where len(ws) >= n
), hits as (select rid, x.k as k, n, item_id from places join windows using (n) where x.s = s),
words as (select rid, count(distinct j) as n_hit from (select rid, unnest(range(k, k + n)) as j from hits) group by rid),
items as (select rid, count(distinct item_id) as n_items, string_agg(distinct cast(item_id as varchar), ',' order by cast(item_id as varchar)) as ids from hits group by rid)
select doc_id, len(ws) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from w left join words using (rid) left join items using (rid)
"""
OP10_SQL = """
with recursive e as (
  select vec_id, cast(embedding as double[]) as v from embeddings
  where embedding is not null and list_sum(list_transform(embedding, lambda x: abs(x))) > 0
), pairs as (
  select a.vec_id as a, b.vec_id as b from e a join e b on a.vec_id <> b.vec_id and list_cosine_similarity(a.v, b.v) >= 0.9
), reach(a, b) as (
  select a, b from pairs union select r.a, p.b from reach r join pairs p on r.b = p.a
)
select vec_id, coalesce(l.n, 0) as n_links, least(vec_id, coalesce(c.m, vec_id)) as component_id,
       vec_id <= coalesce(c.m, vec_id) as kept
from embeddings left join (select a, count(*) as n from pairs group by a) l on vec_id = l.a
left join (select a, min(b) as m from reach group by a) c on vec_id = c.a
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_decontaminate": OP1_SQL, "op10_embedding_dedup": OP10_SQL}
