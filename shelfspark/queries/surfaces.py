"""Queries of the remaining surfaces: bucketed joins, SQL functions, table functions, indexes, caches."""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.sql import functions as F

from ..functions import ids, prices
from ..operators import ann, datasets, losses
from ..operators.embedding import embed, encoded
from ..plans import search
from ..session import remove, table
from ..sources import readers
from . import query
from .data import asked, corpus
from .flows import folder
from .scalars import D62_SQL, N62_SQL


@query("J02_bucketed_join", "select l_partkey as k, count(*) as n from lineitem join part on l_partkey = p_partkey group by 1")
def bucketed(spark, sf_dir):
    """Two tables bucketed alike join without an exchange of either; the catalog keeps nothing of them."""
    from ..session import cut

    at, names = folder(spark), [f"b{uuid.uuid4().hex}" for _ in range(2)]
    li, p = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("k")), table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"))
    for name, rows in zip(names, (li, p), strict=True):
        rows.write.bucketBy(8, "k").sortBy("k").option("path", f"{at}/{name}").saveAsTable(name)
    out = cut(spark.table(names[0]).hint("merge").join(spark.table(names[1]), "k").groupBy("k").agg(F.count("*").alias("n")))
    for name in names:
        spark.sql(f"drop table {name}")
    remove(spark, at)
    return out


@query("X01_sql_function", "select p_partkey, length(p_name) between 4 and 40 and p_name not like '% %' as ok from part")
def sql_function(spark, sf_dir):
    spark.sql("create or replace temporary function one_word(v string) returns boolean return length(v) between 4 and 40 and v not like '% %'")
    table(spark, sf_dir, "part").createOrReplaceTempView("_part")
    return spark.sql("select p_partkey, one_word(p_name) as ok from _part")


@query("X03_lateral_tables", "select event_id, cast(json_extract_string(props, '$.k') as bigint) as v from events")
def lateral(spark, sf_dir):
    table(spark, sf_dir, "events").createOrReplaceTempView("_events")
    return spark.sql("select event_id, cast(t.value as bigint) as v from _events, lateral variant_explode(parse_json(props)) as t where t.key = 'k'")


@query("X04_mergeable_accumulators", "select l_suppkey, count(*) as n, round(sum(l_extendedprice), 2) as total from lineitem group by 1")
def accumulators(spark, sf_dir):
    """Two levels of partial results merge to the same sums."""
    part = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_linenumber").agg(F.count("*").alias("n"), F.sum("l_extendedprice").alias("s"))
    return part.groupBy("l_suppkey").agg(F.sum("n").alias("n"), F.round(F.sum("s"), 2).alias("total"))


@query("X08_length_sorted_batches", "select p_partkey, cast(length(p_name) as double) as len from part")
def length_sorted(spark, sf_dir):
    """The model sees texts of a batch in order of length; vectors come back to their rows."""
    import numpy as np

    def model(texts: list[str]) -> np.ndarray:
        if [len(t) for t in texts] != sorted(len(t) for t in texts):
            raise ValueError("a batch is not sorted by length")
        return np.array([[len(t)] for t in texts], float)

    return embed(table(spark, sf_dir, "part"), "p_partkey", "p_name", model, 32).select("p_partkey", F.get("v", F.lit(0)).cast("double").alias("len"))


@query("X05_embedding_batches", "select doc_id, cast(coalesce(length(text), 0) as double) as len from documents")
def embedded(spark, sf_dir):
    """Batches of texts of like length come back in the order of their rows: each has its own length as vector."""
    import numpy as np

    rows = embed(table(spark, sf_dir, "documents"), "doc_id", "text", lambda texts: np.array([[len(t)] for t in texts], float), 64)
    return rows.select("doc_id", F.get("v", F.lit(0)).cast("double").alias("len"))


@query("X09_injected_model", "select doc_id, cast(length(text) % 7 as integer) as grade, cast(length(text) % 7 >= 3 as boolean) as keep from documents")
def injected(spark, sf_dir):
    """A model that is handed in scores rendered rows in batches."""
    import numpy as np

    rows = embed(table(spark, sf_dir, "documents"), "doc_id", "text", lambda texts: np.array([[len(t) % 7, len(t) % 7 >= 3] for t in texts], float))
    return rows.select("doc_id", F.get("v", F.lit(0)).cast("int").alias("grade"), (F.get("v", F.lit(1)) == 1).alias("keep"))


@query("R19_index_files", "select vec_id as id, cast(1 as bigint) as cells, (select count(*) from embeddings) as rows, cast(16 as bigint) as nlist from embeddings")
def index_files(spark, sf_dir):
    """Each row is in one cell of the files, and the manifest counts them."""
    rows, at = corpus(spark, sf_dir).select("id", "v"), folder(spark)
    ann.write_index(rows, ann.train_cells(rows, 16), at)
    manifest = ann.read_manifest(spark, at)
    found = spark.read.parquet(f"{at}/vectors").groupBy("id").agg(F.countDistinct("cell").alias("cells"))
    return found.select("id", "cells", F.lit(manifest["rows"]).cast("long").alias("rows"), F.lit(manifest["nlist"]).cast("long").alias("nlist"))


@query("R20_search_rows", "select vec_id as qid, vec_id as id, label as match_label from embeddings where vec_id % 100 = 0")
def search_rows(spark, sf_dir):
    """Each query finds itself first in its own cell."""
    rows, q = corpus(spark, sf_dir).select("id", "v"), asked(spark, sf_dir).select("qid", "v")
    c = ann.train_cells(rows, 16)
    hits = ann.ivf_search(q, ann.assign_cells(rows, c), c, 1, 1)
    return ann.with_match(hits, corpus(spark, sf_dir)).select("qid", "id", "match_label")


@query("R21_merged_indexes", "select vec_id as id, (select count(*) from embeddings) as rows from embeddings")
def merged(spark, sf_dir):
    rows, at = corpus(spark, sf_dir).select("id", "v"), folder(spark)
    c = ann.train_cells(rows, 8)
    for n in (0, 1):
        ann.write_index(rows.filter(F.col("id") % 2 == n), c, f"{at}/{n}")
    manifest = ann.merge_indexes(spark, [f"{at}/0", f"{at}/1"], f"{at}/all")
    return spark.read.parquet(f"{at}/all/vectors").select("id", F.lit(manifest["rows"]).cast("long").alias("rows"))


@query("O05_shards", "select p_partkey, (row_number() over (order by p_partkey) - 1) % 5 as shard from part")
def shards(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey")
    out = None
    for i in range(5):
        part = readers.shard(rows, [F.asc("p_partkey")], 5, i).withColumn("shard", F.lit(i).cast("long"))
        out = part if out is None else out.unionByName(part)
    return out


@query("T14_minor_units", "select ccy, v, cast(v as double) / case ccy when 'JPY' then 1 else 100 end as x from (select unnest(['EUR', 'CHF', 'JPY', 'PLN', 'CZK']) as ccy), (select unnest(range(0, 5000, 37)) as v)")
def minor_units(spark, sf_dir):
    rows = [(c, v, float(prices.decode_minor_units(v, c))) for c in ("EUR", "CHF", "JPY", "PLN", "CZK") for v in range(0, 5000, 37)]
    return spark.createDataFrame(rows, "ccy string, v long, x double")


@query("D11_prepared_cache", "select source, count(*) as n from documents where lang = 'en' group by 1")
def prepared(spark, sf_dir):
    """A prepared set is kept under a hash of its settings and read again by them."""
    config = {"lang": "en", "table": "documents", "run": uuid.uuid4().hex}
    at = f"{folder(spark)}/{hashlib.sha256(json.dumps(config, sort_keys=True).encode()).hexdigest()}"
    table(spark, sf_dir, "documents").filter(F.col("lang") == config["lang"]).write.parquet(at)
    return spark.read.parquet(at).groupBy("source").agg(F.count("*").alias("n"))


@query("K11_delimited_sink", "select r_regionkey, r_name from region")
def delimited_sink(spark, sf_dir):
    from ..sources import sinks

    at = folder(spark)
    sinks.write_tsv(table(spark, sf_dir, "region"), at)
    return spark.read.csv(at, sep="\t", header=True).select(F.col("r_regionkey").cast("long").alias("r_regionkey"), "r_name")


@query("B08_parity", "select p_partkey, p_name, 'left' as side from part where p_partkey % 50 = 0 union all select p_partkey, p_name || '?', 'right' from part where p_partkey % 50 = 0 and p_partkey % 100 <> 0")
def parity(spark, sf_dir):
    """Rows that two implementations disagree on: one renames some and loses others."""
    from ..sources import sinks

    rows = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    other = rows.filter("p_partkey % 100 <> 0").withColumn("p_name", F.when(F.col("p_partkey") % 50 == 0, F.concat("p_name", F.lit("?"))).otherwise(F.col("p_name")))
    return sinks.differences(rows, datasets.keep_first(other, ["p_partkey"], [F.asc("p_name")]))


PAIRS = "with e as (select vec_id as i, vec_id // 16 as batch, label as qid, case when vec_id % 3 = 0 then 1.0 else 0.0 end as label, list_transform(embedding, lambda x: cast(x as double)) as q, list_transform(list_reverse(embedding), lambda x: cast(x as double) + 0.0) as o from embeddings), m as (select a.batch, a.i, b.i as j, list_inner_product(a.q, list_transform(list_zip(b.q, b.o), lambda z: (z[1] + z[2]) / 2)) as s, a.qid = b.qid as same, a.label > 0.5 as anchor, b.label > 0.5 as positive from e a join e b using (batch))"


def pair_rows(spark, sf_dir):
    """Batches of 16 vectors; an offer's vector is the mean of a vector and its reverse."""
    both = F.zip_with("q", F.reverse("q"), lambda a, b: (a + b) / 2)
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("i"), F.floor(F.col("vec_id") / 16).alias("batch"), F.col("label").alias("qid"), F.when(F.col("vec_id") % 3 == 0, 1.0).otherwise(0.0).alias("label"), F.transform("embedding", lambda x: x.cast("double")).alias("q"))
    return rows.withColumn("o", both)


@query("D16_binary_loss", f"{PAIRS} select round(avg((greatest(s * 4, 0) - case when positive then s * 4 else 0 end + ln(1 + exp(-abs(s * 4)))) * case when positive then 2.0 else 0.5 end), 6) as loss from m where i = j")
def binary_loss(spark, sf_dir):
    rows = losses.batch_scores(pair_rows(spark, sf_dir)).filter("i = j").select(F.col("s").alias("score"), F.col("positive").cast("double").alias("label"))
    return losses.binary(rows, 4.0, 2.0, 0.5).select(F.round("loss", 6).alias("loss"))


@query("D16_contrastive_loss", f"{PAIRS}, x as (select batch, i, sum(exp(s * 5)) as everything, sum(exp(s * 5)) filter (where same and positive) as own from m group by 1, 2) select batch, round(coalesce(avg(-ln(own / everything)), 0), 6) as loss from x group by 1")
def contrastive_loss(spark, sf_dir):
    return losses.contrastive(pair_rows(spark, sf_dir), 5.0).select("batch", F.round("loss", 6).alias("loss"))


@query("D16_triplet_loss", f"""{PAIRS}, p as (select batch, i, s as p from m where i = j), n as (select m.*, p, case when same and not positive then 'near' when not same then 'far' end as pool from m join p using (batch, i) where anchor),
g as (select batch, i, p, max(s) filter (where pool = 'near') as a, max(s) filter (where pool = 'near' and s < p) as au, max(s) filter (where pool = 'far') as f, max(s) filter (where pool = 'far' and s < p) as fu from n where pool is not null group by 1, 2, 3),
t as (select *, case when a is not null then a else f end as top, case when a is not null then au else fu end as under from g), b as (select distinct batch from e)
select b.batch, round(coalesce(avg(greatest(0, coalesce(under, top) - p + 0.2)), 0), 6) as loss, count(t.i) as anchors, count(t.i) filter (where under is null) as fallbacks from b left join t on t.batch = b.batch group by 1""")
def triplet_loss(spark, sf_dir):
    return losses.triplet(pair_rows(spark, sf_dir), 0.2).select("batch", F.round("loss", 6).alias("loss"), "anchors", "fallbacks")


@query("D16_distillation_loss", f"{PAIRS}, x as (select i, j, s / 0.5 as a, (case when same then 1.0 else 0.0 end) / 0.5 as b from m), l as (select *, a - ln(sum(exp(a)) over (partition by i)) as la, b - ln(sum(exp(b)) over (partition by i)) as lb from x), k as (select i, sum(exp(lb) * (lb - la)) as kl from l group by 1) select round(avg(kl) * 0.25, 6) as loss from k")
def distillation_loss(spark, sf_dir):
    rows = losses.batch_scores(pair_rows(spark, sf_dir)).select(F.col("i").alias("qid"), F.col("s").alias("student"), F.col("same").cast("double").alias("teacher"))
    return losses.distillation(rows, 0.5).select(F.round("loss", 6).alias("loss"))


@query("B03_legacy_articles", f"""with x as (select l_orderkey * 10 + l_linenumber as rank, md5(cast(l_suppkey as varchar)) as h, rtrim(replace(replace(to_base64(encode(l_partkey || '.' || l_returnflag)), '+', '-'), '/', '_'), '=') as b from lineitem), y as (select *, {N62_SQL} as n from x),
z as (select rank, {D62_SQL} || ':' || b as a from y) select a as "articleId", min(rank) as rank, 'N/A' as explanation from z group by 1""")
def legacy_articles(spark, sf_dir):
    """Offers of several catalog versions become one legacy article each, at the place of the first."""
    u = lambda c: ids.uuid_str(F.base64(F.unhex(F.md5(F.col(c).cast("string")))))
    number = F.concat_ws(".", F.col("l_partkey").cast("string"), "l_returnflag")
    hits = table(spark, sf_dir, "lineitem").select(F.concat_ws(":", u("l_suppkey"), number, u("l_orderkey")).alias("id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("rank"))
    return search.to_legacy(hits, explain=True)


@query("X07_rendered_tokens", "select p_partkey, list_sum(list_transform(string_split(p_name || chr(10) || 'Brand: ' || p_brand, ' '), lambda w: length(w))) as chars, len(string_split_regex(p_name || chr(10) || 'Brand: ' || p_brand, '\\s+')) as tokens from part")
def rendered_tokens(spark, sf_dir):
    """Rows are rendered by columns and encoded in the worker processes."""
    from ..functions.text import render

    rows = table(spark, sf_dir, "part").withColumn("t", render([("", F.col("p_name")), ("Brand: ", F.col("p_brand"))]))
    return encoded(rows, "p_partkey", "t", lambda texts: [[len(w) for w in t.split()] for t in texts]).select(
        "p_partkey", (F.aggregate("tokens", F.lit(0).cast("long"), lambda a, x: a + x) + 1).alias("chars"), F.size("tokens").cast("long").alias("tokens")
    )


@query("K12_clustered_sink", "select p_partkey, p_type from part where p_brand = 'Brand#3'")
def clustered_sink(spark, sf_dir):
    """A bulk load sorted by its look-up key, with a filter per file, instead of an index that is dropped and built again."""
    from ..sources import sinks

    at = folder(spark)
    sinks.write_clustered(table(spark, sf_dir, "part"), at, ["p_brand"])
    return spark.read.parquet(at).filter("p_brand = 'Brand#3'").select("p_partkey", "p_type")


@query("K07_manifest", "select p_partkey, (select count(*) from part) as rows, 'test' as purpose from part")
def manifest(spark, sf_dir):
    from ..sources import sinks

    at = folder(spark)
    sinks.write_with_manifest(table(spark, sf_dir, "part").select("p_partkey"), at, {"purpose": "test"})
    rows, told = sinks.read_with_manifest(spark, at)
    return rows.select("p_partkey", F.lit(told["rows"]).cast("long").alias("rows"), F.lit(told["settings"]["purpose"]).alias("purpose"))


@query("K06_staged_upload", "select p_partkey, 1 as times from part")
def staged_upload(spark, sf_dir):
    """Files of a bulk load are handed over a few at a time; a second run begins behind what was done."""
    from ..sources import sinks

    at = folder(spark)
    sinks.write_chunks(table(spark, sf_dir, "part").select("p_partkey"), f"{at}/staged", 300)
    files = [f for f, _ in readers.list_files(spark, f"{at}/staged/*.parquet")]
    taken: list[str] = []

    def submit(path: str) -> str:
        if len(taken) == 3 and "again" not in taken:
            taken.append("again")
            raise ConnectionError
        taken.append(path)
        return path

    while True:
        try:
            sinks.upload(spark, files, f"{at}/state", submit, lambda job: "done", 1)
            break
        except ConnectionError:
            pass
    rows = spark.read.parquet(*[t for t in taken if t != "again"])
    return rows.groupBy("p_partkey").agg(F.count("*").cast("int").alias("times"))


@query("K09_bulk_statuses", "select p_partkey, case when p_partkey % 7 = 0 then 400 else 200 end as status from part")
def bulk_statuses(spark, sf_dir):
    """A service that turns half of each batch away for load takes it after waits; bad documents stay failed."""
    from ..sources import sinks

    def send(documents: list[dict]) -> list[int]:
        late = len(documents) > 40
        return [429 if late and i >= 40 else 400 if d["p_partkey"] % 7 == 0 else 200 for i, d in enumerate(documents)]

    return sinks.bulk_index(table(spark, sf_dir, "part").select("p_partkey"), "p_partkey", send, 100, 5, 0.0)


@query("S12_sliced_scroll", "select unnest(range(0, 500)) as id, 7 as pages")
def sliced_scroll(spark, sf_dir):
    """500 documents in seven slices, paged by twenty."""

    def fetch(part: int, slices: int, after):
        have = [i for i in range(500) if i % slices == part and (after is None or i > after)][:20]
        return [{"id": i} for i in have], have[-1] if have else after

    return readers.scroll(spark, fetch, "id long", 7).select("id", F.lit(7).alias("pages"))


@query("S14_key_values", "select p_partkey, cast(p_partkey % 2048 as real) as first from part where p_partkey % 5 <> 0")
def key_values(spark, sf_dir):
    """Half-precision vectors of a key-value store; keys without one are left out."""
    import numpy as np

    def fetch(keys: list) -> list:
        return [None if k % 5 == 0 else np.array([k % 2048, 1], "<f2").tobytes() for k in keys]

    return readers.key_values(spark, table(spark, sf_dir, "part").select("p_partkey"), "p_partkey", fetch, 2).select("p_partkey", F.get("v", F.lit(0)).alias("first"))
