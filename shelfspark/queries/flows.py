"""Queries of scans, sinks and streams: each writes, reads back or streams, and gives rows."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import ids, vectors
from ..operators import datasets
from ..plans import materialise
from ..session import scratch, table
from ..sources import readers, sinks
from ..streaming import incremental
from . import query
from .scalars import HASH_SQL, raw_collections, uuid_sql


def folder(spark) -> str:
    return f"{scratch(spark)}/flow-{uuid.uuid4().hex}"


@query("S01_ndjson_scan", f"select cast(l_partkey as varchar) as number, {uuid_sql('md5(cast(l_suppkey as varchar))')} as vendor, count(*) as n, cast(sum(floor(l_extendedprice) / 2.0) as double) as total from lineitem where l_linenumber = 2 group by 1, 2")
def ndjson(spark, sf_dir):
    at = folder(spark)
    raw_collections(spark, sf_dir)["pricings"].write.option("compression", "gzip").json(at)
    rows = readers.read_ndjson(spark, at, materialise.PRICING_SCHEMA).filter("pricingDetails.type = 'CLOSED'")
    price = F.get("pricingDetails.prices.staggeredPrices", F.lit(0))["price"].cast("double")
    return rows.groupBy(F.col("articleNumber").alias("number"), ids.uuid_str(F.col("vendorId")).alias("vendor")).agg(F.count("*").alias("n"), F.sum(price).alias("total"))


WRAPPED_RECORDS = 1000


@query("S02_wrapped_scan", """select cast(l_partkey as varchar) as number, count(*) as offers, cast(sum(n) as bigint) as pricings from (select l_partkey, l_suppkey, count(*) as k from lineitem where l_linenumber = 1 group by 1, 2) o
 left join (select l_partkey, l_suppkey, count(*) as n from lineitem where l_linenumber = 2 group by 1, 2) p using (l_partkey, l_suppkey) group by 1""".replace("count(*) as offers, cast(sum(n) as bigint)", "cast(sum(k) as bigint) as offers, cast(sum(k * coalesce(n, 0)) as bigint)"))
def wrapped(spark, sf_dir):
    """All offers, each with the prices of its article, in files of at most WRAPPED_RECORDS records, counted by article."""
    at = folder(spark)
    c = raw_collections(spark, sf_dir)
    key = ["articleNumber", "vendorId"]
    prices = c["pricings"].groupBy(*key).agg(F.collect_list(F.struct(*(F.col(x) for x in c["pricings"].columns))).alias("pricings"))
    offers = c["offers"].select(*key, F.struct("*").alias("offer")).join(prices, key, "left")
    rows = datasets.row_ids(offers, [F.asc(x) for x in key], "n").withColumn("file", F.floor((F.col("n") - 1) / WRAPPED_RECORDS))
    rows.groupBy("file").agg(F.collect_list(F.struct("offer", "pricings")).alias("records")).write.partitionBy("file").json(at)
    got = readers.read_wrapped(spark, at)
    count = lambda side, name: got[side].groupBy(F.col("articleNumber").alias("number")).agg(F.count("*").alias(name))
    return count("offers", "offers").join(count("pricings", "pricings"), "number", "left").select("number", "offers", F.coalesce("pricings", F.lit(0)).cast("long").alias("pricings"))


@query("S03_parquet_scan", "select r_regionkey, r_name from region")
def parquet(spark, sf_dir):
    return table(spark, sf_dir, "region")


@query("S04_partitioned_scan", "select p_type, count(*) as n from part where p_type in ('ECONOMY', 'PROMO') group by 1")
def partitioned(spark, sf_dir):
    at = folder(spark)
    table(spark, sf_dir, "part").write.partitionBy("p_type").parquet(at)
    return spark.read.parquet(at).filter(F.col("p_type").isin("ECONOMY", "PROMO")).groupBy("p_type").agg(F.count("*").alias("n"))


@query("S06_batches", "select p_partkey, p_size * 2 as twice from part")
def batches(spark, sf_dir):
    import pyarrow as pa
    import pyarrow.compute as pc

    def run(parts):
        for b in parts:
            yield pa.RecordBatch.from_arrays([b.column("p_partkey"), pc.multiply(b.column("p_size").cast(pa.int64()), 2)], names=["p_partkey", "twice"])

    return table(spark, sf_dir, "part").select("p_partkey", "p_size").mapInArrow(run, "p_partkey long, twice long")


@query("S07_ordered_head", "select p_partkey, p_name from part order by p_partkey limit 17")
def head(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_name").withColumn("_rn", F.lit(1))
    return readers.head(rows, ["p_partkey"], 17)


@query("S08_lines_with_file", "select item_id, text, item_id % 3 as kind, true as named from benchmark")
def lines(spark, sf_dir):
    at = folder(spark)
    for k in range(3):
        table(spark, sf_dir, "benchmark").filter(F.col("item_id") % 3 == k).write.json(f"{at}/kind{k}")
    rows = readers.read_jsonl_with_file(spark, f"{at}/kind*/*.json", "item_id long, text string")
    return rows.select("item_id", "text", F.regexp_extract("filename", r"/kind(\d)/", 1).cast("long").alias("kind"), F.col("filename").endswith(".json").alias("named"))


@query("S09_delimited_scan", "select p_partkey, p_name from part")
def delimited(spark, sf_dir):
    at = folder(spark)
    sinks.write_tsv(table(spark, sf_dir, "part").select("p_partkey", "p_name"), at)
    return readers.read_tsv(spark, at, "p_partkey long, p_name string")


@query("S11_arrow_relation", "select n_nationkey, n_name from nation")
def arrow(spark, sf_dir):
    return spark.createDataFrame(table(spark, sf_dir, "nation").select("n_nationkey", "n_name").toArrow())


@query("S13_event_rollup", "select event_type, count(*) as n, count(distinct user_id) as users from events where ts >= timestamp '2024-01-10' group by 1")
def event_rollup(spark, sf_dir):
    rows = table(spark, sf_dir, "events").filter(F.col("ts") >= F.to_timestamp_ntz(F.lit("2024-01-10 00:00:00")))
    return rows.groupBy("event_type").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"))


@query("S15_resume", "select p_partkey from part where p_partkey % 4 <> 0")
def resume(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey")
    return p.join(p.filter("p_partkey % 4 = 0"), "p_partkey", "left_anti")


@query("K01_parquet_sink", "select cast(sum(p_size) as bigint) as s, count(*) as n from part")
def parquet_sink(spark, sf_dir):
    at = folder(spark)
    sinks.write_chunks(table(spark, sf_dir, "part"), at, 500)
    return spark.read.parquet(at).agg(F.sum("p_size").alias("s"), F.count("*").alias("n"))


@query("K02_rows_per_file", "with n as (select count(*) as n from part) select least(500, n - 500 * i) as rows, count(*) as files from n, unnest(range(0, (n + 499) // 500)) as u(i) group by 1")
def rows_per_file(spark, sf_dir):
    at = folder(spark)
    sinks.write_chunks(table(spark, sf_dir, "part").coalesce(1), at, 500)
    return spark.read.parquet(at).groupBy(F.input_file_name().alias("f")).agg(F.count("*").alias("rows")).groupBy("rows").agg(F.count("*").alias("files"))


@query("K03_sized_files", "select p_partkey, p_name from part")
def sized(spark, sf_dir):
    at = folder(spark)
    sinks.write_sized(table(spark, sf_dir, "part"), at, 1 << 20)
    return spark.read.parquet(at).select("p_partkey", "p_name")


@query("K04_encoded_rows", f"""with o as (select l_partkey as pk, l_suppkey as sk, l_orderkey as ok, l_returnflag as f, floor(l_extendedprice) / 4.0 as p from lineitem where l_linenumber = 1),
x as (select pk, f, p from o union all select o.pk, c.l_returnflag, floor(c.l_extendedprice) / 2.0 from o join lineitem c on c.l_linenumber = 2 and c.l_partkey = o.pk and c.l_suppkey = o.sk), low as (select pk, min(p) filter (where f = 'A') as low from x group by 1),
c as (select pk, 'c' || p_size as value, md5(cast(ok as varchar)) as h from o join part on pk = p_partkey union select o.pk, 'k' || (c.l_orderkey % 3), md5(cast(c.l_orderkey % 20 as varchar)) from o join lineitem c on c.l_linenumber = 4 and c.l_partkey = o.pk and c.l_suppkey = o.sk),
v as (select pk, value, string_agg('"' || {uuid_sql("h")} || '"', ',' order by {uuid_sql("h")}) as ids from c group by 1, 2),
n as (select pk, '[' || string_agg('{{"value":"' || value || '","version_ids":[' || ids || ']}}', ',' order by value) || ']' as customer_article_numbers from v group by 1)
select {HASH_SQL} as article_hash, customer_article_numbers, cast(coalesce(low, 3.4028234e38) as real) as eur_price_min from n join low using (pk) join part on pk = p_partkey""")
def encoded(spark, sf_dir):
    from .scalars import flat

    return sinks.encode_articles(materialise.article_table(flat(spark, sf_dir))).select("article_hash", "customer_article_numbers", "eur_price_min")


@query("K05_upsert", "select p_partkey, case when p_partkey % 3 = 0 then 2 else 1 end as v from part")
def upsert(spark, sf_dir):
    old = table(spark, sf_dir, "part").select("p_partkey", F.lit(1).alias("v"))
    return sinks.upserted(old, old.filter("p_partkey % 3 = 0").withColumn("v", F.lit(2)), "p_partkey", "v")


@query("K10_checked_publish", "select p_partkey as article_hash, count(l_partkey) as offers, true as refused from part left join lineitem on l_partkey = p_partkey group by 1")
def publish(spark, sf_dir):
    at = folder(spark)
    table(spark, sf_dir, "part").select(F.col("p_partkey").alias("article_hash")).write.parquet(f"{at}/a")
    table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("article_hash")).write.parquet(f"{at}/o")
    table(spark, sf_dir, "part").limit(0).select(F.col("p_partkey").alias("article_hash")).write.parquet(f"{at}/none")
    sinks.publish(spark, f"{at}/a", f"{at}/o", f"{at}/now")
    try:  # offers without articles are refused, and readers stay with what was published before
        sinks.publish(spark, f"{at}/none", f"{at}/o", f"{at}/now")
        refused = False
    except ValueError:
        refused = True
    a, o = sinks.published(spark, f"{at}/now")
    n = o.groupBy("article_hash").agg(F.count("*").alias("offers"))
    return a.join(n, "article_hash", "left").select("article_hash", F.coalesce("offers", F.lit(0)).cast("long").alias("offers"), F.lit(refused).alias("refused"))


@query("ST05_orphans", "select p_partkey as article_hash from part where p_partkey not in (select l_partkey from lineitem where l_quantity > 45)")
def orphans(spark, sf_dir):
    a = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("article_hash"))
    return sinks.orphans(a, table(spark, sf_dir, "lineitem").filter("l_quantity > 45").select(F.col("l_partkey").alias("article_hash")))


@query("B09_twin_differences", "select p_partkey, 'left' as side from part where p_partkey % 100 = 0")
def twins(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey")
    return sinks.differences(p, p.filter("p_partkey % 100 <> 0"))


def events(spark, sf_dir):
    at = folder(spark)
    spark.read.parquet(f"{sf_dir}/events.parquet").write.parquet(at)  # in the order of the files, as a stream comes
    return incremental.event_stream(spark, at, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string")


@query("ST_tumbling_windows", "select time_bucket(interval '6 hours', ts) as start, event_type, count(*) as n, round(sum(value), 4) as total from events group by 1, 2")
def tumbling(spark, sf_dir):
    out = incremental.drain(incremental.tumbling(events(spark, sf_dir), "6 hours", late=None), f"t{uuid.uuid4().hex}")
    return out.withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("ST_sliding_windows", "with w as (select time_bucket(interval '1 hour', ts) - to_hours(k) as start from events, range(0, 3) r(k)) select start, count(*) as n from w group by 1")
def sliding(spark, sf_dir):
    out = incremental.drain(incremental.sliding(events(spark, sf_dir), "3 hours", "1 hour", late=None), f"t{uuid.uuid4().hex}")
    return out.withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("ST_sessions", "with g as (select user_id, ts, case when ts >= lag(ts) over w + interval '2 hours' or lag(ts) over w is null then 1 else 0 end as new from events window w as (partition by user_id order by ts)), s as (select *, sum(new) over (partition by user_id order by ts rows unbounded preceding) as k from g) select user_id, min(ts) as start, count(*) as n from s group by user_id, k")
def sessions(spark, sf_dir):
    out = incremental.drain(incremental.sessions(events(spark, sf_dir), "2 hours", late=None), f"t{uuid.uuid4().hex}", "complete")
    return out.withColumn("start", F.col("start").cast("timestamp_ntz"))


def change_rows(spark, sf_dir):
    """Offers with versions: line 1 creates, line 2 moves to another article, line 3 deletes."""
    li = table(spark, sf_dir, "lineitem").filter("l_linenumber <= 3").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("p"))
    return li.select(F.col("l_orderkey").alias("id"), F.col("p").alias("article_hash"), F.col("l_linenumber").cast("long").alias("version"), (F.col("l_linenumber") == 3).alias("deleted"))


LATEST = "with c as (select l_orderkey as id, l_linenumber as v, min(l_partkey) as p from lineitem where l_linenumber <= 3 group by 1, 2), l as (select id, arg_max(p, v) as article_hash, max(v) as v from c group by 1)"


@query("ST02_latest_state", f"{LATEST} select id, article_hash from l where v < 3")
def latest(spark, sf_dir):
    return incremental.latest(change_rows(spark, sf_dir)).filter("not deleted").select("id", "article_hash")


def _changes(spark, sf_dir, at):
    """Folder of change files, one a version, and the first state."""
    rows = change_rows(spark, sf_dir)
    for v in (2, 3):  # one file a batch, so that each is a micro-batch
        rows.filter(F.col("version") == v).coalesce(1).write.mode("append").parquet(f"{at}/changes")
    return rows.filter("version = 1").drop("deleted")


def _tables(spark, at):
    return incremental.Tables(spark, f"{at}/tables", lambda o: o.groupBy("article_hash").agg(F.count("*").alias("n")))


CHANGE = "id long, article_hash long, version long, deleted boolean"


@query("ST01_incremental_tables", f"{LATEST} select article_hash, count(*) as n from l where v < 3 group by 1")
def incremental_tables(spark, sf_dir):
    at = folder(spark)
    first, tables = _changes(spark, sf_dir, at), _tables(spark, at)
    tables.start(first)
    stream = incremental.event_stream(spark, f"{at}/changes", CHANGE)
    incremental.run_changes(stream, tables, f"{at}/offsets", once=True).awaitTermination()
    tables.flush()
    return tables.read("articles")


@query("ST07_restart", f"{LATEST} select article_hash, count(*) as n, list_sort(list(id))[1] as least from l where v < 3 group by 1")
def restart(spark, sf_dir):
    """A process that applies one batch, loses the flush of the next and goes; another one goes on from what is durable, and replays."""
    at = folder(spark)
    first = _changes(spark, sf_dir, at)
    rows = change_rows(spark, sf_dir)
    gone = _tables(spark, at)
    gone.start(first)
    gone.upsert(rows.filter("version = 2"), 0)
    gone.take(rows.filter("version = 3"), 1)  # taken, but not yet flushed when the process ends
    again = _tables(spark, at)
    again.upsert(rows.filter("version = 2"), 0)  # replayed: it was applied before
    again.take(rows.filter("version = 3"), 1)
    again.flush()
    offers = again.read("offers").groupBy("article_hash").agg(F.min("id").alias("least"))
    return again.read("articles").join(offers, "article_hash").select("article_hash", "n", "least")


@query("ST03_dirty_flushes", "with c as (select l_orderkey as id, l_linenumber as v, min(l_partkey) as p from lineitem where l_linenumber in (1, 2) group by 1, 2), k as (select c1.p as a, c2.p as b from (select * from c where v = 2) c2 left join (select * from c where v = 1) c1 using (id)) select cast(4 as bigint) as batches, count(distinct x) as dirty from (select a as x from k union all select b from k)")
def dirty_flushes(spark, sf_dir):
    """Four batches of moves: dirty articles are collected over batches, each once, and flushed together at the bound of keys."""
    at = folder(spark)
    rows = change_rows(spark, sf_dir)
    tables = _tables(spark, at)
    tables.start(rows.filter("version = 1").drop("deleted"))
    moves = rows.filter("version = 2")
    for b in range(4):
        tables.take(moves.filter(F.col("id") % 4 == b), b)
    pending = tables.pending()
    flushed = tables.flush()
    return spark.createDataFrame([(pending["batches"], flushed)], "batches long, dirty long")


@query("ST04_dirty_keys", "with o as (select l_orderkey as id, min(l_partkey) as p from lineitem where l_linenumber = 1 group by 1), c as (select l_orderkey as id, min(l_partkey) as p from lineitem where l_linenumber = 2 group by 1) select p as article_hash from o where id in (select id from c) union select p from c")
def dirty(spark, sf_dir):
    rows = change_rows(spark, sf_dir)
    return incremental.dirty_keys(rows.filter("version = 1"), rows.filter("version = 2"))


@query("ST06_dead_letters", "select count(*) filter (where event_id % 10 <> 0) as good, count(*) filter (where event_id % 10 = 0) as bad from events")
def dead_letters(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    body = F.when(F.col("event_id") % 10 == 0, F.lit("{broken")).otherwise(F.concat(F.lit('{"id": '), F.col("event_id").cast("string"), F.lit("}")))
    good, bad = incremental.split_bad(e.select(body.alias("payload")), "id long")
    return good.agg(F.count("*").alias("good")).crossJoin(bad.agg(F.count("*").alias("bad")))


@query("ST03_running_state", "select user_id, count(*) as n, round(sum(value), 4) as total from events group by 1")
def running(spark, sf_dir):
    stream = incremental.running_state(events(spark, sf_dir).select("user_id", "value"))
    out = incremental.drain(stream, f"t{uuid.uuid4().hex}", "update")
    last = out.groupBy("user_id").agg(F.max_by(F.struct("n", "total"), "n").alias("x"))
    return last.select("user_id", "x.n", F.round("x.total", 4).alias("total"))


@query("ST07_once_only_events", "select event_id, 1 as n from events")
def once_only(spark, sf_dir):
    at = folder(spark)
    e = table(spark, sf_dir, "events")
    e.unionByName(e.filter("event_id % 2 = 0")).coalesce(1).write.parquet(at)
    stream = incremental.event_stream(spark, at, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string")
    out = incremental.drain(incremental.distinct_events(stream, late="400 days").select("event_id"), f"t{uuid.uuid4().hex}", "append")
    return out.groupBy("event_id").agg(F.count("*").cast("int").alias("n"))


@query("X06_stub_embeddings", "select md5(text) as h, count(*) as n, cast(1 as bigint) as vectors, 8 as dim, 1.0 as norm from documents group by 1")
def stub(spark, sf_dir):
    from ..operators.embedding import embed, stub_vectors

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = embed(docs, "doc_id", "text", stub_vectors(8)).join(docs, "doc_id").groupBy(F.md5("text").alias("h"))
    return rows.agg(F.count("*").alias("n"), F.countDistinct("v").alias("vectors"), F.max(F.size("v")).alias("dim"), F.round(F.max(vectors.norm(F.transform("v", lambda x: x.cast("double")))), 5).alias("norm"))
