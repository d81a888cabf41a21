"""Queries of scalar functions, materialisation and predicates over identifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import identifiers, ids, prices, taxonomy, text, vectors
from ..plans import materialise
from ..session import table
from . import query

UUID_SQL = "lower(substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-' || substr(h, 21, 12))"


@query("T01_uuid_of_base64", f"with x as (select p_partkey, md5(p_name || p_partkey) as h from part) select p_partkey, {UUID_SQL} as u from x")
def uuid_of_base64(spark, sf_dir):
    b64 = F.base64(F.unhex(F.md5(F.concat("p_name", F.col("p_partkey").cast("string")))))
    return table(spark, sf_dir, "part").select("p_partkey", ids.uuid_str(b64).alias("u"))


@query("T02_base64url", "select doc_id, rtrim(replace(replace(to_base64(encode(text)), '+', '-'), '/', '_'), '=') as b from documents")
def base64url(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", ids.b64url_no_pad(F.col("text")).alias("b"))


@query("T03_category_path", "select p_partkey, replace(p_name, 'a', '|') || '¦' || p_type as path from part")
def category_path(spark, sf_dir):
    elements = F.array(F.replace("p_name", F.lit("a"), F.lit("¦")), "p_type")
    return table(spark, sf_dir, "part").select("p_partkey", ids.encode_path(elements).alias("path"))


@query("T04_ordered_distinct", "select o_orderkey, case when o_orderstatus = 'F' then 'F,P' else 'F,' || o_orderstatus || case when o_orderstatus = 'P' then '' else ',P' end end as xs from orders")
def ordered_distinct(spark, sf_dir):
    xs = F.array_distinct(F.array(F.lit("F"), F.col("o_orderstatus"), F.lit("F"), F.lit("P")))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(xs, ",").alias("xs"))


def _details() -> F.Column:
    step = lambda q, p: F.struct(q.cast("string").alias("minQuantity"), p.alias("price"))
    price = F.format_string("%.2f", F.floor("l_extendedprice") / 4.0)
    steps = F.array(
        step(F.lit(10), F.lit("99.5")),
        step(F.col("l_linenumber"), F.when(F.col("l_linenumber") % 3 != 0, price)),
        step(F.lit(5), F.lit("7.25")),
    )
    return F.struct(
        F.lit(None).cast("string").alias("sourcePriceListId"),
        F.when(F.col("l_linenumber") % 2 == 0, "CLOSED").alias("type"),
        F.struct(steps.alias("staggeredPrices"), F.lit("EUR").alias("currencyCode")).alias("prices"),
        F.lit(False).alias("dailyPrice"),
        F.when(F.col("l_returnflag") == "A", "0").when(F.col("l_returnflag") == "N", "4").alias("priceQuantity"),
    )


PRICE_SQL = """case when l_linenumber % 3 <> 0 and l_linenumber < 5 then floor(l_extendedprice) / 4.0
  when l_linenumber % 3 <> 0 and l_linenumber = 5 then least(7.25, floor(l_extendedprice) / 4.0) else 7.25 end / case l_returnflag when 'N' then 4 else 1 end"""


@query("T05_single_unit_price", f"select l_orderkey, l_partkey, l_linenumber, round({PRICE_SQL}, 4) as price from lineitem")
def unit_price(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").withColumn("d", _details())
    return rows.select("l_orderkey", "l_partkey", "l_linenumber", F.round(prices.single_unit_price(F.col("d")).cast("double"), 4).alias("price"))


@query("T06_pricing_priority", "select o_orderkey, case o_orderpriority when '1-URGENT' then 2 when '2-HIGH' then 3 when '3-MEDIUM' then 4 else 1 end as p from orders")
def priority(spark, sf_dir):
    kind = F.when(F.col("o_orderpriority") == "1-URGENT", "CLOSED").when(F.col("o_orderpriority") == "2-HIGH", "GROUP").when(F.col("o_orderpriority") == "3-MEDIUM", "DEDICATED").when(F.col("o_orderpriority") == "5-LOW", "OTHER")
    return table(spark, sf_dir, "orders").select("o_orderkey", prices.pricing_priority(kind).alias("p"))


@query("T07_price_entry", f"select l_orderkey, l_partkey, l_linenumber, round({PRICE_SQL}, 4) as price, 'EUR' as currency, case when l_linenumber % 2 = 0 then 2 else 1 end as priority, '' as list from lineitem")
def entry(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").withColumn("e", prices.project_pricing(_details()))
    return rows.select("l_orderkey", "l_partkey", "l_linenumber", F.round("e.price", 4).alias("price"), "e.currency", "e.priority", F.col("e.sourcePriceListId").alias("list"))


@query("T08_unwrap_int", "select event_id, case event_id % 4 when 3 then null else cast(json_extract_string(props, '$.k') as bigint) end as k from events")
def unwrap(spark, sf_dir):
    k = F.get_json_object("props", "$.k")
    kind = F.col("event_id") % 4
    json = F.when(kind == 0, k).when(kind == 1, F.concat(F.lit('{"$numberInt": "'), k, F.lit('"}'))).when(kind == 2, F.concat(F.lit('{"$numberLong": "'), k, F.lit('"}'))).otherwise(F.lit('{"x": 1}'))
    return table(spark, sf_dir, "events").select("event_id", taxonomy.unwrap_int(json).alias("k"))


@query("T09_expand_code", """with x as (select p_partkey, p_size * 1000000 + p_partkey % 100 * 10000 + p_partkey % 3 as c from part)
select p_partkey, array_to_string(list_filter([c // 1000000 * 1000000, c // 10000 * 10000, c // 100 * 100, c], lambda v: v > 0), ',') as codes from x""")
def expand(spark, sf_dir):
    code = F.col("p_size") * 1_000_000 + F.col("p_partkey") % 100 * 10_000 + F.col("p_partkey") % 3
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(taxonomy.expand_code(code.cast("int")), ",").alias("codes"))


@query("T10_article_hash", """select p_partkey, substr(sha256(encode(p_name) || '\\x00'::blob || encode(p_brand) || '\\x00'::blob || '\\x00'::blob
 || encode(least(p_type || '¦x', 'M¦b') || chr(30) || greatest(p_type || '¦x', 'M¦b')) || '\\x00'::blob || '\\x00'::blob || encode(cast(p_partkey as varchar)) || '\\x00'::blob || '\\x00'::blob), 1, 32) as h from part""")
def article_hash(spark, sf_dir):
    none = F.lit(None).cast("string")
    paths = F.array(F.struct(F.array(F.col("p_type"), F.lit("x")).alias("elements")), F.struct(F.array(F.lit("M"), F.lit("b")).alias("elements")), F.struct(F.array().cast("array<string>").alias("elements")))
    h = ids.article_hash(F.col("p_name"), F.col("p_brand"), none, paths, none, F.col("p_partkey").cast("string"), none, none)
    return table(spark, sf_dir, "part").select("p_partkey", h.alias("h"))


@query("T11_feature_tokens", "select p_partkey, 'type=' || p_type || ',size=' || p_size as f from part")
def tokens(spark, sf_dir):
    f = lambda n, *v: F.struct(F.lit(n).alias("name"), F.array(*v).alias("values"))
    features = F.array(f("type", F.col("p_type"), F.concat("p_type", F.lit("=x"))), f("size", F.col("p_size").cast("string"), F.lit("a=b")))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(taxonomy.feature_tokens(features), ",").alias("f"))


@query("T17_path_prefix", "select p_partkey, (p_type = 'ECONOMY' or starts_with(p_type || '¦' || p_name, 'ECONOMY¦')) as hit, len(string_split(p_type || '¦' || p_name, '¦')) as parts from part")
def path_prefix(spark, sf_dir):
    path = F.concat_ws("¦", "p_type", "p_name")
    return table(spark, sf_dir, "part").select("p_partkey", taxonomy.starts_with_path(path, "ECONOMY").alias("hit"), F.size(taxonomy.split_path(path)).cast("long").alias("parts"))


@query("T18_base62_round_trip", f"with x as (select p_partkey, md5(p_name || p_partkey) as h from part) select p_partkey, {UUID_SQL} as u, cast(22 as bigint) as n from x")
def base62(spark, sf_dir):
    u = ids.uuid_str(F.base64(F.unhex(F.md5(F.concat("p_name", F.col("p_partkey").cast("string"))))))
    rows = table(spark, sf_dir, "part").select("p_partkey", ids.friendly_id(u).alias("f"))
    return rows.select("p_partkey", ids.uuid_of_friendly("f").alias("u"), F.length("f").cast("long").alias("n"))


_B62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
N62_SQL = "list_reduce(list_transform(range(1, 33), lambda i: (instr('0123456789abcdef', substr(h, i, 1)) - 1)::uhugeint), lambda a, d: a * 16 + d)"
D62_SQL = "array_to_string(list_transform([" + ", ".join(f"'{62**i}'::uhugeint" for i in range(21, -1, -1)) + f"], lambda w: substr('{_B62}', ((n // w) % 62)::integer + 1, 1)), '')"


@query("T19_legacy_ids", f"""with x as (select p_partkey, md5(cast(p_partkey as varchar)) as h, rtrim(replace(replace(to_base64(encode(p_name)), '+', '-'), '/', '_'), '=') as b from part), y as (select *, {N62_SQL} as n from x), z as (select *, {D62_SQL} as d from y)
select p_partkey, d || ':' || b as legacy, ltrim(d, '0') || ':' || b as sort_key from z""")
def legacy_ids(spark, sf_dir):
    u = ids.uuid_str(F.base64(F.unhex(F.md5(F.col("p_partkey").cast("string")))))
    key = ids.offer_key(u, F.col("p_name"), u)
    return table(spark, sf_dir, "part").select("p_partkey", ids.legacy_offer_id(key).alias("legacy"), ids.legacy_sort_key(key).alias("sort_key"))


@query("T20_s2class", """with x as (select p_partkey, p_size, p_size % 4 as m from part)
select p_partkey, case when m = 0 then '90000000,90900000,90909000,90909090' when p_size <= 25 and m = 1 then '21000000,21040000,21040100' when m = 2 then '23000000,23010000' else '90000000,90900000,90909000,90909090' end as codes from x""")
def s2class(spark, sf_dir):
    m = F.col("p_size") % 4
    codes = lambda v: F.array(F.lit(v))
    none = F.array().cast("array<int>")
    high = F.when((m == 1) & (F.col("p_size") <= 25), codes(11)).when(m == 2, codes(12)).when(m == 3, codes(99)).when(m == 1, codes(98)).otherwise(none)
    mapping = F.create_map(F.lit("v8/11"), F.array(F.lit(21_040_100)), F.lit("v8/12"), F.array(F.lit(23_010_000)), F.lit("v5/11"), F.array(F.lit(77_000_000)))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(taxonomy.s2class([("v8", high), ("v5", F.when(m == 1, codes(11)).otherwise(none))], mapping), ",").alias("codes"))


@query("T21_list_functions", "select p_partkey, array_to_string(list_sort(list_distinct([p_type, p_brand, p_type])), ',') as s, list_position([p_brand, p_type], p_type) as pos, array_to_string(list_slice([p_name, p_brand, p_type], 2, 3), ',') as sl from part")
def list_functions(spark, sf_dir):
    a = lambda *c: F.array(*c)
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        F.array_join(F.array_sort(F.array_distinct(a("p_type", "p_brand", "p_type"))), ",").alias("s"),
        F.array_position(a("p_brand", "p_type"), F.col("p_type")).cast("int").alias("pos"),
        F.array_join(F.slice(a("p_name", "p_brand", "p_type"), 2, 2), ",").alias("sl"),
    )


@query("T22_truncation", "select doc_id, length(substr(text, 1, 8192)) as n from documents")
def truncation(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.length(F.substring("text", 1, materialise.MAX_CODES)).cast("long").alias("n"))


@query("T24_joined_codes", "select p_partkey, case when p_brand = p_type then p_brand else array_to_string(list_filter([case when p_size > 10 then p_brand end, p_type], lambda x: x is not null), ' ') end as codes from part")
def joined_codes(spark, sf_dir):
    parts = F.array(F.when(F.col("p_size") > 10, F.col("p_brand")), F.col("p_type"), F.col("p_type"))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(F.array_distinct(F.array_compact(parts)), " ").alias("codes"))


@query("T25_json_extract", "select event_id, json_extract_string(props, '$.k') as k from events")
def json_extract(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"))


@query("T26_label_parse", "select event_id, case when event_type = 'click' then 'Exact' when event_type = 'view' then 'Irrelevant' end as label from events")
def label_parse(spark, sf_dir):
    word = F.when(F.col("event_type") == "click", "Exact").when(F.col("event_type") == "view", "Irrelevant").otherwise("Maybe")
    inner = F.concat(F.lit('{\\"label\\": \\"'), word, F.lit('\\"}'))
    body = F.when(F.col("event_type") == "error", F.lit("no json")).otherwise(F.concat(F.lit('{"choices": [{"message": {"content": "'), inner, F.lit('"}}]}')))
    content = F.from_json(body, "choices array<struct<message:struct<content:string>>>")["choices"]
    label = F.from_json(F.get(content, F.lit(0))["message"]["content"], "label string")["label"]
    return table(spark, sf_dir, "events").select("event_id", F.when(label.isin("Exact", "Substitute", "Complement", "Irrelevant"), label).alias("label"))


WS = "[\\s\\x{1c}-\\x{1f}\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+"
NORMAL_SQL = f"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(replace(%s, chr(160), ' '), chr(13) || chr(10), chr(10)), '^{WS}|{WS}$', '', 'g'),
 '[ \\t\\r\\f\\x0B]+', ' ', 'g'), ' *\\n *', chr(10), 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'), '^{WS}|{WS}$', '', 'g')"""


@query("T27_normalize_text", f"select doc_id, {NORMAL_SQL.replace('%s', 'text')} as t from documents")
def normalize(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.normalize_text(F.col("text")).alias("t"))


@query("T28_strip_tags", "select page_id, " + NORMAL_SQL.replace("%s", "regexp_replace(html, '<[^>]+>', ' ', 'g')") + " as t from pages")
def strip_tags(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.strip_tags(F.col("html")).alias("t"))


#: The references that the pages hold, resolved once; the mark stands for an ampersand until then.
ENTITY_SQL = "replace(regexp_replace(replace(replace(replace(%s, '&quot;', '\"'), '&copy;', '©'), '&middot;', '·'), '&amp;?', chr(1), 'g'), chr(1), '&')"


@query("T28_clean_html", "with x as (select page_id, " + NORMAL_SQL.replace("%s", "html") + " as t from pages) select page_id, " + NORMAL_SQL.replace("%s", ENTITY_SQL.replace("%s", "regexp_replace(t, '<[^>]+>', ' ', 'g')")) + " as t from x")
def clean_html(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.clean_html_text(F.col("html")).alias("t"))


@query("T29_flatten_paths", "select p_partkey, p_brand || ' > ' || p_type || ' | ' || p_name as paths from part")
def flatten_paths(spark, sf_dir):
    e = lambda *c: F.struct(F.array(*c).alias("elements"))
    paths = F.array(e("p_brand", F.concat("p_type", F.lit("  "))), e("p_name"), e("p_brand", "p_type"), e(F.lit(" ")))
    return table(spark, sf_dir, "part").select("p_partkey", text.flatten_paths(paths).alias("paths"))


@query("T30_render", "select p_partkey, p_name || chr(10) || 'Brand: ' || p_brand || case when p_size > 25 then chr(10) || 'Type: ' || p_type else '' end as t from part")
def render(spark, sf_dir):
    parts = [("", F.col("p_name")), ("Brand: ", F.col("p_brand")), ("Type: ", F.when(F.col("p_size") > 25, F.col("p_type"))), ("EAN: ", F.lit(""))]
    return table(spark, sf_dir, "part").select("p_partkey", text.render(parts).alias("t"))


GTIN_SQL = "(10 - list_sum(list_transform(range(1, 13), lambda i: cast(substr(d, i, 1) as integer) * case when i % 2 = 0 then 3 else 1 end)) % 10) % 10"


@query("T31_gtin_check", f"with x as (select p_partkey, lpad(cast(p_partkey * 7919 + 400000000000 as varchar), 12, '0') || (p_partkey % 10) as d from part) select p_partkey, cast(substr(d, 13, 1) as integer) = {GTIN_SQL} as ok from x")
def gtin(spark, sf_dir):
    d = F.concat(F.lpad((F.col("p_partkey") * 7919 + F.lit(400_000_000_000)).cast("string"), 12, "0"), (F.col("p_partkey") % 10).cast("string"))
    return table(spark, sf_dir, "part").select("p_partkey", identifiers.gtin_ok(d).alias("ok"))


@query("T31_article_slot", """select p_partkey, case p_partkey % 4 when 0 then '[ART_NONE]' when 1 then '[ART_EXACT]' when 2 then '[ART_SUBSTRING_ONLY]' else '[ART_OFFER_INVALID]' end as slot from part""")
def article_slot(spark, sf_dir):
    n = F.concat(F.lit("ab-"), (F.col("p_partkey") + 10000).cast("string"))
    kind = F.col("p_partkey") % 4
    q = F.when(kind == 0, "red ring").otherwise(F.concat(F.lit("need "), F.upper(n)))
    own = F.when(kind == 1, F.concat(F.lit("x;"), n)).when(kind == 2, F.concat(n, F.lit("-9"))).when(kind == 3, "n/a").otherwise(n)
    return table(spark, sf_dir, "part").select("p_partkey", identifiers.article_state(q, [own, F.lit("")]).alias("slot"))


@query("T31_feature_slots", """select p_partkey, case p_partkey % 3 when 0 then '[EAN_MATCH]' when 1 then '[EAN_MISMATCH]' else '[EAN_NONE]' end as ean, case when p_size % 2 = 0 then '[SPEC_MATCH]' else '[SPEC_MISMATCH]' end as spec from part""")
def feature_slots(spark, sf_dir):
    """Offers with the EAN that the query names, with another valid one, or an invalid one; and with its length or a longer one."""
    p, kind, size = table(spark, sf_dir, "part"), F.col("p_partkey") % 3, F.col("p_size")
    q = F.concat_ws(" ", F.lit("M8x40"), (size + 100).cast("string"), F.lit("mm 4006381333931"))
    own = F.when(kind == 0, "4006381333931").when(kind == 1, "96385074").otherwise("4006381333930")
    long = F.when(size % 2 == 0, size + 100).otherwise(size + 300)
    return p.select("p_partkey", identifiers.ean_state(q, own).alias("ean"), identifiers.spec_state(q, [F.concat(F.lit("Bolt m8 x40 length "), long.cast("string"), F.lit(" mm"))]).alias("spec"))


@query("T32_spec_tokens", "select p_partkey, 'm8x' || p_size || ',' || p_size || 'mm,din' || (p_partkey % 1000) as specs from part")
def spec_tokens(spark, sf_dir):
    t = F.concat(F.lit("Bolt M8x"), F.col("p_size").cast("string"), F.lit(" "), F.col("p_size").cast("string"), F.lit(" mm DIN "), (F.col("p_partkey") % 1000).cast("string"))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(identifiers.spec_tokens(t, ["thread_m", "mm", "din"]), ",").alias("specs"))


@query("T33_similarities", """with x as (select p_partkey, p_name as a, p_name || ' ' || p_type as b from part),
g as (select p_partkey, a, b, list_distinct(list_transform(range(1, greatest(len(a) - 1, 2)), lambda i: substr(lower(a), i, 3))) as ga, list_distinct(list_transform(range(1, greatest(len(b) - 1, 2)), lambda i: substr(lower(b), i, 3))) as gb from x)
select p_partkey, round(len(list_intersect(ga, gb)) / len(list_distinct(list_concat(ga, gb))), 9) as tri, case when contains(lower(b), lower(a)) then 1 else 0 end as sub from g""")
def similarities(spark, sf_dir):
    a, b = F.col("p_name"), F.concat_ws(" ", "p_name", "p_type")
    return table(spark, sf_dir, "part").select("p_partkey", F.round(text.trigram_jaccard(a, b), 9).alias("tri"), text.substring_flag(a, b).alias("sub"))


@query("T33_digit_jaccard", "select p_partkey, case when p_size = p_partkey then 1.0 else 0.5 end as j from part")
def digit_jaccard(spark, sf_dir):
    a = F.concat_ws(" ", F.col("p_size").cast("string"))
    b = F.concat_ws("x", F.col("p_size").cast("string"), F.col("p_partkey").cast("string"))
    return table(spark, sf_dir, "part").select("p_partkey", text.digit_jaccard(a, b).alias("j"))


@query("T34_row_identifier", "select p_partkey, case when p_size % 2 = 0 then p_name else cast(p_partkey as varchar) end as i from part")
def row_identifier(spark, sf_dir):
    first = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit(" "), F.col("p_name"))).otherwise(F.lit("  "))
    return table(spark, sf_dir, "part").select("p_partkey", text.row_identifier([first, F.col("p_partkey")]).alias("i"))


@query("T35_denormalised_keys", "select o_custkey, array_to_string(list_sort(list_distinct(list(o_orderstatus || '|' || o_orderpriority))), ',') as ks from orders group by o_custkey")
def keys(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.collect_set(F.concat_ws("|", "o_orderstatus", "o_orderpriority")).alias("k"))
    return rows.select("o_custkey", F.array_join(F.array_sort("k"), ",").alias("ks"))


@query("T36_l2_normalise", "select vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: cast(x as double) * x))), 5) as n, 1.0 as unit from embeddings")
def normalise(spark, sf_dir):
    v = F.col("embedding")
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(vectors.norm(v), 5).alias("n"), F.round(vectors.norm(vectors.l2_normalise(v)), 6).alias("unit"))


@query("T37_fp16_round_trip", "select vec_id, len(embedding) as n, true as near from embeddings")
def fp16(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", vectors.encode_fp16("embedding").alias("b"))
    rows = rows.select("vec_id", "embedding", "b", vectors.decode_fp16("b").alias("d"))
    near = F.forall(F.zip_with("embedding", "d", lambda x, y: F.abs(x - y) < 1e-3), lambda ok: ok)
    return rows.select("vec_id", (F.octet_length("b") / 2).cast("long").alias("n"), near.alias("near"))


@query("T38_string_functions", "select p_partkey, lower(trim(p_brand)) as b, length(p_name) as n, replace(p_type, 'O', '0') as t, p_name like '%ring%' as ring, regexp_matches(p_brand, '#1[0-9]$') as teen from part")
def strings(spark, sf_dir):
    return table(spark, sf_dir, "part").select(
        "p_partkey", F.lower(F.trim("p_brand")).alias("b"), F.length("p_name").cast("long").alias("n"), F.replace("p_type", F.lit("O"), F.lit("0")).alias("t"),
        F.col("p_name").like("%ring%").alias("ring"), F.col("p_brand").rlike("#1[0-9]$").alias("teen"),
    )


@query("T39_unwrap_records", "select event_id, cast(json_extract_string(props, '$.k') as bigint) as k, cast(event_id as varchar) as oid from events")
def unwrap_records(spark, sf_dir):
    body = F.concat(F.lit('{"n": {"$numberLong": "'), F.get_json_object("props", "$.k"), F.lit('"}, "_id": {"$oid": "'), F.col("event_id").cast("string"), F.lit('"}}'))
    v = F.parse_json(body)
    return table(spark, sf_dir, "events").select("event_id", F.try_variant_get(v, '$.n["$numberLong"]', "string").cast("long").alias("k"), F.try_variant_get(v, '$._id["$oid"]', "string").alias("oid"))


@query("T40_part_number_shape", "select p_partkey, p_partkey % 3 = 0 as mpn from part")
def mpn(spark, sf_dir):
    q = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("ab-"), F.col("p_partkey").cast("string"))).when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("a b"), F.col("p_partkey").cast("string"))).otherwise("abcd")
    return table(spark, sf_dir, "part").select("p_partkey", identifiers.is_mpn_shaped(q).alias("mpn"))


@query("T41_flat_fields", "select o_orderkey, count(*) as n, cast(min(l_quantity) as double) as first_price from orders join lineitem on o_orderkey = l_orderkey group by 1")
def flat_fields(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list("l_quantity")).alias("steps"))
    rows = table(spark, sf_dir, "orders").join(li, F.col("o_orderkey") == F.col("l_orderkey"))
    return rows.select("o_orderkey", F.size("steps").cast("long").alias("n"), F.get("steps", F.lit(0)).alias("first_price"))


OK_SQL = "v is not null and length(v) between 4 and 40 and not regexp_matches(v, '^0+$') and not regexp_matches(v, '^9+$') and not regexp_matches(v, '^[-_.[:space:]]+$') and v not in ('k.a.', 'n/a', 'n.a.', 'null', 'aucune donnée', '#ref!') and not regexp_matches(v, '\\s')"
SHAPES_SQL = "select p_partkey, case p_partkey % 8 when 0 then '0000' when 1 then 'n.a.' when 2 then cast(40000000 + p_partkey as varchar) when 3 then 'ab ' || p_partkey when 4 then 'magnet' when 5 then '4.0e+12' when 6 then 'x-' || (p_partkey + 100) else null end as v from part"


@query("P20_identifier_hygiene", f"with x as ({SHAPES_SQL}) select p_partkey, {OK_SQL} as ok, {OK_SQL} and length(v) in (8, 12, 13, 14) as ean, {OK_SQL} and not regexp_matches(v, '^[a-zäöüß]+$') and not (v like '%e+%' and regexp_matches(v, '^[\\d,.eE+\\-]+$')) as mpn from x")
def hygiene(spark, sf_dir):
    k, n = F.col("p_partkey") % 8, F.col("p_partkey")
    v = (
        F.when(k == 0, "0000").when(k == 1, "n.a.").when(k == 2, (n + 40_000_000).cast("string")).when(k == 3, F.concat(F.lit("ab "), n.cast("string")))
        .when(k == 4, "magnet").when(k == 5, "4.0e+12").when(k == 6, F.concat(F.lit("x-"), (n + 100).cast("string")))
    )
    return table(spark, sf_dir, "part").select("p_partkey", v.alias("v")).select("p_partkey", identifiers.is_universal_ok(F.col("v")).alias("ok"), identifiers.is_ean_ok(F.col("v")).alias("ean"), identifiers.is_mpn_ok(F.col("v")).alias("mpn"))


STRICT_SQL = "regexp_full_match(q, '\\d{8}|\\d{12,14}') or (length(q) >= 7 and (regexp_full_match(q, '[a-z]+\\d{4,}[a-z0-9]*') or (regexp_full_match(q, '[a-z0-9]+(-[a-z0-9]+)+') and length(regexp_replace(q, '[^0-9]', '', 'g')) >= 3)))"


@query("R04_strict_identifier", f"with x as (select p_partkey, lower(case p_partkey % 6 when 0 then cast(p_partkey + 40000000 as varchar) when 1 then 'TZE-' || (p_partkey + 100) when 2 then 'rj45' when 3 then 'E' || (p_partkey + 1987303) when 4 then p_name else 'wd-40' end) as q from part) select p_partkey, q not in ('rj45', 'wd-40') and length(q) between 4 and 40 and ({STRICT_SQL}) as strict from x")
def strict(spark, sf_dir):
    k, n = F.col("p_partkey") % 6, F.col("p_partkey")
    q = F.when(k == 0, (n + 40_000_000).cast("string")).when(k == 1, F.concat(F.lit("TZE-"), (n + 100).cast("string"))).when(k == 2, "rj45").when(k == 3, F.concat(F.lit("E"), (n + 1_987_303).cast("string"))).when(k == 4, F.col("p_name")).otherwise(" WD-40 ")
    return table(spark, sf_dir, "part").select("p_partkey", identifiers.is_strict_identifier(q).alias("strict"))


@query("P22_query_universe", """with x as (select event_type || '-' || (event_id % 50) as q, count(*) as n, count(distinct user_id) as u from events group by 1)
select q, n, u from x where length(q) between 3 and 200 and (regexp_matches(q, '[A-Za-zÀ-ÖØ-öø-ÿẞ]') or (regexp_matches(q, '\\d') and length(q) >= 4)) and not (n >= 50 and u <= 3)""")
def universe(spark, sf_dir):
    q = F.concat_ws("-", "event_type", (F.col("event_id") % 50).cast("string"))
    rows = table(spark, sf_dir, "events").groupBy(q.alias("q")).agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("u"))
    letter = F.col("q").rlike("[A-Za-zÀ-ÖØ-öø-ÿẞ]") | (F.col("q").rlike(r"\d") & (F.length("q") >= 4))
    return rows.filter(F.length("q").between(3, 200) & letter & ~((F.col("n") >= 50) & (F.col("u") <= 3)))


@query("P23_distinct_from", "select count(*) as n from documents d left join labels l using (doc_id) where l.quality is distinct from 1")
def distinct_from(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return rows.filter(~F.col("quality").eqNullSafe(1)).agg(F.count("*").alias("n"))


@query("P24_in_subquery", "select p_partkey from part where p_partkey in (select l_partkey from lineitem where l_quantity > 49) and p_partkey not in (select l_partkey from lineitem where l_quantity < 2)")
def in_subquery(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("p_partkey"), "l_quantity")
    p = table(spark, sf_dir, "part").select("p_partkey")
    return p.join(li.filter("l_quantity > 49"), "p_partkey", "left_semi").join(li.filter("l_quantity < 2"), "p_partkey", "left_anti")


@query("P25_all_but_columns", "select * exclude (p_name, p_brand) from part")
def all_but(spark, sf_dir):
    return table(spark, sf_dir, "part").drop("p_name", "p_brand")


@query("P27_bands", "select p_partkey, case when p_size >= 40 then 'head' when p_size >= 5 then 'torso' else 'tail' end as band, case when p_retailprice = 0 then 'zero' when p_retailprice < 10 then '1-9' when p_retailprice < 100 then '10-99' when p_retailprice < 1000 then '100-999' else '1000+' end as hits from part")
def bands(spark, sf_dir):
    r = F.col("p_retailprice")
    hits = F.when(r == 0, "zero").when(r < 10, "1-9").when(r < 100, "10-99").when(r < 1000, "100-999").otherwise("1000+")
    return table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_size") >= 40, "head").when(F.col("p_size") >= 5, "torso").otherwise("tail").alias("band"), hits.alias("hits"))


@query("Z06_truncate_bytes", "select doc_id, length(case when octet_length(encode(text)) > 1024 then substr(text, 1, 256) else text end) as n from documents")
def truncate(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.length(text.truncate_bytes(F.col("text"), 1024)).cast("long").alias("n"))


@query("Z09_unique_nested", "select l_orderkey, string_agg(distinct 'v' || l_suppkey, ',' order by 'v' || l_suppkey) as vs from lineitem group by 1")
def unique_nested(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_set(F.concat(F.lit("v"), F.col("l_suppkey").cast("string")))).alias("v"))
    return rows.select("l_orderkey", F.array_join("v", ",").alias("vs"))


@query("Z12_id_sets", "select l_orderkey, string_agg(distinct 'v' || l_suppkey, ',' order by 'v' || l_suppkey) as vs from lineitem where l_returnflag <> 'R' group by 1")
def id_sets(spark, sf_dir):
    entry = F.struct(F.concat(F.lit("v"), F.col("l_suppkey").cast("string")).alias("v"), F.col("l_returnflag").alias("f"))
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_set(entry).alias("e"))
    sets = F.array_sort(F.array_distinct(F.transform(F.filter("e", lambda x: x["f"] != "R"), lambda x: x["v"])))
    return rows.select("l_orderkey", F.array_join(sets, ",").alias("vs")).filter("vs <> ''")


def raw_collections(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Nested collections over the test tables: line items with a line number of 1 are offers, others their prices."""
    li = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    b64 = lambda c: F.base64(F.unhex(F.md5(c.cast("string"))))
    none = lambda t: F.lit(None).cast(t)
    number, vendor = F.col("l_partkey").cast("string").alias("articleNumber"), b64(F.col("l_suppkey")).alias("vendorId")
    step = lambda p: F.array(F.struct(F.lit("1").alias("minQuantity"), F.format_string("%.2f", p).alias("price")))
    details = lambda kind, p: F.struct(
        b64(F.col("l_linestatus")).alias("sourcePriceListId"), F.lit(kind).alias("type"),
        F.struct(step(p).alias("staggeredPrices"), F.when(F.col("l_returnflag") == "A", "EUR").otherwise("CHF").alias("currencyCode")).alias("prices"),
        F.lit(False).alias("dailyPrice"), F.lit("1").alias("priceQuantity"),
    )
    params = F.struct(
        F.col("p_name").alias("name"),
        F.array(F.struct(F.lit("type").alias("name"), F.array("p_type").alias("values"), none("string").alias("unit"), none("string").alias("description"))).alias("features"),
        F.create_map(F.lit("ECLASS_5_1"), F.array((F.col("p_size") * 1_000_000).cast("int"))).alias("eclassGroups"),
        F.array(F.struct(F.array("p_brand", "p_type").alias("elements"))).alias("categoryPaths"),
        none("string").alias("ean"), F.col("p_brand").alias("manufacturerName"), F.concat(F.lit("c"), F.col("p_size").cast("string")).alias("customerArticleNumber"),
        F.lit("5").alias("deliveryTime"), none("string").alias("description"), none("string").alias("manufacturerArticleNumber"), none("string").alias("manufacturerArticleType"),
    )
    offer = F.struct(
        params.alias("offerParams"),
        F.struct(details("OPEN", F.floor("l_extendedprice") / 4.0).alias("open"), none(materialise.DETAILS).alias("closed")).alias("pricings"),
        F.struct(none("array<string>").alias("sparePartFor"), F.array(F.lit("n1")).alias("accessoryFor"), none("array<string>").alias("similarTo")).alias("relatedArticleNumbers"),
    )
    first = li.filter("l_linenumber = 1")
    return {
        "offers": first.select(number, vendor, b64(F.col("l_orderkey")).alias("catalogVersionId"), offer.alias("offer")),
        "pricings": li.filter("l_linenumber = 2").select(number, vendor, details("CLOSED", F.floor("l_extendedprice") / 2.0).alias("pricingDetails")),
        "markers": li.filter("l_linenumber = 3").select(number, vendor, b64(F.col("l_orderkey") % 50).alias("coreArticleListSourceId"), (F.col("l_returnflag") == "A").alias("coreArticleMarker")),
        "cans": li.filter("l_linenumber = 4").select(number, vendor, b64(F.col("l_orderkey") % 20).alias("customerArticleNumbersListVersionId"), F.concat(F.lit("k"), (F.col("l_orderkey") % 3).cast("string")).alias("customerArticleNumber")),
    }


def flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = raw_collections(spark, sf_dir)
    return materialise.flat_rows(materialise.joined(c["offers"], c["pricings"], c["markers"], c["cans"]))


@query("J01_joined_offers", """with o as (select l_partkey, l_suppkey, l_orderkey from lineitem where l_linenumber = 1), p as (select l_partkey, l_suppkey, count(*) as n from lineitem where l_linenumber = 2 group by 1, 2),
m as (select l_partkey, l_suppkey, count(*) as n from lineitem where l_linenumber = 3 group by 1, 2)
select l_partkey, l_suppkey, l_orderkey, coalesce(p.n, 0) as n_prices, coalesce(m.n, 0) as n_markers from o left join p using (l_partkey, l_suppkey) left join m using (l_partkey, l_suppkey)""")
def joined_offers(spark, sf_dir):
    c = raw_collections(spark, sf_dir)
    li = table(spark, sf_dir, "lineitem")
    b64 = lambda n: F.base64(F.unhex(F.md5(F.col(n).cast("string"))))
    names = li.filter("l_linenumber = 1").select("l_partkey", "l_suppkey", "l_orderkey", b64("l_suppkey").alias("vendorId"), F.col("l_partkey").cast("string").alias("articleNumber"), b64("l_orderkey").alias("catalogVersionId"))
    rows = materialise.joined(c["offers"], c["pricings"], c["markers"], c["cans"])
    rows = rows.join(names, ["vendorId", "articleNumber", "catalogVersionId"])
    n = lambda x: F.coalesce(F.size(x), F.lit(0)).cast("long")
    return rows.select("l_partkey", "l_suppkey", "l_orderkey", F.when(F.col("joined_prices").isNull(), 0).otherwise(n("joined_prices")).alias("n_prices"), F.when(F.col("joined_markers").isNull(), 0).otherwise(n("joined_markers")).alias("n_markers"))


@query("A02_article_base", """select substr(sha256(encode(p_name) || '\\x00'::blob || encode(p_brand) || '\\x00'::blob || '\\x00'::blob || encode(p_brand || '¦' || p_type) || '\\x00'::blob || '\\x00'::blob || encode(cast(p_partkey as varchar)) || '\\x00'::blob || '\\x00'::blob), 1, 32) as article_hash,
 p_name as name, p_name || ' ' || p_brand || ' ' || p_partkey as text_codes from part where p_partkey in (select l_partkey from lineitem where l_linenumber = 1)""")
def article_base(spark, sf_dir):
    return materialise.article_table(flat(spark, sf_dir)).select("article_hash", "name", "text_codes")


@query("A03_envelopes", """with o as (select l_partkey, l_suppkey, l_orderkey, l_returnflag, floor(l_extendedprice) / 4.0 as p from lineitem where l_linenumber = 1),
x as (select l_partkey, l_returnflag, p from o union all select o.l_partkey, c.l_returnflag, floor(c.l_extendedprice) / 2.0 from o join lineitem c on c.l_linenumber = 2 and c.l_partkey = o.l_partkey and c.l_suppkey = o.l_suppkey)
select p_name || ' ' || p_brand || ' ' || l_partkey as text_codes, coalesce(min(p) filter (where l_returnflag = 'A'), 3.4028234e38) as eur_price_min, coalesce(max(p) filter (where l_returnflag = 'A'), -3.4028234e38) as eur_price_max,
 coalesce(min(p) filter (where l_returnflag <> 'A'), 3.4028234e38) as chf_price_min from x join part on l_partkey = p_partkey group by 1""")
def envelopes(spark, sf_dir):
    return materialise.article_table(flat(spark, sf_dir)).select("text_codes", "eur_price_min", "eur_price_max", "chf_price_min")


@query("A04_customer_numbers", """with o as (select l_partkey, l_suppkey, l_orderkey, 'c' || p_size as c from lineitem join part on l_partkey = p_partkey where l_linenumber = 1),
x as (select l_partkey, c as value, md5(cast(l_orderkey as varchar)) as v from o union select o.l_partkey, 'k' || (c.l_orderkey % 3), md5(cast(c.l_orderkey % 20 as varchar)) from o join lineitem c on c.l_linenumber = 4 and c.l_partkey = o.l_partkey and c.l_suppkey = o.l_suppkey),
n as (select l_partkey, value, count(distinct v) as n from x group by 1, 2)
select p_name || ' ' || p_brand || ' ' || l_partkey as text_codes, string_agg(value || ':' || n, ',' order by value) as numbers from n join part on l_partkey = p_partkey group by 1""")
def customer_numbers(spark, sf_dir):
    rows = materialise.article_table(flat(spark, sf_dir))
    return rows.select("text_codes", F.array_join(F.transform("customer_article_numbers", lambda x: F.concat_ws(":", x["value"], F.size(x["version_ids"]).cast("string"))), ",").alias("numbers"))


HASH_SQL = "substr(sha256(encode(p_name) || '\\x00'::blob || encode(p_brand) || '\\x00'::blob || '\\x00'::blob || encode(p_brand || '¦' || p_type) || '\\x00'::blob || '\\x00'::blob || encode(cast(p_partkey as varchar)) || '\\x00'::blob || '\\x00'::blob), 1, 32)"


def uuid_sql(h: str) -> str:
    return UUID_SQL.replace("(h,", f"({h},")


@query("S01_offer_table", f"""with o as (select l_partkey as pk, l_suppkey as sk, l_orderkey as ok, l_returnflag as f, floor(l_extendedprice) / 4.0 as p from lineitem where l_linenumber = 1),
x as (select * from o union all select o.pk, o.sk, o.ok, c.l_returnflag, floor(c.l_extendedprice) / 2.0 from o join lineitem c on c.l_linenumber = 2 and c.l_partkey = o.pk and c.l_suppkey = o.sk),
g as (select pk, sk, ok, count(*) as n, min(p) filter (where f = 'A') as low, max(p) filter (where f <> 'A') as high, array_to_string(list_sort(list_distinct(list(case when f = 'A' then 'eur' else 'chf' end))), ',') as c from x group by 1, 2, 3)
select {uuid_sql("md5(cast(sk as varchar))")} || ':' || rtrim(replace(replace(to_base64(encode(cast(pk as varchar))), '+', '-'), '/', '_'), '=') || ':' || {uuid_sql("md5(cast(ok as varchar))")} as id, {HASH_SQL} as article_hash, {uuid_sql("md5(cast(sk as varchar))")} as vendor_id,
 5 as delivery_time_days_max, cast(n as integer) as n_prices, coalesce(low, 3.4028234e38) as eur_price_min, coalesce(high, -3.4028234e38) as chf_price_max, c as currencies from g join part on pk = p_partkey""")
def offer_table(spark, sf_dir):
    rows = materialise.offer_table(flat(spark, sf_dir))
    return rows.select("id", "article_hash", "vendor_id", "delivery_time_days_max", F.size("prices").alias("n_prices"), "eur_price_min", "chf_price_max", F.array_join("currencies", ",").alias("currencies"))
