"""Queries of the filter algebra, sorting, paging, routing and facets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import prices, taxonomy
from ..plans import predicates, search
from ..plans.request import ArticleSources, BlockedClasses, SearchRequest, sort_plan
from . import query
from .catalog import CATALOG, RESOLVED, articles, offers

SOURCES = ArticleSources(("cv1", "cv2", "cv3"), ("cv1", "cv2"), ("plO", "plX"), ("u1",))
EUR = f"{RESOLVED}"


def _filter(name: str, request: SearchRequest, part, where: str, side=offers) -> None:
    """A query that gives the rows one filter lets through."""
    key = "id" if side is offers else "article_hash"
    source = "offers" if side is offers else "articles"

    @query(name, f"{CATALOG} select {key} from {source} where {where}")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        test = part(request)
        rows = side(spark, sf_dir)
        return (rows if test is None else rows.filter(test)).select(key)


R = SearchRequest
_filter("P01_vendors", R(vendors=("v1", "v7", "v50")), predicates.vendors, "vendor_id in ('v1', 'v7', 'v50')")
_filter("P02_article_ids", R(article_ids=("v3:1", "v4:", "v9:12-1-1:cv4")), predicates.article_ids, "starts_with(id, 'v3:1') or starts_with(id, 'v4:') or id = 'v9:12-1-1:cv4'")
_filter("P03_manufacturers", R(manufacturers=("Brand#1", "Brand#9")), predicates.manufacturers, "manufacturerName in ('Brand#1', 'Brand#9')", articles)
_filter("P04_delivery_time", R(max_delivery_time=5), predicates.delivery_time, "delivery_time_days_max <= 5")
_filter("P05_features", R(features=(("flag", ("A", "N")), ("line", ("1", "2")), ("none", ()))), predicates.features, "flag in ('A', 'N') and line in (1, 2)")
_filter("P06_category", R(category_path=("Brand#3", "ECONOMY")), predicates.category, "category_l2 = 'Brand#3¦ECONOMY'", articles)
_filter("P07_s2class", R(s2class=3_000_000, eclass5=1_000_000), predicates.s2class, "root = 3000000 or mid = 3000000 or leaf = 3000000", articles)
_filter("P08_eclasses", R(eclasses=(2_010_000, 4_000_000)), predicates.eclasses, "root in (2010000, 4000000) or mid in (2010000, 4000000) or leaf in (2010000, 4000000)", articles)
_filter("P09_catalog_versions", R(sources=SOURCES), predicates.catalog_versions, "catalog_version_id in ('cv1', 'cv2', 'cv3')")
_filter("P09_closed_versions", R(sources=SOURCES, closed_only=True), predicates.catalog_versions, "catalog_version_id in ('cv1', 'cv2')")
_filter("P11_relationships", R(accessory_for="n1", spare_part_for="n2"), predicates.relationships, "accessory_for = 'n1' and spare_part_for = 'n2'")
_filter("P12_core_only", R(sources=SOURCES, core_only=True), predicates.core_only, "list_contains(core_marker_enabled_sources, 'u1') or (list_has_any(core_marker_enabled_sources, ['cv1', 'cv2']) and not list_contains(core_marker_disabled_sources, 'u1'))")
_filter("P13_core_vendors", R(sources=SOURCES, core_vendors=("v1", "v2")), predicates.core_vendors, "vendor_id not in ('v1', 'v2') or list_contains(core_marker_enabled_sources, 'u1') or (list_has_any(core_marker_enabled_sources, ['cv1', 'cv2']) and not list_contains(core_marker_disabled_sources, 'u1'))")
_filter("P16_price_lists", R(sources=ArticleSources(("cv1",), (), ("plO",)), price_filter=True), predicates.price_lists, "status = 'O'")
_filter("P17_price_band", R(price_min=100_000, price_max=200_000), predicates.price_band, "case when ccy = 'EUR' then unit else unit * 2 end <= 2000 and unit * 2 >= 1000")

@query("P10_match_nothing", f"{CATALOG} select 'lists and versions' as kind, count(*) as n from offers where catalog_version_id in ('cv1', 'cv2', 'cv3') union all select 'no lists', 0 union all select 'no versions', 0")
def match_nothing(spark, sf_dir):
    """Offers of requests that name no price lists, no catalog versions, or both."""
    out = None
    for kind, sources in (("lists and versions", SOURCES), ("no lists", ArticleSources(("cv1",))), ("no versions", ArticleSources((), (), ("plO", "plX")))):
        n = offers(spark, sf_dir).filter(predicates.catalog_versions(R(sources=sources))).agg(F.lit(kind).alias("kind"), F.count("*").alias("n"))
        out = n if out is None else out.unionByName(n)
    return out


BLOCKED = (BlockedClasses("S2CLASS", ("v1", "v2", "v3"), (1_000_000, 2_000_000), (1_010_000,)), BlockedClasses("ECLASS_5_1", ("v4",), (3_000_000,)), BlockedClasses("S2CLASS", (), (1_000_000,)))
BLOCKED_SQL = "(vendor_id not in ('v1', 'v2', 'v3') or not (root in (1000000, 2000000) and mid <> 1010000)) and (vendor_id <> 'v4' or root <> 3000000)"


@query("P14_blocked_classes", f"{CATALOG} select id from offers join articles using (article_hash) where {BLOCKED_SQL}")
def blocked(spark, sf_dir):
    rows = offers(spark, sf_dir).select("id", "vendor_id", "article_hash").join(articles(spark, sf_dir), "article_hash")
    return rows.filter(predicates.blocked_classes(R(blocked=BLOCKED))).select("id")


@query("P15_blocked_after_join", f"{CATALOG} select vendor_id, count(*) as n from offers join articles using (article_hash) where {BLOCKED_SQL} group by vendor_id")
def blocked_counts(spark, sf_dir):
    rows = search.filtered(offers(spark, sf_dir), articles(spark, sf_dir), R(blocked=BLOCKED, sources=ArticleSources(("cv0", "cv1", "cv2", "cv3", "cv4"), (), ("plO", "plX"))))
    return search.vendor_facet(rows).withColumnRenamed("vendor", "vendor_id")


FULL = R(sources=SOURCES, vendors=("v1", "v2", "v3", "v6", "v7", "v8", "v11", "v12", "v13"), category_path=(), max_delivery_time=40, features=(("flag", ("A", "R")),), price_min=50_000, price_max=350_000)
FULL_SQL = f"catalog_version_id in ('cv1', 'cv2', 'cv3') and delivery_time_days_max <= 40 and flag in ('A', 'R') and {EUR} between 500 and 3500"
VENDORS_SQL = "vendor_id in ('v1', 'v2', 'v3', 'v6', 'v7', 'v8', 'v11', 'v12', 'v13')"


@query("P18_all_filters", f"{CATALOG} select id, {EUR} as price from offers join articles using (article_hash) where {FULL_SQL} and {VENDORS_SQL}")
def all_filters(spark, sf_dir):
    return search.filtered(offers(spark, sf_dir), articles(spark, sf_dir), FULL).select("id", F.col("resolved_price").alias("price"))


@query("P18_without_vendor", f"{CATALOG} select id from offers where {FULL_SQL}")
def without_vendor(spark, sf_dir):
    return search.filtered(offers(spark, sf_dir), articles(spark, sf_dir), FULL, ("vendor",)).select("id")


@query("P19_column_planner", f"{CATALOG} select vendor_id, count(*) as n from offers group by vendor_id")
def pruned(spark, sf_dir):
    return offers(spark, sf_dir).groupBy("vendor_id").agg(F.count("*").alias("n"))


@query("P21_one_offer_satisfies", f"{CATALOG} select article_hash from offers where vendor_id in ('v1', 'v2') and delivery_time_days_max <= 30 and ((ccy = 'EUR' and unit between 900 and 1800) or unit * 2 between 900 and 1800) group by article_hash")
def nested(spark, sf_dir):
    rows = offers(spark, sf_dir).filter(F.col("vendor_id").isin("v1", "v2")).groupBy("article_hash").agg(F.collect_list(F.struct("vendor_id", "delivery_time_days_max", "prices")).alias("offers"))
    return rows.filter(predicates.one_offer_of("offers", ("v1", "v2"), 30, "EUR", 900, 1800)).select("article_hash")


@query("P26_hash_chunks", f"{CATALOG} select id, cast(count(*) as integer) as chunks from offers group by 1")
def chunks(spark, sf_dir):
    """Each offer is in one chunk of four, those of one id in the same."""
    rows = offers(spark, sf_dir).select("id")
    parts = rows.filter(predicates.hash_chunk("id", 4, 0)).withColumn("chunk", F.lit(0))
    for i in range(1, 4):
        parts = parts.unionByName(rows.filter(predicates.hash_chunk("id", 4, i)).withColumn("chunk", F.lit(i)))
    counted = parts.groupBy("id").agg(F.count("*").cast("int").alias("chunks"), F.countDistinct("chunk").alias("n"))
    return counted.select("id", F.when(F.col("n") == 1, F.col("chunks")).alias("chunks"))


LISTS = "['plO', 'plX']"


@query("T13_resolve_price", f"{CATALOG} select id, {EUR} as price from offers")
def resolve(spark, sf_dir):
    return offers(spark, sf_dir).select("id", prices.resolve_price(F.col("prices"), "EUR", ["plO", "plX"]).alias("price"))


@query("T15_price_filter", f"{CATALOG} select id from offers where ({EUR}) between 1000 and 1500.5")
def price_filter(spark, sf_dir):
    return offers(spark, sf_dir).filter(prices.passes_price_filter(F.col("prices"), "EUR", ["plO", "plX"], "EUR", 100_000, 150_050)).select("id")


@query("T23_price_lists_and_currencies", f"{CATALOG} select id, array_to_string(list_sort(['pl' || status, 'plX']), ',') as lists, case when ccy = 'EUR' then 'eur' else array_to_string(list_sort([lower(ccy), 'eur']), ',') end as ccys from offers")
def lists(spark, sf_dir):
    return offers(spark, sf_dir).select("id", F.array_join("price_list_ids", ",").alias("lists"), F.array_join("currencies", ",").alias("ccys"))


REP = f"""{CATALOG}, rows as (select *, {EUR} as price from offers join articles using (article_hash) where {FULL_SQL} and {VENDORS_SQL}),
rep as (select * from (select *, row_number() over (partition by article_hash order by ORDER_KEYS) as r from rows) where r = 1)"""


def _representative(name: str, sort: tuple[str, ...], order: str) -> None:
    @query(name, REP.replace("ORDER_KEYS", order) + " select article_hash, id, price from rep")
    def run(spark, sf_dir):
        rows = search.filtered(offers(spark, sf_dir), articles(spark, sf_dir), FULL)
        return search.representatives(rows, sort_plan(sort)).select("article_hash", "id", F.col("resolved_price").alias("price"))


_representative("R10_representative_id", (), "id")
_representative("R10_representative_id_desc", ("articleId,desc",), "id desc")
_representative("R10_representative_price", ("price,asc",), "price, id")
_representative("R10_representative_price_desc", ("price,desc",), "price desc, id")


def _page(name: str, sort: tuple[str, ...], rep: str, order: str, page: int = 2) -> None:
    @query(name, REP.replace("ORDER_KEYS", rep) + f" select id, name, price from rep order by {order} limit 24 offset {24 * (page - 1)}")
    def run(spark, sf_dir):
        r = FULL.without(sort=sort, page=page)
        rows = search.hits(offers(spark, sf_dir), articles(spark, sf_dir), r)
        return rows.select("id", "name", F.col("resolved_price").alias("price"))


_page("O01_sort_by_name", ("name,asc",), "id", "lower(name), id")
_page("O01_sort_by_name_desc", ("name,desc",), "id", "lower(name) desc, id")
_page("R11_sort_by_price", ("price,asc", "name,desc"), "price, id", "price, id")
_page("R11_sort_by_price_desc", ("price,desc",), "price desc, id", "price desc, id")
_page("R12_paging", ("articleId,asc",), "id", "id", 3)
_page("R13_browse", (), "id", "lower(name), id", 1)


@query("R12_hit_count", f"{CATALOG} select count(distinct article_hash) as hits, cast(ceil(count(distinct article_hash) / 24.0) as bigint) as pages from offers where {FULL_SQL} and {VENDORS_SQL}")
def counts(spark, sf_dir):
    return search.hit_counts(search.filtered(offers(spark, sf_dir), articles(spark, sf_dir), FULL), 24)


@query("R14_filter_before_limit", f"{CATALOG} select id from offers where {FULL_SQL} and {VENDORS_SQL} order by {EUR}, id limit 50")
def filter_first(spark, sf_dir):
    return search.filtered(offers(spark, sf_dir), articles(spark, sf_dir), FULL).orderBy("resolved_price", "id").limit(50).select("id")


@query("A15_capped_count", f"{CATALOG} select least(count(*), 1000) as n, count(*) > 1000 as clipped from offers where {VENDORS_SQL}")
def capped(spark, sf_dir):
    return search.capped_count(offers(spark, sf_dir).filter(predicates.vendors(FULL)), 1000)


@query("J09_probe", f"{CATALOG} select article_hash, name from articles where article_hash in (select article_hash from offers where catalog_version_id in ('cv1', 'cv2', 'cv3') and {VENDORS_SQL})")
def probe(spark, sf_dir):
    r = R(sources=SOURCES, vendors=FULL.vendors)
    return articles(spark, sf_dir).join(search.probe(offers(spark, sf_dir), r), "article_hash", "left_semi").select("article_hash", "name")


@query("R07_capped_probe", f"{CATALOG} select article_hash from (select distinct article_hash from offers where catalog_version_id in ('cv1', 'cv2', 'cv3')) order by article_hash limit 100")
def capped_probe(spark, sf_dir):
    return search.probe(offers(spark, sf_dir), R(sources=SOURCES), search.Caps(probe=100))


@query("J07_resolve_offers", f"{CATALOG}, ranked as (select article_hash, name from articles order by name, article_hash limit 64) select o.id, r.name from offers o join ranked r using (article_hash)")
def resolve_offers(spark, sf_dir):
    ranked = articles(spark, sf_dir).orderBy("name", "article_hash").limit(64).select("article_hash", "name")
    return offers(spark, sf_dir).select("id", "article_hash").join(F.broadcast(ranked), "article_hash").select("id", "name")


@query("J10_article_meta", f"{CATALOG} select id, name, root as eclass from offers join articles using (article_hash) where delivery_time_days_max = 7")
def meta(spark, sf_dir):
    rows = offers(spark, sf_dir).filter("delivery_time_days_max = 7").join(articles(spark, sf_dir), "article_hash")
    return rows.select("id", "name", F.get("eclass7_code", F.lit(0)).alias("eclass"))


def _facet_rows(spark, sf_dir, exclude=()):
    return search.filtered(offers(spark, sf_dir), articles(spark, sf_dir), FULL, exclude)


BASE = f"{CATALOG}, rows as (select *, {EUR} as price from offers join articles using (article_hash) where {FULL_SQL} and {VENDORS_SQL})"


@query("A06_vendor_facet", f"{BASE} select vendor_id as vendor, count(*) as n from rows group by 1")
def vendor_facet(spark, sf_dir):
    return search.vendor_facet(_facet_rows(spark, sf_dir))


@query("A07_manufacturer_facet", f"{BASE} select manufacturerName as manufacturer, count(*) as n from rows group by 1")
def manufacturer_facet(spark, sf_dir):
    return search.manufacturer_facet(_facet_rows(spark, sf_dir))


@query("A08_feature_facet", f"""{BASE}, t as (select id, split_part(f, '=', 1) as name, split_part(f, '=', 2) as value from (select id, unnest(features) as f from rows))
select name, value, n, total from (select name, value, count(*) as n from t group by 1, 2) join (select name, count(distinct id) as total from t group by 1) using (name)""")
def feature_facet(spark, sf_dir):
    return search.feature_values(_facet_rows(spark, sf_dir))


@query("A08_feature_facet_nested", f"""{BASE}, t as (select id, split_part(f, '=', 1) as name, split_part(f, '=', 2) as value from (select id, unnest(features) as f from rows)),
v as (select name, value, count(*) as n from t group by 1, 2), totals as (select name, count(distinct id) as total from t group by 1)
select name, total, string_agg(value || ':' || n, ',' order by n desc, value) as vals from v join totals using (name) group by 1, 2 order by total desc, name limit 100""")
def feature_nested(spark, sf_dir):
    rows = search.feature_facet(_facet_rows(spark, sf_dir))
    return rows.select("name", "total", F.array_join(F.transform("values", lambda v: F.concat_ws(":", v["value"], v["n"].cast("string"))), ",").alias("vals"))


@query("A09_price_facet", f"{BASE} select 'EUR' as currency, min(price) as low, max(price) as high from rows")
def price_facet(spark, sf_dir):
    return search.price_facet(_facet_rows(spark, sf_dir), "EUR")


@query("A10_category_facet", f"""{CATALOG} select 'same' as place, category_l2 as path, count(distinct article_hash) as n from articles where category_l1 = 'Brand#3' group by 2
union all select 'child', category_l3, count(distinct article_hash) from articles where category_l2 = 'Brand#3¦ECONOMY' group by 2""")
def category_facet(spark, sf_dir):
    return search.category_facet(articles(spark, sf_dir), ("Brand#3", "ECONOMY"))


@query("A10_category_roots", f"""{CATALOG} select 'same' as place, category_l1 as path, count(distinct article_hash) as n from articles group by 2
union all select 'child', category_l2, count(distinct article_hash) from articles where category_l1 = 'Brand#3' group by 2""")
def category_roots(spark, sf_dir):
    return search.category_facet(articles(spark, sf_dir), ("Brand#3",))


@query("A11_class_facet", f"""{BASE}, c as (select article_hash, count(*) as n from rows group by 1), a as (select distinct article_hash, root, mid, leaf from rows)
select 'same' as place, mid as code, cast(sum(n) as bigint) as n from a join c using (article_hash) where root = 3000000 group by 2
union all select 'child', leaf, cast(sum(n) as bigint) from a join c using (article_hash) where mid = 3020000 group by 2""")
def class_facet(spark, sf_dir):
    rows = _facet_rows(spark, sf_dir)
    return search.class_facet(rows.dropDuplicates(["article_hash"]), rows, "s2class_code", 3_020_000)


@query("A11_class_roots", f"{BASE} select 'child' as place, root as code, count(*) as n from rows group by 2")
def class_roots(spark, sf_dir):
    rows = _facet_rows(spark, sf_dir)
    return search.class_facet(rows.dropDuplicates(["article_hash"]), rows, "s2class_code", 0)


@query("A12_set_facet", f"""{BASE} select 'one' as "set", count(*) filter (where root in (1000000, 2000000)) as n from rows
union all select 'two', count(*) filter (where mid = 3020000 or leaf = 4030200) from rows union all select 'none', 0""")
def set_facet(spark, sf_dir):
    rows = _facet_rows(spark, sf_dir)
    return search.set_facet(rows.dropDuplicates(["article_hash"]), rows, [("one", (1_000_000, 2_000_000)), ("two", (3_020_000, 4_030_200)), ("none", ())])


@query("A13_disjunctive_facets", f"""{BASE.replace(' and ' + VENDORS_SQL, '')} select 'vendor' as facet, vendor_id as value, count(*) as n from rows where manufacturerName in ('Brand#1', 'Brand#2') group by 2
union all select 'manufacturer', manufacturerName, count(*) from rows where {VENDORS_SQL} group by 2""")
def disjunctive(spark, sf_dir):
    rows = _facet_rows(spark, sf_dir, ("vendor",))
    tests = {"vendor": predicates.vendors(FULL), "manufacturer": F.col("manufacturerName").isin("Brand#1", "Brand#2")}
    return search.disjunctive_counts(rows, tests, {"vendor": "vendor_id", "manufacturer": "manufacturerName"})


@query("A14_summaries", f"""{BASE.replace("rows as (", "wide as (").replace(' and ' + VENDORS_SQL, '')}, rows as (select * from wide where {VENDORS_SQL}), t as (select split_part(f, '=', 1) as name, split_part(f, '=', 2) as value from (select unnest(features) as f from rows))
select 'vendors' as facet, vendor_id as value, count(*) as n from wide group by 2 union all select 'manufacturers', manufacturerName, count(*) from rows group by 2
union all select 'features', name || '=' || value, count(*) from t group by 2 union all select 's2class', cast(root as varchar), count(*) from rows group by 2 union all select 'eclass7', cast(root as varchar), count(*) from rows group by 2 union all select 'sets', 'one', count(*) filter (where root in (1000000, 2000000)) from rows""")
def summaries(spark, sf_dir):
    """All facets of one request as (facet, value, n)."""
    got = search.summaries(offers(spark, sf_dir), articles(spark, sf_dir), FULL.without(s2class=0, eclass7=0), [("one", (1_000_000, 2_000_000))])
    row = lambda facet, value, n="n": got[facet].select(F.lit(facet).alias("facet"), F.col(value).cast("string").alias("value"), F.col(n).cast("long").alias("n"))
    features = got["features"].select("name", F.explode("values").alias("v")).select(F.lit("features").alias("facet"), F.concat_ws("=", "name", "v.value").alias("value"), F.col("v.n").alias("n"))
    return row("vendors", "vendor").unionByName(row("manufacturers", "manufacturer")).unionByName(features).unionByName(row("s2class", "code")).unionByName(row("eclass7", "code")).unionByName(row("sets", "set"))


@query("A32_first_category", f"{CATALOG} select category_l1 as category, count(*) as n from articles group by 1 order by n desc, category limit 15")
def first_category(spark, sf_dir):
    first = F.get("category_l1", F.lit(0)).alias("category")
    return articles(spark, sf_dir).groupBy(first).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "category").limit(15)


@query("T12_category_levels", "select p_partkey, p_brand as l1, p_brand || '|x' as l2 from part")
def levels(spark, sf_dir):
    from ..session import table

    rows = table(spark, sf_dir, "part").withColumn("paths", F.expr("array(named_struct('elements', array(p_brand, 'a')), named_struct('elements', array(p_brand, 'b')), named_struct('elements', array(p_brand || '¦x')))"))
    levels = taxonomy.category_level(F.col("paths"), 1)
    return rows.select("p_partkey", F.get(levels, F.lit(0)).alias("l1"), F.get(levels, F.lit(1)).alias("l2"))


@query("T16_code_depth_parent", f"{CATALOG} select leaf as code, case when leaf % 100 <> 0 then 4 when leaf % 10000 <> 0 then 3 when leaf % 1000000 <> 0 then 2 else 1 end as depth, mid as parent from articles")
def depths(spark, sf_dir):
    code = F.get("s2class_code", F.lit(2))
    return articles(spark, sf_dir).select(code.alias("code"), taxonomy.code_depth(code).alias("depth"), taxonomy.code_parent(code).alias("parent"))


@query("R08_rank_limit", "select field, page, size, case when field = 'relevance' then greatest(1000, page * size) else 16384 end as n from (select unnest(['relevance', 'name', 'price', 'articleId']) as field), (select unnest(range(1, 30)) as page), (select unnest([1, 24, 100, 500]) as size)")
def limits(spark, sf_dir):
    from ..plans.request import SortPlan, rank_limit

    rows = [(f, p, n, rank_limit(SortPlan(f), p, n)) for f in ("relevance", "name", "price", "articleId") for p in range(1, 30) for n in (1, 24, 100, 500)]
    return spark.createDataFrame(rows, "field string, page long, size int, n long")


@query("B05_search_modes", f"{BASE} select count(distinct article_hash) as hits, cast(ceil(count(distinct article_hash) / 24.0) as bigint) as pages from rows")
def modes(spark, sf_dir):
    return search.search(offers(spark, sf_dir), articles(spark, sf_dir), FULL.without(mode="BOTH"))["counts"]


@query("B06_score_shown", REP.replace("ORDER_KEYS", "id") + " select id, cast(null as double) as score from rep order by lower(name), id limit 24")
def score_shown(spark, sf_dir):
    return search.hits(offers(spark, sf_dir), articles(spark, sf_dir), FULL.without(sort=("name,asc",), query="x")).select("id", "score")


@query("B07_point_lookup", f"{CATALOG} select id, article_hash from offers where starts_with(id, 'v5:')")
def lookup(spark, sf_dir):
    return offers(spark, sf_dir).filter(predicates.article_ids(R(article_ids=("v5:",)))).select("id", "article_hash")


#: The flagship: cheapest offer per article in a band, for vendors of one nation, by name.
FLAGSHIP_SQL = f"""{CATALOG}, near as (select 'v' || s_suppkey as vendor_id from supplier join nation on s_nationkey = n_nationkey where n_name = 'NATION_3'),
rows as (select *, {EUR} as price from offers join articles using (article_hash) where vendor_id in (select vendor_id from near) and {EUR} between 500 and 3500),
rep as (select * from (select *, row_number() over (partition by article_hash order by price, id) as r from rows) where r = 1)
select id, name, price from rep order by lower(name), id limit 24"""


@query("flagship_cheapest_offers", FLAGSHIP_SQL)
def flagship(spark, sf_dir):
    from ..session import table

    near = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation").filter("n_name = 'NATION_3'"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.concat(F.lit("v"), F.col("s_suppkey").cast("string")).alias("vendor_id"))
    r = R(sources=ArticleSources(("cv0", "cv1", "cv2", "cv3", "cv4"), (), ("plO", "plX")), price_min=50_000, price_max=350_000)
    rows = search.filtered(offers(spark, sf_dir).join(near, "vendor_id", "left_semi"), articles(spark, sf_dir), r)
    best = search.representatives(rows, sort_plan(("price,asc",)))
    return search.paged(best, [F.lower("name").asc(), F.asc("id")], 1, 24).select("id", "name", F.col("resolved_price").alias("price"))
