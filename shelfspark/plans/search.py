"""Search plans over offers and articles: routing, representative, sort, page, facets.

One logical plan per result set: filters stand below every limit, so nothing is
over-fetched; article and offer predicates meet in one join on article_hash. The
caps of a bounded store are options, off by default.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ids import legacy_offer_id
from ..functions.prices import passes_price_filter, resolve_price
from ..functions.taxonomy import code_depth, code_parent, starts_with_path
from ..session import cut
from . import predicates
from .request import SearchRequest, SortPlan, sort_plan

PATH = "¦"


@dataclass(frozen=True)
class Caps:
    """Limits of a bounded store; None means exact."""

    probe: int | None = None
    offers_per_article: int | None = None


def filtered(offers: DataFrame, articles: DataFrame, r: SearchRequest, exclude: tuple[str, ...] = ()) -> DataFrame:
    """Offers joined to their articles under all filters, with resolved_price where one exists."""
    rows = offers
    own = predicates.offer_side(r, exclude)
    if own is not None:
        rows = rows.filter(own)
    other = predicates.article_side(r, exclude)
    side = articles if other is None else articles.filter(other)
    rows = rows.join(side, "article_hash")
    late = predicates.blocked_classes(r)
    if late is not None:
        rows = rows.filter(late)
    lists = list(r.sources.price_lists)
    rows = rows.withColumn("resolved_price", resolve_price(F.col("prices"), r.currency, lists))
    if r.has_price_filter:
        rows = rows.filter(passes_price_filter(F.col("prices"), r.currency, lists, r.price_currency or r.currency, r.price_min, r.price_max))
    return rows


def representatives(rows: DataFrame, plan: SortPlan) -> DataFrame:
    """One offer per article: by price where that sorts, else by id; ties by the lesser id."""
    if plan.field == "price":
        rows = rows.filter("resolved_price is not null")
        order = [F.desc("resolved_price") if plan.descending else F.asc("resolved_price"), F.asc("id")]
    else:
        order = [F.desc("id") if plan.field == "articleId" and plan.descending else F.asc("id")]
    w = Window.partitionBy("article_hash").orderBy(*order)
    return rows.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def final_order(plan: SortPlan) -> list[Column]:
    name = F.lower(F.coalesce("name", F.lit("")))
    if plan.field == "relevance":
        return [F.desc_nulls_last("score"), name.asc(), F.asc("id")]
    if plan.field == "articleId":
        return [F.desc("id") if plan.descending else F.asc("id")]
    key = name if plan.field == "name" else F.col("resolved_price")
    return [key.desc() if plan.descending else key.asc(), F.asc("id")]


def paged(rows: DataFrame, order: list[Column], page: int, size: int) -> DataFrame:
    """Rows of a page; the sort and both limits run as one bounded top-k."""
    return rows.orderBy(*order).offset((page - 1) * size).limit(size)


def hit_counts(rows: DataFrame, size: int) -> DataFrame:
    """Hits and pages of distinct articles."""
    return rows.agg(F.countDistinct("article_hash").alias("hits")).select("hits", F.ceil(F.col("hits") / max(1, size)).cast("long").alias("pages"))


def capped_count(rows: DataFrame, cap: int) -> DataFrame:
    """Number of rows up to a cap, and whether there are more."""
    n = rows.select(F.lit(1).alias("x")).limit(cap + 1).agg(F.count("*").alias("n"))
    return n.select(F.least("n", F.lit(cap)).alias("n"), (F.col("n") > cap).alias("clipped"))


def probe(offers: DataFrame, r: SearchRequest, caps: Caps = Caps()) -> DataFrame:
    """Distinct article hashes with a matching offer: what the article side is limited to."""
    own = predicates.offer_side(r)
    hashes = (offers if own is None else offers.filter(own)).select("article_hash").distinct()
    return hashes if caps.probe is None else hashes.orderBy("article_hash").limit(caps.probe)


def route_label(r: SearchRequest, has_offer_filter: bool) -> str:
    """Path that a request takes: nothing, summaries, article side first, offer side first."""
    if predicates.matches_nothing(r):
        return "match_nothing"
    if r.mode == "SUMMARIES_ONLY":
        return "path_b_summaries" if has_offer_filter else "path_a_summaries"
    return "path_b" if has_offer_filter else "path_a"


def ranked_articles(offers: DataFrame, articles: DataFrame, r: SearchRequest, ranking: DataFrame | None = None) -> DataFrame:
    """Filtered offers with the score of their article; without a ranking the score is null (browse)."""
    rows = filtered(offers, articles, r)
    if ranking is None:
        return rows.withColumn("score", F.lit(None).cast("double"))
    return rows.join(ranking.select(F.col("id").alias("article_hash"), "score"), "article_hash")


def hits(offers: DataFrame, articles: DataFrame, r: SearchRequest, ranking: DataFrame | None = None) -> DataFrame:
    """A page of hits; the score shows only where relevance of a query sorts."""
    plan = sort_plan(r.sort)
    rows = representatives(ranked_articles(offers, articles, r, ranking), plan)
    shown = F.col("score") if r.query and plan.field == "relevance" else F.lit(None).cast("double")
    page = paged(rows, final_order(plan), r.page, r.page_size)
    return page.select("id", "article_hash", "name", "resolved_price", shown.alias("score"))


def search(offers: DataFrame, articles: DataFrame, r: SearchRequest, ranking: DataFrame | None = None, sets: list[tuple[str, tuple[int, ...]]] = ()) -> dict[str, DataFrame]:
    """Result sets by the request's mode: hits, counts and summaries."""
    out = {}
    if r.mode != "SUMMARIES_ONLY":
        out["hits"] = hits(offers, articles, r, ranking)
        out["counts"] = hit_counts(filtered(offers, articles, r), r.page_size)
    if r.mode != "HITS_ONLY":
        out |= summaries(offers, articles, r, sets)
    return out


# facets


def vendor_facet(rows: DataFrame) -> DataFrame:
    """Offers per vendor; blank vendors are left out."""
    return rows.filter(F.coalesce("vendor_id", F.lit("")) != "").groupBy(F.col("vendor_id").alias("vendor")).agg(F.count("*").alias("n"))


def manufacturer_facet(rows: DataFrame) -> DataFrame:
    return rows.groupBy(F.coalesce("manufacturerName", F.lit("")).alias("manufacturer")).agg(F.count("*").alias("n"))


def feature_values(rows: DataFrame) -> DataFrame:
    """(name, value, n, total): offers per value, and offers that have the name at all.

    A name counts once per offer by the distinct names of its tokens, so no offer
    id is shuffled.
    """
    own = lambda t: F.regexp_extract(t, "(?s)^([^=]+)=(.*)$", 1)
    token = rows.select(F.explode("features").alias("t")).filter(F.col("t").rlike("(?s)^[^=]+="))
    values = token.groupBy(own(F.col("t")).alias("name"), F.regexp_extract("t", "(?s)^([^=]+)=(.*)$", 2).alias("value")).agg(F.count("*").alias("n"))
    names = rows.select(F.explode(F.array_distinct(F.transform("features", own))).alias("name")).filter("name <> ''")
    return values.join(names.groupBy("name").agg(F.count("*").alias("total")), "name")


def feature_facet(rows: DataFrame, most: int = 100) -> DataFrame:
    """The most frequent names with their values nested in order."""
    nested = feature_values(rows).groupBy("name", "total").agg(
        F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), F.col("value").alias("value")))), lambda s: F.struct(s["value"].alias("value"), (-s["m"]).alias("n"))).alias("values")
    )
    return nested.orderBy(F.desc("total"), F.asc("name")).limit(most)


def price_facet(rows: DataFrame, currency: str) -> DataFrame:
    priced = rows.filter("resolved_price is not null")
    return priced.groupBy(F.lit(currency.upper()).alias("currency")).agg(F.min("resolved_price").alias("low"), F.max("resolved_price").alias("high"))


def category_facet(articles: DataFrame, path: tuple[str, ...]) -> DataFrame:
    """(place, path, n) of distinct articles: siblings at the path's depth and children below it; empty without a path."""
    depth = len(path)
    if not 1 <= depth <= 5:
        return articles.select(F.lit("").alias("place"), F.lit("").alias("path"), F.lit(0).cast("long").alias("n")).limit(0)
    parent, own = PATH.join(path[:-1]), PATH.join(path)

    def level(d: int, prefix: str, place: str) -> DataFrame:
        rows = articles.select("article_hash", F.explode(f"category_l{d}").alias("path")).filter(starts_with_path(F.col("path"), prefix))
        return rows.groupBy(F.lit(place).alias("place"), "path").agg(F.countDistinct("article_hash").alias("n"))

    same = level(depth, parent, "same")
    return same.unionByName(level(depth + 1, own, "child")) if depth < 5 else same


def with_offer_counts(articles: DataFrame, offers: DataFrame) -> DataFrame:
    """Articles with how many offers they have; 1 where none is known."""
    counts = offers.groupBy("article_hash").agg(F.count("*").alias("_n"))
    return articles.join(counts, "article_hash", "left").withColumn("_n", F.coalesce("_n", F.lit(1)))


def class_facet(articles: DataFrame, offers: DataFrame, column: str, selected: int | None) -> DataFrame:
    """(place, code, n): roots as children of 0, else siblings and children of the selected code, by offers."""
    empty = articles.select(F.lit("").alias("place"), F.lit(0).alias("code"), F.lit(0).cast("long").alias("n")).limit(0)
    if selected is None:
        return empty
    code = F.col("code")
    rows = with_offer_counts(articles, offers).select("_n", F.explode(F.array_distinct(column)).alias("code"))
    depth = code_depth(code)
    if selected == 0:
        rows = rows.filter(depth == 1).withColumn("place", F.lit("child"))
    else:
        s = F.lit(selected)
        sibling = (depth == code_depth(s)) & (code_parent(s).isNull() | (code_parent(code) == code_parent(s)))
        child = (depth == code_depth(s) + 1) & (code_parent(code) == s)
        rows = rows.withColumn("place", F.when(sibling, "same").when(child, "child")).filter("place is not null")
    return rows.groupBy("place", "code").agg(F.sum("_n").alias("n"))


def set_facet(articles: DataFrame, offers: DataFrame, sets: list[tuple[str, tuple[int, ...]]]) -> DataFrame:
    """(set, n): offers of articles with any code of the set; an empty set has 0. One pass for all sets."""
    rows = with_offer_counts(articles, offers)
    if not sets:
        return rows.select(F.lit("").alias("set"), F.col("_n").cast("long").alias("n")).limit(0)
    tests = {name: predicates.overlaps("s2class_code", tuple(codes), "int") if codes else F.lit(False) for name, codes in sets}
    sums = rows.agg(*(F.coalesce(F.sum(F.when(t, F.col("_n"))), F.lit(0)).alias(f"s{i}") for i, t in enumerate(tests.values())))
    pairs = F.array(*(F.struct(F.lit(n).alias("set"), F.col(f"s{i}").cast("long").alias("n")) for i, n in enumerate(tests)))
    return sums.select(F.explode(pairs).alias("x")).select("x.*")


FACET_COLUMNS = ("article_hash", "vendor_id", "manufacturerName", "features", "resolved_price", "category_l1", "category_l2", "category_l3", "category_l4", "category_l5", "eclass5_code", "eclass7_code", "s2class_code")


def facet_base(offers: DataFrame, articles: DataFrame, r: SearchRequest) -> tuple[DataFrame, dict[str, Column]]:
    """Rows that fail one facet filter at most, read and joined once, and what passes each filter."""
    makers = {"vendor": predicates.vendors, "manufacturer": predicates.manufacturers, "category": predicates.category, "s2class": predicates.s2class}
    tests = {n: t for n, f in makers.items() if (t := f(r)) is not None}
    rows = filtered(offers, articles, r, tuple(makers))
    rows = rows.withColumns({f"_{n}": F.coalesce(t, F.lit(False)) for n, t in tests.items()})
    if tests:
        failed = sum(((~F.col(f"_{n}")).cast("int") for n in tests), start=F.lit(0))
        rows = rows.filter(failed <= 1)
    return rows.select(*FACET_COLUMNS, *(f"_{n}" for n in tests)), {n: F.col(f"_{n}") for n in tests}


def summaries(offers: DataFrame, articles: DataFrame, r: SearchRequest, sets: list[tuple[str, tuple[int, ...]]] = ()) -> dict[str, DataFrame]:
    """All facets; a facet over a filtered field leaves that filter out. Offers and articles are joined once for all of them."""
    base, tests = facet_base(offers, articles, r)
    base = cut(base)

    def less(name: str = "") -> DataFrame:
        test = predicates.all_of([t for n, t in tests.items() if n != name])
        return base if test is None else base.filter(test)

    rows = less()
    one_per_article = lambda rows: rows.dropDuplicates(["article_hash"])
    return {
        "vendors": vendor_facet(less("vendor")),
        "manufacturers": manufacturer_facet(less("manufacturer")),
        "features": feature_facet(rows),
        "prices": price_facet(rows, r.currency),
        "categories": category_facet(one_per_article(less("category")), r.category_path),
        "platform_categories": category_facet(one_per_article(less("category")), r.category_path),
        "eclass5": class_facet(one_per_article(rows), rows, "eclass5_code", r.eclass5),
        "eclass7": class_facet(one_per_article(rows), rows, "eclass7_code", r.eclass7),
        "s2class": class_facet(one_per_article(less("s2class")), less("s2class"), "s2class_code", r.s2class),
        "sets": set_facet(one_per_article(rows), rows, list(sets)),
    }


def disjunctive_counts(base: DataFrame, tests: dict[str, Column], keys: dict[str, str]) -> DataFrame:
    """(facet, value, n) with each facet counted under all filters but its own, in one pass.

    Rows that fail no filter count for all facets, those that fail just one count
    for that one; no facet scans the base again.
    """
    entries = []
    for name, key in keys.items():
        others = [t for n, t in tests.items() if n != name]
        ok = predicates.all_of(others)
        entries.append(F.when(F.lit(True) if ok is None else ok, F.struct(F.lit(name).alias("facet"), F.col(key).cast("string").alias("value"))))
    rows = base.select(F.explode(F.filter(F.array(*entries), lambda x: x.isNotNull())).alias("x")).select("x.*")
    return rows.groupBy("facet", "value").agg(F.count("*").alias("n"))


#: Names of the legacy response's summaries, by those of the engine.
LEGACY_SUMMARIES = {"vendors": "vendorSummaries", "manufacturers": "manufacturerSummaries", "features": "featureSummaries", "prices": "pricesSummary", "categories": "categoriesSummary", "eclass5": "eClass5Categories", "eclass7": "eClass7Categories", "s2class": "s2ClassCategories", "sets": "eClassesAggregations"}


def to_legacy(hits: DataFrame, rank: str = "rank", explain: bool = False) -> DataFrame:
    """Hits (id, rank) as legacy articles: converted ids, the first of equal ones, in order; scores are not told."""
    first = hits.withColumn("articleId", legacy_offer_id(F.col("id"))).groupBy("articleId").agg(F.min(rank).alias(rank))
    out = first.orderBy(rank)
    return out.select("articleId", F.lit("N/A").alias("explanation"), rank) if explain else out.select("articleId", rank)


def legacy_response(found: dict[str, DataFrame], r: SearchRequest, explain: bool = False) -> dict[str, DataFrame]:
    """A legacy response of the result sets of search(): articles, metadata, and the summaries that it knows under its names."""
    out = {}
    if "hits" in found:
        placed = found["hits"].withColumn("rank", F.monotonically_increasing_id())
        out["articles"] = to_legacy(placed, explain=explain).drop("rank")
    if "counts" in found:
        pages = F.greatest(F.lit(1), F.col("pages"))
        out["metadata"] = found["counts"].select(F.lit(r.page).alias("page"), F.lit(r.page_size).alias("pageSize"), pages.alias("pageCount"), F.lit(r.query).alias("term"), F.col("hits").alias("hitCount"))
    for name, legacy in LEGACY_SUMMARIES.items():
        if name in found:
            rows = found[name]
            out[legacy] = rows.select(F.col("set").alias("id"), F.col("n").alias("count")) if name == "sets" else rows
    return out
