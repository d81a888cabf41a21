"""Catalog materialisation: raw collections to flat rows, offers and articles.

Offers join the pre-grouped prices, markers and customer numbers on (vendor,
article number) in one shuffle per side; everything after it is per row until the
one aggregation by article hash, whose aggregates merge on the map side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ids, prices, taxonomy

#: Capacities of the target tables.
MAX_RELATED, MAX_MARKERS, MAX_CODES = 4096, 64, 8192

BIN = "string"
DETAILS = "struct<sourcePriceListId:string,type:string,prices:struct<staggeredPrices:array<struct<minQuantity:string,price:string>>,currencyCode:string>,dailyPrice:boolean,priceQuantity:string>"
OFFER_SCHEMA = (
    "articleNumber string, vendorId string, catalogVersionId string, offer struct<offerParams:struct<name:string,"
    "features:array<struct<name:string,values:array<string>,unit:string,description:string>>,eclassGroups:map<string,array<int>>,"
    "categoryPaths:array<struct<elements:array<string>>>,ean:string,manufacturerName:string,customerArticleNumber:string,deliveryTime:string,"
    "description:string,manufacturerArticleNumber:string,manufacturerArticleType:string>,"
    f"pricings:struct<open:{DETAILS},closed:{DETAILS}>,"
    "relatedArticleNumbers:struct<sparePartFor:array<string>,accessoryFor:array<string>,similarTo:array<string>>>"
)
PRICING_SCHEMA = f"articleNumber string, vendorId string, pricingDetails {DETAILS}"
MARKER_SCHEMA = "articleNumber string, vendorId string, coreArticleListSourceId string, coreArticleMarker boolean"
CAN_SCHEMA = "articleNumber string, vendorId string, customerArticleNumbersListVersionId string, customerArticleNumber string"
WRAPPER_SCHEMA = f"records array<struct<offer:struct<{OFFER_SCHEMA}>,pricings:array<struct<{PRICING_SCHEMA}>>,markers:array<struct<{MARKER_SCHEMA}>>,customerArticleNumbers:array<struct<{CAN_SCHEMA}>>>>"


def grouped(rows: DataFrame, name: str, entry: Column, keep: Column | None = None) -> DataFrame:
    """Sorted list of entries per (vendor, article number)."""
    rows = rows if keep is None else rows.filter(keep)
    return rows.groupBy(F.col("vendorId"), F.col("articleNumber")).agg(F.array_sort(F.collect_list(entry)).alias(name))


def joined(offers: DataFrame, pricings: DataFrame, markers: DataFrame, cans: DataFrame) -> DataFrame:
    """Offers with the lists of their prices, markers and customer numbers, empty where there are none."""
    sides = [
        grouped(pricings, "joined_prices", prices.project_pricing(F.col("pricingDetails"))),
        grouped(markers, "joined_markers", F.struct(ids.uuid_str(F.col("coreArticleListSourceId")).alias("source"), F.col("coreArticleMarker").alias("core")), F.col("coreArticleListSourceId").isNotNull()),
        grouped(cans, "joined_cans", F.struct(F.col("customerArticleNumber").alias("value"), ids.uuid_str(F.col("customerArticleNumbersListVersionId")).alias("version_id")), (F.col("customerArticleNumber") != "") & F.col("customerArticleNumbersListVersionId").isNotNull()),
    ]
    for side in sides:
        offers = offers.join(side, ["vendorId", "articleNumber"], "left")
    return offers


def _markers(core: bool) -> Column:
    own = F.filter(F.coalesce("joined_markers", F.array().cast("array<struct<source:string,core:boolean>>")), lambda m: F.coalesce(m["core"] == core, F.lit(False)))
    return F.slice(F.array_sort(F.array_distinct(F.transform(own, lambda m: m["source"]))), 1, MAX_MARKERS)


def merge_numbers(pairs: Column) -> Column:
    """Pairs of value and version as distinct values in order, each with its sorted versions."""
    values = F.array_sort(F.array_distinct(F.transform(pairs, lambda p: p["value"])))
    return F.transform(
        values,
        lambda v: F.struct(
            v.alias("value"),
            F.array_sort(F.array_distinct(F.transform(F.filter(pairs, lambda p: p["value"] == v), lambda p: p["version_id"]))).alias("version_ids"),
        ),
    )


def flat_rows(offers: DataFrame, mapping: Column | None = None, versions: tuple[str, ...] = ("ECLASS_7_1", "ECLASS_5_1")) -> DataFrame:
    """One row per offer with the columns of the two target tables.

    offers: the result of joined(); mapping: map column of s2class(), the versions
    from the highest down.
    """
    p, o = F.col("offer.offerParams"), F.col("offer")
    none = F.array().cast("array<struct<elements:array<string>>>")
    paths = F.coalesce(p["categoryPaths"], none)
    codes = lambda key: F.try_element_at(p["eclassGroups"], F.lit(key))
    vendor, version = ids.uuid_str(F.col("vendorId")), ids.uuid_str(F.col("catalogVersionId"))
    own = F.when((p["customerArticleNumber"] != "") & version.isNotNull(), F.array(F.struct(p["customerArticleNumber"].alias("value"), version.alias("version_id"))))
    pair = "array<struct<value:string,version_id:string>>"
    entry = "array<struct<price:double,currency:string,priority:int,sourcePriceListId:string>>"
    every = F.concat(F.array(prices.project_pricing(o["pricings"]["open"]), prices.project_pricing(o["pricings"]["closed"])).cast(entry), F.coalesce("joined_prices", F.array().cast(entry)))
    related = lambda n: F.slice(F.coalesce(o["relatedArticleNumbers"][n], F.array().cast("array<string>")), 1, MAX_RELATED)
    text = lambda n: F.coalesce(p[n], F.lit(""))
    empty_map = F.create_map().cast("map<string,array<int>>")
    return offers.select(
        ids.offer_key(vendor, F.col("articleNumber"), version).alias("id"),
        vendor.alias("vendor_id"),
        F.col("articleNumber").alias("article_number"),
        version.alias("catalog_version_id"),
        text("name").alias("name"),
        text("manufacturerName").alias("manufacturerName"),
        text("ean").alias("ean"),
        *(taxonomy.category_level(paths, d).alias(f"category_l{d}") for d in range(1, 6)),
        F.filter(every, lambda x: x.isNotNull()).alias("prices"),
        F.coalesce(taxonomy.unwrap_int(p["deliveryTime"]), F.lit(0)).cast("int").alias("delivery_time_days_max"),
        _markers(True).alias("core_marker_enabled_sources"),
        _markers(False).alias("core_marker_disabled_sources"),
        taxonomy.expand_codes(codes("ECLASS_5_1")).alias("eclass5_code"),
        taxonomy.expand_codes(codes("ECLASS_7_1")).alias("eclass7_code"),
        taxonomy.s2class([(v, codes(v)) for v in versions], empty_map if mapping is None else mapping).alias("s2class_code"),
        taxonomy.feature_tokens(p["features"]).alias("features"),
        related("accessoryFor").alias("relationship_accessory_for"),
        related("sparePartFor").alias("relationship_spare_part_for"),
        related("similarTo").alias("relationship_similar_to"),
        merge_numbers(F.concat(F.coalesce("joined_cans", F.array().cast(pair)), F.coalesce(own, F.array().cast(pair)))).alias("customer_article_numbers"),
        ids.article_hash(p["name"], p["manufacturerName"], p["description"], paths, p["ean"], F.col("articleNumber"), p["manufacturerArticleNumber"], p["manufacturerArticleType"]).alias("article_hash"),
    )


ARTICLE_ONLY = ("name", "manufacturerName", "category_l1", "category_l2", "category_l3", "category_l4", "category_l5", "eclass5_code", "eclass7_code", "s2class_code", "customer_article_numbers")


def offer_table(flat: DataFrame) -> DataFrame:
    """Offer columns with price lists, currencies and the envelope of each catalogue currency."""
    out = flat.drop(*ARTICLE_ONLY)
    bounds = {f"{c}_price_{end}": prices.envelope(F.col("prices"), c)[i] for c in prices.CATALOG_CURRENCIES for i, end in enumerate(("min", "max"))}
    return out.withColumns({"price_list_ids": prices.price_list_ids(F.col("prices")), "currencies": prices.currencies(F.col("prices"))} | bounds)


def article_table(flat: DataFrame) -> DataFrame:
    """One row per article hash: invariants of the least offer id, codes text, merged numbers, envelopes.

    One aggregation: envelopes are per-row bounds whose minimum and maximum merge,
    so prices are never exploded.
    """
    ccys = prices.CATALOG_CURRENCIES
    rows = flat.withColumns({f"_{c}_{i}": prices.envelope(F.col("prices"), c)[i] for c in ccys for i in (0, 1)})
    first = F.min_by(F.struct(*ARTICLE_ONLY[:-1]), F.col("id"))
    seen = lambda c: F.array_sort(F.collect_set(F.when(F.col(c) != "", F.col(c))))
    pairs = F.flatten(F.transform("customer_article_numbers", lambda n: F.transform(n["version_ids"], lambda v: F.struct(n["value"].alias("value"), v.alias("version_id")))))
    found = rows.groupBy("article_hash").agg(
        first.alias("a"),
        seen("ean").alias("eans"),
        seen("article_number").alias("numbers"),
        F.array_distinct(F.flatten(F.collect_set(pairs))).alias("pairs"),
        *(F.min(f"_{c}_0").alias(f"{c}_price_min") for c in ccys),
        *(F.max(f"_{c}_1").alias(f"{c}_price_max") for c in ccys),
    )
    head = F.filter(F.array("a.name", "a.manufacturerName"), lambda x: F.coalesce(x, F.lit("")) != "")
    codes = F.substring(F.array_join(F.concat(head, F.col("eans"), F.col("numbers")), " "), 1, MAX_CODES)
    return found.select("article_hash", "a.*", codes.alias("text_codes"), merge_numbers(F.col("pairs")).alias("customer_article_numbers"), *(f"{c}_price_{e}" for c in ccys for e in ("min", "max")))
