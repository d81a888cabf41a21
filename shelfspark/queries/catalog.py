"""Offers and articles over the test tables: line items are offers of parts by suppliers.

CATALOG is the same in SQL, to stand before the checks as common table expressions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import prices
from ..session import table

CURRENCY = {"A": "EUR", "N": "CHF", "R": "USD"}


def offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    s = lambda c: F.col(c).cast("string")
    ccy = F.when(F.col("l_returnflag") == "A", "EUR").when(F.col("l_returnflag") == "N", "CHF").otherwise("USD")
    unit = F.floor(F.col("l_extendedprice") / F.col("l_quantity") * 100) / 100.0
    listed = F.concat(F.lit("pl"), F.col("l_linestatus"))
    entry = lambda p, c, r, l: F.struct(p.alias("price"), c.alias("currency"), r.alias("priority"), l.alias("sourcePriceListId"))  # noqa: E731, E741
    mark = F.col("l_linenumber") % 3
    none = F.array().cast("array<string>")
    rows = li.select(
        F.concat_ws(":", F.concat(F.lit("v"), s("l_suppkey")), F.concat_ws("-", s("l_partkey"), s("l_orderkey"), s("l_linenumber")), F.concat(F.lit("cv"), (F.col("l_suppkey") % 5).cast("string"))).alias("id"),
        F.concat(F.lit("a"), s("l_partkey")).alias("article_hash"),
        F.concat(F.lit("v"), s("l_suppkey")).alias("vendor_id"),
        F.concat(F.lit("cv"), (F.col("l_suppkey") % 5).cast("string")).alias("catalog_version_id"),
        F.array(entry(unit, ccy, F.col("l_linenumber"), listed), entry(unit * 2, F.lit("EUR"), F.lit(2), F.lit("plX"))).alias("prices"),
        F.col("l_quantity").cast("int").alias("delivery_time_days_max"),
        F.array(F.concat(F.lit("flag="), F.col("l_returnflag")), F.concat(F.lit("status="), F.col("l_linestatus")), F.concat(F.lit("line="), s("l_linenumber"))).alias("features"),
        F.when(mark == 0, F.array(F.lit("cv1"))).when(mark == 1, F.array(F.lit("u1"))).otherwise(none).alias("core_marker_enabled_sources"),
        F.when(F.col("l_linenumber") % 2 == 0, F.array(F.lit("u1"))).otherwise(none).alias("core_marker_disabled_sources"),
        F.array(F.concat(F.lit("n"), (F.col("l_partkey") % 7).cast("string"))).alias("relationship_accessory_for"),
        F.array(F.concat(F.lit("n"), (F.col("l_partkey") % 11).cast("string"))).alias("relationship_spare_part_for"),
        F.array(F.concat(F.lit("n"), (F.col("l_partkey") % 13).cast("string"))).alias("relationship_similar_to"),
        F.col("l_shipdate").alias("shipped"),
    )
    bounds = {f"{c}_price_{e}": prices.envelope(F.col("prices"), c)[i] for c in ("eur", "chf") for i, e in enumerate(("min", "max"))}
    return rows.withColumns({"price_list_ids": prices.price_list_ids(F.col("prices")), "currencies": prices.currencies(F.col("prices"))} | bounds)


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    brand = F.regexp_extract("p_brand", "([0-9]+)", 1).cast("int")
    root, mid = (F.col("p_size") % 9 + 1) * 1_000_000, (brand % 7 + 1) * 10_000
    return p.select(
        F.concat(F.lit("a"), F.col("p_partkey").cast("string")).alias("article_hash"),
        F.col("p_name").alias("name"),
        F.col("p_brand").alias("manufacturerName"),
        F.array("p_brand").alias("category_l1"),
        F.array(F.concat_ws("¦", "p_brand", "p_type")).alias("category_l2"),
        F.array(F.concat_ws("¦", "p_brand", "p_type", F.col("p_size").cast("string"))).alias("category_l3"),
        F.array().cast("array<string>").alias("category_l4"),
        F.array().cast("array<string>").alias("category_l5"),
        F.array(root, root + mid).alias("eclass5_code"),
        F.array(root).alias("eclass7_code"),
        F.array(root, root + mid, root + mid + (F.col("p_size") % 4 + 1) * 100).alias("s2class_code"),
    )


CATALOG = """
with offers as (
  select 'v' || l_suppkey || ':' || l_partkey || '-' || l_orderkey || '-' || l_linenumber || ':cv' || (l_suppkey % 5) as id,
    'a' || l_partkey as article_hash, 'v' || l_suppkey as vendor_id, 'cv' || (l_suppkey % 5) as catalog_version_id,
    [{'price': floor(l_extendedprice / l_quantity * 100) / 100.0, 'currency': case l_returnflag when 'A' then 'EUR' when 'N' then 'CHF' else 'USD' end,
      'priority': l_linenumber, 'sourcePriceListId': 'pl' || l_linestatus},
     {'price': floor(l_extendedprice / l_quantity * 100) / 100.0 * 2, 'currency': 'EUR', 'priority': 2, 'sourcePriceListId': 'plX'}] as prices,
    cast(floor(l_quantity) as integer) as delivery_time_days_max,
    ['flag=' || l_returnflag, 'status=' || l_linestatus, 'line=' || l_linenumber] as features,
    case l_linenumber % 3 when 0 then ['cv1'] when 1 then ['u1'] else [] end as core_marker_enabled_sources,
    case when l_linenumber % 2 = 0 then ['u1'] else [] end as core_marker_disabled_sources,
    'n' || (l_partkey % 7) as accessory_for, 'n' || (l_partkey % 11) as spare_part_for, 'n' || (l_partkey % 13) as similar_to,
    l_shipdate as shipped, l_returnflag as flag, l_linestatus as status, l_linenumber as line,
    floor(l_extendedprice / l_quantity * 100) / 100.0 as unit,
    case l_returnflag when 'A' then 'EUR' when 'N' then 'CHF' else 'USD' end as ccy
  from lineitem
), articles as (
  select 'a' || p_partkey as article_hash, p_name as name, p_brand as manufacturerName, p_brand as category_l1,
    p_brand || '¦' || p_type as category_l2, p_brand || '¦' || p_type || '¦' || p_size as category_l3,
    (p_size % 9 + 1) * 1000000 as root, (p_size % 9 + 1) * 1000000 + (cast(regexp_extract(p_brand, '([0-9]+)', 1) as integer) % 7 + 1) * 10000 as mid,
    (p_size % 9 + 1) * 1000000 + (cast(regexp_extract(p_brand, '([0-9]+)', 1) as integer) % 7 + 1) * 10000 + (p_size % 4 + 1) * 100 as leaf
  from part
)
"""

#: Price that a request in EUR over the lists plO and plX resolves to: greatest priority, the first of equal ones.
RESOLVED = "case when ccy = 'EUR' and status = 'O' and line >= 2 then unit else unit * 2 end"
