"""Filter algebra of a request as column predicates.

Each function gives a Column, or None where the request does not filter. Array
columns are coalesced to empty, so a missing array never makes a filter null.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.ids import PATH_ESCAPE, PATH_SEPARATOR
from ..functions.prices import CATALOG_CURRENCIES, decode_minor_units
from .request import ECLASS_FIELDS, BlockedClasses, SearchRequest


def all_of(parts: list[Column | None]) -> Column | None:
    kept = [p for p in parts if p is not None]
    return reduce(lambda a, b: a & b, kept) if kept else None


def any_of(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, parts)


def overlaps(name: str, values: tuple, kind: str = "string") -> Column:
    own = F.coalesce(F.col(name), F.array().cast(f"array<{kind}>"))
    return F.arrays_overlap(own, F.array(*(F.lit(v).cast(kind) for v in values)))


def contains(name: str, value, kind: str = "string") -> Column:
    return overlaps(name, (value,), kind)


def vendors(r: SearchRequest) -> Column | None:
    return F.col("vendor_id").isin(*r.vendors) if r.vendors else None


def article_ids(r: SearchRequest) -> Column | None:
    """Whole ids are matched, ids of fewer than three parts are prefixes."""
    if not r.article_ids:
        return None
    whole = [i for i in r.article_ids if i.count(":") >= 2]
    tests = [F.col("id").startswith(i) for i in r.article_ids if i.count(":") < 2]
    return any_of(tests + ([F.col("id").isin(*whole)] if whole else []))


def manufacturers(r: SearchRequest) -> Column | None:
    return F.col("manufacturerName").isin(*r.manufacturers) if r.manufacturers else None


def delivery_time(r: SearchRequest) -> Column | None:
    return F.col("delivery_time_days_max") <= r.max_delivery_time if r.max_delivery_time > 0 else None


def features(r: SearchRequest) -> Column | None:
    """All names, any value of each; names without values do not filter."""
    return all_of([overlaps("features", tuple(f"{name}={v}" for v in values)) for name, values in r.features if values])


def category(r: SearchRequest) -> Column | None:
    depth = len(r.category_path)
    if not 1 <= depth <= 5:
        return None
    return contains(f"category_l{depth}", PATH_SEPARATOR.join(e.replace(PATH_SEPARATOR, PATH_ESCAPE) for e in r.category_path))


def s2class(r: SearchRequest) -> Column | None:
    """Only the current s2 class drills down; the other classifications never filter."""
    return contains("s2class_code", r.s2class, "int") if r.s2class else None


def eclasses(r: SearchRequest) -> Column | None:
    return overlaps("s2class_code", r.eclasses, "int") if r.eclasses else None


def catalog_versions(r: SearchRequest) -> Column | None:
    """Without catalog versions or price lists nothing matches."""
    s = r.sources
    scope = s.closed_catalog_versions if r.closed_only else s.catalog_versions
    if not s.catalog_versions or not s.price_lists or not scope:
        return F.lit(False)
    return F.col("catalog_version_id").isin(*scope)


def matches_nothing(r: SearchRequest) -> bool:
    s = r.sources
    return not s.catalog_versions or not s.price_lists or (r.closed_only and not s.closed_catalog_versions)


def relationships(r: SearchRequest) -> Column | None:
    named = (("accessory_for", r.accessory_for), ("spare_part_for", r.spare_part_for), ("similar_to", r.similar_to))
    return all_of([contains(f"relationship_{n}", v) for n, v in named if v])


def _core(r: SearchRequest) -> Column | None:
    base, own = r.sources.closed_catalog_versions, r.sources.uploaded_core_lists
    if not base and not own:
        return None
    in_base = overlaps("core_marker_enabled_sources", base) if base else None
    if not own:
        return in_base
    in_own = overlaps("core_marker_enabled_sources", own)
    return in_own if in_base is None else in_own | (in_base & ~overlaps("core_marker_disabled_sources", own))


def core_only(r: SearchRequest) -> Column | None:
    return _core(r) if r.core_only else None


def core_vendors(r: SearchRequest) -> Column | None:
    """Listed vendors show only their core articles."""
    core = _core(r) if r.core_vendors else None
    return None if core is None else ~F.col("vendor_id").isin(*r.core_vendors) | core


def _blocked(b: BlockedClasses) -> Column | None:
    if not b.blocked or not b.vendors:
        return None
    name = ECLASS_FIELDS[b.version]
    hit = overlaps(name, b.blocked, "int")
    if b.allowed:
        hit &= ~overlaps(name, b.allowed, "int")
    return ~F.col("vendor_id").isin(*b.vendors) | ~hit


def blocked_classes(r: SearchRequest) -> Column | None:
    """A vendor's blocked classes; it needs offer and article columns, so it stands after their join."""
    return all_of([_blocked(b) for b in r.blocked])


def price_lists(r: SearchRequest) -> Column | None:
    return overlaps("price_list_ids", r.sources.price_lists) if r.has_price_filter and r.sources.price_lists else None


def price_band(r: SearchRequest) -> Column | None:
    """Envelope against the bounds: implied by the exact price filter, it lets the scan prune."""
    ccy = r.currency.lower()
    if ccy not in CATALOG_CURRENCIES:
        return None
    bound = r.price_currency or r.currency
    low = None if r.price_min is None else F.col(f"{ccy}_price_max") >= float(decode_minor_units(r.price_min, bound))
    high = None if r.price_max is None else F.col(f"{ccy}_price_min") <= float(decode_minor_units(r.price_max, bound))
    return all_of([high, low])


def article_side(r: SearchRequest, exclude: tuple[str, ...] = ()) -> Column | None:
    parts = {"manufacturer": manufacturers, "category": category, "s2class": s2class, "eclasses": eclasses}
    return all_of([f(r) for n, f in parts.items() if n not in exclude])


def offer_side(r: SearchRequest, exclude: tuple[str, ...] = ()) -> Column | None:
    parts = {
        "vendor": vendors,
        "article_ids": article_ids,
        "delivery": delivery_time,
        "features": features,
        "catalog": catalog_versions,
        "relationships": relationships,
        "core": core_only,
        "core_vendors": core_vendors,
        "price_lists": price_lists,
        "price_band": price_band,
    }
    return all_of([f(r) for n, f in parts.items() if n not in exclude])


def everything(r: SearchRequest, exclude: tuple[str, ...] = ()) -> Column:
    """All filters over offers joined to their articles."""
    found = all_of([article_side(r, exclude), offer_side(r, exclude), blocked_classes(r)])
    return F.lit(True) if found is None else found


def one_offer_of(offers: str, vendor: tuple[str, ...] = (), delivery: int | None = None, currency: str | None = None, low: float | None = None, high: float | None = None) -> Column:
    """Nested form: a single element of an offers array satisfies all, with any of its prices in range."""
    def fits(o: Column) -> Column:
        tests = [F.lit(True)]
        if vendor:
            tests.append(o["vendor_id"].isin(*vendor))
        if delivery is not None:
            tests.append(o["delivery_time_days_max"] <= delivery)
        if currency or low is not None or high is not None:
            def priced(p: Column) -> Column:
                inner = [F.lit(True)]
                if currency:
                    inner.append(p["currency"] == currency)
                if low is not None:
                    inner.append(p["price"] >= low)
                if high is not None:
                    inner.append(p["price"] <= high)
                return reduce(lambda a, b: a & b, inner)

            tests.append(F.exists(o["prices"], priced))
        return reduce(lambda a, b: a & b, tests)

    return F.exists(F.col(offers), fits)


def hash_chunk(key: str, chunks: int, chunk: int) -> Column:
    """One of disjoint parts of the rows by a hash of the key."""
    return F.pmod(F.xxhash64(key), F.lit(chunks)) == chunk
