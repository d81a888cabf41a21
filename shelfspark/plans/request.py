"""Search requests: a checked value object, sort and paging parameters, legacy mapping."""

from __future__ import annotations

import re
from dataclasses import dataclass, field, fields, replace

SORT_FIELDS = {"articleId", "name", "price"}
SEARCH_MODES = ("HITS_ONLY", "SUMMARIES_ONLY", "BOTH")
RETRIEVAL_MODES = ("vector", "bm25", "hybrid", "hybrid_classified")
ECLASS_FIELDS = {"ECLASS_5_1": "eclass5_code", "ECLASS_7_1": "eclass7_code", "S2CLASS": "s2class_code"}


@dataclass(frozen=True)
class ArticleSources:
    catalog_versions: tuple[str, ...] = ()
    closed_catalog_versions: tuple[str, ...] = ()
    price_lists: tuple[str, ...] = ()
    uploaded_core_lists: tuple[str, ...] = ()


@dataclass(frozen=True)
class BlockedClasses:
    """Codes that the listed vendors may not show; allowed codes lift the block."""

    version: str
    vendors: tuple[str, ...]
    blocked: tuple[int, ...]
    allowed: tuple[int, ...] = ()


@dataclass(frozen=True)
class SortPlan:
    field: str = "relevance"
    descending: bool = True


@dataclass(frozen=True)
class SearchRequest:
    """All filters of a search; what is empty does not filter."""

    query: str = ""
    vector: tuple[float, ...] = ()
    vendors: tuple[str, ...] = ()
    article_ids: tuple[str, ...] = ()
    manufacturers: tuple[str, ...] = ()
    max_delivery_time: int = 0
    features: tuple[tuple[str, tuple[str, ...]], ...] = ()
    category_path: tuple[str, ...] = ()
    s2class: int | None = None
    eclass5: int | None = None
    eclass7: int | None = None
    eclasses: tuple[int, ...] = ()
    sources: ArticleSources = field(default_factory=ArticleSources)
    closed_only: bool = False
    accessory_for: str | None = None
    spare_part_for: str | None = None
    similar_to: str | None = None
    core_only: bool = False
    core_vendors: tuple[str, ...] = ()
    blocked: tuple[BlockedClasses, ...] = ()
    currency: str = "EUR"
    price_min: int | None = None
    price_max: int | None = None
    price_currency: str | None = None
    price_filter: bool = False
    page: int = 1
    page_size: int = 24
    sort: tuple[str, ...] = ()
    mode: str = "HITS_ONLY"
    retrieval: str = "hybrid_classified"

    def __post_init__(self) -> None:
        for f in fields(self):  # null lists are empty lists
            if getattr(self, f.name) is None and f.default == ():
                object.__setattr__(self, f.name, ())
        if not re.fullmatch("[A-Z]{3}", self.currency):
            raise ValueError("currency is three capital letters")
        if self.page < 1 or not 0 <= self.page_size <= 500:
            raise ValueError("page is at least 1 and page_size 0 to 500")
        if self.max_delivery_time < 0:
            raise ValueError("max_delivery_time is not negative")
        if self.mode not in SEARCH_MODES or self.retrieval not in RETRIEVAL_MODES:
            raise ValueError("unknown mode")
        for b in self.blocked:
            if b.version not in ECLASS_FIELDS:
                raise ValueError(f"unknown classification {b.version!r}")
        sort_plan(self.sort)

    @property
    def has_price_filter(self) -> bool:
        return self.price_filter or self.price_min is not None or self.price_max is not None

    def without(self, **names: object) -> SearchRequest:
        return replace(self, **names)


def request_from(values: dict) -> SearchRequest:
    """Request of a mapping; unknown keys are refused."""
    known = {f.name for f in fields(SearchRequest)}
    if strange := set(values) - known:
        raise ValueError(f"unknown keys: {', '.join(sorted(strange))}")
    return SearchRequest(**values)


def sort_plan(clauses: tuple[str, ...]) -> SortPlan:
    """Only the first clause "field,direction" sorts; none is relevance from the best down."""
    parsed = []
    for c in clauses:
        name, _, way = c.partition(",")
        if name not in SORT_FIELDS or way not in ("", "asc", "desc"):
            raise ValueError(f"cannot sort by {c!r}")
        parsed.append(SortPlan(name, way == "desc"))
    return parsed[0] if parsed else SortPlan()


def rank_limit(plan: SortPlan, page: int, page_size: int, pool: int = 1000, wide: int = 16384) -> int:
    """How many ranked articles a page needs: a pool for relevance, all that may be sorted otherwise."""
    return max(pool, page * page_size) if plan.field == "relevance" else wide


#: Legacy names of request fields; those not listed are dropped.
LEGACY_FIELDS = {
    "searchQuery": "query",
    "vendorIdsFilter": "vendors",
    "articleIdsFilter": "article_ids",
    "manufacturersFilter": "manufacturers",
    "maxDeliveryTime": "max_delivery_time",
    "currentCategoryPathElements": "category_path",
    "currentS2ClassCode": "s2class",
    "eClassesFilter": "eclasses",
    "closedMarketplaceOnly": "closed_only",
    "accessoriesForArticleNumber": "accessory_for",
    "sparePartsForArticleNumber": "spare_part_for",
    "similarToArticleNumber": "similar_to",
    "coreSortimentOnly": "core_only",
    "coreArticlesVendorsFilter": "core_vendors",
    "currency": "currency",
    "page": "page",
    "pageSize": "page_size",
    "sort": "sort",
    "searchMode": "mode",
}


def from_legacy(values: dict, vendor_id=lambda v: v) -> SearchRequest:
    """Engine request of a legacy one: fields renamed, vendor ids converted, null lists emptied."""
    out = {}
    for old, new in LEGACY_FIELDS.items():
        if values.get(old) is not None:
            v = values[old]
            out[new] = tuple(v) if isinstance(v, list) else v
    for name in ("vendors", "core_vendors"):
        if name in out:
            out[name] = tuple(vendor_id(v) for v in out[name])
    out["features"] = tuple((f["name"], tuple(f.get("values") or ())) for f in values.get("requiredFeatures") or ())
    s = values.get("selectedArticleSources") or {}
    out["sources"] = ArticleSources(
        tuple(s.get("catalogVersionIdsOrderedByPreference") or ()),
        tuple(s.get("closedCatalogVersionIds") or ()),
        tuple(s.get("sourcePriceListIds") or ()),
        tuple(s.get("customerUploadedCoreArticleListSourceIds") or ()),
    )
    if p := values.get("priceFilter"):
        out |= {"price_filter": True, "price_min": p.get("min"), "price_max": p.get("max"), "price_currency": p.get("currencyCode")}
    return SearchRequest(**out)


@dataclass(frozen=True)
class SearchParameters:
    """Limits of the plain search; candidates are never fewer than the hits asked for."""

    k: int = 24
    dense_limit: int = 200
    codes_limit: int = 200
    strict_limit: int = 50
    num_candidates: int = 500
    rrf_k: int = 60
    fallback: bool = True

    def __post_init__(self) -> None:
        if self.num_candidates < max(self.k, self.dense_limit):
            raise ValueError("num_candidates is at least the limit")
