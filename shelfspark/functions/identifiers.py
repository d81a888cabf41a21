"""Shape tests of identifiers: strict ids, EAN and part numbers, GTIN checksum, spec tokens."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Shapes of opaque identifiers, and generic tokens that have such a shape.
STRICT_PATTERNS = (
    r"\d{8}",
    r"\d{12,14}",
    r"(?=.{7,}$)(?=(?:[^\d]*\d){3,})[a-z0-9]+(?:-[a-z0-9]+)+",
    r"(?=.{7,}$)[a-z]+\d{4,}[a-z0-9]*",
)
GENERIC_TOKENS = (
    "cr2032", "cr2025", "cr2016", "cr1632", "cr1620",
    "lr44", "lr41", "lr1130", "sr44", "sr41",
    "rj45", "rj11", "rj12",
    "usb-c", "usb-a", "usb-b", "hdmi", "displayport", "vga", "dvi-d",
    "cat5", "cat5e", "cat6", "cat6a", "cat7", "cat8",
    "ffp1", "ffp2", "ffp3", "n95", "n99", "kn95",
    "wd-40", "wd40",
    "m3", "m4", "m5", "m6", "m8", "m10", "m12", "m16", "m20",
    "ip54", "ip65", "ip66", "ip67", "ip68",
)
PLACEHOLDERS = ("k.a.", "n/a", "n.a.", "null", "aucune donnée", "#ref!")
#: Rules that find a technical specification in a text.
SPEC_RULES = {
    "thread_m": r"(?i)\bm\d{1,3}(?:[x×]\d+(?:[.,]\d+)?){0,2}\b",
    "g_thread": r"(?i)\bg\d+(?:/\d+)?\b",
    "dimensions": r"\b\d+(?:[.,]\d+)?[x×]\d+(?:[.,]\d+)?(?:[x×]\d+(?:[.,]\d+)?)?\b",
    "fraction": r"\b\d+/\d+\b",
    "decimal_de": r"\b\d+,\d+\b",
    "mm": r"(?i)\b\d+(?:[.,]\d+)?\s*mm\b",
    "cm": r"(?i)\b\d+(?:[.,]\d+)?\s*cm\b",
    "micrometre": r"(?i)\b\d+(?:[.,]\d+)?\s*(?:µm|um)\b",
    "cross_sect": r"(?i)\b\d+(?:[.,]\d+)?\s*mm[²2]\b",
    "inch_zoll": r"(?i)\b\d+(?:/\d+)?\s*(?:zoll|″|\")\b",
    "voltage": r"(?i)\b\d+(?:[.,]\d+)?\s*v(?:olt)?\b",
    "ampere": r"(?i)(?<![a-z0-9])\d+(?:[.,]\d+)?\s*a(?![a-z0-9])",
    "ah": r"(?i)\b\d+(?:[.,]\d+)?\s*ah\b",
    "watt": r"(?i)\b\d+(?:[.,]\d+)?\s*w(?:att)?\b",
    "hz": r"(?i)\b\d+(?:[.,]\d+)?\s*hz\b",
    "volume_l": r"(?i)(?<![a-z0-9])\d+(?:[.,]\d+)?\s*l(?![a-z0-9])",
    "mass_kg": r"(?i)\b\d+(?:[.,]\d+)?\s*kg\b",
    "pressure": r"(?i)\b\d+(?:[.,]\d+)?\s*(?:bar|psi|mpa)\b",
    "din": r"(?i)\bdin\s*\d+\b",
    "iso": r"(?i)\biso\s*\d+\b",
    "en_norm": r"(?i)\ben\s*\d{3,5}\b",
    "strength_cls": r"\b(?:[4-9]|1[0-2])\.[0-9]\b",
    "stainless": r"(?i)\b(?:1\.4\d{3}|v[24]a)\b",
    "ral_color": r"(?i)\bral\s*\d{3,4}\b",
    "ip_rating": r"(?i)\bip[\s-]?\d{2}[a-z]?\b",
    "cat_rating": r"(?i)\bcat[\s.-]?[1-7][a-z]?\b",
    "dn_nw_pn": r"(?i)\b(?:dn|nw|pn)\s*\d+\b",
    "pg_gland": r"(?i)\bpg\s*\d+\b",
    "awg": r"(?i)\bawg\s*\d+\b",
    "lumen_lux": r"(?i)\b\d+(?:[.,]\d+)?\s*(?:lm|lx|lux)\b",
    "temp_c": r"(?i)\b-?\d+(?:[.,]\d+)?\s*°?c\b",
    "atex": r"(?i)\batex\b",
    "nato_nema": r"(?i)\b(?:nato|nema)[\s-]?[a-z0-9]+\b",
}


def is_strict_identifier(q: Column) -> Column:
    """Whether a query is an opaque identifier: 4 to 40 characters of one of the shapes, not generic."""
    q = F.lower(F.trim(q))
    shaped = q.rlike("^(?:" + "|".join(f"(?:{p})" for p in STRICT_PATTERNS) + ")$")
    return shaped & F.length(q).between(4, 40) & ~q.isin(*GENERIC_TOKENS)


def is_universal_ok(v: Column) -> Column:
    junk = v.rlike("^0+$") | v.rlike("^9+$") | v.rlike(r"^[-_.\s]+$") | v.isin(*PLACEHOLDERS) | v.rlike(r"\s")
    return F.coalesce(F.length(v).between(4, 40) & ~junk, F.lit(False))


def is_ean_ok(v: Column) -> Column:
    return is_universal_ok(v) & F.coalesce(F.length(v).isin(8, 12, 13, 14), F.lit(False))


def is_mpn_ok(v: Column) -> Column:
    word = v.rlike("^[a-zäöüß]+$")
    scientific = F.contains(v, F.lit("e+")) & v.rlike(r"^[\d,.eE+\-]+$")
    return is_universal_ok(v) & F.coalesce(~word & ~scientific, F.lit(False))


def is_mpn_shaped(q: Column) -> Column:
    return q.rlike(r"(?i)^[a-z0-9][a-z0-9\-_/.]{2,}$") & q.rlike("[0-9]") & q.rlike("(?i)[a-z]")


def gtin_ok(digits: Column) -> Column:
    """Check digit of 8, 12, 13 or 14 digits; weights 3 and 1 alternate from the right of the body."""
    places = F.sequence(F.lit(1), F.greatest(F.length(digits) - 1, F.lit(1)))
    body = F.reverse(F.substring(digits, F.lit(1), F.greatest(F.length(digits) - 1, F.lit(1))))
    total = F.aggregate(places, F.lit(0), lambda a, i: a + F.coalesce(F.substring(body, i, F.lit(1)).try_cast("int"), F.lit(0)) * F.when(i % 2 == 1, 3).otherwise(1))
    check = F.right(digits, F.lit(1)).try_cast("int")
    return F.length(digits).isin(8, 12, 13, 14) & digits.rlike("^[0-9]+$") & ((10 - total % 10) % 10 == check)


def _norm_id(x: Column) -> Column:
    return F.regexp_replace(F.lower(x), r"[-_/. ]", "")


def ean_state(query: Column, ean: Column) -> Column:
    """EAN slot: the query's first digit run of EAN length against the offer's valid EAN."""
    runs = F.filter(F.regexp_extract_all(F.coalesce(query, F.lit("")), F.lit("[0-9]+"), F.lit(0)), lambda r: F.length(r).isin(8, 12, 13, 14))
    wanted = F.get(runs, F.lit(0))
    own = F.regexp_replace(F.coalesce(ean, F.lit("")), "[^0-9]", "")
    state = F.when(wanted.isNull() | ~F.coalesce(gtin_ok(own), F.lit(False)), "NONE").when(own == wanted, "MATCH").otherwise("MISMATCH")
    return F.concat(F.lit("[EAN_"), state, F.lit("]"))


def article_state(query: Column, numbers: list[Column], least: int = 4) -> Column:
    """Article slot: exact, part of, other, invalid offer ids, or no id in the query."""
    words = F.regexp_extract_all(F.coalesce(query, F.lit("")), F.lit(r"[A-Za-z0-9](?:[A-Za-z0-9._/\-]*[A-Za-z0-9])?"), F.lit(0))
    wanted = F.array_distinct(F.filter(F.transform(words, _norm_id), lambda w: (F.length(w) >= least) & w.rlike("[0-9]")))
    parts = F.flatten(F.array(*(F.split(F.coalesce(n, F.lit("")), "[,;|]") for n in numbers)))
    own = F.filter(F.transform(parts, _norm_id), lambda w: F.length(w).between(4, 32) & w.rlike("[0-9]"))
    within = F.exists(wanted, lambda w: F.exists(own, lambda o: F.contains(o, w) | F.contains(w, o)))
    state = (
        F.when(F.size(wanted) == 0, "NONE")
        .when(F.size(own) == 0, "OFFER_INVALID")
        .when(F.arrays_overlap(wanted, own), "EXACT")
        .when(within, "SUBSTRING_ONLY")
        .otherwise("MISMATCH")
    )
    return F.concat(F.lit("[ART_"), state, F.lit("]"))


def _folded(x: Column) -> Column:
    return F.regexp_replace(F.lower(x), r"\s+", "")


def spec_tokens(text: Column, rules: list[str] | None = None) -> Column:
    """Specifications in a text, by rule and then place, folded and distinct."""
    found = [F.regexp_extract_all(text, F.lit("(?U)" + SPEC_RULES[r]), F.lit(0)) for r in (rules or SPEC_RULES)]
    return F.array_distinct(F.filter(F.transform(F.flatten(F.array(*found)), _folded), lambda t: t != ""))


def spec_state(query: Column, fields: list[Column], rules: list[str] | None = None) -> Column:
    """Spec slot: whether the offer's text holds every specification of the query."""
    wanted = spec_tokens(F.coalesce(query, F.lit("")), rules)
    hay = F.concat_ws(" ", *(F.nullif(_folded(f), F.lit("")) for f in fields))
    state = F.when((F.size(wanted) == 0) | (hay == ""), "NONE").when(F.forall(wanted, lambda t: F.contains(hay, t)), "MATCH").otherwise("MISMATCH")
    return F.concat(F.lit("[SPEC_"), state, F.lit("]"))
