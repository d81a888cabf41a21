"""Identifier expressions: UUIDs, URL-safe base64, article hashes, base62 ids."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

HASH_SEPARATOR = "\x00"
RECORD_SEPARATOR = "\x1e"
PATH_SEPARATOR = "¦"
PATH_ESCAPE = "|"
#: Fixed value: digits of the friendly id alphabet.
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def uuid_str(b64: Column) -> Column:
    """Hyphenated lower-case UUID of 16 base64-encoded bytes."""
    raw = F.lower(F.hex(F.unbase64(b64)))
    return F.regexp_replace(raw, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")


def b64url_no_pad(s: Column) -> Column:
    """URL-safe base64 of the UTF-8 bytes without padding or line breaks."""
    plain = F.regexp_replace(F.base64(F.encode(s, "UTF-8")), "[\r\n=]", "")
    return F.translate(plain, "+/", "-_")


def offer_key(vendor: Column, article_number: Column, catalog_version: Column) -> Column:
    return F.concat_ws(":", vendor, b64url_no_pad(article_number), catalog_version)


def encode_path(elements: Column) -> Column:
    """Category path with the separator escaped inside elements."""
    return F.array_join(F.transform(elements, lambda e: F.replace(e, F.lit(PATH_SEPARATOR), F.lit(PATH_ESCAPE))), PATH_SEPARATOR)


def article_hash(name: Column, maker: Column, description: Column, paths: Column, ean: Column, number: Column, maker_number: Column, maker_kind: Column) -> Column:
    """First 16 bytes, in hex, of the SHA-256 over the eight fields; paths are sorted and not escaped here."""
    filled = F.filter(paths, lambda p: F.coalesce(F.size(p["elements"]) > 0, F.lit(False)))
    joined = F.array_join(F.array_sort(F.transform(filled, lambda p: F.array_join(p["elements"], PATH_SEPARATOR))), RECORD_SEPARATOR)
    fields = [name, maker, description, joined, ean, number, maker_number, maker_kind]
    whole = F.concat_ws(HASH_SEPARATOR, *(F.coalesce(f, F.lit("")) for f in fields))
    return F.substring(F.sha2(F.encode(whole, "UTF-8"), 256), 1, 32)


def _to_base62(value: str, width: int) -> str:
    n, out = uuid.UUID(value).int, ""
    while n:
        n, digit = divmod(n, 62)
        out = BASE62[digit] + out
    return out.rjust(width, "0") or "0"


def _from_base62(value: str) -> str | None:
    n = 0
    for c in value:
        if c not in BASE62:
            return None
        n = n * 62 + BASE62.index(c)
    return str(uuid.UUID(int=n)) if value and n < 1 << 128 else None


def _guard(f, *args):
    def run(x):
        try:
            return f(x, *args) if x is not None else None
        except ValueError:
            return None

    return run


@F.pandas_udf(T.StringType())
def friendly_id(s: pd.Series) -> pd.Series:
    """Base62 of a UUID padded to 22 digits, as responses show it; null if it is no UUID."""
    return s.map(_guard(_to_base62, 22))


@F.pandas_udf(T.StringType())
def sort_id(s: pd.Series) -> pd.Series:
    """Base62 of a UUID without padding, as sort keys use it; null if it is no UUID."""
    return s.map(_guard(_to_base62, 0))


@F.pandas_udf(T.StringType())
def uuid_of_friendly(s: pd.Series) -> pd.Series:
    """UUID of a base62 id; null if it is none."""
    return s.map(_guard(_from_base62))


def legacy_sort_key(offer_id: Column) -> Column:
    """vendor:number with the vendor in base62, or the id itself where the vendor is no UUID."""
    parts = F.split(offer_id, ":")
    vendor = sort_id(F.get(parts, F.lit(0)))
    return F.when((F.size(parts) >= 2) & vendor.isNotNull(), F.concat_ws(":", vendor, F.get(parts, F.lit(1)))).otherwise(offer_id)


def looks_base64url(token: Column) -> Column:
    """Whether a token is what b64url_no_pad gives for some printable text that is no bare number."""
    shaped = token.rlike("^[A-Za-z0-9_-]+$") & ~token.rlike("^[0-9]+$") & (F.length(token) % 4 != 1)
    raw = F.unbase64(F.concat(F.translate(token, "-_", "+/"), F.repeat(F.lit("="), (4 - F.length(token) % 4) % 4)))
    text = F.try_validate_utf8(raw.cast("string"))
    return F.when(shaped, F.coalesce(text.rlike(r"^[[^\p{C}\p{Z}] ]+$") & (b64url_no_pad(text) == token), F.lit(False))).otherwise(False)


def legacy_offer_id(offer_id: Column) -> Column:
    """friendly(vendor):base64url(number) for an engine offer id of three parts; other ids are left as they are."""
    parts = F.split(offer_id, ":")
    friendly = friendly_id(F.get(parts, F.lit(0)))
    number = F.get(parts, F.lit(1))
    token = F.when(looks_base64url(number), number).otherwise(b64url_no_pad(number))
    return F.when((F.size(parts) == 3) & friendly.isNotNull(), F.concat_ws(":", friendly, token)).otherwise(offer_id)
