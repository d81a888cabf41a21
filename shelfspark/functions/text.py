"""Text expressions: normalisation, markup removal, templates, similarity."""

from __future__ import annotations

import html
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed value: white space by Unicode, as stripped from both ends.
_BLANKS = " \t\n\x0b\f\r\x1c\x1d\x1e\x1f\x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def _strip(x: Column) -> Column:
    return F.btrim(x, F.lit(_BLANKS))


def normalize_text(x: Column) -> Column:
    """Null as empty; NUL and NBSP as spaces, runs of blanks and of line ends folded, ends stripped."""
    x = F.translate(F.coalesce(x, F.lit("")), "\x00\xa0", "  ")
    x = _strip(F.replace(x, F.lit("\r\n"), F.lit("\n")))
    # what stays as it is, a single space or a bare line end, is not matched: most of a text is
    x = F.regexp_replace(x, " [ \\t\\r\\f\\x0B]++|[\\t\\r\\f\\x0B][ \\t\\r\\f\\x0B]*+", " ")
    x = F.regexp_replace(F.regexp_replace(x, " ++\\n *+|\\n ++", "\n"), "\\n{3,}+", "\n\n")
    return _strip(x)


@F.pandas_udf(T.StringType())
def unescape_html(s: pd.Series) -> pd.Series:
    """Character references of HTML as characters (Spark has no such function)."""
    return s.map(lambda x: None if x is None else html.unescape(x) if "&" in x else x)


@F.pandas_udf(T.StringType())
def nfkc(s: pd.Series) -> pd.Series:
    """Compatibility composition (Spark has no such function)."""
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


def clean_html_text(x: Column) -> Column:
    """Text with tags as spaces and character references resolved."""
    x = normalize_text(x)
    cleaned = normalize_text(unescape_html(F.regexp_replace(x, "<[^>]+>", " ")))
    return F.when(x.contains("<") | x.contains("&"), cleaned).otherwise(x)


def strip_tags(x: Column) -> Column:
    """Tags as spaces, without character references."""
    return normalize_text(F.regexp_replace(x, "<[^>]+>", " "))


def flatten_paths(paths: Column) -> Column:
    """a > b | c > d: distinct non-empty paths in order."""
    def path(p: Column) -> Column:
        return F.array_join(F.filter(F.transform(p["elements"], normalize_text), lambda e: e != ""), " > ")

    return F.coalesce(F.array_join(F.array_distinct(F.filter(F.transform(paths, path), lambda x: x != "")), " | "), F.lit(""))


def render(parts: list[tuple[str, Column]], separator: str = "\n") -> Column:
    """Lines of prefix and value for the parts that are not empty; null if none is."""
    lines = [F.when(normalize_text(v) != "", F.concat(F.lit(prefix), normalize_text(v))) for prefix, v in parts]
    out = F.concat_ws(separator, *lines)
    return F.when(out != "", out)


def truncate_bytes(x: Column, cap: int) -> Column:
    """The first cap / 4 characters of texts of more than cap bytes."""
    return F.when(F.octet_length(x) > cap, F.substring(x, 1, cap // 4)).otherwise(x)


def row_identifier(candidates: list[Column]) -> Column:
    """First candidate that is not blank, stripped."""
    return F.coalesce(*(F.nullif(_strip(c.cast("string")), F.lit("")) for c in candidates))


def _jaccard(a: Column, b: Column) -> Column:
    none = (F.size(a) == 0) | (F.size(b) == 0)
    return F.when(none, 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.greatest(F.size(F.array_union(a, b)), F.lit(1)))


def digit_jaccard(q: Column, o: Column) -> Column:
    runs = lambda x: F.array_distinct(F.regexp_extract_all(F.coalesce(x, F.lit("")), F.lit("[0-9]+"), F.lit(0)))
    return _jaccard(runs(q), runs(o))


def trigram_jaccard(q: Column, o: Column) -> Column:
    """Jaccard of character trigrams in lower case; a shorter text is one gram."""
    def grams(x: Column) -> Column:
        x = F.lower(F.coalesce(x, F.lit("")))
        many = F.transform(F.sequence(F.lit(1), F.greatest(F.length(x) - 2, F.lit(1))), lambda i: F.substring(x, i, F.lit(3)))
        return F.array_distinct(F.filter(many, lambda g: g != ""))

    return _jaccard(grams(q), grams(o))


def substring_flag(q: Column, o: Column) -> Column:
    q, o = F.lower(_strip(F.coalesce(q, F.lit("")))), F.lower(F.coalesce(o, F.lit("")))
    q = _strip(q)
    return ((q != "") & (o != "") & F.contains(o, q)).cast("int")
