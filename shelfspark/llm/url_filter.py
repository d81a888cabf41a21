"""URL filtering by host rules and gradient-boosted trees on lexical features.

A rule (host, path) fits its host and all subdomains where the url's path starts
with the rule's; the longest rule decides. Urls that no rule fits are judged by
boosted trees learned from those that a rule labels: length, depth, share of
digits, entropy, number of parameters and statistics of host suffixes (the share
of blocked urls among labelled ones, smoothed). Features that spell out the rules
themselves are left to the trees; the suffix statistics carry them over.

Trees are fitted by DataFrame aggregations: features are binned by quantiles of a
sample of at most `sample_rows` different labelled urls chosen by a hash, each with the
logarithm of its number of rows as weight, so that no hot url fills the sample or
outweighs it; each level of a tree is one grouped sum of gradients by leaf, feature and
bin, and the finished trees are one CASE expression, so scoring adds neither a shuffle
nor Python.

A null url, or one without ://, has empty host and path, fits no rule and is
judged by the trees like any other. With labels of one kind only, everything gets
that verdict; with none at all, allow. Ties of rules of one length go to the first by
name, ties of splits to the first feature and bin, a probability of one half is
allowed. Very long urls count in full. Repeated rows are judged one by one. Columns
named like the results are replaced. Empty tables give no rows.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import Work, cut

RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))
SAMPLE_ROWS = 20_000
TREES = 12
DEPTH = 3
BINS = 16
RATE = 0.4
BROADCAST_SUFFIXES = 100_000

FEATURES = ("length", "host_length", "path_length", "depth", "dots", "digits", "entropy", "params", "hyphens", "fragment", "secure", "suffix1", "suffix2", "segment")


def host_path(url: str) -> tuple[Column, Column]:
    """Host after the first :// with A-Z lower-cased, and the path up to ? or #."""
    u = F.coalesce(F.col(url), F.lit(""))
    at = F.instr(u, "://")
    rest = F.when(at > 0, F.expr(f"substring({_sql(url)}, instr({_sql(url)}, '://') + 3)")).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.translate(host, upper, lower), path


def _sql(name: str) -> str:
    return f"coalesce(`{name.replace('`', '``')}`, '')"


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits; null if none does."""
    ordered = sorted(rules, key=lambda r: (-len(r[0]) - len(r[1]), r))
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in reversed(ordered):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, h + p).otherwise(name), F.when(fits, v).otherwise(verdict)
    return name, verdict


def _entropy(x: Column) -> Column:
    """Bits per character from the counts of distinct characters."""
    chars = F.split(x, "")
    n = F.greatest(F.length(x), F.lit(1))

    def add(total: Column, c: Column) -> Column:
        share = (n - F.length(F.replace(x, c))) / n
        return total - F.when((share > 0) & (c != ""), share * F.log2(share)).otherwise(0.0)

    return F.aggregate(F.array_distinct(chars), F.lit(0.0).cast("double"), add)


def with_features(rows: DataFrame) -> DataFrame:
    """rows (_url, _host, _path) with lexical features and the two host suffixes and the first path segment."""
    u, h, p = F.col("_url"), F.col("_host"), F.col("_path")
    count = lambda x, c: (F.length(x) - F.length(F.replace(x, F.lit(c)))).cast("double")
    query = F.regexp_extract(u, r"(?s)\?([^#]*)", 1)
    return rows.withColumns({
        "length": F.length(u).cast("double"),
        "host_length": F.length(h).cast("double"),
        "path_length": F.length(p).cast("double"),
        "depth": count(p, "/"),
        "dots": count(h, "."),
        "digits": F.length(F.regexp_replace(u, "[^0-9]", "")) / F.greatest(F.length(u), F.lit(1)),
        "entropy": F.round(_entropy(u), 6),
        "params": F.when(query == "", 0.0).otherwise(count(query, "&") + 1),
        "hyphens": count(u, "-"),
        "fragment": F.contains(u, F.lit("#")).cast("double"),
        "secure": F.startswith(u, F.lit("https")).cast("double"),
        "_suffix1": F.regexp_extract(h, r"([^.]*)$", 1),
        "_suffix2": F.regexp_extract(h, r"([^.]*\.?[^.]*)$", 1),
        "_segment": F.regexp_extract(p, r"^/?([^/]*)", 1),
    })


_KEYS = (("suffix1", "_suffix1"), ("suffix2", "_suffix2"), ("segment", "_segment"))


class Trees:
    """Boosted regression trees as nested conditions over feature columns."""

    def __init__(self, prior: float, tables: dict[str, DataFrame]):
        self.prior, self.tables, self.trees = prior, tables, []

    def encode(self, rows: DataFrame) -> DataFrame:
        """Suffix statistics of the labelled sample, the prior for the unseen."""
        base = 1 / (1 + math.exp(-self.prior))
        for name, key in _KEYS:
            rows = rows.join(self.tables[name], key, "left").withColumn(name, F.coalesce(name, F.lit(base)))
        return rows

    def margin(self) -> Column:
        return reduce(lambda a, b: a + b, self.trees, F.lit(self.prior))


def _leaf(paths: list[list[tuple[str, float, bool]]], values: list) -> Column:
    """CASE over the paths of a tree's leaves."""
    out = F.lit(None)
    for path, value in zip(paths, values, strict=True):
        test = reduce(lambda a, b: a & b, [(F.col(f) <= c) if low else (F.col(f) > c) for f, c, low in path], F.lit(True))
        out = F.when(test, value).otherwise(out)
    return out


def fit(labelled: DataFrame, sample_rows: int = SAMPLE_ROWS, trees: int = TREES, depth: int = DEPTH, bins: int = BINS, rate: float = RATE) -> Trees | float | None:
    """Trees from rows (_url, _host, _path, _blocked); a verdict's share if there is one kind; None without rows."""
    once = labelled.groupBy("_url", "_host", "_path", "_blocked").agg((1 + F.log2(F.count("*").cast("double"))).alias("_times"))
    sample = cut(with_features(once.orderBy(F.xxhash64("_url"), "_url").limit(sample_rows)))
    n, positive = sample.agg(F.sum("_times"), F.sum(F.col("_times") * F.col("_blocked"))).first()
    if not n:
        return None
    if positive <= 0 or positive >= n:
        return float(positive > 0)
    prior = math.log(positive / (n - positive))
    tables = {}
    for name, key in _KEYS:
        stat = cut(sample.groupBy(key).agg(((F.sum(F.col("_times") * F.col("_blocked")) + 5.0 * positive / n) / (F.sum("_times") + 5.0)).alias(name)))
        tables[name] = F.broadcast(stat) if stat.count() <= BROADCAST_SUFFIXES else stat
    model = Trees(prior, tables)
    rows = model.encode(sample)
    steps = [i / bins for i in range(1, bins)]
    cuts = rows.agg(*(F.percentile_approx(f, steps, 10_000).alias(f) for f in FEATURES)).first()
    edges = {f: sorted(set(cuts[f])) for f in FEATURES}
    binned = [sum(((F.col(f) > e).cast("int") for e in edges[f]), start=F.lit(0)).alias(f"b_{f}") for f in FEATURES]
    rows = cut(rows.select("_blocked", "_times", *FEATURES, *binned))
    work, rows = Work(labelled.sparkSession), rows.withColumn("_margin", F.lit(prior))
    for _ in range(trees):
        p = 1 / (1 + F.exp(-F.col("_margin")))
        rows_now = rows.withColumns({"_g": F.col("_times") * (F.col("_blocked") - p), "_w": F.col("_times") * p * (1 - p)})
        paths: list[list[tuple[str, float, bool]]] = [[]]
        totals: list[tuple[float, float]] = []
        for _ in range(depth):
            stacked = F.explode(F.array(*(F.struct(F.lit(f).alias("f"), F.col(f"b_{f}").alias("b")) for f in FEATURES)))
            sums = (
                rows_now.withColumn("leaf", _leaf(paths, list(range(len(paths)))))
                .select("leaf", "_g", "_w", stacked.alias("x"))
                .groupBy("leaf", "x.f", "x.b")
                .agg(F.sum("_g").alias("g"), F.sum("_w").alias("h"))
                .collect()
            )  # at most leaves * features * bins rows
            by: dict[int, dict[str, dict[int, tuple[float, float]]]] = {}
            for r in sums:
                by.setdefault(r.leaf, {}).setdefault(r.f, {})[r.b] = (r.g, r.h)
            grown, totals = [], []
            for k, path in enumerate(paths):
                stats = by.get(k, {})
                first = stats.get(FEATURES[0], {})
                g0, h0 = sum(v[0] for v in first.values()), sum(v[1] for v in first.values())
                best = (1e-6, None, 0.0, 0.0, 0.0)
                for f in FEATURES:
                    g = h = 0.0
                    for b, e in enumerate(edges[f]):
                        a = stats.get(f, {}).get(b, (0.0, 0.0))
                        g, h = g + a[0], h + a[1]
                        gain = round(g * g / (h + 1) + (g0 - g) ** 2 / (h0 - h + 1) - g0 * g0 / (h0 + 1), 9)
                        if h > 1e-3 and h0 - h > 1e-3 and gain > best[0]:
                            best = (gain, f, e, g, h)
                if best[1] is None:
                    grown.append(path)
                    totals.append((g0, h0))
                else:
                    grown += [[*path, (best[1], best[2], True)], [*path, (best[1], best[2], False)]]
                    totals += [(best[3], best[4]), (g0 - best[3], h0 - best[4])]
            if grown == paths:
                break
            paths = grown
        model.trees.append(_leaf(paths, [F.lit(rate * g / (h + 1)) for g, h in totals]))
        rows = work.mark(rows.withColumn("_margin", F.col("_margin") + model.trees[-1]))  # later trees need not work the earlier ones out again
    work.drop()
    return model


def judge(pages: DataFrame, url: str = "url", carry: list[str] | None = None, rules=RULES, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The carried columns (all if None) with host, path, rule, verdict and p_block of the trees."""
    added = ("host", "path", "rule", "verdict", "p_block")
    keep = [c for c in (pages.columns if carry is None else carry) if c not in added]
    host, path = host_path(url)
    rows = pages.select(*(F.col(c).alias(f"c{i}") for i, c in enumerate(keep)), F.coalesce(F.col(url), F.lit("")).alias("_url"), host.alias("_host"), path.alias("_path"))
    rule, verdict = rule_of(F.col("_host"), F.col("_path"), rules)
    rows = rows.withColumns({"_rule": rule, "_verdict": verdict})
    labelled = rows.filter("_rule is not null").select("_url", "_host", "_path", (F.col("_verdict") == "block").cast("int").alias("_blocked"))
    model = fit(labelled, sample_rows)
    if isinstance(model, Trees):
        rows = model.encode(with_features(rows))
        p = 1 / (1 + F.exp(-model.margin()))
    else:
        p = F.lit(float(model or 0.0))
    own = F.when(p > 0.5, "block").otherwise("allow")
    return rows.select(
        *(F.col(f"c{i}").alias(c) for i, c in enumerate(keep)),
        F.col("_host").alias("host"),
        F.col("_path").alias("path"),
        F.col("_rule").alias("rule"),
        F.coalesce("_verdict", own).alias("verdict"),
        p.alias("p_block"),
    )
