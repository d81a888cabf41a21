"""Dataset building: sampling, splits, mining, pools, batches, statistics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from .components import connected_components


#: Tables of strata up to this many rows are broadcast.
BROADCAST_STRATA = 100_000


def shuffled(key: Column, seed: int) -> Column:
    """Order that is random by key and the same in every run."""
    return F.md5(F.concat(key.cast("string"), F.lit(f"#{seed}")))


def running_sum(rows: DataFrame, order: list[Column], weight: Column, out: str, start: int = 0) -> DataFrame:
    """rows with the sum of weights up to and with each row in a global order, without bringing rows into one task.

    Rows are range-partitioned and sorted; each partition adds up its weights, and the
    small table of sums gives its offset.
    """
    sorted_rows = rows.withColumn("_w", weight).repartitionByRange(*order).sortWithinPartitions(*order)
    keyed = cut(sorted_rows.withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id()))
    sizes = keyed.groupBy("_p").agg(F.sum("_w").alias("_n"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    local = F.sum("_w").over(Window.partitionBy("_p").orderBy("_i").rowsBetween(Window.unboundedPreceding, 0))
    return keyed.join(F.broadcast(before), "_p").withColumn(out, local + F.col("_before") + start).drop("_p", "_i", "_before", "_w")


def row_ids(rows: DataFrame, order: list[Column], out: str, start: int = 0) -> DataFrame:
    """Dense ids from start + 1 in a global order."""
    return running_sum(rows, order, F.lit(1), out, start)


def per_group(rows: DataFrame, by: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows of each group."""
    w = Window.partitionBy(*by).orderBy(*order)
    return rows.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n).drop("_r")


def keep_first(rows: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    return per_group(rows, by, order, 1)


def ranked_within(rows: DataFrame, groups: list[str], order: list[Column], out: str, size: str | None = None) -> DataFrame:
    """rows with their 1-based place within their group (and its size), from one global order: no group is ranked in one task."""
    placed = cut(row_ids(rows, [*(F.asc_nulls_first(c) for c in groups), *order], "_place"))
    sizes = placed.groupBy(*(F.col(c).alias(f"_{c}") for c in groups)).agg(F.min("_place").alias("_first"), F.count("*").alias("_size"))
    few = F.broadcast(sizes) if sizes.count() <= BROADCAST_STRATA else sizes
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in groups])
    found = placed.join(few, same).withColumn(out, F.col("_place") - F.col("_first") + 1)
    return found.select(*rows.columns, out, *([F.col("_size").alias(size)] if size else []))


def percent_split(rows: DataFrame, strata: list[str], key: str, seed: int, train: int = 80, valid: int = 10) -> DataFrame:
    """Rows with `split`, by hundredths of each stratum in hash order."""
    ranked = ranked_within(rows, strata, [shuffled(F.col(key), seed), F.col(key).asc()], "_r", "_n")
    r, each, more = F.col("_r") - 1, F.floor(F.col("_n") / 100), F.col("_n") % 100
    # the first `more` hundredths have a row more than the others
    wide = more * (each + 1)
    tile = F.when(r < wide, F.floor(r / (each + 1))).otherwise(more + F.floor((r - wide) / F.greatest(each, F.lit(1)))) + 1
    return ranked.withColumn("split", F.when(tile <= train, "train").when(tile <= train + valid, "validation").otherwise("test")).drop("_r", "_n")


def split_by_query(rows: DataFrame, key: str, fraction: float, seed: int) -> DataFrame:
    """Rows with `split`: a share of the queries, one at least, is validation; blank ids never are."""
    ids = rows.select(F.col(key).alias("_q")).filter(F.trim(F.coalesce(F.col(key).cast("string"), F.lit(""))) != "").distinct()
    ranked = row_ids(ids, [shuffled(F.col("_q"), seed), F.col("_q").asc()], "_r")
    total = ids.agg(F.greatest(F.lit(1), F.floor(F.count("*") * fraction)).alias("_n"))
    chosen = ranked.crossJoin(F.broadcast(total)).filter(F.col("_r") <= F.col("_n")).select("_q")
    marked = rows.join(chosen.withColumn("_v", F.lit(True)), F.col(key) == F.col("_q"), "left")
    return marked.withColumn("split", F.when(F.col("_v"), "validation").otherwise("train")).drop("_q", "_v")


def split_by_component(rows: DataFrame, query: str, offer: str, fraction: float, seed: int) -> DataFrame:
    """Rows with `split` such that no component of the query-offer graph crosses it.

    Components are taken in hash order until they hold the share of queries;
    blank ids make no edges, and blank queries stay in training.
    """
    named = lambda c: F.trim(F.coalesce(F.col(c).cast("string"), F.lit("")))
    edges = rows.filter((named(query) != "") & (named(offer) != "")).select(F.concat(F.lit("q:"), named(query)).alias("src"), F.concat(F.lit("o:"), named(offer)).alias("dst")).distinct()
    comp = connected_components(edges)
    queries = rows.filter(named(query) != "").select(F.concat(F.lit("q:"), named(query)).alias("node")).distinct().join(comp, "node", "left").withColumn("component", F.coalesce("component", "node"))
    sizes = queries.groupBy("component").agg(F.count("*").alias("n"))
    summed = running_sum(sizes, [shuffled(F.col("component"), seed), F.col("component").asc()], F.col("n"), "_upto")
    target = sizes.agg(F.greatest(F.lit(1), F.floor(F.sum("n") * fraction)).alias("target"))
    chosen = summed.crossJoin(F.broadcast(target)).filter(F.col("_upto") - F.col("n") < F.col("target")).select("component")
    valid = queries.join(chosen, "component", "left_semi").select("node").withColumn("_v", F.lit(True))
    marked = rows.join(valid, F.concat(F.lit("q:"), named(query)) == F.col("node"), "left")
    return marked.withColumn("split", F.when(F.col("_v"), "validation").otherwise("train")).drop("node", "_v")


def given_split(rows: DataFrame, split: str, known: tuple[str, ...] = ("train", "validation", "test")) -> DataFrame:
    """Rows whose given split is one of the known ones, trimmed and in lower case; blank ones are left out, others raise."""
    name = F.lower(F.trim(F.col(split)))
    rows = rows.filter(F.coalesce(name, F.lit("")) != "")
    checked = F.assert_true(name.isin(*known), F.concat(F.lit("unknown split "), name))
    return rows.withColumn(split, F.when(checked.isNull(), name))


def leaks(rows: DataFrame, key: str, split: str = "split") -> DataFrame:
    """Keys that stand in more than one split."""
    return rows.groupBy(key).agg(F.countDistinct(split).alias("splits")).filter("splits > 1")


def eligible_queries(pairs: DataFrame, least: int = 1) -> DataFrame:
    """(qid, positives, negatives) of queries with enough positive pairs (qid, label)."""
    n = pairs.groupBy("qid").agg(F.count_if(F.col("label") == 1).alias("positives"), F.count_if(F.col("label") == 0).alias("negatives"))
    return n.filter(F.col("positives") >= least)


def mine_negatives(hits: DataFrame, positives: DataFrame, start: int, end: int, cap: int) -> DataFrame:
    """Hits (qid, id, score) that are no positives, ranked anew; the zero-based band [start, end), at most cap."""
    rest = hits.join(positives.select("qid", "id").distinct(), ["qid", "id"], "left_anti")
    place = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), F.asc("id"))) - 1
    return rest.withColumn("place", place).filter((F.col("place") >= start) & (F.col("place") < min(end, start + cap)))


def sidecar(mined: DataFrame, positives: DataFrame, default: str = "hard") -> DataFrame:
    """Mined negatives without positives, with a provenance; needed columns are checked."""
    if missing := {"qid", "id"} - set(mined.columns):
        raise ValueError(f"mined negatives lack {sorted(missing)}")
    if "provenance" not in mined.columns:
        mined = mined.withColumn("provenance", F.lit(None).cast("string"))
    kept = mined.join(positives.select("qid", "id").distinct(), ["qid", "id"], "left_anti")
    return kept.withColumn("provenance", F.coalesce("provenance", F.lit(default)))


def deep_negatives(hits: DataFrame, known: DataFrame, below: float, per_query: int, seed: int) -> DataFrame:
    """A seeded sample per query of hits under a score that are not known pairs."""
    rest = hits.filter(F.col("score") < below).join(known.select("qid", "id").distinct(), ["qid", "id"], "left_anti")
    return per_group(rest, ["qid"], [shuffled(F.concat_ws("#", "qid", "id"), seed), F.asc("id")], per_query)


def fill_by_priority(pools: list[tuple[str, DataFrame]], size: int, seed: int) -> DataFrame:
    """`size` rows (qid, id) per query from pools in order, each pair once, with its source."""
    every = None
    for i, (name, pool) in enumerate(pools):
        part = pool.select("qid", "id", F.lit(i).alias("prio"), F.lit(name).alias("source"))
        every = part if every is None else every.unionByName(part)
    once = keep_first(every, ["qid", "id"], [F.asc("prio")])
    w = Window.partitionBy("qid").orderBy("prio", shuffled(F.concat_ws("#", "qid", "id"), seed), "id")
    return once.withColumn("slot", F.row_number().over(w)).filter(F.col("slot") <= size).drop("prio")


def anchor_batches(positives: DataFrame, hard: DataFrame, semi: DataFrame, synthetic: DataFrame, size: int, least: int, seed: int) -> DataFrame:
    """One batch per query (batch is the query): its positives, then hard, semi-hard and synthetic negatives.

    Queries whose batch stays under `least` rows are left out.
    """
    rows = fill_by_priority([("positive", positives), ("hard", hard), ("semi", semi), ("synthetic", synthetic)], size, seed)
    n = F.count("*").over(Window.partitionBy("qid"))
    return rows.withColumn("_n", n).filter(F.col("_n") >= least).drop("_n")


def _dealt(key: Column, seed: int, buckets: int) -> Column:
    return F.conv(F.substring(shuffled(key, seed), 1, 12), 16, 10).cast("long") % buckets


def synthetic_negatives(queries: DataFrame, offers: DataFrame, known: DataFrame, per_query: int, seed: int) -> DataFrame:
    """Offers (id) drawn for each query (qid) by hash, known pairs left out; no pair of all with all is made.

    Offers are dealt to buckets that hold some 4 times what a query needs, and a query
    draws from two buckets chosen by its hash, or from twice as many until it has enough
    or has seen all. So each offer can be drawn, and none of a bucket is left out.
    """
    total = offers.count()
    buckets = max(1, -(-total // (4 * per_query + 16)))
    side = offers.select("id", _dealt(F.col("id"), seed, buckets).alias("b"))
    ids, width = queries.select("qid").distinct(), 2
    while True:
        asked = ids.select("qid", F.explode(F.sequence(F.lit(0), F.lit(min(width, buckets) - 1))).alias("x")).select("qid", ((_dealt(F.col("qid"), seed + 1, buckets) + F.col("x")) % buckets).alias("b"))
        drawn = asked.join(side, "b").select("qid", "id").distinct().join(known.select("qid", "id").distinct(), ["qid", "id"], "left_anti")
        found = cut(per_group(drawn, ["qid"], [shuffled(F.concat_ws("#", "qid", "id"), seed), F.asc("id")], per_query).select("qid", "id"))
        if width >= buckets or found.count() == per_query * ids.count():
            return found
        width *= 2


def stratified_quota(rows: DataFrame, strata: str, band: str, targets: dict[str, int], quotas: dict[str, float], key: str, seed: int) -> DataFrame:
    """Rows by targets per stratum: quotas of bands first, the last band fills up, then any leftovers.

    Strata are ranked in the order of that preference.
    """
    names = list(quotas)
    target = F.create_map(*(F.lit(x) for kv in targets.items() for x in kv))
    quota = F.create_map(*(F.lit(x) for kv in quotas.items() for x in kv))
    rows = rows.filter(F.col(strata).isin(*targets) & F.col(band).isin(*names)).withColumn("_t", F.try_element_at(target, F.col(strata)))
    mixed = [shuffled(F.col(key), seed), F.col(key).asc()]
    rows = ranked_within(rows, [strata, band], mixed, "_r")
    within = (F.col(band) == names[-1]) | (F.col("_r") <= F.floor(F.col("_t") * F.try_element_at(quota, F.col(band))))
    leftover = F.when(within & (F.col(band) != names[-1]), 0).when(within, 1).otherwise(2)
    return ranked_within(rows.withColumn("_l", leftover), [strata], [F.asc("_l"), *mixed], "_p").filter(F.col("_p") <= F.col("_t")).drop("_t", "_r", "_p", "_l")


def swap_for_floor(selected: DataFrame, universe: DataFrame, key: str, flag: str, floor: int, victim: Column, seed: int) -> DataFrame:
    """Selected rows with as many unflagged victims swapped for flagged spare rows as reach the floor."""
    have = selected.agg(F.count_if(F.col(flag)).alias("have"))
    spare = universe.filter(F.col(flag)).join(selected.select(key), key, "left_anti")
    order = [shuffled(F.col(key), seed), F.col(key).asc()]
    spare = row_ids(spare, order, "_r").crossJoin(F.broadcast(have)).filter(F.col("_r") <= floor - F.col("have")).drop("have")
    out = row_ids(selected.filter(~F.col(flag) & victim), order, "_r").select(key, "_r")
    swaps = out.join(spare.withColumnRenamed(key, "_new").select("_new", "_r"), "_r").select(F.col(key).alias("_old"), "_new")
    kept = selected.join(swaps, selected[key] == swaps["_old"], "left_anti")
    added = universe.join(swaps.select(F.col("_new").alias(key)), key, "left_semi")
    return kept.unionByName(added.select(*kept.columns))


def list_features(rows: DataFrame, by: str, columns: list[str]) -> DataFrame:
    """Rank, gap to the best, z-score (1 for a spread of 0) and group size within a query's list."""
    w = Window.partitionBy(by)
    out = {"group_size": F.count("*").over(w)}
    for c in columns:
        spread = F.coalesce(F.nullif(F.nanvl(F.stddev_samp(c).over(w), F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
        out |= {
            f"{c}_rank": F.dense_rank().over(w.orderBy(F.desc(c))),
            f"{c}_gap": F.max(c).over(w) - F.col(c),
            f"{c}_z": (F.col(c) - F.avg(c).over(w)) / spread,
        }
    return rows.withColumns(out)


def dedup_rate(rows: DataFrame, text: Column, prefix: int | None = None) -> DataFrame:
    """One row: rows, distinct texts, share of repeats, size of the largest cluster; by hash of the (cut) text."""
    key = F.sha2(text if prefix is None else F.substring(text, 1, prefix), 256)
    sizes = rows.groupBy(key.alias("h")).agg(F.count("*").alias("n"))
    return sizes.agg(F.sum("n").alias("rows"), F.count("*").alias("uniques"), (1 - F.count("*") / F.sum("n")).alias("dup_rate"), F.max("n").alias("largest"))


def cluster_histogram(rows: DataFrame, text: Column) -> DataFrame:
    sizes = rows.groupBy(F.sha2(text, 256).alias("h")).agg(F.count("*").alias("size"))
    return sizes.groupBy("size").agg(F.count("*").alias("clusters"))


def class_weights(rows: DataFrame, label: str, classes: list) -> DataFrame:
    """(label, weight): N / (K n) per class, 0 for a class without rows."""
    counts = rows.agg(F.count("*").alias("N"), *(F.count_if(F.col(label) == c).alias(f"n{i}") for i, c in enumerate(classes)))
    pairs = F.array(*(F.struct(F.lit(c).alias("label"), F.coalesce(F.try_divide(F.col("N"), F.lit(len(classes)) * F.col(f"n{i}")), F.lit(0.0)).alias("weight")) for i, c in enumerate(classes)))
    return counts.select(F.explode(pairs).alias("x")).select("x.*")


def majority_labels(train: DataFrame, rows: DataFrame, by: str, label: str) -> DataFrame:
    """rows with `pred`: the most frequent label of their group, or of all rows; ties by the lesser label."""
    def top(*keys: str) -> DataFrame:
        n = train.groupBy(*keys, label).agg(F.count("*").alias("n"))
        return n.groupBy(*keys).agg(F.min(F.struct((-F.col("n")).alias("m"), F.col(label).alias("l")))["l"].alias("own" if keys else "any"))

    return rows.join(top(by), by, "left").crossJoin(F.broadcast(top())).withColumn("pred", F.coalesce("own", "any")).drop("own", "any")


def batch_stats(rows: DataFrame) -> DataFrame:
    """Rows per source over all batches and per batch."""
    return rows.groupBy("source").agg(F.count("*").alias("n"), F.countDistinct("qid").alias("batches"))


def catalog_subsample(catalog: DataFrame, judged: DataFrame, size: int, seed: int) -> DataFrame:
    """All judged rows and a seeded sample of others up to a size."""
    keep = judged.select("id").distinct()
    must = catalog.join(keep, "id", "left_semi")
    rest = catalog.join(keep, "id", "left_anti")
    have = must.agg(F.count("*").alias("_h"))
    ranked = row_ids(rest, [shuffled(F.col("id"), seed), F.col("id").asc()], "_r").crossJoin(F.broadcast(have))
    return must.unionByName(ranked.filter(F.col("_r") <= size - F.col("_h")).select(*must.columns))
