"""Ranking and classification metrics, contingency statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Gain of each label.
GAINS = {"Exact": 1.0, "Substitute": 0.1, "Complement": 0.01, "Irrelevant": 0.0}


def gain(label: Column) -> Column:
    """Gain of a label; an unknown one is an error."""
    out = F.raise_error(F.concat(F.lit("unknown label "), F.coalesce(label, F.lit("null")))).cast("double")
    for name, g in GAINS.items():
        out = F.when(label == name, F.lit(g)).otherwise(out)
    return out


def ndcg(rows: DataFrame, k: int) -> DataFrame:
    """(qid, ndcg) of rows (qid, id, score, gain), for queries with a positive gain; ties by id."""
    place = lambda c: F.row_number().over(Window.partitionBy("qid").orderBy(F.desc(c), F.asc("id")))
    ranked = rows.withColumns({"r": place("score"), "b": place("gain")})
    part = lambda r: F.sum(F.when(F.col(r) <= k, F.col("gain") / F.log2(F.col(r) + 1.0)))
    sums = ranked.groupBy("qid").agg(part("r").alias("dcg"), part("b").alias("ideal"))
    return sums.filter("ideal > 0").select("qid", (F.col("dcg") / F.col("ideal")).alias("ndcg"))


def first_relevant(rows: DataFrame) -> DataFrame:
    """(qid, rank): rank of the first relevant row (qid, rank, relevant), null without one."""
    return rows.groupBy("qid").agg(F.min(F.when(F.col("relevant"), F.col("rank"))).alias("rank"))


def mrr_and_success(rows: DataFrame, eligible: DataFrame, k: int) -> DataFrame:
    """One row: mean reciprocal rank and success@k over eligible queries, those without hits count as 0."""
    first = eligible.select("qid").distinct().join(first_relevant(rows), "qid", "left")
    return first.agg(
        F.avg(F.coalesce(1.0 / F.col("rank"), F.lit(0.0))).alias("mrr"),
        F.avg(F.coalesce((F.col("rank") <= k).cast("double"), F.lit(0.0))).alias("success"),
    )


def precision_at(rows: DataFrame, k: int) -> DataFrame:
    return rows.groupBy("qid").agg((F.count_if(F.col("relevant") & (F.col("rank") <= k)) / k).alias("precision"))


def hit_rate_at(rows: DataFrame, eligible: DataFrame, k: int) -> DataFrame:
    return mrr_and_success(rows, eligible, k).select(F.col("success").alias("hit_rate"))


def best_labels(judged: DataFrame) -> DataFrame:
    """(qid, id, label): the label of the greatest gain of each pair."""
    return judged.groupBy("qid", "id").agg(F.max_by("label", gain(F.col("label"))).alias("label"))


def labelled(hits: DataFrame, judged: DataFrame) -> DataFrame:
    """Hits with their label and gain, Irrelevant where none is known."""
    label = F.coalesce("label", F.lit("Irrelevant"))
    return hits.join(best_labels(judged), ["qid", "id"], "left").withColumn("label", label).withColumn("gain", gain(F.col("label")))


def confusion(rows: DataFrame) -> DataFrame:
    return rows.groupBy("target", "pred").agg(F.count("*").alias("n"))


def class_report(rows: DataFrame) -> DataFrame:
    """(label, precision, recall, f1, support) of rows (target, pred); 0 where undefined."""
    c = confusion(rows)
    each = c.select(F.col("target").alias("label"), F.col("n").alias("t"), F.lit(0).alias("p"), F.when(F.col("target") == F.col("pred"), F.col("n")).otherwise(0).alias("tp"))
    each = each.unionByName(c.select(F.col("pred").alias("label"), F.lit(0).alias("t"), F.col("n").alias("p"), F.lit(0).alias("tp")))
    s = each.groupBy("label").agg(F.sum("t").alias("support"), F.sum("p").alias("said"), F.sum("tp").alias("tp"))
    ratio = lambda a, b: F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0))
    s = s.withColumns({"precision": ratio("tp", "said"), "recall": ratio("tp", "support")})
    f1 = F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0))
    return s.select("label", "precision", "recall", f1.alias("f1"), "support")


def overall_report(rows: DataFrame) -> DataFrame:
    """One row: micro (accuracy) and macro F1."""
    micro = rows.agg(F.avg((F.col("target") == F.col("pred")).cast("double")).alias("micro"))
    return micro.crossJoin(class_report(rows).agg(F.avg("f1").alias("macro")))


def contingency(rows: DataFrame, a: str, b: str) -> DataFrame:
    """One row of association measures of two columns: Cramer's V, entropies, mutual information, NMI."""
    cells = rows.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("n"))
    all_rows = Window.partitionBy(F.lit(0))
    cells = cells.withColumns({"na": F.sum("n").over(Window.partitionBy("a")), "nb": F.sum("n").over(Window.partitionBy("b")), "t": F.sum("n").over(all_rows)})
    p, pa, pb = F.col("n") / F.col("t"), F.col("na") / F.col("t"), F.col("nb") / F.col("t")
    expected = F.col("na") * F.col("nb") / F.col("t")
    sums = cells.agg(
        F.sum(p * F.log(p / (pa * pb))).alias("mi"),
        F.sum(-p * F.log(pa)).alias("ha"),
        F.sum(-p * F.log(pb)).alias("hb"),
        F.max("t").alias("t"),
        F.sum(F.pow(F.col("n"), 2) / expected).alias("x"),
        F.countDistinct("a").alias("ka"),
        F.countDistinct("b").alias("kb"),
    )
    chi2 = F.col("x") - F.col("t")
    least = F.least("ka", "kb") - 1
    return sums.select(
        F.sqrt(F.greatest(F.lit(0.0), F.coalesce(F.try_divide(chi2, F.col("t") * least), F.lit(0.0)))).alias("cramers_v"),
        "ha", "hb", "mi",
        F.coalesce(F.try_divide(F.col("mi"), F.sqrt(F.col("ha") * F.col("hb"))), F.lit(0.0)).alias("nmi"),
    )


def overlap(rows: DataFrame, a: Column, b: Column) -> DataFrame:
    """One row: Jaccard and containment of the rows where two flags hold."""
    both, either = F.count_if(a & b), F.count_if(a | b)
    return rows.agg(
        F.coalesce(F.try_divide(both, either), F.lit(0.0)).alias("jaccard"),
        F.coalesce(F.try_divide(both, F.count_if(a)), F.lit(0.0)).alias("a_in_b"),
        F.coalesce(F.try_divide(both, F.count_if(b)), F.lit(0.0)).alias("b_in_a"),
    )


def delta(a: DataFrame, b: DataFrame, columns: list[str]) -> DataFrame:
    """One-row metrics b minus a."""
    left = a.select(*(F.col(c).alias(f"a_{c}") for c in columns))
    right = b.select(*(F.col(c).alias(f"b_{c}") for c in columns))
    return left.crossJoin(right).select(*((F.col(f"b_{c}") - F.col(f"a_{c}")).alias(f"delta_{c}") for c in columns))
