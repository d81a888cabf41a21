"""Losses of pair models over tables: binary, in-batch contrastive, in-batch triplet, distillation.

A batch is a group of rows (batch, i, qid, label, q, o): a query vector and an offer
vector each. In-batch losses score all queries of a batch with all of its offers, so
a batch is bounded by its maker and is the only unit in which rows meet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import dot


def _softplus_loss(logit: Column, label: Column) -> Column:
    return F.greatest(logit, F.lit(0.0)) - logit * label + F.log1p(F.exp(-F.abs(logit)))


def binary(rows: DataFrame, scale: float, positive_weight: float = 1.0, negative_weight: float = 1.0) -> DataFrame:
    """One row: the mean weighted binary cross entropy of rows (score, label)."""
    weight = F.when(F.col("label") > 0.5, positive_weight).otherwise(negative_weight)
    return rows.agg(F.avg(_softplus_loss(F.col("score") * scale, F.col("label")) * weight).alias("loss"))


def batch_scores(rows: DataFrame) -> DataFrame:
    """(batch, i, j, s, same, anchor, positive): score of each query i with each offer j of its batch."""
    left = rows.select("batch", "i", F.col("qid").alias("qi"), (F.col("label") > 0.5).alias("anchor"), "q")
    right = rows.select("batch", F.col("i").alias("j"), F.col("qid").alias("qj"), (F.col("label") > 0.5).alias("positive"), "o")
    return left.join(right, "batch").select("batch", "i", "j", dot(F.col("q"), F.col("o")).alias("s"), (F.col("qi") == F.col("qj")).alias("same"), "anchor", "positive")


def contrastive(rows: DataFrame, scale: float) -> DataFrame:
    """(batch, loss): mean over queries with a positive of the log share of all their positives; 0 without any."""
    s = F.col("s") * scale
    top = batch_scores(rows).groupBy("batch", "i").agg(F.max(s).alias("top"))
    mass = batch_scores(rows).join(top, ["batch", "i"]).withColumn("e", F.exp(s - F.col("top")))
    good = F.col("same") & F.col("positive")
    each = mass.groupBy("batch", "i").agg(F.sum("e").alias("all"), F.sum(F.when(good, F.col("e"))).alias("own"))
    return each.groupBy("batch").agg(F.coalesce(F.avg(-F.log(F.col("own") / F.col("all"))), F.lit(0.0)).alias("loss"))


def triplet(rows: DataFrame, margin: float, selection: str = "semi_hard") -> DataFrame:
    """(batch, loss, anchors, fallbacks): hinge against one negative of each positive row.

    Negatives of the same query come first, else those of other queries; semi_hard takes
    the best below the positive and falls back to the best of all, hardest the best of all.
    """
    if selection not in ("semi_hard", "hardest"):
        raise ValueError(f"unknown selection {selection!r}")
    scores = batch_scores(rows)
    own = scores.filter("i = j").select("batch", "i", F.col("s").alias("p"))
    pool = F.when(F.col("same") & ~F.col("positive"), "near").when(~F.col("same"), "far")
    negatives = scores.filter("anchor").withColumn("pool", pool).filter("pool is not null").join(own, ["batch", "i"])
    best = lambda name, test: F.max(F.when((F.col("pool") == name) & test, F.col("s")))
    every, below = F.lit(True), F.col("s") < F.col("p")
    each = negatives.groupBy("batch", "i", "p").agg(*(best(n, t).alias(f"{n}_{k}") for n in ("near", "far") for k, t in (("top", every), ("below", below))))
    near = F.col("near_top").isNotNull()
    top, under = F.when(near, F.col("near_top")).otherwise(F.col("far_top")), F.when(near, F.col("near_below")).otherwise(F.col("far_below"))
    taken = top if selection == "hardest" else F.coalesce(under, top)
    lost = F.lit(False) if selection == "hardest" else under.isNull()
    found = each.groupBy("batch").agg(F.avg(F.greatest(F.lit(0.0), taken - F.col("p") + margin)).alias("loss"), F.count("*").alias("anchors"), F.count_if(lost).alias("fallbacks"))
    every_batch = rows.select("batch").distinct().join(found, "batch", "left")
    return every_batch.select("batch", F.coalesce("loss", F.lit(0.0)).alias("loss"), F.coalesce("anchors", F.lit(0)).alias("anchors"), F.coalesce("fallbacks", F.lit(0)).alias("fallbacks"))


def distillation(rows: DataFrame, temperature: float) -> DataFrame:
    """One row: mean divergence of the student's scores from the teacher's, of rows (qid, student, teacher), times the temperature squared."""
    scaled = rows.select("qid", (F.col("student") / temperature).alias("a"), (F.col("teacher") / temperature).alias("b"))
    top = scaled.groupBy("qid").agg(F.max("a").alias("ma"), F.max("b").alias("mb"))
    mass = scaled.join(top, "qid").select("qid", (F.col("a") - F.col("ma")).alias("a"), (F.col("b") - F.col("mb")).alias("b"))
    sums = mass.groupBy("qid").agg(F.log(F.sum(F.exp("a"))).alias("la"), F.log(F.sum(F.exp("b"))).alias("lb"))
    logs = mass.join(sums, "qid").select("qid", (F.col("a") - F.col("la")).alias("a"), (F.col("b") - F.col("lb")).alias("b"))
    each = logs.groupBy("qid").agg(F.sum(F.exp("b") * (F.col("b") - F.col("a"))).alias("kl"))
    return each.agg((F.avg("kl") * temperature**2).alias("loss"))
