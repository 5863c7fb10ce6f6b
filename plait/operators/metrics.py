"""Scoring of any predictor that has put its columns beside the labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plait.functions import vectors as V


def prediction_columns(rows: DataFrame, logits: str = "logits", label: str = "label") -> DataFrame:
    """Adds p, confidence, the best class, hits and losses of each row."""
    rows = rows.withColumn("p", V.softmax(logits)).withColumn("top3", V.top_classes("p", 3))
    return rows.withColumns({
        "pred": F.get("top3", F.lit(0)), "conf": F.array_max("p"), "p_label": F.get("p", F.col(label)),
        "hit1": (F.get("top3", F.lit(0)) == F.col(label)).cast("double"), "hit3": F.array_contains("top3", F.col(label)).cast("double"),
        "brier": V.brier("p", label),
    }).withColumn("nll", -F.log("p_label"))


def calibration(rows: DataFrame, bins: int = 15, confidence: str = "conf", hit: str = "hit1") -> DataFrame:
    """(bin, n, acc, conf) for every bin; empty ones have n 0 and null figures."""
    b = F.least(F.floor(F.col(confidence) * bins), F.lit(bins - 1)).cast("int")
    got = rows.groupBy(b.alias("bin")).agg(F.count("*").alias("n"), F.avg(hit).alias("acc"), F.avg(confidence).alias("conf"))
    every = rows.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(got, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"), "acc", "conf")


def calibration_edges(rows: DataFrame, bins: int = 15, confidence: str = "conf", hit: str = "hit1") -> DataFrame:
    """(bin, lo, hi, n, acc, conf): right-open bins between the edges i / bins, compared as such, the last one closed; confidences outside 0..1 are in none."""
    edges = F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda i: F.struct(i.alias("bin"), (i / F.lit(float(bins))).alias("lo"), ((i + 1) / F.lit(float(bins))).alias("hi")))
    every = rows.sparkSession.range(1).select(F.inline(edges))
    x = F.col(confidence)
    guess = F.greatest(F.least(F.floor(x * bins), F.lit(bins - 1)), F.lit(0))
    # the product may round over an edge; the edges themselves decide
    at = F.when(x < guess / F.lit(float(bins)), guess - 1).when((x >= (guess + 1) / F.lit(float(bins))) & (guess < bins - 1), guess + 1).otherwise(guess).cast("int")
    got = rows.where(x.between(0, 1)).groupBy(at.alias("_b")).agg(F.count("*").alias("n"), F.avg(hit).alias("acc"), F.avg(confidence).alias("conf"))
    return every.join(got, F.col("bin") == F.col("_b"), "left").select("bin", "lo", "hi", F.coalesce("n", F.lit(0)).alias("n"), "acc", "conf")


def calibration_error(bins: DataFrame) -> DataFrame:
    gap = F.abs(F.col("acc") - F.col("conf")) * F.col("n")
    return bins.agg((F.sum(gap) / F.sum("n")).alias("ece"))


def slices(rows: DataFrame, keys: list[str]) -> DataFrame:
    """n, accuracy, top-3, cross-entropy and place error by each key in turn: one pass of grouping sets."""
    grouped = rows.groupingSets([[F.col(k)] for k in keys], *[F.col(k) for k in keys])
    name = F.lit(None).cast("string")
    for k in keys:
        name = F.when(F.grouping(k) == 0, k).otherwise(name)
    value = F.coalesce(*[F.when(F.grouping(k) == 0, F.col(k).cast("bigint")) for k in keys])
    return grouped.agg(name.alias("slice"), value.alias("value"), F.count("*").alias("n"), F.avg("hit1").alias("acc"), F.avg("hit3").alias("top3"), F.avg("nll").alias("ce"), F.sqrt(F.avg("se") / 2).alias("loc_rmse")).drop(*keys)


def masked_mean(x, mask):
    return F.sum(F.col(x) * F.col(mask)) / F.greatest(F.sum(mask), F.lit(1))
