"""A report of one prepared folder: metrics, slices and baselines of its held-out rows, written as JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plait.functions import columns as X
from plait.functions import vectors as V
from plait.operators import baselines, metrics, prepare, sequences
from plait.sources import artifacts

SLICES = ["count_id", "inning_bucket", "score_bucket"]


def rows_of(part: DataFrame, history: int) -> DataFrame:
    """What baselines and metrics need of a prepared part."""
    last = lambda f: sequences.last_nonzero([f"hist_{f}_{i}" for i in range(history)])
    return part.select(
        F.col("pitcher_id").alias("pitcher"), "balls", "strikes", last("token_id").alias("prev_type"), last("outcome_id").alias("prev_outcome"), F.col("token_id").alias("y"), "x", F.col("y").alias("y_loc"),
        (F.col("balls") * 3 + F.col("strikes")).alias("count_id"), X.inning_bucket("inning").alias("inning_bucket"), X.score_bucket("score_diff").alias("score_bucket"),
    )


def judged(predicted: DataFrame, alpha: float) -> DataFrame:
    """Adds hits, losses, confidence and squared place error to the rows of :func:`baselines.predicted`."""
    p = predicted.withColumn("p", F.transform("c", lambda n: (n + F.lit(alpha)) / F.col("denominator")))
    return p.withColumns({
        "hit1": (F.col("top3")[0] == F.col("y")).cast("double"), "hit3": F.array_contains("top3", F.col("y")).cast("double"), "conf": F.array_max("p"), "nll": -F.log(F.get("p", F.col("y"))),
        "brier": V.brier("p", "y"), "se": F.pow(F.col("x") - F.col("m_x"), 2) + F.pow(F.col("y_loc") - F.col("m_y"), 2),
    })


def report(spark: SparkSession, prepared: str, out: str, grain: str = "count", alpha: float = 1.0, bins: int = 15, overwrite: bool = False) -> dict:
    """Writes ``metrics``, ``calibration``, ``slices``, ``baselines`` and ``report`` (JSON) under ``out``, and returns the report.

    The predictor of ``grain`` and the baselines at every grain are fitted on the training part and scored on the held-out one."""
    got = prepare.load(spark, prepared)
    history, classes = got.meta["history"], got.meta["vocab_sizes"]["token"]
    train, valid = (rows_of(p, history) for p in (got.train, got.valid))
    scored = judged(baselines.predicted(train, valid, baselines.GRAINS[grain], classes, alpha), alpha).persist()
    try:
        calibration = metrics.calibration(scored, bins)
        whole = scored.agg(F.count("*").alias("n"), F.avg("hit1").alias("acc"), F.avg("hit3").alias("top3"), F.avg("nll").alias("ce"), F.avg("brier").alias("brier"), F.sqrt(F.avg("se") / 2).alias("loc_rmse"), F.avg("fallback").alias("fallback_share"))
        every = [baselines.evaluate(train, valid, keys, classes, alpha).select(F.lit(name).alias("grain"), "*") for name, keys in baselines.GRAINS.items()]
        parts = {"metrics": whole.crossJoin(F.broadcast(metrics.calibration_error(calibration))), "calibration": calibration, "slices": metrics.slices(scored, SLICES), "baselines": every[0]}
        for e in every[1:]:
            parts["baselines"] = parts["baselines"].unionByName(e)
        return artifacts.write_report(spark, out, parts, overwrite=overwrite)
    finally:
        scored.unpersist()
