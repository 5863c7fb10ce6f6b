"""Conditional policy profiles: what an entity does next, by grain, predicted beside observed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_SITUATION = ["pitcher", "balls", "strikes", "stand_id", "runners_state", "inning_bucket", "score_bucket"]
#: Key columns of each grain, in output order.
GRAINS = {
    "pitcher": ["pitcher"],
    "pitcher_count": ["pitcher", "balls", "strikes"],
    "pitcher_count_prev": ["pitcher", "balls", "strikes", "prev_type"],
    "pitcher_count_prev_outcome": ["pitcher", "balls", "strikes", "prev_type", "prev_outcome"],
    "pitcher_situation": _SITUATION,
    "pitcher_situation_prev": [*_SITUATION, "prev_type"],
    "pitcher_situation_prev_outcome": [*_SITUATION, "prev_type", "prev_outcome"],
    "pitcher_situation_batter_cluster": [*_SITUATION, "batter_cluster"],
    "pitcher_situation_batter_cluster_prev": [*_SITUATION, "batter_cluster", "prev_type"],
    "pitcher_situation_batter_cluster_prev_outcome": [*_SITUATION, "batter_cluster", "prev_type", "prev_outcome"],
}


def profile(rows: DataFrame, by: str, tokens: list[str], min_n: int = 25) -> DataFrame:
    """One row a group of at least ``min_n``: mean predicted and observed share of each token, mean places, cross-entropy.

    ``rows`` carry the label ``y`` (0 = unknown), the prediction ``probs`` (an array over classes), places and predicted places.
    """
    keys = GRAINS[by]
    names = ["OOV", *tokens]
    shares = []
    for i, t in enumerate(names):
        shares += [F.avg(F.get("probs", F.lit(i))).alias(f"pred_prob_{t}"), F.avg((F.col("y") == i).cast("double")).alias(f"emp_prob_{t}")]
    out = rows.groupBy(*keys).agg(F.count("*").alias("n"), *shares, F.avg("pred_x").alias("pred_plate_x"), F.avg("pred_y").alias("pred_plate_y"), F.avg("x").alias("emp_plate_x"), F.avg("y_loc").alias("emp_plate_y"))
    ce = F.lit(0.0)
    for t in names:
        ce = ce - F.col(f"emp_prob_{t}") * F.log(F.least(F.greatest(F.col(f"pred_prob_{t}"), F.lit(1e-12)), F.lit(1.0)))
    return out.where(F.col("n") >= min_n).withColumn("type_ce_group", ce)


def weighted_shares(profiles: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """n-weighted means of profile columns; null where the weights sum to nothing."""
    return profiles.groupBy(*keys).agg(F.sum("n").alias("n"), *[F.try_divide(F.sum(F.col(c) * F.col("n")), F.sum("n")).alias(c) for c in columns])


def heat_map(points: DataFrame, weight: str, x: str, y: str, cells: int, lo: tuple[float, float], hi: tuple[float, float], sigma: float) -> DataFrame:
    """(i, j, heat): a Gaussian kernel sum on a fixed grid.  The grid (cells squared rows) is broadcast, whatever the points' number."""
    step = [(h - b) / (cells - 1) for b, h in zip(lo, hi)]
    axis = points.sparkSession.range(cells * cells).select((F.col("id") % cells).cast("int").alias("i"), F.floor(F.col("id") / cells).cast("int").alias("j"))
    grid = axis.select("i", "j", (F.lit(lo[0]) + F.col("i") * step[0]).alias("gx"), (F.lit(lo[1]) + F.col("j") * step[1]).alias("gy"))
    d2 = F.pow(F.col("gx") - F.col(x), 2) + F.pow(F.col("gy") - F.col(y), 2)
    return points.crossJoin(F.broadcast(grid)).groupBy("i", "j").agg(F.sum(F.col(weight) * F.exp(-d2 / (2 * sigma * sigma))).alias("heat"))
