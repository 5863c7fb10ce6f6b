"""Mixtures of correlated Gaussians over places, one for each group, fitted by distributed expectation maximisation.

An iteration is one pass: each row meets its group's parameters, its responsibilities are column expressions, and their
weighted moments are summed by group (on the map side first, so a hot group is no one task).  Parameters are a written table after each iteration.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plait.sources.scratch import written

FLOOR, MOST_RHO = 1e-3, 0.95
PARTS = ("w", "mx", "my", "sx", "sy", "rho")
#: Groups up to this many are broadcast to the rows.
MOST = 200_000


def component(x, y, k: int, p: str = "") -> Column:
    """Log of the weighted density of component ``k``; its parameters are the array columns ``PARTS``, after ``p``."""
    w, mx, my, sx, sy, r = (F.get(F.col(p + c), F.lit(k)) for c in PARTS)
    a, b, q = (x - mx) / sx, (y - my) / sy, 1 - r * r
    return F.log(w) - 0.5 * (a * a + b * b - 2 * r * a * b) / q - F.log(sx) - F.log(sy) - 0.5 * F.log(q) - math.log(2 * math.pi)


def total_log(parts: list[Column]) -> Column:
    top = F.greatest(*parts) if len(parts) > 1 else parts[0]
    return top + F.log(sum((F.exp(p - top) for p in parts), F.lit(0.0)))


def log_density(x, y, components: int, p: str = "") -> Column:
    return total_log([component(x, y, k, p) for k in range(components)])


def start(rows: DataFrame, keys: list[str], components: int) -> DataFrame:
    """Equal weights, uncorrelated, the group's deviations, and means spread over the group: evenly along x, to either side along y."""
    sd = lambda c: F.greatest(F.coalesce(F.stddev_pop(c), F.lit(0.0)), F.lit(FLOOR))
    g = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("x").alias("gx"), F.avg("y").alias("gy"), sd("x").alias("dx"), sd("y").alias("dy"))
    every = range(components)
    spread = [2 * (k + 0.5) / components - 1 for k in every]
    return g.select(
        *keys, "n", "gx", "gy", F.lit(None).cast("double").alias("ll"), F.array(*[F.lit(1 / components) for _ in every]).alias("w"),
        F.array(*[F.col("gx") + F.col("dx") * s for s in spread]).alias("mx"), F.array(*[F.col("gy") + F.col("dy") * (0.5 * (-1) ** k if components > 1 else 0.0) for k in every]).alias("my"),
        F.array(*[F.col("dx") for _ in every]).alias("sx"), F.array(*[F.col("dy") for _ in every]).alias("sy"), F.array(*[F.lit(0.0) for _ in every]).alias("rho"),
    )


def improved(rows: DataFrame, params: DataFrame, keys: list[str], components: int) -> DataFrame:
    """One iteration.  ``ll`` of the result is the log likelihood of the parameters that went in.

    A component without weight keeps its place; deviations are at least 1e-3, correlations within 0.95."""
    side = params.select(*[F.col(k).alias(f"_{k}") for k in keys], *[F.col(c).alias(f"_{c}") for c in ("gx", "gy", *PARTS)])
    side = F.broadcast(side) if params.count() <= MOST else side
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_{k}"))
    every = range(components)
    j = rows.join(side, on).withColumns({f"_l{k}": component(F.col("x"), F.col("y"), k, "_") for k in every})
    j = j.withColumn("_ll", total_log([F.col(f"_l{k}") for k in every])).withColumns({"_dx": F.col("x") - F.col("_gx"), "_dy": F.col("y") - F.col("_gy")})
    sums = []
    for k in every:
        r = F.exp(F.col(f"_l{k}") - F.col("_ll"))
        sums += [F.sum(r * v).alias(f"_{name}{k}") for name, v in (("r", F.lit(1.0)), ("x", F.col("_dx")), ("y", F.col("_dy")), ("xx", F.col("_dx") * F.col("_dx")), ("yy", F.col("_dy") * F.col("_dy")), ("xy", F.col("_dx") * F.col("_dy")))]
    old = F.first(F.struct(*[F.col(f"_{c}").alias(c) for c in ("gx", "gy", *PARTS)])).alias("_o")
    g = j.groupBy(*keys).agg(F.count("*").alias("n"), F.sum("_ll").alias("ll"), old, *sums)
    out: dict[str, list[Column]] = {c: [] for c in PARTS}
    for k in every:
        r = F.col(f"_r{k}")
        mean = {c: F.col(f"_{c}{k}") / r for c in ("x", "y")}
        dev = {c: F.greatest(F.sqrt(F.greatest(F.col(f"_{c}{c}{k}") / r - mean[c] * mean[c], F.lit(0.0))), F.lit(FLOOR)) for c in ("x", "y")}
        rho = (F.col(f"_xy{k}") / r - mean["x"] * mean["y"]) / (dev["x"] * dev["y"])
        new = {"w": F.greatest(r / F.col("n"), F.lit(1e-12)), "mx": F.col("_o")["gx"] + mean["x"], "my": F.col("_o")["gy"] + mean["y"], "sx": dev["x"], "sy": dev["y"], "rho": F.least(F.greatest(rho, F.lit(-MOST_RHO)), F.lit(MOST_RHO))}
        for c in PARTS:
            out[c].append(new[c] if c == "w" else F.when(r > 1e-9, new[c]).otherwise(F.get(F.col("_o")[c], F.lit(k))))
    return g.select(*keys, "n", F.col("_o")["gx"].alias("gx"), F.col("_o")["gy"].alias("gy"), "ll", *[F.array(*v).alias(c) for c, v in out.items()])


def fit(rows: DataFrame, keys: list[str], components: int = 8, iterations: int = 50, tolerance: float = 1e-6) -> DataFrame:
    """(keys, n, ll, w, mx, my, sx, sy, rho): each group's mixture over (x, y); arrays over components.

    Rows without a place are left out; null keys are a group.  It stops when the mean log likelihood of all rows gains less than
    ``tolerance``; ``ll`` is that of the last but one parameters.  A group of one place is a narrow Gaussian."""
    rows = written(rows.where("x is not null and y is not null").select(*keys, F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")), "places")
    params, before = written(start(rows, keys, components), "mixture"), None
    for _ in range(iterations):
        params = written(improved(rows, params, keys, components), "mixture")
        got = params.agg((F.sum("ll") / F.sum("n")).alias("mean")).first()["mean"]
        if got is None or before is not None and got - before < tolerance:
            break
        before = got
    return params.select(*keys, "n", "ll", *PARTS)


def scored(rows: DataFrame, params: DataFrame, on: Column, components: int) -> DataFrame:
    """Adds ``loc_nll``, the loss of (x, y) under the mixture that ``on`` chooses (null where none), and the mixture's mean place ``loc_x``, ``loc_y``."""
    side = params.select(*[F.col(c).alias(f"_{c}") for c in params.columns])
    side = F.broadcast(side) if params.count() <= MOST else side
    mean = lambda c: sum((F.get("_w", F.lit(k)) * F.get(f"_{c}", F.lit(k)) for k in range(components)), F.lit(0.0))
    j = rows.join(side, on, "left").withColumns({"loc_nll": -log_density(F.col("x"), F.col("y"), components, "_"), "loc_x": mean("mx"), "loc_y": mean("my")})
    return j.drop(*side.columns)
