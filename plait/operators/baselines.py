"""Smoothed empirical predictors: fitted at several grains, evaluated with fallback to the global distribution."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plait.sources.scratch import written

#: Grains by name, each with its key columns.
GRAINS = {
    "global": [],
    "entity": ["pitcher"],
    "count": ["pitcher", "balls", "strikes"],
    "prev": ["pitcher", "balls", "strikes", "prev_type"],
    "outcome": ["pitcher", "balls", "strikes", "prev_type", "prev_outcome"],
}


def fit(rows: DataFrame, keys: list[str], target: str = "y") -> DataFrame:
    """(keys, target, n, mean_x, mean_y): class counts and the group's mean place."""
    return rows.groupBy(*keys, target).agg(F.count("*").alias("n"), F.sum("x").alias("sum_x"), F.sum("y_loc").alias("sum_y"))


def fit_all(rows: DataFrame) -> DataFrame:
    """All grains in one pass: a rollup over the nested keys within each class."""
    keys = GRAINS["outcome"]
    levels = [keys[:i] for i in (0, 1, 3, 4, 5)]
    grouped = rows.groupingSets([[F.col(k) for k in ks] + [F.col("y")] for ks in levels], *[F.col(k) for k in keys], F.col("y"))
    return grouped.agg(F.count("*").alias("n"), F.grouping_id().alias("gid"))


def group_distributions(counts: DataFrame, keys: list[str], n_classes: int, alpha: float) -> DataFrame:
    """One row a group: its size, counts as an array over all classes, the best class and the best three.

    Ties go to the lower class; classes never seen take part with 0."""
    arr = F.array(*[F.coalesce(F.sum(F.when(F.col("y") == i, F.col("n"))), F.lit(0)) for i in range(n_classes)])
    g = counts.groupBy(*keys).agg(F.sum("n").alias("group_n"), arr.alias("c"))
    order = F.array_sort(F.transform("c", lambda x, i: F.struct((-x).alias("neg"), i.alias("i"))))
    top = F.transform(F.slice(order, 1, 3), lambda s: s["i"])
    return g.withColumn("top3", top).withColumn("denominator", F.col("group_n") + F.lit(alpha * n_classes))


def centred(counts: DataFrame, keys: list[str], n_classes: int, alpha: float) -> DataFrame:
    """:func:`group_distributions` with the group's mean place, from the same counts in one aggregation."""
    arr = F.array(*[F.coalesce(F.sum(F.when(F.col("y") == i, F.col("n"))), F.lit(0)) for i in range(n_classes)])
    g = counts.groupBy(*keys).agg(F.sum("n").alias("group_n"), arr.alias("c"), (F.sum("sum_x") / F.sum("n")).alias("m_x"), (F.sum("sum_y") / F.sum("n")).alias("m_y"))
    order = F.array_sort(F.transform("c", lambda x, i: F.struct((-x).alias("neg"), i.alias("i"))))
    return g.withColumn("top3", F.transform(F.slice(order, 1, 3), lambda s: s["i"])).withColumn("denominator", F.col("group_n") + F.lit(alpha * n_classes))


#: Groups up to this many are broadcast to the rows.
MOST = 200_000
PREDICTED = ["c", "top3", "denominator", "m_x", "m_y"]


def predicted(train: DataFrame, valid: DataFrame, keys: list[str], n_classes: int, alpha: float = 1.0) -> DataFrame:
    """``valid`` with the counts ``c`` of its group in ``train``, their ``top3`` and ``denominator``, and the mean place; the global ones where
    the group was never seen (``fallback`` 1).  Both carry the keys, ``y``, ``x`` and ``y_loc``.  Counts and groups are written tables, so ``train`` is read once."""
    counts = written(fit(train, keys), "counts")
    everywhere = centred(counts, [], n_classes, alpha).select(*[F.col(x).alias(f"g_{x}") for x in PREDICTED])
    rows = valid.crossJoin(F.broadcast(everywhere))
    if keys:
        side = written(centred(counts, keys, n_classes, alpha).select(*[F.col(k).alias(f"k_{k}") for k in keys], *PREDICTED), "groups")
        side = F.broadcast(side) if side.count() <= MOST else side
        rows = rows.join(side, reduce(lambda a, b: a & b, [F.col(k) == F.col(f"k_{k}") for k in keys]), "left").drop(*[f"k_{k}" for k in keys])
    else:
        rows = rows.withColumns({x: F.col(f"g_{x}") for x in PREDICTED})
    rows = rows.withColumn("fallback", F.col("denominator").isNull().cast("int"))
    return rows.withColumns({x: F.coalesce(x, f"g_{x}") for x in PREDICTED}).drop(*[f"g_{x}" for x in PREDICTED])


def evaluate(train: DataFrame, valid: DataFrame, keys: list[str], n_classes: int, alpha: float = 1.0) -> DataFrame:
    """One row: n, fallbacks, top-1 and top-3 accuracy, cross-entropy and place error of the predictor on ``valid``."""
    rows = predicted(train, valid, keys, n_classes, alpha)
    p = (F.get("c", F.col("y")) + F.lit(alpha)) / F.col("denominator")
    err = (F.pow(F.col("x") - F.col("m_x"), 2) + F.pow(F.col("y_loc") - F.col("m_y"), 2)) / 2
    return rows.agg(
        F.count("*").alias("n"), F.sum("fallback").alias("fallback_n"),
        F.round(F.avg((F.col("top3")[0] == F.col("y")).cast("double")), 6).alias("acc"),
        F.round(F.avg(F.array_contains("top3", F.col("y")).cast("double")), 6).alias("top3"),
        F.round(F.avg(-F.log(p)), 6).alias("ce"), F.round(F.sqrt(F.avg(err)), 6).alias("loc_rmse"),
    )


def top_classes(counts: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The ``k`` most frequent classes of each group, with their rank."""
    w = Window.partitionBy(*keys).orderBy(F.desc("n"), F.asc("y"))
    return counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
