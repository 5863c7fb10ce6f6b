"""Clusters of vectors as a kept model: centres by Lloyd's rounds, assignment by column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plait.sources.scratch import written

#: Centres are one broadcast row; more numbers than that are refused.
MOST = 1_000_000


def nearest(v: Column, centres: Column) -> Column:
    """The cluster of the nearest centre (squared distance to nine digits, the lower cluster of equals); null vectors as 0."""
    far = lambda c: F.round(F.aggregate(F.zip_with(v, c["v"], lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x), 9)
    return F.when(v.isNull(), 0).otherwise(F.array_min(F.transform(centres, lambda c: F.struct(far(c).alias("far"), c["cluster"].alias("cluster"))))["cluster"]).cast("int")


def assign(rows: DataFrame, centres: DataFrame, vector: str = "v", out: str = "cluster") -> DataFrame:
    """Adds the cluster of each row, from 1; 0 for rows without a vector.  ``centres``: (cluster, v), few."""
    one = centres.agg(F.collect_list(F.struct(F.col("cluster").cast("int").alias("cluster"), "v")).alias("_centres"))
    return rows.crossJoin(F.broadcast(one)).withColumn(out, nearest(F.col(vector), F.col("_centres"))).drop("_centres")


def fit(rows: DataFrame, start: DataFrame, rounds: int = 20) -> DataFrame:
    """(cluster, v): centres after as many rounds, or when none moves.  ``rows``: v; ``start``: first centres, from 1.

    A round is one pass, aggregated by cluster on the map side.  A cluster without rows keeps its centre."""
    centres = written(start.select(F.col("cluster").cast("int").alias("cluster"), "v"), "centres")
    shape = centres.agg(F.count("*").alias("k"), F.max(F.size("v")).alias("dims")).first()
    if not shape.k:
        raise ValueError("no first centres")
    if shape.k * shape.dims > MOST:
        raise ValueError(f"centres of over {MOST} numbers")
    rows = written(rows.where("v is not null").select("v"), "vectors")
    for _ in range(rounds):
        means = assign(rows, centres).groupBy("cluster").agg(F.array(*[F.avg(F.get("v", F.lit(i))) for i in range(shape.dims)]).alias("_v"))
        both = written(centres.join(F.broadcast(means), "cluster", "left").select("cluster", F.coalesce("_v", "v").alias("v"), (F.col("_v").isNotNull() & (F.col("_v") != F.col("v"))).alias("moved")), "centres")
        centres = both.select("cluster", "v")
        if both.where("moved").isEmpty():
            break
    return centres


def first_rows(rows: DataFrame, key: str, k: int) -> DataFrame:
    """First centres: the rows of the ``k`` smallest keys."""
    few = rows.where("v is not null").orderBy(key).limit(k)
    numbered = few.agg(F.array_sort(F.collect_list(F.struct(key, "v"))).alias("a"))
    return numbered.select(F.posexplode("a").alias("i", "c")).select((F.col("i") + 1).alias("cluster"), "c.v")
