"""Learned predictors: clusters of embeddings on Spark ML, the baseline network."""

from __future__ import annotations

from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plait.operators import perceptron


def clusters(rows: DataFrame, vector: str, k: int, seed: int = 0) -> DataFrame:
    """(vec_id, cluster): ids from 1, so that 0 stays for unknown."""
    if not 2 <= k < 99:
        raise ValueError("k must lie in 2..98")
    v = rows.select("vec_id", array_to_vector(vector).alias("features"))
    return KMeans(k=k, seed=seed).fit(v).transform(v).select("vec_id", (F.col("prediction") + 1).alias("cluster"))


def mlp_model(train: DataFrame, features: list[str], label: str, hidden: int = 16, iterations: int = 20, seed: int = 1337, identities=(), categories=(), history: str | None = None, length: int = 4, place=None, **sizes) -> perceptron.Perceptron:
    """The baseline network, fitted on the training rows by ``iterations`` rounds: embedded identities, categories and history, z-scored features, two rectified layers
    with dropout, the label's logits and, with ``place`` (names of x and y), a Gaussian of the place.  Values not seen there are unknown."""
    shape = perceptron.fitted(train, features, label, identities, categories, history, length, place, hidden=hidden, **sizes)
    return perceptron.train(train, shape, label, history, iterations, seed=seed)


def mlp(train: DataFrame, valid: DataFrame, features: list[str], label: str, **options) -> DataFrame:
    """(game, pa, seq, predicted) of the validation rows, and with a place its means and deviations."""
    out = mlp_model(train, features, label, **options).transform(valid)
    return out.select("game", "pa", "seq", "predicted", *[c for c in ("loc_x", "loc_y", "loc_sx", "loc_sy") if options.get("place")])
