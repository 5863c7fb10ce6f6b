"""The baseline network: identities, context and flattened history through two layers of rectified units to a token and a place.

Embedded identities and categories, z-scored context, and the embedded tokens and z-scored places of the history go through two rectified layers with
dropout to the token's logits and a Gaussian for each coordinate of the place.  Rounds of distributed gradients are added up as in ``network``; the
optimiser is Adam with decoupled decay on gradients of bounded norm.

An identity's vector is the sum of two rows of a table of ``slots``, each named by a hash of its own, so that the weights stay bounded however
many identities there are, and nearly every one has a sum of its own.  Identities that training has not seen have the zero vector: a join tells
them; categories and history tokens not seen have a row for unknown ones.  Nulls count as unknown, null context as its mean.
"""

from __future__ import annotations

import math
from dataclasses import asdict, dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plait.operators import network
from plait.operators.features import MOST_INLINE, coded
from plait.session import importable
from plait.sources import artifacts
from plait.sources.scratch import written

INPUT = ["x", "ids", "cats", "hist", "hist_xy"]
TARGET = ["y", "xy"]
LOW, HIGH = -4.0, 2.0  # of a deviation's logarithm


@dataclass(frozen=True)
class Shape:
    """What is fixed before training: names of the inputs, dictionaries and norms of the training rows, and sizes."""

    features: list[str]
    identities: list[str]
    labels: list[str]
    categories: dict[str, list[str]]
    norms: dict[str, list[float]]
    place: list[str] | None = None
    history: int = 0
    hidden: int = 16
    embedding: int = 8
    slots: int = 16_384
    dropout: float = 0.1
    loc: float = 1.0

    @property
    def layers(self) -> dict[str, tuple[int, ...]]:
        """Names and shapes of all weights."""
        e, h = self.embedding, self.hidden
        wide = e * (len(self.identities) + len(self.categories)) + len(self.features) + self.history * (e + 2)
        out = {f"id_{f}": (self.slots, e) for f in self.identities} | {f"cat_{c}": (len(v) + 1, e) for c, v in self.categories.items()}
        out |= {"hist": (len(self.labels) + 1, e)} if self.history else {}
        out |= {"w1": (wide, h), "b1": (h,), "w2": (h, h), "b2": (h,), "type": (h, len(self.labels)), "type_b": (len(self.labels),)}
        return out | ({"loc": (h, 4), "loc_b": (4,)} if self.place else {})


def start(shape: Shape, seed: int) -> np.ndarray:
    r = np.random.default_rng(seed)
    scale = lambda n, s: 0.1 if n.startswith(("id_", "cat_", "hist")) else math.sqrt(2 / s[0])
    return np.concatenate([(r.normal(0, scale(n, s), s) if len(s) == 2 else np.zeros(s)).ravel() for n, s in shape.layers.items()])


def forward(shape: Shape, w: dict, data: dict, drop: np.random.Generator | None = None) -> dict:
    """Inputs, layers, logits and the place's means and logarithms of deviations.  ``drop`` leaves units out, as in training."""
    n, parts = len(data["x"]), []
    for i, f in enumerate(shape.identities):
        for k in (2 * i, 2 * i + 1):
            row = w[f"id_{f}"][data["ids"][:, k]] * (data["ids"][:, k] >= 0)[:, None]
            parts.append(row) if k % 2 == 0 else parts.__setitem__(-1, parts[-1] + row)
    parts += [w[f"cat_{c}"][data["cats"][:, i]] for i, c in enumerate(shape.categories)]
    if shape.history:
        parts += [w["hist"][data["hist"]].reshape(n, -1), data["hist_xy"]]
    x = np.concatenate([*parts, data["x"]], axis=1)
    keep = lambda a: (drop.random(a.shape) >= shape.dropout) / (1 - shape.dropout) if drop is not None and shape.dropout else 1.0
    h1 = np.maximum(x @ w["w1"] + w["b1"], 0)
    h1 = h1 * (k1 := keep(h1))
    h2 = np.maximum(h1 @ w["w2"] + w["b2"], 0)
    h2 = h2 * (k2 := keep(h2))
    out = {"in": x, "h1": h1, "h2": h2, "k1": k1, "k2": k2, "logits": h2 @ w["type"] + w["type_b"]}
    return out | ({"loc": h2 @ w["loc"] + w["loc_b"]} if shape.place else {})


def losses(shape: Shape, w: dict, data: dict, n: int, drop: np.random.Generator | None = None) -> np.ndarray:
    """The gradient of the mean loss over a batch of ``n`` rows, of which these are a part; then the sums of rows, of the token's loss and of the place's."""
    o, rows = forward(shape, w, data, drop), np.arange(len(data["x"]))
    p = network.softmax(o["logits"])
    sums = np.array([len(rows), -np.log(np.maximum(p[rows, data["y"]], 1e-300)).sum(), 0.0])
    p[rows, data["y"]] -= 1
    p /= n
    g = {"type": o["h2"].T @ p, "type_b": p.sum(axis=0)}
    d = p @ w["type"].T
    if shape.place:
        mu, raw = o["loc"][:, :2], o["loc"][:, 2:]
        s = np.exp(np.clip(raw, LOW, HIGH))
        known = np.isfinite(data["xy"]).all(axis=1, keepdims=True)  # a row without a place has no loss of it
        z = np.where(known, (np.nan_to_num(data["xy"]) - mu) / s, 0.0)
        sums[2] = (0.5 * known * (z * z + 2 * np.log(s) + math.log(2 * math.pi))).sum()
        by = np.concatenate([-z / s, known * (1 - z * z) * ((raw >= LOW) & (raw <= HIGH))], axis=1) * (shape.loc / n)
        g |= {"loc": o["h2"].T @ by, "loc_b": by.sum(axis=0)}
        d = d + by @ w["loc"].T
    d = d * o["k2"] * (o["h2"] > 0)
    g |= {"w2": o["h1"].T @ d, "b2": d.sum(axis=0)}
    d = (d @ w["w2"].T) * o["k1"] * (o["h1"] > 0)
    g |= {"w1": o["in"].T @ d, "b1": d.sum(axis=0)}
    d, e, at = d @ w["w1"].T, shape.embedding, 0
    for i, f in enumerate(shape.identities):
        g[f"id_{f}"] = np.zeros_like(w[f"id_{f}"])
        for k in (2 * i, 2 * i + 1):
            known = data["ids"][:, k] >= 0
            np.add.at(g[f"id_{f}"], data["ids"][known, k], d[known, at : at + e])
        at += e
    for i, c in enumerate(shape.categories):
        g[f"cat_{c}"] = np.zeros_like(w[f"cat_{c}"])
        np.add.at(g[f"cat_{c}"], data["cats"][:, i], d[:, at : at + e])
        at += e
    if shape.history:
        g["hist"] = np.zeros_like(w["hist"])
        np.add.at(g["hist"], data["hist"].ravel(), d[:, at : at + shape.history * e].reshape(-1, e))
    return np.concatenate([*(g[k].ravel() for k in shape.layers), sums])


def totals(rows: DataFrame, shape: Shape, weights: np.ndarray, n: int, seed: tuple[int, ...] | None = None) -> np.ndarray:
    """:func:`losses` over all rows; with ``seed`` units are dropped, drawn anew for each part."""
    spark = rows.sparkSession
    sent = spark.sparkContext.broadcast(weights)

    def of(data, part, k):
        return losses(shape, network.unflat(shape, sent.value), data, n, None if seed is None else np.random.default_rng([*seed, part, k]))

    got = network.summed(rows, [*INPUT, *TARGET], of)
    sent.unpersist()
    return np.zeros(len(weights) + 3) if got is None else got


def fitted(train: DataFrame, features: list[str], label: str, identities=(), categories=(), history: str | None = None, length: int = 4, place=None, **sizes) -> Shape:
    """The dictionaries and norms of the training rows.  ``history``: a column of arrays of structs (token, x, y) whose last ``length`` count; ``place``: the names of x and y."""
    values = {}
    for c in (label, *categories):
        got = [r[0] for r in train.where(F.col(c).isNotNull()).select(F.col(c).cast("string")).distinct().limit(MOST_INLINE + 1).collect()]
        if len(got) > MOST_INLINE:
            raise ValueError(f"{c} has over {MOST_INLINE} values; give it as an identity")
        values[c] = sorted(got)
    if not values[label]:
        raise ValueError("no training rows")
    columns = [*features, *(place or ())]
    stats = train.agg(F.count("*").alias("_n"), *[f for c in columns for f in (F.avg(c).alias(f"{c}_mean"), F.coalesce(F.nullif(F.stddev_samp(c), F.lit(0.0)), F.lit(1.0)).alias(f"{c}_std"))]).first()
    norms = {c: [stats[f"{c}_mean"] or 0.0, stats[f"{c}_std"]] for c in columns}
    return Shape(list(features), list(identities), values[label], {c: values[c] for c in categories}, norms, list(place) if place else None, length if history else 0, **sizes)


def encoded(rows: DataFrame, shape: Shape, history: str | None, known: dict[str, DataFrame] | None = None) -> DataFrame:
    """Adds ``INPUT``.  ``known``: the identities of training by field; without it all are known."""
    seen = {}
    for f in shape.identities:
        seen[f] = F.col(f).isNotNull()
        if known is not None:
            rows = rows.join(known[f].select(F.col("identity").alias(f"_known_{f}")), F.col(f).cast("string") == F.col(f"_known_{f}"), "left")
            seen[f] = F.col(f"_known_{f}").isNotNull()
    z = lambda v, c: (v.cast("double") - F.lit(shape.norms[c][0])) / F.lit(shape.norms[c][1])
    ints = lambda v: F.array(*v) if v else F.array().cast("array<int>")
    doubles = lambda v: F.array(*v) if v else F.array().cast("array<double>")
    slot = lambda f, k: F.when(seen[f], F.pmod(F.xxhash64(F.lit(k), F.col(f).cast("string")), F.lit(shape.slots)).cast("int")).otherwise(-1)
    tokens = dict(zip(shape.labels, range(1, len(shape.labels) + 1)))
    hist, xy = F.array().cast("array<int>"), F.array().cast("array<double>")
    if shape.history:
        item = lambda i: F.get(F.col("_last"), F.lit(i))
        size = F.coalesce(F.size(history), F.lit(0))
        rows = rows.withColumn("_last", F.when(size > shape.history, F.slice(F.col(history), -shape.history, shape.history)).otherwise(F.col(history)))
        hist = F.array(*[coded(item(i)["token"].cast("string"), tokens) for i in range(shape.history)])  # an event that is missing is unknown, at the mean place
        px, py = shape.place
        xy = F.array(*[F.coalesce(z(item(i)[a], c), F.lit(0.0)) for i in range(shape.history) for a, c in (("x", px), ("y", py))])
    cats = [coded(F.col(c).cast("string"), dict(zip(v, range(1, len(v) + 1)))) for c, v in shape.categories.items()]
    new = {"x": doubles([F.coalesce(z(F.col(c), c), F.lit(0.0)) for c in shape.features]), "ids": ints([slot(f, k) for f in shape.identities for k in (0, 1)]), "cats": ints(cats), "hist": hist, "hist_xy": xy}
    return rows.select("*", *[v.alias(f"_{k}") for k, v in new.items()]).drop("_last", *[f"_known_{f}" for f in shape.identities])


def part_of(rows: DataFrame, *more: str) -> DataFrame:
    """``INPUT`` and further columns, without the underscores that keep them apart from the rows' own."""
    return rows.select(*more, *[F.col(f"_{c}").alias(c) for c in INPUT])


@dataclass
class Perceptron:
    """A trained network; saved as a table of weights, a JSON file and a table of identities beside it."""

    shape: Shape
    weights: np.ndarray
    history: str | None = None
    known: dict[str, DataFrame] = field(default_factory=dict)
    curve: list[float] = field(default_factory=list)

    def save(self, spark: SparkSession, path: str, overwrite: bool = False) -> None:
        mode = "overwrite" if overwrite else "errorifexists"
        rows = [(i, n, x.ravel().tolist()) for i, (n, x) in enumerate(network.unflat(self.shape, self.weights).items())]
        artifacts.write_json(spark, f"{path}/shape.json", asdict(self.shape) | {"history_column": self.history}, overwrite)
        spark.createDataFrame(rows, "place int, name string, weights array<double>").coalesce(1).write.mode(mode).parquet(f"{path}/weights")
        for f, ids in self.known.items():
            ids.write.mode(mode).parquet(f"{path}/identities/{f}")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Perceptron:
        fixed = artifacts.read_json(spark, f"{path}/shape.json")
        history, shape = fixed.pop("history_column", None), Shape(**fixed)
        rows = spark.read.parquet(f"{path}/weights").orderBy("place").collect()
        known = {f: spark.read.parquet(f"{path}/identities/{f}") for f in shape.identities}
        return cls(shape, np.concatenate([np.array(r.weights) for r in rows]), history, known)

    def transform(self, rows: DataFrame) -> DataFrame:
        """Adds ``predicted``, the likeliest token (of equal ones the first), and with a place its means ``loc_x``, ``loc_y`` and deviations ``loc_sx``, ``loc_sy``."""
        from pyspark.sql.pandas.types import to_arrow_schema
        from pyspark.sql.types import StructType

        importable(rows.sparkSession)
        new = StructType.fromDDL("predicted string" + (", loc_x double, loc_y double, loc_sx double, loc_sy double" if self.shape.place else ""))
        rows = rows.drop(*new.names)
        schema = StructType([*rows.schema.fields, *new.fields])
        arrow, shape, sent = to_arrow_schema(schema), self.shape, rows.sparkSession.sparkContext.broadcast(self.weights)

        def run(batches):
            w, names = network.unflat(shape, sent.value), np.array(shape.labels, dtype=object)
            for b in batches:
                if not b.num_rows:
                    continue
                own = [b.column(i) for i, c in enumerate(b.schema.names) if c not in hidden]
                o = forward(shape, w, {c: network.arrays(b, [f"_{c}"])[f"_{c}"] for c in INPUT})
                out = [pa.array(names[o["logits"].argmax(axis=1)], pa.string())]
                if shape.place:
                    norm = np.array([shape.norms[c] for c in shape.place])
                    at = np.concatenate([o["loc"][:, :2] * norm[:, 1] + norm[:, 0], np.exp(np.clip(o["loc"][:, 2:], LOW, HIGH)) * norm[:, 1]], axis=1)
                    out += [pa.array(np.ascontiguousarray(v)) for v in at.T]
                yield pa.RecordBatch.from_arrays([*own, *out], schema=arrow)

        hidden = {f"_{c}" for c in INPUT}
        return encoded(rows, shape, self.history, self.known).mapInArrow(run, schema)


def train(rows: DataFrame, shape: Shape, label: str, history: str | None = None, rounds: int = 20, rate: float = 0.03, decay: float = 1e-2, clip: float = 1.0, seed: int = 1337, least: int = 100_000) -> Perceptron:
    """The network after ``rounds`` rounds.  Rows are dealt to as many batches as there are rounds, but of about ``least`` rows or more, and written once; a round reads
    one batch, in an order drawn anew for each pass.  Rows without a label are left out; no training rows is an error."""
    importable(rows.sparkSession)
    v = start(shape, seed)
    if len(v) > network.MOST_WEIGHTS:
        raise ValueError(f"over {network.MOST_WEIGHTS} weights")
    rows = rows.where(F.col(label).isNotNull())
    ids = [written(rows.where(F.col(f).isNotNull()).select(F.col(f).cast("string").alias("identity")).distinct(), "identities") for f in shape.identities]
    batches = min(rounds, rows.count() // least) or 1
    y = coded(F.col(label).cast("string"), dict(zip(shape.labels, range(len(shape.labels)))))
    place = F.array(*[F.coalesce((F.col(c).cast("double") - shape.norms[c][0]) / shape.norms[c][1], F.lit(math.nan)) for c in shape.place]) if shape.place else F.array().cast("array<double>")
    inputs = encoded(rows.select("*", y.alias("_y"), place.alias("_xy"), F.pmod(F.xxhash64(F.lit(seed), *rows.columns), F.lit(batches)).cast("int").alias("_batch")), shape, history)
    dealt = written(part_of(inputs, F.col("_y").alias("y"), F.col("_xy").alias("xy"), F.col("_batch").alias("batch")), "batch", by="batch")
    sizes = {r["batch"]: r["count"] for r in dealt.groupBy("batch").count().collect()}
    if not sizes:
        raise ValueError("no training rows")
    one, two, order, curve = np.zeros_like(v), np.zeros_like(v), [], []
    for step in range(1, rounds + 1):
        order = order or np.random.default_rng([seed, step]).permutation(sorted(sizes)).tolist()
        b = order.pop()
        got = totals(dealt.where(F.col("batch") == b), shape, v, sizes[b], (seed, step))
        g, (n, ce, nll) = got[:-3], got[-3:]
        curve.append(float(ce / n + shape.loc * nll / n))
        g = g * min(1.0, clip / (float(np.sqrt((g * g).sum())) + 1e-6))
        one, two = 0.9 * one + 0.1 * g, 0.999 * two + 0.001 * g * g
        v = v * (1 - rate * decay) - rate * (one / (1 - 0.9**step)) / (np.sqrt(two / (1 - 0.999**step)) + 1e-8)
    return Perceptron(shape, v, history, dict(zip(shape.identities, ids)), curve)
