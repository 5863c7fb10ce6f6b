"""A network of several heads, trained by distributed gradient rounds.

Embedded history, z-scored places and context go through two layers of rectified units to the heads: the next token, its outcome, the next state, and
the place as a mixture of correlated Gaussians.  A round sends the weights to all tasks; each gives one row, the gradient summed over its part of the
round's batch, and these are added up 32 at a time, twice, so that the driver takes one row for a thousand parts.  Batches are
written tables, so a round reads its batch alone; their order is drawn anew for each epoch.
"""

from __future__ import annotations

import json
import math
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plait.operators import heads
from plait.session import importable
from plait.sources import artifacts
from plait.sources.scratch import written

MOST_WEIGHTS = 2_000_000
FAN = 32  # gradients that one task adds up
INPUT = ["hist_ids", "hist_places", "cont"]
TARGET = ["labels", "mask", "place"]


@dataclass(frozen=True)
class Shape:
    """Sizes of a network.  ``loc``, ``state``, ``outcome``: weights of those losses beside the token's."""

    n_types: int
    n_outcomes: int
    history: int
    context: int
    embedding: int = 8
    hidden: int = 32
    components: int = 2
    loc: float = 1.0
    state: float = 1.0
    outcome: float = 1.0

    @property
    def classes(self) -> list[int]:
        return [self.n_types, self.n_outcomes, *[n for _, n in heads.STATE.values()]]

    @property
    def layers(self) -> dict[str, tuple[int, ...]]:
        """Names and shapes of all weights."""
        wide = self.history * (2 * self.embedding + 2) + self.context
        out = sum(self.classes) + 6 * self.components
        return {"types": (self.n_types, self.embedding), "outcomes": (self.n_outcomes, self.embedding), "w1": (wide, self.hidden), "b1": (self.hidden,), "w2": (self.hidden, self.hidden), "b2": (self.hidden,), "w3": (self.hidden, out), "b3": (out,)}


def start(shape: Shape, seed: int) -> dict[str, np.ndarray]:
    r = np.random.default_rng(seed)
    scale = lambda s: 1 / math.sqrt(s[0]) if len(s) == 2 else 0.0
    return {n: r.normal(0, 0.1 if n in ("types", "outcomes") else scale(s), s) if len(s) == 2 else np.zeros(s) for n, s in shape.layers.items()}


def flat(w: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([x.ravel() for x in w.values()])


def unflat(shape: Shape, v: np.ndarray) -> dict[str, np.ndarray]:
    ends = np.cumsum([math.prod(s) for s in shape.layers.values()])
    return {n: x.reshape(s) for (n, s), x in zip(shape.layers.items(), np.split(v, ends[:-1]))}


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def forward(shape: Shape, w: dict, ids: np.ndarray, places: np.ndarray, cont: np.ndarray):
    n, h = len(ids), shape.history
    x = np.concatenate([w["types"][ids[:, :h]].reshape(n, -1), w["outcomes"][ids[:, h:]].reshape(n, -1), places, cont], axis=1)
    h1 = np.maximum(x @ w["w1"] + w["b1"], 0)
    h2 = np.maximum(h1 @ w["w2"] + w["b2"], 0)
    return x, h1, h2, h2 @ w["w3"] + w["b3"]


def mixture(shape: Shape, raw: np.ndarray):
    """Shares, means, deviations and correlations of the place's mixture; deviations between e^-4 and e^2, correlations within 0.95."""
    pi, mx, my, lx, ly, t = (raw[:, i * shape.components : (i + 1) * shape.components] for i in range(6))
    return softmax(pi), mx, my, np.clip(lx, -4, 2), np.clip(ly, -4, 2), 0.95 * np.tanh(t)


def place_loss(shape: Shape, raw: np.ndarray, xy: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Negative log likelihood of each row's place, and its gradient by the raw outputs."""
    k = shape.components
    p, mx, my, lx, ly, r = mixture(shape, raw)
    sx, sy, q = np.exp(lx), np.exp(ly), 1 - r * r
    a, b = (xy[:, :1] - mx) / sx, (xy[:, 1:] - my) / sy
    e = a * a + b * b - 2 * r * a * b
    logs = np.log(p) - math.log(2 * math.pi) - lx - ly - 0.5 * np.log(q) - 0.5 * e / q
    top = logs.max(axis=1, keepdims=True)
    total = top + np.log(np.exp(logs - top).sum(axis=1, keepdims=True))
    share = np.exp(logs - total)
    inside = lambda i: (np.abs(raw[:, i * k : (i + 1) * k] + 1) <= 3)
    by = [share - p, share * (a - r * b) / (q * sx), share * (b - r * a) / (q * sy), share * (a * (a - r * b) / q - 1) * inside(3), share * (b * (b - r * a) / q - 1) * inside(4), share * (r / q + a * b / q - r * e / q**2) * 0.95 * (1 - (r / 0.95) ** 2)]
    return -total[:, 0], -np.concatenate(by, axis=1)


def losses(shape: Shape, w: dict, data: dict, n: int, n_masked: int) -> tuple[np.ndarray, np.ndarray]:
    """Gradient, and the sums of a part of a batch: rows, masked rows, losses of token, outcome, place and state, right tokens.

    ``n`` and ``n_masked`` are the whole batch's: the loss is the token's mean, plus the weighted means of outcome and place, plus the
    weighted mean over the state heads of their mean over rows with a next event."""
    ids, labels, mask = data["hist_ids"], data["labels"], data["mask"].astype("f8")
    x, h1, h2, out = forward(shape, w, ids, data["hist_places"], data["cont"])
    ends = np.cumsum(shape.classes)
    grad, row = np.zeros_like(out), np.arange(len(out))
    sums = np.zeros(7)
    sums[0], sums[1] = len(out), mask.sum()
    for i, (lo, hi) in enumerate(zip(ends - shape.classes, ends)):
        p = softmax(out[:, lo:hi])
        loss = -np.log(p[row, labels[:, i]])
        weight = np.full(len(out), (1.0, shape.outcome)[i] / max(n, 1)) if i < 2 else mask * shape.state / (len(heads.STATE) * max(n_masked, 1))
        if i == 0:
            sums[6] = (p.argmax(axis=1) == labels[:, 0]).sum()
        sums[2 + i if i < 2 else 5] += loss.sum() if i < 2 else (loss * mask).sum() / len(heads.STATE)
        p[row, labels[:, i]] -= 1
        grad[:, lo:hi] = p * weight[:, None]
    nll, by = place_loss(shape, out[:, ends[-1] :], data["place"])
    sums[4] = nll.sum()
    grad[:, ends[-1] :] = by * (shape.loc / max(n, 1))
    g = {"w3": h2.T @ grad, "b3": grad.sum(axis=0)}
    d = (grad @ w["w3"].T) * (h2 > 0)
    g |= {"w2": h1.T @ d, "b2": d.sum(axis=0)}
    d = (d @ w["w2"].T) * (h1 > 0)
    g |= {"w1": x.T @ d, "b1": d.sum(axis=0)}
    d, e, h = d @ w["w1"].T, shape.embedding, shape.history
    for name, start_ in (("types", 0), ("outcomes", h)):
        g[name] = np.zeros_like(w[name])
        np.add.at(g[name], ids[:, start_ : start_ + h].ravel(), d[:, start_ * e : (start_ + h) * e].reshape(-1, e))
    return np.concatenate([g[k].ravel() for k in shape.layers]), sums


def combined(shape: Shape, sums: np.ndarray) -> dict[str, float]:
    """Mean losses from summed ones: of each head, and the whole."""
    n, m = max(sums[0], 1), max(sums[1], 1)
    got = {"ce": sums[2] / n, "outcome_ce": sums[3] / n, "loc_nll": sums[4] / n, "state_loss": sums[5] / m, "acc": sums[6] / n}
    return {k: float(v) for k, v in got.items()} | {"n": int(sums[0]), "loss": float(got["ce"] + shape.outcome * got["outcome_ce"] + shape.loc * got["loc_nll"] + shape.state * got["state_loss"])}


def arrays(b: pa.RecordBatch, columns: list[str]) -> dict[str, np.ndarray]:
    out = {}
    for c in columns:
        v = b.column(b.schema.get_field_index(c))
        out[c] = v.flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1) if pa.types.is_list(v.type) else v.to_numpy(zero_copy_only=False)
    return out


def summed(rows: DataFrame, columns: list[str], of) -> np.ndarray | None:
    """The sum of ``of(data, part, k)``, a vector of the k-th piece of a part, over all rows: a row a part, added up ``FAN`` at a time, twice, then on the
    driver; always in the order of parts.  None without rows."""

    def part(batches):
        from pyspark import TaskContext

        here, total, k = TaskContext.get().partitionId(), None, 0
        for b in batches:
            for at in range(0, b.num_rows, 4096):
                got = of(arrays(b.slice(at, 4096), columns), here, k)
                total, k = got if total is None else total + got, k + 1
        if total is not None:
            yield pa.RecordBatch.from_pydict({"part": pa.array([here], pa.int64()), "v": pa.array([total.tobytes()], pa.binary())})

    def added(t: pa.Table) -> pa.Table:
        t = t.sort_by("part")
        return pa.table({"part": t.column("part").slice(0, 1), "v": pa.array([np.sum([np.frombuffer(x.as_py()) for x in t.column("v")], axis=0).tobytes()], pa.binary())})

    parts = rows.select(*columns).mapInArrow(part, "part long, v binary")
    for width in (FAN, FAN * FAN):
        parts = parts.withColumn("up", F.floor(F.col("part") / width)).groupBy("up").applyInArrow(added, "part long, v binary")
    got = parts.collect()
    return np.sum([np.frombuffer(r.v) for r in sorted(got, key=lambda r: r.part)], axis=0) if got else None


def totals(rows: DataFrame, shape: Shape, weights: np.ndarray, n: int, n_masked: int, gradient: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and sums over all rows."""
    sent = rows.sparkSession.sparkContext.broadcast(weights)

    def of(data, part, k):
        g, s = losses(shape, unflat(shape, sent.value), data, n, n_masked)
        return np.concatenate([g if gradient else g[:0], s])

    total = summed(rows, [*INPUT, *TARGET], of)
    sent.unpersist()
    size = len(weights) * gradient + 7
    total = np.zeros(size) if total is None else total
    return total[: size - 7], total[size - 7 :]


@dataclass
class Network:
    """Weights with their sizes; saved as a table of weights and a JSON file beside it."""

    shape: Shape
    weights: np.ndarray

    def save(self, spark: SparkSession, path: str, overwrite: bool = False) -> None:
        rows = [(i, n, x.ravel().tolist()) for i, (n, x) in enumerate(unflat(self.shape, self.weights).items())]
        artifacts.write_json(spark, f"{path}/shape.json", asdict(self.shape), overwrite)
        spark.createDataFrame(rows, "place int, name string, weights array<double>").coalesce(1).write.mode("overwrite" if overwrite else "errorifexists").parquet(f"{path}/weights")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Network:
        shape = Shape(**artifacts.read_json(spark, f"{path}/shape.json"))
        rows = spark.read.parquet(f"{path}/weights").orderBy("place").collect()
        return cls(shape, np.concatenate([np.array(r.weights) for r in rows]))

    def predict(self, rows: DataFrame) -> DataFrame:
        """Adds ``p_<head>`` (probabilities), the mean place ``loc_x``, ``loc_y`` and the mixture ``loc_parts``, z-scored, to rows that carry ``INPUT``."""
        from pyspark.sql.pandas.types import to_arrow_schema
        from pyspark.sql.types import StructType

        importable(rows.sparkSession)
        names = [f"p_{h}" for h in ("type", "outcome", *heads.STATE)]
        new = StructType.fromDDL(", ".join(f"{n} array<double>" for n in names) + ", loc_x double, loc_y double, loc_parts array<double>")
        rows = rows.drop(*new.names)
        schema = StructType([*rows.schema.fields, *new.fields])
        arrow, sent, shape = to_arrow_schema(schema), rows.sparkSession.sparkContext.broadcast(self.weights), self.shape

        def run(batches):
            w, ends = unflat(shape, sent.value), np.cumsum(shape.classes)
            for b in batches:
                if not b.num_rows:
                    continue
                data = arrays(b, INPUT)
                out = forward(shape, w, data["hist_ids"], data["hist_places"], data["cont"])[3]
                p, mx, my, lx, ly, r = mixture(shape, out[:, ends[-1] :])
                lists = [softmax(out[:, lo:hi]) for lo, hi in zip(ends - shape.classes, ends)]
                lists += [(p * mx).sum(axis=1), (p * my).sum(axis=1), np.concatenate([p, mx, my, np.exp(lx), np.exp(ly), r], axis=1)]
                as_list = lambda x: pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel())) if x.ndim == 2 else pa.array(x)
                yield pa.RecordBatch.from_arrays([*b.columns, *map(as_list, lists)], schema=arrow)

        return rows.mapInArrow(run, schema)


def train(rows: DataFrame, valid: DataFrame, shape: Shape, keys: list[str], run: str | None = None, epochs: int = 5, batches: int = 4, rate: float = 1e-3, decay: float = 1e-2, clip: float = 1.0, seed: int = 1337) -> tuple[Network, list[dict]]:
    """The network of the least validation loss, and each epoch's losses on both parts.

    Rows are dealt to ``batches`` by a hash of ``keys``: each batch is filtered from ``rows`` as they lie, which reads them once a batch but neither shuffles nor sorts them; gradients are clipped to the norm ``clip``; the optimiser is Adam with decoupled decay.  With ``run``, the
    best network so far is kept there and every epoch logged.  No training rows is an error."""
    spark = rows.sparkSession
    importable(spark)
    v = flat(start(shape, seed))
    if len(v) > MOST_WEIGHTS:
        raise ValueError(f"over {MOST_WEIGHTS} weights")
    batch = F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(batches))
    dealt = [written(rows.where(batch == b).select(*INPUT, *TARGET), "batch") for b in range(batches)]
    held = written(valid.select(*INPUT, *TARGET), "held-out")
    counted = [d.agg(F.count("*").alias("n"), F.sum("mask").alias("m")).first() for d in dealt]
    sizes = {b: (r.n, r.m) for b, r in enumerate(counted) if r.n}
    if not sizes:
        raise ValueError("no training rows")
    one, two, step, best, history = np.zeros_like(v), np.zeros_like(v), 0, None, []
    for epoch in range(1, epochs + 1):
        seen = np.zeros(7)
        for b in np.random.default_rng([seed, epoch]).permutation(sorted(sizes)).tolist():
            g, sums = totals(dealt[b], shape, v, *sizes[b])
            seen += sums
            norm = float(np.sqrt((g * g).sum()))
            g = g * min(1.0, clip / (norm + 1e-6))
            step += 1
            one, two = 0.9 * one + 0.1 * g, 0.999 * two + 0.001 * g * g
            v = v * (1 - rate * decay) - rate * (one / (1 - 0.9**step)) / (np.sqrt(two / (1 - 0.999**step)) + 1e-8)
        after = combined(shape, totals(held, shape, v, 1, 1, gradient=False)[1])
        history.append({"epoch": epoch, "train_loss": combined(shape, seen)["loss"], **{f"valid_{k}": x for k, x in after.items()}})
        model = Network(shape, v)
        if run:
            artifacts.save_if_better(spark, run, model, after["loss"], epoch=epoch, train_loss=history[-1]["train_loss"])
        if best is None or after["loss"] < best[0]:
            best = after["loss"], model
    return best[1], history
