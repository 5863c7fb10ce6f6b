"""Inference of a sequence model from stored weights: self-attention over a session's history, in numpy over Arrow batches.

A context token (embedded ids and z-scored context) stands before the history's tokens (type, outcome and place, each with its position).  Layers
normalise first, attend, then widen; padded history (type 0) is no one's key, so what it holds changes nothing.  The context token's output gives
the heads: the next type, the place's mixture given the expected type, the outcome given type and place, and the next state.  Weights come from a table
that any trainer may have written; fitting them is not done here."""

from __future__ import annotations

import json
import math
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from plait.operators import heads, network
from plait.session import importable
from plait.sources import artifacts

EPS = 1e-5
CHUNK = 2048  # rows that pass together


@dataclass(frozen=True)
class Plan:
    """Sizes of a model: ``ids`` are (classes, width) of each context id, ``state`` whether it has the heads of the next state."""

    ids: tuple[tuple[int, int], ...]
    context: int
    n_types: int
    n_outcomes: int
    history: int
    width: int = 32
    n_heads: int = 4
    layers: int = 2
    components: int = 2
    state: bool = True

    def __post_init__(self):
        if self.width % self.n_heads:
            raise ValueError("width must divide by n_heads")

    @property
    def weights(self) -> dict[str, tuple[int, ...]]:
        """Names and shapes of all weights."""
        d, k = self.width, self.components
        out: dict[str, tuple[int, ...]] = {f"id{i}": s for i, s in enumerate(self.ids)}
        linear = lambda n, a, b: out.update({f"{n}.w": (a, b), f"{n}.b": (b,)})
        norm = lambda n: out.update({f"{n}.g": (d,), f"{n}.b": (d,)})
        linear("context", sum(w for _, w in self.ids) + self.context, d)
        out |= {"type": (self.n_types, d), "outcome": (self.n_outcomes, d), "position": (self.history + 1, d)}
        linear("place", 2, d)
        norm("tokens")
        for i in range(self.layers):
            norm(f"{i}.one")
            linear(f"{i}.qkv", d, 3 * d)
            linear(f"{i}.out", d, d)
            norm(f"{i}.two")
            linear(f"{i}.up", d, 4 * d)
            linear(f"{i}.down", 4 * d, d)
        norm("last")
        linear("head.type", d, self.n_types)
        out["belief"] = (self.n_types, d)
        linear("belief.to", d, d)
        norm("loc")
        linear("head.loc", d, 6 * k)
        linear("loc.to", 2, d)
        norm("told")
        linear("head.outcome", d, self.n_outcomes)
        if self.state:
            linear("head.state", d, sum(n for _, n in heads.STATE.values()))
        return out


def start(plan: Plan, seed: int) -> dict[str, np.ndarray]:
    """Random weights, for tests and as a trainer's first ones."""
    r = np.random.default_rng(seed)
    return {n: np.ones(s) if n.endswith(".g") else r.normal(0, 1 / math.sqrt(s[0]), s) if len(s) == 2 else np.zeros(s) for n, s in plan.weights.items()}


def erf(x: np.ndarray) -> np.ndarray:
    """Within 1.5e-7."""
    t = 1 / (1 + 0.3275911 * np.abs(x))
    return np.sign(x) * (1 - t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429)))) * np.exp(-x * x))


def gelu(x: np.ndarray) -> np.ndarray:
    return 0.5 * x * (1 + erf(x / math.sqrt(2)))


def forward(plan: Plan, w: dict, ids: np.ndarray, cont: np.ndarray, types: np.ndarray, outcomes: np.ndarray, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
    """Raw outputs: ``type``, ``loc`` (the mixture's six groups), ``outcome`` and ``state``."""
    linear = lambda n, v: v @ w[f"{n}.w"] + w[f"{n}.b"]

    def norm(n, v):
        c = v - v.mean(axis=-1, keepdims=True)
        return c / np.sqrt((c * c).mean(axis=-1, keepdims=True) + EPS) * w[f"{n}.g"] + w[f"{n}.b"]

    rows, d, h = len(cont), plan.width, plan.n_heads
    first = linear("context", np.concatenate([*[w[f"id{i}"][ids[:, i]] for i in range(len(plan.ids))], cont], axis=1))
    told = w["type"][types] + w["outcome"][outcomes] + linear("place", np.stack([x, y], axis=2))
    t = norm("tokens", np.concatenate([first[:, None], told], axis=1) + w["position"])
    n = t.shape[1]
    hidden = np.concatenate([np.zeros((rows, 1), bool), types == 0], axis=1)[:, None, None]
    for i in range(plan.layers):
        q, k, v = (a.reshape(rows, n, h, d // h).transpose(0, 2, 1, 3) for a in np.split(linear(f"{i}.qkv", norm(f"{i}.one", t)), 3, axis=2))
        s = np.where(hidden, -np.inf, q @ k.transpose(0, 1, 3, 2) / math.sqrt(d // h))
        e = np.exp(s - s.max(axis=3, keepdims=True))
        a = (e / e.sum(axis=3, keepdims=True)) @ v
        t = t + linear(f"{i}.out", a.transpose(0, 2, 1, 3).reshape(rows, n, d))
        t = t + linear(f"{i}.down", gelu(linear(f"{i}.up", norm(f"{i}.two", t))))
    g = norm("last", t[:, 0])
    out = {"type": linear("head.type", g)}
    g = g + linear("belief.to", network.softmax(out["type"]) @ w["belief"])
    out["loc"] = linear("head.loc", norm("loc", g))
    p, mx, my, *_ = network.mixture(plan, out["loc"])
    g = g + linear("loc.to", np.stack([(p * mx).sum(axis=1), (p * my).sum(axis=1)], axis=1))
    told = norm("told", g)
    out["outcome"] = linear("head.outcome", told)
    if plan.state:
        out["state"] = linear("head.state", told)
    return out


@dataclass
class Attention:
    plan: Plan
    weights: dict[str, np.ndarray]

    def __post_init__(self):
        want = self.plan.weights
        if wrong := [n for n in {**want, **self.weights} if n not in self.weights or self.weights[n].shape != want.get(n)]:
            raise ValueError(f"weights that do not fit: {', '.join(sorted(wrong))}")

    def save(self, spark: SparkSession, path: str, overwrite: bool = False) -> None:
        """A table of named weights, and the sizes as JSON."""
        artifacts.write_json(spark, f"{path}/shape.json", asdict(self.plan), overwrite)
        rows = [(n, json.dumps(x.shape), x.ravel().tolist()) for n, x in self.weights.items()]
        spark.createDataFrame(rows, "name string, shape string, weights array<double>").write.mode("overwrite" if overwrite else "errorifexists").parquet(f"{path}/weights")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Attention:
        plan = artifacts.read_json(spark, f"{path}/shape.json")
        plan["ids"] = tuple(map(tuple, plan["ids"]))
        return cls(Plan(**plan), {r.name: np.array(r.weights).reshape(json.loads(r.shape)) for r in spark.read.parquet(f"{path}/weights").collect()})

    def predict(self, rows: DataFrame) -> DataFrame:
        """Adds ``p_type``, ``p_outcome``, ``p_<state head>``, the mean place ``loc_x``, ``loc_y`` and the mixture ``loc_parts`` (z-scored).

        ``rows``: ``ids`` (of the context), and ``hist_ids``, ``hist_places`` and ``cont`` as :func:`features.encoded` makes them.  Ids outside their
        dictionary count as 0."""
        from pyspark.sql.pandas.types import to_arrow_schema
        from pyspark.sql.types import StructType

        importable(rows.sparkSession)
        plan = self.plan
        states = list(heads.STATE) if plan.state else []
        new = StructType.fromDDL(", ".join(f"p_{h} array<double>" for h in ["type", "outcome", *states]) + ", loc_x double, loc_y double, loc_parts array<double>")
        rows = rows.drop(*new.names)
        schema = StructType([*rows.schema.fields, *new.fields])
        arrow, sent = to_arrow_schema(schema), rows.sparkSession.sparkContext.broadcast(self.weights)
        sizes = np.array([n for n, _ in plan.ids])
        inside = lambda v, n: np.where((v >= 0) & (v < n), v, 0)
        as_list = lambda v: pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1) * v.shape[1], pa.int32()), pa.array(v.ravel())) if v.ndim == 2 else pa.array(v)

        def run(batches):
            w = sent.value
            for whole in batches:
                for at in range(0, whole.num_rows, CHUNK):
                    b, n = whole.slice(at, CHUNK), plan.history
                    a = network.arrays(b, ["ids", "hist_ids", "hist_places", "cont"])
                    told = a["hist_ids"]
                    out = forward(plan, w, inside(a["ids"], sizes), a["cont"], inside(told[:, :n], plan.n_types), inside(told[:, n:], plan.n_outcomes), a["hist_places"][:, :n], a["hist_places"][:, n:])
                    lists = [network.softmax(out["type"]), network.softmax(out["outcome"])]
                    if plan.state:
                        ends = np.cumsum([c for _, c in heads.STATE.values()])
                        lists += [network.softmax(x) for x in np.split(out["state"], ends[:-1], axis=1)]
                    p, mx, my, lx, ly, r = network.mixture(plan, out["loc"])
                    lists += [(p * mx).sum(axis=1), (p * my).sum(axis=1), np.concatenate([p, mx, my, np.exp(lx), np.exp(ly), r], axis=1)]
                    yield pa.RecordBatch.from_arrays([*b.columns, *map(as_list, lists)], schema=arrow)

        return rows.mapInArrow(run, schema)
