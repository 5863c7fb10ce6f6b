"""Self-attention from stored weights against plain loops; padding; storage."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from plait.operators import attention, features, heads
from plait.plans import learning

PLAN = attention.Plan(((5, 3), (4, 2)), 3, 6, 4, 3, width=8, n_heads=2, layers=2, components=2)


def data(n, seed):
    r = np.random.default_rng(seed)
    types = r.integers(1, 6, (n, 3))
    for i in range(n):
        types[i, : r.integers(0, 4)] = 0
    return {"ids": np.stack([r.integers(0, 5, n), r.integers(0, 4, n)], axis=1), "cont": r.normal(size=(n, 3)), "types": types, "outcomes": r.integers(0, 4, (n, 3)), "x": r.normal(size=(n, 3)), "y": r.normal(size=(n, 3))}


def weights(seed):
    r = np.random.default_rng(seed)
    return {n: x + r.normal(0, 0.1, x.shape) for n, x in attention.start(PLAN, seed).items()}


def plain(w, d, i):
    """One row, token by token, number by number."""
    lin = lambda n, v: [sum(v[a] * w[f"{n}.w"][a, b] for a in range(len(v))) + w[f"{n}.b"][b] for b in range(len(w[f"{n}.b"]))]
    add = lambda *vs: [sum(x) for x in zip(*vs)]

    def norm(n, v):
        m = sum(v) / len(v)
        s = math.sqrt(sum((x - m) ** 2 for x in v) / len(v) + 1e-5)
        return [(x - m) / s * g + b for x, g, b in zip(v, w[f"{n}.g"], w[f"{n}.b"])]

    def soft(v):
        e = [math.exp(x - max(v)) for x in v]
        return [x / sum(e) for x in e]

    tokens = [lin("context", [*w["id0"][d["ids"][i, 0]], *w["id1"][d["ids"][i, 1]], *d["cont"][i]])]
    tokens += [add(w["type"][d["types"][i, j]], w["outcome"][d["outcomes"][i, j]], lin("place", [d["x"][i, j], d["y"][i, j]])) for j in range(3)]
    tokens = [norm("tokens", add(t, p)) for t, p in zip(tokens, w["position"])]
    seen = [0, *[j + 1 for j in range(3) if d["types"][i, j] != 0]]
    for layer in range(2):
        qkv = [lin(f"{layer}.qkv", norm(f"{layer}.one", t)) for t in tokens]
        new = []
        for q in qkv:
            mixed = []
            for h in (0, 4):
                a = soft([sum(q[h + c] * qkv[j][8 + h + c] for c in range(4)) / 2 for j in seen])
                mixed += [sum(p * qkv[j][16 + h + c] for p, j in zip(a, seen)) for c in range(4)]
            new.append(mixed)
        tokens = [add(t, lin(f"{layer}.out", m)) for t, m in zip(tokens, new)]
        gelu = lambda v: [0.5 * x * (1 + math.erf(x / math.sqrt(2))) for x in v]
        tokens = [add(t, lin(f"{layer}.down", gelu(lin(f"{layer}.up", norm(f"{layer}.two", t))))) for t in tokens]
    g = norm("last", tokens[0])
    types = lin("head.type", g)
    p = soft(types)
    g = add(g, lin("belief.to", [sum(p[t] * w["belief"][t, c] for t in range(6)) for c in range(8)]))
    loc = lin("head.loc", norm("loc", g))
    pi = soft(loc[:2])
    g = add(g, lin("loc.to", [sum(a * b for a, b in zip(pi, loc[k : k + 2])) for k in (2, 4)]))
    return types, loc, lin("head.outcome", norm("told", g)), lin("head.state", norm("told", g))


def test_forward_is_the_plain_loop():
    w, d = weights(1), data(12, 2)
    out = attention.forward(PLAN, w, **d)
    for i in range(12):
        for got, want in zip((out["type"], out["loc"], out["outcome"], out["state"]), plain(w, d, i)):
            assert got[i] == pytest.approx(want, abs=1e-5)


def test_padded_positions_change_nothing():
    w, d = weights(3), data(40, 4)
    before = attention.forward(PLAN, w, **d)
    pad = d["types"] == 0
    for k in ("outcomes", "x", "y"):
        d[k] = np.where(pad, (d[k] + 1) % 4 if k == "outcomes" else 99.0, d[k])
    after = attention.forward(PLAN, w, **d)
    assert pad.any(axis=1).sum() > 10 and all(np.allclose(before[k], after[k]) for k in before)
    d["x"] = np.where(pad, d["x"], d["x"] + 1)
    assert not np.allclose(before["type"], attention.forward(PLAN, w, **d)["type"])


def test_stored_weights_predict_the_same(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(attention, "CHUNK", 7)
    w, d = weights(5), data(30, 6)
    attention.Attention(PLAN, w).save(spark, f"{tmp_path}/m")
    model = attention.Attention.load(spark, f"{tmp_path}/m")
    rows = [(i, [int(d["ids"][i, 0]), 77], [*map(int, d["types"][i]), *map(int, d["outcomes"][i])], [*d["x"][i].tolist(), *d["y"][i].tolist()], d["cont"][i].tolist(), "clash") for i in range(30)]
    df = spark.createDataFrame(rows, "id int, ids array<int>, hist_ids array<int>, hist_places array<double>, cont array<double>, p_type string")
    got = model.predict(df).orderBy("id").collect()
    d["ids"][:, 1] = 0
    e = np.exp(attention.forward(PLAN, w, **d)["type"])
    assert np.allclose([r.p_type for r in got], e / e.sum(axis=1, keepdims=True)) and all(sum(r.p_pa_end) == pytest.approx(1) for r in got)
    assert model.predict(df.limit(0)).collect() == []
    with pytest.raises(ValueError, match="do not fit: head.type.b"):
        attention.Attention(PLAN, {**w, "head.type.b": np.zeros(1)})
    with pytest.raises(ValueError, match="divide"):
        attention.Plan((), 1, 2, 2, 1, width=6, n_heads=4)


def test_it_takes_the_features_of_requests(spark):
    e = features.Encoding({"AF": 1, "RO": 2}, {"ball": 1}, dict.fromkeys([*features.CONTEXT, "x", "y"], (0.0, 1.0)), 4)
    rows = features.encoded(features.context(learning.requests(spark, "/root/testdata/sf0.001")), e).withColumn("ids", F.array((F.col("pitcher") % 5).cast("int")))
    plan = attention.Plan(((5, 3),), len(features.CONTEXT), *e.sizes, e.history, width=8, n_heads=2, layers=1)
    got = attention.Attention(plan, attention.start(plan, 1)).predict(rows).select("p_type", *[f"p_{h}" for h in heads.STATE]).collect()
    assert len(got) > 500 and all(len(r.p_type) == 3 and len(r.p_score_delta) == 9 for r in got)
