"""The baseline network: identities, history, two layers with dropout and the place's Gaussian."""

import numpy as np

from plait.operators import learned, network, perceptron

SHAPE = perceptron.Shape(["f"], ["who"], ["a", "b", "c"], {"side": ["L", "R"]}, {"f": [0.0, 1.0], "x": [0.0, 1.0], "y": [0.0, 1.0]}, ["x", "y"], 2, 5, 3, 7, 0.3)


def some(n, r):
    ids = r.integers(0, 7, (n, 2))
    ids[0] = -1
    return {"x": r.normal(size=(n, 1)), "ids": ids, "cats": r.integers(0, 3, (n, 1)), "hist": r.integers(0, 4, (n, 2)), "hist_xy": r.normal(size=(n, 4)), "y": r.integers(0, 3, n), "xy": r.normal(size=(n, 2))}


def test_gradient_is_that_of_the_loss():
    r = np.random.default_rng(1)
    data, v = some(20, r), perceptron.start(SHAPE, 3)
    v = v + 0.05 * r.normal(size=len(v))  # no unit lies on its edge
    data["xy"][4, 1] = np.nan
    drop = lambda: np.random.default_rng(9)
    loss = lambda v: perceptron.losses(SHAPE, network.unflat(SHAPE, v), data, 20, drop())[-2:].sum() / 20
    g = perceptron.losses(SHAPE, network.unflat(SHAPE, v), data, 20, drop())[:-3]
    for i in range(len(v)):
        step = np.zeros(len(v))
        step[i] = 1e-5
        assert abs((loss(v + step) - loss(v - step)) / 2e-5 - g[i]) < 1e-5, i
    o = perceptron.forward(SHAPE, network.unflat(SHAPE, v), data)
    assert (o["in"][0, :3] == 0).all() and (o["h1"] >= 0).all() and (o["k1"] == 1.0)
    kept = perceptron.forward(SHAPE, network.unflat(SHAPE, v), data, drop())["k1"]
    assert 0.1 < (kept == 0).mean() < 0.5 and set(np.unique(kept)) == {0, 1 / 0.7}


def test_identities_history_and_places_are_learned(spark, tmp_path):
    r, rows = np.random.default_rng(2), []
    names = [f"n{i}" for i in range(6)]
    for i in range(900):
        who, last = names[i % 6], "ab"[int(r.integers(2))]
        own = int(who[1:]) % 2
        token = "ab"[own if i % 3 else (own + (last == "b")) % 2] if i % 2 else "ab"[own]
        rows.append((i, 1, 1, 0.0, who, "L", [(last, "ball", 0.0, 0.0)], token, 3.0 * own + 0.1 * r.normal(), 1.0))
    d = spark.createDataFrame(rows, "game int, pa int, seq int, f double, who string, side string, history array<struct<token:string,outcome:string,x:double,y:double>>, token string, x double, y double")
    how = {"identities": ["who"], "categories": ["side"], "history": "history", "length": 2, "place": ["x", "y"]}
    model = learned.mlp_model(d, ["f"], "token", iterations=60, **how)
    got = model.transform(d).collect()
    assert sum(x.predicted == x.token for x in got) >= 0.8 * len(got)  # the feature alone tells nothing: half
    assert np.mean([abs(x.loc_x - 3.0 * (int(x.who[1:]) % 2)) for x in got]) < 0.8 and all(x.loc_sx > 0 for x in got)
    assert model.curve[-1] < 0.7 * model.curve[0]
    strangers = d.selectExpr("game", "pa", "seq", "f", "'other' as who", "side", "history", "token", "x", "y").limit(20)
    none = strangers.selectExpr("game", "pa", "seq", "f", "cast(null as string) as who", "side", "history", "token", "x", "y")
    assert [x.loc_x for x in model.transform(strangers).orderBy("game").collect()] == [x.loc_x for x in model.transform(none).orderBy("game").collect()]
    model.save(spark, f"{tmp_path}/m")
    again = perceptron.Perceptron.load(spark, f"{tmp_path}/m").transform(d)
    assert sorted((x.game, x.predicted, x.loc_x) for x in again.collect()) == sorted((x.game, x.predicted, x.loc_x) for x in got)
    nulls = spark.createDataFrame([(1, 1, 1, None, None, None, None, None, None, None)], d.schema)
    assert model.transform(nulls).count() == 1 and learned.mlp(d.unionByName(nulls), nulls, ["f"], "token", iterations=2, **how).count() == 1


def test_parts_add_up_and_batches_hold_every_row_once(spark, monkeypatch):
    r = np.random.default_rng(4)
    d = spark.createDataFrame([(float(r.normal()), "abc"[i % 3], f"w{i % 50}", float(i % 5), 1.0) for i in range(3000)], "f double, token string, who string, x double, y double").repartition(7)
    shape, seen, whole = perceptron.fitted(d, ["f"], "token", ["who"], place=["x", "y"], slots=64), [], perceptron.totals

    def noted(rows, *a):
        seen.append(rows.count())
        return whole(rows, *a)

    monkeypatch.setattr(perceptron, "totals", noted)
    model = perceptron.train(d, shape, "token", rounds=6, least=1000)
    assert len(seen) == 6 and sum(seen[:3]) == sum(seen[3:]) == 3000 and min(seen) > 800
    again = perceptron.train(d.repartition(3), shape, "token", rounds=1, least=10_000)
    inputs = perceptron.encoded(d, shape, None).selectExpr("_x as x", "_ids as ids", "_cats as cats", "_hist as hist", "_hist_xy as hist_xy", "ascii(token) - 97 as y", "array(x, y) as xy")
    parts = [whole(inputs.repartition(n), shape, again.weights, 3000) for n in (1, 40)]
    assert np.allclose(*parts) and parts[0][-3] == 3000 and len(model.weights) == len(parts[0]) - 3
