"""Mixtures, features, the network of several heads, clusters, predictions from requests: against plain numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from plait.operators import features, mixtures, network
from plait.plans import learning
from plait.sources import artifacts

SF = "/root/testdata/sf0.001"


def plain_em(xy, k, rounds):
    """(log likelihoods, parameters) of as many iterations."""
    g, d = xy.mean(axis=0), np.maximum(xy.std(axis=0), 1e-3)
    spread = np.array([2 * (i + 0.5) / k - 1 for i in range(k)])
    mean = g + np.stack([spread, [0.5 * (-1) ** i if k > 1 else 0.0 for i in range(k)]], axis=1) * d
    w, cov = np.full(k, 1 / k), np.stack([np.diag(d**2)] * k)
    lls = []
    for _ in range(rounds):
        inv, det = np.linalg.inv(cov), np.linalg.det(cov)
        diff = xy[:, None] - mean
        logs = np.log(w) - 0.5 * np.einsum("nki,kij,nkj->nk", diff, inv, diff) - 0.5 * np.log(det) - np.log(2 * np.pi)
        total = np.log(np.exp(logs).sum(axis=1))
        lls.append(total.sum())
        r = np.exp(logs - total[:, None])
        n = r.sum(axis=0)
        w, mean = n / len(xy), (r.T @ xy) / n[:, None]
        diff = xy[:, None] - mean
        cov = np.einsum("nk,nki,nkj->kij", r, diff, diff) / n[:, None, None]
    return lls, w, mean, cov


def test_mixtures_are_those_of_plain_em(spark):
    rnd = np.random.default_rng(3)
    data = {g: np.concatenate([rnd.multivariate_normal([g, 0], [[1, 0.6], [0.6, 1]], 400), rnd.multivariate_normal([g + 4, 3], [[0.5, -0.2], [-0.2, 0.7]], 200)]) for g in (0, 1, None) for g in [g or 0]}
    rows = [(g, float(x), float(y)) for g, xy in data.items() for x, y in xy] + [(0, None, 1.0), (1, 2.0, None)]
    df = spark.createDataFrame(rows, "g int, x double, y double").withColumn("w", F.lit("clash"))
    for rounds in (1, 4, 15):
        for r in mixtures.fit(df, ["g"], 2, rounds, -1.0).collect():
            lls, w, mean, cov = plain_em(data[r.g], 2, rounds)
            assert r.ll == pytest.approx(lls[-1]) and r.w == pytest.approx(w) and r.mx == pytest.approx(mean[:, 0]) and r.my == pytest.approx(mean[:, 1])
            assert np.array(r.sx) ** 2 == pytest.approx(cov[:, 0, 0]) and np.array(r.rho) * r.sx * r.sy == pytest.approx(cov[:, 0, 1])


def test_likelihood_never_falls_and_odd_groups_stay_finite(spark):
    rnd = np.random.default_rng(5)
    rows = [(1, float(x), float(y)) for x, y in rnd.normal(size=(300, 2))] + [(None, 1.0, 2.0)] * 5 + [(2, 3.0, 4.0)] + [(3, 0.0, 0.0), (3, 5.0, 5.0)]
    df = spark.createDataFrame(rows, "g int, x double, y double")
    lls = [{r.g: r.ll for r in mixtures.fit(df, ["g"], 3, n, -1.0).collect()} for n in (1, 2, 4, 8, 16)]
    assert all(b[1] >= a[1] - 1e-9 for a, b in zip(lls, lls[1:]))
    got = {r.g: r for r in mixtures.fit(df, ["g"], 3).collect()}
    assert set(got) == {1, 2, 3, None} and all(np.isfinite([*r.w, *r.mx, *r.my, *r.sx, *r.sy, *r.rho]).all() for r in got.values())
    assert got[None].mx == pytest.approx([1.0] * 3) and min(got[None].sx) >= 1e-3
    assert mixtures.fit(df.limit(0), ["g"], 2).collect() == []


SHAPE = network.Shape(4, 3, 2, 2, embedding=3, hidden=5, components=2, loc=0.7, state=0.5, outcome=0.3)


def random_data(n, seed):
    r = np.random.default_rng(seed)
    ids = np.concatenate([r.integers(0, 4, (n, 2)), r.integers(0, 3, (n, 2))], axis=1)
    labels = np.stack([r.integers(0, c, n) for c in SHAPE.classes], axis=1)
    return {"hist_ids": ids, "hist_places": r.normal(size=(n, 4)), "cont": r.normal(size=(n, 2)), "labels": labels, "mask": r.integers(0, 2, n), "place": r.normal(size=(n, 2))}


def test_gradients_are_the_slopes_of_the_loss():
    data, v = random_data(40, 1), network.flat(network.start(SHAPE, 3))
    v = v + np.random.default_rng(7).normal(0, 0.05, len(v))  # off the bend of the rectified units
    n, m = 40, int(data["mask"].sum())

    def loss(v):
        s = network.losses(SHAPE, network.unflat(SHAPE, v), data, n, m)[1]
        return network.combined(SHAPE, s)["loss"]

    g = network.losses(SHAPE, network.unflat(SHAPE, v), data, n, m)[0]
    for i in np.random.default_rng(2).choice(len(v), 120, replace=False):
        up, down = v.copy(), v.copy()
        up[i] += 1e-6
        down[i] -= 1e-6
        assert (loss(up) - loss(down)) / 2e-6 == pytest.approx(g[i], abs=2e-7)


def as_frame(spark, data):
    rows = [(i, *[x[i].tolist() for x in data.values()]) for i in range(len(data["mask"]))]
    return spark.createDataFrame(rows, "id int, hist_ids array<int>, hist_places array<double>, cont array<double>, labels array<int>, mask int, place array<double>")


def test_distributed_training_is_plain_training(spark, tmp_path):
    data, held = random_data(300, 4), random_data(80, 5)
    rows, valid = as_frame(spark, data), as_frame(spark, held)
    got, history = network.train(rows.repartition(5), valid, SHAPE, ["id"], f"{tmp_path}/runs/r1", epochs=4, batches=3, rate=0.02, clip=0.5, seed=9)
    dealt = dict(rows.select("id", F.pmod(F.xxhash64(F.lit(9), "id"), F.lit(3)).alias("b")).collect())
    v = network.flat(network.start(SHAPE, 9))
    m = s = np.zeros_like(v)
    t, best = 0, None
    for epoch in range(1, 5):
        losses = []
        for b in np.random.default_rng([9, epoch]).permutation(3).tolist():
            at = np.array([i for i in range(300) if dealt[i] == b])
            part = {k: x[at] for k, x in data.items()}
            g, sums = network.losses(SHAPE, network.unflat(SHAPE, v), part, len(at), int(part["mask"].sum()))
            losses.append(sums)
            g = g * min(1, 0.5 / (np.linalg.norm(g) + 1e-6))
            t += 1
            m, s = 0.9 * m + 0.1 * g, 0.999 * s + 0.001 * g**2
            v = v * (1 - 0.02 * 0.01) - 0.02 * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.999**t)) + 1e-8)
        after = network.combined(SHAPE, network.losses(SHAPE, network.unflat(SHAPE, v), held, 1, 1)[1])
        assert history[epoch - 1]["train_loss"] == pytest.approx(network.combined(SHAPE, np.sum(losses, axis=0))["loss"], rel=1e-9)
        assert history[epoch - 1]["valid_loss"] == pytest.approx(after["loss"], rel=1e-9)
        if best is None or after["loss"] < best[0]:
            best = after["loss"], v
    assert np.allclose(got.weights, best[1], rtol=0, atol=1e-9)
    kept = network.Network.load(spark, artifacts.resolve_run(spark, f"{tmp_path}/runs") + "/checkpoints/best")
    assert kept.shape == SHAPE and np.array_equal(kept.weights, got.weights)
    log = artifacts.read_log(spark, f"{tmp_path}/runs/r1/metrics").collect()
    assert [r.epoch for r in log] == [1, 2, 3, 4] and min(r.loss for r in log) == pytest.approx(best[0])
    artifacts.write_json(spark, f"{tmp_path}/prepared/meta.json", {})
    spark.range(1).write.parquet(f"{tmp_path}/prepared/vocabs")
    artifacts.export_run(spark, f"{tmp_path}/runs/r1", f"{tmp_path}/prepared", f"{tmp_path}/bundle")
    assert np.array_equal(network.Network.load(spark, f"{tmp_path}/bundle/model").weights, got.weights)
    p = got.predict(valid).orderBy("id").collect()
    out = network.forward(SHAPE, network.unflat(SHAPE, got.weights), held["hist_ids"], held["hist_places"], held["cont"])[3]
    assert np.allclose([r.p_type for r in p], network.softmax(out[:, :4])) and np.allclose([sum(r.loc_parts[:2]) for r in p], 1)


def test_training_lowers_the_loss_and_nothing_is_an_error(spark):
    rows = as_frame(spark, random_data(200, 6))
    _, history = network.train(rows, rows, SHAPE, ["id"], epochs=6, batches=2, rate=0.05)
    assert history[-1]["valid_loss"] < history[0]["valid_loss"]
    with pytest.raises(ValueError, match="no training rows"):
        network.train(rows.limit(0), rows, SHAPE, ["id"])


def test_requests_are_predicted_like_the_batch(spark):
    e, (train, valid) = learning.learning_rows(spark, SF)
    model, _ = network.train(train, valid, learning.shape_of(e), ["game", "pa", "seq"], epochs=1, batches=1)
    batch = {(r.game, r.pa, r.seq): r for r in model.predict(valid).collect()}
    asked = features.encoded(features.context(learning.requests(spark, SF)), e)
    got = model.predict(asked).collect()
    assert len(got) == len(batch) > 500
    for r in got:
        assert r.p_type == batch[r.game, r.pa, r.seq].p_type and r.loc_x == batch[r.game, r.pa, r.seq].loc_x and r.prev_type == batch[r.game, r.pa, r.seq].prev_type


def test_requests_are_encoded_padded_and_cut(spark):
    flat = dict.fromkeys(features.CONTEXT, (0.0, 1.0))
    e = features.Encoding({"A": 1, "B": 2}, {"ball": 1}, {**flat, "x": (1.0, 2.0), "y": (0.0, 1.0), "inning": (5.0, 2.0)}, 2)
    h = "array<struct<token string, outcome string, x double, y double>>".replace("token ", "token:").replace("outcome ", "outcome:").replace("x d", "x:d").replace("y d", "y:d")
    rows = spark.createDataFrame([(1, [("A", "ball", 3.0, 4.0)]), (2, [("B", "?", 1.0, 1.0), ("A", None, 5.0, None), (None, "ball", 7.0, 2.0)]), (3, None), (4, [])], f"id int, history {h}")
    rows = rows.withColumns({c: F.lit(9 if c == "inning" else None).cast("double") for c in features.CONTEXT}).withColumn("hist_ids", F.lit("clash"))
    got = {r.id: r for r in features.encoded(rows, e).collect()}
    assert got[1].hist_ids == [0, 1, 0, 1] and got[1].hist_places == [-0.5, 1.0, 0.0, 4.0] and got[1].prev_type == 1
    assert got[2].hist_ids == [1, 0, 0, 1] and got[2].hist_places == [2.0, 3.0, 0.0, 2.0] and (got[2].prev_type, got[2].prev_outcome) == (1, 1)
    assert got[3].hist_ids == got[4].hist_ids == [0, 0, 0, 0] and got[3].cont[0] == 2.0 and got[3].cont[1] == 0.0
