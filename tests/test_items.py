"""Feed, reports, clusters, optional columns, truncation, calibration edges, keys, retries."""

import math
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from plait.functions import columns as X
from plait.operators import baselines, clusters, encoding, learned, metrics, prepare, reports
from plait.sources import artifacts, chunks, feed
from plait.sources.tables import optional, pitch_log, vector_scores

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def files(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("feed") / "rows")
    for part, (lo, hi) in enumerate(((0, 1000), (1000, 1003), (1003, 1800))):
        spark.range(lo, hi, 1, 1).withColumn("v", F.col("id") * 2).coalesce(1).write.mode("append" if part else "overwrite").parquet(path)
    return path


def order(spark, path, **options):
    return [(r.position, r.batch, r.id) for r in feed.placed(spark, path, ["id"], 64, **options).orderBy("position").collect()]


def test_every_row_once_an_epoch_in_seeded_order(spark, files):
    one = order(spark, files, seed=1, block=100)
    assert [p for p, _, _ in one] == list(range(1800)) and sorted(i for _, _, i in one) == list(range(1800))
    assert [b for _, b, _ in one] == [p // 64 for p in range(1800)]
    assert one == order(spark, files, seed=1, block=100) != order(spark, files, seed=2, block=100)
    assert one != order(spark, files, seed=1, epoch=1, block=100)
    plain = [i for _, _, i in order(spark, files)]
    assert sorted(plain) == list(range(1800)) and sum(b == a + 1 for a, b in zip(plain, plain[1:])) >= 1797
    kept = [i for _, _, i in order(spark, files, seed=1, block=100, within=False)]
    assert sum(b == a + 1 for a, b in zip(kept, kept[1:])) > 1700 and kept != plain
    first = [i for _, _, i in one]
    runs = [i // 100 if i < 1000 else -1 if i < 1003 else 1000 + (i - 1003) // 100 for i in first]
    assert sum(a != b for a, b in zip(runs, runs[1:])) == len(set(runs)) - 1


def test_batches_have_one_size(spark, files):
    rows = feed.placed(spark, files, ["id", "v"], 64, seed=3, block=128)
    got = feed.map_batches(rows, lambda t: pa.table({"n": [t.num_rows], "ordered": [t.column("position").to_pylist() == sorted(t.column("position").to_pylist())]}), "n long, ordered boolean").collect()
    assert sorted(r.n for r in got) == [1800 % 64, *[64] * (1800 // 64)] and all(r.ordered for r in got)
    tables = list(feed.iterate(rows, 64))
    assert [t.num_rows for t in tables] == [*[64] * 28, 8] and tables[0].column_names == ["id", "v"]
    assert [x for t in tables for x in t.column("id").to_pylist()] == [i for _, _, i in order(spark, files, seed=3, block=128)]
    with pytest.raises(ValueError):
        feed.placed(spark, files, ["id"], 0)


def test_report_holds_what_its_parts_compute(spark, tmp_path):
    prepare.prepare(pitch_log(spark, SF), f"{tmp_path}/p", history=4)
    got = reports.report(spark, f"{tmp_path}/p", f"{tmp_path}/r")
    assert artifacts.read_json(spark, f"{tmp_path}/r/report.json") == got and set(got) == {"metrics", "calibration", "slices", "baselines"}
    p = prepare.load(spark, f"{tmp_path}/p")
    train, valid = (reports.rows_of(x, 4) for x in (p.train, p.valid))
    want = baselines.evaluate(train, valid, baselines.GRAINS["count"], p.meta["vocab_sizes"]["token"]).first()
    m, b = got["metrics"][0], {r["grain"]: r for r in got["baselines"]}
    assert m["n"] == p.meta["rows"]["valid"] and m["acc"] == pytest.approx(want.acc, abs=1e-6) and m["ce"] == pytest.approx(want.ce, abs=1e-6) and m["loc_rmse"] == pytest.approx(want.loc_rmse, abs=1e-6)
    assert b["count"]["acc"] == want.acc and set(b) == set(baselines.GRAINS) and sum(r["n"] for r in got["calibration"]) == m["n"]
    assert all(sum(r["n"] for r in got["slices"] if r["slice"] == s) == m["n"] for s in reports.SLICES)
    with pytest.raises(Exception, match="exist"):
        reports.report(spark, f"{tmp_path}/p", f"{tmp_path}/r")


def test_unseen_groups_take_the_global_prediction(spark):
    train = spark.createDataFrame([(1, 0, 0.0, 0.0), (1, 0, 2.0, 0.0), (2, 1, 4.0, 6.0)], "k int, y int, x double, y_loc double")
    got = {r.k: r for r in baselines.predicted(train, spark.createDataFrame([(1, 0, 1.0, 1.0), (9, 1, 1.0, 1.0), (None, 1, 1.0, 1.0)], train.schema), ["k"], 2).collect()}
    assert (got[1].c, got[1].m_x, got[1].fallback) == ([2, 0], 1.0, 0)
    assert (got[9].c, got[9].m_x, got[9].m_y, got[9].fallback) == ([2, 1], 2.0, 2.0, 1) and got[None].fallback == 1


def test_clusters_are_those_of_plain_rounds(spark):
    v = vector_scores(spark, SF).select("vec_id", "v")
    rows = {r.vec_id: np.array(r.v) for r in v.collect()}
    x, c = np.stack([rows[k] for k in sorted(rows)]), np.stack([rows[k] for k in sorted(rows)[:5]])
    for _ in range(3):
        at = ((x[:, None] - c) ** 2).sum(axis=2).argmin(axis=1)
        c = np.stack([x[at == k].mean(axis=0) if (at == k).any() else c[k] for k in range(5)])
    centres = clusters.fit(v, clusters.first_rows(v, "vec_id", 5), 3)
    assert np.allclose([r.v for r in centres.orderBy("cluster").collect()], c)
    want = dict(zip(sorted(rows), (((x[:, None] - c) ** 2).sum(axis=2).argmin(axis=1) + 1).tolist()))
    none = spark.createDataFrame([(-1, None)], v.schema)
    assert {r.vec_id: r.cluster for r in clusters.assign(v.unionByName(none), centres).collect()} == {**want, -1: 0}
    with pytest.raises(ValueError):
        clusters.fit(v, clusters.first_rows(v.limit(0), "vec_id", 5))


def test_learned_clusters_are_the_nearest_centres(spark):
    v = vector_scores(spark, SF)
    got = {r.vec_id: r.cluster for r in learned.clusters(v, "v", 8).collect()}
    rows = {r.vec_id: np.array(r.v) for r in v.collect()}
    means = {c: np.mean([rows[i] for i in rows if got[i] == c], axis=0) for c in set(got.values())}
    near = {i: min(means, key=lambda c: ((rows[i] - means[c]) ** 2).sum()) for i in rows}
    assert set(got.values()) <= set(range(1, 9)) and sum(near[i] == got[i] for i in rows) >= 0.97 * len(rows)


def test_learned_perceptron_finds_a_rule(spark):
    rows = spark.createDataFrame([(i, 1, 1, float(i % 3), float(i % 2), "abc"[i % 3]) for i in range(300)], "game int, pa int, seq int, f double, g double, token string")
    got = learned.mlp(rows, rows, ["f", "g"], "token", iterations=60).join(rows, ["game", "pa", "seq"])
    assert got.where("predicted = token").count() >= 290


def test_small_items(spark):
    big = spark.createDataFrame([(1 << 40, 3, 2, 1), ((1 << 55) + 1, 1, 0, 2)], "a long, b int, c int, d int")
    key = X.packed_key([("a", 0), ("b", 4), ("c", 3), ("d", 3)])
    parts = X.unpacked_key(key, [4, 3, 3])
    assert [tuple(r) for r in big.select(*parts).collect()] == [(1 << 40, 3, 2, 1), ((1 << 55) + 1, 1, 0, 2)]
    x = spark.createDataFrame([(v,) for v in (1.9, -1.9, None, math.nan, 1e300, -1e300, 0.0)], "x double")
    assert [r[0] for r in x.select(X.truncated("x")).collect()] == [1, -1, 0, 0, 2**63 - 1, -(2**63), 0]
    o = optional(spark.createDataFrame([(1, "2")], "a int, `b.c` string"), {"b.c": "int", "z": "double", "a": "string"})
    assert o.columns == ["b.c", "z", "a"] and tuple(o.first()) == (2, None, "1")
    conf = [i / 15 for i in range(16)] + [0.29999999999999993, -0.1, 1.1]
    got = metrics.calibration_edges(spark.createDataFrame([(c, 1.0) for c in conf], "conf double, hit1 double")).orderBy("bin").collect()
    want = [sum(1 for c in conf if i / 15 <= c and (c < (i + 1) / 15 or i == 14 and c <= 1)) for i in range(15)]
    assert [r.n for r in got] == want and sum(want) == 17


def test_nothing_stays_cached(spark):
    before = len(spark.sparkContext._jsc.getPersistentRDDs())
    log = pitch_log(spark, SF)
    v = encoding.vocabulary(encoding.token_counts(log, ["token"]))
    assert encoding.encode(log, v, ["token"]).where("token_id = 0").isEmpty() and encoding.decode(log.withColumn("i", F.lit(1)), v, "token", "i", "t").count() == log.count()
    assert len(spark.sparkContext._jsc.getPersistentRDDs()) == before


def test_a_retry_can_succeed(spark, tmp_path, monkeypatch):
    path, waits = f"{tmp_path}/late.parquet", []
    sleep = lambda s: (waits.append(s), len(waits) == 2 and spark.range(3).write.parquet(path))
    monkeypatch.setattr(chunks, "time", SimpleNamespace(sleep=sleep))
    schema = spark.range(1).schema
    assert chunks.scan_chunks(spark, [path], schema, attempts=4, wait=0.5).count() == 3 and waits == [0.5, 1.0]
    with pytest.raises(ValueError, match="no readable"):
        chunks.scan_chunks(spark, [f"{tmp_path}/never"], schema, attempts=2, wait=0.1)
