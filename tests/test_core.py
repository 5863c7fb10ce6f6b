import itertools

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from plait.functions import columns as X
from plait.functions import rules
from plait.functions import vectors as V
from plait.operators import baselines, encoding, learned, metrics, prepare, sequences, simulation, splitting
from plait.sources import artifacts, chunks
from plait.sources.tables import pitch_log, pitch_rows

SCHEMA = StructType([StructField("id", LongType()), StructField("name", StringType())])


def test_date_chunks_are_clipped(spark):
    rows = [tuple(map(str, r)) for r in chunks.date_chunks(spark, "2024-01-01", "2024-01-10", 7).orderBy("chunk_start").collect()]
    assert rows == [("2024-01-01", "2024-01-07"), ("2024-01-08", "2024-01-10")]
    with pytest.raises(ValueError):
        chunks.date_chunks(spark, "2024-01-02", "2024-01-01", 7)


def test_scan_chunks_quarantines(spark, tmp_path):
    spark.createDataFrame([(1, "a")], SCHEMA).write.parquet(f"{tmp_path}/good")
    chunks.write_empty(spark, SCHEMA, f"{tmp_path}/empty")
    spark.range(3).write.parquet(f"{tmp_path}/incomplete")
    (tmp_path / "broken.parquet").write_text("no parquet")
    paths = [f"{tmp_path}/{x}" for x in ("good", "empty", "incomplete", "broken.parquet")]
    out = chunks.scan_chunks(spark, paths, SCHEMA, f"{tmp_path}/skipped.json")
    assert [tuple(r) for r in out.collect()] == [(1, "a")]
    report = {x["path"].rsplit("/")[-1]: x["reason"] for x in artifacts.read_json(spark, f"{tmp_path}/skipped.json")}
    assert report["incomplete"] == "missing columns: name" and "unreadable" in report["broken.parquet"] and len(report) == 2
    assert [x.name for x in chunks.missing_chunks(spark, chunks.date_chunks(spark, "2024-01-01", "2024-01-10", 7), str(tmp_path)).collect()] == ["events_2024-01-01_2024-01-07.parquet", "events_2024-01-08_2024-01-10.parquet"]
    write = lambda x: spark.range(1).write.parquet(f"{tmp_path}/{x}")
    write("events_2024-01-01_2024-01-07.parquet")
    assert chunks.missing_chunks(spark, chunks.date_chunks(spark, "2024-01-01", "2024-01-10", 7), str(tmp_path)).count() == 1
    with pytest.raises(ValueError):
        chunks.scan_chunks(spark, paths[2:], SCHEMA)


def test_write_split_guards_and_prunes(spark, tmp_path):
    rows = spark.createDataFrame([(1, "train"), (2, "valid")], "id int, split string")
    chunks.write_split(rows, f"{tmp_path}/out")
    with pytest.raises(Exception, match="already exists|PATH_ALREADY_EXISTS"):
        chunks.write_split(rows, f"{tmp_path}/out")
    chunks.write_split(rows, f"{tmp_path}/out", overwrite=True)
    assert spark.read.parquet(f"{tmp_path}/out").where("split = 'valid'").count() == 1


def test_lenient_date(spark):
    rows = spark.createDataFrame([("2024-02-30",), ("2024-02-29",), ("x",), (None,)], "d string")
    assert [str(r[0]) for r in rows.select(X.lenient_date("d")).collect()] == ["None", "2024-02-29", "None", "None"]


def expected(o, b, s):
    if o in rules.BALLS:
        return (0, 0, 1, 1) if b == 3 else (b + 1, s, 0, 1)
    if o in rules.ENDS:
        return (0, 0, 1, 1)
    if o in rules.STRIKES or o == "foul_bunt":
        return (0, 0, 1, 1) if s == 2 else (b, s + 1, 0, 1)
    if o == "foul":
        return (b, min(2, s + 1), 0, 1)
    return (b, s, 0, 0)


def test_count_rules_truth_table(spark):
    outcomes = [*rules.BALLS, *rules.ENDS, *rules.STRIKES, "foul", "foul_bunt", "other", None]
    rows = list(itertools.product(outcomes, range(4), range(3)))
    got = spark.createDataFrame(rows, "o string, b int, s int").select("o", "b", "s", rules.count_rules("o", "b", "s").alias("r")).collect()
    assert all(tuple(r.r) == expected(r.o, r.b, r.s) for r in got) and len(got) == len(rows)


def test_buckets_at_edges(spark):
    r = spark.createDataFrame([(i, s, p) for i, s, p in zip((3, 4, 6, 7, 8, 9), (-9, -3, 0, 2, 3, 9), (0, 1, 2, 3, 4, 9))], "i int, s int, p int")
    got = r.select(X.inning_bucket("i"), X.score_bucket("s"), X.pitch_number_bucket("p")).collect()
    assert [tuple(x) for x in got] == [(0, 0, 0), (1, 0, 0), (1, 3, 1), (2, 5, 2), (2, 6, 3), (3, 6, 3)]


def test_split_boundary_prefers_the_earliest(spark):
    rows = spark.createDataFrame([(d,) for d in ("2024-01-01", "2024-01-02", "2024-01-03", "2024-01-04")], "day string").select(F.to_date("day").alias("day"))
    assert str(splitting.boundary(rows, 0.375).first().valid_from) == "2024-01-03"
    one = rows.where("day = '2024-01-01'")
    assert splitting.boundary(one, 0.1).first().valid_from is None


def test_vocabulary_ties_and_unknowns(spark):
    rows = spark.createDataFrame([("b",), ("a",), ("b",), ("a",), ("c",), (None,)], "t string")
    v = encoding.vocabulary(encoding.token_counts(rows, ["t"]), 2)
    assert {r.token: r.id for r in v.collect()} == {"a": 1, "b": 2}
    got = encoding.encode(rows, v, ["t"]).select("t", "t_id").collect()
    assert {(r.t, r.t_id) for r in got} == {("a", 1), ("b", 2), ("c", 0), (None, 0)}


def test_constant_feature_has_unit_deviation(spark):
    s = splitting.feature_stats(spark.createDataFrame([(2, 1), (2, 3)], "a int, b int"), ["a", "b"]).first()
    assert s.a_std == 1.0 and s.b_std == pytest.approx(2**0.5)


def test_history_and_next_state_agree(spark):
    cols = "game long, pa long, seq int, balls int, strikes int, outs int, inning int, score_diff int, side string, on_1 long, on_2 long, on_3 long"
    rows = spark.createDataFrame([(1, 1, 1, 0, 0, 0, 1, 0, "Top", None, None, None), (1, 1, 2, 1, 0, 0, 1, 0, "Top", 5, None, None), (1, 2, 1, 3, 2, 1, 3, 9, "Bot", None, 6, None)], cols)
    got = sequences.next_state(rows).orderBy("pa", "seq").collect()
    assert [r.y_has_next for r in got] == [1, 1, 0] and [r.y_pa_end for r in got] == [0, 1, 1]
    assert [r.y_score_delta for r in got] == [4, 8, 4] and [r.y_inning_delta for r in got] == [0, 1, 0]
    h = sequences.history(rows, ["balls"], 2).orderBy("pa", "seq").collect()
    assert [(r.hist_balls_0, r.hist_balls_1) for r in h] == [(0, 0), (0, 0), (0, 0)]


def test_unseen_groups_fall_back(spark):
    train = spark.createDataFrame([(1, 1, 0.0, 0.0), (1, 1, 0.0, 0.0), (2, 2, 1.0, 1.0)], "pitcher int, y int, x double, y_loc double")
    valid = spark.createDataFrame([(9, 1, 0.0, 0.0), (2, 2, 1.0, 1.0)], "pitcher int, y int, x double, y_loc double")
    r = baselines.evaluate(train, valid, ["pitcher"], 3).first()
    assert (r.n, r.fallback_n, r.acc, r.top3) == (2, 1, 1.0, 1.0)


def test_calibration_has_every_bin(spark):
    rows = spark.createDataFrame([(1.0, 1.0), (0.0, 0.0), (0.5, 1.0)], "conf double, hit1 double")
    got = {r.bin: (r.n, r.acc) for r in metrics.calibration(rows, 2).collect()}
    assert got == {0: (1, 0.0), 1: (2, 1.0)}
    assert {r.bin for r in metrics.calibration(rows, 15).where("n = 0").collect()} == set(range(15)) - {0, 7, 14}


def test_softmax_and_ranking(spark):
    r = spark.createDataFrame([([1.0, 3.0, 3.0],)], "z array<double>").select(V.softmax("z").alias("p"), V.top_classes("z", 2).alias("t")).first()
    assert sum(r.p) == pytest.approx(1) and r.t == [1, 2]


SF = "/root/testdata/sf0.001"


def test_prepare_round_trip(spark, tmp_path):
    log, out = pitch_log(spark, SF), f"{tmp_path}/prepared"
    meta = prepare.prepare(log, out, history=3, min_count=2)
    got = prepare.load(spark, out)
    assert got.meta == meta and got.train.count() == meta["rows"]["train"] and got.valid.count() == meta["rows"]["valid"]
    assert sum(meta["rows"].values()) == log.count() and 0.02 < meta["rows"]["valid"] / log.count() < 0.2
    train = log.where(F.col("day") < meta["valid_from"])
    counts = train.groupBy("pitcher").count().where("count >= 2").orderBy(F.desc("count"), F.col("pitcher").cast("string")).collect()
    assert [int(r.token) for r in got.vocab.where("field = 'pitcher'").orderBy("id").collect()] == [r.pitcher for r in counts]
    assert [r.id for r in got.vocab.where("field = 'pitcher'").orderBy("id").collect()] == list(range(1, len(counts) + 1))
    mean, std = train.agg(F.avg("inning"), F.stddev_samp("inning")).first()
    assert meta["norms"]["inning"] == {"mean": pytest.approx(mean), "std": pytest.approx(std)}
    assert {f"hist_{f}_{i}" for f in prepare.HISTORY for i in range(3)} <= set(got.train.columns)
    with pytest.raises(FileExistsError):
        prepare.prepare(log, out)
    with pytest.raises(ValueError, match="two days"):
        prepare.prepare(log.limit(0), f"{tmp_path}/none")
    with pytest.raises(ValueError, match="empty vocabulary"):
        prepare.prepare(log, f"{tmp_path}/rare", min_count=10**9)
    with pytest.raises(FileNotFoundError):
        prepare.load(spark, f"{tmp_path}/nowhere")


def test_vocabulary_ids_are_a_global_order(spark):
    rows = [("f", t) for t, n in (("b", 3), ("a", 3), ("abc", 3), ("ab", 3), ("z", 9), ("once", 1)) for _ in range(n)] + [("f", None)]
    counts = encoding.token_counts(spark.createDataFrame(rows, "g string, f string"), ["f"])
    assert [(r.token, r.id) for r in encoding.vocabulary(counts, 2).orderBy("id").collect()] == [("z", 1), ("a", 2), ("ab", 3), ("abc", 4), ("b", 5)]


def test_game_filter_reaches_the_scans(spark):
    plan = pitch_rows(spark, SF, game=7)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(l_orderkey,112)" in plan and "GreaterThanOrEqual(o_orderkey,112)" in plan
    assert "hashpartitioning(game" not in pitch_rows(spark, SF)._jdf.queryExecution().executedPlan().toString()


def test_artifacts(spark, tmp_path):
    trace, schema = f"{tmp_path}/trace", StructType([StructField("game", LongType()), StructField("pa", LongType()), StructField("note", StringType())])
    events = spark.createDataFrame([(g, p, None) for g in (1, 2) for p in range(4)], schema)
    artifacts.write_trace(events, trace, ["game", "pa"])
    assert artifacts.read_trace(spark, trace, schema, game=2).count() == 4
    with pytest.raises(ValueError, match="several games"):
        artifacts.read_trace(spark, trace, schema)
    artifacts.write_trace(events, f"{tmp_path}/short", ["game", "pa"], most=3)
    assert [(r.game, r.pa) for r in artifacts.read_trace(spark, f"{tmp_path}/short", schema).orderBy("pa").collect()] == [(1, 0), (1, 1), (1, 2)]
    spark.createDataFrame([("no json",)], "value string").write.text(f"{tmp_path}/bad")
    with pytest.raises(ValueError, match="no json"):
        artifacts.read_trace(spark, f"{tmp_path}/bad", schema)
    report = artifacts.write_report(spark, f"{tmp_path}/report", {"slices": events.select("game", "pa"), "metrics": events.agg(F.count("*").alias("n"))})
    assert artifacts.read_json(spark, f"{tmp_path}/report/report.json") == report and report["metrics"] == [{"n": 8}]
    with pytest.raises(ValueError):
        artifacts.write_report(spark, f"{tmp_path}/big", {"slices": events}, most=7)
    artifacts.write_profile(events, f"{tmp_path}/profile")
    assert artifacts.read_profile(spark, f"{tmp_path}/profile").count() == 8
    with pytest.raises(ValueError):
        artifacts.write_profile(events.limit(0), f"{tmp_path}/empty-profile")


def test_runs_keep_the_best_model(spark, tmp_path):
    rows = spark.createDataFrame([(1, 1, i, float(i % 2), "a" if i % 2 else "b") for i in range(40)], "game int, pa int, seq int, f double, token string")
    model, runs = learned.mlp_model(rows, ["f"], "token", iterations=5), f"{tmp_path}/runs"
    assert [artifacts.save_if_better(spark, f"{runs}/r1", model, loss) for loss in (2.0, 3.0, 1.0)] == [True, False, True]
    assert artifacts.resolve_run(spark, runs) == f"{runs}/r1" == artifacts.resolve_run(spark, runs, "r1")
    with pytest.raises(FileNotFoundError):
        artifacts.resolve_run(spark, runs, "r2")
    assert [r.best for r in artifacts.read_log(spark, f"{runs}/r1/metrics").collect()] == [True, False, True]
    prepare.prepare(pitch_log(spark, SF), f"{tmp_path}/prepared", history=1)
    artifacts.export_run(spark, f"{runs}/r1", f"{tmp_path}/prepared", f"{tmp_path}/bundle")
    assert artifacts.names(spark, f"{tmp_path}/bundle") == ["meta.json", "metrics", "model", "vocabs"]
    unknown = rows.withColumn("token", F.lit("c"))
    assert learned.mlp(rows, unknown, ["f"], "token").count() == 40


def test_corruption_and_samples_depend_on_keys_alone(spark):
    p = pitch_rows(spark, SF)
    first = simulation.corrupted(p, {"balls": (3, 1)}, ["pa", "line"], 0.2, 1).select("pa", "line", "balls")
    again = simulation.corrupted(p.repartition(3), {"balls": (3, 1)}, ["pa", "line"], 0.2, 1).select("pa", "line", "balls")
    assert first.exceptAll(again).isEmpty() and 0.08 < first.exceptAll(p.select("pa", "line", F.col("balls").cast("int"))).count() / p.count() < 0.2
    a = prepare.evaluation_sample(p, ["pa", "line"], 0.25, 1)
    assert a.exceptAll(prepare.evaluation_sample(p.repartition(3), ["pa", "line"], 0.25, 1)).isEmpty() and abs(a.count() / p.count() - 0.25) < 0.03
    order = [r.pa for r in prepare.shuffled(p, ["pa", "line"], 5).limit(50).collect()]
    assert order == [r.pa for r in prepare.shuffled(p.repartition(3), ["pa", "line"], 5).limit(50).collect()] != sorted(order)
