"""The log's one exchange, the boundary from counted days, passes over written logs, rollouts that need no further exchange."""

import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from plait.operators import heads, network, simulation, splitting
from plait.plans import learning, scoring, simulating
from plait.sources.tables import pitch_days, pitch_log, pitch_rows

SF = "/root/testdata/sf0.001"


@pytest.fixture()
def no_broadcast(spark):
    kept = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield
    for k, v in kept.items():
        spark.conf.set(k, v)


def exchanges(df):
    return re.findall(r"Exchange hashpartitioning\((\w+)", df._jdf.queryExecution().executedPlan().toString())


def test_lines_are_shuffled_once_for_join_and_windows(spark, no_broadcast):
    log = simulating.state_rows(spark, SF)
    assert exchanges(log) == ["game", "_game"]
    names = [c for c in pitch_rows(spark, SF).columns if c not in ("x", "y")]
    assert sorted(map(str, pitch_log(spark, SF).select(names).collect())) == sorted(map(str, pitch_rows(spark, SF).select(names).collect()))


def test_rollout_adds_no_exchange_to_a_log_that_lies_by_game(spark, no_broadcast):
    p = heads.Predictor.of(heads.fit(simulating.state_rows(spark, SF), 7, 13), simulating.OUTCOME_NAMES)
    rolled = simulation.rollout(simulating.state_rows(spark, SF), p, "rules", keep=["game", "pa", "seq"], add=["sim_balls", "p_type"])
    assert exchanges(rolled) == ["game", "_game"] and rolled.columns == ["game", "pa", "seq", "sim_balls", "p_type"]


def test_boundary_of_counted_days_is_the_logs(spark):
    assert splitting.boundary_of(pitch_days(spark, SF), 0.1).first() == splitting.boundary(pitch_log(spark, SF), 0.1).first()
    assert sorted(map(tuple, pitch_days(spark, SF).collect())) == sorted(map(tuple, splitting.rows_per_day(pitch_rows(spark, SF)).collect()))


def test_scored_rows_no_longer_read_the_lines(spark, no_broadcast):
    assert "lineitem" not in scoring.empirical(spark, SF, ["game"])._jdf.queryExecution().executedPlan().toString()


def test_heads_group_rows_once(spark):
    plan = heads.fit(simulating.state_rows(spark, SF), 7, 13)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Expand") < plan.index("Window") and plan[: plan.index("Window")].count("Aggregate") == 2


def test_batches_are_dealt_without_a_shuffle(spark, monkeypatch):
    e, (train, valid) = learning.learning_rows(spark, SF)
    plans = []

    def seen(df, name, by=None):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return df

    monkeypatch.setattr(network, "written", seen)
    network.train(train, valid, learning.shape_of(e), ["game", "pa", "seq"], epochs=1, batches=2)
    assert len(plans) == 3 and not any("Exchange" in p or "lineitem" in p for p in plans)


def test_half_way_means_round_away_from_zero_whatever_the_order_of_sums(spark):
    low, high = 2.2484374999999996, 2.2484375000000004
    got = spark.createDataFrame([(low,), (high,), (-low,)], "v double").select(learning.settled("v").alias("v")).collect()
    assert [r.v for r in got] == [2.248438, 2.248438, -2.248438] and spark.range(1).select(F.round(F.lit(low), 6)).first()[0] == 2.248437


def test_network_reads_a_written_log(spark, no_broadcast):
    assert "lineitem" not in simulating.mlp_predict(spark, SF)._jdf.queryExecution().executedPlan().toString()


def test_a_rollout_asks_the_predictor_once_for_each_distinct_context(spark, monkeypatch):
    p = heads.Predictor.of(heads.fit(simulating.state_rows(spark, SF), 7, 13), simulating.OUTCOME_NAMES)
    asked, step, size = [], heads.Predictor.step, 5_000
    monkeypatch.setattr(heads.Predictor, "step", lambda *a: asked.append(1) or step(*a))
    keep = ["game", "pa", "seq", *simulation.FIELDS]
    batch = pa.RecordBatch.from_pydict({c: pa.array(range(size) if c == "seq" else [7] * size if c == "game" else [0] * size, pa.int32()) for c in keep})
    schema = to_arrow_schema(StructType.fromDDL("game int, sim_inning int, p_type int"))
    got = list(simulation.fold(p, "constrained", 4, ["game"], schema)([batch, batch]))
    assert sum(b.num_rows for b in got) == 2 * size and 0 < len(asked) < 500
