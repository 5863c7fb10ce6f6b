"""Rollouts, fitted heads, replay and traces."""

import itertools
import json
import tracemalloc

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from plait.functions import rules
from plait.operators import heads, simulation, splitting
from plait.plans import simulating
from plait.sources import artifacts

SF = "/root/testdata/sf0.001"
OUT = simulating.OUTCOME_NAMES


@pytest.fixture(scope="module")
def states(spark):
    return simulating.state_rows(spark, SF).persist()


@pytest.fixture(scope="module")
def table(states):
    return heads.fit(splitting.training(states, 0.1), simulating.T, simulating.NO).persist()


@pytest.fixture(scope="module")
def predictor(table):
    return heads.Predictor.of(table, OUT)


def test_rule_is_that_of_the_columns(spark):
    rows = [(o, b, s) for o in OUT for b in range(4) for s in range(3)]
    got = spark.createDataFrame(rows, "o string, b int, s int").select("o", "b", "s", rules.count_rules("o", "b", "s").alias("r")).collect()
    for r in got:
        want = heads.rule(r.o, r.b, r.s)
        assert (tuple(r.r)[:3] if r.r.used else None) == want


def test_modes_agree_with_the_column_decoders(spark, table, predictor):
    seen = table.where("level = 0").orderBy(*heads.LEVELS[0]).limit(150)
    logs = lambda h, n: F.transform(f"c_{h}", lambda x: F.log((x + 1.0) / (F.col(n) + F.size(f"c_{h}"))))
    lo = logs("outcome", "n")
    r = seen.select("*", rules.clamped("balls", "strikes", logs("balls", "n_next"), logs("strikes", "n_next")).alias("cl"), rules.constrained("balls", "strikes", logs("pa_end", "n_next"), logs("balls", "n_next"), logs("strikes", "n_next"), {o: lo[i] for i, o in enumerate(OUT) if i}).alias("co")).collect()
    assert len(r) > 100
    for x in r:
        context = {k: x[k] for k in heads.LEVELS[0]}
        s = predictor.step("constrained", x.balls, x.strikes, context)
        assert (s.balls, s.strikes, s.pa_end, s.used) == (x.co.balls, x.co.strikes, x.co.pa_end, x.co.used)
        s = predictor.step("clamp", x.balls, x.strikes, context)
        assert (s.balls, s.strikes) == ((0, 0) if s.pa_end else (x.cl.balls, x.cl.strikes))


def plain_rollout(rows, predictor, mode, history):
    out, game = [], None
    for r in rows:
        if r["game"] != game:
            game, state, events = r["game"], {f: r[f] or 0 for f in simulation.FIELDS}, []
        last = [next((e[i] for e in reversed(events[-history:]) if e[i]), 0) for i in (0, 1)]
        s = predictor.step(mode, state["balls"], state["strikes"], {**state, "prev_type": last[0], "prev_outcome": last[1]})
        out.append((r["game"], r["pa"], r["seq"], *state.values(), *last, s.type, s.outcome))
        events = [] if s.pa_end else [*events, (s.type, s.outcome)]
        n = s.rest
        state = dict(zip(simulation.FIELDS, (state["inning"] + n["inning_delta"], n["outs"], s.balls, s.strikes, 1 if s.pa_end else state["pitch_number"] + 1, state["score_diff"] + n["score_delta"] - 4, n["on_1"], n["on_2"], n["on_3"], n["side"])))
    return out


@pytest.mark.parametrize("mode", simulation.MODES)
def test_rollout_is_the_plain_fold_whatever_the_batches(spark, states, predictor, mode):
    rows = states.select(*simulating.PLAYED).withColumn("p_type", F.lit("clash"))
    want = plain_rollout(sorted((r.asDict() for r in rows.where("game < 60").collect()), key=lambda r: (r["game"], r["pa"], r["seq"])), predictor, mode, 4)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = simulation.rollout(rows.where("game < 60"), predictor, mode).select("game", "pa", "seq", *[f"sim_{f}" for f in simulation.FIELDS], "prev_type", "prev_outcome", "p_type", "p_outcome").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(map(tuple, got)) == want and len(want) > 1000


def test_a_game_of_a_million_events_takes_constant_memory(predictor):
    keep = ["game", "pa", "seq", *simulation.FIELDS]
    schema = to_arrow_schema(StructType.fromDDL(", ".join(f"{c} int" for c in keep) + ", " + ", ".join(f"{c} {t}" for c, t in simulation.SIMULATED.items())))
    size, peaks = 10_000, []

    def batches(n):
        for b in range(n):
            yield pa.RecordBatch.from_pydict({c: pa.array([7] * size if c == "game" else range(b * size, (b + 1) * size) if c == "seq" else [0] * size, pa.int32()) for c in keep})

    for n in (3, 100):
        tracemalloc.start()
        total = sum(b.num_rows for b in simulation.fold(predictor, "constrained", 4, keep, schema)(batches(n)))
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
        assert total == n * size
    assert peaks[1] < 1.5 * peaks[0]


def test_rollout_of_nothing_and_of_nulls(spark, states, predictor):
    rows = states.select(*simulating.PLAYED)
    assert simulation.rollout(rows.limit(0), predictor, "rules").collect() == []
    empty = rows.where("game = 3").withColumns({f: F.lit(None).cast("int") for f in simulation.FIELDS})
    got = simulation.rollout(empty, predictor, "heads").orderBy("pa", "seq").collect()
    assert [got[0][f"sim_{f}"] for f in simulation.FIELDS] == [0] * 10 and len(got) > 20
    with pytest.raises(ValueError, match="no training rows"):
        heads.Predictor.of(heads.fit(states.limit(0), 7, 13), OUT)
    with pytest.raises(ValueError, match="count mode"):
        predictor.step("other", 0, 0, {k: 0 for k in heads.LEVELS[0]})


def test_a_context_may_take_the_events_own_columns(states):
    rows = states
    levels = (("pitcher", "balls"), ())
    p = heads.Predictor.of(heads.fit(splitting.training(rows, 0.1), 7, 13, levels), OUT, levels)
    got = simulation.rollout(rows.select(*simulating.PLAYED, "pitcher"), p, "clamp").collect()
    for r in itertools.islice(got, 0, None, 37):
        want = p.tables[0].get((r.pitcher, r.sim_balls)) or p.tables[1][()]
        assert r.p_type == heads.first_best(want["c_type"])


def test_attached_heads_are_the_predictors(states, table, predictor):
    rows = states
    far = rows.where("game = 1").withColumn("prev_type", F.lit(99))
    got = heads.attach(rows.where("game = 0").unionByName(far), table).collect()
    for r in got:
        c = predictor.counts({k: r[k] for k in heads.LEVELS[0]})
        assert sum(r.p_balls) == pytest.approx(1) and r.p_x == c["mean_x"]
        assert r.p_type == pytest.approx([(x + 1) / (c["n"] + 7) for x in c["c_type"]])


def test_trace_and_summary(spark, tmp_path):
    from plait.plans.learning import traced

    names = ["OOV", *simulating.TOKENS]
    events = simulation.trace(traced(spark, SF).where("game < 20"), names, list(OUT), F.col("loc_nll"))
    artifacts.write_trace(events.select("game", F.col("event")), f"{tmp_path}/trace", ["game"])
    records = [json.loads(r.event) for r in events.orderBy("game", "pa", "seq").collect()]
    assert records and all({"state", "actual_state", "state_match", "y", "pred", "metrics"} <= set(r) for r in records)
    for r in records:
        assert r["state_match"] == {f: int(r["state"][f] == r["actual_state"][f]) for f in simulation.FIELDS}
        assert r["metrics"]["top1"] == int(r["pred"]["token"] == r["y"]["token"]) and r["pred"]["topk"][0] == r["pred"]["token"]
        assert r["metrics"]["loc_se"] == pytest.approx((r["y"]["x"] - r["pred"]["x"]) ** 2 + (r["y"]["y"] - r["pred"]["y"]) ** 2, abs=1e-4)
    rolled = simulating.played(spark, SF, "rules", held_out=True).persist()
    got = simulation.simulate(rolled, f"{tmp_path}/summary.json", split="valid", mode="rollout", count_mode="rules")
    assert artifacts.read_json(spark, f"{tmp_path}/summary.json") == got and got["n"] == rolled.count() and got["rules_used"] > 0 and 0 <= got["match_balls"] <= 1
