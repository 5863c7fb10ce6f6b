"""Rules, decoders, replay, rollouts, traces; learned predictors."""

from __future__ import annotations

from pyspark.sql import functions as F

from plait.functions import columns as X
from plait.functions import rules
from plait.operators import features, heads, learned, sequences, simulation, splitting
from plait.plans.profiling import CLUSTERS_SQL, fitted_clusters, with_cluster
from plait.plans.registry import query
from plait.plans.relational import LG, NEXT, TRAIN, bucketed
from plait.plans.scoring import EMPIRICAL, TOKENS, VS, T, _case, _ids, empirical, held_out_from, scored
from plait.sources.scratch import written
from plait.sources.tables import OUTCOMES, pitch_log, pitch_rows, vector_scores

_B, _E, _S = (", ".join(f"'{x}'" for x in v) for v in (rules.BALLS, rules.ENDS, rules.STRIKES))


def _rules_sql(o, b, s):
    ended = f"({o} IN ({_B}) AND {b} >= 3) OR {o} IN ({_E}) OR ({o} IN ({_S}) AND {s} >= 2) OR ({o} = 'foul_bunt' AND {s} >= 2)"
    return {
        "balls": f"CASE WHEN {ended} THEN 0 WHEN {o} IN ({_B}) THEN {b} + 1 ELSE {b} END",
        "strikes": f"CASE WHEN {ended} THEN 0 WHEN {o} IN ({_S}) OR {o} = 'foul_bunt' THEN {s} + 1 WHEN {o} = 'foul' AND {s} < 2 THEN {s} + 1 ELSE {s} END",
        "pa_end": f"CASE WHEN {ended} THEN 1 ELSE 0 END",
        "used": f"CASE WHEN {o} IN ({_B}, {_E}, {_S}, 'foul', 'foul_bunt') THEN 1 ELSE 0 END",
    }


_R = _rules_sql("outcome", "balls", "strikes")


@query("count_rules", f"{LG} SELECT game, pa, seq, " + ", ".join(f"{v} AS next_{k}" for k, v in _R.items()) + " FROM lg")
def count_rules(spark, sf):
    p = pitch_log(spark, sf).withColumn("r", rules.count_rules("outcome", "balls", "strikes"))
    return p.select("game", "pa", "seq", *[F.col(f"r.{k}").alias(f"next_{k}") for k in _R])


def _decoder_rows(p):
    """Log probabilities by small integer weights, so both engines agree exactly."""
    logs = lambda name, n, m: F.array(*[-((F.col("inning") * (i + m) + F.col("seq")) % 7 + 1).cast("double") / 4 for i in range(n)]).alias(name)
    return p.select("game", "pa", "seq", "balls", "strikes", "outcome", logs("lb", 4, 1), logs("ls", 3, 2), logs("le", 2, 3))


def _log_sql(i, m):
    return f"(-((inning * ({i} + {m}) + seq) % 7 + 1) / 4.0::DOUBLE)"


_LB = f"[{', '.join(_log_sql(i, 1) for i in range(4))}]"
_LS = f"[{', '.join(_log_sql(i, 2) for i in range(3))}]"
_LE = f"[{', '.join(_log_sql(i, 3) for i in range(2))}]"


@query("clamp_decode", f"""{LG}, dl AS (SELECT game, pa, seq, balls, strikes, {_LB} AS lb, {_LS} AS ls FROM lg),
 cd AS (SELECT game, pa, seq, 0 AS r, balls AS b, strikes AS s, lb[balls + 1] + ls[strikes + 1] AS sc FROM dl
 UNION ALL SELECT game, pa, seq, 1, balls + 1, strikes, lb[balls + 2] + ls[strikes + 1] FROM dl WHERE balls < 3
 UNION ALL SELECT game, pa, seq, 2, balls, strikes + 1, lb[balls + 1] + ls[strikes + 2] FROM dl WHERE strikes < 2)
 SELECT game, pa, seq, CAST(b AS INT) AS next_balls, CAST(s AS INT) AS next_strikes FROM cd QUALIFY row_number() OVER (PARTITION BY game, pa, seq ORDER BY sc DESC, r) = 1""")
def clamp_decode(spark, sf):
    d = _decoder_rows(pitch_log(spark, sf)).withColumn("d", rules.clamped("balls", "strikes", "lb", "ls"))
    return d.select("game", "pa", "seq", F.col("d.balls").alias("next_balls"), F.col("d.strikes").alias("next_strikes"))


_OUT = ("ball", "called_strike", "foul", "hit_into_play")


def _one_rule(i, o):
    r = _rules_sql(f"'{o}'", "balls", "strikes")
    return f"SELECT game, pa, seq, {i} AS r, b, s, e, 1 AS used, 0.35::DOUBLE * CASE WHEN outcome = '{o}' THEN -0.1 ELSE -3.0 END + le[e + 1] + lb[b + 1] + ls[s + 1] AS sc FROM (SELECT *, {r['balls']} AS b, {r['strikes']} AS s, {r['pa_end']} AS e FROM dl)"


@query("constrained_decode", f"""{LG}, dl AS (SELECT game, pa, seq, balls, strikes, outcome, {_LB} AS lb, {_LS} AS ls, {_LE} AS le FROM lg),
 hd AS (SELECT game, pa, seq, -1 AS r, list_position(lb, list_max(lb)) - 1 AS b, list_position(ls, list_max(ls)) - 1 AS s, list_position(le, list_max(le)) - 1 AS e, 0 AS used, list_max(le) + list_max(lb) + list_max(ls) AS sc FROM dl),
 cd AS (SELECT * FROM hd UNION ALL {' UNION ALL '.join(_one_rule(i, o) for i, o in enumerate(_OUT))})
 SELECT game, pa, seq, CAST(b AS INT) AS next_balls, CAST(s AS INT) AS next_strikes, CAST(e AS INT) AS pa_end, CAST(used AS INT) AS used FROM cd QUALIFY row_number() OVER (PARTITION BY game, pa, seq ORDER BY round(sc, 9) DESC, r) = 1""")
def constrained_decode(spark, sf):
    logs = {o: F.when(F.col("outcome") == o, F.lit(-0.1)).otherwise(F.lit(-3.0)) for o in _OUT}
    d = _decoder_rows(pitch_log(spark, sf)).withColumn("d", rules.constrained("balls", "strikes", "le", "lb", "ls", logs))
    return d.select("game", "pa", "seq", F.col("d.balls").alias("next_balls"), F.col("d.strikes").alias("next_strikes"), F.col("d.pa_end").alias("pa_end"), F.col("d.used").alias("used"))


@query("replay_summary", EMPIRICAL + " SELECT count(*) AS n, count(DISTINCT game) AS games, round(avg(hit1), 6) AS acc, round(avg(hit3), 6) AS top3, round(sum(se), 4) AS loc_se, round(sqrt(avg(se / 2)), 6) AS loc_rmse FROM em")
def replay_summary(spark, sf):
    e = empirical(spark, sf, ["game"])
    return e.agg(F.count("*").alias("n"), F.count_distinct("game").alias("games"), F.round(F.avg("hit1"), 6).alias("acc"), F.round(F.avg("hit3"), 6).alias("top3"), F.round(F.sum("se"), 4).alias("loc_se"), F.round(F.sqrt(F.avg(F.col("se") / 2)), 6).alias("loc_rmse"))


OUTCOME_NAMES = ("other", *OUTCOMES[:-1])
NO = len(OUTCOME_NAMES)


def state_rows(spark, sf):
    """Events with ids, the actual state as integers, the targets of the next state, and the actual history's last known token and outcome."""
    p = sequences.next_state(pitch_log(spark, sf)).withColumns({"token_id": _ids("token", TOKENS), "outcome_id": _ids("outcome", OUTCOMES[:-1])})
    occ = {x: X.occupied(x).cast("int") for x in ("on_1", "on_2", "on_3")}
    p = p.withColumns({**occ, "pitch_number": F.col("seq"), "side": F.when(F.col("side") == "Bot", 1).otherwise(0)})
    p = p.withColumns({f: F.col(f).cast("int") for f in simulation.FIELDS})
    return simulation.actual_history(p)


def heads_table(spark, sf, levels=heads.LEVELS, cut=None):
    """The heads of the training part; ``cut``: its boundary, where that is known already."""
    return heads.fit(splitting.before(state_rows(spark, sf), cut or held_out_from(spark, sf)), T, NO, levels)


def predictor(spark, sf, levels=heads.LEVELS, cut=None):
    return heads.Predictor.of(heads_table(spark, sf, levels, cut), OUTCOME_NAMES, levels)


PLAYED = ["game", "pa", "seq", "day", "token_id", "outcome_id", "x", "y", *simulation.FIELDS]

_LAST = lambda c: f"coalesce({', '.join(f'nullif(lag({c}, {i}) OVER w, 0)' for i in range(1, 5))}, 0)"
STATES = f"""{LG}, {TRAIN}, {NEXT}, si AS (SELECT *, {_case('token', TOKENS)} AS token_id, {_case('outcome', OUTCOMES[:-1])} AS outcome_id FROM nx),
 sh AS (SELECT *, {_LAST('token_id')} AS prev_type, {_LAST('outcome_id')} AS prev_outcome FROM si WINDOW w AS (PARTITION BY game, pa ORDER BY seq)),
 ft AS (SELECT sh.* FROM sh, ct WHERE day < valid_from), va AS (SELECT sh.* FROM sh, ct WHERE day >= valid_from)"""


def _counts_sql(y, n, also=""):
    return "[" + ", ".join(f"count(*) FILTER ({y} = {i}{also})" for i in range(n)) + "]"


_AGGS = ", ".join(["count(*) AS n", "sum(y_has_next) AS n_next", "avg(x) AS mean_x", "avg(y) AS mean_y", f"{_counts_sql('token_id', T)} AS c_type", f"{_counts_sql('outcome_id', NO)} AS c_outcome", *[f"{_counts_sql(y, n, ' AND y_has_next = 1')} AS c_{h}" for h, (y, n) in heads.STATE.items()]])
_GOT = ["n", "n_next", "mean_x", "mean_y", "c_type", "c_outcome", *[f"c_{h}" for h in heads.STATE]]
_KEYS = ("balls", "strikes", "prev_type", "prev_outcome")


def contexts_sql(levels=heads.LEVELS):
    """``tx0``: every context with the counts of its finest known level, and each head's best."""
    parts = [f"l{i} AS (SELECT {''.join(k + ', ' for k in level)}{_AGGS} FROM ft {'GROUP BY ' + ', '.join(level) if level else ''} HAVING sum(y_has_next) >= 1)" for i, level in enumerate(levels)]
    joins = " ".join(f"LEFT JOIN l{i} ON {' AND '.join(f'l{i}.{k} = cx.{k}' for k in level) or 'TRUE'}" for i, level in enumerate(levels))
    pick = ", ".join("coalesce(" + ", ".join(f"l{i}.{c}" for i in range(len(levels))) + f") AS {c}" for c in _GOT)
    top = ", ".join(f"list_position(c_{h}, list_max(c_{h})) - 1 AS h_{h}" for h in ("type", "outcome", *heads.STATE))
    grid = ", ".join(f"(SELECT unnest(generate_series(0, {n - 1})) AS {k})" for k, n in zip(_KEYS, (4, 3, T, NO)))
    return f"{', '.join(parts)}, cx AS (SELECT * FROM {grid}), tx1 AS (SELECT cx.*, {pick} FROM cx {joins}), tx0 AS (SELECT *, {top} FROM tx1)"


def _log_of(head, i, n, total="n_next"):
    return f"ln((c_{head}[CAST({i} AS INT) + 1] + 1.0::DOUBLE) / ({total} + {n}))"


def transitions_sql(mode):
    """``tx``: the next count of each context by mode: nb, ns, pe, the outcome oc, and whether a rule gave them."""
    lb, ls, le = (lambda i: _log_of("balls", i, 4)), (lambda i: _log_of("strikes", i, 3)), (lambda i: _log_of("pa_end", i, 2))
    if mode == "heads":
        return "tx AS (SELECT *, h_balls AS nb, h_strikes AS ns, h_pa_end AS pe, h_outcome AS oc, 0 AS used FROM tx0)"
    if mode == "clamp":
        score = lambda b, s: f"round({lb(b)} + {ls(s)}, 9)"
        stay, ball, strike = score("balls", "strikes"), score("least(balls + 1, 3)", "strikes"), score("balls", "least(strikes + 1, 2)")
        move = f"CASE WHEN {stay} >= {ball} AND {stay} >= {strike} THEN 0 WHEN {ball} >= {strike} THEN 1 ELSE 2 END"
        return f"""tm AS (SELECT *, {move} AS mv FROM tx0), tx AS (SELECT *, CASE WHEN h_pa_end = 1 THEN 0 WHEN mv = 1 THEN least(balls + 1, 3) ELSE balls END AS nb,
 CASE WHEN h_pa_end = 1 THEN 0 WHEN mv = 2 THEN least(strikes + 1, 2) ELSE strikes END AS ns, h_pa_end AS pe, h_outcome AS oc, 0 AS used FROM tm)"""
    if mode == "rules":
        names = ", ".join(f"'{x}'" for x in OUTCOME_NAMES)
        r = _rules_sql("told", "balls", "strikes")
        pick = lambda k, h: f"CASE WHEN {r['used']} = 1 THEN {r[k]} ELSE {h} END"
        return f"tn AS (SELECT *, [{names}][CAST(h_outcome AS INT) + 1] AS told FROM tx0), tx AS (SELECT *, {pick('balls', 'h_balls')} AS nb, {pick('strikes', 'h_strikes')} AS ns, {pick('pa_end', 'h_pa_end')} AS pe, h_outcome AS oc, {r['used']} AS used FROM tn)"
    cand = [f"SELECT *, -1 AS r, h_balls AS nb, h_strikes AS ns, h_pa_end AS pe, h_outcome AS oc, 0 AS used, round({le('h_pa_end')} + {lb('h_balls')} + {ls('h_strikes')}, 9) AS sc FROM tx0"]
    for i, o in enumerate(OUTCOME_NAMES[1:], 1):
        r = _rules_sql(f"'{o}'", "balls", "strikes")
        cand.append(f"SELECT *, round(0.35::DOUBLE * {_log_of('outcome', i, NO, 'n')} + {le('pe')} + {lb('nb')} + {ls('ns')}, 9) AS sc FROM (SELECT *, {i} AS r, {r['balls']} AS nb, {r['strikes']} AS ns, {r['pa_end']} AS pe, {i} AS oc, 1 AS used FROM tx0)")
    return f"tx AS (SELECT * FROM ({' UNION ALL '.join(cand)}) QUALIFY row_number() OVER (PARTITION BY {', '.join(_KEYS)} ORDER BY sc DESC, r) = 1)"


_KNOWN = lambda h: f"coalesce(list_filter({h}, lambda z: z <> 0)[-1], 0)"
_NOW = "CAST(inning AS INT) AS inning, CAST(outs AS INT) AS outs, CAST(balls AS INT) AS balls, CAST(strikes AS INT) AS strikes, CAST(seq AS INT) AS pitch_number, CAST(score_diff AS INT) AS score_diff, CAST(on_1 IS NOT NULL AS INT) AS on_1, CAST(on_2 IS NOT NULL AS INT) AS on_2, CAST(on_3 IS NOT NULL AS INT) AS on_3, CASE WHEN side = 'Bot' THEN 1 ELSE 0 END AS side"


def rollout_sql(mode, source="sh", levels=heads.LEVELS):
    """``cr``: the events in order; ``ro``: their simulated states with the predicted history; ``rp``: with the prediction beside."""
    keep = lambda h, x: f"CASE WHEN x.pe = 1 THEN CAST([] AS INT[]) ELSE list_append(s.{h}, CAST({x} AS INT))[-4:] END"
    return f"""{STATES.replace('WITH', 'WITH RECURSIVE', 1)}, {contexts_sql(levels)}, {transitions_sql(mode)},
 cr AS (SELECT game, pa, seq, token_id, outcome_id, x, y, {_NOW}, row_number() OVER (PARTITION BY game ORDER BY pa, seq) AS i FROM {source}),
 ro AS (SELECT game, i, pa, seq, {', '.join(simulation.FIELDS)}, CAST([] AS INT[]) AS ht, CAST([] AS INT[]) AS ho FROM cr WHERE i = 1
 UNION ALL SELECT n.game, n.i, n.pa, n.seq, CAST(s.inning + x.h_inning_delta AS INT), CAST(x.h_outs AS INT), CAST(x.nb AS INT), CAST(x.ns AS INT), CASE WHEN x.pe = 1 THEN 1 ELSE s.pitch_number + 1 END,
 CAST(s.score_diff + x.h_score_delta - 4 AS INT), CAST(x.h_on_1 AS INT), CAST(x.h_on_2 AS INT), CAST(x.h_on_3 AS INT), CAST(x.h_side AS INT), {keep('ht', 'x.h_type')}, {keep('ho', 'x.oc')}
 FROM ro s JOIN tx x ON x.balls = s.balls AND x.strikes = s.strikes AND x.prev_type = {_KNOWN('s.ht')} AND x.prev_outcome = {_KNOWN('s.ho')} JOIN cr n ON n.game = s.game AND n.i = s.i + 1),
 rp AS (SELECT ro.*, x.* EXCLUDE (balls, strikes) FROM ro JOIN tx x ON x.balls = ro.balls AND x.strikes = ro.strikes AND x.prev_type = {_KNOWN('ro.ht')} AND x.prev_outcome = {_KNOWN('ro.ho')})"""


def played(spark, sf, mode, levels=heads.LEVELS, held_out=False, cut=None, **columns):
    cut = cut or held_out_from(spark, sf)
    rows = state_rows(spark, sf).select(*PLAYED)
    return simulation.rollout(splitting.since(rows, cut) if held_out else rows, predictor(spark, sf, levels, cut), mode, **columns)


SIM = {"keep": ["game", "pa", "seq"], "add": [f"sim_{f}" for f in simulation.FIELDS]}


def simulated(rolled):
    return rolled.select("game", "pa", "seq", *[F.col(f"sim_{f}").alias(f) for f in simulation.FIELDS])


for _mode in simulation.MODES:

    @query(f"rollout_{_mode}", rollout_sql(_mode) + f" SELECT game, pa, seq, {', '.join(simulation.FIELDS)} FROM ro")
    def rollout(spark, sf, mode=_mode):
        return simulated(played(spark, sf, mode, **SIM))

    @query(f"rollout_summary_{_mode}", rollout_sql(_mode, "va") + """ SELECT count(DISTINCT game) AS games, count(*) AS n, round(avg(CASE WHEN h_type = token_id THEN 1.0::DOUBLE ELSE 0 END), 6) AS acc,
 round(avg(CASE WHEN len(list_filter(generate_series(0, 6), lambda t: c_type[t + 1] > c_type[token_id + 1] OR (c_type[t + 1] = c_type[token_id + 1] AND t < token_id))) < 3 THEN 1.0::DOUBLE ELSE 0 END), 6) AS top3,
 round(avg(CASE WHEN oc = outcome_id THEN 1.0::DOUBLE ELSE 0 END), 6) AS outcome_acc, round(sqrt(avg(((x - mean_x) ** 2 + (y - mean_y) ** 2) / 2)), 6) AS loc_rmse,
 CAST(sum(used) AS BIGINT) AS rules_used, CAST(sum(CASE WHEN oc <> h_outcome THEN 1 ELSE 0 END) AS BIGINT) AS outcomes_overridden FROM rp JOIN (SELECT game, i, token_id, outcome_id, x, y FROM cr) USING (game, i)""")
    def rollout_summary(spark, sf, mode=_mode):
        return simulation.summary(played(spark, sf, mode, held_out=True, keep=["game", "token_id", "outcome_id", "x", "y"], add=["p_type", "p_top", "p_outcome", "p_x", "p_y", "used", "overridden"]))


@query("rollout_predicted", rollout_sql("constrained") + " SELECT game, pa, seq, CAST(prev_type AS INT) AS prev_type, CAST(prev_outcome AS INT) AS prev_outcome, CAST(h_type AS INT) AS p_type, CAST(oc AS INT) AS p_outcome, round(mean_x, 9) AS p_x, round(mean_y, 9) AS p_y, CAST(pe AS INT) AS p_pa_end, CAST(used AS INT) AS used FROM rp")
def rollout_predicted(spark, sf):
    r = played(spark, sf, "constrained", keep=SIM["keep"], add=["prev_type", "prev_outcome", "p_type", "p_outcome", "p_x", "p_y", "p_pa_end", "used"])
    return r.select("game", "pa", "seq", "prev_type", "prev_outcome", "p_type", "p_outcome", F.round("p_x", 9).alias("p_x"), F.round("p_y", 9).alias("p_y"), "p_pa_end", "used")


BY_COUNT = (("balls", "strikes"), ())


@query("rollout_empirical", rollout_sql("heads", levels=BY_COUNT) + f" SELECT game, pa, seq, {', '.join(simulation.FIELDS)} FROM ro")
def rollout_empirical(spark, sf):
    return simulated(played(spark, sf, "heads", BY_COUNT, **SIM))


@query("rollout_drift", rollout_sql("rules", "va") + " SELECT count(*) AS n, " + ", ".join(f"round(avg(CASE WHEN ro.{f} = cr.{f} THEN 1.0::DOUBLE ELSE 0 END), 6) AS match_{f}" for f in simulation.FIELDS) + " FROM ro JOIN cr USING (game, i)")
def rollout_drift(spark, sf):
    return simulation.drift(played(spark, sf, "rules", held_out=True, keep=simulation.FIELDS, add=SIM["add"]))


@query("replay_state_accuracy", f"{STATES}, {contexts_sql()} SELECT count(*) AS n, " + ", ".join(f"round(avg(CASE WHEN tx0.h_{h} = va.{y} THEN 1.0::DOUBLE ELSE 0 END), 6) AS {h}_acc" for h, (y, _) in heads.STATE.items()) + f" FROM va JOIN tx0 USING ({', '.join(_KEYS)}) WHERE y_has_next = 1")
def replay_state_accuracy(spark, sf):
    cut = held_out_from(spark, sf)
    return simulation.state_accuracy(simulation.replay(splitting.since(state_rows(spark, sf), cut), heads_table(spark, sf, cut=cut)))


@query("trace_json", f"{LG} SELECT game, pa, seq, '{{\"pitch_number\":' || seq || ',\"state\":{{\"inning\":' || inning || ',\"balls\":' || balls || ',\"strikes\":' || strikes || '}},\"y\":{{\"token\":\"' || token || '\",\"outcome\":\"' || outcome || '\"}}}}' AS event FROM lg")
def trace_json(spark, sf):
    state = F.struct(F.col("inning").cast("int").alias("inning"), F.col("balls").cast("int").alias("balls"), F.col("strikes").cast("int").alias("strikes"))
    return pitch_log(spark, sf).select("game", "pa", "seq", F.to_json(F.struct(F.col("seq").alias("pitch_number"), state.alias("state"), F.struct("token", "outcome").alias("y"))).alias("event"))


_NAMES = ("OOV", *TOKENS)


_TOPS = f"string_agg('\"' || [{', '.join(f"'{x}'" for x in _NAMES)}][cls + 1] || '\"', ',' ORDER BY r) AS top, max(CASE WHEN r = 1 THEN [{', '.join(f"'{x}'" for x in _NAMES)}][cls + 1] END) AS best"


@query("trace_predictions", EMPIRICAL + f""", tp AS (SELECT pitcher, balls, strikes, {_TOPS} FROM gc WHERE r <= 3 GROUP BY pitcher, balls, strikes), tg AS (SELECT {_TOPS} FROM gt WHERE r <= 3)
 SELECT game, pa, seq, '{{"pitch_number":' || seq || ',"y":{{"token":"' || token || '","outcome":"' || outcome || '"}},"pred":{{"token":"' || coalesce(tp.best, tg.best) || '","topk":[' || coalesce(tp.top, tg.top) || ']}},"metrics":{{"top1":' || CAST(hit1 AS INT) || ',"top3":' || CAST(hit3 AS INT) || '}}}}' AS event FROM em LEFT JOIN tp USING (pitcher, balls, strikes), tg""")
def trace_predictions(spark, sf):
    names = F.array(*[F.lit(x) for x in _NAMES])
    top = F.transform("top3", lambda i: F.get(names, i))
    hits = F.struct(F.col("hit1").cast("int").alias("top1"), F.col("hit3").cast("int").alias("top3"))
    record = F.struct(F.col("seq").alias("pitch_number"), F.struct("token", "outcome").alias("y"), F.struct(top[0].alias("token"), top.alias("topk")).alias("pred"), hits.alias("metrics"))
    return empirical(spark, sf, ["game", "pa", "seq", "token", "outcome"]).select("game", "pa", "seq", F.to_json(record).alias("event"))


@query("trace_at_bat", f"{LG} SELECT game, pa, seq, token, outcome, balls, strikes FROM lg WHERE game = 7 AND pa = (SELECT min(pa) FROM lg WHERE game = 7) ORDER BY seq")
def trace_at_bat(spark, sf):
    g = pitch_log(spark, sf, game=7)
    first = g.agg(F.min("pa").alias("_first"))
    return g.join(F.broadcast(first), F.col("pa") == F.col("_first")).select("game", "pa", "seq", "token", "outcome", "balls", "strikes").orderBy("seq")


@query("predict_requests", VS + "SELECT vec_id, max(CASE WHEN r = 1 THEN c END) AS type_1, round(max(CASE WHEN r = 1 THEN p END), 6) AS prob_1, max(CASE WHEN r = 5 THEN c END) AS type_5, round(max(CASE WHEN r = 5 THEN p END), 6) AS prob_5 FROM rk GROUP BY vec_id")
def predict_requests(spark, sf):
    from plait.functions.vectors import ranked

    s = scored(spark, sf).withColumn("r", ranked("p"))
    at = lambda i: F.get("r", F.lit(i - 1))
    return s.select("vec_id", *[x for i in (1, 5) for x in (at(i)["class"].cast("bigint").alias(f"type_{i}"), F.round(at(i)["p"], 6).alias(f"prob_{i}"))])


@query("kmeans_clusters")
def kmeans_clusters(spark, sf):
    return learned.clusters(vector_scores(spark, sf), "v", 8)


@query("cluster_assign", f"WITH {CLUSTERS_SQL} SELECT vec_id, cluster FROM cluster_of")
def cluster_assign(spark, sf):
    return fitted_clusters(spark, sf)


@query("cluster_profile", f"{LG}, {CLUSTERS_SQL} SELECT pitcher, coalesce(cluster, 0) AS batter_cluster, count(*) AS n, round(avg(x), 9) AS mean_x FROM lg LEFT JOIN cluster_of ON vec_id = batter % (SELECT count(*) FROM embeddings) GROUP BY 1, 2")
def cluster_profile(spark, sf):
    p = with_cluster(pitch_rows(spark, sf), fitted_clusters(spark, sf))
    return p.groupBy("pitcher", "batter_cluster").agg(F.count("*").alias("n"), F.round(F.avg("x"), 9).alias("mean_x"))


@query("mlp_predict")
def mlp_predict(spark, sf):
    cut = held_out_from(spark, sf)
    context = ["balls", "strikes", "outs", "inning", "score_diff", "runners_state"]
    log = features.nested_history(bucketed(pitch_log(spark, sf)), 4)
    p = written(log.select("game", "pa", "seq", "day", *context, "pitcher", "batter", "stand", "throws", "history", "token", "x", "y"), "log")
    inputs = {"identities": ["pitcher", "batter"], "categories": ["stand", "throws"], "history": "history", "length": 4, "place": ["x", "y"]}
    return learned.mlp(splitting.before(p, cut), splitting.since(p, cut), context, "token", **inputs)


def _noise_sql(seed, n):
    return f"((pa * 7919 + line * 104729 + {seed} * 1299709) % 2147483647 * 48271 % 2147483647 * 48271 % 2147483647 % {n})"


_PUT_SQL = "CASE WHEN {hit} < 200 THEN least(greatest({c} + {jump} - 1, 0), {hi}) ELSE {c} END AS {c}"
CORRUPTED = {"balls": (3, 11), "strikes": (2, 21)}


@query("state_corruption", f"{LG} SELECT game, pa, line, " + ", ".join("CAST(" + _PUT_SQL.format(c=c, hi=hi, hit=_noise_sql(seed, 1000), jump=_noise_sql(seed + 1, 3)).replace(f" AS {c}", f" AS INT) AS {c}") for c, (hi, seed) in CORRUPTED.items()) + " FROM lg")
def state_corruption(spark, sf):
    return simulation.corrupted(pitch_rows(spark, sf), CORRUPTED, ["pa", "line"], 0.2, 1).select("game", "pa", "line", *CORRUPTED)
