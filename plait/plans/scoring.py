"""Baselines and metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from plait.functions import vectors as V
from plait.operators import baselines, metrics, sequences, splitting
from plait.plans.registry import query
from plait.plans.relational import BUCKETED, CUT, LG, bucketed
from plait.sources.scratch import written
from plait.sources.tables import OUTCOMES, PITCH_SQL, SCORES_SQL, pitch_days, pitch_log, vector_scores

#: Class ids of tokens and outcomes.
TOKENS = ("AF", "AO", "NF", "NO", "RF", "RO")
T = len(TOKENS) + 1
VS = f"WITH {SCORES_SQL} "


def _ids(col, values):
    out = F.lit(0)
    for i, v in enumerate(values, 1):
        out = F.when(F.col(col) == v, i).otherwise(out)
    return out


def held_out_from(spark, sf):
    """The first held-out day of the log."""
    return splitting.first_held_out(pitch_days(spark, sf), 0.1)


def labelled(spark, sf):
    """y: the token's class; prev_type and prev_outcome: last non-zero of the session's history; split at the boundary day."""
    cut = held_out_from(spark, sf)
    p = pitch_log(spark, sf)
    p = p.withColumn("token_id", _ids("token", TOKENS)).withColumn("outcome_id", _ids("outcome", OUTCOMES[:-1]))
    h = sequences.history(p, ["token_id", "outcome_id"], 4)
    h = h.withColumn("prev_type", sequences.last_nonzero([f"hist_token_id_{i}" for i in range(4)])).withColumn("prev_outcome", sequences.last_nonzero([f"hist_outcome_id_{i}" for i in range(4)]))
    return h.select("game", "pa", "seq", "day", "pitcher", "balls", "strikes", "prev_type", "prev_outcome", F.col("token_id").alias("y"), "outcome_id", "x", F.col("y").alias("y_loc")).withColumn("split", F.when(F.col("day") < F.lit(cut), "train").otherwise("valid"))


def _case(col, values):
    return f"CASE {col} " + " ".join(f"WHEN '{v}' THEN {i}" for i, v in enumerate(values, 1)) + " ELSE 0 END"


CUT_LOG = CUT.replace("FROM ev", "FROM lg")
LABELLED = f"""WITH {PITCH_SQL}, {CUT_LOG}, li AS (SELECT *, {_case('token', TOKENS)} AS token_id, {_case('outcome', OUTCOMES[:-1])} AS outcome_id FROM lg),
 lb AS (SELECT game, pa, seq, day, pitcher, balls, strikes,
 coalesce({', '.join(f'nullif(lag(token_id, {i}) OVER w, 0)' for i in range(1, 5))}, 0) AS prev_type,
 coalesce({', '.join(f'nullif(lag(outcome_id, {i}) OVER w, 0)' for i in range(1, 5))}, 0) AS prev_outcome,
 token_id AS y, outcome_id, x, y AS y_loc, CASE WHEN day < valid_from THEN 'train' ELSE 'valid' END AS split FROM li, ct WINDOW w AS (PARTITION BY game, pa ORDER BY seq))"""

for _name, _keys in baselines.GRAINS.items():

    @query(f"baseline_fit_{_name}", f"{LABELLED} SELECT {''.join(k + ', ' for k in _keys)}y, count(*) AS n, round(sum(x), 4) AS sum_x, round(sum(y_loc), 4) AS sum_y FROM lb WHERE split = 'train' GROUP BY {''.join(k + ', ' for k in _keys)}y")
    def baseline_fit(spark, sf, keys=tuple(_keys)):
        return baselines.fit(labelled(spark, sf).where("split = 'train'"), list(keys)).withColumn("sum_x", F.round("sum_x", 4)).withColumn("sum_y", F.round("sum_y", 4))

    _on = " AND ".join(f"va.{k} = gr.{k}" for k in _keys) or "TRUE"
    _k = "".join(f"{k}, " for k in _keys)
    _by = "GROUP BY " + ", ".join(_keys) if _keys else ""

    @query(f"baseline_eval_{_name}", f"""{LABELLED}, tr AS (SELECT * FROM lb WHERE split = 'train'), va AS (SELECT * FROM lb WHERE split = 'valid'),
 cl AS (SELECT unnest(generate_series(0, {T - 1})) AS cls),
 gl AS (SELECT cls, (SELECT count(*) FROM tr WHERE y = cls) AS n FROM cl), gt AS (SELECT cls, n, sum(n) OVER () AS tot, row_number() OVER (ORDER BY n DESC, cls) AS r FROM gl),
 gr AS (SELECT {_k}count(*) AS tot, avg(x) AS m_x, avg(y_loc) AS m_y FROM tr {_by}),
 gc AS (SELECT {''.join('gr.' + k + ', ' for k in _keys)}cls, coalesce(n, 0) AS n, row_number() OVER ({'PARTITION BY ' + ', '.join('gr.' + k for k in _keys) if _keys else ''} ORDER BY coalesce(n, 0) DESC, cls) AS r
  FROM gr CROSS JOIN cl LEFT JOIN (SELECT {_k}y, count(*) AS n FROM tr GROUP BY {_k}y) k ON k.y = cls {''.join(f'AND k.{k} = gr.{k} ' for k in _keys)}),
 jn AS (SELECT va.*, gr.tot AS g_tot, gr.m_x, gr.m_y, gc.n AS g_n, gc.r AS g_r, gt.n AS a_n, gt.r AS a_r, gt.tot AS a_tot,
  (SELECT avg(x) FROM tr) AS a_x, (SELECT avg(y_loc) FROM tr) AS a_y
  FROM va LEFT JOIN gr ON {_on} LEFT JOIN gc ON gc.cls = va.y {''.join(f'AND gc.{k} = va.{k} ' for k in _keys)} LEFT JOIN gt ON gt.cls = va.y)
 SELECT count(*) AS n, CAST(sum(CASE WHEN g_tot IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS fallback_n,
 round(avg(CASE WHEN coalesce(g_r, a_r) = 1 THEN 1.0::DOUBLE ELSE 0 END), 6) AS acc, round(avg(CASE WHEN coalesce(g_r, a_r) <= 3 THEN 1.0::DOUBLE ELSE 0 END), 6) AS top3,
 round(avg(-ln((CASE WHEN g_tot IS NULL THEN a_n ELSE g_n END + 1.0::DOUBLE) / (CASE WHEN g_tot IS NULL THEN a_tot ELSE g_tot END + {T}))), 6) AS ce,
 round(sqrt(avg(((x - coalesce(m_x, a_x)) ** 2 + (y_loc - coalesce(m_y, a_y)) ** 2) / 2)), 6) AS loc_rmse FROM jn""")
    def baseline_eval(spark, sf, keys=tuple(_keys)):
        p = written(labelled(spark, sf).select(*keys, "y", "x", "y_loc", "split"), "log")
        return baselines.evaluate(p.where("split = 'train'"), p.where("split = 'valid'"), list(keys), T)


@query("baseline_fit_rollup", f"""{LABELLED} SELECT pitcher, balls, strikes, prev_type, prev_outcome, y, count(*) AS n, CAST(grouping(pitcher, balls, strikes, prev_type, prev_outcome, y) AS BIGINT) AS gid
 FROM lb WHERE split = 'train' GROUP BY GROUPING SETS ((y), (pitcher, y), (pitcher, balls, strikes, y), (pitcher, balls, strikes, prev_type, y), (pitcher, balls, strikes, prev_type, prev_outcome, y))""")
def baseline_fit_rollup(spark, sf):
    return baselines.fit_all(labelled(spark, sf).where("split = 'train'"))


@query("top3_classes", f"{LABELLED} SELECT pitcher, y, n, rank FROM (SELECT pitcher, y, count(*) AS n, row_number() OVER (PARTITION BY pitcher ORDER BY count(*) DESC, y) AS rank FROM lb WHERE split = 'train' GROUP BY pitcher, y) WHERE rank <= 3")
def top3_classes(spark, sf):
    return baselines.top_classes(labelled(spark, sf).where("split = 'train'").groupBy("pitcher", "y").agg(F.count("*").alias("n")), ["pitcher"], 3)


def scored(spark, sf):
    return metrics.prediction_columns(vector_scores(spark, sf))


_TRUE = "(SELECT vec_id, p, r FROM rk WHERE c = label)"


@query("topk_accuracy", VS + f"SELECT count(*) AS n, round(avg(CASE WHEN r = 1 THEN 1.0::DOUBLE ELSE 0 END), 6) AS acc, round(avg(CASE WHEN r <= 3 THEN 1.0::DOUBLE ELSE 0 END), 6) AS top3 FROM {_TRUE}")
def topk_accuracy(spark, sf):
    return scored(spark, sf).agg(F.count("*").alias("n"), F.round(F.avg("hit1"), 6).alias("acc"), F.round(F.avg("hit3"), 6).alias("top3"))


@query("topk_per_row", VS + "SELECT vec_id, max(CASE WHEN r = 1 THEN c END) AS c1, max(CASE WHEN r = 2 THEN c END) AS c2, max(CASE WHEN r = 3 THEN c END) AS c3, round(max(CASE WHEN r = 1 THEN p END), 6) AS p1 FROM rk GROUP BY vec_id")
def topk_per_row(spark, sf):
    return scored(spark, sf).select("vec_id", *[F.get("top3", F.lit(i)).cast("bigint").alias(f"c{i + 1}") for i in range(3)], F.round("conf", 6).alias("p1"))


@query("log_loss", VS + f"SELECT round(avg(-ln(p)), 6) AS ce FROM {_TRUE}")
def log_loss(spark, sf):
    return scored(spark, sf).agg(F.round(F.avg("nll"), 6).alias("ce"))


@query("brier", VS + "SELECT round(avg(b), 6) AS brier FROM (SELECT vec_id, sum(p * p) - 2 * max(CASE WHEN c = label THEN p END) + 1 AS b FROM rk GROUP BY vec_id)")
def brier(spark, sf):
    return scored(spark, sf).agg(F.round(F.avg("brier"), 6).alias("brier"))


CAL = """cb AS (SELECT CAST(least(floor(p * 15), 14) AS INT) AS bin, count(*) AS n, avg(CASE WHEN c = label THEN 1.0::DOUBLE ELSE 0 END) AS acc, avg(p) AS conf FROM rk WHERE r = 1 GROUP BY 1)"""


@query("calibration_bins", f"{VS}, {CAL} SELECT CAST(b AS INT) AS bin, coalesce(n, 0) AS n, round(acc, 6) AS acc, round(conf, 6) AS conf FROM (SELECT unnest(generate_series(0, 14)) AS b) LEFT JOIN cb ON bin = b")
def calibration_bins(spark, sf):
    return metrics.calibration(scored(spark, sf)).select("bin", "n", F.round("acc", 6).alias("acc"), F.round("conf", 6).alias("conf"))


@query("calibration_edges", VS + """, ed AS (SELECT i AS bin, i / 15.0::DOUBLE AS lo, (i + 1) / 15.0::DOUBLE AS hi FROM (SELECT unnest(generate_series(0, 14)) AS i)), best AS (SELECT p, CASE WHEN c = label THEN 1.0::DOUBLE ELSE 0 END AS hit FROM rk WHERE r = 1)
 SELECT CAST(bin AS INT) AS bin, round(lo, 9) AS lo, round(hi, 9) AS hi, count(p) AS n, round(avg(hit), 6) AS acc, round(avg(p), 6) AS conf FROM ed LEFT JOIN best ON p >= lo AND (p < hi OR bin = 14 AND p <= hi) GROUP BY bin, lo, hi""")
def calibration_edges(spark, sf):
    return metrics.calibration_edges(scored(spark, sf)).select("bin", F.round("lo", 9).alias("lo"), F.round("hi", 9).alias("hi"), "n", F.round("acc", 6).alias("acc"), F.round("conf", 6).alias("conf"))


@query("ece", f"{VS}, {CAL} SELECT round(sum(abs(acc - conf) * n) / CAST(sum(n) AS DOUBLE), 6) AS ece FROM cb")
def ece(spark, sf):
    return metrics.calibration_error(metrics.calibration(scored(spark, sf))).select(F.round("ece", 6).alias("ece"))


def _vector_places(p):
    v = F.col("v")
    return p.withColumn("se", F.pow(v[8] - v[48], 2) + F.pow(v[9] - v[49], 2))


@query("loc_rmse", VS + "SELECT round(sqrt(avg(((v[9] - v[49]) ** 2 + (v[10] - v[50]) ** 2) / 2)), 6) AS loc_rmse FROM vs")
def loc_rmse(spark, sf):
    return _vector_places(vector_scores(spark, sf)).agg(F.round(F.sqrt(F.avg("se") / 2), 6).alias("loc_rmse"))


@query("eval_summary", VS + f"""SELECT count(*) AS n, round(avg(CASE WHEN r = 1 THEN 1.0::DOUBLE ELSE 0 END), 6) AS acc, round(avg(CASE WHEN r <= 3 THEN 1.0::DOUBLE ELSE 0 END), 6) AS acc_top3, round(avg(-ln(p)), 6) AS ce,
 round(sqrt(avg(((v[9] - v[49]) ** 2 + (v[10] - v[50]) ** 2) / 2)), 6) AS loc_rmse FROM {_TRUE} t JOIN vs USING (vec_id)""")
def eval_summary(spark, sf):
    return _vector_places(scored(spark, sf)).agg(F.count("*").alias("n"), F.round(F.avg("hit1"), 6).alias("acc"), F.round(F.avg("hit3"), 6).alias("acc_top3"), F.round(F.avg("nll"), 6).alias("ce"), F.round(F.sqrt(F.avg("se") / 2), 6).alias("loc_rmse"))


EMPIRICAL_KEYS = ["pitcher", "balls", "strikes"]


def empirical(spark, sf, also):
    """The held-out rows with the entity-and-count predictor's columns beside each, from shares of the training rows (alpha 1); unseen groups take the global shares.

    ``y`` becomes the token's class, ``y_loc`` the place; ``also``: further columns to keep.  The log is written once, for all passes over its parts."""
    cut = held_out_from(spark, sf)
    p = bucketed(pitch_log(spark, sf)).withColumn("y_loc", F.col("y")).withColumn("y", _ids("token", TOKENS))
    p = written(p.select(*dict.fromkeys(["day", *EMPIRICAL_KEYS, "y", "x", "y_loc", *also])), "log")
    j = baselines.predicted(splitting.before(p, cut), splitting.since(p, cut), EMPIRICAL_KEYS, T)
    return j.withColumns({
        "hit1": (F.col("top3")[0] == F.col("y")).cast("double"), "hit3": F.array_contains("top3", F.col("y")).cast("double"),
        "nll": -F.log((F.get("c", F.col("y")) + 1.0) / F.col("denominator")), "se": F.pow(F.col("x") - F.col("m_x"), 2) + F.pow(F.col("y_loc") - F.col("m_y"), 2),
    })


EMPIRICAL = f"""{BUCKETED}, {CUT_LOG}, yb AS (SELECT bk.*, {_case('token', TOKENS)} AS y_id, day < valid_from AS is_train FROM bk, ct), cl AS (SELECT unnest(generate_series(0, {T - 1})) AS cls),
 ft AS (SELECT * FROM yb WHERE is_train), va AS (SELECT * FROM yb WHERE NOT is_train),
 gr AS (SELECT pitcher, balls, strikes, count(*) AS tot, avg(x) AS m_x, avg(y) AS m_y FROM ft GROUP BY ALL), ga AS (SELECT count(*) AS a_tot, avg(x) AS a_x, avg(y) AS a_y FROM ft),
 gc AS (SELECT gr.pitcher, gr.balls, gr.strikes, cls, coalesce(n, 0) AS n, row_number() OVER (PARTITION BY gr.pitcher, gr.balls, gr.strikes ORDER BY coalesce(n, 0) DESC, cls) AS r FROM gr CROSS JOIN cl
  LEFT JOIN (SELECT pitcher, balls, strikes, y_id, count(*) AS n FROM ft GROUP BY ALL) k ON k.pitcher = gr.pitcher AND k.balls = gr.balls AND k.strikes = gr.strikes AND k.y_id = cls),
 gt AS (SELECT cls, coalesce(n, 0) AS n, row_number() OVER (ORDER BY coalesce(n, 0) DESC, cls) AS r FROM cl LEFT JOIN (SELECT y_id, count(*) AS n FROM ft GROUP BY y_id) k ON k.y_id = cls),
 em AS (SELECT va.*, CASE WHEN coalesce(gc.r, gt.r) = 1 THEN 1.0::DOUBLE ELSE 0 END AS hit1, CASE WHEN coalesce(gc.r, gt.r) <= 3 THEN 1.0::DOUBLE ELSE 0 END AS hit3,
  -ln((coalesce(gc.n, gt.n) + 1.0::DOUBLE) / (coalesce(tot, a_tot) + {T})) AS nll, (x - coalesce(m_x, a_x)) ** 2 + (y - coalesce(m_y, a_y)) ** 2 AS se
  FROM va LEFT JOIN gr USING (pitcher, balls, strikes) LEFT JOIN gc ON gc.pitcher = va.pitcher AND gc.balls = va.balls AND gc.strikes = va.strikes AND gc.cls = va.y_id JOIN gt ON gt.cls = va.y_id, ga)"""
SLICES = ["count_id", "pitch_bucket", "inning_bucket", "runners_state", "score_bucket", "stand_id", "throws_id"]


@query("slice_metrics", EMPIRICAL + " " + " UNION ALL ".join(f"SELECT '{s}' AS slice, CAST({'balls * 3 + strikes' if s == 'count_id' else s} AS BIGINT) AS value, count(*) AS n, round(avg(hit1), 6) AS acc, round(avg(hit3), 6) AS top3, round(avg(nll), 6) AS ce, round(sqrt(avg(se) / 2), 6) AS loc_rmse FROM em GROUP BY 2" for s in SLICES))
def slice_metrics(spark, sf):
    p = empirical(spark, sf, SLICES[1:]).withColumn("count_id", F.col("balls") * 3 + F.col("strikes"))
    s = metrics.slices(p, SLICES)
    return s.select("slice", "value", "n", *[F.round(x, 6).alias(x) for x in ("acc", "top3", "ce", "loc_rmse")]).orderBy(F.desc("n"), "slice", "value")


@query("outcome_metrics", f"""{LABELLED}, cl AS (SELECT unnest(generate_series(0, 12)) AS cls), gc AS (SELECT cls, coalesce(n, 0) AS n, row_number() OVER (ORDER BY coalesce(n, 0) DESC, cls) AS r FROM cl LEFT JOIN (SELECT outcome_id, count(*) AS n FROM lb WHERE split = 'train' GROUP BY outcome_id) ON outcome_id = cls)
 SELECT count(*) AS n, round(avg(CASE WHEN r = 1 THEN 1.0::DOUBLE ELSE 0 END), 6) AS acc, round(avg(CASE WHEN r <= 3 THEN 1.0::DOUBLE ELSE 0 END), 6) AS top3, round(avg(-ln((gc.n + 1.0::DOUBLE) / ((SELECT count(*) FROM lb WHERE split = 'train') + 13))), 6) AS ce FROM lb JOIN gc ON cls = outcome_id WHERE split = 'valid'""")
def outcome_metrics(spark, sf):
    p = written(labelled(spark, sf).select("x", "y_loc", F.col("outcome_id").alias("y"), "split"), "log")
    return baselines.evaluate(p.where("split = 'train'"), p.where("split = 'valid'"), [], 13).select("n", "acc", "top3", "ce")


@query("masked_state_accuracy", f"""{LG}, nx AS (SELECT *, CAST(lead(pa) OVER w IS NOT NULL AS INT) AS has, coalesce(lead(balls) OVER w, 0) AS nb, coalesce(lead(strikes) OVER w, 0) AS ns FROM lg WINDOW w AS (PARTITION BY game ORDER BY pa, seq))
 SELECT round(sum(CASE WHEN nb = least(balls + 1, 3) THEN has ELSE 0 END) / CAST(greatest(sum(has), 1) AS DOUBLE), 6) AS balls_acc, round(sum(CASE WHEN ns = least(strikes + 1, 2) THEN has ELSE 0 END) / CAST(greatest(sum(has), 1) AS DOUBLE), 6) AS strikes_acc FROM nx""")
def masked_state_accuracy(spark, sf):
    n = sequences.next_state(pitch_log(spark, sf))
    n = n.withColumn("hb", (F.col("y_next_balls") == F.least(F.col("balls") + 1, F.lit(3))).cast("int")).withColumn("hs", (F.col("y_next_strikes") == F.least(F.col("strikes") + 1, F.lit(2))).cast("int"))
    return n.agg(F.round(metrics.masked_mean("hb", "y_has_next"), 6).alias("balls_acc"), F.round(metrics.masked_mean("hs", "y_has_next"), 6).alias("strikes_acc"))


@query("mixture_nll", VS + """, mx AS (SELECT vec_id, k, v[k] AS pi, v[8 + 2 * k - 1] AS mx, v[8 + 2 * k] AS my, greatest(exp(v[24 + k]), 1e-3) AS sx, greatest(exp(v[32 + k]), 1e-3) AS sy,
  least(greatest(0.95::DOUBLE * tanh(v[40 + k]), -0.95), 0.95) AS rho, v[49] AS x, v[50] AS y FROM vs, (SELECT unnest(generate_series(1, 8)) AS k)),
 dn AS (SELECT vec_id, pi, pi - 0.5 * (((x - mx) / sx) ** 2 + ((y - my) / sy) ** 2 - 2 * rho * (x - mx) / sx * (y - my) / sy) / greatest(1 - rho * rho, 1e-3) - ln(sx) - ln(sy) - 0.5 * ln(greatest(1 - rho * rho, 1e-3)) - ln(2 * pi()) AS d FROM mx)
 SELECT vec_id, round(-(ln(sum(exp(d))) - ln(sum(exp(pi)))), 6) AS nll FROM dn GROUP BY vec_id""")
def mixture_nll(spark, sf):
    s = vector_scores(spark, sf)
    seq = lambda start, step=1: F.array(*[F.col("v")[start - 1 + step * k] for k in range(8)])
    d = V.mixture_log_density(F.col("v")[48], F.col("v")[49], seq(1), seq(9, 2), seq(10, 2), seq(25), seq(33), seq(41))
    return s.select("vec_id", F.round(-d, 6).alias("nll"))


@query("mixture_mean", VS + """, mx AS (SELECT vec_id, exp(v[k]) AS w, v[8 + 2 * k - 1] AS mx, v[8 + 2 * k] AS my FROM vs, (SELECT unnest(generate_series(1, 8)) AS k))
 SELECT vec_id, round(sum(w * mx) / sum(w), 6) AS mean_x, round(sum(w * my) / sum(w), 6) AS mean_y FROM mx GROUP BY vec_id""")
def mixture_mean(spark, sf):
    s = vector_scores(spark, sf)
    seq = lambda start, step=1: F.array(*[F.col("v")[start - 1 + step * k] for k in range(8)])
    return s.select("vec_id", F.round(V.mixture_mean(seq(1), seq(9, 2)), 6).alias("mean_x"), F.round(V.mixture_mean(seq(1), seq(10, 2)), 6).alias("mean_y"))


@query("gaussian_nll", VS + "SELECT vec_id, round(0.5 * ((v[49] - v[1]) / greatest(exp(v[2]), 1e-4)) ** 2 + ln(greatest(exp(v[2]), 1e-4)) + 0.5 * ln(2 * pi()), 6) AS nll FROM vs")
def gaussian_nll(spark, sf):
    v = F.col("v")
    return vector_scores(spark, sf).select("vec_id", F.round(V.gaussian_nll(v[48], v[0], v[1]), 6).alias("nll"))
