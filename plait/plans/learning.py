"""Fitted models: mixtures of places, traces that carry their loss, prediction from nested histories, a network of several heads."""

from __future__ import annotations

from pyspark.sql import functions as F

from plait.operators import features, heads, mixtures, network, sequences, simulation, splitting
from plait.plans.registry import query
from plait.plans.scoring import TOKENS, _ids, held_out_from
from plait.plans.simulating import OUTCOME_NAMES, STATES, contexts_sql, heads_table, played, rollout_sql
from plait.sources.scratch import written
from plait.sources.tables import pitch_log, pitch_rows

K, ROUNDS = 2, 3


def _mixture_sql(source, key, k=K, rounds=ROUNDS):
    """``m<rounds>``: as many iterations, one step after the other."""
    every = range(k)
    parts = [f"m0 AS (SELECT {key}, count(*) AS n, avg(x) AS gx, avg(y) AS gy, NULL::DOUBLE AS ll, greatest(stddev_pop(x), 1e-3) AS dx, greatest(stddev_pop(y), 1e-3) AS dy, "
             + ", ".join(f"{1 / k!r}::DOUBLE AS w{i}, avg(x) + greatest(stddev_pop(x), 1e-3) * {2 * (i + 0.5) / k - 1!r}::DOUBLE AS mx{i}, avg(y) + greatest(stddev_pop(y), 1e-3) * {0.5 * (-1) ** i!r}::DOUBLE AS my{i}, greatest(stddev_pop(x), 1e-3) AS sx{i}, greatest(stddev_pop(y), 1e-3) AS sy{i}, 0.0::DOUBLE AS rho{i}" for i in every)
             + f" FROM {source} GROUP BY {key})"]
    dens = lambda i: f"ln(w{i}) - 0.5 * (((x - mx{i}) / sx{i}) ** 2 + ((y - my{i}) / sy{i}) ** 2 - 2 * rho{i} * ((x - mx{i}) / sx{i}) * ((y - my{i}) / sy{i})) / (1 - rho{i} * rho{i}) - ln(sx{i}) - ln(sy{i}) - 0.5 * ln(1 - rho{i} * rho{i}) - ln(2 * pi())"
    for r in range(rounds):
        logs = ", ".join(f"{dens(i)} AS l{i}" for i in every)
        tops = f"greatest({', '.join(f'l{i}' for i in every)})"
        sums = ", ".join(f"sum(exp(l{i} - lse)) AS r{i}, sum(exp(l{i} - lse) * (x - gx)) AS x{i}, sum(exp(l{i} - lse) * (y - gy)) AS y{i}, sum(exp(l{i} - lse) * (x - gx) ** 2) AS xx{i}, sum(exp(l{i} - lse) * (y - gy) ** 2) AS yy{i}, sum(exp(l{i} - lse) * (x - gx) * (y - gy)) AS xy{i}" for i in every)
        new = ", ".join(f"greatest(r{i} / n, 1e-12) AS w{i}, gx + x{i} / r{i} AS mx{i}, gy + y{i} / r{i} AS my{i}, {{sx}} AS sx{i}, {{sy}} AS sy{i}, least(greatest((xy{i} / r{i} - x{i} / r{i} * (y{i} / r{i})) / ({{sx}} * {{sy}}), -0.95), 0.95) AS rho{i}".format(sx=f"greatest(sqrt(greatest(xx{i} / r{i} - (x{i} / r{i}) ** 2, 0)), 1e-3)", sy=f"greatest(sqrt(greatest(yy{i} / r{i} - (y{i} / r{i}) ** 2, 0)), 1e-3)") for i in every)
        parts.append(f"e{r} AS (SELECT *, {tops} + ln({' + '.join(f'exp(l{i} - {tops})' for i in every)}) AS lse FROM (SELECT s.x, s.y, m{r}.*, {logs} FROM {source} s JOIN m{r} ON m{r}.{key} = s.{key}))")
        parts.append(f"m{r + 1} AS (SELECT {key}, n, gx, gy, ll, {new} FROM (SELECT {key}, count(*) AS n, any_value(gx) AS gx, any_value(gy) AS gy, sum(lse) AS ll, {sums} FROM e{r} GROUP BY {key}))")
    return ", ".join(parts)


def settled(c):
    """Six digits of a mean that may lie half-way between two: noise of the sum's order, beyond nine digits, goes first."""
    return F.round(F.round(c, 9), 6)


def token_places(spark, sf):
    """(day, token_id, x, y) of the log, whose order plays no part here."""
    return pitch_rows(spark, sf).select("day", _ids("token", TOKENS).alias("token_id"), "x", "y")


def places(spark, sf, cut=None):
    """The mixture of each token's places in the training part; ``cut``: its boundary, where that is known already."""
    return mixtures.fit(splitting.before(token_places(spark, sf), cut or held_out_from(spark, sf)), ["token_id"], K, ROUNDS, 0.0)


@query("mixture_fit", f"{STATES}, {_mixture_sql('ft', 'token_id')} SELECT token_id, n, round(ll, 4) AS ll, " + ", ".join(f"round({c}{i}, 6) AS {c}_{i}" for i in range(K) for c in mixtures.PARTS) + f" FROM m{ROUNDS}")
def mixture_fit(spark, sf):
    return places(spark, sf).select("token_id", "n", F.round("ll", 4).alias("ll"), *[F.round(F.get(c, F.lit(i)), 6).alias(f"{c}_{i}") for i in range(K) for c in mixtures.PARTS])


_LOSS = f"-({{top}} + ln({' + '.join(f'exp(l{i} - {{top}})' for i in range(K))}))".format(top=f"greatest({', '.join(f'l{i}' for i in range(K))})")
_DENSITY = ", ".join(f"ln(w{i}) - 0.5 * (((x - mx{i}) / sx{i}) ** 2 + ((y - my{i}) / sy{i}) ** 2 - 2 * rho{i} * ((x - mx{i}) / sx{i}) * ((y - my{i}) / sy{i})) / (1 - rho{i} * rho{i}) - ln(sx{i}) - ln(sy{i}) - 0.5 * ln(1 - rho{i} * rho{i}) - ln(2 * pi()) AS l{i}" for i in range(K))


def _loss_sql(rows, key, keep):
    return f"SELECT {', '.join(keep)}, {_LOSS} AS loc_nll, {' + '.join(f'w{i} * mx{i}' for i in range(K))} AS loc_x, {' + '.join(f'w{i} * my{i}' for i in range(K))} AS loc_y FROM (SELECT r.*, m.* EXCLUDE (token_id, n), {_DENSITY} FROM {rows} r LEFT JOIN m{ROUNDS} m ON m.token_id = r.{key})"


@query("mixture_eval", f"{STATES}, {_mixture_sql('ft', 'token_id')}, ls AS ({_loss_sql('va', 'token_id', ['x', 'y'])}) SELECT count(*) AS n, round(avg(loc_nll), 6) AS loc_nll, round(sqrt(avg(((x - loc_x) ** 2 + (y - loc_y) ** 2) / 2)), 6) AS loc_rmse FROM ls")
def mixture_eval(spark, sf):
    cut = held_out_from(spark, sf)
    rows, params = splitting.since(token_places(spark, sf), cut), places(spark, sf, cut)
    s = mixtures.scored(rows, params, F.col("token_id") == F.col("_token_id"), K)
    se = F.pow(F.col("x") - F.col("loc_x"), 2) + F.pow(F.col("y") - F.col("loc_y"), 2)
    return s.agg(F.count("*").alias("n"), F.round(F.avg("loc_nll"), 6).alias("loc_nll"), F.round(F.sqrt(F.avg(se / 2)), 6).alias("loc_rmse"))


def traced(spark, sf):
    """The constrained rollout of the held-out events, with the loss of each actual place under the predicted token's mixture."""
    cut = held_out_from(spark, sf)
    return mixtures.scored(played(spark, sf, "constrained", held_out=True, cut=cut), places(spark, sf, cut), F.col("p_type") == F.col("_token_id"), K)


_F = simulation.FIELDS


@query("trace_records", f"""{rollout_sql('constrained', 'va')}, {_mixture_sql('ft', 'token_id')}, tr1 AS (SELECT cr.*, {', '.join(f'rp.{f} AS sim_{f}' for f in _F)}, rp.h_type AS p_type, rp.oc AS p_outcome, rp.mean_x, rp.mean_y, rp.pe, rp.nb, rp.ns FROM rp JOIN cr USING (game, i)),
 ls AS ({_loss_sql('tr1', 'p_type', ['game', 'pa', 'seq', 'token_id', 'x', 'y', *_F, *[f'sim_{f}' for f in _F], 'p_type', 'p_outcome', 'mean_x', 'mean_y', 'pe', 'nb', 'ns'])})
 SELECT game, pa, seq, {', '.join(f'sim_{f}, CAST(sim_{f} = {f} AS INT) AS match_{f}' for f in _F)}, CAST(p_type AS INT) AS p_type, CAST(p_outcome AS INT) AS p_outcome, round(mean_x, 6) AS p_x, round(mean_y, 6) AS p_y, round(loc_nll, 6) AS loc_nll,
 CAST(pe AS INT) AS p_pa_end, CAST(nb AS INT) AS p_balls, CAST(ns AS INT) AS p_strikes, CAST(p_type = token_id AS INT) AS top1, round((x - mean_x) ** 2 + (y - mean_y) ** 2, 6) AS loc_se FROM ls""")
def trace_records(spark, sf):
    t = traced(spark, sf)
    se = F.pow(F.col("x") - F.col("p_x"), 2) + F.pow(F.col("y") - F.col("p_y"), 2)
    both = [c for f in _F for c in (F.col(f"sim_{f}"), (F.col(f"sim_{f}") == F.col(f)).cast("int").alias(f"match_{f}"))]
    return t.select("game", "pa", "seq", *both, "p_type", "p_outcome", settled("p_x").alias("p_x"), settled("p_y").alias("p_y"), F.round("loc_nll", 6).alias("loc_nll"), "p_pa_end", "p_balls", "p_strikes", (F.col("p_type") == F.col("token_id")).cast("int").alias("top1"), F.round(se, 6).alias("loc_se"))


L = 4


def requests(spark, sf, cut=None):
    """The held-out events as prediction requests: raw context and the nested history of the session so far, no id encoded.  ``cut`` as in :func:`places`."""
    log = features.nested_history(pitch_log(spark, sf), L)
    return splitting.since(log, cut or held_out_from(spark, sf)).select("game", "pa", "seq", "day", "inning", "outs", "balls", "strikes", "score_diff", "on_1", "on_2", "on_3", "side", "pitcher", "batter", "history")


@query("predict_from_history", f"""{STATES}, {contexts_sql()} SELECT game, pa, seq, CAST(h_type AS INT) AS type_1, round((c_type[CAST(h_type AS INT) + 1] + 1.0::DOUBLE) / (n + 7), 6) AS prob_1, CAST(h_outcome AS INT) AS outcome_1,
 CAST(h_balls AS INT) AS next_balls, CAST(h_strikes AS INT) AS next_strikes, round((c_pa_end[2] + 1.0::DOUBLE) / (n_next + 2), 6) AS pa_end_prob, round(mean_x, 6) AS p_x, round(mean_y, 6) AS p_y FROM va JOIN tx0 USING (balls, strikes, prev_type, prev_outcome)""")
def predict_from_history(spark, sf):
    ids = [{x: i for i, x in enumerate(names, 1)} for names in (TOKENS, OUTCOME_NAMES[1:])]
    flat = dict.fromkeys([*features.CONTEXT, "x", "y"], (0.0, 1.0))
    cut = held_out_from(spark, sf)
    r = features.encoded(features.context(requests(spark, sf, cut)), features.Encoding(*ids, flat, L))
    p = heads.attach(r, heads_table(spark, sf, cut=cut))
    return p.select("game", "pa", "seq", heads.best("p_type").alias("type_1"), F.round(F.array_max("p_type"), 6).alias("prob_1"), heads.best("p_outcome").alias("outcome_1"), heads.best("p_balls").alias("next_balls"), heads.best("p_strikes").alias("next_strikes"), F.round(F.get("p_pa_end", F.lit(1)), 6).alias("pa_end_prob"), settled("p_x").alias("p_x"), settled("p_y").alias("p_y"))


def learning_rows(spark, sf):
    """Both parts of the log as a network's input with labels, and their encoding, which sees the training part alone."""
    cut = held_out_from(spark, sf)
    log = features.context(features.nested_history(sequences.next_state(pitch_log(spark, sf)), L))
    targets = ["y_has_next", *[y for y, _ in heads.STATE.values()]]
    log = written(log.select("game", "pa", "seq", "day", "token", "outcome", "x", "y", *features.CONTEXT, "history", *targets), "log")
    parts = [splitting.before(log, cut), splitting.since(log, cut)]
    e = features.fitted(parts[0], L)
    return e, [features.labelled(features.encoded(p, e), e) for p in parts]


def shape_of(e):
    return network.Shape(*e.sizes, e.history, len(features.CONTEXT))


@query("joint_training")
def joint_training(spark, sf):
    """Losses of each epoch."""
    e, (train, valid) = learning_rows(spark, sf)
    _, history = network.train(train, valid, shape_of(e), ["game", "pa", "seq"], epochs=3, batches=2)
    return spark.createDataFrame([tuple(float(h[c]) for c in _EPOCH) for h in history], ", ".join(f"{c} double" for c in _EPOCH))


_EPOCH = ["epoch", "train_loss", "valid_loss", "valid_ce", "valid_outcome_ce", "valid_loc_nll", "valid_state_loss", "valid_acc"]
