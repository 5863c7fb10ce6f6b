"""Profiles at ten grains, and the policies drawn from them."""

from __future__ import annotations

from pyspark.sql import functions as F

from plait.operators import baselines, clusters, profiles, sequences, splitting
from plait.plans.registry import query
from plait.plans.relational import BUCKETED, bucketed
from plait.plans.scoring import CUT_LOG, TOKENS, T, _case, _ids, held_out_from
from plait.sources.scratch import written
from plait.sources.tables import OUTCOMES, pitch_log, pitch_rows, vector_scores

NAMES = ["OOV", *TOKENS]


K, ROUNDS = 8, 2


def fitted_clusters(spark, sf):
    """(vec_id, cluster): each vector's nearest of the centres that Lloyd's rounds reach from the first vectors."""
    v = vector_scores(spark, sf).select("vec_id", "v")
    return clusters.assign(v, clusters.fit(v, clusters.first_rows(v, "vec_id", K), ROUNDS)).select("vec_id", "cluster")


def with_cluster(p, of):
    """Adds ``batter_cluster``; 0 for batters without a vector.  Batters take their vector round robin."""
    side = of.select(F.col("vec_id").alias("_v"), F.col("cluster").alias("_c"))
    n = of.count()
    side = F.broadcast(side) if n <= clusters.MOST else side
    return p.join(side, p["batter"] % max(n, 1) == F.col("_v"), "left").withColumn("batter_cluster", F.coalesce("_c", F.lit(0))).drop("_v", "_c")


def _lloyd(r):
    return f"""as{r} AS (SELECT v.vec_id, v.v, cluster FROM v, ce{r} QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY round(list_distance(v.v, ce{r}.c) ** 2, 9), cluster) = 1),
 ce{r + 1} AS (SELECT o.cluster, coalesce(m.c, o.c) AS c FROM ce{r} o LEFT JOIN (SELECT cluster, list(mean ORDER BY i) AS c FROM (SELECT cluster, i, avg(v[i]) AS mean FROM as{r}, (SELECT unnest(generate_series(1, 64)) AS i) GROUP BY cluster, i) GROUP BY cluster) m USING (cluster))"""


CLUSTERS_SQL = f"""v AS (SELECT vec_id, [CAST(e AS DOUBLE) FOR e IN embedding] AS v FROM embeddings),
 ce0 AS (SELECT CAST(row_number() OVER (ORDER BY vec_id) AS INT) AS cluster, v AS c FROM v QUALIFY row_number() OVER (ORDER BY vec_id) <= {K}), {', '.join(_lloyd(r) for r in range(ROUNDS))},
 cluster_of AS (SELECT v.vec_id, cluster FROM v, ce{ROUNDS} QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY round(list_distance(v.v, ce{ROUNDS}.c) ** 2, 9), cluster) = 1)"""


def profile_rows(spark, sf, by):
    """The held-out events with their bucketed context, the last type and outcome, a fitted batter cluster if the grain ``by`` has it, and as prediction the entity's smoothed shares and mean place of the training events.

    The log is written once with the columns of that grain, for all passes over its parts."""
    keys = profiles.GRAINS[by]
    clustered = "batter_cluster" in keys
    cut = held_out_from(spark, sf)
    p = bucketed(pitch_log(spark, sf))
    p = p.withColumn("token_id", _ids("token", TOKENS)).withColumn("outcome_id", _ids("outcome", OUTCOMES[:-1]))
    p = sequences.history(p, ["token_id", "outcome_id"], 4)
    p = p.withColumn("prev_type", sequences.last_nonzero([f"hist_token_id_{i}" for i in range(4)])).withColumn("prev_outcome", sequences.last_nonzero([f"hist_outcome_id_{i}" for i in range(4)]))
    p = p.withColumn("y_loc", F.col("y")).withColumn("y", F.col("token_id"))
    keep = ["day", "pitcher", *[k for k in keys if k != "batter_cluster"], *(["batter"] if clustered else []), "y", "x", "y_loc"]
    p = written(p.select(*dict.fromkeys(keep)), "log")
    valid = splitting.since(p, cut)
    j = baselines.predicted(splitting.before(p, cut), with_cluster(valid, fitted_clusters(spark, sf)) if clustered else valid, ["pitcher"], T)
    return j.withColumn("probs", F.transform("c", lambda x: (x + 1.0) / F.col("denominator"))).withColumn("pred_x", F.col("m_x")).withColumn("pred_y", F.col("m_y"))


_PROB = ", ".join(f"avg((n_{i} + 1.0::DOUBLE) / (tot + {T})) AS pred_prob_{t}, avg(CASE WHEN token_id = {i} THEN 1.0::DOUBLE ELSE 0 END) AS emp_prob_{t}" for i, t in enumerate(NAMES))
_CE = " ".join(f"- emp_prob_{t} * ln(least(greatest(pred_prob_{t}, 1e-12), 1))" for t in NAMES)
_ROUND = ", ".join(f"round({x}_{t}, 9) AS {x}_{t}" for t in NAMES for x in ("pred_prob", "emp_prob"))
PROFILED = f"""{BUCKETED}, {CUT_LOG}, {CLUSTERS_SQL}, pi AS (SELECT *, {_case('token', TOKENS)} AS token_id, {_case('outcome', OUTCOMES[:-1])} AS outcome_id FROM bk),
 ph AS (SELECT *, coalesce({', '.join(f'nullif(lag(token_id, {i}) OVER w, 0)' for i in range(1, 5))}, 0) AS prev_type,
 coalesce({', '.join(f'nullif(lag(outcome_id, {i}) OVER w, 0)' for i in range(1, 5))}, 0) AS prev_outcome FROM pi WINDOW w AS (PARTITION BY game, pa ORDER BY seq)),
 ft AS (SELECT ph.* FROM ph, ct WHERE day < valid_from), va AS (SELECT ph.* FROM ph, ct WHERE day >= valid_from),
 pp AS (SELECT pitcher, count(*) AS tot, avg(x) AS pred_x, avg(y) AS pred_y, {', '.join(f'count(*) FILTER (token_id = {i}) AS n_{i}' for i in range(T))} FROM ft GROUP BY pitcher),
 pg AS (SELECT count(*) AS tot, avg(x) AS pred_x, avg(y) AS pred_y, {', '.join(f'count(*) FILTER (token_id = {i}) AS n_{i}' for i in range(T))} FROM ft),
 pr AS (SELECT va.*, {', '.join(f'coalesce(pp.{c}, pg.{c}) AS {c}' for c in ('tot', 'pred_x', 'pred_y', *(f'n_{i}' for i in range(T))))}, coalesce(cluster, 0) AS batter_cluster
  FROM va LEFT JOIN pp USING (pitcher) LEFT JOIN cluster_of e ON e.vec_id = batter % (SELECT count(*) FROM embeddings), pg)"""


def _grouped(keys, min_n=25):
    k = ", ".join(keys)
    return f"SELECT {k}, count(*) AS n, {_PROB}, avg(pred_x) AS pred_plate_x, avg(pred_y) AS pred_plate_y, avg(x) AS emp_plate_x, avg(y) AS emp_plate_y FROM pr GROUP BY {k} HAVING count(*) >= {min_n}"


def _min_n(by):
    return 25 if by == "pitcher" else 2


for _by, _keys in profiles.GRAINS.items():

    @query(f"profile_{_by}", f"{PROFILED}, pq AS ({_grouped(_keys, _min_n(_by))}) SELECT {', '.join(_keys)}, n, {_ROUND}, round(pred_plate_x, 9) AS pred_plate_x, round(pred_plate_y, 9) AS pred_plate_y, round(emp_plate_x, 9) AS emp_plate_x, round(emp_plate_y, 9) AS emp_plate_y, round(0 {_CE}, 9) AS type_ce_group FROM pq")
    def profile(spark, sf, by=_by, keys=tuple(_keys)):
        out = profiles.profile(profile_rows(spark, sf, by), by, list(TOKENS), _min_n(by))
        return out.select(*keys, "n", *[F.round(c, 9).alias(c) for c in out.columns if c not in (*keys, "n")]).orderBy(*keys)


POLICY = f"{PROFILED}, pq AS ({_grouped(profiles.GRAINS['pitcher_count'], 2)})"
_SHARES = [f"{x}_{t}" for x in ("pred_prob", "emp_prob") for t in NAMES]


@query("profile_cross_entropy", f"{PROFILED}, pq AS ({_grouped(['pitcher'])}) SELECT round(sum((0 {_CE}) * n) / sum(n), 6) AS weighted_ce FROM pq")
def profile_cross_entropy(spark, sf):
    p = profiles.profile(profile_rows(spark, sf, "pitcher"), "pitcher", list(TOKENS))
    return p.agg(F.round(F.try_divide(F.sum(F.col("type_ce_group") * F.col("n")), F.sum("n")), 6).alias("weighted_ce"))


@query("weighted_policy", f"{POLICY} SELECT balls, strikes, CAST(sum(n) AS BIGINT) AS n, " + ", ".join(f"round(sum({c} * n) / sum(n), 9) AS {c}" for c in _SHARES) + " FROM pq GROUP BY balls, strikes")
def weighted_policy(spark, sf):
    p = profiles.profile(profile_rows(spark, sf, "pitcher_count"), "pitcher_count", list(TOKENS), 2)
    w = profiles.weighted_shares(p, ["balls", "strikes"], _SHARES)
    return w.select("balls", "strikes", "n", *[F.round(c, 9).alias(c) for c in _SHARES])


@query("count_policy_grid", f"{POLICY}, wp AS (SELECT balls, strikes, CAST(sum(n) AS BIGINT) AS n, " + ", ".join(f"round(sum(emp_prob_{t} * n) / sum(n), 6) AS emp_prob_{t}" for t in TOKENS) + f""" FROM pq GROUP BY balls, strikes),
 lg2 AS (UNPIVOT (SELECT balls, strikes, n, {', '.join(f'emp_prob_{t}' for t in TOKENS)} FROM wp) ON {', '.join(f'emp_prob_{t}' for t in TOKENS)} INTO NAME token VALUE p)
 SELECT balls, strikes, n, replace(token, 'emp_prob_', '') AS token, p FROM lg2 QUALIFY row_number() OVER (PARTITION BY balls, strikes ORDER BY p DESC, token) = 1""")
def count_policy_grid(spark, sf):
    p = profiles.profile(profile_rows(spark, sf, "pitcher_count"), "pitcher_count", list(TOKENS), 2)
    w = profiles.weighted_shares(p, ["balls", "strikes"], [f"emp_prob_{t}" for t in TOKENS])
    pairs = F.array(*[F.struct((-F.round(f"emp_prob_{t}", 6)).alias("neg"), F.lit(t).alias("token")) for t in TOKENS])
    best = F.array_min(pairs)
    return w.select("balls", "strikes", "n", best["token"].alias("token"), (-best["neg"]).alias("p"))


@query("top_usage", f"{PROFILED}, us AS (SELECT token, count(*) AS n FROM ph WHERE token_id > 0 GROUP BY token) SELECT token, n FROM us ORDER BY n DESC, token LIMIT 2")
def top_usage(spark, sf):
    return pitch_rows(spark, sf).groupBy("token").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "token").limit(2)


@query("kde_heatmap", f"""{PROFILED}, pq AS ({_grouped(['pitcher'])}), gr AS (SELECT i, j, -2.0::DOUBLE + i * (4.0::DOUBLE / 41) AS gx, 0.5::DOUBLE + j * (4.0::DOUBLE / 41) AS gy FROM (SELECT unnest(generate_series(0, 41)) AS i), (SELECT unnest(generate_series(0, 41)) AS j))
 SELECT CAST(i AS INT) AS i, CAST(j AS INT) AS j, round(sum(n * exp(-((gx - emp_plate_x) ** 2 + (gy - emp_plate_y) ** 2) / (2 * 0.22::DOUBLE * 0.22))), 4) AS heat FROM pq, gr GROUP BY 1, 2""")
def kde_heatmap(spark, sf):
    p = profiles.profile(profile_rows(spark, sf, "pitcher"), "pitcher", list(TOKENS)).select(F.col("n").cast("double").alias("n"), "emp_plate_x", "emp_plate_y")
    return profiles.heat_map(p, "n", "emp_plate_x", "emp_plate_y", 42, (-2.0, 0.5), (2.0, 4.5), 0.22).withColumn("heat", F.round("heat", 4))
