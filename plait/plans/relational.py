"""Scans, filters, derived columns, encoding, split, statistics and windows."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from plait.functions import columns as X
from plait.operators import encoding, prepare, sequences, splitting
from plait.plans.registry import query
from plait.sources import feed
from plait.sources.chunks import date_chunks
from plait.sources.tables import PITCH_SQL, USER_SQL, optional, pitch_log, pitch_rows, table, user_log

LG, EV = f"WITH {PITCH_SQL} ", f"WITH {USER_SQL} "
KEY = ["game", "pa", "seq"]
LINE = ["game", "pa", "line"]  # where no sequence number is needed


@query("scan_events", "SELECT event_id, user_id, event_type, value FROM events")
def scan_events(spark, sf):
    return table(spark, sf, "events").select("event_id", "user_id", "event_type", "value")


@query("union_chunks", "SELECT event_id, value FROM events WHERE event_id % 3 = 0 UNION ALL SELECT event_id, value FROM events WHERE event_id % 3 <> 0")
def union_chunks(spark, sf):
    e = table(spark, sf, "events").select("event_id", "value")
    return e.where("event_id % 3 = 0").unionByName(e.where("event_id % 3 <> 0"))


@query("date_chunks", """SELECT strftime(d, '%Y-%m-%d') AS chunk_start, strftime(least(d + INTERVAL 6 DAY, TIMESTAMP '2024-03-05'), '%Y-%m-%d') AS chunk_end
 FROM (SELECT unnest(generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-03-05', INTERVAL 7 DAY)) AS d)""")
def chunks(spark, sf):
    return date_chunks(spark, "2024-01-01", "2024-03-05", 7).select(*[F.date_format(x, "yyyy-MM-dd").alias(x) for x in ("chunk_start", "chunk_end")])


@query("filter_date_range", EV + "SELECT event_id, day FROM ev WHERE day BETWEEN DATE '2024-01-05' AND DATE '2024-01-20'")
def filter_date_range(spark, sf):
    d = X.lenient_date("day")
    return user_log(spark, sf).where(d.isNotNull() & d.between("2024-01-05", "2024-01-20")).select("event_id", d.alias("day"))


@query("filter_not_null", LG + "SELECT game, pa, line, token FROM lg WHERE token IS NOT NULL AND stand IS NOT NULL AND throws IS NOT NULL AND on_1 IS NOT NULL")
def filter_not_null(spark, sf):
    return pitch_rows(spark, sf).where(" and ".join(f"{x} is not null" for x in ("token", "stand", "throws", "on_1"))).select(*LINE, "token")


@query("case_encode", LG + """SELECT game, pa, line, CASE side WHEN 'Bot' THEN 1 ELSE 0 END AS side_id,
 CASE stand WHEN 'R' THEN 1 WHEN 'L' THEN 2 WHEN 'S' THEN 3 ELSE 0 END AS stand_id, CASE throws WHEN 'R' THEN 1 WHEN 'L' THEN 2 ELSE 0 END AS throws_id FROM lg""")
def case_encode(spark, sf):
    e = lambda x, v: X.coded(x, v).cast("int").alias(f"{x}_id")
    return pitch_rows(spark, sf).select(*LINE, e("side", X.SIDES), e("stand", X.STANDS), e("throws", X.THROWS))


@query("null_indicator", LG + "SELECT game, pa, line, CAST(on_1 IS NOT NULL AS INT) AS on_1_occ, CAST(on_2 IS NOT NULL AS INT) AS on_2_occ, CAST(on_3 IS NOT NULL AS INT) AS on_3_occ FROM lg")
def null_indicator(spark, sf):
    return pitch_rows(spark, sf).select(*LINE, *[X.occupied(b).cast("int").alias(f"{b}_occ") for b in ("on_1", "on_2", "on_3")])


@query("derived_features", LG + "SELECT game, pa, line, score_diff - outs AS lead_diff, coalesce(stand, '<NULL>') AS stand_token, CAST(pitcher AS VARCHAR) AS pitcher_token, CAST(batter AS VARCHAR) AS batter_token FROM lg")
def derived_features(spark, sf):
    p = pitch_rows(spark, sf)
    return p.select(*LINE, (F.col("score_diff") - F.col("outs")).cast("smallint").cast("int").alias("lead_diff"), F.coalesce("stand", F.lit("<NULL>")).alias("stand_token"), *[F.col(x).cast("bigint").cast("string").alias(f"{x}_token") for x in ("pitcher", "batter")])


_BUCKETS = """CASE WHEN inning <= 3 THEN 0 WHEN inning <= 6 THEN 1 WHEN inning <= 8 THEN 2 ELSE 3 END AS inning_bucket,
 least(greatest(score_diff, -3), 3) + 3 AS score_bucket, CASE WHEN seq <= 1 THEN 0 WHEN seq = 2 THEN 1 WHEN seq = 3 THEN 2 ELSE 3 END AS pitch_bucket,
 CASE WHEN on_1 > 0 THEN 1 ELSE 0 END + 2 * CASE WHEN on_2 > 0 THEN 1 ELSE 0 END + 4 * CASE WHEN on_3 > 0 THEN 1 ELSE 0 END AS runners_state"""
BUCKETED = f"{LG}, bk AS (SELECT *, {_BUCKETS}, CASE stand WHEN 'R' THEN 1 WHEN 'L' THEN 2 WHEN 'S' THEN 3 ELSE 0 END AS stand_id, CASE throws WHEN 'R' THEN 1 WHEN 'L' THEN 2 ELSE 0 END AS throws_id FROM lg) "


def bucketed(p):
    return p.withColumns({
        "inning_bucket": X.inning_bucket("inning"), "score_bucket": X.score_bucket("score_diff"), "pitch_bucket": X.pitch_number_bucket("seq"),
        "runners_state": X.runners("on_1", "on_2", "on_3"), "stand_id": X.coded("stand", X.STANDS).cast("int"), "throws_id": X.coded("throws", X.THROWS).cast("int"),
    })


@query("buckets", BUCKETED + "SELECT game, pa, seq, inning_bucket, score_bucket, pitch_bucket, runners_state FROM bk")
def buckets(spark, sf):
    return bucketed(pitch_log(spark, sf)).select(*KEY, "inning_bucket", "score_bucket", "pitch_bucket", "runners_state")


@query("bitmask_decode", BUCKETED + "SELECT game, pa, seq, runners_state & 1 AS b1, (runners_state >> 1) & 1 AS b2, (runners_state >> 2) & 1 AS b3, CASE inning_bucket WHEN 0 THEN '1-3' WHEN 1 THEN '4-6' WHEN 2 THEN '7-8' ELSE '9+' END AS inning_label FROM bk")
def bitmask_decode(spark, sf):
    b = bucketed(pitch_log(spark, sf))
    bit = lambda i: F.shiftright("runners_state", i).bitwiseAND(F.lit(1)).alias(f"b{i + 1}")
    return b.select(*KEY, bit(0), bit(1), bit(2), X.label("inning_bucket", X.INNINGS).alias("inning_label"))


@query("bases_string", BUCKETED + "SELECT DISTINCT runners_state, coalesce(nullif(concat_ws('-', CASE WHEN runners_state & 1 > 0 THEN '1' END, CASE WHEN runners_state & 2 > 0 THEN '2' END, CASE WHEN runners_state & 4 > 0 THEN '3' END), ''), '-') AS bases FROM bk")
def bases_string(spark, sf):
    return bucketed(pitch_log(spark, sf)).select("runners_state").distinct().select("runners_state", X.bases_text("runners_state").alias("bases"))


@query("safe_token", "SELECT p_partkey, regexp_replace(p_brand || ' ' || p_type, '[^A-Za-z0-9]', '_', 'g') AS name FROM part")
def safe_token(spark, sf):
    return table(spark, sf, "part").select("p_partkey", X.safe_token(F.concat("p_brand", F.lit(" "), "p_type")).alias("name"))


@query("pack_unpack_key", LG + "SELECT game, pa, line, ((CAST(pitcher AS BIGINT) * 4 + balls) * 3 + strikes) * 10 + outs AS packed, pitcher AS k_pitcher, balls AS k_balls, strikes AS k_strikes, outs AS k_outs FROM lg")
def pack_unpack_key(spark, sf):
    p = pitch_rows(spark, sf).withColumn("packed", X.packed_key([("pitcher", 0), ("balls", 4), ("strikes", 3), ("outs", 10)]))
    names = ("k_pitcher", "k_balls", "k_strikes", "k_outs")
    return p.select(*LINE, "packed", *[e.cast("bigint").alias(n) for n, e in zip(names, X.unpacked_key("packed", [4, 3, 10]))])


@query("html_escape", """SELECT page_id, replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;') AS escaped FROM pages""")
def html_escape(spark, sf):
    return table(spark, sf, "pages").select("page_id", X.html_escaped("html").alias("escaped"))


@query("events_json_props", EV + "SELECT event_id, k FROM ev WHERE k IS NOT NULL")
def events_json_props(spark, sf):
    parsed = F.from_json("props", "k bigint", {"mode": "FAILFAST"})
    return table(spark, sf, "events").select("event_id", parsed["k"].alias("k")).where("k is not null")


@query("load_entity", LG + "SELECT game, pa, seq, token, outcome FROM lg WHERE game = 7")
def load_entity(spark, sf):
    return pitch_log(spark, sf, game=7).select(*KEY, "token", "outcome")


@query("distinct_entities", "SELECT DISTINCT l_orderkey // 16 AS game FROM lineitem")
def distinct_entities(spark, sf):
    return table(spark, sf, "lineitem").select(F.expr("l_orderkey div 16").alias("game")).distinct()


@query("first_n_entities", "SELECT DISTINCT l_orderkey // 16 AS game FROM lineitem ORDER BY 1 LIMIT 5")
def first_n_entities(spark, sf):
    return distinct_entities(spark, sf).orderBy("game").limit(5)


@query("batch_count", "SELECT count(*) AS n_rows, CAST(ceil(count(*) / 4096.0) AS BIGINT) AS n_batches FROM lineitem")
def batch_count(spark, sf):
    return table(spark, sf, "lineitem").agg(F.count("*").alias("n_rows"), F.ceil(F.count("*") / F.lit(4096.0)).cast("bigint").alias("n_batches"))


@query("count_by_day", EV + "SELECT day, count(*) AS n FROM ev GROUP BY day")
def count_by_day(spark, sf):
    return splitting.rows_per_day(user_log(spark, sf))


CUT = """dy AS (SELECT day, count(*) AS n FROM ev GROUP BY day),
 pf AS (SELECT day, sum(n) OVER (ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before, sum(n) OVER () AS total FROM dy),
 sc AS (SELECT day, round(abs((total - before) / total::DOUBLE - 0.1), 9) AS error FROM pf WHERE before IS NOT NULL),
 ct AS (SELECT day AS valid_from, error FROM sc ORDER BY error, day LIMIT 1)"""


@query("time_split_boundary", f"{EV}, {CUT} SELECT valid_from, error FROM ct")
def time_split_boundary(spark, sf):
    return splitting.boundary(user_log(spark, sf), 0.1)


@query("time_split", f"{EV}, {CUT} SELECT event_id, CASE WHEN day < valid_from THEN 'train' ELSE 'valid' END AS split FROM ev, ct")
def time_split(spark, sf):
    return splitting.split(user_log(spark, sf), 0.1).select("event_id", "split")


TRAIN = CUT.replace("FROM ev", "FROM lg") + ", tr AS (SELECT lg.* FROM lg, ct WHERE day < valid_from)"


def _train(spark, sf):
    return splitting.training(pitch_rows(spark, sf), 0.1)


VOCAB_FIELDS = ["token", "outcome", "pitcher", "batter"]
COUNTS = TRAIN + """, tc AS (SELECT field, token, count(*) AS n FROM (SELECT 'token' AS field, token FROM tr UNION ALL SELECT 'outcome', outcome FROM tr
 UNION ALL SELECT 'pitcher', CAST(pitcher AS VARCHAR) FROM tr UNION ALL SELECT 'batter', CAST(batter AS VARCHAR) FROM tr) WHERE token IS NOT NULL GROUP BY field, token)"""
VOCAB = COUNTS + ", vc AS (SELECT field, token, n, row_number() OVER (PARTITION BY field ORDER BY n DESC, token) AS id FROM tc WHERE n >= 30)"


def _vocab(spark, sf):
    return encoding.vocabulary(encoding.token_counts(_train(spark, sf), VOCAB_FIELDS), 30)


@query("token_counts", f"{LG}, {COUNTS} SELECT field, token, n FROM tc")
def token_counts(spark, sf):
    return encoding.token_counts(_train(spark, sf), VOCAB_FIELDS)


@query("vocab_ids", f"{LG}, {VOCAB} SELECT field, token, n, id FROM vc")
def vocab_ids(spark, sf):
    return _vocab(spark, sf)


@query("dict_encode_join", f"""{LG}, {VOCAB} SELECT game, pa, line, coalesce(a.id, 0) AS token_id, coalesce(b.id, 0) AS outcome_id, coalesce(c.id, 0) AS pitcher_id, coalesce(d.id, 0) AS batter_id
 FROM lg LEFT JOIN vc a ON a.field = 'token' AND a.token = lg.token LEFT JOIN vc b ON b.field = 'outcome' AND b.token = lg.outcome
 LEFT JOIN vc c ON c.field = 'pitcher' AND c.token = CAST(pitcher AS VARCHAR) LEFT JOIN vc d ON d.field = 'batter' AND d.token = CAST(batter AS VARCHAR)""")
def dict_encode_join(spark, sf):
    return encoding.encode(pitch_rows(spark, sf), _vocab(spark, sf), VOCAB_FIELDS).select(*LINE, *[f"{x}_id" for x in VOCAB_FIELDS])


@query("dict_decode_join", f"{LG}, {VOCAB} SELECT game, pa, line, strikes * 4 + balls AS code, coalesce(vc.token, '<OOV>') AS decoded FROM lg LEFT JOIN vc ON field = 'token' AND id = strikes * 4 + balls")
def dict_decode_join(spark, sf):
    p = pitch_rows(spark, sf).withColumn("code", F.col("strikes") * 4 + F.col("balls"))
    return encoding.decode(p, _vocab(spark, sf), "token", "code", "decoded").select(*LINE, "code", "decoded")


@query("oov_rows_anti", f"{LG}, {VOCAB} SELECT game, pa, line, batter FROM lg WHERE CAST(batter AS VARCHAR) NOT IN (SELECT token FROM vc WHERE field = 'batter')")
def oov_rows_anti(spark, sf):
    v = encoding.small(_vocab(spark, sf).where("field = 'batter'").select("token"))
    p = pitch_rows(spark, sf)
    return p.join(v.withColumnRenamed("token", "_t"), p["batter"].cast("string") == F.col("_t"), "left_anti").select(*LINE, "batter")


@query("in_vocab_semi", f"{LG}, {VOCAB} SELECT game, pa, line, batter FROM lg WHERE CAST(batter AS VARCHAR) IN (SELECT token FROM vc WHERE field = 'batter')")
def in_vocab_semi(spark, sf):
    v = encoding.small(_vocab(spark, sf).where("field = 'batter'").select("token"))
    p = pitch_rows(spark, sf)
    return p.join(v.withColumnRenamed("token", "_t"), p["batter"].cast("string") == F.col("_t"), "left_semi").select(*LINE, "batter")


@query("optional_columns", "SELECT event_id, CAST(user_id AS VARCHAR) AS user_id, CAST(NULL AS DOUBLE) AS spin, event_type FROM events")
def optional_columns(spark, sf):
    return optional(table(spark, sf, "events"), {"event_id": "bigint", "user_id": "string", "spin": "double", "event_type": "string"})


@query("truncated_features", "SELECT event_id, CASE WHEN value IS NULL OR isnan(value) THEN 0 ELSE CAST(trunc(value) AS BIGINT) END AS value_int, CASE WHEN value IS NULL OR isnan(value) THEN 0 ELSE CAST(trunc(-2.5 * value) AS BIGINT) END AS scaled_int FROM events")
def truncated_features(spark, sf):
    return table(spark, sf, "events").select("event_id", X.truncated("value").alias("value_int"), X.truncated(F.col("value") * -2.5).alias("scaled_int"))


@query("batch_feed")
def batch_feed(spark, sf):
    """One shuffled epoch of lineitem in batches of 1024: rows of each batch, and what its function sums up."""
    rows = feed.placed(spark, f"{sf}/lineitem.parquet", ["l_orderkey", "l_quantity"], 1024, seed=7, block=4096)
    total = lambda t: pa.table({"batch": t.column("batch").slice(0, 1), "n": [t.num_rows], "first_key": t.column("l_orderkey").slice(0, 1), "quantity": [float(sum(t.column("l_quantity").to_pylist()))]})
    return feed.map_batches(rows, total, "batch long, n long, first_key long, quantity double")


STATS = ["balls", "strikes", "outs", "inning", "score_diff"]


@query("feature_stats", f"{LG}, {TRAIN} SELECT " + ", ".join(f"round(avg({c}), 6) AS {c}_mean, round(coalesce(nullif(stddev_samp({c}), 0), 1), 6) AS {c}_std" for c in STATS) + " FROM tr")
def feature_stats(spark, sf):
    s = splitting.feature_stats(_train(spark, sf), STATS)
    return s.select(*[F.round(x, 6).alias(x) for x in s.columns])


@query("zscore", f"{LG}, {TRAIN}, st AS (SELECT " + ", ".join(f"avg({c}) AS {c}_m, coalesce(nullif(stddev_samp({c}), 0), 1) AS {c}_s" for c in STATS) + " FROM tr) SELECT game, pa, line, " + ", ".join(f"round(({c} - {c}_m) / {c}_s, 6) AS {c}_z" for c in STATS) + " FROM lg, st")
def zscore(spark, sf):
    p = pitch_rows(spark, sf)
    z = splitting.standardised(p, splitting.feature_stats(_train(spark, sf), STATS), STATS)
    return z.select(*LINE, *[F.round(f"{x}_z", 6).alias(f"{x}_z") for x in STATS])


@query("lag_history", LG + "SELECT game, pa, seq, " + ", ".join(f"coalesce(lag(balls, {4 - i}) OVER w, 0) AS hist_balls_{i}, coalesce(lag(score_diff, {4 - i}) OVER w, 0) AS hist_score_diff_{i}" for i in range(4)) + " FROM lg WINDOW w AS (PARTITION BY game, pa ORDER BY seq)")
def lag_history(spark, sf):
    h = sequences.history(pitch_log(spark, sf), ["balls", "score_diff"], 4)
    return h.select(*KEY, *[f"hist_{f}_{i}" for f in ("balls", "score_diff") for i in range(4)])


NEXT = """nx AS (SELECT *, CAST(lead(pa) OVER w IS NOT NULL AS INT) AS y_has_next,
 CASE WHEN lead(pa) OVER w IS NULL THEN 1 ELSE CAST(lead(pa) OVER w <> pa AS INT) END AS y_pa_end,
 least(greatest(coalesce(lead(balls) OVER w, 0), 0), 3) AS y_next_balls, least(greatest(coalesce(lead(strikes) OVER w, 0), 0), 2) AS y_next_strikes,
 least(greatest(coalesce(lead(outs) OVER w, 0), 0), 2) AS y_next_outs,
 coalesce(lead(CAST(on_1 IS NOT NULL AS INT)) OVER w, 0) AS y_next_on_1, coalesce(lead(CAST(on_2 IS NOT NULL AS INT)) OVER w, 0) AS y_next_on_2,
 coalesce(lead(CAST(on_3 IS NOT NULL AS INT)) OVER w, 0) AS y_next_on_3, coalesce(lead(CASE WHEN side = 'Bot' THEN 1 ELSE 0 END) OVER w, 0) AS y_next_side,
 least(greatest(coalesce(lead(inning) OVER w, inning) - inning, 0), 1) AS y_inning_delta,
 least(greatest(coalesce(lead(score_diff) OVER w, score_diff) - score_diff, -4), 4) + 4 AS y_score_delta
 FROM lg WINDOW w AS (PARTITION BY game ORDER BY pa, seq))"""
TARGETS = list(prepare.TARGETS)


@query("next_state", f"{LG}, {NEXT} SELECT game, pa, seq, {', '.join(TARGETS)} FROM nx")
def next_state(spark, sf):
    return sequences.next_state(pitch_log(spark, sf)).select(*KEY, *TARGETS)


@query("last_nonzero", LG + "SELECT game, pa, seq, coalesce(nullif(lag(balls, 1) OVER w, 0), nullif(lag(balls, 2) OVER w, 0), nullif(lag(balls, 3) OVER w, 0), 0) AS prev FROM lg WINDOW w AS (PARTITION BY game, pa ORDER BY seq)")
def last_nonzero(spark, sf):
    h = sequences.history(pitch_log(spark, sf), ["balls"], 3)
    return h.select(*KEY, sequences.last_nonzero([f"hist_balls_{i}" for i in range(3)]).alias("prev"))


@query("entity_initial_state", LG + "SELECT game, pa, seq, balls, strikes, outs, inning, score_diff FROM lg QUALIFY row_number() OVER (PARTITION BY game ORDER BY pa, seq) = 1")
def entity_initial_state(spark, sf):
    first = pitch_log(spark, sf).groupBy("game").agg(F.min_by(F.struct("pa", "seq", "balls", "strikes", "outs", "inning", "score_diff"), F.struct("pa", "seq")).alias("s"))
    return first.select("game", "s.*")


@query("sessionize", "SELECT event_id, CAST(sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS BIGINT) AS session FROM (SELECT event_id, user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w > INTERVAL 6 HOUR THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts))")
def sessionize(spark, sf):
    return sequences.sessions(table(spark, sf, "events"), "user_id", "ts", 6 * 3600).select("event_id", "session")


@query("limit_per_group", LG + "SELECT game, pa, seq, token FROM lg WHERE seq <= 3")
def limit_per_group(spark, sf):
    return pitch_log(spark, sf).where("seq <= 3").select(*KEY, "token")


_HIST = ", ".join(f"coalesce(lag({c}, {8 - i}) OVER w, 0) AS hist_{c}_{i}" for c in ("token_id", "outcome_id", "x", "y") for i in range(8))


@query("feature_matrix", f"""{LG}, {VOCAB}, {NEXT}, en AS (SELECT nx.*, coalesce(a.id, 0) AS token_id, coalesce(b.id, 0) AS outcome_id, coalesce(c.id, 0) AS pitcher_id, coalesce(d.id, 0) AS batter_id
 FROM nx LEFT JOIN vc a ON a.field = 'token' AND a.token = nx.token LEFT JOIN vc b ON b.field = 'outcome' AND b.token = nx.outcome
 LEFT JOIN vc c ON c.field = 'pitcher' AND c.token = CAST(pitcher AS VARCHAR) LEFT JOIN vc d ON d.field = 'batter' AND d.token = CAST(batter AS VARCHAR))
 SELECT game, pa, seq, pitcher_id, batter_id, token_id, outcome_id, x, y, balls, strikes, outs, inning, score_diff, {', '.join(TARGETS)}, {_HIST} FROM en WINDOW w AS (PARTITION BY game, pa ORDER BY seq)""")
def feature_matrix(spark, sf):
    return prepare.assemble(pitch_log(spark, sf), _vocab(spark, sf), 8)


@query("range_guard", LG + "SELECT min(balls) AS balls_min, max(balls) AS balls_max, min(strikes) AS strikes_min, max(strikes) AS strikes_max, min(outs) AS outs_min, max(outs) AS outs_max FROM lg")
def range_guard(spark, sf):
    return pitch_rows(spark, sf).agg(*[f(x).alias(f"{x}_{n}") for x in ("balls", "strikes", "outs") for n, f in (("min", F.min), ("max", F.max))])


@query("conversation_history", "SELECT conv_id, turn, role, coalesce(lag(role, 1) OVER w, '') AS prev_role, CAST(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS BIGINT) AS chars_so_far FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)")
def conversation_history(spark, sf):
    w = Window.partitionBy("conv_id").orderBy("turn")
    return table(spark, sf, "conversations").select("conv_id", "turn", "role", F.coalesce(F.lag("role").over(w), F.lit("")).alias("prev_role"), F.sum(F.length("text")).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("chars_so_far"))
