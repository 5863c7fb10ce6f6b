"""Tables, and the adapters that give them the roles of an ordered event log.

An event log has an entity (``game``), a session in it (``pa``), an order (``seq``), a day, a token, an outcome and
context columns.  Each adapter comes with the same definition as DuckDB SQL, for the oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def optional(rows: DataFrame, wanted: dict[str, str]) -> DataFrame:
    """The columns of ``wanted`` (name to type), in its order: cast where ``rows`` has them, null where not."""
    return rows.select(*[(F.col(f"`{n}`") if n in rows.columns else F.lit(None)).cast(t).alias(n) for n, t in wanted.items()])


#: Outcome tokens in the order of the adapter's code; code 12 is a token no rule knows.
OUTCOMES = ("ball", "blocked_ball", "pitchout", "hit_by_pitch", "hit_into_play", "called_strike", "swinging_strike", "swinging_strike_blocked", "foul_tip", "missed_bunt", "foul", "foul_bunt", "other")


PER_GAME = 16
#: What of the two tables the log is made of.
_LINES = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus")
_ORDERS = ("o_orderkey", "o_custkey", "o_orderdate")


def _sources(spark: SparkSession, sf_dir: str, game: int | None = None) -> tuple[DataFrame, DataFrame]:
    li, orders = table(spark, sf_dir, "lineitem").select(*_LINES), table(spark, sf_dir, "orders").select(*_ORDERS)
    if game is not None:  # as a range of the key, so that the filter reaches both scans
        li, orders = (x.where(F.col(k).between(game * PER_GAME, game * PER_GAME + PER_GAME - 1)) for x, k in ((li, "l_orderkey"), (orders, "o_orderkey")))
    return li, orders


def _pitches(joined: DataFrame, *also: str) -> DataFrame:
    n = lambda c: F.round(F.col(c) * 100).cast("int")
    q = F.col("l_quantity").cast("int")
    return joined.select(
        F.expr(f"l_orderkey div {PER_GAME}").alias("game") if "game" not in also else F.col("game"), F.col("l_orderkey").alias("pa"),
        F.col("l_linenumber").alias("line"),
        F.col("o_orderdate").cast("date").alias("day"),
        F.concat("l_returnflag", "l_linestatus").alias("token"),
        F.element_at(F.array(*[F.lit(x) for x in OUTCOMES]), q % 13 + 1).alias("outcome"),
        F.col("l_suppkey").alias("pitcher"), F.col("o_custkey").alias("batter"),
        ((F.col("l_linenumber") - 1) % 4).alias("balls"), (n("l_discount") % 3).alias("strikes"),
        (q % 3).alias("outs"), (q % 10 + 1).alias("inning"),
        F.when(F.col("l_orderkey") % 2 == 0, "Top").otherwise("Bot").alias("side"),
        F.expr("CASE l_partkey % 4 WHEN 0 THEN 'R' WHEN 1 THEN 'L' WHEN 2 THEN 'S' END").alias("stand"),
        F.expr("CASE l_suppkey % 3 WHEN 0 THEN 'R' WHEN 1 THEN 'L' END").alias("throws"),
        (n("l_tax") - 4).alias("score_diff"),
        F.expr("CASE WHEN l_partkey % 2 = 0 THEN l_partkey END").alias("on_1"),
        F.expr("CASE WHEN l_partkey % 3 = 0 THEN l_partkey END").alias("on_2"),
        F.expr("CASE WHEN l_partkey % 5 = 0 THEN l_partkey END").alias("on_3"),
        ((F.col("l_partkey") % 200 - 100) / F.lit(50.0)).alias("x"),
        ((F.col("l_suppkey") % 40) / F.lit(10.0) + F.lit(0.5)).alias("y"),
        *[c for c in also if c != "game"],
    )


def pitch_rows(spark: SparkSession, sf_dir: str, game: int | None = None) -> DataFrame:
    """lineitem with orders as a play-by-play log, without the sequence number: no exchange beyond the join's."""
    li, orders = _sources(spark, sf_dir, game)
    return _pitches(li.join(orders, F.col("l_orderkey") == F.col("o_orderkey")))


def pitch_log(spark: SparkSession, sf_dir: str, game: int | None = None) -> DataFrame:
    """``pitch_rows`` with ``seq``, the place in its session.

    Lines and orders meet by ``game``, a game's few orders being told apart by a further condition, so that one exchange of the bare lines serves the join
    and all later windows; the log's own columns are made after it.  The orders, a quarter of the lines, are the hashed side: the lines are not sorted for the join."""
    li, orders = _sources(spark, sf_dir, game)
    li = li.withColumn("game", F.expr(f"l_orderkey div {PER_GAME}")).repartition("game")
    orders = orders.withColumn("_game", F.expr(f"o_orderkey div {PER_GAME}")).hint("shuffle_hash")
    joined = li.join(orders, (F.col("game") == F.col("_game")) & (F.col("l_orderkey") - F.col("o_orderkey") == 0))
    order = Window.partitionBy("game", "l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return _pitches(joined.withColumn("seq", F.row_number().over(order)), "game", "seq")


def pitch_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(day, n): the log's events of each day, from the lines counted by order before they meet the orders."""
    li, orders = _sources(spark, sf_dir)
    counts = li.groupBy("l_orderkey").agg(F.count("*").alias("n"))
    j = counts.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return j.groupBy(F.col("o_orderdate").cast("date").alias("day")).agg(F.sum("n").alias("n"))


_CASES = " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(OUTCOMES))
PITCH_SQL = f"""lg AS (SELECT l_orderkey // 16 AS game, l_orderkey AS pa, l_linenumber AS line,
 CAST(o_orderdate AS DATE) AS day, l_returnflag || l_linestatus AS token,
 CASE CAST(floor(l_quantity) AS INT) % 13 {_CASES} END AS outcome,
 l_suppkey AS pitcher, o_custkey AS batter, (l_linenumber - 1) % 4 AS balls,
 CAST(round(l_discount * 100) AS INT) % 3 AS strikes, CAST(floor(l_quantity) AS INT) % 3 AS outs,
 CAST(floor(l_quantity) AS INT) % 10 + 1 AS inning, CASE WHEN l_orderkey % 2 = 0 THEN 'Top' ELSE 'Bot' END AS side,
 CASE l_partkey % 4 WHEN 0 THEN 'R' WHEN 1 THEN 'L' WHEN 2 THEN 'S' END AS stand,
 CASE l_suppkey % 3 WHEN 0 THEN 'R' WHEN 1 THEN 'L' END AS throws,
 CAST(round(l_tax * 100) AS INT) - 4 AS score_diff,
 CASE WHEN l_partkey % 2 = 0 THEN l_partkey END AS on_1, CASE WHEN l_partkey % 3 = 0 THEN l_partkey END AS on_2,
 CASE WHEN l_partkey % 5 = 0 THEN l_partkey END AS on_3,
 (l_partkey % 200 - 100) / 50.0::DOUBLE AS x, (l_suppkey % 40) / 10.0::DOUBLE + 0.5 AS y,
 row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS seq
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


def user_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events by user: a day is a session."""
    e = table(spark, sf_dir, "events")
    return e.select(
        "event_id", F.col("user_id").alias("entity"), F.col("ts").cast("date").alias("day"), "ts", F.col("event_type").alias("token"),
        F.col("value").alias("x"), F.get_json_object("props", "$.k").cast("bigint").alias("k"),
    )


USER_SQL = """ev AS (SELECT event_id, user_id AS entity, CAST(ts AS DATE) AS day, ts, event_type AS token, value AS x,
 CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)"""


def vector_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings as predictions: ten logits (values 2 to 11), and the label."""
    e = table(spark, sf_dir, "embeddings")
    v = F.transform(F.col("embedding"), lambda x: x.cast("double"))
    return e.select("vec_id", F.col("label").cast("int").alias("label"), v.alias("v")).withColumn("logits", F.slice("v", 2, 10))


SCORES_SQL = """vs AS (SELECT vec_id, CAST(label AS INT) AS label, [CAST(e AS DOUBLE) FOR e IN embedding] AS v FROM embeddings),
 ex AS (SELECT vec_id, label, unnest(generate_series(0, 9)) AS c, v FROM vs),
 lo AS (SELECT vec_id, label, c, v[c + 2] AS z FROM ex),
 pr AS (SELECT vec_id, label, c, exp(z - max(z) OVER w) / sum(exp(z)) OVER w * exp(max(z) OVER w) AS p FROM lo WINDOW w AS (PARTITION BY vec_id)),
 rk AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY p DESC, c) AS r FROM pr)"""
