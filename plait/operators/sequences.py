"""Windows over entity -> session -> event: history, next state, sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plait.functions.columns import clip, occupied


def in_session():
    return Window.partitionBy("game", "pa").orderBy("seq")


def in_game():
    return Window.partitionBy("game").orderBy("pa", "seq")


def history(rows: DataFrame, fields: list[str], length: int) -> DataFrame:
    """Adds ``hist_<field>_<i>``: the session's last ``length`` values, oldest at 0, missing and null as 0."""
    new = {f"hist_{f}_{i}": F.coalesce(F.lag(f, length - i).over(in_session()), F.lit(0)) for f in fields for i in range(length)}
    return rows.withColumns(new)


def last_nonzero(columns: list[str]) -> Column:
    """The most recent value that is not padding, else 0."""
    return F.coalesce(*[F.nullif(F.col(x), F.lit(0)) for x in reversed(columns)], F.lit(0))


def next_state(rows: DataFrame) -> DataFrame:
    """Adds the state after each event within its game: the targets ``y_*``."""
    nxt = lambda x: F.lead(x).over(in_game())
    has = nxt("pa").isNotNull()
    base = lambda x: F.coalesce(nxt(occupied(x).cast("int")), F.lit(0))
    return rows.withColumns({
        "y_has_next": has.cast("int"),
        "y_pa_end": F.when(has, (nxt("pa") != F.col("pa")).cast("int")).otherwise(1),
        "y_next_balls": clip(F.coalesce(nxt("balls"), F.lit(0)), 0, 3),
        "y_next_strikes": clip(F.coalesce(nxt("strikes"), F.lit(0)), 0, 2),
        "y_next_outs": clip(F.coalesce(nxt("outs"), F.lit(0)), 0, 2),
        "y_next_on_1": base("on_1"), "y_next_on_2": base("on_2"), "y_next_on_3": base("on_3"),
        "y_next_side": F.coalesce(nxt(F.when(F.col("side") == "Bot", 1).otherwise(0)), F.lit(0)),
        "y_inning_delta": clip(F.coalesce(nxt("inning"), F.col("inning")) - F.col("inning"), 0, 1),
        "y_score_delta": clip(F.coalesce(nxt("score_diff"), F.col("score_diff")) - F.col("score_diff"), -4, 4) + 4,
    })


def sessions(rows: DataFrame, entity: str, at: str, gap_seconds: int) -> DataFrame:
    """Adds ``session``: counts, from 1, each entity's gaps of over ``gap_seconds``."""
    w = Window.partitionBy(entity).orderBy(at)
    seconds = lambda x: F.unix_micros(x.cast("timestamp"))
    new = (F.lag(at).over(w).isNull() | (seconds(F.col(at)) - seconds(F.lag(at).over(w)) > gap_seconds * 1_000_000)).cast("int")
    return rows.withColumn("_new", new).withColumn("session", F.sum("_new").over(w)).drop("_new")
