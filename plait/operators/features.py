"""What a learned model is given: id, history and context arrays, made by column expressions alone.

Batch rows and prediction requests go the same way: both carry a nested history, ``array<struct<token, outcome, x, y>>`` with the
oldest event first, which is encoded, cut to its last events, padded on the left and z-scored."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plait.functions.columns import occupied
from plait.operators import encoding, heads

#: The context of an event, in the order of its array.
CONTEXT = ("inning", "outs", "balls", "strikes", "pitch_number", "score_diff", "on_1", "on_2", "on_3", "side")
#: Token dictionaries up to this many entries may stand in a plan as a map.
MOST_INLINE = 10_000


@dataclass(frozen=True)
class Encoding:
    """What training fixes and prediction needs: dictionaries of tokens and outcomes, norms (mean, deviation) of the context and of x and y, the history's length."""

    tokens: dict[str, int]
    outcomes: dict[str, int]
    norms: dict[str, tuple[float, float]]
    history: int = 4

    def __post_init__(self):
        if max(len(self.tokens), len(self.outcomes)) > MOST_INLINE:
            raise ValueError(f"a dictionary of over {MOST_INLINE} entries; encode it by a join")

    @property
    def sizes(self) -> tuple[int, int]:
        """Classes, with 0 for unknown."""
        return max(self.tokens.values(), default=0) + 1, max(self.outcomes.values(), default=0) + 1


def fitted(train: DataFrame, history: int = 4, min_count: int = 1) -> Encoding:
    """The encoding of the training rows (token, outcome, x, y and the context as numbers)."""
    counts = encoding.token_counts(train, ["token", "outcome"])
    vocab = encoding.vocabulary(counts, min_count).limit(2 * MOST_INLINE + 1).collect()
    columns = [*CONTEXT, "x", "y"]
    stats = train.agg(*[f for c in columns for f in (F.avg(c).alias(f"{c}_mean"), F.coalesce(F.nullif(F.stddev_samp(c), F.lit(0.0)), F.lit(1.0)).alias(f"{c}_std"))]).first()
    ids = {f: {r.token: r.id for r in vocab if r.field == f} for f in ("token", "outcome")}
    return Encoding(ids["token"], ids["outcome"], {c: (stats[f"{c}_mean"] or 0.0, stats[f"{c}_std"]) for c in columns}, history)


def coded(token: Column, ids: dict[str, int]) -> Column:
    """The id of a token by an inline map; unknown and null as 0."""
    if not ids:
        return F.lit(0)
    table = F.create_map(*[F.lit(x) for kv in ids.items() for x in kv])
    return F.when(token.isNull(), 0).otherwise(F.coalesce(F.try_element_at(table, token.cast("string")), F.lit(0))).cast("int")


def context(rows: DataFrame) -> DataFrame:
    """Raw columns of an event as numbers: bases as 0 or 1, side as 1 for Bot, ``pitch_number`` from ``seq``."""
    return rows.withColumns({**{x: occupied(x).cast("int") for x in ("on_1", "on_2", "on_3")}, "side": F.when(F.col("side") == "Bot", 1).otherwise(0), "pitch_number": F.col("seq")})


def nested_history(rows: DataFrame, history: int) -> DataFrame:
    """Adds ``history``: the session's last ``history`` events before each."""
    w = Window.partitionBy("game", "pa").orderBy("seq").rowsBetween(-history, -1)
    return rows.withColumn("history", F.collect_list(F.struct("token", "outcome", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))).over(w))


def encoded(rows: DataFrame, e: Encoding) -> DataFrame:
    """Adds ``hist_ids`` (tokens, then outcomes), ``hist_places`` (x, then y, z-scored), ``cont`` (the context, z-scored), and the last known ``prev_type`` and ``prev_outcome``.

    Missing history is id 0 and place 0, z-scored like others; null context counts as its mean, null histories as empty."""
    n = e.history
    last = F.slice(F.concat(F.array_repeat(F.lit(None).cast("struct<token:string,outcome:string,x:double,y:double>"), n), F.coalesce(F.transform("history", lambda h: F.struct(h["token"].cast("string").alias("token"), h["outcome"].cast("string").alias("outcome"), h["x"].cast("double").alias("x"), h["y"].cast("double").alias("y"))), F.array().cast("array<struct<token:string,outcome:string,x:double,y:double>>"))), -n, n)
    rows = rows.withColumn("_last", last)
    z = lambda v, c: (F.coalesce(v.cast("double"), F.lit(0.0)) - e.norms[c][0]) / e.norms[c][1]
    ids = {"token": F.transform("_last", lambda h: coded(h["token"], e.tokens)), "outcome": F.transform("_last", lambda h: coded(h["outcome"], e.outcomes))}
    known = lambda a: F.coalesce(F.try_element_at(F.filter(a, lambda i: i != 0), F.lit(-1)), F.lit(0)).cast("int")
    mean = lambda c: F.coalesce((F.col(c).cast("double") - e.norms[c][0]) / e.norms[c][1], F.lit(0.0))
    return rows.withColumns({
        "hist_ids": F.concat(ids["token"], ids["outcome"]), "hist_places": F.concat(F.transform("_last", lambda h: z(h["x"], "x")), F.transform("_last", lambda h: z(h["y"], "y"))),
        "cont": F.array(*[mean(c) for c in CONTEXT]), "prev_type": known(ids["token"]), "prev_outcome": known(ids["outcome"]),
    }).drop("_last")


def labelled(rows: DataFrame, e: Encoding) -> DataFrame:
    """Adds ``labels`` (token, outcome, then the state heads' targets), ``mask`` (has a next event) and ``place`` (z-scored x and y)."""
    state = [F.col(y).cast("int") for y, _ in heads.STATE.values()]
    at = lambda c: (F.col(c).cast("double") - e.norms[c][0]) / e.norms[c][1]
    return rows.withColumns({"labels": F.array(coded(F.col("token"), e.tokens), coded(F.col("outcome"), e.outcomes), *state), "mask": F.col("y_has_next").cast("int"), "place": F.array(at("x"), at("y"))})
