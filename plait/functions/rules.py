"""State transitions: outcome rules for the count, and decoders that choose a next count."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from plait.functions.columns import c

#: What each outcome does to the count.
BALLS = ("ball", "blocked_ball", "pitchout")
ENDS = ("hit_by_pitch", "hit_into_play")
STRIKES = ("called_strike", "swinging_strike", "swinging_strike_blocked", "foul_tip", "missed_bunt")


def state(balls, strikes, end, used) -> Column:
    as_int = lambda x: (x if isinstance(x, Column) else F.lit(x)).cast("int")
    return F.struct(as_int(balls).alias("balls"), as_int(strikes).alias("strikes"), as_int(end).alias("pa_end"), as_int(used).alias("used"))


def count_rules(outcome, balls, strikes) -> Column:
    """(balls, strikes, pa_end, used) after an outcome; ``used`` is 0 where no rule knows it."""
    o, b, s = c(outcome), c(balls), c(strikes)
    over = state(0, 0, 1, 1)
    return (
        F.when(o.isin(*BALLS), F.when(b + 1 >= 4, over).otherwise(state(b + 1, s, 0, 1)))
        .when(o.isin(*ENDS), over)
        .when(o.isin(*STRIKES), F.when(s + 1 >= 3, over).otherwise(state(b, s + 1, 0, 1)))
        .when(o == "foul", state(b, F.when(s < 2, s + 1).otherwise(s), 0, 1))
        .when(o == "foul_bunt", F.when(s >= 2, over).otherwise(state(b, s + 1, 0, 1)))
        .otherwise(state(b, s, 0, 0))
    )


def clamped(balls, strikes, log_balls, log_strikes) -> Column:
    """(balls, strikes): stay, one ball more or one strike more, by the summed log probabilities; the first of equals.

    ``log_balls`` and ``log_strikes`` are arrays over counts.  Moves beyond 3 balls or 2 strikes are no candidates."""
    b, s = c(balls), c(strikes)
    lb, ls = c(log_balls), c(log_strikes)
    score = lambda x, y: F.get(lb, x) + F.get(ls, y)
    one = lambda rank, x, y, ok: F.when(ok, F.struct(score(x, y).alias("score"), F.lit(-rank).alias("rank"), x.cast("int").alias("balls"), y.cast("int").alias("strikes")))
    best = F.array_max(F.array(one(0, b, s, F.lit(True)), one(1, b + 1, s, b < 3), one(2, b, s + 1, s < 2)))
    return F.struct(best["balls"].alias("balls"), best["strikes"].alias("strikes"))


def constrained(balls, strikes, log_end, log_balls, log_strikes, log_outcomes: dict[str, Column], weight: float = 0.35) -> Column:
    """(balls, strikes, pa_end, used): the heads' own best state, or the outcome rule's that scores strictly higher.

    ``log_end`` has two values; each rule's score adds ``weight`` times its outcome's log probability."""
    lb, ls, le = c(log_balls), c(log_strikes), c(log_end)

    def arg(v, n):
        return F.array_max(F.array(*[F.struct(F.get(v, F.lit(i)).alias("p"), F.lit(-i).alias("rank"), F.lit(i).alias("i")) for i in range(n)]))

    e, b, s = arg(le, 2), arg(lb, 4), arg(ls, 3)
    heads = F.struct((e["p"] + b["p"] + s["p"]).alias("score"), F.lit(1).alias("rank"), state(b["i"], s["i"], e["i"], 0).alias("state"))
    options = [heads]
    for rank, (name, lp) in enumerate(log_outcomes.items()):
        r = count_rules(F.lit(name), balls, strikes)
        points = F.lit(weight) * lp + F.get(le, r["pa_end"]) + F.get(lb, r["balls"]) + F.get(ls, r["strikes"])
        options.append(F.when(r["used"] == 1, F.struct(points.alias("score"), F.lit(-rank).alias("rank"), r.alias("state"))))
    return F.array_max(F.array(*options))["state"]
