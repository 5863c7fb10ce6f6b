"""A state predictor as a table: smoothed probabilities of every head by context, with coarser contexts behind finer ones.

A context is the count and the last known token and outcome of the history, be they the actual or the predicted ones.
Fitting is one grouping of the training rows.  The table has a row for each context that was seen, so its size is bounded
by the classes of its keys and not by the rows: it may be broadcast, or held by each task of a rollout.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plait.functions import rules
from plait.sources.scratch import written

#: Heads of a state predictor: the target of each, and its classes.
STATE = {
    "pa_end": ("y_pa_end", 2), "balls": ("y_next_balls", 4), "strikes": ("y_next_strikes", 3), "outs": ("y_next_outs", 3), "on_1": ("y_next_on_1", 2),
    "on_2": ("y_next_on_2", 2), "on_3": ("y_next_on_3", 2), "side": ("y_next_side", 2), "inning_delta": ("y_inning_delta", 2), "score_delta": ("y_score_delta", 9),
}
#: Contexts from the finest to the one that always holds.
LEVELS = (("balls", "strikes", "prev_type", "prev_outcome"), ("balls", "strikes"), ())
#: More contexts than that are no table to send around.
MOST = 200_000


def fit(train: DataFrame, n_types: int, n_outcomes: int, levels=LEVELS) -> DataFrame:
    """(level, keys, n, n_next, c_<head>, mean_x, mean_y): class counts and mean places by context, the rows being grouped once, by all keys, and the groups by level.

    ``train`` carries the keys, ``token_id``, ``outcome_id``, ``x``, ``y`` and the targets ``y_*``.  State heads count the rows that
    have a next one.  A context without such a row is left out, and without any row fitting is an error."""
    keys = list(dict.fromkeys(k for level in levels for k in level))
    seen = F.col("y_has_next") == 1
    classes = {"type": ("token_id", n_types, F.lit(True)), "outcome": ("outcome_id", n_outcomes, F.lit(True)), **{h: (y, n, seen) for h, (y, n) in STATE.items()}}
    counts = [F.sum(((F.col(y) == i) & also).cast("long")).alias(f"_{h}_{i}") for h, (y, n, also) in classes.items() for i in range(n)]
    places = [f(c).alias(f"_{name}_{c}") for c in ("x", "y") for name, f in (("sum", F.sum), ("count", F.count))]
    finest = train.groupBy(*keys).agg(F.count("*").alias("_n"), F.sum(seen.cast("long")).alias("_n_next"), *counts, *places)
    aggs = [F.array(*[F.sum(f"_{h}_{i}") for i in range(n)]).alias(f"c_{h}") for h, (_, n, _) in classes.items()]
    mean = lambda c: F.try_divide(F.sum(f"_sum_{c}"), F.sum(f"_count_{c}")).alias(f"mean_{c}")
    which = F.lit(len(levels) - 1)
    for i, level in reversed(list(enumerate(levels[:-1]))):
        which = F.when(reduce(lambda a, b: a & b, [(F.grouping(k) == 0) if k in level else (F.grouping(k) == 1) for k in keys]), i).otherwise(which)
    grouped = finest.groupingSets([[F.col(k) for k in level] for level in levels], *[F.col(k) for k in keys])
    got = grouped.agg(which.cast("int").alias("level"), F.sum("_n").alias("n"), F.sum("_n_next").alias("n_next"), *aggs, mean("x"), mean("y"))
    return got.where("n_next >= 1")


def attach(rows: DataFrame, table: DataFrame, levels=LEVELS, alpha: float = 1.0) -> DataFrame:
    """Adds ``p_<head>`` (arrays of probabilities) and the mean place ``p_x``, ``p_y`` of each row's finest known context, all in the JVM.

    Each level is joined by a broadcast of at most ``MOST`` contexts, counted before; a larger table is joined by shuffles.  The table is written first, so it is fitted once."""
    table = written(table, "heads")
    small = table.count() <= MOST
    heads = ["type", "outcome", *STATE]
    found = []
    for i, level in enumerate(levels):
        side = table.where(F.col("level") == i).select(*[F.col(k).alias(f"_k{i}_{k}") for k in level], F.struct("n", "n_next", "mean_x", "mean_y", *[f"c_{h}" for h in heads]).alias(f"_h{i}"))
        side = F.broadcast(side) if small else side
        on = reduce(lambda a, b: a & b, [F.col(k) == F.col(f"_k{i}_{k}") for k in level], F.lit(True))
        rows = rows.join(side, on, "left").drop(*[f"_k{i}_{k}" for k in level])
        found.append(f"_h{i}")
    rows = rows.withColumn("_h", F.coalesce(*found)).drop(*found)
    share = lambda h: F.transform(F.col("_h")[f"c_{h}"], lambda x: (x + F.lit(alpha)) / (F.col("_h")["n" if h in ("type", "outcome") else "n_next"] + F.lit(alpha) * F.size(F.col("_h")[f"c_{h}"])))
    return rows.withColumns({**{f"p_{h}": share(h) for h in heads}, "p_x": F.col("_h")["mean_x"], "p_y": F.col("_h")["mean_y"]}).drop("_h")


def best(p) -> Column:
    """The first class of the highest probability."""
    p = F.col(p) if isinstance(p, str) else p
    return (F.array_position(p, F.array_max(p)) - 1).cast("int")


def first_best(values) -> int:
    return max(range(len(values)), key=lambda i: (values[i], -i))


def rule(outcome: str, balls: int, strikes: int) -> tuple[int, int, int] | None:
    """(balls, strikes, pa_end) after an outcome; None where no rule knows it.  The same table as :func:`rules.count_rules`."""
    strike = outcome in rules.STRIKES or outcome == "foul_bunt"
    if outcome in rules.ENDS or outcome in rules.BALLS and balls + 1 >= 4 or strike and strikes + 1 >= 3:
        return 0, 0, 1
    if outcome in rules.BALLS:
        return balls + 1, strikes, 0
    if strike:
        return balls, strikes + 1, 0
    return (balls, min(2, strikes + 1), 0) if outcome == "foul" else None


def near(x: float) -> float:
    """Scores closer than this are equal, so that the first of them is taken everywhere."""
    return round(x, 9)


@dataclass
class Step:
    """What a predictor says of one event: its own event, its place, and the next state."""

    type: int
    outcome: int
    top: tuple[int, ...]
    x: float
    y: float
    balls: int
    strikes: int
    pa_end: int
    used: int  # 1 where an outcome's rule gave the count
    overridden: int  # 1 where the outcome is another than the head's best
    rest: dict[str, int]


@dataclass
class Predictor:
    """The table of :func:`fit` in memory.  ``outcomes``: names of the outcome classes."""

    tables: list[dict[tuple, dict]]
    outcomes: tuple[str, ...]
    levels: tuple[tuple[str, ...], ...] = LEVELS
    alpha: float = 1.0
    weight: float = 0.35  # of an outcome's log probability in the constrained mode
    known: dict = field(default_factory=dict, repr=False, compare=False)

    @classmethod
    def of(cls, table: DataFrame, outcomes, levels=LEVELS, **options) -> Predictor:
        rows = table.limit(MOST + 1).collect()
        if len(rows) > MOST:
            raise ValueError(f"over {MOST} contexts")
        tables: list[dict] = [{} for _ in levels]
        for r in rows:
            tables[r.level][tuple(r[k] for k in levels[r.level])] = r.asDict()
        if not tables[-1]:
            raise ValueError("no training rows")
        return cls(tables, tuple(outcomes), tuple(map(tuple, levels)), **options)

    @cached_property
    def keys(self) -> tuple[str, ...]:
        return tuple(dict.fromkeys(k for level in self.levels for k in level))

    def counts(self, context: dict) -> dict:
        for level, table in zip(self.levels, self.tables):
            if got := table.get(tuple(context[k] for k in level)):
                return got
        raise AssertionError("the last level holds every context")

    def logs(self, got: dict, head: str) -> list[float]:
        c = got[f"c_{head}"]
        n = got["n" if head in ("type", "outcome") else "n_next"] + self.alpha * len(c)
        return [math.log((x + self.alpha) / n) for x in c]

    def step(self, mode: str, balls: int, strikes: int, context: dict) -> Step:
        """Count modes: ``heads`` (each head's best), ``clamp`` (stay, or one more ball or strike), ``rules`` (by the best outcome), ``constrained``
        (the heads' best, or the outcome rule that scores strictly higher).  Answers are kept by context."""
        key = (mode, balls, strikes, *(context[k] for k in self.keys))
        if key not in self.known:
            self.known[key] = self._step(mode, balls, strikes, self.counts(context))
        return self.known[key]

    def _step(self, mode: str, balls: int, strikes: int, got: dict) -> Step:
        types, outcomes = got["c_type"], got["c_outcome"]
        head = {h: first_best(got[f"c_{h}"]) for h in STATE}
        told = first_best(outcomes)
        b, s, end, used, outcome = head["balls"], head["strikes"], head["pa_end"], 0, told
        lb, ls, le = (self.logs(got, h) for h in ("balls", "strikes", "pa_end"))
        if mode == "clamp":
            moves = [(balls, strikes), (min(3, balls + 1), strikes), (balls, min(2, strikes + 1))]
            b, s = (0, 0) if end else moves[first_best([near(lb[x] + ls[y]) for x, y in moves])]
        elif mode == "rules":
            if r := rule(self.outcomes[told], balls, strikes):
                (b, s, end), used = r, 1
        elif mode == "constrained":
            lo = self.logs(got, "outcome")
            score = near(le[end] + lb[b] + ls[s])
            for i, name in enumerate(self.outcomes):
                if r := rule(name, balls, strikes):
                    points = near(self.weight * lo[i] + le[r[2]] + lb[r[0]] + ls[r[1]])
                    if points > score:
                        score, (b, s, end), used, outcome = points, r, 1, i
        elif mode != "heads":
            raise ValueError(f"count mode {mode}")
        top = tuple(sorted(range(len(types)), key=lambda i: (-types[i], i))[:3])
        rest = {h: head[h] for h in STATE if h not in ("balls", "strikes", "pa_end")}
        return Step(top[0], outcome, top, got["mean_x"], got["mean_y"], b, s, end, used, int(outcome != told), rest)
