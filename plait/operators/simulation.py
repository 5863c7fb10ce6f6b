"""Replay and open-loop rollout of event sequences, their scores and traces; corruption of states."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plait.operators import heads, sequences
from plait.operators.heads import Predictor
from plait.session import importable
from plait.sources import artifacts

FIELDS = ["inning", "outs", "balls", "strikes", "pitch_number", "score_diff", "on_1", "on_2", "on_3", "side"]
MODES = ("heads", "clamp", "rules", "constrained")
#: What a rollout adds to each event: the simulated state, the history it predicts from, and its prediction.
SIMULATED = {**{f"sim_{f}": "int" for f in FIELDS}, "prev_type": "int", "prev_outcome": "int", "p_type": "int", "p_outcome": "int", "p_top": "array<int>", "p_x": "double", "p_y": "double", "p_pa_end": "int", "p_balls": "int", "p_strikes": "int", "used": "int", "overridden": "int"}


def last_known(values: list[int]) -> int:
    return next((x for x in reversed(values) if x), 0)


#: Fields of the state that the predictor gives as they are, and those that move by a step.
GIVEN = ("outs", "on_1", "on_2", "on_3", "side")
MOVES = {"inning": ("inning_delta", 0), "score_diff": ("score_delta", -4)}
#: What of a prediction each column takes.
PREDICTION = {"p_type": "type", "p_outcome": "outcome", "p_top": "top", "p_x": "x", "p_y": "y", "p_pa_end": "pa_end", "p_balls": "balls", "p_strikes": "strikes", "used": "used", "overridden": "overridden"}


class Walks:
    """The predictor as a graph that is drawn as far as rollouts come.

    A node is all that a prediction depends on: the predicted history, the count, and those fields of the state that are keys.  An edge is a
    node with an event's own keys: its prediction, and the node after it.  The rest of the state follows from the path by whole columns."""

    def __init__(self, predictor: Predictor, mode: str, history: int):
        self.predictor, self.mode, self.history = predictor, mode, history
        self.own = [k for k in predictor.keys if k in FIELDS and k not in ("balls", "strikes")]
        self.known = [k for k in predictor.keys if k not in FIELDS and k not in ("prev_type", "prev_outcome")]
        self.ids: dict[tuple, int] = {}
        self.nodes: list[tuple] = []
        self.edges: dict[tuple, int] = {}
        self.after: list[int] = []
        self.steps: list[tuple] = []  # (prev_type, prev_outcome, step)
        self._columns: dict[str, tuple] = {}

    def node(self, types, outcomes, balls, strikes, own) -> int:
        key = (types, outcomes, balls, strikes, own)
        if key not in self.ids:
            self.ids[key] = len(self.nodes)
            self.nodes.append(key)
        return self.ids[key]

    def start(self, state: dict) -> int:
        return self.node((), (), state["balls"], state["strikes"], tuple(state[f] for f in self.own))

    def draw(self, key: tuple) -> int:
        """The edge of (node, the event's keys), new."""
        types, outcomes, balls, strikes, own = self.nodes[key[0]]
        prev = last_known(types), last_known(outcomes)
        state = dict(zip(self.own, own))
        context = {**state, "balls": balls, "strikes": strikes, "prev_type": prev[0], "prev_outcome": prev[1], **dict(zip(self.known, key[1:]))}
        s = self.predictor.step(self.mode, min(3, max(0, balls)), min(2, max(0, strikes)), context)
        moved = lambda f: s.rest[f] if f in GIVEN else (1 if s.pa_end else state[f] + 1) if f == "pitch_number" else state[f] + s.rest[MOVES[f][0]] + MOVES[f][1]
        if s.pa_end:
            types, outcomes = (), ()
        else:
            types, outcomes = (*types, s.type)[-self.history :], (*outcomes, s.outcome)[-self.history :]
        self.edges[key] = len(self.steps)
        self.steps.append((*prev, s))
        self.after.append(self.node(types, outcomes, s.balls, s.strikes, tuple(moved(f) for f in self.own)))
        return self.edges[key]

    def column(self, name: str, value, kind=None):
        """``value`` of every edge, as an array: of numpy, or of the Arrow type ``kind``; made anew when edges were added."""
        size, got = self._columns.get(name, (-1, None))
        if size != len(self.steps):
            values = [value(x) for x in self.steps]
            got = np.array(values, "i8") if kind is None else pa.array(values, kind)
            self._columns[name] = len(self.steps), got
        return got

    def rest(self, field: str) -> np.ndarray:
        """The next state's field, or the move of it, after every edge."""
        if field in ("balls", "strikes", "pa_end"):
            return self.column(f"_{field}", lambda x: getattr(x[2], field))
        return self.column(f"_{field}", lambda x: x[2].rest[field])


def fold(predictor: Predictor, mode: str, history: int, keep: list[str], schema: pa.Schema):
    """A function over sorted Arrow batches.  It holds one game's state and last ``history`` predictions, whatever the game's length, and each distinct prediction once."""
    wanted = [c for c in schema.names if c in SIMULATED]

    def run(batches):
        walks = Walks(predictor, mode, history)
        started, game, node, carry = False, None, 0, {}
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            games = b.column("game").to_pylist()
            known = [b.column(k).to_pylist() for k in walks.known]
            actual = {f: b.column(f).cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False) for f in FIELDS}
            path, first = [], np.zeros(n, bool)
            edges, after, draw = walks.edges, walks.after, walks.draw
            for i, g in enumerate(games):
                if not started or g != game:
                    started, game, first[i] = True, g, True
                    node = walks.start({f: int(actual[f][i]) for f in FIELDS})
                key = (node, *[k[i] for k in known]) if known else (node,)
                e = edges.get(key)
                if e is None:
                    e = draw(key)
                path.append(e)
                node = after[e]
            path = np.array(path, "i8")
            before = np.concatenate([[carry.get("edge", 0)], path[:-1]]).astype("i8")
            at = np.arange(n)
            since = np.maximum.accumulate(np.where(first, at, -1))  # where the row's game starts; -1: in an earlier batch
            state = {f: np.where(first, actual[f], walks.rest(f)[before]) for f in ("balls", "strikes", *GIVEN)}
            for f, (move, shift) in MOVES.items():
                total = np.cumsum(np.where(first, 0, walks.rest(move)[before] + shift))
                state[f] = np.where(since >= 0, actual[f][since] - total[since], carry.get(f, 0)) + total
            ended = ~first & (walks.rest("pa_end")[before] == 1)
            reset = np.maximum.accumulate(np.where(first | ended, at, -1))
            state["pitch_number"] = np.where(reset >= 0, np.where(first, actual["pitch_number"], 1)[reset] + at - reset, carry.get("pitch_number", 0) + 1 + at)
            carry = {"edge": int(path[-1]), **{f: int(state[f][-1]) for f in (*MOVES, "pitch_number")}}
            made, taken = {}, pa.array(path)
            for c in wanted:
                kind = schema.field(c).type
                if c.startswith("sim_"):
                    made[c] = pa.array(state[c[4:]]).cast(kind)
                elif c in PREDICTION:
                    made[c] = walks.column(c, lambda x, a=PREDICTION[c]: getattr(x[2], a), kind).take(taken)
                else:
                    made[c] = walks.column(c, lambda x, a=("prev_type", "prev_outcome").index(c): x[a], kind).take(taken)
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], *made.values()], schema=schema)

    return run


def rollout(rows: DataFrame, predictor: Predictor, mode: str = "heads", history: int = 4, keep: list[str] | None = None, add: list[str] | None = None) -> DataFrame:
    """Each event with its actual columns, the simulated state before it, and the prediction from that state and the predicted history.

    ``rows``: game, pa, seq and the actual state (``FIELDS``); the first event's state starts a game, nulls as 0.  What is predicted
    becomes the history of the events after it, until a session's predicted end.  Games run in parallel, each as a stream in
    event order through one task, dealt and sorted by a window over the game, which takes no exchange where rows lie by game already.  Extra
    columns are kept, but for those that a rollout adds.  ``keep`` and ``add``: the columns of either kind to give, all unless named."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    importable(rows.sparkSession)
    rows = rows.drop(*SIMULATED)
    keep, add = list(rows.columns if keep is None else keep), list(SIMULATED if add is None else add)
    given = [k for k in predictor.keys if k not in FIELDS and k not in ("prev_type", "prev_outcome")]
    rows = rows.select(*dict.fromkeys(["game", "pa", "seq", *FIELDS, *given, *keep]))
    schema = StructType([*[rows.schema[c] for c in keep], *StructType.fromDDL(", ".join(f"{c} {SIMULATED[c]}" for c in add)).fields])
    in_order = rows.withColumn("_place", F.row_number().over(sequences.in_game()))  # the window's order is that of its rows
    return in_order.mapInArrow(fold(predictor, mode, history, keep, to_arrow_schema(schema)), schema)


def actual_history(rows: DataFrame, history: int = 4) -> DataFrame:
    """Adds ``prev_type`` and ``prev_outcome``: the last known token and outcome of the session's last ``history`` events."""
    h = sequences.history(rows, ["token_id", "outcome_id"], history)
    names = {p: [f"hist_{f}_{i}" for i in range(history)] for p, f in (("prev_type", "token_id"), ("prev_outcome", "outcome_id"))}
    return h.withColumns({p: sequences.last_nonzero(c) for p, c in names.items()}).drop(*names["prev_type"], *names["prev_outcome"])


def replay(rows: DataFrame, table: DataFrame, levels=heads.LEVELS, alpha: float = 1.0) -> DataFrame:
    """Each event with its prediction from the actual state and history: the heads' probabilities ``p_<head>``, ``p_x`` and ``p_y``.  ``rows`` carry the keys of ``levels``."""
    return heads.attach(rows, table, levels, alpha)


def state_accuracy(replayed: DataFrame) -> DataFrame:
    """One row: with the actual state given, the share of next states that each head foresees, over events that have a next one."""
    j = replayed.where("y_has_next = 1")
    return j.agg(F.count("*").alias("n"), *[F.round(F.avg((heads.best(f"p_{h}") == F.col(y)).cast("double")), 6).alias(f"{h}_acc") for h, (y, _) in heads.STATE.items()])


def drift(rolled: DataFrame) -> DataFrame:
    """One row: events, and for each field the share whose simulated value is the actual one."""
    return rolled.agg(F.count("*").alias("n"), *[F.round(F.avg((F.col(f) == F.col(f"sim_{f}")).cast("double")), 6).alias(f"match_{f}") for f in FIELDS])


def summary(rolled: DataFrame) -> DataFrame:
    """One row: games, events, accuracy of tokens and outcomes, place error, and how often rules gave the count or changed the outcome."""
    share = lambda ok: F.round(F.avg(ok.cast("double")), 6)
    se = F.pow(F.col("x") - F.col("p_x"), 2) + F.pow(F.col("y") - F.col("p_y"), 2)
    return rolled.agg(
        F.count_distinct("game").alias("games"), F.count("*").alias("n"), share(F.col("p_type") == F.col("token_id")).alias("acc"), share(F.array_contains("p_top", F.col("token_id"))).alias("top3"),
        share(F.col("p_outcome") == F.col("outcome_id")).alias("outcome_acc"), F.round(F.sqrt(F.avg(se / 2)), 6).alias("loc_rmse"), F.coalesce(F.sum("used"), F.lit(0)).alias("rules_used"), F.coalesce(F.sum("overridden"), F.lit(0)).alias("outcomes_overridden"),
    )


def trace(rolled: DataFrame, types: list[str], outcomes: list[str], loss) -> DataFrame:
    """(game, pa, seq, event): a JSON record of each event of a rollout, with the simulated and the actual state and where they agree, the
    actual event, the predicted one with its place and the loss of the actual place (the column ``loss``), and its scores."""
    name = lambda c, names: F.get(F.array(*[F.lit(x) for x in names]), F.col(c) if isinstance(c, str) else c)
    state = F.struct(*[F.col(f"sim_{f}").alias(f) for f in FIELDS])
    match = F.struct(*[(F.col(f"sim_{f}") == F.col(f)).cast("int").alias(f) for f in FIELDS])
    se = F.pow(F.col("x") - F.col("p_x"), 2) + F.pow(F.col("y") - F.col("p_y"), 2)
    pred = F.struct(
        name("p_type", types).alias("token"), F.transform("p_top", lambda i: name(i, types)).alias("topk"), name("p_outcome", outcomes).alias("outcome"), F.round("p_x", 6).alias("x"), F.round("p_y", 6).alias("y"),
        F.round(loss, 6).alias("loc_nll"), F.col("p_pa_end").alias("pa_end"), F.col("p_balls").alias("next_balls"), F.col("p_strikes").alias("next_strikes"),
    )
    metrics = F.struct((F.col("p_type") == F.col("token_id")).cast("int").alias("top1"), F.array_contains("p_top", F.col("token_id")).cast("int").alias("top3"), F.round(se, 6).alias("loc_se"))
    y = F.struct(name("token_id", types).alias("token"), name("outcome_id", outcomes).alias("outcome"), "x", "y")
    record = F.struct("game", "pa", F.col("seq").alias("pitch_number"), state.alias("state"), F.struct(*FIELDS).alias("actual_state"), match.alias("state_match"), y.alias("y"), pred.alias("pred"), metrics.alias("metrics"))
    return rolled.select("game", "pa", "seq", F.to_json(record, {"ignoreNullFields": "false"}).alias("event"))


def noise(keys: list[str], seed: int, n: int) -> Column:
    """An integer below ``n`` from whole-number keys: the same for a row in every run and partitioning."""
    mixed = F.lit(seed * 1299709).cast("bigint")
    for k, m in zip(keys, (7919, 104729, 15485863)):
        mixed = mixed + F.col(k).cast("bigint") * m
    step = lambda x: x * 48271 % 2147483647
    return (step(step(mixed % 2147483647)) % n).cast("int")


def corrupted(rows: DataFrame, fields: dict[str, tuple[int, int]], keys: list[str], p: float, delta: int) -> DataFrame:
    """With probability ``p`` a field moves by a whole number up to ``delta`` either way, clipped to 0..hi.  ``fields``: name to (hi, seed)."""
    new = {}
    for c, (hi, seed) in fields.items():
        jump = noise(keys, seed + 1, 2 * delta + 1) - delta
        new[c] = F.when(noise(keys, seed, 1000) < round(p * 1000), F.least(F.greatest(F.col(c) + jump, F.lit(0)), F.lit(hi))).otherwise(F.col(c)).cast("int")
    return rows.withColumns(new)


def simulate(rolled: DataFrame, path: str, overwrite: bool = False, **about) -> dict:
    """Writes the summary of a rollout, with the share of each field that the simulated state hits and what ``about`` says of the run, as one JSON file; returns it."""
    kept = rolled.persist()
    try:
        got = {**summary(kept).first().asDict(), **drift(kept).first().asDict(), **about}
    finally:
        kept.unpersist()
    artifacts.write_json(rolled.sparkSession, path, got, overwrite)
    return got
