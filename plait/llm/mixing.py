"""Mixing sources to target weights by entropy balancing (operator 2).

Document rates minimise the relative entropy to 1 under one token constraint a source (the taken words are the
source's target) and a ceiling on repeats.  The convex dual has one multiplier a source; its solution tilts each
document exponentially, ``rate = min(ceiling, exp(multiplier * size / scale))``.  Newton's method solves it: each
iteration is one distributed pass over (source, size, documents) that returns one row a source.  Rates become
whole copies by systematic rounding along the sizes, exact over all documents, so a source's error stays below
one document; single copies given or taken then bring each source's words nearer to its target.

* a null text has 0 words, and takes nothing; documents of 0 words keep rate 1.
* null is a source of its own, last in order; a null ``doc_id`` is kept; repeated rows are mixed one by one.
* ties of size are broken by the ids' hash, then the id: reruns agree.  Equal ids of equal size may swap, with equal results.
* an empty table, or one without words, takes nothing; extra columns are ignored.
* sources are collected, one row each: over ``max_sources`` is an error, never a cut.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plait.llm.shared import n_words, written

CEILING = 3.0


@dataclass
class Source:
    name: str | None
    size: int
    documents: int
    target: float = 0.0
    multiplier: float = 0.0
    done: bool = False


def targets(sizes: list[int], weights: list[float], ceiling: float = CEILING) -> list[float]:
    """All sizes shared by weight; a share stops at ``ceiling`` times its source, and the excess is shared again by weight."""
    out, open_, rest = [0.0] * len(sizes), set(range(len(sizes))), float(sum(sizes))
    while open_:
        unit = rest / sum(weights[i] for i in open_)
        full = {i for i in open_ if unit * weights[i] > ceiling * sizes[i]}
        if not full:
            for i in open_:
                out[i] = unit * weights[i]
            break
        for i in full:
            out[i] = ceiling * sizes[i]
            rest -= out[i]
        open_ -= full
    return out


def source_table(rows: DataFrame, pattern: tuple[float, ...], max_sources: int) -> list[Source]:
    found = rows.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n")).limit(max_sources + 1).collect()
    if len(found) > max_sources:
        raise ValueError(f"over {max_sources} sources")
    out = [Source(r.source, r["size"], r.n) for r in sorted(found, key=lambda r: (r.source is None, r.source or ""))]
    for s, t in zip(out, targets([s.size for s in out], [pattern[i % len(pattern)] for i in range(len(out))])):
        s.target = t
    return out


def _frame(rows: DataFrame, sources: list[Source]) -> DataFrame:
    """The multipliers as a table of at most ``max_sources`` rows."""
    data = [(s.name, float(s.size), s.size / max(1, s.documents) or 1.0, s.target, s.multiplier) for s in sources]
    return rows.sparkSession.createDataFrame(data, "source string, source_size double, scale double, target double, multiplier double")


def _rate() -> F.Column:
    return F.when(F.col("size") == 0, F.lit(1.0)).otherwise(F.least(F.lit(CEILING), F.exp(F.least(F.lit(50.0), F.col("multiplier") * F.col("size") / F.col("scale")))))


def _with(rows: DataFrame, sources: list[Source]) -> DataFrame:
    table = _frame(rows, sources).withColumnRenamed("source", "_source")
    small = F.broadcast(table) if len(sources) <= 100_000 else table
    return rows.join(small, rows["source"].eqNullSafe(F.col("_source"))).drop("_source")


def solve(sizes: DataFrame, sources: list[Source], iterations: int = 60, tolerance: float = 1e-7) -> None:
    """Newton on the dual, bracketed: sets each source's multiplier.  ``sizes``: source, size, n (documents)."""
    bracket = {}
    for s in sources:
        scale = s.size / max(1, s.documents) or 1.0
        top = math.log(CEILING) * scale + 1e-9  # at this multiplier even a document of one word has the full rate
        bracket[s.name] = [-60.0 * scale, top]
        if s.size == 0 or s.target >= CEILING * s.size * (1 - 1e-12):
            s.multiplier, s.done = top, True
    for _ in range(iterations):
        left = [s for s in sources if not s.done]
        if not left:
            return
        rate, at = _rate(), F.col("size") / F.col("scale")
        sums = _with(sizes, left).groupBy("source").agg(
            F.sum(F.col("n") * F.col("size") * rate).alias("value"),
            F.sum(F.when(rate < CEILING, F.col("n") * F.col("size") * at * rate).otherwise(0.0)).alias("slope"),
        )
        by = {r.source: (r.value, r.slope) for r in sums.collect()}
        for s in left:
            (value, slope), b = by[s.name], bracket[s.name]
            gap = value - s.target
            b[gap > 0] = s.multiplier
            if abs(gap) <= tolerance * max(1.0, s.target):
                s.done = True
                continue
            step = s.multiplier - gap / slope if slope > 0 else math.inf
            s.multiplier = step if b[0] < step < b[1] else (b[0] + b[1]) / 2


def nearer(chosen: DataFrame, rounds: int) -> DataFrame:
    """Each round gives or takes one copy in each source: of the size that brings its taken words nearest to the target, if any does."""
    for _ in range(rounds):
        gap = chosen.groupBy("source").agg((F.max("target") - F.sum(F.col("size") * (F.col("n") * F.col("whole") + F.col("extra")))).alias("gap"))
        gap = gap.select(F.col("source").alias("_source"), "gap")
        room = F.when(F.col("gap") > 0, (F.col("extra") < F.col("n")) & (F.col("whole") < CEILING)).otherwise(F.col("extra") > 0)
        left = F.abs(F.abs("gap") - F.col("size"))
        can = chosen.join(gap, F.col("source").eqNullSafe(F.col("_source"))).where((F.col("size") > 0) & room & (left < F.abs("gap")))
        best = can.groupBy("_source").agg(F.min(F.struct(left.alias("left"), F.col("size").alias("at"), F.signum("gap").alias("sign"))).alias("b")).select("_source", F.col("b.at").alias("_size"), F.col("b.sign").alias("_sign"))
        if best.isEmpty():
            return chosen
        same = F.col("source").eqNullSafe(F.col("_source")) & (F.col("size") == F.col("_size"))
        moved = chosen.join(best, same, "left").withColumn("extra", F.col("extra") + F.coalesce(F.col("_sign"), F.lit(0)).cast("long")).drop("_source", "_size", "_sign")
        chosen = written(moved, "mix-chosen")
    return chosen


def mix(docs: DataFrame, pattern: tuple[float, ...] = (5, 2, 1), max_sources: int = 100_000, deal: int = 64, offsets: int = 32, rounds: int = 5) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies and rate of every document.

    Only (doc_id, source, size) is shuffled.  ``deal`` splits each (source, size), so a hot one is no single task.
    """
    h = F.xxhash64("doc_id", "size")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), n_words(F.col("text").cast("string")).alias("size"))
    rows = written(rows.withColumn("hash", h).withColumn("part", F.pmod(F.shiftright("hash", 8), F.lit(deal)).cast("int")), "mix")
    sources = source_table(rows, pattern, max_sources)
    parts = written(rows.groupBy("source", "size", "part").agg(F.count("*").alias("n")), "mix-sizes")
    sizes = parts.groupBy("source", "size").agg(F.sum("n").alias("n"))
    sizes = written(sizes, "mix-counts")
    solve(sizes, sources)

    # systematic rounding: the fractions' running sum along the sizes; of the offsets the one nearest the target
    rated = _with(sizes, sources).withColumn("rate", _rate())
    rated = rated.withColumn("whole", F.floor(F.col("rate") + 1e-9)).withColumn("part_sum", F.col("n") * F.greatest(F.lit(0.0), F.col("rate") - F.col("whole")))
    along = Window.partitionBy("source").orderBy("size")
    rated = rated.withColumn("after", F.sum("part_sum").over(along)).withColumn("before", F.coalesce(F.lag("after").over(along), F.lit(0.0)))
    rated = written(rated, "mix-rates")
    extra = lambda u: F.floor(F.col("after") + u) - F.floor(F.col("before") + u)
    tried = rated.withColumn("u", F.explode(F.array(*[F.lit((i + 0.5) / offsets) for i in range(offsets)])))
    error = tried.groupBy("source", "u").agg(F.abs(F.sum(F.col("size") * (F.col("n") * F.col("whole") + extra(F.col("u")))) - F.max("target")).alias("error"))
    best = error.groupBy("source").agg(F.min(F.struct("error", "u")).getField("u").alias("u")).withColumnRenamed("source", "_source")
    chosen = rated.join(best, rated["source"].eqNullSafe(F.col("_source"))).withColumn("extra", extra(F.col("u"))).drop("_source", "u")

    chosen = nearer(written(chosen, "mix-chosen"), rounds)

    # which documents of a (source, size) get the extra copy: the first by hash, ranked in dealt parts
    keys = ["size", "part"]
    ranked = Window.partitionBy("source", "size").orderBy("part")
    first = parts.withColumn("first", F.coalesce(F.sum("n").over(ranked.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    plan = first.drop("n").alias("f").join(chosen.alias("c"), F.col("f.source").eqNullSafe(F.col("c.source")) & (F.col("f.size") == F.col("c.size")))
    plan = plan.select(F.col("f.source").alias("_source"), F.col("f.size").alias("_size"), F.col("f.part").alias("_part"), "first", "whole", "extra", "rate", "target", "source_size")
    full = rows.join(plan, rows["source"].eqNullSafe(F.col("_source")) & (rows["size"] == F.col("_size")) & (rows["part"] == F.col("_part")))
    rank = F.row_number().over(Window.partitionBy("source", *keys).orderBy("hash", "doc_id")) + F.col("first")
    copies = F.col("whole") + F.when(rank <= F.col("extra"), 1).otherwise(0)
    out = full.withColumn("copies", F.when(F.col("size") == 0, F.lit(1)).otherwise(copies).cast("long"))
    return out.select("doc_id", "source", "size", F.col("source_size").cast("long").alias("source_size"), "target", (F.col("size") * F.col("copies")).alias("taken"), "copies", "rate")


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, all columns, each as often as the mix takes it."""
    names = docs.columns
    plan = mix(docs, **options).groupBy("doc_id", "source", "size").agg(F.sum("copies").alias("_total"), F.count("*").alias("_n"))
    plan = plan.select(F.col("doc_id").alias("_d"), F.col("source").alias("_s"), F.col("size").alias("_z"), "_total", "_n")
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"), F.col("doc_id").cast("long").alias("_d"), F.col("source").cast("string").alias("_s"), n_words(F.col("text").cast("string")).alias("_z"))
    on = packed["_d"].eqNullSafe(plan["_d"]) & packed["_s"].eqNullSafe(plan["_s"]) & (packed["_z"] == plan["_z"])
    full = packed.join(plan, on).select("_row", packed["_d"], packed["_s"], packed["_z"], "_total", "_n")
    rank = F.row_number().over(Window.partitionBy("_d", "_s", "_z").orderBy(F.xxhash64(F.col("_row.text"))))  # over 1 only for repeated ids
    times = F.floor(F.col("_total") / F.col("_n")) + F.when(rank <= F.col("_total") % F.col("_n"), 1).otherwise(0)
    out = full.withColumn("_times", times.cast("int")).where("_times > 0")
    return out.select("_row", F.explode(F.array_repeat(F.lit(1), F.col("_times")))).select("_row.*")
