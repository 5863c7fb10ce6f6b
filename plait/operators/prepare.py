"""From an event log to a model-ready table: split, training-only vocabularies and norms, targets, history, meta data."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plait.operators import encoding, sequences, splitting
from plait.sources import artifacts
from plait.sources.chunks import write_split

VERSION = 1
KEY = ["game", "pa", "seq"]
FIELDS = ["token", "outcome", "pitcher", "batter"]
CONTINUOUS = ["balls", "strikes", "outs", "inning", "score_diff"]
HISTORY = ["token_id", "outcome_id", "x", "y"]
#: The classes of each target.
TARGETS = {
    "y_has_next": 2, "y_pa_end": 2, "y_next_balls": 4, "y_next_strikes": 3, "y_next_outs": 3, "y_next_on_1": 2, "y_next_on_2": 2,
    "y_next_on_3": 2, "y_next_side": 2, "y_inning_delta": 2, "y_score_delta": 9,
}


def assemble(log: DataFrame, vocab: DataFrame, history: int) -> DataFrame:
    """Ids, places, state, targets and ``history`` earlier values of each event."""
    p = encoding.encode(sequences.next_state(log), vocab, FIELDS)
    h = sequences.history(p, HISTORY, history)
    extra = ["split", "day"] if "split" in log.columns else []
    return h.select(*extra, *KEY, "pitcher_id", "batter_id", "token_id", "outcome_id", "x", "y", *CONTINUOUS, *TARGETS, *[f"hist_{f}_{i}" for f in HISTORY for i in range(history)])


def prepare(log: DataFrame, out: str, fraction: float = 0.1, history: int = 16, min_count: int = 1, rows_per_file: int = 0, overwrite: bool = False) -> dict:
    """Writes ``data`` (Parquet by split), ``vocabs`` and ``meta.json`` under ``out``; returns the meta data.

    Rows without a label (token, x, y) are left out before the split.  Vocabularies and norms see the training part only.
    A split or vocabulary without rows is an error."""
    spark = log.sparkSession
    if artifacts.names(spark, out) and not overwrite:
        raise FileExistsError(out)
    log = log.where("token is not null and x is not null and y is not null and day is not null")
    cut = splitting.boundary(log, fraction).first()["valid_from"]
    if cut is None:
        raise ValueError("fewer than two days: nothing to split")
    log = log.withColumn("split", F.when(F.col("day") < F.lit(cut), "train").otherwise("valid"))
    train = log.where("split = 'train'")
    mode = "overwrite" if overwrite else "errorifexists"
    encoding.vocabulary(encoding.token_counts(train, FIELDS), min_count).write.mode(mode).parquet(f"{out}/vocabs")
    vocab = spark.read.parquet(f"{out}/vocabs")
    sizes = {r["field"]: r["count"] for r in vocab.groupBy("field").count().collect()}
    if missing := [f for f in FIELDS if not sizes.get(f)]:
        raise ValueError(f"empty vocabulary: {', '.join(missing)}")
    norms = splitting.feature_stats(train, [*CONTINUOUS, "x", "y"]).first()
    write_split(assemble(log, vocab, history), f"{out}/data", overwrite, rows_per_file)
    rows = {r["split"]: r["count"] for r in spark.read.parquet(f"{out}/data").groupBy("split").count().collect()}
    if empty := [s for s in ("train", "valid") if not rows.get(s)]:
        raise ValueError(f"empty split: {', '.join(empty)}")
    meta = {
        "version": VERSION, "history": history, "valid_from": str(cut), "rows": rows, "vocab_sizes": {f: n + 1 for f, n in sizes.items()}, "targets": TARGETS,
        "norms": {c: {"mean": norms[f"{c}_mean"], "std": norms[f"{c}_std"]} for c in [*CONTINUOUS, "x", "y"]},
    }
    artifacts.write_json(spark, f"{out}/meta.json", meta, overwrite)
    return meta


@dataclass(frozen=True)
class Prepared:
    meta: dict
    train: DataFrame
    valid: DataFrame
    vocab: DataFrame


def load(spark: SparkSession, path: str) -> Prepared:
    """A prepared folder; another version, or a missing part, is an error."""
    meta = artifacts.read_json(spark, f"{path}/meta.json")
    if meta.get("version") != VERSION:
        raise ValueError(f"version {meta.get('version')}, not {VERSION}")
    data = spark.read.parquet(f"{path}/data")
    return Prepared(meta, *(data.where(F.col("split") == s) for s in ("train", "valid")), spark.read.parquet(f"{path}/vocabs"))


def shuffled(rows: DataFrame, keys: list[str], seed: int) -> DataFrame:
    """Rows in an order that a seed fixes, whatever their partitioning."""
    return rows.orderBy(F.xxhash64(F.lit(seed), *keys), *keys)


def evaluation_sample(rows: DataFrame, keys: list[str], share: float, seed: int) -> DataFrame:
    """The same share of rows for each evaluation of a training run, chosen by a hash of the keys."""
    return rows.where(F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(1_000_000)) < round(share * 1_000_000))
