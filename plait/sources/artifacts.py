"""Artifacts beside the tables: JSON sidecars, metric logs, traces, profiles, reports, fitted models and runs.

All go through Spark's readers and writers or Hadoop's file systems, so that any store will do that the cluster knows."""

from __future__ import annotations

import datetime as dt
import json

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def names(spark: SparkSession, folder: str) -> list[str]:
    """What lies in a folder, sorted; a missing folder is empty."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(x.getPath().getName() for x in fs.listStatus(path)) if fs.exists(path) else []


def write_json(spark: SparkSession, path: str, value, overwrite: bool = False) -> None:
    """One JSON value with sorted keys; an existing artifact is an error unless ``overwrite``."""
    line = spark.createDataFrame([(json.dumps(value, sort_keys=True),)], "value string")
    line.coalesce(1).write.mode("overwrite" if overwrite else "errorifexists").text(path)


def read_json(spark: SparkSession, path: str):
    if not names(spark, path):
        raise FileNotFoundError(path)
    return json.loads("".join(r.value for r in spark.read.text(path).collect()))


def log_event(spark: SparkSession, path: str, event: str, **fields) -> None:
    """Appends one line ``{"ts", "event", ...}`` to a metrics log."""
    line = json.dumps({"ts": dt.datetime.now(dt.timezone.utc).isoformat(), "event": event, **fields}, sort_keys=True)
    spark.createDataFrame([(line,)], "value string").coalesce(1).write.mode("append").text(path)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path).orderBy("ts")


def write_profile(profile: DataFrame, path: str, overwrite: bool = False) -> None:
    """zstd Parquet; a profile without rows is an error."""
    profile.write.mode("overwrite" if overwrite else "errorifexists").option("compression", "zstd").parquet(path)
    if read_profile(profile.sparkSession, path).isEmpty():
        raise ValueError("the profile has no group of the least size")


def read_profile(spark: SparkSession, path: str) -> DataFrame:
    if not names(spark, path):
        raise FileNotFoundError(path)
    return spark.read.parquet(path)


def write_report(spark: SparkSession, folder: str, parts: dict[str, DataFrame], most: int = 100_000, overwrite: bool = False) -> dict:
    """One JSON file for each part (metrics, slices, baselines) and ``report`` with all.  A part over ``most`` rows is no summary: an error."""
    report = {}
    for name, rows in parts.items():
        got = rows.limit(most + 1).toJSON().collect()
        if len(got) > most:
            raise ValueError(f"{name} has over {most} rows")
        report[name] = sorted((json.loads(x) for x in got), key=lambda r: json.dumps(r, sort_keys=True))
    for name, value in {**report, "report": report}.items():
        write_json(spark, f"{folder}/{name}.json", value, overwrite)
    return report


def write_trace(events: DataFrame, path: str, order: list[str], most: int | None = None, overwrite: bool = False) -> None:
    """JSON lines, nulls kept; ``most`` takes the first events by ``order``."""
    rows = events.orderBy(*order).limit(most) if most is not None else events
    rows.write.mode("overwrite" if overwrite else "errorifexists").option("ignoreNullFields", "false").json(path)


def read_trace(spark: SparkSession, path: str, schema: StructType, game: int | None = None) -> DataFrame:
    """The events of one game.  A line that is no JSON object is an error, and so is a trace of several games when none is chosen."""
    bad = "_corrupt"
    rows = spark.read.schema(StructType(list(schema)).add(bad, "string")).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", bad).json(path)
    broken = rows.where(F.col(bad).isNotNull()).select(schema[0].name, bad).first()  # the reader refuses the last column alone
    if broken:
        raise ValueError(f"not an event: {broken[bad][:200]}")
    rows = rows.drop(bad)
    if game is not None:
        return rows.where(F.col("game") == game)
    if rows.select("game").distinct().limit(2).count() > 1:
        raise ValueError("the trace holds several games; choose one")
    return rows


def save_if_better(spark: SparkSession, run: str, model, loss: float, **fields) -> bool:
    """Keeps the model of the least loss under ``checkpoints/best``, and logs every loss.  ``model``: a PipelineModel, or one with ``save(spark, path, overwrite)``."""
    log, best = f"{run}/metrics", f"{run}/checkpoints/best"
    before = spark.read.json(log).where("event = 'valid'").agg(F.min("loss")).first()[0] if names(spark, log) else None
    better = before is None or loss < before
    if better:
        model.write().overwrite().save(best) if hasattr(model, "write") else model.save(spark, best, overwrite=True)
    log_event(spark, log, "valid", loss=loss, best=better, **fields)
    return better


def resolve_run(spark: SparkSession, runs: str, run_id: str | None = None) -> str:
    """The folder of a run that has a best model: that named, or the last by name."""
    done = [x for x in names(spark, runs) if "best" in names(spark, f"{runs}/{x}/checkpoints")]
    if run_id is not None and run_id not in done or not done:
        raise FileNotFoundError(f"{runs}/{run_id or '*'}/checkpoints/best")
    return f"{runs}/{run_id or done[-1]}"


def export_run(spark: SparkSession, run: str, prepared: str, out: str) -> None:
    """Model, metrics, meta data and vocabularies in one new folder."""
    if names(spark, out):
        raise FileExistsError(out)
    best = f"{run}/checkpoints/best"
    if "weights" in names(spark, best):
        spark.read.parquet(f"{best}/weights").coalesce(1).write.parquet(f"{out}/model/weights")
        write_json(spark, f"{out}/model/shape.json", read_json(spark, f"{best}/shape.json"))
        for f in names(spark, f"{best}/identities"):
            spark.read.parquet(f"{best}/identities/{f}").write.parquet(f"{out}/model/identities/{f}")
    else:
        PipelineModel.load(best).save(f"{out}/model")
    spark.read.text(f"{run}/metrics").coalesce(1).write.text(f"{out}/metrics")
    write_json(spark, f"{out}/meta.json", read_json(spark, f"{prepared}/meta.json"))
    spark.read.parquet(f"{prepared}/vocabs").write.parquet(f"{out}/vocabs")
