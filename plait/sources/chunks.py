"""Chunked ingest: date windows, validated multi-file scans, split sinks."""

from __future__ import annotations

import datetime as dt
import json
import time
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from plait.sources import artifacts


def date_chunks(spark: SparkSession, start: str, end: str, days: int) -> DataFrame:
    """(chunk_start, chunk_end): inclusive windows of ``days`` days, the last one clipped."""
    if days <= 0:
        raise ValueError("days must be positive")
    if dt.date.fromisoformat(end) < dt.date.fromisoformat(start):
        raise ValueError("end lies before start")
    one = spark.range(1).select(F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"), F.make_interval(days=F.lit(days)))).alias("chunk_start"))
    return one.select("chunk_start", F.least(F.date_add("chunk_start", days - 1), F.lit(end).cast("date")).alias("chunk_end"))


def _schema_of(spark: SparkSession, path: str, attempts: int, wait: float) -> StructType | str:
    """A file's schema, or why it cannot be read after so many attempts, each after twice the wait."""
    for i in range(attempts):
        try:
            return spark.read.parquet(path).schema
        except Exception as e:  # an unreadable footer or a store that is away, whatever the reader says of it
            reason = f"unreadable: {type(e).__name__}"
            if i + 1 < attempts:
                time.sleep(wait * 2**i)
    return reason


def scan_chunks(spark: SparkSession, paths: list[str], schema: StructType, report: str | None = None, attempts: int = 1, wait: float = 1.0, at_once: int = 16) -> DataFrame:
    """One DataFrame over the readable files that have all columns of ``schema``; the others go to the ``report``.

    Footers are read ``at_once`` at a time; files of one schema are one scan, cast to ``schema``, so chunks written empty
    (with other types) fit too.  No readable file is an error."""
    with ThreadPoolExecutor(at_once) as pool:
        found = list(pool.map(lambda p: _schema_of(spark, p, attempts, wait), paths))
    groups, skipped = {}, []
    for path, has in zip(paths, found):
        missing = [] if isinstance(has, str) else [f.name for f in schema if f.name not in has.names]
        if isinstance(has, str) or missing:
            skipped.append({"path": path, "reason": has if isinstance(has, str) else f"missing columns: {', '.join(missing)}"})
        else:
            groups.setdefault(has.json(), []).append(path)
    if report:
        artifacts.write_json(spark, report, skipped, overwrite=True)
    if not groups:
        raise ValueError("no readable file")
    scans = [spark.read.schema(StructType.fromJson(json.loads(k))).parquet(*g).select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in schema]) for k, g in groups.items()]
    return reduce(DataFrame.unionByName, scans)


def write_empty(spark: SparkSession, schema: StructType, path: str) -> None:
    """A chunk without rows whose names and types are stable."""
    spark.createDataFrame([], schema).write.parquet(path)


def write_split(rows: DataFrame, path: str, overwrite: bool = False, rows_per_file: int = 0) -> None:
    """Parquet partitioned by ``split``, zstd; an existing folder is an error unless ``overwrite``."""
    w = rows.write.mode("overwrite" if overwrite else "errorifexists").partitionBy("split").option("compression", "zstd")
    (w.option("maxRecordsPerFile", rows_per_file) if rows_per_file else w).parquet(path)


def missing_chunks(spark: SparkSession, chunks: DataFrame, folder: str) -> DataFrame:
    """Chunks that have no file ``events_<start>_<end>`` in the folder yet: a resumed download."""
    have = spark.createDataFrame([(x,) for x in artifacts.names(spark, folder)], "name string")
    name = F.concat(F.lit("events_"), F.col("chunk_start").cast("string"), F.lit("_"), F.col("chunk_end").cast("string"), F.lit(".parquet"))
    return chunks.withColumn("name", name).join(have, "name", "left_anti")
