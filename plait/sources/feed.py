"""Fixed-size batches of Parquet rows for a trainer: every row once an epoch, in an order that a seed fixes.

Files are shuffled, then the blocks of each file (``block`` rows that stand together in it), then the rows of a block, so that a batch mixes rows without a sort of the
whole table: places follow from the counts of files and blocks, and only the rows of a block are ranked together."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plait.session import importable

_FILE, _ROW, _BLOCK = "_file", "_row", "_block"


def placed(spark: SparkSession, path: str | list[str], columns: list[str], size: int, seed: int | None = None, epoch: int = 0, block: int = 65_536, within: bool = True) -> DataFrame:
    """``columns``, with ``position`` (from 0, gapless) and ``batch`` (of ``size`` rows, the last one shorter).

    Without a ``seed`` rows come by file name and place in the file.  ``within`` false keeps the order of a block's rows."""
    if size <= 0:
        raise ValueError("size must be positive")
    paths = [path] if isinstance(path, str) else path
    rows = spark.read.parquet(*paths).select(*columns, F.col("_metadata.file_path").alias(_FILE), F.col("_metadata.row_index").alias(_ROW)).withColumn(_BLOCK, F.floor(F.col(_ROW) / block))
    drawn = lambda *c: F.xxhash64(F.lit(seed), F.lit(epoch), *c) if seed is not None else F.lit(0)
    blocks = rows.groupBy(_FILE, _BLOCK).agg(F.count("*").alias("n"))
    files = blocks.groupBy(_FILE).agg(F.sum("n").alias("n"))
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    files = files.select(F.col(_FILE).alias("_f"), before(Window.orderBy(drawn(_FILE), _FILE)).alias("_files"))
    starts = blocks.select(F.col(_FILE).alias("_bf"), F.col(_BLOCK).alias("_bb"), before(Window.partitionBy(_FILE).orderBy(drawn(_FILE, _BLOCK), _BLOCK)).alias("_blocks"))
    starts = starts.join(files, F.col("_bf") == F.col("_f")).select("_bf", "_bb", (F.col("_files") + F.col("_blocks")).alias("_start"))
    order = [drawn(_FILE, _ROW), F.col(_ROW)] if within else [F.col(_ROW)]
    rank = F.row_number().over(Window.partitionBy(_FILE, _BLOCK).orderBy(*order)) - 1
    position = (F.col("_start") + F.col("_rank")).cast("long")
    out = rows.withColumn("_rank", rank).join(starts, (F.col(_FILE) == F.col("_bf")) & (F.col(_BLOCK) == F.col("_bb"))).withColumn("position", position)
    return out.select(*columns, "position", F.floor(F.col("position") / size).alias("batch"))


def map_batches(rows: DataFrame, function, schema: str) -> DataFrame:
    """``function`` (an Arrow table to an Arrow table) of each batch of :func:`placed`, its rows in order; batches run in parallel."""
    importable(rows.sparkSession)
    return rows.groupBy("batch").applyInArrow(lambda t: function(t.sort_by("position")), schema)


def iterate(rows: DataFrame, size: int):
    """The batches in order, as Arrow tables without ``position`` and ``batch``, for a trainer outside of Spark; one partition at a time is fetched."""
    from pyspark.sql.pandas.types import to_arrow_schema

    ordered = rows.orderBy("position").drop("position", "batch")
    schema, waiting = to_arrow_schema(ordered.schema), []
    for r in ordered.toLocalIterator():
        waiting.append(r.asDict(recursive=True))
        if len(waiting) == size:
            yield pa.Table.from_pylist(waiting, schema)
            waiting = []
    if waiting:
        yield pa.Table.from_pylist(waiting, schema)
