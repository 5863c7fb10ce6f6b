"""What the operators share: the cluster's shared folder, written intermediate tables, reading of inputs."""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plait.sources.scratch import shared_dir

REPO = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

#: White space that separates words in most contracts: space and \t \n \v \f \r.
SPACE = r"\x20\x09-\x0D"
WORD = re.compile(r"[^\x20\x09-\x0D]+")

#: Large arrays are mapped one by one, so that a worker that is kept between tasks does not keep their memory too.
WORKER_MEMORY = {"MALLOC_MMAP_THRESHOLD_": "1048576", "MALLOC_TRIM_THRESHOLD_": "8388608", "MALLOC_ARENA_MAX": "2", "ARROW_DEFAULT_MEMORY_POOL": "system"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name``; also lets the Python workers import this package, and give freed memory back."""
    env = spark.sparkContext.environment
    for k, v in WORKER_MEMORY.items():
        env.setdefault(k, v)
    if REPO not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (env.get("PYTHONPATH"), REPO) if x)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/plait-{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """``df`` written once as Parquet to the shared folder and read back: it cuts the lineage, and a lost executor costs nothing."""
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def emptied(*tables: DataFrame) -> None:
    """Overwrites ``written`` tables that nothing reads any more, so that their disk is free again."""
    for df in tables:
        if files := df.inputFiles():
            df.sparkSession.createDataFrame([], df.schema).write.mode("overwrite").parquet(os.path.dirname(files[0]))


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Inside, the shuffle files of a table go as soon as it is written, not when the driver happens to collect its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before) if before is not None else spark.conf.unset(key)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def n_words(text) -> F.Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text, null as 0, JVM-side; Spark rewrites it to the size of an array of the words."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
