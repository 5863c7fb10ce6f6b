"""Intermediate tables in the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: The folder of each application whose session names none.
_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; where that is unset, a new folder under /tmp on one machine (one for each application), an error on a cluster."""
    context = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not path:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = _OWN.get(context.applicationId) or tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        _OWN[context.applicationId] = path
    return path.rstrip("/")


def written(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """``df`` written once as Parquet (a folder for each value of ``by``) and read back: it cuts the lineage, and a lost executor costs nothing."""
    path = f"{shared_dir(df.sparkSession)}/plait-{name}-{uuid.uuid4().hex}"
    out = df.write.option("compression", "zstd")
    (out.partitionBy(by) if by else out).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
