"""Dictionary encoding: token counts, vocabularies, encode and decode joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plait.sources.scratch import written

OOV = "<OOV>"
#: A dictionary up to this many rows is broadcast; larger ones are joined by a shuffle.
MAX_BROADCAST = 1_000_000


def token_counts(rows: DataFrame, fields: list[str]) -> DataFrame:
    """(field, token, n) for several columns in one pass; null tokens are left out."""
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("token")) for f in fields]))
    return rows.select(pairs.alias("p")).select("p.*").where("token is not null").groupBy("field", "token").agg(F.count("*").alias("n"))


def vocabulary(counts: DataFrame, min_count: int = 1, prefix: int = 2) -> DataFrame:
    """(field, token, n, id): ids from 1 by count, then token; 0 stays for unknown tokens.

    Tokens are ranked among those of one count and one beginning, so that no task sorts a whole field; a running sum over the sizes of
    these groups, which are far fewer, gives each its first id."""
    group = ["field", "n", "_beginning"]
    kept = counts.where(F.col("n") >= min_count).withColumn("_beginning", F.substring("token", 1, prefix))
    earlier = Window.partitionBy("field").orderBy(F.desc("n"), "_beginning").rowsBetween(Window.unboundedPreceding, -1)
    first = kept.groupBy(*group).agg(F.count("*").alias("_size")).select(*group, F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_before"))
    rank = F.row_number().over(Window.partitionBy(*group).orderBy("token"))
    return kept.withColumn("_rank", rank).join(first, group).select("field", "token", "n", (F.col("_before") + F.col("_rank")).cast("int").alias("id"))


def small(vocab: DataFrame) -> DataFrame:
    """The dictionary, written once, and hinted for broadcast only if its counted size allows."""
    vocab = written(vocab, "vocabulary")
    return F.broadcast(vocab) if vocab.count() <= MAX_BROADCAST else vocab


def encode(rows: DataFrame, vocab: DataFrame, fields: list[str]) -> DataFrame:
    """Adds ``<field>_id``; unknown and null tokens get 0.  The vocabulary is written once, and counted once for all fields."""
    vocab = written(vocab, "vocabulary")
    sizes = {r["field"]: r["count"] for r in vocab.groupBy("field").count().collect()}
    for f in fields:
        side = vocab.where(F.col("field") == f).select(F.col("token").alias("_t"), F.col("id").alias("_i"))
        side = F.broadcast(side) if sizes.get(f, 0) <= MAX_BROADCAST else side
        rows = rows.join(side, rows[f].cast("string") == F.col("_t"), "left").withColumn(f"{f}_id", F.coalesce("_i", F.lit(0)).cast("int")).drop("_t", "_i")
    return rows


def decode(rows: DataFrame, vocab: DataFrame, field: str, id_column: str, out: str) -> DataFrame:
    """Adds the token of an id; ids outside the dictionary give ``<OOV>``."""
    side = small(vocab.where(F.col("field") == field).select(F.col("id").alias("_i"), F.col("token").alias("_t")))
    return rows.join(side, rows[id_column] == F.col("_i"), "left").withColumn(out, F.coalesce("_t", F.lit(OOV))).drop("_i", "_t")
