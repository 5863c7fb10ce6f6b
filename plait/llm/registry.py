"""Queries of this subpackage: ``opN_<name>`` and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plait.llm import dac, hard_negatives, images, licenses, mixing, near_dups, packing, quality, ranked_search, simhash, site_trees, toxicity, urls
from plait.llm.shared import table


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").where("quality = 1"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies", "rate")


def op3_token_dac(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dac.round_trip(table(spark, sf_dir, "documents"))


def op4_image_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("image_id"), F.col("embedding").alias("image"))
    return images.classes(vectors, images.from_vector)


def op5_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return site_trees.extract(table(spark, sf_dir, "pages"))


def op6_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dups.classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.train(docs, labels.where(~toxicity.held_out("doc_id")))
    out = toxicity.score(docs, model, threshold=0.7)
    return out.select("doc_id", toxicity.held_out("doc_id").alias("held_out"), "score", "predicted")


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def op11_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.classes(table(spark, sf_dir, "documents"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = hard_negatives.quantised(table(spark, sf_dir, "embeddings"))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(q.withColumn("label", label), F.col("vec_id") % 100 == 0)


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality": op1_quality,
    "op2_mixing": op2_mixing,
    "op3_token_dac": op3_token_dac,
    "op4_image_copies": op4_image_copies,
    "op5_main_text": op5_main_text,
    "op6_near_dups": op6_near_dups,
    "op7_toxicity": op7_toxicity,
    "op8_url_filter": op8_url_filter,
    "op9_packing": op9_packing,
    "op10_licenses": op10_licenses,
    "op11_simhash": op11_simhash,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_ranked_search": op13_ranked_search,
}

_TERMS = "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"

SQL: dict[str, str] = {
    "op12_hard_negatives": """WITH fine AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
 score AS (SELECT a.vec_id AS anchor_id, r.vec_id AS row_id, a.label = r.label AS same, CAST(list_inner_product(a.q, r.q) AS BIGINT) AS s FROM fine a JOIN fine r ON a.vec_id <> r.vec_id WHERE a.vec_id % 100 = 0),
 pos AS (SELECT anchor_id, row_id AS positive_id, s AS positive_score FROM score WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY s DESC, row_id) <= 5)
 SELECT pos.anchor_id, positive_id, CAST(row_number() OVER w AS INT) AS rank, row_id AS negative_id, positive_score, s AS negative_score FROM pos JOIN score ON score.anchor_id = pos.anchor_id AND NOT same
  AND 80 * positive_score <= 100 * s AND s <= positive_score WINDOW w AS (PARTITION BY pos.anchor_id, positive_id ORDER BY s DESC, row_id) QUALIFY row_number() OVER w <= 5""",
    "op13_ranked_search": f"""WITH words AS (SELECT row_number() OVER () AS doc, doc_id, unnest({_TERMS}) AS term FROM documents),
 tf AS (SELECT doc, doc_id, term, count(*) AS tf FROM words GROUP BY ALL),
 n AS (SELECT doc, CAST(sum(tf) AS BIGINT) AS n FROM tf GROUP BY doc), total AS (SELECT count(*) AS nn, CAST(sum(n) AS BIGINT) AS l FROM n),
 asked AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark),
 w AS (SELECT term, CAST(floor(1000 * ln((2 * nn + 2) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM tf, total GROUP BY term, nn),
 score AS (SELECT item_id, doc, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * nn) // l)))) AS BIGINT) AS score FROM asked JOIN tf USING (term) JOIN w USING (term) JOIN n USING (doc), total GROUP BY ALL)
 SELECT item_id, CAST(row_number() OVER o AS INT) AS rank, doc_id, score FROM score WHERE score > 0 WINDOW o AS (PARTITION BY item_id ORDER BY score DESC, doc_id) QUALIFY row_number() OVER o <= 50""",
}
