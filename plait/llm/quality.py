"""Quality rules (operator 1): hashed n-gram log-likelihood ratio of trusted target against raw corpus.

Byte n-grams are hashed into ``buckets``.  Two multinomials are counted: one over the raw corpus (every
document), one over the trusted target.  A document's score is the sum of its n-grams' log ratios over their
number; one fixed threshold decides every document.  Simple rules (length, repeated word windows) come first.

* The target is a bounded sample of labelled good rows (``max_target``, the lowest by a hash of the id); all else covers all data.
* Null or empty texts have no words, fail the base rules, and score 0; null ids are kept and are never in the target.
* Repeated rows get the same verdict; an empty table gives no rows; extra columns are ignored.
* Without any target rows all scores are 0 and the rules alone decide.
"""

from __future__ import annotations

from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


SPACES, SYMBOLS = b" \t\n\x0b\x0c\r", b"#*$%&|<>"
#: Nats an n-gram: good text lies near 0, junk well below -1.
THRESHOLD = -0.3
FEATURES = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, score double"


def word_features(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    b = (text or "").encode("utf-8", "surrogatepass")
    ws = b.split()  # on ASCII white space alone
    lines = [x for x in b.split(b"\n") if x.strip()]
    n = len(ws)
    repeat = 0
    if n > 3:
        seen, twice = set(), set()
        for win in zip(ws, islice(ws, 1, None), islice(ws, 2, None)):
            if win in seen:
                twice.add(win)
            else:
                seen.add(win)
        if twice:
            hit = np.fromiter((w in twice for w in zip(ws, islice(ws, 1, None), islice(ws, 2, None))), bool, n - 2)
            cover = np.zeros(n, bool)
            for k in range(3):
                cover[k : n - 2 + k] |= hit
            repeat = int(cover.sum())
    return n, len(text or "") - (len(b) - len(b.translate(None, SPACES))), len(b) - len(b.translate(None, SYMBOLS)), len(lines) - len(set(lines)), repeat


def base_failed(n_words, n_repeat_words):
    return (n_words < 50) | (100 * n_repeat_words > 50 * n_words)


def ngram_buckets(data: np.ndarray, n: int, buckets: int) -> np.ndarray:
    """The bucket of each n-gram of a byte array, in order."""
    if len(data) < n:
        return np.zeros(0, "i8")
    h = np.zeros(len(data) - n + 1, "u4")
    for k in range(n):
        h *= np.uint32(0x01000193)
        h ^= data[k : len(data) - n + 1 + k]
        h *= np.uint32(0x9E3779B1)
    return (h >> np.uint32(7)) % np.uint32(buckets)


def _bytes(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode("utf-8", "surrogatepass"), "u1")


def count_ngrams(docs: DataFrame, n: int, buckets: int) -> DataFrame:
    """(bucket, raw, target) over all rows of (text, trusted); each task sends at most ``buckets`` rows to the shuffle."""

    def counted(batches):
        raw, target = np.zeros(buckets, "i8"), np.zeros(buckets, "i8")
        for b in batches:
            for text, trusted in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                c = np.bincount(ngram_buckets(_bytes(text), n, buckets), minlength=buckets)
                raw += c
                if trusted:
                    target += c
        at = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(raw[at]), pa.array(target[at])], names=["bucket", "raw", "target"])

    return docs.mapInArrow(counted, "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))


def log_ratios(counts, buckets: int, smooth: float = 0.5) -> np.ndarray:
    """log p_target - log p_raw of each bucket, smoothed; zeros without a target."""
    raw, target = np.zeros(buckets), np.zeros(buckets)
    for r in counts:
        raw[r.bucket], target[r.bucket] = r.raw, r.target
    if not target.sum():
        return np.zeros(buckets)
    p = (target + smooth) / (target.sum() + smooth * buckets)
    q = (raw + smooth) / (raw.sum() + smooth * buckets)
    return np.log(p / q)


def model(docs: DataFrame, good: DataFrame, n: int = 4, buckets: int = 1 << 15, max_target: int = 20_000) -> np.ndarray:
    """The log ratios: ``buckets`` numbers, whatever the size of the corpus."""
    ids = good.select(F.col("doc_id").cast("long").alias("_id")).where("_id is not null").distinct()
    ids = ids.orderBy(F.xxhash64("_id"), "_id").limit(max_target).withColumn("_trusted", F.lit(True))
    marked = docs.select(F.col("doc_id").cast("long").alias("_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(ids), "_id", "left")
    return log_ratios(count_ngrams(marked.select("text", "_trusted"), n, buckets).toLocalIterator(), buckets)


def _scores(text: str | None, llr: np.ndarray, n: int) -> tuple:
    g = ngram_buckets(_bytes(text), n, len(llr))
    return (*word_features(text), float(llr[g].mean()) if len(g) else 0.0)


def score(docs: DataFrame, ratios: np.ndarray, n: int = 4) -> DataFrame:
    """Each document's base figures and length-normalised score."""
    shared = docs.sparkSession.sparkContext.broadcast(ratios)

    def scored(batches):
        for b in batches:
            cols = list(zip(*(_scores(t, shared.value, n) for t in b.column(1).to_pylist()))) or [()] * 6
            names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "score"]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.int64()) for c in cols[:5]), pa.array(cols[5], pa.float64())], names=names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(scored, FEATURES)


def judge(docs: DataFrame, good: DataFrame, threshold: float = THRESHOLD, n: int = 4, **options) -> DataFrame:
    """Adds ``base_failed`` and ``kept``: the base rules, then the score against the threshold."""
    out = score(docs, model(docs, good, n, **options), n)
    failed = base_failed(F.col("n_words"), F.col("n_repeat_words"))
    return out.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("score") >= threshold))


def kept(docs: DataFrame, good: DataFrame, threshold: float = THRESHOLD, n: int = 4, **options) -> DataFrame:
    """The rows of ``docs``, all columns, that :func:`judge` keeps.  No shuffle of texts."""
    shared = docs.sparkSession.sparkContext.broadcast(model(docs, good, n, **options))
    at = docs.columns.index("text")

    def rows(batches):
        for b in batches:
            verdicts = (_scores(t, shared.value, n) for t in b.column(at).to_pylist())
            yield b.filter(pa.array([not base_failed(v[0], v[4]) and v[5] >= threshold for v in verdicts], pa.bool_()))

    return docs.mapInArrow(rows, docs.schema)
