"""Toxicity by compression distance (operator 7).

Two zstandard dictionaries are trained, one on ordinary and one on toxic text.  A text is cut into windows of WINDOW words;
a window's figure is how many bytes fewer it takes with the toxic dictionary than with the ordinary one (the toxic
compressor knows both, since toxic documents hold ordinary prose too), below 0 where it takes more.  Every window is compressed with both.  A
document's windows give a histogram of these figures, and a logistic calibration of it gives the score; the threshold is on that score.

Before compression each byte of a word is replaced by four bytes that hash the word up to and with it: matches then start at
word starts only, and weigh more than the cost of a sequence.  Labels are by document, yet most
windows of a toxic document are ordinary: after a first toxic dictionary, trained on whole toxic documents, the next ones
are trained on the words that the last one, from the other half of the documents, sets apart from ordinary words.

* Training takes a bounded sample of labelled rows (``max_toxic``, ``max_ordinary``, the lowest by a hash of the id); the
  dictionaries see at most ``max_words`` words of each, in windows spread evenly over its whole text.  They are
  trained in tasks, and so are the histograms of the sampled rows' whole texts; only dictionaries and histograms reach the driver.
* Scoring covers every whole text.  Null or empty texts have no windows: their score is that of an empty histogram.  Null ids are kept.
* Repeated rows score alike; an empty table gives no rows; extra columns are ignored.
* Without both classes among the labelled rows the score is 0.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterable
from dataclasses import dataclass
from functools import lru_cache
from operator import sub

import numpy as np
import pyarrow as pa
import zstandard as zs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plait.llm.darts import SpanHasher
from plait.llm.shared import written

WINDOW, WIDTH, CHUNK = 4, 4, 1 << 14
#: A histogram's bounds: figures of at least 1 to UP, and of at most -1 to -DOWN; what lies beyond counts in the last.
UP, DOWN = 20, 4
_SPANS = SpanHasher()
SCORES = "doc_id long, score double, predicted int"


def words(text: str | None) -> list[bytes]:
    return (text or "").lower().encode("utf-8", "surrogatepass").split()


def coded(ws: list[bytes]) -> tuple[bytes, list[int]]:
    """The words' codes, WIDTH bytes for each byte of a word, and where each word ends."""
    data, sizes = np.frombuffer(b"".join(ws), "u1"), np.array([len(w) for w in ws], "i8")
    ends = np.cumsum(sizes)
    h = _SPANS(data, np.repeat(ends - sizes, sizes), np.arange(1, len(data) + 1))
    return (h >> np.uint64(32)).astype("<u4").tobytes(), [0, *(WIDTH * ends).tolist()]


def _compressor(content: bytes) -> zs.ZstdCompressor:
    p = zs.ZstdCompressionParameters.from_level(
        3, format=zs.FORMAT_ZSTD1_MAGICLESS if hasattr(zs, "FORMAT_ZSTD1_MAGICLESS") else zs.FORMAT_ZSTD1,
        write_content_size=False, write_checksum=False, write_dict_id=False,
        min_match=6, strategy=zs.STRATEGY_BTLAZY2, window_log=18, search_log=8, hash_log=16, chain_log=17, target_length=64,
    )
    d = zs.ZstdCompressionDict(content, dict_type=zs.DICT_TYPE_RAWCONTENT)
    d.precompute_compress(compression_params=p)
    return zs.ZstdCompressor(dict_data=d, compression_params=p)


@dataclass(frozen=True)
class Dictionaries:
    ordinary: bytes
    toxic: bytes


class Distance:
    """Figures of windows under two dictionaries; remembers at most ``limit`` windows."""

    def __init__(self, d: Dictionaries, limit: int = 50_000):
        self.compressors, self.known, self.limit = (_compressor(d.ordinary), _compressor(d.toxic + d.ordinary)), {}, limit

    def of(self, windows: list[bytes]) -> list[int]:
        """The windows' figures.  New ones are compressed by one call a dictionary, which costs less than a call a window."""
        out = []
        for at in range(0, len(windows), CHUNK):
            some = windows[at : at + CHUNK]
            new = [w for w in dict.fromkeys(some) if w not in self.known]
            if len(self.known) + len(new) > self.limit:
                self.known.clear()
                new = list(dict.fromkeys(some))
            if new:
                plain, toxic = ([len(x) for x in c.multi_compress_to_buffer(new)] for c in self.compressors)
                self.known.update(zip(new, map(sub, plain, toxic)))
            out += map(self.known.__getitem__, some)
        return out

    def figures(self, texts: Iterable[list[bytes]]) -> list[np.ndarray]:
        """Figures of all windows of each text, a list of words; windows of many texts are compressed together."""
        counts, windows, out = [0], [], []
        for ws in texts:
            counts.append(0)
            for at in range(0, len(ws), CHUNK):
                code, ends = coded(ws[at : at + CHUNK])
                cuts = [*ends[::WINDOW], *ends[-1:]] if (len(ends) - 1) % WINDOW else ends[::WINDOW]
                windows += [code[a:b] for a, b in zip(cuts, cuts[1:])]
                counts[-1] += len(cuts) - 1
                if len(windows) >= CHUNK:
                    out += self.of(windows)
                    windows = []
        out, ends = np.array(out + self.of(windows), "i8"), np.cumsum(counts)
        return [out[a:b] for a, b in zip(ends, ends[1:])]


def histogram(v: np.ndarray) -> np.ndarray:
    """How many of a text's figures reach each bound of the histogram, as logarithms and as shares, and a constant."""
    reach = lambda x, most: np.cumsum(np.bincount(np.clip(x, 0, most), minlength=most + 1)[::-1])[::-1][1:]
    n = np.concatenate([reach(v, UP), reach(-v, DOWN)])
    return np.concatenate([np.log1p(n), 10 * np.sqrt(n / max(1, len(v))), [1.0]])


@dataclass(frozen=True)
class Model:
    dictionaries: Dictionaries | None
    weights: tuple[float, ...] = ()

    def scores(self, texts: pa.Array, distance: Distance | None) -> list[float]:
        if self.dictionaries is None:
            return [0.0] * len(texts)
        z = [float(np.dot(self.weights, histogram(v))) for v in distance.figures(words(t.as_py()) for t in texts)]
        return [1 / (1 + math.exp(-max(-30.0, min(30.0, x)))) for x in z]


def spread(ws: list[bytes], most: int) -> list[bytes]:
    """At most ``most`` words: windows at even distances over the whole text."""
    n, take = -(-len(ws) // WINDOW), most // WINDOW
    return ws if n <= take else [w for i in range(take) for w in ws[(i * n // take) * WINDOW :][:WINDOW]]


def _trained(samples: list[bytes], size: int) -> bytes:
    """zstandard's trainer; with too few samples for it, the samples themselves."""
    try:
        return zs.train_dictionary(size, samples, k=32, d=8).as_bytes()
    except zs.ZstdError:
        return b"".join(samples)[-size:]


def half(ws: list[bytes], bit: int) -> int:
    """One of two halves; texts that begin alike share it."""
    return zlib.crc32(b" ".join(ws[:50])) >> bit & 1


def train_dictionaries(docs: list[bytes], toxic: list[int], rounds: int = 2, share: float = 0.005, sizes=(110_000, 16_384), most_ordinary: int = 600_000) -> Dictionaries:
    """The two dictionaries.  In each round a word of a toxic document goes to the next training where the dictionary from
    the other half of the toxic documents saves more on it than on all but ``share`` of the ordinary words.  The ordinary dictionary is trained
    on at most ``most_ordinary`` words, as many from each row.  ``docs``: texts of words parted by spaces."""
    ordinary = [d for d, y in zip(docs, toxic) if not y and d]
    bad = [(half(d.split(), 1), code, np.array(ends, "i4")) for d, y in zip(docs, toxic) if y and d for code, ends in [coded(d.split())]]
    each = max(WINDOW, most_ordinary // max(1, len(ordinary)))
    known = _trained([coded(spread(d.split(), each))[0] for d in ordinary], sizes[0])
    plain = sorted({b[i:j] for d in ordinary for b, ends in [coded(spread(d.split(), 200))] for i, j in zip(ends, ends[1:])})
    samples = {h: [b for g, b, _ in bad if g == h] for h in (0, 1)}
    for _ in range(rounds):
        chosen = {}
        for h in (0, 1):
            figures = Distance(Dictionaries(known, _trained(samples[1 - h], sizes[1]))).of
            cut = max(1, np.quantile(figures(plain), 1 - share)) if plain else 1
            found = [b[i:j] for g, b, ends in bad if g == h for i, j in zip(ends, ends[1:])]
            chosen[h] = [x for x, v in zip(found, figures(found)) if v > cut]
        samples = chosen
    return Dictionaries(known, _trained(samples[0] + samples[1], sizes[1]))


def calibrated(x: np.ndarray, y: np.ndarray) -> tuple[float, ...]:
    """Weights of a ridge-penalised logistic regression by Newton's method; the last column is the constant."""
    w, ridge = np.zeros(x.shape[1]), np.eye(x.shape[1])
    ridge[-1, -1] = 1e-6
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x.T * (p * (1 - p) + 1e-9)) @ x + ridge, x.T @ (p - y) + ridge @ w)
        w -= step
        if np.abs(step).max() < 1e-7:
            break
    return tuple(w.tolist())


def train(docs: DataFrame, labels: DataFrame, max_toxic: int = 3000, max_ordinary: int = 6000, max_words: int = 400) -> Model:
    """Fits on at most ``max_toxic + max_ordinary`` labelled rows.

    Three pairs of dictionaries are trained in three tasks: from each half of the rows, and from all.  The calibration is
    fitted on histograms of whole texts under the pair from the other half, which has not seen them; the pair from all rows scores."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic in (0, 1)").dropDuplicates(["doc_id"])
    order = F.xxhash64("doc_id")
    ids = known.where("toxic = 1").orderBy(order, "doc_id").limit(max_toxic).union(known.where("toxic = 0").orderBy(order, "doc_id").limit(max_ordinary))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(ids), "doc_id")
    rows = written(rows.groupBy("doc_id", "toxic").agg(F.min("text").alias("text")), "labelled")

    def cut(batches):
        for b in batches:
            parts, samples = [], []
            for t in b.column(2):  # one text at a time: lists of words take many times their bytes
                ws = words(t.as_py())
                parts.append(half(ws, 0))
                samples.append(b" ".join(spread(ws, max_words)))
            cols = [b.column(0), b.column(1), pa.array(parts, pa.int32()), pa.array(samples, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "toxic", "half", "sample"])

    def fitted(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        table = table.sort_by("doc_id")
        docs_, toxic = table["sample"].to_pylist(), table["toxic"].to_pylist()
        both = len({y for d, y in zip(docs_, toxic) if d}) == 2
        d = train_dictionaries(docs_, toxic) if both else None
        return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "ordinary": pa.array([d and d.ordinary], pa.binary()), "toxic": pa.array([d and d.toxic], pa.binary())})

    samples = rows.mapInArrow(cut, "doc_id long, toxic int, half int, sample binary")
    parts = F.explode(F.array(F.col("half"), F.lit(2))).alias("part")  # 2: all rows
    pairs = samples.select("doc_id", "toxic", "sample", parts).groupBy("part").applyInArrow(fitted, "part int, ordinary binary, toxic binary")
    by_part = {r.part: Dictionaries(bytes(r.ordinary), bytes(r.toxic)) for r in pairs.collect() if r.toxic is not None}
    if 2 not in by_part:
        return Model(None)

    def histograms(batches):
        pairs = {p: Distance(d) for p, d in by_part.items()}
        for b in batches:
            h = [histogram(pairs.get(1 - half(x, 0), pairs[2]).figures([x])[0]).tolist() for x in (words(t.as_py()) for t in b.column(2))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(h, pa.list_(pa.float64()))], names=["doc_id", "toxic", "histogram"])

    found = sorted(rows.mapInArrow(histograms, "doc_id long, toxic int, histogram array<double>").collect())
    return Model(by_part[2], calibrated(np.array([r.histogram for r in found]), np.array([r.toxic for r in found], float)))


@lru_cache(maxsize=2)
def _distance(dictionaries: Dictionaries) -> Distance:
    return Distance(dictionaries)


def score(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """Every document's score, and whether it reaches the threshold."""

    def scored(batches):
        distance = _distance(model.dictionaries) if model.dictionaries else None
        for b in batches:
            s = model.scores(b.column(1), distance)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s, pa.float64()), pa.array([int(v >= threshold) for v in s], pa.int32())], names=["doc_id", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(scored, SCORES)


def kept(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """The rows of ``docs``, all columns, whose score stays below the threshold.  No shuffle."""
    at = docs.columns.index("text")

    def rows(batches):
        distance = _distance(model.dictionaries) if model.dictionaries else None
        for b in batches:
            yield b.filter(pa.array([v < threshold for v in model.scores(b.column(at), distance)], pa.bool_()))

    return docs.mapInArrow(rows, docs.schema)


def held_out(doc_id) -> F.Column:
    """crc32 of the id as text, mod 3, is 1."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))
