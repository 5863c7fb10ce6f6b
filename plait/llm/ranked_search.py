"""Ranked lexical search by a hierarchical max tree and best-first branch-and-bound (operator 13).

Documents are scanned once.  Each task cuts its stream into shards of ``shard`` documents and keeps, for every document,
the counts of those terms that some item asks for; counts of documents and terms are summed over all shards.  A term's best
contribution in a range of documents is the leaf of a tree whose upper nodes are wider ranges, up to whole shards.

An item starts at the top, in Spark: the shard with the highest sum of its terms' maxima is searched first and gives the
score that the rest must reach; only shards whose sum reaches it are searched after.  Within a shard the search goes on by
a heap of ranges: the one with the highest sum is opened, down to leaves whose documents are scored, until no range
reaches the item's k-th score.  Ranges with a sum equal to it are opened, for ties go by the smaller doc_id.

* null and empty texts have no terms and are never returned; an item without terms has no rows.
* items that share an id are one item with the terms of all; each term counts once.
* repeated documents count and are ranked one by one; a null doc_id comes last among equal scores.
* items are worked on in blocks of at most ``max_terms`` terms (an item that has more is a block of its own), so that what is
  sent to the tasks is bounded.  Empty tables give no rows; extra columns are ignored.
"""

from __future__ import annotations

import heapq
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plait.llm.near_dups import light
from plait.llm.shared import written

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bytes of a text as those of its terms: A-Z lower-cased, other ASCII but digits and letters as spaces.
_BYTES = bytes(x if x >= 0x80 or chr(x).isalnum() and chr(x) not in UPPER else (x + 32 if chr(x) in UPPER else 32) for x in range(256))
LEAF, FAN = 64, 8  # documents of a leaf range, children of a node
SHARD = "shard long, docs long, terms long, doc_id array<long>, n array<long>, at array<int>, term array<int>, tf array<int>"


def asked(items: DataFrame) -> DataFrame:
    """(item_id, term): the distinct terms of each item."""
    words = F.regexp_extract_all(F.translate(F.col("text").cast("string"), UPPER, LOWER), F.lit(TERM), F.lit(0))
    return items.select(F.col("item_id").cast("long").alias("item_id"), F.explode(words).alias("term")).distinct()


def blocks(terms: DataFrame, max_terms: int) -> list[list]:
    """The items' ids in blocks of at most ``max_terms`` terms together.  Only ids and sizes come to the driver."""
    out, room = [], 0
    for r in terms.groupBy("item_id").agg(F.count("*").alias("n")).orderBy("item_id").toLocalIterator():
        if not out or r.n > room:
            out.append([])
            room = max_terms
        out[-1].append(r.item_id)
        room -= r.n
    return out


def index(docs: DataFrame, vocabulary: dict[bytes, int], shard: int) -> DataFrame:
    """Shards of the documents: their number of documents and terms, and the term counts of those that hold a term of ``vocabulary``."""
    known = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def scan(batches):
        from pyspark import TaskContext

        part, number, words_of = TaskContext.get().partitionId(), 0, known.value
        new = lambda: {"docs": 0, "terms": 0, "doc_id": [], "n": [], "at": [0], "term": [], "tf": []}
        now, seen = new(), 0

        def out():
            row = {"shard": part << 32 | number, **now}
            return pa.RecordBatch.from_pylist([row], pa.schema([("shard", pa.int64()), ("docs", pa.int64()), ("terms", pa.int64()), ("doc_id", pa.list_(pa.int64())), ("n", pa.list_(pa.int64())), ("at", pa.list_(pa.int32())), ("term", pa.list_(pa.int32())), ("tf", pa.list_(pa.int32()))]))

        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1)):
                words = text.as_py().translate(_BYTES).split() if text.is_valid else []
                if not words:
                    continue
                counts = Counter(words)
                hits = [(words_of[w], c) for w, c in counts.items() if w in words_of]
                now["docs"] += 1
                now["terms"] += len(words)
                seen += 1
                if hits:
                    now["doc_id"].append(doc_id)
                    now["n"].append(len(words))
                    now["term"].extend(h[0] for h in hits)
                    now["tf"].extend(h[1] for h in hits)
                    now["at"].append(len(now["term"]))
                if seen == shard:
                    yield out()
                    now, seen, number = new(), 0, number + 1
        if seen:
            yield out()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text")).mapInArrow(scan, SHARD)


class Tree:
    """One shard: contributions of its postings, and the highest of each term by ranges of ``LEAF``, ``LEAF * FAN``, ... documents."""

    def __init__(self, t: pa.Table, weights: np.ndarray, n_docs: int, n_terms: int):
        col = lambda c: t.column(c)[0].values
        ids = col("doc_id")
        self.null = ids.is_null().to_numpy(zero_copy_only=False)
        self.ids = ids.fill_null(np.iinfo("i8").max).to_numpy(zero_copy_only=False)
        self.at, term, tf, n = (col(c).to_numpy(zero_copy_only=False).astype("i8") for c in ("at", "term", "tf", "n"))
        self.doc = np.repeat(np.arange(len(ids)), np.diff(self.at))
        m = 100 - 50 + (50 * n * n_docs) // n_terms
        self.gain = weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 20 * m[self.doc]))
        self.terms, self.term = np.unique(term, return_inverse=True)
        width = max(1, -(-len(ids) // LEAF))
        low = np.zeros((len(self.terms), width), "i8")
        np.maximum.at(low, (self.term, self.doc // LEAF), self.gain)
        self.levels = [low]
        while self.levels[-1].shape[1] > 1:
            x = self.levels[-1]
            pad = np.pad(x, ((0, 0), (0, -x.shape[1] % FAN)))
            self.levels.append(pad.reshape(len(x), -1, FAN).max(axis=2))

    def rows(self, terms: np.ndarray) -> np.ndarray:
        """Places of those of ``terms`` (sorted) that the shard holds."""
        at = np.searchsorted(self.terms, terms)
        ok = at < len(self.terms)
        return at[ok][self.terms[at[ok]] == terms[ok]]

    def bound(self, terms: np.ndarray) -> int:
        return int(self.levels[-1][self.rows(terms), 0].sum())

    def search(self, terms: np.ndarray, k: int, floor: int) -> tuple[np.ndarray, np.ndarray]:
        """(places, scores) of the shard's ``k`` best documents with a score of at least ``floor`` and above 0."""
        rows = self.rows(terms)
        wanted = np.zeros(len(self.terms), bool)
        wanted[rows] = True
        floor, top = max(floor, 1), len(self.levels) - 1
        heap = [(-int(self.levels[top][rows, 0].sum()), top, 0)]
        docs, scores = np.zeros(0, "i8"), np.zeros(0, "i8")
        while heap and -heap[0][0] >= floor:
            _, level, node = heapq.heappop(heap)
            if level:
                first = node * FAN
                sums = self.levels[level - 1][rows, first : first + FAN].sum(axis=0)
                for c in np.flatnonzero(sums >= floor).tolist():
                    heapq.heappush(heap, (-int(sums[c]), level - 1, first + c))
                continue
            lo, hi = node * LEAF, min((node + 1) * LEAF, len(self.ids))
            span = slice(self.at[lo], self.at[hi])
            hit = wanted[self.term[span]]
            got = np.zeros(hi - lo, "i8")
            np.add.at(got, self.doc[span][hit] - lo, self.gain[span][hit])
            good = np.flatnonzero(got >= floor)
            docs, scores = np.concatenate([docs, good + lo]), np.concatenate([scores, got[good]])
            if len(scores) > k:
                floor = max(floor, int(np.partition(scores, len(scores) - k)[len(scores) - k]))
                docs, scores = docs[scores >= floor], scores[scores >= floor]
        order = np.lexsort((self.ids[docs], self.null[docs], -scores))[:k]
        return docs[order], scores[order]


def ranked(rows: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search_block(docs: DataFrame, terms: DataFrame, k: int, shard: int) -> DataFrame:
    """The ``k`` best documents for each item of one block, as a written table: item_id, rank, doc_id, score."""
    spark = docs.sparkSession
    names = sorted(r.term for r in terms.select("term").distinct().toLocalIterator())
    ids = {t: i for i, t in enumerate(names)}
    of_item: dict = {}
    for r in terms.toLocalIterator():
        of_item.setdefault(r.item_id, []).append(ids[r.term])
    shards = written(index(docs, {t.encode(): i for t, i in ids.items()}, shard), "shards")
    size = shards.agg(F.coalesce(F.sum("docs"), F.lit(0)).alias("n"), F.coalesce(F.sum("terms"), F.lit(0)).alias("l")).first()
    df = shards.select(F.explode("term").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    w = F.floor(1000.0 * F.log(F.lit(2.0 * size.n + 2) / (2 * F.col("df") + 1).cast("double"))).cast("long")
    weights = np.zeros(len(names), "i8")
    for r in df.select("term", w.alias("w")).toLocalIterator():
        weights[r.term] = r.w
    sent = spark.sparkContext.broadcast((weights, {i: np.array(sorted(t), "i8") for i, t in of_item.items()}))
    n_docs, n_terms = size.n, max(size.l, 1)

    def bounds(t: pa.Table) -> pa.Table:
        weights, items = sent.value
        tree = Tree(t, weights, n_docs, n_terms)
        found = [(i, x) for i, x in ((i, tree.bound(w)) for i, w in items.items()) if x > 0]
        number = t.column("shard")[0].as_py()
        return pa.table({"shard": pa.array([number] * len(found), pa.int64()), "item_id": pa.array([i for i, _ in found], pa.int64()), "bound": pa.array([x for _, x in found], pa.int64())})

    def descend(t: pa.Table, asked_: pa.Table) -> pa.Table:
        weights, items = sent.value
        out = {"item_id": [], "doc_id": [], "score": []}
        if t.num_rows and asked_.num_rows:
            tree = Tree(t, weights, n_docs, n_terms)
            for r in asked_.to_pylist():
                docs, scores = tree.search(items[r["item_id"]], k, r["floor"])
                out["item_id"] += [r["item_id"]] * len(docs)
                out["doc_id"] += [None if n else d for d, n in zip(tree.ids[docs].tolist(), tree.null[docs])]
                out["score"] += scores.tolist()
        return pa.table({c: pa.array(v, pa.int64()) for c, v in out.items()})

    def searched(requests: DataFrame) -> DataFrame:
        needed = shards.join(light(requests.select("shard").distinct()), "shard", "left_semi")
        return needed.groupBy("shard").cogroup(requests.groupBy("shard")).applyInArrow(descend, "item_id long, doc_id long, score long")

    tops = written(shards.groupBy("shard").applyInArrow(bounds, "shard long, item_id long, bound long"), "bounds")
    order = Window.partitionBy("item_id").orderBy(F.desc("bound"), "shard")
    turns = written(tops.withColumn("first", F.row_number().over(order) == 1), "turns")
    first = written(searched(turns.where("first").select("shard", "item_id", F.lit(1).cast("long").alias("floor"))), "first")
    reached = first.groupBy("item_id").agg(F.when(F.count("*") == k, F.min("score")).otherwise(F.lit(1)).alias("floor"))
    rest = turns.where("not first").join(light(reached.select(F.col("item_id").alias("_i"), "floor")), F.col("item_id").eqNullSafe(F.col("_i")), "left")
    rest = rest.select("shard", "item_id", F.coalesce("floor", F.lit(1)).cast("long").alias("floor"), "bound").where("bound >= floor").drop("bound")
    return written(ranked(first.unionByName(searched(written(rest, "rest"))), k).select("item_id", "rank", "doc_id", "score"), "ranked")


def search(docs: DataFrame, items: DataFrame, k: int = 50, shard: int = 4096, max_terms: int = 100_000) -> DataFrame:
    """item_id, rank, doc_id and score: the ``k`` best documents with a score above 0 for each item."""
    terms = written(asked(items), "terms")
    found = None
    for ids in blocks(terms, max_terms):
        some = [x for x in ids if x is not None]
        mine = F.col("item_id").between(min(some), max(some)) if some else F.lit(False)
        mine = mine | F.col("item_id").isNull() if None in ids else mine
        got = search_block(docs, terms.where(mine), k, shard)
        found = got if found is None else found.unionByName(got)
    return found if found is not None else docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
