"""Hard negatives by a two-dimensional block matrix product (operator 12).

Anchors and rows are dealt by a hash of their id into blocks, and each block is cut into chunks of dimensions.  A block of
anchors meets a block of rows once for each chunk and gives a partial tile of int64 scores; tiles of the same two blocks are
shuffled together and added up.  A summed tile is reduced at once to what may still be among the best of an anchor, so no
score leaves its task.  The product runs twice: first for each anchor's positives, then for the negatives in the window
that each positive's score sets.

Every anchor is scored against every row: the work is the number of anchors times the number of rows, and memory is that
of one tile, whatever the sizes of labels and blocks.

* rows with a null id, label or vector, or a null or non-finite component, take no part.
* of rows that share an id, the one with the smallest (label, vector) counts.
* equal scores go by the smaller id; of vectors of several lengths the shorter count as padded by zeros.
* an anchor without positives, or a positive without negatives in its window, gives no row; nor does an empty table.
* scores that could exceed 64 bits are an error.  Extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plait.llm.shared import written

LOW = np.iinfo("i8").min


def quantised(rows: DataFrame, scale: int = 256, vector: str = "embedding") -> DataFrame:
    """vec_id, label and q (floor of ``scale`` times each component, as longs) of the rows that take part, one for each id."""
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf))
    q = F.transform(F.col(vector), lambda x: F.floor(x.cast("double") * scale).cast("long"))
    whole = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col(vector).isNotNull() & F.forall(vector, fine))
    one = whole.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), q.alias("q"))
    return one.groupBy("vec_id").agg(F.min(F.struct("label", "q")).alias("v")).select("vec_id", "v.label", "v.q")


def shards(rows: DataFrame, n_blocks: int, dims: int, chunk: int) -> DataFrame:
    """(block, chunk, ids, labels, cells): blocks of rows in id order, each cut into ``chunk`` dimensions; cells are int64, row by row."""
    n_chunks = max(1, -(-dims // chunk))

    def pack(t: pa.Table) -> pa.Table:
        t = t.sort_by("vec_id")
        flat, n = t.column("q").combine_chunks(), t.num_rows
        lengths = np.diff(flat.offsets.to_numpy())
        cells = np.zeros((n, n_chunks * chunk), "<i8")
        cells[np.repeat(np.arange(n), lengths), np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat.flatten().to_numpy()
        ids, labels = (t.column(c).to_numpy().astype("<i8").tobytes() for c in ("vec_id", "label"))
        return pa.table({
            "block": pa.array([t.column("block")[0].as_py()] * n_chunks, pa.int32()), "chunk": pa.array(range(n_chunks), pa.int32()), "ids": pa.array([ids] * n_chunks, pa.binary()),
            "labels": pa.array([labels] * n_chunks, pa.binary()), "cells": pa.array([np.ascontiguousarray(cells[:, k * chunk : (k + 1) * chunk]).tobytes() for k in range(n_chunks)], pa.binary()),
        })

    block = F.pmod(F.xxhash64("vec_id"), F.lit(n_blocks)).cast("int")
    return rows.select("vec_id", "label", "q", block.alias("block")).groupBy("block").applyInArrow(pack, "block int, chunk int, ids binary, labels binary, cells binary")


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a times b transposed, exactly: in doubles where all sums fit 53 bits, else in int64; beyond that an error."""
    top = lambda x: max(abs(int(x.min())), abs(int(x.max()))) if x.size else 0
    most = top(a) * top(b) * a.shape[1]
    if most < 1 << 53:
        return (a.astype("f8") @ b.astype("f8").T).astype("i8")
    if most >= 1 << 62:
        raise OverflowError("scores of over 62 bits")
    return a @ b.T


def best(scores: np.ndarray, allowed: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the ``k`` highest allowed scores of each row, equal scores by the lower column; fewer where fewer are allowed."""
    n, width = scores.shape
    k = min(k, width)
    top = max(abs(int(scores.min())), abs(int(scores.max())))
    if top < (1 << 61) // width:  # score and column in one number
        key = np.where(allowed, scores * width + np.arange(width - 1, -1, -1), LOW)
        at = np.argpartition(key, width - k, axis=1)[:, width - k :]
    else:
        at = np.stack([np.lexsort((np.arange(width), -s, ~ok))[:k] for s, ok in zip(scores, allowed)])
    row, at = np.repeat(np.arange(n), k), at.reshape(-1)
    ok = allowed[row, at]
    return row[ok], at[ok]


def tiles(anchors: DataFrame, rows: DataFrame, n_anchor_blocks: int, n_row_blocks: int) -> DataFrame:
    """(i, j, tile, and the ids and labels of both sides): partial scores of each pair of blocks and each chunk of dimensions."""
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    a = anchors.select(F.col("block").alias("i"), "chunk", every(n_row_blocks).alias("j"), F.col("ids").alias("a_ids"), F.col("labels").alias("a_labels"), F.col("cells").alias("a_cells"))
    b = rows.select(F.col("block").alias("j"), "chunk", every(n_anchor_blocks).alias("i"), F.col("ids").alias("b_ids"), F.col("labels").alias("b_labels"), F.col("cells").alias("b_cells"))

    def multiply(x: pa.Table, y: pa.Table) -> pa.Table:
        got = []
        if x.num_rows and y.num_rows:
            x, y = x.to_pylist()[0], y.to_pylist()[0]
            sides = [np.frombuffer(s, "<i8").reshape(len(i) // 8, -1) for s, i in ((x["a_cells"], x["a_ids"]), (y["b_cells"], y["b_ids"]))]
            got = [{**{c: x[c] for c in ("i", "j", "a_ids", "a_labels")}, "b_ids": y["b_ids"], "b_labels": y["b_labels"], "tile": product(*sides).tobytes()}]
        return pa.Table.from_pylist(got, pa.schema([("i", pa.int32()), ("j", pa.int32()), *((c, pa.binary()) for c in ("a_ids", "a_labels", "b_ids", "b_labels", "tile"))]))

    keys = ["i", "j", "chunk"]
    return a.groupBy(*keys).cogroup(b.groupBy(*keys)).applyInArrow(multiply, "i int, j int, a_ids binary, a_labels binary, b_ids binary, b_labels binary, tile binary")


def summed(t: pa.Table) -> tuple[np.ndarray, ...]:
    """Scores, anchor ids and labels, row ids and labels of one pair of blocks: its partial tiles added up."""
    a_ids, a_labels, b_ids, b_labels = (np.frombuffer(t.column(c)[0].as_py(), "<i8") for c in ("a_ids", "a_labels", "b_ids", "b_labels"))
    total = np.zeros((len(a_ids), len(b_ids)), "i8")
    for part in t.column("tile"):
        total += np.frombuffer(part.as_buffer(), "<i8").reshape(total.shape)
    return total, a_ids, a_labels, b_ids, b_labels


def positives(partial: DataFrame, k: int) -> DataFrame:
    """(anchor_id, positive_id, positive_score): each anchor's ``k`` best other rows of its label."""

    def reduce(t: pa.Table) -> pa.Table:
        s, a_ids, a_labels, b_ids, b_labels = summed(t)
        r, c = best(s, (a_labels[:, None] == b_labels) & (a_ids[:, None] != b_ids), k)
        return pa.table({"anchor_id": a_ids[r], "positive_id": b_ids[c], "positive_score": s[r, c]})

    each = partial.groupBy("i", "j").applyInArrow(reduce, "anchor_id long, positive_id long, positive_score long")
    order = Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id")
    return each.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= k).drop("_r")


def negatives(partial: DataFrame, windows: DataFrame, n_anchor_blocks: int, n_row_blocks: int, k: int, low: int, high: int) -> DataFrame:
    """The ``k`` best rows of another label in each positive's window: low * positive <= 100 * negative <= high * positive."""

    def reduce(t: pa.Table, w: pa.Table) -> pa.Table:
        got = []
        if t.num_rows and w.num_rows:
            s, a_ids, a_labels, b_ids, b_labels = summed(t)
            at = {x: i for i, x in enumerate(a_ids.tolist())}
            own = np.array([at[x] for x in w.column("anchor_id").to_pylist()])
            order = np.argsort(own, kind="stable")
            own, pos, pid = own[order], w.column("positive_score").to_numpy()[order], w.column("positive_id").to_numpy()[order]
            nth = np.arange(len(own)) - np.searchsorted(own, own)  # of its anchor
            for n in range(nth.max() + 1):
                m = nth == n
                part, p = s[own[m]], pos[m][:, None]
                # division keeps the bounds within 64 bits: ceil(low * p / 100) and floor(high * p / 100)
                lo = np.array([-(-low * int(x) // 100) for x in p[:, 0]])[:, None]
                hi = np.array([high * int(x) // 100 for x in p[:, 0]])[:, None]
                r, c = best(part, (part >= lo) & (part <= hi) & (a_labels[own[m]][:, None] != b_labels), k)
                got.append(pa.table({"anchor_id": a_ids[own[m][r]], "positive_id": pid[m][r], "positive_score": p[r, 0], "negative_id": b_ids[c], "negative_score": part[r, c]}))
        names = ("anchor_id", "positive_id", "positive_score", "negative_id", "negative_score")
        return pa.concat_tables(got) if got else pa.table({c: pa.array([], pa.int64()) for c in names})

    block = F.pmod(F.xxhash64("anchor_id"), F.lit(n_anchor_blocks)).cast("int")
    sent = windows.select(block.alias("i"), F.explode(F.sequence(F.lit(0), F.lit(n_row_blocks - 1))).alias("j"), "anchor_id", "positive_id", "positive_score")
    each = partial.groupBy("i", "j").cogroup(sent.groupBy("i", "j")).applyInArrow(reduce, "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long")
    order = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id")
    return each.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine(vectors: DataFrame, is_anchor, n_positives: int = 5, n_negatives: int = 5, low: int = 80, high: int = 100, anchor_block: int = 256, row_block: int = 4096, chunk: int = 32) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id and both scores.

    ``vectors``: vec_id, label, q, from :func:`quantised`; ``is_anchor`` a condition on them.  Negatives lie between ``low`` and
    ``high`` hundredths of their positive's score.  A tile holds about ``anchor_block`` times ``row_block`` scores."""
    vectors = written(vectors, "vectors")
    anchors = vectors.where(is_anchor)
    size = vectors.agg(F.count("*").alias("n"), F.coalesce(F.max(F.size("q")), F.lit(0)).alias("dims")).first()
    n_i, n_j = (max(1, -(-n // b)) for n, b in ((anchors.count(), anchor_block), (size.n, row_block)))
    a, b = written(shards(anchors, n_i, size.dims, chunk), "anchors"), written(shards(vectors, n_j, size.dims, chunk), "rows")
    windows = written(positives(tiles(a, b, n_i, n_j), n_positives), "positives")
    found = negatives(tiles(a, b, n_i, n_j), windows, n_i, n_j, n_negatives, low, high)
    return found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
