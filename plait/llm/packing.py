"""Packing (operator 9): first-fit decreasing over a tournament tree of bin capacities, in randomised groups.

Contract of :func:`pack`.  Every document's ids (null text: none) plus the end id are cut into pieces of at
most ``capacity`` tokens; every id lies in exactly one piece, and every piece in exactly one sequence.

* null ``doc_id``: packed like any other; repeated rows: each row is packed by itself.
* an empty text is one piece that holds only the end id.
* an empty table gives no rows; extra columns are ignored.
* ties of length are broken by the pieces' hash order, so reruns agree.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plait.llm.shared import partitions
from plait.llm.tokens import default_path, tokenizer

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
PLACED = PIECES + ", sequence_id long, offset long"


class CapacityTree:
    """A tournament tree: each inner node knows the largest free capacity below it, so first fit takes O(log bins)."""

    def __init__(self, capacity: int):
        self.capacity, self.leaves, self.tree, self.bins = capacity, 1, [0, 0], 0

    def _grow(self) -> None:
        """Twice the leaves; those not opened yet count as 0."""
        old, n = self.tree, self.leaves
        self.leaves, self.tree = 2 * n, [0] * (4 * n)
        self.tree[2 * n : 3 * n] = old[n : 2 * n]
        for i in range(2 * n - 1, 0, -1):
            self.tree[i] = max(self.tree[2 * i], self.tree[2 * i + 1])

    def _set(self, leaf: int, free: int) -> None:
        tree, i = self.tree, leaf + self.leaves
        tree[i] = free
        while i > 1:
            i //= 2
            free = max(tree[2 * i], tree[2 * i + 1])
            if tree[i] == free:
                return
            tree[i] = free

    def place(self, length: int) -> tuple[int, int]:
        """The first bin with room (a new one if none has), and the offset there."""
        tree, n = self.tree, self.leaves
        if tree[1] < length:
            if self.bins == n:
                self._grow()
            leaf, free = self.bins, self.capacity
            self.bins += 1
        else:
            i = 1
            while i < n:
                i *= 2
                if tree[i] < length:
                    i += 1
            leaf, free = i - n, tree[i]
        self._set(leaf, free - length)
        return leaf, self.capacity - free


def first_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each length; equal lengths go in the order given."""
    tree, bins, offsets = CapacityTree(capacity), np.empty(len(lengths), "i8"), np.empty(len(lengths), "i8")
    for i in np.argsort(-lengths, kind="stable").tolist():
        bins[i], offsets[i] = tree.place(int(lengths[i]))
    return bins, offsets


def cut(docs: DataFrame, capacity: int = 2048, end_id: int = 1, tokenizer_path: str | None = None, with_ids: bool = False) -> DataFrame:
    """Pieces of each document: whole runs of ``capacity`` tokens, then the rest."""
    path = tokenizer_path or default_path()

    def pieces(batches):
        tok = tokenizer(path)
        for b in batches:
            rows = [[] for _ in range(5 + with_ids)]
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ids = tok.encode(text, end_id)
                n = len(ids) // 4
                for start in range(0, n, capacity):
                    part = ids[4 * start : 4 * (start + capacity)]
                    for col, x in zip(rows, (doc_id, start, len(part) // 4, zlib.crc32(part), n, part)):
                        col.append(x)
            kinds = [*[pa.int64()] * 5, pa.binary()]
            names = [x.split()[0] for x in PIECES.split(", ")] + ["ids"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds)], names=names[: len(rows)])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(pieces, PIECES + ", ids binary" * with_ids)


def place(pieces: DataFrame, capacity: int = 2048, group: int = 16384, n_groups: int | None = None, seed: int = 7) -> DataFrame:
    """Deals the pieces at random (by hash) into ``n_groups`` partitions and packs each by first-fit decreasing, ``group`` pieces at a time."""

    def packed(batches):
        part, first = TaskContext.get().partitionId() << 32, 0

        def flush(kept):
            nonlocal first
            b = pa.Table.from_batches(kept).combine_chunks()
            bins, offsets = first_fit_decreasing(b["length"].to_numpy(), capacity)
            out = b.append_column("sequence_id", pa.array(part + first + bins)).append_column("offset", pa.array(offsets))
            first += int(bins.max()) + 1
            return out.to_batches()

        kept, n = [], 0
        for b in batches:
            while n + b.num_rows >= 2 * group:
                kept.append(b.slice(0, 2 * group - n))
                b, n = b.slice(2 * group - n), 0
                yield from flush(kept)
                kept = []
            if b.num_rows:
                kept.append(b)
                n += b.num_rows
        if n:
            yield from flush(kept)

    spark, names = pieces.sparkSession, pieces.columns
    order = F.xxhash64(F.lit(seed), "doc_id", "start", "ids_crc32", "doc_tokens")
    dealt = pieces.repartition(n_groups or partitions(spark), order).sortWithinPartitions(order)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    return dealt.mapInArrow(packed, kinds + ", sequence_id long, offset long").select(*names, "sequence_id", "offset")


def pack(docs: DataFrame, capacity: int = 2048, group: int = 16384, end_id: int = 1, tokenizer_path: str | None = None, with_ids: bool = False, seed: int = 7) -> DataFrame:
    """Sequences of at most ``capacity`` tokens with little padding, one row a piece.

    Only the pieces' figures are shuffled, never texts (unless ``with_ids`` asks for the ids too).  A group
    holds ``group`` pieces on average where the cluster's partitions allow, ``2 * group`` at most.
    """
    n = max(1, min(partitions(docs.sparkSession), -(-docs.count() // group)))
    return place(cut(docs, capacity, end_id, tokenizer_path, with_ids), capacity, group, n, seed)
