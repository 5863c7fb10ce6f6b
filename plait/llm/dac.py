"""Token ids on disk as directly addressable codes (operator 3).

An id is split into byte-aligned chunks, lowest first; level ``l`` holds the ``l``-th chunk of every id that
has one, with a continuation bitmap (does a higher chunk follow?) and a rank directory (set bits before each
512-bit block).  Token ``i`` is found by one rank a level: no block is decoded.

A shard file (all little-endian)::

    magic "DACT" | version u32 | n_docs u64 | n_tokens u64 | n_levels u32 | width of each level u32 ...
    doc ids i64[n_docs] | null flags u8[n_docs] | first token of each document u64[n_docs]
    each level: n u64 | chunks u8/u16/u32[n] | bitmap u8[ceil(n/8)] | directory u32[ceil(n/512)]

Shards are the values of the column ``shard`` of a Parquet table, written without compression by Spark's own
committer: it works on every store and survives lost executors.  A manifest beside it has each partition's
first token.

Defined results: a null text is empty; a null ``doc_id`` sorts first; repeated ids sort by their text's hash;
an empty table gives no shards and reads back as no rows; extra columns are ignored.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plait.llm.shared import new_path, partitions
from plait.llm.tokens import default_path, tokenizer

MAGIC, BLOCK = b"DACT", 512
_KIND = {8: "<u1", 16: "<u2", 32: "<u4"}
SHARDS = "part int, part_first long, n_docs long, n_tokens long, shard binary"
DECODED = "doc_id long, start long, n_tokens long, ids_crc32 long"
#: Write partitions at most; the manifest has one row of 16 bytes for each, so it is broadcast.
MAX_PARTS = 100_000
#: Words that a worker's tokenizer remembers in each of its two generations, about 200 bytes each; the ids do not depend on it.
REMEMBERED = 300_000


def _level(chunks: np.ndarray, more: np.ndarray, kind: str) -> bytes:
    bits = np.packbits(more, bitorder="little")
    ends = np.add.reduceat(more, np.arange(0, len(more), BLOCK), dtype="i8") if len(more) else np.zeros(0, "i8")
    directory = np.concatenate([[0], np.cumsum(ends)[:-1]]) if len(ends) else ends
    return struct.pack("<Q", len(chunks)) + chunks.astype(kind).tobytes() + bits.tobytes() + directory.astype("<u4").tobytes()


def encode_shard(doc_ids: list[int | None], starts: np.ndarray, ids: np.ndarray, widths: tuple[int, ...] = (8, 8, 16)) -> bytes:
    """One shard of whole documents; ``starts`` are the documents' first tokens in ``ids``.  Trailing empty levels are left out."""
    levels, rest, shift = [], ids.astype("u8"), 0
    for w in widths:
        more = (rest >> np.uint64(w)) > 0
        levels.append((w, _level(rest & np.uint64((1 << w) - 1), more, _KIND[w])))
        shift, rest = shift + w, rest[more] >> np.uint64(w)
        if not len(rest):
            break
    if len(rest):
        raise ValueError(f"an id needs more than {shift} bits")
    out = [MAGIC, struct.pack("<IQQI", 1, len(doc_ids), len(ids), len(levels)), *(struct.pack("<I", w) for w, _ in levels)]
    out += [np.array([d or 0 for d in doc_ids], "<i8").tobytes(), np.array([d is None for d in doc_ids], "u1").tobytes(), np.asarray(starts, "<u8").tobytes()]
    return b"".join(out + [x for _, x in levels])


class Shard:
    """Views into a shard's bytes; nothing is decoded until asked for."""

    def __init__(self, data: bytes):
        if data[:4] != MAGIC:
            raise ValueError("not a token shard")
        _, self.n_docs, self.n_tokens, n_levels = struct.unpack_from("<IQQI", data, 4)
        at = 28
        widths = struct.unpack_from(f"<{n_levels}I", data, at)
        at += 4 * n_levels

        def view(kind, n):
            nonlocal at
            out = np.frombuffer(data, kind, n, at)
            at += out.nbytes
            return out

        ids, null, self.starts = view("<i8", self.n_docs), view("u1", self.n_docs), view("<u8", self.n_docs)
        self.doc_ids = [None if z else d for d, z in zip(ids.tolist(), null.tolist())]
        self.levels = []
        for w in widths:
            n = int(view("<u8", 1)[0])
            self.levels.append((w, view(_KIND[w], n), view("u1", -(-n // 8)), view("<u4", -(-n // BLOCK))))

    def token(self, i: int) -> int:
        """Token ``i`` alone: a rank (one directory entry and at most 64 bytes of bitmap) for each level."""
        if not 0 <= i < self.n_tokens:
            raise IndexError(i)
        out = shift = 0
        for w, chunks, bits, directory in self.levels:
            out |= int(chunks[i]) << shift
            shift += w
            if not bits[i >> 3] >> (i & 7) & 1:
                break
            block = i // BLOCK
            before = bits[block * BLOCK // 8 : i >> 3]
            i = int(directory[block]) + int.from_bytes(before.tobytes(), "little").bit_count() + (int(bits[i >> 3]) & ((1 << (i & 7)) - 1)).bit_count()
        return out

    def tokens(self) -> np.ndarray:
        """All ids."""
        out, at, shift = np.zeros(self.n_tokens, "<u4"), None, 0
        for w, chunks, bits, _ in self.levels:
            part = chunks.astype("<u4") << np.uint32(shift)
            if at is None:
                out |= part
            else:
                out[at] |= part
            more = np.flatnonzero(np.unpackbits(bits, bitorder="little", count=len(chunks)))
            at, shift = (more if at is None else at[more]), shift + w
        return out


def write(docs: DataFrame, path: str, tokenizer_path: str | None = None, end_id: int = 2, shard_tokens: int = 1_000_000, widths: tuple[int, ...] = (8, 8, 16)) -> None:
    """Writes ``path``/shards and ``path``/manifest, documents in ascending ``doc_id`` order over all shards.

    Texts are range-partitioned (ids would be a larger shuffle), then encoded and written in one pass.  A
    shard ends with the document that fills ``shard_tokens``, so memory stays bounded by that and one text.
    """
    spark = docs.sparkSession
    tok_path = tokenizer_path or default_path()

    def shards(batches):
        tok, part = tokenizer(tok_path, REMEMBERED), TaskContext.get().partitionId()
        ids, names, n, first = [], [], 0, 0

        def flush():
            nonlocal ids, names, n, first
            lengths = np.array([len(x) // 4 for x in ids])
            blob = encode_shard(names, np.cumsum(lengths) - lengths, np.frombuffer(b"".join(ids), "<u4"), widths)
            row = [[part], [first], [len(names)], [n], [blob]]
            ids, names, n, first = [], [], 0, first + n
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(row, (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()))], names=["part", "part_first", "n_docs", "n_tokens", "shard"])

        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                names.append(doc_id)
                ids.append(tok.encode(text, end_id))
                n += len(ids[-1]) // 4
                if n >= shard_tokens:
                    yield flush()
        if names:
            yield flush()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    dealt = rows.repartitionByRange(min(partitions(spark), MAX_PARTS), F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))  # one id's rows may part
    dealt = dealt.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    dealt.mapInArrow(shards, SHARDS).write.option("compression", "uncompressed").parquet(f"{path}/shards")
    sums = spark.read.schema(SHARDS).parquet(f"{path}/shards").groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums.select("part", before.alias("first_token")).coalesce(1).write.parquet(f"{path}/manifest")


def read(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """Documents back from the files: their place, length, checksum and (``with_ids``) the ids as little-endian bytes."""

    def documents(batches):
        for b in batches:
            for first, blob in zip(b.column(0).to_pylist(), b.column(1)):
                shard = Shard(blob.as_py())
                ids = shard.tokens().tobytes()
                starts = shard.starts.tolist()
                ends = [*starts[1:], shard.n_tokens]
                parts = [ids[4 * s : 4 * e] for s, e in zip(starts, ends)]
                cols = [shard.doc_ids, [first + s for s in starts], [e - s for s, e in zip(starts, ends)], [zlib.crc32(x) for x in parts]]
                kinds, names = [pa.int64()] * 4, ["doc_id", "start", "n_tokens", "ids_crc32"]
                if with_ids:
                    cols, kinds, names = [*cols, parts], [*kinds, pa.binary()], [*names, "ids"]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=names)

    shards = spark.read.schema(SHARDS).parquet(f"{path}/shards")
    manifest = spark.read.schema("part int, first_token long").parquet(f"{path}/manifest")
    placed = shards.join(F.broadcast(manifest), "part")
    return placed.select(F.col("first_token") + F.col("part_first"), "shard").mapInArrow(documents, DECODED + ", ids binary" * with_ids)


def lookup(positions: DataFrame, path: str, block: int = 1_000_000) -> DataFrame:
    """(position, token) for places counted over all files, null where there is none.  Each shard with a place asked for is read once, and
    only the asked tokens' chunks are visited: no block is decoded."""
    spark = positions.sparkSession
    shards = spark.read.schema(SHARDS).parquet(f"{path}/shards")
    start = F.col("first_token") + F.col("part_first")
    spans = shards.join(F.broadcast(spark.read.schema("part int, first_token long").parquet(f"{path}/manifest")), "part").select("part", "part_first", start.alias("start"), (start + F.col("n_tokens")).alias("end"))
    spans = spans.withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((F.col("end") - 1) / block))))
    asked = positions.select(F.col("position").cast("long").alias("position")).where("position is not null").distinct()
    at = asked.join(spans, (F.floor(F.col("position") / block) == F.col("block")) & F.col("position").between(F.col("start"), F.col("end") - 1))
    wanted = at.groupBy("part", "part_first").agg(F.collect_list(F.col("position") - F.col("start")).alias("places"), F.first("start").alias("start"))

    def picked(batches):
        for b in batches:
            found = [(start + i, shard.token(i)) for start, places, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)) for shard in [Shard(blob.as_py())] for i in places]
            cols = list(zip(*found)) or [(), ()]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array([int(x) for x in cols[1]], pa.int64())], names=["position", "token"])

    got = wanted.join(shards.select("part", "part_first", "shard"), ["part", "part_first"]).select("start", "places", "shard").mapInArrow(picked, "position long, token long")
    return asked.join(got, "position", "left")


def round_trip(docs: DataFrame, **options) -> DataFrame:
    """Writes ``docs`` to a new place in the shared folder and reads it back."""
    path = new_path(docs.sparkSession, "dac")
    write(docs, path, **options)
    return read(docs.sparkSession, path)
