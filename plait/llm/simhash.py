"""Near-duplicates by SimHash: a binary trie of fingerprints joined with itself (operator 11).

A text's fingerprint has a bit set where over half of its word shingles' hashes have it.  Distinct fingerprints are the
trie's leaves, so exact copies cost one.  Two nodes of the same depth are visited together, with the number of bits in
which their prefixes differ; a pair whose bits exceed the budget is pruned with all that hangs below it.  The upper part
of the traversal runs as Spark joins, four bits a round, until a pair's subtrees hold at most ``block`` fingerprints
together; each such pair is then one task's group, and the task goes on bit by bit to single leaves.  A group gives each of
its linked fingerprints the smallest one of its local component (never all pairs), and its number of linked documents;
classes are the components of these links.

A fingerprint has at most 2,081 others within two bits, so the work grows with the number of distinct fingerprints even
in a large group of near copies.

* null and empty texts, and texts of white space alone, have fingerprint zero, linked like any other.
* texts under ``width`` words are one shingle; a class's id is its smallest non-null ``doc_id`` (null if all are null).
* repeated rows share a fingerprint and count as documents; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plait.llm import near_dups
from plait.llm.near_dups import light
from plait.llm.shared import written

STEP = 4  # bits that one round of joins goes down
LEAF = 16  # pairs of leaves below which two subtrees are compared directly
FRONTIER = 1 << 16  # node pairs that a task holds at once
CHUNK = 1 << 16  # shingles whose bits are counted together


def fingerprint(text: bytes | None, width: int = 3, seed: int = 42) -> int:
    """The fingerprint as an unsigned number.  Words are parted by ASCII white space, A-Z lower-cased."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    norm = b" ".join(words)
    if len(words) <= width:
        return xxhash.xxh64_intdigest(norm, seed)
    ends = np.append(np.flatnonzero(np.frombuffer(norm, "u1") == 32), len(norm))
    starts = np.concatenate([[0], ends[:-1] + 1])
    starts, ends = starts[: 1 - width].tolist(), ends[width - 1 :].tolist()
    ones, digest = np.zeros(64, "i8"), xxhash.xxh64_intdigest
    for at in range(0, len(starts), CHUNK):
        h = np.fromiter((digest(norm[s:e], seed) for s, e in zip(starts[at : at + CHUNK], ends[at : at + CHUNK])), "<u8")
        ones += np.unpackbits(h.view("u1").reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype="i8")
    return int(np.packbits(2 * ones > len(starts), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = 3, seed: int = 42) -> DataFrame:
    """doc_id and fingerprint (as a signed long) of every document."""

    def sign(batches):
        for b in batches:
            got = np.fromiter((fingerprint(x.as_py(), width, seed) for x in b.column(1)), "u8", b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got.view("i8"))], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text")).mapInArrow(sign, "doc_id long, fp long")


def prefix(fp, depth: int) -> F.Column:
    """The first ``depth`` bits (1 to 64) of a fingerprint."""
    return F.shiftrightunsigned(fp, 64 - depth)


def subtree_pairs(nodes: DataFrame, budget: int, block: int) -> DataFrame:
    """(depth, a, b, diff): pairs of trie nodes, a <= b, that hold all leaf pairs within the budget, each once; written.

    Sizes of subtrees are counted at each depth that is reached."""
    spark = nodes.sparkSession
    open_, done, depth = spark.createDataFrame([(0, 0, 0)], "a long, b long, diff int"), None, 0
    while depth < 64:
        depth += STEP
        p = prefix(F.col("fp"), depth).alias("p")
        child = written(nodes.groupBy(p).agg(F.count("*").alias("n")), "trie")
        parent = F.shiftrightunsigned("p", STEP) if depth > STEP else F.lit(0).cast("long")
        side = lambda c: child.select(parent.alias(f"up_{c}"), F.col("p").alias(f"to_{c}"), F.col("n").alias(f"n_{c}"))  # noqa: B023, E731
        both = open_.join(side("a"), F.col("a") == F.col("up_a")).join(side("b"), F.col("b") == F.col("up_b"))
        both = both.where("a <> b or to_a <= to_b").withColumn("diff", (F.col("diff") + F.bit_count(F.col("to_a").bitwiseXOR(F.col("to_b")))).cast("int") if depth == STEP else (F.col("diff") + F.bit_count(F.col("to_a").bitwiseXOR(F.col("to_b")).bitwiseAND(F.lit((1 << STEP) - 1)))).cast("int"))
        kept = written(both.where(F.col("diff") <= budget).select(F.col("to_a").alias("a"), F.col("to_b").alias("b"), "diff", F.when(F.col("to_a") == F.col("to_b"), F.col("n_a")).otherwise(F.col("n_a") + F.col("n_b")).alias("n")), "pairs")
        ready = kept.where(F.col("n") <= block).select(F.lit(depth).alias("depth"), "a", "b", "diff")
        done = ready if done is None else done.unionByName(ready)
        open_ = kept.where(F.col("n") > block).drop("n")
        if open_.isEmpty():
            break
    return written(done, "subtrees")


def leaf_pairs(a: np.ndarray, b: np.ndarray, depth: int, diff: int, budget: int, same: bool):
    """Yields (i, j): places in the sorted, distinct ``a`` and ``b`` of leaves within the budget.

    All of ``a`` share their first ``depth`` bits, as do all of ``b``; ``diff`` of these differ.  With ``same`` the two are one
    array, and each pair comes once.  Node pairs are ranges of the arrays; at most ``FRONTIER`` are split together."""
    one = np.uint64(1)
    stack = [(depth, np.array([0]), np.array([len(a)]), np.array([0]), np.array([len(b)]), np.array([diff]))]
    while stack:
        depth, al, ah, bl, bh, d = stack.pop()
        if len(al) > FRONTIER:
            for part in (slice(FRONTIER, None), slice(None, FRONTIER)):
                stack.append((depth, *(x[part] for x in (al, ah, bl, bh, d))))
            continue
        few = (ah - al) * (bh - bl) <= LEAF
        if few.any():
            l, m, r = al[few], bl[few], bh[few] - bl[few]
            n = (ah[few] - l) * r
            own = np.repeat(np.arange(len(n)), n)
            k = np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n)
            i, j = l[own] + k // r[own], m[own] + k % r[own]
            hit = np.bitwise_count(a[i] ^ b[j]) <= budget
            if same:
                hit &= (i < j) | (l != m)[own]
            yield i[hit], j[hit]
            al, ah, bl, bh, d = (x[~few] for x in (al, ah, bl, bh, d))
        if not len(al):
            continue
        bit = np.uint64(63 - depth)
        middle = lambda x, lo: np.searchsorted(x, (x[lo] >> bit | one) << bit)  # noqa: B023, E731
        # the first leaf with this bit set: the prefix above it, then a one, then zeros
        am, bm = np.clip(middle(a, al), al, ah), np.clip(middle(b, bl), bl, bh)
        twin = same & (al == bl) & (ah == bh)
        sides = [(al, am, bl, bm, d, None), (am, ah, bm, bh, d, None), (al, am, bm, bh, d + 1, None), (am, ah, bl, bm, d + 1, twin)]
        parts = []
        for lo, hi, lo_, hi_, e, mirrored in sides:
            ok = (lo < hi) & (lo_ < hi_) & (e <= budget)
            if mirrored is not None:
                ok &= ~mirrored
            parts.append([x[ok] for x in (lo, hi, lo_, hi_, e)])
        al, ah, bl, bh, d = (np.concatenate(x) for x in zip(*parts))
        if len(al):
            stack.append((depth + 1, al, ah, bl, bh, d))


def merged(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """``label`` (each place's smallest known mate, pointing at itself in the end) after the links (i, j)."""
    while True:
        x, y = label[i], label[j]
        apart = x != y
        if not apart.any():
            return label
        i, j, x, y = i[apart], j[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (up := label[label]).tobytes() != label.tobytes():
            label = up


def linked(nodes: DataFrame, pairs: DataFrame, budget: int) -> DataFrame:
    """(fp, root, links) from each pair of subtrees, for fingerprints linked there: the smallest of the local component, and the documents within the budget.

    ``nodes``: fp, copies; ``pairs``: from :func:`subtree_pairs`."""
    depths = sorted(r.depth for r in pairs.select("depth").distinct().collect())
    if not depths:
        return nodes.sparkSession.createDataFrame([], "fp long, root long, links long")
    keys = F.explode(F.array(*[F.struct(F.lit(d).alias("depth"), prefix(F.col("fp"), d).alias("p")) for d in depths]))
    ends = pairs.select("depth", "a", "b", "diff", F.explode(F.when(F.col("a") == F.col("b"), F.array("a")).otherwise(F.array("a", "b"))).alias("p"))
    rows = nodes.select("fp", "copies", keys.alias("k")).select("fp", "copies", "k.*").join(light(ends), ["depth", "p"])

    def walk(t: pa.Table) -> pa.Table:
        depth, first, second, diff = (t.column(c)[0].as_py() for c in ("depth", "a", "b", "diff"))
        fp, copies, at = (t.column(c).to_numpy() for c in ("fp", "copies", "p"))
        order = np.argsort(fp.view("u8"))
        fp, copies, at = fp[order], copies[order], at[order]
        leaves, places = fp.view("u8"), [np.flatnonzero(at == x) for x in (first, second)]
        label, links = np.arange(len(fp)), np.zeros(len(fp), "i8")
        for i, j in leaf_pairs(leaves[places[0]], leaves[places[1]], depth, diff, budget, first == second):
            i, j = places[0][i], places[1][j]
            np.add.at(links, i, copies[j])
            np.add.at(links, j, copies[i])
            label = merged(label, i, j)
        has = links > 0
        return pa.table({"fp": fp[has], "root": fp[label[has]], "links": links[has]})

    return rows.groupBy("depth", "a", "b").applyInArrow(walk, "fp long, root long, links long")


def attach(rows: DataFrame, named: DataFrame, columns: list[str]) -> DataFrame:
    """``columns`` of each document's fingerprint.  Fingerprints of over a thousandth of all rows (so at most 1000) are broadcast;
    their documents skip the shuffle by keys that never match."""
    limit = max(1000, rows.count() // 1000)
    hot = named.where(F.col("copies") > limit).select(F.col("fp").alias("_hot"), *[F.col(c).alias(f"_hot_{c}") for c in columns])
    marked = rows.join(F.broadcast(hot), rows["fp"] == F.col("_hot"), "left")
    keyed = marked.withColumn("_key", F.when(F.col("_hot").isNull(), F.col("fp"))).withColumn("_salt", F.when(F.col("_hot").isNull(), F.lit(-1)).otherwise(F.pmod(F.xxhash64("doc_id"), F.lit(4096))))
    side = named.where(F.col("copies") <= limit).select(F.col("fp").alias("_n"), F.lit(-1).cast("long").alias("_s"), *columns)
    out = keyed.join(side, (keyed["_key"] == side["_n"]) & (keyed["_salt"] == side["_s"]), "left")
    return out.select("doc_id", "fp", *[F.when(F.col("_hot").isNull(), F.col(c)).otherwise(F.col(f"_hot_{c}")).alias(c) for c in columns])


def classes(docs: DataFrame, budget: int = 2, width: int = 3, seed: int = 42, block: int = 1 << 17) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id and links (other documents within ``budget`` bits) of every document."""
    signed = written(fingerprints(docs, width, seed), "fingerprints")
    nodes = written(signed.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")), "nodes")
    found = written(linked(nodes.select("fp", "copies"), subtree_pairs(nodes, budget, block), budget), "linked")
    labels = near_dups.components(found.where("fp <> root").select(F.col("fp").alias("a"), F.col("root").alias("b")).distinct())
    links = found.groupBy("fp").agg(F.sum("links").alias("links"))
    known = labels.select(F.col("node").alias("fp"), "component")
    nodes = nodes.join(known, "fp", "left").join(links, "fp", "left").select("fp", "rep", "copies", F.coalesce("component", "fp").alias("component"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"))
    nodes = written(nodes, "named")
    ids = nodes.groupBy("component").agg(F.min("rep").alias("component_id"))
    named = written(nodes.join(ids, "component").select("fp", "copies", "component_id", "links"), "classes")
    out = attach(signed, named, ["component_id", "links"])
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "links")
