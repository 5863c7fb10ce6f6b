"""Near-duplicate classes by DartMinHash (operator 6).

Texts are weighted sets of word shingles: one that occurs n times weighs 1 + log2(n), so that repeated lines count, but not
in proportion; similarity is the weighted Jaccard one.  The graph's nodes are distinct texts (a 64-bit hash of the whole text), so exact copies
cost one node.  Each node's signature is cut into bands, equal bands meet in buckets, and pairs of a bucket are verified
by the exact weighted similarity of their texts.  Within a bucket a leader is compared with all members (never all pairs); what
a leader cannot decide - members outside its component - is compared with the bucket's other components, so no link
between bucket mates is lost.  Classes are the connected components.

With 32 bands of 6 coordinates a pair of similarity 0.8 shares a bucket with probability 0.99994.

* null and empty texts, and texts of white space alone, have no shingles: each document is a class of its own.
* texts under five words are one shingle; a class's id is its smallest non-null ``doc_id`` (null if all are null).
* repeated rows share a class; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plait.llm import darts
from plait.llm.shared import written

CHUNK = 1 << 18  # characters that are signed together


def node_key(text) -> F.Column:
    """The node of a text; null for texts without words."""
    return F.when(F.coalesce(text, F.lit("")).rlike(r"[^\x20\x09-\x0D]"), F.xxhash64(text))


def sketch_names(k: int) -> list[str]:
    """Columns of the sketch: four bits of each coordinate, 16 coordinates to a column."""
    return [f"s{i}" for i in range(k // 16)]


def plausible(k: int, threshold: float, a: str = "x_", b: str = "y_") -> F.Column:
    """Do two sketches agree in as many coordinates as texts of ``threshold`` similarity do, less four deviations?

    A pair right at the threshold is lost three times in a hundred thousand, half as often as by the bands."""
    names = sketch_names(k)
    if not names:
        return F.lit(True)
    n, p = 16 * len(names), threshold + (1 - threshold) / 16
    most = math.ceil(n * (1 - p) + 4 * math.sqrt(n * p * (1 - p)))
    differ = F.lit(0)
    for c in names:
        x = F.col(a + c).bitwiseXOR(F.col(b + c))
        for shift in (2, 1):
            x = x.bitwiseOR(F.shiftrightunsigned(x, shift))
        differ = differ + F.bit_count(x.bitwiseAND(F.lit(0x1111111111111111)))
    return differ <= most


def weights(times: np.ndarray, weighted: bool) -> np.ndarray:
    return 1 + np.log2(times) if weighted else np.ones(len(times))


def signed(docs: DataFrame, bands: int, rows: int, k: int, width: int, weighted: bool) -> DataFrame:
    """doc_id, node, band hashes and sketch of every document (no bands without words).  The bands take the first of ``k`` coordinates."""
    n_sketch = k // 16

    def sign(batches):
        hasher = darts.SpanHasher()
        for b in batches:
            texts, n, at = b.column(2).to_pylist(), b.num_rows, 0
            while at < n:
                to, size = at, 0
                while to < n and (to == at or size + len(texts[to] or "") <= CHUNK):
                    size += len(texts[to] or "")
                    to += 1
                owner, h, times = darts.shingles(texts[at:to], width, hasher)
                sig = darts.signatures(to - at, owner, h, weights(times, weighted), k)
                flat = pa.array(darts.band_hashes(sig[:, : bands * rows], bands).reshape(-1))
                has = np.isin(np.arange(to - at), owner)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.where(has, bands, 0))]), pa.int32()), flat.filter(pa.array(np.repeat(has, bands))))
                low = (sig[:, : 16 * n_sketch] & 15).astype("u1")
                sketch = np.ascontiguousarray(low[:, ::2] | low[:, 1::2] << 4).view("<i8")
                cols = [b.column(0).slice(at, to - at), b.column(1).slice(at, to - at), lists, *(pa.array(np.ascontiguousarray(sketch[:, i])) for i in range(n_sketch))]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "node", "bands", *sketch_names(k)])
                at = to

    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), node_key(text).alias("node"), text.alias("text")).mapInArrow(sign, "doc_id long, node long, bands array<long>" + "".join(f", {c} long" for c in sketch_names(k)))


class ShingleSets:
    """The shingle sets of a task's latest texts, by node; emptied beyond ``limit`` shingles."""

    def __init__(self, width: int, limit: int = 1_000_000):
        self.width, self.limit, self.known, self.size, self.hasher = width, limit, {}, 0, darts.SpanHasher()

    def get(self, node: int, text: str) -> tuple[np.ndarray, np.ndarray]:
        got = self.known.get(node)
        if got is None:
            if self.size > self.limit:
                self.known.clear()
                self.size = 0
            got = self.known[node] = darts.shingles([text], self.width, self.hasher)[1:]
            self.size += len(got[0])
        return got


def jaccard_at_least(a, b, threshold: float, weighted: bool) -> bool:
    (ha, na), (hb, nb) = a, b
    wa, wb = weights(na, weighted), weights(nb, weighted)
    small, large = sorted((wa.sum(), wb.sum()))
    if small < threshold * large - 1e-9:
        return False
    _, i, j = np.intersect1d(ha, hb, assume_unique=True, return_indices=True)
    both = np.minimum(wa[i], wb[j]).sum()
    union = small + large - both
    return bool(union > 0 and both >= threshold * union - 1e-9)


def similar(pairs: DataFrame, texts: DataFrame, width: int, threshold: float, weighted: bool) -> DataFrame:
    """Those (a, b) whose texts' shingles have a (weighted) Jaccard similarity of ``threshold`` or more."""

    def verified(batches):
        sets = ShingleSets(width)
        for b in batches:
            rows = zip(*(b.column(i).to_pylist() for i in range(4)))
            hit = [jaccard_at_least(sets.get(x, tx), sets.get(y, ty), threshold, weighted) for x, y, tx, ty in rows]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(hit, pa.bool_()))

    full = pairs.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b").join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
    return full.select("a", "b", "text_a", "text_b").mapInArrow(verified, "a long, b long")


def light(rows: DataFrame, limit: int = 1_000_000) -> DataFrame:
    """A written table of two longs a row, hinted for broadcast if its counted rows are at most ``limit`` (16 MB)."""
    return F.broadcast(rows) if rows.count() <= limit else rows


def components(edges: DataFrame) -> DataFrame:
    """(node, component) by least labels with pointer jumping; every round is a written table."""
    both = written(edges.select("a", "b").union(edges.select("b", "a")), "links")
    labels = written(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("component")), "labels")
    while True:
        known = light(labels)
        near = both.join(known, both["b"] == known["node"]).groupBy("a").agg(F.min("component").alias("m"))
        new = near.join(known, near["a"] == known["node"]).select("node", F.least("component", "m").alias("component"), F.col("component").alias("was"))
        up = known.select(F.col("node").alias("_n"), F.col("component").alias("_c"))
        new = written(new.join(up, new["component"] == up["_n"]).select("node", F.least("component", "_c").alias("component"), "was"), "labels")
        labels = new.select("node", "component")
        if new.where("component <> was").isEmpty():
            return labels


def labelled(rows: DataFrame, labels: DataFrame | None, column: str, out: str) -> DataFrame:
    """The component of ``column`` (a node without links is its own)."""
    if labels is None:
        return rows.withColumn(out, F.col(column))
    side = light(labels).select(F.col("node").alias("_n"), F.col("component").alias("_c"))
    return rows.join(side, rows[column] == F.col("_n"), "left").withColumn(out, F.coalesce("_c", column)).drop("_c", "_n")


def strays_and_mates(marked: DataFrame, key: list[str], names: list[str], a: str = "q_", b: str = "t_", more: DataFrame | None = None, block: int = 1000) -> tuple[DataFrame, DataFrame, F.Column]:
    """What remains to be compared in groups (``key``) that hold several components ``c``: members outside the largest one, all members of
    the group, and when two of them meet (once, and only from different components).

    ``more`` adds columns by the first name.  The strays of a group are dealt over parts of about ``block``, and the mates go to each part, so that a hot group is no one task."""
    sizes = marked.groupBy(*key, "c").agg(F.count("*").alias("n"))
    main = sizes.groupBy(*key).agg(F.max_by("c", F.struct("n", "c")).alias("main"), F.count("*").alias("several"), (F.sum("n") - F.max("n")).alias("n_strays")).where("several > 1")
    main = main.select(*key, "main", F.ceil(F.col("n_strays") / block).cast("int").alias("parts"))
    rows = marked.join(main, key)
    rows = written(rows.join(more, names[0]) if more is not None else rows, "open")
    strays = rows.where("c <> main").select(*[F.col(x).alias(f"_{x}") for x in key], F.pmod(F.xxhash64(names[0]), F.col("parts")).cast("int").alias("_part"), F.col("c").alias("_c"), *[F.col(x).alias(a + x) for x in names])
    mates = rows.select(*key, F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "c", "main", *[F.col(x).alias(b + x) for x in names])
    meet = (F.col("_part") == F.col("part")) & (F.col("_c") != F.col("c")) & ((F.col("c") == F.col("main")) | (F.col(a + names[0]) < F.col(b + names[0])))
    for x in key:
        meet = (F.col(f"_{x}") == F.col(x)) & meet
    return strays, mates, meet


def links(nodes: DataFrame, texts_of, k: int, bands: int, width: int, threshold: float, weighted: bool, rounds: int = 2) -> tuple[DataFrame, DataFrame]:
    """Verified links between distinct texts, and their components.  ``nodes``: node, bands and sketch.

    Each round compares one leader of a bucket with the members of other components.  The first round takes the same
    leaders everywhere over a quarter of the bands (few distinct pairs link most of a class); later ones draw leaders
    anew for each bucket, so that every member meets many.  Rounds only shrink what the last step decides exactly:
    members outside their bucket's largest component are compared with all mates of other components.  Pairs whose
    sketches cannot belong to similar texts leave inside that join."""
    sketch = sketch_names(k)
    rows = nodes.select("node", F.posexplode("bands").alias("band", "bucket"))
    full = rows.groupBy("bucket").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo <> hi").select("bucket")
    members = written(rows.join(full, "bucket"), "members")
    texts = written(texts_of(members.select("node").distinct()), "texts")
    fits = plausible(k, threshold)
    found, labels = None, None

    def more(pairs):
        nonlocal found, labels
        pairs = pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        new = written(similar(pairs, texts, width, threshold, weighted), "similar")
        found = new if found is None else written(found.union(new), "found")
        labels = components(found)

    def undecided():
        """Members with their component, of buckets that hold several."""
        marked = labelled(members, labels, "node", "c")
        open_ = marked.groupBy("bucket").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi").select("bucket")
        return written(marked.join(open_, "bucket"), "open")

    for r in range(rounds):
        rows = undecided() if r else members.where(F.col("band") < max(1, bands // 4)).withColumn("c", F.col("node"))
        order = F.xxhash64("node", "bucket", F.lit(r)) if r else F.xxhash64("node")
        lead = rows.groupBy("bucket").agg(F.min_by("node", order).alias("x"), F.min_by("c", order).alias("x_c"))
        more(rows.select("bucket", "c", F.col("node").alias("y")).join(lead, "bucket").where("c <> x_c"))
    rows, more_of = labelled(members, labels, "node", "c"), nodes.select("node", "bands", *sketch)
    strays, mates, meet = strays_and_mates(rows, ["bucket"], ["node", "band", "bands", *sketch], "x_", "y_", more_of)
    # a pair that shares several buckets is met in the first alone
    first = F.array_position(F.zip_with("x_bands", "y_bands", lambda a, b: a == b), True) == F.col("y_band") + 1
    more(strays.join(mates, meet & fits & first).select(F.col("x_node").alias("x"), F.col("y_node").alias("y")))
    return found, labels


def classes(docs: DataFrame, threshold: float = 0.8, width: int = 5, bands: int = 32, rows: int = 6, k: int = 384, weighted: bool = True, max_broadcast: int = 2_000_000) -> DataFrame:
    """doc_id, node and class_id of every document.

    ``k`` coordinates make the sketch, ``bands * rows`` of them the bands.  Without ``weighted`` every shingle weighs 1.  Texts of candidates are fetched by a broadcast of
    at most ``max_broadcast`` (node, id) pairs; beyond, by a shuffled join.
    """
    k = max(k, bands * rows)
    sigs = written(signed(docs, bands, rows, k, width, weighted), "signed")
    reps = written(sigs.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.first("bands").alias("bands"), *[F.first(c).alias(c) for c in sketch_names(k)]), "reps")

    def texts_of(wanted):
        want = written(reps.join(wanted, "node").select("node", "rep"), "wanted")
        small = F.broadcast(want) if want.count() <= max_broadcast else want
        text = F.col("text").cast("string")
        all_ = docs.select(F.col("doc_id").cast("long").alias("doc_id"), node_key(text).alias("node"), text.alias("text"))
        return all_.join(small, (all_["node"] == small["node"]) & all_["doc_id"].eqNullSafe(small["rep"])).select(all_["node"], "text").dropDuplicates(["node"])

    _, labels = links(reps, texts_of, k, bands, width, threshold, weighted)
    known = light(labels)
    linked = reps.join(known, "node").groupBy("component").agg(F.min("rep").alias("class_rep"))
    class_of = light(written(labels.join(linked, "component").select("node", "class_rep"), "class-of"))
    named = written(reps.join(class_of, "node", "left").select("node", F.coalesce("class_rep", "rep").alias("class_id"), "copies"), "classes")
    return attach(sigs.select("doc_id", "node"), named)


def attach(rows: DataFrame, named: DataFrame) -> DataFrame:
    """Joins each document to its node's class.  Nodes with over a thousandth of all rows (so at most 1000) are broadcast;
    their documents, and those without a node, skip the shuffle by keys that never match."""
    limit = max(1000, rows.count() // 1000)
    hot = named.where(F.col("copies") > limit).select(F.col("node").alias("_hot"), F.col("class_id").alias("_hot_class"))
    marked = rows.join(F.broadcast(hot), rows["node"] == F.col("_hot"), "left")
    alone = F.col("node").isNull() | F.col("_hot").isNotNull()
    keyed = marked.withColumn("_key", F.when(~alone, F.col("node"))).withColumn("_salt", F.when(alone, F.pmod(F.xxhash64("doc_id"), F.lit(4096))).otherwise(-1))
    side = named.where(F.col("copies") <= limit).select(F.col("node").alias("_n"), F.lit(-1).cast("long").alias("_s"), "class_id")
    out = keyed.join(side, (keyed["_key"] == side["_n"]) & (keyed["_salt"] == side["_s"]), "left")
    return out.select("doc_id", "node", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.coalesce("_hot_class", "class_id")).alias("class_id"))


def one_of_each(docs: DataFrame, max_broadcast: int = 2_000_000, **options) -> DataFrame:
    """The rows of ``docs``, all columns, one of each class: that whose id names the class (of repeated rows, one).

    Only ids that go are joined to the texts: by broadcast up to ``max_broadcast`` of them, else by a shuffled join."""
    spare = "_gone_" + "_".join(docs.columns)[:40]
    found = written(classes(docs, max_broadcast=max_broadcast, **options).groupBy("doc_id", "node").agg(F.first("class_id").alias("class_id"), F.count("*").alias("n")), "found")
    keys = [F.col("doc_id").alias(f"{spare}_d"), F.col("node").alias(f"{spare}_n")]
    gone = found.where("not (doc_id <=> class_id)").select(*keys)
    again = found.where("doc_id <=> class_id and n > 1 and node is not null").select(*keys)
    same = docs["doc_id"].cast("long").eqNullSafe(F.col(f"{spare}_d")) & node_key(docs["text"].cast("string")).eqNullSafe(F.col(f"{spare}_n"))
    small = lambda x: F.broadcast(x) if x.count() <= max_broadcast else x
    rest = docs.join(small(gone), same, "left_anti")
    if again.isEmpty():
        return rest
    more = small(again)
    single = docs.join(more, same, "left_semi").dropDuplicates(["doc_id", "text"])
    return rest.join(more, same, "left_anti").unionByName(single)
