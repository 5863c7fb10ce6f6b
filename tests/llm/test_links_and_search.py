"""Fingerprint links, hard negatives and ranked search against plain versions and SQL; awkward rows; a session without a shared folder."""

import os
import random
import re
import subprocess
import sys
from collections import Counter

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from plait.llm import hard_negatives, ranked_search, registry, simhash

SF = "/root/testdata/sf0.001"


def same_as_sql(spark, name, tables):
    con = duckdb.connect()
    for t in tables:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    cur = con.execute(registry.SQL[name])
    names = [d[0] for d in cur.description]
    got = registry.QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(names)
    assert sorted(map(tuple, got.select(*names).collect())) == sorted(cur.fetchall())


# operator 11


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_classes(rows, budget):
    """doc index -> (fingerprint, class's smallest id, links), by comparing all."""
    fp = [plain_fingerprint(t) for _, t in rows]
    up = list(range(len(rows)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    links = [0] * len(rows)
    for i in range(len(rows)):
        for j in range(i):
            if (fp[i] ^ fp[j]).bit_count() <= budget:
                links[i] += 1
                links[j] += 1
                up[top(i)] = top(j)
    ids = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            ids[top(i)] = min(d, ids.get(top(i), d))
    return [(d, f"{fp[i]:016x}", ids.get(top(i)), links[i]) for i, (d, _) in enumerate(rows)]


def by_text(rows):
    return sorted(map(tuple, rows), key=str)


@pytest.mark.parametrize("block", [1 << 17, 8])
def test_simhash_classes_are_those_of_all_pairs(spark, block):
    rnd = random.Random(3)
    base = [" ".join(rnd.choice("abcdefgh") * rnd.randint(1, 5) for _ in range(rnd.randint(1, 60))) for _ in range(25)]
    rows = [(i, t) for i, t in enumerate(base)]
    for t in base:
        for _ in range(3):
            w = t.split(" ")
            w[rnd.randrange(len(w))] = "Changed"
            rows.append((len(rows), " ".join(w)))
    rows += [(900, None), (901, ""), (902, " \t\n"), (None, "One Word"), (903, "one\x0bword"), (904, "é\xa0Ünit É"), (904, "é\xa0Ünit É"), (None, base[0])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fp", F.lit("clash")).withColumn("component_id", F.lit(1.5))
    for budget in (2, 9):
        assert by_text(simhash.classes(docs, budget=budget, block=block).collect()) == by_text(plain_classes(rows, budget))


def test_simhash_query_links_every_pair(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert by_text(registry.op11_simhash(spark, SF).collect()) == by_text(plain_classes(rows, 2))


@pytest.mark.parametrize("same", [True, False])
def test_leaf_pairs_are_all_pairs_within_the_budget(same, monkeypatch):
    monkeypatch.setattr(simhash, "FRONTIER", 50)
    rnd = np.random.default_rng(5)
    centre = rnd.integers(0, 1 << 63, 30, dtype="u8")
    flips = lambda n: np.bitwise_xor.reduce(np.uint64(1) << rnd.integers(0, 64, (n, 1), dtype="u8"), axis=1)
    a = np.unique(rnd.choice(centre, 400) ^ flips(400))
    b = a if same else np.unique(rnd.choice(centre, 300) ^ flips(300))
    got = sorted((x, y) for i, j in simhash.leaf_pairs(a, b, 0, 0, 2, same) for x, y in zip(i.tolist(), j.tolist()))
    far = np.bitwise_count(a[:, None] ^ b[None, :])
    want = [(x, y) for x, y in zip(*(k.tolist() for k in np.nonzero(far <= 2))) if not same or x < y]
    assert got == sorted(want) and len(want) > 100


def test_simhash_of_nothing_and_of_a_very_long_text(spark, monkeypatch):
    assert simhash.classes(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    monkeypatch.setattr(simhash, "CHUNK", 100)
    text = " ".join(str(i * i % 977) for i in range(5000))
    assert simhash.fingerprint(text.encode()) == plain_fingerprint(text)


# operator 12


def plain_negatives(rows, anchor, k=5):
    """From (vec_id, label, q): all scores, sorted."""
    out = []
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    for a, la, qa in rows:
        if not anchor(a):
            continue
        scored = sorted(((-dot(qa, q), v, lab) for v, lab, q in rows if v != a))
        for p, pid, _ in [x for x in scored if x[2] == la][:k]:
            fits = [x for x in scored if x[2] != la and 80 * -p <= 100 * -x[0] <= 100 * -p][:k]
            out += [(a, pid, i, v, -p, -s) for i, (s, v, _) in enumerate(fits, 1)]
    return sorted(out)


def test_hard_negatives_query_matches_sql(spark):
    same_as_sql(spark, "op12_hard_negatives", ["embeddings"])


@pytest.mark.parametrize("sizes", [(256, 4096, 32), (3, 7, 2)])
def test_hard_negatives_are_those_of_plain_scores(spark, sizes):
    rnd = random.Random(1)
    rows = [(i, rnd.randrange(3), [rnd.choice([-0.5, -0.01, 0.0, 0.02, 0.7, 1.0]) for _ in range(5)]) for i in range(-4, 60)]
    floor = lambda x: int(np.floor(256 * x))
    plain = [(v, lab, [floor(x) for x in q]) for v, lab, q in rows] + [(500, 1, [floor(3.0)] * 2)]
    odd = [(70, None, [1.0] * 5), (71, 1, None), (72, 1, [1.0, None, 1.0, 1.0, 1.0]), (73, 1, [float("nan")] * 5), (74, 1, [float("inf")] * 5), (None, 1, [1.0] * 5), (500, 1, [3.0, 3.0]), (500, 2, [9.0] * 5), (75, 1, [float("-inf")] + [1.0] * 4)]
    df = spark.createDataFrame(rows + odd + rows[:10], "vec_id long, label int, embedding array<double>").withColumn("q", F.lit("clash")).withColumn("block", F.lit(1))
    got = hard_negatives.mine(hard_negatives.quantised(df), F.col("vec_id") % 5 == 0, anchor_block=sizes[0], row_block=sizes[1], chunk=sizes[2])
    want = plain_negatives(plain, lambda v: v % 5 == 0)
    assert sorted(map(tuple, got.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())) == want and len(want) > 50


def test_hard_negatives_of_nothing(spark):
    empty = spark.createDataFrame([], "vec_id long, label int, embedding array<float>")
    assert hard_negatives.mine(hard_negatives.quantised(empty), F.lit(True)).collect() == []
    one = spark.createDataFrame([(0, 1, [1.0]), (1, 2, [])], "vec_id long, label int, embedding array<float>")
    assert hard_negatives.mine(hard_negatives.quantised(one), F.lit(True)).collect() == []


def test_products_are_exact_or_refused():
    a, b = np.array([[1 << 30, 3]], "i8"), np.array([[(1 << 30) + 1, 5], [7, 1]], "i8")
    assert hard_negatives.product(a, b).tolist() == [[(1 << 30) * ((1 << 30) + 1) + 15, 7 * (1 << 30) + 3]]
    with pytest.raises(OverflowError):
        hard_negatives.product(a << 20, b << 20)


def test_best_of_large_scores_goes_by_the_lower_column():
    s = np.array([[1 << 60, 5, 1 << 60, 1 << 60, 7]], "i8")
    ok = np.array([[False, True, True, True, True]])
    r, c = hard_negatives.best(s, ok, 3)
    assert sorted(c.tolist()) == [2, 3, 4] and r.tolist() == [0, 0, 0]
    r, c = hard_negatives.best(s, np.zeros_like(ok), 3)
    assert c.tolist() == []


# operator 13


def plain_search(docs, items, k):
    words = lambda t: re.findall(ranked_search.TERM, re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    counted = [(d, Counter(words(t))) for d, t in docs]
    counted = [(d, c, sum(c.values())) for d, c in counted if c]
    n, total = len(counted), sum(x[2] for x in counted)
    df = Counter(t for _, c, _ in counted for t in c)
    w = {t: int(np.floor(1000 * np.log((2 * n + 2) / (2 * x + 1)))) for t, x in df.items()}
    asked, out = {}, []
    for i, t in items:
        asked.setdefault(i, set()).update(words(t))
    for i, terms in asked.items():
        scored = [(-sum(w[t] * (10**9 * c[t] // (1000 * c[t] + 20 * (50 + 50 * size * n // total))) for t in terms if t in c), d is None, d or 0, d) for d, c, size in counted]
        out += [(i, r, x[3], -x[0]) for r, x in enumerate(sorted(s for s in scored if s[0] < 0)[:k], 1)]
    return sorted(out, key=str)


def test_ranked_search_query_matches_sql(spark):
    same_as_sql(spark, "op13_ranked_search", ["documents", "benchmark"])


@pytest.mark.parametrize("shard,max_terms,leaf", [(4096, 100_000, 64), (7, 5, 2)])
def test_ranked_search_is_that_of_all_scores(spark, monkeypatch, shard, max_terms, leaf):
    monkeypatch.setattr(ranked_search, "LEAF", leaf)
    monkeypatch.setattr(ranked_search, "FAN", 2)
    rnd = random.Random(2)
    docs = [(rnd.randrange(200), " ".join(rnd.choice(["Ab", "cd-ef", "x1", "Éa", "zz", "q", "q", "w"]) for _ in range(rnd.randint(0, 12)))) for _ in range(120)]
    docs += docs[:30] + [(None, "ab x1"), (None, "q"), (5, None), (6, " -- "), (7, "rare " + "q " * 3000)]
    items = [(1, "AB q"), (2, "cd x1 Éa éa"), (3, "absent"), (4, None), (5, ""), (1, "rare"), (6, "q w zz x1 ab ef cd Éa"), (None, "zz")]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("score", F.lit("clash")).withColumn("term", F.lit(1)).repartition(3)
    got = ranked_search.search(d, spark.createDataFrame(items, "item_id long, text string"), k=9, shard=shard, max_terms=max_terms)
    assert sorted(map(tuple, got.collect()), key=str) == plain_search(docs, items, 9)


def test_a_search_opens_few_documents(spark):
    rows = [(i, "common") for i in range(2000)] + [(5000, "common needle")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    t = ranked_search.index(docs, {b"common": 0, b"needle": 1}, 4096).toArrow()
    tree = ranked_search.Tree(t, np.array([1, 1000], "i8"), 2001, 2002)
    opened = []
    tree.gain = type("Seen", (), {"__getitem__": lambda s, k, g=tree.gain: (opened.append(k), g[k])[1]})()
    docs_, _ = tree.search(np.array([0, 1]), 1, 0)
    assert tree.ids[docs_].tolist() == [5000] and len(opened) == 1


def test_ranked_search_of_nothing(spark):
    docs, items = (spark.createDataFrame([], f"{k} long, text string") for k in ("doc_id", "item_id"))
    some = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert ranked_search.search(docs, items).collect() == [] and ranked_search.search(docs, some).collect() == []
    assert ranked_search.search(some.withColumnRenamed("item_id", "doc_id"), items).collect() == []


# the shared folder

STOCK = """
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
assert spark.conf.get("spark.checkpoint.dir", None) is None
from plait.llm import mixing, near_dups, shared
docs = spark.createDataFrame([(i, "a b c d e f " * (i + 1), "s" + str(i % 2)) for i in range(8)], "doc_id long, text string, source string")
assert near_dups.classes(docs).count() == 8 and mixing.mix(docs).count() == 8
assert shared.shared_dir(spark) == shared.shared_dir(spark)
print("both ran")
"""


def test_writing_operators_run_on_a_stock_session(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = {**os.environ, "SPARK_CONF_DIR": str(tmp_path), "PYTHONPATH": root}
    done = subprocess.run([sys.executable, "-c", STOCK], env=env, capture_output=True, text=True, timeout=900)
    assert "both ran" in done.stdout, done.stderr[-2000:]
