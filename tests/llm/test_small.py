"""Operators of the text pipeline on small fixtures, against brute force, with the awkward cases."""

import math
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from plait.llm import dac, darts, images, licenses, mixing, near_dups, packing, quality, site_trees, tokens, toxicity, urls

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _key string, node string"
WORDS = "amber birch cedar delta ember fjord grove haven inlet jetty knoll lagoon meadow north ocean pine quarry river stone tide".split()


def prose(n, seed):
    r = np.random.default_rng(seed)
    return " ".join(WORDS[i] + str(r.integers(50)) for i in r.integers(0, len(WORDS), n))


@pytest.fixture(scope="module")
def docs(spark):
    base = prose(120, 1)
    rows = [(1, base), (2, base), (3, base.replace("amber", "umber", 1)), (4, prose(120, 2)), (5, ""), (6, None), (7, " \n\t "), (None, prose(60, 3)), (8, "one two"), (8, "one two"), (9, prose(6000, 4)), (10, "x\x1cy\xa0z é Ω 日本 <|endoftext|>")]
    return spark.createDataFrame([(i, t, None, ("a", "b", None)[k % 3], None, "k", "n") for k, (i, t) in enumerate(rows)], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def whole():
    return Tokenizer.from_file(tokens.default_path())


@settings(max_examples=150, deadline=None)
@given(st.text())
def test_chunked_ids_are_the_librarys(text):
    t = tokens.tokenizer(tokens.default_path())
    assert np.frombuffer(t.encode(text), "<u4").tolist() == t.whole.encode(text, add_special_tokens=False).ids


def test_codes_give_any_token():
    ids = np.random.default_rng(0).integers(0, 1 << 30, 3000) >> np.random.default_rng(1).integers(0, 30, 3000)
    s = dac.Shard(dac.encode_shard([1, None], np.array([0, 2500]), ids))
    assert s.tokens().tolist() == ids.tolist() and all(s.token(i) == ids[i] for i in range(0, 3000, 7))
    assert s.doc_ids == [1, None]


def test_lookup_in_the_files(spark, docs, whole, tmp_path):
    rows = sorted(docs.select("doc_id", "text").collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0))
    dac.write(docs, str(tmp_path), shard_tokens=500)
    ids = [x for r in dac.read(spark, str(tmp_path), with_ids=True).orderBy("start").collect() for x in np.frombuffer(r.ids, "<u4").tolist()]
    assert len(ids) == sum(len(whole.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in rows)
    ask = spark.createDataFrame([(p,) for p in [*range(0, len(ids), 37), len(ids) - 1, 0, len(ids), -1, None]], "position long")
    got = {r.position: r.token for r in dac.lookup(ask, str(tmp_path), block=500).collect()}
    assert got == {p: ids[p] for p in [*range(0, len(ids), 37), len(ids) - 1]} | {len(ids): None, -1: None}


def test_round_trip(docs, none, whole):
    got = dac.round_trip(docs).orderBy("start").collect()
    rows = sorted(docs.select("doc_id", "text").collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0))
    start = 0
    for g, r in zip(got, rows, strict=True):
        ids = np.array([*whole.encode(r.text or "", add_special_tokens=False).ids, 2], "<u4")
        assert (g.doc_id, g.start, g.n_tokens, g.ids_crc32) == (r.doc_id, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert dac.round_trip(none).count() == 0


def test_packing_places_each_id_once(docs, none, whole):
    rows = packing.pack(docs, capacity=64, group=5, with_ids=True).collect()
    by_seq, total = {}, 0
    for r in rows:
        assert r.length <= 64 and zlib.crc32(r.ids) == r.ids_crc32
        by_seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
        total += r.length
    for parts in by_seq.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    assert total == sum(len(whole.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in docs.collect())
    assert packing.pack(none).count() == 0


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(1, 100), min_size=1, max_size=80))
def test_tournament_tree_is_first_fit(lengths):
    bins, offsets = packing.first_fit_decreasing(np.array(lengths), 100)
    free, want = [], {}
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        b = next((k for k, f in enumerate(free) if f >= lengths[i]), None)
        if b is None:
            b = len(free)
            free.append(100)
        want[i] = (b, 100 - free[b])
        free[b] -= lengths[i]
    assert [(b, o) for b, o in zip(bins.tolist(), offsets.tolist())] == [want[i] for i in range(len(lengths))]


def test_quality_figures():
    text = "a b c\na b c\n\n  \na b c | x"
    assert quality.word_features(text) == (11, 11, 1, 1, 9)
    assert quality.word_features(None) == quality.word_features("") == (0, 0, 0, 0, 0)


def test_quality_drops_junk_and_keeps_prose(spark, none):
    good = [(i, prose(100, i)) for i in range(60)]
    junk = [(100 + i, " ".join(w.upper() + "%%%" for w in prose(100, 200 + i).split())) for i in range(20)]
    d = spark.createDataFrame(good + junk + [(None, None), (500, "short")], "doc_id long, text string")
    labels = spark.createDataFrame([(i,) for i in range(0, 60, 2)], "doc_id long")
    kept = {r.doc_id for r in quality.judge(d, labels).where("kept").collect()}
    assert kept == set(range(60)) == {r.doc_id for r in quality.kept(d, labels).collect()}
    assert quality.kept(none, labels).count() == 0


def test_toxicity_learns_words(spark, none):
    bad = ["wretchling", "snotgoblin", "mudbrained"]
    rows = [(i, prose(60, i) + (" " + " ".join(bad) + " ") * 2 * (i % 3 == 0)) for i in range(240)] + [(900, None), (901, ""), (902, prose(40_000, 5)), (3, prose(60, 3)), (None, "Mudbrained SNOTGOBLIN " * 9)]
    d = spark.createDataFrame([(i, t, 1.0, "s", "h", 1, 0) for i, t in rows], "doc_id long, text string, score double, sample string, half string, toxic int, part int")
    labels = spark.createDataFrame([(i, int(i % 3 == 0), "x") for i in range(240)] + [(None, 1, "x"), (1, 0, "x")], "doc_id long, toxic int, text string").where(~toxicity.held_out("doc_id"))
    m = toxicity.train(d, labels)
    out = toxicity.score(d, m).collect()
    got = {r.doc_id: r.predicted for r in out}
    hits = sum(got[i] == int(i % 3 == 0) for i in range(240) if i != 3)
    assert len(out) == len(rows) and hits >= 230 and got[900] == got[901] == got[902] == 0 and got[None] == 1
    assert m == toxicity.train(d.repartition(5), labels)
    kept = toxicity.kept(d, m)
    assert kept.columns == d.columns and kept.count() == sum(r.predicted == 0 for r in out)
    assert toxicity.score(none, m).count() == 0 == toxicity.kept(none, m).count()
    one_class = toxicity.train(d, labels.where("toxic = 0"))
    assert one_class.dictionaries is None and toxicity.score(d, one_class).where("score <> 0 or predicted <> 0").count() == 0
    assert toxicity.train(none, labels).dictionaries is None


def plain_code(word):
    """Four bytes for each byte of a word: the upper half of the hash of the word up to it."""
    out = b""
    for n in range(1, len(word) + 1):
        h = sum((b + 1) * pow(darts._BASE, i, 1 << 64) for i, b in enumerate(word[:n])) % (1 << 64)
        out += int(darts.mix(np.array([h], "u8"))[0] >> np.uint64(32)).to_bytes(4, "little")
    return out


def test_toxicity_score_is_that_of_plain_compression():
    d = toxicity.Dictionaries(b"".join(toxicity.coded(prose(400, 1).encode().split())[0] for _ in range(2)), toxicity.coded([b"wretchling", b"mudbrained"])[0])
    c0, c1 = (toxicity._compressor(x).compress for x in (d.ordinary, d.toxic + d.ordinary))
    ws = toxicity.words(prose(90, 2) + " Wretchlings mudbrained averyveryverylongwordthatnodictionaryholds")
    windows = [b"".join(map(plain_code, ws[i : i + toxicity.WINDOW])) for i in range(0, len(ws), toxicity.WINDOW)]
    figures = [len(c0(w)) - len(c1(w)) for w in windows]
    assert toxicity.Distance(d).figures([ws, [], ws[:3]])[0].tolist() == figures and max(figures) > 5
    up = [sum(f >= k for f in figures) for k in range(1, toxicity.UP + 1)] + [sum(f <= -k for f in figures) for k in range(1, toxicity.DOWN + 1)]
    assert np.allclose(toxicity.histogram(np.array(figures)), [*np.log1p(up), *(10 * np.sqrt(np.array(up) / len(windows))), 1])
    assert toxicity.histogram(toxicity.Distance(d).figures([[]])[0]).tolist() == [0.0] * (2 * len(up)) + [1.0]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text("abcé1 ", min_size=1), max_size=12))
def test_codes_agree_as_far_as_words_begin_alike(texts):
    ws = toxicity.words(" ".join(texts))
    b, ends = toxicity.coded(ws)
    parts = [b[i:j] for i, j in zip(ends, ends[1:])]
    assert len(parts) == len(ws)
    for x, p in zip(ws, parts):
        assert p == plain_code(x)
        for y, q in zip(ws, parts):
            alike = next((k for k in range(min(len(x), len(y))) if x[k] != y[k]), min(len(x), len(y)))
            assert p[: 4 * alike] == q[: 4 * alike] and (p[4 * alike :][:4] != q[4 * alike :][:4] or p[4 * alike :] == b"" == q[4 * alike :])


def test_spread_takes_windows_of_the_whole_text():
    ws = [b"%d" % i for i in range(1000)]
    some = toxicity.spread(ws, 100)
    assert len(some) == 100 and int(some[-1]) > 950 and toxicity.spread(ws[:90], 100) == ws[:90]


def test_darts_estimate_weighted_jaccard():
    e = np.arange(400, dtype="u8")
    w = np.random.default_rng(2).uniform(0.1, 3, 400)
    v = np.where(e % 4 == 0, w / 2, w)
    s = darts.signatures(2, np.repeat([0, 1], 400), darts.mix(np.concatenate([e, e]) + np.uint64(9)), np.concatenate([w, v]), 2048)
    assert abs((s[0] == s[1]).mean() - np.minimum(w, v).sum() / np.maximum(w, v).sum()) < 0.04
    w = np.exp2(np.random.default_rng(3).uniform(-3, 12, 400))  # heavy weights cost their logarithm
    v = np.where(e % 4 == 0, w / 3, w)
    s = darts.signatures(2, np.repeat([0, 1], 400), darts.mix(np.concatenate([e, e]) + np.uint64(9)), np.concatenate([w, v]), 2048)
    assert abs((s[0] == s[1]).mean() - np.minimum(w, v).sum() / np.maximum(w, v).sum()) < 0.04


def brute_classes(rows):
    """Classes by weighted Jaccard similarity of all pairs: a shingle that occurs n times weighs 1 + log2(n)."""
    sets, parent = [], list(range(len(rows)))

    def root(i):
        return i if parent[i] == i else root(parent[i])

    for _, t in rows:
        ws = (t or "").encode().split()
        times = Counter(tuple(ws[i : i + 5]) for i in range(max(1, len(ws) - 4))) if ws else {}
        sets.append({s: 1 + math.log2(n) for s, n in times.items()})
    for i in range(len(rows)):
        for j in range(i):
            both = sum(min(w, sets[j][s]) for s, w in sets[i].items() if s in sets[j])
            u = sum(sets[i].values()) + sum(sets[j].values()) - both
            if u and both >= 0.8 * u - 1e-9:
                parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[root(i)] = min(x for x in (least.get(root(i)), d) if x is not None) if d is not None or least.get(root(i)) is not None else None
    return sorted((d is None, d or 0, least[root(i)]) for i, (d, _) in enumerate(rows))


def test_near_duplicates(spark, docs, none):
    r = np.random.default_rng(5)
    rows = [(x.doc_id, x.text) for x in docs.collect()]
    for c in range(4):
        base = prose(150, 50 + c).split()
        for k in range(12):
            w = list(base)
            for i in r.integers(0, 150, int(r.integers(0, 9))):
                w[i] = "edit" + str(r.integers(1000))
            rows.append((1000 + 100 * c + k, " ".join(w)))
            rows.append((3000 + 100 * c + k, " ".join(w[:60] * (1 + k) + w[60:])))  # weights decide
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((x.doc_id is None, x.doc_id or 0, x.class_id) for x in near_dups.classes(d).collect())
    assert got == brute_classes(rows)
    left = near_dups.one_of_each(docs)
    assert left.columns == docs.columns
    ids = [x.doc_id for x in left.collect()]
    assert ids.count(8) == 1 and 2 not in ids and 3 not in ids and {1, 4, 5, 6, 7, 9, 10, None} <= set(ids)
    assert near_dups.one_of_each(none).count() == 0


def test_mixing(spark, docs, none):
    rows = [(i, prose(int(5 + 40 * (i % 7)), i), ("a", "b", "c", None)[min(3, i % 10)]) for i in range(400)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(d).collect()
    assert len(got) == 400 and max(r.copies for r in got) <= 3
    for s in ("a", "b", "c", None):
        own = [r for r in got if r.source == s]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 0.02 * own[0].target
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.mix(d).collect()), key=str)
    assert mixing.mixed(d).count() == sum(r.copies for r in got) and mixing.mixed(d).columns == d.columns
    assert mixing.mix(docs).count() == docs.count() and mixing.mix(none).count() == 0


def test_targets_stop_at_the_ceiling():
    assert mixing.targets([10, 100, 100], [5, 2, 1]) == pytest.approx([30, 120, 60])


def test_licenses(spark, docs, none):
    text = "X Licensed under the Apache License, Version 2.0. Also UNDER the MIT license; cc-by-nc! " + licenses.TEMPLATES[0][1]
    d = spark.createDataFrame([(1, text), (2, None), (3, "the software is free")], "doc_id long, text string")
    r = {x.doc_id: x for x in licenses.scan(d).collect()}
    assert r[1].base_labels == "apache-2,cc-by-nc,mit" == r[1].labels and r[1].n_base == 3 and r[1].score == 1.0
    assert (r[2].n_words, r[2].n_base, r[2].first_word, r[2].labels, r[2].score) == (0, 0, None, "", 0.0) and r[3].labels == ""
    edited = licenses.TEMPLATES[4][1].replace("conditions are met", "terms hold")
    assert [s.label for s in licenses.Scanner().scan(licenses.words("intro " + edited))[1]] == ["bsd"]
    assert licenses.scan(none).count() == 0 and licenses.scan(docs).count() == docs.count()


def test_licences_are_found_by_any_section():
    sc = licenses.Scanner()
    ends = [
        ("mit", "The software is provided 'as is', without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement. In no event shall the authors or copyright holders be liable for any claim, damages or other liability, whether in an action of contract, tort or otherwise, arising from, out of or in connection with the software or the use or other dealings in the software."),
        ("bsd", "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
        ("isc", "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ]
    for label, text in ends:
        assert {s.label for s in sc.scan(licenses.words("intro " + text))[1]} == {label}
    for label, text in licenses.TEMPLATES:
        assert {s.label for s in sc.scan(licenses.words("x " + text + " y"))[1]} == {label}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["under", "the", "mit", "license", "apache", "version", "2", "cc", "by", "nc", "x"]), max_size=40))
def test_phrases_against_brute_force(ws):
    sc = licenses.Scanner()
    places, _ = sc.scan([w.encode() for w in ws])
    want = sorted((i, label) for p, label in licenses.PHRASES for i in range(len(ws)) if ws[i : i + len(p.split())] == p.split())
    assert sorted((i, sc.labels[k]) for i, k in places) == want


PAGE = """<html><head><title>t</title><script>var a="</p>";</script></head><body><header>Site</header><nav><ul><li>Home<li>About</ul></nav>
<div class="cookie-notice">We use cookies</div><div id=x1>Subscribe to all of our letters</div><article><h1>T{i} &amp; more</h1><p>First <b>para {i}<br>line<p>Second &lt;{i}&gt;<aside>side</aside></article>
<div class="comments"><p>nice</p></div><footer>(c)</footer></body></html>"""


def test_main_text(spark):
    rows = [(i, f"http://h.example/{i}", PAGE.replace("{i}", str(i))) for i in range(6)] + [(90, None, None), (91, "http://x/", ""), (92, "http://x/", "plain text <!-- cut")]
    got = {r.page_id: r for r in site_trees.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i in range(6):
        assert got[i].text == f"T{i} & more\n\nFirst para {i} line\n\nSecond <{i}>" and got[i].n_chars == len(got[i].text)
    assert got[90].text == got[91].text == "" and got[92].text == "plain text"
    shuffled = site_trees.extract(spark.createDataFrame(rows, "page_id long, url string, html string"), max_broadcast=0)
    assert {r.page_id: r.text for r in shuffled.collect()} == {k: r.text for k, r in got.items()}


def test_entropy_overrules_roles_in_both_directions(spark):
    page = """<html><body><div id="related-work">Earlier studies of case {i}</div><article><p>Body {i}</p><div>Read this in our app</div></article>
<div class="comments"><p>nice</p></div></body></html>"""
    rows = [(i, f"http://h.example/{i}", page.replace("{i}", str(i))) for i in range(6)] + [(90 + i, f"http://few.example/{i}", page.replace("{i}", str(i))) for i in range(2)]
    got = {r.page_id: r.text for r in site_trees.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == f"Earlier studies of case {i}\n\nBody {i}" for i in range(6))
    assert all(got[90 + i] == f"Body {i}\n\nRead this in our app" for i in range(2))


def test_importance_is_that_of_the_recursive_definition(spark):
    r = np.random.default_rng(4)
    tags = ["div", "section", "p", "ul", "article", "nav"]

    def tree(depth):
        if depth == 0 or r.random() < 0.2:
            return f"<p>{WORDS[r.integers(4)] if r.random() < 0.5 else r.integers(10**6)}</p>"
        t = tags[r.integers(len(tags))]
        return f"<{t} class='{'abc'[r.integers(3)]}'>" + "".join(tree(depth - 1) for _ in range(r.integers(1, 4))) + f"</{t}>"

    rows = [(f"http://h{i % 3}.example/{i}", tree(5)) for i in range(40)] + [("http://one.example/", tree(4))]
    trees = site_trees.merged_trees(spark.createDataFrame(rows, "url string, html string"))
    nodes = {(x.host, x.node): x for x in trees.collect()}
    kids, pages = {}, {}
    for (h, _), x in nodes.items():
        kids.setdefault((h, x.parent), []).append((h, x.node))
        pages[h] = max(pages.get(h, 0), x.m)

    def value(k):
        x, log_m = nodes[k], math.log(max(1, nodes[k].m))
        below = [value(c) for c in kids.get(k, ())]
        parts = [1 - x.text_logk / x.n_texts / log_m if log_m else 1.0] if x.n_texts else []
        own = (1 - x.text_logk / x.n_texts / math.log(max(x.m, 3))) * site_trees.WEIGHTS[x.role] if x.n_texts and pages[k[0]] >= 3 else float(x.role >= 0) if x.n_texts else None
        if below:
            spread = (math.log(x.style_k) - x.style_klogk / x.style_k) / log_m if log_m and x.style_k else 1.0
            fade = 0.9 ** max(1.0, x.n_styles)
            parts.append((1 - fade) * min(1.0, spread) + fade * sum(b[0] for b in below) / len(below))
        leaves = [v for v in [own, *(b[1] for b in below)] if v is not None]
        return max(0.0, min(1.0, max(parts, default=0.0))), max(leaves, default=0.0)

    got = {(x.host, x.node): (x.importance, x.leaf) for x in site_trees.importance(trees).collect()}
    assert got.keys() == nodes.keys() and all(np.allclose(got[k], value(k)) for k in nodes)


def test_main_text_of_awkward_tables(spark):
    deep = "<div>" * 20_000 + "<p>at the bottom</p>" + "</div>" * 20_000
    rows = [(1, "http://deep.example/", deep, "a", 1), (None, "http://deep.example/", None, "a", 1), (2, None, "<p>no host</p>", "a", 1), (2, None, "<p>no host</p>", "a", 1), (3, "x", "<p>" + "long " * 200_000, "a", 1)]
    kind = "page_id long, url string, html string, host string, gone int"
    got = sorted(((r.page_id, r.text, r.n_chars) for r in site_trees.extract(spark.createDataFrame(rows, kind)).collect()), key=str)
    long = ("long " * 200_000).strip()
    assert got == sorted([(1, "at the bottom", 13), (None, "", 0), (2, "no host", 7), (2, "no host", 7), (3, long, len(long))], key=str)
    assert site_trees.extract(spark.createDataFrame([], kind)).count() == 0


def test_unnamed_boilerplate_goes_and_named_content_stays(spark):
    page = "<body><div id=x1>Join two million happy readers</div><div class='sidebar-story'><p>Case {i} of the court</p></div></body>"
    rows = [(i, f"http://court.example/{i}", page.replace("{i}", str(i))) for i in range(30)]
    got = {r.page_id: r.text for r in site_trees.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == f"Case {i} of the court" for i in range(30))


def test_scripts_end_at_their_own_end_tag():
    for script in ("for(i=0;i<n;i++){f()}", "if(a<b){s=\"don't\"}", "x = a<b ? 'it' : \"'\";", "s='</p>'"):
        page = f"<SCRIPT>{script}</Script ><article><p>It's all here</p></article><svg><style>a<b{{}}</style></svg><p>End</p>"
        assert [s for _, s in site_trees.blocks(page)[0]] == ["It's all here", "End"]
    assert [s for _, s in site_trees.blocks("<p>a<script>b</p></scripted><p>c")[0]] == ["a"]


def test_open_tags_cost_no_search():
    """Unmatched ends and repeated items below many open tags: a search of the open stack would take minutes."""
    n = 60_000
    for page in ("<div>" * n + "</p>" * n, "<div>" * n + "<p>x</p>" * n, "<li><ul>" + "<div>" * n + "<li>x</li>" * n):
        start = time.process_time()
        found = site_trees.blocks(page)[0]
        assert len(found) == n * ("x" in page) and time.process_time() - start < 20


def test_url_rules_and_model(spark):
    rows = [(1, "http://A.example.org/es/1?x"), (2, "https://b.org"), (3, "https://b.org/"), (4, "http://example.org/en/12"), (5, "http://m.x.com/de/"), (6, "http://notexample.org/es/1"), (7, None), (8, "no scheme"), (9, "http://www.casino-pills.example.net/en/1"), (10, "http://meadow.example.net/en/1")]
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert got[1] == ("a.example.org", "/es/1", "example.org/es/", "block") and got[2][:3] == ("b.org", "", None)
    assert got[3][2:] == ("org/", "allow") and got[4][2:] == ("example.org/en/1", "block") and got[5][2:] == ("com/de/", "block")
    assert got[6][2:] == ("org/", "allow") and got[7][:3] == got[8][:3] == ("", "", None) and got[9][3] == "block" and got[10][3] == "allow"


def test_image_copies(spark):
    def scene(seed):
        r = np.random.default_rng(seed)
        a = images.resize(r.random((10, 10)), 16)
        for _ in range(25):
            y, x = r.integers(0, 140, 2)
            h, w = r.integers(6, 30, 2)
            a[y : y + h, x : x + w] = r.random()
        return images.smooth(a, 1)

    a, b = scene(1), scene(2)
    shots = [a, a[20:130, 25:140], np.clip(a * 0.8 + 0.1, 0, 1), np.rot90(a), images.resize(a, 0.7), b, b, scene(3)]
    rows = [(i, [float(s.shape[0]), *s.ravel().tolist()]) for i, s in enumerate(shots)] + [(50, None), (None, [1.0, 1.0]), (51, [1.0, 0.5])]
    decode = lambda v: np.array(v[1:]).reshape(int(v[0]), -1)
    got = {r.image_id: r.class_id for r in images.classes(spark.createDataFrame(rows, "image_id long, image array<double>"), decode, per_scale=60).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 0, 4: 0, 5: 5, 6: 5, 7: 7, 50: 50, 51: 51}


def classes_of(ids, pairs):
    up = {i: i for i in ids}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for x, y in pairs:
        up[max(top(x), top(y))] = min(top(x), top(y))
    return {i: top(i) for i in up}


def brute_force_links(spark, found, read, tables, max_distance, max_other):
    """Links of all pairs of descriptors (image_id, place, w0..w3)."""
    w = np.array([f[2:6] for f in found], "<i8")
    ids, bits = np.array([f[0] for f in found]), np.unpackbits(w.view("u1").reshape(len(w), 32), axis=1, bitorder="little").astype("i4")
    differ = lambda x: x @ (1 - x).T + (1 - x) @ x.T
    ok = np.zeros((len(w), len(w)), bool)
    for t in [i * 256 // tables for i in range(tables)]:
        o = (t // 64 + 2) % 4 * 64
        ok |= (differ(bits[:, t : t + read]) == 0) & (differ(bits[:, o : o + 64]) <= max_other)
    ok &= (differ(bits) <= max_distance) & (ids[:, None] < ids[None])
    pairs = [(int(ids[i]), found[i][1], int(ids[j]), found[j][1]) for i, j in np.argwhere(ok)]
    pairs = spark.createDataFrame(pairs, "q_image_id long, q_place long, t_image_id long, t_place long").distinct()
    return sorted((x.query_id, x.image_id) for x in images.consensus(pairs).collect())


@pytest.mark.parametrize("crowded", [3, 64])
def test_image_classes_are_those_of_brute_force(spark, crowded):
    r = np.random.default_rng(8)
    words = lambda: r.integers(-(1 << 63), 1 << 63, 4).tolist()
    pictures, common = [[words() for _ in range(8)] for _ in range(10)], words()
    rows = []
    for i, k in enumerate([0, 1, 2, 3, 0, 4, 5, 1, 6, 0, 7, 8, 9]):  # copies, with strangers in a cell that all share
        for j, w in enumerate(pictures[k]):
            rows.append((i, images.packed_place(8 * j, 4 * j, 1.0, 0.5), w[0] ^ (7 << i), *w[1:]))
        rows.append((i, images.packed_place(90, 90, 1.0, 0.5), *common))
    found = spark.createDataFrame(rows, images.FEATURES)
    links, labels = images.links(found, crowded=crowded)
    want = brute_force_links(spark, rows, 40, 6, 24, 12)
    assert want == [(0, 4), (0, 9), (1, 7), (4, 9)] and {(x.a, x.b) for x in links.collect()} <= set(want)
    assert {i: 0 for i in (0, 4, 9)} | {1: 1, 7: 1} == {x.node: x.component for x in labels.collect()}


def test_image_copies_with_default_parameters(spark):
    r, height = np.random.default_rng(9), lambda a: [float(a.shape[0]), *a.ravel().tolist()]
    decode = lambda v: np.array(v[1:]).reshape(int(v[0]), -1)
    rows, origin = [], {}
    for k in range(14):
        v = r.normal(size=64)
        a = images.from_vector(v)
        edited = a.copy()
        edited[:16, :16] = 0.5
        shots = [a, images.from_vector(v + 0.05 * r.normal(size=64)), np.rot90(a), a[:, 8:], edited, 0.7 * a + 0.2][: 6 if k % 2 == 0 else 1]
        for s in shots:
            origin[len(rows)] = len(rows) if s is a else origin[len(rows) - 1]
            rows.append((len(rows), height(s), "x", 1))
    d = spark.createDataFrame(rows + rows[:3] + [(None, [1.0, 1.0], "x", 1), (900, None, "x", 1), (901, None, "x", 1), (902, [], "x", 1)], "image_id long, image array<double>, same string, cell long")
    got = {x.image_id: x.class_id for x in images.classes(d, lambda v: decode(v) if v else None).collect()}
    assert len(got) == len(rows) + 3 and all(got[i] == i for i in (900, 901, 902))
    found = [(i, images.packed_place(*f[:4]), *f[4:]) for i, v, *_ in rows for f in images.describe(decode(v))]
    assert {i: got[i] for i in origin} == classes_of(origin, brute_force_links(spark, found, 40, 6, 24, 12))
    assert all(got[i] in (i, o) for i, o in origin.items())
    for kind in range(1, 6):  # noise, turn, crop, edit, brightness
        copies = [i for i, o in origin.items() if i - o == kind]
        assert sum(got[i] == origin[i] for i in copies) >= 0.9 * len(copies), kind
    assert images.classes(d.limit(0), decode).count() == 0


def test_image_copies_of_other_scales_and_cuts(spark):
    r, rows = np.random.default_rng(10), []
    decode = lambda v: np.array(v[1:]).reshape(int(v[0]), -1)
    stretched = lambda a: images.sample(a, *np.meshgrid(np.arange(64), np.arange(64) * (a.shape[1] - 1) / 63, indexing="ij"))
    n, edits = 30, 7
    for k in range(n):
        a = images.from_vector(r.normal(size=64))
        small = images.smooth(a)
        for j, s in enumerate([a, images.resize(small, 0.5), images.resize(small, 0.7), images.resize(a, 0.85), images.resize(a, 1.25), images.resize(a, 1.5), a[:, 32:], stretched(a[:, 8:])]):
            rows.append((k * (edits + 1) + j, [float(s.shape[0]), *s.ravel().tolist()]))
    got = {x.image_id: x.class_id for x in images.classes(spark.createDataFrame(rows, "image_id long, image array<double>"), decode).collect()}
    assert all(got[i] // (edits + 1) == i // (edits + 1) for i in got)
    for kind in range(1, edits + 1):
        assert sum(got[k * (edits + 1) + kind] == k * (edits + 1) for k in range(n)) >= 0.9 * n, kind


def test_places_of_large_images():
    assert images.packed_place(260_000.25, 3.5, 1.0, 0.0) != images.packed_place(250_000.25, 3.5, 1.0, 0.0)
    with pytest.raises(ValueError, match="does not fit"):
        images.packed_place(300_000, 1, 1.0, 0.0)


def test_corners_grow_with_the_image():
    a = np.random.default_rng(3).random((64, 64))
    few, many = images.corners(images.smooth(a), 16), images.corners(images.smooth(np.tile(a, (3, 3))), 16)
    assert len(few) == 16 and len(many) == 9 * 16


def test_words_are_ascii_parted():
    assert re.findall(r"[^\x20\x09-\x0D]+", "a\xa0b c") == ["a\xa0b", "c"] and len(quality.word_features("a\xa0b c")) == 5
