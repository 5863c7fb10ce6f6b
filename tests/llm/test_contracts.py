"""The columns that the contracts fix, against DuckDB SQL or plain Python over whole tables."""

import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from plait.llm import quality, registry, shared, urls
from tests.llm.test_small import prose

SF = "/root/testdata/sf0.001"
WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ("documents", "pages", "labels"):
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def test_quality_base_columns(spark, con):
    want = con.execute(f"""with d as (select doc_id, text, {WORDS} as ws from documents),
     t as (select doc_id, i, ws[i] || chr(32) || ws[i + 1] || chr(32) || ws[i + 2] as w from (select doc_id, ws, unnest(generate_series(1, len(ws) - 2)) as i from d)),
     r as (select doc_id, i from (select *, count(*) over (partition by doc_id, w) as n from t) where n > 1),
     p as (select doc_id, count(distinct i + k) as n from r, (select unnest([0, 1, 2]) as k) group by doc_id),
     l as (select doc_id, count(*) - count(distinct line) as n from (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line from documents) where regexp_matches(line, '[^\\x20\\x09-\\x0D]') group by doc_id)
     select doc_id, len(ws) as n_words, coalesce(list_sum([length(w) for w in ws]), 0)::bigint as word_chars, length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]', '', 'g')) as n_symbols,
     coalesce(l.n, 0) as n_dup_lines, coalesce(p.n, 0) as n_repeat_words, len(ws) < 50 or 100 * coalesce(p.n, 0) > 50 * len(ws) as base_failed
     from d left join p using (doc_id) left join l using (doc_id)""").fetchall()
    out = registry.op1_quality(spark, SF)
    assert rows(out, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed") == sorted(want, key=str)
    assert out.where("base_failed and kept").isEmpty()


def test_mixing_targets_and_sums(spark, con):
    sizes = dict(con.execute(f"select source, sum(len({WORDS})) from documents group by source").fetchall())
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, open_, rest = {}, set(names), sum(sizes.values())
    while open_:
        share = {s: rest * weight[s] / sum(weight[t] for t in open_) for s in open_}
        over = {s for s in open_ if share[s] > 3 * sizes[s]}
        for s in over or open_:
            target[s] = 3 * sizes[s] if over else share[s]
        rest -= sum(target[s] for s in over)
        open_ = open_ - over if over else set()
    source = dict(con.execute("select doc_id, source from documents").fetchall())
    taken = dict.fromkeys(names, 0)
    for r in registry.op2_mixing(spark, SF).collect():
        s = source[r.doc_id]
        assert r.source_size == sizes[s] and np.isclose(r.target, target[s]) and 0 <= r.taken <= 3 * r.size
        taken[s] += r.taken
    median = dict(con.execute(f"select source, median(len({WORDS})) from documents group by source").fetchall())  # some sources hold few documents
    assert all(abs(taken[s] - target[s]) <= max(0.01 * target[s], median[s]) for s in names)


def test_url_rules(spark, con):
    order = sorted(urls.RULES, key=lambda r: -len(r[1] + r[2]))
    case = lambda what: "case " + " ".join(f"when (host = '{h}' or ends_with(host, '.{h}')) and starts_with(path, '{p}') then '{what((v, h, p))}'" for v, h, p in order) + " end"
    want = con.execute(f"""with u as (select page_id, case when url like '%://%' then substr(url, instr(url, '://') + 3) else '' end as rest from pages),
     hp as (select page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host, regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') as path from u)
     select page_id, host, path, {case(lambda r: r[1] + r[2])}, {case(lambda r: r[0])} from hp""").fetchall()
    got = {r.page_id: r for r in registry.op8_url_filter(spark, SF).collect()}
    assert len(got) == len(want)
    for page_id, host, path, rule, verdict in want:
        r = got[page_id]
        assert (r.host, r.path, r.rule) == (host, path, rule) and r.verdict == (verdict or ("block" if r.score >= 0.5 else "allow"))


def test_licence_base_columns(spark, con):
    phrases = [("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc")]
    found = " union all ".join(f"select doc_id, i - 1 as pos, '{label}' as label from w where " + " and ".join(f"ws[i + {k}] = '{x}'" for k, x in enumerate(p.split())) for p, label in phrases)
    want = con.execute(f"""with d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as ws from documents),
     w as (select doc_id, ws, unnest(generate_series(1, len(ws))) as i from d), f as ({found}),
     g as (select doc_id, count(*) as n, min(pos) as a, max(pos) as b, string_agg(distinct label, ',' order by label) as labels from f group by doc_id)
     select doc_id, len(ws), coalesce(n, 0), a, b, coalesce(labels, '') from d left join g using (doc_id)""").fetchall()
    out = registry.op10_licenses(spark, SF)
    assert rows(out, "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels") == sorted(want, key=str)
    assert all(set(r.base_labels.split(",")) - {""} <= set(r.labels.split(",")) for r in out.collect())
    gpl = {i for (i,) in con.execute("select doc_id from documents where text like '%licensed under the GNU General Public License, version 3%'").fetchall()}
    assert {r.doc_id for r in out.collect() if "gpl-3" in r.labels.split(",")} >= gpl


def test_url_filter_of_awkward_tables(spark):
    kind = "page_id long, url string, host string, score double, rule string"
    some = [(1, "HTTP://WWW.News.Example/a?b", "h", 1.0, "r"), (1, "HTTP://WWW.News.Example/a?b", "h", 1.0, "r"), (None, None, None, None, None), (2, "x://" + "a" * 200_000 + "/" + "b" * 200_000, "h", 1.0, "r"), (3, "", "h", 1.0, "r"), (4, "a://b://c/d#e", "h", 1.0, "r")]
    got = sorted(((r.page_id, r.host[:20], r.path[:20], r.rule) for r in urls.judge(spark.createDataFrame(some, kind)).collect()), key=str)
    assert got == sorted([(1, "www.news.example", "/a", None)] * 2 + [(None, "", "", None), (2, "a" * 20, "/" + "b" * 19, None), (3, "", "", None), (4, "b:", "//c/d", None)], key=str)
    assert urls.judge(spark.createDataFrame([], kind)).count() == 0


def test_url_model_on_folds():
    """Hosts are kept apart: all rows of a site (its last two names) fall in one fold."""
    part = lambda u: zlib.crc32(".".join(u.split("/")[0].split(".")[-2:]).encode()) % 5
    right, n = Counter(), Counter(y for _, y in urls.LABELLED)
    for fold in range(5):
        model = urls.train(tuple(x for x in urls.LABELLED if part(x[0]) != fold))
        right.update(y for u, y in urls.LABELLED if part(u) == fold and (urls.probability(*urls._cut(u), model) >= 0.5) == bool(y))
    assert right[0] >= 0.85 * n[0] and right[1] >= 0.75 * n[1]
    assert urls.ngrams("www.a.org", "/").tolist() == urls.ngrams("a.org", "/").tolist()


def test_quality_ratio_against_plain_counts(spark):
    def buckets(text, n=4, size=1 << 15):
        b, out = (text or "").encode(), []
        for i in range(len(b) - n + 1):
            h = 0
            for x in b[i : i + n]:
                h = ((h * 0x01000193 & 0xFFFFFFFF) ^ x) * 0x9E3779B1 & 0xFFFFFFFF
            out.append((h >> 7) % size)
        return out

    rows = [(i, prose(70, i)) for i in range(30)] + [(100 + i, " ".join(w[::-1] + "%%" for w in prose(70, 50 + i).split())) for i in range(20)] + [(7, prose(70, 7)), (None, prose(60, 99)), (200, None), (201, ""), (202, "abc"), (203, "tail " * 9000 + prose(100, 98))]
    d = spark.createDataFrame([(*r, 1.0, True, 3, "b") for r in rows], "doc_id long, text string, score double, kept boolean, n_words int, bucket string")
    good = spark.createDataFrame([(i, "x") for i in [*range(0, 20, 2), 7, 7, None]], "doc_id long, text string")
    trusted, raw, target = {*range(0, 20, 2), 7}, np.zeros(1 << 15), np.zeros(1 << 15)
    for i, t in rows:
        for x in buckets(t):
            raw[x] += 1
            target[x] += i in trusted
    ratio = np.log((target + 0.5) / (target.sum() + 0.5 * len(raw))) - np.log((raw + 0.5) / (raw.sum() + 0.5 * len(raw)))
    want = sorted((i, round(float(np.mean([ratio[x] for x in buckets(t)])) if buckets(t) else 0.0, 6)) for i, t in rows if i is not None)
    out = quality.judge(d, good).collect()
    assert sorted((r.doc_id, round(r.score, 6)) for r in out if r.doc_id is not None) == want and len(out) == len(rows)
    assert all(r.kept == (not r.base_failed and r.score >= quality.THRESHOLD) for r in out)
    kept = quality.kept(d, good)
    assert kept.columns == d.columns and sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r.doc_id) for r in out if r.kept)


def test_a_cluster_needs_a_shared_folder():
    class Conf:
        get = staticmethod(lambda *_: None)

    class Context:
        master = "spark://host:7077"
        getConf = staticmethod(lambda: Conf)

    class Session:
        conf, sparkContext = Conf, Context

    with pytest.raises(ValueError, match="checkpoint.dir"):
        shared.shared_dir(Session)
