"""HTML main text by site style trees (operator 5).

The DOMs of a host's pages are merged into one tree: a node is a path of tags and classes.  Presentation
nodes keep the styles of their children (sequences of tags), content nodes the texts of their blocks, each
with the number of pages that have it.  From these come entropies: a content node whose texts stand on every
page of the host, or a presentation node with one style everywhere, tells nothing of a page.  Branches of low
composite importance are removed from each page.  Known roles weigh a block's importance: texts unique to a page stay in spite of a
noise word in a name (``id="related-work"``), and texts on every page go in spite of ``<article>``.  Noise by tag or by a
whole name (``<nav>``, ``class="ad"``) always goes: such texts are often unique to a page.  Roles decide alone for hosts
with too few pages to compare.

Importance is carried up the tree one level a round, by joins on (host, parent), so that no task gets a whole host.  Nodes below
``MAX_DEPTH`` levels are merged with their ancestor on that level; their texts count, and stay or go, with it.

* null or empty html, and pages without an important block, give an empty text with 0 characters.
* null urls share the empty host; null ids are kept; repeated rows are extracted one by one.
* cut-off tags, comments and scripts run to the end of the page; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
import zlib
from collections import defaultdict
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plait.llm.shared import written
from plait.llm.urls import host_and_path

#: HTML's element kinds.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe svg math object canvas select".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Those whose content is text, not markup, up to their own end tag.
RAW_TEXT = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*>?", re.I) for t in "script style noscript textarea title iframe".split()}
CLOSED_BY_SELF = frozenset("p li dt dd tr td th option".split())
#: Roles known in advance.
NOISE_TAGS = frozenset("nav footer aside form button dialog menu head label fieldset".split())
NOISE_NAMES = frozenset("ad ads advert adverts advertisement advertising sponsored sponsor promo promotion banner cookie cookies consent gdpr notice notices alert sidebar side menu nav navbar navigation breadcrumb breadcrumbs footer header masthead comment comments reply replies respond disqus share sharing social related recommended newsletter subscribe subscription signup login popup modal overlay widget toolbar pagination pager skip".split())
CONTENT_TAGS = frozenset(("article", "main"))

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)|[^<]+|<", re.S)
_NAMES = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_SPLIT = re.compile(r"[^a-z]+")

NO_PARENT = -1
#: Roles of a node: noise by its tag or a whole class or id (-2), by a word within one (-1), content (1), unknown (0); what a
#: role multiplies importance by.  At the threshold of 0.3 entropy can overrule all but -2.
WEIGHTS = {-2: 0.25, -1: 0.5, 0: 1.0, 1: 1.5}
MAX_DEPTH = 48
EMITTED = "host string, node long, parent long, depth int, kind int, role int, feature long"


class _Node:
    __slots__ = ("tag", "key", "up", "depth", "parent", "role", "children", "kept")

    def __init__(self, tag: str, names: frozenset[str], parent: _Node | None, whole: frozenset[str] = frozenset(), gone: frozenset[int] = frozenset()):
        self.tag, self.parent, self.children = tag, parent, []
        role = parent.role if parent else 0
        named = tag not in CONTENT_TAGS and tag != "body" and tag != "html"
        noise = tag in NOISE_TAGS or (tag == "header" and role <= 0) or (named and not whole.isdisjoint(NOISE_NAMES))
        self.role = -2 if role < -1 or noise else -1 if role < 0 or (named and not names.isdisjoint(NOISE_NAMES)) else 1 if role > 0 or tag in CONTENT_TAGS else 0
        if parent and parent.depth >= MAX_DEPTH:
            self.key, self.up, self.depth = parent.key, parent.up, parent.depth
        else:
            step = f"{tag}.{'.'.join(sorted(names))}{'!' * noise}".encode()
            self.key = zlib.crc32(step, parent.key & 0xFFFFFFFF if parent else 0) | (zlib.adler32(step, parent.key >> 32 & 0x7FFFFFFF if parent else 1) & 0x7FFFFFFF) << 32
            self.up, self.depth = (parent.key, parent.depth + 1) if parent else (NO_PARENT, 0)
        self.kept = (parent is None or parent.kept) and self.key not in gone


def blocks(page: str | None, gone: frozenset[int] = frozenset()) -> tuple[list[tuple[_Node, str]], list[_Node]]:
    """The blocks of a page in order, each with its node, and all its presentation nodes; those at or below a node in ``gone`` are not kept."""
    root = _Node("#", frozenset(), None, gone=gone)
    stack, nodes, out, text = [root], [root], [], []
    places = defaultdict(list)  # where in the stack each tag is open, so that no tag has to search it
    raw = None  # the element whose raw text is being skipped

    def flush():
        if text:
            s = " ".join(entities.unescape("".join(text)).split())
            text.clear()
            if s:
                out.append((stack[-1], s))

    def cut(i):
        while len(stack) > i:
            places[stack.pop().tag].pop()

    def pop_to(i):
        flush()
        cut(i)

    def last(tags):
        return max((places[t][-1] for t in tags if places[t]), default=0)

    page, at = page or "", 0
    while at < len(page):
        m = _TOKEN.match(page, at)
        at, tag = m.end(), m[2] or m[5]
        if tag and not (m[1] or m[4]) and (end := RAW_TEXT.get(tag.lower())) and not (m[3] or m[6] or "").endswith("/"):
            e = end.search(page, at)
            at = e.end() if e else len(page)
            text.append(" " if not raw else "")
            continue
        if raw:
            if tag and (m[1] or m[4]) and tag.lower() == raw:
                raw = None
            continue
        if not tag:
            s = m[0]
            if s[0] != "<" or s == "<":
                text.append(s)
            continue
        tag, ending, attrs = tag.lower(), m[1] or m[4], m[3] or m[6] or ""
        if tag in RAW:
            if not ending and not attrs.endswith("/"):
                raw = tag
            text.append(" ")
            continue
        names = whole = frozenset()
        if "=" in attrs and not ending:
            values = ["".join(a).lower() for a in _NAMES.findall(attrs)]
            names = frozenset(x for v in values for x in _SPLIT.split(v) if x)
            whole = frozenset(x for v in values for x in v.split())
        if tag in INLINE and (ending or names.isdisjoint(NOISE_NAMES)):
            if tag == "br":
                text.append(" ")
            elif ending and last((tag,)) >= max(1, len(stack) - 3):  # an inline element that a noise name made a block
                pop_to(last((tag,)))
            continue
        if ending:
            if up := last((tag,)):
                pop_to(up)
            else:
                flush()
            continue
        flush()
        if tag in VOID:
            continue
        if tag in CLOSED_BY_SELF:
            same = ("td", "th") if tag in ("td", "th") else ("dt", "dd") if tag in ("dt", "dd") else (tag,)
            stop = ("ul", "ol", "menu") if tag == "li" else ("table",) if tag in ("tr", "td", "th") else ("dl",) if tag in ("dt", "dd") else ()
            if (i := last(same)) > last((*stop, "tr") if tag in ("td", "th") else stop):
                cut(i)
        elif stack[-1].tag == "p":
            cut(len(stack) - 1)
        node = _Node(tag, names, stack[-1], whole, gone)
        stack[-1].children.append(tag)
        places[tag].append(len(stack))
        stack.append(node)
        nodes.append(node)
    flush()
    return out, nodes


def _hash(s: str) -> int:
    b = s.encode("utf-8", "surrogatepass")
    return zlib.crc32(b) << 31 ^ zlib.adler32(b)


def merged_trees(pages: DataFrame) -> DataFrame:
    """One row a host and node: pages with it, and for its styles and its texts their number and sums for the entropies."""

    def emitted(batches):
        for b in batches:
            cols = [[] for _ in range(7)]
            for host, page in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                found, nodes = blocks(page)
                rows = set()
                for n in nodes:
                    at = (host, n.key, n.up, n.depth)
                    rows.add((*at, 0, n.role, 0))  # the page has the node
                    if n.children:
                        rows.add((*at, 1, n.role, _hash(" ".join(n.children))))
                rows |= {(host, n.key, n.up, n.depth, 2, n.role, _hash(s)) for n, s in found}
                for c, x in zip(cols, zip(*rows)):
                    c += x
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["host", "node", "parent", "depth", "kind", "role", "feature"])

    rows = pages.select(host_and_path(F.col("url").cast("string"))[0].alias("host"), F.col("html").cast("string").alias("html")).mapInArrow(emitted, EMITTED)
    at = ("host", "node", "parent", "depth")
    counted = rows.groupBy(*at, "kind", "feature").agg(F.count("*").alias("k"), F.max("role").alias("role"))
    one = lambda kind, x: F.coalesce(F.sum(F.when(F.col("kind") == kind, x)), F.lit(0.0))
    k = F.col("k").cast("double")
    return counted.groupBy(*at).agg(
        F.max("role").alias("role"), one(0, k).alias("m"),
        one(1, F.lit(1.0)).alias("n_styles"), one(1, k).alias("style_k"), one(1, k * F.log(k)).alias("style_klogk"),
        one(2, F.lit(1.0)).alias("n_texts"), one(2, F.log(k)).alias("text_logk"),
    )


def importance(trees: DataFrame, min_pages: int = 3, gamma: float = 0.9) -> DataFrame:
    """(host, node, n_texts, importance, leaf) of the merged trees.

    ``importance`` is the composite one: 1 less the mean entropy of a node's texts over pages, or the spread of its styles with its children's
    mean importance.  ``leaf`` is that of the most important block at or below a node: its texts' entropy times the weight of
    its role; on hosts of under ``min_pages`` pages the role decides alone.  The deepest level comes first; each is a written table."""
    trees = written(trees, "site-trees")
    pages = trees.where("depth = 0").groupBy("host").agg(F.max("m").alias("pages"))
    log_m = F.log(F.greatest("m", F.lit(1.0)))
    told = F.try_divide(F.col("text_logk"), F.col("n_texts"))
    weight = F.element_at(F.create_map(*[F.lit(x) for kv in WEIGHTS.items() for x in kv]), F.col("role"))
    block = F.when(F.col("pages") >= min_pages, (1 - told / F.log(F.greatest("m", F.lit(float(max(min_pages, 2)))))) * weight).otherwise((F.col("role") >= 0).cast("double"))
    texts = F.when(F.col("n_texts") > 0, F.when(log_m > 0, 1 - told / log_m).otherwise(1.0))
    spread = F.when((log_m > 0) & (F.col("style_k") > 0), (F.log("style_k") - F.col("style_klogk") / F.col("style_k")) / log_m).otherwise(1.0)
    fade = F.pow(F.lit(gamma), F.greatest("n_styles", F.lit(1.0)))
    rows = trees.join(pages, "host").select("host", "node", "parent", "depth", "n_texts", texts.alias("texts"), F.when(F.col("n_texts") > 0, block).alias("block"), fade.alias("fade"), F.least(F.lit(1.0), spread).alias("spread"))
    rows, levels, below = written(rows, "site-nodes"), [], None
    for depth in range(trees.agg(F.max("depth")).first()[0] or 0, -1, -1):
        level = rows.where(F.col("depth") == depth)
        if below is None:
            level = level.withColumns({"kids": F.lit(None).cast("double"), "kids_leaf": F.lit(None).cast("double")})
        else:
            kids = below.groupBy(F.col("host").alias("_h"), F.col("parent").alias("_p")).agg(F.avg("importance").alias("kids"), F.max("leaf").alias("kids_leaf"))
            level = level.join(kids, (F.col("host") == F.col("_h")) & (F.col("node") == F.col("_p")), "left")
        styles = (1 - F.col("fade")) * F.col("spread") + F.col("fade") * F.col("kids")
        value = F.least(F.lit(1.0), F.greatest(F.coalesce(F.greatest("texts", styles), F.lit(0.0)), F.lit(0.0)))
        below = written(level.select("host", "node", "parent", "n_texts", value.alias("importance"), F.coalesce(F.greatest("block", "kids_leaf"), F.lit(0.0)).alias("leaf")), "site-level")
        levels.append(below)
    return reduce(DataFrame.union, levels).drop("parent")


def removed_nodes(trees: DataFrame, threshold: float = 0.3, min_pages: int = 3) -> DataFrame:
    """(host, node) of branches to remove: without an important block at or below them, and, unless they hold blocks, of low importance themselves."""
    low = (F.col("leaf") < threshold) & ((F.col("importance") < threshold) | (F.col("n_texts") > 0))
    return importance(trees, min_pages).where(low).select("host", "node")


def extract(pages: DataFrame, threshold: float = 0.3, max_broadcast: int = 500_000) -> DataFrame:
    """Each page's main text.  The removed nodes go to the tasks as a broadcast up to ``max_broadcast`` of them; beyond,
    each host's list is joined to its pages with salts, so that a hot host is dealt over many tasks."""
    spark = pages.sparkSession
    gone = written(removed_nodes(merged_trees(pages), threshold), "removed-nodes")
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"), host_and_path(F.col("url").cast("string"))[0].alias("host"))
    few = gone.count() <= max_broadcast
    if few:
        by_host: dict[str, set[int]] = {}
        for r in gone.toLocalIterator():
            by_host.setdefault(r.host, set()).add(r.node)
        known = spark.sparkContext.broadcast(by_host)
        rows = rows.withColumn("gone", F.lit(None).cast("array<long>"))
    else:
        known, salts = None, 64
        lists = gone.groupBy("host").agg(F.collect_list("node").alias("gone")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        rows = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(salts)).cast("int")).join(lists, ["host", "salt"], "left").drop("salt")

    def texts(batches):
        for b in batches:
            host, page, lists = (b.column(i).to_pylist() for i in (2, 3, 4))
            out = []
            for h, p, more in zip(host, page, lists):
                gone = known.value.get(h, frozenset()) if known else frozenset(more or ())
                kept = [s for n, s in blocks(p, gone)[0] if n.kept]
                out.append("\n\n".join(kept))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.string()), pa.array([len(s) for s in out], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return rows.select("page_id", "url", "host", "html", "gone").mapInArrow(texts, f"page_id {kind}, url string, text string, n_chars long")
