"""Main text of web pages by site style trees (operator 3).

Parsing. A page is a tree of its elements with HTML's implied ends; raw-text elements (script, style ..) have no
children. An element's place is its chain of block elements with their classes and roles, digits left out, kept as one
64-bit hash, so depth doesn't matter. Reading takes time in proportion to a page's length, whatever is in it.

Style tree. The distinct pages of a host are merged by place. A merged node's presentation is the sequence of its child
elements, its content the features of the text that stands in it but in no block below: links, images, words of runs of
up to RUN words, and stretches of RUN words of longer runs. With m pages that have the node:

    content = 1 - mean over pages and their features of (log of the pages that have the feature / log m)
    presentation = entropy of the child sequences / log m
    importance = (1 - g^l) presentation + g^l content, g = 0.9, l the number of child sequences; 1 where m = 1

A box that is the same on every page, or whose words are but for a few, has little; one that differs from page to page
has about 1. A branch is removed from a page if it and all nodes below it that have content fall below LEAST.

Priors. What HTML says about an element is added to the importance of what it holds: TAGGED (below 0) for menus, headers,
footers, sidebars, notices, adverts, forms, scripts and comments, by tag, role or class, and for text outside of
article or main where a page has one; KNOWN (above 0) for article, main and what is in them, and for a box that holds
more than half of a page's text. A class or id counts if the whole of it, or all words of a hyphenated one, name such a
part (`site-nav`, not `notice-of-award`). So a host of a single page loses its menu by the prior, an untagged
menu goes by the entropies, and an article that a host repeats stays.

Text. Character references are decoded, white space within a block becomes one space, blocks are joined by a blank
line in page order. Nothing else is dropped or cut.

Scale. Rows of the tree are hashes, summed by host, place and feature within tasks and then by grouped aggregates. Pages
that a host repeats are found by a count of hashes and counted once; a filter of fixed size tells most others apart
without moving them. Places of little importance go to the workers as one sorted array while they are at most `most`;
beyond, they are joined to their pages by host.

Cases. A null html gives an empty text; a null or odd url belongs to the host ''; unclosed, crossed and unknown tags
are read as browsers would, roughly; a '<' that opens no tag is text. Repeated pages count once and are each
returned. Other columns are not returned. An empty table stays empty.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.llm.common import Scratch, read, slices

LEAST, GAMMA, RUN, TAGGED, KNOWN = 0.35, 0.9, 8, -1.0, 1.0
FILTER, MOST = 1 << 22, 200_000
NAME = re.compile(r"/?([a-zA-Z][^\s/>]*)")
STOP = re.compile("[>\"']")
ATTR = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = set(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
OUT = set("head script style title noscript template iframe svg canvas object nav footer aside form button select option textarea dialog menu applet map noembed noframes xmp audio video".split())
WORDS = set(
    "ad ads adbox adsense adslot advert adverts advertisement advertising banner banners sponsor sponsored promo promotion nav navbar navigation menu menubar breadcrumb "
    "breadcrumbs sidebar aside complementary footer contentinfo masthead cookie cookies consent gdpr notice notices notification popup modal overlay newsletter subscribe "
    "subscription signup share sharing social related recommended recommendations comment comments disqus replies respond toolbar login search pagination pager skip".split()
)
HEAD_WORDS = {"header", "banner", "topbar"}
#: words that may stand beside those above in one hyphenated class
BESIDE = set("site main page global top bottom left right primary secondary user reader post bar box list area section wrapper wrap container block inner outer item items link links widget panel policy form unit zone content thread".split())
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "option": {"option"}, "thead": {"tr", "td", "th"}, "tbody": {"thead", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"}, "body": {"head"},
}
FENCE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "thead": {"table"}, "tbody": {"table"}, "tfoot": {"table"}}
NO_P = BLOCK - {"body", "html", "li", "dd", "dt", "td", "th", "tr", "tbody", "thead", "tfoot", "option", "figcaption", "legend", "summary"}




class Node:
    __slots__ = ("tag", "place", "prior", "main", "block", "hidden", "link", "kids")

    def __init__(self, tag: str, place: int, prior: float, main: bool, block: bool, hidden: bool = False, link: str = ""):
        self.tag, self.place, self.prior, self.main, self.block, self.hidden, self.link, self.kids = tag, place, prior, main, block, hidden, link, []


def _hash(data: str, seed: int = 0) -> int:
    x = xxhash.xxh3_64_intdigest(data.encode("utf-8", "surrogatepass"), seed)
    return x - (1 << 64) if x >> 63 else x


def _attributes(tag: str, name: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for k, v in ATTR.findall(tag[len(name) + 1 : -1]):
        out.setdefault(k.lower(), v[1:-1] if v[:1] in "\"'" and v else v)
    return out


def _names_a_part(marks: list[str], words: set[str]) -> bool:
    for mark in marks:
        parts = [x for x in re.split(r"[^a-z]+", mark) if x]
        if any(x in words for x in parts) and all(x in words or x in WORDS or x in BESIDE for x in parts):
            return True
    return False


def _open(name: str, tag: str, above: Node) -> Node:
    at = _attributes(tag, name) if len(tag) > len(name) + 2 else {}
    marks = f"{at.get('class', '')} {at.get('role', '')}".lower().split() if at else []
    main = above.main or name in ("article", "main") or at.get("role") == "main"
    prior = KNOWN if main else 0.0
    if name not in ("body", "html", "article", "main"):
        heads = not main and (name == "header" or _names_a_part(marks, HEAD_WORDS))
        if above.prior < 0 or name in OUT or heads or _names_a_part([*marks, at.get("id", "").lower()] if at else marks, WORDS):
            prior = TAGGED
    hidden = bool(at) and ("hidden" in at or at.get("aria-hidden") == "true" or "display:none" in at.get("style", "").replace(" ", ""))
    block = name in BLOCK
    place = above.place
    if block:
        label = f"{name}.{re.sub('[0-9]+', '', ' '.join(sorted(marks)))}" if marks else name
        place = _hash(label, above.place & (1 << 64) - 1)
    return Node(name, place, prior, main, block, hidden, at.get("href", "") or at.get("src", ""))


class _Stack:
    """Open elements, with the places of each name's and of the block elements, so that no end tag looks through all of them."""

    def __init__(self, root: Node):
        self.nodes, self.of, self.blocks = [root], {}, [0]

    def push(self, node: Node) -> None:
        self.of.setdefault(node.tag, []).append(len(self.nodes))
        if node.block:
            self.blocks.append(len(self.nodes))
        self.nodes.append(node)

    def last(self, names: set[str]) -> int:
        return max((self.of[x][-1] for x in names if self.of.get(x)), default=0)

    def cut(self, k: int) -> None:
        while len(self.nodes) > k:
            node = self.nodes.pop()
            self.of[node.tag].pop()
            if node.block:
                self.blocks.pop()


def parse(page: str) -> Node:
    root = Node("", 0, 0.0, False, True)
    stack, at, n = _Stack(root), 0, len(page)
    last = {c: page.rfind(c) for c in ">\"'"}
    gone = {x: False for x in ("-->", "]]>")}  # marks of which there is none ahead

    def text(a: int, b: int) -> None:
        if a < b:
            stack.nodes[-1].kids.append(entities.unescape(page[a:b]))

    def ahead(mark: str, start: int) -> int:
        k = -1 if gone[mark] else page.find(mark, start)
        gone[mark] = k < 0
        return k

    begin = 0
    while (at := page.find("<", at)) >= 0:
        m = NAME.match(page, at + 1)
        if not m:
            if page.startswith("<!--", at):
                k = ahead("-->", at + 4)
                text(begin, at)
                begin = at = n if k < 0 else k + 3
            elif page.startswith("<![CDATA[", at) and (k := ahead("]]>", at)) >= 0:
                text(begin, at)
                stack.nodes[-1].kids.append(page[at + 9 : k])
                begin = at = k + 3
            elif page[at + 1 : at + 2] in ("!", "?") and last[">"] > at:
                text(begin, at)
                begin = at = page.find(">", at) + 1
            else:
                at += 1
            continue
        end = m.end()
        if last[">"] < end:  # no tag ends any more
            break
        while True:  # a quote counts after '=' if it is closed
            stop = STOP.search(page, end)
            if not stop:
                end = -1
                break
            c, end = stop.group(), stop.end()
            if c == ">":
                break
            if page[at : end - 1].rstrip()[-1:] == "=" if end - at < 4096 else page[end - 2] == "=":
                if last[c] >= end:
                    end = page.find(c, end) + 1
        if end < 0:  # only quoted ends are left
            end = page.find(">", m.end()) + 1
        text(begin, at)
        tag, name = page[at:end], m.group(1).lower()
        begin = at = end
        if tag[1] == "/":
            k = stack.last({name})
            if k and (name in BLOCK or k > stack.blocks[-1]):  # an inline end doesn't close blocks
                stack.cut(k)
            continue
        if name in NO_P and stack.blocks[-1] and stack.nodes[stack.blocks[-1]].tag == "p":  # a block start ends an open paragraph
            stack.cut(stack.blocks[-1])
        if name in CLOSES:
            fence = stack.last(FENCE.get(name, set()))
            while (k := stack.last(CLOSES[name])) > fence:
                stack.cut(k)
        node = _open(name, tag, stack.nodes[-1])
        stack.nodes[-1].kids.append(node)
        if name in RAW:
            close = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>", re.I).search(page, at) if not gone.get(name) else None
            gone[name] = not close
            begin = at = close.end() if close else n
        elif name not in VOID and not tag.endswith("/>"):
            stack.push(node)
    text(begin, n)
    return root


def _gone(x: Node) -> bool:
    """Whether nothing of an element is shown, or looked at."""
    return x.hidden or x.tag in ("head", "script", "style", "template", "noscript")


def features(root: Node) -> dict[int, tuple[str, set[str]]]:
    """By place that has content: (child sequences, features of the text in it but in no block below) of a page."""
    runs: dict[int, list[str]] = {}
    shape: dict[int, list[str]] = {}
    found: dict[int, set[str]] = {}
    todo: list = [root]
    while todo:
        x = todo.pop()
        if isinstance(x, tuple):  # (place, text), or (place,) where a run of text in it ends
            if len(x) == 2:
                runs.setdefault(x[0], []).append(x[1])
            else:
                _take_run(runs, found, x[0])
            continue
        if x.block:
            shape.setdefault(x.place, []).append(" ".join(k.tag for k in x.kids if not isinstance(k, str)))
            todo.append((x.place,))
        if x.link:
            found.setdefault(x.place, set()).add("@" + x.link)
        for k in reversed(x.kids):
            if isinstance(k, str):
                todo.append((x.place, k))
            elif not _gone(k):
                todo += [(x.place,), k, (x.place,)] if k.block else [k]
    return {p: ("|".join(shape.get(p, ())), f) for p, f in found.items()}


def _take_run(runs: dict[int, list[str]], found: dict[int, set[str]], place: int) -> None:
    words = "".join(runs.pop(place, ())).split()
    if words:
        out = found.setdefault(place, set())
        out.update(words if len(words) <= RUN else (" ".join(words[k : k + RUN]) for k in range(0, len(words), RUN)))


def _kept(root: Node, low: frozenset[int]) -> tuple[dict[int, int], set[int]]:
    """(by id of each node its characters of text that no prior is against, ids of the nodes that hold content of importance)."""
    size: dict[int, int] = {}
    holds: set[int] = set()
    todo: list[tuple[Node, Node | None, bool]] = [(root, None, False)]
    while todo:
        x, block, done = todo.pop()
        own = x if x.block else block
        if _gone(x) or x.prior < 0:
            size[id(x)] = 0
        elif done:
            chars = [len("".join(k.split())) if isinstance(k, str) else size[id(k)] for k in x.kids]
            size[id(x)] = sum(chars)
            inline = any(n and (isinstance(k, str) or not k.block) for k, n in zip(x.kids, chars))
            if (inline and x.place not in low) or any(not isinstance(k, str) and id(k) in holds for k in x.kids):
                holds.add(id(x))
        else:
            todo.append((x, block, True))
            todo += [(k, own, False) for k in x.kids if not isinstance(k, str)]
    return size, holds


def _has_main(root: Node) -> bool:
    todo = [root]
    while todo:
        x = todo.pop()
        if x.main and x.prior >= 0 and not x.hidden:
            return True
        todo += [k for k in x.kids if not isinstance(k, str)]
    return False


def extract(page: str | None, low: frozenset[int] = frozenset()) -> str:
    """The main text; low: the host's places of little importance."""
    if not page:
        return ""
    root = parse(page)
    found = _has_main(root)
    size, holds = _kept(root, low) if low else ({}, set())
    blocks: list[str] = []
    held: list[str] = []

    def flush() -> None:
        t = " ".join("".join(held).split())
        held.clear()
        if t:
            blocks.append(t)

    todo: list = [(root, False)]
    while todo:
        x, main = todo.pop()
        if isinstance(x, str):
            if main or not found:
                held.append(x)
            continue
        if x is None:
            flush()
            continue
        prior = max(x.prior, KNOWN if low and 2 * size[id(x)] > size[id(root)] else x.prior)
        little = bool(low) and prior == 0 and x.tag not in ("html", "body", "") and id(x) not in holds
        if _gone(x) or 1 + prior < LEAST or little:
            if x.block:
                flush()
            else:
                held.append(" ")
            continue
        if x.tag in ("br", "wbr", "img", "input"):
            held.append(" " if x.tag != "wbr" else "")
            continue
        if x.block:
            flush()
            todo.append((None, False))
        todo += [(k, x.main) for k in reversed(x.kids)]
    flush()
    return "\n\n".join(blocks)


def _count_rows(count: dict[tuple, int]) -> pa.RecordBatch:
    rows = list(zip(*((*k, n) for k, n in count.items()))) or [()] * 5
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds)], ["host", "place", "kind", "f", "n"])


def node_counts(pages: DataFrame, repeated: np.ndarray | None) -> DataFrame:
    """pages (host, key, html) -> (host, place, kind, f, n): pages with a place (kind 2), a child sequence (0), a feature (1) of it.

    repeated: bits of the keys that are left out.
    """
    asked = pages.sparkSession.sparkContext.broadcast(repeated)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count: dict[tuple, int] = {}
        bits = asked.value
        for b in slices(batches):
            for host, key, page in zip(b.column("host").to_pylist(), b.column("key").to_pylist(), b.column("html").to_pylist()):
                if bits is not None and bits[key % FILTER]:
                    continue
                for place, (shape, found) in features(parse(page or "")).items():
                    for at in ((host, place, 2, 0), (host, place, 0, _hash(shape)), *((host, place, 1, _hash(x)) for x in found)):
                        count[at] = count.get(at, 0) + 1
            if len(count) > 200_000:
                yield _count_rows(count)
                count.clear()
        yield _count_rows(count)

    return pages.mapInArrow(run, "host long, place long, kind int, f long, n long")


def repeated_bits(pages: DataFrame) -> np.ndarray:
    """FILTER flags, set where a key falls that several pages have; FILTER / 64 rows at most reach the driver."""
    again = pages.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select(F.pmod("key", F.lit(FILTER)).alias("p"))
    out = np.zeros(FILTER // 64, np.int64)
    for r in again.groupBy(F.shiftright("p", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("bits")).collect():
        out[r["w"]] = r["bits"]
    return np.unpackbits(out.view(np.uint8), bitorder="little").astype(bool)


def once_each(pages: DataFrame, repeated: np.ndarray) -> DataFrame:
    """Of the pages whose key is marked as repeated, one for each key."""
    asked = pages.sparkSession.sparkContext.broadcast(repeated)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            yield b.filter(pa.array(asked.value[np.asarray(b.column("key")) % FILTER]))

    marked = pages.mapInArrow(run, "host long, key long, html string")
    return marked.groupBy("host", "key").agg(F.first("html").alias("html"))


def style_tree(pages: DataFrame) -> DataFrame:
    """pages (host, key, html), key a hash of host and html -> (host, place, seen, presentation, content, importance)."""
    repeated = repeated_bits(pages)
    rows = node_counts(pages, repeated).union(node_counts(once_each(pages, repeated), None))
    each = rows.groupBy("host", "place", "kind", "f").agg(F.sum("n").cast("double").alias("n"))
    one = lambda k, x: F.sum(F.when(F.col("kind") == k, x))
    log = F.log("n")
    tree = each.groupBy("host", "place").agg(
        one(2, F.col("n")).alias("seen"), one(1, F.col("n") * log).alias("logs"), one(1, F.col("n")).alias("features"), one(0, F.col("n") * log).alias("nlogn"), one(0, F.lit(1.0)).alias("styles")
    )
    m = F.log("seen")
    content = F.when(F.col("seen") > 1, 1 - F.col("logs") / (F.col("features") * m)).otherwise(1.0)
    presentation = F.when(F.col("seen") > 1, (m - F.col("nlogn") / F.col("seen")) / m).otherwise(1.0)
    tree = tree.select("host", "place", "seen", presentation.alias("presentation"), content.alias("content"), F.pow(F.lit(GAMMA), F.col("styles")).alias("g"))
    return tree.select("host", "place", "seen", "presentation", "content", ((1 - F.col("g")) * F.col("presentation") + F.col("g") * F.col("content")).alias("importance"))


def main_text(pages: DataFrame, most: int = MOST) -> DataFrame:
    """pages (page_id, url, html) -> (page_id, url, text, n_chars), a row for each row."""
    spark, scratch = pages.sparkSession, Scratch(pages.sparkSession)
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^\s*[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    pages = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), "html", F.xxhash64(host).alias("host"), F.xxhash64(host, "html").alias("key"))
    low = scratch.table(style_tree(pages.select("host", "key", "html")).where(F.col("importance") < LEAST).select("host", "place"))
    few = low.count() <= most
    shared = None
    if few:
        rows = np.array([(r[0], r[1]) for r in low.collect()], np.int64).reshape(-1, 2)
        shared = spark.sparkContext.broadcast(rows[np.argsort(rows[:, 0], kind="stable")])
    else:
        own = low_of_pages(pages, low).select(F.col("page_id").alias("p"), F.col("key").alias("k"), "low")
        pages = pages.join(own, (F.col("key") == F.col("k")) & F.col("page_id").eqNullSafe(F.col("p")), "left").select("page_id", "url", "html", "host", "low")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, frozenset] = {}
        for b in slices(batches):
            text, hosts = [], b.column("host").to_pylist()
            lists = b.column("low").to_pylist() if shared is None else [None] * len(hosts)
            for page, h, places in zip(b.column("html").to_pylist(), hosts, lists):
                if shared is None:
                    mine = frozenset(places or ())
                elif (mine := known.get(h)) is None:
                    lo, hi = np.searchsorted(shared.value[:, 0], h, "left"), np.searchsorted(shared.value[:, 0], h, "right")
                    mine = frozenset(shared.value[lo:hi, 1].tolist())
                    if mine:  # at most as many as the array has rows
                        known[h] = mine
                text.append(extract(page, mine))
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(text, pa.string()), pa.array(map(len, text), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def low_of_pages(pages: DataFrame, low: DataFrame) -> DataFrame:
    """pages (page_id, host, key, html), low (host, place) -> (page_id, key, low: those of the page's places)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            rows = [(p, k, h, x) for p, k, h, t in zip(*(b.column(c).to_pylist() for c in ("page_id", "key", "host", "html"))) for x in features(parse(t or ""))]
            cols = list(zip(*rows)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["page_id", "key", "host", "place"])

    own = pages.select("page_id", "key", "host", "html").mapInArrow(run, "page_id long, key long, host long, place long")
    low = low.select(F.col("host").alias("lh"), F.col("place").alias("lp"))
    return own.join(low, (F.col("host") == F.col("lh")) & (F.col("place") == F.col("lp"))).groupBy("page_id", "key").agg(F.array_sort(F.collect_set("place")).alias("low"))


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(read(spark, sf_dir, "pages"))
