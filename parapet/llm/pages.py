"""Main text of web pages by wrapper induction.

A bounded set of pages of each host (``SAMPLE`` by hash, documented bound) is parsed into trees of
blocks and aligned pair by pair with simple tree matching. Nodes that are the same in all of them are
template; nodes whose text varies are slots, and the subtree that holds the slots' running text is the
content of the host's wrapper. Every page is then read through the wrapper of its host: its own nodes
are aligned to the wrapper by their paths of labels, in one pass.
"""

from __future__ import annotations

import json
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parapet.llm.common import written

SAMPLE = 8

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = ("script", "style", "textarea", "title", "noscript", "iframe", "template", "xmp")
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var".split())
#: a block of these ends an open paragraph
CLOSES_P = frozenset("address article aside blockquote center details dialog div dl dd dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre search section summary table ul".split())
#: elements that end an open element of the same kind, up to the container that bounds them
SIBLINGS = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}

BOILERPLATE_TAGS = frozenset("head nav header footer aside form script style noscript template iframe svg button select menu dialog object canvas audio video map search".split())
#: words of class, id and role that mark boilerplate
BOILERPLATE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices alert "
    "menu nav navbar navigation breadcrumb breadcrumbs sidebar side footer header masthead comment comments disqus reply replies respond share sharing "
    "social related recommended newsletter subscribe subscription signup login popup modal overlay widget pagination pager skip toolbar search copyright "
    "complementary contentinfo dialog form".split()
)
#: never boilerplate by their class, id or role
NEVER = frozenset(("html", "body", "main", "article"))
#: an element marked by a whole name, or by a part of one, is dropped if it holds no more than this share
#: of the page's running text; a wrapper of the content holds more
WHOLE_SHARE, PART_SHARE = 0.8, 0.3
#: share of a host's pages in which a constant text must stand at its place
CONSTANT_SHARE = 0.9
_WORD = re.compile(r"[a-z]+")
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<[a-zA-Z/!?][^>]*>", re.S)
_ATTR = re.compile(r"(class|id|role|hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_END_RAW = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*>", re.I) for t in RAW}


class Node:
    """A block element: its label, own text runs in order, child blocks, and where each run stands."""

    __slots__ = ("children", "drop", "label", "path", "share", "tag", "text")

    def __init__(self, tag: str, label: str, path: str, drop: bool, share: float = 1.0):
        self.tag, self.label, self.path, self.drop, self.share = tag, label, path, drop, share
        self.children: list[Node] = []
        self.text = ""


def _names(attrs: str) -> tuple[list[str], float]:
    """Words of class, id and role, and the share of text up to which they mark boilerplate (1: none)."""
    out, share = [], 1.0
    for m in _ATTR.finditer(attrs):
        if m[1].lower() == "hidden":
            continue
        for token in (m[2] or m[3] or m[4] or "").lower().split():
            words = _WORD.findall(token)
            out += words
            if not BOILERPLATE_WORDS.isdisjoint(words):
                whole = token in BOILERPLATE_WORDS
                share = WHOLE_SHARE if whole or share == WHOLE_SHARE else PART_SHARE
    return out, share


def _drop_marked(root: Node) -> None:
    """Mark for dropping what names call boilerplate and does not hold too much of the text."""
    order, todo = [], [root]
    while todo:
        x = todo.pop()
        order.append(x)
        todo.extend(x.children)
    size: dict[int, int] = {}
    for x in reversed(order):
        size[id(x)] = 0 if x.drop else len(x.text) + sum(size[id(c)] for c in x.children)
    total = size[id(root)]
    for x in order:
        x.drop = x.drop or (x.share < 1 and size[id(x)] <= x.share * total)
        if x.drop:
            for c in x.children:
                c.drop = True


def parse(html: str | None) -> Node:
    """Tree of blocks. Text runs become leaf nodes labelled ``#text``; inline elements keep their
    text in the block around them unless they are marked as boilerplate. Never raises."""
    root = Node("#root", "", "", False)
    stack, buf, at = [root], [], 0
    html = html or ""

    def flush() -> None:
        if buf:
            text = " ".join(unescape("".join(buf)).split())
            buf.clear()
            if text:
                top = stack[-1]
                leaf = Node("#text", "#text", top.path + "/#text", top.drop)
                leaf.text = text
                top.children.append(leaf)

    def close(tag: str, bounds: tuple[str, ...] = ()) -> None:
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag == tag:
                flush()
                del stack[k:]
                return
            if stack[k].tag in bounds:
                return

    n = len(html)
    while at < n:
        m = _TAG.search(html, at)
        if m is None:
            buf.append(html[at:])
            break
        if m.start() > at:
            buf.append(html[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag in CLOSES_P or tag not in INLINE or any(x.tag == tag for x in stack):
                close(tag)
            continue
        if tag in VOID:
            if tag == "hr":
                flush()
            buf.append(" ")
            continue
        if tag in RAW:
            end = _END_RAW[tag].search(html, at)
            at = end.end() if end else n
            continue
        names, share = _names(m[3]) if m[3] else ([], 1.0)
        marked = tag in BOILERPLATE_TAGS
        if tag in INLINE and not marked and share == 1:
            continue
        flush()
        if tag in CLOSES_P and stack[-1].tag == "p":
            stack.pop()
        if tag in SIBLINGS:
            close(tag, SIBLINGS[tag])
        if m[3].endswith("/") and tag not in CLOSES_P:
            continue
        top = stack[-1]
        label = ".".join([tag, *sorted(set(names))])
        node = Node(tag, label, f"{top.path}/{label}", top.drop, 1.0 if tag in NEVER else share)
        if tag == "header" and any(x.tag == "article" for x in stack):
            marked, node.share = False, 1.0
        node.drop = node.drop or marked
        top.children.append(node)
        stack.append(node)
    flush()
    _drop_marked(root)
    return root


def leaves(node: Node) -> Iterator[Node]:
    """Text runs in page order."""
    todo = [node]
    while todo:
        x = todo.pop()
        if x.tag == "#text":
            yield x
        todo.extend(reversed(x.children))


def tree_match(a: Node, b: Node) -> list[tuple[Node, Node]]:
    """Simple tree matching: the largest set of node pairs with equal labels that keeps order and
    parents. Only the alignment of children is searched; a pair is worth its matched descendants."""
    pairs: list[tuple[Node, Node]] = []

    def score(x: Node, y: Node) -> tuple[int, list]:
        if x.label != y.label:
            return 0, []
        p, q = x.children, y.children
        if not p or not q:
            return 1 + (x.text == y.text), []
        sub = [[score(i, j) for j in q] for i in p]
        w = [[0] * (len(q) + 1) for _ in range(len(p) + 1)]
        for i in range(1, len(p) + 1):
            row, above, s = w[i], w[i - 1], sub[i - 1]
            for j in range(1, len(q) + 1):
                row[j] = max(above[j], row[j - 1], above[j - 1] + s[j - 1][0])
        i, j, chosen = len(p), len(q), []
        while i and j:
            if w[i][j] == w[i - 1][j]:
                i -= 1
            elif w[i][j] == w[i][j - 1]:
                j -= 1
            else:
                i, j = i - 1, j - 1
                chosen.append((p[i], q[j], sub[i][j][1]))
        return 1 + w[len(p)][len(q)], chosen[::-1]

    def collect(x: Node, y: Node, chosen: list) -> None:
        pairs.append((x, y))
        for i, j, deeper in chosen:
            collect(i, j, deeper)

    value, chosen = score(a, b)
    if value:
        collect(a, b, chosen)
    return pairs


def content_root(trees: list[Node]) -> str:
    """Path of the node that holds the running text: an article, else main, else the deepest node
    with most of the text that is not boilerplate."""
    mass: Counter[str] = Counter()
    for t in trees:
        for x in leaves(t):
            if not x.drop:
                parts = x.path.split("/")[:-1]
                for k in range(1, len(parts) + 1):
                    mass["/".join(parts[:k])] += len(x.text)
    total = mass.get("", 0)
    for tag in ("article", "main"):
        named = [p for p in mass if p.rsplit("/", 1)[-1].split(".")[0] == tag]
        if named:
            # the outermost of the heaviest
            return min(named, key=lambda p: (-mass[p], p.count("/"), p))
    heavy = [p for p in mass if 10 * mass[p] >= 7 * total and p.rsplit("/", 1)[-1].split(".")[0] not in ("p", "li", "h1")]
    return max(heavy, key=lambda p: (p.count("/"), p), default="")


def induce(htmls: list[str]) -> dict:
    """Wrapper of a host: path of the content and the constant texts inside it.

    Constant texts need at least three pages whose contents differ in more than half of their blocks,
    and must stand at aligned nodes of all of them; so copies of one article never make it template.
    """
    trees = [parse(h) for h in dict.fromkeys(htmls)]
    root = content_root(trees)
    chosen: list[tuple[Node, set[str]]] = []
    for t in trees:
        own = {x.text for x in leaves(t) if not x.drop and inside(x.path, root)}
        if own and all(2 * len(own & other) < len(own | other) for _, other in chosen):
            chosen.append((t, own))
    constant: dict[str, list[str]] = {}
    if len(chosen) >= 3:
        same: dict[int, int] = defaultdict(int)
        first = chosen[0][0]
        for t, _ in chosen[1:]:
            for a, b in tree_match(first, t):
                if a.tag == "#text" and a.text == b.text:
                    same[id(a)] += 1
        for x in leaves(first):
            if same[id(x)] == len(chosen) - 1 and not x.drop and inside(x.path, root):
                constant.setdefault(x.path, []).append(x.text)
    return {"root": root, "constant": constant}


def inside(path: str, root: str) -> bool:
    return path.startswith(root + "/") or not root


def extract(html: str | None, wrapper: dict | None) -> str:
    """Content blocks of a page through its host's wrapper, joined by a newline. A page that has
    nothing at the wrapper's place is read through a wrapper of its own."""
    tree = parse(html)
    blocks = [x for x in leaves(tree) if not x.drop]
    if not blocks:
        return ""
    found = [x for x in blocks if inside(x.path, wrapper["root"])] if wrapper else []
    if not found:
        own = content_root([tree])
        return "\n".join(x.text for x in blocks if inside(x.path, own))
    constant = wrapper["constant"]
    return "\n".join(x.text for x in found if x.text not in constant.get(x.path, ()))


def host(url: str = "url"):
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def wrappers(pages: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(host, wrapper JSON), from at most ``sample`` pages of each host, the first by hash in each of
    ``sample`` slots; the counts and the choice use partial aggregates, so a hot host is no hot task."""
    keyed = pages.select(host().alias("host"), "page_id", F.xxhash64("page_id", "url").alias("h"), "html").filter("html is not null and html <> ''")
    picked = keyed.groupBy("host", F.pmod("h", F.lit(sample)).alias("slot")).agg(F.min("h").alias("h")).select("host", "h")
    picked = written(picked)
    chosen = keyed.join(picked, ["host", "h"], "left_semi").groupBy("host", "h").agg(F.max("html").alias("html"))

    def learn(t: pa.Table) -> pa.Table:
        rows = sorted(zip(t.column("h").to_pylist(), t.column("html").to_pylist(), strict=True))
        return pa.table({"host": [t.column("host")[0].as_py()], "wrapper": [json.dumps(induce([x for _, x in rows]))]}, schema=pa.schema([("host", pa.string()), ("wrapper", pa.string())]))

    return chosen.groupBy("host").applyInArrow(learn, "host string, wrapper string")


def counted(pages: DataFrame, found: DataFrame) -> DataFrame:
    """``found`` (host, wrapper) with those constant texts only that stand at their place in
    CONSTANT_SHARE of all pages of the host that have its content; counts are summed before the shuffle."""
    keyed = pages.select(host().alias("host"), "html").filter("html is not null and html <> ''")
    asked = written(found.filter("wrapper not like '%\"constant\": {}%'"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, dict] = {}
        for b in batches:
            seen: Counter[tuple[str, str | None, str | None]] = Counter()
            for h, page, w in zip(*(b.column(c).to_pylist() for c in ("host", "html", "wrapper")), strict=True):
                if w not in known:
                    if len(known) > 10_000:
                        known.clear()
                    known[w] = json.loads(w)
                here = {(x.path, x.text) for x in leaves(parse(page)) if not x.drop and inside(x.path, known[w]["root"])}
                if here:
                    seen[h, None, None] += 1
                    seen.update((h, p, t) for p, texts in known[w]["constant"].items() for t in set(texts) if (p, t) in here)
            rows = [(*k, n) for k, n in seen.items()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64() if i == 3 else pa.string()) for i in range(4)], names=["host", "path", "text", "n"])

    rows = keyed.join(asked, "host").select("host", "html", "wrapper").mapInArrow(run, "host string, path string, text string, n bigint")
    rows = written(rows.groupBy("host", "path", "text").agg(F.sum("n").alias("n")))
    of_host = rows.filter("path is null").select("host", F.col("n").alias("pages"))
    kept = rows.filter("path is not null").join(of_host, "host").filter(F.col("n") >= CONSTANT_SHARE * F.col("pages"))
    kept = kept.groupBy("host").agg(F.collect_list(F.struct("path", "text")).alias("kept"))

    @F.udf("string")
    def only(wrapper, kept):
        constant: dict[str, list[str]] = {}
        for p, t in sorted(kept or ()):
            constant.setdefault(p, []).append(t)
        return json.dumps({"root": json.loads(wrapper)["root"], "constant": constant})

    return found.join(kept, "host", "left").select("host", only("wrapper", "kept").alias("wrapper"))


def main_text(pages: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(page_id, url, text, n_chars), one row for each row of ``pages``.

    A null or empty html, or one without content, gives an empty text; a null url is a host of its
    own; repeated rows give repeated results; other columns are ignored; no rows give no rows.
    """
    keyed = pages.select("page_id", "url", "html", host().alias("_host"))
    learned = written(counted(pages, written(wrappers(pages, sample))))
    joined = keyed.join(learned.withColumnRenamed("host", "_host"), "_host", "left").select("page_id", "url", "html", "wrapper")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, dict] = {}
        for b in batches:
            texts = []
            for page, w in zip(b.column("html"), b.column("wrapper").to_pylist(), strict=True):
                if w is not None and w not in known:
                    if len(known) > 10_000:
                        known.clear()
                    known[w] = json.loads(w)
                texts.append(extract(page.as_py(), known[w] if w is not None else None))
            yield pa.RecordBatch.from_arrays([b.column("page_id").cast(pa.int64()), b.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return joined.mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint")
