"""Main text of web pages by wrapper induction.

Pages of one host and layout (the kinds of container elements that a page has) share a wrapper. A few of them, of other
content each, are aligned by simple tree matching: nodes that some of them lack enter the wrapper too, nodes that hold
the same text wherever they stand are template, and the node under which most of the varying text lies is the content
region. A page is aligned with its wrapper: the node matched to the region holds the main text, without the template
nodes in it and what its markup says is boilerplate. Markup alone decides for pages without a wrapper, or that match no
region of theirs, or where the region has less than half of the text of an article element elsewhere.
"""

from __future__ import annotations

import html as entities
import json
import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ampline.llm.common import release, small_batches, stage

#: Pages of a host and layout that a wrapper is induced from, at most; each of other content.
EXAMPLES = 8
#: Pages in which a paragraph or heading must stand, always with the same text, to be template; for containers 2 do.
SURE = 4
#: Examples that a layout needs for a wrapper of its own; pages of rarer ones take that of all the host's pages.
LAYOUT = 3
#: Bytes of wrappers, or of the examples' names, up to which they are broadcast; beyond, they are joined by a shuffle.
BROADCAST_BYTES = 64 << 20
#: Elements nested deeper stand side by side; cells of an alignment beyond which equal labels are paired in order.
DEPTH, CELLS = 120, 1 << 20

TOKEN = re.compile(r"<!--.*?(?:-->|$)|<![^>]*>|<\?[^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
ATTR = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)

# Elements of HTML by how they are parsed and shown.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style noscript template textarea title iframe xmp noembed noframes".split())
BLOCK = set("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul br option select".split())
CLOSES_P = BLOCK - set("body br dd dt html li option select summary tbody td tfoot th thead tr".split())
IMPLIED = {"li": ({"li"}, {"ul", "ol", "menu"}), "dd": ({"dd", "dt"}, {"dl"}), "dt": ({"dd", "dt"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}), "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}), "body": ({"head"}, {"html"})}
PRUNED = RAW | set("nav footer aside form head button select option menu dialog svg math canvas audio video object embed input".split())
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "alert", "alertdialog", "dialog", "menu", "menubar", "form", "toolbar"}
# Names of classes and ids that mark boilerplate.
WORDS = "ad ads adbox adslot advert adverts advertisement advertising sponsor sponsored sponsors promo promotion promoted banner sidebar sidebars menu navbar nav navigation topnav breadcrumb breadcrumbs footer masthead siteheader topbar cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup login comment comments commentlist disqus respond replies share sharing social related recommended pagination pager widget toolbar skip".split()
MARK = re.compile(r"(?:^|[-_])(?:" + "|".join(WORDS) + r")(?:$|[-_])|^(?:site|page|global|top)[-_]?header$|^header$|^(?:comment|ad|advert|cookie)\d+$", re.I)

NUMBER = re.compile("[0-9]+")


class Node:
    __slots__ = ("tag", "marks", "kids", "parent", "text", "depth")

    def __init__(self, tag: str, marks: tuple[str, ...], parent: Node | None):
        self.tag, self.marks, self.kids, self.parent, self.text = tag, marks, [], parent, None
        self.depth = parent.depth + 1 if parent else 0

    def nodes(self) -> list[Node]:
        return [k for k in self.kids if type(k) is Node]


def parse(page: str) -> Node:
    """Tree of elements and decoded texts; closes what HTML closes by itself and takes any input."""
    root = here = Node("#root", (), None)
    at, flat = 0, []  # flat: open elements that are nested too deep to be entered
    n = len(page)
    while at < n:
        m = TOKEN.search(page, at)
        if not m:
            # a tag cut off by the page's end holds no text
            last = page.rfind("<", at)
            end = last if last >= 0 and re.match(r"</?[a-zA-Z!]", page[last : last + 3]) else n
            if end > at:
                here.kids.append(entities.unescape(page[at:end]))
            break
        if m.start() > at:
            here.kids.append(entities.unescape(page[at : m.start()]))
        at = m.end()
        tag = m[2]
        if not tag:
            continue
        tag = tag.lower()
        if m[1]:
            if tag in flat:
                while flat.pop() != tag:
                    pass
                continue
            up = here
            while up is not root and up.tag != tag:
                up = up.parent
            if up is not root:
                here = up.parent
            continue
        if tag in CLOSES_P:
            up = here
            while up is not root and up.tag not in ("p", "article", "div", "section", "td", "th", "li", "main", "body"):
                up = up.parent
            if up.tag == "p":
                here = up.parent
        if rule := IMPLIED.get(tag):
            up, found = here, None
            while up is not root and up.tag not in rule[1]:
                if up.tag in rule[0]:
                    found = up
                up = up.parent
            if found:
                here = found.parent
        marks = ()
        if m[3]:
            marks = tuple(w if k[0].lower() != "r" else f"role:{w}" for k in ATTR.findall(m[3]) for w in (["hidden"] if k[0].lower() == "hidden" or (k[0].lower() == "aria-hidden" and (k[1] or k[2] or k[3]) == "true") else [] if k[0].lower() == "aria-hidden" else (k[1] or k[2] or k[3]).lower().split()))
        node = Node(tag, marks, here)
        here.kids.append(node)
        if tag in RAW:
            end = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            at = end.end() if end else n
        elif tag not in VOID and not m[3].endswith("/"):
            if node.depth < DEPTH:
                here = node
            else:
                flat.append(tag)
    return root


def text_of(node: Node) -> str:
    """All text below a node, white space as it is."""
    if node.text is None:
        node.text = "".join(k if type(k) is str else f" {text_of(k)} " if k.tag in BLOCK else text_of(k) for k in node.kids) if node.tag not in RAW else ""
    return node.text


def boilerplate(node: Node, inside: bool) -> bool:
    """Whether markup says that a node is no article text. inside: below the content region, where headers may be its own."""
    if node.tag in ("html", "body"):
        return False
    if node.tag in PRUNED or (node.tag == "header" and not inside):
        return True
    hit = any(m == "hidden" or (m[5:] in ROLES if m.startswith("role:") else MARK.search(m) and not (inside and m == "header")) for m in node.marks)
    return hit and not any(k.tag in ("article", "main") and not any(MARK.search(m) for m in k.marks) for k in descendants(node))


def descendants(node: Node) -> Iterator[Node]:
    stack = node.nodes()
    while stack:
        k = stack.pop()
        yield k
        stack.extend(k.nodes())


def label(node: Node) -> tuple:
    return node.tag, tuple(NUMBER.sub("", m) for m in node.marks) if node.marks else ()


def match(a: list, b: list, label_a, label_b, kids_a, kids_b) -> tuple[int, list[tuple]]:
    """Simple tree matching of two forests in order: the most matched nodes, and the matched pairs.

    Equal childless nodes at the front and the end of both are paired at once, which loses no match; between them, the
    best alignment by dynamic programming, each pair's gain being its own match.
    """
    lo, hi_a, hi_b = 0, len(a), len(b)
    pairs: list[tuple] = []
    plain = lambda x, y: label_a(x) == label_b(y) and not kids_a(x) and not kids_b(y)
    while lo < hi_a and lo < hi_b and plain(a[lo], b[lo]):
        pairs.append((a[lo], b[lo]))
        lo += 1
    while hi_a > lo and hi_b > lo and plain(a[hi_a - 1], b[hi_b - 1]):
        hi_a, hi_b = hi_a - 1, hi_b - 1
        pairs.append((a[hi_a], b[hi_b]))
    gain = len(pairs)
    x, y = a[lo:hi_a], b[lo:hi_b]
    if len(x) * len(y) > CELLS:
        at: dict = {}
        for j, q in enumerate(y):
            at.setdefault(label_b(q), []).append(j)
        j = -1
        for p in x:
            there = at.get(label_a(p), [])
            k = bisect_right(there, j)
            if k < len(there):
                j = there[k]
                pairs.append((p, y[j]))
                gain += 1
                if (kp := kids_a(p)) and (kq := kids_b(y[j])):
                    more, inner = match(kp, kq, label_a, label_b, kids_a, kids_b)
                    gain += more
                    pairs.extend(inner)
    elif x and y:
        best = {}
        rows = [[0] * (len(y) + 1)]
        for i, p in enumerate(x):
            row, above = [0], rows[-1]
            lp, kp = label_a(p), kids_a(p)
            for j, q in enumerate(y):
                g = 0
                if lp == label_b(q):
                    kq = kids_b(q)
                    if kp and kq:
                        best[i, j] = match(kp, kq, label_a, label_b, kids_a, kids_b)
                        g = 1 + best[i, j][0]
                    else:
                        g = 1
                row.append(max(above[j + 1], row[-1], above[j] + g if g else 0))
            rows.append(row)
        i, j = len(x), len(y)
        gain += rows[i][j]
        while i and j:
            if rows[i][j] == rows[i - 1][j]:
                i -= 1
            elif rows[i][j] == rows[i][j - 1]:
                j -= 1
            else:
                i, j = i - 1, j - 1
                pairs.append((x[i], y[j]))
                pairs.extend(best[i, j][1] if (i, j) in best else ())
    return gain, pairs


class Slot:
    """Node of a wrapper: its label, children, the text that it always has (else None), the varying characters below, and
    in how many examples it stands."""

    __slots__ = ("label", "kids", "text", "first", "mass", "region", "seen")

    def __init__(self, node: Node):
        self.label, self.kids, self.mass, self.region = label(node), [Slot(k) for k in node.nodes()], 0, False
        self.text = self.first = said(node)
        self.seen = 1


def said(node: Node) -> str:
    return " ".join(text_of(node).split())


def page_match(slots: list[Slot], node: Node) -> list[tuple]:
    return match(slots, node.nodes(), lambda s: s.label, label, lambda s: s.kids, lambda n: n.nodes())[1]


def induce(pages: list[str]) -> str:
    """Wrapper of pages of one host and layout, as JSON."""
    trees = [parse(p) for p in pages]
    root = Slot(trees[0])
    for tree in trees[1:]:
        pairs = [(root, tree), *page_match(root.kids, tree)]
        slot_of = {id(node): s for s, node in pairs}
        for s, node in pairs:
            s.seen += 1
            own = said(node)
            if own != s.first:
                s.text = None
                s.mass += len(own) + len(s.first)
            # what the wrapper lacks so far enters it behind the sibling before
            behind = None
            for k in node.nodes():
                there = slot_of.get(id(k))
                if there is None:
                    there = Slot(k)
                    s.kids.insert(s.kids.index(behind) + 1 if behind else 0, there)
                behind = there
    every = [root]
    for s in every:
        every.extend(s.kids)
    for s in every:
        if s.seen == 1:  # of one page alone: all of it varies
            s.mass = len(s.first)
    find_region(root).region = True

    def told(s: Slot) -> list:
        return [s.label[0], list(s.label[1]), s.text if s.seen > 1 else None, s.seen, s.region, [told(k) for k in s.kids]]

    return json.dumps(told(root), ensure_ascii=False)


def find_region(root: Slot) -> Slot:
    """From the root down while one child holds most of the varying text; an article or main element ends the descent."""
    here = root
    while True:
        if here.label[0] in ("article", "main"):
            return here
        able = [k for k in here.kids if k.label[0] not in PRUNED and k.label[0] != "header" and not any(MARK.search(m) for m in k.label[1] if not m.startswith("role:"))]
        top = max(able, key=lambda k: (k.label[0] in ("article", "main"), k.mass, len(k.text or "")), default=None)
        if top is None or not top.mass or top.label[0] not in ("html", "body", "div", "section", "article", "main", "table", "tbody", "tr", "td", "center"):
            return here
        if top.label[0] not in ("article", "main") and top.mass * 5 < 3 * sum(k.mass for k in able):
            return here
        here = top


class _Wrapper:
    def __init__(self, told: list):
        self.label, self.text, self.seen, self.region, self.kids = (told[0], tuple(told[1])), told[2], told[3], told[4], [_Wrapper(k) for k in told[5]]


@lru_cache(maxsize=64)
def loaded(wrapper: str) -> _Wrapper:
    return _Wrapper(json.loads(wrapper))


#: Containers: constant ones are template if two pages have them; for other elements see SURE.
SHELL = set("div ul ol section table span a dl small center details".split())


def inside(node: Node, others: list[Node]) -> bool:
    """Whether a node is one of the others or below one."""
    ids = {id(o) for o in others}
    while node is not None and id(node) not in ids:
        node = node.parent
    return node is not None


def main_text(page: str | None, wrapper: str | None) -> str:
    """Main text of a page; without a wrapper, or where the page does not match its region, markup alone decides.

    Constant nodes in the region are no template if they make up over half of its text: then the examples are copies.
    """
    if not page:
        return ""
    tree = parse(page)
    regions: list[Node] = []
    constant: list[Node] = []
    if wrapper:
        w = loaded(wrapper)
        for s, node in page_match(w.kids, tree):
            if s.region:
                regions.append(node)
            elif s.text and s.seen >= (2 if node.tag in SHELL else SURE) and s.text == said(node):
                constant.append(node)
    every = list(descendants(tree))[::-1]
    marked = [n for n in every if n.tag == "article" and not boilerplate(n, False)] or [n for n in every if (n.tag == "main" or "role:main" in n.marks) and not boilerplate(n, False)]
    mass = lambda nodes: sum(len(said(n)) for n in nodes)
    if regions and marked:
        near = [m for m in marked if inside(m, regions) or inside(regions[0], [m])]
        if near and not all(n in constant for n in near):
            regions = marked if near[0].tag == "article" else near  # an article and those beside it
        elif 2 * mass(regions) < mass(marked):
            regions = marked
    sure = not regions or any(inside(r, marked) for r in regions)
    regions = regions or marked
    sure = sure and bool(regions)
    regions = regions or [n for n in every if n.tag == "body"][:1] or [tree]
    chosen = {id(r) for r in regions}
    cut = [n for n in constant if id(n) not in chosen and inside(n.parent, regions)]
    outer = [n for n in cut if not inside(n.parent, cut)]
    if 2 * mass(outer) > mass(regions):
        cut = [] if sure or mass(outer) == mass(regions) else [n for n in cut if n.tag in SHELL]
    template = {id(n) for n in cut}
    out: list[str] = []

    def walk(node: Node, within: bool) -> None:
        for k in node.kids:
            if type(k) is str:
                if within:
                    out.append(k)
            elif id(k) in chosen:
                if not boilerplate(k, False) or k.tag in ("article", "main"):
                    out.append("\n")
                    walk(k, True)
                    out.append("\n")
            elif not boilerplate(k, within) and id(k) not in template and not (within and not sure and mostly_links(k)):
                if k.tag in BLOCK:
                    out.append("\n")
                walk(k, within)
                if k.tag in BLOCK:
                    out.append("\n")

    walk(tree, tree in regions)
    return " ".join("".join(out).split())


def mostly_links(node: Node) -> bool:
    """A list or block of which links make up over half of the text."""
    if node.tag not in ("ul", "ol", "div", "table"):
        return False
    total = len(text_of(node).strip())
    return total > 0 and 2 * sum(len(text_of(k).strip()) for k in descendants(node) if k.tag == "a") > total


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


CONTAINERS = r"(?i)<(?:div|section|article|main|nav|header|footer|aside|form|table)(?:\s[^>]*)?>"


def layout(html: Column) -> Column:
    """Hash of the kinds of containers that a page has: element names with their classes, without digits."""
    kind = lambda x: F.concat(F.lower(F.regexp_extract(x, r"^<(\w+)", 1)), F.lit(" "), F.regexp_replace(F.regexp_extract(x, "(?i)\\sclass\\s*=\\s*[\"']?([^\"'>]*)", 1), "[0-9]+", ""))
    return F.xxhash64(F.array_join(F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(html, F.lit(CONTAINERS), F.lit(0)), kind))), "\n"))


def _bounded(df: DataFrame, size: Column) -> DataFrame:
    """df, broadcast if its bytes are known to be few."""
    total = df.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    return F.broadcast(df) if total <= BROADCAST_BYTES else df


def host_wrappers(pages: DataFrame, url_col: str = "url", html_col: str = "html", examples: int = EXAMPLES) -> DataFrame:
    """(host, layout, wrapper): for each layout of a host with LAYOUT examples or more, and with null as layout for all its
    pages. Examples are the pages of the least hash in each of `examples` classes of page contents.

    Examples are chosen by aggregations of hashes over all pages, so a host of any size sends few rows; then the chosen
    pages are fetched. They differ in content, and copies of one page count once. Written in the shared folder.
    """
    own = pages.where(F.length(html_col) > 0).select(host(F.col(url_col)).alias("host"), layout(F.col(html_col)).alias("layout"), F.xxhash64(html_col).alias("o"))
    seen = stage(own.groupBy("host", "layout", F.pmod("o", F.lit(examples)).alias("part")).agg(F.min("o").alias("o")))
    often = seen.groupBy("host", "layout").agg(F.count("*").alias("n")).where(F.col("n") >= LAYOUT).drop("n")
    all_ = seen.groupBy("host", "part").agg(F.min("o").alias("o")).select("host", F.lit(None).cast("bigint").alias("layout"), "o")
    chosen = stage(seen.join(often, ["host", "layout"]).select("host", "layout", "o").unionByName(all_))
    named = pages.where(F.length(html_col) > 0).select(F.xxhash64(html_col).alias("o"), F.col(html_col).alias("h"))
    fetched = stage(named.join(_bounded(chosen.select("o").distinct(), F.lit(32)), "o", "left_semi").groupBy("o").agg(F.min("h").alias("h")))

    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"host": [key[0]], "layout": pd.array([key[1]], dtype="Int64"), "wrapper": [induce(sorted(pdf["h"]))]})

    out = stage(chosen.join(fetched, "o").groupBy("host", "layout").applyInPandas(one, "host string, layout long, wrapper string"))
    release(seen, chosen, fetched)
    return out


def extract_main(pages: DataFrame, url_col: str = "url", html_col: str = "html", out: str = "main_text", examples: int = EXAMPLES) -> DataFrame:
    """Add the main text of each page. Null or empty html gives an empty text; a null or odd url belongs to the empty host.

    Rows that repeat get equal texts; a page of any length is read whole. A column named out is replaced, others stay,
    whatever their names. Wrappers are broadcast while their bytes are few; beyond, pages meet them by a join on host
    and layout, of which Spark splits the large parts.
    """
    small_batches(pages.sparkSession)
    wrappers = host_wrappers(pages, url_col, html_col, examples)
    special = _bounded(wrappers.where("layout is not null").select(F.col("host").alias("__host"), F.col("layout").alias("__layout"), F.col("wrapper").alias("__own")), F.octet_length("__own"))
    general = _bounded(wrappers.where("layout is null").select(F.col("host").alias("__host"), F.col("wrapper").alias("__all")), F.octet_length("__all"))

    @F.pandas_udf("string")
    def extracted(htmls: pd.Series, ws: pd.Series) -> pd.Series:
        return pd.Series([main_text(h, w) for h, w in zip(htmls, ws)], dtype=object)

    keep = [c for c in pages.columns if c != out]
    own = pages.select(F.struct(*keep).alias("__page") if keep else F.lit(None).alias("__page"), F.col(html_col).alias("__html"), host(F.col(url_col)).alias("__host"), layout(F.col(html_col)).alias("__layout"))
    done = own.join(special, ["__host", "__layout"], "left").join(general, "__host", "left")
    done = done.withColumn("__text", extracted(F.col("__html"), F.coalesce("__own", "__all")))
    return done.select(*[F.col("__page")[c].alias(c) for c in keep], F.col("__text").alias(out))
