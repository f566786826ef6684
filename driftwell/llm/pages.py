"""Main text of web pages with a site style tree.

The pages of one host are merged into one tree. An element node (its path of tags and classes) has one style per
sequence of children that pages show under it. Its presentation importance is the entropy of its styles over the
host's pages: layout that never changes carries nothing. A content leaf's importance is one minus the entropy of
its content over the pages: text that most pages repeat carries nothing, the less certain the fewer pages there are, as if
one more page showed something else. A branch counts by both,
(1 - g**l) * presentation + g**l * content for a parent with l styles, so that a sentence shared by many pages inside an
article, whose layout differs from page to page, stays, while the same notice in the same place goes. Branches below
the threshold are removed from each page.

What a host's pages cannot tell is settled by the roles that HTML names: navigation, headers, footers, asides, forms,
adverts, notices and comments have importance 0, and where a page marks its article, what stands outside has 0 too.

Trees of all hosts are counts per (host, node, style) and (host, node, content), merged before any shuffle, so a host
with a third of all pages is not one task's work.
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftwell.llm.rows import arrow_map, as_text, stored, utf8

THRESHOLD = 0.1
GAMMA = 0.9
# Pages, not seen and different, that a host's pages are counted with: few pages prove little.
UNSEEN = 1
BROADCAST_ROWS = 100_000

# Fixed values of HTML.
BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section "
    "summary table tbody td tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe textarea svg math object video audio canvas noframes xmp".split())
# A start tag ends an open element of these kinds.
ENDS = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "option": {"option"}, "optgroup": {"option", "optgroup"}, "thead": {"tr", "td", "th"}, "tbody": {"tr", "td", "th", "thead", "tbody"},
}
SCOPES = frozenset("html body table ul ol dl select article main section div nav aside footer header form blockquote td th button".split())
ENDS_P = BLOCKS - frozenset("br body html head caption tbody td tfoot th thead tr title optgroup option legend".split())

# Roles without importance.
NOISE_TAGS = frozenset("head nav header footer aside form menu dialog search select button fieldset".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
NOISE_WORDS = frozenset(
    "ad ads adbox advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr "
    "notice popup modal overlay sidebar sidebars aside menu nav navbar navigation breadcrumb breadcrumbs footer header masthead "
    "comment comments commentlist disqus reply replies share sharing social related recommended newsletter subscribe signup "
    "login search pagination pager widget toolbar toc skip".split()
)
MAIN_TAGS = frozenset(["article", "main"])

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<[!?/][^>]*+(?:>|\Z)", re.S
)
_ATTRIBUTE = re.compile(r"([^\s=\"'/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_CUT_TAG = re.compile(r"<[a-zA-Z][^<]*\Z")
_WORDS = re.compile(r"[a-z0-9]+")
_HOST = re.compile(r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", re.I)


def number(text: str) -> int:
    h = xxhash.xxh64_intdigest(text)
    return h - (1 << 64) if h >> 63 else h


class Element:
    __slots__ = ("tag", "parent", "path", "noise", "main", "holds_main", "children")

    def __init__(self, tag: str, parent: Element | None, style: str, noise: bool):
        self.tag, self.parent, self.noise = tag, parent, noise
        self.path = f"{parent.path}>{style}" if parent else style
        self.main = tag in MAIN_TAGS
        self.holds_main = False
        self.children: list[str] = []


def _attributes(text: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for name, a, b, c in _ATTRIBUTE.findall(text):
        found.setdefault(name.lower(), a or b or c)
    return found


def _element(tag: str, rest: str, parent: Element | None) -> Element:
    style, noise = tag, tag in NOISE_TAGS
    if "=" in rest or "hidden" in rest:
        a = _attributes(rest)
        named = f"{a.get('class', '')} {a.get('id', '')}".lower()
        noise = noise or a.get("role", "").lower() in NOISE_ROLES or "hidden" in a or a.get("aria-hidden") == "true"
        noise = noise or not NOISE_WORDS.isdisjoint(_WORDS.findall(named)) or "display:none" in a.get("style", "").replace(" ", "").lower()
        style = f"{tag}.{a['class']}" if a.get("class") else tag
    # Classes of the whole page ("has-sidebar") say nothing about it.
    return Element(tag, parent, style, noise and tag not in ("html", "body"))


def parse(page: str) -> tuple[list[tuple[Element, str]], list[Element]]:
    """Text blocks (element, text) in page order, and all elements. Broken markup never fails."""
    blocks: list[tuple[Element, str]] = []
    root = Element("", None, "", False)
    elements, open_ = [root], [root]
    text: list[str] = []
    lower = None

    def flush() -> None:
        if text:
            joined = " ".join("".join(text).split())
            text.clear()
            if joined:
                blocks.append((open_[-1], joined))

    def add(chunk: str) -> None:
        if chunk:
            text.append(html.unescape(chunk) if "&" in chunk else chunk)

    def close(until: int) -> None:
        if any(e.tag in BLOCKS for e in open_[until:]):
            flush()
        del open_[until:]

    at = 0
    while True:
        m = _TAG.search(page, at)
        if m is None:
            break
        add(page[at : m.start()])
        at = m.end()
        tag = m.group(2)
        if tag is None:
            if m.group().startswith("<![CDATA["):
                add(m.group()[9:].removesuffix("]]>"))
            continue
        tag = tag.lower()
        if m.group(1):
            for i in range(len(open_) - 1, 0, -1):
                if open_[i].tag == tag:
                    if tag in BLOCKS:
                        flush()
                    close(i)
                    break
            continue
        if tag in RAW:
            lower = page.lower() if lower is None or len(lower) != len(page) else lower
            if not m.group(3).endswith("/"):
                end = lower.find(f"</{tag}", at)
                end = len(page) if end < 0 else end
                gt = page.find(">", end)
                at = len(page) if gt < 0 else gt + 1
            continue
        if tag in BLOCKS:
            flush()
        ends = ENDS.get(tag, ())
        for i in range(len(open_) - 1, 0, -1):
            name = open_[i].tag
            if name in ends or (name == "p" and tag in ENDS_P):
                close(i)
                if not ends:
                    break
            elif name in SCOPES and name not in ends:
                break
        parent = open_[-1]
        parent.children.append(tag)
        if tag in VOID:
            continue
        made = _element(tag, m.group(3), parent)
        elements.append(made)
        if made.main and not made.noise:
            up: Element | None = parent
            while up is not None and not up.holds_main:
                up.holds_main = True
                up = up.parent
        open_.append(made)
    add(_CUT_TAG.sub("", page[at:]))
    flush()
    return blocks, elements


def block_kinds(blocks: list[tuple[Element, str]], root: Element) -> list[bool]:
    """Whether roles leave each block in: no noisy element above it (one that holds the article is a mere frame), and
    inside the article where one is marked."""
    known: dict[int, tuple[bool, bool]] = {}

    def state(e: Element) -> tuple[bool, bool]:
        chain, up = [], e
        while up is not None and id(up) not in known:
            chain.append(up)
            up = up.parent
        clean, inside = known[id(up)] if up is not None else (True, False)
        for x in reversed(chain):
            clean, inside = clean and not (x.noise and not x.holds_main), inside or (x.main and not x.noise)
            known[id(x)] = clean, inside
        return clean, inside

    return [clean and (inside or not root.holds_main) for clean, inside in (state(e) for e, _ in blocks)]


_TREE = """host string, digest long, blocks array<struct<node: long, content: long, kept: boolean, text: string>>,
    styles array<struct<node: long, style: long>>"""


def parsed_pages(df: DataFrame, names: list[str]) -> DataFrame:
    """One row per page of ``df`` (``names``, url, raw): its host, blocks, and the style of each element that has children."""
    fields = "".join(f"{n} {df.schema[n].dataType.simpleString()}, " for n in names)

    def run(rows: pa.Table) -> dict:
        out: dict = {c: [] for c in ("host", "digest", "blocks", "styles")}
        for url, raw in zip(rows["url"].to_pylist(), rows["raw"].to_pylist()):
            page = as_text(raw)
            blocks, elements = parse(page)
            kept = block_kinds(blocks, elements[0])
            found = _HOST.match(url or "")
            out["host"].append(found.group(1).lower() if found else "")
            out["digest"].append(number(page))
            # A block hangs on the parent of its element: repeated siblings are children of one node.
            out["blocks"].append([
                {"node": number((e.parent or e).path), "content": number(f"{e.path}\n{t}"), "kept": k, "text": t if k else None}
                for (e, t), k in zip(blocks, kept)
            ])
            out["styles"].append([{"node": number(e.path), "style": number(" ".join(e.children))} for e in elements if e.children])
        return {n: rows[n] for n in names} | out

    return arrow_map(df, run, fields + _TREE)


def low_branches(trees: DataFrame, threshold: float, gamma: float, unseen: float) -> DataFrame:
    """(host, node, content) of branches whose importance lies below ``threshold``.

    Pages that are equal byte for byte count once, and a page counts once per node, style or content. The entropy of a
    content on c of m pages is taken over m + ``unseen`` pages, so a single page never loses anything and a host of any
    size is judged by one formula.
    """
    slim = trees.select("uid", "host", "digest", F.transform("blocks", lambda b: F.struct(b["node"].alias("node"), b["content"].alias("content"))).alias("blocks"), "styles")
    first = trees.groupBy("host", "digest").agg(F.min("uid").alias("uid")).select("uid")
    pages = stored(slim.join(first, "uid"), "page-trees")
    styles = pages.select("host", F.explode(F.array_distinct("styles")).alias("s")).groupBy("host", "s.node", "s.style").agg(F.count(F.lit(1)).alias("n"))
    # An element that a page shows several times with different children counts once for each.
    total = styles.groupBy("host", "node").agg(F.sum("n").alias("m"), F.count(F.lit(1)).alias("l"), F.sum(F.col("n") * F.log("n")).alias("e"))
    # -sum p log_m p with p = n / m, which is (log m - sum n log n / m) / log m; 1 for a node seen once.
    presentation = total.select(
        "host", "node", "l",
        F.when(F.col("m") > 1, F.lit(1.0) - F.col("e") / (F.col("m") * F.log("m"))).otherwise(1.0).alias("presentation"),
    )
    contents = pages.select("host", F.explode(F.array_distinct("blocks")).alias("b")).groupBy("host", "b.node", "b.content").agg(F.count(F.lit(1)).alias("c"))
    held = pages.select("host", F.explode(F.array_distinct(F.col("blocks.node"))).alias("node")).groupBy("host", "node").agg(F.count(F.lit(1)).alias("m"))
    scored = contents.where(F.col("c") > 1).join(held, ["host", "node"]).join(presentation, ["host", "node"], "left")
    weight = F.pow(F.lit(gamma), F.coalesce("l", F.lit(1)))
    content = F.lit(1.0) - F.log("c") / F.log(F.col("m") + unseen)
    importance = (F.lit(1.0) - weight) * F.coalesce("presentation", F.lit(0.0)) + weight * content
    return scored.where(importance < threshold).select("host", "node", "content")


def extract_pages(
    df: DataFrame, page: str, url: str, keys: list[str], threshold: float = THRESHOLD, gamma: float = GAMMA, unseen: float = UNSEEN
) -> DataFrame:
    """``keys`` and ``text``: the main text of each whole page, its blocks joined by one space.

    NULL and empty pages give the empty text. A NULL or odd address belongs to the host without a name. Repeated rows
    stay; other columns are left out; an empty table gives no rows.
    """
    names = [f"k{i}" for i in range(len(keys))]
    slim = df.select(*[F.col(k).alias(n) for k, n in zip(keys, names)], F.col(url).cast("string").alias("url"), utf8(F.col(page)).alias("raw"))
    # Storing the parsed pages fixes the number of a row.
    trees = stored(parsed_pages(slim, names).withColumn("uid", F.monotonically_increasing_id()), "trees")
    low = stored(low_branches(trees, threshold, gamma, unseen), "low-branches")
    few = low.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    placed = trees.select("uid", "host", F.posexplode(F.transform("blocks", lambda b: F.struct(b["node"].alias("node"), b["content"].alias("content"), b["kept"].alias("kept")))).alias("at", "b"))
    hit = placed.where("b.kept").select("uid", "host", "at", "b.node", "b.content").join(F.broadcast(low) if few else low, ["host", "node", "content"])
    # Pages that lose a branch, a few numbers each; sent to the pages rather than the pages' texts to them while few.
    dropped = stored(hit.groupBy("uid").agg(F.collect_set("at").alias("dropped")), "dropped")
    if dropped.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        dropped = F.broadcast(dropped)
    text = F.array_join(
        F.transform(
            F.filter("blocks", lambda b, i: b["kept"] & ~F.coalesce(F.array_contains("dropped", i), F.lit(False))), lambda b: b["text"]
        ),
        " ",
    )
    return trees.join(dropped, "uid", "left").select(*[F.col(n).alias(k) for k, n in zip(keys, names)], text.alias("text"))


def page_texts(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every page."""
    found = extract_pages(pages, "html", "url", ["page_id", "url"])
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
