"""Main text of web pages by a site style tree.

The pages of a host are merged into one tree of element styles (tag and class, from the root
down). A node with text has content features, the texts of its blocks: its content importance is
1 less their mean entropy over the pages, so text that is on every page counts nothing. An inner
node has presentation styles, the sequences of its children's styles (repetitions as one): its
presentation importance is the entropy of these, as only real content varies. The composite
importance of a branch is the mean of its nodes', weighted by their number and by GAMMA for each
step down. A branch below `least` goes from every page of the host if each node in it is below;
of one that holds a node of higher importance only the low branches and the low own text go.
Pages of equal content (their marked article, else all their blocks) count once, so that a host
of copies has no low article. A branch that holds a page's article stays there, and so does an
article of which most would go.

Importance needs pages to compare, and menus of words differ from page to page like an article
does. So two rules of presentation stand beside it: elements whose tag or class names a role that
is not content (ROLE_TAGS, ROLE_ARIA, ROLE_WORDS) have importance 0, and where a page marks its
article (`article`, `main`) that counts, with the headings right before it; text outside of it
counts where its node was judged and has importance HIGH, or where one of its blocks is STORY
characters long and longer than the article, which is a teaser then. A class or id names a role by a whole name, on block
elements only, and not where it stands around the page's article: an element of role that holds
the only article counts as a wrapper, and the article and the text outside of roles are kept. A node's importance is shrunk towards 1 by PRIOR pages on which all is content, so few pages
remove little: what is on every page goes from five pages on. Text outside of an article is added
where its importance, shrunk towards 0 by as many pages, is HIGH: a host's only page has none.
Both are one rule at any number of pages. Roles are judged on each page.

A block is a run of text that no block element's start or end interrupts. Character references
are decoded, white space becomes one space, blocks are joined by a line feed.

Scale: one row per page, node and feature leaves a page's parse and is summed in the map task, so
a hot host is counted before the shuffle. The branches to remove are a small written table that
Spark broadcasts if its own limit allows; else the join is a shuffle by host. HTML is parsed
twice and not moved in the first case. Paths deeper than DEPTH are cut, so styles are bounded.

Defined cases: null or empty html gives an empty text; a null url is a host of its own; equal
rows count as one page of the tree and get equal texts; unclosed or stray tags are read as browsers would
roughly; an empty table gives no rows. Other input columns are ignored.
"""

from __future__ import annotations

import hashlib
import html as entities
import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chainalerts.llm.common import table, written
from chainalerts.llm.url_rules import host_of

GAMMA, LEAST, DEPTH = 0.9, 0.2, 24
HIGH, STORY = 0.5, 80
PRIOR = 1.1  # pages; not a whole number, so that no number of pages gives just LEAST
# Elements of HTML by what they do.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
UNSEEN = frozenset("head script style noscript template svg math iframe object textarea title select button canvas audio video map".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary "
    "table caption tbody td tfoot th thead tr ul".split())
# What an opening element closes, up to the nearest of the second set.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select", "datalist"}),
}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ROLE_TAGS = frozenset("nav footer aside menu dialog fieldset search".split())
ROLE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent "
    "gdpr notice notices disclaimer popup modal overlay newsletter subscribe subscription share sharing social breadcrumb "
    "breadcrumbs sidebar menu nav navbar navigation footer masthead comment comments reply replies respond disqus related "
    "recommended widget login signup pagination pager toolbar topbar skip commentlist".split())
# Words of place and form: they name no role, and take none from a name that has one.
PLACE_WORDS = frozenset(
    "site page main global bar box list section area wrap wrapper container inner outer block slot unit group row column col "
    "panel item items link links post posts article articles story stories top bottom left right primary secondary".split())
# Roles that hold articles of their own: other readers' or other pages'.
LIST_WORDS = frozenset("comment comments commentlist reply replies respond disqus related recommended".split())
ROLE_ARIA = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())

_TAG = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.DOTALL)
_ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.IGNORECASE)


def _role(tag: str, attributes: dict[str, str], inside: bool) -> bool:
    """Whether an element is no content by its tag or ARIA role."""
    if tag in ROLE_TAGS or attributes.get("role", "").lower() in ROLE_ARIA:
        return True
    return tag == "header" and not inside  # an article's own header holds its title


@lru_cache(1 << 14)
def _names(named: str) -> frozenset[str]:
    """The role words of classes and ids: of a hyphenated name only if its other parts say where
    or how (`main-nav`, `comment-list`), not of what (`has-sidebar`, `share-price`)."""
    found = [{part for part in re.split("[^a-z]+", name) if part} - PLACE_WORDS for name in named.lower().split()]
    return frozenset().union(*[parts for parts in found if parts <= ROLE_WORDS or parts == {"header"}])


def _named(tag: str, attributes: dict[str, str], inside: bool) -> frozenset[str]:
    """The words by which an element is no content unless the page's article is in it."""
    if tag == "form":
        return frozenset([tag])
    if tag not in BLOCKS or tag in ("html", "body", "main") or not ("class" in attributes or "id" in attributes):
        return frozenset()
    words = _names(f"{attributes.get('class', '')} {attributes.get('id', '')}")
    if tag == "article":
        return words & LIST_WORDS
    return words - {"header"} if inside or tag in ("h1", "h2", "h3") else words


class _Open:
    __slots__ = ("tag", "path", "dead", "article", "children", "block", "roles", "around")

    def __init__(self, tag, path, dead, article, block, roles, around):
        self.tag, self.path, self.dead, self.article, self.block = tag, path, dead, article, block
        self.roles, self.around = roles, around  # numbers of named roles it is in; those its nearest article is in
        self.children: list[str] = []


def _wrappers(blocks: list[tuple], lists: set[int]) -> frozenset[int]:
    """The named roles that hold the page's article: none if an article is outside of them; those
    that hold articles of their own only if the page has no other text."""
    articles = [around for _, _, article, roles, around in blocks if article and roles == around]
    if not all(articles):
        return frozenset()
    held = frozenset().union(*[around for around in articles if not around & lists])
    return held if held or any(not b[3] for b in blocks) else frozenset().union(*articles)


def parse(page: str) -> tuple[list[tuple[str, str, str, bool]], list[tuple[str, tuple[str, ...]]]]:
    """Blocks (path, text, path of the article around it or "", whether main text) outside elements
    with a role, and the inner nodes (path, styles of their children), in page order."""
    none: frozenset[int] = frozenset()
    stack = [_Open("", "", False, "", True, none, none)]
    blocks: list[tuple[str, str, str, frozenset[int], frozenset[int]]] = []
    nodes: list[tuple[str, tuple[str, ...], frozenset[int]]] = []
    n_roles, lists = 0, set()
    ahead: list[int] = []  # headings since the last other block or role
    titles: set[int] = set()
    pieces: list[str] = []

    def flush() -> None:
        if pieces:
            top = next(e for e in reversed(stack) if e.block)
            text = " ".join("".join(pieces).split())
            pieces.clear()
            if text and not any(e.dead for e in stack):
                if top.tag in HEADINGS:
                    ahead.append(len(blocks))
                else:
                    ahead.clear()
                blocks.append((top.path, text, top.article, top.roles, top.around))

    def text(raw: str) -> None:
        if raw and not stack[-1].dead:
            pieces.append(entities.unescape(raw) if "&" in raw else raw)

    def close(to: int) -> None:
        if any(e.block for e in stack[to:]):
            flush()
        while len(stack) > to:
            e = stack.pop()
            if e.children and e.block and not e.dead:
                nodes.append((e.path, tuple(e.children), e.roles))

    at = 0
    while True:
        tag = _TAG.search(page, at)
        if not tag:
            break
        text(page[at:tag.start()])
        at = tag.end()
        name = (tag.group(2) or tag.group(5) or "").lower()
        if not name:
            continue
        if tag.group(1) or tag.group(4):
            to = next((i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == name), 0)
            # An inline end tag does not close blocks around it.
            if to and (name in BLOCKS or not any(e.block for e in stack[to:])):
                close(to)
            elif name == "br":
                pieces.append(" ")
            continue
        if name in BLOCKS:
            flush()
            p = next((i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == "p"), 0)
            if p and not any(e.tag in ("td", "th", "li", "div", "section") for e in stack[p + 1:]):
                close(p)
        if name in CLOSES:
            closed, stop = CLOSES[name]
            to = 0
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in stop:
                    break
                if stack[i].tag in closed:
                    to = i
            if to:
                close(to)
        if name in VOID:
            pieces.append(" " if name in ("br", "hr", "img", "wbr") and name != "wbr" else "")
            continue
        raw_attributes = tag.group(3) if tag.group(2) else tag.group(6) or ""
        attributes = {}
        for a in _ATTRIBUTE.finditer(raw_attributes) if raw_attributes and "=" in raw_attributes else ():
            attributes.setdefault(a.group(1).lower(), a.group(2) or a.group(3) or a.group(4) or "")
        parent = stack[-1]
        above = next(e for e in reversed(stack) if e.block)
        article = above.article
        role = _role(name, attributes, bool(article))
        dead = parent.dead or role or name in UNSEEN
        roles, around = above.roles, above.around
        if not dead and (words := _named(name, attributes, bool(article))):
            roles |= {n_roles}
            if words & LIST_WORDS:
                lists.add(n_roles)
            n_roles += 1
        if role or roles != above.roles:
            ahead.clear()
        if name in ("article", "main") and not role:
            # Neither may stand in a menu or footer: those were not closed.
            dead = any(e.dead and e.tag not in ("nav", "footer", "header") for e in stack)
            if not dead:
                titles.update(ahead)
                for e in stack:
                    e.dead = False
        if name in BLOCKS:
            label = ".".join([name, *sorted(attributes.get("class", "").split())]).replace("/", "_")
            if not above.children or above.children[-1] != label:
                above.children.append(label)
            path = f"{above.path}/{label}" if above.path.count("/") < DEPTH else above.path
            if name in ("article", "main"):
                article, around = ("", none) if dead else (article or path, roles)
            stack.append(_Open(name, path, dead, article, True, roles, around))
        else:
            stack.append(_Open(name, above.path, dead, article, False, roles, around))
        if name in RAW:
            end = re.compile(rf"</{name}(?=[\s/>])[^>]*>?", re.IGNORECASE).search(page, at)
            stack.pop()
            at = end.end() if end else len(page)
    text(page[at:])
    flush()
    close(1)
    held = _wrappers(blocks, lists)
    left = [(*b, i in titles) for i, b in enumerate(blocks) if b[3] <= held]
    n_article = sum(len(text) for _, text, article, *_ in left if article)
    teaser = any(not article and len(text) >= max(STORY, n_article) for _, text, article, *_ in left)
    return [(path, text, article, bool(article) or title or teaser or not n_article or bool(held) and not roles)
            for path, text, article, roles, _, title in left], [(path, children) for path, children, roles in nodes if roles <= held]


def _main(page: str | None) -> list[tuple[str, str, str]]:
    """(path, text, path of the article) of a page's blocks that no role rule removes."""
    return [b[:3] for b in parse(page or "")[0] if b[3]]


def main_blocks(page: str | None) -> list[tuple[str, str]]:
    """(path, text) of a page's blocks that no role rule removes."""
    return [(path, text) for path, text, _ in _main(page)]


def _held(page: str | None, gone: frozenset[str], high: frozenset[str]) -> list[str]:
    """The texts of a page's main blocks and of nodes of high importance, without the host's low
    branches (`path/`) and the low own text of nodes (`path`)."""
    blocks = [b[:3] for b in parse(page or "")[0] if b[3] or b[0] in high]
    if not gone:
        return [text for _, text, _ in blocks]

    def low(path: str, article: str) -> bool:
        # Branches from the article's own up hold it.
        ends = [i for i in range(1, len(path)) if path[i] == "/"] + [len(path)]
        return path in gone or any(f"{path[:i]}/" in gone for i in ends if i > len(article))

    keep = [not low(path, article) for path, _, article in blocks]
    inside = [(len(text), k) for (_, text, article), k in zip(blocks, keep) if article]
    if 2 * sum(n for n, k in inside if not k) > sum(n for n, _ in inside):
        keep = [k or bool(article) for (_, _, article), k in zip(blocks, keep)]
    return [text for (_, text, _), k in zip(blocks, keep) if k]


CONTENT, STYLE, PAGES, OUTSIDE = 0, 1, 2, 3


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, page, path, kind, feature, c, l): how often a feature is in a page's node, and c ln c.
    `page` is a hash of the page's main blocks."""
    for batch in batches:
        rows: list[tuple] = []
        for host, page in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist()):
            blocks, nodes = parse(page or "")
            found = Counter((path, CONTENT, text) for path, text, _, _ in blocks)
            found += Counter((path, STYLE, "|".join(children)) for path, children in nodes)
            found += Counter({(path, PAGES, ""): 1 for path, _, _ in found})
            found += Counter({(path, OUTSIDE, ""): 1 for path, _, _, main in blocks if not main})
            content = "\n".join(f"{path}\n{text}" for path, text, _, main in blocks if main).encode("utf-8", "surrogatepass")
            name = int.from_bytes(hashlib.blake2b(content, digest_size=8).digest(), "little", signed=True)
            rows += [(host, name, path, kind, what, c) for (path, kind, what), c in found.items()]
        host, name, path, kind, what, c = zip(*rows) if rows else ((), (), (), (), (), ())
        yield pa.RecordBatch.from_arrays(
            [pa.array(host, pa.string()), pa.array(name, pa.int64()), pa.array(path, pa.string()), pa.array(kind, pa.int32()), pa.array(what, pa.string()),
             pa.array(c, pa.int64()), pa.array([n * math.log(n) for n in c], pa.float64())],
            ["host", "page", "path", "kind", "what", "c", "l"])


def style_tree(pages: DataFrame) -> DataFrame:
    """Nodes (host, path) of all hosts with n (their number), importance,
    own (the node's alone), outer (that of text outside of articles, if any) and highest (of all
    nodes' own in the branch). `pages` has host and html."""
    rows = pages.select("host", "html").mapInArrow(
        _features, "host string, page long, path string, kind int, what string, c long, l double")
    # Copies of a page are one; most meet in the map tasks.
    once = rows.select("host", "page", "path", "kind", F.xxhash64("what").alias("feature"), "c", "l").groupBy(
        "host", "page", "path", "kind", "feature").agg(
        F.max("c").alias("c"), F.max("l").alias("l"), F.count("*").alias("copies"))
    each = once.groupBy("host", "path", "kind", "feature").agg(
        F.sum("c").alias("c"), F.sum("l").alias("l"), F.sum("copies").alias("copies"), F.count("*").alias("once"))
    # Entropy over pages of one content feature; of a node's styles it is that over styles.
    nodes = each.groupBy("host", "path").agg(
        F.sum(F.when(F.col("kind") == PAGES, F.col("c"))).alias("pages"),
        F.count(F.when(F.col("kind") == CONTENT, 1)).alias("features"),
        F.sum(F.when(F.col("kind") == CONTENT, F.log("c") - F.col("l") / F.col("c"))).alias("entropy"),
        F.sum(F.when(F.col("kind") == CONTENT, F.col("c"))).alias("n_content"),
        F.count(F.when(F.col("kind") == OUTSIDE, 1)).alias("outside"),
        F.sum(F.when(F.col("kind") == PAGES, F.col("copies"))).alias("copies"),
        F.sum(F.when(F.col("kind") == CONTENT, F.col("copies"))).alias("content_copies"),
        F.sum(F.when(F.col("kind") == CONTENT, F.col("once"))).alias("content_once"),
        F.sum(F.when(F.col("kind") == STYLE, F.col("c"))).alias("n_style"),
        F.sum(F.when(F.col("kind") == STYLE, F.col("c") * F.log("c"))).alias("style_l"),
    )
    scale = F.log(F.greatest("pages", F.lit(2)).cast("double"))
    content = F.when(F.col("pages") <= 1, 1.0).otherwise(1 - F.col("entropy") / F.col("features") / scale)
    style = F.when(F.col("pages") <= 1, 1.0).otherwise((F.log("n_style") - F.col("style_l") / F.col("n_style")) / scale)
    # Texts of a page beside those of one of its copies: text that changes around the same article
    # is not its.
    steady = F.col("content_copies") / F.col("copies") / (F.col("content_once") / F.col("pages"))
    outer = F.when(F.col("pages") <= 1, 0.0).otherwise(
        content * F.least(steady, F.lit(1.0)) * F.col("pages") / (F.col("pages") + PRIOR))
    own = nodes.select(
        "host", "path", F.when(F.col("outside") > 0, outer).alias("outer"),
        F.coalesce("n_content", "n_style").alias("n"),
        ((F.coalesce(content, style, F.lit(1.0)) * F.col("pages") + PRIOR) / (F.col("pages") + PRIOR)).alias("own"))
    # Every node gives its share to itself and to the nodes above it.
    depth = F.size(F.split("path", "/"))
    shares = own.select(
        "host", "path", "n", "own", "outer", F.explode(F.sequence(F.lit(2), depth)).alias("d"))
    above = F.array_join(F.slice(F.split("path", "/"), F.lit(1), F.col("d")), "/")
    weight = F.col("n") * F.pow(F.lit(GAMMA), depth - F.col("d"))
    return shares.select(
        "host", above.alias("path"), weight.alias("w"), (weight * F.col("own")).alias("x"), F.col("own").alias("highest"),
        F.when(depth == F.col("d"), F.col("own")).alias("own"), F.when(depth == F.col("d"), F.col("outer")).alias("outer"),
        F.when(depth == F.col("d"), F.col("n")).alias("n"),
    ).groupBy("host", "path").agg(
        F.max("n").alias("n"), F.max("own").alias("own"),
        F.max("outer").alias("outer"), F.max("highest").alias("highest"), (F.sum("x") / F.sum("w")).alias("importance"))


def extract(
    pages: DataFrame, least: float = LEAST,
    id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
) -> DataFrame:
    """id, url and text (empty if none) of every page."""
    source = pages.select(
        F.col(id_col).alias("__id"), F.col(url_col).alias("__url"), host_of(F.col(url_col)).alias("host"),
        F.col(html_col).cast("string").alias("html"))
    # Text outside all elements has no branch.
    low = F.when(F.col("importance") < least, F.when(
        (F.col("highest") < least) & (F.col("path") != ""), F.concat("path", F.lit("/"))).when(F.col("own") < least, F.col("path")))
    high = F.when(F.col("outer") >= HIGH, F.col("path"))
    judged = style_tree(source).select("host", low.alias("low"), high.alias("high"))
    # A host's branches to remove or to add are at most its styles, of which several pages have each one.
    judged = judged.filter(F.col("low").isNotNull() | F.col("high").isNotNull()).groupBy("host").agg(
        F.collect_set("low").alias("low"), F.collect_set("high").alias("high"))
    rows = source.join(written(judged, "importance"), "host", "left").select("__id", "__url", "html", "low", "high")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = ["\n".join(_held(page, frozenset(gone or ()), frozenset(more or ()))) for page, gone, more in zip(
                *[batch.column(c).to_pylist() for c in ("html", "low", "high")])]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["__id", "__url", "text"])

    schema = T.StructType([*rows.schema.fields[:2], T.StructField("text", T.StringType())])
    return rows.mapInArrow(run, schema).withColumnsRenamed({"__id": id_col, "__url": url_col})


def op1_site_style_tree(spark, sf_dir: str) -> DataFrame:
    found = extract(table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
