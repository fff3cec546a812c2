"""Main text of web pages: page furniture by element, site templates by recurring subtrees.

Every element's subtree is hashed from its name, class and content.  Spark counts, per host, on
how many different pages a subtree occurs; subtrees on a large share of a host's pages are its
template and are deleted.  Elements that are furniture by name, class or role go too.
"""

from __future__ import annotations

import html as entities
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, lookup

#: A subtree is template from so many different pages of a host, and this share of them, on.
LEAST_PAGES = 5
SHARE = 0.3

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)\]\]>|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(?P<end2>/?)(?P<name2>[a-zA-Z][^\s/>]*+)[^>]*+(?:>|\Z)|</[^>]*+(?:>|\Z)", re.S)
ATTR = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: Content of these is not markup.
RAW = set("script style textarea title noscript iframe noembed noframes xmp".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rb rt rp s samp "
             "small span strike strong sub sup time tt u var wbr img".split())
#: Start tags that end an open paragraph.
ENDS_P = set("address article aside blockquote details dialog div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 "
             "h6 header hgroup hr main menu nav ol p pre section table ul".split())
#: Open elements that a start tag ends, and the elements this does not reach beyond.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
        "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
        "tbody": ({"tr", "td", "th", "thead", "tbody"}, {"table"}), "tfoot": ({"tr", "td", "th", "thead", "tbody"}, {"table"}),
        "option": ({"option"}, {"select"})}
#: Furniture by element name, by word of class or id, by role.
NAMES = set("head nav footer aside form script style noscript template iframe svg canvas object button select textarea input "
            "dialog menu audio video math noembed noframes title".split())
CLASSES = set("ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar menu nav "
              "navbar navigation breadcrumb breadcrumbs pagination pager footer comment comments discussion disqus replies "
              "respond cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe signup social "
              "share sharing related recommended toolbar widget masthead topbar skip".split())
#: Words that go with those in the class names of furniture inside an article.
WITH = set("bar block box button buttons container content group inline inner item items link links list listing post posts "
           "section slot unit widget wrap wrapper area bottom top left right icons form js media articles stories".split())
ROLES = set("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
ROOTS = {"html", "body", "main", "article"}
SPLIT = re.compile(r"[^a-z0-9]+|(?<=[a-z])(?=[A-Z])")


class Element:
    __slots__ = ("name", "label", "parts", "furniture", "digest", "words")

    def __init__(self, name: str, label: str, furniture: bool):
        self.name, self.label, self.furniture = name, label, furniture
        self.parts: list = []


def furniture(name: str, attrs: dict[str, str], inside: bool) -> bool:
    """Whether an element is page furniture; ``inside``: it lies in an article or main part."""
    if name in NAMES or name == "header" and not inside:
        return True
    if name in ("html", "body", "main"):
        return False
    if attrs.get("role", "").lower() in ROLES or "hidden" in attrs or attrs.get("aria-hidden") == "true":
        return True
    if "display:none" in attrs.get("style", "").replace(" ", "").lower():
        return True
    named = (attrs.get("class", "") + " " + attrs.get("id", "")).split()
    parts = [{w.lower() for w in SPLIT.split(n) if w} for n in named]
    if inside:  # "related-posts" is furniture, "related-work" and "share-of-market" are what the text is about
        return any(p & CLASSES and p <= CLASSES | WITH for p in parts)
    return any(p & CLASSES or "header" in p for p in parts)


def parse(page: str) -> Element:
    """The tree of a page; text is decoded, comments and declarations are gone."""
    root = Element("", "", False)
    stack, inside, at, known = [root], 0, 0, {}
    n = len(page)
    while at < n:
        m = TOKEN.search(page, at)
        start = m.start() if m else n
        if start > at:
            stack[-1].parts.append(entities.unescape(page[at:start]))
        if not m:
            break
        at = m.end()
        name = m["name"] or m["name2"]
        if name is None:
            if m["cdata"]:
                stack[-1].parts.append(m["cdata"])
            continue
        name = name.lower()
        if m["end"] or m["end2"]:
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].name == name:
                    inside -= sum(e.name in ("article", "main") for e in stack[depth:])
                    del stack[depth:]
                    break
                if stack[depth].name in ("article", "main", "table", "nav", "aside") and name in INLINE | {"p", "li"}:
                    break  # a stray end tag does not end the part around it
            continue
        raw = m["attrs"] or ""
        if raw.strip(" /") == "":
            attrs = {}
        else:
            attrs = {a.lower(): (b or c or d or "") for a, b, c, d in ATTR.findall(raw)}
        gone, reach = ENDS.get(name, (None, None))
        if name in ENDS_P:
            gone, reach = {"p"}, {"table", "td", "th", "button", "li", "article", "section", "div", "body"}
        if gone:
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].name in gone:
                    del stack[depth:]
                    if name not in ("tr", "tbody", "tfoot"):
                        break
                elif stack[depth].name in reach:
                    break
        key = (name, raw, inside > 0)
        got = known.get(key)
        if got is None:
            got = known[key] = (" ".join((name, attrs.get("class", ""), attrs.get("id", ""))), furniture(name, attrs, inside > 0))
        e = Element(name, *got)
        stack[-1].parts.append(e)
        if name in VOID or raw.endswith("/") and name not in RAW and name not in ENDS_P and name not in INLINE:
            continue
        if name in RAW:
            close = re.compile(rf"</{name}\s*>|\Z", re.I).search(page, at)
            if name != "noscript":
                e.parts.append(page[at:close.start()])
            at = close.end()
            continue
        stack.append(e)
        inside += name in ("article", "main")
    return root


def digests(root: Element) -> list[Element]:
    """All elements, parents first; ``digest`` of each is set from its label and content."""
    import xxhash

    order = [root]
    for e in order:
        order += [p for p in e.parts if isinstance(p, Element)]
    for e in reversed(order):
        bits, e.words = [e.label], False
        for p in e.parts:
            if isinstance(p, Element):
                bits.append(f"\x01{p.digest}")
                e.words |= p.words
            elif p := " ".join(p.split()):
                bits.append(p)
                e.words = True
        e.digest = xxhash.xxh64_intdigest("\x00".join(bits).encode("utf-8", "surrogatepass")) - (1 << 63)
    return order


def main_text(page: str | None, template: frozenset | set = frozenset()) -> str:
    """Text of the article: blocks in order, joined by one space, white space inside folded."""
    root = parse(page or "")
    order = digests(root)
    roots = [e for e in order if e.name == "article" and not e.furniture] or \
            [e for e in order if e.name == "main" and not e.furniture] or [root]
    inner: set[int] = set()
    out: list[str] = []

    def walk(top: Element) -> None:
        todo = [top]
        while todo:
            p = todo.pop()
            if not isinstance(p, Element):
                out.append(p)
                continue
            if p.furniture or p.digest in template and p.name not in ROOTS and p is not root:
                continue
            if id(p) in inner:
                continue
            inner.add(id(p))
            edge = [] if p.name in INLINE else [" "]
            todo += [*edge, *reversed(p.parts), *edge]

    hidden = {id(q) for e in order if e.furniture or id(e) in inner for q in e.parts if isinstance(q, Element)}
    for e in order:  # furniture hides what lies in it
        if id(e) in hidden:
            hidden.update(id(q) for q in e.parts if isinstance(q, Element))
    for r in roots:
        if id(r) not in hidden:
            walk(r)
    return " ".join("".join(out).split())


def host_of(url):
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:@]*@)?([^/?#:]+)", 2))
    return F.when(host != "", host)


def templates(pages: DataFrame, least: int = LEAST_PAGES, share: float = SHARE) -> DataFrame:
    """``host, template``: hashes of the subtrees on at least ``least`` and a ``share`` of the
    host's different pages.  A page that recurs unchanged counts once, so copies of an article
    are no template.  The list of a host holds at most 1 / ``share`` of the elements of a page."""
    schema = "host string, page bigint, subtrees array<bigint>"

    def run(batches):
        for b in batches:
            out = []
            for host, text in zip(b["host"], b["html"]):
                order = digests(parse(text or ""))
                found = {e.digest for e in order if e.words and e.name not in ROOTS and e.name not in NAMES and e.name}
                out.append((host, order[0].digest, sorted(found)))
            yield pd.DataFrame(out, columns=["host", "page", "subtrees"])

    seen = pages.where("host is not null").select("host", "html").mapInPandas(run, schema)
    seen = cut(seen.groupBy("host", "page").agg(F.first("subtrees").alias("subtrees")))
    pages_of = seen.groupBy("host").agg(F.count("*").alias("pages")).where(F.col("pages") >= least)
    counts = seen.select("host", F.explode("subtrees").alias("subtree")).groupBy("host", "subtree") \
        .agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return counts.join(pages_of, "host").where(F.col("n") >= share * F.col("pages")) \
        .groupBy("host").agg(F.sort_array(F.collect_list("subtree")).alias("template"))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
            least: int = LEAST_PAGES, share: float = SHARE) -> DataFrame:
    """``page_id, url, text, n_chars``: the main text of every page.

    Article elements (else the main element, else the whole body) without furniture and without
    the subtrees of the host's template; white space, no-break spaces included, is folded.  A null
    or empty page gives an empty text; a null or odd URL has no template; cut-off markup is read
    as far as it goes; repeated rows stay; an empty table gives an empty result; other columns
    are not read.  Templates meet the pages behind a size check, salted beyond it."""
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    rows = rows.withColumn("host", host_of(F.col("url")))
    rows = lookup(rows, templates(rows, least, share), ["host"], F.col("page_id"))
    schema = T.StructType([T.StructField("page_id", pages.schema[id_col].dataType), T.StructField("url", T.StringType()),
                           T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches):
        for b in batches:
            texts = [main_text(h, frozenset(t) if t is not None else frozenset()) for h, t in zip(b["html"], b["template"])]
            yield pd.DataFrame({"page_id": b["page_id"].to_numpy(object), "url": b["url"], "text": texts,
                                "n_chars": [len(t) for t in texts]})

    return rows.select("page_id", "url", "html", "template").mapInPandas(run, schema)
