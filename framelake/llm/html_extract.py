"""Main text of web pages by deducing each host's template from token occurrences.

Tokens are tags, the words of short runs of text and whole longer runs, each with its path. Tokens of a host that stand equally
often on the same pages have one occurrence vector and form an equivalence class. Frequent classes that nest without crossing
are the template. Its elements hold the slots: the deepest one that stands once on its pages and holds most of what the host's
pages say outside links is the main one, elements that hold mostly links are lists of links. The blocks of the main element's slots are
the text, without lists of links and without blocks that are template themselves. Names of tags decide what is never text; class
names and the tags article and main break ties, and decide for hosts without a template. A class name is taken whole, and what it says of
an element inside an article, or of a single paragraph, counts only if the template has that element too.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.tables import BROADCAST_BYTES
from .common import bound_batches, hint, let, materialise

#: A class must stand on so many pages of a host at least, and on this share of them, and have so many tokens.
PAGES, SHARE, TOKENS = 3, 0.5, 2
#: Words of a run that is a token for each word, at most.
SHORT = 12
#: The main element holds this share of the text outside links at least; a list of links has more than this share of its text in them.
MOST = 0.5

MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([a-zA-Z][\w:-]*)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
RAW = {name: re.compile(rf"</{name}(?=[\s/>])|\Z", re.I) for name in ("script", "style", "textarea", "title", "xmp", "noembed", "noframes", "iframe")}
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark nobr q ruby rb rt rp s samp small span strike strong sub sup time tt u var wbr".split())
#: What an opening tag ends, and the elements beyond which it does not look.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
#: Elements whose text is never main text, and words in class, id or role that say the same.
ASIDE = frozenset("head nav footer aside form script style noscript template iframe button select option textarea menu dialog object svg canvas title label input fieldset audio video map".split())
ASIDE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion nav navigation navbar menu breadcrumb breadcrumbs sidebar aside widget footer header masthead topbar cookie cookies consent notice gdpr popup modal overlay newsletter subscribe signup login share sharing social related recommended comment comments disqus reply replies respond discussion pager pagination toolbar search skip contentinfo complementary".split()
)
MAIN = frozenset(("article", "main"))
#: Elements whose class name counts by itself outside an article.
HOLDERS = frozenset("div section ul ol table details".split())


class Part(NamedTuple):
    """A tag or a run of text: its token (0 for white space), the block and the element it belongs to, and of a run whether it
    lies in an article, aside by its tags, in what element that is aside by its class (0: none), in a link, and its text."""

    token: int
    block: int
    element: int
    main: bool
    aside: bool
    hinted: int
    link: bool
    text: str | None


class Open(NamedTuple):
    """An element that is open: its name, the path inside it, and what holds of the text inside."""

    name: str
    path: str
    element: int
    main: bool
    aside: bool
    hinted: int
    link: bool


OUTSIDE = Open("", "", 0, False, False, 0, False)


class Page(NamedTuple):
    """``parts`` in order; ``up``: the element around each element; ``marked``: elements with a telling class name, and whether
    the template must have them for that to count."""

    parts: list[Part]
    up: dict[int, int]
    marked: dict[int, bool]


@lru_cache(1 << 16)
def token_of(path: str, text: str) -> int:
    return int.from_bytes(hashlib.blake2b(f"{path}\0{text}".encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def role(name: str, attributes: str, inside_main: bool) -> tuple[str, bool, bool, bool]:
    """The tag with its class; whether it opens an article, what lies aside by its tag, what does so by its class, id or role."""
    marks = ""
    words: list[str] = []
    hidden = False
    for key, value in ATTRIBUTE.findall(attributes) if attributes else ():
        key = key.lower()
        if key in ("class", "id", "role"):
            value = value.strip("\"'").lower()
            words += value.split()
            marks += "." + value if key == "class" else ""
        elif key == "hidden" or key == "aria-hidden" and "true" in value.lower() or key == "style" and re.search(r"display\s*:\s*none", value, re.I):
            hidden = True
    aside = hidden or name in ASIDE or name == "header" and not inside_main
    hinted = any(w in ASIDE_WORDS for w in words) and name not in ("html", "body")
    main = (name in MAIN or "main" in words) and not aside and not hinted
    return name + marks, main, aside, hinted


def parsed(page: str) -> Page:
    """The tags and runs of a page in order. Elements left open end where HTML ends them, or with what holds them."""
    out, up, marked = [], {0: 0}, {}
    stack: list[Open] = []
    now, block, at, n, raw = OUTSIDE, 0, 0, len(page), None

    def text(a: int, b: int) -> None:
        if a < b:
            run = page[a:b]
            token = token_of(now.path, " ".join(run.split())) if run.strip() else 0
            out.append(Part(token, block, now.element, now.main, now.aside, now.hinted, now.link, run))

    def tag(token: int, text: str | None = None) -> None:
        out.append(Part(token, block, now.element, now.main, now.aside, now.hinted, now.link, text))

    while at < n:
        if raw:
            end = RAW[raw].search(page, at)
            text(at, end.start())
            at, raw = end.start(), None
        m = MARKUP.search(page, at)
        if not m:
            text(at, n)
            break
        text(at, m.start())
        at = max(m.end(), m.start() + 1)
        name = (m[2] or "").lower()
        if not name:
            continue
        inline = name in INLINE
        if m[1]:
            depth = next((i for i in range(len(stack) - 1, -1, -1) if stack[i].name == name), -1)
            if depth >= 0 and not (inline and any(x.name not in INLINE for x in stack[depth + 1 :])):
                del stack[depth:]
                now = stack[-1] if stack else OUTSIDE
            if not inline:
                block += 1
                tag(token_of(now.path, f"/{name}"))
            continue
        if not inline:
            block += 1
            if name in ENDS:
                gone, beyond = ENDS[name]
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i].name in beyond:
                        break
                    if stack[i].name in gone:
                        del stack[i:]
                        break
            else:
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i].name == "p":
                        del stack[i:]
                        break
                    if stack[i].name not in INLINE:
                        break
            now = stack[-1] if stack else OUTSIDE
        mark, opens, hides, hints = role(name, m[3], now.main)
        token = token_of(now.path, mark)
        if hints:
            marked[token] = now.main or name not in HOLDERS
        hinted = token if hints and (not now.hinted or marked[now.hinted] and not marked[token]) else now.hinted
        tag(token, " " if name == "br" else None)
        if name in VOID or m[3].endswith("/") and name not in RAW:
            continue
        if name in RAW:
            raw = name
        if inline:
            now = Open(name, now.path, now.element, now.main, now.aside or hides, hinted, now.link or name == "a")
        else:
            up[token] = now.element
            now = Open(name, f"{now.path}/{mark}", token, now.main or opens, now.aside or hides, hinted, now.link)
        stack.append(now)
    return Page(out, up, marked)


def words_of(x: Part) -> list[int]:
    """The tokens of a run: of its words if it is short, else the run itself."""
    words = x.text.split()
    return [token_of(str(x.element), w) for w in words] if len(words) <= SHORT else [x.token]


class Template(NamedTuple):
    """Of a host: the tokens of its valid classes, the main element (0: none) and the lists of links."""

    tokens: frozenset[int]
    main: int
    links: frozenset[int]


NONE = Template(frozenset(), 0, frozenset())


def chosen_parts(page: Page, template: Template) -> list[Part]:
    """The runs of the main element that are neither aside nor in a list of links; without a main element those of the article,
    else all. What class names say is passed over where it would leave nothing."""
    runs = [x for x in page.parts if x.text is not None and not x.aside]

    def away(element: int) -> bool:
        return element in page.marked and (not page.marked[element] or element in template.tokens or element in template.links)

    if template.main in page.up:
        inside: dict[int, bool] = {0: False, template.main: True}

        def within(element: int) -> bool:
            if element not in inside:
                inside[element] = not away(element) and element not in template.links and within(page.up[element])
            return inside[element]

        of_main = [x for x in runs if within(x.element)]
        if any(x.text.strip() for x in of_main):
            if all(x.main for x in of_main):  # an article around it: what else that holds
                around = [x for x in runs if x.main and not away(x.hinted) and x.element not in template.links]
                return around or of_main
            return of_main
    plain = [x for x in runs if not away(x.hinted)]
    for some in ([x for x in plain if x.main], plain, [x for x in runs if x.main]):
        if any(x.text.strip() for x in some):
            return some
    return runs


def blocks_of(page: Page, template: Template) -> str:
    """The text of the chosen parts' blocks, a block a paragraph, without blocks that are template as a whole."""
    blocks: list[list[Part]] = []
    for x in chosen_parts(page, template):
        if not blocks or x.block != blocks[-1][0].block:
            blocks.append([])
        blocks[-1].append(x)
    blocks = [x for x in blocks if any(y.text.strip() for y in x)]

    def fixed(x: list[Part]) -> bool:
        return all(t in template.tokens for y in x if y.text.strip() for t in words_of(y))

    slots = [x for x in blocks if not fixed(x)] if template.tokens else blocks
    out = ["".join(y.text for y in x) for x in slots or blocks]  # else a host that repeats a whole page
    paragraphs = (" ".join(html.unescape(x).split()) for x in out)
    return "\n\n".join(p for p in paragraphs if p)


OCCURRENCE = "rid long, host long, token long, tag int, times int, place int, depth int, chars int, linked int"


def page_tokens(page: Page) -> dict[int, list[int]]:
    """Of every token of a page: whether it is a tag, its times, the place of the first, and of an element its depth, the
    characters inside it and those of them in links (text aside by its tags is not counted)."""
    seen: dict[int, list[int]] = {}
    inside: dict[int, list[int]] = {}
    for i, x in enumerate(page.parts):
        if x.token:
            tag = x.text is None or x.text == " "
            for token in [x.token] if tag else words_of(x):
                seen.setdefault(token, [int(tag), 0, i, 0, 0, 0])[1] += 1
            if not tag and not x.aside:
                own = inside.setdefault(x.element, [0, 0])
                own[0] += len(x.text)
                own[1] += len(x.text) * x.link
    for element, (chars, linked) in inside.items():
        chain = [element] if element else []
        while chain and page.up[chain[-1]]:
            chain.append(page.up[chain[-1]])
        for depth, e in zip(range(len(chain), 0, -1), chain, strict=True):
            row = seen[e]
            row[3], row[4], row[5] = depth, row[4] + chars, row[5] + linked
    return seen


def occurrences(pages: DataFrame) -> DataFrame:
    """OCCURRENCE rows: every token on every page (``rid``)."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rid, host, token, rest = [], [], [], []
            for r, h, page in zip(batch["rid"], batch["host"], batch["html"], strict=True):
                seen = page_tokens(parsed(page))
                rid += [r] * len(seen)
                host += [h] * len(seen)
                token += seen
                rest += seen.values()
            own = np.array(rest, dtype=np.int32).reshape(-1, 6).T
            ids = {"rid": np.array(rid, dtype=np.int64), "host": np.array(host, dtype=np.int64), "token": np.array(token, dtype=np.int64)}
            yield pd.DataFrame(ids | dict(zip(("tag", "times", "place", "depth", "chars", "linked"), own, strict=True)))

    return pages.select("rid", F.xxhash64("host").alias("host"), "html").mapInPandas(count, OCCURRENCE)


def templates(pages: DataFrame) -> DataFrame:
    """``host`` (hashed), ``template`` (the tokens of its valid classes), ``main`` and ``links`` (elements).

    An occurrence vector is known by the number of its pages and the sum of hashes of (page, times), which adds up within
    tasks: no vector is ever gathered, so a host with a third of all pages is a row for each token and task. A class is
    valid if it is large and frequent enough and its span (from its first to its last token, by mean place) crosses no span of
    a class on as many pages or more. The tokens of one host are bounded: each stands on SHARE of the pages. ``main`` is the
    deepest element of the template that stands once on its pages and holds MOST of the text outside links; ``links`` are those that hold more than MOST of
    their own text in links.
    """
    seen = occurrences(pages)
    sums = [F.count("*").alias("n"), F.sum(F.xxhash64("rid", "times").cast("decimal(38,0)")).alias("vector"), F.avg("place").alias("place"), F.max("tag").alias("tag"), F.max("depth").alias("depth"), F.sum("chars").alias("chars"), F.sum("linked").alias("linked"), (F.sum("times") == F.count("*")).alias("once")]
    tokens = seen.groupBy("host", "token").agg(*sums).where(f"n >= {PAGES}")
    totals = pages.groupBy(F.xxhash64("host").alias("host")).agg(F.count("*").alias("pages")).where(f"pages >= {PAGES}")
    tokens = tokens.join(hint(materialise(totals, "hosts"), 24), "host").where(F.col("n") >= SHARE * F.col("pages"))
    token = F.struct("token", "tag", "depth", "chars", "linked", "once")
    classes = tokens.groupBy("host", "n", "vector").agg(F.collect_list(token).alias("tokens"), F.min("place").alias("a"), F.max("place").alias("b")).where(F.size("tokens") >= TOKENS)
    by_host = classes.groupBy("host").agg(F.collect_list(F.struct("n", "a", "b", "tokens")).alias("classes"))

    def nested(c, all_classes):
        return ~F.exists(all_classes, lambda o: (o["n"] >= c["n"]) & (((o["a"] < c["a"]) & (c["a"] < o["b"]) & (o["b"] < c["b"])) | ((c["a"] < o["a"]) & (o["a"] < c["b"]) & (c["b"] < o["b"]))))

    valid = let(F.col("classes"), lambda cs: F.flatten(F.transform(F.filter(cs, lambda c: nested(c, cs)), lambda c: c["tokens"])))
    rows = by_host.select("host", valid.alias("valid"))
    own = lambda t: t["chars"] - t["linked"]
    elements = F.filter("valid", lambda t: (t["tag"] == 1) & (t["chars"] > 0))
    rows = rows.withColumn("most", MOST * F.array_max(F.transform(elements, own)))
    main = F.array_max(F.transform(F.filter(elements, lambda t: t["once"] & (own(t) >= F.col("most"))), lambda t: F.struct(t["depth"].alias("depth"), own(t).alias("own"), t["token"].alias("token"))))["token"]
    listed = F.filter(elements, lambda t: (t["linked"] > MOST * t["chars"]) & (own(t) < F.col("most")))
    return rows.select("host", F.transform("valid", lambda t: t["token"]).alias("template"), F.coalesce(main, F.lit(0)).alias("main"), F.transform(listed, lambda t: t["token"]).alias("links"))


def extract_main(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``id_col``, ``url_col``, ``text`` and ``n_chars`` (code points) of every row of ``df``.

    The text is that of the main element of the host's template (:func:`templates`), without lists of links, what tags show to
    be menus, headers, footers, sidebars, forms, scripts or styles, elements whose class, id or role is a word that says the like (inside an
    article, and of single paragraphs, only if they are of the template), and
    blocks that are template as a whole. Where an article or main element lies around it, that element counts. Hosts of fewer than
    PAGES pages, and pages without the main element, are read by their article or main element, else by their body. Character
    references are decoded, white space within a block becomes one space, blocks are joined by two newlines; nothing else
    is dropped. A null page counts as empty; a null url is a host of its own; a null id stays null; repeated rows are pages
    like others. Long pages are read whole. An empty table gives an empty result; other columns are not read.
    """
    spark = df.sparkSession
    bound_batches(spark)
    kinds = {c: df.schema[c].dataType.simpleString() for c in (id_col, url_col)}
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url_col), F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/@?#]*@)?([^/:?#]*)", 1))
    pages = df.select(F.xxhash64(F.col(id_col).cast("string"), url_col, html_col).alias("rid"), F.col(id_col).cast("string").alias("id"), F.col(url_col).cast("string").alias("url"), host.alias("host"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))
    template = materialise(templates(pages), "templates")
    size = template.agg(F.sum(64 + 8 * (F.size("template") + F.size("links")))).first()[0] or 0
    template = F.broadcast(template) if size <= BROADCAST_BYTES else template

    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[int, Template] = {}
        for batch in batches:
            texts = []
            for h, page, tokens, main, links in zip(batch["h"], batch["html"], batch["template"], batch["main"], batch["links"], strict=True):
                if h not in known:
                    if len(known) > 1000:
                        known.clear()
                    known[h] = Template(frozenset(tokens.tolist()), int(main), frozenset(links.tolist())) if tokens is not None else NONE
                texts.append(blocks_of(parsed(page), known[h]))
            yield pd.DataFrame({"id": batch["id"], "url": batch["url"], "text": texts})

    joined = pages.withColumn("h", F.xxhash64("host")).join(template.withColumnRenamed("host", "h"), "h", "left")
    out = joined.select("id", "url", "h", "html", "template", "main", "links").mapInPandas(extract, "id string, url string, text string")
    return out.select(F.col("id").cast(kinds[id_col]).alias(id_col), F.col("url").cast(kinds[url_col]).alias(url_col), "text", F.length("text").cast("long").alias("n_chars"))
