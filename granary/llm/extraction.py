"""HTML extraction: the page's own marks first, repeats of the host where a page marks nothing.

A tolerant reader turns a page into blocks of text, each inside a marked main part (``article``, ``main``), in a part that
is no main text (navigation, footers, adverts, comments, forms, ...), or open. A page with a marked main part is that part.
For the others, token strings of ``RUN`` tokens that occur on at least two distinct pages of the host (in open blocks or
discarded parts) are repeats, and open blocks that these cover are boilerplate; the unique runs of blocks stay.

Repeats are sought over the whole host, however many pages it has: the suffixes of its pages' tokens are sorted over ranges by
host, first ``RUN`` tokens and page, and equal neighbours of distinct pages are repeats. Runs that go on in the next range meet by
their ends, so neither a host nor a string of all its pages is one task's work. ``repeated_tokens`` gives the same for pages in memory, by a suffix array.

Cases: null html is empty and gives an empty text; malformed markup is read as far as it goes (unclosed tags end with
their parents, a void or unknown end tag is skipped, a quote that nothing closes ends with its tag, CDATA that nothing closes with
the page); null urls share the empty host; repeated rows are pages of their own, so their strings repeat on the host. A very long
page is read whole, one at a time. Only the three named columns are read. Empty tables give none.
"""

from __future__ import annotations

import html as entities
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.common import shuffle_width, stored
from granary.llm.urls import host

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)", re.S)
RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "xmp", "noembed", "noframes", "svg", "math", "canvas", "object", "audio", "video", "select", "button", "datalist"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form",
    "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "option", "p", "pre", "search", "section", "summary", "table",
    "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
JUNK = {"nav", "header", "footer", "aside", "form", "menu", "dialog", "head", "search"}
JUNK_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alertdialog", "menu", "menubar", "form", "toolbar"}
MAIN_ROLES = {"main", "article"}
JUNK_NAMES = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "adsense", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "commentlist", "consent", "cookie", "cookies",
    "disqus", "disclaimer", "footer", "gdpr", "header", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notices", "pager", "pagination", "popup", "promo", "promotion",
    "related", "replies", "reply", "respond", "share", "sharing", "sidebar", "signup", "social", "sponsor", "sponsored", "subscribe", "subscription", "toolbar", "topbar", "widget",
}
#: Words that may stand beside those in a name; any other makes it another name (ad-free, header-image, no-ads).
BESIDE = {
    "area", "bar", "block", "body", "bottom", "box", "btn", "button", "buttons", "col", "container", "content", "current", "desktop", "fixed", "form", "global", "group", "inner", "item", "items", "js", "left",
    "link", "links", "list", "local", "main", "mobile", "outer", "overlay", "page", "panel", "policy", "post", "posts", "primary", "reader", "right", "row", "secondary", "section", "site", "slot", "space",
    "sticky", "sub", "thread", "top", "unit", "user", "wrap", "wrapper", "zone", "",
}
MAIN_NAMES = {"articlebody"}
#: An open element closes these when it opens.
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
ATTRIBUTE = re.compile(r"([^\s=\"'<>/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
RUN = 6
COVERED = 0.8
KEEP, DROP, OPEN = 0, 1, 2


def _kind(tag: str, attributes: str) -> int:
    """KEEP for a main part, DROP for a part that is none, else OPEN."""
    if tag in JUNK:
        return DROP
    said = {k.lower(): a or b or c for k, a, b, c in ATTRIBUTE.findall(attributes)} if attributes else {}
    role = said.get("role", "").strip().lower()
    if role in JUNK_ROLES or "hidden" in said or said.get("aria-hidden", "").lower() == "true":
        return DROP
    names = [set(re.split(r"[^a-z]+", name)) for k in ("class", "id") for name in said.get(k, "").lower().split()]
    if any(n & JUNK_NAMES and n <= JUNK_NAMES | BESIDE for n in names) and tag not in ("html", "body", "main"):
        return DROP
    if tag in ("article", "main") or role in MAIN_ROLES or "articlebody" in said.get("itemprop", "").lower():
        return KEEP
    return OPEN


def blocks(page: str | None) -> list[tuple[int, str]]:
    """(KEEP, DROP or OPEN; text) of every block with text, in page order; character references decoded, white space single."""
    page = page or ""
    out: list[tuple[int, str]] = []
    stack: list[tuple[str, int]] = []
    text: list[str] = []
    state = OPEN

    def close():
        said = " ".join(entities.unescape("".join(text)).split())
        text.clear()
        if said:
            out.append((state, said))

    def pop():
        nonlocal state
        close()
        stack.pop()
        state = stack[-1][1] if stack else OPEN

    at = 0
    for m in iter(lambda: TOKEN.search(page, at), None):
        text.append(page[at : m.start()])
        at = m.end()
        closes, tag, attributes = m.group(1, 2, 3) if m[2] else m.group(4, 5, 6)  # the last three: a quote that nothing closes
        if not tag:
            if m[0].startswith("<![CDATA["):
                text.append(m[0][9:].removesuffix("]]>").replace("&", "&amp;"))
            continue
        tag = tag.lower()
        if closes:
            if any(t == tag for t, _ in stack):
                if tag in BLOCK or any(t in BLOCK for t, _ in stack[-1:]):
                    close()
                # an inline end tag doesn't close the blocks around it
                depth = max(i for i, (t, _) in enumerate(stack) if t == tag)
                if tag in BLOCK or not any(t in BLOCK for t, _ in stack[depth + 1 :]):
                    while len(stack) > depth:
                        if stack[-1][0] in BLOCK or stack[-1][1] != (stack[-2][1] if len(stack) > 1 else OPEN):
                            pop()
                        else:
                            stack.pop()
            elif tag == "p":
                close()
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            if not attributes.rstrip().endswith("/"):
                at = end.end() if end else len(page)
            continue
        if tag in VOID:
            if tag == "hr":
                close()
            elif tag == "br":
                text.append(" ")
            continue
        if tag in BLOCK:
            close()
            shut = CLOSES.get(tag, {"p"} if tag not in ("body", "html") else set())
            while stack and any(t in shut for t, _ in stack):
                k = max(i for i, (t, _) in enumerate(stack) if t in shut)
                if any(t in BLOCK and t not in shut for t, _ in stack[k + 1 :]):
                    break
                while len(stack) > k:
                    pop()
        kind = _kind(tag, attributes)
        inner = DROP if state == DROP or kind == DROP else KEEP if state == KEEP or kind == KEEP else OPEN
        if inner != state:
            close()
        stack.append((tag, inner))
        state = inner
    text.append(page[at:])
    close()
    return out


def suffix_order(tokens: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(suffix array, ranks) of the suffixes by their first ``depth`` tokens or a little more, by prefix doubling."""
    n = len(tokens)
    rank = np.unique(tokens, return_inverse=True)[1].astype(np.int64)
    k = 1
    while True:
        after = np.full(n, -1, np.int64)
        after[: n - k] = rank[k:] if k < n else rank[:0]
        pair = rank * (n + 1) + after + 1
        rank = np.unique(pair, return_inverse=True)[1].astype(np.int64)
        k *= 2
        if k >= depth or rank.max() == n - 1:
            return np.argsort(rank, kind="stable"), rank


def repeated_tokens(streams: list[list[str]], run: int = RUN) -> list[np.ndarray]:
    """For each stream the mask of tokens inside strings of ``run`` tokens that at least two distinct streams hold."""
    known: dict[str, int] = {}
    coded = [[known.setdefault(t, len(known)) for t in s] for s in streams]
    flat, owner = [], []
    for i, s in enumerate(coded):
        flat += [*s, len(known) + i]  # a sentinel of its own ends each stream
        owner += [i] * (len(s) + 1)
    tokens, pages = np.array(flat, np.int64), np.array(owner)
    if not len(tokens):
        return [np.zeros(0, bool) for _ in streams]
    order, _ = suffix_order(tokens, run)
    a, b = order[:-1], order[1:]
    same = np.ones(len(a), bool)
    for k in range(run):
        inside = (a + k < len(tokens)) & (b + k < len(tokens))
        same &= inside
        same[inside] &= tokens[a[inside] + k] == tokens[b[inside] + k]
    group = np.concatenate(([0], np.cumsum(~same)))
    least = np.full(group[-1] + 1, len(streams))
    most = np.full(group[-1] + 1, -1)
    np.minimum.at(least, group, pages[order])
    np.maximum.at(most, group, pages[order])
    starts = order[(most > least)[group]]
    edge = np.zeros(len(tokens) + run + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + run, -1)
    covered = np.cumsum(edge)[: len(tokens)] > 0
    out, at = [], 0
    for s in coded:
        out.append(covered[at : at + len(s)])
        at += len(s) + 1
    return out


def uncovered(page: list[tuple[int, str]], mask: np.ndarray) -> str:
    """The open blocks of a page that its mask of repeated tokens doesn't cover."""
    kept, at = [], 0
    for kind, text in page:
        size = text.count(" ") + 1
        if kind == OPEN and mask[at : at + size].mean() < COVERED:
            kept.append(text)
        at += size
    return "\n".join(kept)


def main_texts(pages: list[list[tuple[int, str]]], run: int = RUN) -> list[str]:
    """The main text of each page of a host, from its blocks."""
    others = [[(kind, text) for kind, text in page if kind != KEEP] for page in pages]
    marked = [len(rest) < len(page) for rest, page in zip(others, pages, strict=True)]
    masks = repeated_tokens([[t for _, text in rest for t in text.split(" ")] for rest in others], run) if not all(marked) else [None] * len(pages)
    own = ["\n".join(text for kind, text in page if kind == KEEP) for page in pages]
    return [text if mine else uncovered(rest, mask) for text, mine, rest, mask in zip(own, marked, others, masks, strict=True)]


def starts(tokens: list[str], run: int = RUN) -> list[str]:
    """The first ``run`` tokens of each suffix that has as many; tokens hold no space."""
    return [" ".join(tokens[k : k + run]) for k in range(len(tokens) - run + 1)]


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", run: int = RUN) -> DataFrame:
    """(id, url, text) of every page.

    The text of marked pages is final when they are read. Only hosts with unmarked pages are searched for repeats, and of
    their marked pages only the parts outside the main text go along.
    """

    def read(batches):
        kind = pa.list_(pa.struct([("kind", pa.int8()), ("text", pa.string())]))
        for b in batches:
            texts, rest = [], []
            for page in b.column(3):
                found = blocks(page.as_py())
                own = [t for k, t in found if k == KEEP]
                texts.append("\n".join(own) if own or not found else None)
                rest.append([{"kind": k, "text": t} for k, t in found if k != KEEP])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(texts, pa.string()), pa.array(rest, kind), b.column(4)], ["id", "url", "host", "text", "blocks", "page"])

    # rows are pages of their own, so each has its number; it is stored with them
    named = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), host(F.col(url_col)).alias("host"), F.col(html_col).cast("string").alias("html"), F.monotonically_increasing_id().alias("page"))
    seen = stored(named.mapInArrow(read, "id long, url string, host string, text string, blocks array<struct<kind:tinyint,text:string>>, page long"), "blocks")
    done = seen.where("text is not null").select("id", "url", "text")
    hosts = stored(seen.where("text is null").select("host").distinct(), "hosts")
    if hosts.isEmpty():
        return done

    def words(found) -> list[str]:
        return [t for x in found for t in x["text"].split(" ")]

    def suffixes(batches):
        for b in batches:
            for page, at, found, unmarked in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                if said := sorted(set(starts(words(found), run))):
                    yield pa.RecordBatch.from_arrays([pa.array([at] * len(said), pa.string()), pa.array(said, pa.string()), pa.array(np.full(len(said), page)), pa.array(np.full(len(said), unmarked))], ["host", "suffix", "page", "open"])

    def runs(batches):
        """(host, suffix, least, most page) of the equal neighbours in the order; those of one page only at the ends of a partition, where the next one may go on."""
        held, first = None, True
        for b in batches:
            out = []
            for at, suffix, page in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                if held and held[1] == suffix and held[0] == at:
                    held[3] = page
                    continue
                if held and (first or held[2] < held[3]):
                    out.append(held)
                first = first and not held
                held = [at, suffix, page, page]
            yield batch(out)
        yield batch([held] if held else [])

    def batch(out):
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], kind) for k, kind in enumerate((pa.string(), pa.string(), pa.int64(), pa.int64()))], ["host", "suffix", "least", "most"])

    said = seen.join(hosts, "host", "left_semi").select("page", "host", "blocks", F.col("text").isNull().alias("open")).mapInArrow(suffixes, "host string, suffix string, page long, open boolean")
    # the suffixes of a host in order, by their first tokens; pages are in the order too, so that a string of many pages is dealt over tasks
    order = ["host", "suffix", "page"]
    ordered = said.select(*order).repartitionByRange(shuffle_width(pages.sparkSession), *order).sortWithinPartitions(*order)
    found = ordered.mapInArrow(runs, "host string, suffix string, least long, most long").groupBy("host", "suffix").agg(F.min("least").alias("least"), F.max("most").alias("most"))
    # stored before the join, so that the rows of a string of many pages can be split over tasks
    repeated = stored(found.where("least < most").select("host", "suffix"), "repeated")
    covered = said.where("open").join(repeated, ["host", "suffix"]).groupBy("page").agg(F.collect_list("suffix").alias("suffixes"))

    def settle(batches):
        for b in batches:
            texts = []
            for found, known in zip(*(b.column(i).to_pylist() for i in (2, 3)), strict=True):
                tokens, known = words(found), set(known or [])
                at = np.array([k for k, s in enumerate(starts(tokens, run)) if s in known], np.int64)
                edge = np.zeros(len(tokens) + 1, np.int64)
                np.add.at(edge, at, 1)
                np.add.at(edge, at + run, -1)
                texts.append(uncovered([(x["kind"], x["text"]) for x in found], np.cumsum(edge)[:-1] > 0))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string())], ["id", "url", "text"])

    ready = seen.where("text is null").join(covered, "page", "left").select("id", "url", "blocks", "suffixes")
    return done.unionByName(ready.mapInArrow(settle, "id long, url string, text string"))
