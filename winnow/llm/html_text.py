"""Main text of web pages as a maximum-scoring stretch of words and tags.

A page is read once into items: runs of words, tags, and elements that never are part of an article (menus, forms, adverts, scripts
and the like), each a single item of which nothing is kept. Words score above zero, tags below; a linear scan finds the stretch with
the highest sum, and its words are the text. The scores are learned from pages that mark their article themselves, with an
article or main element: log-odds of each kind of item inside against outside, then a perceptron that moves the scores
until the best stretch is the marked one. Marks have no meaning of their own in the scan, they are tags with a score like others.
"""

from __future__ import annotations

import bisect
import html
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Elements that stand as blocks of their own, by the HTML standard's rendering rules.
BLOCKS = set("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup html legend li main menu nav ol p pre search section summary table tbody tfoot thead tr ul".split())
#: Containers that aren't blocks, whose contents are found by their end tag like those of blocks.
HOLDERS = set("audio button canvas datalist map noscript object picture select svg td template th video".split())
INLINE = set("a abbr b bdi bdo big br cite code data del dfn em embed font hr i img input ins kbd label link mark math meta param q rp rt ruby s samp small source span strike strong sub sup time track tt u var wbr".split())
#: Their contents are no markup, up to their end tag.
RAW = set("iframe noembed noframes plaintext script style textarea title xmp".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: A start tag ends these if they are the innermost open blocks; paragraphs end at any block.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "tbody": {"tr", "td", "th", "thead"}, "tfoot": {"tr", "td", "th", "tbody"}}

#: Elements without article text, whatever they hold; a header only outside an article.
DROPPED = set("aside audio button canvas datalist dialog footer form head header map menu nav noscript object search select svg template video".split()) | RAW
ROLES = set("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
#: Parts of class and id values that name such elements.
HINTS = set("ad ads advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs consent cookie cookies footer gdpr masthead menu modal nav navbar navigation newsletter notice notices overlay pager pagination popup promo promotion recommended related share sharing sidebar signup social sponsor sponsored subscribe toolbar topbar widget".split())
COMMENTS = set("comment comments commentlist disqus replies reply respond".split())
#: With these beside a hint, the name speaks of the content beside such an element, as in has-sidebar.
NOT_HINTS = set("content has main no with without".split())

SKIPPED = r"<!--.*?(?:--!?>|\Z)|<[!?][^>]*(?:>|\Z)"
TAG = re.compile(SKIPPED + r"|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|(?=</?[A-Za-z])", re.S)
#: For pages with a quote that nothing closes, from there on: quotes mean nothing, and a tag ends before the next one at the latest.
UNQUOTED = re.compile(SKIPPED + r"|<(/?)([A-Za-z][^\s/<>]*)([^<>]*)(?:>|(?=<)|\Z)", re.S)
ATTRIBUTE = re.compile(r"([a-z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))|\b(hidden)\b", re.I)
RAW_END = {name: re.compile(rf"</{name}(?=[\s/>]|\Z)", re.I) for name in RAW}
PART = re.compile(r"[A-Z]?[a-z0-9]+|[A-Z]+")

WORD, LINKED = 0, 1
TAGS = sorted(BLOCKS | HOLDERS | INLINE | RAW | VOID)
#: Codes of the kinds of items: words, linked words, tags by name, elements that are left out by name.
KINDS = {name: k for k, name in enumerate(["", "a "] + TAGS + ["other"] + [f"-{t}" for t in TAGS] + ["-other"])}
N_KINDS = len(KINDS)
LEAST, MOST_A_WORD, UNSEEN, MOST_LEFT_OUT = 0.05, 1.0, -0.1, -0.5
IS_LEFT_OUT = np.array([name.startswith("-") for name in KINDS])
EPOCHS = 30


def _is_dropped(name: str, attributes: str) -> int:
    """0: kept, 1: left out, 2: left out unless it holds an article, 3: left out although it may be one."""
    if name in DROPPED:
        return 1
    said = {}
    for m in ATTRIBUTE.finditer(attributes) if attributes else ():
        said.setdefault((m[1] or m[5]).lower(), m[2] or m[3] or m[4] or "")
    if "hidden" in said or said.get("aria-hidden") == "true" or said.get("role", "").lower() in ROLES:
        return 2
    parts = {p.lower() for c in ("class", "id") if c in said for p in PART.findall(said[c])}
    if parts & COMMENTS and not parts & NOT_HINTS:
        return 3
    return 2 if parts & HINTS and not parts & NOT_HINTS else 0


def _tokens(page: str) -> list[tuple]:
    """(text,) and (name, is an end tag, attributes) in page order; the contents of raw elements and all comments are gone."""
    out, at, tag = [], 0, TAG
    while at < len(page):
        m = tag.search(page, at)
        if m and m.end() == m.start():
            # no end up to the page's own, or no tag at all: other tags would be looked through as far again
            tag = UNQUOTED
            m = tag.search(page, at)
        if not m:
            out.append((page[at:],))
            break
        if m.start() > at:
            out.append((page[at : m.start()],))
        at, name = m.end(), (m[2] or "").lower()
        if not name:
            continue
        end = bool(m[1])
        out.append((name, end, m[3] or ""))
        if name in RAW and not end:
            close = RAW_END[name].search(page, at)
            at = close.start() if close else len(page)
    return out


def _left_out(tokens: list[tuple]) -> dict[int, int]:
    """Start and end places of the elements that are left out, outermost only. One that nothing closes is not left out."""
    spans, open_at, count, articles, kept_articles = [], [], {}, [], []
    inline: dict[str, list] = {}

    def close(k: int) -> None:
        at, name, kind = open_at.pop()
        count[name] -= 1
        if kind:
            spans.append((at, k, kind))

    for k, t in enumerate(tokens):
        if len(t) == 1:
            continue
        name, end, attributes = t
        if name in BLOCKS or name in HOLDERS or name == "head":
            if end:
                if count.get(name):
                    while open_at[-1][1] != name:
                        close(k)
                    close(k + 1)
                continue
            while open_at and (open_at[-1][1] == "p" and name in BLOCKS or open_at[-1][1] in ENDS.get(name, ())):
                close(k)
            kind = _is_dropped(name, attributes)
            kind = 0 if name in ("html", "body", "main") or name == "header" and (count.get("article") or count.get("main")) else kind
            open_at.append((k, name, kind))
            count[name] = count.get(name, 0) + 1
            if name in ("article", "main"):
                articles.append(k)
                if kind != 3:
                    kept_articles.append(k)
        elif name in RAW and not end:
            spans.append((k, k + 2 if k + 1 < len(tokens) and tokens[k + 1][:2] == (name, True) else k + 1, 1))
        elif name not in VOID:
            mine = inline.setdefault(name, [])
            if not end:
                mine.append((k, len(open_at), _is_dropped(name, attributes)))
            elif mine:
                at, depth, kind = mine.pop()
                if kind and depth == len(open_at):
                    spans.append((at, k + 1, kind))
    out, upto = {}, 0
    for a, b, kind in sorted(spans, key=lambda s: (s[0], -s[1])):
        holds = bisect.bisect_left(kept_articles, b) > bisect.bisect_left(kept_articles, a)
        if a >= upto and not (kind == 2 and holds):
            out[a] = upto = b
    return out


class Page:
    """A page's items: kind, score count and text of each, and the place where each marked article begins and ends."""

    def __init__(self, page: str):
        self.kinds, self.counts, self.texts, self.marks = [], [], [], []
        tokens, links, marked = _tokens(page), 0, []
        out, k = _left_out(tokens), 0
        while k < len(tokens):
            t = tokens[k]
            if k in out:
                self._add(KINDS.get(f"-{t[0]}", KINDS["-other"]), 1, "\n" if t[0] in BLOCKS else " ")
                k = out[k]
                continue
            k += 1
            if len(t) == 1:
                text = html.unescape(t[0])
                if n := len(text.split()):
                    self._add(LINKED if links else WORD, n, text)
                else:
                    self._space(text)
                continue
            name, end, _ = t
            links = max(0, links + (-1 if end else 1)) if name == "a" else 0 if name in BLOCKS else links
            if name in ("article", "main"):
                if not end:
                    marked.append((name, len(self.kinds) + 1))
                elif any(n == name for n, _ in marked):
                    while marked[-1][0] != name:
                        marked.pop()
                    self.marks.append((name, marked.pop()[1], len(self.kinds)))
            self._add(KINDS.get(name, KINDS["other"]), 1, "\n" if name in BLOCKS or name == "hr" else " " if name in ("br", "td", "th") else "")

    def _add(self, kind: int, n: int, text: str) -> None:
        self.kinds.append(kind)
        self.counts.append(n)
        self.texts.append(text)

    def _space(self, text: str) -> None:
        if self.texts and text:
            self.texts[-1] += " "

    def region(self, scores: np.ndarray) -> tuple[int, int]:
        """The first longest stretch of items with the highest sum, in one pass; (0, 0) if no item scores above zero."""
        best, place, total, start = 0.0, (0, 0), 0.0, 0
        for k, x in enumerate((scores[self.kinds] * self.counts).tolist()):
            if total <= 0:
                total, start = 0.0, k
            total += x
            if total > best or total == best and start == place[0] and place[1]:
                best, place = total, (start, k + 1)
        return self.trimmed(*place)

    def trimmed(self, a: int, b: int) -> tuple[int, int]:
        """Without the items before its first and behind its last words."""
        while a < b and self.kinds[a] > LINKED:
            a += 1
        while a < b and self.kinds[b - 1] > LINKED:
            b -= 1
        return (a, b) if a < b else (0, 0)

    def text(self, a: int, b: int) -> str:
        # a line break in the page is white space; only what items say ends a block
        parts = [t if k > LINKED else t.replace("\n", " ") for k, t in zip(self.kinds[a:b], self.texts[a:b], strict=True)]
        lines = (" ".join(x.split()) for x in "".join(parts).split("\n"))
        return "\n".join(x for x in lines if x)

    def marked(self) -> tuple[int, int] | None:
        """The article that the page marks: its only article element, or else its only main element. None without words."""
        for name in ("article", "main"):
            found = [(a, b) for n, a, b in self.marks if n == name]
            if found:
                found = self.trimmed(*found[0]) if len(found) == 1 else (0, 0)
                if found != (0, 0):
                    return found
        return None


def learned(pages: list[tuple[np.ndarray, np.ndarray, int, int]]) -> np.ndarray:
    """Scores of the kinds, from marked pages (kinds, counts, first item, end of the marked stretch).

    Without pages a word scores 1, a linked one 0.3, a tag -3; a kind that no page has scores UNSEEN, which says little.
    Words stay within LEAST to MOST_A_WORD, tags at -LEAST at most; what is left out scores MOST_LEFT_OUT at least, for an article
    goes on behind an advert in it.
    """
    if not pages:
        scores = np.full(N_KINDS, -3.0)
        scores[[WORD, LINKED]] = 1.0, 0.3
        return scores
    inside, outside = np.ones(N_KINDS), np.ones(N_KINDS)
    for kinds, counts, a, b in pages:
        inside += np.bincount(kinds[a:b], counts[a:b], N_KINDS)
        outside += np.bincount(kinds[:a], counts[:a], N_KINDS) + np.bincount(kinds[b:], counts[b:], N_KINDS)

    def held(s: np.ndarray) -> np.ndarray:
        words = np.clip(s[: LINKED + 1], LEAST, MOST_A_WORD)
        s = np.where(IS_LEFT_OUT, np.maximum(s, MOST_LEFT_OUT), s)
        return np.concatenate([words, np.minimum(s[LINKED + 1 :], -LEAST)])

    scores = np.log(inside / inside.sum()) - np.log(outside / outside.sum())
    scores[inside + outside == 2] = UNSEEN
    scores, best, fewest = held(scores), None, math.inf
    for _ in range(EPOCHS):
        wrong, tried = 0, scores.copy()
        for kinds, counts, a, b in pages:
            p = Page("")
            p.kinds, p.counts = kinds, counts
            x, y = p.region(scores)
            if (x, y) != (a, b):
                wrong += 1
                missed = np.bincount(kinds[a:b], counts[a:b], N_KINDS) - np.bincount(kinds[x:y], counts[x:y], N_KINDS)
                scores = held(scores + missed / max(1.0, np.abs(missed[LINKED + 1 :]).max()))
        if wrong < fewest:
            best, fewest = tried, wrong
        if not wrong:
            break
    return best


def fitted(pages: DataFrame, key: str = "page_id", max_pages: int = 1000, max_items: int = 4000) -> np.ndarray:
    """Scores learned from at most max_pages pages that mark their article, those with the smallest hashes of their key, of at
    most max_items items each: so much comes to the driver at most. All of them if there are fewer."""

    def items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(0).to_pylist():
                p = Page(text or "")
                if len(p.kinds) <= max_items and (m := p.marked()):
                    rows.append((p.kinds, p.counts, *m))
            yield pa.RecordBatch.from_pylist([dict(zip(("kinds", "counts", "a", "b"), r, strict=True)) for r in rows], pa.schema([("kinds", pa.list_(pa.int32())), ("counts", pa.list_(pa.int32())), ("a", pa.int32()), ("b", pa.int32())]))

    # the smallest hashes are looked for among keys and lengths alone; twice the pages, for not all mark an article
    likely = pages.where(F.col("html").rlike("(?i)<(article|main)\\b") & (F.length("html") <= 40 * max_items))
    drawn = likely.select(F.xxhash64(key, "html").alias("h")).orderBy("h").limit(2 * max_pages).agg(F.max("h")).first()[0]
    if drawn is None:
        return learned([])
    found = likely.where(F.xxhash64(key, "html") <= F.lit(drawn)).select("html").mapInArrow(items, "kinds array<int>, counts array<int>, a int, b int")
    rows = found.orderBy(F.xxhash64("kinds", "counts"), "a", "b").limit(max_pages).collect()
    return learned([(np.array(r.kinds, np.int64), np.array(r.counts, np.int64), r.a, r.b) for r in rows])


def extracted(pages: DataFrame, scores: np.ndarray) -> DataFrame:
    """page_id, url, text, n_chars of each of pages: the words of the best stretch, blocks as lines. A null page has no text."""

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                some = batch.slice(at, 64)
                out = []
                for page in some.column(2).to_pylist():
                    p = Page(page or "")
                    out.append(p.text(*p.region(scores)))
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.array(out, pa.string()), pa.array(list(map(len, out)), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), "html").mapInArrow(texts, "page_id long, url string, text string, n_chars long")


def op12_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, url, text, n_chars of every page, with scores learned from the pages that mark their article.

    A null or empty page, and one without words outside what is left out, gives an empty text. Repeated rows give equal rows;
    pages of any length are read whole, cut-off tags and elements as browsers read them. No pages: no rows.
    """
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return extracted(pages, fitted(pages))
