"""Main-text extraction from HTML by a decision tree over flat text blocks.

A page is cut into flat text blocks at block-level tags. A block's features are its
word count and link density, those of the blocks before and after it, and where it
stands: in a boilerplate element, a form, a container named as boilerplate, an
article, a heading; how many plain words are still to come, which tells a list of
contents from the related links at the end; whether the block is a phrase of
boilerplate; and whether it stands behind a heading of reader comments. A decision
tree trained on the labelled table of :mod:`brickyard.llm.html_labelled` keeps or
drops it. A name is a weak feature: it counts only if all of its words say so
(``cookie-notice``, not ``share-of-wealth``). Half of the labelled pages with an
article are learned a second time without their tags, so that a page of ``div``
elements is judged by its words and links. The phrases are English ones and signs;
what no tag, name, phrase or link density marks cannot be told from main text.

The scan is linear in the page: a tag ends at ``>``, and a ``<`` that meets another
``<`` first is text; a quote matters only after ``=``; closing tags pop what they
close and are ignored when nothing of their name is open.

Null html gives empty text, as does a page without a main block; broken or cut
markup never fails, and a tag cut off at the end of the page is dropped; repeated
rows each give a row; null ids and urls stay; an empty table gives no rows; extra
columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from html import unescape

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brickyard.llm.common import small_batches
from brickyard.llm.html_labelled import PAGES

#: Elements that start and end a text block.
BLOCK_TAGS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements whose content is no text of the page.
HIDDEN_TAGS = frozenset("script style noscript template svg math iframe object canvas audio video head title".split())
RAW_TAGS = frozenset("script style".split())
#: Containers that never hold main text, and form controls.
BOILER_TAGS = frozenset("nav footer aside menu dialog".split())
FORM_TAGS = frozenset("form button select textarea label fieldset input".split())
ARTICLE_TAGS = frozenset("article main".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that are containers only if they have a class, id or role.
LEAF_TAGS = frozenset("p li span td th tr option dd dt".split())
INLINE_TAGS = frozenset("a b i em strong u s small big sub sup font code".split())
#: Words that name boilerplate, words that name an article, and words that say nothing by themselves.
BOILER_WORDS = frozenset("ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promos promoted nav navbar navigation menu menus header masthead footer sidebar aside banner cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe comment comments commentlist disqus reply replies respond share sharing social related recommended breadcrumb breadcrumbs pagination pager login signup search toolbar copyright complementary contentinfo".split())
ARTICLE_WORDS = frozenset("article post entry story content body main text".split())
GLUE_WORDS = frozenset("site page top bottom left right upper lower primary secondary global inner outer wrapper wrap container box block area section slot unit bar list item items row column col group panel widget widgets link links button buttons icon icons form title the of in for by".split())
#: Short blocks that say they are boilerplate, by the most words they have.
PHRASES = [
    (25, re.compile(r"(?:©|\(c\) ?\d{4}|copyright (?:©|\(c\)|\d{4}))|.*\ball rights reserved\b", re.IGNORECASE)),
    (12, re.compile(r"(?:posted|filed|tagged) (?:by|in|on|under|with)\b", re.IGNORECASE)),
    (12, re.compile(r"(?=.*(?:share|tweet|follow us|facebook|twitter|linkedin|whatsapp|reddit|pinterest))(?:(?:share|tweet|pin|print|email|like|follow|facebook|twitter|linkedin|whatsapp|reddit|pinterest|this|us|on|via|it)\b\W*+)++$", re.IGNORECASE)),
    (40, re.compile(r"(?:we (?:and our partners )?use|(?:this|our) (?:web)?site uses|by (?:continuing|using|browsing)\b|accept\b).*\bcookies\b", re.IGNORECASE)),
    (6, re.compile(r"(?:advertisements?|sponsored(?: content| by .*)?|skip to (?:main )?content|related (?:posts|articles|stories)|read (?:more|next)|you (?:may|might) also like)\W*$", re.IGNORECASE)),
]
#: Headings of reader comments, and the plain words that must stand before one.
COMMENTS = re.compile(r"(?:comments|reader comments|(?:\d+|no|one) (?:comments?|responses?|reply|replies)|(?:comments|responses|replies) ?\(\d+\)|\d+ thoughts? on .*|(?:leave|post|write|add) a (?:reply|comment)|join the (?:conversation|discussion))(?: to .*)?\W*$", re.IGNORECASE)
COMMENTS_WORDS, TEXT_BEFORE = 12, 10
NAME_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
TAG_NAME = re.compile(r"</?+([a-zA-Z][^\s/><]*+)")
#: The rest of a tag: quotes bind only after an equals sign.
TAG_REST = re.compile(r"""[^<>"'=]*+(?:(?:=\s*+(?:"[^"]*+"|'[^']*+')?+|["'])[^<>"'=]*+)*+""")
ATTRIBUTE = re.compile(r"""([^\s=/"'<>]++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>]*+)))?+""")
NAMING = re.compile(r"class|id|role", re.IGNORECASE)
FEATURES = ("words", "link_density", "words_before", "link_density_before", "words_after", "link_density_after", "boiler", "control", "named", "article", "heading", "still", "phrase", "comments")
DEPTH, LEAST = 10, 2


def name_says(name: str) -> tuple[bool, bool]:
    """(boilerplate, article) of one class, id or role: all its words must agree."""
    parts = {p.lower() for p in NAME_PARTS.findall(name)}
    if not parts <= BOILER_WORDS | ARTICLE_WORDS | GLUE_WORDS:
        return False, False
    boiler = parts & BOILER_WORDS
    own = bool(boiler) and not (boiler == {"header"} and parts & ARTICLE_WORDS)
    return own, not boiler and bool(parts & ARTICLE_WORDS)


def is_phrase(text: str, words: int) -> bool:
    return any(words <= most and pattern.match(text) for most, pattern in PHRASES)


def naming(attributes: str) -> tuple[bool, bool]:
    """(boilerplate, article) by the class, id and role among the attributes of a tag; short ones are remembered."""
    return _remembered(attributes) if len(attributes) <= 200 else _named(attributes)


def _named(attributes: str) -> tuple[bool, bool]:
    names = [n for a in ATTRIBUTE.finditer(attributes) if a[1].lower() in ("class", "id", "role") for n in (a[2] or a[3] or a[4] or "").split()]
    says = [name_says(n) for n in names]
    return any(s[0] for s in says), any(s[1] for s in says)


_remembered = lru_cache(10_000)(_named)


def tags(html: str) -> Iterator[tuple[str, str, bool, str]]:
    """(text before it, tag name, closing, attributes) of each tag; the last has no name."""
    at, size, last = 0, len(html), html.rfind(">")
    text_from = 0
    while True:
        at = html.find("<", at)
        if at < 0:
            break
        second = html[at + 1 : at + 2]
        if second in ("!", "?") or second == "/" and not html[at + 2 : at + 3].isalpha():
            comment = html.startswith("<!--", at)
            end = html.find("-->" if comment else ">", at + 4 if comment else at)
            yield html[text_from:at], "!", False, ""
            at = text_from = size if end < 0 else end + (3 if comment else 1)
            continue
        named = TAG_NAME.match(html, at)
        if not named:
            at += 1
            continue
        if at > last:
            yield html[text_from:at], "", False, ""
            return
        rest = TAG_REST.match(html, named.end())
        if rest.end() == size:
            yield html[text_from:at], "", False, ""
            return
        if html[rest.end()] == "<":
            at += 1
            continue
        name = named[1].lower()
        yield html[text_from:at], name, second == "/", rest[0]
        at = text_from = rest.end() + 1
        if name in RAW_TAGS and second != "/":
            end = re.compile(f"</{name}", re.IGNORECASE).search(html, at)
            at = text_from = end.start() if end else size
    yield html[text_from:], "", False, ""


def blocks(html: str) -> list[tuple]:
    """(text, words, linked words, boiler, control, named, article, entry, heading, phrase, comments) of every flat block."""
    out: list[tuple] = []
    open_: list[tuple] = []  # name, boiler, control, named, article, entry, hidden
    names: Counter = Counter()
    depth = [0] * 6
    text: list[str] = []
    links: list[str] = []
    in_link = heading = title = comments = False
    plain = 0

    def flush() -> None:
        nonlocal comments, plain
        if text:
            words = " ".join(unescape("".join(text)).split())
            if words:
                n, linked = words.count(" ") + 1, len("".join(links).split())
                if title:
                    comments = False
                elif n <= COMMENTS_WORDS and not linked and plain >= TEXT_BEFORE and COMMENTS.match(words):
                    comments = True
                if not heading:
                    plain += n - linked
                out.append((words, n, linked, *(d > 0 for d in depth[:5]), heading, is_phrase(words, n), comments))
            text.clear()
            links.clear()

    def pop() -> None:
        gone = open_.pop()
        names[gone[0]] -= 1
        if any(gone[1:]):
            flush()
        for k in range(6):
            depth[k] -= gone[k + 1]

    for before, name, closing, attributes in tags(html):
        if before and not depth[5]:
            text.append(before)
            if in_link:
                links.append(unescape(before))
        if name == "br":
            text.append(" ")
            links.append(" ")
        elif name == "a":
            in_link = not closing
            links.append(" ")
        elif name in BLOCK_TAGS or name in FORM_TAGS:
            flush()
            heading = not closing and name in HEADINGS
            title = not closing and name == "h1"
        if closing:
            if names[name]:
                while open_[-1][0] != name:
                    pop()
                pop()
            continue
        if open_ and (open_[-1][0] == "p" and name in BLOCK_TAGS or open_[-1][0] == name == "li"):
            pop()  # an open paragraph or list item ends where the next block starts
        if name in VOID_TAGS or name in INLINE_TAGS or not name or name == "!":
            continue
        boiler_name, article_name = naming(attributes) if NAMING.search(attributes) else (False, False)
        if name in LEAF_TAGS and not (boiler_name or article_name):
            continue
        if name == "body":
            while open_ and depth[5]:
                pop()
        container = name not in ("html", "body", "article", "main")
        mark = (
            name,
            name in BOILER_TAGS or name == "header" and not depth[3] and not depth[4],
            name in FORM_TAGS,
            container and boiler_name,
            name in ARTICLE_TAGS,
            container and article_name,
            name in HIDDEN_TAGS,
        )
        if any(mark[1:]):
            flush()
        open_.append(mark)
        names[name] += 1
        for k in range(6):
            depth[k] += mark[k + 1]
    flush()
    return out


def features(found: list[tuple]) -> np.ndarray:
    """A row of FEATURES for each block of one page.

    ``article`` is 1 inside article or main, -1 outside on a page that has one; on a
    page without, a half inside a container named as an article and else 0. ``still``
    counts the unlinked words of later blocks that nothing marks as boilerplate. What
    an article says is its text: phrases and headings of comments count outside only.
    """
    table = np.array([b[1:] for b in found], float)
    words, density = table[:, 0], table[:, 1] / table[:, 0]
    w, d = np.pad(words, 1), np.pad(density, 1)
    inside, entry = table[:, 5], table[:, 6]
    article = np.where(inside > 0, 1.0, -1.0) if inside.any() else entry / 2
    outside = (inside == 0) & inside.any()
    says = table[:, 8:10] * (inside == 0)[:, None]
    marked = table[:, 2:5].any(axis=1) | says.any(axis=1) | outside | (density > 0.5)
    plain = np.where(marked, 0, words - table[:, 1])
    still = plain[::-1].cumsum()[::-1] - plain
    return np.column_stack([words, density, w[:-2], d[:-2], w[2:], d[2:], table[:, 2:5], article, table[:, 7], still, says])


def without_tags(items: list[str]) -> list[str]:
    """The items of a labelled page as ``div`` elements would show them: footers without links keep a phrase."""
    return [re.sub("[ao]", "", item.replace("n", "" if "/" in item else "p")) for item in items]


def labelled(pages: str = PAGES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features, labels (true for main text) and page numbers of the labelled table; every other page with an article comes twice."""
    rows, labels, of_page = [], [], []
    for number, line in enumerate(pages.strip().split("\n")):
        items, bare = line.split(), []
        if number % 2 == 0 and any("a" in item for item in items):
            bare = [without_tags(items)]
        for page in [items, *bare]:
            found = [re.fullmatch(r"([mb])(\d+)(?:/(\d+))?([a-z]*)", item) for item in page]
            rows.append(features([("", int(m[2]), int(m[3] or 0), *(mark in m[4] for mark in "nfcaehpr")) for m in found]))
            labels += [m[1] == "m" for m in found]
            of_page += [number] * len(found)
    return np.vstack(rows), np.array(labels), np.array(of_page)


def train(rows: np.ndarray, labels: np.ndarray, depth: int = DEPTH, least: int = LEAST) -> tuple:
    """A binary tree of (feature, cut, left, right), with a truth value for a leaf, by Gini impurity.

    Both sides of a split keep ``least`` rows; of equal splits the first feature wins.
    """
    best = None
    if depth and labels.any() and not labels.all():
        for f in range(rows.shape[1]):
            values = np.unique(rows[:, f])
            for cut in (values[1:] + values[:-1]) / 2:
                left = rows[:, f] <= cut
                if min(left.sum(), (~left).sum()) < least:
                    continue
                p, q = labels[left].mean(), labels[~left].mean()
                cost = left.sum() * p * (1 - p) + (~left).sum() * q * (1 - q)
                if best is None or cost < best[0] - 1e-12:
                    best = cost, f, cut, left
    if best is None or best[0] >= len(labels) * labels.mean() * (1 - labels.mean()) - 1e-12:
        return (bool(labels.mean() >= 0.5),)
    _, f, cut, left = best
    low, high = train(rows[left], labels[left], depth - 1, least), train(rows[~left], labels[~left], depth - 1, least)
    return low if low == high else (f, float(cut), low, high)


def judge(tree: tuple, rows: np.ndarray) -> np.ndarray:
    if len(tree) == 1:
        return np.full(len(rows), tree[0])
    f, cut, left, right = tree
    low = rows[:, f] <= cut
    out = np.empty(len(rows), bool)
    out[low], out[~low] = judge(left, rows[low]), judge(right, rows[~low])
    return out


@lru_cache
def trained() -> tuple:
    return train(*labelled()[:2])


def main_texts(htmls: list[str | None], tree: tuple) -> list[str]:
    """The main text of each page; all their blocks are judged at once."""
    found = [blocks(h or "") for h in htmls]
    rows = [features(page) for page in found if page]
    keep = iter(judge(tree, np.vstack(rows)).tolist() if rows else [])
    return ["\n".join([b[0] for b in page if next(keep)]) for page in found]


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every row."""
    tree = trained()
    small_batches(pages.sparkSession)

    @F.pandas_udf("string")
    def text_of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for htmls in batches:
            yield pd.Series(main_texts(htmls.tolist(), tree), dtype=object)

    out = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", text_of(F.col("html").cast("string")).alias("text"))
    return out.withColumn("n_chars", F.length("text").cast("long"))
