"""Main text of web pages: flat text blocks, classified by a decision tree.

A page is read once, from front to end, as a flat list of text blocks. Each block
has its word count and link density, those of its neighbours, whether it is a
heading or paragraph, and what the elements around it say. A small decision tree,
grown on the labelled pages of ``op8_pages``, keeps or drops each block.

Class names are a hint only. They never count against the article itself, nor against
an element that holds what text there is: what stands beside it is weighed first.

Time is linear in the length of a page: the scanner never goes back, and a closing
mark that is not found once is not searched for again.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tidegauge.llm.columns import column
from tidegauge.llm.op8_pages import PAGES
from tidegauge.session import ship, table

# Element names, and name hints.
#: Held text is never shown, or is no text.
RAW = frozenset("script style iframe noembed noframes textarea title xmp".split())
SKIP = frozenset("noscript template svg math object select button datalist audio video canvas".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements whose end is tracked; others only separate blocks.
CONTAINER = frozenset("article aside blockquote center dialog div details dl fieldset figure footer form header main menu nav ol section table ul".split())
CHROME = frozenset("nav footer aside form menu dialog header".split())
CONTENT = frozenset("article main".split())
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
HINTS = frozenset(
    "ad ads advert advertisement adverts advertising banner breadcrumb breadcrumbs byline comment comments consent cookie cookies copyright disqus footer gdpr header "
    "login menu modal nav navbar navigation newsletter notice notification overlay pagination pager popup promo promoted promotion related reply replies respond "
    "share sharing sidebar signup social sponsor sponsored subscribe subscription tags toolbar widget".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog menu menubar toolbar".split())
#: Of HINTS, those of reader comments, which alone may be longer than the article.
COMMENTS = frozenset("comment comments disqus reply replies respond".split())
#: What a class says of the page as a whole, not of what it holds.
STATES = ("has-", "no-", "with-", "is-", "without-")
#: Words beside a hint that leave it as it is; with others it may name something else (share-story).
NEUTRAL = frozenset(
    "a area articles bar bottom box button buttons blocks body block container content feed footer form global group icons inner item items left link links list "
    "main message outer panel posts primary right row secondary section site stories text title top unit wrap wrapper zone".split()
)

FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "heading", "paragraph", "content", "chrome", "alone", "rest")
#: Words of a block that counts as running text, and of a text that a plain hint cannot hide.
RUNNING, LONG = 15, 40
#: Kinds of hints: none, a name among other words, a plain name; and reader comments.
NONE, VAGUE, PLAIN = 0, 1, 2


class Tree:
    """A binary decision tree by Gini impurity."""

    def __init__(self, x: np.ndarray, y: np.ndarray, depth: int = 10, least: int = 2) -> None:
        self.share = float(y.mean()) if len(y) else 0.0
        self.feature: int | None = None
        if depth and len(y) > 1 and 0 < self.share < 1:
            found = ((self._impurity(x[:, f], y, c, least), f, c) for f in range(x.shape[1]) for c in self._cuts(x[:, f]))
            best = min(found, default=(np.inf, 0, 0.0))
            if best[0] < np.inf:
                _, self.feature, self.cut = best
                low = x[:, self.feature] <= self.cut
                self.low, self.high = Tree(x[low], y[low], depth - 1, least), Tree(x[~low], y[~low], depth - 1, least)

    @staticmethod
    def _cuts(values: np.ndarray) -> np.ndarray:
        known = np.unique(values)
        return (known[1:] + known[:-1]) / 2

    @staticmethod
    def _impurity(values: np.ndarray, y: np.ndarray, cut: float, least: int) -> float:
        sides = y[values <= cut], y[values > cut]
        return float(sum(len(s) * s.mean() * (1 - s.mean()) for s in sides)) if min(map(len, sides)) >= least else np.inf

    def predict(self, x: np.ndarray) -> np.ndarray:
        if self.feature is None:
            return np.full(len(x), self.share > 0.5)
        low = x[:, self.feature] <= self.cut
        out = np.empty(len(x), bool)
        out[low], out[~low] = self.low.predict(x[low]), self.high.predict(x[~low])
        return out

    def asked(self) -> set[str]:
        """The features that the tree looks at."""
        return set() if self.feature is None else {FEATURES[self.feature]} | self.low.asked() | self.high.asked()


_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+)>")
_NAMES = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
_HIDDEN = re.compile(r"\shidden(?=[\s/=]|\Z)|display\s*:\s*none", re.I)
_ENDS = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in RAW | SKIP}


def _hinted(attributes: str, inside: bool) -> tuple[bool, bool, int, bool]:
    """What an element's names say: main text, something else by its role, a kind of hint, comments."""
    content = role = comments = False
    hint = NONE
    for kind, value in _NAMES.findall(attributes):
        for name in value.strip("\"'").lower().split():
            if kind.lower() == "role":
                content, role = content or name in CONTENT, role or name in ROLES
            elif not name.startswith(STATES):
                words = {w for w in re.split(r"[^a-z0-9]+", name) if w}
                if found := (words & HINTS) - ({"header"} if inside else set()):
                    hint = max(hint, VAGUE if words - HINTS - NEUTRAL else PLAIN)
                    comments |= bool(found & COMMENTS)
    return content, role, hint, comments


class _Elements:
    """The elements of a page that say something of what they hold, in the order they open."""

    def __init__(self) -> None:
        self.parent, self.content, self.chrome, self.hint, self.comments, self.within = [-1], [False], [False], [NONE], [False], [False]
        self.words, self.running = [0], [0]
        self.rest = 0

    def open(self, parent: int, content: bool, chrome: bool, hint: int, comments: bool, words: int, running: int) -> int:
        self.parent.append(parent)
        self.content.append(content)
        self.chrome.append(chrome or hint > NONE)
        self.hint.append(NONE if chrome else hint)
        self.comments.append(comments)
        self.within.append(content or self.within[parent])
        self.words.append(-words)
        self.running.append(-running)
        return len(self.parent) - 1

    def close(self, at: int, words: int, running: int) -> None:
        self.words[at] += words
        self.running[at] += running

    def _anchor(self, words: int) -> int:
        """The article: the largest element of main text; of others' names its own does not count against it."""
        n = len(self.parent)
        inside = [False] * n
        for e in range(1, n):
            up = self.parent[e]
            inside[e] = inside[up] or (self.chrome[up] and up > 0)
        outside = words - sum(self.words[e] for e in range(1, n) if self.chrome[e] and not self.content[e] and not inside[e])
        articles = [e for e in range(1, n) if self.content[e]]
        size = lambda e: self.words[e] * (1 if self.hint[e] == NONE else 0.25 if self.comments[e] else 0.5)
        found = max((e for e in articles if not inside[e]), key=lambda e: (size(e), -e), default=0)
        if not found:  # an article in a form or the like counts if it is most of the page
            found = max((e for e in articles if self.words[e] > outside), key=lambda e: (size(e), -e), default=0)
        return found

    def settle(self, words: int) -> None:
        """Frees the article and what holds most of the text from their names, then gives children what their parents say."""
        n = len(self.parent)
        children: list[list[int]] = [[] for _ in range(n)]
        for e in range(1, n):
            children[self.parent[e]].append(e)
        anchor = self._anchor(words)
        around = anchor
        while around > 0:
            self.chrome[around] = False
            around = self.parent[around]
        scope, size = anchor, self.words[anchor] if anchor else words
        while True:
            top, todo = [], list(children[scope])
            while todo:
                e = todo.pop()
                if self.chrome[e]:
                    top.append(e)
                else:
                    todo += children[e]
            self.rest = size - sum(self.words[e] for e in top)
            free = [e for e in top if self._speaks(e, size, self.rest, anchor > 0)]
            if not free:
                break
            for e in free:
                self.chrome[e] = False
            if len(free) == 1 and 2 * self.words[free[0]] > size:  # goes on in what holds the text
                scope, size = free[0], self.words[free[0]]
        for e in range(1, n):
            self.content[e] |= self.content[self.parent[e]]
            self.chrome[e] |= self.chrome[self.parent[e]]

    def _speaks(self, e: int, size: int, rest: int, within: bool) -> bool:
        """Whether an element's text outweighs its name: nothing much stands beside it, or the name is vague."""
        words, hint = self.words[e], self.hint[e]
        if hint == NONE or words < (RUNNING if within or hint == VAGUE else LONG):
            return False
        if self.comments[e]:
            return rest < 5
        return rest < RUNNING or 8 * rest < words or (hint == VAGUE and words >= LONG and 4 * words >= size)


class _Reader:
    """One pass over a page: blocks as (text, words, linked words, heading, paragraph, element, kind of hint or hidden)."""

    def __init__(self, page: str) -> None:
        self.page, self.elements, self.found = page, _Elements(), []
        self.stack: list[tuple[str, int, int]] = []  # name, element or 0, whether it hides what it holds
        self.open_names: Counter = Counter()
        self.pieces: list[str] = []
        self.linked = self.words = self.running = self.hiding = self.top = 0
        self.link = self.link_text = self.heading = self.paragraph = False
        self.hinted = NONE
        self.ends: dict[str, int] = {}

    def add(self, raw: str) -> None:
        if not self.hiding:
            text = html.unescape(raw) if "&" in raw else raw
            self.pieces.append(text)
            if self.link:
                n = len(text.split())
                self.linked += n
                self.link_text |= n > 0

    def close_block(self) -> None:
        words = "".join(self.pieces).split()
        if words:
            n, linked = len(words), min(self.linked, len(words))
            named = self.hinted == PLAIN or (self.hinted == VAGUE and n - linked < LONG)
            self.found.append((" ".join(words), n, linked, self.heading, self.paragraph, self.top, named))
            self.words += n - linked
            self.running += n - linked >= RUNNING
        self.pieces.clear()
        self.linked = 0
        if self.link_text:  # an anchor around whole blocks goes on, one that lacks its end does not
            self.link = self.link_text = False

    def pop(self) -> str:
        name, element, hides = self.stack.pop()
        self.open_names[name] -= 1
        self.hiding -= hides
        if element:
            self.elements.close(element, self.words, self.running)
            self.top = self.elements.parent[element]
        return name

    def push(self, name: str, element: int, hides: int) -> None:
        self.stack.append((name, element, hides))
        self.open_names[name] += 1
        self.hiding += hides

    def pop_to(self, name: str) -> None:
        if self.open_names[name]:
            while self.pop() != name:
                pass

    def end_of(self, name: str, at: int) -> int:
        """Where the next closing mark of a name begins, or -1; no part of a page is searched twice."""
        if 0 <= (known := self.ends.get(name, 0)) < at or name not in self.ends:
            mark = _ENDS[name].search(self.page, at)
            self.ends[name] = known = mark.start() if mark else -1
        return known

    def read(self) -> None:
        page, at = self.page, 0
        while at < len(page):
            lt = page.find("<", at)
            if lt < 0:
                self.add(page[at:])
                break
            if lt > at:
                self.add(page[at:lt])
            first, second = page[lt + 1 : lt + 2], page[lt + 2 : lt + 3]
            if page.startswith("<!--", lt):
                end = page.find("-->", lt + 2)
                at = end + 3
            elif first in ("!", "?") or (first == "/" and not (second.isascii() and second.isalpha())):
                end = page.find(">", lt + 1)
                at = end + 1
            elif first == "/" or (first.isascii() and first.isalpha()):
                token = _TAG.match(page, lt)
                end = token.end() if token else -1
                at = self.tag(token[2].lower(), token[1] == "/", token[3], end) if token else 0
            else:
                self.add("<")
                at = end = lt + 1
            if end < 0 or at < 0:  # a comment, tag or script that the page does not end
                break
        self.close_block()
        while self.stack:
            self.pop()

    def tag(self, name: str, ending: bool, attributes: str, at: int) -> int:
        """Takes a tag in; gives where to read on, or -1 for nowhere."""
        closed = attributes.endswith("/")
        if name in RAW:
            end = -1 if ending else self.end_of(name, at)
            return end if end >= 0 else -1 if name in ("script", "style") and not ending else at
        if name == "a":
            self.link, self.link_text = not ending and "href" in attributes.lower(), False
        elif name == "br":
            self.add(" ")
        elif name in SKIP:
            if ending:
                self.pop_to(name)
            elif not closed and self.end_of(name, at) >= 0:
                self.push(name, 0, 1)
        elif name in BLOCK:
            while self.stack and self.stack[-1][0] in ("button", "select") and not ending:
                self.pop()  # they hold no blocks: their end is missing
            self.close_block()
            self.heading = not ending and name in HEADING
            self.paragraph = not ending and name in ("p", "pre", "blockquote", "dd")
            self.hinted = NONE
            if ending:
                if name in CONTAINER:
                    self.pop_to(name)
            elif name not in ("body", "html"):
                self.block(name, attributes, closed)
        return at

    def block(self, name: str, attributes: str, closed: bool) -> None:
        within = self.elements.within[self.top]
        content, chrome, hint, comments = _hinted(attributes, within) if attributes else (False, False, NONE, False)
        hidden = bool(attributes) and bool(_HIDDEN.search(attributes))
        if name not in CONTAINER:
            self.hinted = PLAIN if hidden or chrome else hint
        elif not closed:
            content = content or name in CONTENT
            chrome |= name in CHROME and name != "form" and not (name == "header" and within)
            if name == "form" and not chrome:
                hint = PLAIN
            element = 0
            if content or chrome or hint:
                element = self.top = self.elements.open(self.top, content, chrome, hint, comments, self.words, self.running)
            self.push(name, element, int(hidden))


def blocks(page: str) -> list[tuple[str, np.ndarray]]:
    """The text blocks of a page in order: (text, [words, link density, heading, paragraph, content, chrome, alone, rest]).

    alone: whether the page has no article; rest: its words outside links and what is chrome.
    """
    reader = _Reader(page)
    reader.read()
    e = reader.elements
    e.settle(reader.words)
    alone = not any(e.content)
    return [
        (text, np.array([n, linked / n, head, paragraph, e.content[k], e.chrome[k] or named, alone, e.rest], np.float64))
        for text, n, linked, head, paragraph, k, named in reader.found
    ]


def with_neighbours(own: np.ndarray) -> np.ndarray:
    """The rows of FEATURES of a page's blocks; what stands before the first and after the last is 0."""
    none = np.zeros((1, 2))
    before, after = np.vstack([none, own[:-1, :2]]), np.vstack([own[1:, :2], none])
    return np.hstack([own[:, :2], before, after, own[:, 2:]])


def main_text(page: str | None, tree: Tree) -> str:
    """The kept blocks of a page, one a line."""
    found = blocks(page) if page else []
    if not found:
        return ""
    keep = tree.predict(with_neighbours(np.stack([f for _, f in found])))
    return "\n".join(text for (text, _), ok in zip(found, keep.tolist(), strict=True) if ok)


def _filled(page: str) -> str:
    """A labelled page with its counts written out as words."""
    return re.sub(r"\{(a?)(\d+)\}", lambda m: ("<a href=/>{}</a>" if m[1] else "{}").format(" ".join(["word"] * int(m[2]))), page)


def labelled() -> tuple[np.ndarray, np.ndarray]:
    """The labelled table: features of every block of PAGES, and whether it is main text."""
    x, y = [], []
    for page in PAGES:
        found = blocks(_filled(page))
        x.append(with_neighbours(np.stack([f for _, f in found])))
        y += [text.startswith("\u00b6") for text, _ in found]
    return np.vstack(x), np.array(y, np.float64)


def grown() -> Tree:
    return Tree(*labelled())


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", body: str = "html") -> DataFrame:
    """Rows (page_id, url, text, n_chars), one per input row.

    Null and empty pages, and pages without main text, give an empty text. Pages
    cut short are read up to an unfinished tag, comment or script; other elements
    without an end hide nothing, and time stays linear in the length of a page.
    Repeated rows come back repeated, an empty table gives no rows, null ids and
    URLs stay null. Other columns are left out.
    """
    ship(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = grown()
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts = [main_text(p, tree) for p in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"]
                )

    rows = pages.select(column(page_id).cast("long").alias("page_id"), column(url).cast("string").alias("url"), column(body).cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of all pages."""
    return extract(table(spark, sf_dir, "pages"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op8_html": op8_html}


#: For pages as the driver's tables have them: one article element of headings and paragraphs.
ORACLE_SQL = {
    "op8_html": r"""
WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '<article>(.*?)(</article>|$)', 1, 's') AS body FROM pages),
b AS (SELECT page_id, url, regexp_split_to_array(regexp_replace(replace(body, '<br>', ' '), '</?b>', '', 'g'), '</?p>|</?h1>') AS parts FROM a),
c AS (SELECT page_id, url, list_filter(list_transform(parts, lambda x: trim(regexp_replace(replace(replace(replace(x, '&quot;', '"'), '&amp;', '&'), '&amp', '&'), '\s+', ' ', 'g'))), lambda x: x <> '') AS kept FROM b)
SELECT page_id, url, coalesce(array_to_string(kept, chr(10)), '') AS text, CAST(length(coalesce(array_to_string(kept, chr(10)), '')) AS BIGINT) AS n_chars FROM c"""
}
