"""Main text of web pages: flat text blocks classified by a decision tree.

A page is cut at block-level tags. Each block is described by its number of words, its share of
words inside links, the same two figures of the block before and after it, and its place (inside a
container that is never text, outside of the page's article, inside of it, or a page without one).
A decision tree grown from the small labelled table below says which blocks are text.
"""

from __future__ import annotations

import re
from collections import Counter
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugewise.llm.common import ROWS_AT_ONCE

#: Places of a block.
NEVER_TEXT, OUTSIDE, NO_ARTICLE, INSIDE = -2, -1, 0, 1

FIELDS = "words_before words words_after links_before links links_after place".split()

#: Labelled blocks: words before, words, words after, link share before, own, after, place, is text.
LABELLED = """
  0   3   4  0.0 1.0 1.0 -2 0
  4   6   9  1.0 1.0 0.0 -2 0
  6   9   8  1.0 0.0 0.0 -2 0
  6  40  10  1.0 0.0 0.0 -2 0
 80   9   0  0.0 0.0 0.0 -2 0
120  14   0  0.0 0.2 0.0 -2 0
 60  30  45  0.0 0.0 0.0 -2 0
 60  90  45  0.0 0.0 0.0 -2 0
  5   1  30  0.0 0.0 0.0 -2 0
300  22  18  0.0 0.0 0.0 -2 0
  2 200   9  0.0 0.1 0.0 -2 0
  8  10  40  0.0 0.0 0.0  1 1
  9   2   9  0.0 0.0 0.0  1 1
  8   9  70  0.0 0.0 0.0  1 1
 10  75  60  0.0 0.0 0.0  1 1
 70   5  80  0.0 0.0 0.0  1 1
 60   1   9  0.0 0.0 0.0  1 1
 90  40   9  0.0 0.3 0.0  1 1
 30  12   7  0.1 0.4 1.0  1 1
  4   3   4  0.0 0.0 0.0  1 1
  1   1   1  0.0 0.0 0.0  1 1
  0   1   0  0.0 0.0 0.0  1 1
  0 300   0  0.0 0.0 0.0  1 1
 90  20  30  0.0 0.5 0.0  1 1
 60   4   3  0.0 1.0 1.0  1 0
  4   5   4  1.0 1.0 1.0  1 0
 90   2   0  0.0 1.0 0.0  1 0
 40  12  10  0.0 0.9 1.0  1 0
  5  20  40  1.0 0.8 0.0  1 0
  6   8  10  1.0 0.0 0.0 -1 0
  8  14  60  0.0 0.0 0.0 -1 0
 90   9   0  0.0 0.0 0.0 -1 0
 70  25   6  0.0 0.0 0.0 -1 0
 50  60   9  0.0 0.0 0.0 -1 0
  4   5   6  1.0 1.0 1.0 -1 0
 30 120   9  0.0 0.1 0.0 -1 0
  0   3   4  0.0 1.0 1.0  0 0
  3   4   3  1.0 1.0 1.0  0 0
  4   5  60  1.0 1.0 0.0  0 0
  9  30   8  1.0 0.8 1.0  0 0
  4   6   5  1.0 0.0 1.0  0 0
  5   3   0  1.0 0.0 0.0  0 0
  3   4   4  0.0 0.0 0.0  0 0
  6   9   0  0.0 0.0 0.0  0 0
  9   6   4  0.0 0.5 0.5  0 0
 90   7   0  0.0 0.0 0.0  0 0
 80   9   4  0.0 0.0 1.0  0 0
 70   6   5  0.0 0.4 0.4  0 0
 50  11   8  0.0 0.6 0.2  0 0
  3   9  60  1.0 0.0 0.0  0 1
  4   7  35  0.5 0.0 0.0  0 1
  8  40  50  0.0 0.0 0.0  0 1
  9  60   3  0.0 0.0 1.0  0 1
 60  80  70  0.0 0.1 0.0  0 1
 70   6  80  0.0 0.0 0.0  0 1
 45   3  60  0.0 0.0 0.0  0 1
 80  25   6  0.0 0.0 0.0  0 1
  0   1   1  0.0 0.0 1.0  0 0
  0   1   2  0.0 0.0 1.0  0 0
  0   2  12  0.0 0.0 1.0  0 0
  2   1   2  1.0 0.0 1.0  0 0
  1   1   1  1.0 0.0 1.0  0 0
  2   3   1  1.0 0.0 0.0  0 0
  5   9   6  1.0 0.0 0.0  0 0
 60   8  40  0.0 1.0 0.0  0 0
 70   4  80  0.0 1.0 0.0  0 0
  9  60  70  0.0 0.9 0.0  0 0
 40   9  50  0.0 0.8 0.0  1 0
 60   6  70  0.0 1.0 0.0  1 0
  9   5  60  0.0 1.0 0.0  1 0
  0   4  50  0.0 1.0 0.0  1 0
 80   9  80  0.0 0.7 0.0  1 0
 12   9   8  0.0 0.0 0.0  0 1
  0   1  30  0.0 0.0 0.0  0 1
  0  60   0  0.0 0.0 0.0  0 1
  0  20   0  0.0 0.0 0.0  0 1
  5  30   5  1.0 0.1 1.0  0 1
 40  22  30  0.0 0.3 0.0  0 1
"""

#: Tags inside a block; every other tag ends it.
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp "
    "small span strike strong sub sup time tt u var wbr".split()
)
_EMPTY = frozenset("hr input meta link col base source embed param area track".split())
#: Elements that the next one of their kind ends.
_ENDED_BY_NEXT = frozenset("li dt dd tr td th option".split())
#: Elements whose content is no markup and no text.
_RAW = frozenset("script style title noscript template iframe noembed noframes textarea xmp object svg math".split())
_NEVER_TEXT_TAGS = frozenset("nav header footer aside form menu dialog button select fieldset head".split())
_ARTICLE_TAGS = frozenset("article main".split())
#: Words in class, id or role of a container that is never text.
_NEVER_TEXT_NAMES = frozenset(
    "nav navbar navigation menu menubar breadcrumb breadcrumbs header masthead footer contentinfo complementary "
    "sidebar aside ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner "
    "cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription share "
    "sharing social related recommended comment comments commentlist disqus reply replies respond reactions "
    "login signin signup register search form widget copyright legal pagination pager skip toolbar".split()
)
_ARTICLE_NAMES = frozenset("article main post entry story articlebody".split())
#: Words that make a compound name tell of a state of the page ("no-sidebar", "comments-open"), not of the container.
_STATE_WORDS = frozenset("no not without with has have is are open closed on off enabled disabled left right both full one two".split())
#: What readers write, also in article tags.
_READER_NAMES = frozenset("comment comments commentlist reply replies disqus respond".split())

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|"
    r"""<(/?)([a-zA-Z][^\s/<>]*+)((?:[^<>"']++|"[^"<]*+"|'[^'<]*+'|["'])*+)>""",
    re.S,
)
_NAMES = re.compile(r"""\b(?:class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_CLOSE = {name: re.compile(rf"</{name}\b[^>]*>", re.I) for name in _RAW}


def _standing(tag: str, attributes: str) -> int:
    """-1 for a container that is never text, 1 for one that holds the article, else 0."""
    if tag in _NEVER_TEXT_TAGS:
        return -1
    if tag in ("html", "body"):
        return 0
    never = article = False
    whole: set[str] = set()
    for name in _names(attributes):
        parts = set(re.split(r"[^a-z]+", name)) - {""}
        if parts == {name}:
            whole.add(name)
        elif not parts & _STATE_WORDS:
            never |= bool(parts & _NEVER_TEXT_NAMES)
            article |= bool(parts & _ARTICLE_NAMES)
    told = bool(whole & _ARTICLE_NAMES)
    if whole & _NEVER_TEXT_NAMES:
        # only an article that is named as one outweighs a name of its own that is never text
        return 1 if tag in _ARTICLE_TAGS and told and not whole & _READER_NAMES else -1
    if tag in _ARTICLE_TAGS or told:
        return 1
    return -1 if never else int(article)


def _names(attributes: str) -> list[str]:
    if "=" not in attributes:
        return []
    return [name for found in _NAMES.findall(attributes) for name in "".join(found).lower().split()]


def blocks(html: str) -> list[tuple[str, int, float, int]]:
    """Text blocks in page order: text, words, share of words in links, standing of its containers."""
    out: list[tuple[str, int, float, int]] = []
    stack: list[tuple[str, int]] = []
    opened: Counter[str] = Counter()  # tags in the stack
    never = article = 0
    parts: list[str] = []
    linked: list[str] = []
    in_link = False

    def end() -> None:
        nonlocal parts, linked
        if parts:
            words = "".join(parts).split()
            if words:
                in_links = len("".join(linked).split()) if linked else 0
                share = min(1.0, in_links / len(words))
                out.append((" ".join(words), len(words), share, -1 if never else 1 if article else 0))
            parts, linked = [], []

    def add(raw: str) -> None:
        if raw:
            text = unescape(raw) if "&" in raw else raw
            parts.append(text)
            if in_link:
                linked.append(text)

    def leave(depth: int) -> None:
        nonlocal never, article
        for name, standing in stack[depth:]:
            opened[name] -= 1
            never -= standing < 0
            article -= standing > 0
        del stack[depth:]

    def enter(name: str, standing: int) -> None:
        nonlocal never, article
        stack.append((name, standing))
        opened[name] += 1
        never += standing < 0
        article += standing > 0

    at, size = 0, len(html)
    while at < size:
        found = _TAG.search(html, at)
        if found is None:
            add(html[at:])
            break
        add(html[at : found.start()])
        at = found.end()
        tag = found[2]
        if tag is None:
            continue
        tag, closing = tag.lower(), bool(found[1])
        if tag in _RAW:
            if not closing and not found[3].endswith("/"):
                shut = _CLOSE[tag].search(html, at)
                at = shut.end() if shut else size
            if tag not in ("svg", "math"):
                end()
        elif tag == "a":
            in_link = not closing
            if linked:
                linked.append(" ")
        elif tag == "br":
            parts.append("\n")
        elif tag in _INLINE:
            if not closing and _standing(tag, found[3]) < 0:
                end()
                enter(tag, -1)
            elif closing and stack and stack[-1][0] == tag:
                end()
                leave(len(stack) - 1)
        else:
            end()
            if not closing:
                if tag in _EMPTY:
                    continue
                if stack and (stack[-1][0] == "p" or stack[-1][0] == tag in _ENDED_BY_NEXT):
                    leave(len(stack) - 1)
                enter(tag, _standing(tag, found[3]))
            else:
                in_link = False
                if opened[tag]:  # what the search passes is left, so no tag is passed twice
                    leave(next(k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == tag))
    end()
    return out


def features(found: list[tuple[str, int, float, int]]) -> np.ndarray:
    """A row of FIELDS for each block."""
    n = len(found)
    words = np.array([0, *(b[1] for b in found), 0], float)
    links = np.array([0, *(b[2] for b in found), 0], float)
    standing = np.array([b[3] for b in found])
    place = np.where(standing < 0, NEVER_TEXT, np.where(standing > 0, INSIDE, OUTSIDE if (standing > 0).any() else NO_ARTICLE))
    return np.column_stack([words[:n], words[1:-1], words[2:], links[:n], links[1:-1], links[2:], place])


def labelled_table(text: str = LABELLED) -> tuple[np.ndarray, np.ndarray]:
    rows = np.array([[float(x) for x in line.split()] for line in text.strip().splitlines()])
    return rows[:, :-1], rows[:, -1].astype(int)


def grow_tree(rows: np.ndarray, labels: np.ndarray, depth: int = 8):
    """Decision tree by Gini impurity: (field, threshold, tree below it, tree above it), or a label."""
    ones = int(labels.sum())
    if depth == 0 or ones in (0, len(labels)):
        return int(2 * ones >= len(labels))
    best = None
    for field in range(rows.shape[1]):
        values = np.unique(rows[:, field])
        for threshold in (values[1:] + values[:-1]) / 2:
            low = rows[:, field] < threshold
            impurity = sum(len(y) * y.mean() * (1 - y.mean()) for y in (labels[low], labels[~low]))
            if best is None or impurity < best[0] - 1e-12:
                best = (impurity, field, float(threshold), low)
    if best is None:
        return int(2 * ones >= len(labels))
    _, field, threshold, low = best
    return field, threshold, grow_tree(rows[low], labels[low], depth - 1), grow_tree(rows[~low], labels[~low], depth - 1)


def classify(tree, rows: np.ndarray) -> np.ndarray:
    if not isinstance(tree, tuple):
        return np.full(len(rows), bool(tree))
    field, threshold, below, above = tree
    low = rows[:, field] < threshold
    out = np.empty(len(rows), bool)
    out[low] = classify(below, rows[low])
    out[~low] = classify(above, rows[~low])
    return out


def main_text(html: str, tree) -> str:
    found = blocks(html)
    if not found:
        return ""
    return " ".join(block[0] for block, kept in zip(found, classify(tree, features(found))) if kept)


def extract(pages: DataFrame, html: str = "html", keep: tuple[str, ...] = ("page_id", "url"), table: str = LABELLED):
    """The columns ``keep``, ``text`` and ``n_chars`` (code points) of every page.

    A null or empty page, or one without text, has the empty text. Pages of any length are read
    whole. Rows keep their multiplicity; other columns are left out, so their names cannot clash.
    """
    tree = grow_tree(*labelled_table(table))
    source = pages.select(F.col(html).cast("string").alias("html"), *keep)
    schema = source.select(*keep).schema.add("text", "string").add("n_chars", "long")

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(start, ROWS_AT_ONCE)
                texts = [main_text(value or "", tree) for value in part.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[1:], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                    names=[*keep, "text", "n_chars"],
                )

    return source.mapInArrow(run, schema)
