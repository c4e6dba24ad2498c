"""Main text of web pages from parser events and text-to-tag ratios.

The standard library's streaming parser reports tags and text; blocks of text come out as lines, each with the tags that
were met in it, how much of it is link text, and the container it stands in. Each line's ratio of text outside links to tags
is smoothed with a Gaussian and compared with a threshold; lines above it vote, with their text, for the container they
stand in. Content regions are chosen by these votes:

- where the page has article or main elements, the outermost ones, all that hold lines above the threshold and a fair share
  of the votes of the best; of a main around one article, the article, what stands in the main directly, and the boxes beside
  the article that hold as much;
- on other pages the container with most votes, and containers beside it whose lines are above the threshold; if that is
  the body, without the lines below the threshold at both ends.

All lines of a region are kept, short ones too.

Elements that never hold article text (menus, scripts, ...) are left out while parsing. Class, id and role are read as names
of one or more words: a name made of nothing but marks (an advert, a notice, comments, ...) and words for boxes leaves its
element out, as a form does, unless the article or, on a page without one, most of the text stands inside. A mark beside
other words is a hint only: it halves the ratio of its lines, and its element goes if none of them is above the threshold and
all are links for the most part.

Results in edge cases: null and empty pages, and pages without text outside the left-out elements, give an empty text;
markup that is cut off or not closed is read as far as it goes; repeated pages are extracted each.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chainspan.llm.common import rows_of, with_python

LEFT_OUT = frozenset(
    "head script style noscript template nav footer aside button select textarea input iframe svg canvas object dialog menu".split()
)
#: Left out like marked elements: unless the article stands inside.
MARKED_TAGS = frozenset(["form"])
#: Words in a class, id or role that mark an element as something other than the article.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent notice notices alert popup modal overlay "
    "nav navbar navigation menu breadcrumb breadcrumbs sidebar footer masthead toolbar pagination pager comment comments reply replies disqus respond "
    "share sharing social subscribe subscription newsletter signup login search widget related recommended recommendations complementary contentinfo".split()
)
#: Words for boxes and places, which beside a mark leave it one.
BOXES = frozenset(
    "box boxes list bar wrapper wrap container area block section link links button buttons slot unit left right top bottom site page global main post posts "
    "article articles stories item items inner outer form header head title text body content row col column group panel icon icons tools thread "
    "message the us all new latest".split()
)
#: The share of the best region's votes that another needs, and of a line's text that makes a list of links.
FAIR_SHARE, LINKED = 0.2, 0.5
BLOCKS = frozenset(
    "html body main article section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr blockquote pre figure figcaption address hr header "
    "hgroup details summary fieldset center title caption".split()
)
CONTAINERS = frozenset("body main article section div".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
SIGMA = 1.0


class Line(NamedTuple):
    text: str
    tags: int
    at: int
    linked: int
    heading: bool


class Lines(HTMLParser):
    """Collects lines: text, tags, container, characters in links, and whether it is a heading. A container is a number; ``kinds`` has the tag of each, ``parents`` the one around."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[Line] = []
        self.kinds, self.parents = ["body"], [-1]
        #: Containers that are left out unless the article stands in them.
        self.marked: set[int] = set()
        #: Containers whose names hold a mark among other words.
        self.hinted: set[int] = set()
        self.links = 0  # open links
        self.linked = 0  # characters of the line inside links
        self.marks: list[int] = []  # where in ``open`` marked elements begin
        self.open: list[tuple[str, int]] = []
        self.skipped = 0
        self.text: list[str] = []
        self.tags = 0
        self.at = 0

    def flush(self) -> None:
        text = " ".join("".join(self.text).split())
        if text:
            self.lines.append(Line(text, self.tags, self.at, min(self.linked, len(text)), any(t in HEADINGS for t, _ in self.open[-3:])))
            self.tags = 0
        self.text.clear()
        self.linked = 0

    def left_out(self, tag: str, attrs: list[tuple[str, str | None]]) -> tuple[bool, bool, bool]:
        """Whether an element is left out whatever it holds, whether it is unless it holds the article, and whether it is hinted at."""
        if tag in LEFT_OUT:
            return True, False, False
        if tag == "header":
            return not any(t in ("article", "main") for t, _ in self.open), False, False
        if tag in ("html", "body", "main", "article"):
            return False, False, False
        named, hidden = [], False
        for k, v in attrs:
            hidden = hidden or k == "hidden" or (k == "style" and "display:none" in (v or "").replace(" ", "").lower())
            if v and k in ("class", "id", "role"):
                named += [set(re.findall("[a-z]+", w)) for w in v.lower().split()]
        marked = [w for w in named if not MARKS.isdisjoint(w)]
        if hidden or tag in MARKED_TAGS or any(w <= MARKS | BOXES for w in marked):
            return hidden, not hidden, False
        if tag in ("div", "section") and any("header" in w for w in named) and not any(t in ("article", "main") for t, _ in self.open):
            return False, True, False
        return False, False, bool(marked)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.tags += 1
        if tag in VOID:
            if tag == "hr" and not self.skipped:
                self.flush()
            elif tag == "br" or tag == "wbr":
                self.text.append(" ")
            return
        if tag in BLOCKS and not self.skipped:
            self.flush()
        out, marked, hinted = (True, False, False) if self.skipped else self.left_out(tag, attrs)
        if out:
            if not self.skipped:
                self.flush()
            self.skipped += 1
            self.open.append((tag, -1))
            return
        if tag in ("td", "th"):
            self.text.append(" ")
        was = self.at
        if marked:
            self.flush()
            self.marks.append(len(self.open))
            self.marked.add(len(self.kinds))
        if hinted and tag in BLOCKS:
            self.hinted.add(len(self.kinds))
        if tag == "a":
            self.links += 1
        if marked or (hinted and tag in BLOCKS) or (tag in CONTAINERS and not (tag == "body" and self.at == 0)):
            self.kinds.append(tag)
            self.parents.append(self.at)
            self.at = len(self.kinds) - 1
        self.open.append((tag, was))

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag in BLOCKS and not self.skipped:
            self.flush()
        depth = next((i for i in range(len(self.open) - 1, -1, -1) if self.open[i][0] == tag), -1)
        if depth < 0:
            return
        if self.skipped and self.open[depth][1] >= 0 and tag not in ("body", "html", "article", "main"):
            return  # an end tag without a start inside a left-out element
        if self.marks and depth < self.marks[-1] and tag not in ("body", "html", "article", "main"):
            return  # the same inside a marked one
        while len(self.open) > depth:
            name, was = self.open.pop()
            if name == "a" and was >= 0:
                self.links -= 1
            if self.marks and self.marks[-1] == len(self.open):
                self.marks.pop()
            if was < 0:
                self.skipped -= 1
            else:
                if self.at != was:
                    self.flush()
                self.at = was

    def handle_data(self, data: str) -> None:
        if not self.skipped:
            self.text.append(data)
            if self.links:
                self.linked += len(data)


def smoothed(ratios: np.ndarray) -> np.ndarray:
    reach = max(1, int(3 * SIGMA))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / SIGMA) ** 2)
    return np.convolve(np.pad(ratios, reach, mode="edge"), kernel / kernel.sum(), mode="valid")


def main_text(html: str | None) -> str:
    parser = Lines()
    parser.feed(html or "")
    parser.close()
    parser.flush()
    out = left_containers(parser)
    lines = [x for x in parser.lines if out.isdisjoint(around(parser, x.at))]
    if not lines:
        return ""
    size = np.array([len(x.text) for x in lines], float)
    free = size - np.array([x.linked for x in lines])
    weight = np.array([0.5 if parser.hinted.intersection(around(parser, x.at)) else 1.0 for x in lines])
    score = smoothed(weight * free / (1 + np.array([x.tags for x in lines])))
    above = score >= min(score.mean(), np.median(score))
    votes = np.where(above, free, 0.0)
    kept = outlined(parser, lines, votes)
    if kept is None:
        kept = clustered(parser, lines, votes, score)
    # A hint decides where no line of its element stands out and each is made of links.
    bad = set(parser.hinted)
    for x, v, f in zip(lines, votes, free, strict=True):
        if v or len(x.text) - f <= LINKED * len(x.text):
            bad.difference_update(around(parser, x.at))
    return "\n\n".join(x.text for x, yes in zip(lines, kept, strict=True) if yes and bad.isdisjoint(around(parser, x.at)))


def outlined(parser: Lines, lines: list[Line], votes: np.ndarray) -> list[bool] | None:
    """Which lines to keep where articles or mains say so; None if no line stands in one."""
    homes = [region(parser, x.at) for x in lines]
    if not any(homes):
        return None
    held: dict[int, float] = dict.fromkeys(filter(None, homes), 0.0)
    for home, x, v in zip(homes, lines, votes, strict=True):
        if home:
            held[home] += v + 1e-6 * len(x.text)
    best = max(held, key=lambda k: (held[k], -k))
    chosen = {k for k, v in held.items() if v >= FAIR_SHARE * held[best]}
    mains = {k for k in chosen if parser.kinds[k] == "main"} | {m for k in chosen for m in around(parser, k) if parser.kinds[m] == "main"}
    # Boxes beside an article in a main count as regions of their own.
    boxes: dict[int, float] = {}
    beside = [box_in(parser, x.at, mains) if home not in chosen or parser.kinds[home] == "main" else None for home, x in zip(homes, lines, strict=True)]
    for k, v in zip(beside, votes, strict=True):
        if k is not None:
            boxes[k] = boxes.get(k, 0.0) + v
    only_main = all(parser.kinds[k] == "main" for k in chosen)
    keep = []
    for home, k in zip(homes, beside, strict=True):
        if home in chosen and (only_main or parser.kinds[home] == "article"):
            keep.append(True)
        else:
            keep.append(k is not None and (k in mains or boxes[k] >= FAIR_SHARE * held[best]))
    return keep


def box_in(parser: Lines, at: int, mains: set[int]) -> int | None:
    """The outermost container around ``at`` within one of these mains, or the main; None outside of them."""
    inner = at
    for k in around(parser, at):
        if k in mains:
            return inner
        inner = k
    return None


def clustered(parser: Lines, lines: list[Line], votes: np.ndarray, score: np.ndarray) -> list[bool]:
    """Which lines to keep by votes of the containers alone."""
    homes = [x.at for x in lines]
    held: dict[int, float] = {}
    for at, v in zip(homes, votes, strict=True):
        held[at] = held.get(at, 0.0) + v
    # Paragraphs may be wrapped one by one: a container has the votes of what it holds, but a wrapper of one region is not it.
    best = max(held, key=lambda k: (held[k], -k))
    total = sum(held.values())
    while best and held[best] < 0.5 * total:
        best = parser.parents[best]
        held[best] = sum(v for at, v in zip(homes, votes, strict=True) if best == 0 or best in around(parser, at))
    inside = [best == 0 or best in around(parser, at) for at in homes]
    level = 0.5 * np.average(score, weights=np.maximum(votes, 1e-9))
    dense: dict[int, list[float]] = {}
    for at, s in zip(homes, score, strict=True):
        dense.setdefault(at, []).append(s)
    firm = {at for at, s in dense.items() if np.mean(s) >= level}
    if best:
        beside = parser.parents[best]
        return [yes or (at in firm and at != beside and parser.parents[at] == beside) for yes, at in zip(inside, homes, strict=True)]
    # In the body itself: boxes below the threshold go, and so do such lines at both ends.
    keep = [at == 0 or at in firm for at in homes]
    solid = [i for i, yes in enumerate(keep) if yes and (score[i] >= level or lines[i].heading)]
    return [yes and solid[0] <= i <= solid[-1] for i, yes in enumerate(keep)] if solid else keep


def around(parser: Lines, at: int) -> list[int]:
    """A container and those it stands in, but for the body."""
    found = []
    while at > 0:
        found.append(at)
        at = parser.parents[at]
    return found


def left_containers(parser: Lines) -> set[int]:
    """The marked containers without the article: the article or main in the fewest marked ones, else most of the text.

    An article of nothing but marked containers keeps the one with most of its text.
    """
    if not parser.marked:
        return set()
    inside = [parser.marked.intersection(around(parser, k)) for k, tag in enumerate(parser.kinds) if tag in ("article", "main")]
    if inside:
        least = min(map(len, inside))
        left = parser.marked.difference(*(x for x in inside if len(x) == least))
        of = [(len(x.text), left.intersection(around(parser, x.at))) for x in parser.lines if region(parser, x.at)]
        if any(not x for _, x in of):
            return left
        # Nothing would be left of the article: what holds most of it stays.
        return left - {k for k in left if 2 * sum(n for n, x in of if k in x) > sum(n for n, _ in of)}
    held = dict.fromkeys(parser.marked, 0)
    for x in parser.lines:
        for k in parser.marked.intersection(around(parser, x.at)):
            held[k] += len(x.text)
    total = sum(len(x.text) for x in parser.lines)
    return {k for k, n in held.items() if 2 * n <= total}


def region(parser: Lines, at: int) -> int:
    """The outermost article around a container, else the outermost main, else the body (0)."""
    found, kind = 0, ""
    while at > 0:
        if parser.kinds[at] == "article" or (parser.kinds[at] == "main" and kind != "article"):
            found, kind = at, parser.kinds[at]
        at = parser.parents[at]
    return found


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows_of(batches):
            texts = [main_text(h) for h in b.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    found = with_python(pages.select("page_id", "url", "html")).mapInArrow(parsed, "page_id long, url string, text string")
    return found.withColumn("n_chars", F.length("text").cast("long"))
