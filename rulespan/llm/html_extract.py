"""Main text of web pages by smoothed text-to-tag ratios.

The standard library's parser streams events; block borders cut the page into lines, each with
its characters of text and its number of tags. A line's ratio of text outside links to tags is
smoothed with a Gaussian window, weighted by the landmarks around it (an article's lines weigh more, those
of what a class name calls a menu or an advert less), and compared with the threshold, the page's standard
deviation: lines above it seed content regions, and a region grows over the lines around its
seeds that share their container. Only elements that HTML itself sets apart (scripts, forms, navigation
and the like) are left out before.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rulespan.llm.common import bounded_references

# Fixed values of HTML and of page authors' habits.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form "
                   "h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
NEVER = frozenset("aside button canvas datalist dialog footer form head iframe menu nav noframes noscript object script select style svg template textarea title".split())
ROOTS = frozenset("article main".split())
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
#: Words of class names and ids of what is hardly ever the article.
NAMES = frozenset("ad adbox ads adsense adslot advert advertisement advertising adverts announcement banner breadcrumb breadcrumbs byline commentlist consent cookie cookies copyright "
                  "cta disclaimer footer gdpr lightbox login masthead menu menus modal nav navbar navigation newsletter overlay pager pagination paywall popup "
                  "promo promoted promotion search sharing sidebar signup skip social sponsor sponsored subscribe subscription tagcloud toc toolbar widget widgets".split())
#: Of these, and of what else a page's other articles are in, an article inside is none.
SIDE_NAMES = frozenset("comment commentlist comments disqus pingbacks popular promo promoted recent recommended related replies reply respond sponsored trackbacks trending".split())
#: Words that the article's own parts have as well.
WEAK_NAMES = frozenset("alert hidden links notice notices share tags warning".split())
#: Words of which a page header's name consists, besides ``header``; an article's header has others.
HEADER_NAMES = frozenset("global header main page site top wrapper".split())
#: What a line's ratio is multiplied by: in an article or main part, by names, and for a line like a copyright note.
ROOT_WEIGHTS = {"article": 256.0, "main": 16.0}
NAME_WEIGHT, WEAK_WEIGHT, NOTE_WEIGHT, NOTE_CHARS = 1 / 16, 1 / 2, 1 / 16, 200
#: A window's reach and spread in lines, the threshold in standard deviations, the most of a line that links may
#: hold for a region to grow over it, and the least share of the threshold in a run of such lines in an article.
REACH, SIGMA, THRESHOLD, LINK_SHARE, RUN_SHARE = 2, 1.0, 1.0, 0.5, 0.01
#: So many comments that don't end, and not more, are looked for to the page's end.
OPEN_COMMENTS = 100

_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_NOTE = re.compile(r"(?:©|\(c\)|copyright)\W{0,9}(?:©|\(c\)|copyright)?\W{0,9}(?:19|20)\d\d|all rights reserved", re.I)
_UNFINISHED = re.compile(r"<[a-zA-Z/!?]")
#: What ends a still open element of the same kind: "<p>a<p>b".
_SELF_CLOSING = {"p": BLOCKS - {"br"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}}


class _Line:
    __slots__ = ("parts", "chars", "tags", "linked", "root", "heading", "parent", "weight")

    def __init__(self, root: int, heading: bool, parent: int, weight: float):
        self.parts, self.chars, self.tags, self.linked, self.root, self.heading, self.parent, self.weight = [], 0, 0, 0, root, heading, parent, weight


def _unwanted(tag: str, attrs: list[tuple[str, str | None]]) -> bool:
    if tag in NEVER:
        return True
    for name, value in attrs:
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "role" and value and value.strip().lower() in ROLES or name == "style" and value and _HIDDEN.search(value):
            return True
    return False


def _name_weight(tag: str, attrs: list[tuple[str, str | None]]) -> tuple[float, bool]:
    """What an element's class names and id make of its lines' weight, and whether also of an article's inside."""
    weight, side = 1.0, False
    for name, value in attrs:
        if name not in ("class", "id") or not value or tag in ("html", "body"):
            continue
        words = {w.lower() for w in _WORD.findall(value)}
        if words & SIDE_NAMES:
            weight, side = NAME_WEIGHT, True
        elif tag not in ROOTS and (words & NAMES or "header" in words and words <= HEADER_NAMES):
            weight = NAME_WEIGHT
        elif tag not in ROOTS and words & WEAK_NAMES:
            weight = min(weight, WEAK_WEIGHT)
    return weight, side


class _Open:
    """An open element: whether it or one around it is unwanted, its content root, whether it is a header, its number,
    and what names make of its lines' weight; ``side`` if articles inside don't count as such."""

    __slots__ = ("tag", "out", "root", "header", "number", "weight", "side")

    def __init__(self, tag: str, out: bool, root: int, header: bool, number: int, weight: float, side: bool):
        self.tag, self.out, self.root, self.header, self.number, self.weight, self.side = tag, out, root, header, number, weight, side


_PAGE = _Open("", False, 0, False, 0, 1.0, False)


class _Lines(HTMLParser):
    """Collects the lines of a page, in time linear in its length."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[_Line] = []
        self.open: list[_Open] = []
        #: where in ``open`` the elements of each tag are, and the blocks
        self.places: dict[str, list[int]] = {}
        self.blocks: list[int] = []
        self.roots = self.count = 0
        self.kinds: dict[int, str] = {}
        self.links = self.headings = 0
        self.line: _Line | None = None

    def parse_marked_section(self, i, report=1):
        return self.parse_bogus_comment(i, 0)  # as browsers do; the base class refuses unknown ones

    def _top(self) -> _Open:
        return self.open[-1] if self.open else _PAGE

    def _current(self) -> _Line:
        if self.line is None:
            top = self._top()
            self.line = _Line(top.root, self.headings > 0, top.number, top.weight)
            self.lines.append(self.line)
        return self.line

    def _pop_to(self, at: int) -> None:
        for x in self.open[at:]:
            self.links -= x.tag == "a"
            self.headings -= x.tag in HEADINGS
            self.places[x.tag].pop()
            if x.tag in BLOCKS:
                self.blocks.pop()
        del self.open[at:]

    def handle_starttag(self, tag, attrs):
        while self.open and tag in _SELF_CLOSING.get(self.open[-1].tag, ()):
            self._pop_to(len(self.open) - 1)
        if tag in BLOCKS:
            # inline elements that were left open end with the paragraph or item that they are in
            if tag != "br" and self.blocks and tag in _SELF_CLOSING.get(self.open[self.blocks[-1]].tag, ()):
                self._pop_to(self.blocks[-1])
            self.line = None
        if self.line is not None:
            self.line.tags += 1
        if tag in VOID:
            return
        above = self._top()
        self.count += 1
        out, root, header, weight, side = above.out or _unwanted(tag, attrs), above.root, above.header, above.weight, above.side
        own, own_side = _name_weight(tag, attrs) if attrs else (1.0, False)
        side = side or own_side
        if tag in ROOTS and not out and not side and (tag == "article" or self.kinds.get(root) != "article"):  # a main part in an article is part of it
            self.roots += 1
            root = self.roots
            self.kinds[root] = tag
            weight = 1.0  # whatever the page's layout around it is called
        weight = min(weight, own)
        if tag == "header":
            header = True
            out = out or not root
        self.links += tag == "a"
        self.headings += tag in HEADINGS
        self.places.setdefault(tag, []).append(len(self.open))
        if tag in BLOCKS:
            self.blocks.append(len(self.open))
        self.open.append(_Open(tag, out, root, header, self.count, weight, side))

    def handle_startendtag(self, tag, attrs):
        # "<div/>" opens an element in HTML
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        if tag in BLOCKS:
            self.line = None
        elif self.line is not None:
            self.line.tags += 1
        places = self.places.get(tag)
        # the end of an inline element that isn't open in its block is a stray one
        if places and (tag in BLOCKS or not self.blocks or places[-1] > self.blocks[-1]):
            self._pop_to(places[-1])

    def handle_data(self, data):
        top = self._top()
        if top.out or top.header and not self.headings:
            return
        n = len(data) - data.count(" ")
        if not n and self.line is None:
            return
        line = self._current()
        line.weight = max(line.weight, top.weight)
        line.parts.append(data)
        line.chars += n
        if self.links:
            line.linked += n


def lines_of(page: str) -> tuple[list[_Line], dict[int, str]]:
    """The page's lines with text, and its content roots' tags."""
    page = bounded_references(page)
    end = page.rfind(">") + 1
    head, tail = page[:end], page[end:]
    # comments that don't end are ended by the next tag's end, if there are many
    after = head.rfind("-->") + 1
    if head.count("<!--", after) > OPEN_COMMENTS:
        head = head[:after] + head[after:].replace("<!--", "<!")
    if m := _UNFINISHED.search(tail):
        tail = tail[: m.start()]  # a tag that the page's end cuts off
    parser = _Lines()
    parser.feed(head + tail)
    parser.close()
    return [x for x in parser.lines if x.chars and any(p.strip() for p in x.parts)], parser.kinds


def smoothed(values: np.ndarray, groups: np.ndarray, reach: int = REACH, sigma: float = SIGMA) -> np.ndarray:
    """Means under a Gaussian window, of the part of the window that is in the value's own group."""
    total, weight = values.astype(float), np.ones(len(values))
    for k in range(1, min(reach, len(values) - 1) + 1):
        w = np.exp(-0.5 * (k / sigma) ** 2) * (groups[k:] == groups[:-k])
        total[k:] += w * values[:-k]
        total[:-k] += w * values[k:]
        weight[k:] += w
        weight[:-k] += w
    return total / weight


def _note(line: _Line) -> bool:
    return not line.root and line.chars <= NOTE_CHARS and _NOTE.search("".join(line.parts)) is not None


def content(lines: list[_Line], kinds: dict[int, str]) -> list[int]:
    """The places of the lines that are content; ``kinds`` are their roots' tags."""
    named = np.array([x.weight * (NOTE_WEIGHT if _note(x) else 1.0) for x in lines])
    marked = np.array([ROOT_WEIGHTS.get(kinds.get(x.root, ""), 1.0) for x in lines])
    groups = np.array([x.root for x in lines]) + named / 2  # a window doesn't reach over a landmark's border
    plain = smoothed(np.array([(x.chars - x.linked) / max(1, x.tags) for x in lines]), groups)
    ratio = plain * named * marked
    # where a part of the page is marked as content, the threshold is for its lines; lines that are all alike all stay
    least = min(THRESHOLD * plain.std() * marked.max(), ratio.max())
    linked = np.array([x.linked > LINK_SHARE * x.chars for x in lines])
    seeds = np.flatnonzero((ratio >= least) & ~linked).tolist() or [int(ratio.argmax())]
    low = named < WEAK_WEIGHT
    chosen = set(seeds)
    # a region in an article or main part is all of it but lines that names set apart and long runs of links
    for root in {lines[i].root for i in seeds} - {0}:
        own = [i for i, x in enumerate(lines) if x.root == root]
        run: list[int] = []
        for i in [*own, None]:
            if i is not None and linked[i] and i not in chosen and not low[i]:
                run.append(i)
                continue
            if run and ratio[run].min() >= RUN_SHARE * least:
                chosen.update(run)
            run = []
            if i is not None and not low[i]:
                chosen.add(i)
    for step in (-1, 1):
        for seed in seeds:
            i = seed + step
            while not lines[seed].root and 0 <= i < len(lines) and i not in chosen:
                x = lines[i]
                if x.root or linked[i] or low[i] and not low[seed] or not (x.heading or x.parent == lines[seed].parent or ratio[i] >= least / 2):
                    break
                chosen.add(i)
                i += step
    return sorted(chosen)


def main_text(html: str | None) -> str:
    """The page's main text: blocks in page order, joined by one space, white space in them turned into one space."""
    lines, kinds = lines_of(html) if html else ([], {})
    return " ".join(" ".join("".join(lines[i].parts).split()) for i in content(lines, kinds)) if lines else ""


def extract(pages: DataFrame, keys: list[str], *, html: str = "html") -> DataFrame:
    """``keys``, then ``text`` and ``n_chars long`` (code points) of every row of ``pages``.

    A null page counts as empty; an empty page or one without content has the text ``''``. Nothing
    is cut, whatever its length, but a tag that the page's end cuts off; time is linear in the page's length; repeated rows each have their row; other columns are ignored.
    """
    source = pages.select(*(F.col(k) for k in keys), F.col(html).cast("string").alias("__html"))
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                texts = [main_text(h) for h in batch.column(len(keys)).to_pylist()]
                yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keys))), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=[*keys, "text", "n_chars"])

    return source.mapInArrow(run, f"{types}, text string, n_chars long")
