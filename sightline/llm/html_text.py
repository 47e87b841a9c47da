"""Main text of web pages by line-block distribution.

Markup is stripped to lines, one for each block of text. What the tags say about a line is its weight: text of links,
and text in menus, footers, adverts and the like, weighs nothing; text in an article element weighs a multiple of its
length. The weights of lines are summed over sliding windows; where the sum surges a text begins, where it dives to
nothing it ends, and the lines between are kept.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import map_columns

#: Lines in a window.
WINDOW = 3
#: Weight in a window at which a text begins; a page with less everywhere begins at its largest window.
SURGE = 40
#: Times that a character in an article element (or else in main) weighs, where the page has one.
MARKED = 10

_name = re.compile(r"/?([a-zA-Z][a-zA-Z0-9:-]*)")
_hint = re.compile(r"""(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_hidden = re.compile(r"""(?:^|\s)hidden(?:\s|=|/|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)

#: Elements by what they mean for the main text.
RAW = frozenset("script style noscript template svg math iframe object textarea select canvas video audio title".split())
OUTSIDE = frozenset("nav footer aside form dialog menu button head".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul".split())
EMPTY = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CONTAINERS = frozenset("article blockquote body center dd details div fieldset figure li main section td th".split())
#: Blocks that are text themselves, whatever their class is called.
TEXT_BLOCKS = frozenset("html body main p h1 h2 h3 h4 h5 h6 pre blockquote figcaption caption td th tr table tbody".split())
#: Words of class, id and role that mark text outside the article, and words that say nothing.
HINTS = frozenset("ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion sidebar nav navbar navigation menu breadcrumb breadcrumbs footer cookie cookies consent notice notification newsletter subscribe subscription signup login share sharing social related recommended popup modal toolbar widget pagination pager skip complementary contentinfo search".split())
#: Words that mark what readers wrote, in whatever company; those that do so outside an article alone; and
#: words beside them that only tell whether readers may write.
READERS = frozenset("comment comments commentlist commentary disqus reply replies respond".split())
READERS_OUTSIDE = frozenset("discussion discussions responses reactions".split())
ALLOWED = frozenset("open opened closed enabled disabled allowed no has with without".split())
NEUTRAL = frozenset("area areas bar bars block blocks bottom box boxes button buttons container form forms group header holder icon icons inner item items left link links list lists main outer page panel panels post posts region right section sections site slot slots thread threads top unit units wrap wrapper".split())


class Line(NamedTuple):
    text: str
    weight: int


class _Block(NamedTuple):
    """A block of text as it stands in the page; place 2 in an article, 1 in a main element, 0 elsewhere."""

    text: str
    weight: int
    parent: int
    place: int


def tags(page: str) -> Iterator[tuple[int, int, str, bool, str]]:
    """Tags, comments and declarations as (start, end, lower-case name, whether it is an end tag, attributes); the name
    of all but tags is empty. The text of RAW elements belongs to their start tags. Takes linear time: what was not
    found once is not looked for again."""
    at, size, absent = 0, len(page), set()

    def find(what: str, begin: int) -> int:
        if what in absent:
            return -1
        place = page.find(what, begin)
        if place < 0:
            absent.add(what)
        return place

    while (begin := find("<", at)) >= 0:
        if page.startswith("<!--", begin):
            stop = find("-->", begin + 4)
            at = stop + 3 if stop >= 0 else size
            yield begin, at, "", False, ""
            continue
        named = _name.match(page, begin + 1)
        if not named and page[begin + 1 : begin + 2] not in ("!", "?"):
            at = begin + 1
            continue
        stop = find(">", begin)
        if stop < 0:
            return
        at = named.end() if named else begin + 1
        while named:  # a > inside a quoted value does not end the tag
            quote = min((q for q in (find('"', at), find("'", at)) if q >= 0), default=size)
            if quote > stop:
                break
            close = find(page[quote], quote + 1)
            if close < 0:
                break
            at = close + 1
            if close > stop:
                stop = find(">", at)
                if stop < 0:
                    return
        at = stop + 1
        if not named:
            yield begin, at, "", False, ""
            continue
        name, ends, rest = named[1].lower(), page[begin + 1] == "/", page[named.end() : stop]
        if name in RAW and not ends and not rest.endswith("/"):
            if f"</{name}" not in absent:
                end = re.compile(rf"</{name}\s*>", re.I).search(page, at)
                if not end:
                    absent.add(f"</{name}")
                at = end.end() if end else size
            else:
                at = size
        yield begin, at, name, ends, rest


def _outside(name: str, rest: str, in_article: bool) -> str:
    """Whether an element is outside the main text, by its name or by what its attributes say: "readers" for what readers
    wrote, "other", or "" for an element that may hold main text."""
    if name in TEXT_BLOCKS or not rest:
        return "other" if name in OUTSIDE or name == "header" and not in_article else ""
    found = "other" if name in OUTSIDE or name == "header" and not in_article or _hidden.search(rest) else ""
    for hint in _hint.findall(rest):
        for token in hint.strip("\"'").lower().split():
            words = [w for w in re.split(r"[^a-z]+", token) if w]
            if ALLOWED.isdisjoint(words) and not (READERS.isdisjoint(words) and (in_article or READERS_OUTSIDE.isdisjoint(words))):
                return "readers"
            if not HINTS.isdisjoint(words) and all(w in HINTS or w in NEUTRAL for w in words):
                found = "other"
    return found


def _blocks(page: str) -> list[_Block | None]:
    """The blocks of text of a page: white space made one blank, references decoded. Text of links weighs nothing if it
    is most of a block. None stands for a region outside the main text."""
    blocks: list[_Block | None] = []
    held: list[str] = []
    linked = 0  # characters of links in held, without white space
    mask: list[str] = []  # open elements since a region outside the main text began
    why = ""  # it began
    parents: list[tuple[str, int]] = [("", 0)]
    open_: Counter = Counter()  # the names in parents
    masked: Counter = Counter()  # the names in mask
    links = made = at = 0

    def place() -> int:
        return 2 if open_["article"] else 1 if open_["main"] else 0

    def hide(name: str) -> None:
        mask.append(name)
        masked[name] += 1

    def close() -> None:
        nonlocal linked
        text = " ".join("".join(held).split())
        held.clear()
        if text and not mask:
            solid = len(text.replace(" ", ""))
            blocks.append(_Block(text, max(0, solid - linked) if linked * 2 >= solid else len(text), parents[-1][1], place()))
        linked = 0

    def take(text: str) -> None:
        nonlocal linked
        if text and not mask:
            text = html.unescape(text)
            held.append(text)
            linked += len("".join(text.split())) if links else 0

    def leave() -> None:
        mask.clear()
        masked.clear()
        held.clear()
        blocks.append(None)

    for begin, stop, name, ends, rest in tags(page):
        take(page[at:begin])
        at = stop
        if not name or name in RAW:
            continue
        alone = name in EMPTY or rest.endswith("/")
        if name in ("br", "img", "wbr", "input"):
            if not mask and name != "wbr":
                held.append(" ")
            continue
        if mask:
            if ends:
                if masked[name]:
                    while (last := mask.pop()) != name:
                        masked[last] -= 1
                    masked[name] -= 1
                    if not mask:
                        leave()
                continue
            if name == "body" and mask[0] == "head":
                leave()
            elif name in ("article", "main") and why != "readers" and mask[0] not in ("footer", "aside", "form", "dialog", "menu", "button"):
                leave()  # the region was never closed; what readers wrote may be articles of its own
            elif mask == ["p"] and name in BLOCKS:
                leave()
            else:
                if not alone and name in BLOCKS and name not in ("p", "li", "td", "tr", "dd", "dt"):
                    hide(name)
                continue
        if name == "a":
            links = 0 if ends else 1
            continue
        block = name in BLOCKS or name in OUTSIDE
        if block:
            close()
        if ends:
            if open_[name]:
                while (last := parents.pop()[0]) != name:
                    open_[last] -= 1
                open_[name] -= 1
        elif not alone and (block or rest) and (why := _outside(name, rest, place() == 2)):
            close()
            hide(name)
        elif not alone and name in CONTAINERS:
            if name in ("li", "td", "th", "dd") and parents[-1][0] == name:
                parents.pop()  # its end tag may be left out
                open_[name] -= 1
            made += 1
            open_[name] += 1
            parents.append((name, made))
    take(page[at:])
    close()
    return blocks


def lines_of(page: str, window: int = WINDOW) -> list[Line]:
    """The lines of a page with their weights. If a part of the page is marked as the article (or else as main), lines
    elsewhere are empty and lines in it weigh MARKED times as much; lines of links weigh nothing there too. A region outside the main text is one empty line where the
    text goes on in the same element, and a window of empty lines elsewhere."""
    blocks = _blocks(page)
    best = max((b.place for b in blocks if b), default=0)
    lines: list[Line] = []
    parent, regions = None, 0
    for block in blocks:
        if block is None:
            regions += 1
            continue
        if regions:
            lines += [Line("", 0)] * (1 if block.parent == parent else window)
        parent, regions = block.parent, 0
        lines.append(Line("", 0) if block.place < best else Line(block.text, block.weight * (MARKED if best else 1)))
    return lines


def between(lines: list[Line], window: int = WINDOW, surge: int = SURGE) -> list[str]:
    """The texts between surge and dive points: a window opens on each line; the text begins where its sum surges,
    reaches back over the lines of text before it, and ends where the sum dives to nothing."""
    sums, total = [], 0
    for i in range(len(lines) - 1, -1, -1):
        total += lines[i].weight - (lines[i + window].weight if i + window < len(lines) else 0)
        sums.append(total)
    sums.reverse()
    least = min(surge, max(sums, default=0))
    kept: list[str] = []
    at = done = 0
    while least and at < len(lines):
        if sums[at] < least:
            at += 1
            continue
        begin = at
        while begin > done and lines[begin - 1].text and sums[begin - 1]:
            begin -= 1
        while not lines[begin].weight:  # a window may open on lines of links
            begin += 1
        while at < len(lines) and sums[at]:
            at += 1
        kept += [line.text for line in lines[begin:at] if line.text]
        done = at
    return kept


def main_text(page: str, window: int = WINDOW, surge: int = SURGE) -> str:
    """The kept lines of a page in page order, joined by line ends; empty if it has none."""
    return "\n".join(between(lines_of(page, window), window, surge))


def extract(pages: DataFrame, column: str = "html") -> DataFrame:
    """Add text and n_chars to every page; other columns stay, and own columns of these names are replaced. A null or
    empty page, or one without text, gives an empty text of 0 characters. Repeated rows give repeated results; an empty table
    gives no rows."""
    kept = [c for c in pages.columns if c not in ("text", "n_chars", column)]

    def make():
        def work(batch: dict) -> dict:
            texts = [main_text(h or "") for h in batch.pop(column)]
            return batch | {"text": texts, "n_chars": list(map(len, texts))}

        return work

    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in pages.select(kept).schema)
    return map_columns(pages.select(*kept, F.col(column)), make, f"{fields}text string, n_chars long")
