"""HTML extraction by line-block distribution.

Markup is stripped so that every block element gives one line.  A line weighs as many characters as it has outside links;
lines that are mostly link text weigh nothing, and neither do those inside menus, headers, footers, sidebars, notices,
adverts, forms and reader comments (by element, role, or name of class or id) or, where a page marks its article, outside
it.  Weights are summed over sliding windows of ``WINDOW`` lines.  Text surges where a window begins to weigh anything and
dives where one no longer does; what stands between a surge and the dive after it is kept, lines that are links among it,
but for what is unwanted.  So a linked line within running text stays, and a list of links goes.

Defined results: a null or empty page has empty text; text outside any block is a line of its own; an element left
open reaches to the end of its parent, or of a p, li, dd, dt, or part of a table to what ends it in HTML (the next of
its kind, and for p any block), but an article inside an unwanted element that its own end tag never closes counts; a raw
element that closes itself is empty; a tag without an end is text up to the next tag; elements nested deeper than ``DEEPEST``
take no part in these rules; repeated rows give repeated results; further columns are ignored.  All steps take time linear
in the page.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pick, sliced

LINKS = 0.6
WINDOW = 3
DEEPEST = 512
SLICE_BYTES = 4 << 20

# Elements by what they mean for the text, roles, and words of classes and ids.
BLOCKS = set("address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split())
RAW = set("script style noscript template textarea title iframe".split())
DROPPED = set("nav header footer aside form menu dialog object svg canvas audio video select button".split())
ROLES = set("navigation banner contentinfo complementary search form alert dialog alertdialog menu menubar toolbar".split())
MARKS = set(
    "ad ads adv advert adverts advertisement adsense banner sponsor sponsored promo promotion nav navbar navigation menu menubar breadcrumb breadcrumbs pagination pager"
    " header masthead footer copyright sidebar side aside widget widgets related recommended recommendations cookie cookies consent gdpr notice notices alert popup modal"
    " newsletter subscribe signup login comment comments disqus reply replies respond share sharing social toolbar skip".split()
)
#: Words that may stand beside those in a name without changing what it says.
BESIDE = set("area bar block body bottom box button buttons col column container content cta element foot form frame global group head holder icon icons inner inline item items large left links link list main mid mobile module more news outer page panel placement post posts primary right row secondary section side sides site slot small stories sub text thread title top unit wrap wrapper zone".split())
#: Marks of an article that is none.
NO_ARTICLE = {"comment", "comments", "reply", "replies", "ad"}
#: Elements whose end tag may be left out.
OPTIONAL = set("p li dd dt option tr td th thead tbody tfoot caption".split())
#: Blocks whose start ends an open p.
ENDS_P = BLOCKS - set("br option legend title html head body".split())
#: By element: which open ones its start ends, and the blocks that these are looked for through.
_IN_ITEM, _IN_TABLE = {"address", "div", "p"}, BLOCKS - set("table article main body html".split())
SIBLINGS = {"li": ({"li"}, _IN_ITEM), "dt": ({"dt", "dd"}, _IN_ITEM), "dd": ({"dt", "dd"}, _IN_ITEM), "option": ({"option"}, set()), "body": ({"head"}, BLOCKS)}
SIBLINGS |= {n: ({"td", "th"}, _IN_TABLE - {"tr"}) for n in ("td", "th")} | {"tr": ({"tr", "td", "th"}, _IN_TABLE)}
SIBLINGS |= {n: ({"thead", "tbody", "tfoot", "tr", "td", "th"}, _IN_TABLE) for n in ("thead", "tbody", "tfoot")}
VOID = set("area base br col embed hr img input link meta source track wbr".split())

#: A tag whose quoted values hold no brackets, and the pieces of any other.
_PLAIN = re.compile(r"""<(/?)([a-zA-Z][^\s/><"']*+)((?:[^<>"']++|"[^"<>]*+"|'[^'<>]*+')*+)>""")
_NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)")
_GAP, _KEY, _EQUALS, _BARE = (re.compile(p) for p in (r"[\s/]*+", r"[^\s/>][^\s/>=]*+", r"\s*+=\s*+", r"[^\s>]*+"))
_ATTRIBUTE = re.compile(r"""([^\s/>=][^\s/>=]*+)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>]*+)))?+""")
_TELLING = re.compile(r"class|id|role|hidden|style|href", re.I)
_WORD = re.compile(r"[a-z]+|[A-Z]+(?![a-z])|[A-Z][a-z]*|[0-9]+")
_HIDES = re.compile(r"display\s*:\s*none")


def _attributes(text: str) -> dict[str, str]:
    """The attributes of a tag that say something here, the first of each name."""
    found: dict[str, str] = {}
    if _TELLING.search(text):
        for key, *values in _ATTRIBUTE.findall(text):
            found.setdefault(key.lower(), "".join(values))
    return found


def _says(names: str, marks: set[str]) -> bool:
    """Whether one of the names (of a class or id) is made of ``marks``, and of words that may stand beside them."""
    for name in names.split():
        words = [w.lower() for w in _WORD.findall(name)]
        if marks.intersection(words) and all(w in MARKS or w in BESIDE or w.isdigit() or len(w) == 1 for w in words):
            return True
    return False


def _unwanted(name: str, attributes: dict[str, str]) -> bool:
    if name in DROPPED:
        return True
    if not attributes:
        return False
    if attributes.get("role", "").lower() in ROLES or "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true" or _HIDES.search(attributes.get("style", "").lower()):
        return True
    names = f"{attributes.get('class', '')} {attributes.get('id', '')}"
    return name not in ("body", "html", "main") and _says(names, NO_ARTICLE if name == "article" else MARKS)


class _Element:
    """An open element; ``bad`` is the innermost unwanted one around a place in it, ``article`` the innermost article."""

    __slots__ = ("name", "depth", "parent", "bad", "article", "closed")

    def __init__(self, name: str, parent: _Element | None, bad: bool, article: bool):
        self.name, self.parent, self.closed = name, parent, False
        self.depth = parent.depth + 1 if parent else 0
        self.bad = self if bad else parent.bad if parent else None
        self.article = self if article and not bad else parent.article if parent else None

    def surely_bad(self) -> bool:
        """Whether a place in it is unwanted whatever follows: no article stands between."""
        return self.bad is not None and (self.article is None or self.bad.depth > self.article.depth)

    def is_bad(self) -> bool:
        """The same once the page has been read: an unwanted element around the article must have been closed."""
        bad = self.bad
        while bad is not None:
            if bad.closed or self.article is None or bad.depth > self.article.depth:
                return True
            bad = bad.parent.bad if bad.parent else None
        return False


class _Open:
    """The elements that are open at a place of a page."""

    def __init__(self) -> None:
        self.elements = [_Element("", None, False, False)]
        self.over = 0  # open elements that are nested too deep

    @property
    def top(self) -> _Element:
        return self.elements[-1]

    def push(self, name: str, bad: bool) -> None:
        if len(self.elements) > DEEPEST:
            self.over += 1
        else:
            self.elements.append(_Element(name, self.top, bad, name in ("article", "main")))

    def ended_by_start(self, name: str) -> int | None:
        """The element whose left-out end tag the start tag of ``name`` stands for."""
        found = None
        wanted, through = SIBLINGS.get(name, ((), ()))
        if wanted:
            for at in range(len(self.elements) - 1, 0, -1):
                other = self.elements[at].name
                if other in wanted:
                    found = at
                elif other in BLOCKS and other not in through:
                    break
        if found is None and name in ENDS_P:
            for at in range(len(self.elements) - 1, 0, -1):
                if self.elements[at].name in BLOCKS:
                    return at if self.elements[at].name == "p" else None
        return found

    def ended_by_end(self, name: str) -> int | None:
        """The element that the end tag of ``name`` ends; a stray one ends no block, and only its own one an article."""
        for at in range(len(self.elements) - 1, 0, -1):
            other = self.elements[at].name
            if other == name:
                return at
            if name not in ("article", "main") and (other in ("article", "main") or name not in BLOCKS and other in BLOCKS and other not in OPTIONAL):
                return None
        return None


def _self_closed(attributes: str) -> bool:
    """Whether a start tag ends in a slash that isn't part of an unquoted value."""
    return attributes.endswith("/") and not re.search(r"=\s*[^\s\"']+$", attributes[-200:])


def _tags(page: str) -> Iterator[tuple[int, int, bool, str, str]]:
    """(start, end, is an end tag, name, attributes) of each tag; name is empty for comments and declarations.

    The caller may send the place to go on from, where it skips what a tag holds.
    """
    at, last = 0, {c: page.rfind(c) for c in "\"'>"}
    while (start := page.find("<", at)) >= 0:
        if page.startswith("<!--", start):
            stop = page.find("-->", start + 4)
            end, found = (stop + 3 if stop >= 0 else len(page)), (False, "", "")
        elif page.startswith(("<!", "<?"), start) and start < last[">"]:
            end, found = page.index(">", start) + 1, (False, "", "")
        elif m := _PLAIN.match(page, start):
            end, found = m.end(), (bool(m[1]), m[2].lower(), m[3])
        elif (m := _NAME.match(page, start)) and m.end() <= last[">"]:
            begin = m.end()
            end = _tag_end(page, begin, last) or page.index(">", begin) + 1
            found = (bool(m[1]), m[2].lower(), page[begin : end - 1])
        else:
            at = start + 1
            continue
        at = end
        skipped = yield (start, end, *found)
        if skipped is not None:
            at = skipped
            yield (at, at, False, "", "")


def _tag_end(page: str, at: int, last: dict[str, int]) -> int | None:
    """Where the tag whose attributes begin at ``at`` ends; quotes count behind an equals sign only, and if they are closed."""
    while True:
        at = _GAP.match(page, at).end()
        if at > last[">"]:
            return None
        if page[at] == ">":
            return at + 1
        at = _KEY.match(page, at).end()
        if m := _EQUALS.match(page, at):
            at = m.end()
            quote = page[at : at + 1]
            at = page.index(quote, at + 1) + 1 if quote in ('"', "'") and at < last[quote] else _BARE.match(page, at).end()


def page_lines(page: str) -> list[tuple[str, int, bool, bool]]:
    """(text, characters in links, unwanted, inside an article) of each line of a page.

    Lines without text are left out; those that hold unwanted text only have an empty one.
    """
    out: list[tuple[str, int, _Element | None]] = []
    parts: list[str] = []
    linked: list[str] = []
    opened = _Open()
    owner: _Element | None = None
    in_link = lost = False
    at = 0

    def close() -> None:
        nonlocal owner, in_link, lost
        text = " ".join(html.unescape("".join(parts)).split())
        if text:
            out.append((text, min(len(text), sum(len(" ".join(html.unescape(x).split())) for x in linked)), owner))
        elif lost:
            out.append(("", 0, None))
        parts.clear()
        linked.clear()
        owner, in_link, lost = None, False, False

    def take(text: str) -> None:
        nonlocal owner, lost
        if opened.top.surely_bad():
            lost = lost or not text.isspace()
            return
        parts.append(text)
        owner = owner or opened.top
        if in_link:
            linked.append(text)

    def end(number: int | None, own: bool = False) -> None:
        if number is not None:
            opened.elements[number].closed = own
            del opened.elements[number:]

    tags = _tags(page)
    for start, stop, is_end, name, attributes in tags:
        if start > at:
            take(page[at:start])
        at = stop
        if not name:
            continue
        if name in BLOCKS:
            close()
        if is_end:
            if opened.over:
                opened.over -= 1
            else:
                end(opened.ended_by_end(name), own=True)
            in_link = in_link and name != "a"
            continue
        if name in RAW:
            if not _self_closed(attributes):
                last = re.compile(rf"</{re.escape(name)}\s*+>", re.I).search(page, at)
                at = last.end() if last else len(page)
                tags.send(at)
            continue
        told = _attributes(attributes) if attributes else {}
        if name == "a":
            in_link = "href" in told
        if opened.over == 0:
            end(opened.ended_by_start(name))
        if name not in VOID and not (name in ("svg", "math") and _self_closed(attributes)):
            opened.push(name, _unwanted(name, told))
    if at < len(page) and not _NAME.match(page, at):
        take(page[at:])
    close()
    return [(text, link, owner is None or owner.is_bad(), owner is not None and owner.article is not None) for text, link, owner in out]


def line_weights(lines: list[tuple[str, int, bool, bool]]) -> list[int]:
    """Characters of each line that count."""
    marked = any(inside and not bad for _, _, bad, inside in lines)
    return [0 if bad or marked and not inside or link > LINKS * len(text) else len(text) - link for text, link, bad, inside in lines]


def text_spans(weights: list[int], window: int = WINDOW) -> list[tuple[int, int]]:
    """(first line, line after the last) of each stretch from a surge to the dive after it.

    Windows of ``window`` lines are summed; a surge is the first line that weighs in a window after one of weight 0, a dive
    the last line that weighs before a window of weight 0.
    """
    padded = [*weights, *[0] * window]
    spans, total, begin, last = [], 0, None, 0
    total = sum(padded[: window - 1])
    for i, weight in enumerate(weights):
        total += padded[i + window - 1]  # the window that begins at line i
        if weight:
            begin, last = i if begin is None else begin, i
        if begin is not None and total == 0:
            spans.append((begin, last + 1))
            begin = None
        total -= weight
    if begin is not None:
        spans.append((begin, last + 1))
    return spans


def main_text(page: str) -> str:
    """The text between surges and dives."""
    lines = page_lines(page)
    marked = any(inside and not bad for _, _, bad, inside in lines)
    kept = [line for a, z in text_spans(line_weights(lines)) for line in lines[a:z]]
    return "\n".join(text for text, _, bad, inside in kept if not bad and (inside or not marked))


def extract_text(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", url_col: str = "url") -> DataFrame:
    """page_id, url, text, n_chars of every row."""
    rows = pick(pages, page_id=id_col, url=url_col, html=html_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, column=2, size=SLICE_BYTES):
            texts = [main_text(p) if p else "" for p in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    kinds = {c: rows.schema[c].dataType.simpleString() for c in ("page_id", "url")}
    found = rows.mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string")
    return found.withColumn("n_chars", F.length("text").cast("long"))
