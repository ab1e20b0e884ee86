"""Main-text extraction by line-block distribution (operator 1).

Markup is stripped: each block element starts a line, scripts and the like vanish, and regions that
say what they are (menus, headers, footers, asides, forms, adverts, notices, comments) leave a gap
of empty lines. The sum of text lengths over a sliding window of ``WINDOW`` lines then has surge
points, where it leaves zero, and dive points, where it falls back; the text between a surge and its
dive is a stretch. Link text counts for nothing, but inside <article>, <main> and the like, whose
edges end a stretch. The content's container is the innermost one that holds more than half of the text of the one around
it, or a marked one on the way; regions removed inside it end no stretch. The main text is the heaviest stretch, the stretches in
that container, and those elsewhere with no less text than links, whatever their length. Unclosed
elements end where an enclosing one or the article ends.

Null html gives the empty text; an unclosed tag or comment runs to the end of the page. A page
without any stretch has an empty text. Rows are independent; repeated rows give equal results.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

from tsengine.llm.common import small_batches

WINDOW = 3

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
_ATTR = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?")
_SPACE = re.compile(r"\s+")
_SLASH = re.compile(r"=\s*[^\s\"']*/\Z")   # the end of an unquoted value, not of the element
_MARKED = re.compile(r"<(?:article|main)(?=[\s/>])|<[a-z][^<>]*\s(?:role\s*=\s*[\"']?main\b|itemprop\s*=\s*[\"']?articlebody\b)", re.I)
_FOREIGN = re.compile(r"comment|disqus|respond|repl(?:y|ies)|related|recommend|newsletter|promo|sponsor|\bads?\b|advert", re.I)
RAW = {"script", "style", "noscript", "template", "textarea", "title", "iframe", "svg", "math", "object", "canvas", "audio", "video", "select",
       "datalist"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BOILER = {"nav", "header", "footer", "aside", "form", "menu", "dialog", "button", "fieldset", "label", "legend", "option"}
BLOCK = {"address", "article", "blockquote", "body", "br", "caption", "center", "dd", "details", "div", "dl", "dt", "figcaption", "figure", "h1",
         "h2", "h3", "h4", "h5", "h6", "hgroup", "hr", "html", "li", "main", "ol", "p", "pre", "section", "summary", "table", "tbody", "td",
         "tfoot", "th", "thead", "tr", "ul"} | BOILER
MAIN = {"article", "main"}
BOXES = MAIN | {"div", "section", "td", "center"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6", "hgroup"}
INLINE = {"a", "abbr", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "mark", "q", "s", "samp", "small",
          "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var"}
#: Parts of class, id, role and label names that mark a region as not the article's.
WORDS = re.compile(
    r"nav|navbar|navigation|menu|menubar|breadcrumbs?|header|masthead|banner|footer|sidebar|aside|complementary|contentinfo|"
    r"ads?|advert\w*|adsbygoogle|sponsor\w*|promo\w*|cookies?|consent|gdpr|notice|alert|popup|modal|overlay|newsletter|subscri\w+|signup|login|"
    r"comments?|commentlist|disqus|respond|repl(?:y|ies)|reader|share|sharing|social|related|recommend\w*|widget|search|toolbar|"
    r"pagination|pager|skip|toc|copyright|legal|disclaimer")
#: Parts beside such a word that leave an id or a label the name of a region, not of a subject.
PLACES = re.compile(r"site|page|main|top|bottom|left|right|primary|secondary|global|post|article|entry|content|area|bar|block|box|container|form|inner|"
                    r"item|links?|list|module|outer|panel|region|section|slot|unit|wrap|wrapper|\d*")
#: Parts that make a class a statement about the layout of what it stands on.
LAYOUT = {"no", "not", "non", "has", "have", "with", "without", "hide", "show"}
#: Words that are headings of articles, too: as the id or label of a section they name its subject.
SUBJECTS = {"alert", "consent", "copyright", "cookie", "cookies", "disclaimer", "legal", "menu", "navigation", "notice", "reader", "recommendations", "search",
            "sharing", "social"}
#: Classes that say of an article element that it is another's: a reader's comment or a teaser.
OTHERS = {"ad", "advert", "comment", "comments", "promo", "related", "reply", "sponsored"}


def _word(part: str) -> bool:
    return bool(WORDS.fullmatch(part.rstrip("0123456789")))


def _class_says(value: str) -> bool:
    """A class with a part that is such a word and none that makes it the layout's."""
    names = (re.split(r"[_\-]+", c) for c in value.lower().split())
    return any(any(map(_word, parts)) and LAYOUT.isdisjoint(parts) for parts in names)


def _name_says(value: str) -> bool:
    """An id, role or label of such words and places only."""
    parts = [x for x in re.split(r"[\s_\-]+", value.lower()) if x]
    return any(map(_word, parts)) and all(_word(x) or PLACES.fullmatch(x) for x in parts)


def _marks(name: str, attrs: str) -> tuple[bool, bool, bool]:
    """(says it is not the article, is hidden, says it is the main text) of an element by its attributes."""
    has: dict[str, str] = {}
    for key, value in _ATTR.findall(attrs):
        has.setdefault(key.lower(), value.strip("\"'"))
    hidden = "hidden" in has or bool(re.search(r"display\s*:\s*none", has.get("style", ""), re.I))
    main = has.get("role", "").lower() == "main" or has.get("itemprop", "").lower() == "articlebody"
    if name in MAIN:
        return name == "article" and not OTHERS.isdisjoint(has.get("class", "").lower().split()), hidden, True
    if main or name in HEADINGS or name in INLINE:
        return False, hidden, main
    said = [x for x in (has.get(k, "") for k in ("id", "aria-label")) if name != "section" or x.lower() not in SUBJECTS]
    return _class_says(has.get("class", "")) or any(map(_name_says, [*said, has.get("role", "")])), hidden, main


def _wraps(page: str, name: str, at: int, marks: list[int]) -> bool:
    """Whether the element ``name`` whose content begins at ``at`` closes after all of the page's main marks."""
    if not marks or marks[0] < at:
        return False
    depth = 1
    for m in re.finditer(rf"<(/?){re.escape(name)}(?=[\s/>])", page[at:], re.I):
        depth += -1 if m[1] else 1
        if not depth:
            return at + m.start() > marks[-1]
    return False


class Line(NamedTuple):
    """A line, or with ``gap`` the place of a region that was removed."""
    text: str
    plain: int     # length outside links
    inside: bool   # an article or another main mark
    box: int       # the container it stands in
    gap: bool = False


def lines_of(page: str) -> tuple[list[Line], list[tuple[int, bool]]]:
    """The lines of a page, and of each container (0 is the page, an outer one stands before those in
    it) the next outer one and whether it is marked as main."""
    lines: list[Line] = []
    boxes = [(0, False)]
    text: list[str] = []
    linked: list[str] = []
    stack: list[tuple[str, bool, bool, int]] = []   # name, starts a region to skip, starts the article, container around it
    skip = main = link = box = 0
    raw: str | None = None
    marks: list[int] | None = None             # where the page's main marks stand, once asked for

    def end_line() -> None:
        t = _SPACE.sub(" ", entities.unescape("".join(text))).strip()
        if t:
            inside = _SPACE.sub(" ", entities.unescape("".join(linked))).strip()
            # separators between links are no text
            plain = len(t) - len(inside) if not inside or sum(map(str.isalnum, t)) > sum(map(str.isalnum, inside)) else 0
            lines.append(Line(t, max(0, plain), main > 0, box))
        text.clear()
        linked.clear()

    def close(upto: int) -> None:
        nonlocal skip, main, link, box
        while len(stack) > upto:
            name, skipped, article, around = stack.pop()
            if name in BLOCK or skipped or article:
                end_line()
            skip -= skipped
            main -= article
            link -= name == "a"
            box = around
            if skipped:
                lines.append(Line("", 0, main > 0, box, True))

    at = 0
    for m in _TOKEN.finditer(page):
        if raw is None and not skip and m.start() > at:
            piece = page[at:m.start()]
            text.append(piece)
            if link:
                linked.append(piece)
        at = m.end()
        name = (m[2] or "").lower()
        if raw is not None:
            if m[1] and name == raw:
                raw = None
            continue
        if not name:
            continue
        if m[1]:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    close(i)
                    break
            else:
                if name in BLOCK:
                    end_line()
            continue
        selfclosed = m[3].endswith("/") and not _SLASH.search(m[3]) and name not in BLOCK
        if name in RAW:
            if name != "title" or not skip:
                end_line() if name in ("textarea", "select") else None
            if not selfclosed:
                raw = name
            continue
        if name in BLOCK:
            end_line()
        if name in VOID or selfclosed:
            continue
        said_boiler, hidden, said_main = _marks(name, m[3])
        if said_boiler and not skip and name not in BOILER and name not in MAIN and not _FOREIGN.search(m[3]):
            if marks is None:
                marks = [x.start() for x in _MARKED.finditer(page)]
            said_boiler = not _wraps(page, name, at, marks)
        said_boiler |= hidden
        article = not said_boiler and said_main
        if article and skip and not any(s for n, s, *_ in stack if n in BOILER or n == "section") and not main:
            # an advert or notice left open before the article ends with it
            close(next(i for i, x in enumerate(stack) if x[1]))
        if name == "a" and link:
            close(max(i for i, x in enumerate(stack) if x[0] == "a"))
        # the article's own header holds its headings
        boiler = (said_boiler and name not in ("html", "body")) or (name in BOILER and not (name == "header" and main))
        if boiler and not skip:
            end_line()
            lines.append(Line("", 0, main > 0, box, True))
        if article:
            end_line()
        stack.append((name, boiler, article, box))
        if not skip and not boiler and (name in BOXES or article):
            boxes.append((box, article))
            box = len(boxes) - 1
        skip += boiler
        main += article
        link += name == "a"
    if raw is None and not skip and at < len(page):
        rest = page[at:]
        cut = re.search(r"<[!/a-zA-Z]", rest)
        text.append(rest[:cut.start()] if cut else rest)
    close(0)
    end_line()
    return lines, boxes


def stretches(weights: list[int]) -> list[tuple[int, int]]:
    """[surge, dive) line ranges: where the window sums leave zero and where they fall back to it."""
    sums, held = [], 0
    for i in range(len(weights) + WINDOW - 1):
        held += weights[i] if i < len(weights) else 0
        held -= weights[i - WINDOW] if i >= WINDOW else 0
        sums.append(held)   # of lines i - WINDOW + 1 .. i
    out, surge = [], None
    for i, s in enumerate(sums):
        if s and surge is None:
            surge = i
        elif not s and surge is not None:
            out.append((surge, i - WINDOW + 1))
            surge = None
    if surge is not None:
        out.append((surge, len(weights)))
    return out


def content_box(lines: list[Line], boxes: list[tuple[int, bool]], weights: list[int]) -> int:
    """The container of the content: from the page inwards, as long as one container holds more than
    half of the text and none is marked."""
    mass = [0] * len(boxes)
    for line, w in zip(lines, weights, strict=True):
        mass[line.box] += w
    for k in range(len(boxes) - 1, 0, -1):
        mass[boxes[k][0]] += mass[k]
    at = 0
    for k in range(1, len(boxes)):
        if boxes[k][0] == at and not boxes[at][1] and 2 * mass[k] > mass[at]:
            at = k
    return at


def main_text(page: str) -> str:
    """The article's blocks in page order, joined by one space."""
    lines, boxes = lines_of(page)
    weights = [len(x.text) if x.inside else x.plain for x in lines]
    content = content_box(lines, boxes, weights)
    held = [content == 0] * len(boxes)   # inside the content's container
    held[content] = True
    for k in range(content + 1, len(boxes)):
        held[k] |= held[boxes[k][0]]
    row: list[Line | None] = []
    before = None
    for x in lines:
        # a removed region inside the content ends nothing
        edge = not held[x.box] if x.gap else before is not None and x.inside != before
        if edge:
            row.extend([None] * WINDOW)
        if not x.gap:
            row.append(x)
            before = x.inside
    weights = [0 if x is None else len(x.text) if x.inside else x.plain for x in row]
    found = [([x for x in row[a:b] if x], sum(weights[a:b])) for a, b in stretches(weights)]
    most = max((w for _, w in found), default=0)
    return " ".join(x.text for part, w in found if w == most or _is_text(part, held if content else None) for x in part)


def _is_text(part: list[Line], held: list[bool] | None) -> bool:
    """Whether a stretch stands in the content's container ``held``, or is no less text than links;
    of a page without such a container (None) the mark lets links count as text."""
    if held and any(held[x.box] for x in part):
        return True
    return 2 * sum(len(x.text) if x.inside and not held else x.plain for x in part) >= sum(len(x.text) for x in part)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars (code points) of every page."""
    small_batches(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [main_text(h.as_py() or "") for h in b.column(2)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(got, pa.string()), pa.array([len(t) for t in got], pa.int64())],
                names=["page_id", "url", "text", "n_chars"])

    kinds = {f.name: f.dataType.simpleString() for f in pages.schema.fields}
    return pages.select("page_id", "url", "html").mapInArrow(
        run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
