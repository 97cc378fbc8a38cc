"""Main text of web pages by tag-path ratios.

Every piece of text in a page hangs on a path of tags from the root; containers count with their
class and id. Pieces with the same path are laid out alike, so content is chosen by path, not piece by
piece: for each path the length of its text and its punctuation are summed and divided by the number
of its pieces. Both ratios are smoothed along the page (a piece's value is averaged with its
neighbours'), fused into one score, less the share of the text that is in links, and paths whose score
reaches a share of the page's spread are content.

The element around all blocks on these paths, or the article or main element around that, is the
article. Inside it the paths decide as well: a container without content, such as a list of links or a
box beside the text, is left out with all that it holds; within an article or main element only if it is
mostly links. What stands beside content in the same container, such as a heading, belongs to the text.

Before that, elements that are marked as something else by their tag or role are left out, and those
whose class or id says so. A class or id is a hint only: it does not mark an element that holds nearly
all of the page's text, or the only article, main or first-level heading, or most text of a page
without these.

A null or empty page, and one without content, has an empty text. Repeated rows are extracted
each. Other columns are kept.
"""

from __future__ import annotations

import html as character_references
from collections import defaultdict
from math import exp

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterlens.llm.common import small_batches

#: Elements without an end tag.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is not markup.
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
#: Elements that never hold the main text.
SKIPPED = frozenset(
    "head script style noscript template nav footer aside form button select textarea option "
    "iframe svg math canvas audio video object menu dialog".split()
)
#: Elements that stand within a line; any other element is a block.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt "
    "ruby s samp small span strike strong sub sup time tt u var wbr br".split()
)
#: An open element of the key is closed by these start tags.
CLOSED_BY = {
    "p": frozenset(
        "address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 "
        "h6 header hr main menu nav ol p pre section table ul".split()
    ),
    "li": frozenset(["li"]),
    "dt": frozenset(["dt", "dd"]),
    "dd": frozenset(["dt", "dd"]),
    "tr": frozenset(["tr", "tbody", "tfoot"]),
    "td": frozenset(["td", "th", "tr"]),
    "th": frozenset(["td", "th", "tr"]),
    "head": frozenset(["body"]),
}
#: What closes no further than to these.
FENCES = frozenset("table td th ul ol dl div article section main body html".split())
ROLES = frozenset(
    "navigation banner contentinfo complementary search form menu menubar dialog alert".split()
)
#: Words in class and id that mark what is not the main text, where they begin or end a name.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo "
    "promotion nav navbar navigation menu breadcrumb breadcrumbs footer sidebar aside "
    "comment comments respond disqus replies cookie cookies consent gdpr masthead topbar "
    "newsletter subscription signup login pagination pager".split()
)
#: Words that mark it where a name has no other words than these, those above and those below.
WEAK_MARKS = frozenset(
    "widget reply notice notices alert popup modal overlay subscribe share sharing social related "
    "recommended hidden header feedback copyright legal disclaimer colophon toolbar discussion".split()
)
#: Words that only say where something stands, or that it is a box or list.
PLAIN = frozenset(
    "a area bar big block bottom box button buttons col column container content cta group holder "
    "inner item items left links list main outer page panel post posts right row section site slot "
    "small strip text top unit wrap wrapper".split()
)
#: Inside an article these may belong to it.
ARTICLE_WORDS = frozenset("alert notice notices header hidden legal disclaimer widget overlay".split())

#: Words in a class that make it speak of the layout, or of what is not there.
LAYOUT = frozenset("has no non not with without overflow free less layout".split())

#: Comments, declarations, and tags; a tag with an open quote ends at the next bracket.
_token = regex.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|</?([a-zA-Z][^\s/>]*)"""
    r"""((?:[^>"']|"[^"]*"|'[^']*')*+(?=>|\Z)|[^>]*)(?:>|\Z)""",
    regex.S,
)
_attribute = regex.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_mark = regex.compile(r"[a-z]+")
_punctuation = regex.compile(r"[\p{P}]")

#: Weights of neighbours when ratios are smoothed: a bell over this many pieces on either side.
REACH = 2
BELL = [exp(-(d * d) / 2.0) for d in range(-REACH, REACH + 1)]
#: A path is content if its score is at least this share of the standard deviation.
SPREAD = 0.5
#: Elements that may be the article; any other is a part of one, however long.
WHOLE = frozenset(["", "html", "body", "main", "article", "div"])
#: Elements that hold blocks; those of the second kind have a meaning of their own.
BOXES = frozenset("div section center fieldset details span".split())
HOLDERS = BOXES | frozenset("ul ol dl table figure blockquote pre header address hgroup".split())
#: A container is mostly links if more than this share of its text is.
LINKED = 0.5
#: How a line that only says whose the page is begins.
_owner = regex.compile(r"\s*(?:©|\(c\)\s|copyright\s*(?:©|\(c\)|\d{4}))", regex.I)
#: A class or id marks no element with more than the first share of the page's text; if there is no
#: article, main or h1 elsewhere, with more than the second.
NEARLY_ALL, HALF = 0.8, 0.5
LANDMARKS = frozenset(["article", "main", "h1"])


class _Element:
    __slots__ = ("tag", "parent", "path", "skipped", "article", "hints", "link")

    def __init__(
        self, tag: str, parent: _Element | None, skipped: bool, hint: bool = False, name: str = ""
    ):
        self.link = tag == "a" or bool(parent and parent.link)
        self.tag, self.parent, self.skipped = tag, parent, skipped
        #: Elements from the root to this one whose class or id marks them.
        self.hints: tuple[_Element, ...] = parent.hints if parent else ()
        if hint:
            self.hints += (self,)
        self.path = f"{parent.path}/{tag}{name if tag in HOLDERS else ''}" if parent else tag
        self.article = tag in ("article", "main") or bool(parent and parent.article)


class _Block:
    """Text between two block boundaries."""

    __slots__ = ("element", "text", "linked")

    def __init__(self, element: _Element, text: str, linked: float):
        self.element, self.text, self.linked = element, text, linked


def _marked(tag: str, attributes: str, inside: bool) -> tuple[bool, bool, str]:
    """Whether an element is marked as not being main text, whether its class or id hints so, and its
    name in a path."""
    if tag in SKIPPED or tag == "header" and not inside:
        return True, False, ""
    if tag in ("html", "body", "article", "main") or "=" not in attributes:
        return False, False, ""
    hint, names = False, []
    for name, *values in _attribute.findall(attributes):
        value = "".join(values).lower()
        name = name.lower()
        if name == "role" and value in ROLES or name == "aria-hidden" and value == "true":
            return True, False, ""
        if name in ("class", "id"):
            names += value.split()
            hint = hint or any(_hints(token, inside) for token in value.split())
    return False, hint, "." + ".".join(sorted(names)) if names else ""


def _hints(token: str, inside: bool = False) -> bool:
    """Whether a class or id means what is not main text."""
    words = _mark.findall(token)
    if not words or ":" in token or not LAYOUT.isdisjoint(words):
        return False
    if words[0] in MARKS or words[-1] in MARKS:
        return True
    weak = WEAK_MARKS - ARTICLE_WORDS if inside else WEAK_MARKS
    known = MARKS | weak
    return not known.isdisjoint(words) and all(w in known or w in PLAIN for w in words)


#: What stands between two block boundaries: pieces of text and their elements.
_Line = list[tuple[_Element, str]]


def _blocks(lines: list[_Line], marked: set[_Element]) -> list[_Block]:
    """The blocks of lines, without what is in marked elements."""
    out = []
    for line in lines:
        kept = [(e, t) for e, t in line if marked.isdisjoint(e.hints)] if marked else line
        text = " ".join(character_references.unescape("".join(t for _, t in kept)).split())
        if text:
            owner = kept[0][0]
            while owner.tag in INLINE and owner.parent:
                owner = owner.parent
            linked = sum(len(t.strip()) for e, t in kept if e.link)
            every = sum(len(t.strip()) for _, t in kept)
            out.append(_Block(owner, text, linked / max(every, 1)))
    return out


def _really_marked(lines: list[_Line], landmarks: list[_Element]) -> set[_Element]:
    """The elements that are not main text, of those whose class or id hints so."""
    held: dict[_Element, int] = defaultdict(int)
    total = 0
    for line in lines:
        for element, text in line:
            size = len(text.strip())
            total += size
            for hint in element.hints:
                held[hint] += size
    holding = {hint for e in landmarks for hint in e.hints}
    nearest = {e.hints[-1] if e.hints else None for e in landmarks}
    marked: set[_Element] = set()
    for hint, size in held.items():
        inside = hint in holding
        elsewhere = not nearest.isdisjoint((None, *hint.hints[:-1]))
        share = size / max(total, 1)
        if share <= NEARLY_ALL and (elsewhere or not inside and share <= HALF):
            marked.add(hint)
    return marked


def blocks_of(page: str) -> list[_Block]:
    """The blocks of a page in order, without what is marked as something else."""
    root = _Element("", None, False)
    stack, lines, landmarks = [root], [[]], []

    def close(block: bool = True) -> None:
        if block and lines[-1]:
            lines.append([])

    at, end = 0, len(page)
    while at < end:
        found = _token.search(page, at)
        start = found.start() if found else end
        if start > at and not stack[-1].skipped:
            lines[-1].append((stack[-1], page[at:start]))
        if not found:
            break
        at = found.end()
        if found[1] is None:
            continue
        tag = found[1].lower()
        if page[start + 1] == "/":
            close(tag not in INLINE)
            for n in range(len(stack) - 1, 0, -1):
                if stack[n].tag == tag:
                    del stack[n:]
                    break
                if tag in INLINE and stack[n].tag not in INLINE:
                    break  # an end tag of a line element closes no block
            continue
        if tag == "br" and lines[-1]:
            lines[-1].append((stack[-1], " "))
        close(tag not in INLINE)
        for n in range(len(stack) - 1, 0, -1):
            if tag in CLOSED_BY.get(stack[n].tag, ()):
                del stack[n:]
                break
            if stack[n].tag in FENCES:
                break
        if tag in VOID or found[0].endswith("/>") and tag not in RAW:
            continue
        top = stack[-1]
        skipped, hint, name = _marked(tag, found[2], top.article)
        element = _Element(tag, top, top.skipped or skipped, hint, name)
        if tag in LANDMARKS and not element.skipped:
            landmarks.append(element)
        if tag in RAW:
            stop = regex.compile(f"</{regex.escape(tag)}\\b", regex.I).search(page, at)
            at = stop.start() if stop else end
        if tag not in RAW or at < end:
            stack.append(element)
    return _blocks(lines, _really_marked(lines, landmarks))


def content_paths(blocks: list[_Block]) -> set[str]:
    """Paths whose smoothed and fused ratios reach the threshold."""
    length, marks, pieces = defaultdict(int), defaultdict(int), defaultdict(int)
    linked = defaultdict(float)
    for b in blocks:
        path = b.element.path
        length[path] += len(b.text)
        linked[path] += len(b.text) * b.linked
        marks[path] += len(_punctuation.findall(b.text))
        pieces[path] += 1

    def smoothed(ratio: list[float]) -> list[float]:
        out = []
        for n in range(len(ratio)):
            near = range(max(0, n - REACH), min(len(ratio), n + REACH + 1))
            weights = [BELL[k - n + REACH] for k in near]
            out.append(sum(w * ratio[k] for w, k in zip(weights, near, strict=True)) / sum(weights))
        return out

    texts = smoothed([length[b.element.path] / pieces[b.element.path] for b in blocks])
    points = smoothed([marks[b.element.path] / pieces[b.element.path] for b in blocks])
    scores, counts = defaultdict(float), defaultdict(int)
    for b, text, point in zip(blocks, texts, points, strict=True):
        scores[b.element.path] += text * (1 + point)
        counts[b.element.path] += 1
    fused = {p: s / counts[p] * (1 - linked[p] / length[p]) for p, s in scores.items()}
    total = sum(counts.values())
    mean = sum(fused[p] * n for p, n in counts.items()) / total
    spread = (sum(n * (fused[p] - mean) ** 2 for p, n in counts.items()) / total) ** 0.5
    least = min(SPREAD * spread, max(fused.values()))
    return {p for p, s in fused.items() if s >= least}


def article_of(blocks: list[_Block], paths: set[str]) -> _Element:
    """The element around all blocks on content paths."""
    common: list[_Element] | None = None
    for element in dict.fromkeys(b.element for b in blocks if b.element.path in paths):
        chain = []
        while element is not None:
            chain.append(element)
            element = element.parent
        chain.reverse()
        if common is None:
            common = chain
        same = (n for n, (a, b) in enumerate(zip(common, chain, strict=False)) if a is not b)
        common = common[: next(same, min(len(common), len(chain)))]
    for element in common:
        if element.tag in ("article", "main"):
            return element
    return next(e for e in reversed(common) if e.tag in WHOLE)


def selected(blocks: list[_Block]) -> list[_Block]:
    """The blocks of the article, by the paths of what they stand in."""
    paths = content_paths(blocks)
    article = article_of(blocks, paths)
    chains: list[tuple[_Block, list[_Element]]] = []
    size, linked, content = defaultdict(int), defaultdict(float), set()
    for b in blocks:
        chain, element = [], b.element
        while element is not None and element is not article:
            chain.append(element)
            element = element.parent
        if element is None:
            continue
        chains.append((b, chain))
        for e in chain:
            size[e] += len(b.text)
            linked[e] += len(b.text) * b.linked
            if b.element.path in paths or b.element.tag in ("h1", "h2") and not b.linked:
                content.add(e)
    own = article.article

    def stays(e: _Element) -> bool:
        if e in content or e.tag not in HOLDERS:
            return True
        return linked[e] <= LINKED * size[e] and (own or e.article or e.tag not in BOXES)

    return [
        b
        for b, chain in chains
        if all(map(stays, chain)) and (own or not _owner.match(b.text) or len(chains) == 1)
    ]


def main_text(page: str | None) -> str:
    """The article's blocks, one to a line."""
    blocks = blocks_of(page or "")
    return "\n".join(b.text for b in selected(blocks)) if blocks else ""


def _text_udf():
    @F.arrow_udf("string")
    def extract(pages: pa.Array) -> pa.Array:
        return pa.array([main_text(p.as_py()) for p in pages], pa.string())

    return extract


def with_main_text(pages: DataFrame, html: str = "html", into: str = "text") -> DataFrame:
    """Add the main text of each page."""
    small_batches(pages.sparkSession)
    return pages.withColumn(into, _text_udf()(F.col(html)))
