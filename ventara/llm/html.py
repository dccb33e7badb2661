"""Main text of web pages by tag-path ratios.

Every text node has a root-to-leaf path of tags with their class and id. Per path, text length, punctuation and linked text are summed
over its text nodes and divided by their number. The ratios are smoothed along the text nodes of a page, and fused to one value, lowered
by the part that is linked. The values choose the content in two steps: weighed by the text they hold, they lead from the root of the
page down to the element that holds most of it (with neighbours that hold a third as much), and inside it paths stay whose value is
a share of the best. Lists, tables and quotes go with the content round them.

Elements that are never part of an article by their tag are left out before. Two things are priors only: <article> and <main> count
PRIOR times, so other text must hold more to outweigh them, and a word such as "comments" in class, id or role lowers the values of an
element by WORD, unless it holds most of the page's punctuated text (and more than PRIOR times that of marked elements outside it).
"""

from __future__ import annotations

import html
import math
import re

from pyspark.sql import DataFrame

from ventara.llm.base import map_values

#: Share of the best value that a path needs, and weights of the neighbours at distance 0, 1 and 2 in the smoothing.
SHARE, KERNEL = 0.25, (0.4, 0.24, 0.06)
#: Part of an element's weight that one of its children must hold for the way down to go on, and part of the content's weight that makes a neighbour content.
DOMINANT, BESIDE = 0.6, 0.33
#: Factors of a marked element's weight and of the values under a word.
PRIOR, WORD = 3.0, 0.2

#: Elements by how they are treated.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe xmp noembed noframes".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead tr ul caption".split())
APART = frozenset("nav footer aside form head menu dialog button fieldset search svg select object noscript template".split())
MARKED = frozenset("article main".split())
#: An element that starts closes these open ones.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "body": ("head",)}
#: Words in class, id or role that speak against an element.
APART_WORDS = re.compile(
    r"(?i)(?<![a-z])(?:ads?|adverts?|advertisements?|advertising|banner|sponsor(?:ed)?|promo(?:tion)?s?|sidebar|side-bar|menus?|nav|navbar|navigation|breadcrumbs?|footer|comments?|disqus|replies|respond|cookies?|consent|gdpr|notices?|popup|modal|newsletter|subscribe|signup|login|share|sharing|social|related|recommended|widget|toolbar|pagination|contentinfo|complementary|masthead|site-header|page-header)(?![a-z])"
)

_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>")
_PLAIN_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
_ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_NONE = re.compile(r"(?i)display\s*:\s*none")
_DIGITS = re.compile(r"\d+")
_PUNCTUATION = re.compile(r"[.,;:!?…。，；：！？、\"'()«»„“”]")


_CONTAINERS = frozenset("html body article main section div td table ul ol dl blockquote".split())
_GROUPED = frozenset("td table ul ol dl blockquote".split())
_SCOPES = frozenset("table td th caption button object svg select noscript template".split())
_STOPS = frozenset("table ul ol dl select svg".split())


class Page:
    """Elements of a page, parents before children, and its text nodes.

    Element 0 is the page itself. Of each element: parent, tag, path (a number for each distinct way of tags with class and id), and whether
    a word speaks against it. Text nodes: (block, element, text), those that are set apart left out.
    """

    def __init__(self, source: str):
        self.parents, self.tags, self.paths, self.words = [-1], [""], [0], [False]
        self.nodes: list[tuple[int, int, str]] = []
        self._known: dict[tuple, int] = {}
        self._read(source)

    def _open(self, parent: int, tag: str, names: str) -> int:
        self.parents.append(parent)
        self.tags.append(tag)
        self.words.append(bool(names) and tag not in ("html", "body", "article", "main") and bool(APART_WORDS.search(names)))
        self.paths.append(self._known.setdefault((self.paths[parent], tag, _DIGITS.sub("", names)), len(self._known) + 1))
        return len(self.tags) - 1

    def _read(self, source: str) -> None:
        stack: list[tuple[str, bool, int]] = []  # tag, set apart, element
        apart = block = at = here = 0
        n = len(source)

        def pop() -> None:
            nonlocal apart, here
            apart -= stack.pop()[1]
            here = stack[-1][2] if stack else 0

        def close(names: tuple, stop: frozenset) -> None:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in names:
                    while len(stack) > k:
                        pop()
                    return
                if stack[k][0] in stop:
                    return

        def add(text: str) -> None:
            if not apart and text:
                self.nodes.append((block, here, html.unescape(text)))

        while at < n:
            lt = source.find("<", at)
            if lt < 0:
                add(source[at:])
                break
            if lt > at:
                add(source[at:lt])
            following = source[lt + 1 : lt + 2]
            if source.startswith("<!--", lt):
                end = source.find("-->", lt + 4)
                at = n if end < 0 else end + 3
                continue
            if following in ("!", "?") or (following == "/" and not source[lt + 2 : lt + 3].isalpha()):
                end = source.find(">", lt)
                at = n if end < 0 else end + 1
                continue
            if not (following.isascii() and (following.isalpha() or following == "/")):
                add("<")
                at = lt + 1
                continue
            found = _TAG.match(source, lt) or _PLAIN_TAG.match(source, lt)
            if not found:
                break  # a tag that the page's end cuts off
            at = found.end()
            closing, name, given = found[1], found[2].lower(), found[3]
            if name in BLOCK:
                block += 1
            if name == "br":
                add(" ")
            if closing:
                if any(x[0] == name for x in stack):
                    while stack[-1][0] != name:
                        pop()
                    pop()
                continue
            alone = given.rstrip().endswith("/") and name not in BLOCK
            if name in VOID or alone:
                continue
            if name in RAW:
                end = re.compile(rf"(?i)</{re.escape(name)}\s*>").search(source, at)
                at = end.end() if end else (at if name == "iframe" else n)
                continue
            if name in BLOCK:
                close(("svg",), frozenset())  # page elements end a drawing that was left open
                close(("p",), _SCOPES)
            if name in CLOSES:
                close(CLOSES[name], _STOPS)
            held = {k.lower(): a or b or c for k, a, b, c in _ATTRIBUTE.findall(given)} if given else {}
            hidden = "hidden" in held or held.get("aria-hidden", "").lower() == "true" or bool(_NONE.search(held.get("style", "")))
            here = self._open(here, name, " ".join(held[k] for k in ("class", "id", "role") if held.get(k)))
            stack.append((name, hidden or name in APART, here))
            apart += stack[-1][1]


def path_values(page: Page) -> dict[int, float]:
    """The fused value of every path that has text: ratios of length, punctuation and links, smoothed along the page."""
    linked = [False] * len(page.tags)
    for k in range(1, len(page.tags)):
        linked[k] = linked[page.parents[k]] or page.tags[k] == "a"
    run = [(page.paths[e], bare, linked[e]) for _, e, text in page.nodes if (bare := text.strip())]
    sums: dict[int, list] = {}
    for path, bare, link in run:
        own = sums.setdefault(path, [0, 0, 0, 0])
        own[0] += len(bare)
        own[1] += len(_PUNCTUATION.findall(bare))
        own[2] += len(bare) * link
        own[3] += 1
    ratios = [(sums[path][0] / sums[path][3], sums[path][1] / sums[path][3]) for path, _, _ in run]
    smoothed: dict[int, list] = {}
    for k, (path, _, _) in enumerate(run):
        total = length = marks = 0.0
        for d in range(-2, 3):
            if 0 <= k + d < len(run):
                weight, (a, b) = KERNEL[abs(d)], ratios[k + d]
                total, length, marks = total + weight, length + weight * a, marks + weight * b
        own = smoothed.setdefault(path, [0.0, 0.0, 0])
        own[0] += length / total
        own[1] += marks / total
        own[2] += 1
    return {p: math.log1p(a / n) * math.log(2 + b / n) * (1 - sums[p][2] / sums[p][0]) ** 2 for p, (a, b, n) in smoothed.items()}


def content(page: Page) -> set[int]:
    """Positions of the text nodes of the content."""
    values, count = path_values(page), len(page.tags)
    lengths, total = [0] * count, 0
    for _, e, text in page.nodes:
        if _PUNCTUATION.search(text):
            lengths[e] += len(text.strip())
    for k in range(count - 1, 0, -1):
        lengths[page.parents[k]] += lengths[k]
    total = lengths[0]
    marked = [tag in MARKED for tag in page.tags]
    for k in range(count - 1, 0, -1):
        marked[page.parents[k]] |= marked[k]
    told = sum(lengths[k] for k in range(1, count) if page.tags[k] in MARKED)
    factor = [1.0] * count  # by the words on the way to an element
    for k in range(1, count):
        spared = 2 * lengths[k] > total and (marked[k] or lengths[k] > PRIOR * told)
        factor[k] = min(factor[page.parents[k]], WORD if page.words[k] and not spared else 1.0)
    weights = [0.0] * count
    for _, e, text in page.nodes:
        if bare := text.strip():
            weights[e] += values[page.paths[e]] * factor[e] * len(bare)
    children: list[list[int]] = [[] for _ in range(count)]
    for k in range(count - 1, 0, -1):
        if page.tags[k] in MARKED and not any(page.tags[c] in MARKED for c in children[k]):
            weights[k] *= PRIOR
        weights[page.parents[k]] += weights[k]
        children[page.parents[k]].append(k)
    # down to the element that holds most
    root, way = 0, [0]
    while children[root]:
        best = max(children[root], key=lambda k: weights[k])
        if page.tags[best] not in _CONTAINERS or weights[best] < DOMINANT * weights[root] or not weights[best]:
            break
        root = best
        way.append(best)
    held = {root}
    if len(way) > 1:
        held |= {k for k in children[way[-2]] if page.tags[k] in _CONTAINERS and weights[k] >= BESIDE * weights[root]}
    inside, title = [False] * count, [False] * count
    real = page.tags[root] not in ("", "html", "body")
    for k in range(count):
        up = page.parents[k]
        inside[k] = k in held or up >= 0 and inside[up] and (real or page.tags[k] != "header")
        title[k] = page.tags[k] == "h1" and up in way[:-1] and page.tags[up] not in ("", "html", "body") or up >= 0 and title[up]
    chosen = [k for k, (_, e, text) in enumerate(page.nodes) if inside[e] and text.strip()]
    worth = {k: values[page.paths[page.nodes[k][1]]] * factor[page.nodes[k][1]] for k in chosen}
    best = max(worth.values(), default=0.0)
    wanted = {k for k in chosen if worth[k] >= SHARE * best}
    wanted |= _along(page, chosen, wanted, factor)
    if not any(page.tags[page.nodes[k][1]] == "h1" for k in wanted):
        wanted |= {k for k, (_, e, text) in enumerate(page.nodes) if title[e] and text.strip() and factor[e] == 1.0}
    return wanted


def _along(page: Page, chosen: list[int], wanted: set[int], factor: list[float]) -> set[int]:
    """Further text nodes of lists, tables and quotes: those between content, and those before or after it unless most of their text is links."""

    def group(e: int) -> int:
        """The outermost list, table or quote round an element, below the next other container."""
        out = -1
        while e > 0 and (page.tags[e] not in _CONTAINERS or page.tags[e] in _GROUPED):
            out = e if page.tags[e] in _GROUPED else out
            e = page.parents[e]
        return out

    first, last = min(wanted, default=0), max(wanted, default=-1)
    groups: dict[int, list[int]] = {}
    for k in chosen:
        e = page.nodes[k][1]
        if k not in wanted and factor[e] == 1.0 and (g := group(e)) >= 0:
            groups.setdefault(g, []).append(k)
    out: set[int] = set()
    for own in groups.values():
        size = [(len(page.nodes[k][2].strip()), _linked(page, page.nodes[k][1])) for k in own]
        links = sum(n for n, link in size if link)
        if first < own[0] and own[-1] < last and links < sum(n for n, _ in size) or 2 * links < sum(n for n, _ in size):
            out.update(own)
    return out


def _linked(page: Page, e: int) -> bool:
    while e > 0:
        if page.tags[e] == "a":
            return True
        e = page.parents[e]
    return False


def main_text(source: str | None) -> str:
    """The content blocks in page order, white space inside a block as one space, joined by an empty line."""
    page = Page(source or "")
    wanted = content(page)
    blocks: dict[int, list] = {}
    for k, (block, _, text) in enumerate(page.nodes):
        if k in wanted or not text.strip():
            blocks.setdefault(block, []).append(text)
    return "\n\n".join(x for x in (" ".join("".join(parts).split()) for parts in blocks.values()) if x)


def extract(df: DataFrame, keep: list[str], source: str = "html") -> DataFrame:
    """The columns `keep`, text and n_chars (code points) of every row; null or empty html give the empty text."""

    def make(sources: list) -> list:
        texts = [main_text(x) for x in sources]
        return [texts, [len(x) for x in texts]]

    return map_values(df, keep, source, [("text", "string"), ("n_chars", "bigint")], make)
