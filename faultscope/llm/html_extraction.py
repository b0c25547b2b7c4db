"""HTML extraction: a minimum cut separates the blocks of the main text from the rest of a page."""

from __future__ import annotations

import math
import re
from collections import deque
from dataclasses import dataclass, field
from html import unescape

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from faultscope.llm.arrow_columns import with_text_columns

# A comment, an element whose content is no markup, a tag, or a declaration.
TOKEN = re.compile(
    r"<!--.*?(?:--!?>|\Z)"
    r"|<(?P<raw>script|style|noscript|template|textarea|iframe|select|object|canvas|audio|video|xmp|noembed|noframes)"
    r"(?=[\s/>])[^>]*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-z][^\s/>]*)(?P<rest>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>"
    r"|<(?P<end2>/?)(?P<name2>[a-z][^\s/>]*)(?P<rest2>[^>]*)(?:>|\Z)"
    r"|<[!?][^>]*(?:>|\Z)|</[^a-z][^>]*(?:>|\Z)",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"(class|id|role|itemprop|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
# Elements that are part of a line of text; all others begin and end blocks.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark meter nobr output picture "
    "progress q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br".split()
)
VOID = frozenset("area base br col embed hr img input keygen link meta param source track wbr".split())
# Elements that a following one of these ends, and the elements that keep them open.
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"),
        "th": ("td", "th"), "option": ("option",), "body": ("head",)}
KEEPS = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table", "tr"), "th": ("table", "tr")}
# Elements whose text is never main text.
NEVER = frozenset("head title button fieldset dialog menu nav input legend datalist optgroup option svg annotation annotation-xml".split())
# Roots of drawings and formulas: what they hold is part of a line, and a slash at the end of a tag closes it. Elements in
# them that hold HTML again, and HTML elements that end them where they are left open.
FOREIGN = frozenset(("svg", "math"))
HOLDS_HTML = frozenset("foreignobject desc title mi mo mn ms mtext annotation-xml".split())
ENDS_FOREIGN = frozenset(
    "b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p "
    "pre ruby s small span strong strike sub sup table tt u ul var article section main aside header footer nav form".split()
)
PAGE_PARTS = frozenset("footer header aside".split())
# Words of class, id and role that speak against an element, and those that speak for it.
AGAINST = re.compile(
    r"(?:^|[\s_-])(?:ads?|adv|advert\w*|adsense|sponsor\w*|promo\w*|banner|nav\w*|menu\w*|side-?bar\w*|aside|footer\w*|foot|"
    r"header|masthead|top-?bar|breadcrumbs?|crumbs?|cookies?|consent|gdpr|notices?|alert|pop-?up|modal|overlay|newsletter|"
    r"subscri\w*|sign-?up|log-?in|share|sharing|social|related|recommend\w*|more-?stories|comments?|disqus|repl(?:y|ies)|respond|"
    r"discussion|pagination|pager|search|widgets?|toolbar|legal|copyright|disclaimer|tags?|tag-?cloud|skip\w*|hidden|"
    r"complementary|contentinfo|navigation|advertisement|teaser|outbrain|taboola)(?=$|[\s_-])",
    re.I,
)
FOR = re.compile(
    r"(?:^|[\s_-])(?:article\w*|main|content|post|entry|story|text|body|prose|blog|page-?content|post-?content|articlebody)(?=$|[\s_-])",
    re.I,
)
OWN_HEADER = re.compile(r"(?:^|(?<=[\s_-]))(?:article|post|entry|story|content|title)?[_-]?header(?=$|[\s_-])", re.I)
INLINE_AGAINST = re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|share|sharing|hidden|sr-only)(?=$|[\s_-])", re.I)
# Names of boxes that hold articles of their own.
BOX = re.compile(r"comment|repl(?:y|ies)|teaser|related|recommend|promo|sponsor|advert", re.I)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# Log odds against the text of an element that AGAINST or its kind speaks against, and the weight of article text beside it.
COST = 7.0
MAIN_WEIGHT = 3


@dataclass(slots=True)
class Element:
    """An open element: its place in the tree and what its ancestors and itself say about main text."""

    name: str
    parent: "Element | None"
    number: int
    depth: int
    dropped: bool = False
    against: bool = False
    main: int = 0
    named_main: bool = False
    # The innermost doubtful element and the innermost article, itself or above; what a doubtful one costs.
    doubtful: "Element | None" = None
    article: "Element | None" = None
    box: bool = False
    cost: float = 0.0
    # An element of a drawing or formula, and any element in one, which is part of a line.
    foreign: bool = False
    line: bool = False


@dataclass(slots=True)
class Block:
    """A run of text between block boundaries, as it stands in ``element``."""

    element: Element
    parts: list[str] = field(default_factory=list)
    link_chars: int = 0
    text: str = ""


def _opened(name: str, rest: str, parent: Element, number: int) -> Element:
    """An element below ``parent``, judged by its name and attributes."""
    e = Element(
        name, parent, number, parent.depth + 1, parent.dropped, parent.against, parent.main, parent.named_main, parent.doubtful, parent.article
    )
    e.foreign = name in FOREIGN or parent.foreign and parent.name not in HOLDS_HTML
    e.line = name in FOREIGN or parent.line
    if name in NEVER:
        e.dropped = True
    elif name in PAGE_PARTS:
        # A header of an article holds its title; a footer or aside never holds main text.
        e.against = e.against or name != "header" or not e.main
    elif name in ("article", "main"):
        e.main += 1
        e.article = e
    elif name == "form":
        e.doubtful = e
    if rest and "=" in rest or rest and "hidden" in rest:
        found = {k.lower(): a or b or c for k, a, b, c in ATTRIBUTE.findall(rest)}
        if "hidden" in found or found.get("aria-hidden") == "true" or "display:none" in found.get("style", "").replace(" ", ""):
            e.dropped = True
        named = " ".join(found.get(k, "") for k in ("class", "id", "role", "itemprop")).strip()
        if named and name in INLINE:
            e.dropped = e.dropped or bool(INLINE_AGAINST.search(named))
        elif named and name not in ("html", "body") and not e.foreign:
            if name in ("article", "main"):
                # The reader's own articles are comments.
                if BOX.search(named):
                    e.doubtful = e
            elif AGAINST.search(named):
                # The header of an article or a post holds its title.
                if not ((e.main or e.named_main) and not AGAINST.search(OWN_HEADER.sub(" ", named))):
                    e.doubtful = e
                    e.box = bool(BOX.search(named))
                    e.named_main = e.named_main or bool(FOR.search(named))
            elif FOR.search(named):
                e.named_main = True
    return e


def page_blocks(html: str) -> list[Block]:
    """The blocks of a page in order, without those of elements that never hold main text."""
    root = Element("", None, 0, 0)
    stack = [root]
    blocks: list[Block] = []
    current: Block | None = None
    links = number = at = 0

    def close(to: int) -> None:
        nonlocal links
        for e in stack[to:]:
            links -= e.name == "a"
        del stack[to:]

    while token := TOKEN.search(html, at):
        if token.start() > at:
            current = _add_text(html[at : token.start()], stack[-1], blocks, current, links)
        at = token.end()
        name = (token["name"] or token["name2"] or "").lower()
        top = stack[-1]
        within = top.foreign and top.name not in HOLDS_HTML
        if not name:
            if within and token["raw"] and (tag := html[token.start() : html.find(">", token.start()) + 1]).endswith("/>"):
                at = token.start() + len(tag)
                continue
            if token["raw"] and token["raw"].lower() not in INLINE:
                current = None if token["raw"].lower() in ("iframe", "object", "video", "textarea", "select") else current
            continue
        end = token["end"] or token["end2"]
        rest = token["rest"] or token["rest2"] or ""
        if within and name in (("p", "br") if end else ENDS_FOREIGN):
            k = len(stack) - 1
            while stack[k - 1].foreign and stack[k - 1].name not in HOLDS_HTML:
                k -= 1
            close(k)
            within = False
        inline = name in INLINE or name in FOREIGN or (_holds(stack, name) if end else stack[-1].line)
        if not inline:
            current = None
        if end:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].name == name:
                    close(k)
                    break
                if inline and not (stack[k].name in INLINE or stack[k].line):
                    break
            continue
        if (within or name in FOREIGN) and rest.endswith("/"):
            continue
        if name == "br" and current is not None:
            current.parts.append(" ")
        if name in VOID:
            continue
        if not inline:
            _end_implied(name, stack, close)
        number += 1
        stack.append(_opened(name, rest, stack[-1], number))
        links += name == "a"
    if at < len(html):
        _add_text(html[at:], stack[-1], blocks, current, links)
    for block in blocks:
        block.text = " ".join(unescape("".join(block.parts)).split())
    return [b for b in blocks if b.text]


def _holds(stack: list[Element], name: str) -> bool:
    """Whether an end tag closes an element of the drawing or formula that is open."""
    for e in reversed(stack):
        if e.name == name or not e.line:
            return e.line
    return False


def _end_implied(name: str, stack: list[Element], close) -> None:
    """Close what a new block element ends: an open paragraph or heading, and items of its own kind."""
    for k in range(len(stack) - 1, 0, -1):
        if stack[k].name == "p":
            close(k)
            break
        if stack[k].name not in INLINE:
            break
    ended, keeps = ENDS.get(name, ()), KEEPS.get(name, ())
    if ended:
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].name in ended:
                close(k)
                break
            if stack[k].name in keeps:
                break


def _add_text(text: str, element: Element, blocks: list[Block], current: Block | None, links: int) -> Block | None:
    holder = element
    while (holder.name in INLINE or holder.line) and holder.parent is not None:
        if holder.dropped:
            return current
        holder = holder.parent
    if element.dropped:
        return current
    if current is None:
        if text.isspace():
            return None
        current = Block(holder)
        blocks.append(current)
    current.parts.append(text)
    if links:
        current.link_chars += len(text.strip())
    return current


def weigh_doubts(blocks: list[Block]) -> None:
    """Set the cost of doubtful elements: the less, the more of the page's text they hold.

    A wrapper is told from a box by what it holds. One with an article inside is measured by its largest
    article against the largest of the page; an article that is doubtful itself by its share of the text of
    all articles; any other by its share of all text, where a single block is no wrapper. Text that is called
    main beside the element, with no other doubt than the element's own surroundings, counts against it.
    """
    doubts = {b.element.doubtful.number: b.element.doubtful for b in blocks if b.element.doubtful}
    for e in list(doubts.values()):
        while (e := e.parent.doubtful) is not None and e.number not in doubts:
            doubts[e.number] = e
    if not doubts:
        return
    articles: dict[int, int] = {}
    homes: dict[int, Element | None] = {}
    inside, count, beside = ({n: 0 for n in [0, *doubts]} for _ in range(3))
    for b in blocks:
        e = b.element
        if e.against:
            continue
        size = max(0, len(b.text) - b.link_chars)
        home = e.doubtful.number if e.doubtful else 0
        inside[home] += size
        count[home] += 1
        if e.main or e.named_main:
            beside[home] += size * (MAIN_WEIGHT if e.main else 1)
        if e.article:
            articles[e.article.number] = articles.get(e.article.number, 0) + size
            homes[e.article.number] = e.article.doubtful
    best, every = max(articles.values(), default=0), sum(articles.values())
    largest = {n: 0 for n in [0, *doubts]}
    for number, size in articles.items():
        home = homes[number].number if homes[number] else 0
        largest[home] = max(largest[home], size)
    order = sorted(doubts)
    around = {0: beside[0]}
    for n in order:
        above = doubts[n].parent.doubtful
        around[n] = around[above.number if above else 0] + beside[n]
    for n in reversed(order):
        above = doubts[n].parent.doubtful
        home = above.number if above else 0
        inside[home] += inside[n]
        count[home] += count[n]
        largest[home] = max(largest[home], largest[n])
    for n in order:
        e = doubts[n]
        clean = around[n] - beside[n]
        if e.article is e:
            own, rivals = articles.get(n, 0), every - articles.get(n, 0)
        elif largest[n]:
            own, rivals = largest[n], 0 if largest[n] == best else best * (MAIN_WEIGHT if e.box else 1)
        else:
            own, rivals = inside[n], inside[0] - inside[n]
            own *= 1 - 1 / max(1, count[n]) ** 2
        share = own / (own + rivals + clean) if own else 0.0
        e.cost = max(COST * (1 - share**2), e.parent.doubtful.cost if e.parent.doubtful else 0.0)


def against(element: Element) -> float:
    """Log odds against the text of an element from its kind and names, and those of its ancestors."""
    return COST if element.against else element.doubtful.cost if element.doubtful else 0.0


def evidence(block: Block) -> float:
    """Log odds that a block is main text, from its place, its kind and its share of linked text."""
    e, size = block.element, len(block.text)
    linked = min(1.0, block.link_chars / size)
    score = -against(e)
    if e.main:
        score += 4.0
    elif e.named_main:
        score += 2.5
    if e.name in HEADINGS:
        score += 0.3
    elif e.name in ("p", "pre", "blockquote"):
        score += 0.5
    elif e.name == "li":
        score -= 0.5
    else:
        score -= 0.3
    score += min(2.0, size / 100.0) - 0.6
    score -= (1.0 if e.main else 4.0) * linked
    return score


def _proximity(a: Block, b: Block) -> float:
    """Smoothness between two blocks: the closer their elements in the tree, the larger; 0 across page parts."""
    x, y = a.element, b.element
    if bool(x.main) != bool(y.main):
        return 0.0
    if x is y:
        return 1.0
    alike = 1.0 - abs(against(x) - against(y)) / COST
    steps = 0
    while x is not y:
        if x.depth >= y.depth:
            x = x.parent
        else:
            y = y.parent
        steps += 1
    return alike / steps if x.depth > 0 else 0.0


def smoothness_edges(blocks: list[Block]) -> list[tuple[int, int, float]]:
    """Edges between neighbours on the page, and between successive blocks below the same parent element."""
    edges = []
    last: dict[int, int] = {}
    for i, block in enumerate(blocks):
        if i and (weight := _proximity(blocks[i - 1], block)):
            edges.append((i - 1, i, weight))
        parent = (block.element.parent or block.element).number
        before = last.get(parent)
        if before is not None and before < i - 1 and (weight := _proximity(blocks[before], block)):
            edges.append((before, i, weight / 2))
        last[parent] = i
    return edges


def minimum_cut(gains: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Which nodes are on the source's side of a minimum cut.

    A node's gain is the capacity from the source if positive, and to the sink if negative (the
    common part of both terminal capacities flows straight through). The maximum flow is found in phases of
    shortest paths: each phase numbers the nodes by their distance to the sink once and saturates all shortest paths, which
    are as short on a page as the few blocks that one block's gain can outweigh.
    """
    n = len(gains)
    if all(g <= 0 for g in gains) or all(g >= 0 for g in gains):
        return [any(g > 0 for g in gains)] * n
    if not edges:
        return [g > 0 for g in gains]
    # Arcs 2k and 2k + 1 are edge k in both directions.
    room: list[float] = []
    ends: list[int] = []
    arcs: list[list[int]] = [[] for _ in range(n)]
    for a, b, weight in edges:
        arcs[a].append(len(ends))
        arcs[b].append(len(ends) + 1)
        ends += (b, a)
        room += (weight, weight)
    left = list(gains)
    tiny = 1e-9
    while True:
        distance = _distances(left, arcs, ends, room, tiny)
        sources = [v for v in range(n) if left[v] > tiny and distance[v] >= 0]
        if not sources:
            break
        following = [0] * n
        for source in sources:
            _push(source, left, arcs, ends, room, distance, following, tiny)
    # The source's side: all that can still be reached from nodes with capacity left.
    side = [g > tiny for g in left]
    queue = deque(i for i in range(n) if side[i])
    while queue:
        for arc in arcs[queue.popleft()]:
            b = ends[arc]
            if room[arc] > tiny and not side[b]:
                side[b] = True
                queue.append(b)
    return side


def _distances(left: list[float], arcs: list[list[int]], ends: list[int], room: list[float], tiny: float) -> list[int]:
    """Steps from each node to one with capacity to the sink, over arcs with room; -1 where there is no way."""
    distance = [0 if g < -tiny else -1 for g in left]
    queue = deque(v for v, d in enumerate(distance) if not d)
    while queue:
        b = queue.popleft()
        for arc in arcs[b]:
            # The arc from the other end to this node is the twin.
            a = ends[arc]
            if distance[a] < 0 and room[arc ^ 1] > tiny:
                distance[a] = distance[b] + 1
                queue.append(a)
    return distance


def _push(source: int, left: list[float], arcs: list[list[int]], ends: list[int], room: list[float], distance: list[int], following: list[int], tiny: float) -> None:
    """Send what the source has left along shortest paths; ``following`` skips the arcs of a node that lead nowhere in this phase."""
    path: list[int] = []
    node = source
    while left[source] > tiny:
        if distance[node] == 0 and left[node] < -tiny:
            flow = min(left[source], -left[node], *(room[arc] for arc in path))
            left[source] -= flow
            left[node] += flow
            for arc in path:
                room[arc] -= flow
                room[arc ^ 1] += flow
            path, node = [], source
            continue
        # A sink that has taken all it can leads nowhere.
        own = arcs[node] if distance[node] else []
        while following[node] < len(own):
            arc = own[following[node]]
            if room[arc] > tiny and distance[ends[arc]] == distance[node] - 1:
                break
            following[node] += 1
        if following[node] < len(own):
            path.append(own[following[node]])
            node = ends[path[-1]]
        elif path:
            node = ends[path.pop() ^ 1]
            following[node] += 1
        else:
            return


def terminal_costs(score: float) -> tuple[float, float]:
    """Cost of calling a block boilerplate, and of calling it main text: its losses under the classifier."""
    boilerplate = math.log1p(math.exp(min(score, 30.0)))
    return boilerplate, boilerplate - score


def main_text(html: str | None) -> str:
    """The main text of a page: its blocks on the content side of the cut, joined by two newlines."""
    if not html:
        return ""
    blocks = page_blocks(html)
    weigh_doubts(blocks)
    costs = [terminal_costs(evidence(b)) for b in blocks]
    kept = minimum_cut([lost - taken for lost, taken in costs], smoothness_edges(blocks))
    return "\n\n".join(b.text for b, keep in zip(blocks, kept) if keep)


def extract_main_text(pages: DataFrame, html: str = "html", name: str = "text") -> DataFrame:
    """Add the main text of every page, its blocks joined by two newlines; all other columns but ``html`` pass unchanged, a
    column named as the text is replaced. No shuffle.

    Each page is a graph of its own: blocks are nodes, the classifier's costs are their terminal
    capacities, neighbourhood on the page and in the tree are smoothness edges, and the minimum cut
    labels the blocks. Forms and names such as sidebar are costs, which fall with the share of the page's articles, or
    without articles of its text, that an element holds: a wrapper of the whole page costs next to nothing. The text of
    formulas is kept but for their annotations, which no reader sees; drawings are dropped up to their end. Null, empty and markup-only pages give the empty text; repeated rows give equal texts.
    """
    extracted = with_text_columns(
        pages, html, [T.StructField(name, T.StringType())], lambda: lambda part: [[main_text(h) for h in part]]
    )
    return extracted.select(*[c for c in pages.columns if c not in (html, name)], name)
