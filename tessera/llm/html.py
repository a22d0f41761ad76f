"""Main text of web pages by minimum-cut labelling.

A page becomes a sequence of text blocks. Each block has a cost for being content and one for being boilerplate, the
capacities to the two terminals. Their difference, the log-odds of content, is the sum of what the elements around a
block say by name, class and id (fixed signs) and of what its shape says: length, share of links, punctuation, kind of
element. The weights of the shape are fitted by logistic regression on blocks of a sample of the pages themselves, weakly labelled
by the signs where these are plain. Neighbours in reading order and blocks that share more of
their path than that are tied by smoothness edges. The least cut between the terminals labels the page; the content
blocks are its text.

The odds of a shape are bounded, so that a block whose shape deceives is outvoted by its neighbours unless these
are divided; a plain sign, such as an advert's class, outweighs them all. Blocks whose own odds outweigh all their edges have the same label in a least cut, so they are settled first
and their edges become costs of their neighbours; maximum flow runs on the rest. All steps take time in proportion to a page's
length but for the flow, which runs on what is left of it.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import python_ready
from tessera.llm.features import sigmoid

# Elements of HTML.
RAW = ("script", "style", "template", "textarea", "iframe", "select", "title")  # what is in them is never shown as text of the page
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
INLINE = frozenset(
    "a abbr acronym audio b bdi bdo big canvas cite code data del dfn em font i img ins kbd label map mark object picture q ruby rb rp rt s samp small span strike strong sub sup time tt u var video wbr br "
    "math mi mo mn ms mtext mrow msup msub msubsup mfrac msqrt mroot mstyle mover munder munderover semantics annotation svg g text tspan defs path circle rect line polygon polyline ellipse use desc".split()
)
ENDS_PARAGRAPH = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
ENDS_LIKE = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "tbody": ("thead", "tbody", "tr", "td", "th"), "tfoot": ("thead", "tbody", "tr", "td", "th")}
KEEPS_OPEN = frozenset("table ul ol dl article section div main aside nav footer header form body".split())
# What counts as a sign.
NEVER = frozenset("head nav footer aside form button menu dialog noscript".split())
BODY = frozenset("article main".split())
BOILERPLATE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu".split())
BOILERPLATE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner banners promo promotion promoted sponsor sponsored nav navbar navigation breadcrumb breadcrumbs masthead topbar "
    "footer sidebar rail aside widget widgets notice notices cookie cookies consent gdpr alert popup modal overlay comment comments commentlist disqus replies respond "
    "login signup subscribe newsletter share sharing social related recommended recommendations toolbar pager pagination copyright disclaimer".split()
)
#: Words that boilerplate has, and articles too: their shape decides within an article, and next to a content word they say nothing.
DOUBTFUL_WORDS = frozenset("menu menus header bottom side reply discussion form search legal tags skip".split())
CONTENT_WORDS = frozenset("article content post entry story text body main page prose".split())

TOKEN = re.compile(
    r"<!--(?:>|->|.*?(?:--!?>|\Z))|<(?P<raw>" + "|".join(RAW) + r")(?=[\s/>])(?:[^>\"'=]|=\s*+(?:\"[^\"]*\"|'[^']*')?|[\"'])*+>.*?(?:</(?P=raw)(?=[\s/>])[^>]*>|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-z][^\s/>]*)(?P<attributes>(?:[^>\"'=]|=\s*+(?:\"[^\"]*\"|'[^']*')?|[\"'])*+)>|<[!?/][^>]*>",
    re.I | re.S,
)
HINTS = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
WORD = re.compile(r"[a-z]+")
BREAK = re.compile(r"(?<=[a-z])(?=[A-Z])")

#: What a sign says: nothing, content by a word, the article by its name, doubt, boilerplate by a word, boilerplate by its name.
NONE, CONTENT, ARTICLE, DOUBT, BAD, BARRED = range(6)


@dataclass
class Block:
    element: int
    above: int  # the innermost element of its path that the block before has too
    shared: int = 0  # elements of its path that the block before has too, and all of it; inline ones don't count
    depth: int = 0
    parts: list[str] = field(default_factory=list)
    linked: int = 0
    text: str = ""
    prior: float = 0.0
    article: bool = False
    leaf: str = ""


@dataclass
class Tree:
    """Elements in the order of their start tags; a parent comes before its children."""

    parent: list[int] = field(default_factory=list)
    name: list[str] = field(default_factory=list)
    sign: list[int] = field(default_factory=list)


def _sign(name: str, attributes: str) -> int:
    if name in NEVER:
        return BARRED
    if name in BODY:
        return ARTICLE
    if name == "header":
        return BAD
    if not attributes or name in ("html", "body"):
        return NONE
    found: set[str] = set()
    for kind, *values in HINTS.findall(attributes):
        value = "".join(values)
        if kind.lower() == "role" and value.lower() in BODY:
            return ARTICLE
        if kind.lower() == "role" and value.lower() in BOILERPLATE_ROLES:
            return BARRED
        found.update(WORD.findall(BREAK.sub(" ", value).lower()))
    if found & BOILERPLATE_WORDS:
        return BAD
    doubtful, content = bool(found & DOUBTFUL_WORDS), bool(found & CONTENT_WORDS)
    return NONE if doubtful == content else CONTENT if content else DOUBT


def blocks(html: str) -> list[Block]:
    """The text blocks of a page in reading order. A line break is white space of its block."""
    out: list[Block] = []
    tree, stack = Tree(), []
    at: dict[str, list[int]] = {}  # the places in the stack of the open elements of each name
    current: Block | None = None
    done = lowest = 0  # lowest: how far the stack has been taken down since the last block began

    def text(raw: str) -> None:
        nonlocal current, lowest
        if not raw or (current is None and raw.isspace()):
            return
        if current is None:
            both = min(lowest, len(stack))
            current = Block(stack[-1] if stack else -1, stack[both - 1] if both else -1)
            lowest = len(stack)
            out.append(current)
        current.parts.append(raw)
        if at.get("a"):
            current.linked += len(raw)

    def close(names: tuple[str, ...], until: frozenset[str]) -> None:
        nonlocal lowest
        last = lambda of: max((at[n][-1] for n in of if at.get(n)), default=-1)
        place = last(names)
        if place < 0 or place < last(until - {*names}):
            return
        while len(stack) > place:
            at[tree.name[stack.pop()]].pop()
        lowest = min(lowest, place)

    end = html.rfind(">") + 1
    for m in TOKEN.finditer(html, 0, end):
        text(html[done : m.start()])
        done = m.end()
        if m["name"] is None:
            if m["raw"] and current is not None:
                current.parts.append(" ")
            continue
        name = m["name"].lower()
        if name not in INLINE:
            current = None
        elif name == "br" and current is not None:
            current.parts.append(" ")
        if m["end"]:
            close((name,), frozenset() if name in KEEPS_OPEN else KEEPS_OPEN)
            continue
        if name in VOID:
            continue
        if name in ENDS_PARAGRAPH:
            close(("p",), KEEPS_OPEN)
        if name in ENDS_LIKE:
            close(ENDS_LIKE[name], KEEPS_OPEN - {"table"} if name in ("tbody", "tfoot") else KEEPS_OPEN)
        if not m["attributes"].endswith("/") or name not in INLINE:
            tree.parent.append(stack[-1] if stack else -1)
            tree.name.append(name)
            tree.sign.append(_sign(name, m["attributes"]))
            at.setdefault(name, []).append(len(stack))
            stack.append(len(tree.name) - 1)
    text(re.sub(r"<[a-z/!?].*", "", html[done:], count=1, flags=re.I | re.S))  # a tag without an end is none
    for b in out:
        raw = "".join(b.parts)
        b.text = " ".join((unescape(raw) if "&" in raw else raw).split())
        b.linked = min(b.linked, len(raw)) * len(b.text) // max(len(raw), 1)
    levels = [0]
    for parent, name in zip(tree.parent, tree.name, strict=True):
        levels.append(levels[parent + 1] + (name not in INLINE))
    kept, shared = [], None
    for b in out:
        b.depth, b.shared = levels[b.element + 1], levels[b.above + 1]
        shared = b.shared if shared is None else min(shared, b.shared)
        if b.text:
            b.shared, shared = shared, None
            kept.append(b)
    _excuse(tree, kept)
    _priors(tree, kept)
    return kept


#: Share of the page's text, or prose, that a wrapper must hold for its sign to be excused; words of prose that a page must have for that without a heading.
MOST, PROSE_WORDS = 0.6, 25


def _excuse(tree: Tree, page: list[Block]) -> None:
    """Takes the sign from wrappers that hold the page itself: words and doubts from one with the heading and most of the text, as
    `page with-sidebar` may name one; words and `form` from one with most of the page's prose, if neither a heading nor an article with
    prose stands outside it."""
    n = len(tree.name)
    lengths, prose, headings, articles = [0] * n, [0] * n, [0] * n, [0] * n
    words = 0
    for b in page:
        e = b.element
        long = b.text[-1] in ".!?…" and b.text.count(" ") >= 4 and b.linked * 2 < len(b.text)
        words += long * (b.text.count(" ") + 1)
        if e >= 0:
            lengths[e] += len(b.text)
            prose[e] += long * len(b.text)
            headings[e] |= tree.name[e] == "h1"
    for i in range(n - 1, -1, -1):
        p = tree.parent[i]
        articles[i] += tree.sign[i] == ARTICLE and prose[i] > 0
        headings[i] = headings[i] or (tree.name[i] == "h1" and lengths[i] > 0)
        if p >= 0:
            lengths[p] += lengths[i]
            prose[p] += prose[i]
            headings[p] += headings[i]
            articles[p] += articles[i]
    total, roots = sum(len(b.text) for b in page), [i for i in range(n) if tree.parent[i] < 0]
    all_prose = sum(len(b.text) for b in page if b.text[-1] in ".!?…" and b.text.count(" ") >= 4 and b.linked * 2 < len(b.text))
    all_headings, all_articles = sum(headings[i] for i in roots), sum(articles[i] for i in roots)
    for i in range(n):
        if tree.sign[i] in (BAD, DOUBT) and tree.name[i] != "header" and headings[i] and lengths[i] > MOST * total:
            tree.sign[i] = NONE
        elif (tree.sign[i] == BAD or tree.name[i] == "form") and tree.name[i] != "header" and words >= PROSE_WORDS and prose[i] > MOST * all_prose:
            if headings[i] == all_headings and articles[i] == all_articles:
                tree.sign[i] = NONE


def _priors(tree: Tree, page: list[Block]) -> None:
    """The signs on each block's path, from the outermost element on."""
    priors: list[tuple[float, bool, bool]] = []  # log-odds, in an article, with a content word
    leaves: list[str] = []  # the innermost element that is not inline
    for p, name, sign in zip(tree.parent, tree.name, tree.sign, strict=True):
        odds, article, worded = priors[p] if p >= 0 else (0.0, False, False)
        if sign == ARTICLE:  # in a wrapper that only its words speak against
            odds, article = (max(odds, -1.0) if odds > -20 else odds) + 3, True
        elif sign == CONTENT and not worded:
            odds, worded = odds + 2, True
        elif sign == BARRED:
            odds -= 40
        elif sign == BAD:
            odds -= 1 if name == "header" and article else 14
        elif sign == DOUBT:
            odds -= 1 if article else 4
        priors.append((odds, article, worded))
        leaves.append(name if name not in INLINE else leaves[p] if p >= 0 else "")
    for b in page:
        b.prior, b.article = priors[b.element][:2] if b.element >= 0 else (0.0, False)
        b.leaf = leaves[b.element] if b.element >= 0 else ""


def shape(b: Block) -> list[float]:
    """What a block's form says: the features of the fitted weights."""
    n = min(b.text.count(" ") + 1, 200)
    return [
        1.0, float(np.log1p(n)), b.linked / len(b.text), float(b.text[-1] in ".!?…\"”»'"), float(b.leaf in ("h1", "h2", "h3")), float(b.leaf in ("p", "blockquote", "pre")),
        float(b.text[0] == "©" or b.text[:9].lower() == "copyright"),
    ]


#: Weights of shape() where the pages have no plain signs to learn from, and what the fit is drawn to: prose is long and ends sentences, menus are links.
DEFAULT = (-1.2, 0.55, -4.0, 0.5, 0.8, 0.5, -4.0)
#: How strongly fitted weights are drawn to these, in blocks. Pages of the fit and blocks of each that it looks at.
PULL, SAMPLE_PAGES, SAMPLE_BLOCKS = 20.0, 200, 200
#: Bound of the log-odds by shape, and what speaks for any block: the fit takes both classes as equally many, but text is kept in doubt.
LIMIT, LENIENCE = 3.0, 1.0
#: Smoothness: between neighbours, and for the share of the path that two blocks have in common, as far as it is over the LEAST.
NEXT, NEAR, LEAST = 0.1, 2.0, 0.8
#: How far apart in reading order blocks of one parent are tied.
REACH = 2


def lessons(html: str | None) -> list[tuple[list[float], int]]:
    """(shape, 0 or 1) of the blocks that signs alone settle; evenly spaced ones of a long page."""
    found = [(b, b.prior > 0) for b in blocks(html or "") if b.prior >= 3 or b.prior <= -6]
    step = max(1, -(-len(found) // SAMPLE_BLOCKS))
    return [(shape(b), int(y)) for b, y in found[::step]]


def fit(rows: list[tuple[list[float], int]]) -> tuple[float, ...]:
    """The weights of shape(), by Newton steps on the logistic loss of both classes in equal parts plus a pull to DEFAULT."""
    y = np.array([r[1] for r in rows], float)
    if len(set(y.tolist())) < 2:
        return DEFAULT
    x, start = np.array([r[0] for r in rows]), np.array(DEFAULT)
    weight = np.where(y > 0, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    w = start.copy()
    for _ in range(50):
        p = sigmoid(x @ w)
        gradient = x.T @ (weight * (p - y)) + PULL * (w - start)
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + PULL * np.eye(len(w)), gradient)
        w = w - step * min(1.0, 2.0 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-6:
            break
    return tuple(w.tolist())


def odds(b: Block, weights: tuple[float, ...] = DEFAULT) -> float:
    """The classifier: log-odds of content by signs and shape, the latter within LIMIT. A paragraph that is a link is no menu."""
    f = shape(b)
    form = sum(w * x for w, x in zip(weights, f, strict=True)) + LENIENCE
    if b.leaf in ("p", "h1", "h2", "h3") or b.article and b.leaf in ("li", "td", "th"):
        form -= weights[2] * f[2] * 0.5
    return b.prior + max(-LIMIT, min(LIMIT, form))


def edges(page: list[Block]) -> list[tuple[int, int, float]]:
    out = []
    for i, b in enumerate(page):
        shared = len(b.text) + b.depth
        for j in range(i + 1, min(i + 1 + REACH, len(page))):
            shared = min(shared, page[j].shared)
            depth = max(b.depth, page[j].depth, 1)
            weight = (NEXT if j == i + 1 else 0.0) + NEAR * max(0.0, (shared + 1) / depth - LEAST) * (2.0 if j == i + 1 else 1.0)
            if weight > 0:
                out.append((i, j, weight))
    return out


def cut(costs: list[float], ties: list[tuple[int, int, float]]) -> list[bool]:
    """Which nodes are on the source's side of a least cut. costs: log-odds, the capacity from the source if positive,
    to the sink if negative; ties: undirected edges."""
    n = len(costs)
    around: list[dict[int, float]] = [{} for _ in range(n)]
    for i, j, w in ties:
        around[i][j] = around[i].get(j, 0.0) + w
        around[j][i] = around[j].get(i, 0.0) + w
    cost, label = list(costs), [None] * n
    total = [sum(a.values()) for a in around]
    queue = deque(range(n))
    while queue:
        i = queue.popleft()
        if label[i] is not None or abs(cost[i]) < total[i]:
            continue
        label[i] = cost[i] >= 0
        for j, w in around[i].items():
            if label[j] is None:
                cost[j] += w if label[i] else -w
                total[j] -= w
                queue.append(j)
    rest = [i for i in range(n) if label[i] is None]
    if rest:
        _flow(rest, cost, around, label)
    return label


def _flow(rest: list[int], cost: list[float], around: list[dict[int, float]], label: list) -> None:
    """Labels `rest` by maximum flow: blocking flows on the levels of the residual graph (Dinitz 1970)."""
    inside = set(rest)
    room = {i: {j: w for j, w in around[i].items() if j in inside} for i in rest}
    give, take = {i: max(cost[i], 0.0) for i in rest}, {i: max(-cost[i], 0.0) for i in rest}
    tiny = 1e-9
    while True:
        level, queue = {i: 0 for i in rest if give[i] > tiny}, deque(i for i in rest if give[i] > tiny)
        reached = False
        while queue:
            u = queue.popleft()
            reached = reached or take[u] > tiny
            for v, c in room[u].items():
                if c > tiny and v not in level:
                    level[v] = level[u] + 1
                    queue.append(v)
        if not reached:
            break
        left = {i: iter([*room[i]]) for i in level}
        for s in [i for i, d in level.items() if d == 0]:
            path = [s]
            while path and give[s] > tiny:
                u = path[-1]
                if take[u] > tiny:
                    flow = min([give[s], take[u], *(room[a][b] for a, b in zip(path, path[1:], strict=False))])
                    give[s] -= flow
                    take[u] -= flow
                    for a, b in zip(path, path[1:], strict=False):
                        room[a][b] -= flow
                        room[b][a] += flow
                    first = next((k for k, (a, b) in enumerate(zip(path, path[1:], strict=False)) if room[a][b] <= tiny), None)
                    if first is not None:
                        del path[first + 1 :]
                    continue
                ahead = next((v for v in left[u] if room[u][v] > tiny and level.get(v) == level[u] + 1), None)
                if ahead is None:
                    path.pop()
                else:
                    path.append(ahead)
    for i in rest:
        label[i] = i in level


def main_text(html: str | None, weights: tuple[float, ...] = DEFAULT) -> str:
    """The content blocks of a page, joined by a line feed."""
    page = blocks(html or "")
    kept = cut([odds(b, weights) for b in page], edges(page))
    return "\n".join(b.text for b, keep in zip(page, kept, strict=True) if keep)


def learn(pages: DataFrame, html: str = "html") -> tuple[float, ...]:
    """fit() on SAMPLE_PAGES pages, or on all if there are fewer: those with the least 64-bit hashes of html and row, so that equal pages of
    different rows are drawn one by one and what is drawn never grows with the table. At most SAMPLE_BLOCKS shapes of each reach the driver.
    DEFAULT where no page drawn has both kinds of blocks, as for null, empty and signless pages.
    """
    python_ready(pages.sparkSession)
    row = [c for c, t in pages.dtypes if not t.startswith(("map", "array", "struct", "variant"))]
    chosen = pages.where(F.col(html).isNotNull()).select(F.col(html), F.xxhash64(*row).alias("_h")).orderBy("_h", html).limit(SAMPLE_PAGES)

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            found = [r for x in f.iloc[:, 0] for r in lessons(x)]
            if found:
                yield pd.DataFrame({"x": pd.Series([r[0] for r in found], dtype=object), "y": [r[1] for r in found]})

    rows = chosen.mapInPandas(each, "x array<double>, y int").collect()
    return fit(sorted((list(r["x"]), r["y"]) for r in rows))


def extract(pages: DataFrame, html: str = "html", into: str = "text", weights: tuple[float, ...] | None = None) -> DataFrame:
    """`pages` with the column `into`: the main text of `html`; empty where there is none, as for null and empty pages.

    A column of that name is replaced. Given the weights, which are learned from the pages if not given, each row is on its own:
    repeated rows get equal texts, extra columns stay.
    """
    python_ready(pages.sparkSession)
    w = weights or learn(pages, html)

    @F.pandas_udf("string")
    def each(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            yield pd.Series([main_text(x, w) for x in s], dtype=object)

    return pages.withColumn(into, each.asNondeterministic()(F.col(html)))
