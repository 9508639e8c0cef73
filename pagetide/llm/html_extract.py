"""Main text of web pages by minimum-cut labelling.

1. A page is cut to blocks of text, and its containers make a tree above them.
2. A classifier, logistic regression on figures of a block's own text, gives what it costs to call the block boilerplate or
   content. It is fitted to a bounded sample of the pages' blocks: those within an article or main element against all
   others, while the classifier itself never sees containers. These costs are the blocks' capacities to the two terminals.
3. What a container's name, role and class say is its own capacity. Edges tie containers to what they hold, and blocks to
   those that follow; they are the stronger, the nearer two blocks lie in the DOM and the more a container is known to be
   of one kind.
4. The minimum cut, which is what a maximum flow between the terminals leaves saturated, labels blocks and containers at
   once. As the graph is a tree with a chain through its leaves, it is found exactly and in linear time, by eliminating
   containers one by one with the label of each and of its first and last block.
"""

from __future__ import annotations

import math
import re
from html import unescape
from operator import mul

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagetide.llm.common import table

#: Pages that the classifier is fitted to, about, and blocks taken of each.
TRAINING_PAGES = 2_000
PAGE_BLOCKS = 100
SEED = 9

#: A tag without a stray quote; any other goes through attributes() step by step.
TAG = re.compile(r"""<(/?)([A-Za-z][^\s/><]*+)((?:[\s/]++(?:[^\s=<>"'/]++(?:\s*+=\s*+(?:"[^"<>]*+"|'[^'<>]*+'|[^\s<>"']++))?+)?+)*+)>""")
START = re.compile(r"<(?:!--|[!?]|/?[A-Za-z])")
NAME = re.compile(r"</?([A-Za-z][^\s/>]*)")
ATTRIBUTE = re.compile(r"""[\s/]*+(?:([^\s/>][^\s/>=]*+)(?:\s*+=\s*+(?:(["'])|([^\s>]*+)))?+)?+""")
PAIR = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no text of the page. Those of RAW end at their end tag only, or with the page.
RAW = frozenset("script style textarea title iframe noscript xmp noembed noframes".split())
OPAQUE = RAW | frozenset("template object svg math select canvas audio video".split())
SPACED = frozenset("svg math canvas object iframe select".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
#: What a start tag closes if it is open in scope, and what opens a new scope.
CLOSES = {"li": ("li",), "dt": ("dd",), "dd": ("dd",), "tr": ("td", "tr"), "td": ("td",), "th": ("td",), "option": ("option",)}
KIND = {"p": "p", "li": "li", "dt": "dd", "dd": "dd", "tr": "tr", "td": "td", "th": "td", "option": "option"}
SCOPES = {"p": frozenset("td th li div article section button body".split()), "li": frozenset(("ul", "ol", "menu")), "dd": frozenset(("dl",)), "tr": frozenset(("table",)), "td": frozenset(("tr", "table")), "option": frozenset(("select",))}
BOUNDS = {name: tuple(k for k, names in SCOPES.items() if name in names) for name in frozenset().union(*SCOPES.values())}

BOILERPLATE_TAGS = frozenset("nav header footer aside form button dialog menu fieldset".split())
BOILERPLATE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
BOILERPLATE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer header masthead menu modal nav navbar navigation newsletter notice "
    "pagination popup promo promotion recommended related reply replies respond share sharing sidebar signup social sponsor sponsored subscribe toolbar widget gdpr disclaimer".split()
)
#: Words that say the same beside a word for content.
FIRM_WORDS = BOILERPLATE_WORDS - frozenset("banner header modal notice popup promotion recommended related widget disclaimer".split())
CONTENT_WORDS = frozenset("article content entry post story main body text".split())
#: Words of names that only tell where something is or how it is built.
FRAME_WORDS = frozenset("area bar block bottom box btn button buttons card cards column container details form group holder icon icons inner item items js l layer left link links list module msg outer panel policy posts primary reader row secondary section site slot small thread top right user unit wrap wrapper".split())

#: How a container is marked: its capacity to boilerplate, to content, and the strength of its edges to what it holds.
SURE = 1e6
NEUTRAL, FIRM, LOOSE, LEANING, BODY, NAMED = (0.0, 0.0, 0.5), (SURE, 0.0, 6.0), (1.5, 0.0, 1.0), (4.0, 0.0, 2.5), (0.0, SURE, 2.5), (0.0, 20.0, 1.5)
#: The edge between blocks that follow each other in one container.
ADJACENT = 1.0
#: A block's own capacity at most.
MOST = 2.0


class Element:
    __slots__ = ("name", "parent", "units", "mark", "region", "scope")

    def __init__(self, name: str, parent: Element | None, mark=NEUTRAL, region: int = 0):
        self.name, self.parent, self.units, self.mark, self.region = name, parent, [], mark, region
        scope = parent.scope if parent else {}
        if (bounds := BOUNDS.get(name)) and any(k in scope for k in bounds):
            scope = {k: v for k, v in scope.items() if k not in bounds}
        if kind := KIND.get(name):
            scope = {**scope, kind: self}
        self.scope: dict[str, Element] = scope


class Block:
    __slots__ = ("parts", "linked", "home", "length", "text", "place")

    def __init__(self, home: Element):
        self.parts: list[str] = []
        self.linked, self.length, self.home, self.text, self.place = 0, 0, home, "", -1


def token_mark(token: str):
    """What a class or id says: a name of boilerplate, perhaps one, a name of content, or nothing."""
    words = [w for w in re.split(r"[^a-z]+", token) if w]
    found = [w in BOILERPLATE_WORDS for w in words]
    if not any(found):
        return NAMED if words and any(w in CONTENT_WORDS for w in words) and all(w in CONTENT_WORDS or w in FRAME_WORDS for w in words) else NEUTRAL
    if any(w in ("no", "has", "with", "without") for w in words):
        return NEUTRAL
    if all(b or w in FRAME_WORDS for w, b in zip(words, found, strict=True)):
        return FIRM
    firm = any(w in FIRM_WORDS for w in words)
    if all(b or w in FRAME_WORDS or w in CONTENT_WORDS for w, b in zip(words, found, strict=True)):
        return FIRM if firm else LOOSE
    return LEANING if firm else LOOSE


def marked(name: str, attributes: str, above: Element):
    """An element's mark and region: 1 within boilerplate, 2 where its tag says so, 3 if hidden; -1 within content, -2 where a name there casts doubt.

    Boilerplate holds all it holds; only a main element frees itself, from a mere name above it. Content holds what nothing
    speaks against.
    """
    region = above.region
    if region >= 2 or region == 1 and name != "main":
        return FIRM, region
    if name in BOILERPLATE_TAGS:
        return FIRM, 2
    mark = BODY if name in ("main", "article") else NEUTRAL
    if attributes and name not in ("html", "body"):
        for m in PAIR.finditer(attributes):
            key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
            if key == "hidden" and value != "until-found" or key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
                return FIRM, 3
            if key == "role" and value in BOILERPLATE_ROLES:
                return FIRM, 2
            if key == "role" and value in ("main", "article"):
                mark = BODY
            if key in ("class", "id") and name != "main":
                for token in value.split():
                    own = token_mark(token)
                    if own is FIRM or own is LEANING and mark is not FIRM or own is LOOSE and mark[0] < LOOSE[0] or own is NAMED and mark is NEUTRAL:
                        mark = own if mark is not BODY or own is not NAMED else mark
    if mark is FIRM:
        return mark, 1
    if mark is BODY or region == -1 and mark[0] == 0:
        return BODY, -1
    if region < 0:
        return (mark[0], mark[1], BODY[2]), -2
    return mark, region


def attributes(html: str, at: int, last: dict[str, int]) -> tuple[str, int]:
    """The attributes from at on, each as name="value", and where the tag ends. A quote that nothing closes is no quote."""
    out = []
    while at < len(html) and html[at] != ">":
        m = ATTRIBUTE.match(html, at)
        if m.end() == at:
            at += 1
            continue
        at, value = m.end(), m[3]
        if m[2]:
            if last[m[2]] > m.end() - 1:
                close = html.index(m[2], at)
                value, at = html[at:close], close + 1
            else:
                value = ""
        if m[1]:
            out.append(f"{m[1]}='{value}'" if value and '"' in value else f'{m[1]}="{value or ""}"')
    return " ".join(out), min(at + 1, len(html))


def tags(html: str):
    """(begin, end, whether it is an end tag, name, attributes) of each tag in turn; comments and declarations have no name. Nothing is read twice, but for one tag."""
    at, end, last = 0, len(html), {q: html.rfind(q) for q in "\"'"}
    while at < end and (m := START.search(html, at)):
        begin = m.start()
        if m[0] == "<!--":
            close = html.find("-->", begin + 4)
            at = yield begin, (close + 3 if close >= 0 else end), False, "", ""
        elif m[0] in ("<!", "<?"):
            close = html.find(">", begin)
            at = yield begin, (close + 1 if close >= 0 else end), False, "", ""
        elif t := TAG.match(html, begin):
            at = yield begin, t.end(), bool(t[1]), t[2].lower(), t[3]
        else:
            name = NAME.match(html, begin)
            own, close = attributes(html, name.end(), last)
            at = yield begin, close, m[0][1] == "/", name[1].lower(), own


def blocks_of(html: str) -> list[Block]:
    """The page's blocks in order. Elements are closed as browsers do in the common cases: p by any block, li by li, and so on."""
    root = here = Element("", None)
    blocks: list[Block] = []
    block: Block | None = None
    links = 0
    opened: dict[str, int] = {}
    unclosed: set[str] = set()  # opaque elements whose end tag isn't met any more
    at, scan = 0, tags(html)

    def up(to: Element) -> Element:
        x = here
        while x is not to:
            opened[x.name] -= 1
            x = x.parent
        return to

    found = next(scan, None)
    while True:
        stop = found[0] if found else len(html)
        if stop > at and here.region != 3:
            part = html[at:stop]
            if block is None:
                block = Block(here)
                blocks.append(block)
                here.units.append(block)
            block.parts.append(part)
            block.length += len(part)
            if links:
                block.linked += len(part)
        if not found:
            return blocks
        _, at, closing, name, own = found
        if name and closing:
            if name == "a":
                links = max(0, links - 1)
            if name not in INLINE:
                block = None
                if opened.get(name):
                    x = here
                    while x.name != name:
                        x = x.parent
                    here = up(x.parent)
        elif name in OPAQUE:
            if not own.rstrip().endswith("/") or name not in ("svg", "math"):
                close = None if name in unclosed else re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(html, at)
                if close:
                    at = close.end()
                elif name in RAW:
                    at = len(html)
                else:
                    unclosed.add(name)
            if block and name in SPACED:
                block.parts.append(" ")
        elif name in INLINE:
            if name == "a":
                links += 1
            elif name == "br" and block:
                block.parts.append(" ")
        elif name:
            block, links = None, 0
            for kind in ("p", *CLOSES.get(name, ())):
                if (x := here.scope.get(kind)) is not None:
                    here = up(x.parent)
            if name not in VOID:
                new = Element(name, here, *marked(name, own, here))
                here.units.append(new)
                here = new
                opened[name] = opened.get(name, 0) + 1
        try:
            found = scan.send(at)
        except StopIteration:
            found = None


DIGIT, SEPARATOR = re.compile(r"\d"), re.compile("[|·»›©•→]")
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
FIGURES = ["one", "words", "linked", "ends like a sentence", "digits", "separators", "word length", "heading"]
#: Weights in the standard units of FIGURES that the fit starts from and leans to: what holds for any pages.
START_WEIGHTS = np.array([-0.6, 1.5, -4.0, 0.8, -1.0, -2.0, 0.0, 1.5])


def figures(block: Block) -> list[float]:
    """What the classifier sees: the block's text, its links, and whether it is a heading; no container."""
    text = block.text
    words = text.count(" ") + 1
    return [
        1.0,
        min(3.0, math.log1p(words) / 1.5) - 1.0,
        block.linked / max(1, block.length),
        1.0 if text[-1] in ".!?…:;\"'»”" else 0.0,
        len(DIGIT.findall(text)) / len(text),
        min(1.0, 4 * len(SEPARATOR.findall(text)) / words),
        min(2.0, len(text) / words / 6) - 1.0,
        1.0 if block.home.name in HEADINGS else 0.0,
    ]


def fit(x: np.ndarray, content: np.ndarray, lean: float = 20.0) -> np.ndarray:
    """Logistic regression by Newton's method; both kinds weigh alike, and weights are drawn to START_WEIGHTS as by so many rows. With one kind only they stay there."""
    w = START_WEIGHTS.copy()
    if not content.any() or content.all():
        return w
    share = np.where(content, 0.5 / content.mean(), 0.5 / (1 - content.mean()))
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (share * (p - content)) + lean * (w - START_WEIGHTS)
        curve = (x * (share * p * (1 - p))[:, None]).T @ x + lean * np.eye(len(w))
        move = np.linalg.solve(curve, slope)
        w -= move * min(1.0, 2 / max(1e-9, np.abs(move).max()))
        if np.abs(move).max() < 1e-9:
            break
    return w


def units_of(html: str | None) -> tuple[Element | None, list[Block]]:
    """The root of the page's containers, and its blocks that have text."""
    blocks = blocks_of(html or "")
    kept = []
    for b in blocks:
        if text := " ".join("".join(map(unescape, b.parts)).split()):
            b.text, b.place = text, len(kept)
            kept.append(b)
    if not kept:
        return None, []
    root = kept[0].home
    while root.parent:
        root = root.parent
    return root, kept


def capacities(block: Block, weights: list[float]) -> tuple[float, float]:
    """What the block loses as boilerplate, and as content: the classifier's log-odds, held to MOST."""
    odds = max(-MOST, min(MOST, sum(map(mul, figures(block), weights))))
    return max(0.0, odds), max(0.0, -odds)


INF = math.inf
CORNERS = [(up, first, last) for up in (0, 1) for first in (0, 1) for last in (0, 1)]


def cut(root: Element, costs: list[tuple[float, float]]) -> list[bool]:
    """Which blocks a minimum cut leaves on the side of content; of equal cuts, one with less content.

    root: the tree of containers; its blocks' place is their place in costs. A table has the least cost of what a container
    holds, by the container's label and those of its first and last block. Children are taken up in turn: first a child's
    own label is settled for each label of its container, then the edge between its first block and the last one before.
    """
    label = [False] * len(costs)
    tables: dict[int, tuple] = {}  # of containers: table, depths of first and last block, steps, whether it is bare, whether it holds one block
    stack: list[tuple[Element, bool]] = [(root, False)]
    while stack:
        e, ready = stack.pop()
        if not ready:
            stack.append((e, True))
            stack.extend((u, False) for u in e.units if isinstance(u, Element))
            continue
        table, steps, head, tail, single = None, [], 0, 0, True
        boilerplate, content, tie = e.mark
        for u in e.units:
            if isinstance(u, Block):
                if u.place < 0:
                    continue
                c, b = costs[u.place]
                child, first_depth, last_depth, hold = (c, INF, INF, INF, INF, INF, INF, b), 0, 0, tie
                alone = True
            else:
                if id(u) not in tables:
                    continue
                child, first_depth, last_depth, _, bare, alone = tables[id(u)]
                if not bare:
                    first_depth, last_depth = first_depth + 1, last_depth + 1
                hold = max(tie, u.mark[2]) if u.mark[0] == 0 else tie
            # Where a child holds a single block, its first is its last: two cases rather than four.
            settled, own = [INF] * 8, [0] * 8
            for k in (0, 3) if alone else (0, 1, 2, 3):
                x, y = child[k], child[4 + k]
                settled[k], own[k] = (x, 0) if x <= y + hold else (y + hold, 1)
                settled[4 + k], own[4 + k] = (y, 1) if y <= x + hold else (x + hold, 0)
            if table is None:
                table, head, choice, single = settled, first_depth, None, alone
            else:
                edge, single = ADJACENT / (1 + tail + first_depth), False
                joined, choice = [INF] * 8, [None] * 8
                for base in (0, 2, 4, 6):  # by the label of the container and of the first block
                    off, on = table[base], table[base + 1]
                    up = base & 4
                    for last in (0, 1):
                        if alone:
                            x, y, start = (off, on + edge, 0) if last == 0 else (on, off + edge, 1)
                            same = x <= y
                            joined[base + last] = (x if same else y) + settled[up + 3 * last]
                            choice[base + last] = (start if same else 1 - start, start)
                        else:
                            x, y = settled[up + last], settled[up + 2 + last]
                            joined[base + last], choice[base + last] = min((off + x, (0, 0)), (on + y, (1, 1)), (off + y + edge, (0, 1)), (on + x + edge, (1, 0)))
                table = joined
            steps.append((u, own, choice))
            tail = last_depth
        if table is not None:
            table = [x + (boilerplate if k >= 4 else content) for k, x in enumerate(table)]
            bare = len(steps) == 1 and e.mark[:2] == (0.0, 0.0)  # such a container, say p, doesn't set its block apart
            tables[id(e)] = table, head, tail, steps, bare, single
    if id(root) not in tables:
        return label
    table = tables[id(root)][0]
    todo = [(root, min(range(8), key=lambda k: (table[k], k)))]
    while todo:
        e, state = todo.pop()
        up, first, last = CORNERS[state]
        for u, own, choice in reversed(tables[id(e)][3]):
            middle, start = choice[4 * up + 2 * first + last] if choice else (0, first)
            mine = own[4 * up + 2 * start + last]
            if isinstance(u, Block):
                label[u.place] = bool(mine)
            else:
                todo.append((u, 4 * mine + 2 * start + last))
            last = middle
    return label


def main_text(html: str | None, weights: np.ndarray = START_WEIGHTS) -> str:
    """The page's main text: blocks labelled content, white space within each as one space, joined by line breaks."""
    root, blocks = units_of(html)
    if root is None:
        return ""
    own = [float(w) for w in weights]
    return "\n".join(b.text for b, x in zip(blocks, cut(root, [capacities(b, own) for b in blocks]), strict=True) if x)


def in_article(block: Block) -> bool:
    """The label that the classifier learns: the nearest container that says anything is an article or main element."""
    return block.home.region == -1


def learn(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", rows: int = TRAINING_PAGES, seed: int = SEED) -> np.ndarray:
    """Weights of the classifier, from all pages up to rows, or about so many chosen by a hash of their id and html.

    At most PAGE_BLOCKS blocks of each, evenly spread, come to the driver as figures. Pages without an article or main
    element teach nothing; if there are no others, START_WEIGHTS are returned.
    """
    n = pages.count()
    chosen = pages.select(F.col(html_col).alias("html"), F.pmod(F.xxhash64(F.col(id_col), F.col(html_col), F.lit(seed)), F.lit(1_000_000)).alias("draw"))
    if n > rows:
        chosen = chosen.where(F.col("draw") < F.lit(max(1, 1_000_000 * rows // n)))

    def of(batches):
        for b in batches:
            x, y = [], []
            for html in b.column(0):
                _, blocks = units_of(html.as_py())
                if not any(map(in_article, blocks)):
                    continue
                for k in blocks[:: max(1, -(-len(blocks) // PAGE_BLOCKS))]:
                    x.append(figures(k))
                    y.append(in_article(k))
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), pa.array(y, pa.bool_())], ["x", "content"])

    got = chosen.select("html").mapInArrow(of, "x array<double>, content boolean").toArrow()
    x = np.array(got.column("x").to_pylist(), float).reshape(-1, len(FIGURES))
    y = np.array(got.column("content").to_pylist(), bool)
    order = np.lexsort([y, *x.T]) if len(x) else []  # whatever order the rows came in
    return fit(x[order], y[order])


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", weights: np.ndarray | None = None) -> DataFrame:
    """page_id, url, text, n_chars: a row for each row of pages. weights: the classifier's, which learn() takes from the pages if none are given.

    Null and empty html, and pages without content, give an empty text. The id and url are only carried: they may be null or
    repeat. Broken markup is read as far as it can be, a quote that nothing closes as none; nothing is cut by length, and
    time grows as the page. An empty table gives no rows. Other columns aren't read.
    """
    model = learn(pages, id_col, html_col) if weights is None else weights

    def of(batches):
        for b in batches:
            for k in range(0, b.num_rows, 500):
                part = b.slice(k, 500)
                texts = [main_text(t.as_py(), model) for t in part.column(2)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    return rows.mapInArrow(of, "page_id long, url string, text string, n_chars long")


def op9_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
