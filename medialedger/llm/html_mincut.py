"""Main text of web pages by minimum-cut labelling of their blocks.

A page is cut into blocks of text. What markup says about a block and a linear classifier of its text, links and neighbours
give its cost for either label, in log-odds; blocks that follow each other or stand close in the element tree are tied by
smoothness edges on the same scale. The minimum cut between content and boilerplate is the cheapest labelling of all blocks
together: clear markup decides by itself, names that only hold a telling word weigh as much as text does, and where markup is
silent or doubtful neighbours settle what the classifier leaves open.

The classifier and the edges are fitted to a bounded sample of the pages themselves. Blocks whose markup is clear serve as
labelled ones, with that markup hidden from the classifier.
"""

from __future__ import annotations

import html
import itertools
import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from medialedger.llm.store import discard, materialize

_MARKUP = re.compile(r"<(?:(!--)|(!\[CDATA\[)|([!?])|(/?)([a-zA-Z][a-zA-Z0-9:-]*))")
#: The rest of a tag: quotes protect what they hold. Nothing is given back, so a scan is one pass.
_TAIL = re.compile(r"([^>\"']*+(?:\"[^\"]*+\"[^>\"']*+|'[^']*+'[^>\"']*+)*+)>")
_PLAIN_TAIL = re.compile(r"([^<>]*+)(?:>|\Z)")
_ATTRIBUTE = re.compile(r"(class|id|role|style|hidden|aria-hidden|itemprop|aria-label)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.IGNORECASE)
_SPACE = re.compile(r"\s+")
_INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no text of the page; the raw ones end at their own end tag only.
_RAW = frozenset("script style title textarea noframes noembed iframe xmp".split())
_UNSEEN = frozenset("head noscript template svg math object audio video canvas map select datalist".split())
_CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split())
_CLOSED_BY_SELF = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_LIMITS = frozenset("ul ol dl table td th div article section main body".split())
#: What an element around a block says about it, by its name.
_ELEMENT = {"nav": -9.0, "footer": -9.0, "aside": -8.0, "form": -8.0, "button": -8.0, "menu": -8.0, "dialog": -8.0, "header": -7.0, "address": -2.0, "label": -2.0, "figcaption": 0.5, "article": 5.0, "main": 4.0, "blockquote": 1.0}
_ROLE = {"navigation": -9.0, "banner": -7.0, "contentinfo": -9.0, "complementary": -8.0, "search": -9.0, "dialog": -8.0, "alert": -8.0, "alertdialog": -8.0, "menu": -8.0, "form": -8.0, "main": 4.0, "article": 5.0}
_BAD_NAME = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|banner|sponsor\w*|promo\w*|nav\w*|menu\w*|breadcrumbs?|footer\w*|foot|header|masthead|topbar|sidebar\w*|side|rail|widgets?"
    r"|comments?\w*|commentlist|disqus\w*|respond|replies|reply|discussion|share\w*|sharing|social\w*|related\w*|recommend\w*|newsletter\w*|subscribe\w*|signup|login|popup|modal|overlay"
    r"|cookies?\w*|consent\w*|gdpr|notice|notification|alert|disclaimer|copyright|legal|toolbar|pagination|pager|search\w*|skip\w*|tags|toc|hidden|sr-only|visually-hidden|outbrain|taboola)(?=$|[\s_-])",
    re.IGNORECASE,
)
_GOOD_NAME = re.compile(r"(?:^|[\s_-])(?:article\w*|post|entry|content|main|story|body|text|prose)(?=$|[\s_-])", re.IGNORECASE)
#: Names of a box of its own kind, unlike those that only tell of a layout (has-sidebar, no-comments, nav-open).
_BOX_NAME = re.compile(
    r"(?:^|\s)(?:(?:comments?|commentlist|disqus|respond|replies|discussion|related|recommend\w*|ads?|advert\w*|adsense|sponsor\w*)(?![\w-]*[_-](?:open|opened|closed|enabled|disabled|on|off|none)(?:$|\s))(?:[_-][\w-]*)?"
    r"|outbrain|taboola|nav|navbar|navigation|menu|(?:site|page|main)?[_-]?footer|sidebar)(?=$|\s)",
    re.IGNORECASE,
)
#: Words that name a box of something else when they are a whole name, or stand with what only tells of a box or of its place.
_BOX_WORD = (
    r"(?:ads?|advert\w*|adsense|banner|sponsor\w*|promo\w*|nav|navbar|navigation|menu|breadcrumbs?|footer|foot|header|masthead|topbar|sidebar|widgets?|comments?|commentlist|disqus|respond|replies|reply"
    r"|share|sharing|social|related|recommend(?:ed|ations?)|newsletter|subscribe|signup|login|popup|modal|overlay|cookies?|consent|gdpr|notice|notification|alert|disclaimer|copyright|toolbar"
    r"|pagination|pager|search|skip|hidden|outbrain|taboola)"
)
_HOLDER = (
    r"(?:box|bar|list|notice|banner|wrap|wrapper|container|block|area|section|unit|slot|form|links?|buttons?|posts?|articles?|stories|items?|threads?|widgets?|panel|overlay|popup|inner|content"
    r"|top|bottom|left|right|menu|nav|header|footer|group|holder|region|zone|icons?|feed|count|\d+)"
)
_BOX_TOKEN = re.compile(rf"(?:(?:site|page|main|global|top|post|entry|article|blog)[_-]?)?{_BOX_WORD}(?:[_-]?(?:{_HOLDER}|{_BOX_WORD}))*|sr-only|visually-hidden", re.IGNORECASE)
#: For an element that is an article itself only the bare word says so.
_BARE_TOKEN = re.compile(_BOX_WORD, re.IGNORECASE)
#: Names of what holds the title of an article, inside of one.
_TITLE_TOKEN = re.compile(r"(?:article|post|entry|story|content|page)[_-]?(?:header|head|title|heading|top)", re.IGNORECASE)
#: What a name says that only holds such a word among others (share-prices, legal-analysis): a sign that text and neighbours can outvote.
_HINT = -1.5
_ARTICLE_PROPS = frozenset(("articlebody", "maincontentofpage"))
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)


@dataclass
class Node:
    name: str
    parent: Node | None
    bias: float
    in_article: bool
    good: float = 0.0
    hard: bool = False
    nested: bool = False


@dataclass
class Block:
    parent: Node
    tag: str
    parts: list[str] = field(default_factory=list)
    linked: int = 0
    text: str = ""


def _bias(name: str, attributes: str, above: Node | None) -> tuple[float, bool, float, bool, bool]:
    """What this element and those around it say about a block: (bias, an article or main is around it, the best that is
    said, whether the worst stands for any article inside, an article is around it)."""
    bias, inside, best, hard, nested = (above.bias, above.in_article, above.good, above.hard, above.nested) if above else (0.0, False, 0.0, False, False)
    own = _ELEMENT.get(name, 0.0)
    if name == "header" and inside:
        own = 0.0  # the head of an article carries its title
    firm = own <= -7.0 and name != "form"  # some servers put a whole page into one form
    article, main, hinted = name == "article", name == "main", False
    found = [(m[1].lower(), m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(attributes)] if attributes else ()
    for key, value in found:
        article |= key == "role" and value.lower() == "article" or key == "itemprop" and not _ARTICLE_PROPS.isdisjoint(value.lower().split())
        main |= key == "role" and value.lower() == "main"
    for key, value in found:
        if key == "role":
            role = _ROLE.get(value.lower(), 0.0)
            own, firm = (min(own, role), True) if role < 0 else (own + role, firm)
        elif key in ("class", "id") and name not in ("body", "html"):
            names = [t for t in value.split() if not (inside and _TITLE_TOKEN.fullmatch(t))]
            box = any(_BOX_TOKEN.fullmatch(t) for t in names) and _BOX_NAME.search(value) is not None
            if inside and name in ("header", "h1", "h2", "h3"):
                pass
            elif box or any((_BARE_TOKEN if article or main else _BOX_TOKEN).fullmatch(t) for t in names):
                own, firm = min(own, -8.0), firm or box
            elif own > -7.0:
                own = max(own, 3.0) if own >= 0 and _GOOD_NAME.search(value) else own
                hinted |= any(_BAD_NAME.search(t) for t in names)
        elif key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and _HIDDEN.search(value):
            own, firm = -9.0, True
    if hinted and own > -7.0:
        own += _HINT
    if (article or main) and own > -7.0 and bias < 0 and not hard and not nested:
        bias = best  # the wrapper was only named badly; an article within an article is no such sign
    best = max(best, own, 0.0)
    good, bad = max(bias, own, 0.0), min(bias, own, 0.0)
    # A negative element stays negative whatever stands inside it, unless it is only a name and an article lies in it.
    return (bad if bad <= -7.0 else good + bad), inside or name in ("article", "main"), best, hard or firm, nested or article


def tags(page: str) -> Iterator[tuple[int, int, str, bool, str]]:
    """(start, end, name, whether it closes, attributes) of each tag, in one pass; other markup has an empty name.

    After the first tag whose quotes never close, quotes protect nothing in the rest of the page.
    """
    at, quoted = 0, True
    while m := _MARKUP.search(page, at):
        start, at = m.start(), m.end()
        if m[1] or m[2] or m[3]:
            close = "-->" if m[1] else "]]>" if m[2] else ">"
            end = page.find(close, at)
            kept = page[at : end if end >= 0 else len(page)] if m[2] else ""
            at = end + len(close) if end >= 0 else len(page)
            yield start, at, "", False, kept
            continue
        tail = _TAIL.match(page, at) if quoted else None
        if tail is None:
            quoted = False
            tail = _PLAIN_TAIL.match(page, at)
        if tail is None:
            at = start + 1  # a lone angle bracket is text
            continue
        at, name = tail.end(), m[5].lower()
        if name in _RAW and not m[4]:
            stop = _raw_end(name).search(page, at)
            at = stop.end() if stop else len(page)
        yield start, at, name, bool(m[4]), tail[1]


_raw_ends: dict[str, re.Pattern] = {}


def _raw_end(name: str) -> re.Pattern:
    if name not in _raw_ends:
        _raw_ends[name] = re.compile(rf"</{name}(?=[\s/>]|\Z)[^>]*+(?:>|\Z)", re.IGNORECASE)
    return _raw_ends[name]


def _decoded(text: str) -> str:
    """Character references decoded; numbers beyond any character become the replacement character."""
    if "&" in text:
        text = re.sub(r"&#([xX]?)0{2,}", r"&#\g<1>0", text)
        text = html.unescape(re.sub(r"&#(?:0?[1-9][0-9]{7,}|[xX]0?[1-9a-fA-F][0-9a-fA-F]{6,});?", "\ufffd", text))
    return _SPACE.sub(" ", text).strip()


def blocks(page: str) -> list[Block]:
    """The blocks of a page: runs of text between the tags that start or end a block. Open elements are found by name, so that
    no depth or breadth of nesting makes a tag cost more than another."""
    out: list[Block] = []
    root = Node("", None, 0.0, False)
    stack = [root]
    where: dict[str, list[int]] = {}  # places of the open elements by name
    limits, holders = [], [0]  # places of those that end a search, and of those that are no inline elements
    links = unseen = at = 0
    current: Block | None = None

    def text(piece: str) -> None:
        nonlocal current
        if unseen or not piece:
            return
        if current is None:
            if piece.isspace():
                return
            current = Block(stack[-1], stack[holders[-1]].name)
            out.append(current)
        current.parts.append(piece)
        if links:
            current.linked += len(piece)

    def push(node: Node) -> None:
        nonlocal links, unseen
        where.setdefault(node.name, []).append(len(stack))
        if node.name in _LIMITS:
            limits.append(len(stack))
        if node.name not in _INLINE:
            holders.append(len(stack))
        stack.append(node)
        links += node.name == "a"
        unseen += node.name in _UNSEEN

    def pop_to(place: int) -> None:
        nonlocal links, unseen, current
        while len(stack) > place:
            name = stack.pop().name
            where[name].pop()
            if name in _LIMITS:
                limits.pop()
            links -= name == "a"
            unseen -= name in _UNSEEN
            if name not in _INLINE:
                holders.pop()
                current = None

    def last(names: set[str] | tuple[str, ...]) -> int:
        return max((where[n][-1] for n in names if where.get(n)), default=0)

    for start, end, name, closing, attributes in tags(page):
        text(page[at:start])
        at = end
        if not name:
            if attributes:
                text(html.escape(attributes, quote=False))
            continue
        if closing:
            place = last((name,))
            if place and not (name in _INLINE and limits and limits[-1] > place):
                pop_to(place)
            elif name not in _INLINE:
                current = None
            continue
        if name == "br":
            text(" ")
            continue
        if name not in _INLINE:
            current = None
        if name in _CLOSES_P or name in _CLOSED_BY_SELF:
            targets = _CLOSED_BY_SELF.get(name, {"p"})
            while (place := last(targets)) and place >= (limits[-1] if limits else 0):
                pop_to(place)
                if name != "tr":
                    break
        if name in _VOID or name in _RAW or attributes.rstrip().endswith("/") and name in _UNSEEN:
            continue
        if name == "body":
            pop_to(1)  # the head ends here, closed or not
        push(Node(name, stack[-1], *_bias(name, attributes, stack[-1])))
    text(page[at:])
    for b in out:
        b.text = _decoded("".join(b.parts))
    return [b for b in out if b.text]


#: What is seen of a block's text: a constant, its length and whether it is very short or long, the share of it that is linked,
#: its sentence marks, whether it ends like a sentence, signs of a notice, heading or list item, and length and links around it.
FEATURES = ("constant", "length", "short", "long", "linked", "marks", "ends", "notice", "heading", "item", "near length", "near linked")
_NOTICE = re.compile("[\u00a9\u00ae|\u00b7\u00bb\u203a]")
_MARKS = re.compile("[.!?,;:\u3002\uff0c\u3001]")


def text_features(found: list[Block]) -> np.ndarray:
    """(blocks, FEATURES) of a page; nothing of it comes from names or roles of elements but headings and list items."""
    x = np.zeros((len(found), len(FEATURES)))
    for i, b in enumerate(found):
        n = len(b.text)
        marks = len(_MARKS.findall(b.text)) / n
        x[i, :10] = (
            1, min(np.log1p(n) / 6, 2), n < 25, n >= 200, min(1, b.linked / n), min(1, 20 * marks), b.text[-1] in ".!?:\"'\u3002",
            _NOTICE.search(b.text) is not None, b.tag in _HEADINGS, b.tag == "li",
        )
    if len(found) > 1:
        for to, of in ((10, 1), (11, 4)):
            sides = np.pad(x[:, of], 1, mode="edge")
            x[:, to] = (sides[:-2] + sides[2:]) / 2
    elif found:
        x[:, 10], x[:, 11] = x[:, 1], x[:, 4]
    return x


@dataclass
class Model:
    """Log-odds of content: weights of the text features, and what a pair of blocks costs that gets different labels."""

    weights: np.ndarray = field(default_factory=lambda: np.array([0.0, 0.6, -0.4, 0.6, -3.0, 0.3, 0.3, -0.6, 0.4, -0.4, 0.2, -0.3]))
    #: For pairs that follow each other under one element, that follow each other otherwise, and that stand under one element.
    ties: tuple[float, float, float] = (0.8, 0.3, 0.5)
    #: The text's part of a cost stays within this, so that clear markup is not outvoted by words.
    most: float = 2.5


_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())


def markup_cost(b: Block) -> float:
    """What markup says: elements, roles and names around the block, and its own tag."""
    return b.parent.bias + (1.0 if b.tag == "p" or b.tag in _HEADINGS or b.tag in ("pre", "td") else 0.0 if b.tag == "li" else 0.2)


def costs_of(found: list[Block], model: Model, use_markup: bool = True) -> list[float]:
    """Positive for content, negative for boilerplate."""
    said = np.clip(text_features(found) @ model.weights, -model.most, model.most) if found else np.zeros(0)
    return [float(s) + (markup_cost(b) if use_markup else 0.0) for s, b in zip(said, found, strict=True)]


def pairs_of(found: list[Block]) -> list[tuple[int, int, int]]:
    """(block, later block, kind of tie): neighbours in reading order, and blocks with the last one under the same element."""
    out, last = [], {}
    for i, b in enumerate(found):
        up = b.parent.parent
        if i:
            out.append((i - 1, i, 0 if up is found[i - 1].parent.parent else 1))
        if up is not None:
            if last.get(id(up), i - 1) != i - 1:
                out.append((last[id(up)], i, 2))
            last[id(up)] = i
    return out


def edges_of(found: list[Block], model: Model, use_markup: bool = True) -> list[tuple[int, int, float]]:
    """Ties of the page's blocks; none between a block that markup rejects and one that it does not."""
    rejected = [use_markup and b.parent.bias <= -7.0 for b in found]
    return [(i, j, model.ties[kind]) for i, j, kind in pairs_of(found) if rejected[i] == rejected[j]]


def clear_label(b: Block) -> int:
    """1 or 0 for a block whose markup is clear, else -1."""
    return 0 if b.parent.bias <= -7.0 else 1 if b.parent.in_article and b.parent.bias >= 4.0 else -1


def sample_rows(page: str | None, most: int = 200) -> tuple[np.ndarray, np.ndarray]:
    """(text features and sums of the labels, 1 or -1, of what a block is tied to by kind of tie; labels) of at most ``most``
    clear blocks of a page, evenly spread."""
    found = blocks(page or "")
    labels = np.array([clear_label(b) for b in found], dtype=np.int8)
    around = np.zeros((len(found), 3))
    for i, j, kind in pairs_of(found):
        for to, of in ((i, j), (j, i)):
            around[to, kind] += 0 if labels[of] < 0 else 2 * labels[of] - 1
    at = np.flatnonzero(labels >= 0)
    at = at[:: max(1, -(-len(at) // most))]
    return np.column_stack([text_features(found), around])[at], labels[at]


def fit(x: np.ndarray, y: np.ndarray, trust: float = 20.0, steps: int = 30) -> Model:
    """The maximum pseudo-likelihood: logistic regression on text features and labels around, so that weights and ties are on one
    scale, drawn towards those of ``Model()`` with the weight of ``trust`` blocks; classes are weighted alike. Without blocks of
    both labels the model stays as it is."""
    model = Model()
    if len(np.unique(y)) < 2:
        return model
    start = np.concatenate([model.weights, model.ties])
    w = start.copy()
    weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum())) * min(len(y), 100 * trust)
    for _ in range(steps):  # Newton's method
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (weight * (p - y)) + trust * (w - start)
        w = w - np.linalg.solve((x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + trust * np.eye(len(w)), gradient)
    return Model(w[: len(FEATURES)], tuple(float(t) for t in np.maximum(w[len(FEATURES) :], 0)))


def scaled(model: Model, factors: tuple[float, ...]) -> Model:
    return Model(model.weights, tuple(t * f for t, f in zip(model.ties, factors, strict=True)), model.most)


def mistakes(page: str | None, models: list[Model]) -> np.ndarray:
    """For each model (clear blocks, wrong by their costs alone, wrong after the cut, put right by the cut), markup being hidden.
    The models differ in their ties only."""
    found = blocks(page or "")
    truth = np.array([clear_label(b) for b in found])
    seen, pairs = truth >= 0, pairs_of(found)
    costs = costs_of(found, models[0], use_markup=False)
    alone = np.array(costs) >= 0
    out = np.zeros((len(models), 4), dtype=np.int64)
    for k, model in enumerate(models):
        cut = np.array(minimum_cut(costs, [(i, j, model.ties[kind]) for i, j, kind in pairs]), dtype=bool)
        out[k] = seen.sum(), (alone != truth)[seen].sum(), (cut != truth)[seen].sum(), ((alone != truth) & (cut == truth))[seen].sum()
    return out


#: Ties fitted by pseudo-likelihood come out too strong where labels run in long stretches: each kind is tried at these scales.
SCALES = tuple(itertools.product((0.25, 0.5, 1.0), (0.0, 0.1, 0.3), (0.02, 0.1, 0.3)))


def train(pages: DataFrame, max_pages: int = 1000) -> Model:
    """The model fitted to at most ``max_pages`` pages (chosen by a hash of their ids), 200 blocks of each at most; of the
    ``SCALES`` of its ties those are taken whose cuts make the fewest mistakes on these pages, the strongest of equal ones."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [sample_rows(page.as_py()) for page in batch.column("html")]
            columns = [pa.array([r[k].astype(t).tobytes() for r in rows], pa.binary()) for k, t in enumerate(("<f4", "i1"))]
            yield pa.RecordBatch.from_arrays(columns, names=["x", "y"])

    chosen = pages.select("page_id").distinct().orderBy(F.xxhash64("page_id"), "page_id").limit(max_pages)
    # A repeated id must not widen the sample: one row of each.
    rows = pages.select("page_id", F.col("html").cast("string").alias("html")).join(F.broadcast(chosen), "page_id").dropDuplicates(["page_id"])
    sample = materialize(rows.select("html").repartition(32), "page-sample")  # a few pages to a task: judging them is the work
    got = sample.mapInArrow(read, "x binary, y binary").collect()
    x = np.concatenate([np.zeros(0, "<f4"), *(np.frombuffer(r["x"], "<f4") for r in got)]).reshape(-1, len(FEATURES) + 3)
    y = np.concatenate([np.zeros(0, "i1"), *(np.frombuffer(r["y"], "i1") for r in got)])
    order = np.lexsort((y, *x.T))  # the same sums whatever order the rows come in
    fitted = fit(x[order].astype(np.float64), y[order])
    models = [scaled(fitted, f) for f in SCALES]

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for page in batch.column("html"):
                wrong = pa.array(mistakes(page.as_py(), models)[:, 2])
                yield pa.RecordBatch.from_arrays([pa.array(range(len(models)), pa.int32()), wrong], names=["model", "wrong"])

    wrong = {r["model"]: r["n"] for r in sample.mapInArrow(judge, "model int, wrong bigint").groupBy("model").agg(F.sum("wrong").alias("n")).collect()}
    discard(sample)
    return models[min(range(len(models)), key=lambda k: (wrong.get(k, 0), -k))]


def minimum_cut(costs: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """For each node whether it stays on the content side of the minimum cut.

    A node of cost c has capacity c from the source if positive, -c to the sink if negative; edges cost their weight when
    their ends get different labels.
    """
    label: list[bool | None] = [None] * len(costs)
    near: list[dict[int, float]] = [{} for _ in costs]
    for i, j, w in edges:
        near[i][j] = near[i].get(j, 0.0) + w
        near[j][i] = near[j].get(i, 0.0) + w
    # A node whose cost outweighs its edges keeps its own label in any minimum cut, and adds them to its neighbours' costs.
    now, tied = list(costs), [sum(n.values()) for n in near]
    queue = deque(i for i in range(len(now)) if abs(now[i]) >= tied[i])
    while queue:
        i = queue.popleft()
        if label[i] is not None:
            continue
        label[i] = now[i] >= 0
        for j, w in near[i].items():
            if label[j] is None:
                now[j] += w if label[i] else -w
                tied[j] -= w
                if abs(now[j]) >= tied[j] - 1e-12:
                    queue.append(j)
    rest = [i for i in range(len(now)) if label[i] is None]
    if rest:
        number = {i: k for k, i in enumerate(rest)}
        ties = [(number[i], number[j], w) for i in rest for j, w in near[i].items() if i < j and j in number]
        for i, kept in zip(rest, _max_flow_cut([now[i] for i in rest], ties), strict=True):
            label[i] = kept
    return [bool(x) for x in label]


def _max_flow_cut(costs: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Which nodes the source still reaches after a maximum flow (Dinic's algorithm)."""
    n = len(costs)
    graph: list[list[int]] = [[] for _ in range(n + 2)]
    to: list[int] = []
    room: list[int] = []

    def join(a: int, b: int, there: int, back: int) -> None:
        graph[a].append(len(to))
        graph[b].append(len(to) + 1)
        to.extend((b, a))
        room.extend((there, back))

    for i, c in enumerate(costs):
        if c > 0:
            join(n, i, round(c * 1000), 0)
        elif c < 0:
            join(i, n + 1, round(-c * 1000), 0)
    for a, b, w in edges:
        join(a, b, round(w * 1000), round(w * 1000))
    while True:
        level = [-1] * (n + 2)
        level[n] = 0
        queue = deque([n])
        while queue:
            a = queue.popleft()
            for e in graph[a]:
                if room[e] and level[to[e]] < 0:
                    level[to[e]] = level[a] + 1
                    queue.append(to[e])
        if level[n + 1] < 0:
            return [level[i] >= 0 for i in range(n)]
        next_edge = [0] * (n + 2)
        path: list[int] = []
        a = n
        while True:
            if a == n + 1:
                least = min(room[e] for e in path)
                cut = 0
                for k, e in enumerate(path):
                    room[e] -= least
                    room[e ^ 1] += least
                    if not room[e] and not cut:
                        cut = k + 1
                a = to[path[cut - 1] ^ 1]
                del path[cut - 1 :]
                continue
            while next_edge[a] < len(graph[a]):
                e = graph[a][next_edge[a]]
                if room[e] and level[to[e]] == level[a] + 1:
                    path.append(e)
                    a = to[e]
                    break
                next_edge[a] += 1
            else:
                if a == n:
                    break
                level[a] = -1
                a = to[path.pop() ^ 1]


def labels_of(found: list[Block], model: Model, use_markup: bool = True) -> list[bool]:
    return minimum_cut(costs_of(found, model, use_markup), edges_of(found, model, use_markup))


def main_text(page: str | None, model: Model | None = None) -> str:
    """The text of the blocks that the minimum cut labels content, two newlines apart; empty for null or no content."""
    found = blocks(page or "")
    return "\n\n".join(b.text for b, keep in zip(found, labels_of(found, model or Model()), strict=True) if keep)


def extract(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """page_id, url, text, n_chars (code points) of every row of ``pages`` (page_id, url, html).

    Null and empty pages, and pages without content, have an empty text; repeated rows give repeated results; extra
    columns are ignored; an empty table gives no rows. Pages may be cut off anywhere and nest badly.
    """
    model = model or Model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(page.as_py(), model) for page in batch.column("html")]
            columns = [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("bigint"), F.col("url").cast("string"), F.col("html").cast("string"))
    return rows.mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint")
