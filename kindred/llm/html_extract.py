"""Main text of web pages: gradient-boosted trees score DOM nodes, and one decoding of the whole tree picks what stays.

The trees see a node's subtree (text and link density, tag counts), its own and its ancestors' tags and attribute tokens, its
depth and its siblings. They learn from the landmarks that pages state themselves (article and main against nav, footer, forms
and so on) on a bounded sample. The decoding gives every node keep, drop or split: below a kept or dropped node no other
choice exists, so an ancestor and its descendants never contradict each other.
"""

import html
import random
import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SAMPLE_PAGES, MADE_PAGES = 400, 300
TREES, DEPTH, BINS, RATE = 40, 3, 16, 0.3
SPLIT_COST = 0.5

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|</([a-zA-Z][^\s/>]*)[^>]*>|<([a-zA-Z][^\s/>]*)", re.S)
BETWEEN, NAME, EQUALS, UNQUOTED = (re.compile(p) for p in (r"[\s/]*", r"=?[^\s/>=]*", r"\s*=\s*", r"[^\s>]*"))
SPACE = re.compile(r"\s+")
WORD = re.compile(r"[a-z]+")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe".split())
FOREIGN = frozenset("svg math".split())
# Parts of controls, drawings and fallbacks. One that is left open holds nothing: see `_end`.
HIDDEN = frozenset("noscript template svg select button option".split())
NEVER_TEXT = HIDDEN - {"noscript"}
BLOCK = frozenset(
    "html body article main section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption blockquote pre "
    "figure figcaption nav header footer aside form fieldset address details summary hgroup search menu dialog".split()
)
CLOSES_P = BLOCK - {"html", "body"}
SELF_CLOSING = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
                "option": {"option"}, "optgroup": {"option", "optgroup"}, "button": {"button"}}
LIST_SCOPE = frozenset("ul ol dl table menu select datalist".split())
OPTIONAL_END = frozenset("p li dt dd tr td th".split())
OPTION_LISTS = frozenset("select datalist optgroup".split())
GOOD_TAGS = frozenset("article main".split())
BAD_TAGS = frozenset("nav header footer aside form menu dialog search".split()) | HIDDEN
BAD_WORDS = frozenset(
    "ad ads advert advertisement banner breadcrumb comment comments cookie consent footer form header login menu modal nav navbar "
    "navigation newsletter notice pagination popup promo promotion related reply share sidebar social sponsor sponsored subscribe "
    "toolbar widget".split()
)
GOOD_WORDS = frozenset("article body content entry main post story text".split())
TAG_GROUPS = ["p", "h", "li", "list", "div", "section", "table", "quote", "inline", "other"]
GROUP_OF = {"p": 0, "li": 2, "dt": 2, "dd": 2, "ul": 3, "ol": 3, "dl": 3, "div": 4, "section": 5, "table": 6, "tr": 6, "td": 6, "th": 6,
            "blockquote": 7, "pre": 7, "figure": 7, "a": 8, "b": 8, "i": 8, "em": 8, "strong": 8, "span": 8, **{f"h{i}": 1 for i in range(1, 7)}}


@dataclass
class Page:
    """Nodes in document order; texts are (node, raw characters) in page order, breaks are texts of one space."""

    tag: list[str] = field(default_factory=lambda: ["#root"])
    parent: list[int] = field(default_factory=lambda: [-1])
    words: list[frozenset] = field(default_factory=lambda: [frozenset()])
    texts: list[tuple[int, str]] = field(default_factory=list)


def parse(page: str) -> Page:
    """A forgiving tree: unclosed paragraphs, items and cells end where the next begins, stray end tags are ignored.

    The contents of RAW elements are no text. All others are nodes, so nothing behind an element that is empty (`<svg/>`) or
    left open is lost.
    """
    out, stack, at, n = Page(), [0], 0, len(page)
    last, unclosed, unended = page.rfind(">"), set(), set()
    while at < n:
        match = TOKEN.search(page, at, last + 1) if at <= last else None
        if match is None:
            out.texts.append((stack[-1], page[at:]))
            break
        if match.start() > at:
            out.texts.append((stack[-1], page[at : match.start()]))
        at = match.end()
        if match[1]:
            name = match[1].lower()
            for k in range(len(stack) - 1, 0, -1):
                if out.tag[stack[k]] == name:
                    _end(out, stack, k, closed=True)
                    break
                if name not in BLOCK and out.tag[stack[k]] in BLOCK and not (name in HIDDEN and out.tag[stack[k]] in OPTIONAL_END):
                    break
            continue
        if not match[2]:
            continue
        name = match[2].lower()
        at, tokens, empty = _attributes(page, at, unclosed)
        if name == "br":
            out.texts.append((stack[-1], " "))
        if name in VOID:
            continue
        if name in RAW:
            # In a drawing or formula these may be empty (`<title/>`), and one left open ends with it at the latest.
            foreign = any(out.tag[k] in FOREIGN for k in stack)
            if not (foreign and empty) and name not in unended:
                end = re.compile(rf"</{re.escape(name)}\s*>" + (r"|(?=</(?:svg|math)\s*>)" if foreign else ""), re.I).search(page, at)
                at = end.end() if end else at if foreign else n
                if not end:
                    unended.add(name)
            continue
        if name in CLOSES_P:
            _close(out, stack, {"p"}, frozenset())
        if name in SELF_CLOSING:
            _close(out, stack, SELF_CLOSING[name], LIST_SCOPE)
        out.tag.append(name)
        out.parent.append(stack[-1])
        out.words.append(frozenset(tokens))
        if not empty or name in BLOCK:
            stack.append(len(out.tag) - 1)
    _end(out, stack, 1)
    return out


def _attributes(page: str, at: int, unclosed: set) -> tuple[int, set, bool]:
    """Where the tag ends whose name ends at `at`, the words of its telling attributes, and whether it closes itself.

    One pass by state: a quote opens a value only right behind `=`. A quote that the page never closes is an ordinary sign;
    `unclosed` remembers it, so that the page is not searched for it again.
    """
    tokens: set = set()
    n, value_end = len(page), -1
    while at < n:
        at = BETWEEN.match(page, at).end()
        if page[at : at + 1] in (">", ""):
            break
        name = NAME.match(page, at)
        at = name.end()
        if equals := EQUALS.match(page, at):
            at = equals.end()
            quote = page[at : at + 1]
            end = page.find(quote, at + 1) if quote in ("'", '"') and quote not in unclosed else -1
            if end >= 0:
                value, at = page[at + 1 : end], end + 1
            else:
                if quote in ("'", '"'):
                    unclosed.add(quote)
                value = UNQUOTED.match(page, at)[0]
                at = value_end = at + len(value)
            if name[0].lower() in ("class", "id", "role", "itemprop"):
                tokens.update(WORD.findall(value.lower()))
    return min(at + 1, n), tokens, at != value_end and page[at - 1 : at] == "/"


def _end(page: Page, stack: list[int], k: int, closed: bool = False) -> None:
    """Ends the nodes from stack[k] on; `closed` says that stack[k] has its end tag.

    A HIDDEN node without one is a slip of the page: how far it was meant to go is unknown, so its tag says nothing about the
    text that followed. Options need no end tag in their list.
    """
    listed = page.tag[stack[k]] in OPTION_LISTS if closed else False
    for node in stack[k + closed :]:
        if page.tag[node] in HIDDEN and not (page.tag[node] == "option" and listed):
            page.tag[node] = "#open"
    del stack[k:]


def _close(page: Page, stack: list[int], names: set, scope: frozenset) -> None:
    for k in range(len(stack) - 1, 0, -1):
        tag = page.tag[stack[k]]
        if tag in names:
            # The next option or group of options is an end as good as a tag.
            _end(page, stack, k, closed=tag in ("option", "optgroup"))
            return
        if tag in scope or tag in BLOCK and tag not in ("p", "li", "dt", "dd"):
            return


FEATURES = 12 + len(TAG_GROUPS) + 6


def features(page: Page) -> np.ndarray:
    """A row per node: own subtree, own kind, attribute tokens, depth, siblings and ancestors."""
    n = len(page.tag)
    chars, links, below, paragraphs, items, stops = np.zeros(n), np.zeros(n), np.ones(n), np.zeros(n), np.zeros(n), np.zeros(n)
    depth, in_link, good, bad, place, kids = (np.zeros(n) for _ in range(6))
    for k in range(1, n):
        p = page.parent[k]
        depth[k] = depth[p] + 1
        in_link[k] = in_link[p] or page.tag[k] == "a"
        good[k] = good[p] + len(page.words[k] & GOOD_WORDS) + (page.tag[k] in GOOD_TAGS)
        bad[k] = bad[p] + len(page.words[k] & BAD_WORDS) + (page.tag[k] in BAD_TAGS)
        place[k] = kids[p]
        kids[p] += 1
        paragraphs[k], items[k] = page.tag[k] == "p", page.tag[k] in ("li", "a")
    for k, text in page.texts:
        size = len(text.strip())
        chars[k] += size
        stops[k] += sum(map(text.count, ".,;:!?"))
        if in_link[k]:
            links[k] += size
    for k in range(n - 1, 0, -1):
        p = page.parent[k]
        for total in (chars, links, below, paragraphs, items, stops):
            total[p] += total[k]
    group = np.array([GROUP_OF.get(t, 9) for t in page.tag])
    up = np.maximum(page.parent, 0)
    own_bad = np.array([len(w & BAD_WORDS) + (t in BAD_TAGS) for w, t in zip(page.words, page.tag, strict=True)])
    own_good = np.array([len(w & GOOD_WORDS) + (t in GOOD_TAGS) for w, t in zip(page.words, page.tag, strict=True)])
    share = chars / np.maximum(chars[up], 1)
    return np.column_stack([
        np.log1p(chars), links / np.maximum(chars, 1), chars / below, np.log1p(below), paragraphs, items, stops / np.maximum(chars, 1),
        depth, place, kids[up], place / np.maximum(kids[up], 1), share, (group[:, None] == np.arange(len(TAG_GROUPS))).astype(float),
        own_good, own_bad, np.minimum(good, 3), np.minimum(bad, 3), links[up] / np.maximum(chars[up], 1), chars / max(1.0, chars[0]),
    ])


def landmarks(page: Page) -> np.ndarray:
    """1 for nodes in an article or main part, 0 for those in menus, headers and the like, -1 for those the page says nothing of."""
    label = np.full(len(page.tag), -1)
    for k in range(1, len(page.tag)):
        if page.tag[k] in BAD_TAGS or page.words[k] & BAD_WORDS:
            label[k] = 0
        elif label[page.parent[k]] == 0:
            label[k] = 0
        elif page.tag[k] in GOOD_TAGS or label[page.parent[k]] == 1:
            label[k] = 1
    return label


@dataclass
class Trees:
    """Complete binary trees of one depth: for every tree the split features and values, and the leaves' log-odds."""

    start: float
    feature: np.ndarray
    value: np.ndarray
    leaf: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for feature, value, leaf in zip(self.feature, self.value, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[rows, feature[node]] > value[node])
            out += leaf[node - (2**DEPTH - 1)]
        return out


def boost(x: np.ndarray, y: np.ndarray, trees: int = TREES) -> Trees:
    """Boosted trees for the log-loss, with splits at quantiles. With one class or none the trees answer its prior."""
    inner, leaves = 2**DEPTH - 1, 2**DEPTH
    rate = (y.sum() + 0.5) / (len(y) + 1)
    start = float(np.log(rate / (1 - rate)))
    all_feature, all_value, all_leaf = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, leaves))
    if not len(y):
        return Trees(0.0, all_feature[:0], all_value[:0], all_leaf[:0])
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.column_stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)])
    z = np.full(len(y), start)
    for t in range(trees):
        p = 1 / (1 + np.exp(-z))
        g, h = y - p, p * (1 - p)
        node = np.zeros(len(y), np.int64)
        for level in range(DEPTH):
            for k in range(2**level - 1, 2 ** (level + 1) - 1):
                mine = np.flatnonzero(node == k)
                best = (1e-9, 0, None)
                whole_g, whole_h = g[mine].sum(), h[mine].sum()
                for f, e in enumerate(edges):
                    if not len(e) or not len(mine):
                        continue
                    gs = np.cumsum(np.bincount(binned[mine, f], g[mine], len(e) + 1))[:-1]
                    hs = np.cumsum(np.bincount(binned[mine, f], h[mine], len(e) + 1))[:-1]
                    gain = gs**2 / (hs + 1) + (whole_g - gs) ** 2 / (whole_h - hs + 1) - whole_g**2 / (whole_h + 1)
                    s = int(gain.argmax())
                    if gain[s] > best[0]:
                        best = (gain[s], f, e[s])
                if best[2] is not None:
                    all_feature[t, k], all_value[t, k] = best[1], best[2]
                node[mine] = 2 * k + 1 + (x[mine, all_feature[t, k]] > all_value[t, k])
        at = node - inner
        all_leaf[t] = RATE * np.bincount(at, g, leaves) / (np.bincount(at, h, leaves) + 1)
        z += all_leaf[t][at]
    return Trees(start, all_feature, all_value, all_leaf)


def decode(page: Page, score: np.ndarray) -> np.ndarray:
    """Which nodes' own text is kept: the keep, drop or split choice of every node with the largest sum of log-odds.

    Controls, drawings and templates are never kept and weigh nothing in it; noscript is left to the trees.
    """
    n = len(page.tag)
    never = np.zeros(n, bool)
    for k in range(1, n):
        never[k] = never[page.parent[k]] or page.tag[k] in NEVER_TEXT
    own = np.where(never, 0.0, score)
    keep, drop, split = own.copy(), -own, np.full(n, -SPLIT_COST)
    for k in range(n - 1, 0, -1):
        p = page.parent[k]
        keep[p] += keep[k]
        drop[p] += drop[k]
        split[p] += max(keep[k], drop[k], split[k])
    state = np.zeros(n, np.int8)  # 1 keep, -1 drop, 0 split: own text of a split node goes by its own score
    for k in range(n):
        p = page.parent[k]
        if p >= 0 and state[p]:
            state[k] = state[p]
        elif p >= 0:
            state[k] = (0, 1, -1)[int(np.argmax((split[k], keep[k], drop[k])))]
    return np.where(state == 0, own > 0, state == 1) & ~never


def text_of(page: Page, kept: np.ndarray) -> str:
    """Kept text, block by block in page order."""
    inside = [0] * len(page.tag)
    for k in range(1, len(page.tag)):
        inside[k] = k if page.tag[k] in BLOCK else inside[page.parent[k]]
    blocks, now, current = [], [], None
    for k, raw in page.texts:
        if inside[k] != current:
            blocks.append("".join(now))
            now, current = [], inside[k]
        if kept[k]:
            now.append(raw)
    blocks.append("".join(now))
    cleaned = (SPACE.sub(" ", html.unescape(b)).strip() for b in blocks)
    return "\n\n".join(b for b in cleaned if b)


def made_pages(n: int = MADE_PAGES):
    """(page, its bare twin) of invented pages in many layouts, with comments, footers, menus of any length, notices and forms.

    The twin has the same nodes, but plain `div` and no attributes, where the page names its parts in half of the cases. What a
    collection's own pages never show, such as reader comments with paragraphs like an article's, is learned from these.
    """
    rng = random.Random(20240917)

    def words(k):
        return " ".join("".join(rng.choice("bdfgklmnprst") + rng.choice("aeiou") for _ in range(rng.randrange(1, 4))) for _ in range(k))

    def prose(tag="p", low=12, high=90):
        return f"<{tag}>{words(rng.randrange(low, high)).capitalize()}, {words(rng.randrange(3, 15))}.</{tag}>"

    def links(k):
        return "<ul>" + "".join(f"<li><a>{words(rng.randrange(1, 3))}</a></li>" for _ in range(k)) + "</ul>"

    def named(kind):
        tag, name = rng.choice(kind)
        if not name or tag != "div" and rng.random() < 0.5:
            return f"<{tag}>", f"</{tag}>"
        return f'<{tag} {rng.choice(["class", "id"])}="{name}">', f"</{tag}>"

    def wrap(kind, inner):
        start, end = named(kind)
        return start + inner + end

    def comment():
        return wrap([("div", "comment"), ("li", "comment"), ("article", "comment reply")], prose(low=3, high=40) * rng.randrange(1, 3))

    def comments():
        return wrap([("section", "comments"), ("div", "comments"), ("div", "comment list")], "".join(comment() for _ in range(rng.randrange(1, 6))))

    for _ in range(n):
        article = [f"<h1>{words(6)}</h1>"] + [rng.choice([prose, prose, prose, lambda: prose("blockquote"), lambda: f"<ul>{prose('li', 4, 15) * 3}</ul>"])() for _ in range(rng.randrange(1, 9))]
        if rng.random() < 0.3:
            article.insert(rng.randrange(1, len(article) + 1), wrap([("div", "ad"), ("aside", "related"), ("div", "newsletter"), ("div", "share social")], prose(low=3, high=20)))
        if rng.random() < 0.25:
            article.append(comments())
        body = wrap([("article", ""), ("main", ""), ("div", "content"), ("div", "post entry"), ("article", "story")], "".join(article))
        top = [wrap([("nav", ""), ("div", "menu"), ("div", "navbar"), ("header", "")], rng.choice([links, lambda k: f"<a>{words(k % 3 + 1)}</a>"])(rng.randrange(1, 9)))]
        if rng.random() < 0.4:
            top.append(wrap([("div", "cookie notice"), ("div", "banner"), ("form", "login"), ("aside", "sidebar")], prose(low=3, high=30)))
        foot = [comments()] if rng.random() < 0.4 else []
        foot += [wrap([("footer", ""), ("div", "footer"), ("footer", "footer")], prose(low=2, high=25) + (links(rng.randrange(1, 5)) if rng.random() < 0.4 else ""))]
        page = "<html><body>" + "".join(top) + body + "".join(foot) + "</body></html>"
        bare = re.sub(r"<(/?)(?:nav|header|footer|aside|main|article|form|section)(?: [^>]*)?>", r"<\1div>", page)
        yield page, re.sub(r"<(\w+) [^>]*>", r"<\1>", bare)


def train(pages: DataFrame, sample_pages: int = SAMPLE_PAGES) -> Trees:
    """Learns from the landmarks of at most `sample_pages` pages, those with the smallest hash of their url and page_id, and from
    MADE_PAGES invented ones.

    A second copy of every row hides the landmarks' own tags and tokens, so that the trees also learn from the other features.
    Of rows that share their page_id no more are taken either.
    """
    order = [F.xxhash64("page_id", "url"), F.col("page_id"), F.col("url")]
    chosen = pages.select("page_id", "url").orderBy(*order).limit(sample_pages)
    rows = pages.select("page_id", "url", "html").join(F.broadcast(chosen.select("page_id").distinct()), "page_id", "left_semi")
    rows = rows.orderBy(*order, F.xxhash64("html")).limit(sample_pages).select("page_id", "html")

    def label(batches):
        for batch in batches:
            out = []
            for id_, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                tree = parse(page or "")
                marks = landmarks(tree)
                use = marks >= 0
                out.append((str(id_), features(tree)[use].astype(np.float32).tobytes(), marks[use].astype(np.int8).tobytes()))
            yield pa.RecordBatch.from_pydict({"key": pa.array([o[0] for o in out], pa.string()), "x": pa.array([o[1] for o in out], pa.binary()), "y": pa.array([o[2] for o in out], pa.binary())})

    got = sorted(rows.mapInArrow(label, "key string, x binary, y binary").collect())
    x = np.concatenate([np.zeros((0, FEATURES)), *[np.frombuffer(r.x, np.float32).reshape(-1, FEATURES).astype(float) for r in got]])
    y = np.concatenate([np.zeros(0), *[np.frombuffer(r.y, np.int8).astype(float) for r in got]])
    hidden = x.copy()
    hidden[:, [FEATURES - 6, FEATURES - 5, FEATURES - 4, FEATURES - 3]] = 0
    xs, ys = [x, hidden], [y, y]
    for page, bare in made_pages() if len(y) else ():
        tree = parse(page)
        marks = landmarks(tree)
        for twin in (tree, tree, parse(bare)):
            xs.append(features(twin)[marks >= 0])
            ys.append(marks[marks >= 0].astype(float))
    return boost(np.concatenate(xs), np.concatenate(ys))


def extract(pages: DataFrame, model: Trees | None = None, sample_pages: int = SAMPLE_PAGES) -> DataFrame:
    """page_id, url, text and n_chars (code points) of every page.

    Character references are decoded, white space inside a block becomes one space, blocks are joined by an empty line. A null
    or empty page, or one without main text, gives an empty text; null ids and urls and repeated rows pass through; an empty
    table stays empty. Other columns are ignored.
    """
    model = model or train(pages, sample_pages)
    kinds = dict(pages.dtypes)

    def run(batches):
        for batch in batches:
            trees = [parse(page or "") for page in batch.column(2).to_pylist()]
            sizes = np.cumsum([0] + [len(t.tag) for t in trees])
            scores = model.score(np.concatenate([features(t) for t in trees])) if trees else np.zeros(0)
            texts = [text_of(t, decode(t, scores[a:b])) for t, a, b in zip(trees, sizes[:-1], sizes[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                                             names=["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
