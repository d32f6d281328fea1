"""Main text of HTML pages from flat text blocks.

A page is cut into text blocks at its block-level tags. Every block has its word count and link density, those
of its neighbours, and what its ancestors say. A decision tree, grown on a small table of labelled blocks,
tells article blocks from boilerplate.
"""

from __future__ import annotations

import html as entities
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.columns import without

# Element names of the HTML standard, and words that sites use in class and id attributes.
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th "
    "thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes noscript template svg math object select canvas audio video".split())
IMPLIED_END = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}, "option": {"option"},
}
SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "td": {"table"}, "th": {"table"}, "tr": {"table"}, "option": set()}
BOILERPLATE_TAGS = frozenset("nav aside form footer header menu dialog search button".split())
BOILERPLATE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright "
    "disclaimer discussion disqus footer form header login masthead menu modal nav navbar navigation newsletter notice notices "
    "notification pagination paywall popup promo promoted promotion recommended related replies reply share sharing sidebar signup "
    "social sponsor sponsored subscribe subscription tags toolbar topbar widget".split()
)
ARTICLE_TAGS = frozenset(("article", "main"))
ARTICLE_WORDS = frozenset("article articlebody content entry entrycontent main maincontent post postbody postcontent story storybody".split())
BOILERPLATE_ROLES = frozenset("banner navigation complementary contentinfo search form dialog alert menu menubar toolbar".split())

HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
NAME = re.compile(r"[a-zA-Z][^\s/>]*")
ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""")
MARKING = re.compile("class|id|role|style|hidden", re.IGNORECASE)
OPEN_QUOTE = re.compile(r"""=\s*(?:"[^"]*"|'[^']*'|[^\s"'>]+)""")
WORD = re.compile(r"[a-zA-Z]+")
FEATURES = (
    "words", "link_density", "previous_words", "previous_link_density", "next_words", "next_link_density",
    "near_words", "near_link_density", "in_boilerplate", "in_article", "page_has_article", "heading",
)
#: Blocks on either side that count as near.
NEAR = 3


@dataclass
class Block:
    text: str
    words: int
    link_density: float
    boilerplate: bool
    article: bool
    heading: bool


@dataclass
class _Element:
    name: str
    boilerplate: bool
    article: bool


def _tag_end(page: str, at: int) -> int:
    """Where the tag that starts at `at` ends, past '>' signs inside quoted values; -1 if it does not."""
    start, end = at, page.find(">", at)
    if end < 0 or "=" not in (inner := page[at:end]) or ('"' not in inner and "'" not in inner):
        return end
    while end >= 0:
        rest = OPEN_QUOTE.sub("", page[start:end])
        m = re.search(r"""=\s*(["'])[^"']*$""", rest)
        if not m:
            return end
        close = page.find(m[1], end)
        if close < 0:
            return -1
        start, end = close + 1, page.find(">", close)
    return -1


def _marks(name: str, attributes: str) -> tuple[bool, bool]:
    """Whether an element itself says that it is boilerplate, or the article."""
    boilerplate, article = name in BOILERPLATE_TAGS, name in ARTICLE_TAGS
    if attributes and MARKING.search(attributes):
        for m in ATTRIBUTE.finditer(attributes):
            key, value = m[1].lower(), m[2].strip("\"'")
            if key in ("class", "id"):
                for token in value.split():
                    parts = [w.lower() for w in WORD.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", token))]
                    boilerplate |= any(w in BOILERPLATE_WORDS for w in parts)
                    article |= "".join(parts) in ARTICLE_WORDS
            elif key == "role":
                boilerplate |= value.lower() in BOILERPLATE_ROLES
                article |= value.lower() in ("main", "article")
            elif key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
                boilerplate = True
        if "hidden" in attributes and re.search(r"(?:^|\s)hidden(?:\s|=|/|$)", ATTRIBUTE.sub(" ", attributes)):
            boilerplate = True
    return boilerplate, article


def blocks(page: str) -> list[Block]:
    """The text blocks of a page in order; linear in its length. Broken markup is read as browsers do, roughly."""
    out: list[Block] = []
    stack: list[_Element] = [_Element("#root", False, False)]
    open_names: dict[str, int] = {}
    pieces: list[tuple[str, bool]] = []
    links = 0

    def flush() -> None:
        if not pieces:
            return
        text = "".join([p for p, _ in pieces])
        parts = (entities.unescape(text) if "&" in text else text).split()
        if parts:
            linked = sum([len(p.split()) for p, in_link in pieces if in_link])
            n, top = len(parts), stack[-1]
            out.append(Block(" ".join(parts), n, min(1.0, linked / n), top.boilerplate, top.article, any([e.name in HEADINGS for e in stack[-3:]])))
        pieces.clear()

    def pop_to(k: int) -> None:
        nonlocal links
        for e in stack[k:]:
            open_names[e.name] -= 1
            links -= e.name == "a"
        del stack[k:]

    def close(names: set[str], scope: set[str]) -> None:
        """Ends the innermost open element of `names`, if it is not outside an element of `scope`."""
        if any(open_names.get(n) for n in names):
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].name in names:
                    pop_to(k)
                    return
                if stack[k].name in scope:
                    return

    at, n = 0, len(page)
    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            lt = n
        if lt > at:
            pieces.append((page[at:lt], links > 0))
        if lt == n:
            break
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4)
            at = n if end < 0 else end + 3
            continue
        if page[lt + 1 : lt + 2] in ("!", "?"):
            end = page.find(">", lt)
            at = n if end < 0 else end + 1
            continue
        ending = page[lt + 1 : lt + 2] == "/"
        m = NAME.match(page, lt + 1 + ending)
        if not m:
            pieces.append(("<", links > 0))
            at = lt + 1
            continue
        end = _tag_end(page, m.end())
        if end < 0:
            break  # an unfinished tag at the end of the page is no text
        name, attributes = m[0].lower(), page[m.end() : end]
        at = end + 1
        if name == "br":
            pieces.append((" ", False))
            continue
        if ending:
            if name in BLOCK:
                flush()
            if open_names.get(name):
                close({name}, set() if name in BLOCK else BLOCK)
            continue
        if name in BLOCK:
            flush()
            close({"p"}, {"td", "th", "table", "button", "object"})
        if name in IMPLIED_END:
            close(IMPLIED_END[name], SCOPE[name])
        if name in VOID:
            continue
        if name in RAW:
            if not attributes.endswith("/"):
                stop = re.compile(rf"</{name}(?=[\s/>])", re.IGNORECASE).search(page, at)
                at = n if not stop else page.find(">", stop.end())
                at = n if at < 0 else at + (at < n)
            continue
        top = stack[-1]
        boilerplate, article = _marks(name, attributes)
        if name in ("header", "footer", "form", "body", "html", "main", "article"):
            # The head of an article holds its title; whole-page elements may have any class.
            boilerplate = boilerplate and not (name == "header" and top.article) and name not in ("body", "html", "main", "article")
        links += name == "a"
        open_names[name] = open_names.get(name, 0) + 1
        stack.append(_Element(name, top.boilerplate or boilerplate, top.article or article))
    flush()
    return out


def block_features(found: list[Block]) -> list[tuple[float, ...]]:
    """The FEATURES of each block of a page; near_words counts the words outside links of the NEAR blocks on either side."""
    has = float(any(b.article and not b.boilerplate for b in found))
    words, linked = [0.0], [0.0]
    for b in found:
        words.append(words[-1] + b.words)
        linked.append(linked[-1] + b.words * b.link_density)
    out = []
    for i, b in enumerate(found):
        p, q = (found[i - 1] if i else None), (found[i + 1] if i + 1 < len(found) else None)
        low, high = max(0, i - NEAR), min(len(found), i + NEAR + 1)
        w = words[high] - words[low] - b.words
        in_links = linked[high] - linked[low] - b.words * b.link_density
        sides = (float(p.words if p else 0), p.link_density if p else 0.0, float(q.words if q else 0), q.link_density if q else 0.0)
        out.append((float(b.words), b.link_density, *sides, max(0.0, w - in_links), in_links / w if w else 0.0, float(b.boilerplate), float(b.article), has, float(b.heading)))
    return out


def grow(rows: np.ndarray, labels: np.ndarray, depth: int = 12, least: int = 2):
    """A CART tree by Gini impurity: (feature, threshold, below, above), or True or False at a leaf."""
    share = labels.mean() if len(labels) else 0.0
    if depth == 0 or share in (0.0, 1.0) or len(labels) < 2 * least:
        return bool(share >= 0.5)
    best = None
    for f in range(rows.shape[1]):
        order = np.argsort(rows[:, f], kind="stable")
        x, y = rows[order, f], labels[order].astype(np.float64)
        left = np.arange(1, len(y))
        ones = np.cumsum(y)[:-1]
        right_ones = y.sum() - ones
        right = len(y) - left
        cost = 2 * ones * (1 - ones / left) + 2 * right_ones * (1 - right_ones / right)
        cost = np.where((x[1:] > x[:-1]) & (left >= least) & (right >= least), cost, np.inf)
        k = int(np.argmin(cost)) if len(cost) else 0
        if len(cost) and np.isfinite(cost[k]) and (best is None or cost[k] < best[0] - 1e-12):
            best = (cost[k], f, (x[k] + x[k + 1]) / 2)
    if best is None:
        return bool(share >= 0.5)
    _, f, t = best
    low = rows[:, f] <= t
    return (f, float(t), grow(rows[low], labels[low], depth - 1, least), grow(rows[~low], labels[~low], depth - 1, least))


def decide(tree, row: tuple[float, ...]) -> bool:
    while not isinstance(tree, bool):
        f, t, below, above = tree
        tree = below if row[f] <= t else above
    return tree


def labelled_pages(n: int = 600, seed: int = 7) -> list[tuple[str, list[bool]]]:
    """`n` invented pages, with a label for each of their blocks: whether it is the article's.

    A third says by tags, roles or class names what is what; some articles there have few words. A third has no such mark at all, only divisions and
    tables, so that words, link densities and those of the neighbours must do. In the last third a mark misleads:
    a list of links stands inside what is marked as the article, or whole pages are marked as the main content.
    Articles have headings, short and long paragraphs, and links inside paragraphs.
    """
    rng = random.Random(seed)
    word = lambda n: " ".join(f"w{rng.randrange(60)}" for _ in range(n))
    link = lambda n: f'<a href="/{rng.randrange(99)}">{word(n)}</a>'

    def menu(least: int = 3) -> tuple[str, int]:
        k, form = rng.randint(least, 8), rng.randrange(3)
        items = [link(rng.randint(1, 4)) for _ in range(k)]
        if form == 0:
            return f"<ul>{''.join(f'<li>{x}</li>' for x in items)}</ul>", k
        if form == 1:
            return f"<table><tr>{''.join(f'<td>{x}</td>' for x in items)}</tr></table>", k
        return f"<div>{' | '.join(items)}</div>", 1

    def article() -> tuple[str, int]:
        out = [rng.choice(("<h1>{}</h1>", "<h2>{}</h2>", "<div><h1>{}</h1></div>")).format(word(rng.randint(1, 10)))]
        sizes = [rng.choice((rng.randint(20, 140), rng.randint(20, 140), rng.randint(5, 20), rng.randint(1, 4))) for _ in range(rng.choice((1, 1, 2, 2, 3, 4, 5, 6, 7, 8)))]
        if sum(sizes) < 50:
            sizes.insert(rng.randrange(len(sizes) + 1), rng.randint(50, 160))
        for s in sizes:
            inner = word(s)
            if s > 12 and rng.random() < 0.3:
                inner = f"{word(s // 2)} {link(rng.randint(1, 3))} {word(s - s // 2)}"
            out.append(rng.choice(("<p>{}</p>", "<p>{}", "<div>{}</div>", "<blockquote>{}</blockquote>") if s > 4 else ("<p>{}</p>", "<p>{}")).format(inner))
            if out[-1].startswith("<p>") and rng.random() < 0.1:
                out.append(f"<h3>{word(rng.randint(1, 5))}</h3>")
        return "".join(out), len(out)

    def brief() -> tuple[str, int]:
        """An article of few words, which only marks can tell from boilerplate."""
        k = rng.randint(1, 3)
        return "".join(f"<p>{word(rng.randint(1, 9))}</p>" for _ in range(k)), k

    def aside() -> tuple[str, int]:
        """Boilerplate that says so."""
        form = rng.randrange(7)
        text = word(rng.randint(2, 160))
        if form == 0:
            m, k = menu()
            return f"<nav>{m}</nav>", k
        if form == 1:
            return f"<footer><p>{text}</p></footer>", 1
        if form == 2:
            m, k = menu()
            return f"<aside><p>{text}</p>{m}</aside>", k + 1
        if form == 3:
            return f"<form><p>{text}</p><p>{word(3)}</p></form>", 2
        if form == 4:
            return f"<header><p>{text}</p></header>", 1
        name = rng.choice(("ad", "sidebar", "cookie-notice", "promo box", "comment-list", "comments", "related", "newsletter signup", "share-buttons"))
        return f"<div class='{name}'><p>{text}</p><p>{word(rng.randint(1, 40))}</p></div>", 2

    def stub() -> tuple[str, int]:
        """A line of boilerplate without a mark: a site's name, a date, a copyright."""
        inner = rng.choice((word(rng.randint(1, 8)), f"{word(rng.randint(1, 4))} {link(rng.randint(1, 3))}", link(rng.randint(1, 5))))
        return f"<div>{inner}</div>", 1

    out = []
    for k in range(n):
        parts: list[tuple[str, list[bool]]] = []
        add = lambda made, label: parts.append((made[0], [label] * made[1]))  # noqa: B023, E731
        if k % 3 == 0:
            for _ in range(rng.randint(0, 3)):
                add(aside() if rng.random() < 0.7 else stub(), False)
            inner, count = article() if rng.random() < 0.6 else brief()
            labels = [True] * count
            if rng.random() < 0.5:
                more, extra = aside()
                if not more.startswith("<header"):
                    inner, labels = inner + "</p>" + more, labels + [False] * extra
            open_tag, close_tag = rng.choice((("<article>", "</article>"), ("<main>", "</main>"), ("<div class='post-content'>", "</div>"), ("<div role='main'>", "</div>"), ("<div id='content'>", "</div>")))
            parts.append((open_tag + inner + close_tag, labels))
            for _ in range(rng.randint(0, 3)):
                add(aside() if rng.random() < 0.7 else stub(), False)
        else:
            whole = k % 12 == 2
            for _ in range(rng.randint(1, 3)):
                add(menu() if rng.random() < 0.6 else stub(), False)
            made = article()
            if k % 3 == 2 and not whole:
                links, count = menu(4)
                parts.append((f"<article>{made[0]}</p><ul>{links}</ul></article>", [True] * made[1] + [False] * count))
            else:
                parts.append((f"<div>{made[0]}</div>", [True] * made[1]))
            for _ in range(rng.randint(1, 3)):
                add(menu() if rng.random() < 0.6 else stub(), False)
            if whole:
                parts = [("<div id='content'>" + "".join(p for p, _ in parts) + "</div>", [x for _, labels in parts for x in labels])]
        out.append(("<body>" + "".join(p for p, _ in parts) + "</body>", [x for _, labels in parts for x in labels]))
    return out


def labelled_table(n: int = 600, seed: int = 7) -> list[tuple[tuple[float, ...], bool]]:
    """(features, label) of every block of labelled_pages(n, seed)."""
    out = []
    for page, labels in labelled_pages(n, seed):
        found = blocks(page)
        if len(found) != len(labels):
            raise ValueError(f"{len(labels)} labels for {len(found)} blocks: {page}")
        out += zip(block_features(found), labels, strict=True)
    return out


def train(table: list[tuple[tuple[float, ...], bool]] | None = None):
    table = labelled_table() if table is None else table
    return grow(np.array([r for r, _ in table]), np.array([y for _, y in table]))


def main_text(page: str | None, tree) -> str:
    found = blocks(page or "")
    return "\n".join(b.text for b, row in zip(found, block_features(found), strict=True) if decide(tree, row))


def extract(pages: DataFrame, *, html_col: str = "html", table: list[tuple[tuple[float, ...], bool]] | None = None) -> DataFrame:
    """Adds text (the main text, empty if none) and n_chars (its code points); drops the html column.

    One pass, no shuffle: every page is read and decided by itself, and memory holds a batch of pages. A null
    page counts as empty. Repeated rows are treated alike; an empty table gives an empty result. Input columns
    named text or n_chars are replaced. `table` has labelled rows, (FEATURES, label), to grow the tree on.
    """
    tree = train(table)
    rest = [c for c in without(pages, "text", "n_chars", html_col).columns]
    # Plain names on the way, as mapInArrow can't resolve names with dots.
    plain = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(rest)]
    given = pages.select(*plain, F.col(html_col).alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py(), tree) for x in batch.column(len(rest))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(i) for i in range(len(rest))] + [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=[*[f"c{i}" for i in range(len(rest))], "text", "n_chars"],
            )

    schema = pages.select(*plain, F.lit("").alias("text"), F.lit(0).cast("long").alias("n_chars")).schema
    return given.mapInArrow(run, schema).toDF(*rest, "text", "n_chars")
