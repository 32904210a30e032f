"""Main text of web pages: boosted trees over DOM-node features, decoded down the tree."""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.llm.boosting import BoostedTrees, fit_trees
from cadenza.llm.common import steps, text_of
from cadenza.llm.html_dom import Page

#: Pages whose paragraphs the training layouts are filled with, and bytes used of each; and layouts made.
SAMPLE_PAGES, SAMPLE_BYTES, LAYOUTS = 200, 20_000, 700

#: Fixed words of attribute values, by what they usually mark.
GROUPS: dict[str, frozenset[str]] = {
    "content": frozenset("article content post entry story main text prose articlebody".split()),
    "navigation": frozenset("nav menu navbar navigation breadcrumb breadcrumbs pagination pager tabs toc skip".split()),
    "header": frozenset("header masthead banner topbar logo branding hero".split()),
    "footer": frozenset("footer copyright legal colophon imprint".split()),
    "side": frozenset("sidebar aside related recommended widget widgets rail trending popular complementary teaser".split()),
    "advert": frozenset("ad ads advert advertisement adverts sponsor sponsored promo promotion adsense".split()),
    "notice": frozenset("cookie cookies consent notice notices alert gdpr newsletter popup modal paywall disclaimer warning overlay toast".split()),
    "form": frozenset("form search login signup signin subscribe register".split()),
    "comment": frozenset("comment comments commentlist reply replies discussion disqus respond reader readers feedback".split()),
    "share": frozenset("share social follow tags byline author meta sharing".split()),
}
TAGS: tuple[frozenset[str], ...] = tuple(
    frozenset(x.split()) for x in ("article main", "nav menu", "header", "footer", "aside", "form fieldset label", "div section", "ul ol dl li dt dd", "p blockquote pre", "h1 h2 h3 h4 h5 h6", "a", "table tbody tr td th", "html body #root")
)
N_GROUPS, N_TAGS = len(GROUPS), len(TAGS)
_GROUP_OF = {w: 1 << k for k, ws in enumerate(GROUPS.values()) for w in ws}
_TAG_OF = {t: 1 << N_GROUPS + k for k, ts in enumerate(TAGS) for t in ts}
_PARAGRAPH = 1 << N_GROUPS + 8
#: Marks that tell what an element is for: all attribute words, and the tags from article to form.
_TELLING = (1 << N_GROUPS + 6) - 1


def features(pages: list[Page]) -> np.ndarray:
    """One row for every node of the pages, in order: marks of the node, of all its ancestors and of the nearest telling one, and
    figures of its subtree."""
    own: list[int] = []
    nearest: list[int] = []
    above: list[int] = []
    parents: list[int] = []
    ends: list[int] = []
    depth: list[int] = []
    index: list[int] = []
    children: list[int] = []
    roots: list[int] = []
    size: list[int] = []
    links: list[int] = []
    stops: list[int] = []
    for page in pages:
        base, n = len(own), len(page.tags)
        mark = [_TAG_OF.get(tag, 0) for tag in page.tags]
        for k, words in enumerate(page.words):
            for w in words:
                mark[k] |= _GROUP_OF.get(w, 0)
        over, near, deep, nth, below, link = [0] * n, [0] * n, [0] * n, [0] * n, [0] * n, [False] * n
        for k in range(1, n):
            up = page.parents[k]
            over[k] = over[up] | mark[up]
            near[k] = mark[up] if mark[up] & _TELLING else near[up]
            deep[k] = deep[up] + 1
            nth[k] = below[up]
            below[up] += 1
            link[k] = link[up] or page.tags[k] == "a"
        chars, linked, marks = [0] * n, [0] * n, [0] * n
        for node, text, _ in page.runs:
            if not page.silent[node] and not text.isspace():
                length = len(text) - text.count(" ")
                chars[node] += length
                marks[node] += text.count(".") + text.count(",")
                if link[node]:
                    linked[node] += length
        own += mark
        above += over
        nearest += near
        depth += deep
        index += nth
        children += below
        size += chars
        links += linked
        stops += marks
        roots += [base] * n
        parents += [base + max(0, up) for up in page.parents]
        ends += [base + e for e in page.ends]
    n = len(own)
    flags, up, end, root = np.array(own), np.array(parents), np.array(ends), np.array(roots)
    bits = np.arange(N_GROUPS + N_TAGS)
    total = np.zeros((n + 1, 5))
    np.cumsum(np.stack([size, links, stops, np.ones(n), (flags & _PARAGRAPH) > 0], axis=1), axis=0, out=total[1:])
    text, link, stop, count, paragraphs = (total[end] - total[:n]).T
    siblings = np.maximum(1, np.array(children)[up])
    page_text = np.maximum(1.0, text[root])
    more = [
        np.log1p(text),
        text / page_text,
        link / np.maximum(1, text),
        text / count,
        stop / np.maximum(1, text),
        np.array(depth),
        siblings,
        np.array(index) / np.maximum(1, siblings - 1),
        np.log1p(text[up]),
        text / np.maximum(1, text[up]),
        (text[up] - text) / np.maximum(1, siblings - 1),
        np.log1p(paragraphs),
        np.log1p(count),
        (total[:n, 0] - total[root, 0]) / page_text,
    ]
    marked = [(np.array(x)[:, None] >> bits) & 1 for x in (own, above, nearest)]
    return np.concatenate([np.stack(more, axis=1), *marked], axis=1).astype(np.float32)


def decode(page: Page, log_odds: np.ndarray) -> list[bool]:
    """Which nodes to keep: the likeliest labelling in which nothing below a dropped node is kept."""
    n = len(page.parents)
    keep, drop = (-np.logaddexp(0, -log_odds)).tolist(), (-np.logaddexp(0, log_odds)).tolist()
    all_drop, best_below = list(drop), [0.0] * n
    for k in range(n - 1, 0, -1):
        up = page.parents[k]
        if page.silent[k]:
            keep[k] = -1e9
        all_drop[up] += all_drop[k]
        best_below[up] += max(all_drop[k], keep[k] + best_below[k])
    kept = [True] * n
    for k in range(1, n):
        kept[k] = kept[page.parents[k]] and keep[k] + best_below[k] > all_drop[k]
    return kept


def text_from(page: Page, kept: list[bool]) -> str:
    """Blocks in page order, one a line; white space inside a block is one space."""
    blocks: dict[int, list[str]] = {}
    for node, text, block in page.runs:
        if kept[node]:
            blocks.setdefault(block, []).append(text)
    return "\n".join(filter(None, (" ".join("".join(parts).split()) for parts in blocks.values())))


def layout(rng: random.Random, paragraphs: list[str]) -> str:
    """A made-up page around real paragraphs; data-main marks what belongs to the article."""
    short = lambda: " ".join(rng.choice(paragraphs).split()[: rng.randint(1, 9)]) or "x"
    some = lambda: rng.choice(paragraphs)

    def named(words: str, tag: str, inner: str, marked: str = "") -> str:
        """An element of a telling tag, or a plain one with a telling name, seldom without."""
        word = rng.choice(words.split())
        kind = rng.random()
        attribute = f' class="{rng.choice(["", "js ", "x-"])}{word}{rng.choice(["", "-box", "_inner", " wide", "Wrap"])}"' if kind < 0.7 else f' id="{word}"' if kind < 0.9 else ""
        name = tag if rng.random() < 0.5 or not attribute else rng.choice(["div", "section"])
        return f"<{name}{attribute}{marked}>{inner}</{name}>"

    def links() -> str:
        return "<ul>" + "".join(f'<li><a href="/{k}">{short()}</a></li>' for k in range(rng.randint(2, 9))) + "</ul>"

    def person() -> str:
        return named("comment reply", "div", f"<p>{some()}</p>" + f"<span>{short()}</span>" * rng.randint(0, 1))

    extra = {
        "nav": lambda: named("nav menu navbar navigation breadcrumbs", "nav", links()),
        "header": lambda: named("header masthead banner topbar", "header", rng.choice(["", "<h1>" + short() + "</h1>", links()]) + f"<p>{short()}</p>"),
        "footer": lambda: named("footer copyright legal", "footer", rng.choice([f"&copy; {short()} &middot; {some()}", f"<p>{some()}</p>", links() + f"<p>{short()}</p>"])),
        "side": lambda: named("sidebar related widget popular recommended", "aside", f"<h3>{short()}</h3>" * rng.randint(0, 1) + rng.choice([links(), f"<p>{some()}</p>" * rng.randint(1, 3)])),
        "advert": lambda: named("ad ads advert sponsored promo", "div", rng.choice([short(), some(), f"<p>{some()}</p>", f'<a href="/x">{short()}</a>'])) if rng.random() < 0.9 else "",
        "notice": lambda: named("cookie consent notice newsletter alert popup", "div", rng.choice([short(), some(), f"<p>{some()}</p>"]) + f"<button>{short()}</button>" * rng.randint(0, 1)),
        "form": lambda: f"<form{rng.choice(['', ' class=search', ' id=login'])}>" + rng.choice(["", f"<p>{short()}</p>", some()]) + f"<label>{short()}</label><input name=q><button>{short()}</button></form>",
        "comments": lambda: named("comments comment-list discussion replies", rng.choice(["section", "div", "ol"]), f"<h3>{short()}</h3>" * rng.randint(0, 1) + "".join(person() for _ in range(rng.randint(1, 6)))),
        "share": lambda: named("share social tags", "div", links()),
    }

    def block() -> str:
        at = " data-main=1"
        kind = rng.random()
        if kind < 0.72:
            return f"<p{at}>{some()}</p>" if rng.random() < 0.8 else f"<p{at}><b{at}>{some()}<br>"
        if kind < 0.8:
            return f"<h2{at}>{short()}</h2>"
        if kind < 0.86:
            return f"<ul{at}>" + "".join(f"<li{at}>{rng.choice([short(), some()])}</li>" for _ in range(rng.randint(1, 5))) + "</ul>"
        if kind < 0.9:
            return f"<blockquote{at}><p{at}>{some()}</p></blockquote>"
        if kind < 0.94:
            return f'<p{at}>{some()} <a href="/y"{at}>{short()}</a> {some()}</p>'
        return f"<div{at}>{some()}</div>"

    inner = ([f"<h1 data-main=1>{short()}</h1>"] if rng.random() < 0.85 else []) + [block() for _ in range(rng.randint(1, 14))]
    inside = [k for k in ("advert", "share", "comments", "side", "notice", "form") if rng.random() < 0.15]
    for k in inside:
        inner.insert(len(inner) if k == "comments" else rng.randint(1, len(inner)), extra[k]())
    article = named("article content post entry story", "article", "".join(inner), " data-main=1") if rng.random() < 0.93 else "".join(inner)
    if rng.random() < 0.4:
        article = named("main content wrapper page container", "main", article + "".join(extra[k]() for k in ("comments", "side") if rng.random() < 0.2))
    before = [extra[k]() for k in ("header", "nav", "notice", "advert", "form", "side") if rng.random() < 0.4]
    after = [extra[k]() for k in ("comments", "side", "advert", "form", "notice", "share", "footer") if rng.random() < 0.4]
    rng.shuffle(before)
    body = "".join(before) + article + "".join(after)
    if rng.random() < 0.3:
        body = f'<div class="{rng.choice(["page", "wrapper", "site", "container"])}">{body}</div>'
    return f"<!DOCTYPE html><html><head><title>{short()}</title><style>p{{}}</style></head><body>{body}</body></html>"


def train(sample: list[str], seed: int = 5, layouts: int = LAYOUTS) -> BoostedTrees:
    """Trees that tell nodes with article text below them from all others, learnt on layouts filled with the sample's paragraphs."""
    rng = random.Random(seed)
    paragraphs: list[str] = []
    for source in sample:
        paragraphs += [t.replace("&", "&amp;").replace("<", "&lt;") for _, t, _ in Page(source).runs if len(t) > 20]
    paragraphs = sorted(set(paragraphs))
    if len(paragraphs) < 20:
        paragraphs += [" ".join("word" * rng.randint(1, 2) for _ in range(rng.randint(3, 60))) + "." for _ in range(40)]
    pages = [Page(layout(rng, paragraphs)) for _ in range(layouts)]
    x = features(pages)
    y = np.concatenate([np.diff(np.cumsum([0, *p.marked])[[range(len(p.ends)), p.ends]], axis=0)[0] > 0 for p in pages])
    used = np.concatenate([[False, *(not s for s in p.silent[1:])] for p in pages])
    longer = np.sqrt(1 + x[:, 0])  # longer texts matter more
    return fit_trees(x[used], y[used].astype(float), longer[used])


def extract_text(pages: DataFrame, page: str = "page_id", url: str = "url", html: str = "html", sample_pages: int = SAMPLE_PAGES) -> DataFrame:
    """page_id, url, text and n_chars of every page.

    The trees are trained here, on made-up layouts around paragraphs of a bounded sample of pages (the `sample_pages` with the least
    hash of id and address, SAMPLE_BYTES of each); every page is then read whole, in one pass without a shuffle. A node's
    features: tag, attribute words, the same of its ancestors, text and link density of its subtree, depth, siblings. Decoding keeps
    the likeliest set of nodes in which no kept node lies below a dropped one. Scripts, styles and controls never have text.

    Null html counts as empty and gives an empty text; broken and cut-off markup is read as far as it goes. Repeated rows
    give repeated results, null ids and addresses stay null, an empty table gives no rows, other columns are ignored.
    """
    rows = pages.select(F.col(page).alias("page_id"), F.col(url).alias("url"), text_of(html).alias("html"))
    hashed = rows.select(F.xxhash64("page_id", "url").alias("k"), F.substring("html", 1, SAMPLE_BYTES).alias("html"))
    least = [r["k"] for r in hashed.select("k").distinct().orderBy("k").limit(sample_pages).collect()]  # numbers only, then the chosen texts
    sample = hashed.where(F.col("k").isin(least)).groupBy("k").agg(F.min("html").alias("html")).orderBy("k").collect()
    shared = pages.sparkSession.sparkContext.broadcast(train([r["html"] for r in sample]))

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in steps(batches, "html", 1 << 20):
            read = [Page(source) for source in part.column("html").to_pylist()]
            odds = shared.value.log_odds(features(read))
            texts, at = [], 0
            for page in read:
                texts.append(text_from(page, decode(page, odds[at : at + len(page.tags)])))
                at += len(page.tags)
            yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    kind = rows.schema["page_id"].dataType.simpleString()
    return rows.mapInArrow(extract, f"page_id {kind}, url string, text string, n_chars long")
