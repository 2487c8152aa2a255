"""Main text of web pages by boosted trees over their blocks (operator 9).

The model is trained on pages of known make-up: layouts drawn at random and
filled with the text runs of some pages of the table itself. A block counts as
main if it holds main text. At prediction the blocks of a page are decided
together: the set of blocks with the largest sum of log odds in which a block's
ancestor is always in the set. So nothing main can stand below what is not.
"""

from __future__ import annotations

import html
import random

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .boost import Trees, fit
from .common import arrow_task, columns_of
from .dom import Page, features, parse

#: Pages that lend their text runs, none longer than so many characters, and the pages that are made of them.
SAMPLE_PAGES, SAMPLE_CHARS, MADE_PAGES = 100, 20_000, 800
#: Mark of main text in made pages: a character that no page uses.
MARK = "\ue000"


class Layout:
    """Draws pages whose main text is marked."""

    def __init__(self, runs: list[str], seed: int):
        self.draw = random.Random(seed)
        self.long = [r for r in runs if len(r) >= 80] or ["Some words that stand for a paragraph of an article, with an end."]
        self.short = [r for r in runs if len(r) < 80] or ["Some words", "More", "Other things"]

    def words(self, low: int, high: int) -> str:
        found = self.draw.choice(self.long).split()
        n = self.draw.randint(low, high)
        at = self.draw.randrange(max(1, len(found) - n + 1))
        return html.escape(" ".join(found[at:at + n]), quote=False)

    def phrase(self) -> str:
        return html.escape(self.draw.choice(self.short)[:60], quote=False) if self.draw.random() < 0.5 else self.words(1, 4)

    def paragraph(self) -> str:
        text = html.escape(self.draw.choice(self.long), quote=False) if self.draw.random() < 0.6 else self.words(2, 60)
        if self.draw.random() < 0.25:
            cut = text.split(" ")
            a = self.draw.randrange(len(cut))
            cut[a] = self.draw.choice(["<b>%s</b>", "<i>%s</i>", "<em>%s</em>", "<code>%s</code>", '<a href="/x">%s</a>', "<b>%s", "<span>%s</span>"]) % cut[a]
            text = " ".join(cut)
        return text

    def named(self, tag: str, names: list[str], inner: str) -> str:
        name = self.draw.choice(names)
        how = self.draw.random()
        if name and how < 0.65:
            return f'<{tag} class="{name}">{inner}</{tag}>'
        return f'<{tag} id="{name}">{inner}</{tag}>' if name and how < 0.9 else f"<{tag}>{inner}</{tag}>"

    def links(self, low: int, high: int) -> str:
        items = [f'<a href="/{i}">{self.phrase()}</a>' for i in range(self.draw.randint(low, high))]
        if self.draw.random() < 0.75:
            return "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>"
        return self.draw.choice([" | ", " ", " &middot; "]).join(items)

    def rest(self, kind: str) -> str:
        """A part that is not main."""
        d = self.draw
        say = lambda low, high: f"<p>{self.words(low, high)}</p>" if d.random() < 0.6 else self.words(low, high)
        title = f"<h{d.choice([2, 3, 4])}>{self.phrase()}</h3>" if d.random() < 0.6 else ""
        if kind == "nav":
            return self.named(d.choice(["nav", "nav", "div", "ul"]), ["nav", "menu", "navbar", "main-menu", "breadcrumb", "pagination", ""], self.links(2, 10))
        if kind == "header":
            return self.named(d.choice(["header", "header", "div"]), ["header", "site-header", "masthead", "topbar", "banner"], d.choice(["", f"<h1>{self.phrase()}</h1>", say(1, 8)]) + d.choice(["", self.links(2, 6), say(1, 12)]))
        if kind == "footer":
            return self.named(d.choice(["footer", "footer", "div"]), ["footer", "site-footer", "copyright", "bottom"], d.choice(["", "&copy; ", "Copyright "]) + say(1, 30) + d.choice(["", self.links(1, 6)]))
        if kind == "side":
            return self.named(d.choice(["aside", "aside", "div"]), ["sidebar", "side", "widget", "sidebar-right", "rail"], title + d.choice([self.links(2, 8), say(3, 60), say(3, 40) + say(3, 40)]))
        if kind == "notice":
            return self.named(d.choice(["div", "div", "section", "aside", "p"]), ["cookie-banner", "cookie-notice", "notice", "alert", "consent", "gdpr", "popup", "notification", "modal"], say(3, 40) + d.choice(["", "<button>OK</button>"]))
        if kind == "ad":
            return self.named(d.choice(["div", "div", "aside", "section", "p"]), ["ad", "ads", "advert", "advertisement", "sponsored", "promo", "ad-slot", "banner-ad"], say(2, 50))
        if kind == "form":
            fields = "".join(f"<label>{self.phrase()}</label><input name=x>" for _ in range(d.randint(1, 4)))
            return d.choice(["%s", '<div class="newsletter">%s</div>', '<section class="signup">%s</section>']) % f"<form action='/go'>{d.choice(['', say(2, 30)])}{fields}<button>{self.phrase()}</button></form>"
        if kind == "comment":
            one = lambda: self.named(d.choice(["div", "li", "article"]), ["comment", "comment-body", "reply", ""], d.choice(["", f"<b>{self.phrase()}</b>", f"<h4>{self.phrase()}</h4>"]) + say(2, 70))
            return self.named(d.choice(["section", "div", "div", "ul", "ol"]), ["comments", "comment-list", "responses", "discussion"], title + "".join(one() for _ in range(d.randint(1, 6))))
        if kind == "related":
            return self.named(d.choice(["div", "section"]), ["related", "recommended", "more-stories", "trending"], title + self.links(2, 8))
        return self.named("div", ["share", "social", "share-buttons"], self.links(1, 5))

    def main_blocks(self) -> str:
        d = self.draw
        mark = lambda t: MARK + t
        out = [f"<h1>{mark(self.words(1, 12))}</h1>"] if d.random() < 0.85 else []
        tiny = d.random() < 0.2
        for _ in range(1 if tiny else d.choice([1, 1, 2, 3, 4, 5, 8, 12])):
            form = d.random() * (0.75 if tiny else 1)
            if form < 0.78:
                end = d.choice(["</p>", "</p>", "</p>", "", "<br>"])
                out.append(f"<p>{mark(self.words(1, 6) if tiny else self.paragraph())}{end}")
            elif form < 0.85:
                out.append(f"<h{d.choice([2, 3])}>{mark(self.words(1, 8))}</h2>")
            elif form < 0.91:
                tag = d.choice(["ul", "ol"])
                out.append(f"<{tag}>" + "".join(f"<li>{mark(self.words(3, 25))}</li>" for _ in range(d.randint(2, 6))) + f"</{tag}>")
            elif form < 0.95:
                out.append(f"<blockquote>{d.choice(['', '<p>'])}{mark(self.words(5, 50))}</blockquote>")
            elif form < 0.97:
                out.append("<table>" + "".join("<tr>" + "".join(f"<td>{mark(self.words(1, 6))}</td>" for _ in range(3)) + "</tr>" for _ in range(3)) + "</table>")
            else:
                out.append(d.choice(["<pre>%s</pre>", "<div>%s</div>", "<figure><figcaption>%s</figcaption></figure>"]) % mark(self.words(4, 40)))
        for kind in ("ad", "share", "form", "notice", "related"):
            if d.random() < 0.12:
                out.insert(d.randrange(1, len(out) + 1), self.rest(kind))
        return "".join(out)

    def page(self) -> str:
        d = self.draw
        main = self.main_blocks()
        how = d.random()
        if how < 0.5:
            main = self.named("article", ["", "", "post", "article", "entry"], main)
        elif how < 0.65:
            main = f"<main>{main}</main>"
        else:
            main = self.named(d.choice(["div", "div", "section"]), ["content", "post-body", "article-body", "entry-content", "story", "main", "text", "", "c1", "x-box"], main)
        before = [self.rest(k) for k, p in (("header", 0.4), ("nav", 0.7), ("notice", 0.25), ("ad", 0.35), ("side", 0.15), ("form", 0.08)) if d.random() < p]
        after = [self.rest(k) for k, p in (("share", 0.15), ("side", 0.3), ("comment", 0.35), ("related", 0.2), ("ad", 0.2), ("form", 0.15), ("nav", 0.15), ("notice", 0.1)) if d.random() < p]
        if d.random() < 0.3:
            d.shuffle(before)
        if d.random() < 0.3:
            d.shuffle(after)
        last = [self.rest("footer")] if d.random() < 0.8 else []
        inner = "".join(before) + main + "".join(after)
        for _ in range(d.choice([0, 0, 0, 1, 2])):
            inner = self.named("div", ["wrapper", "container", "page", "row", "", "site"], inner)
        return f"<!DOCTYPE html><html><head><title>{self.phrase()}</title><script>var a;</script></head><body>{inner}{''.join(last)}" + d.choice(["</body></html>", ""])


def labelled(page: Page) -> np.ndarray:
    """Of a made page, which blocks hold main text."""
    main = np.zeros(len(page.parent), bool)
    for node, run in page.runs:
        if MARK in run:
            while node >= 0 and not main[node]:
                main[node] = True
                node = page.parent[node]
    return main


def unmarked(page: Page) -> Page:
    page.runs = [(node, run.replace(MARK, "")) for node, run in page.runs]
    return page


def train(runs: list[str], made: int = MADE_PAGES, seed: int = 7) -> Trees:
    """A model from made pages filled with these text runs. Without runs the layouts use words of their own."""
    layout = Layout(runs, seed)
    pages = [parse(layout.page()) for _ in range(made)]
    y = np.concatenate([labelled(p) for p in pages]).astype(float)
    x, _ = features([unmarked(p) for p in pages])
    return fit(x, y)


def decided(page: Page, odds: np.ndarray) -> np.ndarray:
    """The set of blocks, closed under ancestors, with the largest sum of log odds; the root is always in it."""
    worth = odds.copy()
    for i in range(len(worth) - 1, 0, -1):  # children come after their parents
        if worth[i] > 0:
            worth[page.parent[i]] += worth[i]
    chosen = np.zeros(len(worth), bool)
    chosen[0] = True
    for i in range(1, len(worth)):
        chosen[i] = worth[i] > 0 and chosen[page.parent[i]]
    return chosen


def main_texts(sources: list[str | None], model: Trees) -> list[str]:
    """Main text of pages: text runs of the chosen blocks in page order, two line ends between them."""
    out: list[str] = []
    pages: list[Page] = []

    def flush() -> None:
        x, first = features(pages)
        odds = model.predict(x)
        for page, a, b in zip(pages, first, first[1:], strict=False):
            chosen = decided(page, odds[a:b])
            # the root's own runs stand beside its parts and are main only where no part is
            lone = not chosen[1:].any()
            out.append("\n\n".join(run for node, run in page.runs if chosen[node] and (node or lone)))
        pages.clear()

    for source in sources:
        pages.append(parse(source))
        if len(pages) == 256:
            flush()
    if pages:
        flush()
    return out


def fit_pages(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> Trees:
    """The model for a table: at most SAMPLE_PAGES pages, dealt by a hash, lend their text runs."""
    some = pages.where(F.length(F.col(html_col)).between(1, SAMPLE_CHARS)).select(html_col, F.xxhash64(F.lit(9), F.col(id_col), html_col).alias("__h"))
    runs = [run for r in some.orderBy("__h", html_col).limit(SAMPLE_PAGES).collect() for _, run in parse(r[0]).runs]
    return train(runs)


def extract(pages: DataFrame, model: Trees, id_cols: tuple[str, ...] = ("page_id", "url"), html_col: str = "html") -> DataFrame:
    """Main text of every page: the id columns, `text` and `n_chars` (its code points).

    A null or empty page has an empty text, and so has one without main text.
    Whole pages are read; repeated rows each give their row; other columns are not looked at.
    """
    shared = pages.sparkSession.sparkContext.broadcast(model)

    def work(batch: pa.RecordBatch) -> dict:
        texts = main_texts(batch.column(html_col).to_pylist(), shared.value)
        return {**{c: batch.column(c) for c in id_cols}, "text": pa.array(texts, pa.string()), "n_chars": pa.array([len(t) for t in texts], pa.int64())}

    kinds = ", ".join(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in id_cols)
    return arrow_task(columns_of(pages, *id_cols, html_col), f"{kinds}, text string, n_chars long", work)
