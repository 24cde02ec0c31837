"""Main text of web pages: boosted trees over block features, decoded so that choices never contradict.

Pages come without labels, so the model is trained on pages laid out here: an article and everything that
surrounds articles (menus, headers, sidebars, notices, adverts, forms, reader comments, footers), in many
layouts and with many names, filled with words of a bounded sample of the table's own pages.  A block
counts as wanted when it holds article text.  Trees give each block a margin; of all sets of blocks in which a
block's parent is in the set too, the one with the largest sum is kept.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import dom, trees
from .common import row_batches, spread_sample

#: Pages whose words fill the training pages, about, and the number of those.
SAMPLE_ROWS = 150
#: Words of those pages that are used, about; beyond it a hash of the word chooses.
SAMPLE_WORDS = 20_000
TRAIN_PAGES = 260
#: In training pages a run of article text starts with this private character.
_SIGN = "\ue000"

# Names that page authors commonly give to the parts of a page.
ARTICLE = "article content post entry story main body text article-body post-content entry-content story-body maincontent".split()
NOISE = {
    "menu": "nav menu navbar navigation topnav main-menu breadcrumb breadcrumbs pagination pager tabs site-nav links".split(),
    "header": "header site-header masthead top topbar banner branding page-header logo".split(),
    "sidebar": "sidebar side aside widget widgets related related-posts popular recent trending toc recommended".split(),
    "notice": "notice cookie cookie-banner cookie-consent consent gdpr alert popup modal overlay message paywall warning".split(),
    "advert": "ad ads advert advertisement sponsor sponsored promo promotion ad-slot adsense banner-ad".split(),
    "form": "form newsletter signup subscribe search search-form login contact-form".split(),
    "comments": "comments comment comment-list reader-comments discussion replies responses respond disqus".split(),
    "footer": "footer site-footer bottom copyright legal colophon page-footer".split(),
    "share": "share social sharing social-links follow byline-links tags meta tools".split(),
}
#: Names of links and spans inside running text, in articles and around them.
INLINE = "ref link external tag label highlight name term note tooltip mention keyword text date author count icon title".split()
SEMANTIC = {"menu": "nav", "header": "header", "sidebar": "aside", "form": "form", "footer": "footer"}


class _Layout:
    """One training page, written at random."""

    def __init__(self, rng: np.random.Generator, words: list[str]):
        self.rng, self.words = rng, words

    def pick(self, options):
        return options[int(self.rng.integers(len(options)))]

    def some(self, low: int, high: int) -> str:
        n = int(np.exp(self.rng.uniform(np.log(low), np.log(high + 1))))
        return " ".join(self.words[int(i)] for i in self.rng.integers(0, len(self.words), max(1, n)))

    def sentence(self, low: int, high: int) -> str:
        text = self.some(low, high)
        return text[:1].upper() + text[1:] + ("." if self.rng.random() < 0.8 and text[-1:].isalnum() else "")

    def prose(self, low: int, high: int) -> str:
        text = self.sentence(low, high)
        if self.rng.random() < 0.15:
            a = text.split(" ")
            k = int(self.rng.integers(len(a)))
            a[k] = f"{self.pick(['<b>', '<em>', '<a href=/x>', '<span>'])}{a[k]}{self.pick(['</b>', '</em>', '</a>', '</span>'])}"
            text = " ".join(a)
        return self.marked(text, 0.3)

    def marked(self, text: str, share: float) -> str:
        """Some words of the text in a link or span with a class or id."""
        if self.rng.random() < share:
            a = text.split(" ")
            for _ in range(int(self.rng.integers(1, 4))):
                k, tag = int(self.rng.integers(len(a))), self.pick(["a", "a", "span", "span", "em", "b"])
                name = self.pick(INLINE) if self.rng.random() < 0.8 else self.pick(NOISE[self.pick(list(NOISE))])
                href = " href=/x?id=1" if tag == "a" else ""
                a[k] = f'<{tag}{href} {self.pick(["class", "class", "id"])}="{name}">{a[k]}</{tag}>'
            text = " ".join(a)
        return text

    def named(self, names, semantic: str | None = None) -> tuple[str, str]:
        """Opening and closing tag of a part."""
        name = self.pick(names)
        if semantic and self.rng.random() < 0.5:
            attributes = f' class="{name}"' if self.rng.random() < 0.4 else ""
            return f"<{semantic}{attributes}>", f"</{semantic}>"
        tag = self.pick(["div", "div", "div", "section", "aside" if semantic == "aside" else "div"])
        return f'<{tag} {self.pick(["class", "class", "id"])}="{name}">', f"</{tag}>"

    def listing(self, n: int, long: bool = False) -> str:
        item = lambda: f'<a href="/{self.some(1, 2)}">{self.some(1, 9 if long else 3)}</a>'
        if self.rng.random() < 0.75:
            return "<ul>" + "".join(f"<li>{item()}</li>" for _ in range(n)) + "</ul>"
        return " | ".join(item() for _ in range(n))

    def noise(self, kind: str) -> str:
        start, end = self.named(NOISE[kind], SEMANTIC.get(kind))
        r = self.rng
        if kind == "menu":
            inner = self.listing(int(r.integers(3, 10)))
        elif kind == "header":
            inner = self.pick([f"<h1>{self.some(1, 4)}</h1>", f"<a href='/'>{self.some(1, 3)}</a>", f"<p>{self.sentence(3, 10)}</p>"])
            inner += self.listing(int(r.integers(3, 7))) if r.random() < 0.5 else ""
        elif kind == "sidebar":
            inner = f"<h3>{self.some(1, 4)}</h3>" + self.pick([
                self.listing(int(r.integers(3, 8)), True), f"<p>{self.sentence(5, 40)}</p>",
                f"<p>{self.sentence(5, 25)}</p><p>{self.sentence(5, 25)}</p>", self.sentence(4, 25)])
        elif kind in ("notice", "advert"):
            inner = self.pick([self.sentence(3, 30), f"<p>{self.sentence(3, 40)}</p>",
                               f"{self.sentence(3, 15)} <a href='/p'>{self.some(1, 3)}</a>",
                               f"<p>{self.sentence(4, 20)}</p><button>{self.some(1, 2)}</button>"])
        elif kind == "form":
            inner = f"<label>{self.some(1, 5)}</label><input name='q'><button>{self.some(1, 2)}</button>"
            inner = (f"<p>{self.sentence(4, 18)}</p>" if r.random() < 0.5 else "") + inner
            inner = inner if start.startswith("<form") or r.random() < 0.3 else f"<form>{inner}</form>"
        elif kind == "comments":
            one = lambda: self.pick([
                f'<div class="comment"><b>{self.some(1, 2)}</b><p>{self.sentence(3, 60)}</p></div>',
                f"<li><p>{self.sentence(3, 60)}</p></li>", f'<div class="comment-body">{self.sentence(3, 50)}</div>',
                f"<article><p>{self.sentence(3, 40)}</p></article>", f"<p>{self.sentence(3, 50)}</p>"])
            inner = f"<h3>{self.some(1, 3)}</h3>" + "".join(one() for _ in range(int(r.integers(1, 7))))
        elif kind == "footer":
            inner = self.pick([f"&copy; {self.some(1, 4)} &middot; {self.sentence(3, 15)}", f"<p>&copy; {self.sentence(3, 15)}</p>",
                               self.listing(int(r.integers(3, 8))) + f"<p>{self.sentence(3, 12)}</p>", self.sentence(3, 40)])
        else:
            inner = self.listing(int(r.integers(2, 6)))
        return start + re.sub(r"<p>([^<]+)", lambda m: "<p>" + self.marked(m[1], 0.3), inner) + end

    def article(self) -> str:
        r, out = self.rng, []
        kinds = int(r.integers(1, 14))
        if r.random() < 0.85:
            out.append(f"<h1>{_SIGN}{self.some(1, 12)}</h1>")
        for _ in range(kinds):
            p = r.random()
            if p < 0.72:
                close = "" if r.random() < 0.1 else "</p>"
                out.append(f"<p>{_SIGN}{self.prose(1, 120)}{close}")
            elif p < 0.79:
                out.append(f"<{self.pick(['h2', 'h3', 'h4'])}>{_SIGN}{self.some(1, 8)}</h2>")
            elif p < 0.84:
                out.append("<ul>" + "".join(f"<li>{_SIGN}{self.sentence(2, 25)}</li>" for _ in range(int(r.integers(2, 7)))) + "</ul>")
            elif p < 0.87:
                out.append(f"<blockquote>{_SIGN}{self.sentence(5, 50)}</blockquote>")
            elif p < 0.89:
                out.append("<table>" + "".join(
                    f"<tr><td>{_SIGN}{self.some(1, 3)}</td><td>{_SIGN}{self.some(1, 6)}</td></tr>"
                    for _ in range(int(r.integers(2, 5)))) + "</table>")
            elif p < 0.92:
                out.append(f"<div>{_SIGN}{self.prose(3, 100)}</div>")
            elif p < 0.95:
                out.append(f"<pre>{_SIGN}{self.some(2, 30)}</pre>")
            else:
                out.append(self.noise(self.pick(["advert", "share", "sidebar", "notice", "form"])))
        if r.random() < 0.1:
            out = ["".join(out[:1]), f"{_SIGN}{self.prose(5, 80)}<br><br>{self.prose(5, 80)}", *out[1:]]
        return "".join(out)

    def page(self) -> str:
        r, parts = self.rng, []
        have = lambda p: r.random() < p
        top = [k for k, p in (("header", 0.5), ("menu", 0.85), ("notice", 0.25), ("advert", 0.5), ("form", 0.15),
                              ("sidebar", 0.2)) if have(p)]
        r.shuffle(top)
        parts += [self.noise(k) for k in top]
        inside, after = self.article(), []
        if have(0.2):
            inside += self.noise(self.pick(["share", "comments", "comments", "sidebar"]))
        start, end = self.pick([("<article>", "</article>"), ("<article>", "</article>"), ("<main>", "</main>"),
                                self.named(ARTICLE), self.named(ARTICLE), ("<main><article>", "</article></main>"),
                                (f'<div class="{self.pick(["wrapper", "container", "page", "row"])}">{self.named(ARTICLE)[0]}', "</div></div>")])
        parts.append(start + inside + end)
        after = [k for k, p in (("share", 0.2), ("comments", 0.35), ("sidebar", 0.4), ("form", 0.2), ("advert", 0.3),
                                ("menu", 0.1), ("notice", 0.15)) if have(p)]
        r.shuffle(after)
        parts += [self.noise(k) for k in after]
        if have(0.85):
            parts.append(self.noise("footer"))
        if have(0.15):  # everything in one more wrapper
            parts = ['<div id="page">', *parts, "</div>"]
        close = "</body></html>" if have(0.85) else ""
        return (f"<!DOCTYPE html><html lang=x><head><meta charset=utf-8><title>{self.some(2, 9)}</title></head><body>"
                + "".join(parts) + close)


@dataclass
class Model:
    tags: dict[str, float]
    tokens: dict[str, float]
    trees: trees.Boosted

    def extract(self, pages: list[str | None]) -> list[str]:
        nodes = dom.read_pages(pages)
        x = dom.features(nodes, self.tags, self.tokens)
        return dom.texts(nodes, dom.decode(nodes, self.trees.margin(x)))


def _odds(good: int, bad: int) -> float:
    return float(np.log((good + 0.5) / (bad + 0.5)))


def train(words: list[str], pages: int = TRAIN_PAGES, seed: int = 17) -> Model:
    """Lay out pages with these words and learn which blocks hold article text."""
    rng = np.random.default_rng(seed)
    words = words or ["text"]
    nodes = dom.read_pages([_Layout(rng, words).page() for _ in range(pages)])
    n = len(nodes.tag)
    wanted = np.zeros(n, dtype=bool)
    own = np.zeros(n, dtype=np.int64)
    for at, text in nodes.runs:
        own[at] |= text.startswith(_SIGN)
    total = np.concatenate([[0], np.cumsum(own)])
    wanted = (total[np.array(nodes.end)] - total[np.arange(n)]) > 0
    tags, tokens = {}, {}
    count: dict[tuple[str, str], list[int]] = {}
    for k in range(n):
        for key in (("tag", nodes.tag[k]), *(("token", t) for t in nodes.tokens[k])):
            count.setdefault(key, [0, 0])[int(wanted[k])] += 1
    for (kind, name), (bad, good) in count.items():
        (tags if kind == "tag" else tokens)[name] = _odds(good, bad)
    x = dom.features(nodes, tags, tokens)
    # a run weighs with its text: a long one lost costs more than a short one
    weight = np.where(np.array(nodes.chars) > 0, 1 + np.log1p(np.array(nodes.chars)) / 4, 1.0)
    return Model(tags, tokens, trees.fit(x, wanted.astype(float), rounds=40, depth=4, rate=0.25, weight=weight))


def learn(pages: DataFrame, sample_rows: int = SAMPLE_ROWS, sample_words: int = SAMPLE_WORDS) -> Model:
    """A model with about `sample_words` words of about `sample_rows` whole pages; without any it uses a placeholder."""
    some = spread_sample(pages.filter(F.col("html").isNotNull()).select("page_id", "html"), F.col("page_id"), sample_rows, 31)
    found = F.regexp_extract_all(F.regexp_replace("html", "<[^>]*>", " "), F.lit(r"\p{L}{1,20}"), F.lit(0))
    words = some.select(F.explode(F.array_distinct(found)).alias("word")).distinct()
    return train(sorted(r.word for r in spread_sample(words, F.col("word"), sample_words, 33).collect()))


def main_text(pages: DataFrame, model: Model) -> DataFrame:
    """`(page_id, url, text, n_chars)`: the article's text of each page, empty where there is none."""
    def work(batches):
        for batch in row_batches(batches, "html"):
            got = model.extract(batch.column("html").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(got, pa.string()),
                 pa.array([len(t) for t in got], pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return rows.mapInArrow(work, "page_id long, url string, text string, n_chars long")
