"""Main text of web pages: boosted trees over the features of DOM blocks, decoded along the tree.

The trees learn from pages made here from a grammar of page parts (menus, mastheads, notices, adverts, articles,
sidebars, forms, comments, footers) in many spellings, in which the parts of the article are known.
"""

from __future__ import annotations

import functools
import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from regolith.llm import boosting
from regolith.llm.common import table
from regolith.llm.dom import Page, decode

#: Pages to learn from, and the seed of their making.
PAGES, SEED = 900, 11
#: Stands before the text of the article in made pages, and is taken out before they are read.
MARK = "\ue000"
#: Pages whose blocks are judged at a time.
STEP = 64


class Maker:
    """Makes a page from a seed."""

    def __init__(self, seed: int) -> None:
        self.r = random.Random(seed)
        pieces = self.r.choice(["the er on an re he in ed nd ha at en es of or nt ti to it st", "ou le en de re é ai que è ment ion aux eau la oi an", "sch er ung ich ein ge ver be st en te der heit ü zu", "os ar ción que la en el ado ez ie mente ñ do as"]).split()
        self.vocabulary = ["".join(self.r.choice(pieces) for _ in range(self.r.randint(1, 4))) for _ in range(150)]

    def words(self, low: int, high: int) -> str:
        return " ".join(self.r.choice(self.vocabulary) for _ in range(self.r.randint(low, high)))

    def sentences(self, low: int, high: int) -> str:
        out = []
        for _ in range(self.r.randint(low, high)):
            s = self.words(4, 16).capitalize()
            out.append(s.replace(" ", ", ", 1) if self.r.random() < 0.4 else s)
        return self.r.choice([". ", ".\n"]).join(out) + "."

    def maybe(self, chance: float, *parts: str) -> str:
        return "".join(parts) if self.r.random() < chance else ""

    def pick(self, words: str) -> str:
        return self.r.choice(words.split())

    def named(self, words: str, tags: str = "div") -> tuple[str, str]:
        """An opening and a closing tag with a class or id of one of the words."""
        tag, word = self.pick(tags), self.pick(words)
        if self.r.random() < 0.3:
            word += self.pick("-wrap -box -inner -1 -container")
        if self.r.random() < 0.2:
            word = self.pick("l- c- site- page-") + word
        return f'<{tag} {self.pick("class class id")}="{word}">', f"</{tag}>"

    def inside(self, words: str, tags: str, *body: str) -> str:
        start, end = self.named(words, tags)
        return start + "".join(body) + end

    def menu(self, many: int = 9) -> str:
        links = [f'<a href="/{self.words(1, 1)}">{self.words(1, 3)}</a>' for _ in range(self.r.randint(3, many))]
        kind = self.r.random()
        if kind < 0.6:
            return "<ul>" + "".join(f"<li>{x}</li>" if self.r.random() < 0.97 else f"<li>{x}" for x in links) + "</ul>"
        return self.r.choice([" ", " | ", " &middot; "]).join(links) if kind < 0.85 else "".join(f"<div>{x}</div>" for x in links)

    def nav(self) -> str:
        kind = self.r.random()
        body = self.menu()
        if kind < 0.5:
            return f"<nav>{body}</nav>"
        return self.inside("menu nav navbar navigation main-menu breadcrumb topnav", "div nav div ul section", body)

    def masthead(self) -> str:
        body = self.maybe(0.6, f"<h1>{self.words(1, 4)}</h1>") + self.maybe(0.5, f"<p>{self.words(3, 9)}</p>") + self.maybe(0.5, self.nav()) + self.maybe(0.3, f'<a href="/">{self.words(1, 3)}</a>')
        return f"<header>{body}</header>" if self.r.random() < 0.6 else self.inside("header masthead top logo branding", "div header", body)

    def notice(self) -> str:
        body = self.r.choice([f"<p>{self.sentences(1, 3)}</p>", self.sentences(1, 3), f"<p>{self.sentences(1, 2)}<button>{self.words(1, 2)}</button></p>"]) + self.maybe(0.3, f'<a href="#">{self.words(1, 2)}</a>')
        return self.inside("cookie-notice cookie consent gdpr-banner notice banner alert popup privacy-notice newsletter-popup", "div div section aside p", body)

    def advert(self) -> str:
        body = self.r.choice([self.sentences(1, 4), f"<p>{self.sentences(1, 3)}</p>", f'<a href="#">{self.words(2, 8)}</a>', f"<h4>{self.words(1, 4)}</h4><p>{self.sentences(1, 2)}</p>"])
        return "<!-- ad -->" + self.inside("ad ads advert advertisement sponsored promo banner-ad ad-slot", "div div div aside section", body)

    def aside(self) -> str:
        item = lambda: self.r.choice([f"<h3>{self.words(1, 4)}</h3>{self.menu(6)}", f"<p>{self.sentences(1, 3)}</p>", f"<h4>{self.words(2, 5)}</h4><p>{self.sentences(1, 2)}</p>", self.menu(6)])
        body = "".join(item() for _ in range(self.r.randint(1, 4)))
        return f"<aside>{body}</aside>" if self.r.random() < 0.5 else self.inside("sidebar side widget related popular recommended more-stories trending", "div div aside section", body)

    def form(self) -> str:
        body = self.maybe(0.5, f"<p>{self.sentences(1, 2)}</p>") + f"<label>{self.words(1, 3)}</label><input name=q>" + self.maybe(0.4, f"<label>{self.words(1, 2)} <input></label>") + self.maybe(0.7, f"<button>{self.words(1, 2)}</button>")
        out = f'<form action="/{self.words(1, 1)}">{body}</form>'
        return self.inside("newsletter subscribe search contact-form signup", "div section", self.maybe(0.4, f"<h3>{self.words(2, 5)}</h3>"), out) if self.r.random() < 0.5 else out

    def comments(self) -> str:
        one = lambda: self.r.choice([
            f'<div class="{self.pick("comment comment-body reply")}"><b>{self.words(1, 2)}</b><p>{self.sentences(1, 4)}</p></div>',
            f'<li class="{self.pick("comment reply depth-1")}"><p>{self.sentences(1, 4)}</p></li>',
            f'<article class="{self.pick("comment comment-item")}"><p>{self.sentences(1, 3)}</p></article>',
            f"<p>{self.sentences(1, 3)}</p>",
        ])
        body = self.maybe(0.7, f"<h3>{self.words(1, 3)}</h3>") + "".join(one() for _ in range(self.r.randint(1, 6))) + self.maybe(0.3, self.form())
        return self.inside("comments comment-list discussion disqus responses reader-comments", "div section section ol ul", body)

    def footer(self) -> str:
        body = self.r.choice(["&copy; ", "", "&copy; 2020 "]) + self.r.choice([self.words(2, 8), self.sentences(1, 3), f"<p>{self.sentences(1, 3)}</p>", self.menu(7), f"<p>{self.words(2, 6)}</p>{self.menu(6)}"])
        return f"<footer>{body}</footer>" if self.r.random() < 0.7 else self.inside("footer foot site-footer copyright colophon bottom", "div footer section", body)

    def paragraph(self) -> str:
        text = self.sentences(1, 6)
        if self.r.random() < 0.3:
            text += f' <a href="#">{self.words(1, 5)}</a> {self.sentences(1, 2)}'
        if self.r.random() < 0.2:
            text = f"<b>{self.words(1, 4)}<br>{text}" if self.r.random() < 0.5 else f"<em>{self.words(1, 4)}</em> {text}"
        return f"<p>{MARK}{text}" + self.maybe(0.85, "</p>")

    def article(self) -> str:
        p = self.paragraph
        extra = lambda: self.r.choice([
            f"<h2>{MARK}{self.words(1, 6)}</h2>",
            f"<h3>{MARK}{self.words(1, 6)}</h3>",
            "<ul>" + "".join(f"<li>{MARK}{self.r.choice([self.words(1, 8), self.sentences(1, 2)])}</li>" for _ in range(self.r.randint(2, 6))) + "</ul>",
            f"<blockquote>{p()}</blockquote>",
            f"<blockquote>{MARK}{self.sentences(1, 3)}</blockquote>",
            "<table>" + "".join(f"<tr><td>{MARK}{self.words(1, 4)}</td><td>{MARK}{self.words(1, 4)}</td></tr>" for _ in range(self.r.randint(2, 5))) + "</table>",
            f"<pre>{MARK}{self.words(3, 20)}</pre>",
            f"<div>{MARK}{self.sentences(1, 4)}</div>",
            f"<section><h2>{MARK}{self.words(1, 5)}</h2>{p()}{p()}</section>",
        ])
        inner = lambda: self.r.choice([self.advert, self.aside, self.notice, self.form, self.nav])()
        length = 0 if self.r.random() < 0.04 else self.r.choice([1, 2, 3, 4, 6, 9, 14])
        title = self.maybe(0.85, f"<{(h := self.pick('h1 h1 h1 h2'))}>{MARK}{self.words(2, 10)}</{h}>")
        if self.r.random() < 0.15:
            title = f"<header>{title}</header>"
        body = "".join(p() if self.r.random() < 0.8 else extra() for _ in range(length)) or f"<p>{MARK}<b>{self.words(2, 9)}<br>"
        if self.r.random() < 0.15:
            body = body.replace("<p>", f"<p class={self.pick('text lead para intro')}>")
        if self.r.random() < 0.35:
            cut = body.find("<p", len(body) // 2)
            body = body[:cut] + inner() + body[cut:] if cut > 0 else body + inner()
        body = title + (self.inside("entry-content post-body article-body text story", "div", body) if self.r.random() < 0.2 else body)
        body += self.maybe(0.12, self.inside("share social tags", "div ul", self.menu(5))) + self.maybe(0.12, self.comments())
        kind = self.r.random()
        if kind < 0.55:
            return f"<article>{body}</article>"
        if kind < 0.7:
            return f"<main>{body}</main>" if kind < 0.62 else f"<main><article>{body}</article></main>"
        if kind < 0.9:
            return self.inside("content main article post entry story post-content", "div div section", body)
        return f"<div>{body}</div>" if kind < 0.95 else body

    def page(self) -> str:
        few = lambda f, *chances: "".join(self.maybe(c, f()) for c in chances)
        top = few(self.masthead, 0.5) + few(self.nav, 0.6, 0.1) + few(self.notice, 0.25) + few(self.advert, 0.4) + few(self.form, 0.1)
        middle = few(self.aside, 0.1) + self.article() + few(self.comments, 0.25) + few(self.aside, 0.35, 0.1) + few(self.advert, 0.15)
        if self.r.random() < 0.3:
            middle = self.inside("wrapper container page layout row", "div", middle)
        bottom = few(self.form, 0.15) + few(self.nav, 0.1) + few(self.footer, 0.85) + few(self.notice, 0.15)
        body = top + middle + bottom
        if self.r.random() < 0.15:
            body = self.inside("wrapper container site page", "div", body)
        return f"<!DOCTYPE html><html><head><title>{self.words(2, 8)}</title><style>p{{}}</style><script>var a='<p>';</script></head><body>{body}" + self.maybe(0.9, "</body></html>")


def labelled(source: str) -> tuple[np.ndarray, np.ndarray]:
    """The features of a made page's blocks, and which of them hold marked text."""
    page = Page(source)
    y = np.zeros(len(page.tag))
    for b, t in page.parts:
        if MARK in t:
            y[b] = 1
    for i in range(len(y) - 1, 0, -1):
        y[page.parent[i]] = max(y[page.parent[i]], y[i])
    return Page(source.replace(MARK, "")).features(), y


@functools.cache
def model(pages: int = PAGES, seed: int = SEED) -> boosting.Trees:
    """The trees fitted to the made pages, once for each process."""
    parts = [labelled(Maker(seed * 1_000_003 + i).page()) for i in range(pages)]
    return boosting.fit(np.concatenate([x for x, _ in parts]), np.concatenate([y for _, y in parts]))


def main_texts(sources: list[str | None], trees: boosting.Trees) -> list[str]:
    """The main text of each page; a null or empty page has none."""
    out = []
    for at in range(0, len(sources), STEP):
        pages = [Page(s or "") for s in sources[at : at + STEP]]
        rows = [p.features() for p in pages]
        odds = np.split(boosting.logits(trees, np.concatenate(rows)), np.cumsum([len(r) for r in rows])[:-1])
        out += [p.text_of(decode(p, o)) for p, o in zip(pages, odds)]
    return out


def extract(df: DataFrame, keep: list[str], source: str, trees: boosting.Trees | None = None) -> DataFrame:
    """The columns `keep` and text, the main text of the whole page in `source`. No shuffle; the trees (some tens of
    kilobytes, whatever the input) go along with the tasks. Repeated rows are extracted each; nulls give "" ."""
    trees = trees or model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, STEP):
                part = b.slice(at, STEP)
                texts = main_texts(part.column(part.num_columns - 1).to_pylist(), trees)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(texts, pa.string())], [f"c{i}" for i in range(len(keep))] + ["text"])

    rows = df.select(*(F.col(c).alias(f"c{i}") for i, c in enumerate(keep)), F.col(source).cast("string").alias("text"))
    return rows.mapInArrow(run, rows.schema).toDF(*keep, "text")


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of all pages."""
    done = extract(table(spark, sf_dir, "pages"), ["page_id", "url"], "html")
    return done.withColumn("n_chars", F.length("text").cast("long"))
