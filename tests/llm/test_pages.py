import html as entities
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from regolith.llm import boosting, dom
from regolith.llm import html as H
from regolith.llm.common import table


def article(source):
    found = re.search(r"<article>(.*?)</article>", source or "", re.S)
    body = re.sub(r"<[^>]*>", "", re.sub(r"</?(p|h1|br)>", " ", found[1] if found else ""))
    return " ".join(entities.unescape(body).split())


def test_op6(spark, sf):
    got = {r.page_id: r for r in H.op6_html_text(spark, sf).collect()}
    pages = table(spark, sf, "pages").collect()
    assert len(got) == len(pages)
    for p in pages:
        assert (got[p.page_id].text, got[p.page_id].n_chars, got[p.page_id].url) == (article(p.html), len(article(p.html)), p.url)


def test_made_pages_not_seen_in_training():
    trees, right, chars, wrong = H.model(), 0, 0, 0
    for i in range(150):
        source = H.Maker(777_000_000 + i).page()
        x, y = H.labelled(source)
        page = dom.Page(source.replace(H.MARK, ""))
        want, got = page.text_of(y > 0), page.text_of(dom.decode(page, boosting.logits(trees, x)))
        right += want == got
        chars += len(want)
        wrong += abs(len(want) - len(got))
    assert right >= 0.85 * 150 and wrong < 0.06 * chars


@pytest.mark.parametrize(
    ("source", "text"),
    [
        (None, ""),
        ("", ""),
        ("<article><h1>A &amp; B</h1><p>One\n  two<b>three</b> &lt;x&gt; caf&eacute;.</p><p>Four five, six.</p></article>", "A & B One twothree <x> café. Four five, six."),
        ("<article><p>Unclosed <b>words<p>and, more words.</article><footer>&copy; x</footer>", "Unclosed words and, more words."),
        ("<body><nav><ul><li><a href=/>Home</a></ul></nav><article><p>Some text, here it is.</p><script>var a = '</p>';</script></article></body>", "Some text, here it is."),
        ("<html><head><title>T</title><meta x><body><article><p>No end of the head, so it is.</article>", "No end of the head, so it is."),
        ("<article><p>Before it, all is well.</p><ul><li><button>x<li>An item, still here.</ul><p>After it, all is well.</p></article>", "Before it, all is well. An item, still here. After it, all is well."),
    ],
)
def test_reading(source, text):
    assert H.main_texts([source], H.model()) == [text]


def test_no_block_stays_within_one_that_goes():
    r = np.random.default_rng(1)
    for i in range(40):
        page = dom.Page(H.Maker(i).page())
        kept = dom.decode(page, r.normal(size=len(page.tag)) * 3)
        assert kept[0] and all(kept[page.parent[j]] for j in range(1, len(kept)) if kept[j])


def test_decoding_is_the_likeliest_choice():
    page = dom.Page("<div><p>a</p><p>b</p></div><div><p>c</p></div>")
    r = np.random.default_rng(5)
    for _ in range(50):
        z = r.normal(size=len(page.tag))
        best, most = None, -np.inf
        for mask in range(1 << len(z)):
            k = np.array([mask >> i & 1 for i in range(len(z))], bool)
            if k[0] and all(k[page.parent[j]] or not k[j] for j in range(1, len(k))) and (s := z[1:][k[1:]].sum()) > most:
                best, most = k, s
        assert (dom.decode(page, z) == best).all()


def test_trees_learn_a_rule():
    r = np.random.default_rng(0)
    x = r.normal(size=(2000, 5)).astype(np.float32)
    y = ((x[:, 0] > 0.3) ^ (x[:, 2] > -0.2)).astype(float)
    m = boosting.fit(x, y, trees=30)
    assert ((boosting.logits(m, x) > 0) == y).mean() > 0.97
    assert (boosting.logits(boosting.fit(x[:10], np.ones(10), trees=2), x[:3]) > 0).all()


def test_odd_rows(spark):
    df = spark.createDataFrame([(1, "<p>x", "u", "c"), (1, "<p>x", "u", "c"), (None, None, None, None), (2, "<" * 5000, "u", "c"), (3, "<div>" * 3000 + "deep", "u", "c")], "page_id long, html string, url string, text string")
    rows = H.extract(df, ["page_id", "url"], "html")
    assert rows.count() == 5
    assert H.extract(df.where(F.lit(False)), ["page_id"], "html").count() == 0


@pytest.mark.parametrize("page", ["<a x " * 200_000, "<div>" * 200_000, "<div>" * 100_000 + "</section>" * 100_000, "<div>" * 3000 + "<p>x" * 100_000, "<b><div>" + "<i>" * 100_000 + "</b>" * 100_000, "<a '>\"" * 200_000])
def test_long_pages_take_seconds(page):
    begin = time.process_time()
    dom.Page(page).features()
    assert time.process_time() - begin < 15
