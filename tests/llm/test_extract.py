"""Pages: parsing, decisions over a tree, held-out layouts, and the given pages."""

import itertools

import numpy as np
import pytest

from ringtide.llm import boost, dom, extract


@pytest.fixture(scope="module")
def model():
    return extract.train(["Some longer run of words that can stand for a paragraph of a page, with a full stop at its end."] * 5 + ["Menu", "Two words"], made=300)


def blocks(source):
    return [run for _, run in dom.parse(source).runs]


def test_parse():
    assert blocks(None) == [] and blocks("") == []
    assert blocks("<p>a<p>b &amp; c&nbsp;d<br>e</p>f") == ["a", "b & c d e", "f"]
    assert blocks("<ul><li>one<li>two <b>bold</ul>x < y") == ["one", "two bold", "x < y"]
    assert blocks("<script>if (a<b) '<p>'</script><style>p{}</style><!-- <p>no</p> --><p title='a>b'>yes") == ["yes"]
    assert blocks("<script>never ends <p>x") == [] and blocks("<p>a</div>b</p>") == ["ab"] 
    assert blocks("<p class='x>open") == ["open"]
    assert blocks("<h2>a</h3>b<h1>c<h2>d</h1>e") == ["a", "b", "c", "d", "e"]
    assert blocks("<table><tr><td>1<td>2<tr><td>3</table>") == ["1", "2", "3"]
    assert blocks("<div>" * 3000 + "deep") == ["deep"]


def test_decisions_are_closed_and_best():
    draw = np.random.default_rng(0)
    for _ in range(40):
        n = 8
        page = dom.Page(parent=[-1, *[int(draw.integers(0, i)) for i in range(1, n)]])
        odds = draw.normal(size=n)
        chosen = extract.decided(page, odds)
        assert all(not chosen[i] or chosen[page.parent[i]] for i in range(1, n))
        best = max(sum(odds[i] for i in range(1, n) if s[i - 1]) for s in itertools.product([0, 1], repeat=n - 1)
                   if all(not s[i - 1] or page.parent[i] == 0 or s[page.parent[i] - 1] for i in range(1, n)))
        assert np.isclose(odds[1:][chosen[1:]].sum(), best)


def test_boosting_learns():
    draw = np.random.default_rng(1)
    x = draw.normal(size=(3000, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 2] > 0.5)).astype(float)
    trees = boost.fit(x[:2000], y[:2000], trees=30, share=1.0)
    assert ((trees.predict(x[2000:]) > 0) == y[2000:]).mean() > 0.97


def test_held_out_layouts(model):
    layout = extract.Layout(["Other long words that make up a paragraph for pages which the model has not seen, and end here."] * 3, 4242)
    hit = said = true = 0
    for _ in range(150):
        source = layout.page()
        page = dom.parse(source)
        want = {run.replace(extract.MARK, "") for _, run in page.runs if extract.MARK in run}
        got = set(extract.main_texts([source.replace(extract.MARK, "")], model)[0].split("\n\n")) - {""}
        hit, said, true = hit + len(want & got), said + len(got), true + len(want)
    assert hit / said > 0.9 and hit / true > 0.9


def test_given_pages(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    rows = extract.extract(pages, extract.fit_pages(pages)).collect()
    sources = {r.page_id: r.html for r in pages.collect()}
    for r in rows:
        source = sources[r.page_id]
        inside = source[source.index("<article>"):]
        inside = inside[:inside.index("</article>")] if "</article>" in inside else inside
        assert r.text == "\n\n".join(blocks(inside)) and r.n_chars == len(r.text)


def test_edges(spark, model):
    df = spark.createDataFrame([(1, "u", None, 5), (2, None, "", 5), (2, None, "", 5), (None, "u", "<nav><a href=x>menu</a></nav>", 5)], "page_id long, url string, html string, text int")
    assert [r.text for r in extract.extract(df, model).collect()] == [""] * 4
    assert extract.extract(df.limit(0), model).count() == 0
    assert extract.fit_pages(df).value.shape[0] == 100
