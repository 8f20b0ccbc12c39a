"""HTML extraction: the parser on odd markup, the labeller on pages it was not trained on, the query on the article."""

import html as entities
import re
import time

import numpy as np
import pytest

pytest.importorskip("tallgrass.llm")

from tallgrass.llm import html  # noqa: E402


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("", []),
        ("plain  text", ["plain text"]),
        ("<p>a<b>b</b>c<p>d &amp; &lt;e&gt; &am &copy", ["abc", "d & <e> &am ©"]),
        ('<p>x<script>if (a<b) "</p>"</script>y<style>p{}</style><!-- <p>no --> z', ["xy z"]),
        ("<p>a<br>b\n\t c&nbsp;d", ["a b c d"]),
        ("<ul><li>1<li>2<ul><li>3</ul><li>4</ul>5 < 6", ["1", "2", "3", "4", "5 < 6"]),
        ('<a title="x>y">t</a><a href=\'">\'>u</a>', ["tu"]),
        ("<!-- open <p>x", []),
        ("<p>one</p><!--><p>two</p><!---><p>three</p>", ["one", "two", "three"]),
        ("<p>one</p><!-- a --!><p>two</p><!-- b --x> --><p>three</p>", ["one", "two", "three"]),
        ("<p>one</p><script>var x = 1;<p>two</p>", ["one"]),
        ("<p>one</p><style>p{}<p>two</p>", ["one"]),
        ('<p>a<svg width="1"/>b<svg><text>no</text></svg>c<math>x</math>', ["abcx"]),
        ("<p>a<svg>b<p>c<iframe>d", ["ab", "cd"]),
        ("<p>a<noscript>b</noscript><object><p>c</object>", ["ab", "c"]),
        ("<p>a<b '>c</b>d <i title='x>y'>e</i><i title=\"f>g", ["acd eg"]),
        ("<p>x</div></p>y<script>never closed", ["x", "y"]),
        ("<table><tr><td>a<td>b<tr><td>c</table>", ["a", "b", "c"]),
    ],
)
def test_blocks(page, want):
    assert [b[0] for b in html.blocks(page)[0]] == want


@pytest.mark.parametrize(
    "page",
    ["<a '" * 250_000, '<a =">"' * 150_000, "<div>" * 100_000 + "x", "<a " * 300_000, "<svg>" * 200_000, "<i class=x><div>" + "<b class=x>" * 50_000 + "</i>" * 50_000, "<a ='" * 100_000 + '<a ="' * 100_000, "<!" * 300_000, "<p>x" * 100_000],
    ids=range(9),
)
def test_time_goes_with_length(page):
    model, began = html.trained(), time.process_time()
    own = html.blocks(page)
    model.inputs([own])
    assert time.process_time() - began < 12


def test_labeller_on_new_pages():
    model, wrong, n = html.trained(), 0, 0
    for page, labels in html.training_pages(120, seed=99):
        own = html.blocks(page)
        assert len(own[0]) == len(labels)
        wrong += int((model.labels([own]) != np.array(labels)).sum())
        n += len(labels)
    assert wrong / n < 0.02


def held_out_page(rng, style):
    """A page of a layout that training has none of: other containers, nesting, attributes and order."""
    word = lambda: "".join(rng.choice(list("abcdefghijklmnoprstuvy"), int(rng.integers(2, 9))))
    words = lambda a, b: " ".join(word() for _ in range(int(rng.integers(a, b))))
    main = "".join(f"<p>{words(20, 60)}.</p>" for _ in range(int(rng.integers(3, 8))))
    menu = "".join(f"<li><a href='/{word()}'>{words(1, 3)}</a></li>" for _ in range(5))
    title = words(3, 8)
    if style == 0:
        page = f"<div id=wrap><div><nav class='top bar'><ul>{menu}</ul></nav></div><div><article data-x=1><h1>{title}</h1><div><div>{main}</div></div></article></div><footer><div><p>{words(3, 9)}</p></div></footer></div>"
        return page, [0] * 5 + [1] * (1 + main.count("<p>")) + [0]
    if style == 1:
        page = f"<main><article><h2>{title}</h2>{main}<p>{words(1, 3)}</p></article></main><section id='comments'><h3>{words(1, 3)}</h3>" + f"<div class='comment'><p>{words(5, 20)}</p></div>" * 3 + f"</section><aside><p>{words(4, 9)}</p></aside>"
        return page, [1] * (2 + main.count("<p>")) + [0] * 5
    deep = "<div class='x y'>" * 30
    return f"<nav><ul>{menu}</ul></nav>{deep}<article><h1>{title}</h1>{main}</article>{'</div>' * 30}<footer>{words(3, 9)}</footer>", [0] * 5 + [1] * (1 + main.count("<p>")) + [0]


def test_labeller_on_held_out_layouts():
    rng, model, wrong, n = np.random.default_rng(8), html.trained(), 0, 0
    for i in range(90):
        page, labels = held_out_page(rng, i % 3)
        own = html.blocks(page)
        assert len(own[0]) == len(labels)
        wrong += int((model.labels([own]) != np.array(labels)).sum())
        n += len(labels)
    print(wrong, n)
    assert wrong / n < 0.05


def test_gradients():
    model = html.Labeller()
    pages = [html.blocks(p) for p, _ in html.training_pages(3, seed=4)]
    x, reads = model.inputs(pages)
    sizes = np.array([len(own) for own, _ in pages])
    labels = np.arange(len(x)) % 2
    given = model.gradients(x, sizes, labels, pages, reads)

    def loss():
        x, _ = model.inputs(pages)
        z = model.forward(x, sizes)[0].astype(float)
        return float((np.logaddexp(0, z) - labels * z).sum() / len(sizes))

    for name in ("Wf", "Wb", "O", "P", "L", "V", "Bf"):
        at = np.unravel_index(np.argmax(np.abs(given[name])), given[name].shape)
        old, step = model.w[name][at], 1e-2
        model.w[name][at] = old + step
        up = loss()
        model.w[name][at] = old - step
        down = loss()
        model.w[name][at] = old
        assert abs((up - down) / (2 * step) - given[name][at]) < 0.05 * abs(given[name][at]) + 1e-4


def test_query(spark, small):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{small}/pages.parquet").collect()}
    rows = html.op2_html_extraction(spark, small).collect()
    assert len(rows) == len(pages)
    for r in rows:
        article = re.search("<article>(.*?)</article>", pages[r.page_id], re.DOTALL)[1].replace("<br>", " ")
        parts = (" ".join(entities.unescape(re.sub("<[^>]*>", "", b)).split()) for b in re.split("</?(?:p|h1|li|ul)>", article))
        assert r.text == "\n".join(p for p in parts if p) and r.n_chars == len(r.text)


def test_odd_rows(spark):
    rows = [(1, None, "t"), (2, "", "t"), (2, "", "t"), (None, "<article><p>" + "long text here. " * 20000 + "</p></article>", None)]
    given = spark.createDataFrame(rows, "page_id long, html string, text string")
    got = html.extract_text(given).collect()
    assert sorted(len(r.text) for r in got) == [0, 0, 0, 16 * 20000 - 1]
    assert html.extract_text(given.limit(0)).count() == 0
