import html as references
import re
import time

import numpy as np
import pytest

from lapsewise.llm import html

FOLDER = "/root/testdata/sf0.01"
PAGES = "page_id bigint, url string, html string, text string, n_chars string"


@pytest.fixture(scope="module")
def model(spark):
    return html.train(spark.read.parquet(f"{FOLDER}/pages.parquet"))


def article(page):
    inside = re.search(r"<article>(.*)</article>", page, re.S)
    parts = (" ".join(references.unescape(re.sub(r"<[^>]*>", " ", p)).split()) for p in re.split(r"</?(?:p|h1)>", inside[1])) if inside else ()
    return "\n".join(p for p in parts if p)


def test_articles_of_the_given_pages(spark, model):
    pages = spark.read.parquet(f"{FOLDER}/pages.parquet")
    truth = {r.page_id: article(r.html) for r in pages.collect()}
    found = html.extract(pages, model).collect()
    assert len(found) == len(truth)
    assert sum(r.text == truth[r.page_id] for r in found) >= 0.98 * len(truth)
    assert all(r.n_chars == len(r.text) for r in found)


def test_other_template(model):
    page = (
        '<html><head><title>t</title></head><body><header><p>Site name</p></header><div class="menu"><ul><li>Home</li><li>About</li></ul></div>'
        '<div class="content"><h1>Title</h1><p>First text here, with words. And more of it.</p><div class="ad">Buy now</div><p>Second text, longer than that.</p></div>'
        '<section id="comments"><div class="comment"><p>Nice post!</p></div></section><footer>&copy; me</footer></body></html>'
    )
    blocks = html.blocks_of(page)
    kept = [t for (_, t, _), k in zip(blocks, html.label([blocks], model)[0]) if k]
    assert kept == ["Title", "First text here, with words. And more of it.", "Second text, longer than that."]


@pytest.mark.parametrize("page, texts", [
    (None, []), ("", []), ("plain &amp; text", ["plain & text"]), ("<p>a<p>b\n c<br>d", ["a", "b c d"]), ("<!-- open <p>x", []), ("<p>1 < 2 <b>x</p>", ["1 < 2 x"]),
    ("<script>var a='<p>';</script>y<style>p{}</style>", ["y"]), ("<script>never closed <p>x", []), ("<ul><li>a<ul><li>b</ul><li>c</ul>", ["a", "b", "c"]),
    ("<p title=\"a>b\">x</p></div></p>z", ["x", "z"]), ("<table><tr><td>a<td>b</table>", ["a", "b"]), ("&lt;p&gt; &#65;&nbsp;&#x42;", ["<p> A B"]),
])
def test_blocks(page, texts):
    assert [t for _, t, _ in html.blocks_of(page)] == texts


def test_gradients_are_those_of_the_loss():
    random = np.random.default_rng(0)
    model = html.Labeller.fresh(random)
    model.weights = {k: v.astype(np.float64) for k, v in model.weights.items()}
    pages = [html.blocks_of("<nav><li>a<li>b c</nav><article><p>some words. here<p>and more</article>"), html.blocks_of("<p>one</p><div class=ad>two, three</div>")]
    batch = html.Batch.of([html.vectors(p) for p in pages])
    labels = (random.random(batch.mask.shape) < 0.5) * batch.mask
    _, grads = model.gradients(batch, labels)
    for name, grad in grads.items():
        at = np.unravel_index(np.argmax(np.abs(grad)), grad.shape)
        losses = []
        for step in (1e-4, -2e-4):
            model.weights[name][at] += step
            losses.append(model.gradients(batch, labels)[0])
        model.weights[name][at] += 1e-4
        assert abs((losses[0] - losses[1]) / 2e-4 - grad[at]) < 1e-2 * abs(grad[at]) + 1e-5


def test_padding_changes_nothing(model):
    pages = [html.blocks_of("<article>" + "<p>words and words.</p>" * n + "</article><footer>x</footer>") for n in (1, 7, 40)]
    alone = [model.chances(html.Batch.of([html.vectors(p)]))[0] for p in pages]
    together = model.chances(html.Batch.of([html.vectors(p) for p in pages]))
    for p, a, t in zip(pages, alone, together):
        assert np.allclose(a, t[: len(p)], atol=1e-5)


def test_odd_rows(spark, model):
    long = "<article>" + "<p>many words in it.</p>" * 20_000 + "</article>"
    rows = [(1, None, None, "own", "own"), (2, "u", "", "own", "own"), (None, "u", "<p>x", "own", "own"), (3, "u", long, "own", "own"), (3, "u", long, "own", "own"), (4, "u", "<div>" * 5000 + "deep", "own", "own")]
    found = html.extract(spark.createDataFrame(rows, PAGES), model).collect()
    assert sorted(str(r.page_id) for r in found) == ["1", "2", "3", "3", "4", "None"]
    assert all((r.text, r.n_chars) == ("", 0) for r in found if r.page_id in (1, 2))
    assert html.main_text(spark.createDataFrame([], PAGES)).count() == 0
    assert html.main_text(spark.createDataFrame(rows[:3], PAGES)).filter("page_id IS NULL").first().text == "x"


def test_sample_of_tables_of_any_size(spark, monkeypatch):
    """The share of a sample is not rounded to nothing, and long pages, or few that name an article, are found."""
    page = "<nav><p>menu</p></nav><article><p>Words here.</p></article>"
    pages = spark.range(3000).selectExpr("id AS page_id", f"'{page}' AS html")
    monkeypatch.setattr(type(pages), "count", lambda self: 400_000_000)
    assert html.sample(pages, 16)
    monkeypatch.undo()
    rare = pages.selectExpr("page_id", "if(page_id = 7, html, '<p>plain') AS html")
    long = pages.limit(3).selectExpr("page_id", "concat(html, repeat('<p>more words</p>', 20000)) AS html")
    assert len(html.sample(rare, 16)) == 1 and len(html.sample(long, 16)) == 3
    same = pages.selectExpr("0L AS page_id", "concat(html, page_id) AS html")
    assert len(html.sample(same, 16)) == 16


@pytest.mark.parametrize("page, texts", [
    ('<svg class="icon"/><p>a</p><svg><title>x</title></svg><p>b', ["a", "b"]), ("<svg><path d=1><p>a<p>b", ["a", "b"]), ("<svg><svg></svg>x</svg>a", ["a"]),
    ("<noscript><p>a</p><noscript>x</noscript><p>b", ["a", "b"]), ("<p>a</p><iframe src=x><p>b", ["a", "b"]), ("<template><p>a<p>b", ["a", "b"]),
    ("<textarea>typed<p>a", ["a"]), ("<title>t<p>a", ["a"]), ("<style>p{}<p>a", ["a"]), ("<svg><!-- <svg> --><text>x</text></svg>a", ["a"]),
    ("<head><title>t</title><p>Article", ["Article"]), ("<head><meta charset=x><link rel=y><script>1</script><div>a</div>", ["a"]),
    ("<head><title>t</title>Article<p>b", ["Article", "b"]), ("<html><head>\n<title>t</title>\n</head><body><p>a", ["a"]), ("<head><noscript><p>x</p></noscript><img src=i>a", ["a"]),
])
def test_blocks_of_ordinary_html(page, texts):
    assert [t for _, t, _ in html.blocks_of(page)] == texts


def test_many_unclosed_raw_tags_take_linear_time():
    blocks = html.blocks_of("<svg><noscript>" * 50_000 + "<p>a")
    assert [t for _, t, _ in blocks] == ["a"]


@pytest.mark.parametrize("page, many", [
    ("<a '" * 20_000, 1), ("<div>x" * 8000, 8000), ("(<a '>')" * 16_000 + '"', 1), ("<a" * 50_000, 1), ("<svg>" + "<svg " * 20_000, 1), ("<div>" * 30_000 + "</b>" * 30_000, 0),
])
def test_adverse_pages_take_linear_time(page, many):
    begun = time.time()
    assert len(html.blocks_of(page)) == many
    assert time.time() - begun < 2


def test_deep_paths_keep_what_names_them():
    deep = "<div class=a>" * 40 + "{}" + "<div class=b>" * 40 + "<p>x"
    for inside, label in (("<article>", [1]), ("<article><header>", [1]), ("<header><article>", [0]), ("<article><nav>", [0]), ("<nav>", None)):
        blocks = html.blocks_of(deep.format(inside))
        assert len(blocks[0][0]) <= 2 * html.ENDS + 2 and html.marked(blocks) == label


def test_pages_that_name_no_article(spark):
    """Menus, notices, forms and footers stay out although there is nothing in the table to learn from."""
    body = "<h1>Water in the town</h1><p>The report says that light can change a city, and more.</p><p>It was known for years.</p>"
    page = "<nav><ul><li><a href=x>Home</a></li><li><a href=y>Contact</a></li></ul></nav>{}<form><label>Your name</label></form><footer>All rights reserved</footer>"
    rows = [(i, "u", page.format(body if i % 2 else f"<div>{body}</div>"), None, None) for i in range(4)]
    with pytest.warns(UserWarning, match="made pages"):
        found = html.main_text(spark.createDataFrame(rows, PAGES)).collect()
    for r in found:
        assert "light can change" in r.text and "known for years" in r.text
        assert not any(t in r.text for t in ("Home", "Contact", "Your name", "rights"))
