import numpy as np
import pytest

from digestry.llm import block_lstm, html_extract, page_blocks
from digestry.llm.page_layouts import Layouts


def texts(page):
    return [b.text for b in page_blocks.blocks(page)]


def test_blocks():
    page = (
        '<!DOCTYPE html><html><head><title>T</title><script>var a="</p>";</script></head><body class="x"><!-- <p>no</p> --><p>one &amp;lt; <b>t'
        "wo</b>\n\t&nbsp;three<br>four<p>five &copy &#233;<ul><li>six<li>seven</ul><table><tr><td>a<td>b</table>tail<style>p{}</style> end"
        '<div title="a>b">q</div></span>x < y<svg><text>no</text></svg></body>z<a hre'
    )
    assert texts(page) == ["one &lt; two three four", "five © é", "six", "seven", "a", "b", "tail end", "q", "x < y", "z"]
    assert texts(None) == texts("") == texts("<script>x") == texts("<p> \n</p>") == []


def test_path_has_words_of_class_and_id_and_link():
    (block,) = page_blocks.blocks('<div id="mainNav" class="side-bar"><a href=x>l</a>')
    assert block.path[0] == "div" and set(block.path[1:-1]) == {".main", ".nav", ".side", ".bar"} and block.path[-1] == "a"


def test_long_and_broken_pages_end():
    assert len(texts("<p>x" * 50_000)) == 50_000
    assert len(texts("<div>" * 3000 + "deep")) == 1
    assert texts('<p>a<b c="' * 2000)[0].startswith("a")


def test_gradients_against_differences():
    layouts = Layouts(["alpha", "beta", "gamma"], 1)
    drawn = [html_extract._drawn(layouts) for _ in range(3)]
    pages, labels = [p for p, _ in drawn], np.concatenate([np.array(x) for _, x in drawn])
    model = block_lstm.Labeller.fresh(1)
    _, grad = model.gradients(pages, labels == 1, labels >= 0)
    for name, g in grad.items():
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        losses = []
        for step in (1e-5, -2e-5):
            model.w[name][at] += step
            losses.append(model.gradients(pages, labels == 1, labels >= 0)[0])
        model.w[name][at] += 1e-5
        assert (losses[0] - losses[1]) / 2e-5 == pytest.approx(g[at], rel=1e-3)


@pytest.fixture(scope="module")
def labeller():
    return html_extract.train_labeller(["<body><nav><a>n</a></nav><article><p>alpha beta gamma delta</p></article></body>"])


def test_batches_do_not_change_labels(labeller):
    layouts = Layouts(["alpha", "beta"], 5)
    pages = [html_extract._drawn(layouts)[0] for _ in range(9)] + [[]]
    together = labeller.probabilities(pages)
    for page, p in zip(pages, together, strict=True):
        assert np.allclose(labeller.probabilities([page])[0], p)


def test_held_out_layouts(labeller):
    layouts = Layouts(["alpha", "beta", "gamma", "delta"], 99)
    wrong = total = 0
    for _ in range(200):
        page, labels = html_extract._drawn(layouts)
        p, labels = labeller.probabilities([page])[0] > 0.5, np.array(labels)
        wrong += (p != (labels == 1))[labels >= 0].sum()
        total += (labels >= 0).sum()
    assert wrong <= 0.01 * total


PAGE = """<html><body><div class="cookie-notice"><p>We use cookies</p></div><header><h1>Site</h1></header><nav><ul><li><a href=/>Home</a></li></ul></nav>
<div class="sidebar"><h3>Most read</h3><ul><li><a href=/a>Other</a></li></ul></div><div class="ad">Buy now cheap</div>
<article><h1>Title here</h1><p>First  paragraph with some &eacute; words in it.<p>Second paragraph, also of some length.</p><ul><li>point one of the list</li></ul></article>
<section class="comments"><h2>Comments</h2><div class="comment"><p>Nice article I liked it</p></div><form><label>Name</label><button>Send</button></form></section>
<footer>&copy; 2024 Site</footer></body></html>"""


def test_table(spark, labeller):
    rows = [(1, "u", PAGE, "c"), (1, "u", PAGE, "c"), (2, None, None, "c"), (None, "v", "", "c"), (3, "w", "<script>x</script>", "c")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = html_extract.extract(df, labeller).collect()
    text = "Title here\nFirst paragraph with some é words in it.\nSecond paragraph, also of some length.\npoint one of the list"
    assert [tuple(r) for r in got] == [(1, "u", text, len(text))] * 2 + [(2, None, "", 0), (None, "v", "", 0), (3, "w", "", 0)]
    assert html_extract.extract(df.limit(0), labeller).count() == 0
    assert html_extract.sample_pages(df.limit(0)) == []


def test_left_out_end_tags_lose_no_text():
    assert texts("<!DOCTYPE html><head><title>T</title><h1>A</h1><p>text") == ["A", "text"]
    assert texts("<html><head><meta charset=x><noscript><link href=y></noscript>\n<script>x</script>plain<p>text") == ["plain", "text"]
    assert texts("<head><template><p>no</p><body>yes</body>") == ["yes"]
    for tag in ("video", "audio", "canvas", "object", "svg", "template", "math"):
        assert texts(f"<div><{tag} src=x></div><article><p>kept</p></article>") == ["kept"], tag
        assert texts(f"<p>one <span><{tag}></span> two</p>three") == ["one two", "three"], tag
        assert texts(f"<p>one<{tag}/> two</p>") == ["one two"], tag
    assert texts("<ul><li><video src=x><li>two</ul><p><audio src=y><p>three<table><tr><td><object><td>four") == ["two", "three", "four"]
    assert texts("<div><svg><title>no</title><path d=x><article><p>kept</article>") == ["kept"]


def test_hidden_elements_and_formulas():
    assert texts("<p>a <video><div>no</div><script>'</video>'</script></video> b</p>") == ["a b"]
    assert texts("<p>a <span><object><span>no</span><object>no</object> no</object></span> b") == ["a b"]
    assert texts("<p>a <svg><title>no</title><foreignObject><p>no</p></foreignObject><svg>no</svg>no</svg> b</p>c") == ["a b", "c"]
    assert texts("<p>if <math><mi>x</mi><mo>=</mo><mn>1</mn></math> then</p>") == ["if x=1 then"]
    assert texts("a<script>x") == texts("a<title>x<p>y") == texts("a<iframe><p>x") == ["a"]


SENTENCES = ["The river rose quickly after the storm and several roads were closed.", "Officials said on Monday that repairs would take at least two weeks to finish.",
             "Residents were asked to avoid the bridge until an inspection is complete."]
THREE = "".join(f"<p>{s}</p>" for s in SENTENCES)


@pytest.mark.parametrize(("page", "want"), [
    (f"<body><div>{THREE}</div>", SENTENCES),
    (f"<html><body>{THREE}</body></html>", SENTENCES),
    ("<html><body>" + "<br><br>".join(SENTENCES) + "</body></html>", [" ".join(SENTENCES)]),
    (f"<html><body><table><tr><td><a href=/>Home</a> <a href=/a>About</a></td><td>{THREE}</td></tr></table></body></html>", SENTENCES),
    (f"<html><body><h1>Flood</h1>{THREE}<hr><p>Copyright 2020 Some Paper</p></body></html>", ["Flood", *SENTENCES]),
    ("<body><div>" + "".join(f"<div>{s}</div>" for s in SENTENCES) + "</div></body>", SENTENCES),
    (f"<body><p><a href=a>Home</a> | <a href=b>News</a> | <a href=c>Contact</a></p><hr>{THREE}<hr><address>Contact: web@example.org</address>", SENTENCES),
    (f'<body><header><h1>Site</h1></header><nav><a href=/>Home</a></nav><main><h2>Flood</h2>{THREE}<section class="comments"><h3>Comments</h3>'
     "<p>I agree with all of this</p></section></main><footer>&copy; 2020</footer>", ["Flood", *SENTENCES]),
    (f"<body><h2>Flood</h2><p>{SENTENCES[0]}</p><ul><li>{SENTENCES[1]}</li><li>{SENTENCES[2]}</li></ul></body>", ["Flood", *SENTENCES]),
])
def test_pages_written_by_hand(page, want):
    assert html_extract.main_texts(by_hand(), [page])[0].split("\n") == want


def by_hand():
    """A labeller from the pages of the smallest tables, trained once."""
    if not _TRAINED:
        import pyarrow.parquet as pq

        _TRAINED.append(html_extract.train_labeller(pq.read_table("/root/testdata/sf0.001/pages.parquet")["html"].to_pylist()))
    return _TRAINED[0]


_TRAINED: list = []


def test_comments_inside_an_article_have_no_label_from_the_markup():
    page = page_blocks.blocks('<article><p>a</p><div class="comments"><p>b</p></div><aside>c</aside></article><div id="x"><p>d</p></div><main><div class="ad">e</div></main>')
    assert html_extract._told_by_markup(page) == [1, -1, 0, -1, -1]


@pytest.mark.parametrize("page", ["<div>x" * 200_000, "</p>" * 250_000, "<div class='" + "ab " * 60_000 + "'>" + "<p>x" * 20_000, "<div>" * 100_000 + "</p></li></td>" * 60_000])
def test_deep_pages_take_linear_time(page):
    import time
    import tracemalloc

    start = time.process_time()
    found = page_blocks.blocks(page)
    assert time.process_time() - start < 20
    assert sum(b.text.count("x") for b in found) == page.count("x") and max([len(b.path) for b in found], default=0) <= 32 * 25
    if page.startswith("<div>x"):
        tracemalloc.start()
        page_blocks.blocks(page[: 6 * 20_000])
        assert tracemalloc.get_traced_memory()[1] < 200 << 20
        tracemalloc.stop()
