"""Main text of HTML pages: a recurrent labeller reads the leaf blocks of the whole page.

A page is cut into leaf blocks, in page order, each with its path of open elements (tags and the words of
class, id and role).  A bidirectional LSTM over the whole sequence labels every block from the vectors of
its path and of its hashed words; the blocks labelled main text are joined by newlines.

The labeller is trained here, on the driver, from ``LAYOUTS`` drawn layouts with exact labels, whose words come from
a bounded sample of the pages, and from those ``SAMPLE_PAGES`` sampled pages themselves wherever the markup says what a block is
(inside article or main, but not in what is named as comments, notices or adverts; inside nav, footer, aside or form).  The sample is the pages with the
smallest hashes of id and html, none over ``SAMPLE_CHARS``.  Seeds are fixed, so the same table gives the same labeller.

Defined results: a null, empty or text-free page has empty text and n_chars 0; nothing of a page is cut or capped,
but what stands inside script, style, textarea, title, iframe, template, svg, object, audio, video and canvas is not text of the page (end tags
left out: see ``page_blocks``); tags cut off at the end of a page are dropped; repeated rows come out each; other columns may have any name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from digestry.llm.block_lstm import Labeller, path_ids, train, word_ids
from digestry.llm.common import map_texts, read, registry
from digestry.llm.page_blocks import Block, blocks
from digestry.llm.page_layouts import Layouts

QUERIES, ORACLE, register = registry()

LAYOUTS = 1200
SAMPLE_PAGES = 150
SAMPLE_CHARS = 100_000
SAMPLE_WORDS = 20_000
SEED = 11
EPOCHS = 7
INSIDE = {"article", "main"}
OUTSIDE = {"nav", "footer", "aside", "form", "button", "select"}
#: Class and id words of what may stand inside an article without being its text.
APART = {f".{w}" for w in ("ad ads advert advertisement alert banner comment commentlist comments consent cookie discussion disqus gdpr modal newsletter notice "
                           "paywall popup promo related replies reply respond responses share sidebar social sponsored subscribe tags widget").split()}

Features = list[tuple[list[int], list[int]]]


def features(page: list[Block]) -> Features:
    return [(path_ids(b.path), word_ids(b.text)) for b in page]


def _drawn(layouts: Layouts) -> tuple[Features, list[int]]:
    page, labels = [], []
    for b in blocks(layouts.page()):
        mark, _, text = b.text.partition(" ")
        label = {"x1q": 1, "x0q": 0}.get(mark, -1)
        page.append(Block(b.path, text.replace("x0q ", "") if label >= 0 else b.text))
        labels.append(label)
    return features(page), labels


def _told_by_markup(page: list[Block]) -> list[int]:
    def label(path: set) -> int:
        if OUTSIDE & path:
            return 0
        return 1 if INSIDE & path and not APART & path else -1

    return [label(set(b.path)) for b in page]


def sample_pages(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> list[str]:
    """The sampled pages; tasks send the driver hashes first, then only the pages chosen by them."""
    rows = pages.select(F.xxhash64(id_col, html_col).alias("order"), F.col(html_col).alias("html")).filter(F.length("html") <= SAMPLE_CHARS)
    chosen = [r["order"] for r in rows.select("order").orderBy("order").limit(SAMPLE_PAGES).collect()]
    if not chosen:
        return []
    found = rows.filter(F.col("order") <= max(chosen)).dropDuplicates(["order"]).collect()
    return [r["html"] for r in sorted(found, key=lambda r: r["order"])]


def train_labeller(htmls: list[str]) -> Labeller:
    real = [blocks(x) for x in htmls]
    words = [w for page in real for b in page for w in b.text.split()]
    layouts = Layouts(words[:: max(1, len(words) // SAMPLE_WORDS)], SEED)
    drawn = [_drawn(layouts) for _ in range(LAYOUTS)] + [(features(p), _told_by_markup(p)) for p in real]
    return train([p for p, _ in drawn], [x for _, x in drawn], SEED, EPOCHS)


def main_texts(model: Labeller, htmls: list[str | None]) -> list[str]:
    pages = [blocks(x) for x in htmls]
    found = model.probabilities([features(p) for p in pages])
    return ["\n".join(b.text for b, p in zip(page, ps, strict=True) if p > 0.5) for page, ps in zip(pages, found, strict=True)]


def extract(pages: DataFrame, model: Labeller, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars per row."""
    shared = pages.sparkSession.sparkContext.broadcast(model)  # a megabyte, whatever the table's size

    def make():
        def work(ids, urls, htmls):
            texts = main_texts(shared.value, htmls)
            return {"page_id": ids, "url": urls, "text": texts, "n_chars": [len(t) for t in texts]}

        return work

    rows = pages.select(F.col(id_col).cast("long"), F.col(url_col).cast("string"), F.col(html_col).cast("string"))
    return map_texts(rows, "page_id long, url string, text string, n_chars long", make, rows=128)


@register("op1_html_extract")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages")
    return extract(pages, train_labeller(sample_pages(pages)))
