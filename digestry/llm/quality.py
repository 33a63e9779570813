"""Quality rules: base counts and zstandard compression bands.

A text whose compressed size, as a share of its own, lies below its band repeats itself; above it,
it is noise (keys, encoded data).  Bands depend on the length, since short texts compress worse:
``BANDS`` gives for texts from so many bytes on the lowest and highest ratio.  The whole text is
judged, then fixed chunks of ``CHUNK`` bytes: a text also fails if chunks outside their band hold
more than ``MAX_BAD_SHARE`` of its bytes.  The limits lie in the gaps measured between clean prose
in four languages and planted noise and repeats; the README gives the figures.

Defined results: a null or empty text has no words and fails the base rules; texts under the first
band are judged by the base rules alone; every row gets one result row, repeated rows too.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from digestry.llm.common import map_texts, read, registry

QUERIES, ORACLE, register = registry()

LEVEL = 3  # zstandard level
CHUNK = 1024  # bytes
MAX_BAD_SHARE = 0.05
#: (from bytes, lowest ratio, highest ratio)
BANDS = [
    (128, 0.45, 1.00), (181, 0.42, 0.93), (256, 0.40, 0.88), (362, 0.35, 0.82), (512, 0.32, 0.77),
    (1024, 0.29, 0.70), (2048, 0.27, 0.65), (4096, 0.25, 0.62),
]
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
WINDOW = 5  # words

NAMES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "ratio", "bad_chunk_share"]
SCHEMA = "doc_id long, " + ", ".join(
    f"{name} {kind}" for name, kind in zip(NAMES, ["long"] * 5 + ["boolean"] * 2 + ["double"] * 2, strict=True)
)


def band(n_bytes: int) -> tuple[float, float]:
    low, high = 0.0, float("inf")
    for start, lowest, highest in BANDS:
        if n_bytes >= start:
            low, high = lowest, highest
    return low, high


def repeat_words(words: list) -> int:
    """Words inside windows of ``WINDOW`` words that occur twice or more, the first ones included.

    Windows are numbered exactly by pairing numbers of shorter ones (1, 2, 4, 5 words).
    """
    import numpy as np

    n = len(words)
    if n <= WINDOW:
        return 0
    number: dict = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
    v = len(number)
    if v == n:
        return 0
    pairs = np.unique(ids[:-1] * v + ids[1:], return_inverse=True)[1]
    if pairs.max() == len(pairs) - 1:
        return 0
    quads = np.unique(pairs[:-2] * n + pairs[2:], return_inverse=True)[1]
    if quads.max() == len(quads) - 1:
        return 0
    _, which, times = np.unique(quads[:-1] * v + ids[4:], return_inverse=True, return_counts=True)
    again = times[which] > 1
    inside = np.zeros(n, bool)
    for k in range(WINDOW):
        inside[k : k + len(again)] |= again
    return int(inside.sum())


def base_counts(text: str, data: bytes) -> tuple[int, int, int, int, int]:
    words = data.split()  # bytes split at ASCII white space only
    lines = [x for x in data.split(b"\n") if x.strip()]
    return (
        len(words),
        len(text) - sum(map(text.count, " \t\n\v\f\r")),
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeat_words(words),
    )


def compression(data: bytes, compressor) -> tuple[float, float]:
    """(ratio of the whole, share of bytes in chunks outside their band)."""
    if not data:
        return 0.0, 0.0
    bad = 0
    for at in range(0, len(data), CHUNK):
        chunk = data[at : at + CHUNK]
        low, high = band(len(chunk))
        if not low <= len(compressor.compress(chunk)) / len(chunk) <= high:
            bad += len(chunk)
    return len(compressor.compress(data)) / len(data), bad / len(data)


def _judge():
    import zstandard

    compressor = zstandard.ZstdCompressor(level=LEVEL)

    def one(text: str | None) -> tuple:
        text = text or ""
        data = text.encode()
        counts = base_counts(text, data)
        failed = counts[0] < MIN_WORDS or 100 * counts[4] > MAX_REPEAT_PERCENT * counts[0]
        ratio, bad = compression(data, compressor)
        low, high = band(len(data))
        return (*counts, failed, not failed and low <= ratio <= high and bad <= MAX_BAD_SHARE, ratio, bad)

    return one


def judge_quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, the counts, base_failed, kept, ratio, bad_chunk_share."""

    def make():
        one = _judge()

        def work(ids, texts):
            return {"doc_id": ids, **dict(zip(NAMES, map(list, zip(*map(one, texts))), strict=True))}

        return work

    return map_texts(docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")), SCHEMA, make)


def keep_good(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text is kept, all columns as they are: one pass, nothing shuffled."""

    @F.udf("boolean", useArrow=True)
    def kept(text):
        return _shared()(text)[6]

    return docs.filter(kept(F.col(f"`{text_col}`")))


_ONE: list = []


def _shared():
    """One judge per Python worker."""
    if not _ONE:
        _ONE.append(_judge())
    return _ONE[0]


@register("op6_quality_rules")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_quality(read(spark, sf_dir, "documents"))
