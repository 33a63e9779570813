"""Language identification by interpolated Kneser-Ney character models.

Texts are lower-cased; every run of characters that aren't letters becomes one space.  The models
count four-character windows of a bounded sample of labelled documents; the lower orders count
distinct continuations.  Their probabilities are worked out in full for every window seen and
stored in sorted hash arrays, one per order, with a column per language; a window seen in no language backs
off to the next shorter one.  The prediction is the language with the lowest cross-entropy per
character.  A part of the labelled documents that no model counts calibrates the score (a
temperature) and the rejection (a highest cross-entropy per language).

The sample: about ``SAMPLE_DOCS`` documents per language, drawn by a hash of their id from those that
are not held out, whole texts, until ``SAMPLE_CHARS`` characters of the language are reached; documents over
``LONG`` characters come last, so they fill up what the others leave.  Every language with a
text gives at least one document, and one with fewer than ``CALIBRATES`` in the calibration fold is learned from that fold
too, and has no highest cross-entropy.  Window counts are added up on the cluster; only they and one row per calibration
document reach the driver.  Predictions cover every row and whole texts.

Defined results: ``und`` with score 0 for a text that is null or has no letter, and for all texts if
nothing was learned; a prediction above its language's highest cross-entropy keeps its language, is
marked ``rejected`` and scores 0; a row without doc_id is not held out and teaches nothing; repeated rows are predicted each.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from digestry import session
from digestry.llm.common import map_texts, read, registry, written

QUERIES, ORACLE, register = registry()

ORDER = 4
SAMPLE_DOCS = 1500  # labelled documents per language, expected
SAMPLE_CHARS = 8_000_000  # characters per language; the document that passes them is the last one drawn
LONG = 200_000  # characters; longer documents are drawn last
CALIBRATES = 20  # documents of a language that calibrate it; if there are fewer, they are counted instead
LANGUAGES = 10_000  # rows of (language, rate) that may be broadcast
FOLDS = 5  # remainder 0 is held out, 1 calibrates, the others are counted
BLOCK = 1 << 16  # characters whose windows are looked up at once
UNKNOWN = "und"
MULTIPLIER = 0x9E3779B97F4A7C15  # odd; windows are hashed as polynomials modulo 2**64


def fold(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % FOLDS


_LETTERS: list = []


def characters(text: str):
    """Code points of the normalized text, a space at both ends; None if it has no letter."""
    import numpy as np

    if not _LETTERS:  # once per Python worker
        _LETTERS.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    codes = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "replace"), "<u4")
    letter = _LETTERS[0][codes]
    if not letter.any():
        return None
    codes = np.where(letter, codes, 32)
    return codes[letter | np.concatenate([[True], letter[:-1]])]


def hashes(codes, order: int):
    """Hash of the window of ``order`` characters that ends at each place from order - 1 on."""
    import numpy as np

    wide = codes.astype(np.uint64)
    out = np.zeros(len(wide) - order + 1, np.uint64)
    for k in range(order):
        out = out * np.uint64(MULTIPLIER) + wide[k : k + len(out)]
    return out


def window_counts(labelled: DataFrame) -> DataFrame:
    """lang, gram (string of ``ORDER`` characters), n: added up per slice, then per language."""

    def make():
        from collections import Counter

        import numpy as np

        def work(langs, texts):
            total: Counter = Counter()
            for lang, text in zip(langs, texts, strict=True):
                codes = characters(text)
                if codes is None or len(codes) < ORDER:
                    continue
                grams, n = np.unique(np.lib.stride_tricks.sliding_window_view(codes, ORDER), axis=0, return_counts=True)
                for gram, times in zip(grams.tolist(), n.tolist(), strict=True):
                    total[lang, "".join(map(chr, gram))] += times
            return {"lang": [k[0] for k in total], "gram": [k[1] for k in total], "n": list(total.values())}

        return work

    counted = map_texts(labelled.select("lang", "text"), "lang string, gram string, n long", make)
    return counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


@dataclass
class Models:
    """Models of all languages: per order a sorted array of hashes and, per language, log2 probabilities and back-off weights."""

    languages: list[str]
    windows: list[Any]  # [order - 1]: sorted hashes of the windows of that order
    logs: list[Any]  # [order - 1]: windows x languages, log2 of the interpolated probability
    contexts: list[Any]  # [order - 1]: sorted hashes of the windows of that order, as contexts
    weights: list[Any]  # [order - 1]: contexts x languages, log2 of the weight of the shorter model
    floor: Any  # languages: log2 probability of a character never seen
    temperature: float = 1.0
    highest: Any = None  # languages: highest cross-entropy accepted

    def log_probabilities(self, codes):
        """Sum over all windows of log2 p, per language."""
        import numpy as np

        total = np.zeros(len(self.languages))
        for at in range(0, len(codes) - ORDER + 1, BLOCK):
            some = codes[at : at + BLOCK + ORDER - 1]
            total += self._sum(some, ORDER, np.arange(ORDER - 1, len(some)))
        return total

    def _sum(self, codes, order: int, ends):
        """Sum for the characters at ``ends`` under the models of ``order``; windows not seen go on to the next shorter order."""
        import numpy as np

        if not len(ends):
            return 0.0
        if order == 0:
            return self.floor * len(ends)
        here = hashes(codes, order)[ends - order + 1]
        at, seen = _find(self.windows[order - 1], here)
        total = self.logs[order - 1][at[seen]].sum(0, dtype=np.float64)
        rest = ends[~seen]
        if len(rest):
            if order > 1:
                context = hashes(codes, order - 1)[rest - order + 1]
                at, known = _find(self.contexts[order - 2], context)
                total = total + self.weights[order - 2][at[known]].sum(0, dtype=np.float64)
            total = total + self._sum(codes, order - 1, rest)
        return total

    def cross_entropy(self, text: str | None):
        """Bits per character and language; None without a letter."""
        codes = characters(text) if text else None
        if codes is None or not self.languages:
            return None
        if len(codes) < ORDER:  # one letter: padded on the left
            import numpy as np

            codes = np.concatenate([np.full(ORDER - len(codes), 32, codes.dtype), codes])
        return -self.log_probabilities(codes) / (len(codes) - ORDER + 1)

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        import numpy as np

        bits = self.cross_entropy(text)
        if bits is None:
            return UNKNOWN, 0.0, False
        best = int(bits.argmin())
        odds = np.exp(-(bits - bits[best]) * self.temperature)
        rejected = bool(self.highest is not None and bits[best] > self.highest[best])
        return self.languages[best], 0.0 if rejected else float(1 / odds.sum()), rejected


def _find(table, wanted):
    """Places of ``wanted`` in a sorted array, and which are there."""
    import numpy as np

    if not len(table):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(table, wanted), len(table) - 1)
    return at, table[at] == wanted


def estimate(counts: dict[str, dict[str, int]]) -> Models:
    """Models from window counts per language."""
    import numpy as np

    languages = sorted(counts)
    alphabet = len({c for grams in counts.values() for g in grams for c in g}) + 1
    by_order: list[list[dict[str, float]]] = [[] for _ in range(ORDER)]  # order, language: window -> p
    weights: list[list[dict[str, float]]] = [[] for _ in range(ORDER)]  # length of the context, language
    floor = []
    for lang in languages:
        table = counts[lang]  # windows and how often
        tables = [table]
        for _ in range(ORDER - 1):
            shorter: dict[str, int] = {}
            for gram in tables[-1]:  # each distinct longer window is one continuation
                shorter[gram[1:]] = shorter.get(gram[1:], 0) + 1
            tables.append(shorter)
        below: dict[str, float] = {}
        base = 1 / alphabet
        for order, table in enumerate(reversed(tables), 1):
            ones = sum(n == 1 for n in table.values())
            twos = sum(n == 2 for n in table.values())
            discount = ones / (ones + 2 * twos) if ones and twos else 0.5
            sums: dict[str, int] = {}
            kinds: dict[str, int] = {}
            for gram, n in table.items():
                sums[gram[:-1]] = sums.get(gram[:-1], 0) + n
                kinds[gram[:-1]] = kinds.get(gram[:-1], 0) + 1
            weight = {c: discount * kinds[c] / sums[c] for c in sums}
            p = {
                g: (n - discount) / sums[g[:-1]] + weight[g[:-1]] * (below.get(g[1:], 0.0) if order > 1 else base)
                for g, n in table.items()
            }
            by_order[order - 1].append(p)
            weights[order - 1].append(weight)
            if order == 1:
                floor.append(np.log2(weight.get("", 1.0) * base))
            below = p
    return _arrays(languages, by_order, weights, np.array(floor))


def _arrays(languages, by_order, weights, floor) -> Models:
    import numpy as np

    def one(gram: str) -> int:
        return int(hashes(np.array([ord(c) for c in gram], np.uint64), len(gram))[0])

    def backed(order: int, k: int, gram: str) -> float:
        """log2 p of a window in language k, which needn't have seen it."""
        if order == 0:
            return float(floor[k])
        p = by_order[order - 1][k].get(gram)
        if p is not None:
            return float(np.log2(p))
        rest = weights[order - 1][k].get(gram[:-1], 1.0) if order > 1 else 1.0
        return float(np.log2(rest)) + backed(order - 1, k, gram[1:])

    windows, logs, contexts, backs = [], [], [], []
    for order in range(1, ORDER + 1):
        grams = sorted({g for p in by_order[order - 1] for g in p}, key=one)
        windows.append(np.array([one(g) for g in grams], np.uint64))
        logs.append(np.array([[backed(order, k, g) for k in range(len(languages))] for g in grams], np.float32))
        if order > 1:
            heads = sorted({c for w in weights[order - 1] for c in w}, key=one)
            contexts.append(np.array([one(c) for c in heads], np.uint64))
            backs.append(np.array([[np.log2(w.get(c, 1.0)) for w in weights[order - 1]] for c in heads], np.float32))
    return Models(languages, windows, logs, contexts, backs, floor)


def calibrate(models: Models, truths: list[str], bits: list) -> None:
    """Temperature with the best likelihood of the truth; highest cross-entropy: that of the worst right document in a thousand, and a tenth more."""
    import numpy as np

    place = {x: i for i, x in enumerate(models.languages)}
    rows = [(place[t], np.array(b)) for t, b in zip(truths, bits, strict=True) if t in place]
    if not rows:
        return
    truth, table = np.array([t for t, _ in rows]), np.array([b for _, b in rows])
    gaps = table - table.min(1, keepdims=True)

    def loss(temperature: float) -> float:
        return float((gaps[np.arange(len(truth)), truth] * temperature + np.log(np.exp(-gaps * temperature).sum(1))).mean())

    models.temperature = min((2.0**k for k in np.arange(-2, 8, 0.5)), key=loss)
    right = table.argmin(1) == truth
    models.highest = np.full(len(models.languages), np.inf)
    for k in range(len(models.languages)):
        own = table[right & (truth == k), k]
        if len(own) >= CALIBRATES:
            models.highest[k] = 1.1 * np.quantile(own, 0.999)


def sample(docs: DataFrame) -> DataFrame:
    """lang, text, counted (or else it calibrates) of the labelled sample."""
    known = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold(F.col("doc_id")) != 0))
    rates = known.groupBy("lang").agg((SAMPLE_DOCS / F.count(F.lit(1))).alias("rate"))
    chance = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("sample")), F.lit(1 << 20)) / float(1 << 20)
    drawn = known.select("doc_id", "lang", "text").join(session.checked_broadcast(rates, LANGUAGES), "lang").filter(chance < F.col("rate"))
    chars = F.length("text").cast("long")
    place = F.struct((chars > LONG).alias("long"), F.xxhash64("doc_id", F.lit("order")).alias("nth"), F.col("doc_id").alias("id"))
    drawn = written(drawn.select("lang", "text", (fold(F.col("doc_id")) == 1).alias("calibrates"), place.alias("place"), chars.alias("chars")))
    # over lengths only, and about SAMPLE_DOCS rows per language
    ahead = Window.partitionBy("lang").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    within = drawn.select("lang", "place", "chars", "calibrates").withColumn("ahead", F.coalesce(F.sum("chars").over(ahead), F.lit(0).cast("long")))
    ends = within.filter(F.col("ahead") < SAMPLE_CHARS).groupBy("lang").agg(F.max("place").alias("end"), F.count_if("calibrates").alias("n_calibrate"))
    drawn = drawn.join(session.checked_broadcast(ends, LANGUAGES), "lang").filter(F.col("place") <= F.col("end"))
    return drawn.select("lang", "text", (~F.col("calibrates") | (F.col("n_calibrate") < CALIBRATES)).alias("counted"))


def learn(docs: DataFrame) -> Models:
    """Calibrated models from the documents (doc_id, text, lang) that aren't held out."""
    drawn = written(sample(docs))  # read twice
    counts: dict[str, dict[str, int]] = {}
    for r in window_counts(drawn.filter("counted")).toLocalIterator():
        counts.setdefault(r["lang"], {})[r["gram"]] = r["n"]
    models = estimate(counts)
    shared = docs.sparkSession.sparkContext.broadcast(models)

    def make():
        def work(langs, texts):
            bits = [shared.value.cross_entropy(t) for t in texts]
            return {"lang": langs, "bits": [None if b is None else b.tolist() for b in bits]}

        return work

    scored = map_texts(drawn.filter("not counted").select("lang", "text"), "lang string, bits array<double>", make).filter("bits is not null").collect()
    calibrate(models, [r["lang"] for r in scored], [r["bits"] for r in scored])
    return models


def identify(docs: DataFrame, models: Models, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score, rejected per row."""
    shared = docs.sparkSession.sparkContext.broadcast(models)

    def make():
        def work(ids, texts):
            found = [shared.value.predict(t) for t in texts]
            return {"doc_id": ids, "lang_pred": [f[0] for f in found], "score": [f[1] for f in found], "rejected": [f[2] for f in found]}

        return work

    schema = "doc_id long, lang_pred string, score double, rejected boolean"
    return map_texts(docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")), schema, make)


@register("op10_language_id")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    held_out = F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False))
    return identify(docs, learn(docs)).select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected")
