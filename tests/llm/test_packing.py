import random
import zlib
from collections import Counter

import numpy as np
import pytest

from digestry.llm import packing

SCHEMA = "doc_id long, text string, start long, hash string"


def encoder():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(packing.default_vocabulary())


def test_fast_encoder_gives_the_same_ids():
    exact, fast, pick = encoder(), packing.make_encoder(packing.default_vocabulary()), random.Random(1)
    pool = "\t\n\r  ''''sdtrevml0123456789.,;:!?-_()[]{}<>|$%#&*+=/\\\"@^`~abcxyzABCXYZéèçñßüöäÀÿ¡¿²½ªµ–—‘’“”„…€ſĀŁő"
    more = pool + "\xa0 　中文🙂́\x0b\x0c\x00\x1c\x85٣Ⅷ"
    for k in range(6000):
        text = "".join(pick.choice(more if k % 3 == 0 else pool) for _ in range(pick.randint(0, 30))) + "<|endoftext|>" * (k % 7 == 0)
        assert fast(text) == exact.encode(text, add_special_tokens=False).ids, text


def optimum(items, length):
    items, best = sorted(items, reverse=True), [len(items)]

    def go(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(items):
            best[0] = len(bins)
            return
        for k in {b: k for k, b in enumerate(bins) if b + items[i] <= length}.values():
            bins[k] += items[i]
            go(i + 1, bins)
            bins[k] -= items[i]
        go(i + 1, [*bins, items[i]])

    go(0, [])
    return best[0]


def check_plan(plan, counts, length):
    used = Counter()
    for filling, times in plan:
        assert sum(size * n for size, n in filling) <= length and times > 0
        for size, n in filling:
            used[size] += n * times
    assert used == Counter({s: n for s, n in counts.items() if n})


def test_search_against_the_optimum():
    worse = 0
    for seed in range(200):
        pick = random.Random(seed)
        counts = Counter(pick.randint(15, 70) for _ in range(11))
        plan = packing.bin_completion(counts, 100)
        check_plan(plan, counts, 100)
        best = optimum(list(counts.elements()), 100)
        assert packing.lower_bound(counts, 100) <= best
        worse += packing.n_sequences(plan) - best
    assert worse <= 2


@pytest.mark.parametrize("n", [0, 1, 300, 20_000])
def test_search_beats_best_fit_and_nears_the_bound(n):
    pick = random.Random(n)
    counts = Counter(1 + int(pick.lognormvariate(5.8, 1.0)) % 1023 for _ in range(n))
    counts[700] += n  # a hot length
    plan = packing.bin_completion(counts)
    check_plan(plan, counts, 1024)
    used, bound = packing.n_sequences(plan), packing.lower_bound(counts, 1024)
    assert bound <= used <= packing.n_sequences(packing.best_fit(counts, 1024)) if n else not plan
    assert used <= bound * 1.01 + 1


def test_fillings_use_each_piece_once():
    found = packing.fillings({8: 2, 6: 1, 4: 1, 2: 1}, 20, 10)
    assert (0, ((8, 1), (6, 1), (4, 1), (2, 1))) in found and (0, ((8, 2), (4, 1))) in found


def test_cut():
    assert packing.cut(5, 4) == [(0, 1), (1, 4)] and packing.cut(8, 4) == [(0, 4), (4, 4)] and packing.cut(3, 4) == [(0, 3)]


def test_pack_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(packing, "ROWS_PER_RANGE", 7)
    pick, exact = random.Random(2), encoder()
    texts = [None, "", "<|endoftext|>", "Zażółć 中文 🙂"] + [" ".join(pick.choice(["alpha", "beta", "é", "x1", "\n"]) for _ in range(pick.randint(0, 120))) for _ in range(150)]
    rows = [(pick.choice([i, None, 3]), t, 1, "clash") for i, t in enumerate(texts)] + [(9, "same text again", 1, "x")] * 60
    got = packing.pack(spark.createDataFrame(rows, SCHEMA), length=64, with_ids=True).collect()
    want = Counter()
    for doc_id, text, *_ in rows:
        ids = [*exact.encode(text or "", add_special_tokens=False).ids, packing.END_ID]
        for k, (start, n) in enumerate(packing.cut(len(ids), 64)):
            part = ids[start : start + n]
            want[doc_id, k, start, n, zlib.crc32(np.array(part, "<u4").tobytes()), tuple(part)] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"], tuple(r["ids"])) for r in got) == want
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by.values():
        at = 0
        for offset, n in sorted(places):
            assert offset == at
            at += n
        assert at <= 64
    assert len(by) <= -(-sum(r["length"] for r in got) // 64) + 1


def test_sequences_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "a b c"), (2, "d e"), (3, "word " * 90)], "doc_id long, text string")
    packed = packing.pack(docs, length=64, with_ids=True)
    rows = packing.sequences(packed).collect()
    assert sorted(x for r in rows for x in r["ids"]) == sorted(x for r in packed.collect() for x in r["ids"])
    assert all(len(r["ids"]) <= 64 and r["starts"][0] == 0 for r in rows)
    assert packing.pack(docs.limit(0)).count() == 0
