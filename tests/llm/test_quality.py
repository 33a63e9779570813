import base64
import random
import re
from collections import Counter

from digestry.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    inside = {i + k for i in range(len(words) - 4) for k in range(5) if windows[tuple(words[i : i + 5])] > 1}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    failed = len(words) < 10 or 100 * len(inside) > 20 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(inside), failed


def texts():
    pick = random.Random(4)
    out = [None, "", " \n\t", "a", "é\xa0b c", "a b c d e a b c d e", "x\n\nx\n \nx\ry\x0bz\x0c#"]
    for _ in range(150):
        vocabulary = [pick.choice("abcdé#") * pick.randint(1, 3) for _ in range(pick.choice([2, 4, 300]))]
        out.append("".join(pick.choice(vocabulary) + pick.choice([" ", " ", "\n", "\t", "  "]) for _ in range(pick.randint(0, 300))))
    return out


def judged(spark, values):
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(values)], "doc_id long, text string, kept int")
    return {r["doc_id"]: r for r in quality.judge_quality(df).collect()}


def test_base_counts_against_brute_force(spark):
    values = texts()
    got = judged(spark, values)
    for i, t in enumerate(values):
        assert tuple(got[i])[1:7] == brute(t), t
        assert not (got[i]["base_failed"] and got[i]["kept"])


def test_bands(spark):
    pick = random.Random(5)
    syllables = [a + b for a in "bcdfglmnprst" for b in "aeiou"]
    lexicon = ["".join(pick.choice(syllables) for _ in range(pick.randint(1, 4))) for _ in range(2000)]
    prose = lambda n: " ".join(pick.choice(lexicon) for _ in range(n))
    clean = [prose(n) for n in (12, 40, 150, 1000, 8000)]
    noise = [" ".join(base64.b64encode(pick.randbytes(60)).decode() for _ in range(n)) for n in (20, 200)]
    stuck = [" ".join(f"{pick.choice('abcd')}!!" for _ in range(2000)), " ".join("row %d of the same long table line" % (i % 7) + str(i) for i in range(900))]
    half = prose(1500) + " " + " ".join(["spam"] * 9000)
    got = judged(spark, clean + noise + stuck + [half])
    assert [got[i]["kept"] for i in range(len(clean))] == [True] * len(clean)
    assert not any(got[i]["kept"] for i in range(len(clean), len(clean) + 5))


def prose(pick, n_bytes):
    syllables = [a + b for a in "bcdfglmnprst" for b in "aeiou"]
    lexicon = ["".join(pick.choice(syllables) for _ in range(pick.randint(1, 4))) for _ in range(2000)]
    return " ".join(pick.choice(lexicon) for _ in range(n_bytes // 3))[:n_bytes]


def noise(pick, n_bytes):
    return " ".join(base64.b64encode(pick.randbytes(45)).decode() for _ in range(n_bytes // 60 + 1))[:n_bytes]


def rows(pick, n_bytes):
    return "".join(f"the same long tables {i}\n" for i in range(n_bytes // 22 + 9))[:n_bytes]


def test_chunks_decide_alone(spark):
    pick = random.Random(6)
    planted = [(make, n, share) for make in (noise, rows) for n, share in ((40_000, 0.1), (40_000, 0.3), (6000, 0.3))]
    texts = []
    for make, n, share in planted:
        text = prose(pick, n)
        texts.append(text[: n // 3] + " " + make(pick, int(n * share)) + " " + text[n // 3 + int(n * share) :])
    text = prose(pick, 40_000)
    texts.append(text[:9000] + " " + noise(pick, 700) + " " + text[9000:])
    got = judged(spark, texts)
    for i, case in enumerate(planted):
        low, high = quality.band(len(texts[i]))
        assert not got[i]["base_failed"] and low <= got[i]["ratio"] <= high and not got[i]["kept"], case
    assert got[len(planted)]["kept"]


def test_whole_decides_alone(spark):
    # every ordered pair of 41 phrases once: no five words come twice, and no kilobyte repeats much
    words = prose(random.Random(7), 4000).split()
    phrases = [" ".join(f"{w}{i}" for w in words[4 * i : 4 * i + 4]) for i in range(41)]
    text = " ".join(phrases[k * d % 41] for d in range(1, 41) for k in range(41))
    (row,) = judged(spark, [text]).values()
    assert not row["base_failed"] and row["bad_chunk_share"] <= quality.MAX_BAD_SHARE and not row["kept"]


def test_short_upper_bands(spark):
    pick = random.Random(8)
    sizes = [200, 240, 300, 400, 700, 1500, 5000]
    got = judged(spark, [" ".join(base64.b64encode(pick.randbytes(12)).decode() for _ in range(400))[:n] for n in sizes] + [prose(pick, n) for n in sizes])
    assert not any(got[i]["kept"] or got[i]["base_failed"] for i in range(len(sizes)))
    assert all(got[i]["kept"] for i in range(len(sizes), 2 * len(sizes)))


def test_one_and_none(spark):
    assert judged(spark, []) == {}
    df = spark.createDataFrame([(1, "w%d " * 3, "x"), (2, " ".join(f"w{i * i}q" for i in range(40)), "x"), (2, None, None)], "doc_id long, text string, ratio string")
    out = quality.keep_good(df)
    assert out.columns == df.columns and [r["doc_id"] for r in out.collect()] == [2]
