import random
import re

import xxhash

from digestry.llm import simhash
from digestry.llm.components import component_roots

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def fingerprint(text):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def groups(nodes, bits=3):
    """Brute force: node -> all nodes reachable by links of at most ``bits`` bits."""
    left, out = set(nodes), {}
    while left:
        reach, todo = set(), [left.pop()]
        while todo:
            x = todo.pop()
            reach.add(x)
            near = {y for y in left if (x ^ y).bit_count() <= bits}
            left -= near
            todo += near
        out |= dict.fromkeys(reach, reach)
    return out


def table():
    pick = random.Random(8)
    lexicon = [f"w{i}É" for i in range(400)] + ["The", "OF"]
    base = [" ".join(pick.choice(lexicon) for _ in range(pick.choice([1, 2, 3, 30, 300]))) for _ in range(60)]
    out = [None, "", " \n", "a", "A", "one two", "one  TWO"]
    for text in base:
        out += [text] * pick.choice([1, 1, 1, 4])
        for _ in range(3):
            words = text.split()
            words[pick.randrange(len(words))] = pick.choice(lexicon)
            out.append(" ".join(words))
    rows = [(pick.choice([i, i, i, i, None]), t, "en", "s", 0) for i, t in enumerate(out)]
    return rows + rows[20:30]


def test_fingerprints_and_components_against_brute_force(spark):
    rows = table()
    prints = [fingerprint(r[1]) for r in rows]
    reach = groups(set(prints))
    assert len({frozenset(g) for g in reach.values()}) < len(reach)  # there are links
    want = []
    for r, p in zip(rows, prints, strict=True):
        ids = [q[0] for q, x in zip(rows, prints, strict=True) if x in reach[p] and q[0] is not None]
        want.append((r[0], p - (1 << 64) if p >> 63 else p, min(ids, default=None)))
    df = spark.createDataFrame(rows, SCHEMA).withColumnRenamed("n_chars", "fp")
    got = simhash.near_duplicates(df).select("doc_id", "fp", "component_id").collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_links_against_all_pairs(spark):
    pick = random.Random(9)
    nodes = {0, 2**64 - 1}
    for _ in range(40):
        center = pick.getrandbits(64)
        for _ in range(12):
            x = center
            for _ in range(pick.randint(0, 4)):
                x ^= 1 << pick.randrange(64)
            nodes.add(x)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    got = simhash.links(spark.createDataFrame([(signed(x),) for x in nodes], "fp long"), len(nodes)).collect()
    want = {frozenset((signed(x), signed(y))) for x in nodes for y in nodes if 0 < (x ^ y).bit_count() <= 3}
    assert {frozenset((r["u"], r["v"])) for r in got} == want
    assert len(got) <= 2 * len(want)


def test_crowded_segments_against_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(simhash, "CROWD", 8)
    pick = random.Random(10)
    low, high = pick.getrandbits(32), pick.getrandbits(32) | 1 << 31
    nodes = set()
    for _ in range(60):  # all share a segment, some of them also half of the other, or all but a bit
        x = pick.getrandbits(32)
        for _ in range(4):
            near = x
            for _ in range(pick.randint(0, 4)):
                near ^= 1 << pick.randrange(32)
            nodes |= {near << 32 | low, high << 32 | near, near << 32 | low ^ 1 << pick.randrange(32)}
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    got = simhash.links(spark.createDataFrame([(signed(x),) for x in nodes], "fp long"), len(nodes)).collect()
    want = {frozenset((signed(x), signed(y))) for x in nodes for y in nodes if 0 < (x ^ y).bit_count() <= 3}
    assert len(want) > 100 and {frozenset((r["u"], r["v"])) for r in got} == want


def test_keep_one_of_each_component(spark):
    rows = [r for r in table()]
    df = spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA + ", row string")
    out = simhash.keep_one(df)
    assert out.columns == df.columns
    kept = [(r["doc_id"], fingerprint(r["text"])) for r in out.collect()]
    prints = {fingerprint(r[1]) for r in rows}
    reach = groups(prints)
    assert len(kept) == len({frozenset(g) for g in reach.values()})
    for doc_id, p in kept:
        ids = [q[0] for q in rows if fingerprint(q[1]) in reach[p] and q[0] is not None]
        assert doc_id == min(ids, default=None)
    assert simhash.keep_one(df.limit(0)).count() == 0


def test_components_of_chains_and_hubs(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 200)] + [(5000, 5000), (7, 3), (3, 7)]
    got = {r["u"]: r["v"] for r in component_roots(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(1, 301)}, **{1000 + i: 1000 for i in range(1, 200)}}
    assert component_roots(spark.createDataFrame([], "u long, v long")).count() == 0
