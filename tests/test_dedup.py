import random

from pyspark.sql import functions as F

from conftest import articles_df
from digestry.operators import dedup


def ids(df):
    return sorted(r["id"] for r in df.select("id").collect())


def process(df, t=0.7):
    """The reference's process(): exact (D1 -> D2) then fuzzy (greedy, exact)."""
    return dedup.fuzzy_dedup_greedy(dedup.exact_dedup(df), threshold=t)


def bigrams(s):
    return {s[i:i + 2] for i in range(len(s) - 1)}


def dice(a, b):
    """The definition: twice the shared bigrams over all bigrams of both."""
    ga, gb = bigrams(a), bigrams(b)
    return 1.0 if a == b else 2 * len(ga & gb) / max(1, len(ga) + len(gb))


LETTERS = "abcdefghijklmnopqrstuvwxyz"


def pair_with(shared, own):
    """Two titles of distinct letters: a common run of ``shared`` bigrams, then ``own`` bigrams of each alone."""
    run = LETTERS[:shared + 1]
    return run + "0123456789"[:own], run + "9876543210"[:own]


def test_url_key_decides_before_the_title(spark):
    first, second = pair_with(3, 9)
    df = articles_df(spark, [("1", "https://u.example/p/q", first, "c1"), ("2", "https://u.example/p/q/", second, "c2"),
                             ("3", "https://u.example/p/r", "0 1 2 3", "c3")])
    assert dice(first, second) < 0.7
    assert ids(process(df)) == ["1", "3"]


def test_row_with_content_survives(spark):
    df = articles_df(spark, [("1", "https://u.example/1", LETTERS), ("2", "https://u.example/2", LETTERS, "x")])
    assert ids(process(df)) == ["2"]


def test_pairs_just_above_and_below_the_threshold(spark):
    for shared, own in ((14, 6), (13, 6), (7, 3), (6, 3), (20, 8), (20, 9)):
        first, second = pair_with(shared, own)
        value = dice(first, second)
        assert abs(value - shared / (shared + own)) < 1e-12
        df = articles_df(spark, [("1", "https://u.example/1", first), ("2", "https://u.example/2", second)])
        want = 1 if value >= 0.7 else 2
        assert process(df).count() == dedup.composite_dedup(df).count() == want, (shared, own, value)
    assert dice(*pair_with(7, 3)) == 0.7  # on the threshold: similar


def test_word_order_counts_only_at_the_seams(spark):
    # the fingerprint sorts words, so the same words in another order are equal titles
    df = articles_df(spark, [("1", "https://u.example/1", "kilo lima mike"), ("2", "https://u.example/2", "mike kilo lima")])
    assert process(df).count() == 1


def test_empty_and_equal_titles(spark):
    for title in ("", LETTERS):
        df = articles_df(spark, [("1", "https://u.example/1", title), ("2", "https://u.example/2", title)])
        assert process(df).count() == 1


def test_threshold_is_a_parameter(spark):
    first, second = pair_with(8, 2)
    df = articles_df(spark, [("1", "https://u.example/1", first), ("2", "https://u.example/2", second)])
    assert [process(df, t).count() for t in (0.75, 0.8, 0.81)] == [1, 1, 2]


def test_many_rows_of_few_titles(spark):
    # seven unlike titles and a near copy of each: two rows in three are copies by the fingerprint alone
    titles = ["".join(chr(97 + (k * 5 + i * (k + 1)) % 26) for i in range(18)) for k in range(7)]
    titles = [t for k, t in enumerate(titles) if all(dice(t, u) < 0.5 for u in titles[:k])]
    rows = [(str(i), f"https://u.example/{i}", titles[i % len(titles)] + ("0" if i % 3 == 0 else "")) for i in range(900)]
    df = articles_df(spark, rows)
    assert all(dice(t, t + "0") >= 0.7 for t in titles)
    assert process(df).count() == dedup.composite_dedup(df).count() == len(titles)


def test_leader_replacement_moves_comparison_title(spark):
    # 1 has no content; 2 is similar to 1 and has content: 2 takes the slot and
    # becomes the comparison title; 3 is similar to 2 but not to 1.
    df = articles_df(spark, [
        ("1", "https://a.example/1", "alpha beta gamma delta"),
        ("2", "https://a.example/2", "alpha beta gamma delta epsilon", "x"),
        ("3", "https://a.example/3", "beta gamma delta epsilon zeta", "y"),
    ])
    out = dedup.fuzzy_dedup_greedy(df, threshold=0.8).orderBy("rank").collect()
    assert [r["id"] for r in out] == ["2"]


def _greedy(rows, t, replace=True):
    """Sequential model of the reference's fuzzy loop on (id, norm, has_content)."""
    def grams(s):
        return {s[i:i + 2] for i in range(len(s) - 1)}

    def dice(a, b):
        if a == b:
            return 1.0
        ga, gb = grams(a), grams(b)
        return 0.0 if not ga and not gb else 2 * len(ga & gb) / (len(ga) + len(gb))

    kept = []
    for r in rows:
        idx = next((i for i, k in enumerate(kept) if dice(k[1], r[1]) >= t), None)
        if idx is None:
            kept.append(r)
        elif replace and not kept[idx][2] and r[2]:
            kept[idx] = r
    return [k[0] for k in kept]


def _random_rows(seed, n):
    rnd = random.Random(seed)
    words = ["ab", "abc", "bcd", "cde", "xy", "xyz", "yza", "qq", "qrs"]
    return [(str(i), " ".join(rnd.choice(words) for _ in range(rnd.randint(1, 4))), rnd.random() < 0.8) for i in range(n)]


def test_greedy_fold_matches_sequential_model(spark):
    rows = _random_rows(7, 120)
    df = spark.createDataFrame([(i, f"https://u/{i}", t, "c" if h else "", int(i)) for i, t, h in rows],
                               "id string, url string, title string, content string, ord bigint")
    got = [r["id"] for r in dedup.fuzzy_dedup_greedy(df, threshold=0.7).orderBy("rank").collect()]
    assert got == _greedy(rows, 0.7)


def test_scale_mode_equals_greedy_without_replacement(spark):
    for seed in (1, 2, 3):
        rows = _random_rows(seed, 150)
        df = spark.createDataFrame([(i, f"https://u/{i}", t, "c" if h else "", int(i)) for i, t, h in rows],
                                   "id string, url string, title string, content string, ord bigint")
        out = dedup.fuzzy_dedup_scale(df, threshold=0.7)
        leaders = sorted(int(r["ord"]) for r in out.select("ord").collect())
        assert leaders == sorted(int(i) for i in _greedy(rows, 0.7, replace=False))


def test_scale_mode_equals_exact_mode_when_all_rows_have_content(spark):
    rows = [(i, t, True) for i, t, _ in _random_rows(11, 150)]
    df = spark.createDataFrame([(i, f"https://u/{i}", t, "c", int(i)) for i, t, _ in rows],
                               "id string, url string, title string, content string, ord bigint")
    a = ids(dedup.fuzzy_dedup_greedy(df, threshold=0.7))
    b = ids(dedup.fuzzy_dedup_scale(df, threshold=0.7))
    assert a == b


def test_similar_pairs_complete(spark):
    rows = _random_rows(5, 80)
    df = spark.createDataFrame([(i, f"https://u/{i}", t, "c", int(i)) for i, t, _ in rows],
                               "id string, url string, title string, content string, ord bigint")
    pairs = {(r["a_ord"], r["b_ord"]) for r in dedup.similar_pairs(df, threshold=0.5).collect()}
    first = {}
    for i, t, _ in rows:
        first.setdefault(t, int(i))
    reps = sorted((o, t) for t, o in first.items())

    def grams(s):
        return {s[i:i + 2] for i in range(len(s) - 1)}

    want = set()
    for x in range(len(reps)):
        for y in range(x + 1, len(reps)):
            ga, gb = grams(reps[x][1]), grams(reps[y][1])
            if ga or gb:
                if 2 * len(ga & gb) / (len(ga) + len(gb)) >= 0.5:
                    want.add((reps[x][0], reps[y][0]))
    assert pairs == want


def test_result_independent_of_shuffle_partitions(spark):
    rows = _random_rows(9, 200)
    df = spark.createDataFrame([(i, f"https://u/{int(i) % 50}", t, "c" if h else "", int(i)) for i, t, h in rows],
                               "id string, url string, title string, content string, ord bigint")
    results = []
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in (1, 4, 64):
            spark.conf.set("spark.sql.shuffle.partitions", str(n))
            results.append(ids(process(df)))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert results[0] == results[1] == results[2]


def test_keyed_last_wins(spark):
    e = spark.createDataFrame([("a", "old", 1), ("b", "keep", 2)], "id string, title string, pos int")
    l = spark.createDataFrame([("a", "new", 1), ("c", "add", 2)], "id string, title string, pos int")
    out = {r["id"]: (r["title"], r["_src"]) for r in dedup.keyed_last_wins(e, l).collect()}
    assert out == {"a": ("new", 0), "b": ("keep", 0), "c": ("add", 1)}


def test_text_is_never_shuffled_by_dedup(spark):
    """No exchange or aggregate of the narrow dedup plans holds the content."""
    df = articles_df(spark, [(str(i), f"https://u.example/{i % 7}", LETTERS[i % 5:], "body") for i in range(40)])
    plans = [dedup.exact_dedup(dedup.narrow(df), content="_empty"), dedup.dedup_url(dedup.narrow(df), content="_empty"),
             dedup.composite_dedup(dedup.narrow(df), content="_empty")]
    for out in plans:
        plan = out._jdf.queryExecution().executedPlan().toString()
        for line in plan.splitlines():
            if "Exchange" in line or "Aggregate" in line:
                assert "content" not in line, line
    wide = dedup.exact_dedup(df)._jdf.queryExecution().executedPlan().toString()
    assert any("content" in x for x in wide.splitlines() if "Aggregate" in x)


def test_absorbed_titles_in_a_chain(spark):
    # 0-1-2-3-4-5: 0 leads and absorbs 1, so 2 leads and absorbs 3, so 4 leads and absorbs 5
    pairs = spark.createDataFrame([(i, i + 1) for i in range(5)], "a long, b long")
    assert sorted(r["b"] for r in dedup.absorbed_titles(pairs).collect()) == [1, 3, 5]
    assert dedup.absorbed_titles(pairs.limit(0)).count() == 0


def test_minhash_finds_most_similar_pairs_and_no_others(spark):
    from digestry.operators import minhash

    pick, words = random.Random(11), [f"{a}{b}{c}" for a in ("ka", "mo", "ri", "tu") for b in ("len", "dor", "vis") for c in ("a", "ex", "ium")]
    rows = []
    for _ in range(60):
        base = [pick.choice(words) for _ in range(6)]
        for _ in range(5):
            near = list(base)
            near[pick.randrange(6)] = pick.choice(words)
            rows.append(" ".join(near))
    rows += ["", "x", "x", " "]
    df = articles_df(spark, [(str(i), f"https://u.example/{i}", t) for i, t in enumerate(rows)])
    exact = {(r["a_ord"], r["b_ord"]) for r in dedup.similar_pairs(df).collect()}
    found = {(r["a_ord"], r["b_ord"]) for r in minhash.similar_pairs(df).collect()}
    assert found <= exact and len(found) >= 0.9 * len(exact) > 300
    assert minhash.similar_pairs(df.limit(0)).count() == 0
    leaders = dedup.fuzzy_dedup_scale(df, find_pairs=minhash.rep_pairs).count()
    assert dedup.fuzzy_dedup_scale(df).count() <= leaders <= 1.1 * dedup.fuzzy_dedup_scale(df).count()


def test_titles_in_blocks_and_waves_are_all_compared(spark, monkeypatch):
    from digestry.operators import title_blocks

    pick = random.Random(3)
    words = ["alpha", "bravo", "carbon", "delta", "ember", "falcon", "garnet", "harbor"]
    rows = [(g, i, " ".join(pick.choice(words) for _ in range(pick.randrange(1, 7)))) for i, g in enumerate(pick.choice(["x", "x", "x", "y", None]) for _ in range(150))]
    df = spark.createDataFrame([(g, i, t, "c", str(i)) for g, i, t in rows], "grp string, ord bigint, title string, content string, id string")
    first = {}
    for g, i, t in rows:
        if g is not None:
            first.setdefault((g, t), i)
    grams = lambda s: {s[i:i + 2] for i in range(len(s) - 1)}
    want = {(g, i, j) for (g, t), i in first.items() for (h, u), j in first.items()
            if g == h and i < j and 2 * len(grams(t) & grams(u)) / (len(grams(t)) + len(grams(u))) >= 0.7}
    whole = ids(dedup.fuzzy_dedup_scale(df, ["grp"], 0.7))
    monkeypatch.setattr(title_blocks, "BLOCK", 40)
    monkeypatch.setattr(title_blocks, "AT_ONCE", 5)
    got = [(r["grp"], r["a_ord"], r["b_ord"]) for r in dedup.similar_pairs(df, ["grp"], 0.7).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    monkeypatch.setattr(dedup, "WAVE", 60)
    assert ids(dedup.fuzzy_dedup_scale(df, ["grp"], 0.7)) == whole


def test_titles_that_are_not_new_meet_only_new_ones(spark, monkeypatch):
    """What earlier waves have held against each other isn't again, and edges are decided in windows."""
    from digestry.operators import minhash, title_blocks

    rows = [(i, f"alpha bravo carbon {w}", i % 3 == 0) for i, w in enumerate(["delta", "deltas", "deltaz", "delt", "xdelta", "adelta"])]
    reps = spark.createDataFrame(rows, "_rep bigint, _norm string, _new boolean")
    new = {i for i, _, n in rows if n}
    for find in (title_blocks.similar_titles, minhash.rep_pairs):
        every = {(r["a"], r["b"]) for r in find(reps.drop("_new"), [], 0.7).collect()}
        assert find is minhash.rep_pairs or len(every) == 15
        for cross, some in ((False, (1, 2)), (True, (1,))):
            got = [(r["a"], r["b"]) for r in find(reps, [], 0.7, cross=cross).collect()]
            assert sorted(got) == sorted(p for p in every if len(new & set(p)) in some)
    monkeypatch.setattr(dedup, "EDGES", 2)
    pairs = spark.createDataFrame([(i, i + 1) for i in range(9)], "a long, b long")
    assert sorted(r["b"] for r in dedup.absorbed_titles(pairs).collect()) == [1, 3, 5, 7, 9]
