import random

from pyspark.sql import functions as F

from digestry.operators import keywords, rank


def test_weighted_score_counts_each_keyword_once(spark):
    df = spark.createDataFrame([("Big model news", "model model launch")], "title string, content string")
    out = keywords.layer1_scores(df, {"model": 50, "launch": 10}, {}).first()
    assert out["positive"] == 60 and out["layer1"] == 60


def test_overlay_custom_wins_and_zero_mutes(spark):
    base = spark.createDataFrame([("agi", 100.0), ("hype", 40.0)], "keyword string, weight double")
    custom = spark.createDataFrame([("launch", 30.0), ("hype", 0.0)], "keyword string, weight double")
    merged = keywords.overlay(base, custom)
    df = spark.createDataFrame([("AGI hype", "a launch")], "title string, content string")
    assert keywords.layer1_scores(df, merged, {}).first()["positive"] == 130


def test_boundary_spanning_keyword_scores_but_does_not_cover(spark):
    # "alpha beta" spans title and content: it scores (S2) but is no match
    df = spark.createDataFrame([("x alpha", "beta y")], "title string, content string")
    assert keywords.layer1_scores(df, {"alpha beta": 10}, {}).first()["positive"] == 10
    assert df.select(keywords.match_array(["alpha beta"]).alias("m")).first()["m"] == []


def test_overlapping_keywords_all_count(spark):
    df = spark.createDataFrame([("agentic arc-agi", None)], "title string, content string")
    got = keywords.layer1_scores(df, {"agi": 45, "arc-agi": 15, "agent": 15, "agentic": 30}, {}).first()["positive"]
    assert got == 105


def test_negative_subtracts_with_floor(spark):
    df = spark.createDataFrame([("a sponsored post", "")], "title string, content string")
    assert keywords.layer1_scores(df, {"post": 10}, {"sponsored": 25}).first()["layer1"] == 0


def test_large_dictionary_path_matches_inline(spark):
    words = [f"w{i:04d}" for i in range(700)]
    dic = spark.createDataFrame([(w, float(i % 7)) for i, w in enumerate(words)], "keyword string, weight double")
    rows = [(" ".join(random.Random(s).sample(words, 30)), "") for s in range(20)]
    df = spark.createDataFrame(rows, "title string, content string")
    big = keywords.layer1_scores(df, dic, {}, inline_limit=100).select("positive").collect()
    small = keywords.layer1_scores(df, dic, {}, inline_limit=1000).select("positive").collect()
    assert [r[0] for r in big] == [r[0] for r in small]


def _coverage_loop(rows, limit):
    seen, kept = set(), []
    for rid, matches in rows:
        if len(kept) >= limit:
            break
        if matches and all(m in seen for m in matches):
            continue
        kept.append(rid)
        seen.update(matches)
    return kept


def test_coverage_window_form_equals_loop(spark):
    rnd = random.Random(3)
    for trial in range(5):
        rows = [(i + 1, sorted(set(rnd.sample("abcdefgh", rnd.randint(0, 3))))) for i in range(60)]
        df = spark.createDataFrame(rows, "rank int, matches array<string>")
        got = [r["rank"] for r in rank.coverage_filter(df, "matches", "rank", (), 25).orderBy("cov_rank").collect()]
        assert got == _coverage_loop(rows, 25), trial


def test_top_k_grouped_and_stable(spark):
    df = spark.createDataFrame([("g", 1, 5.0), ("g", 2, 5.0), ("g", 3, 9.0), ("h", 4, 1.0)], "g string, ord int, s double")
    out = rank.top_k(df, 2, [F.col("s").desc(), F.col("ord")], ["g"], "rank").orderBy("g", "rank").collect()
    assert [(r["g"], r["ord"]) for r in out] == [("g", 3), ("g", 1), ("h", 4)]


def test_repeated_keywords_give_one_result_for_any_size(spark):
    words = spark.createDataFrame([("agi", 5.0), ("agi", 5.0), ("here", 1.0), ("here", 0.5), ("", 2.0), ("", 2.0)], "keyword string, weight double")
    df = spark.createDataFrame([(1, "AGI", "is here"), (2, "none", None)], "ord long, title string, content string")
    for limit in (512, 1):
        got = {r["ord"]: r["positive"] for r in keywords.layer1_scores(df, words, {}, inline_limit=limit).collect()}
        assert got == {1: 8.0, 2: 2.0}
        hits = keywords.keyword_hits(df, words.where("keyword <> ''"), ["ord"], inline_limit=limit).collect()
        assert sorted(map(tuple, hits)) == [(1, "agi", 5.0), (1, "here", 1.0)]


def test_what_many_texts_hold_is_not_written(spark, monkeypatch):
    written, write = [], keywords.materialize
    monkeypatch.setattr(keywords, "materialize", lambda df: (written.append(df.columns), write(df))[1])
    monkeypatch.setattr(keywords, "FEW_ROWS", 0)
    df = spark.createDataFrame([(1, "alpha bravo", "x"), (1, "alpha bravo", "x"), (1, "carbon", "alphabet"), (2, "", None), (3, "bra", "vo")],
                               "ord long, title string, content string")
    words = spark.createDataFrame([("alpha", 5.0), ("bravo", 7.0), ("alphabet", 1.0), ("o", 2.0)], "keyword string, weight double")
    got = keywords.layer1_scores(df, words, {}, inline_limit=1).select("ord", "title", "positive").collect()
    assert sorted(map(tuple, got)) == [(1, "alpha bravo", 14.0), (1, "alpha bravo", 14.0), (1, "carbon", 8.0), (2, "", 0.0), (3, "bra", 2.0)]
    assert not [c for c in written if "_met" in c]


def test_keywords_are_found_by_runs_as_by_contains(spark, monkeypatch):
    """words, phrases, signs, long and empty keywords, in one pass and in small parts; and as by gram joins."""
    import pyarrow as pa

    from digestry.operators import finder

    rnd = random.Random(5)
    text = lambda n: "".join(rnd.choice("abñ _-. 1é\n漢") for _ in range(n))
    texts = [text(rnd.randint(0, 150)) for _ in range(40)] + [None, "", "a" * 90]
    lows = list({text(rnd.choice([1, 2, 3, 5])) for _ in range(60)} | {t[3:33] for t in texts if t and len(t) > 40} | {"", "a" * 40, "a" * 89})
    entries = pa.table({"keyword": lows, "_low": lows, "weight": pa.array([None if i == 7 else float(i) for i in range(len(lows))])})
    want = [[i for i, low in enumerate(lows) if low in (t or "")] for t in texts]
    for at_once in (1 << 23, 64):
        monkeypatch.setattr(finder, "AT_ONCE", at_once)
        listed = finder.Listed(entries)
        assert listed.numbers(pa.array(texts)).to_pylist() == want
        assert listed.scores(pa.array(texts)).to_pylist() == [None if 7 in w else float(sum(w)) for w in want]
        assert [[x["keyword"] for x in f] for f in listed.found(pa.array(texts)).to_pylist()] == [[lows[i] for i in w] for w in want]

    df = spark.createDataFrame([(i, t, "tail") for i, t in enumerate(texts)], "ord long, title string, content string")
    words = spark.createDataFrame([(w, 1.0) for w in lows if w] + [("tail", 3.0), (None, 9.0)], "keyword string, weight double")
    by_runs = keywords.keyword_hits(df, words, ["ord"], inline_limit=1)
    scores = keywords.layer1_scores(df, words, {}, inline_limit=1).select("ord", "positive")
    assert "Exchange" not in scores._jdf.queryExecution().executedPlan().toString()  # texts stay where they are
    monkeypatch.setattr(keywords, "MAX_BROADCAST_KEYWORDS", 0)
    by_grams = keywords.keyword_hits(df, words, ["ord"], inline_limit=1)
    assert sorted(map(tuple, by_runs.collect())) == sorted(map(tuple, by_grams.collect()))
    assert sorted(scores.collect()) == sorted(keywords.layer1_scores(df, words, {}, inline_limit=1).select("ord", "positive").collect())


def test_large_dictionaries_match_after_the_prune(spark):
    """rows carry no keywords through dedup and prune; topic coverage is that of the inlined dictionary."""
    import dataclasses

    from digestry.params import DigestParams
    from digestry.plans.signal_digest import run_digest

    rows = [(str(i), f"Title {i} of {w}", f"https://x.example/{i}", "src", f"about {w} and more {i}", None, None, i // 2, "en" if i % 3 else None)
            for i, w in enumerate(["alpha", "bravo", "alpha", "gamma ray", "none", "bravo gamma", "delta"])]
    arts = spark.createDataFrame(rows, "id string, title string, url string, source string, content string, published_at string, published_ts timestamp, ord long, lang string")
    words = spark.createDataFrame([("alpha", 50.0), ("bravo", 40.0), ("gamma ray", 30.0), ("delta", 20.0), ("more", 10.0)], "keyword string, weight double")

    def run(limit):
        params = dataclasses.replace(DigestParams(), group_cols=("lang",), inline_keyword_limit=limit)
        return run_digest(arts, words, {}, params, "2025-02-01 12:00:00", finish=False)

    few, many = run(512), run(1)
    assert dict(many.pruned.dtypes)["match_idx"] == "bigint"
    of = lambda r, c: sorted((x["lang"] or "", x["cov_rank"], x["id"], x["layer1"], sorted(x[c])) for x in r.candidates.collect())
    assert of(few, "matches") == of(many, "matches")
