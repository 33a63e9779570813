from pyspark.sql import functions as F

from digestry.functions import dates as D
from digestry.functions import scores as S
from digestry.functions import text as T
from digestry.functions import urls as U


def one(spark, expr, value, schema="x string"):
    return spark.createDataFrame([(value,)], schema).select(expr.alias("r")).first()["r"]


def test_normalize_title_deletes_newlines_and_punctuation(spark):
    assert one(spark, T.normalize_title("x"), "GPT-4  released!\nNow") == "gpt4 releasednow"
    assert one(spark, T.normalize_title("x"), "Été à Paris") == "t paris"


def test_fingerprint_sorts_unique_words(spark):
    assert one(spark, T.fingerprint("x"), "Tesla buys Twitter!") == "buys tesla twitter"
    assert one(spark, T.fingerprint("x"), "twitter TESLA buys, buys") == "buys tesla twitter"
    assert one(spark, T.fingerprint("x"), "Café déjà vu") == "cafe deja vu"


def test_bigrams_and_dice_set_semantics(spark):
    df = spark.createDataFrame([("aaaa", "aaa"), ("", ""), ("a", "b"), ("night", "nacht")], "a string, b string")
    out = df.select(T.dice("a", "b", T.bigrams(F.col("a")), T.bigrams(F.col("b"))).alias("d")).collect()
    assert [r["d"] for r in out] == [1.0, 1.0, 0.0, 0.25]


def test_canonical_url(spark):
    cases = {
        "https://Example.com/a/": "https://example.com/a",
        "https://example.com/a": "https://example.com/a",
        "https://example.com": "https://example.com",
        "https://example.com/": "https://example.com",
        "http://user:pw@example.com:80/x?q=1#f": "http://example.com/x",
        "https://example.com:8443/x//": "https://example.com:8443/x/",
        "mailto:someone": "mailto:someone",
        "not a url": "not a url",
        "": "",
    }
    for raw, want in cases.items():
        assert one(spark, U.canonical_url(F.col("x")), raw) == want, raw


def test_canonical_url_default_mode_keeps_empty_urls_apart(spark):
    df = spark.createDataFrame([("", 1), ("", 2)], "x string, o bigint")
    keys = [r["k"] for r in df.select(U.canonical_url(F.col("x"), strict=False, fallback_key=F.col("o")).alias("k")).collect()]
    assert len(set(keys)) == 2


def test_resolve_url(spark):
    df = spark.createDataFrame(
        [("/a", "https://h.example/x/y?q"), ("b", "https://h.example/x/y"), ("https://o/z", "https://h.example/"), (None, "https://h.example/p")],
        "h string, b string")
    got = [r["r"] for r in df.select(U.resolve_url("h", "b").alias("r")).collect()]
    assert got == ["https://h.example/a", "https://h.example/x/b", "https://o/z", "https://h.example/p"]


def test_blend_uses_double_rounding(spark):
    df = spark.createDataFrame([(45.0, 0.0), (85.0, 0.0), (100.0, 100.0), (10.0, None)], "a double, b double")
    got = [r["r"] for r in df.select(S.blend("a", "b").alias("r")).collect()]
    assert got == [31, 59, 100, 7]


def test_layer1_has_no_upper_cap(spark):
    df = spark.createDataFrame([(250.0, 10.0), (5.0, 30.0)], "p double, n double")
    assert [r["r"] for r in df.select(S.layer1("p", "n").alias("r")).collect()] == [240.0, 0.0]


def test_parse_instant_iso_rfc822_and_garbage(spark):
    df = spark.createDataFrame(
        [("2024-01-02T03:04:05.000Z",), ("Tue, 02 Jan 2024 03:04:05 GMT",), ("2024-01-02T05:04:05+02:00",), ("garbage",), ("",)], "x string")
    got = [r["r"] for r in df.select(D.to_iso(D.parse_instant("x")).alias("r")).collect()]
    assert got == ["2024-01-02T03:04:05.000Z"] * 3 + [None, None]


def test_heuristic_category_order(spark):
    df = spark.createDataFrame([("New research paper",), ("SDK release",), ("Tool for lawyers",), ("Nothing",)], "x string")
    got = [r["r"] for r in df.select(T.heuristic_category("x").alias("r")).collect()]
    assert got == ["Research", "Model Release", "Tool/SDK", "Uncategorized"]


def test_recover_analysis(spark):
    df = spark.createDataFrame([("**Summary:** It works.\n**Category:** Tool/SDK.",), ("category: *Policy*",), ("nothing",)], "x string")
    got = [r["r"] for r in df.select(T.recover_analysis("x").alias("r")).collect()]
    assert got[0]["summary"] == "It works." and got[0]["category"] == "Tool/SDK"
    assert got[1]["summary"] is None and got[1]["category"] == "Policy"
    assert got[2] is None


def test_epoch_seconds_to_iso(spark):
    assert one(spark, D.epoch_seconds_to_iso(F.col("x")), 1700000000.5, "x double") == "2023-11-14T22:13:20.500Z"
