"""Binding of the driver's test tables to the digest data model.

Every derived table is computed by Spark from the given parquet tables, so its
size grows with them.  The same derivations are written in DuckDB SQL in
``digestry.plans.sqlgen``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from digestry.functions import dates, text
from digestry.session import rewritten, spread

# ---------------------------------------------------------------------------
# Fixed values of the test binding.
# Publication instant of document d: EPOCH_START + d hours.
EPOCH_START = "2024-01-01 00:00:00"
# Scoring dictionary (positive weights); also the coverage dictionary of F5.
SIGNAL_KEYWORDS = {
    "thble": 25, "ering": 20, "thing": 20, "attion": 30, "nicht": 40, "ment": 15, "quea": 20,
    "oreda": 30, "ient": 25, "gata": 25, "jaqu": 25, "estin": 20, "ness": 15, "para": 10,
    "aire": 15, "ça": 10, "ñ": 5, "ción": 10, "eaux": 10, "los": 5, "die": 5, "ung": 10,
    "lich": 10, "sch": 5, "ber": 5, "whst": 15, "mente": 10, "eau": 5, "ich": 5, "que": 5,
    "nter": 10, "ouen": 10, "heer": 10, "ndre": 10, "ous": 5, "und": 5, "oui": 10, "ier": 5,
    "ation": 10, "anen": 10, "ndt": 10, "erth": 10,
}
# Negative dictionary (weights are subtracted).
NEGATIVE_KEYWORDS = {"schen": 15, "edble": 10, "license": 20, "idiot": 25, "pathetic": 25}
# Custom overlay for U3: a new keyword, a re-weighted one, a muted one, and an
# upper-case key that the case-sensitive merge keeps next to its lower-case twin.
CUSTOM_KEYWORDS = {"thorre": 35, "ment": 30, "ier": 0, "THING": 12}
# Model score of a labelled document: quality * 80 unless toxic.
MODEL_SCORE_PER_QUALITY = 80
# Run instant used by the registered queries ("now" is always a parameter).
AS_OF = "2025-02-01 12:00:00"
# ---------------------------------------------------------------------------

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def doc_title(text_col: Column) -> Column:
    """The whole first sentence (up to the first full stop)."""
    return F.split_part(text_col, F.lit("."), F.lit(1))


def doc_content(text_col: Column) -> Column:
    """The text after the first sentence; empty when there is only that one."""
    return F.substring(text_col, F.length(doc_title(text_col)) + 2, F.length(text_col))


def published_ts(doc_id: Column) -> Column:
    return F.timestamp_seconds(F.unix_timestamp(F.to_timestamp(F.lit(EPOCH_START))) + doc_id.cast("bigint") * 3600)


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents -> scraped-article rows (id, title, url, source, content,
    published_at, published_ts, ord, lang)."""
    return articles_from_documents(spread(table(spark, sf_dir, "documents")))


def articles_from_documents(d: DataFrame, *keep: str) -> DataFrame:
    """The article projection of a documents DataFrame (batch or streaming), and its columns ``keep``."""
    title = doc_title(F.col("text"))
    url = F.concat(
        F.lit("https://"), F.col("source"), F.lit(".example/"),
        F.md5(text.normalize_title(title)), F.lit("?d="), F.col("doc_id").cast("string"),
    )
    ts = published_ts(F.col("doc_id"))
    return d.select(
        F.col("doc_id").cast("string").alias("id"),
        title.alias("title"),
        url.alias("url"),
        F.col("source"),
        doc_content(F.col("text")).alias("content"),
        dates.to_iso(ts).alias("published_at"),
        ts.alias("published_ts"),
        F.col("doc_id").cast("bigint").alias("ord"),
        F.col("lang"),
        *keep,
    )


def keyword_table(spark: SparkSession, weights: dict[str, int]) -> DataFrame:
    """A dictionary as a small dimension DataFrame (keyword, weight)."""
    return spark.createDataFrame([(k, float(v)) for k, v in sorted(weights.items())], "keyword string, weight double")


def model_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """labels -> precomputed model scores (id, model_score)."""
    lab = table(spark, sf_dir, "labels")
    score = F.when(F.col("toxic") == 0, F.col("quality") * F.lit(MODEL_SCORE_PER_QUALITY)).otherwise(F.lit(0))
    return lab.select(F.col("doc_id").cast("string").alias("id"), score.cast("double").alias("model_score"))


def health_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events -> source-health log (id, source, status, items_found, error_message, last_check)."""
    ev = table(spark, sf_dir, "events")
    err = F.col("event_type") == "error"
    return ev.select(
        F.col("event_id").alias("id"),
        F.concat(F.lit("src"), F.col("user_id").cast("string")).alias("source"),
        F.when(err, F.lit("error")).otherwise(F.lit("ok")).alias("status"),
        F.when(err, F.lit(0)).otherwise(F.floor(F.col("value")).cast("int")).alias("items_found"),
        F.when(err, F.concat(F.lit("fetch failed: "), F.col("props"))).alias("error_message"),
        F.col("ts").cast("timestamp").alias("last_check"),
    )


# ---------------------------------------------------------------------------
# Fixed values of the stored state of a previous run (derived from `labels`).
PREVIOUS_DIGEST_DATE = "2024-01-20"
STORED_SCORE_CLEAN = 70  # score of a stored, non-toxic labelled document
STORED_SCORE_TOXIC = 30
# ---------------------------------------------------------------------------


def stored_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The article table of a previous run: every labelled document.

    published_at is unknown (null), so the high-water mark falls back to the
    digest date; documents of quality 1 were already delivered.
    """
    arts = articles(spark, sf_dir)
    lab = table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("id"), "quality", "toxic")
    j = arts.join(lab, "id")
    return j.select(
        "id", "title", "url", "source",
        F.nullif(F.col("content"), F.lit("")).alias("content"),
        F.concat(F.lit("quality="), F.col("quality").cast("string"), F.lit(", toxic="), F.col("toxic").cast("string")).alias("summary"),
        text.heuristic_category(F.col("title")).alias("category"),
        F.lit(None).cast("string").alias("published_at"),
        F.when(F.col("toxic") == 0, F.lit(STORED_SCORE_CLEAN)).otherwise(F.lit(STORED_SCORE_TOXIC)).cast("bigint").alias("score"),
        F.lit(PREVIOUS_DIGEST_DATE).alias("digest_date"),
        F.col("quality").cast("int").alias("delivered"),
        "lang",
    )


def analyses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precomputed model analyses (id, summary, category) for labelled documents.

    Toxic documents get an empty category (falsy -> Uncategorized in J4);
    unlabelled documents have no analysis (fallback: S17).
    """
    lab = table(spark, sf_dir, "labels")
    return lab.select(
        F.col("doc_id").cast("string").alias("id"),
        F.concat(F.lit("quality="), F.col("quality").cast("string"), F.lit(", toxic="), F.col("toxic").cast("string")).alias("summary"),
        F.when(F.col("toxic") == 1, F.lit("")).otherwise(F.lit("Research")).alias("category"),
    )


# ---------------------------------------------------------------------------
# Fixed values of the payload binding: one registry source per (source, lang)
# of `documents`, a payload format per language, at most PAGE_ITEMS items per
# payload; `hn` from `benchmark`, `github_trending` from `conversations`,
# one scrape source per row of `pages`.
PAGE_ITEMS = 20
LANG_FEEDS = {  # lang -> (id prefix, declared type)
    "en": ("rss-", "rss"),
    "fr": ("arxiv-", "rss"),
    "de": ("reddit-", "json"),
    "es": ("json-", "json"),
}
JSON_MAPPING = {"items": "results", "title": "heading", "url": "link", "content": "desc", "published_at": "date"}
ATOM_NS = "http://www.w3.org/2005/Atom"
RFC822_OUT = "EEE, dd MMM yyyy HH:mm:ss"
# Languages without an entry above are RSS feeds of their own, RSS_PREFIX-<lang>-<source>.
RSS_PREFIX = "rss-"
# ---------------------------------------------------------------------------


def _feed_id(lang: Column, source: Column) -> Column:
    expr = F
    for lg, (prefix, _) in LANG_FEEDS.items():
        expr = expr.when(lang == lg, F.concat(F.lit(prefix), source))
    return expr.otherwise(F.concat(F.lit(RSS_PREFIX), F.coalesce(lang, F.lit("none")), F.lit("-"), source))


def _feed_type(lang: Column) -> Column:
    expr = F
    for lg, (_, typ) in LANG_FEEDS.items():
        expr = expr.when(lang == lg, F.lit(typ))
    return expr.otherwise(F.lit("rss"))


def feed_url(source: Column, lang: Column) -> Column:
    return F.concat(F.lit("https://"), source, F.lit(".example/"), lang, F.lit("/feed"))


def registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source registry rows (REGISTRY_SCHEMA) derived from the test tables."""
    d = table(spark, sf_dir, "documents").select("source", "lang").distinct()
    mapping = F.create_map(*[x for k, v in JSON_MAPPING.items() for x in (F.lit(k), F.lit(v))])
    feeds = d.select(
        _feed_id(F.col("lang"), F.col("source")).alias("id"),
        F.concat(F.col("source"), F.lit(" ("), F.col("lang"), F.lit(")")).alias("name"),
        _feed_type(F.col("lang")).alias("type"),
        feed_url(F.col("source"), F.col("lang")).alias("url"),
        F.lit(1).alias("tier"), F.array(F.col("lang")).alias("tags"),
        F.lit(None).cast("string").alias("selector"),
        F.when(F.col("lang") == "es", mapping).alias("mapping"),
    )
    pages = table(spark, sf_dir, "pages").select(
        F.concat(F.lit("page-"), F.col("page_id").cast("string")).alias("id"), F.col("url").alias("name"),
        F.lit("scrape").alias("type"), F.col("url"), F.lit(2).alias("tier"), F.array(F.lit("web")).alias("tags"),
        F.lit("li").alias("selector"), F.create_map(F.lit("title"), F.lit("a"), F.lit("url"), F.lit("a")).alias("mapping"),
    )
    ev = table(spark, sf_dir, "events").select("event_type").distinct()
    events_json = ev.select(
        F.concat(F.lit("evt-"), F.col("event_type")).alias("id"), F.col("event_type").alias("name"), F.lit("json").alias("type"),
        F.concat(F.lit("https://events.example/"), F.col("event_type")).alias("url"), F.lit(3).alias("tier"),
        F.array(F.lit("events")).alias("tags"), F.lit(None).cast("string").alias("selector"),
        F.create_map(F.lit("title"), F.lit("k")).alias("mapping"))
    events_api = ev.select(
        F.concat(F.lit("api-"), F.col("event_type")).alias("id"), F.col("event_type").alias("name"), F.lit("api").alias("type"),
        F.concat(F.lit("https://events.example/api/"), F.col("event_type")).alias("url"), F.lit(3).alias("tier"),
        F.array(F.lit("events")).alias("tags"), F.lit(None).cast("string").alias("selector"),
        F.lit(None).cast("map<string,string>").alias("mapping"))
    fixed = spark.createDataFrame(
        [("hn", "News API", "api", "https://hn.example/api/search", 1, ["news"], None, None),
         ("github_trending", "Trending", "scrape", "https://github.com/trending", 1, ["code"], None, None)],
        "id string, name string, type string, url string, tier int, tags array<string>, selector string, mapping map<string,string>")
    # a small dimension table read by several branches: written once, in as few files as it needs
    return rewritten(feeds.unionByName(pages).unionByName(events_json).unionByName(events_api).unionByName(fixed))


def xml_escape(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def _pages_of(items: DataFrame, key_cols: list[str], pos_col: str, body: Column, payload) -> DataFrame:
    """Group items into payload pages of at most PAGE_ITEMS consecutive rows; ``payload`` makes one of the bodies in order.

    ``items`` are dealt out by ``key_cols`` before, as they are read: bodies are then made and grouped in the tasks of that
    shuffle, not in those of the scan, which has one per row group, whatever its size."""
    grouped = items.groupBy(*key_cols).agg(
        F.array_sort(F.collect_list(F.struct(F.col(pos_col).alias("_k"), body.alias("_b")))).alias("_items"))
    return grouped.select(*key_cols, payload(F.transform("_items", lambda x: x["_b"])).alias("payload"))


def _framed(head: str, tail: str, sep: str = ""):
    """Bodies joined by ``sep`` between ``head`` and ``tail``."""
    return lambda bodies: F.concat(F.lit(head), F.array_join(bodies, sep), F.lit(tail))


def payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raw payload table (source_id, page, fetched_at, payload).

    A deployment reads its payload table from storage; the binding writes the derived one once, as Parquet, so every
    reader reads it back."""
    return rewritten(raw_payloads(spark, sf_dir))


def raw_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``payloads`` as they are made, for a reader that reads them once.

    Documents are read, projected and grouped in one pass, whatever the format of their language's feed."""
    d = table(spark, sf_dir, "documents")
    lang = F.col("lang")
    fmt = F.when(lang == "fr", F.lit("atom")).when(lang == "de", F.lit("reddit")).when(lang == "es", F.lit("mapped")).otherwise(F.lit("rss"))
    d = d.withColumn("source_id", _feed_id(lang, F.col("source"))).withColumn(
        "page", F.floor(F.col("doc_id").cast("bigint") / F.lit(PAGE_ITEMS)).cast("bigint")).withColumn("format", fmt)
    keys = ["source_id", "page"]
    a = articles_from_documents(d.repartition(*keys, "format"), *keys, "format")
    rss_item = F.concat(
        F.lit("<item><guid>"), xml_escape(F.col("url")), F.lit("</guid><title>"), xml_escape(F.col("title")),
        F.lit("</title><link>"), xml_escape(F.col("url")), F.lit("</link><description>"), xml_escape(F.col("content")),
        F.lit("</description><pubDate>"), F.date_format(F.col("published_ts"), RFC822_OUT), F.lit(" GMT</pubDate></item>"))
    entry = F.concat(
        F.lit("<entry><id>"), xml_escape(F.col("url")), F.lit("</id><title>"), xml_escape(F.col("title")),
        F.lit("</title><summary>"), xml_escape(F.col("content")), F.lit("</summary><published>"), F.col("published_at"),
        F.lit("</published></entry>"))
    child = F.to_json(F.struct(F.struct(
        F.concat(F.lit("t3_"), F.col("id")).alias("name"), F.col("title"),
        F.concat(F.lit("/r/"), F.col("source"), F.lit("/comments/"), F.col("id")).alias("url"),
        F.col("content").alias("selftext"),
        (F.unix_micros(F.col("published_ts")) / F.lit(1_000_000)).cast("double").alias("created_utc")).alias("data")))
    res = F.to_json(F.struct(F.col("title").alias("heading"), F.col("url").alias("link"), F.col("content").alias("desc"),
                             F.col("published_at").alias("date")))
    formats = {
        "rss": (rss_item, _framed('<?xml version="1.0"?><rss version="2.0"><channel><title>feed</title>', "</channel></rss>")),
        "atom": (entry, _framed(f'<?xml version="1.0"?><feed xmlns="{ATOM_NS}"><title>feed</title>', "</feed>")),
        "reddit": (child, _framed('{"kind":"Listing","data":{"children":[', "]}}", ",")),
        "mapped": (res, _framed('{"results":[', "]}", ",")),
    }

    def by_format(of) -> Column:
        out = F
        for name, spec in formats.items():
            out = out.when(F.col("format") == name, of(*spec))
        return out

    feeds = _pages_of(a, [*keys, "format"], "ord", by_format(lambda body, _: body),
                      lambda bodies: by_format(lambda _, framed: framed(bodies))).drop("format")
    bench = table(spark, sf_dir, "benchmark").select(
        F.lit("hn").alias("source_id"), F.floor(F.col("item_id") / F.lit(PAGE_ITEMS)).cast("bigint").alias("page"),
        F.col("item_id"),
        F.to_json(F.struct(
            F.col("item_id").cast("string").alias("objectID"), doc_title(F.col("text")).alias("title"),
            F.lit(None).cast("string").alias("url"), F.col("text").alias("story_text"),
            dates.to_iso(published_ts(F.col("item_id"))).alias("created_at"))).alias("hit"))
    hn = _pages_of(bench, keys, "item_id", F.col("hit"), _framed('{"hits":[', "]}", ","))
    turns = table(spark, sf_dir, "conversations")
    # as many page numbers per conversation as its longest one needs: none collide
    room = turns.agg(F.coalesce(F.floor(F.max("turn") / F.lit(PAGE_ITEMS)) + 1, F.lit(1))).first()[0]
    conv = turns.withColumn("page", (F.col("conv_id") * F.lit(room) + F.floor(F.col("turn") / F.lit(PAGE_ITEMS))).cast("bigint"))
    conv = conv.repartition("page").select(
        F.lit("github_trending").alias("source_id"), "page", "turn",
        F.concat(F.lit('<article class="Box-row"><h2 class="h3 lh-condensed"><a href="/'), F.col("role"), F.lit("/c"),
                 F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string"), F.lit('">\n  '), F.col("role"),
                 F.lit(" /\n  c"), F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string"),
                 F.lit('\n</a></h2><p class="col-9">'), xml_escape(F.col("text")), F.lit("</p></article>")).alias("block"))
    trending = _pages_of(conv, keys, "turn", F.col("block"), _framed("<html><body>", "</body></html>"))
    pages = spread(table(spark, sf_dir, "pages")).select(
        F.concat(F.lit("page-"), F.col("page_id").cast("string")).alias("source_id"), F.lit(0).cast("bigint").alias("page"),
        F.col("html").alias("payload"))
    ev = table(spark, sf_dir, "events").select(
        "event_type", "event_id", F.floor(F.col("event_id") / F.lit(PAGE_ITEMS)).cast("bigint").alias("page"), "props")
    ev_pages = _pages_of(ev.repartition("event_type", "page"), ["event_type", "page"], "event_id", F.col("props"), _framed("[", "]", ","))
    # each page of events comes twice, as a JSON feed's payload and as an API's
    both = F.explode(F.array(F.lit("evt-"), F.lit("api-"))).alias("_prefix")
    ev_pages = ev_pages.select("event_type", "page", "payload", both).select(F.concat("_prefix", "event_type").alias("source_id"), "page", "payload")
    out = feeds.unionByName(hn).unionByName(trending).unionByName(pages).unionByName(ev_pages)
    return out.withColumn("fetched_at", F.to_timestamp(F.lit(AS_OF)))


# ---------------------------------------------------------------------------
# Subscriptions and delivery channels derived from the tables.
SUBS_AS_OF = "2024-01-30 12:00:00"
# ---------------------------------------------------------------------------


def language_subscriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One subscription per language of `documents`, with `lang`: every 24 hours, else that of the first user dealt to it (users in turn, by id)."""
    langs = table(spark, sf_dir, "documents").where("lang IS NOT NULL").select("lang").distinct()
    langs = langs.withColumn("_k", F.row_number().over(Window.orderBy("lang")) - 1)  # one row per language
    subs = subscriptions(spark, sf_dir)
    user = F.substring("id", 5, 20).cast("long")
    k = F.pmod(user, F.lit(max(1, langs.count()))).alias("_k")
    first = subs.groupBy(k).agg(F.min_by(F.struct(*subs.columns), user).alias("_s"))
    own = langs.join(first, "_k").select("lang", "_s.*")
    return own.withColumn("cron", F.lit("hourly")).withColumn("scheduled_time", F.lit(None).cast("string"))


def subscriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One subscription per user of `events`: daily when the user signed up
    (else hourly); the time is the first event's value read as 'H.mm'; inactive
    when the latest event is an error; last run = latest purchase (or never)."""
    ev = table(spark, sf_dir, "events")
    agg = ev.groupBy("user_id").agg(
        F.count_if(F.col("event_type") == "signup").alias("_signups"),
        F.min_by("value", F.struct("ts", "event_id")).alias("_first_value"),
        F.max_by("event_type", F.struct("ts", "event_id")).alias("_last_type"),
        F.max(F.when(F.col("event_type") == "purchase", F.col("ts"))).alias("_last_purchase"),
    )
    return agg.select(
        F.concat(F.lit("sub-"), F.col("user_id").cast("string")).alias("id"),
        F.concat(F.lit("user "), F.col("user_id").cast("string")).alias("name"),
        F.when(F.col("_signups") > 0, F.lit("daily")).otherwise(F.lit("hourly")).alias("cron"),
        F.replace(F.col("_first_value").cast("string"), F.lit("."), F.lit(":")).alias("scheduled_time"),
        F.when(F.col("_last_type") == "error", F.lit(0)).otherwise(F.lit(1)).alias("active"),
        dates.to_iso(F.col("_last_purchase").cast("timestamp")).alias("last_run"),
    )


def channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Delivery channels: every page as a webhook (its url), each of its links as a
    chat hook (often relative), and one unset hook."""
    p = table(spark, sf_dir, "pages")
    hook = lambda kind, url: F.struct(F.lit(kind).alias("type"), url.alias("webhook_url"))
    links = F.transform(F.regexp_extract_all("html", F.lit(r'href="([^"]*)"'), 1), lambda u: hook("slack", u))
    hooks = F.concat(F.array(hook("webhook", F.col("url"))), F.coalesce(links, F.array().cast("array<struct<type:string,webhook_url:string>>")),
                     F.array(hook("webhook", F.lit(None).cast("string"))))
    ex = p.select("page_id", F.posexplode(hooks).alias("_k", "_c"))
    room = ex.agg(F.coalesce(F.max("_k") + 1, F.lit(1))).first()[0]
    return ex.select((F.col("page_id") * F.lit(room) + F.col("_k")).cast("bigint").alias("idx"), "_c.type", "_c.webhook_url")


def href_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registry entries proposed from page links (F9 input): absolute links
    become scrape sources, relative ones have no type."""
    p = table(spark, sf_dir, "pages")
    ex = p.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(r'<a href="([^"]*)">([^<]*)</a>'), 1)).alias("pos", "url"),
                  F.regexp_extract_all("html", F.lit(r'<a href="([^"]*)">([^<]*)</a>'), 2).alias("_names"))
    room = ex.agg(F.coalesce(F.max("pos") + 1, F.lit(1))).first()[0]
    return ex.select(
        (F.col("page_id") * F.lit(room) + F.col("pos")).cast("bigint").alias("idx"),
        F.element_at("_names", (F.col("pos") + 1).cast("int")).alias("name"),
        F.when(F.col("url").startswith("http"), F.lit("scrape")).alias("type"),
        "url",
    )
