"""Sources: registry (A1, A2) and payload parsing.

Ingestion starts from a raw payload table ``(source_id, page, fetched_at,
payload)``: one row per fetched document.  Parsing is a distributed job
over that table; each parser is a projection plus ``posexplode`` and never
groups rows, so a source with a third of all payloads costs a third of the
tasks, not one task.

Failures never fail the job: every parse uses a ``try``/permissive function
and a failed payload becomes an error envelope with no items (A11).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from digestry.functions import dates as D
from digestry.functions import text as T
from digestry.functions import urls as U
from digestry.session import PLAIN_TEXTS, checked_broadcast, rewritten
from digestry.sources import html_select as H

# ---------------------------------------------------------------------------
# Fixed values.
SOURCE_TYPES = ("rss", "api", "scrape", "json")
NEWS_API_ITEM_URL = "https://news.ycombinator.com/item?id="
REDDIT_HOST = "https://reddit.com"
TRENDING_HOST = "https://github.com"
MSG_NO_PARSER = "No scraper found for type: "
MSG_UNSUPPORTED_API = "Unsupported API source"
MSG_UNSUPPORTED_JSON = "Unsupported JSON source or missing mapping"
MSG_UNSUPPORTED_SCRAPE = "Unsupported scraping source or missing mapping"
MSG_PARSE_FAILED = "payload could not be parsed"
# ---------------------------------------------------------------------------

REGISTRY_SCHEMA = (
    "id string, name string, type string, url string, tier int, tags array<string>, "
    "selector string, mapping map<string,string>"
)
_RSS_ITEM = "guid: string, title: string, link: string, description: string, `content:encoded`: string, pubDate: string, `dc:date`: string"
RSS_SCHEMA = f"channel struct<item: array<struct<{_RSS_ITEM}>>>"
RDF_SCHEMA = f"item array<struct<{_RSS_ITEM}>>"
ATOM_FEED_SCHEMA = (
    "entry array<struct<id: string, title: string, link: array<struct<_href: string, _rel: string>>, summary: string, "
    "content: string, published: string, updated: string>>"
)
ATOM_SCHEMA = "entry array<struct<id: string, title: string, summary: string, published: string>>"
NEWS_API_SCHEMA = "struct<hits: array<struct<objectID: string, title: string, url: string, story_text: string, created_at: string>>>"
REDDIT_SCHEMA = (
    "struct<data: struct<children: array<struct<data: struct<name: string, title: string, url: string, "
    "selftext: string, created_utc: double>>>>>"
)
ITEM_COLUMNS = ["source", "page", "item_pos", "id", "title", "url", "content", "published_at"]
# Registries up to this many sources are broadcast to the payload join.
MAX_BROADCAST_SOURCES = 1 << 20


def encounter_ord(source: Column, page: Column, item_pos: Column) -> Column:
    """The encounter position as a struct that sorts by source, page and
    position in the payload (nothing is packed, so any of them may be large)."""
    return F.struct(source.alias("source"), page.cast("bigint").alias("page"), item_pos.cast("bigint").alias("item_pos"))


# --------------------------------------------------------------------------- A1, A2


def read_registry(spark: SparkSession, path: str, multiline: bool = True) -> DataFrame:
    """A1: the source registry with a fixed schema: a JSON array file
    (``multiline=True``, the reference's format) or JSON lines."""
    return spark.read.schema(REGISTRY_SCHEMA).option("multiLine", multiline).json(path)


def route(registry: DataFrame) -> DataFrame:
    """A2: parser per source: by id first, then by type; else no parser."""
    i = F.col("id")
    parser = (
        F.when(i == "hn", F.lit("api"))
        .when(i == "github_trending", F.lit("scrape"))
        .when(i.startswith("arxiv"), F.lit("arxiv"))
        .when(i.startswith("reddit"), F.lit("json"))
        .when(F.col("type").isin(*SOURCE_TYPES), F.col("type"))
    )
    return registry.withColumn("parser", parser).withColumn(
        "route_error", F.when(parser.isNull(), F.concat(F.lit(MSG_NO_PARSER), F.coalesce(F.col("type"), F.lit("undefined"))))
    )


# --------------------------------------------------------------------------- helpers


def _where(c: Column, asks, change) -> Column:
    """``change`` of the texts that need it; others stay as they are.  The text is computed once."""
    return F.get(F.transform(F.array(c), lambda x: F.when(asks(x), change(x)).otherwise(x)), F.lit(0))


# What a text that needs trimming starts or ends with: white space, or a line end that `$` looks past.
_ENDS = tuple(" \t\n\x0b\f\r\x85\u2028\u2029")


def js_trim(c: Column) -> Column:
    """String.prototype.trim: strip leading and trailing whitespace (not only spaces)."""
    return _where(c, lambda x: F.left(x, F.lit(1)).isin(*_ENDS) | F.right(x, F.lit(1)).isin(*_ENDS), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))


def strip_tags(c: Column) -> Column:
    return _where(c, lambda x: F.contains(x, F.lit("<")), lambda x: F.regexp_replace(x, r"<[^>]*>", ""))


def html_unescape(c: Column) -> Column:
    """The five predefined entities, &nbsp; and numeric references."""

    def unescaped(x: Column) -> Column:
        out = numeric_unescape(x)
        for ent, ch in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&nbsp;", " "), ("&amp;", "&")):
            out = F.replace(out, F.lit(ent), F.lit(ch))
        return out

    return _where(c, lambda x: F.contains(x, F.lit("&")), unescaped)


def numeric_unescape(c: Column) -> Column:
    """``&#233;`` and ``&#xE9;`` as characters; what isn't one stays as it is."""

    def piece(p: Column, i: Column) -> Column:
        digits = F.regexp_extract(p, r"^(x[0-9A-Fa-f]{1,6}|[0-9]{1,7});", 1)
        code = F.when(digits.startswith("x"), F.conv(F.substring(digits, 2, 6), 16, 10)).otherwise(digits).try_cast("int")
        valid = code.between(1, 0xD7FF) | code.between(0xE000, 0x10FFFF)
        char = F.decode(F.unhex(F.lpad(F.hex(code.cast("long")), 8, "0")), "UTF-32")
        decoded = F.concat(char, F.substring(p, F.length(digits) + 2, F.length(p)))
        return F.when(i == 0, p).when(F.coalesce(valid, F.lit(False)), decoded).otherwise(F.concat(F.lit("&#"), p))

    return F.array_join(F.transform(F.split(c, "&#"), piece), "")


def root_element(payload: Column) -> Column:
    """Local name of an XML payload's root element; '' when there is none."""
    return F.regexp_extract(payload, r"(?s)^\s*(?:(?:<\?.*?\?>|<!--.*?-->|<![A-Za-z][^>]*>)\s*)*<(?:[\w.-]+:)?([A-Za-z][\w.-]*)", 1)


def _items(df: DataFrame, arr: Column, fields) -> DataFrame:
    """posexplode an item array; ``fields(x)`` maps one element to the item columns."""
    ex = df.select("source", "page", "source_url", F.posexplode_outer(arr).alias("item_pos", "_x"))
    ex = ex.where(F.col("_x").isNotNull())
    cols = fields(F.col("_x"))
    return ex.select("source", "page", "item_pos", *[cols[c].alias(c) for c in ITEM_COLUMNS[3:]])


def _envelope(df: DataFrame, ok: Column, error: Column | None = None) -> DataFrame:
    return df.select("source", "page", F.when(ok, F.lit("ok")).otherwise(F.lit("error")).alias("status"),
                     F.when(ok, F.lit(None).cast("string")).otherwise(error if error is not None else F.lit(MSG_PARSE_FAILED)).alias("error"))


# --------------------------------------------------------------------------- A3 RSS


def parse_rss(payloads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A3: feed items, RSS, RDF or Atom by the payload's root element.

    id = guid, else link, else 'source-title'; title else 'No Title'; url =
    link else ''; content = text snippet of the description (encoded content
    where there is none; an Atom entry's content, else its summary) else '';
    published_at = ISO form of the date, else the date as given."""
    root = root_element(F.col("payload"))
    is_rss, is_rdf, is_atom = root == "rss", root == "RDF", root == "feed"

    def doc(schema: str, when: Column) -> Column:
        return F.when(when, F.from_xml("payload", schema, {"mode": "PERMISSIVE"}))

    p = payloads.withColumn("_rss", doc(RSS_SCHEMA, is_rss)).withColumn("_rdf", doc(RDF_SCHEMA, is_rdf)).withColumn("_atom", doc(ATOM_FEED_SCHEMA, is_atom))

    def from_item(x):
        text = T.falsy_or(x["description"], x["content:encoded"])
        return F.struct(x["guid"].alias("guid"), x["title"].alias("title"), x["link"].alias("link"), text.alias("text"),
                        T.falsy_or(x["pubDate"], x["dc:date"]).alias("date"))

    def from_entry(x):
        rank = F.filter(x["link"], lambda m: F.coalesce(m["_rel"], F.lit("alternate")) == "alternate")
        link = F.coalesce(F.get(rank, F.lit(0))["_href"], F.get(x["link"], F.lit(0))["_href"])
        return F.struct(F.lit(None).cast("string").alias("guid"), js_trim(x["title"]).alias("title"), link.alias("link"),
                        T.falsy_or(x["content"], x["summary"]).alias("text"), T.falsy_or(x["published"], x["updated"]).alias("date"))

    rows = F.coalesce(F.transform("_rss.channel.item", from_item), F.transform("_rdf.item", from_item), F.transform("_atom.entry", from_entry))
    p = p.withColumn("_rows", rows)
    ok = F.coalesce((is_rss & F.col("_rss.channel").isNotNull()) | (is_rdf & F.col("_rdf").isNotNull()) | (is_atom & F.col("_atom").isNotNull()), F.lit(False))

    def fields(x):
        snippet = js_trim(html_unescape(strip_tags(F.coalesce(x["text"], F.lit("")))))
        iso = D.to_iso(D.parse_instant(x["date"]))
        return {
            "id": T.falsy_or(x["guid"], T.falsy_or(x["link"], F.concat(F.col("source"), F.lit("-"), F.coalesce(x["title"], F.lit("undefined"))))),
            "title": T.falsy_or(x["title"], F.lit(T.NO_TITLE)),
            "url": T.falsy_or(x["link"], F.lit("")),
            "content": T.falsy_or(snippet, F.coalesce(x["text"], F.lit(""))),
            "published_at": F.coalesce(iso, x["date"]),
        }

    # a payload that isn't ok has no rows; a filter on ok would parse each payload twice
    return _items(p, F.col("_rows"), fields), _envelope(p, ok)


# --------------------------------------------------------------------------- A4 Atom


def parse_atom(payloads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A4: Atom entries; id = url = entry id; title and summary trimmed with
    whitespace collapsed; published as text.  The default namespace is ignored."""
    p = payloads.withColumn("_doc", F.from_xml("payload", ATOM_SCHEMA, {"mode": "PERMISSIVE"}))
    ok = F.col("_doc").isNotNull()

    def fields(x):
        u = js_trim(F.coalesce(x["id"], F.lit("")))
        return {
            "id": u, "title": T.collapse_ws(F.coalesce(x["title"], F.lit(""))), "url": u,
            "content": T.collapse_ws(F.coalesce(x["summary"], F.lit(""))),
            "published_at": js_trim(F.coalesce(x["published"], F.lit(""))),
        }

    return _items(p, F.col("_doc.entry"), fields), _envelope(p, ok)


# --------------------------------------------------------------------------- A5 news API


def parse_news_api(payloads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A5: ``hits[]`` of the 'hn' source; other api sources are an error."""
    is_hn = F.col("source") == "hn"
    p = payloads.withColumn("_doc", F.when(is_hn, F.from_json("payload", NEWS_API_SCHEMA)))
    ok = is_hn & F.col("_doc.hits").isNotNull()
    err = F.when(~is_hn, F.lit(MSG_UNSUPPORTED_API)).otherwise(F.lit(MSG_PARSE_FAILED))

    def fields(x):
        return {
            "id": x["objectID"], "title": x["title"],
            "url": T.falsy_or(x["url"], F.concat(F.lit(NEWS_API_ITEM_URL), F.coalesce(x["objectID"], F.lit("undefined")))),
            "content": T.falsy_or(x["story_text"], F.lit("")), "published_at": x["created_at"],
        }

    return _items(p.where(is_hn), F.col("_doc.hits"), fields), _envelope(p, ok, err)


# --------------------------------------------------------------------------- A6 mapped JSON, A7 Reddit


def parse_json(payloads: DataFrame, as_of: str) -> tuple[DataFrame, DataFrame]:
    """A6 (a mapping is given) and A7 (no mapping, id starts with 'reddit').

    A6: the list is the payload itself when it is an array, else
    ``payload[mapping.items or 'items']``; per-field paths come from the
    mapping with defaults title/url/content/date; a payload whose list is not
    an array is ok with no items.  A payload is parsed once, into a variant; one that
    a variant can't hold gives an error envelope.  A7: ``data.children[].data``.
    """
    has_map = F.col("mapping").isNotNull()
    is_reddit = F.col("source").startswith("reddit")
    first = F.substring(F.ltrim(F.col("payload")), 1, 1)
    # one parse per mapped payload; the paths inside it come from each row's mapping
    p = payloads.withColumn("_json", F.when(has_map & first.isin("{", "["), F.try_parse_json("payload")))
    items_path = F.when(first == "[", F.lit("$")).otherwise(F.concat(F.lit("$."), F.coalesce(F.col("mapping")["items"], F.lit("items"))))
    p = p.withColumn("_list", F.try_variant_get("_json", items_path, "array<variant>")).withColumn("_valid", F.col("_json").isNotNull())
    p = p.withColumn("_reddit", F.when(~has_map & is_reddit, F.from_json("payload", REDDIT_SCHEMA)))
    ok = (has_map & F.col("_valid")) | (~has_map & is_reddit & F.col("_reddit.data.children").isNotNull())
    err = F.when(~has_map & ~is_reddit, F.lit(MSG_UNSUPPORTED_JSON)).otherwise(F.lit(MSG_PARSE_FAILED))
    now_iso = D.to_iso(D.as_of_literal(as_of))

    def mapped(x):
        def get(key, default):
            return F.try_variant_get(x, F.concat(F.lit("$."), F.coalesce(F.col("mapping")[key], F.lit(default))), "string")

        return {
            "id": T.falsy_or(F.try_variant_get(x, F.lit("$.id"), "string"),
                             F.concat(F.lit("json-"), F.col("source"), F.lit("-"), F.col("item_pos").cast("string"))),
            "title": T.falsy_or(get("title", "title"), F.lit(T.NO_TITLE)),
            "url": T.falsy_or(get("url", "url"), F.col("source_url")),
            "content": T.falsy_or(get("content", "content"), F.lit("")),
            "published_at": T.falsy_or(get("published_at", "date"), now_iso),
        }

    def reddit(x):
        post = x["data"]
        u = post["url"]
        return {
            "id": post["name"], "title": post["title"],
            "url": F.when(u.startswith("/"), F.concat(F.lit(REDDIT_HOST), u)).otherwise(u),
            "content": T.falsy_or(post["selftext"], F.lit("")),
            "published_at": D.epoch_seconds_to_iso(post["created_utc"]),
        }

    ex = p.where(has_map).select("source", "page", "source_url", "mapping", F.posexplode_outer("_list").alias("item_pos", "_x"))
    ex = ex.where(F.col("item_pos").isNotNull())
    m = mapped(F.col("_x"))
    mapped_items = ex.select("source", "page", "item_pos", *[m[c].alias(c) for c in ITEM_COLUMNS[3:]])
    reddit_items = _items(p.where(~has_map), F.col("_reddit.data.children"), reddit)
    return mapped_items.unionByName(reddit_items), _envelope(p, ok, err)


# --------------------------------------------------------------------------- A8, A9 HTML blocks


def parse_html_blocks(payloads: DataFrame, block_re: str, title_re: str | None, href_re: str | None,
                      content_re: str | None, collapse_title: bool = False, href_prefix: str | None = None) -> tuple[DataFrame, DataFrame]:
    """A8/A9, regular-expression form of a selector mapping.

    ``block_re`` captures one block per match (group 1); inside a block the
    first match of ``title_re`` / ``content_re`` gives the text (tags
    stripped, entities decoded, trimmed) and ``href_re`` the link.  Title
    else 'No Title'; url: href resolved on the source url (S7), else the
    source url; id = url; no published_at.  ``href_prefix`` (A9) prefixes the
    raw href instead of resolving it.
    """
    p = payloads.withColumn("_blocks", F.regexp_extract_all("payload", F.lit(block_re), 1))

    def text_of(block, rx):
        if rx is None:
            return F.lit("")
        return js_trim(html_unescape(strip_tags(F.regexp_extract(block, rx, 1))))

    def fields(b):
        title = text_of(b, title_re)
        if collapse_title:
            title = T.collapse_ws(title)
        href = F.regexp_extract(b, href_re, 1) if href_re else F.lit("")
        if href_prefix is not None:
            url = F.concat(F.lit(href_prefix), href)
        else:
            url = U.resolve_url(F.nullif(href, F.lit("")), F.col("source_url"))
        return {"id": url, "title": T.falsy_or(title, F.lit(T.NO_TITLE)) if href_prefix is None else title,
                "url": url, "content": text_of(b, content_re), "published_at": F.lit(None).cast("string")}

    return _items(p, F.col("_blocks"), fields), _envelope(p, F.col("payload").isNotNull())


def parse_html_selected(payloads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Blocks by each source's own ``selector`` and ``mapping`` (title, url, content).

    Selectors are those of ``html_select``; any other one, or a missing payload, gives an error envelope,
    never other blocks.  A field is the text of all mapped elements inside the block; the url is the
    first mapped element's href, resolved on the source url (S7), else the source url."""
    supported = lambda c: c.isNull() | c.rlike(H.SELECTOR)
    fields = [F.nullif(F.col("mapping")[name], F.lit("")).alias(f"_{name}") for name in H.FIELDS]
    p = payloads.select("*", *fields)
    ok = F.col("payload").isNotNull() & F.col("selector").rlike(H.SELECTOR)
    for name in H.FIELDS:
        ok = ok & supported(F.col(f"_{name}"))
    found = p.where(ok).select("source", F.col("page").cast("bigint").alias("page"), "source_url", "selector", *[f"_{name}" for name in H.FIELDS], "payload")
    ex = found.mapInArrow(H.blocks_of_pages, H.SCHEMA)
    url = U.resolve_url(F.nullif("href", F.lit("")), F.col("source_url"))
    items = ex.select("source", "page", "item_pos", url.alias("id"), T.falsy_or(js_trim(F.col("title")), F.lit(T.NO_TITLE)).alias("title"), url.alias("url"),
                      js_trim(F.col("content")).alias("content"), F.lit(None).cast("string").alias("published_at"))
    return items, _envelope(p, F.coalesce(ok, F.lit(False)), F.lit(MSG_UNSUPPORTED_SCRAPE))


TRENDING_PRESET = dict(block_re=r'(?s)<article class="Box-row">(.*?)</article>', title_re=r"(?s)<h2[^>]*>(.*?)</h2>",
                       href_re=r'<h2[^>]*>\s*<a[^>]*href="([^"]*)"', content_re=r"(?s)<p[^>]*>(.*?)</p>",
                       collapse_title=True, href_prefix=TRENDING_HOST)


# --------------------------------------------------------------------------- A10, A11


def _routed(p: DataFrame) -> DataFrame:
    """``p`` written once, a folder per parser: each parser then reads its own payloads only, for items as for envelopes."""
    return rewritten(p.drop("source_id", "fetched_at"), "parser", options=PLAIN_TEXTS)


def fan_out(payloads: DataFrame, registry: DataFrame, as_of: str, strict_routing: bool = False) -> tuple[DataFrame, DataFrame]:
    """A10 + A11: route every payload to its parser, parse, and union.

    ``payloads``: (source_id, page, fetched_at, payload).  Returns (items,
    envelopes).  Items carry ``ord``, the encounter position (source id,
    page, position in the payload).  A source without a parser, or a
    payload that fails, yields an error envelope and no items.
    ``strict_routing`` keeps the id-prefix routing even where a payload's root
    element contradicts it (the reference's behaviour).
    """
    reg = route(registry)
    dim = reg.select(F.col("id").alias("source_id"), F.col("url").alias("source_url"), "mapping",
                     "selector", "parser", "route_error")
    p = payloads.join(checked_broadcast(dim, MAX_BROADCAST_SOURCES), "source_id")
    p = p.withColumn("source", F.col("source_id"))
    if not strict_routing:
        # an id prefix chooses the Atom parser; a payload that is an RSS document by its root is read as one
        is_rss = root_element(F.col("payload")).isin("rss", "RDF")
        p = p.withColumn("parser", F.when((F.col("parser") == "arxiv") & is_rss, F.lit("rss")).otherwise(F.col("parser")))
    p = _routed(p)
    outs = []
    envs = [p.where(F.col("parser").isNull()).select("source", "page", F.lit("error").alias("status"), F.col("route_error").alias("error"))]
    for parser, fn in (
        ("rss", lambda d: parse_rss(d)),
        ("arxiv", lambda d: parse_atom(d)),
        ("api", lambda d: parse_news_api(d)),
        ("json", lambda d: parse_json(d, as_of)),
    ):
        items, env = fn(p.where(F.col("parser") == parser))
        outs.append(items)
        envs.append(env)
    scrape = p.where(F.col("parser") == "scrape")
    t_items, t_env = parse_html_blocks(scrape.where(F.col("source") == "github_trending"), **TRENDING_PRESET)
    own = F.col("selector").isNotNull() & F.col("mapping").isNotNull()
    n_items, n_env = parse_html_selected(scrape.where((F.col("source") != "github_trending") & own))
    bad_scrape = scrape.where((F.col("source") != "github_trending") & ~own).select(
        "source", "page", F.lit("error").alias("status"), F.lit(MSG_UNSUPPORTED_SCRAPE).alias("error"))
    outs += [t_items, n_items]
    envs += [t_env, n_env, bad_scrape]
    items = outs[0]
    for o in outs[1:]:
        items = items.unionByName(o)
    env = envs[0]
    for e in envs[1:]:
        env = env.unionByName(e)
    # All-or-nothing per payload (a failed payload has no items by construction)
    items = items.withColumn("ord", encounter_ord(F.col("source"), F.col("page"), F.col("item_pos")))
    counts = items.groupBy("source", "page").agg(F.count("*").alias("items_found"))
    env = env.join(counts, ["source", "page"], "left").withColumn("items_found", F.coalesce("items_found", F.lit(0)).cast("int"))
    return items, env
