"""Feed audit and quality rules.

Rules are columns; a row's violations are ``array_compact(array(when...))``
exploded into a violations table, so any number of rows is checked in one
pass with no driver-side loop.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from digestry.functions import urls as U
from digestry.operators.rank import numbered
from digestry.session import materialize
from digestry.sources.payloads import SOURCE_TYPES

# ---------------------------------------------------------------------------
# Rule messages and the 24-hour time pattern.
MSG_FEED_NO_URL = "Feed at index {idx} is missing a 'url'."
MSG_FEED_BAD_URL = "Feed at index {idx} has a malformed URL: {url}"
MSG_FEED_BAD_TYPE = "Feed '{name}' has an invalid or missing 'type' (must be rss, api, scrape, or json)."
MSG_CHANNEL_NO_URL = "Delivery channel [{idx}] ({type}) is missing a webhookUrl."
MSG_CHANNEL_BAD_URL = "Delivery channel [{idx}] ({type}) has a malformed webhook URL: {url}"
MSG_BAD_TIME = "Please enter valid HH:mm time"
REPORT_CHUNK = 10_000  # details that are joined into one text at a time
TIME_RE = r"^([0-1]?[0-9]|2[0-3]):[0-5][0-9]$"
# ---------------------------------------------------------------------------


def _fmt(template: str, **cols: Column) -> Column:
    """Fill ``{name}`` slots of a fixed message with column values."""
    parts: list[Column] = []
    rest = template
    while "{" in rest:
        pre, _, tail = rest.partition("{")
        name, _, rest = tail.partition("}")
        if pre:
            parts.append(F.lit(pre))
        parts.append(F.coalesce(cols[name].cast("string"), F.lit("undefined")))
    if rest:
        parts.append(F.lit(rest))
    return F.concat(*parts)


def _violations(df: DataFrame, keep: list[str], scope: str, rules: list[Column]) -> DataFrame:
    arr = F.array_compact(F.array(*rules))
    return df.select(*keep, F.lit(scope).alias("scope"), F.posexplode(arr).alias("rule_pos", "message"))


def registry_violations(reg: DataFrame, idx_col: str = "idx") -> DataFrame:
    """url missing; url malformed; type missing or not one of the four."""
    url = F.col("url")
    missing = F.coalesce(url, F.lit("")) == ""
    rules = [
        F.when(missing, _fmt(MSG_FEED_NO_URL, idx=F.col(idx_col))),
        F.when(~missing & ~U.is_valid_url(url), _fmt(MSG_FEED_BAD_URL, idx=F.col(idx_col), url=url)),
        F.when(~F.coalesce(F.col("type").isin(*SOURCE_TYPES), F.lit(False)),
               _fmt(MSG_FEED_BAD_TYPE, name=F.coalesce(F.nullif(F.col("name"), F.lit("")), url))),
    ]
    return _violations(reg, [idx_col], "Feeds", rules)


def channel_violations(channels: DataFrame, idx_col: str = "idx") -> DataFrame:
    """a delivery channel's url missing or malformed."""
    url = F.col("webhook_url")
    missing = F.coalesce(F.trim(url), F.lit("")) == ""
    rules = [
        F.when(missing, _fmt(MSG_CHANNEL_NO_URL, idx=F.col(idx_col), type=F.col("type"))),
        F.when(~missing & ~U.is_valid_url(url), _fmt(MSG_CHANNEL_BAD_URL, idx=F.col(idx_col), type=F.col("type"), url=url)),
    ]
    return _violations(channels, [idx_col], "Delivery", rules)


def time_violations(subs: DataFrame, id_col: str = "id", time_col: str = "scheduled_time") -> DataFrame:
    """a subscription time must be 24-hour H:mm or HH:mm."""
    t = F.col(time_col)
    rules = [F.when(t.isNotNull() & ~t.rlike(TIME_RE), F.lit(MSG_BAD_TIME))]
    return _violations(subs, [id_col], "Schedule", rules)


def feed_audit(registry: DataFrame, items: DataFrame, envelopes: DataFrame) -> DataFrame:
    """M3: per source: status, item count, characters of title + content,
    rounded mean item size (0 when empty), error.  Built from the registry
    side, so a source without payloads appears with zero items."""
    per_items = items.groupBy("source").agg(
        F.count("*").alias("item_count"),
        F.sum(F.length(F.coalesce("content", F.lit(""))) + F.length(F.coalesce("title", F.lit("")))).alias("total_characters"),
    )
    per_env = envelopes.groupBy("source").agg(
        F.max(F.when(F.col("status") == "error", 1).otherwise(0)).alias("_err"), F.min("error").alias("error"))
    out = registry.select(F.col("id").alias("source")).join(per_env, "source", "left").join(per_items, "source", "left")
    n = F.coalesce("item_count", F.lit(0)).cast("bigint")
    chars = F.coalesce("total_characters", F.lit(0)).cast("bigint")
    return out.select(
        "source",
        F.when(F.col("_err") == 1, F.lit("error")).otherwise(F.lit("ok")).alias("status"),
        n.alias("item_count"), chars.alias("total_characters"),
        F.when(n > 0, F.round(chars.cast("double") / n.cast("double")).cast("bigint")).otherwise(F.lit(0).cast("bigint")).alias("average_item_size"),
        "error",
    )


def audit_totals(audit: DataFrame) -> DataFrame:
    """M4: feeds, successful, failed, items, characters (one row)."""
    return audit.agg(
        F.count("*").alias("total_feeds"),
        F.count_if(F.col("status") == "ok").alias("successful_feeds"),
        F.count_if(F.col("status") == "error").alias("failed_feeds"),
        F.sum("item_count").cast("bigint").alias("total_items"),
        F.sum("total_characters").cast("bigint").alias("total_characters"),
    )


def _summary() -> Column:
    return F.struct(
        F.count("*").alias("totalFeeds"),
        F.count_if(F.col("status") == "ok").alias("successfulFeeds"),
        F.count_if(F.col("status") == "error").alias("failedFeeds"),
        F.sum("item_count").cast("bigint").alias("totalItems"),
        F.sum("total_characters").cast("bigint").alias("totalCharacters"),
    ).alias("summary")


def _detail() -> Column:
    return F.struct(
        F.col("source"), F.col("status"), F.col("item_count").alias("itemCount"),
        F.col("total_characters").alias("totalCharacters"), F.col("average_item_size").alias("averageItemSize"),
        F.col("error"))


def _report_rows(placed: DataFrame) -> DataFrame:
    summary = placed.agg(_summary()).select(F.lit(0).cast("bigint").alias("pos"), F.to_json(F.struct("summary")).alias("json"))
    return summary.unionByName(placed.select("pos", F.to_json(_detail()).alias("json")))


def _placed(audit: DataFrame) -> DataFrame:
    return numbered(audit, (), ("source", "status", "item_count", "total_characters", "average_item_size", "error"))


def report_rows(audit: DataFrame) -> DataFrame:
    """K6 for a registry of any size: (pos, json), the summary at 0, then one detail per source in order."""
    return _report_rows(_placed(audit))


def audit_report(audit: DataFrame, max_details: int | None = None) -> DataFrame:
    """K6: ``{summary, details[]}`` as one JSON document, for a registry of any size.

    Details are written as JSON by the tasks that number them and joined ``REPORT_CHUNK`` at a time, so the last task
    holds the document's text and nothing else.  Only a caller that gives ``max_details`` gets the lines of
    ``report_rows``, in order, for a registry above it."""
    placed = materialize(_placed(audit))
    if max_details is not None and placed.count() > max_details:
        return _report_rows(placed).orderBy("pos").select("json")

    def joined(items: str) -> Column:
        return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_at", items))), lambda x: x[items]), ",").alias("_text")

    details = placed.select(F.col("pos").alias("_at"), F.to_json(_detail()).alias("_json"))
    chunks = details.groupBy(F.floor(F.col("_at") / F.lit(REPORT_CHUNK)).alias("_chunk")).agg(joined("_json"))
    details = chunks.select(F.col("_chunk").alias("_at"), "_text").agg(joined("_text"))
    summary = placed.agg(_summary()).select(F.to_json("summary").alias("_summary"))
    return details.crossJoin(F.broadcast(summary)).select(
        F.concat(F.lit('{"summary":'), "_summary", F.lit(',"details":['), "_text", F.lit("]}")).alias("json"))
