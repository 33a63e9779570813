"""Digest documents and run accounting.

A digest holds the selected items of one group (at most max_items new items)
and the pending ones, which grow with the stored table.  So its general form is
one row per item (``item_rows``); a nested document is built only of a digest
whose positions show that it has at most ``MAX_DIGEST_ITEMS`` items.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from digestry.functions import text as T

# ---------------------------------------------------------------------------
# Chat-block texts of the K5 sink.
HEADER_TEXT = "Your digest, {date}"
SUMMARY_TEXT = "New since the last run: {new}. Picked for you: *{selected}*."
FOOTER_TEXT = "Sent by digestry"
# ---------------------------------------------------------------------------

MAX_DIGEST_ITEMS = 100_000  # of one nested document
ITEM_FIELDS = ("title", "url", "summary", "category", "source", "score")


def item_struct() -> Column:
    """The six fields a digest item keeps."""
    return F.struct(*[F.col(c) for c in ITEM_FIELDS])


def assemble(items: DataFrame, counts: DataFrame | None, digest_date: str, group_cols=(), pos_col: str = "pos") -> DataFrame:
    """M7 + M6: one digest per group: ordered item structs and metadata
    (new items after the incremental filter, number selected, date).

    Fails at an item beyond position ``MAX_DIGEST_ITEMS``, before such a digest is gathered."""
    g = list(group_cols)
    place = F.when(F.col(pos_col) <= MAX_DIGEST_ITEMS, F.col(pos_col)).otherwise(
        F.raise_error(F.lit(f"a digest has more than {MAX_DIGEST_ITEMS} items; take its item rows")).cast("bigint"))
    docs = items.groupBy(*g).agg(
        F.transform(F.array_sort(F.collect_list(F.struct(place.alias("_p"), item_struct().alias("_i")))),
                    lambda x: x["_i"]).alias("items")
    )
    if counts is not None:
        if g:
            docs = docs.join(counts, g, "left")
        else:  # one row on each side: read the single count as a literal
            row = counts.first()
            docs = docs.withColumn("total_new_items", F.lit(row["total_new_items"] if row else 0).cast("bigint"))
    else:
        docs = docs.withColumn("total_new_items", F.lit(None).cast("bigint"))
    return docs.select(
        *g, "items",
        F.struct(
            F.coalesce(F.col("total_new_items"), F.lit(0)).cast("bigint").alias("total_new_items"),
            F.size("items").cast("bigint").alias("total_selected"),
            F.lit(digest_date).alias("date"),
        ).alias("metadata"),
    )


def item_rows(placed: DataFrame, counts: DataFrame, digest_date: str, group_cols=()) -> DataFrame:
    """M7 as rows: one per item of ``rank.numbered`` rows, with the digest's metadata; ``counts`` has one row per group."""
    g = list(group_cols)
    if g:  # joined as in assemble, but a hot group is only streamed past the counts
        rows = placed.join(F.broadcast(counts) if counts.count() <= MAX_DIGEST_ITEMS else counts, g, "left")
    else:
        row = counts.first()
        rows = placed.withColumn("total_new_items", F.lit(row["total_new_items"] if row else 0).cast("bigint"))
    fields = [c for c in ITEM_FIELDS if c not in g]
    return rows.select(
        *g, F.col("pos").cast("int").alias("pos"), *fields, F.coalesce("total_new_items", F.lit(0)).cast("bigint").alias("total_new_items"),
        F.col("total").cast("bigint").alias("total_selected"), F.lit(digest_date).alias("digest_date"))


def new_item_counts(new_items: DataFrame, group_cols=()) -> DataFrame:
    """M6: items after the incremental filter, before dedup, per group."""
    return new_items.groupBy(*group_cols).agg(F.count("*").cast("bigint").alias("total_new_items"))


def to_json_doc(digests: DataFrame, group_cols=()) -> DataFrame:
    """K4: the nested document as JSON text; a missing value is an explicit null."""
    doc = F.to_json(F.struct("items", "metadata"), {"ignoreNullFields": "false"})
    return digests.select(*group_cols, doc.alias("json"))


def chat_blocks(digests: DataFrame, group_cols=()) -> DataFrame:
    """K5: header, summary line, divider, one section per item, footer; as JSON.

    The blocks differ in shape (a header's text allows emoji, a context block
    has ``elements``), so each is written as JSON by itself."""
    md = F.col("metadata")

    def text(kind: str, value: Column, *more: Column) -> Column:
        return F.struct(F.lit(kind).alias("type"), value.alias("text"), *more)

    def section(value: Column) -> Column:
        return F.to_json(F.struct(F.lit("section").alias("type"), text("mrkdwn", value).alias("text")))

    title = F.replace(F.lit(HEADER_TEXT), F.lit("{date}"), md["date"])
    header = F.to_json(F.struct(F.lit("header").alias("type"), text("plain_text", title, F.lit(True).alias("emoji")).alias("text")))
    summary = section(F.replace(F.replace(F.lit(SUMMARY_TEXT), F.lit("{selected}"), md["total_selected"].cast("string")),
                                F.lit("{new}"), md["total_new_items"].cast("string")))
    divider = F.to_json(F.struct(F.lit("divider").alias("type")))
    items = F.transform(F.col("items"), lambda i: section(
        T.digest_line(i["title"], i["url"], i["category"], i["source"], i["score"], i["summary"])))
    footer = F.to_json(F.struct(F.lit("context").alias("type"), F.array(text("mrkdwn", F.lit(FOOTER_TEXT))).alias("elements")))
    blocks = F.array_join(F.concat(F.array(header, summary, divider), items, F.array(footer)), ",")
    return digests.select(*group_cols, F.concat(F.lit('{"blocks":['), blocks, F.lit("]}")).alias("json"))


def write_documents(docs: DataFrame, path: str, group_cols=(), column: str = "json") -> str:
    """K4, K5, K6 as files: one text file per digest, in a folder named by its group.

    Spark's own writer commits the files, so they are there whole or not at all, in any store; a digest that is
    written again replaces its file and leaves the others."""
    rows = docs.select(*group_cols, F.col(column).alias("value"))
    if not group_cols:
        rows.coalesce(1).write.mode("overwrite").text(path)
    else:
        rows.repartition(*group_cols).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*group_cols).text(path)
    return path


def read_documents(spark, path: str, group_cols=(), column: str = "json") -> DataFrame:
    """The files of ``write_documents``, one row per line."""
    schema = ", ".join(["value string", *[f"`{c}` string" for c in group_cols]])
    return spark.read.schema(schema).text(path).select(*group_cols, F.col("value").alias(column))


def delivery_outcome(outcomes: DataFrame, group_cols=()) -> DataFrame:
    """M9: succeeded / failed channels per digest; commit when >= 1 succeeded."""
    return outcomes.groupBy(*group_cols).agg(
        F.count_if(F.col("status") == "ok").alias("succeeded"),
        F.count_if(F.col("status") != "ok").alias("failed"),
    ).withColumn("commit", F.col("succeeded") >= 1)


def stage_funnel(flags: DataFrame, stage_cols: list[str], group_cols=()) -> DataFrame:
    """Rows reaching each stage, per group, in one aggregation over flag columns."""
    return flags.groupBy(*group_cols).agg(
        F.count("*").alias("raw"), *[F.count_if(F.col(c)).alias(c) for c in stage_cols]
    )
