"""Chat formatting: one training string per conversation, with its loss mask.

The turns of a conversation are collected as structs and sorted; adjacent turns of one role are
merged into a block by an array aggregation; the blocks are concatenated.  Spark expressions only.

    <s>[INST]role[/INST]first text[TURN]second text</s>

``[TURN]`` stands between the texts of a merged block, so the turns can be read back.  A control
string inside a role or text is escaped by one backslash after its opening bracket, one that is
already escaped by one more; ``unescape`` takes exactly one away.  A control string has its only
opening bracket in front and its only closing one at the end, so none arises across a boundary.

Defined results: rows are ordered by (turn, role, text), a null turn last; a null text or role is
empty; repeated rows are repeated turns; rows without conv_id form one conversation; an empty table
gives an empty result.  Only conv_id, turn, role and text are read.

A conversation is one output string, so its rows meet in one task: memory follows the longest
conversation, not the table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from digestry.llm.common import read, registry

QUERIES, ORACLE, register = registry()

BEGIN, END = "<s>", "</s>"
ROLE, BODY, TURN = "[INST]", "[/INST]", "[TURN]"
NAMES = r"(/?s>|/?INST\]|TURN\])"  # what follows the bracket of a control string
LEARNED = "assistant"
CHUNK = 512  # pieces whose places are added up together


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])(\\*)" + NAMES, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])\\(\\*)" + NAMES, r"$1$2$3")


#: Positions (from 0) of the turns that start a block: those whose role differs from the one before.
_STARTS = "filter(sequence(0, size(turns) - 1), i -> i = 0 or turns[i].role <> turns[greatest(i - 1, 0)].role)"


def _running(sums: str, start: str) -> str:
    """SQL: ``start`` plus the sum of all elements before, per element; the array grows by one copy per element."""
    return (
        f"aggregate({sums}, named_struct('pos', {start}, 'out', cast(array() as array<int>)),"
        " (b, x) -> named_struct('pos', b.pos + x, 'out', array_append(b.out, b.pos)), b -> b.out)"
    )


#: Where each piece begins, from the array ``chunks`` of the pieces' lengths in slices of ``CHUNK``: sums of
#: slices first, so that no long array is copied per turn.
_POSITIONS = f"""
flatten(zip_with(chunks, {_running("transform(chunks, c -> aggregate(c, 0, (s, x) -> s + x))", "0")}, (c, at) -> {_running("c", "at")}))
"""


def format_conversations(turns: DataFrame, learned_role: str = LEARNED) -> DataFrame:
    """conv_id, formatted (string), loss (spans of the learned role's texts in it: start from 0, length; code points)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    role = F.coalesce(F.col("role"), F.lit(""))
    turn = F.struct(F.col("turn").isNull().alias("late"), F.col("turn").alias("turn"), role.alias("role"), text.alias("text"))
    conv = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    conv = conv.withColumn("at", F.expr(_STARTS))
    conv = conv.withColumn(
        "blocks",
        F.transform(
            "at",
            lambda a, i: F.struct(
                F.col("turns")[a]["role"].alias("role"),
                F.transform(
                    F.slice("turns", a + 1, F.coalesce(F.get("at", i + 1), F.size("turns")) - a), lambda t: escape(t["text"])
                ).alias("texts"),
            ),
        ),
    )
    head = lambda b: F.concat(F.lit(BEGIN + ROLE), escape(b["role"]), F.lit(BODY))
    conv = conv.withColumn(
        "formatted", F.array_join(F.transform("blocks", lambda b: F.concat(head(b), F.array_join(b["texts"], TURN), F.lit(END))), "")
    )
    # the string as pieces in order: marks and texts alternate, (length, learned) each
    pieces = F.flatten(
        F.transform(
            "blocks",
            lambda b: F.transform(
                b["texts"],
                lambda t, i: F.struct(
                    F.when(i == 0, F.length(head(b))).otherwise(len(TURN)).alias("mark"),
                    F.length(t).alias("text"),
                    F.when(i == F.size(b["texts"]) - 1, len(END)).otherwise(0).alias("tail"),
                    (b["role"] == learned_role).alias("learned"),
                ),
            ),
        )
    )
    conv = conv.withColumn("pieces", pieces)
    lengths = F.transform("pieces", lambda p: p["mark"] + p["text"] + p["tail"])
    conv = conv.withColumn("lengths", lengths)
    conv = conv.withColumn("chunks", F.expr(f"transform(sequence(1, size(lengths), {CHUNK}), k -> slice(lengths, k, {CHUNK}))"))
    placed = F.zip_with("pieces", F.expr(_POSITIONS), lambda p, at: F.struct(p["learned"].alias("learned"), (at + p["mark"]).alias("start"), p["text"].alias("length")))
    loss = F.transform(F.filter(placed, lambda p: p["learned"]), lambda p: F.struct(p["start"].alias("start"), p["length"].alias("length")))
    return conv.select("conv_id", "formatted", loss.alias("loss"))


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted string, array<struct<role, text>>, unescaped."""
    blocks = F.filter(F.split(formatted, END), lambda b: b != "")

    # in a transform of its own, so that a block is split once, not per turn
    parts = F.transform(blocks, lambda b: F.split(F.substring(b, F.lit(len(BEGIN + ROLE) + 1), F.length(b)), r"\[/INST\]", 2))

    def turns_of(p: Column) -> Column:
        return F.transform(F.split(p[1], r"\[TURN\]", -1), lambda t: F.struct(unescape(p[0]).alias("role"), unescape(t).alias("text")))

    return F.flatten(F.transform(parts, turns_of))


def read_loss(formatted: Column, loss: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    # a substring is found by counting from the front: parts of ``CHUNK`` spans are cut out first
    parts = F.transform(F.sequence(F.lit(1), F.size(loss), F.lit(CHUNK)), lambda k: F.slice(loss, k, F.lit(CHUNK)))

    def part(s: Column) -> Column:
        first, last = s[0]["start"], F.element_at(s, -1)
        return F.struct(s.alias("spans"), first.alias("first"), F.substring(formatted, first + 1, last["start"] + last["length"] - first).alias("text"))

    def texts(p: Column) -> Column:
        return F.array_join(F.transform(p["spans"], lambda s: unescape(F.substring(p["text"], s["start"] - p["first"] + 1, s["length"]))), "")

    whole = F.array_join(F.transform(F.transform(parts, part), texts), "")
    return F.when(F.size(loss) > 0, whole).otherwise(F.lit(""))


HARD = "</s>[INST] ok [/INST]"  # the added conversation's text (fixed value)

_CONTROL = r"[<]\\*/?s>|\[\\*(?:/?INST|TURN)\]"
_SQL = f"""
WITH r AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, 0, 'user', '{HARD}' UNION ALL SELECT -7, 1, 'assistant', '{HARD}'),
o AS (SELECT *, row_number() OVER w AS k, lag(role) OVER w AS before FROM r
      WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS LAST, role, text)),
e AS (SELECT *, length(text) + len(regexp_extract_all(text, '{_CONTROL}')) AS chars,
             CASE WHEN k = 1 OR role <> before
                  THEN {len(BEGIN + ROLE + BODY + END)} + length(role) + len(regexp_extract_all(role, '{_CONTROL}'))
                  ELSE {len(TURN)} END AS marks FROM o)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = '{LEARNED}'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = '{LEARNED}'), '')) AS loss_sha256,
       CAST(sum(chars + marks) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""


@register("op3_chat_format", _SQL)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    hard = spark.createDataFrame([(-7, 0, "user", HARD), (-7, 1, "assistant", HARD)], "conv_id long, turn long, role string, text string")
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(hard)
    out = format_conversations(rows).withColumn("turns", read_turns(F.col("formatted")))
    out = out.withColumn("learned", read_loss(F.col("formatted"), F.col("loss")))
    joined = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(joined, 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"),
        F.sha2("learned", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
