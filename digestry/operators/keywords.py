"""Keyword dictionaries: overlay (U3), weighted score (M2, S4), match sets.

A dictionary is a small dimension table ``(keyword string, weight double)``.

* Up to ``inline_limit`` keywords, it is read to the driver (its row count is
  checked first) and folded into one JVM expression, a sum of ``contains``
  tests that runs inside whole-stage code generation; the article rows are
  not shuffled.
* A larger one is numbered and sent to Python tasks, which find its keywords by the texts' runs
  (``finder``): the rows stay where they are.
* One above ``MAX_BROADCAST_KEYWORDS``, of any size, stays a table.  Every keyword is represented by
  the one of its ``GRAM``-character substrings that the fewest keywords have (a
  shorter keyword by itself); texts meet keywords by an equi-join on that
  gram, and each meeting is verified with ``contains`` where it is made.  The result is the same.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from digestry.functions import scores as S
from digestry.functions import text as T
from digestry.operators.finder import Listed
from digestry.session import MAX_BROADCAST_BYTES, checked_broadcast, materialize

# Characters of the substring a keyword of a large dictionary is found by.  Five are far more selective
# than three, and a text has about as many distinct ones.
GRAM = 5
# Keywords of a large dictionary are sent to all tasks up to this many (and ``MAX_BROADCAST_BYTES``).
MAX_BROADCAST_KEYWORDS = 1_000_000


def overlay(base: DataFrame, custom: DataFrame) -> DataFrame:
    """Base ∪ custom by exact (case-sensitive) keyword; the custom weight wins.

    A custom weight of 0 mutes a keyword; a custom 'AGI' next to a base 'agi'
    are two entries and both count.
    """
    b = base.select("keyword", F.col("weight").alias("_bw"))
    c = custom.select("keyword", F.col("weight").alias("_cw"))
    return b.join(c, "keyword", "full_outer").select(
        "keyword", F.coalesce(F.col("_cw"), F.col("_bw")).cast("double").alias("weight")
    )


def _as_items(dictionary, limit: int) -> list[tuple[str, float]] | None:
    """Dictionary entries when the dictionary is small enough to inline, else None."""
    if isinstance(dictionary, Mapping):
        items = [(str(k), float(v)) for k, v in dictionary.items()]
        return items if len(items) <= limit else None
    entries = _entries(dictionary).limit(limit + 1).collect()
    return [(r["keyword"], r["weight"]) for r in entries] if len(entries) <= limit else None


def _entries(dictionary: DataFrame) -> DataFrame:
    """A dictionary table as the map it stands for: a keyword that it repeats counts once, with its largest weight."""
    return dictionary.groupBy("keyword").agg(F.max(F.col("weight").cast("double")).alias("weight"))


def inline_score(text_lower: str, items: list[tuple[str, float]]) -> Column:
    """Sum of the weights of the keywords contained in the column named
    ``text_lower`` (each keyword once).  One SQL expression, parsed in one
    call, however many keywords there are."""
    terms = [f"CASE WHEN contains(`{text_lower}`, {T.sql_str(kw.lower())}) THEN {T.sql_double(w)} ELSE {T.sql_double(0)} END"
             for kw, w in items]
    return F.expr(balanced_sum([T.sql_double(0)] + terms))


def known(dictionary):
    """A dictionary table written once, for what reads it more than once; a mapping as it is."""
    return dictionary if isinstance(dictionary, Mapping) else materialize(_entries(dictionary))


def balanced_sum(terms: list[str]) -> str:
    """``t1 + t2 + ...`` as a balanced tree, so a long dictionary does not build
    an expression nested as deep as it is long."""
    while len(terms) > 1:
        terms = [f"({terms[i]} + {terms[i + 1]})" if i + 1 < len(terms) else terms[i] for i in range(0, len(terms), 2)]
    return terms[0]


def layer1_scores(
    df: DataFrame,
    positive,
    negative,
    title: str = "title",
    content: str = "content",
    inline_limit: int = 512,
    keep_text: bool = False,
    key: str = "ord",
) -> DataFrame:
    """M2 + S4: adds ``positive``, ``negative`` and ``layer1`` columns.

    The scoring text is lower-cased once per row (S2); each keyword is tested
    as a plain substring (S3), without word boundaries and across the
    title/content boundary.  ``key`` names a column unique per row (used only
    for dictionaries above ``inline_limit``).
    """
    txt = T.scoring_text(title, content)
    out = df.withColumn("_score_text", txt)
    for dictionary, name in ((known(positive), "positive"), (known(negative), "negative")):
        items = _as_items(dictionary, inline_limit)
        if items is not None:
            out = out.withColumn(name, inline_score("_score_text", items))
        else:
            # rows without such a column meet their keywords by their text: equal texts have equal keywords
            keyed = out if key in out.columns else out.withColumn("_hash", F.xxhash64("_score_text"))
            out = with_score(keyed, as_table(df, dictionary), "_score_text", key if key in out.columns else "_hash", name).drop("_hash")
    out = out.withColumn("layer1", S.layer1("positive", "negative"))
    return out if keep_text else out.drop("_score_text")


def as_table(df: DataFrame, dictionary) -> DataFrame:
    """A dictionary as a (keyword, weight) table, one row per keyword."""
    if isinstance(dictionary, Mapping):
        rows = [(str(k), float(v)) for k, v in dictionary.items()]
        return df.sparkSession.createDataFrame(rows, "keyword string, weight double")
    return _entries(dictionary)


def _grams(text: Column, sizes: list[int]) -> Column:
    """Distinct substrings of the given lengths; linear in the text."""
    chars = F.split(text, "")
    grams, parts = chars, []
    for n in range(1, max(sizes) + 1):
        if n > 1:  # longer by the character that follows; null past the end
            grams = F.zip_with(grams, F.slice(chars, n, F.length(text) + 1), lambda a, b: F.concat(a, b))
        if n in sizes:
            parts.append(grams)
    return F.array_compact(F.array_distinct(F.flatten(F.array(*parts))))


# Rows and characters of texts whose keywords are broadcast.
FEW_ROWS, FEW_CHARACTERS = 10_000, 1_000_000


def _few(df: DataFrame, text_col: str) -> bool:
    sizes = df.select(F.length(text_col).alias("_n")).limit(FEW_ROWS + 1)
    rows, characters = sizes.agg(F.count("*"), F.coalesce(F.sum("_n"), F.lit(0))).first()
    return rows <= FEW_ROWS and characters <= FEW_CHARACTERS


def _shares(df: DataFrame) -> int:
    """Partitions for texts that are dealt out: adaptive execution doesn't know that cutting them is the work."""
    spark = df.sparkSession
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)


def _listed(dictionary: DataFrame) -> tuple[DataFrame | None, Listed | None]:
    """A dictionary table numbered from 0, ``_id``, as a table and for Python tasks; neither if a count of its rows and bytes is too large."""
    size = F.coalesce(F.octet_length("keyword"), F.lit(0)) + 8
    rows, used = dictionary.select(size.alias("_n")).limit(MAX_BROADCAST_KEYWORDS + 1).agg(F.count("*"), F.coalesce(F.sum("_n"), F.lit(0))).first()
    if rows > MAX_BROADCAST_KEYWORDS or used > MAX_BROADCAST_BYTES:
        return None, None
    # of one partition, ids are places; no texts are in it
    numbered = dictionary.select("keyword", F.col("weight").cast("double").alias("weight"), F.lower("keyword").alias("_low"))
    numbered = materialize(numbered.repartition(1).withColumn("_id", F.monotonically_increasing_id().cast("int")))
    return numbered, Listed(numbered.toArrow().sort_by("_id").drop_columns("_id"))


def with_score(df: DataFrame, dictionary: DataFrame, text_col: str, key: str, out: str) -> DataFrame:
    """M2 for any dictionary size: adds ``out``, the summed weights of the keywords contained in ``text_col``."""
    _, listed = _listed(dictionary)
    if listed is None:
        return _with_met(df, dictionary, text_col, key, "_found").withColumn(out, found_score("_found")).drop("_found")
    return df.withColumn(out, F.arrow_udf(listed.scores, "double")(F.col(text_col)))


def with_found(df: DataFrame, dictionary: DataFrame, text_col: str, key: str, out: str) -> DataFrame:
    """M2 for any dictionary size: adds ``out``, the (keyword, weight) structs
    contained in ``text_col``; ``key`` names a column unique per row."""
    _, listed = _listed(dictionary)
    if listed is None:
        return _with_met(df, dictionary, text_col, key, out)
    return df.withColumn(out, F.arrow_udf(listed.found, "array<struct<keyword:string,weight:double>>")(F.col(text_col)))


def _with_met(df: DataFrame, dictionary: DataFrame, text_col: str, key: str, out: str) -> DataFrame:
    """``with_found`` by gram joins, for a dictionary that doesn't fit a task.

    The rows are shuffled once, by ``key`` and text.  Grams that represent no
    keyword are dropped where the text is cut into them, and a meeting is
    verified where it is made; what is found is collected per row (at most the
    keywords of one text) and joins the text in its partition.
    """
    words = materialize(dictionary.withColumn("_low", F.lower("keyword")))  # read several times
    always = words.where(F.col("_low") == "")  # the empty keyword is in every text
    words = words.where(F.col("_low") != "").withColumn("_size", F.least(F.length("_low"), F.lit(GRAM)))
    # at most GRAM lengths
    sizes = sorted(r[0] for r in words.select("_size").distinct().collect()) or [GRAM]
    cuts = words.withColumn("_gram", F.explode(_grams(F.col("_low"), sizes))).where(F.length("_gram") == F.col("_size"))
    shared = cuts.groupBy("_gram").agg(F.count("*").alias("_words"))
    rarest = cuts.join(shared, "_gram").groupBy("keyword", "weight", "_low").agg(
        F.min(F.struct(F.col("_words").alias("n"), F.col("_gram").alias("gram"))).alias("_rare"))
    rarest = materialize(rarest.select("keyword", "weight", "_low", F.col("_rare.gram").alias("_gram")))
    # rows are dealt once by key and text; after that a row's meetings, their verification and the text stay in one partition
    mine = ["_key", "_text_hash"]
    keyed = df.withColumn("_key", F.col(key)).withColumn("_text_hash", F.xxhash64(text_col))
    dealt = keyed.repartition(_shares(df), *mine)
    held = dealt.where("_key IS NOT NULL").dropDuplicates(mine).select(*mine, text_col, F.explode(_grams(F.col(text_col), sizes)).alias("_gram"))
    # a keyword has one gram, so a text meets it once
    met = held.join(checked_broadcast(rarest, MAX_BROADCAST_KEYWORDS), "_gram").where(F.contains(F.col(text_col), F.col("_low")))
    met = met.groupBy(*mine).agg(F.collect_list(F.struct("keyword", "weight")).alias("_met"))
    # what few short texts hold is broadcast, and they stay in place
    joined = keyed.join(F.broadcast(met), mine, "left") if _few(df, text_col) else dealt.join(met.hint("merge"), mine, "left")
    joined = joined.drop(*mine)
    empty = F.array().cast("array<struct<keyword:string,weight:double>>")
    base = [F.struct(F.lit(r["keyword"]).alias("keyword"), F.lit(float(r["weight"])).alias("weight")) for r in always.collect()]
    found = F.coalesce("_met", empty)
    return joined.withColumn(out, F.concat(found, F.array(*base)) if base else found).drop("_met")


def found_score(found: str) -> Column:
    """Sum of the weights of ``with_found``'s structs."""
    return F.aggregate(found, F.lit(0.0).cast("double"), lambda acc, m: acc + m["weight"])


def match_array(keywords: list[str], title: str = "title", content: str = "content") -> Column:
    """S16 for a dictionary given as a list."""
    return T.keyword_matches(keywords, title, content)


def keyword_hits(df: DataFrame, dictionary, id_cols: list[str], title: str = "title", content: str = "content",
                 inline_limit: int = 512, key: str = "ord") -> DataFrame:
    """(row, keyword, weight) for every keyword contained in title or content.

    Up to ``inline_limit`` keywords the reference's substring "join" is one
    inline match array per row, exploded; above, rows are given the numbers of their keywords, or
    those of the gram join of ``_with_met``.  A keyword found only across the end of the title is not a
    hit, so title and content are joined by a character no keyword has.
    """
    dictionary = known(dictionary)
    items = _as_items(dictionary, inline_limit)
    if items is None:
        both = df.withColumn("_both", F.lower(F.concat_ws("\x00", F.coalesce(title, F.lit("")), F.coalesce(content, F.lit("")))))
        table, listed = _listed(as_table(df, dictionary))
        if listed is None:
            found = _with_met(both, as_table(df, dictionary), "_both", key, "_found")
            return found.select(*id_cols, F.explode("_found").alias("_m")).select(*id_cols, "_m.keyword", "_m.weight")
        found = both.select(*id_cols, F.explode(F.arrow_udf(listed.numbers, "array<int>")("_both")).alias("_id"))
        return found.join(F.broadcast(table.select("_id", "keyword", "weight")), "_id").select(*id_cols, "keyword", "weight")
    weights = F.create_map(*[x for k, w in items for x in (F.lit(k), F.lit(float(w)))]) if items else None
    hits = df.select(*id_cols, F.explode(T.keyword_matches([k for k, _ in items], title, content)).alias("keyword"))
    if weights is None:
        return hits.withColumn("weight", F.lit(None).cast("double"))
    return hits.withColumn("weight", F.element_at(weights, F.col("keyword")))
