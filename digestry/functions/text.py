"""String column functions.

All of them are built-in Spark expressions, so they stay inside whole-stage
code generation; no Python runs per row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values.
# Accent folding used by the fingerprint key (S9): each character of
# ACCENTED maps to the character at the same position of FOLDED.
ACCENTED = "àáâãäåāăąçćčďèéêëēėęěìíîïīįłñńňòóôõöøōőřśšşťùúûüūůűųýÿźżž"
FOLDED = "aaaaaaaaacccdeeeeeeeeiiiiiilnnnoooooooorssstuuuuuuuuyyzzz"
# Heuristic categories (S17), tested in this order on the lower-cased title.
CATEGORY_RULES = (
    ("Research", ("research", "paper")),
    ("Model Release", ("release", "version", "new")),
    ("Tool/SDK", ("tool", "sdk", "api")),
    ("Policy", ("policy", "law", "regulation")),
)
UNCATEGORIZED = "Uncategorized"
NO_TITLE = "No Title"
NO_SUMMARY = "No summary available."
# ---------------------------------------------------------------------------

assert len(ACCENTED) == len(FOLDED)


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def sql_str(s: str) -> str:
    """A Spark SQL string literal (backslash escapes on, the default)."""
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def falsy_or(a, b) -> Column:
    """``a || b`` for strings: null and '' fall through to ``b``."""
    return F.coalesce(F.nullif(_c(a), F.lit("")), _c(b))


def scoring_text(title="title", content="content") -> Column:
    """lower(title + ' ' + (content or ''))."""
    return F.lower(F.concat(F.coalesce(_c(title), F.lit("")), F.lit(" "), F.coalesce(_c(content), F.lit(""))))


def contains_ci(text_lower, keyword: str) -> Column:
    """S3: case-insensitive substring test; ``text_lower`` is already lower-cased."""
    return F.contains(_c(text_lower), F.lit(keyword.lower()))


def normalize_title(title="title") -> Column:
    """Lower, delete [^a-z0-9 ], collapse spaces, trim.

    Tabs and newlines are deleted, not turned into spaces ("a\\nb" -> "ab").
    """
    t = F.regexp_replace(F.lower(F.coalesce(_c(title), F.lit(""))), r"[^a-z0-9 ]", "")
    return F.trim(F.regexp_replace(t, " +", " "))


def fingerprint(title="title") -> Column:
    """Fingerprint key: trim, lower, fold accents, drop punctuation and
    control characters, split on whitespace, unique, sort, join with ' '."""
    t = F.translate(F.lower(F.trim(F.coalesce(_c(title), F.lit("")))), ACCENTED, FOLDED)
    t = F.regexp_replace(t, r"[^\p{L}\p{N}\s]", "")
    words = F.array_remove(F.split(t, r"\s+"), "")
    return F.array_join(F.array_sort(F.array_distinct(words)), " ")


def bigrams(norm_title) -> Column:
    """Distinct character bigrams of a normalised title (empty below 2 chars)."""
    s = _c(norm_title)
    n = F.length(s)
    grams = F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.substring(s, i, 2))
    return F.when(n < 2, F.array().cast("array<string>")).otherwise(F.array_distinct(grams))


def dice(norm_a, norm_b, grams_a, grams_b) -> Column:
    """Dice coefficient on bigram sets; identical strings (also '' = '') are 1."""
    na, nb = F.size(_c(grams_a)), F.size(_c(grams_b))
    inter = F.size(F.array_intersect(_c(grams_a), _c(grams_b)))
    return (
        F.when(_c(norm_a) == _c(norm_b), F.lit(1.0))
        .when(na + nb == 0, F.lit(0.0))
        .otherwise(inter.cast("double") * F.lit(2.0).cast("double") / (na + nb).cast("double"))
    )


def collapse_ws(col) -> Column:
    """Trim and collapse whitespace runs to one space."""
    return F.trim(F.regexp_replace(_c(col), r"\s+", " "))


def sql_double(x: float) -> str:
    return f"CAST({float(x)!r} AS DOUBLE)"


def keyword_matches(keywords: list[str], title="title", content="content") -> Column:
    """Keywords found in lower(title) or in lower(content), tested separately.

    Built as one SQL expression (one call to the JVM, however long the list)."""
    if isinstance(title, str) and isinstance(content, str):
        if not keywords:
            return F.expr("CAST(array() AS ARRAY<STRING>)")
        tl, cl = f"lower(coalesce(`{title}`, ''))", f"lower(coalesce(`{content}`, ''))"
        items = ", ".join(
            f"CASE WHEN contains({tl}, {sql_str(k.lower())}) OR contains({cl}, {sql_str(k.lower())}) THEN {sql_str(k)} END"
            for k in keywords)
        return F.expr(f"array_compact(array({items}))")
    tl = F.lower(F.coalesce(_c(title), F.lit("")))
    cl = F.lower(F.coalesce(_c(content), F.lit("")))
    hits = [F.when(F.contains(tl, F.lit(k.lower())) | F.contains(cl, F.lit(k.lower())), F.lit(k)) for k in keywords]
    if not hits:
        return F.array().cast("array<string>")
    return F.array_compact(F.array(*hits))


def heuristic_category(title="title") -> Column:
    """First matching rule on the lower-cased title, else Uncategorized."""
    t = F.lower(F.coalesce(_c(title), F.lit("")))
    expr = None
    for category, words in CATEGORY_RULES:
        cond = None
        for w in words:
            c = F.contains(t, F.lit(w))
            cond = c if cond is None else (cond | c)
        expr = F.when(cond, F.lit(category)) if expr is None else expr.when(cond, F.lit(category))
    return expr.otherwise(F.lit(UNCATEGORIZED))


# What may stand between a label and its value: emphasis, the colon, white space.
LABEL_FILL = "*: \t\r\n"


def labelled_line(text: Column, label: str) -> Column:
    """The rest of the line after the first ``label`` (in any case), without emphasis and
    colon in front; null when there is no label or nothing follows it."""
    after = F.regexp_extract(text, f"(?is){label}(.*)", 1)
    line = F.trim(F.substring_index(F.ltrim(after, F.lit(LABEL_FILL)), "\n", 1))
    return F.nullif(line, F.lit(""))


def recover_analysis(text) -> Column:
    """Recover ``struct<summary, category>`` from free text.

    Null when neither label is present.  The category loses '.' and '*'; a
    missing category becomes Uncategorized.
    """
    t = _c(text)
    summary, category = labelled_line(t, "summary"), labelled_line(t, "category")
    named = F.coalesce(F.trim(F.translate(category, ".*", "")), F.lit(UNCATEGORIZED))
    found = summary.isNotNull() | category.isNotNull()
    return F.when(found, F.struct(summary.alias("summary"), named.alias("category")))


def digest_line(title="title", url="url", category="category", source="source", score="score", summary="summary") -> Column:
    """One markdown line of a digest item."""
    return F.concat(
        F.lit("*<"), F.coalesce(_c(url), F.lit("")), F.lit("|"), F.coalesce(_c(title), F.lit("")), F.lit(">*\n_"),
        F.coalesce(_c(category), F.lit("")), F.lit("_ • "), F.coalesce(_c(source), F.lit("")),
        F.lit(" • Score: "), F.coalesce(_c(score).cast("string"), F.lit("")), F.lit("\n"),
        falsy_or(summary, F.lit(NO_SUMMARY)),
    )


def placeholder_id(*parts) -> Column:
    """Synthetic identity joined with '-'."""
    return F.concat_ws("-", *[_c(p) for p in parts])
