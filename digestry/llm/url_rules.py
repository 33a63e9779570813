"""URL filters: host-suffix and path-prefix expressions joined on short hash prefixes.

Every URL is expanded into expressions (the last k labels of its host followed by the first n
characters of its path), only for the shapes (k, n) that occur in the rules.  Expressions meet
the rules by an equi-join on the first 32 bits of their SHA-256 digest; the whole digest then
confirms the match, and the longest matching rule decides.  DataFrame expressions only.

Defined results: a null url, or one without ``://``, has empty host and path and gets the default
verdict unless a rule is empty; hosts are taken literally (port and user included); repeated rows
come out as often as they came in; an empty table gives an empty result.  Of two rules with equal
host and path, ``block`` wins.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from digestry.llm.common import read, registry

QUERIES, ORACLE, register = registry()

PREFIX_HEX = 8  # hex digits of the digest in the join key: 32 bits
#: A rule list up to this many rows (under about 100 bytes each) is broadcast; a longer one is
#: shuffled, each rule once per salt, so that a rule fitting a third of all urls is split.
BROADCAST_RULES = 200_000
SALTS = 32

#: The rules of the registered query (fixed values): verdict, host, path.
RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]


def host_of(url: Column) -> Column:
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"://([^/?#]*)", 1)
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"://[^/?#]*([^?#]*)", 1)


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    return spark.createDataFrame(rules, "verdict string, host string, path string")


def _labels(host: Column) -> Column:
    return F.size(F.split(host, r"\."))


def judge_urls(urls: DataFrame, rules: DataFrame, id_cols: list[str], url_col: str = "url", default: str = "allow") -> DataFrame:
    """One row per row of ``urls``: ``id_cols``, host, path, rule (null if none fits) and verdict.

    ``urls`` is narrowed to ``id_cols`` and the url, so other columns never travel; join the
    verdicts to them by id.  ``rules`` has verdict, host, path.
    """
    # A url's path is empty or starts with a slash, so other rules can't fit anything.
    rules = rules.filter((F.col("path") == "") | F.col("path").startswith("/")).select("verdict", "host", "path")
    # longest rule, then longest host, then block: two fitting rules with equal lengths are the same rule
    rank = (
        F.shiftleft((F.length("host") + F.length("path")).cast("long"), 32)
        + F.shiftleft(F.length("host").cast("long"), 1)
        + (F.col("verdict") == "block").cast("long")
    )
    digest = F.sha2(F.concat("host", "path"), 256)
    table = rules.select(F.substring(digest, 1, PREFIX_HEX).alias("rule_prefix"), digest.alias("rule_digest"), rank.alias("rank"))
    # distinct shapes: at most (labels of a host) x (path lengths), far fewer than rules
    shapes = sorted(tuple(r) for r in rules.select(_labels(F.col("host")), F.length("path")).distinct().collect())
    n_rules = rules.limit(BROADCAST_RULES + 1).count()

    ids = [F.col(c).alias(f"id{i}") for i, c in enumerate(id_cols)]
    keys = [f"id{i}" for i in range(len(id_cols))] + ["host", "path", "part"]
    # the scan's partition in the key keeps copies of one row apart by partition: none gathers
    rows = urls.select(*ids, host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"), F.spark_partition_id().alias("part"))
    fits = [
        F.when(
            (_labels(F.col("host")) >= k) & (F.length("path") >= n),
            F.concat(F.substring_index("host", ".", -k), F.substring(F.col("path"), 1, n)),
        )
        for k, n in shapes
    ]
    # one null expression stands for the row itself, so rows without a match stay and are counted once
    own = F.array(F.lit(None).cast("string"))
    expanded = rows.select(*keys, F.explode(F.concat(own, F.array_compact(F.array(*fits))) if fits else own).alias("expr"))
    expanded = expanded.withColumn("digest", F.sha2("expr", 256)).withColumn("prefix", F.substring("digest", 1, PREFIX_HEX))
    on = F.col("prefix") == F.col("rule_prefix")
    if n_rules <= BROADCAST_RULES:
        table = F.broadcast(table)
    else:
        table = table.withColumn("rule_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        expanded = expanded.withColumn("salt", F.pmod(F.xxhash64(*keys), F.lit(SALTS)).cast("int"))
        on = on & (F.col("salt") == F.col("rule_salt"))
    met = expanded.join(table, on, "left").select(
        *keys,
        F.when(F.col("digest") == F.col("rule_digest"), F.col("rank")).alias("rank"),
        F.col("expr").isNull().cast("long").alias("own"),
    )
    best = met.groupBy(*keys).agg(F.max("rank").alias("rank"), F.sum("own").alias("copies"))
    host_len = F.shiftright(F.col("rank").bitwiseAND(F.lit(2**32 - 1)), 1).cast("int")
    path_len = (F.shiftright("rank", 32) - host_len).cast("int")
    rule = F.concat(F.expr("right(host, int(shiftright(rank & 4294967295L, 1)))"), F.substring(F.col("path"), F.lit(1), path_len))
    verdict = F.when(F.col("rank").isNull(), default).when(F.col("rank").bitwiseAND(F.lit(1)) == 1, "block").otherwise("allow")
    return best.select(
        *[F.col(f"id{i}").alias(c) for i, c in enumerate(id_cols)],
        "host",
        "path",
        F.when(F.col("rank").isNotNull(), rule).alias("rule"),
        verdict.alias("verdict"),
        F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy"),
    ).drop("copy")


def _oracle() -> str:
    fits = " UNION ALL ".join(
        f"SELECT '{v}' AS verdict, '{h}' AS rh, '{p}' AS rp" for v, h, p in RULES
    )
    upper, lower = string.ascii_uppercase, string.ascii_lowercase
    return f"""
WITH rules AS ({fits}),
u AS (SELECT page_id, row_number() OVER () AS rid,
             translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1), '{upper}', '{lower}') AS host,
             regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path FROM pages),
m AS (SELECT u.*, r.verdict, r.rh || r.rp AS rule,
             row_number() OVER (PARTITION BY rid ORDER BY length(r.rh || r.rp) DESC) AS k
      FROM u LEFT JOIN rules r ON (u.host = r.rh OR ends_with(u.host, '.' || r.rh)) AND starts_with(u.path, r.rp))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM m WHERE k = 1
"""


@register("op4_url_filters", _oracle())
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(read(spark, sf_dir, "pages"), rule_table(spark, RULES), ["page_id"])
