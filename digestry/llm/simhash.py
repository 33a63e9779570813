"""SimHash near-duplicates by multi-index hashing.

A fingerprint has two 32-bit segments.  Of two fingerprints that differ in at most three bits, one
segment differs in at most one.  So every distinct fingerprint is entered in a table under each of
its segments and looks up, for each segment, the Hamming ball of radius one around it; a meeting is
verified on all 64 bits.  Of two segments that differ in one bit, the one with the bit unset looks
up the other, which halves the ball: 17 look-ups per segment on average.  Texts with one fingerprint count as one
node, so copies make no pairs.  Links are contracted to components by stars.

A segment that more than a thousandth of the distinct fingerprints share is indexed once more: of the
other segment's two halves, again one differs in at most one bit, so entries and look-ups under
such a key also carry a half, and no task gathers the whole key.

Defined results: A-Z is lower-cased; a text of fewer words than a shingle is one shingle; a null
or empty text, or one of white space, has fingerprint zero and is linked like any other.  The
component id is the smallest doc_id reached; null ids are passed over, and a component of rows without ids has a
null id.  Repeated rows each get a row; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from digestry.llm.common import HOT_SHARE, join_split, map_texts, read, registry, written
from digestry.llm.components import component_roots

QUERIES, ORACLE, register = registry()

SHINGLE = 3  # words
SEED = 42
MAX_BITS = 3
SEGMENT = 32  # bits; two segments
HALF = SEGMENT // 2
CROWD = 64  # entries that a key may have in any case before its entries are indexed once more
BLOCK = 1 << 16  # hashes whose bits are counted at once


def make_fingerprint(shingle: int = SHINGLE, seed: int = SEED):
    """A function from a text to its fingerprint as a signed 64-bit integer."""
    import numpy as np
    import xxhash

    digest = xxhash.xxh64_intdigest
    pattern = b" ".join([b"%b"] * shingle)

    def fingerprint(text: str | None) -> int:
        words = (text or "").encode().lower().split()  # of bytes: A-Z and ASCII white space only
        if not words:
            return 0
        parts = [b" ".join(words)] if len(words) < shingle else map(pattern.__mod__, zip(*(words[k:] for k in range(shingle)), strict=False))
        hashes = np.fromiter((digest(s, seed) for s in parts), np.uint64)
        ones = np.zeros(64, np.int64)
        for at in range(0, len(hashes), BLOCK):
            some = hashes[at : at + BLOCK].view(np.uint8).reshape(-1, 8)
            ones += np.unpackbits(some, axis=1, bitorder="little").sum(0, dtype=np.int64)
        return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.int64)[0])

    return fingerprint


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp (signed long) per row."""

    def make():
        one = make_fingerprint()
        return lambda ids, texts: {"doc_id": ids, "fp": [one(t) for t in texts]}

    return map_texts(docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")), "doc_id long, fp long", make)


def _segment(fp: Column, k: int) -> Column:
    return F.shiftrightunsigned(fp, SEGMENT * k).bitwiseAND(F.lit(2**SEGMENT - 1))


def _key(value: Column, k: int) -> Column:
    return value.bitwiseOR(F.lit(k << SEGMENT))


def _halves(fp: Column) -> tuple[Column, Column]:
    """The two halves of the segment that column ``key`` isn't about."""
    other = F.when(F.shiftright("key", SEGMENT) == 0, _segment(fp, 1)).otherwise(_segment(fp, 0))
    return other.bitwiseAND(F.lit(2**HALF - 1)), F.shiftright(other, HALF)


def _half_key(value: Column, j: int) -> Column:
    return value.bitwiseOR(F.lit(j << HALF).cast("long"))


def _met(probes: DataFrame, table: DataFrame, n_nodes: int) -> DataFrame:
    """``probes`` (u, key) joined to ``table`` (v, key); under crowded keys only those that also agree by a half of the other segment."""
    crowded = table.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > max(CROWD, n_nodes // HOT_SHARE))
    crowded = written(crowded.select("key").coalesce(1))
    if crowded.isEmpty():
        return probes.join(table, "key")
    hot = F.broadcast(crowded)  # fewer than 2 * HOT_SHARE keys: each node has two entries
    low, high = _halves(F.col("v"))
    entries = table.join(hot, "key").withColumn("half", F.explode(F.array(_half_key(low, 0), _half_key(high, 1))))

    def ball(half: Column, j: int) -> list[Column]:
        return [_half_key(half, j), *(_half_key(half.bitwiseXOR(F.lit(1 << b).cast("long")), j) for b in range(HALF))]

    low, high = _halves(F.col("u"))
    looked_up = probes.join(hot, "key").withColumn("half", F.explode(F.array(*ball(low, 0), *ball(high, 1))))
    among = looked_up.join(entries, ["key", "half"]).drop("half")
    return probes.join(hot, "key", "left_anti").join(table.join(hot, "key", "left_anti"), "key").unionByName(among)


def links(nodes: DataFrame, n_nodes: int) -> DataFrame:
    """Pairs (u, v) of distinct fingerprints in column fp that differ in 1 to ``MAX_BITS`` bits; a pair may come more than once."""
    table = nodes.select(F.col("fp").alias("v"), F.explode(F.array(*[_key(_segment(F.col("fp"), k), k) for k in (0, 1)])).alias("key"))
    bits = F.sequence(F.lit(0), F.lit(SEGMENT - 1))

    def ball(k: int) -> Column:
        here = _segment(F.col("fp"), k)
        unset = F.filter(bits, lambda i: F.getbit(here, i) == 0)
        with_bit = lambda i: here.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), i))
        return F.concat(F.array(_key(here, k)), F.transform(unset, lambda i: _key(with_bit(i), k)))

    probes = nodes.select(F.col("fp").alias("u"), F.explode(F.concat(ball(0), ball(1))).alias("key"))
    apart = F.bit_count(F.col("u").bitwiseXOR(F.col("v")))
    # equal segments meet from both sides; one side is enough
    twice = (_key(_segment(F.col("u"), 0), 0) == F.col("key")) | (_key(_segment(F.col("u"), 1), 1) == F.col("key"))
    met = _met(probes, table, n_nodes).filter((apart <= MAX_BITS) & (F.col("u") != F.col("v")) & (~twice | (F.col("u") < F.col("v"))))
    return met.select("u", "v")


def components(docs: DataFrame) -> DataFrame:
    """doc_id, fp, component_id for a written table of doc_id and fp; the least fp of the least id's texts is in ``least_fp``."""
    nodes = written(docs.groupBy("fp").agg(F.min("doc_id").alias("least_id"), F.count(F.lit(1)).alias("n")))
    total, n_nodes = nodes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    roots = component_roots(links(nodes, n_nodes))
    rooted = written(nodes.join(roots.withColumnRenamed("u", "fp"), "fp", "left").withColumn("root", F.coalesce("v", "fp")).drop("v"))
    # ids come first among the ids, then those without one
    least = F.min(F.struct(F.col("least_id").isNull().alias("none"), F.col("least_id").alias("id"), F.col("fp").alias("fp")))
    heads = rooted.groupBy("root").agg(least.alias("least"), F.count(F.lit(1)).alias("n"))
    heads = written(heads.select("root", F.col("least.id").alias("component_id"), F.col("least.fp").alias("least_fp"), "n"))
    named = written(join_split(rooted.withColumnRenamed("n", "n_docs"), heads, "root", n_nodes))
    named = named.select("fp", "component_id", "least_fp", F.col("n_docs").alias("n"))
    return join_split(docs, named, "fp", total)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, fp (signed long), component_id, least_fp."""
    return components(written(fingerprints(docs, id_col, text_col)))


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` (doc_id, text, ...) with one left of each component: the one with the smallest doc_id.

    The texts are written once with their fingerprints and shuffled once, by them, to the list of
    those that stay.  Of rows that repeat doc_id and fingerprint one stays.
    """
    cols = docs.columns

    @F.udf("long", useArrow=True)
    def fingerprint(text):
        if not _ONE:
            _ONE.append(make_fingerprint())  # one per Python worker
        return _ONE[0](text)

    row = F.struct(*[F.col(f"`{c}`") for c in cols])
    marked = written(docs.select(row.alias("row"), fingerprint(F.col("text")).alias("fp")))
    ids = marked.select(F.col("row.doc_id").cast("long").alias("doc_id"), "fp")
    heads = components(ids).filter((F.col("fp") == F.col("least_fp")) & F.col("doc_id").eqNullSafe(F.col("component_id")))
    heads = written(heads.groupBy("fp").agg(F.min("doc_id").alias("head"), F.count(F.lit(1)).alias("n")))
    heads = heads.withColumnRenamed("fp", "head_fp")
    # by fingerprint and id: copies of one text have one fingerprint, but don't gather
    kept = marked.join(heads, (F.col("fp") == F.col("head_fp")) & F.col("row.doc_id").cast("long").eqNullSafe(F.col("head")))
    if heads.filter("n > 1").limit(1).count():
        once = F.row_number().over(Window.partitionBy("fp").orderBy(F.xxhash64("row.text")))
        kept = kept.withColumn("nth", F.when(F.col("n") > 1, once).otherwise(1)).filter("nth = 1")
    return kept.select(*[F.col(f"row.`{c}`").alias(c) for c in cols])


_ONE: list = []


@register("op5_simhash_dedup")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
