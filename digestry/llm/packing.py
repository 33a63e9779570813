"""Best-fit packing of token sequences by bin completion.

Documents are tokenized and cut into pieces of at most ``LENGTH`` tokens.  Only the lengths matter
for packing, and there are at most ``LENGTH`` of them, so the search runs over the counts per
length (a bounded table, however many documents there are) and its result is a short list of
fillings, each with the number of sequences it is used for.  Pieces are then numbered within
their length, and a piece's number gives its sequence and place.  Texts are never shuffled; ids only
where the caller wants them placed (``with_ids``), as ``sequences`` does to build the packed rows.

Search: branch and bound over fillings around the largest length left.  A filling is undominated if
nothing more fits and no length in it can be exchanged for a larger one that is left.  Fillings are
tried from the smallest waste on; a branch ends when its waste passes what an improvement on
the best complete packing allows.  The first such packing is best-fit decreasing; the search ends when
a packing meets the lower bound, or after ``NODES`` steps with the best one found.

Defined results: a null or empty text is the end token alone; repeated rows are packed each; an empty
table gives an empty result; other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from digestry.llm.common import map_texts, read, registry, written

QUERIES, ORACLE, register = registry()

LENGTH = 1024  # tokens a sequence holds
END_ID = 2  # id after every document
VOCABULARY = "byte_bpe_50k.json"
NODES = 3000  # steps of the search
STEPS = 2000  # steps in the search for fillings around one length
ROWS_PER_RANGE = 8192  # pieces of one length that are numbered together, about
MOST_RANGES = 1 << 16  # counts per range of one length are added up in one task; beyond, the ranges grow instead

Filling = tuple[tuple[int, int], ...]  # (length, how often), largest first
Plan = list[tuple[Filling, int]]  # fillings and for how many sequences each

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, hash long, ids array<int>"


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def make_encoder(path: str):
    """A function from a text to its token ids, as ``tokenizers`` gives them for the vocabulary file.

    ``tiktoken`` reads the same byte-level vocabulary several times faster.  It takes the texts made
    only of letters, digits, signs and white space on which both split alike, and without a special token; all others go to
    ``tokenizers`` itself.
    """
    import json
    import re

    import tiktoken
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(path)
    with open(path, encoding="utf-8") as f:
        model = json.load(f)
    special = [t["content"] for t in model["added_tokens"]]
    # byte-level vocabularies write each byte as a printable character
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    chars = {chr(b): b for b in shown}
    chars |= {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(shown))}
    ranks = {bytes(chars[c] for c in t): i for t, i in model["model"]["vocab"].items() if t not in special}
    split = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"  # the byte-level pre-tokenizer's
    fast = tiktoken.Encoding("same", pat_str=split, mergeable_ranks=ranks, special_tokens={})
    plain = re.compile(r"[\t\n\r\x20-\x7e\xa1-\xac\xae-ſ–-„…€]*")
    marked = re.compile("|".join(map(re.escape, special))) if special else None

    def encode(text: str) -> list[int]:
        if plain.fullmatch(text) and not (marked and marked.search(text)):
            return fast.encode_ordinary(text)
        return exact.encode(text, add_special_tokens=False).ids

    return encode


def cut(n: int, length: int = LENGTH) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` tokens: whole ones, with the rest in front."""
    head = n % length
    return [(0, head)] * (head > 0) + [(at, length) for at in range(head, n, length)]


def token_pieces(
    docs: DataFrame, vocabulary: str, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False
) -> DataFrame:
    """One row per piece; ``hash`` spreads the pieces and is the same on every run; ids are null unless asked for."""

    def make():
        import zlib

        import numpy as np

        encode = make_encoder(vocabulary)

        def work(ids, texts):
            out = {name.split()[0]: [] for name in PIECES.split(", ")}
            for doc_id, text in zip(ids, texts, strict=True):
                tokens = np.array([*encode(text or ""), END_ID], "<u4")
                for k, (start, n) in enumerate(cut(len(tokens), length)):
                    crc = zlib.crc32(tokens[start : start + n].tobytes())
                    # neither the id alone (it may repeat or be null) nor the tokens alone (copies)
                    spread = zlib.crc32(f"{doc_id}:{k}:{crc}".encode())
                    ids_of = tokens[start : start + n].tolist() if with_ids else None
                    for values, x in zip(out.values(), (doc_id, k, start, n, crc, spread, ids_of), strict=True):
                        values.append(x)
            return out

        return work

    return map_texts(docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")), PIECES, make)


# --- the search, over counts per length ---------------------------------------------------


def best_fit(counts: dict[int, int], length: int) -> Plan:
    """Best-fit decreasing, many equal sequences at a time: the largest length left, then again and again the largest that fits."""
    left = dict(sorted(counts.items(), reverse=True))
    plan: Plan = []
    while left:
        filling, room = [], length
        for size in left:
            times = min(left[size], room // size)
            if times:
                filling.append((size, times))
                room -= size * times
        plan.append((tuple(filling), _use(left, tuple(filling))))
    return plan


def _use(left: dict[int, int], filling: Filling) -> int:
    """Take a filling as often as it goes."""
    times = min(left[size] // n for size, n in filling)
    for size, n in filling:
        left[size] -= n * times
        if not left[size]:
            del left[size]
    return times


def n_sequences(plan: Plan) -> int:
    return sum(times for _, times in plan)


def fillings(left: dict[int, int], length: int, most: int, steps: int = STEPS) -> list[tuple[int, Filling]]:
    """Undominated fillings around the largest length left, as (waste, filling), by waste.

    Depth first, large lengths first.  A length that fills the room exactly dominates everything
    else that could go there.  Ends after ``most`` fillings without waste or ``steps`` steps.
    """
    first = max(left)
    spare = {**left, first: left[first] - 1}
    sizes = sorted((s for s, n in spare.items() if n), reverse=True)
    found: dict[Filling, int] = {}
    stack: list[tuple[int, int, Filling]] = [(0, length - first, ())]  # (next size, room, chosen)
    exact = 0
    while stack and steps and exact < most:
        steps -= 1
        k, room, chosen = stack.pop()
        while k < len(sizes) and sizes[k] > room:
            k += 1
        if k < len(sizes) and sizes[k] < room and spare.get(room, 0) > dict(chosen).get(room, 0):
            continue  # a length passed over before, of which a piece is left, fills this room alone
        if k == len(sizes):
            if undominated(chosen, room, spare):
                found[chosen] = room
                exact += room == 0
            continue
        size = sizes[k]
        times = [0] if sizes[k] < room else []  # passing it over, unless it fills the room
        stack += [(k + 1, room - size * n, (*chosen, (size, n)) if n else chosen) for n in [*times, *range(1, min(spare[size], room // size) + 1)]]
    whole = []
    for filling, waste in found.items():
        counts = dict(filling)
        counts[first] = counts.get(first, 0) + 1
        whole.append((waste, tuple(sorted(counts.items(), reverse=True))))
    return sorted(whole, key=lambda x: (x[0], [-s for s, _ in x[1]]))[:most]


def undominated(filling: Filling, room: int, spare: dict[int, int]) -> bool:
    """Nothing left fits beside the filling, and no length in it can grow to one that is left."""
    used = dict(filling)
    for size, n in spare.items():
        if n > used.get(size, 0) and (size <= room or any(s < size <= s + room for s in used)):
            return False
    return True


def lower_bound(counts: dict[int, int], length: int) -> int:
    """Total over length, and for each small s: lengths over length - s stand alone, those over half stand apart."""
    total = sum(s * n for s, n in counts.items())
    best = -(-total // length)
    for small in {0, *(s for s in counts if 2 * s <= length)}:
        alone = sum(n for s, n in counts.items() if s > length - small)
        apart = sum(n for s, n in counts.items() if length - small >= s and 2 * s > length)
        room = sum(n * (length - s) for s, n in counts.items() if length - small >= s and 2 * s > length)
        rest = sum(n * s for s, n in counts.items() if small <= s and 2 * s <= length)
        best = max(best, alone + apart + max(0, -(-(rest - room) // length)))
    return best


def bin_completion(counts: dict[int, int], length: int = LENGTH, nodes: int = NODES, branches: int = 6) -> Plan:
    """Fillings for all pieces counted in ``counts`` (length -> number), as few sequences as the search finds."""
    counts = {s: n for s, n in counts.items() if n}
    best = best_fit(counts, length)
    least, most = lower_bound(counts, length), n_sequences(best)
    total = sum(s * n for s, n in counts.items())
    steps = nodes

    def options(left: dict[int, int], wasted: int) -> Iterator[Filling]:
        """Fillings whose waste still allows fewer sequences than the best packing has."""
        for waste, filling in fillings(left, length, branches):
            if waste <= (most - 1) * length - total - wasted:
                yield filling

    # depth first without recursion: (what is left, waste so far, plan so far, fillings to try)
    stack = [(dict(counts), 0, [], None)]
    while stack and most > least and steps:
        left, wasted, plan, todo = stack.pop()
        if not left:
            if n_sequences(plan) < most:
                best, most = plan, n_sequences(plan)
            continue
        if wasted > (most - 1) * length - total:
            continue
        todo = options(left, wasted) if todo is None else todo
        filling = next(todo, None)
        if filling is None:
            continue
        steps -= 1
        stack.append((left, wasted, plan, todo))
        after = dict(left)
        times = min(after[size] // n for size, n in filling)
        waste = length - sum(size * n for size, n in filling)
        if waste:  # wasteful sequences one by one as far as the bound allows
            times = max(1, min(times, ((most - 1) * length - total - wasted) // waste))
        for size, n in filling:
            after[size] -= n * times
            if not after[size]:
                del after[size]
        stack.append((after, wasted + waste * times, [*plan, (filling, times)], None))
    return best


# --- from the plan to places ---------------------------------------------------------------


def places(plan: Plan) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first number, end number, pieces per sequence, first sequence, first offset) per filling and length."""
    used: dict[int, int] = {}
    out, sequence = [], 0
    for filling, times in plan:
        offset = 0
        for size, n in filling:
            at = used.get(size, 0)
            out.append((size, at, at + n * times, n, sequence, offset))
            used[size] = at + n * times
            offset += size * n
        sequence += times
    return out


def number_within_length(pieces: DataFrame, total: int) -> DataFrame:
    """``pieces`` with ``number``, gapless from 0 within each length.

    Hash ranges are numbered apart and start after the counts of the ranges before, so a length
    that holds a third of all pieces is spread over many tasks.
    """
    ranges = min(MOST_RANGES, max(1, total // ROWS_PER_RANGE))
    ranged = pieces.withColumn("range", F.shiftright(F.col("hash") * ranges, 32).cast("int"))
    counts = ranged.groupBy("length", "range").agg(F.count(F.lit(1)).alias("n"))
    ahead = Window.partitionBy("length").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("length", "range", F.coalesce(F.sum("n").over(ahead), F.lit(0).cast("long")).alias("ahead"))
    inside = Window.partitionBy("length", "range").orderBy("hash", "doc_id", "piece")
    numbered = ranged.withColumn("inside", F.row_number().over(inside) - 1).join(starts, ["length", "range"])
    return numbered.withColumn("number", F.col("ahead") + F.col("inside")).drop("range", "ahead", "inside", "hash")


def pack(
    docs: DataFrame, vocabulary: str | None = None, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False
) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset, and ids if asked for."""
    spark = docs.sparkSession
    pieces = token_pieces(docs, vocabulary or default_vocabulary(), length, id_col, text_col, with_ids)
    pieces = written(pieces if with_ids else pieces.drop("ids"))
    # at most `length` rows
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    plan = bin_completion(counts, length)
    table = spark.createDataFrame(
        places(plan), "length long, first long, end long, per_sequence long, first_sequence long, first_offset long"
    )
    numbered = number_within_length(pieces, sum(counts.values()))
    # each filling uses up a length or is one of the search's last few: a bounded table
    met = numbered.join(F.broadcast(table), "length").filter((F.col("number") >= F.col("first")) & (F.col("number") < F.col("end")))
    nth = F.col("number") - F.col("first")
    return met.select(
        "doc_id",
        "piece",
        "start",
        "length",
        "ids_crc32",
        (F.col("first_sequence") + F.expr("(number - first) div per_sequence")).alias("sequence_id"),
        (F.col("first_offset") + nth % F.col("per_sequence") * F.col("length")).alias("offset"),
        *(["ids"] if with_ids else []),
    )


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, ids of the whole sequence, and starts of the pieces in it, from ``pack(..., with_ids=True)``."""
    rows = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("pieces"))
    return rows.select("sequence_id", F.flatten("pieces.ids").alias("ids"), F.col("pieces.offset").alias("starts"))


@register("op2_best_fit_packing")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents"))
