"""Secret scans: keyword prefilter, anchored patterns near hits, checksum validation.

One Aho-Corasick pass finds the keywords in the lower-cased text; a pattern is tried only at the
place of its keyword.  Runs of hexadecimal digits have no keyword, so a copy of the text in which
every such digit is one symbol is searched for 32 of them in a row.  Kinds with a checksum inside
(GitHub and npm tokens: CRC-32 in base 62; JSON web tokens: a header that decodes to JSON) count only if it holds.

Base kinds: ``assign``, ``access``, ``hex``; matches of a kind are leftmost and do not overlap, one that
is too short still uses up its characters.  Added kinds: ``github``, ``npm``, ``jwt``, ``pem``.
Spans are in code points, end exclusive.

Defined results: a null or empty text has no span; every row gets one result row, repeated rows too;
an empty table gives an empty one; other columns are not looked at, whatever their names, and masking keeps them;
whole texts are scanned, however long, in time in proportion to their length.
"""

from __future__ import annotations

import bisect
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from digestry.llm.common import map_texts, read, registry

QUERIES, ORACLE, register = registry()

KINDS = ["assign", "access", "hex", "github", "npm", "jwt", "pem"]  # order of kinds at one start
MASK = "[REDACTED]"

# Fixed values of the base kinds.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ASSIGN_CHARS = 8
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
ACCESS_CHARS = 16
HEX = re.compile(r"[0-9a-f]+")
HEX_CHARS = 32

GITHUB = re.compile(r"gh[pousr]_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
NPM = re.compile(r"npm_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
JWT_RUN = re.compile(r"[A-Za-z0-9_-]*")  # three of them, joined by dots, the first with more than ``eyJ``
PEM = re.compile(r"-----BEGIN ([A-Z ]{0,40}PRIVATE KEY)-----")
PEM_END = re.compile(r"(?=-----END ([A-Z ]{0,40}PRIVATE KEY)-----)")

#: keyword in the lower-cased text -> kind
KEYWORDS = {
    **dict.fromkeys(["password", "passwd", "secret", "token", "apikey", "api_key"], "assign"),
    "akia": "access",
    **dict.fromkeys(["ghp_", "gho_", "ghu_", "ghs_", "ghr_"], "github"),
    "npm_": "npm",
    "eyj": "jwt",
    "-----begin ": "pem",
}
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
_RUNS = bytes(ord("x") if chr(b) in "0123456789abcdef" else ord(".") for b in range(256))

Span = tuple[int, int, int]  # start, number of the kind, end


def crc_holds(body: str, check: str) -> bool:
    """The last six characters are the CRC-32 of the others in base 62."""
    import zlib

    value = 0
    for c in check:
        value = value * 62 + BASE62.index(c)
    return value == zlib.crc32(body.encode())


def header_decodes(header: str) -> bool:
    import base64
    import json

    try:
        return "alg" in json.loads(base64.urlsafe_b64decode(header + "=" * (-len(header) % 4)))
    except (ValueError, TypeError):
        return False


class _Tokens:
    """JSON web tokens of one text, asked for at rising places.  All places in one run of token characters share
    its end and what follows, so a run is read once, however many headers begin in it."""

    def __init__(self, text: str):
        self.text, self.run_end, self.end = text, 0, None

    def match(self, at: int) -> tuple[int, bool] | None:
        text = self.text
        if not text.startswith("eyJ", at):
            return None
        if at >= self.run_end:
            self.run_end, self.end = JWT_RUN.match(text, at).end(), None
            if text.startswith(".", self.run_end):
                second = JWT_RUN.match(text, self.run_end + 1).end()
                if second > self.run_end + 1 and text.startswith(".", second):
                    self.end = JWT_RUN.match(text, second + 1).end()
        if self.end is None or self.run_end == at + 3:
            return None
        return self.end, header_decodes(text[at : self.run_end])


class _Keys:
    """PEM blocks of one text: the end markers are looked up once, at the first header."""

    def __init__(self, text: str):
        self.text, self.ends = text, None

    def match(self, at: int) -> tuple[int, bool] | None:
        m = PEM.match(self.text, at)
        if not m:
            return None
        if self.ends is None:
            self.ends = {}
            for end in PEM_END.finditer(self.text):
                self.ends.setdefault(end[1], []).append(end.start())
        places = self.ends.get(m[1], [])
        i = bisect.bisect_left(places, m.end())
        return (places[i] + len(f"-----END {m[1]}-----"), True) if i < len(places) else (m.end(), True)


def _match(kind: str, text: str, at: int) -> tuple[int, bool] | None:
    """(end, whether it counts) of the match of a kind that starts at ``at``."""
    if kind == "assign":
        m = ASSIGN.match(text, at)
        return m and (m.end(), len(m[2]) >= ASSIGN_CHARS)
    if kind == "access":
        m = ACCESS.match(text, at)
        return m and (m.end(), m.end() - at >= ACCESS_CHARS)
    m = (GITHUB if kind == "github" else NPM).match(text, at)
    return m and (m.end(), crc_holds(m[1], m[2]))


def _hex_spans(text: str, data: bytes) -> list[Span]:
    runs, want, out = data.translate(_RUNS), b"x" * HEX_CHARS, []
    at, seen_bytes, seen_chars = runs.find(want), 0, 0
    while at >= 0:
        seen_chars += len(data[seen_bytes:at].decode())  # digits are single bytes: no character is split
        seen_bytes = at
        end = HEX.match(text, seen_chars).end()
        out.append((seen_chars, KINDS.index("hex"), end))
        at = runs.find(want, at + end - seen_chars)
    return out


def make_scanner():
    """A function from a text to its spans, sorted; the automaton is built once."""
    import ahocorasick

    automaton = ahocorasick.Automaton()
    for word, kind in KEYWORDS.items():
        automaton.add_word(word, (len(word), kind))
    automaton.make_automaton()

    def scan(text: str | None) -> list[Span]:
        if not text:
            return []
        data = text.encode()
        lowered = data.lower().decode()  # A-Z only, so places stay the same
        out, used = _hex_spans(text, data), dict.fromkeys(KINDS, 0)
        readers = {"jwt": _Tokens(text), "pem": _Keys(text)}
        for last, (length, kind) in automaton.iter(lowered):
            at = last + 1 - length
            if at < used[kind]:
                continue
            found = readers[kind].match(at) if kind in readers else _match(kind, text, at)
            if found:
                used[kind] = found[0]
                if found[1]:
                    out.append((at, KINDS.index(kind), found[0]))
        return sorted(out)

    return scan


def joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def mask(text: str | None, spans: list[Span]) -> str | None:
    """The text with every span, overlapping ones together, replaced by ``MASK``."""
    if not spans:
        return text
    out, upto = [], 0
    for a, _, b in spans:
        if a >= upto:
            out += [text[upto:a], MASK]
        upto = max(upto, b)
    return "".join([*out, text[upto:]])


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id and spans, array<struct<kind, start, end>>, sorted by start, then kind."""

    def make():
        scan = make_scanner()

        def work(ids, texts):
            return {"doc_id": ids, "spans": [[{"kind": KINDS[k], "start": a, "end": b} for a, k, b in scan(t)] for t in texts]}

        return work

    schema = "doc_id long, spans array<struct<kind:string,start:long,end:long>>"
    return map_texts(docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")), schema, make)


_SCAN: list = []


def mask_secrets(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with every secret in the text replaced by ``MASK`` and, where there is one, n_chars counted anew."""

    @F.udf("string", useArrow=True)
    def masked(text):
        if not _SCAN:
            _SCAN.append(make_scanner())  # one per Python worker
        return mask(text, _SCAN[0](text))

    out = docs.withColumn(text_col, masked(F.col(f"`{text_col}`")))
    return out.withColumn("n_chars", F.length(F.col(f"`{text_col}`")).cast("long")) if "n_chars" in docs.columns else out


@register("op9_secret_scan")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(read(spark, sf_dir, "documents"))
    text = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    base = F.array_join(F.transform(F.filter("spans", lambda s: s["kind"].isin(KINDS[:3])), text), ",")
    return found.select(
        "doc_id",
        *[count(kind).alias(f"n_{kind}") for kind in KINDS[:3]],
        F.sha2(base, 256).alias("base_sha256"),
        F.array_join(F.transform("spans", text), ",").alias("spans"),
    )
