"""DuckDB SQL twins of the column functions, for the oracle queries.

Each helper returns SQL text for the same value the Spark expression of the
same name computes.  Literals that must be doubles are cast explicitly
(DuckDB, like Spark, reads ``0.7`` as a decimal).
"""

from __future__ import annotations

from digestry.functions import text as T
from digestry.functions import urls as U
from digestry.sources import testdata as TD


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def dbl(x: float) -> str:
    return f"CAST({float(x)!r} AS DOUBLE)"


def norm_title(t: str) -> str:
    return f"trim(regexp_replace(regexp_replace(lower(coalesce({t}, '')), '[^a-z0-9 ]', '', 'g'), ' +', ' ', 'g'))"


def fingerprint(t: str) -> str:
    s = f"translate(lower(trim(coalesce({t}, ''))), {q(T.ACCENTED)}, {q(T.FOLDED)})"
    s = f"regexp_replace({s}, '[^\\p{{L}}\\p{{N}}\\s]', '', 'g')"
    return f"array_to_string(list_sort(list_distinct(list_filter(regexp_split_to_array({s}, '\\s+'), lambda x: x <> ''))), ' ')"


def bigrams(n: str) -> str:
    return (f"(CASE WHEN length({n}) < 2 THEN CAST([] AS VARCHAR[]) ELSE "
            f"list_distinct(list_transform(range(1, length({n})), lambda i: substr({n}, i, 2))) END)")


def dice(na: str, nb: str, ga: str, gb: str) -> str:
    return (f"(CASE WHEN {na} = {nb} THEN {dbl(1.0)} WHEN len({ga}) + len({gb}) = 0 THEN {dbl(0.0)} "
            f"ELSE CAST(len(list_intersect({ga}, {gb})) AS DOUBLE) * {dbl(2.0)} / CAST(len({ga}) + len({gb}) AS DOUBLE) END)")


def scoring_text(title: str = "title", content: str = "content") -> str:
    return f"lower(coalesce({title}, '') || ' ' || coalesce({content}, ''))"


def inline_score(txt: str, weights: dict[str, float]) -> str:
    terms = [f"(CASE WHEN contains({txt}, {q(k.lower())}) THEN {dbl(w)} ELSE {dbl(0.0)} END)" for k, w in weights.items()]
    return "(" + " + ".join([dbl(0.0)] + terms) + ")"


def layer1(pos: str, neg: str) -> str:
    return f"greatest({dbl(0.0)}, CAST({pos} - {neg} AS DOUBLE))"


def keyword_matches(keywords, title="title", content="content") -> str:
    tl, cl = f"lower(coalesce({title}, ''))", f"lower(coalesce({content}, ''))"
    items = ", ".join(
        f"CASE WHEN contains({tl}, {q(k.lower())}) OR contains({cl}, {q(k.lower())}) THEN {q(k)} END" for k in keywords
    )
    return f"list_filter([{items}], lambda x: x IS NOT NULL)"


def heuristic_category(title: str = "title") -> str:
    t = f"lower(coalesce({title}, ''))"
    parts = []
    for cat, words in T.CATEGORY_RULES:
        cond = " OR ".join(f"contains({t}, {q(w)})" for w in words)
        parts.append(f"WHEN {cond} THEN {q(cat)}")
    return "(CASE " + " ".join(parts) + f" ELSE {q(T.UNCATEGORIZED)} END)"


def blend(l1: str, l2: str, w1: float = 0.7, w2: float = 0.3) -> str:
    return f"CAST(round(CAST({l1} AS DOUBLE) * {dbl(w1)} + CAST(coalesce({l2}, 0) AS DOUBLE) * {dbl(w2)}) AS BIGINT)"


def collapse_ws(x: str) -> str:
    return f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"


def canonical_url(u: str) -> str:
    """S6 (strict mode) with the same regular expressions as the Spark side."""
    r = q(U.URL_RE)
    scheme = f"lower(regexp_extract({u}, {r}, 1))"
    hostport = f"regexp_replace(regexp_extract({u}, {r}, 2), '^.*@', '')"
    host = f"lower(regexp_extract({hostport}, '^(\\[[^\\]]*\\]|[^:]*)', 1))"
    port = f"regexp_extract({hostport}, ':([0-9]+)$', 1)"
    path = f"regexp_extract({u}, {r}, 3)"
    nets = ", ".join(q(s) for s in U.NETWORK_SCHEMES)
    port_txt = (f"(CASE WHEN {port} = '' OR ({scheme} = 'http' AND {port} = '80') OR ({scheme} = 'https' AND {port} = '443') "
                f"THEN '' ELSE ':' || {port} END)")
    origin = f"(CASE WHEN {scheme} IN ({nets}) THEN {scheme} || '://' || {host} || {port_txt} ELSE 'null' END)"
    valid = f"coalesce(regexp_matches({u}, {r}) AND {host} <> '', false)"
    return f"(CASE WHEN {valid} THEN {origin} || regexp_replace({path}, '/$', '') ELSE coalesce({u}, '') END)"


def is_valid_url(u: str) -> str:
    r = q(U.URL_RE)
    hostport = f"regexp_replace(regexp_extract({u}, {r}, 2), '^.*@', '')"
    host = f"lower(regexp_extract({hostport}, '^(\\[[^\\]]*\\]|[^:]*)', 1))"
    return f"coalesce(regexp_matches({u}, {r}) AND {host} <> '', false)"


def articles_cte() -> str:
    """The test binding of ``documents`` as the CTE ``articles``."""
    title = "split_part(text, '.', 1)"
    return f"""articles_src AS (
  SELECT doc_id, text, lang, source, n_chars, {title} AS title FROM documents
), articles AS (
  SELECT CAST(doc_id AS VARCHAR) AS id, title,
         'https://' || source || '.example/' || md5({norm_title('title')}) || '?d=' || CAST(doc_id AS VARCHAR) AS url,
         source,
         substr(text, length(title) + 2) AS content,
         strftime(TIMESTAMP '{TD.EPOCH_START}' + to_hours(CAST(doc_id AS INTEGER)), '%Y-%m-%dT%H:%M:%S.%gZ') AS published_at,
         TIMESTAMP '{TD.EPOCH_START}' + to_hours(CAST(doc_id AS INTEGER)) AS published_ts,
         CAST(doc_id AS BIGINT) AS ord, lang
  FROM articles_src
)"""


def survivor_cte(name: str, src: str, keys: list[str], key_expr: str, key_name: str) -> str:
    """M8 in SQL: first row with content else first row per key; ord := min(ord)."""
    part = ", ".join(keys + [key_name])
    return f"""{name}_k AS (SELECT *, {key_expr} AS {key_name} FROM {src}),
{name}_r AS (
  SELECT *, row_number() OVER (PARTITION BY {part} ORDER BY (coalesce(content, '') = ''), ord) AS _rn,
         min(ord) OVER (PARTITION BY {part}) AS _first
  FROM {name}_k
), {name} AS (SELECT * EXCLUDE (_rn, _first, ord, {key_name}), _first AS ord FROM {name}_r WHERE _rn = 1)"""


def greedy_fold_ctes(name: str, src: str, group: str, order: str, threshold: float, replace: bool) -> str:
    """D3 as a recursive CTE: the greedy leader loop, one item per step per group.

    ``src`` must provide columns ``{group}``, ``ord``, ``norm``, ``has``.
    Produces ``{name}`` with one row per surviving slot: group, ``slot``
    (1-based), the slot holder's ``ord``; and ``{name}_members`` mapping every
    item's ``ord`` to its slot's leader ``ord`` (without replacement only).
    """
    t = dbl(threshold)
    x_struct = "STRUCT(ord BIGINT, norm VARCHAR, grams VARCHAR[], has BOOLEAN)"
    sim = f"list_transform(f.acc, lambda l: {dice('l.norm', 'i.x.norm', 'l.grams', 'i.x.grams')} >= {t})"
    if replace:
        step = ("CASE WHEN s.idx = 0 THEN list_append(s.acc, s.x) "
                "WHEN NOT s.acc[s.idx].has AND s.x.has THEN list_transform(s.acc, lambda l, k: CASE WHEN k = s.idx THEN s.x ELSE l END) "
                "ELSE s.acc END")
    else:
        step = "CASE WHEN s.idx = 0 THEN list_append(s.acc, s.x) ELSE s.acc END"
    member = "CASE WHEN s.idx = 0 THEN s.x.ord ELSE s.acc[s.idx].ord END"
    return f"""{name}_items AS (
  SELECT {group}, row_number() OVER (PARTITION BY {group} ORDER BY {order}) AS step,
         {{'ord': ord, 'norm': norm, 'grams': {bigrams('norm')}, 'has': has}}::{x_struct} AS x
  FROM {src}
), {name}_fold AS (
  SELECT {group}, CAST(0 AS BIGINT) AS step, CAST([] AS {x_struct}[]) AS acc, CAST(NULL AS BIGINT) AS item_ord, CAST(NULL AS BIGINT) AS leader_ord
  FROM (SELECT DISTINCT {group} FROM {name}_items)
  UNION ALL
  SELECT s.{group}, s.step, {step}, s.x.ord, {member}
  FROM (
    SELECT f.{group}, i.step, f.acc, i.x, coalesce(list_position({sim}, true), 0) AS idx
    FROM {name}_fold f JOIN {name}_items i ON i.{group} = f.{group} AND i.step = f.step + 1
  ) s
), {name}_last AS (
  SELECT f.{group}, f.acc FROM {name}_fold f
  JOIN (SELECT {group}, max(step) AS ms FROM {name}_fold GROUP BY {group}) m ON f.{group} = m.{group} AND f.step = m.ms
), {name} AS (
  SELECT {group}, CAST(slot AS BIGINT) AS slot, r.ord AS ord FROM (
    SELECT {group}, unnest(acc) AS r, unnest(range(1, len(acc) + 1)) AS slot FROM {name}_last)
), {name}_members AS (
  SELECT {group}, item_ord, leader_ord FROM {name}_fold WHERE item_ord IS NOT NULL
)"""
