"""URL column functions.

The canonical key is computed with regular expressions that Java and RE2
read alike, so the same key is produced by the SQL oracle.  What is kept of
the WHATWG URL parser: lower-case scheme and host, user info dropped,
default ports (80 for http, 443 for https) dropped, query and fragment
dropped, one trailing '/' removed from the path, and the literal text
'null' as the origin of non-network schemes.  What is not: IDNA host
encoding, percent-encoding and dot-segment resolution.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

URL_RE = r"^([A-Za-z][A-Za-z0-9+.\-]*)://([^/?#]*)([^?#]*)(\?[^#]*)?"
NETWORK_SCHEMES = ("http", "https", "ftp", "ws", "wss")


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def url_parts(url) -> dict[str, Column]:
    u = _c(url)
    scheme = F.lower(F.regexp_extract(u, URL_RE, 1))
    authority = F.regexp_extract(u, URL_RE, 2)
    hostport = F.regexp_replace(authority, r"^.*@", "")
    host = F.lower(F.regexp_extract(hostport, r"^(\[[^\]]*\]|[^:]*)", 1))
    port = F.regexp_extract(hostport, r":([0-9]+)$", 1)
    path = F.regexp_extract(u, URL_RE, 3)
    query = F.regexp_extract(u, URL_RE, 4)
    return {"scheme": scheme, "host": host, "port": port, "path": path, "query": query}


def is_valid_url(url) -> Column:
    """True when the text parses as an absolute URL with a host."""
    u = _c(url)
    p = url_parts(u)
    return F.coalesce(u.rlike(URL_RE) & (p["host"] != F.lit("")), F.lit(False))


def canonical_url(url, strict: bool = True, keep_query: bool = False, fallback_key=None) -> Column:
    """Origin + path minus one trailing '/'; unparsable -> the raw text.

    ``strict=True`` keeps the reference's behaviour: every empty url is one key.
    ``strict=False`` gives an empty url its own key (``fallback_key``, e.g. the
    row's position) and can keep the query string.
    """
    u = _c(url)
    p = url_parts(u)
    default_port = ((p["scheme"] == "http") & (p["port"] == "80")) | ((p["scheme"] == "https") & (p["port"] == "443"))
    port = F.when((p["port"] == "") | default_port, F.lit("")).otherwise(F.concat(F.lit(":"), p["port"]))
    origin = F.when(
        p["scheme"].isin(*NETWORK_SCHEMES), F.concat(p["scheme"], F.lit("://"), p["host"], port)
    ).otherwise(F.lit("null"))
    key = F.concat(origin, F.regexp_replace(p["path"], "/$", ""))
    if keep_query and not strict:
        key = F.concat(key, p["query"])
    out = F.when(is_valid_url(u), key).otherwise(F.coalesce(u, F.lit("")))
    if not strict:
        fb = F.lit("") if fallback_key is None else _c(fallback_key).cast("string")
        out = F.when(F.coalesce(u, F.lit("")) == "", F.concat(F.lit("\u0000empty:"), fb)).otherwise(out)
    return out


def _without_dots(url: Column) -> Column:
    """``.`` and ``..`` segments of an absolute url's path resolved; query and fragment stay."""
    origin = F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)", 1)
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1)
    rest = F.substring(url, F.length(origin) + F.length(path) + 1, F.length(url))
    parts = F.slice(F.split(path, "/"), 2, F.length(path))  # the path starts with a slash
    # a last segment that is a dot segment leaves its directory
    parts = F.when(F.element_at(parts, -1).isin(".", ".."), F.concat(parts, F.array(F.lit("")))).otherwise(parts)
    kept = F.aggregate(
        parts, F.array().cast("array<string>"),
        lambda acc, s: F.when(s == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).when(s == ".", acc).otherwise(F.array_append(acc, s)))
    dotted = path.rlike(r"/\.\.?(/|$)")
    return F.when(dotted, F.concat(origin, F.lit("/"), F.array_join(kept, "/"), rest)).otherwise(url)


def resolve_url(href, base) -> Column:
    """An href with a scheme of its own is kept; '/x' is joined to the base
    origin, other relative ones to the base directory, and dot segments are resolved; no href -> base."""
    h, b = _c(href), _c(base)
    base_origin = F.regexp_extract(b, r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)", 1)
    base_dir = F.regexp_extract(b, r"^([A-Za-z][A-Za-z0-9+.\-]*://[^?#]*/)", 1)
    base_dir = F.when(base_dir == "", F.concat(base_origin, F.lit("/"))).otherwise(base_dir)
    return (
        F.when(F.coalesce(h, F.lit("")) == "", b)
        .when(h.startswith("http") | h.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), h)
        .when(h.startswith("//"), F.concat(F.regexp_extract(b, r"^([A-Za-z][A-Za-z0-9+.\-]*:)", 1), h))
        .when(h.startswith("/"), _without_dots(F.concat(base_origin, h)))
        .when(h.startswith("?") | h.startswith("#"), F.concat(F.regexp_replace(b, r"[?#].*$", ""), h))
        .otherwise(_without_dots(F.concat(base_dir, h)))
    )
