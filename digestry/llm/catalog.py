"""The registered queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from digestry.llm import chat, collocations, html_extract, language, mixing, packing, quality, secrets, simhash, topk, url_rules, warc, whitening

_MODULES = (html_extract, packing, chat, url_rules, simhash, quality, topk, mixing, secrets, language, warc, whitening, collocations)

QUERIES = {name: fn for m in _MODULES for name, fn in m.QUERIES.items()}
ORACLE = {name: sql for m in _MODULES for name, sql in m.ORACLE.items()}
