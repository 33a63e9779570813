"""digestry: signal digests built as Spark DataFrame jobs.

Every operator is a ``DataFrame -> DataFrame`` function.  Operators that rank,
cut or deduplicate accept ``group_cols`` so that many digests (per date,
tenant, language, ...) are computed in one job; an empty ``group_cols`` gives
the single-digest semantics.
"""

from digestry.params import DigestParams

__all__ = ["DigestParams"]
