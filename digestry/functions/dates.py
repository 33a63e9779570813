"""Date and time column functions.

Instants are ``TIMESTAMP`` columns; the session time zone is UTC (see
``digestry.session``), so the ISO text below is UTC text.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

# The ISO-8601 text form produced by a JavaScript Date.
ISO_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"
# RFC-822 forms after the weekday has been stripped.
RFC822_FORMATS = ("dd MMM yyyy HH:mm:ss z", "d MMM yyyy HH:mm:ss z", "dd MMM yyyy HH:mm:ss Z", "d MMM yyyy HH:mm:ss Z")


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def to_iso(ts) -> Column:
    """Instant -> '2024-01-01T00:00:00.000Z'."""
    return F.date_format(_c(ts), ISO_FORMAT)


def epoch_seconds_to_iso(secs) -> Column:
    """``new Date(s * 1000).toISOString()``."""
    millis = F.floor(_c(secs).cast("double") * F.lit(1000.0).cast("double"))
    return to_iso(F.timestamp_millis(millis))


def parse_instant(text) -> Column:
    """ISO-8601 or RFC-822 text -> TIMESTAMP; unparsable -> null.

    The weekday is stripped first: the pattern letter 'E' is rejected by the
    parser even inside ``try_to_timestamp``.
    """
    t = F.trim(_c(text))
    stripped = F.regexp_replace(t, r"^[A-Za-z]{3}, *", "")
    tries = [F.try_to_timestamp(t)]
    tries += [F.try_to_timestamp(stripped, F.lit(fmt)) for fmt in RFC822_FORMATS]
    return F.when(F.coalesce(t, F.lit("")) == "", F.lit(None).cast("timestamp")).otherwise(F.coalesce(*tries))


def as_of_literal(as_of: str | dt.datetime) -> Column:
    """S15 / every 'now': always a parameter, never the clock."""
    if isinstance(as_of, dt.datetime):
        as_of = as_of.strftime("%Y-%m-%d %H:%M:%S")
    return F.to_timestamp(F.lit(as_of))


def digest_date(as_of) -> Column:
    """UTC date of the run."""
    return F.to_date(as_of_literal(as_of) if isinstance(as_of, (str, dt.datetime)) else _c(as_of))


def minutes_between(later, earlier) -> Column:
    """Fractional minutes between two instants."""
    return (F.unix_micros(_c(later)) - F.unix_micros(_c(earlier))).cast("double") / F.lit(6.0e7).cast("double")


def hours_between(later, earlier) -> Column:
    """Fractional hours between two instants."""
    return (F.unix_micros(_c(later)) - F.unix_micros(_c(earlier))).cast("double") / F.lit(3.6e9).cast("double")


def cutoff_instant(as_of, hours: int) -> Column:
    """Now minus N hours."""
    base = as_of_literal(as_of) if isinstance(as_of, (str, dt.datetime)) else _c(as_of)
    return base - F.make_dt_interval(F.lit(0), F.lit(hours))
