"""Due subscriptions (F12), a table job replacing the reference's scheduler loop.

One ``when`` chain over the subscription table with an ``as_of`` parameter:
inactive -> not due; never run -> due; ``daily`` with a time -> due when
the run's HH:mm (text) is >= the time and the last run's UTC date is not
today; otherwise due when at least 24 hours passed since the last run.
Both the clock time and the dates are UTC.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from digestry.functions import dates as D


def due(subs: DataFrame, as_of: str) -> DataFrame:
    now = D.as_of_literal(as_of)
    last = D.parse_instant(F.col("last_run"))
    hhmm = F.date_format(now, "HH:mm")
    never = F.coalesce(F.col("last_run"), F.lit("")) == ""
    daily = (F.col("cron") == "daily") & (F.coalesce(F.col("scheduled_time"), F.lit("")) != "")
    ran_today = F.date_format(last, "yyyy-MM-dd") == F.date_format(now, "yyyy-MM-dd")
    rule = (
        F.when(F.coalesce(F.col("active"), F.lit(0)) == 0, F.lit(False))
        .when(never, F.lit(True))
        .when(daily, (hhmm >= F.col("scheduled_time")) & ~F.coalesce(ran_today, F.lit(False)))
        .otherwise(F.coalesce(D.hours_between(now, last) >= F.lit(24.0), F.lit(False)))
    )
    return subs.withColumn("due", rule)


def due_groups(subs: DataFrame, as_of: str, group_cols: Sequence[str]) -> DataFrame:
    """The groups that a due subscription asks for, once each (``groups`` of a digest run)."""
    return due(subs, as_of).where("due").select(*group_cols).distinct()


def record_runs(subs: DataFrame, as_of: str, finished: DataFrame, group_cols: Sequence[str]) -> DataFrame:
    """``subs`` after a run: those that were due and whose group is in ``finished`` have run at ``as_of``;
    one whose digest failed stays due."""
    done = finished.select(*[F.col(c).alias(f"_g{i}") for i, c in enumerate(group_cols)]).distinct().withColumn("_done", F.lit(True))
    same = F.lit(True)
    for i, c in enumerate(group_cols):
        same = same & F.col(c).eqNullSafe(F.col(f"_g{i}"))
    ran = F.col("due") & F.coalesce("_done", F.lit(False))
    now = F.concat(F.date_format(D.as_of_literal(as_of), "yyyy-MM-dd'T'HH:mm:ss.SSS"), F.lit("Z"))
    out = due(subs, as_of).join(done, same, "left")
    return out.withColumn("last_run", F.when(ran, now).otherwise(F.col("last_run"))).select(*subs.columns)
