"""Full timestamps from (day of month, hour), in order."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from swellworks.functions.text import let

MONTHS = 13  # how many months ahead a day is sought


def next_time(threshold: Column, day: Column, hour: Column) -> Column:
    """The earliest time at or after threshold with this day and hour, in its month or the 13 after; null if there is none."""

    def at(month: Column, k: Column) -> Column:
        made = let(F.add_months(month, k), lambda m: F.try_make_timestamp(F.year(m), F.month(m), day, hour, F.lit(0), F.lit(0)))
        return let(made, lambda c: F.when(c >= threshold, c))

    def search(month: Column) -> Column:
        later = F.transform(F.sequence(F.lit(2), F.lit(MONTHS)), lambda k: at(month, k))
        # nearly every row ends in the first two months; coalesce evaluates no more than it needs
        return F.coalesce(at(month, F.lit(0)), at(month, F.lit(1)), F.try_element_at(F.filter(later, lambda c: c.isNotNull()), F.lit(1)))

    return F.when(day.between(1, 31) & hour.between(0, 23), let(F.trunc(threshold, "MM"), search))


def timeline(start: Column, rows: Column) -> Column:
    """Timestamps (null where none fits) of an array of structs with ``d`` and ``h``; each at or after the last that fitted.

    A fold within the row: no shuffle, no window, and a row that fits nowhere leaves the state as it is.
    """
    first = F.struct(start.alias("prev"), F.array().cast("array<timestamp>").alias("out"))

    def step(acc: Column, row: Column) -> Column:
        return let(next_time(acc.prev, row.d, row.h), lambda ts: F.struct(F.coalesce(ts, acc.prev).alias("prev"), F.concat(acc.out, F.array(ts)).alias("out")))

    return F.aggregate(rows, first, step, lambda acc: acc.out)
