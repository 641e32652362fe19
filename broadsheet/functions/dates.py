"""Column functions on dates."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from broadsheet import fixed_values as fixed
from broadsheet.functions.text import col

ISO = "yyyy-MM-dd"


def check_bound(value: str | dt.date | None) -> dt.date | None:
    """A date bound given by the caller; anything but a real ISO date is the caller's error."""
    if value is None or isinstance(value, dt.date):
        return value
    try:
        return dt.datetime.strptime(value, "%Y-%m-%d").date()
    except ValueError as error:
        raise ValueError(f"invalid date {value!r}, expected YYYY-MM-DD") from error


def as_date(c) -> Column:
    """A date column from a date or from ISO text; text that is no date gives NULL."""
    return F.try_to_date(col(c).cast("string"), ISO)


def parse_multi_format_date(c, formats=("yyyy-MM-dd", "dd-MM-yyyy", "yyyy/MM/dd", "dd/MM/yyyy")) -> Column:
    """P12. First format that fits wins."""
    return F.coalesce(*[F.try_to_date(col(c), f) for f in formats])


def month_key(c) -> Column:
    """P13."""
    return F.date_format(col(c), "yyyy-MM")


def format_display_date(c) -> Column:
    """P15."""
    return F.date_format(col(c), "dd/MM/yyyy")


def date_from_millis(ms) -> Column:
    """UTC calendar date of an epoch in milliseconds, whatever the session time zone."""
    return F.date_from_unix_date(F.floor(col(ms) / 86_400_000).cast("int"))


def within_date_range(ts, start, end) -> Column:
    """F13. Calendar date of ``ts`` between two dates, both included; zone suffixes are ignored."""
    return F.to_date(col(ts)).between(F.lit(check_bound(start)), F.lit(check_bound(end)))


def month_chunks(spark: SparkSession, start: str, end: str) -> DataFrame:
    """S12. Month-aligned ranges that cover [start, end], the first and last clipped."""
    lo, hi = F.lit(check_bound(start)), F.lit(check_bound(end))
    months = F.sequence(F.trunc(lo, "month"), hi, F.expr("interval 1 month"))
    return (
        spark.range(1)
        .select(F.explode(months).alias("m"))
        .select(F.greatest("m", lo).alias("chunk_start"), F.least(F.last_day("m"), hi).alias("chunk_end"))
    )


def day_series(spark: SparkSession, start: str, end: str) -> DataFrame:
    """S12. One row per day of [start, end]."""
    days = F.sequence(F.lit(check_bound(start)), F.lit(check_bound(end)))
    return spark.range(1).select(F.explode(days).alias("day"))


def chunk_ranges(df: DataFrame, start: str, end: str) -> DataFrame:
    """S12 per row: one output row for each month touched by the row's own [start, end] columns."""
    lo, hi = F.col(start), F.col(end)
    months = F.sequence(F.trunc(lo, "month"), hi, F.expr("interval 1 month"))
    return df.withColumn("_m", F.explode(months)).select(
        *df.columns,
        F.greatest(F.to_date("_m"), lo).alias("chunk_start"),
        F.least(F.last_day("_m"), hi).alias("chunk_end"),
    )


def extract_dates(text, digits: str = "০১২৩৪৫৬৭৮৯") -> Column:
    """T08. ISO dates written in a text in any of four ways, distinct and sorted.

    Year 1900–2100, month 1–12, day 1–31 are checked, the calendar is not. ``digits`` are read as 0–9.
    """
    t = F.translate(col(text), digits, "0123456789")
    # the look-ahead in front of each pattern is cheap and spares the look-behind at most positions
    left, right = r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])"
    names = "|".join(fixed.MONTHS)
    gap = r"\s+"
    ymd = rf"(?=\d){left}(\d{{4}})[-/](\d{{1,2}})[-/](\d{{1,2}}){right}"
    dmy = rf"(?=\d){left}(\d{{1,2}})[-/](\d{{1,2}})[-/](\d{{4}}){right}"
    mdy = rf"(?i)(?=[adfjmnos]){left}({names}){gap}(\d{{1,2}}),?{gap}(\d{{4}}){right}"
    dmy_named = rf"(?i)(?=\d){left}(\d{{1,2}}){gap}({names}){gap}(\d{{4}}){right}"
    month_list = F.array(*[F.lit(m) for m in fixed.MONTHS])

    def iso(year: Column, month: Column, day: Column) -> Column:
        y, m, d = year.cast("int"), month.cast("int"), day.cast("int")
        valid = y.between(1900, 2100) & m.between(1, 12) & d.between(1, 31)
        return F.when(valid, F.format_string("%04d-%02d-%02d", y, m, d))

    def each(pattern: str, year: int, month: int, day: int, named: bool) -> Column:
        def one(hit: Column) -> Column:
            part = [F.regexp_extract(hit, pattern, g) for g in (1, 2, 3)]
            m = F.array_position(month_list, F.lower(part[month])) if named else part[month]
            return iso(part[year], m, part[day])

        return F.transform(F.regexp_extract_all(t, F.lit(pattern), 0), one)

    found = F.concat(
        each(ymd, 0, 1, 2, False), each(dmy, 2, 1, 0, False), each(mdy, 2, 0, 1, True), each(dmy_named, 2, 1, 0, True)
    )
    distinct = F.array_sort(F.array_distinct(F.filter(found, lambda x: x.isNotNull())))
    return F.when(t.rlike(r"\d{4}"), distinct).otherwise(F.array().cast("array<string>"))


def recency_score(date, now, window_days=None) -> Column:
    """V12. Age of an article in steps; inside the asked window 1.0, inside twice the window 0.7."""
    age = F.datediff(col(now), col(date))
    out = F.when(col(date).isNull(), 0.5)
    if window_days is not None:
        w = window_days if isinstance(window_days, Column) else F.lit(window_days)
        out = out.when(w.isNotNull() & (age <= w), 1.0).when(w.isNotNull() & (age <= w * 2), 0.7)
    for days, score in ((7, 1.0), (30, 0.8), (90, 0.6), (180, 0.4)):
        out = out.when(age <= days, score)
    return out.otherwise(0.2)


def time_window(period, days, now, start=None, end=None) -> Column:
    """V17. struct(start, end) of a named period; bounds given explicitly win when both are there."""
    n, p = col(now), col(period)
    back = F.when(p == "today", 0).when(p == "week", 7).when(p == "month", 30).when(p == "quarter", 90)
    computed = F.date_sub(n, back.otherwise(F.coalesce(col(days).cast("int"), F.lit(7))))
    none = F.lit(None).cast("date")
    s = none if start is None else col(start).cast("date")
    e = none if end is None else col(end).cast("date")
    given = s.isNotNull() & e.isNotNull()
    return F.struct(
        F.when(given, s).otherwise(computed).alias("start"),
        F.when(given, e).otherwise(n).alias("end"),
    )
