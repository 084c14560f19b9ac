"""Market sessions: rule-based exchange calendar, session ordinals, offsets.

A calendar holds one row per session, so its size is bounded by the length of
history (about 252 rows a year).  That bound is what makes the explicit
``broadcast`` and the single unpartitioned window below safe at any data size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

EXCHANGE_ZONE = "America/New_York"


def _nth_weekday(year: Column, month: int, weekday: int, n: int) -> Column:
    """n-th given weekday (0 = Monday) of a month."""
    first = F.make_date(year, F.lit(month), F.lit(1))
    shift = F.pmod(F.lit(weekday) - F.weekday(first), F.lit(7)) + 7 * (n - 1)
    return F.date_add(first, shift.cast("int"))


def _last_weekday(year: Column, month: int, weekday: int) -> Column:
    last = F.last_day(F.make_date(year, F.lit(month), F.lit(1)))
    return F.date_sub(last, F.pmod(F.weekday(last) - F.lit(weekday), F.lit(7)).cast("int"))


def _observed(day: Column) -> Column:
    """A Saturday holiday moves to Friday, a Sunday one to Monday."""
    wd = F.weekday(day)
    return F.when(wd == 5, F.date_sub(day, 1)).when(wd == 6, F.date_add(day, 1)).otherwise(day)


def _easter(year: Column) -> Column:
    """Gregorian Easter through the golden number and the paschal full moon."""
    golden = year % 19
    century = F.floor(year / 100)
    skipped = century - F.floor(century / 4) - F.floor((century * 8 + 13) / 25)
    moon = F.pmod(skipped + golden * 19 + 15, F.lit(30))
    full = moon - F.floor(moon / 28) * (1 - F.floor(moon / 28) * F.floor(F.lit(29) / (moon + 1)) * F.floor((21 - golden) / 11))
    weekday = F.pmod(year + F.floor(year / 4) + full + 2 - century + F.floor(century / 4), F.lit(7))
    offset = full - weekday
    month = 3 + F.floor((offset + 40) / 44)
    day = offset + 28 - 31 * F.floor(month / 4)
    return F.make_date(year, month.cast("int"), day.cast("int"))


def holidays_of(year: Column) -> Column:
    """Array of full-day closures of a year."""
    new_year = F.make_date(year, F.lit(1), F.lit(1))
    juneteenth = F.make_date(year, F.lit(6), F.lit(19))
    return F.array_compact(
        F.array(
            # 1 January on a Saturday leaves 31 December open.
            F.when(F.weekday(new_year) != 5, _observed(new_year)),
            _nth_weekday(year, 1, 0, 3),
            _nth_weekday(year, 2, 0, 3),
            F.date_sub(_easter(year), 2),
            _last_weekday(year, 5, 0),
            F.when(year >= 2022, _observed(juneteenth)),
            _observed(F.make_date(year, F.lit(7), F.lit(4))),
            _nth_weekday(year, 9, 0, 1),
            _nth_weekday(year, 11, 3, 4),
            _observed(F.make_date(year, F.lit(12), F.lit(25))),
            # One-off closure of 9 January 2025.
            F.when(year == 2025, F.make_date(year, F.lit(1), F.lit(9))),
        )
    )


def exchange_calendar(days: DataFrame, day: str = "day") -> DataFrame:
    """Keep the trading days of ``days`` and add the close in UTC.

    Early closes (13:00 local): the day after the November holiday, 3 July and
    24 December when those are sessions.
    """
    d = F.col(day)
    year = F.year(d)
    black_friday = F.date_add(_nth_weekday(year, 11, 3, 4), 1)
    early = (d == black_friday) | F.date_format(d, "MM-dd").isin("07-03", "12-24")
    hour = F.when(early, F.lit(13)).otherwise(F.lit(16))
    local = F.make_timestamp_ntz(year, F.month(d), F.dayofmonth(d), hour, F.lit(0), F.lit(0))
    return (
        days.select(d.alias(day))
        .where((F.weekday(d) < 5) & ~F.array_contains(holidays_of(year), d))
        .withColumn("early_close", early)
        .withColumn("close_utc", F.convert_timezone(F.lit(EXCHANGE_ZONE), F.lit("UTC"), local))
    )


def exchange_sessions(spark: SparkSession, first: str, last: str) -> DataFrame:
    """Numbered exchange calendar between two ISO dates."""
    days = spark.range(1).select(F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))).alias("day"))
    return number_sessions(exchange_calendar(days), "day")


def number_sessions(days: DataFrame, day: str = "session_date") -> DataFrame:
    """Ordinal of each session, from 1 (one row per session, hence one small sort)."""
    return days.withColumn("session_no", F.row_number().over(Window.orderBy(day)))


def sessions_of(bars: DataFrame, day: str = "session_date") -> DataFrame:
    """The calendar a benchmark series defines: its distinct sessions, numbered."""
    return number_sessions(bars.select(day).distinct(), day)


def attach_session_no(df: DataFrame, calendar: DataFrame, day: str = "session_date") -> DataFrame:
    """Add ``session_no``; rows off the calendar get null."""
    return df.join(F.broadcast(calendar.select(day, "session_no")), day, "left")


def session_targets(calendar: DataFrame, horizons: tuple[int, ...], day: str = "session_date") -> DataFrame:
    """Long table (session, horizon, target date); the target is null past the end."""
    w = Window.orderBy(day)
    ahead = [F.struct(F.lit(h).alias("horizon"), F.lead(day, h).over(w).alias("target_date")) for h in horizons]
    return calendar.select(day, F.array(*ahead).alias("t")).select(day, F.inline("t"))


def day_ordinals(calendar: DataFrame, day: str = "session_date") -> DataFrame:
    """One row per calendar day of the covered span: ordinal of the last session at or before it."""
    following = F.lead(day).over(Window.orderBy(day))
    spans = calendar.withColumn("_until", F.coalesce(F.date_sub(following, 1), F.col(day)))
    return spans.select(F.explode(F.sequence(F.col(day), F.col("_until"))).alias("any_day"), F.col("session_no").alias("sessions_passed"))


def shift_sessions(df: DataFrame, calendar: DataFrame, day: str, n: int, out: str) -> DataFrame:
    """Add the date of the n-th session strictly after ``day``, which need not be a session."""
    sessions = calendar.select(F.col("session_date").alias(out), F.col("session_no").alias("_no"))
    ordinals = day_ordinals(calendar)
    first = calendar.agg(F.min("session_date")).scalar()
    last_no = calendar.agg(F.max("session_no")).scalar()
    passed = F.when(F.col(day) < first, F.lit(0)).otherwise(F.coalesce("sessions_passed", last_no))
    return (
        df.join(F.broadcast(ordinals), F.col(day) == F.col("any_day"), "left")
        .withColumn("_target", F.when(F.col(day).isNotNull(), passed + n))
        .join(F.broadcast(sessions), F.col("_no") == F.col("_target"), "left")
        .drop("any_day", "sessions_passed", "_no", "_target")
    )


def latest_completed_session(calendar: DataFrame, clock: Column, close: str = "close_utc", day: str = "day") -> DataFrame:
    """One row: the newest session whose close is not after ``clock``."""
    return calendar.where(F.col(close) <= clock).agg(F.max(day).alias("session_date"), F.max(close).alias(close))


def local_day(ts: Column, zone: str) -> Column:
    """Calendar day of a UTC timestamp in another zone."""
    return F.to_date(F.convert_timezone(F.lit("UTC"), F.lit(zone), ts))


def last_session_of_weeks(calendar: DataFrame, day: str = "session_date") -> DataFrame:
    """Last session of every ISO week."""
    return calendar.groupBy(F.extract(F.lit("YEAROFWEEK"), F.col(day)).alias("iso_year"), F.weekofyear(day).alias("iso_week")).agg(
        F.max(day).alias(day)
    )


def every_nth_session(calendar: DataFrame, n: int) -> DataFrame:
    """Sessions 1, 1+n, 1+2n, … and always the last one."""
    last = calendar.agg(F.max("session_no")).scalar()
    return calendar.where((F.col("session_no") % n == 1 % n) | (F.col("session_no") == last))
