"""Date and time expressions.

All of them read a TIMESTAMP_NTZ column and never touch the session time zone, so a job
gives the same result on any cluster. ``wall_clock`` brings other inputs to that form.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from needledrop.config import MICROS_PER_DAY, MICROS_PER_MINUTE

# Day parts as half-open ranges of seconds since midnight.
MORNING = (21_600, 43_200)
AFTERNOON = (43_200, 64_800)
EVENING = (64_800, 79_200)
NIGHT_FROM, NIGHT_TO = 79_200, 21_600
SECONDS_PER_DAY = 86_400

# English day names in the order of Spark's dayofweek (Sunday is 1).
DAY_NAMES = ("Sunday", "Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday")

TEMPORAL_COLUMNS = (
    "year",
    "month",
    "day",
    "day_of_week",
    "is_weekend",
    "is_morning",
    "is_afternoon",
    "is_evening",
    "is_night",
    "time_of_day_sin",
    "time_of_day_cos",
)


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


# A time of day and then a zone: Z, an offset with or without colon, or a name.
_ZONED = r"\d:\d{2}.*(Z|[+-]\d{1,2}(:?\d{2})?|[A-Za-z]{2,}[A-Za-z/_+-]*\d*)$"


def _instant_utc(instant: Column) -> Column:
    seconds = (F.unix_micros(instant).cast("decimal(24,0)") / F.lit(1_000_000)).cast("decimal(18,6)")
    epoch = F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'")
    return epoch + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds)


def wall_clock(df: DataFrame, ts: str = "ts") -> DataFrame:
    """Return ``df`` with ``ts`` as TIMESTAMP_NTZ in UTC."""
    kind = df.schema[ts].dataType
    if isinstance(kind, T.TimestampNTZType):
        return df
    if isinstance(kind, T.TimestampType):
        return df.withColumn(ts, _instant_utc(F.col(ts)))
    if isinstance(kind, T.DateType):
        return df.withColumn(ts, F.col(ts).cast("timestamp_ntz"))
    if isinstance(kind, T.StringType):
        # Text with a zone is an instant, text without one is UTC already. What is neither becomes
        # null and is reported by operators.columns.reject_null_keys.
        text = F.trim(F.col(ts))
        zoned = text.rlike(_ZONED)
        colon = F.regexp_replace(text, r"([+-]\d{2})(\d{2})$", "$1:$2")
        instant = F.when(zoned, colon.try_cast("timestamp"))
        return df.withColumn(ts, F.when(zoned, _instant_utc(instant)).otherwise(text.try_cast("timestamp_ntz")))
    raise TypeError(f"column {ts} of type {kind.simpleString()} is not a point in time")


def calendar_day(ts: Column | str) -> Column:
    return F.to_date(_col(ts))


def seconds_of_day(ts: Column | str) -> Column:
    """Whole seconds since midnight; the fraction is dropped."""
    c = _col(ts)
    return F.hour(c) * 3600 + F.minute(c) * 60 + F.second(c)


def micros(ts: Column | str) -> Column:
    """Microseconds since 1970-01-01 00:00 of the wall clock, as BIGINT."""
    c = _col(ts)
    in_minute = (F.date_part(F.lit("SECOND"), c) * 1_000_000).cast("bigint")
    minutes = (F.hour(c) * 60 + F.minute(c)).cast("bigint")
    days = F.unix_date(F.to_date(c)).cast("bigint")
    return days * MICROS_PER_DAY + minutes * MICROS_PER_MINUTE + in_minute


def floor_div(value: Column | str, step: int) -> Column:
    """Integer division rounding down, also below zero."""
    v = _col(value)
    s = F.lit(step).cast("bigint")
    return F.call_function("div", v - F.pmod(v, s), s)


def _flag(condition: Column) -> Column:
    return condition.cast("tinyint")


def temporal_features(ts: Column | str) -> dict[str, Column]:
    """The eleven calendar columns, by name, plus the corrected night flag."""
    c = _col(ts)
    s = seconds_of_day(c)
    dow = F.dayofweek(F.to_date(c))
    angle = 2 * F.pi() * s / F.lit(float(SECONDS_PER_DAY))

    def between(span: tuple[int, int]) -> Column:
        return _flag((s >= span[0]) & (s < span[1]))

    return {
        "year": F.year(c),
        "month": F.month(c),
        "day": F.dayofmonth(c),
        "day_of_week": F.element_at(F.array(*[F.lit(n) for n in DAY_NAMES]), dow),
        "is_weekend": _flag(dow.isin(1, 7)),
        "is_morning": between(MORNING),
        "is_afternoon": between(AFTERNOON),
        "is_evening": between(EVENING),
        # Parity: the original condition holds for every time of day.
        "is_night": _flag(s.isNotNull()),
        "time_of_day_sin": F.sin(angle),
        "time_of_day_cos": F.cos(angle),
        "is_night_corrected": _flag((s >= NIGHT_FROM) | (s < NIGHT_TO)),
    }


def with_temporal_features(df: DataFrame, ts: str = "ts", corrected: bool = False) -> DataFrame:
    """Put the calendar columns in front of the others, in their fixed order."""
    cols = temporal_features(ts)
    names = list(TEMPORAL_COLUMNS) + (["is_night_corrected"] if corrected else [])
    rest = [c for c in df.columns if c not in names]
    return df.select(*[cols[n].alias(n) for n in names], *rest)


# Nanosecond timestamps reach from 1677-09-21 to 2262-04-11, so dates outside
# have no year in the original either.
FIRST_DATE, LAST_DATE = "1677-09-22", "2262-04-11"


def release_year(text: Column | str) -> Column:
    """Year of a ``YYYY``, ``YYYY-MM`` or ``YYYY-MM-DD`` release date, else null."""
    t = F.trim(_col(text))
    full = (
        F.when(t.rlike(r"^\d{4}$"), F.concat(t, F.lit("-01-01")))
        .when(t.rlike(r"^\d{4}-\d{2}$"), F.concat(t, F.lit("-01")))
        .when(t.rlike(r"^\d{4}-\d{2}-\d{2}$"), t)
    )
    day = full.try_cast("date")
    inside = day.between(F.lit(FIRST_DATE).cast("date"), F.lit(LAST_DATE).cast("date"))
    return F.when(inside, F.year(day))
