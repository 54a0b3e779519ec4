"""Date and time expressions on timestamps without time zone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def time_bucket(ts: Column, minutes: int) -> Column:
    """Start of the bucket: the hour plus whole multiples of ``minutes`` inside it."""
    back = F.make_dt_interval(F.lit(0), F.lit(0), F.minute(ts) % minutes, F.extract(F.lit("SECOND"), ts))
    return ts - back


def minute_of_day(ts: Column) -> Column:
    return F.hour(ts) * 60 + F.minute(ts)


def date_parts(ts: Column, minutes: int = 5) -> dict[str, Column]:
    """Weekday (Monday 0), month, date, minute of day and bucket start."""
    bucket = time_bucket(ts, minutes)
    return {
        "day_of_week": F.weekday(ts), "month": F.month(ts), "date": F.to_date(ts),
        "minute_of_day": minute_of_day(ts), "bucket": bucket,
    }


# Rush hours in minutes of the day, both ends included.
RUSH_WINDOWS = [(7 * 60, 9 * 60), (16 * 60, 19 * 60)]


def calendar_flags(bucket: Column, holidays: list[str]) -> dict[str, Column]:
    """Weekend, holiday and rush-hour flags of a bucket start."""
    m = minute_of_day(bucket)
    rush = F.lit(False)
    for lo, hi in RUSH_WINDOWS:
        rush = rush | m.between(lo, hi)
    return {
        "is_weekend": F.weekday(bucket) >= 5,
        "is_holiday": F.to_date(bucket).isin([F.lit(h).cast("date") for h in holidays]),
        "is_rushhour": rush,
    }


def parse_date(text: Column, *formats: str) -> Column:
    """First format that fits; NULL if none does.

    Two-digit years from 69 on belong to the twentieth century.
    """
    def read(f):
        ts = F.try_to_timestamp(text, F.lit(f)).cast("timestamp_ntz")
        if "yy" in f and "yyyy" not in f:
            ts = F.when(F.year(ts) >= 2069, F.add_months(ts, -1200).cast("timestamp_ntz")
                        + F.make_dt_interval(F.lit(0), F.hour(ts), F.minute(ts), F.second(ts))).otherwise(ts)
        return ts

    return F.coalesce(*[read(f) for f in formats])


def parse_duration(text: Column) -> Column:
    """``'h:mm'`` as minutes."""
    parts = F.split(text, ":")
    return F.try_element_at(parts, F.lit(1)).try_cast("int") * 60 + F.try_element_at(parts, F.lit(2)).try_cast("int")


def add_minutes(ts: Column, minutes: Column) -> Column:
    return ts + F.make_dt_interval(F.lit(0), F.lit(0), minutes, F.lit(0))


def clock_label(ts: Column) -> Column:
    """``'hh:mm a.m.'`` with 12 for midnight and noon, hours without leading zero."""
    hour = F.hour(ts)
    twelve = F.when(hour % 12 == 0, 12).otherwise(hour % 12)
    return F.concat(twelve.cast("string"), F.lit(":"), F.lpad(F.minute(ts).cast("string"), 2, "0"),
                    F.when(hour < 12, " a.m.").otherwise(" p.m."))


def date_index(df: DataFrame, ts: str) -> DataFrame:
    """Days since the first date of the table and minutes since midnight."""
    first = df.agg(F.min(F.to_date(ts))).scalar()
    return df.withColumn("date_idx", F.datediff(F.to_date(ts), first)).withColumn("time_idx", minute_of_day(F.col(ts)))
