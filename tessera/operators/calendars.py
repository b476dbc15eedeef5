"""Business days, and the next slot of a daily timetable that has another one for days off."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def nth_weekday(day: Column, month: int, weekday: int, n: int) -> Column:
    """Whether a day is the n-th such weekday (Monday is 0) of a month; the last one for n = -1."""
    of = (F.month(day) == month) & (F.weekday(day) == weekday)
    return of & ((F.dayofmonth(day) > F.dayofmonth(F.last_day(day)) - 7) if n < 0 else (F.ceil(F.dayofmonth(day) / 7) == n))


def is_holiday(day: Column) -> Column:
    """Public holidays by their rules: fixed days, and n-th weekdays of a month."""
    fixed = F.date_format(day, "MM-dd").isin("01-01", "07-04", "11-11", "12-25", "12-26")
    moving = [nth_weekday(day, 1, 0, 3), nth_weekday(day, 2, 0, 3), nth_weekday(day, 5, 0, -1), nth_weekday(day, 9, 0, 1), nth_weekday(day, 11, 3, 4), nth_weekday(F.date_sub(day, 1), 11, 3, 4)]
    for m in moving:
        fixed = fixed | m
    return fixed


def calendar(spark: SparkSession, first: str, last: str, business: list[str], off: list[str], holidays: DataFrame | None = None) -> DataFrame:
    """(day, is_business_day, slots, next_first): a row for each day, its slots as timestamps and the first one of the next day. Further holidays: day."""
    days = spark.range(1).select(F.explode(F.sequence(F.lit(first).cast("date"), F.date_add(F.lit(last).cast("date"), 1))).alias("day"))
    free = (F.weekday("day") >= 5) | is_holiday(F.col("day"))
    if holidays is not None:
        days = days.join(F.broadcast(holidays.select("day", F.lit(True).alias("more")).distinct()), "day", "left")  # days of a calendar
        free = free | F.coalesce("more", F.lit(False))
    at = lambda times: F.array(*[F.to_timestamp(F.concat_ws(" ", F.col("day").cast("string"), F.lit(t))) for t in sorted(times)])
    days = days.select("day", (~free).alias("is_business_day"), F.when(free, at(off)).otherwise(at(business)).alias("slots"))
    following = days.select(F.date_sub("day", 1).alias("day"), F.get("slots", 0).alias("next_first"))
    return days.join(following, "day")


def next_slot(events: DataFrame, at: str, days: DataFrame) -> DataFrame:
    """events with next_slot: the first slot after their time, on the same day or the first of the next. The calendar has a row a day and is joined by day."""
    after = F.get(F.filter("slots", lambda s: s > F.col(at)), 0)
    joined = events.withColumn("day", F.to_date(at)).join(F.broadcast(days), "day", "left")
    return joined.withColumn("next_slot", F.coalesce(after, "next_first")).drop("day", "slots", "next_first")
