"""Working time between moments: a day table with running totals, joined by day; no UDF."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.operators.measures import _ratio
from tablewright.plans.settings import Calendar

#: Days a table may span; 200 years of days are about 2 MB, which is what is broadcast.
MAX_DAYS = 366 * 200


def day_table(spark: SparkSession, first: str, last: str, calendar: Calendar, holidays: DataFrame | None = None) -> DataFrame:
    """day, works (0 or 1), before (working days since the first day, this one not counted)."""
    days = spark.sql(f"select explode(sequence(date'{first}', date'{last}')) as day")
    works = F.element_at(F.array(*[F.lit(int(d)) for d in calendar.days]), F.weekday("day") + 1)
    days = days.withColumn("works", works)
    if holidays is not None:
        off = holidays.select(F.col("holiday_date").cast("date").alias("day")).distinct().withColumn("off", F.lit(1))
        days = days.join(off, "day", "left").withColumn("works", F.when(F.col("off").isNull(), F.col("works")).otherwise(0)).drop("off")
    rows, total = [], 0
    for r in days.orderBy("day").collect():  # one row a day, at most MAX_DAYS
        rows.append((r["day"], r["works"], total))
        total += r["works"]
    if len(rows) > MAX_DAYS:
        raise ValueError("the calendar spans too many days")
    return spark.createDataFrame(rows, "day date, works int, before int")


def _seconds_of_day(c: Column) -> Column:
    return F.hour(c) * 3600 + F.minute(c) * 60 + F.second(c)


def _at(c: Column, works: Column, before: Column, calendar: Calendar) -> Column:
    """Working seconds since the first day of the table."""
    opens = calendar.start.hour * 3600 + calendar.start.minute * 60 + calendar.start.second
    own = F.least(F.greatest(_seconds_of_day(c) - opens, F.lit(0)), F.lit(calendar.day_seconds))
    return (before * calendar.day_seconds + works * own).cast("long")


def turnaround(df: DataFrame, start: str, end: str, calendar: Calendar | None = None, holidays: DataFrame | None = None, *, out: str = "tat_hours") -> DataFrame:
    """Add the working hours from start to end; NULL where either is NULL or end comes first."""
    calendar = calendar or Calendar()
    span = df.agg(F.least(F.min(start), F.min(end)).cast("date").alias("a"), F.greatest(F.max(start), F.max(end)).cast("date").alias("b")).first()
    if span["a"] is None:
        return df.withColumn(out, F.lit(None).cast("double"))
    days = F.broadcast(day_table(df.sparkSession, str(span["a"]), str(span["b"]), calendar, holidays))
    joined = df
    for side, c in (("s", start), ("e", end)):
        own = days.select(*[F.col(x).alias(f"_{side}_{x}") for x in days.columns])
        joined = joined.join(own, F.col(c).cast("date") == F.col(f"_{side}_day"), "left")
    seconds = _at(F.col(end), F.col("_e_works"), F.col("_e_before"), calendar) - _at(F.col(start), F.col("_s_works"), F.col("_s_before"), calendar)
    joined = joined.withColumn(out, F.when(F.col(end) >= F.col(start), seconds / 3600.0))
    return joined.drop(*[f"_{s}_{x}" for s in "se" for x in days.columns])


def with_sla(df: DataFrame, calendar: Calendar | None = None, *, priority: str = "priority") -> DataFrame:
    """Add sla_hours, and in_time where both hours are known."""
    targets = (calendar or Calendar()).sla
    hours = F.element_at(F.create_map(*[x for k, v in targets.items() for x in (F.lit(k), F.lit(float(v)))]), F.lower(F.col(priority)))
    return df.withColumn("sla_hours", hours).withColumn("in_time", F.col("tat_hours") <= F.col("sla_hours"))


def add_hours(df: DataFrame, start: str, hours: str, calendar: Calendar | None = None, holidays: DataFrame | None = None, *, out: str = "due_at", horizon_days: int = 366) -> DataFrame:
    """Add the moment at which so many working hours from start have passed: the day by its running total, then the time."""
    calendar = calendar or Calendar()
    span = df.agg(F.min(start).cast("date").alias("a"), F.max(start).cast("date").alias("b")).first()
    if span["a"] is None:
        return df.withColumn(out, F.lit(None).cast("timestamp_ntz"))
    import datetime

    days = day_table(df.sparkSession, str(span["a"]), str(span["b"] + datetime.timedelta(days=horizon_days)), calendar, holidays)
    own = F.broadcast(days.select(*[F.col(x).alias(f"_s_{x}") for x in days.columns]))
    due = F.broadcast(days.where("works = 1").select(F.col("before").alias("_d_before"), F.col("day").alias("_d_day")))
    at = df.join(own, F.col(start).cast("date") == F.col("_s_day"), "left")
    at = at.withColumn("_want", _at(F.col(start), F.col("_s_works"), F.col("_s_before"), calendar) + F.round(F.col(hours) * 3600).cast("long"))
    at = at.withColumn("_d", F.expr(f"int((greatest(_want, 1) - 1) div {calendar.day_seconds})")).join(due, F.col("_d") == F.col("_d_before"), "left")
    opens = calendar.start.hour * 3600 + calendar.start.minute * 60
    inside = F.col("_want") - F.col("_d") * calendar.day_seconds + opens
    moment = F.timestamp_seconds(F.unix_timestamp(F.col("_d_day").cast("timestamp")) + inside).cast("timestamp_ntz")
    return at.withColumn(out, moment).drop("_want", "_d", "_d_before", "_d_day", *[f"_s_{x}" for x in days.columns])


def compliance(df: DataFrame) -> Column:
    return _ratio(F.count_if("in_time"), F.count_if(F.col("in_time").isNotNull()), 100.0)
