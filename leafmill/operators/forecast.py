"""Forecasts: nested slots flattened, grouped by runs of equal dates, and written in sections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SCHEMA = (
    "list array<struct<dt_txt:string,weather:array<struct<description:string>>,main:struct<temp_min:double,temp_max:double,humidity:double>,"
    "wind:struct<speed:double>,rain:struct<`3h`:double>,snow:struct<`3h`:double>>>"
)
HEADER = ("Hour", "Condition", "Min Temp (℃)", "Max Temp(℃)", "Humidity(%)", "Wind(m/s)", "Rain(mm)", "Snow(mm)")
COLUMNS = ("hour", "condition", "min_temp", "max_temp", "humidity", "wind", "rain", "snow")


def flatten_slots(frame: DataFrame, key: str, json: str) -> DataFrame:
    """One row a slot; missing precipitation is a single blank."""
    slots = frame.select(key, F.posexplode(F.from_json(json, SCHEMA)["list"]).alias("pos", "slot"))
    when = F.split("slot.dt_txt", r"\s+")
    or_blank = lambda c: F.coalesce(F.col(f"slot.{c}.`3h`").cast("string"), F.lit(" "))
    return slots.select(
        key, "pos", F.get(when, F.lit(0)).alias("date"), F.get(when, F.lit(1)).alias("hour"), F.get("slot.weather", F.lit(0))["description"].alias("condition"),
        F.col("slot.main.temp_min").alias("min_temp"), F.col("slot.main.temp_max").alias("max_temp"), F.col("slot.main.humidity").alias("humidity"),
        F.col("slot.wind.speed").alias("wind"), or_blank("rain").alias("rain"), or_blank("snow").alias("snow"),
    )


def day_runs(frame: DataFrame, key: str, order: str, date: str = "date") -> DataFrame:
    """Adds day_idx: a new day whenever the date changes, also back to an earlier one."""
    by_order = Window.partitionBy(key).orderBy(order)
    changed = F.coalesce(F.col(date) != F.lag(date).over(by_order), F.lit(False)).cast("bigint")
    return frame.withColumn("__changed", changed).withColumn("day_idx", F.sum("__changed").over(by_order)).drop("__changed")


def sections(days: DataFrame, key: str, order: str) -> DataFrame:
    """(key, day_idx, kind, seq, c0…c7): header, then for each day an empty row, a banner and its slots."""
    cells = [F.col(c).cast("string").alias(f"c{i}") for i, c in enumerate(COLUMNS)]
    slots = days.select(key, "day_idx", F.lit(3).alias("kind"), F.col(order).cast("bigint").alias("seq"), *cells)
    one_day = days.groupBy(key, "day_idx").agg(F.min_by("date", order).alias("date"))
    empty = [F.lit("").alias(f"c{i}") for i in range(8)]
    blank = one_day.select(key, "day_idx", F.lit(1).alias("kind"), F.lit(0).cast("bigint").alias("seq"), *empty)
    banner = one_day.select(key, "day_idx", F.lit(2).alias("kind"), F.lit(0).cast("bigint").alias("seq"), F.concat(F.lit("("), "date", F.lit(")")).alias("c0"), *empty[1:])
    header = days.select(key).distinct().select(key, F.lit(-1).cast("bigint").alias("day_idx"), F.lit(0).alias("kind"), F.lit(0).cast("bigint").alias("seq"), *[F.lit(h).alias(f"c{i}") for i, h in enumerate(HEADER)])
    return header.unionByName(blank).unionByName(banner).unionByName(slots)


def optional(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit(" "))
