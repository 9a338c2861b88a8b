"""Small relational operators: letter index, partitions, unions, top rows, ages and time blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# What marks a title as an extra.
EXTRA_MARKS = ("Category:", "Appendix:")


def is_extra(title: Column) -> Column:
    return title.contains(EXTRA_MARKS[0]) | title.contains(EXTRA_MARKS[1])


def letter_index(frame: DataFrame, title: str) -> DataFrame:
    """(letter, group_no, title): groups by upper-cased first character, in the order of their least title.

    The groups' order is taken from a partial aggregation; a letter that most titles share is no
    burden, since titles stay rows.
    """
    letter = F.upper(F.substring(title, 1, 1))
    titles = frame.filter(F.length(title) > 0).select(F.col(title).alias("title"), letter.alias("letter"))
    first = titles.groupBy("letter").agg(F.min("title").alias("__first"))
    order = first.withColumn("group_no", F.row_number().over(Window.orderBy("__first", "letter")).cast("bigint")).drop("__first")
    return titles.join(order, "letter").select("letter", "group_no", "title")


def index_lines(indexed: DataFrame) -> DataFrame:
    """(group_no, kind, title, line): ``## letter`` and ``- title`` lines for an ordered sink."""
    heads = indexed.select("group_no", "letter").distinct().select("group_no", F.lit(0).alias("kind"), F.lit("").alias("title"), F.concat(F.lit("## "), "letter").alias("line"))
    return heads.unionByName(indexed.select("group_no", F.lit(1).alias("kind"), "title", F.concat(F.lit("- "), "title").alias("line")))


def order_union(first: Column, rest: Column) -> Column:
    """The chosen values first, then the others in their order, none twice."""
    return F.concat(first, F.filter(rest, lambda x: ~F.array_contains(first, x)))


def latest(frame: DataFrame, keys: list[str], value: str, order: Column) -> DataFrame:
    return frame.groupBy(*keys).agg(F.max_by(value, order).alias("latest"), F.max(order).alias("at"))


def settled(age_minutes: Column, threshold: int = 15) -> Column:
    return age_minutes > threshold


def time_block(time: Column, blocks: list[str]) -> Column:
    """The first block (``HH:MM-HH:MM``) that ended before the time; null if none has."""
    ended = F.filter(F.array(*[F.lit(b) for b in blocks]), lambda b: time > F.split_part(b, F.lit("-"), F.lit(2)))
    return F.get(ended, F.lit(0))


def random_pick(frame: DataFrame, seed: int | None = None) -> DataFrame:
    return frame.orderBy(F.rand(seed) if seed is not None else F.rand()).limit(1)
