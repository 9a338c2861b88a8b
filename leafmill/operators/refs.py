"""References from notes to images, and images that no note refers to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.functions import text as X

# How notes refer to images. The greedy alias swallows a second embed of its line; the lazy one does not.
EMBED_GREEDY = r"(?d)!\[\[([^\]|]+)(?:\|.*)?\]\]"
EMBED_LAZY = r"(?d)!\[\[([^\]|]+)(?:\|[^\]]*)?\]\]"
MARKDOWN_IMAGE = r"(?d)!\[.*?\]\(([^)]+)\)"
HTML_IMAGE = r"<img[^>]+src=[\"']([^\"']+)[\"']"
FRONT_MATTER = r"(?s)\A---\n(.*?)\n---"
FRONT_MATTER_IMAGE = r"(?i):\s*\"?([^\"\n]+\.(?:png|jpg|jpeg|gif|svg|webp|bmp|tiff))\"?"
IMAGE_EXTENSIONS = (".png", ".jpg", ".jpeg", ".gif", ".svg", ".webp", ".bmp", ".tiff")


def _until(value: Column, *signs: str) -> Column:
    for sign in signs:
        value = F.substring_index(value, sign, 1)
    return value


def references(text: Column, parity: bool = True) -> Column:
    """All references of a text: embeds, Markdown images, HTML images and front matter values."""
    all_of = lambda t, p: F.regexp_extract_all(t, F.lit(p), F.lit(1))
    body = F.coalesce(text, F.lit(""))
    return F.concat(
        F.transform(all_of(body, EMBED_GREEDY if parity else EMBED_LAZY), lambda x: F.trim(x)),
        F.transform(all_of(body, MARKDOWN_IMAGE), lambda x: _until(F.trim(_until(x, '"', "'")), "?")),
        F.transform(all_of(body, HTML_IMAGE), lambda x: _until(F.trim(x), "?")),
        F.transform(all_of(F.regexp_extract(body, FRONT_MATTER, 1), FRONT_MATTER_IMAGE), lambda x: F.trim(x)),
    )


def reference_tails(notes: DataFrame, text: str, group: list[str], parity: bool = True) -> DataFrame:
    """(group…, tail): each distinct reference as its lower-case path parts, joined."""
    found = notes.select(*group, F.explode(references(F.col(text), parity)).alias("ref"))
    return found.select(*group, F.array_join(X.path_parts(X.percent_decode(F.col("ref"))), "/").alias("tail")).filter("tail <> ''").distinct()


def orphans(images: DataFrame, tails: DataFrame, path: str, group: list[str]) -> DataFrame:
    """Images of which no reference is the end of the path.

    Every suffix of an image's path is listed, so the test is an equi-join; a path has few parts.
    """
    parts = X.path_parts(F.col(path))
    suffixes = images.select(*group, path, F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts), F.lit(1))), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), "/"))).alias("tail"))
    used = suffixes.join(tails, [*group, "tail"], "left_semi").select(*group, path).distinct()
    return images.join(used, [*group, path], "left_anti")


def orphan_report(orphaned: DataFrame, size: str, group: list[str]) -> DataFrame:
    grouped = orphaned.groupBy(*group).agg(F.count(F.lit(1)).alias("n_images"), F.coalesce(F.sum(size), F.lit(0)).cast("bigint").alias("n_bytes"))
    return grouped.withColumn("readable", X.human_size(F.col("n_bytes")))


def delete_plan(orphaned: DataFrame, path: str) -> DataFrame:
    return orphaned.select(F.lit("delete").alias("action"), F.col(path).alias("path"))


def cover(stem: Column, there: Column) -> Column:
    """The first cover file of six that the inventory array holds, else null."""
    tried = [F.concat(F.lit("."), stem, F.lit(f".assets/{name}")) for name in ("cover.jpg", "cover.jpeg", "cover.png", "Cover.jpg", "Cover.jpeg", "Cover.png")]
    return F.get(F.filter(F.array(*tried), lambda x: F.array_contains(there, x)), F.lit(0))
