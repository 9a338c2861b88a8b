"""Audio catalog: predicates, names, tolerance deduplication, playlist and copy plan.

Input columns: path, name, size, mime, duration, tags map<string, array<string>>, ord. Nulls in
size or mime fail the predicate; an unknown duration drops the row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.functions import text as X

LEAST_BYTES = 1_000_000
LEAST_SECONDS = 20
TOLERANCE = 1.0

# For each field the tag names in their order.
ALIASES = {
    "title": ["TIT2", "title"], "artist": ["TPE1", "artist"], "artists": ["TPE1", "artists", "TPE2"], "album": ["TALB", "album"],
    "track": ["TRCK", "tracknumber"], "tracknumber": ["tracknumber"], "year": ["TDRC", "TYER", "year"],
    "date": ["TDRC", "TYER", "TDAT", "TDRL", "TDTG", "date", "originaldate"], "genre": ["TCON", "genre"], "composer": ["TCOM", "composer"], "label": ["TPUB", "label"],
}
FIELDS = ["track", "title", "album", "artist", "year", "genre", "composer", "label", "date", "artists"]
MIME_EXTENSIONS = {"audio/mpeg": ".mp3", "audio/ogg": ".ogg", "audio/flac": ".flac", "audio/wav": ".wav", "audio/aiff": ".aiff", "audio/dsf": ".dsf", "audio/mp4": ".m4a", "audio/x-m4a": ".m4a", "audio/aac": ".aac"}


def is_audio(mime: Column, size: Column) -> Column:
    return F.coalesce(F.startswith(mime, F.lit("audio/")) & (size > LEAST_BYTES), F.lit(False))


def long_enough(duration: Column, least: float = LEAST_SECONDS) -> Column:
    return duration.isNotNull() & (duration >= least)


def field(tags: Column, name: str) -> Column:
    """One logical field of the tags."""
    if name in ("year", "date"):
        raw = F.transform(F.array(*[F.lit(a) for a in ALIASES[name]]), lambda a: F.get(F.try_element_at(tags, a), F.lit(0)))
        return X.normalise_date(F.coalesce(F.get(F.filter(raw, lambda v: F.trim(v) != ""), F.lit(0)), F.lit("")))
    value = X.first_tag(tags, ALIASES.get(name, [name]))
    return X.track_number(value) if name == "track" else value


def audio_extension(mime: Column, name: Column, default: str = ".mp3") -> Column:
    """The extension of the name, else by type, else the default."""
    known = F.create_map(*[F.lit(x) for kv in MIME_EXTENSIONS.items() for x in kv])
    by_type = F.coalesce(F.try_element_at(known, F.lower(mime)), F.when(F.startswith(F.lower(mime), F.lit("audio/")), F.concat(F.lit("."), F.substring_index(F.lower(mime), "/", -1))))
    own = F.nullif(F.regexp_extract(name, r"[^.](\.[^./]*)$", 1), F.lit(""))
    return F.coalesce(own, by_type, F.lit(default))


def improved_root(tags: Column, name: Column, template: str | None) -> Column:
    """The file's name by the template, cleaned; its own stem where that gives nothing."""
    own = X.stem(name)
    if not template:
        return own
    return F.when(F.coalesce(F.size(tags), F.lit(0)) > 0, X.safe_name(X.fill_template(template, {f: field(tags, f) for f in FIELDS}, FIELDS), own)).otherwise(own)


def drop_near_equal(frame: DataFrame, name: str, value: str, order: str, tolerance: float = TOLERANCE) -> DataFrame:
    """Keeps, in order, the rows of a name whose value is not within the tolerance of a kept one.

    Adds ``copy_no``: 0 for the first row kept of a name, then 1, 2, …. Later rows of an equal
    value can never be kept, so a partial aggregation first leaves one row a value, and values
    more than a tolerance apart fall into groups that are folded apart from each other; a name that
    many rows share costs a task no more than its distinct values. Ties in ``order`` are rows alike
    to the fold: the lower value goes first. Rows without a value are dropped.
    """
    least = frame.filter(F.col(value).isNotNull()).groupBy(name, value).agg(F.min(order).alias("__ord"))
    by_value = Window.partitionBy(name).orderBy(value)
    runs = least.withColumn("__new", (F.col(value) - F.lag(value).over(by_value) >= tolerance).cast("int")).withColumn("__run", F.sum(F.coalesce("__new", F.lit(0))).over(by_value))
    kept = (
        runs.groupBy(name, "__run")
        .agg(F.array_sort(F.collect_list(F.struct(F.col("__ord").alias("o"), F.col(value).alias("v")))).alias("rows"))
        .select(
            name,
            F.explode(
                F.aggregate(
                    "rows",
                    F.filter(F.col("rows"), lambda x: F.lit(False)),
                    lambda acc, x: F.when(F.exists(acc, lambda k: F.abs(k["v"] - x["v"]) < tolerance), acc).otherwise(F.concat(acc, F.array(x))),
                )
            ).alias("k"),
        )
        .select(name, F.col("k.o").alias(order), F.col("k.v").alias(value))
    )
    return kept.withColumn("copy_no", F.row_number().over(Window.partitionBy(name).orderBy(order, value)) - 1)


def final_name(root: Column, copy_no: Column, ext: Column) -> Column:
    return F.concat(root, F.when(copy_no > 0, F.concat(F.lit("_("), copy_no.cast("string"), F.lit(")"))).otherwise(""), ext)


def playlist(frame: DataFrame, path: str, order: str, base: str | None = None) -> DataFrame:
    """(line_no, line): the header and one path a row, relative to the base where it is given."""
    entry = X.relative_to(F.col(path), F.lit(base)) if base else F.col(path)
    header = frame.sparkSession.range(1).select(F.lit(0).cast("bigint").alias("line_no"), F.lit("#EXTM3U").alias("line"))
    return header.unionByName(frame.select(F.col(order).cast("bigint").alias("line_no"), entry.alias("line")))


def copy_plan(frame: DataFrame, existing: DataFrame, source: str, target: str) -> DataFrame:
    """(src, dst, action): copy, or skip what exists already; carried out outside Spark."""
    there = existing.select(F.col("path").alias("dst")).distinct().withColumn("__there", F.lit(True))
    return frame.select(F.col(source).alias("src"), F.col(target).alias("dst")).join(there, "dst", "left").select("src", "dst", F.when(F.col("__there"), "skip").otherwise("copy").alias("action"))
