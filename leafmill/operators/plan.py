"""Chunk plans: page ranges, running numbers, overlaps, line slices and ordered merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.operators.order import in_parts, running_sum

PAGES_PER_CHUNK = 10


def page_chunks(files: DataFrame, file: str, pages: str, order: Column, size: int = PAGES_PER_CHUNK) -> DataFrame:
    """(file, chunk_idx over all files, start_page, end_page). Files without pages have no chunk.

    The running number needs one order over all files; it is summed up in parts (see ``order``).
    """
    counted = files.filter(F.col(pages) > 0).select(file, F.col(pages).cast("bigint").alias("pages"), F.ceil(F.col(pages) / F.lit(size)).cast("bigint").alias("n"), order.alias("__ord"))
    based = running_sum(in_parts(counted, ["__ord", file]), ["__ord", file], "n", "first", inclusive=False)
    return based.select(file, "pages", "first", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1)).alias("k")).select(
        file,
        (F.col("first") + F.col("k") + 1).alias("chunk_idx"),
        (F.col("k") * size + 1).alias("start_page"),
        F.least((F.col("k") + 1) * size, "pages").alias("end_page"),
    )


def chunk_totals(files: DataFrame, file: str, pages: str, size: int = PAGES_PER_CHUNK) -> DataFrame:
    total = F.sum(F.coalesce(F.col(pages), F.lit(0))).cast("bigint")
    return files.groupBy(file).agg(total.alias("pages"), F.ceil(total / F.lit(size)).cast("bigint").alias("chunks"))


def ordinal_slice(frame: DataFrame, key: str, order: str, start: int, end: int) -> DataFrame:
    """Rows with the 1-based ordinals start..end within their key."""
    return frame.withColumn("ordinal", F.row_number().over(Window.partitionBy(key).orderBy(order))).filter(F.col("ordinal").between(start, end))


def overlapping(plan: DataFrame, key: str, start: Column, end: Column) -> DataFrame:
    """Neighbours (by start) of which the next begins at or before the end of the one before.

    Malformed ranges (null, not two numbers) are passed over. No row means no overlap.
    """
    ranges = plan.select(key, start.alias("start"), end.alias("end")).filter("start IS NOT NULL AND end IS NOT NULL")
    following = F.lead("start").over(Window.partitionBy(key).orderBy("start", "end"))
    return ranges.withColumn("next_start", following).filter(F.col("next_start") <= F.col("end"))


def first_wins(frame: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key; a partial aggregation, no window."""
    others = [c for c in frame.columns if c not in keys]
    picked = frame.groupBy(*keys).agg(F.min_by(F.struct(*others), F.struct(*order)).alias("row"))
    return picked.select(*keys, "row.*")


def slice_lines(plan: DataFrame, lines: DataFrame, plan_key: str, key: str, start: Column, end: Column) -> DataFrame:
    """(plan_key, n_lines, text): lines start..end of the plan's document, as far as they exist.

    The range is clipped to the document and listed, so the join is an equi-join on document and
    line number; a reversed range gives no row.
    """
    last = lines.groupBy(key).agg(F.max("line_no").alias("__last"))
    listed = (
        plan.select(plan_key, key, F.greatest(start, F.lit(1)).alias("lo"), end.alias("hi"))
        .join(last, key)
        .withColumn("hi", F.least("hi", "__last"))
        .filter("lo <= hi")
        .select(plan_key, key, F.explode(F.sequence("lo", "hi")).alias("line_no"))
    )
    return listed.join(lines, [key, "line_no"]).groupBy(plan_key).agg(
        F.count(F.lit(1)).alias("n_lines"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", F.coalesce("line", F.lit("")).alias("line")))), lambda x: x["line"]), "\n").alias("text"),
    )


def merge_segments(frame: DataFrame, key: str, order: list[str], text: str, delimiter: str = "\n\n") -> DataFrame:
    """(key, order…, segment): the pieces of each merged text, for ``sinks.write_segments``; no text is gathered in a row."""
    return frame.select(key, *order, F.concat(F.coalesce(text, F.lit("")), F.lit(delimiter)).alias("segment"))


def merge_ordered(frame: DataFrame, key: str, order: list[str], text: str, delimiter: str = "\n\n") -> DataFrame:
    """(key, text): the texts in order, the delimiter after every one of them. Null texts count as empty.

    A merged text is one row; where merged texts may be larger than a task, write ``merge_segments``.
    """
    own = F.array_sort(F.collect_list(F.struct(*order, F.coalesce(text, F.lit("")).alias("__text"))))
    return frame.groupBy(key).agg(own.alias("own")).select(key, F.array_join(F.transform("own", lambda x: F.concat(x["__text"], F.lit(delimiter))), "").alias("text"))


def merge_files(merged: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, text): each file's text under a header with its name, for an ordered sink."""
    return merged.select(key, F.concat(F.lit("# "), F.col(key), F.lit("\n\n"), F.col(text)).alias("text"))


def discover_chunks(names: DataFrame, name: str, stems: DataFrame, stem: str) -> DataFrame:
    """(stem, idx, name) of chunk files: ``chunk_IDX_STEM.md``, or a page range with an optional stem.

    A page range without a stem belongs to every file, so those rows alone are paired with all
    stems; the others join on the stem.
    """
    base = F.col(name)
    one = names.select(base, F.regexp_extract(base, r"^chunk_(\d+)_(.+)\.md$", 1).alias("i"), F.regexp_extract(base, r"^chunk_\d+_(.+)\.md$", 1).alias(stem)).filter("i <> ''")
    ranged = names.select(base, F.regexp_extract(base, r"^chunk_(\d+)_\d+_(.+)\.md$", 1).alias("i"), F.regexp_extract(base, r"^chunk_\d+_\d+_(.+)\.md$", 1).alias(stem)).filter("i <> ''")
    free = names.select(base, F.regexp_extract(base, r"^chunk_(\d+)_\d+\.md$", 1).alias("i")).filter("i <> ''").withColumn("__all", F.lit(1))
    keyed = one.unionByName(ranged).join(stems.select(stem).distinct(), stem)
    every = free.join(stems.select(stem).distinct().withColumn("__all", F.lit(1)), "__all").drop("__all")
    return keyed.unionByName(every).distinct().select(stem, F.col("i").cast("bigint").alias("idx"), name)


PREVIEW_CHUNKS, CONTEXT_CHUNKS = 5, 5


def previews(plan: DataFrame, lines: DataFrame, first: int = PREVIEW_CHUNKS) -> DataFrame:
    """(doc_id, preview): the first chunks of each document with their title, range, text and contexts.

    ``plan`` has plan_id, doc_id, chunk_number, title, output_range and contexts. The order of chunks is
    by number, ties by plan_id. Chunks without a range of two numbers are passed over, as are such
    contexts; a reversed range and one beyond the text give an empty text.
    """
    at = F.struct("chunk_number", "plan_id")
    ranged = plan.filter(F.size("output_range") >= 2).withColumn("__at", at)
    chosen = ordinal_slice(ranged, "doc_id", "__at", 1, first).drop("__at", "ordinal")
    own = F.array(F.struct(F.lit(0).alias("k"), F.col("output_range").alias("r")))
    more = F.transform(F.filter(F.coalesce("contexts", F.array().cast("array<array<int>>")), lambda r: F.size(r) >= 2), lambda r, i: F.struct((i + 1).alias("k"), r.alias("r")))
    each = chosen.select("plan_id", "doc_id", "chunk_number", "title", "output_range", F.explode(F.concat(own, more)).alias("s"))
    each = each.select("*", F.struct("plan_id", "s.k").alias("key"), F.get("s.r", F.lit(0)).alias("lo"), F.get("s.r", F.lit(1)).alias("hi"))
    texts = slice_lines(each, lines, "key", "doc_id", F.col("lo"), F.col("hi")).select("key", "text")
    span = F.concat(F.lit("lines "), F.col("lo").cast("string"), F.lit("–"), F.col("hi").cast("string"))
    head = F.when(F.col("key.k") == 0, F.lit("  --- PRIMARY TEXT (output_range): ")).otherwise(F.concat(F.lit("  --- ADDITIONAL CONTEXT["), F.col("key.k").cast("string"), F.lit("]: ")))
    parts = each.join(texts, "key", "left").withColumn("part", F.concat(head, span, F.lit(" ---\n"), F.coalesce("text", F.lit(""))))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("key.k", "part"))), lambda x: x["part"]), "\n\n")
    chunks = parts.groupBy("plan_id", "doc_id", "chunk_number").agg(F.first("title").alias("title"), F.first("output_range").alias("r"), joined.alias("body"))
    rule = F.lit("=" * 70)
    title = F.concat(
        rule, F.lit("\nChunk "), F.coalesce(F.col("chunk_number").cast("string"), F.lit("?")), F.lit(": "), F.coalesce("title", F.lit("")), F.lit("\n  output_range: lines "),
        F.get("r", F.lit(0)).cast("string"), F.lit("–"), F.get("r", F.lit(1)).cast("string"), F.lit("\n"), rule, F.lit("\n"), F.col("body"),
    )
    told = chunks.select("doc_id", F.struct("chunk_number", "plan_id", title.alias("text")).alias("c"))
    return told.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("c")), lambda c: c["text"]), "\n\n").alias("preview"))


def recent_chunks(plan: DataFrame, last: int = CONTEXT_CHUNKS) -> DataFrame:
    """The last chunks of each document, which the next request for a plan is given as context."""
    by_end = Window.partitionBy("doc_id").orderBy(F.col("chunk_number").desc(), F.col("plan_id").desc())
    return plan.withColumn("__n", F.row_number().over(by_end)).filter(F.col("__n") <= last).drop("__n")


def remaining(frame: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """What is not done yet; the keys of ``done`` may repeat."""
    return frame.join(done.select(*keys), keys, "left_anti")


def prompt(primary: Column, context: Column) -> Column:
    """The primary text, and the context under a heading where there is one."""
    return F.concat(F.lit("PRIMARY TEXT\n"), primary, F.when(F.coalesce(context, F.lit("")) != "", F.concat(F.lit("\n\nADDITIONAL CONTEXT\n"), context)).otherwise(""))
