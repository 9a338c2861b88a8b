"""Sinks. Ordered single-file outputs are small reports (playlists, indexes, forecasts); data sinks stay partitioned."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_ordered_lines(lines: DataFrame, order: list[str], line: str, path: str) -> None:
    """One text file with the lines in order; for reports, since one task writes it."""
    lines.orderBy(*order).select(F.col(line).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def write_sections(sections: DataFrame, path: str) -> None:
    """The sectioned CSV of a forecast: eight columns, no header of its own."""
    cells = [f"c{i}" for i in range(8)]
    sections.orderBy("day_idx", "kind", "seq").select(*cells).coalesce(1).write.mode("overwrite").option("emptyValue", "").option("quoteAll", "false").csv(path)


def write_chunks(chunks: DataFrame, path: str, key: str = "chunk_idx") -> None:
    """Chunk texts in a folder for each key."""
    chunks.select(key, F.col("text").alias("value")).repartition(key).write.mode("overwrite").partitionBy(key).text(path)


def write_segments(segments: DataFrame, key: str, order: list[str], path: str) -> None:
    """Merged texts as ordered part files in a folder for each key: names rise with the order, so the parts one after the other are the text.

    Rows are ranged by key and order; a text that is larger than a partition is spread over several.
    """
    ranged = segments.repartitionByRange(key, *order).sortWithinPartitions(key, *order)
    lines = ranged.select(key, F.regexp_replace("segment", r"\n\z", "").alias("value"))  # the writer ends every row with a line end
    lines.write.mode("overwrite").partitionBy(key).text(path)


def write_merged(merged: DataFrame, path: str, key: str = "file") -> None:
    merged.select(key, "text").write.mode("overwrite").parquet(path)


def write_plan(plan: DataFrame, path: str) -> None:
    plan.write.mode("overwrite").json(path)


def write_texts(texts: DataFrame, key: str, text: str, path: str) -> None:
    """Whole texts (outlines, previews) in a folder for each key."""
    texts.select(key, F.col(text).alias("value")).write.mode("overwrite").partitionBy(key).text(path)


def write_outlines(outlines: DataFrame, key: str, path: str) -> None:
    """Outline rows (key, seq, line, depth, entry) as ``line: entry``, indented by depth, in the order of the rows."""
    lines = outlines.select(key, "seq", F.concat(F.col("line").cast("string"), F.lit(": "), F.repeat(F.lit("  "), F.col("depth")), "entry").alias("value"))
    lines.repartition(key).sortWithinPartitions(key, "seq").select(key, "value").write.mode("overwrite").partitionBy(key).text(path)


def front_matter(meta: Column) -> Column:
    """The metadata as a block before a text; nothing where there are none."""
    pairs = F.transform(F.array_sort(F.map_entries(meta)), lambda e: F.concat(e["key"], F.lit(": "), F.coalesce(e["value"], F.lit(""))))
    return F.when(F.coalesce(F.size(meta), F.lit(0)) > 0, F.concat(F.lit("---\n"), F.array_join(pairs, "\n"), F.lit("\n---\n"))).otherwise("")


def write_documents(documents: DataFrame, path: str) -> None:
    """Documents with their metadata as front matter, to a new place; what is being read is never overwritten."""
    documents.select("doc_id", F.concat(front_matter(F.col("meta")), F.coalesce("text", F.lit(""))).alias("text")).write.mode("errorifexists").parquet(path)


def show_aligned(frame: DataFrame, rows: int = 40) -> None:
    frame.show(rows, truncate=False)
