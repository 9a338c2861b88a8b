"""Problem 4: oversized items cut into pieces under a limit at natural boundaries.

Content-defined chunking: landmarks are local minima of a rolling gear hash, so they depend on
the text around them alone, and each snaps to the best natural boundary near it (paragraph,
line, sentence, word). The first snapped landmark beyond the minimum size ends a piece; where
there is none before the maximum, the last natural boundary before it does; where there is none
of these either, the piece ends at the maximum. An edit moves only the cuts next to it: later
pieces start at the same landmarks again. A piece begins ``overlap`` characters before its own
part, so consecutive pieces have exactly that many characters in common.

Defined results: null and empty texts give no piece; a text within the limit is one piece;
sizes are in code points; repeated rows give repeated pieces (the queries drop the repeats).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafmill.llm.common import code_points, gear_hash, local_minima, table

LIMIT = 6000
OVERLAP = 200
MINIMUM = 2000
LANDMARK_WINDOW = 700
SNAP = 250

# Natural boundaries from the best to the least; a cut is made at the end of the match.
BOUNDARIES = tuple(
    re.compile(p) for p in (r"\n[ \t\r]*\n+", r"\n", r"[.!?…][\"'”’)\]]*\s+", r"[;:,—]\s+", r"\s+")
)


def _boundaries(text: str, low: int, high: int, near: int | None) -> int | None:
    """The end of the best natural boundary in (low, high]: the one closest to ``near``, or the last."""
    for pattern in BOUNDARIES:
        ends = [m.end() for m in pattern.finditer(text, max(low - 8, 0), high) if low < m.end() <= high]
        if ends:
            return max(ends) if near is None else min(ends, key=lambda e: (abs(e - near), e))
    return None


def cut_offsets(text: str | None, limit: int = LIMIT, overlap: int = OVERLAP, minimum: int = MINIMUM) -> list[int]:
    """Offsets where the pieces' own parts begin, and the length of the text at the end."""
    if not text:
        return []
    if len(text) <= limit:
        return [0, len(text)]
    core = limit - overlap
    hashes = gear_hash(code_points(text))
    landmarks = local_minima(hashes[15:], LANDMARK_WINDOW) + 15
    offsets, start = [0], 0
    while len(text) - start + (overlap if start else 0) > limit:
        most = start + (core if start else limit)
        cut = None
        for mark in landmarks[np.searchsorted(landmarks, start + minimum) :]:
            if mark > most:
                break
            found = _boundaries(text, max(int(mark) - SNAP, start + minimum // 2), min(int(mark) + SNAP, most), int(mark))
            if found is not None:
                cut = found
                break
        if cut is None:
            cut = _boundaries(text, start + minimum // 2, most, None) or most
        offsets.append(cut)
        start = cut
    offsets.append(len(text))
    return offsets


def split_items(
    frame: DataFrame, keep: list[str], text: str, limit: int = LIMIT, overlap: int = OVERLAP, minimum: int = MINIMUM, with_text: bool = True
) -> DataFrame:
    """Rows (keep…, n_pieces, piece_no, start_at, end_at[, piece]); a map over partitions, no shuffle."""
    if not 0 <= overlap < minimum <= limit - overlap:
        raise ValueError("needs 0 <= overlap < minimum <= limit - overlap")
    source = frame.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").alias("__text"))
    extra = [T.StructField(n, T.IntegerType(), False) for n in ("n_pieces", "piece_no", "start_at", "end_at")]
    extra += [T.StructField("piece", T.StringType(), False)] * with_text
    schema = T.StructType([*source.schema.fields[:-1], *extra])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, n, no, start, end, piece = [], [], [], [], [], []
            for i, value in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
                cuts = cut_offsets(value, limit, overlap, minimum)
                for k in range(len(cuts) - 1):
                    rows.append(i)
                    n.append(len(cuts) - 1)
                    no.append(k)
                    start.append(max(0, cuts[k] - overlap) if k else 0)
                    end.append(cuts[k + 1])
                    if with_text:
                        piece.append(value[start[-1] : end[-1]])
            taken = batch.select(list(range(batch.num_columns - 1))).take(pa.array(rows, pa.int64()))
            columns = [pa.array(x, pa.int32()) for x in (n, no, start, end)] + [pa.array(piece, pa.string())] * with_text
            yield pa.RecordBatch.from_arrays([*taken.columns, *columns], names=[f.name for f in schema.fields])

    return source.mapInArrow(run, schema)


def planned_texts(plan: DataFrame, lines: DataFrame) -> DataFrame:
    """(plan_id, text) of planned line ranges: lines lo..hi as far as they exist, joined by newlines.

    Ranges that are null, reversed or not of two numbers give no row, and so do ranges without an
    existing line. A range is clipped to its document's last line before its numbers are listed,
    and the lines join on document and number, so neither a document with a third of all lines
    nor a range that ends far beyond the last line is a burden.
    """
    one = lines.groupBy("doc_id", "line_no").agg(F.first("line").alias("line"))
    last = lines.groupBy("doc_id").agg(F.max("line_no").alias("last"))
    ranges = (
        plan.filter(F.size("output_range") == 2)
        .select("plan_id", "doc_id", F.get("output_range", F.lit(0)).alias("lo"), F.get("output_range", F.lit(1)).alias("hi"))
        .filter("lo <= hi")
        .dropDuplicates(["plan_id"])
        .join(last, "doc_id")
        .withColumn("lo", F.greatest("lo", F.lit(1)))
        .withColumn("hi", F.least("hi", "last"))
        .filter("lo <= hi")
    )
    numbered = ranges.select("plan_id", "doc_id", F.explode(F.sequence("lo", "hi")).alias("line_no"))
    return (
        numbered.join(one, ["doc_id", "line_no"])
        .groupBy("plan_id")
        .agg(F.sort_array(F.collect_list(F.struct("line_no", F.coalesce("line", F.lit("")).alias("line")))).alias("own"))
        .select("plan_id", F.array_join(F.transform("own", lambda x: x["line"]), "\n").alias("text"))
    )


def items(spark: SparkSession, directory: str) -> DataFrame:
    """(source_table, item_key, text) of both tables; a chunk that was delivered twice comes twice."""
    chunks = table(spark, directory, "chunk_texts").select("chunk_id", "content")
    planned = planned_texts(table(spark, directory, "chunk_plan"), table(spark, directory, "html_lines"))
    return chunks.select(F.lit("chunk_texts").alias("source_table"), F.col("chunk_id").cast("string").alias("item_key"), F.col("content").alias("text")).unionByName(
        planned.select(F.lit("chunk_plan").alias("source_table"), F.col("plan_id").cast("string").alias("item_key"), "text")
    )


def p4_found(spark: SparkSession, directory: str) -> DataFrame:
    """Items above the limit: those that the operator cut into more than one piece."""
    cut = split_items(items(spark, directory), ["source_table", "item_key"], "text", with_text=False)
    return cut.filter("n_pieces > 1 and piece_no = 0").select("source_table", "item_key").distinct()


def p4_pieces(spark: SparkSession, directory: str) -> DataFrame:
    """The pieces of all items, with the given overlap."""
    return split_items(items(spark, directory), ["source_table", "item_key"], "text").dropDuplicates(["source_table", "item_key", "piece_no"])
