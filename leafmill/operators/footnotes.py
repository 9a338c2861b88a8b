"""Footnotes of extracted items with the page header that stands before them.

The order of items is a file's. A footnote begins at a marker (``1.``, ``[1]``, ``*``), goes on over
page-footer items that are no page furniture, and ends at anything else. Its page is the header in
force when it ends, so a note that a header ends has that header; one that ends with its file has
the last header. The states are carried by windows over blocks of ``BLOCK`` positions and by the last
states of the blocks before, all in one pass, so a file with a third of all rows is spread over as
many tasks as it has blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 2048


def carried(frame: DataFrame, file: str, order: str, values: dict[str, tuple[Column, bool]]) -> DataFrame:
    """Adds, for each name, the last non-null value before each row of its file, and at the row itself where the flag says so."""
    marked = frame.withColumn("__block", F.floor(F.col(order) / BLOCK)).withColumns({f"__{n}": v for n, (v, _) in values.items()})
    last = [F.max_by(f"__{n}", F.when(F.col(f"__{n}").isNotNull(), F.col(order))).alias(f"__last_{n}") for n in values]
    before = Window.partitionBy(file).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = marked.groupBy(file, "__block").agg(*last).select(file, "__block", *[F.last(f"__last_{n}", ignorenulls=True).over(before).alias(f"__carry_{n}") for n in values])
    inner = Window.partitionBy(file, "__block").orderBy(order)
    own = {n: F.last(f"__{n}", ignorenulls=True).over(inner.rowsBetween(Window.unboundedPreceding, 0 if at else -1)) for n, (_, at) in values.items()}
    joined = marked.join(blocks, [file, "__block"]).withColumns({n: F.coalesce(c, F.col(f"__carry_{n}")) for n, c in own.items()})
    return joined.drop("__block", *[f"__{n}" for n in values], *[f"__carry_{n}" for n in values])


def extract_footnotes(items: DataFrame, file: str = "file", order: str = "idx", label: str = "label", text: str = "text") -> DataFrame:
    """(file, start_idx, page_ctx, footnote). Positions must be unique within a file; blank items are passed over."""
    body = F.trim(F.regexp_replace(F.col(text), r"(?U)^\s+|\s+$", ""))
    kept = items.select(file, order, F.col(label).alias("label"), body.alias("body")).filter("body IS NOT NULL AND body <> ''")
    number = F.col("body").rlike(r"^\d+$")
    note = F.coalesce(F.col("label").isin("footnote", "page_footer"), F.lit(False))
    starts = note & F.col("body").rlike(r"^(?:\d+[.\s]|\[\d+\]|\*)\s*") & ~number
    furniture = number | ((F.col("body") == F.upper("body")) & (F.length("body") <= 60))
    goes_on = F.coalesce(F.col("label") == "page_footer", F.lit(False)) & ~starts & ~furniture
    turn = F.when(starts, F.col(order)).when(~goes_on, F.lit(-1))  # where a note begins, or none goes on
    state = carried(kept.withColumn("turn", turn), file, order, {"page": (F.when(F.col("label") == "page_header", F.col("body")), True), "note": (F.col("turn"), True), "earlier": (F.col("turn"), False)})
    # a row is part of the note it stands in, and may end the one before it
    empty = F.lit(None)
    part = F.struct(F.col("note").alias("start_idx"), F.col(order).alias("o"), F.col("body").alias("b"), F.col("page").alias("page"), F.lit(False).alias("ends"))
    end = F.struct(F.col("earlier").alias("start_idx"), empty.cast("int").alias("o"), empty.cast("string").alias("b"), F.col("page").alias("page"), F.lit(True).alias("ends"))
    rows = F.filter(F.array(F.when(F.col("note") >= 0, part), F.when((F.col("earlier") >= 0) & F.col("turn").isNotNull(), end)), lambda x: x.isNotNull())
    told = state.select(file, F.explode(rows).alias("r")).select(file, "r.*")
    page = F.when(F.bool_or("ends"), F.max(F.when(F.col("ends"), F.col("page")))).otherwise(F.max_by("page", "o"))
    texts = F.array_sort(F.collect_list(F.when(~F.col("ends"), F.struct("o", "b"))))
    return told.groupBy(file, "start_idx").agg(F.coalesce(page, F.lit("Unknown Page")).alias("page_ctx"), F.array_join(F.transform(texts, lambda x: x["b"]), " ").alias("footnote"))


def table_footnotes(links: DataFrame, items: DataFrame, extracted: DataFrame, file: str = "file", order: str = "idx") -> DataFrame:
    """(file, idx, page_ctx, footnote) of items that tables point to, but for texts extracted already."""
    pages = carried(items.select(file, order, "label", "text"), file, order, {"page_ctx": (F.when(F.col("label") == "page_header", F.col("text")), True)})
    found = links.select(file, order).distinct().join(pages, [file, order]).select(file, order, F.coalesce("page_ctx", F.lit("Unknown Page")).alias("page_ctx"), F.col("text").alias("footnote"))
    return found.join(extracted.select(file, "footnote"), [file, "footnote"], "left_anti").select(file, order, "page_ctx", "footnote")
