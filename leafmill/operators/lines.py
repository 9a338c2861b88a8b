"""Documents as numbered lines: runs, caps, headings and page marks.

A document's lines are worked on inside its row with array functions wherever the result depends
on neighbours, so no shuffle is needed and no window gathers a document; a line table is made only
when asked for. Null texts have no lines; empty texts have none either (as in ``splitlines``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.operators.footnotes import carried


def split_lines(text: Column) -> Column:
    """Lines without their ends; a final line end adds no empty line."""
    clean = F.regexp_replace(text, r"\r\n|[\r\x0B\x0C\x1C\x1D\x1E\x{85}\x{2028}\x{2029}]", "\n")
    return F.when(clean == "", F.array().cast("array<string>")).otherwise(F.split(F.regexp_replace(clean, r"\n\z", ""), "\n"))


def explode_lines(frame: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line_no from 1, line)."""
    return frame.select(key, F.posexplode(split_lines(F.col(text))).alias("pos", "line")).select(key, (F.col("pos") + 1).cast("bigint").alias("line_no"), "line")


def cap_blank_runs(text: Column, most: int = 3) -> Column:
    """At most ``most`` blank lines in a row; other lines lose the white space at their end."""
    step = F.aggregate(
        split_lines(text),
        F.struct(F.array().cast("array<string>").alias("out"), F.lit(0).alias("run")),
        lambda acc, x: F.struct(
            F.when(F.regexp_replace(x, r"(?U)\s+", "") != "", F.concat(acc["out"], F.array(F.regexp_replace(x, r"(?U)\s+$", ""))))
            .when(acc["run"] < most, F.concat(acc["out"], F.array(F.lit(""))))
            .otherwise(acc["out"])
            .alias("out"),
            F.when(F.regexp_replace(x, r"(?U)\s+", "") != "", F.lit(0)).otherwise(acc["run"] + 1).alias("run"),
        ),
        lambda acc: F.array_join(acc["out"], "\n"),
    )
    return F.when(text.isNull(), F.lit(None).cast("string")).otherwise(step)


def _shifted(values: Column, by: int) -> Column:
    """The array moved by some places: by > 0 the values that follow, by < 0 those before; nulls fill up.

    Zipped with the array it gives neighbours in one pass; looking them up by index inside a lambda
    would compute the whole array again for every element.
    """
    if by > 0:
        return F.slice(values, by + 1, 2**31 - 1 - by)
    return F.concat(F.transform(F.slice(values, 1, -by), lambda x: F.nullif(x, x)), values)


def integer_islands(values: Column) -> Column:
    """Runs of an array that rise by one, in order and unsorted: ``1-2, 9, 4-5``; '' for an empty array."""
    pairs = F.transform(
        F.arrays_zip(values.alias("v"), _shifted(values, -1).alias("p"), _shifted(values, 1).alias("n")),
        lambda z: F.struct(z["v"].alias("v"), (F.coalesce(z["v"] - z["p"], F.lit(0)) != 1).alias("starts"), (F.coalesce(z["n"] - z["v"], F.lit(0)) != 1).alias("ends")),
    )
    pairs = F.filter(pairs, lambda p: p["v"].isNotNull())
    starts = F.transform(F.filter(pairs, lambda p: p["starts"]), lambda p: p["v"])
    ends = F.transform(F.filter(pairs, lambda p: p["ends"]), lambda p: p["v"])
    spans = F.transform(F.arrays_zip(starts.alias("a"), ends.alias("b")), lambda z: F.when(z["a"] == z["b"], z["a"].cast("string")).otherwise(F.concat(z["a"].cast("string"), F.lit("-"), z["b"].cast("string"))))
    return F.array_join(spans, ", ")


def page_marks(text: Column) -> Column:
    """The numbers of ``[n]`` in order."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"\[(\d+)\]\s?"), F.lit(1)), lambda x: x.cast("bigint"))


# Roman numerals and number words of part headings.
ROMAN_LINE = r"(?i)^\s*\*?\*?M{0,4}(CM|CD|D?C{0,3})(XC|XL|L?X{0,3})(IX|IV|V?I{0,3})\.?\*?\*?$"
PART_LINE = (
    r"(?i)^\s*\*?\*?Part\s(One|Two|Three|Four|Five|Six|Seven|Eight|Nine|Ten|Eleven|Twelve|Thirteen|Fourteen|Fifteen|Sixteen|Seventeen|"
    r"Eighteen|Nineteen|Twenty)\.?\*?\*?$"
)


def promote_headings(text: Column, extra: bool = False, title_chars: int = 100) -> Column:
    """Roman-numeral lines become ``#### …``, "Part N" lines ``## …``; the first and last line never.

    With ``extra``, short lines between two blank ones become ``## …`` too, but for the last ten.
    """
    lines = split_lines(text)
    named = lambda x: F.when(x.rlike(ROMAN_LINE), F.concat(F.lit("#### "), x)).when(x.rlike(PART_LINE), F.concat(F.lit("## "), x)).otherwise(x)
    inner = F.transform(
        F.arrays_zip(lines.alias("x"), _shifted(lines, 1).alias("n")), lambda z, i: F.when((i >= 1) & z["n"].isNotNull() & (z["x"] != ""), named(z["x"])).otherwise(z["x"])
    )
    done = F.filter(inner, lambda x: x.isNotNull())
    if extra:
        short = rf"(?iU)^\s*\*?\*?(?!.*---)[\w !\"$%&'()+,\-./:;<=>?@\[\\\]^`{{|}}~]{{1,{title_chars}}}\.?\*?\*?$"
        blank = lambda x: F.regexp_replace(F.coalesce(x, F.lit("-")), r"(?U)\s+", "") == ""
        around = F.arrays_zip(done.alias("x"), _shifted(done, -1).alias("p"), _shifted(done, 1).alias("n"), _shifted(done, 10).alias("far"))
        titled = F.transform(around, lambda z, i: F.when((i >= 1) & z["far"].isNotNull() & (z["x"] != "") & z["x"].rlike(short) & blank(z["p"]) & blank(z["n"]), F.concat(F.lit("## "), z["x"])).otherwise(z["x"]))
        done = F.filter(titled, lambda x: x.isNotNull())
    return F.array_join(done, "\n")


def heading_depths(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(r"(?md)^(#+)\s+.*"), F.lit(1)), lambda x: F.length(x))


def strip_archive_frame(text: Column, search: int = 20) -> Column:
    """The text between the START and END lines of a public archive, headings raised to the top level
    and the table of contents cut off, if one of the first ``search`` headings (but for the last) names it.
    """
    body = F.regexp_replace(text, r"(?s)\A.*?\*\*\* START[^\n]*PROJECT GUTENBERG[^\n]*", "")
    least = F.array_min(heading_depths(body))
    raised = F.when(least > 1, F.regexp_replace(body, F.concat(F.lit("(?md)^#{"), (least - 1).cast("string"), F.lit(r"}\s*")), F.lit(""))).otherwise(body)
    heads = F.regexp_extract_all(raised, F.lit(r"(?md)^#+\s+.*"), F.lit(0))
    at = F.array_position(F.transform(F.slice(heads, 1, F.least(F.lit(search), F.greatest(F.size(heads) - 1, F.lit(0)))), lambda h: F.lower(h).contains("content")), True)
    shortened = F.when(at > 0, F.regexp_replace(raised, r"(?imd)\A[\s\S]*?^#+[ \t]+[^\n]*content[^\n]*\n[\s\S]*?(?=^#+\s)", "")).otherwise(raised)
    end = F.regexp_replace(shortened, r"(?s)(\n[^\n]*Project Gutenberg[^\n]*\s*)?\*\*\* END[^\n]*PROJECT GUTENBERG.*\z", "")
    return F.when(F.size(heading_depths(body)) == 0, body).otherwise(F.regexp_replace(end, r"(?U)\s+\z", ""))


def carry_number(frame: DataFrame, key: str, order: str, line: str) -> DataFrame:
    """Adds ``number``: the line number an outline line begins with, else that of the line before (0 at first).

    Carried over blocks of lines (see ``footnotes.carried``), so no window holds a whole document.
    """
    own = F.regexp_extract(F.col(line), r"^\s*(\d+):", 1)
    numbered = carried(frame, key, order, {"number": (F.when(own != "", own.cast("bigint")), True)})
    return numbered.withColumn("number", F.coalesce("number", F.lit(0)).cast("bigint"))
