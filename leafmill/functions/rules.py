"""Ordered rewrite rules for document text, as a table of patterns applied one after the other.

Patterns are Java's; ``(?d)`` keeps ``\\n`` the only line end, as in the texts' origin. Counts of
replacements come from ``count_matches``. Null texts stay null.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    name: str
    pattern: str
    replacement: str


def apply_rules(text: Column, rules: tuple[Rule, ...]) -> Column:
    for rule in rules:
        text = F.regexp_replace(text, rule.pattern, rule.replacement)
    return text


def count_matches(text: Column, pattern: str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(pattern)), F.lit(0)).cast("bigint")


# The patterns of the rewrite steps, in their order.
BOLD_HEADING = (Rule("bold_heading", r"(?md)^\s*\*\*(.*)\*\*", "# $1"),)
LEADING_SPACE = (Rule("leading_space", r"(?md)(?:^|\G) ", " "),)
XML_AND_PATHS = (Rule("xml_declaration", r"(?d)<\?xml.*?>", ""), Rule("path_line", r"(?d).*/.*\.md\n", ""))
FOOTNOTES = (
    Rule("endnote", r"(?d)\[(\d+)\]\(#.*?(b\d+)\.html#.*?endnote\1\) *", r"[^$2_note$1]: "),
    Rule("chapter_note", r"(?d)\[(\d+)\]\(#notes.*?(b\d+)\.html#.*?note\1\)", r"[^$2_note$1]"),
    Rule("footnote", r"(?d)\[(\d+)\]\(#(.*?).html_F\1\) *", r"[^$2_footnote$1]: "),
    Rule("reference", r"(?d)\[(\d+)\]\(#(.*?).html_FT\1\)", r"[^$2_footnote$1]"),
)
ARCHIVE_FOOTNOTES = (
    Rule("archive_footnote", r"(?imd)^\[\[([\dA-Z]+?)\]\]\(.*?#.*?(?:ref|anchor|citation).*?\1.*?\)", r"[^$1]: "),
    Rule("archive_reference", r"(?id)\[\[([\dA-Z]+?)\]\]\(.*?#.*?(?:fn|footnote).*?\1.*?\)", r"[^$1]"),
)
GENERAL_FOOTNOTES = (Rule("general_reference", r"\[?\[(\d+)\]\]?\([^\s]*?\)", r"[^$1]"),)
HEADING_LINKS = (
    Rule("linked_heading", r"(?md)^(#+)\s*\[(.*?)\**\]\(.*\)$", "$1 $2"),
    Rule("bold_heading_text", r"(?md)^(#+)\s*\**(.*?)\**$", "$1 $2"),
)
CONTENTS_LINKS = (Rule("contents_link", r"(?iU)\[([^\[\]]+?)\]\([._ \w#?:\-!$%^/,~”“’\\]+(content|toc)[._ \w#?:\-!$%^/,~”“’\\]+\)", "# $1"),)
PAGE_MARKS = (Rule("page_mark", r"\[\d+\]\s?", ""),)
ROMAN_PAGE_MARKS = (Rule("roman_page_mark", r"(?i)\[(?:PG\s*)?[ivxlcdm]+\]\s?", ""), Rule("page_number_mark", r"(?i)\[PG\s*\d+\]\s?", ""))
BARE_LINKS = (Rule("bare_link", r"(?U)\[\[([\w\s?]+?)\]\](?!\()", r"\\[\\[$1\\]\\]"),)
IMAGES_TO_HTML = (Rule("image", r"(?d)!\[(.*?)\]\(((?:[^()\s]|\([^()]*\))*)(?: (?:[^()]|\([^()]*\))*)?\)", r'<img src="$2" alt="$1" width="300px">'),)
DEFINITION_CLEANUP = (
    Rule("bracketed_number", r"^ {0,3}(\[\^[^\]]+\]: )\[\d+\]\s*:?\s*", "$1"),
    Rule("year", r"^ {0,3}(\[\^[^\]]+\]: )\d{4}\b\.?\s*", "$1"),
    Rule("colon", r"^ {0,3}(\[\^[^\]]+\]: )\s*:?\s*", "$1"),
)


def rewrite_footnotes(text: Column, kind: Column, general: bool = False) -> Column:
    """Footnote links as Markdown footnotes; two more rules where the kind is ``gut``, one more if asked."""
    text = apply_rules(text, FOOTNOTES)
    text = F.when(kind == "gut", apply_rules(text, ARCHIVE_FOOTNOTES)).otherwise(text)
    return apply_rules(text, GENERAL_FOOTNOTES) if general else text


def bold_headings(text: Column, kind: Column) -> Column:
    return F.when(kind == "txt", apply_rules(text, BOLD_HEADING)).otherwise(text)


def escape_underscores(text: Column) -> Column:
    """Escapes the last of an odd number of bare underscores of a line without a tag."""
    odd = lambda x: (F.regexp_count(x, F.lit(r"(?<!\\)_")) % 2 == 1) & ~(x.contains("<") & x.contains(">"))
    return F.array_join(F.transform(F.split(text, "\n"), lambda x: F.when(odd(x), F.regexp_replace(x, r"(?<!\\)_(?!.*(?<!\\)_)", r"\\_")).otherwise(x)), "\n")


def strip_reply(text: Column) -> Column:
    """A reply without its enclosing fence and with its first footnote definition tidied (text start only)."""
    blank = r"(?U)^\s+|\s+$"
    bare = F.regexp_replace(text, blank, "")
    unfenced = F.regexp_replace(F.regexp_replace(bare, r"(?d)\A```[^\n]*(\n|\z)", ""), r"(?d)(\A|\n)```[^\n]*\z", "")
    return apply_rules(F.when(F.startswith(bare, F.lit("```")), F.regexp_replace(unfenced, blank, "")).otherwise(bare), DEFINITION_CLEANUP)


def namespace_footnotes(text: Column, chunk: Column) -> Column:
    """[^x] becomes [^cN_x] for chunk N."""
    return F.regexp_replace(text, F.lit(r"\[\^([^\]]+)\]"), F.concat(F.lit("[^c"), chunk.cast("string"), F.lit("_$1]")))
