"""Queries of the subpackage by name, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from leafmill.llm import encode, markup, pack, paragraphs, repetition, scans, spans, split, truncation

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": scans.p1_found,
    "p1_paragraphs": paragraphs.p1_paragraphs,
    "p2_found": repetition.p2_found,
    "p2_shares": repetition.p2_shares,
    "p2_scores": repetition.p2_scores,
    "p3_found": markup.p3_found,
    "p3_clean": markup.p3_clean,
    "p4_found": split.p4_found,
    "p4_pieces": split.p4_pieces,
    "p5_found": truncation.p5_found,
    "p5_scores": truncation.p5_scores,
    "p5_rates": truncation.p5_rates,
    "p6_ids": encode.p6_ids,
    "p6_roundtrip": encode.p6_roundtrip,
    "p7_packed": pack.p7_packed,
    "p7_fill": pack.p7_fill,
    "p8_found": spans.p8_found,
    "p8_shares": spans.p8_shares,
}

# The places of repeated words: second and later occurrences of runs of four words.
REPEATED = r"""
    w AS (SELECT reply_id, regexp_extract_all(lower(coalesce(any_value(markdown_text), '')), '\p{L}+') AS ws FROM transcriptions GROUP BY reply_id),
    g AS (SELECT reply_id, ws, unnest(range(1, len(ws) - 2)) AS i FROM w WHERE len(ws) >= 4),
    h AS (SELECT reply_id, i, list_aggregate(ws[i : i + 3], 'string_agg', ' ') AS gram FROM g),
    r AS (SELECT reply_id, i FROM (SELECT *, min(i) OVER (PARTITION BY reply_id, gram) AS f FROM h) WHERE i > f),
    c AS (SELECT reply_id, count(*) AS k FROM (SELECT DISTINCT reply_id, i + k AS p FROM (SELECT *, unnest([0, 1, 2, 3]) AS k FROM r)) GROUP BY reply_id),
    s AS (SELECT w.reply_id, CAST(len(ws) AS BIGINT) AS n_words, CASE WHEN len(ws) = 0 THEN CAST(0 AS DOUBLE) ELSE coalesce(k, 0) / len(ws) END AS share FROM w LEFT JOIN c ON c.reply_id = w.reply_id)"""

ORACLES: dict[str, str] = {
    "p2_found": f"WITH {REPEATED} SELECT reply_id FROM s WHERE share >= 0.4",
    "p2_shares": f"WITH {REPEATED} SELECT reply_id, n_words, share FROM s",
    "p4_found": """
        WITH lines AS (SELECT doc_id, line_no, coalesce(any_value(line), '') AS line FROM html_lines GROUP BY doc_id, line_no),
        plans AS (SELECT DISTINCT plan_id, doc_id, output_range[1] AS lo, output_range[2] AS hi FROM chunk_plan WHERE len(output_range) = 2)
        SELECT DISTINCT 'chunk_texts' AS source_table, CAST(chunk_id AS VARCHAR) AS item_key FROM chunk_texts WHERE length(content) > 6000
        UNION ALL
        SELECT 'chunk_plan' AS source_table, CAST(plan_id AS VARCHAR) AS item_key
        FROM plans JOIN lines ON plans.doc_id = lines.doc_id AND lines.line_no BETWEEN plans.lo AND plans.hi
        GROUP BY plan_id HAVING sum(length(line)) + count(*) - 1 > 6000
    """,
}
