"""Queries over chunk plans, page ranges, slices, merges and footnotes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.functions import text as X
from leafmill.operators import footnotes as N
from leafmill.operators import plan as P
from leafmill.sources.tables import read_table

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _files(spark: SparkSession, d: str) -> DataFrame:
    x = read_table(spark, d, "files_pages").dropDuplicates(["file", "batch_no"])
    return x.groupBy("file").agg(F.sum("pages").alias("pages"), F.min("batch_no").alias("first_batch"))


FILES_SQL = "SELECT file, sum(pages) AS pages FROM (SELECT DISTINCT file, batch_no, pages FROM files_pages) GROUP BY file"


@query(f"SELECT file, CAST(coalesce(pages, 0) AS BIGINT) AS pages, CAST(ceil(coalesce(pages, 0) / 10) AS BIGINT) AS chunks FROM ({FILES_SQL})")
def chunk_totals(spark: SparkSession, d: str) -> DataFrame:
    """A11."""
    return P.chunk_totals(_files(spark, d), "file", "pages")


@query(f"""WITH f AS (SELECT file, CAST(pages AS BIGINT) AS pages, CAST(ceil(pages / 10) AS BIGINT) AS n FROM ({FILES_SQL}) WHERE pages > 0),
    b AS (SELECT *, coalesce(sum(n) OVER (ORDER BY file ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base FROM f)
    SELECT file, CAST(base + k + 1 AS BIGINT) AS chunk_idx, CAST(k * 10 + 1 AS BIGINT) AS start_page, CAST(least((k + 1) * 10, pages) AS BIGINT) AS end_page
    FROM (SELECT *, unnest(range(n)) AS k FROM b)""")
def running_chunk_index(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of ten pages, numbered over all files."""
    return P.page_chunks(_files(spark, d), "file", "pages", F.col("file"))


PLAN_SQL = "SELECT plan_id, any_value(doc_id) AS doc_id, any_value(chunk_number) AS chunk_number, any_value(output_range) AS output_range, any_value(title) AS title FROM chunk_plan GROUP BY plan_id"
LINES_SQL = "SELECT doc_id, line_no, coalesce(any_value(line), '') AS line FROM html_lines GROUP BY doc_id, line_no"


def _plan(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "chunk_plan").dropDuplicates(["plan_id"])


def _lines(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "html_lines").dropDuplicates(["doc_id", "line_no"])


@query(f"""WITH p AS ({PLAN_SQL}), l AS ({LINES_SQL}) SELECT plan_id, count(*) AS n_lines, string_agg(line, chr(10) ORDER BY line_no) AS text
    FROM p JOIN l ON p.doc_id = l.doc_id AND len(output_range) = 2 AND line_no BETWEEN output_range[1] AND output_range[2] GROUP BY plan_id""")
def range_slice(spark: SparkSession, d: str) -> DataFrame:
    """J3 over all plans."""
    plan = _plan(spark, d).filter(F.size("output_range") == 2)
    return P.slice_lines(plan, _lines(spark, d), "plan_id", "doc_id", F.get("output_range", F.lit(0)), F.get("output_range", F.lit(1)))


@query(f"""WITH c AS (SELECT plan_id, doc_id, unnest(contexts) AS r, generate_subscripts(contexts, 1) - 1 AS k FROM (SELECT plan_id, any_value(doc_id) AS doc_id, any_value(contexts) AS contexts FROM chunk_plan GROUP BY plan_id) WHERE len(contexts) > 0),
    l AS ({LINES_SQL}) SELECT plan_id, CAST(k AS INTEGER) AS k, count(*) AS n_lines FROM c JOIN l ON c.doc_id = l.doc_id AND len(r) >= 2 AND line_no BETWEEN r[1] AND r[2] GROUP BY plan_id, k""")
def context_slices(spark: SparkSession, d: str) -> DataFrame:
    """The context ranges."""
    each = _plan(spark, d).select("plan_id", "doc_id", F.posexplode("contexts").alias("k", "r")).filter(F.size("r") >= 2)
    each = each.withColumn("key", F.struct("plan_id", "k"))
    got = P.slice_lines(each, _lines(spark, d), "key", "doc_id", F.get("r", F.lit(0)), F.get("r", F.lit(1)))
    return got.select("key.plan_id", "key.k", "n_lines")


@query(f"""WITH r AS (SELECT doc_id, output_range[1] AS "start", output_range[2] AS "end" FROM ({PLAN_SQL}) WHERE len(output_range) = 2),
    n AS (SELECT *, lead("start") OVER (PARTITION BY doc_id ORDER BY "start", "end") AS next_start FROM r) SELECT doc_id, "start", "end", next_start FROM n WHERE next_start <= "end" """)
def overlap_check(spark: SparkSession, d: str) -> DataFrame:
    """W5 over all plans."""
    plan = _plan(spark, d).filter(F.size("output_range") == 2)
    return P.overlapping(plan, "doc_id", F.get("output_range", F.lit(0)), F.get("output_range", F.lit(1)))


@query(f"SELECT doc_id, chunk_number, arg_min(plan_id, plan_id) AS plan_id, arg_min(title, plan_id) AS title FROM (SELECT plan_id, doc_id, chunk_number, coalesce(title, '') AS title FROM ({PLAN_SQL})) GROUP BY doc_id, chunk_number")
def first_wins_distinct(spark: SparkSession, d: str) -> DataFrame:
    """Of a chunk number planned twice the first one counts."""
    return P.first_wins(_plan(spark, d).select("doc_id", "chunk_number", "plan_id", F.coalesce("title", F.lit("")).alias("title")), ["doc_id", "chunk_number"], ["plan_id"])


CHUNKS_SQL = "SELECT chunk_id, any_value(file) AS file, any_value(chunk_idx) AS chunk_idx, coalesce(any_value(content), '') AS content FROM chunk_texts GROUP BY chunk_id"


@query(f"SELECT file, string_agg(content || chr(10) || chr(10), '' ORDER BY chunk_idx, chunk_id) AS text FROM ({CHUNKS_SQL}) GROUP BY file")
def ordered_merge(spark: SparkSession, d: str) -> DataFrame:
    """M1, K7: the delimiter after every chunk."""
    return P.merge_ordered(read_table(spark, d, "chunk_texts").dropDuplicates(["chunk_id"]), "file", ["chunk_idx", "chunk_id"], "content")


@query(f"SELECT file, '# ' || file || chr(10) || chr(10) || string_agg(content || chr(10) || chr(10), '' ORDER BY chunk_idx, chunk_id) AS text FROM ({CHUNKS_SQL}) GROUP BY file")
def merged_files(spark: SparkSession, d: str) -> DataFrame:
    """M2."""
    return P.merge_files(ordered_merge(spark, d), "file")


@query("SELECT chunk_id, 'chunk_' || lpad(CAST(chunk_idx AS VARCHAR), 4, '0') || '_' || regexp_replace(regexp_extract(file, '([^/]*)$', 1), '\\.[^.]*$', '') || '.md' AS name FROM (SELECT DISTINCT chunk_id, chunk_idx, file FROM chunk_texts)")
def chunk_names(spark: SparkSession, d: str) -> DataFrame:
    """P9."""
    x = read_table(spark, d, "chunk_texts").dropDuplicates(["chunk_id"])
    return x.select("chunk_id", X.chunk_name(F.col("chunk_idx"), X.stem(X.file_name(F.col("file")))).alias("name"))


@query("SELECT * FROM (SELECT file, batch_no, CAST(row_number() OVER (PARTITION BY file ORDER BY batch_no) AS INTEGER) AS ordinal FROM (SELECT DISTINCT file, batch_no FROM files_pages)) WHERE ordinal BETWEEN 1 AND 2")
def ordinal_slice(spark: SparkSession, d: str) -> DataFrame:
    """F8."""
    return P.ordinal_slice(read_table(spark, d, "files_pages").select("file", "batch_no").distinct(), "file", "batch_no", 1, 2)


FIRST_SQL = """f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY chunk_number, plan_id) AS n FROM
    (SELECT plan_id, any_value(doc_id) AS doc_id, any_value(chunk_number) AS chunk_number, any_value(title) AS title, any_value(output_range) AS r, any_value(contexts) AS contexts FROM chunk_plan GROUP BY plan_id) WHERE len(r) >= 2) WHERE n <= 5)"""


@query(f"""WITH {FIRST_SQL}, l AS ({LINES_SQL}),
    x AS (SELECT plan_id, doc_id, unnest(list_filter(coalesce(contexts, []), lambda c: len(c) >= 2)) AS r, generate_subscripts(list_filter(coalesce(contexts, []), lambda c: len(c) >= 2), 1) AS k FROM f),
    e AS (SELECT plan_id, doc_id, r, 0 AS k FROM f UNION ALL SELECT plan_id, doc_id, r, k FROM x),
    t AS (SELECT e.plan_id, e.k, coalesce(string_agg(line, chr(10) ORDER BY line_no), '') AS text FROM e LEFT JOIN l ON e.doc_id = l.doc_id AND line_no BETWEEN e.r[1] AND e.r[2] GROUP BY e.plan_id, e.k),
    p AS (SELECT e.plan_id, string_agg(CASE WHEN e.k = 0 THEN '  --- PRIMARY TEXT (output_range): ' ELSE '  --- ADDITIONAL CONTEXT[' || e.k || ']: ' END || 'lines ' || e.r[1] || '–' || e.r[2] || ' ---' || chr(10) || text, chr(10) || chr(10) ORDER BY e.k) AS body FROM e JOIN t ON e.plan_id = t.plan_id AND e.k = t.k GROUP BY e.plan_id)
    SELECT doc_id, string_agg(repeat('=', 70) || chr(10) || 'Chunk ' || chunk_number || ': ' || coalesce(title, '') || chr(10) || '  output_range: lines ' || r[1] || '–' || r[2] || chr(10) || repeat('=', 70) || chr(10) || body, chr(10) || chr(10) ORDER BY chunk_number, f.plan_id) AS preview
    FROM f JOIN p ON f.plan_id = p.plan_id GROUP BY doc_id""")
def plan_preview(spark: SparkSession, d: str) -> DataFrame:
    """The preview text of each book's first five chunks."""
    return P.previews(_plan(spark, d), _lines(spark, d))


@query("SELECT plan_id, doc_id, chunk_number FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY chunk_number DESC, plan_id DESC) AS n FROM (SELECT DISTINCT plan_id, doc_id, chunk_number FROM chunk_plan)) WHERE n <= 5")
def recent_chunks(spark: SparkSession, d: str) -> DataFrame:
    """The last five chunks of each book."""
    return P.recent_chunks(_plan(spark, d).select("plan_id", "doc_id", "chunk_number"))


@query("""SELECT plan_id, doc_id, chunk_number FROM (SELECT DISTINCT plan_id, doc_id, chunk_number FROM chunk_plan) p WHERE NOT EXISTS (
    SELECT 1 FROM transcriptions t WHERE t.doc_id = p.doc_id AND t.chunk_number = p.chunk_number AND t.attempt = 1 AND t.model = (SELECT min(model) FROM transcriptions))""")
def skip_existing(spark: SparkSession, d: str) -> DataFrame:
    """Planned chunks without a first reply of one model."""
    replies = read_table(spark, d, "transcriptions")
    least = replies.agg(F.min("model").alias("model"))
    done = replies.filter("attempt = 1").join(F.broadcast(least), "model")
    return P.remaining(_plan(spark, d).select("plan_id", "doc_id", "chunk_number"), done, ["doc_id", "chunk_number"])


ITEMS_SQL = """WITH k AS (SELECT file, idx, any_value(label) AS label, regexp_replace(any_value(text), '^[\\s\\x{A0}]+|[\\s\\x{A0}]+$', '', 'g') AS body FROM extracted_items GROUP BY file, idx),
    v AS (SELECT * FROM k WHERE body <> ''),
    f AS (SELECT *, coalesce(label IN ('footnote', 'page_footer'), false) AS note, regexp_matches(body, '^\\d+$') AS number FROM v),
    s AS (SELECT *, note AND regexp_matches(body, '^(?:\\d+[.\\s]|\\[\\d+\\]|\\*)\\s*') AND NOT number AS starts FROM f),
    g AS (SELECT *, coalesce(label = 'page_footer', false) AND NOT starts AND NOT (number OR (body = upper(body) AND length(body) <= 60)) AS goes_on FROM s),
    t AS (SELECT *, CASE WHEN starts THEN idx WHEN NOT goes_on THEN -1 END AS turn FROM g),
    p AS (SELECT *, last_value(CASE WHEN label = 'page_header' THEN body END IGNORE NULLS) OVER w AS page, last_value(turn IGNORE NULLS) OVER w AS start_idx,
          last_value(turn IGNORE NULLS) OVER (PARTITION BY file ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS earlier FROM t WINDOW w AS (PARTITION BY file ORDER BY idx)),
    e AS (SELECT file, earlier AS start_idx, page FROM p WHERE earlier >= 0 AND turn IS NOT NULL),
    m AS (SELECT file, start_idx, arg_max(coalesce(page, 'Unknown Page'), idx) AS page, string_agg(body, ' ' ORDER BY idx) AS footnote FROM p WHERE start_idx >= 0 GROUP BY file, start_idx),
    n AS (SELECT m.file, m.start_idx, CASE WHEN e.start_idx IS NULL THEN m.page ELSE coalesce(e.page, 'Unknown Page') END AS page_ctx, footnote FROM m LEFT JOIN e ON e.file = m.file AND e.start_idx = m.start_idx)"""


@query(ITEMS_SQL + " SELECT file, start_idx, page_ctx, footnote FROM n")
def extracted_footnotes(spark: SparkSession, d: str) -> DataFrame:
    """W7 over all extracted items."""
    return N.extract_footnotes(read_table(spark, d, "extracted_items").dropDuplicates(["file", "idx"]))


@query("""WITH c AS (SELECT DISTINCT chunk_idx, regexp_replace(regexp_extract(file, '([^/]*)$', 1), '\\.[^.]*$', '') AS stem FROM chunk_texts)
    SELECT stem, CAST(chunk_idx AS BIGINT) AS idx, 'chunk_' || lpad(CAST(chunk_idx AS VARCHAR), 4, '0') || '_' || stem || '.md' AS name FROM c""")
def chunk_discovery(spark: SparkSession, d: str) -> DataFrame:
    """M4: the names of all chunk files, told apart by the stems of their files."""
    x = read_table(spark, d, "chunk_texts").select("chunk_idx", X.stem(X.file_name(F.col("file"))).alias("stem")).distinct()
    return P.discover_chunks(x.select(X.chunk_name(F.col("chunk_idx"), F.col("stem")).alias("name")), "name", x, "stem")


@query("""SELECT plan_id, 'PRIMARY TEXT' || chr(10) || coalesce(title, '') || CASE WHEN len(contexts) > 0 THEN chr(10) || chr(10) || 'ADDITIONAL CONTEXT' || chr(10) || doc_id ELSE '' END AS prompt
    FROM (SELECT plan_id, any_value(title) AS title, any_value(contexts) AS contexts, any_value(doc_id) AS doc_id FROM chunk_plan GROUP BY plan_id)""")
def prompts(spark: SparkSession, d: str) -> DataFrame:
    """H6: a prompt for each plan, its document's name for a context where it has contexts."""
    return _plan(spark, d).select("plan_id", P.prompt(F.coalesce("title", F.lit("")), F.when(F.size("contexts") > 0, F.col("doc_id"))).alias("prompt"))


@query(ITEMS_SQL + """, l AS (SELECT DISTINCT file, idx FROM extracted_items WHERE footnote_text IS NOT NULL),
    h AS (SELECT k.*, last_value(CASE WHEN label = 'page_header' THEN raw END IGNORE NULLS) OVER (PARTITION BY file ORDER BY idx) AS page FROM (SELECT file, idx, any_value(label) AS label, any_value(text) AS raw FROM extracted_items GROUP BY file, idx) k)
    SELECT h.file, h.idx, coalesce(h.page, 'Unknown Page') AS page_ctx, h.raw AS footnote FROM h JOIN l ON h.file = l.file AND h.idx = l.idx WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.file = h.file AND n.footnote = h.raw)""")
def table_footnotes(spark: SparkSession, d: str) -> DataFrame:
    """Items with a footnote text stand for those that tables point to; texts extracted already are passed over."""
    items = read_table(spark, d, "extracted_items").dropDuplicates(["file", "idx"])
    return N.table_footnotes(items.filter("footnote_text IS NOT NULL").select("file", "idx"), items, N.extract_footnotes(items))
