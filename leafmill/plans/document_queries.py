"""Queries over document text: rewrite rules, lines, outlines and stories."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.functions import rules as R
from leafmill.functions import text as X
from leafmill.operators import html as H
from leafmill.operators import lines as L
from leafmill.operators.order import in_parts, running_sum, value_before
from leafmill.sources.tables import read_table

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _documents(spark: SparkSession, d: str) -> DataFrame:
    x = read_table(spark, d, "documents_md").dropDuplicates(["doc_id"])
    return x.select("doc_id", F.try_element_at("meta", F.lit("type")).alias("kind"), F.col("content").alias("text"))


@query("""SELECT doc_id, regexp_replace(regexp_replace(content, '<\\?xml[^\\n]*?>', '', 'g'), '[^\\n]*/[^\\n]*\\.md\\n', '', 'g') AS text
          FROM (SELECT DISTINCT doc_id, content FROM documents_md)""")
def xml_and_path_lines(spark: SparkSession, d: str) -> DataFrame:
    """T5 over all converted documents."""
    return _documents(spark, d).select("doc_id", R.apply_rules(F.col("text"), R.XML_AND_PATHS).alias("text"))


@query("SELECT doc_id, len(regexp_extract_all(content, '\\[(\\d+)\\]\\s?')) AS n_marks, regexp_replace(content, '\\[\\d+\\]\\s?', '', 'g') AS text FROM (SELECT DISTINCT doc_id, content FROM documents_md) WHERE content IS NOT NULL")
def page_mark_removal(spark: SparkSession, d: str) -> DataFrame:
    """The number of marks and the text without them."""
    x = _documents(spark, d).filter("text IS NOT NULL")
    return x.select("doc_id", R.count_matches(F.col("text"), R.PAGE_MARKS[0].pattern).alias("n_marks"), R.apply_rules(F.col("text"), R.PAGE_MARKS).alias("text"))


@query("""WITH m AS (SELECT doc_id, generate_subscripts(v, 1) AS i, unnest(v) AS v FROM (SELECT doc_id, list_transform(regexp_extract_all(content, '\\[(\\d+)\\]\\s?', 1), lambda x: CAST(x AS BIGINT)) AS v FROM (SELECT DISTINCT doc_id, content FROM documents_md) WHERE content IS NOT NULL)),
    b AS (SELECT *, CASE WHEN v - lag(v) OVER (PARTITION BY doc_id ORDER BY i) = 1 THEN 0 ELSE 1 END AS s FROM m),
    g AS (SELECT *, sum(s) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM b),
    r AS (SELECT doc_id, g, min(v) AS a, max(v) AS z FROM g GROUP BY doc_id, g)
    SELECT d.doc_id, coalesce(string_agg(CASE WHEN a = z THEN CAST(a AS VARCHAR) ELSE a || '-' || z END, ', ' ORDER BY g), '') AS pages
    FROM (SELECT DISTINCT doc_id FROM documents_md WHERE content IS NOT NULL) d LEFT JOIN r ON r.doc_id = d.doc_id GROUP BY d.doc_id""")
def page_islands(spark: SparkSession, d: str) -> DataFrame:
    """W2 over the page marks of documents."""
    return _documents(spark, d).filter("text IS NOT NULL").select("doc_id", L.integer_islands(L.page_marks(F.col("text"))).alias("pages"))


@query("""WITH e AS (SELECT user_id, event_id, lag(user_id) OVER (ORDER BY event_id) AS p FROM events), g AS (SELECT *, sum(CASE WHEN user_id - p = 1 THEN 0 ELSE 1 END) OVER (ORDER BY event_id) AS g FROM e)
    SELECT min(user_id) AS first, max(user_id) AS last, count(*) AS n, min(event_id) AS at FROM g GROUP BY g""")
def event_islands(spark: SparkSession, d: str) -> DataFrame:
    """W2 over a table in one global order, in parts (see ``order``)."""
    order = ["event_id"]
    parted = value_before(in_parts(read_table(spark, d, "events").select("event_id", "user_id"), order), order, "user_id", "before")
    flagged = parted.withColumn("starts", F.coalesce((F.col("user_id") - F.col("before") != 1).cast("bigint"), F.lit(1).cast("bigint")))
    numbered = running_sum(flagged, order, "starts", "g")
    return numbered.groupBy("g").agg(F.min("user_id").alias("first"), F.max("user_id").alias("last"), F.count(F.lit(1)).alias("n"), F.min("event_id").alias("at")).drop("g")


@query("""SELECT doc_id, CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(list_filter(lines, lambda l: trim(l, ' ' || chr(9)) = '')) AS BIGINT) AS n_blank FROM (
    SELECT doc_id, CASE WHEN c = '' THEN [] ELSE string_split(regexp_replace(c, '\\n$', ''), chr(10)) END AS lines FROM (SELECT doc_id, replace(replace(content, chr(13) || chr(10), chr(10)), chr(13), chr(10)) AS c FROM (SELECT DISTINCT doc_id, content FROM documents_md) WHERE content IS NOT NULL))""")
def line_counts(spark: SparkSession, d: str) -> DataFrame:
    x = _documents(spark, d).filter("text IS NOT NULL")
    lines = L.split_lines(F.col("text"))
    return x.select("doc_id", F.size(lines).cast("bigint").alias("n_lines"), F.size(F.filter(lines, lambda v: F.regexp_replace(v, r"[ \t]+", "") == "")).cast("bigint").alias("n_blank"))


DOCS_SQL = "(SELECT DISTINCT doc_id, meta['type'] AS kind, content FROM documents_md WHERE content IS NOT NULL)"
UNIX_SQL = "replace(replace(content, chr(13) || chr(10), chr(10)), chr(13), chr(10))"


def _rewritten(spark: SparkSession, d: str, step: Callable[[Column, Column], Column]) -> DataFrame:
    x = _documents(spark, d).filter("text IS NOT NULL")
    return x.select("doc_id", step(F.col("text"), F.col("kind")).alias("text"))


@query(f"""WITH l AS (SELECT doc_id, {UNIX_SQL} AS c FROM {DOCS_SQL}),
    j AS (SELECT doc_id, chr(10) || array_to_string(list_transform(string_split(regexp_replace(c, '\\n$', ''), chr(10)), lambda x: regexp_replace(x, '[\\s\\x{{A0}}]+$', '')), chr(10)) || chr(10) AS c FROM l WHERE c <> ''),
    k AS (SELECT doc_id, regexp_replace(c, '\\n{{5,}}', chr(10) || chr(10) || chr(10) || chr(10), 'g') AS c FROM j)
    SELECT doc_id, substr(c, 2, length(c) - 2) AS text FROM k UNION ALL SELECT doc_id, '' FROM l WHERE c = ''""")
def blank_runs_capped(spark: SparkSession, d: str) -> DataFrame:
    """W3, T3 over all converted documents."""
    return _rewritten(spark, d, lambda t, k: L.cap_blank_runs(t))


@query(f"SELECT doc_id, CASE WHEN kind = 'txt' THEN regexp_replace(content, '(?m)^\\s*\\*\\*(.*)\\*\\*', '# \\1', 'g') ELSE content END AS text FROM {DOCS_SQL}")
def bold_headings(spark: SparkSession, d: str) -> DataFrame:
    """Only in documents of the type txt."""
    return _rewritten(spark, d, R.bold_headings)


@query(f"SELECT doc_id, array_to_string(list_transform(string_split(content, chr(10)), lambda l: repeat(chr(160), length(l) - length(ltrim(l, ' '))) || ltrim(l, ' ')), chr(10)) AS text FROM {DOCS_SQL}")
def leading_space(spark: SparkSession, d: str) -> DataFrame:
    """T4."""
    return _rewritten(spark, d, lambda t, k: R.apply_rules(t, R.LEADING_SPACE))


def footnote_rules(spark: SparkSession, d: str) -> DataFrame:
    """T6 over all converted documents; back references have no SQL, ``tests`` has the cases."""
    return _rewritten(spark, d, R.rewrite_footnotes)


@query(f"""SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(content, '(?m)^(#+)\\s*\\[(.*?)\\**\\]\\(.*\\)$', '\\1 \\2', 'g'), '(?m)^(#+)\\s*\\**(.*?)\\**$', '\\1 \\2', 'g'),
    '(?i)\\[([^\\[\\]]+?)\\]\\([._ \\pL\\pN#?:\\-!$%^/,~”“’\\\\]+(content|toc)[._ \\pL\\pN#?:\\-!$%^/,~”“’\\\\]+\\)', '# \\1', 'g') AS text FROM {DOCS_SQL}""")
def heading_rules(spark: SparkSession, d: str) -> DataFrame:
    """T7, T9."""
    return _rewritten(spark, d, lambda t, k: R.apply_rules(t, R.HEADING_LINKS + R.CONTENTS_LINKS))


def headings_promoted(spark: SparkSession, d: str) -> DataFrame:
    """T8, W6 over all converted documents, with short lines between blank ones."""
    return _rewritten(spark, d, lambda t, k: L.promote_headings(t, extra=True))


ROMAN_SQL = "(?i)^\\s*\\*?\\*?M{0,4}(CM|CD|D?C{0,3})(XC|XL|L?X{0,3})(IX|IV|V?I{0,3})\\.?\\*?\\*?$"
PART_SQL = "(?i)^\\s*\\*?\\*?Part\\s(One|Two|Three|Four|Five|Six|Seven|Eight|Nine|Ten|Eleven|Twelve|Thirteen|Fourteen|Fifteen|Sixteen|Seventeen|Eighteen|Nineteen|Twenty)\\.?\\*?\\*?$"


@query(f"""WITH l AS (SELECT doc_id, CASE WHEN content = '' THEN [] ELSE string_split(regexp_replace({UNIX_SQL}, '\\n$', ''), chr(10)) END AS ls FROM {DOCS_SQL})
    SELECT doc_id, array_to_string(list_transform(ls, lambda x, i: CASE WHEN i = 1 OR i = len(ls) OR x = '' THEN x WHEN regexp_matches(x, '{ROMAN_SQL}') THEN '#### ' || x WHEN regexp_matches(x, '{PART_SQL}') THEN '## ' || x ELSE x END), chr(10)) AS text FROM l""")
def heading_promotion(spark: SparkSession, d: str) -> DataFrame:
    """First and last line never; a line of a point alone is promoted."""
    return _rewritten(spark, d, lambda t, k: L.promote_headings(t))


def archive_frame(spark: SparkSession, d: str) -> DataFrame:
    """T1, A7 over all converted documents, each set into a frame of START and END lines."""
    framed = lambda t: F.concat(F.lit("head\n*** START OF THE PROJECT GUTENBERG EBOOK X ***\n## Contents\n- a\n## One\n"), t, F.lit("\n*** END OF THE PROJECT GUTENBERG EBOOK X ***\ntail"))
    return _rewritten(spark, d, lambda t, k: L.strip_archive_frame(framed(t)))


QUERIES |= {"footnote_rules": footnote_rules, "headings_promoted": headings_promoted, "archive_frame": archive_frame}


@query("SELECT doc_id, list_min(list_transform(regexp_extract_all(content, '(?m)^(#+)\\s+.*', 1), lambda x: CAST(length(x) AS INTEGER))) AS least FROM (SELECT DISTINCT doc_id, content FROM documents_md) WHERE content IS NOT NULL")
def least_heading_depth(spark: SparkSession, d: str) -> DataFrame:
    """A7."""
    return _documents(spark, d).filter("text IS NOT NULL").select("doc_id", F.array_min(L.heading_depths(F.col("text"))).alias("least"))


@query(r"""WITH b AS (SELECT reply_id, regexp_replace(any_value(markdown_text), '^[\s\x{A0}]+|[\s\x{A0}]+$', '', 'g') AS b FROM transcriptions GROUP BY reply_id),
    u AS (SELECT reply_id, CASE WHEN starts_with(b, '```') THEN regexp_replace(regexp_replace(regexp_replace(b, '\A```[^\n]*(\n|\z)', ''), '(\A|\n)```[^\n]*\z', ''), '^[\s\x{A0}]+|[\s\x{A0}]+$', '', 'g') ELSE b END AS b FROM b)
    SELECT reply_id, regexp_replace(regexp_replace(regexp_replace(b, '^ {0,3}(\[\^[^\]]+\]: )\[\d+\]\s*:?\s*', '\1'), '^ {0,3}(\[\^[^\]]+\]: )\d{4}\b\.?\s*', '\1'), '^ {0,3}(\[\^[^\]]+\]: )\s*:?\s*', '\1') AS text FROM u""")
def reply_postprocess(spark: SparkSession, d: str) -> DataFrame:
    """T15 over all replies: fences go; the definition rules apply at the start of the text alone."""
    return read_table(spark, d, "transcriptions").dropDuplicates(["reply_id"]).select("reply_id", R.strip_reply(F.col("markdown_text")).alias("text"))


@query("SELECT p_partkey, 'meta+' || p_name || ' ctrl+' || p_brand AS text FROM part")
def key_substitution(spark: SparkSession, d: str) -> DataFrame:
    """Order matters."""
    keys = F.concat(F.lit("ctrl+"), "p_name", F.lit(" cmd+"), "p_brand")
    return read_table(spark, d, "part").select("p_partkey", X.swap_keys(keys, "darwin_to_linux").alias("text"))


@query(f"""WITH a AS (SELECT doc_id, replace(content, ']](', chr(1)) AS c FROM {DOCS_SQL}),
    b AS (SELECT doc_id, replace(replace(regexp_replace(c, '\\[\\[([\\pL\\pN\\pM_\\s?]+?)\\]\\]', '\\\\[\\\\[\\1\\\\]\\\\]', 'g'), chr(1), ']]('), '\\_', chr(2)) AS c FROM a)
    SELECT doc_id, replace(array_to_string(list_transform(string_split(c, chr(10)), lambda x: CASE WHEN (length(x) - length(replace(x, '_', ''))) % 2 = 1 AND NOT (contains(x, '<') AND contains(x, '>')) THEN regexp_replace(x, '_([^_]*)$', '\\\\_\\1') ELSE x END), chr(10)), chr(2), '\\_') AS text FROM b""")
def escapes(spark: SparkSession, d: str) -> DataFrame:
    """T12."""
    return _rewritten(spark, d, lambda t, k: R.escape_underscores(R.apply_rules(t, R.BARE_LINKS)))


@query(f"""SELECT doc_id, regexp_replace(content, '!\\[(.*?)\\]\\(((?:[^()\\s]|\\([^()]*\\))*)(?: (?:[^()]|\\([^()]*\\))*)?\\)', '<img src="\\2" alt="\\1" width="300px">', 'g') AS text FROM {DOCS_SQL}""")
def images_to_html(spark: SparkSession, d: str) -> DataFrame:
    """T13."""
    return _rewritten(spark, d, lambda t, k: R.apply_rules(t, R.IMAGES_TO_HTML))


@query(f"SELECT doc_id, regexp_replace(regexp_replace(content, '(?i)\\[(?:PG\\s*)?[ivxlcdm]+\\]\\s?', '', 'g'), '(?i)\\[PG\\s*\\d+\\]\\s?', '', 'g') AS text FROM {DOCS_SQL}")
def roman_pages(spark: SparkSession, d: str) -> DataFrame:
    """T11."""
    return _rewritten(spark, d, lambda t, k: R.apply_rules(t, R.ROMAN_PAGE_MARKS))


@query("SELECT reply_id, regexp_replace(markdown_text, '\\[\\^([^\\]]+)\\]', '[^c' || chunk_number || '_\\1]', 'g') AS text FROM (SELECT DISTINCT reply_id, chunk_number, markdown_text FROM transcriptions)")
def footnote_namespace(spark: SparkSession, d: str) -> DataFrame:
    """T16 over all replies."""
    x = read_table(spark, d, "transcriptions").dropDuplicates(["reply_id"])
    return x.select("reply_id", R.namespace_footnotes(F.col("markdown_text"), F.col("chunk_number")).alias("text"))


def html_outline(spark: SparkSession, d: str) -> DataFrame:
    """H1, W8, W9 over all books: their lines joined to a page, then the outline of each."""
    lines = read_table(spark, d, "html_lines").dropDuplicates(["doc_id", "line_no"])
    own = F.array_sort(F.collect_list(F.struct("line_no", F.coalesce("line", F.lit("")).alias("line"))))
    pages = lines.groupBy("doc_id").agg(own.alias("own")).select("doc_id", F.array_join(F.transform("own", lambda x: x["line"]), "\n").alias("text"))
    return H.outlines(pages, ["doc_id"], "text")


def story_passages(spark: SparkSession, d: str) -> DataFrame:
    """V2–V7 over all story documents, each taken for a passage."""
    return H.passages_as_markdown(read_table(spark, d, "documents").filter("kind = 'story'").select("doc_id", "text"), ["doc_id"], "text")


QUERIES |= {"html_outline": html_outline, "story_passages": story_passages}


@query("""SELECT doc_id, passage_idx, name, true AS headed FROM (
    SELECT doc_id, 0 AS passage_idx, coalesce(nullif(lang, ''), 'Untitled Passage') AS name FROM documents WHERE kind = 'story' AND text IS NOT NULL
    UNION ALL SELECT doc_id, 1, 'Untitled Passage' FROM documents WHERE kind = 'story' AND text IS NOT NULL)""")
def story_parse(spark: SparkSession, d: str) -> DataFrame:
    """V1 over all story documents, each set into a page of two passages; ``headed``: the Markdown begins with the name."""
    x = read_table(spark, d, "documents").filter("kind = 'story' AND text IS NOT NULL")
    safe = F.replace(F.replace(F.replace("text", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    page = F.concat(F.lit('<tw-storydata name="S"><tw-passagedata name="'), F.coalesce("lang", F.lit("")), F.lit('">'), safe, F.lit("</tw-passagedata><tw-passagedata>"), safe, F.lit("</tw-passagedata></tw-storydata>"))
    got = H.stories(x.select("doc_id", page.alias("page")), ["doc_id"], "page")
    return got.select("doc_id", "passage_idx", "name", F.startswith("markdown", F.concat(F.lit("## "), "name")).alias("headed"))


@query("""SELECT plan_id, 0 AS pos, '{"chunk_number": ' || chunk_number || ', "output_range": [' || array_to_string(output_range, ', ') || ']}' AS chunk_json
    FROM (SELECT plan_id, any_value(chunk_number) AS chunk_number, any_value(output_range) AS output_range FROM chunk_plan GROUP BY plan_id) WHERE output_range IS NOT NULL AND chunk_number IS NOT NULL""")
def truncated_json_recovery(spark: SparkSession, d: str) -> DataFrame:
    """H2, H3: of a reply that breaks off in its second chunk, the first one."""
    x = read_table(spark, d, "chunk_plan").dropDuplicates(["plan_id"]).filter("output_range IS NOT NULL AND chunk_number IS NOT NULL")
    cut = F.concat(F.lit('Here it is: {"chunks":['), F.to_json(F.struct("chunk_number", "output_range")), F.lit(',{"chunk_nu'))
    return H.recovered_chunks(x.select("plan_id", cut.alias("raw")), ["plan_id"], "raw")


TITLES_SQL = "(SELECT plan_id, any_value(title) AS title FROM chunk_plan GROUP BY plan_id)"


@query(f"SELECT plan_id, trim(regexp_replace(regexp_replace(coalesce(title, ''), '[^\\pL\\pN_\\s.\\x{{A0}}-]', '', 'g'), '[\\s\\x{{A0}}]+', ' ', 'g')) AS title FROM {TITLES_SQL}")
def html_title(spark: SparkSession, d: str) -> DataFrame:
    """P11 over pages with the planned titles."""
    x = read_table(spark, d, "chunk_plan").dropDuplicates(["plan_id"])
    page = F.concat(F.lit("<html><head>\n<TITLE lang='x'>"), F.coalesce("title", F.lit("")), F.lit(" \n</title></head>"))
    return x.select("plan_id", X.html_title(page).alias("title"))


@query("""SELECT plan_id, replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(url_encode(regexp_replace(title, '[^\\pL\\pN_\\s\\x{A0}()?!.,;"''*&%$-]', '', 'g')), '%3F', '?'), '%21', '!'), '%2C', ','), '%3B', ';'), '%22', '"'), '%27', chr(39)), '%2A', '*'), '%26', '&'), '%24', '$'), '%7E', '~'), '%25', '%') AS anchor
    FROM """ + TITLES_SQL)
def anchors(spark: SparkSession, d: str) -> DataFrame:
    """X2 over the planned titles."""
    return read_table(spark, d, "chunk_plan").dropDuplicates(["plan_id"]).select("plan_id", X.encode_anchor(F.col("title")).alias("anchor"))


@query("""WITH l AS (SELECT doc_id, line_no, any_value(line) AS line FROM html_lines GROUP BY doc_id, line_no HAVING any_value(line) IS NOT NULL),
    n AS (SELECT *, CASE WHEN starts_with(line, '<p') THEN line_no || ': ' || line ELSE line END AS entry FROM l)
    SELECT doc_id, line_no, CAST(coalesce(last_value(CASE WHEN starts_with(line, '<p') THEN line_no ELSE CAST(nullif(regexp_extract(line, '^\\s*(\\d+):', 1), '') AS BIGINT) END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no), 0) AS BIGINT) AS number,
    regexp_matches(regexp_replace(regexp_replace(entry, '^\\d+:', ''), '</[^>]+>', '', 'g'), '[a-zA-Z0-9]') AS content FROM n""")
def outline_slices(spark: SparkSession, d: str) -> DataFrame:
    """F10, F11 over page lines, those of paragraphs with their number: lines without a number have the one before."""
    x = read_table(spark, d, "html_lines").dropDuplicates(["doc_id", "line_no"]).filter("line IS NOT NULL")
    x = x.withColumn("entry", F.when(F.startswith("line", F.lit("<p")), F.concat(F.col("line_no").cast("string"), F.lit(": "), "line")).otherwise(F.col("line")))
    return L.carry_number(x, "doc_id", "line_no", "entry").select("doc_id", "line_no", "number", X.outline_has_content(F.col("entry")).alias("content"))


@query("""SELECT doc_id, line_no, regexp_extract_all(line, '<a href="#([^"]*)">', 1) AS targets FROM (SELECT DISTINCT * FROM html_lines) WHERE line IS NOT NULL""")
def html_links(spark: SparkSession, d: str) -> DataFrame:
    x = read_table(spark, d, "html_lines").distinct().filter("line IS NOT NULL")
    return x.select("doc_id", "line_no", F.regexp_extract_all("line", F.lit('<a href="#([^"]*)">'), F.lit(1)).alias("targets"))
