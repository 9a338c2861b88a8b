"""Queries over files: tables are written to the shared folder and read back by the sources; names and heads of files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.functions import text as X
from leafmill.sources import files as S
from leafmill.sources import sinks
from leafmill.sources.scratch import scratch_path
from leafmill.sources.tables import read_table

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


CONTENT_SQL = "(SELECT chunk_id, any_value(file) AS file, any_value(chunk_idx) AS chunk_idx, any_value(content) AS content FROM chunk_texts GROUP BY chunk_id)"


@query(f"SELECT CAST(chunk_idx AS INTEGER) AS chunk_idx, CAST(sum(len(regexp_split_to_array(content, '\\r\\n|\\r|\\n'))) AS BIGINT) AS n_lines FROM {CONTENT_SQL} WHERE content <> '' GROUP BY chunk_idx")
def chunk_files(spark: SparkSession, d: str) -> DataFrame:
    """K6: chunk texts in a folder for each index, and the lines that are read back from it."""
    path = scratch_path(spark)
    x = read_table(spark, d, "chunk_texts").dropDuplicates(["chunk_id"]).filter("content <> ''")
    sinks.write_chunks(x.select("chunk_idx", F.col("content").alias("text")), path)
    return spark.read.text(path).groupBy(F.col("chunk_idx").cast("int").alias("chunk_idx")).agg(F.count(F.lit(1)).alias("n_lines"))


@query(f"SELECT count(DISTINCT chunk_idx) AS n_folders, true AS sizes_known FROM {CONTENT_SQL} WHERE content <> ''")
def file_inventory(spark: SparkSession, d: str) -> DataFrame:
    """The files of such folders, listed without being read."""
    path = scratch_path(spark)
    x = read_table(spark, d, "chunk_texts").dropDuplicates(["chunk_id"]).filter("content <> ''")
    sinks.write_chunks(x.select("chunk_idx", F.col("content").alias("text")), path)
    listed = S.inventory(spark, path, "*.txt")
    return listed.agg(F.count_distinct(F.regexp_extract("path", r"chunk_idx=(\d+)/", 1)).alias("n_folders"), F.bool_and((F.col("length") > 0) & (F.col("ext") == ".txt")).alias("sizes_known"))


@query("SELECT doc_id, coalesce(meta['title'], '') AS title, length(content) + 1 AS n_chars FROM (SELECT DISTINCT doc_id, meta, content FROM documents_md) WHERE content IS NOT NULL AND NOT starts_with(content, '---')")
def documents_read(spark: SparkSession, d: str) -> DataFrame:
    """Documents written as whole files with front matter, and read with it split off."""
    path = scratch_path(spark)
    x = read_table(spark, d, "documents_md").dropDuplicates(["doc_id"]).filter("content IS NOT NULL AND NOT startswith(content, '---')")
    sinks.write_texts(x.select("doc_id", F.concat(sinks.front_matter(F.col("meta")), "content").alias("text")), "doc_id", "text", path)
    got = S.read_documents(spark, path)
    return got.select(F.regexp_extract("path", "doc_id=([^/]+)/", 1).alias("doc_id"), F.coalesce(F.try_element_at("meta", F.lit("title")), F.lit("")).alias("title"), F.length("text").cast("bigint").alias("n_chars"))


@query("""SELECT doc_id, chunk_number, coalesce(title, '') AS title, len(output_range) AS n_range, count(*) AS n FROM (SELECT plan_id, any_value(doc_id) AS doc_id, any_value(chunk_number) AS chunk_number, any_value(title) AS title, any_value(output_range) AS output_range FROM chunk_plan GROUP BY plan_id)
    GROUP BY doc_id, chunk_number, title, n_range""")
def plan_artifacts(spark: SparkSession, d: str) -> DataFrame:
    """A document's plan written as one JSON artifact, and the chunks read from all of them."""
    path = scratch_path(spark)
    x = read_table(spark, d, "chunk_plan").dropDuplicates(["plan_id"])
    chunk = F.struct("chunk_number", "title", "output_range", "contexts")
    plans = x.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("plan_id", chunk.alias("c")))).alias("own"))
    body = F.to_json(F.struct(F.transform("own", lambda p: p["c"]).alias("chunks"), F.lit(True).alias("complete")))
    sinks.write_texts(plans.select("doc_id", body.alias("text")), "doc_id", "text", path)
    got = S.read_plan(spark, path, keep=["doc_id"])
    return got.groupBy("doc_id", "chunk_number", F.coalesce("title", F.lit("")).alias("title"), F.size("output_range").alias("n")).agg(F.count(F.lit(1)).alias("k")).select(
        "doc_id", "chunk_number", "title", F.when(F.col("n") >= 0, F.col("n")).cast("bigint").alias("n_range"), F.col("k").alias("n")
    )


@query("SELECT DISTINCT file, regexp_replace(split_part(regexp_extract(file, '[^/]*$'), '.', 1), '[^A-Za-z0-9]', '_', 'g') AS slug FROM files_pages")
def url_slugs(spark: SparkSession, d: str) -> DataFrame:
    """P10."""
    x = read_table(spark, d, "files_pages").select("file").distinct()
    return x.select("file", X.url_slug(F.concat(F.lit("https://host/a/"), "file", F.lit("/"))).alias("slug"))


@query("""SELECT plan_id, replace(regexp_replace(title, '[()/\\\\]', '', 'g'), ' ', '_') AS book, coalesce(nullif(trim(regexp_replace(title, '[\\\\/*?:"<>|]', '', 'g')), ''), 'output') AS story
    FROM (SELECT plan_id, any_value(title) AS title FROM chunk_plan GROUP BY plan_id) WHERE title IS NOT NULL""")
def file_names(spark: SparkSession, d: str) -> DataFrame:
    """Titles as names of files, for books and for stories."""
    x = read_table(spark, d, "chunk_plan").dropDuplicates(["plan_id"]).filter("title IS NOT NULL")
    return x.select("plan_id", X.book_file_name(F.col("title")).alias("book"), X.story_file_name(F.col("title")).alias("story"))


@query("SELECT reply_id, NOT regexp_matches(any_value(markdown_text), '\\}[\\s\\x{A0}]*$') AS truncated FROM transcriptions WHERE markdown_text IS NOT NULL GROUP BY reply_id")
def truncated_replies(spark: SparkSession, d: str) -> DataFrame:
    """H4: the heuristic of JSON replies."""
    x = read_table(spark, d, "transcriptions").dropDuplicates(["reply_id"]).filter("markdown_text IS NOT NULL")
    return x.select("reply_id", X.looks_truncated(F.col("markdown_text")).alias("truncated"))


@query("""SELECT p_partkey, CASE p_type WHEN 'SMALL' THEN 'audio/flac' WHEN 'LARGE' THEN 'audio/ogg' WHEN 'PROMO' THEN 'audio/mpeg' WHEN 'ECONOMY' THEN 'audio/mp4' END AS mime, CASE WHEN p_size > 25 THEN p_retailprice ELSE p_size * 2.0 END AS duration FROM part""")
def sniffed_types(spark: SparkSession, d: str) -> DataFrame:
    """Types by the first bytes, and durations from tags or else from a probe."""
    x = read_table(spark, d, "part")
    heads = {"SMALL": "fLaC\0", "LARGE": "OggS", "PROMO": "ID3\4", "ECONOMY": "\0\0\0 ftypM4A "}
    head = F.lit("text")
    for kind, sign in heads.items():
        head = F.when(F.col("p_type") == kind, F.concat(F.lit(sign), "p_name")).otherwise(head)
    tagged = F.when(F.col("p_size") > 25, F.col("p_retailprice"))
    return x.select("p_partkey", S.sniff_mime(head).alias("mime"), S.known_duration(tagged, F.col("p_size") * 2.0).alias("duration"))
