"""Queries over references, indexes, orders, ages and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.functions import text as X
from leafmill.operators import catalog as C
from leafmill.operators import groups as G
from leafmill.operators import refs as R
from leafmill.operators.order import in_parts, running_sum
from leafmill.sources.tables import read_table
from leafmill.streaming.resume import event_windows

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


@query("SELECT doc_id, text LIKE '%Category:%' OR text LIKE '%Appendix:%' AS extra FROM documents WHERE text IS NOT NULL")
def title_partition(spark: SparkSession, d: str) -> DataFrame:
    """not anchored."""
    return read_table(spark, d, "documents").filter("text IS NOT NULL").select("doc_id", G.is_extra(F.col("text")).alias("extra"))


@query("""WITH t AS (SELECT p_name AS title, upper(substr(p_name, 1, 1)) AS letter FROM part WHERE length(p_name) > 0), g AS (SELECT letter, row_number() OVER (ORDER BY min(title), letter) AS group_no FROM t GROUP BY letter)
    SELECT t.letter, group_no, title FROM t JOIN g USING (letter)""")
def letter_index(spark: SparkSession, d: str) -> DataFrame:
    """Groups in the order of their least title."""
    return G.letter_index(read_table(spark, d, "part"), "p_name")


@query("""WITH t AS (SELECT p_name AS title, upper(substr(p_name, 1, 1)) AS letter FROM part WHERE length(p_name) > 0), g AS (SELECT letter, row_number() OVER (ORDER BY min(title), letter) AS group_no FROM t GROUP BY letter)
    SELECT group_no, 0 AS kind, '' AS title, '## ' || letter AS line FROM g UNION ALL SELECT group_no, 1, title, '- ' || title FROM t JOIN g USING (letter)""")
def index_lines(spark: SparkSession, d: str) -> DataFrame:
    """K5."""
    return G.index_lines(letter_index(spark, d))


@query("""SELECT doc_id, list_transform(regexp_extract_all(text, '!\\[\\[([^\\]|]+)(?:\\|[^\\n]*)?\\]\\]', 1), lambda x: trim(x)) AS refs FROM documents WHERE kind = 'note' AND text IS NOT NULL""")
def note_embeds(spark: SparkSession, d: str) -> DataFrame:
    """R1 over all notes, the alias greedy as in the original."""
    x = read_table(spark, d, "documents").filter("kind = 'note' AND text IS NOT NULL")
    return x.select("doc_id", F.transform(F.regexp_extract_all("text", F.lit(R.EMBED_GREEDY), F.lit(1)), lambda v: F.trim(v)).alias("refs"))


REFS_SQL = """r AS (SELECT source, unnest(list_concat(list_concat(list_transform(regexp_extract_all(text, '!\\[\\[([^\\]|]+)(?:\\|[^\\]]*)?\\]\\]', 1), lambda x: trim(x)),
        list_transform(regexp_extract_all(text, '!\\[.*?\\]\\(([^)]+)\\)', 1), lambda x: split_part(trim(split_part(split_part(x, '"', 1), chr(39), 1)), '?', 1))),
        list_concat(list_transform(regexp_extract_all(text, '<img[^>]+src=["'']([^"'']+)["'']', 1), lambda x: split_part(trim(x), '?', 1)),
        list_transform(regexp_extract_all(regexp_extract(text, '(?s)\\A---\\n(.*?)\\n---', 1), '(?i):\\s*"?([^"\\n]+\\.(?:png|jpg|jpeg|gif|svg|webp|bmp|tiff))"?', 1), lambda x: trim(x))))) AS ref FROM documents WHERE text IS NOT NULL),
    t AS (SELECT DISTINCT source, array_to_string(list_transform(list_filter(string_split(url_decode(ref), '/'), lambda p: p NOT IN ('', '.', chr(92))), lambda p: lower(p)), '/') AS tail FROM r)"""


@query(f"WITH {REFS_SQL} SELECT source, tail FROM t WHERE tail <> ''")
def note_references(spark: SparkSession, d: str) -> DataFrame:
    """Distinct references of all documents by source."""
    return R.reference_tails(read_table(spark, d, "documents"), "text", ["source"], parity=False)


FILES_SQL = "(SELECT file, sum(pages) AS pages FROM (SELECT DISTINCT file, batch_no, pages FROM files_pages) GROUP BY file)"
USED_SQL = "(SELECT DISTINCT lower(regexp_extract(file, '[^/]*/[^/]*$')) AS tail FROM chunk_texts WHERE content IS NULL OR content = '' OR chunk_idx >= 10)"
ORPHANS_SQL = f"SELECT split_part(file, '/', 2) AS vault, '/v/' || file AS path, CAST(coalesce(pages, 0) * 100000 AS BIGINT) AS length FROM {FILES_SQL} f WHERE NOT EXISTS (SELECT 1 FROM {USED_SQL} u WHERE ends_with('/' || lower(file), '/' || tail))"


@query(ORPHANS_SQL)
def orphan_suffix_antijoin(spark: SparkSession, d: str) -> DataFrame:
    """Scanned files stand for images, chunks that are empty or far on for the notes that refer to them."""
    vault = F.split_part("file", F.lit("/"), F.lit(2)).alias("vault")
    pages = read_table(spark, d, "files_pages").dropDuplicates(["file", "batch_no"]).groupBy("file").agg(F.coalesce(F.sum("pages"), F.lit(0)).alias("pages"))
    images = pages.select(vault, F.concat(F.lit("/v/"), "file").alias("path"), (F.col("pages") * 100000).cast("bigint").alias("length"))
    far = read_table(spark, d, "chunk_texts").filter("content IS NULL OR content = '' OR chunk_idx >= 10")
    notes = far.select(vault, F.concat(F.lit("see ![["), F.upper(F.regexp_extract("file", r"[^/]*/[^/]*$", 0)), F.lit("|200]]")).alias("text"))
    return R.orphans(images, R.reference_tails(notes, "text", ["vault"]), "path", ["vault"])


@query(f"""SELECT vault, CAST(count(*) AS BIGINT) AS n_images, CAST(sum(length) AS BIGINT) AS n_bytes, CASE WHEN sum(length) < 1024 THEN printf('%.2f Bytes', CAST(sum(length) AS DOUBLE)) WHEN sum(length) < 1048576 THEN printf('%.2f KB', sum(length) / 1024.0::DOUBLE)
    WHEN sum(length) < 1073741824 THEN printf('%.2f MB', sum(length) / 1048576.0::DOUBLE) ELSE printf('%.2f GB', sum(length) / 1073741824.0::DOUBLE) END AS readable FROM ({ORPHANS_SQL}) GROUP BY vault""")
def orphan_report(spark: SparkSession, d: str) -> DataFrame:
    """A4, A9."""
    return R.orphan_report(orphan_suffix_antijoin(spark, d), "length", ["vault"])


@query(f"SELECT 'delete' AS action, path FROM ({ORPHANS_SQL})")
def delete_plan(spark: SparkSession, d: str) -> DataFrame:
    """What would be deleted; nothing is."""
    return R.delete_plan(orphan_suffix_antijoin(spark, d), "path")


@query("""SELECT doc_id, CASE WHEN n < 1024 THEN printf('%.2f Bytes', n) WHEN n < 1048576 THEN printf('%.2f KB', n / 1024) WHEN n < 1073741824 THEN printf('%.2f MB', n / 1048576) ELSE printf('%.2f GB', n / 1073741824) END AS readable
    FROM (SELECT doc_id, CAST(coalesce(n_chars, 0) * coalesce(n_chars, 0) AS DOUBLE) AS n FROM documents)""")
def readable_sizes(spark: SparkSession, d: str) -> DataFrame:
    """P: sizes of all magnitudes, the squares of the documents' lengths."""
    return read_table(spark, d, "documents").select("doc_id", X.human_size(F.col("n_chars") * F.col("n_chars")).alias("readable"))


@query("""SELECT file, CAST(row_number() OVER (ORDER BY list_transform(regexp_extract_all(lower(file), '[0-9]+|[^0-9]+'), lambda x: CASE WHEN regexp_matches(x, '^[0-9]') THEN lpad(x, 30, '0') ELSE x END), file) AS BIGINT) AS rank FROM (SELECT DISTINCT file FROM files_pages)""")
def natural_sort_rank(spark: SparkSession, d: str) -> DataFrame:
    """The files' numbers in natural order, in parts (see ``order``)."""
    files = read_table(spark, d, "files_pages").select("file").distinct().select("file", X.natural_key(F.col("file")).alias("key"), F.lit(1).cast("bigint").alias("one"))
    return running_sum(in_parts(files, ["key", "file"]), ["key", "file"], "one", "rank").select("file", "rank")


@query("""SELECT doc_id, array_to_string(list_concat([coalesce(lang, '-')], list_filter([coalesce(kind, '-'), coalesce(lang, '-'), coalesce(source, '-')], lambda x: x <> coalesce(lang, '-'))), ',') AS models FROM documents""")
def order_preserving_union(spark: SparkSession, d: str) -> DataFrame:
    """The language first, then what else describes the document."""
    name = lambda c: F.coalesce(c, F.lit("-"))
    x = read_table(spark, d, "documents")
    return x.select("doc_id", F.array_join(G.order_union(F.array(name("lang")), F.array(name("kind"), name("lang"), name("source"))), ",").alias("models"))


@query("""SELECT doc_id, CASE WHEN n_chars > 1000 THEN '.' || kind || '.assets/cover.png' WHEN n_chars > 500 THEN '.' || kind || '.assets/Cover.jpg' END AS cover FROM documents""")
def cover_choice(spark: SparkSession, d: str) -> DataFrame:
    """Of the covers that there are, the first of six names."""
    file = lambda name: F.concat(F.lit("."), "kind", F.lit(f".assets/{name}"))
    there = F.array_compact(F.array(F.when(F.col("n_chars") > 500, file("Cover.jpg")), F.when(F.col("n_chars") > 1000, file("cover.png")), F.lit("other.png")))
    return read_table(spark, d, "documents").select("doc_id", R.cover(F.col("kind"), there).alias("cover"))


@query("""WITH f AS (SELECT DISTINCT file, string_split('m/' || file, '/') AS p, ['m', 'scans', split_part(file, '/', 2), 'lists'] AS b, ['m', 'scans', 'audio'] AS c FROM files_pages)
    SELECT file, CASE WHEN starts_with(file, 'scans/audio/') THEN substr(file, 13) ELSE '/m/' || file END AS below, '../' || split_part(file, '/', 3) AS near, CASE WHEN p[3] = 'audio' THEN p[4] ELSE '../' || p[3] || '/' || p[4] END AS way FROM f""")
def relative_paths(spark: SparkSession, d: str) -> DataFrame:
    """By prefix alone, and with ``..`` from a folder beside and from another one."""
    x = read_table(spark, d, "files_pages").select("file").distinct()
    path = F.concat(F.lit("/m/"), "file")
    beside = F.concat(F.lit("/m/scans/"), F.split_part("file", F.lit("/"), F.lit(2)), F.lit("/lists"))
    return x.select("file", X.relative_to(path, F.lit("/m/scans/audio")).alias("below"), X.relative_path(path, beside).alias("near"), X.relative_path(path, F.lit("/m/scans/audio/")).alias("way"))


@query("SELECT user_id, arg_max(event_type, ts) AS latest, max(ts) AS at, date_diff('second', max(ts), TIMESTAMP '2031-01-01') // 60 AS minutes, date_diff('second', max(ts), TIMESTAMP '2031-01-01') // 60 > 15 AS settled FROM events GROUP BY user_id")
def latest_and_age(spark: SparkSession, d: str) -> DataFrame:
    """A10, N4, D4, F7."""
    x = read_table(spark, d, "events")
    got = G.latest(x, ["user_id"], "event_type", F.col("ts"))
    seconds = F.unix_timestamp(F.date_trunc("second", F.col("at").cast("timestamp")))
    minutes = X.minutes_since(F.unix_timestamp(F.lit("2031-01-01 00:00:00")), seconds)
    return got.select("user_id", "latest", "at", minutes.alias("minutes"), G.settled(minutes).alias("settled"))


@query("SELECT event_id, CASE WHEN strftime(ts, '%H:%M') > '09:00' THEN '06:00-09:00' WHEN strftime(ts, '%H:%M') > '12:00' THEN '09:00-12:00' END AS block FROM events")
def time_block(spark: SparkSession, d: str) -> DataFrame:
    """The first block that has ended."""
    return read_table(spark, d, "events").select("event_id", G.time_block(F.date_format("ts", "HH:mm"), ["06:00-09:00", "09:00-12:00", "12:00-18:00"]).alias("block"))


@query("SELECT l_orderkey AS k FROM lineitem WHERE l_quantity > 49 UNION ALL SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F'")
def union_all(spark: SparkSession, d: str) -> DataFrame:
    """U1."""
    a = read_table(spark, d, "lineitem").filter("l_quantity > 49").select(F.col("l_orderkey").alias("k"))
    return a.unionByName(read_table(spark, d, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("k")))


@query("SELECT file, count(*) AS n FROM (SELECT DISTINCT * FROM files_pages) WHERE file NOT LIKE 'scans/misc/%' AND lower(regexp_extract(file, '(\\.[^.]*)$', 1)) = '.pdf' GROUP BY file")
def path_filters(spark: SparkSession, d: str) -> DataFrame:
    """extension without case, path prefix excluded."""
    x = read_table(spark, d, "files_pages").distinct()
    return x.filter(~F.startswith("file", F.lit("scans/misc/")) & X.extension(F.col("file")).isin(".pdf")).groupBy("file").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderpriority = '1-URGENT'")
def equality_filter(spark: SparkSession, d: str) -> DataFrame:
    """the predicate and two columns reach the scan."""
    return read_table(spark, d, "orders").filter("o_orderpriority = '1-URGENT'").select("o_orderkey", "o_custkey")


@query("SELECT doc_id, CAST(count(*) FILTER (WHERE NOT failed) AS BIGINT) AS n_ok, CAST(count(*) FILTER (WHERE failed) AS BIGINT) AS n_failed FROM (SELECT DISTINCT *, coalesce(trim(markdown_text), '') = '' AS failed FROM transcriptions) GROUP BY doc_id")
def success_counters(spark: SparkSession, d: str) -> DataFrame:
    """Replies with a text, and those without."""
    x = read_table(spark, d, "transcriptions").distinct()
    failed = F.coalesce(F.trim("markdown_text"), F.lit("")) == ""
    return x.groupBy("doc_id").agg(F.count_if(~failed).alias("n_ok"), F.count_if(failed).alias("n_failed"))


@query("SELECT c_custkey, n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def lookup_join(spark: SparkSession, d: str) -> DataFrame:
    """Small sides by Spark's own size check, no forced broadcast."""
    n = read_table(spark, d, "nation").join(read_table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return read_table(spark, d, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name", "r_name")


@query("SELECT p_partkey, substr(md5(p_name), 1, 4) AS short FROM part")
def short_digests(spark: SparkSession, d: str) -> DataFrame:
    """X5, K11."""
    return read_table(spark, d, "part").select("p_partkey", X.short_digest(F.col("p_name")).alias("short"))


@query("SELECT date_trunc('day', ts) AS window_start, event_type, count(*) AS n_events, sum(value) AS total FROM events GROUP BY 1, 2")
def event_windows_by_day(spark: SparkSession, d: str) -> DataFrame:
    """The streaming extension's aggregation over a table."""
    x = event_windows(read_table(spark, d, "events"))
    return x.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n_events", F.round("total", 6).alias("total"))


ORACLES["event_windows_by_day"] = ORACLES["event_windows_by_day"].replace("sum(value)", "round(sum(value), 6)")


def random_pick(spark: SparkSession, d: str) -> DataFrame:
    """One row at random."""
    return G.random_pick(read_table(spark, d, "part").select("p_partkey"))


QUERIES["random_pick"] = random_pick
