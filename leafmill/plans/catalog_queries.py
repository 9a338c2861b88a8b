"""Catalog and forecast queries. ``part`` stands for a catalog: names repeat, prices stand for durations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.functions import text as X
from leafmill.operators import catalog as C
from leafmill.operators import forecast as W
from leafmill.sources.files import list_entries
from leafmill.sources.tables import read_table

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


@query("SELECT doc_id, kind, n_chars FROM documents WHERE coalesce(lower(kind) LIKE 'p%' AND n_chars > 1000, false)")
def catalog_filter(spark: SparkSession, d: str) -> DataFrame:
    """type prefix and size, strictly above; null fails."""
    x = read_table(spark, d, "documents")
    return x.filter(F.coalesce(F.startswith(F.lower("kind"), F.lit("p")) & (F.col("n_chars") > 1000), F.lit(False))).select("doc_id", "kind", "n_chars")


@query("SELECT p_partkey AS ord, p_retailprice AS duration FROM part WHERE p_retailprice >= 901 AND p_type IN ('SMALL', 'LARGE', 'ECONOMY') AND p_size * 100000 > 1000000")
def audio_predicate(spark: SparkSession, d: str) -> DataFrame:
    """some types of parts stand for audio, the price for a duration."""
    x = read_table(spark, d, "part")
    mime = F.when(F.col("p_type").isin("SMALL", "LARGE", "ECONOMY"), "audio/mpeg").otherwise("video/mp4")
    return x.filter(C.is_audio(mime, F.col("p_size") * 100000) & C.long_enough(F.col("p_retailprice"), 901)).select(F.col("p_partkey").alias("ord"), F.col("p_retailprice").alias("duration"))


@query("""SELECT doc_id, coalesce(meta['title'], '') AS title, coalesce(nullif(meta['type'], ''), nullif(meta['tags'], ''), '') AS artists, coalesce(regexp_extract(meta['tags'], '^[^/]*'), '') AS track
    FROM (SELECT DISTINCT doc_id, meta FROM documents_md)""")
def tag_alias_coalesce(spark: SparkSession, d: str) -> DataFrame:
    """First value of the first tag that has one; the documents' metadata stand for tags."""
    renamed = {"title": "title", "type": "TPE1", "tags": "artists"}
    x = read_table(spark, d, "documents_md").dropDuplicates(["doc_id"])
    named = F.map_from_arrays(F.array(*[F.lit(v) for v in [*renamed.values(), "TRCK"]]), F.array(*[F.array_compact(F.array(F.try_element_at("meta", F.lit(k)))) for k in [*renamed, "tags"]]))
    return x.select("doc_id", *[C.field(named, n).alias(n) for n in ("title", "artists", "track")])


@query("""SELECT o_orderkey, CASE o_orderpriority WHEN '4-NOT SPECIFIED' THEN strftime(o_orderdate, '%Y-%m') WHEN '5-LOW' THEN 'circa ' || year(o_orderdate) ELSE strftime(o_orderdate, '%Y-%m-%d') END AS normal FROM orders""")
def date_normalise(spark: SparkSession, d: str) -> DataFrame:
    """D1 over order dates, written in a form for each priority."""
    x = read_table(spark, d, "orders")
    when = F.col("o_orderdate")
    forms = {"1-URGENT": "d/M/yyyy", "2-HIGH": "yyyy-M-d", "3-MEDIUM": "dd-MM-yyyy", "4-NOT SPECIFIED": "yyyy/MM"}
    raw = F.concat(F.lit("circa "), F.year(when))
    for priority, form in forms.items():
        raw = F.when(F.col("o_orderpriority") == priority, F.date_format(when, form)).otherwise(raw)
    return x.select("o_orderkey", X.normalise_date(raw).alias("normal"))


@query("""SELECT l_orderkey, l_linenumber, count(*) AS n, CASE WHEN l_quantity BETWEEN 1 AND day(last_day(l_shipdate)) THEN strftime(l_shipdate, '%Y-%m-') || lpad(CAST(CAST(l_quantity AS INTEGER) AS VARCHAR), 2, '0') ELSE strftime(l_shipdate, '%Y-%m') END AS normal
    FROM lineitem GROUP BY l_orderkey, l_linenumber, normal""")
def date_parts(spark: SparkSession, d: str) -> DataFrame:
    """Year and month of shipment with the quantity for a day; impossible days are left out."""
    x = read_table(spark, d, "lineitem")
    normal = X.date_from_parts(F.year("l_shipdate"), F.month("l_shipdate"), F.col("l_quantity").cast("int"))
    return x.select("l_orderkey", "l_linenumber", normal.alias("normal")).groupBy("l_orderkey", "l_linenumber", "normal").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT p_partkey, CASE WHEN p_size > 25 THEN '.ogg' WHEN p_type = 'SMALL' THEN '.flac' WHEN p_type = 'LARGE' THEN '.opus' ELSE '.mp3' END AS ext FROM part")
def extension_choice(spark: SparkSession, d: str) -> DataFrame:
    """By the name, by the type, by default."""
    x = read_table(spark, d, "part")
    mime = F.when(F.col("p_type") == "SMALL", "AUDIO/FLAC").when(F.col("p_type") == "LARGE", "audio/opus")
    return x.select("p_partkey", C.audio_extension(mime, F.concat("p_name", F.when(F.col("p_size") > 25, ".ogg").otherwise(""))).alias("ext"))


@query("""SELECT p_partkey, CASE WHEN regexp_replace(p_brand || ' - ' || p_name, '[^\\pL\\pN ._-]', '', 'g') = '' THEN p_name
          ELSE regexp_replace(p_brand || ' - ' || p_name, '[^\\pL\\pN ._-]', '', 'g') END || '.mp3' AS file_name FROM part""")
def name_template_sanitise(spark: SparkSession, d: str) -> DataFrame:
    """P4, P5, P7."""
    x = read_table(spark, d, "part")
    root = X.safe_name(X.fill_template("{artist} - {title}", {"artist": F.col("p_brand"), "title": F.col("p_name")}, C.FIELDS), F.col("p_name"))
    return x.select("p_partkey", C.final_name(root, F.lit(0), F.lit(".mp3")).alias("file_name"))


KEPT_SQL = """
    SELECT p_name, unnest(kept) AS r FROM (
      SELECT p_name, list_reduce(list(l ORDER BY o), lambda acc, x: CASE WHEN len(list_filter(acc, lambda k: abs(k.v - x[1].v) < 1.0)) > 0 THEN acc ELSE list_concat(acc, x) END) AS kept
      FROM (SELECT p_name, p_partkey AS o, [{'o': p_partkey, 'v': p_retailprice}] AS l FROM part WHERE p_retailprice IS NOT NULL) GROUP BY p_name)
"""


@query(f"SELECT p_name, r.o AS p_partkey, r.v AS p_retailprice, CAST(row_number() OVER (PARTITION BY p_name ORDER BY r.o) - 1 AS BIGINT) AS copy_no FROM ({KEPT_SQL})")
def tolerance_dedup(spark: SparkSession, d: str) -> DataFrame:
    """The greedy fold, never a comparison with the row before alone."""
    return C.drop_near_equal(read_table(spark, d, "part"), "p_name", "p_retailprice", "p_partkey").withColumn("copy_no", F.col("copy_no").cast("bigint"))


@query(f"""SELECT 0 AS line_no, '#EXTM3U' AS line UNION ALL
    SELECT r.o AS line_no, p_name || CASE WHEN n > 0 THEN '_(' || n || ')' ELSE '' END || '.mp3' AS line
    FROM (SELECT p_name, r, row_number() OVER (PARTITION BY p_name ORDER BY r.o) - 1 AS n FROM ({KEPT_SQL}))""")
def playlist_lines(spark: SparkSession, d: str) -> DataFrame:
    """K1 over W1: the playlist of the deduplicated catalog."""
    kept = C.drop_near_equal(read_table(spark, d, "part"), "p_name", "p_retailprice", "p_partkey")
    return C.playlist(kept.withColumn("path", C.final_name(F.col("p_name"), F.col("copy_no"), F.lit(".mp3"))), "path", "p_partkey")


@query("SELECT 'music/' || p_name AS src, 'copy/' || p_name AS dst, CASE WHEN p_name IN (SELECT p_name FROM part WHERE p_size > 25) THEN 'skip' ELSE 'copy' END AS action FROM part")
def copy_plan(spark: SparkSession, d: str) -> DataFrame:
    """K2, J2."""
    x = read_table(spark, d, "part")
    there = x.filter("p_size > 25").select(F.concat(F.lit("copy/"), "p_name").alias("path"))
    return C.copy_plan(x.select(F.concat(F.lit("music/"), "p_name").alias("s"), F.concat(F.lit("copy/"), "p_name").alias("t")), there, "s", "t")


@query("""SELECT doc_id, list_transform(list_filter(string_split(text, chr(10)), lambda l: trim(l, ' ' || chr(13)) <> '' AND NOT starts_with(trim(l, ' ' || chr(13)), '#')), lambda l: regexp_extract(trim(l, ' ' || chr(13)), '([^/]*)$', 1)) AS names
          FROM documents WHERE kind = 'playlist' AND text IS NOT NULL""")
def playlist_entries(spark: SparkSession, d: str) -> DataFrame:
    """Entries of playlist documents without comments and blanks."""
    x = read_table(spark, d, "documents").filter("kind = 'playlist' AND text IS NOT NULL")
    return x.select("doc_id", F.transform(list_entries(F.col("text")), X.file_name).alias("names"))


def _event_days(spark: SparkSession, d: str) -> DataFrame:
    x = read_table(spark, d, "events")
    k = F.get_json_object("props", "$.k").cast("double")
    slots = x.select(
        F.col("user_id").alias("place"), F.col("event_id").alias("pos"), F.date_format("ts", "yyyy-MM-dd").alias("date"), F.date_format("ts", "HH:mm:ss").alias("hour"),
        F.col("event_type").alias("condition"), F.col("value").alias("min_temp"), (F.col("value") * 2).alias("max_temp"), k.alias("humidity"), F.lit(1.0).alias("wind"),
        W.optional(F.when(F.col("event_type") == "click", F.lit(1))).alias("rain"), F.lit(" ").alias("snow"),
    )
    return W.day_runs(slots, "place", "pos")


@query("""SELECT place, pos, "date", "hour", humidity, rain, CAST(sum(changed) OVER (PARTITION BY place ORDER BY pos) AS BIGINT) AS day_idx FROM (
    SELECT user_id AS place, event_id AS pos, strftime(ts, '%Y-%m-%d') AS "date", strftime(ts, '%H:%M:%S') AS "hour", CAST(json_extract_string(props, '$.k') AS DOUBLE) AS humidity,
    CASE WHEN event_type = 'click' THEN '1' ELSE ' ' END AS rain,
    CASE WHEN strftime(ts, '%Y-%m-%d') <> lag(strftime(ts, '%Y-%m-%d')) OVER (PARTITION BY user_id ORDER BY event_id) THEN 1 ELSE 0 END AS changed FROM events)""")
def forecast_by_day(spark: SparkSession, d: str) -> DataFrame:
    """P1, A1, D3 over events, a place for each user."""
    return _event_days(spark, d).select("place", "pos", "date", "hour", "humidity", "rain", "day_idx")


@query("""SELECT event_id, 0 AS pos, strftime(ts, '%Y-%m-%d') AS "date", strftime(ts, '%H:%M') AS "hour", event_type AS condition, value AS min_temp, CASE WHEN event_type = 'click' THEN '0.5' ELSE ' ' END AS rain, ' ' AS snow FROM events""")
def optional_field_default(spark: SparkSession, d: str) -> DataFrame:
    """Forecast JSON with a slot for each event; missing members are a blank."""
    x = read_table(spark, d, "events")
    slot = F.struct(
        F.date_format("ts", "yyyy-MM-dd HH:mm").alias("dt_txt"), F.array(F.struct(F.col("event_type").alias("description"))).alias("weather"),
        F.struct(F.col("value").alias("temp_min")).alias("main"), F.when(F.col("event_type") == "click", F.struct(F.lit(0.5).alias("3h"))).alias("rain"),
    )
    body = x.select("event_id", F.to_json(F.struct(F.array(slot).alias("list"))).alias("body"))
    return W.flatten_slots(body, "event_id", "body").select("event_id", "pos", "date", "hour", "condition", "min_temp", "rain", "snow")


@query("""WITH e AS (SELECT user_id AS place, event_id AS pos, strftime(ts, '%Y-%m-%d') AS d, CASE WHEN strftime(ts, '%Y-%m-%d') <> lag(strftime(ts, '%Y-%m-%d')) OVER (PARTITION BY user_id ORDER BY event_id) THEN 1 ELSE 0 END AS c,
        strftime(ts, '%H:%M:%S') AS h, event_type, value, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events),
    g AS (SELECT *, CAST(sum(c) OVER (PARTITION BY place ORDER BY pos) AS BIGINT) AS day_idx FROM e)
    SELECT place, CAST(-1 AS BIGINT) AS day_idx, 0 AS kind, CAST(0 AS BIGINT) AS seq, 'Hour' AS c0, 'Condition' AS c1, CAST(NULL AS DOUBLE) AS c2, CAST(NULL AS DOUBLE) AS c3, CAST(NULL AS DOUBLE) AS c4, CAST(NULL AS DOUBLE) AS c5, 'Rain(mm)' AS c6, 'Snow(mm)' AS c7 FROM (SELECT DISTINCT place FROM g)
    UNION ALL SELECT place, day_idx, 1, 0, '', '', NULL, NULL, NULL, NULL, '', '' FROM (SELECT DISTINCT place, day_idx FROM g)
    UNION ALL SELECT place, day_idx, 2, 0, '(' || arg_min(d, pos) || ')', '', NULL, NULL, NULL, NULL, '', '' FROM g GROUP BY place, day_idx
    UNION ALL SELECT place, day_idx, 3, pos, h, event_type, round(value, 6), round(value * 2, 6), k, 1.0, CASE WHEN event_type = 'click' THEN '1' ELSE ' ' END, ' ' FROM g""")
def forecast_sections(spark: SparkSession, d: str) -> DataFrame:
    """K3: header, empty row, banner and slots of each day; the cells of numbers as numbers, those of the header and banner null."""
    x = W.sections(_event_days(spark, d), "place", "pos")
    number = lambda c: F.round(F.expr(f"try_cast({c} AS double)"), 6).alias(c)
    return x.select("place", "day_idx", "kind", "seq", "c0", "c1", *[number(c) for c in ("c2", "c3", "c4", "c5")], "c6", "c7")
