"""The library's operators on literal cases, with the rows they must give as SQL values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafmill.functions import rules as RULES
from leafmill.functions import text as X
from leafmill.operators import catalog as C
from leafmill.operators import footnotes as N
from leafmill.operators import forecast as W
from leafmill.operators import groups as G
from leafmill.operators import html as H
from leafmill.operators import lines as L
from leafmill.operators import plan as P
from leafmill.operators import refs as REFS

CASES = {}


def query(sql: str):
    def add(f):
        CASES[f.__name__] = (f, sql)
        return f

    return add


TAGS = [
    (1, {"TIT2": [], "title": ["Song A"], "TPE1": ["X"], "TRCK": ["3/12"], "date": ["2019-6-2"]}),
    (2, {"title": ["B", "C"], "artists": ["Y"], "tracknumber": ["7"], "TDRC": ["12/06/2019"]}),
    (3, {"TPE2": ["Z"], "year": ["2001"], "TYER": ["circa 1990"]}),
    (4, {}),
]


@query("""SELECT * FROM (VALUES (1, 'Song A', 'X', 'X', '3', '2019-06-02', ''), (2, 'B', '', 'Y', '7', '2019-06-12', '2019-06-12'),
          (3, '', '', 'Z', '', 'circa 1990', 'circa 1990'), (4, '', '', '', '', '', '')) AS t(id, title, artist, artists, track, "date", "year")""")
def tag_alias_coalesce(spark: SparkSession, d: str) -> DataFrame:
    """First value of the first tag that has one."""
    x = spark.createDataFrame(TAGS, "id int, tags map<string,array<string>>")
    return x.select("id", *[C.field(F.col("tags"), n).alias(n) for n in ("title", "artist", "artists", "track", "date", "year")])


DATES = ["2019-06-12", "2019/06/12", "12-06-2019", "12/06/2019", "2019-6-2", "2019/06", "2019", "1206", "circa 1990", " 2020-01 ", "2019-02-30", "0000", None]


@query("""SELECT * FROM (VALUES (0,'2019-06-12'),(1,'2019-06-12'),(2,'2019-06-12'),(3,'2019-06-12'),(4,'2019-06-02'),(5,'2019-06'),(6,'2019'),(7,'1206'),
          (8,'circa 1990'),(9,'2020-01'),(10,'2019-02-30'),(11,'0000'),(12,'')) AS t(i, normal)""")
def date_normalise(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame(list(enumerate(DATES)), "i int, raw string").select("i", X.normalise_date(F.col("raw")).alias("normal"))


@query("SELECT * FROM (VALUES (0,'2019-02'),(1,'1900-06'),(2,'2020-02-29'),(3,'2020')) AS t(i, normal)")
def date_parts(spark: SparkSession, d: str) -> DataFrame:
    x = spark.createDataFrame([(0, 2019, 2, 30), (1, 0, 6, None), (2, 2020, 2, 29), (3, 2020, None, 4)], "i int, y int, m int, d int")
    return x.select("i", X.date_from_parts(F.col("y"), F.col("m"), F.col("d")).alias("normal"))


@query("SELECT * FROM (VALUES (0, '.ogg'), (1, '.mp3'), (2, '.flac'), (3, '.opus'), (4, '.mp3')) AS t(i, ext)")
def extension_choice(spark: SparkSession, d: str) -> DataFrame:
    """P6."""
    x = spark.createDataFrame([(0, "audio/mpeg", "a.ogg"), (1, "audio/mpeg", "a"), (2, "AUDIO/FLAC", "b"), (3, "audio/opus", "c"), (4, None, "d")], "i int, mime string, name string")
    return x.select("i", C.audio_extension(F.col("mime"), F.col("name")).alias("ext"))


FORECAST = '{"list":[{"dt_txt":"d1 09:00","weather":[{"description":"mist"}],"main":{"temp_min":1.5,"temp_max":2.5,"humidity":80},"wind":{"speed":3.5},"rain":{"3h":0.25}},{"dt_txt":"d1 12:00","weather":[],"main":{"temp_min":1.0,"temp_max":2.0,"humidity":81},"wind":{"speed":3.0}},{"dt_txt":"d2 00:00","main":{"temp_min":0.5,"temp_max":1.0,"humidity":82},"wind":{"speed":2.0},"snow":{"3h":1.5}},{"dt_txt":"d1 03:00","main":{},"wind":{}}]}'


@query("""SELECT * FROM (VALUES (0,'d1','09:00','mist',CAST(1.5 AS DOUBLE),'0.25',' ',0),(1,'d1','12:00',NULL,1.0,' ',' ',0),(2,'d2','00:00',NULL,0.5,' ','1.5',1),(3,'d1','03:00',NULL,NULL,' ',' ',2))
          AS t(pos, "date", "hour", condition, min_temp, rain, snow, day_idx)""")
def optional_field_default(spark: SparkSession, d: str) -> DataFrame:
    """Missing members, and a day that comes back is a new group."""
    x = W.flatten_slots(spark.createDataFrame([("k", FORECAST)], "place string, body string"), "place", "body")
    return W.day_runs(x, "place", "pos").select("pos", "date", "hour", "condition", "min_temp", "rain", "snow", F.col("day_idx").cast("int").alias("day_idx"))


def _cases(spark: SparkSession, cases: list, columns: str) -> DataFrame:
    return spark.createDataFrame([(i, *(c if isinstance(c, tuple) else (c,))) for i, c in enumerate(cases)], f"i int, {columns}")


@query("SELECT * FROM (VALUES (0, '1-2, 9, 4-5'), (1, ''), (2, '7'), (3, '3, 3, 2')) AS t(i, runs)")
def integer_islands(spark: SparkSession, d: str) -> DataFrame:
    x = _cases(spark, [([1, 2, 9, 4, 5],), ([],), ([7],), ([3, 3, 2],)], "v array<bigint>")
    return x.select("i", L.integer_islands(F.col("v")).alias("runs"))


@query("""SELECT * FROM (VALUES (0, 'a' || chr(10) || chr(10) || chr(10) || chr(10) || 'b'), (1, ''), (2, 'x' || chr(10) || 'y'), (3, NULL)) AS t(i, text)""")
def blank_run_cap(spark: SparkSession, d: str) -> DataFrame:
    """W3, T3."""
    return _cases(spark, ["a\n\n\n\n\nb", "", "x  \ny\n", None], "raw string").select("i", L.cap_blank_runs(F.col("raw")).alias("text"))


@query("SELECT * FROM (VALUES (0, '# Title'), (1, 'x **b**'), (2, '**T**')) AS t(i, text)")
def bold_headings(spark: SparkSession, d: str) -> DataFrame:
    """Only in documents of the type txt."""
    x = _cases(spark, [("**Title**", "txt"), ("x **b**", "txt"), ("**T**", "gut")], "raw string, kind string")
    return x.select("i", RULES.bold_headings(F.col("raw"), F.col("kind")).alias("text"))


@query("SELECT * FROM (VALUES (0, chr(160) || chr(160) || 'a b'), (1, 'a' || chr(10) || chr(160) || 'b'), (2, '')) AS t(i, text)")
def leading_space(spark: SparkSession, d: str) -> DataFrame:
    """T4."""
    return _cases(spark, ["  a b", "a\n b", ""], "raw string").select("i", RULES.apply_rules(F.col("raw"), RULES.LEADING_SPACE).alias("text"))


FOOTNOTE_CASES = [("x[3](#a b12.html#c endnote3)  y", None), ("[3](#notes b12.html#note3)", None), ("[4](#c1.html_F4) t", None), ("u[4](#c1.html_FT4)", None), ("[[5]](x.html#ref5) Z", "gut"), ("w[[5]](x.html#fn5)", "gut"), ("w[[5]](x.html#fn5)", "txt")]


@query("SELECT * FROM (VALUES (0,'x[^b12_note3]: y'),(1,'[^b12_note3]'),(2,'[^c1_footnote4]: t'),(3,'u[^c1_footnote4]'),(4,'[^5]:  Z'),(5,'w[^5]'),(6,'w[[5]](x.html#fn5)')) AS t(i, text)")
def footnote_rules(spark: SparkSession, d: str) -> DataFrame:
    """T6."""
    return _cases(spark, FOOTNOTE_CASES, "raw string, kind string").select("i", RULES.rewrite_footnotes(F.col("raw"), F.col("kind")).alias("text"))


@query("SELECT * FROM (VALUES (0,'# Part'),(1,'## Bold'),(2,'# One'),(3,'text')) AS t(i, text)")
def heading_rules(spark: SparkSession, d: str) -> DataFrame:
    """T7, T9."""
    x = _cases(spark, ["# [Part](c.html)", "## **Bold**", "[One](text/content1.html)", "text"], "raw string")
    return x.select("i", RULES.apply_rules(F.col("raw"), RULES.HEADING_LINKS + RULES.CONTENTS_LINKS).alias("text"))


@query("""SELECT * FROM (VALUES (0,'a' || chr(10) || '#### IV' || chr(10) || '## Part Two' || chr(10) || 'b'),(1,'IV' || chr(10) || 'x'),(2,'a' || chr(10) || '#### .' || chr(10) || 'b')) AS t(i, text)""")
def heading_promotion(spark: SparkSession, d: str) -> DataFrame:
    """First and last line never; a line of a point alone is promoted."""
    return _cases(spark, ["a\nIV\nPart Two\nb", "IV\nx", "a\n.\nb"], "raw string").select("i", L.promote_headings(F.col("raw")).alias("text"))


FRAME = "head\n*** START OF THE PROJECT GUTENBERG EBOOK X ***\n## Contents\n- a\n## One\ntext\nmore Project Gutenberg\n*** END OF THE PROJECT GUTENBERG EBOOK X ***\ntail"


@query("SELECT * FROM (VALUES (0, '# One' || chr(10) || 'text'), (1, 'plain')) AS t(i, text)")
def archive_frame(spark: SparkSession, d: str) -> DataFrame:
    """T1, A7."""
    return _cases(spark, [FRAME, "plain"], "raw string").select("i", L.strip_archive_frame(F.col("raw")).alias("text"))


@query("SELECT * FROM (VALUES (0,'[^1]: text'),(1,'[^1]: text'),(2,'x'),(3,'[^1]: a' || chr(10) || '[^2]: [2] b')) AS t(i, text)")
def reply_postprocess(spark: SparkSession, d: str) -> DataFrame:
    """Fences go; the definition rules apply at the start of the text alone."""
    return _cases(spark, ["[^1]: [1]: text", "```md\n[^1]: 1850. text\n```", "```\nx\n```\n", "[^1]: [1] a\n[^2]: [2] b"], "raw string").select("i", RULES.strip_reply(F.col("raw")).alias("text"))


@query("SELECT * FROM (VALUES (0,'meta+a ctrl+b'),(1,'x')) AS t(i, text)")
def key_substitution(spark: SparkSession, d: str) -> DataFrame:
    """Order matters."""
    return _cases(spark, ["ctrl+a cmd+b", "x"], "raw string").select("i", X.swap_keys(F.col("raw"), "darwin_to_linux").alias("text"))


@query("""SELECT * FROM (VALUES (0,'\\[\\[a b\\]\\] x'),(1,'[[a]](b)'),(2,'a\\_b'),(3,'_a_')) AS t(i, text)""")
def escapes(spark: SparkSession, d: str) -> DataFrame:
    """T12."""
    return _cases(spark, ["[[a b]] x", "[[a]](b)", "a_b", "_a_"], "raw string").select("i", RULES.escape_underscores(RULES.apply_rules(F.col("raw"), RULES.BARE_LINKS)).alias("text"))


@query("""SELECT * FROM (VALUES (0,'<img src="b.png" alt="a" width="300px">'),(1,'no')) AS t(i, text)""")
def images_to_html(spark: SparkSession, d: str) -> DataFrame:
    """T13."""
    return _cases(spark, ["![a](b.png cap)", "no"], "raw string").select("i", RULES.apply_rules(F.col("raw"), RULES.IMAGES_TO_HTML).alias("text"))


@query("SELECT * FROM (VALUES (0,'ab'),(1,'c')) AS t(i, text)")
def roman_pages(spark: SparkSession, d: str) -> DataFrame:
    """T11."""
    return _cases(spark, ["a[xiv] b", "[PG 12]c"], "raw string").select("i", RULES.apply_rules(F.col("raw"), RULES.ROMAN_PAGE_MARKS).alias("text"))


STORY = '<tw-storydata name="S"><tw-passagedata name="A">x [[to B|B]] (set: $a to 1)</tw-passagedata><tw-passagedata>&lt;&lt;if $a&gt;&gt;\ny</tw-passagedata></tw-storydata>'


@query("SELECT * FROM (VALUES (0,'A','## A' || chr(10) || chr(10) || 'x [to B](#B) `(set: $a to 1)`'),(1,'Untitled Passage','## Untitled Passage' || chr(10) || chr(10) || '> `<<if $a>>`' || chr(10) || chr(10) || 'y')) AS t(passage_idx, name, markdown)")
def story_parse(spark: SparkSession, d: str) -> DataFrame:
    """V1."""
    return H.stories(_cases(spark, [STORY], "raw string"), [], "raw")


@query("""SELECT * FROM (VALUES (0,0,'{"chunk_number": 1, "output_range": [1, 2]}'),(0,1,'{"chunk_number": 2, "output_range": [3, 4]}'),(1,0,'{"chunk_number": 3, "output_range": [5, 6]}')) AS t(i, pos, chunk_json)""")
def truncated_json_recovery(spark: SparkSession, d: str) -> DataFrame:
    """H2, H3."""
    cut = '{"chunks":[{"chunk_number":1,"output_range":[1,2]},{"chunk_number":2,"output_range":[3,4]},{"chunk_nu'
    whole = 'text {"chunks":[{"chunk_number":3,"output_range":[5,6]}],"complete":true}\n```'
    return H.recovered_chunks(_cases(spark, [cut, whole, None, "none"], "raw string"), ["i"], "raw")


@query("SELECT * FROM (VALUES (0,'A title. B'),(1,''),(2,'T x')) AS t(i, title)")
def html_title(spark: SparkSession, d: str) -> DataFrame:
    """P11."""
    return _cases(spark, ["<title>A  title.\n B!</title>", "<p>x", "<TITLE lang='x'>T/ x</TITLE>"], "raw string").select("i", X.html_title(F.col("raw")).alias("title"))


@query("SELECT * FROM (VALUES (0,'a%20b'),(1,'Caf%C3%A9%20&'),(2,'x?y!'),(3,'100%')) AS t(i, anchor)")
def anchors(spark: SparkSession, d: str) -> DataFrame:
    """X2."""
    return _cases(spark, ["a b", "Café &", "x?y!", "100%"], "raw string").select("i", X.encode_anchor(F.col("raw")).alias("anchor"))


@query("SELECT * FROM (VALUES (0,0,false),(1,3,true),(2,3,true),(3,7,false)) AS t(i, number, content)")
def outline_slices(spark: SparkSession, d: str) -> DataFrame:
    """lines without a number have the one before."""
    x = _cases(spark, ["</p>", "3: <p>", "text", "7: </div>"], "line string").withColumn("k", F.lit(1))
    return L.carry_number(x, "k", "i", "line").select("i", F.col("number").cast("int").alias("number"), X.outline_has_content(F.col("line")).alias("content"))


@query("SELECT * FROM (VALUES (1,'A','Axe'),(1,'A','apple'),(2,'Z','Zoo')) AS t(group_no, letter, title)")
def letter_groups(spark: SparkSession, d: str) -> DataFrame:
    x = G.letter_index(spark.createDataFrame([("apple",), ("Zoo",), ("Axe",)], "t string"), "t")
    return x.select(F.col("group_no").cast("int").alias("group_no"), "letter", "title")


IMAGES = [("v", "/v/a/x.png", 512), ("v", "/v/b/y.png", 1536), ("w", "/w/b/x.png", 1024), ("w", "/w/a s.jpg", 10)]


NOTES = [("v", "see ![[A/X.png|200]]"), ("w", "![t](b/x.png \"c\") and <img src='q.png?2'>"), ("w", "---\ncover: a%20s.jpg\n---\n")]


@query("SELECT * FROM (VALUES ('v', '/v/b/y.png', 1536)) AS t(vault, path, length)")
def orphan_suffix_antijoin(spark: SparkSession, d: str) -> DataFrame:
    """R1–R4, X1, J1."""
    tails = REFS.reference_tails(spark.createDataFrame(NOTES, "vault string, text string"), "text", ["vault"])
    return REFS.orphans(spark.createDataFrame(IMAGES, "vault string, path string, length int"), tails, "path", ["vault"])


@query("SELECT * FROM (VALUES ('v', 1, 1536, '1.50 KB')) AS t(vault, n_images, n_bytes, readable)")
def orphan_report(spark: SparkSession, d: str) -> DataFrame:
    """A4, A9."""
    x = REFS.orphan_report(orphan_suffix_antijoin(spark, d), "length", ["vault"])
    return x.select("vault", F.col("n_images").cast("int").alias("n_images"), F.col("n_bytes").cast("int").alias("n_bytes"), "readable")


@query("SELECT * FROM (VALUES (0,'512.00 Bytes'),(1,'1.50 KB'),(2,'0.00 Bytes'),(3,'1.00 PB'),(4,'1.00 MB')) AS t(i, readable)")
def readable_sizes(spark: SparkSession, d: str) -> DataFrame:
    x = spark.createDataFrame(list(enumerate([512, 1536, None, 1024**5, 1024**2])), "i int, n bigint")
    return x.select("i", X.human_size(F.col("n")).alias("readable"))


@query("SELECT * FROM (VALUES (0,'a.png'),(1,'a.png,b.png'),(2,'a'),(3,'c.png')) AS t(i, refs)")
def reference_quirks(spark: SparkSession, d: str) -> DataFrame:
    """R1 in both modes, R2 with an apostrophe, R3."""
    x = spark.createDataFrame([(0, "![[a.png|1]] ![[b.png]]"), (1, "![[a.png|1]] ![[b.png]]"), (2, "![x](a's.png)"), (3, '<img src="c.png?9">')], "i int, t string")
    return x.select("i", F.array_join(F.when(F.col("i") == 1, REFS.references(F.col("t"), False)).otherwise(REFS.references(F.col("t"))), ",").alias("refs"))


@query("SELECT * FROM (VALUES ('3b',0),('10b',1),('(x)',2),('A1',3),('a2',4),('a10',5)) AS t(v, rank)")
def natural_sort_rank(spark: SparkSession, d: str) -> DataFrame:
    """N1."""
    from pyspark.sql import Window

    x = spark.createDataFrame([(v, i) for i, v in enumerate("a10 a2 A1 (x) 3b 10b".split())], "v string, ord int")
    return x.select("v", (F.row_number().over(Window.orderBy(X.natural_key(F.col("v")), "ord")) - 1).alias("rank"))


@query("SELECT * FROM (VALUES (0,'c,a,b'),(1,'a')) AS t(i, models)")
def order_preserving_union(spark: SparkSession, d: str) -> DataFrame:
    """U3."""
    x = spark.createDataFrame([(0, ["c"], ["a", "b", "c"]), (1, ["a"], ["a"])], "i int, f array<string>, r array<string>")
    return x.select("i", F.array_join(G.order_union(F.col("f"), F.col("r")), ",").alias("models"))


@query("SELECT * FROM (VALUES (0,'.b.assets/cover.png'),(1,NULL)) AS t(i, cover)")
def cover_choice(spark: SparkSession, d: str) -> DataFrame:
    """T14."""
    x = spark.createDataFrame([(0, "b", [".b.assets/cover.png"]), (1, "c", [])], "i int, s string, there array<string>")
    return x.select("i", REFS.cover(F.col("s"), F.col("there")).alias("cover"))


@query("SELECT * FROM (VALUES (0,'a/b.mp3'),(1,'/other/c.mp3')) AS t(i, path)")
def relative_paths(spark: SparkSession, d: str) -> DataFrame:
    """P8."""
    x = spark.createDataFrame([(0, "/m/a/b.mp3"), (1, "/other/c.mp3")], "i int, p string")
    return x.select("i", X.relative_to(F.col("p"), F.lit("/m")).alias("path"))


@query("SELECT * FROM (VALUES ('f1',1,1,10),('f1',2,11,20),('f1',3,21,23),('f2',4,1,5)) AS t(file, chunk_idx, start_page, end_page)")
def page_chunks(spark: SparkSession, d: str) -> DataFrame:
    x = P.page_chunks(spark.createDataFrame([("f2", 5), ("f1", 23)], "file string, pages int"), "file", "pages", F.col("file"))
    return x.select("file", *[F.col(c).cast("int").alias(c) for c in ("chunk_idx", "start_page", "end_page")])


@query("SELECT * FROM (VALUES ('a',1,'chunk_0001_a.md'),('a',11,'chunk_0011_0020.md'),('b',11,'chunk_0011_0020.md'),('b',3,'chunk_3_4_b.md')) AS t(stem, idx, name)")
def chunk_discovery(spark: SparkSession, d: str) -> DataFrame:
    """M4: a page range without a stem belongs to every file."""
    names = spark.createDataFrame([("chunk_0001_a.md",), ("chunk_0011_0020.md",), ("chunk_3_4_b.md",), ("other.md",)], "name string")
    return P.discover_chunks(names, "name", spark.createDataFrame([("a",), ("b",)], "stem string"), "stem").withColumn("idx", F.col("idx").cast("int"))


@query("SELECT * FROM (VALUES (0,'PRIMARY TEXT' || chr(10) || 'a'),(1,'PRIMARY TEXT' || chr(10) || 'a' || chr(10) || chr(10) || 'ADDITIONAL CONTEXT' || chr(10) || 'b')) AS t(i, prompt)")
def prompts(spark: SparkSession, d: str) -> DataFrame:
    """H6."""
    return spark.createDataFrame([(0, "a", None), (1, "a", "b")], "i int, p string, c string").select("i", P.prompt(F.col("p"), F.col("c")).alias("prompt"))


@query("SELECT * FROM (VALUES ('f', 4, 'P2', 'tab'), ('g', 1, 'Unknown Page', 't')) AS t(file, idx, page_ctx, footnote)")
def table_footnotes(spark: SparkSession, d: str) -> DataFrame:
    """The page is the nearest header before; texts extracted already are passed over."""
    items = spark.createDataFrame([("f", 1, "page_header", "P1"), ("f", 2, "footnote", "1. a"), ("f", 3, "page_header", "P2"), ("f", 4, "text", "tab"), ("g", 1, "text", "t")], "file string, idx int, label string, text string")
    links = spark.createDataFrame([("f", 2), ("f", 4), ("g", 1)], "file string, idx int")
    return N.table_footnotes(links, items, N.extract_footnotes(items))

