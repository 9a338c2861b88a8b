"""Small cases: nulls, empties, ties, repeated rows and skew that the tables do not hold."""

import random

from pyspark.sql import functions as F

from leafmill.functions import rules, text as X
from leafmill.operators import catalog, footnotes, html, images, lines, plan, refs
from leafmill.sources import files, paged, sinks
from leafmill.streaming.resume import event_windows, resume_chunks


def fold(rows, tolerance=1.0):
    kept = []
    for o, v in sorted(rows):
        if v is not None and all(abs(v - k) >= tolerance for _, k in kept):
            kept.append((o, v))
    return kept


def test_tolerance_dedup_is_the_greedy_fold(spark):
    draw = random.Random(1)
    rows = [("x", i, round(draw.uniform(0, 12), 2)) for i in range(200)] + [("y", 1, 10.0), ("y", 2, 10.6), ("y", 3, 11.2), ("y", 4, 10.1), ("z", 1, 10.0), ("z", 2, 11.0), ("n", 1, None)]
    got = catalog.drop_near_equal(spark.createDataFrame(rows, "n string, o int, v double"), "n", "v", "o").collect()
    for name in "xyz":
        assert sorted((r["o"], r["v"]) for r in got if r["n"] == name) == sorted(fold([(o, v) for n, o, v in rows if n == name]))
    assert not [r for r in got if r["n"] == "n"]
    assert sorted(r["copy_no"] for r in got if r["n"] == "y") == [0, 1]


def test_predicates_and_limits(spark):
    x = spark.createDataFrame([("audio/mpeg", 1_000_000, 20.0), ("audio/mpeg", 1_000_001, 19.9), ("audio/mpeg", 1_000_001, None), (None, 5_000_000, 30.0), ("audio/mpeg", 1_000_001, 20.0)], "m string, s bigint, d double")
    assert x.filter(catalog.is_audio(F.col("m"), F.col("s")) & catalog.long_enough(F.col("d"))).count() == 1


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "n string, o int, v double")
    assert catalog.drop_near_equal(empty, "n", "v", "o").count() == 0
    assert plan.page_chunks(spark.createDataFrame([], "file string, pages int"), "file", "pages", F.col("file")).count() == 0
    items = spark.createDataFrame([], "file string, idx int, label string, text string")
    assert footnotes.extract_footnotes(items).count() == 0
    assert html.outlines(spark.createDataFrame([], "k int, t string"), ["k"], "t").count() == 0


def test_template_and_names(spark):
    x = spark.createDataFrame([({"artist": ["AC/DC"], "title": ["T!"]}, "a.b.mp3"), ({}, "own.mp3"), (None, ".hidden")], "tags map<string,array<string>>, name string")
    assert [r[0] for r in x.select(catalog.improved_root(F.col("tags"), F.col("name"), "{artist} - {title}")).collect()] == ["ACDC - T", "own", ".hidden"]


def test_lines(spark):
    x = spark.createDataFrame([("a\r\nb\n",), ("",), (None,), ("\n\n\n\n\n",)], "t string")
    got = [r[0] for r in x.select(lines.split_lines(F.col("t"))).collect()]
    assert got == [["a", "b"], [], None, [""] * 5]
    assert [r[0] for r in x.select(lines.cap_blank_runs(F.col("t"))).collect()] == ["a\nb", "", None, "\n\n"]
    assert lines.explode_lines(x.withColumn("k", F.lit(1)), "k", "t").count() == 7


def test_slices_clip_and_reverse(spark):
    l = spark.createDataFrame([("d", i, c) for i, c in enumerate("abcd", 1)], "doc string, line_no int, line string")
    p = spark.createDataFrame([(1, "d", 2, 3), (2, "d", 3, 2), (3, "d", 4, 2_000_000_000), (4, "e", 1, 2), (5, "d", -3, 1)], "p int, doc string, lo int, hi int")
    got = {r["p"]: r["text"] for r in plan.slice_lines(p, l, "p", "doc", F.col("lo"), F.col("hi")).collect()}
    assert got == {1: "b\nc", 3: "d", 5: "a"}


def test_overlaps(spark):
    p = spark.createDataFrame([("a", 1, 10), ("a", 10, 20), ("b", 1, 9), ("b", 10, 20), ("c", None, 3)], "k string, lo int, hi int")
    assert [r["k"] for r in plan.overlapping(p, "k", F.col("lo"), F.col("hi")).collect()] == ["a"]


def test_footnotes_across_blocks(spark, monkeypatch):
    rows = [("f", 1, "page_header", "H"), ("f", 2, "footnote", "1. a"), ("f", 3, "page_footer", "and so on"), ("f", 4, "page_footer", "THE END"), ("f", 5, "page_footer", "lost"), ("f", 6, "footnote", "[2] b"), ("f", 7, None, None), ("f", 8, "page_footer", "c")]
    rows += [("f", 9, "page_header", "I"), ("f", 10, "footnote", "3. d"), ("f", 11, "page_header", "J"), ("g", 0, "footnote", "* e"), ("g", 5000, "page_footer", "f"), ("h", 3, "footnote", "1. x"), ("h", 4, "footnote", "2. y")]
    # a note that a header ends has that header; one without any has none
    expected = [("f", "H", "1. a and so on"), ("f", "I", "[2] b c"), ("f", "J", "3. d"), ("g", "Unknown Page", "* e f"), ("h", "Unknown Page", "1. x"), ("h", "Unknown Page", "2. y")]
    for block in (2, 2048):
        monkeypatch.setattr(footnotes, "BLOCK", block)
        got = footnotes.extract_footnotes(spark.createDataFrame(rows, "file string, idx int, label string, text string")).orderBy("file", "start_idx")
        assert [(r["file"], r["page_ctx"], r["footnote"]) for r in got.collect()] == expected


def test_references_and_orphans(spark):
    notes = spark.createDataFrame([("![[x.png]]",), (None,), ("",)], "text string").withColumn("v", F.lit(1))
    images = spark.createDataFrame([("/v/a/x.png",), ("/v/b/x.png",), ("/v/b/y%20z.png",)], "path string").withColumn("v", F.lit(1))
    got = refs.orphans(images, refs.reference_tails(notes, "text", ["v"]), "path", ["v"])
    assert [r["path"] for r in got.collect()] == ["/v/b/y%20z.png"]


def test_macro_scanner():
    assert html.mark_macros("a (set: $x to 1) b") == "a `(set: $x to 1)` b"
    assert html.mark_macros("(if: $x)\n") == "\n> `(if: $x)`\n"
    assert html.mark_macros("```\n(if: $x)\n```") == "```\n(if: $x)\n```"
    assert html.mark_macros("x [note] y") == "x [note] y"
    assert html.mark_macros("{unclosed") == "{unclosed"
    assert html.mark_macros("") == ""
    assert html.macro_end("(a\n\n\n)", 0, "(") is None and html.macro_end("(a\n\n)", 0, "(") == 5
    assert html.macro_end("(it's)", 0, "(") is None
    assert html.macro_end("<<a <<b>> c>>", 0, "<<") == 9 and html.macro_end("{a {b} c}", 0, "{") == 9
    assert html.mark_macros("[css]\nx {y}\n[z]\n{set}") == "\n```css\nx {y}\n```\n\n\n\n> `[z]`\n\n\n\n> `{set}`\n"


def test_recovered_objects():
    cut = '{"chunks":[{"chunk_number":1,"output_range":[1,2]},{"chunk_number":2,"output_range":[3,4]},{"chu'
    assert len(html.plan_objects(cut)) == 2
    assert html.plan_objects("") == [] and html.plan_objects("{") == []


def test_outline_shortens_lists():
    page = "<body><ul>" + "".join(f"<li>item {i}</li>" for i in range(14)) + "</ul><p>" + "w " * 60 + "</p></body>"
    entries = [e for _, _, e in html.outline(page)]
    assert "[4x <li>]" in entries and any("chars:" in e for e in entries)
    assert html.outline("") == [(1, 0, "<[document] />")]


def test_outline_of_unclosed_tags():
    entries = html.outline("<p>x" * 20_000)
    assert len(entries) == 60_002 and entries[39_999][1:] == (20_000, "<p>")
    assert html.outline("<p>a<br><br>b</p></ul>")[1:-1] == [(1, 1, "<p>"), (1, 2, "a"), (1, 2, "<br /> [2x]"), (1, 2, "b"), (1, 1, "</p>")]


def test_rules_keep_nulls(spark):
    x = spark.createDataFrame([(None, None)], "t string, k string")
    assert x.select(rules.rewrite_footnotes(F.col("t"), F.col("k"), True), rules.strip_reply(F.col("t")), rules.escape_underscores(F.col("t"))).first() == (None, None, None)


def test_sources_and_sinks(spark, tmp_path):
    folder = tmp_path / "in"
    (folder / "sub").mkdir(parents=True)
    for name in ("b10.md", "b2.md", ".hid.md", "sub/c.PNG"):
        (folder / name).write_text("---\ntitle: T\ntitle: U\n---\nbody\n")
    assert files.inventory(spark, str(folder)).count() == 3
    assert files.list_files(spark, str(folder)).count() == 4
    assert [r[0].rsplit("/", 1)[1] for r in files.expand_inputs(spark, str(folder)).collect()] == ["b2.md", "b10.md"]
    doc = files.read_documents(spark, str(folder / "b2.md")).first()
    assert (doc["meta"], doc["text"]) == ({"title": "U"}, "body\n")
    (tmp_path / "list.txt").write_text("# c\n\n a \nb\n")
    assert [r[0] for r in files.read_list(spark, str(tmp_path / "list.txt")).collect()] == ["a", "b"]
    listed = catalog.playlist(spark.createDataFrame([("/m/a.mp3", 1)], "p string, o int"), "p", "o", "/m")
    sinks.write_ordered_lines(listed, ["line_no"], "line", str(tmp_path / "out"))
    assert [r[0] for r in spark.read.text(str(tmp_path / "out")).collect()] == ["#EXTM3U", "a.mp3"]
    sinks.write_chunks(spark.createDataFrame([(1, "x"), (2, "y")], "chunk_idx int, text string"), str(tmp_path / "chunks"))
    assert spark.read.text(str(tmp_path / "chunks")).count() == 2


def test_paged_source(spark, tmp_path):
    (tmp_path / "p1.json").write_text('{"query":{"categorymembers":[{"pageid":1,"ns":0,"title":"a"}]},"continue":"p2.json"}')
    (tmp_path / "p2.json").write_text('{"query":{"categorymembers":[{"pageid":2,"ns":0,"title":"b"}]}}')
    spark.dataSource.register(paged.PagedSource)
    got = spark.read.format("paged_json").option("start", str(tmp_path / "p1.json")).load()
    assert sorted(r["title"] for r in got.collect()) == ["a", "b"]


def test_sources_over_http(spark):
    import json
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer
    from urllib.parse import parse_qs, urlparse

    asked = []

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            url = urlparse(self.path)
            asked.append(self.path)
            query = parse_qs(url.query, keep_blank_values=True)
            at = query.get("cmcontinue", [""])[0]
            pages = {"": ("a", "page|2"), "page|2": ("b", "page|3"), "page|3": ("c", None)}
            body = {"query": {"categorymembers": [{"pageid": 1, "ns": 0, "title": pages[at][0]}]}} if at in pages else {}
            if at in pages and pages[at][1]:
                body["continue"] = {"cmcontinue": pages[at][1], "continue": "-||"}
            if url.path.startswith("/forecast"):
                body = {"list": []} if "Aal" in self.path else {"cod": "404"}
            self.send_response(200)
            self.end_headers()
            self.wfile.write(json.dumps(body).encode())

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}"
    spark.dataSource.register(paged.PagedSource)
    spark.dataSource.register(paged.ForecastSource)
    got = spark.read.format("paged_json").option("start", f"{base}/a b%20c/api.php?action=query&cmcontinue=").load().collect()
    assert [r["title"] for r in got] == ["a", "b", "c"]
    assert asked[0].startswith("/a%20b%2520c/") and "cmcontinue=page%7C2" in asked[1] and "action=query" in asked[2]
    rows = spark.read.format("forecast_json").option("address", base + "/forecast?q={place}").option("places", "Aal, Aalen").load().collect()
    assert sorted(r["place"] for r in rows) == ["Aal", "Aalen"]
    try:
        spark.read.format("forecast_json").option("address", base + "/forecast?q={place}").option("places", "X").load().collect()
        raise AssertionError("an answer without a forecast is an error")
    except Exception as error:
        assert "no forecast for X" in str(error)
    server.shutdown()


def test_image_links(spark):
    x = spark.createDataFrame([(1, 'a <img src="http://h/p.png" alt="x"> ![t](https://h/q.JPG) http://h/p.png'), (2, "![t](local.png) ![u](http://gone/z.gif)"), (3, None), (4, "")], "id int, text string")
    assert [r[0] for r in x.orderBy("id").select(images.image_addresses(F.col("text"))).collect()] == [["http://h/p.png", "https://h/q.JPG"], ["http://gone/z.gif"], [], []]
    asked = x.select(F.explode(images.image_addresses(F.col("text"))).alias("a"))
    fetched = images.fetch_images(asked, "a", lambda a: None if "gone" in a else a[-3:].encode())
    names = {r["address"]: r["name"] for r in fetched.collect()}
    assert names == {"http://h/p.png": "image_0b4c.png".replace("0b4c", __import__("hashlib").md5(b"png").hexdigest()[:4]), "https://h/q.JPG": "image_" + __import__("hashlib").md5(b"JPG").hexdigest()[:4] + ".JPG"}
    got = {r["id"]: r["text"] for r in images.rewrite_links(x, "id", "text", fetched, "img/").collect()}
    one, two = names["http://h/p.png"], names["https://h/q.JPG"]
    assert got == {1: f'a <img src="img/{one}" alt="x"> ![t](img/{two}) img/{one}', 2: "![t](local.png) ![u](http://gone/z.gif)", 3: None, 4: ""}


def test_previews(spark):
    lines_ = spark.createDataFrame([("d", i, c) for i, c in enumerate("abcd", 1)], "doc_id string, line_no int, line string")
    rows = [(1, "d", 1, "T", [1, 2], [[3, 4], [9]]), (2, "d", 2, None, [4, 3], None), (3, "d", 3, "x", [1], None)] + [(10 + i, "d", 10 + i, "y", [1, 1], []) for i in range(5)]
    got = plan.previews(spark.createDataFrame(rows, "plan_id bigint, doc_id string, chunk_number int, title string, output_range array<int>, contexts array<array<int>>"), lines_).collect()
    rule = "=" * 70
    assert len(got) == 1 and got[0]["preview"].count("Chunk ") == 5
    assert got[0]["preview"].startswith(f"{rule}\nChunk 1: T\n  output_range: lines 1–2\n{rule}\n  --- PRIMARY TEXT (output_range): lines 1–2 ---\na\nb\n\n  --- ADDITIONAL CONTEXT[1]: lines 3–4 ---\nc\nd\n\n{rule}\nChunk 2: \n")


def test_outlines_and_previews_are_written(spark, tmp_path):
    pages = spark.createDataFrame([("k", "<p>a<br><br></p>")], "k string, t string")
    sinks.write_outlines(html.outlines(pages, ["k"], "t"), "k", str(tmp_path / "outline"))
    assert [r[0] for r in spark.read.text(str(tmp_path / "outline/k=k")).collect()] == ["1: <[document]>", "1:   <p>", "1:     a", "1:     <br /> [2x]", "1:   </p>", "1: </[document]>"]
    sinks.write_texts(pages, "k", "t", str(tmp_path / "text"))
    assert spark.read.text(str(tmp_path / "text")).count() == 1


def test_merged_segments_are_the_merged_text(spark, tmp_path):
    rows = [("f", i % 50, i, f"text {i}\nof f\n" if i % 3 else None) for i in range(300)] + [("g", 0, 1, "only")]
    frame = spark.createDataFrame(rows, "file string, chunk_idx int, chunk_id bigint, content string").repartition(7)
    order = ["chunk_idx", "chunk_id"]
    sinks.write_segments(plan.merge_segments(frame, "file", order, "content"), "file", order, str(tmp_path / "out"))
    expected = {r["file"]: r["text"] for r in plan.merge_ordered(frame, "file", order, "content").collect()}
    for name in ("f", "g"):
        parts = sorted((tmp_path / f"out/file={name}").glob("part-*.txt"))
        assert "".join(p.read_text() for p in parts) == expected[name]


def test_relative_paths(spark):
    rows = [("/m/a/b.mp3", "/m", "a/b.mp3"), ("/m/a/b.mp3", "/m/c/d", "../../a/b.mp3"), ("/x", "/m/", "../x"), ("/m", "/m", "."), ("/m", "/m/a", ".."), ("/mm/a", "/m", "../mm/a"), (None, "/m", None)]
    for p, b, r in spark.createDataFrame(rows, "p string, b string, r string").select(X.relative_path(F.col("p"), F.col("b")), "p", "r").collect():
        assert p == r, b


def test_stream_resumes(spark, tmp_path):
    source, target, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    spark.createDataFrame([(1, "a")], "id int, text string").write.parquet(source)
    step = lambda f: f.withColumn("text", F.upper("text"))
    for _ in range(2):
        resume_chunks(spark, source, "id int, text string", target, check, step)
    spark.createDataFrame([(2, "b")], "id int, text string").write.mode("append").parquet(source)
    resume_chunks(spark, source, "id int, text string", target, check, step)
    assert sorted(r["text"] for r in spark.read.parquet(target).collect()) == ["A", "B"]
    assert event_windows(spark.createDataFrame([], "ts timestamp_ntz, event_type string, value double")).count() == 0


def test_scalars(spark):
    x = spark.createDataFrame([("https://h/a-b/c d.tar.gz/",)], "u string")
    assert x.select(X.url_slug(F.col("u")), X.percent_decode(F.lit("a+b%20%zz")), X.collapse_blanks(F.lit(" a  b ")), X.looks_truncated(F.lit("{} \n"))).first() == ("c_d", "a+b%20%zz", "a b", False)


def test_text_queries_against_plain_python(spark):
    """The rules that SQL can't express, over a whole table, by Python's own patterns."""
    import re

    from leafmill.plans import document_queries as Q

    data = "/root/testdata/sf0.001"
    docs = {r["doc_id"]: r for r in Q._documents(spark, data).filter("text IS NOT NULL").collect()}

    def rewritten(text, kind):
        for rule in rules.FOOTNOTES + (rules.ARCHIVE_FOOTNOTES if kind == "gut" else ()):
            flags, pattern = re.match(r"\(\?([a-z]+)\)(.*)", rule.pattern, re.S).groups()
            text = re.sub(pattern, re.sub(r"\$(\d)", r"\\\1", rule.replacement), text, flags=(re.I if "i" in flags else 0) | (re.M if "m" in flags else 0))
        return text

    assert {r["doc_id"]: r["text"] for r in Q.footnote_rules(spark, data).collect()} == {k: rewritten(r["text"], r["kind"]) for k, r in docs.items()}
    framed = {r["doc_id"]: r["text"] for r in Q.archive_frame(spark, data).collect()}
    assert set(framed) == set(docs) and not any("*** START" in t or "*** END" in t or "## Contents" in t for t in framed.values())
    promoted = {r["doc_id"]: r["text"].split("\n") for r in Q.headings_promoted(spark, data).collect()}
    plain = {r["doc_id"]: r["text"].split("\n") for r in Q.heading_promotion(spark, data).collect()}
    for k, got in promoted.items():
        changed = [i for i, (a, b) in enumerate(zip(plain[k], got)) if a != b]
        assert len(got) == len(plain[k]) and all(got[i] == "## " + plain[k][i] and not plain[k][i - 1].strip() and not plain[k][i + 1].strip() and 0 < i < len(got) - 10 for i in changed)
