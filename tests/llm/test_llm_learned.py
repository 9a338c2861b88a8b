"""Scanned text, repetition, markup and truncation: made cases, held-out accuracy, odd inputs."""

import random

import numpy as np
import pytest

from leafmill.llm import markup, paragraphs, queries, repetition, scans, truncation

WORDS = "the and of a typesetter harvest lantern window tunnel summer moonlit warehouse kettle meadow bridge wanderer stood inside near with old many small wood cutter woodcutter hand copied".split()


@pytest.fixture(scope="module")
def decoder():
    lexicon = {w: 1.0 for w in WORDS} | {"hand-copied": 1.5, "ebbundholt": 3.0}
    return scans.Decoder(lexicon)


@pytest.mark.parametrize(
    ("text", "hyphen", "glyph"),
    [
        ("the old type-\nsetter stood", True, False),
        ("the old type- setter stood", True, False),
        ("the old ty¬\npesetter stood", True, False),
        ("the old type\xad\nsetter stood", True, False),
        ("a wood-\ncutter stood", True, False),
        ("a hand-\ncopied lantern", False, False),
        ("pages 150-\n155 of the", False, False),
        ("the summer - old and small", False, False),
        ("the moonIit tunne1", False, True),
        ("a lan|ern of the ■ window", False, True),
        ("the wiridow stood", False, True),
        ("the 2nd B12 at 12° in 1784", False, False),
        ("swete wyndes of Ebbundholt", False, False),
        ("the old har-", True, False),
        ("", False, False),
    ],
)
def test_noise_of_words(decoder, text, hyphen, glyph):
    got = scans.item_noise(decoder, text, 3, "text")
    assert (got[0], got[1]) == (hyphen, glyph)


@pytest.mark.parametrize(
    ("text", "page", "label", "clutter"),
    [
        ("12", 12, "text", True), ("p. 7", 7, "", True), ("- 5 -", 5, "footnote", True), ("vi", 6, "", True), ("IV", 4, "sectionheader", False),
        ("1784.", 9, "text", True), ("He came in\n1784.", 9, "text", False), ("one two\n\n[7]\n\nthree", 7, "text", True), ("words\n\nTHE OLD TUNNEL\n\nwords", 2, "text", True),
        ("The Old Tunnel", 1, "sectionheader", False), ("9   THE OLD TUNNEL", 9, "sectionheader", True), ("so ended\n\nTHE END", 9, "text", False),
    ],
)
def test_clutter_by_form(text, page, label, clutter):
    assert scans.find_clutter(text, page, label)[0] is clutter


def test_joint_decoding(decoder):
    assert decoder.decode(("type", "setter"), ("h",))[1] == (True,)
    assert decoder.decode(("hand", "copied"), ("h",))[1] == (False,)
    assert decoder.decode(("oldtunnel",), ())[0] == ("old tunnel",)
    assert decoder.decode(("tun", "nel"), ("s",))[1] == (True,)
    assert decoder.word("wiridow")[1:] == ("window", 1)
    assert decoder.word("zzzz")[1:] == ("zzzz", 0)


@pytest.mark.parametrize(
    ("text", "repaired", "hyphen", "glyph"),
    [
        ("the old tun nel stood", "the old tunnel stood", False, False),
        ("the old tun\nnel stood near", "the old tunnel\nstood near", False, False),
        ("The oldtunnel stood", "The old tunnel stood", False, False),
        ("The ware-hou-se stood", "The warehouse stood", True, False),
        ("the type-set-\nter, stood", "the typesetter,\nstood", True, False),
        ("a type-set-ter's hand", "a typesetter's hand", True, False),
        ("the tun ne1 stood", "the tunnel stood", False, True),
        ("A TUN NEL STOOD", "A TUNNEL STOOD", False, False),
        ("the ware-house, near", "the warehouse, near", True, False),
        ("the tun, nel and tun\n\nnel", "the tun, nel and tun\n\nnel", False, False),
        ("a hand-copied lantern", "a hand-copied lantern", False, False),
        ("swete wyndes of Ebbundholt", "swete wyndes of Ebbundholt", False, False),
    ],
)
def test_words_over_stretches(decoder, text, repaired, hyphen, glyph):
    assert paragraphs.repair_words(decoder, text) == repaired
    assert scans.item_noise(decoder, text, 3, "text")[:2] == (hyphen, glyph)


def items(spark, rows):
    return spark.createDataFrame(rows, "item_id bigint, file string, idx int, page_no int, label string, text string, footnote_text string")


def test_noise_end_to_end(spark):
    plain = "the old lantern stood inside the tunnel with many a moonlit window near the bridge of summer"
    rows = [(i, "f", i, 1 + i // 5, "text", plain, None) for i in range(60)]
    rows += [(100, "f", 100, 21, "text", "the old wood-", None), (101, "f", 101, 21, "page_footer", "21", None), (102, "f", 102, 22, "Text", "cutter stood", "1. the lan- tern")]
    rows += [(103, "f", 103, 22, "page_header", "THE MEADOW", None), (104, "f", 104, 23, "Page-Header", "THE MEADOW", None), (105, "f", 105, 24, "text", "inside the THE MEADOW tunnel", None), (106, "f", 106, 24, None, "24", None), (106, "f", 106, 24, None, "24", None)]
    rows += [(107, None, None, None, None, None, None), (108, "f", 108, None, "text", "  ", ""), (109, "f", 109, 25, "text", "the kett1e", None)]
    words = spark.createDataFrame([(w,) for w in WORDS] + [(None,)], "word string")
    got = {(r["item_id"], r["noise"]) for r in scans.find_noise(items(spark, rows), words).collect()}
    assert got == {(100, "hyphen"), (102, "hyphen"), (105, "clutter"), (106, "clutter"), (109, "glyph")}
    assert scans.find_noise(items(spark, []), words).count() == 0


def test_paragraphs_over_pages(spark, monkeypatch):
    lexicon = {w: 1.0 for w in WORDS}
    rows = [(1, "f", 1, 1, "text", "the old\ntype-\nsetter stood ins-", None), (2, "f", 2, 1, "page_footer", "1", None), (3, "f", 3, 2, "paragraph", "ide the tunne1.", None), (4, "f", 4, 2, "section_header", "Summer", None), (5, "f", 5, 2, None, "Old and small.", None)]
    lexicon["inside"] = 1.0
    none = spark.createDataFrame([], "item_id bigint, file string, idx int, key string")
    for block in (1, 2, 3, 2048):
        monkeypatch.setattr(paragraphs, "BLOCK", block)
        parts = paragraphs.blocks(items(spark, rows + rows[2:3]), none, lexicon)
        got = paragraphs.join_blocks(parts, lexicon).orderBy("start_idx", "start_part").collect()
        assert [r["text"] for r in got] == ["the old typesetter stood inside the tunnel.", "Summer", "Old and small."]
        assert (got[0]["page_no"], got[0]["end_page"]) == (1, 2)
    assert paragraphs.join_blocks(paragraphs.blocks(items(spark, []), none, lexicon), lexicon).count() == 0


def test_chain_over_many_blocks(spark, monkeypatch):
    lexicon = {w: 1.0 for w in WORDS}
    rows = [(i, "f", i, 1 + i, "text", "and the old lantern stood near", None) for i in range(9)] + [(9, "f", 9, 3, "footnote", "1. a note", None), (10, "g", 0, 1, "text", "near the end", None)]
    none = spark.createDataFrame([], "item_id bigint, file string, idx int, key string")
    for block in (1, 2, 4, 2048):
        monkeypatch.setattr(paragraphs, "BLOCK", block)
        got = paragraphs.join_blocks(paragraphs.blocks(items(spark, rows), none, lexicon), lexicon).orderBy("file", "start_idx").collect()
        assert [r["text"] for r in got] == [" ".join(["and the old lantern stood near"] * 9), "1. a note", "near the end"]


def test_long_items_are_whole():
    text = "\n\n".join(f"The old lantern stood near number {k}." for k in range(5000))
    assert len(paragraphs.paragraphs_of(text)) == 5000


def test_labelled_furniture_is_proved(spark):
    lexicon = {w: 1.0 for w in WORDS}
    prose = "So the lantern of the tunnel stood near the bridge."
    rows = [(1, "f", 1, 3, "page_footer", "3", None), (2, "f", 2, 3, "page_header", "The Meadow of Summer", None), (3, "f", 3, 3, "Page-Footer", prose, None), (4, "f", 4, 3, "page_footer", "2 the old", "2 the old kettle"), (5, "f", 5, 3, "page_footer", "[4] a wanderer stood", None)]
    rows += [(6, "f", 6, 4, "page_header", "THE OLD MEADOW 4", None), (7, "f", 7, 4, "page_footer", "- 4 -", None), (8, "f", 8, 4, "page_header", "4 • The Meadow", None), (9, "f", 9, 4, "page_footer", "S U M M E R   A N D   O L D", None), (10, "f", 10, 4, "page_footer", None, " ")]
    none = spark.createDataFrame([], "item_id bigint, file string, idx int, key string")
    got = paragraphs.join_blocks(paragraphs.blocks(items(spark, rows), none, lexicon), lexicon).orderBy("start_idx").collect()
    assert [(r["kind"], r["text"]) for r in got] == [("footnote", prose), ("footnote", "2 the old kettle"), ("footnote", "[4] a wanderer stood")]


def test_repeated_share():
    share = lambda t: repetition.repeated_share(repetition.words_of(t))
    assert share(None) == share("") == share("one two") == 0.0
    assert share("a b c d a b c d") == 0.5
    assert share("A b, c d! a B 7 c d x") == pytest.approx(4 / 9)
    assert share("yes " * 100) == pytest.approx(0.99)
    draw = random.Random(1)
    for _ in range(200):
        words = [draw.choice("abc") for _ in range(draw.randint(0, 40))]
        grams, marked = set(), set()
        for i in range(len(words) - 3):
            g = tuple(words[i : i + 4])
            if g in grams:
                marked |= set(range(i, i + 4))
            grams.add(g)
        assert repetition.repeated_share(words) == pytest.approx(len(marked) / len(words) if words else 0.0)


def test_trees_are_monotonic_and_accurate():
    draw = np.random.default_rng(0)
    x = draw.random((1500, 3))
    y = ((x[:, 0] > 0.6) | (draw.random(1500) < 0.03)).astype(float)
    trees = repetition.train_trees(x[:1000], y[:1000], [1, -0, 0])
    assert ((trees.score(x[1000:]) > 0.5) == (x[1000:, 0] > 0.6)).mean() > 0.95
    line = np.tile(draw.random(3), (200, 1))
    line[:, 0] = np.linspace(0, 1, 200)
    assert (np.diff(trees.score(line)) >= -1e-12).all()
    assert repetition.train_trees(np.empty((0, 3)), np.empty(0), [1, 0, 0]).score(x[:2]).shape == (2,)


def test_trees_learn_without_a_positive_in_the_sample(spark):
    word = lambda i: "".join(chr(97 + (i * 7919 // 26**k) % 26) for k in range(4))
    rows = [(i, " ".join(word(i * 61 + k) for k in range(80))) for i in range(150)]
    trees = repetition.fit(spark.createDataFrame(rows, "id bigint, t string"), "id", "t")
    loop = rows[0][1] + " and so it goes on" * 40
    assert trees.score(np.array([repetition.statistics(t) for t in (rows[3][1], loop)])).round().tolist() == [0, 1]


def test_repetition_query_keeps_all(spark):
    rows = [(i, "one two three four " * 10 if i % 4 == 0 else " ".join(f"w{chr(97 + (i * k) % 26)}{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(60))) for i in range(200)] + [(900, None), (901, "")]
    frame = spark.createDataFrame(rows, "id bigint, t string")
    got = repetition.measure(frame, "id", "t", repetition.fit(frame, "id", "t")).filter("share >= 0.4").collect()
    assert {r["key"] for r in got} == {i for i, t in rows if t and repetition.repeated_share(repetition.words_of(t)) >= 0.4}


@pytest.fixture(scope="module")
def weights():
    return markup.train(["The harvest stood near a lantern of old wanderers.", "Many windows, small and moonlit, were open in summer."])


@pytest.mark.parametrize(
    ("text", "families"),
    [
        ("a <b>bold</b> word", ["html"]), ("fish &amp; chips", ["html"]), ("<!-- x -->", ["html"]), ("# Head\ntext", ["markdown"]), ("a **b** c", ["markdown"]),
        ("- one\n- two", ["markdown"]), ("| a | b |\n| --- | --- |", ["markdown"]), ("Title\r\n=====\r\ntext", ["markdown"]), ("see [x](y.md)", ["markdown"]), ("```\n<b>x</b> \\x{y} [[z]]\n```", ["markdown"]),
        ("[[link|text]]", ["wiki"]), ("== Head ==", ["wiki"]), ("a ''b'' c", ["wiki"]), ("{{cite|x}}", ["wiki"]), ("\\section{A}", ["latex"]), ("so $x_1 = 2$ holds", ["latex"]), ("\\[ a^2 \\]", ["latex"]),
        ("It cost $3 then, and $5 now.", []), ("if 3 < 4 and 5 > 4", []), ("kept in C:\\old\\tunnel", []), ("see page [75] and #29 [sic]", []), ("R&D at Q&A; said", []), ("x == 60, file_name_final, 6 * 7 * 8", []),
        ("'Twas the wanderers' own {as noted}", []), ("I <3 windows -> always", []), ("", []), (None, []), ("   \n", []),
    ],
)
def test_markup_families(weights, text, families):
    assert markup.families(text, weights) == families


def test_the_cut_decides_what_the_classifier_leaves_open(weights):
    closed, alone = "a <ledger> kept here </ledger> by hand", "the <ledger> kept here by hand"
    assert markup.families(closed, weights) == ["html"] and markup.families(alone, weights) == []
    found = markup.candidates(closed)
    assert markup.label(found, weights).tolist() == [True, True] and markup.label(found, weights, edges=False).tolist() == [False, True]


def test_long_constructs(weights):
    assert markup.families('x <img alt="' + "word " * 400 + '"> y', weights) == ["html"]
    assert markup.clean("so \\emph{" + "old words " * 900 + "} ends", weights) == "so " + "old words " * 900 + " ends"


def test_clean_keeps_structure(weights):
    text = "<h2>Old &amp; small</h2>\n<ul><li>one</li><li>two</li></ul>\n\n```\n<b>\n```\n\nA **b** with $x_1 = 2$ and [[w|link]]."
    assert markup.clean(text, weights) == "## Old & small\n\n- one\n- two\n\n```\n<b>\n```\n\nA b with $x_1 = 2$ and link."
    assert markup.clean(None, weights) is None and markup.clean("", weights) == ""


def test_min_cut_is_minimal():
    draw = np.random.default_rng(2)
    for _ in range(60):
        n = int(draw.integers(1, 8))
        costs = draw.normal(size=n) * 2
        edges = [(int(a), int(b), float(w)) for a, b, w in zip(draw.integers(0, n, 6), draw.integers(0, n, 6), draw.random(6) * 2) if a != b]
        price = lambda s: sum(c for c, x in zip(costs, s) if c > 0 and not x) - sum(c for c, x in zip(costs, s) if c < 0 and x) + sum(w for a, b, w in edges if s[a] != s[b])
        best = min(price([k >> i & 1 for i in range(n)]) for k in range(1 << n))
        assert price(markup.min_cut(costs, edges)) == pytest.approx(best)
    assert markup.min_cut(np.empty(0), []).size == 0


def test_truncation_on_held_out_cuts(spark):
    draw = random.Random(9)
    nouns = [a + b for a in ("lan", "har", "win", "tun", "ket", "mea", "bri") for b in ("tern", "vest", "dow", "nel", "tle", "ge", "der")]
    sentence = lambda: f"The {draw.choice(nouns)} of the {draw.choice(nouns)} stood near {draw.choice(nouns)} and {draw.choice(nouns)}."
    rows, cut = [], set()
    for i in range(500):
        body = " ".join(sentence() for _ in range(draw.randint(4, 12)))
        if i % 6 == 0:
            body = body[: len(body) - draw.randint(3, 30)]
            if not body.endswith("."):
                cut.add(str(i))
                body += draw.choice(["", "…", "...", "\n"])
        elif i % 7 == 0:
            body += f"\n\n— from the {draw.choice(nouns)}"
        rows.append(("t", str(i), "m", body))
    rows += [("t", "x", "m", None), ("t", "y", "m", ""), ("t", "z", "m", "  \n")]
    frame = spark.createDataFrame(rows, "source_table string, item_key string, source string, text string")
    evidence = truncation.Evidence(frame)
    scores = {r["item_key"]: r["score"] for r in truncation.score(evidence, truncation.fit(frame, evidence)).collect()}
    found = {k for k, v in scores.items() if v >= truncation.THRESHOLD}
    assert len(scores) == 503 and len(found & cut) >= 0.9 * len(cut) and len(found - cut) <= 0.1 * len(cut)
    assert not found & {"x", "y", "z"}


def test_artificial_cuts_are_inside_sentences():
    text = "One sentence stands here. Another one, a little longer, stands behind it!"
    for cut, _ in truncation.artificial_cuts(text, 5, 20):
        assert not truncation.body_and_mark(cut)[0].endswith((".", "!"))
    assert truncation.artificial_cuts("", 1) == [] and truncation.last_word(None) is None


@pytest.mark.parametrize(
    ("text", "body", "kind", "word"),
    [
        ("so it ends. [truncated] \n", "so it ends.", "w", "ends"), ("so it (…) ...", "so it", "w", "it"), ("a lan....", "a lan", "d", "lan"), ("a lan..", "a lan..", "", "lan"), ("x (more)", "x", "w", "x"),
        ("x (word)", "x (word)", "", "word"), ("in 1784", "in 1784", "", None), ("…", "", "e", None), ("end) " + " " * 50_000, "end)", "", "end"), ("w" + "." * 3 + "!" * 90, "w" + "." * 3 + "!" * 90, "", "w"),
    ],
)
def test_what_stands_behind_a_cut(text, body, kind, word):
    assert truncation.body_and_mark(text) == (body, kind)
    assert truncation.last_word(text) == word


def test_hot_words_and_lengths_take_the_broadcast(spark, monkeypatch):
    rows = [("t", str(i), "m", "the same words and the same end here") for i in range(400)] + [("t", f"x{i}", f"s{i % 3}", f"other words number {'abcdef'[i % 6]} end{'xyz'[i % 3]} " + "w" * i) for i in range(90)]
    frame = spark.createDataFrame(rows, "source_table string, item_key string, source string, text string")
    evidence = truncation.Evidence(frame)
    got = {}
    for share in (1e-5, 10.0):  # with and without hot keys
        monkeypatch.setattr(truncation, "HOT_SHARE", share)
        got[share] = sorted((r["item_key"], r["word_level"], r["spike"]) for r in evidence.with_both().collect())
    assert got[1e-5] == got[10.0] and len(got[10.0]) == 490
    assert {s for k, _, s in got[10.0] if not k.startswith("x")} == {1}


@pytest.mark.parametrize("name", [n for n in sorted(queries.QUERIES)])
def test_queries_run_on_the_smallest_tables(spark, name):
    got = queries.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert got.count() == got.distinct().count()
