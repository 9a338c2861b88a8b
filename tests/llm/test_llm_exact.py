"""Encoding, packing, splitting and shared spans against brute force and exact round trips."""

import random

import pytest
from pyspark.sql import functions as F

from leafmill.llm import encode, pack, spans, split
from leafmill.llm.common import TOKENIZER_DIR, byte_bpe

ODD = [None, "", " ", "  \n\n ", "abc", "It's 3rd of May — “fine”.", "a​b﻿", "é" * 50, "x" * 5000, "word " * 9000, "नमस्ते 日本語 🙂🙂", "\t\ttabs   ", "\x00\x1f"]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, i) for i, t in enumerate(ODD)] + [(4, "abc", 4)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, ids int")


def test_ids_and_round_trip(odd):
    got = encode.encode_column(odd.select("doc_id", "text"), ["doc_id"])
    whole = byte_bpe(TOKENIZER_DIR)
    rows = got.collect()
    assert len(rows) == len(ODD) + 1
    for r in rows:
        assert list(r["ids"]) == whole.encode_ordinary(ODD[r["doc_id"]] or "")
    texts = {r["doc_id"]: r["text"] for r in encode.decode_column(got, ["doc_id"]).collect()}
    assert all(texts[i] == (t or "") for i, t in enumerate(ODD))


def test_clashing_column_names(odd):
    assert encode.encode_column(odd, ["doc_id"]).columns == ["doc_id", "ids"]
    assert encode.count_tokens(odd.limit(0), ["doc_id"]).count() == 0


def test_parts_at_safe_boundaries():
    draw = random.Random(3)
    text = "".join(draw.choice(["word", " ", "\n", "  ", "12", "'s", "…", "é"]) for _ in range(4000))
    whole = byte_bpe(TOKENIZER_DIR).encode_ordinary
    assert sum((whole(p) for p in encode.safe_parts(text, 50)), []) == whole(text)
    assert "".join(encode.safe_parts(text, 50)) == text


def test_packing_is_whole_and_tight(spark):
    draw = random.Random(2)
    sizes = [(i, draw.choice([0, 3, 7, 7, 7, 7, 50, 99, 100, 101, 350, None])) for i in range(600)]
    got = pack.pack_items(spark.createDataFrame(sizes, "doc bigint, n int"), "doc", "n", capacity=100, rows_per_salt=50).collect()
    assert all(r["container_id"] is not None for r in got)
    by_item, by_container = {}, {}
    for r in got:
        by_item.setdefault(r["doc"], []).append(r["size"])
        by_container[r["container_id"]] = by_container.get(r["container_id"], 0) + r["size"]
    assert {i: sum(v) for i, v in by_item.items()} == {i: n or 0 for i, n in sizes}
    assert all(len(v) == 1 for i, v in by_item.items() if sum(v) <= 100)
    assert max(by_container.values()) <= 100
    assert len(by_container) <= 1.05 * (sum(by_container.values()) / 100) + 1


def test_packing_empty(spark):
    assert pack.pack_items(spark.createDataFrame([], "doc bigint, n int"), "doc", "n").count() == 0
    got = pack.pack_items(spark.createDataFrame([(1, 0), (2, 0)], "doc bigint, n int"), "doc", "n").collect()
    assert {r["container_id"] for r in got} == {0}


def test_cuts_keep_limits_and_overlap():
    draw = random.Random(4)
    text = "".join(draw.choice(["Some words here. ", "more, ", "line\n", "\n\n", "w" * 30, " "]) for _ in range(6000))
    cuts = split.cut_offsets(text, 600, 50, 200)
    assert cuts[0] == 0 and cuts[-1] == len(text) and cuts == sorted(set(cuts))
    assert all(b - max(0, a - (50 if a else 0)) <= 600 for a, b in zip(cuts, cuts[1:]))
    changed = split.cut_offsets("Inserted words. " + text, 600, 50, 200)
    assert len({c - 16 for c in changed} & set(cuts)) > 0.7 * len(cuts)  # only cuts near the edit move
    assert split.cut_offsets("x" * 1500, 600, 50, 200)[-1] == 1500
    assert split.cut_offsets("", 600) == [] and split.cut_offsets(None, 600) == [] and split.cut_offsets("ab", 600) == [0, 2]


def test_pieces_round_trip(spark):
    rows = [(1, "a b. " * 5000), (2, None), (3, ""), (4, "short")]
    got = split.split_items(spark.createDataFrame(rows, "k int, text string"), ["k"], "text").orderBy("k", "piece_no").collect()
    own = [r for r in got if r["k"] == 1]
    assert "".join(r["piece"][split.OVERLAP if r["piece_no"] else 0 :] for r in own) == rows[0][1]
    assert max(len(r["piece"]) for r in own) <= split.LIMIT and {r["k"] for r in got} == {1, 4}


def test_planned_ranges(spark):
    lines = spark.createDataFrame([("d", i, None if i == 2 else f"l{i}") for i in (1, 2, 3)] + [("d", 1, "l1")], "doc_id string, line_no int, line string")
    plan = spark.createDataFrame([(1, "d", [1, 9]), (1, "d", [1, 9]), (2, "d", [3, 1]), (3, "d", [2]), (4, "d", None), (5, "d", [7, 9]), (6, "e", [1, 1])], "plan_id bigint, doc_id string, output_range array<int>")
    assert [(r["plan_id"], r["text"]) for r in split.planned_texts(plan, lines).collect()] == [(1, "l1\n\nl3")]


def brute(texts):
    seen = {}
    for i, t in texts.items():
        for k in range(len(t) - spans.SPAN + 1):
            seen.setdefault(t[k : k + spans.SPAN], set()).add(i)
    return {(a, b) for s in seen.values() for a in s for b in s if a < b}


def test_spans_against_brute_force(spark):
    draw = random.Random(6)
    word = lambda: "".join(draw.choice("abcdefgh") for _ in range(draw.randint(2, 9)))
    text = lambda n: " ".join(word() for _ in range(n))[: n * 5]
    shared = [text(120) for _ in range(6)]
    texts = {}
    for i in range(120):
        body = text(draw.randint(0, 120))
        for _ in range(draw.randint(0, 2)):
            s, n = draw.choice(shared), draw.choice([150, 199, 200, 201, 260, 500])
            at, cut = draw.randint(0, max(0, len(s) - n)), draw.randint(0, len(body))
            body = body[:cut] + s[at : at + n] + body[cut:]
        texts[i] = body
    for i in range(40):  # boilerplate of a third of the documents, and periodic texts
        texts[200 + i] = text(10) + shared[0][:180] + text(10)
    texts |= {300: "yes " * 200, 301: "no yes " + "yes " * 90, 302: "yes " * 49, 303: "", 304: "ü🙂" * 150, 305: "x" + "ü🙂" * 120}
    frame = spark.createDataFrame([(i, t) for i, t in texts.items()] + [(400, None)], "doc_id bigint, text string")
    for many in (2, 16):
        got = {(r[0], r[1]) for r in spans.shared_spans(frame, many=many).select("doc_id_a", "doc_id_b").distinct().collect()}
        assert got == brute(texts)


def test_spans_of_copies_and_none(spark):
    t = "".join(chr(97 + i * 7 % 26) for i in range(50)) * 6
    frame = spark.createDataFrame([(1, t), (2, t), (2, t), (3, "short")], "doc_id bigint, text string").withColumn("doc", F.lit("x")).withColumn("digest", F.lit(0))
    assert {(r[0], r[1]) for r in spans.shared_spans(frame).select("doc_id_a", "doc_id_b").distinct().collect()} == {(1, 2)}
    assert spans.shared_spans(frame.limit(0)).count() == 0


def test_shares_against_brute_force(spark):
    draw = random.Random(8)
    text = lambda n: "".join(draw.choice("abcdefgh ") for _ in range(n))
    plate, one, two = text(1000), text(260), text(300)
    texts = {i: text(draw.randint(0, 80)) + plate + text(draw.randint(0, 80)) for i in range(20)}  # 1,000 characters in 20 documents
    texts |= {30 + i: one + text(30 + i) + two for i in range(20)}  # two passages with the same set of documents
    texts |= {60: two + text(50) + two, 61: one + one, 62: "yes " * 90, 63: "no " + "yes " * 70, 64: text(900), 65: "", 66: plate[100:299], 67: plate[100:300]}
    expected = {i: set() for i in texts}
    seen = {}
    for i, t in texts.items():
        for k in range(len(t) - spans.SPAN + 1):
            seen.setdefault(t[k : k + spans.SPAN], []).append((i, k))
    for places in seen.values():
        if len({i for i, _ in places}) > 1:
            for i, k in places:
                expected[i].update(range(k, k + spans.SPAN))
    frame = spark.createDataFrame([*texts.items(), (60, texts[60])], "doc_id bigint, text string")
    for many in (2, 16):
        got = {r["doc_id"]: r["shared_chars"] for r in spans.shared_chars(frame, many=many).collect()}
        assert got == {i: len(v) for i, v in expected.items()}
