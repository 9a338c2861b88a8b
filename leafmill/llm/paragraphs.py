"""Problem 1, the repaired text: continuous readable paragraphs of scanned files in page order.

Each item's words are decoded (see ``scans``), running headers and page numbers are taken out, and
its lines are cut into paragraphs by dynamic programming: a line goes on with the paragraph before
it as prose or as verse, or begins a new one, and the path of the least cost wins. Then the seams
between body items are judged, over headers, footers and footnotes in between: prose that ends
inside a sentence goes on in the next body item, also on the next page.

The texts are shuffled once, by file and block of ``BLOCK`` positions, together with the proved
running headers of their items; a block's items are repaired and joined in one pass. Only the first
and the last body paragraph of a block may go on beyond it: these few are joined afterwards along
the blocks of their file, so a file with a third of all rows is as many tasks as it has blocks.

Defined results: blank items and page furniture give nothing, and an item labelled header or footer
is furniture only if its form or the headers of its file prove it (else a footer is a footnote or a
further part of the one before, a header is a note or body); headings and list items are paragraphs
of their own; footnotes come as paragraphs of the kind ``footnote`` and join nothing; repeated rows
count once; a null position counts as 0, ties are ordered by item.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafmill.llm import scans as S
from leafmill.llm.common import cut_lineage, table

BLOCK = 2048
NEW, RAGGED, CAPITAL, SMALL, WIDE = 2.0, 1.5, 0.7, 2.5, 0.6
CLOSED = re.compile(r"[.!?…:;][\"'”’)\]]*\Z")


def repair_token(decoder: S.Decoder, token: str) -> str | None:
    """The token as it was printed; None for a stray mark."""
    kind = decoder.judge(token)
    if kind == "stray":
        core = token.strip("".join(S.STRAY))
        return core or None
    if kind not in ("glyph", "soft"):
        return re.sub("[¬\xad]", "", token) if kind == "broken" else token
    core = token.strip(S.EDGE)
    at = token.index(core)
    tail = core[-2:] if core.lower().endswith(("'s", "’s")) else ""
    word = core[: len(core) - len(tail)]
    parts = [p if p in decoder.lexicon else decoder.word(p)[1] for p in word.lower().split("-")]
    return token[:at] + S.same_case(word, "-".join(parts)) + tail + token[at + len(core) :]


def repair_words(decoder: S.Decoder, text: str) -> str:
    """A line or several: broken and torn words joined, grown ones split, misread ones read, stray marks dropped; line ends stay."""
    if not decoder.suspects(text):
        return "\n".join(" ".join(line.split()) for line in text.split("\n"))
    text = S.redone(decoder, text)[0]
    parts, at = [], 0
    for start, end, left, right in S.broken_words(text):
        bare, core = re.split("[—–]", left)[-1].strip(S.EDGE + "-").lower(), S.core_of(right)
        if not bare or not core or not bare[-1].isalpha() or not core[0].isalpha():
            continue
        joins = decoder.decode((S.INNER.split(bare)[-1], core), ("h",))[1]
        gap = text[start + len(left) : end - len(right)]
        parts += [text[at:start], left.rstrip() + ("" if joins[0] else "-") + right + ("\n" if "\n" in gap else "")]
        at = end
    text = "".join([*parts, text[at:]])
    lines = []
    for line in text.split("\n"):
        repaired = (t if t in decoder.fine else repair_token(decoder, t) for t in line.split())
        lines.append(" ".join(t for t in repaired if t is not None))
    return "\n".join(lines)


def without_furniture(text: str, page: int | None, keys: set[str]) -> str:
    """The text without lines and runs that are page numbers or running headers."""
    kept = []
    for line in text.split("\n"):
        bare = line.strip()
        number = S.is_page_number(bare) if bare else None
        if not bare or not ((keys and S.header_key(bare) in keys) or S._capitals(bare) or (number is not None and (number == page or len(bare) > 4))):
            kept.append(line)
    text = "\n".join(kept)
    if keys:
        for pattern in (S.CAPITALS, S.BULLET_TITLE, S.TITLE_RUN):
            text = pattern.sub(lambda m: " " if S.header_key(m.group()) in keys else m.group(), text)
    if page is None or str(page) not in text:
        return text
    return S.INLINE_NUMBER.sub(lambda m: "" if int(next(g for g in m.groups() if g)) == page else m.group(), text)


def paragraphs_of(text: str) -> list[tuple[str, str]]:
    """(kind, text) of the paragraphs of an item: the cheapest way to go on or begin anew, line by line.

    Each line has a state for prose and one for verse, with the state of the line before that it came
    from; a paragraph's last line and kind are all that the next step looks at, so the work is linear.
    """
    if "\n" not in text.strip():
        return [("prose", text.strip())] if text.strip() else []
    lines = text.split("\n")
    width = max((len(x) for x in lines), default=0)
    rows: list[str] = []
    steps: list[dict[str, tuple[float, str | None, bool]]] = []  # kind -> (cost, kind of the line before, begins anew)
    blank = True
    for line in lines:
        bare = line.strip()
        if not bare:
            blank = True
            continue
        capital, small = bare[0].isupper() or not bare[0].isalpha(), bare[0].islower()
        fresh: dict[str, tuple[float, str | None, bool]] = {}
        closed = bool(rows) and bool(CLOSED.search(rows[-1]))
        for kind in ("prose", "verse"):
            own = (SMALL * small + WIDE * (len(bare) > 0.95 * width and width > 60)) if kind == "verse" else 0.0
            if not steps:
                fresh[kind] = (own + (0.5 if kind == "verse" else 0.0), None, True)
                continue
            last = min(steps[-1], key=lambda k: steps[-1][k][0])
            inside = last == "prose" and not blank and not closed
            best = (steps[-1][last][0] + NEW * (0.2 if blank else 1.0) + CAPITAL * inside + own, last, True)
            on = own + (1.5 if blank else 0.0)
            if kind == "prose":  # a prose line is broken where the next word did not fit, and mostly inside a sentence
                ragged = len(rows[-1]) + 1 + len(bare.split()[0]) <= 0.92 * width
                on += RAGGED * ragged + CAPITAL * (capital and not closed)
            if steps[-1][kind][0] + on < best[0]:
                best = (steps[-1][kind][0] + on, kind, False)
            fresh[kind] = best
        rows.append(bare)
        steps.append(fresh)
        blank = False
    if not rows:
        return []
    kind = min(steps[-1], key=lambda k: steps[-1][k][0])
    out: list[tuple[str, list[str]]] = []
    own: list[str] = []
    for k in range(len(rows) - 1, -1, -1):
        own.append(rows[k])
        _, before, anew = steps[k][kind]
        if anew:
            out.append((kind, own[::-1]))
            own = []
        kind = before or kind
    return [("prose" if len(own) == 1 else kind, ("\n" if kind == "verse" else " ").join(own)) for kind, own in reversed(out)]


NOTE = re.compile(r"(?:\d{1,3}[.\s]|\[\d{1,3}\]|\*)\s*\S")


def is_furniture(bare: str, page: int | None) -> bool:
    """Whether the text of an item labelled header or footer is proved to be one by its form.

    A page number, capitals, a bulleted title, or a title: short, closed by no mark, every word but
    small ones with a capital. Anything else is a note or body that was labelled wrongly.
    """
    if S.is_page_number(bare) is not None or S.BULLET_TITLE.fullmatch(bare):
        return True
    line = " ".join(bare.split())
    if len(line) > 90 or line[-1] in ".;:!?":
        return False
    own = re.sub(r"^\d{1,4}\s+|\s+\d{1,4}$", "", line)
    letters = [c for c in own if c.isalpha()]
    if not letters or all(c.isupper() for c in letters):
        return True
    return all(w[0].isupper() or w in TITLE_WORDS for w in re.findall(r"[^\W\d_]+(?:['’][^\W\d_]+)?", own))


TITLE_WORDS = frozenset("of for and the in on to an a".split())
KINDS = {"sectionheader": "heading", "listitem": "list", "footnote": "footnote"}


def item_parts(decoder: S.Decoder, page: int | None, label: str | None, text: str | None, foot: str | None, keys: set[str]) -> list[tuple[str, str]]:
    """(kind, repaired text) of the paragraphs of one item by itself."""
    label = S.plain_label(label)
    marginal = label in ("pageheader", "pagefooter")
    note = bool(foot and foot.strip())
    source = foot if note and (marginal or label == "footnote") else text
    if not source or not source.strip():
        return []
    bare = source.strip()
    if S.is_page_number(bare) is not None or S.header_key(bare) in keys:
        return []
    if marginal and not note and is_furniture(bare, page):
        return []
    repaired = repair_words(decoder, without_furniture(source, page, keys))
    kind = "footnote" if label == "pagefooter" or (marginal and (note or NOTE.match(bare))) else KINDS.get(label)
    own = [(kind, " ".join(repaired.split()))] if kind else paragraphs_of(repaired)
    return [(what, value) for what, value in own if value]


def joined_text(decoder: S.Decoder, parts: list[str]) -> str:
    """The parts of one paragraph as one text; a word that is broken at a seam is joined."""
    pieces: list[str] = []
    for x in parts:
        if pieces:
            half = S.letters_at_end(pieces[-1][:-1]) if pieces[-1][-1:] in S.HYPHENS else ""
            if half and decoder.decode((half.lower(), S.core_of(x.split(None, 1)[0])), ("h",))[1][0]:
                pieces[-1] = pieces[-1][:-1]
            elif not half:
                pieces.append(" ")
        pieces.append(x)
    return "".join(pieces)


OUT = "file string, start_idx int, start_part int, page_no int, end_page int, kind string, text string"
#: A paragraph that may go on in a neighbouring block: its block, its place in it (0 the first, 1 the last body
#: paragraph), whether it may go on with one before, and whether it ends inside a sentence.
EDGE = "block bigint, side int, goes_on boolean, ends_open boolean"


def blocks(items: DataFrame, keys: DataFrame, lexicon: dict[str, float]) -> DataFrame:
    """(file, start_idx, start_part, page_no, end_page, kind, text, block, side, goes_on, ends_open): paragraphs as far as a block reaches."""
    at = F.floor(F.coalesce(F.col("idx"), F.lit(0)) / BLOCK)
    left = items.select(F.coalesce("file", F.lit("")).alias("file"), at.alias("block"), "item_id", F.coalesce("idx", F.lit(0)).alias("idx"), "page_no", "label", "text", "footnote_text")
    right = keys.select(F.coalesce("file", F.lit("")).alias("file"), at.alias("block"), "item_id", "key")

    def run(items: pa.Table, keys: pa.Table) -> pa.Table:
        decoder = S.shared_decoder(lexicon)
        own: dict[int, set[str]] = {}
        for item, key in zip(keys.column("item_id").to_pylist(), keys.column("key").to_pylist()):
            own.setdefault(item, set()).add(key)
        rows = sorted(zip(*(items.column(n).to_pylist() for n in ("idx", "item_id", "page_no", "label", "text", "footnote_text", "file", "block"))), key=lambda r: (r[0], r[1]))
        done: list[list] = []  # [idx, part, page, end page, kind, texts, may go on with one before]
        body: list[int] = []
        before = None
        for idx, item, page, label, text, foot, _, _ in rows:
            if item == before and item is not None:  # delivered twice
                continue
            before = item
            for k, (kind, value) in enumerate(item_parts(decoder, page, label, text, foot, own.get(item, set()))):
                if kind == "footnote":
                    done.append([idx, k, page, page, kind, [value], False])
                    continue
                last = done[body[-1]] if body else None
                runs = k == 0 and kind == "prose"
                if runs and last and last[4] == "prose" and not CLOSED.search(last[5][-1]):
                    last[5].append(value)
                    last[2:4] = [min((p for p in (last[2], page) if p is not None), default=None), max((p for p in (last[3], page) if p is not None), default=None)]
                    continue
                body.append(len(done))
                done.append([idx, k, page, page, kind, [value], runs])
        out = []
        file, block = (rows[0][6], rows[0][7]) if rows else (None, None)
        ends = {body[0]: 0, body[-1]: 1 if len(body) > 1 else 0} if body else {}
        for i, (idx, k, page, end, kind, texts, runs) in enumerate(done):
            edge = (block, ends[i], runs and i == body[0], kind == "prose" and not CLOSED.search(texts[-1])) if i in ends else (None,) * 4
            out.append((file, idx, k, page, end, kind, joined_text(decoder, texts), *edge))
        kinds = (pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int32(), pa.bool_(), pa.bool_())
        names = [f.split()[0] for f in f"{OUT}, {EDGE}".split(", ")]
        columns = list(zip(*out)) if out else [()] * len(kinds)
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=names)

    return left.groupBy("file", "block").cogroup(right.groupBy("file", "block")).applyInArrow(run, f"{OUT}, {EDGE}")


def join_blocks(parts: DataFrame, lexicon: dict[str, float]) -> DataFrame:
    """The paragraphs of all blocks, those that run over block ends joined. ``parts`` is read twice: give it as a table."""
    along = Window.partitionBy("file").orderBy("block", "side")
    edges = parts.filter("block IS NOT NULL").withColumn("goes_on", F.col("goes_on") & F.coalesce(F.lag("ends_open").over(along), F.lit(False)))
    chain = F.last(F.when(~F.col("goes_on"), F.struct("block", "side")), ignorenulls=True).over(along.rowsBetween(Window.unboundedPreceding, 0))
    grouped = edges.withColumn("chain", chain).groupBy("file", "chain").agg(
        F.min_by(F.struct("start_idx", "start_part", "kind"), F.struct("block", "side")).alias("first"), F.min("page_no").alias("page_no"), F.max("end_page").alias("end_page"),
        F.array_sort(F.collect_list(F.struct("block", "side", "text"))).alias("own"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = S.shared_decoder(lexicon)
        names = ["file", "start_idx", "start_part", "page_no", "end_page", "kind"]
        for batch in batches:
            texts = [joined_text(decoder, [x["text"] for x in own]) for own in batch.column("own").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(texts, pa.string())], names=[*names, "text"])

    over = grouped.select("file", "first.start_idx", "first.start_part", "page_no", "end_page", "first.kind", "own").mapInArrow(run, OUT)
    return parts.filter("block IS NULL").select(*over.columns).unionByName(over)


def p1_paragraphs(spark: SparkSession, directory: str) -> DataFrame:
    """All paragraphs of all files; order within a file by ``start_idx`` and ``start_part``."""
    items = table(spark, directory, "extracted_items")
    counted = cut_lineage(S.count_corpus(items))
    lexicon = S.learn_lexicon(counted, table(spark, directory, "wordlist"))
    headers = counted.filter("kind = 'h' and n > 0").select("file", "key")
    keys = S.header_looks(items).join(headers, ["file", "key"], "left_semi")
    return join_blocks(cut_lineage(blocks(items, keys, lexicon)), lexicon)
