"""Problem 8: long spans that stand character for character in more than one document.

Content-defined chunking by a gear hash. A start is a local minimum of the hash over
``START_WINDOW`` positions, a chunk ends at the first local minimum over ``END_WINDOW`` positions
that lies ``CHUNK_CHARS`` or more behind its start. Both depend on the 16 characters before a
position alone, so an insertion moves no other chunk. Any span of 200 common characters holds a
whole chunk: a start within its first 15 + 90 positions, its end at most 64 + 16 further on.
So chunks of equal digest find every pair (no recall is lost, up to hash collisions), and an
exact comparison of the characters around them follows.

Every chunk's place goes through one exchange by its digest. Behind it the places stand in order
of digest and document, and a pass over them keeps the digests that are in two documents or more;
it holds at most ``MANY`` places. Digests that a documented sample already shows in a hundredth of
its documents need no counting: their places are spread over all tasks by document. The sample
decides where rows are worked on, never which rows come out.

Of a digest in few places, the places' contexts are compared pair by pair. A digest in many
places (a boilerplate, periodic text) is never expanded into pairs: its places list the digests
of all 200-character windows around the chunk, and only equal windows, which are true cases,
meet. Both ways are exact, so where the line between them is drawn changes no row. For the pairs,
windows with the same set of documents are joined once, and the join of a window that is in many
documents is split over tasks; for the shares, every place of every window that is in more than
one document counts, merged to ranges for each document without any pairs.

Defined results: null, empty and short texts have no case; a repeated row of a document is the
same document; spans within one document alone do not count.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm.common import code_points, cut_lineage, gear_hash, sliding_min, table

SPAN = 200
GEAR = 16
START_WINDOW = 90
END_WINDOW = 16
CHUNK_CHARS = 64
MANY = 16
# Of the sample that finds hot digests: documents, and the share of them from which a digest is hot.
SAMPLE = 2000
HOT_SHARE = 0.01
PAIR_BLOCK = 256


def _minima(keys: np.ndarray, width: int, owner: np.ndarray) -> np.ndarray:
    """Positions of the minima of all windows that lie within one document."""
    low = sliding_min(keys, width)
    inside = owner[: low.size] == owner[width - 1 :]
    return np.unique((np.uint64(0xFFFFFFFF) - (low[inside] & np.uint64(0xFFFFFFFF))).astype(np.int64))


def chunks_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all chunks of some texts of at least SPAN characters: text index, start, end, digest."""
    points = code_points("".join(texts))
    sizes = np.array([len(t) for t in texts], np.int64)
    first = np.cumsum(sizes) - sizes
    hashes = gear_hash(points, GEAR)
    usable = np.ones(points.size, bool)  # the first positions of a text see the text before it
    for k in range(GEAR - 1):
        usable[first + k] = False
    at = np.flatnonzero(usable)
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), sizes)[at]
    keys = (hashes[at].astype(np.uint64) << np.uint64(32)) | (np.uint64(0xFFFFFFFF) - np.arange(at.size, dtype=np.uint64))
    starts, ends = _minima(keys, START_WINDOW, owner), _minima(keys, END_WINDOW, owner)
    following = np.searchsorted(ends, starts + CHUNK_CHARS)
    starts, following = starts[following < ends.size], following[following < ends.size]
    ends = ends[following]
    same = owner[starts] == owner[ends]
    starts, ends = starts[same], ends[same]
    who = owner[starts]
    low, high = at[starts] - (GEAR - 1), at[ends] + 1
    raw = memoryview(points).cast("B")
    digest = xxhash.xxh3_64_intdigest
    digests = np.fromiter((digest(raw[4 * a : 4 * b]) for a, b in zip(low.tolist(), high.tolist())), np.uint64, low.size)
    return who, low - first[who], high - first[who], digests.view(np.int64)


def _keyed(documents: DataFrame, key: str, text: str) -> DataFrame:
    """(doc, text) of the documents that can have a case."""
    return documents.select(F.col(f"`{key}`").cast("bigint").alias("doc"), F.col(f"`{text}`").alias("text")).filter(F.length("text") >= SPAN)


def postings(texts: DataFrame, hot: frozenset[int] = frozenset(), longest: int = 4_000_000) -> DataFrame:
    """(digest, doc, place) of every chunk; the place is 256 * start + length, and -1 - that for hot digests.

    Texts are taken in groups of about ``longest`` characters.
    """
    known = np.array(sorted(hot), np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(keys: list[int], texts: list[str]) -> pa.RecordBatch:
            who, low, high, digests = chunks_of(texts)
            place = low * 256 + (high - low)
            if known.size:
                place = np.where(np.isin(digests, known), -1 - place, place)
            return pa.RecordBatch.from_arrays([pa.array(digests), pa.array(np.array(keys, np.int64)[who]), pa.array(place)], names=["digest", "doc", "place"])

        for batch in batches:
            keys, texts, size = [], [], 0
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                keys.append(k)
                texts.append(t)
                size += len(t)
                if size > longest:
                    yield made(keys, texts)
                    keys, texts, size = [], [], 0
            if keys:
                yield made(keys, texts)

    return texts.mapInArrow(run, "digest bigint, doc bigint, place bigint")


def hot_digests(texts: DataFrame, sample: int = SAMPLE, share: float = HOT_SHARE) -> frozenset[int]:
    """Digests in at least the share of a sample of about ``sample`` documents, and in two of them at least.

    At most (chunks of the sample) / (share * sample) digests come to the driver.
    """
    many = max(texts.count(), 1)
    parts = max(1, many // sample)
    chosen = texts.filter(F.pmod(F.xxhash64("doc"), F.lit(parts)) == 0)
    rows = postings(chosen).select("digest", "doc").distinct().groupBy("digest").agg(F.count(F.lit(1)).alias("n"))
    return frozenset(r["digest"] for r in rows.filter(F.col("n") >= max(2, share * min(many, sample))).select("digest").collect())


def _in_two(many: int):
    """Keeps, of places in order of (digest, doc, place), those of digests in two documents or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        empty = np.empty(0, np.int64)
        carry = (empty, empty, empty)
        settled: int | None = None  # a digest that is known to be in many places

        def rows(digest: np.ndarray, doc: np.ndarray, place: np.ndarray, flag: np.ndarray) -> pa.RecordBatch:
            place = np.where(place < 0, -1 - place, place)
            low, size = (place >> 8).astype(np.int32), (place & 255).astype(np.int32)
            return pa.RecordBatch.from_arrays([pa.array(digest), pa.array(doc), pa.array(low), pa.array(low + size), pa.array(flag)], names=["digest", "doc", "low", "high", "many"])

        def chosen(digest: np.ndarray, doc: np.ndarray, place: np.ndarray) -> pa.RecordBatch:
            starts = np.flatnonzero(np.r_[True, digest[1:] != digest[:-1]])
            counts = np.diff(np.r_[starts, digest.size])
            hot = place[starts] < 0
            kept = (doc[starts] != doc[starts + counts - 1]) | hot
            taken = np.repeat(kept, counts)
            return rows(digest[taken], doc[taken], place[taken], np.repeat(hot | (counts > many), counts)[taken])

        for batch in batches:
            digest, doc, place = (np.concatenate([c, batch.column(k).to_numpy()]) for k, c in enumerate(carry))
            if not digest.size:
                continue
            fresh = np.r_[True, (digest[1:] != digest[:-1]) | (doc[1:] != doc[:-1]) | (place[1:] != place[:-1])]  # repeated rows
            digest, doc, place = digest[fresh], doc[fresh], place[fresh]
            if settled is not None:
                n = int(np.searchsorted(digest, settled, side="right"))
                if n:
                    yield rows(digest[:n], doc[:n], place[:n], np.ones(n, bool))
                    digest, doc, place = digest[n:], doc[n:], place[n:]
                if digest.size:
                    settled = None
                else:
                    carry = (empty, empty, empty)
                    continue
            last = int(np.searchsorted(digest, digest[-1]))
            if last:
                yield chosen(digest[:last], doc[:last], place[:last])
            carry = (digest[last:], doc[last:], place[last:])
            if carry[0].size > many and carry[1][0] != carry[1][-1]:
                settled = int(carry[0][0])
                yield rows(*carry, np.ones(carry[0].size, bool))
                carry = (empty, empty, empty)
        if carry[0].size:
            yield chosen(*carry)

    return run


def repeated_chunks(texts: DataFrame, many: int = MANY) -> DataFrame:
    """(digest, doc, low, high, many): the places of all chunks that are in two documents or more."""
    spread = F.when(F.col("place") < 0, F.col("doc")).otherwise(F.col("digest"))
    ordered = postings(texts, hot_digests(texts)).repartition(spread).sortWithinPartitions("digest", "doc", "place")
    return ordered.mapInArrow(_in_two(many), "digest bigint, doc bigint, low int, high int, many boolean")


def _common_prefix(a: str, b: str) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n
    while high - low > 1:
        middle = (low + high) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle
    return low


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of places of one digest whose common span has SPAN characters or more."""
    for batch in batches:
        out: list[tuple[int, int, int, int, int]] = []
        for places in batch.column(0).to_pylist():
            places.sort(key=lambda p: (p["doc"], p["low"]))
            for j, b in enumerate(places):
                for a in places[:j]:
                    if a["doc"] == b["doc"] or a["chunk"] != b["chunk"]:
                        continue
                    left = _common_prefix(a["left"][::-1], b["left"][::-1])
                    right = _common_prefix(a["right"], b["right"])
                    size = left + len(a["chunk"]) + right
                    if size >= SPAN:
                        out.append((a["doc"], b["doc"], a["low"] - left, b["low"] - left, size))
        columns = list(zip(*out)) if out else [()] * 5
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()))],
            names=["doc_id_a", "doc_id_b", "at_a", "at_b", "size"],
        )


def _evidence(texts: DataFrame, many: int, every: bool) -> DataFrame:
    """Contexts of the chunks in few places, and windows around those in many.

    (digest, doc, low, left, chunk, right) with a null ``window``, or (doc, low, window) with a null ``digest``.
    ``every``: all places of a window in a document, else its first one. The texts are read once,
    for the places that are left.
    """
    own = repeated_chunks(texts, many).groupBy("doc").agg(F.collect_list(F.struct("digest", "low", "high", "many")).alias("own"))
    fields = (("digest", pa.int64()), ("doc", pa.int64()), ("low", pa.int32()), ("left", pa.string()), ("chunk", pa.string()), ("right", pa.string()), ("window", pa.binary()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_128_digest
        for batch in batches:
            out: list[tuple] = []
            for doc, places, body in zip(batch.column("doc").to_pylist(), batch.column("own").to_pylist(), batch.column("text").to_pylist()):
                frequent = []
                for p in places:
                    low, high = p["low"], p["high"]
                    if p["many"]:
                        frequent.append((low, high))
                        continue
                    spare = SPAN - (high - low)
                    out.append((p["digest"], doc, low, body[max(0, low - spare) : low], body[low:high], body[high : high + spare], None))
                if not frequent:
                    continue
                raw = memoryview(body.encode("utf-32-le", "surrogatepass"))
                seen: set[bytes] = set()
                done = -1
                for low, high in sorted(frequent):
                    for at in range(max(done + 1, high - SPAN, 0), min(low, len(body) - SPAN) + 1):
                        done = at
                        window = digest(raw[4 * at : 4 * (at + SPAN)])
                        if not every:
                            if window in seen:
                                continue
                            seen.add(window)
                        out.append((None, doc, at, None, None, None, window))
            columns = list(zip(*out)) if out else [()] * len(fields)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, fields)], names=[n for n, _ in fields])

    joined = texts.join(own, "doc").select("doc", "own", "text")
    return cut_lineage(joined.mapInArrow(run, "digest bigint, doc bigint, low int, left string, chunk string, right string, window binary"))


def _near_spans(evidence: DataFrame) -> DataFrame:
    """(doc_id_a, doc_id_b, at_a, at_b, size) of every pair of places of the chunks that are in few places."""
    return (
        evidence.filter("digest IS NOT NULL")
        .groupBy("digest")
        .agg(F.collect_list(F.struct("doc", "low", "left", "chunk", "right")).alias("places"))  # at most ``many`` places
        .select("places")
        .mapInArrow(_compare, "doc_id_a bigint, doc_id_b bigint, at_a int, at_b int, size int")
    )


def _window_spans(evidence: DataFrame) -> DataFrame:
    """Spans found by equal windows: enough of them for every pair, not for every character.

    The one side of a window in n documents is split into n / ``PAIR_BLOCK`` parts and the other
    one repeated for each, so no task pairs more than a block with all the others.
    """
    listed = evidence.filter("window IS NOT NULL").select(F.col("window").alias("key"), "doc", "low")
    sets = listed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("doc").cast("decimal(38,0)")).alias("sum"), F.bit_xor(F.xxhash64("doc", F.lit(1))).alias("xor")).filter("n > 1")
    one = sets.groupBy("n", "sum", "xor").agg(F.min("key").alias("key")).select("key", F.ceil(F.col("n") / PAIR_BLOCK).cast("int").alias("parts"))
    chosen = listed.join(one, "key")
    left = chosen.select("key", "doc", "low", F.pmod(F.xxhash64("doc"), F.col("parts")).cast("int").alias("part"))
    right = chosen.select("key", F.col("doc").alias("doc_id_b"), F.col("low").alias("at_b"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    return (
        left.join(right, ["key", "part"])
        .filter("doc < doc_id_b")
        .select(F.col("doc").alias("doc_id_a"), "doc_id_b", F.col("low").alias("at_a"), "at_b", F.lit(SPAN).alias("size"))
    )


def shared_spans(documents: DataFrame, key: str = "doc_id", text: str = "text", many: int = MANY) -> DataFrame:
    """(doc_id_a, doc_id_b, at_a, at_b, size): common spans that are a case, or parts of longer ones.

    Each pair of documents with a case has at least one row. Of texts in many places the rows name
    one window for each set of documents; what they cover in full is in ``shared_ranges``.
    """
    evidence = _evidence(_keyed(documents, key, text), many, False)
    return _near_spans(evidence).unionByName(_window_spans(evidence))


def shared_ranges(documents: DataFrame, key: str = "doc_id", text: str = "text", many: int = MANY) -> DataFrame:
    """(doc, low, high): ranges of each document, which may overlap.

    Together they cover exactly the characters that stand in a span of SPAN or more characters that
    another document has too.
    """
    evidence = _evidence(_keyed(documents, key, text), many, True)
    side = lambda x: F.struct(F.col(f"doc_id_{x}").alias("doc"), F.col(f"at_{x}").alias("low"), (F.col(f"at_{x}") + F.col("size")).alias("high"))
    near = _near_spans(evidence).select(F.explode(F.array(side("a"), side("b"))).alias("r")).select("r.*").distinct()
    return near.unionByName(_window_ranges(evidence))


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, low, high) of rows (doc, low) in order: windows that touch or overlap are one range."""
    doc, low, high = None, 0, 0
    names, kinds = ["doc", "low", "high"], (pa.int64(), pa.int32(), pa.int32())
    for batch in batches:
        out: list[tuple[int, int, int]] = []
        for d, at in zip(batch.column("doc").to_pylist(), batch.column("low").to_pylist()):
            if d == doc and at <= high:
                high = at + SPAN
                continue
            if doc is not None:
                out.append((doc, low, high))
            doc, low, high = d, at, at + SPAN
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [()] * 3, kinds)], names=names)
    if doc is not None:
        yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((doc, low, high), kinds)], names=names)


def _window_ranges(evidence: DataFrame) -> DataFrame:
    """(doc, low, high) covered by all windows that are in more than one document; no pairs are made."""
    listed = evidence.filter("window IS NOT NULL").select(F.col("window").alias("key"), "doc", "low")
    shared = listed.groupBy("key").agg(F.min("doc").alias("least"), F.max("doc").alias("most")).filter("least < most").select("key")
    kept = listed.join(shared, "key").select("doc", "low")
    return kept.repartition("doc").sortWithinPartitions("doc", "low").mapInArrow(_merged, "doc bigint, low int, high int")


def p8_found(spark: SparkSession, directory: str) -> DataFrame:
    """Pairs of documents with a common span of SPAN or more characters."""
    return shared_spans(table(spark, directory, "documents")).select("doc_id_a", "doc_id_b").distinct()


def shared_chars(documents: DataFrame, many: int = MANY) -> DataFrame:
    """(doc_id, n_chars, shared_chars, share) of every document."""
    ranges = shared_ranges(documents, many=many).withColumnRenamed("doc", "doc_id")
    step = F.aggregate(
        "own",
        F.struct(F.lit(0).cast("bigint").alias("sum"), F.lit(0).alias("end")),
        lambda acc, x: F.struct(
            (acc["sum"] + F.greatest(F.lit(0), x["high"] - F.greatest(x["low"], acc["end"]))).alias("sum"), F.greatest(acc["end"], x["high"]).alias("end")
        ),
        lambda acc: acc["sum"],
    )
    covered = ranges.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("low", "high"))).alias("own")).select("doc_id", step.alias("shared_chars"))
    return documents.select("doc_id", F.coalesce(F.length("text"), F.lit(0)).cast("bigint").alias("n_chars")).distinct().join(covered, "doc_id", "left").select(
        "doc_id",
        "n_chars",
        F.coalesce("shared_chars", F.lit(0)).cast("bigint").alias("shared_chars"),
        F.when(F.col("n_chars") > 0, F.coalesce("shared_chars", F.lit(0)) / F.col("n_chars")).otherwise(0.0).alias("share"),
    )


def p8_shares(spark: SparkSession, directory: str) -> DataFrame:
    """Each document's number of characters that stand in such a span elsewhere too, and their share."""
    return shared_chars(table(spark, directory, "documents"))
