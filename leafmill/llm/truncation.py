"""Problem 5: texts cut off by field limits or in transfer.

Intact values are cut artificially to make positives; a hashed logistic regression learns from the
closing characters, punctuation, the last line and sentence, open markup, whether the last word
is a known word, and how common the text's length is for its model (a spike is a field limit).
Then every record is scored. The sample is bounded (about ``SAMPLE`` records by a hash of their
key); the words and the lengths are counted over all records. Records that are cut already
would teach the wrong thing as negatives, so those that models of the other folds take for cut are
left out, twice, before the last fit.

No text is shuffled. One pass over the texts writes, for each record, its key, length, last word and
hashed features, and for each task its counts of words. A feature that depends on how common the
last word or the length is stands there without that part, which is mixed in when both are known.
Common last words and lengths, which may be those of a third of all records, are brought to the
records by a broadcast of at most 1 / ``HOT_SHARE`` rows, the others by an equi-join.

Defined results: null, empty and blank texts are not truncated (score 0). White space at the end
is no sign either way. Repeated rows count once, but in the counts of words, which are evidence alone.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm.common import cut_lineage, table

SAMPLE = 4000
DIMENSIONS = 1 << 16
THRESHOLD = 0.5
CUTS = 4
FOLDS = 5
BATCH = 192
ROUNDS = 2
HOT_SHARE = 1e-5

WORDS = re.compile(r"[^\W\d_]+")
# What a transfer or a tool may put behind a cut, besides points and white space.
BEHIND = re.compile(r"\[\s*(?:…|\.{3}|truncated|cut|more)\s*\]|\(\s*(?:…|\.{3}|truncated|more|continued)\s*\)", re.I)
CLOSERS = "\"'”’)]*_}>`$"
SENTENCE_END = re.compile(r"[.!?…][\"'”’)\]*_]*\s+|\n\s*\n")
MARKUP_START = re.compile(r"^(?:>+|[-*+•]|\d+[.)]|#+|\|)\s*")


def body_and_mark(text: str) -> tuple[str, str]:
    """The text before what may stand behind a cut, and the kind of what stands there."""
    end = len(text)
    while end:
        c, at = text[end - 1], end
        if c.isspace() or c == "…":
            at -= 1
        elif c == ".":
            while at and text[at - 1] == ".":
                at -= 1
            at = at if end - at > 2 else end
        elif c in ")]":
            opened = text.rfind("(" if c == ")" else "[", 0, end)
            at = opened if opened >= 0 and BEHIND.fullmatch(text, opened, end) else end
        if at == end:
            break
        end = at
    mark = text[end:].strip()
    kind = "" if not mark else "e" if mark[0] == "…" else "d" if mark[0] == "." else "w"
    return text[:end], kind


def last_word(text: str | None) -> str | None:
    """The word that nothing but marks follow."""
    if not text or not text.strip():
        return None
    body = body_and_mark(text)[0]
    end = len(body)
    while end and not (body[end - 1].isalnum() or body[end - 1] == "_"):
        end -= 1
    start = end
    while start and body[start - 1].isalpha():
        start -= 1
    return body[start:end].lower() or None


def _closed(body: str) -> bool:
    if body[-1] in ".!?":
        return True
    if len(body) < 2 or body[-1] not in CLOSERS:
        return False
    bare = body.rstrip(CLOSERS)
    return body[-1] in "`})" or bare[-1:] in (".", "!", "?") or (body[-1] == ">" and bool(re.fullmatch(r"</\w+>", body[max(body.rfind("<"), 0) :])))


def _shape(c: str) -> str:
    return "a" if c.islower() else "A" if c.isupper() else "9" if c.isdigit() else "s" if c.isspace() else "a" if c.isalpha() else c


def _bucket(n: int) -> int:
    return n if n <= 6 else 7 if n <= 9 else 8 if n <= 14 else 9


def features(text: str) -> tuple[list[str], list[str], list[str]]:
    """Names of the binary features of a text that is not blank.

    Those that stand by themselves, those to be mixed with the last word's level, and those with the length's.
    """
    body, mark = body_and_mark(text)
    if not body:
        return ["empty"], [], []
    end = "".join(_shape(c) for c in body[-3:])
    closed = _closed(body)
    line = body[body.rfind("\n") + 1 :]
    bare = MARKUP_START.sub("", line.strip())
    words = bare.split()
    previous = body[: len(body) - len(line)].rstrip(" \t")
    apart = previous.endswith("\n\n") or not previous
    sentence = SENTENCE_END.split(line)[-1].split()
    paragraph = body[body.rfind("\n\n") + 1 :]
    start = re.sub(r"\d+", "9", " ".join(words[:2])).lower()
    first = re.sub(r"\d+", "9", words[0]).lower() if words else ""
    ending = "p" if closed else "e" if mark == "e" else "d" if mark else "n"
    names = [
        "bias", f"end3={end}", f"end2={end[-2:]}", f"last={end[-1]}", f"ending={ending}",
        f"{ending}|first={first}|apart={apart}", f"{ending}|sentn={_bucket(len(sentence))}",
    ]
    levelled = [
        f"{ending}", f"{ending}|apart={apart}|n={_bucket(len(words))}", f"{ending}|start={start}", f"{ending}|start={start}|n={_bucket(len(words))}",
        f"{ending}|sent={' '.join(sentence[:2]).lower()}|n={_bucket(len(sentence))}", f"{ending}|upper={line.isupper()}|apart={apart}",
    ]
    if _shape(body[-1]) not in "aA":
        names += [f"{n}|k-" for n in levelled]
        levelled = []
    for opened, shut in (("[", "]"), ("(", ")"), ("{", "}"), ("<", ">")):
        if paragraph.count(opened) > paragraph.count(shut):
            names.append(f"open={opened}")
    for sign in ("**", "$", "``", '"', "'''", "__"):
        if paragraph.count(sign) % 2:
            names.append(f"odd={sign}|{ending}")
    if text.count("```") % 2:
        names.append("open=fence")
    names.append(f"suffix={body[-3:].lower()}|{ending}" if body[-1].isalpha() else "suffix=-")
    return names, levelled, ["spike", f"spike|{ending}"]


def hashed(names: list[str]) -> list[int]:
    import xxhash

    return [xxhash.xxh32_intdigest(n) for n in names]


def mixed(hashes: tuple[list[int], list[int], list[int]], level: int, spike: int) -> list[int]:
    """Places of the features in the weights, with the level of the last word and of the length mixed in."""
    every = [*((h, 0) for h in hashes[0]), *((h, 1 + level) for h in hashes[1]), *((h, 11 + spike) for h in hashes[2])]
    return sorted({((h + v * 0x9E3779B1) * 0x85EBCA6B & 0xFFFFFFFF) >> 16 for h, v in every})


def artificial_cuts(text: str, seed: int, cuts: int = CUTS) -> list[tuple[str, str]]:
    """(the text as cut, how) at random places inside a sentence, near the end as often as anywhere."""
    draw = np.random.default_rng(seed & 0x7FFFFFFF)
    body = text.rstrip()
    out = []
    for k in range(cuts * 4):
        if len(out) == cuts or len(body) < 30:
            break
        at = int(draw.integers(max(10, len(body) - 80), len(body))) if k % 3 == 0 else int(draw.integers(10, len(body)))
        before, after = body[:at], body[at:]
        if before[-1] in ".!?…\n\"')]" or before.rstrip() != before or after[0] in "\n" or (not after[0].isalnum() and not before[-1].isalnum()):
            continue
        if after[0] in ".!?" and not after[1:2].isalnum():
            continue  # nothing but the final point would be missing
        out.append((before + ("", "", "", "", "…", "...", " ", "\n", "…\n", "\n\n")[int(draw.integers(0, 10))], "cut"))
    return out


class Model:
    def __init__(self, weights: np.ndarray):
        self.weights = weights.astype(np.float32)

    def score(self, rows: list[list[int]]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.array([self.weights[np.array(r, int)].sum() for r in rows], float)))


def train(rows: list[list[int]], labels: np.ndarray, epochs: int = 12, rate: float = 0.3, decay: float = 1e-5) -> Model:
    """Logistic regression by AdaGrad in mini-batches; both classes weigh the same."""
    weights, gathered = np.zeros(DIMENSIONS), np.full(DIMENSIONS, 1e-2)
    draw = np.random.default_rng(7)
    share = max(labels.mean(), 1e-3) if len(labels) else 0.5
    weight = np.where(labels == 1, 0.5 / share, 0.5 / max(1 - share, 1e-3))
    lengths = np.array([len(r) for r in rows])
    flat = np.concatenate([np.array(r) for r in rows]) if rows else np.empty(0, int)
    offset = np.cumsum(lengths) - lengths
    for _ in range(epochs):
        order = draw.permutation(len(rows))
        for batch in np.array_split(order, max(1, len(order) // BATCH)):
            if not len(batch):
                continue
            ids = np.concatenate([flat[offset[i] : offset[i] + lengths[i]] for i in batch])
            owner = np.repeat(np.arange(len(batch)), lengths[batch])
            margin = np.bincount(owner, weights[ids], len(batch))
            error = (1 / (1 + np.exp(-margin)) - labels[batch]) * weight[batch] / len(batch)
            gradient = np.bincount(ids, error[owner], DIMENSIONS)
            touched = np.flatnonzero(gradient)
            g = gradient[touched] + decay * weights[touched]
            gathered[touched] += g * g
            weights[touched] -= rate * g / np.sqrt(gathered[touched])
    return Model(weights)


def records(spark: SparkSession, directory: str) -> DataFrame:
    """(source_table, item_key, source, text) of both tables, repeated rows included; models in lower case."""
    replies, chunks = table(spark, directory, "transcriptions"), table(spark, directory, "chunk_texts")
    source = F.lower(F.trim("model")).alias("source")
    return replies.select(F.lit("transcriptions").alias("source_table"), F.col("reply_id").cast("string").alias("item_key"), source, F.col("markdown_text").alias("text")).unionByName(
        chunks.select(F.lit("chunk_texts").alias("source_table"), F.col("chunk_id").cast("string").alias("item_key"), source, F.col("content").alias("text"))
    )


NAMES = ["source_table", "item_key", "source", "text"]
LIGHT = (
    "source_table string, item_key string, source string, size int, last_word string, cut int, plain array<bigint>, levelled array<bigint>, sized array<bigint>, word string, n bigint"
)


def _light(frame: DataFrame, cuts: bool, longest: int = 500_000) -> DataFrame:
    """For each record its light row, and for each task the words inside its texts with their numbers.

    With ``cuts``, each record's artificial cuts (``cut`` = 1) follow it, and no words are counted. ``size`` is null for blank texts.
    """
    listed = pa.list_(pa.int64())
    kinds = (pa.string(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.int32(), listed, listed, listed, pa.string(), pa.int64())
    names = [f.split()[0] for f in LIGHT.split(", ")]

    def made(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows)) if rows else [()] * len(kinds)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=names)

    def counted(words: Counter[str]) -> pa.RecordBatch:
        return made([(*[None] * 9, w, n) for w, n in words.items()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        words: Counter[str] = Counter()
        for batch in batches:
            out = []
            for table_, key, source, text in zip(*(batch.column(n).to_pylist() for n in NAMES)):
                blank = not text or not text.strip()
                values = [(text, 0)]
                if cuts and not blank:
                    values += [(t, 1) for t, _ in artificial_cuts(text, xxhash.xxh32_intdigest(f"{table_}{key}"))]
                for t, cut in values:
                    got = ([], [], []) if blank else tuple(hashed(x) for x in features(t))
                    out.append((table_, key, source or "", None if blank else len(t), last_word(t) or "", cut, *got, None, None))
                if not blank and not cuts:
                    inner = WORDS.findall(text.lower())
                    words.update(inner[:-1] if text.rstrip()[-1:].isalpha() or last_word(text) else inner)
            yield made(out)
            if len(words) > longest:
                yield counted(words)
                words = Counter()
        yield counted(words)

    return frame.select(*NAMES).mapInArrow(run, LIGHT)


class Evidence:
    """The light rows of all records, how common words are in all texts, and which lengths are spikes for their source."""

    def __init__(self, everything: DataFrame):
        every = cut_lineage(_light(everything, False))
        self.words = cut_lineage(every.filter("word IS NOT NULL").groupBy(F.col("word").alias("last_word")).agg(F.sum("n").alias("n_word")))
        total = float(self.words.agg(F.sum("n_word")).first()[0] or 1)
        ppm = F.col("n_word") * 1e6 / F.lit(total)
        self.levels = self.words.select("last_word", F.when(ppm < 3, 1).when(ppm < 20, 2).when(ppm < 100, 3).otherwise(4).alias("word_level"))
        self.rows = cut_lineage(every.filter("word IS NULL").drop("word", "n").dropDuplicates(["source_table", "item_key"]))
        self.count = self.rows.count()
        lengths = self.rows.filter("size IS NOT NULL").groupBy("source", "size").agg(F.count(F.lit(1)).alias("n_size"))
        sizes = lengths.groupBy("source").agg(F.sum("n_size").alias("n_source"))
        spike = (F.col("n_size") >= 4) & (F.col("n_size") >= 0.01 * F.col("n_source"))
        self.spikes = cut_lineage(lengths.join(sizes, "source").filter(spike).select("source", "size", F.lit(1).alias("spike"), "n_size"))

    def with_both(self) -> DataFrame:
        """The light rows with ``word_level`` and ``spike``.

        A row whose key is hot is done by the broadcast and takes no part in the join on that key.
        """
        least = max(100.0, HOT_SHARE * self.count)
        common = self.rows.groupBy("last_word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)
        hot_words = cut_lineage(common.join(self.levels, "last_word", "left").select("last_word", F.coalesce("word_level", F.lit(0)).alias("hot_level")))
        hot_sizes = self.spikes.filter(F.col("n_size") >= least).select("source", "size", F.lit(1).alias("hot_spike"))
        rows = self.rows.join(F.broadcast(hot_words), "last_word", "left").join(F.broadcast(hot_sizes), ["source", "size"], "left")
        done = rows.filter("hot_level IS NOT NULL").withColumn("word_level", F.col("hot_level"))
        looked = rows.filter("hot_level IS NULL").join(self.levels, "last_word", "left")
        levelled = done.unionByName(looked.select(*done.columns))
        rest = self.spikes.filter(F.col("n_size") < least).select("source", "size", "spike")
        return levelled.join(rest, ["source", "size"], "left").select(
            "source_table", "item_key", "source", "size", "plain", "levelled", "sized", F.coalesce("word_level", F.lit(0)).alias("word_level"), F.coalesce("hot_spike", "spike", F.lit(0)).alias("spike")
        )


def fit(everything: DataFrame, evidence: Evidence, sample: int = SAMPLE) -> Model:
    """The model; about ``sample`` records and their cuts come to the driver, as hashed features."""
    spark = everything.sparkSession
    share = sample / max(evidence.count, 1)
    h = F.xxhash64("source_table", "item_key")
    chosen = everything.filter((F.pmod(h, F.lit(1_000_000)) < F.lit(share * 1_000_000)) & (F.length(F.trim("text")) > 0))
    taken = {(r["source_table"], r["item_key"], r["cut"], r["size"], tuple(r["plain"])): r for r in _light(chosen, True).filter("word IS NULL").collect()}
    ends = sorted({r["last_word"] for r in taken.values()})
    spikes = {(r["source"], r["size"]) for r in taken.values() if r["cut"] == 0}
    asked = spark.createDataFrame([(w,) for w in ends], "last_word string")
    levels = {r["last_word"]: r["word_level"] for r in evidence.levels.join(F.broadcast(asked), "last_word").collect()}
    asked = spark.createDataFrame(sorted(x for x in spikes if x[1] is not None), "source string, size int")
    spikes = {(r["source"], r["size"]) for r in evidence.spikes.join(F.broadcast(asked), ["source", "size"]).collect()}
    got = []
    for r in taken.values():
        # one artificial cut in three stands for a field limit; an uncut record of a length
        # that is itself a spike is suspect and teaches nothing
        if r["size"] is None or (not r["cut"] and (r["source"], r["size"]) in spikes):
            continue
        seen = int(r["size"] % 3 == 0) if r["cut"] else 0
        got.append((r["cut"], mixed((r["plain"], r["levelled"], r["sized"]), levels.get(r["last_word"], 0), seen)))
    got.sort()
    rows, labels = [r for _, r in got], np.array([c for c, _ in got], float)
    keep = np.ones(len(rows), bool)
    for _ in range(ROUNDS):
        keep = (labels == 1) | (_held_out(rows, labels, keep) < THRESHOLD)
    return train([r for r, k in zip(rows, keep) if k], labels[keep])


def _held_out(rows: list[list[int]], labels: np.ndarray, keep: np.ndarray) -> np.ndarray:
    """Scores of all rows, each by a model that was trained on the kept rows of the other folds."""
    fold = np.random.default_rng(11).integers(0, FOLDS, len(rows))
    scores = np.zeros(len(rows))
    for k in range(FOLDS):
        inner, outer = np.flatnonzero((fold != k) & keep), np.flatnonzero(fold == k)
        model = train([rows[i] for i in inner], labels[inner])
        scores[outer] = model.score([rows[i] for i in outer])
    return scores


def score(evidence: Evidence, model: Model) -> DataFrame:
    """(source_table, item_key, source, blank, score) of every record."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = (batch.column(n).to_pylist() for n in ("size", "plain", "levelled", "sized", "word_level", "spike"))
            scores = [0.0 if size is None else float(model.score([mixed((p, l, z), level, spike)])[0]) for size, p, l, z, level, spike in zip(*columns)]
            blank = pa.array([s is None for s in batch.column("size").to_pylist()], pa.bool_())
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in ("source_table", "item_key", "source")), blank, pa.array(scores, pa.float64())], names=["source_table", "item_key", "source", "blank", "score"])

    return evidence.with_both().mapInArrow(run, "source_table string, item_key string, source string, blank boolean, score double")


def scored(spark: SparkSession, directory: str) -> DataFrame:
    everything = records(spark, directory)
    evidence = Evidence(everything)
    return score(evidence, fit(everything, evidence))


def p5_scores(spark: SparkSession, directory: str) -> DataFrame:
    return scored(spark, directory).drop("blank")


def p5_found(spark: SparkSession, directory: str) -> DataFrame:
    return scored(spark, directory).filter(F.col("score") >= THRESHOLD).select("source_table", "item_key")


def p5_rates(spark: SparkSession, directory: str) -> DataFrame:
    """How often each model truncates: records with text, truncated ones, rate."""
    return (
        scored(spark, directory)
        .filter("NOT blank")
        .groupBy("source")
        .agg(F.count(F.lit(1)).alias("n_records"), F.count_if(F.col("score") >= THRESHOLD).alias("n_truncated"))
        .withColumn("rate", F.col("n_truncated") / F.col("n_records"))
    )
