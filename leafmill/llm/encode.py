"""Problem 6: token ids of every document by a public byte-level vocabulary.

Long texts are first cut where no match of the splitting pattern can cross: after a letter,
number or punctuation mark and before a blank or line end. Encoding the parts one by one gives
the ids of the whole, and the encoder never sees an unbounded string. Decoding joins raw bytes
before it reads them as UTF-8, since a character may be spread over several tokens.

Defined results: null and empty texts give the empty list; repeated rows give repeated rows;
other columns are kept only if named in ``keep``; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafmill.llm.common import TOKENIZER_DIR, byte_bpe, table

PART_CHARS = 20_000
VOCABULARY = "byte_bpe_50k"


def safe_parts(text: str, part_chars: int = PART_CHARS) -> list[str]:
    """Cuts a text into parts of about the size, only at safe boundaries.

    A boundary lies between a visible character and a following space or line end: there a
    match of the pattern always ends, whatever precedes or follows. A text without one stays whole.
    """
    if len(text) <= part_chars:
        return [text]
    parts, start = [], 0
    while len(text) - start > part_chars:
        at = start + part_chars
        while at < len(text) and not (text[at] in " \n" and text[at - 1].isprintable() and not text[at - 1].isspace()):
            at += 1
        if at >= len(text):
            break
        parts.append(text[start:at])
        start = at
    parts.append(text[start:])
    return parts


def token_ids(text: str | None, tokenizer_dir: str, vocabulary: str = VOCABULARY) -> np.ndarray:
    if not text:
        return np.empty(0, np.int32)
    encode = byte_bpe(tokenizer_dir, vocabulary).encode_to_numpy
    parts = [encode(p, disallowed_special=()) for p in safe_parts(text)]
    return (parts[0] if len(parts) == 1 else np.concatenate(parts)).astype(np.int32)


def encode_column(
    frame: DataFrame, keep: list[str], text: str = "text", tokenizer_dir: str = TOKENIZER_DIR, vocabulary: str = VOCABULARY
) -> DataFrame:
    """The ``keep`` columns and ``ids``, one row for each row; a map over partitions, no shuffle."""
    source = frame.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").alias("__text"))
    schema = T.StructType([*source.schema.fields[:-1], T.StructField("ids", T.ArrayType(T.IntegerType(), False))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            arrays = [token_ids(t, tokenizer_dir, vocabulary) for t in batch.column(batch.num_columns - 1).to_pylist()]
            offsets = np.zeros(len(arrays) + 1, np.int32)
            np.cumsum([a.size for a in arrays], out=offsets[1:])
            values = np.concatenate(arrays) if arrays else np.empty(0, np.int32)
            ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, pa.int32()), type=pa.list_(pa.field("element", pa.int32(), False)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], ids], names=[*keep, "ids"])

    return source.mapInArrow(run, schema)


def decode_column(frame: DataFrame, keep: list[str], ids: str = "ids", tokenizer_dir: str = TOKENIZER_DIR, vocabulary: str = VOCABULARY) -> DataFrame:
    """The inverse: ``keep`` columns and ``text``; null ids give null, an empty list the empty text."""
    source = frame.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{ids}`").alias("__ids"))
    schema = T.StructType([*source.schema.fields[:-1], T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = byte_bpe(tokenizer_dir, vocabulary)
        for batch in batches:
            lists = batch.column(batch.num_columns - 1).to_pylist()
            texts = [None if x is None else encoding.decode_bytes(x).decode("utf-8", "replace") for x in lists]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], names=[*keep, "text"])

    return source.mapInArrow(run, schema)


def count_tokens(frame: DataFrame, keep: list[str], text: str = "text", tokenizer_dir: str = TOKENIZER_DIR, vocabulary: str = VOCABULARY) -> DataFrame:
    """The ``keep`` columns and ``n_tokens``; the ids never leave the worker."""
    source = frame.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").alias("__text"))
    schema = T.StructType([*source.schema.fields[:-1], T.StructField("n_tokens", T.LongType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = [token_ids(t, tokenizer_dir, vocabulary).size for t in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sizes, pa.int64())], names=[*keep, "n_tokens"])

    return source.mapInArrow(run, schema)


def p6_ids(spark: SparkSession, directory: str) -> DataFrame:
    return encode_column(table(spark, directory, "documents"), ["doc_id"])


def p6_roundtrip(spark: SparkSession, directory: str) -> DataFrame:
    """Each document with its token count and whether decoding gives its text back."""
    documents = table(spark, directory, "documents").select("doc_id", "text")
    encoded = encode_column(documents, ["doc_id", "text"]).withColumnRenamed("text", "source_text")
    decoded = decode_column(encoded, ["doc_id", "source_text", "ids"])
    return decoded.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), (F.col("text") == F.coalesce("source_text", F.lit(""))).alias("exact"))
