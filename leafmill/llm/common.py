"""What the text operators share: tables, shared scratch, token vocabularies and the gear hash."""

from __future__ import annotations

import base64
import os
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from leafmill.sources.scratch import cut_lineage  # noqa: F401

TOKENIZER_DIR = "/opt/tokenizers"

# Fixed value: the public pattern that splits text before byte pairs are merged.
BYTE_BPE_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{directory}/{name}.parquet")


@lru_cache(maxsize=4)
def byte_bpe(directory: str, name: str = "byte_bpe_50k"):
    """The tiktoken encoding of a local rank file; one per Python worker."""
    import tiktoken

    ranks = {}
    with open(os.path.join(directory, f"{name}.tiktoken"), "rb") as lines:
        for line in lines:
            token, rank = line.split()
            ranks[base64.b64decode(token)] = int(rank)
    return tiktoken.Encoding(name, pat_str=BYTE_BPE_PATTERN, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=2)
def gear_table(size: int = 4096, seed: int = 20_231) -> np.ndarray:
    """Random 32-bit words by code point modulo the size; the same on every worker."""
    return np.random.default_rng(seed).integers(0, 2**32, size, dtype=np.uint32)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def gear_hash(points: np.ndarray, window: int = 16) -> np.ndarray:
    """Rolling gear hash h[i] = sum of table[c[i-k]] << 2k over k < 16, for all i at once.

    Two bits a step let exactly 16 characters reach the 32-bit sum, so equal surroundings of
    16 characters give equal hashes wherever they stand. The sum over a window is built by
    doubling: log2(16) shifted additions instead of a loop over characters.
    """
    table_ = gear_table()
    h = table_[points & np.uint32(table_.size - 1)] ^ (points >> np.uint32(12))
    step = 1
    while step < window:
        shifted = h[:-step] << np.uint32(2 * step)
        h = h.copy()
        h[step:] += shifted
        step *= 2
    # mix, so that the order of hashes does not follow the last characters alone
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    h ^= h >> np.uint32(13)
    return h


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of values[i : i + width] for every full window, by doubling."""
    low, span = values, 1
    while span * 2 <= width:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    rest = width - span
    return np.minimum(low[: low.size - rest], low[rest:]) if rest else low


def local_minima(values: np.ndarray, width: int) -> np.ndarray:
    """Positions that are the (rightmost) minimum of at least one full window of the width.

    Every stretch of ``width`` values holds at least one, and which ones are chosen inside a
    stretch depends on the values of the windows inside it alone.
    """
    if values.size == 0:
        return np.empty(0, np.int64)
    width = min(width, values.size)
    keys = (values.astype(np.uint64) << np.uint64(32)) | (np.uint64(0xFFFFFFFF) - np.arange(values.size, dtype=np.uint64))
    low = sliding_min(keys, width)
    return np.unique((np.uint64(0xFFFFFFFF) - (low & np.uint64(0xFFFFFFFF))).astype(np.int64))
