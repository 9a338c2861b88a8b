"""Images that texts refer to by address: addresses, names after their content, and texts with the names put in.

Addresses are fetched once each, in Python workers, by a function that is given; the texts are
joined with what was fetched, so a text with an image that could not be fetched stays as it is there.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: how an image is written in HTML or Markdown.
IMAGE_LINK = r'(?d)<img src="(.*?)".*>|!\[[^\[\]\\]*?\]\((.*?)\)'


def image_addresses(text: Column) -> Column:
    """The addresses of a text's images on the web, in order; null and empty texts have none."""
    both = F.arrays_zip(F.regexp_extract_all(text, F.lit(IMAGE_LINK), F.lit(1)).alias("a"), F.regexp_extract_all(text, F.lit(IMAGE_LINK), F.lit(2)).alias("b"))
    found = F.transform(both, lambda z: F.trim(F.when(z["a"] != "", z["a"]).otherwise(z["b"])))
    return F.coalesce(F.filter(found, lambda x: F.startswith(x, F.lit("http"))), F.array().cast("array<string>"))


def image_name(digest: Column, address: Column) -> Column:
    """``image_`` and the first four digits of the content's MD5, with the address's extension."""
    return F.concat(F.lit("image_"), F.substring(digest, 1, 4), F.trim(F.regexp_extract(address, r"(?<=[^/])(\.[^./]*)$", 1)))


def fetch_images(addresses: DataFrame, address: str, fetch: Callable[[str], bytes | None]) -> DataFrame:
    """(address, name, content) of the distinct addresses for which ``fetch`` gives bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [(a, c) for a in batch.column(0).to_pylist() if a and (c := fetch(a)) is not None]
            columns = [pa.array([a for a, _ in got], pa.string()), pa.array([hashlib.md5(c).hexdigest() for _, c in got], pa.string()), pa.array([c for _, c in got], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["address", "digest", "content"])

    fetched = addresses.select(F.col(address).alias("address")).distinct().mapInArrow(run, "address string, digest string, content binary")
    return fetched.select("address", image_name(F.col("digest"), F.col("address")).alias("name"), "content")


def rewrite_links(documents: DataFrame, key: str, text: str, names: DataFrame, folder: str) -> DataFrame:
    """(key, text): every occurrence of a fetched address replaced by ``folder``/name, one address after the other in their order.

    ``names`` has the columns (address, name). The texts are not shuffled for it but by their key.
    """
    asked = documents.select(key, F.posexplode(image_addresses(F.col(text))).alias("at", "address"))
    found = asked.join(names.select("address", "name"), "address").groupBy(key).agg(F.array_sort(F.collect_list(F.struct("at", "address", "name"))).alias("__names"))
    put = F.aggregate("__names", F.col(text), lambda acc, x: F.replace(acc, x["address"], F.concat(F.lit(folder.rstrip("/") + "/"), x["name"])))
    return documents.select(key, text).join(found, key, "left").select(key, F.when(F.col("__names").isNull(), F.col(text)).otherwise(put).alias(text))
