"""File sources: inventories, whole texts with front matter, lists and JSON artifacts.

Spark passes over names that begin with a dot or underscore; ``list_files`` walks on the driver
where those matter, and is meant for folders, not for data.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.functions import text as X

# Leading bytes of audio files.
MAGIC = (("ID3", "audio/mpeg"), ("fLaC", "audio/flac"), ("OggS", "audio/ogg"), ("RIFF", "audio/wav"), ("FORM", "audio/aiff"), ("DSD ", "audio/dsf"))


def inventory(spark: SparkSession, folder: str, glob: str | None = None) -> DataFrame:
    """(path, name, ext, length) of all files below a folder; contents are never read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    files = (reader.option("pathGlobFilter", glob) if glob else reader).load(folder)
    name = X.file_name(F.col("path"))
    return files.select("path", name.alias("name"), X.extension(name).alias("ext"), F.col("length").cast("bigint").alias("length"))


def list_files(spark: SparkSession, folder: str, prune_hidden: bool = False) -> DataFrame:
    """As ``inventory``, with hidden names; with ``prune_hidden`` hidden folders and symbolic links are left out."""
    rows = []
    for root, folders, files in os.walk(folder, followlinks=False):
        if prune_hidden:
            folders[:] = [x for x in folders if not x.startswith(".")]
        for name in files:
            path = os.path.join(root, name)
            if not (prune_hidden and os.path.islink(path)):
                rows.append((path, name, os.path.splitext(name)[1].lower(), os.path.getsize(path) if os.path.exists(path) else None))
    return spark.createDataFrame(rows, "path string, name string, ext string, length bigint")


def expand_inputs(spark: SparkSession, path: str) -> DataFrame:
    """Files of a folder (dot-files dropped), a glob or a literal path, in natural order."""
    if os.path.isdir(path):
        found = [os.path.join(path, x) for x in os.listdir(path) if not x.startswith(".")]
    elif any(c in path for c in "*?["):
        import glob

        found = glob.glob(path)
    else:
        found = [path]
    files = spark.createDataFrame([(x,) for x in found if os.path.isfile(x)], "path string")
    return files.orderBy(X.natural_key(X.file_name(F.col("path"))), "path")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(path, front_matter, meta, text): whole files with a leading ``---`` block split off."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value"))
    block = F.regexp_extract("value", r"(?s)\A---\r?\n(.*?)\r?\n---[ \t]*(?:\r?\n|\z)", 1)
    pairs = F.filter(F.split(block, r"\r?\n"), lambda x: x.contains(":"))
    keys = F.transform(pairs, lambda x: F.trim(F.substring_index(x, ":", 1)))
    first = F.filter(pairs, lambda x: F.lit(True))
    values = F.transform(first, lambda x: F.trim(F.regexp_replace(x, r"^[^:]*:", "")))
    unique = F.filter(F.arrays_zip(keys.alias("k"), values.alias("v")), lambda z: z["k"] != "")
    meta = F.aggregate(unique, F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")), lambda acc, z: F.map_concat(F.map_filter(acc, lambda k, v: k != z["k"]), F.create_map(z["k"], z["v"])))
    return whole.select("path", block.alias("front_matter"), meta.alias("meta"), F.regexp_replace("value", r"(?s)\A---\r?\n.*?\r?\n---[ \t]*(?:\r?\n|\z)", "").alias("text"))


def list_entries(text: Column) -> Column:
    """The entries of a list's text, stripped, without blanks and ``#`` comments."""
    return F.filter(F.transform(F.split(text, "\\r?\\n"), lambda x: F.trim(x)), lambda x: (x != "") & ~F.startswith(x, F.lit("#")))


def read_list(spark: SparkSession, path: str) -> DataFrame:
    """Entries of a list file, without blanks and ``#`` comments."""
    value = F.trim("value")
    return spark.read.text(path).select(value.alias("entry")).filter((F.col("entry") != "") & ~F.startswith("entry", F.lit("#")))


PLAN_SCHEMA = "chunks array<struct<chunk_number:int,title:string,output_range:array<int>,contexts:array<array<int>>>>, complete boolean"


def read_plan(spark: SparkSession, path: str, keep: list[str] | None = None) -> DataFrame:
    """The chunks of JSON artifacts; ``keep`` names columns that the folders below the path stand for."""
    schema = ", ".join([PLAN_SCHEMA, *(f"`{c}` string" for c in keep or [])])
    return spark.read.schema(schema).json(path, multiLine=True).select(*(keep or []), F.explode("chunks").alias("c")).select(*(keep or []), "c.*")


def sniff_mime(head: Column) -> Column:
    """The type by a file's first bytes (as text in ISO-8859-1); null if unknown."""
    out = F.when(F.substring(head, 5, 4) == "ftyp", "audio/mp4").when(F.substring(head, 1, 1) == "ÿ", "audio/mpeg")
    for sign, mime in MAGIC:
        out = F.when(F.startswith(head, F.lit(sign)), mime).otherwise(out)
    return out


def known_duration(tagged: Column, probed: Column) -> Column:
    return F.coalesce(tagged, probed)
