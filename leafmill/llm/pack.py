"""Problem 7: documents packed into containers of a fixed capacity.

The packing is planned over the histogram of sizes, never over documents: the histogram has at
most ``capacity`` entries, so its collection to the driver and the plan's broadcast are bounded
by a parameter, whatever the number of documents. Best fit over counts: sizes are placed from
the largest down; all documents of a size that fit the fullest open kind of container are placed
at once. The plan is a list of runs ``(size, first rank, last rank, first container)``. A
document's place follows from its rank among documents of its size, and ranks are computed in
salted groups (rank within the salt plus the salts before it). A size has one salt for every
``ROWS_PER_SALT`` of its documents, so a size that a third of all documents have is spread over many
tasks, and what is broadcast has at most capacity + 1 + documents / ``ROWS_PER_SALT`` rows.

Defined results: an item larger than the capacity is divided into full pieces, each alone in its
container, and a remainder that is packed like any other item; no other item is divided. Items
of size zero (null or empty text) take no space and are spread over the containers by rank; if
there are no others, container 0 holds them. Repeated rows are separate items.
"""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafmill.llm.common import cut_lineage, table
from leafmill.llm.encode import count_tokens

CAPACITY = 2048
ROWS_PER_SALT = 200_000


def plan_runs(histogram: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Runs of a best-fit plan and the number of containers.

    A run says: the items of ``size`` with ranks lo..hi-1 go, ``per_container`` at a time, to the
    containers from container_lo on. ``open_kinds`` maps free space to ranges of like containers.
    """
    runs: list[tuple[int, int, int, int, int]] = []
    open_kinds: dict[int, list[tuple[int, int]]] = defaultdict(list)  # free space -> [(first container, how many)]
    spaces: list[int] = []  # the kinds in use, ascending

    def put(space: int, first: int, many: int) -> None:
        if space <= 0 or many <= 0:
            return
        if not open_kinds[space]:
            at = _bisect(spaces, space)
            if at == len(spaces) or spaces[at] != space:
                spaces.insert(at, space)
        open_kinds[space].append((first, many))

    total = 0
    for size in sorted((s for s in histogram if s > 0), reverse=True):
        left, rank = histogram[size], 0
        while left:
            at = _bisect(spaces, size)
            while at < len(spaces) and not open_kinds[spaces[at]]:
                spaces.pop(at)
            if at < len(spaces):
                space = spaces[at]
                first, many = open_kinds[space].pop()
                if not open_kinds[space]:
                    spaces.pop(at)
            else:
                space, first, many = capacity, total, -1
            each = min(space // size, left)
            wanted = left // each
            if many < 0:
                many = wanted
                total += many
            used = min(many, wanted)
            runs.append((size, rank, rank + used * each, first, each))
            rank += used * each
            left -= used * each
            put(space - each * size, first, used)
            put(space, first + used, many - used)
    return runs, total


def _bisect(ordered: list[int], value: int) -> int:
    low, high = 0, len(ordered)
    while low < high:
        middle = (low + high) // 2
        if ordered[middle] < value:
            low = middle + 1
        else:
            high = middle
    return low


def pack_items(sizes: DataFrame, item: str, size: str, capacity: int = CAPACITY, rows_per_salt: int = ROWS_PER_SALT) -> DataFrame:
    """Rows (item, piece_no, size, container_id) from rows (item, size).

    ``sizes`` is read two or three times; give it as a table or a checkpoint where it is dear to compute.
    """
    spark = sizes.sparkSession
    n = F.coalesce(F.col(f"`{size}`").cast("bigint"), F.lit(0))
    pieces = (
        sizes.select(F.col(f"`{item}`").alias("__item"), n.alias("__n"))
        .select(
            "__item",
            F.explode(
                F.when(F.col("__n") <= capacity, F.array(F.struct(F.lit(0).cast("bigint").alias("piece_no"), F.col("__n").alias("size")))).otherwise(
                    F.transform(
                        F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("__n") - 1) / capacity)),
                        lambda i: F.struct(i.alias("piece_no"), F.least(F.lit(capacity).cast("bigint"), F.col("__n") - i * capacity).alias("size")),
                    )
                )
            ).alias("p"),
        )
        .select("__item", "p.piece_no", "p.size")
    )
    by_size = {r["size"]: r["n"] for r in pieces.groupBy("size").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most capacity + 1 rows
    salts = {s: -(-n // rows_per_salt) for s, n in by_size.items()}
    hot = [s for s, k in salts.items() if k > 1]  # a size is hot from rows_per_salt documents on
    if hot:
        of_size = spark.createDataFrame([(s, salts[s]) for s in hot], "size bigint, salts bigint")
        salt = F.coalesce(F.pmod(F.xxhash64("__item", "piece_no"), F.col("salts")), F.lit(0).cast("bigint"))
        pieces = pieces.join(F.broadcast(of_size), "size", "left").withColumn("salt", salt).drop("salts")
        counted = pieces.filter(F.col("size").isin(hot)).groupBy("size", "salt").agg(F.count(F.lit(1)).alias("n")).collect()
    else:
        pieces, counted = pieces.withColumn("salt", F.lit(0).cast("bigint")), []
    before: dict[int, int] = defaultdict(int)
    offsets = []
    for row in sorted(counted, key=lambda r: (r["size"], r["salt"])):
        offsets.append((row["size"], row["salt"], before[row["size"]]))
        before[row["size"]] += row["n"]
    runs, total = plan_runs(by_size, capacity)
    grouped = defaultdict(list)
    for s, lo, hi, first, each in runs:
        grouped[s].append((lo, hi, first, each))
    offset_rows = spark.createDataFrame(offsets, "size bigint, salt bigint, before bigint")
    run_rows = spark.createDataFrame(
        [(s, [x[0] for x in g], g) for s, g in grouped.items()],
        "size bigint, los array<bigint>, runs array<struct<lo:bigint,hi:bigint,first:bigint,each:bigint>>",
    )
    ranked = (
        pieces.withColumn("rn", F.row_number().over(Window.partitionBy("size", "salt").orderBy("__item", "piece_no")) - 1)
        .join(F.broadcast(offset_rows), ["size", "salt"], "left")
        .withColumn("rank", F.coalesce("before", F.lit(0)) + F.col("rn"))
        .join(F.broadcast(run_rows), "size", "left")
    )
    at = F.get("runs", F.size(F.filter("los", lambda lo: lo <= F.col("rank"))) - 1)
    container = F.when(F.col("size") == 0, F.col("rank") % max(total, 1)).otherwise(at["first"] + F.floor((F.col("rank") - at["lo"]) / at["each"]))
    return ranked.select(F.col("__item").alias(item), "piece_no", "size", container.cast("bigint").alias("container_id"))


def p7_packed(spark: SparkSession, directory: str) -> DataFrame:
    """Every document's pieces with the container each was assigned to."""
    counted = count_tokens(table(spark, directory, "documents"), ["doc_id"])
    return pack_items(cut_lineage(counted), "doc_id", "n_tokens")


def p7_fill(spark: SparkSession, directory: str) -> DataFrame:
    """How many containers were used and how much of them is filled."""
    packed = p7_packed(spark, directory)
    per = packed.groupBy("container_id").agg(F.sum("size").alias("used"))
    return per.agg(
        F.count(F.lit(1)).alias("containers"),
        F.sum("used").alias("tokens"),
        F.max("used").alias("fullest"),
        F.ceil(F.sum("used") / F.lit(CAPACITY)).cast("bigint").alias("lower_bound"),
        (F.sum("used") / (F.count(F.lit(1)) * CAPACITY)).alias("filled"),
    )
