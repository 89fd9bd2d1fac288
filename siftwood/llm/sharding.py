"""Sharding by sampled splitters.

Records get the key (hash of the text, doc_id, a salt), so equal texts stand side
by side and the order of the rest is random. Size-weighted key samples give
quantile boundaries; records are dealt to ranges by them, and overfull ranges
(many copies of one text) are subdivided by the later parts of the key. The ranges
in which a shard is to end are subdivided until few records are left in them, so
that each shard ends at a splitter: its size differs from the mean by less than one
record at either end. A record's shard follows from its range, its slot from its
place in the range and the exact counts of the ranges before.

Law "bytes". Results: null text has size 16 and crc32 0; null doc_id comes first
among equal texts; rows that are wholly alike are told apart by the salt alone, so
each has a slot of its own; texts of any length count whole; an empty table gives
an empty table; assign_shards returns its own columns alone, and write_shards every
column of the rows (one named shard is replaced by the result, one named slot too).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import drop_stored, fixed, small_batches, stored, table
from .ranges import choose_splitters, count_ranges, exact_cuts, range_column

SHARDS, OVERHEAD = 40, 16
#: Records per range at most, about; ranges at least per shard, and in all at most.
RECORDS, PER_SHARD, MOST_RANGES = 250_000, 6, 16_384
LOWEST = -(1 << 63)
KEYS = ["key", "id", "salt"]


def _keys(text: Column, doc_id: Column) -> list[Column]:
    return [F.xxhash64(text).alias("key"), F.coalesce(doc_id.cast("long"), F.lit(LOWEST)).alias("id"), F.monotonically_increasing_id().alias("salt")]


def _placed(rows: DataFrame, shards: int) -> DataFrame:
    """rows (stored; size and KEYS among the columns) with shard and slot."""
    total, n = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    n_ranges = min(MOST_RANGES, max(PER_SHARD * shards, n // RECORDS))
    narrow = rows.select(*KEYS, "size")
    splitters, ranges = choose_splitters(narrow, KEYS, "size", n_ranges, total)
    cuts = exact_cuts(narrow, KEYS, "size", splitters, ranges, total, shards)
    splitters = sorted({*splitters, *cuts})
    shard, before, at = 0, 0, []
    for k, (_, count) in enumerate(count_ranges(narrow, KEYS, "size", splitters)):
        while shard < len(cuts) and k and splitters[k - 1] >= cuts[shard]:
            shard, before = shard + 1, 0
        at.append((k, shard, before))
        before += count
    offsets = F.broadcast(rows.sparkSession.createDataFrame(at, "range int, shard int, before long"))  # one row per range
    nth = F.row_number().over(Window.partitionBy("range").orderBy(*KEYS))
    placed = rows.withColumn("range", range_column([F.col(k) for k in KEYS], splitters)).withColumn("nth", nth).join(offsets, "range")
    return placed.withColumn("slot", F.col("before") + F.col("nth") - 1).drop("range", "nth", "before")


def assign_shards(docs: DataFrame, shards: int = SHARDS, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot (gapless from 0 in each shard), grown_shard (null under this law)."""
    t, d = F.col(f"`{text}`"), F.col(f"`{doc_id}`")
    size = (F.coalesce(F.octet_length(t), F.lit(0)) + OVERHEAD).cast("long").alias("size")
    rows = fixed(small_batches(docs).select(d.alias("doc_id"), size, F.crc32(F.coalesce(t, F.lit("")).cast("binary")).alias("text_crc32"), *_keys(t, d)))
    return _placed(rows, shards).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, text: str = "text", doc_id: str = "doc_id") -> None:
    """Writes all rows of docs, each once, as one folder per shard, rows by slot. Rows go with their records, so null and repeated ids do no harm."""
    t, d = F.col(f"`{text}`"), F.col(f"`{doc_id}`")
    size = (F.coalesce(F.octet_length(t), F.lit(0)) + OVERHEAD).cast("long").alias("size")
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    rows = stored(docs.select(whole, size, *_keys(t, d)), "records")
    kept = [F.col(f"row.`{c}`") for c in docs.columns if c.lower() not in ("shard", "slot")]
    placed = _placed(rows, shards).select(*kept, "shard", "slot")
    placed.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
    drop_stored(rows)


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_shards(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {"op1_sharding": op1}
