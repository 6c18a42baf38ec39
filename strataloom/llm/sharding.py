"""Contiguous shards of nearly equal bytes by global prefix sums.

Rows are range-partitioned by ``doc_id`` (ties: text checksum, then size; null ids first) and sorted within each
partition. A pass over each partition numbers its rows and sums their bytes; only the totals, one row per partition, go
to the driver, which turns them into each partition's offset. A row belongs to the shard in which the middle of its
byte range lies, so a shard differs from the equal target by less than one row at either end. The texts themselves are
never shuffled.

A row counts its UTF-8 bytes plus 16; null text has none. Repeated rows are separate rows. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table


PART, ROW_AT, BYTE_AT = "__part", "__row_at", "__byte_at"


def numbered(rows: DataFrame, order: list, size: str) -> tuple[DataFrame, list]:
    """Adds __part, __row_at and __byte_at (offsets inside the part) in the global order; also (part, rows, bytes) of each
    part. Columns of ``rows`` with these names are replaced."""
    spark = rows.sparkSession
    rows = rows.drop(PART, ROW_AT, BYTE_AT)
    schema = rows.withColumns({PART: F.lit(0), ROW_AT: F.lit(0).cast("long"), BYTE_AT: F.lit(0).cast("long")}).schema

    def run(batches):
        part, n, total = TaskContext.get().partitionId(), 0, 0
        for b in batches:
            sizes = b.column(size).to_numpy(zero_copy_only=False).astype(np.int64)
            ends = total + np.cumsum(sizes)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(len(sizes), part, np.int32)), pa.array(n + np.arange(len(sizes), dtype=np.int64)), pa.array(ends - sizes)], [*b.schema.names, PART, ROW_AT, BYTE_AT])
            n, total = n + len(sizes), int(ends[-1]) if len(sizes) else total

    out = table(spark, rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, schema))
    return out, sorted(tuple(r) for r in out.groupBy(PART).agg(F.count("*"), F.sum(size)).collect())


def balanced_shards(docs: DataFrame, shards: int = 40, overhead: int = 16) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row of ``docs`` (doc_id, text)."""
    spark = docs.sparkSession
    raw = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    rows = docs.select(F.col("doc_id").cast("long"), (F.octet_length(raw) + F.lit(overhead)).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"))
    held, parts = numbered(rows, ["doc_id", "text_crc32", "size"], "size")
    total, before = sum(p[2] for p in parts), []
    n = size = 0
    for part, count, own in parts:
        before.append((part, n, size))
        n, size = n + count, size + own
    starts = spark.createDataFrame(before, f"{PART} int, rows_before long, bytes_before long")  # one row for each partition
    middle = (F.col("bytes_before") + F.col(BYTE_AT)) * 2 + F.col("size")
    shard = F.least(F.lit(shards - 1), F.floor(middle * shards / F.lit(max(2 * total, 1)))).cast("int")
    placed = held.join(F.broadcast(starts), PART).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), shard.alias("shard"), (F.col("rows_before") + F.col(ROW_AT)).alias("at"))
    firsts = placed.groupBy("shard").agg(F.min("at").alias("first"))  # at most one row for each shard
    return placed.join(F.broadcast(firsts), "shard").select("doc_id", "size", "text_crc32", "law", "shard", (F.col("at") - F.col("first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
