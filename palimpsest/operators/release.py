"""Sorted, range-partitioned releases and their checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


#: Shards up to which their parts are broadcast; a row a shard.
BROADCAST_SHARDS = 1_000_000


def equal_parts(counts: DataFrame, parts: int = 32) -> DataFrame:
    """(shard, part): whole shards dealt into parts of about equal rows. ``counts`` has one row a shard."""
    order = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    total = counts.agg(F.sum("n_rows").alias("total"))
    before = counts.withColumn("before", F.coalesce(F.sum("n_rows").over(order), F.lit(0)))
    return before.join(total).select("shard", "n_rows", F.least(F.floor(F.col("before") * parts / F.greatest("total", F.lit(1))), F.lit(parts - 1)).cast("int").alias("part"))


def write(df: DataFrame, path: str, parts: int = 32, row_group_rows: int = 100_000, file_rows: int = 0) -> None:
    """Parts of about equal rows with disjoint, sorted id ranges, so that a lookup reads one row group.

    ``df`` has doc_id and shard. No part splits a shard. A part is a folder
    ``part=N`` of one file, or of consecutive files of ``file_rows`` rows.
    """
    dealt = equal_parts(rows_per_shard(df), parts).select("shard", "part")
    few = dealt.count() <= BROADCAST_SHARDS
    rows = df.join(F.broadcast(dealt) if few else dealt, "shard")
    ordered = rows.repartitionByRange(parts, "part").sortWithinPartitions("part", "doc_id")
    writer = ordered.write.mode("overwrite").option("compression", "zstd").option("parquet.block.row.count.limit", row_group_rows)
    (writer.option("maxRecordsPerFile", file_rows) if file_rows else writer).partitionBy("part").parquet(path)


def manifest(released: DataFrame) -> DataFrame:
    """First and last id and rows of each part."""
    return released.groupBy("part").agg(F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"), F.count(F.lit(1)).alias("n_rows"))


def overlaps(files: DataFrame) -> DataFrame:
    """Parts whose range begins before the one before it ends; there should be none."""
    order = Window.orderBy("first_id")  # one row a part
    return files.withColumn("before", F.lag("last_id").over(order)).where(F.col("before") >= F.col("first_id"))


def rows_per_shard(df: DataFrame) -> DataFrame:
    return df.groupBy("shard").agg(F.count(F.lit(1)).alias("n_rows"))


def checksum(df: DataFrame) -> DataFrame:
    """Rows and the sum of their hashes modulo 2**64: the same in any order of rows and columns.

    A row's hash is the first 60 bits of the MD5 of its columns as text, by
    name; nulls are left out of the text.
    """
    text = F.concat_ws("|", *[F.to_json(F.struct(c)) if t.startswith(("array", "map", "struct")) else F.col(c).cast("string") for c, t in sorted(df.dtypes)])
    hashed = F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("decimal(38,0)")
    total = F.pmod(F.sum(hashed), F.lit(str(2**64)).cast("decimal(38,0)"))
    return df.agg(F.count(F.lit(1)).alias("n_rows"), total.cast("string").alias("checksum"))


def difference(source: DataFrame, released: DataFrame) -> DataFrame:
    """Rows that only one side has, all of them."""
    return source.exceptAll(released).withColumn("side", F.lit("source")).unionByName(released.exceptAll(source).withColumn("side", F.lit("release")))
