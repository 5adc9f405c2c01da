"""Corpus readers: numbered shards, manifests, JSON artifacts, lookups."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.functions.text import shard_name

ROWS_PER_SHARD = 99_999


def read_shards(spark: SparkSession, path: str, limit_shards: int | None = None, column: str = "text") -> DataFrame:
    """(doc_id, shard, row, text) of files ``shard_NNNNN.parquet``; the number in the name counts, not the listing's order."""
    raw = spark.read.parquet(path).select(
        F.regexp_extract("_metadata.file_name", r"shard_(\d+)\.parquet$", 1).alias("number"), F.col("_metadata.row_index").alias("row"), F.col(column).alias("text")
    )
    known = raw.where(F.col("number") != "").select(F.col("number").cast("int").alias("shard"), "row", "text")
    known = known if limit_shards is None else known.where(F.col("shard") < limit_shards)
    return known.select(shard_name(F.col("shard"), F.col("row")).alias("doc_id"), "shard", "row", "text")


def with_rows(docs: DataFrame, per_shard: int = 1000) -> DataFrame:
    """Numbered documents as shards of ``per_shard`` ids."""
    return docs.withColumn("shard", F.floor(F.col("doc_id") / per_shard).cast("long")).withColumn("row", F.pmod("doc_id", F.lit(per_shard)).cast("long"))


def manifest(docs: DataFrame, most: int = ROWS_PER_SHARD) -> DataFrame:
    """Rows of each shard and the rows before it; a shard with too many rows is an error."""
    counts = docs.groupBy("shard").agg(F.count(F.lit(1)).alias("n_rows"))
    checked = F.when(F.col("n_rows") > most, F.raise_error(F.concat(F.lit("too many rows in shard "), F.col("shard").cast("string")))).otherwise(F.col("n_rows"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row a shard
    return counts.select("shard", checked.cast("long").alias("n_rows")).withColumn("offset", F.coalesce(F.sum("n_rows").over(before), F.lit(0)).cast("long"))


def manifest_stats(docs: DataFrame) -> DataFrame:
    return manifest(docs).agg(F.count(F.lit(1)).alias("n_shards"), F.sum("n_rows").alias("total_rows"), F.max("n_rows").alias("max_rows_per_shard"))


def checked(df: DataFrame, rows: int) -> DataFrame:
    """The rows, if there are as many as a manifest says."""
    n = df.count()
    if n != rows:
        raise ValueError(f"{n} rows, but the manifest has {rows}")
    return df


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def read_json_files(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """One JSON document a file, with the file's name."""
    return spark.read.schema(schema).option("multiLine", True).json(path).withColumn("file_name", F.col("_metadata.file_name"))


def needle_counts(lines: DataFrame, column: str, needles: list[str]) -> DataFrame:
    """How often each needle stands in a text column, without overlaps."""
    counts = [F.sum((F.length(column) - F.length(F.replace(F.col(column), F.lit(n)))) / len(n)).cast("long").alias(f"n{i}") for i, n in enumerate(needles)]
    rows = lines.agg(*counts)
    return rows.select(F.explode(F.array(*[F.struct(F.lit(n).alias("needle"), F.coalesce(f"n{i}", F.lit(0)).alias("count")) for i, n in enumerate(needles)])).alias("x")).select("x.*")


def fetch(wanted: DataFrame, corpus: DataFrame, cache: DataFrame | None = None) -> DataFrame:
    """Texts of wanted ids, with ``cached``, ``fetched``, ``not-found`` or ``error`` (known, but without a text); nothing is dropped."""
    rows = wanted.select("doc_id").distinct()
    held = rows.sparkSession.createDataFrame([], corpus.select("doc_id", "text").schema) if cache is None else cache.select("doc_id", "text")
    held = held.dropDuplicates(["doc_id"]).withColumnsRenamed({"doc_id": "held", "text": "old"})
    fresh = corpus.select(F.col("doc_id").alias("found"), "text")
    both = rows.join(held, rows["doc_id"] == held["held"], "left").join(fresh, rows["doc_id"] == fresh["found"], "left")
    status = F.when(F.col("held").isNotNull(), "cached").when(F.col("found").isNull(), "not-found").when(F.col("text").isNull(), "error").otherwise("fetched")
    return both.select("doc_id", F.when(F.col("held").isNotNull(), F.col("old")).otherwise(F.col("text")).alias("text"), status.alias("status"))


def fetch_by(wanted: DataFrame, one: Callable[[object], str | None], cache: DataFrame | None = None) -> DataFrame:
    """``fetch`` by a function (such as one that runs a command) for ids that the cache lacks; what it raises is an ``error`` row."""
    rows = wanted.select("doc_id").distinct()
    todo = rows if cache is None else rows.join(cache.select("doc_id"), "doc_id", "left_anti")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, status = [], []
            for key in batch.column("doc_id").to_pylist():
                try:
                    texts.append(one(key))
                    status.append("not-found" if texts[-1] is None else "fetched")
                except Exception:  # noqa: BLE001  one document never stops the others
                    texts.append(None)
                    status.append("error")
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string()), pa.array(status, pa.string())], names=["doc_id", "text", "status"])

    kind = dict(rows.dtypes)["doc_id"]
    got = todo.mapInArrow(run, f"doc_id {kind}, text string, status string")
    if cache is None:
        return got
    return got.unionByName(rows.join(cache.select("doc_id", "text").dropDuplicates(["doc_id"]), "doc_id").withColumn("status", F.lit("cached")))


def select_ids(docs: DataFrame, ids: list | DataFrame) -> DataFrame:
    """Rows with given ids: a short list is pushed down to the scan, a table is a semi join."""
    if isinstance(ids, list):
        return docs.where(F.col("doc_id").isin(ids))
    return docs.join(ids.select("doc_id").distinct(), "doc_id", "left_semi")


def sample(docs: DataFrame, fraction: float, seed: int) -> DataFrame:
    """A seeded sample that depends on ids alone: the first 32 bits of an MD5 draw."""
    draw = F.conv(F.substring(F.md5(F.concat(F.col("doc_id").cast("string"), F.lit(f":{seed}"))), 1, 8), 16, 10).cast("long")
    return docs.where(draw < int(fraction * 2**32))


def slice_rows(rows: DataFrame, order: list[Column | str], low: int, high: int) -> DataFrame:
    """The rows at places ``low`` to ``high`` (exclusive) of an order."""
    return rows.orderBy(*order).offset(low).limit(high - low)


def numbered(rows: DataFrame, order: list[Column]) -> DataFrame:
    """Rows with their ``place`` (from 1) in an order; for short lists."""
    return rows.withColumn("place", F.row_number().over(Window.orderBy(*order)).cast("long"))
