"""Length statistics, alone and against duplication."""

from __future__ import annotations

from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.operators.records import facts

#: Fixed value: lower edges of the half-open length buckets.
EDGES = (0, 32, 64, 128, 256, 512, 768, 1024, 1536, 2048, 4096, 8192, 16384)
PERCENTILES = (1, 5, 10, 25, 50, 75, 90, 95, 99, 99.9)


def token_counts(docs: DataFrame) -> DataFrame:
    """(doc_id, n_tokens): runs of other than ASCII white space."""
    return docs.select("doc_id", F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long").alias("n_tokens"))


def tokenizer_path(name: str, folder: str = "/opt/tokenizers") -> str:
    """The file of a tokenizer: an existing path as it is, else a file of that name in a folder."""
    for path in (Path(name), Path(folder) / name, Path(folder) / f"{name}.json"):
        if path.is_file():
            return str(path)
    raise FileNotFoundError(f"no tokenizer {name} in {folder}")


def tokenizer_counts(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens) under a tokenizer file, without special tokens; the driver reads the file."""
    with open(path, encoding="utf-8") as f:
        content = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks share the cores already
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_str(content.value)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts = [t or "" for t in part.column("text").to_pylist()]
                n = [len(e.ids) for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n, pa.int64())], names=["doc_id", "n_tokens"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long")


def overall(lengths: DataFrame) -> DataFrame:
    """Count, sum, mean, extremes and percentiles with linear interpolation, in one row."""
    at = F.percentile("n_tokens", F.array(*[F.lit(p / 100) for p in PERCENTILES]))
    rows = lengths.agg(F.count(F.lit(1)).alias("documents"), F.sum("n_tokens").alias("tokens"), F.avg("n_tokens").alias("mean"), F.median("n_tokens").alias("median"), F.min("n_tokens").alias("least"), F.max("n_tokens").alias("most"), at.alias("at"))
    return rows.select("*", *[F.get("at", F.lit(i)).alias(f"p{str(p).replace('.', '_')}") for i, p in enumerate(PERCENTILES)]).drop("at")


def bucket(n: Column) -> Column:
    """The lower edge of the bucket that holds a length."""
    out = F.lit(EDGES[0])
    for edge in EDGES[1:]:
        out = F.when(n >= edge, F.lit(edge)).otherwise(out)
    return out.cast("long")


def label(edge: Column) -> Column:
    out = None
    for low, high in zip(EDGES, (*EDGES[1:], None), strict=True):
        name = f"{low}-{high - 1}" if high else f"{low}+"
        out = F.when(edge == low, F.lit(name)) if out is None else out.when(edge == low, F.lit(name))
    return out


def _all_buckets(lengths: DataFrame) -> DataFrame:
    return lengths.sparkSession.createDataFrame([(e,) for e in EDGES], "bucket long")


def buckets(lengths: DataFrame) -> DataFrame:
    """Documents, their share and tokens of every bucket, empty ones included."""
    got = lengths.groupBy(bucket(F.col("n_tokens")).alias("bucket")).agg(F.count(F.lit(1)).alias("documents"), F.sum("n_tokens").alias("tokens"))
    total = got.agg(F.sum("documents").alias("total"))
    rows = F.broadcast(_all_buckets(lengths)).join(got, "bucket", "left").join(total)  # one row
    zero = F.lit(0).cast("long")
    return rows.select("bucket", label(F.col("bucket")).alias("label"), F.coalesce("documents", zero).alias("documents"), (F.coalesce("documents", zero) / F.greatest("total", F.lit(1))).alias("share"), F.coalesce("tokens", zero).alias("tokens"))


def histogram(lengths: DataFrame, width: int = 10, most: int = 0) -> DataFrame:
    """Bins of a fixed width up to the 90th percentile rounded up to 100 bins, or ``most``; the last takes the rest."""
    if not most:
        p90 = lengths.agg(F.percentile("n_tokens", 0.9)).first()[0] or 0
        most = max(1, -(-int(p90 + 0.999999) // (100 * width))) * 100 * width
    last = most // width - 1
    got = lengths.groupBy(F.least(F.floor(F.col("n_tokens") / width), F.lit(last)).cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("documents"))
    bins = lengths.sparkSession.range(last + 1).withColumnRenamed("id", "bin")
    return bins.join(got, "bin", "left").select("bin", (F.col("bin") * width).alias("low"), F.coalesce("documents", F.lit(0).cast("long")).alias("documents"))


def by_duplication(lengths: DataFrame, recorded: DataFrame) -> DataFrame:
    """For each length bucket that has documents: how many have an exact copy, and a near one at each threshold."""
    status = facts(recorded).select("doc_id", (F.col("n_exact") > 0).alias("exact"), "best")
    rows = lengths.join(status, "doc_id", "left").groupBy(bucket(F.col("n_tokens")).alias("bucket"))
    tiers = [F.count_if(F.col("best") >= F.lit(t).cast("float")).alias(f"near_{int(t * 100)}") for t in (0.7, 0.8, 0.9)]
    return rows.agg(F.count(F.lit(1)).alias("documents"), F.count_if("exact").alias("exact"), *tiers)


#: Inclusive bands of a document's number of duplicates.
DUP_BANDS = ((1, 1), (2, 4), (5, 9), (10, 99), (100, 999), (1000, None))


def by_duplicate_count(lengths: DataFrame, recorded: DataFrame, cap: int = 4001) -> DataFrame:
    """Nearest-rank quartiles of capped length by how many duplicates a document has."""
    n = (F.col("n_exact") + F.col("n_near")).cast("long")
    band = None
    for low, high in DUP_BANDS:
        test = (F.col("n_dup") >= low) & (F.col("n_dup") <= high) if high else F.col("n_dup") >= low
        name = str(low) if high == low else f"{low}-{high}" if high else f"{low}+"
        band = F.when(test, F.lit(name)) if band is None else band.when(test, F.lit(name))
    rows = recorded.select("doc_id", n.alias("n_dup")).join(lengths, "doc_id").withColumn("length", F.least("n_tokens", F.lit(cap)))
    at = [F.expr(f"percentile_disc({p}) within group (order by length)").cast("long").alias(k) for k, p in (("p25", 0.25), ("median", 0.5), ("p75", 0.75))]
    return rows.groupBy(band.alias("band")).agg(F.count(F.lit(1)).alias("documents"), *at)
