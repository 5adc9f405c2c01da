"""Writers. Spark's committer makes each output appear whole or not at all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_json(df: DataFrame, path: str, partition_by: str | None = None) -> None:
    """JSON lines, such as groups, clusters by threshold, or a one-row report."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(partition_by) if partition_by else writer).json(path)


def write_shards(df: DataFrame, path: str) -> None:
    """Files ``shard_NNNNN.parquet`` with a shard's documents by id. ``df`` has shard and doc_id; other columns go along.

    Spark writes one file a shard; the driver renames them, one call a file.
    """
    raw = f"{path}/raw"
    ordered = df.repartitionByRange("shard").sortWithinPartitions("shard", "doc_id")
    ordered.write.mode("errorifexists").partitionBy("shard").parquet(raw)
    jvm = df.sparkSession.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(raw)
    files = root.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration())
    for folder in files.listStatus(root):
        name = folder.getPath().getName()
        if name.startswith("shard="):
            parts = [f.getPath() for f in files.listStatus(folder.getPath()) if f.getPath().getName().endswith(".parquet")]
            if len(parts) != 1:
                raise ValueError(f"{len(parts)} files for {name}")
            files.rename(parts[0], jvm.org.apache.hadoop.fs.Path(f"{path}/shard_{int(name.removeprefix('shard=')):05d}.parquet"))
    files.delete(root, True)


def write_lines(df: DataFrame, column: str, path: str) -> None:
    """A column as text, one value a line, such as a drop list."""
    df.select(F.col(column).cast("string")).write.mode("overwrite").text(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_records(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)


def write_groups(groups: DataFrame, path: str, failures_path: str) -> None:
    """Verified groups, and apart from them the failures."""
    write_json(groups.where("ok").drop("ok"), path)
    write_json(groups.where("not ok").drop("ok"), failures_path)


def markdown_rows(df: DataFrame, columns: dict[str, int | None]) -> DataFrame:
    """One line of a Markdown table a row: no pipes or line breaks, and texts cut to a width."""

    def cell(name: str, width: int | None) -> Column:
        text = F.translate(F.translate(F.coalesce(F.col(name).cast("string"), F.lit("")), "|", " "), "\n", " ")
        return F.substring(text, 1, width) if width else text

    return df.select(F.concat(F.lit("| "), F.concat_ws(" | ", *[cell(n, w) for n, w in columns.items()]), F.lit(" |")).alias("line"))


def worksheet(pending: DataFrame, most: int = 4500) -> DataFrame:
    """Pending rows with the start of their text, its length, and whether it was cut."""
    return pending.withColumn("n_chars", F.length("text")).withColumn("truncated", F.length("text") > most).withColumn("text", F.substring("text", 1, most))
