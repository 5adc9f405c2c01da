import numpy as np
from pyspark.sql import functions as F

import __spark_entry__
from palimpsest.functions import text as T
from palimpsest.operators import dedup_stats, lengths


def test_lengths(spark):
    n = [0, 5, 31, 32, 700, 20_000, 15, 15]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(n)], "doc_id long, n_tokens long")
    got = lengths.overall(rows).first()
    assert got["tokens"] == sum(n) and got["median"] == np.median(n) and abs(got["p90"] - np.percentile(n, 90)) < 1e-9
    table = {r["label"]: r["documents"] for r in lengths.buckets(rows).collect()}
    assert len(table) == len(lengths.EDGES) and (table["0-31"], table["32-63"], table["16384+"], table["64-127"]) == (5, 1, 1, 0)
    bins = lengths.histogram(rows, 10, 100).orderBy("bin").collect()
    assert [b["documents"] for b in bins] == [2, 2, 0, 2, 0, 0, 0, 0, 0, 2]


def test_token_counts(spark):
    rows = spark.createDataFrame([(1, "a b\tc\n"), (2, None), (3, "")], "doc_id long, text string")
    assert {r["doc_id"]: r["n_tokens"] for r in lengths.token_counts(rows).collect()} == {1: 3, 2: 0, 3: 0}


def test_tokenizer_counts(spark):
    import public_tokenizers

    rows = spark.createDataFrame([(1, "hello world"), (2, None)], "doc_id long, text string")
    assert {r["doc_id"]: r["n_tokens"] for r in lengths.tokenizer_counts(rows, public_tokenizers.path("byte_bpe_50k.json")).collect()} == {1: 2, 2: 0}


def test_retention(spark):
    rows = spark.createDataFrame([(i, 10 if i else 3) for i in range(10)], "doc_id long, n_tokens long")
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "doc_id long")
    kept = dedup_stats.retention(rows, ids(1, 2), {0.9: ids(2, 3), 0.7: ids(3, 4, 5)})
    got = {r["step"]: (r["removed_docs"], r["removed_tokens"], r["short_docs"], r["retained_docs"]) for r in kept.collect()}
    assert got == {"exact": (2, 20, 1, 7), "near_90": (3, 30, 1, 6), "near_70": (5, 50, 1, 4)}
    slices = {r["step"]: r["added_docs"] for r in dedup_stats.removable_slices(kept).collect()}
    assert slices == {"exact": 2, "near_90": 1, "near_70": 2}


def test_bands(spark):
    rows = spark.range(1, 6).select(T.bucket_label(F.col("id"), [(1, 1), (2, 4), (5, None)]).alias("b"), T.human_bytes(F.lit(1_500_000)).alias("h"))
    assert [r["b"] for r in rows.collect()] == ["1", "2-4", "2-4", "2-4", "5+"] and rows.first()["h"] == "1.5 MB"


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 10
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
