import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.llm import topk


def brute(rows, k=20):
    known = [(i, np.floor(64 * np.array(v, np.float64)).astype(np.int64)) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(v).all()]
    size = max((len(v) for _, v in known), default=0)
    known = [(i, np.pad(v, (0, size - len(v)))) for i, v in known]
    out = {}
    for i, v in known:
        if i % 20 == 0:
            best = sorted((-int(v @ w), j) for j, w in known if j != i)[:k]
            out[i] = [(j, -s) for s, j in best]
    return out


def got(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        own = out.setdefault(r["query_id"], [])
        assert r["rank"] == len(own) + 1
        own.append((r["vec_id"], r["score"]))
    return out


SCHEMA = "vec_id long, embedding array<float>, bound string, pivot string, norm string"


@pytest.mark.parametrize("case", ["spread", "clustered", "hot"])
def test_as_brute_force(spark, case):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(8, 12))
    x = rng.normal(size=(700, 12)) if case == "spread" else centres[rng.integers(0, 8, 700)] + 0.05 * rng.normal(size=(700, 12))
    if case == "hot":
        x[::3] = x[0]
    rows = [(i, [float(np.float32(f)) for f in v]) for i, v in enumerate(x)]
    df = spark.createDataFrame([(*r, "", "", "") for r in rows], SCHEMA)
    assert got(topk.search(df, F.col("vec_id") % 20 == 0, count=8, block=32, met=20)) == brute(rows)


def test_expansion_skips_blocks(spark):
    rng = np.random.default_rng(4)
    centres = 20 * rng.normal(size=(10, 6))
    x = centres[rng.integers(0, 10, 2000)] + 0.01 * rng.normal(size=(2000, 6))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    rows = topk.materialize(topk.quantised(df, "vec_id", "embedding", 64.0), "v")
    index = topk.Index(rows, 10, 64)
    one = rows.where("vec_id = 0")
    best = sorted(int(v) for v in np.floor(64 * x)[1:] @ np.floor(64 * x[0]))[-20]
    pairs = index.pairs(index.chunks(one.withColumn("bound", F.lit(float(best))).withColumn("tie", F.lit(int(topk.LAST)))), 20, home=False)
    assert 0 < pairs.count() < len(index.directory)


def test_awkward_vectors(spark):
    rows = [(0, [1.0, 2.0]), (20, None), (40, [float("nan"), 1.0]), (60, [None, 1.0]), (None, [1.0, 1.0]), (1, [float("inf"), 0.0]), (2, [1.0, 2.0]), (3, [1.0, 2.0]), (80, [0.5]), (5, []), (100, [-1.0, 0.0])]
    df = spark.createDataFrame([(*r, "", "", "") for r in rows], SCHEMA)
    assert got(topk.search(df, F.col("vec_id") % 20 == 0)) == brute(rows)
    twice = df.unionByName(df.where("vec_id = 0"))
    assert [v for v, _ in got(topk.search(twice, F.col("vec_id") % 20 == 0))[0]] == [2, 3, 80, 5, 100]
    assert topk.search(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    large = spark.createDataFrame([(0, [1e30, 1.0]), (1, [1.0, 1.0]), (2, [-1e308, 0.0]), (20, [2.0, 0.0])], "vec_id long, embedding array<double>")
    most = int((2.0**62 / 2) ** 0.5)
    capped = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in topk.search(large, F.col("vec_id") % 20 == 0).collect()}
    assert capped == {(0, 1): (20, 128 * most), (0, 2): (1, 64 * most + 64 * 64), (0, 3): (2, -most * most), (20, 1): (0, 128 * most), (20, 2): (1, 128 * 64), (20, 3): (2, -128 * most)}
