import os

from pyspark.sql import functions as F

from palimpsest.functions import text as T
from palimpsest.operators import exact
from palimpsest.sources import corpus as sources
from palimpsest.sources import sinks, tables
from tests.corpora import exact_rows

GROUPS = {(3, 117, 360, 499): 29, (50, 250): 13, (105, 106, 107): 22}


def docs(spark):
    return spark.createDataFrame(exact_rows(), "doc_id long, text string")


def test_planted_groups(spark):
    found = exact.exact_groups(exact.scan(docs(spark))).collect()
    assert {tuple(r["doc_ids"]): r["length"] for r in found} == GROUPS


def test_totals_and_checks(spark):
    sizes = exact.group_sizes(exact.scan(docs(spark)))
    t = exact.duplicate_totals(sizes).first()
    assert (t["total_docs"], t["distinct_hashes"], t["n_groups"], t["docs_in_groups"], t["redundant_docs"], t["largest_group"]) == (500, 494, 3, 9, 6, 4)
    assert all(exact.reconcile(docs(spark)).first())


def test_every_id_once(spark):
    scanned = exact.scan(docs(spark))
    for rows in (exact.length_map(scanned), exact.hash_groups(scanned)):
        ids = [i for r in rows.collect() for i in r["doc_ids"]]
        assert sorted(ids) == list(range(500))


def test_verify_finds_nothing_wrong(spark):
    rows = exact.verify(docs(spark)).collect()
    assert len(rows) == 3 and all(r["ok"] and r["content_mismatch"] == [] for r in rows)


def test_representatives_and_copies(spark):
    scanned = exact.scan(docs(spark))
    copies = {r["doc_id"]: r["rep_id"] for r in exact.excluded_copies(scanned).collect()}
    assert copies == {117: 3, 360: 3, 499: 3, 250: 50, 106: 105, 107: 105}
    assert exact.representatives(scanned).count() == 494


def test_white_space_and_nulls(spark):
    rows = [(1, None), (2, ""), (3, " 　\x1c"), (4, " a "), (5, "a")]
    found = {r["doc_id"]: (r["char_len"], r["sha256"]) for r in exact.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found[1] == found[2] == found[3] and found[1][0] == 0
    assert found[4] == found[5] and found[4][0] == 1
    assert sorted(T.WHITE) == [c for c in map(chr, range(0x110000)) if c.isspace()]


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert exact.exact_groups(exact.scan(none)).count() == 0


def test_brute_force(spark):
    rows = exact.brute_force_counts(docs(spark)).collect()
    assert {r["rep_id"]: (r["hash_count"], r["raw_count"], r["stripped_count"]) for r in rows} == {3: (4, 1, 4), 50: (2, 1, 2), 105: (3, 1, 3)}


def test_names(spark):
    df = spark.createDataFrame([(7,), (12_034,)], "doc_id long").select("doc_id", T.doc_name(F.col("doc_id")).alias("n"))
    rows = df.select("n", T.unpadded(F.col("n")), T.padded(T.unpadded(F.col("n"))), T.packed(F.col("n")), T.is_full_id(F.col("n"))).collect()
    assert [tuple(r) for r in rows] == [("shard_00000_00007", "shard_00000_7", "shard_00000_00007", 7, True), ("shard_00012_00034", "shard_00012_34", "shard_00012_00034", 1_200_034, True)]


def test_shards(spark, tmp_path):
    for s in (0, 2):
        spark.createDataFrame([(f"t{s}{i}",) for i in range(3)], "text string").coalesce(1).write.parquet(str(tmp_path / f"x{s}"))
        part = next((tmp_path / f"x{s}").glob("part-*.parquet"))
        (tmp_path / "corpus").mkdir(exist_ok=True)
        part.rename(tmp_path / "corpus" / f"shard_{s:05d}.parquet")
    docs = sources.read_shards(spark, str(tmp_path / "corpus"))
    assert sorted((r["doc_id"], r["text"]) for r in docs.collect())[3] == ("shard_00002_00000", "t20")
    assert [tuple(r) for r in sources.manifest(docs).orderBy("shard").collect()] == [(0, 3, 0), (2, 3, 3)]
    assert sources.read_shards(spark, str(tmp_path / "corpus"), limit_shards=1).count() == 3
    fetched = {r["doc_id"]: r["status"] for r in sources.fetch(spark.createDataFrame([("shard_00000_00001",), ("gone",)], "doc_id string"), docs).collect()}
    assert fetched == {"shard_00000_00001": "fetched", "gone": "not-found"}


def test_shards_keep_their_names(spark, tmp_path):
    rows = spark.range(250).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), F.col("id").cast("string")).alias("text"))
    sinks.write_shards(sources.with_rows(rows, 100).select("shard", "doc_id", "text"), str(tmp_path / "s"))
    assert sorted(p.name for p in (tmp_path / "s").glob("*.parquet")) == [f"shard_0000{i}.parquet" for i in range(3)]
    got = {r["doc_id"]: r["text"] for r in sources.read_shards(spark, str(tmp_path / "s")).collect()}
    assert got == {f"shard_{i // 100:05d}_{i % 100:05d}": f"t{i}" for i in range(250)}
    assert sources.read_shards(spark, str(tmp_path / "s"), limit_shards=1).count() == 100


def test_fetching_never_stops(spark):
    corpus = spark.createDataFrame([(1, "a"), (2, None), (3, "c")], "doc_id long, text string")
    wanted = spark.createDataFrame([(1,), (2,), (3,), (9,), (1,)], "doc_id long")
    cache = spark.createDataFrame([(3, "old")], "doc_id long, text string")
    want = {1: ("a", "fetched"), 2: (None, "error"), 3: ("old", "cached"), 9: (None, "not-found")}
    assert {r["doc_id"]: (r["text"], r["status"]) for r in sources.fetch(wanted, corpus, cache).collect()} == want

    def one(key):
        return {1: "a"}[key] if key < 5 else None

    assert {r["doc_id"]: (r["text"], r["status"]) for r in sources.fetch_by(wanted, one, cache).collect()} == want


def test_intermediate_tables_are_deleted(spark):
    with tables.workspace(spark) as kept:
        a, b = (tables.materialize(spark.range(n).toDF("x"), "t") for n in (3, 4))
        kept.append(b)
    assert b.count() == 4 and not [f for f in a.inputFiles() if os.path.exists(f.removeprefix("file://"))]
    tables.discard(b)
    assert not [f for f in b.inputFiles() if os.path.exists(f.removeprefix("file://"))]
    assert tables.unused(spark.range(1).toDF("_A"), "_a") == "__a"


def test_lists_of_hot_keys_are_cut(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "a"), (exact.SPAN + 5, " a "), (3, "bb")], "doc_id long, text string")
    scanned = exact.scan(rows)
    assert sorted((r["count"], r["chunk"], tuple(r["doc_ids"])) for r in exact.exact_groups(scanned).collect()) == [(3, 0, (1, 2)), (3, 1, (exact.SPAN + 5,))]
    assert sorted((r["char_len"], r["chunk"], r["n_docs"]) for r in exact.length_map(scanned).collect()) == [(1, 0, 2), (1, 1, 1), (2, 0, 1)]
    assert exact.hash_groups(scanned).count() == 3
