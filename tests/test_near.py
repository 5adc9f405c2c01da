import random

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from palimpsest.functions.shingles import gram_sets
from palimpsest.operators import cliques, components, dedup_stats, exact, minhash, records, release, similarity
from palimpsest.sources import sinks
from tests.corpora import near_rows, record_rows, words


def frame(spark, rows):
    return spark.createDataFrame(sorted(rows.items()), "doc_id long, text string")


@pytest.fixture(scope="module")
def near(spark):
    docs = frame(spark, near_rows())
    return docs, *similarity.edges(docs)


def test_pairs(near):
    got = {(r["a"], r["b"]): r["jaccard"] for r in near[2].collect()}
    want = {(5, 1020): 0.966997, (5, 2040): 0.966997, (1020, 2040): 0.935065, (5, 3060): 0.806061, (1020, 3060): 0.779104, (2040, 3060): 0.779104, (90, 1100): 0.874214, (1100, 2110): 0.8625, (90, 2110): 0.752941}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 for k in want)


@pytest.mark.parametrize(
    ("t", "want"),
    [
        (0.7, {(5, 1020, 2040, 3060): (0.7791, 0.8722), (90, 1100, 2110): (0.7529, 0.8299)}),
        (0.8, {(5, 1020, 2040): (0.9351, 0.9564), (90, 1100): (0.8742, 0.8742)}),
        (0.9, {(5, 1020, 2040): (0.9351, 0.9564)}),
    ],
)
def test_cliques(near, t, want):
    found = cliques.clusters(cliques.partition(near[2], t), near[2])
    assert {tuple(r["doc_ids"]): (round(r["min_jaccard"], 4), round(r["mean_jaccard"], 4)) for r in found.collect()} == want
    checks = cliques.check(found, t).first()
    assert checks["violations"] == checks["incomplete"] == 0


def test_candidates_hold_the_pairs(near):
    links = minhash.gated_links(minhash.signed_bands(near[1], 73, 7))
    labels = {r["vertex"]: r["component"] for r in components.connected_components(links).collect()}
    assert all(labels[r["a"]] == labels[r["b"]] for r in near[2].collect())
    assert {(r["a"], r["b"]) for r in similarity.verified(links, near[1], 0.7).collect()} >= {(5, 1020), (5, 2040), (90, 1100)}


def test_pairs_of_a_large_group(spark):
    # buckets of more than 16 members link each member with the smallest alone
    rows = {i: words("g", {range(6 * i, 6 * i + 3): f"x{i}q"}) for i in range(60)} | {100 + i: words("h", {range(30 * i, 30 * i + 25): "x"}) for i in range(20)} | {200: words("z")}
    sets = similarity.materialize(similarity.representative_sets(frame(spark, rows)), "sets")
    want = {(r["a"], r["b"]): r["jaccard"] for r in similarity.near_pairs(sets).collect()}
    labelled = cliques.components(minhash.gated_links(minhash.signed_bands(sets, 73, 7)))
    assert len(want) >= 60 * 59 // 2
    for weight in (similarity.WEIGHT, 4_000):
        got = similarity.pairs_within(labelled, sets, 0.7, weight).collect()
        assert len(got) == len(want) and {(r["a"], r["b"]): r["jaccard"] for r in got} == want


def test_pairs_that_meet_in_no_band(spark, tmp_path):
    # 1,500 pairs that share 70 of 100 n-grams: banding alone loses some two in 1,000
    rows = {2 * i + j: words(f"p{i}q", {range(30, 41): "x"} if j else {}, 89) for i in range(1500) for j in (0, 1)} | {5000 + i: None if i else "a b" for i in range(2)}
    frame(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    sets = similarity.materialize(gram_sets(frame(spark, rows)), "sets")
    labelled = cliques.components(minhash.gated_links(minhash.signed_bands(sets, 73, 7)))
    assert similarity.pairs_within(labelled, sets, 0.7).count() < 1500
    got = sorted(map(tuple, __spark_entry__.queries()["lsh_near_pairs"](spark, str(tmp_path)).collect()))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert got == sorted(con.execute(__spark_entry__.oracle_sql()["lsh_near_pairs"]).fetchall()) and len(got) == 1500


def test_pairs_across_components(spark):
    # pairs in any split of the documents are either within components or across them
    rng = random.Random(17)
    rows = {i: words("g", {range(6 * i, 6 * i + 3): f"x{i}q"}) for i in range(40)} | {100 + i: words("h", {range(30 * i, 30 * i + 25): "x"}) for i in range(20)}
    rows |= {200 + 2 * i + j: words(f"p{i}q", {range(30, 30 + k): "x"} if j else {}, 89 - (k if j else 0)) for i, k in enumerate(range(24)) for j in (0, 1)} | {300: None, 301: "a b c d e", 302: "A b c d e!", 303: "a b c d e f"}
    sets = similarity.materialize(gram_sets(frame(spark, rows)), "sets")
    want = {(r["a"], r["b"]): r["jaccard"] for r in similarity.near_pairs(sets).collect()}
    for most in (1, 3, 30):
        group = {i: rng.randrange(most) for i in rows if rng.random() < 0.8}
        least = {g: min(i for i in group if group[i] == g) for g in set(group.values())}
        labelled = spark.createDataFrame([(i, least[g]) for i, g in group.items()], "doc_id long, component long")
        got = [tuple(r) for r in similarity.pairs_across(labelled, sets, 0.7).collect()]
        across = {p: j for p, j in want.items() if group.get(p[0], -1) != group.get(p[1], -2)}
        assert across and len(got) == len(across) and {(a, b): j for a, b, j in got} == across


def test_copies_have_no_cluster(near):
    members = {r["doc_id"] for r in cliques.partition(near[2], 0.7).collect()}
    assert not members & {130, 3120}


def test_records(spark):
    docs = frame(spark, record_rows())
    _, edges = similarity.edges(docs)
    found = records.records(edges, exact.members(exact.scan(docs)))
    got = {r["doc_id"]: (r["exact_duplicates"], [(x["doc_id"], round(x["jaccard"], 4)) for x in r["near_duplicates"]]) for r in found.collect()}
    assert got == {
        10: ([], [(1020, 0.9605), (30, 0.9541), (2040, 0.9541)]),
        1020: ([], [(10, 0.9605), (30, 0.9164), (2040, 0.9164)]),
        30: ([2040], [(10, 0.9541), (1020, 0.9164)]),
        2040: ([30], [(10, 0.9541), (1020, 0.9164)]),
    }
    assert records.overlap(found).first()[0] == 0
    assert [x["doc_id"] for x in records.neighbours(found, 10, 0.96).first()["near_duplicates"]] == [1020]
    tiers = {r["tier"]: r["documents"] for r in dedup_stats.composition(found, docs.count()).collect()}
    assert tiers == {"exact": 2, "near_90": 2, "near_80": 0, "near_70": 0, "none": 5}


def test_greedy_cliques_are_cliques():
    rng = random.Random(3)
    for _ in range(200):
        n = rng.randint(2, 24)
        links = {i: set() for i in range(n)}
        for i in range(n):
            for j in range(i):
                if rng.random() < 0.6:
                    links[i].add(j)
                    links[j].add(i)
        groups = cliques.greedy_cliques(links)
        assert all(b in links[a] for g in groups for a in g for b in g if a != b)
        assert len({v for g in groups for v in g}) == sum(map(len, groups))


def test_large_components_are_partitioned(spark):
    rng = random.Random(11)
    rows = [(100 * g + i, 100 * g + j, rng.choice([0.7, 0.8, 0.9])) for g in range(8) for i in range(25) for j in range(i) if rng.random() < 0.7]
    rows += [(1000 + i, 1001 + i, 0.9) for i in range(30)]
    edges = spark.createDataFrame([(min(a, b), max(a, b), j) for a, b, j in rows], "a long, b long, jaccard double")
    for t in (0.7, 0.85):
        want = sorted(map(tuple, cliques.partition(edges, t).collect()))
        assert want and sorted(map(tuple, cliques.partition(edges, t, most=27).collect())) == want
        assert sorted(map(tuple, cliques.partition(edges, t, most=3).collect())) == want


def test_no_bucket_is_left_out(spark):
    signed = spark.range(50_002).select(F.col("id").alias("doc_id"), F.array(F.lit(7).cast("long")).alias("bands"), F.array_repeat(F.lit(1), 64).alias("head"))
    assert minhash.gated_links(signed).count() == 50_001


def test_components_of_random_graphs(spark):
    rng = random.Random(5)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(1000 + i, 1001 + i) for i in range(40)] + [(7, 7)]
    parent = {}

    def find(v):
        while parent.setdefault(v, v) != v:
            v = parent[v]
        return v

    for a, b in pairs:
        if a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    got = {r["vertex"]: r["component"] for r in components.connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {v: find(v) for v in parent}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_band_layout():
    assert minhash.band_layout(512, 73, 7)[-1] == (504, 511)
    with pytest.raises(ValueError):
        minhash.band_layout(512, 74, 7)
    assert minhash.least_matches(0.4, 64) == 26


def test_release(spark, tmp_path):
    rows = spark.range(1000).select(F.col("id").alias("doc_id"), F.floor(F.col("id") / 70).alias("shard"), F.array("id").alias("x")).repartition(7)
    release.write(rows, str(tmp_path / "r"), 4, 100)
    released = spark.read.parquet(str(tmp_path / "r"))
    assert released.groupBy("shard").agg(F.countDistinct("part").alias("n")).where("n > 1").count() == 0
    assert len(released.inputFiles()) == 4 and all(abs(r["n_rows"] - 250) < 70 for r in release.manifest(released).collect())
    back = released.select(*rows.columns)
    assert release.checksum(back).first() == release.checksum(rows).first()
    assert release.overlaps(release.manifest(released)).count() == 0 and release.manifest(released).count() == 4
    assert release.difference(rows, back).count() == 0
    sinks.write_lines(rows.limit(3), "doc_id", str(tmp_path / "drops"))
    assert spark.read.text(str(tmp_path / "drops")).count() == 3
    line = sinks.markdown_rows(spark.createDataFrame([("a|b\nc", "x" * 50)], "p string, q string"), {"p": None, "q": 5}).first()[0]
    assert line == "| a b c | xxxxx |"


def test_sets_of_short_and_null_texts(spark):
    got = {r["doc_id"]: len(r["grams"]) for r in gram_sets(spark.createDataFrame([(1, None), (2, ""), (3, "a b c d"), (4, "a b c d e"), (5, "Ä-B c d e f!")], "doc_id long, text string")).collect()}
    assert got == {1: 0, 2: 0, 3: 0, 4: 1, 5: 1}


def test_partitions_at_several_thresholds(spark):
    edges = similarity.near_pairs(gram_sets(spark.createDataFrame(list(near_rows().items()), "doc_id long, text string")), 0.7)
    edges = edges.persist()
    for most in (1, 1000):  # all through the path for large components, or none
        got = {tuple(r) for r in cliques.partitions(edges, (0.7, 0.8, 0.9), most=most).select("threshold", "cluster", "doc_id").collect()}
        want = set()
        for t in (0.7, 0.8, 0.9):
            want |= {(t, r["cluster"], r["doc_id"]) for r in cliques.partition(edges, t).collect()}
        assert got == want and len(got) > 6
    assert [tuple(r) for r in cliques.top_components(cliques.components(edges), 1).collect()] == [(5, 4)]


def test_records_are_held_against_their_texts(spark):
    rows = spark.createDataFrame(list(record_rows().items()), "doc_id long, text string")
    scanned = exact.scan(rows)
    sets = similarity.representative_sets(rows)
    recorded = records.records(similarity.near_pairs(sets, 0.7), exact.members(scanned))
    good = records.verify(recorded, rows)
    assert good.where("wrong_exact + wrong_near > 0").count() == 0 and good.agg(F.sum("near_refs"), F.sum("exact_refs")).first()[0] > 0
    changed = rows.withColumn("text", F.when(F.col("doc_id") == 1020, "something else that has other words").otherwise(F.col("text")))
    bad = {r["doc_id"]: (r["wrong_exact"], r["wrong_near"]) for r in records.verify(recorded, changed).collect()}
    assert all(n > 0 for _, n in bad.values())
    groups = exact.members(exact.scan(rows))
    assert [tuple(r) for r in records.missing_groups(groups, rows.where("doc_id = 10").select("doc_id")).collect()] == [(30, 2)]
    assert records.missing_groups(groups, rows.where("doc_id = 2040").select("doc_id")).count() == 0
