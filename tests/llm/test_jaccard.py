import random
import time

import numpy as np
import pytest

from palimpsest.llm import jaccard


def sets(text):
    words = (text or "").lower().encode().split()
    k = min(5, len(words))
    return frozenset((k, *words[i : i + k]) for i in range(len(words) - k + 1)) if words else frozenset()


def brute(rows):
    """Classes and link counts by comparing all texts."""
    texts = {}
    for i, t in rows:
        if i is not None:
            texts.setdefault(t or "", []).append(i)
    keys = list(texts)
    own = [sets(t) for t in keys]
    parent, links, docs = list(range(len(keys))), [0] * len(keys), [0] * len(keys)

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(keys)):
        for j in range(i):
            shared = len(own[i] & own[j])
            if shared and shared >= 0.8 * (len(own[i]) + len(own[j]) - shared):
                parent[find(i)] = find(j)
                links[i] += 1
                links[j] += 1
                docs[i] += len(texts[keys[j]])
                docs[j] += len(texts[keys[i]])
    least = {}
    for i, t in enumerate(keys):
        least[find(i)] = min(least.get(find(i), 1 << 60), *texts[t])
    return {d: (least[find(i)], min(texts[t]), len(texts[t]) - 1, links[i], len(texts[t]) - 1 + docs[i]) for i, t in enumerate(keys) for d in texts[t]}


def planted(seed=1):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(4000)}"
    rows, passage = [], " ".join(word() for _ in range(60))
    for family in range(12):
        base = [word() for _ in range(rng.choice([6, 30, 200]))]
        for _ in range(rng.choice([2, 3, 25])):
            own = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 6])):
                own[rng.randrange(len(own))] = word()
            rows.append(" ".join(own))
    rows += [passage + " " + " ".join(word() for _ in range(rng.choice([10, 30]))) for _ in range(40)]
    rows += [" ".join(word() for _ in range(rng.randint(0, 9))) for _ in range(60)]
    rows += ["Same Text again and again here"] * 30 + ["same text again and again here"]
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize(("weight", "bucket"), [(100_000, 2000), (600, 5)])
def test_as_brute_force(spark, monkeypatch, weight, bucket):
    for name, value in (("WEIGHT", weight), ("MOST", weight), ("BUCKET", bucket)):
        monkeypatch.setattr(jaccard, name, value)
    rows = planted()
    got = {r["doc_id"]: (r["class_id"], r["rep_id"], r["n_copies"], r["n_text_links"], r["n_links"]) for r in jaccard.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = brute(rows)
    assert got == want


def test_large_buckets_are_tied_without_pairs(spark):
    n = jaccard.BUCKET + 5
    rows = [(i, bytes([i % 251]) * 60, [7]) for i in range(n)]
    out = jaccard._tied(spark.createDataFrame(rows, "rep long, sign binary, bands array<long>"), 24, 5, 0.8).collect()
    assert len(out) == n - 1 and {r["b"] for r in out} == {0}


def test_texts_with_equal_sets_are_not_compared(spark):
    began = time.monotonic()
    rows = [(i, "a b c d e f" + " " * (i % 20_000 + 1) + ("g" if i % 2 else "G")) for i in range(30_000)] + [(50_000, "a b c d e f g h")]
    got = {r["doc_id"]: r for r in jaccard.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {r["class_id"] for k, r in got.items() if k < 50_000} == {0}
    assert got[0]["n_copies"] == 1 and got[0]["n_text_links"] == 19_999 and got[0]["n_links"] == 29_999
    assert time.monotonic() - began < 60


def test_a_large_group_of_near_copies(spark):
    rng = random.Random(9)
    base = [f"w{i}" for i in range(100)]
    rows = []
    for i in range(2500):
        own = list(base)
        own[rng.randrange(100)] = f"x{i}"
        rows.append((i, " ".join(own)))
    got = jaccard.classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(8)).collect()
    # two such texts differ in ten n-grams of 96 at most
    assert {r["class_id"] for r in got} == {0} and {r["n_links"] for r in got} == {2499}


def test_one_id_with_several_texts(spark):
    rows = [(1, "a b c d e f g h i j"), (1, "k l m n o p q r s t"), (2, "a b c d e f g h i j"), (3, "k l m n o p q r s t"), (4, "other words that stand here alone")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"]: r["class_id"] for r in jaccard.classes(docs).collect()} == {1: 1, 2: 1, 3: 1, 4: 4}
    kept = [sorted((r["doc_id"], r["text"]) for r in jaccard.deduplicated(docs.repartition(n)).collect()) for n in (1, 3, 5)]
    assert kept[0] == kept[1] == kept[2] and [k for k, _ in kept[0]] == [1, 4]


def test_banding_reaches_the_recall():
    bands, rows = jaccard.banding()
    assert bands * rows <= jaccard.HASHES and 1 - (1 - 0.8**rows) ** bands >= jaccard.RECALL
    rng = np.random.default_rng(2)
    family, met = jaccard._family(bands * rows), 0
    for _ in range(300):  # sets with similarity 0.8
        x = rng.integers(0, 1 << 63, 450, np.uint64)
        a, b = (jaccard.minhash(v, family).reshape(bands, rows) for v in (np.concatenate([x[:400], x[400:425], x[425:450]]), np.concatenate([x[:400], rng.integers(0, 1 << 63, 50, np.uint64)])))
        met += bool((a == b).all(1).any())
    assert met >= 298


def test_deduplicated_keeps_one_of_each_class(spark):
    rows = planted(4)
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, _kept string")
    kept = jaccard.deduplicated(docs.withColumnRenamed("_kept", "class_id"))
    assert {r["doc_id"] for r in kept.collect()} == {c for c, *_ in brute(rows).values()}


def test_awkward_rows(awkward, nothing):
    rows = jaccard.classes(awkward)
    assert rows.count() == awkward.count()
    got = {r["doc_id"]: r for r in rows.where("doc_id is not null").collect()}
    assert (got[1]["class_id"], got[5]["class_id"], got[1]["n_copies"]) == (1, 1, 2)
    assert got[2]["class_id"] == got[3]["class_id"] == 2 and got[6]["class_id"] == 6
    assert all(r["class_id"] is None for r in rows.where("doc_id is null").collect())
    assert jaccard.classes(nothing).count() == 0 and jaccard.deduplicated(nothing).count() == 0
    kept = jaccard.deduplicated(awkward)
    assert kept.columns == awkward.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(["1", "2", "4", "6", "7", "8", "None", "None"])
