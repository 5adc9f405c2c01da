import zlib

import numpy as np

from palimpsest.llm import toxicity
from palimpsest.sources.tables import table


def test_isotonic_as_brute_force():
    rng = np.random.default_rng(1)
    for _ in range(50):
        x, y, w = rng.integers(0, 12, 30).astype(float), rng.integers(0, 2, 30).astype(float), rng.uniform(0.1, 2, 30)
        at, value = toxicity.isotonic(x, y, w)
        assert (np.diff(value) >= -1e-12).all()
        places = np.unique(x)
        means = [(np.average(y[x == p], weights=w[x == p]), w[x == p].sum()) for p in places]
        # the max-min formula of isotonic regression
        for k, p in enumerate(places):
            want = max(min(np.average([m for m, _ in means[i : j + 1]], weights=[v for _, v in means[i : j + 1]]) for j in range(k, len(places))) for i in range(k + 1))
            assert abs(np.interp(p, at, value) - want) < 1e-9


def test_trees_learn_an_interaction():
    rng = np.random.default_rng(2)
    x = rng.uniform(-1, 1, (3000, 4))
    y = ((x[:, 0] > 0.2) ^ (x[:, 2] > -0.3)).astype(float)
    trees = toxicity.Trees().fit(x[:2000], y[:2000], np.ones(2000))
    assert ((trees.margin(x[2000:]) > 0) == y[2000:]).mean() > 0.95


def test_features():
    f = dict(zip(toxicity.FEATURES, toxicity.features("You IDIOT! m0ron idiot", {"idiot": 3.0, "moron": 2.0}, {"idio": 1.0}), strict=True))
    assert f["hit_density"] == 0.5 and f["top_weight"] == 3.0 and f["nearness"] == 1 - 1 / 50 and f["shout_rate"] == 0.25
    assert f["mixed_rate"] == 0.25 and f["log_unmasked"] == np.log1p(1)
    assert len(toxicity.features("", {}, {})) == len(toxicity.FEATURES)


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    known = docs.join(labels.select("doc_id"), "doc_id", "left_semi")
    rows = toxicity.rate(known, labels).toPandas().merge(labels.toPandas(), on="doc_id")
    assert (rows["held_out"] == [zlib.crc32(str(i).encode()) % 5 == 0 for i in rows["doc_id"]]).all()
    held = rows[rows["held_out"]]
    assert len(held) > 500 and (held["predicted"] == held["toxic"]).mean() > 0.97
    assert rows["score"].between(0, 1).all() and ((rows["score"] >= 0.5) == (rows["predicted"] == 1)).all()
    clean = held[held["toxic"] == 0]
    assert (clean["predicted"] == 1).mean() < 0.01


def test_held_out_labels_teach_nothing(spark):
    folder = "/root/testdata/sf0.001"
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    flipped = labels.selectExpr("doc_id", "quality", "if(crc32(cast(cast(doc_id as string) as binary)) % 5 = 0, 1 - toxic, toxic) as toxic")
    a, b = (sorted(map(tuple, toxicity.rate(docs, x).collect())) for x in (labels, flipped))
    assert a == b


def test_awkward_rows(awkward, nothing, labels):
    rows = toxicity.rate(awkward, labels).collect()
    assert len(rows) == awkward.count() and all(0 <= r["score"] <= 1 for r in rows) and all(r["held_out"] for r in rows if r["doc_id"] is None)
    assert toxicity.rate(nothing, labels).count() == 0
    assert {r["score"] for r in toxicity.rate(awkward, labels.limit(0)).collect()} == {0.0}
    kept = toxicity.accepted(awkward, labels)
    assert kept.columns == awkward.columns and kept.count() == sum(r["score"] < 0.5 for r in rows)
