import random
import re

import duckdb

from palimpsest.llm import mixing, queries
from palimpsest.sources.tables import table


def fill(sizes, share=1.5, cap=2.0, weights=(3, 1, 2)):
    """Targets by resharing the excess again and again."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, free, out = share * sum(sizes.values()), set(names), {}
    while free:
        total = sum(weight[s] for s in free)
        above = {s for s in free if left * weight[s] / total > cap * sizes[s]}
        if not above:
            return out | {s: left * weight[s] / total for s in free}
        for s in above:
            out[s] = cap * sizes[s]
        left -= sum(out[s] for s in above)
        free -= above
    return out


def test_targets(spark):
    rng = random.Random(1)
    for n in (1, 2, 5, 17):
        sizes = {f"s{i}é" if i % 2 else f"S{i}": rng.choice([0, 1, 10, 1000, 50_000]) for i in range(n)} | {None: 70}
        got = {r["source"]: r["target"] for r in mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
        want = fill(sizes)
        assert got.keys() == want.keys() and all(abs(got[s] - want[s]) < 1e-6 * (1 + want[s]) for s in want)


def docs(spark, n=1200):
    rng = random.Random(3)
    rows = [(i, " ".join("w" for _ in range(rng.randint(0, 60))), rng.choice(["big"] * 4 + ["s1", "s2", None])) for i in range(n)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


def test_mix_is_near_targets_and_repeats(spark):
    a, b = (sorted(map(tuple, mixing.mix(docs(spark)).collect()), key=str) for _ in range(2))
    assert a == b
    sums = {}
    for _, size, source_size, target, taken, source, copies in a:
        assert taken == size * copies <= 2 * size
        s = sums.setdefault(source, [0, source_size, target, 0])
        s[0], s[3] = s[0] + size, s[3] + taken
    for size, source_size, target, taken in sums.values():
        assert size == source_size and abs(taken - target) <= 0.03 * target


def test_emitted_rows_are_the_mix(spark):
    d = docs(spark, 300)
    want = {r["doc_id"]: r["copies"] for r in mixing.mix(d).collect() if r["copies"]}
    got = {}
    for r in mixing.emit(d).collect():
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + 1
    assert got == want and mixing.emit(d).columns == d.columns


def test_oracle(spark):
    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{folder}/documents.parquet'")
    sql = con.execute(queries.oracle_sql()["op9_mixing"])
    names = [d[0] for d in sql.description]
    want = {tuple(r[names.index(c)] for c in ("doc_id", "size", "source_size", "taken")) for r in sql.fetchall()}
    got = {(r["doc_id"], r["size"], r["source_size"], r["taken"]) for r in queries.op9_mixing(spark, folder).collect()}
    assert got == want and table(spark, folder, "documents").count() == len(got)


def test_awkward_rows(awkward, nothing):
    rows = mixing.mix(awkward).collect()
    assert len(rows) == awkward.count() and all(0 <= r["taken"] <= 2 * r["size"] for r in rows)
    words = re.compile("[^\x20\x09-\x0d]+")
    assert sorted(r["size"] for r in rows) == sorted(len(words.findall(r["text"] or "")) for r in awkward.collect())
    assert mixing.mix(nothing).count() == 0 and mixing.emit(nothing).count() == 0
    out = mixing.emit(awkward)
    assert out.columns == awkward.columns and out.count() == sum(r["copies"] for r in rows)
