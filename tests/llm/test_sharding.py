import hashlib
import random
import zlib

import pytest

from palimpsest.llm import sharding


def slow_minimax(sizes, shards):
    """The least capacity by trying them all."""
    for capacity in range(sum(sizes) + 1):
        n, held = 0, None
        for s in sizes:
            if held is None or held + s > capacity:
                n, held = n + 1, s
            else:
                held += s
        if n <= shards:
            return capacity
    return 0


def test_minimax_as_brute_force():
    rng = random.Random(1)
    for _ in range(200):
        sizes = [rng.choice([1, 2, 3, 5, 40]) for _ in range(rng.randint(0, 25))]
        shards = rng.randint(1, 6)
        capacity, cuts = sharding.minimax(sizes, shards)
        assert capacity == slow_minimax(sizes, shards) and len(cuts) <= shards and (not sizes or cuts[-1] == len(sizes))


def plain(rows):
    groups = {}
    for i, text in rows:
        h = hashlib.sha256((text or "").encode()).digest()
        g = groups.setdefault(h, [None, 0])
        g[0] = i if g[0] is None else min(g[0], i) if i is not None else g[0]
        g[1] += len((text or "").encode()) + 1
    order = sorted(groups, key=lambda h: (groups[h][0] is not None, groups[h][0] or 0, h))
    capacity, cuts = sharding.minimax([groups[h][1] for h in order], sharding.SHARDS)
    return capacity, {h: sum(k >= c for c in cuts) for k, h in enumerate(order)}


def holds(df, rows):
    got = df.collect()
    capacity, shard = plain(rows)
    assert sorted((g["doc_id"] is None, g["doc_id"] or 0, g["text_crc32"]) for g in got) == sorted((i is None, i or 0, zlib.crc32((t or "").encode())) for i, t in rows)
    by_crc = {zlib.crc32((t or "").encode()): (len((t or "").encode()) + 1, shard[hashlib.sha256((t or "").encode()).digest()]) for _, t in rows}
    slots = {}
    for g in got:
        assert (g["size"], g["shard"]) == by_crc[g["text_crc32"]] and g["law"] == "bytes" and g["grown_shard"] is None and g["capacity"] == capacity
        slots.setdefault(g["shard"], []).append(g["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


@pytest.mark.parametrize("block", [4096, 7])
def test_as_plain_python(spark, monkeypatch, block):
    monkeypatch.setattr(sharding, "BLOCK", block)
    rng = random.Random(2)
    rows = [(i, "w" * rng.randint(0, 30) + str(rng.randrange(150))) for i in range(900)]
    rows += [(1000 + i, "hot text" * 3) for i in range(500)]
    rng.shuffle(rows)
    holds(sharding.shard(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)), rows)


def test_awkward_rows(awkward, nothing):
    holds(sharding.shard(awkward), [(r["doc_id"], r["text"]) for r in awkward.collect()])
    assert sharding.shard(nothing).count() == 0
