"""Sharding by minimax contiguous partition.

Documents with equal texts form an atomic group. Groups stand in the order of
their smallest doc_id (ties: by content hash). The smallest capacity for which
a greedy pass fits all groups into the shards is found by binary search, and
the order is cut there. A group larger than the capacity has a shard of its
own, so one huge group of copies doesn't raise the capacity of the others; the
largest shard is the minimax one either way.

The group sizes are never brought to the driver. It sees one row for each block
of ``BLOCK`` neighbouring groups (more, so that there are about ``DIRECTORY``
blocks at most): with these it bounds the capacity from
both sides, then asks only for the groups of blocks in which a cut can still
lie, and ends the search exactly.

Cases: a null text has no bytes and is a copy of the empty text; repeated rows
and equal texts share a shard; null ids sort first; an empty table gives an
empty result; fewer groups than shards leave the last shards empty; other
columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.sources.tables import materialize

SHARDS = 16
BLOCK, DIRECTORY = 4096, 200_000


def digests(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.unhex(F.sha2(text, 256)).alias("gid"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )


def _numbered(batches: Iterator[pa.RecordBatch], block: int) -> Iterator[pa.RecordBatch]:
    """Numbers the rows of a sorted partition and adds up sizes and counts before each."""
    rows = bytes_ = docs = 0
    for b in batches:
        if not b.num_rows:
            continue
        size, n = (np.asarray(b.column(k).to_numpy(zero_copy_only=False), np.int64) for k in ("size", "n"))
        sums, counts = np.cumsum(size), np.cumsum(n)
        place = rows + np.arange(b.num_rows)
        yield pa.RecordBatch.from_arrays(
            [b.column("part"), pa.array(place // block), b.column("first"), b.column("gid"), pa.array(size), pa.array(n), pa.array(bytes_ + sums - size), pa.array(docs + counts - n)],
            names=["part", "block", "first", "gid", "size", "n", "at", "docs_at"],
        )
        rows, bytes_, docs = rows + b.num_rows, bytes_ + int(sums[-1]), docs + int(counts[-1])


NUMBERED = "part int, block long, first long, gid binary, size long, n long, at long, docs_at long"


def greedy(ends: list[int], capacity: int, limit: int) -> list[int]:
    """The end place of each shard, greedily; an oversized group stands alone. Stops past ``limit`` shards.

    ``ends`` are the running sums of the group sizes.
    """
    cuts, place, base = [], 0, 0
    while place < len(ends) and len(cuts) <= limit:
        place = max(place + 1, bisect_right(ends, base + capacity, place))
        base = ends[place - 1]
        cuts.append(place)
    return cuts


def minimax(sizes: list[int], shards: int) -> tuple[int, list[int]]:
    """The smallest feasible capacity and the shards' end places, for sizes at hand."""
    ends = np.cumsum(np.asarray(sizes, np.int64)).tolist()
    low, high = 0, ends[-1] if ends else 0
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if len(greedy(ends, mid, shards)) <= shards else (mid + 1, high)
    return low, greedy(ends, low, shards)


class _Blocks:
    """Running sums by block: within a block, ends are known only once it is opened."""

    def __init__(self, starts: list[int], ends: list[int], largest: list[int]):
        self.starts, self.ends, self.largest, self.opened = starts, ends, largest, {}

    def shard_end(self, base: int, capacity: int) -> tuple[int, int]:
        """Bounds, as running sums, of where a greedy shard that begins at ``base`` ends."""
        total = self.ends[-1]
        if base + capacity >= total:
            return total, total
        k = bisect_right(self.ends, base + capacity)  # the block in which the target lies
        if k in self.opened:
            inside = self.opened[k]
            at = bisect_right(inside, base + capacity)
            end = inside[at - 1] if at else self.starts[k]
            if end <= base:  # an oversized group
                end = inside[bisect_right(inside, base)] if base < self.ends[k] else self.ends[k]
            return end, end
        # unopened: at least to the block's start, at most to the target or past one oversized group
        low = self.starts[k]
        if low > base:
            return low, min(base + capacity, self.ends[k])
        return base + 1, max(base + capacity, min(self.ends[k], base + self.largest[k]))

    def run(self, capacity: int, shards: int) -> tuple[int, int, set[int]]:
        """Where all shards end at least and at most, and the unopened blocks in which a cut may lie."""
        low = high = 0
        doubt: set[int] = set()
        total = self.ends[-1]
        for _ in range(shards):
            a, b = bisect_right(self.ends, min(low + capacity, total - 1)), bisect_right(self.ends, min(high + capacity, total - 1))
            doubt |= {k for k in range(a, b + 1) if k not in self.opened}
            low, high = self.shard_end(low, capacity)[0], min(self.shard_end(high, capacity)[1], total)
        return low, high, doubt


def _opened(groups: DataFrame, keys: list[tuple[int, int]], offsets: dict[int, int]) -> dict[tuple[int, int], list[int]]:
    """The running sums inside some blocks."""
    wanted = groups.sparkSession.createDataFrame(keys, "part int, block long")
    got = groups.join(F.broadcast(wanted), ["part", "block"]).select("part", "block", (F.col("at") + F.col("size")).alias("end")).toPandas()
    return {k: sorted((v.to_numpy() + offsets[k[0]]).tolist()) for k, v in got.groupby(["part", "block"])["end"]}


def cut(groups: DataFrame, shards: int = SHARDS) -> tuple[int, list[int], dict[int, int], dict[int, int]]:
    """The capacity, the running sums at which shards end, and each partition's bytes and documents before it."""
    table = groups.groupBy("part", "block").agg(F.min("at").alias("at"), F.max(F.col("at") + F.col("size")).alias("end"), F.max("size").alias("largest"), F.max(F.col("docs_at") + F.col("n")).alias("docs")).orderBy("part", "block").collect()
    offsets: dict[int, int] = {}
    docs_before: dict[int, int] = {}
    total = docs = 0
    starts, ends, largest, keys = [], [], [], []
    last = None
    for r in table:
        if r["part"] != last:
            if last is not None:
                total, docs = ends[-1], docs_before[last] + docs_in
            offsets[r["part"]], docs_before[r["part"]], last = total, docs, r["part"]
        docs_in = r["docs"]
        starts.append(total + r["at"])
        ends.append(total + r["end"])
        largest.append(r["largest"])
        keys.append((r["part"], r["block"]))
    if not table:
        return 0, [], offsets, docs_before
    blocks = _Blocks(starts, ends, largest)
    low, high, whole = 0, ends[-1], ends[-1]
    while low < high:
        mid = (low + high) // 2
        least, most, doubt = blocks.run(mid, shards)
        if least >= whole:
            high = mid
        elif most < whole:
            low = mid + 1
        elif doubt:
            got = _opened(groups, [keys[k] for k in sorted(doubt)], offsets)
            blocks.opened |= {k: got[keys[k]] for k in doubt}
        else:
            raise AssertionError("a run over open blocks is exact")
    cuts, base = [], 0
    while base < whole:
        _, _, doubt = blocks.run(low, shards)
        if doubt:
            got = _opened(groups, [keys[k] for k in sorted(doubt)], offsets)
            blocks.opened |= {k: got[keys[k]] for k in doubt}
            continue
        base = blocks.shard_end(base, low)[0]
        cuts.append(base)
    return low, cuts, offsets, docs_before


def shard(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """One row a document: size, text_crc32, law, shard, slot, grown_shard and the shard capacity."""
    rows = materialize(digests(docs), "digests")
    groups = rows.groupBy("gid").agg(F.min("doc_id").alias("first"), F.sum("size").alias("size"), F.count(F.lit(1)).alias("n"))
    groups = materialize(groups, "groups")
    spark = docs.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ordered = groups.repartitionByRange(parts, "first", "gid").sortWithinPartitions("first", "gid").withColumn("part", F.spark_partition_id())
    block = max(BLOCK, groups.count() // DIRECTORY)
    placed = materialize(ordered.mapInArrow(lambda b: _numbered(b, block), NUMBERED), "placed")
    capacity, cuts, offsets, docs_before = cut(placed, shards)
    return _assigned(rows, placed, shards, capacity, cuts, offsets, docs_before)


def _assigned(rows: DataFrame, placed: DataFrame, shards: int, capacity: int, cuts: list[int], offsets: dict[int, int], docs_before: dict[int, int]) -> DataFrame:
    spark = rows.sparkSession
    before = spark.createDataFrame([(p, offsets[p], docs_before[p]) for p in offsets], "part int, bytes_before long, docs_before long")
    # one row a partition, so its size is that of the partition count
    place = placed.join(F.broadcast(before), "part").select("gid", "first", "n", (F.col("at") + F.col("bytes_before")).alias("at"), (F.col("docs_at") + F.col("docs_before")).alias("docs_at"))
    number = F.lit(0)
    for end in cuts[:-1]:
        number = number + F.when(F.col("at") >= end, 1).otherwise(0)
    place = materialize(place.withColumn("shard", number.cast("int")), "places")
    begins = {r["shard"]: r["begin"] for r in place.groupBy("shard").agg(F.min("docs_at").alias("begin")).collect()}
    # a document's slot is its place in its group, past the documents of earlier groups of the shard
    known = rows.join(place.select("gid", "first", "shard"), "gid")
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    order = ["first", "gid", "doc_id"]
    lined = known.repartitionByRange(parts, *order, "text_crc32").sortWithinPartitions(*order)
    # the id is the partition's number and the row's place in it
    lined = materialize(lined.withColumn("place", F.monotonically_increasing_id()), "lined")
    part, row = F.shiftright("place", 33), F.col("place").bitwiseAND(F.lit((1 << 33) - 1))
    counts = sorted((r["p"], r["n"]) for r in lined.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect())
    sums, total = [], 0
    for p, n in counts:
        sums.append((p, total))
        total += n
    ahead = spark.createDataFrame(sums, "p long, ahead long")
    begin = F.coalesce(*[F.when(F.col("shard") == s, F.lit(b)) for s, b in sorted(begins.items())]) if begins else F.lit(0)
    out = lined.withColumn("p", part).join(F.broadcast(ahead), "p")
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("ahead") + row - begin).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), F.lit(capacity).cast("long").alias("capacity"),
    )
