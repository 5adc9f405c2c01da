"""Exact top-k search by inner product with a pivot-distance index.

Vectors are turned into integers, floor(scale * x). Adding one coordinate that
brings all vectors to the same length (and 0 for a query) makes the largest
inner product the smallest Euclidean distance, where the triangle inequality
holds. Pivots come from a few rounds of k-means on a bounded sample
(``SAMPLE`` rows); every vector is keyed by its nearest pivot and its distance
to it, and the index is one table of blocks: neighbours in that order, packed,
with the annulus that they fill.

1. Each query searches the annuli nearest its own place until it has met
   ``HOME`` others (at least k), however small the blocks. Its k-th score bounds the distance that can still matter.
2. The annuli are then expanded: a block is searched only if, by the triangle
   inequality, it can hold a vector within that distance, and within the block
   only the rows whose pivot distance allows it.

Results are exact: scores are integers, bounds have slack for rounding, and
what ties with the k-th score is kept if its id isn't larger than the k-th's.

Queries travel in chunks and vectors in blocks, so a task holds one of each.
The driver holds the directory, one row a block, kept under about
``DIRECTORY`` rows by the block size as long as a block has ``BYTES`` at most.

Cases: vectors that are null or hold null or non-finite parts, and rows with a
null id, take no part; shorter vectors count as padded with zeros; rows with a
query's own id are not its candidates, rows that repeat another id are each
ranked, and a query that repeats is asked once, with its least vector; fewer
than k candidates are all returned; empty tables give empty results; other
columns are ignored; in a vector whose square is beyond 2**62, so that scores
might not fit in 64 bits, components count as at most sqrt(2**62 / their
number) either way.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.sources.tables import materialize

SAMPLE, PIVOTS, ROUNDS = 8192, 64, 8
BLOCK, DIRECTORY, CHUNK, HOME = 1024, 200_000, 256, 1024
#: Bytes of a block's vectors at most, and cells that are compared with the directory at once.
BYTES, CELLS = 1 << 26, 1 << 22


def _rows(column: pa.Array, size: int) -> np.ndarray:
    """Packed vectors as a matrix, padded with zeros."""
    out = np.zeros((len(column), size))
    for i, v in enumerate(column):
        own = np.frombuffer(v.as_py(), np.int64)
        out[i, : len(own)] = own
    return out


def quantised(vectors: DataFrame, vec_id: str, vector: str, scale: float) -> DataFrame:
    """The vectors that take part, as packed integers with their squared length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, packed, norms = [], [], []
            for i, v in zip(batch.column("vec_id").to_pylist(), batch.column("v"), strict=True):
                x = v.values.to_numpy(zero_copy_only=False).astype(np.float64)
                if i is None or v.values.null_count or not np.isfinite(x).all():
                    continue
                x = np.floor(scale * x)
                if float(np.abs(x).max(initial=0)) > 2.0**31 or float(x @ x) > 2.0**62:  # so that all inner products fit in 64 bits
                    most = float(int((2.0**62 / len(x)) ** 0.5))
                    x = np.clip(x, -most, most)
                whole = x.astype(np.int64)
                ids.append(i)
                packed.append(whole.tobytes())
                norms.append(int(whole @ whole))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(packed, pa.binary()), pa.array(norms, pa.int64())], names=["vec_id", "v", "norm"])

    taken = vectors.where(F.col(vector).isNotNull()).select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"))
    return taken.mapInArrow(run, "vec_id long, v binary, norm long")


def pivots(sample: np.ndarray, count: int = PIVOTS) -> np.ndarray:
    """Centres of a few rounds of k-means, begun at rows far from each other."""
    if not len(sample):
        return np.zeros((1, sample.shape[1]))
    chosen = [0]
    far = ((sample - sample[0]) ** 2).sum(1)
    while len(chosen) < min(count, len(sample)) and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, ((sample - sample[chosen[-1]]) ** 2).sum(1))
    centres = sample[chosen].copy()
    for _ in range(ROUNDS):
        own = distances(sample, centres).argmin(1)
        for i in range(len(centres)):
            if (own == i).any():
                centres[i] = sample[own == i].mean(0)
    return centres


def distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    squared = (x**2).sum(1)[:, None] + (centres**2).sum(1) - 2 * x @ centres.T
    return np.sqrt(np.maximum(squared, 0))


def _lifted(x: np.ndarray, norms: np.ndarray, most: int) -> np.ndarray:
    return np.column_stack([x, np.sqrt(np.maximum(most - norms, 0.0))])


def _scores(queries: np.ndarray, block: np.ndarray) -> np.ndarray:
    largest = float(np.abs(queries).max(initial=0)) * float(np.abs(block).max(initial=0)) * block.shape[1]
    if largest < 2.0**52:  # exact in floating point
        return (queries @ block.T).astype(np.int64)
    return queries.astype(np.int64) @ block.astype(np.int64).T


PAIRS = "block long, queries binary, vectors binary, bounds binary, ties binary"
LAST = np.iinfo(np.int64).max


class Index:
    """Blocks of vectors by nearest pivot and distance, and their directory."""

    def __init__(self, vectors: DataFrame, count: int = PIVOTS, block: int = BLOCK, met: int = HOME):
        self.vectors, self.met = vectors, met
        spark = vectors.sparkSession
        n, most, size = vectors.agg(F.count(F.lit(1)), F.max("norm"), F.max(F.octet_length("v"))).first()
        self.n, self.most, self.size = n, most or 0, (size or 0) // 8
        self.block = min(max(block, n // DIRECTORY), max(1, BYTES // (8 * max(1, self.size))))
        sample = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("v", "norm").toArrow()
        x = _rows(sample.column("v"), self.size)
        self.pivots = pivots(_lifted(x, sample.column("norm").to_numpy().astype(float), self.most), count)
        self.parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
        keyed = vectors.mapInArrow(self._keyed, "vec_id long, v binary, pivot int, far double")
        ordered = keyed.repartitionByRange(self.parts, "pivot", "far", "vec_id").sortWithinPartitions("pivot", "far", "vec_id").withColumn("part", F.spark_partition_id())
        self.blocks = materialize(ordered.mapInArrow(self._packed, "block long, pivot int, near double, far double, n int, ids binary, fars binary, matrix binary"), "blocks")
        self.directory = self.blocks.select("block", "pivot", "near", "far", "n").orderBy("block").toPandas()

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("vectors", "blocks")}

    def _keyed(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _lifted(_rows(batch.column("v"), self.size), batch.column("norm").to_numpy().astype(float), self.most)
                d = distances(x, self.pivots)
                own = d.argmin(1)
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), pa.array(own.astype(np.int32)), pa.array(d[np.arange(len(x)), own])], names=["vec_id", "v", "pivot", "far"])

    def _packed(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, held = 0, []

        def block() -> pa.RecordBatch:
            table = pa.Table.from_batches(held)
            far = table.column("far").to_numpy()
            row = [(table.column("part")[0].as_py() << 32) + count, table.column("pivot")[0].as_py(), far[0], far[-1], table.num_rows, table.column("vec_id").to_numpy().tobytes(), far.tobytes(), _rows(table.column("v"), self.size).tobytes()]
            types = [pa.int64(), pa.int32(), pa.float64(), pa.float64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types, strict=True)], names=["block", "pivot", "near", "far", "n", "ids", "fars", "matrix"])

        for batch in batches:
            at = 0
            while at < batch.num_rows:
                pivot = batch.column("pivot")[at].as_py()
                if held and (held[0].column("pivot")[0].as_py() != pivot or sum(b.num_rows for b in held) >= self.block):
                    yield block()
                    count, held = count + 1, []
                run = int(np.searchsorted(batch.column("pivot").to_numpy()[at:], pivot, side="right"))
                take = min(run, self.block - sum(b.num_rows for b in held))
                held.append(batch.slice(at, take))
                at += take
        if held:
            yield block()

    def chunks(self, queries: DataFrame) -> DataFrame:
        """Queries packed into chunks of neighbours: rows (ids, matrix, bounds, ids that ties may have at most)."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, CHUNK):
                    part = batch.slice(at, CHUNK)
                    row = [part.column("vec_id").to_numpy().tobytes(), _rows(part.column("v"), self.size).tobytes(), part.column("bound").to_numpy(zero_copy_only=False).astype(np.float64).tobytes(), part.column("tie").to_numpy(zero_copy_only=False).astype(np.int64).tobytes()]
                    yield pa.RecordBatch.from_arrays([pa.array([v], pa.binary()) for v in row], names=["queries", "vectors", "bounds", "ties"])

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    x = _rows(batch.column("v"), self.size)
                    d = distances(np.column_stack([x, np.zeros(len(x))]), self.pivots)
                    yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(d.argmin(1).astype(np.int32)), pa.array(d.min(1))], names=[*batch.schema.names, "pivot", "far"])

        placed = queries.select("vec_id", "v", "bound", "tie").mapInArrow(place, "vec_id long, v binary, bound double, tie long, pivot int, far double")
        ordered = placed.repartitionByRange(self.parts, "pivot", "far", "vec_id").sortWithinPartitions("pivot", "far", "vec_id")
        return ordered.mapInArrow(run, "queries binary, vectors binary, bounds binary, ties binary")

    def _reach(self, x: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distances to the pivots, and the distance within which scores reach the bound."""
        d = distances(np.column_stack([x, np.zeros(len(x))]), self.pivots)
        reach = np.sqrt(np.maximum((x**2).sum(1) + self.most - 2 * bound, 0))
        return d, reach + 1e-6 * (1 + reach + d.max(1, initial=0))

    def _wanted(self, x: np.ndarray, bound: np.ndarray, k: int, home: bool) -> np.ndarray:
        """Which blocks (columns) each query (row) has to search."""
        t = self.directory
        pivot, near, far, n = (t[c].to_numpy() for c in ("pivot", "near", "far", "n"))
        d, reach = self._reach(x, bound)
        gap = np.maximum(0, np.maximum(near - d[:, pivot], d[:, pivot] - far))
        if not home:
            return gap <= reach[:, None]
        # the annuli nearest a query's place, until they hold enough
        order = np.lexsort((np.broadcast_to(d[:, pivot], gap.shape), gap), axis=1) if len(t) else np.zeros((len(x), 0), int)
        before = np.cumsum(n[order], 1) - n[order]
        out = np.zeros(gap.shape, bool)
        np.put_along_axis(out, order, before <= max(k, self.met), 1)
        return out

    def pairs(self, chunks: DataFrame, k: int, home: bool) -> DataFrame:
        """A row for each chunk and block that it has to search, with the chunk's rows that need it."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names = self.directory["block"].to_numpy()
            for batch in batches:
                for ids, packed, bounds, ties in zip(*[batch.column(c).to_pylist() for c in ("queries", "vectors", "bounds", "ties")], strict=True):
                    q, bound, tie = np.frombuffer(ids, np.int64), np.frombuffer(bounds), np.frombuffer(ties, np.int64)
                    x = np.frombuffer(packed).reshape(len(q), self.size)
                    step = max(1, CELLS // max(1, len(names)))
                    wanted = np.concatenate([self._wanted(x[at : at + step], bound[at : at + step], k, home) for at in range(0, len(x), step)])
                    for b in np.flatnonzero(wanted.any(0)):
                        rows = wanted[:, b]
                        row = [int(names[b]), q[rows].tobytes(), x[rows].tobytes(), bound[rows].tobytes(), tie[rows].tobytes()]
                        yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, (pa.int64(), *[pa.binary()] * 4), strict=True)], names=["block", "queries", "vectors", "bounds", "ties"])

        return chunks.mapInArrow(run, PAIRS)

    def _found(self, batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
        """Each query's best of a block: at most k rows, none under the query's bound."""
        for batch in batches:
            for r in batch.to_pylist():
                q, bound, tie = np.frombuffer(r["queries"], np.int64), np.frombuffer(r["bounds"]), np.frombuffer(r["ties"], np.int64)
                x = np.frombuffer(r["vectors"]).reshape(len(q), self.size)
                ids, fars = np.frombuffer(r["ids"], np.int64), np.frombuffer(r["fars"])
                matrix = np.frombuffer(r["matrix"]).reshape(len(ids), self.size)
                tie = np.where(np.abs(bound) < 2.0**53, tie, LAST)  # beyond, unlike scores can look equal
                d, reach = self._reach(x, bound)
                own = d[:, r["pivot"]]
                low, high = np.searchsorted(fars, (own - reach).min(), "left"), np.searchsorted(fars, (own + reach).max(), "right")
                ids, matrix = ids[low:high], matrix[low:high]
                scores = _scores(x, matrix)
                a, b, c = [], [], []
                for i in range(len(q)):
                    at = np.flatnonzero(((scores[i] > bound[i]) | (scores[i] == bound[i]) & (ids <= tie[i])) & (ids != q[i]))
                    if len(at) > k:
                        least = np.partition(scores[i][at], len(at) - k)[len(at) - k]
                        at = at[scores[i][at] >= least]
                        at = at[np.lexsort((ids[at], -scores[i][at]))[:k]]
                    a.append(np.full(len(at), q[i]))
                    b.append(ids[at])
                    c.append(scores[i][at])
                if a:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(v).astype(np.int64)) for v in (a, b, c)], names=["query_id", "vec_id", "score"])

    def search(self, queries: DataFrame, k: int, home: bool) -> DataFrame:
        pairs = self.pairs(self.chunks(queries), k, home)
        return pairs.join(self.blocks.select("block", "pivot", "ids", "fars", "matrix"), "block").mapInArrow(lambda b: self._found(b, k), "query_id long, vec_id long, score long")


def search(vectors: DataFrame, is_query: Column, k: int = 20, scale: float = 64.0, vec_id: str = "vec_id", vector: str = "embedding", count: int = PIVOTS, block: int = BLOCK, met: int = HOME) -> DataFrame:
    """Each query's k best of all other rows: query_id, rank, vec_id, score; ties go to the smaller id."""
    rows = materialize(quantised(vectors, vec_id, vector, scale), "vectors")
    index = Index(rows, count, block, met)
    asked = rows.where(is_query).groupBy("vec_id").agg(F.min("v").alias("v"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    open_, last = F.lit(float("-inf")), F.lit(int(LAST))
    first = index.search(asked.withColumn("bound", open_).withColumn("tie", last), k, home=True)
    best = first.withColumn("rank", F.row_number().over(order)).where(F.col("rank") == k)
    best = materialize(best.select("query_id", F.col("score").cast("double").alias("bound"), F.col("vec_id").alias("tie")), "bounds")
    bounded = asked.join(best, asked["vec_id"] == best["query_id"], "left").withColumn("bound", F.coalesce("bound", open_)).withColumn("tie", F.coalesce("tie", last))
    found = index.search(bounded, k, home=False)
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
