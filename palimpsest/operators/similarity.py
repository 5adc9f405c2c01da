"""Exact Jaccard similarity of n-gram sets.

``near_pairs`` is exact: it follows the prefix principle (Bayardo et al.,
"Scaling Up All Pairs Similarity Search", 2007). Two sets with Jaccard at
least t share an n-gram among the rarest n - ceil(t * n) + 1 of each, so only
those are joined. N-grams of a single document can't link and are left out of
the join, and lengths too unlike are dropped before sets are compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions.shingles import gram_sets
from palimpsest.operators.exact import representatives, scan
from palimpsest.sources.tables import materialize

#: N-grams of a part of a component; each pair of parts is a task.
WEIGHT = 500_000
#: The share of a set's n-grams by which the prefixes of ``met_elsewhere`` are longer than one common n-gram asks for.
MORE = 0.125


def jaccard(shared: Column, left: Column, right: Column) -> Column:
    """i / (a + b - i), 0 for two empty sets."""
    union = left + right - shared
    return F.when(union == 0, F.lit(0.0)).otherwise(shared.cast("double") / union.cast("double"))


def representative_sets(docs: DataFrame) -> DataFrame:
    """(doc_id, grams) of one document of each digest; those too short have no n-grams."""
    reps = representatives(scan(docs))
    return gram_sets(docs.join(reps, "doc_id", "left_semi"))


def verified(links: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """(a, b, jaccard) of links whose sets reach the threshold."""
    left = sets.select(F.col("doc_id").alias("a"), F.col("grams").alias("ga"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("grams").alias("gb"))
    both = links.select("a", "b").join(left, "a").join(right, "b")
    shared = F.size(F.array_intersect("ga", "gb"))
    return both.select("a", "b", jaccard(shared, F.size("ga"), F.size("gb")).alias("jaccard")).where(F.col("jaccard") >= threshold)


def _shared(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many n-grams each left set shares with each right one, by products over blocks of n-grams."""
    known, inverse = np.unique(np.concatenate([*left, *right]), return_inverse=True)
    row = np.repeat(np.arange(len(left) + len(right)), [len(x) for x in (*left, *right)])
    common = np.bincount(inverse, minlength=len(known)) > 1
    place = np.cumsum(common) - 1
    keep = common[inverse]
    row, column = row[keep], place[inverse[keep]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    out = np.zeros((len(left), len(right)), np.float64)
    width = max(64, 4_000_000 // (len(left) + len(right)))
    for at in range(0, int(place[-1]) + 1, width):
        a, b = np.searchsorted(column, [at, at + width])
        if a < b:
            block = np.zeros((len(left) + len(right), width), np.float32)
            block[row[a:b], column[a:b] - at] = 1
            out += block[: len(left)] @ block[len(left) :].T
    return out


def _within(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """The near pairs of tasks (component, i, j), in a partition sorted by them."""

    def pairs(key: tuple, rows: list[tuple[int, int, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        left, right = ([r for r in rows if r[0] == p] for p in key[1:])
        ids, sizes = np.array([r[1] for r in right], np.int64), np.array([len(r[2]) for r in right], np.float64)
        step = 256 if len(right) else len(left) + 1
        for at in range(0, len(left) if len(right) else 0, step):
            part = left[at : at + step]
            shared = _shared([r[2] for r in part], [r[2] for r in right])
            own = np.array([r[1] for r in part], np.int64)[:, None]
            alike = shared / (np.array([len(r[2]) for r in part], np.float64)[:, None] + sizes - shared)
            # within one part each pair is met twice
            x, y = np.nonzero((alike >= threshold) & ((own < ids) if key[1] == key[2] else (own != ids)))
            a, b = own[x, 0], ids[y]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(alike[x, y])], names=["a", "b", "jaccard"])

    last, held = None, []
    for batch in batches:
        keys = zip(*[batch.column(c).to_pylist() for c in ("component", "i", "j")], strict=True)
        for key, part, doc, own in zip(keys, batch.column("part").to_pylist(), batch.column("doc_id").to_pylist(), batch.column("grams"), strict=True):
            if key != last and held:
                yield from pairs(last, held)
                held = []
            last = key
            held.append((part, doc, own.values.to_numpy()))
    if held:
        yield from pairs(last, held)


def pairs_within(labelled: DataFrame, sets: DataFrame, threshold: float, weight: int = WEIGHT) -> DataFrame:
    """(a, b, jaccard) of all pairs in the same component, for (doc_id, component), that reach the threshold.

    A component beyond ``weight`` n-grams is dealt into parts, and each pair
    of parts is a task, so that no task holds more than two parts.
    """
    members = labelled.select("doc_id", "component").join(sets.where(F.size("grams") > 0), "doc_id")
    members = materialize(members, "members")
    weights = members.groupBy("component").agg(F.ceil(F.sum(F.size("grams")) / weight).cast("int").alias("parts"))
    dealt = members.join(weights, "component").withColumn("part", F.pmod(F.xxhash64("doc_id"), F.col("parts")).cast("int"))
    tasks = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda k: F.struct(F.least(k, F.col("part")).alias("i"), F.greatest(k, F.col("part")).alias("j")))
    rows = dealt.select("component", "doc_id", "part", "grams", F.explode(tasks).alias("p")).select("component", "p.i", "p.j", "part", "doc_id", "grams")
    parts = max(1, int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = rows.repartition(parts, "component", "i", "j").sortWithinPartitions("component", "i", "j")
    return rows.mapInArrow(lambda b: _within(b, threshold), "a long, b long, jaccard double")


def _least_shared(n: Column, threshold: float) -> Column:
    """N-grams that a set of n shares with any near one at least; rounding down a little keeps a pair that lies on the threshold."""
    return F.ceil(n * threshold - 1e-9)


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many rows of each document have an n-gram that other components have too, in a partition sorted by n-gram."""

    def counted(docs: np.ndarray) -> pa.RecordBatch:
        ids, counts = np.unique(docs, return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(counts.astype(np.int64))], names=["doc_id", "met"])

    held: list[np.ndarray] = []  # the last n-gram's rows, as it may go on in the next batch
    for batch in batches:
        rows = np.stack([batch.column(c).to_numpy() for c in ("g", "component", "doc_id")])
        rows = np.concatenate([*held, rows], axis=1)
        if not rows.shape[1]:
            continue
        begins = np.flatnonzero(np.concatenate([[True], rows[0, 1:] != rows[0, :-1]]))
        held = [rows[:, begins[-1] :]]
        rows, begins = rows[:, : begins[-1]], begins[:-1]
        if len(begins):
            several = np.minimum.reduceat(rows[1], begins) != np.maximum.reduceat(rows[1], begins)
            yield counted(rows[2, np.repeat(several, np.diff([*begins, rows.shape[1]]))])
    if held and held[0][1].min() != held[0][1].max():
        yield counted(held[0][2])


def met_elsewhere(sets: DataFrame, threshold: float) -> DataFrame:
    """(doc_id, component) of all sets that can have a near one in another component, for (doc_id, component, grams).

    Two near sets share o n-grams or more, and the first k of these are among
    the first n - o + k of each, in order of the hashes. So a set stays if
    enough of its first n-grams are among the first of other components.
    """
    n = F.size("grams")
    more = lambda size: F.greatest(F.lit(1), F.floor(size * MORE))
    first = sets.select("doc_id", "component", F.explode(F.slice("grams", F.lit(1), (n - _least_shared(n, threshold) + more(n)).cast("int"))).alias("g"))
    parts = max(1, int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = first.select("g", "component", "doc_id").repartition(parts, "g").sortWithinPartitions("g")
    met = rows.mapInArrow(_met, "doc_id long, met long").groupBy("doc_id").agg(F.sum("met").alias("met"))
    # the other set may be smaller, and its prefix then holds fewer of the common ones
    sizes = sets.select("doc_id", "component", more(_least_shared(n, threshold)).alias("least"))
    return sizes.join(met, "doc_id").where("met >= least").select("doc_id", "component")


def pairs_across(labelled: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """(a, b, jaccard) of all near pairs that are not in the same component, for (doc_id, component); documents without one stand alone.

    The exact counterpart of ``pairs_within``. The n-grams of one component
    alone can't link, however many members have them, and most sets have too
    few others for a near one; what is left is joined by rare n-grams.
    """
    known = sets.where(F.size("grams") > 0).join(labelled.select("doc_id", "component"), "doc_id", "left")
    known = known.select("doc_id", F.coalesce("component", "doc_id").alias("component"), "grams")
    left = materialize(met_elsewhere(known, threshold), "left")
    rest = materialize(sets.join(left, "doc_id").select("doc_id", "component", "grams"), "rest")
    n = F.size("grams")
    rows = rest.select("doc_id", "component", n.alias("n"), F.explode("grams").alias("g"))
    frequency = rows.select("g", "component").distinct().groupBy("g").agg(F.count(F.lit(1)).alias("df"))
    ranked = rows.join(frequency, "g").withColumn("place", F.row_number().over(Window.partitionBy("doc_id").orderBy("df", "g")))
    prefix = ranked.where((F.col("place") <= F.col("n") - _least_shared(F.col("n"), threshold) + 1) & (F.col("df") > 1)).select("g", "doc_id", "component", "n")
    prefix = materialize(prefix, "prefix")
    x, y = (prefix.select("g", F.col("doc_id").alias(d), F.col("component").alias(f"c{d}"), F.col("n").alias(f"n{d}")) for d in "ab")
    alike = F.least("na", "nb") >= F.greatest("na", "nb") * threshold - 1e-9
    links = x.join(y, "g").where((F.col("a") < F.col("b")) & (F.col("ca") != F.col("cb")) & alike).select("a", "b").distinct()
    return verified(links, rest.select("doc_id", "grams"), threshold)


def prefix_candidates(sets: DataFrame, threshold: float) -> DataFrame:
    known = sets.where(F.size("grams") > 0)
    rows = known.select("doc_id", F.size("grams").alias("n"), F.explode("grams").alias("g"))
    frequency = rows.groupBy("g").agg(F.count(F.lit(1)).alias("df"))
    ranked = rows.join(frequency, "g").withColumn("place", F.row_number().over(Window.partitionBy("doc_id").orderBy("df", "g")))
    # rounding down a little keeps a pair that lies on the threshold
    prefix = ranked.where((F.col("place") <= F.col("n") - F.ceil(F.col("n") * threshold - 1e-9) + 1) & (F.col("df") > 1)).select("doc_id", "n", "g")
    left = prefix.select("g", F.col("doc_id").alias("a"), F.col("n").alias("na"))
    right = prefix.select("g", F.col("doc_id").alias("b"), F.col("n").alias("nb"))
    alike = F.least("na", "nb") >= F.greatest("na", "nb") * threshold - 1e-9
    return left.join(right, "g").where((F.col("a") < F.col("b")) & alike).select("a", "b").distinct()


def near_pairs(sets: DataFrame, threshold: float = 0.7) -> DataFrame:
    """All pairs (a < b) with Jaccard at or over a threshold. ``sets`` should be a written table."""
    return verified(prefix_candidates(sets, threshold), sets, threshold)


def edges(docs: DataFrame, floor: float = 0.7) -> tuple[DataFrame, DataFrame]:
    """The written sets of representatives and their written edges, which all later steps share."""
    sets = materialize(representative_sets(docs), "sets")
    return sets, materialize(near_pairs(sets, floor), "edges")
