"""Complete-linkage clusters of near duplicates, and what they say about a corpus."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions.text import bucket_label
from palimpsest.operators.components import connected_components
from palimpsest.sources.tables import materialize

#: Members of a component whose links are held in memory; those of a larger one are kept in a file.
MAX_COMPONENT = 40_000
#: Inclusive bands of component sizes.
SIZE_BANDS = [(2, 2), (3, 9), (10, 99), (100, 999), (1000, 9999), (10_000, None)]


def greedy_cliques(links: dict[int, set[int]]) -> list[list[int]]:
    """Disjoint groups in which all are linked, for neighbours by member.

    Members are taken in descending number of links, then ascending id; each
    that is still free opens a group, and later free ones join it if they are
    linked with all its members.
    """
    order = sorted(links, key=lambda v: (-len(links[v]), v))
    place = {v: i for i, v in enumerate(order)}
    taken: set[int] = set()
    groups = []
    for seed in order:
        if seed in taken:
            continue
        group, common = [seed], links[seed] - taken
        for v in sorted((u for u in common if place[u] > place[seed]), key=place.__getitem__):
            if v in common:
                group.append(v)
                common = common & links[v]
        taken.update(group)
        if len(group) > 1:
            groups.append(sorted(group))
    return groups


def components(edges: DataFrame) -> DataFrame:
    """(doc_id, component) of all documents with an edge."""
    return connected_components(edges).select(F.col("vertex").alias("doc_id"), "component")


def component_sizes(labelled: DataFrame) -> DataFrame:
    return labelled.groupBy("component").agg(F.count(F.lit(1)).alias("size"))


def oversized(labelled: DataFrame, most: int = MAX_COMPONENT, shown: int = 50) -> DataFrame:
    """Components that are partitioned with their links in a file, with their first ids."""
    large = component_sizes(labelled).where(F.col("size") > most)
    rank = F.row_number().over(Window.partitionBy("component").orderBy("doc_id"))
    first = labelled.join(large, "component").withColumn("rank", rank).where(F.col("rank") <= shown)
    return first.groupBy("component", "size").agg(F.sort_array(F.collect_list("doc_id")).alias("doc_ids"))


def greedy_places(first: np.ndarray, starts: np.ndarray, later: np.ndarray, n: int) -> Iterator[list[int]]:
    """The groups of ``greedy_cliques``, for places 0..n-1 in its order.

    ``later[starts[k] : starts[k + 1]]`` are the ascending later neighbours of
    the place ``first[k]``. Members of a group join in order, so each
    needs only its links to later ones.
    """
    taken = np.zeros(n, bool)
    at = {int(p): k for k, p in enumerate(first)}

    def after(p: int) -> np.ndarray:
        k = at.get(p)
        return np.zeros(0, later.dtype) if k is None else np.unique(later[starts[k] : starts[k + 1]])

    for seed in first.tolist():
        if taken[seed]:
            continue
        group, common = [seed], after(seed)
        common = common[~taken[common]]
        while len(common):
            v = int(common[0])
            group.append(v)
            common = np.intersect1d(common[1:], after(v), assume_unique=True)
        taken[group] = True
        if len(group) > 1:
            yield group


def _large(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(component, seed, place) of groups, from rows (component, n, p, q) sorted by component, p and q."""

    def groups(component: int, n: int, file, first: list[int], counts: list[int]) -> Iterator[pa.RecordBatch]:
        file.flush()
        later = np.memmap(file.name, np.int32, "r")
        rows: list[tuple[int, int]] = []
        for group in greedy_places(np.array(first), np.cumsum([0, *counts]), later, n):
            rows += [(group[0], p) for p in group]
            if len(rows) >= 50_000:
                yield batch_of(component, rows)
                rows = []
        if rows:
            yield batch_of(component, rows)

    def batch_of(component: int, rows: list[tuple[int, int]]) -> pa.RecordBatch:
        seeds, places = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array([component] * len(rows), pa.int64()), pa.array(seeds, pa.int64()), pa.array(places, pa.int64())], names=["component", "seed", "place"])

    last, n, file, first, counts = None, 0, None, [], []
    for batch in batches:
        component, size, p, q = (batch.column(c).to_numpy() for c in ("component", "n", "p", "q"))
        cuts = np.flatnonzero((component[1:] != component[:-1]) | (p[1:] != p[:-1])) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(p)], strict=True):
            if a == b:
                continue
            if component[a] != last:
                if file:
                    yield from groups(last, n, file, first, counts)
                    file.close()
                last, n, file, first, counts = int(component[a]), int(size[a]), tempfile.NamedTemporaryFile(), [], []
            if first and first[-1] == p[a]:
                counts[-1] += b - a
            else:
                first.append(int(p[a]))
                counts.append(b - a)
            file.write(q[a:b].astype(np.int32).tobytes())
    if file:
        yield from groups(last, n, file, first, counts)
        file.close()


def large_partition(tied: DataFrame) -> DataFrame:
    """The clusters of links (component, a, b), as ``partition`` has them, for components of any size.

    Spark orders the members and sorts the links; a task holds a component's
    members, and reads their links from a file. The greedy choice is
    sequential, so a component is one task.
    """
    ends = tied.select("component", F.explode(F.array(F.struct(F.col("a").alias("doc_id"), F.col("b").alias("other")), F.struct(F.col("b").alias("doc_id"), F.col("a").alias("other")))).alias("x")).select("component", "x.*")
    degrees = ends.groupBy("component", "doc_id").agg(F.count_distinct("other").alias("degree"))
    order = Window.partitionBy("component").orderBy(F.desc("degree"), "doc_id")
    places = degrees.select("component", "doc_id", (F.row_number().over(order) - 1).cast("long").alias("place"))
    places = materialize(places, "places")
    sizes = places.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    a, b = (places.select("component", F.col("doc_id").alias(k), F.col("place").alias(f"p{k}")) for k in "ab")
    rows = tied.join(a, ["component", "a"]).join(b, ["component", "b"]).join(sizes, "component")
    rows = rows.select("component", "n", F.least("pa", "pb").alias("p"), F.greatest("pa", "pb").alias("q"))
    parts = max(1, int(tied.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = rows.repartition(parts, "component").sortWithinPartitions("component", "p", "q")
    found = materialize(rows.mapInArrow(_large, "component long, seed long, place long"), "groups").join(places, ["component", "place"])
    names = found.groupBy("component", "seed").agg(F.min("doc_id").alias("cluster"))
    return found.join(names, ["component", "seed"]).select("cluster", "component", "doc_id")


def partitions(edges: DataFrame, thresholds: tuple[float, ...], labelled: DataFrame | None = None, most: int = MAX_COMPONENT) -> DataFrame:
    """(threshold, cluster, component, doc_id) of clusters with at least two members, at several thresholds.

    A component is one group of rows, which all thresholds share; those over
    ``most`` members go through ``large_partition``, which gives the same
    clusters. A cluster is named by its smallest id.
    """
    labelled = components(edges) if labelled is None else labelled
    sizes = component_sizes(labelled)
    known = edges.where(F.col("jaccard") >= min(thresholds)).join(labelled.withColumnRenamed("doc_id", "a"), "a")
    tied = known.join(sizes.where(F.col("size") <= most), "component").select("component", "a", "b", "jaccard")

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        found = []
        for threshold in thresholds:
            links: dict[int, set[int]] = {}
            near = rows[rows["jaccard"] >= threshold]
            for a, b in zip(near["a"].tolist(), near["b"].tolist(), strict=True):
                links.setdefault(a, set()).add(b)
                links.setdefault(b, set()).add(a)
            found += [(threshold, g[0], key[0], v) for g in greedy_cliques(links) for v in g]
        return pd.DataFrame(found, columns=["threshold", "cluster", "component", "doc_id"]).astype({"threshold": "float64", "cluster": "int64", "component": "int64", "doc_id": "int64"})

    found = tied.groupBy("component").applyInPandas(run, "threshold double, cluster long, component long, doc_id long")
    large = sizes.where(F.col("size") > most)
    if large.isEmpty():
        return found
    links = known.join(large, "component")
    for threshold in thresholds:
        more = large_partition(links.where(F.col("jaccard") >= threshold).select("component", "a", "b"))
        found = found.unionByName(more.withColumn("threshold", F.lit(float(threshold))))
    return found


def partition(edges: DataFrame, threshold: float, labelled: DataFrame | None = None, most: int = MAX_COMPONENT) -> DataFrame:
    """(cluster, component, doc_id) of ``partitions`` at one threshold."""
    return partitions(edges, (threshold,), labelled, most).drop("threshold")


def clusters(members: DataFrame, edges: DataFrame) -> DataFrame:
    """One row a cluster: component, size, ids, least and mean Jaccard of its pairs, unrounded."""
    a = members.select(F.col("cluster"), F.col("doc_id").alias("a"))
    b = members.select(F.col("cluster").alias("cb"), F.col("doc_id").alias("b"))
    inner = edges.join(a, "a").join(b, "b").where("cluster = cb").groupBy("cluster").agg(F.min("jaccard").alias("min_jaccard"), F.avg("jaccard").alias("mean_jaccard"), F.count(F.lit(1)).alias("pairs"))
    sized = members.groupBy("cluster", "component").agg(F.count(F.lit(1)).alias("size"), F.sort_array(F.collect_list("doc_id")).alias("doc_ids"))
    return sized.join(inner, "cluster")


def check(found: DataFrame, threshold: float) -> DataFrame:
    """The least similarity within clusters, pairs below the threshold, and pairs that are missing."""
    whole = F.col("size") * (F.col("size") - 1) / 2
    return found.agg(F.min("min_jaccard").alias("worst"), F.count_if(F.col("min_jaccard") < threshold).alias("violations"), F.count_if(F.col("pairs") != whole).alias("incomplete"))


def floor_of_lines(lines: DataFrame) -> DataFrame:
    """(threshold, clusters, worst) from raw JSON lines of clusters, by a pattern. ``lines`` has value and threshold."""
    found = F.regexp_extract("value", r'"min_jaccard":\s*([0-9.eE+-]+)', 1)
    return lines.groupBy("threshold").agg(F.count(F.lit(1)).alias("clusters"), F.min(found.cast("double")).alias("worst"))


def summary(found: DataFrame, total_docs: int) -> DataFrame:
    return found.agg(
        F.count(F.lit(1)).alias("clusters"), F.coalesce(F.sum("size"), F.lit(0)).alias("docs"), F.coalesce(F.sum(F.col("size") - 1), F.lit(0)).alias("redundant"),
        F.avg("size").alias("mean_size"), F.max("size").alias("max_size"), F.percentile("min_jaccard", 0.05).alias("p05_min_jaccard"),
    ).withColumn("rate", F.col("redundant") / F.lit(float(max(1, total_docs)))).withColumn("kept", F.lit(total_docs) - F.col("redundant"))


def top_clusters(found: DataFrame, n: int = 15) -> DataFrame:
    return found.orderBy(F.desc("size"), "cluster").limit(n)


def drop_list(members: DataFrame) -> DataFrame:
    """All but the smallest id of each cluster, which names it."""
    return members.where("doc_id <> cluster").select("doc_id")


def top_components(labelled: DataFrame, n: int = 20) -> DataFrame:
    return component_sizes(labelled).orderBy(F.desc("size"), "component").limit(n)


def component_histogram(labelled: DataFrame) -> DataFrame:
    size = F.col("size")
    band = bucket_label(size, SIZE_BANDS)
    return component_sizes(labelled).groupBy(band.alias("size_band")).agg(F.count(F.lit(1)).alias("components"), F.sum("size").alias("docs"))


def chaining_gap(edges: DataFrame, threshold: float, members: DataFrame) -> DataFrame:
    """Documents that single linkage puts together but complete linkage doesn't."""
    single = components(edges.where(F.col("jaccard") >= threshold)).agg(F.count(F.lit(1)).alias("single_linkage_docs"))
    return single.join(members.agg(F.count(F.lit(1)).alias("clique_docs"))).withColumn("gap", F.col("single_linkage_docs") - F.col("clique_docs"))
