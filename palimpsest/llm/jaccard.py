"""N-gram Jaccard join by MinHash banding, with exact verification.

Words are the lower-cased runs between ASCII white space, and a text's n-grams
are the set of its runs of five words; a shorter text is one n-gram. Two
documents are linked if the Jaccard similarity of their sets is at least 0.8.

1. One pass over the texts hashes n-grams, takes minima under a family of
   hash functions, and cuts them into bands. The numbers of bands and rows
   follow from the target recall at the threshold (``banding``).
2. Equal texts (by digest) are one text, and texts with equal n-gram sets (by
   the digest of the set) one set, with numbers of texts and documents. Only
   sets go on.
3. Band hashes are shuffled and counted. In a bucket of up to ``BUCKET``
   members, those whose short signatures agree too little for the threshold
   (by five standard deviations) are not tied; the rest are tied by a forest,
   never by all pairs. The members of a larger one are each tied to its
   smallest by a join, which ties no less, and gathers no bucket.
4. Connected components of the ties are collections of sets outside which no
   link can be. Each text is cut into n-grams once more and moves to its
   component, where all pairs are verified on full n-gram sets, by counting
   shared n-grams in blocks. A component with many n-grams or members is cut
   into parts (``parts_of``), and each pair of parts is a task of its own. What
   leaves a task is each set's number of links and a forest of the links, so
   nothing grows with the square of a group.
5. Components of the verified links give each document its class.

So all links are counted but those whose pair meets in no band and is not tied
through others; at the threshold itself that is under one in 10,000. Counting
the links of one group of near copies compares all its pairs; copies, and texts
that differ in case or white space alone, are not compared.

Cases: a null text counts as empty; texts without words are copies of each
other if equal, and not linked otherwise; equal texts and repeated rows share a
class; rows with one id and several texts share that id's class, each with the
links of its own text; a null id gets no class and no links; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from palimpsest.operators.components import connected_components
from palimpsest.sources.tables import materialize

N, THRESHOLD, RECALL, HASHES = 5, 0.8, 0.9999, 128
BUCKET = 2000
#: N-grams and members of a part of a component; beyond ``SPREAD`` parts, the n-grams that a part has at most.
WEIGHT, MEMBERS, SPREAD, MOST = 100_000, 10_000, 16, 400_000
BROADCAST_MEMBERS = 500_000
_M1, _M2, _MUL = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53), np.uint64(0x9E3779B97F4A7C15)


def banding(threshold: float = THRESHOLD, recall: float = RECALL, hashes: int = HASHES) -> tuple[int, int]:
    """Bands and rows: the most rows for which enough bands for the recall need no more hashes than given."""
    best = (hashes, 1)
    for rows in range(1, hashes + 1):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))
        if bands * rows > hashes:
            break
        best = (bands, rows)
    return best


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * _M1
    h = (h ^ (h >> np.uint64(29))) * _M2
    return h ^ (h >> np.uint64(32))


def shingles(text: str | None, n: int = N) -> np.ndarray:
    """The sorted set of a text's hashed n-grams."""
    words = (text or "").lower().encode().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = mixed(np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words)))
    k = min(n, len(words))
    rolled = h[: len(h) - k + 1].copy()
    for i in range(1, k):
        rolled = rolled * _MUL + h[i : len(h) - k + 1 + i]
    return np.unique(mixed(rolled + np.uint64(k)))


def set_id(grams: np.ndarray) -> bytes:
    return hashlib.blake2b(grams.tobytes(), digest_size=16).digest()


def _family(count: int, seed: int = 20240229) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.Generator(np.random.PCG64(seed))
    return rng.integers(0, 1 << 32, count, np.uint64).astype(np.uint32), rng.integers(0, 1 << 32, count, np.uint64).astype(np.uint32) | np.uint32(1)


def minhash(grams: np.ndarray, family: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    low = (grams >> np.uint64(32)).astype(np.uint32)
    out = np.full(len(family[0]), 0xFFFFFFFF, np.uint32)
    for at in range(0, len(low), 2048):
        out = np.minimum(out, ((low[at : at + 2048, None] ^ family[0]) * family[1]).min(0))
    return out


def _signed(batches: Iterator[pa.RecordBatch], bands: int, rows: int) -> Iterator[pa.RecordBatch]:
    """Per document: the digest of its n-gram set, n-grams, band hashes, and a signature of four bits a hash."""
    family = _family(bands * rows)
    salt = mixed(np.arange(1, bands + 1, dtype=np.uint64))
    for batch in batches:
        sizes, owns, keys, signs = [], [], [], []
        for text in batch.column("text"):
            grams = shingles(text.as_py())
            sizes.append(len(grams))
            if not len(grams):
                owns.append(None)
                keys.append(None)
                signs.append(None)
                continue
            owns.append(set_id(grams))
            least = minhash(grams, family)
            table = least.reshape(bands, rows).astype(np.uint64)
            h = salt.copy()
            for i in range(rows):
                h = mixed((h ^ table[:, i]) * _MUL)
            keys.append(h.view(np.int64))
            bits = (least >> np.uint32(28)).astype(np.uint8)
            bits = np.append(bits, 0) if len(bits) % 2 else bits
            signs.append((bits[::2] << 4 | bits[1::2]).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("content"), pa.array(owns, pa.binary()), pa.array(sizes, pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(signs, pa.binary())], names=["doc_id", "content", "own", "grams", "bands", "sign"])


def sign(docs: DataFrame, bands: int, rows: int) -> DataFrame:
    text = F.coalesce(docs["text"], F.lit(""))
    rows_ = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.unhex(F.sha2(text, 256)).alias("content"), "text")
    return rows_.mapInArrow(lambda b: _signed(b, bands, rows), "doc_id long, content binary, own binary, grams long, bands array<long>, sign binary")


class _Forest:
    def __init__(self, n: int):
        self.parent = list(range(n))

    def find(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = i = self.parent[self.parent[i]]
        return i

    def tie(self, i: int, j: int) -> bool:
        a, b = self.find(i), self.find(j)
        if a == b:
            return False
        self.parent[max(a, b)] = min(a, b)
        return True


def _runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The runs of equal keys in a sorted partition, whole; a run is held while it lasts."""
    held: list[pa.RecordBatch] = []
    last = None

    def cut(table: pa.RecordBatch) -> np.ndarray:
        change = np.zeros(max(0, table.num_rows - 1), bool)
        for k in keys:
            v = table.column(k).to_numpy(zero_copy_only=False)
            change |= v[1:] != v[:-1]
        return np.flatnonzero(change) + 1

    for batch in batches:
        if not batch.num_rows:
            continue
        first = tuple(batch.column(k)[0].as_py() for k in keys)
        if held and first != last:
            yield pa.Table.from_batches(held)
            held = []
        ends = [0, *cut(batch).tolist(), batch.num_rows]
        for a, b in zip(ends, ends[1:], strict=False):
            if held and a > 0:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
        last = tuple(batch.column(k)[batch.num_rows - 1].as_py() for k in keys)
    if held:
        yield pa.Table.from_batches(held)


_SAME = np.array([[(x >> 4 == 0) + (x & 15 == 0) for x in range(256)]], np.uint8).ravel()


def _ties(batches: Iterator[pa.RecordBatch], hashes: int, threshold: float) -> Iterator[pa.RecordBatch]:
    """A forest of ties for each bucket of a partition sorted by band hash. A bucket has ``BUCKET`` members at most."""
    p = threshold + (1 - threshold) / 16
    enough = hashes * p - 5 * math.sqrt(hashes * p * (1 - p))
    pad = hashes % 2  # an odd signature ends in a nibble that always agrees
    a: list[int] = []
    b: list[int] = []
    for run in _runs(batches, ["band"]):
        ids = run.column("rep").to_numpy()
        order = np.argsort(ids, kind="stable")
        ids = ids[order]
        if len(ids) > 1:
            signs = np.frombuffer(b"".join(run.column("sign").to_pylist()), np.uint8).reshape(len(ids), -1)[order]
            forest = _Forest(len(ids))
            for i in range(len(ids) - 1):
                agree = _SAME[signs[i + 1 :] ^ signs[i]].sum(1, dtype=np.int64) - pad
                for j in np.flatnonzero(agree >= enough).tolist():
                    if forest.tie(i, i + 1 + j):
                        a.append(int(ids[i + 1 + j]))
                        b.append(int(ids[i]))
        if len(a) >= 50_000:
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
            a, b = [], []
    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _shared(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many n-grams each left set shares with each right one, by products over blocks of n-grams."""
    grams, inverse = np.unique(np.concatenate([*left, *right]), return_inverse=True)
    row = np.repeat(np.arange(len(left) + len(right)), [len(x) for x in (*left, *right)])
    common = np.bincount(inverse, minlength=len(grams)) > 1
    place = np.cumsum(common) - 1
    keep = common[inverse]
    row, column = row[keep], place[inverse[keep]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    out = np.zeros((len(left), len(right)), np.float32)
    width = max(64, 4_000_000 // max(1, len(left) + len(right)))
    for at in range(0, int(place[-1]) + 1 if len(place) else 0, width):
        a, b = np.searchsorted(column, [at, at + width])
        if a < b:
            block = np.zeros((len(left) + len(right), width), np.float32)
            block[row[a:b], column[a:b] - at] = 1
            out += block[: len(left)] @ block[len(left) :].T
    return out


def near(left: list[np.ndarray], right: list[np.ndarray], threshold: float = THRESHOLD) -> Iterator[tuple[int, np.ndarray]]:
    """Which right sets (columns) the left ones (rows) are linked with, by blocks of rows with their first place."""
    sizes = np.array([len(x) for x in right])
    for at in range(0, len(left), 256):
        part = left[at : at + 256]
        if len(part) * len(right) <= 4:
            shared = np.array([[len(np.intersect1d(x, y, assume_unique=True)) for y in right] for x in part], np.float64)
        else:
            shared = _shared(part, right).astype(np.float64)
        union = np.array([len(x) for x in part])[:, None] + sizes - shared
        yield at, (shared >= threshold * union) & (shared > 0)


FOUND = "own binary, rep long, other long, texts long, documents long"


def _verified(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """Link counts of sets (own), and a forest of links (rep, other), from tasks of (component, part, part)."""
    for run in _runs(batches, ["component", "i", "j"]):
        columns = zip(*[run.column(c).to_pylist() for c in ("part", "rep", "own", "texts", "documents", "grams")], strict=True)
        rows = sorted({r[1:3]: r for r in columns}.values(), key=lambda r: r[:3])  # a repeated row is one set
        i, j = run.column("i")[0].as_py(), run.column("j")[0].as_py()
        ranks = [[k for k, r in enumerate(rows) if r[0] == part] for part in (i, j)]
        grams = [[np.frombuffer(rows[k][5], np.uint64) for k in places] for places in ranks]
        places = [np.array(x, np.int64) for x in ranks]
        held = np.array([r[3:5] for r in rows], np.float64).reshape(len(rows), 2)
        counts, label, ties = np.zeros((len(rows), 2)), np.arange(len(rows)), []
        for at, linked in near(grams[0], grams[1], threshold):
            if i == j:  # each pair once
                linked &= np.arange(len(places[1])) > np.arange(at, at + len(linked))[:, None]
            whole = linked.astype(np.float64)
            counts[places[0][at : at + len(linked)]] += whole @ held[places[1]]
            counts[places[1]] += whole.T @ held[places[0][at : at + len(linked)]]
            for x in np.flatnonzero(linked.any(1)):
                one, others = places[0][at + x], places[1][linked[x]]
                groups, first = np.unique(label[others], return_index=True)
                for group, k in zip(groups.tolist(), first.tolist(), strict=True):
                    if group != label[one]:
                        ties.append((rows[others[k]][1], rows[one][1]))
                        label[label == group] = label[one]
        met = np.flatnonzero(counts[:, 0])
        if len(met):
            none = [None] * len(ties)
            yield pa.RecordBatch.from_arrays(
                [pa.array([*(rows[k][2] for k in met), *none], pa.binary()), pa.array([*[None] * len(met), *(t[0] for t in ties)], pa.int64()), pa.array([*[None] * len(met), *(t[1] for t in ties)], pa.int64()),
                 pa.array([*counts[met, 0].astype(np.int64).tolist(), *none], pa.int64()), pa.array([*counts[met, 1].astype(np.int64).tolist(), *none], pa.int64())],
                names=["own", "rep", "other", "texts", "documents"],
            )


CUT = "component long, own binary, rep long, texts long, documents long, parts int, part int, grams binary"


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replaces members' texts by their n-grams; a text of the same id that is another set's is left out."""
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            sets = [shingles(t.as_py()) for t in part.column("text")]
            keep = pa.array([len(g) > 0 and set_id(g) == own for g, own in zip(sets, part.column("own").to_pylist(), strict=True)], pa.bool_())
            names = [n for n in part.schema.names if n != "text"]
            yield pa.RecordBatch.from_arrays([*[part.column(n) for n in names], pa.array([g.tobytes() for g in sets], pa.binary())], names=[*names, "grams"]).filter(keep)


def parts_of(grams: Column, members: Column) -> Column:
    """The parts of a component: of ``WEIGHT`` n-grams up to ``SPREAD`` parts, then larger ones, since each pair of parts reads two."""
    by_weight = F.greatest(F.least(F.ceil(grams / WEIGHT), F.lit(SPREAD)), F.ceil(grams / max(WEIGHT, MOST)))
    return F.greatest(by_weight, F.ceil(members / MEMBERS)).cast("int")


def _tied(sets: DataFrame, bands: int, rows: int, threshold: float) -> DataFrame:
    """Ties (a, b) of sets that share a band."""
    slim = sets.select("rep", F.explode("bands").alias("band"))
    shared = slim.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.min("rep").alias("least")).where("n > 1")
    held = materialize(slim.join(shared, "band"), "held")
    stars = held.where((F.col("n") > BUCKET) & (F.col("rep") != F.col("least"))).select(F.col("rep").alias("a"), F.col("least").alias("b"))
    parts = max(1, int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    small = held.where(F.col("n") <= BUCKET).select("band", "rep").join(sets.select("rep", "sign"), "rep").repartition(parts, "band").sortWithinPartitions("band").select("band", "rep", "sign")
    return small.mapInArrow(lambda b: _ties(b, bands * rows, threshold), "a long, b long").unionByName(stars)


def classes(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """One row a document: doc_id, class_id, rep_id, n_copies, n_text_links, n_links.

    ``class_id`` is the smallest id of all that are linked, in one step or
    several; ``rep_id`` the smallest id with an equal text; ``n_copies`` the
    other documents with an equal text; ``n_text_links`` the other texts that
    are linked; ``n_links`` the documents that are linked, copies included.
    """
    bands, rows = banding(threshold, recall)
    signed = materialize(sign(docs, bands, rows), "signed")
    texts = signed.groupBy("content").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first(F.struct("own", "grams", "bands", "sign")).alias("x"))
    texts = materialize(texts.select("content", "rep", "copies", "x.*"), "texts")
    alike = texts.where("rep is not null and own is not null").groupBy("own")
    sets = alike.agg(F.min("rep").alias("rep"), F.count(F.lit(1)).alias("texts"), F.sum("copies").alias("documents"), F.first(F.struct("grams", "bands", "sign")).alias("x"))
    sets = materialize(sets.select("own", "rep", "texts", "documents", "x.*"), "sets")
    groups = connected_components(_tied(sets, bands, rows, threshold))
    members = materialize(groups.join(sets.select("own", "rep", "texts", "documents", "grams"), groups["vertex"] == sets["rep"]).select("component", "own", "rep", "texts", "documents", "grams"), "members")
    # a large component is dealt into parts, and each pair of parts is a task
    sizes = members.groupBy("component").agg(parts_of(F.sum("grams"), F.count(F.lit(1))).alias("parts"))
    dealt = members.drop("grams").join(sizes, "component").withColumn("part", F.pmod(F.xxhash64("own"), F.col("parts")).cast("int"))
    # few members are broadcast, so that only their texts move; many are joined by a shuffle
    few = members.count() <= BROADCAST_MEMBERS
    text = docs.select(docs["doc_id"].cast("long").alias("id"), docs["text"])
    dealt = text.join(F.broadcast(dealt) if few else dealt.hint("merge"), F.col("id") == F.col("rep")).drop("id")
    cut = dealt.mapInArrow(_cut, CUT)
    pairs = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda k: F.struct(F.least(k, F.col("part")).alias("i"), F.greatest(k, F.col("part")).alias("j")))
    tasks = cut.select("component", "own", "rep", "texts", "documents", "part", "grams", F.explode(pairs).alias("p")).select("component", "p.i", "p.j", "part", "rep", "own", "texts", "documents", "grams")
    parts = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    tasks = tasks.repartition(parts, "component", "i", "j").sortWithinPartitions("component", "i", "j")
    found = materialize(tasks.mapInArrow(lambda b: _verified(b, threshold), FOUND), "found")
    counts = found.where("own is not null").groupBy("own").agg(F.sum("texts").alias("more_texts"), F.sum("documents").alias("more_documents"))
    joined = connected_components(found.where("own is null").select(F.col("rep").alias("a"), F.col("other").alias("b"))).withColumnRenamed("vertex", "rep")
    per_set = sets.select("own", "rep", "texts", "documents").join(counts, "own", "left").join(joined, "rep", "left")
    zero = F.lit(0).cast("long")
    per_set = per_set.select("own", F.coalesce("component", "rep").alias("class"), (F.col("texts") - 1 + F.coalesce("more_texts", zero)).alias("links"), (F.col("documents") - 1 + F.coalesce("more_documents", zero)).alias("documents"))
    per = texts.select("content", "rep", "copies", "own").join(per_set, "own", "left")
    out = signed.select("doc_id", "content").join(per, "content")
    return out.select(
        "doc_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("class", "rep")).alias("class_id"), F.col("rep").alias("rep_id"), (F.col("copies") - 1).cast("long").alias("n_copies"),
        F.coalesce("links", zero).alias("n_text_links"), F.coalesce("documents", F.col("copies") - 1).cast("long").alias("n_links"),
    )


def deduplicated(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents with one left of each class: that with the smallest id. Rows without an id stay.

    Of several rows with that id stays the one whose text has the smallest
    digest (then by a hash of the row), so reruns agree.
    """
    kept = classes(docs, threshold).where("doc_id = class_id").select("doc_id").distinct()
    rows = docs.select(docs["doc_id"].cast("long").alias("id"), F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    stay = rows.join(kept, rows["id"] == kept["doc_id"], "left_semi")
    hashed = [F.col("row").getField(c) for c, t in docs.dtypes if "map<" not in t]
    order = Window.partitionBy("id").orderBy(F.sha2(F.coalesce(F.col("row").getField("text"), F.lit("")), 256), F.xxhash64(*hashed))
    first = stay.withColumn("n", F.row_number().over(order)).where("n = 1")
    return first.unionByName(rows.where("id is null").withColumn("n", F.lit(1))).select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
