"""MinHash signatures, banding and candidate links."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.shingles import family, minima, scrambled, words

PRIME = 2147483647
#: The small family that SQL can compute too: h -> (a * h + b) mod PRIME.
SMALL = [(2 * (104_729 * i * i + 7_919 * i + 15_485_863) % PRIME | 1, (32_452_843 * i + 49_979_687) % PRIME) for i in range(1, 15)]
SMALL_BANDS, SMALL_ROWS = 7, 2


def band_layout(n_perm: int, bands: int, rows: int) -> list[tuple[int, int]]:
    if bands * rows > n_perm:
        raise ValueError(f"{bands} bands of {rows} rows need more than {n_perm} hashes")
    return [(i * rows, (i + 1) * rows) for i in range(bands)]


def lsh_probability(similarity: Column, bands: int, rows: int) -> Column:
    return F.lit(1.0) - F.pow(F.lit(1.0) - F.pow(similarity, F.lit(float(rows))), F.lit(float(bands)))


def estimator_sd(similarity: float, n_perm: int) -> float:
    return math.sqrt(similarity * (1 - similarity) / n_perm)


def least_matches(threshold: float, n_perm: int) -> int:
    return math.ceil(threshold * n_perm)


def small_signatures(docs: DataFrame, k: int = 5) -> DataFrame:
    """(doc_id, s1..s14) by the small family over MD5 of the n-grams' texts; shorter documents are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = (np.array(x, np.int64) for x in zip(*SMALL, strict=True))
        for batch in batches:
            ids, rows = [], []
            for i, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                found = words(text.as_py())
                own = {b" ".join(found[j : j + k]) for j in range(len(found) - k + 1)}
                if own:
                    h = np.array([int(hashlib.md5(g).hexdigest()[:7], 16) for g in own], np.int64)
                    ids.append(i)
                    rows.append(np.min([(h * x + y) % PRIME for x, y in zip(a, b, strict=True)], axis=1))
            table = np.array(rows, np.int64).reshape(len(ids), len(SMALL))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *[pa.array(table[:, c]) for c in range(len(SMALL))]], names=["doc_id", *[f"s{c + 1}" for c in range(len(SMALL))]])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, " + ", ".join(f"s{c + 1} long" for c in range(len(SMALL))))


def small_bands(signatures: DataFrame) -> DataFrame:
    """(doc_id, band, key) of the small family."""
    keys = [F.struct(F.lit(b).alias("band"), F.concat_ws("-", *[F.col(f"s{b * SMALL_ROWS + r + 1}") for r in range(SMALL_ROWS)]).alias("key")) for b in range(SMALL_BANDS)]
    return signatures.select("doc_id", F.explode(F.array(*keys)).alias("x")).select("doc_id", "x.band", "x.key")


def small_signed(signatures: DataFrame) -> DataFrame:
    """Signatures of the small family as ``signed_bands`` has them: (doc_id, bands, head)."""
    keys = [F.xxhash64(*[F.col(f"s{b * SMALL_ROWS + r + 1}") for r in range(SMALL_ROWS)]) for b in range(SMALL_BANDS)]
    return signatures.select("doc_id", F.array(*keys).alias("bands"), F.array(*[F.col(f"s{i + 1}").cast("int") for i in range(len(SMALL))]).alias("head"))


def signed_bands(grams: DataFrame, bands: int, rows: int, prefilter: int = 64, seed: int = 41_017) -> DataFrame:
    """(doc_id, bands, head): band keys and the first minima of each set, in one pass over (doc_id, grams)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = family(bands * rows, seed)
        salt = scrambled(np.arange(1, bands + 1, dtype=np.uint64))
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                lists = part.column("grams")
                offsets, values = lists.offsets.to_numpy(), lists.values.to_numpy()
                full = np.flatnonzero(offsets[1:] > offsets[:-1])
                low = np.empty((len(full), bands * rows), np.uint32)
                for row, i in enumerate(full.tolist()):
                    low[row] = minima(values[offsets[i] : offsets[i + 1]], hashes)
                table, h = low.reshape(-1, bands, rows).astype(np.uint64), np.broadcast_to(salt, (len(full), bands))
                for r in range(rows):
                    h = scrambled((h ^ table[:, :, r]) * np.uint64(0x9E3779B97F4A7C15))
                ids = part.column("doc_id").take(pa.array(full))
                columns = [pa.ListArray.from_arrays(pa.array(np.arange(len(full) + 1, dtype=np.int32) * x.shape[1]), pa.array(np.ascontiguousarray(x).ravel())) for x in (h.view(np.int64), low[:, :prefilter].view(np.int32))]
                yield pa.RecordBatch.from_arrays([ids, *columns], names=["doc_id", "bands", "head"])

    return grams.mapInArrow(run, "doc_id long, bands array<long>, head array<int>")


def explode_bands(signed: DataFrame) -> DataFrame:
    return signed.select("doc_id", F.posexplode("bands").alias("band", "key"))


def buckets(banded: DataFrame) -> DataFrame:
    """Band keys that several documents share."""
    return banded.groupBy("band", "key").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("anchor")).where("n >= 2")


def star_links(banded: DataFrame, max_bucket: int | None = None) -> DataFrame:
    """Links (a, b) from each member of a bucket to its smallest; oversized buckets are left out, as asked."""
    known = buckets(banded) if max_bucket is None else buckets(banded).where(F.col("n") <= max_bucket)
    return banded.join(known.select("band", "key", "anchor"), ["band", "key"]).where("doc_id <> anchor").select(F.col("anchor").alias("a"), F.col("doc_id").alias("b")).distinct()


def oversized_buckets(banded: DataFrame, max_bucket: int) -> DataFrame:
    return buckets(banded).where(F.col("n") > max_bucket)


def gated_links(signed: DataFrame, threshold: float = 0.4, prefilter: int = 64, small: int = 16, max_bucket: int | None = None) -> DataFrame:
    """Candidate links whose first minima agree often enough.

    Buckets of up to ``small`` members give all their pairs, at most
    ``(small - 1) / 2`` a row; larger ones each member with the smallest.
    Buckets beyond ``max_bucket`` are left out only if one is asked for.
    """
    banded = explode_bands(signed)
    known = buckets(banded) if max_bucket is None else buckets(banded).where(F.col("n") <= max_bucket)
    held = banded.join(known, ["band", "key"]).select("band", "key", "n", "anchor", F.col("doc_id"))
    few = held.where(F.col("n") <= small).groupBy("band", "key").agg(F.sort_array(F.collect_set("doc_id")).alias("ids"))
    pairs = few.select(F.explode(F.flatten(F.transform("ids", lambda x, i: F.transform(F.slice("ids", i + 2, F.size("ids")), lambda y: F.struct(x.alias("a"), y.alias("b")))))).alias("p")).select("p.*")
    stars = held.where((F.col("n") > small) & (F.col("doc_id") != F.col("anchor"))).select(F.col("anchor").alias("a"), F.col("doc_id").alias("b"))
    links = pairs.unionByName(stars).distinct()
    heads = signed.select("doc_id", "head")
    both = links.join(heads.withColumnsRenamed({"doc_id": "a", "head": "ha"}), "a").join(heads.withColumnsRenamed({"doc_id": "b", "head": "hb"}), "b")
    agree = F.size(F.filter(F.zip_with("ha", "hb", lambda x, y: x == y), lambda x: x))
    return both.where(agree >= least_matches(threshold, prefilter)).select("a", "b")


def sql_signature(i: int) -> str:
    a, b = SMALL[i]
    return f"min((h * {a}::HUGEINT + {b}) % {PRIME})::BIGINT AS s{i + 1}"


