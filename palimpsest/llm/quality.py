"""Quality rules: a hashed n-gram log-likelihood ratio, length-normalised.

Words and word pairs are hashed into fixed numbers of buckets. Two multinomials
over the buckets are counted: one over the trusted documents (those labelled as
of good quality, less one fold), one over the raw corpus, both over whole texts
and all rows. Raw counts are scaled to the trusted total before both get the
same smoothing, so an n-gram too rare to tell counts for little. A document's
score is the mean over its n-grams of log p_trusted - log p_raw.

One threshold decides for every document. It is found from a histogram of fixed
bins over the scores of the fold of trusted documents that were not counted,
which therefore score as unlabelled ones do: of the thresholds that keep at
least ``KEEP`` of them, the one that best separates them from the documents
labelled as poor. Without poor ones nothing is rejected.

Base figures are exact and come with the score in one pass over the text.

Cases: a null text has no words; a text without words scores 0 and fails the
base rules; labels that are null, repeated or of unknown documents are ignored
(a document with both labels counts as poor); without trusted documents all
scores are 0 and the verdict is to keep; empty tables give empty results; other
columns are ignored.

Counts leave a task as one row for each bucket it met, at most ``BUCKETS`` of
each kind, so no key gathers a group. Labels are broadcast below
``BROADCAST_LABELS`` rows and joined by a shuffle beyond.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from palimpsest.sources.tables import materialize

BUCKETS = 1 << 16
SMOOTHING = 2.0
FOLDS = 5
KEEP = 0.995
BROADCAST_LABELS = 1_000_000
BINS, REACH = 4000, 10.0
SYMBOLS = b"#*$%&|<>"
_MIX = np.uint64(0x9E3779B97F4A7C15)


def grams(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of a text's words, and of its pairs of neighbouring words (after the words' own buckets)."""
    h = np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))
    pairs = (h[:-1] * _MIX) ^ (h[1:] + (h[:-1] >> np.uint64(29)))
    pairs *= _MIX
    return (h >> np.uint64(48)).astype(np.int64), (pairs >> np.uint64(48)).astype(np.int64) + BUCKETS


def base(text: bytes, words: list[bytes]) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of a text in UTF-8."""
    joined = b"".join(words)
    chars = int(np.count_nonzero((np.frombuffer(joined, np.uint8) & 0xC0) != 0x80))
    symbols = len(joined) - len(joined.translate(None, SYMBOLS))
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    return len(words), chars, symbols, len(lines) - len(set(lines)), repeated_words(words)


def repeated_words(words: list[bytes]) -> int:
    """How many words stand in a 3-word window that the text has at least twice."""
    n = len(words)
    if n < 4:
        return 0
    ids = {w: i for i, w in enumerate(dict.fromkeys(words))}
    a = np.fromiter(map(ids.__getitem__, words), np.int64, n)
    if len(ids) > 2_000_000:  # so that a window's number fits
        pair = np.unique(a[:-1] * len(ids) + a[1:], return_inverse=True)[1]
        key = pair[:-1] * len(ids) + a[2:]
    else:
        key = (a[:-2] * len(ids) + a[1:-1]) * len(ids) + a[2:]
    order = np.argsort(key, kind="stable")
    same = np.diff(key[order]) == 0
    twice = np.zeros(n - 2, bool)
    twice[order[:-1][same]] = True
    twice[order[1:][same]] = True
    covered = np.zeros(n, bool)
    covered[:-2] |= twice
    covered[1:-1] |= twice
    covered[2:] |= twice
    return int(np.count_nonzero(covered))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    raw, trusted = np.zeros(2 * BUCKETS, np.int64), np.zeros(2 * BUCKETS, np.int64)
    for batch in batches:
        for text, good in zip(batch.column("text"), batch.column("good").to_pylist(), strict=True):
            words = (text.as_py() or "").encode().split()
            if words:
                found = np.concatenate(grams(words))
                np.add.at(raw, found, 1)
                if good:
                    np.add.at(trusted, found, 1)
    met = np.flatnonzero(raw)
    yield pa.RecordBatch.from_arrays([pa.array(met.astype(np.int32)), pa.array(raw[met]), pa.array(trusted[met])], names=["bucket", "raw", "trusted"])


def _labelled(labels: DataFrame) -> DataFrame:
    """One row a labelled document: whether it is trusted, and whether it is of the fold kept for the threshold."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
    held = F.pmod(F.xxhash64("of"), F.lit(FOLDS)) == 0
    return known.groupBy(F.col("doc_id").alias("of")).agg((F.min("quality") == 1).alias("good")).withColumn("held", held)


def ratios(docs: DataFrame, labels: DataFrame) -> np.ndarray:
    """log p_trusted - log p_raw of every bucket; words and pairs have multinomials of their own."""
    good = _labelled(labels).where("good and not held").select("of", "good")
    few = good.count() <= BROADCAST_LABELS
    marked = docs.select("doc_id", "text").join(F.broadcast(good) if few else good, F.col("doc_id") == F.col("of"), "left").select("text", F.coalesce("good", F.lit(False)).alias("good"))
    counts = marked.mapInArrow(_count, "bucket int, raw long, trusted long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("trusted").alias("trusted")).toPandas()
    raw, trusted = np.zeros(2 * BUCKETS), np.zeros(2 * BUCKETS)
    raw[counts["bucket"]], trusted[counts["bucket"]] = counts["raw"], counts["trusted"]
    out = np.zeros(2 * BUCKETS)
    for part in (slice(0, BUCKETS), slice(BUCKETS, None)):
        if trusted[part].sum():
            scaled = raw[part] * (trusted[part].sum() / raw[part].sum())
            out[part] = np.log(trusted[part] + SMOOTHING) - np.log(scaled + SMOOTHING)
    return out


SCORED = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, score double"


def score(docs: DataFrame, ratio: np.ndarray) -> DataFrame:
    """Base figures and score of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(ratio)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in batches:
            figures, scores = [], []
            for text in batch.column("text"):
                data = (text.as_py() or "").encode()
                words = data.split()
                figures.append(base(data, words))
                own = np.concatenate(grams(words)) if words else ()
                scores.append(float(table[own].sum() / len(own)) if len(own) else 0.0)
            columns = list(zip(*figures, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(c, pa.int64()) for c in columns], pa.array(scores, pa.float64())], names=["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "score"])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text").mapInArrow(run, SCORED)


def threshold(scored: DataFrame, labels: DataFrame, keep: float = KEEP) -> float:
    """The score below which documents are rejected."""
    known = _labelled(labels).where("held or not good")
    bin_ = F.least(F.greatest(F.floor((F.col("score") + REACH) * (BINS / (2 * REACH))), F.lit(0)), F.lit(BINS - 1))
    got = scored.where("n_words > 0").join(known, scored["doc_id"] == known["of"]).groupBy(bin_.cast("int").alias("bin")).agg(F.count_if("good").alias("good"), F.count_if(~F.col("good")).alias("poor")).toPandas()
    good, poor = np.zeros(BINS), np.zeros(BINS)
    good[got["bin"]], poor[got["bin"]] = got["good"], got["poor"]
    if not poor.sum() or not good.sum():
        return -np.inf
    lost = np.concatenate([[0], np.cumsum(good)]) / good.sum()  # by a threshold at each bin's lower edge
    caught = np.concatenate([[0], np.cumsum(poor)]) / poor.sum()
    gain = np.where(lost <= 1 - keep, caught - lost, -1)
    best = np.flatnonzero(gain == gain.max())
    return float(best[len(best) // 2]) * (2 * REACH / BINS) - REACH


def rate(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row a document: base figures, base_failed, the score and whether it is kept."""
    scored = materialize(score(docs, ratios(docs, labels)), "scores")
    least = threshold(scored, labels)
    failed = (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)
    return scored.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("score") >= F.lit(least))).withColumn("threshold", F.lit(least))
