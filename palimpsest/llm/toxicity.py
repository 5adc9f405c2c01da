"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

A bounded sample of the labelled rows (``TOXIC_ROWS`` and ``CLEAN_ROWS``, in
the order of a hash of their ids; none of the held-out fold) teaches three
things. A lexicon of words and of word beginnings holds what is far commoner in
toxic documents. Trees are boosted on features from whole texts: densities of
lexicon words and beginnings, nearness to second-person words, rates of
capitals, of punctuation and of obfuscated spellings. An isotonic step turns
margins into probabilities, from margins of trees that haven't seen the row.
Features of sample rows come from a lexicon counted without the row's fold.
Rows weigh as their class does among all labelled rows.

Each document is then scored from its own whole text alone.

Cases: a null text counts as empty; an empty text has a score like any other;
null labels, repeated labels (the largest counts) and labels of unknown
documents do no harm; without labels of both kinds every score is the share of
toxic labels, or 0; a null id counts as held out; repeated rows score alike;
empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.sources.tables import materialize, unused

TOXIC_ROWS, CLEAN_ROWS = 4000, 8000
FOLDS = 3
STEM = 4
TREES, DEPTH, RATE, BINS, LEAST_WEIGHT, RIDGE = 60, 3, 0.2, 32, 3.0, 1.0
#: Second-person words of the corpus's languages.
SECOND = frozenset("you your yours yourself u ur ya du dich dir dein deine deiner euch euer ihr tu toi te ton ta tes vous votre vos tú ti usted ustedes vosotros su tus".split())
#: Letters that digits and signs stand in for.
LEET = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "*": None})
WORD = re.compile(r"[^\W_]+")
INNER = re.compile(r"(?<=[A-Za-z])[0-9@$!*](?=[A-Za-z])")
MIXED = re.compile(r"[A-Za-z]+(?:[0-9@$!*]+[A-Za-z]+)+")
SHOUTED = re.compile(r"[A-ZÀ-Þ]{2,}")
CAPITALS, MARKS, STRONG = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"!\"#$%&'()*+,-./:;<=>?@[]^_`{|}~", b"!?"
NEAR = 50
FEATURES = ("log_words", "hit_density", "log_hits", "weight_density", "top_weight", "stem_density", "log_stems", "top_stem", "nearness", "second_rate", "capital_rate", "shout_rate", "strong_rate", "mark_rate", "mixed_rate", "log_unmasked")


def features(text: str, words: dict[str, float], stems: dict[str, float]) -> list[float]:
    """The dense features of a whole text under a lexicon with weights."""
    found = WORD.findall(text.lower())
    n = max(1, len(found))
    hits = [i for i, w in enumerate(found) if w in words]
    rooted = [i for i, w in enumerate(found) if w[:STEM] in stems]
    weights = [words[found[i]] for i in hits]
    second = [i for i, w in enumerate(found) if w in SECOND]
    nearness = 0.0
    marked = sorted({*hits, *rooted})
    if second and marked:
        a, b = np.asarray(second), np.asarray(marked)
        at = np.searchsorted(a, b)
        gap = np.minimum(np.abs(b - a[np.minimum(at, len(a) - 1)]), np.abs(b - a[np.maximum(at - 1, 0)])).min()
        nearness = max(0.0, 1 - float(gap) / NEAR)
    data = text.encode()
    size = max(1, len(data))

    def share(chars: bytes) -> float:
        return (len(data) - len(data.translate(None, chars))) / size

    mixed = [m.lower() for m in MIXED.findall(text)] if INNER.search(text) else []
    plain = [m.translate(LEET) for m in mixed]
    unmasked = sum(w in words or w[:STEM] in stems for w in plain)
    return [
        np.log1p(len(found)), len(hits) / n, np.log1p(len(hits)), sum(weights) / n, max(weights, default=0.0),
        len(rooted) / n, np.log1p(len(rooted)), max((stems[found[i][:STEM]] for i in rooted), default=0.0), nearness, len(second) / n,
        share(CAPITALS), len(SHOUTED.findall(text)) / n, share(STRONG), share(MARKS), len(mixed) / n, np.log1p(unmasked),
    ]


def matrix(texts: list[str | None], words: dict[str, float], stems: dict[str, float]) -> np.ndarray:
    return np.array([features(t or "", words, stems) for t in texts], np.float64).reshape(len(texts), len(FEATURES))


@dataclass
class Trees:
    """Boosted trees of one depth for the logistic loss, over binned features."""

    prior: float = 0.0
    feature: list[np.ndarray] = field(default_factory=list)
    bound: list[np.ndarray] = field(default_factory=list)
    leaf: list[np.ndarray] = field(default_factory=list)

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> Trees:
        share = np.clip((y * weight).sum() / weight.sum(), 1e-6, 1 - 1e-6)
        self.prior = float(np.log(share / (1 - share)))
        edges = [np.unique(np.quantile(c[c != 0] if (c != 0).any() else c, np.linspace(0, 1, BINS)[:-1])) for c in x.T]
        edges = [np.unique(np.concatenate([[0.0], (e[1:] + e[:-1]) / 2, [e[0] / 2]])) for e in edges]
        binned = np.column_stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T, strict=True)])
        width, k = BINS + 3, x.shape[1]
        margin = np.full(len(y), self.prior)
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-margin))
            slope, bend = weight * (y - p), np.maximum(weight * p * (1 - p), 1e-12)
            node = np.zeros(len(y), np.int64)
            feature, bound = np.zeros(2**DEPTH - 1, np.int64), np.full(2**DEPTH - 1, np.inf)
            for level in range(DEPTH):
                count, first = 2**level, 2**level - 1
                key = ((node[:, None] * k + np.arange(k)) * width + binned).ravel()
                g, h = (np.bincount(key, np.repeat(v, k), count * k * width).reshape(count, k, width) for v in (slope, bend))
                gl, hl = g.cumsum(2), h.cumsum(2)
                gt, ht = gl[:, :, -1:], hl[:, :, -1:]
                gain = gl**2 / (hl + RIDGE) + (gt - gl) ** 2 / (ht - hl + RIDGE) - gt**2 / (ht + RIDGE)
                gain[(hl < LEAST_WEIGHT / 10) | (ht - hl < LEAST_WEIGHT / 10)] = -1
                flat = gain.reshape(count, -1)
                best = flat.argmax(1)
                for i in range(count):
                    f, b = divmod(int(best[i]), width)
                    if flat[i, best[i]] > 1e-9 and b < len(edges[f]):
                        feature[first + i], bound[first + i] = f, edges[f][b]
                own = first + node
                node = 2 * node + (x[np.arange(len(y)), feature[own]] > bound[own])
            total, curve = (np.bincount(node, v, 2**DEPTH) for v in (slope, bend))
            leaf = RATE * total / (curve + RIDGE)
            margin += leaf[node]
            self.feature.append(feature)
            self.bound.append(bound)
            self.leaf.append(leaf)
        return self

    def margin(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.prior), np.arange(len(x))
        for feature, bound, leaf in zip(self.feature, self.bound, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            for level in range(DEPTH):
                own = 2**level - 1 + node
                node = 2 * node + (x[rows, feature[own]] > bound[own])
            out += leaf[node]
        return out


def isotonic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The weighted least-squares nondecreasing fit, as points to interpolate between."""
    places, inverse = np.unique(x, return_inverse=True)
    w = np.bincount(inverse, weight)
    means = np.bincount(inverse, weight * y) / w
    blocks: list[list[float]] = []  # mean, weight, first and last place
    for at, mean, own in zip(places, means, w, strict=True):
        blocks.append([mean, own, at, at])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            b, a = blocks.pop(), blocks.pop()
            blocks.append([(a[0] * a[1] + b[0] * b[1]) / (a[1] + b[1]), a[1] + b[1], a[2], b[3]])
    points = [(p, b[0]) for b in blocks for p in ([b[2], b[3]] if b[2] < b[3] else [b[2]])]
    return np.array([p for p, _ in points]), np.array([v for _, v in points])


@dataclass
class Model:
    """All that scoring a text needs."""

    words: dict[str, float] = field(default_factory=dict)
    stems: dict[str, float] = field(default_factory=dict)
    trees: Trees = field(default_factory=Trees)
    margins: np.ndarray = field(default_factory=lambda: np.zeros(1))
    chances: np.ndarray = field(default_factory=lambda: np.zeros(1))

    def score(self, texts: list[str | None]) -> np.ndarray:
        margin = self.trees.margin(matrix(texts, self.words, self.stems))
        return np.clip(np.interp(margin, self.margins, self.chances), 0.0, 1.0)


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each term, kind, class and fold of a few documents, with their number."""
    for batch in (b.slice(at, 64) for b in batches for at in range(0, b.num_rows, 64)):
        counts: Counter = Counter()
        for text, toxic, fold in zip(batch.column("text"), batch.column("toxic").to_pylist(), batch.column("fold").to_pylist(), strict=True):
            found = set(WORD.findall((text.as_py() or "").lower()))
            counts.update((w, False, toxic, fold) for w in found)
            counts.update((w, True, toxic, fold) for w in {w[:STEM] for w in found if len(w) >= STEM})
        if counts:
            term, stem, toxic, fold = zip(*counts, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(term, pa.string()), pa.array(stem), pa.array(toxic, pa.int32()), pa.array(fold, pa.int32()), pa.array(list(counts.values()), pa.int64())], names=["term", "stem", "toxic", "fold", "n"])


def _stands_out(toxic: Column, clean: Column, n_toxic: float, n_clean: float) -> Column:
    """Whether ``_lexicon`` may keep a term, with a little slack for rounding."""
    ratio = F.log((toxic + 0.5) / (n_toxic + 1)) - F.log((clean + 0.5) / (n_clean + 1))
    return (toxic >= 2) & (ratio / F.sqrt(1 / (toxic + 0.5) + 1 / (clean + 0.5)) > 1.59) & (ratio > 1.49)


def _lexicon(counts, folds: list[int], n: np.ndarray) -> tuple[dict[str, float], dict[str, float]]:
    """Terms whose share of toxic documents stands out, with their log ratio; counted over some folds."""
    toxic, clean = (sum(counts[f"{k}{f}"].to_numpy(np.float64) for f in folds) for k in ("t", "c"))
    n_toxic, n_clean = max(1, n[folds, 1].sum()), max(1, n[folds, 0].sum())
    ratio = np.log((toxic + 0.5) / (n_toxic + 1)) - np.log((clean + 0.5) / (n_clean + 1))
    spread = np.sqrt(1 / (toxic + 0.5) + 1 / (clean + 0.5))
    kept = (toxic >= 2) & (ratio / spread > 1.6) & (ratio > 1.5)
    stem = counts["stem"].to_numpy(bool)
    return tuple({t: float(r) for t, r in zip(counts["term"][kept & s], ratio[kept & s], strict=True)} for s in (~stem, stem))


def train(docs: DataFrame, labels: DataFrame, toxic_rows: int = TOXIC_ROWS, clean_rows: int = CLEAN_ROWS) -> Model:
    """Learns from a bounded sample of the labelled rows outside the held-out fold."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy(F.col("doc_id").alias("of")).agg((F.max("toxic") == 1).cast("int").alias("toxic"))
    known = known.where(~held_out(F.col("of"))).withColumn("by", F.xxhash64("of"))
    totals = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    parts = [known.where(F.col("toxic") == y).orderBy("by", "of").limit(k) for y, k in ((1, toxic_rows), (0, clean_rows))]
    chosen = parts[0].unionByName(parts[1]).withColumn("fold", F.pmod(F.xxhash64("of", F.lit(7)), F.lit(FOLDS)).cast("int"))
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("of")).select("text", "toxic", "fold")  # at most toxic_rows + clean_rows
    sample = materialize(sample, "sample")
    sizes = np.zeros((FOLDS, 2))
    for r in sample.groupBy("fold", "toxic").count().collect():
        sizes[r["fold"], r["toxic"]] = r["count"]
    if not sizes.sum(0).all():
        share = totals.get(1, 0) / max(1, sum(totals.values()))
        return Model(chances=np.array([share]))
    per = [F.sum(F.when((F.col("toxic") == y) & (F.col("fold") == f), F.col("n")).otherwise(0)).alias(f"{k}{f}") for k, y in (("t", 1), ("c", 0)) for f in range(FOLDS)]
    terms = sample.mapInArrow(_terms, "term string, stem boolean, toxic int, fold int, n long").groupBy("term", "stem").agg(*per)
    # what no lexicon can keep stays on the cluster; each lexicon picks by its own folds alone
    wanted = F.lit(False)
    for out in (None, *range(FOLDS)):
        used = [f for f in range(FOLDS) if f != out]
        t, c = (sum((F.col(f"{k}{f}") for f in used[1:]), F.col(f"{k}{used[0]}")) for k in "tc")
        wanted = wanted | _stands_out(t, c, max(1, sizes[used, 1].sum()), max(1, sizes[used, 0].sum()))
    counts = terms.where(wanted).orderBy("term", "stem").toPandas()
    folds = list(range(FOLDS))
    whole = _lexicon(counts, folds, sizes)
    without = [_lexicon(counts, [f for f in folds if f != out], sizes) for out in folds]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column("fold").to_pylist()
            x = [features(text.as_py() or "", *without[f]) for text, f in zip(batch.column("text"), at, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), batch.column("toxic"), batch.column("fold")], names=["x", "toxic", "fold"])

    seen = sample.mapInArrow(run, "x array<double>, toxic int, fold int").toPandas()
    x, y, fold = np.array(seen["x"].tolist()), seen["toxic"].to_numpy(np.float64), seen["fold"].to_numpy()
    order = np.lexsort((*x.T, y, fold))  # so that reruns add up in one order
    x, y, fold = x[order], y[order], fold[order]
    weight = np.where(y == 1, totals[1] / max(1, (y == 1).sum()), totals[0] / max(1, (y == 0).sum()))
    weight /= weight.mean()
    margin = np.zeros(len(y))
    for out in folds:
        rest = fold != out
        if rest.any():
            margin[~rest] = Trees().fit(x[rest], y[rest], weight[rest]).margin(x[~rest])
    margins, chances = isotonic(margin, y, weight)
    return Model(*whole, Trees().fit(x, y, weight), margins, chances)


def score(docs: DataFrame, model: Model, keep: list[str] | None = None, name: str = "_toxicity") -> DataFrame:
    """The kept columns, and as the last one, under the given name, the score of each document's whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    columns = keep or ["doc_id"]
    sent = list(dict.fromkeys([*columns, "text"]))
    schema = T.StructType([*docs.select(*columns).schema.fields, T.StructField(name, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                chance = known.score(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in columns], pa.array(chance, pa.float64())], names=[*columns, name])

    return docs.select(*sent).mapInArrow(run, schema)


def rate(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row a document: held_out, score and predicted."""
    scored = score(docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text"), train(docs, labels), name="score")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the model doesn't take for toxic, with their own columns."""
    name = unused(docs, "_toxicity")
    return score(docs, train(docs, labels), docs.columns, name).where(F.col(name) < 0.5).drop(name)
