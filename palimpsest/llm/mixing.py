"""Mixing sources to target weights.

Token counts are summed per source, targets are filled by weight up to a cap of
so many times a source's size, and each source gets a repetition rate of target
over size. A document is then emitted floor(rate) times, plus one copy when a
hash of its id falls under the rate's fraction.

The hash is seeded. Of a fixed number of seeds each source takes the one under
which its taken words come nearest its target (ties: the smaller seed), which
also holds small sources near their targets. Reruns agree, because only ids,
sizes and source names decide.

Cases: a null text has size 0 and takes nothing; sources sort by code point
with null last; a source of size 0 has target 0 and rate 0; repeated rows are
documents of their own with equal decisions; a null id hashes as the word null;
an empty table gives an empty result; other columns are ignored.

One source may hold any share of the rows: rows are summed before they move,
and the per-source rates (one small row each) join back by a broadcast only
below ``BROADCAST_SOURCES`` sources, by a shuffle beyond.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.sources.tables import materialize

SEEDS = 64
CAP = 2.0
SHARE = 1.5
WEIGHTS = (3, 1, 2)
BROADCAST_SOURCES = 50_000
WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sources: DataFrame, share: float = SHARE, cap: float = CAP, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """Adds ``weight`` and ``target`` to one row for each source with its ``source_size``.

    Filling by weight with caps has a closed form: in ascending order of cap
    over weight, a source is full if its share of what the earlier ones leave
    reaches its cap. There is one row a source here, not one a document.
    """
    everything = Window.partitionBy(F.lit(0)).orderBy("null_last", "source")
    w = sources.withColumn("null_last", F.col("source").isNull())
    w = w.withColumn("weight", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.row_number().over(everything) - 1, F.lit(len(weights))) + 1).cast("int")))
    w = w.withColumn("cap", F.lit(cap) * F.col("source_size"))
    order = Window.partitionBy(F.lit(0)).orderBy((F.col("cap") / F.col("weight")), "null_last", "source")
    whole = Window.partitionBy(F.lit(0))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    w = w.withColumn("left", F.lit(share) * F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
    w = w.withColumn("rest", F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    w = w.withColumn("full", F.col("left") * F.col("weight") / F.col("rest") >= F.col("cap"))
    # the first source that isn't full fixes the level for all after it
    first = F.first(F.when(~F.col("full"), F.col("left") / F.col("rest")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    w = w.withColumn("target", F.when(F.col("full") | first.isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), first * F.col("weight"))))
    return w.select("source", "source_size", "weight", "target")


def _draw(seed: Column, doc_id: Column) -> Column:
    """The first 32 bits of a seeded hash, as eight hex digits."""
    return F.substring(F.md5(F.concat(seed, F.lit(":"), F.coalesce(doc_id.cast("string"), F.lit("null")))), 1, 8)


def _with(docs: DataFrame, rates: DataFrame, small: bool) -> DataFrame:
    return docs.join(F.broadcast(rates) if small else rates, docs["source"].eqNullSafe(rates["of"]))


def plan(sized: DataFrame, share: float = SHARE, cap: float = CAP, weights: tuple[int, ...] = WEIGHTS, seeds: int = SEEDS) -> tuple[DataFrame, bool]:
    """One row a source: whole copies, the fraction's bound and seed; and whether they are few enough to broadcast.

    ``sized`` has (doc_id, source, size) and is read twice, so it should be a written table.
    """
    rates = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), share, cap, weights)
    rates = rates.withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)))
    rates = rates.withColumn("whole", F.floor("rate").cast("long"))
    rates = rates.withColumn("under", F.lpad(F.lower(F.hex(F.floor((F.col("rate") - F.col("whole")) * F.lit(2.0**32)).cast("long"))), 8, "0"))
    rates = materialize(rates.withColumnRenamed("source", "of"), "rates")
    small = rates.count() <= BROADCAST_SOURCES
    drawn = _with(sized, rates, small)
    # the words that the whole copies and each seed's fractional ones take
    taken = [F.sum(F.when(_draw(F.lit(str(s)), F.col("doc_id")) < F.col("under"), F.col("size")).otherwise(F.lit(0))).alias(f"t{s}") for s in range(seeds)]
    tried = drawn.groupBy("of", "source_size", "target", "whole", "under").agg(*taken)
    off = [F.struct(F.abs(F.col(f"t{s}") + F.col("whole") * F.col("source_size") - F.col("target")).alias("off"), F.lit(s).alias("seed")) for s in range(seeds)]
    return materialize(tried.select("of", "source_size", "target", "whole", "under", F.array_min(F.array(*off))["seed"].cast("string").alias("seed")), "seeds"), small


def repeated(docs: DataFrame, rates: DataFrame, small: bool) -> DataFrame:
    """Adds ``source_size``, ``target`` and ``copies`` to documents."""
    bernoulli = F.when(_draw(F.col("seed"), F.col("doc_id")) < F.col("under"), F.lit(1)).otherwise(F.lit(0))
    return _with(docs, rates, small).withColumn("copies", (F.col("whole") + bernoulli).cast("long")).drop("of", "whole", "under", "seed")


def sizes(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "source", n_words(F.col("text")).alias("size"))


def mix(docs: DataFrame) -> DataFrame:
    """One row a document: its size, its source's size and target, and the words that the mix takes."""
    sized = materialize(sizes(docs), "sizes")
    out = repeated(sized, *plan(sized))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "source", "copies")


def emit(docs: DataFrame) -> DataFrame:
    """The mix itself: each document as often as its source's rate and its draw say, whole, with its own columns."""
    rates, small = plan(materialize(sizes(docs), "sizes"))
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs["source"], docs["doc_id"])
    copies = repeated(rows, rates, small).select("row", F.explode(F.array_repeat(F.lit(True), F.col("copies").cast("int"))))
    return copies.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
