"""Queries over what the engine writes and reads again: shards, JSON artifacts, reports, samples, releases."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.functions import text as T
from palimpsest.operators import cliques, dedup_stats, exact, lengths, minhash, records, release
from palimpsest.plans import sql
from palimpsest.plans.registry import joined, query
from palimpsest.plans.stages import Corpus
from palimpsest.sources import corpus as sources
from palimpsest.sources import sinks
from palimpsest.sources.tables import folder, materialize, table

PER_SHARD = 100


# -- sources


def _shards(c: Corpus) -> str:
    """The corpus as files shard_NNNNN.parquet of 100 ids."""

    def make() -> DataFrame:
        path = f"{folder(c.spark)}/shards"
        sinks.write_shards(sources.with_rows(c.docs, PER_SHARD).select("shard", "doc_id", "text"), path)
        return c.spark.createDataFrame([(path,)], "path string")

    return c.once("shards", make).first()["path"]


_SHARDS = "SELECT printf('shard_%05d_%05d', doc_id // 100, row) AS doc_id, (doc_id // 100)::INTEGER AS shard, row, length(text) AS n_chars FROM (SELECT *, row_number() OVER (PARTITION BY doc_id // 100 ORDER BY doc_id) - 1 AS row FROM documents)"


@query(_SHARDS)
def shard_scan(c: Corpus) -> DataFrame:
    return sources.read_shards(c.spark, _shards(c)).select("doc_id", "shard", "row", F.length("text").cast("long").alias("n_chars"))


@query(_SHARDS + " WHERE doc_id // 100 < 3")
def shard_scan_limited(c: Corpus) -> DataFrame:
    """Limiting shards is what this one is for."""
    return sources.read_shards(c.spark, _shards(c), limit_shards=3).select("doc_id", "shard", "row", F.length("text").cast("long").alias("n_chars"))


@query(sql.POOL + "SELECT doc_id, lang, n_chars FROM documents WHERE doc_id IN (SELECT doc_id FROM pool)")
def selected_rows(c: Corpus) -> DataFrame:
    return sources.select_ids(c.docs, c.pool().select("doc_id")).select("doc_id", "lang", "n_chars")


@query("SELECT doc_id, lang, n_chars FROM documents WHERE doc_id IN (1, 17, 250, 999, 1000000007)")
def looked_up_rows(c: Corpus) -> DataFrame:
    """A lookup by a short list is pushed down to the scan."""
    return sources.select_ids(c.docs, [1, 17, 250, 999, 1_000_000_007]).select("doc_id", "lang", "n_chars")


@query(
    sql.PREVIEWED
    + ", "
    + sql.POOL_BODY
    + """, wanted AS (SELECT doc_id FROM pool UNION SELECT doc_id FROM previewed UNION SELECT item_id + 1000000000 FROM benchmark)
SELECT w.doc_id, CASE WHEN w.doc_id IN (SELECT doc_id FROM pool) THEN 'cached' WHEN d.doc_id IS NULL THEN 'not-found' WHEN d.text IS NULL THEN 'error' ELSE 'fetched' END AS status, length(d.text) AS n_chars FROM wanted w LEFT JOIN documents d USING (doc_id)"""
)
def fetched_documents(c: Corpus) -> DataFrame:
    """Documents to be read for judging, some of them read before and some unknown."""
    held = c.pool().select("doc_id").distinct().join(c.docs.select("doc_id", "text"), "doc_id")
    wanted = c.pool().select("doc_id").union(c.previewed().select("doc_id")).union(c.passages().select(F.col("item_id") + 1_000_000_000))
    return sources.fetch(wanted, c.docs, held).select("doc_id", "status", F.length("text").cast("long").alias("n_chars"))


@query(sql.LENGTHS + "SELECT doc_id, n_tokens FROM lengths")
def sidecar_lengths(c: Corpus) -> DataFrame:
    """A sidecar of lengths, read with its number of rows checked against the corpus."""
    return sources.checked(materialize(c.lengths(), "sidecar"), c.docs.count()).select("doc_id", "n_tokens")


@query("SELECT doc_id, text FROM documents WHERE ('0x' || substr(md5(doc_id || ':11'), 1, 8))::BIGINT < 858993459")
def sampled_documents(c: Corpus) -> DataFrame:
    """A seeded fifth of the corpus; sampling is what this one is for."""
    return sources.sample(c.docs, 0.2, 11).select("doc_id", "text")


@query("SELECT doc_id, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS place FROM documents ORDER BY n_chars DESC, doc_id LIMIT 20 OFFSET 10")
def sliced_rows(c: Corpus) -> DataFrame:
    """The rows at places 10 to 29 of an order; the slice is what this one is for."""
    got = sources.slice_rows(c.docs, [F.desc("n_chars"), "doc_id"], 10, 30)
    rank = sources.numbered(got, [F.desc("n_chars"), F.col("doc_id")])
    return rank.select("doc_id", (F.col("place") + 10).alias("place"))


# -- JSON, text and CSV, written and read again


def _written(c: Corpus, name: str, df: DataFrame, **options) -> str:
    path = f"{folder(c.spark)}/{name}"
    sinks.write_json(df, path, **options)
    return path


@query(sql.MANIFEST + "SELECT shard, n_rows, (sum(n_rows) OVER (ORDER BY shard) - n_rows)::BIGINT AS \"offset\" FROM shards")
def manifest_json(c: Corpus) -> DataFrame:
    return sources.read_jsonl(c.spark, _written(c, "manifest", sources.manifest(sources.with_rows(c.docs))), "shard long, n_rows long, offset long")


@query(sql.LENGTH_LISTS)
def length_map_json(c: Corpus) -> DataFrame:
    return sources.read_jsonl(c.spark, _written(c, "lengths", exact.length_map(c.scanned())), "char_len long, chunk long, n_docs long, doc_ids array<long>").withColumn("doc_ids", joined("doc_ids"))


@query(sql.HASH_LISTS)
def hash_groups_jsonl(c: Corpus) -> DataFrame:
    return sources.read_jsonl(c.spark, _written(c, "hashes", exact.hash_groups(c.scanned())), "sha256 string, length long, count long, chunk long, doc_ids array<long>").withColumn("doc_ids", joined("doc_ids"))


@query(
    sql.REPS
    + f""", v AS (SELECT r.sha256, count(*) AS count, bool_and({sql.strip('d.text')} = {sql.strip('p.text')}) AS ok FROM reps r JOIN documents d ON d.doc_id = r.doc_id JOIN documents p ON p.doc_id = r.rep_id WHERE group_size >= 2 GROUP BY 1)
SELECT CASE WHEN ok THEN 'group' ELSE 'failure' END AS kind, sha256, count FROM v"""
)
def verified_groups_jsonl(c: Corpus) -> DataFrame:
    """Verified groups and failures, in two files."""
    path = folder(c.spark)
    sinks.write_groups(exact.verify(c.docs), f"{path}/groups", f"{path}/failures")
    schema = "sha256 string, count long"
    both = [sources.read_jsonl(c.spark, f"{path}/{name}", schema).withColumn("kind", F.lit(kind)) for name, kind in (("groups", "group"), ("failures", "failure"))]
    return both[0].unionByName(both[1])


def _clusters_json(c: Corpus) -> str:
    def make() -> DataFrame:
        rows = None
        for t in (0.7, 0.8, 0.9):
            one = cliques.clusters(c.partition(t), c.edges()).select("cluster", "doc_ids", "min_jaccard", F.lit(t).alias("threshold"))
            rows = one if rows is None else rows.unionByName(one)
        return c.spark.createDataFrame([(_written(c, "clusters", rows, partition_by="threshold"),)], "path string")

    return c.once("clusters_json", make).first()["path"]


@query(sql.CLIQUES + "SELECT threshold, cluster, array_to_string(ids, ',') AS doc_ids FROM scored")
def clusters_jsonl(c: Corpus) -> DataFrame:
    return sources.read_jsonl(c.spark, _clusters_json(c), "cluster long, doc_ids array<long>, threshold double").select("threshold", "cluster", joined("doc_ids").alias("doc_ids"))


@query(sql.CLIQUES + "SELECT threshold, count(*) AS clusters, round(min(min_jaccard), 9) AS worst FROM scored GROUP BY 1")
def cluster_floor(c: Corpus) -> DataFrame:
    """The least similarity in raw JSON lines, by a pattern."""
    lines = c.spark.read.text(_clusters_json(c))
    return cliques.floor_of_lines(lines).select(F.col("threshold").cast("double").alias("threshold"), "clusters", F.round("worst", 9).alias("worst"))


@query(sql.CLIQUES + "SELECT doc_id FROM members WHERE threshold = 0.8 AND doc_id <> cluster")
def drop_list_text(c: Corpus) -> DataFrame:
    path = f"{folder(c.spark)}/drops"
    sinks.write_lines(cliques.drop_list(c.partition(0.8)), "doc_id", path)
    return c.spark.read.text(path).select(F.col("value").cast("long").alias("doc_id"))


@query(sql.RECORDS + "SELECT doc_id, coalesce(exact_duplicates, '') AS exact_duplicates, coalesce(near_duplicates, '') AS near_duplicates FROM recorded")
def records_parquet(c: Corpus) -> DataFrame:
    path = f"{folder(c.spark)}/records"
    sinks.write_records(c.records(), path)
    near = F.array_join(F.transform("near_duplicates", lambda x: x["doc_id"].cast("string")), ",")
    return c.spark.read.parquet(path).select("doc_id", joined("exact_duplicates").alias("exact_duplicates"), near.alias("near_duplicates"))


@query(
    sql.LENGTHS
    + """, m AS (SELECT greatest(1, ceil(ceil(quantile_cont(n_tokens, 0.9)) / 1000))::BIGINT * 1000 // 10 AS bins FROM lengths), h AS (SELECT least(n_tokens // 10, bins - 1) AS bin, count(*) AS documents FROM lengths, m GROUP BY 1),
r AS (SELECT unnest(range(bins)) AS bin FROM m) SELECT bin, bin * 10 AS low, coalesce(documents, 0) AS documents FROM r LEFT JOIN h USING (bin)"""
)
def length_histogram_csv(c: Corpus) -> DataFrame:
    path = f"{folder(c.spark)}/histogram"
    sinks.write_csv(lengths.histogram(c.lengths()), path)
    return c.spark.read.schema("bin long, low long, documents long").option("header", True).csv(path)


@query("SELECT '| ' || doc_id || ' | ' || coalesce(source, '') || ' | ' || substr(replace(replace(coalesce(text, ''), '|', ' '), chr(10), ' '), 1, 60) || ' |' AS line FROM documents")
def markdown_index(c: Corpus) -> DataFrame:
    return sinks.markdown_rows(c.docs, {"doc_id": None, "source": None, "text": 60})


@query("SELECT doc_id, CASE " + " ".join(f"WHEN n >= {1000**p} THEN printf('%.1f {u}', round(n / {1000**p}::DOUBLE, 1))" for p, u in ((5, "PB"), (4, "TB"), (3, "GB"), (2, "MB"), (1, "KB"))) + " ELSE printf('%.0f B', n::DOUBLE) END AS size FROM (SELECT doc_id, n_chars * 1021 AS n FROM documents)")
def human_sizes(c: Corpus) -> DataFrame:
    return c.docs.select("doc_id", T.human_bytes(F.col("n_chars") * 1021).alias("size"))


# -- checks of the duplicates


@query(sql.RECORDS + ", refs AS (SELECT doc_id, count(*) AS n FROM near GROUP BY 1) SELECT r.doc_id, r.n_exact AS exact_refs, 0::BIGINT AS wrong_exact, coalesce(n, 0) AS near_refs, (SELECT count(*) FROM near x JOIN reps a ON a.doc_id = x.doc_id JOIN reps b ON b.doc_id = x.neighbour WHERE x.doc_id = r.doc_id AND NOT EXISTS (SELECT 1 FROM pairs p WHERE (p.a = a.rep_id AND p.b = b.rep_id OR p.a = b.rep_id AND p.b = a.rep_id) AND abs(p.jaccard - x.jaccard) <= 0.002)) AS wrong_near FROM recorded r LEFT JOIN refs USING (doc_id)")
def record_verification(c: Corpus) -> DataFrame:
    """Each record against the texts that it refers to."""
    return records.verify(c.records(), c.docs)


@query(sql.REPS + "SELECT rep_id, any_value(group_size) AS size FROM reps LEFT JOIN labels USING (doc_id) WHERE group_size >= 2 GROUP BY rep_id HAVING count(*) FILTER (WHERE quality = 1) = 0")
def missing_groups(c: Corpus) -> DataFrame:
    """Exact groups without a record, where documents labelled as good have theirs written."""
    written = table(c.spark, c.dir, "labels").where("quality = 1").select("doc_id")
    return records.missing_groups(c.members(), written)


@query(sql.PAIR_CLOSURE + ", m AS (SELECT v, min(c) AS component FROM reach GROUP BY 1), s AS (SELECT component, count(*) AS size, list(v ORDER BY v) AS ids FROM m GROUP BY 1) SELECT component, size, array_to_string(ids[1:3], ',') AS doc_ids FROM s WHERE size > 2")
def oversized_components(c: Corpus) -> DataFrame:
    """The report of large components, from three members on and with three ids each, as the tables have none larger."""
    return cliques.oversized(c.components(), 2, 3).withColumn("doc_ids", joined("doc_ids"))


@query(sql.PAIR_CLOSURE + ", m AS (SELECT v, min(c) AS component FROM reach GROUP BY 1) SELECT component, count(*) AS size FROM m GROUP BY 1 ORDER BY size DESC, component LIMIT 20")
def top_components(c: Corpus) -> DataFrame:
    return cliques.top_components(c.components())


@query(sql.BANDS + "SELECT band, key, count(*) AS n, min(doc_id) AS anchor FROM bands GROUP BY 1, 2 HAVING count(*) > 4")
def oversized_buckets(c: Corpus) -> DataFrame:
    return minhash.oversized_buckets(c.bands(), 4)


@query(sql.NEAR + ", one AS (SELECT min(doc_id) AS doc_id FROM near) SELECT doc_id, (SELECT string_agg(y.doc_id::VARCHAR, ',' ORDER BY y.doc_id) FROM reps x JOIN reps y ON x.rep_id = y.rep_id AND y.doc_id <> x.doc_id WHERE x.doc_id = one.doc_id) AS exact_duplicates, (SELECT string_agg(neighbour::VARCHAR, ',' ORDER BY jaccard DESC, neighbour) FROM near n WHERE n.doc_id = one.doc_id AND jaccard::FLOAT >= 0.75::FLOAT) AS near_duplicates FROM one")
def neighbours_of_one(c: Corpus) -> DataFrame:
    """The lookup of a single document, here the first with a near copy."""
    first = c.records().where("n_near > 0").agg(F.min("doc_id")).first()[0]
    near = F.array_join(F.transform("near_duplicates", lambda x: x["doc_id"].cast("string")), ",")
    empty = lambda x: F.when(x != "", x)
    return records.neighbours(c.records(), first, 0.75).select("doc_id", empty(joined("exact_duplicates")).alias("exact_duplicates"), empty(near).alias("near_duplicates"))


@query(sql.SCAN + "SELECT doc_id, char_len, sha256, 'source' AS side FROM scan WHERE doc_id NOT IN (SELECT min(doc_id) FROM scan GROUP BY sha256)")
def release_difference(c: Corpus) -> DataFrame:
    """The scan against a release of representatives, row by row and both ways."""
    rows = c.scanned().select("doc_id", "char_len", "sha256")
    return release.difference(rows, rows.join(exact.representatives(c.scanned()), "doc_id", "left_semi").select(*rows.columns))


@query("SELECT s AS similarity, n AS n_perm, round(sqrt(s * (1 - s) / n), 12) AS sd, ceil(round(s * n, 9))::BIGINT AS least_matches, round((s - 0.4::DOUBLE) / sqrt(s * (1 - s) / n), 9) AS sigmas FROM (VALUES (0.5::DOUBLE), (0.6), (0.7), (0.8)) x(s), (VALUES (64), (128), (512)) y(n)")
def estimator_table(c: Corpus) -> DataFrame:
    """How well minima estimate a similarity, and how far that lies above the gate at 0.4."""
    rows = [(s, n, minhash.estimator_sd(s, n), minhash.least_matches(s, n), (s - 0.4) / minhash.estimator_sd(s, n)) for s in (0.5, 0.6, 0.7, 0.8) for n in (64, 128, 512)]
    got = c.spark.createDataFrame(rows, "similarity double, n_perm int, sd double, least_matches long, sigmas double")
    return got.withColumn("sd", F.round("sd", 12)).withColumn("sigmas", F.round("sigmas", 9))


@query("SELECT b * r AS n_perm, i::INTEGER AS band, (i * r)::INTEGER AS begin, (i * r + r)::INTEGER AS \"end\" FROM (VALUES (73, 7), (36, 7), (7, 2)) x(b, r), range(73) t(i) WHERE i < b")
def band_layouts(c: Corpus) -> DataFrame:
    rows = [(b * r, i, *ends) for b, r in ((73, 7), (36, 7), (7, 2)) for i, ends in enumerate(minhash.band_layout(512, b, r))]
    return c.spark.createDataFrame(rows, "n_perm int, band int, begin int, end int")


@query(
    sql.TIERS
    + """, t AS (SELECT x.tier, count(tiers.doc_id) AS documents FROM (VALUES ('exact'), ('near_90'), ('near_80'), ('near_70')) x(tier) LEFT JOIN tiers ON tiers.tier = x.tier GROUP BY 1),
u AS (SELECT * FROM t UNION ALL SELECT 'none', (SELECT count(*) FROM documents) - (SELECT sum(documents)::BIGINT FROM t)), s AS (SELECT tier, documents::DOUBLE / (SELECT count(*) FROM documents) AS share FROM u)
SELECT tier, round(share, 3) AS share_3, round(share, 4) AS share_4, round(share, 5) AS share_5, round(share, 6) AS share_6 FROM s"""
)
def rounded_shares(c: Corpus) -> DataFrame:
    parts = dedup_stats.composition(c.counted(), c.docs.count())
    return parts.select("tier", *[F.round("share", n).alias(f"share_{n}") for n in (3, 4, 5, 6)])


@query()
def token_lengths(c: Corpus) -> DataFrame:
    """Lengths under a tokenizer that is found by its name; the tokenizer's own merges have no SQL."""
    return lengths.tokenizer_counts(c.docs, lengths.tokenizer_path("word_bpe_49k"))
