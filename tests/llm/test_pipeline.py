from pyspark.sql import functions as F

import corpus_pipeline
from palimpsest.llm import bpe, jaccard, mixing, queries, secrets, toxicity
from palimpsest.sources.tables import materialize, table

FOLDER = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = table(spark, FOLDER, "documents")
    columns, before = docs.columns, docs.count()
    got = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, FOLDER), name)
        got[name] = docs
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "secrets", "mixing", "bpe"]
    assert all(got[n].columns == columns for n in got if n != "bpe")
    labels = table(spark, FOLDER, "labels")
    scores = {r["doc_id"]: r["predicted"] for r in toxicity.rate(table(spark, FOLDER, "documents"), labels).collect()}
    assert {r["doc_id"] for r in got["toxicity"].collect()} == {i for i, p in scores.items() if not p} and got["toxicity"].count() < before
    classes = {r["class_id"] for r in jaccard.classes(got["toxicity"]).collect()}
    assert sorted(r["doc_id"] for r in got["near_duplicates"].collect()) == sorted(classes)
    assert got["secrets"].count() == len(classes)
    left = secrets.digest(secrets.scan_secrets(got["secrets"])[0])
    assert left.where("n_assign + n_access + n_hex > 0").count() == 0
    mixed = mixing.mix(got["secrets"]).groupBy().sum("copies").first()[0]
    assert got["mixing"].count() == mixed == got["bpe"].count()
    tokenizer = bpe.load(open(queries.tokenizer_file(), encoding="utf-8").read())
    texts = {r["doc_id"]: r["text"] for r in got["secrets"].collect()}
    assert all(r["ids"] == tokenizer.encode(texts[r["doc_id"]]) and r["n_tokens"] == len(r["ids"]) for r in got["bpe"].collect())


def test_awkward_rows_go_through_all_stages(spark, awkward, nothing):
    extra = awkward.withColumns({c: F.lit(c) for c in ("_findings", "_of", "_blob", "_toxicity", "_mix_whole", "_mix_under", "_mix_seed", "row", "id", "cuts")})
    for docs in (extra, nothing):
        for name, stage in corpus_pipeline.STAGES:
            columns = docs.columns
            docs = materialize(stage(spark, docs, FOLDER), name)
            assert name == "bpe" or docs.columns == columns
        assert (docs.count() > 0) == (columns == extra.columns)


def test_run_leaves_only_what_is_read(spark):
    got = corpus_pipeline.run(spark, FOLDER)
    assert got.count() > 0 and got.columns == ["doc_id", "source", "n_tokens", "ids"]
