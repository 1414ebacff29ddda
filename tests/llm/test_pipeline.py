import hashlib

import public_tokenizers
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline
from scorelake.llm import langid, mixing, quality
from scorelake.session import materialise
from tests.llm.edges import edge_docs, no_docs
from tests.llm.test_minhash import brute

FOLDER = "/root/testdata/sf0.001"


def test_stages_one_by_one(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, before = docs.columns, docs
    stages = dict(corpus_pipeline.STAGES)
    outs = {}
    for name, stage in corpus_pipeline.STAGES:
        outs[name] = materialise(stage(spark, before, FOLDER))
        before = outs[name]
    for name in list(stages)[:-1]:
        assert outs[name].columns == columns
    ids = {name: [r["doc_id"] for r in out.select("doc_id").collect()] for name, out in outs.items()}
    assert sorted(ids["quality rules"]) == sorted(r["doc_id"] for r in quality.rated(docs).where("kept").collect())
    good = outs["quality rules"]
    fine = langid.identified(good, langid.train(good)).where("lang_pred <> 'und' and score >= 0.5")
    assert sorted(ids["language ID"]) == sorted(r["doc_id"] for r in fine.collect())
    rows = [(r["doc_id"], r["text"]) for r in outs["language ID"].collect()]
    assert sorted(ids["near-duplicates"]) == sorted(d for d, c in brute(rows).items() if d == c)
    want = mixing.mixed(outs["near-duplicates"], 0.7).select("doc_id").collect()
    assert sorted(ids["mixing"]) == sorted(r["doc_id"] for r in want) and set(ids["mixing"]) == set(ids["near-duplicates"])
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    text = {r["doc_id"]: r["text"] for r in outs["near-duplicates"].collect()}
    assert sorted(ids["encoding"]) == sorted(ids["mixing"])
    for r in outs["encoding"].collect():
        assert r["ids"] == library.encode(text[r["doc_id"]]) and r["decoded_sha256"] == hashlib.sha256(text[r["doc_id"]].encode()).hexdigest()


def test_run(spark):
    got = corpus_pipeline.run(spark, FOLDER)
    assert got.count() > 100 and got.columns[0] == "doc_id"
    assert 4 <= len(corpus_pipeline.STAGES) <= 5 and corpus_pipeline.ORACLE_SQL is None


def test_edges(spark):
    for table in (edge_docs(spark), no_docs(spark)):
        for _, stage in corpus_pipeline.STAGES:
            out = materialise(stage(spark, table, FOLDER))
            assert "doc_id" in out.columns


def test_no_language_to_learn_from(spark):
    docs = edge_docs(spark).withColumn("lang", F.lit(None).cast("string"))
    assert corpus_pipeline.language_id(spark, docs, FOLDER).count() == edge_docs(spark).count()
