import glob
from pathlib import Path

import corpus_pipeline as pipeline
from pyspark.sql import functions as F
from test_simhash import components, fingerprint

from tabularium.llm import language, mixing, packing, toxicity
from tabularium.llm.common import shared_folder, table
from tabularium.llm.tokens import encoder, public_vocabulary


def test_stages(spark, sf, documents):
    docs = documents
    model = toxicity.fit(docs, table(spark, sf, "labels"))
    kept = [r for r in docs.collect() if toxicity.score_text(r["text"], model.weights, model.bias) < toxicity.THRESHOLD]
    found = pipeline.keep_civil(spark, docs, sf)
    assert found.columns == pipeline.COLUMNS and sorted(r["doc_id"] for r in found.collect()) == sorted(r["doc_id"] for r in kept)
    assert len(kept) < docs.count()

    vocabulary = public_vocabulary("piece_bpe_32k.model")
    declared = language.fit(docs, vocabulary)
    said = {r["doc_id"]: r["x"] for r in docs.select("doc_id", language.predict(F.col("text"), declared, vocabulary, spark).alias("x")).collect()}
    stay = [r["doc_id"] for r in docs.collect() if said[r["doc_id"]]["lang"] != "und" and not (r["lang"] in declared and r["lang"] != said[r["doc_id"]]["lang"] and said[r["doc_id"]]["score"] >= 0.99)]
    assert sorted(r["doc_id"] for r in pipeline.keep_language(spark, docs, sf).collect()) == sorted(stay)

    rows = docs.orderBy("doc_id").collect()
    groups = components([fingerprint(r["text"]) for r in rows])
    assert sorted(r["doc_id"] for r in pipeline.keep_one_of_each(spark, docs, sf).collect()) == sorted(rows[i]["doc_id"] for i in set(groups))

    assert pipeline.mix_sources(spark, docs, sf).columns == pipeline.COLUMNS


def test_run(spark, sf, documents):
    packed = pipeline.run(spark, sf)
    whole = packed.groupBy("doc_id").agg(F.sum("length").alias("n")).collect()
    texts = {r["doc_id"]: r["text"] for r in documents.collect()}
    encode = encoder(public_vocabulary("byte_bpe_50k.tiktoken")).encode_ordinary
    assert whole and all(r["n"] % (len(encode(texts[r["doc_id"]] or "")) + 1) == 0 for r in whole)
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("e")).where(f"n <> e OR n > {packing.CAPACITY}").count() == 0


def test_odd_rows(spark, sf, odd, empty):
    for docs in (odd, empty):
        for name, stage in pipeline.STAGES:
            out = stage(spark, docs, sf)
            assert name == pipeline.STAGES[-1][0] or out.columns == pipeline.COLUMNS
            docs = spark.createDataFrame(out.collect(), out.schema)
    assert pipeline.ORACLE_SQL is None and mixing.QUERIES


def test_run_leaves_only_its_last_stage(spark, sf):
    before = set(glob.glob(f"{shared_folder(spark).removeprefix('file:')}/pipeline-*"))
    packed = pipeline.run(spark, sf)
    (folder,) = set(glob.glob(f"{shared_folder(spark).removeprefix('file:')}/pipeline-*")) - before
    assert [Path(p).name for p in glob.glob(f"{folder}/*")] == ["4-best_fit_packing"] and packed.count()
