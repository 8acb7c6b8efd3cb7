"""The pipeline next to the brute-force versions of its stages."""
import sentencepiece

import corpus_pipeline
from enrichflow.llm import toxicity
from enrichflow.llm.catalog import model_bytes
from enrichflow.sources.scratch import written
from tests.llm import test_decontaminate, test_jaccard_join, test_line_dedup

SF = "/root/testdata/sf0.01"


def test_stages_equal_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, {}
    rows = docs.collect()
    score = {r.doc_id: r.score for r in toxicity.scored(docs, toxicity.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))).collect()}
    kept["toxicity"] = {r.doc_id: r.text for r in rows if score[r.doc_id] < 0.5}
    texts = dict(kept["toxicity"])
    for doc, gone in test_line_dedup.brute(list(texts.items())).items():
        texts[doc] = "\n".join(x for k, x in enumerate(texts[doc].split("\n")) if k not in gone)
    kept["line dedup"] = {i: t for i, t in texts.items() if t.strip() or t == kept["toxicity"][i]}
    root = test_jaccard_join.brute(list(kept["line dedup"].items()), 5, 80)
    kept["n-gram Jaccard join"] = {i: t for i, t in kept["line dedup"].items() if root[i][1] == i}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    leaks = {d for d, _ in test_decontaminate.brute(list(kept["n-gram Jaccard join"].items()), items)}
    kept["benchmark decontamination"] = {i: t for i, t in kept["n-gram Jaccard join"].items() if i not in leaks}
    model = sentencepiece.SentencePieceProcessor(model_proto=model_bytes())
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, SF))
        if name in kept:
            got = docs.collect()
            assert docs.columns == columns and {r.doc_id: r.text for r in got} == kept[name], name
            assert all(r.n_chars == len(r.text) for r in got)
            assert name == "toxicity" or len(got) < before
            before = len(got)
    final = kept["benchmark decontamination"]
    assert {r.doc_id: r.ids for r in docs.collect()} == {i: model.encode(t) for i, t in final.items()}


def test_stages_take_odd_rows(spark, tmp_path):
    rows = [(1, None, None), (2, "", 0), (None, "a b c d e f", 11), (3, "a b c d e f", 11), (3, "a b c d e f", 11), (4, "A b c d e F", 11)]
    docs = spark.createDataFrame([(*r, "z") for r in rows], "doc_id bigint, text string, n_chars bigint, removed string")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, None)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for frame, left in ((docs, 5), (docs.limit(0), 0)):
        for name, stage in corpus_pipeline.STAGES:
            before, frame = frame, written(stage(spark, frame, str(tmp_path)))
            assert name.startswith("Sentence") or frame.columns == docs.columns
        assert before.count() == frame.count() == left


def test_stages_hand_small_batches_to_python(spark, monkeypatch):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    try:
        spark.conf.set(name, "10000")
        docs = spark.createDataFrame([(1, "a few words")], "doc_id bigint, text string")
        assert corpus_pipeline.encoding_stage(spark, docs, "").count() == 1
        assert int(spark.conf.get(name)) == corpus_pipeline.BATCH_ROWS < 10000
    finally:
        spark.conf.set(name, before)
