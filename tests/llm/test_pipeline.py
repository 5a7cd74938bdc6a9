"""The pipeline's stages against their operators and plain versions."""

from test_operators import DOCS, labelled, odd_rows, plain_components, plain_fingerprint

import corpus_pipeline
from graphloom.llm import quality, toxicity


def test_stages_keep_what_operators_say(spark, tmp_path):
    docs, labels = labelled(spark)
    rows = [tuple(r) for r in docs.collect()] + [(1000 + k, r[1], *r[2:]) for k, r in enumerate(odd_rows())] + [(5000, docs.first().text, "en", "s", 0)]
    docs = spark.createDataFrame(rows, DOCS)
    folder = f"file://{tmp_path}"
    docs.write.parquet(f"{folder}/documents.parquet")
    labels.write.parquet(f"{folder}/labels.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality", "toxicity", "near_copies", "packing"]
    good = {r.doc_id for r in quality.score_documents(docs, labels).filter("predicted = 1").collect()}
    first = stages["quality"](spark, docs, folder)
    assert {r.doc_id for r in first.collect()} == good and first.columns == docs.columns
    clean = {r.doc_id for r in toxicity.score_documents(first, labels).filter("predicted = 0").collect()}
    second = stages["toxicity"](spark, first, folder)
    assert {r.doc_id for r in second.collect()} == clean
    left = [(r.doc_id, plain_fingerprint(r.text)) for r in second.collect()]
    third = stages["near_copies"](spark, second, folder)
    assert sorted(r.doc_id for r in third.collect()) == sorted(set(plain_components(left)))
    packed = stages["packing"](spark, third, folder).collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in third.collect()}
    whole = corpus_pipeline.run(spark, folder).collect()
    key = lambda x: sorted((r.doc_id, r.piece, r.length, r.ids_crc32) for r in x)
    assert key(whole) == key(packed)


def test_an_empty_table_gives_no_rows(spark, tmp_path):
    docs, labels = labelled(spark)
    folder = f"file://{tmp_path}"
    docs.limit(0).write.parquet(f"{folder}/documents.parquet")
    labels.write.parquet(f"{folder}/labels.parquet")
    assert corpus_pipeline.run(spark, folder).collect() == []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(0), folder).columns == docs.columns
