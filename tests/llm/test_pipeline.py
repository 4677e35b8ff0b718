from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from ledgerfold.llm import packing, quality_knn, quality_rules, queries, simhash
from tests.llm.test_packing import check_packing
from tests.llm.test_simhash import brute_components, brute_fingerprint

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = queries.table(spark, SF, "documents")
    out = [docs]
    from ledgerfold.llm._common import Scratch

    scratch = Scratch(spark, "test")
    for _, stage in corpus_pipeline.STAGES:
        out.append(scratch.write(stage(spark, out[-1], SF)))
    return out


def test_columns(stages):
    assert all(df.columns == stages[0].columns for df in stages[1:-1])


def test_quality_rules(stages):
    wanted = Counter((r.doc_id, quality_rules.judge(r.text)[7]) for r in stages[0].collect() if quality_rules.judge(r.text)[6])
    assert Counter((r.doc_id, r.text) for r in stages[1].collect()) == wanted


def test_classifier(spark, stages):
    space = quality_knn.fit_labelled(queries.table(spark, SF, "documents"), queries.table(spark, SF, "labels"))
    features = quality_knn.Features()
    rows = stages[1].collect()
    scores = space.score([features(r.text) for r in rows])
    assert {r.doc_id for r in stages[2].collect()} == {r.doc_id for r, s in zip(rows, scores, strict=True) if s >= 0.3}
    bad = {r.doc_id for r in queries.table(spark, SF, "labels").where("quality = 0").collect()}
    assert not bad & {r.doc_id for r in stages[2].collect()}


def test_near_duplicates(stages):
    rows = stages[2].collect()
    least = brute_components([(r.doc_id, brute_fingerprint(r.text), r.doc_id) for r in rows])
    assert sorted(r.doc_id for r in stages[3].collect()) == sorted(set(least.values()))


def test_secrets_and_packing(stages):
    before, after = {r.doc_id: r.text for r in stages[3].collect()}, {r.doc_id: r.text for r in stages[4].collect()}
    assert before.keys() == after.keys()
    assert all("[SECRET]" in after[i] for i in after if before[i] != after[i])
    words = packing.WordIds(queries.tokenizer_path("word_bpe_49k.json"))
    rows = stages[5].collect()
    check_packing(rows)
    wanted = [p for i, t in after.items() for p in packing.cut(i, words(t) + np.array([1], "<u4").tobytes(), packing.CAPACITY)]
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == sorted(wanted)


def test_run_is_all_stages(spark, stages):
    rows = corpus_pipeline.run(spark, SF)
    assert sorted((r.doc_id, r.piece, r.ids_crc32) for r in rows.collect()) == sorted((r.doc_id, r.piece, r.ids_crc32) for r in stages[5].collect())
    assert simhash.near_duplicates(queries.table(spark, SF, "documents")).count() == 200


def test_empty_and_odd_documents(spark, docs, none, tmp_path):
    for name, df in (("odd", docs), ("none", none)):
        path = f"{tmp_path}/{name}"
        df.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{path}/documents.parquet")
        spark.createDataFrame([(20, 1, 0), (21, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
        check_packing(corpus_pipeline.run(spark, path).collect())
