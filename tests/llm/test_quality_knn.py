import random
import tracemalloc
import zlib

import numpy as np
import pytest

from ledgerfold.llm import quality_knn as knn
from tests.llm.conftest import DOCS, sentence


def rows_of(n, seed=1):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        good = rng.random() < 0.7
        text = sentence(rng, rng.randint(15, 80))
        if not good:
            text = " ".join(w + rng.choice(["###", "%%%", "!!"]) for w in text.split())
        out.append((i, text, "en", "s", len(text), int(good)))
    return out


@pytest.fixture(scope="module")
def table(spark):
    rows = rows_of(400)
    docs = spark.createDataFrame([r[:5] for r in rows], DOCS)
    labels = spark.createDataFrame([(r[0], r[5], 0) for r in rows] + [(None, 1, 0), (3, None, 0), (99999, 0, 0)], "doc_id long, quality int, toxic int")
    return docs, labels, {r[0]: r[5] for r in rows}


def test_held_out_accuracy(table):
    docs, labels, truth = table
    out = knn.score_documents(docs, knn.fit_labelled(docs, labels)).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in out)
    held = [r for r in out if r.held_out]
    assert len(held) > 40
    assert sum(r.predicted == truth[r.doc_id] for r in held) / len(held) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in out)


def test_vote_is_that_of_all_labelled_vectors():
    features = knn.Features()
    rows = [features(r[1]) for r in rows_of(300)]
    labels = [r[5] for r in rows_of(300)]
    space = knn.fit(rows[:200], labels[:200], dimensions=16)
    latent = space.latent(rows[200:])
    for v, score in zip(latent, space.score(rows[200:], neighbours=9), strict=True):
        cosine = np.array([float(v @ u) for u in space.vectors])
        near = np.argsort(-cosine, kind="stable")[:9]
        weight = np.maximum(cosine[near], 0).astype(float)
        assert score == pytest.approx((weight * space.labels[near]).sum() / weight.sum(), abs=1e-3)


def test_sample_is_bounded(table):
    docs, labels, _ = table
    space = knn.fit_labelled(docs, labels, max_labelled=50)
    assert len(space.vectors) <= 50


def test_texts_of_one_id_are_told_apart(spark, table):
    """The fit doesn't depend on the order of rows, though ids have several texts."""
    docs, labels, _ = table
    twice = docs.unionByName(docs.withColumn("doc_id", docs["doc_id"] + 1))
    one, two = (knn.fit_labelled(df, labels) for df in (twice.orderBy("text"), twice.repartition(3)))
    assert np.array_equal(one.vectors, two.vectors) and np.array_equal(one.labels, two.labels)


def test_long_labelled_texts_are_small_on_the_driver(spark):
    """Texts with thousands of features each come as a few bytes a feature, not as objects."""
    docs = spark.range(200).selectExpr("id doc_id", "concat_ws(' ', transform(sequence(1, 6000), i -> lower(hex(xxhash64(id, i))))) text")
    labels = docs.selectExpr("doc_id", "int(doc_id % 2) quality")
    tracemalloc.start()
    space = knn.fit_labelled(docs, labels)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    fitted = [i for i in range(200) if zlib.crc32(str(i).encode()) % 5]
    assert len(space.vectors) == len(fitted) and space.labels.tolist() == [i % 2 for i in fitted]
    features = knn.Features()
    rows = [features(r.text) for r in docs.where("crc32(cast(string(doc_id) as binary)) % 5 <> 0").orderBy("doc_id").collect()]
    assert np.array_equal(space.vectors, knn.fit(rows, [i % 2 for i in fitted]).vectors)
    assert peak < 25e6


def test_shapes_are_of_whole_words():
    assert knn._shape(b"a-b" * 9) != knn._shape(b"a-b" * 8)


def test_odd_rows(spark, docs, none, table):
    _, labels, _ = table
    space = knn.fit_labelled(docs, labels)
    out = knn.score_documents(docs, space).collect()
    assert len(out) == docs.count()
    assert all(r.score == pytest.approx(space.prior) for r in out if r.doc_id in (0, 1, 4))
    assert knn.score_documents(none, space).collect() == []
    kept = knn.keep_predicted(docs, space)
    assert kept.columns == docs.columns
    assert kept.count() == sum(r.predicted for r in out)
    unlabelled = knn.fit_labelled(docs, labels.where("false"))
    assert {r.score for r in knn.score_documents(docs, unlabelled).collect()} == {0.5}
    assert knn.fit_labelled(none, labels).prior == 0.5
