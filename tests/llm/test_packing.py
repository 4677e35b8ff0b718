import math
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from ledgerfold.llm import packing
from ledgerfold.llm._common import Scratch
from ledgerfold.llm.queries import tokenizer_path

PATH = tokenizer_path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def words():
    return packing.WordIds(PATH)


def exact(tokenizer, text):
    return np.array(tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()


def test_ids_are_the_tokenizers(words, docs):
    tokenizer = Tokenizer.from_file(PATH)
    tokenizer.encode_special_tokens = True
    texts = [r.text or "" for r in docs.collect()]
    texts += ["a\x00b", "İ", "ΣΑΣ", "Å Å", "it's 's's", "100%***!!", "a b", "日本語12", "<|endoftext|> hi", "a\x1cb", "e\u200bf"]
    assert [words(t) for t in texts] == [exact(tokenizer, t) for t in texts]
    assert words.many(texts) == [exact(tokenizer, t) for t in texts]


def check_packing(rows, capacity=packing.CAPACITY):
    """Gapless from 0 in every sequence, none over capacity, pieces of a document cut only at capacity."""
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by_sequence)


def test_whole_table(spark, docs, none, words):
    rows = packing.pack_documents(docs, PATH).collect()
    sequences = check_packing(rows)
    assert {(r.sequences, r.least_sequences) for r in rows} == {(sequences, sequences)}
    assert sequences == math.ceil(sum(r.length for r in rows) / packing.CAPACITY)
    expected = []
    for d in docs.collect():
        expected += packing.cut(d.doc_id, words(d.text or "") + b"\1\0\0\0", packing.CAPACITY)
    key = lambda t: tuple((x is None, x) for x in t)
    assert sorted([(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows], key=key) == sorted(expected, key=key)
    assert packing.pack_documents(none, PATH).collect() == []


def test_exchange_between_partitions(spark):
    rng = np.random.default_rng(1)
    lengths = np.concatenate([rng.integers(1, 101, 2900), np.full(140, 60)]).tolist()
    pieces = spark.createDataFrame([(i, 0, 0, int(n), i) for i, n in enumerate(lengths)], packing.PIECES)
    scratch = Scratch(spark, "test")
    rows = packing.pack(scratch.write(pieces), scratch, capacity=100, items_per_partition=200).collect()
    assert sorted(r.doc_id for r in rows) == list(range(len(lengths)))
    sequences = check_packing(rows, 100)
    sizes, counts = np.unique(lengths, return_counts=True)
    bound = math.ceil(packing.dual_feasible_bound(sizes, counts, 100))
    assert {(r.sequences, r.least_sequences) for r in rows} == {(sequences, bound)}
    together = len(packing.best_fit_decreasing(sorted(lengths, reverse=True), 100)[2])
    assert bound <= sequences <= 1.02 * together
    apart = sum(len(packing.best_fit_decreasing(sorted(lengths[i::16], reverse=True), 100)[2]) for i in range(16))
    assert sequences < apart


def test_equal_rows_are_dealt_evenly(spark, monkeypatch):
    """10,000 empty documents without an id: no group holds them all."""
    sizes = []
    group = packing._pack_group

    def watched(*args):
        pack = group(*args)

        def run(key, rows):
            out = pack(key, rows)
            return out.set_column(out.schema.get_field_index("start"), "start", packing.pa.array([rows.num_rows] * rows.num_rows, packing.pa.int64()))

        return run

    monkeypatch.setattr(packing, "_pack_group", watched)
    pieces = spark.range(10_000).selectExpr("CAST(NULL AS long) AS doc_id", "0 AS piece", "0L AS start", "1L AS length", "7L AS ids_crc32")
    scratch = Scratch(spark, "test")
    rows = packing.pack(scratch.write(pieces), scratch, capacity=100, items_per_partition=1000).collect()
    sizes = [r.start for r in rows]
    assert len(rows) == 10_000 and max(sizes) < 2000
    assert check_packing(rows, 100) == 100


def test_bounds_are_below_every_packing():
    rng = np.random.default_rng(2)
    for _ in range(200):
        lengths = rng.integers(1, 31, rng.integers(1, 40))
        sizes, counts = np.unique(lengths, return_counts=True)
        bound = packing.dual_feasible_bound(sizes, counts, 30)
        bins, offsets, left = packing.best_fit_decreasing(sorted(lengths.tolist(), reverse=True), 30)
        assert lengths.sum() / 30 - 1e-9 <= bound <= len(left) + 1e-9
    # over half: one bin each, which the sum of lengths doesn't show
    assert packing.dual_feasible_bound(np.array([16]), np.array([10]), 30) == 10
    assert packing.dual_feasible_bound(np.array([11]), np.array([10]), 30) == 5


def test_cut_only_long_documents():
    ids = np.arange(10, dtype="<u4").tobytes()
    assert [(p, s, n) for _, p, s, n, _ in packing.cut(7, ids, 4)] == [(0, 0, 4), (1, 4, 4), (2, 8, 2)]
    assert next(packing.cut(7, ids, 10))[4] == zlib.crc32(ids)
