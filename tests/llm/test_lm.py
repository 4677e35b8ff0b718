import math
import zlib
from collections import Counter

import numpy as np
import pytest

from ledgerfold.llm import lm
from ledgerfold.llm._common import lower_words_of
from ledgerfold.llm.queries import tokenizer_path

PATH = tokenizer_path("piece_bpe_32k.model")


def held_out(doc_id):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 5 == 1


@pytest.fixture(scope="module")
def lattice():
    return lm.lattice_of(PATH)


@pytest.fixture(scope="module")
def scores(lattice):
    n = np.arange(2 * lattice.n)
    return lm.scores_of(PATH, np.stack([1.0 + n % 7, 1.0 + n % 3], axis=1))


def arcs(lattice, word):
    """(start, end, ids) of a word's lattice, found by trying every piece at every place."""
    s = lm.SPACE + word
    out = [(k, k + len(p), [i]) for i, p in enumerate(lattice.pieces) if p is not None for k in range(len(s)) if s.startswith(p, k)]
    return out + [(k, k + 1, lattice.bytes_of(c).tolist()) for k, c in enumerate(s) if c not in lattice.single]


def all_segmentations(lattice, word):
    """The rows of scores of every way to cut the word, by enumeration."""
    found, n = arcs(lattice, word), len(word) + 1

    def walk(at):
        if at == n:
            yield []
        for start, end, ids in found:
            if start == at:
                for rest in walk(end):
                    yield ids + rest

    return [[*ids[:-1], ids[-1] + lattice.n] for ids in walk(0)]


WORDS = ["the", "thereon", "été", "日本", "x\U0001f642y", "a", "qzx", "nationality", "▁", "the"]


def test_forward_sums_all_segmentations(lattice, scores):
    got = lattice.forward(WORDS, scores)
    for word, row in zip(WORDS, got, strict=True):
        for z in (0, 1):
            wanted = math.log(sum(math.exp(scores[ids, z].sum()) for ids in all_segmentations(lattice, word)))
            assert row[z] == pytest.approx(wanted, abs=1e-9)


def test_expected_uses(lattice, scores):
    wanted = np.zeros(2 * lattice.n)
    for word in WORDS:
        ways = all_segmentations(lattice, word)
        weight = np.exp([scores[ids, 0].sum() for ids in ways])
        for ids, share in zip(ways, weight / weight.sum(), strict=True):
            np.add.at(wanted, ids, share)
    assert lattice.expect(WORDS, scores[:, 0]) == pytest.approx(wanted, abs=1e-9)


def test_long_words(lattice, scores, monkeypatch):
    long = ["ab" * 10_000, "abéz日" * 500, "x" * 2001]
    alone = lattice.forward(long, scores)
    assert (-1e7 < alone).all() and (alone < -1e3).all()
    assert lattice.forward(["the", *long, "on"], scores)[1:4] == pytest.approx(alone)
    monkeypatch.setattr(lm, "LONG_WORD", 30_000)
    assert lattice.forward(long, scores) == pytest.approx(alone)
    uses = lattice.expect(long, scores[:, 0])
    assert uses[lattice.n :].sum() == pytest.approx(3)
    sizes = np.where(lattice.sizes > 0, lattice.sizes, 0)
    bytes_only = uses.reshape(2, -1)[:, lattice.byte_ids].sum()
    assert (uses.reshape(2, -1).sum(axis=0) * sizes).sum() + bytes_only == pytest.approx(sum(len(w) + 1 + 2 * sum(c not in lattice.single for c in w) for w in long), rel=1e-6)


def test_stretches_do_not_matter(lattice, scores, monkeypatch):
    words = [w * k for w in ("th", "on", "é") for k in range(1, 12)]
    whole = lattice.forward(words, scores), lattice.expect(words, scores[:, 1])
    monkeypatch.setattr(lm, "LAID_OUT", 20)
    assert lattice.forward(words, scores) == pytest.approx(whole[0])
    assert lattice.expect(words, scores[:, 1]) == pytest.approx(whole[1])


def test_plain_sums_are_those_of_logs(lattice, scores, monkeypatch):
    """Probabilities are summed as they are unless they are too small, which are summed by their logs."""
    words = [w * k for w in ("the", "onz", "é日", "\U0001f642") for k in (1, 2, 5, 30, 60, 300)]
    plain = lattice.forward(words, scores), lattice.expect(words, scores[:, 1])
    assert plain[0].min() < math.log(lm.PLAIN) < plain[0].max()
    monkeypatch.setattr(lm, "PLAIN", math.inf)
    assert lattice.forward(words, scores) == pytest.approx(plain[0], rel=1e-12)
    assert lattice.expect(words, scores[:, 1]) == pytest.approx(plain[1], rel=1e-9)


def test_words_are_dealt_once(spark, docs, monkeypatch):
    """Rounds and values read the words as they lie, however many rounds there are."""
    frame, dealt = type(docs), []
    real = frame.repartition
    monkeypatch.setattr(frame, "repartition", lambda self, *a: dealt.append(a) or real(self, *a))
    lm.score_documents(docs, PATH, rounds=2)
    assert len(dealt) == 1


def test_scores_are_a_distribution(lattice, scores):
    """One unit for pieces that begin a word, one for all others."""
    begins = np.array([p is not None and p[0] == lm.SPACE for p in lattice.pieces] * 2)
    assert np.exp(scores[begins]).sum(axis=0) == pytest.approx([1.0, 1.0])
    assert np.exp(scores[~begins]).sum(axis=0) == pytest.approx([1.0, 1.0])


def test_vocabulary_scores_fall_with_rank(lattice):
    given = lm.vocabulary_scores(PATH)[:, 0]
    rank = {p: i for i, p in enumerate(lattice.pieces) if p}
    for a, b in (("▁the", "▁nationality"), ("er", "ation")):
        if a in rank and b in rank:
            assert given[rank[a]] > given[rank[b]]
    assert given[: lattice.n] == pytest.approx(given[lattice.n :])


def test_expectation_raises_likelihood(lattice):
    words = ["thereon", "hereon", "thereat", "hereat", "ander", "under"]
    flat = lm.scores_of(PATH, np.zeros((2 * lattice.n, 1)))
    better = lm.scores_of(PATH, lattice.expect(words, flat[:, 0])[:, None])
    assert lattice.forward(words, better).sum() > lattice.forward(words, flat).sum()


def brute_base(docs):
    counts = Counter()
    for d in docs:
        if not held_out(d.doc_id):
            counts.update([*lower_words_of(d.text), b""])
    n, v = sum(counts.values()), len(counts)
    out = []
    for d in docs:
        tokens = [*lower_words_of(d.text), b""]
        score = sum(math.log10((counts[t] + 0.5) / (n + 0.5 * (v + 1))) for t in tokens)
        out.append((d.doc_id, held_out(d.doc_id), len(tokens), sum(counts[t] > 0 for t in tokens), n, score))
    return out, counts


@pytest.mark.parametrize("hot_share", [lm.HOT_SHARE, 0.01, 2.0])
def test_whole_table(spark, docs, hot_share):
    rows = docs.collect()
    wanted, counts = brute_base(rows)
    got = lm.score_documents(docs, PATH, hot_share=hot_share).collect()
    order = lambda r: (str(r[0]), r[2], r[3])
    assert len(got) == len(wanted)
    for g, w in zip(sorted(map(tuple, got), key=order), sorted(wanted, key=order), strict=True):
        assert g[:5] == w[:5]
        assert g[5] == pytest.approx(w[5], abs=1e-6)
        assert math.isfinite(g[6]) and g[6] < 0


@pytest.mark.parametrize(("column", "most"), [(None, 8), ("source", 8), ("source", 1)])
def test_scores_agree_with_the_formula(spark, docs, lattice, column, most):
    from ledgerfold.llm._common import Scratch

    rows = docs.collect()
    training = [d for d in rows if not held_out(d.doc_id)]
    values = [v for v, _ in sorted(Counter(d.source for d in training if d.source).items(), key=lambda x: (-x[1], x[0]))][:most] if column else []
    class_of = lambda d: values.index(d.source) if column and d.source in values else len(values)
    classes = sorted({class_of(d) for d in training})
    counts, by_class = Counter(), {z: Counter() for z in classes}
    for d in training:
        tokens = [*lower_words_of(d.text), b""]
        counts.update(tokens)
        by_class[class_of(d)].update(tokens)
    words = Scratch(spark, "test").write(lm.count_words(docs, values, column).where("c > 0 AND word <> ''"))
    scores = lm.train_scores(words, PATH, classes)
    n, v = sum(counts.values()), len(counts)

    def probability(w, k):
        own = by_class[classes[k]]
        passed = lm.DISCOUNT * len(own) / sum(own.values())
        spelled = math.exp(lattice.forward([w.decode("utf-8", "replace")], scores)[0, k]) if w else 0
        anywhere = max(counts[w] - lm.DISCOUNT, 0) / (n - lm.DISCOUNT * v)
        return max(own[w] - lm.DISCOUNT, 0) / sum(own.values()) + passed * (lm.SHARED * anywhere + (1 - lm.SHARED) * spelled)

    got = {(r.doc_id, r.n_tokens): r.score for r in lm.score_documents(docs, PATH, class_column=column, max_classes=most).collect()}
    checked = 0
    for d in rows:
        tokens = [*lower_words_of(d.text), b""]
        if len(tokens) < 400 and max(map(len, tokens)) < 200:
            each = [math.log10(by_class[z][b""] / counts[b""]) + sum(math.log10(probability(w, k)) for w in tokens) for k, z in enumerate(classes)]
            wanted = max(each) + math.log10(sum(10 ** (x - max(each)) for x in each))
            assert got[d.doc_id, len(tokens)] == pytest.approx(wanted, abs=1e-6)
            checked += 1
    assert checked > 50


def test_classes_help_held_out_documents(spark):
    """Two languages that share no word: knowing which raises the probability of what is held out."""
    import random

    rng = random.Random(8)
    rows = [(i, " ".join("qw"[i % 2] + rng.choice("abcdefghijklmnop") for _ in range(60)), "qw"[i % 2]) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    total = lambda **kind: sum(r.score for r in lm.score_documents(docs, PATH, **kind).collect() if r.held_out)
    base = sum(r.base_score for r in lm.score_documents(docs, PATH).collect() if r.held_out)
    assert total(class_column="lang") > total() and total(class_column="lang") > base


def test_without_training_rows_and_empty(spark, docs, none):
    only = docs.where("crc32(CAST(coalesce(CAST(doc_id AS STRING), '') AS BINARY)) % 5 = 1")
    for column in (None, "lang"):
        out = lm.score_documents(only, PATH, class_column=column).collect()
        assert len(out) == only.count() and all(r.train_tokens == 0 and r.n_known == 0 and r.held_out and r.score < 0 for r in out)
        assert lm.score_documents(none, PATH, class_column=column).collect() == []


def test_the_model_beats_the_base_on_held_out_documents(spark):
    from ledgerfold.llm.queries import op5_lm_scoring

    rows = op5_lm_scoring(spark, "/root/testdata/sf0.01").where("held_out").collect()
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)
