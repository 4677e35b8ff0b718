"""Quality by nearest-neighbour voting in a latent-semantic space.

A text becomes weighted counts of hashed words and of word shapes (letter case,
punctuation, repetition). A truncated singular value decomposition of a bounded
sample of labelled rows gives the latent space; the sample's vectors and labels
are broadcast (their size is bounded by ``max_labelled``), and every document is
compared with all of them, exactly, in blocks of matrix products. The nearest
``neighbours`` vote with their cosine as weight.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerfold.llm._common import fold_crc, map_rows, words_of

#: Labelled rows that the model is fitted on, at most: those of the smallest id hashes.
MAX_LABELLED = 3000
DIMENSIONS = 48
NEIGHBOURS = 25
WORD_BINS = 3072
SHAPE_BINS = 1024
#: Weight of word shapes beside words in a document's vector.
SHAPE_WEIGHT = 2.0
THRESHOLD = 0.3
BLOCK = 256
CACHE_WORDS = 300_000

_BITS = WORD_BINS + SHAPE_BINS


def _shape(word: bytes) -> bytes:
    """Character classes of a whole word, runs collapsed: ``a`` lower or non-ASCII, ``A`` upper, ``0`` digit, else the character."""
    out = bytearray()
    for c in word:
        k = 97 if 97 <= c <= 122 or c > 127 else 65 if 65 <= c <= 90 else 48 if 48 <= c <= 57 else c
        if not out or out[-1] != k:
            out.append(k)
    return bytes(out)


class Features:
    """Feature numbers and counts of a text; remembers words it has seen."""

    def __init__(self):
        self.known: dict[bytes, tuple[int, int]] = {}

    def __call__(self, text: str | None) -> tuple[list[int], list[int]]:
        words = words_of(text)
        if len(self.known) > CACHE_WORDS:
            self.known.clear()
        known = self.known
        counts: dict[int, int] = {}
        for word, n in Counter(words).items():
            if (pair := known.get(word)) is None:
                pair = known[word] = (
                    zlib.crc32(word.lower()) % WORD_BINS,
                    WORD_BINS + 16 + zlib.crc32(_shape(word)) % (SHAPE_BINS - 16),
                )
            a, b = pair
            counts[a] = counts.get(a, 0) + n
            counts[b] = counts.get(b, 0) + n
        if words:
            # Repetition and length, in steps, beside the hashed shapes.
            again = sum(map(bytes.__eq__, words, words[1:]))
            if again:
                counts[WORD_BINS] = again
            counts[WORD_BINS + 1] = max(1, len(words) - len(set(words)))
            counts[WORD_BINS + 2 + min(7, int(math.log2(len(words)) / 2))] = max(1, len(words) // 8)
        return list(counts), list(counts.values())


class Space:
    """The fitted projection with the labelled vectors."""

    def __init__(self, weight: np.ndarray, basis: np.ndarray, vectors: np.ndarray, labels: np.ndarray, prior: float):
        self.weight, self.basis, self.vectors, self.labels, self.prior = weight, basis, vectors, labels, prior

    def latent(self, rows: list[tuple[list[int], list[int]]]) -> np.ndarray:
        """A unit vector for each row of features; zeros for a row without any."""
        out = np.zeros((len(rows), self.basis.shape[1]), dtype=np.float32)
        for i, (index, count) in enumerate(rows):
            if index:
                at, x = weigh(index, count, self.weight)
                out[i] = x @ self.basis[at]
        return unit(out)

    def score(self, rows, neighbours: int = NEIGHBOURS) -> np.ndarray:
        out = np.full(len(rows), self.prior)
        if not len(self.vectors):
            return out
        k = min(neighbours, len(self.vectors))
        for at in range(0, len(rows), BLOCK):
            latent = self.latent(rows[at : at + BLOCK])
            cosine = latent @ self.vectors.T
            near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
            weight = np.maximum(np.take_along_axis(cosine, near, axis=1), 0).astype(np.float64)
            total = weight.sum(axis=1)
            vote = (weight * self.labels[near]).sum(axis=1) / np.where(total > 0, total, 1)
            out[at : at + BLOCK] = np.where(total > 0, vote, self.prior)
        return np.clip(out, 0.0, 1.0)


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-12)


def weigh(index: Sequence[int], count: Sequence[int], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers and weights; words and shapes each have unit length before SHAPE_WEIGHT."""
    at = np.array(index, dtype=np.int32)
    x = np.array(count, dtype=np.float32)
    word = at < WORD_BINS
    # Words by damped counts and rarity, shapes by their share of the text.
    x = np.where(word, np.log1p(x) * idf[at], np.sqrt(x) * np.sqrt(idf[at]))
    for part, weight in ((word, 1.0), (~word, SHAPE_WEIGHT)):
        if norm := float(np.sqrt((x[part] ** 2).sum())):
            x[part] *= weight / norm
    return at, x.astype(np.float32)


def fit(rows: Sequence[tuple[Sequence[int], Sequence[int]]], labels: list[int], dimensions: int = DIMENSIONS) -> Space:
    """Latent space of labelled rows by subspace iteration; deterministic."""
    n = len(rows)
    prior = (sum(labels) + 1) / (n + 2)
    if not n:
        empty = np.zeros((0, dimensions), dtype=np.float32)
        return Space(np.ones(_BITS, np.float32), np.zeros((_BITS, dimensions), np.float32), empty, np.zeros(0), prior)
    seen = np.zeros(_BITS)
    for index, _ in rows:
        seen[index] += 1
    idf = np.log((1 + n) / (1 + seen)).astype(np.float32) + 1
    x = np.zeros((n, _BITS), dtype=np.float32)
    for i, (index, count) in enumerate(rows):
        if len(index):
            at, w = weigh(index, count, idf)
            x[i, at] = w
    wide = min(dimensions + 8, n, _BITS)
    q = np.linalg.qr(x @ np.random.default_rng(7).standard_normal((_BITS, wide)).astype(np.float32))[0]
    for _ in range(3):
        q = np.linalg.qr(x @ (x.T @ q))[0]
    basis = np.linalg.svd(q.T @ x, full_matrices=False)[2][:dimensions].T.astype(np.float32)
    return Space(idf, np.ascontiguousarray(basis), unit(x @ basis), np.array(labels, dtype=np.float64), prior)


def fit_labelled(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, dimensions: int = DIMENSIONS) -> Space:
    """Fits on at most ``max_labelled`` labelled rows of ``docs`` outside of the held-out fold.

    The sample is that of the smallest hashes of doc_id; its features (not its
    texts) come to the driver, packed to six bytes each, as long texts have
    thousands of them. Rows with a null id or label are left out; of
    several labels of an id the largest counts, and of several texts that of the least hash.
    """
    usable = labels.where("doc_id is not null and quality is not null").where(fold_crc("doc_id") != 0)
    chosen = usable.groupBy("doc_id").agg(F.max("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    picked = [(r["doc_id"], int(r["quality"] > 0)) for r in chosen.collect()]
    spark = docs.sparkSession
    small = F.broadcast(spark.createDataFrame(picked, "doc_id long, quality int"))  # max_labelled rows at most
    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("key")).join(small, "doc_id")

    def start():
        features = Features()

        def row(doc_id, text, key, quality):
            index, count = features(text)
            yield doc_id, key, quality, np.array(index, "<u2").tobytes(), np.array(count, "<u4").tobytes()

        return row

    schema = "doc_id long, key long, quality int, at binary, n binary"
    found = map_rows(texts.select("doc_id", "text", "key", "quality"), schema, start)
    found = found.groupBy("doc_id").agg(F.min_by(F.struct("quality", "at", "n"), "key").alias("x")).select("doc_id", "x.*")
    rows = found.toArrow().sort_by("doc_id")
    unpacked = lambda name, kind: [np.frombuffer(x.as_buffer(), kind) for x in rows.column(name)]
    features = list(zip(unpacked("at", "<u2"), unpacked("n", "<u4"), strict=True))
    return fit(features, rows.column("quality").to_pylist(), dimensions)


def score_documents(docs: DataFrame, space: Space, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of ``docs``.

    Empty and null texts get the share of label 1 among the labelled rows. Only
    the text enters a score. Rows are independent, repeated ones included, and
    further columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(space)

    def run(batches):
        features = Features()
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                score = shared.value.score([features(t.as_py()) for t in part.column(1)])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(2), pa.array(score), pa.array((score >= threshold).astype(np.int32))],
                    names=["doc_id", "held_out", "score", "predicted"],
                )

    held = docs.select("doc_id", "text", (fold_crc("doc_id") == 0).alias("held_out"))
    return held.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def keep_predicted(docs: DataFrame, space: Space, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` whose score reaches ``threshold``, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(space)
    at_text = docs.columns.index("text")

    def run(batches):
        features = Features()
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                score = shared.value.score([features(t.as_py()) for t in part.column(at_text)])
                yield part.filter(pa.array(score >= threshold))

    return docs.mapInArrow(run, docs.schema)
