"""Document probability by marginalising over a subword lattice.

A text is a sequence of words and an end. Each word is a lattice over the pieces
of an existing subword vocabulary: arcs are the pieces that match (found by one
automaton), and the forward recursion in log space sums over all segmentations.
Arcs are weighted by the vocabulary's unigram scores. A file of merges has no
probabilities but scores that rank its pieces; read as ranks by Zipf's law they are
the scores to begin with, and expectation-maximisation over the lattices of all
distinct training words carries them on. A piece has scores for four places in a word:
pieces that begin one share one unit of probability and all others another, and
in either a piece that ends the word is told from one that doesn't, so that words
need no symbol for their end.

The whole word is one more arc, scored by its training count under absolute
discounting; the mass taken off is shared by the pieces and, in a small part, by
words of other classes. Classes are the values of a column (such as the language)
of the training documents. Each has its own scores, and a document's probability
is summed over the classes it could be of, as it is over segmentations; the column
is never read for the document that is scored. The probabilities of all texts
sum to one at most.

Counting and estimation are distributed: words are counted per task and summed by
shuffle; what comes to the driver is bounded by the vocabulary and the number of
classes. Scoring meets counts in two ways. Words with at least one in
``1 / HOT_SHARE`` tokens can be no more than that many, and are broadcast; all
others join by word, where no word has more than that share of the rows.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain, groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerfold.llm._common import Scratch, fold_crc, lower_words_of, map_rows, spark_schema

HOT_SHARE = 2e-6
DISCOUNT = 0.7
#: Part of the mass taken off that goes to words of other classes.
SHARED = 0.1
#: Values of the class column with scores of their own, at most; all others make up one more class.
MAX_CLASSES = 8
EM_ROUNDS = 3
SMOOTHING = 0.01
FLUSH_WORDS = 400_000
WORDS_PER_TASK = 40_000
#: Characters laid out at once, and of a word that is laid out or walked on its own.
LAID_OUT = 200_000
LONG_WORD = 2_000
#: Words whose probabilities are all above this are summed without logs: what underflows beside them is less than 1e-50 of any.
PLAIN = 1e-250
SPACE, GAP = "▁", "\n"
LN10 = math.log(10)


@dataclass(frozen=True)
class Layout:
    """Arcs between the nodes of words that lie one after another; ``spelled`` are the byte pieces of the characters that ``piece`` numbers from the vocabulary's size on."""

    start: np.ndarray
    to: np.ndarray
    piece: np.ndarray
    word: np.ndarray
    first: np.ndarray
    last: np.ndarray
    spelled: list[np.ndarray]

    def steps(self, forward: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(arcs, where each node's arcs begin, nodes) of nodes equally far from the start of their words, nearest or farthest first."""
        node = self.to if forward else self.start
        order = np.argsort(node, kind="stable")
        depth = (node - self.first[self.word])[order]
        if len(self.last) > 1:  # no word is long then, and short integers are sorted fastest
            depth = depth.astype(np.int16)
        order = order[np.argsort(depth if forward else -depth, kind="stable")]
        node = node[order]
        runs = np.flatnonzero(np.diff(node, prepend=-1))
        depth = node[runs] - self.first[self.word[order[runs]]]
        cuts = [*np.flatnonzero(np.diff(depth, prepend=-1)).tolist(), len(runs)]
        edges = np.append(runs, len(order))
        for a, b in zip(cuts, cuts[1:], strict=False):
            yield order[edges[a] : edges[b]], runs[a:b] - edges[a], node[runs[a:b]]


def _sums(x: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Logs of the sums over runs that begin at ``begins``."""
    most = np.maximum.reduceat(x, begins)
    shifted = x - np.repeat(most, np.diff(np.append(begins, len(x))))
    return most + np.log(np.add.reduceat(np.exp(shifted), begins))


def _sweep(size: int, begin: np.ndarray, steps: Iterable, beside: np.ndarray, arc: np.ndarray) -> np.ndarray:
    """Log sums over all ways from the nodes ``begin`` to each node; ``beside`` has the node that an arc comes from."""
    out = np.full(size, -np.inf)
    out[begin] = 0.0
    for arcs, begins, nodes in steps:
        out[nodes] = _sums(out[beside[arcs]] + arc[arcs], begins)
    return out


def _plain_sweep(size: int, begin: np.ndarray, steps: Iterable, beside: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The same sums themselves, from the arcs' probabilities."""
    out = np.zeros(size)
    out[begin] = 1.0
    for arcs, begins, nodes in steps:
        out[nodes] = np.add.reduceat(out[beside[arcs]] * weight[arcs], begins)
    return out


class Lattice:
    """An automaton of the vocabulary's pieces, and a table of those of one character.

    Words are handled many at a time: one step of a recursion takes the arcs of all
    words that end equally far from their word's start. Scores have two rows for each
    piece, first all that don't end a word, then all that do, and a column for each class.
    """

    def __init__(self, pieces: list[str | None], byte_ids: list[int]):
        import ahocorasick

        self.pieces, self.byte_ids = pieces, np.array(byte_ids)
        self.n = len(pieces)
        self.single = {p: i for i, p in enumerate(pieces) if p is not None and len(p) == 1}
        self.by_code = np.full(0x110000, -1, dtype=np.int32)
        self.by_code[list(map(ord, self.single))] = list(self.single.values())
        self.sizes = np.array([len(p or "") for p in pieces], dtype=np.int64)
        self.automaton = ahocorasick.Automaton()
        for i, p in enumerate(pieces):
            if p is not None and len(p) > 1:
                self.automaton.add_word(p, i)
        self.automaton.make_automaton()

    def _found(self, text: str) -> Iterable[tuple[int, int]]:
        """(place of the last character, piece) of all pieces of several characters in ``text``."""
        return self.automaton.iter(text) if len(self.automaton) else ()

    def lay_out(self, words: list[str]) -> Layout:
        """Matching pieces, and bytes for a character that is no piece."""
        text = "".join([SPACE + w + GAP for w in words])
        lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
        first = np.concatenate(([0], np.cumsum(lengths + 1)[:-1]))
        found = np.fromiter(chain.from_iterable(self._found(text)), np.int64).reshape(-1, 2)
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
        place = np.flatnonzero(codes != ord(GAP))
        codes = codes[place]
        alone = self.by_code[codes].astype(np.int64)
        odd = np.flatnonzero(alone < 0)
        marks, which = np.unique(codes[odd], return_inverse=True)
        alone[odd] = self.n + which
        to, piece = np.concatenate((found[:, 0], place)) + 1, np.concatenate((found[:, 1], alone))
        start = np.concatenate((found[:, 0] + 1 - self.sizes[found[:, 1]], place))
        word = np.repeat(np.arange(len(words)), lengths + 1)[start]
        return Layout(start, to, piece, word, first, first + lengths, [self.bytes_of(chr(c)) for c in marks.tolist()])

    def bytes_of(self, character: str) -> np.ndarray:
        return self.byte_ids[list(character.encode("utf-8", "surrogatepass"))]

    def spelling(self, ids: np.ndarray, ends: bool) -> np.ndarray:
        """Rows of scores for a character's bytes, of which the last may end the word."""
        return np.append(ids[:-1], ids[-1] + self.n * ends)

    def _rows(self, at: Layout) -> np.ndarray:
        """For each arc the row of its score; spelled characters have two rows each after those of pieces."""
        ends = at.to == at.last[at.word]
        return np.where(at.piece < self.n, at.piece + self.n * ends, 2 * at.piece + ends)

    def _arcs(self, at: Layout, rows: np.ndarray, scores: np.ndarray) -> np.ndarray:
        """The score of each arc under one column of scores."""
        if at.spelled:
            scores = np.concatenate((scores, [scores[self.spelling(ids, e)].sum() for ids in at.spelled for e in (False, True)]))
        return scores[rows]

    def forward(self, words: list[str], scores: np.ndarray) -> np.ndarray:
        """Natural log of each word's probability, summed over all segmentations; a column for each class."""
        out = np.empty((len(words), scores.shape[1]))
        order = sorted(range(len(words)), key=lambda i: len(words[i]))
        for own in _stretches(order, [len(words[i]) for i in order]):
            if len(own) == 1 and len(words[own[0]]) > LONG_WORD:
                out[own[0]] = self._walk(words[own[0]], scores)
            else:
                at = self.lay_out([words[i] for i in own])
                rows, steps, size = self._rows(at), list(at.steps(forward=True)), at.last[-1] + 1
                for z in range(scores.shape[1]):
                    arc = self._arcs(at, rows, scores[:, z])
                    total = _plain_sweep(size, at.first, steps, at.start, np.exp(arc))[at.last]
                    out[own, z] = np.log(total) if total.min() > PLAIN else _sweep(size, at.first, steps, at.start, arc)[at.last]
        return out

    def _walk(self, word: str, scores: np.ndarray) -> np.ndarray:
        """The same for one word of any length; only as many sums are held as the longest piece has characters."""
        held = int(self.sizes.max()) + 1
        alpha = np.full((held, scores.shape[1]), -np.inf)
        alpha[0] = 0.0
        s = SPACE + word
        ends = groupby(self._found(s), itemgetter(0))
        end, found = next(ends, (-1, ()))
        for k, c in enumerate(s):
            ways = []
            last = k == len(s) - 1
            if end == k:
                ways = [alpha[(k + 1 - self.sizes[i]) % held] + scores[i + self.n * last] for _, i in found]
                end, found = next(ends, (-1, ()))
            own = [self.single[c] + self.n * last] if c in self.single else self.spelling(self.bytes_of(c), last)
            ways.append(alpha[k % held] + scores[own].sum(axis=0))
            alpha[(k + 1) % held] = np.logaddexp.reduce(ways, axis=0)
        return alpha[len(s) % held]

    def expect(self, words: list[str], scores: np.ndarray) -> np.ndarray:
        """Expected uses of each row of ``scores``, one column, over ``words``."""
        counts = np.zeros(2 * self.n)
        words = sorted(words, key=len)
        for own in _stretches(words, list(map(len, words))):
            at = self.lay_out(own)
            rows, steps, size = self._rows(at), list(at.steps(forward=True)), at.last[-1] + 1
            arc = self._arcs(at, rows, scores)
            weight = np.exp(arc)
            alpha = _plain_sweep(size, at.first, steps, at.start, weight)
            total = alpha[at.last]
            if total.min() > PLAIN:
                beta = _plain_sweep(size, at.last, at.steps(forward=False), at.to, weight)
                share = alpha[at.start] * weight * beta[at.to] / total[at.word]
            else:
                alpha = _sweep(size, at.first, steps, at.start, arc)
                beta = _sweep(size, at.last, at.steps(forward=False), at.to, arc)
                share = np.exp(alpha[at.start] + arc + beta[at.to] - alpha[at.last][at.word])
            uses = np.bincount(rows, share, 2 * (self.n + len(at.spelled)))
            counts += uses[: 2 * self.n]
            for k, ids in enumerate(at.spelled):
                for ends in (False, True):
                    np.add.at(counts, self.spelling(ids, ends), uses[2 * (self.n + k) + ends])
        return counts


def _stretches(items: list, lengths: list[int]) -> Iterator[list]:
    """``items`` (shortest first) in lists that can be laid out at once; a long one is a list of its own."""
    own, chars = [], 0
    for item, n in zip(items, lengths, strict=True):
        if own and (chars + n > LAID_OUT or n > LONG_WORD):
            yield own
            own, chars = [], 0
        own.append(item)
        chars += n + 2
    if own:
        yield own


@lru_cache(maxsize=2)
def _inventory(path: str):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces: list[str | None] = []
    byte_ids = [0] * 256
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            byte_ids[int(piece[1:-1], 16)] = i
            pieces.append(None)
        elif model.is_control(i) or model.is_unknown(i) or any("A" <= c <= "Z" for c in piece) or GAP in piece:
            pieces.append(None)  # never in a lower-cased word
        else:
            pieces.append(piece)
    return model, pieces, byte_ids


@lru_cache(maxsize=2)
def lattice_of(path: str) -> Lattice:
    _, pieces, byte_ids = _inventory(path)
    return Lattice(pieces, byte_ids)


def scores_of(path: str, counts: np.ndarray) -> np.ndarray:
    """Smoothed log probabilities, by class, of the places of all pieces that can match and of bytes; ``counts`` has a column for each class.

    Pieces that begin a word share one unit, all others another.
    """
    _, pieces, byte_ids = _inventory(path)
    n = len(pieces)
    begin = np.array([i for i, p in enumerate(pieces) if p is not None and p[0] == SPACE], dtype=np.int64)
    other = np.array(sorted({i for i, p in enumerate(pieces) if p is not None and p[0] != SPACE} | set(byte_ids)), dtype=np.int64)
    out = np.full(counts.shape, -np.inf)
    for own in (begin, other):
        rows = np.concatenate((own, own + n))
        smooth = counts[rows] + SMOOTHING
        out[rows] = np.log(smooth / smooth.sum(axis=0))
    return out


def vocabulary_scores(path: str) -> np.ndarray:
    """The scores that the vocabulary's file has, as one column of log probabilities, places of a piece being alike.

    A unigram file's are logs of probabilities. A file of merges numbers its pieces downwards; by Zipf's law the
    k-th is used in proportion to 1 / k. Bytes stand last.
    """
    model, pieces, byte_ids = _inventory(path)
    given = np.array([model.get_score(i) for i in range(len(pieces))])
    given[byte_ids] = given.min()
    whole = (given == np.round(given)).all()
    weight = 1 / (1 + given.max() - given) if whole else np.exp(given - given.max())
    # As if the file had been counted on a large text, so that smoothing is without weight.
    return scores_of(path, np.tile(weight / weight.sum() * 1e9, 2)[:, None])


def count_words(docs: DataFrame, classes: list | None = None, class_column: str | None = None) -> DataFrame:
    """(word, c, t, c0, c1, ...): uses in training rows, in all rows, and in training rows of each class; the empty word stands for a text's end.

    ``classes`` are values of ``class_column``; rows of other values are of the class after the last of them.
    """
    n = len(classes or []) + 1
    schema = "word string, c long, t long, " + ", ".join(f"c{z} long" for z in range(n))
    fields = spark_schema(docs.sparkSession, schema)

    def run(batches):
        by_class: list[Counter[bytes]] = [Counter() for _ in range(n)]
        held: Counter[bytes] = Counter()

        def flush():
            words = list(dict.fromkeys(chain(*by_class, held)))
            for at in range(0, len(words), 20_000):
                part = words[at : at + 20_000]
                uses = [[own.get(w, 0) for w in part] for own in by_class]
                c = list(map(sum, zip(*uses, strict=True)))
                t = [n + held.get(w, 0) for n, w in zip(c, part, strict=True)]
                columns = [[w.decode("utf-8", "replace") for w in part], c, t, *uses]
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(columns, fields, strict=True)], schema=fields)
            for own in (*by_class, held):
                own.clear()

        for batch in batches:
            texts, out, z = batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist()
            for i in range(batch.num_rows):
                into = held if out[i] else by_class[z[i]]
                into.update(lower_words_of(texts[i].as_py()))
                into[b""] += 1
                if sum(map(len, by_class)) + len(held) > FLUSH_WORDS:
                    yield from flush()
        yield from flush()

    z = F.lit(n - 1)
    for i, value in reversed(list(enumerate(classes or []))):
        z = F.when(F.col(class_column) == F.lit(value), i).otherwise(z)
    rows = docs.select("text", (fold_crc("doc_id") == 1).alias("held_out"), z.alias("z"))
    counts = [c for c in fields.names if c != "word"]
    return rows.mapInArrow(run, schema).groupBy("word").agg(*[F.sum(c).alias(c) for c in counts])


def _piece_counts(words: DataFrame, path: str, classes: list[int], scores: np.ndarray) -> np.ndarray:
    """Expected uses under ``scores``, by place and class, over each class's distinct training words."""
    schema = "z int, id int, n double"

    def run(batches):
        lattice = lattice_of(path)
        counts = np.zeros((2 * lattice.n, len(classes)))
        held: list[list[str]] = [[] for _ in classes]
        chars = [0] * len(classes)

        def flush(z):
            if held[z]:
                counts[:, z] += lattice.expect(held[z], scores[:, z])
            held[z], chars[z] = [], 0

        for batch in batches:
            for z in range(len(classes)):
                own = batch.column(0).filter(pa.compute.greater(batch.column(z + 1), 0)).to_pylist()
                held[z] += own
                chars[z] += sum(map(len, own))
                if chars[z] > LAID_OUT:
                    flush(z)
        for z in range(len(classes)):
            flush(z)
        at, z = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(z, pa.int32()), pa.array(at, pa.int32()), pa.array(counts[at, z])], names=["z", "id", "n"])

    summed = words.select("word", *[f"c{z}" for z in classes]).mapInArrow(run, schema).groupBy("z", "id").agg(F.sum("n").alias("n"))
    out = np.zeros((2 * len(_inventory(path)[1]), len(classes)))
    for r in summed.collect():  # twice as many rows as the vocabulary has pieces, for each class
        out[r["id"], r["z"]] = r["n"]
    return out


def train_scores(words: DataFrame, path: str, classes: list[int], rounds: int = EM_ROUNDS) -> np.ndarray:
    """Log scores of places of pieces, a column for each of ``classes``, from the distinct training words (columns word, c0, c1, ...)."""
    scores = np.repeat(vocabulary_scores(path), len(classes), axis=1)
    for _ in range(rounds):
        scores = scores_of(path, _piece_counts(words, path, classes, scores))
    return scores


@dataclass(frozen=True)
class Totals:
    """Tokens (n) and distinct tokens (v) of the training documents, whole and by class."""

    n: int
    v: int
    class_n: np.ndarray
    class_v: np.ndarray

    def log_model(self, c: np.ndarray, by_class: np.ndarray, spelled: np.ndarray) -> np.ndarray:
        """Natural log of each word's probability in each class, from its counts and the log sums of its lattice."""
        if not self.n:
            return math.log(0.5) + np.where(np.isneginf(spelled), 0.0, spelled)
        own = np.maximum(by_class - DISCOUNT, 0) / self.class_n
        passed = DISCOUNT * self.class_v / self.class_n
        anywhere = np.maximum(c - DISCOUNT, 0) / (self.n - DISCOUNT * self.v)
        with np.errstate(divide="ignore"):
            return np.logaddexp(np.log(own + passed * SHARED * anywhere[:, None]), np.log(passed * (1 - SHARED)) + spelled)


def _classes(docs: DataFrame, class_column: str | None, max_classes: int) -> list:
    """The most frequent values of the column in training rows."""
    if class_column is None:
        return []
    training = docs.where((fold_crc("doc_id") != 1) & F.col(class_column).isNotNull())
    top = training.groupBy(class_column).agg(F.count("*").alias("_n")).orderBy(F.desc("_n"), class_column).limit(max_classes)
    return [r[0] for r in top.collect()]


def score_documents(
    docs: DataFrame,
    vocabulary_path: str,
    rounds: int = EM_ROUNDS,
    hot_share: float = HOT_SHARE,
    class_column: str | None = None,
    max_classes: int = MAX_CLASSES,
) -> DataFrame:
    """Base and model scores of every row of ``docs`` (doc_id, text, and ``class_column`` if one is named).

    Training rows are those whose crc32(doc_id as text) mod 5 isn't 1; a null id
    counts as empty text. A null or empty text is its end alone. Repeated rows
    count and are scored each on their own; further columns are ignored. The
    ``max_classes`` most frequent values of the class column are classes, all
    other values and null one more. Without training rows all words rest on the
    pieces' smoothing.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "lm")
    values = _classes(docs, class_column, max_classes)
    counted = scratch.write(count_words(docs, values, class_column))
    every = range(len(values) + 1)
    told = counted.agg(
        *[F.sum(c).alias(c) for c in ("c", "t", *[f"c{z}" for z in every])],
        *[F.count(F.when(F.col(c) > 0, 1)).alias(f"v_{c}") for c in ("c", *[f"c{z}" for z in every])],
        F.count("*").alias("words"),
    ).first()
    n, v, tokens, distinct = int(told["c"] or 0), int(told["v_c"]), int(told["t"] or 0), int(told["words"])
    classes = [z for z in every if told[f"c{z}"]] or [0]
    columns = [f"c{z}" for z in classes]
    totals = Totals(n, v, np.array([told[c] or 0 for c in columns], dtype=float), np.array([told[f"v_{c}"] for c in columns], dtype=float))
    tasks = max(1, math.ceil(distinct / WORDS_PER_TASK))
    # Dealt evenly by word: counting leaves few partitions, and the lattices are the work. Every round reads these files as they lie.
    spread = scratch.write(counted.where("word <> ''").repartition(tasks, "word"))
    scores = train_scores(spread.where("c > 0"), vocabulary_path, classes, rounds)
    shared = spark.sparkContext.broadcast(scores)
    base_of = lambda c: math.log10((c + 0.5) / (n + 0.5 * (v + 1)))
    models = [f"m{k}" for k in range(len(classes))]

    def value(batches):
        lattice = lattice_of(vocabulary_path)
        for batch in batches:
            if not batch.num_rows:
                continue
            c = batch.column(1).to_numpy()
            by_class = np.stack([x.to_numpy() for x in batch.columns[3:]], axis=1)
            model = totals.log_model(c, by_class, lattice.forward(batch.column(0).to_pylist(), shared.value)) / LN10
            base = np.log10((c + 0.5) / (n + 0.5 * (v + 1)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(base), *map(pa.array, model.T)], names=["word", "c", "t", "base", *models])

    valued = spread.select("word", "c", "t", *columns)
    scored = scratch.write(valued.mapInArrow(value, "word string, c long, t long, base double, " + ", ".join(f"{m} double" for m in models)))

    hot = scored.where(F.col("t") >= hot_share * tokens)  # 1 / hot_share words at most
    hot = hot.select("word", (F.col("c") > 0).cast("double").alias("known"), "base", *models).toArrow()
    end = counted.where("word = ''").first()
    end_c = int(end["c"]) if end else 0
    end_by_class = np.array([[end[c] if end else 0 for c in columns]])
    end_model = (totals.log_model(np.array([end_c]), end_by_class, np.full((1, len(classes)), -np.inf)) / LN10)[0]
    prior = end_by_class[0] / end_c if end_c else np.ones(len(classes)) / len(classes)
    # By word: a row of the table, with its base, whether it is known, and the scores of each class.
    rows_of = {w.encode("utf-8"): k for k, w in enumerate(hot.column(0).to_pylist())}
    values_of = np.stack([x.to_numpy() for x in hot.columns[1:]], axis=1)
    table = spark.sparkContext.broadcast((rows_of, values_of))

    def begin():
        known, hot_values = table.value
        known_get = known.get
        first = np.array([end_c > 0, base_of(end_c), *end_model], dtype=float)

        def row(doc_id, text, held_out, key):
            words = lower_words_of(text)
            uses = Counter(map(known_get, words))
            rare: Counter[bytes] = Counter()
            if uses.pop(None, 0):
                rare.update([w for w in words if w not in known])
            found = np.fromiter(uses.keys(), np.int64, len(uses))
            seen, base, *model = (first + np.fromiter(uses.values(), np.int64, len(uses)) @ hot_values[found]).tolist()
            yield (doc_id, held_out, key, len(words) + 1, int(seen), base, *model, [w.decode("utf-8", "replace") for w in rare], list(rare.values()))

        return row

    rows = docs.select("doc_id", "text", (fold_crc("doc_id") == 1).alias("held_out"), F.monotonically_increasing_id().alias("key"))
    sums = ["n_known", "base", *models]
    schema = (
        "doc_id long, held_out boolean, key long, n_tokens long, n_known long, base double, "
        + ", ".join(f"{m} double" for m in models)
        + ", rare array<string>, uses array<int>"
    )
    parts = scratch.write(map_rows(rows, schema, begin))
    rare = (
        parts.select("key", F.explode(F.arrays_zip("rare", "uses")).alias("x"))
        .select("key", F.col("x.rare").alias("word"), F.col("x.uses").alias("uses"))
        .join(scored.select("word", "c", "base", *models), "word")
        .select(
            "key",
            F.lit(None).cast("long").alias("doc_id"),
            F.lit(None).cast("boolean").alias("held_out"),
            F.lit(None).cast("long").alias("n_tokens"),
            F.when(F.col("c") > 0, F.col("uses")).otherwise(0).cast("long").alias("n_known"),
            *[(F.col("uses") * F.col(m)).alias(m) for m in ("base", *models)],
        )
    )
    whole = (
        parts.select("key", "doc_id", "held_out", "n_tokens", *sums)
        .unionByName(rare)
        .groupBy("key")
        .agg(*[F.max(c).alias(c) for c in ("doc_id", "held_out", "n_tokens")], *[F.sum(c).alias(c) for c in sums])
    )
    # log10 of the sum over classes, from the largest.
    likely = [F.col(m) + float(math.log10(p)) for m, p in zip(models, prior.tolist(), strict=True)]
    most = F.greatest(*likely) if len(likely) > 1 else likely[0]
    score = most + F.log10(sum((F.pow(F.lit(10.0), x - most) for x in likely), F.lit(0.0)))
    return whole.select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), score.alias("score")
    )
