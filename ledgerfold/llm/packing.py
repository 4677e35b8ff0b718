"""Best-fit packing of token sequences with certified bin counts.

Documents become token ids (an existing tokenizer's, then one end id), only
those longer than ``capacity`` are cut, and the pieces are packed into as few
sequences of ``capacity`` tokens as can be.

Pieces are dealt by the hash of their place in the written table into partitions of
about ``items_per_partition``, so no key decides where rows go. Each partition runs best-fit decreasing and computes
dual-feasible-function lower bounds of its own bin count. A partition whose count
exceeds the real-valued bound has a gap: the pieces in its bins with room left
are released, dealt anew together with those of other such partitions (whole old
bins at a time) and packed again; a new packing is taken only if it saves bins.
Rounds end when the count meets the bound of the whole input's histogram of
lengths, when what is left fits one partition, or when a round saves nothing to speak
of. The result carries the certificate: how many sequences there are, and the bound
that no packing can go below.

Only numbers move: texts are tokenized once and never shuffled.
"""

from __future__ import annotations

import math
import re
import unicodedata
import zlib
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerfold.llm._common import Scratch, spark_schema, to_batch

CAPACITY = 4096
END_ID = 1
#: Distinct words whose ids a Python worker remembers before it starts afresh.
CACHE_WORDS = 500_000
#: Documents whose new words are encoded in one call.
DOCS_AT_ONCE = 64

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = PIECES + ", bin long, offset long, open boolean, room int, bins int, bound double"


def _byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class WordIds:
    """Ids of texts by a tokenizer that drops white space, as little-endian uint32 bytes.

    No token crosses white space, so the ids of a text are those of its parts
    between blanks, of which each distinct one is encoded once. Merging by
    the file's rules is done for many words in one call of tiktoken: a word's end
    is a zero byte, which joins its last byte before anything else. Merging by the
    rank of what two parts make gives the same ids as merging by the rank of the
    pair, since below a token's rank its own bytes can only have come to its two
    halves. What isn't plain (separator controls, zero bytes, characters that are not
    in normal form) goes to the tokenizers library whole.
    """

    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

    def __init__(self, path: str):
        import json

        import regex
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        letters, ends = _byte_letters(), "</w>"
        raw = lambda t: bytes(letters[c] for c in t.removesuffix(ends)) + b"\0" * t.endswith(ends)
        vocabulary, ranks, ids = model["vocab"], {}, []
        for letter, byte in sorted(letters.items(), key=lambda x: x[1]):
            ranks[bytes([byte])] = byte
            ids.append(vocabulary[letter])
        for letter, byte in sorted(letters.items(), key=lambda x: x[1]):
            ranks[bytes([byte, 0])] = 256 + byte
            ids.append(vocabulary[letter + ends])
        for merge in model["merges"]:
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            ranks[raw(left + right)] = len(ids)
            ids.append(vocabulary[left + right])
        self.gap = ranks[b"\n\0"]
        self.ids = np.array(ids, dtype="<u4")
        self.merge = tiktoken.Encoding("words", pat_str=r"[^\x00]+\x00", mergeable_ranks=ranks, special_tokens={})
        self.find = regex.compile(self.PATTERN + r"|\n").findall
        # Zero bytes, and the letter whose lower case depends on its place.
        self.odd = re.compile("[\x00\u03a3]").search
        self.known: dict[str, bytes] = {}

    def learn(self, words: list[str]) -> None:
        """Adds the ids of ``words``, none of which holds a line feed, to ``known``."""
        text = "\n".join(words)
        if not text.isascii() and not unicodedata.is_normalized("NFC", text) or self.odd(text):
            plain = []
            for word in words:
                if self.odd(word) or not unicodedata.is_normalized("NFC", word):
                    ids = self.tokenizer.encode(word, add_special_tokens=False).ids
                    self.known[word] = np.array(ids, dtype="<u4").tobytes()
                else:
                    plain.append(word)
            words, text = plain, "\n".join(plain)
        if not words:
            return
        # Stretches that are merged on their own, and the line feeds between words.
        pieces = self.find(text.lower())
        ranks = np.array(self.merge.encode_ordinary("\0".join(pieces) + "\0\n\0"), dtype=np.int64)
        gaps = np.flatnonzero(ranks == self.gap)
        starts = np.concatenate(([0], gaps[:-1] + 1)) * 4
        flat = self.ids[ranks].tobytes()
        self.known.update(zip(words, [flat[i:j] for i, j in zip(starts.tolist(), (gaps * 4).tolist(), strict=True)], strict=True))

    def many(self, texts: list[str]) -> list[bytes]:
        """The ids of each of ``texts``."""
        known, found, missing = self.known, [], set()
        if len(known) > CACHE_WORDS:
            known.clear()
        for text in texts:
            # str.split parts at these too, which the tokenizer takes for characters.
            if any(map(text.__contains__, "\x1c\x1d\x1e\x1f")):
                found.append((None, np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()))
                continue
            parts = text.split()
            ids = list(map(known.get, parts))
            if None in ids:
                holes = [i for i, x in enumerate(ids) if x is None]
                missing.update([parts[i] for i in holes])
                found.append(([(i, parts[i]) for i in holes], ids))
            else:
                found.append((None, b"".join(ids)))
        if missing:
            self.learn(list(missing))
        out = []
        for holes, ids in found:
            if holes is not None:
                for i, word in holes:
                    ids[i] = known[word]
                ids = b"".join(ids)
            out.append(ids)
        return out

    def __call__(self, text: str) -> bytes:
        return self.many([text])[0]


def cut(doc_id, ids: bytes, capacity: int):
    """(doc_id, piece, start, length, crc) of each stretch of ``capacity`` ids."""
    step = 4 * capacity
    for piece, at in enumerate(range(0, len(ids), step)):
        part = ids[at : at + step]
        yield doc_id, piece, at // 4, len(part) // 4, zlib.crc32(part)


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row per piece of each row of ``docs`` (doc_id, text); a null text counts as empty."""
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches):
        ids_of = WordIds(tokenizer_path)
        for batch in batches:
            for at in range(0, batch.num_rows, DOCS_AT_ONCE):
                part = batch.slice(at, DOCS_AT_ONCE)
                texts = [t or "" for t in part.column(1).to_pylist()]
                rows = []
                for doc_id, ids in zip(part.column(0).to_pylist(), ids_of.many(texts), strict=True):
                    rows += cut(doc_id, ids + end, capacity)
                yield to_batch(rows, fields)

    fields = spark_schema(docs.sparkSession, PIECES)
    return docs.select("doc_id", "text").mapInArrow(run, PIECES)


def best_fit_decreasing(lengths: list[int], capacity: int) -> tuple[list[int], list[int], list[int]]:
    """Bin and offset of each length (given in falling order), and the room left in each bin.

    Bins wait in stacks by the room they have left; the bits of ``rooms`` mark the
    stacks that aren't empty, so the tightest fit is the lowest bit from ``size`` up.
    """
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0
    bins, offsets, left = [], [], []
    for size in lengths:
        fits = rooms >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            stack = by_room[room]
            b = stack.pop()
            if not stack:
                rooms ^= 1 << room
        else:
            b, room = len(left), capacity
            left.append(0)
        bins.append(b)
        offsets.append(capacity - room)
        room -= size
        left[b] = room
        if room:
            if not by_room[room]:
                rooms |= 1 << room
            by_room[room].append(b)
    return bins, offsets, left


def dual_feasible_bound(lengths: np.ndarray, counts: np.ndarray, capacity: int, classes: int = 12) -> float:
    """The largest sum of three families of dual feasible functions; no packing has fewer bins.

    Families: dropping lengths under a threshold and rounding up those that only
    they could join; rounding to multiples of 1/k; and counting what a bin can
    hold beside a length above its threshold. Sums are exact integers until the
    last division.
    """
    if not len(lengths):
        return 0.0
    n = np.zeros(capacity + 2, dtype=np.int64)
    np.add.at(n, lengths, counts)
    size = np.arange(capacity + 2, dtype=np.int64)
    count_to, sum_to = np.cumsum(n), np.cumsum(n * size)
    eps = np.arange(0, capacity // 2 + 1)
    whole = count_to[capacity] - count_to[capacity - eps]
    middle = sum_to[capacity - eps] - np.where(eps > 0, sum_to[eps - 1], 0)
    best = float((capacity * whole + middle).max()) / capacity
    x, c = lengths.astype(np.int64), counts.astype(np.int64)
    for k in range(1, classes + 1):
        scaled = (k + 1) * x
        value = np.where(scaled % capacity == 0, k * x, (scaled // capacity) * capacity)
        best = max(best, float((value * c).sum()) / (capacity * k))
    for e in x[(x > 1) & (x <= capacity // 2)].tolist():
        per = capacity // e
        value = np.where(x > capacity - e, per - (capacity - x) // e, (x >= e).astype(np.int64))
        best = max(best, float((value * c).sum()) / per)
    return best


def _pack_group(capacity: int, round_no: int, schema: pa.Schema):
    def pack(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        part = key[0].as_py()
        old = rows.column("bin") if round_no else None
        order = [("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending")]
        rows = rows.sort_by([*order, *([("bin", "ascending")] if round_no else [])])
        lengths = rows.column("length").to_numpy()
        sizes, counts = np.unique(lengths, return_counts=True)
        bound = dual_feasible_bound(sizes, counts, capacity)
        bins, offsets, left = best_fit_decreasing(lengths.tolist(), capacity)
        if round_no and len(left) >= len(np.unique(old.to_numpy())):
            names, index = np.unique(rows.column("bin").to_numpy(), return_inverse=True)
            used = np.zeros(len(names), dtype=np.int64)
            np.add.at(used, index, lengths)
            ids, offsets, rest = names[index], rows.column("offset").to_numpy(), (capacity - used)[index]
        else:
            names = np.arange(len(left), dtype=np.int64)
            ids = (np.int64(round_no) << 58) | (np.int64(part) << 32) | np.array(bins, dtype=np.int64)
            rest = np.array(left, dtype=np.int64)[np.array(bins, dtype=np.int64)]
        gap = len(names) - bound > 1e-9
        n = rows.num_rows
        head = np.zeros(n, dtype=np.int32)
        if n:
            head[0] = len(names)
        columns = [rows.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
        more = [pa.array(ids), pa.array(np.asarray(offsets, dtype=np.int64)), pa.array((rest > 0) & gap), pa.array(rest.astype(np.int32)), pa.array(head), pa.array(np.full(n, bound))]
        return pa.Table.from_arrays([*columns, *more], schema=schema)

    return pack


def pack(
    pieces: DataFrame,
    scratch: Scratch,
    capacity: int = CAPACITY,
    items_per_partition: int = 20_000,
    least_saving: float = 1e-4,
) -> DataFrame:
    """Adds sequence_id, offset, sequences and least_sequences to ``pieces`` (columns of PIECES, lengths 1 to capacity).

    Rows may repeat; each is packed on its own. An empty input gives an empty
    result. ``pieces`` is read more than once, so pass a written table. A round that saves
    no more than ``least_saving`` of the bins that it opened counts as one that saves nothing.
    """
    spark = pieces.sparkSession
    schema = spark_schema(spark, PACKED)
    histogram = pieces.groupBy("length").agg(F.count("*").alias("n")).collect()  # at most ``capacity`` rows
    sizes = np.array([r["length"] for r in histogram], dtype=np.int64)
    counts = np.array([r["n"] for r in histogram], dtype=np.int64)
    order = np.argsort(sizes)
    bound = math.ceil(dual_feasible_bound(sizes[order], counts[order], capacity) - 1e-9)
    rows, settled, total, deal, emptiest = int(counts.sum()), [], 0, pieces, False
    for round_no in count():
        parts = 1 if emptiest else max(1, math.ceil(rows / items_per_partition))
        key = [F.col("bin") if round_no else F.monotonically_increasing_id()]
        dealt = deal.withColumn("part", F.pmod(F.xxhash64(*key, F.lit(round_no)), F.lit(parts)).cast("int"))
        packed = scratch.write(dealt.groupBy("part").applyInArrow(_pack_group(capacity, round_no, schema), PACKED))
        told = packed.agg(F.sum("bins").alias("bins"), F.count(F.when(F.col("open"), 1)).alias("open")).first()
        bins = int(told["bins"] or 0)
        saved = open_bins - bins if round_no else 0
        total = total - saved if round_no else bins
        rows = int(told["open"])
        if not rows or total <= bound or parts == 1:
            settled.append(packed)
            break
        released = F.col("open")
        if round_no and saved <= least_saving * open_bins:
            # What is left saves nothing in parts: the emptiest bins, as many as fit one partition, meet once.
            emptiest, upto, least = True, 0, capacity + 1
            for r in packed.where("open").groupBy("room").agg(F.count("*").alias("n")).orderBy(F.desc("room")).collect():  # capacity rows at most
                upto += r["n"]
                if upto > items_per_partition:
                    break
                least = r["room"]
            released = F.col("open") & (F.col("room") >= least)
        settled.append(packed.where(~released))
        deal = packed.where(released)
        open_bins = deal.select("bin").distinct().count()
    out = settled[0]
    for more in settled[1:]:
        out = out.unionByName(more)
    certificate = [F.lit(n).cast("long").alias(c) for n, c in ((total, "sequences"), (bound, "least_sequences"))]
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", F.col("bin").alias("sequence_id"), "offset", *certificate)


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, items_per_partition: int = 20_000) -> DataFrame:
    """Tokenizes, cuts and packs the rows of ``docs``.

    A null or empty text is the end id alone, a text of any length is cut and packed whole.
    Rows with a null doc_id, repeated ids or repeated rows are packed like any others;
    further columns are ignored.
    """
    scratch = Scratch(docs.sparkSession, "packing")
    pieces = scratch.write(token_pieces(docs, tokenizer_path, capacity))
    return pack(pieces, scratch, capacity, items_per_partition)
