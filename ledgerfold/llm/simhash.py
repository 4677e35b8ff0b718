"""SimHash near-duplicates by pigeonhole blocks.

A text's fingerprint has 64 bits, each the majority of the XXH64 hashes of its
word shingles. Fingerprints link if they differ in at most ``max_bits`` bits.
They are split into ``max_bits + 2`` blocks: two that link agree on at least two
whole blocks, so they meet in the bucket of some pair of blocks, and the join on
buckets loses nothing. Candidates are verified by their Hamming distance.

Equal fingerprints are one node from the start, however many documents share
them. A bucket of many different fingerprints isn't joined with itself: each of
its members is listed under every fingerprint one bit away (outside of the
bucket's blocks), where any two members within two bits meet. Such a list has a
few dozen entries at most, so a hot bucket costs in proportion to its size.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerfold.llm._common import Scratch, join_each, lower_words_of, map_rows
from ledgerfold.llm.components import star_components

SEED = 42
#: Buckets of up to so many fingerprints are joined with themselves.
SMALL_BUCKET = 32


def fingerprint(text: str | None, width: int = 3) -> int:
    """64-bit SimHash of the word shingles of ``text``, repeats included; 0 without words."""
    words = lower_words_of(text)
    if not words:
        return 0
    if len(words) <= width:
        hashes = [xxhash.xxh64_intdigest(b" ".join(words), SEED)]
    else:
        joined = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[s:e], SEED) for s, e in zip(starts.tolist(), ends[width - 1 :].tolist(), strict=False)]
    total = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 16):
        block = np.array(hashes[at : at + (1 << 16)], dtype="<u8")
        total += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return sum(1 << i for i in np.flatnonzero(2 * total > len(hashes)).tolist())


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """doc_id, text_key (a hash of the whole text) and fp (the fingerprint as a signed long) of every row."""

    def start():
        def row(doc_id, text, key):
            fp = fingerprint(text, width)
            yield doc_id, key, fp - (1 << 64) if fp >> 63 else fp

        return row

    return map_rows(docs.select("doc_id", "text", F.xxhash64("text").alias("text_key")), "doc_id long, text_key long, fp long", start)


def links(fps: DataFrame, scratch: Scratch, max_bits: int = 2, small_bucket: int = SMALL_BUCKET) -> DataFrame:
    """Edges (a, b) between distinct fingerprints (column fp) that span the same components as all links do.

    Edges from small buckets are all links there; in a large bucket each list of
    fingerprints one bit from a common point is a clique for two bits, of which
    the edges to its least member are kept.
    """
    if max_bits > 2:
        raise ValueError("lists one bit away cover links of up to two bits")
    n_blocks = max_bits + 2
    edges = [round(64 * i / n_blocks) for i in range(n_blocks + 1)]
    masks = []
    for pair in combinations(range(n_blocks), 2):
        mask = sum(((1 << (edges[i + 1] - edges[i])) - 1) << edges[i] for i in pair)
        masks.append(mask)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    keys = scratch.write(
        fps.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(signed(m))) for m in masks])).alias("pair", "key"))
    )
    buckets = keys.groupBy("pair", "key").agg(F.count("*").alias("n")).where("n > 1")
    shared = scratch.write(keys.join(buckets, ["pair", "key"]))
    small = shared.where(F.col("n") <= small_bucket).select("pair", "key", "fp")
    distance = F.bit_count(F.col("a").bitwiseXOR(F.col("b")))
    near = (
        small.withColumnRenamed("fp", "a")
        .join(small.withColumnRenamed("fp", "b"), ["pair", "key"])
        .where((F.col("a") > F.col("b")) & (distance <= max_bits))
        .select("a", "b")
    )
    flips = F.array(*[
        F.array(F.lit(0).cast("long"), *[F.lit(signed(1 << i)) for i in range(64) if not m >> i & 1]) for m in masks
    ])
    listed = (
        shared.where(F.col("n") > small_bucket)
        .select("pair", "fp", F.explode(F.element_at(flips, F.col("pair") + 1)).alias("flip"))
        .select("pair", "fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("point"))
        .groupBy("pair", "point")
        .agg(F.collect_list("fp").alias("members"))  # 65 at most: those within one bit of the point
        .where(F.size("members") > 1)
        .select(F.explode("members").alias("a"), F.array_min("members").alias("b"))
        .where("a <> b")
    )
    return near.unionByName(listed).distinct()


def _components(docs: DataFrame, width: int, max_bits: int) -> tuple[DataFrame, DataFrame]:
    """Rows with their fingerprints, and the root of each distinct fingerprint's component."""
    scratch = Scratch(docs.sparkSession, "simhash")
    each = scratch.write(fingerprints(docs, width))
    classes = scratch.write(each.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")))
    stars = scratch.write(star_components(links(classes.select("fp"), scratch, max_bits), scratch))
    rooted = classes.join(stars.withColumnRenamed("node", "fp"), "fp", "left")
    return each, rooted.select("fp", "least", "n", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, width: int = 3, max_bits: int = 2) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id for every row of ``docs``.

    Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased; a text of fewer than
    ``width`` words is one shingle, and one without words (null and empty texts
    too) has fingerprint zero and links like any other. component_id is the
    smallest doc_id that links reach; null ids take part, and the component of
    rows that all lack an id has none. Repeated rows are repeated in the result,
    and further columns are ignored.
    """
    each, rooted = _components(docs, width, max_bits)
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("fps"))
    told = rooted.agg(F.count("*"), F.sum("n")).first()
    # A fingerprint can have a third of all rows, and a component a third of all fingerprints.
    named = join_each(rooted, least, "root", "fps", told[0]).select("fp", "n", "component_id")
    return join_each(each, named, "fp", "n", told[1] or 0).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, width: int = 3, max_bits: int = 2) -> DataFrame:
    """One row of ``docs`` for each component: that of the smallest doc_id, null ids last.

    All columns come back. Of rows that repeat that id and its text one stays.
    """
    each, rooted = _components(docs, width, max_bits)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key"))
    by_fp = each.groupBy("fp").agg(first.alias("first"))
    chosen = by_fp.join(rooted, "fp").groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.doc_id").alias("_simhash_id"), F.col("first.text_key").alias("_simhash_key"))
    # Columns of docs may have any names.
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id"), F.xxhash64("text").alias("text_key"))
    kept = keyed.join(chosen, keyed["doc_id"].eqNullSafe(chosen["_simhash_id"]) & (keyed["text_key"] == chosen["_simhash_key"]), "left_semi")
    if each.groupBy("doc_id", "text_key").count().where("count > 1").limit(1).count():
        kept = kept.dropDuplicates(["doc_id", "text_key"])
    return kept.select(*[F.col("row")[c].alias(c) for c in docs.columns])
