"""Exact nearest binary codes by incremental multi-index hashing.

An embedding's code has the signs of its first 64 components. Codes are split
into segments of about log2(codes) bits, and each distinct code is listed once per
segment under its value there. A query looks up all values within radius 0, 1, 2 of
its own in every segment, then those at 3, and so on: after radius r in all of m
segments, every code within ``m * (r + 1) - 1`` bits has been met. The k-th verified
distance so far bounds what is still needed, so the last radius is looked up in as
many segments as that takes and no more; a query leaves once its k-th distance is
no more than what its look-ups have covered.

The index is dealt by segment and the first bits of the value, so that a group has a
bounded number of codes; groups that hold more are salted by code. Queries go to the
groups whose first bits are near enough, look up values there and send back
their k best codes, so that no join ever makes a row for each pair. Equal codes are one
entry with a count and the least id. Look-ups never turn into a scan of all rows: where
a radius has more values than a group holds, the group's values are compared instead.
"""

from __future__ import annotations

import math
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerfold.llm._common import Scratch

BITS = 64
#: Codes that a group of the index is meant to hold; one of more than twice as many is salted.
GROUP_CODES = 20_000
#: First bits by which a segment's values are dealt, at most; groups grow with the table beyond.
MAX_PREFIX = 14
#: Radii of the first round; each later one adds one radius.
FIRST_RADIUS = 2
#: Pairs of a query and a code that are compared at once.
PAIRS_AT_ONCE = 1 << 20
_HIT = "qcode long, code long, n long, least long, distance int"


def sign_code(embedding: Column, bits: int = BITS) -> Column:
    """Bit i is set if component i is above zero; missing and null components count as zero."""
    at = F.sequence(F.lit(0), F.lit(bits - 1))
    return F.aggregate(
        at,
        F.lit(0).cast("long"),
        lambda code, i: code.bitwiseOR(F.when(F.get(embedding, i) > 0, F.expr("1L")).otherwise(F.expr("0L")) * _power(i)),
    )


def _power(i: Column) -> Column:
    """1 shifted left by a column."""
    return F.call_function("shiftleft", F.expr("1L"), i)


def segments_of(distinct: int, bits: int = BITS) -> list[tuple[int, int]]:
    """(first bit, width) of segments of about log2(distinct) bits, 8 at least."""
    width = min(bits, max(8, round(math.log2(max(2, distinct)))))
    n = max(1, round(bits / width))
    edges = [round(bits * i / n) for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


@lru_cache(maxsize=64)
def _flips(width: int, radius: int) -> np.ndarray:
    """All numbers of ``width`` bits of which ``radius`` are set."""
    return np.array([sum(1 << b for b in c) for c in combinations(range(width), radius)], dtype=np.int64)


def needed(kth: int | None, radius: int, segments: int) -> int:
    """Segments in which ``radius`` has to be looked up, all lesser radii being done, to cover ``kth`` bits."""
    return segments if kth is None else min(segments, max(0, kth - segments * radius + 1))


def _sent(left: DataFrame, segments: list[tuple[int, int]], prefix: int, radii: range) -> DataFrame:
    """(qcode, kth, segment, prefix): the groups in which each query has values to look up."""

    def run(batches):
        near = np.concatenate([_flips(prefix, d) for d in range(min(prefix, radii[-1]) + 1)])
        for batch in batches:
            codes, bounds = batch.column(0).to_numpy(), batch.column(1).to_pylist()
            for segment, (first, width) in enumerate(segments):
                mine = [i for i, kth in enumerate(bounds) if segment < needed(kth, radii[-1], len(segments))]
                for at in range(0, len(mine), 64):
                    part = mine[at : at + 64]
                    own = (codes[part].view(np.uint64) >> np.uint64(first)).astype(np.int64) & ((1 << width) - 1)
                    groups = ((own >> (width - prefix))[:, None] ^ near[None, :]).ravel()
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.repeat(codes[part], len(near))),
                            pa.array([bounds[i] for i in part for _ in range(len(near))], pa.int32()),
                            pa.array(np.full(len(groups), segment, np.int32)),
                            pa.array(groups.astype(np.int32)),
                        ],
                        names=["qcode", "kth", "segment", "prefix"],
                    )

    return left.select("qcode", "kth").mapInArrow(run, "qcode long, kth int, segment int, prefix int")


def _best(q: np.ndarray, distance: np.ndarray, least: np.ndarray, k: int) -> np.ndarray:
    """Indices of each query's ``k`` best entries by (distance, least id), the queries being numbers."""
    order = np.lexsort((least, distance, q))
    ranked = q[order]
    begins = np.flatnonzero(np.diff(ranked, prepend=-1))
    place = np.arange(len(order)) - np.repeat(begins, np.diff(np.append(begins, len(order))))
    return order[place < k]


def look_up(codes: np.ndarray, least: np.ndarray, queries: np.ndarray, kth: np.ndarray, first: int, width: int, prefix: int, radii, k: int):
    """(query, code, distance) as places: each query's ``k`` best codes of one group, among those whose segment is at one of ``radii``.

    ``codes`` share the first ``prefix`` bits of their segment; ``kth`` bounds the distance.
    """
    low = width - prefix
    of = lambda x: (x.view(np.uint64) >> np.uint64(first)).astype(np.int64) & ((1 << width) - 1)
    values = of(codes)
    order = np.argsort(values, kind="stable")
    held, begins, sizes = np.unique(values[order], return_index=True, return_counts=True)
    own = of(queries)
    away = np.bitwise_count(np.uint64(held[0] >> low) ^ (own >> low).astype(np.uint64)).astype(np.int64)
    at_query, at_code = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for radius in radii:
        for d in np.unique(away).tolist():
            if not 0 <= radius - d <= low:
                continue
            asked = np.flatnonzero(away == d)
            if math.comb(low, radius - d) <= len(held):
                flips = _flips(low, radius - d)
                for block in np.array_split(asked, math.ceil(len(asked) * len(flips) / PAIRS_AT_ONCE)):
                    wanted = ((held[0] >> low << low) | (own[block] & ((1 << low) - 1)))[:, None] ^ flips[None, :]
                    place = np.minimum(np.searchsorted(held, wanted), len(held) - 1)
                    hit, which = np.nonzero(held[place] == wanted)
                    at_query.append(block[hit])
                    at_code.append(place[hit, which])
            else:
                for block in np.array_split(asked, math.ceil(len(asked) * len(held) / PAIRS_AT_ONCE)):
                    hit, which = np.nonzero(np.bitwise_count(own[block][:, None].astype(np.uint64) ^ held[None, :].astype(np.uint64)) == radius)
                    at_query.append(block[hit])
                    at_code.append(which)
    q, v = np.concatenate(at_query), np.concatenate(at_code)
    kept = [np.zeros(0, np.int64)] * 3
    # Values become codes, so many at once.
    cuts = np.searchsorted(np.cumsum(sizes[v]), np.arange(PAIRS_AT_ONCE, int(sizes[v].sum()) + PAIRS_AT_ONCE, PAIRS_AT_ONCE))
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(v)], strict=True):
        if a == b:
            continue
        n = sizes[v[a:b]]
        ends = np.cumsum(n)
        c = order[np.repeat(begins[v[a:b]] - (ends - n), n) + np.arange(ends[-1])]
        p = np.repeat(q[a:b], n)
        distance = np.bitwise_count(codes[c] ^ queries[p]).astype(np.int64)
        near = distance <= kth[p]
        kept = [np.concatenate((x, y[near])) for x, y in zip(kept, (p, c, distance), strict=True)]
        best = _best(kept[0], kept[2], least[kept[1]], k)
        kept = [x[best] for x in kept]
    return kept


def _hits(sent: DataFrame, index: DataFrame, segments: list[tuple[int, int]], prefix: int, radii: range, k: int) -> DataFrame:
    """Each query's best codes of every group that it is sent to."""

    def run(key, asked: pa.Table, held: pa.Table) -> pa.Table:
        schema = pa.schema([("qcode", pa.int64()), ("code", pa.int64()), ("n", pa.int64()), ("least", pa.int64()), ("distance", pa.int32())])
        if not asked.num_rows or not held.num_rows:
            return schema.empty_table()
        # bitwise_count of a negative number counts its magnitude, so codes go unsigned.
        codes, queries = held.column("code").to_numpy().view(np.uint64), asked.column("qcode").to_numpy().view(np.uint64)
        kth = asked.column("kth").fill_null(BITS).to_numpy()
        least = held.column("least").fill_null((1 << 63) - 1).to_numpy()
        q, c, distance = look_up(codes, least, queries, kth, *segments[key[0].as_py()], prefix, radii, k)
        found = held.take(pa.array(c))
        return pa.Table.from_arrays(
            [pa.array(queries[q].view(np.int64)), found.column("code"), found.column("n"), found.column("least"), pa.array(distance.astype(np.int32))], schema=schema
        )

    group = ["segment", "prefix", "salt"]
    return sent.groupBy(*group).cogroup(index.groupBy(*group)).applyInArrow(run, _HIT)


def search_codes(embeddings: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """What nearest_codes() returns, and ``radius``: the one after which the answer was proven."""
    scratch = Scratch(embeddings.sparkSession, "topk")
    coded = lambda df: df.where("embedding is not null").select("vec_id", sign_code(F.col("embedding")).alias("code"))
    rows = scratch.write(coded(embeddings))
    asked = scratch.write(coded(queries).select(F.col("vec_id").alias("query_id"), F.col("code").alias("qcode")))
    codes = scratch.write(rows.groupBy("code").agg(F.count("*").alias("n"), F.min("vec_id").alias("least")))
    distinct = codes.count()
    segments = segments_of(distinct)
    widest = max(w for _, w in segments)
    prefix = min(MAX_PREFIX, max(0, math.ceil(math.log2(max(1, distinct) / GROUP_CODES))))

    places = [F.shiftrightunsigned("code", first + width - prefix).bitwiseAND(F.lit((1 << prefix) - 1)).cast("int") for first, width in segments]
    listed = codes.select("code", "n", "least", F.posexplode(F.array(*places)).alias("segment", "prefix"))
    full = None
    if prefix:
        # Groups of more codes than were meant for them; there are at most 2 ** MAX_PREFIX groups a segment.
        most = 2 * max(GROUP_CODES, distinct >> prefix)
        sizes = listed.groupBy("segment", "prefix").agg(F.count("*").alias("size")).where(F.col("size") > most)
        found = sizes.select("segment", "prefix", F.ceil(F.col("size") / most).cast("int").alias("parts")).toArrow()
        full = F.broadcast(embeddings.sparkSession.createDataFrame(found)) if found.num_rows else None

    def salted(df: DataFrame, salt: Column) -> DataFrame:
        if full is None:
            return df.withColumn("salt", F.lit(0))
        return df.join(full, ["segment", "prefix"], "left").withColumn("salt", salt).drop("parts")

    parts = F.coalesce("parts", F.lit(1))
    index = salted(listed, F.pmod(F.xxhash64("code"), parts).cast("int"))

    left = asked.select("qcode").distinct().withColumn("kth", F.lit(None).cast("int"))
    proven, met = [], None
    radii = range(min(FIRST_RADIUS, widest) + 1)
    by_near = Window.partitionBy("qcode").orderBy("distance", F.col("least").asc_nulls_last())
    open_queries = asked.limit(1).count() if distinct else 0
    while open_queries:
        sent = salted(_sent(left, segments, prefix, radii), F.explode(F.sequence(F.lit(0), parts - 1)))
        found = _hits(sent, index, segments, prefix, radii, k)
        found = found if met is None else found.unionByName(met)
        # The k best codes of a query hold its k nearest rows.
        ranked = found.dropDuplicates(["qcode", "code"]).withColumn("place", F.row_number().over(by_near)).where(F.col("place") <= k)
        upto = ranked.withColumn("upto", F.sum("n").over(by_near.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
        bound = F.min(F.when(F.col("upto") >= k, F.col("distance"))).over(Window.partitionBy("qcode"))
        now = scratch.write(upto.withColumn("now", bound).drop("place", "upto"))
        told = left.join(now.groupBy("qcode").agg(F.max("now").alias("now")), "qcode", "left")
        m, radius = len(segments), radii[-1]
        covered = m * radius - 1 + F.least(F.lit(m), F.greatest(F.lit(0), F.coalesce(F.col("kth") - m * radius + 1, F.lit(m))))
        done = F.lit(True) if radius >= widest else F.coalesce(F.col("now") <= covered, F.lit(False))
        told = scratch.write(told.select("qcode", F.col("now").alias("kth"), done.alias("done")))
        proven.append(now.join(told.where("done"), "qcode", "left_semi").select("qcode", "code", "distance", F.lit(radius).alias("radius")))
        left = told.where("NOT done").select("qcode", "kth")
        open_queries = left.count()
        met = now.join(left, "qcode", "left_semi").select("qcode", "code", "n", "least", "distance")
        radii = range(radius + 1, radius + 2)

    by_rank = Window.partitionBy("code").orderBy(F.col("vec_id").asc_nulls_last())
    least = rows.withColumn("place", F.row_number().over(by_rank)).where(F.col("place") <= k).drop("place")
    if not proven:
        proven = [rows.where("false").select(F.col("code").alias("qcode"), "code", F.lit(0).alias("distance"), F.lit(0).alias("radius"))]
    found = proven[0]
    for more in proven[1:]:
        found = found.unionByName(more)
    by_query = Window.partitionBy("qcode").orderBy("distance", F.col("vec_id").asc_nulls_last())
    best = found.join(least, "code").withColumn("rank", F.row_number().over(by_query)).where(F.col("rank") <= k)
    return asked.join(best, "qcode").select("query_id", "rank", "vec_id", "distance", "radius")


def nearest_codes(embeddings: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """query_id, rank (from 1), vec_id and distance: the k nearest rows of ``embeddings`` to each row of ``queries``.

    Both have vec_id and embedding. The distance is that of the sign codes in
    bits; ties go by vec_id, null ids last. A row whose embedding is null takes
    no part; of an embedding of any length the first 64 components count. Fewer
    than k rows, or none, give fewer ranks. Repeated rows count each on their own, on
    both sides, and further columns are ignored.
    """
    return search_codes(embeddings, queries, k).drop("radius")
