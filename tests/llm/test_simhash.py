import random

import pytest
import xxhash
from pyspark.sql import functions as F

from ledgerfold.llm import simhash
from ledgerfold.llm._common import Scratch, lower_words_of
from ledgerfold.llm.components import star_components


def brute_fingerprint(text):
    words = lower_words_of(text)
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(items):
    """items: (key, fingerprint, id); the smallest id that links of two bits reach."""
    parent = {k: k for k, _, _ in items}

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for i, (a, x, _) in enumerate(items):
        for b, y, _ in items[:i]:
            if (x ^ y).bit_count() <= 2:
                parent[root(a)] = root(b)
    least = {}
    for k, _, i in items:
        r = root(k)
        least[r] = i if least.get(r) is None else least[r] if i is None else min(least[r], i)
    return {k: least[root(k)] for k, _, _ in items}


def test_whole_table(spark, docs, none):
    rows = docs.collect()
    items = [(n, brute_fingerprint(r.text), r.doc_id) for n, r in enumerate(rows)]
    least = brute_components(items)
    wanted = [(i, f"{fp:016x}", least[n]) for n, fp, i in items]
    got = simhash.near_duplicates(docs).collect()
    assert sorted(map(tuple, got), key=str) == sorted(wanted, key=str)
    assert simhash.near_duplicates(none).collect() == []


def test_one_of_each(docs, none):
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    got = [(r.doc_id, r.text) for r in kept.collect()]
    assert len(got) == len(set(got))
    rows = docs.collect()
    items = [(n, brute_fingerprint(r.text), r.doc_id) for n, r in enumerate(rows)]
    least = brute_components(items)
    components = {least[n] for n, _, _ in items}
    assert sorted(i for i, _ in got if i is not None) == sorted(c for c in components if c is not None)
    assert simhash.one_of_each(none).count() == 0


@pytest.mark.parametrize("small_bucket", [1, 4, 1000])
def test_no_link_is_lost_in_hot_buckets(spark, small_bucket):
    """Fingerprints in crowds around a few points, through pairs and through lists."""
    rng = random.Random(small_bucket)
    points = [rng.getrandbits(64) for _ in range(6)]
    fps = {p for p in points}
    for p in points:
        for _ in range(40):
            x = p
            for _ in range(rng.randint(1, 6)):
                x ^= 1 << rng.randrange(64)
            fps.add(x)
    fps = sorted(fps)
    signed = [(f - (1 << 64) if f >> 63 else f,) for f in fps]
    scratch = Scratch(spark, "test")
    edges = simhash.links(spark.createDataFrame(signed, "fp long"), scratch, small_bucket=small_bucket)
    roots = {r.node & (1 << 64) - 1: r.root for r in star_components(edges, scratch).collect()}
    wanted = brute_components([(f, f, f) for f in fps])
    groups = {}
    for f in fps:
        groups.setdefault(wanted[f], set()).add(roots.get(f, f - (1 << 64) if f >> 63 else f))
    assert all(len(g) == 1 for g in groups.values())
    assert len({next(iter(g)) for g in groups.values()}) == len(groups)
    for r in edges.collect():
        assert ((r.a ^ r.b) & (1 << 64) - 1).bit_count() <= 2


def test_hot_fingerprints_and_hubs(spark):
    """Ten thousand empty rows each, and a star of two thousand: hot keys are met by broadcast, and nothing is lost."""
    rows = spark.range(10_000).selectExpr("id AS doc_id", "CASE WHEN id % 2 = 0 THEN '' END AS text")
    some = spark.createDataFrame([(20_000 + i, f"{i} word {i} other {i} text {i}") for i in range(50)], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(rows.unionByName(some)).collect()}
    assert len(got) == 10_050 and {got[i] for i in range(10_000)} == {0}
    assert simhash.one_of_each(rows.unionByName(some)).count() == len(set(got.values()))
    star = spark.createDataFrame([(5, i) for i in range(10, 2010)] + [(i, i + 1) for i in range(3000, 3010)], "a long, b long")
    roots = dict(map(tuple, star_components(star, Scratch(spark, "test")).collect()))
    assert {roots[i] for i in range(10, 2010)} == {5} and {roots[i] for i in range(3000, 3011)} == {3000}


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 140)] + [(7, 7), (200, 201), (201, 200)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = dict(map(tuple, star_components(df, Scratch(spark, "test")).collect()))
    assert {got[i] for i in range(61)} == {0}
    assert {got[i] for i in range(100, 140)} == {100}
    assert got[201] == got[200] == 200
    assert star_components(df.where("false"), Scratch(spark, "test")).collect() == []


def test_hash_is_sparks_own(spark):
    text = "Été on the"
    own = spark.range(1).select(F.xxhash64(F.lit("a b c"))).first()[0]
    assert xxhash.xxh64_intdigest(b"a b c", 42) == own & (1 << 64) - 1
    assert simhash.fingerprint(text) == xxhash.xxh64_intdigest("Été on the".encode(), 42)
