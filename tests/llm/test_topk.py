import random

import numpy as np
import pytest

from ledgerfold.llm import topk
from ledgerfold.llm._common import table


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, code int, n int, rank int")


def brute(rows, queries, k):
    bits = lambda e: [1 if x is not None and x > 0 else 0 for x in (list(e) + [0] * 64)[:64]]
    out = []
    for q in queries:
        if q[1] is None:
            continue
        own = sorted((sum(a != b for a, b in zip(bits(q[1]), bits(r[1]), strict=True)), r[0] is None, r[0] or 0) for r in rows if r[1] is not None)
        out += [(q[0], i + 1, None if none else v, d) for i, (d, none, v) in enumerate(own[:k])]
    return sorted(out)


def shown(df):
    return sorted((r.query_id, r.rank, r.vec_id, r.distance) for r in df.collect())


def near_rows(n, seed):
    """Clusters, whose queries small radii prove, and random rows, which take larger ones."""
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((12, 64))
    out = []
    for i in range(n):
        e = centres[i % 12] + 0.1 * rng.standard_normal(64) if i % 5 else rng.standard_normal(64)
        out.append((i, [float(x) for x in e], 0, 0, 0))
    return out


@pytest.mark.parametrize("group_codes, max_prefix", [(20_000, 14), (40, 14), (40, 2)], ids=["one group", "many groups", "salted groups"])
def test_matches_brute_force(spark, monkeypatch, group_codes, max_prefix):
    monkeypatch.setattr(topk, "GROUP_CODES", group_codes)
    monkeypatch.setattr(topk, "MAX_PREFIX", max_prefix)
    rows = near_rows(1500, 3)
    rows += [(9000 + i, rows[7][1], 0, 0, 0) for i in range(40)]  # one code with many rows
    rows += [(5000, None, 0, 0, 0), (None, rows[3][1], 0, 0, 0), (5001, [], 0, 0, 0), (5002, [1.0, None, float("nan")], 0, 0, 0), rows[10]]
    queries = [r for r in rows if r[0] is not None and r[0] % 100 == 0]
    df = frame(spark, rows)
    got = topk.nearest_codes(df, df.where("vec_id % 100 = 0"), k=7)
    fixed = [(i, None if e is None else [0 if x is None else (1 if x != x else x) for x in e], *_) for i, e, *_ in rows]
    assert shown(got) == brute(fixed, [f for f in fixed if f[0] is not None and f[0] % 100 == 0], 7)
    assert len(queries) > 10


def test_few_rows_and_none(spark):
    df = frame(spark, [(0, [1.0] * 64, 0, 0, 0), (1, [-1.0] * 64, 0, 0, 0)])
    assert shown(topk.nearest_codes(df, df.where("vec_id = 0"), k=5)) == [(0, 1, 0, 0), (0, 2, 1, 64)]
    assert shown(topk.nearest_codes(df, df.where("vec_id = 0"), k=1)) == [(0, 1, 0, 0)]
    assert topk.nearest_codes(df.where("false"), df.where("false")).collect() == []
    assert topk.nearest_codes(df, df.where("false")).collect() == []


def test_hot_segment_values(spark, monkeypatch):
    """A third of the codes share three segments out of four."""
    monkeypatch.setattr(topk, "GROUP_CODES", 50)
    rng = random.Random(4)
    rows = [(i, [rng.choice((-1.0, 1.0)) if i % 3 or b < 16 else 1.0 for b in range(64)], 0, 0, 0) for i in range(900)]
    df = frame(spark, rows)
    got = topk.nearest_codes(df, df.where("vec_id % 30 = 0"), k=4)
    assert shown(got) == brute(rows, [r for r in rows if r[0] % 30 == 0], 4)


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_look_ups_prove_every_query(spark, sf):
    """Every answer comes from look-ups whose radii cover it, and none needs a radius that looks up everything."""
    rows = table(spark, f"/root/testdata/{sf}", "embeddings")
    codes = rows.select(topk.sign_code(rows["embedding"])).distinct().count()
    segments = topk.segments_of(codes)
    out = topk.search_codes(rows, rows.where("vec_id % 100 = 0")).collect()
    assert len({r.query_id for r in out}) == rows.where("vec_id % 100 = 0").count()
    assert all(r.distance <= len(segments) * (r.radius + 1) - 1 for r in out)
    assert max(r.radius for r in out) <= min(w for _, w in segments) // 2


@pytest.mark.parametrize("prefix", [0, 3])
def test_look_up_finds_what_lies_at_the_radii(prefix):
    """Both ways, of listing near values and of comparing those that are there."""
    rng = np.random.default_rng(1)
    first, width = 20, 10
    codes = rng.integers(0, 1 << 63, 400, dtype=np.uint64)
    group = np.uint64((1 << prefix) - 1) << np.uint64(first + width - prefix)
    codes = np.unique(codes | group)
    queries = rng.integers(0, 1 << 63, 50, dtype=np.uint64)
    least = np.arange(len(codes))
    for radii in (range(2), range(2, 3), range(5, 7)):
        q, c, d = topk.look_up(codes, least, queries, np.full(50, 64), first, width, prefix, radii, 3)
        for i in range(50):
            off = [int(x).bit_count() for x in (codes ^ queries[i]) >> np.uint64(first) & np.uint64((1 << width) - 1)]
            own = sorted((int(codes[j] ^ queries[i]).bit_count(), j) for j in range(len(codes)) if off[j] in radii)[:3]
            assert sorted(zip(d[q == i].tolist(), c[q == i].tolist(), strict=True)) == own
