"""Hard negatives and centroid clustering against brute force."""

import hashlib
import math
import random

import numpy as np
import pytest
from llm_cases import CLASHES
from pyspark.sql import functions as F

from tremorlake.llm import clustering, negatives

SCHEMA = "vec_id long, embedding array<float>, label int"


def vectors(seed=3, n=230, dims=6, wide=1.0):
    """Clustered vectors with exact copies, then null, short, empty, zero and non-finite ones, and NULL keys."""
    rng = random.Random(seed)
    f32 = lambda xs: [float(np.float32(x)) for x in xs]
    centres = [[rng.gauss(0, 1) for _ in range(dims)] for _ in range(5)]
    rows = [(i, f32(wide * (c + rng.gauss(0, 0.6)) for c in centres[rng.randrange(5)]), rng.randrange(3)) for i in range(n)]
    rows += [(1000 + i, rows[i][1], rows[i + 1][2]) for i in range(20)]
    rows += [(2000, None, 1), (2100, [0.5, None, 1.0, 1.0, 1.0, 1.0], 1), (2200, [float("nan")] * dims, 1), (2300, [], 2),
             (2400, [float("inf")] + [0.0] * (dims - 1), 1), (2500, [0.0] * dims, 1), (2501, [0.0] * dims, 0),
             (2600, [0.25] * (dims - 1), 2), (2601, [0.5] * (dims - 1), 2), (2602, [0.375] * (dims - 1), 0),
             (None, [0.5] * dims, 1), (2700, [0.5] * dims, None)]
    return rows


def frame(spark, rows, parts=3):
    df = spark.createDataFrame(rows, SCHEMA)
    return df.withColumns({c: F.lit(f"clash-{c}") for c in (*CLASHES, "v", "dims", "no", "cluster", "distance", "rank")}) \
        .repartition(parts)


def fine(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def brute_negatives(rows, every=10, keep=5, least=80, scale=256):
    part = [(i, [math.floor(scale * float(x)) for x in v], lab) for i, v, lab in rows
            if i is not None and lab is not None and fine(v) and v]
    out = []
    for a, va, la in sorted({(i, tuple(v), lab) for i, v, lab in part if i % every == 0}):
        scored = [(sum(x * y for x, y in zip(va, v)), i, lab) for i, v, lab in part if i != a and len(v) == len(va)]
        order = lambda s: (-s[0], s[1])
        for p, pid, _ in sorted((s for s in scored if s[2] == la), key=order)[:keep]:
            window = sorted((s for s in scored if s[2] != la and least * p <= 100 * s[0] <= 100 * p), key=order)[:keep]
            out += [(a, pid, k + 1, i, p, s) for k, (s, i, _) in enumerate(window)]
    return sorted(out)


@pytest.mark.parametrize("wide,block,refs", [(1.0, 4096, 8), (0.01, 7, 3), (30.0, 9, 1), (1.0, 5, 0)])
def test_hard_negatives_match_brute_force(spark, wide, block, refs):
    rows = vectors(wide=wide)
    got = negatives.hard_negatives(frame(spark, rows), F.col("vec_id") % 10 == 0, F.col("label"), block=block, refs=refs)
    want = brute_negatives(rows)
    assert sorted(tuple(r) for r in got.collect()) == want and len(want) > 50


def test_hard_negatives_with_repeated_rows(spark):
    rows = vectors(n=60)
    rows += rows[:20] * 3
    got = negatives.hard_negatives(frame(spark, rows), F.col("vec_id") % 10 == 0, F.col("label"))
    assert sorted(tuple(r) for r in got.collect()) == brute_negatives(rows)


def test_hard_negatives_of_nothing(spark):
    anchor = F.col("vec_id") % 10 == 0
    assert negatives.hard_negatives(frame(spark, []), anchor, F.col("label")).collect() == []
    alone = [(0, [1.0, 2.0], 1), (1, [1.0, 2.0], 2)]  # no positive: no window
    assert negatives.hard_negatives(frame(spark, alone), anchor, F.col("label")).collect() == []


def test_score_bounds_hold():
    rng = np.random.default_rng(1)
    v = rng.integers(-4000, 4000, (300, 12))
    v[:40] = v[40:80] * 2  # angles of zero
    refs = v[100:104] / np.linalg.norm(v[100:104], axis=1, keepdims=True)
    norm, theta = negatives.angles(v, refs)
    low = np.abs(theta[:, None, :] - theta[None, :, :]).max(axis=2).astype(np.float32)
    both = theta[:, None, :] + theta[None, :, :]
    high = np.minimum(both, 2 * np.pi - both).min(axis=2).astype(np.float32)
    least, most = negatives.score_bounds(low, high, np.outer(norm, norm).astype(np.float32))
    score = v @ v.T
    assert (least <= score).all() and (score <= most).all()


def brute_clusters(rows, k, rounds, dims, scale=1024, seed=3):
    kept = [(i, [math.floor(scale * float(x)) for x in v]) for i, v, _ in rows if fine(v) and len(v) == dims]
    name = lambda i: hashlib.sha256(f"{seed}:{i}".encode()).hexdigest()
    centroids = [v for _, v in sorted(kept, key=lambda r: (r[0] is None, name(r[0]), r[1]))[:k]]
    away = lambda v, c: sum((x - y) ** 2 for x, y in zip(v, c))
    near = lambda v: min(range(len(centroids)), key=lambda c: (away(v, centroids[c]), c))
    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(near(v), []).append(v)
        for c, vs in groups.items():
            centroids[c] = [sum(x) // len(vs) for x in zip(*vs)]
    return sorted(((-1 if i is None else i), near(v), away(v, centroids[near(v)])) for i, v in kept), centroids


@pytest.mark.parametrize("k,rounds", [(8, 10), (3, 1), (1, 2), (5, 0)])
def test_clusters_match_brute_force(spark, k, rounds):
    rows = vectors()
    found = clustering.cluster(frame(spark, rows), k=k, rounds=rounds, dims=6)
    want, centroids = brute_clusters(rows, k, rounds, 6)
    assert sorted((-1 if r.vec_id is None else r.vec_id, r.cluster, r.distance) for r in found.vectors.collect()) == want
    table = {r.cluster: r for r in found.clusters.collect()}
    assert [table[c].centroid for c in range(len(centroids))] == centroids
    for c, r in table.items():
        own = [d for _, x, d in want if x == c]
        assert (r.n, r.inertia) == (len(own), sum(own))


def test_cluster_ties_and_few_rows(spark):
    same = [(i, [1.0, 1.0], 0) for i in range(9)]  # equal centroids: the smallest number takes all
    found = clustering.cluster(frame(spark, same), k=4, dims=2)
    assert {(r.cluster, r.distance) for r in found.vectors.collect()} == {(0, 0)} and found.clusters.count() == 4
    two = clustering.cluster(frame(spark, [(1, [0.0, 0.0], 0), (None, [3.0, -3.0], 0), (5, [1.0], 0)]), k=8, dims=2)
    assert two.clusters.count() == 2 and two.vectors.count() == 2
    none = clustering.cluster(frame(spark, []), dims=2)
    assert none.vectors.collect() == [] and none.clusters.collect() == []


def test_bisectors_agree_with_distances():
    rng = np.random.default_rng(2)
    v, c = rng.integers(-3, 4, (2000, 5)), rng.integers(-3, 4, (7, 5))
    won = clustering.Bisectors(c).winners(v)
    away = ((v[:, None, :] - c[None, :, :]) ** 2).sum(axis=2)
    assert (won == away.argmin(axis=1)).all()  # argmin: the first of equal ones


def test_components_beyond_the_limit_end_the_job(spark):
    with pytest.raises(Exception, match="not below"):
        clustering.cluster(frame(spark, [(1, [1e30, 0.0], 0)]), dims=2).vectors.collect()
