"""Clustering by ball trees against comparing every row with every centroid in plain integers."""

import hashlib
import math
import random

import numpy as np
import pytest

from inkframe.llm import ball_tree

SCHEMA = "vec_id long, embedding array<double>, id string, q int, cluster string, far int"


def brute(rows, k=8, rounds=10, seed=3):
    grid = lambda x: max(-(1 << 63), min((1 << 63) - 1, math.floor(1024 * x) if abs(x) < 1e300 else math.copysign(1e300, x)))
    pts = [(i, [int(grid(x)) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    h = lambda i: (1, "") if i is None else (0, hashlib.sha256(f"{seed}:{i}".encode()).hexdigest())
    now = [q for _, q in sorted(pts, key=lambda p: (h(p[0]), p[1]))[:k]]
    near = lambda q: min((sum((a - b) ** 2 for a, b in zip(q, c)), j) for j, c in enumerate(now))
    for _ in range(rounds):
        groups = {}
        for _, q in pts:
            groups.setdefault(near(q)[1], []).append(q)
        for j, own in groups.items():
            now[j] = [sum(x) // len(own) for x in zip(*own)]
    top = (1 << 63) - 1
    at = [(i, *near(q)) for i, q in pts]
    inertia = {j: sum(min(top, d) for _, d, c in at if c == j) for j in range(len(now))}
    total = min(top, sum(inertia.values()))
    return sorted(((i, c, min(top, d), min(top, inertia[c]), total, hashlib.sha256(",".join(map(str, now[c])).encode()).hexdigest()) for i, d, c in at), key=str)


def close_by(rng, n, spread=0.02):
    hearts = [[rng.uniform(-1, 1) for _ in range(64)] for _ in range(11)]
    return [(i, [x + rng.gauss(0, spread) for x in hearts[i % 11]]) for i in range(n)]


def cases():
    rng = random.Random(4)
    one = [0.5] * 64
    odd = [(1, None), (2, []), (3, [1.0] * 63), (4, [1.0] * 65), (5, [1.0] * 63 + [None]), (6, [1.0] * 63 + [float("nan")]), (7, [float("inf")] * 64)]
    few = [(i, [rng.uniform(-1, 1) for _ in range(64)]) for i in range(5)]
    wide = [(i, [rng.choice([1e5, -1e16, 1e300, 0.25, -7e17]) for _ in range(64)]) for i in range(40)]
    return {
        "clusters": close_by(rng, 700), "odd": odd + close_by(rng, 60), "only odd": odd, "few": few, "none": [], "one vector": [(i, one) for i in range(200)] + [(900, [-x for x in one])],
        "repeated and without id": [*close_by(rng, 50), *close_by(random.Random(9), 50), *[(None, v) for _, v in few], (None, one), (3, one)], "ties": [(i, [float(i % 3)] * 64) for i in range(30)], "wide": wide + close_by(rng, 40),
    }


@pytest.mark.parametrize("name", cases())
def test_against_all_distances(spark, name):
    rows = cases()[name]
    df = spark.createDataFrame([(i, v, "x", 1, "c", 2) for i, v in rows], SCHEMA).repartition(3)
    rounds = 10 if name == "clusters" else 2
    got = ball_tree.cluster(df, rounds=rounds)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows, rounds=rounds)


def test_balls_are_given_whole_and_nothing_else_changes():
    rng = np.random.default_rng(2)
    hearts = rng.integers(-900, 900, (6, 64))
    q = np.concatenate([h + rng.integers(-20, 20, (400, 64)) for h in hearts])
    t = ball_tree.grown(np.arange(len(q)), np.ones(len(q), bool), q)
    t["sums"] = np.array(t["sums"], np.int64)
    for centroids in (hearts, q[rng.choice(len(q), 8)], np.repeat(hearts[:1], 3, 0)):
        got, compared = np.full(len(q), -1), 0
        for node, which, k in ball_tree.assigned(t, centroids.astype(object)):
            lo, hi = t["nodes"][node, :2]
            if which is None:
                assert t["sums"][node].tolist() == t["q"][lo:hi].sum(0).tolist()
            else:
                compared += hi - lo
            assert (got[lo:hi] == -1).all()
            got[lo:hi] = k if which is None else which
        assert (got == ball_tree._nearest(t["q"], centroids)[0]).all()
        if centroids is hearts:
            assert compared == 0  # every row came with a ball
    for n, (lo, hi, _) in enumerate(t["nodes"]):
        away = np.sqrt(((t["q"][lo:hi] - t["sums"][n] // (hi - lo)) ** 2).sum(1).max())
        assert abs(away - t["radius"][n]) < 1e-9
