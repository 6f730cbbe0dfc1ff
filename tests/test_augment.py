"""Augmented characters step by step against plain numpy; reruns agree, repeats differ."""

import math

import numpy as np
import plain_pictures as plain
import pytest
from pyspark.sql import functions as F

from inkframe.operators import augment as A
from inkframe.operators import filters
from inkframe.operators import metrics as M
from inkframe.sources import derived as D

DATA = "/root/testdata/sf0.001"
KEY = ("part", "id", "copy")


@pytest.fixture(scope="module")
def copies(spark):
    """Copies of drawn characters of three classes, light on dark, with an empty and a full one."""
    rng = np.random.default_rng(3)
    rows = []
    for k in range(14):
        a = np.zeros((28, 28), int)
        for t in np.linspace(0, 1, 200):
            y, x = int(3 + 20 * t), int(4 + 18 * (0.5 + 0.5 * math.sin(5 * t + k)))
            a[y : y + 1 + k % 3, x : x + 1 + k % 2] = 150 + rng.integers(0, 100)
        a = {12: np.zeros((28, 28), int), 13: np.full((28, 28), 200)}.get(k, a)
        rows += [("target", k, c, "*/7"[k % 3], a.tolist()) for c in range(1, 5)]
    return spark.createDataFrame(rows, "part string, id long, copy int, label string, picture array<array<int>>").repartition(3).cache()


def by_key(df, *columns):
    return {(r.part, r.id, r.copy): r for r in df.collect()}


def moved_back(r):
    """The matrix of the way back, by numpy's own inverse."""
    t = math.radians(r.angle)
    a, b = r.scale * math.cos(t), r.scale * math.sin(t)
    m = np.array([[a, b + r.shear, (1 - a) * 14 - b * 14 + r.tx], [-b, a, b * 14 + (1 - a) * 14 + r.ty], [0, 0, 1]])
    return np.linalg.inv(m)[:2].ravel()


def test_copies_are_moved_restroked_and_softened(copies):
    drawn = A.draws(copies, KEY).withColumns({"back": A.inverse()}).withColumn("warped", A.warped(F.col("picture"), F.col("back")))
    steps = {"wider": A._restroked(F.col("warped"), F.array_max, F.greatest), "thinner": A._restroked(F.col("warped"), F.array_min, F.least), "softened": A._softened(F.col("warped"))}
    corner = [(0, 0), (0, -1), (-1, 0), (-1, -1)]
    spans = {"*": A.SPANS["*"], "/": A.SPANS["/"], "7": A.OTHER}
    for r in drawn.withColumns(steps).collect():
        assert np.allclose(r.back, moved_back(r), atol=1e-9)
        want = plain.warped(np.array(r.picture), r.back)
        assert (np.array(r.warped) == want).all()
        assert (np.array(r.wider) == plain.moved(want, corner, max)).all() and (np.array(r.thinner) == plain.moved(want, corner, min)).all()
        assert (np.array(r.softened) == plain.softened(want)).all()
        angle, s0, s1, shear, n0, n1 = spans[r.label]
        assert abs(r.angle) <= angle and s0 <= r.scale <= s1 and abs(r.shear) <= shear and n0 <= r.noise <= n1 and abs(r.tx) <= 3 and abs(r.ty) <= 3
    assert {r.strokes for r in drawn.collect()} == {None, "wider", "thinner"} and {r.soft for r in drawn.collect()} == {True, False}


def test_noise_has_its_spread(copies):
    full = copies.filter("id = 13").withColumn("picture", F.transform("picture", lambda r: F.transform(r, lambda v: F.lit(100))))
    noise = {k: r.noise for k, r in by_key(A.draws(full, KEY)).items()}
    for k, r in by_key(A.changed(full, KEY)).items():
        middle = np.array(r.picture)[9:19, 9:19]  # away from what moves in from outside
        assert abs(middle.mean() + 0.5 - 100) < noise[k] and 0.6 * noise[k] < middle.std() < 1.5 * noise[k]


def test_ink_is_found_and_fitted(copies):
    changed = {k: np.array(r.picture) for k, r in by_key(A.changed(copies, KEY)).items()}
    got = {}
    for r in A.augmented(copies.repartition(2), KEY).orderBy("y").collect():
        got.setdefault((r.part, r.id, r.copy), []).append(r.vs)
    assert sorted(got) == sorted(changed)
    for k, a in changed.items():
        assert (np.array(got[k]) == plain.fitted(plain.lesser_shade(a))).all(), k
    assert len({str(v) for k, v in got.items() if k[1] < 12}) == 48  # repeats differ


def test_small_ink_grows_and_one_shade_is_empty(spark):
    pictures = {1: np.zeros((28, 28), int), 2: np.zeros((28, 28), int), 3: np.full((28, 28), 9), 4: np.zeros((28, 28), int)}
    pictures[1][4:9, 5:8] = pictures[2][3, 3] = 255
    pictures[4][1:27, 2:5] = 255
    rows = [(k, y, list(map(int, v))) for k, a in pictures.items() for y, v in enumerate(a)]
    df = spark.createDataFrame(rows, "glyph_id long, y int, vs array<int>")
    for f, want in ((A.fitted, plain.fitted), (A.ink, plain.lesser_shade)):
        got = {}
        for r in f(df).orderBy("y").collect():
            got.setdefault(r.glyph_id, []).append(r.vs)
        assert all((np.array(got[k]) == want(a)).all() for k, a in pictures.items() if k != 3 or f is A.fitted) and (f is A.fitted or not np.any(got[3]))


def test_a_training_set_has_all_its_pictures(spark):
    ids = D.read(spark, DATA, "supplier").select(F.col("s_suppkey").alias("id"), D.vocabulary_at(F.lit(12) + F.col("s_suppkey") % 3).alias("label"))
    rows = M.training_rows(ids, ids.filter("id % 3 = 0"), ids.filter("id % 5 = 0")).cache()
    pictures = filters.lines(D.pixels(spark, DATA).withColumn("v", F.col("v").cast("int"))).cache()
    got = A.training_pictures(rows, pictures).cache()
    assert got.count() == 28 * rows.count() and got.select(*KEY).distinct().count() == rows.count()
    own = got.filter("part = 'base'").select(F.col("id").alias("glyph_id"), "y", "vs")
    assert own.exceptAll(pictures.select("glyph_id", "y", "vs")).isEmpty() and own.count() == pictures.count()
    again = A.training_pictures(rows.repartition(3), pictures.repartition(2))
    assert got.exceptAll(again).isEmpty()
    assert A.training_pictures(rows.limit(0), pictures).count() == A.training_pictures(rows, pictures.limit(0)).count() == 0


def test_copies_are_dealt_to_tasks(spark, monkeypatch):
    """A training set's rows are small, so Spark would make all its copies in one task."""
    dealt = []
    monkeypatch.setattr(A, "COPIES", 2, raising=False)
    monkeypatch.setattr(A, "augmented", lambda copies, key, seed: dealt.append(copies) or copies.select(*key, F.lit(0).alias("y"), F.array(F.lit(0)).alias("vs")))
    rows = spark.createDataFrame([("plain", 1, 0, "1")] + [("target", 1, k, "*") for k in range(5)], "part string, id long, copy int, label string")
    pictures = spark.createDataFrame([(1, y, [0] * 28) for y in range(28)], "glyph_id long, y int, vs array<int>")
    found = A.training_pictures(rows, pictures)
    assert dealt[0].rdd.getNumPartitions() == 3 and dealt[0].count() == 5
    assert found.groupBy("part").count().orderBy("part").collect() == [("plain", 28), ("target", 5)]
