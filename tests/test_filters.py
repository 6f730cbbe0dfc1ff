"""Filters over whole tables of pictures of several sizes against plain numpy, pixel by pixel."""

import numpy as np
import plain_pictures as plain
import pytest
from pyspark.sql import functions as F

from inkframe.operators import filters
from inkframe.operators import pixels as P
from inkframe.sources import derived

DATA = "/root/testdata/sf0.001"


def pictures(lines):
    out = {}
    for r in sorted(lines.collect(), key=lambda r: (r.glyph_id, r.y)):
        out.setdefault(r.glyph_id, []).append(r.vs)
    return {k: np.array(v, int) for k, v in out.items()}


@pytest.fixture(scope="module")
def pages(spark):
    df = filters.lines(derived.photographs(spark, DATA)).cache()
    return df, pictures(df)


@pytest.fixture(scope="module")
def characters(spark):
    """Drawn characters as ink maps: 28 x 28 and smaller, with an empty one, a dot, a thin stroke and a large one."""
    rng = np.random.default_rng(5)
    own = pictures(filters.lines(derived.pixels(spark, DATA)))
    for k in range(6):
        h, w = [(19, 40), (28, 28), (9, 9), (60, 33), (45, 50), (24, 31)][k]
        a = rng.integers(0, 25, (h, w))
        for t in np.linspace(0, 1, 300):
            y, x = int(2 + (h - 5) * t), int(2 + (w - 5) * (0.5 + 0.5 * np.sin(6 * t + k)))
            a[y : y + 1 + k % 3, x : x + 1 + k % 2] = 180 + rng.integers(0, 70)
        own[1000 + k] = a
    own[2000], own[2001] = np.zeros((28, 28), int), np.zeros((12, 17), int)
    own[2001][5, 5] = 255
    rows = [(k, y, list(map(int, line))) for k, a in own.items() for y, line in enumerate(a)]
    return spark.createDataFrame(rows, "glyph_id long, y int, vs array<int>").repartition(4).cache(), own


def same(got, want):
    assert sorted(got) == sorted(want)
    for k in want:
        assert got[k].shape == want[k].shape, k
        assert (got[k] == want[k]).all(), (k, np.argwhere(got[k] != want[k])[:5].tolist(), got[k][got[k] != want[k]][:5], want[k][got[k] != want[k]][:5])


@pytest.mark.parametrize("name", ["even_background", "equalized", "dark_strokes", "canvas_strokes"])
def test_whole_pictures(pages, name):
    df, own = pages
    plain_name = {"equalized": "contrast"}.get(name, name)
    want = {k: getattr(plain, plain_name)(a) for k, a in own.items()}
    same(pictures(getattr(filters, name)(df)), want)
    if name == "even_background":  # skipped, fallen back, changed
        assert any(a.std() < 18 for a in own.values()) and any(a.std() >= 18 and (want[k] == a).all() for k, a in own.items()) and any((want[k] != a).any() for k, a in own.items())


def test_pictures_enhanced_and_binarized(pages):
    df, own = pages
    enhanced = filters.enhanced(df).cache()
    want = {k: plain.enhanced(a) for k, a in own.items()}
    same(pictures(enhanced), want)
    same(pictures(filters.binarized(enhanced)), {k: plain.binarized(a) for k, a in want.items()})


def test_large_pictures_have_their_background_found_small(spark):
    y, x = np.mgrid[0:26, 0:640]
    a = 30 + x // 5 + 70 * ((x // 7 + y) % 5 == 0)
    df = spark.createDataFrame([(1, i, list(map(int, line))) for i, line in enumerate(a)], "glyph_id long, y int, vs array<int>")
    same(pictures(filters.even_background(df)), {1: plain.even_background(a)})


@pytest.mark.parametrize("name", ["character_ink", "preprocessed"])
def test_characters_from_ink_maps(characters, name):
    df, own = characters
    same(pictures(getattr(filters, name)(df)), {k: getattr(plain, name)(a) for k, a in own.items()})


@pytest.mark.parametrize("name", ["strengthened", "one_character", "centred", "normalized"])
def test_characters_from_masks(characters, name):
    df, own = characters
    masks = {k: np.where(a > 128, 255, 0) for k, a in own.items()}
    mask = df.withColumn("vs", F.transform("vs", lambda v: F.when(v > 128, 255).otherwise(0)))
    want = {k: getattr(plain, {"one_character": "character"}.get(name, name))(a) for k, a in masks.items()}
    same(pictures(getattr(filters, name)(mask)), want)


def test_local_means_and_openings_of_even_rectangles(characters):
    df, own = characters
    for block, offset in ((21, -2), (35, -5), (9, 3)):
        same(pictures(filters.above_means(filters.local_means(df, block), offset)), {k: plain.above_means(a, block, offset) for k, a in own.items()})
    for w, h in ((2, 2), (5, 1), (4, 7)):
        same(pictures(filters.opened(df, w, h)), {k: plain.opening(a, plain.box(w, h)) for k, a in own.items()})
    same(pictures(filters.turned(filters.turned(df))), own)
    assert P.threshold_scores(filters.pixels_of(df), F.col("v") > 300).filter("score is not null").count() == 0


def test_only_pictures_of_28_by_28_are_taken_as_they_are(spark):
    def colours(side):
        return spark.range(side * side).select(F.lit(side).cast("long").alias("glyph_id"), (F.col("id") / side).cast("long").alias("y"), (F.col("id") % side).alias("x")).withColumn("b", F.when(F.col("x").between(10, 13), 250).otherwise(5)).withColumns({"g": F.col("b"), "r": F.col("b")})
    got = {r.glyph_id: r.top for r in P.ink_map(colours(28).union(colours(30)), whole=False).filter("y = 3 and x = 11").select("glyph_id", F.col("v").alias("top")).collect()}
    assert got == {28: 250, 30: 5}
    assert {r.v for r in P.ink_map(colours(30)).filter("y = 3 and x = 11").collect()} == {250}


def test_a_filter_shuffles_lines_once_and_no_pixels(characters):
    df, _ = characters
    for f in (filters.closed(df, 5, 5), filters.equalized(df), filters.strengthened(df)):
        plan = f._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1 and "Generate" not in plan


def test_pages_are_made_ink_with_one_shuffle_of_lines(pages):
    df, own = pages
    y, x = np.mgrid[0:26, 0:640]
    more = {5001: 30 + x // 5 + 70 * ((x // 7 + y) % 5 == 0), 5002: np.zeros((26, 640), int), 5003: np.full((7, 5), 9)}  # large and busy, large and even, small and even
    rows = [(k, i, list(map(int, line))) for k, a in more.items() for i, line in enumerate(a)]
    both = df.unionByName(df.sparkSession.createDataFrame(rows, "glyph_id long, y int, vs array<int>"))
    want = {k: plain.binarized(plain.enhanced(a)) for k, a in (own | more).items()}
    same(pictures(filters.binarized_pages(both)), want)


def test_the_query_of_ink_pages_joins_nothing(spark, monkeypatch):
    from inkframe.plans import catalog

    monkeypatch.setattr(filters, "LINES_TAKEN", 100)
    found = catalog.QUERIES["binarized_pages"](spark, DATA)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan
