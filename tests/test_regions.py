"""Boxes of what hangs together, blobs on lines, bands and proposals against plain versions, on a given table and on odd pictures."""

import numpy as np
import plain_pictures as plain
import pytest
from pyspark.sql import functions as F
from test_masks import ruled
from test_splitting import all_split

from inkframe.operators import regions as R
from inkframe.plans import catalog, photos
from inkframe.sources import derived

DATA = "/root/testdata/sf0.001"


def filled(a):
    """``a`` with every ground that ink shuts in, corners apart."""
    h, w = a.shape
    out, todo = np.zeros((h + 2, w + 2), bool), [(0, 0)]
    ink = np.pad(a > 0, 1)
    out[0, 0] = True
    while todo:
        y, x = todo.pop()
        for q in ((y + 1, x), (y - 1, x), (y, x + 1), (y, x - 1)):
            if 0 <= q[0] < h + 2 and 0 <= q[1] < w + 2 and not out[q] and not ink[q]:
                out[q] = True
                todo.append(q)
    return ~out[1:-1, 1:-1]


def outlines(a):
    """(x, y, w, h, area) of outermost outlines; the area square by square."""
    found = []
    for own in plain.parts(filled(a).astype(int)):
        m = np.zeros(a.shape, int)
        for p in own:
            m[p] = 1
        squares = m[:-1, :-1] + m[1:, :-1] + m[:-1, 1:] + m[1:, 1:]
        ys, xs = np.nonzero(m)
        found.append((xs.min(), ys.min(), np.ptp(xs) + 1, np.ptp(ys) + 1, (squares == 4).sum() + 0.5 * (squares == 3).sum()))
    return found


def components(a):
    h, w = a.shape
    return [f[:4] for f in outlines(a) if f[4] >= max(6.0, float(h * w) * 0.000015) and f[2] < w * 0.98 and f[3] < h * 0.98 and f[2] >= 2 and f[3] >= 4]


def blobs(a):
    height, width = a.shape
    found = []
    for x, y, w, h, _ in outlines(a):
        if w < max(72, int(width * 0.30)) or h < max(22, int(height * 0.06)) or w < max(h * 1.35, 28):
            continue
        own = a[y : y + h, x : x + w]
        line = ruled(own, True, (0.42 if w >= 120 else 0.36, 0.10, 0.18))
        if not line.any():
            continue
        rest = plain.closing(np.where(line > 0, 0, own), [(0, 0), (-1, 0), (0, -1)])
        rest = plain.without_small(rest, max(6, int(w * h * 0.00035)))
        for u, v, p, q in all_split((rest > 0).astype(int), components(rest)):
            ink = np.count_nonzero(rest[v : v + q, u : u + p]) / (p * q)
            if p * q >= max(18, int(w * h * 0.00012)) and q >= max(14, int(h * 0.28)) and ink >= 0.08 and not (p >= w * 0.92 and q >= h * 0.65):
                found.append((x + u, y + v, p, q))
    return sorted(found)


def overlap(a, b):
    w, h = (max(0, min(a[i] + a[i + 2], b[i] + b[i + 2]) - max(a[i], b[i])) for i in (0, 1))
    return w * h / max(1, min(a[2] * a[3], b[2] * b[3]))


def both(a):
    kept = components(a)
    for b in blobs(a):
        if all(overlap(b, k) < 0.72 for k in kept):
            kept.append(b)
    return kept


def bands(a):
    h = len(a)
    if h < 9:
        return []
    k = max(9, h // 40 * 2 + 1)
    s = np.convolve(np.count_nonzero(a, axis=1), np.ones(k, int), "same")
    dense = s / k >= max(np.mean(s / k) + 0.35 * np.std(s / k), s.max() / k * 0.22) - 1e-9
    edges = np.flatnonzero(np.diff(np.r_[0, dense.astype(int), 0]))
    return [(p, q) for p, q in zip(edges[::2], edges[1::2]) if q == h or q - p >= max(20, int(h * 0.04))]


def once(regions):
    out = []
    for x0, y0, x1, y1 in regions:
        r = (max(0, x0), max(0, y0), max(max(0, x0) + 1, x1), max(max(0, y0) + 1, y1))
        if (r[2] - r[0]) * (r[3] - r[1]) >= 64 and r not in out:
            out.append(r)
    return out


def proposals(a):
    height, width = a.shape
    rects = both(a)
    if not rects:
        return [(0, 0, width, height)]
    mw, mh = (float(np.median([r[i] for r in rects])) for i in (2, 3))
    chars = [r for r in rects if r[2] * r[3] >= max(8, int(height * width * 0.00002)) and r[3] >= max(8, int(height * 0.018)) and r[3] <= height * 0.8 and r[2] <= width * 0.75 and not (r[2] / r[3] > 12 and r[3] < mh * 0.7)]
    base = chars if len(chars) >= 2 else rects
    ma = float(np.median([r[2] * r[3] for r in base]))
    mx, my = max(6, int(width * 0.02)), max(6, int(height * 0.02))
    core = [r for r in base if not ((r[0] <= mx or r[1] <= my or r[0] + r[2] >= width - mx or r[1] + r[3] >= height - my) and r[2] * r[3] < max(12.0, ma * 0.35))]
    source = sorted(core if len(core) >= 2 else base, key=lambda r: r[1] + r[3] / 2)
    rows = [[source[0]]]
    for before, r in zip(source, source[1:]):
        if r[1] + r[3] / 2 - before[1] - before[3] / 2 > max(16, int(mh * 0.85)):
            rows.append([])
        rows[-1].append(r)

    def around(some, px, py):
        return (max(0, min(r[0] for r in some) - px), max(0, min(r[1] for r in some) - py), min(width, max(r[0] + r[2] for r in some) + px), min(height, max(r[1] + r[3] for r in some) + py))

    found = [around(r, max(12, int(mw * 0.9)), max(12, int(mh * 0.9))) for r in rows]
    found = [r for r in found if r[2] - r[0] >= max(28, int(width * 0.08)) and r[3] - r[1] >= max(24, int(height * 0.05))]
    pad = max(10, int(mh))
    found += [(0, max(0, p - pad), width, min(height, q + pad)) for p, q in bands(a)]
    near, px, py = [], max(10, int(width * 0.02)), max(10, int(height * 0.02))
    for r in sorted(once(found)):
        o = near[-1] if near else None
        if o and min(r[2], o[2]) - max(r[0], o[0]) > -px and min(r[3], o[3]) - max(r[1], o[1]) > -py and r[0] <= o[2] + px and r[2] >= o[0] - px and r[1] <= o[3] + py and r[3] >= o[1] - py:
            near[-1] = (min(r[0], o[0]), min(r[1], o[1]), max(r[2], o[2]), max(r[3], o[3]))
        else:
            near.append(r)
    return once([around(source, max(14, int(mw * 1.15)), max(14, int(mh * 1.10))), *found, *near, (0, 0, width, height)])


def arrays(pixels, threshold):
    out = {}
    for k, p in pixels.toPandas().groupby("image_id"):
        a = np.zeros((p.y.max() + 1, p.x.max() + 1), int)
        a[p.y, p.x] = np.where(p.v.fillna(0) >= threshold, 255, 0)
        out[k] = a
    return out


def held(df, plain_version, a, columns):
    got = {k: [] for k in a}
    for r in df.collect():
        got[r.image_id].append(tuple(r[c] for c in columns))
    want = {k: [tuple(int(v) for v in r) for r in plain_version(m)] for k, m in a.items()}
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    return want


@pytest.fixture(scope="module")
def own(spark):
    rng = np.random.default_rng(5)
    pages = []
    for k in range(14):
        h, w = int(rng.integers(1, 70)), int(rng.integers(1, 150))
        a = rng.random((h, w)) < (0.05, 0.3, 0.6, 0.95, 0.0)[k % 5]
        if k == 7:  # a ring with a dot in it, a thin line and two pixels that meet at a corner
            a = np.zeros((30, 40), bool)
            a[2:20, 3:25], a[5:17, 6:22], a[10:12, 10:13], a[25, 2:30], a[23, 30], a[24, 31] = True, False, True, True, True, True
        if k == 8:  # strokes that a line over the whole page joins
            a = np.zeros((60, 140), bool)
            a[40:42] = True
            for x in range(6, 130, 24):
                a[12:40, x : x + 7] = True
            a[24:27, 54:85] = True
        pages += [(k, y, x, 200 if a[y, x] else (None if (x + y) % 5 == 0 else 3), "q") for y in range(a.shape[0]) for x in range(a.shape[1])]
    pixels = spark.createDataFrame(pages, "image_id long, y int, x int, v int, w string").repartition(3).cache()
    return pixels, arrays(pixels, 100)


INK = "v >= 100"


def test_outlines(own):
    pixels, a = own
    marked = pixels.select("image_id", F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"), F.coalesce(F.expr(INK), F.lit(False)).alias("i"))
    got = {k: [] for k in a}
    for r in R.outlines(marked).collect():
        got[r.image_id].append((r.x, r.y, r.w, r.h, r.area))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(outlines(m)) for k, m in a.items()}
    assert sorted(got[7]) == [(2, 25, 28, 1, 0.0), (3, 2, 22, 18, 357.0), (30, 23, 2, 2, 0.0)]


def test_boxes_and_proposals_of_odd_pictures(own):
    pixels, a = own
    box = ("x", "y", "w", "h")
    held(R.components(pixels, F.expr(INK)), components, a, box)
    held(R.components_with_blobs(pixels, F.expr(INK)), both, a, box)
    got = {k: [] for k in a}
    for r in R.proposed_regions(pixels, F.expr(INK)).orderBy("image_id", "ord").collect():
        got[r.image_id].append((r.x0, r.y0, r.x1, r.y1))
    assert got == {k: proposals(m) for k, m in a.items()}
    assert len(both(a[8])) == 6 and not components(a[8]) and got[4] == [(0, 0, a[4].shape[1], a[4].shape[0])]


def test_bands_of_odd_pictures(own):
    pixels, a = own
    held(R.density_bands(pixels.withColumn("i", F.coalesce(F.expr(INK), F.lit(False)))), bands, a, ("y0", "y1"))


def test_whole_table(spark):
    pages = derived.underlined(spark, DATA).withColumnRenamed("glyph_id", "image_id")
    a, box = arrays(pages, photos.STROKE), ("x", "y", "w", "h")
    some = held(catalog.QUERIES["component_boxes"](spark, DATA), components, a, box)
    blob = held(catalog.QUERIES["blobs_on_lines"](spark, DATA), blobs, a, box)
    more = held(catalog.QUERIES["components_with_blobs"](spark, DATA), both, a, box)
    held(catalog.QUERIES["density_bands"](spark, DATA), bands, a, ("y0", "y1"))
    got = {k: [] for k in a}
    for r in catalog.QUERIES["proposed_regions"](spark, DATA).orderBy("image_id", "ord").collect():
        got[r.image_id].append((r.x0, r.y0, r.x1, r.y1))
    assert got == {k: proposals(m) for k, m in a.items()}
    assert sum(map(len, blob.values())) > 10 and sum(len(more[k]) > len(some[k]) for k in a) >= 1 and any(len(v) >= 4 for v in got.values())


def test_no_rows(spark):
    none = spark.createDataFrame([], "image_id long, y long, x long, v int")
    assert R.proposed_regions(none, F.expr(INK)).count() == 0 and R.components_with_blobs(none, F.expr(INK)).count() == 0


@pytest.mark.parametrize("corners", [True, False])
def test_parts_by_fold_and_by_picture_are_the_same(own, corners, monkeypatch):
    from inkframe.operators import pixels as P

    pixels, a = own
    runs = P.row_runs(pixels.select(F.struct(F.col("image_id").alias("k")).alias("glyph_id"), "y", "x", "v"), F.expr(INK))
    found = []
    for most in (0, 1 << 30):
        monkeypatch.setattr(P, "FOLDED", most)
        found.append(sorted((r.glyph_id.k, r.y, r.x0, r.x1, r.part) for r in P.labelled_runs(runs, corners).collect()))
    assert found[0] == found[1] and len(found[0]) > 3000
    if corners:
        assert len({(r[0], r[4]) for r in found[0]}) == sum(len(plain.parts(m)) for m in a.values())


def test_parts_of_a_page_of_ten_megapixels(spark):
    from inkframe.operators import pixels as P

    # 3,000 rows of 40 runs, each run one further than the one above it: 40 slanted strokes; and a comb that joins the last ten below
    strokes = spark.range(120_000).select(F.lit(1).cast("long").alias("glyph_id"), F.expr("cast(id div 40 as int)").alias("y"), F.expr("cast(id % 40 * 80 + id div 40 % 2 as int)").alias("x0"))
    comb = spark.range(1).select(F.lit(1).cast("long").alias("glyph_id"), F.lit(3000).alias("y"), F.lit(30 * 80).alias("x0"), F.lit(3199).alias("x1"))
    runs = strokes.withColumn("x1", F.col("x0") + 5).unionByName(comb)
    n = P.labelled_runs(runs).groupBy("part").count().collect()
    assert len(n) == 31 and sorted(r["count"] for r in n) == [3000] * 30 + [30_001] and {r.part for r in n} == set(range(31))
