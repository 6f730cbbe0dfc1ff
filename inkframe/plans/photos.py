"""Queries over pages and characters that are filtered whole: a checksum for each line of pixels. No SQL but for ``density_bands``; tests hold
every pixel, box and region against plain numpy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import augment, filters, masks, regions, splitting
from ..operators import metrics as M
from ..sources import derived as D
from ..sources.staged import staged
from .registry import query


def _sums(of: DataFrame, *key: str) -> DataFrame:
    """(*key, y, n_light, total), the key glyph_id unless given: pixels above 0, and the sum of each pixel times its place."""
    weighted = F.aggregate(F.transform("vs", lambda v, x: (v * (x + 1)).cast("long")), F.lit(0).cast("long"), lambda a, v: a + v)
    return of.select(*(key or ("glyph_id",)), "y", F.size(F.filter("vs", lambda v: v > 0)).alias("n_light"), weighted.alias("total"))


def _pages(spark, sf_dir) -> DataFrame:
    return filters.lines(D.photographs(spark, sf_dir))


def _characters(spark, sf_dir) -> DataFrame:
    return filters.lines(D.pixels(spark, sf_dir).withColumn("v", F.col("v").cast("int")))


@query()
def even_backgrounds(spark, sf_dir):
    return _sums(filters.even_background(_pages(spark, sf_dir)))


@query()
def equalized_pages(spark, sf_dir):
    return _sums(filters.equalized(_pages(spark, sf_dir)))


@query()
def binarized_pages(spark, sf_dir):
    """Pages enhanced, then made ink by the best of three thresholds."""
    return _sums(filters.binarized_pages(_pages(spark, sf_dir)))


@query()
def dark_stroke_pages(spark, sf_dir):
    return _sums(filters.dark_strokes(_pages(spark, sf_dir)))


@query()
def canvas_pages(spark, sf_dir):
    return _sums(filters.canvas_strokes(_pages(spark, sf_dir)))


@query()
def character_inks(spark, sf_dir):
    return _sums(filters.character_ink(_characters(spark, sf_dir)))


@query()
def normalized_characters(spark, sf_dir):
    """Characters as ink, strengthened and put on 28 x 28."""
    ink = _characters(spark, sf_dir).withColumn("vs", F.transform("vs", lambda v: F.when(v >= 128, 255).otherwise(0)))
    return _sums(filters.normalized(ink))


@query()
def preprocessed_characters(spark, sf_dir):
    """What a classifier gets of a character's ink map."""
    return _sums(filters.preprocessed(_characters(spark, sf_dir)))


def _covered(runs: DataFrame) -> DataFrame:
    """(glyph_id, y, n_runs, n_ink) of each row that has runs."""
    return runs.groupBy("glyph_id", "y").agg(F.count("*").alias("n_runs"), F.sum(F.col("x1") - F.col("x0") + 1).alias("n_ink"))


@query()
def ruled_line_runs(spark, sf_dir):
    """Ruled lines of the pages' lighter pixels, gaps healed."""
    return _covered(masks.ruled_lines(masks.row_runs(D.photographs(spark, sf_dir), F.col("v") >= 70)))


@query()
def ruled_lines_less_strokes(spark, sf_dir):
    runs = staged(masks.row_runs(D.photographs(spark, sf_dir), F.col("v") >= 70), "runs", by="glyph_id")
    return _covered(masks.without_strokes(runs, masks.ruled_lines(runs)))


@query()
def page_grids(spark, sf_dir):
    """Ruled lines and guides that are taken away, pixels a row."""
    return masks.grid_lines(D.photographs(spark, sf_dir), F.col("v") >= 70).groupBy("glyph_id", "y").agg(F.count("*").alias("n"), F.sum("x").alias("total"))


@query()
def training_pictures(spark, sf_dir):
    """A training set's pictures of the suppliers' characters, those of target, corrected and hard rows augmented: checksums of their lines."""
    rows = D.read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), D.vocabulary_at(F.col("s_suppkey") % 16).alias("label"))
    found = augment.training_pictures(M.training_rows(rows, rows.filter("id % 3 = 0"), rows.filter("id % 5 = 0")), _characters(spark, sf_dir))
    return _sums(found, "part", "id", "copy")


#: From here on a page's pixel is a stroke's.
STROKE = 100


def wide_boxes(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Pages (image_id, y, x, v) and boxes (image_id, glyph_id, x, y, w, h) on them: five narrow ones and two that hold several strokes."""
    pages = D.photographs(spark, sf_dir).withColumnRenamed("glyph_id", "image_id")
    g, k = F.col("image_id"), F.col("k")
    boxes = D.read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("image_id")).withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(6).cast("long"))))
    wide = k >= 5
    return pages, boxes.select(
        "image_id", (g * 7 + k).alias("glyph_id"), F.when(wide, (k - 5) * 3 + g % 5).otherwise(9 * k + g % 7).alias("x"), (4 + (g + k) % 5).alias("y"),
        F.when(wide, 24 + g * 5 % 32).otherwise(8 + (g + k) % 4).alias("w"), (16 + (g * 3 + k) % 12).alias("h"))


@query()
def recursive_splits(spark, sf_dir):
    """Wide boxes of the pages cut at valleys, by parts or evenly, until none is wide."""
    pages, boxes = wide_boxes(spark, sf_dir)
    return splitting.split_boxes(pages, F.col("v") >= STROKE, boxes)


def _underlined(spark, sf_dir) -> tuple[DataFrame, Column]:
    return D.underlined(spark, sf_dir).withColumnRenamed("glyph_id", "image_id"), F.col("v") >= STROKE


@query()
def component_boxes(spark, sf_dir):
    """Boxes of what hangs together on underlined pages."""
    return regions.components(*_underlined(spark, sf_dir))


@query()
def blobs_on_lines(spark, sf_dir):
    """What wide blobs of those pages hold when their line is taken away."""
    return regions.blobs_on_lines(*_underlined(spark, sf_dir))


@query()
def components_with_blobs(spark, sf_dir):
    return regions.components_with_blobs(*_underlined(spark, sf_dir))


@query(D.with_("underlined") + """, rows_ AS (SELECT glyph_id AS image_id, y, count(*) FILTER (v >= 100) AS n FROM underlined GROUP BY ALL),
sized AS (SELECT image_id, count(*) AS height, greatest(9, count(*)//40*2+1) AS kernel FROM rows_ GROUP BY image_id),
smooth AS (SELECT a.image_id, a.y, height, sum(b.n) AS s FROM rows_ a JOIN sized USING (image_id) JOIN rows_ b ON b.image_id = a.image_id AND abs(b.y-a.y) <= kernel//2 GROUP BY ALL),
cut AS (SELECT *, greatest((sum(s) OVER p+sqrt((height*sum(s*s) OVER p-sum(s) OVER p*sum(s) OVER p)::DOUBLE)*0.35::DOUBLE)/height, max(s) OVER p*0.22::DOUBLE) AS cutoff FROM smooth WINDOW p AS (PARTITION BY image_id)),
isle AS (SELECT *, y-row_number() OVER (PARTITION BY image_id ORDER BY y) AS isle FROM cut WHERE s >= cutoff),
runs AS (SELECT image_id, isle, min(y) AS y0, max(y)+1 AS y1, first(height) AS height FROM isle GROUP BY ALL)
SELECT image_id, row_number() OVER (PARTITION BY image_id ORDER BY y0) AS k, y0, y1, height FROM runs WHERE y1 = height OR y1-y0 >= greatest(20, floor(height*0.04))""")
def density_bands(spark, sf_dir):
    """Dense stretches of rows of underlined pages."""
    pages, ink = _underlined(spark, sf_dir)
    return regions.density_bands(pages.withColumn("i", ink))


@query()
def proposed_regions(spark, sf_dir):
    """Regions of underlined pages that may hold an expression, in the order they are tried."""
    return regions.proposed_regions(*_underlined(spark, sf_dir))
