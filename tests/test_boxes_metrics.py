import math

from pyspark.sql import functions as F

from inkframe.functions import labels
from inkframe.operators import boxes as B
from inkframe.operators import context as C
from inkframe.operators import feedback as K
from inkframe.operators import metrics as M
from inkframe.plans import catalog


def test_priority_matches_published_metrics():
    # The published quality of the classifier
    got = M.priority(0.9623326634555063, 0.9565532223026791, 0.9873724291346458, 0.9898296438367393, 0.9936611573877527)
    assert math.isclose(got, 0.9739226725463704, rel_tol=0, abs_tol=1e-12)


def test_metrics_of_eight_samples(spark):
    pairs = spark.createDataFrame(list(zip([0, 1, 2, 2, 1, 0, 3, 3], [0, 1, 2, 1, 1, 0, 3, 2])), "truth int, pred int")
    assert abs(M.averages(pairs).first().accuracy - 6 / 8) < 1e-12
    assert {(r.truth, r.pred): r.n for r in M.confusion(pairs).collect()}[(2, 1)] == 1
    never = M.per_class(pairs.unionByName(spark.createDataFrame([(4, 0)], "truth int, pred int"))).filter("label = 4").first()
    assert (never.precision, never.recall, never.f1, never.support) == (0.0, 0.0, 0.0, 1)


def test_rows_and_containment(spark):
    boxes = spark.createDataFrame([(1, 1, 0, 0, 10, 20), (1, 2, 50, 2, 10, 20), (1, 3, 0, 100, 10, 20), (1, 4, 52, 5, 3, 3)], "image_id long, glyph_id long, x long, y long, w long, h long")
    assert {r.glyph_id: r.line for r in B.rows(boxes).collect()} == {1: 0, 2: 0, 3: 1, 4: 0}
    assert [(r["inner"], r["outer"]) for r in B.contained(boxes).collect()] == [(4, 2)]
    assert [r.glyph_id for r in B.reading_order(boxes).orderBy("place").collect()] == [1, 2, 4, 3]
    assert {r.glyph_id for r in B.clear_of(boxes).collect()} == {1, 2, 3}


def test_merge_takes_in_what_the_grown_box_reaches(spark):
    boxes = spark.createDataFrame([(1, 1, 0, 0, 20, 20), (1, 2, 2, 24, 18, 20), (1, 3, 1, 48, 19, 20), (1, 4, 200, 0, 20, 20)], "image_id long, glyph_id long, x long, y long, w long, h long")
    got = sorted((r.x, r.y, r.w, r.h, r.n_parts) for r in B.merge_broken(boxes).collect())
    # the first two stand on one another, and what they have become on the third
    assert got == [(0, 0, 20, 68, 3), (200, 0, 20, 20, 1)]


def test_labels(spark):
    df = spark.createDataFrame([("  x ",), ("−",), (None,), ("plus",), ("7",), ("a b",)], "l string")
    got = [(r.n, r.t) for r in df.select(labels.normal_label(F.col("l")).alias("n"), labels.label_token(F.col("l")).alias("t")).collect()]
    assert got == [("*", "mul"), ("−", "unknown"), ("", "unknown"), ("+", "plus"), ("7", "7"), ("a b", "unknown")]


def test_context_flips():
    assert C.corrected(list("/2+3"), [0.5, 0.9, 0.9, 0.9])[0] == list("72+3")
    assert C.corrected(list("1+/2"), [0.9, 0.7, 0.6, 0.9])[0] == list("1+72")
    assert C.corrected(list("1+-2"), [0.9, 0.6, 0.9, 0.9])[0] == list("14-2")
    assert C.corrected(list("12-"), [0.9, 0.9, 0.5])[0] == list("121")
    assert C.corrected(list("**3"), [0.5, 0.5, 0.9])[0] == list("**3")  # * resembles no digit
    assert C.corrected([], []) == ([], [])


def test_beam_reads_a_whole_expression():
    options = [[("/", 0.9), ("(", 0.6)], [("1", 0.9)], [("+", 0.9)], [("7", 0.8), ("2", 0.7)], [(")", 0.9), ("4", 0.5)]]
    assert C.best_reading(options) == "(1+7)"
    assert C.best_reading([[("+", 1.0), ("*", 0.5)], [("/", 0.3)]]) == "+/"  # none is whole


def test_feedback_sets(spark):
    rows = spark.createDataFrame([(1, 10, "2024-01-01", "corrected", 3), (2, 10, "2024-01-02", "corrected", 3), (3, 10, "2024-01-01", "rejected", 3), (4, 11, "2024-01-01", "rejected", 5), (5, 11, "2024-01-01", "rejected", 5)], "event_id long, analysis_id long, saved_at string, action string, label_idx long").withColumn("saved_at", F.to_timestamp("saved_at"))
    assert {r.event_id for r in K.last_writes(rows).collect()} == {2, 3, 4, 5}
    assert [(r.analysis_id, r.label_idx) for r in K.conflicts(rows).collect()] == [(10, 3)]
    assert {r.analysis_id: r.message for r in K.messages(rows).collect()} == {10: "Saved 2 corrections and 1 rejection.", 11: "Saved 2 rejections."}


def test_scores_of_regions_take_bounds_exactly(spark):
    """A box of 7 in a region of 25 is 0.28 wide, though 25 * 0.28 is above 7 in floating point."""
    regions = spark.createDataFrame([(1, 0, 0, 0, 25, 30, 0.18)], "image_id long, ord long, x0 int, y0 int, x1 int, y1 int, fg_ratio double")
    got = {}
    for w in (6, 7):
        boxes = spark.createDataFrame([(1, 2, 3, w, 10)], "image_id long, x long, y long, w long, h long")
        got[w] = B.region_scores(regions, boxes, 200, 120).first().score
    assert got[7] < got[6] - 1.0


def test_spread_of_heights_is_exact_in_any_order(spark):
    rows = spark.range(3000).selectExpr("id % 2 AS k", "IF(id < 1500, 69, 11) AS h").repartition(7)
    assert {r.s for r in rows.groupBy("k").agg(B.spread(F.col("h")).alias("s")).collect()} == {29.0}


def test_average_confidence_does_not_follow_the_parts_of_the_files(spark, tmp_path):
    """At a half the order of adding decides; SQL on one thread adds rows as they come, which is by key."""
    import duckdb

    keys = [(i * 7919 + j * 104729 + j * j * 31, i) for i in range(3000) for j in range(10)]
    rows = spark.createDataFrame(sorted(keys), "o_orderkey long, o_custkey long")
    rows.coalesce(1).sortWithinPartitions("o_orderkey").write.parquet(f"{tmp_path}/one")
    rows.orderBy(F.xxhash64("o_orderkey")).repartition(7).write.parquet(f"{tmp_path}/orders.parquet")
    c = duckdb.connect()
    c.execute("SET threads = 1")
    c.execute(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/one/*.parquet'")
    want = {r[0]: r[1:] for r in c.execute(catalog.ORACLE["confidence_summary"]).fetchall()}
    got = catalog.QUERIES["confidence_summary"](spark, str(tmp_path))
    assert {r.image_id: (r.avg_percent, r.n_low) for r in got.collect()} == want
