"""Mixing sources to target weights by hash-random order, distributed prefix sums and exact cuts.

Every document gets a hash-random key. Keys are uniform, so their leading hex
digits are equal ranges of the sorted order: sizes are summed per (source, range), a running sum
over the ranges gives each range its offset, and only then are documents sorted inside their own
range. A source that holds a third of all rows is spread over all ranges, and no task sorts more
than one range of one source. Sources that repeat are taken whole for each full epoch, then in key order.
Reruns give the same mix: the order depends on the rows alone.

Defined results: a null text has size 0 and is never taken; a null source is a source of its own,
last in order; rows that share a doc_id share a key and are taken by size, then by digest of the text, and of rows
that are equal in all of these it makes no difference which is taken; an empty table gives an empty
result; a source without words has target 0.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .staging import Stage

WORD = r"[^\x20\x09-\x0D]+"
#: Hex digits of the key that name a range: 16 ** 3 ranges a source.
RANGE_DIGITS = 3


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[float], share: float, most_repeats: float) -> DataFrame:
    """(source, source_size, target) from (source, source_size): water-filling of the budget.

    With level x, a source gets min(most_repeats * size, x * weight). Sources are ordered by the
    level at which they are full; prefix sums find the level that spends the whole budget. The
    table has one row a source.
    """
    by_name, by_level = Window.orderBy(F.col("source").asc_nulls_last()), Window.orderBy("full_at", F.col("source").asc_nulls_last())
    w = F.array(*[F.lit(float(x)) for x in weights])
    all_rows = Window.partitionBy()
    return (
        sizes.withColumn("weight", F.element_at(w, ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")))
        .withColumn("cap", F.col("source_size") * most_repeats)
        .withColumn("full_at", F.col("cap") / F.col("weight"))
        .withColumn("budget", F.sum("source_size").over(all_rows) * share)
        .withColumn("spent", F.coalesce(F.sum("cap").over(by_level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("open", F.sum("weight").over(by_level.rowsBetween(0, Window.unboundedFollowing)))
        # the level if this source is the first that isn't full
        .withColumn("level", (F.col("budget") - F.col("spent")) / F.col("open"))
        # levels rise up to that source and fall after it
        .withColumn("x", F.max(F.when(F.col("level") <= F.col("full_at"), F.col("level"))).over(all_rows))
        .select("source", "source_size", F.least(F.col("cap"), F.coalesce(F.col("x") * F.col("weight"), F.col("cap"))).alias("target"))
    )


def mix(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most_repeats: float = 2.0, seed: str = "mix", keep: Sequence[str] = ()) -> DataFrame:
    """Per row: doc_id, source, size, source_size, target, taken (words the mix takes), and ``keep``.

    Whole epochs take every document; in the last one documents are taken in key order until the
    source's budget of words is spent, the document at the cut up to the cut.
    """
    rows = docs.select(F.col("doc_id"), F.col("source"), n_words(F.col("text")).alias("size"), F.xxhash64("text").alias("tie"), *[F.col(c).alias(f"kept_{c}") for c in keep])
    if not keep:  # the sizes are read twice, the texts once
        rows = Stage(docs.sparkSession, "mix").put("sizes", rows)
    keyed = rows.withColumn("key", F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))))
    keyed = keyed.withColumn("part", F.substring("key", 1, RANGE_DIGITS))
    ranges = keyed.groupBy("source", "part").agg(F.sum("size").alias("range_size"))
    upto = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    targets = source_targets(ranges.groupBy("source").agg(F.sum("range_size").alias("source_size")), weights, share, most_repeats)
    offsets = ranges.withColumn("offset", F.coalesce(F.sum("range_size").over(upto), F.lit(0))).alias("r")
    t = targets.alias("t")
    plan = offsets.join(t, F.col("r.source").eqNullSafe(F.col("t.source"))).select(
        F.col("r.source").alias("p_source"), F.col("r.part").alias("p_part"), "offset", "source_size", "target")
    inside = Window.partitionBy("source", "part").orderBy("key", "doc_id", "size", "tie").rowsBetween(Window.unboundedPreceding, -1)
    placed = keyed.withColumn("before", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    budget = F.floor("target")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0)
    rest = budget - epochs * F.col("source_size")
    last = F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("offset") - F.col("before")))
    return (
        placed.join(plan, F.col("source").eqNullSafe(F.col("p_source")) & (F.col("part") == F.col("p_part")))
        .select("doc_id", "source", "size", "source_size", "target", (epochs * F.col("size") + last).cast("long").alias("taken"), *[F.col(f"kept_{c}").alias(c) for c in keep])
    )


def mixed_rows(docs: DataFrame, **options) -> DataFrame:
    """The mix as documents: one row for each time a document is taken, its text cut where the budget ends."""
    columns = docs.columns
    packed = docs.select("doc_id", "source", "text", F.struct(*[F.col(c) for c in columns]).alias("row_"))
    got = mix(packed, keep=("row_",), **options).filter("taken > 0")
    times = F.ceil(F.col("taken") / F.col("size")).cast("int")
    each = got.withColumn("copy", F.explode(F.sequence(F.lit(1), times))).withColumn("n", F.least(F.col("size"), F.col("taken") - (F.col("copy") - 1) * F.col("size")))
    # the first n words, with the white space between them as it was
    words = F.regexp_extract_all(F.col("row_.text"), F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0))
    head = F.array_join(F.slice(words, 1, F.col("n").cast("int")), "")
    text = F.when(F.col("n") == F.col("size"), F.col("row_.text")).otherwise(head)
    out = [text.alias(c) if c == "text" else F.when(F.col("n") == F.col("size"), F.col("row_.n_chars")).otherwise(F.char_length(text)).alias(c) if c == "n_chars" else F.col(f"row_.{c}").alias(c) for c in columns]
    return each.select(*out)
