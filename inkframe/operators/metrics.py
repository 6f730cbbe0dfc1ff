"""Classifier scores and quality: softmax, top-k, confusion, per-class and macro metrics, hard examples."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.labels import literal_map
from ..sources.derived import vocabulary_at

# Weights of the priority score and what a class is confused with.
PRIORITY = {"target_f1": 0.40, "target_recall": 0.15, "boundary_f1": 0.20, "boundary_recall": 0.10, "accuracy": 0.15}
PARTNERS = {"*": "+4", "/": "1()", "1": "/()7", "(": "/1", ")": "/1"}
# Fixed values of training: classes that matter most, bounds of sure and clear rows, limits and repeats by class, weights.
TARGETS, BOUNDARY = ("*", "/"), ("1", "(", ")")
SURE, CLEAR = 0.992, 0.040
HARD_LIMITS = {"*": 512, "/": 2048, "1": 1536, "(": 1024, ")": 1024}
HARD_FILL = {"*": 256}
BASE_WEIGHTS = {"*": 1.6, "/": 1.8, "1": 1.15, "(": 1.1, ")": 1.1}
FEEDBACK_WEIGHT = (2.5, 1.25)
TARGET_REPEATS = {"*": 1, "/": 0}
FEEDBACK_REPEATS = {"*": 24, "/": 24}
HARD_REPEATS = {"*": 2, "/": 2, "1": 1, "(": 1, ")": 1}
HARD_WEIGHT = 1.20
ACCURACY_LOSS = 0.0025


def softmax(logits: Column) -> Column:
    top = F.array_max(logits)
    e = F.transform(logits, lambda v: F.exp(v - top))
    total = F.aggregate(e, F.lit(0.0), lambda a, v: a + v)
    return F.transform(e, lambda v: v / total)


def argmax(values: Column) -> Column:
    """Index of the largest value, the first of equals."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def top_k(values: Column, k: int) -> Column:
    """The k largest as (value, idx), largest first, ties to the larger index."""
    pairs = F.transform(values, lambda v, i: F.struct(v.alias("value"), i.alias("idx")))
    return F.slice(F.sort_array(pairs, asc=False), 1, k)


def topk_rows(scores: DataFrame, k: int = 5) -> DataFrame:
    p = scores.select("vec_id", F.posexplode(top_k(softmax(F.col("logits")), k)).alias("place", "of"))
    return p.select("vec_id", (F.col("place") + 1).alias("rank"), vocabulary_at(F.col("of.idx")).alias("char"), F.bround("of.value", 6).alias("conf"))


def predicted(scores: DataFrame) -> DataFrame:
    """(vec_id, truth, pred, conf, margin)."""
    p = scores.withColumn("p", softmax(F.col("logits")))
    s = F.sort_array("p", asc=False)
    return p.select("vec_id", F.col("label").alias("truth"), argmax(F.col("logits")).alias("pred"), s[0].alias("conf"), (s[0] - s[1]).alias("margin"))


def confusion(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("truth", "pred").agg(F.count("*").alias("n"))


def confusion_wide(pairs: DataFrame, labels: Sequence[int]) -> DataFrame:
    wide = pairs.groupBy("truth").pivot("pred", list(labels)).count()
    return wide.select("truth", *[F.coalesce(F.col(str(k)), F.lit(0)).alias(f"pred_{k}") for k in labels])


def per_class(pairs: DataFrame) -> DataFrame:
    """(label, precision, recall, f1, support); nothing to divide by gives 0."""
    n = confusion(pairs)
    sides = n.select(F.explode(F.array(
        F.struct(F.col("truth").alias("label"), F.col("n").alias("support"), F.lit(0).cast("long").alias("said"), F.when(F.col("truth") == F.col("pred"), F.col("n")).otherwise(0).alias("hit")),
        F.struct(F.col("pred").alias("label"), F.lit(0).cast("long").alias("support"), F.col("n").alias("said"), F.lit(0).cast("long").alias("hit")))).alias("s")).select("s.*")
    g = sides.groupBy("label").agg(F.sum("support").alias("support"), F.sum("said").alias("said"), F.sum("hit").alias("hit"))
    p, r = F.coalesce(F.try_divide("hit", "said"), F.lit(0.0)), F.coalesce(F.try_divide("hit", "support"), F.lit(0.0))
    g = g.withColumns({"precision": p, "recall": r})
    return g.withColumn("f1", F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0))).select("label", "precision", "recall", "f1", "support")


def averages(pairs: DataFrame) -> DataFrame:
    """One row: accuracy, macro, support-weighted and micro precision, recall and F1.

    With one label a row, what all classes miss together is what all wrongly get, so micro averages are the accuracy."""
    accuracy = F.sum(F.col("recall") * F.col("support")) / F.sum("support")
    return per_class(pairs).agg(
        *[F.avg(c).alias(f"macro_{c}") for c in ("precision", "recall", "f1")],
        *[(F.sum(F.col(c) * F.col("support")) / F.sum("support")).alias(f"weighted_{c}") for c in ("precision", "recall", "f1")],
        *[accuracy.alias(f"micro_{c}") for c in ("precision", "recall", "f1")], accuracy.alias("accuracy"))


def label_vector(scores: Column) -> Column:
    """A row's label: its one value, or the index of the largest of several."""
    return F.when(F.size(scores) == 1, scores[0].cast("long")).when(F.size(scores) > 1, argmax(scores).cast("long"))


def labels_of(pairs: DataFrame) -> DataFrame:
    """All labels that occur as truth or prediction."""
    return pairs.select(F.explode(F.array("truth", "pred")).alias("label")).distinct()


def subset_macro(pairs: DataFrame, groups: dict[str, Sequence[int]]) -> DataFrame:
    """(name, macro_f1, macro_recall) over the labels of each group that occur; 0 if none do."""
    rows = per_class(pairs)
    parts = [rows.filter(F.col("label").isin(*own)).agg(F.coalesce(F.avg("f1"), F.lit(0.0)).alias("macro_f1"), F.coalesce(F.avg("recall"), F.lit(0.0)).alias("macro_recall")).select(F.lit(name).alias("name"), "*") for name, own in groups.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def priority(target_f1, target_recall, boundary_f1, boundary_recall, accuracy):
    """The score that decides between models; works on numbers and columns."""
    w = PRIORITY
    return w["target_f1"] * target_f1 + w["target_recall"] * target_recall + w["boundary_f1"] * boundary_f1 + w["boundary_recall"] * boundary_recall + w["accuracy"] * accuracy


def priority_row(pairs: DataFrame, target: Sequence[int], boundary: Sequence[int]) -> DataFrame:
    s = subset_macro(pairs, {"target": target, "boundary": boundary})
    pick = lambda name, c: F.max(F.when(F.col("name") == name, F.col(c)))
    one = s.agg(pick("target", "macro_f1").alias("tf"), pick("target", "macro_recall").alias("tr"), pick("boundary", "macro_f1").alias("bf"), pick("boundary", "macro_recall").alias("br"))
    return one.crossJoin(pairs.agg(F.avg((F.col("truth") == F.col("pred")).cast("double")).alias("acc"))).select(
        F.col("tf").alias("target_f1"), F.col("bf").alias("boundary_f1"), F.col("acc").alias("accuracy"), priority(F.col("tf"), F.col("tr"), F.col("bf"), F.col("br"), F.col("acc")).alias("priority"))


def _of(values: dict, key: Column, default) -> Column:
    return F.coalesce(F.try_element_at(literal_map(values), key), F.lit(default))


def hardness(scored: DataFrame) -> Column:
    """How nearly or quite wrong a row (truth, pred, conf, margin; names of classes) is: more where a partner was said."""
    wrong = F.col("truth") != F.col("pred")
    partner = F.coalesce(F.array_contains(F.try_element_at(F.create_map(*[x for k, v in PARTNERS.items() for x in (F.lit(k), F.array(*[F.lit(c) for c in v]))]), F.col("truth")), F.col("pred")), F.lit(False))
    unsure = F.greatest(F.lit(0.0), SURE - F.col("conf")) * 8.0 + F.greatest(F.lit(0.0), CLEAR - F.col("margin")) * 10.0
    return unsure + F.when(wrong, F.when(partner, 1.75).otherwise(1.0)).otherwise(0.0)


def hard_examples(scored: DataFrame, limits: dict[str, int] = HARD_LIMITS, fill: dict[str, int] = HARD_FILL) -> DataFrame:
    """Of each class in ``limits`` its hardest rows; a class in ``fill`` with fewer gets its least sure ones too.

    scored: (truth, pred, vec_id, conf, margin), truth and pred names of classes. Returns (truth, vec_id, hardness, filled)."""
    own = scored.filter(F.col("truth").isin(*limits)).withColumn("hardness", F.bround(hardness(scored), 9))
    by_class = Window.partitionBy("truth")
    rank = F.row_number().over(by_class.orderBy(F.desc("hardness"), "vec_id"))
    picked = own.withColumn("rank", rank).withColumn("hard", (F.col("hardness") > 0) & (F.col("rank") <= _of(limits, F.col("truth"), 0)))
    missing = _of(fill, F.col("truth"), 0) - F.count_if(F.col("hard")).over(by_class)
    least = F.row_number().over(Window.partitionBy("truth", "hard").orderBy("conf", "margin", "vec_id"))
    return picked.withColumns({"missing": missing, "least": least}).filter(F.col("hard") | (F.col("least") <= F.col("missing"))).select("truth", "vec_id", "hardness", (~F.col("hard")).alias("filled"))


def sample_weights(label: Column, feedback: bool = False) -> Column:
    """A training row's weight by its class; corrected rows count more, those of target classes most."""
    return F.when(label.isin(*TARGETS), FEEDBACK_WEIGHT[0]).otherwise(FEEDBACK_WEIGHT[1]) if feedback else _of(BASE_WEIGHTS, label, 1.0)


def repeated(rows: DataFrame, repeats: dict[str, int]) -> DataFrame:
    """``rows`` (label, ...) as often as their class asks, with copy."""
    n = _of(repeats, F.col("label"), 0)
    return rows.filter(n > 0).withColumn("copy", F.explode(F.sequence(F.lit(1), n)))


def training_rows(base: DataFrame, corrected: DataFrame, hard: DataFrame, seed: str = "42") -> DataFrame:
    """(part, id, label, copy, weight, place): the six parts of a training set, in an order that the seed decides.

    Inputs: (id, label). Rows are placed by a hash of seed, part, id and copy; the hash's leading digits are ranges
    of the order, so that places are sums over ranges and no task sorts more than one range."""
    once = lambda d: d.withColumn("copy", F.lit(1))
    parts = [
        ("base", once(base), sample_weights(F.col("label"))), ("target", repeated(base, TARGET_REPEATS), sample_weights(F.col("label"))),
        ("feedback", once(corrected), sample_weights(F.col("label"), True)), ("feedback_more", repeated(corrected, FEEDBACK_REPEATS), sample_weights(F.col("label"), True)),
        ("hard", once(hard), sample_weights(F.col("label")) * HARD_WEIGHT), ("hard_more", repeated(hard, HARD_REPEATS), sample_weights(F.col("label")) * HARD_WEIGHT),
    ]
    every = reduce(DataFrame.unionByName, [d.select(F.lit(name).alias("part"), F.col("id").cast("long").alias("id"), "label", "copy", weight.cast("double").alias("weight")) for name, d, weight in parts])
    return placed_by_hash(every, ["part", "id", "copy"], seed)


def placed_by_hash(rows: DataFrame, key: Sequence[str], seed: str, digits: int = 4) -> DataFrame:
    """``rows`` with place, counted from 0 in the order of a hash of the seed and the key.

    The hash's first ``digits`` make ranges: 65,536 by four, of 15 million rows each where there are a trillion. One task adds up the ranges' sizes."""
    keyed = rows.withColumn("key_", F.md5(F.concat_ws(":", F.lit(seed), *[F.col(c).cast("string") for c in key]))).withColumn("range_", F.substring("key_", 1, digits))
    sizes = keyed.groupBy("range_").agg(F.count("*").alias("n_"))
    before = sizes.withColumn("before_", F.coalesce(F.sum("n_").over(Window.orderBy("range_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n_")
    inside = F.row_number().over(Window.partitionBy("range_").orderBy("key_", *key))
    return keyed.withColumn("at_", inside).join(before, "range_").withColumn("place", (F.col("before_") + F.col("at_") - 1).cast("long")).drop("key_", "range_", "at_", "before_")


def split_rows(rows: DataFrame, key: Sequence[str], seed: str = "42", share: float = 0.1) -> DataFrame:
    """``rows`` with split: the first ``share`` of them in the seed's order, rounded down, is for validation."""
    n = F.floor(rows.count() * F.lit(share))
    return placed_by_hash(rows, key, seed).withColumn("split", F.when(F.col("place") < n, "val").otherwise("train"))


def promotes(base_priority: Column, base_accuracy: Column, priority_: Column, accuracy: Column) -> Column:
    """Whether a candidate model takes the place of another."""
    return (priority_ > base_priority + 1e-6) & (accuracy >= base_accuracy - ACCURACY_LOSS)


def label_rollup(rows: DataFrame) -> DataFrame:
    return rows.rollup("action", "label_idx").agg(F.count("*").alias("n"))


def running_best(log: DataFrame) -> DataFrame:
    """(step, value, best, is_best): the steps that beat all before them by more than a rounding error."""
    before = F.max("value").over(Window.partitionBy("series").orderBy("step").rowsBetween(Window.unboundedPreceding, -1))
    return log.withColumn("best", F.greatest(F.col("value"), F.coalesce(before, F.col("value")))).withColumn("is_best", F.coalesce(F.col("value") > before + 1e-6, F.lit(True)))
