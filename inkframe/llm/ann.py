"""Nearest neighbours by additive quantisation.

A vector is coded as the sum of one full-dimensional codeword from each of several codebooks. The
codebooks are fitted to residuals on a bounded sample; encoding keeps the best ``BEAM`` partial
sums at each codebook. With the codes goes each vector's norm over its code's norm, which
corrects the code's length. Directions are coded, so that short, long and very long vectors are coded alike; longer vectors
have more codebooks, up to ``MOST_BOOKS``. A query's products with all codewords are a table; a vector's score is
the sum of its codewords' entries, times the stored ratio. The best ``SHORTLIST`` of each query, and all that come within ``SPREAD`` of
their code's usual error of its k-th, are scored again with the original vectors in double precision. Equal vectors are searched as one.

Vectors are coded where they lie. Codes travel in blocks of ``BLOCK`` rows, queries in as few blocks as
keep all cores busy and hold at most ``QUERY_BLOCK``; each pair of blocks is one task's work and gives a shortlist a
query. A block's codes go once to each block of queries. All rows are candidates of all queries; the sample
only fits the codebooks.

Defined results: vectors that are null, zero, or hold null or non-finite components take no part,
nor do rows without an id; inner products exist between vectors of one length, so a row's neighbours are those of its
length; every row is a candidate and a query of its own, so rows that repeat an id find each other; an empty table gives
an empty result; ties go to the smaller id.

The commonest length, and each with more than ``FEW`` components in all, has codebooks of its own. The vectors of a rarer
length fit in one task, where each is compared with each query: all such lengths are one job.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .staging import Stage

BOOKS, WORDS, BEAM = 24, 256, 4
#: Components that one codebook stands for, at most; and how many codebooks there are at most.
A_BOOK, MOST_BOOKS = 8 / 3, 96
#: Usual errors of a code within which a vector may be among the nearest.
SPREAD = 3.0
SAMPLE = 12_000
SHORTLIST = 200
BLOCK, QUERY_BLOCK = 65_536, 4_096
ROUNDS = 6
#: Components of all vectors of a length that one task compares directly (32 MB).
FEW = 4_000_000
#: What a search returns.
FOUND = "query_id long, rank int, vec_id long, score double"


def usable(vector: Column) -> Column:
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def _nearest(x: np.ndarray, words: np.ndarray) -> np.ndarray:
    return (np.sum(words * words, 1) - 2 * x @ words.T).argmin(1)


def fit(sample: np.ndarray, books: int = BOOKS, words: int = WORDS, rounds: int = ROUNDS, seed: int = 7) -> np.ndarray:
    """books x words x dimensions: each codebook is a k-means of what the ones before leave."""
    rng = np.random.default_rng(seed)
    rest = sample.astype(np.float32)
    out = np.zeros((books, words, sample.shape[1]), np.float32)
    for b in range(books):
        own = rest[rng.choice(len(rest), words, replace=len(rest) < words)].copy()
        for _ in range(rounds):
            near = _nearest(rest, own)
            n = np.bincount(near, minlength=words)
            order = np.argsort(near, kind="stable")
            full = np.flatnonzero(n)
            own[full] = np.add.reduceat(rest[order], np.concatenate(([0], np.cumsum(n[full])[:-1]))) / n[full][:, None]
        out[b] = own
        rest = rest - own[_nearest(rest, own)]
    return out


def encode(x: np.ndarray, books: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
    """(codes, norm of each vector over its code's), by beam search."""
    n, d = x.shape
    m, k, _ = books.shape
    x = x.astype(np.float32)
    rest, codes = x[:, None, :], np.zeros((n, 1, 0), np.uint8)
    for b in range(m):
        width = rest.shape[1]
        word = books[b]
        # the error that a word would leave, up to the beam's own squared length
        error = np.sum(rest * rest, 2)[:, :, None] + np.sum(word * word, 1) - 2 * (rest.reshape(-1, d) @ word.T).reshape(n, width, k)
        error = error.reshape(n, width * k)
        keep = min(beam if b < m - 1 else 1, width * k)
        best = np.argpartition(error, keep - 1, axis=1)[:, :keep] if keep < width * k else np.tile(np.arange(width * k), (n, 1))
        row = np.arange(n)[:, None]
        rest = rest[row, best // k] - word[best % k]
        codes = np.concatenate((codes[row, best // k], (best % k).astype(np.uint8)[:, :, None]), 2)
    code = x - rest[:, 0]
    ratio = np.linalg.norm(x, axis=1) / np.maximum(np.linalg.norm(code, axis=1), 1e-12)
    return codes[:, 0], ratio.astype(np.float32)


def directions(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(vectors of length one, lengths)."""
    top = np.abs(x).max(1, keepdims=True)
    unit = x / top
    norm = np.linalg.norm(unit, axis=1, keepdims=True)
    return unit / norm, (norm * top)[:, 0]


def errors(unit: np.ndarray, codes: np.ndarray, books: np.ndarray) -> np.ndarray:
    """How far each vector of length one is from its code's direction."""
    code = np.zeros(unit.shape, np.float32)
    for b in range(codes.shape[1]):
        code += books[b][codes[:, b]]
    code /= np.maximum(np.linalg.norm(code, axis=1, keepdims=True), 1e-12)
    return np.linalg.norm(unit - code, axis=1).astype(np.float32)


def promising(s: np.ndarray, wide: np.ndarray, k: int, shortlist: int) -> tuple[np.ndarray, np.ndarray]:
    """(query, vector) places of the ``shortlist`` best scores of each query and of those that ``wide`` may lift to its k-th."""
    n = s.shape[1]
    least = np.partition(s, n - min(shortlist, n), axis=1)[:, n - min(shortlist, n), None]
    kth = np.partition(s, n - min(k, n), axis=1)[:, n - min(k, n), None]
    return np.nonzero((s >= least) | (s + wide >= kth))


def scores(tables: np.ndarray, codes: np.ndarray, ratio: np.ndarray) -> np.ndarray:
    """queries x vectors: sums of table entries. ``tables``: queries x books x words."""
    out = np.take(tables[:, 0], codes[:, 0], axis=1)
    for b in range(1, codes.shape[1]):
        out += np.take(tables[:, b], codes[:, b], axis=1)
    return out * ratio


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    flat = (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).flatten()
    return flat.to_numpy(zero_copy_only=False).reshape(-1, d)


def search(vectors: DataFrame, is_query: Column, k: int = 20, shortlist: int = SHORTLIST, block: int = BLOCK, query_block: int = QUERY_BLOCK, few: int = FEW) -> DataFrame:
    """(query_id, rank, vec_id, score) for the rows (vec_id, embedding) that ``is_query`` picks."""
    spark = vectors.sparkSession
    stage = Stage(spark, "ann")
    good = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v")).filter(F.col("vec_id").isNotNull() & usable(F.col("v")))
    every = stage.put("vectors", good.withColumn("row", F.monotonically_increasing_id()))
    lengths = every.groupBy(F.size("v").alias("d")).count()
    common = lengths.orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    if not common:
        return spark.createDataFrame([], FOUND)
    d = common[0]["d"]
    many = common + lengths.filter((F.col("d") != d) & (F.col("d") * F.col("count") > few)).collect()  # one row for each FEW components of the table at most
    found = [_coded(stage, every.filter(F.size("v") == n["d"]), n["d"], n["count"], is_query, k, shortlist, block, query_block) for n in many]
    rest = every.filter(~F.size("v").isin([n["d"] for n in many]))
    if not rest.isEmpty():
        found.append(_compared(rest.select("row", "vec_id", "v", F.coalesce(is_query, F.lit(False)).alias("asks")), k))
    return functools.reduce(DataFrame.unionByName, found)


def _compared(rows: DataFrame, k: int) -> DataFrame:
    """The ``k`` nearest of each row that asks, by products with all rows of its length."""

    def nearest(of: pa.Table) -> pa.Table:
        v, row, ids = _matrix(of.column("v"), len(of.column("v")[0])), of.column("row").to_numpy(), of.column("vec_id").to_numpy()
        got: list[tuple] = []
        for i in np.flatnonzero(of.column("asks").to_numpy(zero_copy_only=False)):
            score = np.sum(v * v[i], axis=1)
            order = np.lexsort((row, ids, -score))
            best = order[order != i][:k]
            got.append((np.full(len(best), ids[i]), np.arange(1, len(best) + 1), ids[best], score[best]))
        cols = [np.concatenate(c) for c in zip(*got)] if got else [np.empty(0)] * 4
        types = (pa.int64(), pa.int32(), pa.int64(), pa.float64())
        return pa.table({c: pa.array(x.astype(t.to_pandas_dtype()), t) for c, x, t in zip(("query_id", "rank", "vec_id", "score"), cols, types)})

    return rows.groupBy(F.size("v").alias("d")).applyInArrow(nearest, FOUND)


def _coded(stage: Stage, base: DataFrame, d: int, n_rows: int, is_query: Column, k: int, shortlist: int, block: int, query_block: int) -> DataFrame:
    """The search among the rows (row, vec_id, v) of length ``d`` by their codes."""
    spark = base.sparkSession
    # of equal vectors k + 1 rows are enough, and the first one stands for them in the search
    copies = Window.partitionBy("v").orderBy("vec_id", "row")
    members = base.withColumn("copy", F.row_number().over(copies)).filter(F.col("copy") <= k + 1).withColumn("leader", F.first("row").over(copies))
    members = stage.put(f"members_{d}", members.select("leader", "copy", "row", "vec_id", F.when(F.col("copy") == 1, F.col("v")).alias("v")))
    single = members.filter("copy = 1").select("row", "vec_id", "v")
    sample = single.orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(SAMPLE).select("v").collect()  # SAMPLE rows at most
    books = fit(directions(np.array([r.v for r in sample]))[0], books=min(MOST_BOOKS, max(BOOKS, round(d / A_BOOK))))
    sent = spark.sparkContext.broadcast(books)  # MOST_BOOKS * WORDS vectors at most
    longest = float(single.agg(F.max(F.array_max(F.transform("v", F.abs)))).first()[0])  # one number
    n_blocks = max(1, -(-n_rows // block))

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = b.column("row").to_numpy()
            for lo in range(0, len(rows), 1024):
                unit, norm = directions(_matrix(b.column("v").slice(lo, 1024), d) / longest)
                codes, ratio = encode(unit, sent.value)
                off = errors(unit, codes, sent.value) * norm
                yield pa.RecordBatch.from_arrays([pa.array(rows[lo : lo + 1024]), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array((ratio * norm).astype(np.float32)), pa.array(off.astype(np.float32))], ["row", "code", "ratio", "off"])

    codes = single.mapInArrow(coded, "row long, code binary, ratio float, off float").withColumn("block", F.pmod(F.xxhash64("row"), F.lit(n_blocks)).cast("int"))
    codes = stage.put(f"codes_{d}", codes)
    queries = stage.put(f"queries_{d}", base.filter(is_query).select(F.col("row").alias("query"), F.col("vec_id").alias("query_id"), "v"))
    n_query_blocks = max(1, -(-queries.count() // query_block), -(-2 * spark.sparkContext.defaultParallelism // n_blocks))
    asked = queries.withColumn("query_block", F.pmod(F.xxhash64("query"), F.lit(n_query_blocks)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))
    # a block's codes as one row, so that sending it to each query block is one row each
    packed = codes.groupBy("block").agg(F.collect_list(F.struct("row", "code", "ratio", "off")).alias("of"))
    packed = packed.withColumn("query_block", F.explode(F.sequence(F.lit(0), F.lit(n_query_blocks - 1))))
    m = len(books)

    def matched(_, left: pa.Table, right: pa.Table) -> pa.Table:
        got: list[tuple] = []
        if left.num_rows and right.num_rows:
            rows = right.column("of").combine_chunks().flatten()
            row = rows.field("row").to_numpy()
            code = np.frombuffer(b"".join(rows.field("code").to_pylist()), np.uint8).reshape(-1, m)
            ratio, off = rows.field("ratio").to_numpy(), rows.field("off").to_numpy()
            asker, vectors = left.column("query").to_numpy(), directions(_matrix(left.column("v"), d))[0].astype(np.float32)
            wide = off * np.float32(SPREAD / np.sqrt(d))
            for lo in range(0, len(asker), 32):
                table = np.einsum("qd,mwd->qmw", vectors[lo : lo + 32], sent.value, optimize=True)
                s = scores(table, code, ratio)
                q, near = promising(s, wide, k + 1, shortlist + 1)
                got.append((asker[lo + q], row[near], s[q, near], wide[near]))
        cols = [np.concatenate(c) for c in zip(*got)] if got else [np.empty(0, np.int64)] * 2 + [np.empty(0, np.float32)] * 2
        return pa.table({**{c: pa.array(v, pa.int64()) for c, v in zip(("query", "row"), cols)}, **{c: pa.array(v, pa.float32()) for c, v in zip(("about", "wide"), cols[2:])}})

    near = asked.groupBy("query_block", "block").cogroup(packed.groupBy("query_block", "block")).applyInArrow(matched, "query long, row long, about float, wide float")
    of_query = Window.partitionBy("query")
    near = near.withColumn("n", F.row_number().over(of_query.orderBy(F.desc("about"), "row")))
    near = near.withColumn("kth", F.min(F.when(F.col("n") <= k + 1, F.col("about"))).over(of_query)).filter((F.col("n") <= shortlist + 1) | (F.col("about") + F.col("wide") >= F.col("kth"))).select("query", "row")
    both = near.join(single.withColumnRenamed("v", "w"), "row").join(queries, "query")

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v, w = _matrix(b.column("v"), d), _matrix(b.column("w"), d)
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in ("query", "query_id", "row", "vec_id")], pa.array(np.sum(v * w, axis=1))], ["query", "query_id", "row", "vec_id", "score"])

    scored = both.select("query", "query_id", "row", "vec_id", "v", "w").mapInArrow(exact, "query long, query_id long, row long, vec_id long, score double")
    best = of_query.orderBy(F.desc("score"), "vec_id", "row")
    # k + 1 vectors, as the query's own row may be the only one of its vector
    leading = scored.withColumn("n", F.row_number().over(best)).filter(F.col("n") <= k + 1).select("query", "query_id", F.col("row").alias("leader"), "score")
    found = leading.join(members.select("leader", "row", "vec_id"), "leader").filter("row <> query")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
