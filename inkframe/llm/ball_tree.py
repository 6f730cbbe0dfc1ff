"""Centroid clustering with ball-tree filtering.

Vectors become integer grids (floor of ``SCALE`` times a component), and each task builds metric trees over the rows it reads, ``SHARD`` rows a
tree. A node stores its rows' count, their integer sum, a centre and the radius around it. In a round a tree gives its rows to the centroids from the root
down: a centroid that is farther from a node's centre than the nearest one by more than two radii is nearest to none of the
node's rows (triangle inequality). Where one centroid is left, the whole ball is its, with the stored count and sum; else the
children look at the centroids that are left, and leaves compare every row. Distances are exact integers; the bound on roots has a margin far above
their rounding, so results are those of comparing every row with every centroid.

Trees are one staged table. A round sends the centroids out and brings back one row a centroid; trees of one task are summed in the
task, tasks by Spark. Nothing else passes the driver.

Defined results: vectors that are null, or of another length than ``DIMENSIONS``, or hold null or non-finite components take no part; repeated
rows and rows without an id take part as rows of their own, those without an id are starting centroids only where others are too few;
fewer rows than centroids give fewer centroids; ties go to the smaller number; an empty table gives an empty result. A scaled component beyond 64 bits counts as the
nearest 64-bit integer; distances are exact whatever their size, and where one, or a sum of them, is beyond 64 bits the largest 64-bit integer
is returned. Other columns are not read.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .staging import Stage

DIMENSIONS, SCALE = 64, 1024
CENTROIDS, ROUNDS, SEED = 8, 10, 3
#: Rows of a tree and of a leaf.
SHARD, LEAF = 8_192, 24
#: Components below it have distances and sums of a tree below 2 ** 62; trees with larger ones compute with unbounded integers.
SMALL = 1 << 26
LARGEST = (1 << 63) - 1
#: What a comparison of roots allows for their rounding, relative.
MARGIN = 1e-9
TREE = "ids binary, points binary, nodes binary, sums binary, small boolean"


def grids(embeddings: DataFrame, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """(id, q): the rows that take part, as integers."""
    v = F.transform(F.col(vector), lambda x: x.cast("double"))
    fits = (F.size(vector) == DIMENSIONS) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    scaled = lambda x: F.floor(F.least(F.lit(2.0**63), F.greatest(F.lit(-(2.0**63)), x * SCALE))).cast("long")  # noqa: E731  # the cast saturates
    return embeddings.filter(F.coalesce(fits, F.lit(False))).select(F.col(key).cast("long").alias("id"), F.transform(v, scaled).alias("q"))


def starts(points: DataFrame, k: int = CENTROIDS, seed: int = SEED) -> list[list[int]]:
    """The rows with the smallest hashes of seed and id; ids that repeat are ordered by their vectors."""
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    return [r.q for r in points.withColumn("h", h).orderBy(F.asc_nulls_last("h"), "q").limit(k).select("q").collect()]


# --- one tree

def grown(ids: np.ndarray, valid: np.ndarray, q: np.ndarray) -> dict:
    """A tree as columns: rows in tree order, nodes (start, end, left, right) with the root first, the radius, sums."""
    small = bool(np.all((q > -SMALL) & (q < SMALL)))
    order, nodes, centres, radii = np.arange(len(q)), [], [], []
    p = q if small else q.astype(object)
    todo = [(0, len(q), -1)]
    while todo:
        lo, hi, parent = todo.pop()
        me = len(nodes)
        nodes.append([lo, hi, 0])
        if parent >= 0:
            nodes[parent][2] = me  # the second child; the first follows its parent
        own = order[lo:hi]
        total = p[own].sum(0)
        centre = total // (hi - lo)
        away = _square(p[own] - centre)
        centres.append(total)
        radius = float(max(away)) ** 0.5
        radii.append(radius)
        if small and hi - lo > LEAF and radius > 0:
            # two far rows, each row to the nearer one
            a = own[int(np.argmax(away))]
            from_a = _square(p[own] - p[a])
            from_b = _square(p[own] - p[own[int(np.argmax(from_a))]])
            left = from_a < from_b
            order[lo:hi] = np.concatenate((own[left], own[~left]))
            cut = lo + int(left.sum())
            todo += [(cut, hi, me), (lo, cut, -1)]
    # a node's first child is the next node; order of visit is depth first, so children of me are me + 1 and nodes[me][2]
    return {"ids": ids[order], "valid": valid[order], "q": q[order], "nodes": np.array(nodes, np.int64), "sums": centres, "radius": np.array(radii), "small": small}


def _square(d: np.ndarray) -> np.ndarray:
    return (d * d).sum(-1)


def _nearest(p: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row the nearest centroid, the first of equals, and the squared distance."""
    d = np.stack([_square(p - x) for x in c], 1)
    k = d.argmin(1)
    return k, d[np.arange(len(p)), k]


def assigned(tree: dict, centroids: np.ndarray) -> Iterator[tuple[int, np.ndarray | None, int | np.ndarray]]:
    """Balls (node, None, centroid) that are whole one centroid's, and leaves (node, rows' centroids, squared distances)."""
    nodes, small = tree["nodes"], tree["small"] and bool(np.all(np.abs(centroids) < SMALL))
    p, c = (tree["q"], centroids.astype(np.int64)) if small else (tree["q"].astype(object), centroids)
    if not small:
        yield (0, *_nearest(p, c))
        return
    size = nodes[:, 1] - nodes[:, 0]
    centre = tree["sums"] // size[:, None]
    level, open_ = np.zeros(1, np.int64), np.ones((1, len(c)), bool)
    while len(level):
        d = np.sqrt(np.stack([_square(centre[level] - x) for x in c], 1).astype(np.float64))
        d[~open_] = np.inf
        best = d.argmin(1)
        reach = d[np.arange(len(level)), best] + 2 * tree["radius"][level]
        left = open_ & (d <= (reach * (1 + MARGIN))[:, None])
        whole = left.sum(1) == 1
        for n, k in zip(level[whole].tolist(), best[whole].tolist()):
            yield n, None, k
        level, left = level[~whole], left[~whole]
        inner = nodes[level, 2] > 0
        for n, some in zip(level[~inner].tolist(), left[~inner]):
            which = np.flatnonzero(some)
            k, far = _nearest(p[nodes[n, 0] : nodes[n, 1]], c[which])
            yield n, which[k], far
        level, left = level[inner], left[inner]
        level, open_ = np.concatenate((level + 1, nodes[level, 2])), np.concatenate((left, left))


# --- trees as rows

def planted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (id, q) to rows of TREE."""
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def row() -> pa.RecordBatch:
        t = grown(*(np.concatenate(x) for x in zip(*held)))
        sums = np.array(t["sums"], np.int64).tobytes() if t["small"] else b""
        cells = [np.stack((t["ids"], t["valid"].astype(np.int64))).tobytes(), t["q"].tobytes(), np.concatenate((t["nodes"].T.ravel(), t["radius"].view(np.int64))).tobytes(), sums]
        held.clear()
        return pa.RecordBatch.from_arrays([*[pa.array([x], pa.binary()) for x in cells], pa.array([t["small"]])], ["ids", "points", "nodes", "sums", "small"])

    n = 0
    for b in batches:
        ids, q = b.column("id"), b.column("q").flatten().to_numpy(zero_copy_only=False).reshape(-1, DIMENSIONS)
        values, valid = ids.fill_null(0).to_numpy(zero_copy_only=False), ids.is_valid().to_numpy(zero_copy_only=False)
        for lo in range(0, len(q), SHARD):
            part = slice(lo, lo + SHARD)
            if n + len(q[part]) > SHARD and held:
                yield row()
                n = 0
            held.append((values[part], valid[part], q[part]))
            n += len(q[part])
    if held:
        yield row()


def _trees(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    whole = lambda v, *shape: np.frombuffer(v, np.int64).reshape(shape)
    for b in batches:
        for r in b.to_pylist():
            ids, nodes = whole(r["ids"], 2, -1), whole(r["nodes"], 4, -1)
            yield {"ids": ids[0], "valid": ids[1] > 0, "q": whole(r["points"], -1, DIMENSIONS), "nodes": nodes[:3].T, "radius": nodes[3].view(np.float64), "sums": whole(r["sums"], -1, DIMENSIONS), "small": r["small"]}


def _gathered(centroids: np.ndarray, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's (cluster, n, sums): counts and component sums, exact, as text where they may pass 64 bits."""
    n, total = [0] * len(centroids), np.zeros((len(centroids), DIMENSIONS), object)
    for t in _trees(batches):
        for node, which, k in assigned(t, centroids):
            lo, hi = t["nodes"][node, :2].tolist()
            if which is None:
                n[k] += hi - lo
                total[k] += t["sums"][node].astype(object)
                continue
            rows = t["q"][lo:hi] if t["small"] else t["q"][lo:hi].astype(object)
            for c in np.unique(which).tolist():
                own = rows[which == c]
                n[c] += len(own)
                total[c] += own.sum(0).astype(object)
    used = [c for c in range(len(n)) if n[c]]
    yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array([n[c] for c in used], pa.int64()), pa.array([[str(x) for x in total[c]] for c in used], pa.list_(pa.string()))], ["cluster", "n", "sums"])


def _placed(centroids: np.ndarray, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each row with its centroid and squared distance."""
    for t in _trees(batches):
        cluster, far = np.zeros(len(t["q"]), np.int32), np.zeros(len(t["q"]), np.int64)
        for node, which, found in assigned(t, centroids):
            own = slice(*t["nodes"][node, :2].tolist())
            if which is None:  # a ball is given away in trees of small numbers only
                which, found = found, _square(t["q"][own] - centroids[found].astype(np.int64))
            cluster[own], far[own] = which, np.minimum(found, LARGEST)
        yield pa.RecordBatch.from_arrays([pa.array(t["ids"], pa.int64(), mask=~t["valid"]), pa.array(cluster), pa.array(far)], ["id", "cluster", "far"])


def cluster(embeddings: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, seed: int = SEED) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of each row that takes part."""
    stage = Stage(embeddings.sparkSession, "ball-tree")
    points = grids(embeddings)
    trees = stage.put("trees", points.mapInArrow(planted, TREE))
    now = [[int(x) for x in c] for c in starts(points, k, seed)]
    for _ in range(rounds if now else 0):
        sent = np.array(now, object)
        parts = trees.mapInArrow(functools.partial(_gathered, sent), "cluster int, n long, sums array<string>")
        # sums of longs stay below decimal(38): 10 ** 19 rows of 10 ** 19 each
        exact = [F.sum(F.col("sums")[i].cast("decimal(38,0)")).cast("string").alias(f"s{i}") for i in range(DIMENSIONS)]
        for r in parts.groupBy("cluster").agg(F.sum("n").alias("n"), *exact).collect():  # one row a centroid
            now[r.cluster] = [int(r[f"s{i}"]) // r.n for i in range(DIMENSIONS)]
    placed = stage.put("placed", trees.mapInArrow(functools.partial(_placed, np.array(now, object)), "id long, cluster int, far long"))
    stage.drop("trees")
    sums = {r.cluster: int(r.own) for r in placed.groupBy("cluster").agg(F.sum(F.col("far").cast("decimal(38,0)")).alias("own")).collect()}  # one row a centroid
    total = min(LARGEST, sum(sums.values()))
    digest = {c: hashlib.sha256(",".join(map(str, now[c])).encode()).hexdigest() for c in sums}
    of = lambda values, kind: F.element_at(F.create_map(*[F.lit(x) for c, v in values.items() for x in (c, v)]), F.col("cluster")).cast(kind) if values else F.lit(None).cast(kind)
    own = of({c: min(LARGEST, v) for c, v in sums.items()}, "long")
    return placed.select(F.col("id").alias("vec_id"), "cluster", F.col("far").alias("distance"), own.alias("cluster_inertia"), F.lit(total).cast("long").alias("inertia"), of(digest, "string").alias("centroid_sha256"))
