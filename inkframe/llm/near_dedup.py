"""Near-duplicate classes by ProbMinHash over weighted five-word shingles.

A document's shingles are weighted by how often they occur. Each shingle sends points of a
Poisson process of its weight's rate to the signature's components; a component keeps the shingle
whose point arrives first. The processes stop as soon as no later point can win. Two signatures
agree in a component with the probability Jaccard similarity of the documents.

Equal texts are one document from the start. Signatures are cut into bands; documents that share
a band are candidates. Star links to one member of each band bucket are verified first, on the
whole texts, by the exact probability Jaccard similarity; what they join is one component. Bucket
members of different components are then compared by their signatures, in blocks inside the tasks,
and only those that may reach the threshold become rows to be read in full, each pair once. So a
group of near copies costs rows in proportion to its links, and no link between components is lost.

Words are lower-cased runs of letters, digits and non-ASCII characters. A text of fewer than five
words is one shingle of all its words.

Defined results: a null text is a class of its own; texts without words join only texts equal to
them; rows belong together by their texts alone, so rows that share a doc_id, or have none, are classed like
others; repeated rows are one member each; the class id is the smallest doc_id in the class, null if no member has
one; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import Words, mixed, rolling, runs, steps
from .components import components
from .staging import Stage

SHINGLE = 5
THRESHOLD = 0.8
#: 32 bands of 6 components: a pair of similarity 0.8 shares a band with probability 0.99994.
BANDS, ROWS = 32, 6
#: Components of a signature: the bands' and more, for the estimate alone.
COMPONENTS = 768
#: Pairs whose signatures estimate less than the threshold by this many standard errors aren't read in full.
ERRORS = 4.0
#: Members of a bucket that one task compares with as many others.
BLOCK = 4096

_SPLIT = np.frombuffer(bytes(b if chr(b).isalnum() or b > 127 else 32 for b in range(256)), np.uint8)


def shingles(texts: list[str | None], size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, 44-bit hash, count) of all distinct shingles, ordered by document and hash; up to 2 ** 20 texts."""
    low = [(t or "").lower().encode("utf-8", "surrogatepass").translate(_SPLIT.tobytes()).decode("utf-8", "surrogatepass") for t in texts]
    words = Words(low)
    h = words.hashes()
    n = np.diff(words.first)
    windows = rolling(h, size)
    at = np.arange(len(windows))
    at = at[words.doc[at] == words.doc[at + size - 1]] if len(at) else at
    doc, value = words.doc[at], windows[at]
    short = np.flatnonzero((n > 0) & (n < size))
    if len(short):
        sums = np.array([np.sum(h[a : a + k] * (2 * np.arange(k) + 1).astype(np.uint64)) for a, k in zip(words.first[short], n[short])], np.uint64)
        doc, value = np.concatenate([doc, short]), np.concatenate([value, mixed(sums)])
    # one sort of 20 bits of document and 44 of hash
    both = (doc.astype(np.uint64) << np.uint64(44)) | (value >> np.uint64(20))
    both.sort()
    start, end = runs(both)
    both = both[start]
    return (both >> np.uint64(44)).astype(np.int64), both & np.uint64((1 << 44) - 1), end - start


def uniform(h: np.ndarray) -> np.ndarray:
    return ((h >> np.uint64(11)).astype(np.float64) + 0.5) * (1.0 / (1 << 53))


def signatures(doc: np.ndarray, value: np.ndarray, weight: np.ndarray, n_docs: int, m: int) -> np.ndarray:
    """n_docs x m shingle hashes: in each component the shingle that arrives first; 0 where a document has none."""
    first = np.full(n_docs * m, np.inf)
    winner = np.zeros(n_docs * m, np.uint64)
    time = np.zeros(len(doc))
    rate = weight.astype(np.float64)
    alone = np.bincount(doc, minlength=n_docs)[doc] == 1  # one shingle wins everywhere
    winner.reshape(n_docs, m)[doc[alone]] = value[alone][:, None]
    doc, value, rate, time = doc[~alone], value[~alone], rate[~alone], time[~alone]
    grid, point = first.reshape(n_docs, m), 0
    while len(doc):
        point += 1
        h = mixed(value + np.uint64((point * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF))
        time = time - np.log(uniform(h)) / rate
        component = (mixed(h ^ np.uint64(0xA0761D6478BD642F)) % np.uint64(m)).astype(np.int64)
        cell = doc * m + component
        np.minimum.at(first, cell, time)
        won = first[cell] == time
        winner[cell[won]] = value[won]
        # a shingle whose next point comes after the slowest component can't win any more
        start, end = runs(doc)
        going = time < np.repeat(grid[doc[start]].max(1), end - start)
        doc, value, rate, time = doc[going], value[going], rate[going], time[going]
    return winner.reshape(n_docs, m)


def probability_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """The exact similarity of two weighted sets (sorted hashes, counts): the sum over common d of
    1 / sum over e of max(a_e / a_d, b_e / b_d)."""
    both, ia, ib = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    if not len(both):
        return 0.0
    x, y = a[1][ia].astype(float), b[1][ib].astype(float)
    only_a, only_b = a[1].sum() - x.sum(), b[1].sum() - y.sum()
    # the larger of x_e / x_d and y_e / y_d changes sides where x_e / y_e passes x_d / y_d
    ratio = x / y
    order = np.argsort(ratio, kind="stable")
    x, y, ratio = x[order], y[order], ratio[order]
    up_to = np.concatenate(([0.0], np.cumsum(y)))  # e with ratio <= that of d count y_e / y_d
    beyond = np.concatenate((np.cumsum(x[::-1])[::-1], [0.0]))
    k = np.searchsorted(ratio, ratio, side="right")
    return float(np.sum(1.0 / ((beyond[k] + only_a) / x + (up_to[k] + only_b) / y)))


def signed(reps: DataFrame, bands: int, rows: int) -> DataFrame:
    """(id, doc, band keys, signature) of every text with words. A signature is the bands' components
    in 16 bits each and the others in 8."""
    m = bands * rows

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, docs = b.column("id"), b.column("doc")
            for lo, hi, texts in steps(b, most=2_000_000):
                doc, value, weight = shingles(texts)
                if not len(doc):
                    continue
                # only texts with words get a signature
                own, doc = np.unique(doc, return_inverse=True)
                sig = mixed(signatures(doc, value, weight, len(own), COMPONENTS))
                keys = _band_keys(sig[:, :m], bands, rows)
                kept = np.concatenate((sig[:, :m].astype(np.uint16).view(np.uint8), sig[:, m:].astype(np.uint8)), 1)
                yield pa.RecordBatch.from_arrays(
                    [*[c.slice(lo, hi - lo).take(pa.array(own)) for c in (ids, docs)], pa.array(list(keys.view(np.int64)), pa.list_(pa.int64())), pa.array([k.tobytes() for k in kept], pa.binary())],
                    ["id", "doc", "keys", "signature"],
                )

    return reps.select("id", "doc", "text").mapInArrow(made, "id long, doc long, keys array<long>, signature binary")


class Signs:
    """Stored signatures of several texts: ``bands`` in 16 bits, ``rest`` in 8."""

    def __init__(self, stored: list[bytes], m: int):
        flat = np.frombuffer(b"".join(stored), np.uint8).reshape(len(stored), -1)
        self.bands, self.rest = np.ascontiguousarray(flat[:, : 2 * m]).view(np.uint16), flat[:, 2 * m :]


def estimate(same: np.ndarray, same_rest: np.ndarray, m: int) -> np.ndarray:
    """Similarity from agreeing components; of the 8-bit ones some agree by chance."""
    rest = COMPONENTS - m
    return (same + (same_rest - rest / 256) / (1 - 1 / 256)) / COMPONENTS


def sure_below(threshold: float) -> float:
    return threshold - ERRORS * (threshold * (1 - threshold) / COMPONENTS) ** 0.5


def _band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    parts = sig.reshape(len(sig), bands, rows)
    key = np.zeros(parts.shape[:2], np.uint64) + np.arange(bands, dtype=np.uint64)
    for r in range(rows):
        key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, r])
    return key


def verified(pairs: DataFrame, reps: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) of distinct texts whose similarity reaches the threshold."""
    text = reps.select("id", "text")
    full = pairs.join(text.withColumnsRenamed({"id": "a", "text": "text_a"}), "a").join(text.withColumnsRenamed({"id": "b", "text": "text_b"}), "b").select("a", "b", "text_a", "text_b")

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for lo, hi, left in steps(batch, "text_a", 300_000):
                right = batch.column("text_b").slice(lo, hi - lo).to_pylist()
                sets = []
                for side in (left, right):
                    doc, value, weight = shingles(side)
                    cut = np.searchsorted(doc, np.arange(hi - lo + 1))
                    sets.append([(value[x:y], weight[x:y]) for x, y in zip(cut[:-1], cut[1:])])
                good += [probability_jaccard(x, y) >= threshold - 1e-12 for x, y in zip(*sets)]
            mask = pa.array(good, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(mask), batch.column("b").filter(mask)], ["a", "b"])

    return full.mapInArrow(kept, "a long, b long")


def alike(pairs: DataFrame, marks: DataFrame, m: int, at_least: float) -> DataFrame:
    """Pairs whose signatures agree in enough components to be worth reading in full."""
    both = pairs.join(marks.withColumnsRenamed({"id": "a", "signature": "sa"}), "a").join(marks.withColumnsRenamed({"id": "b", "signature": "sb"}), "b").select("a", "b", "sa", "sb")

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x, y = (Signs(b.column(c).to_pylist(), m) for c in ("sa", "sb"))
            mask = pa.array(estimate((x.bands == y.bands).sum(1), (x.rest == y.rest).sum(1), m) >= at_least)
            yield pa.RecordBatch.from_arrays([b.column("a").filter(mask), b.column("b").filter(mask)], ["a", "b"])

    return both.mapInArrow(kept, "a long, b long")


def apart_alike(members: DataFrame, bands: int, rows: int, at_least: float) -> DataFrame:
    """Pairs (a, b) of bucket members (key, band, hub, id, class, signature, n) of different
    components whose signatures are alike. A pair is given by the first band that it shares.

    A bucket of more than BLOCK members is compared block by block, each pair of blocks a group.
    """
    m = bands * rows
    n_blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    dealt = members.withColumn("blocks", n_blocks).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.withColumns({"x": F.least("block", "other"), "y": F.greatest("block", "other")})

    def compared(rows_: pa.Table) -> pa.Table:
        block, x, y = (rows_.column(c).to_numpy() for c in ("block", "x", "y"))
        ids, of, hub = (rows_.column(c).to_numpy() for c in ("id", "class", "hub"))
        band = rows_.column("band")[0].as_py()
        signs = Signs(rows_.column("signature").to_pylist(), m)
        left, right = np.flatnonzero(block == x), np.flatnonzero(block == y)
        out: list[tuple] = []
        for lo in range(0, len(left), 32):
            i = left[lo : lo + 32]
            good = (of[i][:, None] != of[right]) & (ids[i] != hub[i])[:, None] & (ids[right] != hub[right])
            if x[0] == y[0]:
                good &= ids[i][:, None] < ids[right]
            cols = np.flatnonzero(good.any(0))
            if not len(cols):
                continue
            j = right[cols]
            same = signs.bands[i][:, None] == signs.bands[j]
            good = good[:, cols] & (same.reshape(len(i), len(j), bands, rows).all(3).argmax(2) == band)
            u, v = np.nonzero(good)
            about = estimate(same[u, v].sum(1), (signs.rest[i[u]] == signs.rest[j[v]]).sum(1), m) >= at_least
            out.append((ids[i[u[about]]], ids[j[v[about]]]))
        a, b = (np.concatenate(c) for c in zip(*out)) if out else (np.empty(0, np.int64),) * 2
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return dealt.groupBy("key", "x", "y").applyInArrow(compared, "a long, b long")


def _keyed(docs: DataFrame, *more: str) -> DataFrame:
    """doc (a null doc_id counts as the largest), no_id and the text's digest, null for a null text."""
    doc_id = F.col("doc_id").cast("long")
    return docs.select(
        F.coalesce(doc_id, F.lit((1 << 63) - 1)).alias("doc"), doc_id.isNull().alias("no_id"),
        F.when(F.col("text").isNotNull(), F.unhex(F.sha2("text", 256))).alias("digest"), *more,
    )


def text_classes(docs: DataFrame, stage: Stage, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(digest, class_id, doc, no_id, leads) for every distinct text of ``docs``.

    doc and no_id are those of the first row with the text; class_id is the smallest doc_id of the class; one
    text of each class, that of its first row, leads."""
    # equal texts are one text, told from others by its digest and named by a number of its own
    first = _keyed(docs).filter("digest is not null").groupBy("digest").agg(F.min(F.struct("no_id", "doc")).alias("first"))
    ids = stage.put("ids", first.select("digest", "first.no_id", "first.doc", F.monotonically_increasing_id().alias("id")))
    key = ["digest", "doc", "no_id"]
    # the key holds the row's own doc_id, so that a group of copies doesn't meet in one task
    reps = stage.put("texts", _keyed(docs, "text").join(ids, key).groupBy(*key, "id").agg(F.first("text").alias("text")).select("id", "doc", "text"))
    marks = stage.put("signatures", signed(reps, bands, rows))
    signs = marks.select("id", "signature")
    bucket = marks.select("id", "doc", F.posexplode("keys").alias("band", "key"))
    # the hub is the oldest document, as copies are more like what they were made from than like one another
    shared = bucket.groupBy("key").agg(F.min(F.struct("doc", "id")).alias("first"), F.count("*").alias("n")).filter("n > 1").select("key", F.col("first.id").alias("hub"), "n")
    groups = stage.put("buckets", bucket.join(shared, "key").select("key", "band", "hub", "n", "id"))
    star = stage.put("star", groups.filter("id <> hub").select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct())
    cut = sure_below(threshold)
    links = stage.put("links", verified(alike(star, signs, bands * rows, cut), reps, threshold))
    comp = stage.put("joined", components(links.select(F.col("a").alias("src"), F.col("b").alias("dst")), stage, "cc"))
    # what the stars left apart: buckets with members of different components
    placed = groups.join(comp.withColumnRenamed("node", "id"), "id", "left").withColumn("class", F.coalesce("class", "id"))
    split = placed.groupBy("key").agg(F.min("class").alias("lo"), F.max("class").alias("hi")).filter("lo <> hi and lo is not null").select("key")
    apart = placed.filter("n > 2").join(split, "key").join(signs, "id")
    more = stage.put("more", verified(apart_alike(apart, bands, rows, cut), reps, threshold))
    edges = links.union(more).select(F.col("a").alias("src"), F.col("b").alias("dst"))
    final = components(edges, stage, "all").withColumnsRenamed({"node": "id"})
    of = stage.put("of", ids.join(final, "id", "left").withColumn("class", F.coalesce("class", "id")))
    head = of.groupBy("class").agg(F.min(F.struct("no_id", "doc", "digest")).alias("head"))
    out = of.join(head, "class").select(
        "digest", F.when(~F.col("head.no_id"), F.col("head.doc")).alias("class_id"), "doc", "no_id", (F.col("digest") == F.col("head.digest")).alias("leads")
    )
    out = stage.put("text-classes", out)
    stage.drop("texts", "signatures", "buckets", "star", "links", "joined", "more", "ids", "of")
    return out


def classes(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, class_id) for every row of ``docs`` (doc_id, text); doc_id must be an integer."""
    stage = Stage(docs.sparkSession, "near")
    found = text_classes(docs, stage, **options).select("digest", "class_id", F.lit(True).alias("known"))
    own = F.when(~F.col("no_id"), F.col("doc"))
    out = _keyed(docs).join(found, "digest", "left")
    return out.select(own.alias("doc_id"), F.when(F.col("known"), F.col("class_id")).otherwise(own).alias("class_id"))


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """One row of ``docs`` of each class: the first by doc_id (nulls last), then by digest of the text.

    A row with a null text is a class of its own; rows that repeat its doc_id are one, those without doc_id all stay."""
    stage = Stage(docs.sparkSession, "near")
    found = text_classes(docs, stage, **options).filter("leads").select("digest", "doc", "no_id")
    names = docs.columns
    rows = _keyed(docs, F.struct(*[F.col(c) for c in names]).alias("row_"))
    key = ["digest", "doc", "no_id"]
    kept = rows.join(found, key, "left_semi").dropDuplicates(key)
    none = rows.filter("digest is null")
    kept = kept.unionByName(none.filter("not no_id").dropDuplicates(["doc"])).unionByName(none.filter("no_id"))
    return kept.select(*[F.col("row_").getField(c).alias(c) for c in names])
