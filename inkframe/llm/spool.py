"""Many small (hash, document, place) entries as few Spark rows.

A row of the bucket table holds all entries of one batch of texts whose hash lies in one range of
the hash space, as compressed columns sorted by hash. Buckets are ranges, so one sort of the
hashes serves both. A row of the group table holds places inside the documents of one document
group. Rows number at most one per entry, so the tables grow with the input and no faster.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import mixed, pack, runs, unpack

#: Bytes of text whose entries one bucket, and whose rows one document group, holds on average.
GROUP_BYTES = 6_000_000
#: Entries that a task gathers before it writes its rows.
FLUSH = 1_000_000
BUCKETS = "bucket int, whole boolean, hash binary, extra binary, doc binary, pos binary, ids binary, groups binary"
GROUPS = "g int, doc binary, pos binary, ids binary"
_NAMES = ["bucket", "whole", "hash", "extra", "doc", "pos", "ids", "groups"]


def n_groups(docs: DataFrame) -> int:
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(4, -(-total // GROUP_BYTES))


def grouped(docs: DataFrame, groups: int, keep: bool = False) -> DataFrame:
    """doc_id, tie, text, the document's group and own_doc_id, as it was.

    A document is told from others by doc_id and tie, a digest of its id and text, and ordered by
    them; a null doc_id counts as the largest. With ``keep`` each row also carries all columns of
    ``docs`` but the text, under the prefix ``own_``."""
    own = F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1))
    tie = F.xxhash64(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")))
    more = [F.col(c).alias(f"own_{c}") for c in docs.columns if c not in ("text", "doc_id")] if keep else []
    kept = F.col("doc_id") if keep else F.col("doc_id").cast("long")
    return docs.select(own.alias("doc_id"), tie.alias("tie"), "text", F.pmod(tie, F.lit(groups)).cast("int").alias("g"), kept.alias("own_doc_id"), *more)


def identities(rows: pa.RecordBatch | pa.Table) -> np.ndarray:
    """(doc_id, tie) of each row."""
    return np.stack([rows.column(c).to_numpy().astype(np.int64) if isinstance(rows, pa.Table) else rows.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "tie")], 1)


def by_identity(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sort keys of ``np.lexsort`` that put documents in order."""
    return ids[:, 1], ids[:, 0]


def differ(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a != b).any(1)


def _table(doc: np.ndarray, ids: np.ndarray, groups: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    own, doc = np.unique(doc, return_inverse=True)
    return doc.astype(np.uint32), ids[own], groups[own]


class Spool:
    """Entries of one task on their way to the bucket table."""

    def __init__(self, buckets: int):
        self.buckets = buckets
        self.clear()

    def clear(self) -> None:
        self.parts: list[tuple] = []
        self.ids: list[np.ndarray] = []
        self.groups: list[np.ndarray] = []
        self.docs = self.size = 0

    def add(self, hash_: np.ndarray, extra: np.ndarray, doc: np.ndarray, pos: np.ndarray, ids: np.ndarray, groups: np.ndarray) -> None:
        """``doc`` counts within ``ids`` and ``groups``, the documents of this batch."""
        self.parts.append((hash_, extra, (doc + self.docs).astype(np.uint32), pos.astype(np.uint64)))
        self.ids.append(ids)
        self.groups.append(groups)
        self.docs += len(ids)
        self.size += len(hash_)

    def full(self) -> bool:
        return self.size >= FLUSH

    def columns(self) -> tuple[np.ndarray, ...]:
        """hash, extra, doc, pos, ids, groups, sorted by hash; the spool is empty after."""
        hash_, extra, doc, pos = (np.concatenate(c) for c in zip(*self.parts)) if self.parts else [np.empty(0, np.uint64)] * 4
        ids, groups = (np.concatenate(c) if c else none for c, none in ((self.ids, np.empty((0, 2), np.int64)), (self.groups, np.empty(0, np.int32))))
        self.clear()
        order = np.argsort(hash_, kind="stable")
        return hash_[order], extra[order], doc[order], pos[order], ids, groups

    def rows(self, hash_, extra, doc, pos, ids, groups, whole: bool = False) -> pa.RecordBatch:
        """Rows of the bucket table from columns sorted by hash. ``whole`` rows are results already."""
        bucket = ((hash_ >> np.uint64(32)) * np.uint64(self.buckets)) >> np.uint64(32)
        out: list[tuple] = []
        for a, b in zip(*runs(bucket)):
            d, i, g = _table(doc[a:b], ids, groups)
            h = hash_[a:b]
            delta = np.concatenate((h[:1], h[1:] - h[:-1])) if not whole else h[:0]
            out.append((int(bucket[a]), whole, pack(delta), pack(extra[a:b]) if not whole else b"", pack(d), pack(pos[a:b].astype(np.uint64)), pack(i.T.ravel()), pack(g.astype(np.int32))))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 8, [pa.int32(), pa.bool_(), *[pa.binary()] * 6])], _NAMES)


def _read(b: pa.Scalar, dtype) -> np.ndarray:
    return unpack(b.as_py(), dtype)


def read_ids(b: pa.Scalar) -> np.ndarray:
    return _read(b, np.int64).reshape(2, -1).T


def merged(rows: pa.Table, extra_type=np.uint32) -> tuple[tuple[np.ndarray, ...], tuple[np.ndarray, ...]]:
    """The entries of one bucket sorted by hash, and those of its whole rows:
    (hash, extra, doc, pos, ids, groups) and (doc, pos, ids, groups)."""
    found: dict[bool, list] = {False: [], True: []}
    base = {False: 0, True: 0}
    for r in range(rows.num_rows):
        whole, h, e, d, p, i, g = (rows.column(c)[r] for c in _NAMES[1:])
        whole = whole.as_py()
        i, d = read_ids(i), _read(d, np.uint32).astype(np.int64)
        own = [d + base[whole], _read(p, np.uint64).astype(np.int64), i, _read(g, np.int32)]
        base[whole] += len(i)
        found[whole].append(own if whole else [np.cumsum(_read(h, np.uint64)), _read(e, extra_type), *own])
    out = []
    for whole, n in ((False, 6), (True, 4)):
        none = [np.empty(0, np.int64)] * (n - 2) + [np.empty((0, 2), np.int64), np.empty(0, np.int32)]
        cols = [np.concatenate(c) for c in zip(*found[whole])] or none
        if not whole and len(cols[0]):
            order = np.argsort(cols[0], kind="stable")
            cols[:4] = [c[order] for c in cols[:4]]
        out.append(tuple(cols))
    return out[0], out[1]


def group_rows(doc: np.ndarray, pos: np.ndarray, ids: np.ndarray, groups: np.ndarray) -> pa.RecordBatch:
    """Rows of the group table."""
    order = np.lexsort((pos, doc, groups[doc])) if len(doc) else np.empty(0, np.int64)
    doc, pos = doc[order], pos[order]
    out = []
    for a, b in zip(*runs(groups[doc] if len(doc) else doc)):
        d, i, _ = _table(doc[a:b], ids, groups)
        out.append((int(groups[doc[a]]), pack(d), pack(pos[a:b].astype(np.uint64)), pack(i.T.ravel())))
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 4, [pa.int32(), *[pa.binary()] * 3])], ["g", "doc", "pos", "ids"])


def places(rows: pa.Table, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(doc, pos) of a group's rows, doc counted within ``ids``; a repeated document gets its places each time."""
    docs, poss = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    order = np.lexsort((ids[:, 0], ids[:, 1]))
    ordered = ids[order, 1]
    for r in range(rows.num_rows):
        own = read_ids(rows.column("ids")[r])
        d, p = _read(rows.column("doc")[r], np.uint32).astype(np.int64), _read(rows.column("pos")[r], np.uint64).astype(np.int64)
        lo, hi = np.searchsorted(ordered, own[:, 1], "left"), np.searchsorted(ordered, own[:, 1], "right")
        for k in range(int((hi - lo).max(initial=0))):
            here = order[np.minimum(lo + k, len(order) - 1)]
            fits = (lo + k < hi) & (ids[here, 0] == own[:, 0])
            some = fits[d]
            docs.append(here[d[some]])
            poss.append(p[some])
    return np.concatenate(docs), np.concatenate(poss)


def settle(spool: Spool, is_anchor: Callable[[np.ndarray], np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Probe entries as rows: what an anchor and a probe of this batch decide already goes on as whole rows."""
    h, extra, doc, pos, ids, groups = spool.columns()
    a, b = runs(h)
    block = is_anchor(pos)
    if not len(h):
        return
    met = (b - a > 1) & np.logical_or.reduceat(block, a)
    hit = np.repeat(met, b - a)
    # one entry speaks for the batch's hits: an anchor, as the index needs one
    first = np.zeros(len(h), bool)
    order = np.lexsort((~block, np.repeat(np.arange(len(a)), b - a)))
    first[order[a]] = True
    send = ~hit | first
    yield spool.rows(h[send], extra[send], doc[send], pos[send], ids, groups)
    if hit.any():
        by = np.argsort(doc[hit], kind="stable")
        d = doc[hit][by]
        spread = mixed(d.astype(np.uint64) // np.uint64(4096))  # some bucket or other
        order = np.argsort(spread, kind="stable")
        yield spool.rows(spread[order], extra[:0], d[order], pos[hit][by][order], ids, groups, whole=True)
