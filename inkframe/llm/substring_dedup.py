"""Substring dedup by fixed-block anchors.

The index holds every document's non-overlapping blocks of ten words; every rolling ten-word
window probes it. Any twenty words hold a whole block of their own document, so a passage of
twenty words that occurs twice is hit by the other occurrence's window at the same place. Hits
are extended: the twenty-word windows around a hit are looked up by their words, each lookup
keeps the earliest place, and neighbouring hits make up the maximal repeats that are removed.

Both lookups are Spark shuffles by hash range. A task first settles what repeats inside its own
batch and sends one entry for it, so a passage in a third of all documents is a few entries a task.
Equal windows are those of equal 128-bit hashes, made of two independent hashes of each word's bytes.

Defined results: a null or empty text has no words; a text of fewer than twenty words loses
nothing; places are ordered by (doc_id, digest of the text, word), a null doc_id last, so rows that share
a doc_id but not the text are documents of their own; rows that repeat a document (same doc_id and text) are one
document and get equal results; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .blocks import Words, mixed, rolling, runs, steps
from .spool import BUCKETS, GROUPS, Spool, by_identity, differ, group_rows, grouped, identities, merged, n_groups, places, settle
from .staging import Stage

BLOCK, WINDOW = 10, 20
#: Seed of the second word hash.
SECOND = 0x9E3779B9


def _windows(words: Words, h: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first word, document) of all windows that lie in one document."""
    value = rolling(h, size)
    at = np.flatnonzero(words.doc[: len(value)] == words.doc[size - 1 :][: len(value)]) if len(value) else np.empty(0, np.int64)
    return value[at], at, words.doc[at]


def _is_block(pos: np.ndarray) -> np.ndarray:
    return pos % BLOCK == 0


def anchor_hits(docs: DataFrame, n: int) -> DataFrame:
    """The group table of all ten-word windows that meet a block elsewhere, and of those blocks."""

    def probes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spool = Spool(n)
        for batch in batches:
            ids, groups = identities(batch), batch.column("g").to_numpy(zero_copy_only=False)
            for lo, hi, texts in steps(batch, most=1_000_000):
                words = Words(texts)
                # 44 bits pick candidates; what they let through by chance the extension drops
                h, at, doc = _windows(words, words.hashes(), BLOCK)
                spool.add(h & ~np.uint64(0xFFFFF), np.zeros(len(h), np.uint8), doc, at - words.first[doc], ids[lo:hi], groups[lo:hi])
                if spool.full():
                    yield from settle(spool, _is_block)
        yield from settle(spool, _is_block)

    def met(rows: pa.Table) -> pa.Table:
        (h, _, doc, pos, ids, groups), (d2, p2, i2, g2) = merged(rows, np.uint8)
        keep = np.zeros(len(h), bool)
        if len(h):
            a, b = runs(h)
            keep = np.repeat((b - a > 1) & np.logical_or.reduceat(pos % BLOCK == 0, a), b - a)
        doc, pos = np.concatenate((doc[keep], d2 + len(ids))), np.concatenate((pos[keep], p2))
        return pa.Table.from_batches([group_rows(doc.astype(np.int64), pos, np.concatenate((ids, i2)), np.concatenate((groups, g2)))])

    return docs.mapInArrow(probes, BUCKETS).groupBy("bucket").applyInArrow(met, GROUPS)


def _repeats(spool: Spool) -> Iterator[pa.RecordBatch]:
    """Window entries: of equal windows the earliest is sent, the others are repeats already."""
    h, extra, doc, pos, ids, groups = spool.columns()
    if not len(h):
        return
    later = _later(h, extra, doc, pos, ids)
    keep = ~later
    yield spool.rows(h[keep], extra[keep], doc[keep], pos[keep], ids, groups)
    if later.any():
        d = doc[later]
        spread = mixed(d.astype(np.uint64) // np.uint64(4096))
        order = np.argsort(spread, kind="stable")
        yield spool.rows(spread[order], extra[:0], d[order], pos[later][order], ids, groups, whole=True)


def _later(h: np.ndarray, extra: np.ndarray, doc: np.ndarray, pos: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """For entries sorted by hash: whether an equal one has an earlier (doc_id, place)."""
    out = np.zeros(len(h), bool)
    if len(h) < 2:
        return out
    same = h[1:] == h[:-1]
    some = np.flatnonzero(np.concatenate(([False], same)) | np.concatenate((same, [False])))
    order = some[np.lexsort((pos[some], *by_identity(ids[doc[some]]), extra[some], h[some]))]
    h, extra, who, pos = h[order], extra[order], ids[doc[order]], pos[order]
    new = np.ones(len(order), bool)
    new[1:] = (h[1:] != h[:-1]) | (extra[1:] != extra[:-1])
    start = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    out[order] = differ(who, who[start]) | (pos != pos[start])
    return out


def repeats(docs: DataFrame, hits: DataFrame, n: int) -> DataFrame:
    """The group table of all twenty-word windows that also start earlier."""

    def near_hits(_, left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        spool = Spool(n)
        if right.num_rows and left.num_rows:
            left = left.combine_chunks()
            ids, groups = identities(left), left.column("g").to_numpy()
            hit_doc, hit_at = places(right, ids)
            order = np.argsort(hit_doc, kind="stable")
            hit_doc, hit_at = hit_doc[order], hit_at[order]
            base = 0
            for batch in left.to_batches():
                for lo, hi, texts in steps(batch, most=1_000_000):
                    x, y = np.searchsorted(hit_doc, (base + lo, base + hi))
                    if x == y:
                        continue
                    words = Words(texts)
                    h = words.hashes()
                    value, at, doc = _windows(words, h, WINDOW)
                    # windows that hold a hit start up to WINDOW - BLOCK words before it
                    mark = np.zeros(len(h) + WINDOW + 1, np.int64)
                    place = words.first[hit_doc[x:y] - base - lo] + hit_at[x:y]
                    np.add.at(mark, np.maximum(place - (WINDOW - BLOCK), 0), 1)
                    np.add.at(mark, place + 1, -1)
                    near = np.cumsum(mark)[at] > 0
                    extra = rolling(words.hashes(SECOND), WINDOW)[at[near]]
                    spool.add(value[near], extra, doc[near], at[near] - words.first[doc[near]], ids[base + lo : base + hi], groups[base + lo : base + hi])
                base += batch.num_rows
            out = list(_repeats(spool))
        return pa.Table.from_batches(out or [spool.rows(*spool.columns())])

    def not_first(rows: pa.Table) -> pa.Table:
        (h, extra, doc, pos, ids, groups), (d2, p2, i2, g2) = merged(rows, np.uint64)
        later = _later(h, extra, doc, pos, ids)
        doc, pos = np.concatenate((doc[later], d2 + len(ids))), np.concatenate((pos[later], p2))
        return pa.Table.from_batches([group_rows(doc.astype(np.int64), pos, np.concatenate((ids, i2)), np.concatenate((groups, g2)))])

    entries = docs.groupBy("g").cogroup(hits.groupBy("g")).applyInArrow(near_hits, BUCKETS)
    return entries.groupBy("bucket").applyInArrow(not_first, GROUPS)


def removed_words(docs: DataFrame, stage: Stage, keep: bool = False) -> tuple[DataFrame, DataFrame]:
    """(grouped documents, group table of the repeated windows)."""
    n = n_groups(docs)
    own = grouped(docs, n)
    hits = stage.put("hits", anchor_hits(own, n))
    found = stage.put("repeats", repeats(own, hits, n))
    stage.drop("hits")
    return grouped(docs, n, keep), found


def _kept(left: pa.Table, right: pa.Table) -> Iterator[tuple[pa.Table, Words, np.ndarray, int]]:
    """(rows, their words, whether each word stays) of one document group."""
    left = left.combine_chunks()
    ids = identities(left)
    rep_doc, rep_at = places(right, ids)
    order = np.argsort(rep_doc, kind="stable")
    rep_doc, rep_at = rep_doc[order], rep_at[order]
    base = 0
    for batch in left.to_batches():
        for lo, hi, texts in steps(batch, most=1_000_000):
            words = Words(texts)
            x, y = np.searchsorted(rep_doc, (base + lo, base + hi))
            mark = np.zeros(len(words.start) + WINDOW + 1, np.int64)
            place = words.first[rep_doc[x:y] - base - lo] + rep_at[x:y]
            np.add.at(mark, place, 1)
            np.add.at(mark, place + WINDOW, -1)
            yield batch.slice(lo, hi - lo), texts, words, np.cumsum(mark)[: len(words.start)] == 0
        base += batch.num_rows


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (kept words joined by one space) of every row."""
    stage = Stage(docs.sparkSession, "substrings")
    own, found = removed_words(docs, stage)

    def summed(_, left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[list] = [[], [], [], []]
        if left.num_rows:
            for rows, texts, words, keep in _kept(left, right):
                out[0] += rows.column("own_doc_id").to_pylist()
                for t, x, y in zip(texts, words.first[:-1], words.first[1:]):
                    own = keep[x:y]
                    removed = int(y - x - own.sum())
                    raw = (t or "").encode("utf-8", "surrogatepass").split()  # bytes split at the same six white bytes
                    kept = raw if not removed else [w for w, k in zip(raw, own) if k]
                    out[1].append(int(y - x))
                    out[2].append(removed)
                    out[3].append(hashlib.sha256(b" ".join(kept)).hexdigest())
        return pa.table({"doc_id": pa.array(out[0], pa.int64()), "n_words": pa.array(out[1], pa.int64()), "n_removed": pa.array(out[2], pa.int64()), "kept_sha256": pa.array(out[3], pa.string())})

    done = own.groupBy("g").cogroup(found.groupBy("g")).applyInArrow(summed, "doc_id long, n_words long, n_removed long, kept_sha256 string")
    done = stage.put("digests", done)
    stage.drop("repeats")
    return done


def without_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with repeated words cut out of the text, each with the white space after it, and
    ``n_chars``, where there is one, counted anew. Texts that lose nothing are unchanged."""
    own, found = removed_words(docs, Stage(docs.sparkSession, "cuts"), keep=True)
    names = docs.columns

    def cut(_, left: pa.Table, right: pa.Table) -> pa.Table:
        parts = []
        if left.num_rows:
            for rows, texts, words, keep in _kept(left, right):
                out = list(texts)
                bounds = np.append(words.start, len(words.data))
                for k, (x, y) in enumerate(zip(words.first[:-1], words.first[1:])):
                    if keep[x:y].all():
                        continue
                    a, b = runs(keep[x:y])
                    top = int(words.offset[k + 1]) - 1  # without the space between texts
                    ends = np.minimum(bounds[x + b], top)
                    starts = bounds[x + a].copy()
                    starts[0] = words.offset[k]
                    out[k] = b"".join(words.data[p:q].tobytes() for p, q, good in zip(starts, ends, keep[x + a]) if good).decode("utf-8", "surrogatepass")
                columns = {c: rows.column(f"own_{c}") for c in names if c != "text"}
                columns["text"] = pa.array(out, pa.string())
                if "n_chars" in columns:
                    columns["n_chars"] = pa.array([o if n is t else len(n) for o, n, t in zip(columns["n_chars"].to_pylist(), out, texts)], columns["n_chars"].type)
                parts.append(pa.Table.from_arrays([columns[c] for c in names], names))
        if parts:
            return pa.concat_tables(parts)
        return pa.table({c: pa.array([], left.column(c if c == "text" else f"own_{c}").type) for c in names})

    return own.groupBy("g").cogroup(found.groupBy("g")).applyInArrow(cut, docs.schema)
