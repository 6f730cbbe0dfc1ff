"""Removal of repeated byte strings by external induced sorting of suffixes.

Every 100-byte window is led by an anchor: of its 51 substrings of 50 bytes the one with the least
hash. Equal windows have equal anchors, so windows can be sharded by their anchor's hash, and
windows whose anchor occurs once need no look. What neighbouring windows with one anchor span (149
bytes at most, 125 on average) goes to the anchor's shard; equal spans of one batch travel once. In a shard
the spans are one text whose suffixes are put in order by induced sorting with disk-backed queues
(``induced_sort``); suffixes that share 100 bytes or more with their neighbour are equal windows,
and all but the earliest are repeats.

A shard of more than ``Limits.shard`` bytes is dealt to several tasks, which drop equal spans and split the others: windows
that have half of what their anchor lacks to 100 bytes before it are sharded anew by the anchor and those bytes, the
others by the anchor and the bytes after it. After six splits the anchor is the window, so a line in a third of
all documents, each time with other neighbours, never meets in one task. One anchor that is too large
for one sort is split alike inside its task.

Defined results: a null text has no bytes; a text shorter than the window loses nothing; places
are ordered by (doc_id, digest of the text, byte), a null doc_id last, so rows that share a doc_id but not the text
are documents of their own; rows that repeat a document (same doc_id and text) are one document and get equal results;
an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import rolling, runs, steps, unpack, within
from .induced_sort import MEMORY, suffix_order
from .spool import BUCKETS, GROUPS, Spool, by_identity, differ, group_rows, grouped, identities, merged, n_groups, places, read_ids, settle
from .staging import Stage

WINDOW, ANCHOR = 100, 50
#: Shards for each document group.
SHARDS = 8
#: A run of windows is stored as first place * SPAN + number of windows.
SPAN = 4096
SPANS = BUCKETS + ", text binary, size long"
#: Hash bits by which anchors are told apart.
KEY = ~np.uint64(0xFFFFF)


@dataclass(frozen=True)
class Limits:
    """What a task takes at a time, in bytes; results are the same for all values.

    shard: spans of one task, a larger shard is split; sort: spans whose suffixes are sorted together, anchor by
    anchor; memory: a sort's queued tuples, beyond it they go to scratch disk; piece: of a text looked at together, a
    longer one is taken in pieces that overlap by a window.
    """

    shard: int = 24_000_000
    sort: int = 600_000
    memory: int = MEMORY
    piece: int = 8_000_000


class Anchored:
    """Some texts' bytes and the runs of windows that share an anchor.

    doc, start, count: the run's document, its first window there and how many there are;
    anchor: the anchor's place in the document; first: where the run starts in ``data``; hash: 44 leading bits.
    ``base``: where in its document each of ``raw`` starts.
    """

    def __init__(self, raw: list[bytes], docs: list[int], base: list[int]):
        self.data = np.frombuffer(b"".join(raw), np.uint8)
        offset = np.concatenate(([0], np.cumsum([len(r) for r in raw]))).astype(np.int64)
        h = rolling(self.data, ANCHOR)
        last = np.uint64((1 << 26) - 1)
        # leading hash bits, then the place counted backwards: the least is the rightmost of equals
        most = (h & ~last) | (last - np.arange(len(h), dtype=np.uint64))
        for w in (1, 2, 4, 8, 16):
            most = np.minimum(most[:-w], most[w:]) if len(most) > w else most[:0]
        rest = WINDOW - ANCHOR + 1 - 32
        most = np.minimum(most[:-rest], most[rest:]) if len(most) > rest else most[:0]
        place = (last - (most & last)).astype(np.int64)
        n = np.maximum(np.diff(offset) - WINDOW + 1, 0)  # windows of each text
        at = within(offset[:-1], offset[:-1] + n)
        own = np.repeat(np.arange(len(raw)), n)
        a, b = runs(place[at])
        # places differ between texts, so a run never leaves its text
        own, self.first, core = own[a], at[a], place[at[a]]
        shift = np.array(base, np.int64)[own] - offset[own]
        self.doc, self.count = np.array(docs, np.int64)[own], b - a
        self.start, self.anchor = self.first + shift, core + shift
        self.hash = h[core] & KEY


def anchored(texts: list[str | None], piece: int = Limits.piece) -> Iterator[Anchored]:
    """The texts' runs; long texts come in pieces."""
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    short = [k for k, r in enumerate(raw) if len(r) <= piece]
    yield Anchored([raw[k] for k in short], short, [0] * len(short))
    for k, r in enumerate(raw):
        if len(r) > piece:
            for lo in range(0, len(r), piece):
                yield Anchored([r[lo : lo + piece + WINDOW - 1]], [k], [lo])


def anchor_hits(docs: DataFrame, n: int, limits: Limits) -> DataFrame:
    """The group table of the anchors that occur more than once."""

    def probes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spool = Spool(n)
        for batch in batches:
            ids, groups = identities(batch), batch.column("g").to_numpy(zero_copy_only=False)
            for lo, hi, texts in steps(batch, most=1_000_000):
                for own in anchored(texts, limits.piece):
                    spool.add(own.hash, np.zeros(len(own.hash), np.uint8), own.doc, own.anchor, ids[lo:hi], groups[lo:hi])
                    if spool.full():
                        yield from settle(spool, lambda pos: np.ones(len(pos), bool))
        yield from settle(spool, lambda pos: np.ones(len(pos), bool))

    def met(rows: pa.Table) -> pa.Table:
        (h, _, doc, pos, ids, groups), (d2, p2, i2, g2) = merged(rows, np.uint8)
        a, b = runs(h)
        keep = np.repeat(b - a > 1, b - a)
        doc, pos = np.concatenate((doc[keep], d2 + len(ids))), np.concatenate((pos[keep], p2))
        return pa.Table.from_batches([group_rows(doc.astype(np.int64), pos, np.concatenate((ids, i2)), np.concatenate((groups, g2)))])

    return docs.mapInArrow(probes, BUCKETS).groupBy("bucket").applyInArrow(met, GROUPS)


@dataclass
class Spans:
    """Runs of windows that share a core, and the bytes that they span.

    doc: place in ids and groups; start, count: first window and number of windows; core: the core's
    place in the span, which starts at ``first`` in ``data``; size: of cores, in bytes.
    """

    data: np.ndarray
    doc: np.ndarray
    start: np.ndarray
    count: np.ndarray
    core: np.ndarray
    first: np.ndarray
    hash: np.ndarray
    size: int
    ids: np.ndarray
    groups: np.ndarray

    def __len__(self) -> int:
        return len(self.doc)

    def take(self, some: np.ndarray) -> Spans:
        return replace(self, **{k: getattr(self, k)[some] for k in ("doc", "start", "count", "core", "first", "hash")})

    def length(self) -> np.ndarray:
        return self.count + WINDOW - 1

    def text(self) -> bytes:
        """The spans one after the other, put together a few thousand at a time."""
        end = self.first + self.length()
        return b"".join(self.data[within(self.first[k : k + 4096], end[k : k + 4096])].tobytes() for k in range(0, len(self), 4096))

    def reduced(self) -> tuple[Spans, np.ndarray]:
        """The earliest of equal spans, and the places of the others, whose windows are repeats."""
        ends = np.concatenate(([0], np.cumsum(self.length())))
        values = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(self), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(self.text())])
        code = pc.dictionary_encode(values).indices.to_numpy()
        who = self.ids[self.doc]
        order = np.lexsort((self.start, *by_identity(who), code))
        new = np.ones(len(order), bool)
        new[1:] = code[order[1:]] != code[order[:-1]]
        lead = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
        later = differ(who[order], who[lead]) | (self.start[order] != self.start[lead])
        return self.take(order[new]), order[~new & later]

    def split(self) -> Spans:
        """The same windows with larger cores: those with enough bytes before the core and the others."""
        m = (WINDOW - self.size + 1) // 2
        left = np.clip(self.core - m + 1, 0, self.count)
        a, b = np.flatnonzero(left > 0), np.flatnonzero(left < self.count)
        joined = lambda x, y: np.concatenate((x[a], y[b]))
        core_at = joined(self.first + self.core - m, self.first + self.core)
        h = rolling(self.data, self.size + m)[core_at] & KEY if len(core_at) else self.hash[:0]
        return replace(
            self, doc=joined(self.doc, self.doc), start=joined(self.start, self.start + left), count=joined(left, self.count - left),
            core=joined(self.core - m, self.core - left), first=joined(self.first, self.first + left), hash=h, size=self.size + m,
        )

    def by_anchor(self) -> Spans:
        return self.take(np.argsort(self.hash, kind="stable"))

    def rows(self, buckets: int) -> Iterator[pa.RecordBatch]:
        """Rows of the shard table; spans equal to an earlier one are repeats already."""
        if not len(self):
            return
        spool = Spool(buckets)
        lead, twin = self.reduced()
        lead = lead.by_anchor()
        size = lead.length()
        rows = spool.rows(lead.hash, (size | lead.core << 16).astype(np.uint32), lead.doc, lead.start * SPAN + lead.count, self.ids, self.groups)
        bucket = ((lead.hash >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
        bytes_, ends = lead.text(), np.concatenate(([0], np.cumsum(size)))
        a, b = runs(bucket)
        yield _with_text(rows, [bytes_[x:y] for x, y in zip(ends[a], ends[b])])
        if len(twin):
            twin = twin[np.argsort(self.hash[twin], kind="stable")]
            rows = spool.rows(self.hash[twin], np.empty(0, np.uint32), self.doc[twin], self.start[twin] * SPAN + self.count[twin], self.ids, self.groups, whole=True)
            yield _with_text(rows, [b""] * rows.num_rows)


def _with_text(rows: pa.RecordBatch, texts: list[bytes]) -> pa.RecordBatch:
    packed = pa.array([zstandard.compress(t, 1) if t else b"" for t in texts], pa.binary())
    return pa.RecordBatch.from_arrays([*rows.columns, packed, pa.array([len(t) for t in texts], pa.int64())], [*rows.schema.names, "text", "size"])


def _table(parts: list[pa.RecordBatch]) -> pa.Table:
    return pa.Table.from_batches(parts or [_with_text(Spool(1).rows(*Spool(1).columns()), [])])


def spans(docs: DataFrame, hits: DataFrame, n: int, limits: Limits) -> DataFrame:
    """Per shard, the spans of the windows whose anchor occurs more than once."""

    def made(_, left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if left.num_rows and right.num_rows:
            left = left.combine_chunks()
            ids, groups = identities(left), left.column("g").to_numpy()
            hit_doc, hit_at = places(right, ids)
            live = np.sort((hit_doc << 32) | hit_at)
            base = 0
            for batch in left.to_batches():
                for lo, hi, texts in steps(batch, most=1_000_000):
                    at = slice(base + lo, base + hi)
                    for own in anchored(texts, limits.piece):
                        code = ((own.doc + at.start) << 32) | own.anchor
                        k = np.searchsorted(live, code)
                        some = np.flatnonzero(live[np.minimum(k, len(live) - 1)] == code)
                        found = Spans(own.data, own.doc, own.start, own.count, own.anchor - own.start, own.first, own.hash, ANCHOR, ids[at], groups[at])
                        out += list(found.take(some).rows(n))
                base += batch.num_rows
        return _table(out)

    return docs.groupBy("g").cogroup(hits.groupBy("g")).applyInArrow(made, SPANS)


def _read(rows: pa.Table, size: int) -> tuple[Spans, tuple[np.ndarray, ...]]:
    """The spans of a shard, and (doc, pos, ids, groups) of its whole rows."""
    plain = rows.filter(pc.invert(rows.column("whole")))
    data = np.frombuffer(b"".join(zstandard.decompress(t) if t else b"" for t in plain.column("text").to_pylist()), np.uint8)
    (hash_, extra, doc, pos, ids, groups) = ([], [], [], [], [], [])
    base = 0
    for r in range(plain.num_rows):
        own = read_ids(plain.column("ids")[r])
        for to, c, kind in ((extra, "extra", np.uint32), (doc, "doc", np.uint32), (pos, "pos", np.uint64), (groups, "groups", np.int32), (hash_, "hash", np.uint64)):
            to.append(unpack(plain.column(c)[r].as_py(), kind))
        hash_[-1], doc[-1] = np.cumsum(hash_[-1], dtype=np.uint64), doc[-1].astype(np.int64) + base
        ids.append(own)
        base += len(own)
    joined = lambda parts, kind: np.concatenate(parts).astype(kind) if parts else np.empty(0, kind)
    pos, extra = joined(pos, np.int64), joined(extra, np.int64)
    found = Spans(
        data, joined(doc, np.int64), pos // SPAN, pos % SPAN, extra >> 16, np.concatenate(([0], np.cumsum(extra & 0xFFFF)[:-1])).astype(np.int64) if len(extra) else extra,
        joined(hash_, np.uint64), size, np.concatenate(ids) if ids else np.empty((0, 2), np.int64), joined(groups, np.int32),
    )
    return found, merged(rows.filter(rows.column("whole")))[1]


def repeated(rows: pa.Table, size: int, limits: Limits) -> pa.Table:
    """The group table of the windows of one shard that also start earlier."""
    found, (d2, p2, i2, g2) = _read(rows, size)
    doc, pos = _repeats(found, limits)
    pa.default_memory_pool().release_unused()  # before the next shard comes
    out = group_rows(np.concatenate((doc, d2 + len(found.ids))).astype(np.int64), np.concatenate((pos, p2)), np.concatenate((found.ids, i2)), np.concatenate((found.groups, g2)))
    return pa.Table.from_batches([out])


def _repeated(size: int, limits: Limits) -> Callable[[pa.Table], pa.Table]:
    return lambda rows: repeated(rows, size, limits)


def _finer(size: int, shards: int, columns: list[str]) -> Callable[[pa.Table], pa.Table]:
    """From part of a shard to rows of finer shards, without the spans that equal an earlier one."""

    def split(rows: pa.Table) -> pa.Table:
        got, (d2, p2, i2, g2) = _read(rows.select(columns), size)
        lead, twin = got.reduced()
        out = list(lead.split().rows(shards))
        doc, pos = np.concatenate((got.doc[twin], d2 + len(got.ids))), np.concatenate((got.start[twin] * SPAN + got.count[twin], p2))
        if len(doc):
            spread = np.zeros(len(doc), np.uint64) + (got.hash[0] if len(got) else np.uint64(0))
            whole = Spool(shards).rows(spread, np.empty(0, np.uint32), doc, pos, np.concatenate((got.ids, i2)), np.concatenate((got.groups, g2)), whole=True)
            out.append(_with_text(whole, [b""] * whole.num_rows))
        return _table(out)

    return split


def _repeats(found: Spans, limits: Limits = Limits()) -> tuple[np.ndarray, np.ndarray]:
    """(doc, coded run) of the windows in these spans of which an equal one is earlier."""
    doc, pos = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    while len(found):
        lead, twin = found.reduced()
        doc.append(found.doc[twin])
        pos.append(found.start[twin] * SPAN + found.count[twin])
        # spans that no other one shares its anchor with have no equal windows
        lead = lead.by_anchor()
        a, b = runs(lead.hash)
        total = np.concatenate(([0], np.cumsum(lead.length())))
        many, big = b - a > 1, (total[b] - total[a] > limits.sort) & (lead.size < WINDOW)
        rest = lead.take(np.flatnonzero(np.repeat(many & ~big, b - a)))
        for part in _pieces(rest.hash, rest.length(), limits.sort):
            d, p = _equal_windows(rest.take(np.arange(part.start, part.stop)), limits.memory)
            doc.append(d)
            pos.append(p)
        found = lead.take(np.flatnonzero(np.repeat(many & big, b - a)))
        found = found.split() if len(found) else found
    return np.concatenate(doc), np.concatenate(pos)


def _pieces(hash_: np.ndarray, size: np.ndarray, most: int) -> Iterator[slice]:
    """Runs of whole anchors of about ``most`` bytes."""
    _, b = runs(hash_)
    total = np.cumsum(size)
    lo = 0
    while lo < len(hash_):
        done = total[lo - 1] if lo else 0
        k = np.searchsorted(total[b - 1], done + most, "right") - 1
        k = max(k, np.searchsorted(b, lo, "right"))
        yield slice(lo, int(b[k]))
        lo = int(b[k])


def _equal_windows(own: Spans, memory: int = MEMORY) -> tuple[np.ndarray, np.ndarray]:
    """(doc, coded run) by the order of the spans' suffixes."""
    size = own.length()
    begin = np.concatenate(([0], np.cumsum(size + 1)))  # each span ends in a 1; bytes are 2 and up
    joined = np.ones(begin[-1] + 1, np.int32)
    joined[within(begin[:-1], begin[:-1] + size)] = own.data[within(own.first, own.first + size)].astype(np.int32) + 2
    joined[-1] = 0
    place, shared = suffix_order(joined, 258, WINDOW, memory)
    span = np.searchsorted(begin, place, "right") - 1
    at = place - begin[np.minimum(span, len(own))]
    group = np.cumsum(shared < WINDOW)
    whole = np.flatnonzero((span < len(own)) & (at + WINDOW <= size[np.minimum(span, len(own) - 1)]))
    span, at, group = span[whole], at[whole], group[whole]
    who, start = own.ids[own.doc[span]], own.start[span] + at
    order = np.lexsort((start, *by_identity(who), group))
    span, group, who, start = (x[order] for x in (span, group, who, start))
    a, b = runs(group)
    head = np.repeat(a, b - a)
    later = differ(who, who[head]) | (start != start[head])
    span, start = span[later], start[later]
    order = np.lexsort((start, span))
    span, start = span[order], start[order]
    new = np.ones(len(span), bool)
    new[1:] = (span[1:] != span[:-1]) | (start[1:] != start[:-1] + 1)
    a = np.flatnonzero(new)
    n = np.diff(np.append(a, len(span)))
    return own.doc[span[a]], start[a] * SPAN + n


def removed_bytes(docs: DataFrame, stage: Stage, limits: Limits = Limits()) -> tuple[DataFrame, DataFrame]:
    """(grouped documents, group table of the repeated windows as coded runs)."""
    n = n_groups(docs)
    own = grouped(docs, n)
    hits = stage.put("hits", anchor_hits(own, n, limits))
    shards, found, size, split = n * SHARDS, [], ANCHOR, 0
    now = stage.put("spans-0", spans(own, hits, shards, limits))
    stage.drop("hits")
    while True:
        # shards that are too large for one task go to several, which split their anchors
        parts = F.ceil(F.sum("size") / limits.shard).cast("int")
        large = now.groupBy("bucket").agg(parts.alias("parts")).filter("parts > 1")
        last = size == WINDOW or large.isEmpty()
        small = now if last else now.join(large, "bucket", "left_anti")
        found.append(stage.put(f"repeats-{split}", small.groupBy("bucket").applyInArrow(_repeated(size, limits), GROUPS)))
        if last:
            break

        dealt = now.join(large, "bucket").withColumn("part", F.pmod(F.xxhash64("ids", "pos"), "parts")).drop("parts")
        finer = _finer(size, shards, now.columns)
        size, split = size + (WINDOW - size + 1) // 2, split + 1
        now = stage.put(f"spans-{split}", dealt.groupBy("bucket", "part").applyInArrow(finer, SPANS))
        stage.drop(f"spans-{split - 1}")
    stage.drop(f"spans-{split}")
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    return own, every


def digests(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row."""
    stage = Stage(docs.sparkSession, "bytes")
    own, found = removed_bytes(docs, stage, limits)

    def summed(_, left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[list] = [[], [], [], [], []]
        if left.num_rows:
            left = left.combine_chunks()
            ids = identities(left)
            gone_doc, code = places(right, ids)
            order = np.argsort(gone_doc, kind="stable")
            gone_doc, code = gone_doc[order], code[order]
            cut = np.searchsorted(gone_doc, np.arange(len(ids) + 1))
            base = 0
            for batch in left.to_batches():
                out[0] += batch.column("own_doc_id").to_pylist()
                for k, text in enumerate(batch.column("text"), base):
                    raw = (text.as_py() or "").encode("utf-8", "surrogatepass")
                    own = code[cut[k] : cut[k + 1]]
                    n_removed = n_spans = 0
                    kept = raw
                    if len(own):
                        mark = np.zeros(len(raw) + 1, np.int64)
                        np.add.at(mark, own // SPAN, 1)
                        np.add.at(mark, own // SPAN + own % SPAN + WINDOW - 1, -1)
                        gone = np.cumsum(mark[:-1]) > 0
                        n_removed = int(gone.sum())
                        n_spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                        kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
                    for o, v in zip(out[1:], (len(raw), n_removed, n_spans, hashlib.sha256(kept).hexdigest())):
                        o.append(v)
                base += batch.num_rows
        return pa.table({"doc_id": pa.array(out[0], pa.int64()), **{c: pa.array(v, pa.int64()) for c, v in zip(("n_bytes", "n_removed", "n_spans"), out[1:4])}, "kept_sha256": pa.array(out[4], pa.string())})

    done = own.groupBy("g").cogroup(found.groupBy("g")).applyInArrow(summed, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    done = stage.put("digests", done)
    return done
