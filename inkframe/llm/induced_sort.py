"""Suffix order and common prefixes of one shard by induced sorting with disk-backed queues.

Suffixes that start with the same byte form a queue. Scanning the queues in byte order, every
suffix hands its predecessor to the end of the queue of the predecessor's byte: first the
suffixes that are larger than their successor, then, backwards, those that are smaller. The
leftmost small ones (LMS) seed the scan; their order comes from their substrings' names, sorted
by the same induction and, where names repeat, by recursion on the string of names, two digits
a name, which also tells how many names neighbours share; the recursion ends with a string of names
that fits in memory, which is sorted there by doubling. A tuple carries, beside its place, the prefix it shares with the one before it in its queue: one more
than the least value between the two suffixes that induced them.

Queues beyond ``MEMORY`` bytes are kept in an unnamed scratch file, which goes with the task.
"""

from __future__ import annotations

import tempfile

import numpy as np

from .blocks import runs

#: Bytes of queued tuples that a sort keeps in memory.
MEMORY = 2_000_000


class Queues:
    """First-in first-out queues of (place, shared) tuples by symbol, spilled to scratch disk."""

    def __init__(self, memory: int = MEMORY):
        self.parts: dict[int, list] = {}
        self.held, self.memory, self.file = 0, memory, None

    def append(self, symbol: int, place: np.ndarray, shared: np.ndarray) -> None:
        size = place.nbytes + shared.nbytes
        if self.held + size > self.memory:
            if self.file is None:
                self.file = tempfile.TemporaryFile()
            at = self.file.seek(0, 2)
            self.file.write(np.ascontiguousarray(place).data)
            self.file.write(np.ascontiguousarray(shared).data)
            self.parts.setdefault(symbol, []).append((at, len(place), place.dtype))
        else:
            self.held += size
            self.parts.setdefault(symbol, []).append((place, shared))

    def take(self, symbol: int) -> tuple[np.ndarray, np.ndarray] | None:
        """All tuples of one queue, which is empty after."""
        got = []
        for p in self.parts.pop(symbol, ()):
            if isinstance(p[0], np.ndarray):
                self.held -= p[0].nbytes + p[1].nbytes
                got.append(p)
            else:
                at, n, kind = p
                self.file.seek(at)
                got.append((np.frombuffer(self.file.read(n * kind.itemsize), kind), np.frombuffer(self.file.read(n), np.uint8)))
        if not got:
            return None
        return np.concatenate([g[0] for g in got]), np.concatenate([g[1] for g in got])

    def close(self) -> None:
        if self.file is not None:
            self.file.close()


def is_small(text: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the next one; the last is."""
    start, end = runs(text)
    nxt = np.append(text[start[1:]], -1)
    small = nxt > text[start]
    small[-1] = True
    return np.repeat(small, end - start)


class _Between:
    """Least shared value between two places of a batch, by doubling."""

    def __init__(self, shared: np.ndarray):
        self.table = [shared]

    def least(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """min(shared[a + 1 .. b]) for each pair a < b."""
        n = b - a
        k = np.frexp(n.astype(np.float64))[1] - 1
        while len(self.table) <= int(k.max(initial=0)):
            t, w = self.table[-1], 1 << (len(self.table) - 1)
            self.table.append(np.minimum(t[:-w], t[w:]) if len(t) > w else t)
        out = np.empty(len(a), np.uint8)
        for level in np.unique(k):
            some = k == level
            t, w = self.table[level], 1 << int(level)
            out[some] = np.minimum(t[a[some] + 1], t[b[some] + 1 - w])
        return out


class _Scan:
    """One pass over the queues; ``hand`` gives a batch's predecessors to their queues."""

    def __init__(self, text: np.ndarray, wanted: np.ndarray, queues: Queues, symbols: int, cap: int):
        self.text, self.wanted, self.queues, self.cap = text, wanted, queues, cap
        self.carry = np.zeros(symbols, np.uint8)  # least value since the symbol's last tuple
        self.fresh = np.ones(symbols, bool)

    def hand(self, place: np.ndarray, shared: np.ndarray) -> None:
        if not len(place):
            return
        before = place - 1
        good = np.flatnonzero((place > 0) & self.wanted[before])
        least = np.minimum.accumulate(shared)
        if len(good):
            symbol = self.text[before[good]]
            order = np.argsort(symbol, kind="stable")
            at, symbol = good[order], symbol[order]
            start, end = runs(symbol)
            value = np.empty(len(at), np.uint8)
            inner = np.ones(len(at), bool)
            inner[start] = False
            inner = np.flatnonzero(inner)
            value[inner] = _Between(shared).least(at[inner - 1], at[inner]) if len(inner) else 0
            value[start] = np.minimum(self.carry[symbol[start]], least[at[start]])
            value = np.minimum(value, self.cap - 1) + 1
            own = symbol[start]
            value[start[self.fresh[own]]] = 0  # nothing stands before it in its queue
            self.fresh[own] = False
            left = np.append(np.minimum.accumulate(shared[::-1])[::-1], 255)[at[end - 1] + 1]
            np.minimum(self.carry, least[-1], out=self.carry)
            self.carry[own] = left
            moved = before[at]
            for s, a, b in zip(own.tolist(), start.tolist(), end.tolist()):
                self.queues.append(s, moved[a:b], value[a:b].astype(np.uint8))
        else:
            np.minimum(self.carry, least[-1], out=self.carry)


def induce(text: np.ndarray, small: np.ndarray, seeds: np.ndarray, seed_shared: np.ndarray, symbols: int, cap: int, memory: int) -> tuple[np.ndarray, np.ndarray]:
    """All suffixes in order with the prefix each shares with the one before, up to ``cap``.

    ``seeds``: the LMS suffixes ordered by symbol at least, with what they share.
    """
    same = np.zeros(len(text), np.int64)  # how often the first symbol repeats from here on
    start, end = runs(text)
    same = np.repeat(end, end - start) - np.arange(len(text))
    seed_symbol = text[seeds]
    cut = np.searchsorted(seed_symbol, np.arange(symbols + 1))
    queues, large = Queues(memory), Queues(memory)
    scan = _Scan(text, ~small, queues, symbols, cap)
    seam = lambda x, y: np.uint8(min(cap, int(same[x]), int(same[y])))
    for s in range(symbols):
        last = None
        while (got := queues.take(s)) is not None:
            large.append(s, *got)
            scan.hand(*got)
            last = int(got[0][-1])
        a, b = cut[s], cut[s + 1]
        if b > a:
            shared = seed_shared[a:b].copy()
            shared[0] = 0 if last is None else seam(last, seeds[a])
            scan.hand(seeds[a:b], shared)
    queues.close()
    queues = Queues(memory)
    scan = _Scan(text, small, queues, symbols, cap)
    out: list[tuple[np.ndarray, np.ndarray]] = []  # from the largest suffix down
    queues.append(int(text[-1]), np.array([len(text) - 1], seeds.dtype), np.zeros(1, np.uint8))
    for s in range(symbols - 1, -1, -1):
        last = None
        while (got := queues.take(s)) is not None:
            out.append(got)
            scan.hand(*got)
            last = int(got[0][-1])
        if (got := large.take(s)) is not None:
            place = got[0][::-1]
            shared = np.concatenate((np.zeros(1, np.uint8), got[1][::-1][:-1]))
            if last is not None:
                shared[0] = seam(last, place[0])
            out.append((place, shared))
            scan.hand(place, shared)
    queues.close()
    large.close()
    place = np.concatenate([o[0] for o in out])[::-1]
    down = np.concatenate([o[1] for o in out])  # shared with the next larger one
    shared = np.concatenate((np.zeros(1, np.uint8), down[::-1][:-1]))
    return place, shared


def _by_doubling(names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The end of the recursion, in memory: ranks of prefixes of twice as many names each time, until all differ."""
    n, rank, k = len(names), names.astype(np.int64), 1
    while True:
        order = np.argsort(rank, kind="stable")
        new = np.ones(n, bool)
        new[1:] = rank[order[1:]] != rank[order[:-1]]
        if new.all():
            break
        rank[order] = np.cumsum(new)
        after = np.zeros(n, np.int64)
        after[:-k] = rank[k:]
        rank, k = rank * (n + 1) + after, 2 * k
    equal = np.zeros(n, np.int64)
    equal[1:] = common(names, order[:-1], order[1:], np.full(n - 1, 100), 32)
    return order, equal


def _order_of_names(names: np.ndarray, symbols: int, memory: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffix order of a string of names that ends in its smallest, and how many names each suffix
    shares with the one before (up to 100), by induction on a string of two digits a name."""
    if names.astype(np.int64).nbytes <= memory:
        return _by_doubling(names)
    digits = 2 if symbols > 255 else 1
    base = int(np.ceil(symbols ** (1 / digits)))
    text = np.zeros(digits * len(names) + 1, np.int32)
    text[:-1] = np.stack([names // base ** (digits - 1 - d) % base + 1 for d in range(digits)], 1).ravel()
    place, shared = suffix_order(text, base + 1, 100 * digits, memory)
    at = np.flatnonzero((place % digits == 0) & (place < len(text) - 1))
    least = np.minimum.reduceat(shared[1:], at)[:-1] if len(at) > 1 and len(shared) > at[-1] + 1 else np.array([shared[a + 1 : b + 1].min() for a, b in zip(at[:-1], at[1:])], np.uint8)
    return place[at] // digits, np.concatenate((np.zeros(1, np.int64), least.astype(np.int64) // digits))


def common(text: np.ndarray, a: np.ndarray, b: np.ndarray, most: np.ndarray, bits: int = 16) -> np.ndarray:
    """Symbols that suffixes of ``text`` (ends in its only 0) share, up to ``most``; eight bytes are compared at a time."""
    kind = f"<u{bits // 8}"
    four = np.ndarray(len(text), "<u8", text.astype(kind).tobytes() + bytes(8), strides=(bits // 8,))
    out, live = np.zeros(len(a), np.int64), np.flatnonzero(most > 0)
    while len(live):
        x = four[a[live] + out[live]] ^ four[b[live] + out[live]]
        out[live] += sum(((x << np.uint64(s)) == 0).astype(np.int64) for s in range(bits, 64, bits)) + (x == 0)
        live = live[(x == 0) & (out[live] < most[live])]
    return np.minimum(out, most)


def suffix_order(text: np.ndarray, symbols: int, cap: int, memory: int = MEMORY) -> tuple[np.ndarray, np.ndarray]:
    """(places, shared): the suffixes of ``text`` in order, and the prefix each shares with the
    one before, up to ``cap`` (at most 200). ``text`` ends in its only 0; symbols have 16 bits."""
    n = len(text)
    if n == 1:
        return np.zeros(1, np.int32), np.zeros(1, np.uint8)
    text = text.astype(np.int32)
    small = is_small(text)
    lms = np.flatnonzero(small[1:] & ~small[:-1]).astype(np.int32) + 1
    rough = lms[np.argsort(text[lms], kind="stable")]
    place, _ = induce(text, small, rough, np.zeros(len(lms), np.uint8), symbols, cap, memory)
    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    ordered = place[is_lms[place]]
    del place
    # names: equal substrings from one LMS place to the next are neighbours now
    index = np.zeros(n, np.int32)
    index[lms] = np.arange(len(lms))
    rank = index[ordered]
    length = np.append(lms[1:], n - 1) - lms + 1
    new = np.ones(len(lms), bool)
    twin = np.flatnonzero(length[rank[1:]] == length[rank[:-1]])
    size = length[rank[twin]].astype(np.int64)
    new[twin + 1] = common(text, ordered[twin], ordered[twin + 1], size) < size
    base = np.zeros(len(lms), np.int64)
    if not new.all():
        name = np.zeros(len(lms), np.int64)
        name[rank] = np.cumsum(new) - 1
        rank, equal = _order_of_names(name, int(new.sum()), memory)
        base = (np.append(lms, n - 1)[np.minimum(rank + equal, len(lms))] - lms[rank]).astype(np.int64)
    # what a pair shares: its equal names, as the recursion found them, and the start of the first different ones
    ordered, base = lms[rank], np.minimum(base, cap)
    shared = base.copy()
    shared[1:] += common(text, ordered[:-1] + base[1:], ordered[1:] + base[1:], cap - base[1:])
    return induce(text, small, ordered, shared.astype(np.uint8), symbols, cap, memory)
