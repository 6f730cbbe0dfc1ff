"""Packing documents into token sequences by bin completion over the histogram of lengths.

Pieces have integer lengths up to the capacity, so what decides the packing is how many pieces
have each length: at most ``capacity`` numbers, however many documents there are. That histogram
is all the driver sees. Best-fit decreasing gives the first incumbent; a filling is applied to as many
bins as the counts allow at once, so the plan has some thousands of lines. A branch-and-bound search then
repacks the wasteful bins into one fewer, again and again: it completes the bin around the largest remaining
length with undominated fillings, pruned by the waste that the incumbent less one bin would leave.

Spark then numbers the pieces of each length (salted by their number, so that a common length is not
one task) and looks each number's place up in the plan.

Defined results: a null text is the empty text, which still holds the end id; repeated rows are
packed as often as they occur; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from bisect import bisect_right, insort
from collections import Counter
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .staging import Stage

CAPACITY = 1024
END_ID = 2
#: Pieces of one length that one task sorts and numbers, about.
NUMBERED = 200_000
#: More than there are pieces of one length.
FAR = 1 << 48
#: Wasteful bins that a search empties at most, and how many full ones it empties too, search by search.
MOST_TAIL, TAILS = 2_000, (0, 30, 100, 300, 1_000)
#: Words whose ids a task remembers.
REMEMBERED = 400_000

#: Texts of these characters may be cut by Python's own regular expressions as the tokenizer cuts them.
_PLAIN = re.compile(r"[\t-\r\x20-\x7EÀ-ÖØ-öø-ÿ]*")
_L = "A-Za-zÀ-ÖØ-öø-ÿ"
_WORDS = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[0-9]+| ?[^\t-\r\x20{_L}0-9]+|[\t-\r\x20]+(?![^\t-\r\x20])|[\t-\r\x20]+")


def _by_rank(path: str):
    """The tokenizer file's byte pairs in a faster encoder for single words; None unless its ids follow its merges."""
    import tiktoken

    model = json.loads(Path(path).read_text())["model"]
    vocab = model["vocab"]
    joined = [vocab["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
    if joined != sorted(joined):
        return None
    # byte-level alphabets write printable bytes as themselves and number the others from 256 on
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in printable]
    byte = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(hidden)}
    top = max(joined)
    ranks = {bytes(byte[c] for c in t): i for t, i in vocab.items() if all(c in byte for c in t) and i <= top}
    return tiktoken.Encoding("words", pat_str=r"(?s).+", mergeable_ranks=ranks, special_tokens={})


class Tokens(dict):
    """Ids of a text as little-endian 32-bit bytes; plain texts are put together from remembered words."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        #: Texts that hold one of these are the tokenizer's own matter.
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.by_rank = _by_rank(path)

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def __missing__(self, word: str) -> bytes:
        ids = array("I", self.by_rank.encode_ordinary(word)).tobytes() if self.by_rank else self.whole(word)
        if len(self) < REMEMBERED and len(word) < 64:
            self[word] = ids
        return ids

    def ids(self, text: str) -> bytes:
        if _PLAIN.fullmatch(text) and not any(t in text for t in self.added):
            return b"".join(map(self.__getitem__, _WORDS.findall(text)))
        return self.whole(text)


_loaded: dict[str, Tokens] = {}


def tokens(path: str) -> Tokens:
    if path not in _loaded:
        _loaded[path] = Tokens(path)
    return _loaded[path]


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: only the first may be shorter than the capacity."""
    first = n % capacity or min(n, capacity)
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 for every document (doc_id, text)."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokens(tokenizer)
        end = np.array([END_ID], "<u4").tobytes()
        for b in batches:
            of, piece, start, length, crc = [], [], [], [], []
            for i, text in enumerate(b.column("text")):
                ids = own.ids(text.as_py() or "") + end
                for k, (s, n) in enumerate(cut(len(ids) // 4, capacity)):
                    of.append(i)
                    piece.append(k)
                    start.append(s)
                    length.append(n)
                    crc.append(zlib.crc32(memoryview(ids)[4 * s : 4 * (s + n)]))
            ids = b.column("doc_id").take(pa.array(of, pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, pa.array(piece, pa.int32()), *[pa.array(x, pa.int64()) for x in (start, length, crc)]], ["doc_id", "piece", "start", "length", "ids_crc32"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(made, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def lower_bound(count: dict[int, int], capacity: int) -> int:
    """Bins that any packing needs: the best of the volume bound and of big items counted alone."""
    best = -(-sum(s * n for s, n in count.items()) // capacity)
    for k in sorted({s for s in count if 2 * s <= capacity} | {0}):
        big = sum(n for s, n in count.items() if s > capacity - k)
        middle = {s: n for s, n in count.items() if capacity - k >= s and 2 * s > capacity}
        small = sum(s * n for s, n in count.items() if k <= s and 2 * s <= capacity)
        free = sum(n * (capacity - s) for s, n in middle.items())
        best = max(best, big + sum(middle.values()) + max(0, -(-(small - free) // capacity)))
    return best


def best_fit(count: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing as (lengths, bins): each bin takes the largest length that still fits, again and again."""
    left, sizes, plan = dict(count), sorted(s for s, n in count.items() if n), []
    while sizes:
        bin_, room = [], capacity
        own: dict[int, int] = {}
        at = len(sizes)
        while (at := bisect_right(sizes, room, 0, at)) > 0:
            s = sizes[at - 1]
            take = min(left[s] - own.get(s, 0), room // s)
            if take > 0:
                bin_ += [s] * take
                own[s] = own.get(s, 0) + take
                room -= s * take
            at -= 1
        _apply(left, sizes, bin_, plan)
    return plan


def _apply(left: dict[int, int], sizes: list[int], bin_: list[int], plan: list) -> int:
    """Fill as many bins with these lengths as the counts allow."""
    uses = {s: bin_.count(s) for s in set(bin_)}
    times = min(left[s] // n for s, n in uses.items())
    for s, n in uses.items():
        left[s] -= n * times
        if not left[s]:
            sizes.remove(s)
    plan.append((tuple(bin_), times))
    return times


def fillings(left: dict[int, int], sizes: list[int], room: int, most: int, tries: int = 400) -> list[tuple[int, ...]]:
    """Undominated fillings of ``room``, least waste first, larger lengths first.

    A filling to which a remaining length could be added, or in which a length could be exchanged
    for a larger one that fits, is dominated. ``tries`` bounds the partial fillings looked at for
    one bin; a search that it ends goes on with the best fillings found.
    """
    found: list[tuple[int, tuple[int, ...]]] = []
    state = [tries]

    def grow(at: int, room: int, chosen: tuple[int, ...]) -> None:
        if state[0] <= 0 or len(found) >= most and found[0][0] == 0:
            return
        state[0] -= 1
        top = bisect_right(sizes, room, 0, at)
        grown = False
        for j in range(top - 1, -1, -1):
            s = sizes[j]
            if chosen.count(s) < left[s]:
                grown = True
                grow(j + 1, room - s, (*chosen, s))
                if state[0] <= 0 or found and found[0][0] == 0 and len(found) >= most:
                    return
                if room - s == 0:  # an exact fit by one length dominates all smaller ones here
                    return
        if not grown:
            found.append((room, chosen))
            found.sort(key=lambda x: x[0])
            del found[most * 4 :]

    grow(len(sizes), room, ())
    out = []
    for waste, f in found:
        spare = [s for s in set(f) if (k := bisect_right(sizes, s + waste)) and any(f.count(t) < left[t] and t > s for t in sizes[bisect_right(sizes, s) : k])]
        if not spare:
            out.append(f)
    return (out or [f for _, f in found[:1]])[:most]


def complete(count: dict[int, int], capacity: int, most: int, nodes: int, branch: int = 3) -> list[tuple[int, ...]] | None:
    """At most ``most`` bins that hold all pieces, by depth-first bin completion of one bin a node; None if
    there are none, or none were found in ``nodes`` nodes. Waste beyond what ``most`` bins leave prunes a branch."""
    left, sizes = dict(count), sorted(count)
    spare = most * capacity - sum(s * n for s, n in count.items())

    def options() -> list[tuple[int, ...]]:
        largest = sizes[-1]
        own = left | {largest: left[largest] - 1}
        rest = sizes if own[largest] else sizes[:-1]
        return [(largest, *f) for f in fillings(own, rest, capacity - largest, branch)]

    plan: list[tuple[int, ...]] = []
    todo = [options()]
    while sizes or spare < 0:
        if spare < 0 or not todo[-1]:
            todo.pop()
            if not plan:
                return None
            for s in plan[-1]:
                if not left[s]:
                    insort(sizes, s)
                left[s] += 1
            spare += capacity - sum(plan.pop())
            continue
        if nodes <= 0:
            return None
        nodes -= 1
        plan.append(todo[-1].pop(0))
        for s in plan[-1]:
            left[s] -= 1
            if not left[s]:
                sizes.remove(s)
        spare -= capacity - sum(plan[-1])
        todo.append(options() if sizes and spare >= 0 else [])
    return plan


def bin_completion(count: dict[int, int], capacity: int, nodes: int = 4_000) -> list[tuple[tuple[int, ...], int]]:
    """A plan [(lengths of a bin, number of such bins)] for the counts of each length.

    Best-fit decreasing is the first incumbent, and what it fills without waste stays. Its most wasteful bins,
    and so many of its full bins of many pieces as ``TAILS`` says, are emptied; bin completion looks for a packing of
    their pieces that needs a bin less, until the lower bound is met or no tail gives one. ``nodes`` bounds
    each search, not the result: the incumbent is a whole packing at all times.
    """
    count = {s: n for s, n in count.items() if n}
    if not count:
        return []
    bound, plan = lower_bound(count, capacity), Counter()
    for bin_, times in best_fit(count, capacity):
        plan[tuple(sorted(bin_, reverse=True))] += times

    def emptied(bins: list[tuple[int, ...]], most: int) -> Counter:
        out = Counter()
        for b in bins:
            if out.total() >= most:
                break
            out[b] = min(plan[b], most - out.total())
        return out

    tails = list(TAILS)
    while tails and plan.total() > bound:
        wasteful = emptied(sorted((b for b in plan if sum(b) < capacity), key=lambda b: (sum(b), b)), MOST_TAIL)
        full = emptied(sorted((b for b in plan if sum(b) == capacity and len(b) > 1), key=lambda b: (-len(b), b)), tails[0])
        own = Counter()
        for b, times in (wasteful + full).items():
            for s in b:
                own[s] += times
        n = (wasteful + full).total()
        better = complete(own, capacity, n - 1, nodes + 2 * n) if n else None
        if better is None:
            tails.pop(0)
            continue
        plan = plan - wasteful - full + Counter(better)
    return sorted(plan.items(), reverse=True)


def pack(parts: DataFrame, stage: Stage, capacity: int = CAPACITY, nodes: int = 4_000) -> DataFrame:
    """``parts`` (with a length column) plus sequence_id and offset."""
    spark = parts.sparkSession
    order = parts.columns  # rows equal in all columns may change places
    histogram = {r.length: r.n for r in parts.groupBy("length").agg(F.count("*").alias("n")).collect()}  # capacity rows at most
    plan = bin_completion(histogram, capacity, nodes)
    lines, used, sequence = [], {}, 0
    for lengths, bins in plan:
        offset = 0
        for s in lengths:
            lo = used.get(s, 0)
            lines.append((s, lo, sequence - lo, offset))
            used[s] = lo + bins
            offset += s
        sequence += bins
    # a line says where the pieces of one length from number lo on go; its size is bounded by the capacity
    table = np.array(sorted(lines), np.int64).reshape(-1, 4)
    sent = spark.sparkContext.broadcast((table[:, 0] * FAR + table[:, 1], table[:, 2], table[:, 3]))
    salts = F.element_at(F.array(*[F.lit(-(-histogram.get(k, 0) // NUMBERED) or 1) for k in range(1, capacity + 1)]), F.col("length").cast("int"))
    salted = parts.withColumn("salt_", F.pmod(F.xxhash64(*order), salts))
    counted = stage.put("lengths", salted.groupBy("length", "salt_").agg(F.count("*").alias("n")))
    base = counted.withColumn("base_", F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("salt_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    rank = F.row_number().over(Window.partitionBy("length", "salt_").orderBy(*order)) - 1
    numbered = salted.withColumn("row_", rank).join(base, ["length", "salt_"])
    numbered = numbered.select(*order, (F.col("base_") + F.col("row_")).cast("long").alias("at_"))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, shift, offset = sent.value
        for b in batches:
            at = b.column("at_").to_numpy()
            line = np.searchsorted(first, b.column("length").to_numpy().astype(np.int64) * FAR + at, "right") - 1
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in order], pa.array(at + shift[line]), pa.array(offset[line])], [*order, "sequence_id", "offset"])

    schema = T.StructType([*parts.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    return numbered.mapInArrow(placed, schema)
