"""Language ID by language-bitmask n-gram filters (bit-sliced Bloom filters).

Training counts the letter trigrams of every labelled text per language, as a Spark aggregation
over the whole corpus. A trigram belongs to a language if it is common enough there
(``MIN_SHARE`` of the language's trigrams) and not much rarer than in the language that uses it
most (``RATIO``). Each slot of the filter holds one bit a language; a lookup ANDs
the slots of a trigram and so returns all its languages at once. A text's hits per language,
less the hits that false positives explain, decide.

A language has at most 1 / MIN_SHARE trigrams whatever the corpus's size, and the filter has ROOM slots for
each trigram of the language that has most: MOST_SLOTS 64-bit masks (64 MB) for each 64 languages at most, so it
may be collected and sent to the tasks.

Defined results: ``und`` with score 0 for a null text or one without letters, and for all texts if
nothing was learned; equal scores go to the language first by code point; repeated rows count as
often as they occur; extra columns pass through ``predict`` untouched.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .blocks import mixed, steps

#: Slots for each trigram of the language that has most; at least, and at most.
ROOM, LEAST_SLOTS, MOST_SLOTS = 10, 1 << 16, 1 << 23
PROBES = 3
MIN_SHARE = 2e-6
RATIO = 0.2
_letters: list[np.ndarray] = []


def letter_table() -> np.ndarray:
    if not _letters:
        _letters.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _letters[0]


def trigrams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed trigrams of the words' lower-case letters, with word ends, and the text each is from."""
    low = [(t or "").lower() for t in texts]
    code = np.frombuffer(("\n" + "\n".join(low) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.cumsum([len(t) + 1 for t in low])
    letter = letter_table()[code]
    keep = letter.copy()
    keep[0] = True
    keep[1:] |= letter[:-1]  # one mark after each word
    at = np.flatnonzero(keep)
    c = np.where(letter[at], code[at], 0).astype(np.uint64)
    middle = np.flatnonzero(c[1:-1]) + 1
    gram = (c[middle - 1] << np.uint64(42)) | (c[middle] << np.uint64(21)) | c[middle + 1]
    return mixed(gram), np.searchsorted(ends, at[middle])


def slots_of(gram: np.ndarray, slots: int) -> list[np.ndarray]:
    step = (gram >> np.uint64(32)) | np.uint64(1)
    return [((gram + np.uint64(i) * step) & np.uint64(slots - 1)).astype(np.int64) for i in range(PROBES)]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: dict[str, list] = {}

    def folded(parts: list) -> list:
        gram, where = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        return [(gram, np.bincount(where, np.concatenate([p[1] for p in parts]), len(gram)))]

    for batch in batches:
        langs = batch.column("lang").to_pylist()
        for lo, hi, texts in steps(batch):
            gram, doc = trigrams(texts)
            own = np.array(langs[lo:hi], object)
            for lang in set(langs[lo:hi]):
                some = gram[(own == lang)[doc]]
                parts = seen.setdefault(lang, [])
                parts.append(np.unique(some, return_counts=True))
                if len(parts) >= 16:
                    parts[:] = folded(parts)
    for lang, parts in seen.items():
        gram, n = folded(parts)[0]
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(gram), pa.string()), pa.array(gram.view(np.int64)), pa.array(n.astype(np.int64))], ["lang", "gram", "n"])


@dataclass
class Model:
    langs: list[str]
    masks: np.ndarray  # one row for each 64 languages, in it one 64-bit mask a slot
    false_rate: np.ndarray  # of each language


def train(labelled: DataFrame, slots: int | None = None) -> Model:
    """Learn from all rows (lang, text) of ``labelled`` that have both."""
    grams = (
        labelled.filter("lang is not null and text is not null").select("lang", "text")
        .mapInArrow(_counted, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    )
    # one table a model: totals and masks come from the same counts
    by_gram = grams.groupBy("gram").agg(F.collect_list(F.struct("lang", "n")).alias("of"))
    by_gram = by_gram.persist()
    try:
        totals = {r.lang: r.n for r in by_gram.select(F.explode("of").alias("o")).groupBy("o.lang").agg(F.sum("o.n").alias("n")).collect()}  # one row a language
        langs = sorted(totals)
        masks = np.zeros((1, LEAST_SLOTS), np.uint64)
        if langs:
            total = F.create_map(*[x for k in langs for x in (F.lit(k), F.lit(float(totals[k])))])
            shares = F.transform("of", lambda o: F.struct(o["lang"].alias("lang"), (o["n"] / total[o["lang"]]).alias("share")))
            own = by_gram.select("gram", shares.alias("s")).withColumn("top", F.array_max(F.transform("s", lambda x: x["share"])))
            own = own.select("gram", F.filter("s", lambda x: (x["share"] >= MIN_SHARE) & (x["share"] >= RATIO * F.col("top"))).alias("s"))

            if slots is None:
                most = own.select(F.explode("s").alias("o")).groupBy("o.lang").count().agg(F.max("count")).first()[0] or 1
                slots = min(MOST_SLOTS, max(LEAST_SLOTS, 1 << (ROOM * most - 1).bit_length()))
            masks = np.zeros((-(-len(langs) // 64), slots), np.uint64)

            def slotted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for b in batches:
                    at = slots_of(b.column("gram").to_numpy(zero_copy_only=False).view(np.uint64), slots)
                    mask = b.column("mask").to_numpy(zero_copy_only=False)
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(at)), pa.array(np.tile(mask, PROBES))], ["slot", "mask"])

            for w, word in enumerate(masks):
                bit = F.create_map(*[x for i, k in enumerate(langs[64 * w : 64 * w + 64]) for x in (F.lit(k), F.lit(int(np.uint64(1 << i).view(np.int64))))])
                some = own.select("gram", F.aggregate("s", F.lit(0).cast("long"), lambda a, x: a.bitwiseOR(F.coalesce(bit[x["lang"]], F.lit(0).cast("long")))).alias("mask")).filter("mask <> 0")
                got = some.mapInArrow(slotted, "slot long, mask long").groupBy("slot").agg(F.bit_or("mask").alias("mask")).toArrow()  # a row a slot
                word[got["slot"].to_numpy()] = got["mask"].to_numpy().view(np.uint64)
    finally:
        by_gram.unpersist()
    fill = np.array([np.mean((masks[i // 64] >> np.uint64(i % 64)) & np.uint64(1)) for i in range(len(langs))])
    return Model(langs, masks, fill**PROBES)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with lang_pred and score (the winner's share of the text's trigrams, corrected)."""
    sent = docs.sparkSession.sparkContext.broadcast((model.langs, model.masks, model.false_rate))
    names = docs.columns
    clash = {"lang_pred", "score"} & set(names)
    if clash:
        docs, names = docs.drop(*clash), [c for c in names if c not in clash]
    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, masks, false_rate = sent.value
        for batch in batches:
            pred, score = [], []
            for lo, hi, texts in steps(batch):
                gram, doc = trigrams(texts)
                n = np.bincount(doc, minlength=hi - lo)
                slots = slots_of(gram, masks.shape[1])
                best, top = np.zeros(hi - lo, np.int64), np.full(hi - lo, -1.0)
                for i in range(len(langs)):
                    if i % 64 == 0:
                        hit = np.bitwise_and.reduce([masks[i // 64][s] for s in slots])
                    c = np.bincount(doc, (hit >> np.uint64(i % 64)) & np.uint64(1), hi - lo)
                    share = np.clip((c / np.maximum(n, 1) - false_rate[i]) / max(1e-9, 1 - false_rate[i]), 0, 1)
                    more = share > top
                    best[more], top[more] = i, share[more]
                known = (n > 0) & bool(langs)
                pred += [langs[b] if k else "und" for b, k in zip(best, known)]
                score.append(np.where(known, top, 0.0))
            flat = np.concatenate(score) if score else np.empty(0)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(pred, pa.string()), pa.array(flat)], [*names, "lang_pred", "score"])

    return docs.mapInArrow(scored, schema)


def learned(doc_id: str = "doc_id") -> Column:
    """The documents that training may see; one without an id isn't among them."""
    return F.crc32(F.col(doc_id).cast("string")) % 5 != 0


def held_out(doc_id: str = "doc_id") -> Column:
    """The fifth of the documents that training never sees."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))
