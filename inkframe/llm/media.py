"""A content-addressed media store: chunking by gear hash, dedup by digest, verified reading.

Each text's payload (its UTF-8 bytes, padded) is one grey image in PGM form, 576 samples a row. A
rolling gear hash cuts the image's bytes where its leading bits are zero, so equal stretches are
cut alike wherever they stand. A chunk is stored once, under its digest; an image is the ordered
list of its chunks' digests, a document is its image's digest. Reading takes the stored chunks,
puts them together in order, verifies chunk and image digests and decodes the image.

Images of one chunk, most of them, are read where their chunk lies; only the chunks of longer
images are shuffled to their image. Digests are grouped before bytes move, and one image in a
third of all documents is read once.

Defined results: a null text is the empty text, whose payload is one row of padding; repeated rows
get equal results; an empty table gives an empty result; a chunk or image that does not match its
digest raises an error.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import mixed
from .staging import Stage

WIDTH = 576
PAD = b"\xff"  # occurs in no UTF-8 text
#: Chunk sizes: least, average beyond the least, most.
LEAST, AVERAGE, MOST = 4096, 16384, 65536
GEAR = (mixed(np.arange(1, 257, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)


def payload_of(text: str | None) -> bytes:
    raw = (text or "").encode("utf-8", "surrogatepass")
    rest = -len(raw) % WIDTH if raw else WIDTH
    return raw + PAD * rest


def encoded(payload: bytes) -> bytes:
    return b"P5\n%d %d\n255\n" % (WIDTH, len(payload) // WIDTH) + payload


def decoded(image: bytes) -> bytes:
    kind, size, top, payload = image.split(b"\n", 3)
    width, height = map(int, size.split())
    if kind != b"P5" or top != b"255" or width * height != len(payload):
        raise ValueError("not an 8-bit PGM image")
    return payload


def cuts(data: bytes) -> list[int]:
    """Ends of the chunks of ``data``."""
    n = len(data)
    if n <= LEAST:
        return [n]
    h = GEAR[np.frombuffer(data, np.uint8)]
    for s in (1, 2, 4, 8, 16):  # h[i] = sum of gear[data[i - j]] << j over 32 bytes
        h[s:] += h[:-s] << np.uint32(s)
    good = np.flatnonzero((h >> np.uint32(32 - AVERAGE.bit_length() + 1)) == 0) + 1
    out, at = [], 0
    while n - at > LEAST:
        k = int(np.searchsorted(good, at + LEAST))
        end = min(int(good[k]) if k < len(good) else n, at + MOST, n)
        out.append(end)
        at = end
    if at < n:
        out.append(n)
    return out


def _images(batch: pa.RecordBatch) -> Iterator[tuple[int, bytes, list[int]]]:
    for i, text in enumerate(batch.column("text")):
        image = encoded(payload_of(text.as_py()))
        yield i, image, cuts(image)


def manifest(docs: DataFrame) -> DataFrame:
    """(doc_id, image, chunks): the image's digest and its chunks' digests in order."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            image, chunks = [], []
            for _, data, ends in _images(b):
                image.append(hashlib.sha256(data).digest())
                chunks.append([hashlib.sha256(data[x:y]).digest() for x, y in zip([0, *ends], ends)] if len(ends) > 1 else [image[-1]])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(image, pa.binary()), pa.array(chunks, pa.list_(pa.binary()))], ["doc_id", "image", "chunks"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(made, f"doc_id {kind}, image binary, chunks array<binary>")


def chunk_store(docs: DataFrame) -> DataFrame:
    """(digest, packed, alone, part): each chunk once; whether it is a whole image, or part of one."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=3)
        seen: set[bytes] = set()
        for b in batches:
            rows: list[tuple] = []
            for _, data, ends in _images(b):
                for x, y in zip([0, *ends], ends):
                    digest = hashlib.sha256(data[x:y]).digest()
                    if (key := digest[:12] + bytes([len(ends) > 1])) in seen:
                        continue
                    if len(seen) < 200_000:
                        seen.add(key)
                    rows.append((digest, squeeze.compress(data[x:y]), len(ends) == 1, len(ends) > 1))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 4, [pa.binary(), pa.binary(), pa.bool_(), pa.bool_()])], ["digest", "packed", "alone", "part"])

    rows = docs.select("doc_id", "text").mapInArrow(made, "digest binary, packed binary, alone boolean, part boolean")
    return rows.groupBy("digest").agg(F.first("packed").alias("packed"), F.max("alone").alias("alone"), F.max("part").alias("part"))


def feature(payload: bytes) -> str:
    """Mean, spread, vertical and horizontal contrast of the samples, and their histogram in 16 bins."""
    a = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH).astype(np.int16)
    down = np.abs(np.diff(a, axis=0)).mean() if len(a) > 1 else 0.0
    bins = np.bincount(a.ravel() >> 4, minlength=16)
    return f"mean={a.mean():.3f};std={a.std():.3f};dy={down:.3f};dx={np.abs(np.diff(a, axis=1)).mean():.3f};hist=" + ",".join(map(str, bins.tolist()))


RESULT = "image binary, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _read_back(images: Iterator[tuple[bytes, bytes]]) -> pa.RecordBatch:
    rows = []
    for digest, data in images:
        found = hashlib.sha256(data)
        if found.digest() != digest:
            raise ValueError(f"stored image {digest.hex()} does not match its digest")
        payload = decoded(data)
        rows.append((digest, len(payload.rstrip(PAD)), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(data), found.hexdigest(), feature(payload)))
    kinds = [pa.binary(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    names = [x.split()[0] for x in RESULT.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 8, kinds)], names)


def read_back(store: DataFrame, longer: DataFrame) -> DataFrame:
    """RESULT for every image: those that are one chunk, and ``longer`` (image, chunks)."""

    def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield _read_back((d.as_py(), zstandard.decompress(p.as_py())) for d, p in zip(b.column("digest"), b.column("packed")))

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield _read_back((d.as_py(), b"".join(zstandard.decompress(p["packed"]) for p in c.as_py())) for d, c in zip(b.column("image"), b.column("parts")))

    places = longer.select("image", F.posexplode("chunks").alias("place", "digest"))
    parts = places.join(store.filter("part").select("digest", "packed"), "digest")
    whole = parts.groupBy("image").agg(F.sort_array(F.collect_list(F.struct("place", "packed"))).alias("parts"))
    return store.filter("alone").select("digest", "packed").mapInArrow(alone, RESULT).union(whole.mapInArrow(joined, RESULT))


def stored_and_read(docs: DataFrame) -> DataFrame:
    """Store every text as media, read it back and return one row a document."""
    stage = Stage(docs.sparkSession, "media")
    lists = stage.put("manifest", manifest(docs))
    store = stage.put("chunks", chunk_store(docs))
    longer = lists.filter(F.size("chunks") > 1).groupBy("image").agg(F.first("chunks").alias("chunks"))
    read = stage.put("read", read_back(store, longer))
    found = lists.select("doc_id", "image").join(read, "image", "left")
    return found.select("doc_id", *[c.split()[0] for c in RESULT.split(", ")[1:]])
