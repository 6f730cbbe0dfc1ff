"""Exact deduplication: equal texts, collisions, later files, and the state of a stream."""

import hashlib

import pytest
from pyspark.sql import functions as F

from inkframe.llm import exact_dedup

SCHEMA = "doc_id long, text string, lang string, n long, keep string, digest string, file string, part long, _metadata string"
ROWS = [
    (1, "same"), (2, "same"), (3, "Same"), (4, None), (5, ""), (6, " "), (7, "same "), (None, "same"), (None, "alone"), (8, "x" * 300_000), (9, "x" * 300_000), (9, "twice"), (9, "twice"),
    (10, "é"), (11, "é"), (None, "none has one"), (None, "none has one"), *[(i, "hot") for i in range(20, 60)],
]


def brute(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    out = []
    for t, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = max(known, default=None)
        out += [(i, keep, len(ids), hashlib.sha256(t.encode()).hexdigest()) for i in ids]
    return sorted(out, key=str)


def written(spark, rows, path, files=3, mode="append"):
    df = spark.createDataFrame([(i, t, "en", 7, "k", "d", "f", 1, "m") for i, t in rows], SCHEMA)
    df.repartition(files).write.mode(mode).parquet(path)
    return path


@pytest.mark.parametrize("digest", [exact_dedup.sha256, lambda t: F.substring(exact_dedup.sha256(t), 1, 1), lambda t: F.lit("one")], ids=["sha256", "sixteen", "one"])
def test_equal_texts_even_if_digests_collide(spark, tmp_path, digest):
    got = exact_dedup.dedup(spark, written(spark, ROWS, f"{tmp_path}/documents.parquet"), digest).collect()
    assert sorted([(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got], key=str) == brute(ROWS)
    kept = [(r.doc_id, r.text_sha256) for r in got if r.kept]
    assert sorted(h for _, h in kept) == sorted({h for *_, h in brute(ROWS)})  # one row of each text, repeated rows and those without an id too
    assert all(r.doc_id == r.keep_id for r in got if r.kept)


def test_many_batches_and_hot_rows_in_many_parts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(exact_dedup, "SHARES", 5)
    rows = [(i, "hot" if i % 3 else f"t{i % 40}") for i in range(300)]
    got = exact_dedup.dedup(spark, written(spark, rows, f"{tmp_path}/documents.parquet", 6), batch_bytes=1).collect()
    assert sorted([(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got], key=str) == brute(rows)


def test_state_goes_on_with_new_files(spark, tmp_path):
    path, checkpoint = written(spark, ROWS, f"{tmp_path}/documents.parquet"), f"{tmp_path}/checkpoint"

    def run():
        q = exact_dedup.follow(spark.readStream.schema(spark.read.parquet(path).schema).parquet(path), checkpoint)
        q.awaitTermination()
        return sum(p["numInputRows"] for p in q.recentProgress), {r.digest: (r.keep.id, r.n, r.keep.file, r.keep.row) for r in exact_dedup.entries(spark, checkpoint).collect()}

    read, first = run()
    assert read == len(ROWS) and len(first) == len({t or "" for _, t in ROWS})
    same = hashlib.sha256(b"same").hexdigest()
    assert first[same][:2] == (2, 3) and first[same][2].startswith("file:") and run() == (0, first)
    written(spark, [(99, "same"), (100, "new")], path, 1)
    read, second = run()
    assert read == 2 and second[same][:2] == (99, 4) and len(second) == len(first) + 1


def test_bitmap_keeps_texts_that_repeat(spark):
    rows = spark.createDataFrame([(f"d{i}", "t") for i in range(2000)], "digest string, text string")
    state = spark.createDataFrame([(f"d{i}", 2 if i % 7 == 0 else 1) for i in range(2000)], "digest string, n long")
    got = {r.digest: r.text for r in exact_dedup._may_repeat(rows, state).collect()}
    assert len(got) == 2000 and all(got[f"d{i}"] for i in range(0, 2000, 7)) and sum(t is not None for t in got.values()) < 300


def test_empty_table_and_single_file(spark, tmp_path):
    empty = f"{tmp_path}/empty/documents.parquet"
    spark.createDataFrame([], SCHEMA).write.parquet(empty)
    df = exact_dedup.dedup(spark, empty)
    assert df.count() == 0 and df.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    written(spark, ROWS, f"{tmp_path}/one", 1)
    single = next((tmp_path / "one").glob("part-*.parquet"))
    assert exact_dedup.dedup(spark, str(single)).count() == len(ROWS)
