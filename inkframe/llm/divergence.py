"""Audit of how sources differ in their words, by DuckDB over shards of terms.

Tasks count the terms of the texts they read and write partial counts. These are dealt to shards by language and term, so a shard has
all of a term; there DuckDB adds them up and keeps the terms of enough documents. With the totals of all shards, which Spark adds,
DuckDB finds in each shard what its terms give to each pair of sources and each group's most telling terms; Spark adds the pair sums and
ranks both.

A source without a term counts it zero times, so a pair's value has a part for every kept term. Those parts are one number a pair
where both lack the term; ``PAIRS`` therefore sums, over the terms that a source has, what its value differs from that number, and Spark adds
the number once for each kept term.

There are four shards for each part that the corpus is read in, up to ``SHARDS``; DuckDB adds a shard's counts up as they come, so what it holds are the shard's
distinct terms. A task's counts go out at ``HELD`` entries, so the most frequent term has a few rows a task. They travel as one compressed block of columns for
each shard, not as a row each. Totals reach a shard by a join on its languages, not by broadcast.

Defined results: null text, lang and source are empty ones; a repeated row is a document of its own; ids are not read; a group without terms, and one of a
language without kept terms, has pairs (value 0 in the latter case) and no terms; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import io
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import duckdb
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .blocks import runs
from .staging import Stage

LEAST_DOCUMENTS, TOP = 3, 200
SHARDS, HELD, STEP = 16_384, 250_000, 1 << 20
#: Rows that DuckDB takes before it adds equal ones up, and what it may use.
FOLD, DUCK, BLOCKS_AT_ONCE = 1_500_000, "600MB", 64
SCALE = 1_000_000_000
LETTERS = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256)).lower()
#: A shard's partial counts of one task travel as one compressed block; a row without block names a group.
BLOCKS = "shard int, lang string, source string, block binary"
PACKED = pa.ipc.IpcWriteOptions(compression="zstd")


def words(text: bytes) -> Iterator[list[bytes]]:
    """A text's terms in lists of about ``STEP`` bytes."""
    text = text.translate(LETTERS)
    at = 0
    while at < len(text):
        end = len(text)
        if end - at > STEP:
            end = text.rfind(b" ", at, at + STEP)
            end = end if end >= 0 else text.find(b" ", at + STEP)
            end = end if end >= 0 else len(text)
        yield text[at:end].split()
        at = end + 1


def _blocks(seen: dict[tuple[str, str], tuple[Counter, Counter]], shards: int) -> Iterator[tuple[int, bytes]]:
    """The counts of ``seen`` by shard."""
    groups = list(seen)
    sizes = [len(n) for n, _ in seen.values()]
    flat = [t for n, _ in seen.values() for t in n]
    if not flat:
        return
    place = pa.array(np.repeat(np.arange(len(groups), dtype=np.int32), sizes))
    column = lambda k: pa.DictionaryArray.from_arrays(place, pa.array([g[k] for g in groups], pa.string()))
    numbers = lambda values: pa.array(np.fromiter(values, np.int64, len(flat)))
    whole = pa.table({
        "lang": column(0), "source": column(1), "term": pa.array(flat, pa.binary()).cast(pa.string()),
        "n": numbers(x for n, _ in seen.values() for x in n.values()), "d": numbers(d[t] for n, d in seen.values() for t in n)})
    start = np.repeat([zlib.crc32(g[0].encode()) for g in groups], sizes)
    shard = np.fromiter(map(zlib.crc32, flat, start.tolist()), np.int64, len(flat)) % shards
    order = np.argsort(shard, kind="stable")
    lo, hi = runs(shard[order])
    whole = whole.take(order)
    for i, j in zip(lo.tolist(), hi.tolist()):
        sink = io.BytesIO()
        with pa.ipc.new_stream(sink, whole.schema, options=PACKED) as writer:
            writer.write_table(whole.slice(i, j - i))
        yield int(shard[order[i]]), sink.getvalue()


def counted(shards: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Partial counts as rows of BLOCKS: occurrences and documents of each group's terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[str, str], tuple[Counter, Counter]] = {}

        def out() -> pa.RecordBatch:
            rows = [(None, *g, None) for g in seen] + [(k, None, None, block) for k, block in _blocks(seen, shards)]
            seen.clear()
            kinds = (pa.int32(), pa.string(), pa.string(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], ["shard", "lang", "source", "block"])

        size = 0
        for b in batches:
            for lang, source, text in zip(b.column("lang").to_pylist(), b.column("source").to_pylist(), b.column("text").cast(pa.binary())):
                if (lang, source) not in seen:
                    seen[lang, source] = Counter(), Counter()
                n, d = seen[lang, source]
                before, own = len(n), set()
                for some in words(text.as_py()):
                    n.update(some)
                    own.update(some)
                d.update(own)
                size += len(n) - before
                if size >= HELD:
                    yield out()
                    size = 0
        yield out()

    return run


# --- in a shard

def _duck() -> duckdb.DuckDBPyConnection:
    return duckdb.connect(config={"threads": 1, "memory_limit": DUCK, "temp_directory": "", "preserve_insertion_order": False})


def _do(con: duckdb.DuckDBPyConnection, sql: str) -> list[tuple]:
    """Run one statement to its end, so that the connection is free for the next."""
    return con.execute(sql).fetchall()


def _add(con: duckdb.DuckDBPyConnection, batch: pa.Table, *inserts: str) -> None:
    con.register("batch", batch)
    for sql in inserts:
        _do(con, sql)
    con.unregister("batch")


def _insert(con: duckdb.DuckDBPyConnection, held: list[pa.Table]) -> int:
    """Put the rows of some blocks into the table of counts."""
    if not held:
        return 0
    rows = pa.concat_tables(held)
    held.clear()
    _add(con, rows, "INSERT INTO counts SELECT lang, source, term, n, d FROM batch")
    return rows.num_rows


def _rows(con: duckdb.DuckDBPyConnection, sql: str) -> Iterator[pa.RecordBatch]:
    yield from con.sql(sql).to_arrow_reader(100_000)


ADDED = "SELECT lang, source, term, sum(n)::BIGINT AS n, sum(d)::BIGINT AS d FROM counts GROUP BY ALL"
KEPT = """
SELECT lang, source, term, n, (row_number() OVER (PARTITION BY lang, term ORDER BY source) = 1)::INT AS first
FROM counts QUALIFY sum(d) OVER (PARTITION BY lang, term) >= {least}"""


def kept(least: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From the blocks of a task's shards the counts (lang, source, term, n, first) of terms in at least ``least`` documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        con = _duck()
        _do(con, "CREATE TABLE counts (lang VARCHAR, source VARCHAR, term VARCHAR, n BIGINT, d BIGINT)")
        size, held = 0, []
        for block in (x for b in batches for x in b.column("block")):
            held.append(pa.ipc.open_stream(block.as_buffer()).read_all())
            if len(held) < BLOCKS_AT_ONCE:
                continue
            size += _insert(con, held)
            if size >= FOLD:
                _do(con, f"CREATE OR REPLACE TABLE counts AS {ADDED}")
                size = _do(con, "SELECT count(*) FROM counts")[0][0] // 2
        _insert(con, held)
        _do(con, f"CREATE OR REPLACE TABLE counts AS {ADDED}")
        yield from _rows(con, KEPT.format(least=least))
        con.close()

    return run


# p and z: a group's share of a term, and of a term that it lacks; q: the language's share
CELLS = f"""CREATE TABLE cells AS
SELECT k.lang, k.source, k.term, (1 + ({SCALE}::HUGEINT * (k.n + 1)) // (g.total + g.terms))::BIGINT AS p, g.z,
       (1 + ({SCALE}::HUGEINT * (sum(k.n) OVER (PARTITION BY k.lang, k.term) + 1)) // (g.lang_total + g.terms))::BIGINT AS q
FROM k JOIN g USING (lang, source)"""
FAR = "CREATE MACRO far(p, q) AS ((p - q) * (p - q)) // q"
PAIRS = """
SELECT 'pair' AS part, lang, source, item, sum(v)::DECIMAL(38, 0) AS value FROM (
  SELECT a.lang, a.source, b.source AS item, sum(far(a.p, b.p) - far(a.p, b.z) - far(a.z, b.p) + far(a.z, b.z)) AS v
  FROM cells a JOIN cells b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
  UNION ALL
  SELECT h.lang, h.source, g.source, sum(m * (far(h.p, g.z) - far(h.z, g.z))) FROM h JOIN g ON h.lang = g.lang AND h.source <> g.source GROUP BY ALL
  UNION ALL
  SELECT h.lang, g.source, h.source, sum(m * (far(g.z, h.p) - far(g.z, h.z))) FROM h JOIN g ON h.lang = g.lang AND h.source <> g.source GROUP BY ALL)
GROUP BY ALL"""
TERMS = """
SELECT 'term' AS part, lang, source, term AS item, far(p, q)::DECIMAL(38, 0) AS value FROM cells WHERE p > q
QUALIFY row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) <= {top}"""


def compared(top: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From a shard's counts, and the groups of its languages (rows without term), its partial pair sums and its ``top`` terms a group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        con = _duck()
        _do(con, "CREATE TABLE k (lang VARCHAR, source VARCHAR, term VARCHAR, n BIGINT)")
        _do(con, "CREATE TABLE g0 (lang VARCHAR, source VARCHAR, total BIGINT, lang_total BIGINT, terms BIGINT, z BIGINT)")
        for b in batches:
            _add(con, pa.Table.from_batches([b]), "INSERT INTO k SELECT lang, source, term, n FROM batch WHERE term IS NOT NULL", "INSERT INTO g0 SELECT lang, source, total, lang_total, terms, z FROM batch WHERE term IS NULL")
        _do(con, "CREATE TABLE g AS SELECT DISTINCT * FROM g0")
        _do(con, FAR)
        _do(con, CELLS)
        _do(con, "CREATE TABLE h AS SELECT lang, source, p, z, count(*) AS m FROM cells GROUP BY ALL")
        yield from _rows(con, PAIRS)
        yield from _rows(con, TERMS.format(top=top))
        con.close()

    return run


def audit(docs: DataFrame, least: int = LEAST_DOCUMENTS, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank): for each group the other sources by distance, and its most telling terms."""
    spark, stage = docs.sparkSession, Stage(docs.sparkSession, "divergence")
    texts = docs.select(*[F.coalesce(docs[c], F.lit("")).alias(c) for c in ("lang", "source", "text")])
    # the more parts a corpus is read in, the more shards, as long as a block has some rows
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(SHARDS, 4 * texts.rdd.getNumPartitions()))
    counts = stage.put("counts", texts.mapInArrow(counted(shards), BLOCKS))
    groups = counts.filter("block is null").select("lang", "source").distinct()
    by_term = counts.filter("block is not null").select("shard", "block").repartition(shards, "shard").mapInArrow(kept(least), "lang string, source string, term string, n long, first int")
    terms = stage.put("kept", by_term.withColumn("shard", F.spark_partition_id()))

    # totals: a group's occurrences of kept terms, its language's, and how many terms its language keeps
    own = terms.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.sum("first").alias("terms"))
    whole = Window.partitionBy("lang")
    totals = groups.join(own, ["lang", "source"], "left").fillna(0, ["total", "terms"])
    totals = totals.withColumns({"lang_total": F.sum("total").over(whole), "terms": F.sum("terms").over(whole)})
    totals = stage.put("totals", totals.withColumn("z", F.expr(f"1 + {SCALE} div greatest(1, total + terms)")))

    at = terms.select("shard", "lang").distinct().join(totals, "lang")
    both = terms.drop("first").unionByName(at, allowMissingColumns=True).repartition(shards, "shard")
    found = stage.put("found", both.drop("shard").mapInArrow(compared(top), "part string, lang string, source string, item string, value decimal(38,0)").withColumn("salt", F.spark_partition_id() % 64))

    other = totals.select("lang", F.col("source").alias("item"), F.col("z").alias("other"))
    apart = F.expr("((z - other) * (z - other)) div other").cast("decimal(38,0)") * F.col("terms").cast("decimal(20,0)")
    base = totals.join(other, "lang").filter("source <> item").select("lang", "source", "item", apart.cast("decimal(38,0)").alias("value"))
    sums = base.unionByName(found.filter("part = 'pair'").select("lang", "source", "item", "value")).groupBy("lang", "source", "item").agg(F.sum("value").cast("long").alias("value"))
    order = (F.desc("value"), F.asc("item"))
    some = found.filter("part = 'term'").withColumn("value", F.col("value").cast("long"))
    some = some.withColumn("k", F.row_number().over(Window.partitionBy("lang", "source", "salt").orderBy(*order))).filter(F.col("k") <= top)
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(*order))
    best = some.withColumn("rank", rank).filter(F.col("rank") <= top)
    out = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")
    result = stage.put("result", out(sums.withColumn("rank", rank), "pair").unionByName(out(best, "term")))
    stage.drop("counts", "kept", "totals", "found")
    return result
