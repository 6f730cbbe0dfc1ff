"""The operators on small tables: nulls, empty and long texts, ties, repeated rows, extra columns, empty tables."""

import hashlib
import random
import re

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from inkframe.llm import ann, byte_dedup, html_extract, language_id, media, mixing, near_dedup, packing, queries, substring_dedup, url_filter
from inkframe.llm.components import components
from inkframe.llm.staging import Stage

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [a + b for a in ("al", "be", "co", "du", "en", "fi", "go") for b in ("ra", "ti", "mo", "ne", "su")]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randint(0, 99)) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(11)
    base, passage, line = prose(rng, 120), prose(rng, 35), prose(rng, 6)
    texts = [base, base, None, "", "   \n", "***", "***", "one two", "one two", passage, prose(rng, 40) + "\n" + passage + " " + prose(rng, 30), prose(rng, 25) + " " + passage, line, line + "\n" + prose(rng, 50), line + " " + prose(rng, 30), prose(rng, 4000)]
    near = base.split(" ")
    near[60] = "changed"
    texts += [" ".join(near), " ".join(["go"] * 90), "é" * 260, "x" * 99, "x" * 100, prose(rng, 20) + "\x0b" + passage.replace(" ", "\t")]
    texts += [texts[15][200:9000], passage + " " + passage]
    rows = [(i, t, "en", f"s{i % 3}" if i % 7 else None, len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def variants(spark, docs):
    """The table, with every row twice, with extra columns, empty."""
    extra = docs.withColumns({c: F.lit(7) for c in ("id", "g", "hash", "key", "bucket", "length", "score", "class_id", "size", "part", "offset")})
    return {"plain": docs, "repeated": docs.unionAll(docs), "extra": extra, "empty": docs.limit(0)}


def rows_of(df, *keys):
    return sorted(tuple(r) for r in df.select(*keys).collect())


def removed(texts, split, join, n):
    """Brute force: for (doc_id, text) in order, which units lie in a window of n that starts earlier."""
    seen, out = set(), {}
    for i, t in sorted(texts):
        units = split(t or "")
        gone = [False] * len(units)
        for p in range(len(units) - n + 1):
            w = join(units[p : p + n])
            if w in seen:
                gone[p : p + n] = [True] * n
            seen.add(w)
        out[i] = units, gone
    return out


@pytest.mark.parametrize("kind", ["plain", "repeated", "extra", "empty"])
def test_substring_dedup(spark, docs, kind):
    df = variants(spark, docs)[kind]
    want = []
    found = removed([(r.doc_id, r.text) for r in docs.collect()], lambda t: re.findall(r"[^\x20\x09-\x0D]+", t), tuple, 20)
    for i, (w, gone) in found.items():
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        want.append((i, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    want = {"repeated": want * 2, "empty": []}.get(kind, want)
    assert rows_of(substring_dedup.digests(df), "doc_id", "n_words", "n_removed", "kept_sha256") == sorted(want)
    cut = substring_dedup.without_repeats(df)
    assert cut.columns == df.columns
    if kind == "plain":
        for r, before in zip(cut.orderBy("doc_id").collect(), docs.orderBy("doc_id").collect()):
            w, gone = found[r.doc_id]
            assert re.findall(r"[^\x20\x09-\x0D]+", r.text or "") == [x for x, g in zip(w, gone) if not g]
            assert (r.text == before.text) == (not any(gone)) and r.n_chars == len(r.text or "")


@pytest.mark.parametrize("kind", ["plain", "repeated", "extra", "empty"])
def test_byte_dedup(spark, docs, kind):
    want = []
    for i, (b, gone) in removed([(r.doc_id, r.text) for r in docs.collect()], str.encode, bytes, 100).items():
        spans = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        want.append((i, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    want = {"repeated": want * 2, "empty": []}.get(kind, want)
    assert rows_of(byte_dedup.digests(variants(spark, docs)[kind]), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == sorted(want)


def brute_classes(rows):
    texts = {}
    for i, t in sorted(rows):
        if t is not None:
            texts.setdefault(t, i)
    own = list(texts.items())
    doc, value, weight = near_dedup.shingles([t for t, _ in own])
    sets = [(value[doc == k], weight[doc == k]) for k in range(len(own))]
    parent = {i: i for _, i in own}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(own)):
        for b in range(a):
            if near_dedup.probability_jaccard(sets[a], sets[b]) >= 0.8:
                x, y = sorted((root(own[a][1]), root(own[b][1])))
                parent[y] = x
    return {i: i if t is None else root(texts[t]) for i, t in rows}


@pytest.mark.parametrize("kind", ["plain", "repeated", "extra", "empty"])
def test_near_dedup(spark, docs, kind):
    want = brute_classes([(r.doc_id, r.text) for r in docs.collect()])
    assert want[16] == 0 and want[1] == 0 and want[6] == 5 and want[8] == 7
    df = variants(spark, docs)[kind]
    got = rows_of(near_dedup.classes(df), "doc_id", "class_id")
    pairs = sorted(want.items())
    assert got == {"repeated": sorted(pairs * 2), "empty": []}.get(kind, pairs)
    if kind != "empty":
        kept = near_dedup.one_of_each(df)
        assert kept.columns == df.columns and [r[0] for r in rows_of(kept, "doc_id")] == sorted(set(want.values()))


def test_near_group_whose_members_differ_from_each_other(spark):
    """Copies with changes of their own: linked to the centre or to one another, or not at all."""
    rng = random.Random(5)
    base = prose(rng, 170).split(" ")
    texts = []
    for k in range(60):
        t = list(base)
        for p in rng.sample(range(170), k % 9):
            t[p] = f"w{rng.randint(0, 40)}"
        texts.append((k, " ".join(t)))
    got = dict(rows_of(near_dedup.classes(spark.createDataFrame(texts, "doc_id long, text string")), "doc_id", "class_id"))
    assert got == brute_classes(texts)


def stored(text):
    """What the contract says of a text's payload, its image and the features read back."""
    import zlib

    raw = (text or "").encode()
    p = raw.ljust(max(576, -(-len(raw) // 576) * 576), b"\xff")
    m = b"P5\n576 " + str(len(p) // 576).encode() + b"\n255\n" + p
    rows = [p[k : k + 576] for k in range(0, len(p), 576)]
    mean = sum(p) / len(p)
    std = (sum((x - mean) ** 2 for x in p) / len(p)) ** 0.5
    dy = [abs(x - y) for a, b in zip(rows, rows[1:]) for x, y in zip(a, b)]
    dx = [abs(x - y) for a in rows for x, y in zip(a, a[1:])]
    bins = [sum(x // 16 == k for x in p) for k in range(16)]
    feature = f"mean={mean:.3f};std={std:.3f};dy={sum(dy) / max(1, len(dy)):.3f};dx={sum(dx) / len(dx):.3f};hist=" + ",".join(map(str, bins))
    return len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]), len(m), hashlib.sha256(m).hexdigest(), feature


@pytest.mark.parametrize("kind", ["plain", "repeated", "extra", "empty"])
def test_media(spark, docs, kind):
    got = rows_of(media.stored_and_read(variants(spark, docs)[kind]), "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
    want = []
    for r in docs.collect():
        want.append((r.doc_id, *stored(r.text)))
    assert got == sorted({"repeated": want * 2, "empty": []}.get(kind, want))


@pytest.mark.parametrize("kind", ["plain", "repeated", "extra", "empty"])
def test_packing(spark, docs, kind):
    import zlib

    path = public_tokenizers.path("byte_bpe_50k.json")
    df = variants(spark, docs)[kind]
    stage = Stage(spark, "test-packing")
    out = packing.pack(stage.put("pieces", packing.pieces(df, path)), stage).collect()
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    want = []
    for r in df.select("doc_id", "text").collect():
        ids = np.array([*t.encode(r.text or "", add_special_tokens=False).ids, 2], "<u4")
        want += [(r.doc_id, k, s, n, zlib.crc32(ids[s : s + n].tobytes())) for k, (s, n) in enumerate(packing.cut(len(ids), 1024))]
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out) == sorted(want)
    bins = {}
    for r in out:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in bins.values():
        at = 0
        for o, n in sorted(own):
            assert o == at
            at += n
        assert at <= 1024
    total = sum(r.length for r in out)
    assert len(bins) <= -(-total // 1024) + 1


@pytest.mark.parametrize("kind", ["plain", "repeated", "extra", "empty"])
def test_mixing_against_sql(spark, docs, kind):
    df = variants(spark, docs)[kind]
    c = duckdb.connect()
    c.register("documents", df.select("doc_id", "text", "source").toArrow())
    found = c.execute(queries.ORACLE["op7_source_mix"])
    names = [d[0] for d in found.description]
    key = lambda r: tuple(round(float(r[n]), 6) for n in sorted(names))
    want = sorted(key(dict(zip(names, r))) for r in found.fetchall())
    assert sorted(key(r) for r in mixing.mix(df).drop("source").collect()) == want


def test_mixing_targets_and_rows(spark, docs):
    got = mixing.mix(docs.unionAll(docs)).collect()
    assert got == mixing.mix(docs.unionAll(docs)).collect() or sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.mix(docs.unionAll(docs)).collect()), key=str)
    per = {}
    for r in got:
        assert 0 <= r.taken <= 2 * r.size
        per.setdefault(r.source, [0, r.target])[0] += r.taken
    assert all(taken == int(target) for taken, target in per.values())
    assert sum(t for _, t in per.values()) == pytest.approx(1.5 * sum(r.size for r in got))
    rows = mixing.mixed_rows(docs)
    assert rows.columns == docs.columns
    words = rows.agg(F.sum(mixing.n_words(F.col("text")))).first()[0]
    assert words == mixing.mix(docs).agg(F.sum("taken")).first()[0]
    assert mixing.mixed_rows(docs.limit(0)).count() == 0


def test_water_filling_caps_and_reshares(spark):
    sizes = spark.createDataFrame([("a", 100), ("b", 10_000), (None, 500)], "source string, source_size long")
    got = {r.source: r.target for r in mixing.source_targets(sizes, (3, 1, 2), 1.5, 2.0).collect()}
    assert got["a"] == 200 and got[None] == 1000 and got["b"] == pytest.approx(1.5 * 10_600 - 1200)


PAGES = [
    (1, "http://www.example.com/en/1", None), (2, "https://blog.example.com/en/2?x=1#y", ""), (3, "http://a.example.org/x", '<link rel="canonical" href="https://blog.example.com/en/9">'),
    (4, "http://b.example.org/x", '<meta http-equiv="refresh" content="0; url=http://a.example.org/x">'), (5, "HTTP://SHOP.EXAMPLE.NET/es/", "<p>"), (6, "no scheme", "x"), (7, None, "x"), (8, "", None),
    (9, "http://c.example.org/y", "<link rel='canonical' href='http://www.example.com/en/ok'>"), (10, "http://notexample.com", None), (11, "http://com/", None), (12, "http://a.example.org/x#frag", None),
    (13, "http://d.example.org/z", '<link href="/x" rel=canonical>'), (14, "http://a.net/es/a?b", None), (15, "http://a.net/de/es/", None),
]


def test_url_filter(spark):
    pages = spark.createDataFrame(PAGES + PAGES[:2], "page_id long, url string, html string").withColumns({"host": F.lit(1), "class": F.lit(2), "key": F.lit("k")})
    out = url_filter.judge(pages, queries.URL_RULES, url_filter.link_edges(pages))
    got = {r.page_id: (r.rule, r.verdict) for r in out.collect()}
    assert out.count() == len(PAGES) + 2
    assert got[1] == ("www.example.com/en/", "allow") and got[2] == ("example.com/en/", "block")
    assert got[3] == got[4] == got[12] == (None, "block")  # alias of a blocked url, by two steps
    assert got[5] == ("net/es/", "block") and got[14] == ("net/es/", "block") and got[15] == (None, "allow")
    assert got[9] == (None, "allow") and got[6] == got[7] == got[8] == (None, "allow") and got[10] == (None, "allow") and got[11] == ("com/", "allow")
    c = duckdb.connect()
    c.register("pages", pages.select("page_id", "url", "html").distinct().toArrow())
    want = {r[0]: r[1:] for r in c.execute("SELECT page_id, host, path, rule, verdict FROM (" + queries.ORACLE["op9_url_filter"] + ")").fetchall()}
    assert {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in out.collect()} == want
    assert url_filter.judge(pages.limit(0), queries.URL_RULES, url_filter.link_edges(pages.limit(0))).count() == 0


def test_explicit_allow_comes_before_a_block_in_one_class(spark):
    edges = spark.createDataFrame([("u.org/", "example.com/en/a"), ("u.org/", "www.example.com/en/a")], "src string, dst string")
    pages = spark.createDataFrame([(1, "http://u.org/", None)], "page_id long, url string, html string")
    assert url_filter.judge(pages, queries.URL_RULES, edges).first().verdict == "allow"


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(70)] + [(5000, 6000 + i) for i in range(50)]
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    got = {r.node: r["class"] for r in components(spark.createDataFrame(edges, "src long, dst long"), Stage(spark, "test-cc")).collect()}
    alone = {x for x in parent if all(x not in e or e[0] == e[1] for e in edges)}
    assert got == {x: root(x) for x in parent if x not in alone}


def test_html_pages(spark):
    pages = spark.createDataFrame([(1, "u", "<article><p>Some text.</p></article>"), (1, "u", "<article><p>Some text.</p></article>"), (2, None, None), (3, "u", "")], "page_id long, url string, html string")
    got = rows_of(html_extract.extract(pages.withColumn("text", F.lit(3)).withColumn("extra", F.lit(4))).fillna("", ["url"]), "page_id", "text", "n_chars", "extra")
    assert got == [(1, "Some text.", 10, 4), (1, "Some text.", 10, 4), (2, "", 0, 4), (3, "", 0, 4)]
    assert html_extract.extract(pages.limit(0)).count() == 0


def test_language_id(spark):
    rng = random.Random(1)
    en = ["the quick one and the other thing", "that with this from there"]
    de = ["der schnelle und das andere ding", "mit dieser von dort über"]
    rows = [(i, " ".join(rng.choice(s) for _ in range(6)), k) for i, (s, k) in enumerate([(en, "en"), (de, "de")] * 40)] + [(900, None, "en"), (901, "12 ***", "de"), (902, "", None), (903, "the other thing", None), (904, "x" * 200_000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({"score": F.lit("clash"), "gram": F.lit(1)})
    model = language_id.train(docs.filter(~language_id.held_out()))
    assert model.langs == ["de", "en"]
    got = {r.doc_id: r for r in language_id.predict(docs, model).collect()}
    assert all(got[i].lang_pred == k for i, _, k in rows[:80]) and got[903].lang_pred == "en"
    assert [(got[i].lang_pred, got[i].score) for i in (900, 901, 902)] == [("und", 0.0)] * 3
    assert all(0 <= r.score <= 1 for r in got.values()) and got[904].score < 0.1 and got[3].gram == 1
    none = language_id.train(docs.limit(0))
    assert {r.lang_pred for r in language_id.predict(docs, none).collect()} == {"und"}
    assert language_id.predict(docs.limit(0), model).count() == 0


@pytest.mark.parametrize("blocks", [{}, {"block": 100, "query_block": 7, "shortlist": 60, "few": 100}])
def test_nearest_neighbours(spark, blocks):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(700, 8)).round(2)
    x[40] = x[20]  # ties
    odd = [(700, None), (720, [0.0] * 8), (740, [float("nan")] + [1.0] * 7), (760, [None] + [1.0] * 7), (780, [float("inf")] + [1.0] * 7), (None, [1.0] * 8)] + [(k, [1.0] * 3) for k in range(-40, 0)]
    good = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    good += good[:30]  # repeated rows, queries among them
    df = spark.createDataFrame(odd + good, "vec_id long, embedding array<double>").withColumns({"block": F.lit(1), "score": F.lit(2), "query_id": F.lit(3), "row": F.lit(4), "query": F.lit(5)})
    got = {}
    for r in ann.search(df, F.col("vec_id") % 20 == 0, k=20, **blocks).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    ids, y = np.array([i for i, _ in good]), np.array([v for _, v in good])
    hits = total = 0
    for q in (-40, -20):  # vectors of another length: compared in one task, or by codes of their own
        assert sorted(got.pop(q)) == [(rank, v, 3.0) for rank, v in enumerate([i for i in range(-40, 0) if i != q][:20], 1)]
    assert sorted(got) == list(range(0, 700, 20))
    for q in got:
        own = np.flatnonzero(ids == q)
        p = y @ y[own[0]]
        rest = np.delete(np.arange(len(y)), own[0])
        want = rest[np.lexsort((ids[rest], -p[rest]))[:20]]
        found = sorted(got[q])
        assert [f[0] for f in found] == sorted([*range(1, 21)] * len(own))
        for rank, v, s in found:
            assert s == pytest.approx(float(x[q] @ x[v]), abs=1e-9)
        hits += len(own) * 20 if sorted(f[1] for f in found) == sorted(ids[want].tolist() * len(own)) else sum(f[1] in ids[want] for f in found)
        total += 20 * len(own)
    assert hits / total >= 0.97
    few = ann.search(df.filter("vec_id between 30 and 44"), F.col("vec_id") % 20 == 0, k=20)
    assert [r.rank for r in few.orderBy("rank").collect()] == list(range(1, 15))
    lengths = df.select("vec_id", F.slice(F.array_repeat(F.lit(2.0), 8), 1, (F.abs("vec_id") % 4 + 1).cast("int")).alias("embedding")).filter("vec_id between 1 and 12")
    got = {(r.query_id, r.vec_id, r.score) for r in ann.search(lengths.dropDuplicates(["vec_id"]), F.col("vec_id") > 8).collect()}
    assert got == {(q, v, 4.0 * (q % 4 + 1)) for q in range(9, 13) for v in range(1, 13) if v != q and v % 4 == q % 4}
    assert ann.search(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


@pytest.mark.parametrize("kind", ["copies", "tiny", "long"])
def test_nearest_neighbours_of_copies_tiny_and_long_vectors(spark, kind):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(1200, 192 if kind == "long" else 16))
    if kind == "copies":
        x[rng.permutation(1200)[:500]] = x[0] * 2
    x = x * 1e-25 if kind == "tiny" else x
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<double>").repartition(3)
    got = {}
    for r in ann.search(df, F.col("vec_id") % 100 == 0, k=20, shortlist=40).collect():
        got.setdefault(r.query_id, {})[r.rank] = r.vec_id
    hits = 0
    for q in range(0, 1200, 100):
        p = np.sum(x * x[q], axis=1)
        p[q] = -np.inf
        want = np.lexsort((np.arange(1200), -p))[:20].tolist()
        assert sorted(got[q]) == list(range(1, 21))
        hits += sum(v in want for v in got[q].values())
    assert hits / 240 >= 0.98


def test_recall_on_a_given_table(spark):
    table = "/root/testdata/sf0.01"
    rows = spark.read.parquet(f"{table}/embeddings.parquet").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    got = {}
    for r in queries.op2_additive_ann(spark, table).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hits = 0
    for q in ids[ids % 20 == 0]:
        p = x @ x[ids == q][0]
        p[ids == q] = -np.inf
        hits += len(got[q] & set(ids[np.lexsort((ids, -p))[:20]].tolist()))
    assert hits / (20 * len(got)) >= 0.9


def test_pipeline_stages(spark, docs, tmp_path):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "substring_dedup", "source_mix", "best_fit_packing"]
    now, stage = docs.withColumn("doc_id", F.col("doc_id") * 3), Stage(spark, "test-pipeline")
    for name, step in corpus_pipeline.STAGES:
        new = stage.put(name, step(spark, now, "unused"))
        if name != "best_fit_packing":
            assert new.columns == now.columns
        if name == "language_id":
            assert {r.doc_id for r in now.subtract(new).collect()} == {3 * i for i in (2, 3, 4, 5, 6)}  # no letters
        now = new
    assert now.count() > 0
    docs.limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
