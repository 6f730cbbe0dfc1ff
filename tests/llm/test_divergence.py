"""The audit of sources against plain Python counts."""

import random
import re
from collections import Counter

import pyarrow as pa
import pytest

from inkframe.llm import divergence

SCHEMA = "doc_id long, text string, lang string, source string, n long, term string, shard long, z string"


def brute(rows, least=3, top=200):
    terms = lambda t: [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall("[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+", t or "")]
    groups, docs = {}, {}
    for t, lang, source in rows:
        own = terms(t)
        groups.setdefault((lang or "", source or ""), Counter()).update(own)
        docs.setdefault(lang or "", Counter()).update(set(own))
    kept = {lang: {t for t, n in c.items() if n >= least} for lang, c in docs.items()}
    share = lambda counts, lang: {t: 1 + 10**9 * (counts[t] + 1) // (sum(counts[k] for k in kept[lang]) + len(kept[lang])) for t in kept[lang]}
    p = {g: share(c, g[0]) for g, c in groups.items()}
    q = {lang: share(sum((c for g, c in groups.items() if g[0] == lang), Counter()), lang) for lang in kept}
    far = lambda a, b: (a - b) ** 2 // b
    out = []
    for (lang, source), c in groups.items():
        pair = [(sum(far(p[lang, source][t], p[g][t]) for t in kept[lang]), g[1]) for g in groups if g[0] == lang and g[1] != source]
        term = [(far(p[lang, source][t], q[lang][t]), t) for t in kept[lang] if c[t] and p[lang, source][t] > q[lang][t]]
        for part, items in (("pair", pair), ("term", term)):
            items.sort(key=lambda x: (-x[0], x[1].encode()))
            out += [(lang, source, part, item, value, k) for k, (value, item) in enumerate(items, 1) if part == "pair" or k <= top]
    return sorted(out)


def sample():
    rng = random.Random(8)
    vocabulary = ["Über", "über", "ÉTÉ", "naïve", "don't", "a1b", "x", "漢字", "—", "Zebra", "zebra", "a_b", "l`un"] + [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60)]
    pick = lambda: " ".join(rng.choice(vocabulary[: 5 + rng.randrange(len(vocabulary))]) for _ in range(rng.randrange(0, 60)))
    rows = [(pick(), rng.choice(["en", "de", None]), rng.choice(["s1", "s2", "S2", "é", None])) for _ in range(150)]
    rows += [(None, "en", "quiet"), ("", "fr", "a"), ("1 2 3", "fr", "b"), ("", None, ""), ("un deux", "xx", "one"), ("un deux trois " * 40_000, "en", "s1"), ("un", "en", "s2"), ("un", "en", "s2"), ("y" * 3_000_000, "en", "s1")]
    return rows + rows[:20]


@pytest.mark.parametrize(("rows", "top"), [(sample(), 200), (sample(), 3), ([], 200), ([(None, None, None)], 200), ([("a b a", "en", "s")] * 5, 200)], ids=["all", "three", "none", "null", "one source"])
def test_against_plain_counts(spark, rows, top):
    df = spark.createDataFrame([(i // 2, *r, 5, "t", 1, "z") for i, r in enumerate(rows)], SCHEMA).repartition(5)
    got = divergence.audit(df, top=top)
    assert got.dtypes == [("lang", "string"), ("source", "string"), ("part", "string"), ("item", "string"), ("value", "bigint"), ("rank", "int")]
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, top=top)


def test_counts_that_are_written_out_early_and_added_up_in_parts(monkeypatch):
    monkeypatch.setattr(divergence, "HELD", 40)
    monkeypatch.setattr(divergence, "FOLD", 50)
    monkeypatch.setattr(divergence, "BLOCKS_AT_ONCE", 4)
    monkeypatch.setattr(divergence, "STEP", 16)
    rows = sample()
    column = lambda k: pa.array([r[k] or "" for r in rows], pa.string())
    blocks = pa.Table.from_batches(divergence.counted(7)(iter([pa.RecordBatch.from_arrays([column(1), column(2), column(0)], ["lang", "source", "text"])])))
    assert len(blocks) > 50
    groups = {(r["lang"], r["source"]) for r in blocks.to_pylist() if r["block"] is None}
    assert groups == {(lang or "", source or "") for _, lang, source in rows}
    got = []
    for shard in range(7):
        own = blocks.filter(pa.compute.equal(blocks["shard"], shard)).to_batches(max_chunksize=3)
        got += pa.Table.from_batches(divergence.kept(3)(iter(own))).to_pylist()
    want = {}
    for t, lang, source in rows:
        words = re.findall("[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+", t or "")
        for w in words:
            low = re.sub("[A-Z]", lambda m: m[0].lower(), w)
            want.setdefault((lang or "", low), []).append(source or "")
    docs = Counter()
    for t, lang, _ in rows:
        docs.update({(lang or "", re.sub("[A-Z]", lambda m: m[0].lower(), w)) for w in re.findall("[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+", t or "")})
    assert {(r["lang"], r["source"], r["term"]): r["n"] for r in got} == {(lang, s, w): n for (lang, w), own in want.items() if docs[lang, w] >= 3 for s, n in Counter(own).items()}
    assert sum(r["first"] for r in got) == sum(n >= 3 for n in docs.values())
