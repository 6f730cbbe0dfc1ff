"""The operators' kernels against brute force, without Spark."""

import itertools
import random

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from inkframe.llm import ann, html_extract, language_id, media, near_dedup, packing
from inkframe.llm.blocks import Words, pack, rolling, unpack, within
from inkframe.llm.byte_dedup import WINDOW, anchored
from inkframe.llm.induced_sort import suffix_order


@given(st.lists(st.integers(0, 2**63 - 1), max_size=50))
def test_packed_columns_round_trip(values):
    a = np.array(values, np.uint64)
    assert (unpack(pack(a), np.uint64) == a).all()


def test_within():
    assert within(np.array([3, 9, 20]), np.array([5, 9, 22])).tolist() == [3, 4, 20, 21]


@given(st.lists(st.one_of(st.none(), st.text(alphabet="ab é\n\t\x0b\xa0", max_size=20)), max_size=8))
@settings(max_examples=60)
def test_words_are_split_at_six_white_bytes(texts):
    w = Words(texts)
    own = [[w.word(i).decode() for i in range(a, b)] for a, b in zip(w.first[:-1], w.first[1:])]
    import re

    assert own == [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    flat = [x for o in own for x in o]
    h = w.hashes().tolist()
    assert len({(x, y) for x, y in zip(flat, h)}) == len(set(flat)) == len(set(h))


def test_rolling_equal_windows_have_equal_hashes():
    v = np.array([1, 2, 3, 9, 1, 2, 3], np.uint64)
    h = rolling(v, 3)
    assert h[0] == h[4] and len(set(h.tolist())) == 4


@given(st.lists(st.integers(1, 3), min_size=1, max_size=60), st.booleans())
@settings(max_examples=150, deadline=None)
def test_suffix_order_and_shared_prefixes(values, spill):
    text = np.array([*values, 0])
    place, shared = suffix_order(text, 4, 12, memory=0 if spill else 1 << 30)
    want = sorted(range(len(text)), key=lambda i: text[i:].tolist())
    assert place.tolist() == want
    for k in range(1, len(want)):
        a, b = text[want[k - 1] :].tolist(), text[want[k] :].tolist()
        assert shared[k] == min(12, len([1 for _ in itertools.takewhile(lambda p: p[0] == p[1], zip(a, b))]))


def test_equal_windows_have_equal_anchors():
    rng = random.Random(3)
    base = "".join(rng.choices("abcdef ", k=400))
    own = next(anchored([base, "x" * 37 + base[50:350] + "y" * 40, None, "short"]))
    runs_ = list(zip(own.doc, own.start, own.count, own.anchor, own.hash))
    lead = {}
    for d, s, n, p, h in runs_:
        text = [base, "x" * 37 + base[50:350] + "y" * 40][d]
        for k in range(s, s + n):
            lead.setdefault(text[k : k + WINDOW], set()).add((p - k, h))
    assert all(len(v) == 1 for v in lead.values())
    assert sum(n for d, _, n, _, _ in runs_ if d == 0) == 400 - WINDOW + 1


def test_probability_jaccard_is_the_definition():
    rng = np.random.default_rng(5)
    for _ in range(20):
        keys = np.sort(rng.choice(10_000, 25, replace=False)).astype(np.uint64)
        a_in, b_in = rng.random(25) < 0.8, rng.random(25) < 0.8
        a, b = (keys[a_in], rng.integers(1, 5, a_in.sum())), (keys[b_in], rng.integers(1, 5, b_in.sum()))
        x, y = dict(zip(a[0].tolist(), a[1].tolist())), dict(zip(b[0].tolist(), b[1].tolist()))
        want = sum(1 / sum(max(x.get(e, 0) / x[d], y.get(e, 0) / y[d]) for e in x.keys() | y.keys()) for d in x.keys() & y.keys())
        assert near_dedup.probability_jaccard(a, b) == pytest.approx(want)


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(1)
    v = rng.integers(1, 1 << 44, 60).astype(np.uint64)
    w = rng.integers(1, 4, 60)
    keep = np.arange(60) < 50
    doc, value, weight = np.repeat([0, 1], [60, 50]), np.concatenate([v, v[keep]]), np.concatenate([w, w[keep]])
    s = near_dedup.signatures(doc, value, weight, 2, 4000)
    order = np.argsort(v)
    exact = near_dedup.probability_jaccard((v[order], w[order]), tuple(x[np.argsort(v[keep])] for x in (v[keep], w[keep])))
    assert (s[0] == s[1]).mean() == pytest.approx(exact, abs=0.03)
    assert (s != 0).all()


def brute_bins(items, capacity):
    best = [len(items)]
    items = sorted(items, reverse=True)

    def place(k, rooms):
        if len(rooms) >= best[0]:
            return
        if k == len(items):
            best[0] = len(rooms)
            return
        for i in {r: i for i, r in enumerate(rooms)}.values():
            if rooms[i] >= items[k]:
                place(k + 1, [*rooms[:i], rooms[i] - items[k], *rooms[i + 1 :]])
        place(k + 1, [*rooms, capacity - items[k]])

    place(0, [])
    return best[0]


def test_bin_completion_is_optimal_on_small_sets():
    rng = random.Random(2)
    for _ in range(40):
        items = [rng.randint(8, 45) for _ in range(9)]
        count = {s: items.count(s) for s in set(items)}
        plan = packing.bin_completion(count, 60)
        used = {}
        for lengths, bins in plan:
            assert sum(lengths) <= 60
            for s in lengths:
                used[s] = used.get(s, 0) + bins
        assert used == count
        assert packing.lower_bound(count, 60) <= sum(b for _, b in plan) == brute_bins(items, 60)
    assert packing.bin_completion({}, 60) == []


def test_only_the_first_piece_is_shorter():
    assert packing.cut(1, 1024) == [(0, 1)]
    assert packing.cut(1024, 1024) == [(0, 1024)]
    assert packing.cut(2050, 1024) == [(0, 2), (2, 1024), (1026, 1024)]


@given(st.text(alphabet=st.one_of(st.sampled_from("ab '\n\té9._-’�漢\x1f\xa0"), st.characters(codec="utf-8")), max_size=40))
@settings(max_examples=200, deadline=None)
def test_tokens_equal_the_tokenizers(text):
    own = packing.tokens(public_tokenizers.path("byte_bpe_50k.json"))
    assert own.ids(text) == own.whole(text)


def brute_cut(gain, edges):
    best = None
    for side in itertools.product((True, False), repeat=len(gain)):
        cost = sum(max(0, -g) if s else max(0, g) for g, s in zip(gain, side)) + sum(c for a, b, c in edges if side[a] != side[b])
        if best is None or cost < best - 1e-12:
            best = cost
    return best


def test_minimum_cut_is_minimal():
    rng = random.Random(4)
    for _ in range(60):
        n = rng.randint(1, 8)
        gain = [rng.uniform(-2, 2) for _ in range(n)]
        edges = [(i, j, rng.uniform(0, 1)) for i in range(n) for j in range(i) if rng.random() < 0.4]
        side = html_extract.minimum_cut(gain, edges)
        cost = sum(max(0, -g) if s else max(0, g) for g, s in zip(gain, side)) + sum(c for a, b, c in edges if side[a] != side[b])
        assert cost == pytest.approx(brute_cut(gain, edges))


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="<p>no</p>";</script></head><body>
<header><h1>Site name</h1></header><nav><ul><li><a href=/>Home</a></li></ul></nav><div class="cookie-notice">We use cookies.</div>
<article><h1>Title &amp; more</h1><p>First   paragraph
 of the text.<p>A <b>second</b> one, unclosed.<br><div class="ad">Buy now!</div><p>Short.</p><form><input><label>Mail</label></form></article>
<aside>Related things to read.</aside><section id="comments"><p>A reader says that this is a fine article indeed.</p></section><footer>&copy; site</footer></body>"""


def test_main_text():
    assert html_extract.main_text(PAGE) == "Title & more\nFirst paragraph of the text.\nA second one, unclosed.\nShort."
    assert html_extract.main_text(None) == html_extract.main_text("") == ""
    assert html_extract.main_text("<nav><a href=x>a</a></nav>") == ""
    assert html_extract.main_text("<article><p>cut off in the mid") == "cut off in the mid"


@given(st.binary(max_size=20_000))
@settings(max_examples=30, deadline=None)
def test_chunks_cover_the_data(data):
    ends = media.cuts(data)
    assert ends[-1] == len(data) and ends == sorted(ends) and all(b - a <= media.MOST for a, b in zip([0, *ends], ends))


def test_chunks_move_with_their_content():
    rng = np.random.default_rng(0)
    data = rng.integers(0, 256, 400_000, dtype=np.uint8).tobytes()
    a = {data[x:y] for x, y in zip([0, *media.cuts(data)], media.cuts(data))}
    shifted = b"new" + data
    b = {shifted[x:y] for x, y in zip([0, *media.cuts(shifted)], media.cuts(shifted))}
    assert len(a & b) >= len(a) - 2


def test_media_round_trip():
    for text in (None, "", "a", "é" * 288, "x" * 577):
        payload = media.payload_of(text)
        assert len(payload) % media.WIDTH == 0 and payload
        assert media.decoded(media.encoded(payload)) == payload
        assert payload.rstrip(media.PAD) == (text or "").encode()
    with pytest.raises(ValueError):
        media.decoded(b"P5\n576 2\n255\n" + bytes(576))


def test_trigrams_see_letters_only():
    a, doc = language_id.trigrams(["Ab, ab!", None, "12", "é"])
    assert np.bincount(doc, minlength=4).tolist() == [4, 0, 0, 1]
    assert a[0] == a[2]


def test_additive_codes_come_close():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 16))
    books = ann.fit(x, books=8, words=32, rounds=4)
    codes, ratio = ann.encode(x, books)
    code = sum(books[b][codes[:, b]] for b in range(8))
    assert np.sum((x - code) ** 2) < 0.25 * np.sum(x**2)
    table = np.einsum("qd,mwd->qmw", x[:5].astype(np.float32), books)
    assert ann.scores(table, codes, ratio) == pytest.approx((x[:5] @ code.T) * ratio, abs=1e-3)
    wide = ann.encode(x, books, beam=8)[0]
    assert np.sum((x - sum(books[b][wide[:, b]] for b in range(8))) ** 2) <= 1.02 * np.sum((x - code) ** 2)
