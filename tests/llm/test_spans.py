import random

import numpy as np
import pytest

from kolonna.llm.spans import piece_hashes, shared_classes, shared_pairs, shared_shares, shared_stretches, shared_windows, string_windows, super_kmers, window_minima

K = 20


def test_hashes_and_minima():
    rng = np.random.default_rng(0)
    codes = rng.integers(0, 2, 300)
    for length in (1, 2, 7, 24, 300):
        got = piece_hashes(codes, length, 5)
        assert len(got) == 301 - length
        assert len(set(got.tolist())) == len({tuple(codes[i : i + length]) for i in range(len(got))})
        assert (piece_hashes(codes[9:], length, 5)[:1] == got[9:10]).all()
    values = rng.integers(0, 99, 60).astype(np.uint64)
    for width in (1, 2, 5, 16, 60):
        assert window_minima(values, width).tolist() == [values[i : i + width].min() for i in range(61 - width)]


def test_runs_cover_every_window_once():
    rng = random.Random(2)
    texts = ["".join(rng.choice("aé😀") for _ in range(n)) for n in (19, 20, 21, 500, 0)] + [None, "z" * 9000]
    of, start, count, least = super_kmers(texts, K, 5)
    windows = [(t, s + i) for t, s, c in zip(of, start, count) for i in range(c)]
    assert len(windows) == len(set(windows)) and set(windows) == {(t, i) for t, x in enumerate(texts) if x for i in range(len(x) - K + 1)}
    by = {}
    for t, s, c, h in zip(of, start, count, least):
        for i in range(c):
            assert by.setdefault(texts[t][s + i : s + i + K], h) == h
    of, offset, x, y = string_windows([t for t in texts if t and len(t) >= K], K)
    assert len(of) == len(windows) and len(set(zip(x, y))) == len(by)


def brute(docs, k=K):
    at = {}
    for d, text in docs:
        for i in range(len(text or "") - k + 1):
            at.setdefault(text[i : i + k], set()).add(d)
    pairs = {(a, b) for docs_ in at.values() for a in docs_ for b in docs_ if a < b}
    cover = {}
    for d, text in docs:
        hit = set()
        for i in range(len(text or "") - k + 1):
            if len(at[text[i : i + k]]) > 1:
                hit |= set(range(i, i + k))
        cover[d] = hit
    return pairs, cover


def classes(docs, k=K):
    at = {}
    for d, text in docs:
        for i in range(len(text or "") - k + 1):
            at.setdefault(text[i : i + k], set()).add(d)
    out = {}
    for members in {frozenset(m) for m in at.values() if len(m) > 1}:
        for d in members:
            key = (d, min(members), len(members))
            out[key] = out.get(key, 0) + 1
    return out


@pytest.fixture(scope="module")
def docs():
    rng = random.Random(7)
    word = lambda n: "".join(rng.choice("abcdefghijé ’\n") for _ in range(n))
    formula, passages = word(60), [word(rng.randint(20, 90)) for _ in range(12)]
    out = []
    for d in range(90):
        text = word(rng.randint(0, 150))
        if d % 3 == 0:
            text += formula + word(rng.randint(0, 30))
        if d % 2:
            text = rng.choice(passages)[rng.randint(0, 5) :] + text + word(40)
        out.append((d, text))
    own = word(50)
    return out + [(90, own + "x" + own), (91, None), (92, ""), (93, out[1][1]), (94, out[1][1]), (95, "q" * 400), (96, "q" * 130 + word(30))]


@pytest.mark.parametrize(("crowd", "hot"), [(512, 10_000), (3, 10_000), (3, 20)])
def test_spans_equal_brute_force(spark, docs, crowd, hot):
    pairs, cover = brute(docs)
    df = spark.createDataFrame([(d, t, "c") for d, t in docs] + [(93, docs[1][1], "again")], "doc_id bigint, text string, kind string").repartition(4)
    windows = shared_windows(df, k=K, m=6, crowd=crowd, hot=hot)
    for part in (512, 5):
        found = [tuple(r) for r in shared_pairs(windows, part).collect()]
        assert set(found) == pairs and len(found) == len(pairs) > 300
    assert {(r.doc_id, r.first_doc, r.docs): r.classes for r in shared_classes(windows).collect()} == classes(docs)
    got = {}
    for r in shared_stretches(windows, K).collect():
        part = set(range(r.start, r.end))
        assert not part & got.setdefault(r.doc_id, set())
        got[r.doc_id] |= part
    assert got == {d: c for d, c in cover.items() if c}
    shares = {r.doc_id: r for r in shared_shares(df, windows, k=K).collect()}
    assert {d: r.shared_chars for d, r in shares.items()} == {d: len(c) for d, c in cover.items()}
    assert shares[91].share == 0 and shares[95].share == 1


def test_empty_and_other_ids(spark):
    assert shared_pairs(shared_windows(spark.createDataFrame([], "doc_id bigint, text string"))).count() == 0
    text = "".join(chr(97 + i * i % 23) for i in range(400))
    df = spark.createDataFrame([("b", "1" + text), ("a", text + "2"), (None, text)], "id string, body string")
    windows = shared_windows(df, "id", "body")
    assert [tuple(r) for r in shared_pairs(windows).collect()] == [("a", "b")]
    assert sorted(tuple(r) for r in shared_stretches(windows).collect()) == [("a", 0, 400), ("b", 1, 401)]
