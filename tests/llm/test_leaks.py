import random
import re

import numpy as np
import pyarrow as pa

from kolonna.llm import leaks
from kolonna.llm.leaks import Passages, Shard, find_leaks, search, suffix_array, without_leaks


def test_suffix_array_sorts_and_searches():
    rng = np.random.default_rng(0)
    for n, top, depth in ((0, 3, 8), (1, 3, 8), (300, 2, 16), (2000, 5, 8), (500, 2**30, 4)):
        ids = rng.integers(0, top, n)
        places = suffix_array(ids, depth)
        keys = [tuple(ids[p : p + depth]) for p in places]
        assert sorted(places) == list(range(n)) and keys == sorted(keys)
        if n > 10:
            wanted = np.array([ids[i : i + 4] for i in (0, 5, n - 4)] + [[top + 1] * 4, [-1] * 4])
            low, high = search(ids, places, wanted)
            for w, a, b in zip(wanted, low, high):
                assert sorted(places[a:b]) == [i for i in range(n) if list(ids[i : i + 4]) == list(w)]


def normal(text):
    return re.findall(r"[^\W_]+", text.lower())


def brute(docs, items, least):
    out = {}
    for d, text in docs:
        words = normal(text or "")
        for i, item in items:
            mine = normal(item or "")
            best = 0
            for a in range(len(words)):
                for b in range(len(mine)):
                    n = 0
                    while a + n < len(words) and b + n < len(mine) and words[a + n] == mine[b + n]:
                        n += 1
                    best = max(best, n)
            if best >= least:
                out[(d, i)] = max(best, out.get((d, i), 0))
    return out


def corpus():
    rng = random.Random(1)
    vocabulary = ["été", "Der", "x2", "no", "yes", "ΑΒ", "co-op", "l’eau", "a_b", "7,5"] + [f"w{i}" for i in range(12)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(3, 25)))) for i in range(30)]
    items += [(30, None), (31, ""), (3, items[4][1])]
    docs = []
    for d in range(60):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(0, 60))]
        if d % 2:
            piece = rng.choice(items[:30])[1].split(" ")
            a = rng.randint(0, max(0, len(piece) - 8))
            words[len(words) // 2 : len(words) // 2] = piece[a : a + rng.randint(5, 20)]
        docs.append((d, "  ".join(words).upper() if d % 3 == 0 else "\n".join(words)))
    return docs + [(60, None), (61, ""), (1, docs[1][1]), (62, " ".join(i for _, i in items if i) + "!")], items


def test_leaks_equal_brute_force(spark, monkeypatch):
    docs, items = corpus()
    want = brute(docs, items, 6)
    assert len(want) > 20
    monkeypatch.setattr(leaks, "BLOCK_ITEMS", 9)
    monkeypatch.setattr(leaks, "SHARD_BYTES", 700)
    monkeypatch.setattr(leaks, "PIECE_WORDS", 40)
    documents = spark.createDataFrame([(d, t, "e") for d, t in docs], "doc_id bigint, text string, item bigint".replace("item bigint", "item string")).repartition(3)
    found = find_leaks(documents, spark.createDataFrame(items, "item_id int, text string"), words=6)
    assert {(r.doc_id, r.item_id): r.matched_words for r in found.collect()} == want
    clean = without_leaks(documents, found)
    assert clean.columns == documents.columns
    assert sorted(r.doc_id for r in clean.collect()) == sorted(d for d, _ in docs if d not in {k[0] for k in want})


def test_places_and_empty(spark):
    text, item = "zero one two three four five six", "nine two three four five ten"
    assert [x.tolist() for x in Shard(pa.array([text]), 3, 1 << 20, 10).find(Passages(pa.array([item])))] == [[0], [0], [4], [2], [1]]
    # of equally long matches the first in the document, then the first in the passage
    assert [x.tolist() for x in Shard(pa.array([None, "b c x a b y b c"]), 2, 1 << 20, 10).find(Passages(pa.array(["a b b c b c"])))] == [[1], [0], [2], [0], [2]]
    docs, items = spark.createDataFrame([], "doc_id bigint, text string"), spark.createDataFrame([(1, "a b c")], "item_id bigint, text string")
    assert find_leaks(docs, items).count() == 0
    assert find_leaks(spark.createDataFrame([(1, "a b c")], "doc_id bigint, text string"), items.limit(0), words=1).count() == 0


def test_long_passages_and_shared_formulas(spark, monkeypatch):
    """One passage of 20,000 words, and a formula that all passages and documents hold, many times over; in slices and blocks of small size."""
    rng = random.Random(8)
    long = [f"w{rng.randint(0, 5000)}" for _ in range(20_000)]
    formula = "with the leave of the house i shall now read the whole of the order paper again"
    docs = [(0, " ".join(long[100:19_000])), (1, " ".join(long[:30] + ["x"] + long[40:90]))] + [(i, f"d{i} " + f" y{i} ".join([formula] * 30)) for i in range(2, 40)]
    items = [(0, " ".join(long))] + [(i, f"i{i} " + f" z{i} ".join([formula] * 4)) for i in range(1, 60)]
    monkeypatch.setattr(leaks, "BLOCK_ITEMS", 7)
    monkeypatch.setattr(leaks, "SLICE", 50)
    found = find_leaks(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(2), spark.createDataFrame(items, "item_id bigint, text string"))
    got = {(r.doc_id, r.item_id): (r.matched_words, r.doc_word, r.item_word) for r in found.collect()}
    n = len(formula.split())
    want = {(d, i): (n, 1, 1) for d in range(2, 40) for i in range(1, 60)}
    assert got == want | {(0, 0): (18_900, 0, 100), (1, 0): (50, 31, 40)}


def test_hits_in_slices(monkeypatch):
    rng = np.random.default_rng(3)
    texts, items = ([" ".join(rng.choice(list("abc"), n)) for n in rng.integers(0, 60, count)] for count in (30, 20))
    whole = [x.tolist() for x in Shard(pa.array(texts), 4, 1 << 20, 60).find(Passages(pa.array(items)))]
    monkeypatch.setattr(leaks, "SLICE", 3)
    assert [x.tolist() for x in Shard(pa.array(texts), 4, 25, 60).find(Passages(pa.array(items)))] == whole
    want = brute(list(enumerate(texts)), list(enumerate(items)), 4)
    assert dict(zip(zip(whole[0], whole[1]), whole[2])) == want
