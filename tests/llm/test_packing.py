import base64
import random

import numpy as np
import pytest

from kolonna.llm.packing import TERMS, Index, bpe_counter, byte_counter, container_fill, fill_shard, pack, rarest


def check(rows, texts, capacity, measure):
    """Every text stands once, whole unless longer than the capacity, and no container is overfull."""
    spans, load = {}, {}
    for r in rows:
        spans.setdefault(r.doc_id, []).append((r.start, r.end, r.piece, r.doc_size))
        load[r.container] = load.get(r.container, 0) + r.end - r.start
    assert max(load.values()) <= capacity
    assert len({(r.container, r.place) for r in rows}) == len(rows)
    for doc, text in texts:
        size, mine = measure(text or ""), sorted(spans[doc])
        assert mine[0][0] == 0 and mine[-1][1] == size and all(a[1] == b[0] for a, b in zip(mine, mine[1:]))
        assert {x[3] for x in mine} == {size} and [x[2] for x in mine] == list(range(len(mine)))
        assert len(mine) == max(1, -(-size // capacity))
    return load


def test_bytes(spark):
    rng = random.Random(3)
    texts = [(i, " ".join(rng.choice(["été", "plan", "Bill", f"w{rng.randint(0, 400)}"]) for _ in range(min(400, int(rng.expovariate(1 / 30)))))) for i in range(700)]
    texts += [(1000, None), (1001, ""), (1002, "x" * 600), (1003, "y" * 1201), (1004, "z" * 1800), (1005, "é" * 301)]
    df = spark.createDataFrame([(i, t, "?") for i, t in texts], "doc_id bigint, text string, size string").repartition(3)
    packed = pack(df, 600, byte_counter, shard_texts=200)
    rows = packed.collect()
    load = check(rows, texts, 600, lambda t: len(t.encode()))
    assert sum(load.values()) / (600 * len(load)) > 0.95
    fills = container_fill(packed, 600).collect()
    assert len(fills) == len(load) and all(f.used == load[f.container] and f.used + f.unused == 600 for f in fills)
    assert {r.doc_id for r in rows if r.piece == 0 and r.doc_size > 600} == {i for i, t in texts if t and len(t.encode()) > 600}


def test_neighbours_share_words():
    rng = np.random.default_rng(0)
    topics = [rng.choice(TERMS, 30, replace=False) for _ in range(8)]
    terms = [np.sort(rng.choice(topics[i % 8], 15, replace=False)) for i in range(160)]
    counts = [np.ones(15, np.int64)] * 160
    index = Index(np.full(160, 15), np.concatenate(terms), np.concatenate(counts).astype(float), np.ones(TERMS), 15.0)
    container, place = fill_shard(np.full(160, 50), index, 250)
    assert (np.bincount(container) == 5).all()
    topic = np.arange(160) % 8
    together = np.mean([len(set(topic[container == c])) for c in range(32)])
    assert together < 1.6  # five texts at random would have nearly four topics
    assert sorted(zip(container, place)) == [(c, p) for c in range(32) for p in range(5)]


def test_neighbours_are_found_in_the_whole_corpus(spark):
    # each text has one other of its own words; one is in the same twentieth of the corpus by chance only
    texts = [(i, " ".join(f"w{i % 200:03d}{k:x}" for k in range(10)) + " and") for i in range(400)]
    df = spark.createDataFrame(texts, "doc_id bigint, text string").repartition(3)
    rows = pack(df, 2 * len(texts[0][1]) + 5, byte_counter, shard_texts=20).collect()
    check(rows, texts, 2 * len(texts[0][1]) + 5, len)
    mates = {}
    for r in rows:
        mates.setdefault(r.container, set()).add(r.doc_id % 200)
    assert len(mates) == 200 and all(len(m) == 1 for m in mates.values())


def test_scores_are_bm25_over_all_words():
    rng = np.random.default_rng(5)
    terms = [np.unique(rng.zipf(1.4, rng.integers(0, 60)) % 500) for _ in range(120)]
    counts = [rng.integers(1, 5, len(t)).astype(float) for t in terms]
    idf = rng.random(500) + 0.1
    index = Index(np.array([len(t) for t in terms]), np.concatenate(terms), np.concatenate(counts), idf, 40.0)
    seeds = np.array([3, 77, 119])
    for seed, got in zip(seeds, index.scores(seeds)):
        for other in range(120):
            both = np.isin(terms[other], terms[seed])
            length = counts[other].sum()
            want = (idf[terms[other]] * counts[other] * 2.2 / (counts[other] + 1.2 * (0.25 + 0.75 * length / 40.0)))[both].sum()
            assert abs(want - got[other]) < 1e-3 * max(1, want)


def test_rarest_terms():
    idf = np.array([0.5, 3.0, 2.0, 2.0, 1.0])  # term 1 is in one text only
    found = rarest(np.array([5, 0, 1, 2]), np.array([0, 1, 2, 3, 4, 1, 0, 4]), idf, 3.0)
    assert found.tolist() == [[2, 3, 4], [-1, -1, -1], [-1, -1, -1], [4, 0, -1]]


@pytest.mark.parametrize("shard_texts", [2048, 2])
def test_all_words_of_a_seed_are_looked_up(spark, shard_texts):
    # the seed's thirty strongest words are its own; it shares its ten weakest with the smaller text
    weak = " ".join(f"weak{k}" for k in range(10))
    texts = [(1, " ".join(f"strong{k}" for k in range(30)) + " " + " ".join(f"strong{k}" for k in range(30)) + " " + weak), (2, weak), (3, "other " * 12)]
    rows = pack(spark.createDataFrame(texts, "doc_id bigint, text string"), len(texts[0][1]) + 75, byte_counter, shard_texts=shard_texts).collect()
    of = {r.doc_id: r.container for r in rows}
    assert of[1] == of[2] != of[3]


def test_repeats_one_shard_and_empty(spark):
    df = spark.createDataFrame([(1, "a b c")] * 9 + [(None, "d")], "doc_id bigint, text string")
    rows = pack(df, 10, byte_counter).collect()
    assert len(rows) == 10 and len({(r.container, r.place) for r in rows}) == 10
    assert pack(df.limit(0), 10, byte_counter).count() == 0
    with pytest.raises(ValueError):
        pack(df, 0, byte_counter)


def test_tokens_of_a_vocabulary_file(spark, tmp_path):
    ranks = {bytes([b]): b for b in range(256)} | {b"ab": 256, b"abab": 257}
    path = tmp_path / "own.tiktoken"
    path.write_bytes(b"\n".join(base64.b64encode(k) + b" %d" % v for k, v in ranks.items()))
    texts = [(1, "abab"), (2, "abc"), (3, "ab ab ab"), (4, "é" * 9)]
    rows = pack(spark.createDataFrame(texts, "doc_id bigint, text string"), 8, bpe_counter(str(path), r"\S+|\s+")).collect()
    check(rows, texts, 8, lambda t: {"abab": 1, "abc": 2, "ab ab ab": 5}.get(t, len(t.encode())))
