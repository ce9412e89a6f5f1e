"""Evaluation passages in a training corpus: suffix arrays over shards of the corpus, searched for every suffix of every passage.

A shard is a run of documents as a task reads them, so building needs no shuffle. Its suffix array is sorted by words, deep enough to
rank any two suffixes by the ``words`` that make a match: the first three words in one sort, then by doubling, and only
where suffixes are still equal. Each suffix of a passage that is at least ``words`` long is binary-searched; of the hits around
its place those that a match from a word before includes are left out, and comparing on gives the longest verbatim match of the others.

Texts are compared in lower case with every run of characters other than letters and digits as one blank. A document longer than a shard
is cut into pieces that overlap by the longest passage, and each has an array of its own. Passages come in blocks of
bounded size: a single one is broadcast, more lie in the shared folder. A task holds one shard with its array and one block, and reads the corpus once, however many blocks there are; hits are
taken up in slices of bounded size, so a formula that all passages and documents share makes a task no larger.

Defined results: null and empty texts, and passages of fewer than ``words`` words, match nothing; passages that share an id are one
item; repeated documents (by id) give one row an item; an empty table on either side gives no rows; of several longest matches the one
that comes first in the document counts, and in the passage.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kolonna.catalog import Files
from kolonna.operators.compaction import open_folder
from kolonna.runtime import chunks, pieces, scratch_path

WORDS = 12
#: Bytes of text in a shard, and passages of a block.
SHARD_BYTES, BLOCK_ITEMS, BLOCK_BYTES = 4 << 20, 20_000, 16 << 20
#: Words of one suffix array.
PIECE_WORDS = 1 << 20
#: Suffixes searched, and hits taken up, at once.
SLICE = 1 << 18


def words_of(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """(number of words of each text, the words of all): lower case, maximal runs of letters and digits."""
    split = pc.split_pattern_regex(pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), "")), r"[^\p{L}\p{N}]+")
    words = split.flatten()
    there = pc.not_equal(words, "").to_numpy(zero_copy_only=False)
    owner = np.repeat(np.arange(len(texts)), split.value_lengths().to_numpy())
    return np.bincount(owner[there], minlength=len(texts)), words.filter(pa.array(there))


class Passages:
    """The words of passages as numbers of their own, one passage after the other; -1 ends each."""

    def __init__(self, texts: pa.Array) -> None:
        lengths, words = words_of(texts)
        coded = words.dictionary_encode()
        self.words = coded.dictionary
        self.owner = np.repeat(np.arange(len(texts)), lengths + 1)
        self.codes = np.full(len(self.owner), -1, np.int64)
        self.begin = np.cumsum(lengths + 1) - lengths - 1
        self.codes[np.arange(len(words)) + np.repeat(np.arange(len(texts)), lengths)] = coded.indices.to_numpy()
        self.longest = int(lengths.max(initial=0))


def suffix_array(ids: np.ndarray, depth: int) -> np.ndarray:
    """Places of ``ids`` (non-negative, below 2**31) in the order of their suffixes, by at least ``depth`` elements."""
    n = len(ids)
    if not n:
        return np.empty(0, np.int64)
    padded = np.r_[ids + 1, np.zeros(2, np.int64)]
    width = int(padded.max()).bit_length()
    if width <= 21:
        key, covered = (padded[:n] << (2 * width)) | (padded[1 : n + 1] << width) | padded[2:], 3
    else:
        key, covered = (padded[:n] << 32) | padded[1 : n + 1], 2
    places = np.argsort(key)
    key = key[places]
    opens = np.r_[True, key[1:] != key[:-1]]
    rank = np.zeros(n + 1, np.int64)  # a suffix's rank is the slot of the first of its equals, plus one; 0 is past the end
    rank[places] = np.maximum.accumulate(np.where(opens, np.arange(n), 0)) + 1
    while covered < depth:
        equal = np.flatnonzero(~(opens & np.r_[opens[1:], True]))
        if not len(equal):
            break
        at = places[equal]
        key = rank[at] * (n + 2) + rank[np.minimum(at + covered, n)]
        order = np.argsort(key)
        at, key = at[order], key[order]
        places[equal] = at
        opens[equal] = np.r_[True, key[1:] != key[:-1]]
        rank[at] = np.maximum.accumulate(np.where(opens[equal], equal, 0)) + 1
        covered *= 2
    return places


def search(ids: np.ndarray, places: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of ``wanted`` the slots [from, to) of the suffix array whose suffixes start with it."""
    width = wanted.shape[1]
    padded = np.r_[ids, np.full(width, -1, ids.dtype)]
    ends = []
    for above in (False, True):
        low, high = np.zeros(len(wanted), np.int64), np.full(len(wanted), len(places), np.int64)
        while (low < high).any():
            middle = (low + high) >> 1
            there = padded[places[np.minimum(middle, len(places) - 1)][:, None] + np.arange(width)]
            unlike = there != wanted
            at = unlike.argmax(1)
            rows = np.arange(len(wanted))
            less = np.where(unlike.any(1), there[rows, at] < wanted[rows, at], above) & (low < high)
            low = np.where(less, middle + 1, low)
            high = np.where(less | (low > middle), high, np.minimum(high, middle))
        ends.append(low)
    return ends[0], ends[1]


def extend(ids: np.ndarray, place: np.ndarray, codes: np.ndarray, at: np.ndarray, least: int) -> np.ndarray:
    """How many elements are equal from ``place`` in ``ids`` and from ``at`` in ``codes``, of which the first ``least`` are known to be."""
    ids, codes = np.r_[ids, -3], np.r_[codes, -2]
    length, alive = np.full(len(place), least, np.int64), np.arange(len(place))
    while len(alive):
        step = np.arange(min(4096, max(1, SLICE // len(alive))))
        here, there = (place + length)[alive][:, None] + step, (at + length)[alive][:, None] + step
        unlike = ids[np.minimum(here, len(ids) - 1)] != codes[np.minimum(there, len(codes) - 1)]
        n = np.where(unlike.any(1), unlike.argmax(1), len(step))
        length[alive] += n
        alive = alive[n == len(step)]
    return length


class Shard:
    """The words of some documents as numbers, in pieces of at most ``piece_words`` (and the overlap) with a suffix array each, made once."""

    def __init__(self, texts: pa.Array, least: int, piece_words: int, overlap: int) -> None:
        lengths, words = words_of(texts)
        coded = words.dictionary_encode()
        self.least, self.words, self.arrays = least, coded.dictionary, []
        codes, begin = coded.indices.to_numpy().astype(np.int64), np.cumsum(lengths) - lengths
        held: list[tuple[int, int, int]] = []  # document, first word in it, number of words
        size = 0
        for d in np.flatnonzero(lengths >= least).tolist():
            for first in range(0, int(lengths[d]), piece_words):
                n = min(int(lengths[d]) - first, piece_words + overlap)
                if size and size + n > piece_words + overlap:
                    self._array(codes, begin, held)
                    held, size = [], 0
                held.append((d, first, n))
                size += n
        if held:
            self._array(codes, begin, held)

    def _array(self, codes: np.ndarray, begin: np.ndarray, held: list[tuple[int, int, int]]) -> None:
        # a separator of its own ends each piece, so no match runs on into the next
        ids = np.concatenate([x for i, (d, first, n) in enumerate(held) for x in (codes[begin[d] + first : begin[d] + first + n], np.array([len(self.words) + i], np.int64))])
        at = np.cumsum([0, *(n + 1 for _, _, n in held[:-1])])
        self.arrays.append((ids, suffix_array(ids, self.least), at, np.array([d for d, _, _ in held]), np.array([f for _, f, _ in held])))

    def find(self, passages: Passages) -> tuple[np.ndarray, ...]:
        """text, passage, words matched, place in the text and in the passage: the longest match for each text and passage."""
        known = pc.index_in(passages.words, value_set=self.words).fill_null(-1).to_numpy().astype(np.int64) if len(passages.words) else np.empty(0, np.int64)
        codes = np.where(passages.codes >= 0, np.r_[known, -1][passages.codes], -1)
        bad = np.r_[0, np.cumsum(codes < 0)]
        starts = np.flatnonzero(bad[self.least :] == bad[: -self.least]) if len(codes) >= self.least else np.empty(0, np.int64)
        found = [tuple(np.empty(0, np.int64) for _ in range(5))]
        for array in self.arrays:
            for s in range(0, len(starts), SLICE):
                found += self._matches(array, passages, codes, starts[s : s + SLICE])
        return longest(*(np.concatenate(x) for x in zip(*found)))

    def _matches(self, array: tuple, passages: Passages, codes: np.ndarray, starts: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        ids, places, at, documents, bases = array
        low, high = search(ids, places, codes[starts[:, None] + np.arange(self.least)])
        some = high > low
        starts, low, hits = starts[some], low[some], (high - low)[some]
        slices = np.cumsum(hits) // SLICE
        for a, b in zip(np.flatnonzero(np.r_[True, slices[1:] != slices[:-1]][: len(slices)]).tolist(), [*np.flatnonzero(slices[1:] != slices[:-1]) + 1, len(slices)]):
            n = hits[a:b]
            query = np.repeat(starts[a:b], n)
            place = places[np.repeat(low[a:b] - np.cumsum(n) + n, n) + np.arange(n.sum())]
            # a match that goes on to the left is part of a longer one
            first = np.where((place > 0) & (query > 0), ids[place - 1] != codes[query - 1], True)
            query, place = query[first], place[first]
            length = extend(ids, place, codes, query, self.least)
            piece = np.searchsorted(at, place, "right") - 1
            item = passages.owner[query]
            yield longest(documents[piece], item, length, place - at[piece] + bases[piece], query - passages.begin[item])


def longest(text: np.ndarray, item: np.ndarray, length: np.ndarray, place: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, ...]:
    """The longest match of each text and item, of equals the first in the text and then in the item."""
    order = np.lexsort((inside, place, -length, item, text))
    first = order[np.r_[True, (text[order][1:] != text[order][:-1]) | (item[order][1:] != item[order][:-1])][: len(order)]]
    return text[first], item[first], length[first], place[first], inside[first]


def _q(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def find_leaks(documents: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text", item_text: str = "text", words: int = WORDS) -> DataFrame:
    """doc_id, item_id, matched_words, doc_word, item_word: the longest common run of at least ``words`` words of each document and item, and where it begins."""
    spark = documents.sparkSession
    count, size, largest = items.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length(_q(item_text))), F.lit(0)), F.coalesce(F.max(F.octet_length(_q(item_text))), F.lit(0))).collect()[0]
    blocks = max(1, -(-count // BLOCK_ITEMS), -(-size // BLOCK_BYTES))
    chosen, files, sent = items.select(_q(item_id).alias("item_id"), _q(item_text).alias("text")), [], None
    if blocks == 1:
        sent = spark.sparkContext.broadcast(chosen.toArrow())  # at most BLOCK_ITEMS rows and BLOCK_BYTES of text
    else:
        folder = scratch_path(spark, "passages")
        chosen.repartition(blocks).write.parquet(folder)
        files = sorted(Files(spark).files(folder))
    schema = T.StructType([T.StructField("doc_id", documents.schema[doc_id].dataType), T.StructField("item_id", items.schema[item_id].dataType), T.StructField("matched_words", T.IntegerType()), T.StructField("doc_word", T.LongType()), T.StructField("item_word", T.LongType())])
    # no passage has more words than every other of its bytes
    shard_bytes, piece_words, overlap = SHARD_BYTES, PIECE_WORDS, largest // 2 + 1
    slim = documents.select(_q(doc_id).alias("doc_id"), _q(text).alias("text")).where("text is not null")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.parquet as pq
        from pyspark.sql.pandas.types import to_arrow_schema

        out = to_arrow_schema(schema)

        def coded(table: pa.Table) -> tuple[pa.Array, Passages]:
            names, texts = (table.column(c).combine_chunks() for c in ("item_id", "text"))
            return names, Passages(texts)

        def blocks_of(single: list[tuple[pa.Array, Passages]]) -> Iterator[tuple[pa.Array, Passages]]:
            """Every block; a single one is coded once for all shards of the task."""
            yield from single
            for file in files:
                fs, at = open_folder(file)
                with fs.open_input_file(at) as f:
                    table = pq.read_table(f)
                yield coded(table)

        single = [coded(sent.value)] if sent is not None else []
        for table in (p for c in chunks(batches, shard_bytes, lambda b: b.column(1).nbytes) for p in pieces(c, "text", shard_bytes)):
            shard, docs = None, table.column("doc_id").combine_chunks()
            for names, passages in blocks_of(single):
                shard = shard or Shard(table.column("text").combine_chunks(), words, piece_words, overlap)
                found = shard.find(passages)
                columns = [docs.take(pa.array(found[0])), names.take(pa.array(found[1])), *(pa.array(x) for x in found[2:])]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, out)], schema=out)

    best = F.max_by(F.struct("matched_words", "doc_word", "item_word"), F.struct("matched_words", -F.col("doc_word"), -F.col("item_word")))
    return slim.mapInArrow(scan, schema).groupBy("doc_id", "item_id").agg(best.alias("best")).select("doc_id", "item_id", "best.*")


def without_leaks(documents: DataFrame, leaks: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """The documents that no passage was found in, with all their columns."""
    found = leaks.select(F.col("doc_id").alias("_leaked")).distinct()
    return documents.join(found, _q(doc_id) == F.col("_leaked"), "left_anti")
