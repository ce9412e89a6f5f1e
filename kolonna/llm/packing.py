"""Filling containers of a fixed capacity with whole texts that belong together: lexical retrieval packing.

1. Every text is measured by a counter (bytes, or tokens of a public tokenizer) and reduced to the frequencies of its hashed words.
   A text longer than the capacity gives full containers of its own; only its rest is packed on.
2. Document frequencies are counted over all texts. Words are hashed to ``TERMS`` numbers, so these statistics have a fixed size.
3. All texts are sorted by their rarest words that some other text has too, and runs of some ``SHARD_TEXTS`` neighbours in that order
   are the shards of the inverted index: texts that share what is rare stand in one shard, whatever the size of the corpus.
4. In each shard the longest unused text is the seed; BM25 over all its words ranks the unused texts, and those that reach ``STRONG``
   of the seed's score against itself join it, best first, as long as they fit.
5. What came out, groups and single texts, is sorted anew by the second rarest word of its seed, so that each meets other neighbours.
   Now the longest seeds a container, the unused neighbours that BM25 returns fill it, best first, and what room is left goes to the
   largest unused ones that fit, related or not.

A text is thus looked up in two shards, not in the whole corpus; the README says what share of the best neighbours that reaches. The work is linear
in the corpus: a shard has a fixed size, the driver holds the statistics of step 2 and nothing a text, and sorting by range splits
texts that are all alike. A task holds one shard, bounded in texts and in words.

Defined results: a null or empty text has size 0, takes no room and is assigned like any other; a text of exactly the capacity is
whole; repeated rows are separate items; ties in score go to the text that comes first in the shard; an empty table gives no rows.
Ties between rows of one id, and the borders of shards, depend on where rows are stored, so results are repeatable for the same files.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kolonna.runtime import materialize, pieces, shuffle_partitions

TERMS = 1 << 20
#: Texts of a shard, and different words of all its texts together, either of which closes it.
SHARD_TEXTS, SHARD_TERMS = 2048, 1 << 21
#: Share of a seed's score against itself that a text must reach to join it before the second sorting.
STRONG = 0.6
#: Seeds that are scored at once.
BLOCK = 256
#: BM25's constants.
K1, B = 1.2, 0.75
#: The rarest words of a text, by which it is sorted.
RARE = 3

Counter = Callable[[], Callable[[list[str]], list[int]]]


def byte_counter() -> Callable[[list[str]], list[int]]:
    """One token per byte of the UTF-8 form."""
    return lambda texts: [len(t.encode("utf-8", "surrogatepass")) for t in texts]


def bpe_counter(path: str, pattern: str) -> Counter:
    """Tokens of a byte-level BPE whose ranks are in the file ``path`` (base64 token and rank a line); the file must be at hand on the executors."""

    def make() -> Callable[[list[str]], list[int]]:
        import base64

        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        return lambda texts: [len(encoding.encode_ordinary(t)) for t in texts]

    return make


class Unused:
    """The texts of a shard by size, of which those used have a container and a place in it."""

    def __init__(self, size: np.ndarray, capacity: int) -> None:
        n = len(size)
        self.size, self.capacity = size, capacity
        self.container, self.place = np.full(n, -1, np.int64), np.zeros(n, np.int64)
        self.by_size = np.lexsort((-np.arange(n), size))
        self.sizes = size[self.by_size]
        self.at = np.empty(n, np.int64)
        self.at[self.by_size] = np.arange(n)
        # ``below[i]`` leads to the largest unused one at or under it; places count from 1 here, 0 is none
        self.below = np.arange(n + 1)
        self.made, self.room, self.held = 0, 0, 0

    def largest(self, room: int) -> int:
        """The largest unused text that fits, or -1."""
        below, i = self.below, int(np.searchsorted(self.sizes, room, "right"))
        root = i
        while below[root] != root:
            root = int(below[root])
        while below[i] != root:
            below[i], i = root, int(below[i])
        return int(self.by_size[root - 1]) if root else -1

    def next(self, most: int) -> np.ndarray:
        """The ``most`` largest unused texts, from the largest down."""
        return self.by_size[self.container[self.by_size] < 0][::-1][:most]

    def take(self, i: int) -> None:
        self.container[i], self.place[i] = self.made - 1, self.held
        self.below[self.at[i] + 1] = self.at[i]
        self.held += 1
        self.room -= int(self.size[i])

    def open(self, seed: int) -> None:
        self.made, self.room, self.held = self.made + 1, self.capacity, 0
        self.take(seed)

    def fill(self, near: np.ndarray, score: np.ndarray) -> None:
        """Take of ``near``, best ``score`` first, what is unused and fits."""
        free = (self.size[near] <= self.room) & (self.container[near] < 0)
        near, score = near[free], score[free]
        near = near[np.argsort(-score, kind="stable")]
        while len(near):
            fit = int(np.searchsorted(np.cumsum(self.size[near]), self.room, "right"))
            for i in near[:fit].tolist():
                self.take(i)
            near = near[fit:]
            near = near[self.size[near] <= self.room]

    def top_up(self) -> None:
        while (i := self.largest(self.room)) >= 0:
            self.take(i)


class Index:
    """The inverted index of a shard; BM25 scores of its texts for each other."""

    def __init__(self, lengths: np.ndarray, term: np.ndarray, count: np.ndarray, idf: np.ndarray, mean: float) -> None:
        self.n, self.ends = len(lengths), np.r_[0, np.cumsum(lengths)]
        owner = np.repeat(np.arange(self.n), lengths)
        words = np.bincount(owner, count, self.n)
        weight = idf[term] * count * (K1 + 1) / (count + K1 * (1 - B + B * words[owner] / max(mean, 1e-9)))
        known, self.term = np.unique(term, return_inverse=True)
        held = np.bincount(self.term, minlength=len(known))
        # words in many texts are multiplied densely, the others are lists of texts
        often = np.flatnonzero(held > max(8, self.n // 32))
        self.column = np.full(len(known), -1)
        self.column[often] = np.arange(len(often))
        dense = self.column[self.term] >= 0
        self.weights = np.zeros((self.n, len(often)), np.float32)
        self.weights[owner[dense], self.column[self.term[dense]]] = weight[dense]
        rare = np.flatnonzero(~dense)
        rare = rare[np.argsort(self.term[rare], kind="stable")]
        self.text, self.weight = owner[rare], weight[rare]
        self.begin = np.r_[0, np.cumsum(np.where(self.column < 0, held, 0))]

    def scores(self, seeds: np.ndarray) -> np.ndarray:
        """The score of every text of the shard for all words of each seed."""
        m, lengths = len(seeds), self.ends[seeds + 1] - self.ends[seeds]
        seed = np.repeat(np.arange(m), lengths)
        asked = self.term[np.repeat(self.ends[seeds] - np.cumsum(lengths) + lengths, lengths) + np.arange(lengths.sum())]
        column = self.column[asked]
        query = np.zeros((m, self.weights.shape[1]), np.float32)
        query[seed[column >= 0], column[column >= 0]] = 1
        seed, asked = seed[column < 0], asked[column < 0]
        long = self.begin[asked + 1] - self.begin[asked]
        at = np.repeat(self.begin[asked] - np.cumsum(long) + long, long) + np.arange(long.sum())
        listed = np.bincount(np.repeat(seed * self.n, long) + self.text[at], self.weight[at], m * self.n)
        return listed.reshape(m, self.n).astype(np.float32) + query @ self.weights.T


def fill_shard(size: np.ndarray, index: Index, capacity: int, strong: float | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(container of each text, its place in it). Sizes are at most ``capacity``. With ``strong`` only texts that reach this share of their seed's own score join it."""
    unused = Unused(size, capacity)
    while len(seeds := unused.next(BLOCK)):
        scores = index.scores(seeds)
        for seed, score in zip(seeds.tolist(), scores):
            if unused.container[seed] >= 0:
                continue
            unused.open(seed)
            if unused.room > 0:
                near = np.flatnonzero(score > 0 if strong is None else (score >= strong * score[seed]) & (score > 0))
                unused.fill(near, score[near])
            if strong is None:
                unused.top_up()
    return unused.container, unused.place


def rarest(lengths: np.ndarray, term: np.ndarray, idf: np.ndarray, alone: float) -> np.ndarray:
    """The RARE rarest terms of each text, -1 where it has no more; terms of one text only (their idf is ``alone``) say nothing about others."""
    owner = np.repeat(np.arange(len(lengths)), lengths)
    shared = np.flatnonzero(idf[term] < alone)
    shared = shared[np.lexsort((term[shared], -idf[term[shared]], owner[shared]))]
    of = owner[shared]
    place = np.arange(len(of)) - np.searchsorted(of, of)
    out = np.full((len(lengths), RARE), -1, np.int32)
    some = place < RARE
    out[of[some], place[some]] = term[shared[some]]
    return out


def _q(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def _shards(batches: Iterator[pa.RecordBatch], by: list[str], texts: int, terms: int) -> Iterator[pa.Table]:
    """Runs of about ``texts`` rows, or fewer that hold ``terms`` terms, cut where the columns ``by`` change if they do near there; the last one is no small remainder."""
    held, rows, words = [], 0, 0
    for batch in (b.slice(i, 256) for b in batches for i in range(0, b.num_rows, 256)):
        held.append(batch)
        rows += batch.num_rows
        words += len(batch.column("terms").flatten())
        if rows >= 1.5 * texts or words >= 1.5 * terms:
            table = pa.Table.from_batches(held).combine_chunks()
            cut = max(1, int(rows * min(1.0, texts / rows, terms / max(words, 1))))
            changes = np.zeros(rows, bool)
            for c in by:
                value = table.column(c).to_numpy()
                changes[1:] |= value[1:] != value[:-1]
            near = np.flatnonzero(changes[cut // 2 : cut + 1])
            cut = cut // 2 + int(near[-1]) if len(near) else cut
            yield table.slice(0, cut)
            held = table.slice(cut).to_batches()
            rows, words = rows - cut, sum(len(b.column("terms").flatten()) for b in held)
    if rows:
        yield pa.Table.from_batches(held).combine_chunks()


def _list(column: pa.ChunkedArray) -> pa.ListArray:
    array = column.combine_chunks()
    return pa.concat_arrays(array.chunks) if isinstance(array, pa.ChunkedArray) else array


def _parts(lists: pa.ListArray, order: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """(length of each list, all their elements) in another order of the lists."""
    taken = lists.take(pa.array(order))
    return taken.value_lengths().to_numpy().astype(np.int64), taken.flatten()


def pack(documents: DataFrame, capacity: int, counter: Counter, doc_id: str = "doc_id", text: str = "text", shard_texts: int = SHARD_TEXTS, strong: float = STRONG) -> DataFrame:
    """container, place, doc_id, doc_size, piece, start, end: every text in tokens [start, end) of its pieces, written once to the shared folder."""
    if capacity < 1:
        raise ValueError("the capacity is at least 1")
    spark = documents.sparkSession
    slim = documents.select(_q(doc_id).alias("doc_id"), _q(text).alias("text"))
    kind = slim.schema["doc_id"].dataType
    ints = T.ArrayType(T.IntegerType())

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from zlib import crc32

        from pyspark import TaskContext

        count, row = counter(), TaskContext.get().partitionId() << 40
        number: dict[str, int] = {}
        for table in (p for b in batches for p in pieces(pa.Table.from_batches([b]), "text", 4 << 20)):
            texts = pc.fill_null(table.column("text").combine_chunks(), "")
            words = _list(pa.chunked_array([pc.split_pattern_regex(pc.utf8_lower(texts), r"[^\p{L}\p{N}_]+")]))
            of = np.repeat(np.arange(len(texts)), words.value_lengths().to_numpy())
            coded = words.flatten().dictionary_encode()
            if len(number) > 1_000_000:
                number.clear()
            for w in (known := coded.dictionary.to_pylist()):
                if w not in number:
                    number[w] = crc32(w.encode("utf-8", "surrogatepass")) % TERMS if w else -1
            term = np.array([number[w] for w in known], np.int64)[coded.indices.to_numpy()] if len(known) else np.empty(0, np.int64)
            # words that share a number are one term
            key, times = np.unique((of * TERMS + term)[term >= 0], return_counts=True)
            lengths = pa.array(np.searchsorted(key // TERMS, np.arange(len(texts) + 1)).astype(np.int32))
            lists = (pa.ListArray.from_arrays(lengths, pa.array(x.astype(np.int32))) for x in (key % TERMS, times))
            yield pa.RecordBatch.from_arrays([table.column("doc_id").combine_chunks(), pa.array(np.arange(row, row + len(texts))), pa.array(count(texts.to_pylist()), pa.int64()), *lists], names=["doc_id", "row", "size", "terms", "counts"])
            row += len(texts)

    measured = T.StructType([T.StructField("doc_id", kind), T.StructField("row", T.LongType()), T.StructField("size", T.LongType()), T.StructField("terms", ints), T.StructField("counts", ints)])
    vectors = materialize(slim.mapInArrow(measure, measured), "vectors")

    # statistics over all texts: TERMS numbers at most
    texts, words = vectors.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x)), F.lit(0))).collect()[0]
    held = vectors.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n")).toArrow()
    frequency = np.zeros(TERMS)
    frequency[held.column("term").to_numpy()] = held.column("n").to_numpy()
    idf_sent = spark.sparkContext.broadcast(np.log1p((texts - frequency + 0.5) / (frequency + 0.5)).astype(np.float32))
    mean, alone = words / max(texts, 1), np.float32(np.log1p((texts - 0.5) / 1.5))

    rare = [f"rare{i}" for i in range(RARE)]
    member = T.StructType([T.StructField("doc_id", kind), T.StructField("size", T.LongType()), T.StructField("rest", T.LongType())])
    keyed = T.StructType([*(T.StructField(r, T.IntegerType()) for r in rare), T.StructField("row", T.LongType()), T.StructField("rest", T.LongType()), T.StructField("terms", ints), T.StructField("counts", ints), T.StructField("members", T.ArrayType(member))])

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            terms = b.column("terms")
            found = rarest(terms.value_lengths().to_numpy(), terms.flatten().to_numpy(), idf_sent.value, alone)
            struct = pa.StructArray.from_arrays([b.column(c) for c in ("doc_id", "size", "rest")], names=["doc_id", "size", "rest"])
            members = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1, dtype=np.int32)), struct)
            yield pa.RecordBatch.from_arrays([*(pa.array(found[:, i]) for i in range(RARE)), b.column("row"), b.column("rest"), terms, b.column("counts"), members], names=keyed.names)

    def packed_shards(batches: Iterator[pa.RecordBatch], by: list[str], reach: float | None) -> Iterator[tuple[pa.Table, np.ndarray, np.ndarray]]:
        """Each shard with its rows in the order of (container, place), and both."""
        for table in _shards(batches, by, shard_texts, SHARD_TERMS):
            terms, counts = (_list(table.column(c)) for c in ("terms", "counts"))
            index = Index(terms.value_lengths().to_numpy(), terms.flatten().to_numpy(), counts.flatten().to_numpy().astype(np.float64), idf_sent.value, mean)
            container, place = fill_shard(table.column("rest").to_numpy(), index, capacity, reach)
            order = np.lexsort((place, container))
            yield table, order, container[order]

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One row a group: its seed's words, the sizes of all."""
        for table, order, container in packed_shards(batches, rare[:2], strong):
            first = np.flatnonzero(np.r_[True, container[1:] != container[:-1]])
            seeds = table.take(pa.array(order[first]))
            length, members = _parts(_list(table.column("members")), order)
            offsets = np.r_[np.r_[0, np.cumsum(length)][first], length.sum()].astype(np.int32)
            total = np.add.reduceat(table.column("rest").to_numpy()[order], first)
            columns = [seeds.column(n) for n in ("terms", "counts")]
            yield from pa.table([*(seeds.column(r) for r in rare), seeds.column("row"), pa.array(total), *columns, pa.ListArray.from_arrays(pa.array(offsets), members)], names=keyed.names).to_batches()

    placed = T.StructType([T.StructField("container", T.StringType()), T.StructField("place", T.LongType()), T.StructField("doc_id", kind), T.StructField("doc_size", T.LongType()), T.StructField("piece", T.LongType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        here = TaskContext.get().partitionId()
        for shard, (table, order, container) in enumerate(packed_shards(batches, rare[1:], None)):
            length, members = _parts(_list(table.column("members")), order)
            owner = np.repeat(container, length)
            ids, size, rest = (members.field(i) for i in range(3))
            start = size.to_numpy() - rest.to_numpy()
            place = np.arange(len(owner)) - np.searchsorted(owner, owner)
            yield pa.RecordBatch.from_arrays([pa.array([f"s{here}/{shard}/{c}" for c in owner.tolist()], pa.string()), pa.array(place), ids, size, pa.array(start // capacity), pa.array(start), size], names=placed.names)

    # as many partitions as the session has, but two to eight shards in each: the border of a partition can part neighbours
    shards = -(-texts // shard_texts)
    parts = min(max(1, shards // 2), max(shuffle_partitions(spark), -(-shards // 8)))

    def arranged(rows: DataFrame, by: list[str]) -> DataFrame:
        return rows.repartitionByRange(parts, *by, "row").sortWithinPartitions(*by, "row")

    rest = F.when(F.col("size") > capacity, F.pmod(F.col("size"), F.lit(capacity))).otherwise(F.col("size"))
    items = vectors.withColumn("rest", rest).where((F.col("rest") > 0) | (F.col("size") == 0)).mapInArrow(key, keyed)
    groups = materialize(arranged(items, rare).mapInArrow(gather, keyed), "groups")
    packed = arranged(groups, [*rare[1:], rare[0]]).mapInArrow(fill, placed)
    full = vectors.where(F.col("size") > capacity).select("doc_id", "row", F.col("size").alias("doc_size"), F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("size") / F.lit(capacity)) - 1)).alias("piece"))
    full = full.select(F.concat_ws("/", F.concat(F.lit("d"), F.hex("row")), F.col("piece").cast("string")).alias("container"), F.lit(0).cast("long").alias("place"), "doc_id", "doc_size", "piece", (F.col("piece") * capacity).alias("start"), ((F.col("piece") + 1) * capacity).alias("end"))
    return materialize(packed.unionByName(full), "containers")


def container_fill(packed: DataFrame, capacity: int) -> DataFrame:
    """container, items, used, unused of every container."""
    return packed.groupBy("container").agg(F.count(F.lit(1)).alias("items"), F.sum(F.col("end") - F.col("start")).alias("used")).withColumn("unused", F.lit(capacity) - F.col("used"))
