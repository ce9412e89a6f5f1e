"""Long exact spans shared between records: super-k-mer partitioning.

Every window of ``k`` characters has a minimiser, the least hash of the ``m``-character pieces in it. Consecutive windows with the
same minimiser travel as one string to the minimiser's bucket, where the windows are hashed, sorted and counted.
Equal windows have equal minimisers, so they always meet, wherever they come from.

1. A first pass sends only (minimiser, document); minimisers seen in a single document are done with. A bitmap of those seen in
   several, of a size that follows their number up to a fixed bound, goes to the tasks: strings travel only where it has a bit.
2. The second pass sends the strings. A bucket that holds more strings than ``CROWD`` (a formula repeated all over the corpus) is
   not gathered: its windows go on as hashes and are counted by a plain aggregation, which combines before it shuffles.
   Minimisers that hold more than one in ``HOT`` of all strings take that way wherever they come up: their strings go to many tasks.
3. Windows found in the same set of documents are one class; only one window of a class is kept, so a span of a thousand windows
   costs as much as one of a single window. Classes with their members are the result that stays small; pairs are made of them on
   demand, the members of a class of more than ``PART`` documents in parts that meet in different tasks.

Windows are compared by two independent 64-bit hashes. Defined results: texts are compared as stored, by code point; null texts,
texts below ``k`` characters and documents without an id share nothing; a document repeated under its id, or a span repeated
inside one document, is not shared with itself; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kolonna.runtime import chunks, materialize, pieces, shuffle_partitions

K, M = 300, 128
#: Bytes of text that a task hashes at once (several arrays of eight times that fit the processor's cache); windows in one string at most.
CHUNK_BYTES, RUN = 1 << 18, 4096
#: Strings of a bucket that are gathered; share of all strings from which a minimiser is hot; bits of the bitmap at most.
CROWD, HOT, MAX_BITS = 4096, 10_000, 1 << 28
#: Tasks over which the strings of a hot minimiser are spread; members of a class that meet the others in one task.
SALTS, PART = 1024, 512


def _mix(x: np.ndarray, seed: int) -> np.ndarray:
    x = x + np.uint64(seed)
    x *= np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    return x


#: Odd multipliers, one for each power of two; all are 3 modulo 4, so no two strings built by swapping halves cancel out.
_FACTORS = [np.uint64(x | 3) for x in (0xA0761D6478BD642C, 0xE7037ED1A0B428D8, 0x8EBC6AF09C88C6E0, 0x589965CC75374CC0, 0x1D8E4E27C47D1240, 0xEB44ACCAB455D164, 0xD6E8FEB86659FD90, 0x9E3779B97F4A7C14, 0xBF58476D1CE4E5B8, 0x94D049BB133111E8, 0xC2B2AE3D27D4EB4C)]


def piece_hashes(codes: np.ndarray, length: int, seed: int) -> np.ndarray:
    """A hash of every piece of ``length`` codes, put together from pieces of powers of two: a sum of mixed codes, each times a factor of its place."""
    power, size, done, have, step = _mix(codes.astype(np.uint64), seed), 1, None, 0, 0
    while True:
        factor = _FACTORS[step % len(_FACTORS)]
        if length & size:
            if done is None:
                done, have = power, size
            else:
                done = done[: max(0, len(codes) - have - size + 1)] * _FACTORS[(step + 5) % len(_FACTORS)]
                done += power[have:]
                have += size
        size, step = size * 2, step + 1
        if size > length:
            return _mix(done, seed + 1)
        shifted = power[size // 2 :]
        power = power[: len(shifted)] * factor
        power += shifted


def window_minima(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours."""
    size = 1
    while size * 2 <= width:
        values = np.minimum(values[:-size], values[size:])
        size *= 2
    return np.minimum(values[: len(values) - (width - size)], values[width - size :]) if width > size else values


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def super_kmers(texts: list[str | None], k: int = K, m: int = M) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, windows, minimiser) of the maximal runs of windows with one minimiser; runs are cut at ``RUN`` windows."""
    long = [(i, _codes(t)) for i, t in enumerate(texts) if t is not None and len(t) >= k]
    if not long:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    codes = np.concatenate([c for _, c in long])
    size = np.array([len(c) for _, c in long])
    begin = np.r_[0, np.cumsum(size)[:-1]]
    least = window_minima(piece_hashes(codes, m, 11), k - m + 1)
    opens = np.zeros(len(least) + 1, bool)
    opens[1:-1] = least[1:] != least[:-1]
    opens[begin[begin < len(least)]] = True
    ends = begin + size - k + 1  # no window of this document starts here any more
    opens[ends] = True
    start = np.flatnonzero(opens)
    count = np.diff(start)
    start = start[:-1]
    owner = np.searchsorted(begin, start, "right") - 1
    inside = start < ends[owner]
    start, count, owner = start[inside], count[inside], owner[inside]
    parts = -(-count // RUN)
    if (parts > 1).any():
        step = np.arange(parts.sum()) - np.repeat(np.r_[0, np.cumsum(parts)[:-1]], parts)
        start, count, owner = np.repeat(start, parts) + step * RUN, np.minimum(RUN, np.repeat(count, parts) - step * RUN), np.repeat(owner, parts)
    which = np.array([i for i, _ in long])
    return which[owner], start - begin[owner], count, least[start].view(np.int64)


def string_windows(strings: list[str], k: int = K) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(string, offset, hash, hash) of every window of the strings."""
    parts = [_codes(s) for s in strings]
    size = np.array([len(p) for p in parts])
    codes = np.concatenate(parts)
    count = size - k + 1
    of = np.repeat(np.arange(len(parts)), count)
    offset = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
    at = np.repeat(np.cumsum(size) - size, count) + offset
    return of, offset, piece_hashes(codes, k, 23)[at].view(np.int64), piece_hashes(codes, k, 37)[at].view(np.int64)


def _q(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def _bitmap(repeated: DataFrame) -> tuple[np.ndarray, int]:
    """Bits of the repeated minimisers, as words of 64; the size is bounded by MAX_BITS."""
    n = repeated.count()
    bits = int(min(MAX_BITS, max(1 << 12, 1 << int(np.ceil(np.log2(16 * n + 1))))))
    place = F.col("minimiser").bitwiseAND(F.lit(bits - 1))
    words = repeated.select(F.shiftrightunsigned(place, 6).cast("int").alias("word"), F.expr("shiftleft(1L, cast(minimiser & 63 as int))").alias("mask"))
    table = words.groupBy("word").agg(F.bit_or("mask").alias("mask")).toArrow()
    out = np.zeros(bits // 64, np.int64)
    out[table.column("word").to_numpy()] = table.column("mask").to_numpy()
    return out, bits


def shared_windows(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = K, m: int = M, crowd: int = CROWD, hot: int = HOT) -> DataFrame:
    """What is shared, written once to the shared folder: ``kind``, doc, a, b.

    kind 0: document ``doc`` belongs to the class (a, b) of windows found in one set of documents; kind 1: in ``doc`` the windows that
    start from a up to b (exclusive) are found in other documents too.
    """
    spark = documents.sparkSession
    slim = documents.select(_q(doc_id).alias("doc"), _q(text).alias("text")).where(F.col("doc").isNotNull() & (F.length("text") >= k))
    kind = slim.schema["doc"].dataType

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in (p for b in batches for p in pieces(pa.Table.from_batches([b]), "text", CHUNK_BYTES)):
            of, _, _, least = super_kmers(table.column("text").to_pylist(), k, m)
            yield pa.RecordBatch.from_arrays([table.column("doc").combine_chunks().take(pa.array(of)), pa.array(least)], names=["doc", "minimiser"])

    seen = slim.mapInArrow(first, T.StructType([T.StructField("doc", kind), T.StructField("minimiser", T.LongType())]))
    counted = seen.groupBy("minimiser").agg(F.min("doc").alias("low"), F.max("doc").alias("high"), F.count(F.lit(1)).alias("n")).where("low <> high").select("minimiser", "n")
    repeated = materialize(counted, "minimisers")
    bitmap, bits = _bitmap(repeated)
    total = repeated.agg(F.coalesce(F.sum("n"), F.lit(0))).collect()[0][0]
    # fewer than ``hot`` minimisers can hold more than one in ``hot`` of all strings
    heavy = np.array(sorted(r[0] for r in repeated.where(F.col("n") > max(crowd, total // hot)).select("minimiser").collect()), np.int64)
    bitmap_sent = spark.sparkContext.broadcast(bitmap)

    strings = T.StructType([T.StructField("doc", kind), T.StructField("minimiser", T.LongType()), T.StructField("start", T.LongType()), T.StructField("string", T.StringType())])

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = bitmap_sent.value
        for table in (p for b in batches for p in pieces(pa.Table.from_batches([b]), "text", CHUNK_BYTES)):
            texts = table.column("text").to_pylist()
            of, start, count, least = super_kmers(texts, k, m)
            place = least & (bits - 1)
            keep = np.flatnonzero((words[place >> 6] >> (place & 63)) & 1)
            docs = table.column("doc").combine_chunks().take(pa.array(of[keep]))
            cut = [texts[i][a : a + n + k - 1] for i, a, n in zip(of[keep].tolist(), start[keep].tolist(), count[keep].tolist())]
            yield pa.RecordBatch.from_arrays([docs, pa.array(least[keep]), pa.array(start[keep]), pa.array(cut, pa.string())], names=strings.names)

    found = T.StructType([T.StructField("kind", T.ByteType()), T.StructField("doc", kind), T.StructField("a", T.LongType()), T.StructField("b", T.LongType()), T.StructField("start", T.LongType())])

    def batch(what: int, docs: pa.Array, a: np.ndarray, b: np.ndarray, start: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), what, np.int8)), docs, pa.array(a), pa.array(b), pa.array(start)], names=found.names)

    def as_windows(table: pa.Table) -> Iterator[pa.RecordBatch]:
        """kind 2: (hash, hash) and the place of every window, to be counted by an aggregation."""
        for at in range(0, table.num_rows, 2048):
            part = table.slice(at, 2048)
            of, offset, x, y = string_windows(part.column("string").to_pylist(), k)
            yield batch(2, part.column("doc").combine_chunks().take(pa.array(of)), x, y, part.column("start").to_numpy()[of] + offset)

    def gather(table: pa.Table) -> Iterator[pa.RecordBatch]:
        """Sort and count the windows of whole buckets."""
        of, offset, x, y = string_windows(table.column("string").to_pylist(), k)
        doc = table.column("doc").combine_chunks().dictionary_encode()
        code = doc.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        # one sort by the first hash; only windows that have an equal there are sorted in full
        order = np.argsort(x)
        xs = x[order]
        like = xs[1:] == xs[:-1]
        order = order[np.r_[like, False] | np.r_[False, like]]
        if not len(order):
            return
        order = order[np.lexsort((code[of[order]], y[order], x[order]))]
        xs, ys, ds = x[order], y[order], code[of[order]]
        new = np.r_[True, (xs[1:] != xs[:-1]) | (ys[1:] != ys[:-1])]
        other = new | np.r_[True, ds[1:] != ds[:-1]]  # first of its document in the window
        group = np.cumsum(new) - 1
        begins = np.flatnonzero(new)
        documents_of = np.add.reduceat(other.astype(np.int64), begins)
        shared = documents_of[group] > 1
        if not shared.any():
            return
        # the class of a window is a hash of the set of its documents; each document counts once
        hashes = F_hash(doc.dictionary)
        one, two = (np.bitwise_xor.reduceat(np.where(other, _mix(hashes[ds], s), np.uint64(0)), begins) for s in (1, 2))
        _, keep = np.unique(np.stack([one, two], 1)[documents_of > 1], axis=0, return_index=True)
        chosen = np.zeros(len(begins), bool)
        chosen[np.flatnonzero(documents_of > 1)[keep]] = True
        member = chosen[group] & other
        yield batch(0, doc.dictionary.take(pa.array(ds[member])), one[group][member].view(np.int64), two[group][member].view(np.int64), np.zeros(member.sum(), np.int64))
        flag = np.zeros(len(of), bool)
        flag[order] = shared
        edge = np.r_[True, (of[1:] != of[:-1]) | (flag[1:] != flag[:-1])]
        a = np.flatnonzero(edge)
        length = np.diff(np.r_[a, len(of)])
        a, length = a[flag[a]], length[flag[a]]
        start = table.column("start").to_numpy()[of[a]] + offset[a]
        yield batch(1, doc.dictionary.take(pa.array(code[of[a]])), start, start + length, np.zeros(len(a), np.int64))

    def F_hash(values: pa.Array) -> np.ndarray:
        import hashlib

        return np.array([int.from_bytes(hashlib.blake2b(repr(v).encode(), digest_size=8).digest(), "little") for v in values.to_pylist()], np.uint64)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Buckets come one after another; only whole ones are gathered, and a crowded one is passed on as it comes."""
        carry, passing = None, None
        for table in chunks(batches, 1 << 21, lambda b: b.column(3).nbytes):
            if carry is not None:
                table = pa.concat_tables([carry, table])
            least = table.column("minimiser").to_numpy()
            begin = np.flatnonzero(np.r_[True, least[1:] != least[:-1]])
            size = np.diff(np.r_[begin, len(least)])
            crowded = (size > crowd) | np.isin(least[begin], heavy) | (least[begin] == passing if passing is not None else False)
            last = int(begin[-1])
            rows = np.repeat(crowded, size)
            if crowded[-1]:
                passing, carry = int(least[-1]), None
            else:
                passing, carry = None, table.slice(last)
                rows = rows[:last]
                table = table.slice(0, last)
            if rows.any():
                yield from as_windows(table.filter(pa.array(rows)))
            # a string alone in its bucket came through the bitmap by chance
            rows |= np.repeat(size == 1, size)[: len(rows)]
            if len(rows) and not rows.all():
                table = table.filter(pa.array(~rows))
                least = table.column("minimiser").to_numpy()
                for whole in pieces(table, "string", CHUNK_BYTES, np.flatnonzero(np.r_[True, least[1:] != least[:-1]])):
                    yield from gather(whole)
        if carry is not None and carry.num_rows > 1:  # a hot minimiser is never carried
            yield from gather(carry)

    sent = slim.mapInArrow(second, strings)
    salt = F.when(F.col("minimiser").isin(heavy.tolist()), F.pmod(F.xxhash64("doc", "start"), F.lit(SALTS))).otherwise(F.lit(0)) if len(heavy) else F.lit(0)
    buckets = sent.withColumn("salt", salt).repartition(shuffle_partitions(spark), "minimiser", "salt").drop("salt").sortWithinPartitions("minimiser", "doc", "start")
    counted = materialize(buckets.mapInArrow(count, found), "windows")

    # windows of crowded buckets: the same counting as aggregations
    crowded = counted.where("kind = 2").select("doc", "a", "b", "start")
    once = crowded.groupBy("a", "b", "doc").agg(F.min("start").alias("start"))
    sets = once.groupBy("a", "b").agg(F.count(F.lit(1)).alias("docs"), F.bit_xor(F.xxhash64("doc", F.lit(1))).alias("x"), F.bit_xor(F.xxhash64("doc", F.lit(2))).alias("y")).where("docs > 1")
    chosen = sets.groupBy("x", "y").agg(F.min(F.struct("a", "b")).alias("w")).select("x", "y", F.col("w.a").alias("a"), F.col("w.b").alias("b"))
    members = once.join(chosen, ["a", "b"]).select(F.lit(0).cast("byte").alias("kind"), "doc", F.col("x").alias("a"), F.col("y").alias("b"))
    places = crowded.join(sets.select("a", "b"), ["a", "b"], "left_semi").select(F.lit(1).cast("byte").alias("kind"), "doc", F.col("start").alias("a"), (F.col("start") + 1).alias("b"))
    return counted.where("kind < 2").select("kind", "doc", "a", "b").unionByName(members).unionByName(places)


def _classes(windows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc, class members: a, b, doc; one row a class: a, b, docs, first_doc) of the different sets of documents that share a window."""
    members = windows.where("kind = 0").select("a", "b", "doc").distinct()
    sets = members.groupBy("a", "b").agg(F.count(F.lit(1)).alias("docs"), F.min("doc").alias("first_doc"), F.bit_xor(F.xxhash64("doc", F.lit(1))).alias("x"), F.bit_xor(F.xxhash64("doc", F.lit(2))).alias("y"))
    # one set can come from a gathered bucket and from a crowded one
    once = sets.groupBy("x", "y").agg(F.min(F.struct("a", "b")).alias("w"), F.first("docs").alias("docs"), F.first("first_doc").alias("first_doc"))
    return members, once.select("w.a", "w.b", "docs", "first_doc")


def shared_classes(windows: DataFrame) -> DataFrame:
    """doc_id, first_doc, docs, classes: of every document the classes it is in, by their least document and number of documents, and how many such classes.

    A class is a set of documents that have a window in common; its pairs are its members' with each other.
    """
    members, sets = _classes(windows)
    return members.join(sets, ["a", "b"]).groupBy(F.col("doc").alias("doc_id"), "first_doc", "docs").agg(F.count(F.lit(1)).alias("classes"))


def shared_pairs(windows: DataFrame, part: int = PART) -> DataFrame:
    """doc_id_a, doc_id_b (smaller first): every pair of documents with a common span."""
    members, sets = _classes(windows)
    known = materialize(members.join(sets.select("a", "b", F.ceil(F.col("docs") / F.lit(part)).alias("parts")), ["a", "b"]), "members")
    x = known.select("a", "b", F.col("doc").alias("doc_id_a"), F.pmod(F.xxhash64("doc"), "parts").alias("part"))
    y = known.select("a", "b", F.col("doc").alias("doc_id_b"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    return x.join(y, ["a", "b", "part"]).where("doc_id_a < doc_id_b").select("doc_id_a", "doc_id_b").distinct()


def shared_stretches(windows: DataFrame, k: int = K) -> DataFrame:
    """doc_id, start, end (exclusive): the maximal stretches of each document that are covered by shared spans."""
    spans = windows.where("kind = 1").select(F.col("doc").alias("doc_id"), F.col("a").alias("start"), (F.col("b") + (k - 1)).alias("end"))
    order = Window.partitionBy("doc_id").orderBy("start", "end")
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opened = spans.withColumn("opens", F.when(before >= F.col("start"), 0).otherwise(1)).withColumn("stretch", F.sum("opens").over(order))
    return opened.groupBy("doc_id", "stretch").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("stretch")


def shared_shares(documents: DataFrame, windows: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = K) -> DataFrame:
    """doc_id, chars, shared_chars, stretches, share of every document (of its first row in the case of repeats)."""
    held = shared_stretches(windows, k).groupBy("doc_id").agg(F.sum(F.col("end") - F.col("start")).alias("shared_chars"), F.count(F.lit(1)).alias("stretches"))
    whole = documents.groupBy(_q(doc_id).alias("doc_id")).agg(F.coalesce(F.max(F.length(_q(text))), F.lit(0)).cast("long").alias("chars"))
    joined = whole.join(held, "doc_id", "left").select("doc_id", "chars", F.coalesce("shared_chars", F.lit(0)).alias("shared_chars"), F.coalesce("stretches", F.lit(0)).alias("stretches"))
    return joined.withColumn("share", F.when(F.col("chars") > 0, F.col("shared_chars") / F.col("chars")).otherwise(0.0))
