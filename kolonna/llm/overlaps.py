"""Overlap sizes between many large sets, without materialising an intersection.

Identifiers are hashed to 64 bits and the hash space is cut into ranges. In each range every set is one sorted run, stored as
bit-packed differences. A pair's count is the sum over ranges of the counts of its two runs: a linear merge if their sizes are near,
an exponential (galloping) search of the larger run for the elements of the smaller one otherwise. A task holds the runs of one range only, so
memory does not depend on how large a set is, and a set that holds a third of all rows is spread over all ranges. A pair goes only to the
ranges in which both sets have a run, and pairs stream past the runs.

Which pairs to count: those given, or all that can share ``share`` of their union. For the latter a set's signature is the least of its hashes in each of
256 bins, or all its hashes if these are no more than 256. Bins agree with the probability of the sets' Jaccard similarity, and a pair is counted
exactly if it agrees in 0.3 of those to be expected at the limit (at least one). Of two sets of at most 256 no pair can be missed; of larger
ones a pair at the limit with a probability below 1e-9 for a share of 0.25 (3e-4 for 0.05; the fewer agreements are expected, the more chance
decides). All bins count. Signature values that more than ``CROWD`` sets share
(identifiers found nearly everywhere) are not joined by value, which would pile up in few tasks: the sets that hold any are cut
into blocks of near sizes, and a task counts the agreements in such values for two blocks.

Counts are exact but for collisions of 64-bit hashes. Defined results: null sets and null identifiers belong to nothing;
repeated rows count once; sets below ``min_size`` make no pair; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kolonna.runtime import chunks, materialize, shuffle_partitions

#: Identifiers in a range; a task holds the runs of one.
RANGE_ROWS = 1 << 19
BINS, SLACK, CROWD = 256, 0.3, 512
#: Sets in a block where agreements in crowded values are counted; a task holds two blocks.
BLOCK_SETS = 1024
#: From this size ratio on the larger run is searched instead of merged.
GALLOP = 8


def encode_run(values: np.ndarray) -> bytes:
    """A sorted run of different uint64 as its first value and differences of the least whole number of bytes."""
    steps = np.diff(values)
    width = max(1, (int(steps.max()).bit_length() + 7) // 8) if len(steps) else 1
    return bytes([width]) + values[:1].tobytes() + np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def decode_run(run: bytes) -> np.ndarray:
    width = run[0]
    packed = np.frombuffer(run, np.uint8, offset=9).reshape(-1, width)
    steps = np.zeros((len(packed) + 1, 8), np.uint8)
    steps[1:, :width] = packed
    steps = steps.view(np.uint64).reshape(-1)
    steps[0] = np.frombuffer(run, np.uint64, count=1, offset=1)[0]
    return np.cumsum(steps, dtype=np.uint64)


def gallop(small: np.ndarray, large: np.ndarray) -> int:
    """How many elements of ``small`` are in ``large``: exponential search for all elements at once, from where an even spread would put them."""
    n, last = len(large), len(large) - 1
    spread = (small.astype(np.float64) - float(large[0])) / max(1.0, float(large[last]) - float(large[0]))
    guess = np.clip((spread * last).astype(np.int64), 0, last)
    up = large[guess] < small
    low, high, step = guess.copy(), guess.copy(), 1
    open_ = np.ones(len(small), bool)
    while open_.any():  # double the bracket until it holds the element
        high = np.where(open_ & up, np.minimum(last, guess + step), high)
        low = np.where(open_ & ~up, np.maximum(0, guess - step), low)
        open_ &= np.where(up, (large[high] < small) & (high < last), (large[low] > small) & (low > 0))
        step *= 2
    while (high - low > 1).any():  # and halve it
        middle = (low + high) >> 1
        right = large[middle] <= small
        low, high = np.where(right, middle, low), np.where(right, high, middle)
    return int(((large[low] == small) | (large[high] == small)).sum()) if n else 0


def merge(a: np.ndarray, b: np.ndarray) -> int:
    """Common elements of two sorted runs by one linear pass (a stable sort of two runs is a merge)."""
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    return int((both[1:] == both[:-1]).sum())


def common(a: np.ndarray, b: np.ndarray) -> int:
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if not len(small) or small[0] > large[-1] or large[0] > small[-1]:
        return 0
    if len(large) < GALLOP * len(small):
        return merge(small, large)
    if len(large) < 4096:
        at = np.searchsorted(large, small)
        return int((large[np.minimum(at, len(large) - 1)] == small).sum())
    return gallop(small, large)


def _q(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def sorted_runs(df: DataFrame, set_column: str, id_column: str, range_rows: int = RANGE_ROWS) -> tuple[DataFrame, DataFrame, int]:
    """(runs: part, s, n, run, least; names: s, name, size; number of ranges) of the sets of ``df``, written to the shared folder."""
    spark = df.sparkSession
    there = df.where(_q(set_column).isNotNull() & _q(id_column).isNotNull())
    # different (set, identifier): repeats of a hot identifier are combined before they travel
    members = materialize(there.select(F.xxhash64(_q(set_column)).alias("s"), F.xxhash64(_q(id_column)).alias("h")).distinct(), "members")
    bits = max(3, int(np.ceil(np.log2(max(1, members.count() / range_rows)))))
    placed = members.withColumn("part", F.shiftrightunsigned("h", 64 - bits).cast("int"))
    ordered = placed.repartition(max(shuffle_partitions(spark), min(1 << bits, 100_000)), "part").sortWithinPartitions("part", "s", "h")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry = None
        for table in chunks(batches, 1 << 18):
            table = table if carry is None else pa.concat_tables([carry, table])
            part, s = (table.column(c).to_numpy() for c in ("part", "s"))
            start = np.flatnonzero(np.r_[True, (part[1:] != part[:-1]) | (s[1:] != s[:-1])])
            carry = table.slice(int(start[-1]))  # the last run can go on; it is one set in one range
            if len(start) > 1:
                yield runs_of(table.slice(0, int(start[-1])))
        if carry is not None:
            yield runs_of(carry)

    def runs_of(table: pa.Table) -> pa.RecordBatch:
        part, s, h = (table.column(c).to_numpy() for c in ("part", "s", "h"))
        h = h.view(np.uint64)
        new = np.r_[True, (part[1:] != part[:-1]) | (s[1:] != s[:-1])]
        start = np.flatnonzero(new)
        end = np.r_[start[1:], len(s)]
        bins = h >> np.uint64(56)
        # a run of few hashes lists them all: a small set is its own signature
        least = np.flatnonzero(new | np.r_[True, bins[1:] != bins[:-1]] | np.repeat(end - start <= BINS, end - start))
        offsets = np.searchsorted(least, np.r_[start, len(s)]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(h[least].view(np.int64)))
        return pa.RecordBatch.from_arrays([pa.array(part[start]), pa.array(s[start]), pa.array((end - start).astype(np.int32)), pa.array([encode_run(h[a:b]) for a, b in zip(start, end)], pa.binary()), lists], names=["part", "s", "n", "run", "least"])

    runs = materialize(ordered.select("part", "s", "h").mapInArrow(build, "part int, s long, n int, run binary, least array<long>"), "runs")
    sizes = runs.groupBy("s").agg(F.sum("n").alias("size"))
    names = there.select(_q(set_column).alias("name")).distinct().withColumn("s", F.xxhash64("name"))
    return runs, names.join(sizes, "s"), 1 << bits


def crowded_pairs(crowded: DataFrame, share: float, needed: Callable[[np.ndarray], np.ndarray], block_sets: int) -> DataFrame:
    """(a, b) of the sets (s, size, hs) that agree in enough of the crowded values ``hs``."""
    width = float(-np.log(share)) if 0 < share < 1 else 50.0
    classed = crowded.withColumn("c", F.floor(F.log("size") / width + 1e-9).cast("int"))
    classes = classed.groupBy("c").agg(F.ceil(F.count(F.lit(1)) / F.lit(block_sets)).alias("blocks"))
    placed = classed.join(classes, "c").select("c", F.pmod(F.xxhash64("s"), "blocks").alias("k"), "s", "size", "hs")
    blocks = classes.select("c", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("k"))
    # sets that can reach the share are in one class or in neighbouring ones (two classes on is for rounding)
    near = blocks.select("c", F.col("k").alias("i"), F.explode(F.array("c", F.col("c") + 1, F.col("c") + 2)).alias("d"))
    meets = near.join(blocks.select(F.col("c").alias("d"), F.col("k").alias("j")), "d").where("c < d or i <= j")
    ends = meets.select("c", "i", "d", "j", F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("c").alias("of"), F.col("i").alias("k")), F.struct(F.lit(1).alias("side"), F.col("d").alias("of"), F.col("j").alias("k")))).alias("end"))
    ends = ends.where("end.side = 0 or c < d or i < j").select("c", "i", "d", "j", "end.*")
    rows = ends.join(placed.withColumnRenamed("c", "of"), ["of", "k"])

    def agree(table: pa.Table) -> pa.Table:
        side, s, size = (table.column(c).to_numpy() for c in ("side", "s", "size"))
        lists = table.column("hs").combine_chunks()
        lists = pa.concat_arrays(lists.chunks) if isinstance(lists, pa.ChunkedArray) else lists
        ends, value = np.r_[0, np.cumsum(lists.value_lengths().to_numpy())], np.unique(lists.flatten().to_numpy(), return_inverse=True)[1]
        left = np.flatnonzero(side == 0)
        right = left if all(table.column(x)[0] == table.column(y)[0] for x, y in (("c", "d"), ("i", "j"))) else np.flatnonzero(side == 1)
        place = np.full(len(s), -1)
        place[right] = np.arange(len(right))
        holder = place[np.repeat(np.arange(len(s)), np.diff(ends))]
        there = np.flatnonzero(holder >= 0)
        there = there[np.argsort(value[there], kind="stable")]
        holder, begin = holder[there], np.searchsorted(value[there], np.arange(value.max() + 2))
        found = []
        for i in left.tolist():
            n = np.bincount(np.concatenate([holder[begin[v] : begin[v + 1]] for v in value[ends[i] : ends[i + 1]]]), minlength=len(right))
            larger, smaller = np.maximum(size[right], size[i]), np.minimum(size[right], size[i])
            j = right[(n >= np.maximum(1, needed(larger))) & (smaller >= share * larger)]
            j = j[s[j] > s[i]] if right is left else j
            found.append(np.stack([np.minimum(s[i], s[j]), np.maximum(s[i], s[j])]))
        a, b = np.concatenate(found, axis=1) if found else np.empty((2, 0), np.int64)
        return pa.table({"a": a, "b": b})

    return rows.select("c", "i", "d", "j", "side", "s", "size", "hs").groupBy("c", "i", "d", "j").applyInArrow(agree, "a long, b long")


def candidate_pairs(runs: DataFrame, names: DataFrame, share: float, min_size: int, crowd: int = CROWD, block_sets: int = BLOCK_SETS) -> DataFrame:
    """(a, b) of all sets of at least ``min_size`` that can share ``share`` of their union."""
    sets = names.where(F.col("size") >= min_size).select("s", "size")
    listed = runs.select("s", "least").join(sets, "s").select("s", "size", F.explode("least").alias("h"))
    # the bin of a large set's hash is its upper byte, a small set's hashes are bins of their own
    listed = listed.withColumn("bin", F.when(F.col("size") > BINS, F.shiftrightunsigned("h", 56)).otherwise(F.col("h")))
    signature = materialize(listed.groupBy("s", "size", "bin").agg(F.min("h").alias("h")).select("s", "h", "size"), "signature")
    holders = signature.groupBy("h").agg(F.count(F.lit(1)).alias("holders")).where("holders > 1")
    known = signature.join(holders, "h")

    def fits(x: str, y: str) -> Column:
        return (F.col(f"{x}.s") < F.col(f"{y}.s")) & (F.col(f"{x}.size") >= share * F.col(f"{y}.size")) & (F.col(f"{y}.size") >= share * F.col(f"{x}.size"))

    shared = known.where((F.col("holders") <= crowd)).select("s", "h", "size")
    agree = shared.alias("x").join(shared.alias("y"), (F.col("x.h") == F.col("y.h")) & fits("x", "y"))
    bins = BINS * (1 - F.exp(-F.greatest("x.size", "y.size") / float(BINS)))
    agree = agree.select(F.col("x.s").alias("a"), F.col("y.s").alias("b"), F.floor(SLACK * share * bins).alias("least"))
    agree = agree.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.first("least").alias("least"))
    crowded = materialize(known.where(F.col("holders") > crowd).groupBy("s", "size").agg(F.collect_list("h").alias("hs")), "crowded")
    if crowded.isEmpty():
        return agree.where("n >= least").select("a", "b")
    # agreements in crowded values add to the others, and can be enough by themselves
    agree = materialize(agree, "agree")
    x, y = (crowded.select(F.col("s").alias(k), F.col("hs").alias(f"hs_{k}")) for k in "ab")
    both = agree.where("n < least").join(x, "a").join(y, "b").where(F.col("n") + F.size(F.array_intersect("hs_a", "hs_b")) >= F.col("least"))
    alone = crowded_pairs(crowded, share, lambda size: np.floor(SLACK * share * BINS * (1 - np.exp(-size / float(BINS)))), block_sets)
    return agree.where("n >= least").select("a", "b").union(both.select("a", "b")).union(alone).distinct()


def overlap_counts(runs: DataFrame, pairs: DataFrame, ranges: int) -> DataFrame:
    """(a, b, shared) of the pairs (a, b) that share anything."""
    wanted = pairs.select(F.col("a").alias("s")).union(pairs.select(F.col("b").alias("s"))).distinct()
    slim = runs.select("part", "s", "run").join(wanted, "s", "left_semi")
    there = slim.select("part", "s")
    meet = pairs.join(there.withColumnRenamed("s", "a"), "a").join(there.withColumnRenamed("s", "b"), ["part", "b"])
    rows = slim.select("part", F.lit(0).alias("kind"), F.col("s").alias("a"), F.lit(0).cast("long").alias("b"), "run")
    rows = rows.unionByName(meet.select("part", F.lit(1).alias("kind"), "a", "b", F.lit(None).cast("binary").alias("run")))
    # in each range first the runs, then the pairs
    ordered = rows.repartition(max(shuffle_partitions(runs.sparkSession), min(ranges, 100_000)), "part").sortWithinPartitions("part", "kind", "a", "b")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here: int | None = None
        encoded: dict[int, bytes] = {}
        decoded: dict[int, np.ndarray] = {}

        def values(s: int) -> np.ndarray:
            if s not in decoded:
                decoded[s] = decode_run(encoded.pop(s))
            return decoded[s]

        for batch in batches:
            part, kind, a, b = (batch.column(i).to_numpy() for i in range(4))
            for first, last in _spans(part, kind):
                if int(part[first]) != here:
                    here, encoded, decoded = int(part[first]), {}, {}
                if not kind[first]:
                    encoded |= zip(a[first:last].tolist(), batch.column(4).slice(first, last - first).to_pylist())
                    continue
                found = np.array([common(values(x), values(y)) for x, y in zip(a[first:last].tolist(), b[first:last].tolist())], np.int64)
                some = found > 0
                yield pa.RecordBatch.from_arrays([pa.array(a[first:last][some]), pa.array(b[first:last][some]), pa.array(found[some])], names=["a", "b", "shared"])

    return ordered.mapInArrow(count, "a long, b long, shared long").groupBy("a", "b").agg(F.sum("shared").alias("shared"))


def _spans(*columns: np.ndarray) -> list[tuple[int, int]]:
    """[from, to) of the runs of rows that are equal in all columns."""
    new = np.r_[True, np.any([c[1:] != c[:-1] for c in columns], axis=0)][: len(columns[0])]
    start = np.flatnonzero(new)
    return list(zip(start.tolist(), [*start[1:].tolist(), len(columns[0])]))


def _named(counts: DataFrame, names: DataFrame) -> DataFrame:
    """set_a, set_b (smaller first), size_a, size_b and shared of the pairs (a, b, shared)."""
    x, y = (names.select(F.col("s").alias(k), F.col("name").alias(f"set_{k}"), F.col("size").alias(f"size_{k}")) for k in "ab")
    swap = F.col("set_a") > F.col("set_b")
    ends = [F.when(swap, F.col(p)).otherwise(F.col(q)).alias(n) for p, q, n in (("set_b", "set_a", "set_a"), ("set_a", "set_b", "set_b"), ("size_b", "size_a", "size_a"), ("size_a", "size_b", "size_b"))]
    return counts.join(x, "a").join(y, "b").select(*ends, "shared")


def set_overlaps(df: DataFrame, set_column: str, id_column: str, share: float, min_size: int = 1, range_rows: int = RANGE_ROWS, crowd: int = CROWD) -> DataFrame:
    """set_a, set_b (smaller first), size_a, size_b, shared: all pairs that share at least ``share`` of the identifiers that either has."""
    if not 0 < share <= 1:
        raise ValueError("share lies above 0 and at most at 1")
    runs, names, ranges = sorted_runs(df, set_column, id_column, range_rows)
    names = materialize(names, "names")
    pairs = materialize(candidate_pairs(runs, names, share, min_size, crowd), "pairs")
    counts = overlap_counts(runs, pairs, ranges)
    return _named(counts, names).where(F.col("shared") >= share * (F.col("size_a") + F.col("size_b") - F.col("shared")))


def given_overlaps(df: DataFrame, set_column: str, id_column: str, pairs: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """set_a, set_b and shared (0 too) for the pairs of sets in the first two columns of ``pairs``."""
    runs, _, ranges = sorted_runs(df, set_column, id_column, range_rows)
    asked = pairs.select(F.col(pairs.columns[0]).alias("set_a"), F.col(pairs.columns[1]).alias("set_b")).distinct().withColumns({"a": F.xxhash64("set_a"), "b": F.xxhash64("set_b")})
    counts = overlap_counts(runs, asked.where("set_a is not null and set_b is not null").select("a", "b").distinct(), ranges)
    return asked.join(counts, ["a", "b"], "left").select("set_a", "set_b", F.coalesce("shared", F.lit(0)).alias("shared"))


def all_overlaps(df: DataFrame, set_column: str, id_column: str, crowd: int = CROWD) -> DataFrame:
    """set_a, set_b (smaller first), size_a, size_b, shared: all pairs of sets, of any size, that share anything.

    Members meet by identifier; one that more than ``crowd`` sets hold is cut into parts that meet in different tasks. The result has a
    row a pair, and the work is the number of (pair, shared identifier).
    """
    there = df.where(_q(set_column).isNotNull() & _q(id_column).isNotNull())
    members = materialize(there.select(F.xxhash64(_q(set_column)).alias("s"), F.xxhash64(_q(id_column)).alias("h")).distinct(), "members")
    names = there.select(_q(set_column).alias("name")).distinct().withColumn("s", F.xxhash64("name"))
    names = materialize(names.join(members.groupBy("s").agg(F.count(F.lit(1)).alias("size")), "s"), "names")
    held = members.groupBy("h").agg(F.count(F.lit(1)).alias("holders")).where("holders > 1").select("h", F.ceil(F.col("holders") / F.lit(crowd)).alias("parts"))
    known = materialize(members.join(held, "h"), "known")
    x = known.select("h", F.col("s").alias("a"), F.pmod(F.xxhash64("s"), "parts").alias("part"))
    y = known.select("h", F.col("s").alias("b"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    counts = x.join(y, ["h", "part"]).where("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared"))
    return _named(counts, names)
