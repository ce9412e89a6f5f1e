"""Distinct counts over huge identifier sets: multiresolution bitmaps as ordinary rows.

A 64-bit hash sends an identifier to slice h with probability 2**-(h+1) and to one of ``bits`` bits in it. The bitmaps are stored
sparsely, one row for each 64-bit word that has a bit set, so building, merging and rolling up are all one hash aggregation by
``bit_or`` with map-side partial aggregation inside generated code: no Python, no sort, no group held in memory, and a group that
holds a third of the rows sends at most ``slices * bits / 64`` words per map task. The count of a group uses the
finest slices that are not saturated: with every slice from ``base`` on, a share of 2**-base of the identifiers was sampled, and
each slice is read by linear counting. The relative standard error is below ``1.2 / sqrt(bits)`` at any
scale (1.9 % for 4096; measured in the tests) and far smaller for groups below ``bits / 4``.

Defined results: a null identifier is not counted, yet its group appears (with estimate 0 if it has nothing else); null
keys are keys; repeats change nothing but ``n_rows``; an empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kolonna.runtime import free_name, materialize

BITS, SLICES = 4096, 40
#: A slice with more than this share of its bits set is saturated (a load of about 1.5).
FULL = 0.78
STATE = ("mrb_slice", "mrb_word", "mrb_mask", "mrb_rows")


def _names(keys: list[str]) -> list[str]:
    return [free_name(n, keys) for n in STATE]


def _q(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def distinct_bitmaps(df: DataFrame, keys: list[str], column: str, bits: int = BITS, slices: int = SLICES) -> DataFrame:
    """Bitmaps of ``column`` for each combination of ``keys``: the keys and the STATE columns, one row a non-empty word."""
    if bits % 64 or bits & (bits - 1) or not 64 <= bits <= 1 << 16:
        raise ValueError("bits is a power of two from 64 to 65536")
    level, word, mask, rows = _names(keys)
    h, there = F.xxhash64(_q(column)), _q(column).isNotNull()
    # the upper 47 bits choose the slice, the lower 16 the bit
    upper = F.shiftrightunsigned(h, 17) + 1
    slice_of = F.least(F.lit(slices - 1), F.floor(F.lit(47.0) - F.log2(upper.cast("double"))).cast("int"))
    bit = h.bitwiseAND(F.lit(bits - 1))
    words = df.select(
        *[_q(k) for k in keys],
        F.when(there, F.greatest(F.lit(0), slice_of)).otherwise(-1).alias(level),
        F.when(there, F.shiftrightunsigned(bit, 6).cast("int")).otherwise(-1).alias(word),
        F.when(there, F.expr("shiftleft(1L, cast(" + f"{'xxhash64(`' + column.replace('`', '``') + '`)'} & 63 as int))")).otherwise(0).alias(mask),
        there.cast("long").alias(rows),
    )
    return _or(words, keys, (level, word, mask, rows))


def _or(words: DataFrame, keys: list[str], names: tuple[str, ...] | list[str]) -> DataFrame:
    level, word, mask, rows = names
    return words.groupBy(*[_q(k) for k in keys], level, word).agg(F.bit_or(mask).alias(mask), F.sum(rows).alias(rows))


def merge_bitmaps(states: DataFrame, keys: list[str]) -> DataFrame:
    """Combine stored bitmaps to coarser ``keys``."""
    names = states.columns[-4:]
    return _or(states.select(*[_q(k) for k in keys], *names), keys, names)


def merge_bitmaps_cube(states: DataFrame, keys: list[str], sets: list[list[str]]) -> DataFrame:
    """Combine stored bitmaps to several groupings at once; a column ``grouping_id`` (first after the keys) tells a rolled-up key from a null one."""
    names = states.columns[-4:]
    level, word, mask, rows = names
    gid = free_name("grouping_id", [*keys, *names])
    made: dict[frozenset[str], DataFrame] = {frozenset(keys): materialize(states, "bitmaps")}
    parts = []
    for wanted in sorted((list(s) for s in sets), key=len, reverse=True):
        # from the smallest that is at hand: a coarse grouping never reads the finest rows if one between has been made
        source = made[min((s for s in made if s >= set(wanted)), key=len)]
        held = made.get(frozenset(wanted))
        if held is None:
            held = made[frozenset(wanted)] = materialize(merge_bitmaps(source, wanted), "bitmaps")
        number = sum(1 << (len(keys) - 1 - i) for i, k in enumerate(keys) if k not in wanted)
        shown = [_q(k) if k in wanted else F.lit(None).cast(states.schema[k].dataType).alias(k) for k in keys]
        parts.append(held.select(*shown, F.lit(number).cast("long").alias(gid), level, word, mask, rows))
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


def distinct_estimates(states: DataFrame, bits: int = BITS) -> DataFrame:
    """The keys, ``n_rows`` (rows of non-null identifiers) and ``n_distinct`` (bigint) of every group."""
    level, word, mask, rows = states.columns[-4:]
    keys = states.columns[:-4]
    out_rows, out = free_name("n_rows", keys), free_name("n_distinct", keys)
    per = states.groupBy(*[_q(k) for k in keys], level).agg(F.sum(F.bit_count(mask)).cast("long").alias(mask), F.sum(rows).alias(rows))
    held = per.groupBy(*[_q(k) for k in keys]).agg(
        F.sum(rows).alias(out_rows),
        F.max(F.when(F.col(mask) > int(bits * FULL), F.col(level) + 1).otherwise(0)).alias(level),
        F.collect_list(F.struct(F.col(level).alias("l"), F.col(mask).alias("s"))).alias(word),
    )
    share = F.aggregate(
        F.filter(F.col(word), lambda x: (x["l"] >= F.col(level)) & (x["l"] >= 0)),
        F.lit(0.0),
        lambda acc, x: acc - F.log(F.greatest(F.lit(0.5), F.lit(float(bits)) - x["s"]) / float(bits)) * float(bits),
    )
    return held.select(*[_q(k) for k in keys], out_rows, F.round(share * F.pow(F.lit(2.0), F.col(level))).cast("long").alias(out))


def error_bound(bits: int = BITS) -> float:
    """Relative standard error at any number of identifiers."""
    return 1.2 / math.sqrt(bits)
