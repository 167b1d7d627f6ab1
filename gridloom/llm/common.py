"""What the text operators share: inputs, sizes, range plans; tables between steps are those of gridloom.storage."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import math
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.storage import cut, release, scratch, scratch_path, small

__all__ = ["Bloom", "Ranges", "cut", "documents", "fresh", "held_out", "pages", "parts_for", "range_index", "range_plan", "release", "scratch", "scratch_path", "small", "trim"]


#: Ranges that a plan has at most: they get larger instead, and a task passes through one of any size row by row.
MOST_RANGES = 20_000


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet")


def trim() -> None:
    """Give memory that a Python worker has freed back to the machine; idle workers of other stages share it."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def held_out(doc_id: str = "doc_id") -> Column:
    """True for the quarter of documents (crc32 of the id as text, remainder 2) that no model may learn from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def parts_for(spark: SparkSession, rows: int, per_part: int) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(rows / per_part))


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have (names don't differ by case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


@dataclass(frozen=True)
class Ranges:
    """Ascending ranges of (key, tie), null keys first: the upper end of each but the last, and how many there are."""

    nulls: tuple[int, ...] = ()  # 0 for an upper end among null keys, else 1
    keys: tuple[int, ...] = ()
    ties: tuple[int, ...] = ()

    def __len__(self) -> int:
        return len(self.keys) + 1


@dataclass
class _Cell:
    """A box of keys (or of ties, if it holds one key only), and its weight."""

    null: bool
    lo: int
    hi: int
    tie_lo: int
    tie_hi: int
    weight: int

    def parts(self, n: int) -> tuple[bool, int, int]:
        """Whether the key is split (else the tie), from where, and the width of each part."""
        by_key = not self.null and self.lo < self.hi
        lo, hi = (self.lo, self.hi) if by_key else (self.tie_lo, self.tie_hi)
        return by_key, lo, -(-(hi - lo + 1) // n)

    def splits(self) -> bool:
        return (not self.null and self.lo < self.hi) or self.tie_lo < self.tie_hi


def range_plan(df: DataFrame, key: str, weight: Column, target: int, tie: Column | None = None, ties: int = 0, most: int = MOST_RANGES, fine: int = 2048) -> Ranges:
    """Deterministic ranges of an integer key, each of about `target` total weight, or of a `most`-th of all if that is more.

    Weights are summed exactly in equal-width bins. All bins that are far over target are refined together, by one more
    job over their rows, in proportion to their weight: so a job is run for each level of depth and not for each bin, and the
    driver sees some sixteen numbers for each range, whatever the input. Rows of one key (null is one, too) are split by
    `tie`, whose values are 0 to ties - 1, so a hot key has several ranges.
    """
    tie = F.lit(0) if tie is None else tie
    base = df.select(F.col(key).cast("long").alias("k"), tie.cast("long").alias("t"), weight.cast("long").alias("w"))
    known = F.col("k").isNotNull()
    ends = base.agg(F.min("k").alias("lo"), F.max("k").alias("hi"), F.sum(F.when(known, F.col("w"))).alias("w"), F.sum(F.when(~known, F.col("w"))).alias("none")).first()
    cells = [_Cell(True, 0, 0, 0, max(0, ties - 1), ends["none"])] if ends["none"] is not None else []
    if ends["lo"] is not None:
        cells.append(_Cell(False, ends["lo"], ends["hi"], 0, max(0, ties - 1), ends["w"] or 0))
    target = max(target, -(-sum(c.weight for c in cells) // most), 1)
    first = True
    while heavy := [i for i, c in enumerate(cells) if c.weight > 2 * target and c.splits()]:
        counts = [max(fine if first else 16, -(-4 * cells[i].weight // target)) for i in heavy]
        first = False
        plans = [cells[i].parts(n) for i, n in zip(heavy, counts)]
        # each row finds its cell, and in a heavy cell its part
        ranges = Ranges(*zip(*[(0 if c.null else 1, c.hi, c.tie_hi) for c in cells[:-1]])) if len(cells) > 1 else Ranges()
        number = {i: j for j, i in enumerate(heavy)}
        at = base.select(range_index(F.col("k"), ranges, F.col("t")).alias("cell"), "k", "t", "w")
        at = at.select(F.get(_longs([number.get(i, -1) for i in range(len(cells))]), F.col("cell")).cast("int").alias("cell"), "k", "t", "w").where("cell >= 0")
        by_key, lo, size = (F.get(_longs([int(p[k]) for p in plans]), F.col("cell")) for k in range(3))
        at = at.select("cell", "w", F.when(by_key == 1, F.col("k")).otherwise(F.col("t")).alias("value"), lo.alias("lo"), size.alias("size"))
        # decimals: the difference of two longs may be more than a long holds
        part = at.withColumn("part", F.expr("(cast(value as decimal(20,0)) - lo) div size"))
        got: dict[int, list] = {}
        for r in part.groupBy("cell", "part").agg(F.sum("w").alias("w")).collect():
            got.setdefault(r["cell"], []).append((r["part"], r["w"] or 0))
        out: list[_Cell] = []
        for i, c in enumerate(cells):
            if i not in number:
                out.append(c)
                continue
            j = number[i]
            by, start, wide = plans[j]
            end = c.hi if by else c.tie_hi
            for k, w in sorted(got.get(j, [])):
                a, b = start + k * wide, min(end, start + (k + 1) * wide - 1)
                out.append(_Cell(c.null, a, b, c.tie_lo, c.tie_hi, w) if by else _Cell(c.null, c.lo, c.hi, a, b, w))
        cells = out
    uppers, total = [], 0
    for c in cells[:-1]:
        total += c.weight
        if total >= target:
            uppers.append((0 if c.null else 1, c.hi, c.tie_hi))
            total = 0
    return Ranges(*zip(*uppers)) if uppers else Ranges()


def _longs(values: Iterable[int]) -> Column:
    """An array of longs, which the optimizer folds to one literal."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def range_index(key: Column, ranges: Ranges, tie: Column | None = None) -> Column:
    """Which range a key (null: before all others) and tie is in: a binary search over the upper ends, as a fold."""
    if len(ranges) < 2:
        return F.lit(0)
    nulls, keys, ties = map(_longs, (ranges.nulls, ranges.keys, ranges.ties))
    known, k, t = F.when(key.isNull(), 0).otherwise(1), F.coalesce(key.cast("long"), F.lit(0)), F.lit(0) if tie is None else tie
    steps = F.array(*[F.lit(1 << i) for i in reversed(range((len(ranges) - 1).bit_length()))])

    def below(i: Column) -> Column:
        """Whether the i-th upper end is below the row; false beyond the last."""
        n, a, b = F.get(nulls, i), F.get(keys, i), F.get(ties, i)
        same = F.when(known == 0, F.lit(True)).otherwise(a == k)
        return F.coalesce((n < known) | ((n == known) & (((known == 1) & (a < k)) | (same & (b < t)))), F.lit(False))

    # the result is the number of upper ends below the row
    return F.aggregate(steps, F.lit(0), lambda lo, step: F.when(below(lo + step - 1), lo + step).otherwise(lo))


#: Bits of a Bloom filter (a power of two).
FILTER_BITS = 23


class Bloom:
    """Which words (or numbers) may be among those a filter was made of; one that is always may. Sent to Python workers."""

    def __init__(self, words: DataFrame, column: str):
        """At most 2 ** (FILTER_BITS - 6) numbers reach the driver, however many words there are."""
        h = F.xxhash64(F.col(column).cast("string"))
        bits = words.select(F.explode(F.array(*[F.shiftrightunsigned(h, s).bitwiseAND((1 << FILTER_BITS) - 1) for s in (0, 20, 40)])).alias("bit"))
        packed = bits.groupBy(F.shiftright("bit", 6).cast("int").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("v"))
        self.bits = np.zeros(1 << (FILTER_BITS - 6), np.uint64)
        for r in packed.collect():
            self.bits[r["w"]] = np.uint64(r["v"] % (1 << 64))

    def __call__(self, word: str | int) -> bool:
        h, mask = xxhash.xxh64_intdigest(str(word).encode(), 42), (1 << FILTER_BITS) - 1
        return all(int(self.bits[(h >> s & mask) >> 6]) >> (h >> s & 63) & 1 for s in (0, 20, 40))
