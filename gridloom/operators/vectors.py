"""Vectors of windows: pooling, similarity, kernels."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.scalar import novelty, tile_weight, to_half
from gridloom.storage import cut, small


def window_cells(windows: DataFrame, r: int, keep: tuple[str, ...] = ("slide_id", "roi_id")) -> DataFrame:
    """One row per window and cell of it: fan-out r², so that tiles are met by an equi-join instead of a range join."""
    offsets = F.sequence(F.lit(0), F.lit(r - 1))
    rows = windows.select(*keep, F.col("grid_i").alias("_i"), F.col("grid_j").alias("_j"), F.explode(offsets).alias("di"))
    return rows.select(*keep, "_j", (F.col("_i") + F.col("di")).alias("grid_i"), F.explode(offsets).alias("dj")).select(*keep, "grid_i", (F.col("_j") + F.col("dj")).alias("grid_j"))


#: Keys whose sums a task holds before it hands them on.
HELD_KEYS = 4096


def vector_sums(rows: DataFrame, keys: list[str], vector: str, weights: dict[str, Column]) -> DataFrame:
    """Of each key, for each named weight: the weighted sum of the vectors (name) and of the weights (name_total).

    A task first adds up its own rows of a key in numpy, so a hot key is a row for each task when it is shuffled, and no
    vector is ever taken apart into rows. Rows without a vector are left out; vectors of one task have one length.
    """
    names = list(weights)
    given = rows.where(F.col(vector).isNotNull()).select(*keys, *(w.cast("double").alias(f"_w{i}") for i, w in enumerate(weights.values())), F.col(vector).cast("array<double>").alias("_v"))
    key_types = [f.dataType.simpleString() for f in given.select(*keys).schema]
    schema = ", ".join([*(f"`{k}` {t}" for k, t in zip(keys, key_types)), *(f"_s{i} array<double>, _t{i} double" for i in range(len(names)))])
    k = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, int] = {}
        sums = totals = kinds = None

        def flush() -> Iterator[pa.RecordBatch]:
            if held:
                n = len(held)
                cols = [pa.array([key[i] for key in held], kinds[i]) for i in range(k)]
                for i in range(len(names)):
                    ends = np.arange(0, (n + 1) * sums.shape[2], sums.shape[2], dtype=np.int32) if sums.shape[2] else np.zeros(n + 1, np.int32)
                    cols += [pa.ListArray.from_arrays(pa.array(ends), pa.array(sums[i, :n].ravel())), pa.array(totals[i, :n])]
                yield pa.RecordBatch.from_arrays(cols, [*keys, *(x for i in range(len(names)) for x in (f"_s{i}", f"_t{i}"))])
                held.clear()
                sums[:], totals[:] = 0, 0

        for b in batches:
            if not b.num_rows:
                continue
            lists = b.column(k + len(names))
            lengths = np.diff(lists.offsets.to_numpy())
            if lengths.min() != lengths.max():
                raise ValueError("vectors differ in length")
            x = lists.flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, lengths[0])
            w = [b.column(k + i).to_numpy(zero_copy_only=False) for i in range(len(names))]
            kinds = [b.column(i).type for i in range(k)]
            if sums is not None and sums.shape[2] != x.shape[1]:
                raise ValueError("vectors differ in length")
            if sums is None:
                sums, totals = np.zeros((len(names), HELD_KEYS, x.shape[1])), np.zeros((len(names), HELD_KEYS))
            rows_of = list(zip(*(b.column(i).to_pylist() for i in range(k))))
            at = 0
            while at < len(rows_of):
                codes = []
                for key in rows_of[at:]:
                    if key not in held and len(held) == HELD_KEYS:
                        break
                    codes.append(held.setdefault(key, len(held)))
                upto = at + len(codes)
                order = np.argsort(codes, kind="stable")
                code = np.asarray(codes)[order]
                heads = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
                for i in range(len(names)):
                    part = w[i][at:upto][order]
                    sums[i, code[heads]] += np.add.reduceat(x[at:upto][order] * part[:, None], heads, axis=0)
                    totals[i, code[heads]] += np.add.reduceat(part, heads)
                at = upto
                if at < len(rows_of):
                    yield from flush()
        yield from flush()

    parts = given.mapInArrow(run, schema)
    add = lambda c: F.aggregate(F.slice(c, 2, F.size(c)), F.get(c, 0), lambda a, x: F.zip_with(a, x, lambda p, q: p + q))
    both = parts.groupBy(*keys).agg(*(x for i in range(len(names)) for x in (F.collect_list(f"_s{i}").alias(f"_l{i}"), F.sum(f"_t{i}").alias(f"{names[i]}_total"))))
    return both.select(*keys, *(x for i, n in enumerate(names) for x in (add(F.col(f"_l{i}")).alias(n), F.col(f"{n}_total"))))


def weighted_mean(rows: DataFrame, keys: list[str], vector: str, weight: Column, out: str = "embedding") -> DataFrame:
    """The weighted mean vector of each key; zero total weight: the plain mean."""
    sums = vector_sums(rows, keys, vector, {"_weighted": weight, "_plain": F.lit(1.0)})
    mean = lambda n: F.transform(n, lambda x: x / F.col(f"{n}_total"))
    return sums.select(*keys, F.when(F.col("_weighted_total") > 0, mean("_weighted")).otherwise(mean("_plain")).alias(out))


def window_embeddings(windows: DataFrame, tiles: DataFrame, features: DataFrame, r: int, tile_tissue: float, width: int) -> DataFrame:
    """(slide_id, roi_id, embedding): tiles' features pooled by tissue x (1 - artifact) over each window's valid tiles.

    All weights zero: plain mean. No valid tile: zeros. Features are joined only to the tiles that windows need.
    """
    valid = tiles.where(to_half(F.col("tissue_frac")) >= tile_tissue).select("slide_id", "grid_i", "grid_j", tile_weight(to_half(F.col("tissue_frac")), to_half(F.col("artifact_frac"))).alias("w"))
    cells = window_cells(windows, r).join(valid, ["slide_id", "grid_i", "grid_j"]).join(features, ["slide_id", "grid_i", "grid_j"])
    pooled = weighted_mean(cells, ["slide_id", "roi_id"], "features", F.col("w"))
    out = windows.select("slide_id", "roi_id").join(pooled, ["slide_id", "roi_id"], "left")
    return out.select("slide_id", "roi_id", F.coalesce("embedding", F.array_repeat(F.lit(0.0), width)).alias("embedding"))


#: Points of a block. A slide's points are dealt into blocks by a hash, and a task compares two of them: 16 blocks at most,
#: so that a point is sent to few tasks, unless blocks would get so large that a task could not hold them.
BLOCK_POINTS, MOST_BLOCKS, LARGEST_BLOCK = 2048, 16, 16_384
#: Numbers of a piece of differences that a task works on and hands on at once; few, for the processor's cache.
BLOCK_NUMBERS = 1 << 16
#: Partitions that pairs of blocks are dealt to, at most.
MOST_PARTS = 10_000
#: Points that `_checked` lets pass: for callers that hold all numbers of one slide's pairs at once.
MOST_POINTS = 4096


def _checked(pdf: pd.DataFrame, slide: str) -> pd.DataFrame:
    if len(pdf) > MOST_POINTS:
        raise ValueError(f"slide {pdf[slide].iloc[0]} has {len(pdf)} points to compare, over {MOST_POINTS}")
    return pdf


def _vectors(table: pa.Table) -> np.ndarray:
    """The embeddings of a table as a matrix of doubles."""
    lists = table["embedding"].combine_chunks()
    lengths = np.diff(lists.offsets.to_numpy())
    if lists.null_count or (len(lengths) and lengths.min() != lengths.max()):
        raise ValueError("vectors differ in length")
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(lists), -1)


def _blocks(points: DataFrame, slide: str, name: str) -> DataFrame:
    """(slide, name): the number of blocks of each slide that needs more than one."""
    n = F.count("*")
    many = F.greatest(F.least(F.ceil(n / BLOCK_POINTS), F.lit(MOST_BLOCKS)), F.ceil(n / LARGEST_BLOCK)).cast("int")
    return points.groupBy(slide).agg(many.alias(name)).where(F.col(name) > 1)


def _parts(points: DataFrame, tasks: int) -> int:
    return max(int(points.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(MOST_PARTS, tasks))


def history_similarity(candidates: DataFrame, history: DataFrame, slide: str = "slide_id", key: str = "roi_id") -> DataFrame:
    """(slide, key, max_similarity): the greatest cosine of each candidate to the slide's earlier picks; slides without any are left out.

    A block of a slide's candidates meets a block of its different picks as two matrices in one task, whatever their number.
    """
    kinds = {c: candidates.schema[c].dataType.simpleString() for c in (slide, key)}
    a = cut(candidates.select(slide, key, "embedding").where(F.col(slide).isNotNull()), "candidates")
    b = cut(history.select(F.col(slide).cast(kinds[slide]).alias(slide), "embedding").where(F.col(slide).isNotNull()).distinct(), "history")
    na, nb = cut(_blocks(a, slide, "_na"), "blocks"), cut(_blocks(b, slide, "_nb"), "blocks")
    both = na.join(nb, slide, "full").select(slide, F.coalesce("_na", F.lit(1)).alias("_na"), F.coalesce("_nb", F.lit(1)).alias("_nb"))
    tasks = both.agg(F.sum(F.col("_na").cast("long") * F.col("_nb"))).first()[0] or 0

    def dealt(rows: DataFrame, of: str, own: str, other: str, *more: Column) -> DataFrame:
        n = lambda c: F.coalesce(c, F.lit(1))
        met = rows.join(small(both), slide, "left").withColumn(own, F.pmod(F.xxhash64(of), n(f"_n{own[1]}")).cast("int"))
        return met.withColumn(other, F.explode(F.sequence(F.lit(0), n(f"_n{other[1]}") - 1))).select(slide, *more, "embedding", "_a", "_b")

    rows = dealt(a, key, "_a", "_b", F.col(key)).withColumn("_new", F.lit(True))
    rows = rows.unionByName(dealt(b, "embedding", "_b", "_a", F.lit(None).cast(kinds[key]).alias(key)).withColumn("_new", F.lit(False)))

    def unit(x: np.ndarray) -> np.ndarray:
        norm = np.sqrt((x * x).sum(1, keepdims=True))
        return x / np.where(norm > 0, norm, 1.0)

    def run(table: pa.Table) -> pa.Table:
        new = table["_new"]
        mine, past = table.filter(new), table.filter(pc.invert(new))
        best = np.zeros(0)
        if len(past) and len(mine):
            x, y = unit(_vectors(mine)), unit(_vectors(past)).T
            step = max(1, 16 * BLOCK_NUMBERS // y.shape[1])
            best = np.concatenate([(x[k : k + step] @ y).max(1) for k in range(0, len(x), step)])
        return pa.table({slide: mine[slide][: len(best)], key: mine[key][: len(best)], "max_similarity": best})

    found = rows.repartition(_parts(rows, tasks), slide, "_a", "_b").groupBy(slide, "_a", "_b").applyInArrow(run, f"`{slide}` {kinds[slide]}, `{key}` {kinds[key]}, max_similarity double")
    return found.groupBy(slide, key).agg(F.max("max_similarity").alias("max_similarity"))


def with_novelty(candidates: DataFrame, history: DataFrame, alpha: float = 1.0, eps: float = 0.05) -> DataFrame:
    """candidates with max_similarity (0 without history) and novelty."""
    near = history_similarity(candidates, history)
    out = candidates.join(near, ["slide_id", "roi_id"], "left").withColumn("max_similarity", F.coalesce("max_similarity", F.lit(0.0)))
    return out.withColumn("novelty", novelty(F.col("max_similarity"), alpha, eps))


def squared_distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The squared distances of the rows of x to those of y, summed from the first column to the last, as SQL does."""
    out, step = np.empty((len(x), len(y))), max(1, BLOCK_NUMBERS // max(1, len(y)))
    columns = np.ascontiguousarray(y.T)
    for k in range(0, len(x), step):
        part = out[k : k + step]
        part[:] = 0
        held = np.empty_like(part)
        for c in range(len(columns)):
            np.subtract(x[k : k + step, c, None], columns[c], out=held)
            held *= held
            part += held
    return out


def _pairs(points: DataFrame, slide: str, key: str, extra: list[str], of: Callable[[pa.Table, pa.Table, bool], Iterator[pa.RecordBatch]], columns: str) -> DataFrame:
    """What `of` makes of each two blocks of a slide's points, and of each block with itself (its last argument is true then).

    points are read twice, so they should be a table. Rows without a slide or a key have no pairs.
    """
    kind = points.schema[slide].dataType.simpleString()
    known = points.select(slide, key, *extra, "embedding").where(F.col(slide).isNotNull() & F.col(key).isNotNull())
    many = cut(_blocks(known, slide, "_n"), "blocks")
    tasks = many.agg(F.sum(F.col("_n").cast("long") * (F.col("_n") + 1) / 2)).first()[0] or 0
    n = F.coalesce("_n", F.lit(1))
    dealt = known.join(small(many), slide, "left").withColumn("_b", F.pmod(F.xxhash64(key), n).cast("int")).withColumn("_c", F.explode(F.sequence(F.lit(0), n - 1)))
    dealt = dealt.select(slide, key, *extra, "embedding", "_b", F.least("_b", "_c").alias("_lo"), F.greatest("_b", "_c").alias("_hi"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches)
        lo, hi, own = table["_lo"][0], table["_hi"][0], table["_b"]
        a = table.filter(pc.equal(own, lo))
        b = a if lo == hi else table.filter(pc.equal(own, hi))
        if len(a) and len(b):
            for part in of(a, b, lo == hi):
                yield pa.RecordBatch.from_arrays([pa.repeat(a[slide][0], part.num_rows), *part.columns], [slide, *part.schema.names])

    return dealt.repartition(_parts(points, math.ceil(tasks)), slide, "_lo", "_hi").groupBy(slide, "_lo", "_hi").applyInArrow(run, f"`{slide}` {kind}, {columns}")


def _codes(table: pa.Table, key: str) -> np.ndarray:
    """Numbers that are the same where keys are."""
    return table[key].combine_chunks().dictionary_encode().indices.to_numpy()


def _each_pair(points: DataFrame, slide: str, key: str, extra: list[str], value: Callable[[np.ndarray, pa.Table, np.ndarray, pa.Table], np.ndarray], name: str) -> DataFrame:
    """(slide, a_key, b_key, name): a row for each ordered pair with different keys; value makes the numbers of some rows against a block."""
    kind = points.schema[key].dataType.simpleString()

    def of(a: pa.Table, b: pa.Table, same: bool) -> Iterator[pa.RecordBatch]:
        x, y, names = _vectors(a), _vectors(b), [f"a_{key}", f"b_{key}", name]
        ka, kb = a[key].combine_chunks(), b[key].combine_chunks()
        codes = _codes(a, key) if same else None
        step = max(1, BLOCK_NUMBERS // len(y))
        for k in range(0, len(x), step):
            rows, all_b = np.arange(k, min(k + step, len(x))), np.arange(len(y))
            v = value(squared_distances(x[rows], y), a.slice(k, len(rows)), b).ravel()
            i, j = np.repeat(rows, len(y)), np.tile(all_b, len(rows))
            if same:  # all of its ordered pairs are here; keys of other blocks differ
                far = codes[i] != codes[j]
                i, j, v = i[far], j[far], v[far]
            left, right = ka.take(pa.array(i)), kb.take(pa.array(j))
            yield pa.RecordBatch.from_arrays([left, right, pa.array(v)], names)
            if not same:
                yield pa.RecordBatch.from_arrays([right, left, pa.array(v)], names)

    return _pairs(points, slide, key, extra, of, f"`a_{key}` {kind}, `b_{key}` {kind}, `{name}` double")


def pair_distances(points: DataFrame, slide: str = "slide_id", key: str = "roi_id") -> DataFrame:
    """(slide, a_key, b_key, d2): squared distances of the ordered pairs a <> b of one slide's points, however many they are."""
    return _each_pair(cut(points.select(slide, key, "embedding"), "points"), slide, key, [], lambda d2, a, b: d2, "d2")


def bandwidth(distances: DataFrame, slide: str = "slide_id") -> DataFrame:
    """(slide, sigma): root of the median positive squared distance; 1 where there is none. For slides of few points: see bandwidths."""
    return distances.groupBy(slide).agg(F.coalesce(F.sqrt(F.median(F.when(F.col("d2") > 0, F.col("d2")))), F.lit(1.0)).alias("sigma"))


#: Bits of a distance that one pass over the pairs finds, of the 63 that positive numbers have: three passes.
PASS_BITS = 21


def _distance_bits(x: np.ndarray, y: np.ndarray, wanted: np.ndarray, shift: int, prefixes: list[int] | None) -> np.ndarray:
    """The bits, from `shift` upwards, of the positive squared distances of the wanted pairs that begin with one of the prefixes.

    One product of matrices gives all distances with a bounded error. Only where that leaves the bits open is a distance
    summed as squared_distances does. More of them than asked for may be returned, if prefixes are given.
    """
    nx, ny = (x * x).sum(1)[:, None], (y * y).sum(1)
    size = nx + ny
    near = size - 2 * (x @ y.T)
    size *= 16 * (x.shape[1] + 8) * 2.0**-53
    least, most = near - size, near + size
    if prefixes is None:
        low, high = least.view(np.int64) >> shift, most.view(np.int64) >> shift
        sure = (least > 0) & (low == high)
        found, open_ = low[sure & wanted], ~sure & wanted
    else:
        ends = [np.array([p << shift + PASS_BITS, p + 1 << shift + PASS_BITS]).view(np.float64) for p in prefixes]
        found, open_ = np.zeros(0, np.int64), ~np.logical_and.reduce([(most < low) | (least >= high) for low, high in ends]) & wanted
    i, j = np.nonzero(open_)
    d2 = np.zeros(len(i))
    for c in range(x.shape[1] if len(i) else 0):
        d2 += (x[i, c] - y[j, c]) ** 2
    d2 = d2[~(d2 <= 0)]
    d2[np.isnan(d2)] = np.nan  # of one sign
    return np.concatenate([found, d2.view(np.int64) >> shift])


def bandwidths(points: DataFrame, slide: str = "slide_id", key: str = "roi_id") -> DataFrame:
    """(slide, sigma): bandwidth() of pair_distances(), exact, without a row for a pair.

    Positive numbers are ordered as their bits are. Each pass goes over all pairs and counts the next bits of those that
    begin like the median (like the two middle ones), so a task holds at most 2 ** (PASS_BITS + 1) counts.
    """
    kind = points.schema[slide].dataType.simpleString()
    points = cut(points.select(slide, key, "embedding").where(F.col(slide).isNotNull() & F.col(key).isNotNull()), "points")
    slides = points.groupBy(slide).agg(F.min(key).alias("_least"), F.max(key).alias("_most")).where("_least < _most").select(slide)
    target = None
    for shift in range(2 * PASS_BITS, -1, -PASS_BITS):

        def of(a: pa.Table, b: pa.Table, same: bool, shift: int = shift) -> Iterator[pa.RecordBatch]:
            x, y = _vectors(a), _vectors(b)
            codes = _codes(a, key) if same else None
            prefixes = sorted(set(a["_prefixes"][0].as_py())) if shift < 2 * PASS_BITS else [0]
            counts = {p: np.zeros(0, np.int64) for p in prefixes}
            step = max(1, BLOCK_NUMBERS // len(y))
            for k in range(0, len(x), step):
                first = k + 1 if same else 0  # a pair once
                rows = np.arange(k, min(k + step, len(x)))
                wanted = np.ones((len(rows), len(y) - first), bool)
                if same:
                    wanted = (np.arange(first, len(y)) > rows[:, None]) & (codes[first:] != codes[rows, None])
                bits = _distance_bits(x[rows], y[first:], wanted, shift, prefixes if shift < 2 * PASS_BITS else None)
                for p in prefixes:
                    mine = bits[bits >> PASS_BITS == p] if shift < 2 * PASS_BITS else bits
                    if len(mine):
                        more = np.bincount(mine & ((1 << PASS_BITS) - 1))
                        if len(more) > len(counts[p]):
                            counts[p] = np.concatenate([counts[p], np.zeros(len(more) - len(counts[p]), np.int64)])
                        counts[p][: len(more)] += more
            for p, n in counts.items():
                at = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), p, np.int64)), pa.array(at), pa.array(n[at])], ["_prefix", "_bin", "_count"])

        if target is None:
            rows = points
        else:
            both = target.groupBy(slide).agg(F.collect_list("_prefix").alias("_prefixes"))
            rows = points.join(small(both), slide)
        counts = cut(_pairs(rows, slide, key, [] if target is None else ["_prefixes"], of, "_prefix long, _bin long, _count long").groupBy(slide, "_prefix", "_bin").agg(F.sum("_count").alias("_count")), "counts")
        if target is None:  # the places of the middle ones, from 0
            sums = counts.groupBy(slide).agg(F.sum("_count").alias("_sum"))
            target = sums.select(slide, F.lit(0).cast("long").alias("_prefix"), F.posexplode(F.array(F.floor((F.col("_sum") - 1) / 2), F.floor(F.col("_sum") / 2))).alias("_half", "_place"))
        upto = F.sum("_count").over(Window.partitionBy(slide, "_half").orderBy("_bin"))
        met = counts.join(small(target), [slide, "_prefix"]).withColumn("_upto", upto)
        hit = met.where((F.col("_upto") > F.col("_place")) & (F.col("_upto") - F.col("_count") <= F.col("_place")))
        target = cut(hit.select(slide, "_half", (F.shiftleft("_prefix", PASS_BITS) + F.col("_bin")).alias("_prefix"), (F.col("_place") - (F.col("_upto") - F.col("_count"))).alias("_place")), "places")

    def numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(b.column(1).to_numpy().view(np.float64))], [slide, "_d2"])

    middle = target.select(slide, "_prefix").mapInArrow(numbers, f"`{slide}` {kind}, _d2 double").groupBy(slide).agg(F.min("_d2").alias("_d"), F.max("_d2").alias("_e"))
    return slides.join(middle, slide, "left").select(slide, F.coalesce(F.sqrt(F.col("_d") + (F.col("_e") - F.col("_d")) * 0.5), F.lit(1.0)).alias("sigma"))


def kernel_entries(points: DataFrame, r: int, tau: float | None = None, jitter: float = 1e-6) -> DataFrame:
    """(slide_id, a, b, value): q_a q_b exp(-d²/σ²) exp(-p²/τ²) for all pairs and the diagonal; τ is 1.5 r by default.

    points: slide_id, roi_id, grid_i, grid_j, quality, embedding. The bandwidth σ is that of all pairs of the slide
    (bandwidths); entries are made block by block, however many points a slide has.
    """
    tau = 1.5 * r if tau is None or tau <= 0 else tau
    given = cut(points.select("slide_id", "roi_id", *(F.col(c).cast("double").alias(c) for c in ("grid_i", "grid_j", "quality")), "embedding"), "points")

    def value(d2: np.ndarray, a: pa.Table, b: pa.Table) -> np.ndarray:
        i, j, q = ((a[c].to_numpy()[:, None], b[c].to_numpy()) for c in ("grid_i", "grid_j", "quality"))
        sigma = a["sigma"][0].as_py()
        p2 = (i[0] - i[1]) ** 2 + (j[0] - j[1]) ** 2
        return q[0] * q[1] * np.exp(-d2 / (sigma * sigma)) * np.exp(-p2 / (tau * tau))

    scaled = cut(given.join(small(cut(bandwidths(given), "bandwidths")), "slide_id"), "points")
    entries = _each_pair(scaled, "slide_id", "roi_id", ["grid_i", "grid_j", "quality", "sigma"], value, "value")
    diagonal = given.select("slide_id", F.col("roi_id").alias("a"), F.col("roi_id").alias("b"), (F.col("quality") * F.col("quality") + F.lit(jitter)).alias("value"))
    return entries.select("slide_id", F.col("a_roi_id").alias("a"), F.col("b_roi_id").alias("b"), "value").unionByName(diagonal)


def masked_mean(rows: DataFrame, keys: list[str], vector: str, valid: str, out: str = "pooled") -> DataFrame:
    """Mean vector of the valid rows; the count is at least 1, so without a valid row it is zeros."""
    sums = vector_sums(rows, keys, vector, {"_valid": F.when(F.col(valid), 1.0).otherwise(0.0)})
    return sums.select(*keys, F.transform("_valid", lambda x: x / F.greatest(F.lit(1.0), F.col("_valid_total"))).alias(out))


def overlap_mean(rows: DataFrame, keys: list[str], vector: str, out: str = "target") -> DataFrame:
    """Mean of the vectors that fall on one cell, and how many there are."""
    sums = vector_sums(rows, keys, vector, {"_all": F.lit(1.0)})
    return sums.select(*keys, F.transform("_all", lambda x: x / F.col("_all_total")).alias(out), F.col("_all_total").cast("long").alias("n"))


def running_centre(batches: DataFrame, group: str, order: str, vector: str, momentum: float, start: list[float]) -> DataFrame:
    """(group, centre) after folding each batch's mean in order: c = m c + (1 - m) x; more than MOST_LISTED batches of one group are an error."""
    from gridloom.operators.select import checked_list

    steps = checked_list(batches.groupBy(group).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(vector).alias("v")))).alias("_s")), group, "_s")
    first = F.array(*[F.lit(float(x)) for x in start])
    fold = F.aggregate("_s", first, lambda c, s: F.zip_with(c, s["v"], lambda a, b: a * F.lit(momentum) + b.cast("double") * F.lit(1 - momentum)))
    return steps.select(group, fold.alias("centre"))


def best_class(scores: DataFrame, keys: list[str], label: str, score: str) -> DataFrame:
    """(keys, label) with the greatest score; ties: the least label."""
    return scores.groupBy(*keys).agg(F.max(F.struct(F.col(score).alias("s"), (-F.col(label)).alias("l"))).alias("m")).select(*keys, (-F.col("m.l")).alias(label))


def extremes(points: DataFrame, columns: list[str], slide: str = "slide_id") -> DataFrame:
    return points.groupBy(slide).agg(*(f(c).alias(f"{n}_{c}") for c in columns for n, f in (("min", F.min), ("max", F.max))))

