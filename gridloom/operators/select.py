"""Small, diverse, non-overlapping subsets of each slide's candidates."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.storage import cut, small


def farthest_points(x: np.ndarray, q: np.ndarray, k: int, seed: int | str = 0) -> list[int]:
    """k indices: first the greatest quality (a hash with the seed breaks ties), then ever the greatest distance² x quality.

    Where no quality is positive the distance alone counts. Later ties go to the first index.
    """
    n = len(x)
    k = min(k, n)
    if k <= 0:
        return []
    top = np.flatnonzero(q == q.max())
    first = min(top.tolist(), key=lambda i: hashlib.md5(f"{i}:{seed}".encode()).hexdigest()) if len(top) > 1 else int(top[0])
    factor = q if (q > 0).any() else np.ones(n)
    chosen, near = [first], ((x - x[first]) ** 2).sum(1)
    while len(chosen) < k:
        score = near * factor
        score[chosen] = -1
        chosen.append(int(score.argmax()))
        near = np.minimum(near, ((x - x[chosen[-1]]) ** 2).sum(1))
    return chosen


#: Jitter of a kernel's diagonal.
JITTER = 1e-6
#: Candidates of one slide whose kernel is made whole, to draw by its eigenvectors; more are drawn by rejection.
EIGEN_POINTS = 512
#: Draws that are tried with each number of pivots.
TRIALS = 500


def kernel_matrix(x: np.ndarray, q: np.ndarray, ij: np.ndarray, r: int, tau: float | None = None) -> np.ndarray:
    d2 = ((x[:, None] - x[None]) ** 2).sum(-1)
    p2 = ((ij[:, None] - ij[None]) ** 2).sum(-1)
    some = d2[d2 > 0]
    s2 = float(np.median(some)) if len(some) else 1.0
    tau = 1.5 * r if tau is None or tau <= 0 else tau
    m = q[:, None] * q[None] * np.exp(-d2 / s2) * np.exp(-p2 / tau**2)
    return (m + m.T) / 2 + JITTER * np.eye(len(x))


def _symmetric(value: np.ndarray, k: int) -> np.ndarray:
    """e[i, m]: the i-th elementary symmetric polynomial of the first m values, up to i = k."""
    n = len(value)
    e = np.zeros((k + 1, n + 1))
    e[0] = 1
    for size in range(1, k + 1):
        for m in range(1, n + 1):
            e[size, m] = e[size, m - 1] + value[m - 1] * e[size - 1, m - 1]
    return e


def _taken(value: np.ndarray, e: np.ndarray, k: int, rng: np.random.Generator) -> list[int]:
    """Which k eigenvectors a draw is made of."""
    left, take = k, []
    for m in range(len(value), 0, -1):
        if left and rng.random() < value[m - 1] * e[left - 1, m - 1] / e[left, m]:
            take.append(m - 1)
            left -= 1
    return take


def _items(v: np.ndarray, rng: np.random.Generator) -> list[int]:
    """A draw from the projection onto orthonormal columns, one item for each."""
    out = []
    while v.shape[1]:
        p = np.maximum((v**2).sum(1), 0)
        item = int(rng.choice(len(v), p=p / p.sum()))
        out.append(item)
        pivot = int(np.abs(v[item]).argmax())
        v = v - np.outer(v[:, pivot], v[item] / v[item, pivot])
        v = np.delete(v, pivot, 1)
        if v.shape[1]:
            v, _ = np.linalg.qr(v)
    return out


def determinantal(kernel: np.ndarray, k: int, seed: int) -> list[int]:
    """An exact draw of k items from a k-DPP: eigenvectors by elementary symmetric polynomials, then one item at a time."""
    rng = np.random.default_rng(seed)
    value, vector = np.linalg.eigh(kernel)
    value = np.maximum(value, 0)
    e = _symmetric(value, k)
    if not np.isfinite(e).all() or e[k, -1] <= 0:
        raise ValueError("the kernel has too little rank")
    return _items(vector[:, _taken(value, e, k, rng)], rng)


def determinantal_by_rejection(x: np.ndarray, q: np.ndarray, ij: np.ndarray, tau: float, s2: float, k: int, seed: int) -> list[int]:
    """A draw as exact as that of determinantal(kernel_matrix()), whose kernel L is never made whole.

    A proposal is a k-DPP of B Bᵀ + D: B has some columns of a pivoted Cholesky factor of L, D is a diagonal with
    L_S ⪯ (B Bᵀ + D)_S for each set S of k items. It is a mixture: t items from the t-DPP of B Bᵀ, the others alone, in
    proportion to D. S is taken with probability det(L_S) / det((B Bᵀ + D)_S), so what is taken is a draw of the k-DPP of L,
    however many are rejected. Without pivots D is L's diagonal (Hadamard); with pivots it is k times that of what is left of L,
    as no matrix of k rows exceeds k times its diagonal. Where candidates are so alike that sets are rejected, there are more
    pivots; a draw holds a number for each candidate and pivot.
    """
    rng, n = np.random.default_rng(seed), len(x)

    def row(at: int) -> np.ndarray:
        """A row of L without its jitter."""
        return q[at] * q * np.exp(-((x - x[at]) ** 2).sum(1) / s2) * np.exp(-((ij - ij[at]) ** 2).sum(1) / tau**2)

    def block(s: list[int]) -> np.ndarray:
        d2, p2 = ((x[s][:, None] - x[s]) ** 2).sum(-1), ((ij[s][:, None] - ij[s]) ** 2).sum(-1)
        return np.outer(q[s], q[s]) * np.exp(-d2 / s2) * np.exp(-p2 / tau**2) + JITTER * np.eye(k)

    rest, b = q * q, np.zeros((n, 0))
    for pivots in (0, *(m for m in (1 << p for p in range(5, 40)) if m < n), n):
        done, b = b.shape[1], np.concatenate([b, np.zeros((n, pivots - b.shape[1]))], 1)
        while done < pivots and rest.max() > 1e-3 * JITTER:
            at = int(rest.argmax())
            b[:, done] = (row(at) - b[:, :done] @ b[at, :done]) / math.sqrt(rest[at])
            rest = np.maximum(rest - b[:, done] ** 2, 0)
            rest[at], done = 0, done + 1
        b = b[:, :done]
        d = (k if pivots else 1) * rest + JITTER
        value, vector = np.linalg.eigh(b.T @ b)
        value, scale = np.maximum(value, 0), d.sum() + (b * b).sum()
        e = _symmetric(value / scale, k)
        alone = np.array([math.exp((k - t) * math.log(d.sum() / scale) - math.lgamma(k - t + 1)) for t in range(k + 1)])
        weight = e[:, -1] * alone
        if not np.isfinite(weight).all() or weight.sum() <= 0:
            raise ValueError("the kernel has too little rank")
        sums = np.cumsum(d)
        for _ in range(TRIALS):
            t = int(rng.choice(k + 1, p=weight / weight.sum()))
            take = _taken(value / scale, e, t, rng)
            s = _items(b @ (vector[:, take] / np.sqrt(value[take])), rng) if t else []
            s += np.minimum(np.searchsorted(sums, rng.random(k - t) * sums[-1], side="right"), n - 1).tolist()
            if len(set(s)) < k:
                continue
            bound = np.linalg.det(b[s] @ b[s].T + np.diag(d[s]))
            if bound > 0 and rng.random() * bound < np.linalg.det(block(s)):
                return s
        if done < pivots:  # more columns would not differ
            break
    raise ValueError("the kernel has too little rank")


def iou(a: np.ndarray, b: np.ndarray, size: int) -> float:
    inter = max(0, size - abs(int(a[0]) - int(b[0]))) * max(0, size - abs(int(a[1]) - int(b[1])))
    return inter / (2 * size * size - inter)


def diverse(x: np.ndarray, q: np.ndarray, ij: np.ndarray, group: np.ndarray, history: np.ndarray, k: int, size: int, nms: float = 0.3, most_history: float | None = 0.6, method: str = "fps", seed: int = 0, tau: float | None = None, spread: bool = False, s2: float | None = None) -> list[int]:
    """Indices picked from one slide's candidates: a diverse set, without overlaps, filled up by quality.

    spread: where two or more picks are all of one known group, the weakest of them makes room for the best candidate of
    another group that may stand beside the rest. s2: the squared bandwidth; with it, kdpp
    makes no kernel of more than EIGEN_POINTS candidates.
    """
    n = len(x)
    if n == 0 or k <= 0:
        return []
    by_quality = np.argsort(-q, kind="stable").tolist()
    if n <= k:
        order = list(range(n))
    else:
        order = []
        if method == "kdpp":
            try:
                if n <= EIGEN_POINTS or s2 is None:
                    order = determinantal(kernel_matrix(x, q, ij, size, tau), k, seed)
                else:
                    order = determinantal_by_rejection(x, q, ij, 1.5 * size if tau is None or tau <= 0 else tau, s2, k, seed)
            except (ValueError, np.linalg.LinAlgError):
                order = []
        order = order or farthest_points(x, q, k, seed)
    order += [i for i in by_quality if i not in order][: max(0, min(k, n) - len(order))]
    apart = lambda i, kept, bound: bound <= 0 or all(iou(ij[i], ij[j], size) <= bound for j in kept)
    fresh = lambda i: most_history is None or most_history <= 0 or not len(history) or all(iou(ij[i], h, size) <= most_history for h in history)
    picked: list[int] = []
    for i in order:
        if apart(i, picked, nms):
            picked.append(i)
    picked = [i for i in picked if fresh(i)]
    admissible = lambda i, kept: fresh(i) and all(iou(ij[i], ij[j], size) <= max(nms, 0.0) for j in kept) if len(history) else apart(i, kept, nms)
    for i in by_quality:
        if len(picked) >= k:
            break
        if i not in picked and admissible(i, picked):
            picked.append(i)
    known = [group[i] for i in picked]
    if spread and len(picked) >= 2 and all(g >= 0 for g in known) and len(set(known)) == 1:
        weakest = min(picked, key=lambda i: (q[i], picked.index(i)))
        rest = [i for i in picked if i != weakest]
        for i in by_quality:
            if i not in picked and group[i] >= 0 and group[i] != known[0] and fresh(i) and all(iou(ij[i], ij[j], size) <= nms for j in rest):
                return [*rest, i]
    return picked


_PICKED = "slide_id {kind}, roi_id int, pick int"


def select_diverse(candidates: DataFrame, k: int, size: int, history: DataFrame | None = None, **options) -> DataFrame:
    """(slide_id, roi_id, pick) of the chosen candidates (slide_id, roi_id, grid_i, grid_j, quality, group_id, embedding).

    history (slide_id, grid_i, grid_j): earlier picks to stay away from. One slide's candidates are one task's rows; they
    are bounded by the number asked for per slide. For kdpp the bandwidths of slides with more than EIGEN_POINTS are found
    before, over blocks of their pairs.
    """
    from gridloom.operators.vectors import bandwidths

    kind = candidates.schema["slide_id"].dataType.simpleString()
    past = history.groupBy("slide_id").agg(F.collect_list(F.array("grid_i", "grid_j")).alias("past")) if history is not None else None
    rows = candidates.select("slide_id", "roi_id", "grid_i", "grid_j", "quality", F.coalesce("group_id", F.lit(-1)).alias("group_id"), "embedding")
    rows = rows.join(past, "slide_id", "left") if past is not None else rows.withColumn("past", F.lit(None).cast("array<array<int>>"))
    rows = rows.withColumn("_sigma", F.lit(None).cast("double"))
    if options.get("method") == "kdpp":
        rows = cut(rows, "candidates")
        many = cut(rows.groupBy("slide_id").agg(F.count("*").alias("_n")).where(F.col("_n") > EIGEN_POINTS).select("slide_id"), "large-slides")
        if not many.isEmpty():
            sigmas = cut(bandwidths(rows.join(small(many), "slide_id")), "bandwidths")
            rows = rows.drop("_sigma").join(small(sigmas.withColumnRenamed("sigma", "_sigma")), "slide_id", "left")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("roi_id").reset_index(drop=True)
        sigma = pdf["_sigma"].iloc[0]
        past = pdf.past.iloc[0]
        past = np.array([list(p) for p in past]) if past is not None and len(past) else np.zeros((0, 2))
        got = diverse(np.stack([np.asarray(e, float) for e in pdf.embedding]), pdf.quality.to_numpy(float), pdf[["grid_i", "grid_j"]].to_numpy(), pdf.group_id.to_numpy(), past, k, size, s2=None if pd.isna(sigma) else sigma * sigma, **options)
        return pd.DataFrame({"slide_id": pdf.slide_id.iloc[got], "roi_id": pdf.roi_id.iloc[got].astype(np.int32), "pick": np.arange(len(got), dtype=np.int32)})

    return rows.groupBy("slide_id").applyInPandas(run, _PICKED.format(kind=kind))


def quality_farthest(candidates: DataFrame, k: int, seed: int = 0) -> DataFrame:
    """(slide_id, roi_id, pick) by quality-weighted farthest points alone."""
    kind = candidates.schema["slide_id"].dataType.simpleString()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("roi_id").reset_index(drop=True)
        got = farthest_points(np.stack([np.asarray(e, float) for e in pdf.embedding]), pdf.quality.to_numpy(float), k, seed)
        return pd.DataFrame({"slide_id": pdf.slide_id.iloc[got], "roi_id": pdf.roi_id.iloc[got].astype(np.int32), "pick": np.arange(len(got), dtype=np.int32)})

    return candidates.select("slide_id", F.col("roi_id").cast("int"), "quality", "embedding").groupBy("slide_id").applyInPandas(run, _PICKED.format(kind=kind))


#: Items of one slide or group that are put into one row.
MOST_LISTED = 20_000


def checked_list(listed: DataFrame, key: str, items: str, most: int = MOST_LISTED) -> DataFrame:
    """listed, with an error for a row of more than `most` items."""
    message = F.concat(F.lit(f"more than {most} items of one group: "), F.col(key).cast("string"))
    return listed.withColumn(items, F.when(F.size(items) <= most, F.col(items)).otherwise(F.raise_error(message).cast(listed.schema[items].dataType)))


def overlap_free(candidates: DataFrame, size: int, most: float, order: Column) -> DataFrame:
    """The candidates that a greedy pass in ascending `order` keeps: each overlaps no kept one by more than `most`.

    A fold over one slide's candidates in built-in functions; a bound of 0 or less keeps all. More than MOST_LISTED
    candidates of one slide are an error: they are those that a slide was asked for, not all its windows.
    """
    if most <= 0:
        return candidates.select("slide_id", "grid_i", "grid_j")
    item = F.struct(order.alias("o"), F.col("grid_i").cast("int").alias("i"), F.col("grid_j").cast("int").alias("j"))
    listed = checked_list(candidates.groupBy("slide_id").agg(F.array_sort(F.collect_list(item)).alias("_c")), "slide_id", "_c")

    def overlap(a: Column, b: Column) -> Column:
        inter = F.greatest(F.lit(0), F.lit(size) - F.abs(a["i"] - b["i"])) * F.greatest(F.lit(0), F.lit(size) - F.abs(a["j"] - b["j"]))
        return inter / (F.lit(2.0 * size * size) - inter)

    kept = F.aggregate("_c", F.slice("_c", 1, 0), lambda k, x: F.when(F.exists(k, lambda y: overlap(x, y) > F.lit(most)), k).otherwise(F.concat(k, F.array(x))))
    return listed.select("slide_id", F.explode(kept).alias("x")).select("slide_id", F.col("x.i").alias("grid_i"), F.col("x.j").alias("grid_j"))


def overlapping_pairs(windows: DataFrame, size: int) -> DataFrame:
    """(slide_id, a_grid_i, a_grid_j, b_grid_i, b_grid_j) of the ordered pairs of one slide's windows that share a cell.

    Each window meets those at every offset under its side by an equi-join: a fan-out of (2 size - 1)², not all pairs.
    """
    steps = F.sequence(F.lit(1 - size), F.lit(size - 1))
    moved = windows.select("slide_id", F.col("grid_i").alias("a_grid_i"), F.col("grid_j").alias("a_grid_j"), F.explode(steps).alias("di")).withColumn("dj", F.explode(steps)).where("di <> 0 or dj <> 0")
    keyed = moved.select("slide_id", "a_grid_i", "a_grid_j", (F.col("a_grid_i") + F.col("di")).alias("b_grid_i"), (F.col("a_grid_j") + F.col("dj")).alias("b_grid_j"))
    other = windows.select("slide_id", F.col("grid_i").alias("b_grid_i"), F.col("grid_j").alias("b_grid_j")).distinct()
    return keyed.join(other, ["slide_id", "b_grid_i", "b_grid_j"]).select("slide_id", "a_grid_i", "a_grid_j", "b_grid_i", "b_grid_j")


def away_from(candidates: DataFrame, history: DataFrame, size: int, most: float | None) -> DataFrame:
    """The candidates that overlap no earlier pick of the slide by more than `most`; no bound keeps all."""
    if most is None or most <= 0:
        return candidates
    past = history.select(F.col("slide_id").alias("_s"), F.col("grid_i").alias("_i"), F.col("grid_j").alias("_j"))
    inter = F.greatest(F.lit(0), size - F.abs(F.col("grid_i") - F.col("_i"))) * F.greatest(F.lit(0), size - F.abs(F.col("grid_j") - F.col("_j")))
    return candidates.join(past, (F.col("slide_id") == F.col("_s")) & (inter / (F.lit(2.0 * size * size) - inter) > most), "left_anti")


def pick_pair(candidates: DataFrame) -> DataFrame:
    """(slide_id, first, second): two roi_ids for each slide that has a selected or passed candidate.

    candidates: slide_id, roi_id, tissue_frac, artifact_frac, passed_qc, pick (null if not selected). Two selected ones in
    the order of selection; one selected and the best other passed; the two best passed; a single one twice.
    """
    q = F.col("tissue_frac") * (1 - F.col("artifact_frac"))
    usable = candidates.where("pick is not null or passed_qc")
    order = Window.partitionBy("slide_id").orderBy(F.col("pick").isNull(), F.col("pick"), q.desc(), F.col("roi_id"))
    first = usable.withColumn("_rn", F.row_number().over(order)).where("_rn <= 2")
    two = first.groupBy("slide_id").agg(F.max(F.when(F.col("_rn") == 1, F.col("roi_id"))).alias("first"), F.max(F.when(F.col("_rn") == 2, F.col("roi_id"))).alias("second"))
    return two.select("slide_id", "first", F.coalesce("second", "first").alias("second"))
