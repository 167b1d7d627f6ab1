"""From an index of instances to a balanced, leak-free manifest of slides."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.scalar import bucket_of, finite, hash_order, no_nan
from gridloom.storage import cut, small


def slide_table(instances: DataFrame, series: DataFrame, key: str, kinds: str, spacing: str, cols: str, size: str, target: float, band: tuple[float, float], kind: str = "VOLUME") -> DataFrame:
    """One row per series that has instances of `kind`: its largest instance and the one nearest the target spacing.

    Columns of series, base_* and x20_* for every other column of instances, has_x20_level. Both choices and the flag come
    from one aggregate, which is combined before the shuffle, instead of two sorted windows. Ties go to the greatest
    values of the remaining columns, so the choice never depends on row order. Null sizes and spacings lose.
    """
    rest = [c for c in instances.columns if c not in (key, kinds)]
    off = F.abs(no_nan(F.col(spacing).cast("double")) - F.lit(target))
    volumes = instances.where(F.array_contains(kinds, kind))
    largest = F.struct(F.col(cols).alias("a"), F.col(size).alias("b"), *(F.col(c).alias(f"t_{c}") for c in rest))
    nearest = F.struct((-off).alias("a"), F.col(cols).alias("b"), *(F.col(c).alias(f"t_{c}") for c in rest))
    picked = volumes.groupBy(key).agg(
        F.max(largest).alias("base"),
        F.max(nearest).alias("near"),
        F.coalesce(F.max(F.when(F.col(spacing).between(*band), 1).otherwise(0)), F.lit(0)).alias("has_x20_level"),
    )
    out = picked.select(key, *(F.col(f"base.t_{c}").alias(f"base_{c}") for c in rest), *(F.col(f"near.t_{c}").alias(f"x20_{c}") for c in rest), "has_x20_level")
    return series.join(out, key, "inner")


@dataclass(frozen=True)
class QualityLimits:
    """Bounds of the quality filters; None leaves one out. A null or NaN value fails every bound that is set."""

    least_cols: float | None = None
    least_rows: float | None = None
    size_mb: tuple[float | None, float | None] = (None, None)
    power: tuple[float | None, float | None] = (None, None)
    spacing: tuple[float, float] | None = None  # centre, tolerance
    most_spacing: float | None = None
    require_x20: bool = False
    syntaxes: tuple[str, ...] | None = None


def quality_filters(slides: DataFrame, limits: QualityLimits, names: dict[str, str], required: tuple[str, ...] = ()) -> DataFrame:
    """The rows within all limits. names: which column is cols, rows, size_mb, power, spacing, base_spacing, has_x20, syntax."""
    col = lambda n: no_nan(F.col(names[n]).cast("double"))
    tests: list[Column] = [F.col(c).isNotNull() for c in required]
    if limits.least_cols is not None:
        tests.append(col("cols") >= limits.least_cols)
    if limits.least_rows is not None:
        tests.append(col("rows") >= limits.least_rows)
    for name, (lo, hi) in (("size_mb", limits.size_mb), ("power", limits.power)):
        if lo is not None:
            tests.append(col(name) >= lo)
        if hi is not None:
            tests.append(col(name) <= hi)
    if limits.spacing is not None:
        centre, tolerance = limits.spacing
        tests.append(col("spacing").between(centre - tolerance, centre + tolerance))
    if limits.most_spacing is not None:
        tests.append(col("base_spacing") <= limits.most_spacing)
    if limits.require_x20:
        tests.append(F.col(names["has_x20"]) == 1)
    if limits.syntaxes is not None:
        tests.append(F.col(names["syntax"]).isin(*limits.syntaxes))
    for t in tests:
        slides = slides.where(t)
    return slides


def density(slides: DataFrame, size_mb: str, cols: Column, rows: Column, has_x20: Column | None = None, x20: tuple[Column, Column] | None = None, scale: float = 1e6) -> DataFrame:
    """slides with area_mpix and mb_per_mpix (null where the area is 0), at the x20 level where there is one and it is asked for."""
    if x20 is not None:
        cols, rows = (F.when(has_x20 == 1, a).otherwise(b) for a, b in zip(x20, (cols, rows)))
    area = cols.cast("double") * rows.cast("double") / F.lit(scale)
    return slides.withColumn("area_mpix", area).withColumn("mb_per_mpix", finite(F.try_divide(F.col(size_mb).cast("double"), F.col("area_mpix"))))


#: Different values that one task ranks, about, and the most buckets that values are dealt into.
BUCKET_ROWS, MOST_BUCKETS = 500_000, 2048


def percent_rank(df: DataFrame, value: str, group: str | None = None, out: str = "pct") -> DataFrame:
    """Average-tie percent rank of a value over all rows or within groups; rows without a value or a group are dropped.

    Equal values are counted before they are shuffled, and different ones are dealt by value into buckets at approximate
    quantiles, in each of which a task sums the counts; bucket totals give the starts. So neither a hot value nor a hot
    group is sorted in one task, and the driver sees the bounds of the buckets alone.
    """
    clean = df.withColumn("_v", no_nan(F.col(value).cast("double"))).where("_v is not null")
    clean = clean.withColumn("_g", F.col(group).cast("string") if group else F.lit("")).where("_g is not null")
    counts = cut(clean.groupBy("_g", "_v").agg(F.count("*").alias("_n")), "value-counts")
    buckets = min(MOST_BUCKETS, counts.count() // BUCKET_ROWS + 1)
    bounds = sorted(set(counts.approxQuantile("_v", [k / buckets for k in range(1, buckets)], 0.25 / buckets))) if buckets > 1 else []
    dealt = counts.withColumn("_b", bucket_of(F.col("_v"), bounds))
    before = lambda w: F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_n")
    totals = dealt.groupBy("_g", "_b").agg(F.sum("_n").alias("_n"))
    starts = totals.select("_g", "_b", before(Window.partitionBy("_g").orderBy("_b")).alias("_start"), F.sum("_n").over(Window.partitionBy("_g")).alias("_all"))
    inside = dealt.select("_g", "_b", "_v", "_n", before(Window.partitionBy("_g", "_b").orderBy("_v")).alias("_below"))
    rank = F.col("_start") + F.col("_below") + (F.col("_n") + 1) / F.lit(2.0)
    ranks = cut(inside.join(starts, ["_g", "_b"]).select("_g", "_v", (rank / F.col("_all")).alias(out)), "percent-ranks")
    return clean.join(small(ranks), ["_g", "_v"]).select(*df.columns, out)


def density_filter(df: DataFrame, mode: str, keep: float = 1.0, group: str | None = None, value: str = "mb_per_mpix", least: float | None = None) -> DataFrame:
    """The densest rows: those at or above the floor `least` (threshold), or of them the top share of all or of each group.

    Mode none leaves df as it is, rows without a density included; the others drop those, and group_topq rows without a
    group.
    """
    if mode == "none":
        return df
    if mode not in ("threshold", "global_topq", "group_topq"):
        raise ValueError(f"unknown density mode: {mode}")
    df = df.where(no_nan(F.col(value)).isNotNull() & F.col("area_mpix").isNotNull())
    if least is not None:
        df = df.where(F.col(value) >= least)
    if mode == "threshold":
        return df
    cut_at = F.lit(1.0 - min(max(keep, 0.0), 1.0))
    return percent_rank(df, value, group if mode == "group_topq" else None).where(F.col("pct") >= cut_at)


def sample_per_group(df: DataFrame, group: str, key: str, n: int, seed: int = 0) -> DataFrame:
    """n rows of each group in the order of a hash of their key."""
    order = Window.partitionBy(group).orderBy(hash_order(key, seed), key)
    return df.withColumn("_rn", F.row_number().over(order)).where(F.col("_rn") <= n).drop("_rn")


def balanced_unique(df: DataFrame, group: str, patient: str, key: str, n: int, seed: int = 0) -> DataFrame:
    """Up to n rows of each group, one per patient over all groups; groups choose in sorted order.

    A patient that a group could have taken but did not stays free for the next, so the groups must run in turn. Each turn
    is written before the next reads it.
    """
    spark = df.sparkSession
    rows = df.where(F.col(group).isNotNull() & F.col(patient).isNotNull())
    groups = sorted(r[0] for r in rows.select(group).distinct().collect())
    out = None
    for g in groups:
        free = rows.where(F.col(group) == F.lit(g))
        if out is not None:
            taken = out.select(patient).distinct()
            free = free.join(small(taken), patient, "left_anti")
        order = [hash_order(key, seed), F.col(key)]
        first = free.withColumn("_rn", F.row_number().over(Window.partitionBy(patient).orderBy(*order))).where("_rn = 1").drop("_rn")
        picked = cut(first.orderBy(*order).limit(n), "picked").select(*df.columns)
        out = picked if out is None else out.unionByName(picked)
    return out if out is not None else spark.createDataFrame([], df.schema)


def hash_positions(rows: DataFrame, key: str, seed: int | str) -> tuple[DataFrame, int]:
    """rows with `position`, their place from 0 in the order of a hash of their key (then the key), and how many there are.

    Hashes are dealt by their first digits into buckets of about BUCKET_ROWS; counts of the buckets, at most 65,536, give
    where each begins, so no task sorts all rows.
    """
    total = rows.count()
    digits = next(d for d in range(5) if d == 4 or total <= BUCKET_ROWS * 16**d)
    keyed = rows.withColumn("_h", hash_order(key, seed)).withColumn("_b", F.substring("_h", 1, digits))
    counts = keyed.groupBy("_b").agg(F.count("*").alias("_n"))
    starts = counts.select("_b", (F.sum("_n").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")).alias("_start"))
    inside = F.row_number().over(Window.partitionBy("_b").orderBy("_h", key)) - 1
    return keyed.withColumn("_i", inside).join(F.broadcast(starts), "_b").withColumn("position", F.col("_start") + F.col("_i")).drop("_h", "_b", "_start", "_i"), total


def split_groups(df: DataFrame, group: str, test: float, val: float, seed: int = 0) -> DataFrame:
    """df with `split`: whole groups go to test (that share of groups, rounded up), of the rest to val, the others to train.

    The order of groups is a hash with the seed for test and the next seed for val.
    """
    names = df.where(F.col(group).isNotNull()).select(group).distinct()

    def first(share: float, of: DataFrame, s: int) -> DataFrame:
        placed, total = hash_positions(of.select(group), group, s)
        return placed.where(F.col("position") < F.ceil(F.lit(float(share)) * F.lit(total))).select(group)

    tests = cut(first(test, names, seed), "test-groups") if test > 0 else names.limit(0)
    rest = names.join(tests, group, "left_anti")
    vals = cut(first(val, rest, seed + 1), "val-groups") if val > 0 else names.limit(0)
    marked = tests.withColumn("split", F.lit("test")).unionByName(vals.withColumn("split", F.lit("val")))
    return df.join(marked, group, "left").withColumn("split", F.coalesce("split", F.lit("train")))


def leaks(df: DataFrame, group: str, split: str = "split") -> DataFrame:
    """Groups that stand in more than one split; none if the split is sound."""
    return df.where(F.col(group).isNotNull()).groupBy(group).agg(F.count_distinct(split).alias("n_splits")).where("n_splits > 1")


def value_counts(df: DataFrame, column: str, n: int) -> DataFrame:
    """The n most frequent values; ties by value."""
    return df.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.asc_nulls_last(column)).limit(n)


def totals(df: DataFrame, size_mb: str) -> DataFrame:
    return df.agg(F.count("*").alias("n_rows"), (F.sum(size_mb) / 1024).alias("total_gb"))
