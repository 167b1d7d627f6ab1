"""Candidate windows: weighted order without replacement, gates, thresholds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.scalar import checked_percentile, clip, uniform


def drawn_at(weight: Column, key: Column, seed: int = 0) -> Column:
    """When a row is first drawn, by its key and the seed alone: exponential with its weight as the rate."""
    return -F.log(uniform(key, seed)) / weight


def in_order(drawn: DataFrame) -> DataFrame:
    """drawn with roi_id, the place from 0 of each row of a slide by sort_key, then position."""
    order = Window.partitionBy("slide_id").orderBy("sort_key", "grid_i", "grid_j")
    return drawn.withColumn("roi_id", F.row_number().over(order) - 1)


def candidate_order(placements: DataFrame, weight: Column, key: Column, seed: int = 0) -> DataFrame:
    """placements with sort_key and roi_id, their place in a weighted draw without replacement per slide.

    Drawing a group by its weight, then a position of its box, and refusing what does not fit or was drawn before, takes
    the fitting positions in the order of -ln(u) / w with w the group's weight over its box's positions. So the order is
    one sort per slide instead of a loop of refusals.
    """
    return in_order(placements.withColumn("sort_key", drawn_at(weight, key, seed)))


def hard_rejected(most_artifact: float, factor: float = 2.0) -> Column:
    """Windows not even recorded as candidates where a number of passed ones is asked for."""
    return (F.col("artifact_frac") > factor * most_artifact) if most_artifact > 0 else F.lit(False)


def gate(candidates: DataFrame, least_tissue: Column | float, most_artifact: Column | float) -> DataFrame:
    """candidates with passed_qc and reject_reason; tissue is judged before artifacts."""
    low, high = F.col("tissue_frac") < least_tissue, F.col("artifact_frac") > most_artifact
    return candidates.withColumn("reject_reason", F.when(low, "low_tissue").when(high, "high_artifact")).withColumn("passed_qc", ~(low | high))


def until_passed(candidates: DataFrame, target: int) -> DataFrame:
    """Of each slide the candidates in order up to the one with which `target` have passed."""
    order = Window.partitionBy("slide_id").orderBy("roi_id").rowsBetween(Window.unboundedPreceding, 0)
    passed = F.col("passed_qc").cast("int")
    return candidates.withColumn("_run", F.sum(passed).over(order)).where(F.col("_run") - passed < target).drop("_run")


def attempt_cap(n: int | None, target: int | None) -> int:
    """How many draws are tried at most for n candidates, or until target have passed."""
    return max(200 * target, 1000) if target else max(50 * n, 1000)


def calibration_size(target: int) -> int:
    return max(32, min(2 * target, 512))


def gate_thresholds(candidates: DataFrame, least_tissue: float, most_artifact: float, tissue_percentile: float | None = None, artifact_percentile: float | None = None) -> DataFrame:
    """(slide_id, tissue_thr, artifact_thr): fixed, or percentiles of the slide's own candidates.

    A tissue percentile replaces the fixed bound, an artifact percentile can only lower it; no number of candidates, or
    only NaN, leaves the fixed one. Both are clamped to 0 … 1.
    """
    t, a = checked_percentile(tissue_percentile), checked_percentile(artifact_percentile)
    clean = lambda c: F.when(~F.isnan(c), F.col(c))
    tissue = F.coalesce(F.percentile(clean("tissue_frac"), t / 100), F.lit(least_tissue)) if t is not None else F.max(F.lit(least_tissue))
    artifact = F.least(F.coalesce(F.percentile(clean("artifact_frac"), a / 100), F.lit(most_artifact)), F.lit(most_artifact)) if a is not None else F.max(F.lit(most_artifact))
    return candidates.groupBy("slide_id").agg(clip(tissue, 0.0, 1.0).alias("tissue_thr"), clip(artifact, 0.0, 1.0).alias("artifact_thr"))


def gate_summary(candidates: DataFrame) -> DataFrame:
    return candidates.groupBy("slide_id").agg(
        F.count("*").alias("sampled"), F.count_if("passed_qc").alias("passed"), F.count_if(~F.col("passed_qc")).alias("rejected"),
        F.count_if(F.col("reject_reason") == "low_tissue").alias("low_tissue"), F.count_if(F.col("reject_reason") == "high_artifact").alias("high_artifact"),
    )


def candidates_of(slides_cells: DataFrame, r: int, n: int | None, target: int | None, *, least_tissue: float = 0.7, most_artifact: float = 0.05, tile_tissue: float = 0.3, valid_share: float = 0.5, cover: float = 0.8, member_tissue: float = 0.2, member_artifact: float = 0.25, radius: int = 4, least_group: float = 0.3, tissue_percentile: float | None = None, artifact_percentile: float | None = None, attempts: int | None = None, seed: int = 0) -> DataFrame:
    """Gated candidates of every slide: placements in groups, weighted order, thresholds, the first n or until target passed.

    Percentile thresholds come from the first calibration_size(target) in the order; those are all kept, so more than the
    target may pass. A window that fits two groups is a candidate once, of the group that draws it first. The loop of draws
    ends after attempts (attempt_cap by default): with weights that are chances of one draw, the sort key is the time of a
    window's first draw where one is made in each unit of time, so the cap is a bound on it.
    """
    from gridloom.operators.grid import window_metrics
    from gridloom.operators.groups import component_stats, group_placements, group_weights, tissue_groups

    labelled = tissue_groups(slides_cells, r, member_tissue, member_artifact, radius)
    placed = group_placements(labelled, r, cover, least_group)
    weights = group_weights(placed, component_stats(labelled))
    weights = weights.withColumn("chance", F.col("weight") / F.sum("weight").over(Window.partitionBy("slide_id")))
    metrics = window_metrics(slides_cells, r, tile_tissue).where(F.col("n_valid") >= valid_share * r * r)
    both = placed.join(weights, ["slide_id", "component_id"]).join(metrics, ["slide_id", "grid_i", "grid_j"])
    if target:
        both = both.where(~hard_rejected(most_artifact))
    positions = (F.col("max_i") - F.col("min_i") - r + 1) * (F.col("max_j") - F.col("min_j") - r + 1)
    key = F.concat_ws("/", F.col("slide_id").cast("string"), "component_id", "grid_i", "grid_j")
    drawn = both.withColumn("sort_key", drawn_at(F.col("chance") / positions, key, seed))
    drawn = drawn.where(F.col("sort_key") <= (attempts if attempts is not None else attempt_cap(n, target)))
    first = Window.partitionBy("slide_id", "grid_i", "grid_j").orderBy("sort_key", "component_id")
    ordered = in_order(drawn.withColumn("_rn", F.row_number().over(first)).where("_rn = 1").drop("_rn")).withColumnRenamed("component_id", "group_id")
    if target is None:
        ordered = ordered.where(F.col("roi_id") < n)
    measured = ordered.where(F.col("roi_id") < calibration_size(target)) if target else ordered
    bounds = gate_thresholds(measured, least_tissue, most_artifact, tissue_percentile, artifact_percentile)
    gated = gate(ordered.join(bounds, "slide_id"), F.col("tissue_thr"), F.col("artifact_thr"))
    if target:
        kept = until_passed(gated, target)
        if checked_percentile(tissue_percentile) is not None or checked_percentile(artifact_percentile) is not None:
            first = gated.where(F.col("roi_id") < calibration_size(target))
            kept = kept.unionByName(first.join(kept.select("slide_id", "roi_id"), ["slide_id", "roi_id"], "left_anti"))
        gated = kept
    return gated.select("slide_id", "roi_id", "grid_i", "grid_j", "tissue_frac", "artifact_frac", "group_id", "passed_qc", "reject_reason")
