"""Crops and masks of windows, batches, labels."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.scalar import posterised, to_half, uniform
from gridloom.operators.curate import hash_positions

# Label classes of the artifact map, their names and colours (red, green, blue).
CLASSES = [
    (1, "Clean tissue", 128, 128, 128),
    (2, "Tissue fold", 255, 99, 71),
    (3, "Dark spot / foreign object", 0, 255, 0),
    (4, "Pen marking", 255, 0, 0),
    (5, "Edge / air bubble", 255, 0, 255),
    (6, "Out of focus", 75, 0, 130),
    (7, "Background", 255, 255, 255),
]
BACKGROUND, FIRST_ARTIFACT, LAST_ARTIFACT = 7, 2, 6


def class_table(spark) -> DataFrame:
    rows = [(c, n, r, g, b, FIRST_ARTIFACT <= c <= LAST_ARTIFACT) for c, n, r, g, b in CLASSES]
    return spark.createDataFrame(rows, "class_id int, name string, r int, g int, b int, is_artifact boolean")


def coloured(labels: DataFrame, artifacts_only: bool = False) -> DataFrame:
    """labels (…, class_id) with name, r, g, b, is_artifact; unknown classes stay black, so do clean ones if only artifacts count."""
    named = labels.join(F.broadcast(class_table(labels.sparkSession)), "class_id", "left")
    shown = F.coalesce(F.col("is_artifact") if artifacts_only else F.col("name").isNotNull(), F.lit(False))
    return named.select(*labels.columns, "name", *(F.when(shown, F.col(c)).otherwise(F.lit(0)).alias(c) for c in "rgb"), F.coalesce("is_artifact", F.lit(False)).alias("is_artifact"))


def aligned_labels(labels: DataFrame, block: list[str], label: str, tissue: Column) -> DataFrame:
    """Labels 1 … 7: a block whose labels run from 0 to 6 is shifted by one; without tissue, or 0, is background."""
    w = Window.partitionBy(*block)
    shift = (F.min(label).over(w) == 0) & (F.max(label).over(w) == 6)
    moved = F.col(label) + F.when(shift, 1).otherwise(0)
    return labels.withColumn(label, F.when(~tissue | (moved == 0), BACKGROUND).otherwise(moved).cast("int"))


def blocks_with_tissue(pixels: DataFrame, block: list[str], tissue: str, least: int = 50) -> DataFrame:
    """The blocks worth segmenting: more than `least` tissue pixels."""
    return pixels.groupBy(*block).agg(F.count_if(tissue).alias("n_tissue")).where(F.col("n_tissue") > least)


def stitched(blocks: DataFrame, box: tuple[int, int, int, int]) -> DataFrame:
    """Pixels of label blocks (slide_id, y0, x0, y, x, class_id: y, x within the block) in a region's own coordinates, clipped to it."""
    top, left, bottom, right = box
    at = blocks.select("slide_id", (F.col("y0") + F.col("y")).alias("y"), (F.col("x0") + F.col("x")).alias("x"), "class_id")
    return at.where(F.col("y").between(top, bottom - 1) & F.col("x").between(left, right - 1)).select("slide_id", (F.col("y") - top).alias("y"), (F.col("x") - left).alias("x"), "class_id")


def crop_positions(rois: DataFrame, key: str, rows: int, cols: int, crop: int, n: int, kind: str, seed: int | str = 0, corners: bool = False) -> DataFrame:
    """(key, view_type, view, r0, c0): n crops of each window, by a hash of the key.

    Two crops that span the slack are put in opposite corners, on either diagonal, where `corners` asks for it.
    """
    most_r, most_c = max(0, rows - crop), max(0, cols - crop)
    views = rois.select(key, F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("view"))
    name = F.concat_ws("/", F.col(key).cast("string"), F.lit(kind), "view")
    at = lambda axis, most: F.least(F.floor(uniform(F.concat_ws("/", name, F.lit(axis)), seed) * (most + 1)), F.lit(most)).cast("int")
    if corners and n == 2 and crop >= most_r and crop >= most_c:
        main = uniform(F.concat_ws("/", F.col(key).cast("string"), F.lit(kind), F.lit("diagonal")), seed) < 0.5
        r0 = F.when(F.col("view") == 0, 0).otherwise(most_r)
        c0 = F.when((F.col("view") == 0) == main, 0).otherwise(most_c)
    else:
        r0, c0 = at("r", most_r), at("c", most_c)
    return views.select(key, F.lit(kind).alias("view_type"), "view", r0.cast("int").alias("r0"), c0.cast("int").alias("c0"))


def crop_cells(crops: DataFrame, key: str, crop: int) -> DataFrame:
    """One row per cell of each crop: i, j within the crop, and grid_i, grid_j within the window."""
    steps = F.sequence(F.lit(0), F.lit(crop - 1))
    cells = crops.withColumn("i", F.explode(steps)).withColumn("j", F.explode(steps))
    return cells.withColumn("grid_i", F.col("r0") + F.col("i")).withColumn("grid_j", F.col("c0") + F.col("j"))


def masked_cells(cells: DataFrame, key: Column, ratio: float, valid: str = "valid", seed: int | str = 0) -> DataFrame:
    """cells with masked: a draw by the cell's key under the ratio, for valid cells; none if the ratio is 0 or less."""
    draw = (uniform(key, seed) < ratio) if ratio > 0 else F.lit(False)
    return cells.withColumn("masked", draw & F.col(valid))


def augmented(cells: DataFrame, crop: int, view_key: Column, features: str = "features", valid: str = "valid", flip: float = 0.5, step: float = 0.05, posterise: float = 0.5, noise: float = 0.005, seed: int | str = 0) -> DataFrame:
    """Crop cells flipped, each way by a draw for the whole view, and by a third draw posterised and with noise; invalid cells are zeros.

    A step or a noise of 0 or less leaves that part out. Noise is Gaussian by Box-Muller from two hash draws for each number.
    """
    draw = lambda what: uniform(F.concat_ws("/", view_key, F.lit(what)), seed)
    i = F.when(draw("flip-i") < flip, crop - 1 - F.col("i")).otherwise(F.col("i"))
    j = F.when(draw("flip-j") < flip, crop - 1 - F.col("j")).otherwise(F.col("j"))
    v = changed = F.col(features).cast("array<double>")
    if step > 0:
        changed = posterised(changed, step)
    if noise > 0:
        cell = F.concat_ws("/", view_key, i.cast("string"), j.cast("string"))
        u = lambda k, part: uniform(F.concat_ws("/", cell, k.cast("string"), F.lit(part)), seed)
        normal = lambda k: F.sqrt(-2 * F.log(u(k, "u"))) * F.cos(F.lit(2 * math.pi) * u(k, "v"))
        changed = F.transform(changed, lambda x, k: x + F.lit(noise) * normal(k))
    v = F.when(draw("posterise") < posterise, changed).otherwise(v)
    return cells.withColumn("_f", F.when(F.col(valid), v).otherwise(F.transform(v, lambda x: F.lit(0.0)))).withColumn("i", i).withColumn("j", j).drop(features).withColumnRenamed("_f", features)


def batches(rows: DataFrame, key: str, size: int, epoch: int, seed: int = 0) -> DataFrame:
    """rows with position and batch, in the epoch's hash order."""
    placed, _ = hash_positions(rows, key, f"{seed}:{epoch}")
    return placed.withColumn("position", F.col("position").cast("long")).withColumn("batch", F.floor(F.col("position") / size))


def student_targets(students: DataFrame, teachers: DataFrame, keys: list[str]) -> DataFrame:
    """Student cells with their teacher's target; a student without one is skipped."""
    return students.join(teachers, keys, "inner")


def paired_windows(pairs: DataFrame, features: DataFrame, tiles: DataFrame, r: int, tile_tissue: float) -> DataFrame:
    """Cells of both windows of each pair (slide_id, a_i, a_j, b_i, b_j): side a or b, i, j in the window, features, valid.

    Cells that the grid lacks are left out; invalid ones have zeros.
    """
    sides = pairs.select("slide_id", F.explode(F.array(F.struct(F.lit("a").alias("side"), F.col("a_i").alias("i0"), F.col("a_j").alias("j0")), F.struct(F.lit("b").alias("side"), F.col("b_i").alias("i0"), F.col("b_j").alias("j0")))).alias("x")).select("slide_id", "x.*")
    steps = F.sequence(F.lit(0), F.lit(r - 1))
    cells = sides.withColumn("i", F.explode(steps)).withColumn("j", F.explode(steps)).withColumn("grid_i", F.col("i0") + F.col("i")).withColumn("grid_j", F.col("j0") + F.col("j"))
    known = tiles.select("slide_id", "grid_i", "grid_j", F.coalesce(to_half(F.col("tissue_frac")) >= tile_tissue, F.lit(False)).alias("valid"))
    both = cells.join(known, ["slide_id", "grid_i", "grid_j"]).join(features, ["slide_id", "grid_i", "grid_j"])
    return both.select("slide_id", "side", "i", "j", F.when(F.col("valid"), F.col("features")).otherwise(F.transform("features", lambda x: x * 0)).alias("features"), "valid")


def masked_divergence(rows: DataFrame, teacher: str, student: str, masked: str, group: list[str], teacher_heat: float = 0.04, student_heat: float = 0.1) -> DataFrame:
    """(group, loss, n): mean over masked cells of the cross-entropy of softmaxed teacher and student vectors; no gradients."""

    def soft(v: Column, heat: float) -> Column:
        top = F.array_max(v)
        e = F.transform(v, lambda x: F.exp((x - top) / heat))
        return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, y: a + y))

    t, s = (F.col(c).cast("array<double>") for c in (teacher, student))
    top = F.array_max(s)
    log_sum = F.log(F.aggregate(s, F.lit(0.0), lambda a, y: a + F.exp((y - top) / student_heat)))
    loss = -F.aggregate(F.zip_with(soft(t, teacher_heat), s, lambda p, y: p * ((y - top) / student_heat - log_sum)), F.lit(0.0), lambda a, x: a + x)
    kept = rows.where(F.col(masked)).withColumn("_l", loss)
    return kept.groupBy(*group).agg(F.avg("_l").alias("loss"), F.count("*").alias("n"))


def legend(spark, artifacts_only: bool = False) -> DataFrame:
    """The legend as a table, in class order."""
    out = class_table(spark)
    return (out.where("is_artifact") if artifacts_only else out).orderBy("class_id")
