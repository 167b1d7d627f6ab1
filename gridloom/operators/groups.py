"""Connected groups of tiles, and the windows that fit in them."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.functions.scalar import to_half
from gridloom.operators.grid import box_sums, dilated


def label_components(mask: np.ndarray) -> np.ndarray:
    """8-connected components of a 2-D mask: each true cell gets the least row-major index of its component, others -1."""
    h, w = mask.shape
    label = np.where(mask, np.arange(h * w).reshape(h, w), h * w)
    while True:
        p = np.pad(label, 1, constant_values=h * w)
        new = np.minimum.reduce([p[1 + dy : 1 + dy + h, 1 + dx : 1 + dx + w] for dy in (-1, 0, 1) for dx in (-1, 0, 1)])
        new = np.where(mask, new, h * w)
        # jump to the label of the cell that the label names
        flat = np.append(new.ravel(), h * w)
        new = flat[new]
        if np.array_equal(new, label):
            return np.where(mask, label, -1)
        label = new


def components(cells: DataFrame, width: str = "n_cols") -> DataFrame:
    """cells (slide_id, grid_i, grid_j, n_cols) with component_id: the least grid_i * n_cols + grid_j of the 8-connected group.

    One slide's grid is one task's array; grids are thousands of cells, slides are many.
    """
    schema = f"slide_id {cells.schema['slide_id'].dataType.simpleString()}, grid_i int, grid_j int, component_id long"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        i, j, n = pdf.grid_i.to_numpy(), pdf.grid_j.to_numpy(), int(pdf[width].iloc[0])
        mask = np.zeros((i.max() + 1, max(n, j.max() + 1)), bool)
        mask[i, j] = True
        at = label_components(mask)[i, j]
        return pd.DataFrame({"slide_id": pdf.slide_id, "grid_i": i.astype(np.int32), "grid_j": j.astype(np.int32), "component_id": (at // mask.shape[1]).astype(np.int64) * n + at % mask.shape[1]})

    return cells.select("slide_id", F.col("grid_i").cast("int"), F.col("grid_j").cast("int"), width).groupBy("slide_id").applyInPandas(run, schema)


def component_stats(labelled: DataFrame, least_area: int = 0) -> DataFrame:
    return labelled.groupBy("slide_id", "component_id").agg(
        F.count("*").alias("area"), F.min("grid_i").alias("min_i"), (F.max("grid_i") + 1).alias("max_i"), F.min("grid_j").alias("min_j"), (F.max("grid_j") + 1).alias("max_j")
    ).where(F.col("area") >= least_area)


def member_cells(cells: DataFrame, tissue: float, artifact: float) -> DataFrame:
    """The tiles that can belong to a group: enough tissue, and where there is an artifact value not too much of it."""
    t, a = to_half(F.col("tissue_frac")), to_half(F.col("artifact_frac"))
    return cells.where((t >= min(max(tissue, 0.0), 1.0)) & (F.col("artifact_frac").isNull() | (a <= artifact)))


def tissue_groups(cells: DataFrame, r: int, tissue: float = 0.2, artifact: float = 0.25, radius: int = 4) -> DataFrame:
    """Labelled cells of the groups of each slide: members, dilated by an ellipse, 8-connected."""
    dims = cells.groupBy("slide_id").agg((F.max("grid_i") + 1).alias("n_rows"), (F.max("grid_j") + 1).alias("n_cols"))
    merged = dilated(member_cells(cells, tissue, artifact), radius, dims)
    return components(merged.join(dims.select("slide_id", "n_cols"), "slide_id"))


def group_placements(labelled: DataFrame, r: int, cover: float = 0.8, least_size: float = 0.3) -> DataFrame:
    """(slide_id, component_id, grid_i, grid_j): the r x r windows in a group's box whose share of that group's cells is enough.

    Groups smaller than least_size of a window, or than a window in one direction, have none. Sums run over one group's
    cells at a time, along its own box, so a cell of another group never counts.
    """
    stats = component_stats(labelled).where((F.col("area") >= r * r * least_size) & (F.col("max_i") - F.col("min_i") >= r) & (F.col("max_j") - F.col("min_j") >= r))
    box = stats.select("slide_id", "component_id", "min_i", "max_i", "min_j", "max_j")
    dense = box.withColumn("grid_i", F.explode(F.sequence("min_i", F.col("max_i") - 1))).withColumn("grid_j", F.explode(F.sequence("min_j", F.col("max_j") - 1)))
    marked = dense.join(labelled.withColumn("in", F.lit(1)), ["slide_id", "component_id", "grid_i", "grid_j"], "left")
    keyed = marked.withColumn("g", F.struct("slide_id", "component_id"))
    sums = box_sums(keyed.select("g", "grid_i", "grid_j", F.coalesce("in", F.lit(0)).alias("in")), {"n": F.col("in")}, r, slide="g")
    return sums.where(F.col("n") >= r * r * cover).select("g.slide_id", "g.component_id", "grid_i", "grid_j")


def group_weights(placed: DataFrame, stats: DataFrame) -> DataFrame:
    """(slide_id, component_id, n_placements, weight, n_positions): weight is the square root of the placements."""
    n = placed.groupBy("slide_id", "component_id").agg(F.count("*").alias("n_placements"))
    return n.join(stats, ["slide_id", "component_id"]).select("slide_id", "component_id", "n_placements", F.sqrt("n_placements").alias("weight"), "area", "min_i", "max_i", "min_j", "max_j")
