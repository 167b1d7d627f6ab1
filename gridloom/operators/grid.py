"""Tile grids: extents, masks, fractions, sums over square windows, morphology."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.scalar import to_half


def bounding_box(mask: DataFrame, slide: str = "slide_id", y: str = "y", x: str = "x") -> DataFrame:
    """(slide, min_y, max_y, min_x, max_x) of true cells, half open; slides without one have no row."""
    return mask.groupBy(slide).agg(F.min(y).alias("min_y"), (F.max(y) + 1).alias("max_y"), F.min(x).alias("min_x"), (F.max(x) + 1).alias("max_x"))


def tile_extent(slides: DataFrame) -> DataFrame:
    """Grid of each slide: adds x0, y0 (aligned start), n_cols, n_rows.

    Needs width, height, tile (base pixels), the tissue box min_x … max_y in mask pixels, and scale_x, scale_y (mask pixels
    a base pixel). The box is widened by a tile, clipped, and only its start aligned to the tile. Slides without tissue
    (null box) have no grid.
    """
    out = slides.where("min_x is not null")
    for axis, n in (("x", "width"), ("y", "height")):
        count = {"x": "n_cols", "y": "n_rows"}[axis]
        start = F.greatest(F.lit(0), F.floor(F.col(f"min_{axis}") / F.col(f"scale_{axis}")) - F.col("tile"))
        end = F.least(F.col(n), F.floor(F.col(f"max_{axis}") / F.col(f"scale_{axis}")) + F.col("tile"))
        out = out.withColumn(f"{axis}0", (F.floor(start / F.col("tile")) * F.col("tile")).cast("long"))
        out = out.withColumn(count, F.greatest(F.lit(1), F.ceil((end - F.col(f"{axis}0")) / F.col("tile"))).cast("int"))
    return out


def tiles_of(extents: DataFrame) -> DataFrame:
    """One row per tile of each grid: grid_i, grid_j, tile_id (row-major) and its box in base pixels, clipped to the slide."""
    rows = extents.withColumn("grid_i", F.explode(F.sequence(F.lit(0), F.col("n_rows") - 1)))
    cells = rows.withColumn("grid_j", F.explode(F.sequence(F.lit(0), F.col("n_cols") - 1)))
    left, top = F.col("x0") + F.col("grid_j") * F.col("tile"), F.col("y0") + F.col("grid_i") * F.col("tile")
    return cells.select(
        "slide_id", (F.col("grid_i").cast("long") * F.col("n_cols") + F.col("grid_j")).alias("tile_id"), "grid_i", "grid_j",
        left.alias("x0_lvl0"), top.alias("y0_lvl0"), F.least(left + F.col("tile"), F.col("width").cast("long")).alias("x1_lvl0"), F.least(top + F.col("tile"), F.col("height").cast("long")).alias("y1_lvl0"),
        "scale_x", "scale_y",
    )


def summed_table(cells: DataFrame, value: str, slide: str = "slide_id", i: str = "grid_i", j: str = "grid_j", out: str = "prefix") -> DataFrame:
    """cells with the sum of `value` over all cells at or above-left of each: two running sums, by row, then by column."""
    by_row = Window.partitionBy(slide, i).orderBy(j).rowsBetween(Window.unboundedPreceding, 0)
    by_col = Window.partitionBy(slide, j).orderBy(i).rowsBetween(Window.unboundedPreceding, 0)
    return cells.withColumn(out, F.sum(value).over(by_row)).withColumn(out, F.sum(out).over(by_col))


def mask_fractions(tiles: DataFrame, mask: DataFrame, flag: str) -> DataFrame:
    """tiles with `fraction`: the mean of a mask (slide_id, y, x, flag) over each tile's pixels; 0 if there are none.

    A tile's pixels run from the floor of its start to the ceiling of its end, so edge pixels may count in two tiles.
    Four lookups in a summed table: the cost of a tile does not follow its size. The mask is dense.
    """
    sums = summed_table(mask.withColumn("_f", F.col(flag).cast("long")), "_f", "slide_id", "y", "x", "s").select("slide_id", "y", "x", "s")
    size = mask.groupBy("slide_id").agg((F.max("y") + 1).alias("_h"), (F.max("x") + 1).alias("_w"))
    lo = lambda a, s: F.greatest(F.lit(0), F.floor(F.col(a) * F.col(s))).cast("int")
    hi = lambda a, s, n: F.least(F.col(n), F.ceil(F.col(a) * F.col(s))).cast("int")
    boxes = tiles.join(size, "slide_id").select(tiles["*"], lo("y0_lvl0", "scale_y").alias("_y0"), hi("y1_lvl0", "scale_y", "_h").alias("_y1"), lo("x0_lvl0", "scale_x").alias("_x0"), hi("x1_lvl0", "scale_x", "_w").alias("_x1"))
    corners = F.array(*[F.struct((F.col(y) - 1).alias("y"), (F.col(x) - 1).alias("x"), F.lit(s).alias("sign")) for y, x, s in (("_y1", "_x1", 1), ("_y0", "_x1", -1), ("_y1", "_x0", -1), ("_y0", "_x0", 1))])
    asked = boxes.select("slide_id", "tile_id", ((F.col("_y1") - F.col("_y0")) * (F.col("_x1") - F.col("_x0"))).alias("n"), F.explode(corners).alias("c")).select("slide_id", "tile_id", "n", "c.*")
    total = asked.join(sums, ["slide_id", "y", "x"], "left").groupBy("slide_id", "tile_id").agg(F.first("n").alias("n"), F.sum(F.coalesce("s", F.lit(0)) * F.col("sign")).alias("t"))
    share = F.when(F.col("n") > 0, F.col("t") / F.col("n")).otherwise(F.lit(0.0))
    return tiles.join(total.select("slide_id", "tile_id", share.alias("fraction")), ["slide_id", "tile_id"])


def judged_tiles(tiles: DataFrame, least_tissue: float) -> DataFrame:
    """tiles with rejected and reject_reason: only too little tissue rejects a tile here; artifacts are judged when sampling."""
    low = ~F.coalesce(F.col("tissue_frac") >= least_tissue, F.lit(False))
    return tiles.withColumn("rejected", low).withColumn("reject_reason", F.when(low, F.lit("low_tissue")))


def grid_summary(tiles: DataFrame) -> DataFrame:
    return tiles.groupBy("slide_id").agg(F.count("*").alias("total_grid_tiles"), F.count_if(~F.col("rejected")).alias("accepted_count"), F.count_if("rejected").alias("rejected_count"), F.count_if(F.col("reject_reason") == "low_tissue").alias("rejected_low_tissue"))


def box_sums(cells: DataFrame, values: dict[str, Column], r: int, slide: str = "slide_id", i: str = "grid_i", j: str = "grid_j") -> DataFrame:
    """Sums over the r x r window that starts at each cell, for windows that lie fully in the slide's grid.

    values: name of the sum -> expression of a cell. Two value-range windows, along rows and then columns, cost 2r cells for
    each window instead of r². Missing cells count as 0 and start no window. A grid smaller than r has no window.
    """
    dims = Window.partitionBy(slide)
    along = Window.partitionBy(slide, i).orderBy(j).rangeBetween(0, r - 1)
    down = Window.partitionBy(slide, j).orderBy(i).rangeBetween(0, r - 1)
    first = cells.select(slide, i, j, *(F.sum(e).over(along).alias(n) for n, e in values.items()), F.max(i).over(dims).alias("_mi"), F.max(j).over(dims).alias("_mj"))
    both = first.select(slide, i, j, *(F.sum(n).over(down).alias(n) for n in values), "_mi", "_mj")
    return both.where((F.col(i) <= F.col("_mi") + 1 - r) & (F.col(j) <= F.col("_mj") + 1 - r)).drop("_mi", "_mj")


def window_metrics(cells: DataFrame, r: int, tile_tissue: float) -> DataFrame:
    """Mean tissue and artifact of every window, and its number of valid tiles. Fractions are as stored, in half precision."""
    tissue, artifact = to_half(F.col("tissue_frac")), to_half(F.coalesce("artifact_frac", F.lit(0.0)))
    sums = box_sums(cells, {"t": tissue, "a": artifact, "n_valid": F.when(tissue >= tile_tissue, 1).otherwise(0)}, r)
    return sums.select("slide_id", "grid_i", "grid_j", (F.col("t") / (r * r)).alias("tissue_frac"), (F.col("a") / (r * r)).alias("artifact_frac"), "n_valid")


def viable(cells: DataFrame, r: int, tile_tissue: float, share: float) -> DataFrame:
    """(slide_id, viable): whether any r x r window has enough valid tiles; a grid smaller than r has none."""
    need = math.ceil(share * r * r)
    valid = F.when(to_half(F.col("tissue_frac")) >= tile_tissue, 1).otherwise(0)
    slides = cells.select("slide_id").distinct()
    if need <= 0:
        found = cells.groupBy("slide_id").agg((F.max(valid) > 0).alias("viable"))
    else:
        found = box_sums(cells, {"n": valid}, r).groupBy("slide_id").agg((F.max("n") >= need).alias("viable"))
    return slides.join(found, "slide_id", "left").select("slide_id", F.coalesce("viable", F.lit(False)).alias("viable"))


def ellipse(radius: int) -> list[tuple[int, int]]:
    """Offsets (dy, dx) of the filled ellipse in a square of side 2 radius + 1; half-widths are rounded half to even."""
    out = []
    for dy in range(-radius, radius + 1):
        w = round(radius * math.sqrt((radius * radius - dy * dy) / (radius * radius))) if radius else 0
        out += [(dy, dx) for dx in range(-w, w + 1)]
    return out


def dilated(cells: DataFrame, radius: int, dims: DataFrame | None = None) -> DataFrame:
    """(slide_id, grid_i, grid_j) of the cells that an ellipse around any given cell covers.

    dims (slide_id, n_rows, n_cols) clips to the grid. The fan-out is the kernel's size, whatever the data.
    """
    if radius <= 0:
        return cells.select("slide_id", "grid_i", "grid_j")
    kernel = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in ellipse(radius)])
    moved = cells.select("slide_id", "grid_i", "grid_j", F.explode(kernel).alias("o")).select("slide_id", (F.col("grid_i") + F.col("o.dy")).alias("grid_i"), (F.col("grid_j") + F.col("o.dx")).alias("grid_j"))
    if dims is not None:
        moved = moved.join(dims, "slide_id").where("grid_i >= 0 and grid_j >= 0 and grid_i < n_rows and grid_j < n_cols").select("slide_id", "grid_i", "grid_j")
    return moved.distinct()


def eroded(cells: DataFrame, radius: int, dims: DataFrame | None = None) -> DataFrame:
    """The cells whose ellipse lies within the given cells; of it, only what is inside the grid counts.

    dims (slide_id, n_rows, n_cols) says where the grid ends; without it, it never does.
    """
    kernel = ellipse(radius)
    offsets = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in kernel])
    moved = cells.select("slide_id", "grid_i", "grid_j", F.explode(offsets).alias("o"))
    hits = moved.groupBy("slide_id", (F.col("grid_i") - F.col("o.dy")).alias("grid_i"), (F.col("grid_j") - F.col("o.dx")).alias("grid_j")).agg(F.count("*").alias("n"))
    if dims is None:
        return hits.where(F.col("n") == len(kernel)).select("slide_id", "grid_i", "grid_j")
    at = lambda axis, o, n: (F.col(axis) + o >= 0) & (F.col(axis) + o < F.col(n))
    inside = F.size(F.filter(offsets, lambda o: at("grid_i", o["dy"], "n_rows") & at("grid_j", o["dx"], "n_cols")))
    there = at("grid_i", F.lit(0), "n_rows") & at("grid_j", F.lit(0), "n_cols")
    return hits.join(dims, "slide_id").where(there & (F.col("n") == inside)).select("slide_id", "grid_i", "grid_j")


def opened(cells: DataFrame, radius: int, dims: DataFrame | None = None) -> DataFrame:
    return dilated(eroded(cells, radius, dims), radius, dims)


def closed(cells: DataFrame, radius: int, dims: DataFrame | None = None) -> DataFrame:
    return eroded(dilated(cells, radius, dims), radius, dims)


def otsu_threshold(values: DataFrame, value: str, group: str, n: int = 256) -> DataFrame:
    """(group, threshold): the value up to which cutting the histogram of 0 … n - 1 best separates it; ties: the least.

    The histogram, at most n rows a group, is summed before the shuffle.
    """
    bins = values.groupBy(group, F.col(value).cast("int").alias("v")).agg(F.count("*").alias("c")).where(f"v >= 0 and v < {n}")
    up = Window.partitionBy(group).orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    everything = Window.partitionBy(group)
    run = bins.select(group, "v", F.sum("c").over(up).alias("w0"), F.sum(F.col("v") * F.col("c")).over(up).alias("s0"), F.sum("c").over(everything).alias("w"), F.sum(F.col("v") * F.col("c")).over(everything).alias("s"))
    w1 = F.col("w") - F.col("w0")
    # between-class variance times w², without division until the end: (s0 w - s w0)² / (w0 w1)
    gap = (F.col("s0") * F.col("w") - F.col("s") * F.col("w0")).cast("double")
    between = F.when(w1 > 0, gap * gap / (F.col("w0") * w1).cast("double")).otherwise(F.lit(0.0))
    return run.withColumn("b", between).groupBy(group).agg(F.max(F.struct("b", (-F.col("v")).alias("v"))).alias("m")).select(group, (-F.col("m.v")).alias("threshold"))


def resampled(cells: DataFrame, size_in: tuple[int, int], size_out: tuple[int, int], value: str, centred: bool = True) -> DataFrame:
    """Nearest-neighbour resampling of a dense (slide_id, y, x, value) by index, clamped to the grid.

    centred: out k reads in trunc((k + 0.5) s - 0.5), by pixel centres; else floor(k s), as image libraries do.
    """

    def source(k: str, n_in: int, n_out: int) -> Column:
        raw = (F.col(k) + 0.5) * F.lit(n_in / n_out) - 0.5
        whole = F.when(raw < 0, F.ceil(raw)).otherwise(F.floor(raw)) if centred else F.floor(F.col(k) * F.lit(n_in / n_out))
        return F.least(F.greatest(whole, F.lit(0)), F.lit(n_in - 1)).cast("int")

    slides = cells.select("slide_id").distinct()
    out = slides.withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(size_out[0] - 1)))).withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(size_out[1] - 1))))
    keyed = out.withColumn("_y", source("y", size_in[0], size_out[0])).withColumn("_x", source("x", size_in[1], size_out[1]))
    return keyed.join(cells.select("slide_id", F.col("y").alias("_y"), F.col("x").alias("_x"), value), ["slide_id", "_y", "_x"]).select("slide_id", "y", "x", value)


def blurred(a: np.ndarray, deviation: float = 1.0) -> np.ndarray:
    """Gaussian blur of an 8-bit image, mirrored at the border without repeating it; rounded half up.

    The kernel has as many taps as reach three deviations on each side (7 for 1).
    """
    reach = int(np.floor(deviation * 3 + 0.5))
    w = np.exp(-(np.arange(-reach, reach + 1) ** 2) / (2 * deviation**2))
    w /= w.sum()
    out = a.astype(float)
    for axis in (0, 1):
        n = out.shape[axis]
        at = np.abs(np.arange(-reach, n + reach))  # mirrored about the first pixel …
        period = max(1, 2 * (n - 1))
        at %= period
        at = np.where(at < n, at, period - at)  # … and about the last
        wide = out.take(at, axis)
        out = sum(w[k] * wide.take(range(k, k + n), axis) for k in range(2 * reach + 1))
    return np.floor(out + 0.5)


def _otsu(a: np.ndarray) -> int:
    c = np.bincount(a.astype(int).ravel(), minlength=256).astype(float)
    w0, s0 = np.cumsum(c), np.cumsum(c * np.arange(256))
    w1 = w0[-1] - w0
    with np.errstate(divide="ignore", invalid="ignore"):
        b = np.where((w0 > 0) & (w1 > 0), (s0 * w0[-1] - s0[-1] * w0) ** 2 / (w0 * w1), 0.0)
    return int(b.argmax())


def tissue_mask_array(rgb: np.ndarray, kernel: int = 7, least_area: int = 512) -> np.ndarray:
    """Tissue of a thumbnail: darker than Otsu's grey threshold or over that of saturation, opened, closed, without small components."""
    from gridloom.operators.groups import label_components

    r, g, b = (rgb[..., k].astype(float) for k in range(3))
    grey = np.floor(0.299 * r + 0.587 * g + 0.114 * b + 0.5)
    top, low = rgb.max(-1).astype(float), rgb.min(-1).astype(float)
    sat = np.floor(np.where(top > 0, (top - low) * 255 / np.maximum(top, 1), 0) + 0.5)
    grey, sat = blurred(grey), blurred(sat)
    mask = (grey < _otsu(grey)) | (sat > _otsu(sat))
    offsets = ellipse(max(3, kernel | 1) // 2)
    reach = max(3, kernel | 1) // 2

    def over(m: np.ndarray, grow: bool) -> np.ndarray:
        p = np.pad(m, reach, constant_values=not grow)
        views = [p[reach + dy : reach + dy + m.shape[0], reach + dx : reach + dx + m.shape[1]] for dy, dx in offsets]
        return np.logical_or.reduce(views) if grow else np.logical_and.reduce(views)

    mask = over(over(over(over(mask, False), True), True), False)
    labels = label_components(mask)
    areas = np.bincount(labels[labels >= 0], minlength=mask.size) if mask.any() else np.zeros(1, int)
    return mask & (labels >= 0) & (areas[np.maximum(labels, 0)] >= least_area)


def tissue_masks(thumbnails: DataFrame, kernel: int = 7, least_area: int = 512) -> DataFrame:
    """(slide_id, height, width, tissue binary: packed bits) of thumbnails (slide_id, height, width, rgb binary)."""

    def run(batches):
        for pdf in batches:
            masks = [tissue_mask_array(np.frombuffer(x, np.uint8).reshape(h, w, 3), kernel, least_area) for h, w, x in zip(pdf.height, pdf.width, pdf.rgb)]
            yield pd.DataFrame({"slide_id": pdf.slide_id, "height": pdf.height, "width": pdf.width, "tissue": [np.packbits(m).tobytes() for m in masks]})

    return thumbnails.select("slide_id", "height", "width", "rgb").mapInPandas(run, "slide_id string, height int, width int, tissue binary")


def unpacked(bits: bytes, height: int, width: int) -> np.ndarray:
    """A mask from its packed bits, row by row."""
    return np.unpackbits(np.frombuffer(bits, np.uint8), count=height * width).reshape(height, width).astype(bool)


def packed_box(masks: DataFrame, column: str = "tissue") -> DataFrame:
    """(slide_id, min_y, max_y, min_x, max_x), ends excluded, of packed masks (slide_id, height, width, column); none for an empty one."""
    kind = masks.schema["slide_id"].dataType.simpleString()

    def run(batches):
        for pdf in batches:
            rows = []
            for slide, h, w, bits in zip(pdf.slide_id, pdf.height, pdf.width, pdf[column]):
                m = unpacked(bits, h, w)
                if m.any():
                    ys, xs = np.flatnonzero(m.any(1)), np.flatnonzero(m.any(0))
                    rows.append((slide, ys[0], ys[-1] + 1, xs[0], xs[-1] + 1))
            yield pd.DataFrame(rows, columns=["slide_id", "min_y", "max_y", "min_x", "max_x"])

    return masks.select("slide_id", "height", "width", column).mapInPandas(run, f"slide_id {kind}, min_y int, max_y int, min_x int, max_x int")


def packed_fractions(tiles: DataFrame, masks: DataFrame, column: str, out: str) -> DataFrame:
    """tiles with the mean of a packed mask (slide_id, height, width, column) over each tile's pixels, like mask_fractions.

    One slide's tiles meet its mask in one row: a thumbnail is some megabytes and a grid some ten thousand tiles, whatever the
    number of slides. No row is made of a pixel; a task sums the mask once and looks four numbers up for each tile.
    """
    kind = tiles.schema["slide_id"].dataType.simpleString()
    item = F.struct("tile_id", "x0_lvl0", "y0_lvl0", "x1_lvl0", "y1_lvl0", F.col("scale_x").cast("double").alias("scale_x"), F.col("scale_y").cast("double").alias("scale_y"))
    both = tiles.groupBy("slide_id").agg(F.collect_list(item).alias("tiles")).join(masks.select("slide_id", "height", "width", column), "slide_id")

    def run(batches):
        for pdf in batches:
            for slide, listed, h, w, bits in zip(pdf.slide_id, pdf.tiles, pdf.height, pdf.width, pdf[column]):
                sums = np.zeros((h + 1, w + 1), np.int64)
                sums[1:, 1:] = unpacked(bits, h, w).cumsum(0).cumsum(1)
                t = pd.DataFrame([tuple(x.values()) if isinstance(x, dict) else tuple(x) for x in listed], columns=["tile_id", "x0", "y0", "x1", "y1", "sx", "sy"])
                at = lambda v, s, n, f: np.clip(f(v.to_numpy(float) * s.to_numpy(float)), 0, n).astype(np.int64)
                x0, x1 = at(t.x0, t.sx, w, np.floor), at(t.x1, t.sx, w, np.ceil)
                y0, y1 = at(t.y0, t.sy, h, np.floor), at(t.y1, t.sy, h, np.ceil)
                n = np.maximum(x1 - x0, 0) * np.maximum(y1 - y0, 0)
                total = sums[y1, x1] - sums[y0, x1] - sums[y1, x0] + sums[y0, x0]
                yield pd.DataFrame({"slide_id": slide, "tile_id": t.tile_id.astype(np.int64), out: np.where(n > 0, total / np.maximum(n, 1), 0.0)})

    found = both.mapInPandas(run, f"slide_id {kind}, tile_id long, {out} double")
    return tiles.join(found, ["slide_id", "tile_id"])
