"""Batched model calls over tiles, and a feature store that only takes what is missing."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from gridloom.functions.scalar import to_half
from gridloom.operators.vectors import window_cells
from gridloom.sources import readers

Encoder = Callable[[np.ndarray], np.ndarray]


def stand_in_encoder(width: int) -> Callable[[], Encoder]:
    """A deterministic encoder for tests and dry runs: cosines of a tile's mean at `width` frequencies."""

    def make() -> Encoder:
        rates = np.arange(1, width + 1, dtype=np.float64)

        def encode(tiles: np.ndarray) -> np.ndarray:
            flat = np.asarray(tiles, np.float64).reshape(len(tiles), -1)
            return np.cos(flat.mean(1, keepdims=True) * rates)

        return encode

    return make


def selected_output(out, width: int, keys: tuple[str, ...] = ("image_features", "features", "embeddings", "last_hidden_state")) -> np.ndarray:
    """A model's vectors, whatever form it returns: a dict's first known key, a tuple's first part, a sequence's first token."""
    if isinstance(out, dict):
        out = next((out[k] for k in keys if k in out), next(iter(out.values())))
    if isinstance(out, (tuple, list)):
        out = out[0]
    out = np.asarray(out)
    if out.ndim == 3:
        out = out[:, 0]
    if out.ndim != 2 or out.shape[1] != width:
        raise ValueError(f"the encoder returns {out.shape}, not rows of {width}")
    return out


def as_bytes_range(tiles: np.ndarray) -> np.ndarray:
    """Tiles as 0 … 255; values that are all within 0 … 1 are scaled."""
    tiles = np.asarray(tiles)
    if tiles.dtype == np.uint8:
        return tiles
    scale = 255.0 if tiles.size and tiles.max() <= 1 else 1.0
    return np.clip(tiles * scale, 0, 255).astype(np.uint8)


def encoder_udf(make: Callable[[], Encoder], width: int, batch: int = 32, unit: bool = False, shape: list[int] | None = None):
    """A batch UDF over numeric columns, or arrays of the given shape; the model is made once for each Python worker."""

    def loaded():
        model = make()

        def predict(x: np.ndarray) -> np.ndarray:
            v = selected_output(model(x), width).astype(np.float32)
            if unit:
                norm = np.linalg.norm(v, axis=1, keepdims=True)
                v = v / np.where(norm > 0, norm, 1)
            return v

        return predict

    return predict_batch_udf(loaded, return_type=ArrayType(FloatType()), batch_size=batch, input_tensor_shapes=[shape] if shape else None)


def prepared(tiles: np.ndarray, side: int, mean: tuple[float, ...] = (0.485, 0.456, 0.406), deviation: tuple[float, ...] = (0.229, 0.224, 0.225)) -> np.ndarray:
    """uint8 tiles (n, h, w, 3) as a model's input (n, 3, side, side): the shorter side resized, the centre cut out, normalised."""
    n, h, w, _ = tiles.shape
    scale = side / min(h, w)
    size = tuple(max(side, int(x * scale)) for x in (h, w))
    x = tiles.astype(float)
    for axis, to in ((1, size[0]), (2, size[1])):
        x = _linear(x, axis, to)
    top, left = (round((s - side) / 2) for s in size)
    x = x[:, top : top + side, left : left + side] / 255.0
    return ((x - np.array(mean)) / np.array(deviation)).transpose(0, 3, 1, 2).astype(np.float32)


def _linear(x: np.ndarray, axis: int, to: int) -> np.ndarray:
    """Linear resampling of an axis by pixel centres; where it shrinks, each pixel's triangle is as wide as what it covers."""
    n = x.shape[axis]
    if n == to:
        return x
    ratio = n / to
    reach = max(1.0, ratio)
    centres = (np.arange(to) + 0.5) * ratio - 0.5
    weight = np.maximum(0.0, 1 - np.abs(np.arange(n)[None] - centres[:, None]) / reach)
    weight /= weight.sum(1, keepdims=True)
    return np.moveaxis(np.tensordot(weight, x, axes=(1, axis)), 0, axis)


def encode_slides(tiles: DataFrame, make: Callable[[], Encoder], tile: int, width: int, batch: int = 32, openers: dict | None = None, transform: Callable[[np.ndarray], np.ndarray] | None = None, progress: Callable[[str, int], None] | None = None) -> DataFrame:
    """(slide_id, grid_i, grid_j, features) read straight from slides (tiles: slide_id, slide_path, grid_i, grid_j, x0_lvl0, y0_lvl0).

    A task opens a slide once for each run of its rows and closes it. openers go with the task (readers.open_slide).
    transform is put before the model (prepared, for one); progress is told the slide and the cells done after each batch,
    in the worker.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model, path, slide = make(), None, None
        try:
            for pdf in frames:
                for at in range(0, len(pdf), batch):
                    part, images = pdf.iloc[at : at + batch], []
                    for row in part.itertuples():
                        if row.slide_path != path:
                            if slide is not None and hasattr(slide, "close"):
                                slide.close()
                            path, slide = row.slide_path, readers.open_slide(row.slide_path, openers)
                        images.append(np.asarray(slide.read_region((row.x0_lvl0, row.y0_lvl0), 0, (tile, tile)))[..., :3])
                    x = as_bytes_range(np.stack(images))
                    v = selected_output(model(transform(x) if transform else x), width)
                    yield pd.DataFrame({"slide_id": part.slide_id.to_numpy(), "grid_i": part.grid_i.to_numpy(), "grid_j": part.grid_j.to_numpy(), "features": list(v.astype(np.float32))})
                    if progress:
                        progress(str(part.slide_id.iloc[-1]), len(part))
        finally:
            if slide is not None and hasattr(slide, "close"):
                slide.close()

    kind = tiles.schema["slide_id"].dataType.simpleString()
    dealt = tiles.select("slide_id", "slide_path", "grid_i", "grid_j", "x0_lvl0", "y0_lvl0").repartition("slide_id", F.floor(F.col("grid_i") / 16)).sortWithinPartitions("slide_path", "grid_i", "grid_j")
    return dealt.mapInPandas(run, f"slide_id {kind}, grid_i int, grid_j int, features array<float>")


def needed_tiles(windows: DataFrame, tiles: DataFrame, r: int, least_tissue: float) -> DataFrame:
    """(slide_id, grid_i, grid_j): tiles of any window that exist and have enough tissue."""
    ok = tiles.where(to_half(F.col("tissue_frac")) >= least_tissue).select("slide_id", "grid_i", "grid_j")
    return window_cells(windows, r, ("slide_id",)).distinct().join(ok, ["slide_id", "grid_i", "grid_j"], "left_semi")


def missing_tiles(needed: DataFrame, encoded: DataFrame, overwrite: bool = False) -> DataFrame:
    """The needed tiles that the store lacks; on overwrite all of them, as the store is written anew."""
    if overwrite:
        return needed
    return needed.join(encoded.where("valid").select("slide_id", "grid_i", "grid_j"), ["slide_id", "grid_i", "grid_j"], "left_anti")


def encode_stats(needed: DataFrame, encoded: DataFrame) -> DataFrame:
    """(slide_id, requested, already, now) of an incremental run."""
    had = encoded.where("valid").select("slide_id", "grid_i", "grid_j", F.lit(1).alias("_had"))
    both = needed.join(had, ["slide_id", "grid_i", "grid_j"], "left")
    return both.groupBy("slide_id").agg(F.count("*").alias("requested"), F.count("_had").alias("already"), F.count_if(F.col("_had").isNull()).alias("now"))


def stored_features(rows: DataFrame, width: int, block: int = 16, valid: Column | None = None) -> DataFrame:
    """Rows as the store keeps them: half precision, invalid cells zero, vectors of the wrong width an error, block numbers."""
    ok = F.lit(True) if valid is None else valid
    v = F.when(F.size("features") == width, F.transform("features", lambda x: to_half(x.cast("double").alias("x")).cast("float"))).otherwise(F.raise_error(F.lit(f"features must have {width} numbers")))
    return rows.select(
        "slide_id", F.floor(F.col("grid_i") / block).cast("int").alias("block_i"), F.floor(F.col("grid_j") / block).cast("int").alias("block_j"), "grid_i", "grid_j",
        F.when(ok, v).otherwise(F.array_repeat(F.lit(0.0).cast("float"), width)).alias("features"), ok.alias("valid"),
    )


def upserted(store: DataFrame, new: DataFrame) -> DataFrame:
    """The store after new cells took the place of old ones."""
    return store.join(new.select("slide_id", "grid_i", "grid_j"), ["slide_id", "grid_i", "grid_j"], "left_anti").unionByName(new)


def checked_bounds(rows: DataFrame, dims: DataFrame) -> DataFrame:
    """rows, with an error for a cell outside its slide's grid (dims: slide_id, grid_h, grid_w)."""
    out = rows.join(dims, "slide_id")
    inside = (F.col("grid_i") >= 0) & (F.col("grid_j") >= 0) & (F.col("grid_i") < F.col("grid_h")) & (F.col("grid_j") < F.col("grid_w"))
    return out.withColumn("grid_i", F.when(inside, F.col("grid_i")).otherwise(F.raise_error(F.concat(F.lit("cell outside the grid of slide "), F.col("slide_id").cast("string"))).cast("int"))).drop("grid_h", "grid_w")


def unique_cells(tiles: DataFrame) -> DataFrame:
    """One row per (slide_id, grid_i, grid_j); a cell that stands twice is an error."""
    once = tiles.groupBy("slide_id", "grid_i", "grid_j").agg(F.count("*").alias("_n"), *(F.first(c).alias(c) for c in tiles.columns if c not in ("slide_id", "grid_i", "grid_j")))
    bad = F.raise_error(F.concat(F.lit("tile stands twice in slide "), F.col("slide_id").cast("string"))).cast("int")
    return once.withColumn("grid_i", F.when(F.col("_n") == 1, F.col("grid_i")).otherwise(bad)).select(*tiles.columns)
