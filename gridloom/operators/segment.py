"""Artifacts of slides: a model reads patches at its own resolution where there is tissue; its labels come back to the thumbnail."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from gridloom.operators.grid import unpacked
from gridloom.operators.views import BACKGROUND, FIRST_ARTIFACT, LAST_ARTIFACT
from gridloom.sources import readers

#: A segmenter takes uint8 images (n, side, side, 3) and returns labels (n, side, side), or scores by class (n, classes, side, side).
Segmenter = Callable[[np.ndarray], np.ndarray]
# Micrometres per pixel that the model reads, side of a patch, tissue pixels a patch needs more than, patches of a call.
MPP, PATCH, LEAST_TISSUE, BATCH = 1.5, 512, 50, 4


def stand_in_segmenter() -> Callable[[], Segmenter]:
    """A deterministic segmenter for tests and dry runs: green pixels are a dark spot (3), others clean tissue (1)."""

    def make() -> Segmenter:
        return lambda images: np.where((images[..., 1] > images[..., 0]) & (images[..., 1] > images[..., 2]), 3, 1)

    return make


def source_index(n_out: int, n_in: int, centred: bool) -> np.ndarray:
    """Which of n_in pixels each of n_out reads: by pixel centres (centred), or floor(k n_in / n_out)."""
    k = np.arange(n_out)
    raw = np.trunc((k + 0.5) * (n_in / n_out) - 0.5) if centred else np.floor(k * (n_in / n_out))
    return np.clip(raw, 0, n_in - 1).astype(np.int64)


def resized(image: np.ndarray, side: int) -> np.ndarray:
    """An 8-bit image in another size: means of the pixels that each new one covers, or the nearest pixel where it grows."""
    out = image.astype(float)
    for axis in (0, 1):
        n = out.shape[axis]
        if n <= side:
            out = out.take(source_index(side, n, False), axis)
        else:
            edges = np.linspace(0, n, side + 1)
            total = np.concatenate([np.zeros_like(out.take([0], axis)), np.cumsum(out, axis)], axis)
            low = np.minimum(np.floor(edges).astype(int), n - 1)
            part = (edges - low).reshape([-1 if k == axis else 1 for k in range(out.ndim)])
            at = total.take(low, axis) + part * out.take(low, axis)
            out = np.diff(at, axis=axis) * (side / n)
    return np.floor(out + 0.5).clip(0, 255).astype(np.uint8)


def labels_of(out: np.ndarray) -> np.ndarray:
    """Labels 1 to 7 of a model's output: the best class of scores; a patch whose labels run from 0 to 6 is shifted by one."""
    out = np.asarray(out[0] if isinstance(out, (tuple, list)) else out)
    labels = out.argmax(1) if out.ndim == 4 else out
    if labels.ndim != 3:
        raise ValueError(f"the segmenter returns {out.shape}")
    shift = (labels.min(axis=(1, 2)) == 0) & (labels.max(axis=(1, 2)) == 6)
    return labels + shift[:, None, None]


def class_map(slide: object, tissue: np.ndarray, mpp: float, model: Segmenter, wanted: float = MPP, patch: int = PATCH, least: int = LEAST_TISSUE, batch: int = BATCH, progress: Callable[[int, int], None] | None = None) -> tuple[np.ndarray, int, int]:
    """(classes of each thumbnail pixel, patches in the tissue's box, patches that the model read).

    tissue: mask of the thumbnail. The model's space has `wanted` micrometres per pixel; its patches that hold more than
    `least` tissue pixels are read. Outside tissue, and where the model says 0, is background.
    """
    h, w = tissue.shape
    out = np.full((h, w), BACKGROUND, np.uint8)
    width, height = (max(1, round(n * mpp / wanted)) for n in slide.level_dimensions[0])
    inside = tissue[np.ix_(source_index(height, h, False), source_index(width, w, False))]
    if not inside.any():
        return out, 0, 0
    ys, xs = np.flatnonzero(inside.any(1)), np.flatnonzero(inside.any(0))
    (top, bottom), (left, right) = (ys[0], ys[-1] + 1), (xs[0], xs[-1] + 1)
    scale = wanted / mpp
    side0 = max(1, round(patch * scale))
    level = max((k for k, d in enumerate(slide.level_downsamples) if d <= scale * (1 + 1e-9)), default=0)
    side = max(1, round(side0 / slide.level_downsamples[level]))
    found = np.full((bottom - top, right - left), BACKGROUND, np.uint8)
    places = [(y, x) for y in range(top // patch * patch, bottom, patch) for x in range(left // patch * patch, right, patch)]
    todo = [(y, x) for y, x in places if np.count_nonzero(inside[y : y + patch, x : x + patch]) > least]
    for k in range(0, len(todo), batch):
        part = todo[k : k + batch]
        regions = [np.asarray(slide.read_region((round(x * scale), round(y * scale)), level, (side, side)))[..., :3] for y, x in part]
        for (y, x), got in zip(part, labels_of(model(np.stack([resized(r, patch) for r in regions])))):
            seen = inside[y : y + patch, x : x + patch]
            got = got[: seen.shape[0], : seen.shape[1]]
            y0, y1, x0, x1 = max(y, top), min(y + seen.shape[0], bottom), max(x, left), min(x + seen.shape[1], right)
            block = np.where(seen & (got != 0), got, BACKGROUND)
            found[y0 - top : y1 - top, x0 - left : x1 - left] = block[y0 - y : y1 - y, x0 - x : x1 - x]
        if progress:
            progress(min(k + batch, len(todo)), len(todo))
    at_y, at_x = source_index(h, height, True), source_index(w, width, True)
    in_y, in_x = np.flatnonzero((at_y >= top) & (at_y < bottom)), np.flatnonzero((at_x >= left) & (at_x < right))
    if len(in_y) and len(in_x):
        out[np.ix_(in_y, in_x)] = found[np.ix_(at_y[in_y] - top, at_x[in_x] - left)]
    return out, len(places), len(todo)


def thumbnail_map(rgb: np.ndarray, tissue: np.ndarray | None, model: Segmenter, side: int = PATCH) -> tuple[np.ndarray, np.ndarray]:
    """(artifact mask of an image, its classes in the model's size) of one image that the model reads as a whole."""
    labels = labels_of(model(resized(rgb, side)[None]))[0]
    if tissue is not None:
        seen = tissue[np.ix_(source_index(side, tissue.shape[0], False), source_index(side, tissue.shape[1], False))]
        labels = np.where(seen, labels, BACKGROUND)
    artifact = is_artifact(labels)
    back = artifact[np.ix_(source_index(rgb.shape[0], side, False), source_index(rgb.shape[1], side, False))]
    return back, labels.astype(np.uint8)


def is_artifact(classes: np.ndarray) -> np.ndarray:
    return (classes >= FIRST_ARTIFACT) & (classes <= LAST_ARTIFACT)


def artifact_masks(slides: DataFrame, make: Callable[[], Segmenter], openers: dict[str, Callable] | None = None, **options) -> DataFrame:
    """(slide_id, height, width, artifact packed bits, classes bytes, patches, patches_read) of slides.

    slides: slide_id, slide_path, mpp, height, width, tissue (packed). The model is made once for each worker; one slide is
    one row's work: it is opened once, its patches are read in batches, and nothing but its thumbnail-sized map leaves the
    task. A slide without a positive mpp is an error.
    """
    kind = slides.schema["slide_id"].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make()
        for pdf in frames:
            for row in pdf.itertuples():
                if not row.mpp > 0:
                    raise ValueError(f"slide {row.slide_id} has no micrometres per pixel")
                with readers.opened_slide(row.slide_path, openers) as slide:
                    classes, n, n_read = class_map(slide, unpacked(row.tissue, row.height, row.width), row.mpp, model, **options)
                yield pd.DataFrame([(row.slide_id, row.height, row.width, np.packbits(is_artifact(classes)).tobytes(), classes.tobytes(), n, n_read)], columns=["slide_id", "height", "width", "artifact", "classes", "patches", "patches_read"])

    return slides.select("slide_id", "slide_path", "mpp", "height", "width", "tissue").mapInPandas(run, f"slide_id {kind}, height int, width int, artifact binary, classes binary, patches int, patches_read int")
