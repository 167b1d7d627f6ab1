"""Where slides, manifests and grids come from."""

from __future__ import annotations

import contextlib
import importlib
import shutil
import tempfile
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from gridloom.schemas import TILE_MANIFEST

# File endings of slide images.
SLIDE_ENDINGS = (".svs", ".tif", ".tiff", ".ndpi", ".mrxs", ".scn", ".vms", ".vmu", ".svslide", ".bif")
SERIES_ENDING = ".dcm"


def file_paths(spark: SparkSession, root: str) -> DataFrame:
    """(path) of all files below a root; only names are read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path")


def slide_paths(paths: DataFrame, endings: tuple[str, ...] = SLIDE_ENDINGS, series_ending: str = SERIES_ENDING) -> DataFrame:
    """(slide_path) distinct: files with a slide's ending in any case, and the folders that hold series files."""
    low = F.lower("path")
    one_of = lambda ends: F.lit(False) if not ends else None
    hit = one_of(endings)
    if hit is None:
        hit = low.endswith(endings[0])
        for e in endings[1:]:
            hit = hit | low.endswith(e)
    files = paths.where(hit).select(F.col("path").alias("slide_path"))
    folders = paths.where(low.endswith(series_ending)).select(F.regexp_replace("path", r"/[^/]*$", "").alias("slide_path"))
    return files.unionByName(folders).distinct()


def slide_records(paths: DataFrame, output_root: str | None = None) -> DataFrame:
    """Slide records of raw slides, with the output folder each would have: root (or its own folder) / stem_qc."""
    name = F.regexp_extract("slide_path", r"[^/]*$", 0)
    stem = F.regexp_replace(name, r"\.[^.]*$", "")
    folder = F.coalesce(F.lit(output_root), F.regexp_replace("slide_path", r"/[^/]*$", ""))
    out = F.concat(folder, F.lit("/"), stem, F.lit("_qc"))
    return paths.select(stem.alias("slide_id"), out.alias("preprocess_dir"), F.concat(out, F.lit("/qc")).alias("qc_path"), F.concat(out, F.lit("/features")).alias("features_path"), "slide_path")


def preprocessed_records(paths: DataFrame, marker: str = "preprocess_metadata.json") -> DataFrame:
    """Slide records of finished output folders, found by their marker file; the id is the folder's name without _qc."""
    at = paths.where(F.col("path").endswith("/" + marker)).select(F.regexp_replace("path", r"/[^/]*$", "").alias("preprocess_dir")).distinct()
    name = F.regexp_replace(F.regexp_extract("preprocess_dir", r"[^/]*$", 0), r"_qc$", "")
    return at.select(name.alias("slide_id"), "preprocess_dir", F.concat("preprocess_dir", F.lit("/qc")).alias("qc_path"), F.concat("preprocess_dir", F.lit("/features")).alias("features_path"), F.lit(None).cast("string").alias("slide_path"))


def slides(spark: SparkSession, preprocess_root: str | None = None, slides_root: str | None = None, output_root: str | None = None) -> DataFrame:
    """Slide records from finished folders or from raw slides; exactly one root must be given, and no slide is an error."""
    if (preprocess_root is None) == (slides_root is None):
        raise ValueError("give either preprocess_root or slides_root")
    found = preprocessed_records(file_paths(spark, preprocess_root)) if preprocess_root else slide_records(slide_paths(file_paths(spark, slides_root)), output_root)
    if found.isEmpty():
        raise ValueError(f"no slides under {preprocess_root or slides_root}")
    return found


def slide_id_of(metadata_json, folder):
    """A slide's id from its metadata, else the folder's name."""
    return F.coalesce(F.get_json_object(metadata_json, "$.slide_id"), F.regexp_extract(folder, r"[^/]*$", 0))


def read_table(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The schema's columns; a table's own partition columns are left out."""
    return spark.read.schema(schema).parquet(path).select(*schema.names)


def read_legacy_manifests(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Tile manifests whose files disagree on types (an all-null column may have none).

    Files are read by tasks, each cast on its own; a column that a file lacks is null. The plan does not grow with the files.
    """
    if not paths:
        return spark.createDataFrame([], TILE_MANIFEST)
    wanted = to_arrow_schema(TILE_MANIFEST)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column(0):
                for part in pq.ParquetFile(pa.BufferReader(content.as_buffer())).iter_batches():
                    cols = [part.column(part.schema.get_field_index(x.name)).cast(x.type) if x.name in part.schema.names else pa.nulls(part.num_rows, x.type) for x in wanted]
                    yield pa.RecordBatch.from_arrays(cols, schema=wanted)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").load(paths)
    return files.select("content").mapInArrow(run, TILE_MANIFEST)


def grid_rectangle(grid: DataFrame, rows: tuple[int, int], cols: tuple[int, int], block: int = 16) -> DataFrame:
    """The cells of a rectangle (half open); the bounds on blocks prune partitions and row groups before the cells'."""
    if "block_i" in grid.columns:
        grid = grid.where(F.col("block_i").between(rows[0] // block, (rows[1] - 1) // block) & F.col("block_j").between(cols[0] // block, (cols[1] - 1) // block))
    return grid.where(F.col("grid_i").between(rows[0], rows[1] - 1) & F.col("grid_j").between(cols[0], cols[1] - 1))


# Properties that hold micrometres per pixel, and the objective's power.
SPACING_PROPERTIES = ("openslide.mpp-x", "openslide.mpp-y", "aperio.MPP")
POWER_PROPERTIES = ("openslide.objective-power", "aperio.AppMag", "hamamatsu.SourceLens")

#: How a slide is opened, by the ending of its path; folders of series files have the empty ending.
_OPENERS: dict[str, Callable[[str], object]] = {}


def register_opener(ending: str, opener: Callable[[str], object]) -> None:
    """Register a reader in this process; jobs take readers as an option, so that executors have them, too."""
    _OPENERS[ending.lower()] = opener


def local_path(path: str) -> str:
    return path.removeprefix("file://").removeprefix("file:") if path.startswith("file:") else path


def _known_opener(path: str) -> Callable[[str], object] | None:
    """Readers of installed libraries, and of arrays saved by numpy."""
    low = path.lower()
    if low.endswith(".npy"):
        import numpy as np

        return lambda p: ArraySlide(np.load(local_path(p)))
    if low.endswith(SLIDE_ENDINGS):
        try:
            import openslide
        except ImportError:
            return None
        return lambda p: openslide.OpenSlide(local_path(p))
    try:
        import wsidicom
    except ImportError:
        return None
    return lambda p: SeriesSlide.of(wsidicom.WsiDicom.open(local_path(p if not p.lower().endswith(SERIES_ENDING) else p.rpartition("/")[0])))


def open_slide(path: str, openers: dict[str, Callable[[str], object]] | None = None) -> object:
    """The slide at path, by the reader with the longest ending that fits: those given, else those registered, else known ones."""
    for known in (openers or {}, _OPENERS):
        for ending, opener in sorted(known.items(), key=lambda x: -len(x[0])):
            if path.lower().endswith(ending.lower()):
                return opener(path)
    if opener := _known_opener(path):
        return opener(path)
    raise ValueError(f"no reader for {path}; give one with --opener ending=module:function")


@contextlib.contextmanager
def opened_slide(path: str, openers: dict[str, Callable[[str], object]] | None = None) -> Iterator[object]:
    slide = open_slide(path, openers)
    try:
        yield slide
    finally:
        if hasattr(slide, "close"):
            slide.close()


def named_openers(texts: list[str] | None) -> dict[str, Callable[[str], object]]:
    """Readers from `ending=module:function` texts (an empty ending is for folders of series files)."""
    out = {}
    for text in texts or []:
        ending, _, target = text.partition("=")
        out[ending] = named(target)
    return out


def named(target: str):
    """What `module:name` names."""
    module, _, name = target.rpartition(":")
    return getattr(importlib.import_module(module), name)


def numbers(properties: dict, keys: tuple[str, ...]) -> list[float]:
    out = []
    for k in keys:
        with contextlib.suppress(TypeError, ValueError):
            out.append(float(properties[k] if k in properties else None))
    return out


def spacing_of(properties: dict) -> float | None:
    """Micrometres per pixel at level 0: the mean of the properties that are numbers."""
    found = numbers(properties, SPACING_PROPERTIES)
    return sum(found) / len(found) if found else None


def power_of(properties: dict, spacing: float | None) -> float | None:
    """The objective's power: the first positive property, else ten over the spacing."""
    found = [x for x in numbers(properties, POWER_PROPERTIES) if x > 0]
    return found[0] if found else (10.0 / spacing if spacing and spacing > 0 else None)


def pair_of(spacing: object) -> tuple[float, float] | None:
    """(row, column) spacing from a pair or from an object that names its parts; None where it has none."""
    with contextlib.suppress(TypeError, ValueError, AttributeError):
        if hasattr(spacing, "__len__"):
            row, col = (float(x) for x in spacing)
        elif hasattr(spacing, "row") and hasattr(spacing, "column"):
            row, col = float(spacing.row), float(spacing.column)
        else:
            row, col = float(spacing.height if hasattr(spacing, "height") else spacing.y), float(spacing.width if hasattr(spacing, "width") else spacing.x)
        return (row, col) if row > 0 and col > 0 else None
    return None


class SeriesSlide:
    """A series of images, one for each level, read like a single file: places are in level-0 pixels, outside is black.

    levels: (number of the level in the series, width, height), largest first. read(number, (x, y), (w, h)): pixels of a
    level, at places of that level, all inside it. Spacings (millimetres) are tried in turn.
    """

    def __init__(self, levels: list[tuple[int, int, int]], read: Callable, spacings: tuple = (), power: object = None, close: Callable[[], None] | None = None):
        self.numbers, self.read, self._close = [n for n, _, _ in levels], read, close
        self.level_dimensions = [(int(w), int(h)) for _, w, h in levels]
        self.level_downsamples = [self.level_dimensions[0][0] / w if w > 0 else 1.0 for w, _ in self.level_dimensions]
        self.properties: dict[str, str] = {}
        for spacing in spacings:
            if found := pair_of(spacing):
                self.properties |= {"openslide.mpp-y": str(found[0] * 1000), "openslide.mpp-x": str(found[1] * 1000)}
                break
        with contextlib.suppress(TypeError, ValueError):
            if float(power) > 0:
                self.properties["openslide.objective-power"] = str(float(power))

    @classmethod
    def of(cls, series: object) -> SeriesSlide:
        """From an opened series whose levels have data sets, as series libraries have them."""
        levels = list(series.levels)
        first = levels[0].datasets[0]
        sizes = [(int(getattr(x, "level", k)), x.datasets[0].TotalPixelMatrixColumns, x.datasets[0].TotalPixelMatrixRows) for k, x in enumerate(levels)]
        image = getattr(getattr(series, "metadata", None), "image", None)
        spacings = (getattr(image, "pixel_spacing", None), getattr(first, "PixelSpacing", None))
        return cls(sizes, lambda n, at, size: series.read_region(at, n, size), spacings, getattr(first, "ObjectiveLensPower", None), series.close)

    def read_region(self, location: tuple[int, int], level: int, size: tuple[int, int]):
        import numpy as np

        (w0, h0), (w, h) = self.level_dimensions[0], self.level_dimensions[level]
        if min(size) <= 0:
            raise ValueError(f"a region of {size} pixels")
        x, y = round(location[0] * w / w0), round(location[1] * h / h0)
        left, top, right, bottom = max(0, x), max(0, y), min(w, x + size[0]), min(h, y + size[1])
        if right <= left or bottom <= top:
            return np.zeros((size[1], size[0], 3), np.uint8)
        got = np.asarray(self.read(self.numbers[level], (left, top), (right - left, bottom - top)))
        if got.shape[:2] == (size[1], size[0]):
            return got
        out = np.zeros((size[1], size[0], got.shape[2]), got.dtype)
        out[top - y : bottom - y, left - x : right - x] = got
        return out

    def close(self) -> None:
        if self._close:
            self._close()


class ArraySlide:
    """An in-memory pyramid of one array: regions, other levels by stride, and zeros outside the image."""

    def __init__(self, pixels, downsamples: tuple[int, ...] = (1,), properties: dict[str, str] | None = None):
        self.pixels, self.level_downsamples, self.properties = pixels, downsamples, properties or {}
        self.level_dimensions = [(pixels.shape[1] // d, pixels.shape[0] // d) for d in downsamples]

    def read_region(self, location: tuple[int, int], level: int, size: tuple[int, int]):
        import numpy as np

        d = self.level_downsamples[level]
        out = np.zeros((size[1], size[0], self.pixels.shape[2]), self.pixels.dtype)
        ys, xs = location[1] + d * np.arange(size[1]), location[0] + d * np.arange(size[0])
        yi, xi = np.flatnonzero((ys >= 0) & (ys < self.pixels.shape[0])), np.flatnonzero((xs >= 0) & (xs < self.pixels.shape[1]))
        if len(yi) and len(xi):
            out[np.ix_(yi, xi)] = self.pixels[np.ix_(ys[yi], xs[xi])]
        return out


class Fetched:
    """Opens a series that a function first fetches into a folder; the folder is gone when the slide is closed."""

    def __init__(self, fetch: Callable[[str, str], None], openers: dict[str, Callable[[str], object]] | None = None):
        self.fetch, self.openers = fetch, openers

    def __call__(self, uid: str) -> object:
        folder = tempfile.mkdtemp(prefix="series-")
        try:
            self.fetch(uid, folder)
            slide = open_slide(folder, self.openers)
        except BaseException:
            shutil.rmtree(folder, ignore_errors=True)
            raise
        inner = getattr(slide, "close", None)

        def close() -> None:
            if inner:
                inner()
            shutil.rmtree(folder, ignore_errors=True)

        slide.close = close
        return slide


def with_series(series: DataFrame, fetch: Callable[[str, str], None], work: Callable[[str, pd.Series], pd.DataFrame], schema: StructType | str, key: str = "SeriesInstanceUID") -> DataFrame:
    """Results of `work` on each series, whose files `fetch(uid, folder)` puts into a folder that is gone afterwards.

    The folder is the executor's own: it is filled, used and removed within one row's work.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for _, row in pdf.iterrows():
                folder = tempfile.mkdtemp(prefix="series-")
                try:
                    fetch(row[key], folder)
                    yield work(folder, row)
                finally:
                    shutil.rmtree(folder, ignore_errors=True)

    return series.mapInPandas(run, schema)
