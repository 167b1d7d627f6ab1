"""Whole jobs: curation, preprocessing, sampling, encoding. Each skips what is done, so a run that broke off can go on."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions import scalar as sc
from gridloom.functions.scalar import quality
from gridloom.operators import curate, grid, sampling, select, vectors, views
from gridloom.operators.encode import encode_stats, missing_tiles, needed_tiles
from gridloom.sources import readers, sinks
from gridloom.storage import cut


def not_done(todo: DataFrame, done: DataFrame, key: str = "slide_id") -> DataFrame:
    return todo.join(done.select(key).distinct(), key, "left_anti")


def tile_grid(slides: DataFrame, tissue: DataFrame, artifact: DataFrame | None, least_tissue: float) -> DataFrame:
    """Judged tiles of slides (slide_id, width, height, tile, scale_x, scale_y) from their masks (slide_id, y, x, flag).

    A slide without tissue has no tiles and is no failure; a missing artifact mask counts as clean.
    """
    box = grid.bounding_box(tissue.where("flag"))
    tiles = grid.tiles_of(grid.tile_extent(slides.join(box, "slide_id")))
    with_tissue = grid.mask_fractions(tiles, tissue, "flag").withColumnRenamed("fraction", "tissue_frac")
    if artifact is None:
        both = with_tissue.withColumn("artifact_frac", F.lit(0.0))
    else:
        found = grid.mask_fractions(tiles, artifact, "flag").select("slide_id", "tile_id", F.col("fraction").alias("artifact_frac"))
        both = with_tissue.join(found, ["slide_id", "tile_id"], "left").withColumn("artifact_frac", F.coalesce("artifact_frac", F.lit(0.0)))
    return grid.judged_tiles(both, least_tissue).drop("scale_x", "scale_y")


def sample_rois(cells: DataFrame, features: DataFrame | None, r: int, *, k: int = 4, n: int = 128, target: int | None = 64, width: int = 768, history: DataFrame | None = None, method: str = "fps", nms: float = 0.3, most_history: float | None = 0.6, alpha: float = 1.0, eps: float = 0.05, seed: int = 0, spread: bool = False, tau: float | None = None, **gates) -> DataFrame:
    """Gated candidates of every slide with `pick` for the k chosen ones (null else).

    Features are joined only after the gate, to the windows that passed. k > 0 without features is an error unless nothing
    passed. A target of 0 or less means none. history: slide_id, grid_i, grid_j, embedding of earlier picks.
    """
    target = target if target and target > 0 else None
    found = cut(sampling.candidates_of(cells, r, n, target, seed=seed, **gates), "candidates")
    if k <= 0:
        return found.withColumn("pick", F.lit(None).cast("int"))
    passed = found.where("passed_qc")
    if features is None:
        if passed.isEmpty():
            return found.withColumn("pick", F.lit(None).cast("int"))
        raise ValueError("choosing windows needs features")
    with_vectors = passed.join(vectors.window_embeddings(passed, cells, features, r, gates.get("tile_tissue", 0.3), width), ["slide_id", "roi_id"])
    q = quality(F.col("tissue_frac"), F.col("artifact_frac"))
    if history is not None:
        with_vectors = vectors.with_novelty(with_vectors, history, alpha, eps)
        q = q * F.col("novelty")
    picked = select.select_diverse(with_vectors.withColumn("quality", q), k, r, history, nms=nms, most_history=most_history, method=method, seed=seed, spread=spread, tau=tau)
    return found.join(picked, ["slide_id", "roi_id"], "left")


# Sides of global and local crops, how many of each, and shares of cells that are masked.
CROP_SIDES, CROP_COUNTS = (14, 6), (2, 10)
MASKED = {"teacher_global": 0.0, "student_global": 0.45, "student_local": 0.55}


def train_views(candidates: DataFrame, cells: DataFrame, features: DataFrame, r: int, epoch: int = 0, batch: int = 4, tile_tissue: float = 0.3, sizes: tuple[int, int] = CROP_SIDES, counts: tuple[int, int] = CROP_COUNTS, masked: dict[str, float] = MASKED, seed: int = 0, **changes) -> DataFrame:
    """The cells of every crop that one epoch of training reads, in its batches of slides; the models are not part of this.

    candidates: sampled windows, as sample_rois returns them. Of each slide two windows are taken (pick_pair); of each, global
    crops, which teacher and student see with masks of their own, and local ones for the student alone. Every cell is one
    row: batch, slide_id, side (a or b), role, view_type, view, r0, c0, size, i, j, features, valid, masked. Draws depend on
    the epoch, the window and the view.
    """
    pairs = select.pick_pair(candidates)
    placed = lambda which, side: candidates.select("slide_id", F.col("roi_id").alias(which), F.col("grid_i").alias(f"{side}_i"), F.col("grid_j").alias(f"{side}_j"))
    both = pairs.join(placed("first", "a"), ["slide_id", "first"]).join(placed("second", "b"), ["slide_id", "second"])
    dealt = cut(views.batches(both.select("slide_id", "a_i", "a_j", "b_i", "b_j"), "slide_id", batch, epoch, seed), "pairs")
    window = cut(views.paired_windows(dealt, features, cells, r, tile_tissue).withColumn("roi", F.concat_ws("/", F.col("slide_id").cast("string"), "side")), "windows")
    rois = window.select("slide_id", "side", "roi").distinct()
    draw, out = f"{seed}:{epoch}", None
    for kind, size, n in (("global", sizes[0], counts[0]), ("local", sizes[1], counts[1])):
        if size > r:
            raise ValueError(f"a crop of {size} cells is larger than the window")
        crops = views.crop_cells(views.crop_positions(rois, "roi", r, r, size, n, kind, draw, corners=kind == "global"), "roi", size)
        met = crops.join(window.select("slide_id", "side", "roi", F.col("i").alias("grid_i"), F.col("j").alias("grid_j"), "features", "valid"), ["roi", "grid_i", "grid_j"])
        view = F.concat_ws("/", "roi", "view_type", F.col("view").cast("string"))
        changed = views.augmented(met, size, view, seed=draw, **changes)
        for role in ("teacher", "student"):
            if f"{role}_{kind}" in masked:
                key = F.concat_ws("/", view, F.lit(role), F.col("i").cast("string"), F.col("j").cast("string"))
                one = views.masked_cells(changed, key, masked[f"{role}_{kind}"], seed=draw).select("slide_id", "side", F.lit(role).alias("role"), "view_type", "view", "r0", "c0", F.lit(size).alias("size"), "i", "j", "features", "valid", "masked")
                out = one if out is None else out.unionByName(one)
    return out.join(dealt.select("slide_id", "batch"), "slide_id")


def encode_missing(windows: DataFrame, tiles: DataFrame, store: DataFrame, r: int, least_tissue: float, overwrite: bool = False) -> tuple[DataFrame, DataFrame]:
    """(tiles to encode now, statistics per slide) of an incremental run."""
    needed = needed_tiles(windows, tiles, r, least_tissue)
    return missing_tiles(needed, store, overwrite), encode_stats(needed, store)


# The collections that are curated by default, and the text columns in which null becomes UNKNOWN.
COLLECTIONS = ("tcga_brca", "tcga_luad", "tcga_lusc", "tcga_coad", "tcga_read", "tcga_prad", "tcga_kirc", "tcga_lihc", "tcga_hnsc")
DESCRIPTIONS = ["primaryAnatomicStructure_CodeMeaning", "primaryAnatomicStructureModifier_CodeMeaning", "staining_usingSubstance_CodeMeaning", "tissueFixative_CodeMeaning", "embeddingMedium_CodeMeaning", "illuminationType_CodeMeaning"]
SITE, STAIN, CODEC, COLLECTION = "primaryAnatomicStructure_CodeMeaning", "staining_usingSubstance_CodeMeaning", "base_TransferSyntaxUID", "collection_id_norm"


def series_table(index: DataFrame, attributes: DataFrame, instances: DataFrame, collections: list[str]) -> DataFrame:
    """One row per slide-microscopy series of the collections: its base image and the one nearest to x20."""
    series = index.join(attributes, "SeriesInstanceUID").where((F.col("Modality") == "SM") & F.col("series_aws_url").isNotNull())
    series = sc.unknown_filled(series.withColumn(COLLECTION, sc.normalised_name("collection_id")).where(F.col(COLLECTION).isin(collections)), DESCRIPTIONS)
    named = instances.select(
        "SeriesInstanceUID", "SOPInstanceUID", F.col("PixelSpacing_0").alias("PixelSpacing_mm"), F.col("TotalPixelMatrixColumns").alias("cols"), F.col("TotalPixelMatrixRows").alias("rows"),
        F.col("instance_size").alias("instance_bytes"), "TransferSyntaxUID", "ImageType",
    )
    x20 = sc.TARGET_SPACING["x20"]
    return curate.slide_table(named, series, "SeriesInstanceUID", "ImageType", "PixelSpacing_mm", "cols", "instance_bytes", x20, (0.00045, 0.00055))


def report(df: DataFrame, name: str) -> None:
    """A line on a step's rows, and its largest collections and sites."""
    all_, top = curate.totals(df, "series_size_MB").first(), lambda c, n: ", ".join(f"{r[c]} {r.n}" for r in curate.value_counts(df, c, n).collect())
    print(f"[{name}] slides={all_.n_rows:,} approx_series_GB={all_.total_gb or 0:,.2f}; collections: {top(COLLECTION, 20)}; sites: {top(SITE, 15)}")


def curate_job(spark: SparkSession, args: argparse.Namespace) -> None:
    """Index tables -> filtered, balanced manifest and its splits."""
    from gridloom import schemas

    tables = (readers.read_table(spark, p, s) for p, s in ((args.index, schemas.SERIES_INDEX), (args.attributes, schemas.SERIES_ATTRIBUTES), (args.instances, schemas.INSTANCE_INDEX)))
    listed = lambda text: [x.strip() for x in text.split(",") if x.strip()]
    table = cut(series_table(*tables, [c.lower().replace("-", "_") for c in listed(args.collections)]), "series")
    report(table, "raw")
    names = {"cols": "base_cols", "rows": "base_rows", "size_mb": "series_size_MB", "power": "ObjectiveLensPower", "spacing": "base_PixelSpacing_mm", "base_spacing": "base_PixelSpacing_mm", "has_x20": "has_x20_level", "syntax": CODEC}
    spacing = None if args.target == "none" else (sc.TARGET_SPACING[args.target], args.spacing_tol)
    limits = curate.QualityLimits(args.min_cols, args.min_rows, (args.min_series_mb, args.max_series_mb), (args.objective_min, args.objective_max), spacing, args.max_base_spacing_mm, args.require_x20_level, tuple(listed(args.allow_transfer_syntax)) or None)
    good = curate.quality_filters(table, limits, names, ("SeriesInstanceUID", "PatientID", "StudyInstanceUID", "base_SOPInstanceUID"))
    x20 = (F.col("x20_cols"), F.col("x20_rows")) if args.density_prefer_level == "x20_if_available" else None
    dense = curate.density(good, "series_size_MB", F.col("base_cols"), F.col("base_rows"), F.col("has_x20_level"), x20)
    keyed = cut(dense.withColumn("density_group", sc.density_key(args.density_group_by, site=SITE, codec=CODEC, collection=COLLECTION)), "quality")
    report(keyed, "quality_filtered")
    kept = curate.density_filter(keyed, args.density_filter, args.density_keep_top_quantile, "density_group", least=args.density_min_mb_per_mpix).drop("density_group", "pct")
    kept = cut(kept.withColumn("balance_group", sc.balance_key(args.balanced_by, collection=COLLECTION, site=SITE, stain=STAIN)), "dense")
    report(kept, "density_filtered")
    if args.one_slide_per_patient:
        chosen = curate.balanced_unique(kept, "balance_group", "PatientID", "SeriesInstanceUID", args.n_per_group, args.seed)
    else:
        chosen = curate.sample_per_group(kept, "balance_group", "SeriesInstanceUID", args.n_per_group, args.seed)
    manifest = cut(chosen.drop("balance_group"), "manifest")
    report(manifest, f"balanced({args.balanced_by})")
    sinks.write_manifest(manifest, args.out)
    if args.write_splits:
        parts = cut(curate.split_groups(manifest, "PatientID", args.test_size, args.val_size, args.seed), "splits")
        if not curate.leaks(parts, "PatientID").isEmpty():
            raise AssertionError("a patient is in two splits")
        for name in ("train", "val", "test"):
            sinks.write_manifest(parts.where(F.col("split") == name).drop("split"), f"{args.out}_{name}")


def thumbnail_level(dimensions: list[tuple[int, int]], downsamples: list[float], power: float | None, magnification: float, longest: int) -> int:
    """The level nearest to the magnification, but no larger than `longest` asks for; without a known power the largest within it."""
    import numpy as np

    if power:
        want = max(power / magnification, max(dimensions[0]) / longest if longest > 0 else 0.0)
        return int(np.abs(np.log(np.array(downsamples, float) / want)).argmin())
    within = [k for k, d in enumerate(dimensions) if max(d) <= longest]
    return max(within, key=lambda k: max(dimensions[k]), default=len(dimensions) - 1)


def thumbnails(slides: DataFrame, longest: int = 2048, openers: dict | None = None, magnification: float = 20.0) -> DataFrame:
    """(slide_id, width, height, level0_mpp, power, rows, cols, rgb) of slides (slide_id, slide_path).

    openers (ending -> function) go to the executors with the task; without, installed libraries read the slide. One
    slide's thumbnail is one row.
    """
    import numpy as np
    import pandas as pd

    def run(frames):
        for pdf in frames:
            for row in pdf.itertuples():
                with readers.opened_slide(row.slide_path, openers) as slide:
                    mpp = readers.spacing_of(slide.properties)
                    power = readers.power_of(slide.properties, mpp)
                    w, h = slide.level_dimensions[0]
                    level = thumbnail_level(slide.level_dimensions, slide.level_downsamples, power, magnification, longest)
                    lw, lh = slide.level_dimensions[level]
                    rgb = np.ascontiguousarray(np.asarray(slide.read_region((0, 0), level, (lw, lh)))[..., :3], np.uint8)
                    yield pd.DataFrame([(row.slide_id, w, h, mpp, power, lh, lw, rgb.tobytes())], columns=["slide_id", "width", "height", "level0_mpp", "power", "rows", "cols", "rgb"]).astype({"level0_mpp": float, "power": float})

    kind = slides.schema["slide_id"].dataType.simpleString()
    return slides.select("slide_id", "slide_path").mapInPandas(run, f"slide_id {kind}, width int, height int, level0_mpp double, power double, rows int, cols int, rgb binary")


def mask_pixels(masks: DataFrame) -> DataFrame:
    """(slide_id, y, x, flag) of packed masks (slide_id, height, width, tissue); for masks of a few pixels."""
    digit = F.conv(F.substring(F.hex("tissue"), (F.floor(F.col("p") / 4) + 1).cast("int"), F.lit(1)), 16, 10).cast("int")
    flat = masks.withColumn("p", F.explode(F.sequence(F.lit(0), F.col("height") * F.col("width") - 1)))
    flag = F.floor(digit / F.pow(F.lit(2), 3 - F.col("p") % 4)).cast("int") % 2 == 1
    return flat.select("slide_id", F.floor(F.col("p") / F.col("width")).cast("int").alias("y"), (F.col("p") % F.col("width")).cast("int").alias("x"), flag.alias("flag"))


def preprocess(slides: DataFrame, tile: int = 512, magnification: float = 20.0, least_tissue: float = 0.5, longest: int = 2048, kernel: int = 7, least_area: int = 512, openers: dict | None = None, segmenter=None, window: int | None = None, window_share: float = 0.5, window_tissue: float | None = None) -> tuple[DataFrame, DataFrame]:
    """(tiles, summary) of slides (slide_id, slide_path; level0_mpp where it is known): thumbnail, tissue, artifacts, judged tiles.

    segmenter makes the artifact model (operators.segment); without one no artifact is found. With a window, slides in which
    no window of that many tiles has enough of them with tissue are not segmented. A spacing in the slide's own properties
    comes before that of the slides table. The summary has a row for every slide; status is no_tissue where no tile is.
    """
    images = cut(thumbnails(slides, longest, openers, magnification), "thumbnails")
    masks = cut(grid.tissue_masks(images.select("slide_id", F.col("rows").alias("height"), F.col("cols").alias("width"), "rgb"), kernel, least_area), "tissue")
    given = slides.select("slide_id", F.col("level0_mpp").alias("given_mpp")) if "level0_mpp" in slides.columns else slides.select("slide_id", F.lit(None).cast("double").alias("given_mpp"))
    known = images.drop("rgb").join(given, "slide_id").withColumn("mpp", F.coalesce(sc.no_nan("level0_mpp"), "given_mpp"))
    known = known.select("slide_id", "width", "height", "mpp", sc.no_nan("power").alias("power"), (F.col("cols") / F.col("width")).alias("scale_x"), (F.col("rows") / F.col("height")).alias("scale_y"))
    shaped = cut(known.withColumn("tile", sc.base_tile_size(tile, F.col("mpp"), F.col("power"), magnification)), "shapes")
    extents = grid.tile_extent(shaped.join(grid.packed_box(masks), "slide_id"))
    cells = cut(grid.packed_fractions(grid.tiles_of(extents), masks, "tissue", "tissue_frac"), "cells")
    judged = cells.withColumn("artifact_frac", F.lit(0.0))
    if segmenter is not None:
        from gridloom.operators import segment

        todo = masks.join(shaped.select("slide_id", F.coalesce("mpp", F.lit(0.5)).alias("mpp")), "slide_id").join(slides.select("slide_id", "slide_path"), "slide_id")
        if window:
            at = least_tissue if window_tissue is None else window_tissue
            todo = todo.join(grid.viable(cells, window, at, window_share).where("viable"), "slide_id", "left_semi")
        found = cut(segment.artifact_masks(todo, segmenter, openers), "artifacts")
        artifacts = grid.packed_fractions(cells, found, "artifact", "artifact_frac").select("slide_id", "tile_id", "artifact_frac")
        judged = cells.join(artifacts, ["slide_id", "tile_id"], "left").withColumn("artifact_frac", F.coalesce("artifact_frac", F.lit(0.0)))
    tiles = cut(grid.judged_tiles(judged, least_tissue).drop("scale_x", "scale_y"), "tiles")
    summary = shaped.join(grid.grid_summary(tiles), "slide_id", "left")
    status = F.when(F.col("total_grid_tiles").isNull(), "no_tissue").otherwise("done")
    return tiles, summary.withColumn("status", status).fillna(0, ["total_grid_tiles", "accepted_count", "rejected_count", "rejected_low_tissue"])


def preprocess_job(spark: SparkSession, args: argparse.Namespace) -> None:
    """Slides under a root, or of a manifest -> tile manifests and summaries of those not done yet.

    Done are the slides of the summaries under the output, and of --done. A manifest's series are fetched by --fetch
    (module:function of the id and a folder) into a folder of the executor's own, or read at their slide_path.
    """
    openers = readers.named_openers(args.opener)
    if args.manifest:
        rows = spark.read.parquet(args.manifest)
        spacing = sc.micrometres("base_PixelSpacing_mm") if "base_PixelSpacing_mm" in rows.columns else F.lit(None).cast("double")
        path = F.col("slide_path") if "slide_path" in rows.columns else F.col("SeriesInstanceUID")
        records = rows.select(F.col("SeriesInstanceUID").alias("slide_id"), path.alias("slide_path"), spacing.alias("level0_mpp"))
        if args.fetch:
            openers = {"": readers.Fetched(readers.named(args.fetch), openers)}
    else:
        records = readers.slides(spark, slides_root=args.slides, output_root=args.out).select("slide_id", "slide_path")
    summaries = f"{args.out}/summary"
    for done in filter(None, (args.done, summaries if sinks.exists(spark, summaries) else None)):
        records = not_done(records, spark.read.parquet(done))
    records = cut(records, "to-do")
    segmenter = readers.named(args.segmenter)() if args.segmenter else None
    tiles, summary = preprocess(records, args.tile, args.magnification, args.min_tissue, args.longest, args.kernel, args.least_area, openers=openers, segmenter=segmenter, window=args.roi_size)
    sinks.write_tile_manifest(tiles, f"{args.out}/tiles")
    summary.write.mode("append").parquet(summaries)
    left = {r.status: r.n for r in summary.groupBy("status").agg(F.count("*").alias("n")).collect()}
    print(f"[preprocess] {', '.join(f'{k} {n}' for k, n in sorted(left.items())) or 'nothing to do'}")


def encode_job(spark: SparkSession, args: argparse.Namespace) -> None:
    """Tiles of the windows that were chosen -> cells that the feature store lacks, by the named encoder factory.

    What is missing is appended; only with --overwrite-features the cells of the windows are encoded again, and the buckets
    of their slides written anew.
    """
    from gridloom import schemas
    from gridloom.operators import encode

    tiles = readers.read_table(spark, args.tiles, schemas.TILE_MANIFEST)
    samples = spark.read.schema(schemas.ROI_SAMPLES).json(args.samples)
    windows = samples.select("slide_id", F.explode("passed_candidates").alias("c")).select("slide_id", "c.grid_i", "c.grid_j")
    known = sinks.exists(spark, args.out)
    store = readers.read_table(spark, args.out, schemas.FEATURE_GRID) if known else spark.createDataFrame([], schemas.FEATURE_GRID)
    todo, stats = encode_missing(windows, tiles, store, args.roi_size, args.tile_min_tissue, args.overwrite_features)
    stats = cut(stats, "encode-stats")
    make = readers.named(args.encoder)(args.width)
    paths = spark.read.parquet(args.slide_paths).select("slide_id", "slide_path")
    rows = todo.join(encode.unique_cells(tiles.select("slide_id", "grid_i", "grid_j", "x0_lvl0", "y0_lvl0")), ["slide_id", "grid_i", "grid_j"]).join(paths, "slide_id")
    new = cut(encode.stored_features(encode.encode_slides(rows, make, args.tile, args.width, args.batch_size, readers.named_openers(args.opener)), args.width), "encoded")
    if args.overwrite_features and known:
        sinks.replace_features(store, new, args.out)
    else:
        sinks.write_features(new, args.out)
    stats.write.mode("append").parquet(f"{args.out}_stats")
    print(f"[encode] {new.count()} cells")


def sample_job(spark: SparkSession, args: argparse.Namespace) -> None:
    """Grids and features -> samples of the slides that have none yet."""
    from gridloom import schemas

    cells = readers.read_table(spark, args.grid, schemas.QC_GRID)
    known = sinks.exists(spark, args.out) and not args.overwrite_samples
    if known:
        cells = not_done(cells, spark.read.schema(schemas.ROI_SAMPLES).json(args.out))
    features = readers.read_table(spark, args.features, schemas.FEATURE_GRID).where("valid").select("slide_id", "grid_i", "grid_j", "features") if args.features else None
    history = spark.read.parquet(args.history).select("slide_id", "grid_i", "grid_j", "embedding") if args.history else None
    gates = {
        "least_tissue": args.min_tissue_frac, "most_artifact": args.max_artifact_frac, "tile_tissue": args.tile_min_tissue, "valid_share": args.min_valid_frac, "cover": args.group_cover_min,
        "member_tissue": args.tile_min_tissue_group, "radius": args.merge_radius_tiles, "least_group": args.min_group_tiles_frac, "member_artifact": args.max_artifact_frac_for_group,
        "tissue_percentile": args.tissue_percentile, "artifact_percentile": args.artifact_percentile, "attempts": args.max_attempts,
    }
    found = cut(
        sample_rois(
            cells, features, args.roi_size, k=args.k, n=args.n_candidates, target=args.target_passed, width=args.width, history=history, method=args.method, nms=args.iou_threshold, most_history=args.iou_prev_max,
            alpha=args.novelty_alpha, eps=args.novelty_epsilon, seed=args.seed, spread=args.enforce_group_spread, tau=args.tau, **gates,
        ),
        "samples",
    )
    sinks.write_samples(found, args.roi_size, args.out, mode="append" if known else "overwrite")
    print(f"[sample] {found.select('slide_id').distinct().count()} slides sampled")


def option(p: argparse.ArgumentParser, name: str, **kind) -> None:
    """An option that may be spelt with dashes or underscores."""
    p.add_argument(f"--{name}", *([f"--{name.replace('-', '_')}"] if "-" in name else []), **kind)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="gridloom")
    sub = top.add_subparsers(dest="job", required=True)
    c = sub.add_parser("curate")
    for name in ("index", "attributes", "instances", "out"):
        c.add_argument(f"--{name}", required=True)
    option(c, "collections", default=",".join(COLLECTIONS))
    option(c, "balanced-by", choices=tuple(sc.BALANCE_GROUPS), default="collection_site")
    option(c, "n-per-group", type=int, default=250)
    option(c, "seed", type=int, default=0)
    option(c, "target", choices=("x40", "x20", "x10", "none"), default="none")
    option(c, "spacing-tol", type=float, default=0.00003)
    option(c, "max-base-spacing-mm", type=float, default=0.00055)
    option(c, "require-x20-level", action="store_true")
    option(c, "objective-min", type=float, default=35.0)
    option(c, "objective-max", type=float, default=45.0)
    option(c, "min-cols", type=int, default=20000)
    option(c, "min-rows", type=int, default=20000)
    option(c, "min-series-mb", type=float, default=30.0)
    option(c, "max-series-mb", type=float, default=1500.0)
    option(c, "allow-transfer-syntax", default="")
    option(c, "density-filter", choices=("none", "global_topq", "group_topq", "threshold"), default="none")
    option(c, "density-keep-top-quantile", type=float, default=1.0)
    option(c, "density-min-mb-per-mpix", type=float)
    option(c, "density-group-by", choices=tuple(sc.DENSITY_GROUPS), default="site_codec")
    option(c, "density-prefer-level", choices=("x20_if_available", "base_only"), default="x20_if_available")
    option(c, "one-slide-per-patient", action="store_true")
    option(c, "write-splits", action="store_true")
    option(c, "test-size", type=float, default=0.2)
    option(c, "val-size", type=float, default=0.1)
    s = sub.add_parser("sample")
    for name in ("grid", "out"):
        s.add_argument(f"--{name}", required=True)
    for name in ("features", "history"):
        option(s, name)
    option(s, "roi-size", type=int, default=16)
    option(s, "k", type=int, default=2)
    option(s, "n-candidates", type=int, default=128)
    option(s, "target-passed", type=int, default=64)
    option(s, "max-attempts", type=int)
    option(s, "min-tissue-frac", type=float, default=0.7)
    option(s, "max-artifact-frac", type=float, default=0.05)
    option(s, "tile-min-tissue", type=float, default=0.3)
    option(s, "min-valid-frac", type=float, default=0.5)
    option(s, "group-cover-min", type=float, default=0.8)
    option(s, "tile-min-tissue-group", type=float, default=0.2)
    option(s, "merge-radius-tiles", type=int, default=4)
    option(s, "min-group-tiles-frac", type=float, default=0.3)
    option(s, "max-artifact-frac-for-group", type=float, default=0.25)
    option(s, "tissue-percentile", type=float)
    option(s, "artifact-percentile", type=float)
    option(s, "method", choices=("fps", "kdpp"), default="fps")
    option(s, "tau", type=float)
    option(s, "iou-threshold", type=float, default=0.3)
    option(s, "iou-prev-max", type=float, default=0.6)
    option(s, "novelty-alpha", type=float, default=1.0)
    option(s, "novelty-epsilon", type=float, default=0.05)
    option(s, "enforce-group-spread", action="store_true")
    option(s, "width", type=int, default=768)
    option(s, "seed", type=int, default=0)
    option(s, "overwrite-samples", action="store_true")
    p = sub.add_parser("preprocess")
    for name in ("slides", "manifest", "done", "segmenter", "fetch"):
        option(p, name)
    p.add_argument("--out", required=True)
    p.add_argument("--opener", action="append", help="ending=module:function, a reader of slides")
    option(p, "tile", type=int, default=512)
    option(p, "magnification", type=float, default=20.0)
    option(p, "min-tissue", type=float, default=0.5)
    option(p, "longest", type=int, default=2048)
    option(p, "kernel", type=int, default=7)
    option(p, "least-area", type=int, default=512)
    option(p, "roi-size", type=int)
    e = sub.add_parser("encode")
    for name in ("tiles", "samples", "slide-paths", "out"):
        option(e, name, required=True)
    e.add_argument("--opener", action="append", help="ending=module:function, a reader of slides")
    option(e, "encoder", default="gridloom.operators.encode:stand_in_encoder")
    option(e, "roi-size", type=int, default=16)
    option(e, "tile", type=int, default=512)
    option(e, "width", type=int, default=768)
    option(e, "batch-size", type=int, default=32)
    option(e, "tile-min-tissue", type=float, default=0.3)
    option(e, "overwrite-features", action="store_true")
    return top


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName(f"gridloom {args.job}").getOrCreate()
    {"curate": curate_job, "preprocess": preprocess_job, "sample": sample_job, "encode": encode_job}[args.job](spark, args)


if __name__ == "__main__":
    main()
