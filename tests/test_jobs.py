"""Jobs over folders of files, end to end."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.operators import encode, grid, segment
from gridloom.plans import jobs
from gridloom.sources import readers


def image(tissue: bool) -> np.ndarray:
    rgb = np.full((96, 128, 3), 240, np.uint8)
    if tissue:
        rgb[24:72, 32:96] = (120, 40, 120)
    return rgb


@pytest.fixture
def slides(spark, tmp_path):
    for name, tissue in (("one", True), ("two", False)):
        (tmp_path / "in").mkdir(exist_ok=True)
        np.save(tmp_path / "in" / f"{name}.npy", image(tissue))
    return tmp_path


def opener(path):
    return readers.ArraySlide(np.load(path.removeprefix("file:")), (1, 2, 4), {"openslide.mpp-x": "0.5", "openslide.mpp-y": "0.5", "openslide.objective-power": "20"})


def test_preprocessing(spark, slides):
    folder = str(slides / "in")
    records = spark.createDataFrame([("one", f"{folder}/one.npy"), ("two", f"{folder}/two.npy")], "slide_id string, slide_path string")

    tiles, summary = jobs.preprocess(records, tile=16, longest=64, kernel=3, least_area=4, openers={".npy": opener})
    by = {r.slide_id: r for r in summary.collect()}
    assert by["one"].status == "done" and by["two"].status == "no_tissue"
    rows = tiles.collect()
    assert by["one"].total_grid_tiles == len(rows) and sum(not r.rejected for r in rows) == by["one"].accepted_count > 0
    full = [r for r in rows if r.x0_lvl0 >= 48 and r.x1_lvl0 <= 80 and r.y0_lvl0 >= 32 and r.y1_lvl0 <= 64]
    assert full and all(r.tissue_frac == 1.0 for r in full)


def test_packed_masks(spark):
    m = np.random.default_rng(0).random((5, 7)) < 0.5
    df = spark.createDataFrame([("s", 5, 7, np.packbits(m).tobytes())], "slide_id string, height int, width int, tissue binary")
    got = {(r.y, r.x): r.flag for r in jobs.mask_pixels(df).collect()}
    assert got == {(y, x): bool(m[y, x]) for y in range(5) for x in range(7)}


def test_tissue_mask_finds_the_dark_part():
    mask = grid.tissue_mask_array(image(True), 3, 4)
    assert mask[30:66, 40:90].all() and not mask[:16].any() and not mask[:, 110:].any()


def test_command_line_curates(spark, tmp_path):
    n = 60
    ids = [f"s{i}" for i in range(n)]
    index = spark.createDataFrame([("tcga-x", "d", "l", f"p{i % 20}", "st", s, 100.0 + i, "u", "b", "c", "SM") for i, s in enumerate(ids)], "collection_id string, source_DOI string, license_short_name string, PatientID string, StudyInstanceUID string, SeriesInstanceUID string, series_size_MB double, series_aws_url string, aws_bucket string, crdc_series_uuid string, Modality string")
    attributes = spark.createDataFrame([(s, 0.25, 30000, 30000, 40.0, "lung", None, "he" if i % 2 else None, "f", "m", "i") for i, s in enumerate(ids)], "SeriesInstanceUID string, min_PixelSpacing_2sf double, max_TotalPixelMatrixColumns bigint, max_TotalPixelMatrixRows bigint, ObjectiveLensPower double, primaryAnatomicStructure_CodeMeaning string, primaryAnatomicStructureModifier_CodeMeaning string, staining_usingSubstance_CodeMeaning string, tissueFixative_CodeMeaning string, embeddingMedium_CodeMeaning string, illuminationType_CodeMeaning string")
    instances = spark.createDataFrame([(s, f"{s}.{k}", 0.00025 * 2**k, 40000 >> k, 40000 >> k, 1000, "1.2", ["ORIGINAL", "VOLUME"]) for s in ids for k in range(3)], "SeriesInstanceUID string, SOPInstanceUID string, PixelSpacing_0 double, TotalPixelMatrixColumns bigint, TotalPixelMatrixRows bigint, instance_size bigint, TransferSyntaxUID string, ImageType array<string>")
    for name, df in (("index", index), ("attributes", attributes), ("instances", instances)):
        df.write.parquet(str(tmp_path / name))
    base = ["curate", "--index", str(tmp_path / "index"), "--attributes", str(tmp_path / "attributes"), "--instances", str(tmp_path / "instances"), "--collections", "TCGA-X"]
    jobs.curate_job(spark, jobs.parser().parse_args([*base, "--out", str(tmp_path / "m"), "--one-slide-per-patient", "--write_splits"]))
    got = spark.read.parquet(f"{tmp_path}/m.parquet")
    assert got.count() == 20 and got.select("PatientID").distinct().count() == 20 and got.where(F.col("x20_PixelSpacing_mm") == 0.0005).count() == 20
    assert {"base_SOPInstanceUID", "base_cols", "base_rows", "base_instance_bytes", "base_TransferSyntaxUID", "x20_SOPInstanceUID", "has_x20_level", "mb_per_mpix"} <= set(got.columns)
    assert {r.primaryAnatomicStructureModifier_CodeMeaning for r in got.collect()} == {"UNKNOWN"}
    assert [spark.read.parquet(f"{tmp_path}/m_{s}.parquet").count() for s in ("train", "val", "test")] == [14, 2, 4]
    assert spark.read.json(f"{tmp_path}/m.jsonl").count() == 20

    def count(*options):
        jobs.curate_job(spark, jobs.parser().parse_args([*base, "--out", str(tmp_path / "n"), *options]))
        return spark.read.parquet(f"{tmp_path}/n.parquet")

    # without one slide for each patient, groups by stain, ranked by density within another key
    assert count().count() == n
    assert count("--balanced-by", "collection_site_stain", "--n-per-group", "7").count() == 7 * 2
    few = count("--density-filter", "group_topq", "--density-keep-top-quantile", "0.5", "--density-group-by", "site", "--balanced-by", "collection")
    assert few.count() == n // 2 + 1 and few.agg(F.min("series_size_MB")).first()[0] == 100.0 + n // 2 - 1
    assert count("--density-filter", "threshold", "--density-min-mb-per-mpix", "0.35").count() == sum((100.0 + i) / 400 >= 0.35 for i in range(n))
    assert count("--density-prefer-level", "base_only", "--density-filter", "threshold", "--density-min-mb-per-mpix", "0.35").count() == 0
    assert count("--objective-min", "41").count() == 0 and count("--allow-transfer-syntax", "9.9, 1.2").count() == n and count("--allow-transfer-syntax", "9.9").count() == 0
    assert count("--target", "x40").count() == n and count("--target", "x20").count() == 0 and count("--require-x20-level").count() == n
    assert count("--min-series-mb", "120", "--max-series-mb", "130").count() == 11


def write_slides(folder):
    folder.mkdir()
    for name, shift in (("one", 0), ("two", 24), ("empty", None)):
        rgb = np.full((96, 128, 3), 240, np.uint8)
        if shift is not None:
            rgb[8:72, 8 + shift : 88 + shift] = (120, 40, 120)
            rgb[40:72, 8 + shift : 40 + shift] = (30, 160, 30)  # what the stand-in segmenter calls an artifact
        np.save(folder / f"{name}.npy", rgb)


def test_command_line_from_slides_to_features(spark, tmp_path):
    """preprocess, sample and encode, each run twice: the second time nothing is left to do."""
    write_slides(tmp_path / "in")
    manifest = [(name, f"{tmp_path}/in/{name}.npy", 0.0005) for name in ("one", "two", "empty")]
    spark.createDataFrame(manifest, "SeriesInstanceUID string, slide_path string, base_PixelSpacing_mm double").write.parquet(f"{tmp_path}/m.parquet")
    opener = f".npy={__name__}:plain_opener"
    args = ["preprocess", "--manifest", f"{tmp_path}/m.parquet", "--out", f"{tmp_path}/out", "--tile", "8", "--longest", "128", "--kernel", "3", "--least-area", "4", "--opener", opener, "--segmenter", f"{__name__}:segmenter"]
    for _ in range(2):
        jobs.preprocess_job(spark, jobs.parser().parse_args(args))
    summary = {r.slide_id: r for r in spark.read.parquet(f"{tmp_path}/out/summary").collect()}
    assert len(summary) == 3 and summary["empty"].status == "no_tissue" and spark.read.parquet(f"{tmp_path}/out/summary").count() == 3
    assert summary["one"].mpp == 0.5  # from the manifest: the slides have no spacing of their own
    from gridloom import schemas

    tiles = readers.read_table(spark, f"{tmp_path}/out/tiles", schemas.TILE_MANIFEST)
    assert tiles.where("artifact_frac > 0.9").count() > 4 and tiles.where("tissue_frac > 0.9 and artifact_frac = 0").count() > 10
    tiles.select("slide_id", "grid_i", "grid_j", F.col("tissue_frac").cast("float").alias("tissue_frac"), F.col("artifact_frac").cast("float").alias("artifact_frac")).write.parquet(f"{tmp_path}/grid")

    common = ["--roi-size", "3", "--width", "4"]
    sample = ["sample", "--grid", f"{tmp_path}/grid", *common, "--merge-radius-tiles", "1", "--min-tissue-frac", "0.6", "--group-cover-min", "0.6", "--target-passed", "6"]
    jobs.sample_job(spark, jobs.parser().parse_args([*sample, "--out", f"{tmp_path}/first", "--k", "0"]))
    spark.createDataFrame([(n, p) for n, p, _ in manifest], "slide_id string, slide_path string").write.parquet(f"{tmp_path}/paths")
    encode = ["encode", "--tiles", f"{tmp_path}/out/tiles", "--samples", f"{tmp_path}/first", "--slide-paths", f"{tmp_path}/paths", "--out", f"{tmp_path}/features", "--tile", "8", "--opener", opener, *common]
    counts = []
    for options in ([], [], ["--overwrite-features"]):
        jobs.encode_job(spark, jobs.parser().parse_args([*encode, *options]))
        cells = readers.read_table(spark, f"{tmp_path}/features", schemas.FEATURE_GRID)
        counts.append((cells.count(), cells.select("slide_id", "grid_i", "grid_j").distinct().count()))
    assert counts[0][0] > 10 and len(set(counts)) == 1 and counts[0][0] == counts[0][1]

    chosen = [*sample, "--features", f"{tmp_path}/features", "--out", f"{tmp_path}/samples", "--k", "2", "--enforce-group-spread", "--iou-threshold", "0.5"]
    for _ in range(2):
        jobs.sample_job(spark, jobs.parser().parse_args(chosen))
    got = spark.read.schema(schemas.ROI_SAMPLES).json(f"{tmp_path}/samples").collect()
    assert sorted(r.slide_id for r in got) == ["one", "two"] and all(len(r.selected_candidates) == 2 and 2 <= len(r.passed_candidates) for r in got)
    strict = [*sample, "--out", f"{tmp_path}/strict", "--k", "0", "--max-artifact-frac", "0.0001", "--tissue-percentile", "50"]
    jobs.sample_job(spark, jobs.parser().parse_args(strict))
    assert all(c.artifact_frac <= 0.0001 for r in spark.read.schema(schemas.ROI_SAMPLES).json(f"{tmp_path}/strict").collect() for c in r.passed_candidates)


def plain_opener(path):
    return readers.ArraySlide(np.load(readers.local_path(path)))


def segmenter():
    return segment.stand_in_segmenter()


def test_sparse_slides_are_not_segmented(spark, tmp_path):
    write_slides(tmp_path / "in")
    records = spark.createDataFrame([(n, f"{tmp_path}/in/{n}.npy") for n in ("one", "empty")], "slide_id string, slide_path string")
    run = lambda window: jobs.preprocess(records, tile=8, longest=128, kernel=3, least_area=4, segmenter=segment.stand_in_segmenter(), window=window)[0].agg(F.max("artifact_frac")).first()[0]
    assert run(4) == 1.0 and run(12) == 0.0


class Series:
    """What a series library opens: levels with data sets, a spacing, regions at a level's own places."""

    def __init__(self, pixels):
        self.pixels, self.closed = pixels, False
        size = lambda d: type("D", (), {"TotalPixelMatrixColumns": pixels.shape[1] // d, "TotalPixelMatrixRows": pixels.shape[0] // d, "PixelSpacing": ["0.0005", "0.00025"], "ObjectiveLensPower": "20"})()
        self.levels = [type("L", (), {"level": k, "datasets": [size(d)]})() for k, d in ((0, 1), (2, 4))]

    def read_region(self, at, level, size):
        d = 2**level
        assert at[0] >= 0 and at[1] >= 0 and at[0] + size[0] <= self.pixels.shape[1] // d
        return self.pixels[::d, ::d][at[1] : at[1] + size[1], at[0] : at[0] + size[0]]

    def close(self):
        self.closed = True


def test_series_are_read_like_files(tmp_path):
    pixels = np.arange(32 * 48 * 3, dtype=np.uint32).reshape(32, 48, 3).astype(np.uint8)
    series = Series(pixels)
    slide = readers.SeriesSlide.of(series)
    assert slide.level_dimensions == [(48, 32), (12, 8)] and slide.level_downsamples == [1.0, 4.0]
    assert readers.spacing_of(slide.properties) == (0.5 + 0.25) / 2 and readers.power_of(slide.properties, None) == 20.0
    assert (slide.read_region((8, 4), 1, (3, 2)) == pixels[::4, ::4][1:3, 2:5]).all()
    edge = slide.read_region((-4, 24), 1, (4, 4))
    assert (edge[:2, 1:] == pixels[::4, ::4][6:8, :3]).all() and not edge[2:].any() and not edge[:, 0].any()
    assert not slide.read_region((400, 0), 0, (2, 2)).any()
    slide.close()
    assert series.closed
    point = type("P", (), {"height": 0.001, "width": 0.002})()
    assert readers.pair_of(point) == (0.001, 0.002) and readers.pair_of(None) is None and readers.pair_of(["x", 1]) is None
    assert readers.spacing_of({"openslide.mpp-x": "bad"}) is None and readers.power_of({"aperio.AppMag": "0"}, 0.5) == 20.0
    with pytest.raises(ValueError):
        slide.read_region((0, 0), 0, (0, 2))


def test_fetched_series_are_removed(tmp_path):
    import os

    seen = []

    def fetch(uid, folder):
        np.save(f"{folder}/x.npy", np.zeros((4, 4, 3), np.uint8))
        seen.append(folder)

    with readers.opened_slide("uid", {"": readers.Fetched(fetch, {"": lambda p: readers.ArraySlide(np.load(f"{p}/x.npy"))})}) as slide:
        assert os.path.exists(seen[0]) and slide.level_dimensions == [(4, 4)]
    assert not os.path.exists(seen[0])
    with pytest.raises(RuntimeError):
        readers.Fetched(fetch, {"": failing_opener})("uid")
    assert not os.path.exists(seen[1])


def failing_opener(path):
    raise RuntimeError(path)


def test_class_map_equals_a_plain_loop():
    """One model call for each patch of an image at the model's own resolution, stitched pixel by pixel."""
    rng = np.random.default_rng(5)
    pixels = rng.integers(0, 255, (60, 90, 3)).astype(np.uint8)
    tissue = np.zeros((30, 45), bool)
    tissue[4:22, 6:40] = True
    tissue[8:16, 16:24] = False  # a whole patch
    calls = []

    def model(x):
        calls.append(len(x))
        return (x[..., 0].astype(int) // 32) % 8  # labels 0 to 7

    got, total, read = segment.class_map(readers.ArraySlide(pixels), tissue, 1.5, model, patch=16, least=20, batch=3)
    want = np.full((60, 90), 7)
    inside = tissue.repeat(2, 0).repeat(2, 1)
    for y in range(0, 60, 16):
        for x in range(0, 90, 16):
            if inside[y : y + 16, x : x + 16].sum() > 20:
                patch = np.zeros((16, 16, 3), np.uint8)
                part = pixels[y : y + 16, x : x + 16]
                patch[: part.shape[0], : part.shape[1]] = part
                label = model(patch[None])[0]
                label = label + (label.min() == 0 and label.max() == 6)
                label = label[: part.shape[0], : part.shape[1]]
                want[y : y + 16, x : x + 16] = np.where(inside[y : y + 16, x : x + 16] & (label > 0), label, 7)
    index = lambda n: np.clip(((np.arange(n) + 0.5) * 2 - 0.5).astype(int), 0, 2 * n - 1)
    assert (got == want[np.ix_(index(30), index(45))]).all() and 0 < read < total
    assert max(calls) <= 3
    empty, total, read = segment.class_map(readers.ArraySlide(pixels), np.zeros((30, 45), bool), 1.5, model)
    assert (empty == 7).all() and (total, read) == (0, 0)


def test_scores_and_shifts_of_labels():
    scores = np.zeros((1, 8, 2, 2))
    scores[0, 3] = 1
    assert (segment.labels_of(scores) == 3).all() and (segment.labels_of((scores, "x")) == 3).all()
    zero_to_six = np.array([[[0, 6], [2, 3]], [[1, 6], [2, 3]]])
    assert segment.labels_of(zero_to_six).tolist() == [[[1, 7], [3, 4]], [[1, 6], [2, 3]]]
    mask, classes = segment.thumbnail_map(np.full((10, 20, 3), (0, 200, 0), np.uint8), np.ones((10, 20), bool), segment.stand_in_segmenter()(), 4)
    assert mask.all() and mask.shape == (10, 20) and (classes == 3).all()
    assert (segment.resized(np.arange(16).reshape(4, 4, 1).repeat(3, 2).astype(np.uint8), 2)[..., 0] == np.floor(np.array([[2.5, 4.5], [10.5, 12.5]]) + 0.5)).all()


def test_thumbnail_levels():
    dims, down = [(8000, 4000), (2000, 1000), (500, 250)], [1, 4, 16]
    assert jobs.thumbnail_level(dims, down, 40.0, 20.0, 2048) == 1 and jobs.thumbnail_level(dims, down, 40.0, 2.0, 2048) == 2
    assert jobs.thumbnail_level(dims, down, None, 20.0, 2048) == 1 and jobs.thumbnail_level(dims, down, None, 20.0, 100) == 2


def test_transform_of_tiles():
    x = np.full((2, 8, 12, 3), 255, np.uint8)
    x[:, :, :6] = 0
    got = encode.prepared(x, 4)
    assert got.shape == (2, 3, 4, 4) and np.allclose(got[0, 0, 0, -1], (1 - 0.485) / 0.229) and np.allclose(got[0, 2, 0, 0], -0.406 / 0.225)
    assert encode.prepared(x[:, :4], 8).shape == (2, 3, 8, 8)


def test_progress_is_told(spark, tmp_path):
    tiles = spark.createDataFrame([("s", "x", i, 0, 0, 0) for i in range(5)], "slide_id string, slide_path string, grid_i int, grid_j int, x0_lvl0 int, y0_lvl0 int")
    log = str(tmp_path / "log")

    def progress(slide, n):
        with open(log, "a") as f:
            f.write(f"{slide} {n}\n")

    encode.encode_slides(tiles, encode.stand_in_encoder(2), 4, 2, 2, {"": lambda p: readers.ArraySlide(np.zeros((4, 4, 3), np.uint8))}, progress=progress).count()
    with open(log) as f:
        assert sum(int(line.split()[1]) for line in f) == 5
