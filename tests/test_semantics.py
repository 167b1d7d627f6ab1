"""Rounding, nulls, ties and empty inputs of the helpers and operators."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.functions import scalar as sc
from gridloom.operators import curate, encode, grid, groups, sampling, select, vectors, views
from gridloom.operators.grid import ellipse
from gridloom.sources import readers, sinks


def test_half_precision_equals_numpy(spark):
    x = np.r_[np.random.default_rng(0).random(5000), 0.0, 2.0**-24, 3e-6, 0.1, 1.0]
    got = spark.createDataFrame([(float(v),) for v in x], "x double").select("x", sc.to_half("x").alias("h")).toPandas()
    assert (got.h.to_numpy() == got.x.to_numpy().astype(np.float16).astype(float)).all()


def test_nan_is_dropped_by_bounds(spark):
    df = spark.createDataFrame([(1, float("nan")), (2, 0.5), (3, None)], "id int, base_spacing double")
    names = {"base_spacing": "base_spacing"}
    assert [r.id for r in curate.quality_filters(df, curate.QualityLimits(most_spacing=1.0), names).collect()] == [2]


def test_percent_rank_equals_pandas(spark):
    rng = np.random.default_rng(1)
    pdf = __import__("pandas").DataFrame({"id": range(500), "g": rng.integers(0, 4, 500), "v": rng.integers(0, 40, 500).astype(float)})
    df = spark.createDataFrame(pdf).repartition(7)
    got = curate.percent_rank(df, "v").toPandas().set_index("id").pct.sort_index()
    assert np.allclose(got, pdf.v.rank(pct=True))
    got = curate.percent_rank(df, "v", "g").toPandas().set_index("id").pct.sort_index()
    assert np.allclose(got, pdf.groupby("g").v.rank(pct=True))


def test_percent_rank_of_nothing_and_null_groups(spark):
    df = spark.createDataFrame([(1, None, None), (2, None, 3.0)], "id int, g string, v double")
    assert curate.percent_rank(df, "v", "g").count() == 0
    assert [r.pct for r in curate.percent_rank(df, "v").collect()] == [1.0]
    assert curate.percent_rank(df.limit(0), "v").count() == 0


def test_balanced_unique_equals_the_greedy_loop(spark):
    rng = np.random.default_rng(2)
    rows = [(i, f"g{rng.integers(0, 3)}", int(rng.integers(0, 30))) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, g string, p long").repartition(5)
    import hashlib

    taken, want = set(), set()
    for g in sorted({r[1] for r in rows}):
        picked = []
        for r in sorted((r for r in rows if r[1] == g), key=lambda r: hashlib.md5(f"{r[0]}:0".encode()).hexdigest()):
            if r[2] not in taken and len(picked) < 8:
                picked.append(r[0])
                taken.add(r[2])
        want |= set(picked)
    got = curate.balanced_unique(df, "g", "p", "id", 8).collect()
    assert {r.id for r in got} == want and len({r.p for r in got}) == len(got)


def test_split_is_disjoint_and_covers(spark):
    df = spark.range(300).select(F.col("id"), (F.col("id") % 100).alias("p"))
    parts = curate.split_groups(df, "p", 0.2, 0.1)
    assert curate.leaks(parts, "p").count() == 0 and parts.count() == 300
    assert dict(parts.select("p", "split").distinct().groupBy("split").count().collect()) == {"test": 20, "val": 8, "train": 72}
    assert curate.split_groups(df.limit(0), "p", 0.2, 0.1).count() == 0


def test_zero_area_has_no_density(spark):
    df = spark.createDataFrame([(1.0, 0, 5), (2.0, 2, 5)], "mb double, c int, r int")
    assert [r.mb_per_mpix for r in curate.density(df, "mb", F.col("c"), F.col("r")).orderBy("mb").collect()] == [None, 2.0 / 1e-5]


def test_group_mode_must_be_known():
    with pytest.raises(ValueError):
        sc.density_key("other", site="a")
    with pytest.raises(ValueError):
        sc.balance_key("site", site="a")


def cells(spark, a, slide="s"):
    return spark.createDataFrame([(slide, i, j, float(a[i, j])) for i in range(a.shape[0]) for j in range(a.shape[1])], "slide_id string, grid_i int, grid_j int, tissue_frac double").withColumn("artifact_frac", F.lit(0.0))


def test_box_sums_equal_numpy_and_small_grids_have_none(spark):
    a = np.random.default_rng(3).integers(0, 9, (6, 9)).astype(float)
    got = {(r.grid_i, r.grid_j): r.n for r in grid.box_sums(cells(spark, a), {"n": F.col("tissue_frac")}, 4).collect()}
    assert got == {(i, j): a[i : i + 4, j : j + 4].sum() for i in range(3) for j in range(6)}
    assert grid.box_sums(cells(spark, a), {"n": F.col("tissue_frac")}, 7).count() == 0
    assert [r.viable for r in grid.viable(cells(spark, a), 7, 0.0, 0.5).collect()] == [False]


def test_no_tissue_has_no_tiles(spark):
    from gridloom.plans.jobs import tile_grid

    mask = spark.createDataFrame([("s", 0, 0, False)], "slide_id string, y int, x int, flag boolean")
    slides = spark.createDataFrame([("s", 10, 10, 4, 0.5, 0.5)], "slide_id string, width int, height int, tile int, scale_x double, scale_y double")
    assert tile_grid(slides, mask, None, 0.5).count() == 0


def test_ellipse():
    assert len(ellipse(1)) == 5 and len(ellipse(0)) == 1
    assert {dx for dy, dx in ellipse(3) if dy == 0} == set(range(-3, 4))


def test_components_equal_a_flood(spark):
    a = np.random.default_rng(4).random((12, 15)) < 0.45
    label = groups.label_components(a)
    seen = np.full(a.shape, -1)
    for i, j in zip(*np.nonzero(a)):
        if seen[i, j] < 0:
            stack, name = [(i, j)], i * 15 + j
            while stack:
                y, x = stack.pop()
                if 0 <= y < 12 and 0 <= x < 15 and a[y, x] and seen[y, x] < 0:
                    seen[y, x] = name
                    stack += [(y + dy, x + dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1)]
    assert (label == seen).all()
    df = cells(spark, a.astype(float)).where("tissue_frac > 0").withColumn("n_cols", F.lit(15))
    got = {(r.grid_i, r.grid_j): r.component_id for r in groups.components(df).collect()}
    assert got == {(i, j): seen[i, j] for i, j in zip(*np.nonzero(a))}


def test_weighted_order_follows_weights(spark):
    rows = spark.range(2000).select(F.col("id").cast("string").alias("slide_id"), F.explode(F.array(F.lit(1), F.lit(9))).alias("w")).withColumn("grid_i", F.col("w")).withColumn("grid_j", F.lit(0))
    first = sampling.candidate_order(rows, F.col("w").cast("double"), F.concat_ws("/", "slide_id", F.col("w").cast("string"))).where("roi_id = 0")
    share = first.where("w = 9").count() / 2000
    assert abs(share - 0.9) < 0.03


def test_percentile_gate_clamps(spark):
    df = spark.createDataFrame([("a", float("nan"), 0.9), ("a", 0.4, 0.8), ("b", float("nan"), None)], "slide_id string, tissue_frac double, artifact_frac double")
    got = {r.slide_id: (r.tissue_thr, r.artifact_thr) for r in sampling.gate_thresholds(df, 0.7, 0.05, 50, 50).collect()}
    assert got == {"a": (0.4, 0.05), "b": (0.7, 0.05)}
    with pytest.raises(ValueError):
        sc.checked_percentile(101)


def test_farthest_points_and_selection():
    x = np.array([[0.0], [1.0], [5.0], [5.1]])
    assert select.farthest_points(x, np.array([1.0, 0.5, 0.5, 0.4]), 2) == [0, 2]
    assert select.farthest_points(x, np.zeros(4), 9, 1).__len__() == 4
    ij = np.array([[0, 0], [0, 1], [20, 20], [40, 0]])
    got = select.diverse(x, np.array([1.0, 0.9, 0.8, 0.1]), ij, np.array([0, 0, 1, 1]), np.zeros((0, 2)), 2, 16)
    assert len(got) == 2 and not {0, 1} <= set(got)
    assert select.diverse(x[:0], np.zeros(0), ij[:0], np.zeros(0), np.zeros((0, 2)), 2, 16) == []
    got = select.diverse(x, np.array([1.0, 0.9, 0.8, 0.1]), ij, np.array([0, 0, 1, 1]), np.array([[20, 20]]), 4, 16)
    assert 2 not in got


def test_groups_are_spread():
    x = np.array([[0.0], [9.0], [4.0]])
    ij = np.array([[0, 0], [0, 40], [40, 0]])
    got = select.diverse(x, np.array([1.0, 0.9, 0.1]), ij, np.array([3, 3, 5]), np.zeros((0, 2)), 2, 16)
    assert got == [0, 1]
    got = select.diverse(x, np.array([1.0, 0.9, 0.1]), ij, np.array([3, 3, 5]), np.zeros((0, 2)), 2, 16, spread=True)
    assert got == [0, 2]
    # fewer picks than asked for are spread, too
    got = select.diverse(x, np.array([1.0, 0.9, 0.1]), ij, np.array([3, 3, 5]), np.zeros((0, 2)), 3, 16, spread=True)
    assert sorted(got) == [0, 1, 2]


def test_determinantal_draw_has_k_different_items():
    x = np.random.default_rng(5).normal(size=(12, 3))
    k = select.kernel_matrix(x, np.ones(12), np.arange(24).reshape(12, 2), 4)
    for seed in range(5):
        assert len(set(select.determinantal(k, 4, seed))) == 4


def test_nms_output_does_not_overlap(spark):
    rng = np.random.default_rng(6)
    df = spark.createDataFrame([("s", int(a), int(b), float(c)) for a, b, c in zip(rng.integers(0, 30, 80), rng.integers(0, 30, 80), rng.random(80))], "slide_id string, grid_i int, grid_j int, q double")
    kept = select.overlap_free(df, 8, 0.3, F.struct((-F.col("q")).alias("q"), "grid_i", "grid_j")).collect()
    for n, a in enumerate(kept):
        for b in kept[:n]:
            assert select.iou((a.grid_i, a.grid_j), (b.grid_i, b.grid_j), 8) <= 0.3
    assert select.overlap_free(df, 8, 0, F.col("q")).count() == 80


def test_pooling_falls_back(spark):
    windows = spark.createDataFrame([("s", 0, 0, 0), ("s", 1, 5, 5)], "slide_id string, roi_id int, grid_i int, grid_j int")
    tiles = spark.createDataFrame([("s", 0, 0, 1.0, 1.0), ("s", 0, 1, 1.0, 1.0)], "slide_id string, grid_i int, grid_j int, tissue_frac double, artifact_frac double")
    feats = spark.createDataFrame([("s", 0, 0, [1.0, 2.0]), ("s", 0, 1, [3.0, 6.0])], "slide_id string, grid_i int, grid_j int, features array<double>")
    got = {r.roi_id: list(r.embedding) for r in vectors.window_embeddings(windows, tiles, feats, 2, 0.3, 2).collect()}
    assert got == {0: [2.0, 4.0], 1: [0.0, 0.0]}


def test_duplicate_tiles_and_bounds_are_errors(spark):
    t = spark.createDataFrame([("s", 0, 0), ("s", 0, 0)], "slide_id string, grid_i int, grid_j int")
    with pytest.raises(Exception, match="stands twice"):
        encode.unique_cells(t).collect()
    dims = spark.createDataFrame([("s", 1, 1)], "slide_id string, grid_h int, grid_w int")
    with pytest.raises(Exception, match="outside the grid"):
        encode.checked_bounds(t.withColumn("grid_j", F.lit(4)), dims).collect()
    with pytest.raises(Exception, match="must have 3"):
        encode.stored_features(t.withColumn("features", F.array(F.lit(1.0))), 3).collect()


def test_incremental_encoding_is_idempotent(spark):
    tiles = cells(spark, np.ones((6, 6)))
    windows = spark.createDataFrame([("s", 0, 0)], "slide_id string, grid_i int, grid_j int")
    need = encode.needed_tiles(windows, tiles, 4, 0.5)
    store = tiles.limit(0).select("slide_id", "grid_i", "grid_j", F.lit(True).alias("valid"))
    first = encode.missing_tiles(need, store)
    assert first.count() == 16
    again = first.withColumn("valid", F.lit(True))
    assert encode.missing_tiles(need, again).count() == 0 and encode.missing_tiles(need, again, overwrite=True).count() == 16


def test_encoding_from_slides(spark):
    a = np.zeros((8, 8, 3), np.uint8)
    a[4:, 4:] = 200
    tiles = spark.createDataFrame([("s", "x", 0, 0, 0, 0), ("s", "x", 1, 1, 4, 4), ("s", "x", 2, 2, 8, 8)], "slide_id string, slide_path string, grid_i int, grid_j int, x0_lvl0 int, y0_lvl0 int")
    got = {r.grid_i: r.features[0] for r in encode.encode_slides(tiles, encode.stand_in_encoder(2), 4, 2, openers={"": lambda p: readers.ArraySlide(a)}).collect()}
    assert got[0] == got[2] == 1.0 and math.isclose(got[1], math.cos(200), abs_tol=1e-6)


def test_legacy_manifests_without_types(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    pq.write_table(pa.table({"slide_id": ["a"], "tile_id": [1], "reject_reason": pa.nulls(1)}), tmp_path / "a.parquet")
    pq.write_table(pa.table({"slide_id": ["b"], "tile_id": [2], "reject_reason": ["low_tissue"]}), tmp_path / "b.parquet")
    got = readers.read_legacy_manifests(spark, [str(tmp_path / "a.parquet"), str(tmp_path / "b.parquet")]).orderBy("tile_id").collect()
    assert [r.reject_reason for r in got] == [None, "low_tissue"]


def test_slide_sources(spark, tmp_path):
    for name in ("a/One.SVS", "b/series/x.dcm", "b/series/y.DCM", "c/note.txt", "d/two_qc/preprocess_metadata.json"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("x")
    got = sorted(r.slide_id for r in readers.slides(spark, slides_root=str(tmp_path)).collect())
    assert got == ["One", "series"]
    assert [r.slide_id for r in readers.slides(spark, preprocess_root=str(tmp_path)).collect()] == ["two"]
    (tmp_path / "empty").mkdir()
    with pytest.raises(ValueError):
        readers.slides(spark)


def test_metadata_is_not_overridden(spark):
    df = spark.createDataFrame([("s", 1, {"n": "9", "m": "x"})], "slide_id string, n int, extra map<string,string>")
    import json

    assert json.loads(sinks.metadata_json(df).first().metadata) == {"slide_id": "s", "n": "1", "m": "x"}


def test_series_folders_are_removed(spark):
    import pandas as pd

    def fetch(uid, folder):
        with open(f"{folder}/f", "w") as f:
            f.write(uid)

    def work(folder, row):
        return pd.DataFrame({"uid": [row["SeriesInstanceUID"]], "folder": [folder]})

    got = readers.with_series(spark.createDataFrame([("u1",), ("u2",)], "SeriesInstanceUID string"), fetch, work, "uid string, folder string").collect()
    import os

    assert {r.uid for r in got} == {"u1", "u2"} and not any(os.path.exists(r.folder) for r in got)


def test_results_do_not_depend_on_partitions(spark):
    a = np.random.default_rng(8).random((12, 14))
    one, many = cells(spark, a).coalesce(1), cells(spark, a).repartition(9, "grid_j")
    run = lambda df: sampling.candidates_of(df, 3, 10, 6, least_tissue=0.4, radius=1, cover=0.5).orderBy("roi_id").collect()
    assert run(one) == run(many) and run(one)


def test_corner_crops_are_opposite(spark):
    got = views.crop_positions(spark.range(20), "id", 16, 16, 14, 2, "global", corners=True).groupBy("id").agg(F.sort_array(F.collect_list(F.struct("r0", "c0"))).alias("p")).collect()
    assert {tuple((x.r0, x.c0) for x in r.p) for r in got} == {((0, 0), (2, 2)), ((0, 2), (2, 0))}


def test_outputs_of_models_in_any_form():
    v = np.arange(6.0).reshape(2, 3)
    assert (encode.selected_output({"other": v * 0, "features": v}, 3) == v).all() and (encode.selected_output({"x": v}, 3) == v).all()
    assert (encode.selected_output((v, "rest"), 3) == v).all() and (encode.selected_output([v], 3) == v).all()
    tokens = np.stack([v, v + 1], axis=1)
    assert (encode.selected_output({"last_hidden_state": tokens}, 3) == v).all()
    with pytest.raises(ValueError):
        encode.selected_output(v, 4)


def test_tiles_as_bytes():
    assert encode.as_bytes_range(np.array([[0.0, 0.5, 1.0]])).tolist() == [[0, 127, 255]]
    assert encode.as_bytes_range(np.array([[0.0, 300.0, -4.0]])).tolist() == [[0, 255, 0]]
    assert encode.as_bytes_range(np.array([1], np.uint8)).dtype == np.uint8


def test_legend(spark):
    from gridloom.operators import views

    assert [r.class_id for r in views.legend(spark).collect()] == [1, 2, 3, 4, 5, 6, 7]
    only = views.legend(spark, artifacts_only=True).collect()
    assert [(r.class_id, r.name) for r in only][0] == (2, "Tissue fold") and len(only) == 5


def test_members_of_groups(spark):
    df = spark.createDataFrame([(1, 0.3, 0.1), (2, 0.1, 0.0), (3, 0.9, 0.3), (4, 0.9, None), (5, None, 0.0)], "id int, tissue_frac double, artifact_frac double")
    assert sorted(r.id for r in groups.member_cells(df, 0.2, 0.25).collect()) == [1, 4]


def test_percentiles_of_the_first_candidates(spark):
    a = np.random.default_rng(9).random((14, 14))
    run = lambda **k: sampling.candidates_of(cells(spark, a), 3, 50, 5, least_tissue=0.9, radius=1, cover=0.5, valid_share=0.1, **k)
    assert run().where("passed_qc").count() == 0
    relative = run(tissue_percentile=50.0)
    first = relative.where("roi_id < 32")
    assert first.count() == 32 and abs(first.where("passed_qc").count() - 16) <= 1


def test_unknown_and_keys(spark):
    df = spark.createDataFrame([("c", None, "x", None), ("c", "s", None, "t")], "collection string, site string, codec string, stain string")
    filled = sc.unknown_filled(df, ["site", "stain", "missing"])
    got = filled.select(sc.balance_key("collection_site_stain", collection="collection", site="site", stain="stain").alias("b"), sc.density_key("site_codec", site="site", codec="codec").alias("d")).collect()
    assert {(r.b, r.d) for r in got} == {("c||UNKNOWN||UNKNOWN", "UNKNOWN||x"), ("c||s||t", None)}
    assert df.select(sc.balance_key("collection_site", collection="collection", site="site").alias("b")).first().b == "c||None"


def test_buckets_of_values(spark):
    bounds = [0.5, 1.5, 2.5]
    got = {r.v: r.b for r in spark.createDataFrame([(x,) for x in (0.0, 0.5, 1.0, 1.5, 9.0)], "v double").select("v", sc.bucket_of(F.col("v"), bounds).alias("b")).collect()}
    assert got == {0.0: 0, 0.5: 0, 1.0: 1, 1.5: 1, 9.0: 3}


def test_ranks_over_many_buckets(spark, monkeypatch):
    rng = np.random.default_rng(10)
    pdf = __import__("pandas").DataFrame({"id": range(900), "g": rng.choice(["a", "b", "b", "b"], 900), "v": np.round(rng.normal(size=900), 2)})
    monkeypatch.setattr(curate, "BUCKET_ROWS", 40)
    df = spark.createDataFrame(pdf).repartition(5)
    assert np.allclose(curate.percent_rank(df, "v").toPandas().set_index("id").pct.sort_index(), pdf.v.rank(pct=True))
    assert np.allclose(curate.percent_rank(df, "v", "g").toPandas().set_index("id").pct.sort_index(), pdf.groupby("g").v.rank(pct=True))
    placed, total = curate.hash_positions(df.select("id"), "id", 3)
    import hashlib

    order = sorted(range(900), key=lambda i: (hashlib.md5(f"{i}:3".encode()).hexdigest(), i))
    assert total == 900 and {r.id: r.position for r in placed.collect()} == {i: k for k, i in enumerate(order)}


def test_readers_by_ending():
    readers.register_opener(".Zzz", lambda p: ("registered", p))
    assert readers.open_slide("a/b.ZZZ") == ("registered", "a/b.ZZZ")
    assert readers.open_slide("a/b.zzz", {"zz": lambda p: "short", "b.zzz": lambda p: "given"}) == "given"
    assert readers.named_openers([".x=os.path:basename"])[".x"]("a/b.x") == "b.x"
    with pytest.raises(ValueError, match="no reader"):
        readers.open_slide("a/b.unknown.txt")


def test_largest_level_within(spark):
    df = spark.createDataFrame([([8000, 2000, 500], [4000, 1000, 250])], "w array<int>, h array<int>")
    at = lambda most: df.select(sc.level_within(F.col("w"), F.col("h"), most).alias("i")).first().i
    assert (at(2048), at(9000), at(100)) == (1, 0, 2)
