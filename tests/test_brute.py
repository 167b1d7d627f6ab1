"""Operators that SQL cannot express, against plain numpy or Python over all rows."""

import hashlib
import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.catalog import fixtures as fx
from gridloom.catalog import queries
from gridloom.operators import grid, sampling, select, vectors, views
from gridloom.plans import jobs

SF = "/root/testdata/sf0.001"


# ---------------------------------------------------------------- masks


def reference_mask(rgb, kernel, least):
    """Tissue by loops over pixels: blur, two thresholds, opening, closing, areas."""
    h, w = rgb.shape[:2]
    grey = np.floor(rgb @ np.array([0.299, 0.587, 0.114]) + 0.5)
    top, low = rgb.max(-1).astype(float), rgb.min(-1).astype(float)
    sat = np.floor(np.where(top > 0, (top - low) * 255 / np.where(top > 0, top, 1), 0) + 0.5)

    def mirror(i, n):
        while not 0 <= i < n:
            i = -i if i < 0 else 2 * (n - 1) - i
        return i if n > 1 else 0

    def blur(a):
        taps = [math.exp(-(k**2) / 2) for k in range(-3, 4)]
        taps = [t / sum(taps) for t in taps]
        out = np.array([[sum(taps[k + 3] * a[mirror(y + k, h) if h > 1 else 0, x] for k in range(-3, 4)) for x in range(w)] for y in range(h)])
        return np.array([[math.floor(sum(taps[k + 3] * out[y, mirror(x + k, w) if w > 1 else 0] for k in range(-3, 4)) + 0.5) for x in range(w)] for y in range(h)])

    def otsu(a):
        best, at = -1.0, 0
        for t in range(256):
            below, above = a[a <= t], a[a > t]
            spread = len(below) * len(above) * (below.mean() - above.mean()) ** 2 if len(below) and len(above) else 0.0
            if spread > best * (1 + 1e-12):
                best, at = spread, t
        return at

    grey, sat = blur(grey), blur(sat)
    m = (grey < otsu(grey)) | (sat > otsu(sat))
    offsets = grid.ellipse(kernel // 2)

    def over(m, all_):
        out = np.zeros_like(m)
        for y, x in itertools.product(range(h), range(w)):
            seen = [m[y + dy, x + dx] for dy, dx in offsets if 0 <= y + dy < h and 0 <= x + dx < w]
            out[y, x] = all(seen) if all_ else any(seen)
        return out

    m = over(over(over(over(m, True), False), False), True)
    done = np.zeros_like(m)
    for y, x in zip(*np.nonzero(m)):
        if not done[y, x]:
            stack, part = [(y, x)], set()
            while stack:
                i, j = stack.pop()
                if 0 <= i < h and 0 <= j < w and m[i, j] and (i, j) not in part:
                    part.add((i, j))
                    stack += [(i + a, j + b) for a in (-1, 0, 1) for b in (-1, 0, 1)]
            for i, j in part:
                done[i, j] = True
                if len(part) < least:
                    m[i, j] = False
    return m


def test_tissue_masks_with_tissue_at_the_border():
    rng = np.random.default_rng(0)
    for k, (h, w) in enumerate([(24, 30), (17, 13), (9, 40)]):
        rgb = np.full((h, w, 3), 235, np.uint8)
        rgb[: h // 2, : w // 3] = (140, 60, 140)  # reaches the corner
        rgb[h - 3 :, w - 5 :] = (90, 90, 95)
        rgb = np.clip(rgb + rng.integers(-12, 13, rgb.shape), 0, 255).astype(np.uint8)
        for kernel, least in ((3, 4), (5, 9)):
            got = grid.tissue_mask_array(rgb, kernel, least)
            assert (got == reference_mask(rgb, kernel, least)).all() and got[0, 0], (k, kernel)


def test_tissue_masks_query(spark):
    images = {r.slide_id: np.frombuffer(bytes(r.rgb), np.uint8).reshape(r.height, r.width, 3) for r in queries._images(spark, SF).collect()}
    got = {r.slide_id: grid.unpacked(bytes(r.tissue), r.height, r.width) for r in queries.QUERIES["tissue_masks"](spark, SF).collect()}
    assert set(got) == set(images) and all((got[s] == reference_mask(images[s], 3, 4)).all() for s in got)


def test_two_level_thumbnail_is_cut_below_the_threshold():
    rgb = np.full((20, 20, 3), 200, np.uint8)
    rgb[:, :10] = 100
    assert not grid.tissue_mask_array(rgb, 3, 1)[:, 13:].any()


def test_morphology_at_the_border(spark):
    full = spark.createDataFrame([("s", i, j) for i in range(6) for j in range(6)], "slide_id string, grid_i int, grid_j int")
    dims = spark.createDataFrame([("s", 6, 6)], "slide_id string, n_rows int, n_cols int")
    assert grid.eroded(full, 1, dims).count() == grid.opened(full, 1, dims).count() == grid.closed(full, 1, dims).count() == 36
    assert grid.eroded(full, 1).count() == 16  # a grid without an end
    rng = np.random.default_rng(1)
    m = rng.random((11, 8)) < 0.6
    cells = spark.createDataFrame([("s", int(i), int(j)) for i, j in zip(*np.nonzero(m))], "slide_id string, grid_i int, grid_j int")
    dims = spark.createDataFrame([("s", 11, 8)], "slide_id string, n_rows int, n_cols int")

    def over(m, all_):
        return np.array([[(all if all_ else any)(m[y + dy, x + dx] for dy, dx in grid.ellipse(2) if 0 <= y + dy < 11 and 0 <= x + dx < 8) for x in range(8)] for y in range(11)])

    for name, first in (("opened", True), ("closed", False)):
        want = over(over(m, first), not first)
        got = {(r.grid_i, r.grid_j) for r in getattr(grid, name)(cells, 2, dims).collect()}
        assert got == {(int(i), int(j)) for i, j in zip(*np.nonzero(want))}


# ---------------------------------------------------------------- choosing


def greedy(x, q, ij, group, k, size, nms=0.3, spread=False):
    """Quality-weighted farthest points, overlaps removed, filled up by quality: plain Python."""
    n = len(x)
    far = lambda a, b: sum((u - v) ** 2 for u, v in zip(x[a], x[b]))
    top = [i for i in range(n) if q[i] == max(q)]
    order = [min(top, key=lambda i: hashlib.md5(f"{i}:0".encode()).hexdigest())]
    if n <= k:
        order = list(range(n))
    while len(order) < min(k, n):
        order.append(max((i for i in range(n) if i not in order), key=lambda i: (min(far(i, j) for j in order) * q[i], -i)))

    def iou(a, b):
        inter = max(0, size - abs(ij[a][0] - ij[b][0])) * max(0, size - abs(ij[a][1] - ij[b][1]))
        return inter / (2 * size * size - inter)

    kept = []
    for i in order:
        if all(iou(i, j) <= nms for j in kept):
            kept.append(i)
    best = sorted(range(n), key=lambda i: -q[i])
    for i in best:
        if len(kept) < k and i not in kept and all(iou(i, j) <= nms for j in kept):
            kept.append(i)
    if spread and len(kept) >= 2 and len({group[i] for i in kept}) == 1:
        weakest = min(kept, key=lambda i: q[i])
        rest = [i for i in kept if i != weakest]
        for i in best:
            if i not in kept and group[i] != group[kept[0]] and all(iou(i, j) <= nms for j in rest):
                return [*rest, i]
    return kept


@pytest.mark.parametrize("spread", [False, True])
def test_diverse_select(spark, spread):
    p = queries._points(spark, SF).withColumn("group_id", F.col("roi_id") % 3)
    got = {}
    for r in select.select_diverse(p, 4, fx.R, method="fps", spread=spread).orderBy("slide_id", "pick").collect():
        got.setdefault(r.slide_id, []).append(r.roi_id)
    slides = {}
    for r in p.orderBy("slide_id", "roi_id").collect():
        slides.setdefault(r.slide_id, []).append(r)
    for slide, rows in slides.items():
        want = greedy([list(map(float, r.embedding)) for r in rows], [r.quality for r in rows], [(r.grid_i, r.grid_j) for r in rows], [r.group_id for r in rows], 4, fx.R, spread=spread)
        assert got[slide] == [rows[i].roi_id for i in want]
    if not spread:
        default = queries.QUERIES["diverse_select"](spark, SF).orderBy("slide_id", "pick").collect()
        assert {s: [r.roi_id for r in default if r.slide_id == s] for s in got} == got


def test_determinantal_draws_have_the_right_frequencies():
    """How often each pair is drawn, against the determinants of all pairs."""
    x = np.random.default_rng(7).normal(size=(5, 2))
    kernel = select.kernel_matrix(x, np.array([1.0, 0.8, 0.6, 0.9, 0.7]), np.arange(10).reshape(5, 2) * 3, 4)
    pairs = list(itertools.combinations(range(5), 2))
    weight = np.array([np.linalg.det(kernel[np.ix_(p, p)]) for p in pairs])
    n = 6000
    drawn = [tuple(sorted(select.determinantal(kernel, 2, seed))) for seed in range(n)]
    share = np.array([drawn.count(p) for p in pairs]) / n
    assert np.abs(share - weight / weight.sum()).max() < 0.02


def test_kdpp_select_draws_from_each_slide(spark):
    got = queries.QUERIES["kdpp_select"](spark, SF).collect()
    rows = {(r.slide_id, r.roi_id): r for r in queries._points(spark, SF).collect()}
    for slide in {r.slide_id for r in got}:
        mine = [rows[slide, r.roi_id] for r in got if r.slide_id == slide]
        assert len(mine) == 4 and all(select.iou((a.grid_i, a.grid_j), (b.grid_i, b.grid_j), fx.R) <= 0.3 for a, b in itertools.combinations(mine, 2))


def u(key, seed=0):
    return (int(hashlib.md5(f"{key}:{seed}".encode()).hexdigest()[:7], 16) + 1) / 268435457


def test_augmented_crops(spark):
    """Flips, levels and noise of every cell from the same draws, cell by cell."""
    cells = spark.createDataFrame([("a", v, i, j, (i + j) % 3 > 0, [0.1 * i, 0.2 * j + 0.013, 1.0]) for v in range(12) for i in range(3) for j in range(3)], "slide_id string, view int, i int, j int, valid boolean, features array<double>")
    got = {(r.view, r.i, r.j): list(r.features) for r in views.augmented(cells, 3, F.concat_ws("/", "slide_id", F.col("view").cast("string"))).collect()}
    kinds = set()
    for r in cells.collect():
        key = f"a/{r.view}"
        flips = u(f"{key}/flip-i") < 0.5, u(f"{key}/flip-j") < 0.5
        i, j = 2 - r.i if flips[0] else r.i, 2 - r.j if flips[1] else r.j
        v = list(r.features)
        if changed := u(f"{key}/posterise") < 0.5:
            v = [round(x / 0.05) * 0.05 for x in v]
            v = [x + 0.005 * math.sqrt(-2 * math.log(u(f"{key}/{i}/{j}/{k}/u"))) * math.cos(2 * math.pi * u(f"{key}/{i}/{j}/{k}/v")) for k, x in enumerate(v)]
        kinds.add((*flips, changed))
        assert np.allclose(got[r.view, i, j], v if r.valid else [0.0] * 3, atol=1e-12)
    assert len(kinds) > 4


def test_train_views(spark):
    """Every cell of every crop against plain slicing of the windows, up to flips and changes that its draws say."""
    rows = queries.QUERIES["train_views"](spark, SF).collect()
    tiles = {(r.slide_id, r.grid_i, r.grid_j): r for r in fx.tiles(spark, SF).collect()}
    feats = {(r.slide_id, r.grid_i, r.grid_j): r.features for r in queries._features(spark, SF).collect()}
    chosen = {r.slide_id: r for r in select.pick_pair(queries._gated(spark, SF).withColumn("pick", F.when(F.col("roi_id") == 3, 0).when(F.col("roi_id") == 5, 1))).collect()}
    at = {(r.slide_id, r.roi_id): (r.grid_i, r.grid_j) for r in queries._gated(spark, SF).collect()}
    assert {r.slide_id for r in rows} == set(chosen)
    seen = set()
    for r in rows:
        top, left = at[r.slide_id, chosen[r.slide_id]["first" if r.side == "a" else "second"]]
        key = f"{r.slide_id}/{r.side}/{r.view_type}/{r.view}"
        assert (r.size, r.view < (2 if r.view_type == "global" else 4)) == (3 if r.view_type == "global" else 2, True)
        i = r.size - 1 - r.i if u(f"{key}/flip-i", "0:2") < 0.5 else r.i
        j = r.size - 1 - r.j if u(f"{key}/flip-j", "0:2") < 0.5 else r.j
        cell = (r.slide_id, top + r.r0 + i, left + r.c0 + j)
        assert r.valid == (float(np.float16(tiles[cell].tissue_frac)) >= 0.3)
        if not r.valid:
            assert not any(r.features) and not r.masked
        elif u(f"{key}/posterise", "0:2") >= 0.5:
            assert np.allclose(r.features, feats[cell])
        ratio = {"teacherglobal": 0.0, "studentglobal": 0.45, "studentlocal": 0.55}[r.role + r.view_type]
        assert r.masked == (r.valid and ratio > 0 and u(f"{key}/{r.role}/{r.i}/{r.j}", "0:2") < ratio)
        seen.add((r.slide_id, r.side, r.role, r.view_type, r.view, r.i, r.j))
    assert len(seen) == len(rows) == len(chosen) * 2 * (2 * 2 * 9 + 4 * 4)
    assert {r.batch for r in rows} == set(range(-(-len(chosen) // 4)))


# ---------------------------------------------------------------- candidates


def test_windows_of_two_groups_are_candidates_once(spark):
    rows = [("s", i, j, 1.0 if (j % 4) < 3 else 0.0, 0.0) for i in range(8) for j in range(12)]
    cells = spark.createDataFrame(rows, "slide_id string, grid_i int, grid_j int, tissue_frac double, artifact_frac double")
    got = sampling.candidates_of(cells, 2, 200, None, least_tissue=0.0, tile_tissue=0.1, valid_share=0.0, cover=0.5, radius=0, least_group=0.1).collect()
    places = [(r.grid_i, r.grid_j) for r in got]
    assert len(places) == len(set(places)) > 10 and sorted(r.roi_id for r in got) == list(range(len(got)))


def test_draws_end_like_the_loop_does(spark):
    """How many candidates are found with a cap on draws, against the loop of draws and refusals itself."""
    rng = np.random.default_rng(2)
    rows = [(f"s{k}", i, j, 1.0, 0.0) for k in range(150) for i in range(7) for j in range(7)]
    cells = spark.createDataFrame(rows, "slide_id string, grid_i int, grid_j int, tissue_frac double, artifact_frac double")
    found = sampling.candidates_of(cells, 2, 1000, None, least_tissue=0.0, radius=0, attempts=30)
    mean = found.groupBy("slide_id").count().agg(F.avg("count")).first()[0]
    loops = [len({(int(a), int(b)) for a, b in rng.integers(0, 6, (30, 2))}) for _ in range(2000)]
    assert abs(mean - np.mean(loops)) < 1.0
    assert sampling.attempt_cap(None, 64) == 12800 and sampling.attempt_cap(10, None) == 1000


def test_sampled_windows_are_gated_and_chosen(spark):
    got = queries.QUERIES["sample_rois"](spark, SF).collect()
    tiles = {(r.slide_id, r.grid_i, r.grid_j): r for r in fx.tiles(spark, SF).collect()}
    half = lambda x: float(np.float16(x))
    assert len({(r.slide_id, r.grid_i, r.grid_j) for r in got}) == len(got) > 0
    for r in got:
        cells = [tiles[r.slide_id, r.grid_i + a, r.grid_j + b] for a in range(3) for b in range(3)]
        tissue, artifact = (sum(half(getattr(c, n)) for c in cells) / 9 for n in ("tissue_frac", "artifact_frac"))
        assert abs(r.tissue_frac - tissue) < 1e-9 and abs(r.artifact_frac - artifact) < 1e-9
        assert r.passed_qc == (tissue >= 0.4 and artifact <= 0.05) and (r.pick is None or r.passed_qc)
    for slide in {r.slide_id for r in got}:
        mine = [r for r in got if r.slide_id == slide]
        assert sum(r.passed_qc for r in mine) <= 16 and sum(r.pick is not None for r in mine) <= 2
        picked = [r for r in mine if r.pick is not None]
        assert all(select.iou((a.grid_i, a.grid_j), (b.grid_i, b.grid_j), 3) <= 0.3 for a, b in itertools.combinations(picked, 2))


# ---------------------------------------------------------------- vectors


def test_vector_sums_over_many_keys_and_partitions(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(int(rng.integers(0, 40)) if k % 3 else 7, float(rng.random()), [float(v) for v in rng.normal(size=5)]) for k in range(600)] + [(3, 1.0, None)]
    df = spark.createDataFrame(rows, "k int, w double, v array<double>").repartition(5)
    sums = {}
    for k, w, v in rows:
        if v is not None:
            a = sums.setdefault(k, [np.zeros(5), 0.0, np.zeros(5), 0])
            a[0], a[1], a[2], a[3] = a[0] + w * np.array(v), a[1] + w, a[2] + np.array(v), a[3] + 1
    for held in (vectors.HELD_KEYS, 4):
        monkeypatch.setattr(vectors, "HELD_KEYS", held)
        got = {r.k: r for r in vectors.vector_sums(df, ["k"], "v", {"a": F.col("w"), "b": F.lit(1.0)}).collect()}
        assert set(got) == set(sums)
        for k, (a, t, b, n) in sums.items():
            assert np.allclose(got[k].a, a) and np.allclose(got[k].b, b) and math.isclose(got[k].a_total, t) and got[k].b_total == n
    assert vectors.vector_sums(df.limit(0), ["k"], "v", {"a": F.lit(1.0)}).count() == 0


def test_too_many_points_are_an_error(spark, monkeypatch):
    points = spark.createDataFrame([("s", k, [float(k)]) for k in range(9)], "slide_id string, roi_id int, embedding array<double>")
    assert vectors.pair_distances(points).count() == 72
    listed = points.groupBy("slide_id").agg(F.collect_list("roi_id").alias("x"))
    with pytest.raises(Exception, match="more than 8 items"):
        select.checked_list(listed, "slide_id", "x", 8).collect()
    with pytest.raises(ValueError, match="over 4096"):
        vectors._checked(__import__("pandas").DataFrame({"slide_id": ["s"] * 5000}), "slide_id")


def test_packed_fractions_equal_pixel_counts(spark):
    rng = np.random.default_rng(4)
    masks = {s: rng.random((h, w)) < 0.4 for s, h, w in (("a", 13, 17), ("b", 8, 8))}
    df = spark.createDataFrame([(s, *m.shape, np.packbits(m).tobytes()) for s, m in masks.items()], "slide_id string, height int, width int, tissue binary")
    boxes = [(s, k, int(x0), int(y0), int(x0 + 9), int(y0 + 7), 0.7, 0.9) for s in masks for k, (x0, y0) in enumerate(rng.integers(0, 20, (12, 2)))]
    tiles = spark.createDataFrame(boxes, "slide_id string, tile_id long, x0_lvl0 long, y0_lvl0 long, x1_lvl0 long, y1_lvl0 long, scale_x double, scale_y double")
    got = {(r.slide_id, r.tile_id): r.f for r in grid.packed_fractions(tiles, df, "tissue", "f").collect()}
    for s, k, x0, y0, x1, y1, sx, sy in boxes:
        part = masks[s][math.floor(y0 * sy) : math.ceil(y1 * sy), math.floor(x0 * sx) : math.ceil(x1 * sx)]
        assert math.isclose(got[s, k], part.mean() if part.size else 0.0)
    box = {r.slide_id: tuple(r)[1:] for r in grid.packed_box(df).collect()}
    for s, m in masks.items():
        ys, xs = np.nonzero(m)
        assert box[s] == (ys.min(), ys.max() + 1, xs.min(), xs.max() + 1)


def test_artifact_masks_query(spark):
    got = queries.QUERIES["artifact_masks"](spark, SF).collect()
    masks = {r.slide_id: grid.unpacked(bytes(r.tissue), r.height, r.width) for r in queries.QUERIES["tissue_masks"](spark, SF).collect()}
    for r in got:
        seen = masks[r.slide_id]
        found = grid.unpacked(bytes.fromhex(r.artifact), r.height, r.width)
        want = np.zeros_like(seen)
        for y in range(0, seen.shape[0], 8):
            for x in range(0, seen.shape[1], 8):
                if seen[y : y + 8, x : x + 8].sum() > 2:
                    want[y : y + 8, x : x + 8] = seen[y : y + 8, x : x + 8]
        want[:, 1::2] = False  # odd columns are not green
        assert (found == want).all() and r.patches_read <= r.patches


def test_jobs_module_has_its_fixed_values():
    assert len(jobs.COLLECTIONS) == 9 and len(jobs.DESCRIPTIONS) == 6
