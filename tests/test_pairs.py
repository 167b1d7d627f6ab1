"""Pairs within one slide of any number of points, against plain numpy."""

import contextlib
import itertools
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.operators import select, vectors

MANY = 4200  # more than one task held once


def points_of(spark, x, slide="s", **columns):
    rows = [(slide, k, *(float(c[k]) for c in columns.values()), [float(a) for a in v]) for k, v in enumerate(x)]
    return spark.createDataFrame(rows, f"slide_id string, roi_id int, {''.join(f'{c} double, ' for c in columns)}embedding array<double>")


def cosines(x, y):
    return ((x / np.linalg.norm(x, axis=1)[:, None]) @ (y / np.linalg.norm(y, axis=1)[:, None]).T).max(1)


def test_novelty_of_many_candidates_and_picks(spark):
    x, y = np.random.default_rng(1).normal(size=(2, MANY, 3))
    both = points_of(spark, x).unionByName(points_of(spark, x[:5], "none"))
    history = points_of(spark, y).unionByName(points_of(spark, y[:7], "other")).unionByName(points_of(spark, y[:300])).drop("roi_id")
    got = {(r.slide_id, r.roi_id): r for r in vectors.with_novelty(both, history).collect()}
    assert len(got) == MANY + 5
    assert np.allclose([got["s", k].max_similarity for k in range(MANY)], cosines(x, y))
    assert all(got["none", k].max_similarity == 0 and np.isclose(got["none", k].novelty, 1.05) for k in range(5))


def test_novelty_does_not_depend_on_blocks(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK_POINTS", 8)
    monkeypatch.setattr(vectors, "MOST_BLOCKS", 3)
    x, y = np.random.default_rng(2).normal(size=(60, 3)), np.random.default_rng(3).normal(size=(41, 3))
    for a, b in ((x, y), (x, y[:4]), (x[:3], y)):
        got = {r.roi_id: r.max_similarity for r in vectors.history_similarity(points_of(spark, a), points_of(spark, b).drop("roi_id")).collect()}
        assert np.allclose([got[k] for k in range(len(a))], cosines(a, b))


def test_every_pair_of_many_points(spark):
    x = np.random.default_rng(6).normal(size=(MANY, 2))
    got = vectors.pair_distances(points_of(spark, x).unionByName(points_of(spark, x[:3], "t")).unionByName(points_of(spark, x[:4], None)))
    assert [tuple(r) for r in got.groupBy("slide_id").count().orderBy("slide_id").collect()] == [("s", MANY * (MANY - 1)), ("t", 6)]
    some = got.where("slide_id = 's' and a_roi_id in (0, 77) and b_roi_id >= 4100").collect()
    assert len(some) == 200 and all(np.isclose(r.d2, ((x[r.a_roi_id] - x[r.b_roi_id]) ** 2).sum()) for r in some)


def test_pairs_do_not_depend_on_blocks(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK_POINTS", 8)
    monkeypatch.setattr(vectors, "BLOCK_NUMBERS", 50)
    x = np.random.default_rng(7).normal(size=(61, 3))
    points = points_of(spark, x).unionByName(points_of(spark, x[:1]))  # a row twice: no pair with itself
    got = sorted(tuple(r)[1:3] for r in vectors.pair_distances(points).collect())
    assert got == sorted([(a, b) for a in range(61) for b in range(61) if a != b] + [p for k in range(1, 61) for p in ((0, k), (k, 0))])


def medians(points):
    return {r.slide_id: r.sigma for r in vectors.bandwidths(points).collect()}


def plain_sigma(x):
    d2 = np.concatenate([((x[k] - x[k + 1 :]) ** 2).sum(-1) for k in range(len(x))])
    d2 = d2[d2 > 0]
    return np.sqrt(np.median(d2)) if len(d2) else 1.0


def test_bandwidth_of_many_points(spark):
    """More points than were compared at once, and slides of any other kind: copies, far and near ones, one point."""
    rng = np.random.default_rng(4)
    slides = {
        "s": rng.normal(size=(MANY, 3)), "even": rng.normal(size=(5, 2)), "odd": rng.normal(size=(3, 2)), "one": np.ones((1, 2)), "equal": np.ones((6, 2)),
        "copies": np.repeat(rng.normal(size=(4, 2)), 30, 0), "far": rng.normal(size=(40, 2)) * 10.0 ** rng.integers(-150, 150, (40, 1)), "steps": np.arange(50.0)[:, None],
    }
    points = points_of(spark, slides["s"])
    for name, x in list(slides.items())[1:]:
        points = points.unionByName(points_of(spark, x, name))
    got = medians(points.unionByName(points_of(spark, np.zeros((3, 2)), None)))
    assert set(got) == set(slides) - {"one"}
    for name, sigma in got.items():
        assert np.isclose(sigma, plain_sigma(slides[name]), rtol=1e-14, atol=0), name


def test_bandwidth_does_not_depend_on_blocks(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK_POINTS", 8)
    x = np.random.default_rng(5).normal(size=(61, 3)).round(1)
    points = points_of(spark, x)
    assert np.isclose(medians(points)["s"], plain_sigma(x), rtol=1e-14)
    twice = points.unionByName(points)  # rows of one key are no pair
    assert medians(twice) == {r.slide_id: r.sigma for r in vectors.bandwidth(vectors.pair_distances(twice)).collect()}


def plain_kernel(x, i, j, q, tau):
    d2, p2 = ((x[:, None] - x[None]) ** 2).sum(-1), (i[:, None] - i) ** 2 + (j[:, None] - j) ** 2
    k = q[:, None] * q * np.exp(-d2 / plain_sigma(x) ** 2) * np.exp(-p2 / tau**2)
    k[np.diag_indices(len(x))] = q * q + 1e-6
    return k


def test_kernel_does_not_depend_on_blocks(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK_POINTS", 8)
    rng = np.random.default_rng(8)
    x, (i, j), q = rng.normal(size=(61, 3)), rng.integers(0, 9, (2, 61)).astype(float), rng.random(61)
    points = points_of(spark, x, grid_i=i, grid_j=j, quality=q).unionByName(points_of(spark, x[:1], "one", grid_i=i, grid_j=j, quality=q))
    got = vectors.kernel_entries(points, 4).collect()
    kernel = plain_kernel(x, i, j, q, 6.0)
    assert len(got) == 61 * 61 + 1 and len({(r.slide_id, r.a, r.b) for r in got}) == len(got)
    assert all(np.isclose(r.value, kernel[r.a, r.b], rtol=1e-12) for r in got)


def test_kernel_of_many_points(spark):
    rng = np.random.default_rng(9)
    x, (i, j), q = rng.normal(size=(MANY, 2)), rng.integers(0, 9, (2, MANY)).astype(float), rng.random(MANY)
    entries = vectors.kernel_entries(points_of(spark, x, grid_i=i, grid_j=j, quality=q), 4)
    n, trace = entries.selectExpr("count(*)", "sum(if(a = b, value, 0))").first()
    assert n == MANY * MANY and np.isclose(trace, (q * q + 1e-6).sum())


@pytest.mark.parametrize("spread,trials", [(1.0, 500), (0.02, 20), (0.02, 2)])
def test_draws_by_rejection_have_the_right_frequencies(monkeypatch, spread, trials):
    """How often each set is drawn, against the determinants of all sets; candidates that are much alike need pivots."""
    monkeypatch.setattr(select, "TRIALS", trials)
    rng = np.random.default_rng(10)
    x, ij, q = rng.normal(size=(6, 2)) * spread, np.arange(12).reshape(6, 2) * spread, np.array([1.0, 0.8, 0.6, 0.9, 0.7, 0.5])
    d2, p2 = ((x[:, None] - x) ** 2).sum(-1), ((ij[:, None] - ij) ** 2).sum(-1)
    kernel = np.outer(q, q) * np.exp(-d2 / 2.0) * np.exp(-p2 / 36.0) + 1e-6 * np.eye(6)
    sets = list(itertools.combinations(range(6), 3))
    weight = np.array([np.linalg.det(kernel[np.ix_(p, p)]) for p in sets])
    drawn = []
    for seed in range(5000):
        with contextlib.suppress(ValueError):
            drawn.append(tuple(sorted(select.determinantal_by_rejection(x, q, ij, 6.0, 2.0, 3, seed))))
    assert len(drawn) > 2000
    share = np.array([drawn.count(p) for p in sets]) / len(drawn)
    assert np.abs(share - weight / weight.sum()).max() < 0.03


def test_kdpp_of_many_candidates(spark):
    """No kernel of a slide is made whole; equal candidates, too, give a draw."""
    rng = np.random.default_rng(11)
    x, (i, j), q = rng.normal(size=(MANY, 16)), rng.integers(0, 400, (2, MANY)).astype(float), rng.random(MANY)
    columns = dict(grid_i=i, grid_j=j, quality=q)
    points = points_of(spark, x, **columns).unionByName(points_of(spark, np.ones((600, 16)), "equal", **columns)).unionByName(points_of(spark, x[:9], "few", **columns))
    want = select.diverse(x[:9], q[:9], np.stack([i, j], 1)[:9], np.zeros(9), np.zeros((0, 2)), 4, 4, method="kdpp")
    tracemalloc.start()
    big = select.determinantal_by_rejection(x, q, np.stack([i, j], 1), 6.0, 30.0, 4, 0)
    assert len(set(big)) == 4 and tracemalloc.get_traced_memory()[1] < 50e6
    tracemalloc.stop()
    got = {}
    for r in select.select_diverse(points.withColumn("group_id", F.lit(0)), 4, 4, method="kdpp").orderBy("slide_id", "pick").collect():
        got.setdefault(r.slide_id, []).append(r.roi_id)
    assert {s: len(set(p)) for s, p in got.items()} == {"s": 4, "equal": 4, "few": 4} and got["few"] == want
