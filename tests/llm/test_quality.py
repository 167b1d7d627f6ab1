import zlib

import numpy as np
from pyspark.sql import functions as F

from gridloom.llm import quality


def test_held_out_ranking(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = quality.scores(spark.read.parquet(f"{sf}/documents.parquet"), labels).join(labels, "doc_id").where("held_out").collect()
    good, bad = (np.array([r.score for r in rows if r.quality == q]) for q in (1, 0))
    assert (good[:, None] > bad).mean() + (good[:, None] == bad).mean() / 2 > 0.95
    assert np.mean([r.predicted == r.quality for r in rows]) > 0.93


def test_isotonic_is_ascending_and_keeps_the_mean():
    x, y = np.arange(8.0), np.array([0, 1, 0, 0, 1, 1, 0, 1.0])
    a, b = quality.isotonic(x, y)
    assert (np.diff(b) > 0).all() and (np.diff(a) > 0).all()
    a, b = quality.isotonic(np.array([1.0, 1, 2, 2]), np.array([0.0, 1, 0, 1]))
    assert len(a) == 1 and np.interp([1.0, 2.0], a, b).tolist() == [0.5, 0.5]
    a, b = quality.isotonic(np.array([2.0, 1, 2, 1]), np.array([1.0, 0, 1, 1]))
    assert a.tolist() == [1.0, 2.0] and b.tolist() == [0.5, 1.0]


def minimax(x, y):
    """Isotonic regression at each distinct x by its formula: the largest over starts of the least mean to any end."""
    at = np.unique(x)
    return [max(min(y[(x >= a) & (x <= b)].mean() for b in at[at >= c]) for a in at[at <= c]) for c in at]


def test_isotonic_equals_its_formula():
    rng = np.random.default_rng(3)
    for _ in range(20):
        x, y = rng.integers(0, 12, 30).astype(float), rng.integers(0, 2, 30).astype(float)
        a, b = quality.isotonic(x, y)
        assert (np.diff(b) > 0).all()
        fitted = minimax(x, y)
        assert sorted(set(np.round(fitted, 9))) == np.round(b, 9).tolist()


def test_scores_equal_a_plain_fit(spark):
    """Ridge and calibration on all labelled rows at once, by plain numpy, against the sums over partitions."""
    sf = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    marks: dict = {}
    for r in labels.collect():
        if r.quality is not None:
            marks.setdefault(r.doc_id, []).append(r.quality)
    fold = {r.doc_id: r.f for r in docs.select("doc_id", F.pmod(F.xxhash64("doc_id", F.lit("quality fold")), F.lit(5)).alias("f")).collect()}
    rows = [r for r in docs.collect() if r.doc_id in marks and zlib.crc32(str(r.doc_id).encode()) % 4 != 2]
    stat = lambda rs: np.array([quality.statistics(r.text) for r in rs], np.float32).astype(np.float64)
    target = lambda rs: np.array([np.mean(marks[r.doc_id]) for r in rs])
    learn, check = [r for r in rows if fold[r.doc_id]], [r for r in rows if not fold[r.doc_id]]
    x, y = stat(learn), target(learn)
    mean, scale = x.mean(0), np.where(x.std(0) > 1e-6, x.std(0), 1.0)
    z = quality.expand((x - mean) / scale)
    weight = np.linalg.solve(z.T @ z + quality.RIDGE * len(x) * np.eye(z.shape[1]), z.T @ y)
    raw = lambda rs: quality.expand((stat(rs) - mean) / scale) @ weight
    got = {r.doc_id: r.score for r in quality.scores(docs, labels).collect()}
    want = np.clip(np.interp(raw(docs.collect()), *quality.isotonic(raw(check), target(check))), 0, 1)
    have = np.array([got[r.doc_id] for r in docs.collect()])
    assert np.mean(np.abs(have - want) < 0.02) > 0.97


def test_features_approximate_the_kernel():
    x = np.random.default_rng(0).normal(size=(40, quality.STATISTICS))
    z = quality.expand(x)[:, :-1]
    k = np.exp(-((x[:, None] - x[None]) ** 2).sum(-1) / (2 * quality.STATISTICS))
    assert np.abs(z @ z.T - k).max() < 0.25


def test_odd_rows(odd_docs, no_docs, spark):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(1, 11)] + [(1, 1, 0), (None, 1, 0), (2, None, 0)], "doc_id long, quality int, toxic int")
    rows = quality.scores(odd_docs, labels).collect()
    by = {}
    for r in rows:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
        by.setdefault(r.doc_id, set()).add(r.score)
    assert len(rows) == odd_docs.count() and by[1] == by[2] and by[3] == by[4]
    assert quality.scores(no_docs, labels).count() == 0
    assert {r.score for r in quality.scores(odd_docs, labels.limit(0)).collect()} == {0.5}
