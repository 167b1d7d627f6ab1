"""Quality classifier: random Fourier features of document statistics, ridge regression, isotonic calibration."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import cut, held_out

#: Labelled documents that the model is fitted on, about (by a hash of the id); a fifth of them only calibrate it.
SAMPLE_DOCS = 40_000
#: Random features, their seed, ridge penalty for each row, and tasks that sum the normal equations.
FEATURES, SEED, RIDGE, SUM_TASKS = 320, 7, 1e-4, 16
GOOD_FROM = 0.7

_BYTES = np.arange(256)
_UPPER, _LOWER, _DIGIT, _SPACE = (np.isin(_BYTES, list(x)) for x in (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b" \t\n\r\x0b\x0c"))
_CONTROL, _WIDE = (_BYTES < 32) & ~_SPACE, _BYTES >= 128
_MARKS = [ord(c) for c in ".,!?|#$%&*;:-_<>()[]{}\"'/=+@~^"]
STATISTICS = 20 + len(_MARKS)


def statistics(text: str | None) -> np.ndarray:
    """Statistics of a whole text; of an empty one all are 0."""
    out = np.zeros(STATISTICS)
    if not text:
        return out
    raw = text.encode()
    n = len(raw)
    seen = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    words = text.split()
    lines = [x for x in text.split("\n") if x.strip()]
    k = max(1, len(words))
    counts, line_counts = Counter(words), Counter(lines)
    p = seen[seen > 0] / n
    lengths = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1, np.int64)
    shape = [
        np.log1p(n),
        np.log1p(len(words)),
        lengths.mean(),
        lengths.std(),
        np.log1p(lengths.max()),
        *(seen[c].sum() / n for c in (_UPPER, _LOWER, _DIGIT, _SPACE, _CONTROL, _WIDE)),
        len(counts) / k,
        max(counts.values(), default=0) / k,
        len(counts) / np.sqrt(k),
        np.log1p(len(lines)),
        len(words) / max(1, len(lines)) / 20,
        1 - len(line_counts) / max(1, len(lines)),
        max(line_counts.values(), default=0) / max(1, len(lines)),
        -(p * np.log2(p)).sum(),
        sum(w.isupper() for w in counts) / max(1, len(counts)),
    ]
    out[: len(shape)] = shape
    out[len(shape) :] = np.sqrt(seen[_MARKS] / k)
    return out


def features(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, stats array<float>) of every row of docs; nothing but the text is looked at."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array([statistics(t.as_py()) for t in b.column(2)], np.float32).reshape(-1, STATISTICS)
            ends = np.arange(0, x.size + 1, STATISTICS, dtype=np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.ListArray.from_arrays(pa.array(ends), pa.array(x.ravel()))], ["doc_id", "held_out", "stats"])

    return docs.select("doc_id", held_out().alias("held_out"), F.col("text").cast("string")).mapInArrow(run, f"doc_id {kind}, held_out boolean, stats array<float>")


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray  # of the random features, the last of them constant
    knots: np.ndarray  # calibration: raw scores …
    values: np.ndarray  # … and what they mean

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return expand((stats - self.mean) / self.scale) @ self.weight

    def score(self, stats: np.ndarray) -> np.ndarray:
        if not len(self.knots):
            return np.full(len(stats), 0.5)
        return np.clip(np.interp(self.raw(stats), self.knots, self.values), 0.0, 1.0)


def expand(x: np.ndarray) -> np.ndarray:
    """Random Fourier features of a Gaussian kernel whose width is that of standardised statistics, and a constant."""
    rng = np.random.default_rng(SEED)
    w = rng.normal(0.0, 1.0 / np.sqrt(x.shape[1]), (x.shape[1], FEATURES))
    phase = rng.uniform(0.0, 2 * np.pi, FEATURES)
    return np.hstack([np.sqrt(2.0 / FEATURES) * np.cos(np.clip(x, -8, 8) @ w + phase), np.ones((len(x), 1))])


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: mean x and mean y of each block, by x. Equal x are one point, of their mean y."""
    blocks: list[list[float]] = []
    at, which, times = np.unique(x, return_inverse=True, return_counts=True)
    for a, b, n in zip(at.tolist(), (np.bincount(which, y, len(at)) / times).tolist(), times.tolist()):
        blocks.append([a, b, float(n)])
        while len(blocks) > 1 and blocks[-2][1] >= blocks[-1][1]:
            c, d = blocks.pop(), blocks.pop()
            n = c[2] + d[2]
            blocks.append([(c[0] * c[2] + d[0] * d[2]) / n, (c[1] * c[2] + d[1] * d[2]) / n, n])
    return np.array([b[0] for b in blocks]), np.array([b[1] for b in blocks])


def fit(table: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS) -> Model:
    """A model from the labelled rows of `table` that are not held out, about sample_docs of them.

    Repeated labels of a document count as their mean. The sample's partitions each return sums of fixed size.
    """
    marks = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.avg("quality").alias("y"))
    known = table.where(~F.col("held_out")).join(marks, "doc_id")
    n = known.count()
    u = F.pmod(F.xxhash64("doc_id", F.lit("quality sample")), F.lit(1 << 20)) / float(1 << 20)
    fold = F.pmod(F.xxhash64("doc_id", F.lit("quality fold")), F.lit(5))
    sample = cut(known.where(u < min(1.0, sample_docs / max(1, n))).select("doc_id", fold.cast("int").alias("fold"), "stats", "y").repartition(SUM_TASKS, "doc_id").sortWithinPartitions("doc_id", "y"), "quality-sample")
    learn, check = sample.where("fold <> 0"), sample.where("fold = 0")

    def arrays(batches: Iterator[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray]:
        xs, ys = [np.zeros((0, STATISTICS))], [np.zeros(0)]
        for b in batches:
            xs.append(b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, STATISTICS).astype(np.float64))
            ys.append(b.column(1).to_numpy(zero_copy_only=False))
        return np.vstack(xs), np.concatenate(ys)

    def summed(frame: DataFrame, of) -> np.ndarray | float:
        """Sum over partitions of an array that `of` makes from a partition's statistics and labels."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            yield pa.RecordBatch.from_arrays([pa.array([of(*arrays(batches)).astype("<f8").tobytes()], pa.binary())], ["sums"])

        return sum(np.frombuffer(r["sums"], "<f8") for r in frame.select("stats", "y").mapInArrow(run, "sums binary").collect())

    m = STATISTICS
    moments = summed(learn, lambda x, y: np.concatenate([[len(x)], x.sum(0), (x**2).sum(0)]))
    rows = moments[0] if np.ndim(moments) else 0
    if not rows:
        return Model(np.zeros(m), np.ones(m), np.zeros(FEATURES + 1), np.zeros(0), np.zeros(0))
    mean = moments[1 : m + 1] / rows
    spread = np.sqrt(np.maximum(moments[m + 1 :] / rows - mean**2, 0))
    model = Model(mean, np.where(spread > 1e-9, spread, 1.0), np.zeros(FEATURES + 1), np.zeros(0), np.zeros(0))

    def equations(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        z = expand((x - model.mean) / model.scale)
        return np.concatenate([(z.T @ z).ravel(), z.T @ y])

    sums = summed(learn, equations)
    d = FEATURES + 1
    model.weight = np.linalg.solve(sums[: d * d].reshape(d, d) + RIDGE * rows * np.eye(d), sums[d * d :])
    # without a row to calibrate on, the rows learned from do; the sample's size bounds both
    held = check.select("stats", "y").collect() or learn.select("stats", "y").collect()
    raw = model.raw(np.array([r["stats"] for r in held], np.float64).reshape(-1, m))
    model.knots, model.values = isotonic(raw, np.array([r["y"] for r in held]))
    return model


def scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of docs.

    Null texts count as empty and are scored as such; repeated rows, and equal texts, have equal scores. Texts are read
    whole, however long. Without labelled rows all scores are 0.5; no documents: no rows.
    """
    table = cut(features(docs), "statistics")
    sent = docs.sparkSession.sparkContext.broadcast(fit(table, labels))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column(2).flatten().to_numpy(zero_copy_only=False).reshape(-1, STATISTICS).astype(np.float64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(sent.value.score(x), pa.float64())], ["doc_id", "held_out", "score"])

    scored = table.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= GOOD_FROM).cast("int"))
