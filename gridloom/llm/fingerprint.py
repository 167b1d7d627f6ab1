"""Lempel-Ziv fingerprints: the phrases of an LZ78 parse, hashed and kept as one-permutation minimum hashes."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import cut, range_index, range_plan, small

#: Minimum hashes of a fingerprint. Each is 16 bits; 0 marks a bin that no phrase fell into.
BINS = 128
#: Characters of a range that one task parses.
RANGE_CHARS = 8_000_000


def phrases(text: str, start: int, known: set[str], size: int = 4) -> list[str]:
    """The new phrases of text from `start` on, given the dictionary so far, which they are added to.

    Every prefix of a phrase is a phrase, so the longest known one is found by growing or shrinking a guess. What is left
    at the end is a known phrase and adds nothing.
    """
    out, n, add = [], len(text), known.add
    i = start
    while i < n:
        j = i + size
        if text[i:j] in known:
            j += 1
            while text[i:j] in known and j <= n:
                j += 1
        else:
            j -= 1
            while j > i and text[i:j] not in known:
                j -= 1
            j += 1
        if j > n:
            break
        phrase = text[i:j]
        add(phrase)
        out.append(phrase)
        size = j - i
        i = j
    return out


def parse_with_edit(text: str, cut_at: int, edited: str) -> tuple[list[str], list[str]]:
    """Phrases of text, and of edited, which has the same first `cut_at` characters: those are parsed once."""
    known: set[str] = set()
    first, boundary = _until(text, cut_at, known)
    tail = phrases(text, boundary, known)
    known.difference_update(tail)
    edited_tail = phrases(edited, boundary, known)
    return first + tail, first + edited_tail


def _until(text: str, stop: int, known: set[str]) -> tuple[list[str], int]:
    """Phrases that end within the first `stop` characters, and where the last of them ends."""
    got = phrases(text[:stop], 0, known)
    return got, sum(map(len, got))


def minima(found: list[str], bins: int = BINS) -> np.ndarray:
    """The least 16-bit hash of the phrases of each bin; 0 for an empty bin."""
    out = np.full(bins, 1 << 16, np.int64)
    if found:
        digest = xxhash.xxh3_64_intdigest
        h = np.array([digest(p) for p in found], np.uint64)
        at = (h % np.uint64(bins)).astype(np.int64)
        value = (h >> np.uint64(48)).astype(np.int64)
        np.minimum.at(out, at, np.maximum(value, 1))
    out[out == 1 << 16] = 0
    return out.astype(np.uint16)


def written(minimum: np.ndarray) -> str:
    return base64.b64encode(minimum.astype(">u2").tobytes()).decode()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated Jaccard similarity of the phrase sets: equal bins among those that either has. Two empty sets are alike."""
    used = (a > 0) | (b > 0)
    return float(((a == b) & used).sum() / used.sum()) if used.any() else 1.0


def fingerprint(text: str | None) -> str:
    return written(minima(phrases(text or "", 0, set())))


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint) of every row of docs; null texts count as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([fingerprint(t.as_py()) for t in b.column(1)], pa.string())], ["doc_id", "fingerprint"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, f"doc_id {kind}, fingerprint string")


#: Bytes of a text by which rows of one id are dealt to ranges, in the order of their texts.
TIE_BYTES = 7


def _tie(text: Column) -> Column:
    """0 to 256 ** TIE_BYTES - 1: the larger, the earlier a text comes among rows of its id."""
    first = F.rpad(F.hex(F.substring(F.encode(text, "UTF-8"), 1, TIE_BYTES)), 2 * TIE_BYTES, "0")
    return F.lit(256**TIE_BYTES - 1) - F.conv(first, 16, 10).cast("long")


def with_next(docs: DataFrame, range_chars: int = RANGE_CHARS) -> DataFrame:
    """docs' (doc_id, text) dealt into ranges of doc_id, descending, each with the row that follows it as a guest.

    Columns part, guest (0, or 1 for the first row of the next range), doc_id, text; sorted within partitions, null ids
    last, rows of one id by text. A range has about range_chars characters, more where there would be over MOST_RANGES of
    them; a task reads its rows one by one, so their number costs no memory. The driver sees the first id of each range.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("tie", _tie(F.col("text")))
    sizes = cut(rows.select("doc_id", "tie", F.length("text").cast("long").alias("n")), "lengths")
    ranges = range_plan(sizes, "doc_id", F.col("n") + 64, range_chars, F.col("tie"), 256**TIE_BYTES)
    # ranges ascend, parts descend; nulls are below all ids
    part = (F.lit(len(ranges) - 1) - range_index(F.col("doc_id"), ranges, F.col("tie"))).cast("int")
    head = F.max(F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", "tie")).alias("h")
    heads = sorted((r["part"], r["h"]["doc_id"], r["h"]["tie"]) for r in sizes.groupBy(part.alias("part")).agg(head).collect())
    # the part before also gets the first row of each part; the first part's goes to the last
    to = [(heads[(k + 1) % len(heads)][1], heads[(k + 1) % len(heads)][2], p) for k, (p, _, _) in enumerate(heads)]
    guests = small(spark.createDataFrame(to, "head_id long, head_tie long, to int"), len(to))
    own = F.struct(part.alias("part"), F.lit(0).alias("guest"))
    first = F.when(F.col("to").isNotNull(), F.struct(F.col("to").alias("part"), F.lit(1).alias("guest")))
    named = rows.join(guests, F.col("doc_id").eqNullSafe(F.col("head_id")) & (F.col("tie") == F.col("head_tie")), "left")
    dealt = named.select(F.explode(F.array_compact(F.array(own, first))).alias("x"), "doc_id", "text").select("x.part", "x.guest", "doc_id", "text")
    return dealt.repartitionById(len(ranges), F.col("part")).sortWithinPartitions("part", "guest", F.desc_nulls_last("doc_id"), "text")


def edited_text(text: str, following: str) -> str:
    """text with its last third (rounded down) replaced by as many characters, or all, of the following text's start."""
    k = len(text) // 3
    return text[: len(text) - k] + following[:k]


_OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def compare_edits(docs: DataFrame, range_chars: int = RANGE_CHARS) -> DataFrame:
    """Fingerprints of every whole text and of its edit, and their likeness to each other and to the next document.

    Next is the next lower doc_id; after the lowest comes the highest (a single document is its own next). Null texts are
    empty. Rows of one id follow each other by text; null ids come after all others. No documents: no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None  # the row that waits for its next: id, text
        rows: list[tuple] = []

        def made(row: tuple, following: str) -> tuple:
            doc_id, text = row
            k = len(text) // 3
            edited = edited_text(text, following)
            own, other = (minima(p) for p in parse_with_edit(text, len(text) - k, edited))
            return doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), own, written(other), likeness(own, other)

        def batch(rows: list[tuple], last: np.ndarray) -> pa.RecordBatch:
            """last: minima of the document after the last row."""
            after = [r[3] for r in rows[1:]] + [last]
            cols = [*([r[i] for r in rows] for i in range(3)), [written(r[3]) for r in rows], [r[4] for r in rows], [r[5] for r in rows], [likeness(r[3], x) for r, x in zip(rows, after)]]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, schema.types)], schema=schema)

        done = False
        for b in batches:
            for guest, doc_id, text in zip(*(b.column(i).to_pylist() for i in range(3))):
                if done:
                    continue  # rows that repeat the guest
                if held is not None:
                    rows.append(made(held, text))
                if guest:
                    if rows:
                        yield batch(rows, minima(phrases(text, 0, set())))
                    rows, done = [], True
                    continue
                held = (doc_id, text)
                if len(rows) > 512:
                    yield batch(rows[:-1], rows[-1][3])
                    rows = rows[-1:]
        if held is not None and not done:
            raise RuntimeError(f"no document follows {held[0]}")

    schema = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])
    return with_next(docs, range_chars).select("guest", "doc_id", "text").mapInArrow(run, _OUT)
