"""SimHash near-duplicates: fingerprints, then a binary-trie self-join of the distinct fingerprints.

Cut into budget + k blocks, two fingerprints within `budget` differing bits agree in k blocks at least. So a trie is walked
for each choice of k blocks, with the bits of those on top: there no pair of nodes may differ, so these levels are a shuffle
by the blocks' bits. Below, a task walks pairs of nodes of its cells together, breadth-first with numpy, adds up differing
bits, and drops a pair as soon as the budget is exceeded. It returns a spanning forest of the links it finds, never the links
themselves. More fingerprints take more blocks on top (longer keys), so cells stay small however many there are.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import cut, fresh, parts_for, small, trim
from gridloom.llm.components import connected_components

SHINGLE, SEED, BUDGET = 4, 42, 4
#: Members that a cell should have on average, about, and the most blocks on top.
CELL, MOST_TOP = 64, 4
#: Members of a cell that one task compares; larger cells are dealt as pairs of blocks.
BLOCK = 8192


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """64-bit SimHash of a text: ASCII lower case, words between ASCII white space, shingles with repeats."""
    words = (text or "").encode().lower().split()
    n = len(words)
    if not n:
        return 0
    if n <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    joined, ends = b" ".join(words), []
    at = -1
    for w in words:
        at += len(w) + 1
        ends.append(at)
    starts = [0, *(e + 1 for e in ends)]
    digest = xxhash.xxh64_digest
    bits = np.zeros(64, np.int64)
    for k in range(0, n - shingle + 1, 16384):  # bounded memory for very long texts
        pairs = zip(starts[k : k + 16384], ends[k + shingle - 1 : k + 16384 + shingle - 1])
        raw = b"".join([digest(joined[a:b], SEED) for a, b in pairs])
        bits += np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * bits > n - shingle + 1).tobytes(), "big")


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp long) of every row; a null text counts as empty (fingerprint zero)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = np.array([fingerprint(t.as_py()) for t in b.column(1)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got.view(np.int64))], ["doc_id", "fp"])
        trim()

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, f"doc_id {kind}, fp long")


def orders(budget: int, top: int) -> tuple[list[list[tuple[int, int]]], int]:
    """For each choice of `top` of the budget + top blocks the blocks (first bit, length), chosen ones first; and the least key length.

    Bit 0 is the highest. Blocks differ in length by one at most.
    """
    n = budget + top
    edges = [64 * i // n for i in range(n + 1)]
    blocks = [(a, b - a) for a, b in zip(edges, edges[1:])]
    out = [[*chosen, *(x for x in blocks if x not in chosen)] for chosen in itertools.combinations(blocks, top)]
    return out, min(sum(length for _, length in order[:top]) for order in out)


def blocks_on_top(rows: int, budget: int) -> int:
    """The fewest blocks whose bits make cells of CELL members on average."""
    return next((k for k in range(1, MOST_TOP) if rows / CELL <= 2.0 ** orders(budget, k)[1]), MOST_TOP)


def reordered(fp: np.ndarray, order: list[tuple[int, int]]) -> np.ndarray:
    """Fingerprints with their blocks in another order."""
    out = np.zeros_like(fp)
    at = 0
    for first, length in order:
        at += length
        out |= ((fp >> np.uint64(64 - first - length)) & np.uint64((1 << length) - 1)) << np.uint64(64 - at)
    return out


class Forest:
    """Union-find over 0..n-1 that takes whole arrays of links."""

    def __init__(self, n: int):
        self.root = np.arange(n, dtype=np.int64)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            ra, rb = self.root[a], self.root[b]
            far = ra != rb
            a, b, ra, rb = a[far], b[far], ra[far], rb[far]
            if not len(a):
                return
            hi, lo = np.maximum(ra, rb), np.minimum(ra, rb)
            np.minimum.at(self.root, hi, lo)
            while True:
                up = self.root[self.root]
                if np.array_equal(up, self.root):
                    break
                self.root = up


def walk(value: np.ndarray, pairs: list[np.ndarray], first: int, budget: int, forest: Forest, step: int = 1 << 20) -> None:
    """Walk pairs of trie nodes down from bit `first`.

    value: reordered fingerprints, ascending within each node. pairs: a_lo, a_hi, b_lo, b_hi (index ranges; equal ranges for a
    node with itself) of nodes that agree above.
    """
    leaf = 48
    a0, a1, b0, b1 = pairs
    acc = np.zeros(len(a0), np.int64)
    for bit in range(first, 64):
        if not len(a0):
            return
        few = (a1 - a0) * (b1 - b0) <= leaf
        if few.any():
            _leaves(value, a0[few], a1[few], b0[few], b1[few], budget, forest, step)
            a0, a1, b0, b1, acc = (x[~few] for x in (a0, a1, b0, b1, acc))
            if not len(a0):
                return
        am, bm = _split(value, a0, a1, bit), _split(value, b0, b1, bit)
        same = a0 == b0
        kids = [
            (a0, am, b0, bm, acc, None),
            (am, a1, bm, b1, acc, None),
            (a0, am, bm, b1, acc + 1, None),
            (am, a1, b0, bm, acc + 1, same),  # of a node with itself, one of the two crossings is enough
        ]
        out = []
        for x0, x1, y0, y1, c, skip in kids:
            ok = (x1 > x0) & (y1 > y0) & (c <= budget)
            if skip is not None:
                ok &= ~skip
            ok &= ~((x0 == y0) & (x1 - x0 < 2))
            out.append([x[ok] for x in (x0, x1, y0, y1, c)])
        a0, a1, b0, b1, acc = (np.concatenate([o[i] for o in out]) for i in range(5))
    _leaves(value, a0, a1, b0, b1, budget, forest, step)


def _split(value: np.ndarray, lo: np.ndarray, hi: np.ndarray, bit: int) -> np.ndarray:
    """Where each range's values begin to have `bit` (0 is the highest) set: a halving search over all ranges at once."""
    lo, hi, shift = lo.copy(), hi.copy(), np.uint64(63 - bit)
    while True:
        open_ = lo < hi
        if not open_.any():
            return lo
        mid = (lo + hi) >> 1
        up = ((value[np.minimum(mid, len(value) - 1)] >> shift) & np.uint64(1)).astype(bool)
        hi, lo = np.where(open_ & up, mid, hi), np.where(open_ & ~up, mid + 1, lo)


def _leaves(value, a0, a1, b0, b1, budget, forest, step) -> None:
    """Compare what is left pair by pair, in bounded pieces; links go into the forest at once."""
    na, nb = a1 - a0, b1 - b0
    count = na * nb
    at = 0
    total = np.cumsum(count)
    while at < len(count):
        base = total[at - 1] if at else 0
        upto = max(at + 1, int(np.searchsorted(total, base + step, "right")))
        if upto == at + 1 and count[at] > step:  # one huge pair of nodes: rows of its first side in turn
            rows = max(1, step // int(nb[at]))
            for r in range(int(a0[at]), int(a1[at]), rows):
                left = np.arange(r, min(r + rows, int(a1[at])))
                _compare(value, np.repeat(left, int(nb[at])), np.tile(np.arange(int(b0[at]), int(b1[at])), len(left)), budget, forest)
            at = upto
            continue
        c = count[at:upto]
        which = np.repeat(np.arange(at, upto), c)
        inside = np.arange(int(c.sum())) - np.repeat(np.cumsum(c) - c, c)
        _compare(value, a0[which] + inside // nb[which], b0[which] + inside % nb[which], budget, forest)
        at = upto


def _compare(value, i, j, budget, forest) -> None:
    near = (i != j) & (np.bitwise_count(value[i] ^ value[j]) <= budget)
    forest.link(i[near], j[near])


def _join_cells(cell: np.ndarray, side: np.ndarray, same: np.ndarray, fp: np.ndarray, rep: np.ndarray, depth: int, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """Links between the rows of each cell, as a forest of (rep, rep).

    cell: number of the cell (one for each pair of blocks). side: 0 or 1, of the pair. same: the pair is a block with itself.
    fp: reordered fingerprints; their highest `depth` bits are equal in a cell.
    """
    group = cell * 2 + side
    order = np.lexsort((fp, group))
    group, same, fp, rep = (x[order] for x in (group, same, fp, rep))
    heads = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    tails = np.r_[heads[1:], len(group)]
    key, alone = group[heads], same[heads]
    # a block with itself, or its first side with the second, if there is one
    left = np.flatnonzero(alone | (key % 2 == 0))
    at = np.minimum(np.searchsorted(key, key[left] + 1), len(key) - 1)
    right = np.where(alone[left], left, np.where(key[at] == key[left] + 1, at, -1))
    left, right = left[right >= 0], right[right >= 0]
    forest = Forest(len(fp))
    walk(fp, [heads[left], tails[left], heads[right], tails[right]], depth, budget, forest)
    linked = forest.root != np.arange(len(fp))
    return rep[linked], rep[forest.root[linked]]


def hamming_links(prints: DataFrame, budget: int = BUDGET, block: int = BLOCK, top: int | None = None) -> DataFrame:
    """A forest of links (a, b) that connects exactly the fingerprints within `budget` bits of each other.

    prints: (fp, rep), each fingerprint once; rep names it in the links. A fingerprint goes to one cell for each choice of
    blocks. Cells over `block` members are dealt as pairs of hashed blocks, so a task's rows stay bounded however dense a
    region is. top: blocks on top, by the number of fingerprints if not given; it changes the plan and not the result.
    """
    spark = prints.sparkSession
    rows = prints.count()
    choices, depth = orders(budget, top or blocks_on_top(rows, budget))
    top = len(choices[0]) - budget

    def key(order: list[tuple[int, int]]) -> Column:
        out = F.lit(0).cast("long")
        for first, length in order[:top]:
            out = F.shiftleft(out, length).bitwiseOR(F.shiftrightunsigned("fp", 64 - first - length).bitwiseAND(F.lit((1 << length) - 1).cast("long")))
        return out

    dealt = F.explode(F.array(*[F.struct(F.lit(i).cast("short").alias("choice"), key(order).alias("cell")) for i, order in enumerate(choices)]))
    cells = prints.select("fp", "rep", dealt.alias("x")).select("x.choice", "x.cell", "fp", "rep")
    # large cells: k blocks; every pair of blocks (i <= j) is a task's cell, a row goes to the k pairs its block is in
    hot = cut(cells.groupBy("choice", "cell").count().where(F.col("count") > block).select("choice", "cell", F.ceil(F.col("count") / block).cast("int").alias("k")), "hot")
    if n_hot := hot.count():
        cells = cells.join(small(hot, n_hot), ["choice", "cell"], "left").withColumn("k", F.coalesce("k", F.lit(1)))
    else:
        cells = cells.withColumn("k", F.lit(1))
    own = F.pmod(F.xxhash64("fp"), F.col("k")).cast("int")
    cells = (
        cells.withColumn("s", own)
        .withColumn("o", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
        .select("choice", "cell", "fp", "rep", F.least("s", "o").cast("int").alias("i"), F.greatest("s", "o").cast("int").alias("j"), "s")
    )
    n = parts_for(spark, rows * len(choices), 200_000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = list(batches)
        if not sum(b.num_rows for b in found):
            return
        table = pa.Table.from_batches(found)
        del found
        cols = {c: table.column(c).to_numpy() for c in table.column_names}
        del table
        keys = np.rec.fromarrays([cols["choice"], cols["cell"], cols["i"], cols["j"]])
        cell = np.unique(keys, return_inverse=True)[1].astype(np.int64)
        del keys
        fp = cols["fp"].view(np.uint64)
        value = np.zeros_like(fp)
        for c in np.unique(cols["choice"]):
            mine = cols["choice"] == c
            value[mine] = reordered(fp[mine], choices[c])
        side = np.where(cols["s"] == cols["i"], 0, 1).astype(np.int64)
        a, b = _join_cells(cell, side, cols["i"] == cols["j"], value, cols["rep"], depth, budget)
        for k in range(0, len(a), 65536):
            yield pa.RecordBatch.from_arrays([pa.array(a[k : k + 65536]), pa.array(b[k : k + 65536])], ["a", "b"])

    return cells.repartition(n, "choice", "cell", "i", "j").mapInArrow(run, "a long, b long")


def components(prints: DataFrame, budget: int = BUDGET) -> DataFrame:
    """(fp, group, component_id) of the fingerprints of prints (doc_id, fp) that have a doc_id.

    group: the least fingerprint reachable. component_id: the least doc_id reachable; groups have the same if it repeats.
    """
    distinct = cut(prints.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").cast("long").alias("rep")), "distinct")
    # links are between fingerprints, so a doc_id that repeats with different texts links nothing
    parts = connected_components(hamming_links(distinct.select("fp", F.col("fp").alias("rep")), budget))
    linked = cut(distinct.join(parts, distinct.fp == parts.node).select("fp", "component", "rep"), "linked")
    least = linked.groupBy("component").agg(F.min("rep").alias("component_id"))
    named = linked.join(least, "component").select(F.col("fp").alias("linked_fp"), "component", "component_id")
    return distinct.join(named, distinct.fp == F.col("linked_fp"), "left").select("fp", F.coalesce("component", "fp").alias("group"), F.coalesce("component_id", "rep").alias("component_id"))


def near_duplicates(docs: DataFrame, budget: int = BUDGET) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row of docs (columns doc_id, text; others are ignored).

    Texts whose fingerprints differ in at most `budget` bits are linked; component_id is the least doc_id reachable.
    Null text: fingerprint zero, linked like any other. Rows with a null doc_id get their fingerprint and a null
    component. Repeated rows and doc_ids stay, each with the component of its own fingerprint. No documents: no rows.
    """
    prints = cut(fingerprints(docs), "simhash")
    out = prints.join(components(prints, budget), "fp", "left")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def deduplicate(docs: DataFrame, budget: int = BUDGET) -> DataFrame:
    """One row of docs for each near-duplicate group: of its least doc_id; all columns stay as they are.

    Where an id repeats, each of its rows goes or stays for its own text: of those in one group, the row whose text has the
    least hash stays, then the one whose columns do. Rows with a null doc_id cannot be named as copies and stay.
    """
    prints = cut(fingerprints(docs.select("doc_id", "text")), "simhash")
    found = cut(prints.where("doc_id is not null").join(components(prints, budget), "fp").select("doc_id", "fp", "group", "component_id"), "groups")
    ids = cut(found.groupBy("doc_id").agg(F.min("component_id").alias("c"), F.count("*").alias("n")).where("doc_id <> c or n > 1"), "copies")
    copy_id = fresh(docs, "_copy_id")
    out = docs.join(small(ids.select(F.col("doc_id").alias(copy_id)), ids.count()), docs["doc_id"] == F.col(copy_id), "left_anti")
    doubled = ids.where("n > 1").select("doc_id")
    if (n := doubled.count()) == 0:
        return out
    # ids that repeat: the fingerprints of their texts once more, and the groups that those are the heads of
    row = F.struct(*[docs[c] for c in docs.columns]).alias("row")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    again = cut(docs.join(small(doubled, n), "doc_id", "left_semi").select(row, F.col("doc_id").alias("id"), F.sha2(text, 256).alias("hash"), text.alias("words")), "repeated-ids")
    texts = fingerprints(again.select(F.col("hash").alias("doc_id"), F.col("words").alias("text")).dropDuplicates(["doc_id"])).select(F.col("doc_id").alias("hash"), "fp")
    heads = found.join(small(doubled, n), "doc_id", "left_semi").where("doc_id = component_id").select(F.col("doc_id").alias("id"), "fp", "group").distinct()
    kept = again.join(texts, "hash").join(heads, ["id", "fp"]).select("id", "group", "hash", "row", F.sha2(F.to_json("row"), 256).alias("columns"))
    first = kept.groupBy("id", "group").agg(F.min_by("row", F.struct("hash", "columns")).alias("row"))
    return out.unionByName(first.select(*[F.col("row")[c].alias(c) for c in docs.columns]))
