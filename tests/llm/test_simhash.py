import random
import re

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from gridloom.llm import components, simhash


def brute_print(text):
    words = re.findall("[^\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    parts = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(pairs):
    """{id: least id reachable} of (id, fingerprint) pairs."""
    up = {i: i for i, _ in pairs}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for n, (i, f) in enumerate(pairs):
        for j, g in pairs[:n]:
            if (f ^ g).bit_count() <= 4:
                a, b = sorted((root(i), root(j)))
                up[b] = a
    return {i: root(i) for i in up}


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="aAbÄé \t\n\x0b\u00a0.", max_size=60))
def test_fingerprint(text):
    assert simhash.fingerprint(text) == brute_print(text)


def test_long_text():
    text = " ".join(f"w{i % 777}" for i in range(40_000))
    assert simhash.fingerprint(text) == brute_print(text)


def test_blocks_cover_all_bits_and_some_choice_agrees():
    rng = random.Random(1)
    for top in (1, 2, 3, 4):
        choices, depth = simhash.orders(4, top)
        for order in choices:
            assert sorted(b for first, length in order for b in range(first, first + length)) == list(range(64))
        for _ in range(200):
            f = rng.getrandbits(64)
            g = f
            for b in rng.sample(range(64), 4):
                g ^= 1 << b
            moved = [simhash.reordered(np.array([f, g], np.uint64), order) for order in choices]
            assert any(int(a ^ b) >> (64 - depth) == 0 for a, b in moved) and all(int(a ^ b).bit_count() == 4 for a, b in moved)
    assert [simhash.blocks_on_top(n, 4) for n in (1, 10**5, 10**7, 10**9, 10**11)] == [1, 1, 2, 3, 4]


@pytest.mark.parametrize(("block", "top"), [(simhash.BLOCK, None), (40, 1), (40, 2), (simhash.BLOCK, 2), (simhash.BLOCK, 3), (30, 4)])
def test_links_equal_brute_force(spark, block, top):
    """Dense groups, chains and strangers; with small blocks the hot cells are split."""
    rng = random.Random(3)
    prints = set()
    for _ in range(12):
        centre = rng.getrandbits(64)
        for _ in range(60):
            f = centre
            for b in rng.sample(range(64), rng.randint(0, 6)):
                f ^= 1 << b
            prints.add(f)
    prints |= {rng.getrandbits(64) for _ in range(900)} | {0, 1, (1 << 64) - 1}
    pairs = list(enumerate(sorted(prints)))
    signed = [(i, int(np.uint64(f).astype(np.int64))) for i, f in pairs]
    links = simhash.hamming_links(spark.createDataFrame(signed, "rep long, fp long"), block=block, top=top)
    found = {r.node: r.component for r in components.connected_components(links).collect()}
    assert {i: found.get(i, i) for i, _ in pairs} == brute_components(pairs)


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    pdf = docs.toPandas()
    want = {int(i): brute_print(t) for i, t in zip(pdf.doc_id, pdf.text)}
    groups = brute_components(sorted(want.items()))
    got = simhash.near_duplicates(docs).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == {i: (f"{f:016x}", groups[i]) for i, f in want.items()}
    kept = simhash.deduplicate(docs)
    assert {r.doc_id for r in kept.select("doc_id").collect()} == set(groups.values()) and kept.columns == docs.columns


def test_odd_rows(odd_docs, no_docs):
    got = simhash.near_duplicates(odd_docs).collect()
    assert len(got) == odd_docs.count()
    by = {r.doc_id: r for r in got}
    assert by[1].component_id == by[2].component_id == 1
    assert by[3].fingerprint == by[4].fingerprint == by[5].fingerprint == "0" * 16 and by[5].component_id == 3
    assert by[None].component_id is None
    kept = simhash.deduplicate(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id) == sorted({r.component_id for r in got if r.doc_id})
    assert kept.where("doc_id is null").count() == 1
    assert simhash.near_duplicates(no_docs).count() == 0 and simhash.deduplicate(no_docs).count() == 0


def test_one_row_of_a_repeated_least_id_for_each_group(spark):
    docs = spark.createDataFrame([(1, "one two three four five"), (1, "one two three four five"), (2, "one two three four five"), (1, "quite other words stand here")], "doc_id long, text string")
    assert sorted((r.doc_id, r.text[:3]) for r in simhash.deduplicate(docs).collect()) == [(1, "one"), (1, "qui")]


def test_components_of_chains_and_hubs(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(5, i) for i in range(6, 90)] + [(300, 300), (88, 110)]
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 5 for i in [*range(5, 90), *range(100, 161)]}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_no_checkpoint_on_local_disks():
    import inspect

    assert "localCheckpoint(" not in inspect.getsource(components) + inspect.getsource(simhash)


def test_an_id_with_different_texts_loses_only_copies(spark):
    base = "one two three four five six seven eight nine ten"
    other, third = "completely different words stand in this text of its own here", "yet another thing that nobody has said before in any row"
    rows = [(1, base, "a"), (5, base, "b"), (5, other, "c"), (7, third, "e"), (7, third, "d"), (8, third, "f"), (None, base, "g")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for dealt in (docs, docs.orderBy("source"), docs.orderBy(F.desc("source"))):
        got = sorted(((r.doc_id or 0), r.text, r.source) for r in simhash.deduplicate(dealt.repartition(3)).collect())
        assert [x[:2] for x in got] == [(0, base), (1, base), (5, other), (7, third)]
        kept = got[-1] if dealt is docs else kept
        assert got[-1] == kept  # the same row, however the rows are dealt
