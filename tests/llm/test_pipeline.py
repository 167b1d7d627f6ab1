import os
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from gridloom.llm import decontam, langid, pii, simhash
from gridloom.llm.common import cut, range_index, range_plan, scratch

SF = "/root/testdata/sf0.001"


def test_each_stage_works_on_what_the_one_before_kept(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = cut(stage(spark, docs, SF), "test-stage")
        before, after = {r.doc_id: r for r in docs.collect()}, {r.doc_id: r for r in out.collect()}
        assert set(after) <= set(before) and len(after) == out.count()
        if k < 4:
            assert out.columns == docs.columns
        if name == "language_id":
            model = langid.fit(docs)
            rejected = {r.doc_id for r in langid.identify(docs, model).where("lang_pred = 'und' or score < 0.35").collect()}
            assert set(before) - set(after) == rejected
        if name == "near_dedup":
            groups = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs).collect()}
            assert set(after) == set(groups.values())
        if name == "decontamination":
            assert set(before) - set(after) == {r.doc_id for r in decontam.contained_items(docs, items).collect()}
        if name == "pii":
            assert set(after) == set(before)
            assert not any(pii.emails(r.text) for r in after.values())
        if name == "bpe":
            assert set(after) == set(before) and all(r.exact and r.n_tokens == len(r.ids) for r in after.values())
        docs = out


def plain_pipeline(rows, items):
    """{doc_id: ids} by plain Python over all rows (doc_id, text, lang), without any of the operators."""
    from tests.llm import test_bpe, test_decontam, test_langid, test_pii, test_simhash

    learn = [(t, lang) for i, t, lang in rows if t is not None and lang is not None and zlib.crc32(str(i).encode()) % 4 != 2]
    said = test_langid.brute(learn, [t or "" for _, t, _ in rows])
    kept = [(i, t) for (i, t, _), (lang, score) in zip(rows, said) if lang != "und" and score >= 0.35]
    group = test_simhash.brute_components([(i, test_simhash.brute_print(t)) for i, t in kept])
    kept = [(i, t) for i, t in kept if group[i] == i]
    known = [s for _, text in items if (s := test_decontam.shingles(text))]
    kept = [(i, t) for i, t in kept if not any(len(s & test_decontam.shingles(t)) >= 0.8 * len(s) for s in known)]
    terms = test_pii.disclosed([t for _, t in kept])
    out = {}
    for i, t in kept:
        spans = sorted({*[(a, -b, k) for k, a, b in test_pii.brute(t)], *[(a, -b, "term") for a, b in terms[t]]})
        parts, at = [], 0
        for a, b, kind in spans:
            if a >= at:
                parts += [t[at:a], f"[{kind.upper()}]"]
            at = max(at, -b)
        out[i] = test_bpe.LIBRARY.encode("".join([*parts, t[at:]]), add_special_tokens=False).ids
    return out


def test_run_equals_plain_python(spark):
    """The whole pipeline over the whole smallest table."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    got = corpus_pipeline.run(spark, SF).collect()
    want = plain_pipeline([(r.doc_id, r.text, r.lang) for r in docs], items)
    assert 0 < len(got) < len(docs) and all(r.exact for r in got)
    assert {r.doc_id: list(r.ids) for r in got} == want


def test_stages_take_odd_and_empty_tables(spark, odd_docs, no_docs):
    for docs in (odd_docs, no_docs):
        for _, stage in corpus_pipeline.STAGES:
            docs = cut(stage(spark, docs, SF), "test-stage")
        assert docs.columns == ["doc_id", "lang", "source", "n_tokens", "ids", "exact"]


@pytest.mark.parametrize("keys", [[5], list(range(0, 1000, 7)), [1] * 50 + [10**15, -(10**15)] + list(range(100)), [None] * 60 + [3] * 60 + [-(2**63), 2**63 - 1], [None]])
def test_ranges_follow_keys_and_ties(spark, keys):
    rows = [(k, i * 7919 % 1000) for i, k in enumerate(keys)]
    df = spark.createDataFrame(rows, "k long, t long")
    ranges = range_plan(df, "k", F.lit(10), 100, F.col("t"), 1000, fine=16)
    got = [(r.k is not None, r.k or 0, r.t, r.i) for r in df.select("k", "t", range_index(F.col("k"), ranges, F.col("t")).alias("i")).collect()]
    assert [x[3] for x in sorted(got)] == sorted(x[3] for x in got) and len(got) == len(keys)  # in order
    sizes = Counter(x[3] for x in got)
    assert set(sizes) == set(range(len(ranges))) and max(sizes.values()) <= 30


def test_a_plan_has_a_bounded_number_of_ranges_and_jobs(spark):
    df = spark.range(20000).select((F.col("id") * F.col("id")).alias("k"))
    before = len(spark.sparkContext.statusTracker().getJobIdsForGroup())
    ranges = range_plan(df, "k", F.lit(10), 10, most=50, fine=16)
    assert 20 < len(ranges) <= 50 and len(spark.sparkContext.statusTracker().getJobIdsForGroup()) - before < 20


def test_scratch_tables_go_and_kept_ones_stay(spark):
    with scratch(spark):
        gone, stays = cut(spark.range(3), "gone"), cut(spark.range(4), "stays", kept=True)
    assert stays.count() == 4 and not any(os.path.exists(p.removeprefix("file://").removeprefix("file:")) for p in gone.inputFiles())
