import base64
import gzip
import hashlib
import io

import pytest

from gridloom.llm import warc
from gridloom.llm.common import scratch_path
from tests.oracle import run_sql, same


def test_equals_sql(spark):
    sf = "/root/testdata/sf0.01"
    got = warc.round_trip(spark.read.parquet(f"{sf}/pages.parquet")).drop("file")
    assert same(got.toPandas(), run_sql(warc.ORACLE_SQL, sf))


ROWS = [(1, "http://a/", "same"), (2, "http://b/\r\nX: y", "same"), (9, None, "same"), (9, None, "same"), (3, "u", None), (4, "u", ""), (None, "n", "alone"), (None, "n", "same"), (5, "l", "é" * 100_000), (6, "u", "a\r\n\r\nb")]


def test_odd_rows_round_trip(spark):
    pages = spark.createDataFrame([(*r, "x", 1) for r in ROWS], "page_id long, url string, html string, shard string, kind int")
    folder = scratch_path(spark, "warc-test")
    manifest = warc.write_archives(pages, folder, shard_bytes=300, roll_bytes=400)
    got = warc.read_archives(spark, folder, manifest).collect()
    assert sorted((r.page_id or 0, r.payload_bytes) for r in got) == sorted((i or 0, len((h or "").encode())) for i, _, h in ROWS)
    for r in got:
        if r.record_type == "response":
            assert r.payload_digest == base64.b32encode(hashlib.sha1(r.payload.encode()).digest()).decode() and r.refers_to is None
    kinds = sorted((r.page_id or 0, r.record_type, r.refers_to) for r in got if r.payload_bytes == 4)
    assert kinds == [(0, "revisit", 9), (1, "revisit", 9), (2, "revisit", 9), (9, "response", None), (9, "revisit", 9)]
    assert [(r.record_type, r.refers_to) for r in sorted((r for r in got if r.payload_bytes == 0), key=lambda r: r.page_id)] == [("revisit", 4), ("response", None)]
    assert len({r.file for r in got}) > 1


def test_same_bytes_again_and_readable_members(spark):
    pages = spark.createDataFrame(ROWS, "page_id long, url string, html string")
    sums = []
    for dealt in (pages.coalesce(1), pages.repartition(6)):
        folder = scratch_path(spark, "warc-test")
        m = warc.write_archives(dealt, folder, shard_bytes=2000)
        sums.append(sorted((r.file, r.sha256) for r in m.collect()))
        for name, sha in sums[-1]:
            with open(f"{folder.removeprefix('file://')}/{name}", "rb") as f:
                raw = f.read()
            assert hashlib.sha256(raw).hexdigest() == sha and gzip.decompress(raw).startswith(b"WARC/1.1\r\n")
    assert sums[0] == sums[1]


def test_small_payloads_are_not_revisited(spark):
    pages = spark.createDataFrame(ROWS[:3], "page_id long, url string, html string")
    folder = scratch_path(spark, "warc-test")
    got = warc.read_archives(spark, folder, warc.write_archives(pages, folder, revisit_bytes=5)).collect()
    assert {r.record_type for r in got} == {"response"}


def test_no_pages(spark):
    assert warc.round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_one_page_id_and_null_ids_are_split(spark):
    rows = [(7 if k % 2 else None, f"http://h/{k}", f"text {k % 150} " * 20) for k in range(300)]
    folder = scratch_path(spark, "warc-test")
    manifest = warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string"), folder, shard_bytes=4000)
    got = warc.read_archives(spark, folder, manifest).collect()
    assert sorted((r.page_id or 0, r.payload_digest) for r in got) == sorted((i or 0, warc.payload_digest(h.encode())) for i, _, h in rows)
    assert len({r.file.split("-")[1] for r in got if r.page_id is None}) > 5 and len({r.file.split("-")[1] for r in got if r.page_id}) > 5
    assert sum(r.record_type == "response" for r in got) == 150


def test_a_task_that_runs_again_leaves_the_same_archive(spark):
    pages = spark.createDataFrame(ROWS, "page_id long, url string, html string")
    folder = scratch_path(spark, "warc-test")
    first = warc.write_archives(pages, folder, shard_bytes=2000)
    again = warc.write_archives(pages, folder, shard_bytes=2000)  # over the parts that are there
    assert sorted(map(tuple, first.collect())) == sorted(map(tuple, again.collect()))
    assert warc.read_archives(spark, folder, first).count() == len(ROWS)


def test_damage_is_an_error(spark):
    pages = spark.createDataFrame(ROWS, "page_id long, url string, html string")
    folder = scratch_path(spark, "warc-test")
    manifest = warc.write_archives(pages, folder)
    path = f"{folder.removeprefix('file://')}/{manifest.first().file}"
    with open(path, "rb") as f:
        raw = f.read()
    for bad in (raw[:-20], raw[:100] + bytes([raw[100] ^ 255]) + raw[101:], raw + gzip.compress(b"WARC/1.1\r\n\r\n")):
        with open(path, "wb") as f:
            f.write(bad)
        with pytest.raises(Exception):
            warc.read_archives(spark, folder, manifest).collect()


def test_members_over_many_reads():
    parts = [b"", b"a", b"b" * 5000, bytes(range(256)) * 300]
    raw = b"".join(gzip.compress(p) for p in parts)
    for step in (1, 7, 1 << 16):
        assert list(warc.members(io.BytesIO(raw), step)) == parts
