import random

from gridloom.llm import decontam
from tests.oracle import run_sql, same


def test_equals_sql(spark):
    sf = "/root/testdata/sf0.01"
    got = decontam.contained_items(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet"))
    assert same(got.toPandas(), run_sql(decontam.ORACLE_SQL, sf))


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def test_search_loses_nothing(spark):
    """Items of many sizes, at, above and below the threshold, inside long documents."""
    rng = random.Random(1)
    items = [(k, " ".join(f"w{rng.randrange(3000)}" for _ in range(n))) for k, n in enumerate([1, 3, 5, 6, 7, 9, 12, 14, 20, 40, 41, 80, 150])]
    docs = []
    for k, text in items:
        w = text.split()
        for cut in (0, len(w) // 12, len(w) // 8, len(w) // 6, len(w) // 4):
            filler = [f"w{rng.randrange(3000)}" for _ in range(rng.choice([0, 30, 400]))]
            docs.append((len(docs), " ".join([*filler, *w[cut:], *filler])))
    docs.append((len(docs), items[1][1]))
    want = {}
    for d, t in docs:
        for k, text in items:
            n, f = len(shingles(text)), len(shingles(text) & shingles(t))
            if f >= 0.8 * n:
                want[d, k] = (n, f)
    got = decontam.contained_items(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id): (r.n_item, r.n_found) for r in got} == want and len(want) > 20


def test_odd_rows(odd_docs, no_docs, spark):
    items = spark.createDataFrame([(1, "same WORDS in this text again and again"), (1, "same WORDS in this text again and again"), (2, None), (None, "x"), (3, ""), (4, "tie tie"), (5, "word word word word word")], "item_id long, text string")
    got = decontam.contained_items(odd_docs, items).collect()
    assert sorted((r.doc_id, r.item_id) for r in got) == [(1, 1), (2, 1), (6, 5), (9, 4), (10, 4)]
    kept = decontam.drop_contaminated(odd_docs, items)
    assert kept.columns == odd_docs.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 3, 4, 5, 7, 8]
    assert decontam.contained_items(no_docs, items).count() == 0 and decontam.contained_items(odd_docs, items.limit(0)).count() == 0


def test_no_python_on_the_main_path(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    plan = decontam.contained_items(docs, spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
