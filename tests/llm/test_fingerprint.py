import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st

from gridloom.llm import fingerprint as fp


def lz78(text):
    known, word, out = set(), "", []
    for c in text:
        word += c
        if word not in known:
            known.add(word)
            out.append(word)
            word = ""
    return out


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="abc é", max_size=200))
def test_phrases(text):
    assert fp.phrases(text, 0, set()) == lz78(text)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab", max_size=120), st.text(alphabet="abc", max_size=120))
def test_shared_parse(text, other):
    edited = fp.edited_text(text, other)
    assert fp.parse_with_edit(text, len(text) - len(text) // 3, edited) == (lz78(text), lz78(edited))


def brute(rows):
    """rows: (id, text), in any order; ids differ."""
    rows = sorted(rows, key=lambda r: -r[0])
    out = {}
    for k, (i, t) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        edited = fp.edited_text(t, after)
        a, b, c = (fp.minima(lz78(x)) for x in (t, edited, after))
        out[i] = (len(t), hashlib.sha256(edited.encode()).hexdigest(), fp.written(a), fp.written(b), fp.likeness(a, b), fp.likeness(a, c))
    return out


def test_documents_over_many_ranges(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").repartition(5)
    want = brute([(r.doc_id, r.text or "") for r in docs.collect()])
    for chars in (fp.RANGE_CHARS, 9000):
        got = fp.compare_edits(docs, chars).collect()
        assert {r.doc_id: tuple(r)[1:] for r in got} == want and len(got) == len(want)
    assert sum(w[4] > w[5] for w in want.values()) > 0.95 * len(want)


def test_odd_rows(odd_docs, no_docs, spark):
    got = fp.compare_edits(odd_docs, 1000).collect()
    assert sorted((r.doc_id or -1) for r in got) == sorted((r.doc_id or -1) for r in odd_docs.collect())
    by = {r.doc_id: r for r in got}
    assert by[3].fingerprint == by[4].fingerprint == fp.fingerprint("") and by[1].fingerprint == by[2].fingerprint and by[4].n_chars == 0
    assert by[9].near_next == fp.likeness(fp.minima(lz78("tie tie")), fp.minima(lz78("Ünïcödé 中文 😀 <|endoftext|> text\u0085 with \u2028 odd spaces")))
    assert fp.compare_edits(no_docs).count() == 0
    one = fp.compare_edits(spark.createDataFrame([(1, "abcabc")], "doc_id long, text string")).collect()
    assert one[0].near_next == 1.0 and one[0].edited_sha256 == hashlib.sha256(b"abcaab").hexdigest()
    assert fp.likeness(fp.minima([]), fp.minima([])) == 1.0 and fp.likeness(fp.minima([]), fp.minima(["a"])) == 0.0


def test_hot_and_null_ids_are_split(spark):
    rows = [(7, f"{k * 37 % 200:03d} text of one id") for k in range(200)] + [(None, f"{k * 53 % 200:03d} no id") for k in range(200)] + [(9, "first"), (1, "last")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r.doc_id, r.n_chars, r.edited_sha256, r.near_next) for r in fp.compare_edits(docs, 2000).collect()]
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    want = []
    for k, (i, t) in enumerate(order):
        after = order[(k + 1) % len(order)][1]
        want.append((i, len(t), hashlib.sha256(fp.edited_text(t, after).encode()).hexdigest(), fp.likeness(fp.minima(lz78(t)), fp.minima(lz78(after)))))
    key = lambda r: (r[0] or 0, *r[1:])
    assert sorted(got, key=key) == sorted(want, key=key)
    assert fp.with_next(docs, 2000).where("doc_id = 7 and guest = 0").select("part").distinct().count() > 3
    none = docs.where("doc_id is null")
    assert fp.compare_edits(none, 2000).count() == 200
