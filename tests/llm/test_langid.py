import math
import zlib

from gridloom.llm import langid


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.identify(docs, langid.fit(docs)).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 0.99 * len(got) and all(0 <= r.score <= 1 for r in got)


def test_words_come_before_grams_and_grams_from_long_to_short(spark):
    import numpy as np

    row = lambda *x: np.array(x, float)
    m = langid.Model.of(["a", "b"], {"known": row(-1, -9)}, {"know": row(-9, -1), "zz": row(-1, -5), "q": row(-7, -2)})
    s = langid.Scorer(m)
    assert s.predict("known")[0] == "a" and s.predict("knowz")[0] == "b" and s.predict("azza")[0] == "a" and s.predict("xqx")[0] == "b"
    assert s.predict("xxx") == ("a", 0.5)  # nothing known: a tie, the first language


def test_odd_rows(odd_docs, no_docs, spark):
    model = langid.fit(odd_docs)
    got = {r.doc_id: r for r in langid.identify(odd_docs, model).collect()}
    assert got[3].lang_pred == got[4].lang_pred == got[5].lang_pred == "und" and got[4].score == 0
    assert got[9].lang_pred == got[10].lang_pred and got[None].lang_pred in ("en", "de", "fr")
    assert langid.identify(no_docs, model).count() == 0
    empty = langid.fit(no_docs)
    assert {r.lang_pred for r in langid.identify(odd_docs, empty).collect()} == {"und"}
    kept = langid.keep_identified(odd_docs, model=model)
    assert kept.columns == odd_docs.columns and not {3, 4, 5} & {r.doc_id for r in kept.collect()} and kept.where("doc_id = 1").count() == 1


def test_letters_and_marks():
    words = langid.words_of
    assert words("½ ² Ⅷ 3 _ ①") == [] and words("naïve ça 中文 x²y देवनागरी") == ["naïve", "ça", "中文", "x", "y", "देवनागरी"]
    assert all(bool(words(chr(c))) == chr(c).isalpha() for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    assert words("İx naïve \U000e0100") == langid.WORD.findall("İx naïve \U000e0100".lower()) and words("") == []


def test_long_words_are_learned_whole(spark):
    head, tails = "q" * langid.WORD_CHARS, {"a": "zyzy", "b": "wvwv"}
    docs = spark.createDataFrame([(i, f"{head}{tails['ab'[i % 2]]} ½ ²", "ab"[i % 2]) for i in range(60)] + [(100, "½ ²", None), (101, "zyz", None), (102, head + "wvw", None)], "doc_id long, text string, lang string")
    got = {r.doc_id: r.lang_pred for r in langid.identify(docs, langid.fit(docs)).collect()}
    assert got[100] == "und" and got[101] == "a" and got[102] == "b"


def brute(rows, texts):
    """Scores by plain counting: rows (text, lang) that the model learns from."""
    languages = sorted({lang for _, lang in rows})
    counts = {k: {} for k in range(langid.LONGEST + 1)}
    for text, lang in rows:
        for w in langid.WORD.findall(text.lower()):
            for k in range(langid.LONGEST + 1):
                for g in [w] if not k else langid.grams_of(w, k):
                    counts[k].setdefault(g, dict.fromkeys(languages, 0))[lang] += 1
    sums = {k: {lang: sum(c[lang] for c in by.values()) for lang in languages} for k, by in counts.items()}

    def of(w):
        for k in (0, 4, 3, 2, 1):
            known = [g for g in ([w] if not k else langid.grams_of(w, k)) if sum(counts[k].get(g, {}).values()) >= 2]
            if known:
                return [sum(math.log((counts[k][g][lang] + 0.1) / (sums[k][lang] + 1000.0)) for g in known) / len(known) for lang in languages]
        return [0.0] * len(languages)

    out = []
    for text in texts:
        words = langid.WORD.findall(text.lower())
        rows_of = [of(w) for w in words]
        total = [sum(r[i] for r in rows_of) - sum(map(max, rows_of)) for i in range(len(languages))]
        scaled = [(x - max(total)) * min(1.0, langid.SURE_WORDS / len(words)) for x in total]
        p = [math.exp(x) / sum(map(math.exp, scaled)) for x in scaled]
        out.append((languages[p.index(max(p))], max(p)) if words else ("und", 0.0))
    return out


def test_scores_equal_plain_counting(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("text is not null")
    rows = docs.collect()
    learn = [(r.text, r.lang) for r in rows if r.lang is not None and zlib.crc32(str(r.doc_id).encode()) % 4 != 2]
    short = [r for r in rows if len(r.text) < 1500]
    want = {r.doc_id: w for r, w in zip(short, brute(learn, [r.text for r in short]))}
    got = {r.doc_id: r for r in langid.identify(docs, langid.fit(docs)).collect()}
    assert len(want) > 50
    for i, (lang, score) in want.items():
        assert abs(got[i].score - score) < 1e-9 and (got[i].lang_pred == lang or score < 0.26)
