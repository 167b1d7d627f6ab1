"""Language identification: known words by their log frequency per language, unseen words by ever shorter n-grams."""

from __future__ import annotations

import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import cut, held_out, trim

def _ranges(wanted) -> str:
    """A character class body of the code points of which `wanted` is true."""
    out, start = [], None
    for c in range(0x3_3000):  # no letter is beyond; the marks beyond are variation selectors
        if wanted(chr(c)) != (start is not None):
            if start is not None:
                out.append(f"{re.escape(chr(start))}-{re.escape(chr(c - 1))}")
            start = c if start is None else None
    return "".join(out) + ("" if start is None else f"{re.escape(chr(start))}-{chr(c)}")


_LETTER = _ranges(str.isalpha)
#: Letters, and the marks that stand on them; numbers written with letters or signs (\u2167, \u00bd) are none.
WORD = re.compile(f"[{_LETTER}][{_LETTER}{_ranges(lambda c: unicodedata.category(c)[0] == 'M')}\U000e0100-\U000e01ef]*")
#: Where none of these stands, a simpler and faster pattern finds the same words.
ODD = frozenset(c for c in map(chr, range(0x3_3000)) if unicodedata.category(c)[0] == "M" or (c.isalnum() and not c.isalpha() and not c.isdecimal()))
PLAIN = re.compile(r"[^\W\d_]+")
#: Labelled documents of each language that the model is fitted on, about (by a hash of the id); it keeps about so many of
#: the most frequent words and n-grams of that sample, so the model's size does not follow the corpus.
SAMPLE_DOCS, MODEL_WORDS, MODEL_GRAMS, LONGEST = 4000, 60_000, 60_000, 4
#: Longer words are no words of a language: they are learned and scored by the n-grams of their pieces of this length.
WORD_CHARS = 60
#: Words whose scores a worker keeps, and words of a batch that are summed at once.
KEPT_WORDS, SUM_WORDS = 150_000, 1 << 17
#: Evidence counts as that of so many words at most when scores become a probability.
SURE_WORDS = 12


@dataclass
class Model:
    """words and grams: the row of each unit's log frequencies by language."""

    languages: list[str]
    words: dict[str, int]
    grams: dict[str, int]
    rows: np.ndarray

    @classmethod
    def of(cls, languages: list[str], words: dict[str, np.ndarray], grams: dict[str, np.ndarray]) -> Model:
        rows = [*words.values(), *grams.values()]
        at = {k: i for i, k in enumerate(words)}, {k: len(words) + i for i, k in enumerate(grams)}
        return cls(languages, *at, np.array(rows, np.float64).reshape(len(rows), len(languages)))


def grams_of(word: str, k: int) -> list[str]:
    s = f"^{word}$"
    return [s[i : i + k] for i in range(len(s) - k + 1)]


def words_of(text: str) -> list[str]:
    """The words of a text in lower case."""
    low = text.lower()
    plain = low.isascii() or (ODD.isdisjoint(chars := set(low)) and max(chars) < "\U000e0100")
    return (PLAIN if plain else WORD).findall(low)


def pieces(word: str) -> list[str]:
    return [word] if len(word) <= WORD_CHARS else [word[i : i + WORD_CHARS] for i in range(0, len(word), WORD_CHARS)]


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    by: dict[str, Counter] = defaultdict(Counter)

    def flush() -> Iterator[pa.RecordBatch]:
        for lang, words in by.items():
            kinds = [Counter({w: n for w, n in words.items() if len(w) <= WORD_CHARS}), *(Counter() for _ in range(LONGEST))]
            for w, n in words.items():
                for piece in pieces(w):
                    for k in range(1, LONGEST + 1):
                        for g in grams_of(piece, k):
                            kinds[k][g] += n
            for k, found in enumerate(kinds):
                rows = [(g, n) for g, n in found.items()]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(rows), pa.string()), pa.array([k] * len(rows), pa.int32()), pa.array([g for g, _ in rows], pa.string()), pa.array([n for _, n in rows], pa.int64())], ["lang", "size", "unit", "n"])
        by.clear()

    for b in batches:
        for text, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            by[lang].update(words_of(text))
            if sum(map(len, by.values())) > KEPT_WORDS:
                yield from flush()
    yield from flush()


def _least_total(sizes: dict[int, int], most: int) -> int:
    """The least count such that at most `most` units have it or more; sizes: how many units have each count."""
    kept = 0
    for total, n in sorted(sizes.items(), reverse=True):
        kept += n
        if kept > most:
            return total + 1
    return 2


def fit(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> Model:
    """A model of the non-null languages of the documents that are not held out, from about sample_docs of each.

    Repeated rows count as often as they stand. Of the units seen at least twice, those are kept whose count is so high that
    at most MODEL_WORDS words and MODEL_GRAMS n-grams have it: ties stay or go together, and no more reach the driver.
    """
    train = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where(~held_out() & F.col("text").isNotNull() & F.col("lang").isNotNull())
    sizes = {r["lang"]: r["n"] for r in train.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return Model.of([], {}, {})
    share = F.create_map(*[F.lit(x) for lang, n in sorted(sizes.items()) for x in (lang, min(1.0, sample_docs / n))])
    # which documents: by a hash of the id, so the sample is the same however the table is dealt
    u = F.pmod(F.xxhash64("doc_id", F.lit("language sample")), F.lit(1 << 20)) / float(1 << 20)
    sample = train.where(u < share[F.col("lang")]).select("text", "lang")
    counts = sample.mapInArrow(_counts, "lang string, size int, unit string, n long").groupBy("size", "unit", "lang").agg(F.sum("n").alias("n"))
    each = F.map_from_entries(F.collect_list(F.struct("lang", "n"))).alias("by")
    units = cut(counts.groupBy("size", "unit").agg(F.sum("n").alias("total"), each), "language-units")
    sums = {(r["size"], r["lang"]): r["n"] for r in units.select("size", F.explode("by").alias("lang", "n")).groupBy("size", "lang").agg(F.sum("n").alias("n")).collect()}
    word = F.col("size") == 0
    found = units.where("total >= 2").groupBy(word.alias("word"), "total").agg(F.count("*").alias("n")).collect()
    least = [_least_total({r["total"]: r["n"] for r in found if r["word"] == kind}, most) for kind, most in ((True, MODEL_WORDS), (False, MODEL_GRAMS))]
    rows = units.where(F.col("total") >= F.when(word, least[0]).otherwise(least[1])).collect()
    languages = sorted(sizes)
    n = np.array([[r["by"].get(lang, 0) for lang in languages] for r in rows], np.float64).reshape(len(rows), len(languages))
    of = np.array([[sums.get((k, lang), 0) for lang in languages] for k in range(LONGEST + 1)], np.float64)
    at = np.array([r["size"] for r in rows], np.int64)
    words = {r["unit"]: i for i, r in enumerate(rows) if r["size"] == 0}
    grams = {r["unit"]: i for i, r in enumerate(rows) if r["size"]}
    return Model(languages, words, grams, np.log((n + 0.1) / (of[at] + 1000.0)))


class Scorer(dict):
    """Word -> its row in `rows`: log frequencies by language, less the highest of them."""

    def __init__(self, model: Model):
        super().__init__()
        self.model = model
        self.rows = np.zeros((0, len(model.languages)))

    def add(self, words: Iterable[str]) -> None:
        """Score words that have no row yet: known ones by their own row, others by their longest n-grams that are known."""
        known, grams = self.model.words, self.model.grams
        units: list[int] = []
        sizes: list[int] = []
        for word in words:
            at = known.get(word) if len(word) <= WORD_CHARS else None
            found = [at] if at is not None else []
            for k in range(LONGEST, 0, -1):
                if found:
                    break
                found = [grams[g] for p in pieces(word) for g in grams_of(p, k) if g in grams]
            self[word] = len(self)
            units += found
            sizes.append(len(found))
        n = np.array(sizes, np.int64)
        rows = np.zeros((len(n), self.rows.shape[1]))
        if units:
            starts = np.concatenate([[0], np.cumsum(n[n > 0])[:-1]])
            rows[n > 0] = np.add.reduceat(self.model.rows[units], starts, axis=0) / n[n > 0][:, None]
        rows -= rows.max(axis=1, keepdims=True)
        self.rows = np.concatenate([self.rows, rows])

    def _sums(self, words: list[list[str]]) -> np.ndarray:
        """Summed rows of each list of words (none is empty)."""
        ends = np.cumsum([len(w) for w in words])
        ids = np.fromiter(map(self.__getitem__, chain.from_iterable(words)), np.int64, int(ends[-1]))
        if len(words) == 1:
            return (np.bincount(ids, minlength=len(self)) @ self.rows[: len(self)])[None]
        return np.add.reduceat(self.rows[ids], np.concatenate([[0], ends[:-1]]), axis=0)

    def predict_all(self, texts: list[str]) -> tuple[list[str], list[float]]:
        """Languages and scores of texts; ties: the first language in order."""
        langs, scores = ["und"] * len(texts), [0.0] * len(texts)
        which: list[int] = []
        found: list[list[str]] = []
        held = 0

        def flush() -> None:
            nonlocal which, found, held
            if not which:
                return
            if len(self) > KEPT_WORDS:
                self.clear()
                self.rows = self.rows[:0]
            if new := set(chain.from_iterable(found)).difference(self):
                self.add(new)
            n = np.array([len(w) for w in found])
            score = self._sums(found)
            score = (score - score.max(axis=1, keepdims=True)) * np.minimum(1.0, SURE_WORDS / n)[:, None]
            p = np.exp(score)
            p /= p.sum(axis=1, keepdims=True)
            for i, best, x in zip(which, p.argmax(axis=1).tolist(), p.max(axis=1).tolist()):
                langs[i], scores[i] = self.model.languages[best], x
            which, found, held = [], [], 0

        if self.model.languages:
            for i, text in enumerate(texts):
                if words := words_of(text):
                    if held + len(words) > SUM_WORDS:
                        flush()
                    which.append(i)
                    found.append(words)
                    held += len(words)
            flush()
        return langs, scores

    def predict(self, text: str) -> tuple[str, float]:
        langs, scores = self.predict_all([text])
        return langs[0], scores[0]


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row of docs; only the text decides.

    Null text and text without a letter: und, score 0. No labelled documents to learn from: und for all. Words are runs
    of letters and their marks of the whole text in lower case; very long words are scored by all of their pieces. Ties:
    the first language in order. Repeated rows have equal results; no documents: no rows.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(sent.value)
        for b in batches:
            langs, scores = scorer.predict_all([t or "" for t in b.column(2).to_pylist()])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])
        del scorer
        trim()

    return docs.select("doc_id", held_out().alias("held_out"), F.col("text").cast("string")).mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double")


def keep_identified(docs: DataFrame, least: float = 0.35, model: Model | None = None) -> DataFrame:
    """The rows of docs whose language is found with at least that score; all columns stay as they are.

    Rejected: null text, text without a letter, text that fits no language better than the others. Repeated rows stay or go
    together; no documents: no rows.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model or fit(docs))
    text, schema = docs.columns.index("text"), docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(sent.value)
        for b in batches:
            got = scorer.predict_all([str(t or "") for t in b.column(text).to_pylist()])
            yield b.filter(pa.array([lang != "und" and p >= least for lang, p in zip(*got)], pa.bool_()))
        del scorer
        trim()

    return docs.mapInArrow(run, schema)
