"""Personal data: patterns for the entities themselves, and corpus co-occurrence for the terms that give them away.

Every entity found (email, ip, card, phone) has windows: the words next to it. What a term tells of an entity is measured
in bits, over the words of all different texts (copies tell no more than one of them): the entity's surprisal is that of its
share of all word places, and falls to that of its share of the term's places once the term is read. A term discloses an
entity if at most MOST_LEFT bits are left and at least LEAST_GAIN bits are gained. It also has to stand beside the entity
more than once, and in several different windows of it (in all, if they are fewer). Such terms are spans too, wherever they
stand in any text: beside the entity, further off, and in texts that do not name it.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import Bloom, cut, fresh, small, trim

KINDS = ("email", "ip", "card", "phone")
AT = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: A number's first digit never follows a digit where a match can begin, so the look-behind only saves retries.
IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
NOT_DIGIT = re.compile(r"[^0-9]+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
WORD = re.compile(r"[^\W\d_]{3,}")
#: Words of which a worker remembers what the filter says.
KEPT_WORDS = 200_000
#: Words on each side of an entity that can disclose it, and the characters in which they are looked for.
SIDE_WORDS, SIDE_CHARS = 5, 160
#: Bits of an entity's surprisal that may be left when a term is read for it to be disclosed, and that must be gained.
MOST_LEFT, LEAST_GAIN = 1.0, 1.0
#: Places that a term is taken to have besides those seen: with two, a term seen twice passes only if it stands nowhere else.
SMOOTH = 2
#: Different windows of an entity that must hold the term (all, if it has fewer), and places beside it: one shows nothing.
LEAST_WINDOWS, LEAST_TIMES = 3, 2


def luhn(digits: str) -> bool:
    doubled = (sum(divmod(2 * int(c), 10)) for c in digits[-2::-2])
    return (sum(map(int, digits[-1::-2])) + sum(doubled)) % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches; each `@` is extended to the left instead of trying every start."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        m = AT.match(text, at) if start < at else None
        if m:
            free = m.end()
            out.append((start, free))
        at = text.find("@", max(at + 1, free))
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind as in KINDS, then start; code points, end exclusive."""
    out = [("email", a, b) for a, b in emails(text)] if "@" in text else []
    for m in IP.finditer(text):
        if all(len(p := x.lstrip("0")) <= 3 and int(p or 0) <= 255 for x in m.group().split(".")):
            out.append(("ip", *m.span()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(d := NOT_DIGIT.sub("", m.group())) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= len(NOT_DIGIT.sub("", m.group())) <= 15:
                out.append(("phone", *m.span()))
    return out


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def blanked(text: str, spans: list[tuple[str, int, int]]) -> str:
    """text with blanks in the place of each span."""
    masked = list(text)
    for _, a, b in spans:
        masked[a:b] = " " * (b - a)
    return "".join(masked)


def windows(text: str, spans: list[tuple[str, int, int]]) -> list[dict]:
    """The words beside each span, outside all spans: entity and window as hashes, the term and its place.

    again: the same place was already beside an earlier span of this entity, so it is no further occurrence.
    """
    out, seen = [], set()
    blank = blanked(text, spans) if spans else ""
    for kind, a, b in spans:
        lo, hi = max(0, a - SIDE_CHARS), min(len(text), b + SIDE_CHARS)
        near = [m for m in WORD.finditer(blank, lo, hi) if (m.start() > lo or not lo) and (m.end() < hi or hi == len(text))]
        found = [m for m in near if m.end() <= a][-SIDE_WORDS:] + [m for m in near if m.start() >= b][:SIDE_WORDS]
        entity = _signed(xxhash.xxh64_intdigest(f"{kind} {text[a:b]}".encode()))
        window = _signed(xxhash.xxh64_intdigest(" ".join(m.group().lower() for m in found).encode()))
        out += [{"entity": entity, "window": window, "term": m.group().lower(), "start": m.start(), "end": m.end(), "again": (entity, m.start()) in seen} for m in found]
        seen.update((entity, m.start()) for m in found)
    return out


_NEAR = "array<struct<entity: long, window: long, term: string, start: int, end: int, again: boolean>>"


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, base, n_email, n_ip, n_card, n_phone, near) of every row of docs."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    near_type = pa.list_(pa.struct([("entity", pa.int64()), ("window", pa.int64()), ("term", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("again", pa.bool_())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t.as_py() or "" for t in b.column(2)]
            spans = [base_spans(t) for t in texts]
            counts = [Counter(k for k, _, _ in s) for s in spans]
            near = pa.array([windows(t, s) if s else [] for t, s in zip(texts, spans)], near_type)
            cols = [b.column(0), b.column(1), pa.array([joined(s) for s in spans], pa.string()), *(pa.array([c[k] for c in counts], pa.int64()) for k in KINDS), near]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "text_key", "base", *(f"n_{k}" for k in KINDS), "near"])

    text = F.col("text").cast("string")
    counts = ", ".join(f"n_{k} long" for k in KINDS)
    return docs.select("doc_id", text_key(text).alias("text_key"), text).mapInArrow(run, f"doc_id {kind}, text_key string, base string, {counts}, near {_NEAR}")


def text_key(text: Column) -> Column:
    return F.md5(F.coalesce(text, F.lit("")))


class Known(dict):
    """Word -> itself in lower case if a filter lets it pass, else an empty text; as windows() writes terms."""

    def __init__(self, maybe: Bloom):
        self.maybe = maybe

    def __missing__(self, word: str) -> str:
        if len(self) > KEPT_WORDS:
            self.clear()
        low = word.lower()
        self[word] = term = low if self.maybe(low) else ""
        return term


def term_totals(docs: DataFrame, terms: DataFrame) -> tuple[DataFrame, int]:
    """(term, total): at how many places of all different texts of docs each of the terms stands, and all words' places.

    Texts that stand once are summed by the task that reads them. Those that may be copies, by a filter of the copied ones'
    hashes, are counted text by text, and equal counts of equal texts become one. Texts are told apart by 64 bits.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    copied = cut(docs.select(F.xxhash64(text).alias("text")).groupBy("text").agg(F.count("*").alias("n")).where("n > 1").select("text"), "copied-texts")
    sent, twice = spark.sparkContext.broadcast(Bloom(terms, "term")), spark.sparkContext.broadcast(Bloom(copied, "text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, may_repeat = Known(sent.value), twice.value
        for b in batches:
            rows: list[tuple] = []
            single: Counter = Counter()

            def add(key: int | None, found: Counter) -> None:
                kept: Counter = Counter()
                for word, n in found.items():
                    if term := known[word]:
                        kept[term] += n
                rows.append((key, None, sum(found.values())))
                rows.extend((key, term, n) for term, n in kept.items())

            seen: set[int] = set()
            for key, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if not may_repeat(key):
                    single.update(WORD.findall(t))
                elif key not in seen:
                    seen.add(key)
                    add(key, Counter(WORD.findall(t)))
            add(None, single)
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.string(), pa.int64()))], ["text", "term", "n"])

    counted = docs.select(F.xxhash64(text).alias("text"), text).mapInArrow(run, "text long, term string, n long")
    # summed where no text is named; one of each where one is
    each = counted.groupBy("text", "term").agg(F.when(F.col("text").isNull(), F.sum("n")).otherwise(F.max("n")).alias("n"))
    counts = cut(each.groupBy("term").agg(F.sum("n").alias("total")), "term-totals")
    words = counts.where("term is null").first()
    return counts.where("term is not null").join(terms, "term", "left_semi"), words["total"] if words else 0


def occurrences(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(text_key, start, end): every place outside the entities, in all of docs, where one of the terms stands.

    The filter leaves out texts and words that cannot be meant; what it lets through is joined with the terms themselves.
    """
    sent = docs.sparkSession.sparkContext.broadcast(Bloom(terms, "term"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Known(sent.value)
        for b in batches:
            rows: list[tuple] = []
            for key, t in zip(b.column(0), b.column(1).to_pylist()):
                # without an address, the words outside the entities are words of the text
                if "@" not in t and not any(map(known.__getitem__, {*WORD.findall(t)})):
                    continue
                blank = blanked(t, spans) if (spans := base_spans(t)) else t
                name = None
                for m in WORD.finditer(blank):
                    if term := known[m.group()]:
                        name = name or key.as_py()
                        rows.append((name, term, m.start(), m.end()))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.string(), pa.int32(), pa.int32()))], ["text_key", "term", "start", "end"])

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    found = docs.select(text_key(text).alias("text_key"), text.alias("text")).mapInArrow(run, "text_key string, term string, start int, end int")
    return found.join(small(terms), "term", "left_semi").select("text_key", "start", "end").distinct()


def bits(times: Column, total: Column, slots: Column, words: int) -> tuple[Column, Column]:
    """Bits of an entity's surprisal that are left when a term is read, and bits gained (their pointwise mutual information).

    The entity has `slots` of all `words` places beside it; the term stands beside it at `times` of its `total` places,
    smoothed by SMOOTH more places that are as likely beside it as any.
    """
    before = slots / F.lit(float(max(1, words)))
    after = (times + SMOOTH * before) / (total + SMOOTH)
    return -F.log2(after), F.log2(after / before)


def disclosing(docs: DataFrame, scanned: DataFrame, most_left: float = MOST_LEFT, least_gain: float = LEAST_GAIN) -> DataFrame:
    """(text_key, terms): the spans of disclosing terms, joined as text, of every text of docs that has any."""
    # a text counts once, however many rows have it
    near = scanned.where(F.size("near") > 0).select("text_key", "near").dropDuplicates(["text_key"]).select(F.explode("near").alias("x")).select("x.*")
    near = cut(near.select("entity", "term", "window", "again"), "near")
    joint = near.groupBy("entity", "term").agg(F.count_distinct("window").alias("windows"), F.count_if(~F.col("again")).alias("times")).where(F.col("times") >= LEAST_TIMES)
    each = near.groupBy("entity").agg(F.least(F.count_distinct("window"), F.lit(LEAST_WINDOWS)).alias("asked"), F.count_if(~F.col("again")).alias("slots"))
    pairs = cut(joint.join(each, "entity").where(F.col("windows") >= F.col("asked")), "joint")
    terms = cut(pairs.select("term").distinct(), "terms")
    if terms.isEmpty():  # no term can pass, so the corpus need not be read again
        return scanned.sparkSession.createDataFrame([], "text_key string, terms string")
    totals, words = term_totals(docs, terms)
    left, gain = bits(F.col("times"), F.col("total"), F.col("slots"), words)
    passed = cut(pairs.join(totals, "term").where((left <= most_left) & (gain >= least_gain)).select("entity", "term"), "disclosing")
    if passed.isEmpty():
        return scanned.sparkSession.createDataFrame([], "text_key string, terms string")
    spans = occurrences(docs, passed.select("term").distinct())
    listed = spans.groupBy("text_key").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("s"))
    return listed.select("text_key", F.array_join(F.transform("s", lambda x: F.concat(F.lit("term:"), x["start"], F.lit(":"), x["end"])), ",").alias("terms"))


def find(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base, spans) of every row of docs; other columns are ignored.

    Null and empty texts have no spans. Repeated rows each have theirs and count once. No documents: no rows. Texts are
    read whole, however long. base and spans are `kind:start:end`, joined by
    commas, by kind (email, ip, card, phone, then term) and start.
    """
    scanned = cut(scan(docs), "pii")
    terms = cut(disclosing(docs, scanned), "term-spans")
    out = scanned.drop("near").join(small(terms, terms.count()), "text_key", "left")
    return out.select("doc_id", *(f"n_{k}" for k in KINDS), "base", F.concat_ws(",", F.nullif("base", F.lit("")), "terms").alias("spans"))


def span_digests(docs: DataFrame) -> DataFrame:
    found = find(docs)
    return found.select("doc_id", *(f"n_{k}" for k in KINDS), F.sha2("base", 256).alias("base_sha256"), "spans")


def replaced(text: str, spans: list[tuple[int, int, str]]) -> str:
    """text with each span replaced by its kind; where spans overlap, the one that starts first covers the rest it meets."""
    out, at = [], 0
    for a, b, kind in sorted(spans, key=lambda s: (s[0], -s[1], s[2])):
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def sanitise(docs: DataFrame) -> DataFrame:
    """docs with personal data and disclosing terms in `text` replaced by their kind; all columns and rows stay.

    n_chars, where docs has it, follows the new text. Null texts stay null. Repeated rows stay and count once; no
    documents: no rows.
    """
    scanned = cut(scan(docs).where(F.size("near") > 0), "pii")
    key, found = fresh(docs, "_key"), fresh(docs, "_terms")
    terms = cut(disclosing(docs, scanned).select(F.col("text_key").alias(key), F.col("terms").alias(found)), "term-spans")
    n_terms, text = terms.count(), docs.columns.index("text")
    with_terms = docs.join(small(terms, n_terms), text_key(F.col("text")) == F.col(key), "left").drop(key)
    chars = docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            new = []
            for t, extra in zip(b.column(text).to_pylist(), b.column(b.num_columns - 1).to_pylist()):
                if t is not None:
                    spans = [(a, e, k) for k, a, e in base_spans(t)]
                    spans += [(int(a), int(e), k) for k, a, e in (x.split(":") for x in extra.split(","))] if extra else []
                    t = replaced(t, spans) if spans else t
                new.append(t)
            cols = list(b.columns[:-1])
            cols[text] = pa.array(new, cols[text].type)
            if chars is not None:
                size = pa.array([None if t is None else len(t) for t in new], pa.int64()).cast(cols[chars].type)
                cols[chars] = size
            yield pa.RecordBatch.from_arrays(cols, b.schema.names[:-1])
        trim()

    return with_terms.mapInArrow(run, docs.schema)
