"""License scan: sparse TF-IDF cosine to licence templates, then inheritance from the nearest directory.

Lines, and sentences of lines, are compared with one-line notices; runs of words, and whole texts, with headers of several lines and licence texts.

Everything is built-in functions. Template terms are few and fixed; their document frequencies are counted over all texts.
A line or sentence can only reach the threshold if it holds one of the heaviest terms of a template (what is left of the
template without them is too light), so lines without any of those are not taken apart; this loses nothing.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import cut, small
from gridloom.llm.licence_blocks import BLOCKS

# Licence notices as they stand in file headers.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "BSD-3-Clause": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "LGPL-3.0": "This library is licensed under the GNU Lesser General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}
THRESHOLD = 0.75
#: Share of a file's words that must be in matching lines for it to be a licence file, whatever its name.
FILE_SHARE = 0.5
#: A block's run of words begins at each 64th part of the block's length (an 8th, if it has over 256 words; one word at
#: least), and at the last place where it fits: versions of a header differ in a word, so a run must not miss its start.
HEADER_STEPS, BODY_STEPS, HEADER_WORDS = 64, 8, 256
#: Ratio of the levels to which the first bound rounds shares up.
LEVEL = 1.25
#: Where a sentence ends within a line.
SENTENCE_END = r"([.!?])[ \t]+"
LICENCE_NAME = r"(?i)^(licen[cs]e|copying|notice)([._-].*)?$"


def words(text: Column) -> Column:
    """Runs of letters and digits, in lower case."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _words(text: str) -> list[str]:
    return re.findall(r"[^\W_]+", text.lower())


def terms_held(docs: DataFrame, terms: list[str]) -> DataFrame:
    """(text_key, held): which of the terms stand in the text of each row of docs."""
    named = F.array(*[F.lit(t) for t in terms])
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.md5(text).alias("text_key"), F.array_intersect(words(text), named).alias("held"))


def document_frequencies(held: DataFrame) -> tuple[int, dict[str, int]]:
    """Rows of docs, and in how many of them each term stands; a number for each term is all that the driver gets."""
    counts = held.select(F.explode("held").alias("term")).groupBy("term").agg(F.count("*").alias("n"))
    return held.count(), {r["term"]: r["n"] for r in counts.collect()}


def inverse_frequencies(held: DataFrame, terms: list[str]) -> tuple[dict[str, float], float]:
    """Smoothed idf of each of the terms, and that of a word which is none of them."""
    n, df = document_frequencies(held)
    return {t: math.log((n + 1) / (df.get(t, 0) + 1)) + 1 for t in terms}, math.log(n + 1) + 1


def needed_terms(weights: dict[str, float], threshold: float) -> list[str]:
    """The heaviest terms such that the others alone cannot reach the threshold."""
    norm = math.sqrt(sum(w * w for w in weights.values()))
    left, out = norm, []
    for term, w in sorted(weights.items(), key=lambda x: (-x[1], x[0])):
        if left / norm < threshold - 1e-9:
            break
        out.append(term)
        left = math.sqrt(max(0.0, left * left - w * w))
    return out


def licence_lines(docs: DataFrame, templates: dict[str, str] | None = None, threshold: float = THRESHOLD, idfs: tuple[dict[str, float], float] | None = None) -> DataFrame:
    """(doc_id, path, text_words, matches array<struct<score, licence, line_words>>, text_key) of every row of docs (doc_id, path, text).

    matches: the lines, and sentences of lines, whose best template reaches the threshold, with that template (ties: the
    first by name); line_words is 0 for a sentence. idfs, as
    inverse_frequencies makes them, are counted over docs if not given.
    """
    templates = templates or TEMPLATES
    counts = {name: _words(t) for name, t in sorted(templates.items())}
    terms = sorted({w for ws in counts.values() for w in ws})
    idf, unseen = idfs or inverse_frequencies(terms_held(docs, terms), terms)
    weights = {name: {t: ws.count(t) * idf[t] for t in ws} for name, ws in counts.items()}
    needed = sorted({t for w in weights.values() for t in needed_terms(w, threshold)})
    holds = r"(?iu)(?<![\p{L}\p{N}])(" + "|".join(map(re.escape, needed)) + r")(?![\p{L}\p{N}])"

    idf_map = F.create_map(*[F.lit(x) for t in terms for x in (t, idf[t])])
    weight = lambda x: F.coalesce(F.try_element_at(idf_map, x), F.lit(unseen))

    def squared_norm(w: Column) -> Column:
        """Sum over words of (frequency x idf)^2: the k-th time a word comes adds 2k - 1 of its squared idf."""
        start = F.struct(F.lit("").alias("word"), F.lit(0).alias("run"), F.lit(0.0).alias("sum"))

        def step(a: Column, x: Column) -> Column:
            run = F.when(a["word"] == x, a["run"]).otherwise(F.lit(0))
            return F.struct(x.alias("word"), (run + 1).alias("run"), (a["sum"] + (2 * run + 1) * weight(x) * weight(x)).alias("sum"))

        return F.aggregate(F.array_sort(w), start, step, lambda a: a["sum"])

    def score(w: Column, name: str) -> Column:
        own = weights[name]
        norm = math.sqrt(sum(v * v for v in own.values()))
        of = F.create_map(*[F.lit(x) for t in sorted(own) for x in (t, own[t] * idf[t])])
        dot = F.aggregate(w, F.lit(0.0), lambda a, x: a + F.coalesce(F.try_element_at(of, x), F.lit(0.0)))
        return dot / F.lit(norm)

    rows = docs.select("doc_id", F.col("path").cast("string").alias("path"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    lines = F.when(F.col("text").rlike(holds), F.filter(F.split("text", "\n"), lambda x: x.rlike(holds))).otherwise(F.array().cast("array<string>"))
    # sentences of the lines that have several; they count no words, so a file's share is that of its lines
    parts = F.flatten(F.transform(F.filter("lines", lambda x: x.rlike(SENTENCE_END)), lambda x: F.split(F.regexp_replace(x, SENTENCE_END, "$1\n"), "\n")))
    units = F.concat(F.transform("lines", lambda x: F.struct(x.alias("s"), F.lit(1).alias("line"))), F.transform(F.filter(parts, lambda x: x.rlike(holds)), lambda x: F.struct(x.alias("s"), F.lit(0).alias("line"))))
    each = F.transform(units, lambda x: F.struct(words(x["s"]).alias("w"), x["line"].alias("line")))
    scored = F.transform(
        F.col("line_words"),
        lambda u: F.struct(
            F.array_max(F.array(*[F.struct(score(u["w"], name).alias("dot"), F.lit(-k).alias("k")) for k, name in enumerate(counts)])).alias("best"),
            F.sqrt(squared_norm(u["w"])).alias("norm"),
            (F.size(u["w"]) * u["line"]).alias("n"),
        ),
    )
    names = F.array(*[F.lit(name) for name in counts])
    found = F.transform(
        F.filter("scored", lambda s: s["best"]["dot"] >= s["norm"] * F.lit(threshold)),
        lambda s: F.struct((F.floor(s["best"]["dot"] / s["norm"] * 1e6 + 0.5) / 1e6).alias("score"), F.get(names, -s["best"]["k"]).alias("licence"), s["n"].alias("n")),
    )
    # only texts with a match are counted in words
    with_lines = rows.select("doc_id", "path", "text", lines.alias("lines"))
    parted = with_lines.select("doc_id", "path", "text", each.alias("line_words")).select("doc_id", "path", "text", scored.alias("scored")).select("doc_id", "path", "text", found.alias("matches"))
    return parted.select("doc_id", "path", F.when(F.size("matches") > 0, F.size(words(F.col("text")))).alias("text_words"), "matches", F.md5("text").alias("text_key"))


def block_terms(blocks: tuple) -> list[tuple[str, str, dict[str, int]]]:
    """(key, licence, count of each term) of each block."""
    return [(f"{k}", name, {w: int(n) for w, n in zip(*[iter(text.split())] * 2)}) for k, (name, text) in enumerate(blocks)]


def may_hold(held: Column, share: dict[str, float], least: float) -> Column:
    """Whether the shares of the held terms, each rounded up by at most a LEVEL, sum to `least`: never false if they do."""
    levels: dict[int, list[str]] = {}
    for term, x in sorted(share.items()):
        if x > 0:
            levels.setdefault(math.floor(math.log(x) / math.log(LEVEL)) + 1, []).append(term)
    total = F.lit(0.0)
    for level, terms in sorted(levels.items()):
        total += F.size(F.array_intersect(held, F.array(*[F.lit(t) for t in terms]))) * F.lit(LEVEL**level)
    return total >= F.lit(least)


def block_matches(docs: DataFrame, held: DataFrame, idfs: tuple[dict[str, float], float], blocks: tuple = BLOCKS, threshold: float = THRESHOLD) -> DataFrame | None:
    """(text_key, block array of score, licence and words, block_words) of every text that holds a block; None if there is none.

    held: terms_held of docs with all terms of the blocks. Units are a text as a whole and its runs of as many words as
    the block has. Two bounds keep other texts and runs from being taken apart, and lose nothing:
    * a unit reaches the threshold only if the block's terms in the whole text make up threshold squared of the block's
      squared norm (Cauchy-Schwarz); this is first asked of all blocks at once, by each term's largest share in any;
    * a unit's norm is at least the root of the summed squared idf of its words, a sliding sum like its product.
    Best score, ties by name; block_words are those of the largest unit that matches.
    """
    spark = docs.sparkSession
    idf, unseen = idfs
    rows, share = [], {}
    for key, name, c in block_terms(blocks):
        norm = math.sqrt(sum((k * idf[t]) ** 2 for t, k in c.items()))
        for t, k in c.items():
            rows.append((key, name, sum(c.values()), t, k * idf[t] / norm))
            share[t] = max(share.get(t, 0.0), (k * idf[t] / norm) ** 2)
    own = F.broadcast(spark.createDataFrame(rows, "block string, licence string, m int, term string, w double"))
    least = threshold * threshold - 1e-9
    some = held.where(may_hold(F.col("held"), share, least)).dropDuplicates(["text_key"])
    gate = some.select("text_key", F.explode("held").alias("term")).join(own, "term").groupBy("text_key", "block", "m").agg(F.sum(F.col("w") * F.col("w")).alias("s")).where(F.col("s") >= least)
    pairs = cut(gate.select("text_key", "block", "m"), "licence-block-pairs")
    if not (n_pairs := pairs.count()):
        return None
    known = F.broadcast(spark.createDataFrame(sorted(idf.items()), "term string, idf double"))
    texts = docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).select(F.md5("text").alias("text_key"), "text")
    kept = cut(texts.join(small(pairs.select("text_key").distinct(), n_pairs), "text_key", "left_semi").dropDuplicates(["text_key"]).select("text_key", words(F.col("text")).alias("words")), "licence-block-texts")
    # runs that the second bound lets pass
    at = kept.join(small(pairs, n_pairs), "text_key").select("text_key", "block", "m", F.size("words").alias("size"), F.posexplode("words").alias("at", "term"))
    valued = at.join(known, "term", "left").join(own.select("block", "term", "w"), ["block", "term"], "left").withColumn("idf", F.coalesce("idf", F.lit(unseen)))
    # in units of the block's length, so that one frame serves all blocks
    ahead = "OVER (PARTITION BY text_key, block ORDER BY at / m RANGE BETWEEN CURRENT ROW AND 0.999999999D FOLLOWING)"
    runs = valued.select("text_key", "block", "m", "size", "at", F.expr(f"sum(idf * coalesce(w, 0D)) {ahead}").alias("dot"), F.expr(f"sum(idf * idf) {ahead}").alias("least_square"))
    last = F.greatest(F.col("size") - F.col("m"), F.lit(0))
    step = F.greatest(F.floor(F.col("m") / F.when(F.col("m") <= HEADER_WORDS, HEADER_STEPS).otherwise(BODY_STEPS)).cast("int"), F.lit(1))
    starts = runs.where((F.col("at") <= last) & ((F.col("at") % step == 0) | (F.col("at") == last)) & (F.col("dot") >= F.sqrt("least_square") * F.lit(threshold - 1e-9)))
    units = cut(starts.select("text_key", "block", "m", "at").unionByName(pairs.withColumn("at", F.lit(-1))), "licence-block-units")
    unit = F.when(F.col("at") < 0, F.col("words")).otherwise(F.slice("words", F.col("at") + 1, F.col("m")))
    taken = kept.join(units, "text_key").select("text_key", "block", "at", F.explode(unit).alias("term"))
    tf = taken.groupBy("text_key", "block", "at", "term").agg(F.count("*").alias("tf"))
    weighed = tf.join(known, "term", "left").withColumn("x", F.col("tf") * F.coalesce("idf", F.lit(unseen))).join(own.select("block", "term", "w"), ["block", "term"], "left")
    sums = weighed.groupBy("text_key", "block", "at").agg(F.sum(F.col("x") * F.coalesce("w", F.lit(0.0))).alias("dot"), F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"), F.sum("tf").cast("int").alias("n"))
    labels = F.broadcast(spark.createDataFrame([(key, name) for key, name, _ in block_terms(blocks)], "block string, licence string"))
    hits = sums.where(F.col("dot") >= F.col("norm") * F.lit(threshold)).join(labels, "block")
    score = F.floor(F.col("dot") / F.col("norm") * 1e6 + 0.5) / 1e6
    best = hits.select("text_key", "n", score.alias("score"), "licence").groupBy("text_key").agg(F.min(F.struct((-F.col("score")).alias("s"), "licence", "n")).alias("b"), F.max("n").alias("block_words"))
    return best.select("text_key", F.array(F.struct((-F.col("b.s")).alias("score"), F.col("b.licence").alias("licence"), F.col("b.n").alias("n"))).alias("block"), "block_words").join(kept.select("text_key", F.size("words").alias("block_text_words")), "text_key")


def parent(path: Column) -> Column:
    """The directory of a path; empty at the top."""
    return F.regexp_replace(path, r"/?[^/]*$", "")


def scan(docs: DataFrame, templates: dict[str, str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, path, own_licence, score, licence, basis, from_dir) of every row of docs (doc_id, path, text).

    own_licence: that of the best matching line, sentence, run of words or whole text (ties: the first by name); given templates
    replace the notices and the blocks. Licence files, by name or because what matches holds half of their words, give
    their licence to their directory (several: the best score, then name). A file without an own licence has that of the
    nearest directory at or above it which has one; basis is own, inherited or none. Null texts match nothing; a null path is in no directory. Repeated rows each have their result; no
    documents: no rows. Texts are read whole, however long.
    """
    blocks, terms = None, {w for t in (templates or TEMPLATES).values() for w in _words(t)}
    if not templates:
        terms = sorted(terms.union(*(c for _, _, c in block_terms(BLOCKS))))
        held = cut(terms_held(docs, terms), "licence-terms")
        idfs = inverse_frequencies(held, terms)
        blocks = block_matches(docs, held, idfs, BLOCKS, threshold)
    lines = licence_lines(docs, templates, threshold, None if templates else idfs)
    empty = F.array().cast(lines.schema["matches"].dataType)
    blocks = cut(blocks, "licence-blocks") if blocks else None
    if blocks is None or not (n_blocks := blocks.count()):
        lines = lines.withColumn("block_words", F.lit(0)).withColumn("lines", F.col("matches"))
    else:
        lines = lines.join(small(blocks, n_blocks), "text_key", "left").withColumn("lines", F.col("matches"))
        lines = lines.withColumn("matches", F.concat("matches", F.coalesce("block", empty))).withColumn("text_words", F.coalesce("text_words", "block_text_words"))
    best = F.get(F.array_sort("matches", lambda a, b: F.when(a["score"] > b["score"], -1).when(a["score"] < b["score"], 1).when(a["licence"] < b["licence"], -1).when(a["licence"] > b["licence"], 1).otherwise(0)), 0)
    held = F.greatest(F.aggregate("lines", F.lit(0), lambda a, m: a + m["n"]), F.coalesce("block_words", F.lit(0)))
    name = F.regexp_extract("path", r"[^/]*$", 0)
    files = cut(
        lines.select(
            "doc_id", "path", parent(F.col("path")).alias("dir"), best["licence"].alias("own_licence"), best["score"].alias("score"),
            (F.coalesce(name.rlike(LICENCE_NAME), F.lit(False)) | (held >= F.col("text_words") * F.lit(FILE_SHARE))).alias("is_file"),
        ),
        "licence-files",
    )
    given = files.where("is_file and own_licence is not null and dir is not null").groupBy("dir").agg(F.min(F.struct((-F.col("score")).alias("s"), "own_licence")).alias("b"))
    giving = cut(given.select(F.col("dir").alias("from_dir"), F.col("b.own_licence").alias("licence")), "licensed-dirs")
    dirs = cut(files.where("dir is not null").select("dir").distinct(), "dirs")
    parts = F.split("dir", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    near = dirs.select("dir", F.explode_outer(F.array_distinct(above)).alias("from_dir")).join(small(giving, giving.count()), "from_dir")
    nearest = near.groupBy("dir").agg(F.max(F.struct(F.length("from_dir").alias("l"), "from_dir", "licence")).alias("b")).select("dir", F.col("b.from_dir").alias("from_dir"), F.col("b.licence").alias("given"))
    nearest = cut(nearest, "nearest-licence")
    out = files.join(small(nearest, nearest.count()), "dir", "left")
    own = F.col("own_licence").isNotNull()
    return out.select(
        "doc_id", "path", "own_licence", "score", F.coalesce("own_licence", "given").alias("licence"),
        F.when(own, "own").when(F.col("given").isNotNull(), "inherited").otherwise("none").alias("basis"),
        F.when(~own, F.col("from_dir")).alias("from_dir"),
    )


def as_files(documents: DataFrame) -> DataFrame:
    """The documents table as a tree of files: source/hundreds/tens/name; each id that ends in 0 is its directory's LICENSE."""
    hundreds, tens = F.expr("doc_id div 100").cast("string"), F.expr("doc_id div 10").cast("string")
    name = F.when(F.col("doc_id") % 10 == 0, "LICENSE").otherwise(F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    return documents.select("doc_id", F.concat_ws("/", hundreds, tens, name).alias("path"), "text")


def _oracle() -> str:
    """The same scan in SQL, by joins of words instead of array functions."""
    templates = " UNION ALL ".join(f"SELECT '{name}' AS licence, '{text.lower()}' AS t" for name, text in sorted(TEMPLATES.items()))
    return rf"""
WITH files AS (
  SELECT doc_id, coalesce(text, '') AS text,
         CAST(doc_id // 100 AS VARCHAR) || '/' || CAST(doc_id // 10 AS VARCHAR) AS dir,
         CASE WHEN doc_id % 10 = 0 THEN 'LICENSE' ELSE CAST(doc_id AS VARCHAR) || '.txt' END AS name
  FROM documents),
tw AS (SELECT licence, term, count(*) AS tf FROM (SELECT licence, unnest(regexp_extract_all(t, '[\p{{L}}\p{{N}}]+')) AS term FROM ({templates})) GROUP BY ALL),
terms AS (SELECT DISTINCT term FROM tw),
words AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+')) AS term FROM files),
n AS (SELECT count(*) AS n FROM files),
df AS (SELECT term, count(DISTINCT doc_id) AS df FROM words SEMI JOIN terms USING (term) GROUP BY term),
idf AS (SELECT term, ln((n + 1) / (coalesce(df, 0) + 1)) + 1 AS idf FROM terms LEFT JOIN df USING (term), n),
tnorm AS (SELECT licence, sqrt(sum(tf * idf * tf * idf)) AS norm FROM tw JOIN idf USING (term) GROUP BY licence),
whole AS (SELECT doc_id, unnest(range(len(l))) AS line, unnest(l) AS s FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM files)),
lines AS (FROM whole UNION ALL SELECT doc_id, -1 - row_number() OVER () AS line, s FROM (SELECT doc_id, unnest(string_split(regexp_replace(s, '([.!?])[ \t]+', '\1' || chr(10), 'g'), chr(10))) AS s FROM whole WHERE regexp_matches(s, '[.!?][ \t]'))),
lw AS (SELECT doc_id, line, term, count(*) AS tf FROM (SELECT doc_id, line, unnest(regexp_extract_all(lower(s), '[\p{{L}}\p{{N}}]+')) AS term FROM lines) GROUP BY ALL),
near AS (SELECT DISTINCT doc_id, line FROM lw SEMI JOIN terms USING (term)),
lnorm AS (SELECT doc_id, line, sum(tf) AS k, sqrt(sum(tf * tf * coalesce(idf, ln(n + 1) + 1) * coalesce(idf, ln(n + 1) + 1))) AS norm
          FROM lw SEMI JOIN near USING (doc_id, line) LEFT JOIN idf USING (term), n GROUP BY doc_id, line),
dots AS (SELECT doc_id, line, licence, sum(lw.tf * idf * tw.tf * idf) AS dot FROM lw JOIN idf USING (term) JOIN tw USING (term) GROUP BY doc_id, line, licence),
sims AS (SELECT doc_id, line, licence, k, dot / tnorm.norm / lnorm.norm AS sim FROM dots JOIN tnorm USING (licence) JOIN lnorm USING (doc_id, line)),
hits AS (SELECT doc_id, line, k, floor(sim * 1e6 + 0.5) / 1e6 AS score, licence FROM sims WHERE sim >= {THRESHOLD}
         QUALIFY row_number() OVER (PARTITION BY doc_id, line ORDER BY floor(sim * 1e9 + 0.5) DESC, licence) = 1),
own AS (SELECT doc_id, licence AS own_licence, score FROM hits QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, licence) = 1),
share AS (SELECT doc_id, sum(CASE WHEN line >= 0 THEN k ELSE 0 END) AS held FROM hits GROUP BY doc_id),
size AS (SELECT doc_id, count(*) AS k FROM words GROUP BY doc_id),
given AS (SELECT dir, own_licence AS given FROM files JOIN own USING (doc_id) JOIN share USING (doc_id) JOIN size USING (doc_id)
          WHERE name = 'LICENSE' OR held >= size.k * {FILE_SHARE}
          QUALIFY row_number() OVER (PARTITION BY dir ORDER BY score DESC, own_licence) = 1),
up AS (SELECT DISTINCT dir, unnest([dir, string_split(dir, '/')[1], '']) AS from_dir FROM files),
nearest AS (SELECT up.dir, from_dir, given.given FROM up JOIN given ON up.from_dir = given.dir
            QUALIFY row_number() OVER (PARTITION BY up.dir ORDER BY length(from_dir) DESC) = 1)
SELECT doc_id, f.dir || '/' || name AS path, own_licence, score, coalesce(own_licence, given) AS licence,
       CASE WHEN own_licence IS NOT NULL THEN 'own' WHEN given IS NOT NULL THEN 'inherited' ELSE 'none' END AS basis,
       CASE WHEN own_licence IS NULL THEN from_dir END AS from_dir
FROM files f LEFT JOIN own USING (doc_id) LEFT JOIN nearest ON nearest.dir = f.dir
"""


ORACLE_SQL = _oracle()
