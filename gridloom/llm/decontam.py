"""Benchmark decontamination: size-partitioned MinHash containment search, then exact shingle containment.

Items are dealt into classes by their number of distinct shingles (powers of two). An item's signature is its smallest
shingle hashes; how many is fixed by its class's upper size, so that more than 1 - threshold of the item's shingles are
in it. A document that holds at least `threshold` of an item's shingles then holds at least one of the signature, so the
search loses nothing; what it finds is verified by counting the item's shingles in the document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import cut, fresh, small

SHINGLE, THRESHOLD = 5, 0.8


def words(text: Column) -> Column:
    """Words in lower case: the runs between white space (ASCII), so a null or blank text has none."""
    return F.filter(F.split(F.lower(F.coalesce(text.cast("string"), F.lit(""))), r"[ \t-\r]+"), lambda w: w != "")


def shingle_hashes(w: Column, size: int = SHINGLE) -> Column:
    """A 64-bit hash of every run of `size` words, in order; of all words together if they are fewer (none: no hash).

    w must be a column of its own, not an expression: it is looked up for every word.
    """
    whole = F.when(F.size(w) > 0, F.array(F.xxhash64(w))).otherwise(F.array().cast("array<bigint>"))
    runs = F.transform(F.sequence(F.lit(0), F.size(w) - size), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(size)]))
    return F.when(F.size(w) >= size, runs).otherwise(whole)


def item_shingles(items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(item_id, h, n, signature) of every distinct shingle of every item that has a word.

    n: distinct shingles of the item. signature: h is among its smallest hashes, as many as its size class asks for.
    Rows that repeat an item_id with the same text count once; with different texts they are one item with all shingles.
    """
    hashes = items.where("item_id is not null").select("item_id", words(F.col("text")).alias("w")).select("item_id", F.array_distinct(shingle_hashes(F.col("w"))).alias("hs"))
    merged = hashes.groupBy("item_id").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("hs")))).alias("hs")).withColumn("n", F.size("hs")).where("n > 0")
    # class c holds sizes of 2^c to 2^(c+1) - 1
    top = F.pow(F.lit(2.0), F.floor(F.log2(F.col("n").cast("double"))) + 1) - 1
    missing = F.floor(top * F.lit(1 - threshold) + 1e-9)
    take = F.least(F.col("n"), missing.cast("int") + 1)
    return merged.withColumn("take", take).select("item_id", "n", "take", F.posexplode("hs").alias("at", "h")).select("item_id", "h", "n", (F.col("at") < F.col("take")).alias("signature"))


def contained_items(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, item_id, n_item, n_found, containment): the documents that hold at least `threshold` of an item's shingles.

    Shingles are five words, in lower case; an item of fewer words is one shingle, which only a document of the same words
    has (a phrase of a few words is no evidence in a long text). Null texts and ids: no match. Equal items each have their
    own rows; no documents or no items: no rows. Documents are read twice: for the search, and
    those found again for the count; neither moves a text unless the found ids pass the broadcast bound.
    """
    parts = cut(item_shingles(items, threshold), "item-shingles")
    n_parts = parts.count()
    texts = docs.where(docs["doc_id"].isNotNull() & docs["text"].isNotNull()).select("doc_id", "text")
    hashed = lambda t: t.select("doc_id", words(F.col("text")).alias("w")).select("doc_id", shingle_hashes(F.col("w")).alias("hs"))
    signature = parts.where("signature").groupBy("h").agg(F.collect_list("item_id").alias("items"))
    held = hashed(texts).select("doc_id", F.explode_outer("hs").alias("h")).join(small(signature, n_parts), "h").select("doc_id", F.explode("items").alias("item_id"))
    found = cut(held.distinct(), "candidates")
    ids = found.select("doc_id").distinct()
    n_found = found.count()
    # joined before it is taken into words, so only the texts found are
    again = hashed(texts.join(small(ids, n_found), "doc_id", "left_semi")).select("doc_id", F.explode_outer(F.array_distinct("hs")).alias("h"))
    # explode_outer: explode would add a filter on the array's size, which pushed down takes the words apart again and again
    # the count: (document, shingle) meets the items that the search found in this document
    wanted = again.join(small(parts.select("item_id", "h", "n"), n_parts), "h")
    hits = wanted.join(small(found, n_found), ["doc_id", "item_id"], "left_semi")
    # a doc_id that repeats with different texts is one document with all their shingles
    counts = hits.groupBy("doc_id", "item_id").agg(F.first("n").alias("n_item"), F.count_distinct("h").alias("n_found"))
    return counts.where(F.col("n_found") >= F.col("n_item") * F.lit(threshold)).select("doc_id", "item_id", F.col("n_item").cast("long").alias("n_item"), F.col("n_found").cast("long").alias("n_found"), (F.col("n_found") / F.col("n_item")).alias("containment"))


def drop_contaminated(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that hold no item; all columns stay as they are.

    Rows without an id are searched by no one and stay. Rows that repeat an id stay or go together; no documents: no rows.
    """
    bad_id = fresh(docs, "_bad_id")
    bad = cut(contained_items(docs.select("doc_id", "text"), items, threshold).select(F.col("doc_id").alias(bad_id)).distinct(), "contaminated")
    return docs.join(small(bad, bad.count()), docs["doc_id"] == F.col(bad_id), "left_anti")


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[ \t-\r]+'), lambda x: x <> '') AS w FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL),
b AS (SELECT item_id, list_filter(regexp_split_to_array(lower(text), '[ \t-\r]+'), lambda x: x <> '') AS w FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL),
ds AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i + 4], ' ') END AS s
       FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0)),
bs AS (SELECT DISTINCT item_id, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i + 4], ' ') END AS s
       FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM b WHERE len(w) > 0)),
n AS (SELECT item_id, count(*) AS n_item FROM bs GROUP BY item_id)
SELECT doc_id, item_id, n_item, count(*) AS n_found, count(*) / n_item AS containment
FROM ds JOIN bs USING (s) JOIN n USING (item_id)
GROUP BY doc_id, item_id, n_item HAVING count(*) >= n_item * 0.8::DOUBLE
"""
