"""Benchmark decontamination by size-partitioned MinHash containment search, with DataFrame functions only.

A test item with n shingles is contained in a document if the document has at least 75 % of them, that is,
lacks at most floor(n / 4). Items are partitioned by size class; an item's sketch is its k smallest shingle
hashes, k being set by its class so that k > floor(n / 4): a document that contains the item must then hold at
least k - floor(n / 4) of the sketch. The search looks sketch hashes up in the hashed shingles of every document,
however long it is, so the length of the document does not weaken it and no contained item is missed.
Candidates are verified on the words themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import broadcast_if_small, let, row_key, settle, spare, words

WIDTH = 5


def shingle_hashes(text: Column, width: int = WIDTH) -> Column:
    """Hashes of a text's word shingles; with fewer words than ``width``, of the whole sequence; without words, none."""

    def of(h: Column) -> Column:
        n = F.size(h)
        runs = F.transform(F.sequence(F.lit(1), F.greatest(n - width + 1, F.lit(1))), lambda i: F.xxhash64(F.slice(h, i, width)))
        return F.when(n == 0, F.array().cast("array<long>")).otherwise(runs)

    return let(F.transform(words(text), lambda w: F.xxhash64(w)), of)


def shingle_texts(text: Column, width: int = WIDTH) -> Column:
    """The distinct shingles themselves, words joined by one space."""

    def of(w: Column) -> Column:
        n = F.size(w)
        runs = F.transform(F.sequence(F.lit(1), F.greatest(n - width + 1, F.lit(1))), lambda i: F.array_join(F.slice(w, i, width), " "))
        return F.when(n == 0, F.array().cast("array<string>")).otherwise(F.array_distinct(runs))

    return let(words(text), of)


def sketches(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(h, item, need) for the sketch of each item: its class's number of smallest hashes, and how many of
    them a document that contains the item holds at least."""
    sets = items.select(F.col(id_col).alias("item"), F.array_sort(F.array_distinct(shingle_hashes(F.col(text_col)))).alias("hs")).filter(F.size("hs") > 0)
    n = F.size("hs")
    top = F.pow(F.lit(2.0), F.floor(F.log2(n.cast("double"))) + 1) - 1  # the largest size of the class
    k = F.least(n, (F.floor(top / 4) + 1).cast("int"))
    return sets.withColumn("k", k).withColumn("need", F.col("k") - F.floor(n / 4)).select("item", "need", F.explode(F.slice("hs", F.lit(1), F.col("k"))).alias("h"))


def contained_items(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", least: float = 0.75) -> DataFrame:
    """(row_key, doc_id, item_id, n_item, n_shared, containment) of each document and item contained in it.

    ``least`` is 0.75 or more, which the sketches are sized for. Words are runs other than white space,
    lower-cased in A-Z. Null or empty texts and items have no shingles and match nothing; a text or item with
    fewer than five words is one shingle, the whole of it. Texts of any length are searched whole, and other columns aren't
    read; empty tables give no rows. Repeated rows of documents give one row each pair;
    items repeated under one id and items with a null id count as what they are, one item per id and text.
    """
    if not 0.75 <= least <= 1:
        raise ValueError("least must be from 0.75 to 1")
    item_rows = items.select(F.col(item_id).alias("item_id"), F.col(item_text).alias("item_text")).distinct().withColumn("item", F.xxhash64(F.col("item_id").cast("string"), F.coalesce("item_text", F.lit(""))))
    item_rows = settle(item_rows, "decon-items")
    sketch = broadcast_if_small(sketches(item_rows, "item", "item_text"))
    own = docs.select(row_key(id_col, text_col).alias("row_key"), F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    found = own.select("row_key", F.explode(shingle_hashes(F.col("text"))).alias("h")).join(sketch, "h")
    pairs = settle(found.groupBy("row_key", "item", "need").agg(F.count_distinct("h").alias("hits")).filter("hits >= need").select("row_key", "item"), "decon-pairs")
    # the texts of the documents that have candidates, and the shingles of the items in question
    ids = broadcast_if_small(pairs.select("row_key").distinct())
    suspects = own.join(ids, "row_key", "left_semi").dropDuplicates(["row_key"])
    wanted = item_rows.join(broadcast_if_small(pairs.select("item").distinct()), "item", "left_semi").withColumn("shingles", shingle_texts(F.col("item_text")))
    sides = settle(suspects.select("row_key", "doc_id", F.explode(shingle_texts(F.col("text"))).alias("shingle")).join(broadcast_if_small(wanted.select("item", F.explode("shingles").alias("shingle"))), "shingle"), "decon-shared")
    shared = sides.groupBy("row_key", "doc_id", "item").agg(F.count("*").alias("n_shared"))
    sized = wanted.select("item", "item_id", F.size("shingles").cast("long").alias("n_item"))
    return (
        shared.join(pairs, ["row_key", "item"], "left_semi")
        .join(broadcast_if_small(sized), "item")
        .withColumn("containment", F.col("n_shared") / F.col("n_item"))
        .filter(F.col("n_shared") >= F.lit(float(least)) * F.col("n_item"))
        .select("row_key", "doc_id", "item_id", "n_item", "n_shared", "containment")
    )


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", least: float = 0.75) -> DataFrame:
    """The rows of ``docs`` that contain no item, with the columns of ``docs``, whatever their names. Rows without text
    stay, as do all rows if there is no item; repeated rows stay or go together; an empty table stays empty."""
    key = spare(docs, "decon_key")
    hits = settle(contained_items(docs, items, id_col, text_col, item_id, item_text, least).select(F.col("row_key").alias(key)).distinct(), "decon-hits")
    keyed = docs.withColumn(key, row_key(id_col, text_col))
    return keyed.join(broadcast_if_small(hits), key, "left_anti").drop(key)
