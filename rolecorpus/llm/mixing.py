"""Mixing sources to target weights, with DataFrame functions only.

Tokens are summed by source and hash bucket; the budget of a source ends inside one bucket, and only that
bucket is summed again by the next bits of the hash. Three such passes over a table of (source, size, hash)
give a threshold per source, and a filter on the threshold picks the rows. Nothing is sorted: a window runs
over at most 2**14 sums of a source, whatever the number of its documents, so a hot source costs no more.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import broadcast_if_small, n_words, settle, spare_prefix

#: Bits of the three nested histograms.
LEVELS = (12, 14, 14)
BITS = sum(LEVELS)


def unit_hash(id_col: Column) -> Column:
    """The first 40 bits of the md5 of an id's text, the same in every engine and run."""
    return F.conv(F.substring(F.md5(F.coalesce(id_col.cast("string"), F.lit(""))), 1, BITS // 4), 16, 10).cast("long")


def source_targets(totals: DataFrame, weights=(5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """Adds ``weight`` and ``target`` to one row per source (source, source_size).

    Sources by code point, null last, take the weights in turn and share ``share`` times all sizes; a target
    stops at ``most`` times its source and the excess goes to the others by weight until none is above.
    That end state is a water level: with sources ordered by the level at which they are full, the level is
    what is left for, and weighed by, the sources that are not yet full. One row per source stands here, so
    the windows over all of them see counts, not documents.
    """
    in_order = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(in_order) - 1) % len(weights)
    weighed = totals.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int")))
    full = Window.orderBy(F.col("full_at"), F.col("source").asc_nulls_last())
    levels = (
        weighed.withColumn("cap", F.col("source_size") * F.lit(float(most)))
        .withColumn("full_at", F.col("cap") / F.col("weight"))
        .withColumn("before", F.coalesce(F.sum("cap").over(full.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("open_weight", F.sum("weight").over(full.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("budget", F.sum("source_size").over(Window.partitionBy()) * F.lit(float(share)))
        .withColumn("level_here", (F.col("budget") - F.col("before")) / F.col("open_weight"))
        .withColumn("open_level", F.when(F.col("full_at") > F.col("level_here"), F.col("level_here")))
        .withColumn("level", F.max("open_level").over(Window.partitionBy()))
    )
    target = F.when(F.col("full_at") <= F.col("level"), F.col("cap")).otherwise(F.coalesce(F.col("weight") * F.col("level"), F.col("cap")))
    return levels.select("source", "source_size", "weight", target.alias("target"))


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=(5, 2, 1), share: float = 1.5, most: float = 2.0, prefix: str = "mix_") -> DataFrame:
    """Every row of ``docs`` with size, source_size, target, copies and taken, each behind ``prefix``.

    A row is taken floor(target / source_size) times, and once more if its hash is below its source's
    threshold, so a row never exceeds ceil(``most``) times its size. The threshold is the one whose total is
    nearest to the target; the miss is at most half of the document on the boundary.

    Null or blank texts have size 0 and are taken 0 words; a null source is a source of its own; rows that
    share an id share a hash and stand or fall together; an empty table gives an empty table. Other columns
    pass through, texts of any length are counted whole; columns of ``docs`` with the five names are replaced.
    """
    size, source_size, target, copies, taken = (prefix + c for c in ("size", "source_size", "target", "copies", "taken"))
    plain = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in (size, source_size, target, copies, taken)])
    own_k, own_h, own_base, own_cut = (spare_prefix(plain, "mixing_") + c for c in "khbc")
    key = F.coalesce(F.concat(F.lit("s"), F.col(source_col).cast("string")), F.lit("n"))
    sized = settle(plain.select(key.alias("k"), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size"), unit_hash(F.col(id_col)).alias("h")), "mix-sized")
    totals = sized.groupBy("k").agg(F.first("source").alias("source"), F.sum("size").alias("source_size"))
    targets = settle(
        totals.join(source_targets(totals.select("source", "source_size"), weights, share, most).select(F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("n")).alias("k"), "target"), "k")
        .withColumn("base", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long"))
        .withColumn("left", F.col("target") - F.col("base") * F.col("source_size")),
        "mix-targets",
    )
    cuts = thresholds(sized, targets)
    per_source = broadcast_if_small(
        targets.join(cuts, "k", "left").select(F.col("k").alias(own_k), F.col("source_size").alias(source_size), F.col("target").alias(target), F.col("base").alias(own_base), F.coalesce("cut", F.lit(0)).alias(own_cut))
    )
    return (
        plain.withColumns({own_k: key, size: n_words(F.col(text_col)), own_h: unit_hash(F.col(id_col))})
        .join(per_source, own_k)
        .withColumn(copies, (F.col(own_base) + (F.col(own_h) < F.col(own_cut)).cast("long")).cast("long"))
        .withColumn(taken, F.col(copies) * F.col(size))
        .drop(own_k, own_h, own_base, own_cut)
    )


def thresholds(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """(k, cut) per source with a remainder: rows with h < cut fill it most nearly."""
    open_part = targets.filter("left > 0").select("k", "left", F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("below"))
    shift = BITS
    for level, bits in enumerate(LEVELS):
        shift -= bits
        bucket = F.shiftright(F.col("h"), shift)
        inside = sized.join(broadcast_if_small(open_part), "k").filter(F.shiftright(F.col("h"), shift + bits) == F.col("prefix"))
        sums = inside.groupBy("k", "left", "below", bucket.alias("bucket")).agg(F.sum("size").alias("size"))
        running = F.sum("size").over(Window.partitionBy("k").orderBy("bucket"))
        over = sums.withColumn("through", F.col("below") + running).filter(F.col("through") > F.col("left"))
        ends = over.groupBy("k", "left").agg(F.min(F.struct("bucket", "through", "size")).alias("e"))
        open_part = settle(ends.select("k", "left", F.col("e.bucket").alias("prefix"), (F.col("e.through") - F.col("e.size")).alias("below"), F.col("e.size").alias("size")), f"mix-level{level}")
        if level < len(LEVELS) - 1:
            open_part = open_part.drop("size")
    nearer = (F.col("below") + F.col("size") - F.col("left")) < (F.col("left") - F.col("below"))
    return open_part.select("k", (F.col("prefix") + nearer.cast("long")).alias("cut"))
