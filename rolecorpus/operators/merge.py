"""Keyed merges: one row per key, with a policy for each column, and what the corpus does with them.

Spark tables have no unique constraint, so each merge makes keys unique itself: the batch is cut to its last row per
key, and one full outer join on the key, the only shuffle, decides every column.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import scratch_path, settle
from .graph import connected_components


#: Policies: take the batch's value, null or not; take it unless null; keep the current value.
OVERWRITE, COALESCE, KEEP = "overwrite", "coalesce", "keep"
#: The corpus: salaries survive a batch without one; what identifies a posting stays.
POSTING_POLICY = {"id": KEEP, "source": KEEP, "first_seen_at": KEEP, "salary_min_usd": COALESCE, "salary_max_usd": COALESCE, "salary_raw": COALESCE}
#: Writes from the result store do not touch what the feeds know better.
STORE_POLICY = POSTING_POLICY | {"location": KEEP, "is_remote": KEEP}
#: Feeds without dates do not clear them.
UNDATED_POLICY = POSTING_POLICY | {"published_at": KEEP}
TENANT_POLICY = {"source": KEEP, "discovered_at": KEEP, "company_name": COALESCE, "verified_at": COALESCE}


def last_per_key(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The last row of each key in the given ascending order. The rank limit cuts before the shuffle."""
    reverse = [F.struct(*order).alias("o")] if len(order) > 1 else order
    w = Window.partitionBy(*key).orderBy(F.desc(reverse[0]))
    return df.withColumn("merge_rank", F.row_number().over(w)).filter("merge_rank = 1").drop("merge_rank")


def merge(current: DataFrame, batch: DataFrame, key: list[str], policy: dict[str, str], touched: dict[str, Column] | None = None, created: dict[str, Column] | None = None) -> DataFrame:
    """The new state: current rows, batch rows, and for keys in both a value by each column's policy (default:
    overwrite). ``created`` sets columns of new rows and ``touched`` columns of every row of the batch. The batch must have one
    row per key; columns that it lacks are kept."""
    c, b = current.alias("c"), batch.withColumn("in_batch", F.lit(True)).alias("b")
    on = F.lit(True)
    for k in key:
        on = on & (F.col(f"c.{k}") == F.col(f"b.{k}"))
    both = c.withColumn("in_current", F.lit(True)).alias("c").join(b, on, "full_outer")
    old, new = F.col("c.in_current").isNotNull(), F.col("b.in_batch").isNotNull()
    out = []
    for name in current.columns:
        mine = F.col(f"c.{name}")
        if name not in batch.columns:
            value = mine
        elif name in key:
            value = F.coalesce(mine, F.col(f"b.{name}"))
        else:
            theirs, how = F.col(f"b.{name}"), policy.get(name, OVERWRITE)
            kept = mine if how == KEEP else F.coalesce(theirs, mine) if how == COALESCE else theirs
            value = F.when(old & new, kept).when(new, theirs).otherwise(mine)
        if touched and name in touched:
            value = F.when(new, touched[name]).otherwise(value)
        if created and name in created:
            value = F.when(~old & new, created[name]).otherwise(value)
        out.append(value.alias(name))
    return both.select(*out)


def upsert_postings(current: DataFrame, batch: DataFrame, as_of: Column, policy: dict[str, str] = POSTING_POLICY, order: list[Column] | None = None) -> DataFrame:
    """Postings by url: new ones get the id sha2(url) and are first and last seen now; known ones are last seen now."""
    unique = last_per_key(batch.filter(F.col("url").isNotNull()), ["url"], order or [F.col("batch_pos")])
    return merge(current, unique, ["url"], policy, touched={"last_seen_at": as_of}, created={"id": F.sha2(F.col("b.url"), 256), "first_seen_at": as_of})


def save_corpus(postings: DataFrame, table: str, buckets: int = 256, path: str | None = None) -> DataFrame:
    """Writes postings as a table bucketed and sorted by url, one file a bucket, and reads it back."""
    writer = postings.repartition(buckets, "url").write.mode("overwrite").bucketBy(buckets, "url").sortBy("url")
    (writer if path is None else writer.option("path", path)).saveAsTable(table)
    return postings.sparkSession.table(table)


def upsert_bucketed(current: DataFrame, batch: DataFrame, as_of: Column, buckets: int = 256, policy: dict[str, str] = POSTING_POLICY, order: list[Column] | None = None) -> DataFrame:
    """As ``upsert_postings`` into a corpus of ``save_corpus`` with as many buckets: the batch alone is shuffled, into the corpus's
    buckets, and stays there for its own ranking and for the join. Save the result as another table; it is in buckets too."""
    dealt = batch.filter(F.col("url").isNotNull()).repartition(buckets, "url")
    return upsert_postings(current, dealt, as_of, policy, order)


def write_buckets(state: DataFrame, path: str, key: str = "url", buckets: int = 64, version: int | None = None) -> None:
    """Writes a state partitioned by a hash bucket of its key, and by ``version`` if one is given; only partitions present in
    ``state`` are replaced, so a merge reads and rewrites the buckets its batch touches. Without versions, write to a new path
    what was read from this one."""
    parts = ["bucket"] if version is None else ["bucket", "version"]
    bucketed = state.withColumn("bucket", bucket_of(key, buckets))
    if version is not None:
        bucketed = bucketed.withColumn("version", F.lit(version))
    bucketed.repartition(F.col("bucket")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*parts).parquet(path)


def bucket_of(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def newest_buckets(state: DataFrame, before: int | None = None, among: list[int] | None = None) -> DataFrame:
    """The rows of a versioned state in the newest version of each bucket, if wanted of those before one and of some buckets. Which
    versions there are is read from the partitions; the choice is one pair for each bucket and prunes the scan."""
    have = state if before is None else state.filter(F.col("version") < before)
    have = have if among is None else have.filter(F.col("bucket").isin(among))
    newest = have.groupBy("bucket").agg(F.max("version").alias("version")).collect()
    chosen = F.lit(False)
    for r in newest:
        chosen = chosen | ((F.col("bucket") == r["bucket"]) & (F.col("version") == r["version"]))
    return have.filter(chosen).drop("bucket", "version")


def insert_if_absent(known: DataFrame, batch: DataFrame) -> DataFrame:
    """Rows (url, dedup_key, batch_pos) of a batch of which neither the url nor the key is known, and of which no
    earlier kept row has either. Two equality anti-joins, never one with OR; the batch's own copies are resolved in order."""
    fresh = batch.join(known.select("url").distinct(), "url", "left_anti").join(known.select("dedup_key").distinct(), "dedup_key", "left_anti")
    return greedy_keep(fresh, [F.coalesce("url", F.lit("")), F.when(F.col("dedup_key") != "", F.col("dedup_key"))], "batch_pos")


#: Rows that one task may fold in order.
FOLD_ROWS = 100_000


def greedy_keep(df: DataFrame, keys: list[Column], pos: str, group: list[str] | None = None, fold_rows: int = FOLD_ROWS, rounds: int = 6) -> DataFrame:
    """Rows, taken in order of ``pos``, of which no kept row before (in the same ``group``) has one of the ``keys``; a null
    key never collides. A dropped row blocks nobody. ``pos`` must be unique in a group.

    While many rows are open, a round keeps those that come first for all their keys and drops those that share a key
    with a kept one; a round is a written table, and a key that a third of the rows share is settled in the first. The rest is
    folded in order: at once if it is small, else by components of shared keys, side by side. No task folds more than
    ``fold_rows`` rows of a component: a longer one, such as a chain in which each row hangs on the row before, is folded prefix
    by prefix of its order, and rows that share a key with what earlier prefixes kept go before theirs is folded.
    """
    group, fold_rows = group or [], max(1, fold_rows)
    names = [f"greedy_{k}" for k in range(len(keys))]
    slim = df.select(*group, pos, *[c.cast("string").alias(n) for c, n in zip(keys, names, strict=True)]).withColumn("greedy_id", F.monotonically_increasing_id())
    open_rows = settle(slim, "greedy-open")
    columns, kept = open_rows.columns, []
    for _ in range(rounds):
        if open_rows.limit(fold_rows + 1).count() <= fold_rows:
            break
        marked, win = open_rows, F.lit(True)
        for n in names:
            first = open_rows.filter(F.col(n).isNotNull()).groupBy(*group, n).agg(F.min(pos).alias(f"{n}_first"))
            marked = marked.join(first, [*group, n], "left")
            win = win & (F.col(f"{n}_first").isNull() | (F.col(pos) == F.col(f"{n}_first")))
        marked = settle(marked.withColumn("greedy_win", win), "greedy-marked")
        won, rest = marked.filter("greedy_win"), marked.filter("not greedy_win").select(*columns)
        kept.append(won.select(*group, pos))
        for n in names:
            rest = rest.join(won.filter(F.col(n).isNotNull()).select(*group, n).distinct(), [*group, n], "left_anti")
        open_rows = settle(rest.select(*columns), "greedy-open")
    few = open_rows.limit(fold_rows + 1).count() <= fold_rows
    part = F.lit(0).cast("long")
    if not few:
        links = None
        for n in names:
            first = open_rows.filter(F.col(n).isNotNull()).groupBy(*group, n).agg(F.min("greedy_id").alias("b"))
            own = open_rows.join(first, [*group, n]).select(F.col("greedy_id").alias("a"), "b")
            links = own if links is None else links.union(own)
        open_rows = open_rows.join(connected_components(links), F.col("greedy_id") == F.col("node"), "left")
        part = F.coalesce("component", "greedy_id")
    owned = open_rows.select(*columns, F.to_json(F.struct(part.alias("part"), *group)).alias("owner"))
    if few:
        ids = _fold_owners(owned, names, pos).select("greedy_id")
    else:
        owned = settle(owned, "greedy-owned")
        long_ones = owned.groupBy("owner").agg(F.count("*").alias("n")).filter(F.col("n") > fold_rows).select("owner")
        short, long_rows = owned.join(long_ones, "owner", "left_anti"), owned.join(long_ones, "owner", "left_semi")
        ids = _fold_owners(short, names, pos).select("greedy_id").union(_fold_prefixes(long_rows, names, pos, fold_rows))
    folded = open_rows.join(ids, "greedy_id", "left_semi").select(*group, pos)
    for k in kept:
        folded = folded.union(k)
    return df.join(folded, [*group, pos], "left_semi")


def _fold_owners(owned: DataFrame, names: list[str], pos: str) -> DataFrame:
    """(owner, greedy_id, keys) of the rows that each owner keeps, going through its rows one by one in order."""

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        owner, seen = None, []
        for b in batches:
            keep = []
            for own, *values in zip(b["owner"], *(b[n] for n in names), strict=True):
                if own != owner:
                    owner, seen = own, [set() for _ in names]
                free = not any(v is not None and v in s for v, s in zip(values, seen, strict=True))
                keep.append(free)
                if free:
                    for v, s in zip(values, seen, strict=True):
                        s.add(v)
            yield b[keep]

    ordered = owned.repartition("owner").sortWithinPartitions("owner", pos).select("owner", "greedy_id", *names)
    return ordered.mapInPandas(fold, ordered.schema)


def _prefixes(owned: DataFrame, pos: str, fold_rows: int) -> DataFrame:
    """The rows with ``step``, from 1: the piece of at most ``fold_rows`` rows of their owner's order that they are in. A range
    partitioning sorts all owners at once; only the list of pieces is ranked by owner."""
    ranges = -(-owned.count() // fold_rows) or 1
    dealt = settle(owned.repartitionByRange(ranges, "owner", pos).withColumn("range", F.spark_partition_id()), "greedy-ranges")
    place = F.row_number().over(Window.partitionBy("range", "owner").orderBy(pos)) - 1
    dealt = dealt.withColumn("piece", F.floor(place / F.lit(fold_rows)).cast("int"))
    pieces = dealt.groupBy("owner", "range", "piece").agg(F.count("*").alias("n")).drop("n")
    steps = pieces.withColumn("step", F.row_number().over(Window.partitionBy("owner").orderBy("range", "piece")))
    return dealt.join(steps, ["owner", "range", "piece"]).drop("range", "piece")


def _fold_prefixes(owned: DataFrame, names: list[str], pos: str, fold_rows: int) -> DataFrame:
    """(greedy_id) of the rows that owners keep whose rows are too many for a task, one prefix of each owner's order after another."""
    spark, path, out = owned.sparkSession, scratch_path(owned.sparkSession, "greedy-prefixes"), scratch_path(owned.sparkSession, "greedy-kept")
    _prefixes(owned, pos, fold_rows).repartition("owner", "step").write.partitionBy("step").parquet(path)
    dealt = spark.read.schema(f"{_ddl(owned)}, step int").parquet(path)
    last, written = dealt.agg(F.max("step")).first()[0] or 0, []
    kept_schema = _ddl(owned.select("owner", "greedy_id", *names))
    for step in range(1, last + 1):
        rows = dealt.filter(F.col("step") == step).drop("step")
        if written:
            before = spark.read.schema(kept_schema).parquet(*written)
            for n in names:
                rows = rows.join(before.filter(F.col(n).isNotNull()).select("owner", n).distinct(), ["owner", n], "left_anti")
        written.append(f"{out}/{step}")
        _fold_owners(rows, names, pos).write.parquet(written[-1])
    if not written:
        return owned.select("greedy_id").limit(0)
    return spark.read.schema(kept_schema).parquet(*written).select("greedy_id")


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{name}` {kind}" for name, kind in df.dtypes)


def best_per_key(results: DataFrame) -> DataFrame:
    """One row per dedup key, or url where there is none: the highest score (null is 0), the first on ties."""
    key = F.coalesce("dedup_key", "url")
    w = Window.partitionBy(key).orderBy(F.desc(F.coalesce("score", F.lit(0.0))), "pos")
    return results.withColumn("best_rank", F.row_number().over(w)).filter("best_rank = 1").drop("best_rank")


def greedy_dedupe(candidates: DataFrame, url_key: str = "url_key", content_key: str = "content_key") -> DataFrame:
    """Candidates (query_id, pos, ...) kept in order unless a kept one of the same query has their canonical URL or
    content key; an empty content key never matches."""
    content = F.coalesce(content_key, F.lit(""))
    return greedy_keep(candidates, [F.coalesce(url_key, F.lit("")), F.when(~content.isin("", "||"), content)], "pos", ["query_id"])


def content_key(company: Column, title: Column, location: Column) -> Column:
    from ..functions.text import content_part

    return F.concat_ws("|", content_part(company), content_part(title), content_part(location))


def dedupe_saved(searches: DataFrame) -> DataFrame:
    """The newest search per (anon, hash), ties to the larger id; searches without an anon id all stay."""
    w = Window.partitionBy("anon_id", "query_hash").orderBy(F.desc("created_at"), F.desc("search_id"))
    ranked = searches.filter("anon_id is not null").withColumn("saved_rank", F.row_number().over(w)).filter("saved_rank = 1").drop("saved_rank")
    return ranked.unionByName(searches.filter("anon_id is null"))


def ingest_stats(rows: DataFrame) -> DataFrame:
    """Counts by slug and in all (slug null): fetched, upserted, errors, with a salary, known to be remote, and
    percentages of the fetched, 0 where nothing was."""
    pct = lambda n: F.when(F.col("fetched") > 0, F.floor(100 * F.col(n) / F.col("fetched") + 0.5)).otherwise(0).cast("long")
    counts = rows.rollup("slug").agg(
        F.grouping("slug").cast("int").alias("is_total"), F.count("*").alias("fetched"), F.count_if(~F.col("failed")).alias("upserted"), F.count_if("failed").alias("errors"),
        F.count_if(F.col("has_salary") & ~F.col("failed")).alias("with_salary"), F.count_if(F.col("is_remote").eqNullSafe(F.lit(True)) & ~F.col("failed")).alias("with_remote"),
    )
    return counts.withColumns({"salary_pct": pct("with_salary"), "remote_pct": pct("with_remote")})


def corpus_profile(postings: DataFrame, country: str = "IN") -> DataFrame:
    """One row: rows, distinct companies, shares of a country's places and of remote postings."""
    from ..functions.geo import country_flag

    return postings.agg(
        F.count("*").alias("n_rows"), F.count_distinct("company").alias("companies"), F.count_if(country_flag(F.col("location_raw"), country)).alias("in_country"), F.count_if(F.col("is_remote").eqNullSafe(F.lit(True))).alias("remote"),
    )


def source_counts(postings: DataFrame) -> DataFrame:
    """(source, n, pct): rows of each source and their share of all, in whole percent. The total is one window over the groups."""
    counts = postings.groupBy("source").agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy())
    return counts.select("source", "n", F.floor(100 * F.col("n") / total + 0.5).cast("long").alias("pct"))


def top_locations(postings: DataFrame, k: int = 10) -> DataFrame:
    """(location, n): the ``k`` most frequent places in their normal form, ties by name; postings without one aside."""
    from ..functions.geo import normalize_location

    placed = postings.select(normalize_location(F.trim("location_raw")).alias("location")).filter(F.col("location") != "")
    return placed.groupBy("location").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "location").limit(k)


def company_counts(postings: DataFrame) -> DataFrame:
    return postings.groupBy("company").agg(F.count("*").alias("n"))


