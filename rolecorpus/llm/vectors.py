"""Near copies among vectors: p-stable hashing of normalised vectors, then exact cosines.

For unit vectors a cosine is a Euclidean distance. A table of the hash has some random projections, each cut into cells of a
fixed width; two vectors meet in the tables where all their cells agree. The number of projections follows the number of vectors, so
that a vector meets a stranger in one table of ten, and the number of tables follows from the projections, so that a pair at
the asked cosine itself is missed with the probability ``miss``; nearer pairs are missed less.

Exact copies are one vector with a weight. Vectors within half the asked angle of the least vector of one of their buckets
form a ball: any two of a ball are linked, by the triangle inequality of angles, so no pair of them is compared. Buckets that hold
members of one ball alone go. What is left is compared block by block; a pair counts in the first table where it meets, and
blocks give sums and spanning links, never pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import connected_components
from .common import mix64, settle

#: Width of a cell; distance of vectors that have nothing to do with each other.
WIDTH, STRANGERS = 2.0, math.sqrt(2.0)
#: Strangers that a vector meets in a table, tables that look for balls, vectors of a block.
MEETS, BALL_TABLES, BLOCK = 0.1, 4, 512
SEED = 20_231


def agree(distance: float, width: float = WIDTH) -> float:
    """Chance that one projection puts two vectors at this distance into one cell."""
    r = width / distance
    return math.erf(r / math.sqrt(2)) - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


def plan_tables(n: int, cosine: float, miss: float) -> tuple[int, int]:
    """Projections of a table, and tables, for ``n`` vectors."""
    k = max(1, math.ceil(math.log(max(n, 2) / MEETS) / -math.log(agree(STRANGERS))))
    return k, max(BALL_TABLES, math.ceil(math.log(miss) / math.log1p(-(agree(math.sqrt(2 - 2 * cosine)) ** k))))


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values of a list column as doubles, one after another, and each list's length; nulls inside are NaN."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    values = column.flatten()
    values = values.cast(pa.float64()) if values.type != pa.float64() else values
    return np.asarray(values.fill_null(float("nan")), np.float64), np.asarray(column.value_lengths().fill_null(0), np.int64)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # so that squares neither overflow nor vanish
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _groups(sizes: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each length of list: the length, the rows that have it, and the places of their values."""
    begin = np.cumsum(sizes) - sizes
    for d in np.unique(sizes[sizes > 0]).tolist():
        rows = np.flatnonzero(sizes == d)
        yield d, rows, begin[rows][:, None] + np.arange(d)


def hash_codes(batches: Iterator[pa.RecordBatch], k: int, tables: int) -> Iterator[pa.RecordBatch]:
    """Adds the bucket of each table to (key, embedding, ...)."""
    nets: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for batch in batches:
        flat, sizes = _lists(batch.column("embedding"))
        codes = np.zeros((len(sizes), tables), np.int64)
        for d, rows, at in _groups(sizes):
            if d not in nets:
                rng = np.random.default_rng([SEED, d])
                nets[d] = rng.standard_normal((d, k * tables)), rng.random(k * tables) * WIDTH
            a, b = nets[d]
            for lo in range(0, len(rows), 2048):
                part = rows[lo : lo + 2048]
                cells = np.floor((_unit(flat[at[lo : lo + 2048]]) @ a + b) / WIDTH).astype(np.int64).reshape(len(part), tables, k)
                h = np.full((len(part), tables), d, np.uint64)
                for j in range(k):
                    h = mix64(h * np.uint64(0x9E3779B97F4A7C15) + cells[:, :, j].astype(np.uint64))
                codes[part] = (h >> np.uint64(1)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(pa.array(np.arange(len(codes) + 1) * tables, pa.int32()), pa.array(codes.ravel()))], [*batch.schema.names, "codes"])


def _near_leader(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    """The pairs (key, leader) of (key, embedding, leader, leader_embedding) whose cosine is ``least`` or more."""
    for batch in batches:
        x, nx = _lists(batch.column("embedding"))
        y, ny = _lists(batch.column("leader_embedding"))
        y_begin, near = np.cumsum(ny) - ny, np.zeros(len(nx), bool)
        for d, rows, at in _groups(nx):
            same = ny[rows] == d
            rows, at = rows[same], at[same]
            if len(rows):
                near[rows] = np.einsum("ij,ij->i", _unit(x[at]), _unit(y[y_begin[rows][:, None] + np.arange(d)])) >= least
        keep = pa.array(np.flatnonzero(near))
        yield pa.RecordBatch.from_arrays([batch.column("key").take(keep), batch.column("leader").take(keep)], ["key", "leader"])


def _components(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Links (least, other), one less than nodes, that join what the links a-b join."""
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    label, a, b = np.arange(len(nodes)), at[: len(a)], at[len(a) :]
    while True:
        old = label.copy()
        np.minimum.at(label, a, label[b])
        np.minimum.at(label, b, label[a])
        label = label[label]
        if (old == label).all():
            break
    other = np.flatnonzero(label != np.arange(len(nodes)))
    return np.stack((nodes[label[other]], nodes[other]), axis=1)


def _compare(u: np.ndarray, codes: np.ndarray, root: np.ndarray, weight: np.ndarray, side: np.ndarray, table: int, lone: bool, cosine: float):
    """Linked weights of each row, and links of roots, among the pairs of one block pair that first meet here.

    ``side``: the half of the block pair of each row; pairs of a lone block are all its pairs, else those across. Pairs of one ball
    are linked already.
    """
    left, right = (np.flatnonzero(side == 0), np.flatnonzero(side == 1)) if not lone else (np.arange(len(u)),) * 2
    i, j = np.nonzero(u[left] @ u[right].T >= cosine)
    i, j = left[i], right[j]
    keep = root[i] != root[j]
    if lone:
        keep &= i < j
    i, j = i[keep], j[keep]
    for t in range(table):
        if not len(i):
            break
        fresh = codes[i, t] != codes[j, t]
        i, j = i[fresh], j[fresh]
    counts = np.bincount(i, weight[j], len(u)) + np.bincount(j, weight[i], len(u))
    links = np.unique(np.stack((root[i], root[j]), axis=1), axis=0) if len(i) else np.zeros((0, 2), np.int64)
    return counts.astype(np.int64), _components(links[:, 0], links[:, 1]) if len(links) else links


PAIRS = "key long, links long, a long, b long"


def compare_blocks(batches: Iterator[pa.RecordBatch], cosine: float) -> Iterator[pa.RecordBatch]:
    """Block pairs, one after another in sorted rows: (key, links) for rows with links, (a, b) for links of roots."""
    held: list[pa.RecordBatch] = []
    names = ("tab", "code", "i", "j")

    def settle_block(rows: pa.RecordBatch, out: list) -> None:
        flat, sizes = _lists(rows.column("embedding"))
        codes = np.asarray(rows.column("codes").flatten(), np.int64).reshape(len(sizes), -1)
        key, root, weight, side = (np.asarray(rows.column(c), np.int64) for c in ("key", "root", "weight", "side"))
        lone = rows.column("i")[0] == rows.column("j")[0]
        for _, at, places in _groups(sizes):
            counts, links = _compare(_unit(flat[places]), codes[at], root[at], weight[at], side[at], rows.column("tab")[0].as_py(), lone, cosine)
            some = np.flatnonzero(counts)
            out.append((key[at][some], counts[some], links))

    def written(out: list) -> pa.RecordBatch:
        keys, counts = (np.concatenate([np.zeros(0, np.int64), *(x[k] for x in out)]) for k in (0, 1))
        links = np.concatenate([np.zeros((0, 2), np.int64), *(x[2] for x in out)])
        none = lambda n: pa.nulls(n, pa.int64())
        columns = [(pa.array(keys), none(len(links))), (pa.array(counts), none(len(links))), (none(len(keys)), pa.array(links[:, 0].copy())), (none(len(keys)), pa.array(links[:, 1].copy()))]
        return pa.RecordBatch.from_arrays([pa.concat_arrays(c) for c in columns], ["key", "links", "a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        if held:
            batch = pa.Table.from_batches([*held, batch]).combine_chunks().to_batches()[0]
        marks = [np.asarray(batch.column(c)) for c in names]
        cuts = np.flatnonzero(np.any([m[1:] != m[:-1] for m in marks], axis=0)) + 1
        bounds, out = [0, *cuts.tolist()], []
        for lo, hi in zip(bounds, bounds[1:], strict=False):
            settle_block(batch.slice(lo, hi - lo), out)
        held = [batch.slice(bounds[-1])]
        if out:
            yield written(out)
    if held:
        out = []
        settle_block(held[0], out)
        yield written(out)


def usable(vector: str) -> str:
    """SQL: the vector is there, has a component that isn't zero, and none that is null or not finite."""
    return f"coalesce(exists({vector}, x -> x <> 0) and not exists({vector}, x -> x is null or isnan(x) or abs(x) = double('infinity')), false)"


def near_copies(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = 0.95, miss: float = 0.005) -> DataFrame:
    """One row per vector: id, n_links (other vectors at ``cosine`` or more), component_id (the least id its links reach) and kept.

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing, are their own component and kept;
    so are vectors of another length to each other. Rows that share an id, and repeated rows, are vectors of their own. A null
    id is never the least: a component of null ids alone has a null component_id and isn't kept. An empty table gives an empty one;
    columns besides the two take no part, whatever their names.
    """
    spark = rows.sparkSession
    plain = rows.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{vector_col}`").alias("embedding"))
    valid = plain.filter(F.expr(usable("embedding")))
    copies = valid.groupBy("embedding").agg(F.min("id").alias("least_id"), F.count("*").alias("weight"))
    distinct = settle(copies.withColumn("key", F.monotonically_increasing_id()), "vectors-distinct")
    n = distinct.count()
    k, tables = plan_tables(n, cosine, miss)
    schema = "key long, weight long, embedding " + dict(plain.dtypes)["embedding"] + ", codes array<long>"
    coded = settle(distinct.select("key", "weight", "embedding").mapInArrow(lambda it: hash_codes(it, k, tables), schema), "vectors-coded")

    # balls: the least key of a bucket leads it
    bucket = coded.select("key", F.posexplode(F.slice("codes", 1, BALL_TABLES)).alias("tab", "code"))
    leads = bucket.groupBy("tab", "code").agg(F.min("key").alias("leader"), F.count("*").alias("held")).filter("held > 1").select("tab", "code", "leader")
    follows = settle(bucket.join(leads, ["tab", "code"]).filter("key != leader").select("key", "leader").distinct(), "vectors-follows")
    vectors = coded.select("key", "embedding")
    tried = follows.join(vectors, "key").join(vectors.select(F.col("key").alias("leader"), F.col("embedding").alias("leader_embedding")), "leader")
    half = math.cos(math.acos(cosine) / 2) + 1e-9
    near = settle(tried.select("key", "embedding", "leader", "leader_embedding").mapInArrow(lambda it: _near_leader(it, half), "key long, leader long"), "vectors-near")
    balls = near.join(near.select(F.col("key").alias("leader")).distinct(), "leader", "left_anti").groupBy("key").agg(F.min("leader").alias("root"))
    members = settle(coded.select("key", "weight", "codes").join(balls, "key", "left").withColumn("root", F.coalesce("root", "key")), "vectors-members")

    # buckets of several balls, dealt in pairs of blocks
    bucket = members.select("key", "root", F.posexplode("codes").alias("tab", "code"))
    mixed = bucket.groupBy("tab", "code").agg(F.min("root").alias("r0"), F.max("root").alias("r1"), F.count("*").alias("held")).filter("r0 != r1")
    mixed = mixed.select("tab", "code", F.ceil(F.col("held") / BLOCK).cast("int").alias("blocks"))
    met = bucket.join(mixed, ["tab", "code"]).select("key", "tab", "code", "blocks", F.pmod(F.xxhash64("key", "tab"), F.col("blocks")).cast("int").alias("own"))
    other = F.explode(F.expr("sequence(0, blocks - 1)")).alias("other")
    dealt = met.select("key", "tab", "code", "own", other).select("key", "tab", "code", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).cast("int").alias("side"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    loaded = dealt.join(members, "key").join(vectors, "key").select("tab", "code", "i", "j", "side", "key", "root", "weight", "embedding", "codes")
    sorted_ = loaded.repartition(parts, "tab", "code", "i", "j").sortWithinPartitions("tab", "code", "i", "j")
    found = settle(sorted_.mapInArrow(lambda it: compare_blocks(it, cosine), PAIRS), "vectors-found")

    across = found.filter("key is not null").groupBy("key").agg(F.sum("links").alias("across"))
    ball = members.groupBy("root").agg(F.sum("weight").alias("ball"))
    roots = connected_components(found.filter("a is not null").select("a", "b").distinct())
    linked = members.select("key", "root").join(ball, "root").join(across, "key", "left").join(roots.withColumnRenamed("node", "root"), "root", "left")
    linked = linked.select("key", (F.col("ball") - 1 + F.coalesce("across", F.lit(0))).alias("n_links"), F.coalesce("component", "root").alias("part"))
    named = settle(linked.join(distinct.select("key", "embedding", "least_id"), "key"), "vectors-linked")
    least = named.groupBy("part").agg(F.min("least_id").alias("component_id"))
    known = named.join(least, "part").select(F.col("embedding").alias("vector_"), "n_links", "component_id")
    done = valid.join(known, F.col("embedding") == F.col("vector_")).select("id", "n_links", "component_id", (F.col("id") == F.col("component_id")).alias("kept"))
    lone = plain.filter(~F.expr(usable("embedding"))).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    return done.union(lone).select(F.col("id").alias(id_col), "n_links", "component_id", F.coalesce("kept", F.lit(False)).alias("kept"))
