"""Approximate nearest neighbours by a forest of random-projection trees.

The forest is fitted on a bounded sample; every row is then sent to one leaf of each tree. A query walks all trees
through one shared priority queue, ordered by how near it passes the splits it did not take, until the leaves it
reached hold enough rows; leaf by leaf the candidates are ranked by their exact cosine and the best are merged. How many
rows are enough is measured: a bounded number of queries is compared with every row, and the rows after which
their true neighbours are met say what a recall asks for. Data in clusters ask for a small number whatever the size of
the table, data spread evenly over many dimensions for a share of it.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import settle

#: Rows of a block of entries, and of a block of queries; a leaf that holds or is visited by more is dealt out in blocks.
BLOCK = 4096


@dataclass
class Forest:
    """Trees of one depth; node k of a tree has children 2k + 1 and 2k + 2, and 2**depth leaves below."""

    depth: int
    normals: np.ndarray  # trees x (2**depth - 1) x dimension
    offsets: np.ndarray  # trees x (2**depth - 1)

    @property
    def leaves(self) -> int:
        return 1 << self.depth

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        """Leaf of every row of x (unit length) in every tree."""
        at = np.zeros((len(self.normals), len(x)), np.int64)
        for t in range(len(self.normals)):
            for _ in range(self.depth):
                side = np.einsum("ij,ij->i", x, self.normals[t, at[t]]) > self.offsets[t, at[t]]
                at[t] = 2 * at[t] + 1 + side
        return at - (self.leaves - 1)

    def search(self, q: np.ndarray, counts: np.ndarray, enough: int) -> list[tuple[int, int]]:
        """(tree, leaf) of the leaves that one query visits: counts[tree, leaf] rows each, ``enough`` in all."""
        margins = np.einsum("tkd,d->tk", self.normals, q) - self.offsets if self.depth else None
        queue = [(-np.inf, t, 0) for t in range(len(self.normals))]
        found, total, inner = [], 0, self.leaves - 1
        while queue and total < enough:
            cost, t, node = heapq.heappop(queue)
            while node < inner:
                m = margins[t, node]
                near, far = (2 * node + 2, 2 * node + 1) if m > 0 else (2 * node + 1, 2 * node + 2)
                heapq.heappush(queue, (max(cost, abs(m)), t, far))
                node = near
            if counts[t, node - inner]:
                found.append((t, node - inner))
                total += counts[t, node - inner]
        return found


def fit_forest(x: np.ndarray, trees: int, leaf: int, seed: int = 7) -> Forest:
    """A forest over rows of unit length: each split is the difference of two random rows, at the median."""
    rng = np.random.default_rng(seed)
    depth = max(0, int(np.floor(np.log2(max(1, len(x)) / leaf)))) if len(x) > leaf else 0
    inner, dim = (1 << depth) - 1, x.shape[1] if x.ndim == 2 and len(x) else 1
    normals, offsets = np.zeros((trees, inner, dim)), np.zeros((trees, inner))
    for t in range(trees):
        rows = {0: np.arange(len(x))}
        for node in range(inner):
            own = rows.pop(node)
            if len(own) > 1:
                a, b = x[rng.choice(own, 2, replace=False)]
                normal = a - b
                size = np.sqrt(normal @ normal)
                normals[t, node] = normal / size if size else rng.standard_normal(dim) / np.sqrt(dim)
                side = x[own] @ normals[t, node]
                offsets[t, node] = np.median(side)
                right = side > offsets[t, node]
                rows[2 * node + 1], rows[2 * node + 2] = own[~right], own[right]
            else:
                rows[2 * node + 1], rows[2 * node + 2] = own, own[:0]
    return Forest(depth, normals, offsets)


def _rows_to_visit(entries: DataFrame, queries: DataFrame, forest: Forest, counts: np.ndarray, k: int, recall: float, many: int) -> int:
    """Rows, counted once per tree, that a query visits until ``recall`` of the true ``k`` nearest are among them: measured on
    ``many`` queries at most, chosen by hash, each against all entries."""
    asked = queries.dropDuplicates(["entry"]).orderBy(F.xxhash64("entry"), "entry").limit(many).select("entry", "v").toPandas()
    if not len(asked):
        return 0
    q, own = _matrix(asked["v"]), asked["entry"].to_numpy(np.int64)
    q = q / np.sqrt((q * q).sum(axis=1, keepdims=True))

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                x = _matrix(b["v"])
                score = q @ (x / np.sqrt((x * x).sum(axis=1, keepdims=True))).T
                score[own[:, None] == b["entry"].to_numpy()[None, :]] = -2
                few = min(len(b), k)
                top = np.argpartition(-score, few - 1, axis=1)[:, :few]
                i, j = np.repeat(np.arange(len(q)), few), top.ravel()
                yield pd.DataFrame({"q": i, "score": score[i, j], "v": b["v"].to_numpy()[j]})

    near = Window.partitionBy("q").orderBy(F.desc("score"))
    found = entries.select("entry", "v").mapInPandas(compare, f"q long, score double, v {entries.schema['v'].dataType.simpleString()}")
    true = found.withColumn("place", F.row_number().over(near)).filter((F.col("place") <= k) & (F.col("score") > -2)).toPandas()  # many * k rows
    if not len(true):
        return 0
    x = _matrix(true["v"])
    leaves = forest.leaf_of(x / np.sqrt((x * x).sum(axis=1, keepdims=True)))
    needed = np.zeros(len(true))
    for i, rows in true.reset_index(drop=True).groupby("q").groups.items():
        met, total = np.full(counts.shape, np.inf), 0
        for cell in forest.search(q[i], counts, np.inf):
            total += counts[cell]
            met[cell] = total
        needed[rows] = met[np.arange(len(leaves))[:, None], leaves[:, rows]].min(axis=0)
    return int(np.ceil(np.quantile(needed, recall)))


def _matrix(vectors: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, np.float64) for v in vectors]) if len(vectors) else np.zeros((0, 1))


def nearest(rows: DataFrame, is_query, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 5, trees: int = 20, sample: int = 20_000, leaf: int = 40, search: int = 1000, recall: float = 0.96, calibrate: int = 100) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` rows of largest cosine found for each row where ``is_query``
    (a column) holds, itself excluded; ties to the smaller id; all rows, if there are fewer.

    The index is fitted on about ``sample`` distinct vectors and covers every row. A query looks at leaves that hold
    ``search`` rows or as many as a recall of ``recall`` took on ``calibrate`` queries, whichever is more, counted once per tree. Rows
    with the same vector are one entry that carries its k + 1 smallest ids, which is all that an answer can need of
    them, so a vector that a third of the rows share costs one comparison.

    Vectors that are null, empty, zero, or hold a null or non-finite component take no part, nor rows with a null
    id; vectors of another length than the most common one take none either. A repeated id is answered once. An empty table gives no rows; other columns aren't read.
    """
    v = F.col(vector_col)
    sound = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists(v, lambda c: c != 0)
    valid = rows.filter(F.col(id_col).isNotNull() & F.coalesce(sound, F.lit(False))).select(F.col(id_col).alias("id"), v.alias("v"), F.coalesce(is_query, F.lit(False)).alias("q"))
    lengths = valid.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    schema = "query_id long, rank int, vec_id long, score double"
    if lengths is None:
        return rows.sparkSession.createDataFrame([], schema)
    valid = valid.filter(F.size("v") == lengths["d"])
    # one entry for each distinct vector; the rank limit cuts before the shuffle
    place = Window.partitionBy("v").orderBy("id")
    few = valid.groupBy("v", "id").agg(F.max("q").alias("q")).withColumn("place", F.row_number().over(place)).filter(F.col("place") <= k + 1)
    entries = settle(few.groupBy("v").agg(F.min("id").alias("entry"), F.array_sort(F.collect_list("id")).alias("ids")), "ann-entries")
    n = entries.count()
    queries = settle(valid.filter("q").select("id", "v").distinct().join(entries.select("v", "entry"), "v").select(F.col("id").alias("query_id"), "entry", "v"), "ann-queries")

    share = min(1.0, sample / max(1, n))
    picked = entries.filter(F.pmod(F.xxhash64("entry"), F.lit(1 << 20)) < int(share * (1 << 20))).select("entry", "v").orderBy("entry").toPandas()
    x = _matrix(picked["v"])
    forest = fit_forest(x / np.sqrt((x * x).sum(axis=1, keepdims=True)), trees, leaf)
    shared = rows.sparkSession.sparkContext.broadcast(forest)  # bounded by the sample: trees * sample / leaf splits

    @F.pandas_udf("array<int>")
    def leaves_of(vectors: pd.Series) -> pd.Series:
        m = _matrix(vectors)
        at = shared.value.leaf_of(m / np.sqrt((m * m).sum(axis=1, keepdims=True))) if len(m) else np.zeros((trees, 0), int)
        return pd.Series(list(at.T.astype(np.int32)))

    size = forest.leaves
    postings = settle(entries.select("entry", leaves_of("v").alias("leaves")).select("entry", F.posexplode("leaves").alias("tree", "leaf")).select((F.col("tree") * size + F.col("leaf")).alias("cell"), "entry"), "ann-postings")
    counted = postings.groupBy("cell").count().toPandas()  # one row a leaf: bounded by the index
    counts = np.zeros(trees * size, np.int64)
    counts[counted["cell"]] = counted["count"]
    enough = max(search, _rows_to_visit(entries, queries, forest, counts.reshape(trees, size), k, recall, calibrate))

    @F.pandas_udf("array<int>")
    def visits(vectors: pd.Series) -> pd.Series:
        return pd.Series([[t * size + at for t, at in shared.value.search(q / np.sqrt(q @ q), counts.reshape(trees, size), enough)] for q in _matrix(vectors)])

    searched = settle(queries.dropDuplicates(["entry"]).select(F.col("entry").alias("q"), "v", visits("v").alias("cells")), "ann-visits")
    visited = searched.select(F.explode("cells").alias("cell")).groupBy("cell").count().toPandas()  # one row a leaf
    asked = np.zeros(trees * size, np.int64)
    asked[visited["cell"]] = visited["count"]
    # a leaf is dealt out in blocks of entries and of queries, and each block of the one meets each of the other
    deal = pd.DataFrame({"cell": np.arange(trees * size), "entry_blocks": np.maximum(1, -(-counts // BLOCK)), "query_blocks": -(-asked // BLOCK)})
    n_groups = max(8, int((counts * deal["query_blocks"] + asked * deal["entry_blocks"]).sum() // 20_000))
    dealt = F.broadcast(rows.sparkSession.createDataFrame(deal[asked > 0], "cell int, entry_blocks long, query_blocks long"))  # one row a leaf
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    group = F.pmod(F.xxhash64("cell", "entry_block", "query_block"), F.lit(n_groups)).alias("g")
    met_by = postings.join(dealt, "cell").withColumn("entry_block", F.pmod(F.xxhash64("entry"), "entry_blocks")).withColumn("query_block", every("query_blocks"))
    left = met_by.join(entries.select("entry", "v"), "entry").select(group, "cell", "entry_block", "query_block", "entry", "v")
    meeting = searched.select("q", "v", F.explode("cells").alias("cell")).join(dealt, "cell").withColumn("query_block", F.pmod(F.xxhash64("q"), "query_blocks")).withColumn("entry_block", every("entry_blocks"))
    right = meeting.select(group, "cell", "entry_block", "query_block", "q", "v")
    keep = k + 1

    def rerank(entries_here: pd.DataFrame, queries_here: pd.DataFrame) -> pd.DataFrame:
        parts = []
        own = dict(tuple(entries_here.groupby(["cell", "entry_block", "query_block"])))
        for key, qs in queries_here.groupby(["cell", "entry_block", "query_block"]):
            if key not in own:
                continue
            c, q, ids = _matrix(own[key]["v"]), _matrix(qs["v"]), own[key]["entry"].to_numpy()
            cn, qn = np.sqrt((c * c).sum(axis=1)), np.sqrt((q * q).sum(axis=1))
            for at in range(0, len(q), 256):
                rough = (q[at : at + 256] @ c.T) / cn[None, :]
                few = min(len(c), 4 * keep)
                top = np.argpartition(-rough, few - 1, axis=1)[:, :few] if few < len(c) else np.broadcast_to(np.arange(len(c)), rough.shape)
                i, j = np.repeat(np.arange(at, at + len(rough)), few), top.ravel()
                # every pair's cosine by the same sums, whichever leaf it was met in
                score = np.einsum("ij,ij->i", q[i], c[j]) / (qn[i] * cn[j])
                order = np.lexsort((ids[j], -score, i))
                i, j, score = i[order], j[order], score[order]
                first = np.searchsorted(i, i)
                best = np.arange(len(i)) - first < keep
                parts.append(pd.DataFrame({"q": qs["q"].to_numpy()[i[best]], "entry": ids[j[best]], "score": score[best]}))
        return pd.concat(parts) if parts else pd.DataFrame({"q": np.zeros(0, np.int64), "entry": np.zeros(0, np.int64), "score": np.zeros(0)})

    met = left.groupBy("g").cogroup(right.groupBy("g")).applyInPandas(rerank, "q long, entry long, score double")
    best = Window.partitionBy("q").orderBy(F.desc("score"), "entry")
    top = met.groupBy("q", "entry").agg(F.max("score").alias("score")).withColumn("place", F.row_number().over(best)).filter(F.col("place") <= keep)
    answers = top.join(entries.select("entry", "ids"), "entry").select("q", "score", F.explode("ids").alias("vec_id"))
    # per entry that was asked for, its k + 1 best rows; then each query drops itself
    near = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    lists = settle(answers.withColumn("place", F.row_number().over(near)).filter(F.col("place") <= keep).groupBy("q").agg(F.array_sort(F.collect_list(F.struct("place", "vec_id", "score"))).alias("near")), "ann-lists")
    own = F.slice(F.filter("near", lambda r: r["vec_id"] != F.col("query_id")), 1, k)
    return (
        queries.join(lists, F.col("entry") == F.col("q")).select("query_id", F.posexplode(own).alias("at", "r"))
        .select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("r.vec_id").alias("vec_id"), F.col("r.score").alias("score"))
    )
