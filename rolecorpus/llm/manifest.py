"""A Merkle manifest of a dataset: a postorder log of 16-ary hash trees, and proofs read from it by position.

Every row is a leaf. The leaves of a source, ascending by id, form a tree; the roots of the sources form the tree above. A tree's
log holds its nodes in the order in which an appender completes them, so a node's place follows from the sizes of the subtrees that
end before it (``position``) and no index is kept. Builders work on aligned spans of 16**SPAN nodes: each writes the log of its own
span, whoever writes the others, and the spans' roots are the next round's leaves. A hot source is many spans. Ranks within a source
come from a range partitioning by (source, id) and prefix sums over one count for each partition and source.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, settle

#: Children of a node, as bits, and levels that one builder writes.
BITS, SPAN = 4, 3
FAN = 1 << BITS
#: The name of the tree above the sources' trees; theirs are "n" (null) or "s" and the source.
TOP = ""
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


# ---- closed forms ------------------------------------------------------------------------------------


def level_size(n: int, level: int) -> int:
    """Nodes at a level of a tree of ``n`` leaves."""
    return -((-n) >> (BITS * level))


def height(n: int) -> int:
    """Levels above the leaves."""
    h = 0
    while level_size(n, h) > 1:
        h += 1
    return h


def position(level: int, index: np.ndarray, n: int) -> np.ndarray:
    """Place in the log of the nodes ``index`` of a level: what is complete with the node's last leaf, down from its own level, and
    what was complete before that leaf, above it."""
    m = np.minimum((np.asarray(index, np.int64) + 1) << (BITS * level), n)
    at = np.full(m.shape, -1, np.int64)
    for k in range(height(n) + 1):
        at += -((-m) >> (BITS * k)) if k <= level else (m - 1) >> (BITS * k)
    return at


def hashed(*hexes: str) -> str:
    return hashlib.sha256("".join(hexes).encode()).hexdigest()


def fold(digest: str, siblings: list[str], shape: list[tuple[int, int]]) -> str:
    """The root that a leaf's digest and its proof give; ``shape`` has the place in its run and the run's length for each level."""
    at = 0
    for place, size in shape:
        run = siblings[at : at + size - 1]
        digest, at = hashed(*run[:place], digest, *run[place:]), at + size - 1
    return digest


# ---- leaves and ranks --------------------------------------------------------------------------------


def leaf_digest(fields: list[Column]) -> Column:
    """sha256 of the fields, each ``-`` if null, else its count of UTF-8 bytes, a colon and its text."""
    said = [c.cast("string") for c in fields]
    return F.sha2(F.concat(*[F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c)) for c in said]).cast("binary"), 256)


def ranked(rows: DataFrame, tree: str, order: list[str]) -> DataFrame:
    """``rows`` (a written table) with ``idx``, the rank from 0 within ``tree``, and ``n``, the tree's rows.

    Rows are dealt by ranges of (tree, order), so a hot tree spreads; only counts, one a partition and tree, meet in a window.
    """
    spark = rows.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = rows.repartitionByRange(parts, tree, *[F.col(c).asc_nulls_first() for c in order]).sortWithinPartitions(tree, *[F.col(c).asc_nulls_first() for c in order])
    placed = settle(dealt.withColumn("mid", F.monotonically_increasing_id()), "manifest-placed").withColumn("pid", F.shiftright("mid", 33))
    counts = placed.groupBy(tree, "pid").agg(F.min("mid").alias("first"), F.count("*").alias("held"))
    before = Window.partitionBy(tree).orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(F.col(tree).alias("t_"), F.col("pid").alias("p_"), "first", F.coalesce(F.sum("held").over(before), F.lit(0)).alias("before"), F.sum("held").over(Window.partitionBy(tree)).alias("n"))
    joined = placed.join(offsets, (F.col(tree) == F.col("t_")) & (F.col("pid") == F.col("p_")))
    return joined.withColumn("idx", F.col("mid") - F.col("first") + F.col("before")).drop("mid", "pid", "t_", "p_", "first", "before")


# ---- the log -----------------------------------------------------------------------------------------


def _build(span: pd.DataFrame, base: int) -> pd.DataFrame:
    """One builder: the nodes of levels ``base`` to ``base + SPAN`` over an aligned span, in the order of their completion."""
    tree, n = span["tree"].iloc[0], int(span["n"].iloc[0])
    span = span.sort_values("idx")
    digests, first = [d.hex() for d in span["digest"]], int(span["idx"].iloc[0])
    rows = [(base, first + k, d) for k, d in enumerate(digests)] if base == 0 else []
    for level in range(base + 1, min(base + SPAN, height(n)) + 1):
        digests = [hashed(*digests[k : k + FAN]) for k in range(0, len(digests), FAN)]
        first >>= BITS
        rows += [(level, first + k, d) for k, d in enumerate(digests)]
    out = pd.DataFrame(rows, columns=["level", "idx", "digest"])
    out["position"] = np.concatenate([position(int(k), g["idx"].to_numpy(), n) for k, g in out.groupby("level", sort=True)]) if len(out) else np.zeros(0, np.int64)
    out["digest"] = [bytes.fromhex(d) for d in out["digest"]]
    return out.assign(tree=tree, n=n).sort_values("position")[["tree", "n", "position", "level", "idx", "digest"]]


LOG = "tree string, n long, position long, level int, idx long, digest binary"


def append_log(leaves: DataFrame, tallest: int) -> DataFrame:
    """The logs of all trees over ``leaves`` (tree, n, idx, digest); each round writes SPAN levels, ``tallest`` levels in all."""
    nodes, logs = leaves, []
    for base in range(0, max(tallest, 1), SPAN):
        span = F.shiftright("idx", BITS * SPAN).alias("span")
        built = nodes.select("tree", "n", "idx", "digest").groupBy("tree", span).applyInPandas(partial(_build, base=base), LOG)
        logs.append(settle(built, f"manifest-log{base}"))
        nodes = logs[-1].filter((F.col("level") == base + SPAN) & (F.col("n") > 1 << (BITS * (base + SPAN))))
    out = logs[0]
    for more in logs[1:]:
        out = out.union(more)
    return out


@dataclass
class Manifest:
    """``leaves``: tree, n, idx, digest and the caller's columns; ``log`` and ``top_log``: the trees of the sources and the one above;
    ``roots``: tree, n, idx (place among the sources), top_n, digest (subroot); ``root``: hex, None for an empty table."""

    leaves: DataFrame
    log: DataFrame
    roots: DataFrame
    top_log: DataFrame
    root: str | None
    tallest: int
    top_height: int


def build_manifest(leaves: DataFrame) -> Manifest:
    """The manifest of ``leaves`` (tree, id, digest and more): one tree for each value of ``tree``, ascending by (id, digest)."""
    placed = settle(ranked(leaves, "tree", ["id", "digest"]), "manifest-leaves")
    tallest = height(int(placed.agg(F.max("n")).first()[0] or 0))
    log = append_log(placed, tallest)
    # the last node that is appended is the root: its place is the number of nodes, less one
    nodes = F.col("n")
    for k in range(1, tallest + 1):
        nodes = nodes + F.when(F.col("n") > 1 << (BITS * (k - 1)), F.shiftright(F.col("n") + ((1 << (BITS * k)) - 1), BITS * k)).otherwise(F.lit(0))
    subroots = settle(log.filter(F.col("position") == nodes - 1).select(F.lit(TOP).alias("top"), "tree", "n", "digest"), "manifest-subroots")
    above = settle(ranked(subroots.withColumnRenamed("n", "leaves"), "top", ["tree"]), "manifest-roots")
    roots = above.select("tree", F.col("leaves").alias("n"), "idx", F.col("n").alias("top_n"), "digest")
    n_trees = roots.agg(F.max("top_n")).first()[0] or 0
    top_log = append_log(above.select(F.col("top").alias("tree"), "n", "idx", "digest"), height(n_trees))
    last = top_log.filter(F.col("position") == position(height(n_trees), np.array([0]), n_trees).item()).first() if n_trees else None
    return Manifest(placed, log, roots, top_log, last.digest.hex() if last else None, tallest, height(n_trees))


# ---- proofs ------------------------------------------------------------------------------------------

PATH = "tree string, idx long, siblings binary, shape binary"


def _runs(base: int, n: int, idx: np.ndarray, positions: np.ndarray, digests: list[str]):
    """For each level of a span: each node's place in its run, and its run's digests."""
    for level in range(base, min(base + SPAN, height(n))):
        node = idx >> (BITS * (level - base))
        begin = node >> BITS << BITS
        size = np.minimum(FAN, level_size(n, level) - begin)
        runs = {}
        for b, s in {*zip(begin.tolist(), size.tolist(), strict=True)}:
            at = np.searchsorted(positions, position(level, np.arange(b, b + s), n))
            runs[b] = [digests[k] for k in at]
        yield [(runs[b], p) for b, p in zip(begin.tolist(), (node - begin).tolist(), strict=True)]


def _paths(nodes: pd.DataFrame, segment: pd.DataFrame, base: int):
    """(siblings, shape) of each node of a span up to the root, the siblings as hex, from the log's segment and the span's own path."""
    tail = segment[segment["position"] < 0].iloc[0]
    segment = segment[segment["position"] >= 0].sort_values("position")
    digests = [d.hex() for d in segment["digest"]]
    above = [tail["digest"][k : k + 32].hex() for k in range(0, len(tail["digest"]), 32)]
    above_shape = [*zip(tail["shape"][::2], tail["shape"][1::2], strict=True)]
    levels = [*_runs(base, int(nodes["n"].iloc[0]), nodes["idx"].to_numpy(), segment["position"].to_numpy(), digests)]
    for k in range(len(nodes)):
        siblings, shape = [], []
        for level in levels:
            run, place = level[k]
            siblings += run[:place] + run[place + 1 :]
            shape.append((place, len(run)))
        yield siblings + above, shape + above_shape


def _extend(nodes: pd.DataFrame, segment: pd.DataFrame, base: int) -> pd.DataFrame:
    if not len(nodes):
        return pd.DataFrame(columns=["tree", "idx", "siblings", "shape"])
    found = [*_paths(nodes, segment, base)]
    return pd.DataFrame({"tree": nodes["tree"].to_numpy(), "idx": nodes["idx"].to_numpy(), "siblings": [bytes.fromhex("".join(s)) for s, _ in found], "shape": [bytes(x for p in h for x in p) for _, h in found]})


def _segments(log: DataFrame, paths: DataFrame, base: int) -> DataFrame:
    """What a span needs: the log's rows of its levels, and as position -1 the path of its root (tree, span, siblings, shape)."""
    rows = log.filter((F.col("level") >= base) & (F.col("level") < base + SPAN)).select("tree", F.shiftright("idx", 0).alias("at"), "level", "position", "digest")
    spans = F.expr(f"shiftright(at, {BITS * SPAN} - {BITS} * (level - {base}))")
    return rows.select("tree", spans.alias("span"), "position", "digest", F.lit(None).cast("binary").alias("shape")).union(paths.select("tree", "span", F.lit(-1).cast("long"), F.col("siblings"), "shape"))


def _descend(log: DataFrame, tallest: int, root_paths: DataFrame) -> DataFrame:
    """Paths of the spans of the leaves, from those of the trees' roots (tree, n, siblings, shape), a round of SPAN levels at a time."""
    found = None
    for base in range((max(tallest, 1) - 1) // SPAN * SPAN, -1, -SPAN):
        lone = root_paths.filter((F.col("n") <= 1 << (BITS * (base + SPAN))) & ((F.col("n") > 1 << (BITS * base)) | F.lit(base == 0)))
        paths = lone.select("tree", F.lit(0).cast("long").alias("span"), "siblings", "shape")
        if found is not None:
            paths = paths.union(found.select("tree", F.col("idx").alias("span"), "siblings", "shape"))
        if base == 0:
            return _segments(log, paths, 0)
        nodes = log.filter((F.col("level") == base) & (F.col("n") > 1 << (BITS * base))).select("tree", "n", "idx", F.shiftright("idx", BITS * SPAN).alias("span"))
        right = _segments(log, paths, base)
        found = settle(nodes.groupBy("tree", "span").cogroup(right.groupBy("tree", "span")).applyInPandas(partial(_extend, base=base), PATH), f"manifest-paths{base}")
    raise AssertionError


def _check(leaves: pd.DataFrame, segment: pd.DataFrame) -> pd.DataFrame:
    columns = ["tree", "idx", "proof", "shape", "folded"]
    if not len(leaves):
        return pd.DataFrame(columns=columns)
    known: dict = {}  # folds of the nodes above, which most leaves of a span share

    def climb(digest: str, siblings: list[str], shape: list[tuple[int, int]], at: int, level: int, node: int) -> str:
        if level == len(shape):
            return digest
        key = (level, node, digest)
        if key not in known:
            place, size = shape[level]
            run = siblings[at : at + size - 1]
            known[key] = climb(hashed(*run[:place], digest, *run[place:]), siblings, shape, at + size - 1, level + 1, node >> BITS)
        return known[key]

    out = []
    for tree, idx, seen, (siblings, shape) in zip(leaves["tree"], leaves["idx"], leaves["seen"], _paths(leaves, segment, 0), strict=True):
        out.append((tree, idx, hashed(*siblings), bytes(x for p in shape for x in p), climb(seen.hex(), siblings, shape, 0, 0, int(idx))))
    return pd.DataFrame(out, columns=columns)


def prove(manifest: Manifest, seen: str = "digest") -> DataFrame:
    """For each leaf its tree and idx, ``proof`` (sha256 of its siblings up to the root), ``shape`` (bytes: place and length of its run, a
    level) and ``folded``, the root that the digest in column ``seen`` and the siblings in the log give."""
    top_leaves = manifest.roots.select(F.lit(TOP).alias("tree"), F.col("top_n").alias("n"), "idx", F.col("tree").alias("name"), F.col("n").alias("leaves"), F.shiftright("idx", BITS * SPAN).alias("span"))
    nothing = F.lit(b"").cast("binary")
    over = manifest.roots.limit(1).select(F.lit(TOP).alias("tree"), F.col("top_n").alias("n"), nothing.alias("siblings"), nothing.alias("shape"))
    segments = _descend(manifest.top_log, manifest.top_height, over)
    above = settle(top_leaves.groupBy("tree", "span").cogroup(segments.groupBy("tree", "span")).applyInPandas(partial(_extend, base=0), PATH), "manifest-top")
    root_paths = settle(top_leaves.join(above.select("idx", "siblings", "shape"), "idx").select(F.col("name").alias("tree"), F.col("leaves").alias("n"), "siblings", "shape"), "manifest-root-paths")
    leaves = manifest.leaves.select("tree", "n", "idx", F.col(seen).alias("seen"), F.shiftright("idx", BITS * SPAN).alias("span"))
    segments = _descend(manifest.log, manifest.tallest, root_paths)
    return leaves.groupBy("tree", "span").cogroup(segments.groupBy("tree", "span")).applyInPandas(_check, "tree string, idx long, proof string, shape binary, folded string")


def tree_of(source: Column) -> Column:
    return F.coalesce(F.concat(F.lit("s"), source.cast("string")), F.lit("n"))


def verify_documents(docs: DataFrame, fields: tuple[str, ...] = FIELDS, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", tampered: Column | None = None) -> DataFrame:
    """One row per document: id, leaf, subroot, root, proof_sha256, folded_root, verified.

    Where ``tampered`` holds, the document is checked as if the letters A-Z of its text had been lower-cased. Null ids come first in
    their source; rows that share an id, and repeated rows, are leaves of their own, in the order of their digests; null fields are
    ``-``, empty ones ``0:``; a null source is a tree of its own, before the others; texts of any length are hashed whole by Spark; an
    empty table gives an empty one. Columns besides ``fields`` take no part, whatever their names.
    """
    plain = [F.col(f"`{c}`") for c in fields]
    changed = [ascii_lower(c) if name == text_col else c for c, name in zip(plain, fields, strict=True)]
    wrong = F.coalesce(tampered, F.lit(False)) if tampered is not None else F.lit(False)
    hexed = docs.select(tree_of(F.col(f"`{source_col}`")).alias("tree"), F.col(f"`{id_col}`").alias("id"), leaf_digest(plain).alias("leaf"), F.when(wrong, leaf_digest(changed)).alias("other"))
    leaves = settle(hexed.select("tree", "id", F.unhex("leaf").alias("digest"), F.unhex(F.coalesce("other", "leaf")).alias("seen")), "manifest-hashed")
    manifest = build_manifest(leaves)
    proofs = prove(manifest, "seen")
    subroots = manifest.roots.select("tree", F.lower(F.hex("digest")).alias("subroot"))
    named = manifest.leaves.select("tree", "idx", F.col("id").alias(id_col), F.lower(F.hex("digest")).alias("leaf"))
    root = F.lit(manifest.root).cast("string")
    return proofs.join(named, ["tree", "idx"]).join(subroots, "tree").select(id_col, "leaf", "subroot", root.alias("root"), F.col("proof").alias("proof_sha256"), F.col("folded").alias("folded_root"), (F.col("folded") == root).alias("verified"))
