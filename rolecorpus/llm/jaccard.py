"""N-gram Jaccard join: all links of similarity 0.75 or more between sets of word shingles, by signature trees.

1. One pass over the texts makes the sets and keeps them in blocks, a table bucketed by block.
2. Shingles are counted: blocks send 32-bit prints of theirs to buckets, which answer with how many sets hold each, as a
   power of two. With all shingles in one order, the rarest first, two sets that are similar enough share one of each's
   first floor(n / 4) + 1 shingles. A shingle that one set alone holds links nothing, so only the others are keys, and most sets have
   none: they are out before anything is compared. The order decides the cost, never the result.
3. The sets that share a key with others form a group under the least of them, the same for all keys if it can be, so that
   sets that share many keys meet once or twice and not once for each key.
4. Each group goes through signature trees: nodes hold the OR of their sets' bitmaps and size ranges, and a dual
   traversal drops pairs of nodes whose greatest possible overlap is too small or whose sets are linked already. What is
   left is compared exactly, a few pairs for each component at a time, so a family of m copies costs about m comparisons.
5. A group too large for a task is dealt out in parts, each with the group's leader. If components remain, the parts, now
   by component, are summed up as entries of a tree whose traversal says which parts must still meet.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, mix64, row_key, settle, settle_bucketed, shingle_sets, spare
from .graph import connected_components

#: 100 * overlap >= PERCENT * union links two sets.
PERCENT = 75
#: Characters of text that are made into sets at a time, and shingles of a block; a longer text is alone.
PIECE, BLOCK = 1 << 19, 1 << 19
#: Shingles that are counted in one bucket.
BUCKET = 1 << 21
#: Shingles of the sets that one traversal holds.
GROUP = 1 << 22
LEAF = 16
#: Bits of the bitmap that sums up a part of a large group.
SUMMARY = 1 << 14


def needed_overlap(total: np.ndarray | int) -> np.ndarray | int:
    """Least overlap of two linked sets whose sizes add up to ``total``."""
    return -(-PERCENT * total // (100 + PERCENT))


def prefix_length(n: np.ndarray | int) -> np.ndarray | int:
    """Elements of a set of n, in any order common to all sets, of which one is in the prefix of each set it links to:
    the smallest partner has ceil(0.75 n)."""
    return n - -(-PERCENT * n // 100) + 1


def set_keys(flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """64-bit hash of each set of hashes; of an empty one 0. Different sets share one with a chance of about pairs / 2**64."""
    out = np.zeros(len(sizes), np.uint64)
    full = np.flatnonzero(sizes)
    if len(full):
        begin = np.cumsum(sizes[full]) - sizes[full]
        out[full] = mix64(np.bitwise_xor.reduceat(mix64(flat + np.uint64(0x51ED270B)), begin) + sizes[full].astype(np.uint64))
    return out.view(np.int64)


# ---- comparing the sets of a group -------------------------------------------------------------------


class Group:
    """Sets, one after another in ``flat``, with the component each is in; components grow as links are found."""

    def __init__(self, flat: np.ndarray, sizes: np.ndarray, component: np.ndarray):
        self.flat, self.sizes = flat, sizes
        self.begin = np.cumsum(sizes) - sizes
        self.least = flat[self.begin] if len(flat) else flat
        self.number = np.unique(flat, return_inverse=True)[1]
        self.part = np.unique(component, return_inverse=True)[1]
        self.links: list[tuple[int, int]] = []

    def _elements(self, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The elements of sets k as (place in k, number), in order."""
        size = self.sizes[k]
        end = np.cumsum(size)
        return np.repeat(np.arange(len(k)), size), self.number[np.arange(end[-1]) + np.repeat(self.begin[k] - end + size, size)]

    def linked(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Whether sets x and y are linked, by their elements."""
        out = np.zeros(len(x), bool)
        at = 0
        through = np.cumsum(self.sizes[x] + self.sizes[y])
        while at < len(x):
            stop = max(at + 1, int(np.searchsorted(through, (through[at - 1] if at else 0) + (1 << 20))))
            a, b = x[at:stop], y[at:stop]
            (pa, ea), (pb, eb) = self._elements(a), self._elements(b)
            codes, asked = pa * (len(self.flat) + 1) + ea, pb * (len(self.flat) + 1) + eb
            found = np.searchsorted(codes, asked)
            hit = codes[np.minimum(found, len(codes) - 1)] == asked
            out[at:stop] = np.bincount(pb[hit], minlength=len(a)) >= needed_overlap(self.sizes[a] + self.sizes[b])
            at = stop
        return out

    def join(self, x: np.ndarray, y: np.ndarray) -> None:
        """Take in that sets x and y are linked, and keep the links that join two components."""
        up = list(range(int(self.part.max()) + 1))

        def root(k: int) -> int:
            while up[k] != k:
                up[k] = k = up[up[k]]
            return k

        for i, j, p, q in zip(x.tolist(), y.tolist(), self.part[x].tolist(), self.part[y].tolist(), strict=True):
            p, q = root(p), root(q)
            if p != q:
                up[max(p, q)] = min(p, q)
                self.links.append((i, j))
        self.part = np.array([root(k) for k in range(len(up))])[self.part]

    def compare(self, x: np.ndarray, y: np.ndarray) -> None:
        """Compare pairs until each is refused or within one component: in each round a few for every component."""
        share = 1
        while True:
            apart = self.part[x] != self.part[y]
            x, y = x[apart], y[apart]
            if not len(x):
                return
            order = np.argsort(self.part[x], kind="stable")
            x, y = x[order], y[order]
            new = np.flatnonzero(np.diff(self.part[x], prepend=-1))
            rank = np.arange(len(x)) - np.repeat(new, np.diff(np.append(new, len(x))))
            now = rank < share
            a, b = x[now], y[now]
            ok = self.linked(a, b)
            self.join(a[ok], b[ok])
            x, y, share = x[~now], y[~now], share * 2

    def maps(self, own: np.ndarray, width: int) -> np.ndarray:
        """Bitmaps of some sets as rows of 64-bit words."""
        out = np.zeros((len(own), width // 64), np.uint64)
        step = max(1, (1 << 24) // width)
        for k in range(0, len(own), step):
            part = own[k : k + step]
            size = self.sizes[part]
            end = np.cumsum(size)
            dense = np.zeros((len(part), width), np.uint8)
            bits = self.flat[np.arange(end[-1]) + np.repeat(self.begin[part] - end + size, size)] & np.uint64(width - 1)
            dense[np.repeat(np.arange(len(part)), size), bits.astype(np.int64)] = 1
            out[k : k + step] = np.packbits(dense, axis=1, bitorder="little").view(np.uint64)
        return out


class SignatureTree:
    """A balanced binary tree over entries in their order. A node is the OR of its entries' bitmaps, their least and
    greatest size, their greatest excess (elements beyond distinct bits), and their least and greatest component."""

    HOW = (np.bitwise_or, np.minimum, np.maximum, np.maximum, np.minimum, np.maximum)

    def __init__(self, entries: tuple[np.ndarray, ...], leaf: int = LEAF):
        self.entries, self.leaf = entries, leaf
        self.levels = [entries] if leaf == 1 else [self._above(entries, leaf)]
        while len(self.levels[-1][0]) > 1:
            self.levels.append(self._above(self.levels[-1], 2))

    def _above(self, below: tuple[np.ndarray, ...], each: int) -> tuple[np.ndarray, ...]:
        starts = np.arange(0, len(below[0]), each)
        return tuple(f.reduceat(v, starts, axis=0) for f, v in zip(self.HOW, below, strict=True))

    def relabel(self, component: np.ndarray) -> None:
        """The leaves' components after links were found."""
        self.entries = (*self.entries[:4], component, component)
        starts = np.arange(0, len(component), self.leaf)
        self.levels[0] = (*self.levels[0][:4], np.minimum.reduceat(component, starts), np.maximum.reduceat(component, starts))


def may_link(a: tuple, i: np.ndarray, b: tuple, j: np.ndarray) -> np.ndarray:
    """Whether nodes a[i] and b[j] may hold a linked pair of different components: the overlap of two sets is at most
    the common bits of their bitmaps and the lesser excess, and at most the lesser size."""
    overlap = np.bitwise_count(a[0][i] & b[0][j]).sum(axis=1).astype(np.int64) + np.minimum(a[3][i], b[3][j])
    overlap = np.minimum(overlap, np.minimum(a[2][i], b[2][j]))
    one = (a[4][i] == a[5][i]) & (b[4][j] == b[5][j]) & (a[4][i] == b[4][j])
    return (overlap >= needed_overlap(a[1][i] + b[1][j])) & ~one


def leaf_pairs(a: SignatureTree, b: SignatureTree) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of leaves that may hold a linked pair, by dual traversal from the roots; each once if both trees are one."""
    i = j = np.zeros(1, np.int64)
    for level in range(max(len(a.levels), len(b.levels)) - 1, -1, -1):
        la, lb = min(level, len(a.levels) - 1), min(level, len(b.levels) - 1)
        keep = np.concatenate([may_link(a.levels[la], i[k : k + 65536], b.levels[lb], j[k : k + 65536]) for k in range(0, len(i), 65536)])
        i, j = i[keep], j[keep]
        if not level or not len(i):
            break
        below_a, below_b = min(level - 1, len(a.levels) - 1), min(level - 1, len(b.levels) - 1)
        left = [2 * i, 2 * i + 1] if below_a < la else [i]
        right = [2 * j, 2 * j + 1] if below_b < lb else [j]
        i, j = np.concatenate([x for x in left for _ in right]), np.concatenate([y for _ in left for y in right])
        inside = (i < len(a.levels[below_a][0])) & (j < len(b.levels[below_b][0]))
        if a is b:
            inside &= i <= j
        i, j = i[inside], j[inside]
    return i, j


def width_of(n: np.ndarray) -> np.ndarray:
    """Bits of the bitmap of a set of n in a tree: a power of two, 4 times n at least and 8 times at most."""
    return np.maximum(64, 4 << np.ceil(np.log2(np.maximum(n, 1))).astype(np.int64))


def group_links(group: Group) -> list[tuple[int, int]]:
    """Links of the group that connect all that its links connect, beyond the components given.

    A tree for each bitmap width is compared with itself and with the next width, as the sizes of linked sets differ by a
    third at most. Sets stand in a tree by their least elements, which similar sets tend to share.
    """
    widths = width_of(group.sizes)
    for w in np.unique(widths).tolist():
        sides = []
        for own in (np.flatnonzero(widths == w), np.flatnonzero(widths == 2 * w)):
            if len(own):
                own = own[np.lexsort((group.sizes[own], group.least[own]))]
                maps, n = group.maps(own, w), group.sizes[own]
                sides.append((own, SignatureTree((maps, n, n, n - np.bitwise_count(maps).sum(axis=1).astype(np.int64), group.part[own], group.part[own]))))
        own, tree = sides[0]
        for other, mate in sides:
            i, j = leaf_pairs(tree, mate)
            # near leaves first: what they link, the others need not compare
            gap = np.abs(i - j)
            wave = np.where(gap < 2, gap, 1 + np.ceil(np.log2(np.maximum(gap, 1))).astype(np.int64))
            for k in np.unique(wave).tolist():
                chosen = np.flatnonzero(wave == k)
                for at in range(0, len(chosen), 1024):
                    x, y = i[chosen[at : at + 1024]], j[chosen[at : at + 1024]]
                    for side, t in ((own, tree), (other, mate)):
                        t.relabel(group.part[side])
                    a, b = tree.levels[0], mate.levels[0]
                    one = (a[4][x] == a[5][x]) & (b[4][y] == b[5][y]) & (a[4][x] == b[4][y])
                    x, y = x[~one], y[~one]
                    x = np.repeat(x * LEAF, LEAF * LEAF) + np.tile(np.repeat(np.arange(LEAF), LEAF), len(x))
                    y = np.repeat(y * LEAF, LEAF * LEAF) + np.tile(np.arange(LEAF), LEAF * len(y))
                    inside = (x < len(own)) & (y < len(other))
                    if mate is tree:
                        inside &= x < y
                    x, y = x[inside], y[inside]
                    keep = may_link(tree.entries, x, mate.entries, y)
                    group.compare(own[x[keep]], other[y[keep]])
    return group.links


def pack_sets(flat: np.ndarray) -> bytes:
    """Sorted hashes, the bytes of one weight together: the upper ones hardly change from one to the next."""
    return zstandard.compress(np.ascontiguousarray(flat.view(np.uint8).reshape(-1, 8).T).tobytes(), 1)


def unpack_sets(packed: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(packed), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view(np.uint64).ravel()


# ---- sets and their counts ---------------------------------------------------------------------------


def _blocks(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(block, keys, ids, sizes, nodes, sets): the sets of the rows, in blocks of some half a million shingles."""
    own = docs.select(row_key(id_col, text_col).alias("k"), F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task, n, held, total = TaskContext.get().partitionId(), 0, [], 0

        def row() -> pd.DataFrame:
            keys, ids, flats, sizes = zip(*held, strict=True)
            flat, size = np.concatenate(flats), np.concatenate(sizes)
            return pd.DataFrame({"block": [(task << 32) + n], "keys": [np.concatenate(keys)], "ids": [[i for part in ids for i in part]], "sizes": [size], "nodes": [set_keys(flat, size)], "sets": [pack_sets(flat)]})

        for b in batches:
            length = np.array([len(t or "") for t in b["text"]], np.int64)
            piece = np.cumsum(length) // PIECE
            edges = [0, *(np.flatnonzero(np.diff(piece)) + 1).tolist(), len(b)]
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                part = b.iloc[lo:hi]
                flat, sizes = shingle_sets(part["text"].tolist())
                held.append((part["k"].to_numpy(np.int64), part["id"].tolist(), flat, sizes.astype(np.int64)))
                total += len(flat)
                if total >= BLOCK:
                    yield row()
                    n, held, total = n + 1, [], 0
        if held:
            yield row()

    return settle_bucketed(own.mapInPandas(run, "block long, keys array<long>, ids array<string>, sizes array<long>, nodes array<long>, sets binary"), "block", "jaccard-blocks", "none")


def _distinct(row: dict) -> tuple[np.ndarray, ...]:
    """Of a block's different sets: (nodes, sizes, flat, shingles, which shingle each element is, sets with each shingle)."""
    sizes, nodes = np.asarray(row["sizes"], np.int64), np.asarray(row["nodes"], np.int64)
    first = np.zeros(len(nodes), bool)
    first[np.unique(nodes, return_index=True)[1]] = True
    first &= sizes > 0
    flat = unpack_sets(row["sets"])[np.repeat(first, sizes)]
    return nodes[first], sizes[first], flat, *np.unique(flat, return_inverse=True, return_counts=True)


def _prints(shingles: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and 32-bit print of sorted shingles: the range of hashes is dealt out, so both are in order."""
    spread = (shingles >> np.uint64(24)) * np.uint64(n)
    return (spread >> np.uint64(40)).astype(np.int64), ((spread >> np.uint64(8)) & np.uint64(0xFFFFFFFF)).astype(np.int64)


def _runs(sorted_values: np.ndarray) -> Iterator[tuple[int, slice]]:
    """Each value of a sorted array with its slice."""
    edges = np.flatnonzero(np.diff(sorted_values, prepend=-1)).tolist()
    for a, b in zip(edges, [*edges[1:], len(sorted_values)][: len(edges)], strict=True):
        yield int(sorted_values[a]), slice(a, b)


def _counts(blocks: DataFrame, n: int) -> DataFrame:
    """(block, parts): for each of a block's shingles, in order, the power of two up to which sets hold it, by bucket."""

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for row in b.to_dict("records"):
                *_, shingles, _, many = _distinct(row)
                bucket, prints = _prints(shingles, n)
                rows = []
                for k, at in _runs(bucket):
                    steps = np.diff(prints[at], prepend=0).astype(np.uint32).view(np.uint8).reshape(-1, 4).T  # bytes of one weight together
                    rows.append((k, row["block"], at.stop - at.start, zstandard.compress(steps.tobytes() + np.minimum(many[at], 255).astype(np.uint8).tobytes(), 1)))
                yield pd.DataFrame(rows, columns=["bucket", "block", "n", "prints"])

    def answer(pdf: pd.DataFrame) -> pd.DataFrame:
        prints, many = [], []
        for size, packed in zip(pdf["n"].tolist(), pdf["prints"], strict=True):
            raw = np.frombuffer(zstandard.decompress(packed), np.uint8)
            prints.append(np.cumsum(np.ascontiguousarray(raw[: 4 * size].reshape(4, size).T).view(np.uint32).ravel(), dtype=np.uint64).astype(np.uint32))
            many.append(raw[4 * size :])
        _, which = np.unique(np.concatenate(prints), return_inverse=True)
        held = np.bincount(which, weights=np.concatenate(many))
        power = np.minimum(15, np.ceil(np.log2(held))).astype(np.uint8)[which]
        ends = np.cumsum(pdf["n"].to_numpy(np.int64))
        return pd.DataFrame({"block": pdf["block"], "bucket": pdf["bucket"], "powers": [zstandard.compress(power[e - s : e].tobytes(), 1) for e, s in zip(ends.tolist(), pdf["n"].tolist(), strict=True)]})

    sent = blocks.select("block", "sizes", "nodes", "sets").mapInPandas(send, "bucket long, block long, n long, prints binary")
    answered = sent.groupBy("bucket").applyInPandas(answer, "block long, bucket long, powers binary")
    return answered.groupBy("block").agg(F.collect_list(F.struct("bucket", "powers")).alias("parts"))


def _candidates(blocks: DataFrame, counts: DataFrame) -> DataFrame:
    """(node, n, keys, s) of the sets with a shared shingle among the rarest floor(n / 4) + 1; a set once for each block that has it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for row in b.to_dict("records"):
                nodes, sizes, flat, shingles, which, _ = _distinct(row)
                if not len(flat):
                    continue
                power = np.concatenate([np.frombuffer(zstandard.decompress(p["powers"]), np.uint8) for p in sorted(row["parts"], key=lambda p: p["bucket"])])[which]
                owner = np.repeat(np.arange(len(sizes)), sizes)
                begin = np.cumsum(sizes) - sizes
                order = np.argsort(owner * 16 + power, kind="stable")  # in a set by power, then by hash
                early = order[np.arange(len(flat)) - begin[owner] < prefix_length(sizes)[owner]]
                early = early[power[early] > 0]
                found = np.flatnonzero(np.bincount(owner[early], minlength=len(sizes)))
                at = np.searchsorted(owner[early], np.arange(len(sizes) + 1))
                keys = flat[early].view(np.int64)
                yield pd.DataFrame({
                    "node": nodes[found], "n": sizes[found], "keys": pd.Series([keys[at[k] : at[k + 1]] for k in found.tolist()], dtype=object),
                    "s": pd.Series([flat[begin[k] : begin[k] + sizes[k]].tobytes() for k in found.tolist()], dtype=object),
                })

    joined = blocks.select("block", "sizes", "nodes", "sets").join(counts.hint("shuffle_hash"), "block")
    return settle(joined.mapInPandas(run, "node long, n long, keys array<long>, s binary"), "jaccard-candidates")


# ---- groups ------------------------------------------------------------------------------------------


def _each_group(batches: Iterator[pd.DataFrame], columns: list[str]) -> Iterator[pd.DataFrame]:
    """The groups of rows that come in order; no more than one is held."""
    held: list[pd.DataFrame] = []
    for b in batches:
        names = b[columns].to_numpy(np.int64)
        edges = (np.flatnonzero((names[1:] != names[:-1]).any(axis=1)) + 1).tolist()
        for lo, hi in zip([0, *edges], [*edges, len(b)], strict=True):
            part = b.iloc[lo:hi]
            if held and lo < hi and (held[-1][columns].iloc[-1] != part[columns].iloc[0]).any():
                yield pd.concat(held)
                held = []
            held.append(part)
    if held:
        yield pd.concat(held)


def _in_groups(rows: DataFrame, columns: list[str], work: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """``work`` on the rows of each group, one group in memory at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in _each_group(batches, columns):
            yield work(g)

    return rows.repartition(*columns).sortWithinPartitions(*columns).mapInPandas(run, schema)


def _group(g: pd.DataFrame) -> Group:
    return Group(np.frombuffer(b"".join(g["s"]), np.uint64), g["n"].to_numpy(np.int64), g["component"].to_numpy(np.int64))


def _traverse(g: pd.DataFrame) -> pd.DataFrame:
    """The links (a, b) that connect a group's sets."""
    g = g.drop_duplicates("node")
    nodes = g["node"].to_numpy(np.int64)
    found = np.array(group_links(_group(g)) if g["component"].nunique() > 1 else [], np.int64).reshape(-1, 2)
    return pd.DataFrame({"a": nodes[found[:, 0]], "b": nodes[found[:, 1]]})


def _sum_up(g: pd.DataFrame) -> pd.DataFrame:
    """One row for a part of a large group: what a node of a tree holds."""
    group = _group(g)
    bits = np.unique(group.flat & np.uint64(SUMMARY - 1))
    dense = np.zeros(SUMMARY, np.uint8)
    dense[bits.astype(np.int64)] = 1
    owner = np.repeat(np.arange(len(g)), group.sizes)
    distinct = np.bincount(np.unique(owner * SUMMARY + (group.flat & np.uint64(SUMMARY - 1)).astype(np.int64)) // SUMMARY, minlength=len(g))
    c = g["component"].to_numpy(np.int64)
    return pd.DataFrame({"leader": g["leader"].iloc[:1], "part": g["part"].iloc[:1], "map": [np.packbits(dense, bitorder="little").tobytes()], "least": group.sizes.min(), "most": group.sizes.max(), "excess": (group.sizes - distinct).max(), "low": c.min(), "high": c.max()})


def _meet(g: pd.DataFrame) -> pd.DataFrame:
    """The pairs of parts of a large group that may hold a link between components."""
    g = g.sort_values(["low", "most"])
    columns = [g[c].to_numpy(np.int64) for c in ("least", "most", "excess", "low", "high")]
    tree = SignatureTree((np.frombuffer(b"".join(g["map"]), np.uint64).reshape(len(g), -1), *columns), leaf=1)
    i, j = leaf_pairs(tree, tree)
    part = g["part"].to_numpy(np.int64)
    return pd.DataFrame({"leader": g["leader"].iloc[0], "i": part[i], "j": part[j]}, columns=["leader", "i", "j"])


def _links(candidates: DataFrame, group: int) -> DataFrame:
    """(a, b): links between sets that connect all that links connect."""
    keyed = candidates.select("node", "n", F.explode("keys").alias("key"))
    shared = keyed.groupBy("key").agg(F.min("node").alias("leader"), F.max("node").alias("other")).filter("leader != other").select("key", "leader")
    members = settle(keyed.join(shared, "key").groupBy("leader", "node").agg(F.min("n").alias("n")), "jaccard-members")
    large = members.groupBy("leader").agg(F.ceil(F.sum("n") / group).alias("parts")).filter("parts > 1")
    large = settle(large, "jaccard-large")
    wanted = broadcast_if_small(members.select("node").distinct())
    sets = settle(candidates.select("node", "s").join(wanted, "node", "left_semi").dropDuplicates(["node"]), "jaccard-wanted", "none")
    # parts of a large group by chance, its leader in all of them
    part = F.pmod(F.xxhash64("node"), F.coalesce("parts", F.lit(1)))
    parts = F.when(F.col("node") == F.col("leader"), F.sequence(F.lit(0).cast("long"), F.coalesce("parts", F.lit(1)) - 1)).otherwise(F.array(part))
    dealt = members.join(broadcast_if_small(large), "leader", "left").select("leader", "node", "n", F.col("node").alias("component"), F.explode(parts).alias("part"))
    links = settle(_in_groups(dealt.join(sets, "node"), ["leader", "part"], _traverse, "a long, b long"), "jaccard-links")
    if not large.limit(1).count():
        return links
    # large groups of several components: parts by component, those of large components apart
    labels = connected_components(links)
    placed = members.join(broadcast_if_small(large), "leader").join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    placed = settle(placed, "jaccard-placed")
    mixed = placed.groupBy("leader").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low != high").select("leader")
    if not mixed.limit(1).count():
        return links
    weight = placed.groupBy("leader", "component").agg(F.ceil(F.sum("n") / group).alias("own"))
    alone = F.xxhash64("component", F.pmod(F.xxhash64("node"), F.col("own")))
    among = F.pmod(F.xxhash64("component", F.lit(1)), F.col("parts"))
    placed = placed.join(mixed, "leader", "left_semi").join(weight, ["leader", "component"]).withColumn("part", F.when(F.col("own") > 1, alone).otherwise(among))
    whole = settle(placed.select("leader", "part", "node", "n", "component").join(sets, "node"), "jaccard-parts", "none")
    sums = _in_groups(whole, ["leader", "part"], _sum_up, "leader long, part long, map binary, least long, most long, excess long, low long, high long")
    pairs = settle(_in_groups(sums, ["leader"], _meet, "leader long, i long, j long"), "jaccard-meet")
    either = pairs.select("leader", "i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("part"))
    again = _in_groups(either.join(whole, ["leader", "part"]), ["leader", "i", "j"], _traverse, "a long, b long")
    return settle(links.union(again), "jaccard-all-links")


def _placed(docs: DataFrame, id_col: str, text_col: str, group: int) -> DataFrame:
    """(row_key, doc_id, n_shingles, component, component_id) of each distinct row; component is null without shingles."""
    blocks = _blocks(docs, id_col, text_col)
    total = blocks.agg(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda s, n: s + n))).first()[0] or 0
    candidates = _candidates(blocks, _counts(blocks, max(8, -(-total // BUCKET))))
    labels = connected_components(_links(candidates, group))
    # from sets to rows: the smallest id of each component
    rows = blocks.select(F.explode(F.arrays_zip("keys", "ids", "sizes", "nodes")).alias("r"))
    rows = rows.select(F.col("r.keys").alias("k"), F.col("r.ids").cast(docs.schema[id_col].dataType).alias("id"), F.col("r.sizes").alias("n"), F.when(F.col("r.sizes") > 0, F.col("r.nodes")).alias("node"))
    members = rows.join(broadcast_if_small(labels), "node", "left").withColumn("component", F.coalesce("component", "node"))
    members = settle(members, "jaccard-rows")
    smallest = members.filter("component is not null").groupBy("component").agg(F.min("id").alias("smallest"), F.count("*").alias("members")).filter("members > 1").drop("members")
    return members.join(broadcast_if_small(smallest), "component", "left").dropDuplicates(["k"]).select(F.col("k").alias("row_key"), F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), "component", F.coalesce("smallest", "id").alias("component_id"))


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", group: int = GROUP) -> DataFrame:
    """(row_key, doc_id, n_shingles, component_id) of each distinct row: component_id is the smallest id that
    links reach, over all links with 100 * overlap >= 75 * union.

    Sets: distinct five-word shingles of the whole text, lower-cased in A-Z; with fewer words, the whole sequence;
    null or empty texts have none, size 0, and are components of their own, as are rows with a null id that link
    with nothing. Rows repeated with one id and text come out once; rows that share an id but not the text (null and empty
    differ) are separate. Texts of any length are worked whole, longer ones than a piece alone; ties can't occur, as all
    links count; an empty table gives no rows; other columns aren't read. Shingles are compared by 64-bit hashes.
    ``group`` is the number of shingles that one traversal holds; it changes no result.
    """
    return _placed(docs, id_col, text_col, group).drop("component")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of ``docs`` for each component: that of the smallest id, then of the smallest row key; texts without words all stay, as
    they link with nothing. Repeated rows of one id and text are one document and leave one row. Null ids come last in
    a component; nulls in other columns, and columns of any name, are kept as they are; an empty table stays empty."""
    parts = _placed(docs, id_col, text_col, GROUP)
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row_key")).alias("b")
    best = parts.filter("component is not null").groupBy("component").agg(first).select(F.col("b.row_key").alias("row_key"))
    keep = settle(best.union(parts.filter("component is null").select("row_key")), "jaccard-keep")
    key = spare(docs, "jaccard_key")
    keyed = docs.withColumn(key, row_key(id_col, text_col))
    return keyed.join(broadcast_if_small(keep.withColumnRenamed("row_key", key)), key, "left_semi").dropDuplicates([key]).drop(key)
