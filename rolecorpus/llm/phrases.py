"""Phrase collocations by best-first growth: phrases grow word by word, and only where a bound says that they can still matter.

A phrase that was cut after its first k words scores floor(2000000 a / (l + r)), and its score is that of its worst cut. With a prefix's
counts alone, anything that grows from it has a <= f(prefix), r >= a, and so scores at most the least of floor(2000000 f / (l + f)) over
the cuts whose first part lies in the prefix: an admissible bound, as (bound, f) bounds (score, a) in their order. Each round takes the
best ``FRONTIER`` prefixes of all languages, broadcasts their hashes (a fixed number of bytes) and counts, in one pass over the texts,
the phrases that lengthen them by a word on either side. Counts on the left are what decides whether a longer phrase takes a
shorter one's place, which needs one more word only: counts never grow with length. Rounds end when no prefix and no uncounted part
can reach a language's last surviving rank, ties included. Nothing is counted by sampling, and no phrase is cut off by a cap: a
corpus with more open prefixes takes more rounds.

Words and phrases are 64-bit hashes until the end; the texts of the phrases that are returned are read back in a last pass, which fails
if it meets two texts of one hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import PrefixHash, mix64, settle

#: Prefixes that a round expands, and parts that it looks up; bits of the filter of frequent words; bytes of texts worked at a time.
FRONTIER, FILTER_BITS, GROUP = 1 << 18, 23, 1 << 20
#: Distinct phrases that a task counts before it sends them on; ranges of hashes, for each partition of a shuffle.
HELD, RANGES = 1 << 17, 4
#: Bytes that are hashed at a time.
PIECE = 1 << 18
LONGEST, SCALE = 4, 2_000_000
_BASE = np.uint64(0x9E3779B97F4A7C15)
#: Kinds of bytes: of a word, between words, between pieces.
_KIND = np.zeros(256, np.uint8)
_KIND[[0x20, 0x09]] = 1
_KIND[[*b".,;:!?\x0a\x0b\x0c\x0d"]] = 2
_LOWERED = np.arange(256, dtype=np.uint8)
_LOWERED[65:91] += 32


def _words(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, place, bytes and piece of each word of lower-cased bytes; hashed in parts that end between words."""
    ends = np.flatnonzero(_KIND[raw] > 0)
    hard = np.flatnonzero(_KIND[raw] == 2)
    out, at = [], 0
    while at < len(raw):
        k = np.searchsorted(ends, at + PIECE)
        stop = int(ends[k]) if k < len(ends) else len(raw)
        word = _KIND[raw[at:stop]] == 0
        start = np.flatnonzero(word & np.concatenate(([True], ~word[:-1])))
        size = np.flatnonzero(word & np.concatenate((~word[1:], [True]))) + 1 - start
        if len(start):
            out.append((mix64(PrefixHash(raw[at:stop]).slices(start, size) + size.astype(np.uint64)), start + at, size))
        at = stop
    if not out:
        return np.zeros(0, np.uint64), *(np.zeros(0, np.int64),) * 3
    h, place, size = (np.concatenate(x) for x in zip(*out, strict=True))
    return h, place, size, np.searchsorted(hard, place)


def _texts(batches: Iterator[pa.RecordBatch]):
    """For each group of texts: lower-cased bytes, their words (hash with the language, place, bytes, piece) and each word's language,
    as a number into the list of languages."""
    for batch in batches:
        texts, langs, at = batch.column("text"), batch.column("lang").to_pylist(), 0
        while at < len(texts):
            stop, held, raws = at, 0, []
            while stop < len(texts) and held < GROUP:
                raws.append((texts[stop].as_py() or "").encode("utf-8", "surrogatepass"))
                held += len(raws[-1]) + 1
                stop += 1
            raw = _LOWERED[np.frombuffer(b"\n".join(raws), np.uint8)]
            h, place, size, piece = _words(raw)
            doc = np.searchsorted(np.cumsum([len(r) + 1 for r in raws]), place, side="right")
            names = sorted({x if x is not None else "und" for x in langs[at:stop]})
            number = {x: k for k, x in enumerate(names)}
            of_doc = np.array([number[x if x is not None else "und"] for x in langs[at:stop]], np.int64)
            salts = mix64(np.array([PrefixHash(np.frombuffer(b"lang" + x.encode("utf-8", "surrogatepass"), np.uint8)).sums[-1] for x in names], np.uint64))
            lang = of_doc[doc] if len(doc) else doc
            yield raw, (mix64(h ^ salts[lang]) if len(h) else h, place, size, piece), lang, names
            at = stop


def _batch(names: list[str], columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names)


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(h, lang, c) of the words of each group of texts, and with h null the words of a language in all."""
    for _, (h, *_), lang, names in _texts(batches):
        u, first, c = np.unique(h, return_index=True, return_counts=True)
        totals = np.bincount(lang, minlength=len(names))
        said = pa.array(names, pa.string())
        yield _batch(["h", "lang", "c"], [pa.concat_arrays([pa.array(u.view(np.int64)), pa.nulls(len(names), pa.int64())]), pa.concat_arrays([said.take(pa.array(lang[first])), said]), np.concatenate((c, totals)).astype(np.int64)])


def _has(sorted_: np.ndarray, x: np.ndarray) -> np.ndarray:
    if not len(sorted_) or not len(x):
        return np.zeros(len(x), bool)
    return sorted_[np.minimum(np.searchsorted(sorted_, x), len(sorted_) - 1)] == x


def _chains(h: np.ndarray, piece: np.ndarray, common: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """For each length: the hash of the phrase that begins at each word, and the places where one of common words does."""
    out = {1: (h, np.flatnonzero(common))}
    ok = common
    for n in range(2, LONGEST + 1):
        if len(h) < n:
            break
        ok = ok[:-1] & common[n - 1 :] & (piece[n - 1 :] == piece[: len(piece) - n + 1])
        out[n] = mix64(out[n - 1][0][:-1] * _BASE + h[n - 1 :]), np.flatnonzero(ok)
    return out


PARTS = [f"{side}{k}" for k in range(1, LONGEST) for side in "ps"]
COUNTED = "h long, n int, c long, " + ", ".join(f"{x} long" for x in PARTS)
BLOCKS = "r int, n int, words binary, counts binary"


def _summed(words: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Phrases given by their words' hashes, once each in order of the phrase's hash, with their counts added up."""
    h = words[:, 0]
    for k in range(1, words.shape[1]):
        h = mix64(h * _BASE + words[:, k])
    order = np.argsort(h)
    h, words, counts = h[order], words[order], counts[order]
    first = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
    return h[first], words[first], np.add.reduceat(counts, first)


def _count_phrases(batches: Iterator[pa.RecordBatch], sets, common_bits, ranges: int) -> Iterator[pa.RecordBatch]:
    """Blocks of the phrases that lengthen an expanded one, or are looked up: (range of hashes, n, words' hashes, counts). Phrases are
    counted over ``HELD`` of them before a block of each range goes out."""
    expand, wanted = sets.value
    bits = np.unpackbits(np.frombuffer(common_bits.value, np.uint8), bitorder="little").astype(bool)
    mask = np.uint64(len(bits) - 1)
    bounds = np.array([(k << 64) // ranges for k in range(1, ranges)], np.uint64)
    held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {n: [] for n in range(2, LONGEST + 1)}

    def flush(n: int) -> pa.RecordBatch:
        h, words, counts = _summed(*(np.concatenate(x) for x in zip(*held[n], strict=True)))
        held[n] = []
        cuts = [0, *np.searchsorted(h, bounds).tolist(), len(h)]
        some = [(r, lo, hi) for r, (lo, hi) in enumerate(zip(cuts, cuts[1:], strict=False)) if lo < hi]
        return _batch(["r", "n", "words", "counts"], [np.array([r for r, *_ in some], np.int32), np.full(len(some), n, np.int32), pa.array([words[lo:hi].tobytes() for _, lo, hi in some], pa.binary()), pa.array([counts[lo:hi].astype(np.uint32).tobytes() for _, lo, hi in some], pa.binary())])

    for _, (h, _, _, piece), _, _ in _texts(batches):
        chains = _chains(h, piece, bits[h & mask])
        for n in range(2, LONGEST + 1):
            if n not in chains or not (len(expand[n - 1]) or len(wanted)):
                continue
            whole, at = chains[n]
            shorter = chains[n - 1][0]
            known = np.zeros(len(shorter), bool)
            if len(expand[n - 1]):
                inside = chains[n - 1][1]
                known[inside] = _has(expand[n - 1], shorter[inside])
            at = at[known[at] | known[at + 1] | _has(wanted, whole[at])]
            if not len(at):
                continue
            _, first, c = np.unique(whole[at], return_index=True, return_counts=True)
            held[n].append((np.stack([h[at[first] + k] for k in range(n)], axis=1), c))
            if sum(len(c) for _, c in held[n]) >= HELD:
                yield flush(n)
    for n in held:
        if held[n]:
            yield flush(n)


def _sum_blocks(blocks: pd.DataFrame, least: int) -> pd.DataFrame:
    """The phrases of a range that occur ``least`` times or more, with the hashes of their first and last words."""
    out = []
    for n, some in blocks.groupby("n"):
        words = np.concatenate([np.frombuffer(x, np.uint64).reshape(-1, n) for x in some["words"]])
        h, words, c = _summed(words, np.concatenate([np.frombuffer(x, np.uint32).astype(np.int64) for x in some["counts"]]))
        often = c >= least
        h, words, c = h[often], words[often], c[often]
        frame = {"h": h.view(np.int64), "n": np.full(len(h), n, np.int32), "c": c}
        for k in range(1, LONGEST):
            for side in "ps":
                if k < n:
                    part = words[:, :k] if side == "p" else words[:, n - k :]
                    x = part[:, 0]
                    for j in range(1, k):
                        x = mix64(x * _BASE + part[:, j])
                    frame[f"{side}{k}"] = pd.array(np.ascontiguousarray(x).view(np.int64), "Int64")
                else:
                    frame[f"{side}{k}"] = pd.array([None] * len(h), "Int64")
        out.append(pd.DataFrame(frame))
    return pd.concat(out)[["h", "n", "c", *PARTS]]


def _read_phrases(batches: Iterator[pa.RecordBatch], chosen) -> Iterator[pa.RecordBatch]:
    """(h, phrase) for the chosen hashes, once a group of texts."""
    hashes = chosen.value
    for raw, (h, place, size, piece), _, _ in _texts(batches):
        for n, (whole, at) in _chains(h, piece, np.ones(len(h), bool)).items():
            at = at[_has(hashes, whole[at])]
            u, first = np.unique(whole[at], return_index=True)
            if n > 1 and len(u):
                said = [b" ".join(raw[place[k] : place[k] + size[k]].tobytes() for k in range(b, b + n)).decode("utf-8", "replace") for b in at[first].tolist()]
                yield _batch(["h", "phrase"], [u.view(np.int64), pa.array(said, pa.string())])


# ---- rounds ------------------------------------------------------------------------------------------


def _reaches(score: str, count: str = "c") -> Column:
    """(score, count) is at or above the language's last surviving rank; all are while there is none."""
    return F.col("t_score").isNull() | (F.col(score) > F.col("t_score")) | ((F.col(score) == F.col("t_score")) & (F.col(count) >= F.col("t_c")))


def _hashes(df: DataFrame) -> np.ndarray:
    return np.sort(np.asarray(df.select("h").toArrow().column("h").combine_chunks(), np.int64).view(np.uint64))


def collocations(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", least: int = 30, most: int = 2000, covers: int = 80, frontier: int = FRONTIER) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's ``most`` best phrases of 2 to 4 words that occur ``least`` times or more.

    A phrase goes if a longer one that contains it has ``covers`` hundredths of its count or more. Null and empty texts have no words,
    a null language is ``und``, long texts are counted whole, repeated rows count again, ties in (score, a) are ordered by the phrase's
    bytes, an empty table gives an empty one; other columns take no part, whatever their names.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(f"`{text_col}`").cast("string").alias("text"), F.col(f"`{lang_col}`").cast("string").alias("lang"))
    words = settle(rows.mapInArrow(_count_words, "h long, lang string, c long").groupBy("h", "lang").agg(F.sum("c").alias("c")).filter(F.col("h").isNull() | (F.col("c") >= least)), "phrases-words")
    totals = words.filter("h is null").select("lang", F.col("c").alias("total"))
    single = words.filter("h is not null").select("h", F.lit(1).alias("n"), "c", "lang")
    bit = F.col("h").bitwiseAND(F.lit((1 << FILTER_BITS) - 1))
    bitmaps = single.groupBy(F.shiftright(bit, 15).alias("b")).agg(F.bitmap_construct_agg(bit % 32768).alias("m")).collect()  # 4 KB each, 256 at most
    filled = bytearray(1 << (FILTER_BITS - 3))
    for r in bitmaps:
        filled[r.b * 4096 : r.b * 4096 + 4096] = r.m
    common_bits = spark.sparkContext.broadcast(bytes(filled))

    ranges = RANGES * int(spark.conf.get("spark.sql.shuffle.partitions"))
    known = spark.createDataFrame([], COUNTED)
    expanded = spark.createDataFrame([], "h long")
    judged = cuts = None
    while True:
        if judged is None:
            best = spark.createDataFrame([], "lang string, t_score long, t_c long")
            open_ = single.select("h", "n", F.lit(SCALE // 2).cast("long").alias("bound"), "c", "lang")
            asked = np.zeros(0, np.uint64)
        else:
            rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("c"), "h"))
            best = settle(judged.filter("survives").select("lang", "score", "c", rank.alias("rank")).filter(F.col("rank") <= most).filter(F.col("rank") == most).select("lang", F.col("score").alias("t_score"), F.col("c").alias("t_c")), "phrases-least")
            open_ = single.select("h", "n", F.lit(SCALE // 2).cast("long").alias("bound"), "c", "lang").union(judged.filter(F.col("n") < LONGEST).select("h", "n", "bound", "c", "lang"))
            lacking = judged.filter("not exact and not dropped").join(best, "lang", "left").filter(_reaches("score")).select(F.col("h").alias("of"), "score")
            parts = cuts.filter("lc is null").select(F.col("h").alias("of"), F.col("l").alias("part")).union(cuts.filter("rc is null").select("h", "r"))
            asked = _hashes(parts.join(lacking, "of").groupBy(F.col("part").alias("h")).agg(F.max("score").alias("score")).orderBy(F.desc("score"), "h").limit(frontier))
        open_ = open_.join(expanded, "h", "left_anti").join(best, "lang", "left").filter(_reaches("bound"))
        taken = settle(open_.orderBy(F.desc("bound"), F.desc("c"), "h").limit(frontier).select("h", "n"), "phrases-taken")
        expand = {n: _hashes(taken.filter(F.col("n") == n)) for n in range(1, LONGEST)}
        if not len(asked) and not any(map(len, expand.values())):
            break
        sets = spark.sparkContext.broadcast((expand, asked))
        counted = rows.mapInArrow(lambda it, sets=sets: _count_phrases(it, sets, common_bits, ranges), BLOCKS)
        summed = counted.groupBy("r").applyInPandas(lambda blocks: _sum_blocks(blocks, least), COUNTED)
        known = settle(known.union(summed).dropDuplicates(["h"]), "phrases-known")
        expanded = settle(expanded.union(taken.select("h")), "phrases-expanded")
        judged, cuts = _judge(known, single, expanded, covers)
        sets.unpersist()
    if judged is None:
        judged, _ = _judge(known, single, expanded, covers)
    chosen = settle(judged.filter("survives").join(best, "lang", "left").filter(_reaches("score")).select("h", "lang", "c", "score", "lc", "rc"), "phrases-chosen")
    said, blocks = [], -(-chosen.count() // frontier)
    for k in range(max(1, blocks)):
        some = spark.sparkContext.broadcast(_hashes(chosen.filter(F.pmod(F.xxhash64("h"), F.lit(max(1, blocks))) == k)))
        said.append(settle(rows.mapInArrow(lambda it, some=some: _read_phrases(it, some), "h long, phrase string").groupBy("h").agg(F.min("phrase").alias("phrase"), F.max("phrase").alias("other")), "phrases-said"))
    texts = said[0]
    for more in said[1:]:
        texts = texts.union(more)
    if texts.filter("phrase <> other").limit(1).count():
        raise RuntimeError("two phrases share a 64-bit hash")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("c"), "phrase")
    ranked = chosen.join(texts, "h").join(totals, "lang").select("lang", F.row_number().over(order).cast("long").alias("rank"), "phrase", F.col("c").alias("a"), F.col("lc").alias("l"), F.col("rc").alias("r"), F.col("total").alias("n"), "score")
    return ranked.filter(F.col("rank") <= most)


def _judge(known: DataFrame, single: DataFrame, expanded: DataFrame, covers: int) -> tuple[DataFrame, DataFrame]:
    """Each counted phrase with lang, score (of its worst cut, unknown parts taken as rare as they can be), that cut's counts, exact (no part is
    unknown), bound (of what grows from it), dropped and survives; and the cuts with the counts of their parts."""
    counts = single.select("h", "c").union(known.select("h", "c"))
    of_l, of_r = counts.select(F.col("h").alias("l"), F.col("c").alias("lc")), counts.select(F.col("h").alias("r"), F.col("c").alias("rc"))
    ways = [F.when(F.col("n") > k, F.struct(F.lit(k).alias("k"), F.col(f"p{k}").alias("l"), F.coalesce(*[F.when(F.col("n") == n, F.col(f"s{n - k}")) for n in range(k + 1, LONGEST + 1)]).alias("r"))) for k in range(1, LONGEST)]
    each = known.select("h", "c", F.explode(F.filter(F.array(*ways), lambda x: x.isNotNull())).alias("cut")).select("h", "c", "cut.k", "cut.l", "cut.r")
    cuts = settle(each.join(of_l, "l", "left").join(of_r, "r", "left").select("h", "c", "k", "l", "r", "lc", "rc"), "phrases-cuts")
    wide = f"cast(c as decimal(20,0)) * {SCALE}"
    scored = cuts.select("h", "lc", "rc", F.struct(F.expr(f"({wide}) div cast(coalesce(lc, c) + coalesce(rc, c) as decimal(20,0))").alias("score"), "k", "lc", "rc").alias("way"), F.expr(f"({wide}) div cast(coalesce(lc, c) + c as decimal(20,0))").alias("bound"))
    worst = scored.groupBy("h").agg(F.min("way").alias("way"), F.min("bound").alias("bound"), F.min(F.col("lc").isNotNull() & F.col("rc").isNotNull()).alias("exact"))
    longer = known.filter(F.col("n") > 2).select("c", F.explode(F.array(*[F.when(F.col("n") == 3, F.col(f"{x}2")).otherwise(F.col(f"{x}3")) for x in "ps"])).alias("h")).groupBy("h").agg(F.max("c").alias("longer"))
    langs = single.select(F.col("h").alias("p1"), "lang")
    dropped = F.coalesce(F.expr(f"cast(longer as decimal(20,0)) * 100 >= cast(c as decimal(20,0)) * {covers}"), F.lit(False))
    judged = known.select("h", "n", "c", "p1").join(langs, "p1").join(worst, "h").join(longer, "h", "left").join(expanded.select("h", F.lit(True).alias("open_")).distinct(), "h", "left")
    judged = judged.withColumn("dropped", dropped).select("h", "n", "c", "lang", F.col("way.score").alias("score"), F.col("way.lc").alias("lc"), F.col("way.rc").alias("rc"), "bound", "exact", "dropped", (F.col("exact") & ~F.col("dropped") & ((F.col("n") == LONGEST) | F.coalesce("open_", F.lit(False)))).alias("survives"))
    return settle(judged, "phrases-judged"), cuts
