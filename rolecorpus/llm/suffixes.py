"""Repeated substrings: a suffix sort that compares by hashes, and the de-duplication built on it.

Which bytes of which documents stand in a substring of ``LENGTH`` bytes that an earlier document has is found in
four steps over blocks of documents.

1. Documents are packed into blocks of some megabytes, written once and bucketed by block, so that no later step
   shuffles a text again.
2. Every window of LENGTH bytes names one of its 16-byte substrings, the one of least hash, its anchor. Equal windows
   have equal anchors at equal places. Blocks send 32-bit fingerprints of their anchors to buckets, which answer
   with a bitmap of those that another document has too, and of those that occur more than HOT times.
3. For shared anchors the blocks send the bytes of the windows around them, once per block and content; a task sends those of
   several blocks together. An anchor's windows meet in one bucket; those of a hot anchor are dealt out in parts of PART places,
   by the bytes that every window of the part holds, so that windows meet only where nearly all their bytes are the same. A bucket
   sorts the suffixes that begin there by their first LENGTH bytes: the common extension of two suffixes is found by
   binary search over prefix hashes, so a comparison in the merge sort takes log(LENGTH) steps; neighbours that the
   hashes call equal are verified byte by byte. Suffixes whose hash of LENGTH bytes stands alone are left out of the sort. In each run of equal windows the smallest document keeps its own.
4. The blocks take back which windows go, and cut the bytes they cover.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from .common import PrefixHash, mix64, settle, settle_bucketed

LENGTH, GRAM = 50, 16
#: Bytes of text in a block; a longer document is a block of its own.
BLOCK_BYTES = 4 << 20
#: Bytes of text whose anchors share a bucket.
BUCKET_BYTES = 24 << 20
#: Occurrences beyond which an anchor is hot, and the places before it that a part of its windows begins at.
HOT, PART = 4096, 5
#: Bytes of contexts that a task gathers from its blocks before it sends them.
SEND_BYTES = 32 << 20
#: Bytes that anchors are computed for at a time.
PIECE = 1 << 15
_NO_ID = np.iinfo(np.int64).min


# ---- the sort ---------------------------------------------------------------------------------------


def common_extension(h: PrefixHash, a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """Length of the common prefix, up to ``most``, of the suffixes at a and at b: binary search over hashes, whose first probe is
    the whole length."""
    whole = h.slices(a, most) == h.slices(b, most)
    low, high = np.where(whole, most, 0), np.where(whole, most, most - 1)
    open_ = np.flatnonzero(low < high)
    while len(open_):
        mid = (low[open_] + high[open_] + 1) >> 1
        same = h.slices(a[open_], mid) == h.slices(b[open_], mid)
        low[open_], high[open_] = np.where(same, mid, low[open_]), np.where(same, high[open_], mid - 1)
        open_ = open_[low[open_] < high[open_]]
    return low


def suffix_less(h: PrefixHash, data: np.ndarray, a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """Whether the first ``most`` bytes at a sort before those at b."""
    k = common_extension(h, a, b, most)
    differ = k < most
    end = len(data) - 1
    return differ & (data[np.minimum(a + k, end)] < data[np.minimum(b + k, end)])


def sort_suffixes(data: np.ndarray, h: PrefixHash, starts: np.ndarray, segment: np.ndarray, most: int = LENGTH) -> np.ndarray:
    """Order that sorts suffixes by segment, then by their first ``most`` bytes, stably.

    A bottom-up merge sort over all segments at once: in each round an element finds its place in the sibling run
    by binary search, every probe being one hash comparison of suffixes.
    """
    order = np.argsort(segment, kind="stable")
    if not len(order):
        return order
    seg = segment[order]
    first = np.flatnonzero(np.concatenate(([True], seg[1:] != seg[:-1])))
    size = np.diff(np.concatenate((first, [len(seg)])))
    base, count = np.repeat(first, size), np.repeat(size, size)
    within = np.arange(len(seg)) - base
    run = 1
    while run < size.max():
        live = np.flatnonzero(count > run)
        w, c = within[live], count[live]
        mine = w // run
        right = mine % 2 == 1
        lo = np.where(right, mine - 1, mine + 1) * run
        hi = np.minimum(lo + run, c)
        ok = lo < c  # a run without a sibling stays
        live, w, right, lo, hi = live[ok], w[ok], right[ok], lo[ok], hi[ok]
        low, high = lo.copy(), hi.copy()
        b = base[live]
        own = starts[order[live]]
        while True:
            open_ = np.flatnonzero(low < high)
            if not len(open_):
                break
            mid = (low[open_] + high[open_]) >> 1
            other = starts[order[b[open_] + mid]]
            mine_at = own[open_]
            # elements of the left run stay before equal ones of the right run
            r = right[open_]
            less = np.where(r, ~suffix_less(h, data, mine_at, other, most), suffix_less(h, data, other, mine_at, most))
            low[open_] = np.where(less, mid + 1, low[open_])
            high[open_] = np.where(less, high[open_], mid)
        start_of_pair = np.where(right, lo, w - w % run)
        place = start_of_pair + w % run + (low - lo)
        merged = order.copy()
        merged[b + place] = order[live]
        order = merged
        run *= 2
    return order


def equal_runs(data: np.ndarray, h: PrefixHash, starts: np.ndarray, segment: np.ndarray, order: np.ndarray, most: int = LENGTH) -> np.ndarray:
    """Class number of each sorted suffix: neighbours of one segment whose first ``most`` bytes are the same,
    by hash and then by bytes."""
    a, b = starts[order[:-1]], starts[order[1:]]
    same = np.zeros(len(order), bool)
    like = np.flatnonzero((segment[order[:-1]] == segment[order[1:]]) & (h.slices(a, most) == h.slices(b, most)))
    for k in range(0, len(like), 200_000):
        part = like[k : k + 200_000]
        same[part + 1] = (data[a[part, None] + np.arange(most)] == data[b[part, None] + np.arange(most)]).all(axis=1)
    return np.cumsum(~same) - 1


def same_bytes(data: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether data[a:a + size] and data[b:b + size] are the same, for each element; eight bytes at a time, the last eight ending
    with the slice."""
    same = np.ones(len(a), bool)
    wide = 8 if size.min(initial=8) >= 8 else 1
    units = np.ndarray(max(0, len(data) - wide + 1), np.uint64 if wide == 8 else np.uint8, np.ascontiguousarray(data), strides=(1,))
    for k in range(0, int(size.max(initial=0)), wide):
        live = np.flatnonzero(same & (size > k))
        if not len(live):
            break
        at = np.minimum(k, size[live] - wide)
        same[live] = units[a[live] + at] == units[b[live] + at]
    return same


# ---- anchors -----------------------------------------------------------------------------------------


def anchors(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, place, first window, number of windows) of each anchor of documents that end at ``ends``.

    Worked in pieces that fit the processor's cache; pieces overlap by a window, so they change nothing.
    """
    n, width = len(data) - LENGTH + 1, LENGTH - GRAM + 1
    none = np.zeros(0, np.int64)
    if n <= 0:
        return none.view(np.uint64), none, none, none
    valid = np.ones(n, bool)
    for end in ends[:-1].tolist():  # windows that begin in one document and end in another
        valid[max(0, end - LENGTH + 1) : end] = False
    low_bits = np.uint64((1 << 24) - 1)
    index = np.arange(PIECE + LENGTH, dtype=np.uint64)
    hashes, places, firsts, ranks = [], [], [], []
    seen, last_place = 0, -1
    for at in range(0, n, PIECE):
        here = min(PIECE, n - at)
        piece = data[at : at + here + LENGTH - 1]
        own = PrefixHash(piece)
        grams = mix64((own.sums[GRAM:] - own.sums[:-GRAM]) * own.inverse[: len(piece) - GRAM + 1])
        # the hash's upper 40 bits, then the place: the first of equal hashes wins
        m = (grams & ~low_bits) | index[: len(grams)]
        span = 1
        while span * 2 <= width:
            m = np.minimum(m[:-span], m[span:])
            span *= 2
        if width > span:
            m = np.minimum(m[: len(m) - (width - span)], m[width - span :])
        windows = np.flatnonzero(valid[at : at + here])
        if not len(windows):
            last_place = -1
            continue
        local = (m[windows] & low_bits).astype(np.int64)
        place = local + at
        new = np.empty(len(windows), bool)
        new[0] = windows[0] > 0 or place[0] != last_place
        new[1:] = (place[1:] != place[:-1]) | (windows[1:] != windows[:-1] + 1)
        begin = np.flatnonzero(new)
        hashes.append(grams[local[begin]])
        places.append(place[begin])
        firsts.append(windows[begin] + at)
        ranks.append(begin + seen)
        seen += len(windows)
        last_place = int(place[-1]) if windows[-1] == here - 1 else -1
    if not seen:
        return none.view(np.uint64), none, none, none
    ranks = np.concatenate(ranks)
    return np.concatenate(hashes), np.concatenate(places), np.concatenate(firsts), np.diff(np.concatenate((ranks, [seen])))


def _unpack(row) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, ids, ends) of a block."""
    data = np.frombuffer(zstandard.decompress(row["data"]), np.uint8)
    return data, np.frombuffer(row["ids"], np.int64), np.cumsum(np.frombuffer(row["lengths"], np.int64))


def _buckets(hashes: np.ndarray, n: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) % np.uint64(n)).astype(np.int64)


def _cuts(bucket: np.ndarray) -> Iterator[tuple[int, slice]]:
    """Slices of equal values of a sorted array."""
    edges = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1]))) if len(bucket) else np.zeros(0, np.int64)
    for a, b in zip(edges, np.concatenate((edges[1:], [len(bucket)])), strict=True):
        yield int(bucket[a]), slice(int(a), int(b))


def _fingerprints(data: np.ndarray, ids: np.ndarray, ends: np.ndarray, n: int):
    """Anchors with their document's id; and the distinct (bucket, fingerprint) of the block, in order."""
    h, place, first, count = anchors(data, ends)
    owner = ids[np.searchsorted(ends, place, side="right")]
    code = _buckets(h, n).astype(np.uint64) << np.uint64(32) | (h & np.uint64(0xFFFFFFFF))
    distinct, where = np.unique(code, return_inverse=True)
    return h, place, first, count, owner, distinct, where


# ---- the steps ---------------------------------------------------------------------------------------


def _pack(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(block, size, ids, lengths, data): documents packed into blocks, as a table bucketed by block."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task, n, ids, parts, size = TaskContext.get().partitionId(), 0, [], [], 0

        def row() -> pd.DataFrame:
            lengths = np.array([len(p) for p in parts], np.int64)
            return pd.DataFrame({
                "block": [(task << 32) + n], "size": [int(lengths.sum())], "ids": [np.array(ids, np.int64).tobytes()],
                "lengths": [lengths.tobytes()], "data": [zstandard.compress(b"".join(parts), 3)],
            })

        for b in batches:
            for i, t in zip(b["id"], b["text"], strict=True):
                raw = (t or "").encode("utf-8", "surrogatepass")
                if parts and size + len(raw) > BLOCK_BYTES:
                    yield row()
                    n, ids, parts, size = n + 1, [], [], 0
                ids.append(i)
                parts.append(raw)
                size += len(raw)
        if parts:
            yield row()

    if not isinstance(docs.schema[id_col].dataType, IntegralType):
        raise TypeError(f"{id_col} must be an integer, as documents are told apart and ordered by it")
    own = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_ID)).alias("id"), F.col(text_col).cast("string").alias("text"))
    packed = own.mapInPandas(run, "block long, size long, ids binary, lengths binary, data binary")
    return settle_bucketed(packed, "block", "suffix-blocks", "none")


def _shared_bits(blocks: DataFrame, n: int) -> DataFrame:
    """(block, parts): for each block, which of its distinct fingerprints another document has too, and which are hot, by bucket."""

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for row in b.to_dict("records"):
                *_, owner, distinct, where = _fingerprints(*_unpack(row), n)
                low, high = np.full(len(distinct), np.iinfo(np.int64).max), np.full(len(distinct), _NO_ID)
                np.minimum.at(low, where, owner)
                np.maximum.at(high, where, owner)
                times = np.minimum(np.bincount(where, minlength=len(distinct)), 65535).astype(np.uint16)
                rows = [
                    (bucket, row["block"], distinct[at].astype(np.uint32).tobytes(), np.packbits(low[at] < high[at]).tobytes(), times[at].tobytes())
                    for bucket, at in _cuts((distinct >> np.uint64(32)).astype(np.int64))
                ]
                yield pd.DataFrame(rows, columns=["bucket", "block", "prints", "several", "times"])

    def answer(pdf: pd.DataFrame) -> pd.DataFrame:
        prints = [np.frombuffer(p, np.uint32) for p in pdf["prints"]]
        several = [np.unpackbits(np.frombuffer(s, np.uint8), count=len(p)).astype(bool) for s, p in zip(pdf["several"], prints, strict=True)]
        every, times = np.concatenate(prints), np.concatenate([np.frombuffer(t, np.uint16) for t in pdf["times"]])
        order = np.argsort(every, kind="stable")
        every = every[order]
        first = np.flatnonzero(np.concatenate(([True], every[1:] != every[:-1])))
        again = (np.diff(np.concatenate((first, [len(every)]))) > 1) | np.logical_or.reduceat(np.concatenate(several)[order], first)
        hot = np.add.reduceat(times[order].astype(np.int64), first)[again] > HOT
        shared = every[first[again]]
        bits, much = [], []
        for p in prints:
            at = np.minimum(np.searchsorted(shared, p), max(0, len(shared) - 1))
            hit = shared[at] == p if len(shared) else np.zeros(len(p), bool)
            bits.append(np.packbits(hit).tobytes())
            much.append(np.packbits(hit & hot[at] if len(shared) else hit).tobytes())
        return pd.DataFrame({"block": pdf["block"], "bucket": pdf["bucket"], "bits": bits, "hot": much})

    sent = blocks.mapInPandas(send, "bucket long, block long, prints binary, several binary, times binary")
    answered = sent.groupBy("bucket").applyInPandas(answer, "block long, bucket long, bits binary, hot binary")
    return settle(answered.groupBy("block").agg(F.collect_list(F.struct("bucket", "bits", "hot")).alias("parts")), "suffix-bits")


def _in_parts(whole: PrefixHash, h: np.ndarray, place: np.ndarray, first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, ...]:
    """(whose, first, count, key) of the parts of the contexts of hot anchors. Windows that begin PART * k to PART * k + PART - 1 bytes
    before their anchor are part k; LENGTH - PART + 1 bytes are in all of them, and equal windows have them alike: the key says which."""
    most, least = (place - first) // PART, (place - first - count + 1) // PART
    n = most - least + 1
    whose = np.repeat(np.arange(len(h)), n)
    part = most[whose] - (np.arange(len(whose)) - np.repeat(np.cumsum(n) - n, n))
    last = place[whose] - PART * part
    begin = np.maximum(first[whose], last - PART + 1)
    end = np.minimum(first[whose] + count[whose], last + 1)
    return whose, begin, end - begin, mix64(mix64(h[whose]) ^ mix64(whole.slices(last, LENGTH - PART + 1) + part.astype(np.uint64)))


def _messages(held: list[tuple[np.ndarray, ...]], spread: int) -> Iterator[pd.DataFrame]:
    """The held contexts, one message for each bucket."""
    shift = np.cumsum([0, *(len(x[0]) for x in held)])
    data = np.concatenate([x[0] for x in held])
    at = np.concatenate([x[1] + s for x, s in zip(held, shift[:-1], strict=True)])
    block, owner, first, count, before, key = (np.concatenate([x[k] for x in held]) for k in range(2, 8))
    bucket = _buckets(key, spread)
    by = np.argsort(bucket, kind="stable")
    compress, rows, size = zstandard.ZstdCompressor(level=1).compress, [], 0
    for k, cut in _cuts(bucket[by]):
        x = by[cut]
        heads = b"".join((block[x].tobytes(), owner[x].tobytes(), first[x].astype(np.int32).tobytes(), count[x].astype(np.uint8).tobytes(), before[x].astype(np.uint8).tobytes()))
        long = count[x] + LENGTH - 1
        to = np.cumsum(long)
        text = compress(data[np.repeat(at[x] - to + long, long) + np.arange(to[-1])].tobytes())
        rows.append((k, -1, heads, text, None))
        size += len(heads) + len(text)
        if size > SEND_BYTES:
            yield pd.DataFrame(rows, columns=["bucket", "block", "heads", "text", "done"])
            rows, size = [], 0
    if rows:
        yield pd.DataFrame(rows, columns=["bucket", "block", "heads", "text", "done"])


def _contexts(blocks: DataFrame, bits: DataFrame, n: int, spread: int) -> DataFrame:
    """(bucket, block, heads, text, done) around shared anchors, each content once per block; and rows without heads whose
    ``done`` are windows that the block itself settles: their content stands in an earlier document of the block."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size_held = [], 0
        for b in batches:
            for row in b.to_dict("records"):
                data, ids, ends = _unpack(row)
                h, place, first, count, owner, distinct, where = _fingerprints(data, ids, ends, n)
                shared, hot = np.zeros(len(distinct), bool), np.zeros(len(distinct), bool)
                parts = {p["bucket"]: p for p in row["parts"]}
                for bucket, at in _cuts((distinct >> np.uint64(32)).astype(np.int64)):
                    for flags, name in ((shared, "bits"), (hot, "hot")):
                        flags[at] = np.unpackbits(np.frombuffer(parts[bucket][name], np.uint8), count=at.stop - at.start).astype(bool)
                keep = np.flatnonzero(shared[where])
                if not len(keep):
                    continue
                h, place, first, count, owner, hot = h[keep], place[keep], first[keep], count[keep], owner[keep], hot[where[keep]]
                whole = PrefixHash(data)
                key = mix64(h)
                if hot.any():
                    cold, much = np.flatnonzero(~hot), np.flatnonzero(hot)
                    whose, *dealt = _in_parts(whole, h[much], place[much], first[much], count[much])
                    first, count, key = (np.concatenate((x[cold], y)) for x, y in zip((first, count, key), dealt, strict=True))
                    place, owner = (np.concatenate((x[cold], x[much[whose]])) for x in (place, owner))
                size = count + LENGTH - 1
                content = mix64(whole.slices(first, size) + (size * 64 + place - first).astype(np.uint64))
                order = np.lexsort((first, owner, content))
                lead = np.concatenate(([True], content[order][1:] != content[order][:-1]))
                leader = order[np.flatnonzero(lead)[np.cumsum(lead) - 1]]  # of each in order: the first of its content
                twin = np.flatnonzero(~lead & (size[order] == size[leader]) & (owner[order] > owner[leader]))
                settled = np.zeros(len(order), bool)
                settled[twin] = same_bytes(data, first[order[twin]], first[leader[twin]], size[order[twin]])
                done = order[settled]
                if len(done):
                    yield pd.DataFrame({"bucket": [row["block"] % spread], "block": [row["block"]], "heads": [None], "text": [None], "done": [np.stack((first[done], count[done])).astype(np.int64).tobytes()]})
                go = order[~settled]
                held.append((data, first[go], np.full(len(go), row["block"]), owner[go], first[go], count[go], (place - first)[go], key[go]))
                size_held += len(data) + int(size[go].sum())
                if size_held > SEND_BYTES:
                    yield from _messages(held, spread)
                    held, size_held = [], 0
        if held:
            yield from _messages(held, spread)

    return blocks.join(bits, "block").select("block", "ids", "lengths", "data", "parts").mapInPandas(run, "bucket long, block long, heads binary, text binary, done binary")


def _settle_windows(pdf: pd.DataFrame) -> pd.DataFrame:
    """Which windows of a bucket's contexts go: (block, runs), runs being starts and counts of windows."""
    settled = pdf[pdf["done"].notna()]
    out = settled[["block"]].assign(runs=settled["done"])
    pdf = pdf[pdf["heads"].notna()]
    if not len(pdf):
        return out
    block, owner, first, count, before, texts = [], [], [], [], [], []
    decompress = zstandard.ZstdDecompressor().decompress
    for heads, text in zip(pdf["heads"], pdf["text"], strict=True):
        n = len(heads) // 22
        block.append(np.frombuffer(heads, np.int64, n))
        owner.append(np.frombuffer(heads, np.int64, n, 8 * n))
        first.append(np.frombuffer(heads, np.int32, n, 16 * n).astype(np.int64))
        count.append(np.frombuffer(heads, np.uint8, n, 20 * n).astype(np.int64))
        before.append(np.frombuffer(heads, np.uint8, n, 21 * n).astype(np.int64))
        texts.append(np.frombuffer(decompress(text), np.uint8))
    block, owner, first, count, before, data = (np.concatenate(v) for v in (block, owner, first, count, before, texts))
    size = count + LENGTH - 1
    start = np.cumsum(size) - size
    h = PrefixHash(data)
    # contexts of the same bytes and anchor place are one; the smallest document stands for it
    content = mix64(h.slices(start, size) + (size * 64 + before).astype(np.uint64))
    order = np.lexsort((owner, content))
    lead = np.concatenate(([True], content[order][1:] != content[order][:-1]))
    leader = order[np.flatnonzero(lead)[np.cumsum(lead) - 1]]
    equal = size[order] == size[leader]
    twin = np.flatnonzero(equal & ~lead)
    equal[twin] = same_bytes(data, start[order[twin]], start[leader[twin]], size[order[twin]])
    head = np.arange(len(owner))
    head[order[equal]] = leader[equal]
    unique = np.flatnonzero(head == np.arange(len(owner)))
    # the windows of the distinct contexts; equal ones have one anchor hash and one place relative to it, so those of an anchor with
    # one context are like no others
    n_windows = count[unique]
    least = np.repeat(owner[unique], n_windows)
    grams = h.slices(start[unique] + before[unique], GRAM)
    _, where, many = np.unique(grams, return_inverse=True, return_counts=True)
    context = np.repeat(np.arange(len(unique)), n_windows)
    live = np.flatnonzero((many[where] > 1)[context])
    context = context[live]
    offset = live - (np.cumsum(n_windows) - n_windows)[context]
    suffix = start[unique][context] + offset
    group = mix64(grams[context] + (before[unique][context] - offset).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    # a window whose hash no other of its anchor and place has is like none: only the others are sorted
    same = mix64(group ^ mix64(h.slices(suffix, LENGTH)))
    _, where, many = np.unique(same, return_inverse=True, return_counts=True)
    several = np.flatnonzero(many[where] > 1)
    if len(several):
        starts, segment, ids = suffix[several], np.unique(group[several], return_inverse=True)[1], owner[unique][context[several]]
        by = sort_suffixes(data, h, starts, segment)
        classes = equal_runs(data, h, starts, segment, by)
        smallest = np.full(classes[-1] + 1, np.iinfo(np.int64).max)
        np.minimum.at(smallest, classes, ids[by])
        least[live[several[by]]] = smallest[classes]
    at = np.cumsum(n_windows) - n_windows
    slot = np.zeros(len(owner), np.int64)
    slot[unique] = np.arange(len(unique))
    mine = slot[head]
    # each context's windows that an earlier document has, as runs
    reps = np.repeat(np.arange(len(owner)), count)
    inner = np.arange(len(reps)) - np.repeat(np.cumsum(count) - count, count)
    gone = least[at[mine][reps] + inner] < owner[reps]
    where_gone = np.flatnonzero(gone)
    if not len(where_gone):
        return out
    fresh = np.concatenate(([True], (np.diff(where_gone) != 1) | (reps[where_gone][1:] != reps[where_gone][:-1])))
    run_at = where_gone[fresh]
    run_length = np.diff(np.concatenate((np.flatnonzero(fresh), [len(where_gone)])))
    owner_of_run = reps[run_at]
    starts, blocks_of_run = first[owner_of_run] + inner[run_at], block[owner_of_run]
    rows = []
    by = np.argsort(blocks_of_run, kind="stable")
    for k, cut in _cuts(blocks_of_run[by]):
        rows.append((k, np.stack((starts[by][cut], run_length[by][cut])).astype(np.int64).tobytes()))
    return pd.concat((out, pd.DataFrame(rows, columns=["block", "runs"])))


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, spans, kept) of each row: the maximal removed spans (start, length) of its UTF-8 bytes, and
    the bytes that remain.

    A byte goes if a substring of LENGTH bytes covers it that also starts in a document of smaller id; substrings
    are judged on the input and never cross documents. Ids are integers. Null texts are empty; texts shorter than LENGTH, empty tables
    and columns other than the two, of whatever name, are no special case; a text longer than a block is worked whole, as a block of its own. Rows that share an id are no earlier than each other, so
    repeated rows of one id keep their text; a null id comes before all others.
    """
    blocks = _pack(docs, id_col, text_col)
    total = blocks.agg(F.sum("size")).first()[0] or 0
    n = max(8, -(-total // BUCKET_BYTES))
    bits = _shared_bits(blocks, n)
    # the sort holds some hundred bytes for each window, so its buckets are smaller
    judged = _contexts(blocks, bits, n, 6 * n).groupBy("bucket").applyInPandas(_settle_windows, "block long, runs binary")
    gone = settle(judged.groupBy("block").agg(F.collect_list("runs").alias("runs")), "suffix-gone")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for row in b.to_dict("records"):
                data, ids, ends = _unpack(row)
                cover = np.zeros(len(data) + 1, np.int64)
                for r in row["runs"] if row["runs"] is not None else ():
                    starts, counts = np.frombuffer(r, np.int64).reshape(2, -1)
                    np.add.at(cover, starts, 1)
                    np.add.at(cover, starts + counts + LENGTH - 1, -1)
                mask = np.cumsum(cover)[:-1] > 0
                rows, at = [], 0
                for i, end in zip(ids, ends, strict=True):
                    m = mask[at:end]
                    edge = np.diff(np.concatenate(([0], m.view(np.int8), [0])))
                    a, z = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
                    rows.append((None if i == _NO_ID else i, end - at, [{"start": int(x), "length": int(y - x)} for x, y in zip(a, z, strict=True)], data[at:end][~m].tobytes()))
                    at = end
                ids, *rest = zip(*rows, strict=True)
                yield pd.DataFrame({"doc_id": pd.array(ids, "Int64")} | dict(zip(("n_bytes", "spans", "kept"), rest, strict=True)))

    return blocks.join(gone, "block", "left").select("ids", "lengths", "data", "runs").mapInPandas(cut, "doc_id long, n_bytes long, spans array<struct<start: long, length: long>>, kept binary")
