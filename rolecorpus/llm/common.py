"""Helpers that the operators share: scratch tables, size-checked broadcasts, word and byte hashing."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import broadcast_if_small, scratch_path, settle  # noqa: F401 - the operators take them from here

#: The white space that separates words, as a regular expression class and as bytes.
SPACE = r"[\x20\x09-\x0D]+"
SPACE_CHARS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def settle_bucketed(df: DataFrame, column: str, label: str, codec: str = "zstd") -> DataFrame:
    """As ``settle``, bucketed by ``column``, so that joins on it leave the table where it is. The catalog knows the
    table only while it is written: the entry goes at once, the files stay."""
    spark = df.sparkSession
    path = scratch_path(spark, label.replace("-", "_"))
    name = path.rpartition("/")[2]
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.bucketBy(n, column).option("compression", codec).option("path", path).saveAsTable(name)
    table = spark.table(name)
    spark.sql(f"DROP TABLE {name}")
    return table


def spare(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def spare_prefix(df: DataFrame, prefix: str) -> str:
    """``prefix``, lengthened until no column of ``df`` begins with it."""
    while any(c.lower().startswith(prefix.lower()) for c in df.columns):
        prefix += "_"
    return prefix


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, however often and in whatever lambda ``body`` uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def words(text: Column) -> Column:
    """The words of a text (null: none), lower-cased in A-Z only."""
    parts = F.split(F.trim(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(SPACE_CHARS)), SPACE)
    return F.filter(parts, lambda w: w != "")


def n_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def row_key(id_col: str, text_col: str) -> Column:
    """Identity of a row: repeated rows share it, rows that share only the id don't; null and empty differ."""
    own, text = F.col(id_col).cast("string"), F.col(text_col)
    return F.xxhash64(own, own.isNull(), text, text.isNull())


# ---- hashing of bytes and words in numpy -------------------------------------------------------------

_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
_powers: dict[str, np.ndarray] = {}


def _power(kind: str, n: int) -> np.ndarray:
    """Powers of the base, or of its inverse, modulo 2**64."""
    have = _powers.get(kind)
    if have is None or len(have) < n:
        base = _BASE if kind == "up" else pow(_BASE, -1, 1 << 64)
        size = 1 << 16 if n <= 1 << 16 else -(-n >> 20) << 20  # in steps, so that strings of about the same length compute them once
        out = np.full(size, base, np.uint64)
        out[0] = 1
        have = _powers[kind] = np.multiply.accumulate(out)
    return have[:n]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit over all others."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_byte_codes = mix64(np.arange(1, 257, dtype=np.uint64))


class PrefixHash:
    """Polynomial hashes of all prefixes of a byte string, so that any slice's hash is one subtraction
    and one multiplication. Arithmetic is modulo 2**64; equal hashes are evidence, not proof."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_byte_codes[data] * _power("up", n), out=self.sums[1:])
        self.inverse = _power("down", n + 1)

    def slices(self, start: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        """Hash of each data[start:start + length]; equal bytes give equal hashes wherever they stand."""
        return (self.sums[start + length] - self.sums[start]) * self.inverse[start]


is_space = np.zeros(256, bool)
is_space[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_lowered = np.arange(256, dtype=np.uint8)
_lowered[65:91] += 32


#: Bytes of text that are hashed at a time.
PIECE = 1 << 20


def hashed_words(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and place of each word of some bytes, lower-cased in A-Z; worked in pieces cut at white space."""
    gaps = np.flatnonzero(is_space[raw])
    hashes, places = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    at = 0
    while at < len(raw):
        k = np.searchsorted(gaps, at + PIECE)
        stop = int(gaps[k]) if k < len(gaps) else len(raw)
        space = is_space[raw[at:stop]]
        start = np.flatnonzero(~space & np.concatenate(([True], space[:-1])))
        size = np.flatnonzero(~space & np.concatenate((space[1:], [True]))) + 1 - start
        if len(start):
            hashes.append(mix64(PrefixHash(_lowered[raw[at:stop]]).slices(start, size) + size.astype(np.uint64)))
            places.append(start + at)
        at = stop
    return np.concatenate(hashes), np.concatenate(places)


def _fold(w: np.ndarray, first: np.ndarray | slice, width: int) -> np.ndarray:
    """Hash of the ``width`` words from each place on."""
    h = np.full(1, width, np.uint64)
    for k in range(width):
        h = mix64(h * np.uint64(_BASE & _MASK) + (w[k : len(w) - width + 1 + k] if isinstance(first, slice) else w[first + k]))
    return h


def shingle_sets(texts: list[str | None], width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Each text's sorted distinct 64-bit hashes of word shingles, one text after another, and how many each has.

    A text of fewer than ``width`` words has one shingle, its whole sequence; one without words has none.
    """
    raws = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    w, place = hashed_words(np.frombuffer(b"\n".join(raws), np.uint8))
    owner = np.searchsorted(np.cumsum([len(r) + 1 for r in raws]), place, side="right")
    n_words = np.bincount(owner, minlength=len(texts))
    first = np.cumsum(n_words) - n_words
    count = np.where(n_words >= width, n_words - width + 1, np.minimum(n_words, 1))
    begin = np.cumsum(count) - count
    flat = np.zeros(int(count.sum()), np.uint64)
    if len(w) >= width:
        inside = np.flatnonzero(owner[: len(w) - width + 1] == owner[width - 1 :])
        flat[begin[owner[inside]] + inside - first[owner[inside]]] = _fold(w, slice(None), width)[inside]
    for few in range(1, width):
        short = np.flatnonzero(n_words == few)
        if len(short):
            flat[begin[short]] = _fold(w, first[short], few)
    for a, n in zip(begin.tolist(), count.tolist(), strict=True):
        if n > 1:
            flat[a : a + n].sort()
    text = np.repeat(np.arange(len(texts)), count)
    fresh = np.ones(len(flat), bool)
    fresh[1:] = (flat[1:] != flat[:-1]) | (text[1:] != text[:-1])
    return flat[fresh], np.bincount(text[fresh], minlength=len(texts))
