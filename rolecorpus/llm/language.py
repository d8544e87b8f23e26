"""Language identification by rank-order profiles.

A profile is the list of a language's most frequent letter n-grams (one to three letters, words padded with
spaces). A document's own list is compared with each profile: every n-gram costs the difference of its two
ranks, or the full length of a profile that lacks it. The language with the least sum wins.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import broadcast_if_small, mix64, settle, spare

#: Length of the profiles and of a document's list.
PROFILE = 300
#: Characters that are counted together; longer texts are counted in pieces of about it, cut between words.
PIECE = 1_000_000
#: Characters of texts whose n-grams are held together.
HELD = 4_000_000
_GRAM_BITS = 44
_GRAM_MASK = np.uint64((1 << _GRAM_BITS) - 1)
_letters: np.ndarray | None = None


def _letter_table() -> np.ndarray:
    """Lower-cased letter of each code point; a space for what is no letter."""
    global _letters
    if _letters is None:
        _letters = np.fromiter((ord(c.lower()[0]) if (c := chr(i)).isalpha() else 32 for i in range(0x110000)), np.uint32, 0x110000)
    return _letters


def _piece_counts(text: str, lengths: list[int], first: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys (document << 44 | n-gram) and counts of texts joined by single spaces."""
    a = _letter_table()[np.frombuffer((" " + text + " ").encode("utf-32-le", "surrogatepass"), np.uint32)].astype(np.uint64)
    doc = np.repeat(np.arange(first, first + len(lengths), dtype=np.uint64), [n + 1 for n in lengths])
    doc = np.concatenate((doc[:1], doc))[: len(a)]
    keep = (a != 32) | (np.concatenate(([0], a[:-1])) != 32)
    a, doc = a[keep], doc[keep]
    s = np.uint64(21)
    word = a != 32
    mid = word[1:-1]
    keys = (
        (doc[word], a[word]),
        (np.where(word[1:], doc[1:], doc[:-1]), a[:-1] << s | a[1:]),
        (doc[1:-1][mid], (a[:-2] << (s + s) | a[1:-1] << s | a[2:])[mid]),
    )
    return np.unique(np.concatenate([d << np.uint64(_GRAM_BITS) | mix64(g) >> np.uint64(64 - _GRAM_BITS) for d, g in keys]), return_counts=True)


def _cuts(text: str) -> list[int]:
    """Where a long text is cut: never inside a word, so the pieces have the n-grams of the whole."""
    cuts = [0]
    while cuts[-1] + PIECE < len(text):
        k = cuts[-1] + PIECE
        while k < len(text) and text[k].isalpha():
            k += 1
        cuts.append(k)
    return cuts if cuts[-1] == len(text) else [*cuts, len(text)]


def gram_counts(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, n-gram, count) of all n-grams of each text, by document and n-gram."""
    parts: list[tuple[np.ndarray, np.ndarray]] = []
    i = 0
    while i < len(texts):
        if len(texts[i]) > PIECE:
            cuts = _cuts(texts[i])
            own = [_piece_counts(texts[i][a:b], [b - a], i) for a, b in zip(cuts, cuts[1:], strict=False)]
            keys, where = np.unique(np.concatenate([k for k, _ in own]), return_inverse=True)
            parts.append((keys, np.bincount(where, np.concatenate([c for _, c in own])).astype(np.int64)))
            i += 1
            continue
        j, size = i, 0
        while j < len(texts) and len(texts[j]) <= PIECE and size + len(texts[j]) <= PIECE:
            size += len(texts[j])
            j += 1
        parts.append(_piece_counts(" ".join(texts[i:j]), [len(t) for t in texts[i:j]], i))
        i = j
    keys = np.concatenate([k for k, _ in parts]) if parts else np.zeros(0, np.uint64)
    counts = np.concatenate([c for _, c in parts]) if parts else np.zeros(0, np.int64)
    return (keys >> np.uint64(_GRAM_BITS)).astype(np.int64), (keys & _GRAM_MASK).astype(np.int64), counts


def _ranked(doc: np.ndarray, gram: np.ndarray, count: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The PROFILE most frequent n-grams of each document with their ranks from 0; ties by n-gram."""
    order = np.argsort(doc * (1 << 40) + ((1 << 40) - 1 - np.minimum(count, (1 << 40) - 1)), kind="stable")
    doc, gram = doc[order], gram[order]
    starts = np.searchsorted(doc, np.arange(n_docs))
    rank = np.arange(len(doc)) - starts[doc]
    top = rank < PROFILE
    return doc[top], gram[top], rank[top]


def learn_profiles(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", sample_per_language: int = 5000) -> DataFrame:
    """(lang, gram, rank): the profile of each non-null language, from at most about ``sample_per_language``
    of its documents, chosen by the hash of their text; whole texts are counted."""
    known = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    share = broadcast_if_small(known.groupBy("lang").agg((F.lit(float(sample_per_language)) / F.count("*")).alias("share")))
    chosen = known.join(share, "lang").filter(F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < F.col("share") * (1 << 20)).select("lang", "text")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for lang, texts in b.groupby("lang")["text"]:
                _, gram, n = gram_counts(list(texts))
                grams, where = np.unique(gram, return_inverse=True)
                yield pd.DataFrame({"lang": lang, "gram": grams, "n": np.bincount(where, n, len(grams)).astype(np.int64)})

    counts = chosen.mapInPandas(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram")) - 1
    return settle(counts.withColumn("rank", rank).filter(F.col("rank") < PROFILE).select("lang", "gram", "rank"), "lang-profiles")


def identify_languages(docs: DataFrame, profiles: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``lang_score``, from the text alone.

    The score is 1 less the winner's distance as a share of the greatest possible one. Ties go to the first
    language by code point. ``und`` with score 0: null and empty texts, texts without a letter, and any text
    if there is no profile. One row per input row, repeated or not, texts of any length whole; other columns pass through, columns of
    the two names are replaced.

    The profiles go to the tasks whole: 300 numbers a language, so their size is that of the language list.
    """
    rows = profiles.orderBy("lang", "rank").toPandas()
    langs = sorted(rows["lang"].unique())
    vocabulary = np.unique(rows["gram"].to_numpy(np.int64))
    ranks = np.full((len(vocabulary) + 1, max(1, len(langs))), 1 << 20, np.int32)  # last row: no profile has the n-gram
    for k, lang in enumerate(langs):
        own = rows[rows["lang"] == lang]
        ranks[np.searchsorted(vocabulary, own["gram"].to_numpy(np.int64)), k] = own["rank"].to_numpy()

    @F.pandas_udf("struct<lang_pred: string, lang_score: double>")
    def predict(texts: pd.Series) -> pd.DataFrame:
        texts = ["" if t is None or t is pd.NA else t for t in texts]
        pred, score = np.full(len(texts), "und", object), np.zeros(len(texts))
        size = np.cumsum([len(t) for t in texts]) // HELD if texts else np.zeros(0, int)
        edges = [0, *(np.flatnonzero(np.diff(size)) + 1).tolist(), len(texts)]
        for lo, hi in zip(edges[:-1], edges[1:], strict=True) if langs else ():  # the n-grams of so many characters at once
            doc, gram, rank = _ranked(*gram_counts(texts[lo:hi]), hi - lo)
            if len(doc):
                at = np.searchsorted(vocabulary, gram)
                at = np.where((at < len(vocabulary)) & (vocabulary[np.minimum(at, len(vocabulary) - 1)] == gram), at, len(vocabulary))
                cost = np.minimum(np.abs(ranks[at] - rank[:, None]), PROFILE)
                first = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1])))
                total = np.add.reduceat(cost, first, axis=0)
                n = np.diff(np.concatenate((first, [len(doc)])))
                best = total.argmin(axis=1)
                pred[lo + doc[first]] = np.array(langs, object)[best]
                score[lo + doc[first]] = 1 - total[np.arange(len(first)), best] / (n * PROFILE)
        return pd.DataFrame({"lang_pred": pred, "lang_score": score})

    name = spare(docs, "lang_found")
    found = docs.withColumn(name, predict(F.col(text_col).cast("string")))
    return found.select(*[F.col(f"`{c}`") for c in docs.columns if c not in ("lang_pred", "lang_score")], F.col(name)["lang_pred"].alias("lang_pred"), F.col(name)["lang_score"].alias("lang_score"))
