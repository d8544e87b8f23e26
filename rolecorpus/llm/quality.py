"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics of whole texts are computed in numpy inside the tasks. The trees are fitted on the driver from the
statistics of a bounded sample of labelled rows, and flattened into arrays (a complete binary tree each), so that
a batch of documents walks all trees level by level with array indexing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import PrefixHash, hashed_words, mix64

#: Score from which a text is accepted.
THRESHOLD = 0.3
#: Characters whose statistics are taken together.
PIECE = 1 << 18
FEATURES = (
    "log_bytes", "log_words", "log_lines", "word_length", "words_per_line", "longest_line", "upper", "digit", "space", "other_ascii", "beyond_ascii",
    "bang", "bar", "symbol", "sentence_end", "comma", "quote", "bracket", "distinct_words", "top_word", "repeated_pairs", "repeated_fives", "repeated_lines", "bytes_entropy",
)
_groups = {
    "upper": range(65, 91), "digit": range(48, 58), "space": (9, 10, 11, 12, 13, 32), "bang": b"!", "bar": b"|", "symbol": b"#$%&*@^~_=+<>\\/",
    "sentence_end": b".?", "comma": b",;:", "quote": b"\"'`", "bracket": b"()[]{}",
}


def _distinct(owner: np.ndarray, values: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each of ``n`` owners the number of distinct values, and how often the most frequent one occurs."""
    _, first, count = np.unique(mix64(values ^ mix64(owner.astype(np.uint64) + np.uint64(1))), return_index=True, return_counts=True)
    most = np.zeros(n, np.int64)
    np.maximum.at(most, owner[first], count)
    return np.bincount(owner[first], minlength=n), most


def _piece_statistics(texts: list[str | None]) -> np.ndarray:
    """The statistics of some texts, worked on their bytes in one string, a line break behind each but the last."""
    raws = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    m = len(raws)
    raw, size = np.frombuffer(b"\n".join(raws), np.uint8), np.array([len(r) for r in raws], np.int64)
    n = np.maximum(1, size)
    text_of = np.repeat(np.arange(m), size + 1)[: len(raw)]
    hist = np.bincount(text_of * 256 + raw, minlength=256 * m).reshape(m, 256)
    hist[:-1, 10] -= 1
    share = {k: hist[:, list(v)].sum(axis=1) / n for k, v in _groups.items()}
    ends = np.cumsum(size + 1)

    w, place = hashed_words(raw)
    word_of = np.searchsorted(ends, place, side="right")
    n_words = np.bincount(word_of, minlength=m)
    starts = np.concatenate(([0], np.flatnonzero(raw == 10) + 1))
    lengths = np.diff(np.concatenate((starts, [len(raw) + 1]))) - 1
    line_of = np.minimum(np.searchsorted(ends, starts, side="right"), m - 1)
    longest = np.maximum.reduceat(lengths, np.searchsorted(line_of, np.arange(m)))
    full = np.flatnonzero(lengths)
    lines = PrefixHash(raw).slices(starts[full], lengths[full]) + lengths[full].astype(np.uint64)
    n_lines = np.bincount(line_of[full], minlength=m)

    def repeated(width: int) -> np.ndarray:
        k = np.maximum(0, n_words - width + 1)
        if len(w) < width:
            return np.zeros(m)
        h = np.zeros(len(w) - width + 1, np.uint64)
        for i in range(width):
            h = h * np.uint64(0x9E3779B97F4A7C15) + w[i : len(w) - width + 1 + i]
        inside = word_of[: len(h)] == word_of[width - 1 :]
        return np.where(k < 2, 0.0, 1 - _distinct(word_of[: len(h)][inside], h[inside], m)[0] / np.maximum(1, k))

    distinct, top = _distinct(word_of, w, m)
    p = hist / n[:, None]
    entropy = -np.where(hist > 0, p * np.log2(np.where(hist > 0, p, 1)), 0).sum(axis=1)
    letters = hist[:, 65:91].sum(axis=1) + hist[:, 97:123].sum(axis=1)
    named = sum(share[k] for k in ("digit", "space", "bang", "bar", "symbol", "sentence_end", "comma", "quote", "bracket"))
    beyond = hist[:, 128:].sum(axis=1) / n
    some_words, some_lines = np.maximum(1, n_words), np.maximum(1, n_lines)
    return np.stack([
        np.log1p(size), np.log1p(n_words), np.log1p(n_lines), (n - hist[:, [9, 10, 11, 12, 13, 32]].sum(axis=1)) / some_words, n_words / some_lines, longest / n,
        hist[:, 65:91].sum(axis=1) / np.maximum(1, letters), share["digit"], share["space"], 1 - named - beyond - letters / n, beyond,
        share["bang"], share["bar"], share["symbol"], share["sentence_end"], share["comma"], share["quote"], share["bracket"],
        distinct / some_words, top / some_words, repeated(2), repeated(5), 1 - _distinct(line_of[full], lines, m)[0] / some_lines, entropy,
    ], axis=1).astype(np.float64)


def statistics(texts: list[str | None]) -> np.ndarray:
    """The statistics of whole texts, a row each in the order of FEATURES; null is the empty text. Texts are worked some
    hundred thousand characters at a time, longer ones alone."""
    piece = np.cumsum([len(t or "") for t in texts]) // PIECE if len(texts) else np.zeros(0, int)
    edges = [0, *(np.flatnonzero(np.diff(piece)) + 1).tolist(), len(texts)]
    parts = [_piece_statistics(texts[lo:hi]) for lo, hi in zip(edges[:-1], edges[1:], strict=True) if hi > lo]
    return np.concatenate(parts) if parts else np.zeros((0, len(FEATURES)))


@dataclass
class Trees:
    """Flattened trees of one depth: node k of a tree has children 2k + 1 and 2k + 2."""

    depth: int
    base: float
    feature: np.ndarray  # trees x (2**depth - 1)
    threshold: np.ndarray  # likewise; a value above it goes right; infinity: all go left
    leaf: np.ndarray  # trees x 2**depth

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Probabilities for the rows of x: every row walks every tree at once, a level at a time."""
        if not len(self.feature) or not len(x):
            return np.full(len(x), 1 / (1 + np.exp(-self.base)))
        trees = np.arange(len(self.feature))[None, :]
        at = np.zeros((len(x), len(self.feature)), np.int64)
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            at = 2 * at + 1 + (x[rows, self.feature[trees, at]] > self.threshold[trees, at])
        return 1 / (1 + np.exp(-(self.base + self.leaf[trees, at - (2**self.depth - 1)].sum(axis=1))))


def fit_trees(x: np.ndarray, y: np.ndarray, rounds: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, least: int = 20, ridge: float = 1.0) -> Trees:
    """Boosted trees for labels y in 0..1 by logistic loss; splits are searched on histograms of ``bins`` bins.

    Without rows the probability is 0.5 everywhere; with one label only it is near that label.
    """
    inner, leaves = 2**depth - 1, 2**depth
    prior = (y.sum() + 1) / (len(y) + 2)
    model = Trees(depth, float(np.log(prior / (1 - prior))), np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, leaves)))
    if not len(y) or y.min() == y.max():
        return model
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1)
    cells = binned + np.arange(x.shape[1])[None, :] * bins
    raw = np.full(len(y), model.base)
    found = ([], [], [])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-raw))
        g, h = p - y, np.maximum(p * (1 - p), 1e-9)
        node = np.zeros(len(y), np.int64)
        feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)
        for level in range(depth):
            first, width = 2**level - 1, x.shape[1] * bins
            flat = ((node - first) * width)[:, None] + cells
            sums = [np.bincount(flat.ravel(), np.repeat(v, x.shape[1]), 2**level * width).reshape(2**level, x.shape[1], bins) for v in (g, h, np.ones(len(y)))]
            left = [s.cumsum(axis=2)[:, :, :-1] for s in sums]
            whole = [s.sum(axis=2)[:, :1, None] for s in sums]
            (gl, hl, nl), (gt, ht, nt) = left, whole
            gain = gl**2 / (hl + ridge) + (gt - gl) ** 2 / (ht - hl + ridge) - gt**2 / (ht + ridge)
            gain = np.where((nl >= least) & (nt - nl >= least), gain, -np.inf)
            for k in range(2**level):
                f, b = np.unravel_index(gain[k].argmax(), gain[k].shape)
                if gain[k, f, b] > 1e-6 and b < len(edges[f]):
                    feature[first + k], threshold[first + k] = f, edges[f][b]
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[node]] > threshold[node])
        at = node - inner
        leaf = -rate * np.bincount(at, g, leaves) / (np.bincount(at, h, leaves) + ridge)
        raw = raw + leaf[at]
        for got, new in zip(found, (feature, threshold, leaf), strict=True):
            got.append(new)
    return Trees(depth, model.base, *(np.stack(v) for v in found))


def fit_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = 20_000) -> Trees:
    """Trees fitted on about ``sample`` labelled documents at most, chosen by the hash of their id.

    Rows without a label, an id or a text row take no part; labels repeated for an id are averaged. The sample is
    what is broadcast and what comes to the driver: ``sample`` rows of 24 numbers.
    """
    known = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("label_id")).agg(F.avg(label_col).alias("label"))
    share = min(1.0, sample / max(1, known.count()))
    chosen = F.broadcast(known.filter(F.pmod(F.xxhash64("label_id"), F.lit(1 << 20)) < int(share * (1 << 20))))

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"label_id": b["label_id"], "label": b["label"], "x": list(statistics(b["text"].tolist()))})

    rows = docs.select(F.col(id_col).alias("label_id"), F.col(text_col).cast("string").alias("text")).join(chosen, "label_id").mapInPandas(measure, "label_id long, label double, x array<double>").orderBy("label_id", "x").toPandas()
    x = np.stack(rows["x"]) if len(rows) else np.zeros((0, len(FEATURES)))
    return fit_trees(x, rows["label"].to_numpy(np.float64))


def quality_score(model: Trees) -> callable:
    """A column function: the probability, from 0 to 1, that a text is good; null and empty texts get one too."""

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(model.scores(statistics([None if t is pd.NA else t for t in texts])))

    return lambda text: score(text.cast("string"))


def score_quality(docs: DataFrame, model: Trees, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with ``quality_score`` and ``quality_pred`` (1 if the score reaches ``threshold``, else 0).

    One row per input row, repeated or not; null and empty texts get a score too, texts of any length are read whole, and an
    empty table stays empty; other columns pass through, columns of those two names are replaced.
    """
    scored = docs.withColumn("quality_score", quality_score(model)(F.col(text_col)))
    return scored.withColumn("quality_pred", (F.col("quality_score") >= threshold).cast("int"))


def held_out(id_col: Column, folds: int, fold: int) -> Column:
    """Whether the crc32 of the id's text leaves ``fold``; false for a null id."""
    return F.coalesce(F.crc32(id_col.cast("string")) % folds == fold, F.lit(False))
