"""Line de-duplication by overlapping units of lines.

A unit is a line with text and the next line with text (blank lines between them belong to it), or one long line
alone. Units depend on their own lines only, so a shared passage has the same units wherever it stands, its edges
included. Units that occur more than once in the corpus are compared byte by byte with their first occurrence and
removed everywhere else; of any line the first occurrence always stays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import PrefixHash, broadcast_if_small, is_space, mix64, row_key, settle, spare_prefix


#: A line of more words, or of at least so many bytes, is a unit of its own.
LONG_WORDS, LONG_BYTES = 50, 300


def chunk_lines(text: str | None) -> list[tuple[int, int, int, int, int]]:
    """(first line, number of lines, first byte, end byte, hash) of each unit, by first line, long lines alone before pairs."""
    raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    if not len(raw):
        return []
    breaks = np.flatnonzero(raw == 10)
    start, end = np.concatenate(([0], breaks + 1)), np.concatenate((breaks, [len(raw)]))
    solid = ~is_space[raw]
    words = np.concatenate(([0], np.cumsum(solid & np.concatenate(([True], ~solid[:-1])))))
    n_words = words[end] - words[start]
    full = np.flatnonzero(n_words > 0)
    alone = full[(n_words[full] > LONG_WORDS) | (end[full] - start[full] >= LONG_BYTES)]
    at, to = np.concatenate((alone, full[:-1])), np.concatenate((alone, full[1:]))
    order = np.lexsort((to, at))
    at, to = at[order], to[order]
    lo, hi = start[at], end[to]
    hashes = mix64(PrefixHash(raw).slices(lo, hi - lo) + (hi - lo).astype(np.uint64)).view(np.int64)
    return list(zip(at.tolist(), (to - at + 1).tolist(), lo.tolist(), hi.tolist(), hashes.tolist(), strict=True))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", names: tuple[str, str] = ("lines_removed", "chunks_removed")) -> DataFrame:
    """``docs`` with repeated units of lines cut from ``text_col``, and counts of lines and units removed, called ``names``.

    The first occurrence by (id, content of the row, place in the text) stays, nulls first. Lines end at \\n. Null
    texts stay null. A line that is repeated without a neighbour goes only if it is long. Rows repeated with the same
    id and text count as one document: each keeps what the document keeps. Empty texts stay, texts of any length are worked
    whole, and an empty table stays empty. Other columns pass through; columns of docs with the two count names are replaced.

    Plan: unit hashes without text are counted; a repeated hash joins its occurrences (skewed hashes are split by
    the planner, as the join stands alone); the texts are shuffled once, by row; the bytes of repeated units are
    shuffled once, for the comparison. Units whose hash is that of a different unit are put back.
    """
    plain = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in names])
    own_names = spare_prefix(plain, "linededup_")
    key, hit_col, back_col, cut_col = (own_names + x for x in ("key", "hits", "back", "cut"))
    keyed = plain.withColumn(key, row_key(id_col, text_col))
    own = keyed.select(F.col(key).alias("key"), F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def chunks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(k, i, u, c[4]) for k, i, t in zip(b["key"], b["id"], b["text"], strict=True) for u, c in enumerate(chunk_lines(t))]
            yield pd.DataFrame(rows, columns=["k", "id", "unit", "h"]).astype({"k": "int64", "unit": "int64", "h": "int64"})

    id_type = own.schema["id"].dataType.simpleString()
    found = settle(own.mapInPandas(chunks, f"k long, id {id_type}, unit long, h long"), "lines-chunks")
    place = F.struct("id", "k", "unit")
    firsts = found.groupBy("h").agg(F.min(place).alias("first"), F.max(place).alias("last")).filter("first != last").select("h", "first")
    hits = found.join(firsts, "h").select("k", "unit", "h", (place == F.col("first")).alias("keeper"))
    per_doc = hits.dropDuplicates(["k", "unit"]).groupBy(F.col("k").alias(key)).agg(F.collect_list(F.struct("unit", "h", "keeper")).alias(hit_col))
    joined = settle(keyed.join(per_doc, key, "left"), "lines-joined")

    def occurrences(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for k, text, hits in zip(b["key"], b["text"], b["hits"], strict=True):
                raw, units = text.encode("utf-8", "surrogatepass"), chunk_lines(text)
                rows += [(k, h["unit"], h["h"], h["keeper"], raw[units[h["unit"]][2] : units[h["unit"]][3]]) for h in hits]
            yield pd.DataFrame(rows, columns=["k", "unit", "h", "keeper", "bytes"])

    with_hits = joined.filter(F.col(hit_col).isNotNull())
    bytes_of = with_hits.select(F.col(key).alias("key"), F.col(text_col).cast("string").alias("text"), F.col(hit_col).alias("hits")).mapInPandas(occurrences, "k long, unit long, h long, keeper boolean, bytes binary")
    kept = bytes_of.filter("keeper").dropDuplicates(["h"]).select("h", F.col("bytes").alias("kept"))
    differ = bytes_of.filter("not keeper").join(kept, "h").filter("bytes != kept").select("k", "unit").distinct()
    restored = settle(differ.groupBy(F.col("k").alias(key)).agg(F.collect_set("unit").alias(back_col)), "lines-restored")

    @F.pandas_udf("struct<text: string, lines: long, chunks: long>")
    def cut(texts: pd.Series, hits: pd.Series, back: pd.Series) -> pd.DataFrame:
        out = []
        for text, own, b in zip(texts, hits, back, strict=True):
            if text is None or own is None:
                out.append((text, 0, 0))
                continue
            units = chunk_lines(text)
            stay = set(() if b is None else b)
            go = [h["unit"] for h in own if not h["keeper"] and h["unit"] not in stay]
            drop = {i for u in go for i in range(units[u][0], units[u][0] + units[u][1])}
            out.append(("\n".join(x for i, x in enumerate(text.split("\n")) if i not in drop) if drop else text, len(drop), len(go)))
        return pd.DataFrame(out, columns=["text", "lines", "chunks"])

    touched = F.col(hit_col).isNotNull()
    done = joined.join(broadcast_if_small(restored), key, "left").withColumn(cut_col, cut(F.when(touched, F.col(text_col).cast("string")), F.col(hit_col), F.col(back_col)))
    text = F.when(touched, F.col(f"{cut_col}.text")).otherwise(F.col(text_col)).alias(text_col)
    columns = [text if c == text_col else F.col(f"`{c}`") for c in plain.columns]
    return done.select(*columns, F.coalesce(f"{cut_col}.lines", F.lit(0).cast("long")).alias(names[0]), F.coalesce(f"{cut_col}.chunks", F.lit(0).cast("long")).alias(names[1]))
