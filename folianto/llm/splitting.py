"""Splitting oversized items at natural boundaries (recursive bisection)."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LIMIT, OVERLAP = 3500, 200

# From the strongest boundary to the weakest; a cut falls after the match.
_BOUNDARIES = (re.compile(r"(?:\r?\n|\r)+"), re.compile(r"[.!?…]+[»”\"')\]]*\s+"), re.compile(r"\s+"))


def _cut_at(text: str, low: int, high: int) -> int:
    """The best cut strictly inside ``text[low:high]``: the strongest boundary in the middle half, then a word boundary anywhere, then the midpoint."""
    middle, quarter = (low + high) // 2, max(1, (high - low) // 4)
    for boundary in _BOUNDARIES:
        best = 0
        for m in boundary.finditer(text, middle - quarter, middle + quarter):
            if low < m.end() < high and (not best or abs(m.end() - middle) < abs(best - middle)):
                best = m.end()
        if best:
            return best
    best = 0
    for m in _BOUNDARIES[-1].finditer(text, low, high):
        if low < m.end() < high and (not best or abs(m.end() - middle) < abs(best - middle)):
            best = m.end()
    return best or middle


def spans(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """``(start, end)`` of the cores: they tile the text; one core if it is within ``limit``."""
    if len(text) <= limit:
        return [(0, len(text))]
    done, todo = [], [(0, len(text))]
    while todo:
        low, high = todo.pop()
        if high - low <= limit - overlap and (low, high) != (0, len(text)):
            done.append((low, high))
            continue
        at = _cut_at(text, low, high)
        todo += [(at, high), (low, at)]
    return done


def split_text(text: str | None, limit: int = LIMIT, overlap: int = OVERLAP) -> list[str]:
    """Pieces of at most ``limit`` code points, in order.

    Each piece after the first begins with up to ``overlap`` code points of the end of the one before, from a word's start
    where there is one. Without the overlaps the pieces joined are the text. Null gives no piece, an empty text one empty piece.
    """
    if not 0 <= overlap < limit - 1:
        raise ValueError("overlap must be below limit - 1")
    if text is None:
        return []
    pieces = []
    for low, high in spans(text, limit, overlap):
        start = low
        if low and overlap:
            start = max(0, low - overlap)
            if start and not text[start - 1].isspace():
                m = _BOUNDARIES[-1].search(text, start, low)
                if m and m.end() < low:
                    start = m.end()
        pieces.append(text[start:high])
    return pieces


def split_items(df: DataFrame, key: str = "doc_id", content: str = "content", limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """``df`` with a row for each piece of ``content``; new columns ``piece`` (from 0) and ``n_pieces``.

    Only texts above ``limit`` leave the JVM. Null content stays one row with ``n_pieces`` 0, content within the limit is
    one piece as stored. Columns of ``df`` named like the new ones are replaced; ties, repeated rows and an empty table
    need no rule: each row is split by itself.
    """

    @F.pandas_udf("array<string>")
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else split_text(t, limit, overlap))

    df = df.drop("piece", "n_pieces")
    large = F.char_length(content) > limit
    others = [c for c in df.columns if c != content]
    many = cut(F.when(large, F.col(content)))
    parts = df.withColumn("_parts", many)
    parts = parts.withColumn("n_pieces", F.when(F.col(content).isNull(), 0).otherwise(F.coalesce(F.size("_parts"), F.lit(1))))
    parts = parts.withColumn("_parts", F.when(F.col("_parts").isNull(), F.array(F.col(content))).otherwise(F.col("_parts")))
    return parts.select(*others, "n_pieces", F.posexplode("_parts").alias("piece", content)).select(*others, content, "piece", "n_pieces")


def renumber(pieces: DataFrame, book: str = "book_id", num: str = "chunk_num", key: str = "doc_id", stride: int = 1024) -> DataFrame:
    """``num`` anew from 1 in each ``book``, in reading order (``num``, ``key``, ``piece``); null numbers come first.

    A book may hold a large share of all rows, so it is never one group: rows are numbered in strides of old numbers, to
    which the counts of the strides before are added.
    """
    bucket = F.struct(F.col(num).isNotNull().alias("has"), F.coalesce(F.floor(F.col(num) / stride), F.floor(F.shiftright(F.col(key), 12))).alias("at"))
    df = pieces.withColumn("_bucket", bucket)
    before = Window.partitionBy(book).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = df.groupBy(book, "_bucket").agg(F.count("*").alias("_n"))
    counts = counts.select(F.col(book).alias("_book"), F.col("_bucket").alias("_at"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inner = Window.partitionBy(book, "_bucket").orderBy(num, key, "piece")
    df = df.withColumn("_rank", F.row_number().over(inner))
    df = df.join(counts, df[book].eqNullSafe(counts["_book"]) & (df["_bucket"] == counts["_at"]))
    return df.withColumn(num, (F.col("_before") + F.col("_rank")).cast("int")).drop("_bucket", "_book", "_at", "_before", "_rank")
