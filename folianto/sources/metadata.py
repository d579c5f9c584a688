"""Metadata from file names and paths, genre maps, book ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DASH = " — "
# Lower case of paths is ASCII only.
ASCII_UPPER, ASCII_LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, "([^/]*)$", 1)


def without_extension(name: Column) -> Column:
    return F.regexp_replace(name, r"\.[^.]*$", "")


def filename_fields(name: Column) -> Column:
    """STRUCT<genre, author, title> of ``Genre_Author — Title.ext``: without the dash all is title, without ``_`` all before the dash is author."""
    base = without_extension(name)
    at = F.instr(base, DASH)
    left = F.when(at > 0, F.substring(base, F.lit(1), at - 1)).otherwise(F.lit(""))
    right = F.substring(base, at + F.lit(len(DASH)), F.char_length(base))
    bar = F.instr(left, "_")
    genre = F.when(bar > 0, F.substring(left, F.lit(1), bar - 1)).otherwise(F.lit(""))
    author = F.when(bar > 0, F.substring(left, bar + 1, F.char_length(left))).otherwise(left)
    title = F.when(at > 0, F.trim(right)).otherwise(base)
    return F.struct(F.trim(genre).alias("genre"), F.trim(author).alias("author"), title.alias("title"))


def book_id(path: Column, title: Column, author: Column) -> Column:
    """Signed 64 bits from the start of SHA-256 over path (ASCII lower case, one ``.gz`` then one ``.txt`` taken off), title and author; nulls count as empty."""
    low = F.translate(F.coalesce(path, F.lit("")), ASCII_UPPER, ASCII_LOWER)
    stem = F.regexp_replace(F.regexp_replace(low, r"\.gz$", ""), r"\.txt$", "")
    text = F.concat_ws("|", stem, F.coalesce(title, F.lit("")), F.coalesce(author, F.lit("")))
    return F.conv(F.substring(F.sha2(text, 256), 1, 16), 16, -10).cast("long")


def load_genre_map(spark: SparkSession, path: str) -> DataFrame:
    """``(original, mapped)`` of a headerless file of two columns: cut at the first comma outside quotes, blanks, tabs, quotes and
    carriage returns trimmed, the last of repeated keys wins."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\n")).alias("line", "value"))
    head = F.regexp_extract("value", r'^((?:[^",]|"[^"]*")*),', 1)
    tail = F.substring(F.col("value"), F.char_length(head) + 2, F.char_length("value"))
    kept = lines.filter(F.col("value").rlike(r'^(?:[^",]|"[^"]*")*,'))
    edge = "[ \\t\"\\r]+"
    trim = lambda c: F.regexp_replace(c, f"^{edge}|{edge}$", "")
    pairs = kept.select("line", trim(head).alias("original"), trim(tail).alias("mapped")).filter("original <> ''")
    return pairs.groupBy("original").agg(F.max_by("mapped", "line").alias("mapped"))


def map_genre(df: DataFrame, genre: str, mapping: DataFrame) -> DataFrame:
    """``genre`` replaced where the map has exactly that text; empty and unknown genres stay. ``mapping`` has one row for each key."""
    pairs = mapping.select(F.col("original").alias("_original"), F.regexp_replace("mapped", "[\r\n]+$", "").alias("_mapped"))
    joined = df.join(pairs, df[genre] == F.col("_original"), "left")
    return joined.withColumn(genre, F.coalesce("_mapped", genre)).drop("_original", "_mapped")
