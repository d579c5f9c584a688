"""Queries of the subpackage and their SQL, for ``__spark_entry__``."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folianto.plans.sizes import once_per_key, spread

from . import bpe, canonical, distinctive, garbled, lookalikes, names, nearcopies, packing, splitting, truncated


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{d}/{name}.parquet"))


def _chunks(spark: SparkSession, d: str, *more: str) -> DataFrame:
    """Each chunk once."""
    return once_per_key(spark.read.parquet(f"{d}/chunks.parquet"), "doc_id", ["doc_id", *more, "content"])


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    pieces = splitting.split_items(_table(spark, d, "chunks").select("doc_id", "content"))
    return pieces.filter("piece > 0").select("doc_id").distinct()


def p1_pieces(spark: SparkSession, d: str) -> DataFrame:
    pieces = splitting.renumber(splitting.split_items(_chunks(spark, d, "book_id", "chunk_num")))
    return pieces.select("book_id", "chunk_num", "doc_id", "piece", "n_pieces", "content")


def _near(spark: SparkSession, d: str) -> dict[str, tuple[DataFrame, DataFrame]]:
    model = garbled.library_model(spark, d)
    how = {"content": (nearcopies.words_shingles, nearcopies.WORDS_INDEX), "title": (nearcopies.chars_shingles, nearcopies.CHARS_INDEX)}
    out = {}
    for name, (shingles, index) in how.items():
        table, key = FIELDS[name]
        out[name] = nearcopies.near_copies(_table(spark, d, table), key, name, shingles, index, model)
    return out


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    parts = [nearcopies.pairs(*near).select(F.lit(name).alias("field"), "id_a", "id_b") for name, near in _near(spark, d).items()]
    return functools.reduce(DataFrame.unionByName, parts)


def p2_groups(spark: SparkSession, d: str) -> DataFrame:
    parts = [nearcopies.groups(*near).select(F.lit(name).alias("field"), F.col("id").alias("rec_id"), "class_id", "n_links") for name, near in _near(spark, d).items()]
    return functools.reduce(DataFrame.unionByName, parts)


def p2_links(spark: SparkSession, d: str) -> DataFrame:
    """Which classes of ``p2_groups`` are linked, by their least ids."""
    parts = [links.select(F.lit(name).alias("field"), "class_a", "class_b") for name, (links, _) in _near(spark, d).items()]
    return functools.reduce(DataFrame.unionByName, parts)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    fields = ("content", "title")
    model = garbled.library_model(spark, d)
    parts = []
    for name in fields:
        table, key = FIELDS[name]
        cases = lookalikes.normalize(_table(spark, d, table), key, name, only_cases=True, leave_out=model)
        parts.append(cases.select(F.lit(name).alias("field"), F.col(key).alias("rec_id")).distinct())
    return functools.reduce(DataFrame.unionByName, parts)


def p3_texts(spark: SparkSession, d: str) -> DataFrame:
    parts = []
    for name in ("content", "title"):
        table, key = FIELDS[name]
        texts = lookalikes.normalize(_table(spark, d, table), key, name)
        parts.append(texts.select(F.lit(name).alias("field"), F.col(key).alias("rec_id"), F.col(name).alias("text"), "is_case").dropDuplicates(["rec_id"]))
    return functools.reduce(DataFrame.unionByName, parts)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    wrong = _garbled(spark, d, ("author",)).select(F.col("rec_id").alias("id"))
    authors = spark.read.parquet(f"{d}/books.parquet").select("id", "author")
    values = authors.join(wrong, "id", "left_anti").select("author").distinct()
    return names.link_names(values, "author", spark.read.parquet(f"{d}/given_names.parquet"))


def _mapped_books(spark: SparkSession, d: str) -> DataFrame:
    books, genres, other = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("books", "genre_list", "genre_map"))
    return canonical.map_books(spark, books, genres, other)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _mapped_books(spark, d).select("book_id", "genre_id")


def p5_unmatched(spark: SparkSession, d: str) -> DataFrame:
    return _mapped_books(spark, d).filter("genre_id = 0").groupBy("genre").agg(F.count("*").alias("n_books"))


#: Fields of the library's text: table, key and column.
FIELDS = {"content": ("chunks", "doc_id"), "title": ("books", "id"), "author": ("books", "id")}


def _garbled(spark: SparkSession, d: str, fields: tuple[str, ...], restored: bool = False, model: garbled.Model | None = None) -> DataFrame:
    """``(field, rec_id, chain, log_odds[, restored])``, each record once."""
    model = model or garbled.library_model(spark, d)
    parts = []
    for name in fields:
        table, key = FIELDS[name]
        found = garbled.detect(_table(spark, d, table), key, name, model, restored)
        parts.append(found.withColumnRenamed(key, "rec_id").select(F.lit(name).alias("field"), "*").dropDuplicates(["rec_id"]))
    return functools.reduce(DataFrame.unionByName, parts)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return _garbled(spark, d, ("content", "title", "author")).select("field", "rec_id")


def p6_restored(spark: SparkSession, d: str) -> DataFrame:
    return _garbled(spark, d, ("content", "title", "author"), restored=True)


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return distinctive.distinctive_terms(_chunks(spark, d), least_tf=5, most_df=3).select("doc_id", "term")


def p7_scores(spark: SparkSession, d: str) -> DataFrame:
    return distinctive.distinctive_terms(_chunks(spark, d))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return bpe.encode(_table(spark, d, "documents"))


def p9_pack(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(bpe.count_tokens(_table(spark, d, "documents")))


def p9_report(spark: SparkSession, d: str) -> DataFrame:
    return packing.report(p9_pack(spark, d))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return truncated.find_truncated(_table(spark, d, "documents")).filter("truncated").select("doc_id")


def p10_by_source(spark: SparkSession, d: str) -> DataFrame:
    return truncated.by_source(truncated.find_truncated(_table(spark, d, "documents")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p1_pieces, p2_found, p2_groups, p2_links, p3_found, p3_texts, p4_found, p5_found, p5_unmatched, p6_found, p6_restored, p7_found, p7_scores, p8_ids, p9_pack, p9_report, p10_found, p10_by_source)}


_TERMS = r"""
    with c as (select distinct doc_id, content from chunks where content is not null),
    t as (select doc_id, unnest(regexp_extract_all(translate(content, 'АБВГДЕЖЗИЙКЛМНОПРСТУФХЦЧШЩЪЫЬЭЮЯЁABCDEFGHIJKLMNOPQRSTUVWXYZΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩё',
        'абвгдежзийклмнопрстуфхцчшщъыьэюяеabcdefghijklmnopqrstuvwxyzαβγδεζηθικλμνξοπρστυφχψωе'), '[\x{0400}-\x{04FF}A-Za-z\x{00C0}-\x{024F}\x{0370}-\x{03FF}0-9]+')) as term from c),
    tf as (select doc_id, term, count(*) as tf from t group by 1, 2),
    df as (select term, count(*) as df, sum(tf)::bigint as cf from tf group by 1)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": "select distinct doc_id from chunks where length(content) > 3500",
        "p7_found": _TERMS + "select doc_id, term from tf join df using (term) where tf >= 5 and df <= 3",
    }
