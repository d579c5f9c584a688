"""Searching an index: boolean and phrase queries ranked by BM25, filters, highlights."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folianto.functions.ranking import bm25, idf
from folianto.functions.stemming import stem
from folianto.functions.text import FOLD, WORD_RE
from folianto.plans.compile import compile_tree
from folianto.plans.query import Node, words_in

from .indexing import Index

#: Most hits that are fetched by their ids; more are joined.
MOST_FETCHED = 1_000
HIGHLIGHTS = "array<struct<offset:bigint,length:bigint>>"


class EmptyQuery(ValueError):
    pass


def highlight_terms(query: str) -> list[str]:
    """Terms of a query line, not stemmed."""
    return WORD_RE.findall(query.translate(FOLD))


_ASCII_UPPER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def find_highlights(content: str | None, terms: list[str]) -> list[dict[str, int]]:
    """Byte spans of each term in turn; a span beside an ASCII letter or digit doesn't count, only ASCII case is ignored."""
    text = (content or "").encode().translate(_ASCII_UPPER)
    spans = []
    for term in terms:
        word = term.encode().translate(_ASCII_UPPER)
        if word:
            for m in re.finditer(re.escape(word), text):
                around = text[max(0, m.start() - 1) : m.start()] + text[m.end() : m.end() + 1]
                if not around.isalnum() and not any(chr(b).isalnum() for b in around if b < 128):
                    spans.append({"offset": m.start(), "length": len(word)})
    return spans


def highlights(content: Column, terms: list[str]) -> Column:
    @F.pandas_udf(HIGHLIGHTS)
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: find_highlights(t, terms))

    return run(content)


class Engine:
    """Queries over an index. ``length_norm`` "tf" is the compatible ranking, "doc" the textbook one with true lengths."""

    def __init__(self, index: Index, length_norm: str = "tf"):
        if length_norm not in ("tf", "doc"):
            raise ValueError("length_norm is tf or doc")
        self.index, self.length_norm = index, length_norm

    def normal(self, word: str) -> str:
        """The term of a query word: lower case, ё as е, stemmed; it isn't cut at punctuation."""
        word = word.translate(FOLD)
        return stem(word, self.index.language) if self.index.language else word

    def entries(self, words: list[str]) -> DataFrame:
        """``(doc_id, entries MAP<term, STRUCT<score, positions>>)`` of the records that hold one of the words: one scan of the postings, one shuffle."""
        terms = list(dict.fromkeys(map(self.normal, words)))
        hits = self.index.postings.filter(F.col("term").isin(terms))
        df = self.index.lexicon.filter(F.col("term").isin(terms))
        rows = hits.join(F.broadcast(df), "term").crossJoin(F.broadcast(self.index.stats.select("doc_count", "avg_doc_length")))  # as many rows as words; one row
        length = None
        if self.length_norm == "doc":
            rows = rows.join(self.index.chunks.select("doc_id", "word_count"), "doc_id")
            length = F.col("word_count")
        score = bm25(idf(F.col("doc_count"), F.col("df")), F.col("tf"), F.col("avg_doc_length"), length).cast("float")
        entry = F.struct("term", F.struct(score.alias("score"), "positions"))
        return rows.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(entry)).alias("entries"))

    def scores(self, tree: Node) -> DataFrame:
        """``(doc_id, bm25_score FLOAT)`` of all records in the result."""
        words = words_in(tree)
        if not words:
            return self.index.chunks.filter(F.lit(False)).select("doc_id", F.lit(0).cast("float").alias("bm25_score"))
        value = compile_tree(tree, self.normal, F.col("entries"))
        return self.entries(words).select("doc_id", value.alias("bm25_score")).filter("bm25_score is not null")

    def with_metadata(self, hits: DataFrame, few: bool = False) -> DataFrame:
        """With the chunks' and books' columns. ``few`` hits (a top k) of a stored index are fetched by their ids, which prunes the scans."""
        chunks = self.index.chunks.select("doc_id", "book_id", "chunk_num", "content")
        if few and self.index.stored:
            hits = hits.sparkSession.createDataFrame(hits.collect(), hits.schema)  # at most k rows
            chunks = chunks.filter(F.col("doc_id").isin([r.doc_id for r in hits.collect()]))
            return F.broadcast(hits).join(chunks, "doc_id").join(F.broadcast(self._books(chunks)), "book_id")
        books = self.index.books.select(F.col("id").alias("book_id"), "title", "author", "genre")
        return hits.join(chunks, "doc_id").join(books, "book_id")

    def _books(self, chunks: DataFrame) -> DataFrame:
        """The books of a few chunks."""
        ids = [r.book_id for r in chunks.select("book_id").distinct().collect()]
        return self.index.books.filter(F.col("id").isin(ids)).select(F.col("id").alias("book_id"), "title", "author", "genre")

    @staticmethod
    def _filtered(df: DataFrame, genre: str, author: str, title: str) -> DataFrame:
        for value, keep in ((genre, F.col("genre") == genre), (author, F.col("author") == author), (title, F.col("title").contains(title))):
            if value:
                df = df.filter(keep)
        return df

    def execute(self, tree: Node, top_k: int = 20, genre: str = "", author: str = "", title: str = "", terms: list[str] = (), prefilter: bool = False) -> DataFrame:
        """The best ``top_k`` hits with their metadata, ties by ``doc_id``; filters are applied to those hits only, unless ``prefilter``."""
        order = [F.desc("bm25_score"), F.asc("doc_id")]
        if prefilter:
            hits = self._filtered(self.with_metadata(self.scores(tree)), genre, author, title).orderBy(*order).limit(top_k)
        else:
            hits = self._filtered(self.with_metadata(self.scores(tree).orderBy(*order).limit(top_k), few=top_k <= MOST_FETCHED), genre, author, title)
        spans = highlights(F.col("content"), list(terms)) if terms else F.array().cast(HIGHLIGHTS)
        return hits.select("doc_id", "bm25_score", "title", "author", "genre", "content", spans.alias("highlights"), "book_id", "chunk_num").orderBy(*order)

    def match_all(self, top_k: int = 20, genre: str = "", author: str = "", title: str = "") -> DataFrame:
        """An extension: the first records by ``doc_id`` that pass the filters, with score 0."""
        hits = self.index.chunks.select("doc_id", F.lit(0).cast("float").alias("bm25_score"))
        return self._filtered(self.with_metadata(hits), genre, author, title).orderBy("doc_id").limit(top_k).select("doc_id", "bm25_score", "title", "author", "genre", "content", F.array().cast(HIGHLIGHTS).alias("highlights"), "book_id", "chunk_num")


def search_terms(index: Index, query_terms: list[str], top_k: int = 20) -> DataFrame:
    """``(doc_id, bm25_score FLOAT)``: any of terms that are normal already; a repeated term counts repeatedly, scores are added as doubles."""
    if not query_terms:
        raise EmptyQuery("EmptyQuery")
    times = index.postings.sparkSession.createDataFrame([(t,) for t in query_terms], "term string").groupBy("term").agg(F.count("*").alias("times"))
    hits = index.postings.filter(F.col("term").isin(sorted(set(query_terms))))
    rows = hits.join(F.broadcast(times), "term").join(F.broadcast(index.lexicon.filter(F.col("term").isin(sorted(set(query_terms))))), "term")
    rows = rows.crossJoin(F.broadcast(index.stats.select("doc_count", "avg_doc_length")))
    score = bm25(idf(F.col("doc_count"), F.col("df")), F.col("tf"), F.col("avg_doc_length")) * F.col("times")
    total = rows.groupBy("doc_id").agg(F.sum(score).cast("float").alias("bm25_score"))
    return total.orderBy(F.desc("bm25_score"), "doc_id").limit(top_k)
