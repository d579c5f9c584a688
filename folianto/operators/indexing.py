"""The inverted index: postings with positions, lexicon, statistics, numbered chunks; built, appended to and loaded.

A stored index is a list of segments, each with the tables of the books added at one time, and a marker for each list that is complete. Adding
books writes their segment only; segments are merged when the newest are no longer much smaller than those before them, so there are as
many as the logarithm of the chunks, and a chunk is rewritten as often.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from folianto import schemas
from folianto.functions.stemming import stem_column
from folianto.functions.text import tokens
from folianto.plans.lineage import cut
from folianto.plans.sizes import broadcast_if_small


def positions(df: DataFrame, key: str, text: str, normalize_yo: bool = True, keep_digits: bool = True) -> DataFrame:
    """``(key, pos INT, term)``: one row for each token."""
    # outer: an inner generator gets a filter on the array's size below it, which would tokenize every text twice
    return df.select(key, F.posexplode_outer(tokens(F.col(text), normalize_yo, keep_digits)).alias("pos", "term")).filter("term is not null")


def rejected(df: DataFrame, key: str, text: str) -> DataFrame:
    """``(key, error)``: rows whose text isn't valid UTF-8; they have no terms."""
    return df.filter(~F.is_valid_utf8(F.col(text))).select(key, F.lit("InvalidUtf8").alias("error"))


def stemmed(tokens_: DataFrame, language: str | None) -> DataFrame:
    """Terms replaced by their stems; each distinct term is stemmed once."""
    if language is None:
        return tokens_
    stems = cut(tokens_.select("term").distinct().withColumn("stem", stem_column(F.col("term"), language)))
    return tokens_.join(broadcast_if_small(stems), "term").drop("term").withColumnRenamed("stem", "term")


def postings(tokens_: DataFrame, key: str = "doc_id") -> DataFrame:
    """``(term, key, tf INT, positions ARRAY<INT>)``."""
    grouped = tokens_.groupBy(key, "term").agg(F.sort_array(F.collect_list("pos")).alias("positions"))
    return grouped.select("term", key, F.size("positions").alias("tf"), "positions")


def lexicon(postings_: DataFrame) -> DataFrame:
    return postings_.groupBy("term").agg(F.count("*").alias("df"))


def statistics(df: DataFrame, word_count: Column) -> DataFrame:
    """One row: records with a token, tokens, and tokens for each record (0 for an empty collection)."""
    return _with_average(df.select(word_count.alias("n")).agg(F.count(F.when(F.col("n") > 0, 1)).alias("doc_count"), F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("total_term_count")))


def _with_average(counts: DataFrame) -> DataFrame:
    average = F.col("total_term_count").cast("double") / F.when(F.col("doc_count") > 0, F.col("doc_count"))
    return counts.withColumn("avg_doc_length", F.coalesce(average, F.lit(0.0)))


def number_chunks(chunks: DataFrame, first_id: int = 1) -> DataFrame:
    """``chunk_num`` from 1 in each book and ``doc_id`` from ``first_id`` on, by book path, book and ``idx``; chunks without a token get none.

    The books' counts are written in ranges of paths; only one number for each range is added up in one task. Within a book the
    window's group is one book's chunks.
    """
    kept = chunks.filter("word_count > 0")
    sizes = kept.groupBy("file_path", "book_id").agg(F.count("*").alias("n"))
    sizes = cut(sizes.repartitionByRange("file_path", "book_id").withColumn("range", F.spark_partition_id()))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    per_range = sizes.groupBy("range").agg(F.sum("n").alias("m")).select("range", F.coalesce(F.sum("m").over(before), F.lit(0)).alias("ahead"))
    inside = Window.partitionBy("range").orderBy("file_path", "book_id").rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.withColumn("before", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(per_range, "range")
    base = base.select("book_id", (F.col("before") + F.col("ahead")).alias("base"))
    num = F.row_number().over(Window.partitionBy("book_id").orderBy("idx"))
    return kept.withColumn("chunk_num", num).join(base, "book_id").withColumn("doc_id", F.col("base") + F.col("chunk_num") + F.lit(first_id - 1)).drop("base")


@dataclass
class Index:
    """The tables of an index; ``language`` is that of its stems (None: words as they are).

    ``stored``: read from files sorted by ``doc_id``. ``indexed_files`` and ``indexed_chunks`` are what the call that returned it added.
    """

    postings: DataFrame
    lexicon: DataFrame
    stats: DataFrame
    chunks: DataFrame
    books: DataFrame
    language: str | None = "russian"
    stored: bool = False
    indexed_files: int = 0
    indexed_chunks: int = 0

    @classmethod
    def over_texts(cls, df: DataFrame, key: str, text: str, title: Column, author: Column, genre: Column, language: str | None = None) -> Index:
        """An index over a table whose rows are the chunks, ids as they are; nothing is written."""
        base = df.select(F.col(key).alias("doc_id"), F.col(text).alias("content"), title.alias("title"), author.alias("author"), genre.alias("genre"))
        terms = postings(stemmed(positions(base, "doc_id", "content"), language))
        words = F.size(tokens(F.col("content")))
        chunks = base.select("doc_id", F.col("doc_id").alias("book_id"), F.lit(1).alias("chunk_num"), words.alias("word_count"), F.char_length("content").alias("char_count"), "content")
        books = base.select(F.col("doc_id").alias("id"), "title", "author", "genre")
        return cls(terms, lexicon(terms), statistics(base, words), chunks, books, language)

    def save(self, spark: SparkSession, path: str) -> Index:
        """Written as a new index of one segment, and read back."""
        books = self.books.select("id", "title", "author", "genre", *(F.col(c) if c in self.books.columns else F.lit(None).cast(t).alias(c) for c, t in (("source", "string"), ("language", "string"), ("file_path", "string"), ("created_at", "long"))))
        segment = _write(spark, path, self.chunks.select("doc_id", "book_id", "chunk_num", "word_count", "char_count", "content"), books, self.language)
        _mark(spark, path, [segment], None)
        return Index.load(spark, path, self.language)

    @classmethod
    def load(cls, spark: SparkSession, path: str, language: str | None = "russian") -> Index:
        """The tables of all segments of the newest complete list; an index that was never written is empty."""
        generation = _newest(spark, path)
        if generation is None or not generation.segments:
            empty = (spark.createDataFrame([], x) for x in (schemas.POSTINGS, schemas.LEXICON, schemas.STATS, schemas.CHUNKS, schemas.BOOKS))
            return cls(*empty, language)
        paths = [f"{path}/{x.name}" for x in generation.segments]
        read = lambda t, x: spark.read.schema(x).parquet(*(f"{p}/{t}" for p in paths))
        words, counts = read("lexicon", schemas.LEXICON), read("stats", schemas.STATS)
        if len(paths) > 1:
            words = words.groupBy("term").agg(F.sum("df").alias("df"))
            counts = _with_average(counts.agg(*(F.sum(c).alias(c) for c in ("doc_count", "total_term_count")), F.max("next_doc_id").alias("next_doc_id")))
            counts = counts.select("doc_count", "total_term_count", "avg_doc_length", "next_doc_id")
        return cls(read("postings", schemas.POSTINGS), words, counts, read("chunks", schemas.CHUNKS), read("books", schemas.BOOKS), language, True)

    @property
    def doc_count(self) -> int:
        row = self.stats.first()
        return row.doc_count if row else 0

    @property
    def avg_doc_length(self) -> float:
        row = self.stats.first()
        return row.avg_doc_length if row else 0.0


_GENERATION = "name string, segments array<struct<name string, chunks long>>"


def _newest(spark: SparkSession, path: str) -> Row | None:
    """The newest complete list of segments: a list counts once its marker is there."""
    try:
        rows = spark.read.schema(_GENERATION).json(f"{path}/generations").collect()  # one row for each call that added books
    except AnalysisException:
        return None
    return max(rows, key=lambda r: r.name) if rows else None


def _mark(spark: SparkSession, path: str, segments: list[tuple[str, int]], before: Row | None) -> None:
    name = f"g{(int(before.name[1:]) if before else 0) + 1:08d}"
    spark.createDataFrame([(name, segments)], _GENERATION).coalesce(1).write.mode("append").json(f"{path}/generations")


def _put(spark: SparkSession, out: str, terms: DataFrame, chunks: DataFrame, books: DataFrame) -> DataFrame:
    """The tables of a segment beside its chunks: terms sorted, so that a query's terms are sought by the row groups' least and greatest values."""
    terms.repartitionByRange("term", "doc_id").sortWithinPartitions("term", "doc_id").write.parquet(f"{out}/postings")
    lexicon(spark.read.schema(schemas.POSTINGS).parquet(f"{out}/postings")).repartitionByRange("term").sortWithinPartitions("term").write.parquet(f"{out}/lexicon")
    books.repartitionByRange("id").sortWithinPartitions("id").write.parquet(f"{out}/books")
    last = chunks.agg((F.coalesce(F.max("doc_id"), F.lit(0)) + 1).alias("next_doc_id"), F.count("*").alias("n"))
    stats = cut(statistics(chunks, F.col("word_count")).crossJoin(last))  # one row each
    stats.drop("n").write.parquet(f"{out}/stats")
    return stats


def _chunks(spark: SparkSession, out: str, chunks: DataFrame) -> DataFrame:
    """Chunks sorted by id, so that a few are fetched without reading the others."""
    chunks.repartitionByRange("doc_id").sortWithinPartitions("doc_id").write.parquet(f"{out}/chunks")
    return spark.read.schema(schemas.CHUNKS).parquet(f"{out}/chunks")


def _write(spark: SparkSession, path: str, chunks: DataFrame, books: DataFrame, language: str | None) -> tuple[str, int]:
    name = f"s{uuid.uuid4().hex}"
    chunks = _chunks(spark, f"{path}/{name}", chunks)
    stats = _put(spark, f"{path}/{name}", postings(stemmed(positions(chunks, "doc_id", "content"), language)), chunks, books)
    return name, stats.first().n


def _merged(spark: SparkSession, path: str, segments: list[tuple[str, int]]) -> list[tuple[str, int]]:
    """``segments`` with the newest ones merged as long as they hold half as many chunks as the one before, or more."""
    keep, n = list(segments), 0
    together: list[tuple[str, int]] = []
    while keep and (not together or keep[-1][1] <= 2 * n):
        together.insert(0, keep.pop())
        n += together[0][1]
    if len(together) == 1:
        return segments
    name = f"s{uuid.uuid4().hex}"
    read = lambda t, x: spark.read.schema(x).parquet(*(f"{path}/{s}/{t}" for s, _ in together))
    chunks = _chunks(spark, f"{path}/{name}", read("chunks", schemas.CHUNKS))
    _put(spark, f"{path}/{name}", read("postings", schemas.POSTINGS), chunks, read("books", schemas.BOOKS))
    return [*keep, (name, n)]


def analysed_chunks(books: DataFrame, text: str, config=None) -> DataFrame:
    """``books`` (``book_id``, ``file_path``, ``text``) as chunks with ``word_count`` and ``char_count``."""
    from .chunking import ChunkerConfig, chunk_rows

    rows = chunk_rows(books.select("book_id", "file_path", text), text, config or ChunkerConfig())
    return rows.withColumn("word_count", F.size(tokens(F.col("content")))).withColumn("char_count", F.char_length("content"))


def new_books(parsed: DataFrame, index: Index) -> DataFrame:
    """Books of ``parsed`` (with ``book_id``) that have no chunk in the index yet, each id once."""
    seen = index.chunks.select("book_id").distinct()
    return parsed.join(seen, "book_id", "left_anti").dropDuplicates(["book_id"])


def append(spark: SparkSession, path: str, parsed: DataFrame, language: str | None = "russian", config=None) -> Index:
    """Add the books of ``parsed`` (content, title, author, genre, file_path, book_id) that are new, as a new segment.

    The marker of the new list of segments is written last: a job that is lost leaves the index as it was.
    """
    old = Index.load(spark, path, language)
    before = _newest(spark, path)
    fresh = cut(new_books(parsed.filter("error is null and content is not null"), old))
    files = fresh.count()
    if not files:
        return old
    row = old.stats.first()
    chunks = number_chunks(analysed_chunks(fresh, "content", config), row.next_doc_id if row else 1)
    chunks = chunks.select("doc_id", "book_id", F.col("chunk_num").cast("int"), "word_count", "char_count", "content")
    now = F.unix_timestamp().alias("created_at")
    books = fresh.select(F.col("book_id").alias("id"), "title", "author", "genre", F.lit("local").alias("source"), F.lit("ru").alias("language"), "file_path", now)
    books = books.join(old.books.select("id"), "id", "left_anti")
    segment = _write(spark, path, chunks, books, language)
    segments = _merged(spark, path, [*((x.name, x.chunks) for x in before.segments), segment] if before else [segment])
    _mark(spark, path, segments, before)
    index = Index.load(spark, path, language)
    index.indexed_files, index.indexed_chunks = files, segment[1]
    return index
