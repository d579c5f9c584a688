"""How distinctive a term is for a record: log-likelihood ratio on a two-by-two table of counts."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folianto.functions.text import py_tokens
from folianto.plans.lineage import cut
from folianto.plans.sizes import broadcast_if_small


#: Terms whose counts a worker holds before it hands them on.
TERMS_HELD = 500_000
#: A word is frequent from this share of the records of the most frequent word on.
HOT_SHARE = 0.01


def term_counts(df: DataFrame, key: str = "doc_id", content: str = "content", least: int = 1) -> DataFrame:
    """``(key, term, tf INT, doc_len INT, df LONG, cf LONG)`` of the default tokenizer, in one pass over the texts.

    A record is one row, so its terms are counted where it was read. Terms found ``least`` times or more in a record have a row
    with its key; each task's records and occurrences of all terms come as rows without a key (``df``, ``cf``). Null, empty and wordless texts give no rows.
    """
    kind = df.schema[key].dataType.simpleString()
    names = [key, "term", "tf", "doc_len", "df", "cf"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        records: Counter[str] = Counter()
        occurrences: Counter[str] = Counter()
        own = None

        def held() -> pa.RecordBatch:
            n = len(records)
            columns = [pa.nulls(n, own), pa.array(records.keys(), pa.string()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.int32()), pa.array(records.values(), pa.int64()), pa.array((occurrences[t] for t in records), pa.int64())]
            records.clear()
            occurrences.clear()
            return pa.RecordBatch.from_arrays(columns, names)

        for batch in batches:
            own = batch.column(0).type
            rows, lens, sizes, terms, tfs = [], [], [], [], []
            for row, text in enumerate(batch.column(1).to_pylist()):
                words = py_tokens(text)
                found = Counter(words)
                records.update(found.keys())
                occurrences.update(found)
                if least > 1:
                    found = {t: n for t, n in found.items() if n >= least}
                if found:
                    rows.append(row)
                    lens.append(len(words))
                    sizes.append(len(found))
                    terms.extend(found.keys())
                    tfs.extend(found.values())
            at = np.repeat(np.array(rows, np.int64), sizes)
            columns = [batch.column(0).take(pa.array(at)), pa.array(terms, pa.string()), pa.array(tfs, pa.int32()), pa.array(np.repeat(np.array(lens, np.int32), sizes), pa.int32())]
            yield pa.RecordBatch.from_arrays([*columns, pa.nulls(len(at), pa.int64()), pa.nulls(len(at), pa.int64())], names)
            if len(records) > TERMS_HELD:
                yield held()
        if records:
            yield held()

    return df.select(key, content).mapInArrow(run, f"`{key}` {kind}, term string, tf int, doc_len int, df long, cf long")


def _part(k: Column, n: Column, p: Column) -> Column:
    """Binomial log likelihood k ln p + (n - k) ln(1 - p), with 0 ln 0 = 0."""
    first = F.when(k > 0, k * F.log(p)).otherwise(F.lit(0.0))
    return first + F.when(n - k > 0, (n - k) * F.log(F.lit(1.0) - p)).otherwise(F.lit(0.0))


def log_likelihood_ratio(tf: Column, doc_len: Column, cf: Column, total: Column) -> Column:
    """Signed 2 ln(lambda) of the term's rate in the record against its rate in the remaining collection.

    Positive where the term is more frequent in the record than outside; a record that is the whole collection scores 0.
    """
    k1, n1 = tf.cast("double"), doc_len.cast("double")
    k2, n2 = (cf - tf).cast("double"), (total - doc_len).cast("double")
    p1, p2, p = k1 / n1, k2 / F.when(n2 > 0, n2), (k1 + k2) / (n1 + n2)
    value = F.greatest(F.lit(0.0), 2 * (_part(k1, n1, p1) + _part(k2, n2, p2) - _part(k1, n1, p) - _part(k2, n2, p)))
    return F.when(n2 <= 0, F.lit(0.0)).otherwise(F.when(p1 >= p2, value).otherwise(-value))


def distinctive_terms(df: DataFrame, key: str = "doc_id", content: str = "content", least_tf: int = 1, most_df: int | None = None) -> DataFrame:
    """``(key, term, tf, df, cf, score)``: every term of every record against the whole collection.

    ``df`` must hold one row for each key. ``least_tf`` and ``most_df`` restrict which rows come out, never what is
    counted: df, cf and the collection's length are over all records. Null, empty and wordless texts give no rows; ties
    need no rule; an empty table gives no rows.
    """
    counted = cut(term_counts(df, key, content, least_tf))  # the texts are tokenized once
    per_term = counted.filter("tf is null").groupBy("term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"))  # one row for each word of the vocabulary
    total = per_term.agg(F.coalesce(F.sum("cf"), F.lit(0)).alias("total"))
    terms = counted.filter("tf is not null").drop("df", "cf")
    if most_df is not None:
        rows = terms.join(per_term.filter(F.col("df") <= most_df), "term")
    else:
        # words that very many records share would meet in one task each: they are few, so they are joined by broadcast
        per_term = cut(per_term)
        often = HOT_SHARE * (per_term.agg(F.max("df")).first()[0] or 0)
        rows = terms.join(broadcast_if_small(per_term.filter(F.col("df") >= often)), "term").unionByName(terms.join(per_term.filter(F.col("df") < often), "term"))
    rows = rows.crossJoin(F.broadcast(total))  # one row
    score = log_likelihood_ratio(F.col("tf"), F.col("doc_len"), F.col("cf"), F.col("total"))
    return rows.select(key, "term", "tf", F.col("df").cast("long"), F.col("cf").cast("long"), score.alias("score"))
