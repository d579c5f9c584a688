"""BM25 as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

K1, B = 1.2, 0.75


def idf(n_docs: Column, df: Column) -> Column:
    """ln((N - df + 0.5) / (df + 0.5) + 1); 0 for a term that is nowhere."""
    n, d = n_docs.cast("double"), df.cast("double")
    return F.when(d > 0, F.log((n - d + F.lit(0.5)) / (d + F.lit(0.5)) + F.lit(1.0))).otherwise(F.lit(0.0))


def bm25(idf_: Column, tf: Column, avg_length: Column, length: Column | None = None) -> Column:
    """idf * tf (k1 + 1) / (tf + k1 (1 - b + b length / avg_length)).

    Without ``length`` the term's own frequency stands for the record's length (the behaviour to be compatible with); give the true
    length for textbook BM25. An average of 0 (an empty collection) gives null.
    """
    t = tf.cast("double")
    ratio = (t if length is None else length.cast("double")) / F.when(avg_length > 0, avg_length)
    return idf_ * ((t * F.lit(K1 + 1)) / (t + F.lit(K1) * (F.lit(1 - B) + F.lit(B) * ratio)))
