"""Near-duplicate records: a multi-index Hamming join over b-bit minwise signatures, with an exact check.

A signature has ``chunks x width`` symbols of 32 bits, each the least hash of the record's shingles under one function: two
records agree in a symbol with probability equal to their Jaccard similarity. The signature is cut into ``chunks`` parts. By the
pigeonhole principle two signatures that differ in at most ``chunks * (errors + 1) - 1`` symbols differ in at most ``errors``
symbols of one part, so each part is keyed by every choice of ``width - errors`` of its symbols and equal keys are joined: all
pairs within that distance are found. Candidates are then compared by their whole sets of shingles.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folianto.plans.lineage import cut
from folianto.plans.sizes import broadcast_if_small

from .garbled import Model
from .lookalikes import needs_look, transducer

#: Least share of the shingles of either record that must be in both.
SIMILARITY = 0.6
_WORDS = re.compile(r"[^\W_]+")
_OTHER = re.compile(r"[\W_]+")


@dataclass(frozen=True)
class Index:
    """``chunks`` parts of ``width`` symbols, ``errors`` of which may differ; at 0.6 the parameters below miss one pair in 300, at 0.65 one in 1,500, at 0.7 one in 10,000 or fewer."""

    chunks: int
    width: int
    errors: int

    @property
    def distance(self) -> int:
        """Every pair of signatures that differs in at most so many symbols shares a key."""
        return self.chunks * (self.errors + 1) - 1


WORDS_INDEX, CHARS_INDEX = Index(9, 4, 1), Index(15, 5, 1)


def words_shingles() -> Callable[[str], np.ndarray]:
    """Hashes of all sequences of three adjoining words."""
    memo: dict[str, int] = {}
    factors = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)

    def of(text: str) -> np.ndarray:
        words = _WORDS.findall(text)
        if len(words) < 3:
            return np.empty(0, np.uint64)
        if len(memo) > 500_000:
            memo.clear()
        ids = list(map(memo.get, words))
        if None in ids:
            for k, h in enumerate(ids):
                if h is None:
                    ids[k] = memo[words[k]] = xxhash.xxh64_intdigest(words[k])
        a = np.array(ids, np.uint64)
        return _mix(_mix(a[:-2] * factors[0] + a[1:-1]) * factors[1] + a[2:] * factors[2])

    return of


def chars_shingles() -> Callable[[str], np.ndarray]:
    """Hashes of all sequences of three characters, everything but letters and digits being one blank."""

    def of(text: str) -> np.ndarray:
        text = _OTHER.sub(" ", text).strip()
        if len(text) < 3:
            return np.empty(0, np.uint64)
        a = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
        return _mix(a[:-2] << np.uint64(42) | a[1:-1] << np.uint64(21) | a[2:])

    return of


def _distinct(a: np.ndarray) -> np.ndarray:
    """Sorted, each once."""
    a = np.sort(a)
    return a[np.concatenate([[True], a[1:] != a[:-1]])] if len(a) else a


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Signer:
    """Shingle hashes to signature and keys."""

    def __init__(self, index: Index, seed: int = 7):
        r = np.random.default_rng(seed)
        n = index.chunks * index.width
        self.index, self.mult = index, (r.integers(0, 1 << 63, n, np.uint64) * np.uint64(2) + np.uint64(1))[:, None]
        self.add = r.integers(0, 1 << 63, n, np.uint64)[:, None]
        self.choices = np.array(list(itertools.combinations(range(index.width), index.width - index.errors)))

    def signature(self, shingles: np.ndarray) -> np.ndarray:
        least = None
        for start in range(0, len(shingles), 4096):
            part = ((shingles[start : start + 4096][None, :] * self.mult + self.add) >> np.uint64(32)).min(axis=1)
            least = part if least is None else np.minimum(least, part)
        return least

    def keys(self, signatures: np.ndarray) -> np.ndarray:
        """The keys of each row of ``signatures``."""
        parts = signatures.reshape(-1, self.index.chunks, self.index.width)[:, :, self.choices]  # record, chunk, choice, symbol
        h = np.broadcast_to(np.arange(self.index.chunks * len(self.choices), dtype=np.uint64).reshape(1, self.index.chunks, -1), parts.shape[:3])
        for k in range(parts.shape[3]):
            h = _mix(h * np.uint64(0x9E3779B97F4A7C15) + parts[..., k])
        return h.reshape(len(parts), -1).view(np.int64)


def _forms(batch: pa.RecordBatch, change, model: Model | None, memo: dict) -> Iterator[tuple[int, str]]:
    """Row and text, in its one form and lower case, of the records that aren't garbled."""
    texts = batch.column(1).to_pylist()
    looks = needs_look(texts)
    odd, mixed = model.suspects(texts) if model else (np.zeros(len(texts)),) * 2
    for i, text in enumerate(texts):
        if not text:
            continue
        form = change(text)[0] if looks[i] else text
        if odd[i] or mixed[i]:
            # what is in order once in its one form was odd only by look-alikes
            if (form is text or any(map(any, model.suspects([form])))) and model.garbled(text, memo, bool(mixed[i])):
                continue
        yield i, form.lower()


def sign(df: DataFrame, key: str, column: str, shingles: Callable[[], Callable[[str], np.ndarray]], index: Index, leave_out: Model | None = None) -> DataFrame:
    """``(id, class, n, keys ARRAY<BIGINT>)`` of every record that has a shingle and isn't garbled by ``leave_out``.

    ``class`` is the same for records with equal sets of shingles, ``n`` is the size of the set.
    """
    shared = df.sparkSession.sparkContext.broadcast(leave_out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, memo, change, of, signer = shared.value, {}, transducer(), shingles(), Signer(index)
        for batch in batches:
            rows, classes, sizes, signatures = [], [], [], []
            for i, text in _forms(batch, change, model, memo):
                found = _distinct(of(text))
                if len(found):
                    rows.append(i)
                    classes.append(xxhash.xxh64_intdigest(found.tobytes()) - (1 << 63))
                    sizes.append(len(found))
                    signatures.append(signer.signature(found))
            many = len(signer.choices) * index.chunks
            keys = signer.keys(np.stack(signatures)).ravel() if rows else np.empty(0, np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * many), pa.array(keys))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(classes, pa.int64()), pa.array(sizes, pa.int32()), lists], ["id", "class", "n", "keys"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key).alias("id"), F.col(column).alias("text")).filter(F.length("text") > 2).mapInArrow(run, f"id {kind}, class long, n int, keys array<long>")


def shingle_sets(df: DataFrame, key: str, column: str, shingles: Callable[[], Callable[[str], np.ndarray]]) -> DataFrame:
    """``(id, shingles ARRAY<INT>)``: the whole sets, each shingle as 32 bits of its hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        change, of = transducer(), shingles()
        for batch in batches:
            rows, sets = [], []
            for i, text in _forms(batch, change, None, {}):
                rows.append(i)
                sets.append(np.unique((of(text) >> np.uint64(32)).astype(np.uint32)).view(np.int32))
            ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets) if sets else np.empty(0, np.int32)))], ["id", "shingles"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key).alias("id"), F.col(column).alias("text")).mapInArrow(run, f"id {kind}, shingles array<int>")


def near_copies(
    df: DataFrame, key: str, column: str, shingles: Callable[[], Callable[[str], np.ndarray]], index: Index, leave_out: Model | None = None, similarity: float = SIMILARITY
) -> tuple[DataFrame, DataFrame]:
    """``(links, members)``: ``(class_a, class_b)`` of linked classes and ``(class, id)`` of every record with a shingle.

    Records with equal sets form a class, named by its least id; only one record of a class is joined. Null and empty texts, those
    without a shingle and those that ``leave_out`` finds garbled are in neither frame; repeated rows count once; other columns of
    ``df`` are not read; an empty table gives no rows.
    """
    signed = cut(sign(df, key, column, shingles, index, leave_out))
    least = signed.groupBy("class").agg(F.min("id").alias("rep"))
    members = signed.select("class", "id").distinct().join(least, "class").select(F.col("rep").alias("class"), "id")
    one = signed.join(least.select("class", F.col("rep").alias("id")), ["class", "id"], "left_semi")
    keyed = one.select("id", "n", F.explode("keys").alias("key"))
    a, b = (keyed.select("key", F.col("id").alias(f"class_{x}"), F.col("n").alias(f"n_{x}")) for x in "ab")
    near = a.join(b, "key").filter((F.col("class_a") < F.col("class_b")) & (F.least("n_a", "n_b") >= similarity * F.greatest("n_a", "n_b")))
    near = cut(near.select("class_a", "class_b").distinct())
    # the candidates' texts are read again: their sets are larger than the texts, and few are needed
    wanted = near.select(F.explode(F.array("class_a", "class_b")).alias(key)).distinct()
    texts = df.select(key, column).join(broadcast_if_small(wanted), key, "left_semi")
    sets = shingle_sets(texts, key, column, shingles).groupBy("id").agg(F.first("shingles").alias("shingles"))
    sa, sb = (sets.select(F.col("id").alias(f"class_{x}"), F.col("shingles").alias(f"set_{x}")) for x in "ab")
    both = near.join(sa, "class_a").join(sb, "class_b").withColumn("common", F.size(F.array_intersect("set_a", "set_b")))
    # the share is compared in whole numbers: 0.6 has no exact binary form
    enough = F.col("common") * 1000 >= (F.size("set_a") + F.size("set_b") - F.col("common")) * round(similarity * 1000)
    return both.filter(enough).select("class_a", "class_b"), members


def pairs(links: DataFrame, members: DataFrame) -> DataFrame:
    """``(id_a, id_b)``: every pair of different records in one class or in linked classes, the smaller id first."""
    a, b = (members.select(F.col("class").alias(f"class_{x}"), F.col("id").alias(f"id_{x}")) for x in "ab")
    same = a.join(b, F.col("class_a") == F.col("class_b")).filter("id_a < id_b").select("id_a", "id_b")
    other = links.join(a, "class_a").join(b, "class_b").select(F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b"))
    return same.unionByName(other)


def groups(links: DataFrame, members: DataFrame) -> DataFrame:
    """``(id, class_id, n_links)``: the class's least id, and to how many other records each record is linked."""
    sizes = members.groupBy("class").agg(F.min("id").alias("class_id"), F.count("*").alias("size"))
    both = links.select(F.col("class_a").alias("class"), F.col("class_b").alias("other")).unionByName(links.select(F.col("class_b").alias("class"), F.col("class_a").alias("other")))
    far = both.join(sizes.select(F.col("class").alias("other"), "size"), "other").groupBy("class").agg(F.sum("size").alias("far"))
    counts = sizes.join(far, "class", "left").select("class", "class_id", (F.col("size") - 1 + F.coalesce("far", F.lit(0))).alias("n_links"))
    return members.join(counts, "class").select("id", "class_id", "n_links")
