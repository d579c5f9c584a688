"""The stored index: segments, merging, interrupted writes, fetching by id; and sessions without settings."""

import os
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from folianto.operators import indexing
from folianto.operators.indexing import Index, append
from folianto.operators.search import Engine
from folianto.plans.query import query_string
from folianto.sources.files import FileError, read_parsed

PARSED = "content string, title string, author string, genre string, file_path string, error string, book_id long"


def books(spark, ids):
    return spark.createDataFrame([(f"слово{i} общее рыба", f"т{i}", "а", "г", f"/{i}.txt", None, i) for i in ids], PARSED)


def segments(spark, path):
    return [x.chunks for x in indexing._newest(spark, path).segments]


def test_segments_are_merged_as_they_grow(spark, tmp_path):
    path = f"file://{tmp_path}/index"
    sizes = []
    for k in range(6):
        index = append(spark, path, books(spark, range(k * 3, k * 3 + 3)))
        assert (index.indexed_files, index.indexed_chunks) == (3, 3)
        sizes.append(segments(spark, path))
    assert all(sum(s) == 3 * (k + 1) and all(a > 2 * b for a, b in zip(s, s[1:])) for k, s in enumerate(sizes))
    assert index.doc_count == 18 and index.lexicon.filter("term = 'рыб'").first().df == 18
    hits = Engine(index).execute(query_string("слово7 общее"), 5).collect()
    assert [h.title for h in hits] == ["т7"]
    again = append(spark, path, books(spark, range(5)))
    assert again.indexed_files == 0 and segments(spark, path) == sizes[-1]
    assert sorted(r.doc_id for r in again.chunks.collect()) == list(range(1, 19))


def test_a_large_segment_is_not_rewritten(spark, tmp_path):
    path = f"file://{tmp_path}/index"
    append(spark, path, books(spark, range(40)))
    first = indexing._newest(spark, path).segments[0].name
    append(spark, path, books(spark, range(40, 45)))
    now = indexing._newest(spark, path).segments
    assert now[0].name == first and [x.chunks for x in now] == [40, 5]
    assert Index.load(spark, path).lexicon.filter("term = 'рыб'").first().df == 45


def test_an_interrupted_run_leaves_the_index(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/index"
    append(spark, path, books(spark, range(3)))
    monkeypatch.setattr(indexing, "_mark", lambda *_: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        append(spark, path, books(spark, range(3, 9)))
    monkeypatch.undo()
    assert Index.load(spark, path).doc_count == 3
    assert append(spark, path, books(spark, range(3, 9))).doc_count == 9


def test_saved_index_equals_one_over_texts(spark, tmp_path):
    df = spark.createDataFrame([(1, "рыба и молоко"), (5, "молоко"), (9, None), (7, "...")], "doc_id long, text string")
    plain = Index.over_texts(df, "doc_id", "text", F.lit("т"), F.lit("а"), F.lit("г"))
    saved = plain.save(spark, f"file://{tmp_path}/index")
    for name in ("postings", "lexicon", "chunks"):
        a, b = (sorted(map(str, getattr(x, name).select(sorted(getattr(plain, name).columns)).collect())) for x in (plain, saved))
        assert a == b
    assert saved.doc_count == plain.doc_count == 2
    assert [h.doc_id for h in Engine(saved).execute(query_string("молоко"), 10).collect()] == [1, 5]


def test_rejected_rows(spark):
    df = spark.createDataFrame([(1, bytearray("да".encode())), (2, bytearray(b"\xff\xfe\x00")), (3, None)], "id long, raw binary").select("id", F.col("raw").cast("string").alias("text"))
    assert [tuple(r) for r in indexing.rejected(df, "id", "text").collect()] == [(2, "InvalidUtf8")]


def test_missing_folder(spark, tmp_path):
    with pytest.raises(FileError):
        read_parsed(spark, f"file://{tmp_path}/nowhere")


def test_session_without_settings(tmp_path):
    """A session whose defaults name no checkpoint folder gets one of its own on one machine."""
    code = (
        "from pyspark.sql import SparkSession\n"
        "from folianto.plans.lineage import cut, shared_dir\n"
        "spark = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false').getOrCreate()\n"
        "assert spark.conf.get('spark.checkpoint.dir', None) is None\n"
        "assert cut(spark.range(5)).count() == 5 and shared_dir(spark) == shared_dir(spark)\n"
    )
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = {k: v for k, v in os.environ.items() if k != "PYSPARK_SUBMIT_ARGS"} | {"SPARK_CONF_DIR": str(tmp_path), "PYTHONPATH": root}
    done = subprocess.run([sys.executable, "-c", code], env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
