import pytest
from pyspark.sql import functions as F

from folianto.operators.indexing import Index
from folianto.operators.search import EmptyQuery, Engine, find_highlights, highlight_terms, search_terms
from folianto.plans.query import match_all, match_phrase, query_string


def index(spark, *texts, language="russian"):
    df = spark.createDataFrame([(i, t, "История" if i % 2 else "Наука") for i, t in enumerate(texts, 1)], "doc_id long, text string, genre string")
    return Index.over_texts(df, "doc_id", "text", F.concat(F.lit("Книга "), "doc_id"), F.lit("А"), F.col("genre"), language)


def ids(df):
    return [r.doc_id for r in df.collect()]


def test_golden_scores(spark):
    rows = Engine(index(spark, "рим", "рим рим рим")).execute(query_string("рим")).collect()
    assert [(r.doc_id, round(r.bm25_score, 6)) for r in rows] == [(2, 0.258779), (1, 0.229204)]
    one = index(spark, "история древнего рима")
    assert round(Engine(one).execute(query_string("рима")).first().bm25_score, 6) == 0.395563
    one.chunks = one.chunks.withColumn("word_count", F.lit(3))
    assert round(Engine(one, "doc").execute(query_string("рима")).first().bm25_score, 6) == 0.287682


def test_boolean(spark):
    e = Engine(index(spark, "история рима", "история греции"))
    assert ids(e.execute(query_string("история рима"))) == [1]
    assert ids(e.execute(query_string("история -рима"))) == [2]
    assert ids(e.execute(query_string("-рима история"))) == [1, 2]
    assert ids(e.execute(query_string("-рима"))) == []
    assert ids(e.execute(query_string("история --рима"))) == [1, 2]
    assert ids(e.execute(query_string("рима | -история | греции"))) == [2]
    assert sorted(ids(e.execute(query_string("Рима | Греции")))) == [1, 2]
    assert ids(e.execute(match_all())) == []
    assert ids(e.match_all(1)) == [1]
    assert ids(e.match_all(5, genre="Наука")) == [2]


def test_repeated_term_doubles(spark):
    e = Engine(index(spark, "рим", "греция"))
    once, twice = (e.execute(query_string(q)).first().bm25_score for q in ("рим", "рим рим"))
    assert twice == pytest.approx(2 * once, rel=1e-6)


def test_phrases(spark):
    e = Engine(index(spark, "история древнего рима", "древнего рима история", "рима древнего"))
    assert sorted(ids(e.execute(match_phrase("древнего рима")))) == [1, 2]
    assert ids(e.execute(query_string('"история (старого | древнего)"'))) == [1]
    # only the first alternative of the first position starts a match
    assert ids(e.execute(query_string('"(старого | древнего) рима"'))) == []
    assert sorted(ids(e.execute(query_string('"(древнего | старого) рима"')))) == [1, 2]


def test_filters_after_top_k(spark):
    e = Engine(index(spark, "рим рим", "рим", "рим рим рим"))
    assert ids(e.execute(query_string("рим"), 1, genre="Наука")) == []
    assert ids(e.execute(query_string("рим"), 1, genre="Наука", prefilter=True)) == [2]
    assert ids(e.execute(query_string("рим"), 5, title="нига 3")) == [3]
    assert ids(e.execute(query_string("рим"), 5, author="Б")) == []


def test_ties_by_id(spark):
    assert ids(Engine(index(spark, "рим", "рим", "рим")).execute(query_string("рим"), 2)) == [1, 2]


def test_highlights(spark):
    text = "история древнего рима"
    assert find_highlights(text, ["рима"]) == [{"offset": 32, "length": 8}]
    assert find_highlights("a xa a1 A", ["a"]) == [{"offset": 0, "length": 1}, {"offset": 8, "length": 1}]
    assert find_highlights(None, ["a"]) == find_highlights("a", []) == find_highlights("a", [""]) == []
    hit = Engine(index(spark, text)).execute(query_string("рима"), terms=highlight_terms("Рима")).first()
    assert [(h.offset, h.length) for h in hit.highlights] == [(32, 8)]


def test_search_terms(spark):
    one = index(spark, "рим", "рим рим рим", "греция")
    assert ids(search_terms(one, ["рим"])) == [2, 1]
    a, b = (search_terms(one, q).first().bm25_score for q in (["рим"], ["рим", "рим"]))
    assert b == pytest.approx(2 * a, rel=1e-6)
    with pytest.raises(EmptyQuery):
        search_terms(one, [])


def test_empty_corpus(spark):
    e = index(spark, "!!!", None)
    assert e.doc_count == 0 and e.avg_doc_length == 0.0
    assert ids(Engine(e).execute(query_string("рим"))) == [] == ids(search_terms(e, ["рим"]))
