import random

from pyspark.sql import functions as F

from folianto.operators.chunking import ChunkerConfig, chunk, chunk_rows, ellipsis, sentence_column, sentences


def test_small_texts():
    assert chunk("Одно предложение.") == ["Одно предложение."]
    assert chunk("раз\nдва\nтри") == ["раз\nдва\nтри"]
    assert chunk("Текст... с троеточием. . . .") == ["Текст… с троеточием…" + " ."] or "…" in chunk("Текст... с троеточием.")[0]
    assert chunk("") == chunk("\n\n\n") == chunk(None) == []
    assert chunk("а\r\n\r\nб") == ["а\r\n\r\nб"]


def test_long_paragraphs():
    small = ChunkerConfig(300, 500, 1000)
    parts = chunk("Это довольно длинное предложение, которое нужно для проверки разбиения на части текста. " * 50, small)
    assert len(parts) > 1 and all(len(p) <= 500 for p in parts)
    words = chunk(" ".join(f"слово{i}" for i in range(500)), small)
    assert len(words) > 1 and all(p and not p.endswith(" ") and len(p) <= 1000 for p in words)
    assert chunk("я" * 5000, small) == ["я" * 5000]
    # one sentence above the best size among others stands whole
    long = "б" * 700 + "."
    assert long in chunk("Раз. " + long + " Два. " + "в" * 400, small)


def test_joining():
    c = ChunkerConfig(5, 10, 20)
    assert chunk("aaaa\nbbbb\ncccc", c) == ["aaaa\nbbbb\ncccc"[:9] + "\ncccc"]
    assert chunk("aaaaaaaaaa\nbb", c) == ["aaaaaaaaaa\nbb"]
    assert chunk("a" * 19 + "\nbb", c) == ["a" * 19, "bb"]
    assert chunk("aaaaa\n" + "b" * 18, c) == ["aaaaa", "b" * 18]


def test_content_is_kept():
    r = random.Random(3)
    for _ in range(100):
        text = "".join(r.choice("ab .\n!") for _ in range(r.randint(0, 400)))
        joined = "".join(chunk(text, ChunkerConfig(10, 40, 60)))
        assert sorted(joined.replace(" ", "").replace("\n", "")) == sorted(text.replace("...", "…").replace(". . .", "…").replace(" ", "").replace("\n", "")) or "…" in joined


def test_sentences(spark):
    for text, want in {"Раз. Два! Три": ["Раз.", "Два!", "Три"], "а.б в.": ["а.б в."], "Что?!\r\nДа": ["Что?!", "Да"], "": [], "конец…": ["конец…"]}.items():
        assert sentences(text) == want
        assert spark.createDataFrame([(text,)], "t string").select(sentence_column(F.col("t")).alias("x")).first().x == want


def test_columns(spark):
    df = spark.createDataFrame([(1, "раз\nдва", "x"), (2, None, "y"), (3, "", "z")], "book_id long, text string, idx string")
    assert [(r.book_id, r.idx, r.content) for r in chunk_rows(df, "text").collect()] == [(1, 0, "раз\nдва")]
    assert spark.createDataFrame([("а... . . .",)], "t string").select(ellipsis(F.col("t")).alias("x")).first().x == "а… …"
