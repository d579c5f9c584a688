from pyspark.sql import functions as F

from folianto.functions.stemming import stem, stem_column
from folianto.functions.text import py_tokens, tokens


def both(spark, text, **how):
    return spark.createDataFrame([(text,)], "t string").select(tokens(F.col("t"), **how).alias("x")).first().x


def test_tokens(spark):
    cases = {
        "Привет, мир!": ["привет", "мир"],
        "Мама мыла Раму. И еще: папа!": ["мама", "мыла", "раму", "и", "еще", "папа"],
        "ёлка ёж Ёж": ["елка", "еж", "еж"],
        "кое-как светло-серый": ["кое", "как", "светло", "серый"],
        "д'Артаньян": ["д", "артаньян"],
        "глава 42 битва 1812 года": ["глава", "42", "битва", "1812", "года"],
        "!!! ... ---": [],
        "а\r\nб\nв": ["а", "б", "в"],
        "альфа α и бета Β": ["альфа", "α", "и", "бета", "β"],
        "Éclair × ÷": ["Éclair", "×", "÷"],
        "": [],
    }
    for text, want in cases.items():
        assert both(spark, text) == want == py_tokens(text)
    assert both(spark, None) == [] == py_tokens(None)


def test_token_options(spark):
    assert both(spark, "ёлка", normalize_yo=False) == ["ёлка"]
    assert both(spark, "а1б2", keep_digits=False) == ["а", "б"]


def test_russian_stems():
    want = {"история": "истор", "древнего": "древн", "рима": "рим", "рим": "рим", "книга": "книг", "книги": "книг", "книге": "книг", "": ""}
    assert {w: stem(w) for w in want} == want
    assert len({stem(w) for w in ("мальчик", "мальчика", "мальчику", "мальчиком")}) == 1
    more = {"важнейший": "важн", "важность": "важност", "вавиловка": "вавиловк", "пою": "по", "бежавшая": "бежа", "прочитавши": "прочита", "умываясь": "умыв", "синяя": "син", "стены": "стен", "жёлтый": "желт", "длинный": "длин"}
    assert {w: stem(w) for w in more} == more
    assert stem("market") == "market"


def test_english_stems():
    want = {"running": "run", "runs": "run", "easily": "easili", "books": "book", "generously": "generous", "skies": "sky", "hopping": "hop", "hoping": "hope", "relational": "relat", "conditional": "condit", "happy": "happi", "cries": "cri", "ties": "tie", "news": "news", "agreed": "agre", "consist": "consist", "consistency": "consist", "knightly": "knight", "controlling": "control"}
    assert {w: stem(w, "english") for w in want} == want


def test_stem_column(spark):
    df = spark.createDataFrame([("книги",), (None,), ("",)], "t string")
    assert [r.s for r in df.select(stem_column(F.col("t")).alias("s")).collect()] == ["книг", None, ""]
