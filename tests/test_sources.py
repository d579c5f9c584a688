import io
import zipfile

import pytest
from pyspark.sql import functions as F

from folianto.operators.indexing import Index, append
from folianto.operators.search import Engine
from folianto.plans.query import query_string
from folianto.sources.files import ParserError, detect_encoding, enrich, parse_bytes, parse_docx, parse_fb2, parse_txt, read_parsed
from folianto.sources.metadata import book_id, filename_fields, load_genre_map, map_genre

FB2 = """<?xml version="1.0" encoding="utf-8"?><FictionBook xmlns="http://www.gribuser.ru/xml/fictionbook/2.0"><description><title-info>{info}</title-info></description>{body}</FictionBook>"""


def fb2(body, info="<genre>sf</genre><author><first-name>Иван</first-name><middle-name>П</middle-name><last-name>Петров</last-name></author><author><first-name>Б</first-name></author><book-title>Имя</book-title>"):
    return FB2.format(info=info, body=body).encode()


def docx(paragraphs, title=None):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("[Content_Types].xml", "<Types/>")
        z.writestr("word/document.xml", f"<w:document {w}><w:body>" + "".join("<w:p>" + "".join(f"<w:r><w:t>{t}</w:t></w:r>" for t in p) + "</w:p>" for p in paragraphs) + "</w:body></w:document>")
        if title is not None:
            z.writestr("docProps/core.xml", f'<cp xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:title>{title}</dc:title></cp>')
    return out.getvalue()


def test_txt():
    assert parse_txt("Привет".encode(), "а.txt") == {"content": "Привет", "title": "а.txt", "author": "", "genre": "", "encoding": "UTF-8"}
    got = parse_txt(bytes.fromhex("CFF0E8E2E5F220ECE8F0"), "a.txt")
    assert (got["content"], got["encoding"]) == ("Привет мир", "CP1251")
    assert parse_txt(b"\xef\xbb\xbfabc", "a")["content"] == "abc"
    assert detect_encoding(b"abc") == "ASCII"
    text = "История древнего Рима началась давно, и книга об этом очень велика"
    for name, codec in (("CP1251", "cp1251"), ("CP866", "cp866"), ("KOI8-R", "koi8_r")):
        got = parse_txt(text.encode(codec), "a.txt")
        assert (got["encoding"], got["content"]) == (name, text)
    for empty in (b"", b"\xef\xbb\xbf"):
        with pytest.raises(ParserError, match="EmptyContent"):
            parse_txt(empty, "a.txt")


def test_fb2():
    got = parse_fb2(fb2("<body><p>Раз</p><section><section><p>Два <emphasis>три</emphasis> четыре</p></section></section></body>"), "x.fb2")
    assert got == {"content": "Раз\nДва ", "title": "Имя", "author": "Иван Петров", "genre": "sf", "encoding": "UTF-8"}
    assert parse_fb2(fb2("<body><p>Два <emphasis>три</emphasis> четыре</p></body>"), "x.fb2", full_text=True)["content"] == "Два три четыре"
    assert parse_fb2(fb2("<body><p>а</p></body>", ""), "Имя файла.fb2")["title"] == "Имя файла"
    assert parse_fb2(fb2("<body><p></p><p>а</p><p></p><p>б</p></body>"), "x")["content"] == "а\n\nб"
    for bad, kind in ((fb2("<body></body>"), "EmptyContent"), (b"<a", "ReadError")):
        with pytest.raises(ParserError, match=kind):
            parse_fb2(bad, "x.fb2")


def test_docx():
    got = parse_docx(docx([["При", "вет"], [], ["мир"]], "Имя"), "x.docx")
    assert (got["content"], got["title"]) == ("Привет\nмир", "Имя")
    assert parse_docx(docx([["а"]]), "Жанр_Автор — Имя.docx")["title"] == "Жанр_Автор — Имя"
    for bad, kind in ((docx([]), "EmptyContent"), (b"no zip", "ReadError")):
        with pytest.raises(ParserError, match=kind):
            parse_docx(bad, "x.docx")


def test_failures_are_rows():
    assert parse_bytes(b"", "a.txt")["error"] == "EmptyContent"
    assert parse_bytes(b"x", "a.docx")["error"] == "ReadError"


def test_filename_fields(spark):
    names = {
        "История_Сергеев А. — Древний Рим.fb2": ("История", "Сергеев А.", "Древний Рим"),
        "Фантастика_ — Звёздный путь.txt": ("Фантастика", "", "Звёздный путь"),
        "_Блиш Джеймс — Имя.txt": ("", "Блиш Джеймс", "Имя"),
        "Блиш Джеймс — Имя.txt": ("", "Блиш Джеймс", "Имя"),
        "Простая книга.docx": ("", "", "Простая книга"),
        ".fb2": ("", "", ""),
    }
    df = spark.createDataFrame([(n,) for n in names], "n string").select("n", filename_fields(F.col("n")).alias("f"))
    assert {r.n: tuple(r.f) for r in df.collect()} == names


def test_genre_map(spark, tmp_path):
    path = tmp_path / "g.csv"
    path.write_bytes('Фантастика,Фантастика\r\n"Маркетинг, PR",Бизнес\r\nsf,А\r\nsf , Б \r\nбез запятой\r\n'.encode())
    mapping = load_genre_map(spark, f"file://{path}")
    assert {r.original: r.mapped for r in mapping.collect()} == {"Фантастика": "Фантастика", "Маркетинг, PR": "Бизнес", "sf": "Б"}
    df = spark.createDataFrame([("sf",), ("Sf",), ("",), (None,), ("Маркетинг, PR",)], "genre string")
    assert [r.genre for r in map_genre(df, "genre", mapping).collect()] == ["Б", "Sf", "", None, "Бизнес"]


def test_book_ids(spark, small):
    books = spark.read.parquet(f"{small}/books.parquet")
    assert books.filter(book_id(F.col("file_path"), F.col("title"), F.col("author")) != F.col("id")).count() == 0
    df = spark.createDataFrame([("/A/Б.TXT.gz",), ("/a/Б",), (None,)], "p string")
    a, b, c = (r.x for r in df.select(book_id(F.col("p"), F.lit("т"), F.lit(None).cast("string")).alias("x")).collect())
    assert a == b != c


def write_books(folder):
    (folder / "sub").mkdir(parents=True)
    (folder / "История_Сергеев А. — Древний Рим.txt").write_bytes("история древнего рима".encode("cp1251"))
    (folder / "sub" / "b.FB2").write_bytes(fb2("<body><p>история греции</p></body>"))
    (folder / "c.docx").write_bytes(docx([["кофе и чай"]], "Чай"))
    (folder / "empty.txt").write_bytes(b"\xef\xbb\xbf")
    (folder / "words.txt").write_bytes("!!! ???".encode())
    (folder / "note.pdf").write_bytes(b"%PDF")


def test_files_to_search_and_again(spark, tmp_path):
    write_books(tmp_path / "books")
    mapping = spark.createDataFrame([("История", "Прошлое\r")], "original string, mapped string")
    parsed = enrich(read_parsed(spark, f"file://{tmp_path}/books"), mapping)
    assert {r.error for r in parsed.collect()} == {None, "EmptyContent"}
    path = f"file://{tmp_path}/index"
    assert Index.load(spark, path).doc_count == 0
    index = append(spark, path, parsed)
    assert index.doc_count == 3 and sorted(r.doc_id for r in index.chunks.collect()) == [1, 2, 3]
    assert index.books.count() == 4  # a book without a chunk has a row too
    hit = Engine(index).execute(query_string("Рим")).first()
    assert (hit.title, hit.author, hit.genre, hit.chunk_num) == ("Древний Рим", "Сергеев А.", "Прошлое", 1)
    again = append(spark, path, parsed)
    assert again.doc_count == 3 and again.books.count() == 4
    (tmp_path / "books" / "new.txt").write_text("новый документ о риме")
    more = append(spark, path, enrich(read_parsed(spark, f"file://{tmp_path}/books"), mapping))
    assert more.doc_count == 4 and max(r.doc_id for r in more.chunks.collect()) == 4
    assert len(Engine(more).execute(query_string("рим")).collect()) == 2
    # adding in steps gives the tables of one run
    whole = append(spark, f"file://{tmp_path}/other", enrich(read_parsed(spark, f"file://{tmp_path}/books"), mapping))
    assert sorted(map(tuple, whole.lexicon.collect())) == sorted(map(tuple, more.lexicon.collect()))


def test_stream_and_command_line(spark, tmp_path, capsys):
    from folianto import cli
    from folianto.streaming.ingest import watch

    write_books(tmp_path / "books")
    index = f"file://{tmp_path}/index"
    for _ in range(2):
        watch(spark, f"file://{tmp_path}/books", index, f"file://{tmp_path}/cp").awaitTermination()
    assert Index.load(spark, index).doc_count == 3
    cli.show(Engine(Index.load(spark, index)), "история -греции", 10)
    cli.show(Engine(Index.load(spark, index)), "(история", 10)
    out = capsys.readouterr().out
    assert "Древний Рим" in out and "1 hits" in out and "UnexpectedCharacter" in out
