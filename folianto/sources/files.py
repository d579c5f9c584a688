"""Book files: plain text in several encodings, FB2 and DOCX, read from a folder tree."""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folianto import schemas

from .metadata import book_id, file_name, filename_fields, map_genre

EXTENSIONS = ("txt", "fb2", "docx")
# Letters of Russian by frequency in running text.
FREQUENT = "оеаинтсрвлкмдпуяыьгзбчйхжшюцщэфъё"
CODECS = {"CP1251": "cp1251", "CP866": "cp866", "KOI8-R": "koi8_r"}


class ParserError(Exception):
    """The kind of failure: ReadError, EncodingDetectionFailed, ConversionFailed or EmptyContent."""


class FileError(Exception):
    """FileNotFound: the folder to be read isn't there."""


def _weight(text: str) -> float:
    """How much a text looks like Russian: frequent letters count, capitals inside words and other signs count against it."""
    total, before = 0.0, " "
    for ch in text:
        low = ch.lower()
        if low in FREQUENT:
            total += 1.5 - FREQUENT.index(low) / 16
            if ch != low and before.isalpha() and before == before.lower():
                total -= 2.0
            elif ch != low and before.isalpha():
                total -= 0.5
        elif ch > "\x7f":
            total -= 1.5
        before = ch
    return total


def decode(data: bytes, encoding: str) -> str:
    if encoding == "CP1251":
        return "".join(bytes([b]).decode("cp1251") if b != 0x98 else "\x98" for b in data) if b"\x98" in data else data.decode("cp1251")
    if encoding in CODECS:
        return data.decode(CODECS[encoding])
    return data.decode("utf-8", "replace")


def detect_encoding(data: bytes) -> str:
    """UTF-8 (also for a byte order mark), ASCII, else the Cyrillic encoding in which the bytes look most like Russian; over the whole text."""
    if data.startswith(b"\xef\xbb\xbf"):
        return "UTF-8"
    if data.isascii():
        return "ASCII"
    try:
        data.decode("utf-8")
        return "UTF-8"
    except UnicodeDecodeError:
        return max(CODECS, key=lambda c: (_weight(decode(data, c)), c == "CP1251"))


def parse_txt(data: bytes, name: str) -> dict:
    if not data:
        raise ParserError("EmptyContent")
    encoding = detect_encoding(data)
    text = decode(data, encoding).removeprefix("\ufeff")
    if not text:
        raise ParserError("EmptyContent")
    return {"content": text, "title": name, "author": "", "genre": "", "encoding": encoding}


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def _child(node, *path: str):
    for step in path:
        node = next((c for c in node if _local(c.tag) == step), None) if node is not None else None
    return node


def _own_text(node) -> str:
    """The node's first own text: what stands before its first element, else what follows one; blank text doesn't count."""
    for text in (node.text, *(c.tail for c in node)):
        if text and text.strip():
            return text
    return ""


def parse_fb2(data: bytes, name: str, full_text: bool = False) -> dict:
    """Paragraphs of all bodies joined by line ends. Text behind inline markup is only kept with ``full_text``."""
    try:
        root = ElementTree.fromstring(data)
    except ElementTree.ParseError as e:
        raise ParserError("ReadError") from e
    if _local(root.tag) != "FictionBook":
        raise ParserError("EmptyContent")
    info = _child(root, "description", "title-info")
    title = _child(info, "book-title")
    author = _child(info, "author")
    genre = _child(info, "genre")
    names = [_own_text(n) if (n := _child(author, part)) is not None else "" for part in ("first-name", "last-name")] if author is not None else []
    content = ""
    for body in (c for c in root if _local(c.tag) == "body"):
        for p in (n for n in body.iter() if _local(n.tag) == "p"):
            text = "".join(p.itertext()) if full_text else _own_text(p)
            content = f"{content}\n{text}" if content else text
    if not content:
        raise ParserError("EmptyContent")
    return {
        "content": content,
        "title": re.sub(r"\.[^.]*$", "", name) if title is None else _own_text(title),
        "author": " ".join(n for n in names if n),
        "genre": _own_text(genre) if genre is not None else "",
        "encoding": "UTF-8",
    }


def parse_docx(data: bytes, name: str) -> dict:
    """Non-empty paragraphs joined by line ends; title from the core properties, else the file's stem."""
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            names = set(z.namelist())
            document = ElementTree.fromstring(z.read("word/document.xml"))
            core = ElementTree.fromstring(z.read("docProps/core.xml")) if "docProps/core.xml" in names else None
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError) as e:
        raise ParserError("ReadError") from e
    paragraphs = ("".join(t.text or "" for t in p.iter() if _local(t.tag) == "t") for p in document.iter() if _local(p.tag) == "p")
    content = "\n".join(p for p in paragraphs if p)
    if not content:
        raise ParserError("EmptyContent")
    title = next((n.text for n in core.iter() if _local(n.tag) == "title" and n.text), None) if core is not None else None
    return {"content": content, "title": title or re.sub(r"\.[^.]*$", "", name), "author": "", "genre": "", "encoding": "UTF-8"}


PARSERS = {"txt": parse_txt, "fb2": parse_fb2, "docx": parse_docx}


def parse_bytes(data: bytes, name: str) -> dict:
    """One file as a row of ``schemas.PARSED``; a failure is its ``error``, never an exception."""
    row = dict.fromkeys(("content", "title", "author", "genre", "encoding", "error")) | {"file_path": name, "file_size": len(data or b"")}
    try:
        row |= PARSERS[name.rsplit(".", 1)[-1].lower()](bytes(data or b""), name)
    except ParserError as e:
        row["error"] = str(e)
    except Exception:  # a malformed file must not end the job
        row["error"] = "ConversionFailed"
    return row


def parse_files(files: DataFrame) -> DataFrame:
    """Rows of the ``binaryFile`` source as ``schemas.PARSED`` with the file's ``path``; files of other kinds are left out by name.

    ``file_path`` is the bare name. A file that can't be read is a row with an ``error``; the
    scan itself passes over files of zero bytes.
    """
    files = files.filter(F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(*EXTENSIONS)).select("path", "content")
    columns = [c.split()[0] for c in schemas.PARSED.split(", ")]

    def run(batches):
        for pdf in batches:
            rows = [parse_bytes(data, path.rsplit("/", 1)[-1]) | {"path": path} for path, data in zip(pdf["path"], pdf["content"])]
            yield pd.DataFrame(rows, columns=[*columns, "path"])

    return files.mapInPandas(run, schemas.PARSED + ", path string")


def read_parsed(spark: SparkSession, folder: str) -> DataFrame:
    """Every ``.txt``, ``.fb2`` and ``.docx`` file under ``folder``, parsed."""
    try:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            raise FileError(f"FileNotFound: {folder}") from e
        raise
    return parse_files(files)


def enrich(parsed: DataFrame, genre_map: DataFrame | None = None) -> DataFrame:
    """File-name metadata for text and Word files, mapped genres, and ``book_id`` from the path as given."""
    name, ext = file_name(F.col("path")), F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    named = ext.isin("txt", "docx")
    fields = filename_fields(name)
    df = parsed.withColumn("_f", fields).withColumn("title", F.when(named & (F.col("title") == name) & (F.col("_f.title") != ""), F.col("_f.title")).otherwise(F.col("title")))
    for c in ("author", "genre"):
        df = df.withColumn(c, F.when(named & (F.coalesce(F.col(c), F.lit("")) == ""), F.col(f"_f.{c}")).otherwise(F.col(c)))
    df = df.drop("_f")
    if genre_map is not None:
        df = map_genre(df, "genre", genre_map)
    return df.withColumn("book_id", book_id(F.col("path"), F.col("title"), F.col("author"))).withColumn("file_path", F.col("path"))
