"""Paragraph- and sentence-aware chunks of long texts."""

from __future__ import annotations

import re
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class ChunkerConfig:
    """Sizes in code points: a rest below ``least`` joins the chunk before, a chunk ends at ``best`` or more, and none is joined above ``most``."""

    least: int = 300
    best: int = 1800
    most: int = 3500


_SENTENCE = re.compile(r"(.*?[.!?])(?:[ \n\r]+|\Z)|(.+)\Z", re.S)


def ellipsis(col: Column) -> Column:
    """Three dots, also spaced ones, as one character."""
    return F.replace(F.replace(col, F.lit("..."), F.lit("…")), F.lit(". . ."), F.lit("…"))


def sentences(text: str) -> list[str]:
    """A full stop, ``!`` or ``?`` ends a sentence before a blank, a line end or the end; the rest is one too."""
    found = []
    for m in _SENTENCE.finditer(text):
        part = m.group(1) or m.group(2)
        found.append(part.lstrip(" ") or part)
    return found


def sentence_column(col: Column) -> Column:
    """``sentences`` as an array column, without leaving the JVM."""
    parts = F.split(F.regexp_replace(col, "([.!?])[ \n\r]+", "$1\u0001"), "\u0001")
    parts = F.transform(parts, lambda x: F.when(F.ltrim(x) == "", x).otherwise(F.ltrim(x)))
    return F.filter(parts, lambda x: x != "")


def sentence_rows(df: DataFrame, text: str) -> DataFrame:
    """``df`` without ``text``, a row for each of the chunker's sentences: ``pos`` from 0 and ``sentence``."""

    @F.pandas_udf("array<string>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: sentences(t or ""))

    rest = [c for c in df.columns if c != text]
    return df.select(*rest, F.posexplode(run(F.col(text))).alias("pos", "sentence"))


def _packed(parts: list[str], most: int, alone: int | None = None) -> list[str]:
    """Parts joined by blanks as long as they stay within ``most``; one longer than ``alone`` stands for itself."""
    out: list[str] = []
    current = ""
    for part in parts:
        if alone is not None and len(part) > alone:
            out += [current, part] if current else [part]
            current = ""
        elif len(current) + len(part) + bool(current) <= most:
            current = f"{current} {part}" if current else part
        else:
            if current:
                out.append(current)
            current = part
    return out + [current] if current else out


def split_paragraph(paragraph: str, config: ChunkerConfig) -> list[str]:
    found = sentences(paragraph)
    if not found or len(found) == 1 and len(found[0]) > config.most:
        text = found[0] if found else paragraph
        return _packed([w for w in text.split(" ") if w], config.most)
    return _packed(found, config.best, alone=config.best)


def chunk(text: str | None, config: ChunkerConfig = ChunkerConfig()) -> list[str]:
    """Chunks of a text. Lines are paragraphs; empty ones are dropped. Null and empty texts have none."""
    done: list[str] = []
    current = ""
    for line in (text or "").split("\n"):
        line = line.replace("...", "…").replace(". . .", "…")
        if not line:
            continue
        if len(line) > config.most:
            done += ([current] if current else []) + split_paragraph(line, config)
            current = ""
        elif len(current) + len(line) + bool(current) <= config.most:
            current = f"{current}\n{line}" if current else line
            if len(current) >= config.best:
                done.append(current)
                current = ""
        else:
            if current:
                done.append(current)
            current = line
    if current:
        if done and len(current) < config.least and len(done[-1]) + len(current) + 1 <= config.most:
            done[-1] += "\n" + current
        else:
            done.append(current)
    return done


def chunk_column(col: Column, config: ChunkerConfig = ChunkerConfig()) -> Column:
    @F.pandas_udf("array<string>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: chunk(t, config))

    return run(col)


def chunk_rows(df: DataFrame, text: str, config: ChunkerConfig = ChunkerConfig()) -> DataFrame:
    """``df`` without ``text``, a row for each chunk: ``idx`` from 0 and ``content``."""
    rest = [c for c in df.columns if c not in (text, "idx", "content")]
    return df.select(*rest, F.posexplode(chunk_column(F.col(text), config)).alias("idx", "content"))
