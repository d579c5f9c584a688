"""Visually identical text brought to one form.

A transducer is compiled once from width, presentation, combining, blank, invisible and look-alike rules, with a check that no
two rules give different results for one cluster. It passes over the grapheme clusters of a text, longest match first. Look-alike
letters depend on the script of their word, which is decided by the letters that have no double, then by the words around.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import cache, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .garbled import Model

# Look-alike letters. Each column looks the same in Latin, Cyrillic and Greek; a dot: no such letter.
LATIN = "aceopxyijsABCEHIJKMOPSTXYvZNh"
CYRILLIC = "асеорхуіјѕАВСЕНІЈКМОРЅТХУ...һ"
GREEK = "α..ορχγι..ΑΒ.ΕΗΙ.ΚΜΟΡ.ΤΧΥνΖΝ."
# Further letters drawn like Latin ones.
MORE = {("ɑ", "L"): "a", ("ɡ", "L"): "g", ("ı", "L"): "i", ("ԁ", "L"): "d", ("ԛ", "L"): "q", ("ԝ", "L"): "w"}
# Invisible characters, and blanks other than the plain one.
INVISIBLE = "".join(map(chr, [0xAD, 0x34F, 0x61C, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x180E, *range(0x200B, 0x2010), *range(0x202A, 0x202F), *range(0x2060, 0x2065), *range(0x2066, 0x2070), 0xFEFF]))
BLANKS = "".join(map(chr, [0xA0, 0x1680, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000]))
# Ordinary typography that has a compatibility form and stays.
KEEP = "…№™ªº²³¹¼½¾´¨¸¯˜µ·‥⁄′″‼⁇⁈⁉Ω℃℉ſ"
#: Blocks whose compatibility forms are presentation forms of letters, digits and punctuation marks.
PRESENTATION = ((0x2100, 0x2150), (0x2160, 0x2180), (0x2460, 0x2500), (0xFB00, 0xFB07), (0xFE30, 0xFE70), (0xFF01, 0xFFEF), (0x1D400, 0x1D800), (0x3200, 0x3400))


@cache
def double_of() -> dict[tuple[str, str], str]:
    """(letter, script of the word) to the letter meant; a conflict between rules is an error."""
    table: dict[tuple[str, str], str] = {}

    def add(letter: str, script: str, meant: str) -> None:
        if table.setdefault((letter, script), meant) != meant:
            raise ValueError(f"conflicting rules for {letter!r} in {script}: {table[letter, script]!r}, {meant!r}")

    for la, cy, gr in zip(LATIN, CYRILLIC, GREEK):
        for script, meant in (("L", la), ("C", cy)):
            if meant != ".":
                for other in (la, cy, gr):
                    if other not in (".", meant):
                        add(other, script, meant)
    for (letter, script), meant in MORE.items():
        if (letter, script) not in table:
            add(letter, script, meant)
    return table


@cache
def mapping() -> dict[str, str]:
    """Cluster to its form, for all rules that need no context."""
    table: dict[str, str] = dict.fromkeys(INVISIBLE, "") | dict.fromkeys(BLANKS, " ")

    def add(cluster: str, form: str) -> None:
        if table.setdefault(cluster, form) != form:
            raise ValueError(f"conflicting rules for {cluster!r}: {table[cluster]!r}, {form!r}")

    for low, high in PRESENTATION:
        for code in range(low, high):
            ch = chr(code)
            form = unicodedata.normalize("NFKC", ch)
            if form != ch and ch not in KEEP and not form.isspace():
                add(ch, form)
    for low, high in ((0x41, 0x250), (0x370, 0x530), (0x1E00, 0x2000)):
        for code in range(low, high):
            ch = chr(code)
            parts = unicodedata.normalize("NFD", ch)
            if len(parts) > 1 and unicodedata.normalize("NFC", parts) == ch:
                add(parts, ch)
                for k in range(2, len(parts)):  # part of it composed already
                    add(unicodedata.normalize("NFC", parts[:k]) + parts[k:], ch)
    return table


#: Combining marks that may follow a letter.
_MARK = "\u0300-\u036f"
_MARKED = re.compile(f"[^{_MARK}][{_MARK}]+", re.S)
_WORD = re.compile(f"[^\\W_]+(?:[{_MARK}]+[^\\W_]*)*(?:['’-][^\\W_]+)*")

# Bits of characters: 1 needs the transducer, 2 Latin, 4 Cyrillic, 8 Greek letter, 16 has a double in another script, 32 belongs to a word, 64 joins the parts of a compound.
_KIND = np.zeros(0x10001, np.uint8)
_KIND[0x10000] = 1
for _low, _high, _bit in ((0x41, 0x5B, 2), (0x61, 0x7B, 2), (0xC0, 0x250, 2), (0x1E00, 0x1F00, 2), (0x400, 0x530, 4), (0x370, 0x400, 8), (0x300, 0x370, 1)):
    _KIND[_low:_high] |= _bit
_KIND[[0xD7, 0xF7]] = 0
_KIND[[ord(c) for c in mapping() if len(c) == 1 and ord(c) < 0x10000]] |= 1
_KIND[[ord(a) for a, _ in double_of()]] |= 16
_KIND[[c for c in range(0x10000) if chr(c).isalnum()]] |= 32
_KIND[0x10000] |= 32
_KIND[[ord(c) for c in "'’-"]] |= 64


def script_of(letter: str) -> str:
    k = _KIND[min(ord(letter), 0x10000)]
    return "L" if k & 2 else "C" if k & 4 else "G" if k & 8 else ""


def needs_look(texts: list[str | None]) -> np.ndarray:
    """Texts that hold a mapped character, two scripts in one word, a lone letter with doubles in a compound of two scripts, or a word
    all of whose letters have doubles in the script that most letters or most sure words of the text are in; all others are in their
    one form already."""
    if not texts:
        return np.zeros(0, bool)
    starts = np.cumsum([0] + [len(t or "") + 1 for t in texts[:-1]])
    text = "\n".join(t or "" for t in texts) + "\n"
    kind = _KIND[np.minimum(np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32), 0x10000)]
    script = kind & 14
    odd = (kind & 1) > 0
    odd[:-1] |= (script[:-1] > 0) & (script[1:] > 0) & (script[:-1] != script[1:])
    found = np.logical_or.reduceat(odd, starts)
    each = np.stack([np.add.reduceat(script == s, starts, dtype=np.int64) for s in (2, 4, 8)])
    most = each.argmax(axis=0)
    # runs of letters
    letter = script > 0
    edge = np.flatnonzero(letter[1:] & ~letter[:-1]) + 1
    first = np.concatenate([[0], edge]) if letter[0] else edge
    if len(first):
        plain = np.bitwise_or.reduceat(np.where(letter & ((kind & 16) == 0), np.uint8(1), np.uint8(0)), first) > 0
        owner = np.searchsorted(starts, first, side="right") - 1
        strange = ~plain & (script[first] != np.array([2, 4, 8], np.uint8)[most[owner]])
        found[owner[strange]] = True
    rest = np.flatnonzero(~found & ((each > 0).sum(axis=0) > 1))
    if len(rest):
        found[rest] = _needs_closer_look([texts[i] for i in rest.tolist()])
    return found


def _needs_closer_look(texts: list[str]) -> np.ndarray:
    """The same for texts that hold letters of several scripts, none beside each other: by whole words, compounds and sure words."""
    starts = np.cumsum([0] + [len(t) + 1 for t in texts[:-1]])
    kind = _KIND[np.minimum(np.frombuffer(("\n".join(texts) + "\n").encode("utf-32-le", "replace"), np.uint32), 0x10000)]
    script, of = kind & 14, np.array([2, 4, 8], np.uint8)
    letter, word, whole = script > 0, (kind & 32) > 0, (kind & 96) > 0
    first = np.flatnonzero(letter & ~np.concatenate([[False], letter[:-1]]))
    owner = np.searchsorted(starts, first, side="right") - 1
    found = np.zeros(len(texts), bool)
    own = letter & ((kind & 16) == 0)
    plain = np.add.reduceat(own, first, dtype=np.int64) > 0
    # two scripts in a word, with digits between the letters; the newline after each text parts the words
    piece, compound = np.cumsum(~word)[first], np.cumsum(~whole)[first]
    found[owner[1:][(piece[1:] == piece[:-1]) & (script[first][1:] != script[first][:-1])]] = True
    # a lone letter in a compound of two scripts
    opens = np.flatnonzero(np.concatenate([[True], compound[1:] != compound[:-1]]))
    scripts = np.bitwise_or.reduceat(script[first], opens)
    two = np.repeat((scripts & (scripts - 1)) > 0, np.diff(np.append(opens, len(first))))
    found[owner[two & ~letter[first + 1] & ~plain]] = True
    # the script of most sure words, as the transducer takes it
    each = np.stack([np.add.reduceat(own & (script == s), first[opens], dtype=np.int64) for s in of])
    sure, some = np.zeros((3, len(texts)), np.int64), each.sum(axis=0) > 0
    np.add.at(sure, (each.argmax(axis=0)[some], owner[opens][some]), 1)
    found[owner[~plain & (script[first] != of[sure.argmax(axis=0)[owner]])]] = True
    return found


@lru_cache(200_000)
def _word_script(word: str) -> tuple[str, bool]:
    """The script a word is meant in and whether that is sure: that of most letters without a double there, else of most letters."""
    table = double_of()
    own, every = {"L": 0, "C": 0, "G": 0}, {"L": 0, "C": 0, "G": 0}
    for ch in word:
        if s := script_of(ch):
            every[s] += 1
            if not any((ch, t) in table for t in "LC" if t != s):
                own[s] += 1
    if sum(own.values()):
        best = max(own, key=lambda s: (own[s], every[s]))
        return best, True
    return (max(every, key=every.get), False) if sum(every.values()) else ("", False)


@lru_cache(200_000)
def _one_script(word: str) -> bool:
    return len({script_of(c) for c in word} - {""}) <= 1


def _opens(text: str, at: int) -> bool:
    """Whether a sentence opens at ``at``."""
    before = text[:at].rstrip(" «“„\"'—")
    return not before or before[-1] in ".!?…\n\r:"


class Transducer:
    """One pass over a text."""

    def __init__(self) -> None:
        self.table, self.double = mapping(), double_of()
        self.single = {ord(a): b for a, b in self.table.items() if len(a) == 1}

    def clusters(self, text: str) -> str:
        """Widths, presentation forms, combining marks, blanks and invisible characters."""
        return _MARKED.sub(self._composed, text.translate(self.single))

    def _composed(self, m: re.Match) -> str:
        base, marks, rest = m.group()[0], m.group()[1:], ""
        while marks:  # the longest part that is one character
            for k in range(len(marks), 0, -1):
                if (whole := self.table.get(base + marks[:k])) is not None:
                    base, marks = whole, marks[k:]
                    break
            else:
                rest, marks = rest + marks[0], marks[1:]
        return base + rest

    def __call__(self, text: str) -> tuple[str, bool]:
        """The one form, and whether the text held a case."""
        out = self.clusters(text)
        case = out != text
        words = list(_WORD.finditer(out))
        scripts = [_word_script(m.group()) for m in words]
        sure = {"L": 0, "C": 0, "G": 0}
        for (s, ok), m in zip(scripts, words):
            if ok:
                sure[s] += 1
        main = max(sure, key=sure.get)
        parts, at = [], 0
        for k, (m, (script, ok)) in enumerate(zip(words, scripts)):
            word = m.group()
            if not script or (ok and (script == "G" or _one_script(word))):
                continue
            if not ok:
                # all letters have doubles: the script of the words beside decides, if they agree
                near = {scripts[j][0] for j in range(max(0, k - 2), min(len(words), k + 3)) if j != k and scripts[j][1]}
                mixed = not _one_script(word)
                if mixed:
                    script = near.pop() if len(near) == 1 else main if sum(sure.values()) else script
                elif near == {main} and script != main and main in "LC" and (word[1:].islower() or len(word) == 1 and (word.islower() or word in "ABCKOY" and _opens(out, m.start()))):
                    script = main
                else:
                    continue
            fixed = "".join(self.double.get((c, script), c) if script_of(c) not in ("", script) else c for c in word) if script in "LC" else word
            if fixed != word:
                if "-" in word or "’" in word or "'" in word:
                    fixed = self._parts(word, script)
                if fixed != word:
                    parts.append(out[at : m.start()])
                    parts.append(fixed)
                    at = m.end()
        if parts:
            parts.append(out[at:])
            return "".join(parts), True
        return out, case

    def _parts(self, word: str, script: str) -> str:
        """A compound: parts that are wholly of another script stay (as in IT-отдел)."""
        out = []
        for piece in re.split("(['’-])", word):
            own, ok = _word_script(piece)
            target = own if ok else script
            if not ok and _one_script(piece) and len(piece) > 1:
                out.append(piece)
            elif target in "LC" and target:
                out.append("".join(self.double.get((c, target), c) if script_of(c) not in ("", target) else c for c in piece))
            else:
                out.append(piece)
        return "".join(out)


_transducer: list[Transducer] = []


def transducer() -> Transducer:
    if not _transducer:
        _transducer.append(Transducer())
    return _transducer[0]


def one_form(text: str | None) -> str | None:
    """The one form of a text; null stays null."""
    return transducer()(text)[0] if text and needs_look([text])[0] else text


def normalize(df: DataFrame, key: str, column: str, only_cases: bool = False, leave_out: Model | None = None) -> DataFrame:
    """``(key, column, is_case BOOLEAN)``: every text in its one form, and whether it held a case.

    With ``only_cases`` just those rows; cases that ``leave_out`` finds garbled are none. Null and empty texts come out as they are and
    are no cases; repeated rows come out repeatedly; other columns of ``df`` are not read; an empty table gives no rows.
    """
    kind = df.schema[key].dataType.simpleString()
    shared = df.sparkSession.sparkContext.broadcast(leave_out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        change, model, memo = transducer(), shared.value, {}
        for batch in batches:
            texts = batch.column(1).to_pylist()
            cases = np.zeros(len(texts), bool)
            for i in np.flatnonzero(needs_look(texts)).tolist():
                if texts[i]:
                    form, case = change(texts[i])
                    if case and not (model and model.garbled(texts[i], memo)):
                        texts[i], cases[i] = form, True
            if only_cases:
                at = pa.array(np.flatnonzero(cases))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), pa.array([texts[i] for i in at.to_pylist()], pa.string()), pa.array(cases[cases])], [key, column, "is_case"])
            else:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(cases)], [key, column, "is_case"])

    return df.select(key, F.col(column)).mapInArrow(run, f"`{key}` {kind}, `{column}` string, is_case boolean")
