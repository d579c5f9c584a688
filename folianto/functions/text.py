"""The default tokenizer as Spark columns and as Python tables."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# The tokenizer's letters (Cyrillic block, basic Latin, Latin-1 to Latin Extended-B, Greek) and digits.
LETTERS = "Ѐ-ӿA-Za-zÀ-ɏͰ-Ͽ"
DIGITS = "0-9"
WORD = f"[{LETTERS}{DIGITS}]+"
WORD_NO_DIGITS = f"[{LETTERS}]+"

# The capitals that are lowered (Russian, basic Latin, Greek), nothing else.
UPPER = "".join(map(chr, [*range(0x410, 0x430), 0x401, *range(0x41, 0x5B), *(c for c in range(0x391, 0x3AA) if c != 0x3A2)]))
LOWER = "".join(map(chr, [*range(0x430, 0x450), 0x451, *range(0x61, 0x7B), *(c for c in range(0x3B1, 0x3CA) if c != 0x3C2)]))

FOLD = str.maketrans(UPPER + "ё", LOWER.replace("ё", "е") + "е")
WORD_RE = re.compile(WORD)


def fold(col: Column, normalize_yo: bool = True) -> Column:
    """Lower case by the tokenizer's own table; ``ё`` becomes ``е`` if ``normalize_yo``."""
    return F.translate(col, UPPER + "ё", LOWER.replace("ё", "е") + "е") if normalize_yo else F.translate(col, UPPER, LOWER)


def tokens(col: Column, normalize_yo: bool = True, keep_digits: bool = True) -> Column:
    """Array of terms in text order; null and invalid UTF-8 give an empty array."""
    found = F.regexp_extract_all(fold(col, normalize_yo), F.lit(f"({WORD if keep_digits else WORD_NO_DIGITS})"), F.lit(1))
    return F.when(col.isNotNull() & F.is_valid_utf8(col), found).otherwise(F.array().cast("array<string>"))


def py_tokens(text: str | None) -> list[str]:
    """The same terms in Python."""
    return WORD_RE.findall(text.translate(FOLD)) if text else []
