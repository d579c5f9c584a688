"""Snowball stemmers for Russian and English, written from their published descriptions, applied to the distinct vocabulary."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# --- Russian ----------------------------------------------------------------------------------------------------------

# The endings of the published Russian stemmer. Those of a first group follow а or я only.
RU_VOWELS = "аеиоуыэюя"
RU_GERUND = ("в вши вшись".split(), "ив ивши ившись ыв ывши ывшись".split())
RU_ADJECTIVE = ([], "ее ие ые ое ими ыми ей ий ый ой ем им ым ом его ого ему ому их ых ую юю ая яя ою ею".split())
RU_PARTICIPLE = ("ем нн вш ющ щ".split(), "ивш ывш ующ".split())
RU_REFLEXIVE = ([], "ся сь".split())
RU_VERB = (
    "ла на ете йте ли й л ем н ло но ет ют ны ть ешь нно".split(),
    "ила ыла ена ейте уйте ите или ыли ей уй ил ыл им ым ен ило ыло ено ят ует уют ит ыт ены ить ыть ишь ую ю".split(),
)
RU_NOUN = ([], "а ев ов ие ье е иями ями ами еи ии и ией ей ой ий й иям ям ием ем ам ом о у ах иях ях ы ь ию ью ю ия ья я".split())
RU_DERIVATIONAL = ([], "ост ость".split())


def _endings(groups: tuple[list[str], list[str]]) -> list[tuple[str, bool]]:
    return sorted([(e, True) for e in groups[0]] + [(e, False) for e in groups[1]], key=lambda x: -len(x[0]))


_RU = {name: _endings(g) for name, g in (("gerund", RU_GERUND), ("adjective", RU_ADJECTIVE), ("participle", RU_PARTICIPLE), ("reflexive", RU_REFLEXIVE), ("verb", RU_VERB), ("noun", RU_NOUN), ("derivational", RU_DERIVATIONAL))}


def _cut_ru(word: str, region: int, name: str) -> str | None:
    """``word`` without its longest ending of the class inside the region, or None."""
    for ending, after_a in _RU[name]:
        if word.endswith(ending) and len(word) - len(ending) >= region:
            stem = word[: -len(ending)]
            if after_a and not (len(stem) > region and stem[-1] in "ая"):
                return None
            return stem
    return None


def _after_vowel_consonant(word: str, start: int, vowels: str) -> int:
    """Where the part begins that follows the first non-vowel after a vowel."""
    for i in range(start + 1, len(word)):
        if word[i] not in vowels and word[i - 1] in vowels:
            return i + 1
    return len(word)


def stem_ru(word: str) -> str:
    word = word.replace("ё", "е")
    rv = next((i + 1 for i, c in enumerate(word) if c in RU_VOWELS), None)
    if rv is None:
        return word
    r2 = _after_vowel_consonant(word, _after_vowel_consonant(word, 0, RU_VOWELS), RU_VOWELS)
    if (cut := _cut_ru(word, rv, "gerund")) is not None:
        word = cut
    else:
        word = _cut_ru(word, rv, "reflexive") or word
        if (cut := _cut_ru(word, rv, "adjective")) is not None:
            again = _cut_ru(cut, rv, "participle")
            word = cut if again is None else again
        else:
            for name in ("verb", "noun"):
                if (cut := _cut_ru(word, rv, name)) is not None:
                    word = cut
                    break
    if word.endswith("и") and len(word) > rv:
        word = word[:-1]
    if (cut := _cut_ru(word, max(r2, rv), "derivational")) is not None:
        word = cut
    for ending in ("ейше", "ейш"):
        if word.endswith(ending) and len(word) - len(ending) >= rv:
            word = word[: -len(ending)]
            return word[:-1] if word.endswith("нн") and len(word) - 2 >= rv else word
    if word.endswith("нн") and len(word) - 2 >= rv or word.endswith("ь") and len(word) > rv:
        word = word[:-1]
    return word


# --- English ----------------------------------------------------------------------------------------------------------

# The word lists and endings of the published English stemmer.
EN_VOWELS = "aeiouy"
EN_SPECIAL = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli",
    "only": "onli", "singly": "singl", **{w: w for w in "sky news howe atlas cosmos bias andes".split()},
}
EN_KEPT = set("inning outing canning herring earring proceed exceed succeed".split())
EN_STEP2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ation": "ate",
    "ator": "ate", "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive",
    "biliti": "ble", "bli": "ble", "ogi": "og", "fulli": "ful", "lessli": "less", "li": "",
}
EN_STEP3 = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": ""}
EN_STEP4 = "al ance ence er ic able ible ant ement ment ent ism ate iti ous ive ize ion".split()


def _regions_en(word: str) -> tuple[int, int]:
    r1 = next((len(p) for p in ("gener", "commun", "arsen") if word.startswith(p)), None)
    if r1 is None:
        r1 = _after_vowel_consonant(word, 0, EN_VOWELS)
    return r1, _after_vowel_consonant(word, r1, EN_VOWELS)


def _short_syllable(word: str) -> bool:
    """Whether ``word`` ends in a short syllable."""
    if len(word) == 2:
        return word[0] in EN_VOWELS and word[1] not in EN_VOWELS
    return len(word) > 2 and word[-1] not in EN_VOWELS + "wxY" and word[-2] in EN_VOWELS and word[-3] not in EN_VOWELS


def _longest(word: str, endings) -> str | None:
    return next((e for e in sorted(endings, key=len, reverse=True) if word.endswith(e)), None)


def stem_en(word: str) -> str:
    if len(word) <= 2:
        return word
    if word in EN_SPECIAL:
        return EN_SPECIAL[word]
    word = word.removeprefix("'")
    word = re.sub(f"^y|(?<=[{EN_VOWELS}])y", "Y", word)
    r1, r2 = _regions_en(word)
    if e := _longest(word, ("'s'", "'s", "'")):
        word = word[: -len(e)]
    # 1a
    if word.endswith("sses"):
        word = word[:-2]
    elif word.endswith(("ied", "ies")):
        word = word[:-2] if len(word) > 4 else word[:-1]
    elif word.endswith("s") and not word.endswith(("us", "ss")) and any(c in EN_VOWELS for c in word[:-2]):
        word = word[:-1]
    if word in EN_KEPT:
        return word
    # 1b
    if e := _longest(word, ("eed", "eedly", "ed", "edly", "ing", "ingly")):
        stem = word[: -len(e)]
        if e.startswith("eed"):
            if len(stem) >= r1:
                word = stem + "ee"
        elif any(c in EN_VOWELS for c in stem):
            word = stem
            if word.endswith(("at", "bl", "iz")):
                word += "e"
            elif len(word) > 1 and word[-1] == word[-2] and word[-1] in "bdfgmnprt":
                word = word[:-1]
            elif r1 >= len(word) and _short_syllable(word):
                word += "e"
    # 1c
    if len(word) > 2 and word[-1] in "yY" and word[-2] not in EN_VOWELS:
        word = word[:-1] + "i"
    # 2
    if (e := _longest(word, EN_STEP2)) and len(word) - len(e) >= r1:
        stem = word[: -len(e)]
        if e == "ogi":
            word = stem + "og" if stem.endswith("l") else word
        elif e == "li":
            word = stem if stem[-1:] and stem[-1] in "cdeghkmnrt" else word
        else:
            word = stem + EN_STEP2[e]
    # 3
    if (e := _longest(word, EN_STEP3)) and len(word) - len(e) >= r1:
        if e != "ative" or len(word) - len(e) >= r2:
            word = word[: -len(e)] + EN_STEP3[e]
    # 4
    if (e := _longest(word, EN_STEP4)) and len(word) - len(e) >= r2:
        if e != "ion" or word[: -len(e)].endswith(("s", "t")):
            word = word[: -len(e)]
    # 5
    if word.endswith("e"):
        if len(word) - 1 >= r2 or len(word) - 1 >= r1 and not _short_syllable(word[:-1]):
            word = word[:-1]
    elif word.endswith("ll") and len(word) - 1 >= r2:
        word = word[:-1]
    return word.replace("Y", "y")


STEMMERS: dict[str, Callable[[str], str]] = {"russian": stem_ru, "english": stem_en}


def stem(word: str, language: str = "russian") -> str:
    """Stem of one lower-case word; the empty word stays."""
    if language not in STEMMERS:
        raise ValueError(f"no stemmer for {language!r}")
    return STEMMERS[language](word) if word else word


def stem_column(col: Column, language: str = "russian") -> Column:
    """Stems of a column of words; use it on distinct words, not on every token."""
    if language not in STEMMERS:
        raise ValueError(f"no stemmer for {language!r}")

    @F.pandas_udf("string")
    def run(words: pd.Series) -> pd.Series:
        known = lru_cache(100_000)(STEMMERS[language])
        return words.map(lambda w: None if w is None else known(w) if w else w)

    return run(col)
