"""Variant spellings of names: metric-space partitioning with exact radius joins.

A name is brought to Latin letters and cut into words. Words that stand beside many others are given names and patronymics; the
rest is what sets the name apart (a surname, or the words of an organisation). These keys live in the metric space of the
Levenshtein distance. A bounded sample of them serves as pivots; each key belongs to the cell of its nearest pivot and is copied
to every cell ``p`` with d(key, p) <= d(key, nearest) + 2 r: by the triangle inequality any two keys within radius r then meet in
the home cell of one of them, where all of them are compared. Names with keys in reach are linked if their other words agree.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folianto.plans.lineage import cut

from .canonical import TRANSLIT_MANY, TRANSLIT_ONE

#: Radius of the join; most pivots; keys for each pivot; most given names and patronymics that are told by their frequency.
RADIUS, MOST_PIVOTS, KEYS_PER_PIVOT, MOST_COMMON = 2, 1024, 8, 20_000
#: A word beside at least so many different keys is a given name or patronymic.
COMMON_BESIDE = 6

# Words of organisations, and marks that name no one.
ORGANISATION = ("издательство", "издво", "изд", "издат", "издательский", "дом", "ид", "ооо", "зао", "оао", "ао", "publishing", "publisher", "publishers", "press", "house", "ltd", "inc", "llc", "co", "books", "verlag", "éditions", "editions")
NOBODY = re.compile(r"неизв|не указан|без автор|аноним|коллектив|unknown|anonym|no author|various|^[бн]/?[аy]$|^n/?a$|^none$|^null$|^авторы?$|^author$|^-+$|не установлен|нет автора", re.I)

_TO_LATIN = str.maketrans({**TRANSLIT_MANY, **dict(zip(TRANSLIT_ONE[0][: len(TRANSLIT_ONE[1])], TRANSLIT_ONE[1])), "ъ": "", "ь": ""})
_PIECE = re.compile(r"[^\W\d_]+")


def names_no_one(value: str | None) -> bool:
    """Null, blank and marks such as "unknown author"."""
    text = (value or "").strip()
    return not _PIECE.search(text) or bool(NOBODY.search(text))


def latin(word: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", word.translate(_TO_LATIN)) if not unicodedata.combining(c))


def words_of(value: str) -> tuple[list[str], list[str], bool]:
    """Words in Latin letters, first letters as typed, and whether the name is an organisation's."""
    low = re.sub(r"изд-во", "издво", value.lower())
    found = _PIECE.findall(low)
    kept = [w for w in found if w not in ORGANISATION]
    organisation = len(kept) < len(found) and bool(kept)
    kept = kept if organisation else found
    return [latin(w) for w in kept], [w[0] for w in kept], organisation


def typos(a: str, b: str, most: int) -> int:
    """Edits between two words, a swap of neighbours counting one; ``most + 1`` if there are more."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most:
        return most + 1
    before2, before = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            v = min(before[j] + 1, now[j - 1] + 1, before[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                v = min(v, before2[j - 2] + 1)
            now.append(v)
        if min(now) > most:
            return most + 1
        before2, before = before, now
    return min(before[-1], most + 1)


def distances(word: str, codes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Levenshtein distances of a word to many, given as rows of code points."""
    width = codes.shape[1]
    steps = np.arange(width + 1)
    row = np.broadcast_to(steps, (len(codes), width + 1))
    for i, ch in enumerate(word, 1):
        best = np.minimum(row[:, 1:] + 1, row[:, :-1] + (codes != ord(ch)))
        best = np.concatenate([np.full((len(codes), 1), i), best], axis=1) - steps
        row = np.minimum.accumulate(best, axis=1) + steps
    return row[np.arange(len(codes)), lengths]


def as_codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.array([len(w) for w in words], np.int64)
    codes = np.zeros((len(words), max(1, int(lengths.max()) if len(words) else 1)), np.int64)
    for k, w in enumerate(words):
        codes[k, : len(w)] = [ord(c) for c in w]
    return codes, lengths


class Lexicon:
    """Given names and patronymics: words, everyday forms, and the nearest of them to a misspelt word."""

    def __init__(self, common: dict[str, int], short: dict[str, str]):
        self.common, self.short = common, short
        self.order = sorted(common, key=lambda w: (-common[w], w))
        self.codes, self.lengths = as_codes(self.order)
        self.memo: dict[str, tuple[str | None, int]] = {}

    def nearest(self, word: str) -> tuple[str | None, int]:
        """The common word a long word stands for, and the typos between them (at most 2)."""
        if word in self.common or word in self.short:
            return word, 0
        if len(word) < 3 or not self.order:
            return None, 9
        if word not in self.memo:
            if len(self.memo) > 200_000:
                self.memo.clear()
            near = np.flatnonzero(distances(word, self.codes, self.lengths) <= 4)
            most = 2 if len(word) > 4 else 1
            best = min(((typos(word, self.order[k], most), k) for k in near.tolist()), default=(9, 0))
            self.memo[word] = (self.order[best[1]], best[0]) if best[0] <= most else (None, 9)
        return self.memo[word]


def parse(value: str, lexicon: Lexicon) -> tuple[str, list[str], list[str], bool] | None:
    """Key, other words in order (initials or given names, misspellings undone), their first letters as typed, organisation."""
    words, firsts, organisation = words_of(value)
    if not words:
        return None
    if organisation:
        return "".join(sorted(words, key=lambda w: (-len(w), w))) if len(words) == 1 else " ".join(sorted(words)), [], [], True
    long = [k for k, w in enumerate(words) if len(w) > 3]
    rare = {k: lexicon.nearest(words[k])[1] for k in long}
    if not long:
        return " ".join(sorted(words)), [], [], True
    far = [k for k in long if rare[k] > 2]
    if len(far) > 1 and len(far) == len(words):
        return " ".join(sorted(words)), [], [], True  # an organisation without its word
    # the word that is farthest from all common words; between equals one at either end of the name, the longest
    at = max(far or long, key=lambda k: (rare[k], words[k] not in lexicon.common, k in (0, len(words) - 1), len(words[k])))
    rest, first = [], []
    for k, w in enumerate(words):
        if k != at:
            near = lexicon.nearest(w)[0] if len(w) > 2 else None
            w = near or w
            rest.append(lexicon.short.get(w, w))
            first.append(firsts[k] if w not in lexicon.short else lexicon.short[w][0])
    return words[at], rest, first, False


def agree(rest_a: list[str], first_a: list[str], rest_b: list[str], first_b: list[str]) -> bool:
    """Given name with given name, patronymic with patronymic: equal, an initial of it, or misspelt. What is left out agrees."""
    for x, fx, y, fy in zip(rest_a, first_a, rest_b, first_b):
        if x == y:
            continue
        short_x, short_y = len(x) <= 2, len(y) <= 2
        if short_x or short_y:
            cyrillic = fx > "Ѐ" and fy > "Ѐ"
            if not (fx == fy if cyrillic else x.startswith(y) or y.startswith(x)):
                return False
        elif typos(x, y, 1) > 1 or min(len(x), len(y)) < 5:
            return False
    return True


def learn(values: DataFrame, column: str, given_names: DataFrame) -> Lexicon:
    """Common words of the names and everyday forms of given names.

    A word is common by the number of different words it stands beside; at most ``MOST_COMMON`` come to the driver. Everyday forms
    that ``given_names`` lacks are learned: a form stands for a given name if that is the one most of its surnames also have.
    """

    def beside(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for value in pdf[column]:
                if not names_no_one(value):
                    words, _, organisation = words_of(value)
                    long = [w for w in dict.fromkeys(words) if len(w) > 2]
                    if not organisation:
                        rows += [(a, b) for a in long for b in long if a != b]
            yield pd.DataFrame(rows, columns=["word", "other"])

    co = cut(values.select(column).distinct().mapInPandas(beside, "word string, other string").groupBy("word", "other").agg(F.count("*").alias("n")))
    common = co.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= COMMON_BESIDE)
    common = {r.word: r.n for r in common.orderBy(F.desc("n"), "word").limit(MOST_COMMON).collect()}
    # a surname many of whose words are rare misspellings is no given name: at least half of what stands beside must not be common
    named = co.filter(F.col("word").isin(list(common))).withColumn("is_common", F.col("other").isin(list(common)))
    share = named.groupBy("word").agg(F.sum(F.when(F.col("is_common"), 0).otherwise(1)).alias("free"), F.count("*").alias("n"))
    common = {r.word: r.free for r in share.filter((F.col("free") >= COMMON_BESIDE) & (F.col("free") * 3 >= F.col("n"))).collect()}
    short = {latin(r.short_name.lower()): latin(r.full_name.lower()) for r in given_names.filter("short_name is not null and full_name is not null").collect()}
    short = {a: b for a, b in short.items() if a != b}
    known = Counter(dict.fromkeys({*short, *short.values()}, 1))
    common = dict(known | Counter(common))
    # learned forms: surname -> given names beside it
    pairs = co.filter(F.col("word").isin(list(common)) & ~F.col("other").isin(list(common))).select("other", "word")
    patronymic = ("ovich", "evich", "ich", "ovna", "evna", "ichna")
    a, b = pairs.filter(~F.col("word").isin(list(short))), pairs.select("other", F.col("word").alias("full"))
    seen = a.groupBy("word").agg(F.count("*").alias("surnames"))
    both = a.join(b, "other").filter("word <> full").groupBy("word", "full").agg(F.count("*").alias("n")).join(seen, "word")
    votes: dict[str, list] = defaultdict(list)
    for r in both.filter("n * 2 >= surnames and n >= 2").collect():
        votes[r.word].append((r.n, r.full, r.surnames))
    full_names = {b for b in short.values()}
    for word, found in votes.items():
        if word in full_names or word.endswith(patronymic) or len(word) > 8:
            continue
        found = [(n, f) for n, f, _ in found if not f.endswith(patronymic) and len(f) > len(word) - 1 and common.get(f, 0) > common[word]]
        if found:
            n, full = max(found)
            n2 = max((m for m, f in found if f != full), default=0)
            surnames = votes[word][0][2]
            if n * 4 >= surnames * 3 and n2 * 2 < n:
                short[word] = full
    # a form may lead to another form
    for word in list(short):
        if short[word] in short and short[short[word]] != word:
            short[word] = short[short[word]]
    return Lexicon(common, short)


def dealt(df: DataFrame, column: str) -> DataFrame:
    """``df`` dealt out to a fixed number of tasks: few bytes, but much work for each row.

    By a hash of the column: a frame whose rows were made distinct lies by the column itself already, and that exchange would be taken out.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.xxhash64(column))


def radius_join(keys: DataFrame, radius: int = RADIUS, most_pivots: int = MOST_PIVOTS) -> DataFrame:
    """``(key_a, key_b)`` of all different keys within ``radius`` edits, each pair once, ``key_a`` < ``key_b``.

    ``keys`` has one column ``key`` without repeats. The pivots are a bounded sample by hash; each key's distances to them are
    worked out in one pass, without a join.
    """
    n = keys.count()
    pivots = [r.key for r in keys.orderBy(F.xxhash64("key"), "key").limit(max(1, min(most_pivots, n // KEYS_PER_PIVOT))).collect()]
    shared = keys.sparkSession.sparkContext.broadcast(pivots)

    def cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codes, lengths = as_codes(shared.value)
        for pdf in batches:
            keys, cell, home, far = [], [], [], []
            for key in pdf["key"]:
                d = distances(key, codes, lengths)
                nearest = int(d.argmin())
                reach = np.flatnonzero(d <= d[nearest] + 2 * radius)
                keys += [key] * len(reach)
                cell += reach.tolist()
                home += (reach == nearest).tolist()
                far += d[reach].tolist()
            yield pd.DataFrame({"key": keys, "cell": cell, "home": home, "d": far})

    # written, as a plan's estimate knows nothing of the copies
    placed = cut(dealt(keys, "key").mapInPandas(cells, "key string, cell int, home boolean, d int"))
    a = placed.filter("home").select("cell", F.col("key").alias("key_a"), F.col("d").alias("d_a"))
    b = placed.select("cell", F.col("key").alias("key_b"), F.col("d").alias("d_b"))
    met = a.join(b, "cell").filter((F.col("key_a") != F.col("key_b")) & (F.abs(F.col("d_a") - F.col("d_b")) <= radius))
    near = met.filter(F.levenshtein("key_a", "key_b", radius) >= 0)
    return near.select(F.least("key_a", "key_b").alias("key_a"), F.greatest("key_a", "key_b").alias("key_b")).distinct()


def link_names(values: DataFrame, column: str, given_names: DataFrame) -> DataFrame:
    """``(author_a, author_b)``: pairs of different stored values that name the same person or organisation, the smaller first.

    Null, blank and "nobody" marks link to nothing; repeated rows count once; an empty table gives no rows; other columns are
    not read. What a name leaves out agrees with anything: a bare surname or initials are linked to every fuller name in reach
    that they fit, also where those are namesakes.
    """
    values = cut(values.select(F.col(column).alias("value")).filter(F.trim("value") != "").distinct())
    lexicon = learn(values, "value", given_names)
    shared = values.sparkSession.sparkContext.broadcast(lexicon)

    def parsed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lexicon = shared.value
        for pdf in batches:
            rows = []
            for value in pdf["value"]:
                if not names_no_one(value) and (p := parse(value, lexicon)):
                    rows.append((value, *p))
            yield pd.DataFrame(rows, columns=["value", "key", "rest", "first", "organisation"])

    names = cut(dealt(values, "value").mapInPandas(parsed, "value string, key string, rest array<string>, first array<string>, organisation boolean"))
    keys = names.select("key").distinct()
    near = cut(radius_join(keys))
    # two misspellings of one key may be farther from each other than either is from it
    both = near.unionByName(near.select(F.col("key_b").alias("key_a"), F.col("key_a").alias("key_b")))
    over = both.select(F.col("key_a").alias("middle"), F.col("key_b").alias("x")).join(both.select(F.col("key_a").alias("middle"), F.col("key_b").alias("y")), "middle")
    over = over.filter((F.col("x") < F.col("y")) & (F.levenshtein("x", "y", 2 * RADIUS) > RADIUS)).select(F.col("x").alias("key_a"), F.col("y").alias("key_b")).distinct()
    near = near.unionByName(over).unionByName(keys.select(F.col("key").alias("key_a"), F.col("key").alias("key_b")))
    a, b = (names.select(*(F.col(c).alias(f"{c}_{x}") for c in names.columns)) for x in "ab")
    met = near.join(a, "key_a").join(b, "key_b").filter((F.col("key_a") < F.col("key_b")) | (F.col("value_a") < F.col("value_b")))
    met = met.filter(F.col("organisation_a") == F.col("organisation_b"))

    @F.pandas_udf("boolean")
    def same(key_a: pd.Series, key_b: pd.Series, ra: pd.Series, fa: pd.Series, rb: pd.Series, fb: pd.Series) -> pd.Series:
        out = []
        for ka, kb, x, fx, y, fy in zip(key_a, key_b, ra, fa, rb, fb):
            shortest = min(len(ka), len(kb))
            most = 3 if shortest >= 9 and len(x) and len(y) else 2 if shortest >= 8 else 1
            out.append(typos(ka, kb, most) <= most and agree(list(x), list(fx), list(y), list(fy)))
        return pd.Series(out)

    linked = met.filter(same("key_a", "key_b", "rest_a", "first_a", "rest_b", "first_b"))
    return linked.select(F.least("value_a", "value_b").alias("author_a"), F.greatest("value_a", "value_b").alias("author_b")).distinct()
