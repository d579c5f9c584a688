"""Garbled text from wrong character encodings: found, and restored where nothing was lost.

1. A character bigram model of the clean text is counted over all records.
2. Lines that look odd are joined with clean lines that have the same text without its non-ASCII characters. Their
   non-ASCII runs are aligned one to one, and every transformation (a wrong decoding to undo, once or twice) that turns a garbled
   run into its clean twin gets a vote.
3. The learned transformations, weighted by their votes, are applied to all odd records. A record is garbled if undoing one
   makes its words so much likelier that chance can't explain it.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import cache, lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folianto.plans.lineage import cut
from folianto.plans.sizes import broadcast_if_small, spread

from .filters import hash_filter, passing

# Encodings a text may have been written in, and those it may have been read in.
WRITTEN = ("utf-8", "cp1251", "koi8-r", "cp866", "mac-cyrillic", "iso8859-5", "cp1252")
READ = ("latin-1", "cp1252", "cp1251", "koi8-r", "cp866", "cp437", "cp850", "mac-cyrillic", "mac-roman", "iso8859-5")
TWICE = ("cp1252", "cp1251", "latin-1")
# The characters of ordinary Russian, English, German and French text.
PLAIN = "ЁёÀÂÄÆÇÈÉÊËÎÏÔÖŒÙÛÜàâäæçèéêëîïôöœùûüß…—–«»“”„‘’№"

#: Natural log of the odds a record must reach if a word that tells holds a character that isn't plain, or else odd capitals or two scripts, or else plain letters only; votes that count as none; shortest text left for a twin.
LEAST, UNSEEN, TWIN_LENGTH = (4.5, 14.0, 20.0), -6.0, 12
#: Mean log probability of a character below which a text is looked at word by word.
UNLIKELY = -3.6
#: Most bigrams kept in the model.
MOST_BIGRAMS = 60_000

_TOKEN = re.compile("[^ \t\r\n\u2000-\u200a\u202f\u3000]+")  # blanks that no encoding here has
#: What a word may begin or end with besides its letters.
_EDGES = " !\"#$%&'()*+,-./:;<=>?@[]_{|}~"
_LETTERS = re.compile(r"[^\W\d_]+")
#: A word with a character that isn't plain: the only ones that can tell in a text whose plain letters follow as usual.
_STRANGE = re.compile(f"[^ \t\r\n]*[^\x00-\x7fА-Яа-я{PLAIN} \t\r\n][^ \t\r\n]*")
_NON_ASCII = re.compile(r"[^\x00-\x7f]+")


def transformations() -> list[tuple[tuple[str, str], ...]]:
    """Each is a chain of (read in, written in), to be undone from left to right."""
    once = [((r, w),) for w in WRITTEN for r in READ if r != w and not (w == "cp1252" and r == "latin-1")]
    return once + [((a, "utf-8"), (b, "utf-8")) for a in TWICE for b in TWICE]


@cache
def _bytes_of(encoding: str) -> dict[int, int]:
    """Code point to byte; bytes without a character stand for the control character of the same number."""
    table = {}
    for b in range(128, 256):
        try:
            table[ord(bytes([b]).decode(encoding))] = b
        except UnicodeDecodeError:
            table[b] = b
    return table


@cache
def _readable(encoding: str) -> frozenset[str]:
    return frozenset(map(chr, _bytes_of(encoding)))


@cache
def _as_bytes(encoding: str) -> dict[int, str]:
    """Code point to the character of Latin-1 that has its byte."""
    return {c: chr(b) for c, b in _bytes_of(encoding).items()} | {0xFFFD: "\xff"}


@cache
def _to_char(read: str, written: str) -> dict[int, str]:
    """For one-byte encodings: garbled to original character; what ``written`` lacks becomes U+FFFE."""
    out = {}
    for code, b in _bytes_of(read).items():
        try:
            out[code] = bytes([b]).decode(written)
        except UnicodeDecodeError:
            out[code] = "\ufffe"
    return out


def undo(text: str, chain: tuple[tuple[str, str], ...]) -> str | None:
    """The text before ``chain``, or None if it can't be. U+FFFD stands for what was lost."""
    for read, written in chain:
        high = {c for c in text if c > "\x7f"}
        gone = "�" in high
        high.discard("�")
        if not high <= _readable(read):
            return None
        if written == "utf-8":
            raw = text.translate(_as_bytes(read)).encode("latin-1")
            if not gone:
                try:
                    text = raw.decode("utf-8")
                except UnicodeDecodeError:
                    return None
            else:
                back = raw.decode("utf-8", "replace")
                if back.count("�") > 2 * text.count("�") + 1:
                    return None
                text = re.sub("�+", "�", back)
        else:
            text = text.translate(_to_char(read, written))
            if "\ufffe" in text:
                return None
    return text


@lru_cache(100_000)
def _least(token: str) -> float:
    odd, mixed = oddities([token])
    return LEAST[0] if odd[0] else LEAST[1] if mixed[0] else LEAST[2]


# Letters of Greek, Cyrillic and Latin that look alike, as one; only to tell look-alikes from wrong encodings.
_LOOK = str.maketrans("аеорсухіјѕАВЕКМНОРСТХІЈЅαοργνικΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "aeopcyxijsABEKMHOPCTXIJSaopyvikABEZHIKMNOPTYX")
_TO_CYRILLIC = str.maketrans("aeopcyxABEKMHOPCTXαορκΑΒΕΚΜΗΟΡΤΧ", "аеорсухАВЕКМНОРСТХаоркАВЕКМНОРТХ")


_UNSEEN = re.compile("[\xad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180e\u200b-\u200f\u202a-\u202e\u2060-\u206f\ufeff]+")


def _usual(token: str) -> str:
    """Presentation forms, odd blanks and invisible characters replaced: what is odd about them is no wrong encoding."""
    return unicodedata.normalize("NFKC", _UNSEEN.sub("", token)) if not token.isascii() else token


@dataclass
class Model:
    """Bigram log probabilities of lower-case text and the log weight of each transformation."""

    pairs: dict[str, float] = field(default_factory=dict)
    single: dict[str, float] = field(default_factory=dict)
    rest: dict[str, float] = field(default_factory=dict)
    weights: dict[tuple[tuple[str, str], ...], float] = field(default_factory=dict)
    floor: float = -16.0
    table: np.ndarray | None = None

    @classmethod
    def from_counts(cls, counts: dict[str, int], alpha: float = 4.0) -> Model:
        first, second = defaultdict(int), defaultdict(int)
        for pair, n in counts.items():
            first[pair[0]] += n
            second[pair[1]] += n
        total = sum(second.values()) or 1
        single = {c: math.log((n + 0.1) / (total + 1000)) for c, n in second.items()}
        rest = {c: math.log(alpha / (n + alpha)) for c, n in first.items()}
        pairs = {p: math.log((n + alpha * math.exp(single[p[1]])) / (first[p[0]] + alpha)) for p, n in counts.items()}
        return cls(pairs, single, rest, {}, math.log(0.1 / (total + 1000)))

    def suspects(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """``oddities``, counting also texts whose characters follow each other as in no clean text (all in small letters, say)."""
        odd, mixed = oddities(texts)
        if not texts:
            return odd, mixed
        if self.table is None:
            n = len(_CHARS)
            one = np.array([self.single.get(c, self.floor) for c in _CHARS], np.float32)
            self.table = (np.array([self.rest.get(c, 0.0) for c in _CHARS], np.float32)[:, None] + one[None, :]).ravel()
            at = {c: k for k, c in enumerate(_CHARS)}
            for pair, p in self.pairs.items():
                self.table[at[pair[0]] * n + at[pair[1]]] = p
        text, starts = _joined(texts)
        ids = _IDS[np.minimum(np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32), 0xFFFF)]
        values = np.empty(len(ids), np.float32)
        values[0], values[1:] = 0, self.table[ids[:-1] * len(_CHARS) + ids[1:]]
        lengths = np.diff(np.append(starts, len(ids)))
        low = (np.add.reduceat(values, starts) < UNLIKELY * lengths) & (lengths > 3)
        return odd, mixed + low

    def score(self, token: str) -> float:
        """Log likelihood of a token between blanks, with a cost for capitals in odd places; U+FFFD is neutral."""
        low = token.lower()
        if len(low) != len(token):
            low = token
        total, before, pairs, single, rest, floor = 0.0, " ", self.pairs, self.single, self.rest, self.floor
        for ch in low:
            if ch == "�" or before == "�":
                total -= 3.0
            else:
                p = pairs.get(before + ch)
                total += p if p is not None else rest.get(before, 0.0) + single.get(ch, floor)
            before = ch
        if token != low:
            for word in _LETTERS.findall(token):
                if word[1:].islower() or len(word) == 1:
                    total -= 0.0 if word.islower() else 1.5
                elif word.isupper():
                    total -= 4.0
                elif not word.islower():
                    total -= 9.0
        return total

    def token_gains(self, token: str) -> list[tuple[tuple, float]]:
        """For each transformation that can be undone: how much likelier the token becomes."""
        high = {c for c in token if c > "\x7f" and c != "�"}
        base = self.score(token)
        if base > -3.2 * (len(token) + 1):  # an ordinary word
            return []
        usual = _usual(token)
        for form in (usual, usual.translate(_LOOK), usual.translate(_TO_CYRILLIC)):
            base = max(base, self.score(form))
            if base > -3.2 * (len(usual) + 1):  # ordinary but for blanks, widths and look-alikes
                return []
        out, fits = [], {r: high <= _readable(r) for r in READ}
        for chain in self.weights:
            if not fits[chain[0][0]]:
                continue
            back = undo(token, chain)
            if back is not None and back != token:
                gain = self.score(back) - base
                if gain > -2.0:
                    out.append((chain, gain))
        return out

    def judge(self, text: str, memo: dict, enough: float = math.inf, mixed: bool = True) -> tuple[tuple | None, float]:
        """The likeliest transformation of a record and its log odds; None if no one is likely enough.

        Words only add to the odds: where it is asked only whether a record is garbled, reading stops at ``enough``. ``mixed`` is false for
        a text without odd capitals and mixed scripts.
        """
        sums: dict[tuple, float] = defaultdict(float)
        need: dict[tuple, float] = {}
        best, most = None, 0.0
        for token in set((_TOKEN if mixed else _STRANGE).findall(text)):  # what is repeated is no further evidence
            if token.isascii():
                continue
            token = token.strip(_EDGES)
            gains = memo.get(token)
            if gains is None:
                if len(memo) > 100_000:
                    memo.clear()
                gains = memo[token] = self.token_gains(token)
            for chain, gain in gains:
                if gain > 0.0:
                    sums[chain] += gain
                    if gain >= 3.0:
                        need[chain] = min(need.get(chain, LEAST[2]), _least(token))
                    total = sums[chain] + self.weights[chain]
                    if total >= need.get(chain, LEAST[2]):
                        if total > most:
                            best, most = chain, total
                        if total >= enough:
                            return best, most
        return best, most if best else max((n + self.weights[c] for c, n in sums.items()), default=0.0)

    def garbled(self, text: str, memo: dict, mixed: bool = True) -> bool:
        return self.judge(text, memo, 0.0, mixed)[0] is not None

    def restore(self, text: str, chain: tuple, memo: dict) -> tuple[str, bool]:
        """The text undone: as a whole if nearly all its long words call for ``chain``, else word by word. False if something was lost."""
        tokens = [t.strip(_EDGES) for t in _TOKEN.findall(text) if not t.isascii()]
        gains = {t: memo.get(t) or self.token_gains(t) for t in set(tokens)}
        long = [t for t in tokens if len(t) > 3]
        agree = sum(any(c == chain and g > 0 for c, g in gains[t]) for t in long)
        whole = undo(text, chain) if agree >= 0.9 * len(long) else None
        if whole is None:

            def fix(m: re.Match) -> str:
                good = [(g + self.weights[c] / 4 + 8 * (c == chain), c) for c, g in gains.get(m.group().strip(_EDGES), ()) if g > 3.0]
                return undo(m.group(), max(good)[1]) if good else m.group()

            whole = _TOKEN.sub(fix, text)
        return whole, "�" not in whole


# --- counting -----------------------------------------------------------------------------------------------------------

_BLOCKS = ((0x20, 0x180), (0x370, 0x500), (0x2000, 0x2070), (0x2100, 0x2150), (0x2190, 0x2300), (0x2500, 0x25C0))
_CHARS = [" ", *(chr(c) for low, high in _BLOCKS for c in range(low, high) if c != 0x20)]
_IDS = np.zeros(0x10000, np.int32)
_IDS[[ord(c) for c in _CHARS]] = np.arange(len(_CHARS))
_LOWER = np.array([ord(chr(c).lower()) if len(chr(c).lower()) == 1 and not 0xD800 <= c < 0xE000 and ord(chr(c).lower()) < 0x10000 else c for c in range(0x10000)], np.int32)
_IDS = _IDS[_LOWER]


# Classes of characters: bit 1 plain, 2 small Cyrillic, 4 capital Cyrillic, 8 Latin letter.
_CLASS = np.zeros(0x10001, np.uint8)
_CLASS[0:0x80] |= 1
_CLASS[0x410:0x450] |= 1
_CLASS[[ord(c) for c in PLAIN]] |= 1
_CLASS[[*range(0x430, 0x450), 0x451]] |= 2
_CLASS[[*range(0x410, 0x430), 0x401]] |= 4
_CLASS[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] |= 8


def _joined(texts: list[str | None]) -> tuple[str, np.ndarray]:
    """The texts, a line end after each, and where each starts."""
    starts = np.cumsum([0] + [len(t or "") + 1 for t in texts[:-1]]) if texts else np.zeros(0, np.int64)
    return "\n".join(t or "" for t in texts) + "\n", starts


def oddities(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """For each text: its characters that aren't plain, and its letters that follow oddly (a capital inside a word, four
    capitals in a row, two scripts in a word)."""
    if not texts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    text, starts = _joined(texts)
    codes = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    kind = _CLASS[np.minimum(codes, 0x10000)]
    now, after = kind[:-1], kind[1:]
    odd = np.zeros(len(kind), np.uint8)
    odd[:-1] = ((now & 2) > 0) & ((after & 4) > 0)
    odd[:-1] |= (((now & 6) > 0) & ((after & 8) > 0)) | (((now & 8) > 0) & ((after & 6) > 0))
    cap = (kind & 4) > 0
    odd[:-3] |= cap[:-3] & cap[1:-2] & cap[2:-1] & cap[3:]
    return np.add.reduceat((kind & 1) == 0, starts, dtype=np.int64), np.add.reduceat(odd, starts, dtype=np.int64)


_BREAK = re.compile("\r\n|\r|\n")


def _skeleton(line: str) -> int | None:
    """A hash of the line's text without non-ASCII characters, if enough of it is left."""
    rest = line.encode("ascii", "ignore")
    return xxhash.xxh64_intdigest(rest) - (1 << 63) if len(rest) >= TWIN_LENGTH and len(rest) < len(line) else None


def _runs(line: str, measure) -> int:
    """A hash of the lengths of the line's non-ASCII runs."""
    return xxhash.xxh64_intdigest(np.array([measure(x) for x in _NON_ASCII.findall(line)], np.int64).tobytes()) - (1 << 63)


def _utf8(run: str) -> int:
    return len(run.encode("utf-8", "replace"))


def _utf8_twice(run: str) -> int:
    """The length of UTF-8 read as one-byte characters and written as UTF-8 again: bytes from 0x80 on take two."""
    return 2 * _utf8(run)


def _survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bigrams of the clean texts (at most two characters that aren't plain, no odd capitals) and the odd lines of the others."""
    n = len(_CHARS)
    total = np.zeros(n * n, np.int64)
    for batch in batches:
        texts = batch.column(0).to_pylist()
        odd, mixed = oddities(texts)
        text = " ".join(t for t, o, m in zip(texts, odd, mixed) if t and o <= 2 and not m)
        for start in range(0, len(text), 4_000_000):
            codes = np.frombuffer(text[start : start + 4_000_001].encode("utf-32-le", "replace"), np.uint32)
            ids = _IDS[np.minimum(codes, 0xFFFF)]
            if len(ids) > 1:
                total += np.bincount(ids[:-1] * n + ids[1:], minlength=n * n)
        lines = [x for i in np.flatnonzero(odd + mixed).tolist() for x in _BREAK.split(texts[i])]
        odd, mixed = oddities(lines)
        found = [(h, lines[i]) for i in np.flatnonzero(odd + mixed).tolist() if (h := _skeleton(lines[i])) is not None]
        if found:
            hashes, lines = zip(*found)
            yield pa.RecordBatch.from_arrays([pa.array(hashes, pa.int64()), pa.array(lines, pa.string()), pa.nulls(len(found), pa.int64())], ["h", "value", "n"])
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.nulls(len(at), pa.int64()), pa.array([_CHARS[i // n] + _CHARS[i % n] for i in at], pa.string()), pa.array(total[at], pa.int64())], ["h", "value", "n"])


def _clean_lines(shared) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Clean lines whose rest without other letters passes the filter of odd lines, by the lengths of runs they may have been garbled to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines = [x for t in batch.column(0).to_pylist() if t for x in _BREAK.split(t)]
            odd, mixed = oddities(lines)
            found = [(h, lines[i]) for i in np.flatnonzero((odd + mixed) == 0).tolist() if (h := _skeleton(lines[i])) is not None]
            kept = passing(shared.value, np.array([h for h, _ in found], np.int64).view(np.uint64)).tolist() if found else []
            # a one-byte encoding keeps the runs' lengths, UTF-8 read as single bytes has as many characters as bytes
            rows = [(h, _runs(x, m), x) for h, x in (found[i] for i in kept) for m in (len, _utf8, _utf8_twice)]
            hashes, runs, lines = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(hashes, pa.int64()), pa.array(runs, pa.int64()), pa.array(lines, pa.string())], ["h", "runs", "line"])

    return run


def _votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Align the non-ASCII runs of each garbled line with those of its clean twin."""
    chains, found = transformations(), defaultdict(int)
    memo: dict[tuple[str, str], list[int]] = {}

    def fitting(run: tuple[str, str]) -> list[int]:
        if run not in memo:
            if len(memo) > 100_000:
                memo.clear()
            memo[run] = [k for k, chain in enumerate(chains) if undo(run[0], chain) == run[1]]
        return memo[run]

    for batch in batches:
        for bad, good in zip(*(c.to_pylist() for c in batch.columns[:2])):
            if any((x := oddities([good]))[0]) or any(x[1]):
                continue
            a, b = _NON_ASCII.findall(bad), _NON_ASCII.findall(good)
            if len(a) != len(b) or a == b:
                continue
            runs = list(dict.fromkeys((x, y) for x, y in zip(a, b) if x != y))
            for k, right in Counter(k for run in runs for k in fitting(run)).items():
                found[k] += right >= 0.8 * len(runs)  # at least 80 % must come right
    yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int32()), pa.array([int(n) for n in found.values()], pa.int64())], ["chain", "n"])


def fit(texts: DataFrame, column: str, keyed: DataFrame | None = None) -> Model:
    """Count the model over ``texts`` and learn the transformations from twins.

    ``texts`` holds every text of the fields in ``column``; ``keyed`` may hold further pairs ``(bad, good)`` known to be the same
    record. To the driver come at most ``MOST_BIGRAMS`` bigrams and one count for each transformation.
    """
    texts = texts.select(F.col(column).alias("t")).filter("t is not null")
    survey = cut(texts.mapInArrow(_survey, "h long, value string, n long"))
    counts = survey.filter("h is null").groupBy("value").agg(F.sum("n").alias("n"))
    counts = {r["value"]: r.n for r in counts.orderBy(F.desc("n"), "value").limit(MOST_BIGRAMS).collect()}
    model = Model.from_counts(counts)

    runs = F.udf(lambda line: _runs(line, len), "long", useArrow=True)
    bad = survey.filter("h is not null").select("h", F.col("value").alias("bad")).distinct().withColumn("runs", runs("bad"))
    bad = cut(bad)
    keys = broadcast_if_small(bad.select("h", "runs").distinct())
    # every clean line with the same text around runs of the same lengths is a twin; equal lines count once
    wanted = texts.sparkSession.sparkContext.broadcast(hash_filter(bad.select("h"), bad.count()))
    good = texts.mapInArrow(_clean_lines(wanted), "h long, runs long, line string").join(keys, ["h", "runs"], "left_semi").distinct()
    pairs = bad.join(good, ["h", "runs"]).select("bad", F.col("line").alias("good"))
    if keyed is not None:
        pairs = pairs.unionByName(keyed.select("bad", "good"))
    votes = {r.chain: r.n for r in pairs.mapInArrow(_votes, "chain int, n long").groupBy("chain").agg(F.sum("n").alias("n")).collect()}
    model.votes = {c: votes.get(k, 0) for k, c in enumerate(transformations())}
    total = sum(votes.values())
    # what no twin has shown isn't looked for; a collection without any twin has nothing to learn from, so all compete as equals
    model.weights = {c: math.log((n + 0.01) / (total + 1.0)) if n else UNSEEN for c, n in model.votes.items() if n or not total}
    return model


def detect(df: DataFrame, key: str, column: str, model: Model, restored: bool = False) -> DataFrame:
    """``(key, chain, log_odds[, restored])`` of the garbled records of ``df``.

    Without ``restored`` a record is read only until it is sure that it is garbled. ``chain`` names the wrong decoding, as ``utf-8>cp1251``. ``restored`` is the text with every word undone, null where
    something was lost. Null, empty and plain texts are no cases; repeated rows come out repeatedly;
    other columns of ``df`` are not read; an empty table gives no rows.
    """
    kind = df.schema[key].dataType.simpleString()
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict = {}
        model = shared.value
        for batch in batches:
            rows, chains, odds, backs = [], [], [], []
            texts = batch.column(1).to_pylist()
            odd, mixed = model.suspects(texts)
            for i in np.flatnonzero(odd + mixed).tolist():
                text = texts[i]
                chain, total = model.judge(text, memo, math.inf if restored else 0.0, bool(mixed[i]))
                if chain is not None:
                    rows.append(i)
                    chains.append(" ".join(f"{w}>{r}" for r, w in chain))
                    odds.append(total)
                    if restored:
                        back, whole = model.restore(text, chain, memo)
                        backs.append(back if whole else None)
            out = [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(chains, pa.string()), pa.array(odds, pa.float64())]
            yield pa.RecordBatch.from_arrays(out + ([pa.array(backs, pa.string())] if restored else []), [key, "chain", "log_odds"] + (["restored"] if restored else []))

    schema = f"`{key}` {kind}, chain string, log_odds double" + (", restored string" if restored else "")
    return df.select(key, column).filter(F.length(column) > 0).mapInArrow(run, schema)


def library_model(spark: SparkSession, d: str) -> Model:
    """The model of a library's chunks, titles and authors; titles also meet the title in their file's name."""
    chunks, books = (spread(spark.read.parquet(f"{d}/{t}.parquet")) for t in ("chunks", "books"))
    texts = chunks.select("content").unionByName(books.select(F.col("title").alias("content"))).unionByName(books.select(F.col("author").alias("content")))
    return fit(texts, "content", file_name_twins(books))


def file_name_twins(books: DataFrame) -> DataFrame:
    """Odd titles and authors beside those in the name of the same book's file, where the text without non-ASCII characters is equal."""
    name = F.regexp_extract("file_path", "([^/]*)$", 1)
    author = F.regexp_extract(name, "^(?:[^_]*_)?(.*?) — ", 1)
    title = F.regexp_extract(name, " — (.*?)(?: \\d+)?\\.[a-z0-9.]+$", 1)
    both = books.select(F.explode(F.array(F.struct(F.col("title").alias("bad"), title.alias("good")), F.struct(F.col("author").alias("bad"), author.alias("good")))).alias("p")).select("p.*")
    rest = [F.translate(F.regexp_replace(c, "[^\\x00-\\x7f]+", ""), " ", "") for c in ("bad", "good")]
    return both.filter((F.col("good") != "") & (F.col("bad") != F.col("good")) & (rest[0] == rest[1]))
