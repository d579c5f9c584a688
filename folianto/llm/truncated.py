"""Text cut off by field limits: a backward character n-gram model of ends.

Read backwards from its last character, the end of a text is a chain of ever longer contexts: the last 1, 2, 3, 4, 6 and 9 characters,
and the last runs of small letters, capitals, digits, blanks and marks. For each context that stands at some end, all texts are searched:
how often it stands inside a text, and how often it ends a sentence (in verse and lists: a line) there, stands before a full stop, or goes
on with a letter. The odds of an end against a continuation are estimated along the chain, each context starting from the next shorter one.
Lines that close texts ("The End", a signature) are contexts too: by the share of their occurrences that closes different texts.

Counts are kept for each language and kind of text (prose, or lines) in tables that grow with the corpus; no context shares a counter. The
weights of the odds and the threshold of each language and kind are fitted: texts that are cut at random places are known cases,
and the ends as they are a mixture of whole texts and unknown cases. Marks after a cut and lengths shared by a source's cut texts
move the odds by the share of cut texts found with that mark, or at that length.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folianto.plans.lineage import cut
from folianto.plans.sizes import broadcast_if_small

from .filters import hash_filter, passing

#: Lengths of the contexts in characters (0: the whole group), and in runs of like characters.
ORDERS, RUNS = (0, 1, 2, 3, 4, 6, 9), (4, 7)
#: Contexts from this length on are counted for ends without a full stop only: a full stop has told enough.
LONG = 6
#: Contexts of so many characters are told apart by sorting.
LEADING = 4
#: Length of the beginning of a line that is a context, and of the text before the last line by which copies are told.
BEGINNING, BEFORE = 7, 60
#: Occurrences that a context's own share is weighed against; standard deviations of the lower bounds of shares.
SHRINK, CLOSING_Z, LIMIT_Z = 4.0, 3.0, 4.0
#: A limit of a source: the least share of its cut texts that have one length.
LIMIT_SHARE = 0.08
#: About the most rows the weights are fitted on, and as many cut at random places; rounds of the fit; rows of either sort below which a language takes the weights of all.
FIT_ROWS, ROUNDS, OWN_ROWS = 40_000, 4, 30
#: One of so many artificial cuts is moved on to the end of its word.
WORD_ENDS = 3
#: Least share of artificial cuts that must pass the limits by which the share of cut texts is found; many cuts in verse look like ends of lines.
PASSING = {"prose": 0.95, "lines": 0.6}
#: Code points at the end of a text in which its mark is sought; at the end of a line, in which its full stop is.
MARK_LENGTH, STOP_LENGTH = 64, 8

# Marks put after a cut, and the marks that end sentences.
MARK = re.compile(r"(?:\s*(?:\[(?:\.\.\.|…)\]|\((?:\.\.\.|…)\)|<(?:\.\.\.|…)>)|�+|(?<=[^\W\d_])-|\.\.\.)\s*$")
SENTENCE_END = re.compile(r"[.!?…][»”“\"'’)\]]*$")
STOPS, CLOSERS = ".!?…", "»”“\"'’)]"
# Frequent short words of the languages.
WORDS = {"ru": (" и ", " в ", " на ", " не ", " с ", " у "), "en": (" the ", " and ", " of ", " a ", " his "), "de": (" der ", " die ", " das ", " und ", " den "), "fr": (" le ", " la ", " les ", " et ", " de ")}
LANGUAGES, KINDS = (*WORDS, "other"), ("prose", "lines")
_LINES = re.compile(r"[\r\n]+")
_SPACES = re.compile(r"[ \t]+")
_CYRILLIC = re.compile("[Ѐ-ӿ]")
_LETTER = re.compile(r"[^\W\d_]")


def ending(text: str) -> tuple[str, str]:
    """The text without blanks at its end and without a mark of a cut, and that mark."""
    text = text.rstrip()
    # only the end is searched: a mark reaches the end, and a longer run of one sign is taken off in parts
    m = MARK.search(text, max(0, len(text) - MARK_LENGTH))
    if not m:
        return text, ""
    core, mark = text[: m.start()].rstrip(), m.group().strip()
    while core.endswith("�"):
        core = core.rstrip("�").rstrip()
    return core, mark


def plain_blanks(text: str) -> str:
    """Line ends as LF, runs of blanks and tabs as one blank, none beside a line end."""
    text = text.replace("\r\n", "\n")
    if "\t" in text or "  " in text or " \n" in text or "\n " in text:
        text = _SPACES.sub(" ", text).replace(" \n", "\n").replace("\n ", "\n")
    return text


def kind_of(text: str) -> str:
    """``lines`` if most lines but the last end without a full stop (verse, lists), else ``prose``."""
    if "\n" not in text and "\r" not in text:
        return "prose"
    lines = [y for x in _LINES.split(text) if (y := x.strip())][:-1]
    ended = sum([x[-1] in STOPS or SENTENCE_END.search(x, max(0, len(x) - STOP_LENGTH)) is not None for x in lines])
    return "lines" if lines and ended < 0.75 * len(lines) else "prose"


def language_of(text: str) -> str:
    """The language whose short words are most frequent in the whole text; without such words Russian if most letters are Cyrillic, else ``other``."""
    low = text.lower()
    counts = {lang: sum(map(low.count, words)) for lang, words in WORDS.items()}
    best = max(counts, key=counts.get)
    if counts[best]:
        return best
    return "ru" if 2 * len(_CYRILLIC.findall(text)) > len(_LETTER.findall(text)) else "other"


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_BASE = 0x9E3779B97F4A7C15


@cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2 ** 64."""
    inverse = pow(_BASE, -1, 1 << 64)
    up = np.full(n, _BASE, np.uint64)
    down = np.full(n, inverse, np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


class Sums:
    """Hashes of any stretch of a sequence in constant time, from sums of powers."""

    def __init__(self, values: np.ndarray):
        size = 1 << max(16, int(len(values)).bit_length())
        up, self.down = _powers(size)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_mix(values + np.uint64(1)) * up[: len(values)])])

    def of(self, start: np.ndarray, end: np.ndarray, seed: np.ndarray) -> np.ndarray:
        return _mix((self.sums[end] - self.sums[start]) * self.down[start] + seed * np.uint64(0xC2B2AE3D27D4EB4F))


@cache
def _classes() -> np.ndarray:
    """Classes of characters: small letter 1, capital 2, digit 3, blank 4; others 0 and told apart by themselves."""
    out = np.zeros(0x10001, np.uint8)
    for c in range(0x10000):
        ch = chr(c)
        out[c] = 2 if ch.isupper() else 1 if ch.isalpha() else 3 if ch.isdigit() else 4 if ch.isspace() and ch != "\n" else 0
    return out


@cache
def _table(chars: str) -> np.ndarray:
    out = np.zeros(0x10001, bool)
    out[[ord(c) for c in chars]] = True
    return out


class Pieces:
    """Texts of a batch as one sequence of code points, each between line ends."""

    def __init__(self, cores: list[str], groups: list[int]):
        text = "".join([f"\n{c}\n" for c in cores])
        self.codes = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
        self.sizes = np.array([len(c) + 2 for c in cores], np.int64)
        self.last = np.cumsum(self.sizes) - 2  # the last character of each text
        self.first = self.last + 2 - self.sizes
        self.groups = np.array(groups, np.uint64)
        self.sums = Sums(self.codes.astype(np.uint64))
        self.low = np.minimum(self.codes, 0x10000)
        kind = self.kind = _classes()[self.low]
        self.letter = (kind == 1) | (kind == 2)
        shape = np.where(kind > 0, kind, self.codes + 16).astype(np.uint64)
        new = np.concatenate([[True], (shape[1:] != shape[:-1]) | (kind[1:] == 0)])
        new[self.first] = True
        self.run_start = np.flatnonzero(new)
        self.run_of = np.cumsum(new) - 1
        self.runs = Sums(shape[self.run_start])
        self.line_end = np.flatnonzero(self.codes == 10)

    def at(self, where: np.ndarray, piece: np.ndarray, order: int) -> np.ndarray:
        """Hashes of the last ``order`` characters at ``where``, none before the text's beginning."""
        start = np.maximum(where + 1 - order, self.first[piece])
        return self.sums.of(start, where + 1, self.groups[piece] * np.uint64(64) + np.uint64(order))

    def runs_at(self, run: np.ndarray, piece: np.ndarray, order: int) -> np.ndarray:
        start = np.maximum(run + 1 - order, self.run_of[self.first[piece]])
        return self.runs.of(start, run + 1, self.groups[piece] * np.uint64(64) + np.uint64(32 + order))

    def line(self, start: np.ndarray, end: np.ndarray, piece: np.ndarray, whole: bool) -> np.ndarray:
        """Hashes of lines, or of their beginnings."""
        end = end if whole else np.minimum(end, start + BEGINNING)
        return self.sums.of(start, end, self.groups[piece] * np.uint64(64) + np.uint64(62 + whole))


#: All contexts of an end, in the order of their columns.
CONTEXTS = (*(("char", k) for k in ORDERS), *(("run", k) for k in RUNS), ("line", 0), ("line", 1))


def _ends(pieces: Pieces) -> np.ndarray:
    """The hash of each context (columns) of the end of each text (rows)."""
    piece = np.arange(len(pieces.last))
    where = pieces.last
    line = pieces.line_end[np.searchsorted(pieces.line_end, where, side="right") - 1] + 1
    columns = [pieces.at(where, piece, k) for k in ORDERS] + [pieces.runs_at(pieces.run_of[where], piece, k) for k in RUNS]
    columns += [pieces.line(line, where + 1, piece, False), pieces.line(line, where + 1, piece, True)]
    return np.stack(columns, axis=1)


def _group(lang: str, kind: str) -> int:
    return LANGUAGES.index(lang) * 2 + KINDS.index(kind)


def _long(core: str) -> bool:
    """Whether the end is looked at with long contexts: those of no full stop."""
    return core[-1] not in STOPS and not SENTENCE_END.search(core[-4:])


def _tails(texts: list[str | None], chosen: list[int]) -> list[tuple]:
    """Rows of ``read_ends`` without key and source; ``chosen``: 0, or a number that says where a text is also cut."""
    rows: list[list] = []
    cores, groups = [], []
    for t, pick in zip(texts, chosen):
        if not t or t.isspace():
            rows.append([False, False, None, None, "", False, 0, 0, 0, 0, None, None, 0, 0, 0])
            continue
        clean = plain_blanks(t)
        core, mark = ending(clean)
        if not core:
            rows.append([False, False, None, None, mark, False, 0, 0, len(t), len(t.encode("utf-8", "replace")), None, None, 0, 0, 0])
            continue
        if not mark and core[-1] == "…":
            core, mark = core[:-1].rstrip() or core, "…"
        lang = language_of(clean)
        for artificial in (False, True)[: 1 + bool(pick and not mark)]:
            c, ns = core, (0, int(mark == "…"), 0)  # an ellipsis is a full stop inside its text as well
            if artificial:
                k = 1 + pick % max(1, len(core) - 1)
                if (pick >> 40) % WORD_ENDS == 0:  # some limits spare words
                    k = min((i for i in (core.find(" ", k), core.find("\n", k)) if i > 0), default=k)
                c = core[:k].rstrip()
                if not c:
                    continue
                after = core[len(c) : len(c) + 1]
                if (after == "\n" if kind_of(c) == "lines" else after.isspace() and SENTENCE_END.search(c[-4:])):
                    continue  # at an end of a line or sentence: no case
                ns = (int(after.isalpha()), int(after != "" and after in STOPS + "\n"), int("\n" not in core[len(c) :]))
            kind = kind_of(c)
            lines = _LINES.split(c)
            before = "".join(x for x in "\n".join(lines[:-1])[-BEFORE:].lower() if x.isalnum()) or "".join(x for x in c[-BEFORE:].lower() if x.isalnum())
            cores.append(c)
            groups.append(_group(lang, kind))
            rows.append([artificial, bool(pick), lang, kind, mark[:1] if mark[:1] == "�" else mark, c[-1].isalpha(), len(c), len(c.encode("utf-8", "replace")), len(t), len(t.encode("utf-8", "replace")), None, xxhash.xxh64_intdigest(before) - (1 << 63), *ns])
    if cores:
        hashes = iter(_ends(Pieces(cores, groups)).view(np.int64))
        at = iter(cores)
        for row in rows:
            if row[2] is not None:
                h, c = next(hashes), next(at)
                long = _long(c) or row[4] != ""
                row[10] = [int(x) if long or i >= len(ORDERS) or ORDERS[i] < LONG else None for i, x in enumerate(h)]
    return [tuple(r) for r in rows]


def read_ends(df: DataFrame, key: str, text: str, source: str, rows: int) -> DataFrame:
    """One row for each text, and one more for each of about ``FIT_ROWS`` of them cut at a random place (``artificial``)."""
    kinds = {c: df.schema[c].dataType.simpleString() for c in (key, source)}
    every = max(1, rows // FIT_ROWS)
    names = [key, source, "artificial", "chosen", "lang", "kind", "mark", "last_letter", "chars", "bytes", "all_chars", "all_bytes", "contexts", "before", "next_letter", "next_stop", "same_line"]
    types = (pa.bool_(), pa.bool_(), pa.string(), pa.string(), pa.string(), pa.bool_(), *[pa.int64()] * 4, pa.list_(pa.int64()), pa.int64(), *[pa.int32()] * 3)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                part = batch.slice(start, 1000)
                texts = part.column(1).to_pylist()
                # by key and text, so that copies of one text aren't all chosen
                keys = part.column(0).to_pylist()
                chosen = [h >> 8 if t and (h := xxhash.xxh64_intdigest(f"{k}\n{t[-200:]}".encode("utf-8", "replace"))) % every == 0 else 0 for k, t in zip(keys, texts)]
                out = _tails(texts, chosen)
                # an artificial row follows the row of its text
                index = pa.array(np.cumsum([not r[0] for r in out], dtype=np.int64) - 1)
                columns = list(zip(*out)) if out else [()] * len(types)
                yield pa.RecordBatch.from_arrays([part.column(0).take(index), part.column(2).take(index), *(pa.array(c, t) for c, t in zip(columns, types))], names)

    schema = f"`{key}` {kinds[key]}, `{source}` {kinds[source]}, artificial boolean, chosen boolean, lang string, kind string, mark string, last_letter boolean, chars long, bytes long, all_chars long, all_bytes long, contexts array<long>, before long, next_letter int, next_stop int, same_line int"
    return df.select(key, text, source).mapInArrow(run, schema)


#: What is counted of a context inside texts: all, before a letter, before a full stop or line end, at an end of a sentence or line.
COUNTERS = ("inside", "letter", "stop", "ends")
#: Place of the number of different texts that end with a context, behind the counters.
CLOSES = len(COUNTERS)


def count_contexts(df: DataFrame, text: str, wanted: np.ndarray) -> DataFrame:
    """``(h, inside, letter, stop, ends)``: contexts of ``wanted`` inside all texts, counted where they are read, then added up."""
    shared = df.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def seen(h: np.ndarray) -> np.ndarray:
            return passing(bits, h)

        def together() -> tuple[np.ndarray, np.ndarray]:
            h, _, values = _summed(np.concatenate([a for a, _ in held]), np.concatenate([b for _, b in held], axis=1), np.int64)
            return h, values

        def add(h: np.ndarray, values: np.ndarray) -> None:
            if len(h):
                held.append((h, values))

        def rows() -> pa.RecordBatch:
            h, values = together()
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), *(pa.array(v.astype(np.int64)) for v in values)], ["h", *COUNTERS])

        for batch in batches:
            texts = [plain_blanks(t) for t in batch.column(0).to_pylist() if t and not t.isspace()]
            for start in range(0, len(texts), 400):
                cores, groups, kinds = [], [], []
                for t in texts[start : start + 400]:
                    core, mark = ending(t)
                    if core:
                        kind = kind_of(core)
                        cores.append(core)
                        groups.append(_group(language_of(t), kind))
                        kinds.append(kind == "lines")
                if cores:
                    _count(Pieces(cores, groups), np.array(kinds), seen, add)
                if sum(len(a) for a, _ in held) > 2_000_000:
                    held[:] = [together()]
                    if len(held[0][0]) > 1_000_000:
                        yield rows()
        if sum(len(a) for a, _ in held):
            yield rows()

    counts = df.select(text).mapInArrow(run, "h long, " + ", ".join(f"{c} long" for c in COUNTERS))
    return counts.groupBy("h").agg(*(F.sum(c).alias(c) for c in COUNTERS))


def _summed(h: np.ndarray, values: np.ndarray, kind: type = np.int32) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct hashes, where each is first, and the sums of ``values`` (counter, place)."""
    order = np.argsort(h)
    h = h[order]
    first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.empty(0, np.int64)
    return h[first], order[first], np.stack([np.add.reduceat(v[order], first, dtype=kind) for v in values]) if len(h) else values


def _count(pieces: Pieces, lines: np.ndarray, seen, add) -> None:
    """All contexts inside the texts: every place but the last character and the line ends around a text."""
    codes, n = pieces.codes, len(pieces.codes)
    piece_of = np.repeat(np.arange(len(pieces.sizes)), pieces.sizes)
    inside = np.ones(n, bool)
    inside[pieces.first] = inside[pieces.last] = inside[pieces.last + 1] = False
    newline = codes == 10
    stop, closer = _table(STOPS)[pieces.low], _table(CLOSERS)[pieces.low]
    closed = stop.copy()
    for _ in range(2):
        closed[1:] |= closer[1:] & closed[:-1]
    values = np.zeros((len(COUNTERS), n), bool)  # what follows each character
    values[0] = inside
    values[1, :-1] = pieces.letter[1:]
    values[2, :-1] = stop[1:] | newline[1:]
    values[3, :-1] = np.where(lines[piece_of[:-1]], newline[1:] & ~newline[:-1], closed[:-1] & ((pieces.kind[1:] == 4) | newline[1:]))
    values &= inside
    where = np.flatnonzero(inside)
    if not len(where):
        return
    # the contexts of LEADING characters are told apart by one sort; those of fewer are added up from them
    h, at, sums = _summed(pieces.at(where, piece_of[where], LEADING), values[:, where])
    leading = where[at]
    for k in reversed([k for k in ORDERS if k <= LEADING]):
        if k < LEADING:
            h, at, sums = _summed(pieces.at(leading, piece_of[leading], k), sums)
            leading = leading[at]
        kept = seen(h)
        add(h[kept], sums[:, kept])
    for k in ORDERS:
        if k > LEADING:
            h = pieces.at(where, piece_of[where], k)
            kept = seen(h)
            where, h = where[kept], h[kept]  # a longer context is wanted only where its end is
            add(h, values[:, where].astype(np.int32))
    run_piece = piece_of[pieces.run_start]
    per_run = np.add.reduceat(values, pieces.run_start, axis=1, dtype=np.int32)
    run = np.arange(len(pieces.run_start))
    for k in RUNS:
        h = pieces.runs_at(run, run_piece, k)
        at = seen(h)
        at = at[per_run[0, at] > 0]
        add(h[at], per_run[:, at])
    # whole lines and beginnings of lines, but for the last of each text
    start = pieces.line_end[:-1] + 1
    end = pieces.line_end[1:]
    line_piece = piece_of[np.minimum(start, n - 1)]
    ok = (end > start) & (end <= pieces.last[line_piece])
    start, end, line_piece = start[ok], end[ok], line_piece[ok]
    for whole in (False, True):
        h = pieces.line(start, end, line_piece, whole)
        at = seen(h)
        one = np.zeros((len(COUNTERS), len(at)), np.int32)
        one[0] = 1
        add(h[at], one)


def _odds(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


def lower_bound(k: np.ndarray, n: np.ndarray, z: float) -> np.ndarray:
    """Wilson's lower bound of a share; 0 of 0 is 0."""
    n = np.maximum(n, 1e-9)
    p = np.minimum(k / n, 1)
    return np.maximum(0.0, (p + z * z / (2 * n) - z * np.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n))


#: Features of an end: odds of an end against a continuation, odds that a last letter goes on, whether it more likely does, how surely a context closes texts, odds of the runs.
FEATURES = ("ends", "goes_on", "in_word", "closes", "runs")


#: Whether a feature speaks for a cut text or against: a fitted weight may not have the other sign.
DIRECTIONS = np.array([-1, 1, 1, -1, -1, 0])


def features(counts: np.ndarray, letter_last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``counts`` (row, context, inside/letter/stop/ends/closes) to features, and to the odds of standing before a full stop.

    Along a chain each context's share is weighed against that of the context before it; a context never seen tells nothing new.
    """

    chars, runs = list(range(len(ORDERS))), [0, *range(len(ORDERS), len(ORDERS) + len(RUNS))]

    def chain(which: list[int], part: int) -> np.ndarray:
        own = part == CLOSES  # an end isn't inside its text
        share = first = (counts[:, 0, part] + 0.5) / (counts[:, 0, 0] + own * counts[:, 0, CLOSES] + 1.0)
        for j in which[1:]:
            share = (counts[:, j, part] + SHRINK * share) / (counts[:, j, 0] + own * counts[:, j, CLOSES] + SHRINK)
        return _odds(share) - _odds(first)

    # the last characters of a phrase close texts by chance where texts are cut at one place; behind a letter only lines count
    closes = lower_bound(counts[:, 1:, CLOSES], counts[:, 1:, CLOSES] + counts[:, 1:, 0], CLOSING_Z)
    closes = np.where(letter_last, closes[:, -2:].max(axis=1), closes.max(axis=1))
    goes_on = np.where(letter_last, chain(chars, 1), 0.0)
    x = np.stack([chain(chars, 3), goes_on, np.tanh(goes_on / 2), _odds(np.maximum(closes, 0.002)), chain(runs, CLOSES)], axis=1)
    return x, chain(chars, 2)


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    w, penalty = np.zeros(x.shape[1]), np.full(x.shape[1], 0.5)
    penalty[-1] = 1e-3
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (weight * (y - p)) - penalty * w)
        w = w + np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-4:
            break
    return w


def fit_group(x: np.ndarray, artificial: np.ndarray, share: float | None = None, passing: float = 0.95) -> tuple[np.ndarray, float] | None:
    """Weights of the features and a constant, so that their sum is above 0 for cut texts, and the share of cut texts; None without cases of both sorts.

    The ends as they are hold an unknown share of cut texts. It is at most what is found among the ends that look like cut ones,
    so, where it isn't given, it is the least ratio of ends (an upper bound) and artificial cuts beyond a limit, over limits that at least ``passing`` of the artificial cuts pass. With it, the errors of every threshold can be
    reckoned: the best one is taken, the ends beyond it are left out of the whole ones, and the weights are fitted again.
    """
    n, m = int((~artificial).sum()), int(artificial.sum())
    if not n or not m:
        return None
    x = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    whole = ~artificial
    for _ in range(ROUNDS):
        weight = np.where(artificial, 1 / m, whole / max(1, whole.sum())) * min(n, m)
        free = np.ones(x.shape[1], bool)
        while True:
            w = _logistic(np.where(free, x, 0.0), artificial.astype(float), weight)
            wrong = free & (w * DIRECTIONS < 0)
            if not wrong.any():
                break
            free &= ~wrong
        score = x @ w
        ends, cuts = np.sort(score[~artificial]), np.sort(score[artificial])

        def beyond(limits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            return 1 - np.searchsorted(ends, limits) / n, 1 - np.searchsorted(cuts, limits) / m

        found = share
        if found is None:
            of_ends, of_cuts = beyond(np.quantile(cuts, np.linspace(0.02, 1 - passing, 49)))
            found = min(1.0, ((of_ends + 2 * np.sqrt(of_ends / n) + 3 / n) / of_cuts).min())
        limits = np.append(np.unique(score), score.max() + 1)
        of_ends, of_cuts = beyond(limits)
        best = int((of_ends - 2 * found * of_cuts).argmin())
        threshold = limits[best] if best == 0 else (limits[best] + limits[best - 1]) / 2
        whole = ~artificial & (score < threshold)
    w[-1] -= threshold
    return w, found


def fit_weights(x: np.ndarray, artificial: np.ndarray, lang: np.ndarray, kind: np.ndarray, letter: np.ndarray) -> dict[tuple[str, str, bool], np.ndarray]:
    """Weights by language, kind and whether the last character is a letter; languages of few rows take those of all languages."""

    def fit(at: np.ndarray, passing: float) -> dict[bool, np.ndarray]:
        """Of both last characters: the share of cut texts is found where the last one is a letter, and holds for the others as well."""
        found, share = {}, None
        for last in (True, False):
            own = at & (letter == last)
            m, n = int((own & artificial).sum()), int((own & ~artificial).sum())
            if min(m, n) < OWN_ROWS or (not last and share is None):
                break
            among = m / (at & artificial).sum() / (n / (at & ~artificial).sum())  # how much more of the cut texts are in this part
            found[last], beyond = fit_group(x[own], artificial[own], None if last else min(1.0, share * among), passing)
            share = beyond / among if last else share
        return found

    out = {}
    everything = fit_group(x, artificial)
    for k in KINDS:
        shared = fit(kind == k, PASSING[k])
        for name in LANGUAGES:
            own = fit((kind == k) & (lang == name), PASSING[k])
            for last in (True, False):
                w = own.get(last, shared.get(last, everything and everything[0]))
                if w is not None:
                    out[name, k, last] = w
    return out


def _with_counts(ends: DataFrame, counts: DataFrame) -> DataFrame:
    """``ends`` with an array of its contexts' counts.

    Contexts of up to two characters are few and shared by many texts: they are joined by broadcast after counting them. The others
    shuffle; a context that very many ends share is split by adaptive execution, as its other side is one row.
    """
    short = [i for i, (kind, k) in enumerate(CONTEXTS) if kind == "char" and k <= 2]
    each = ends.filter("contexts is not null").select("uid", "artificial", "before", F.posexplode("contexts").alias("j", "h")).filter("h is not null")
    few, many = each.filter(F.col("j").isin(short)), each.filter(~F.col("j").isin(short))
    closes = cut(each.filter("not artificial").groupBy("h").agg(F.countDistinct("before").alias("closes")))
    table = cut(counts.join(closes, "h", "full").na.fill(0))
    low = table.join(few.select("h").distinct(), "h", "left_semi")
    joined = few.join(broadcast_if_small(cut(low)), "h").unionByName(many.join(table, "h"))
    entry = F.struct("j", *COUNTERS, "closes")
    return ends.join(joined.groupBy("uid").agg(F.collect_list(entry).alias("counts")), "uid", "left")


def _dense(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """(row, context, counter) of a batch with ``counts``, without the row's own occurrences."""
    column = batch.column("counts")
    out = np.zeros((batch.num_rows, len(CONTEXTS), CLOSES + 1))
    known = np.zeros((batch.num_rows, len(CONTEXTS)), bool)
    offsets = column.offsets.to_numpy()
    sizes = np.where(np.array(column.is_valid()), np.diff(offsets), 0)
    flat = column.flatten()
    row = np.repeat(np.arange(batch.num_rows), sizes)
    j = flat.field("j").to_numpy(zero_copy_only=False)
    for c, name in enumerate((*COUNTERS, "closes")):
        out[row, j, c] = flat.field(name).to_numpy(zero_copy_only=False)
    known[row, j] = True
    artificial = np.array(batch.column("artificial").to_pylist(), bool)
    own = np.stack([np.array(batch.column(c).to_pylist(), float) for c in ("next_letter", "next_stop")], axis=1)
    # a place inside a text was counted itself; the beginning of a line that goes on, too
    places = [i for i, (kind, _) in enumerate(CONTEXTS) if kind != "line"]
    inner = artificial | (np.array(batch.column("mark").to_pylist()) == "…")
    at = np.ix_(inner, places)
    out[..., 0][at] -= known[at]
    for c in range(2):
        out[..., c + 1][at] -= own[inner, c][:, None] * known[at]
    line = CONTEXTS.index(("line", 0))
    same = np.array(batch.column("same_line").to_pylist(), float)
    out[artificial, line, 0] -= known[artificial, line] * (1 - same[artificial])
    out[artificial, line, CLOSES] -= known[artificial, line] * same[artificial]
    out[~artificial, :, CLOSES] -= known[~artificial]
    return np.maximum(out, 0), artificial


def _with_features(ends: DataFrame) -> DataFrame:
    fields = [f for f in ends.schema if f.name not in ("counts", "contexts", "next_letter", "next_stop", "same_line", "before")]
    names = [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, _ = _dense(batch)
            x, stop = features(counts, np.array(batch.column("last_letter").to_pylist(), bool))
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), *(pa.array(c) for c in x.T), pa.array(stop)], [*names, *(f"x_{c}" for c in FEATURES), "x_stop"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), *(f"x_{c} double" for c in FEATURES), "x_stop double"])
    return ends.mapInArrow(run, schema)


def _logit(share: Column) -> Column:
    return F.log(share / (1 - share))


def judged(df: DataFrame, key: str, text: str, source: str) -> tuple[DataFrame, dict[tuple[str, str, bool], np.ndarray]]:
    """Every text with its ``log_odds`` of being cut, by its end alone, and the fitted weights."""
    rows = df.count()
    ends = cut(read_ends(df, key, text, source, rows).withColumn("uid", F.monotonically_increasing_id()))
    counts = count_contexts(df, text, hash_filter(ends.select(F.explode("contexts").alias("h")).filter("h is not null"), 4 * rows))
    scored = cut(_with_features(_with_counts(ends, counts)))
    x_names = [f"x_{c}" for c in FEATURES]
    # about FIT_ROWS texts, and as many cut ones; the limit only holds off rows repeated without end
    sample = scored.filter("mark = '' and lang is not null and chosen").select("artificial", "lang", "kind", "last_letter", *x_names).limit(8 * FIT_ROWS).toPandas()
    columns = (sample[c].to_numpy() for c in ("lang", "kind", "last_letter"))
    weights = fit_weights(sample[x_names].to_numpy(float).reshape(-1, len(x_names)), sample["artificial"].to_numpy(bool), *columns)
    alone = F.lit(-1.0)
    for (lang, kind, last), w in weights.items():
        total = sum((F.lit(float(a)) * F.col(c) for a, c in zip(w, x_names)), F.lit(float(w[-1])))
        alone = F.when((F.col("lang") == lang) & (F.col("kind") == kind) & (F.col("last_letter") == last), total).otherwise(alone)

    real = scored.filter("not artificial")
    # the share of cut ones among the texts with a mark: of those that go on more likely than a full stop follows, against the share of these among artificial cuts
    among = scored.filter("artificial").groupBy("kind").agg(F.avg((F.col("x_stop") < 0).cast("double")).alias("f"))
    marked = real.filter("mark <> ''").groupBy("lang", "kind", "mark").agg(F.count("*").alias("n"), F.count(F.when(F.col("x_stop") < 0, 1)).alias("k"))
    marked = marked.join(F.broadcast(among), "kind", "left")  # one row for each kind
    share = F.least((F.col("n") + 1) / (F.col("n") + 2), (F.col("k") + 1) / (F.col("n") + 2) / F.greatest(F.coalesce("f", F.lit(1.0)), F.lit(0.5)))
    marked = marked.select("lang", "kind", "mark", share.alias("share"))
    real = real.join(broadcast_if_small(marked), ["lang", "kind", "mark"], "left")
    odds = F.when(F.col("lang").isNull(), F.lit(-20.0)).when(F.col("share").isNotNull(), _logit(F.col("share")) - F.col("x_stop")).otherwise(alone)
    return real.withColumn("log_odds", odds).drop("share"), weights


def find_truncated(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """``(key, source, log_odds, lang, kind, mark, at_limit, truncated)`` for every row of ``df``; ``log_odds`` are those of a cut text.

    Null, empty and blank texts are whole. A null source is a source of its own. Repeated rows come out repeatedly; other columns
    of ``df`` are not read; an empty table gives no rows.
    """
    alone = cut(judged(df, key, text, source)[0].select(key, source, "lang", "kind", "mark", "log_odds", *_LENGTHS))
    measures = F.array(*(F.struct(F.lit(m).alias("measure"), v.alias("length")) for m, v in _measures().items()))
    is_cut = F.when(F.col("log_odds") > 0, 1)
    lengths = alone.filter("lang is not null").select(source, "log_odds", F.explode(measures).alias("m")).groupBy(source, "m.measure", "m.length").agg(F.count("*").alias("n"), F.count(is_cut).alias("k"))
    each = alone.groupBy(F.col(source).alias("_s")).agg(F.count(is_cut).alias("cut"))
    total = alone.agg(((F.count(is_cut) + 1) / (F.count("*") + 2)).alias("usual"))
    limits = lengths.filter("k > 0").join(each, lengths[source].eqNullSafe(each["_s"]))
    limits = limits.filter(_lower_bound(F.col("k"), F.col("cut"), LIMIT_Z) >= LIMIT_SHARE).crossJoin(F.broadcast(total))  # one row
    more = _logit((F.col("k") + 1) / (F.col("n") + 2)) - _logit(F.col("usual"))
    limits = limits.groupBy("_s").agg(F.map_from_entries(F.collect_list(F.struct(F.struct("measure", "length"), more))).alias("limits"))
    at = alone.join(broadcast_if_small(limits), alone[source].eqNullSafe(limits["_s"]), "left")
    found = F.array_compact(F.transform(measures, lambda m: F.col("limits")[m]))
    at = at.withColumn("_more", F.greatest(F.lit(0.0), F.coalesce(F.array_max(found), F.lit(0.0))))
    odds = F.col("log_odds") + F.col("_more")
    return at.select(key, source, odds.alias("log_odds"), "lang", "kind", "mark", (F.col("_more") > 0).alias("at_limit"), (odds > 0).alias("truncated"))


_LENGTHS = ("chars", "bytes", "all_chars", "all_bytes")


def _lower_bound(k: Column, n: Column, z: float) -> Column:
    p = k / n
    return (p + z * z / (2 * n) - z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)


def _measures() -> dict[str, Column]:
    """Lengths that a limit may be set in: code points or bytes, with or without the mark.

    A byte limit cuts a character of up to four bytes: whole multiples of four lengths fall together.
    """
    return {"chars": F.col("chars"), "all_chars": F.col("all_chars"), "all_bytes": F.floor((F.col("all_bytes") + 1) / 4).cast("long")}


def by_source(found: DataFrame, source: str = "source") -> DataFrame:
    """``(source, n, n_truncated, share)`` of the rows of ``find_truncated``."""
    counts = found.groupBy(source).agg(F.count("*").alias("n"), F.sum(F.col("truncated").cast("long")).alias("n_truncated"))
    return counts.withColumn("share", F.col("n_truncated") / F.col("n"))
