"""Operators against brute force and exact round trips, without Spark where they are plain functions."""

import random

import numpy as np
import pytest

from folianto.llm import bpe, garbled, lookalikes, names, nearcopies, packing, splitting, truncated


def test_split_round_trip():
    r = random.Random(1)
    for _ in range(200):
        n = r.choice((0, 1, 50, 99, 100, 101, 400, 3000))
        text = "".join(r.choice("ab.  \n!я") if r.random() < 0.9 else "…" for _ in range(n))
        spans = splitting.spans(text, 100, 20)
        assert "".join(text[a:b] for a, b in spans) == text
        pieces = splitting.split_text(text, 100, 20)
        assert all(len(p) <= 100 for p in pieces)
        for before, piece, (low, high) in zip(pieces, pieces[1:], spans[1:]):
            shared = len(piece) - (high - low)
            assert 0 <= shared <= 20 and (not shared or before.endswith(piece[:shared]))
    assert splitting.split_text("x" * 100, 100, 20) == ["x" * 100]
    assert splitting.split_text(None) == [] and splitting.split_text("") == [""]
    with pytest.raises(ValueError):
        splitting.split_text("x", 10, 10)


def test_split_prefers_strong_boundaries():
    text = "слово " * 20 + "конец. Начало " + "слово " * 20
    assert splitting.split_text(text, 200, 0)[1].startswith("Начало")
    text = "a. " * 30 + "\n" + "b. " * 30
    assert splitting.split_text(text, 150, 0)[0].endswith("\n")


def test_merge_equals_the_library():
    tiktoken = pytest.importorskip("tiktoken")
    with open(bpe.VOCABULARY, "rb") as f:
        ranks = bpe.load_ranks(f.read())
    other = tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})
    encode = bpe.Encoder(ranks)
    r = random.Random(2)
    texts = ["", " ", "Hello, world!!", "Мама мыла раму…\r\n\n  x", "a" * 3000, "ab" * 1500, "日本語 🙂🙂 ​", "<|endoftext|>", "don't  stop 12345"]
    texts += ["".join(r.choice("abcя жё \n'1.🙂é") for _ in range(r.randint(1, 80))) for _ in range(300)]
    for t in texts:
        assert encode(t) == other.encode_ordinary(t), t
    assert encode(None) == []


def test_look_alikes():
    one = lookalikes.one_form
    assert one("Ｈｅｌｌｏ， ﬁre ⅩⅠⅩ") == "Hello, fire XIX"
    assert one("Тё​мный з­абор й ё é") == "Тёмный забор й ё é"
    assert one("Сеρый случαй Τялмонтаглα") == "Серый случай Тялмонтагла"
    assert one("мeльник «Cтиктoмбeпт» c кyзницы") == "мельник «Стиктомбепт» с кузницы"
    assert one("the mambіst and thіs а cat") == "the mambist and this a cat"
    for same in ("", "По мере F, то есть λ причал", "IT-совете VII-м XIX веке… № «» —", "на пароходе «Nord-Lux»", "L’été d’Ærvik", "q̣̇"):
        assert one(same) == same
    assert one(None) is None
    # once in the one form, a text stays
    for t in ("Сеρый ﬁ", "ｅ́", "й̆ Α"):
        assert one(one(t)) == one(t)
    lookalikes.double_of(), lookalikes.mapping()  # conflicts would raise


def garble(text, written, read):
    return text.encode(written).decode(read)


def test_undo():
    text = "Берёза обеда, für été"
    for written, read in (("utf-8", "latin-1"), ("utf-8", "koi8-r"), ("utf-8", "cp866")):
        assert garbled.undo(garble(text, written, read), ((read, written),)) == text
    assert garbled.undo(garble("Берёза", "cp1251", "latin-1"), (("latin-1", "cp1251"),)) == "Берёза"
    twice = garble(garble("Обед", "utf-8", "cp1251"), "utf-8", "cp1251")
    assert garbled.undo(twice, (("cp1251", "utf-8"),) * 2) == "Обед"
    assert garbled.undo("日本", (("cp1251", "utf-8"),)) is None


def test_oddities():
    odd, mixed = garbled.oddities(["Мама мыла раму", "дОм", "", None, "x²", "КОНЕЦ", "сaд"])
    assert odd.tolist() == [0, 0, 0, 0, 1, 0, 0]
    assert mixed.tolist()[:5] == [0, 1, 0, 0, 0] and mixed[5] > 0 and mixed[6] > 0


def test_signature_distance_guarantee():
    """Every pair of signatures within the stated distance shares a key."""
    r = np.random.default_rng(3)
    for index in (nearcopies.WORDS_INDEX, nearcopies.CHARS_INDEX, nearcopies.Index(3, 4, 2)):
        signer = nearcopies.Signer(index)
        n = index.chunks * index.width
        for _ in range(60):
            a = r.integers(0, 1 << 32, n).astype(np.uint64)
            b = a.copy()
            b[r.permutation(n)[: index.distance]] ^= np.uint64(1)
            keys = signer.keys(np.stack([a, b]))
            assert set(keys[0]) & set(keys[1])


def test_typos_and_distances():
    assert names.typos("олег", "олге", 2) == 1 and names.typos("abc", "abc", 0) == 0 and names.typos("abcdef", "ab", 2) == 3
    words = ["kitten", "sitting", "", "mitten", "a"]
    codes, lengths = names.as_codes(words)

    def slow(a, b):
        d = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            before, d[0] = d[0], i
            for j, y in enumerate(b, 1):
                before, d[j] = d[j], min(d[j] + 1, d[j - 1] + 1, before + (x != y))
        return d[-1]

    for w in ("kitten", "smitten", "", "b"):
        assert names.distances(w, codes, lengths).tolist() == [slow(w, x) for x in words]


def test_nobody():
    assert all(names.names_no_one(x) for x in (None, "", "  ", "Неизвестный автор", "Автор не указан", "Unknown", "б/а", "no author", "—", "неизв.", "Коллектив авторов"))
    assert not any(names.names_no_one(x) for x in ("Иван Петров", "ООО «Рука»", "Авторкин Б."))


@pytest.mark.parametrize("seed", range(5))
def test_packing_plan(seed):
    r = random.Random(seed)
    counts = {s: r.randint(1, 30) for s in r.sample(range(1, 65), r.randint(1, 40))}
    slots, n = packing.plan(counts, 64)
    filled, seen = [0] * n, dict.fromkeys(counts, 0)
    spans = [[] for _ in range(n)]
    for s in slots:
        assert s.rank == seen[s.size] and s.size <= s.window
        for k in range(s.uses * s.copies):
            c, copy = s.first + k % s.uses, k // s.uses
            spans[c].append((s.offset + copy * s.size, s.size))
            filled[c] += s.size
        seen[s.size] += s.uses * s.copies
    assert seen == counts and max(filled) <= 64
    for each in spans:
        each.sort()
        assert all(a + n <= b for (a, n), (b, _) in zip(each, each[1:]))
    assert packing.plan({}, 64) == ([], 0)
    with pytest.raises(ValueError):
        packing.plan({65: 1}, 64)


def test_tiers_shape_the_plan():
    """Windows of the shorter tiers lie side by side, no text crosses one, and without tiers the plan is another."""
    r = random.Random(3)
    counts = {}
    for _ in range(20_000):
        size = min(2048, max(1, int(r.lognormvariate(5.8, 0.9))))
        counts[size] = counts.get(size, 0) + 1
    slots, n = packing.plan(counts)
    assert {s.window for s in slots} == {256, 512, 1024, 2048}
    assert all(s.offset // s.window == (s.offset + s.copies * s.size - 1) // s.window for s in slots)
    flat, m = packing.plan(counts, windows=[2048])
    assert [(s.size, s.first, s.offset) for s in slots] != [(s.size, s.first, s.offset) for s in flat]
    tokens = sum(s * k for s, k in counts.items())
    assert tokens / (2048 * n) > 0.99 and tokens / (2048 * m) > 0.99


def test_shares_have_lower_bounds():
    k, n = np.array([0, 1, 3, 300, 0]), np.array([0, 1, 3, 300, 50])
    low = truncated.lower_bound(k, n, 3.0)
    assert low[0] == 0 and low[4] == 0 and 0 < low[1] < low[2] < low[3] < 1


def test_contexts_of_a_text_are_found_in_others():
    """A context has the same hash wherever it stands, and another one in another group."""
    a, b = truncated.Pieces(["он ушёл домой"], [0]), truncated.Pieces(["вот.\nи он ушёл домой рано", "ушёл"], [0, 1])
    text = "\nвот.\nи он ушёл домой рано\n"
    at = np.array([text.index("домой") + 4])
    zero = np.array([0])
    for k in (1, 4, 9):
        assert a.at(a.last, zero, k)[0] == b.at(at, zero, k)[0]
    assert a.runs_at(a.run_of[a.last], zero, 4)[0] == b.runs_at(b.run_of[at], zero, 4)[0]
    assert a.at(a.last, zero, 1)[0] != b.at(b.last[1:], np.array([1]), 1)[0]


def test_language_of_texts():
    assert [truncated.language_of(x) for x in ("Он был в доме и пел", "the cat of a house", "der Hund und die Katze", "le chat et la souris", "Привет", "Hm")] == ["ru", "en", "de", "fr", "ru", "other"]
    assert truncated.plain_blanks("а \t б\r\n\tв \n") == "а б\nв\n"


def test_cuts_are_told_from_whole_ends():
    """The share of cut texts among the ends is found, and the threshold parts them."""
    r = np.random.default_rng(5)
    whole, cuts, more = r.normal(-3, 1, (900, 6)), r.normal(3, 1, (100, 6)), r.normal(3, 1, (1000, 6))
    x = np.concatenate([whole, cuts, more]) * np.where(truncated.DIRECTIONS == 0, 1, truncated.DIRECTIONS)
    w, share = truncated.fit_group(x[:, :5], np.arange(2000) >= 1000)
    score = x[:, :5] @ w[:-1] + w[-1]
    assert 0.08 < share < 0.2 and (score[:900] < 0).all() and (score[900:] > 0).mean() > 0.99


def test_endings():
    assert truncated.ending("текст [...]  ") == ("текст", "[...]")
    assert truncated.ending("тек-\n") == ("тек", "-")
    assert truncated.ending("тек�") == ("тек", "�")
    assert truncated.ending("стих —") == ("стих —", "")
    assert truncated.ending("текст…") == ("текст…", "")
    assert truncated.kind_of("раз\nдва\nтри") == "lines" and truncated.kind_of("Раз.\nДва.\nТри") == "prose"


def test_look_alikes_worth_a_look():
    """What the transducer would change is looked at: compounds, words with digits, and the script of most sure words."""
    change = lookalikes.transducer()
    texts = ["Пишите на е-mail сегодня, в любое время.", "Это модель Ж9J и другие слова.", "Слово а1b здесь стоит.", "we go to а big fun вечерняяпрогулкапоогромномугороду", "Обычный текст - и GPU-отдел, XVIII-м веке.", "", None, "a plain text"]
    looks = lookalikes.needs_look(texts)
    assert all(look for t, look in zip(texts, looks) if t and change(t)[1])
    assert looks[0] and looks[3] and not looks[4:].any()
    assert lookalikes.one_form(texts[0]) == "Пишите на e-mail сегодня, в любое время."
    assert lookalikes.one_form(texts[3]).startswith("we go to a big")
