"""Operators on small frames: nulls, empty and very long texts, ties, repeated rows, empty tables, extra columns with clashing names."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from folianto.functions.text import py_tokens
from folianto.llm import bpe, canonical, distinctive, garbled, lookalikes, names, nearcopies, packing, splitting, truncated


def frame(spark, rows, schema="doc_id long, content string"):
    return spark.createDataFrame(rows, schema)


LONG = "слово за словом. " * 20_000


def test_splitting(spark):
    rows = [(1, None), (2, ""), (3, "короткий"), (4, LONG), (4, LONG), (None, "без номера")]
    df = frame(spark, rows).withColumn("piece", F.lit("own")).withColumn("n_pieces", F.lit("own"))
    got = splitting.split_items(df).collect()
    by = Counter((r.doc_id, r.piece) for r in got)
    assert by[1, 0] == by[2, 0] == by[3, 0] == by[None, 0] == 1 and by[4, 0] == 2 and by[4, 1] == 2
    assert [r.n_pieces for r in got if r.doc_id in (1, 2, 3)] == [0, 1, 1]
    assert all(len(r.content) <= 3500 for r in got if r.content)
    assert splitting.split_items(frame(spark, [])).count() == 0


def test_renumbering(spark):
    rows = [(i, b, n, f"{i}") for i, (b, n) in enumerate([(1, 5), (1, 2000), (1, None), (1, 5), (2, 7), (None, 1), (1, 3000)])]
    df = frame(spark, rows, "doc_id long, book_id long, chunk_num int, content string").withColumn("piece", F.lit(0))
    got = {r.doc_id: r.chunk_num for r in splitting.renumber(df).collect()}
    assert got == {2: 1, 0: 2, 3: 3, 1: 4, 6: 5, 4: 1, 5: 1}
    assert splitting.renumber(df.limit(0)).count() == 0


def test_encoding(spark):
    rows = [(1, None), (2, ""), (3, "Мама"), (3, "Мама"), (4, LONG), (None, "a")]
    df = frame(spark, rows, "doc_id long, text string").withColumn("ids", F.lit("own")).withColumn("n_tokens", F.lit(0))
    got = bpe.encode(df).collect()
    assert len(got) == 6 and all(r.ids == [] for r in got if r.doc_id in (1, 2))
    sizes = {r.doc_id: r.n_tokens for r in bpe.count_tokens(df).collect()}
    assert sizes == {r.doc_id: len(r.ids) for r in got}
    assert bpe.encode(df.limit(0)).count() == 0


def test_encoding_refuses_a_large_vocabulary(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(bpe, "MOST_BYTES", 10)
    with pytest.raises(ValueError):
        bpe.encode(frame(spark, [], "doc_id long, text string"))


def test_distinctive_terms(spark):
    texts = {1: "а а а а а б", 2: "б б в", 3: None, 4: "", 5: "!!!", 6: "б в"}
    df = frame(spark, list(texts.items())).withColumn("term", F.lit("own")).withColumn("tf", F.lit(0))
    got = {(r.doc_id, r.term): r for r in distinctive.distinctive_terms(df).collect()}
    counts = {d: Counter(py_tokens(t)) for d, t in texts.items()}
    assert set(got) == {(d, t) for d, c in counts.items() for t in c}
    assert got[2, "б"].df == 3 and got[2, "б"].cf == 4 and got[2, "б"].tf == 2
    # brute force of one score
    import math

    k1, n1, k2, n2 = 5, 6, 0, 5
    p, p1 = k1 / (n1 + n2), k1 / n1
    want = 2 * (k1 * math.log(p1) + (n1 - k1) * math.log(1 - p1) - (k1 * math.log(p) + (n1 - k1) * math.log(1 - p)) - n2 * math.log(1 - p))
    assert got[1, "а"].score == pytest.approx(want) and got[1, "б"].score < 0
    only = distinctive.distinctive_terms(df, least_tf=5, most_df=3).collect()
    assert [(r.doc_id, r.term) for r in only] == [(1, "а")]
    assert distinctive.distinctive_terms(df.limit(0)).count() == 0
    alone = distinctive.distinctive_terms(frame(spark, [(1, "а б")])).collect()
    assert {r.score for r in alone} == {0.0}


def test_look_alikes(spark):
    rows = [(1, "Сеρый"), (1, "Сеρый"), (2, None), (3, ""), (4, "ясно"), (5, "ﬁ" * 50_000), (None, "Τялм")]
    df = frame(spark, rows).withColumn("is_case", F.lit("own"))
    got = lookalikes.normalize(df, "doc_id", "content").collect()
    assert len(got) == 7 and Counter(r.doc_id for r in got if r.is_case) == {1: 2, 5: 1, None: 1}
    assert {r.content for r in got if r.doc_id == 1} == {"Серый"}
    assert lookalikes.normalize(df, "doc_id", "content", only_cases=True).count() == 4
    assert lookalikes.normalize(df.limit(0), "doc_id", "content").count() == 0


def library(n, seed=4):
    r = random.Random(seed)
    words = "старый чердак забыл молоко возле реки но базар снова открыл тёплую книгу для мельника под высокой горой потом увидел".split()
    return [" ".join(r.choice(words) for _ in range(r.randint(8, 25))).capitalize() + f". В {r.randint(1700, 1990)} году." for _ in range(n)]


def test_garbled(spark):
    clean = library(300)
    pairs = [("utf-8", "cp1251"), ("cp1251", "latin-1"), ("cp1251", "koi8-r"), ("utf-8", "latin-1")]
    rows, bad = [], {}
    for i, t in enumerate(clean):
        rows.append((i, t))
        if i % 12 == 0:
            written, read = pairs[i // 12 % 4]
            try:
                wrong = t.encode(written).decode(read)
            except UnicodeDecodeError:
                continue
            bad[1000 + i] = t
            rows.append((1000 + i, wrong))
    part = clean[5].split(" ")
    part[2:6] = " ".join(part[2:6]).encode("utf-8").decode("latin-1").split(" ")
    rows.append((5000, " ".join(part)))
    bad[5000] = clean[5]
    rows += [(6000, None), (6001, ""), (6002, "КОНЕЦ ПЕРВОЙ ЧАСТИ"), (6003, "в селе Ђурковац"), (6004, rows[0][1])]
    df = frame(spark, rows).withColumn("chain", F.lit("own"))
    model = garbled.fit(df, "content")
    got = {r.doc_id: r for r in garbled.detect(df, "doc_id", "content", model, restored=True).collect()}
    assert set(got) == set(bad)
    assert all(got[i].restored == t for i, t in bad.items())
    assert {r.doc_id for r in garbled.detect(df, "doc_id", "content", model).collect()} == set(bad)
    empty = df.limit(0)
    assert garbled.detect(empty, "doc_id", "content", garbled.fit(empty, "content")).count() == 0


def shingles_of(text, words):
    parts = nearcopies._WORDS.findall(text.lower()) if words else nearcopies._OTHER.sub(" ", text.lower()).strip()
    return {tuple(parts[i : i + 3]) for i in range(len(parts) - 2)}


@pytest.mark.parametrize("words", [True, False])
def test_near_copies_against_brute_force(spark, words):
    r = random.Random(6)
    texts = {}
    for i, t in enumerate(library(60)):
        texts[i * 10] = t
        for k in range(r.randint(0, 3)):
            w = t.split(" ")
            for _ in range(r.randint(1, 3)):
                w[r.randrange(len(w))] = r.choice(("иной", "и", "вдруг"))
            texts[i * 10 + k + 1] = " ".join(w)
    texts |= {9001: texts[0], 9002: None, 9003: "", 9004: "аб", 9005: LONG, 9006: LONG + "ещё раз"}
    rows = [*texts.items(), (0, texts[0])]
    df = frame(spark, rows).withColumn("n", F.lit("own")).withColumn("keys", F.lit("own"))
    sets = {i: s for i, t in texts.items() if t and (s := shingles_of(t, words))}
    want = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) * 10 >= 6 * len(sets[a] | sets[b])}
    how = (nearcopies.words_shingles, nearcopies.WORDS_INDEX) if words else (nearcopies.chars_shingles, nearcopies.CHARS_INDEX)
    links, members = nearcopies.near_copies(df, "doc_id", "content", *how)
    got = [(x.id_a, x.id_b) for x in nearcopies.pairs(links, members).collect()]
    assert len(got) == len(set(got)) and set(got) <= want
    sure = {(a, b) for a, b in want if len(sets[a] & sets[b]) >= 0.7 * len(sets[a] | sets[b])}
    assert sure <= set(got) and len(got) >= 0.97 * len(want)
    links_of = {x.id: x.n_links for x in nearcopies.groups(links, members).collect()}
    assert set(links_of) == set(sets) and all(n == sum(i in p for p in got) for i, n in links_of.items())
    links, members = nearcopies.near_copies(df.limit(0), "doc_id", "content", *how)
    assert nearcopies.pairs(links, members).count() == 0


GIVEN = [("Саша", "Александр", "ru"), ("Bob", "Robert", "en"), (None, None, None)]


def test_names(spark):
    r = random.Random(9)
    surnames = ["Гегнирков", "Клацягин"] + ["".join(r.choice("бвгджзклмнпрст") + r.choice("аеиоуя") for _ in range(5)).capitalize() + r.choice(("ицын", "ейко", "овский")) for _ in range(30)]
    given = [("Иван", "Яковлевич"), ("Александр", "Олегович"), ("Захар", "Петрович")]
    values = [f"{s} {g} {p}" for k, s in enumerate(surnames) for g, p in (given[k % 3],)] + ["Гегнирков Захар Петрович"]
    own = ["Гегнирков Иван Яковлевич", "Гегнирков И. Я.", "И.Я. Гегнирков", "Gegnirkov Ivan Yakovlevich", "Гегнирков, Иван", "Гегниркоа Иван Яковлевич", "ГЕГНИРКОВ ИВАН ЯКОВЛЕВИЧ"]
    short = ["Саша Клацягин", "Клацягин Александр Олегович"]
    house = ["Издательство «Мносотамб Смагагнач»", "ИД Мносотамб Смагагнач", "Мносотамб Смагагнач (издательство)"]
    rows = [(i, v) for i, v in enumerate([*values, *own, *short, *house, None, "", " ", "Неизвестный автор", "—", values[0]])]
    df = frame(spark, rows, "id long, author string").withColumn("value", F.lit("own")).withColumn("key", F.lit(1))
    nicknames = frame(spark, GIVEN, "short_name string, full_name string, lang string")
    got = [(r.author_a, r.author_b) for r in names.link_names(df, "author", nicknames).collect()]
    assert len(got) == len(set(got)) and all(a < b for a, b in got)
    linked = set(got)
    for group in (own, short, house):
        missed = {tuple(sorted((a, b))) for a in group for b in group if a < b} - linked
        assert not missed
    assert {tuple(sorted((a, b))) for a in values for b in values if a < b} & linked == set()
    assert names.link_names(df.limit(0), "author", nicknames).count() == 0


def test_radius_join_against_brute_force(spark):
    r = random.Random(7)
    keys = sorted({"".join(r.choice("абв") for _ in range(r.randint(1, 7))) for _ in range(150)})
    got = {(x.key_a, x.key_b) for x in names.radius_join(frame(spark, [(k,) for k in keys], "key string"), 2, 16).collect()}
    codes, lengths = names.as_codes(keys)
    want = set()
    for k in keys:
        want |= {tuple(sorted((k, keys[j]))) for j in (names.distances(k, codes, lengths) <= 2).nonzero()[0] if keys[j] != k}
    assert got == want


def test_canonical_values(spark):
    genres = frame(spark, [(1, "Лирика"), (2, "Горное дело"), (3, "Космическая сага")], "genre_id int, genre string")
    other = frame(spark, [("Стихи", "Лирика\r"), ("Стихи", "Лирика\r"), ("mining", "Горное дело"), (None, "Лирика"), ("x", None)], "original string, mapped string")
    values = {
        "лирика": 1, "Ллрика": 1, "Лиирка": 1, "Lirika": 1, "kbhbrf": 1, "стихи": 1, "#Лирика": 1, "Лирика (сборник)": 1, "жанр: Лирика": 1, "дело, Горное": 2, "Горн. дело": 2, "горноедело": 2,
        "MINING": 2, "minign": 2, "Горное  дело": 2, "Космическая связь": 0, "Космичемкая сга": 3, "прочее": 0, "???": 0, "я" * 5000: 0,
    }
    books = frame(spark, [(i, v) for i, v in enumerate([*values, "Лирика", None, "", "  "])] + [(0, "лирика")], "id long, genre string").withColumn("value", F.lit("own"))
    got = {r.genre: r.genre_id for r in canonical.map_books(spark, books, genres, other).collect()}
    assert got == values
    assert canonical.map_books(spark, books, genres, other).count() == len(values)
    assert canonical.map_books(spark, books.limit(0), genres, other).count() == 0
    assert {r.genre_id for r in canonical.map_books(spark, books.filter("genre = 'лирика'"), genres.limit(0), other).collect()} == {0}


def test_work_is_dealt_out(spark):
    """Distinct rows dealt out by their own column lie in several tasks, also with adaptive execution."""
    keys = frame(spark, [(f"k{i % 500}",) for i in range(1000)], "key string").distinct()
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    out = names.dealt(keys, "key").mapInPandas(lambda it: (p.iloc[:1] for p in it), "key string").collect()
    assert tasks > 1 and len(out) == tasks


def test_twins_of_one_skeleton_all_vote(spark):
    """Of several clean lines with the same text around their other letters, each is a twin."""
    clean = [f"2001, 2002, {w} (12345678)" for w in ("домик", "лодка", "весна", "книга")]
    bad = clean[3].encode("utf-8").decode("cp1251")
    df = frame(spark, [(x,) for x in (*clean, bad)], "t string")
    model = garbled.fit(df, "t")
    assert model.votes[(("cp1251", "utf-8"),)] == 1


def test_genres_of_one_letter(spark):
    """A value is blank by its blanks, not by the letter of the pattern for them."""
    genres, other = frame(spark, [(1, "Лирика")], "genre_id int, genre string"), frame(spark, [], "original string, mapped string")
    books = frame(spark, [(1, "s"), (2, "sss"), (3, " s "), (4, "лирика"), (5, " \t\n"), (6, None)], "id long, genre string")
    assert {r.book_id: r.genre_id for r in canonical.map_books(spark, books, genres, other).collect()} == {1: 0, 2: 0, 3: 0, 4: 1}
    assert {r.value for r in canonical.map_values(spark, books, "genre", genres, other).collect()} == {"s", "sss", " s ", "лирика"}


def test_packing(spark):
    rows = [(i, n) for i, n in enumerate([5, 5, 5, 0, None, 2048, 5000, 1000, 1000, 48] * 30)]
    df = frame(spark, rows, "doc_id long, n_tokens int").withColumn("size", F.lit("own")).withColumn("container", F.lit(0))
    got = packing.pack(df).collect()
    held, filled = Counter(), Counter()
    for r in got:
        held[r.doc_id] += r["size"]
        filled[r.container] += r["size"]
    assert held == {i: n for i, n in rows if n}
    assert max(filled.values()) <= 2048
    once = Counter(r.doc_id for r in got)
    assert all(once[i] == (1 if n <= 2048 else 3) for i, n in rows if n)
    total = packing.report(packing.pack(df)).first()
    assert total.containers == len(filled) and 0.9 < total.share <= 1
    assert packing.pack(df.limit(0)).count() == 0
    assert packing.pack(df.filter("n_tokens is null")).count() == 0


def test_truncated(spark):
    r = random.Random(8)
    whole = library(400)
    rows = [(i, t, "a") for i, t in enumerate(whole)]
    cut_ids = set()
    for i in range(40):
        t = whole[i]
        k = t.find(" ", len(t) // 2) + 1 + r.randint(1, 2)
        if t[k : k + 1].isalpha() and t[k - 1].isalpha():
            rows.append((1000 + i, t[:k] + r.choice(("", " [...]")), None))
            cut_ids.add(1000 + i)
    rows += [(2000, None, "a"), (2001, "", None), (2002, " \n", "b"), (2003, LONG, "b"), (2003, LONG, "b")]
    df = frame(spark, rows, "doc_id long, text string, source string").withColumn("kind", F.lit("own")).withColumn("_s", F.lit(1))
    found = truncated.find_truncated(df)
    got = {x.doc_id for x in found.filter("truncated").collect()}
    assert not got & set(range(400)) and not got & {2000, 2001, 2002, 2003}
    assert len(got & cut_ids) >= 0.9 * len(cut_ids)
    shares = {x.source: x for x in truncated.by_source(found).collect()}
    assert shares[None].n_truncated == len(got) and shares["b"].n == 3 and shares["b"].share == 0
    assert truncated.find_truncated(df.limit(0)).count() == 0


def test_truncated_ends_that_occur_often(spark):
    """Cut texts stay found however often their last characters close texts; lines that close different texts stay whole."""
    texts = library(300)
    rows = [(i, t, "a") for i, t in enumerate(texts)]
    often = {1000 + i: f"{texts[i]}\n{texts[i + 1][:60]} и потом над городом" for i in range(12)}
    again = {2000 + i: f"{texts[40]}\nИ потом над городом" for i in range(6)}
    closed = {3000 + i: f"{texts[60 + i]}\n\nКонец" for i in range(12)}
    signed = {4000 + i: f"{texts[80 + i]}\nЗаписал {name}" for i, name in enumerate(("Слазгей", "Клялдей", "Пошис", "Смазан", "Дувр", "Нудман"))}
    rows += [(i, t, "b") for part in (often, again, closed, signed) for i, t in part.items()]
    found = truncated.find_truncated(frame(spark, rows, "doc_id long, text string, source string"))
    assert found.count() == len(rows)
    got = {x.doc_id for x in found.filter("truncated").collect()}
    assert got >= {*often, *again} and not got & {*closed, *signed}
