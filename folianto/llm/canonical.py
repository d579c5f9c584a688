"""Mapping free-entered values to a canonical list, in SQL only.

Every value is brought to a few plain forms (letters and digits in lower case; the same typed on the Russian keyboard
layout; parts around a comma swapped), every canonical wording likewise (also in Latin letters). Forms meet by the pigeonhole principle:
a wording is cut into k + 1 segments, and a form within k edits holds at least one of them, moved by k places at most.
Segments and positional substrings are joined by equality and verified with ``levenshtein``.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from folianto.plans.lineage import cut

# The Russian keyboard layout over the Latin one, and the transliteration of Russian.
LATIN_KEYS = "`qwertyuiop[]asdfghjkl;'zxcvbnm,." + '~{}:"<>'
RUSSIAN_KEYS = "ёйцукенгшщзхъфывапролджэячсмитьбю" + "ёхъжэбю"
TRANSLIT_MANY = {"ж": "zh", "х": "kh", "ц": "ts", "ч": "ch", "ш": "sh", "щ": "shch", "ю": "yu", "я": "ya"}
TRANSLIT_ONE = ("абвгдеёзийклмнопрстуфыэъь", "abvgdeeziyklmnoprstufye")

#: Edits allowed by the length of the wording: one below the first length, two below the second, three below the third, else four.
EDITS = (5, 7, 9)
#: Most (edits + edits between the sorted letters) / 2 by the length of the wording: a swap of neighbours counts 1, a letter left out or added 1, a letter replaced 1.5.
TYPOS = ((5, 1.5), (7, 2), (10_000, 3))


def _q(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _bare(x: str) -> str:
    """Decorations taken off: a label before a colon, a remark in brackets or after a slash, an age mark."""
    for pattern in (r"^\s*[\p{L}]{2,12}\s*:\s*", r"\s*\([^)]*\)\s*$", r"\s+/\s.*$", r"\s+\d{1,2}\+\s*$"):
        x = f"regexp_replace({x}, {_q(pattern)}, '')"
    return x


def _plain(x: str) -> str:
    return f"regexp_replace(translate(lower({x}), 'ё', 'е'), '[^\\\\p{{L}}\\\\p{{N}}]+', '')"


def _latin(x: str) -> str:
    x = f"translate({x}, {_q(TRANSLIT_ONE[0])}, {_q(TRANSLIT_ONE[1])})"
    for a, b in TRANSLIT_MANY.items():
        x = f"replace({x}, '{a}', '{b}')"
    return x


def _swapped(x: str) -> str:
    return f"regexp_replace({x}, '^(.*?),\\\\s*(.*)$', '$2 $1')"


def _typed(x: str) -> str:
    return f"translate(lower({x}), {_q(LATIN_KEYS)}, {_q(RUSSIAN_KEYS)})"


def _letters(x: str) -> str:
    return f"array_join(array_sort(split({x}, '')), '')"


def _typos(a: str, b: str) -> str:
    return f"(levenshtein({a}, {b}) + levenshtein({_letters(a)}, {_letters(b)})) / 2"


def _k(n: str) -> str:
    return f"case when {n} < {EDITS[0]} then 1 when {n} < {EDITS[1]} then 2 when {n} < {EDITS[2]} then 3 else 4 end"


_SQL = f"""
with wordings as (
  select genre as wording, genre_id from @genre_list@ where genre is not null
  union
  select m.original, g.genre_id from @genre_map@ m join @genre_list@ g on regexp_replace(m.mapped, '[\\\\r\\\\n]+$', '') = g.genre where m.original is not null
),
forms as (
  select form, min(genre_id) as genre_id from (
    select {_plain("wording")} as form, genre_id from wordings
    union all select {_latin(_plain("wording"))}, genre_id from wordings)
  where form <> '' group by form
),
vals as (select distinct value from @values@ where value is not null and trim(regexp_replace(value, '\\\\s+', ' ')) <> ''),
bare as (select value, {_bare("value")} as b, {_bare(_typed("value"))} as kb from vals),
variants as (
  select /*+ repartition(%tasks%, value) */ value, variant, min(kind) as kind from bare lateral view inline(array(
    struct({_plain("b")}, 0), struct({_plain("value")}, 1), struct({_plain(_swapped("b"))}, 2),
    struct({_plain("kb")}, 3), struct({_plain(_swapped("kb"))}, 4), struct({_plain(_typed("value"))}, 5))) t as variant, kind
  where variant <> '' group by value, variant
),
sized as (select form, genre_id, length(form) as n, {_k("length(form)")} as k from forms),
cut_points as (select distinct n, k from sized),
segments as (
  select form, genre_id, n, k, i, substring(form, cast(i * n div (k + 1) as int) + 1, cast((i + 1) * n div (k + 1) - i * n div (k + 1) as int)) as piece
  from sized lateral view explode(sequence(0, k)) as i
),
probes as (
  select distinct value, variant, kind, n, i, substring(variant, start, len) as piece from (
    select v.value, v.variant, v.kind, c.n, i, length(v.variant) as m, cast(i * c.n div (c.k + 1) as int) + 1 + shift as start,
           cast((i + 1) * c.n div (c.k + 1) - i * c.n div (c.k + 1) as int) as len
    from variants v join cut_points c on c.n between length(v.variant) - 4 and length(v.variant) + 4 and abs(c.n - length(v.variant)) <= c.k
    lateral view explode(sequence(0, c.k)) as i lateral view explode(sequence(-c.k, c.k)) as shift)
  where start >= 1 and len > 0 and start + len - 1 <= m
),
near as (
  select distinct p.value, p.kind, s.genre_id, levenshtein(p.variant, s.form) as edits, s.k, s.n, {_typos("p.variant", "s.form")} as typos
  from probes p join segments s on p.n = s.n and p.i = s.i and p.piece = s.piece
),
abbreviated as (
  select value, genre_id, 0 as edits, 6 as kind from (
    select value, {_plain("regexp_extract(b, '^(.+?)\\\\.\\\\s*(.+)$', 1)")} as head, {_plain("regexp_extract(b, '^(.+?)\\\\.\\\\s*(.+)$', 2)")} as tail from bare) a
  join (select genre_id, {_plain("substring_index(wording, ' ', 1)")} as first, {_plain("substring(wording, length(substring_index(wording, ' ', 1)) + 1)")} as rest from wordings) w
  on a.tail = w.rest and a.tail <> '' and length(a.head) >= 2 and startswith(w.first, a.head)
),
best as (
  select value, min_by(genre_id, struct(typos, edits, kind, genre_id)) as genre_id, min(edits) as edits from (
    select value, genre_id, edits, kind, typos from near where edits <= k and typos <= case {' '.join(f'when n < {n} then {most}' for n, most in TYPOS)} end
    union all select value, genre_id, edits, kind, 0 from abbreviated)
  group by value
)
"""


def map_values(spark: SparkSession, values: DataFrame, column: str, genre_list: DataFrame, genre_map: DataFrame) -> DataFrame:
    """``(value, genre_id INT, edits INT)`` for each distinct value that is neither null nor blank.

    The closest wording wins, on ties the plainer form, then the smaller id. Values without a wording within the allowed
    edits come out with ``genre_id`` 0 and null ``edits`` (found by an anti join). Wordings are the entries and the other
    wordings of ``genre_map`` that lead to an entry; carriage returns and repeated rows there do no harm. Other columns of the
    inputs are not read; empty tables give no rows, an empty list leaves every value unmatched.
    """
    sql = re.sub(r"@(\w+)@", r"{\1}", _SQL.replace("{", "{{").replace("}", "}}"))
    # few bytes, but much work for each value: a number of tasks that isn't reduced to the bytes, behind the last step that would bring them together
    sql = sql.replace("%tasks%", spark.conf.get("spark.sql.shuffle.partitions"))
    values = values.select(values[column].alias("value"))
    best = cut(spark.sql(sql + "select value, genre_id, edits from best", values=values, genre_list=genre_list, genre_map=genre_map))
    return spark.sql(
        r"""select value, genre_id, edits from {best}
            union all
            select v.value, 0, null from (select distinct value from {values} where trim(regexp_replace(value, '\\s+', ' ')) <> '') v left anti join {best} b on v.value = b.value""",
        best=best, values=values,
    )


def map_books(spark: SparkSession, books: DataFrame, genre_list: DataFrame, genre_map: DataFrame) -> DataFrame:
    """``(book_id, genre, genre_id)`` for every book whose genre is neither null nor blank nor, as stored, an entry."""
    wanted = spark.sql(
        r"""select distinct id as book_id, genre from {books} b where trim(regexp_replace(genre, '\\s+', ' ')) <> ''
            and not exists (select 1 from {genre_list} g where g.genre = b.genre)""",
        books=books, genre_list=genre_list,
    )
    mapped = map_values(spark, wanted, "genre", genre_list, genre_map)
    return spark.sql("select w.book_id, w.genre, m.genre_id from {wanted} w join {mapped} m on w.genre = m.value", wanted=wanted, mapped=mapped)
