"""The queries of the search engine over the driver's tables, and their SQL.

``documents`` serves as a corpus of chunks: ids as they are, title ``doc-<id>``, author the source, genre the language.
"""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable, Iterable
from itertools import count

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folianto.functions.ranking import idf
from folianto.functions.stemming import EN_KEPT, EN_SPECIAL, EN_STEP2, EN_STEP3, EN_STEP4, stem_column
from folianto.functions.text import LOWER, UPPER, tokens
from folianto.operators import indexing
from folianto.operators.chunking import chunk_rows, ellipsis, sentence_rows
from folianto.operators.indexing import Index
from folianto.operators.search import Engine, highlight_terms, search_terms
from folianto.plans.lineage import shared_dir
from folianto.plans.query import And, Node, Not, Or, Phrase, Term, match, match_phrase, query_string, words_in
from folianto.plans.sizes import spread
from folianto.sources.files import parse_files
from folianto.sources.metadata import book_id, file_name, filename_fields, map_genre

Query = Callable[[SparkSession, str], DataFrame]


# Characters that Windows-1251 has, as used in Russian text.
_CP1251 = "\\x00-\\x7F\u0401\u0410-\u044F\u0451«»—–…„“”№’‘"


def _documents(spark: SparkSession, d: str) -> DataFrame:
    return spread(spark.read.parquet(f"{d}/documents.parquet"))


@functools.lru_cache(8)
def _index(spark: SparkSession, d: str, language: str | None = None) -> Index:
    """The corpus as a stored index, written once for all queries of a session."""
    return _over_texts(spark, d, language).save(spark, f"{shared_dir(spark)}/folianto-index-{uuid.uuid4().hex}")


def _over_texts(spark: SparkSession, d: str, language: str | None = None) -> Index:
    docs = _documents(spark, d)
    return Index.over_texts(docs, "doc_id", "text", F.concat(F.lit("doc-"), "doc_id"), F.col("source"), F.col("lang"), language)


#: Name: query, how it is built, how many hits, and filters.
SEARCHES: dict[str, tuple[str, Callable[[str], Node], int, dict[str, str]]] = {
    "term_search_topk": ("чердак", query_string, 20, {}),
    "term_search_upper_case": ("Рыба", query_string, 20, {}),
    "and_search": ("the and", query_string, 50, {}),
    "and_three_terms": ("забор молоко чердак", query_string, 50, {}),
    "or_search": ("забор | market", query_string, 50, {}),
    "not_search": ("базар -забор", query_string, 50, {}),
    "leading_not_search": ("-забор базар", query_string, 50, {}),
    "only_not_search": ("-базар", query_string, 20, {}),
    "double_not_search": ("молоко --забор", query_string, 50, {}),
    "or_not_or_search": ("забор | -чердак | молоко", query_string, 50, {}),
    "nested_or_not_search": ("забор | (молоко | -чердак)", query_string, 50, {}),
    "grouped_search": ("(забор | базар) молоко", query_string, 50, {}),
    "match_or_search": ("базар молоко рыба", match, 50, {}),
    "phrase_search": ("уже были здесь", match_phrase, 50, {}),
    "phrase_alternatives": ('"были (здесь | там | тут) где"', query_string, 50, {}),
    "phrase_first_slot_alternative": ('"(чтобы | уже) потом"', query_string, 50, {}),
    "not_phrase_search": ('чердак -"уже были здесь"', query_string, 50, {}),
    "repeated_term_search": ("чердак чердак", query_string, 20, {}),
    "filter_genre_after_topk": ("the", query_string, 100, {"genre": "en"}),
    "filter_author_after_topk": ("забор", query_string, 100, {"author": "omnibus_feed"}),
    "filter_title_substring": ("забор", query_string, 100, {"title": "doc-1"}),
}


def _search(query: str, build: Callable[[str], Node], k: int, filters: dict[str, str]) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        hits = Engine(_index(spark, d)).execute(build(query), k, **filters)
        return hits.select("doc_id", F.round(F.col("bm25_score").cast("double"), 6).alias("score"), "title", "author", "genre")

    return run


# --- the SQL of a search: relations joined step by step, another way than the engine's single column ------------------------

_UP, _LOW = UPPER + "ё", LOWER.replace("ё", "е") + "е"
_CLASS = r"\x{0400}-\x{04FF}A-Za-z\x{00C0}-\x{024F}\x{0370}-\x{03FF}"
_LIST = f"regexp_extract_all(translate(coalesce(text, ''), '{_UP}', '{_LOW}'), '[{_CLASS}0-9]+')"
_TOKENS = f"""d as (select doc_id, {_LIST} as ts from documents),
tk as (select doc_id, unnest(ts) as term, generate_subscripts(ts, 1) - 1 as pos from d)"""
_RANKED = """po as (select doc_id, term, count(*) as tf from tk group by 1, 2),
le as (select term, count(*) as df from po group by 1),
st as (select count(*) as n, sum(len(ts))::double / count(*) as avgdl from d where len(ts) > 0),
idf as (select term, ln((n - df + 0.5::double) / (df + 0.5::double) + 1::double) as idf from le, st),
sc as (select doc_id, term, (idf * ((tf * 2.2::double) / (tf + 1.2::double * (0.25::double + 0.75::double * (tf / avgdl)))))::float as s from po join idf using (term), st)"""
_POSTINGS = f"{_TOKENS},\n{_RANKED}"

# the public Russian stemming rules as steps on the part of a word behind its first vowel; ``vocabulary`` holds the words
_STEMS = r"""words as (select term, regexp_extract(term, '^[^@V@]*[@V@]') as pre, regexp_extract(term, '^[^@V@]*[@V@]+[^@V@]') as m1 from vocabulary),
regions as (select *, case when m1 = '' then '' else regexp_extract(substr(term, length(m1) + 1), '^[^@V@]*[@V@]+[^@V@]') end as m2 from words),
s0 as (select term, case when pre = '' then term else pre end as pre, case when pre = '' then '' else substr(term, length(pre) + 1) end as rv, case when m2 = '' then length(term) else length(m1) + length(m2) end as p2 from regions),
s1 as (select *, regexp_replace(rv, '(([ая])(вшись|вши|в)|(ившись|ивши|ив|ывшись|ывши|ыв))$', '\2') as gerund, regexp_replace(rv, '(ся|сь)$', '') as rest from s0),
s2 as (select *, regexp_replace(rest, '(ее|ие|ые|ое|ими|ыми|ей|ий|ый|ой|ем|им|ым|ом|его|ого|ему|ому|их|ых|ую|юю|ая|яя|ою|ею)$', '') as adjective from s1),
s3 as (select *, regexp_replace(adjective, '(([ая])(ем|нн|вш|ющ|щ)|(ивш|ывш|ующ))$', '\2') as adjectival,
  regexp_replace(rest, '(([ая])(ла|на|ете|йте|ли|й|л|ем|н|ло|но|ет|ют|ны|ть|ешь|нно)|(ила|ыла|ена|ейте|уйте|ите|или|ыли|ей|уй|ил|ыл|им|ым|ен|ило|ыло|ено|ят|ует|уют|ит|ыт|ены|ить|ыть|ишь|ую|ю))$', '\2') as verb,
  regexp_replace(rest, '(а|ев|ов|ие|ье|е|иями|ями|ами|еи|ии|и|ией|ей|ой|ий|й|иям|ям|ием|ем|ам|ом|о|у|ах|иях|ях|ы|ь|ию|ью|ю|ия|ья|я)$', '') as noun from s2),
s4 as (select term, pre, p2, regexp_replace(case when gerund <> rv then gerund when adjective <> rest then adjectival when verb <> rest then verb else noun end, 'и$', '') as x from s3),
s5 as (select term, pre, case when x like '%ость' and length(pre) + length(x) - 4 >= p2 then x[:-5] when x like '%ост' and length(pre) + length(x) - 3 >= p2 then x[:-4] else x end as x from s4),
stems as (select term, pre || case when regexp_matches(x, 'ейше?$') then regexp_replace(regexp_replace(x, 'ейше?$', ''), 'нн$', 'н') when x like '%нн' then x[:-2] when x like '%ь' then x[:-2] else x end as stem from s5)""".replace("@V@", "аеиоуыэюя")


# the chunker in SQL: paragraphs are packed by a walk along each text, sentences and words of very long paragraphs by another one
_CHUNKS = r"""src as (@source@),
lines as (select doc_id, list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: replace(replace(x, '...', '…'), '. . .', '…')), lambda x: x <> '') as ls from src),
flat as (select doc_id, unnest(range(1, len(ls) + 1)) as i, unnest(ls) as line from lines),
sent as (select doc_id, i, line, list_filter(list_transform(string_split(regexp_replace(line, '([.!?])[ \n\r]+', '\1' || chr(1), 'g'), chr(1)), lambda x: case when ltrim(x, ' ') = '' then x else ltrim(x, ' ') end), lambda x: x <> '') as ss from flat where length(line) > 3500),
parts as (select doc_id, i, words, case when words then list_filter(string_split(case when len(ss) = 0 then line else ss[1] end, ' '), lambda w: w <> '') else ss end as ps from (select *, len(ss) = 0 or (len(ss) = 1 and length(ss[1]) > 3500) as words from sent)),
pk as (select doc_id, i, words, ps, 1 as k, '' as cur, []::varchar[] as done from parts
  union all select doc_id, i, words, ps, k + 1,
    case when alone then '' when fits then case when cur = '' then p else cur || ' ' || p end else p end,
    case when alone then list_concat(done, case when cur = '' then [p] else [cur, p] end) when fits or cur = '' then done else list_append(done, cur) end
  from (select *, ps[k] as p, not words and length(ps[k]) > 1800 as alone, length(cur) + length(ps[k]) + (cur <> '')::int <= case when words then 3500 else 1800 end as fits from pk where k <= len(ps))),
packed as (select doc_id, i, case when cur = '' then done else list_append(done, cur) end as pieces from pk where k = len(ps) + 1),
st as (select doc_id, ls, 1 as k, '' as cur, []::varchar[] as done from lines
  union all select doc_id, ls, k + 1,
    case when pieces is not null then '' when fits then case when length(cur) + length(line) + (cur <> '')::int >= 1800 then '' else jn end else line end,
    case when pieces is not null then list_concat(case when cur = '' then done else list_append(done, cur) end, pieces)
         when fits then case when length(jn) >= 1800 then list_append(done, jn) else done end when cur = '' then done else list_append(done, cur) end
  from (select s.*, ls[k] as line, pieces, length(cur) + length(ls[k]) + (cur <> '')::int <= 3500 as fits, case when cur = '' then ls[k] else cur || chr(10) || ls[k] end as jn
        from st s left join packed on packed.doc_id = s.doc_id and packed.i = s.k where k <= len(ls))),
ch as (select doc_id, case when cur = '' then done when len(done) > 0 and length(cur) < 300 and length(done[-1]) + length(cur) + 1 <= 3500 then list_append(done[:-2], done[-1] || chr(10) || cur) else list_append(done, cur) end as pieces from st where k = len(ls) + 1),
chunked as (select doc_id, (generate_subscripts(pieces, 1) - 1)::bigint as idx, unnest(pieces) as content from ch)"""
_BOOK_ID = """(case when h >= 9223372036854775808 then h - 18446744073709551616 else h end)::bigint"""
_BOOK_HASH = """('0x' || substr(sha256(regexp_replace(regexp_replace(translate(coalesce(file_path, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '\\.gz$', ''), '\\.txt$', '')
    || '|' || coalesce(title, '') || '|' || coalesce(author, '')), 1, 16))::ubigint::hugeint"""


def _fold(word: str) -> str:
    return word.translate(str.maketrans(_UP, _LOW))


class _Sql:
    def __init__(self, term: Callable[[str], str] = lambda word: f"'{_fold(word)}'") -> None:
        self.steps: list[str] = []
        self.term = term
        self.names = (f"r{i}" for i in count())

    def step(self, sql: str) -> str:
        name = next(self.names)
        self.steps.append(f"{name} as ({sql})")
        return name

    def plus(self, acc: str | None, x: str) -> str:
        if acc is None:
            return x
        return self.step(f"select coalesce(a.doc_id, x.doc_id) as doc_id, case when x.s is null then a.s else (coalesce(a.s, 0::float) + x.s)::float end as s from {acc} a full outer join {x} x on a.doc_id = x.doc_id")

    def without(self, acc: str | None, x: str | None) -> str | None:
        return acc if acc is None or x is None else self.step(f"select * from {acc} where doc_id not in (select doc_id from {x})")

    def run(self, node: Node, acc: str | None) -> str | None:
        match node:
            case Term(text):
                return self.plus(acc, self.step(f"select doc_id, s from sc where term = {self.term(text)}"))
            case Phrase(positions):
                first = [_fold(w) for w in positions[0]]
                joins = "".join(
                    f" join tk t{i} on t{i}.doc_id = t0.doc_id and t{i}.pos = t0.pos + {i} and t{i}.term in ({', '.join(repr(_fold(w)) for w in words)})" for i, words in enumerate(positions[1:], 1)
                )
                found = f"select distinct t0.doc_id from tk t0{joins} where t0.term = '{first[0]}'"
                total = " + ".join(f"coalesce((select max(s) from sc where sc.doc_id = f.doc_id and term = '{w}'), 0::float)" for w in first)
                return self.plus(acc, self.step(f"select doc_id, ({total})::float as s from ({found}) f"))
            case Not(child):
                return self.without(acc, self.run(child, None))
            case Or(children):
                for child in children:
                    acc = self.run(child, acc)
                return acc
            case And(children):
                both, begun = None, False
                for child in children:
                    if isinstance(child, Not):
                        both = self.without(both, self.run(child.child, None)) if begun else both
                    else:
                        x = self.run(child, None)
                        if x is None:
                            x = self.step("select doc_id, s from sc where false")
                        both = self.step(f"select a.doc_id, (a.s + x.s)::float as s from {both} a join {x} x on a.doc_id = x.doc_id") if begun else x
                        begun = True
                return acc if both is None else self.plus(acc, both)
        raise TypeError(node)


def _search_sql(query: str, build: Callable[[str], Node], k: int, filters: dict[str, str]) -> str:
    sql = _Sql()
    out = sql.run(build(query), None) or sql.step("select doc_id, s from sc where false")
    where = " and ".join({"genre": f"lang = '{v}'", "author": f"source = '{v}'", "title": f"contains('doc-' || doc_id, '{v}')"}[c] for c, v in filters.items()) or "true"
    return f"""with {_POSTINGS}, {', '.join(sql.steps)}
select doc_id, round(s::double, 6) as score, 'doc-' || doc_id as title, source as author, lang as genre
from (select * from {out} order by s desc, doc_id limit {k}) join documents using (doc_id) where {where}"""


def _english_sql() -> str:
    """The public English stemming rules as steps over ``vocabulary``; the endings are the stemmer's fixed values."""

    def ending(word: str, endings: Iterable[str]) -> str:
        return f"regexp_extract({word}, '({'|'.join(endings)})$')"

    def replaced(e: str, table: dict[str, str]) -> str:
        return f"case {e} " + " ".join(f"when '{a}' then '{b}'" for a, b in table.items()) + " end"

    region, short = "'^[^aeiouy]*[aeiouy]+[^aeiouy]'", "(regexp_matches({0}, '^[aeiouy][^aeiouy]$') or regexp_matches({0}, '[^aeiouy][aeiouy][^aeiouywxY]$'))"
    special = " ".join(f"when '{a}' then '{b}'" for a, b in EN_SPECIAL.items())
    kept = ", ".join(f"'{w}'" for w in EN_KEPT)
    return f"""e0 as (select term, case term {special} end as special, array_to_string(list_transform(range(1, length(term) + 1), lambda i: case when term[i] = 'y' and (i = 1 or term[i - 1] in ('a', 'e', 'i', 'o', 'u', 'y')) then 'Y' else term[i] end), '') as w from vocabulary),
e1 as (select *, case when regexp_matches(w, '^(gener|arsen)') then 5 when starts_with(w, 'commun') then 6 when regexp_matches(w, {region}) then length(regexp_extract(w, {region})) else length(w) end as r1 from e0),
e2 as (select *, case when regexp_matches(substr(w, r1 + 1), {region}) then r1 + length(regexp_extract(substr(w, r1 + 1), {region})) else length(w) end as r2,
  case when w like '%sses' then w[:-3] when regexp_matches(w, 'ie[ds]$') then case when length(w) > 4 then w[:-3] else w[:-2] end when regexp_matches(w, '[aeiouy].*[^us]s$') then w[:-2] else w end as a from e1),
e3 as (select *, {ending('a', ('eedly', 'eed', 'edly', 'ed', 'ingly', 'ing'))} as x from e2),
e4 as (select *, left(a, length(a) - length(x)) as t from e3),
e5 as (select *, case when a in ({kept}) then a when x like 'eed%' then case when length(t) >= r1 then t || 'ee' else a end
  when x <> '' and regexp_matches(t, '[aeiouy]') then case when regexp_matches(t, '(at|bl|iz)$') then t || 'e' when regexp_matches(t, '(bb|dd|ff|gg|mm|nn|pp|rr|tt)$') then t[:-2] when r1 >= length(t) and {short.format('t')} then t || 'e' else t end else a end as b from e4),
e6 as (select *, case when regexp_matches(b, '.[^aeiouy][yY]$') then b[:-2] || 'i' else b end as c from e5),
e7 as (select *, {ending('c', EN_STEP2)} as x2 from e6),
e8 as (select *, left(c, length(c) - length(x2)) as t2 from e7),
e9 as (select *, case when x2 = '' or length(t2) < r1 then c when x2 = 'ogi' then case when t2 like '%l' then t2 || 'og' else c end when x2 = 'li' then case when regexp_matches(t2, '[cdeghkmnrt]$') then t2 else c end else t2 || {replaced('x2', EN_STEP2)} end as d from e8),
e10 as (select *, {ending('d', EN_STEP3)} as x3 from e9),
e11 as (select *, left(d, length(d) - length(x3)) as t3 from e10),
e12 as (select *, case when x3 = '' or length(t3) < r1 or (x3 = 'ative' and length(t3) < r2) then d else t3 || {replaced('x3', EN_STEP3)} end as f from e11),
e13 as (select *, {ending('f', EN_STEP4)} as x4 from e12),
e14 as (select *, left(f, length(f) - length(x4)) as t4 from e13),
e15 as (select *, case when x4 = '' or length(t4) < r2 or (x4 = 'ion' and not regexp_matches(t4, '[st]$')) then f else t4 end as g from e14),
english as (select term, case when length(term) <= 2 then term when special is not null then special when a in ({kept}) then a
  else replace(case when g like '%e' and (length(g) - 1 >= r2 or length(g) - 1 >= r1 and not {short.format('g[:-2]')}) then g[:-2] when g like '%ll' and length(g) - 1 >= r2 then g[:-2] else g end, 'Y', 'y') end as english from e15)"""


def _stemmed_sql(query: str, k: int) -> str:
    """A search over stems; the query's words are stemmed by the same steps."""
    sql = _Sql(lambda word: f"(select stem from stems where term = '{_fold(word)}')")
    tree = query_string(query)
    out = sql.run(tree, None)
    words = ", ".join(f"('{_fold(w)}')" for w in words_in(tree))
    return f"""with {_TOKENS.replace('tk as (', 'tk0 as (')},
vocabulary as (select term from tk0 union values {words}),
{_STEMS},
tk as (select doc_id, stem as term, pos from tk0 join stems using (term)),
{_RANKED}, {', '.join(sql.steps)}
select doc_id, round(s::double, 6) as score, 'doc-' || doc_id as title from {out} order by s desc, doc_id limit {k}"""


def _highlight_sql(line: str) -> str:
    """Byte spans of the words in the best 50 hits: a text is split at a word, and what stands beside each cut decides."""
    sql = _Sql()
    out = sql.run(match(line), None)
    words = ", ".join(f"('{w}')" for w in line.split())
    return f"""with {_POSTINGS}, {', '.join(sql.steps)},
hits as (select doc_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from (select * from {out} order by s desc, doc_id limit 50) join documents using (doc_id)),
cuts as (select doc_id, term, string_split(t, term) as ps from hits, (values {words}) as v(term)),
each as (select *, unnest(range(1, len(ps))) as i from cuts),
around as (select doc_id, (list_sum(list_transform(ps[1:i], lambda x: strlen(x))) + (i - 1) * strlen(term))::bigint as "offset", strlen(term) as length,
    case when ps[i] <> '' then right(ps[i], 1) when i > 1 then right(term, 1) else '' end as a, case when ps[i + 1] <> '' then left(ps[i + 1], 1) when i + 1 < len(ps) then left(term, 1) else '' end as b from each)
select doc_id, "offset", length from around where not regexp_matches(a || b, '[A-Za-z0-9]')"""


# --- analysis ---------------------------------------------------------------------------------------------------------------


def tokenize_counts(spark: SparkSession, d: str) -> DataFrame:
    return _documents(spark, d).select("doc_id", F.size(tokens(F.col("text"))).cast("long").alias("n_tokens"))


def tokens_positions(spark: SparkSession, d: str) -> DataFrame:
    return indexing.positions(_documents(spark, d), "doc_id", "text").select("doc_id", F.col("pos").cast("long").alias("pos"), "term")


def tokenize_no_digits(spark: SparkSession, d: str) -> DataFrame:
    return _documents(spark, d).select("doc_id", F.size(tokens(F.col("text"), keep_digits=False)).cast("long").alias("n_tokens"))


def tokenize_keep_yo(spark: SparkSession, d: str) -> DataFrame:
    terms = indexing.positions(_documents(spark, d), "doc_id", "text", normalize_yo=False)
    return terms.groupBy("term").agg(F.count("*").alias("n"))


def chars_words_count(spark: SparkSession, d: str) -> DataFrame:
    df = spark.read.parquet(f"{d}/chunks.parquet").select("doc_id", "content").distinct()
    return df.select("doc_id", F.char_length("content").cast("long").alias("char_count"), F.size(tokens(F.col("content"))).cast("long").alias("word_count"))


def postings_tf(spark: SparkSession, d: str) -> DataFrame:
    return _index(spark, d).postings.select("term", "doc_id", F.col("tf").cast("long").alias("tf"))


def postings_positions(spark: SparkSession, d: str) -> DataFrame:
    return _index(spark, d).postings.select("term", "doc_id", F.array_join(F.col("positions").cast("array<string>"), " ").alias("positions"))


def lexicon_df(spark: SparkSession, d: str) -> DataFrame:
    return _index(spark, d).lexicon


def corpus_stats(spark: SparkSession, d: str) -> DataFrame:
    return _index(spark, d).stats.select("doc_count", "total_term_count", F.round("avg_doc_length", 6).alias("avg_doc_length"))


def idf_table(spark: SparkSession, d: str) -> DataFrame:
    index = _index(spark, d)
    rows = index.lexicon.crossJoin(F.broadcast(index.stats))  # one row
    return rows.select("term", F.round(idf(F.col("doc_count"), F.col("df")), 6).alias("idf"))


def stem_vocabulary(spark: SparkSession, d: str) -> DataFrame:
    words = _index(spark, d).lexicon.select("term")
    return words.select("term", stem_column(F.col("term"), "russian").alias("russian"), stem_column(F.col("term"), "english").alias("english"))


def stem_russian(spark: SparkSession, d: str) -> DataFrame:
    return _index(spark, d).lexicon.select("term", stem_column(F.col("term"), "russian").alias("stem"))


STEMMED = "чердаками | деревне"


def stemmed_search(spark: SparkSession, d: str) -> DataFrame:
    hits = Engine(_index(spark, d, "russian")).execute(query_string(STEMMED), 50)
    return hits.select("doc_id", F.round(F.col("bm25_score").cast("double"), 6).alias("score"), "title")


def true_length_search(spark: SparkSession, d: str) -> DataFrame:
    hits = Engine(_index(spark, d), "doc").execute(query_string("чердак"), 50)
    return hits.select("doc_id", F.round(F.col("bm25_score").cast("double"), 6).alias("score"))


def prefiltered_search(spark: SparkSession, d: str) -> DataFrame:
    hits = Engine(_index(spark, d)).execute(query_string("забор"), 20, author="omnibus_feed", prefilter=True)
    return hits.select("doc_id", F.round(F.col("bm25_score").cast("double"), 6).alias("score"))


def match_all_empty(spark: SparkSession, d: str) -> DataFrame:
    return Engine(_index(spark, d)).execute(And(), 20).select("doc_id", "title")


def match_all_first(spark: SparkSession, d: str) -> DataFrame:
    return Engine(_index(spark, d)).match_all(20, genre="en").select("doc_id", "title", "genre")


def inmemory_or_search(spark: SparkSession, d: str) -> DataFrame:
    hits = search_terms(_over_texts(spark, d), ["молоко", "забор", "молоко", "the"], 50)
    return hits.select("doc_id", F.round(F.col("bm25_score").cast("double"), 6).alias("score"))


def highlight_offsets(spark: SparkSession, d: str) -> DataFrame:
    line = "чердак market"
    hits = Engine(_index(spark, d)).execute(match(line), 50, terms=highlight_terms(line))
    return hits.select("doc_id", F.explode("highlights").alias("h")).select("doc_id", "h.offset", "h.length")


def chunk_documents(spark: SparkSession, d: str) -> DataFrame:
    rows = chunk_rows(_documents(spark, d).select("doc_id", "text"), "text")
    return rows.select("doc_id", F.col("idx").cast("long").alias("idx"), "content")


def txt_parse(spark: SparkSession, d: str) -> DataFrame:
    """Every document as the bytes of a text file in UTF-8, parsed."""
    text = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    files = _documents(spark, d).select(F.concat(F.lit("/doc-"), "doc_id", F.lit(".txt")).alias("path"), text.alias("content"))
    return parse_files(files).select("file_path", "title", "content", "encoding", "error")


def txt_parse_cp1251(spark: SparkSession, d: str) -> DataFrame:
    """Every Russian text that Windows-1251 can hold as the bytes of a file in it: encoding detected, text restored."""
    high = "".join(map(chr, [0x401, *range(0x410, 0x450), 0x451])) + "«»–—…„“”№’‘"
    docs = _documents(spark, d).filter(F.col("text").rlike(f"^[{_CP1251}]*$") & (F.length(F.regexp_replace("text", "[^а-яё]", "")) >= 20))
    files = docs.select(F.concat(F.lit("/doc-"), "doc_id", F.lit(".txt")).alias("path"), F.encode(F.translate("text", high, high.encode("cp1251").decode("latin-1")), "ISO-8859-1").alias("content"))
    return parse_files(files).select("file_path", "content", "encoding")


def fb2_parse(spark: SparkSession, d: str) -> DataFrame:
    """Every book's title and author as an FB2 file, parsed."""
    books = spread(spark.read.parquet(f"{d}/books.parquet")).select("id", "title", "author").distinct()
    books = books.filter(F.col("title").rlike(r"[\p{L}\p{N}]") & ~F.concat("title", F.coalesce("author", F.lit(""))).rlike(r"[\x00-\x1f\x7f-\x9f\x{fffe}\x{ffff}]"))

    def escaped(column: str) -> Column:
        return F.replace(F.replace(F.replace(F.coalesce(column, F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))

    parts = ["<?xml version='1.0' encoding='UTF-8'?><FictionBook><description><title-info><author><last-name>", escaped("author"), "</last-name></author><book-title>", escaped("title"),
             "</book-title></title-info></description><body><section><p>", escaped("title"), "</p><p>", F.col("id").cast("string"), "</p></section></body></FictionBook>"]
    xml = F.concat(*(F.lit(x) if isinstance(x, str) else x for x in parts))
    files = books.select(F.concat(F.lit("/"), "id", F.lit(".fb2")).alias("path"), F.encode(xml, "UTF-8").alias("content"))
    return parse_files(files).select("file_path", "title", "author", "content", "encoding")


def chunk_numbering(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of the stored books numbered anew, in the order of their stored numbers."""
    df = spark.read.parquet(f"{d}/chunks.parquet").select(F.col("doc_id").alias("old_id"), "book_id", F.col("chunk_num").alias("idx"), "content").distinct()
    paths = spark.read.parquet(f"{d}/books.parquet").select(F.col("id").alias("book_id"), "file_path").groupBy("book_id").agg(F.min("file_path").alias("file_path"))
    rows = df.join(paths, "book_id").withColumn("word_count", F.size(tokens(F.col("content"))))
    rows = rows.withColumn("idx", F.struct("idx", "old_id"))
    return indexing.number_chunks(rows).select("old_id", F.col("doc_id").cast("long").alias("doc_id"), F.col("chunk_num").cast("long").alias("chunk_num"))


def book_id_hash(spark: SparkSession, d: str) -> DataFrame:
    books = spark.read.parquet(f"{d}/books.parquet")
    return books.select("id", book_id(F.col("file_path"), F.col("title"), F.col("author")).alias("computed")).distinct()


def filename_metadata(spark: SparkSession, d: str) -> DataFrame:
    books = spark.read.parquet(f"{d}/books.parquet").select("file_path").distinct()
    return books.select("file_path", filename_fields(file_name(F.col("file_path"))).alias("f")).select("file_path", "f.genre", "f.author", "f.title")


def genre_map_join(spark: SparkSession, d: str) -> DataFrame:
    mapping = spark.read.parquet(f"{d}/genre_map.parquet")
    mapping = mapping.select("original", F.regexp_replace("mapped", "[\r\n]+$", "").alias("mapped")).groupBy("original").agg(F.max("mapped").alias("mapped"))
    books = spark.read.parquet(f"{d}/books.parquet").select("id", "genre").distinct()
    return map_genre(books, "genre", mapping)


def ellipsis_normalize(spark: SparkSession, d: str) -> DataFrame:
    return _documents(spark, d).select("doc_id", ellipsis(F.col("text")).alias("text"))


def sentence_split(spark: SparkSession, d: str) -> DataFrame:
    rows = sentence_rows(_documents(spark, d).select("doc_id", "text"), "text")
    return rows.select("doc_id", F.col("pos").cast("long").alias("pos"), "sentence")


def _library(spark: SparkSession, d: str) -> Index:
    """The stored books and chunks as an index without terms."""
    chunks = spark.read.parquet(f"{d}/chunks.parquet").distinct()
    books = spark.read.parquet(f"{d}/books.parquet").select("id", "title", "author", "genre").distinct()
    return Index(chunks.limit(0), chunks.limit(0), chunks.limit(0), chunks, books, None)


def metadata_join(spark: SparkSession, d: str) -> DataFrame:
    index = _library(spark, d)
    return Engine(index).with_metadata(index.chunks.select("doc_id")).select("doc_id", "book_id", "chunk_num", "title", "author", "genre")


def books_without_chunks(spark: SparkSession, d: str) -> DataFrame:
    """The books an indexing run would not skip."""
    books = spark.read.parquet(f"{d}/books.parquet").select(F.col("id").alias("book_id"))
    return indexing.new_books(books, _library(spark, d)).select(F.col("book_id").alias("id"))


def first_write_wins(spark: SparkSession, d: str) -> DataFrame:
    """Repeated books: the one created first stays."""
    return spark.read.parquet(f"{d}/books.parquet").groupBy("id").agg(F.min("created_at").alias("created_at"))


def incremental_append(spark: SparkSession, d: str) -> DataFrame:
    """The lexicon after adding all parsed files in two runs, the second with every file again."""
    parsed = spark.read.parquet(f"{d}/parsed_documents.parquet")
    parsed = parsed.withColumn("book_id", book_id(F.col("file_path"), F.col("title"), F.col("author")))
    path = f"{shared_dir(spark)}/folianto-index-{uuid.uuid4().hex}"
    indexing.append(spark, path, parsed.filter(F.pmod("book_id", F.lit(2)) == 0), language=None)
    return indexing.append(spark, path, parsed, language=None).lexicon


_PLAIN: dict[str, str | None] = {
    "tokenize_counts": f"select doc_id, len({_LIST})::bigint as n_tokens from documents",
    "tokens_positions": f"with {_TOKENS} select doc_id, pos::bigint as pos, term from tk",
    "tokenize_no_digits": f"select doc_id, len({_LIST.replace('0-9', '')})::bigint as n_tokens from documents",
    "tokenize_keep_yo": f"select term, count(*) as n from (select unnest({_LIST.replace(_UP, UPPER).replace(_LOW, LOWER)}) as term from documents) group by 1",
    "chars_words_count": f"select doc_id, length(text)::bigint as char_count, len({_LIST})::bigint as word_count from (select distinct doc_id, content as text from chunks)",
    "postings_tf": f"with {_POSTINGS} select term, doc_id, tf::bigint as tf from po",
    "postings_positions": f"with {_TOKENS} select term, doc_id, string_agg(pos::varchar, ' ' order by pos) as positions from tk group by 1, 2",
    "lexicon_df": f"with {_POSTINGS} select term, df::bigint as df from le",
    "corpus_stats": f"with {_TOKENS} select count(*) as doc_count, sum(len(ts))::bigint as total_term_count, round(sum(len(ts))::double / count(*), 6) as avg_doc_length from d where len(ts) > 0",
    "idf_table": f"with {_POSTINGS} select term, round(idf, 6) as idf from idf",
    "stem_vocabulary": None,  # below
    "stem_russian": f"with {_TOKENS}, vocabulary as (select distinct term from tk), {_STEMS} select term, stem from stems",
    "stemmed_search": None,
    "true_length_search": f"""with {_POSTINGS} select doc_id, round(s::double, 6) as score from (select doc_id,
        (idf * ((tf * 2.2::double) / (tf + 1.2::double * (0.25::double + 0.75::double * (len(ts) / avgdl)))))::float as s from po join idf using (term) join d using (doc_id), st where term = 'чердак') order by s desc, doc_id limit 50""",
    "prefiltered_search": f"with {_POSTINGS} select doc_id, round(s::double, 6) as score from sc join documents using (doc_id) where term = 'забор' and source = 'omnibus_feed' order by s desc, doc_id limit 20",
    "match_all_empty": "select doc_id, '' as title from documents where false",
    "match_all_first": "select doc_id, 'doc-' || doc_id as title, lang as genre from documents where lang = 'en' order by doc_id limit 20",
    "inmemory_or_search": f"""with {_POSTINGS}, q(term) as (values ('молоко'), ('забор'), ('молоко'), ('the'))
        select doc_id, round(s::double, 6) as score from (select doc_id, sum((idf * ((tf * 2.2::double) / (tf + 1.2::double * (0.25::double + 0.75::double * (tf / avgdl))))))::float as s
        from q join po using (term) join idf using (term), st group by 1) order by s desc, doc_id limit 50""",
    "highlight_offsets": None,
    "chunk_documents": "with recursive " + _CHUNKS.replace("@source@", "select doc_id, text from documents") + " select doc_id, idx, content from chunked",
    "txt_parse": r"""with t as (select 'doc-' || doc_id || '.txt' as name, coalesce(text, '') as t from documents), u as (select name, t, case when t[1] = chr(65279) then t[2:] else t end as u from t)
        select name as file_path, case when u <> '' then name end as title, case when u <> '' then u end as content,
        case when u = '' then null when regexp_full_match(t, '[\x00-\x7F]*') then 'ASCII' else 'UTF-8' end as encoding, case when u = '' then 'EmptyContent' end as error from u""",
    "txt_parse_cp1251": f"""select 'doc-' || doc_id || '.txt' as file_path, text as content, 'CP1251' as encoding from documents
        where regexp_full_match(text, '[{_CP1251}]*') and length(regexp_replace(text, '[^а-яё]', '', 'g')) >= 20""",
    "fb2_parse": r"""select id || '.fb2' as file_path, title, case when regexp_matches(author, '[^\s\p{Z}]') then author else '' end as author, title || chr(10) || id as content, 'UTF-8' as encoding
        from (select distinct id, title, author from books) where regexp_matches(title, '[\p{L}\p{N}]') and not regexp_matches(title || coalesce(author, ''), '[\x00-\x1f\x7f-\x9f\x{fffe}\x{ffff}]')""",
    "chunk_numbering": f"""with p as (select id as book_id, min(file_path) as file_path from books group by 1),
        c as (select *, len({_LIST.replace('coalesce(text', 'coalesce(content')}) as n from (select distinct doc_id, book_id, chunk_num, content from chunks) join p using (book_id))
        select doc_id as old_id, row_number() over (order by file_path, book_id, chunk_num, doc_id)::bigint as doc_id, row_number() over (partition by book_id order by chunk_num, doc_id)::bigint as chunk_num from c where n > 0""",
    "book_id_hash": f"""select distinct id, (case when h >= 9223372036854775808 then h - 18446744073709551616 else h end)::bigint as computed from (select id, ('0x' || substr(sha256(
        regexp_replace(regexp_replace(translate(coalesce(file_path, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '\\.gz$', ''), '\\.txt$', '') || '|' || coalesce(title, '') || '|' || coalesce(author, '')), 1, 16))::ubigint::hugeint as h from books)""",
    "filename_metadata": r"""with b as (select distinct file_path, regexp_replace(regexp_extract(file_path, '([^/]*)$', 1), '\.[^.]*$', '') as base from books),
        s as (select *, instr(base, ' — ') as dash from b), l as (select *, case when dash > 0 then substr(base, 1, dash - 1) else '' end as l from s)
        select file_path, trim(case when contains(l, '_') then substr(l, 1, instr(l, '_') - 1) else '' end, ' ') as genre, trim(substr(l, instr(l, '_') + 1), ' ') as author,
        case when dash > 0 then trim(substr(base, dash + 3), ' ') else base end as title from l""",
    "genre_map_join": r"""with m as (select original, max(regexp_replace(mapped, '[\r\n]+$', '')) as mapped from genre_map group by 1)
        select id, coalesce(mapped, genre) as genre from (select distinct id, genre from books) left join m on genre = original""",
    "ellipsis_normalize": "select doc_id, replace(replace(text, '...', '…'), '. . .', '…') as text from documents",
    "sentence_split": r"""with s as (select doc_id, list_filter(list_transform(string_split(regexp_replace(text, '([.!?])[ \n\r]+', '\1' || chr(1), 'g'), chr(1)), lambda x: case when ltrim(x, ' ') = '' then x else ltrim(x, ' ') end), lambda x: x <> '') as l from documents)
        select doc_id, (generate_subscripts(l, 1) - 1)::bigint as pos, unnest(l) as sentence from s""",
    "metadata_join": """select doc_id, book_id, chunk_num, title, author, genre from (select distinct doc_id, book_id, chunk_num from chunks)
        join (select distinct id as book_id, title, author, genre from books) using (book_id)""",
    "books_without_chunks": "select distinct id from books where id not in (select book_id from chunks where book_id is not null)",
    "first_write_wins": "select id, min(created_at) as created_at from books group by 1",
    "incremental_append": "with recursive " + _CHUNKS.replace("@source@", f"""select doc_id, min(text) as text from (select {_BOOK_ID} as doc_id, content as text
        from (select content, {_BOOK_HASH} as h from parsed_documents where error is null and content is not null)) group by 1""")
        + f", w as (select distinct doc_id, idx, unnest({_LIST.replace('coalesce(text', 'coalesce(content')}) as term from chunked) select term, count(*) as df from w group by 1",
}


def queries() -> dict[str, Query]:
    return {name: globals()[name] for name in _PLAIN} | {name: _search(*how) for name, how in SEARCHES.items()}


def oracle_sql() -> dict[str, str]:
    later = {
        "stem_vocabulary": f"with {_TOKENS}, vocabulary as (select distinct term from tk), {_STEMS}, {_english_sql()} select term, stem as russian, english from stems join english using (term)",
        "highlight_offsets": _highlight_sql("чердак market"), "stemmed_search": _stemmed_sql(STEMMED, 50),
    }
    return {name: sql for name, sql in _PLAIN.items() if sql} | later | {name: _search_sql(*how) for name, how in SEARCHES.items()}
