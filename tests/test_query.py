import random

import pytest

from folianto.plans.query import And, Not, Or, Phrase, QueryParseError, Term, match, match_all, match_phrase, parse, query_string


def T(*words):
    return tuple(Term(w) for w in words)


@pytest.mark.parametrize(
    "text, tree",
    [
        ("привет", Term("привет")),
        ("привет мир", And(T("привет", "мир"))),
        ("привет | мир", Or(T("привет", "мир"))),
        ("кофе | чай круассан", Or((Term("кофе"), And(T("чай", "круассан"))))),
        ("привет -мир", And((Term("привет"), Not(Term("мир"))))),
        ("привет - мир", And((Term("привет"), Not(Term("мир"))))),
        ("привет !мир", And((Term("привет"), Not(Term("мир"))))),
        ('привет -"прекрасный мир"', And((Term("привет"), Not(Phrase((("прекрасный",), ("мир",))))))),
        ('"я люблю (кофе | чай)"', Phrase((("я",), ("люблю",), ("кофе", "чай")))),
        ("(кофе | чай) круассан", And((Or(T("кофе", "чай")), Term("круассан")))),
        ("кое-как", And((Term("кое"), Not(Term("как"))))),
        ("--a", Not(Not(Term("a")))),
        ('"a (|b||c|)"', Phrase((("a",), ("b", "c")))),
    ],
)
def test_trees(text, tree):
    assert parse(text) == tree


@pytest.mark.parametrize(
    "text, kind",
    [(x, "EmptyQuery") for x in ("", "  ", "-", "| a", "a |", "a | | b", "()", '""')]
    + [(x, "UnexpectedCharacter") for x in ("a )", "(a", '"a | b"', '"a -b"', '"a !b"', '"a )"', '"a (b c)"', '"a (b', '"a (-b)"')]
    + [('"привет мир', "UnmatchedQuotes"), ('"a (b|', "UnmatchedQuotes"), ('"привет ()"', "EmptyGroup")],
)
def test_errors(text, kind):
    with pytest.raises(QueryParseError) as e:
        parse(text)
    assert e.value.kind == kind


def test_builders():
    assert query_string("a b") == And(T("a", "b"))
    assert match("a b") == Or(T("a", "b"))
    assert match("a -b") == And((Term("a"), Not(Term("b"))))
    assert match_phrase("a b") == Phrase((("a",), ("b",)))
    assert match_all() == And()


# --- a plain model of the evaluation against the compiled column ------------------------------------------------------


def model(node, docs):
    """Set of records for a tree by the rules in words: an accumulator passed through."""

    def has(doc, word):
        return word in docs[doc]

    def phrase(doc, p):
        words = docs[doc]
        return any(w == p.positions[0][0] and all(i + k < len(words) and words[i + k] in p.positions[k] for k in range(1, len(p.positions))) for i, w in enumerate(words))

    def run(node, acc):
        if isinstance(node, Term):
            return acc | {d for d in docs if has(d, node.text)}
        if isinstance(node, Phrase):
            return acc | {d for d in docs if phrase(d, node)}
        if isinstance(node, Not):
            return acc - run(node.child, set())
        if isinstance(node, Or):
            for c in node.children:
                acc = run(c, acc)
            return acc
        both = None
        for c in node.children:
            if isinstance(c, Not):
                both = both - run(c.child, set()) if both is not None else None
            else:
                x = run(c, set())
                both = x if both is None else both & x
        return acc | (both or set())

    return run(node, set())


def random_tree(r, depth=0):
    kind = r.choice("ttpnao" if depth < 3 else "tp")
    word = lambda: r.choice("abcd")
    if kind == "t":
        return Term(word())
    if kind == "p":
        return Phrase(tuple(tuple(word() for _ in range(r.randint(1, 2))) for _ in range(r.randint(1, 3))))
    if kind == "n":
        return Not(random_tree(r, depth + 1))
    return (And if kind == "a" else Or)(tuple(random_tree(r, depth + 1) for _ in range(r.randint(2, 3))))


def test_compiled_trees_against_the_model(spark):
    from pyspark.sql import functions as F

    from folianto.operators.indexing import Index
    from folianto.operators.search import Engine

    r = random.Random(5)
    docs = {i: [r.choice("abcde") for _ in range(r.randint(1, 6))] for i in range(24)}
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in docs.items()], "doc_id long, text string")
    index = Index.over_texts(df, "doc_id", "text", F.lit(""), F.lit(""), F.lit(""))
    index.postings = index.postings.cache()
    engine = Engine(index)
    for _ in range(25):
        tree = random_tree(r)
        got = {x.doc_id for x in engine.scores(tree).collect()}
        assert got == model(tree, docs), tree
