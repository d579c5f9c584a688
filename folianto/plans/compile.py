"""A syntax tree as one column over a row that maps the query's terms to their scores and positions.

The column is the record's score as FLOAT, null where the record isn't in the result. Evaluation is an ordered fold over an
accumulator, so NOT depends on what stands before it: it takes records out of what was found so far.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .query import And, Node, Not, Or, Phrase, Term



def compile_tree(tree: Node, normal: Callable[[str], str], entries: Column) -> Column:
    """``entries`` is MAP<term, STRUCT<score FLOAT, positions ARRAY<INT>>>; ``normal`` brings a query word to its term."""
    nothing = F.lit(None).cast("float")

    def score(word: str) -> Column:
        return entries[normal(word)]["score"]

    def positions(word: str) -> Column:
        return entries[normal(word)]["positions"]

    def add(acc: Column, x: Column) -> Column:
        """``acc + x`` where ``x`` is, starting from 0; else ``acc``."""
        return F.when(x.isNull(), acc).otherwise(F.coalesce(acc, F.lit(0).cast("float")) + x)

    def phrase(p: Phrase) -> Column:
        first, rest = p.positions[0], p.positions[1:]
        total = None
        for word in first:
            s = score(word)
            total = F.coalesce(s, F.lit(0).cast("float")) if total is None else total + F.coalesce(s, F.lit(0).cast("float"))

        def follows(start: Column) -> Column:
            ok = F.lit(True)
            for i, words in enumerate(rest, 1):
                here = F.lit(False)
                for word in words:
                    here = here | F.coalesce(F.array_contains(positions(word), start + F.lit(i)), F.lit(False))
                ok = ok & here
            return ok

        # the walk starts from the first alternative of the first position only
        found = F.coalesce(F.exists(positions(first[0]), follows), F.lit(False))
        return F.when(found, total)

    def run(node: Node, acc: Column) -> Column:
        match node:
            case Term(text):
                return add(acc, score(text))
            case Phrase():
                return add(acc, phrase(node))
            case Not(child):
                return F.when(run(child, nothing).isNull(), acc)
            case Or(children):
                for child in children:
                    acc = run(child, acc)
                return acc
            case And(children):
                both = None
                for child in children:
                    if isinstance(child, Not):
                        if both is not None:  # with nothing found yet there is nothing to take out
                            both = F.when(run(child.child, nothing).isNull(), both)
                    else:
                        x = run(child, nothing)
                        both = x if both is None else both + x  # null unless in both
                return acc if both is None else add(acc, both)
        raise TypeError(node)

    return run(tree, nothing)
