"""The query language: syntax tree, parser and builders."""

from __future__ import annotations

import re
from dataclasses import dataclass, field


@dataclass(frozen=True)
class Term:
    text: str


@dataclass(frozen=True)
class Phrase:
    """Each position holds one or more alternatives."""

    positions: tuple[tuple[str, ...], ...]


@dataclass(frozen=True)
class Not:
    child: Node


@dataclass(frozen=True)
class And:
    children: tuple[Node, ...] = field(default=())


@dataclass(frozen=True)
class Or:
    children: tuple[Node, ...] = field(default=())


Node = Term | Phrase | Not | And | Or


class QueryParseError(ValueError):
    """``kind`` is EmptyQuery, UnmatchedQuotes, UnexpectedCharacter or EmptyGroup."""

    def __init__(self, kind: str, at: int = 0):
        super().__init__(f"{kind} at {at}")
        self.kind = kind


_LEXEME = re.compile(r'[ \t\r\n]*(?:([|\-!"()])|([^ \t\r\n|\-!"()]+))')


class _Reader:
    """Lexemes with one of look-ahead; None at the end."""

    def __init__(self, text: str):
        self.items = [(m.group(1) or m.group(2), bool(m.group(1)), m.end()) for m in _LEXEME.finditer(text)]
        self.at = 0

    def peek(self) -> str | None:
        return self.items[self.at][0] if self.at < len(self.items) else None

    def is_word(self) -> bool:
        return self.at < len(self.items) and not self.items[self.at][1]

    def take(self) -> str:
        self.at += 1
        return self.items[self.at - 1][0]

    def fail(self, kind: str) -> QueryParseError:
        return QueryParseError(kind, self.items[min(self.at, len(self.items) - 1)][2] if self.items else 0)


def _any(r: _Reader) -> Node:
    options = [_all(r)]
    while r.peek() == "|":
        r.take()
        options.append(_all(r))
    return options[0] if len(options) == 1 else Or(tuple(options))


def _all(r: _Reader) -> Node:
    parts = []
    while r.peek() not in (None, "|", ")"):
        parts.append(_factor(r))
    if not parts:
        raise r.fail("EmptyQuery")
    return parts[0] if len(parts) == 1 else And(tuple(parts))


def _factor(r: _Reader) -> Node:
    if r.is_word():
        return Term(r.take())
    match r.peek():
        case "-" | "!":
            r.take()
            return Not(_factor(r))
        case '"':
            r.take()
            return _phrase(r)
        case "(":
            r.take()
            inner = _any(r)
            if r.peek() != ")":
                raise r.fail("UnexpectedCharacter")
            r.take()
            return inner
    raise r.fail("EmptyQuery")


def _phrase(r: _Reader) -> Phrase:
    positions: list[tuple[str, ...]] = []
    while r.peek() != '"':
        if r.peek() is None:
            raise r.fail("UnmatchedQuotes")
        if r.is_word():
            positions.append((r.take(),))
        elif r.peek() == "(":
            r.take()
            positions.append(_alternatives(r))
        else:  # an operator has no meaning inside a phrase
            raise r.fail("UnexpectedCharacter")
    r.take()
    if not positions:
        raise r.fail("EmptyQuery")
    return Phrase(tuple(positions))


def _alternatives(r: _Reader) -> tuple[str, ...]:
    """Words between bars up to the bracket; stray bars do no harm."""
    found: list[str] = []
    after_bar, need_bar = False, False
    while r.peek() != ")":
        if r.peek() is None:
            raise r.fail("UnmatchedQuotes" if after_bar else "UnexpectedCharacter")
        if r.peek() == "|":
            r.take()
            after_bar, need_bar = True, False
        elif r.is_word() and not need_bar:
            found.append(r.take())
            after_bar, need_bar = False, True
        else:
            raise r.fail("UnexpectedCharacter")
    r.take()
    if not found:
        raise r.fail("EmptyGroup")
    return tuple(found)


def parse(text: str) -> Node:
    """``a b`` both, ``a | b`` either, ``-a`` or ``!a`` not, ``"a (b | c)"`` a phrase with alternatives, brackets for grouping."""
    r = _Reader(text)
    tree = _any(r)
    if r.peek() is not None:
        raise r.fail("UnexpectedCharacter")
    return tree


def query_string(text: str) -> Node:
    return parse(text)


def match(text: str) -> Node:
    """Any of the words, if there are only words; else as ``query_string``."""
    tree = parse(text)
    if isinstance(tree, And) and len(tree.children) > 1 and all(isinstance(c, Term) for c in tree.children):
        return Or(tree.children)
    return tree


def match_phrase(text: str) -> Node:
    return parse(f'"{text}"')


def match_all() -> Node:
    """The empty conjunction; as a query it finds nothing (see ``Engine.match_all``)."""
    return And()


def words_in(tree: Node) -> list[str]:
    """All words of a tree, in order, repeated ones too."""
    match tree:
        case Term(text):
            return [text]
        case Phrase(positions):
            return [w for p in positions for w in p]
        case Not(child):
            return words_in(child)
        case And(children) | Or(children):
            return [w for c in children for w in words_in(c)]
    raise TypeError(tree)
