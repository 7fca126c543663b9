"""The query language: words, quoted phrases, AND, OR, NOT, parentheses; words side by side mean AND."""

from __future__ import annotations

import re
from dataclasses import dataclass


class QuerySyntaxError(ValueError):
    """The query doesn't follow the grammar."""


@dataclass(frozen=True)
class Word:
    text: str

    def __str__(self) -> str:
        return f'"{self.text}"' if " " in self.text else self.text


@dataclass(frozen=True)
class And:
    left: Node
    right: Node

    def __str__(self) -> str:
        return f"({self.left} AND {self.right})"


@dataclass(frozen=True)
class Or:
    left: Node
    right: Node

    def __str__(self) -> str:
        return f"({self.left} OR {self.right})"


@dataclass(frozen=True)
class Not:
    inner: Node

    def __str__(self) -> str:
        return f"(NOT {self.inner})"


Node = Word | And | Or | Not

_LEXEME = re.compile(r'"([^"]+)"|([()])|([^\s()]+)')
_BINDING = {"or": 1, "and": 2}


def is_boolean(query: str) -> bool:
    """Whether a query is of this language: it holds an operator between spaces, a parenthesis or a quote."""
    spaced = f" {query.upper()} "
    return any(f" {op} " in spaced for op in ("AND", "OR", "NOT")) or any(c in query for c in '()"')


def lexemes(query: str) -> list[str]:
    """Lower-case lexemes; the words of a quoted phrase are one lexeme, without blanks around them."""
    return [(m[1].strip() if m[1] is not None else m[2] or m[3]).lower() for m in _LEXEME.finditer(query)]


def parse(query: str) -> Node:
    """Precedence climbing: NOT binds closest, then AND, explicit or not, then OR; equals associate to the left."""
    todo = lexemes(query)
    if not todo:
        raise QuerySyntaxError("empty query")
    node, at = _expression(todo, 0, 1)
    if at < len(todo):
        raise QuerySyntaxError(f"unexpected {todo[at]!r}")
    return node


def _expression(todo: list[str], at: int, least: int) -> tuple[Node, int]:
    left, at = _operand(todo, at)
    while at < len(todo) and todo[at] != ")":
        op = todo[at] if todo[at] in _BINDING else "and"
        if _BINDING[op] < least:
            break
        right, at = _expression(todo, at + (todo[at] in _BINDING), _BINDING[op] + 1)
        left = Or(left, right) if op == "or" else And(left, right)
    return left, at


def _operand(todo: list[str], at: int) -> tuple[Node, int]:
    if at >= len(todo):
        raise QuerySyntaxError("unexpected end of the query")
    word = todo[at]
    if word == "not":
        inner, at = _operand(todo, at + 1)
        return Not(inner), at
    if word == "(":
        inner, at = _expression(todo, at + 1, 1)
        if at >= len(todo) or todo[at] != ")":
            raise QuerySyntaxError("missing )")
        return inner, at + 1
    if word == ")" or word in _BINDING:
        raise QuerySyntaxError(f"unexpected {word!r}")
    return Word(word), at + 1


def leaves(node: Node) -> list[str]:
    """The distinct words and phrases in order, those under NOT included."""
    match node:
        case Word(text):
            return [text]
        case Not(inner):
            return leaves(inner)
        case And(left, right) | Or(left, right):
            return list(dict.fromkeys(leaves(left) + leaves(right)))
    raise TypeError(node)


def holds_for_nothing(node: Node) -> bool:
    """Whether the query is true of a document that has none of its words."""
    match node:
        case Word(_):
            return False
        case Not(inner):
            return not holds_for_nothing(inner)
        case And(left, right):
            return holds_for_nothing(left) and holds_for_nothing(right)
        case Or(left, right):
            return holds_for_nothing(left) or holds_for_nothing(right)
    raise TypeError(node)
