"""The predicate language: text → tree → Column.

    expr := or ;  or := and ("or" and)* ;  and := not ("and" not)* ;  not := "not" not | prim
    prim := "(" expr ")" | field op value | field unary | unary field
    op   := = | != | > | >= | < | <= | like | rlike | in | belong | contain
    unary := exist | not_exist | match
    value := "quoted" | 'quoted' | bareword

Keywords are case-insensitive; NOT binds before AND before OR. A bareword that names an
alias (``B.dst_address``) is a field when aliases are given. Everything is parsed once on
the driver and evaluated as built-in expressions.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.functions.scalars import as_number, as_text, ip_in, total

MATCHER_FIELD = "ioc_matcher"
_COMPARE = ("=", "!=", ">", ">=", "<", "<=")
_WORD_OPS = ("like", "rlike", "in", "belong", "contain")
_UNARY = ("exist", "not_exist", "match")


class PredicateError(ValueError):
    """The text isn't a predicate."""


@dataclass(frozen=True)
class Compare:
    field: str
    op: str
    value: str | None


@dataclass(frozen=True)
class FieldCompare:
    left: str
    op: str
    right: str


@dataclass(frozen=True)
class Unary:
    op: str
    field: str


@dataclass(frozen=True)
class Not:
    child: Predicate


@dataclass(frozen=True)
class And:
    children: tuple[Predicate, ...]


@dataclass(frozen=True)
class Or:
    children: tuple[Predicate, ...]


Predicate = Compare | FieldCompare | Unary | Not | And | Or

_LEX = re.compile(r"""\s*(?:(?P<quoted>"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*')|(?P<sign>!=|>=|<=|=|>|<|\(|\))|(?P<word>[^\s()=<>!"']+))""")


def _tokens(text: str) -> Iterator[tuple[str, str]]:
    at, text = 0, text.rstrip()
    while at < len(text):
        m = _LEX.match(text, at)
        if not m:
            raise PredicateError(f"can't read {text[at:]!r}")
        at = m.end()
        if m["quoted"]:
            yield "quoted", re.sub(r"\\(.)", r"\1", m["quoted"][1:-1])
        else:
            yield ("sign", m["sign"]) if m["sign"] else ("word", m["word"])


class _Parser:
    def __init__(self, text: str, aliases: tuple[str, ...]):
        self.tokens, self.at, self.aliases = [*_tokens(text), ("end", "")], 0, aliases

    def peek(self) -> tuple[str, str]:
        return self.tokens[self.at]

    def take(self) -> tuple[str, str]:
        self.at += 1
        return self.tokens[self.at - 1]

    def keyword(self, *words: str) -> str | None:
        kind, text = self.peek()
        return text.lower() if kind == "word" and text.lower() in words else None

    def chain(self, word: str, one: Callable[[], Predicate], many: type) -> Predicate:
        parts = [one()]
        while self.keyword(word):
            self.take()
            parts.append(one())
        return parts[0] if len(parts) == 1 else many(tuple(parts))

    def expr(self) -> Predicate:
        return self.chain("or", lambda: self.chain("and", self.negated, And), Or)

    def negated(self) -> Predicate:
        if self.keyword("not"):
            self.take()
            return Not(self.negated())
        return self.primary()

    def primary(self) -> Predicate:
        kind, text = self.take()
        if (kind, text) == ("sign", "("):
            inner = self.expr()
            if self.take() != ("sign", ")"):
                raise PredicateError("a parenthesis isn't closed")
            return inner
        if kind not in ("word", "quoted"):
            raise PredicateError(f"a field is expected, not {text!r}")
        if kind == "word" and text.lower() in _UNARY and self.peek()[0] in ("word", "quoted") and not self.keyword("and", "or", *_WORD_OPS):
            return Unary(text.lower(), self.take()[1])
        if op := self.keyword(*_UNARY):
            self.take()
            return Unary(op, text)
        op_kind, op = self.take()
        op = op.lower()
        if not (op_kind == "sign" and op in _COMPARE or op_kind == "word" and op in _WORD_OPS):
            raise PredicateError(f"{op!r} is no operator")
        value_kind, value = self.take()
        if value_kind not in ("word", "quoted"):
            raise PredicateError(f"{text} {op} needs a value")
        if value_kind == "word" and value.split(".")[0] in self.aliases and "." in value:
            return FieldCompare(text, op, value)
        return Compare(text, op, value)


def parse(text: str, aliases: tuple[str, ...] = ()) -> Predicate:
    p = _Parser(text, aliases)
    tree = p.expr()
    if p.peek()[0] != "end":
        raise PredicateError(f"{p.peek()[1]!r} wasn't expected")
    return tree


def fields(tree: Predicate) -> set[str]:
    """All fields that a predicate reads."""
    match tree:
        case Compare(f, _, _):
            return {f}
        case FieldCompare(a, _, b):
            return {a, b}
        case Unary(op, f):
            return {MATCHER_FIELD if op == "match" else f}
        case Not(c):
            return fields(c)
        case And(cs) | Or(cs):
            return set().union(*map(fields, cs))
    raise TypeError(tree)


def groups(tree: Predicate) -> set[tuple[str, str]]:
    """(field, group) of every ``belong``."""
    match tree:
        case Compare(f, "belong", g):
            return {(f, g or "")}
        case Not(c):
            return groups(c)
        case And(cs) | Or(cs):
            return set().union(*map(groups, cs))
    return set()


def resolver(df: DataFrame, raw: str | None = None) -> Callable[[str], tuple[Column, T.DataType]]:
    """Look fields up among the columns (nested ones by their path), else in the JSON text of column ``raw``, else null."""

    def find(name: str) -> tuple[Column, T.DataType]:
        kind: T.DataType = df.schema
        for part in name.split("."):
            if not isinstance(kind, T.StructType) or part not in kind.fieldNames():
                break
            kind = kind[part].dataType
        else:
            return reduce(lambda c, p: c[p], name.split(".")[1:], F.col(f"`{name.split('.')[0]}`")), kind
        if raw is not None:
            return F.get_json_object(raw, "$." + name), T.StringType()
        return F.lit(None).cast("string"), T.StringType()

    return find


def _scalar(c: Column, kind: T.DataType) -> Column:
    """Text of a field; arrays and objects have none."""
    return F.lit(None).cast("string") if isinstance(kind, (T.ArrayType, T.MapType, T.StructType)) else as_text(c)


def _number(c: Column, kind: T.DataType) -> Column:
    """Double of a field; numbers stay as they are, so that comparisons reach the files' statistics."""
    return c.cast("double") if isinstance(kind, T.NumericType) else as_number(_scalar(c, kind))


def _ordered(op: str, a: Column, b: Column) -> Column:
    return {">": a > b, ">=": a >= b, "<": a < b, "<=": a <= b}[op]


def _equal(c: Column, kind: T.DataType, value: str) -> Column:
    if isinstance(kind, T.IntegralType) and re.fullmatch(r"0|-?[1-9][0-9]{0,17}", value):
        return c == F.lit(int(value)).cast("bigint")  # the same as comparing their texts
    return _scalar(c, kind) == value


def _test(c: Column, kind: T.DataType, op: str, value: str, member: Callable[[Column, str], Column] | None) -> Column:
    """A test that is null or false if the value is missing."""
    text = _scalar(c, kind)
    if op == "=":
        return _equal(c, kind, value)
    if op in _COMPARE:
        try:
            number = float(value)
        except ValueError:
            return F.lit(False)
        if isinstance(kind, T.IntegralType) and abs(number) < 2**53:
            # a whole number compares without a cast, which files can filter by
            return _ordered(op, c, F.lit(math.floor(number) if op in (">", "<=") else math.ceil(number)).cast("bigint"))
        return _ordered(op, _number(c, kind), F.lit(number))
    if op == "like":
        return F.contains(text, F.lit(value))
    if op == "rlike":
        return text.rlike(rf"\A(?:{value})\z")
    if op == "in":
        return ip_in(text, value)
    if op == "contain":
        return F.exists(c, lambda x: x.cast("string") == value) if isinstance(kind, T.ArrayType) else F.lit(False)
    if op == "belong":
        if member is None:
            raise PredicateError("belong needs intelligence groups")
        return member(text, value)
    raise PredicateError(f"unknown operator {op}")


def compile_predicate(tree: Predicate, find: Callable[[str], tuple[Column, T.DataType]], member: Callable[[Column, str], Column] | None = None, as_filter: bool = False) -> Column:
    """A boolean Column. ``member(text, group)`` answers ``belong``.

    It is never null, unless it is made ``as_filter``: a filter drops null and false alike, and a bare comparison can
    be pushed down to the files where one wrapped against null can't. Below a NOT everything is wrapped.
    """
    wrap = (lambda c: c) if as_filter else total
    match tree:
        case And(cs):
            return reduce(lambda a, b: a & b, (compile_predicate(c, find, member, as_filter) for c in cs))
        case Or(cs):
            return reduce(lambda a, b: a | b, (compile_predicate(c, find, member, as_filter) for c in cs))
        case Not(c):
            # a comparison without a value is false, negated or not
            return F.lit(False) if isinstance(c, Compare) and c.value is None else ~compile_predicate(c, find, member)
        case Unary("match", name):
            return wrap(_scalar(*find(MATCHER_FIELD)) == name)
        case Unary(op, name):
            c, _ = find(name)
            return c.isNotNull() if op == "exist" else c.isNull()
        case FieldCompare(left, op, right):
            (a, ka), (b, kb) = find(left), find(right)
            if op in ("=", "!="):
                same = F.lower(_scalar(a, ka)) == F.lower(_scalar(b, kb))
                return wrap(same) if op == "=" else ~total(same)
            if op in _COMPARE:
                return wrap(_ordered(op, _number(a, ka), _number(b, kb)))
            raise PredicateError(f"{op} can't compare two fields")
        case Compare(_, _, None):
            return F.lit(False)
        case Compare(name, "!=", value):
            return ~total(_test(*find(name), "=", value, member))
        case Compare(name, op, value):
            return wrap(_test(*find(name), op, value, member))
    raise TypeError(tree)


def where(df: DataFrame, text: str, raw: str | None = None, member: Callable[[Column, str], Column] | None = None) -> Column:
    """The predicate ``text`` over the columns of ``df``, as a value that is never null."""
    return compile_predicate(parse(text), resolver(df, raw), member)


def condition(df: DataFrame, text: str, raw: str | None = None, member: Callable[[Column, str], Column] | None = None) -> Column:
    """The predicate ``text`` for a filter of ``df``."""
    return compile_predicate(parse(text), resolver(df, raw), member, as_filter=True)
