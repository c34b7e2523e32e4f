"""Syntax trees of the query dialect."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Number:
    value: float
    text: str


@dataclass(frozen=True)
class Text:
    value: str


@dataclass(frozen=True)
class Named:
    """`true`, `false` or `null`."""

    name: str


@dataclass(frozen=True)
class Variable:
    name: str


@dataclass(frozen=True)
class Field:
    alias: str
    name: str


@dataclass(frozen=True)
class Call:
    name: str
    args: tuple


@dataclass(frozen=True)
class Chain:
    """Operands with the operators between them, as written on one level of parentheses."""

    operands: tuple
    operators: tuple


@dataclass(frozen=True)
class Unary:
    operator: str
    operand: object


@dataclass(frozen=True)
class Group:
    """An expression in parentheses."""

    inner: object


@dataclass(frozen=True)
class Compare:
    operator: str
    left: object
    right: object
    upper: object = None


@dataclass(frozen=True)
class Logic:
    """`and` or `or` over conditions."""

    operator: str
    parts: tuple


@dataclass
class SelectField:
    value: object
    alias: str | None = None


@dataclass
class Star:
    alias: str | None = None


@dataclass
class Source:
    path: str
    alias: str = ""
    join: str = ""
    on: object = None


@dataclass
class Sort:
    value: object
    descending: bool = False


@dataclass
class Select:
    fields: list
    sources: list[Source]
    where: object = None
    group_by: list = field(default_factory=list)
    order_by: list[Sort] = field(default_factory=list)
    top: object = None
    offset: object = None
    distinct: str = ""
    into: str | None = None


@dataclass
class Insert:
    path: str
    names: list[str]
    rows: list[list[tuple[str, object]]] | None = None
    select: Select | None = None


@dataclass
class Update:
    target: str
    assignments: list[tuple[str, object]]
    sources: list[Source]
    where: object = None


@dataclass
class Delete:
    target: str
    sources: list[Source]
    where: object = None


@dataclass
class Statement:
    """Any other statement: its words, e.g. `create schema`, and what they apply to."""

    verb: str
    name: str = ""
    path: str = ""
    names: list[str] = field(default_factory=list)
    options: dict = field(default_factory=dict)
    values: list = field(default_factory=list)
