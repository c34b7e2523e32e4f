"""Tokens of the query dialect."""

from __future__ import annotations

import re
from dataclasses import dataclass


class DialectError(ValueError):
    """A text that is no statement, or a statement that cannot be run."""


@dataclass(frozen=True)
class Token:
    """`kind` is word, number, string, variable, symbol or end; `glued` tells that no white space came before."""

    kind: str
    text: str
    line: int
    glued: bool

    @property
    def lower(self) -> str:
        return self.text.lower() if self.kind == "word" else self.text if self.kind == "symbol" else ""


_PATTERN = re.compile(
    r"""(?P<space>\s+|--[^\n]*|/\*.*?\*/)
      | (?P<string>'(?:[^']|'')*'|"(?:[^"]|"")*")
      | (?P<number>\d+(?:\.\d+)?(?:[eE][+-]?\d+)?(?![\w]))
      | (?P<variable>@\w+)
      | (?P<word>[#\w][\w#$`]*)
      | (?P<symbol>!=|<>|>=|<=|[-+*/%^&|~!=<>(),.:;{}])""",
    re.VERBOSE | re.DOTALL,
)


def tokens(text: str) -> list[Token]:
    """The tokens of `text`, comments left out, with an end token."""
    out, at, line, glued = [], 0, 1, False
    while at < len(text):
        match = _PATTERN.match(text, at)
        if not match:
            raise DialectError(f"line {line}: unexpected {text[at : at + 20]!r}")
        kind, found = match.lastgroup, match.group()
        if kind == "space":
            glued = False
        else:
            if kind == "string":
                found = found[1:-1].replace(found[0] * 2, found[0])
            out.append(Token(kind, found, line, glued))
            glued = True
        line += match.group().count("\n")
        at = match.end()
    out.append(Token("end", "", line, False))
    return out
