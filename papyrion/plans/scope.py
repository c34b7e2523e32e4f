"""Names in a statement: which column a field stands for."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyrion.dialect.lexer import DialectError
from papyrion.dialect.nodes import Field
from papyrion.functions.values import Value, kind_of_type, literal
from papyrion.sources.catalog import never_null


@dataclass
class Scope:
    """Aliases with their fields. Internally each column is named `alias.field`, so equal names of two tables never clash."""

    document: bool = False
    variables: dict = field(default_factory=dict)
    fields: dict[str, dict[str, tuple[str, str]]] = field(default_factory=dict)  # alias -> field in lower case -> (column, kind)
    shown: dict[str, list[str]] = field(default_factory=dict)  # alias -> names as written
    missing: list[str] = field(default_factory=list)
    null_keys: bool = True  # whether null equals null between fields in a join
    frames: dict[str, tuple[DataFrame, dict[str, str]]] = field(default_factory=dict)  # alias -> the source, field in lower case -> its name there
    extended: set[str] = field(default_factory=set)  # aliases whose rows may be all null, as they are joined by OUTER JOIN

    def add(self, alias: str, frame: DataFrame) -> DataFrame:
        key = alias.lower()
        if key in self.fields:
            raise DialectError(f"alias {alias!r} is used twice")
        own, columns = {}, []
        for i, f in enumerate(frame.schema.fields):
            name = f"{key}.{f.name}" if f.name.lower() not in own else f"{key}.{f.name}#{i}"
            columns.append(name)
            own.setdefault(f.name.lower(), (name, kind_of_type(f.dataType, self.document)))
        self.fields[key] = own
        self.shown[key] = [f.name for f in frame.schema.fields]
        self.frames[key] = (frame, {n.lower(): n for n in reversed(frame.columns)})
        return frame.toDF(*columns) if columns else frame

    def value(self, alias: str, name: str) -> Value:
        """The field's value; an unknown field is null, an unknown alias an error."""
        key = alias.lower()
        if alias and key not in self.fields:
            raise DialectError(f"no schema has the alias {alias!r}")
        for a in [key] if alias else self.fields:
            if found := self.fields[a].get(name.lower()):
                return Value(F.col(f"`{found[0]}`"), found[1])
        self.missing.append(f"{alias}.{name}" if alias else name)
        return Value(F.lit(None).cast("string"), "null")

    def never_null(self, node) -> bool:
        """Whether a field's values in the joined rows surely hold no null."""
        if not isinstance(node, Field):
            return False
        for alias in [node.alias.lower()] if node.alias else self.fields:
            if alias in self.frames and node.name.lower() in self.frames[alias][1]:
                frame, names = self.frames[alias]
                return alias not in self.extended and never_null(frame, names[node.name.lower()])
        return False

    def knows(self, alias: str, name: str) -> bool:
        return any(name.lower() in self.fields.get(a, {}) for a in ([alias.lower()] if alias else self.fields))

    def variable(self, name: str) -> Value:
        if name not in self.variables:
            raise DialectError(f"variable @{name} is not declared")
        return literal(self.variables[name])

    def stars(self, alias: str | None) -> list[tuple[str, str, str]]:
        """(alias, field, output name) of `*` or `alias.*`: sorted by `alias.field`, bare names where there is no alias."""
        aliases = [alias.lower()] if alias else list(self.fields)
        if alias and aliases[0] not in self.fields:
            raise DialectError(f"no schema has the alias {alias!r}")
        written = {a: a for a in aliases} | {a.lower(): a for a in self.written if a.lower() in aliases}
        out = {(a, n.lower()): (a, n, f"{written[a]}.{n}".lstrip(".")) for a in aliases for n in reversed(self.shown[a])}
        return sorted(out.values(), key=lambda x: x[2].lower())

    @property
    def written(self) -> list[str]:
        return getattr(self, "_written", [])

    @written.setter
    def written(self, aliases: list[str]) -> None:
        self._written = aliases
