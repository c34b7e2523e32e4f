"""Expressions and conditions to columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from papyrion.dialect.lexer import DialectError
from papyrion.dialect.nodes import Call, Chain, Compare, Field, Group, Logic, Named, Number, Text, Unary, Variable
from papyrion.functions import aggregate, scalar
from papyrion.functions.values import Value, literal, moment, number, shown, text, whole
from papyrion.plans.scope import Scope

#: Operators from the loosest to the tightest.
LEVELS = ("|", "^", "&", "+-", "*/%")

#: Spellings of a text's beginning that are tested at most.
MOST_FORMS = 8
#: Characters beyond ASCII whose lower case begins with an ASCII letter.
_OTHER_CASES = {"k": ("\u212a",), "i": ("\u0130",)}


def fields_in(node) -> list[Field]:
    """All fields of an expression or condition."""
    if isinstance(node, Field):
        return [node]
    if isinstance(node, Call):
        parts = node.args
    elif isinstance(node, Chain):
        parts = node.operands
    elif isinstance(node, Group):
        parts = (node.inner,)
    elif isinstance(node, Unary):
        parts = (node.operand,)
    elif isinstance(node, Compare):
        parts = (node.left, node.right, node.upper)
    elif isinstance(node, Logic):
        parts = node.parts
    else:
        parts = ()
    return [f for p in parts for f in fields_in(p)]


def aggregates_in(node) -> list[Call]:
    """The outermost aggregate calls of an expression, in order."""
    if isinstance(node, Call):
        if node.name in aggregate.REGISTRY:
            return [node]
        return [c for a in node.args for c in aggregates_in(a)]
    if isinstance(node, Chain):
        return [c for a in node.operands for c in aggregates_in(a)]
    if isinstance(node, Group):
        return aggregates_in(node.inner)
    if isinstance(node, Unary):
        return aggregates_in(node.operand)
    return []


def simplified(node):
    """A form that is equal for expressions that differ only in case of names and in needless parentheses."""
    if isinstance(node, Group):
        return simplified(node.inner)
    if isinstance(node, Field):
        return Field(node.alias.lower(), node.name.lower())
    if isinstance(node, Call):
        return Call(node.name, tuple(map(simplified, node.args)))
    if isinstance(node, Chain):
        return Chain(tuple(map(simplified, node.operands)), node.operators)
    if isinstance(node, Unary):
        return Unary(node.operator, simplified(node.operand))
    if isinstance(node, Number):
        return Number(node.value, "")
    return node


class Lowering:
    """Turns expressions of one scope into values.

    `replaced` holds, for expressions in simplified form, the value that already stands for them: the
    results of aggregates and grouping keys after a GROUP BY. `outside` gives other fields there. With
    `null_equal` off, `=` between fields does not match null with null, as in SQL.
    """

    def __init__(self, scope: Scope, replaced: dict | None = None, outside: Callable[[Field], Value] | None = None, null_equal: bool = True) -> None:
        self.scope, self.replaced, self.outside, self.null_equal = scope, replaced or {}, outside, null_equal

    # -- values

    def value(self, node) -> Value:
        if self.replaced and (found := self.replaced.get(simplified(node))) is not None:
            return found
        if isinstance(node, Number):
            return literal(node.value)
        if isinstance(node, Text):
            return literal(node.value)
        if isinstance(node, Named):
            return literal({"true": 1, "false": 0, "null": None}[node.name])
        if isinstance(node, Variable):
            return self.scope.variable(node.name)
        if isinstance(node, Field):
            return self.outside(node) if self.outside else self.scope.value(node.alias, node.name)
        if isinstance(node, Group):
            return self.value(node.inner)
        if isinstance(node, Call):
            return self._call(node)
        if isinstance(node, Unary):
            inner = self.value(node.operand)
            if node.operator == "-":
                return literal(-inner.literal) if isinstance(inner.literal, (int, float)) else Value(-number(inner), "numeric")
            if node.operator == "~":
                return Value(F.bitwise_not(whole(inner)), "numeric")
            return Value((number(inner) == 0).cast("int"), "numeric")
        return self._chain(node)

    def _call(self, node: Call) -> Value:
        if node.name in aggregate.REGISTRY:
            raise DialectError(f"{node.name} cannot stand here")
        function = scalar.REGISTRY.get(node.name)
        if function is None:
            raise DialectError(f"no function {node.name!r}")
        args = function.bind([self.value(a) for a in node.args])
        kind = {"numeric": "numeric", "boolean": "numeric", "string": "string", "time": "time"}[function.returns]
        return Value(function.build(*args), kind)

    def _chain(self, node: Chain) -> Value:
        """A level of parentheses: text if any summand is text, else arithmetic."""
        summands, operators = self._summands(node)
        kinds = [self._kind(s) for s in summands]
        if "string" in kinds and "+" in node.operators:
            return self._concatenated(summands, kinds)
        if "open" in kinds and all(o == "+" for o in node.operators):
            return self._concatenated(summands, kinds)
        return Value(self._arithmetic(list(node.operands), list(node.operators)), "numeric")

    @staticmethod
    def _summands(node: Chain) -> tuple[list, list]:
        parts, operands, operators = [], [node.operands[0]], []
        for operator, operand in zip(node.operators, node.operands[1:]):
            if operator == "+":
                parts.append(Chain(tuple(operands), tuple(operators)) if operators else operands[0])
                operands, operators = [operand], []
            else:
                operands.append(operand)
                operators.append(operator)
        parts.append(Chain(tuple(operands), tuple(operators)) if operators else operands[0])
        return parts, operators

    def _kind(self, node) -> str:
        if isinstance(node, Chain):
            return "numeric" if "+" not in node.operators else self._chain(node).kind
        return self.value(node).kind

    def _concatenated(self, summands: list, kinds: list[str]) -> Value:
        """Text: neighbouring numbers are added up before they are appended; a group in parentheses ends such a run."""
        values = [self.value(s) for s in summands]
        if "open" in kinds:
            return self._concatenated_open(summands, values)
        parts: list[Column] = []
        run: Column | None = None
        for node, value in zip(summands, values):
            if value.kind == "numeric":
                run = number(value) if run is None else run + number(value)
                if isinstance(node, Group):
                    parts.append(shown(run))
                    run = None
                continue
            if run is not None:
                parts.append(shown(run))
                run = None
            parts.append(text(value))
        if run is not None:
            parts.append(shown(run))
        return Value(F.concat(*parts), "string")

    def _concatenated_open(self, summands: list, values: list[Value]) -> Value:
        """The same where text of a document is a number if it reads as one, decided row by row."""
        items = F.array(*(F.struct(text(v).alias("s"), (number(v) if v.kind in ("numeric", "open") else F.lit(None).cast("double")).alias("n"), F.lit(isinstance(node, Group)).alias("g")) for node, v in zip(summands, values)))
        start = F.struct(F.lit("").alias("s"), F.lit(None).cast("double").alias("n"))

        def step(state, item):
            flushed = F.concat(state["s"], F.coalesce(shown(state["n"]), F.lit("")))
            added = F.coalesce(state["n"], F.lit(0.0)) + item["n"]
            numeric = F.when(item["g"], F.struct(F.concat(state["s"], shown(added)).alias("s"), F.lit(None).cast("double").alias("n"))).otherwise(F.struct(state["s"].alias("s"), added.alias("n")))
            return F.when(item["n"].isNotNull(), numeric).otherwise(F.struct(F.concat(flushed, item["s"]).alias("s"), F.lit(None).cast("double").alias("n")))

        return Value(F.aggregate(items, start, step, lambda end: F.concat(end["s"], F.coalesce(shown(end["n"]), F.lit("")))), "open")

    def _arithmetic(self, operands: list, operators: list[str]) -> Column:
        for level in LEVELS:
            for i in range(len(operators) - 1, -1, -1):
                if operators[i] in level:
                    left = self._arithmetic(operands[: i + 1], operators[:i])
                    right = self._arithmetic(operands[i + 1 :], operators[i + 1 :])
                    return self._binary(operators[i], left, right)
        return number(self.value(operands[0]))

    @staticmethod
    def _binary(operator: str, left: Column, right: Column) -> Column:
        if operator in "&|^":
            a, b = left.try_cast("bigint"), right.try_cast("bigint")
            return {"&": a.bitwiseAND, "|": a.bitwiseOR, "^": a.bitwiseXOR}[operator](b).cast("double")
        if operator == "+":
            return left + right
        if operator == "-":
            return left - right
        if operator == "*":
            return left * right
        return F.try_divide(left, right) if operator == "/" else F.try_mod(left, right)

    # -- conditions

    def condition(self, node) -> Column:
        """A condition; where it is null it does not hold."""
        if isinstance(node, Logic):
            parts = [self.condition(p) for p in node.parts]
            out = parts[0]
            for part in parts[1:]:
                out = (out & part) if node.operator == "and" else (out | part)
            return out
        left = self.value(node.left)
        if node.operator in ("between", "not between"):
            low, high = self._range(node)
            inside = self._ordered(">=", left, low) & self._ordered("<=", left, high)
            return inside if node.operator == "between" else ~inside
        right = self.value(node.right)
        if node.operator == "=":
            return self._equal(left, right, node)
        if node.operator == "!=":
            return self._different(left, right)
        if node.operator in ("like", "not like"):
            if isinstance(right.literal, str):
                matched = F.ilike(text(left), F.lit(right.literal.replace("\\", "\\\\")))
            else:
                matched = scalar.like(text(left), text(right))
            if node.operator == "like" and (begins := self._begins(node.left, left, right, False)) is not None:
                return begins & matched
            return matched if node.operator == "like" else ~matched
        return self._ordered(node.operator, left, right)

    def _range(self, node: Compare) -> tuple[Value, Value]:
        if node.upper is not None:
            return self.value(node.right), self.value(node.upper)
        bounds = self.value(node.right)
        if isinstance(bounds.literal, str) and ":" in bounds.literal:
            low, _, high = bounds.literal.partition(":")
            as_value = lambda s: literal(float(s)) if scalar.REGISTRY and _plain(s) else literal(s.strip())
            return as_value(low), as_value(high)
        raise DialectError("BETWEEN takes 'low:high' or low AND high")

    @staticmethod
    def _sides(left: Value, right: Value) -> tuple[Column, Column]:
        """Both sides in one type: numbers as numbers, times as times, anything else as text without case."""
        if left.kind == "numeric" and right.kind == "numeric":
            return left.column, right.column
        if left.kind == "time" or right.kind == "time":
            if {left.kind, right.kind} <= {"time", "string", "open"} and not (isinstance(left.literal, str) and left.kind != "time" and not _timelike(left.literal)) and not (isinstance(right.literal, str) and not _timelike(right.literal)):
                return moment(left), moment(right)
        return _folded(left), _folded(right)

    def _equal(self, left: Value, right: Value, node: Compare) -> Column:
        if "null" in (left.kind, right.kind):
            return left.column.isNull() if right.kind == "null" else right.column.isNull()
        a, b = self._sides(left, right)
        if left.literal is not None or right.literal is not None:  # with a constant the same rows as the null-safe form, and it can be pushed to the scan
            begins = self._begins(node.left, left, right, True) if right.literal is not None else self._begins(node.right, right, left, True)
            return a == b if begins is None else begins & (a == b)
        if not self.null_equal or self.scope.never_null(node.right) or self.scope.never_null(node.left):
            return a == b  # a null on one side only matches nothing anyway
        return a.eqNullSafe(b)

    def _begins(self, node, value: Value, other: Value, whole: bool) -> Column | None:
        """What a text field must begin with (or be, with `whole`) to match a constant without case: a test on the bare field, which reaches the scan."""
        if not (isinstance(node, Field) and value.kind == "string" and isinstance(other.literal, str)) or self.replaced or self.outside:
            return None
        forms, n = [""], 0
        for ch in other.literal:
            if not ch.isascii() or (not whole and ch in "%_\\"):
                break
            spelt = [ch.lower(), ch.upper(), *_OTHER_CASES.get(ch.lower(), ())] if ch.isalpha() else [ch]
            if len(forms) * len(spelt) > MOST_FORMS:
                break
            forms, n = [f + c for f in forms for c in spelt], n + 1
        if not n:
            return None
        if whole and n == len(other.literal):
            return value.column.isin(*forms)
        out = value.column.startswith(forms[0])
        for form in forms[1:]:
            out = out | value.column.startswith(form)
        return out

    def _different(self, left: Value, right: Value) -> Column:
        if "null" in (left.kind, right.kind):
            return left.column.isNotNull() if right.kind == "null" else right.column.isNotNull()
        a, b = self._sides(left, right)
        return ~a.eqNullSafe(b)

    @staticmethod
    def _ordered(operator: str, left: Value, right: Value) -> Column:
        if "time" in (left.kind, right.kind):
            if isinstance(right.literal, str) and left.kind == "time" and _timelike(right.literal):
                a, b = left.column, F.lit(right.literal).cast("timestamp_ntz")
            else:
                a, b = moment(left), moment(right)
        elif left.kind == "numeric" and right.kind == "numeric":
            a, b = left.column, right.column
        else:
            a, b = number(left), number(right)
        return {"<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[operator]


def _folded(value: Value) -> Column:
    return F.lit(value.literal.lower()) if isinstance(value.literal, str) else text(value) if value.kind in ("numeric", "time") else F.lower(text(value))


def _plain(s: str) -> bool:
    try:
        float(s)
    except ValueError:
        return False
    return True


def _timelike(s: str) -> bool:
    import re

    return re.match(r"^\s*\d{4}-\d{1,2}-\d{1,2}", s) is not None
