"""Random dialect conditions against their plain reading in Python."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from papyrion.engine import Engine

ROWS = [(i, x, s) for i, (x, s) in enumerate((x, s) for x in (None, -1.5, 0.0, 2.0, 7.0) for s in (None, "a", "A", "b%", "Cat"))]

number = st.sampled_from([-1.5, 0.0, 2.0, 3.25])
word = st.sampled_from(["a", "A", "b%", "cat", "zzz"])
test = st.one_of(
    st.tuples(st.just("x"), st.sampled_from(["=", "!=", "<", "<=", ">", ">="]), number),
    st.tuples(st.just("s"), st.sampled_from(["=", "!="]), word),
    st.tuples(st.just("s"), st.sampled_from(["LIKE", "NOT LIKE"]), st.sampled_from(["a", "%a%", "_at", "%"])),
)
condition = st.recursive(test, lambda inner: st.tuples(st.sampled_from(["AND", "OR"]), inner, inner), max_leaves=6)


def written(c):
    if c[0] in ("AND", "OR"):
        return f"({written(c[1])} {c[0]} {written(c[2])})"
    value = f"'{c[2]}'" if isinstance(c[2], str) else str(c[2])
    return f"{c[0]} {c[1]} {value}"


def matches(pattern, text):
    if not pattern:
        return not text
    if pattern[0] == "%":
        return any(matches(pattern[1:], text[i:]) for i in range(len(text) + 1))
    return bool(text) and pattern[0] in ("_", text[0]) and matches(pattern[1:], text[1:])


def holds(c, x, s):
    if c[0] in ("AND", "OR"):
        a, b = holds(c[1], x, s), holds(c[2], x, s)
        return a and b if c[0] == "AND" else a or b
    value, (_, operator, other) = (x if c[0] == "x" else s), c
    if operator == "!=":
        return value is None or (value.lower() != other.lower() if isinstance(other, str) else value != other)
    if value is None:
        return False
    if "LIKE" in operator:
        return matches(other.lower(), value.lower()) == (operator == "LIKE")
    if isinstance(other, str):
        return value.lower() == other.lower()
    return {"=": value == other, "<": value < other, "<=": value <= other, ">": value > other, ">=": value >= other}[operator]


@settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(condition, min_size=4, max_size=4))
def test_where(spark, conditions):
    engine = Engine(spark)
    engine.register("t", spark.createDataFrame(ROWS, "id int, x double, s string"))
    for c in conditions:
        got = {r[0] for r in engine.sql(f"SELECT id FROM t WHERE {written(c)}").collect()}
        assert got == {i for i, x, s in ROWS if holds(c, x, s)}, written(c)


def test_sticky_sort(spark):
    data = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "x int, y string")
    for sticky, expected in ((False, ["c", "a", "b"]), (True, ["c", "b", "a"])):
        engine = Engine(spark, sticky_sort=sticky)
        engine.register("t", data)
        assert [r[0] for r in engine.sql("SELECT y FROM t ORDER BY x DESC, y").collect()] == expected
