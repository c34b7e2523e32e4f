import pytest

from papyrion.dialect.lexer import DialectError, tokens
from papyrion.dialect.nodes import Chain, Compare, Delete, Field, Insert, Logic, Select, Star, Statement, Update
from papyrion.dialect.parser import parse


def one(text):
    (statement,) = parse(text)
    return statement


def test_tokens_and_comments():
    found = tokens("a.b -- rest\n/* x\ny */ 'it''s' \"q\" @V 1.5e3 >= #tmp")
    assert [(t.kind, t.text) for t in found] == [("word", "a"), ("symbol", "."), ("word", "b"), ("string", "it's"), ("string", "q"), ("variable", "@V"), ("number", "1.5e3"), ("symbol", ">="), ("word", "#tmp"), ("end", "")]
    assert found[3].line == 3
    with pytest.raises(DialectError):
        tokens("a ? b")


def test_select_clauses():
    s = one("SELECT DISTINCT TOP 5 a.x AS y, *, b.*, FROM S:A AS a INNER JOIN S:B AS b ON a.i = b.i AND a.j != b.j OUTER JOIN C AS c ON c.k > a.k WHERE (a.x + 1) * 2 = 4 OR (a.y LIKE 'q%' AND NOT_A = 1) GROUP BY a.x, f(a.y) ORDER BY a.x DESC, y OFFSET 3")
    assert isinstance(s, Select) and s.distinct == "before" and s.top.value == 5 and s.offset.value == 3
    assert [type(f).__name__ for f in s.fields] == ["SelectField", "Star", "Star"] and s.fields[2] == Star("b")
    assert [(x.path, x.alias, x.join) for x in s.sources] == [("S:A", "a", ""), ("S:B", "b", "inner"), ("C", "c", "outer")]
    assert isinstance(s.where, Logic) and s.where.operator == "or" and isinstance(s.where.parts[0], Compare) and isinstance(s.where.parts[0].left, Chain)
    assert len(s.group_by) == 2 and [o.descending for o in s.order_by] == [True, False]
    assert one("SELECT TOP 3 DISTINCT a FROM b").distinct == "after"
    assert one("SELECT a INTO #t FROM b").into == "#t"


def test_conditions():
    where = one("SELECT a FROM b WHERE a BETWEEN '1:2' AND c NOT BETWEEN 1 AND 2 AND d NOT LIKE 'x' AND e <> 1").where
    assert [p.operator for p in where.parts] == ["between", "not between", "not like", "!="]
    assert where.parts[0].upper is None and where.parts[1].upper.value == 2


def test_changes_of_data():
    insert = one("INSERT INTO a:b (x: 1, y: 'z'), (x: 2)")
    assert isinstance(insert, Insert) and [[n for n, _ in r] for r in insert.rows] == [["x", "y"], ["x"]]
    assert one("INSERT INTO a (x, y) VALUES (1, 2), (3, 4)").names == ["x", "y"]
    assert isinstance(one("INSERT INTO a (x) SELECT y FROM b").select, Select)
    update = one("UPDATE u SET x = 1, y = u.x + 2 FROM a AS t INNER JOIN b AS u ON u.i = t.i WHERE t.i = 1")
    assert isinstance(update, Update) and update.target == "u" and len(update.assignments) == 2 and len(update.sources) == 2
    assert isinstance(one("DELETE FROM a:b WHERE x = 1"), Delete) and one("DELETE d FROM a AS d INNER JOIN b AS e ON e.i = d.i").target == "d"


@pytest.mark.parametrize(
    ("text", "verb"),
    [
        ("CREATE SCHEMA a:b WITH (PageSize = 50)", "create schema"), ("DROP SCHEMA a", "drop schema"), ("ALTER SCHEMA a WITH (PageSize = 5)", "alter schema"),
        ("CREATE INDEX i(x, y) ON a WITH (PARTITIONS = 10)", "create index"), ("CREATE UNIQUEKEY i(x) ON a", "create uniquekey"), ("DROP UNIQUEKEY i ON a", "drop uniquekey"), ("REBUILD INDEX i ON a", "rebuild index"),
        ("ANALYZE INDEX i ON a", "analyze index"), ("ANALYZE SCHEMA a WITH (IncludePhysicalPages = true)", "analyze schema"), ("ALTER CONFIGURATION WITH (x = 1, y = 'z')", "alter configuration"),
        ("SAMPLE a SIZE 5", "sample"), ("LIST DOCUMENTS a", "list documents"), ("LIST SCHEMAS a:b SIZE 2", "list schemas"), ("BEGIN TRANSACTION", "begin transaction"), ("COMMIT TRANSACTION", "commit transaction"),
        ("ROLLBACK TRANSACTION", "rollback transaction"), ("DECLARE @x = 1 + 2", "declare"), ("SET WarnMissingFields true", "set"), ("EXEC Print('x')", "exec"), ("KILL 3", "kill"),
        ("CREATE ACCOUNT a WITH (Password = 'p')", "create account"), ("DROP ROLE r", "drop role"), ("ALTER ROLE r ADD u", "alter role add"), ("GRANT READ ON a:b TO r WITH (Recursive = true)", "grant"), ("DENY ALL ON : TO r", "deny"), ("REVOKE WRITE ON a FROM r", "revoke"),
    ],
)
def test_other_statements(text, verb):
    statement = one(text)
    assert isinstance(statement, Statement) and statement.verb == verb


def test_batches_and_errors():
    assert len(parse("SELECT a FROM b; SELECT c FROM d DELETE FROM e BEGIN TRANSACTION COMMIT TRANSACTION")) == 5
    assert parse("  -- nothing\n") == []
    assert one("SELECT Value FROM Single").fields[0].value == Field("", "Value")
    for bad in ("SELECT", "SELECT a", "SELECT a FROM", "SELECT a FROM b WHERE", "FOO", "INSERT INTO a (x) VALUES (1, 2)", "SELECT a FROM b JOIN c", "SELECT (1 FROM b", "GRANT FLY ON a TO r"):
        with pytest.raises(DialectError):
            parse(bad)
