import json

from papyrion.operators.schema_drift import alternatives, changes, file_schemas, unified
from tests.conftest import rows

SCHEMA = "schemapath string, fileseq int, docpointer string, elements string, kind string, value string, field string"


def documents(spark, files, path="A"):
    data = [(path, seq, pointer, body if isinstance(body, (str, type(None))) else json.dumps(body), "clash", "clash", "clash") for seq, docs in files.items() for pointer, body in docs.items()]
    return spark.createDataFrame(data, SCHEMA)


def test_each_kind_of_change(spark):
    first = {str(i): {"Id": i, "Name": f"n{i}", "Gone": 1, "Price": i} for i in range(6)}
    second = {str(i): {"id": i, "Title": f"n{i}", "Price": i + 0.5, "New": None} for i in range(4)} | {"9": {"id": 9, "Title": "other", "Price": 1.5}}
    found = rows(changes(documents(spark, {1: first, 2: second})))
    assert found == [("A", 2, "added", "", "new"), ("A", 2, "removed", "gone", ""), ("A", 2, "renamed", "name", "title"), ("A", 2, "retyped", "price", "price")]


def test_whole_and_fraction_and_quoted_numbers_differ(spark):
    docs = documents(spark, {1: {"a": '{"x": 17}'}, 2: {"a": '{"x": 17.0}'}, 3: {"a": '{"x": "17"}'}, 4: {"a": '{"x": true}'}, 5: {"a": '{"x": 123456789012345678901234}'}})
    assert [r[1:3] for r in rows(changes(docs))] == [(2, "retyped"), (3, "retyped"), (4, "retyped"), (5, "retyped")]
    assert {r["fileseq"]: r["kind"] for r in file_schemas(docs).collect()} == {1: "whole", 2: "fraction", 3: "text", 4: "truth", 5: "whole"}


def test_a_rename_needs_most_old_values_and_shared_documents(spark):
    old = {str(i): {"a": i} for i in range(4)}
    half = {str(i): {"b": i if i < 2 else 100} for i in range(4)}
    assert [r[2] for r in rows(changes(documents(spark, {1: old, 2: half})))] == ["added", "removed"]
    elsewhere = {f"x{i}": {"b": i} for i in range(4)}
    assert [r[2] for r in rows(changes(documents(spark, {1: old, 2: elsewhere})))] == ["added", "removed"]
    retyped = {str(i): {"b": str(i)} for i in range(4)}
    assert [r[2:] for r in rows(changes(documents(spark, {1: old, 2: retyped})))] == [("renamed", "a", "b")]


def test_each_field_is_renamed_once(spark):
    old = {str(i): {"a": i, "b": i} for i in range(4)}
    new = {str(i): {"c": i} for i in range(4)}
    assert [r[2:] for r in rows(changes(documents(spark, {1: old, 2: new})))] == [("removed", "b", ""), ("renamed", "a", "c")]


def test_bad_documents_nulls_gaps_and_repeats(spark):
    docs = documents(spark, {1: {"a": '{"x": 1}', "b": "no json", "c": None, "d": "[1]", "e": '{"x": 1, "x": 2}'}, 2: {"a": "{}"}, 4: {"a": '{"y": 1}'}})
    assert rows(changes(docs.unionByName(docs))) == [("A", 2, "removed", "x", "")]
    nulls = spark.createDataFrame([(None, 1, "a", '{"x": 1}'), ("A", None, "a", '{"x": 1}'), ("A", 1, None, '{"x": 1}'), ("A", 2, None, '{"y": 1}')], "schemapath string, fileseq int, docpointer string, elements string")
    assert [r[2] for r in rows(changes(nulls))] == ["added", "removed"]


def test_empty_table(spark):
    empty = documents(spark, {})
    assert rows(changes(empty)) == [] and rows(alternatives(empty)) == [] and rows(file_schemas(empty)) == [] and rows(unified(empty)) == []


def test_unified_follows_renames_and_keeps_typed_branches(spark):
    files = {1: {"1": {"a": 1}, "2": {"a": 2}, "4": {"a": 4}}, 2: {"1": {"b": "1"}, "2": {"b": "2"}, "4": {"b": "4"}}, 3: {"1": {"c": 1.0}, "2": {"c": 2.5}, "3": {"c": True}, "4": {"c": 4.0}}}
    got = {(r["fileseq"], r["docpointer"]): r for r in unified(documents(spark, files)).collect()}
    assert {r["column"] for r in got.values()} == {"a"}
    assert got[1, "1"]["v_whole"] == 1 and got[2, "1"]["v_text"] == "1" and got[3, "2"]["v_fraction"] == 2.5 and got[3, "3"]["v_truth"] is True
    assert got[1, "1"]["canonical"] == got[2, "1"]["canonical"] == got[3, "1"]["canonical"] == "1"


def test_a_very_long_value(spark):
    docs = documents(spark, {1: {"a": {"x": "y" * 300_000}}, 2: {"a": {"z": "y" * 300_000}}})
    assert [r[2:] for r in rows(changes(docs))] == [("renamed", "x", "z")]


def test_paths_below_the_top_level_and_alternatives(spark):
    first = {str(i): {"a": 1, "n": {"x": 1, "deep": [{"p": 1}]}} for i in range(3)}
    second = {"0": {"a": "text", "n": {"x": "1", "y": 2, "deep": [{"p": 1}, {"p": 1.5}]}}, "1": {"a": 1, "n": {"x": "2"}}, "2": {"a": 1, "n": None}}
    docs = documents(spark, {1: first, 2: second})
    assert [r[1:] for r in rows(changes(docs))] == [(2, "added", "", "n.y"), (2, "retyped", "n.x", "n.x")]
    assert [r[1:] for r in rows(alternatives(docs))] == [(2, "a", "text", "appears", 1), (2, "n.deep[].p", "fraction", "appears", 1), (2, "n.x", "text", "appears", 2), (2, "n.x", "whole", "leaves", 3)]
    assert {r["field"]: r["kind"] for r in file_schemas(docs).where("fileseq = 1").collect()} == {"a": "whole", "n": "object", "n.x": "whole", "n.deep": "array", "n.deep[]": "object", "n.deep[].p": "whole"}


def test_a_renamed_field_in_an_object_and_very_deep_values(spark):
    old, new = ({str(i): {"n": {name: i}} for i in range(4)} for name in ("x", "z"))
    assert [r[2:] for r in rows(changes(documents(spark, {1: old, 2: new})))] == [("renamed", "n.x", "n.z")]
    deep = 1
    for _ in range(20):
        deep = {"d": deep}
    assert {r["kind"] for r in file_schemas(documents(spark, {1: {"1": deep}})).collect()} == {"object"}
