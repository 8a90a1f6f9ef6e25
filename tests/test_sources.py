"""Schema lattice, normalisation, file readers and a few library operators."""

import json

import pytest
from pyspark.sql import functions as F

from loomgraph.functions import scalar
from loomgraph.operators import graph, relational
from loomgraph.sources import files


def test_merge_lattice():
    m = files.merge
    assert m("single", "list") == m("list", "single") == "list"
    assert m("single", "null") == "single"
    assert m("empty", "single") == "single"
    assert m("empty", "list") == "list"
    a = {"list": False, "fields": {"x": "single"}}
    assert m(a, "empty") == {"list": True, "fields": {"x": "single"}}
    assert m(a, "null") == m("null", a) == a
    for x, y in (("list", "null"), ("empty", "null"), ("empty", a)):
        with pytest.raises(TypeError):
            m(x, y)


def test_infer_and_normalize(spark):
    rows = [{"a": "1", "b": {"c": None}}, {"a": ["2", "3"], "b": {"c": "x", "d": [{"e": 1}]}}, {"a": [], "b": {"c": "y"}}]
    df = spark.createDataFrame([(json.dumps(r),) for r in rows], "value string")
    kind = files.infer(df)
    assert kind["fields"]["a"] == "list"
    assert files.paths(kind) == ["a", "b|c", "b|d|e"]
    assert files.normalize(rows[0], kind) == {"a": ["1"], "b": {"c": None, "d": []}}
    assert spark.createDataFrame([files.normalize(r, kind) for r in rows], files.spark_type(kind)).count() == 3


def test_readers(spark, tmp_path):
    (tmp_path / "a.csv").write_text('x , y\n1,"two\nlines"\n1,"two\nlines"\n')
    df = files.load(spark, str(tmp_path / "a.csv"))
    assert df.columns == ["x", "y"] and df.count() == 1
    (tmp_path / "a.json").write_text('[{"x": 1}, {"x": 2}]')
    assert files.load(spark, str(tmp_path / "a.json")).count() == 2
    (tmp_path / "a.xml").write_text("<r><item id='1'><n>a</n><n>b</n></item></r>")
    assert files.load(spark, str(tmp_path / "a.xml"), "item").first()["n"] == ["a", "b"]
    with pytest.raises(ValueError):
        files.load(spark, "a.bin")


def test_small_operators(spark):
    e = graph.quick_graph(spark, ["A--p--B", "B--q--C", "C--r--A"])
    assert {r[0] for r in graph.in_cycle(e).collect()} == {"A", "B", "C"}
    r = spark.createDataFrame([(1, 0, 5), (1, 4, 8), (1, 8, 9)], "k int, a int, b int")
    assert {(x.a, x.b) for x in relational.merge_ranges(r, ["k"], "a", "b").collect()} == {(0, 8), (8, 9)}
    t = spark.createDataFrame([("abcabcab", "1850-1900")], "t string, y string")
    row = t.select(scalar.find_all("ab", F.col("t")).alias("f"), scalar.split_years(F.col("y")).alias("y"), scalar.pad(F.lit("ab"), 5, "center").alias("p")).first()
    assert list(row.f) == [0, 3, 6] and row.y.death == "1900" and row.p == " ab  "


def test_history_keeps_what_was_true_in_the_end(spark):
    from loomgraph.sources import history

    col = lambda *names: [{"columnName": n} for n in names]
    one = lambda *names: json.dumps([{"value": col(*names)}])
    typed = lambda path, uri, node: {"commandName": "SetSemanticTypeCommand", "inputParameters": [{"name": "SemanticTypesArray", "value": [{"DomainUri": "ex:A", "FullType": uri, "DomainId": node, "isPrimary": True}]}, {"name": "inputColumns", "value": one(*path)}]}
    edge = lambda kind, s, label, t, **more: {"commandName": kind, "inputParameters": [{"name": "edge", "value": {"edgeSourceId": s, "edgeId": label, "edgeTargetId": t, **more}}]}
    steps = [
        typed(("rows", "name"), "ex:first", "ex:A1 (add)"),
        {"commandName": "OrganizeColumnsCommand", "inputParameters": []},
        {"commandName": "SubmitPythonTransformationCommand", "inputParameters": [{"name": "transformationCode", "value": "return getValue('name') + '!'"}, {"name": "errorDefaultValue", "value": ""}, {"name": "inputColumns", "value": one("rows", "name")}, {"name": "outputColumns", "value": one("rows", "loud")}]},
        typed(("rows", "name"), "ex:second", "ex:A1"),
        typed(("rows", "loud"), "ex:loud", "ex:A1"),
        typed(("rows", "tags", "Values"), "ex:tag", "ex:A1"),
        {"commandName": "UnassignSemanticTypeCommand", "inputParameters": [{"name": "inputColumns", "value": one("rows", "loud")}]},
        edge("AddLinkCommand", "ex:A1", "ex:knows", "ex:B1", edgeSourceUri="ex:A", edgeTargetUri="ex:B"),
        {"commandName": "ChangeInternalNodeLinksCommand", "inputParameters": [{"name": "newEdges", "value": [{"edgeSourceId": "ex:A1", "edgeId": "ex:likes", "edgeTargetId": "ex:B1"}]}]},
        edge("AddLinkCommand", "ex:A1", "ex:has", "ex:C1"),
        edge("DeleteLinkCommand", "ex:A1", "ex:has", "ex:C1"),
        {"commandName": "AddLiteralNodeCommand", "inputParameters": [{"name": "literalValue", "value": "x"}]},
        edge("AddLinkCommand", "ex:A1", "ex:is", "x1", edgeSourceUri="ex:A"),
    ]
    columns = [col("rows", "name"), col("rows", "tags", "Values")]
    triples = spark.createDataFrame([("s", "http://x.org/dev#" + history.HISTORY, json.dumps(steps)), ("s", "http://x.org/dev#" + history.COLUMNS, json.dumps(columns)), ("s", "p", "o")], "s string, p string, o string")
    got = history.commands(*history.texts(triples), ["name", "tags"])
    by = {(c["_type_"], c.get("input_attr_path") or c.get("new_attr_name") or c.get("target_id")): c for c in got}
    assert len(by) == len(got) == 6
    assert by["SetSemanticType", "name"]["type"] == "ex:second" and by["SetSemanticType", "name"]["node_id"] == "ex:A1"
    assert by["SetSemanticType", "tags"]["type"] == "ex:tag" and by["SetSemanticType", "literal:x:1"]["type"] == "ex:is"
    assert by["PyTransformNewColumn", "loud"]["code"] == "return getValue(\"name\") + '!'" and by["PyTransformNewColumn", "loud"]["input_attr_paths"] == ["name"]
    assert by["SetInternalLink", "ex:B1"]["link_lbl"] == "ex:likes" and by["SetInternalLink", "ex:B1"]["target_uri"] == "ex:B"
    assert by["AddLiteralColumnCmd", "literal:x:1"]["val"] == "x"
    with pytest.raises(ValueError):
        history.commands(json.dumps([{"commandName": "FoldCommand", "inputParameters": []}]), "[]", [])
