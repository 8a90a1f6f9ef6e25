"""Walks without a bound, the integration graph, mappings, tensors and documents, beside plain Python and numpy."""

import json
import random
import re
from itertools import permutations

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph import settings
from loomgraph.functions import annotate, scalar
from loomgraph.operators import evaluation, graph, integration, relational, statistics, tensors
from loomgraph.plans import extended
from loomgraph.sources import documents, files, store


def edges(spark, pairs):
    return spark.createDataFrame([(a, b, "x") for a, b in pairs], "src string, dst string, label string")


def chain(n):
    return [(f"n{i:02d}", f"n{i + 1:02d}") for i in range(n)]


def test_walks_have_no_bound(spark):
    e = edges(spark, chain(12))
    assert graph.descendants(e).count() == graph.paths(e).count() == 78
    assert graph.cascade(e, spark.createDataFrame([("n00",)], "node string")).count() == 13
    assert graph.in_cycle(e).count() == 0
    ring = edges(spark, [*chain(11), ("n11", "n00"), ("n03", "out"), ("in", "n05")])
    assert {r.node for r in graph.in_cycle(ring).collect()} == {f"n{i:02d}" for i in range(12)}
    with pytest.raises(ValueError):
        graph.paths(ring)
    assert graph.descendants(ring, spark.createDataFrame([("in",)], "node string")).count() == 13
    assert graph.descendants(e.limit(0)).count() == graph.paths(e.limit(0)).count() == graph.in_cycle(e.limit(0)).count() == 0


def test_walks_on_a_dense_graph(spark):
    """Many walks, few pairs: every node of twenty leads to every later one."""
    pairs = [(f"n{i:02d}", f"n{j:02d}") for i in range(20) for j in range(i + 1, 20)]
    got = graph.descendants(edges(spark, pairs)).collect()
    assert len(got) == 190 and {r.hops for r in got} == {1}


def test_prune_goes_up_all_the_way(spark):
    e = edges(spark, [*chain(12), ("n00", "side")])
    left = graph.prune_childless(e, spark.createDataFrame([("n12",)], "node string")).collect()
    assert {(r.src, r.dst) for r in left} == {("n00", "side")}


def test_integration_prefers_the_same_parent(spark):
    rows = [
        ("a", "p1", "Person", "knows", "p2", "Person", False), ("a", "p2", "Person", "name", "d1", "n", True),
        ("b", "q1", "Person", "knows", "q2", "Person", False), ("b", "q2", "Person", "name", "e1", "m", True), ("b", "q2", "Person", "name", "e2", "m", True),
        ("c", "r1", "Place", "label", "f1", "l", True),
    ]
    got = integration.integration_graph(spark.createDataFrame(rows, "model string, src string, src_label string, label string, dst string, dst_label string, data boolean")).collect()
    by = {(r.src_label, r.label, tuple(r.tags)) for r in got}
    assert by == {("Person", "knows", ("a", "b")), ("Person", "name", ("a", "b")), ("Person", "name", ("b",)), ("Place", "label", ("c",))}
    assert len({r.src for r in got if r.label == "name"}) == 1


def test_gold_mapping(spark):
    g = spark.createDataFrame([(1, 10, "A", "p", True, ["x", "y"]), (2, 10, "A", "q", True, ["x"]), (3, 11, "A", "p", True, ["x"]), (4, 12, "B", "p", True, ["y"])], "edge long, src long, src_label string, label string, data boolean, tags array<string>")
    a = spark.createDataFrame([("x", "a1", "n1", "A", "p"), ("x", "a2", "n1", "A", "q"), ("x", "a3", "n2", "A", "p"), ("y", "b1", "m1", "A", "p"), ("y", "b2", "m2", "B", "p")], "model string, attr string, node string, cls string, predicate string")
    got = {(r.model, r.attr): r.edge for r in integration.gold_mapping(g, a).collect()}
    assert got == {("x", "a1"): 1, ("x", "a2"): 2, ("x", "a3"): 3, ("y", "b1"): 1, ("y", "b2"): 4}


def test_mapping_model_fits(spark):
    rng = random.Random(3)
    rows = [(i, c := rng.random(), rng.random() - 1, rng.random(), rng.random(), float(c > 0.5), c) for i in range(200)]
    f = spark.createDataFrame(rows, "mapping long, confidence double, local double, reduction double, common double, right double, precision double")
    assert integration.fit_mapping_score(f, "precision").transform(f).select(F.max(F.abs(F.col("prediction") - F.col("precision")))).first()[0] < 0.05
    hits = integration.fit_mapping_score(f, "right", logistic=True).transform(f).where("prediction = right").count()
    assert hits > 180


def test_assignment_is_the_best_one():
    rng = random.Random(5)
    for _ in range(60):
        n, m = sorted((rng.randint(1, 5), rng.randint(1, 6)))
        gains = [[rng.randint(0, 6) for _ in range(m)] for _ in range(n)]
        assert integration._assign(gains) == max(sum(gains[i][p[i]] for i in range(n)) for p in permutations(range(m), n))


def test_ranked_without_one_task(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k")).repartition(7)
    got = relational.ranked(df, ["k"], "i", parts=5).collect()
    assert all(r.k == r.i for r in got) and len(got) == 1000


def test_coherence_has_a_bound(spark):
    many = spark.createDataFrame([("c", i, "p", f"s{i:02d}") for i in range(25)], "cls string, node int, parent string, slot string")
    with pytest.raises(Exception, match="slots"):
        statistics.coherence_table(many).count()


def test_constraint_chance(spark):
    learned = spark.createDataFrame([("c", "a", "b", 4, 0.75, 0.5)], "cls string, a string, b string, n long, at_least double, at_most double")
    pairs = spark.createDataFrame([("c", "a", "b", True), ("c", "a", "b", False), ("d", "a", "b", True)], "cls string, a string, b string, ge boolean")
    assert sorted((r.cls, r.ge, r.chance) for r in statistics.constraint_chance(learned, pairs).collect()) == [("c", False, 0.5), ("c", True, 0.75), ("d", True, 0.5)]


def as_array(t):
    out = np.full(t.shape, np.nan)
    for r in t.cells.collect():
        out[tuple(r[d] for d in t.dims)] = r["v"]
    return out


def test_tensors_against_numpy(spark, tmp_path):
    a, b = tensors.randn(spark, 3, 4, seed=1), tensors.randn(spark, 4, 2, seed=2)
    x, y = as_array(a), as_array(b)
    assert np.isfinite(x).all() and abs(x.mean()) < 1.5 and np.array_equal(x, as_array(tensors.randn(spark, 3, 4, seed=1)))
    assert np.allclose(as_array(a.matmul(b)), x @ y)
    assert np.allclose(as_array(a.at(1).matmul(b)), x[1] @ y)
    assert np.allclose(as_array(a.at(0).outer(b.at(None, 1))), np.outer(x[0], y[:, 1]))
    assert np.allclose(as_array(a.sum(0)), x.sum(0)) and np.allclose(as_array(a.argmax(1)), x.argmax(1))
    assert np.allclose(as_array(a.log_sum_exp()), np.log(np.exp(x).sum())) and np.allclose(as_array(a.log_sum_exp(0)), np.log(np.exp(x).sum(0)))
    assert np.allclose(as_array(a.view(2, 6)), x.reshape(2, 6)) and np.allclose(as_array(a.view(1, 3, 4).squeeze()), x)
    assert np.allclose(as_array(a.at(slice(None, None, 2), slice(1, 3))), x[::2, 1:3])
    assert np.allclose(as_array(tensors.concat([a, a.at(slice(0, 1))])), np.concatenate([x, x[:1]]))
    z = x.copy()
    z[:, 2] = x[:, 0]
    assert np.allclose(as_array(a.assign((None, 2), a.at(None, 0))), z)
    assert (a + 0.0).same(a) and not (a + 1.0).same(a)
    tensors.write(a, f"{tmp_path}/t")
    assert tensors.read(spark, f"{tmp_path}/t").same(a)
    with pytest.raises(ValueError):
        a.view(5, 5)


def test_documents_unwrap(spark, tmp_path):
    rows = [{"a": 1, "b": {"c": ["x"]}}, {"a": 2, "b": {"c": "y"}}, {"a": 1, "b": {"c": ["x"]}}]
    (tmp_path / "wrapped.json").write_text(json.dumps({"result": {"rows": rows}}))
    (tmp_path / "lines.json").write_text("\n".join(json.dumps(r) for r in rows))
    (tmp_path / "plain.json").write_text(json.dumps(rows))
    (tmp_path / "doc.yml").write_text("rows:\n- a: 1\n  b: {c: [x]}\n- a: 2\n  b: {c: y}\n")
    (tmp_path / "doc.xml").write_text("<rows><row a='1'><b><c>x</c></b></row><row a='2'><b><c>y</c><c>z</c></b></row></rows>")
    (tmp_path / "loose.xml").write_text("<row a='1'>t</row><row a='2'>u</row>")
    (tmp_path / "two.json").write_text(json.dumps({"a": [], "b": []}))
    for name in ("wrapped.json", "lines.json", "plain.json", "doc.yml"):
        got = documents.load_table(spark, str(tmp_path / name))
        assert sorted((r.a, r.b.c) for r in got.collect()) == [("1", ["x"]), ("2", ["y"])]
    assert documents.load_table(spark, str(tmp_path / "plain.json"), n_rows=1).count() == 1
    xml = documents.load_table(spark, str(tmp_path / "doc.xml"))
    assert sorted((r["@a"], r.b.c) for r in xml.collect()) == [("1", ["x"]), ("2", ["y", "z"])]
    assert sorted((r["@a"], r["#text"]) for r in documents.load_table(spark, str(tmp_path / "loose.xml")).collect()) == [("1", "t"), ("2", "u")]
    with pytest.raises(Exception, match="several properties"):
        documents.rows(spark, str(tmp_path / "two.json")).count()
    assert documents.from_rows(spark, [{"k": None}, {"k": 3}]).count() == 2


def test_model_edges(spark):
    model = {"id": "m", "graph": {"nodes": [{"id": "n1", "type": "InternalNode", "label": {"uri": "ex:A"}}, {"id": "n2", "type": "ColumnNode", "label": {"uri": "col"}}], "links": [{"id": "n1---ex:p---n2"}]}}
    got = documents.model_edges(spark.createDataFrame([(json.dumps(model),)], "value string")).collect()
    assert [tuple(r) for r in got] == [("m", "n1", "ex:A", "ex:p", "n2", "col", True)]


def test_kinds_change():
    kind = files.kind_of({"a": 1, "b": {"c": [2], "d": None}})
    assert files.has_path(kind, "b|c") and not files.has_path(kind, "b|x") and files.steps_to(kind, "b|c") == "list"
    more = files.add_path(files.add_path(kind, "b|x", "single", after="b|c"), "z", "list")
    assert files.paths(more) == ["a", "b|c", "b|x", "b|d", "z"]
    assert files.paths(files.remove_path(files.remove_path(files.remove_path(more, "b|c"), "b|x"), "b|d")) == ["a", "z"]
    assert files.from_text(files.to_text(more)) == more and files.kind_of_schema(files.spark_type(more))["fields"]["z"] == "list"


def test_store(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a,"b"'), (2, "c\td"), (3, "")], "k long, v string")
    for end in ("csv", "tsv", "json", "parquet"):
        store.write(df, f"{tmp_path}/out.{end}")
        back = store.read(spark, f"{tmp_path}/out.{end}", "k long, v string")
        assert sorted((r.k, r.v or "") for r in back.collect()) == sorted((r.k, r.v) for r in df.collect())
    made = []
    one = lambda: made.append(1) or df
    assert store.cached(spark, str(tmp_path), "kept", one).count() == store.cached(spark, str(tmp_path), "kept", one).count() == 3 and made == [1]
    store.save_weights(spark, [0.5, -1.0], ["x", "y"], f"{tmp_path}/w")
    assert store.load_weights(spark, f"{tmp_path}/w") == (["x", "y"], [0.5, -1.0])
    tagged = df.select(store.tagged_json("Pair", {"k": F.col("k")}).alias("t"))
    assert [r.p.k for r in tagged.select(store.from_tagged(F.col("t"), "Pair", "k long").alias("p")).orderBy("p.k").collect()] == [1, 2, 3]
    assert tagged.select(store.from_tagged(F.col("t"), "Other", "k long").alias("p")).where("p is not null").count() == 0


def test_wrap_keeps_long_parts(spark):
    def plain(word, most):
        out = ""
        for part in re.split(r"(?<=[ :_/])|(?<=[^A-Z :_/])(?=[A-Z])", word):
            room = most - (len(out) - out.rfind("\n") - 1)
            out += part if len(part) <= room else "\n" + part
        return out

    rng = random.Random(8)
    words = ["".join(rng.choice("abAB :_/1") for _ in range(rng.randint(0, 40))) for _ in range(200)]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    assert [r.x for r in df.select(scalar.auto_wrap(F.col("w"), 7).alias("x")).collect()] == [plain(w, 7) for w in words]


def test_coherence_of_like_sets_is_one_comparison(spark):
    """Random sets, equal sets, nulls in every column beside brute force; pairs grow with the different sets, not with the rows."""
    rng = random.Random(13)
    maybe = lambda n: None if (x := rng.randrange(n)) == 0 else x
    own, known = [(maybe(30), maybe(9)) for _ in range(150)], [(maybe(12), maybe(9)) for _ in range(50)]
    got = evaluation.coherence(spark.createDataFrame(own, "candidate long, triple long"), spark.createDataFrame(known, "model long, triple long"))
    models = [{t for m, t in known if m == k and t is not None} for k in {m for m, _ in known}]
    want = {}
    for c in {c for c, _ in own}:
        held = {t for k, t in own if k == c}
        want[c] = max(len(held & m) for m in models) / len(held) if c is not None else 0
    assert {r.candidate: r.coherence for r in got.collect()} == pytest.approx(want) and None in want and any(0 < v < 1 for v in want.values())
    many = lambda name: spark.range(400).select(F.col("id").alias(name), F.explode(F.sequence(F.lit(0), 4 + F.col("id") % 3)).alias("triple"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        like = evaluation.coherence(many("candidate"), many("model"))
        assert [r.coherence for r in like.collect()] == [1.0] * 400
        nodes, joined = [like._jdf.queryExecution().executedPlan()], 0
        while nodes:
            node = nodes.pop()
            if "Join" in node.nodeName():
                joined += node.metrics().apply("numOutputRows").value()
            nodes += [node.children().apply(i) for i in range(node.children().size())]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert 0 < joined < 2000


def test_marks_nest():
    rng = random.Random(17)
    for _ in range(200):
        text = "".join(rng.choice("abc ") for _ in range(rng.randint(0, 30)))
        spans = []
        for k in range(rng.randint(0, 6)):
            a, b = sorted((rng.randint(0, len(text)), rng.randint(0, len(text))))
            spans += [{"start": a, "end": b, "open": f"<{k}>", "close": f"</{k}>"}] * (a < b)
        for nested in (True, False):
            out, open_ = annotate.marked(text, spans, nested), []
            assert re.sub(r"</?\d>", "", out) == text
            for mark in re.findall(r"</?\d>", out):
                if mark.startswith("</"):
                    assert open_.pop() == mark[2]
                else:
                    open_.append(mark[1])
                    assert nested or len(open_) == 1
            assert not open_
            # What is marked is marked at its place.
            for s in spans:
                if s["open"] in out:
                    inner = out[out.index(s["open"]) + 3 : out.index(s["close"])]
                    assert re.sub(r"</?\d>", "", inner) == text[s["start"] : s["end"]]
    with pytest.raises(ValueError):
        annotate.marked("abcd", [{"start": 0, "end": 2, "open": "", "close": ""}, {"start": 1, "end": 3, "open": "", "close": ""}], crossed="error")


def test_marks_of_odd_texts(spark, tmp_path):
    """Texts of one word or one letter, without words or null, beside the query's SQL; null and outer bounds, empty spans."""
    texts = ["word", "a", "a b", "ab c", "", " ", " lead", "two  spaces", None, "é", "naïve \U0001f926\u200d x", "tab\there it"]
    spark.createDataFrame(list(enumerate(texts)), "item_id long, text string").coalesce(1).write.parquet(str(tmp_path / "benchmark.parquet"))
    run, sql = extended.QUERIES["fn12_annotate"]
    want = duckdb.sql(sql.replace("FROM benchmark", f"FROM read_parquet('{tmp_path}/benchmark.parquet/*.parquet')")).fetchall()
    assert sorted(map(tuple, run(spark, str(tmp_path)).collect())) == sorted(want) and len(want) == len(texts)
    mark = lambda text, *spans: annotate.marked(text, [{"start": a, "end": b, "open": f"<{k}>", "close": f"</{k}>"} for k, (a, b) in enumerate(spans)])
    assert mark("abc", (1, 1), (0, 3), (3, 3), (1, 1)) == "<1>a<0><3></3></0>bc</1><2></2>"
    assert mark("abc", (-1, 2), (1, 4), (None, 1), (0, 1), (1, 1)) == "<3>a</3><4></4>bc"


def test_settings():
    s = settings.Settings()
    assert s.with_({"searching_beam": "7"}).searching_beam == 7 and s.searching_beam == 10
    with pytest.raises(KeyError):
        s.with_({"beam": 1})
    got = settings.load_config('{"home": "s3://box/a", "n": 3, "in": {"path": "${home}/x", "many": "${n}", "all": ["${in.path}"]}}')
    assert got["in"] == {"path": "s3://box/a/x", "many": 3, "all": ["s3://box/a/x"]}
    with pytest.raises(ValueError):
        settings.resolved({"a": "${b}", "b": "${a}"})
    assert settings.join_path("s3://box/a", "../b") == "s3://box/b" and settings.join_path("/a", "b/../c") == "/a/c"
    assert settings.join_path("hdfs://h:1/a", "/x") == "hdfs://h:1/x" and settings.join_path("/a", "s3://c/d") == "s3://c/d"
