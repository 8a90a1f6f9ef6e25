"""Models grown by the beam against all models there are; eliminations, worksheets, folds."""

import math
import random

import pytest
from pyspark.sql import functions as F

from loomgraph.operators import evaluation, mapping, modelling


def grown(types, links):
    """The best score over every way to build a model, by plain recursion."""
    attrs = sorted({t[0] for t in types})

    def step(nodes, edges, data, k):
        if k == len(attrs):
            yield 0.0
            return
        for a, cls, predicate, p in types:
            if a != attrs[k]:
                continue
            ways = [(nodes, edges, n, 0.0) for n, own in enumerate(nodes) if own == cls and (n, predicate) not in data]
            new = len(nodes)
            roots = [n for n in range(new) if all(d != n for _, d in edges)]
            if not nodes:
                ways = [((cls,), (), 0, 0.0)]
            for up, _, down, q in links if nodes else ():
                ways += [((*nodes, cls), (*edges, (n, new)), new, math.log(q)) for n, own in enumerate(nodes) if (own, cls) == (up, down)]
                ways += [((*nodes, cls), (*edges, (new, roots[0])), new, math.log(q))] * ((cls, nodes[roots[0]]) == (up, down))
                for up2, _, down2, q2 in links:
                    if up == up2 and (cls, nodes[roots[0]]) == (down, down2):
                        ways.append(((*nodes, cls, up), (*edges, (new + 1, new), (new + 1, roots[0])), new, math.log(q) + math.log(q2)))
            for n, e, at, s in ways:
                yield from (s + math.log(p) + rest for rest in step(n, e, data | {(at, predicate)}, k + 1))

    return max(step((), (), frozenset(), 0), default=None)


def test_a_wide_beam_finds_the_best_model(spark):
    rng, types, links = random.Random(12), [], []
    for up, down in (("A", "B"), ("B", "C"), ("A", "C"), ("D", "A"), ("D", "B")):
        links.append((up, f"{up}{down}", down, round(rng.uniform(0.1, 0.9), 2)))
    for source in range(6):
        for a in range(3):
            types += [(source, f"a{a}", cls, rng.choice("pq"), round(rng.uniform(0.1, 0.9), 2)) for cls in rng.sample("ABC", 2)]
    got = modelling.predict(spark.createDataFrame(types, "source int, attr string, cls string, predicate string, score double"), spark.createDataFrame(links, "src string, predicate string, dst string, p double"), width=500).collect()
    assert len(got) == 6
    for r in got:
        best = grown([t[1:] for t in types if t[0] == r.source], links)
        assert r.terminal == (best is not None) and (best is None or r.score == pytest.approx(best))
        assert len([e for e in r.links if e.attr]) == 3 - len(r.left)


def test_a_source_that_cannot_be_joined_keeps_what_it_has(spark):
    types = spark.createDataFrame([(1, "a", "A", "p", 0.5), (1, "b", "Z", "p", 0.5), (2, "a", "A", "p", 0.5)], "source int, attr string, cls string, predicate string, score double")
    links = spark.createDataFrame([("A", "x", "B", 0.5)], "src string, predicate string, dst string, p double")
    got = {r.source: (r.terminal, list(r.left)) for r in modelling.predict(types, links).collect()}
    assert got == {1: (False, ["b"]), 2: (True, [])}
    assert modelling.predict(types.limit(0), links).count() == 0


def test_elimination_prunes_upwards(spark):
    e = spark.createDataFrame([("g", "r", "x", "m", False), ("g", "m", "x", "n", False), ("g", "n", "p", "d1", True), ("g", "r", "p", "d2", True)], "graph string, src string, label string, dst string, data boolean")
    got = {(r.gone, r.src, r.dst) for r in modelling.eliminate(e).collect()}
    assert got == {("d1", "r", "d2"), ("d2", "r", "m"), ("d2", "m", "n"), ("d2", "n", "d1")}


def test_worksheet_goes_back_and_forth(spark):
    sheet = mapping.Worksheet(spark.createDataFrame([(1, ["x", "y"])], "k long, v array<string>"))
    sheet.apply({"_type_": "JoinListCmd", "input_attr": "v", "delimiter": "-"}).apply({"_type_": "AddLiteralColumnCmd", "input_attr_path": "c", "val": "z"})
    assert sheet.table.first().asDict() == {"k": 1, "v": "x-y", "c": "z"}
    assert sheet.undo().undo().table.first().v == ["x", "y"] and sheet.redo().table.first().v == "x-y"
    with pytest.raises(Exception):
        sheet.apply({"_type_": "UnpackOneElementList", "input_attr": "missing"})
    assert len(sheet.done) == 1 and sheet.table.first().v == "x-y" and "JoinListCmd" in sheet.script()


def test_folds_take_each_row_once(spark):
    rows = evaluation.with_folds(spark.range(500).withColumnRenamed("id", "k"), "k", 5, 1)
    sizes = [r["count"] for r in rows.groupBy("fold").count().collect()]
    assert len(sizes) == 5 and sum(sizes) == 500 and min(sizes) > 60
    scored = evaluation.run_folds(rows, 5, lambda train: train.agg(F.count("*").alias("n")), lambda model, test: test.join(model))
    assert scored.count() == 500 and all(r.n == 500 - s for r, s in zip(scored.groupBy("fold").agg(F.first("n").alias("n")).orderBy("fold").collect(), [rows.where(F.col("fold") == k).count() for k in range(5)], strict=True))
