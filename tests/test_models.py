"""Kernels against brute force, round trips and hand-made cases."""

import math
from itertools import permutations, product

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomgraph.operators import alignment, inference, labelling, mapping, ontology, search, trees
from loomgraph.sources import rdf

EDGE = "key int, side string, src string, src_label string, pred string, dst string, dst_label string, dst_data boolean"


def graph_rows(side, names, links):
    return [(side, f"{a}", a[0], p, f"{b}", b[0], False) for a, p, b in links if a in names and b in names]


small = st.lists(st.tuples(st.sampled_from("A1 A2 B1 B2 B3 C1".split()), st.sampled_from("pq"), st.sampled_from("A1 A2 B1 B2 B3 C1".split())), max_size=7)


@settings(max_examples=60, deadline=None)
@given(small, small)
def test_alignment_equals_all_maps(gold, pred):
    rows = [dict(zip("side src src_label pred dst dst_label dst_data".split(), r)) for r in graph_rows("gold", "A1 A2 B1 B2 B3 C1".split(), gold) + graph_rows("pred", "A1 A2 B1 B2 B3 C1".split(), pred)]
    (g, gl), (p, pl) = alignment._triples(rows, "gold", "keep"), alignment._triples(rows, "pred", "keep")
    got = len(g & alignment._mapped(p, alignment.best_maps(g, gl, p, pl, 10**6)[0]))
    per = []
    for label in "ABC":
        gn, pn = [n for n in gl if n[0] == label], [n for n in pl if n[0] == label]
        padded = gn + [None] * len(pn)
        per.append([dict(zip(pn, c)) for c in set(permutations(padded, len(pn)))])
    best = 0
    for chosen in product(*per):
        to = {k: v for m in chosen for k, v in m.items() if v is not None}
        best = max(best, len(g & alignment._mapped(p, to)))
    assert got == best


def test_alignment_modes(spark):
    rows = [(1, "gold", "A1", "A", "n", "x1", "x", True), (1, "gold", "A1", "A", "p", "B1", "B", False), (1, "pred", "A9", "A", "n", "x2", "y", True), (1, "pred", "A9", "A", "p", "B7", "B", False)]
    df = spark.createDataFrame(rows, EDGE)
    f1 = lambda m: alignment.align(df, "key", m).first().f1
    assert (f1("keep"), f1("blur"), f1("ignore")) == (0.5, 1.0, 1.0)
    assert {(r.dst, r.correct) for r in alignment.label_edges(df, "key").collect()} == {("y", False), ("B7", True)}
    many = spark.createDataFrame([(1, s, "R", "R", "p", f"N{i}", "N", False) for s in ("gold", "pred") for i in range(6)], EDGE)
    assert alignment.align(many, "key", cap=100).first().f1 is None
    only = alignment.align(spark.createDataFrame(rows[:2], EDGE), "key").first()
    assert (only.f1, only.precision, only.recall) == (0.0, 0.0, 0.0)
    assert alignment.align(df.limit(0), "key").count() == 0


factor_graphs = st.integers(1, 6).flatmap(lambda n: st.tuples(st.lists(st.integers(2, 3), min_size=n, max_size=n), st.lists(st.integers(0, 10**6), min_size=n, max_size=n), st.integers(0, 999)))


@settings(max_examples=50, deadline=None)
@given(factor_graphs)
def test_beliefs_equal_brute_force(case):
    sizes, parents, seed = case
    rng = np.random.default_rng(seed)
    factors = []
    for v, (n, p) in enumerate(zip(sizes, parents)):
        own = [v] if v == 0 or p % 4 == 0 else [p % v, v]
        shape = [sizes[u] for u in own]
        factors.append({"vars": own, "sizes": shape, "scores": rng.normal(size=int(np.prod(shape))).tolist()})
        factors.append({"vars": [v], "sizes": [n], "scores": rng.normal(size=n).tolist()})
    logs = inference.tables(factors)
    every = inference.brute_force(factors, logs)
    z = math.log(sum(math.exp(s) for s in every.values()))
    b = inference.Beliefs(factors, logs)
    assert b.log_z == pytest.approx(z)
    for v, p in b.marginals().items():
        for x in range(sizes[v]):
            assert math.exp(p[x]) == pytest.approx(sum(math.exp(s - z) for a, s in every.items() if a[v] == x))
    best = inference.Beliefs(factors, logs, best=True).decode()
    assert every[tuple(best[v] for v in range(len(sizes)))] == pytest.approx(max(every.values()))


def test_cycle_has_no_beliefs():
    two = lambda a, b: {"vars": [a, b], "sizes": [2, 2], "scores": [0.0] * 4}
    with pytest.raises(ValueError):
        inference.Beliefs(f := [two(0, 1), two(1, 2), two(2, 0)], inference.tables(f))


def _example(a, b):
    return [{"vars": [0], "sizes": [2], "features": [[], [(0, a)]]}, {"vars": [1], "sizes": [2], "features": [[], [(1, b)]]}, {"vars": [0, 1], "sizes": [2, 2], "features": [[(2, 1.0)], [], [], [(2, 1.0)]]}]


def test_gradient_and_optimisers():
    w, f, gold = np.array([0.3, -0.7, 0.2]), _example(1.5, -0.5), {0: 1, 1: 0}
    assert inference.nll(f, gold, w)[1] == pytest.approx(inference.numerical_gradient(lambda x: inference.nll(f, gold, x)[0], w), abs=1e-6)
    for opt in (inference.Sgd(0.2), inference.Sgd(0.1, 0.9), inference.Sgd(0.1, 0.9, True, 0.01), inference.Adam(0.1), inference.Adam(0.1, amsgrad=True)):
        x = np.array([3.0, -2.0])
        for _ in range(300):
            x = opt.step(x, 2 * x)
        assert np.abs(x).max() < 0.05


def test_training_lowers_the_loss(spark):
    rng = np.random.default_rng(1)
    rows = [(float(a), float(b), int(a > 0), int(b + a > 0)) for a, b in rng.normal(size=(120, 2))]
    df = spark.createDataFrame(rows, "a double, b double, x int, y int").repartition(3)
    example = lambda a, b: [{"vars": [0], "sizes": [2], "features": [[], [(0, a)]]}, {"vars": [1], "sizes": [2], "features": [[], [(1, b)]]}, {"vars": [0, 1], "sizes": [2, 2], "features": [[(2, 1.0)], [], [], [(2, 1.0)]]}]
    nll = inference.nll
    fn = lambda r, w: nll(example(r["a"], r["b"]), {0: int(r["x"]), 1: int(r["y"])}, w)
    w, losses = inference.train(df, fn, np.zeros(3), inference.Adam(0.3), rounds=12)
    assert losses[0] == pytest.approx(2 * math.log(2)) and losses[-1] < 0.75 * losses[0]
    whole = [fn(dict(zip("abxy", r)), w) for r in rows]
    loss, grad = inference.loss_and_gradient(df, fn, w)
    assert loss == pytest.approx(np.mean([x for x, _ in whole])) and grad == pytest.approx(np.mean([g for _, g in whole], axis=0))


def test_canonical_text(spark):
    e = [(1, "a", "A", "p", "b", "B"), (1, "a", "A", "q", "c", "C"), (2, "z", "A", "q", "y", "C"), (2, "z", "A", "p", "x", "B"), (3, "a", "A", "p", "b", "C")]
    df = spark.createDataFrame(e, "key int, src string, src_label string, label string, dst string, dst_label string")
    t = {r.key: r.text for r in trees.canonical_text(df, "key").collect()}
    assert t[1] == t[2] == "(A:p-B,q-C)" and t[3] != t[1]


def test_connecting_trees_and_paths(spark):
    e = [(1, "r", "a", 1.0), (1, "r", "b", 1.0), (1, "m", "a", 5.0), (1, "m", "b", 5.0), (1, "a", "t", 1.0), (1, "b", "u", 1.0)]
    df = spark.createDataFrame(e, "key int, src string, dst string, weight double")
    got = trees.connecting_trees(df, "key", ["t", "u"], 2).orderBy("place").collect()
    assert [(r.root, r.weight) for r in got] == [("r", 4.0), ("m", 12.0)] and len(got[0].links) == 4
    far = {r.node: (r.distance, list(r.path)) for r in trees.shortest_paths(df, "key", "r").collect()}
    assert far["u"] == (2.0, ["r", "b", "u"]) and "m" not in far


def test_turtle_xml_and_lines(spark, tmp_path):
    ttl = '@prefix e: <http://e/> .\n@prefix rdfs: <http://www.w3.org/2000/01/rdf-schema#> .\n@prefix owl: <http://www.w3.org/2002/07/owl#> .\ne:A a owl:Class . e:B rdfs:subClassOf e:A .\ne:p a owl:ObjectProperty ; rdfs:domain e:A ; rdfs:range e:B, e:A .\ne:x e:note "a \\"b\\"\\n"@en, 3 .\n'
    (tmp_path / "o.ttl").write_text(ttl)
    t = rdf.load_triples(spark, str(tmp_path / "o.ttl"))
    assert t.count() == 8
    rdf.ntriples(t).coalesce(1).write.text(str(tmp_path / "lines"))
    (tmp_path / "o.nt").write_text("".join(p.read_text() for p in (tmp_path / "lines").glob("*.txt")))
    again = rdf.load_triples(spark, str(tmp_path / "o.nt"))
    assert again.exceptAll(t).isEmpty() and t.exceptAll(again).isEmpty()
    xml = '<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:e="http://e/"><e:C rdf:about="http://e/1" e:n="v"><e:has><e:D rdf:about="http://e/2"/></e:has><e:to rdf:resource="http://e/3"/></e:C></rdf:RDF>'
    (tmp_path / "o.rdf").write_text(xml)
    assert {(r.s[-1], r.p[-4:], r.o) for r in rdf.load_triples(spark, str(tmp_path / "o.rdf")).collect()} == {("1", "type", "http://e/C"), ("1", "/e/n", "v"), ("2", "type", "http://e/D"), ("1", "/has", "http://e/2"), ("1", "e/to", "http://e/3")}
    links = {(r.src[-1], r.dst[-1]) for r in ontology.linkable(ontology.predicates(t), ontology.ancestors(t)).collect()}
    assert links == {("A", "A"), ("A", "B"), ("B", "A"), ("B", "B")}
    assert ontology.match(t, p=ontology.RDFS + "domain").count() == 1
    with pytest.raises(ValueError):
        rdf.parse_turtle("e:a e:b e:c .")


def _bind(path, node, predicate="v"):
    return {"_type_": "SetSemanticType", "input_attr_path": path, "domain": node[:-1], "type": predicate, "node_id": node}


def _link(a, b, p="has"):
    return {"_type_": "SetInternalLink", "source_id": a, "target_id": b, "link_lbl": p}


def test_objects_in_every_scope(spark):
    df = spark.createDataFrame([("n1", [("t1", 5), (None, None)], ["x", "y"]), (None, [], None)], "name string, items array<struct<title:string,year:int>>, tags array<string>")
    script = [_bind("name", "P1"), _bind("items|title", "I1", mapping.ID_LINK), _bind("items|year", "Y1"), _bind("tags", "T1"), _link("P1", "I1"), _link("I1", "Y1", "in"), _link("P1", "T1", "tag")]
    out, model = mapping.run(df, script)
    got = out.select(mapping.objects(model, out.schema).alias("o")).collect()
    a = got[0].o
    assert a["@type"] == "P" and a.v == "n1" and a.has[0]["in"].v == 5 and a.has[1] is None and [t.v for t in a.tag] == ["x", "y"]
    inner, flipped = mapping.run(df, [_bind("items|title", "I1", mapping.ID_LINK), _bind("name", "P1"), _link("I1", "P1", "by")])
    lines = [r.value for r in mapping.json_objects(inner, flipped).collect()]
    assert lines == ['{"@type":"I","by":{"@type":"P","v":"n1"},"@id":"t1"}', '{"@type":"I","by":{"@type":"P","v":"n1"}}']
    assert mapping.read_script(mapping.write_script(script)) == sorted(script, key=lambda c: c["_type_"] == "SetInternalLink")
    for bad in ([_bind("name", "Px")], [_bind("name", "P1"), _bind("name", "P2")], [_link("A1", "B1"), _link("C1", "B1")], [_link("A1", "B1"), _link("B1", "A1")], [{"_type_": "Nope"}]):
        with pytest.raises(ValueError):
            mapping.run(df, bad)


def test_repeated_predicates_are_lists(spark):
    df = spark.createDataFrame([("a", None), (None, None)], "x string, y string")
    out, model = mapping.run(df, [_bind("x", "P1"), _bind("y", "P1")])
    assert [r.o and list(r.o.v) for r in out.select(mapping.objects(model, out.schema).alias("o")).collect()] == [["a"], None]


def test_p_values_and_forest(spark):
    rng = np.random.default_rng(3)
    cols = {"low1": rng.integers(0, 50, 80), "low2": rng.integers(0, 50, 80), "high1": rng.integers(900, 990, 80), "high2": rng.integers(900, 990, 80), "one": [4]}
    words = {"w1": ["red fox", "blue dog"] * 9, "w2": ["red dog", "blue fox", "red fox"] * 7}
    rows = [(c, str(v)) for c, vs in {**cols, **words}.items() for v in vs]
    names = [(c, [c.rstrip("12")]) for c in {**cols, **words}]
    f = labelling.pair_features(spark.createDataFrame(rows, "col string, v string"), spark.createDataFrame(names, "col string, tokens array<string>")).cache()
    at = {(r.a, r.b): r for r in f.collect()}
    assert len(at) == 21 and at["low1", "low2"].name == 1.0 and at["low1", "one"].ks == 0.0
    a, b = np.array(cols["low1"]), np.array(cols["low2"])
    grid = np.unique(np.concatenate([a, b]))
    gap = max(abs((a <= v).mean() - (b <= v).mean()) for v in grid)
    x = gap * gap * 40
    assert at["low1", "low2"].ks == pytest.approx(2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * x) for k in range(1, 101)), abs=1e-9)
    u = sum((v > b).sum() + (v == b).sum() / 2 for v in a)
    n = np.array([((a == v).sum() + (b == v).sum()) for v in grid])
    sd = math.sqrt(6400 / 12 * (161 - (n**3 - n).sum() / (160 * 159)))
    assert at["low1", "low2"].mann_whitney == pytest.approx(math.erfc((abs(u - 3200) - 0.5) / sd / math.sqrt(2)), abs=1e-9)
    assert at["high1", "low1"].ks < 1e-9 and at["w1", "w2"].text_jaccard == pytest.approx(1 / 4)
    gold = spark.createDataFrame([(c, c.rstrip("12")) for c in {**cols, **words}], "col string, label string")
    forest = labelling.fit_forest(labelling.training_pairs(f, gold), trees=20, depth=4)
    top = labelling.top_labels(labelling.label_scores(forest, f, gold), "col", "label", "score", 1).collect()
    assert {r.col: r.label for r in top if r.col[:3] in ("low", "hig")} == {"low1": "low", "low2": "low", "high1": "high", "high2": "high"}


def test_parent_labels(spark):
    s = spark.createDataFrame([("c", "x", "p", 0.9), ("c", "x", "q", 0.95), ("c", "y", "p", 0.5), ("c", "z", "p", 0.0)], "col string, label string, parent string, score double")
    got = labelling.top_labels_with_parents(s, "col", "label", "parent", "score", 2).orderBy("rank", "parent_rank").collect()
    assert [(r.label, r.parent, r.rank, r.parent_rank) for r in got] == [("x", "q", 1, 1), ("x", "p", 1, 2), ("y", "p", 2, 1)]


def test_beam_without_results_gives_the_best_state(spark):
    start = spark.createDataFrame([("0", 0.0, False)], "id string, score double, terminal boolean")
    grow = lambda s: s.select(F.explode(F.array(F.lit("0"), F.lit("1"))).alias("x"), "id").select(F.concat("id", "x").alias("id"), F.length(F.replace(F.concat("id", "x"), F.lit("0"), F.lit(""))).cast("double").alias("score"), F.lit(False).alias("terminal"))
    assert [r.id for r in search.beam_search(start, grow, 2, 3, 3).collect()] == ["0111"]


def test_weighted_sample_follows_weights(spark):
    df = spark.range(2000).select("id", F.when(F.col("id") < 1000, 9.0).otherwise(1.0).alias("w"))
    got = [r.id for r in search.weighted_sample(df, "id", "w", 200, 1).collect()]
    assert len(set(got)) == 200 and 160 <= sum(i < 1000 for i in got) <= 198
    assert got == [r.id for r in search.weighted_sample(df.repartition(7), "id", "w", 200, 1).collect()]


def test_leave_one_out_and_node_probability(spark):
    rng = np.random.default_rng(5)
    cols = [(f"s{k}_{label}", label, f"s{k}") for k in range(3) for label in ("low", "high")]
    rows = [(c, str(v)) for c, label, _ in cols for v in rng.integers(0, 40, 60) + (500 if label == "high" else 0)]
    f = labelling.pair_features(spark.createDataFrame(rows, "col string, v string"), spark.createDataFrame([(c, [c]) for c, _, _ in cols], "col string, tokens array<string>")).cache()
    gold = spark.createDataFrame(cols, "col string, label string, source string")
    got = labelling.top_labels(labelling.leave_one_out(f, gold, 15, 3), "col", "label", "score", 1).collect()
    assert {r.col: r.label for r in got} == {c: label for c, label, _ in cols}
    with pytest.raises(ValueError):
        labelling.leave_one_out(f, gold.limit(0))
    nodes = spark.createDataFrame([(i, float(i % 10), float(i), int(i % 10 > 4)) for i in range(60)], "id int, score double, cost double, good int")
    chance = labelling.node_probability(labelling.fit_node_probability(nodes, ["score", "cost"], "good"), nodes)
    assert chance.where("(chance > 0.5) != (good = 1)").isEmpty() and chance.count() == 60
