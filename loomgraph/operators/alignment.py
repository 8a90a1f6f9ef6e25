"""Alignment of a predicted graph with a gold one: the one-to-one map of class nodes that makes most triples equal."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations, product
from math import perm

from pyspark.sql import DataFrame

from loomgraph.operators.kernels import per_object

#: What becomes of data nodes (EV4): compared by label, compared as if all had one label, or left out.
MODES = ("keep", "blur", "ignore")


def _triples(rows: list[dict], side: str, mode: str) -> tuple[set, dict]:
    """The distinct triples of a side and its class nodes' labels. A data node is ("data", label) in a triple."""
    triples, labels = set(), {}
    for r in rows:
        if r["side"] != side:
            continue
        labels[r["src"]] = r["src_label"]
        if r["dst_data"]:
            if mode == "ignore":
                continue
            dst = ("data", r["dst_label"] if mode == "keep" else "")
        else:
            labels[r["dst"]] = r["dst_label"]
            dst = ("class", r["dst"])
        triples.add((r["src"], r["pred"], dst))
    return triples, labels


def _maps(gold: list, pred: list) -> Iterator[dict]:
    """All one-to-one maps, as large as possible, of predicted onto gold nodes."""
    if len(pred) <= len(gold):
        for chosen in permutations(gold, len(pred)):
            yield dict(zip(pred, chosen))
    else:
        for chosen in permutations(pred, len(gold)):
            yield dict(zip(chosen, gold))


def _mapped(triples: set, to: dict) -> set:
    out = set()
    for s, p, (kind, o) in triples:
        if s in to and (kind == "data" or o in to):
            out.add((to[s], p, (kind, to[o] if kind == "class" else o)))
    return out


def _parts(labels: list, links: set[frozenset]) -> list[list]:
    """Labels whose nodes can be mapped apart from those of other parts."""
    part = {x: {x} for x in labels}
    for link in links:
        a, b = (tuple(link) * 2)[:2]
        if a in part and b in part and part[a] is not part[b]:
            part[a] |= part[b]
            for x in part[b]:
                part[x] = part[a]
    return sorted({id(p): sorted(p) for p in part.values()}.values())


def best_maps(gold: set, gold_labels: dict, pred: set, pred_labels: dict, cap: int) -> tuple[dict, int] | None:
    """The best map (predicted -> gold) and of how many parts it is not the only best one; None beyond `cap` maps a part."""
    sides: dict = {}
    for at, labels in ((0, gold_labels), (1, pred_labels)):
        for node, label in labels.items():
            sides.setdefault(label, ([], []))[at].append(node)
    both = {x: (sorted(g), sorted(p)) for x, (g, p) in sides.items() if g and p}
    sure = {p[0]: g[0] for g, p in both.values() if len(g) == len(p) == 1}
    open_ = [x for x, (g, p) in both.items() if len(g) > 1 or len(p) > 1]
    links = {frozenset((own[s], own[o])) for triples, own in ((gold, gold_labels), (pred, pred_labels)) for s, _, (kind, o) in triples if kind == "class"}
    best, unsure = dict(sure), 0
    for part in _parts(open_, links):
        size = 1
        for x in part:
            size *= perm(max(map(len, both[x])), min(map(len, both[x])))
        if size > cap:
            return None
        nodes = {n for x in part for n in both[x][1]}
        near = {t for t in pred if t[0] in nodes or t[2][1] in nodes and t[2][0] == "class"}
        top, count = -1, 0
        for chosen in product(*[list(_maps(*both[x])) for x in part]):
            own = {k: v for m in chosen for k, v in m.items()}
            hits = len(gold & _mapped(near, sure | own))
            if hits > top:
                top, count, found = hits, 1, own
            elif hits == top:
                count += 1
        best |= found
        unsure += count > 1
    return best, unsure


def align(edges: DataFrame, key: str, mode: str = "keep", cap: int = 100_000) -> DataFrame:
    """F1, precision, recall, matched triples and best map of each key's two graphs (EV4-EV6).

    `edges`: key, side ('gold' or 'pred'), src, src_label, pred, dst, dst_label, dst_data. All figures are null where a
    part has more than `cap` maps. `unique` tells whether no other map is as good. A side without edges scores 0."""
    if mode not in MODES:
        raise ValueError(f"mode is one of {MODES}")

    def one(rows: list[dict]):
        (gold, gl), (pred, pl) = _triples(rows, "gold", mode), _triples(rows, "pred", mode)
        found = best_maps(gold, gl, pred, pl, cap)
        if found is None:
            return [(None,) * 6]
        hits = len(gold & _mapped(pred, found[0]))
        p, r = hits / len(pred) if pred else 0.0, hits / len(gold) if gold else 0.0
        return [(2 * p * r / (p + r) if hits else 0.0, p, r, hits, found[0], not found[1])]

    return per_object(edges, key, one, "f1 double, precision double, recall double, matched long, bijection map<string,string>, unique boolean")


def label_edges(edges: DataFrame, key: str, mode: str = "keep", cap: int = 100_000) -> DataFrame:
    """Every predicted edge and whether the best map makes it a gold one (EV6); null beyond the cap."""

    def one(rows: list[dict]):
        (gold, gl), (pred, pl) = _triples(rows, "gold", mode), _triples(rows, "pred", mode)
        found = best_maps(gold, gl, pred, pl, cap)
        for s, p, (kind, o) in sorted(pred):
            yield s, p, o, None if found is None else bool(gold & _mapped({(s, p, (kind, o))}, found[0]))

    return per_object(edges, key, one, "src string, pred string, dst string, correct boolean")
