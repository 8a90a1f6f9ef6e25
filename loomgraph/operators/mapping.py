"""Mapping scripts: commands that reshape a nested table and bind its attributes to a tree of classes.

A script is a list of commands (dicts told apart by `_type_`). Run on a table it gives the reshaped table and a Model;
the model compiles to one Column, a struct for each row, so extraction stays in the query plan."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.operators import nested

#: The predicate that marks the attribute holding an object's identity; scripts that use another name pass it.
ID_LINK = "@id"

#: Command names and their fields in the order they are written.
COMMANDS = {
    "ZipAttributes": ("input_attrs", "output_attr"),
    "UnpackOneElementList": ("input_attr",),
    "AddLiteralColumnCmd": ("input_attr_path", "val"),
    "JoinListCmd": ("input_attr", "delimiter"),
    "PyTransformNewColumn": ("input_attr_paths", "new_attr_name", "code", "default_error_value"),
    "SetSemanticType": ("input_attr_path", "domain", "type", "node_id"),
    "SetInternalLink": ("source_id", "target_id", "link_lbl"),
}


@dataclass
class Model:
    """A tree of class nodes; attributes are its leaves (NEST9, NEST10)."""

    labels: dict[str, str] = field(default_factory=dict)
    attrs: dict[str, list[tuple[str, str]]] = field(default_factory=dict)  # node -> (predicate, path)
    links: dict[str, list[tuple[str, str]]] = field(default_factory=dict)  # node -> (predicate, node)

    def node(self, node_id: str, label: str | None = None) -> None:
        label = label or node_id[:-1]
        if not re.fullmatch(re.escape(label) + "[0-9]", node_id):
            raise ValueError(f"{node_id} isn't {label} and one digit")  # NEST11
        if self.labels.setdefault(node_id, label) != label:
            raise ValueError(f"{node_id} has two classes")

    def bind(self, path: str, domain: str, predicate: str, node_id: str) -> None:
        self.node(node_id, domain)
        if any(p == path for own in self.attrs.values() for _, p in own):
            raise ValueError(f"{path} is bound twice")
        self.attrs.setdefault(node_id, []).append((predicate, path))

    def link(self, source: str, predicate: str, target: str) -> None:
        self.node(source), self.node(target)
        if any(t == target for own in self.links.values() for _, t in own):
            raise ValueError(f"{target} has a parent already")
        above, todo = {target}, [target]
        while todo:
            for _, t in self.links.get(todo.pop(), []):
                above.add(t)
                todo.append(t)
        if source in above:
            raise ValueError(f"{source} is below {target}")
        self.links.setdefault(source, []).append((predicate, target))

    def roots(self) -> list[str]:
        below = {t for own in self.links.values() for _, t in own}
        return [n for n in self.labels if n not in below]

    def edges(self) -> list[tuple[str, str, str, bool]]:
        """(source, predicate, target, whether the target is an attribute)."""
        own = [(n, p, t, False) for n, links in self.links.items() for p, t in links]
        return own + [(n, p, path, True) for n, attrs in self.attrs.items() for p, path in attrs]


def _kind(schema: T.DataType, steps: tuple[str, ...]) -> T.DataType:
    for s in steps:
        schema = (schema.elementType if isinstance(schema, T.ArrayType) else schema)[s].dataType
    return schema


def _scope(model: Model, node: str, schema: T.StructType, id_link: str) -> tuple[str, ...] | None:
    """Where a node's objects are: at its identity's parent or else at its outermost attribute's. A node whose only
    attribute is a list of values has an object for each of them."""
    attrs = model.attrs.get(node, [])
    if not attrs:
        return None
    split = [tuple(p.split("|")) for _, p in attrs]
    if len(split) == 1:
        kind = _kind(schema, split[0])
        if isinstance(kind, T.ArrayType) and not isinstance(kind.elementType, T.StructType):
            return split[0]
    ids = [s for (p, _), s in zip(attrs, split) if p == id_link]
    if ids:
        return ids[0][:-1]
    outer = min((s[:-1] for s in split), key=len)
    for s in split:
        inner = [s[:i] for i in range(len(outer) + 1, len(s))]
        if s[: len(outer)] != outer or any(isinstance(_kind(schema, i), T.ArrayType) for i in inner):
            raise ValueError(f"{node} has attributes of several lists and no identity")
    return outer


def objects(model: Model, schema: T.StructType, id_link: str = ID_LINK) -> Column:
    """The struct of a row's object under the model's one root (NEST12, NEST13): '@type' and a field for each predicate.
    Nodes of an inner list give lists, those of an outer scope repeat. A predicate that occurs several times gives the
    list of its values without nulls. An object without any value is null."""
    roots = model.roots()
    if len(roots) != 1:
        raise ValueError(f"a model has one root, not {roots}")

    def walk(path: tuple[str, ...], env: dict[tuple, Column | None], then: Callable) -> Column:
        """`then(column, env)` at a path, mapped over the lists between it and the nearest known scope."""
        at = max((e for e in env if path[: len(e)] == e), key=len)

        def step(done: tuple, column: Column | None, known: dict) -> Column:
            kind = _kind(schema, done)
            if isinstance(kind, T.ArrayType) and done not in known:
                return F.transform(column, lambda e: step(done, e, known | {done: e}))
            known = known if done in known else known | {done: column}
            if done == path:
                return then(column, known)
            name = path[len(done)]
            return step(path[: len(done) + 1], F.col(f"`{name}`") if column is None else column[name], known)

        return step(at, env[at], env)

    def build(node: str, column: Column | None, env: dict) -> Column:
        values: dict[str, list[Column]] = {}
        for predicate, target in model.links.get(node, []):
            scope = _scope(model, target, schema, id_link)
            one = build(target, column, env) if scope is None else walk(scope, env, lambda c, e, t=target: build(t, c, e))
            values.setdefault(predicate, []).append(one)
        for predicate, path in model.attrs.get(node, []):
            values.setdefault(predicate, []).append(walk(tuple(path.split("|")), env, lambda c, e: c))
        if not values:
            return F.lit(None).cast("string")
        out = {p: vs[0] if len(vs) == 1 else F.array_compact(F.array(*vs)) for p, vs in values.items()}
        empty = [c.isNull() if len(values[p]) == 1 else F.size(c) == 0 for p, c in out.items()]
        void = empty[0]
        for e in empty[1:]:
            void = void & e
        return F.when(~void, F.struct(F.lit(model.labels[node]).alias("@type"), *[c.alias(p) for p, c in out.items()]))

    scope = _scope(model, roots[0], schema, id_link) or ()
    return walk(scope, {(): None}, lambda c, e: build(roots[0], c, e))


def run(df: DataFrame, script: list[dict], functions: dict[str, Callable[..., Column]] | None = None) -> tuple[DataFrame, Model]:
    """The table after all commands, in order, and the model (NEST1-NEST12). Computed columns name a function of
    `functions`, from Columns to a Column; Python text isn't run."""
    model, functions = Model(), functions or {}
    for c in script:
        kind = c["_type_"]
        if kind == "ZipAttributes":
            df = nested.zip_lists(df, c["input_attrs"], c["output_attr"])
        elif kind == "UnpackOneElementList":
            df = nested.unpack_one(df, c["input_attr"])
        elif kind == "AddLiteralColumnCmd":
            df = nested.add_literal(df, c.get("input_attr_path", c.get("input_attr")), c["val"])
        elif kind == "JoinListCmd":
            df = nested.join_list(df, c["input_attr"], c.get("delimiter", "\n"))
        elif kind == "PyTransformNewColumn":
            inputs = c["input_attr_paths"]
            parent = inputs[0].rpartition("|")[0]
            out = f"{parent}|{c['new_attr_name']}" if parent else c["new_attr_name"]
            df = nested.computed(df, inputs, out, functions[c["code"].strip()])
        elif kind == "SetSemanticType":
            model.bind(c["input_attr_path"], c["domain"], c["type"], c["node_id"])
        elif kind == "SetInternalLink":
            model.link(c["source_id"], c["link_lbl"], c["target_id"])
        else:
            raise ValueError(f"no command {kind}")
    return df, model


def read_script(text: str) -> list[dict]:
    """Commands of a script's text, JSON or, where a YAML module is there, YAML (SRC12)."""
    try:
        found = json.loads(text)
    except json.JSONDecodeError:
        import yaml

        found = yaml.safe_load(text)
    commands = found["commands"] if isinstance(found, dict) else found
    for c in commands:
        if c.get("_type_") not in COMMANDS:
            raise ValueError(f"no command {c.get('_type_')}")
    return commands


def write_script(commands: list[dict]) -> str:
    """A script's text (SNK1): reshaping commands first, each kind's fields in their order, links last."""
    rank = {name: i for i, name in enumerate(COMMANDS)}
    late = ("SetSemanticType", "SetInternalLink")
    ordered = [c for c in commands if c["_type_"] not in late] + sorted((c for c in commands if c["_type_"] in late), key=lambda c: rank[c["_type_"]])
    return json.dumps({"commands": [{"_type_": c["_type_"], **{f: c[f] for f in COMMANDS[c["_type_"]] if f in c}} for c in ordered]}, indent=1, ensure_ascii=False)


def json_objects(df: DataFrame, model: Model, id_link: str = ID_LINK) -> DataFrame:
    """(value): the row's objects as JSON text, one a line (SNK3, NEST13); rows without any give none."""
    made = df.select(objects(model, df.schema, id_link).alias("o")).where("o is not null")
    if isinstance(made.schema["o"].dataType, T.ArrayType):
        made = made.select(F.explode("o").alias("o")).where("o is not null")
    return made.select(F.to_json("o").alias("value"))


class Worksheet:
    """A table under commands that can be taken back and done again (NEST17). Every state is a plan on the same source, so
    going back costs nothing and no state is stored."""

    def __init__(self, df: DataFrame, functions: dict[str, Callable[..., Column]] | None = None):
        self.source, self.functions, self.done, self.undone = df, functions, [], []

    def apply(self, command: dict) -> Worksheet:
        """One command more; one that fails on the table as it is leaves it as it was."""
        run(self.source, [*self.done, command], self.functions)
        self.done, self.undone = [*self.done, command], []
        return self

    def undo(self) -> Worksheet:
        if self.done:
            self.undone.append(self.done.pop())
        return self

    def redo(self) -> Worksheet:
        if self.undone:
            self.done.append(self.undone.pop())
        return self

    @property
    def table(self) -> DataFrame:
        return run(self.source, self.done, self.functions)[0]

    @property
    def model(self) -> Model:
        return run(self.source, self.done, self.functions)[1]

    def script(self) -> str:
        return write_script(self.done)
