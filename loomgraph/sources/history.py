"""Mapping scripts from the worksheet history that an external mapping tool writes into its Turtle files (SRC13).

The history is a JSON literal: commands in the order in which they were given, each with named parameters. What a later
command sets or takes back for a column, or for two nodes, replaces what was set before, so the script holds what was
true in the end, in the order of first mention."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.operators.mapping import ID_LINK

#: The names, in any namespace, of the predicates that hold the history and the columns of its source.
HISTORY, COLUMNS = "hasWorksheetHistory", "hasInputColumns"
#: Commands that change neither table nor model.
WITHOUT_EFFECT = ("OperateSelectionCommand", "OrganizeColumnsCommand", "SetWorksheetPropertiesCommand")


def texts(triples: DataFrame) -> tuple[str, str]:
    """The history and the input columns of a script's triples (s, p, o): two literals, each there once."""
    name = F.regexp_extract("p", "[^#/]*$", 0)
    found = {r["name"]: r["o"] for r in triples.select(name.alias("name"), "o").where(F.col("name").isin(HISTORY, COLUMNS)).limit(3).collect()}
    if set(found) != {HISTORY, COLUMNS}:
        raise ValueError("a script has one history and one list of input columns")
    return found[HISTORY], found[COLUMNS]


def _names(column: list[dict[str, str]]) -> list[str]:
    return [step["columnName"] for step in column]


class _Script:
    """Commands so far. Those that may be replaced stand under a key; a list keeps the order."""

    def __init__(self, columns: list[list[dict]], paths: list[str], short: Callable[[str], str], id_link: str):
        self.short, self.id_link, self.kept, self.literals = short, id_link, {}, {}
        plain = {p.replace("@", ""): p for p in paths}
        self.column = {tuple(_names(c)): self._own(_names(c), plain) for c in columns}

    @staticmethod
    def _own(names: list[str], plain: dict[str, str]) -> str:
        """The table's path of a source column: without the wrapping steps before it, and without the tool's own last step
        for the values of a list or the text of an element."""
        for tail in (names, names[:-1] if names[-1] == "Values" else None, [*names[:-1], "#text"] if names[-1] == "content" else None):
            for k in range(len(tail or ())):
                if "|".join(tail[k:]) in plain:
                    return plain["|".join(tail[k:])]
        raise ValueError(f"the table has no column {names}")

    def put(self, key: tuple, command: dict) -> None:
        before = self.kept.get(key, {})
        # A repeated link often comes without the addresses that its first mention had.
        self.kept[key] = {k: before.get(k) if v is None else v for k, v in command.items()} if before.get("_type_") == command["_type_"] else command

    def path(self, p: dict[str, Any]) -> str:
        return self.column[tuple(_names(json.loads(p["inputColumns"])[0]["value"]))]

    def bind(self, path: str, domain: str, link: str, node: str) -> None:
        self.put(("type", path), {"_type_": "SetSemanticType", "input_attr_path": path, "domain": domain, "type": link, "node_id": node})

    def link(self, edge: dict[str, Any]) -> None:
        source, target, label = self.short(edge["edgeSourceId"]), edge["edgeTargetId"], self.short(edge["edgeId"])
        uri = lambda end: self.short(edge[f"edge{end}Uri"]) if edge.get(f"edge{end}Uri") not in (None, edge[f"edge{end}Id"]) else None
        if target in self.literals:
            self.bind(self.literals[target], uri("Source") or re.sub(r"\d+$", "", source), label, source)
        else:
            self.put(("link", source, self.short(target)), {"_type_": "SetInternalLink", "source_id": source, "target_id": self.short(target), "link_lbl": label, "source_uri": uri("Source"), "target_uri": uri("Target")})

    def transform(self, p: dict[str, Any]) -> None:
        out = json.loads(p["outputColumns"])[0]["value"]
        inputs = {c["value"][-1]["columnName"]: self.column[tuple(_names(c["value"]))] for c in json.loads(p["inputColumns"])}
        parent = next(iter(inputs.values())).rpartition("|")[0] if inputs else ""
        used: list[str] = []

        def whole(m: re.Match) -> str:
            name = m[1].strip("'\" ")
            path = inputs.get(name, f"{parent}|{name}" if parent else name)
            used.append(path)
            return f'getValue("{path}")'

        code = re.sub(r"getValue\(([^)]+)\)", whole, p["transformationCode"])
        name = out[-1]["columnName"]
        self.column[tuple(_names(out))] = f"{parent}|{name}" if parent else name
        command = {"_type_": "PyTransformNewColumn", "input_attr_paths": list(dict.fromkeys(used)), "new_attr_name": name, "code": code, "default_error_value": p.get("errorDefaultValue")}
        self.put(("column", parent, name), command)

    def literal(self, value: str) -> None:
        """A constant column; the tool numbers the nodes of equal constants."""
        n = 1
        while f"{value}{n}" in self.literals:
            n += 1
        path = f"literal:{self.short(value) if value.startswith('http') else value}:{n}"
        self.literals[f"{value}{n}"] = path
        self.put(("literal", path), {"_type_": "AddLiteralColumnCmd", "input_attr_path": path, "val": value})

    def take(self, name: str, p: dict[str, Any]) -> None:
        if name == "SubmitPythonTransformationCommand":
            self.transform(p)
        elif name in ("SetSemanticTypeCommand", "SetMetaPropertyCommand") and "SemanticTypesArray" in p:
            (own,) = p["SemanticTypesArray"]
            self.bind(self.path(p), self.short(own["DomainUri"]), self.short(own["FullType"]), self.short(own["DomainId"].replace(" (add)", "")))
        elif name in ("SetSemanticTypeCommand", "SetMetaPropertyCommand"):
            self.bind(self.path(p), self.short(p["metaPropertyUri"]), self.id_link, self.short(p["metaPropertyId"]))
        elif name == "UnassignSemanticTypeCommand":
            self.kept.pop(("type", self.path(p)), None)
        elif name == "ChangeInternalNodeLinksCommand":
            for edge in p["newEdges"]:
                self.link(edge)
        elif name == "AddLinkCommand":
            self.link(p["edge"])
        elif name == "DeleteLinkCommand":
            key = ("link", self.short(p["edge"]["edgeSourceId"]), self.short(p["edge"]["edgeTargetId"]))
            if self.kept.get(key, {}).get("link_lbl") == self.short(p["edge"]["edgeId"]):
                del self.kept[key]
        elif name == "AddLiteralNodeCommand":
            self.literal(p["literalValue"])
        elif name not in WITHOUT_EFFECT:
            raise ValueError(f"no command {name}")


def commands(history: str, columns: str, paths: list[str], short: Callable[[str], str] = lambda uri: uri, id_link: str = ID_LINK) -> list[dict]:
    """The script (operators.mapping) of a history over a table with these leaf paths; `short` shortens addresses, and
    `id_link` marks a column that holds its node's own address. Text of computed columns is kept as it is, with whole paths
    in it; it isn't run."""
    script = _Script(json.loads(columns), paths, short, id_link)
    for command in json.loads(history):
        script.take(command["commandName"], {p["name"]: p["value"] for p in command["inputParameters"]})
    return list(script.kept.values())
