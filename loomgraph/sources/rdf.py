"""Triples from Turtle, N-Triples and RDF/XML files, and N-Triples text from triples.

A file of N-Triples is read by lines and splits; a Turtle or XML file is one document, parsed whole by one task."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import count
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
XSD = "http://www.w3.org/2001/XMLSchema#"
XML = "{http://www.w3.org/XML/1998/namespace}"

#: kind is iri, blank or literal; datatype and lang are of literals.
SCHEMA = "s string, p string, o string, kind string, datatype string, lang string"

_TOKEN = re.compile(
    r"""(?P<skip>\s+|\#[^\n]*)|(?P<iri><[^<>"{}|^`\s]*>)|(?P<long>\"{3}(?:[^"\\]|\\.|"(?!""))*\"{3}|'{3}(?:[^'\\]|\\.|'(?!''))*'{3})"""
    r"""|(?P<text>"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')|(?P<tag>@[A-Za-z]+(?:-[A-Za-z0-9]+)*)|(?P<type>\^\^)|(?P<blank>_:[\w.-]*[\w-])"""
    r"""|(?P<number>[+-]?(?:\d+\.?\d*[eE][+-]?\d+|\.\d+[eE][+-]?\d+|\d*\.\d+|\d+))|(?P<name>[\w.-]*:(?:[\w:%-]|\.(?=[\w:%-]))*|[A-Za-z]+)|(?P<mark>[;,.\[\]()])""",
    re.S,
)
_ESCAPE = re.compile(r"\\(u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8}|.)", re.S)
_PLAIN = {"t": "\t", "n": "\n", "r": "\r", "b": "\b", "f": "\f"}


def _unescape(text: str) -> str:
    return _ESCAPE.sub(lambda m: chr(int(m[1][1:], 16)) if m[1][0] in "uU" else _PLAIN.get(m[1], m[1]), text)


class _Turtle:
    def __init__(self, text: str, doc: str):
        self.doc, self.prefixes, self.base, self.blank, self.out = doc, {}, "", count(), []
        self.tokens, at = [], 0
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                raise ValueError(f"no Turtle at {text[at:at + 40]!r}")
            if m.lastgroup != "skip":
                self.tokens.append((m.lastgroup, m[0]))
            at = m.end()
        self.at = 0

    def peek(self) -> tuple[str, str]:
        return self.tokens[self.at] if self.at < len(self.tokens) else ("end", "")

    def take(self, mark: str | None = None) -> tuple[str, str]:
        token = self.peek()
        if token[0] == "end" or mark is not None and token[1] != mark:
            raise ValueError(f"{mark or 'a term'} expected, not {token[1]!r}")
        self.at += 1
        return token

    def fresh(self) -> tuple[str, str]:
        return f"_:g{next(self.blank)}{self.doc}", "blank"

    def iri(self, kind: str, value: str) -> str:
        if kind == "iri":
            own = _unescape(value[1:-1])
            return own if re.match(r"[A-Za-z][\w+.-]*:", own) else self.base + own
        prefix, _, local = value.partition(":")
        if kind != "name" or ":" not in value or prefix not in self.prefixes:
            raise ValueError(f"no name {value!r}")
        return self.prefixes[prefix] + local

    def term(self) -> tuple:
        """(value, kind, datatype, lang)"""
        kind, value = self.take()
        if value == "[":
            node = self.fresh()
            if self.peek()[1] != "]":
                self.properties(node[0])
            self.take("]")
            return (*node, None, None)
        if value == "(":
            items = []
            while self.peek()[1] != ")":
                items.append(self.term())
            self.take(")")
            following: tuple = (RDF + "nil", "iri", None, None)
            for item in reversed(items):
                node = (*self.fresh(), None, None)
                self.out += [(node[0], RDF + "first", *item), (node[0], RDF + "rest", *following)]
                following = node
            return following
        if kind in ("text", "long"):
            cut = 3 if kind == "long" else 1
            own = _unescape(value[cut:-cut])
            if self.peek()[0] == "tag":
                return own, "literal", None, self.take()[1][1:].lower()
            if self.peek()[0] == "type":
                self.take()
                return own, "literal", self.iri(*self.take()), None
            return own, "literal", None, None
        if kind == "number":
            type_ = "double" if "e" in value.lower() else "decimal" if "." in value else "integer"
            return value, "literal", XSD + type_, None
        if value in ("true", "false"):
            return value, "literal", XSD + "boolean", None
        if kind == "blank":
            return value + self.doc, "blank", None, None
        return self.iri(kind, value), "iri", None, None

    def properties(self, subject: str) -> None:
        while True:
            kind, value = self.take()
            predicate = RDF + "type" if value == "a" else self.iri(kind, value)
            while True:
                self.out.append((subject, predicate, *self.term()))
                if self.peek()[1] != ",":
                    break
                self.take()
            while self.peek()[1] == ";":
                self.take()
            if self.peek()[1] in (".", "]") or self.peek()[0] == "end":
                return
            if self.tokens[self.at - 1][1] != ";":
                raise ValueError(f"; or . expected, not {self.peek()[1]!r}")

    def parse(self) -> list[tuple]:
        while self.peek()[0] != "end":
            word = self.peek()[1].lower()
            if word in ("@prefix", "prefix"):
                self.take()
                name = self.take()[1]
                self.prefixes[name[:-1]] = self.iri(*self.take())
            elif word in ("@base", "base"):
                self.take()
                self.base = self.iri(*self.take())
            else:
                alone = word == "["
                subject = self.term()[0]
                if not (alone and self.peek()[1] == "."):
                    self.properties(subject)
                self.take(".")
                continue
            if word[0] == "@":
                self.take(".")
        return self.out


def parse_turtle(text: str, doc: str = "") -> list[tuple]:
    """Triples of a Turtle or N-Triples text; `doc` tells its blank nodes from other documents'."""
    return _Turtle(text, doc).parse()


def parse_xml(text: str, doc: str = "") -> list[tuple]:
    """Triples of an RDF/XML text: typed nodes, property attributes, nested nodes, resources, literals."""
    out, blank = [], count()
    name = lambda tag: tag[1:].replace("}", "", 1) if tag[0] == "{" else tag
    at = lambda e, key: e.get(f"{{{RDF}}}{key}")

    def full(iri: str, base: str) -> str:
        return iri if re.match(r"[A-Za-z][\w+.-]*:", iri) else base + iri

    def attributes(e, subject: str) -> None:
        for key, value in e.attrib.items():
            if not key.startswith((f"{{{RDF}}}", XML)) and key[0] == "{":
                out.append((subject, name(key), value, "literal", None, None))

    def node(e, base: str) -> tuple[str, str]:
        base = e.get(XML + "base", base)
        if at(e, "about") is not None:
            own = full(at(e, "about"), base), "iri"
        elif at(e, "ID") is not None:
            own = f"{base}#{at(e, 'ID')}", "iri"
        elif at(e, "nodeID") is not None:
            own = f"_:{at(e, 'nodeID')}{doc}", "blank"
        else:
            own = f"_:x{next(blank)}{doc}", "blank"
        if e.tag != f"{{{RDF}}}Description":
            out.append((own[0], RDF + "type", name(e.tag), "iri", None, None))
        attributes(e, own[0])
        for child in e:
            prop(child, own[0], base)
        return own

    def prop(e, subject: str, base: str) -> None:
        p = name(e.tag)
        if at(e, "resource") is not None:
            out.append((subject, p, full(at(e, "resource"), base), "iri", None, None))
        elif at(e, "nodeID") is not None:
            out.append((subject, p, f"_:{at(e, 'nodeID')}{doc}", "blank", None, None))
        elif at(e, "parseType") == "Collection":
            items = [node(c, base) for c in e]
            following = (RDF + "nil", "iri")
            for item in reversed(items):
                own = f"_:x{next(blank)}{doc}"
                out.extend([(own, RDF + "first", *item, None, None), (own, RDF + "rest", *following, None, None)])
                following = (own, "blank")
            out.append((subject, p, *following, None, None))
        elif len(e):
            out.extend((subject, p, *node(c, base), None, None) for c in e)
        else:
            out.append((subject, p, e.text or "", "literal", at(e, "datatype"), e.get(XML + "lang")))

    root = ElementTree.fromstring(text)
    base = root.get(XML + "base", "")
    for e in root if root.tag == f"{{{RDF}}}RDF" else [root]:
        node(e, base)
    return out


def load_triples(spark: SparkSession, path: str) -> DataFrame:
    """Distinct triples of files of one kind, told by extension: nt, ttl or n3, rdf, owl or xml (SRC10)."""
    end = path.rsplit(".", 1)[-1].lower()
    if end not in ("nt", "ttl", "n3", "rdf", "owl", "xml"):
        raise ValueError(f"no triples in {path}")
    parse = parse_xml if end in ("rdf", "owl", "xml") else parse_turtle
    rows = spark.read.text(path, wholetext=end != "nt").select("value", F.md5(F.col("_metadata.file_path")).alias("doc"))

    def run(batches) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [t for text, doc in zip(batch["value"], batch["doc"]) for t in parse(text, f".{doc[:8]}")]
            yield pd.DataFrame(found, columns=["s", "p", "o", "kind", "datatype", "lang"], dtype=object)

    return rows.mapInPandas(run, SCHEMA).distinct()


def _escaped(c: Column) -> Column:
    for plain, written in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r")):
        c = F.replace(c, F.lit(plain), F.lit(written))
    return c


def ntriples(triples: DataFrame) -> DataFrame:
    """(value): each triple as a line of N-Triples; write it with `write.text` (SNK2's triples)."""
    iri = lambda c: F.when(F.startswith(c, F.lit("_:")), c).otherwise(F.concat(F.lit("<"), c, F.lit(">")))
    quoted = F.concat(F.lit('"'), _escaped(F.col("o")), F.lit('"'))
    tail = F.when(F.col("lang").isNotNull(), F.concat(F.lit("@"), "lang")).when(F.col("datatype").isNotNull(), F.concat(F.lit("^^<"), "datatype", F.lit(">"))).otherwise("")
    obj = F.when(F.col("kind") == "literal", F.concat(quoted, tail)).otherwise(iri(F.col("o")))
    return triples.select(F.concat_ws(" ", iri(F.col("s")), F.concat(F.lit("<"), "p", F.lit(">")), obj, F.lit(".")).alias("value"))
