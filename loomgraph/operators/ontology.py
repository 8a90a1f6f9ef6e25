"""Ontologies as triples (s, p, o): classes, predicates with their domains and ranges, which classes a predicate links."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.operators.graph import descendants

RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
RDFS = "http://www.w3.org/2000/01/rdf-schema#"
OWL = "http://www.w3.org/2002/07/owl#"

#: The types that make a subject a class or a predicate.
CLASS_TYPES = (OWL + "Class", RDFS + "Class")
PREDICATE_TYPES = (RDF + "Property", OWL + "ObjectProperty", OWL + "DatatypeProperty", OWL + "AnnotationProperty", OWL + "TransitiveProperty")
#: Predicates of every ontology.
ALWAYS = (RDF + "value", RDFS + "label")


def match(triples: DataFrame, s: str | None = None, p: str | None = None, o: str | None = None) -> DataFrame:
    """Triples that equal what is given (GR1)."""
    for name, value in (("s", s), ("p", p), ("o", o)):
        if value is not None:
            triples = triples.where(F.col(name) == value)
    return triples


def classes(triples: DataFrame) -> DataFrame:
    """(uri): whatever is typed as a class (GR2)."""
    return triples.where((F.col("p") == RDF + "type") & F.col("o").isin(*CLASS_TYPES)).select(F.col("s").alias("uri")).distinct()


def predicates(*triples: DataFrame) -> DataFrame:
    """(uri, type, domains, ranges) over one or more ontologies; domains and ranges are united (GR2, GR3). Values and labels
    are predicates everywhere."""
    every = reduce(DataFrame.unionByName, [t.select("s", "p", "o") for t in triples])
    always = every.sparkSession.createDataFrame([(uri, RDF + "type", RDF + "Property") for uri in ALWAYS], "s string, p string, o string")
    typed = (F.col("p") == RDF + "type") & F.col("o").isin(*PREDICATE_TYPES)
    pick = lambda p: F.sort_array(F.collect_set(F.when(F.col("p") == RDFS + p, F.col("o"))))
    per = every.unionByName(always).groupBy(F.col("s").alias("uri")).agg(F.max(F.when(typed, F.col("o"))).alias("type"), pick("domain").alias("domains"), pick("range").alias("ranges"))
    return per.where(F.col("type").isNotNull())


def ancestors(triples: DataFrame) -> DataFrame:
    """(uri, ancestor), each class being its own too (GR5)."""
    sub = triples.where(F.col("p") == RDFS + "subClassOf").select(F.col("s").alias("src"), F.col("o").alias("dst")).distinct()
    above = descendants(sub).select(F.col("node").alias("uri"), F.col("descendant").alias("ancestor"))
    every = classes(triples).unionByName(sub.select(F.explode(F.array("src", "dst")).alias("uri"))).distinct()
    return every.select("uri", F.col("uri").alias("ancestor")).unionByName(above).distinct()


def linkable(preds: DataFrame, above: DataFrame, strict: bool = True) -> DataFrame:
    """(src, predicate, dst): classes a predicate may link, its domains and ranges holding them or an ancestor (GR4, GR6).
    Both sides are equality joins on the ancestor. `strict` leaves out predicates for data and annotations."""
    if strict:
        preds = preds.where(~F.col("type").isin(OWL + "DatatypeProperty", OWL + "AnnotationProperty"))
    src = preds.select(F.col("uri").alias("predicate"), F.explode("domains").alias("ancestor")).join(above, "ancestor").select("predicate", F.col("uri").alias("src")).distinct()
    dst = preds.select(F.col("uri").alias("predicate"), F.explode("ranges").alias("ancestor")).join(above, "ancestor").select("predicate", F.col("uri").alias("dst")).distinct()
    return src.join(dst, "predicate").select("src", "predicate", "dst")


def advise(observed: DataFrame, top: int = 15, least: float = 1e-9) -> DataFrame:
    """(src, label, dst, p, place): of each class the most probable links seen (GR7); ties by name."""
    seen = observed.groupBy("src", "label", "dst").agg(F.count("*").alias("n"))
    p = F.col("n") / F.sum("n").over(Window.partitionBy("src"))
    w = Window.partitionBy("src").orderBy(F.desc("n"), "label", "dst")
    return seen.select("src", "label", "dst", p.alias("p"), F.row_number().over(w).cast("long").alias("place")).where((F.col("p") > least) & (F.col("place") <= top))
