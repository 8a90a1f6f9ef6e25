"""A corpus pipeline: quality rules, near-duplicate removal, substring dedup, source mixing, packing.

Every stage takes (spark, docs, sf_dir) and works on all that the one before it kept. All but the last
return the columns of documents; run() writes each stage as Parquet and reads it again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.common import Scratch
from loomgraph.llm.mixing import mix
from loomgraph.llm.neardup import NearRules, near_duplicates
from loomgraph.llm.packing import digest, pack
from loomgraph.llm.quality import quality_rules
from loomgraph.llm.suffixes import dedup_substrings

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the suffix-array repetition rules."""
    return quality_rules(docs, keep=COLUMNS).where("kept").select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles, a similarity of 0.8 or more.
    Rows of one doc_id are one document: where it stays, each of its different texts stays, once (of rows with
    equal texts, the one with the smallest other columns). Rows without a doc_id stay."""
    scratch = Scratch(spark)
    judged = near_duplicates(docs, NearRules(shingle=5, percent=80)).where("doc_id is not null")
    per = judged.groupBy("doc_id").agg(F.bool_and("kept").alias("kept"), F.count("*").alias("n"))
    # Written, so that its size is known: where it is small, no text moves. Else both joins read one shuffle of the texts.
    special = scratch.write(per.where("n > 1 or not kept").select("doc_id", "kept"))
    scratch.collect_shuffles()
    rows, others = docs.select(*COLUMNS), [c for c in COLUMNS if c not in ("doc_id", "text")]
    named = rows.where("doc_id is not null")
    single = named.join(special.select("doc_id"), "doc_id", "left_anti").unionByName(rows.where("doc_id is null"))
    again = named.join(special.where("kept").select("doc_id"), "doc_id").groupBy("doc_id", "text").agg(F.min(F.struct(*others)).alias("least"))
    return single.unionByName(again.select("doc_id", "text", "least.*").select(*COLUMNS))


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the 100-byte strings that start earlier. Bytes of characters cut in two go too."""
    out = dedup_substrings(docs, keep=("lang", "source"))
    # Only whole characters: the cut may leave a lead byte or tail bytes of one at a span's edge.
    return _valid_text(out).select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))


def _valid_text(out: DataFrame) -> DataFrame:
    return out.withColumn("text", F.make_valid_utf8(F.col("kept").cast("string"))).withColumn(
        "text", F.when(F.size("spans") > 0, F.replace("text", F.lit("�"), F.lit(""))).otherwise(F.col("text"))
    )


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, whole: the words taken over the document's size, rounded.
    Documents without words have no part in a mix of words and stay as they are."""
    per = mix(docs).taken.groupBy("doc_id").agg(F.sum("taken").alias("taken"), F.sum("size").alias("size"))
    times = F.when(F.col("size") == 0, 1).otherwise(F.floor(F.col("taken") / F.col("size") + 0.5)).cast("int")
    per = per.select(F.col("doc_id").alias("id"), times.alias("times"))
    rows = docs.select(*COLUMNS).join(per, F.col("doc_id").eqNullSafe(F.col("id"))).where("times > 0")
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times")))).select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences of 2048 tokens."""
    return digest(pack(docs))


STAGES = [
    ("quality_rules", quality),
    ("near_dedup", near_dedup),
    ("suffix_dedup", suffix_dedup),
    ("source_mix", source_mix),
    ("best_fit_packing", packing),
]

#: SQL expresses neither the suffix arrays nor the minhash trees nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    scratch = Scratch(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = scratch.write(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
