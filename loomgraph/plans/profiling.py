"""Queries over column profiles: type mix, cardinalities, pseudo keys."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.session import table


def column_profile(spark, sf_dir):
    """AGG1-AGG3: the type mix of every customer column, as fractions, its null count and its type."""
    t = table(spark, sf_dir, "customer")
    values = t.select(*[F.col(c).cast("string") for c in t.columns]).unpivot([], t.columns, "col", "val")
    val = F.nullif(F.trim("val"), F.lit(""))
    num = val.cast("string").try_cast("double").isNotNull() if hasattr(val, "try_cast") else F.expr("try_cast(val as double)").isNotNull()
    agg = values.groupBy("col").agg(
        F.avg(num.cast("double")).alias("num"),
        F.avg((val.isNotNull() & ~num).cast("double")).alias("str"),
        F.avg(val.isNull().cast("double")).alias("nul"),
        F.sum(val.isNull().cast("long")).alias("n_null"),
    )
    kind = (
        F.when(F.col("nul") == 1, "null").when(F.col("str") > F.col("num"), "string")
        .when((F.col("nul") < 0.7) & (F.col("num") + F.col("nul") < 0.9), "string").otherwise("number")
    )
    return agg.withColumn("col_type", kind)


COLUMN_PROFILE_SQL = """
WITH v AS (
  UNPIVOT (SELECT c_custkey::varchar AS c_custkey, c_name, c_nationkey::varchar AS c_nationkey,
    c_acctbal::varchar AS c_acctbal, c_mktsegment FROM customer)
  ON c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment INTO NAME col VALUE val),
f AS (SELECT col, nullif(trim(val), '') AS val, try_cast(val AS double) IS NOT NULL AS num FROM v),
a AS (SELECT col, avg(num::int::double) AS num, avg((val IS NOT NULL AND NOT num)::int::double) AS str,
    avg((val IS NULL)::int::double) AS nul, sum((val IS NULL)::int)::bigint AS n_null FROM f GROUP BY col)
SELECT *, CASE WHEN nul = 1 THEN 'null' WHEN str > num THEN 'string'
  WHEN nul < 0.7 AND num + nul < 0.9 THEN 'string' ELSE 'number' END AS col_type FROM a
"""

QUERIES = {"agg1_column_profile": (column_profile, COLUMN_PROFILE_SQL)}
