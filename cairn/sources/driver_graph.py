"""The driver tables as a graph of triples, and the same as SQL for the checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.session import table

EQUIVALENTS = (("locatedIn", "basedIn"),)

#: SQL of triples(): head, head_type, relation, tail, tail_type, confidence, source.
KG = """
kg AS (
  SELECT lower(trim(head)) AS head, 'System' AS head_type, relation, lower(regexp_replace(trim(tail), '\\s+', ' ', 'g')) AS tail, tail_type, confidence, source
  FROM wikidata_enrich_out WHERE tail IS NOT NULL AND lower(trim(tail)) NOT IN ('', 'unknown')
  UNION ALL SELECT s_name, 'Supplier', 'locatedIn', n_name, 'Nation', 0.9, 'tables' FROM supplier JOIN nation ON s_nationkey = n_nationkey
  UNION ALL SELECT s_name, 'Supplier', 'balance', 'about ' || CAST(CAST(floor(s_acctbal) AS BIGINT) AS VARCHAR) || ' units', 'Literal', 0.7, 'tables' FROM supplier
  UNION ALL SELECT n_name, 'Nation', 'partOf', r_name, 'Region', 1.0, 'tables' FROM nation JOIN region ON n_regionkey = r_regionkey
  UNION ALL SELECT DISTINCT s_name, 'Supplier', 'supplies', p_brand, 'Brand', 0.8, 'tables'
    FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey
)"""


def triples(spark, d: str) -> DataFrame:
    w = table(spark, d, "wikidata_enrich_out").filter(F.col("tail").isNotNull() & ~F.lower(F.trim("tail")).isin("", "unknown"))
    s, n, r, p = (table(spark, d, x) for x in ("supplier", "nation", "region", "part"))
    li = table(spark, d, "lineitem").select("l_suppkey", "l_partkey")

    def edge(df, head, head_type, relation, tail, tail_type, confidence):
        return df.select(head.alias("head"), F.lit(head_type).alias("head_type"), F.lit(relation).alias("relation"), tail.alias("tail"), F.lit(tail_type).alias("tail_type"), F.lit(confidence).alias("confidence"), F.lit("tables").alias("source"))

    parts = [
        w.select(F.lower(F.trim("head")).alias("head"), F.lit("System").alias("head_type"), "relation", F.lower(F.regexp_replace(F.trim("tail"), r"\s+", " ")).alias("tail"), "tail_type", "confidence", "source"),
        edge(s.join(n, s["s_nationkey"] == n["n_nationkey"]), F.col("s_name"), "Supplier", "locatedIn", F.col("n_name"), "Nation", 0.9),
        edge(s, F.col("s_name"), "Supplier", "balance", F.concat(F.lit("about "), F.floor("s_acctbal").cast("string"), F.lit(" units")), "Literal", 0.7),
        edge(n.join(r, n["n_regionkey"] == r["r_regionkey"]), F.col("n_name"), "Nation", "partOf", F.col("r_name"), "Region", 1.0),
        edge(li.join(s, li["l_suppkey"] == s["s_suppkey"]).join(p, li["l_partkey"] == p["p_partkey"]).select("s_name", "p_brand").distinct(), F.col("s_name"), "Supplier", "supplies", F.col("p_brand"), "Brand", 0.8),
    ]
    return reduce(DataFrame.unionByName, parts)


def aliases(spark) -> DataFrame:
    """surface, canonical, priority: a small hand-made alias table over the driver tables' names."""
    return spark.createDataFrame([("Seventh Nation", "NATION_7", 0), ("Seven", "NATION_77", 0), ("Seven", "NATION_7", 1), ("Far East", "ASIA", 0)], "surface string, canonical string, priority int")
