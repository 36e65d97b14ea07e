"""Readers and sinks (S-01..S-17)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

TRIPLE = T.StructType([T.StructField(c, T.DoubleType() if c == "confidence" else T.StringType()) for c in ("head", "head_type", "relation", "tail", "tail_type", "confidence", "evidence", "source")])


def extraction_results(spark: SparkSession, path: str) -> DataFrame:
    """S-01: records with a list of triples, flattened; the record's id and title are defaults of its triples."""
    schema = T.StructType().add("radar_id", "string").add("title", "string").add("triples", T.ArrayType(TRIPLE))
    r = spark.read.schema(schema).json(path, multiLine=True)
    return r.select("radar_id", "title", F.explode("triples").alias("t")).select("radar_id", "title", "t.*")


def any_layout(spark: SparkSession, path: str) -> DataFrame:
    """S-03: a list of groups, a flat list or a dict of groups of triples, told apart by content."""
    raw = spark.read.text(path, wholetext=True).select(F.col("value"))
    triples = T.ArrayType(TRIPLE)
    flat = raw.filter(F.col("value").rlike(r'^\s*\[\s*\{\s*"head')).select(F.explode(F.from_json("value", triples)).alias("t"))
    groups = raw.filter(F.col("value").rlike(r"^\s*\[") & ~F.col("value").rlike(r'^\s*\[\s*\{\s*"head')).select(F.explode(F.from_json("value", T.ArrayType(T.StructType().add("triples", triples)))).alias("g")).select(F.explode("g.triples").alias("t"))
    keyed = raw.filter(F.col("value").rlike(r"^\s*\{")).select(F.explode(F.map_values(F.from_json("value", T.MapType(T.StringType(), triples)))).alias("g")).select(F.explode("g").alias("t"))
    return flat.unionByName(groups).unionByName(keyed).select("t.*")


def jsonl(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """S-07: one object per line; a broken line fails the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def strict_csv(spark: SparkSession, path: str, schema: T.StructType, encoding: str = "UTF-8") -> DataFrame:
    """S-07: header must match, ragged rows fail the read."""
    return spark.read.schema(schema).option("header", True).option("enforceSchema", False).option("mode", "FAILFAST").option("encoding", encoding).csv(path)


def kopl_triples(entities: DataFrame, attr_facts: DataFrame, rel_facts: DataFrame, entity_concepts: DataFrame, concepts: DataFrame) -> DataFrame:
    """S-05: membership, forward relations and attributes of a knowledge base as distinct triples."""
    n = entities.select("entity_id", "name")
    member = entity_concepts.join(n, "entity_id").join(concepts.select("concept_id", F.col("name").alias("tail")), "concept_id").select(F.col("name").alias("head"), F.lit("instanceOf").alias("relation"), "tail")
    rel = rel_facts.join(n.withColumnRenamed("entity_id", "subject").withColumnRenamed("name", "head"), "subject").join(n.withColumnRenamed("entity_id", "object").withColumnRenamed("name", "tail"), "object").select("head", F.col("predicate").alias("relation"), "tail")
    att = attr_facts.join(n, "entity_id").select(F.col("name").alias("head"), F.col("key").alias("relation"), F.coalesce("vstr", F.concat_ws(" ", F.col("vnum").cast("string"), "unit")).alias("tail"))
    return member.unionByName(rel).unionByName(att).distinct()


def table_rows(pages: DataFrame) -> DataFrame:
    """S-09, S-10: rows of HTML tables: page_id, row_no, cells."""
    rows = F.regexp_extract_all("html", F.lit(r"(?is)<tr[^>]*>(.*?)</tr>"), 1)
    r = pages.select("page_id", F.posexplode(rows).alias("row_no", "row"))
    cells = F.transform(F.regexp_extract_all("row", F.lit(r"(?is)<t[dh][^>]*>(.*?)</t[dh]>"), 1), lambda c: F.trim(F.regexp_replace(c, r"<[^>]+>", "")))
    return r.select("page_id", "row_no", cells.alias("cells"))


def key_values(docs: DataFrame, id_: str, text: str) -> DataFrame:
    """S-10: "key: value" or "| key | value |" lines of a text: id, line_no, key, value."""
    li = docs.select(F.col(id_).alias("id"), F.posexplode(F.split(text, "\n")).alias("line_no", "line"))
    bar = F.regexp_extract("line", r"^\s*\|\s*([^|]+?)\s*\|\s*([^|]+?)\s*\|\s*$", 1)
    key = F.when(bar != "", bar).otherwise(F.trim(F.regexp_extract("line", r"^([^:：]{2,40})[:：]\s*(\S.*)$", 1)))
    value = F.when(bar != "", F.regexp_extract("line", r"^\s*\|\s*([^|]+?)\s*\|\s*([^|]+?)\s*\|\s*$", 2)).otherwise(F.trim(F.regexp_extract("line", r"^([^:：]{2,40})[:：]\s*(\S.*)$", 2)))
    return li.select("id", "line_no", key.alias("key"), value.alias("value")).filter("key != '' and value != ''")


def infobox(docs: DataFrame, id_: str, column: str = "infobox") -> DataFrame:
    """R-05: a map of an infobox as rows id, key, value."""
    return docs.filter(F.col(column).isNotNull()).select(F.col(id_).alias("id"), F.explode(column).alias("key", "value")).distinct()


def sections(docs: DataFrame, id_: str, text: str) -> DataFrame:
    """S-11: sections of "== H ==" markup: id, section_no, heading, body."""
    parts = F.split(F.concat(F.lit("\n"), F.col(text)), r"\n==+ ?(?=[^\n=]+ ?==+)")
    p = docs.filter(F.col(text).isNotNull()).select(F.col(id_).alias("id"), F.posexplode(parts).alias("section_no", "part"))
    head = F.when(F.col("section_no") > 0, F.trim(F.regexp_extract("part", r"^([^\n=]+?) ?==+", 1)))
    return p.select("id", "section_no", head.alias("heading"), F.trim(F.when(F.col("section_no") > 0, F.regexp_replace("part", r"^[^\n=]+ ?==+\s*", "")).otherwise(F.col("part"))).alias("body")).filter("body != '' or heading is not null")


def load_bundle(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """S-14: nodes with placeholders for dangling ends, and edges by node id (unique name, then type, then lowest id). A repeated triple raises."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("head").alias("name"), F.col("head_type").alias("type")), F.struct(F.col("tail").alias("name"), F.col("tail_type").alias("type")))).alias("e")).select("e.*").distinct()
    dangling = ends.join(nodes.select("name").distinct(), "name", "left_anti").groupBy("name").agg(F.min("type").alias("type"))
    every = nodes.select("node_id", "name", "type").unionByName(dangling.select(F.concat(F.lit("placeholder:"), "name").alias("node_id"), "name", "type"))

    def resolved(e: DataFrame, end: str) -> DataFrame:
        c = e.join(every.select(F.col("name").alias(end), F.col("node_id").alias("_id"), F.col("type").alias("_ty")), end)
        w = W.partitionBy("_e").orderBy(F.desc(F.coalesce(F.col("_ty") == F.col(f"{end}_type"), F.lit(False))), "_id")
        return c.withColumn("_k", F.row_number().over(w)).filter(F.col("_k") == 1).drop("_k", "_ty").withColumnRenamed("_id", f"{end}_id")

    n = edges.groupBy("head", "relation", "tail").count()
    checked = edges.join(n, ["head", "relation", "tail"]).withColumn("_ok", F.assert_true(F.col("count") == 1, "a triple occurs twice")).filter(F.col("_ok").isNull())
    e = checked.withColumn("_e", F.xxhash64("head", "relation", "tail"))
    return every, resolved(resolved(e, "head"), "tail").select("head_id", "relation", "tail_id")


def flat_triples(entities: DataFrame) -> DataFrame:
    """S-15: entities' attributes back as triples. entities: name, attributes array<struct<attr, value_raw>>."""
    return entities.select(F.col("name").alias("head"), F.explode("attributes").alias("a")).select("head", F.col("a.attr").alias("relation"), F.col("a.value_raw").alias("tail")).filter("tail is not null")


def manifest(df: DataFrame, *keys: str) -> DataFrame:
    """S-16: a content hash per row."""
    return df.select(*keys, F.sha2(F.to_json(F.struct(*sorted(df.columns))), 256).alias("sha256"))


def write_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """S-13: the graph as Parquet, edges partitioned by relation."""
    nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    edges.write.mode("overwrite").partitionBy("relation").parquet(f"{path}/edges")


def shown(head: Column, relation: Column, tail: Column) -> Column:
    return F.concat_ws(" ", head, relation, tail)
