"""Problem 3: attribute-value rows into one row per family with typed columns.

Method. Stated values become cells, one row per (family, attribute). The cells are written partitioned by attribute, so that
each attribute is a typed narrow table whose scan reads its own files and fields only. The narrow tables of one type are brought together
by family into one table with a column for each of them; each such table is partitioned by family once, and a balanced
tree of outer joins combines them: up to four join the table of all families, such groups join each other. As every group
holds all families, left outer joins are full ones, and they keep the partitioning by family, so the tree itself needs
no exchange. (Joining the 29 narrow tables one by one was tried: 33 sort-merge joins in one stage took 625 MB a task, see README.)

Scale. Values are counted per (family, attribute, value) before anything is partitioned by family, so a family with a third
of all rows is spread over its values and then is one row per attribute. The tree has log2(attributes) levels,
and each side has at most one row per family. Conflicts compare minima and maxima; lists are compared place by place.

Defined results. family_id null or blank: the row belongs to no family and states nothing. Placeholders and values
that cannot be read as the column's type state nothing. Attributes outside attr_schema are ignored. A head that
equals no family_id is ignored; if two families are equal without separators it belongs to both.
The value of a cell is the most frequent one, ties by a hash of the value. Rows delivered twice count once
(equal record_id). Lists of options are sets: order and repeats do not count, and they differ if they have other
lengths or a figure is more than 2 % apart. Empty tables give an empty table with all columns.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.operators.unit_harmoniser import QUANTITY, even_name, harmonise, schema_names
from cairn.session import shared_folder

# What stands for a missing value, and what affirms or denies.
PLACEHOLDERS = ["", "-", "–", "—", "--", "n/a", "na", "none", "null", "nil", "?", "tbd", "tba", "tbc", "unknown", "not stated", "not known", "not available", "not applicable", "see drawing", "unspecified", "未知", "不详", "暂无", "无"]
AFFIRMS = ["yes", "y", "true", "t", "1", "是", "有", "具备"]
DENIES = ["no", "n", "false", "f", "0", "否", "没有", "不具备"]


def _text(c):
    return F.lower(F.regexp_replace(F.trim(c), r"\s+", " "))


def _states(c):
    t = _text(c)
    return t.isNotNull() & ~t.isin(PLACEHOLDERS) & ~t.rlike(r"^see (?:annex|table|drawing|note)\b")


def facts(records: DataFrame, relations: DataFrame, attr_schema: DataFrame) -> DataFrame:
    """family, attr, vtype, lo, hi, list, txt: one row per stated value; numbers in unit_std."""
    q = harmonise(records, attr_schema)
    usable = (F.size("std") > 0) & ~F.exists("std", lambda x: x.isNull())
    lists = F.when(F.col("vtype") == "quantity_options", F.array_sort(F.array_distinct("std")))
    quantity = q.filter(usable & (F.coalesce("family", F.lit("")) != "")).select(
        "record_id", "family", "attr", "vtype",
        F.when(lists.isNull(), F.array_min("std")).alias("lo"), F.when(lists.isNull(), F.array_max("std")).alias("hi"),
        lists.alias("items"), F.lit(None).cast("string").alias("txt"),
    )
    names = schema_names(attr_schema)
    tv = F.col("typed_value")
    r = records.select("record_id", F.lower(F.trim("family_id")).alias("family"), even_name(F.col("attribute")).alias("_name"), "value_text", "typed_value")
    r = r.join(names.filter(~F.col("vtype").isin(*QUANTITY, "entity")), "_name").filter(F.coalesce("family", F.lit("")) != "")
    raw = F.coalesce(F.when(_states(F.col("value_text")), F.col("value_text")), F.when(F.col("value_text").isNull(), tv["text"]))
    r = r.withColumn("_raw", raw)
    figure = F.coalesce(F.regexp_extract(F.regexp_replace("_raw", r",(?=\d{3}(?!\d))", ""), r"[-−]?\d+(?:\.\d+)?", 0).try_cast("double"), F.when(F.col("value_text").isNull(), tv["value"]))
    word = _text(F.col("_raw"))
    flag = F.when(word.isin(AFFIRMS), F.lit("yes")).when(word.isin(DENIES), F.lit("no"))
    number = F.when(F.col("vtype").isin("count", "year"), figure)
    rest = r.select(
        "record_id", "family", "attr", "vtype", number.alias("lo"), number.alias("hi"), F.lit(None).cast("array<double>").alias("items"),
        F.when(F.col("vtype") == "flag", flag).when((F.col("vtype") == "text") & _states(F.col("_raw")), word).alias("txt"),
    ).filter(F.col("lo").isNotNull() | F.col("txt").isNotNull())
    bare = lambda c: F.regexp_replace(F.lower(F.trim(c)), r"[\s\-_/().]", "")
    families = records.select(F.lower(F.trim("family_id")).alias("family")).filter(F.coalesce("family", F.lit("")) != "").distinct().withColumn("_h", bare(F.col("family")))
    rel = relations.select(bare(F.col("head")).alias("_h"), even_name(F.col("relation")).alias("_name"), _text(F.col("tail")).alias("txt"), "tail")
    rel = rel.filter(_states(F.col("tail"))).groupBy("_h", "_name", "txt").agg(F.count("*").alias("_n"))
    rel = rel.join(names.filter(F.col("vtype") == "entity"), "_name").join(families, "_h")
    rel = rel.select(
        F.concat_ws("|", "_h", "attr", "txt").alias("record_id"), "family", "attr", "vtype", F.lit(None).cast("double").alias("lo"),
        F.lit(None).cast("double").alias("hi"), F.lit(None).cast("array<double>").alias("items"), "txt",
    )
    return quantity.unionByName(rest).unionByName(rel)


def _apart(lo, hi):
    return (hi - lo) > 0.02 * F.greatest(F.abs(lo), F.abs(hi)) * (1 + 1e-9)


def _lists_apart(votes: DataFrame) -> DataFrame:
    """family, attr of cells whose lists have other lengths or, at one place, figures more than 2 % apart."""
    lists = votes.filter(F.col("vtype") == "quantity_options").select("family", "attr", F.size("_v.items").alias("size"), F.posexplode("_v.items").alias("at", "x"))
    place = lists.groupBy("family", "attr", "at").agg(F.min("x").alias("x1"), F.max("x").alias("x2"), F.min("size").alias("s1"), F.max("size").alias("s2"))
    return place.groupBy("family", "attr").agg(F.bool_or(_apart(F.col("x1"), F.col("x2")) | (F.col("s1") != F.col("s2"))).alias("lists_differ"))


def cells(records: DataFrame, relations: DataFrame, attr_schema: DataFrame, lists: bool = True) -> DataFrame:
    """family, attr -> value, n_rows, differs. lists=False: cells of lists are not compared."""
    f = facts(records, relations, attr_schema).withColumn("_id", F.coalesce("record_id", F.lit("")))
    f = f.withColumn("_v", F.struct(F.col("lo"), F.col("hi"), F.col("items"), F.regexp_replace("txt", r"\s+", "").alias("key"), F.col("txt")))
    # a record delivered twice counts once; the first exchange is on the record too, so no family is one task
    votes = f.groupBy("family", "attr", "vtype", "_v", "_id").agg(F.lit(1).alias("_one")).groupBy("family", "attr", "vtype", "_v").agg(F.count("*").alias("n"))
    g = votes.groupBy("family", "attr", "vtype").agg(
        F.max_by("_v", F.struct("n", F.hash("_v"))).alias("v"), F.sum("n").alias("n_rows"),
        F.min("_v.lo").alias("lo1"), F.max("_v.lo").alias("lo2"), F.min("_v.hi").alias("hi1"), F.max("_v.hi").alias("hi2"),
        F.min("_v.key").alias("k1"), F.max("_v.key").alias("k2"),
    )
    if lists:
        g = g.join(_lists_apart(votes), ["family", "attr"], "left")
    heat = F.col("unit_std") == "°C"
    units = attr_schema.select(F.col("attribute").alias("attr"), "unit_std", "is_multi_valued")
    g = g.join(F.broadcast(units), "attr")  # the rows of a schema
    quantity = F.when(heat, (F.col("lo2") - F.col("lo1") > 1 + 1e-9) | (F.col("hi2") - F.col("hi1") > 1 + 1e-9)).otherwise(_apart(F.col("lo1"), F.col("lo2")) | _apart(F.col("hi1"), F.col("hi2")))
    differs = (
        F.when(F.col("vtype").isin("quantity", "quantity_range"), quantity)
        .when(F.col("vtype").isin("count", "year"), F.col("lo1") != F.col("lo2"))
        .when(F.col("vtype") == "quantity_options", F.col("lists_differ") if lists else F.lit(None).cast("boolean"))
        .otherwise(F.col("k1") != F.col("k2"))
    )
    return g.select("family", "attr", "vtype", "is_multi_valued", "v", "n_rows", F.coalesce(differs, F.lit(False)).alias("differs"))


def _narrow_files(c: DataFrame, records: DataFrame) -> DataFrame:
    """The cells, and one row for every family, written once into the shared folder, partitioned by attribute."""
    everyone = records.select(F.lower(F.trim("family_id")).alias("family")).filter(F.coalesce("family", F.lit("")) != "").distinct().withColumn("attr", F.lit(_ALL))
    both = c.unionByName(everyone, allowMissingColumns=True)
    path = shared_folder(c.sparkSession, "cells")
    both.write.partitionBy("attr").parquet(path)
    return c.sparkSession.read.schema(both.schema).parquet(path)


_ALL = "*"
_GROUP = 4
_TYPED = {
    "quantity": lambda: F.col("v.lo"),
    "quantity_range": lambda: F.struct(F.col("v.lo").alias("lower"), F.col("v.hi").alias("upper")),
    "quantity_options": lambda: F.col("v.items"),
    "count": lambda: F.col("v.lo").cast("long"),
    "year": lambda: F.col("v.lo").cast("int"),
    "flag": lambda: F.col("v.txt") == "yes",
    "text": lambda: F.col("v.txt"),
    "entity": lambda: F.col("v.txt"),
}


def wide(records: DataFrame, relations: DataFrame, attr_schema: DataFrame, quality: bool = False) -> DataFrame:
    """One row per family, one typed column per row of attr_schema.

    quality adds to each column an <attribute>__differs flag: the rows state two or more different values.
    """
    schema = [(r.attribute, r.vtype) for r in attr_schema.select("attribute", "vtype").orderBy("attribute").collect()]  # 29 rows, fixed
    base = _narrow_files(cells(records, relations, attr_schema, quality), records)
    return _combined(base, schema, [a for a, _ in schema] if quality else [])


def _combined(base: DataFrame, schema: list[tuple], flagged: list[str]) -> DataFrame:
    """The narrow tables of the cells, by type, joined."""
    everyone = base.filter(F.col("attr") == _ALL).select("family")
    narrow = []
    for type_ in dict.fromkeys(t for _, t in schema):
        own = [a for a, t in schema if t == type_]
        columns = []
        for a in own:
            here = F.col("attr") == a
            columns.append(F.max(F.when(here, _TYPED[type_]())).alias(a))
            if a in flagged:
                columns.append(F.bool_or(here & F.col("differs")).alias(f"{a}__differs"))
        narrow.append(base.filter(F.col("attr").isin(own)).groupBy("family").agg(*columns))
    outer = lambda a, b: a.join(b, "family", "left")
    tree = [reduce(outer, narrow[i : i + _GROUP], everyone) for i in range(0, max(len(narrow), 1), _GROUP)]
    while len(tree) > 1:  # balanced: neighbours first, so no side is wider than half of what is joined so far
        tree = [reduce(outer, tree[i : i + 2]) for i in range(0, len(tree), 2)]
    one = lambda a: [F.col(a), *([F.coalesce(f"{a}__differs", F.lit(False)).alias(f"{a}__differs")] if a in flagged else [])]
    return tree[0].select(F.col("family").alias("family_id"), *[c for a, _ in schema for c in one(a)])


def differing_cells(records: DataFrame, relations: DataFrame, attr_schema: DataFrame) -> DataFrame:
    """p3_found: cells of the wide table, of single-valued attributes, with two or more different values."""
    schema = attr_schema.select("attribute", "vtype", "is_multi_valued").orderBy("attribute").collect()  # 29 rows, fixed
    single = [r.attribute for r in schema if r.is_multi_valued is False]
    lists = any(r.vtype == "quantity_options" and r.is_multi_valued is False for r in schema)
    base = _narrow_files(cells(records, relations, attr_schema, lists), records)
    w = _combined(base, [(r.attribute, r.vtype) for r in schema], single)
    flags = F.filter(F.array(*[F.when(F.col(f"{a}__differs"), F.lit(a)) for a in single]), lambda a: a.isNotNull())
    return w.select("family_id", F.explode(flags).alias("attribute"))
