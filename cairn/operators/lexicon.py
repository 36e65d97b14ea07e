"""Aliases, value types, normalisers and substitutions (X-01..X-07, X-36, W-10, R-24, R-41)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from cairn.functions import text as T


def alias_index(entries: DataFrame) -> DataFrame:
    """X-03: surface -> canonical, type; the first entry of a spelling wins, lower case is a spelling too. entries: canonical, type, surfaces, place."""
    e = entries.select("canonical", "type", "place", F.posexplode(F.array_distinct(F.concat(F.array("canonical"), F.coalesce("surfaces", F.array().cast("array<string>"))))).alias("k", "s"))
    both = e.select("canonical", "type", "place", "k", F.explode(F.array(F.struct(F.lit(0).alias("low"), F.col("s").alias("surface")), F.struct(F.lit(1).alias("low"), F.lower("s").alias("surface")))).alias("x"))
    return both.select("canonical", "type", "place", "k", "x.*").filter("surface is not null and surface <> ''").groupBy("surface").agg(F.min(F.struct("low", "place", "k", "canonical", "type")).alias("m")).select("surface", "m.canonical", "m.type")


def expansions(values: DataFrame, index: DataFrame, suffixes: Sequence[str]) -> DataFrame:
    """X-01: value, candidate, priority: the value, its canonical form, the value without a suffix and that one's canonical form."""
    strip = F.lit(None).cast("string")
    for s in reversed(suffixes):
        strip = F.when(F.endswith("value", F.lit(s)) & (F.length("value") > len(s)), F.substr("value", F.lit(1), F.length("value") - len(s))).otherwise(strip)
    v = values.select("value").distinct().withColumn("bare", strip)
    i = index.select("surface", "canonical")
    parts = [
        v.select("value", F.col("value").alias("candidate"), F.lit(0).alias("priority")),
        v.join(i, F.col("value") == F.col("surface")).select("value", F.col("canonical").alias("candidate"), F.lit(1).alias("priority")),
        v.filter("bare is not null").select("value", F.col("bare").alias("candidate"), F.lit(2).alias("priority")),
        v.join(i, F.col("bare") == F.col("surface")).select("value", F.col("canonical").alias("candidate"), F.lit(3).alias("priority")),
    ]
    u = parts[0]
    for p in parts[1:]:
        u = u.unionByName(p)
    return u.groupBy("value", "candidate").agg(F.min("priority").alias("priority"))


def value_types(values: DataFrame, index: DataFrame) -> DataFrame:
    """X-02: value, types: all types of a value, by name and by shape."""
    named = values.join(index, values["value"] == index["surface"]).select("value", "type")
    shape = F.when(F.col("value").rlike(r"^(?:19|20)\d{2}$"), "year").when(F.col("value").rlike(r"^-?\d"), "quantity").when(T.designation(F.col("value")) != "", "system")
    shaped = values.select("value", shape.alias("type")).filter("type is not null")
    return named.unionByName(shaped).groupBy("value").agg(F.array_join(F.array_sort(F.collect_set("type")), "|").alias("types"))


def relations_of(words: DataFrame, keywords: DataFrame) -> DataFrame:
    """X-04: word, relations whose keywords hold it. keywords: relation, keywords."""
    k = keywords.select("relation", F.explode("keywords").alias("word"))
    return words.join(k, "word").groupBy("word").agg(F.array_join(F.array_sort(F.collect_set("relation")), "|").alias("relations"))


def normalised(t: DataFrame, rules: dict[str, dict[str, str]]) -> DataFrame:
    """X-06: tails replaced by a map for their relation, others trimmed and with single spaces."""
    out = F.trim(F.regexp_replace("tail", r"\s+", " "))
    for relation, m in rules.items():
        for a, b in m.items():
            out = F.when((F.col("relation") == relation) & (F.lower(F.trim("tail")) == a.lower()), F.lit(b)).otherwise(out)
    return t.withColumn("tail", out)


def best_form(names: DataFrame, key: Column) -> DataFrame:
    """X-07: key, form: the spelling with most hyphens, then the longest, then the last by name."""
    hyphens = F.length("name") - F.length(F.replace("name", F.lit("-"), F.lit("")))
    return names.withColumn("key", key).groupBy("key").agg(F.max_by("name", F.struct(hyphens, F.length("name"), F.col("name"))).alias("form"))


def longest_alias(texts: DataFrame, index: DataFrame, small: int = 100_000) -> DataFrame:
    """W-10: id, surface, canonical of the longest alias in each text, by whole words: aliases meet texts at their first word.

    An index of up to `small` aliases is broadcast and texts stay where they are; beyond that the words of the texts travel
    to the aliases with a hash of the text in place of the text, and what they meet goes back to it.
    """
    words = lambda c: F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}]+"), 0)
    spaced = lambda w: F.concat(F.lit(" "), F.array_join(w, " "), F.lit(" "))
    i = index.withColumn("_w", words("surface")).filter(F.size("_w") > 0).withColumn("w", F.get("_w", F.lit(0))).withColumn("_s", spaced(F.col("_w"))).select("w", "_s", "surface", "canonical")
    t = texts.select("id", words("text").alias("_w"))
    if index.limit(small + 1).count() <= small:
        t = t.select("id", "_w", F.explode(F.array_distinct("_w")).alias("w"))
        hit = t.join(F.broadcast(i), "w").filter(F.contains(spaced(F.col("_w")), "_s"))  # size checked above
    else:
        t = t.withColumn("_h", F.xxhash64("_w"))
        met = t.select("id", "_h", F.explode(F.array_distinct("_w")).alias("w")).join(i, "w").select(F.col("id").alias("_id"), F.col("_h").alias("_g"), "_s", "surface", "canonical").distinct()
        hit = t.join(met, F.col("id").eqNullSafe(F.col("_id")) & (F.col("_h") == F.col("_g"))).filter(F.contains(spaced(F.col("_w")), "_s"))
    best = F.min(F.struct(-F.length("surface"), "surface", "canonical")).alias("m")
    return hit.groupBy("id").agg(best).select("id", "m.surface", "m.canonical")


def substitutes(wanted: DataFrame, schema: DataFrame, usage: DataFrame, least: int = 1) -> DataFrame:
    """X-36: relation, substitute: for a relation that does not take the value's type the most used one that does.

    wanted: relation, type; schema: relation, tail_types; usage: relation, n. A relation that fits stays.
    """
    fits = schema.select(F.col("relation").alias("candidate"), F.explode("tail_types").alias("type")).join(usage.withColumnRenamed("relation", "candidate"), "candidate").filter(F.col("n") >= least)
    own = wanted.join(schema, "relation", "left").withColumn("ok", F.coalesce(F.array_contains("tail_types", F.col("type")), F.lit(False)))
    best = fits.groupBy("type").agg(F.max_by("candidate", F.struct("n", "candidate")).alias("best"))
    return own.join(best, "type", "left").select("relation", "type", F.when(F.col("ok"), F.col("relation")).otherwise(F.coalesce("best", "relation")).alias("substitute"))


def routed(questions: DataFrame, strategies: dict[str, str], default: str = "lookup") -> DataFrame:
    """R-24: id, strategy by the question's stated type."""
    out = F.lit(default)
    for k, v in strategies.items():
        out = F.when(F.col("type") == k, F.lit(v)).otherwise(out)
    return questions.select("id", out.alias("strategy"))


def accepted(t: DataFrame, relations: Sequence[str], floor: float, canonical: DataFrame) -> DataFrame:
    """R-41: edges of listed relations, sure enough, whose tail is a canonical value."""
    return t.filter(F.col("relation").isin(*relations) & (F.col("confidence") >= floor)).join(canonical.select(F.col("value").alias("tail")).distinct(), "tail", "left_semi")


def domain(t: DataFrame, by_source: dict[str, str], platform_relation: str) -> DataFrame:
    """R-11: head, domain: by its source if that tells, else by the class of its platforms."""
    src = F.lit(None).cast("string")
    for k, v in by_source.items():
        src = F.when(F.col("source") == k, F.lit(v)).otherwise(src)
    g = t.groupBy("head").agg(F.min(src).alias("s"), F.min(F.when(F.col("relation") == platform_relation, T.platform_class(F.col("tail")))).alias("p"))
    return g.select("head", F.coalesce("s", "p", F.lit("unknown")).alias("domain"))
