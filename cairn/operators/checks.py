"""Joins and scores that must not lose anything, and audits of programs (J-14, J-15, X-27, X-28, R-06, R-08, R-13, R-15, R-28, R-36, R-39, R-40, R-42, K-07, K-08)."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from cairn.functions import text as T


def scored_join(gold: DataFrame, predictions: DataFrame) -> DataFrame:
    """J-14: gold with predictions by id; an id that only one side has, or has twice, raises."""
    g = gold.groupBy("id").agg(F.count("*").alias("_g"), F.first("answer").alias("answer"))
    p = predictions.groupBy("id").agg(F.count("*").alias("_p"), F.first("prediction").alias("prediction"))
    j = g.join(p, "id", "full")
    ok = F.assert_true((F.coalesce("_g", F.lit(0)) == 1) & (F.coalesce("_p", F.lit(0)) == 1), F.concat(F.lit("unmatched or repeated id "), "id"))
    return j.withColumn("_ok", ok).filter(F.col("_ok").isNull()).select("id", "answer", "prediction")


def materialised(wanted: DataFrame, records: DataFrame) -> DataFrame:
    """J-15: the records of the wanted ids; an id without a record raises."""
    r = records.withColumn("_here", F.lit(True))
    j = wanted.select("record_id").distinct().join(r, "record_id", "left")
    return j.withColumn("_ok", F.assert_true(F.col("_here").isNotNull(), F.concat(F.lit("no record "), "record_id"))).filter(F.col("_ok").isNull()).drop("_here", "_ok")


def answer_score(kind: Column, gold: Column, got: Column) -> Column:
    """X-27: one score per kind of answer: count and scalar by number, bool by word, set and compare by token F1."""
    number = F.abs(T.first_number(gold) - T.first_number(got)) <= F.greatest(F.abs(T.first_number(gold)), F.lit(1.0)) * 1e-9
    word = lambda c: F.when(F.lower(c).rlike(r"^(?:yes|true|是)"), "yes").otherwise("no")
    split = lambda c: F.filter(F.transform(F.split(F.lower(c), r"[|;,]"), F.trim), lambda x: x != "")
    return F.coalesce(F.when(kind.isin("count", "scalar"), number.cast("double")).when(kind == "bool", (word(gold) == word(got)).cast("double")).otherwise(T.token_f1(split(gold), split(got))), F.lit(0.0))


@F.pandas_udf(DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """X-28: share of matching blocks of two strings; there is no such built-in function."""
    return pd.Series([difflib.SequenceMatcher(None, x or "", y or "", autojunk=False).ratio() for x, y in zip(a, b)])


def extracted(sentences: DataFrame, rules: dict[str, str]) -> DataFrame:
    """R-06: id, relation, value by one pattern per relation; the first group is the value."""
    found = F.array(*[F.struct(F.lit(r).alias("relation"), F.regexp_extract("text", p, 1).alias("value")) for r, p in rules.items()])
    return sentences.select("id", F.explode(found).alias("f")).select("id", "f.*").filter("value <> ''")


def gate(grounded: DataFrame) -> DataFrame:
    """R-08: claim, verdict: accepted with both ends in the text, rejected with none, else left to a judge."""
    return grounded.select("claim", F.when(F.col("head_in") & F.col("tail_in"), "accept").when(~F.col("head_in") & ~F.col("tail_in"), "reject").otherwise("judge").alias("verdict"))


def paired_delta(pairs: DataFrame) -> DataFrame:
    """R-13: mean of b - a and its normal interval. pairs: a, b numbers."""
    d = F.col("b").cast("double") - F.col("a").cast("double")
    s = pairs.agg(F.avg(d).alias("delta"), (F.stddev_samp(d) / F.sqrt(F.count("*").cast("double"))).alias("se"))
    return s.select("delta", (F.col("delta") - 1.96 * F.col("se")).alias("low"), (F.col("delta") + 1.96 * F.col("se")).alias("high"))


def difference_of_differences(rows: DataFrame) -> DataFrame:
    """R-36: (b - a where treated) - (b - a elsewhere). rows: treated, a, b."""
    d = F.col("b").cast("double") - F.col("a").cast("double")
    return rows.agg((F.avg(F.when(F.col("treated"), d)) - F.avg(F.when(~F.col("treated"), d))).alias("effect"))


def best_assignment(options: list[DataFrame], score: Column, most: int = 100_000) -> DataFrame:
    """R-15: the best row of the product of a few small option tables; the product's size is checked first."""
    size = 1
    for o in options:
        size *= o.count()
    if size > most:
        raise ValueError(f"{size} combinations; at most {most}")
    p = options[0]
    for o in options[1:]:
        p = p.crossJoin(F.broadcast(o))  # bounded by the check above
    return p.withColumn("score", score).orderBy(F.desc("score"), *[F.asc(c) for o in options for c in o.columns]).limit(1)


def signature(rows: DataFrame, *columns: str) -> DataFrame:
    """R-28: a hash of a result that row order does not change."""
    r = F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256)
    return rows.groupBy(r.alias("h")).agg(F.count("*").alias("n")).agg(F.bit_xor(F.xxhash64("h", "n")).alias("signature"), F.sum("n").alias("n_rows"))


def program_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """R-39: id, kind: identical, single field, several fields or structure. a, b: id, steps array<struct<function, inputs array>>."""
    x, y = a.select("id", F.col("steps").alias("s")), b.select("id", F.col("steps").alias("t"))
    j = x.join(y, "id")
    same_shape = F.transform("s", lambda p: F.concat_ws("/", p["function"], F.size(p["inputs"]))) == F.transform("t", lambda p: F.concat_ws("/", p["function"], F.size(p["inputs"])))
    args = lambda c: F.flatten(F.transform(c, lambda p: p["inputs"]))
    n = F.size(F.filter(F.zip_with(args("s"), args("t"), lambda p, q: ~p.eqNullSafe(q)), lambda z: z))
    return j.select("id", F.when(~same_shape, "structure").when(n == 0, "identical").when(n == 1, "single field").otherwise("several fields").alias("kind"))


def unknown_fields(programs: DataFrame, schema: DataFrame) -> DataFrame:
    """R-40: id, field of programs that the schema does not know. programs: id, fields; schema: field."""
    return programs.select("id", F.explode("fields").alias("field")).join(schema, "field", "left_anti")


def support_ratio(summaries: DataFrame, facts: DataFrame) -> DataFrame:
    """R-42: id, ratio: the share of a summary's words that its cited facts hold. summaries: id, text; facts: id, fact."""
    f = facts.groupBy("id").agg(F.array_distinct(F.flatten(F.collect_list(T.answer_tokens(F.col("fact"))))).alias("known"))
    w = F.array_distinct(T.answer_tokens(F.col("text")))
    j = summaries.join(f, "id", "left").withColumn("w", w)
    return j.select("id", F.coalesce(F.size(F.array_intersect("w", F.coalesce("known", F.array().cast("array<string>")))) / F.nullif(F.size("w"), F.lit(0)), F.lit(0.0)).alias("ratio"))


def finished(records: DataFrame) -> DataFrame:
    """K-07: the record ids of an answer, sorted."""
    return records.select("record_id").distinct().orderBy("record_id")


def scalar_with_support(records: DataFrame, value: Column) -> DataFrame:
    """K-08: value, record_ids: one value and the records it rests on; raises if they disagree."""
    return records.select(value.alias("v"), "record_id").agg(
        F.when(F.count_distinct("v") > 1, F.raise_error(F.lit("the records disagree")).cast("string")).otherwise(F.min("v").cast("string")).alias("value"), F.array_join(F.array_sort(F.collect_set("record_id")), "|").alias("record_ids")
    )


def path_pairs(t: DataFrame, least: int = 1) -> DataFrame:
    """R-31: r1, r2, n: two-step relation sequences per start entity, counted once per start."""
    a = t.select("head", F.col("relation").alias("r1"), F.col("tail").alias("mid")).distinct()
    b = t.select(F.col("head").alias("mid"), F.col("relation").alias("r2")).distinct()
    return a.join(b, "mid").select("head", "r1", "r2").distinct().groupBy("r1", "r2").agg(F.count("*").alias("n")).filter(F.col("n") >= least)


def generated_questions(t: DataFrame, templates: dict[str, str]) -> DataFrame:
    """R-25: question, answers from the triples of templated relations; {h} is the head."""
    out = F.lit(None).cast("string")
    for r, text in templates.items():
        out = F.when(F.col("relation") == r, F.replace(F.lit(text), F.lit("{h}"), F.col("head"))).otherwise(out)
    return t.withColumn("question", out).filter("question is not null").groupBy("question").agg(F.array_join(F.array_sort(F.collect_set("tail")), "|").alias("answers"))
