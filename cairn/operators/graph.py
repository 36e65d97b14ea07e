"""Look-ups, set algebra, walks and expansions over a table of triples (head, relation, tail, ...).

An entity set is a one-column DataFrame `entity`. Every function declares a plan; nothing is
collected. Nulls in head, relation or tail never match. Ids in comments are the inventory's.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

NUMBER = r"-?\d+(?:\.\d+)?"


# ---- look-ups: F-01..F-06
def heads_with(t: DataFrame, relation: str, tail: str) -> DataFrame:
    return t.filter((F.col("relation") == relation) & (F.col("tail") == tail)).select(F.col("head").alias("entity")).filter("entity is not null").distinct()


def tails_of(t: DataFrame, head: str, relation: str) -> DataFrame:
    return t.filter((F.col("relation") == relation) & (F.col("head") == head)).select(F.col("tail").alias("entity")).filter("entity is not null").distinct()


def all_tails(t: DataFrame, relation: str) -> DataFrame:
    return t.filter(F.col("relation") == relation).select(F.col("tail").alias("entity")).filter("entity is not null").distinct()


def distinct_tails(t: DataFrame, relation: str, limit: int = 25) -> DataFrame:
    """Tails by number of heads, then by tail, both descending; the limit is the feature."""
    g = t.filter((F.col("relation") == relation) & F.col("tail").isNotNull()).groupBy("tail").agg(F.count_distinct("head").alias("n_heads"))
    return g.filter("n_heads > 0").orderBy(F.desc("n_heads"), F.desc("tail")).limit(limit)


def find(t: DataFrame, relation: str, value: str, types: DataFrame | None = None, type_: str | None = None) -> DataFrame:
    """Heads of a value, of one entity type where given."""
    out = heads_with(t, relation, value)
    if types is not None and type_ is not None:
        out = out.join(types.filter(F.col("type") == type_).select(F.col("name").alias("entity")), "entity", "left_semi")
    return out


# ---- filtered views: F-07..F-09
def clean_name(c: Column, longest: int = 60) -> Column:
    """A usable name: of some length, not only digits or symbols, no sentence marks."""
    return c.isNotNull() & F.length(F.trim(c)).between(2, longest) & c.rlike(r"[\p{L}]") & ~c.rlike(r"[。；;!?！？\n]")


def filtered_view(t: DataFrame, sure_tiers: Sequence[str], allowed: DataFrame | None = None, relation: str | None = None) -> DataFrame:
    """Edges of clean names that are sure by tier or corroborated; one relation's tails may be limited to a list."""
    out = t.filter(clean_name(F.col("head")) & clean_name(F.col("tail")))
    out = out.filter(F.col("tier").isin(*sure_tiers) | F.coalesce("corroborated", F.lit(False)))
    if allowed is not None and relation is not None:
        ok = out.filter(F.col("relation") == relation).join(allowed.select(F.col("value").alias("tail")).distinct(), "tail", "left_semi")
        out = out.filter(F.col("relation") != relation).unionByName(ok.select(*out.columns))
    return out


def confidence_floor(t: DataFrame, floors: DataFrame, missing: float = 0.5) -> DataFrame:
    """Keeps edges whose confidence (0.5 where missing) reaches their relation's floor (0 where none is set)."""
    f = floors.groupBy("relation").agg(F.max("floor").alias("_floor"))
    return t.join(f, "relation", "left").filter(F.coalesce("confidence", F.lit(missing)) >= F.coalesce("_floor", F.lit(0.0))).drop("_floor")


# ---- constraints with aliases and equivalents: F-10, U-06..U-08
def alias_candidates(value: str, aliases: DataFrame) -> DataFrame:
    """candidate, priority: the value itself first, then its canonical forms by priority."""
    a = aliases.filter(F.col("surface") == value).select(F.col("canonical").alias("candidate"), (F.col("priority") + 1).alias("priority"))
    own = aliases.sparkSession.createDataFrame([(value, 0)], "candidate string, priority int")
    return own.unionByName(a).groupBy("candidate").agg(F.min("priority").alias("priority"))


def constraint(t: DataFrame, relation: str, value: str, aliases: DataFrame, equivalents: Sequence[Sequence[str]] = ()) -> DataFrame:
    """Heads of the first alias candidate that has any; if none has, the same through the relation's equivalents."""
    family = next((list(e) for e in equivalents if relation in e), [relation])
    ranks = {r: (0 if r == relation else 1) for r in family}
    hits = t.filter(F.col("relation").isin(*family)).join(F.broadcast(alias_candidates(value, aliases)), t["tail"] == F.col("candidate"))  # aliases of one value
    rank = F.create_map(*[x for r, k in ranks.items() for x in (F.lit(r), F.lit(k))])[F.col("relation")]
    hits = hits.select(F.col("head").alias("entity"), rank.alias("turn"), "priority").filter("entity is not null")
    first = hits.agg(F.min(F.struct("turn", "priority")).alias("f"))
    return hits.join(F.broadcast(first), (F.col("turn") == F.col("f.turn")) & (F.col("priority") == F.col("f.priority"))).select("entity").distinct()  # one row


def constrained_join(t: DataFrame, constraints: Sequence[tuple[str, str]], aliases: DataFrame, equivalents: Sequence[Sequence[str]] = ()) -> DataFrame:
    """Intersection of two or more constraints; if it is empty though each has heads, again over whole classes of equivalents."""
    if len(constraints) < 2:
        raise ValueError("a constrained join needs two constraints")
    strict = intersect(*[constraint(t, r, v, aliases, equivalents) for r, v in constraints])
    loose_parts = []
    for r, v in constraints:
        family = next((list(e) for e in equivalents if r in e), [r])
        loose_parts.append(union(*[constraint(t, x, v, aliases) for x in family]))
    loose = intersect(*loose_parts)
    none = strict.agg((F.count("*") == 0).alias("_none"))
    return strict.unionByName(loose.join(F.broadcast(none), F.col("_none")).select("entity")).distinct()  # one row


def complement(t: DataFrame, head: str, relation: str, value: str) -> DataFrame:
    """The known tails of a head with a flag whether each is the value, and whether the value is among them."""
    known = tails_of(t, head, relation)
    own = known.withColumn("is_value", F.col("entity") == value)
    return own.crossJoin(F.broadcast(own.agg(F.max("is_value").alias("value_known"))))  # one row


def dual(t: DataFrame, a: str, b: str) -> DataFrame:
    """Per relation: shared tails of two heads and those of only one."""
    own = t.filter(F.col("head").isin(a, b) & F.col("tail").isNotNull()).groupBy("relation").agg(
        F.collect_set(F.when(F.col("head") == a, F.col("tail"))).alias("x"), F.collect_set(F.when(F.col("head") == b, F.col("tail"))).alias("y")
    )
    s = lambda c: F.array_join(F.array_sort(c), "|")
    return own.select("relation", s(F.array_intersect("x", "y")).alias("same"), s(F.array_except("x", "y")).alias("only_a"), s(F.array_except("y", "x")).alias("only_b"), ((F.size("x") > 0) & (F.size(F.array_except("x", "y")) + F.size(F.array_except("y", "x")) == 0)).alias("identical"))


# ---- set algebra: U-01..U-05
def intersect(*sets: DataFrame) -> DataFrame:
    if not sets:
        raise ValueError("an intersection needs a set to take its session from")
    return reduce(lambda a, b: a.join(b.select("entity"), "entity", "left_semi"), [s.select("entity") for s in sets]).distinct()


def union(*sets: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, [s.select("entity") for s in sets]).distinct()


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("entity").join(b.select("entity"), "entity", "left_anti").distinct()


# ---- walks: J-02..J-05
def walk(t: DataFrame, start: DataFrame, chain: Sequence[str]) -> DataFrame:
    """Follows the relations from a set; "r^-1" is taken backwards."""
    at = start.select("entity")
    for step in chain:
        back = step.endswith("^-1")
        r = step[:-3].strip() if back else step
        src, dst = ("tail", "head") if back else ("head", "tail")
        e = t.filter(F.col("relation") == r).select(F.col(src).alias("entity"), F.col(dst).alias("_to")).distinct()
        at = e.join(at, "entity", "left_semi").select(F.col("_to").alias("entity")).filter("entity is not null").distinct()
    return at


def walk_trace(t: DataFrame, start: DataFrame, chain: Sequence[str]) -> DataFrame:
    """step, relation, n_edges, n_out of a walk; a step without edges is where it breaks."""
    rows = None
    at = start.select("entity")
    for k, r in enumerate(chain, 1):
        back = r.endswith("^-1")
        name = r[:-3].strip() if back else r
        src, dst = ("tail", "head") if back else ("head", "tail")
        e = t.filter(F.col("relation") == name).select(F.col(src).alias("entity"), F.col(dst).alias("_to")).distinct().join(at, "entity", "left_semi")
        row = e.agg(F.count("*").alias("n_edges"), F.count_distinct("_to").alias("n_out")).select(F.lit(k).alias("step"), F.lit(r).alias("relation"), "n_edges", "n_out")
        rows = row if rows is None else rows.unionByName(row)
        at = e.select(F.col("_to").alias("entity")).distinct()
    return rows


# ---- expansion: J-07..J-10
def k_hop(t: DataFrame, seeds: DataFrame, hops: int = 2, floor: float = 0.0, directed: bool = False) -> DataFrame:
    """head, relation, tail, hop: edges within so many hops of the seeds, each with its first hop.

    Undirected unless told otherwise; only the seeds count as visited before the first hop.
    """
    e = t.filter(F.coalesce("confidence", F.lit(0.5)) >= floor) if "confidence" in t.columns else t
    e = e.select("head", "relation", "tail").filter("head is not null and tail is not null").distinct()
    at, out = seeds.select("entity").distinct(), None
    for hop in range(1, hops + 1):
        fwd = e.join(at.withColumnRenamed("entity", "head"), "head", "left_semi").select("head", "relation", "tail", F.col("tail").alias("_n"))
        hit = fwd
        if not directed:
            hit = fwd.unionByName(e.join(at.withColumnRenamed("entity", "tail"), "tail", "left_semi").select("head", "relation", "tail", F.col("head").alias("_n")))
        rows = hit.select("head", "relation", "tail").distinct().withColumn("hop", F.lit(hop))
        out = rows if out is None else out.unionByName(rows)
        at = hit.select(F.col("_n").alias("entity")).distinct()
    return out.groupBy("head", "relation", "tail").agg(F.min("hop").alias("hop"))


def question_subgraph(t: DataFrame, topics: DataFrame, members: DataFrame, hops: int = 2, cap: int = 50) -> DataFrame:
    """Forward expansion of the topics together with the triples of at most `cap` members per mentioned concept."""
    m = members.withColumn("_k", F.row_number().over(W.partitionBy("concept").orderBy("entity"))).filter(F.col("_k") <= cap).select("entity").distinct()
    near = k_hop(t, topics, hops, directed=True).select("head", "relation", "tail")
    own = t.join(m.withColumnRenamed("entity", "head"), "head", "left_semi").select("head", "relation", "tail")
    return near.unionByName(own).distinct()


# ---- aggregation with coverage: A-01, A-02
def aggregate(t: DataFrame, over: DataFrame, attribute: str, func: str) -> DataFrame:
    """value, n_set, n_covered: the function over each entity's mean of the first numbers in its values."""
    if func not in ("avg", "sum", "max", "min", "count"):
        raise ValueError(f"no such aggregate: {func}")
    own = t.filter(F.col("relation") == attribute).select(F.col("head").alias("entity"), F.regexp_extract("tail", NUMBER, 0).try_cast("double").alias("x")).filter("x is not null").distinct()
    per = over.select("entity").distinct().join(own, "entity", "left").groupBy("entity").agg(F.avg("x").alias("v"))
    f = {"avg": F.avg("v"), "sum": F.sum("v"), "max": F.max("v"), "min": F.min("v"), "count": F.count("v").cast("double")}[func]
    return per.agg(f.alias("value"), F.count("*").alias("n_set"), F.count("v").alias("n_covered"))


# ---- quality: A-07, A-08, A-12, A-13
def conflicts(t: DataFrame, single: Sequence[str], key: Column | None = None) -> DataFrame:
    """head, relation, n_tails, tails of single-valued relations with more than one tail."""
    g = t.filter(F.col("relation").isin(*single)).withColumn("_k", F.col("tail") if key is None else key).filter("_k is not null")
    return g.groupBy("head", "relation").agg(F.count_distinct("_k").alias("n_tails"), F.array_join(F.array_sort(F.collect_set("_k")), "|").alias("tails")).filter("n_tails > 1")


def degrees(t: DataFrame) -> DataFrame:
    return t.select(F.explode(F.array("head", "tail")).alias("entity")).filter("entity is not null").groupBy("entity").agg(F.count("*").alias("degree"))


def fragments(names: DataFrame, key: Column) -> DataFrame:
    """Keys under which more than one spelling occurs."""
    return names.withColumn("_k", key).groupBy(F.col("_k").alias("key")).agg(F.count_distinct("name").alias("n_forms"), F.min("name").alias("first_form")).filter("n_forms > 1")


def self_loops(t: DataFrame) -> DataFrame:
    return t.filter(F.col("head") == F.col("tail"))


def schema_violations(t: DataFrame, schema: DataFrame) -> DataFrame:
    """relation, n, n_head_type, n_tail_type: edges whose end types the schema does not list."""
    s = schema.select(F.col("relation"), "head_types", "tail_types")
    j = t.join(s, "relation", "left")
    bad = lambda ty, allowed: F.coalesce(F.size(allowed) > 0, F.lit(False)) & ~F.coalesce(F.array_contains(allowed, ty), F.lit(False))
    return j.groupBy("relation").agg(F.count("*").alias("n"), F.count_if(bad(F.col("head_type"), F.col("head_types"))).alias("n_head_type"), F.count_if(bad(F.col("tail_type"), F.col("tail_types"))).alias("n_tail_type"))
