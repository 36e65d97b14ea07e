"""Problem 1: one common unit for a quantity that sources record in many.

Method. A reading is parsed into figures and the unit it prints (value_text, else the unit
column, else typed_value.unit). The readings of one (attribute, family) link the same entity across
the sources that use different units. Nodes of the source graph are (attribute, unit as printed); starting
from the node of unit_std alone, each round links the nodes that are not resolved yet with the medians of the
resolved ones, estimates a robust scale and offset in three views of the figure (itself, its reciprocal,
its power of ten), snaps the estimate to a known conversion and adds the node to the graph, until no node
is left that links reach.

The estimate decides. A unit's name is a prior worth `prior` links: among the conversions the estimate allows (within
`tolerance`) the one of that name is taken, and a name is believed against its links only while these are no more than `prior`.
Beyond that the links win and `how` says "contradicted". So the conversions are found with no table of names at all
(names=False): only the known factors to snap to, and unit_std, are given.

Scale. Links never pair readings: medians per (attribute, family, unit) are partial aggregates, so a family with a
third of all rows costs one row per unit. A round joins those medians with one reference per (attribute, family).
The conversions are as many as the distinct units per attribute. Rounds: the longest chain of links, usually two.

Defined results. Null or blank attribute, attribute outside attr_schema, or not a quantity: no row. No
figure anywhere: a row with empty figures. No unit anywhere: unit_key null, figures taken to be in unit_std.
`how`: "linked and named" (estimate and name agree), "linked" (no name known), "weakly linked" (fewer than `min_links`
links), "estimated" (no known conversion is near: the estimate as it is), "contradicted", "named" (nothing or too little links it),
"unresolved" (neither name nor link): figures null. Rows delivered twice: one row each (the result keeps every input row).
Tied medians: the lower one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn.functions import units as U
from cairn.session import cut

QUANTITY = ("quantity", "quantity_range", "quantity_options")


def even_name(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), r"[\s\-_]+", "")


def schema_names(attr_schema: DataFrame) -> DataFrame:
    """One row per name or alias of an attribute; first attribute wins a shared alias."""
    names = F.explode(F.array_distinct(F.concat(F.array("attribute"), F.coalesce("aliases", F.array().cast("array<string>")))))
    return (
        attr_schema.select(F.col("attribute").alias("attr"), "vtype", "unit_std", "is_multi_valued", names.alias("_name"))
        .select(even_name(F.col("_name")).alias("_name"), "attr", "vtype", "unit_std", "is_multi_valued")
        .groupBy("_name")
        .agg(F.min(F.struct("attr", "vtype", "unit_std", "is_multi_valued")).alias("_s"))
        .select("_name", "_s.*")
    )


def readings(records: DataFrame, attr_schema: DataFrame) -> DataFrame:
    """record_id, family, attr, vtype, unit_std, unit_key1, unit_key2, figures of every quantity row."""
    r = records.select("record_id", "family_id", "attribute", "typed_value", "unit", "value_text")
    r = r.withColumn("_name", even_name(F.col("attribute")))
    r = r.join(schema_names(attr_schema).filter(F.col("vtype").isin(*QUANTITY)), "_name")
    tv = F.col("typed_value")
    text = F.when(F.col("value_text").rlike(r"\d"), F.col("value_text")).when(F.coalesce(tv["kind"], F.lit("text")).isin("text"), tv["text"])
    r = r.withColumn("_p", F.when(text.rlike(r"\d"), F.filter(U.figure_parts(text), lambda p: p.rlike(r"\d"))))
    r = r.withColumn("_p", F.when(F.size("_p") > 0, F.col("_p")))
    r = r.withColumn("_n", F.transform("_p", U.part_number)).withColumn("_u", F.transform("_p", U.part_unit))
    # an end of a span or list that prints no unit takes the last one printed
    last = F.element_at(F.filter("_u", lambda u: u != ""), -1)
    r = r.withColumn("_last", F.when(F.exists("_u", lambda u: u != ""), last))
    spare = F.coalesce(U.unit_key(U.even_scales(F.col("unit"))), U.unit_key(U.even_scales(tv["unit"])))
    has = F.col("_p").isNotNull()
    typed = (
        F.when(tv["kind"] == "options", tv["options"])
        .when(tv["kind"] == "range", F.array(tv["lower"], tv["upper"]))
        .otherwise(F.array(F.coalesce(tv["value"], tv["lower"], tv["upper"])))
    )
    figures = F.filter(F.when(has, F.col("_n")).otherwise(typed), lambda x: x.isNotNull() & ~F.isnan(x))
    figures = F.when(F.col("vtype") == "quantity", F.slice(figures, 1, 1)).when(F.col("vtype") == "quantity_range", F.slice(figures, 1, 2)).otherwise(figures)
    k1 = F.coalesce(F.when(has, U.unit_key(F.coalesce(F.nullif(F.get("_u", F.lit(0)), F.lit("")), F.col("_last")))), spare)
    k2 = F.coalesce(F.when(has & (F.col("vtype") != "quantity"), U.unit_key(F.coalesce(F.nullif(F.get("_u", F.lit(1)), F.lit("")), F.col("_last")))), F.when(~has, spare), k1)
    return r.select(
        "record_id", F.lower(F.trim("family_id")).alias("family"), "attr", "vtype", "unit_std", "is_multi_valued", "unit", "value_text",
        F.coalesce(figures, F.array().cast("array<double>")).alias("figures"), k1.alias("unit_key1"), k2.alias("unit_key2"),
    )


def _fit(links: DataFrame, snaps: DataFrame, named: DataFrame, prior: int, min_links: int, tolerance: float) -> DataFrame:
    """One row per linked node: the conversion that estimate and prior give. links: attr, unit_key, m (own median), y (in unit_std)."""
    views = F.explode(F.array(*[F.struct(F.lit(v).alias("view"), U.apply_view(F.lit(v), F.col("m")).alias("v")) for v in ("id", "recip", "pow10")]))
    thirds = lambda c: F.percentile_approx(c, F.array(F.lit(0.2), F.lit(0.5), F.lit(0.8)), 1000)
    est = (
        links.select("attr", "unit_key", "y", views.alias("_w")).select("attr", "unit_key", "y", "_w.*").filter(F.col("v").isNotNull())
        .groupBy("attr", "unit_key", "view")
        .agg(
            F.count("*").alias("links"), thirds("y").alias("qy"), thirds("v").alias("qv"), thirds(F.col("y") - F.col("v")).alias("d"),
            thirds(F.when((F.col("y") > 0) & (F.col("v") > 0), F.log(F.col("y") / F.col("v")))).alias("lr"),
        )
    )
    ratio, spread = F.exp(F.col("lr")[1]), F.col("lr")[2] - F.col("lr")[0]
    # how far a known conversion is from the estimate: by the ratio where it is a factor, at three quantiles where it has an offset
    at = lambda i: F.abs(F.col("qv")[i] * F.col("k_scale") + F.col("k_offset") - F.col("qy")[i])
    span = F.greatest(F.abs(F.col("qy")[2] - F.col("qy")[0]), F.lit(1e-9))
    by_offset = F.abs(F.col("d")[1] - F.col("k_offset")) / F.greatest(F.abs(F.col("k_offset")), F.lit(1.0))
    dist = F.when(F.col("k_offset") == 0, F.coalesce(F.abs(F.log(ratio / F.col("k_scale"))), F.when(F.col("k_scale") == 1, F.abs(F.col("d")[1]) / span))).when(F.col("k_scale") == 1, by_offset).otherwise((at(0) + at(1) + at(2)) / (3 * span))
    n = named.select("attr", "unit_key", "view", F.col("scale").alias("k_scale"), F.col("offset").alias("k_offset"), F.col("unit_name").alias("snap"), F.lit(True).alias("is_named"))
    options = est.join(snaps, ["attr", "view"]).withColumn("is_named", F.lit(False)).unionByName(est.join(n, ["attr", "unit_key", "view"]))
    options = options.withColumn("dist", dist).filter(F.col("dist").isNotNull() & ~F.isnan("dist"))
    # the printed name first among those the estimate allows; then the nearest in the view in which the links agree best
    blur = F.col("dist") + F.when(F.col("k_offset") == 0, F.coalesce(spread, F.lit(0.0)) / 2).otherwise(0.0)
    order = F.struct(F.when(F.col("is_named") & (F.col("dist") <= tolerance), 0).otherwise(1), blur, "snap")
    chosen = F.struct("view", F.col("k_scale").alias("scale"), F.col("k_offset").alias("offset"), ratio.alias("est_scale"), F.col("d")[1].alias("est_offset"), "links", "snap", "dist", "is_named")
    best = options.groupBy("attr", "unit_key").agg(F.min_by(chosen, order).alias("_b")).select("attr", "unit_key", "_b.*")
    own = named.select("attr", "unit_key", F.col("view").alias("n_view"), F.col("scale").alias("n_scale"), F.col("offset").alias("n_offset"), "unit_name")
    best = best.join(own, ["attr", "unit_key"], "left")
    near, has_name = F.col("dist") <= tolerance, F.col("n_view").isNotNull()
    how = (
        F.when(F.col("is_named") & near, "linked and named")
        .when(has_name & (~near | (F.col("links") <= prior)), "named")
        .when(has_name, "contradicted")
        .when(~near, "estimated").when(F.col("links") < min_links, "weakly linked").otherwise("linked")
    )
    by_name, raw = F.col("how") == "named", (F.col("how") == "estimated") & F.col("est_scale").isNotNull() & ~F.isnan("est_scale")
    pick = lambda c, other: F.when(by_name, F.col(f"n_{c}")).when(raw, other).otherwise(F.col(c)).alias(c)
    return best.withColumn("how", how).select(
        "attr", "unit_key", pick("view", F.col("view")), pick("scale", F.col("est_scale")), pick("offset", F.lit(0.0)), "est_scale", "est_offset", "links",
        F.when(by_name, F.col("unit_name")).when(~raw, F.col("snap")).alias("snap"), "how",
    )


_SOLVED = "attr string, unit_key string, view string, scale double, offset double, est_scale double, est_offset double, links long, snap string, how string"


def conversions(obs: DataFrame, attr_schema: DataFrame, prior: int = 20, min_links: int = 5, tolerance: float = 0.06, names: bool = True) -> DataFrame:
    """attr, unit_key -> view, scale, offset to unit_std, estimate, links, how.

    obs: attr, family, unit_key, x (first figure). prior: links a printed known name is worth. names=False: no name is
    known but the attribute's own unit_std.
    """
    spark = obs.sparkSession
    targets = [(r.attribute, r.unit_std) for r in attr_schema.filter(F.col("vtype").isin(*QUANTITY) & F.col("unit_std").isNotNull()).select("attribute", "unit_std").collect()]  # a schema's rows
    known = [(attr, *c) for attr, unit in targets for c in U.conversions_to(unit)]  # at most 60 names per attribute
    rel = F.broadcast(spark.createDataFrame(known if names else [], "attr string, _b string, unit_name string, view string, scale double, offset double"))
    med = cut(obs.groupBy("attr", "family", "unit_key").agg(F.percentile_approx("x", 0.5, 1000).alias("m"), F.count("*").alias("n")))
    factor, bare = U.scale_split(F.col("unit_key"))
    nodes = med.groupBy("attr", "unit_key").agg(F.sum("n").alias("readings")).withColumn("_f", factor).withColumn("_b", bare)
    nodes = cut(nodes.join(rel, ["attr", "_b"], "left").select("attr", "unit_key", "readings", "unit_name", "view", (F.col("scale") * F.col("_f")).alias("scale"), "offset"))
    named = nodes.filter(F.col("view").isNotNull())
    # known conversions that an estimate may snap to, scaled multiples included; one name for each
    marks, snap_of = {"": 1.0, **U._SCALES}, {}
    for attr, _, name, view, scale, offset in sorted(known):
        for m, by in marks.items():
            if m == "" or (view == "id" and offset == 0):
                key = (attr, view, float(f"{scale * by:.9g}"), offset)
                snap_of[key] = min((len(m), name, m + name, scale * by), snap_of.get(key, (9,)))
    snaps = F.broadcast(spark.createDataFrame([(a, v, x[2], x[3], o) for (a, v, _, o), x in sorted(snap_of.items())], "attr string, view string, snap string, k_scale double, k_offset double"))
    start = [(attr, U.key_of(unit), "id", 1.0, 0.0, 1.0, 0.0, 0, unit, "unit_std") for attr, unit in targets]
    solved = spark.createDataFrame(start, _SOLVED)
    fields = T.StructType.fromDDL(_SOLVED)
    while True:
        ref = (
            med.join(solved.select("attr", "unit_key", "view", "scale", "offset"), ["attr", "unit_key"])
            .withColumn("y", U.apply_view(F.col("view"), F.col("m")) * F.col("scale") + F.col("offset"))
            .groupBy("attr", "family").agg(F.percentile_approx("y", 0.5, 1000).alias("y"))
        )
        links = med.join(solved.select("attr", "unit_key"), ["attr", "unit_key"], "left_anti").join(ref.filter(F.col("y").isNotNull()), ["attr", "family"])
        fresh = cut(_fit(links, snaps, named, prior, min_links, tolerance))
        n_strong, n_any = fresh.agg(F.count_if(F.col("links") >= min_links), F.count("*")).first()
        if n_strong:  # what few links reach may have more of them in the next round
            fresh = fresh.filter(F.col("links") >= min_links)
        elif not n_any:  # nothing links these to what is resolved: a known name joins the graph as it is
            alone = named.join(solved.select("attr", "unit_key"), ["attr", "unit_key"], "left_anti")
            nothing = [F.lit(None).cast("double").alias(c) for c in ("est_scale", "est_offset")]
            fresh = alone.select("attr", "unit_key", "view", "scale", "offset", *nothing, F.lit(0).cast("long").alias("links"), F.col("unit_name").alias("snap"), F.lit("named").alias("how"))
            fresh = cut(fresh)
            if fresh.isEmpty():
                break
        solved = cut(solved.unionByName(fresh.to(fields)))
        if nodes.join(solved, ["attr", "unit_key"], "left_anti").isEmpty():
            break
    out = nodes.select("attr", "unit_key", "readings").join(solved, ["attr", "unit_key"], "left")
    return out.select("attr", "unit_key", "readings", F.coalesce("how", F.lit("unresolved")).alias("how"), "view", "scale", "offset", "est_scale", "est_offset", F.coalesce("links", F.lit(0)).alias("links"), "snap")


def first_figures(r: DataFrame) -> DataFrame:
    """attr, family, unit_key, x for the links; a unit that only a second end prints is a node without figures."""
    first = r.filter(F.col("unit_key1").isNotNull() & (F.size("figures") > 0)).select("attr", "family", F.col("unit_key1").alias("unit_key"), F.col("figures")[0].alias("x"))
    second = r.filter((F.col("unit_key2") != F.col("unit_key1")) & (F.size("figures") > 1)).select("attr", "family", F.col("unit_key2").alias("unit_key"), F.lit(None).cast("double").alias("x"))
    return first.unionByName(second)


def harmonise(records: DataFrame, attr_schema: DataFrame, names: bool = True) -> DataFrame:
    """Every quantity reading with its figures in unit_std (column std, array<double>) and `changed`."""
    r = cut(readings(records, attr_schema))  # read twice: by the links and by the conversion
    obs = first_figures(r)
    conv = conversions(obs, attr_schema, names=names)
    side = lambda i: conv.select("attr", F.col("unit_key").alias(f"unit_key{i}"), *[F.col(c).alias(f"{c}{i}") for c in ("view", "scale", "offset", "how")])
    r = r.join(side(1), ["attr", "unit_key1"], "left").join(side(2), ["attr", "unit_key2"], "left")

    def to_std(x: Column, i: Column) -> Column:
        one = lambda k: F.when(F.col(f"unit_key{k}").isNull(), x).otherwise(U.apply_view(F.col(f"view{k}"), x) * F.col(f"scale{k}") + F.col(f"offset{k}"))
        return F.when(i == 0, one(1)).otherwise(one(2))

    moved = lambda k: F.coalesce((F.col(f"view{k}") != "id") | (F.abs(F.col(f"scale{k}") - 1) > 1e-9) | (F.abs(F.col(f"offset{k}")) > 1e-9), F.lit(False))
    changed = (F.size("figures") > 0) & (moved(1) | (F.size("figures") > 1) & moved(2))
    return r.select(
        "record_id", "family", "attr", "vtype", "unit_std", "is_multi_valued", "unit_key1", "unit_key2", "figures",
        F.transform("figures", to_std).alias("std"), changed.alias("changed"), F.coalesce("how1", F.lit("no unit")).alias("how"),
    )


def records_to_change(records: DataFrame, attr_schema: DataFrame) -> DataFrame:
    """p1_found: record_id of quantity readings whose figure has to change to be in unit_std."""
    return harmonise(records, attr_schema).filter("changed").select("record_id").filter(F.col("record_id").isNotNull()).distinct()
