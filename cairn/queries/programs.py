"""Queries of the qualified-fact programs (E4) and the typed-table engine (E5) over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairn.plans import table_program as P
from cairn.plans.kopl import KB
from cairn.queries.registry import Registry
from cairn.session import table
from cairn.sources import readers

q = Registry()


def kb(spark, d) -> KB:
    """Suppliers and nations as entities; balances and order years as attributes; supplies and locations as relations."""
    s, n, r, o, c = (table(spark, d, x) for x in ("supplier", "nation", "region", "orders", "customer"))
    ent = s.select(F.concat(F.lit("s"), "s_suppkey").alias("entity_id"), F.col("s_name").alias("name"))
    ent = ent.unionByName(n.select(F.concat(F.lit("n"), "n_nationkey").alias("entity_id"), F.col("n_name").alias("name")))
    ent = ent.unionByName(c.select(F.concat(F.lit("c"), "c_custkey").alias("entity_id"), F.col("c_name").alias("name")))
    con = spark.createDataFrame([("party", "party", None), ("sup", "supplier", "party"), ("cus", "customer", "party"), ("nat", "nation", None), ("europe", "NATION_3", None)], "concept_id string, name string, parent_id string")
    kind = F.when(F.startswith("entity_id", F.lit("s")), "sup").when(F.startswith("entity_id", F.lit("n")), "nat").otherwise("cus")
    none = F.lit(None).cast("string")
    q0 = F.create_map(F.lit("segment"), F.col("c_mktsegment"))
    att = c.select(F.concat(F.lit("b"), "c_custkey").alias("fact_id"), F.concat(F.lit("c"), "c_custkey").alias("entity_id"), F.lit("balance").alias("key"), F.lit("quantity").alias("vtype"), none.alias("vstr"), F.col("c_acctbal").alias("vnum"), F.lit("USD").alias("unit"), q0.alias("qualifiers"))
    att = att.unionByName(s.select(F.concat(F.lit("a"), "s_suppkey"), F.concat(F.lit("s"), "s_suppkey"), F.lit("balance"), F.lit("quantity"), none, F.col("s_acctbal"), F.lit("USD"), F.create_map(F.lit("nation"), F.col("s_nationkey").cast("string"))).toDF(*att.columns))
    att = att.unionByName(n.select(F.concat(F.lit("r"), "n_nationkey"), F.concat(F.lit("n"), "n_nationkey"), F.lit("region"), F.lit("string"), F.col("n_regionkey").cast("string"), F.lit(None).cast("double"), none, F.create_map(F.lit("x"), F.lit("y"))).toDF(*att.columns))
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    att = att.unionByName(o.select(F.concat(F.lit("o"), "o_orderkey"), F.concat(F.lit("c"), "o_custkey"), F.lit("ordered"), F.lit("date"), day, F.lit(None).cast("double"), none, F.create_map(F.lit("priority"), F.col("o_orderpriority"), F.lit("price"), F.concat(F.floor("o_totalprice").cast("string"), F.lit(" USD")), F.lit("date"), day)).toDF(*att.columns))
    rel = s.select(F.concat(F.lit("l"), "s_suppkey").alias("fact_id"), F.concat(F.lit("s"), "s_suppkey").alias("subject"), F.lit("located in").alias("predicate"), F.concat(F.lit("n"), "s_nationkey").alias("object"), F.create_map(F.lit("since"), F.concat(F.lit("19"), F.lpad((F.col("s_suppkey") % 100).cast("string"), 2, "0"))).alias("qualifiers"))
    rel = rel.unionByName(c.select(F.concat(F.lit("m"), "c_custkey"), F.concat(F.lit("c"), "c_custkey"), F.lit("citizen of"), F.concat(F.lit("n"), "c_nationkey"), F.create_map(F.lit("segment"), F.col("c_mktsegment"))).toDF(*rel.columns))
    return KB(ent, con, ent.select("entity_id", kind.alias("concept_id")), att, rel)


def S(function, *inputs):
    return {"function": function, "inputs": list(inputs)}


def program(name, sql, *steps):
    @q(name, sql)
    def _(spark, d):
        return kb(spark, d).run(list(steps)).select("value")


N = "SELECT count(DISTINCT {}) AS value FROM {}"
program("f18_findall_count", "SELECT (SELECT count(*) FROM supplier) + (SELECT count(*) FROM nation) + (SELECT count(*) FROM customer) AS value", S("FindAll"), S("Count"))
program("f18_find_shared_name", "SELECT 2::BIGINT AS value", S("Find", "NATION_3"), S("Count"))
program("f19_filter_concept", "SELECT (SELECT count(*) FROM supplier) + (SELECT count(*) FROM customer) AS value", S("FindAll"), S("FilterConcept", "party"), S("Count"))
program("f20_filter_str", "SELECT count(*) AS value FROM nation WHERE n_regionkey = 2", S("FindAll"), S("FilterStr", "region", "2"), S("Count"))
program("f20_filter_num", "SELECT (SELECT count(*) FROM supplier WHERE s_acctbal > 5000) + (SELECT count(*) FROM customer WHERE c_acctbal > 5000) AS value", S("FindAll"), S("FilterNum", "balance", "5000 USD", ">"), S("Count"))
program("f20_filter_num_unit", "SELECT 0::BIGINT AS value", S("FindAll"), S("FilterNum", "balance", "5000 EUR", ">"), S("Count"))
program("f20_filter_year", "SELECT count(DISTINCT o_custkey) AS value FROM orders WHERE year(o_orderdate) = 1997", S("FindAll"), S("FilterYear", "ordered", "1997", "="), S("Count"))
program("f20_filter_date", "SELECT count(DISTINCT o_custkey) AS value FROM orders WHERE o_orderdate < '1992-03-01'", S("FindAll"), S("FilterDate", "ordered", "1992-03-01", "<"), S("Count"))
program("f21_qfilter_str", "SELECT count(DISTINCT o_custkey) AS value FROM orders WHERE year(o_orderdate) > 1997 AND o_orderpriority = '1-URGENT'", S("FindAll"), S("FilterYear", "ordered", "1997", ">"), S("QFilterStr", "priority", "1-URGENT"), S("Count"))
program("f21_qfilter_num", "SELECT count(DISTINCT o_custkey) AS value FROM orders WHERE year(o_orderdate) = 1995 AND floor(o_totalprice) > 400000", S("FindAll"), S("FilterYear", "ordered", "1995", "="), S("QFilterNum", "price", "400000 USD", ">"), S("Count"))
program("f21_qfilter_year", "SELECT count(*) AS value FROM (SELECT DISTINCT s_nationkey FROM supplier WHERE s_suppkey % 100 < 40)", S("FindAll"), S("FilterConcept", "supplier"), S("Relate", "located in", "forward"), S("QFilterYear", "since", "1940", "<"), S("Count"))
program("f21_qfilter_date", "SELECT count(DISTINCT o_custkey) AS value FROM orders WHERE o_orderdate >= '1998-07-01' AND year(o_orderdate) = 1998", S("FindAll"), S("FilterYear", "ordered", "1998", "="), S("QFilterDate", "date", "1998-06-30", ">"), S("Count"))
program("j05_relate_backward", "SELECT count(*) AS value FROM supplier WHERE s_nationkey = 7", S("Find", "NATION_7"), S("Relate", "located in", "backward"), S("Count"))
program("j06_query_relation", "SELECT min('located in') AS value FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_suppkey = 1", S("Find", "Supplier#000000001"), S("Find", "Supplier#000000001"), S("Relate", "located in", "forward"), S("QueryRelation"))
program("u05_and", "SELECT count(*) AS value FROM customer WHERE c_nationkey = 7 AND c_acctbal > 1000", S("Find", "NATION_7"), S("Relate", "citizen of", "backward"), S("FindAll"), S("FilterNum", "balance", "1000 USD", ">"), S("And"), S("Count"))
program("u05_or", "SELECT count(*) AS value FROM customer WHERE c_nationkey IN (7, 8)", S("Find", "NATION_7"), S("Relate", "citizen of", "backward"), S("Find", "NATION_8"), S("Relate", "citizen of", "backward"), S("Or"), S("Count"))
program("k01_what", "SELECT 'NATION_' || s_nationkey AS value FROM supplier WHERE s_suppkey = 4", S("Find", "Supplier#000000004"), S("Relate", "located in", "forward"), S("What"))
program("a03_count", "SELECT count(DISTINCT s_nationkey) AS value FROM supplier", S("FindAll"), S("FilterConcept", "supplier"), S("Relate", "located in", "forward"), S("Count"))
program("w08_select_among", "SELECT max_by(c_name, c_acctbal) AS value FROM customer WHERE c_nationkey = 7", S("Find", "NATION_7"), S("Relate", "citizen of", "backward"), S("SelectAmong", "balance", "largest"))
program("w08_select_between", "SELECT min_by(s_name, s_acctbal) AS value FROM supplier WHERE s_suppkey IN (1, 2)", S("Find", "Supplier#000000001"), S("Find", "Supplier#000000002"), S("SelectBetween", "balance", "less"))
program("k02_query_attr", "SELECT CASE WHEN s_acctbal = floor(s_acctbal) THEN CAST(CAST(s_acctbal AS BIGINT) AS VARCHAR) ELSE CAST(s_acctbal AS VARCHAR) END || ' USD' AS value FROM supplier WHERE s_suppkey = 2", S("Find", "Supplier#000000002"), S("QueryAttr", "balance"))
program("k03_query_attr_condition", "SELECT max(CASE WHEN c_acctbal = floor(c_acctbal) THEN CAST(CAST(c_acctbal AS BIGINT) AS VARCHAR) ELSE CAST(c_acctbal AS VARCHAR) END || ' USD') AS value FROM customer WHERE c_custkey = 1 AND c_mktsegment = 'MACHINERY'", S("Find", "Customer#000000001"), S("QueryAttrUnderCondition", "balance", "segment", "MACHINERY"))
program("k04_verify_num", "SELECT CASE WHEN s_acctbal > 1000 THEN 'yes' ELSE 'no' END AS value FROM supplier WHERE s_suppkey = 2", S("Find", "Supplier#000000002"), S("QueryAttr", "balance"), S("VerifyNum", "1000 USD", ">"))
program("k04_verify_str", "SELECT CASE WHEN n_regionkey = 3 THEN 'yes' ELSE 'no' END AS value FROM nation WHERE n_nationkey = 8", S("Find", "NATION_8"), S("QueryAttr", "region"), S("VerifyStr", "3"))
program("k04_verify_year", "SELECT CASE WHEN 1900 + s_suppkey % 100 = 1904 THEN 'yes' ELSE 'no' END AS value FROM supplier WHERE s_suppkey = 4", S("Find", "Supplier#000000004"), S("Find", "Supplier#000000004"), S("Relate", "located in", "forward"), S("QueryRelationQualifier", "located in", "since"), S("VerifyYear", "1904", "="))
program("k04_verify_date", "SELECT CASE WHEN strftime(o_orderdate, '%Y-%m-%d') > '1995-01-01' THEN 'yes' ELSE 'no' END AS value FROM orders WHERE o_custkey = 1 ORDER BY 'o' || o_orderkey LIMIT 1", S("Find", "Customer#000000001"), S("QueryAttr", "ordered"), S("VerifyDate", "1995-01-01", ">"))
program("k05_attr_qualifier", "SELECT max(c_mktsegment) AS value FROM customer WHERE c_custkey = 1 AND c_acctbal = 2547.4", S("Find", "Customer#000000001"), S("QueryAttrQualifier", "balance", "2547.4 USD", "segment"))
program("k06_relation_qualifier", "SELECT '19' || lpad(CAST(s_suppkey % 100 AS VARCHAR), 2, '0') AS value FROM supplier WHERE s_suppkey = 4", S("Find", "Supplier#000000004"), S("Find", "Supplier#000000004"), S("Relate", "located in", "forward"), S("QueryRelationQualifier", "located in", "since"))


@q("s05_kb_triples", "SELECT (SELECT count(*) FROM supplier) * 2 + (SELECT count(*) FROM customer) * 2 + (SELECT count(DISTINCT s_name || n_name) FROM supplier JOIN nation ON s_nationkey = n_nationkey) * 0 + (SELECT count(*) FROM nation) AS n")
def _(spark, d):
    k = kb(spark, d)
    t = readers.kopl_triples(k.entities, k.attr_facts.filter("key = 'region'"), k.rel_facts, k.entity_concepts.filter("concept_id <> 'nat'"), k.concepts)
    return t.agg(F.count("*").alias("n"))


# ---- the typed-table engine
HERTZ = ["Hz", "kHz", "MHz", "GHz"]


def numbers_in(units, *kinds):
    """Guards: later predicates of the conjunction are reached only for these kinds and units."""
    return [P.Predicate("typed_value.kind", "in", kinds or ("number",)), P.Predicate("typed_value.unit", "in", units)]


def readings(spark, d):
    return table(spark, d, "typed_records").dropDuplicates(["record_id"])


BASE = "WITH t AS (SELECT DISTINCT ON (record_id) * FROM typed_records)"
HZ = "(CASE typed_value.unit WHEN 'kHz' THEN 1e3 WHEN 'MHz' THEN 1e6 WHEN 'GHz' THEN 1e9 ELSE 1 END)"
IS_HZ = "typed_value.unit IN ('Hz', 'kHz', 'MHz', 'GHz')"


@q("f11_scan", f"{BASE} SELECT lower(trim(family_id)) AS family, attribute, count(*) AS n FROM t WHERE component = 'transmitter' AND attribute IN ('prf', 'peak_power') GROUP BY 1, 2")
def _(spark, d):
    s = P.scan(readings(spark, d), components=["transmitter"], attributes=["prf", "peak_power"])
    return s.groupBy(F.lower(F.trim("family_id")).alias("family"), "attribute").agg(F.count("*").alias("n"))


@q("f11_scan_subjects", f"{BASE} SELECT x.s AS subject, count(*) AS n FROM t, unnest(subjects) AS x(s) WHERE attribute = 'prf' GROUP BY 1")
def _(spark, d):
    return P.scan(readings(spark, d), attributes=["prf"], explode_subjects=True).groupBy("subject").agg(F.count("*").alias("n"))


@q("f12_filter_number", f"{BASE} SELECT record_id FROM t WHERE attribute = 'carrier_frequency' AND typed_value.kind = 'number' AND {IS_HZ} AND typed_value.value * {HZ} > 5e9")
def _(spark, d):
    s = P.scan(readings(spark, d), attributes=["carrier_frequency"])
    return P.assemble({"x": P.filter_(s, [*numbers_in(HERTZ), P.Predicate("typed_value", ">", 5.0, "GHz")])}).select("record_id").distinct()


@q("f12_filter_negated", f"{BASE} SELECT record_id FROM t WHERE attribute = 'carrier_frequency' AND typed_value.kind = 'number' AND {IS_HZ} AND NOT (typed_value.value * {HZ} > 5e9 AND family_id = 'veltor_meridian900')")
def _(spark, d):
    s = P.scan(readings(spark, d), attributes=["carrier_frequency"])
    return P.assemble({"x": P.filter_(P.filter_(s, numbers_in(HERTZ)), [*numbers_in(HERTZ), P.Predicate("typed_value", ">", 5.0, "GHz"), P.Predicate("family_id", "==", "veltor_meridian900")], negate=True)}).select("record_id").distinct()


@q("f13_compare_bound", f"{BASE} SELECT record_id FROM t WHERE attribute = 'peak_power' AND typed_value.kind IN ('bound', 'number') AND typed_value.unit IN ('W', 'kW') AND typed_value.value * CASE typed_value.unit WHEN 'kW' THEN 1e3 ELSE 1 END <= 50000")
def _(spark, d):
    s = P.scan(readings(spark, d), attributes=["peak_power"])
    return P.assemble({"x": P.filter_(s, [*numbers_in(["W", "kW"], "bound", "number"), P.Predicate("typed_value", "<=", 50.0, "kW", "bound_endpoint")])}).select("record_id").distinct()


@q("f14_contains", f"{BASE} SELECT record_id FROM t WHERE attribute = 'frequency_span' AND typed_value.kind = 'range' AND {IS_HZ} AND 9000e6 BETWEEN typed_value.lower * {HZ} AND typed_value.upper * {HZ}")
def _(spark, d):
    s = P.scan(readings(spark, d), attributes=["frequency_span"])
    return P.assemble({"x": P.filter_(s, [*numbers_in(HERTZ, "range"), P.Predicate("typed_value", "contains", 9.0, "GHz")])}).select("record_id").distinct()


@q("f15_project_distinct", f"{BASE} SELECT family_id AS family, component AS part, count(*) AS n FROM t WHERE component IS NOT NULL GROUP BY 1, 2")
def _(spark, d):
    s = P.project(P.scan(readings(spark, d).filter("component is not null")), {"family": "family_id", "part": "component"})
    return s.select("family", "part", F.size(F.array_distinct(F.flatten(F.map_values("evidence")))).cast("long").alias("n"))


@q("f16_expand", f"{BASE} SELECT family_id, round(x.o, 6) AS item, count(*) AS n FROM t, unnest(typed_value.options) AS x(o) WHERE attribute = 'range_scales' GROUP BY 1, 2")
def _(spark, d):
    s = P.scan(readings(spark, d), attributes=["range_scales"])
    e = P.expand(s.withColumn("options", F.col("typed_value.options")), "options", "item")
    return e.groupBy("family_id", F.round("item", 6).alias("item")).agg(F.count("*").alias("n"))


@q("f17_derive", f"{BASE} SELECT typed_value.value * CASE typed_value.unit WHEN 'kW' THEN 1e3 ELSE 1 END > 100000 AS strong, count(*) AS n FROM t WHERE attribute = 'peak_power' AND typed_value.kind = 'number' AND typed_value.unit IN ('W', 'kW') GROUP BY 1")
def _(spark, d):
    s = P.scan(readings(spark, d), attributes=["peak_power"]).filter((F.col("typed_value.kind") == "number") & F.col("typed_value.unit").isin("W", "kW"))
    return P.derive(s, {"strong": P.Predicate("typed_value", ">", 100.0, "kW")}).groupBy("strong").agg(F.count("*").alias("n"))


@q("j01_join", f"""{BASE}, a AS (SELECT DISTINCT family_id, component FROM t WHERE attribute = 'prf' AND component IS NOT NULL), b AS (SELECT DISTINCT family_id, component FROM t WHERE attribute = 'pulse_width' AND component IS NOT NULL)
 SELECT family_id, component FROM a JOIN b USING (family_id, component)""")
def _(spark, d):
    r = readings(spark, d).filter("component is not null")
    part = lambda a: P.project(P.scan(r, attributes=[a]), {"family_id": "family_id", "component": "component"})
    return P.join(part("prf"), part("pulse_width"), ["family_id", "component"]).select("family_id", "component")


@q("u13_evidence_union", f"{BASE} SELECT attribute, count(DISTINCT record_id) AS n FROM t WHERE attribute IS NOT NULL GROUP BY 1")
def _(spark, d):
    return P.project(P.scan(readings(spark, d).filter("attribute is not null")), {"attribute": "attribute"}).select("attribute", F.size(F.col("evidence")["attribute"]).cast("long").alias("n"))


@q("r26_assess_same", f"{BASE} SELECT CASE WHEN count(*) = 0 THEN 'not_established' ELSE 'established' END AS status, CASE WHEN count(*) > 0 THEN count(DISTINCT typed_value.value) <= 1 END AS all_equal FROM t WHERE attribute = 'channel_count' AND family_id = 'veltor_meridian900' AND typed_value.kind = 'number' AND typed_value.unit IS NULL")
def _(spark, d):
    s = P.scan(readings(spark, d), families=["veltor_meridian900"], attributes=["channel_count"]).filter("typed_value.kind = 'number' AND typed_value.unit IS NULL")
    return P.assess_same_value(s, "typed_value")


@q("r26_assess_listed", f"{BASE} SELECT list_sort(list(DISTINCT CAST(typed_value.value AS VARCHAR) || coalesce(' ' || typed_value.unit, ''))) AS options FROM t WHERE attribute = 'channel_count' AND family_id = 'veltor_meridian900' AND typed_value.kind = 'number'")
def _(spark, d):
    s = P.scan(readings(spark, d), families=["veltor_meridian900"], attributes=["channel_count"]).filter("typed_value.kind = 'number'")
    return P.assess_listed_domain(s, "typed_value")


@q("r26_assess_joint", f"{BASE} SELECT attribute AS parameter, 9000e6 BETWEEN typed_value.lower * {HZ} AND typed_value.upper * {HZ} AS supported FROM t WHERE attribute = 'frequency_span' AND typed_value.kind = 'range' AND {IS_HZ}")
def _(spark, d):
    s = P.scan(readings(spark, d), attributes=["frequency_span"]).filter((F.col("typed_value.kind") == "range") & F.col("typed_value.unit").isin("Hz", "kHz", "MHz", "GHz"))
    return P.assess_joint_support(s, "attribute", "typed_value", {"frequency_span": (9.0, "GHz")})


@q("r27_assemble", f"{BASE} SELECT 'prf' AS output, record_id FROM t WHERE attribute = 'prf' UNION SELECT 'gain', record_id FROM t WHERE attribute = 'antenna_gain'")
def _(spark, d):
    r = readings(spark, d)
    return P.assemble({"prf": P.scan(r, attributes=["prf"]), "gain": P.scan(r, attributes=["antenna_gain"])})


@q("f22_exact_record", f"{BASE} SELECT record_id FROM t WHERE family_id = 'veltor_meridian900' AND attribute = 'prf' AND unit IS NULL")
def _(spark, d):
    return readings(spark, d).filter((F.col("family_id") == "veltor_meridian900") & (F.col("attribute") == "prf") & F.col("unit").eqNullSafe(F.lit(None))).select("record_id")


@q("f11_conditions", f"{BASE} SELECT count(*) FILTER (len(list_filter(coalesce(typed_conditions_all, []), lambda c: c.dimension = 'ambient_temperature')) = 0) AS n_absent FROM t")
def _(spark, d):
    return P.scan(readings(spark, d), absent=["ambient_temperature"]).agg(F.count("*").alias("n_absent"))


QUERIES, SQL = q.queries, q.sql
