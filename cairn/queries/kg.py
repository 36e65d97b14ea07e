"""Queries over the graph: look-ups, sets, walks, expansion, composition, quality, inference."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairn.functions import text as T
from cairn.operators import checks as C
from cairn.operators import evaluation as E
from cairn.operators import fusion as U
from cairn.operators import graph as G
from cairn.plans.composition import Composer
from cairn.queries.registry import Registry
from cairn.session import table
from cairn.sources import driver_graph as D

q = Registry()
K = D.KG
EQ = (("locatedIn", "basedIn"), ("developedBy", "supplies"))


@q("f01_heads_with", f"WITH {K} SELECT DISTINCT head AS entity FROM kg WHERE relation = 'locatedIn' AND tail = 'NATION_7'")
def _(spark, d):
    return G.heads_with(D.triples(spark, d), "locatedIn", "NATION_7")


@q("f02_tails_of", f"WITH {K} SELECT DISTINCT tail AS entity FROM kg WHERE relation = 'supplies' AND head = 'Supplier#000000003'")
def _(spark, d):
    return G.tails_of(D.triples(spark, d), "Supplier#000000003", "supplies")


@q("f03_all_tails", f"WITH {K} SELECT DISTINCT tail AS entity FROM kg WHERE relation = 'countryOfOrigin'")
def _(spark, d):
    return G.all_tails(D.triples(spark, d), "countryOfOrigin")


@q("f04_distinct_tails", f"WITH {K} SELECT tail, count(DISTINCT head) AS n_heads FROM kg WHERE relation = 'countryOfOrigin' GROUP BY tail ORDER BY 2 DESC, 1 DESC LIMIT 25")
def _(spark, d):
    return G.distinct_tails(D.triples(spark, d), "countryOfOrigin")


@q("f05_lookup", f"WITH {K} SELECT DISTINCT tail AS entity FROM kg WHERE relation = 'partOf' AND head = 'NATION_3' ORDER BY 1")
def _(spark, d):
    return G.tails_of(D.triples(spark, d), "NATION_3", "partOf").orderBy("entity")


@q("f06_find_typed", f"WITH {K} SELECT DISTINCT head AS entity FROM kg WHERE relation = 'partOf' AND tail = 'ASIA' AND head IN (SELECT n_name FROM nation)")
def _(spark, d):
    types = table(spark, d, "nation").select(F.col("n_name").alias("name"), F.lit("Nation").alias("type"))
    return G.find(D.triples(spark, d), "partOf", "ASIA", types, "Nation")


def _tiered(t):
    return t.withColumn("tier", F.when(F.col("confidence") >= 0.85, "gold").when(F.col("confidence") >= 0.7, "silver").otherwise("bronze")).withColumn("corroborated", F.col("source") == "tables")


_CLEAN = "length(trim({0})) BETWEEN 2 AND 60 AND regexp_matches({0}, '[A-Za-z]') AND NOT regexp_matches({0}, '[。；;!?！？\\n]')"


@q("f07_filtered_view", f"WITH {K} SELECT head, relation, tail FROM kg WHERE {_CLEAN.format('head')} AND {_CLEAN.format('tail')} AND (confidence >= 0.85 OR source = 'tables') AND (relation <> 'partOf' OR tail IN ('ASIA', 'EUROPE'))")
def _(spark, d):
    allowed = spark.createDataFrame([("ASIA",), ("EUROPE",)], "value string")
    return G.filtered_view(_tiered(D.triples(spark, d)), ["gold"], allowed, "partOf").select("head", "relation", "tail")


@q("f08_second_profile", f"WITH {K} SELECT head, relation, tail FROM kg WHERE {_CLEAN.format('head')} AND {_CLEAN.format('tail')} AND (confidence >= 0.7 OR source = 'tables') AND NOT (relation = 'developedBy' AND NOT regexp_matches(tail, 'electronics|systems|works|radar|laborator|institute|group|company'))")
def _(spark, d):
    t = G.filtered_view(_tiered(D.triples(spark, d)), ["gold", "silver"])
    company = F.col("tail").rlike("electronics|systems|works|radar|laborator|institute|group|company")
    return t.filter((F.col("relation") != "developedBy") | company).select("head", "relation", "tail")


@q("f09_confidence_floor", f"WITH {K} SELECT relation, count(*) AS n FROM kg WHERE coalesce(confidence, 0.5) >= CASE relation WHEN 'countryOfOrigin' THEN 0.8 WHEN 'deployedOn' THEN 0.6 ELSE 0 END GROUP BY relation")
def _(spark, d):
    floors = spark.createDataFrame([("countryOfOrigin", 0.8), ("deployedOn", 0.6)], "relation string, floor double")
    return G.confidence_floor(D.triples(spark, d), floors).groupBy("relation").agg(F.count("*").alias("n"))


@q("f10_constraint_alias", f"WITH {K} SELECT DISTINCT head AS entity FROM kg WHERE relation = 'locatedIn' AND tail = 'NATION_7'")
def _(spark, d):
    return G.constraint(D.triples(spark, d), "locatedIn", "Seven", D.aliases(spark), EQ)


@q("f10_constraint_equivalent", f"WITH {K} SELECT DISTINCT head AS entity FROM kg WHERE relation = 'locatedIn' AND tail = 'NATION_4'")
def _(spark, d):
    return G.constraint(D.triples(spark, d), "basedIn", "NATION_4", D.aliases(spark), EQ)


@q("f24_junk_names", f"WITH {K} SELECT relation, count(*) AS n FROM kg WHERE NOT ({_CLEAN.format('tail')}) OR regexp_matches(tail, '^[A-Z ]+$') GROUP BY relation")
def _(spark, d):
    return D.triples(spark, d).filter(~G.clean_name(F.col("tail")) | F.col("tail").rlike(r"^[A-Z ]+$")).groupBy("relation").agg(F.count("*").alias("n"))


@q("f25_rules", "SELECT event_id AS id, 'r1' AS rule FROM events WHERE event_type IN ('error', 'click') AND user_id % 3 = 0 UNION ALL SELECT event_id, 'r2' FROM events WHERE event_type = 'view'")
def _(spark, d):
    facts = table(spark, d, "events").select(F.col("event_id").alias("id"), F.create_map(F.lit("type"), "event_type", F.lit("third"), (F.col("user_id") % 3 == 0).cast("string")).alias("props"))
    rules = spark.createDataFrame([("r1", {"type": "error|click", "third": "true"}), ("r2", {"type": "view"}), ("r3", {"missing": "x"})], "rule string, cond map<string,string>")
    return U.rule_matches(facts, rules)


# ---- walks and expansion
@q("j02_path", f"WITH {K} SELECT DISTINCT b.tail AS entity FROM kg a JOIN kg b ON a.tail = b.head AND b.relation = 'partOf' JOIN kg c ON c.head = a.head AND c.relation = 'supplies' AND c.tail = 'Brand#7' WHERE a.relation = 'locatedIn'")
def _(spark, d):
    start = spark.createDataFrame([("Brand#7",)], "entity string")
    return G.walk(D.triples(spark, d), start, ["supplies^-1", "locatedIn", "partOf"])


@q("j03_path_trace", f"WITH {K}, e1 AS (SELECT DISTINCT head, tail FROM kg WHERE relation = 'supplies' AND tail = 'Brand#7'), e2 AS (SELECT DISTINCT k.head, k.tail FROM kg k WHERE relation = 'locatedIn' AND head IN (SELECT head FROM e1)) SELECT 1 AS step, 'supplies^-1' AS relation, count(*) AS n_edges, count(DISTINCT head) AS n_out FROM e1 UNION ALL SELECT 2, 'locatedIn', count(*), count(DISTINCT tail) FROM e2")
def _(spark, d):
    start = spark.createDataFrame([("Brand#7",)], "entity string")
    return G.walk_trace(D.triples(spark, d), start, ["supplies^-1", "locatedIn"])


@q("j04_inverse_walk", f"WITH {K} SELECT DISTINCT s.head AS entity FROM kg r JOIN kg s ON s.tail = r.head AND s.relation = 'locatedIn' WHERE r.relation = 'partOf' AND r.tail = 'EUROPE'")
def _(spark, d):
    return G.walk(D.triples(spark, d), spark.createDataFrame([("EUROPE",)], "entity string"), ["partOf^-1", "locatedIn^-1"])


@q("j07_two_hop", f"""WITH {K}, e AS (SELECT DISTINCT head, relation, tail FROM kg WHERE confidence >= 0.85),
 h1 AS (SELECT * FROM e WHERE head = 'NATION_5' OR tail = 'NATION_5'),
 f AS (SELECT tail AS x FROM h1 WHERE head = 'NATION_5' UNION SELECT head FROM h1 WHERE tail = 'NATION_5'),
 h2 AS (SELECT * FROM e WHERE head IN (SELECT x FROM f) OR tail IN (SELECT x FROM f))
 SELECT head, relation, tail, CAST(min(hop) AS INTEGER) AS hop FROM (SELECT *, 1 AS hop FROM h1 UNION ALL SELECT *, 2 FROM h2) GROUP BY ALL""")
def _(spark, d):
    return G.k_hop(D.triples(spark, d), spark.createDataFrame([("NATION_5",)], "entity string"), 2, 0.85)


@q("j08_hop_counts", f"WITH {K} SELECT relation, count(DISTINCT head || '|' || tail) AS n FROM kg WHERE head = 'Supplier#000000001' GROUP BY relation")
def _(spark, d):
    k = G.k_hop(D.triples(spark, d), spark.createDataFrame([("Supplier#000000001",)], "entity string"), 1, directed=True)
    return k.groupBy("relation").agg(F.count("*").alias("n"))


@q("j09_question_subgraph", f"WITH {K}, h1 AS (SELECT DISTINCT head, relation, tail FROM kg WHERE head = 'Supplier#000000002'), h2 AS (SELECT DISTINCT head, relation, tail FROM kg WHERE head IN (SELECT tail FROM h1)) SELECT * FROM h1 UNION SELECT * FROM h2")
def _(spark, d):
    return G.k_hop(D.triples(spark, d), spark.createDataFrame([("Supplier#000000002",)], "entity string"), 2, directed=True).select("head", "relation", "tail")


@q("j10_subgraph_members", f"WITH {K}, m AS (SELECT n_name AS entity FROM nation ORDER BY n_name LIMIT 5), h AS (SELECT DISTINCT head, relation, tail FROM kg WHERE head = 'NATION_9'), h2 AS (SELECT DISTINCT head, relation, tail FROM kg WHERE head IN (SELECT tail FROM h)) SELECT * FROM h UNION SELECT * FROM h2 UNION SELECT DISTINCT head, relation, tail FROM kg WHERE head IN (SELECT entity FROM m)")
def _(spark, d):
    members = table(spark, d, "nation").select(F.lit("Nation").alias("concept"), F.col("n_name").alias("entity"))
    return G.question_subgraph(D.triples(spark, d), spark.createDataFrame([("NATION_9",)], "entity string"), members, 2, 5)


# ---- sets and the composition language
def _run(spark, d, plan):
    return Composer(D.triples(spark, d), D.aliases(spark), EQ).run(plan)


C1, C2 = {"op": "constraint", "relation": "locatedIn", "value": "Seventh Nation"}, {"op": "constraint", "relation": "supplies", "value": "Brand#7"}
S1, S2 = "(SELECT head FROM kg WHERE relation = 'locatedIn' AND tail = 'NATION_7')", "(SELECT head FROM kg WHERE relation = 'supplies' AND tail = 'Brand#7')"


@q("u01_intersect", f"WITH {K} SELECT DISTINCT head AS entity FROM kg WHERE head IN {S1} AND head IN {S2}")
def _(spark, d):
    return _run(spark, d, {"op": "intersect", "args": [C1, C2]})


@q("u02_union", f"WITH {K} SELECT DISTINCT head AS entity FROM kg WHERE head IN {S1} OR head IN {S2}")
def _(spark, d):
    return _run(spark, d, {"op": "union", "args": [C1, C2]})


@q("u03_difference", f"WITH {K} SELECT DISTINCT head AS entity FROM kg WHERE head IN {S2} AND head NOT IN {S1}")
def _(spark, d):
    return _run(spark, d, {"op": "difference", "args": [C2, C1]})


@q("u04_set_tools", f"WITH {K} SELECT DISTINCT head AS entity FROM kg WHERE (head IN {S1} OR head IN {S2}) AND NOT (head IN {S1} AND head IN {S2})")
def _(spark, d):
    t = D.triples(spark, d)
    a, b = G.heads_with(t, "locatedIn", "NATION_7"), G.heads_with(t, "supplies", "Brand#7")
    return G.difference(G.union(a, b), G.intersect(a, b))


@q("u06_constrained_join", f"WITH {K} SELECT DISTINCT head AS entity FROM kg WHERE head IN {S1} AND head IN {S2}")
def _(spark, d):
    return G.constrained_join(D.triples(spark, d), [("basedIn", "Seven"), ("supplies", "Brand#7")], D.aliases(spark), EQ)


@q("u07_exhaustive", f"WITH {K} SELECT DISTINCT head AS entity FROM kg WHERE relation = 'countryOfOrigin' AND tail = 'ostania'")
def _(spark, d):
    return G.constraint(D.triples(spark, d), "countryOfOrigin", "ostania", D.aliases(spark))


@q("u08_complement", f"WITH {K}, x AS (SELECT DISTINCT tail AS entity FROM kg WHERE head = 'Supplier#000000004' AND relation = 'supplies') SELECT entity, entity = 'Brand#7' AS is_value, (SELECT bool_or(entity = 'Brand#7') FROM x) AS value_known FROM x")
def _(spark, d):
    return G.complement(D.triples(spark, d), "Supplier#000000004", "supplies", "Brand#7")


def _dual_sql(where: str) -> str:
    s = "coalesce(string_agg(tail, '|' ORDER BY tail) FILTER ({}), '')"
    return f"""WITH {K}, x AS (SELECT relation, tail, bool_or(head = 'Supplier#000000001') AS a, bool_or(head = 'Supplier#000000002') AS b FROM kg
 WHERE head IN ('Supplier#000000001', 'Supplier#000000002') {where} GROUP BY 1, 2)
 SELECT {'relation, ' if not where else ''}{s.format('a AND b')} AS same, {s.format('a AND NOT b')} AS only_a, {s.format('b AND NOT a')} AS only_b, bool_or(a) AND bool_and(a = b) AS identical FROM x {'GROUP BY relation' if not where else ''}"""


@q("u09_dual", _dual_sql(""))
def _(spark, d):
    return G.dual(D.triples(spark, d), "Supplier#000000001", "Supplier#000000002")


@q("u10_compare", _dual_sql("AND relation = 'supplies'"))
def _(spark, d):
    return _run(spark, d, {"op": "compare", "a": "Supplier#000000001", "b": "Supplier#000000002", "relation": "supplies"})


@q("u11_contains", f"WITH {K} SELECT count(*) > 0 AS value FROM kg WHERE relation = 'partOf' AND tail = 'ASIA' AND head IN ('Seven', 'NATION_7', 'NATION_77')")
def _(spark, d):
    return _run(spark, d, {"op": "contains", "set": {"op": "constraint", "relation": "partOf", "value": "Far East"}, "member": "Seven"})


@q("u12_enumerate", f"WITH {K} SELECT DISTINCT head AS entity FROM kg WHERE relation = 'partOf' AND tail = 'ASIA' ORDER BY 1")
def _(spark, d):
    return _run(spark, d, {"op": "enumerate", "arg": {"op": "constraint", "relation": "partOf", "value": "Far East"}})


@q("u14_set_f1", f"WITH {K}, x AS (SELECT head, tail FROM kg WHERE relation = 'supplies' GROUP BY 1, 2), n AS (SELECT head, count(*) AS n FROM x GROUP BY 1), b AS (SELECT a.head, count(*) AS k FROM x a JOIN x z ON a.tail = z.tail AND z.head = 'Supplier#000000001' GROUP BY 1) SELECT n.head, round(coalesce(2.0 * k / (n.n + (SELECT n FROM n WHERE head = 'Supplier#000000001')), 0), 6) AS f1 FROM n LEFT JOIN b USING (head)")
def _(spark, d):
    t = D.triples(spark, d).filter("relation = 'supplies'").groupBy("head").agg(F.collect_set("tail").alias("x"))
    one = t.filter("head = 'Supplier#000000001'").select(F.col("x").alias("y"))
    return t.crossJoin(F.broadcast(one)).select("head", F.round(T.token_f1(F.col("x"), F.col("y")), 6).alias("f1"))  # one row


@q("a01_count", f"WITH {K} SELECT count(DISTINCT head) AS value FROM kg WHERE head IN {S2}")
def _(spark, d):
    return _run(spark, d, {"op": "count", "arg": C2})


for _f in ("avg", "sum", "max", "min", "count"):
    _expr = {"avg": "avg(v)", "sum": "sum(v)", "max": "max(v)", "min": "min(v)", "count": "CAST(count(v) AS DOUBLE)"}[_f]

    @q(f"a02_aggregate_{_f}", f"""WITH {K}, s AS (SELECT DISTINCT head FROM kg WHERE relation = 'locatedIn' AND tail IN (SELECT head FROM kg WHERE relation = 'partOf' AND tail = 'ASIA')),
 p AS (SELECT s.head, avg(TRY_CAST(nullif(regexp_extract(k.tail, '-?[0-9]+(\\.[0-9]+)?'), '') AS DOUBLE)) AS v FROM s LEFT JOIN (SELECT DISTINCT head, tail FROM kg WHERE relation = 'balance') k USING (head) GROUP BY 1)
 SELECT round({_expr}, 4) AS value, count(*) AS n_set, count(v) AS n_covered FROM p""")
    def _(spark, d, f=_f):
        r = _run(spark, d, {"op": "aggregate", "over": {"op": "path", "start": "Far East", "chain": ["partOf^-1", "locatedIn^-1"]}, "attribute": "balance", "func": f})
        return r.withColumn("value", F.round("value", 4))


# ---- counts, fusion, conflicts
@q("a04_group_counts", f"WITH {K} SELECT relation, tail_type, count(*) AS n, count(DISTINCT head) AS n_heads FROM kg GROUP BY 1, 2")
def _(spark, d):
    return D.triples(spark, d).groupBy("relation", "tail_type").agg(F.count("*").alias("n"), F.count_distinct("head").alias("n_heads"))


@q("s02_merge_preferring", """WITH x AS (SELECT head, relation, tail, source, confidence FROM wikidata_enrich_out WHERE head IS NOT NULL AND tail IS NOT NULL)
 SELECT head, relation, tail, arg_max(source, (CASE WHEN source = 'wikidata_enrich_retry' THEN 1 ELSE 0 END, coalesce(confidence, -1))) AS source, max_by(confidence, (CASE WHEN source = 'wikidata_enrich_retry' THEN 1 ELSE 0 END, coalesce(confidence, -1))) AS confidence FROM x GROUP BY 1, 2, 3""")
def _(spark, d):
    t = table(spark, d, "wikidata_enrich_out").filter("head is not null and tail is not null")
    return U.merge_preferring(t, "wikidata_enrich_retry").select("head", "relation", "tail", "source", "confidence")


@q("a05_fuse", """WITH x AS (SELECT *, regexp_replace(lower(trim(head)), '[\\s\\-_/().]', '', 'g') AS h, regexp_replace(lower(trim(tail)), '[\\s\\-_/().]', '', 'g') AS t,
 CASE WHEN confidence >= 0.85 THEN 'gold' WHEN confidence >= 0.7 THEN 'silver' ELSE 'bronze' END AS tier, CASE WHEN confidence >= 0.85 THEN 3 WHEN confidence >= 0.7 THEN 2 ELSE 1 END AS p FROM wikidata_enrich_out WHERE tail IS NOT NULL AND trim(tail) <> '')
 SELECT min(head) AS head, relation, min(tail) AS tail, max_by(tier, p) AS tier, string_agg(DISTINCT source, '|' ORDER BY source) AS kinds, count(DISTINCT retrieved_at) AS n_docs, count(*) AS n,
 count(DISTINCT source) >= 2 OR count(DISTINCT retrieved_at) >= 2 AS corroborated FROM x GROUP BY h, relation, t""")
def _(spark, d):
    t = table(spark, d, "wikidata_enrich_out").filter("tail is not null and trim(tail) <> ''")
    t = t.select("head", "relation", "tail", F.when(F.col("confidence") >= 0.85, "gold").when(F.col("confidence") >= 0.7, "silver").otherwise("bronze").alias("tier"), F.col("source").alias("source_kind"), F.col("retrieved_at").cast("string").alias("doc_id"), F.col("tail_type").alias("evidence"))
    return U.fuse(t, {"gold": 3, "silver": 2, "bronze": 1}).drop("evidence")


@q("a06_majority", """WITH x AS (SELECT s_nationkey AS maker, l_partkey AS product, min(p_type) AS country FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON p_partkey = l_partkey GROUP BY 1, 2),
 g AS (SELECT maker, country, count(*) AS n FROM x GROUP BY 1, 2), w AS (SELECT *, CAST(sum(n) OVER (PARTITION BY maker) AS BIGINT) AS "all", row_number() OVER (PARTITION BY maker ORDER BY n DESC, country) AS k FROM g)
 SELECT maker, country, n, "all" FROM w WHERE k = 1 AND "all" >= 2 AND n >= 0.1 * "all" """)
def _(spark, d):
    li, s, p = (table(spark, d, x) for x in ("lineitem", "supplier", "part"))
    x = li.select("l_suppkey", "l_partkey").join(s, F.col("l_suppkey") == F.col("s_suppkey")).join(p, F.col("p_partkey") == F.col("l_partkey"))
    return U.majority(x.select(F.col("s_nationkey").alias("maker"), F.col("l_partkey").alias("product"), F.col("p_type").alias("country")), 2, 0.1)


@q("a07_conflicts", f"WITH {K} SELECT head, relation, count(DISTINCT tail) AS n_tails, string_agg(DISTINCT tail, '|' ORDER BY tail) AS tails FROM kg WHERE relation IN ('countryOfOrigin', 'derivedFrom') GROUP BY 1, 2 HAVING count(DISTINCT tail) > 1")
def _(spark, d):
    return G.conflicts(D.triples(spark, d), ["countryOfOrigin", "derivedFrom"])


@q("a08_contradictions", f"WITH {K} SELECT head, relation, count(DISTINCT k) AS n_tails, string_agg(DISTINCT k, '|' ORDER BY k) AS tails FROM (SELECT *, regexp_replace(lower(trim(tail)), '[\\s\\-_/().]', '', 'g') AS k FROM kg) WHERE relation IN ('countryOfOrigin', 'derivedFrom') GROUP BY 1, 2 HAVING count(DISTINCT k) > 1")
def _(spark, d):
    return G.conflicts(D.triples(spark, d), ["countryOfOrigin", "derivedFrom"], T.name_key(F.col("tail")))


@q("a09_dedup_keep_best", "SELECT o_custkey, max_by(o_orderkey, (o_totalprice, -o_orderkey)) AS o_orderkey, max(o_totalprice) AS o_totalprice FROM orders GROUP BY 1")
def _(spark, d):
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return U.keep_best(o, ["o_custkey"], [-F.col("o_totalprice"), F.col("o_orderkey")])


@q("a10_dedup_max_confidence", "SELECT lower(trim(head)) AS head, relation, lower(trim(tail)) AS tail, max(confidence) AS confidence FROM wikidata_enrich_out GROUP BY 1, 2, 3")
def _(spark, d):
    return table(spark, d, "wikidata_enrich_out").groupBy(F.lower(F.trim("head")).alias("head"), "relation", F.lower(F.trim("tail")).alias("tail")).agg(F.max("confidence").alias("confidence"))


@q("a11_merge_entities", """WITH x AS (SELECT DISTINCT family_id AS name FROM typed_records WHERE family_id IS NOT NULL), y AS (SELECT *, lower(trim(name)) AS k FROM x)
 SELECT max_by(name, (length(name) - length(replace(name, '-', '')), length(name), name)) AS name, CAST(NULL AS VARCHAR) AS country, string_agg(DISTINCT name, '|' ORDER BY name) AS aliases, count(*) AS n_merged FROM y GROUP BY k""")
def _(spark, d):
    e = table(spark, d, "typed_records").filter("family_id is not null").select(F.col("family_id").alias("name")).distinct()
    e = e.select("name", F.lit(None).cast("string").alias("country"), F.array("name").alias("aliases"))
    return U.merge_entities(e, F.lower(F.trim("name")))


@q("a12_fragments", "WITH x AS (SELECT DISTINCT family_id AS name FROM typed_records) SELECT lower(trim(name)) AS key, count(DISTINCT name) AS n_forms, min(name) AS first_form FROM x GROUP BY 1 HAVING count(DISTINCT name) > 1")
def _(spark, d):
    return G.fragments(table(spark, d, "typed_records").select(F.col("family_id").alias("name")).distinct(), F.lower(F.trim("name")))


@q("a13_degrees", f"WITH {K} SELECT entity, count(*) AS degree FROM (SELECT head AS entity FROM kg UNION ALL SELECT tail FROM kg) GROUP BY 1")
def _(spark, d):
    return G.degrees(D.triples(spark, d))


@q("a14_corroboration", "SELECT origins, count(*) AS n FROM (SELECT head, relation, tail, count(DISTINCT source) AS origins FROM wikidata_enrich_out GROUP BY 1, 2, 3) GROUP BY 1")
def _(spark, d):
    return U.corroboration(table(spark, d, "wikidata_enrich_out").withColumn("origin", F.col("source")))


@q("j20_agreement", "SELECT relation, count(*) AS n_facts, count(*) FILTER (o >= 2) AS n_shared, count(*) FILTER (o >= 2 AND v = 1) AS n_agree FROM (SELECT head, relation, count(DISTINCT source) AS o, count(DISTINCT tail) AS v FROM wikidata_enrich_out GROUP BY 1, 2) GROUP BY 1")
def _(spark, d):
    return U.agreement(table(spark, d, "wikidata_enrich_out").withColumn("origin", F.col("source")))


# ---- inference
@q("j11_shared_platform", f"""WITH {K}, e AS (SELECT head, tail, max(confidence) AS c FROM kg WHERE relation = 'deployedOn' GROUP BY 1, 2),
 p AS (SELECT a.head AS a, b.head AS b, count(*) AS n_shared, min_by(least(a.c, b.c), a.tail) AS c FROM e a JOIN e b ON a.tail = b.tail AND a.head < b.head GROUP BY 1, 2)
 SELECT a AS head, 'coDeployedWith' AS relation, b AS tail, round(c, 4) AS confidence, n_shared FROM p UNION ALL SELECT b, 'coDeployedWith', a, round(c, 4), n_shared FROM p""")
def _(spark, d):
    return U.sharing_pairs(D.triples(spark, d), "deployedOn", "coDeployedWith")


@q("r03_co_supply", f"""WITH {K}, e AS (SELECT head, tail, max(confidence) AS c FROM kg WHERE relation IN ('developedBy', 'deployedOn', 'countryOfOrigin') GROUP BY 1, 2),
 p AS (SELECT a.head AS a, b.head AS b, count(*) AS n_shared, min_by(least(a.c, b.c), a.tail) AS c FROM e a JOIN e b ON a.tail = b.tail AND a.head < b.head GROUP BY 1, 2 HAVING count(*) >= 2)
 SELECT a AS head, 'coOperatedBy' AS relation, b AS tail, round(c - 0.05, 4) AS confidence, n_shared FROM p UNION ALL SELECT b, 'coOperatedBy', a, round(c - 0.05, 4), n_shared FROM p""")
def _(spark, d):
    t = D.triples(spark, d).filter("relation in ('developedBy', 'deployedOn', 'countryOfOrigin')").withColumn("relation", F.lit("association"))
    return U.sharing_pairs(t, "association", "coOperatedBy", 2, 0.05)


@q("j12_competitors", f"""WITH {K}, b AS (SELECT DISTINCT head, tail FROM kg WHERE relation = 'countryOfOrigin'), p AS (SELECT DISTINCT head, tail FROM kg WHERE relation = 'deployedOn'), o AS (SELECT DISTINCT head, tail FROM kg WHERE relation = 'developedBy')
 SELECT x.head AS a, y.head AS b, min(x.tail) AS band FROM b x JOIN b y ON x.tail = y.tail AND x.head < y.head
 WHERE EXISTS (SELECT 1 FROM p u JOIN p v ON u.tail = v.tail WHERE u.head = x.head AND v.head = y.head) AND NOT EXISTS (SELECT 1 FROM o u JOIN o v ON u.tail = v.tail WHERE u.head = x.head AND v.head = y.head) GROUP BY 1, 2""")
def _(spark, d):
    return U.competitors(D.triples(spark, d), "countryOfOrigin", "deployedOn", "developedBy")


@q("r04_inverse", f"WITH {K} SELECT tail AS head, CASE relation WHEN 'replaces' THEN 'replacedBy' ELSE 'hasDerivative' END AS relation, head AS tail, round(greatest(confidence - 0.1, 0.5), 4) AS confidence FROM kg WHERE relation IN ('replaces', 'derivedFrom')")
def _(spark, d):
    return U.inverse_edges(D.triples(spark, d), {"replaces": "replacedBy", "derivedFrom": "hasDerivative"})


@q("j13_only_new", f"WITH {K} SELECT tail AS head, 'replaces' AS relation, head AS tail, round(greatest(confidence - 0.1, 0.5), 4) AS confidence FROM kg k WHERE relation = 'replaces' AND NOT EXISTS (SELECT 1 FROM kg z WHERE z.head = k.tail AND z.relation = 'replaces' AND z.tail = k.head)")
def _(spark, d):
    t = D.triples(spark, d)
    return U.only_new(U.inverse_edges(t, {"replaces": "replaces"}), t).select("head", "relation", "tail", "confidence")


@q("j16_grounded", """SELECT w.head || '|' || w.relation || '|' || w.tail AS claim, coalesce(bool_or(contains(regexp_replace(lower(text), '[^\\p{L}\\p{N}]', '', 'g'), regexp_replace(lower(w.head), '[^\\p{L}\\p{N}]', '', 'g'))), false) AS head_in
 FROM (SELECT DISTINCT head, relation, tail FROM wikidata_enrich_out WHERE tail IS NOT NULL AND relation = 'replaces') w LEFT JOIN (SELECT DISTINCT family_id, raw_text_en AS text FROM radar_corpus WHERE family_id IS NOT NULL AND raw_text_en IS NOT NULL) r
 ON regexp_replace(lower(r.family_id), '[^\\p{L}\\p{N}]', '', 'g') = w.head GROUP BY 1""")
def _(spark, d):
    w = table(spark, d, "wikidata_enrich_out").filter("tail is not null and relation = 'replaces'").select("head", "relation", "tail").distinct()
    claims = w.select(F.concat("head", F.lit("|"), "relation", F.lit("|"), "tail").alias("claim"), F.col("head").alias("doc"), "head", "tail")
    texts = table(spark, d, "radar_corpus").filter("family_id is not null and raw_text_en is not null").select(T.entity_key(F.col("family_id")).alias("doc"), F.col("raw_text_en").alias("text"))
    return U.grounded(claims, texts, ["head"]).groupBy("claim").agg(F.bool_or("head_in").alias("head_in"))


def _grounded(spark, d):
    w = table(spark, d, "wikidata_enrich_out").filter("head is not null and relation is not null and tail is not null").select("head", "relation", "tail").distinct()
    claims = w.select(F.concat_ws("|", "head", "relation", "tail").alias("claim"), F.col("head").alias("doc"), "head", "tail")
    texts = table(spark, d, "radar_corpus").filter("family_id is not null and raw_text_en is not null").select(T.entity_key(F.col("family_id")).alias("doc"), F.col("raw_text_en").alias("text"))
    return U.grounded(claims, texts).groupBy("claim").agg(F.bool_or("head_in").alias("head_in"), F.bool_or("tail_in").alias("tail_in"))


@q("j16_grounded_all")
def _(spark, d):
    return _grounded(spark, d)


@q("r08_gate_all")
def _(spark, d):
    return C.gate(_grounded(spark, d))


@q("j17_resolve", """WITH m AS (SELECT DISTINCT head AS mention, regexp_replace(lower(head), '[^\\p{L}\\p{N}]', '', 'g') AS k FROM wikidata_enrich_out), e AS (SELECT DISTINCT lower(trim(family_id)) AS name, regexp_replace(lower(trim(family_id)), '[^\\p{L}\\p{N}]', '', 'g') AS k FROM typed_records WHERE family_id IS NOT NULL),
 a AS (SELECT mention, name, 0 AS how FROM m JOIN e ON mention = name UNION ALL SELECT mention, name, 2 FROM m JOIN e ON m.k = e.k UNION ALL SELECT mention, name, 3 FROM m JOIN e ON substr(m.k, 1, 4) = substr(e.k, 1, 4) AND length(m.k) >= 4 AND starts_with(e.k, m.k))
 SELECT mention, min_by(name, (how, length(name), name)) AS name, CAST(min(how) AS INTEGER) AS how FROM a GROUP BY 1""")
def _(spark, d):
    e = table(spark, d, "typed_records").filter("family_id is not null").select(F.lower(F.trim("family_id")).alias("name"))
    return U.resolve(table(spark, d, "wikidata_enrich_out").select(F.col("head").alias("mention")), e, D.aliases(spark))


@q("j18_prefix_blocks", "WITH n AS (SELECT DISTINCT s AS name, regexp_replace(lower(s), '[^\\p{L}\\p{N}]', '', 'g') AS k FROM (SELECT lower(trim(tail)) AS s FROM wikidata_enrich_out WHERE tail IS NOT NULL)) SELECT a.name AS short, b.name AS long FROM n a JOIN n b ON length(a.k) >= 4 AND length(b.k) >= 4 AND a.k <> b.k AND starts_with(b.k, a.k)")
def _(spark, d):
    n = table(spark, d, "wikidata_enrich_out").filter("tail is not null").select(F.lower(F.trim("tail")).alias("name"))
    return U.prefix_blocks(n, T.entity_key(F.col("name")))


@q("j19_similar_parts", """WITH f AS (SELECT p_partkey AS name, p_brand AS country, p_type, p_size FROM part), j AS (SELECT a.name AS a, b.name AS b, round((CASE WHEN a.p_type = b.p_type THEN 0.6 ELSE 0 END) + (CASE WHEN a.p_size = b.p_size THEN 0.4 ELSE 0 END), 6) AS score FROM f a JOIN f b ON a.country = b.country AND a.name <> b.name)
 SELECT a, b, score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, b) AS rank FROM j WHERE score > 0) WHERE rank <= 5""")
def _(spark, d):
    f = table(spark, d, "part").select(F.col("p_partkey").alias("name"), F.col("p_brand").alias("country"), "p_type", "p_size")
    return U.similar(f, spark.createDataFrame([], "a long, b long"), {"p_type": 0.6, "p_size": 0.4})


@q("r10_clean_tails", "SELECT head, relation, t AS tail FROM (SELECT head, relation, trim(regexp_replace(regexp_replace(tail, '^[\\s\"''·,;:.]+|[\\s\"''·,;:]+$', '', 'g'), '\\s+', ' ', 'g')) AS t FROM wikidata_enrich_out) WHERE length(t) > 0 AND NOT regexp_matches(lower(t), '^(unknown|n/a)$')")
def _(spark, d):
    return U.cleaned_tails(table(spark, d, "wikidata_enrich_out").select("head", "relation", "tail"), r"(?i)^(unknown|n/a)$")


@q("r07_canonical_values", "SELECT c_custkey, CASE WHEN contains(lower(c_mktsegment), 'machinery') THEN 'industry' WHEN contains(lower(c_mktsegment), 'hold') THEN 'home' ELSE c_mktsegment END AS segment FROM customer")
def _(spark, d):
    c = table(spark, d, "customer").select("c_custkey", F.lit("segment").alias("relation"), F.col("c_mktsegment").alias("tail"))
    s = spark.createDataFrame([("segment", "mach", "machines"), ("segment", "machinery", "industry"), ("segment", "hold", "home")], "relation string, surface string, canonical string")
    return U.canonical_values(c, s).select("c_custkey", F.col("tail").alias("segment"))


@q("r09_relabel", "SELECT CASE WHEN n > 0 AND k = n THEN 'onlyBuilding' ELSE 'segment' END AS relation, count(*) AS n FROM (SELECT o_custkey, count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS k FROM orders GROUP BY 1) GROUP BY 1")
def _(spark, d):
    t = table(spark, d, "orders").groupBy("o_custkey").agg(F.collect_list("o_orderstatus").alias("evidence")).withColumn("relation", F.lit("segment"))
    return U.relabel(t, "segment", "onlyBuilding", "^F$").groupBy("relation").agg(F.count("*").alias("n"))


@q("r32_path_templates", f"WITH {K} SELECT a.relation AS r1, b.relation AS r2, count(*) AS support FROM kg a JOIN kg b ON a.tail = b.head GROUP BY 1, 2 HAVING count(*) >= 2")
def _(spark, d):
    return U.path_templates(D.triples(spark, d))


@q("r34_components", f"""WITH RECURSIVE {K}, e AS (SELECT head AS a, tail AS b FROM kg WHERE relation IN ('derivedFrom', 'replaces') UNION SELECT tail, head FROM kg WHERE relation IN ('derivedFrom', 'replaces')),
 r AS (SELECT a AS node, a AS x FROM e UNION SELECT r.node, e.b FROM r JOIN e ON r.x = e.a) SELECT node, min(x) AS component FROM r GROUP BY node""")
def _(spark, d):
    t = D.triples(spark, d).filter("relation in ('derivedFrom', 'replaces')")
    return U.components(t.select(F.col("head").alias("a"), F.col("tail").alias("b")))


@q("r30_leakage", "SELECT 'id:' || min(id) AS component, count(*) AS n_items, array_to_string(list_sort(list(DISTINCT split)), '|') AS splits FROM questions WHERE question IS NOT NULL GROUP BY lower(trim(question)) HAVING count(DISTINCT split) > 1")
def _(spark, d):
    qs = table(spark, d, "questions").select("id", "split", F.lower(F.trim("question")).alias("text"))
    return U.leakage(qs, ["text"])


@q("r33_cover")
def _(spark, d):
    t = D.triples(spark, d).filter("relation = 'supplies'")
    return U.cover(t.select(F.col("head").alias("set"), F.col("tail").alias("item")))


@q("q01_self_loops", f"WITH {K} SELECT relation, count(*) AS n FROM kg WHERE head = tail GROUP BY 1")
def _(spark, d):
    return G.self_loops(D.triples(spark, d)).groupBy("relation").agg(F.count("*").alias("n"))


@q("q02_schema_violations", f"WITH {K} SELECT relation, count(*) AS n, count(*) FILTER (relation IN ('locatedIn', 'supplies') AND head_type <> 'Supplier') AS n_head_type, count(*) FILTER ((relation = 'locatedIn' AND coalesce(tail_type, '') <> 'Region') OR (relation = 'supplies' AND coalesce(tail_type, '') <> 'Brand')) AS n_tail_type FROM kg GROUP BY 1")
def _(spark, d):
    s = spark.createDataFrame([("locatedIn", ["Supplier"], ["Region"]), ("supplies", ["Supplier"], ["Brand"])], "relation string, head_types array<string>, tail_types array<string>")
    return G.schema_violations(D.triples(spark, d), s)


@q("x29_split_bucket", "WITH b AS (SELECT list_reduce(list_prepend(0, list_transform(string_split(md5(c_name), ''), lambda c: strpos('0123456789abcdef', c) - 1)), lambda a, x: (a * 16 + x) % 100) AS b FROM customer) SELECT CASE WHEN b < 80 THEN 'train' WHEN b < 90 THEN 'dev' ELSE 'test' END AS split, count(*) AS n FROM b GROUP BY 1")
def _(spark, d):
    c = table(spark, d, "customer").select("c_custkey", T.split_name(F.col("c_name")).alias("split"))
    return c.groupBy("split").agg(F.count("*").alias("n"))


@q("s16_manifest", "SELECT r_regionkey, length(r_name) AS n FROM region")
def _(spark, d):
    from cairn.sources import readers

    m = readers.manifest(table(spark, d, "region"), "r_regionkey", "r_name")
    return m.filter(F.length("sha256") == 64).select("r_regionkey", F.length("r_name").cast("long").alias("n"))


@q("w04_z_scores", "SELECT s_suppkey, round((s_acctbal - avg(s_acctbal) OVER ()) / (stddev_pop(s_acctbal) OVER () + 1e-8), 5) AS z FROM supplier")
def _(spark, d):
    return E.z_scores(table(spark, d, "supplier").select("s_suppkey", "s_acctbal"), "s_acctbal").select("s_suppkey", F.round("z", 5).alias("z"))


QUERIES, SQL = q.queries, q.sql
