"""Queries of lexicons, checked joins, scores, audits and file sources."""

from __future__ import annotations

import json

from pyspark.sql import functions as F
from pyspark.sql import types as T_

from cairn.functions import units as UN
from cairn.operators import checks as C
from cairn.operators import fusion as U
from cairn.operators import graph as G
from cairn.operators import lexicon as L
from cairn.plans import composition as CO
from cairn.plans import kopl
from cairn.plans import table_program as P
from cairn.queries.registry import Registry
from cairn.session import cut, shared_folder, table
from cairn.sources import driver_graph as D
from cairn.sources import readers

q = Registry()
K = D.KG


def _index(spark, d):
    n = table(spark, d, "nation").select(F.col("n_name").alias("canonical"), F.lit("Nation").alias("type"), F.array(F.concat(F.lit("land "), "n_nationkey")).alias("surfaces"), F.col("n_nationkey").alias("place"))
    r = table(spark, d, "region").select(F.col("r_name").alias("canonical"), F.lit("Region").alias("type"), F.array(F.concat(F.lit("the "), F.lower("r_name"))).alias("surfaces"), (F.col("r_regionkey") + 100).alias("place"))
    return L.alias_index(n.unionByName(r))


@q("x03_alias_index", "SELECT n_name AS surface, n_name AS canonical, 'Nation' AS type FROM nation UNION SELECT lower(n_name), n_name, 'Nation' FROM nation UNION SELECT 'land ' || n_nationkey, n_name, 'Nation' FROM nation UNION SELECT r_name, r_name, 'Region' FROM region UNION SELECT lower(r_name), r_name, 'Region' FROM region UNION SELECT 'the ' || lower(r_name), r_name, 'Region' FROM region")
def _(spark, d):
    return _index(spark, d)


@q("x01_expansions", "WITH v AS (SELECT lower(n_name) || ' area' AS value, lower(n_name) AS bare, n_name FROM nation) SELECT value, value AS candidate, 0 AS priority FROM v UNION ALL SELECT value, bare, 2 FROM v UNION ALL SELECT value, n_name, 3 FROM v")
def _(spark, d):
    v = table(spark, d, "nation").select(F.concat(F.lower("n_name"), F.lit(" area")).alias("value"))
    return L.expansions(v, _index(spark, d), [" area", " land"])


@q("x02_value_types", "SELECT n_name AS value, 'Nation' AS types FROM nation UNION ALL SELECT CAST(year(o_orderdate) AS VARCHAR), 'year' FROM orders GROUP BY year(o_orderdate)")
def _(spark, d):
    v = table(spark, d, "nation").select(F.col("n_name").alias("value")).unionByName(table(spark, d, "orders").select(F.year("o_orderdate").cast("string").alias("value")).distinct())
    return L.value_types(v, _index(spark, d))


@q("x04_relation_keywords", "SELECT word, array_to_string(list_sort(list(DISTINCT attribute)), '|') AS relations FROM (SELECT attribute, unnest(aliases) AS word FROM attr_schema) GROUP BY 1")
def _(spark, d):
    k = table(spark, d, "attr_schema").select(F.col("attribute").alias("relation"), F.col("aliases").alias("keywords"))
    return L.relations_of(k.select(F.explode("keywords").alias("word")).distinct(), k)


@q("x06_normalised", "SELECT relation, CASE WHEN relation = 'deployedOn' AND lower(trim(tail)) = 'patrol vessel' THEN 'ship' ELSE trim(regexp_replace(tail, '\\s+', ' ', 'g')) END AS tail, count(*) AS n FROM wikidata_enrich_out WHERE tail IS NOT NULL GROUP BY 1, 2")
def _(spark, d):
    t = table(spark, d, "wikidata_enrich_out").filter("tail is not null").select("relation", "tail")
    return L.normalised(t, {"deployedOn": {"patrol vessel": "ship"}}).groupBy("relation", "tail").agg(F.count("*").alias("n"))


@q("x07_best_form", "SELECT lower(trim(tail)) AS key, max_by(tail, (length(tail) - length(replace(tail, '-', '')), length(tail), tail)) AS form FROM wikidata_enrich_out WHERE tail IS NOT NULL GROUP BY 1")
def _(spark, d):
    return L.best_form(table(spark, d, "wikidata_enrich_out").filter("tail is not null").select(F.col("tail").alias("name")), F.lower(F.trim("name")))


@q("w10_longest_alias", "WITH a(surface, canonical) AS (VALUES ('sea clutter', 'clutter'), ('clutter', 'noise'), ('magnetron', 'tube')), w AS (SELECT doc_id, ' ' || array_to_string(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+'), ' ') || ' ' AS t FROM documents WHERE text IS NOT NULL), x AS (SELECT doc_id AS id, surface, canonical, row_number() OVER (PARTITION BY doc_id ORDER BY length(surface) DESC, surface) AS k FROM w, a WHERE contains(t, ' ' || surface || ' ')) SELECT id, surface, canonical FROM x WHERE k = 1")
def _(spark, d):
    a = spark.createDataFrame([("sea clutter", "clutter"), ("clutter", "noise"), ("magnetron", "tube")], "surface string, canonical string")
    return L.longest_alias(table(spark, d, "documents").filter("text is not null").select(F.col("doc_id").alias("id"), "text"), a)


@q("x36_substitutes", "SELECT 'locatedIn' AS relation, 'Brand' AS type, 'supplies' AS substitute UNION ALL SELECT 'partOf', 'Region', 'partOf'")
def _(spark, d):
    s = spark.createDataFrame([("locatedIn", ["Nation"]), ("supplies", ["Brand"]), ("partOf", ["Region"])], "relation string, tail_types array<string>")
    u = D.triples(spark, d).groupBy("relation").agg(F.count("*").alias("n"))
    return L.substitutes(spark.createDataFrame([("locatedIn", "Brand"), ("partOf", "Region")], "relation string, type string"), s, u)


@q("r24_router", "SELECT id, CASE type WHEN 'compare' THEN 'dual' WHEN 'bool' THEN 'verify' WHEN 'count' THEN 'aggregate' ELSE 'lookup' END AS strategy FROM questions")
def _(spark, d):
    return L.routed(table(spark, d, "questions"), {"compare": "dual", "bool": "verify", "count": "aggregate"})


@q("r41_accepted", f"WITH {K} SELECT head, relation, tail, confidence FROM kg WHERE relation IN ('locatedIn', 'countryOfOrigin') AND confidence >= 0.9 AND tail IN (SELECT n_name FROM nation)")
def _(spark, d):
    return L.accepted(D.triples(spark, d), ["locatedIn", "countryOfOrigin"], 0.9, table(spark, d, "nation").select(F.col("n_name").alias("value"))).select("head", "relation", "tail", "confidence")


@q("r11_domain", "WITH x AS (SELECT head, CASE WHEN source = 'wikidata_enrich_retry' THEN 'retried' END AS s, CASE WHEN relation = 'deployedOn' THEN CASE WHEN regexp_matches(lower(tail), 'ship|vessel|frigate|destroyer|carrier|submarine|boat|naval|marine|corvette') THEN 'naval' WHEN regexp_matches(lower(tail), 'ground|vehicle|truck|station|coastal|tower|site|harbou?r') THEN 'ground' WHEN regexp_matches(lower(tail), 'air|aircraft|fighter|helicopter|uav|bomber|drone') THEN 'air' END END AS p FROM wikidata_enrich_out) SELECT head, coalesce(min(s), min(p), 'unknown') AS domain FROM x GROUP BY 1")
def _(spark, d):
    return L.domain(table(spark, d, "wikidata_enrich_out"), {"wikidata_enrich_retry": "retried"}, "deployedOn")


@q("j14_scored_join", "SELECT o_orderkey AS id, o_orderstatus AS answer, o_orderpriority AS prediction FROM orders")
def _(spark, d):
    o = table(spark, d, "orders")
    return C.scored_join(o.select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("answer")), o.select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("prediction")))


@q("j15_materialised", "SELECT record_id, min(attribute) AS attribute FROM typed_records WHERE component = 'antenna' GROUP BY 1")
def _(spark, d):
    r = table(spark, d, "typed_records").groupBy("record_id").agg(F.min("attribute").alias("attribute"))
    return C.materialised(table(spark, d, "typed_records").filter("component = 'antenna'"), r)


@q("x27_answer_score", "SELECT count(*) AS n, count(*) FILTER (regexp_extract(prediction, '-?\\d+(\\.\\d+)?') = regexp_extract(generated_text, '-?\\d+(\\.\\d+)?')) > 0 AS some FROM generations WHERE prediction IS NOT NULL")
def _(spark, d):
    g = table(spark, d, "generations").filter("prediction is not null")
    s = g.select(C.answer_score(F.lit("scalar"), F.col("prediction"), F.col("generated_text")).alias("s"))
    return s.agg(F.count("*").alias("n"), (F.sum("s") > 0).alias("some"))


@q("x28_sequence_ratio")
def _(spark, d):
    n = table(spark, d, "nation").select("n_name")
    return n.select("n_name", F.round(C.sequence_ratio(F.col("n_name"), F.lit("NATION_1")), 6).alias("ratio"))


@q("r06_extracted", "SELECT doc_id AS id, 'rotation' AS relation, regexp_extract(text, 'turns at (\\d+) rpm', 1) AS value FROM documents WHERE regexp_matches(text, 'turns at \\d+ rpm') UNION ALL SELECT doc_id, 'series_year', regexp_extract(text, 'left the works in (\\d{4})', 1) FROM documents WHERE regexp_matches(text, 'left the works in \\d{4}')")
def _(spark, d):
    t = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    return C.extracted(t, {"rotation": r"turns at (\d+) rpm", "series_year": r"left the works in (\d{4})"})


@q("r08_gate", "SELECT 'accept' AS verdict, count(*) AS n FROM nation")
def _(spark, d):
    n = table(spark, d, "nation")
    claims = n.select(F.col("n_nationkey").alias("claim"), F.col("n_nationkey").alias("doc"), F.col("n_name").alias("head"), F.lit("x9").alias("tail"))
    texts = n.select(F.col("n_nationkey").alias("doc"), F.concat("n_name", F.lit(" has X-9")).alias("text"))
    return C.gate(U.grounded(claims, texts)).groupBy("verdict").agg(F.count("*").alias("n"))


@q("r13_paired_delta", "SELECT round(avg(x), 6) AS delta, round(avg(x) - 1.96 * stddev_samp(x) / sqrt(count(*)), 6) AS low, round(avg(x) + 1.96 * stddev_samp(x) / sqrt(count(*)), 6) AS high FROM (SELECT CAST(o_custkey % 2 = 0 AS INTEGER) - CAST(o_orderkey % 3 = 0 AS INTEGER) AS x FROM orders)")
def _(spark, d):
    r = C.paired_delta(table(spark, d, "orders").select((F.col("o_orderkey") % 3 == 0).cast("int").alias("a"), (F.col("o_custkey") % 2 == 0).cast("int").alias("b")))
    return r.select(*[F.round(c, 6).alias(c) for c in r.columns])


@q("r36_difference_of_differences", "SELECT round(avg(x) FILTER (o_orderstatus = 'F') - avg(x) FILTER (o_orderstatus <> 'F'), 6) AS effect FROM (SELECT o_orderstatus, CAST(o_custkey % 2 = 0 AS INTEGER) - CAST(o_orderkey % 3 = 0 AS INTEGER) AS x FROM orders)")
def _(spark, d):
    o = table(spark, d, "orders").select((F.col("o_orderstatus") == "F").alias("treated"), (F.col("o_orderkey") % 3 == 0).cast("int").alias("a"), (F.col("o_custkey") % 2 == 0).cast("int").alias("b"))
    return C.difference_of_differences(o).select(F.round("effect", 6).alias("effect"))


@q("r15_best_assignment", "SELECT r_name, n_name, r_regionkey * 100 + n_nationkey AS score FROM region, nation ORDER BY 3 DESC LIMIT 1")
def _(spark, d):
    r, n = table(spark, d, "region").select("r_regionkey", "r_name"), table(spark, d, "nation").select("n_nationkey", "n_name")
    return C.best_assignment([r, n], F.col("r_regionkey") * 100 + F.col("n_nationkey")).select("r_name", "n_name", "score")


@q("r28_signature", "SELECT 'other order' AS answer, count(*) AS n_rows, true AS same FROM orders UNION ALL SELECT 'one value changed', count(*), false FROM orders")
def _(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    one = o.withColumn("o_orderstatus", F.when(F.col("o_orderkey") == o.agg(F.max("o_orderkey")).scalar(), "?").otherwise(F.col("o_orderstatus")))
    own = C.signature(o, "o_orderkey", "o_orderstatus")
    others = [("other order", C.signature(o.repartition(3, "o_orderstatus"), "o_orderstatus", "o_orderkey")), ("one value changed", C.signature(one, "o_orderkey", "o_orderstatus"))]
    cases = [own.join(b.select(F.col("signature").alias("s2"))).select(F.lit(name).alias("answer"), "n_rows", (F.col("signature") == F.col("s2")).alias("same")) for name, b in others]
    return cases[0].unionByName(cases[1])


@q("r39_program_diff", "SELECT CASE WHEN o_orderkey % 4 = 0 THEN 'structure' WHEN o_orderkey % 4 = 1 THEN 'identical' WHEN o_orderkey % 4 = 2 THEN 'single field' ELSE 'several fields' END AS kind, count(*) AS n FROM orders GROUP BY 1")
def _(spark, d):
    k = F.col("o_orderkey") % 4
    step = lambda f, a, b: F.array(F.struct(F.lit(f).alias("function"), F.array(a, b).alias("inputs")))
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), step("FilterStr", F.lit("a"), F.lit("b")).alias("steps"), "o_orderkey")
    other = o.select("id", F.when(k == 0, step("Relate", F.lit("a"), F.lit("b"))).when(k == 1, F.col("steps")).when(k == 2, step("FilterStr", F.lit("a"), F.lit("x"))).otherwise(step("FilterStr", F.lit("y"), F.lit("x"))).alias("steps"))
    return C.program_diff(o.select("id", "steps"), other).groupBy("kind").agg(F.count("*").alias("n"))


@q("r40_unknown_fields", "SELECT o_orderkey AS id, o_orderpriority AS field FROM orders WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH')")
def _(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.array("o_orderpriority").alias("fields"))
    return C.unknown_fields(o, spark.createDataFrame([("1-URGENT",), ("2-HIGH",)], "field string"))


@q("r42_support_ratio", "SELECT c_custkey AS id, CASE c_custkey % 3 WHEN 0 THEN 0.5 WHEN 1 THEN 1.0 ELSE 0.0 END AS ratio FROM customer")
def _(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("fact"))
    said = F.when(F.col("id") % 3 == 0, F.concat("fact", F.lit(" unheard"))).when(F.col("id") % 3 == 1, F.col("fact")).otherwise("unheard")
    return C.support_ratio(c.select("id", said.alias("text")), c)


@q("k07_record_set", "SELECT DISTINCT record_id FROM typed_records WHERE family_id = 'veltor_meridian900' AND component = 'antenna' ORDER BY 1")
def _(spark, d):
    return C.finished(table(spark, d, "typed_records").filter("family_id = 'veltor_meridian900' and component = 'antenna'"))


@q("k08_scalar_support", "SELECT min(n_regionkey)::VARCHAR AS value, string_agg(n_name, '|' ORDER BY n_name) AS record_ids FROM nation WHERE n_regionkey = 2")
def _(spark, d):
    n = table(spark, d, "nation").filter("n_regionkey = 2").withColumn("record_id", F.col("n_name"))
    return C.scalar_with_support(n, F.col("n_regionkey"))


@q("r31_path_pairs", f"WITH {K}, a AS (SELECT DISTINCT head, relation AS r1, tail AS mid FROM kg), b AS (SELECT DISTINCT head AS mid, relation AS r2 FROM kg) SELECT r1, r2, count(*) AS n FROM (SELECT DISTINCT head, r1, r2 FROM a JOIN b USING (mid)) GROUP BY 1, 2")
def _(spark, d):
    return C.path_pairs(D.triples(spark, d))


@q("r25_generated_questions", f"WITH {K} SELECT 'Where is ' || head || ' located?' AS question, string_agg(DISTINCT tail, '|' ORDER BY tail) AS answers FROM kg WHERE relation = 'locatedIn' GROUP BY 1")
def _(spark, d):
    return C.generated_questions(D.triples(spark, d), {"locatedIn": "Where is {h} located?"})


@q("f23_anchor_query", "SELECT record_id, value_text FROM typed_records WHERE family_id = 'veltor_meridian900' AND attribute = 'prf'")
def _(spark, d):
    return table(spark, d, "typed_records").filter((F.col("family_id") == "veltor_meridian900") & (F.col("attribute") == "prf")).select("record_id", "value_text")


@q("f26_isolated_find", "SELECT 'first' AS run, count(*) AS n FROM nation WHERE n_regionkey = 2 UNION ALL SELECT 'again', count(*) FROM nation WHERE n_regionkey = 2")
def _(spark, d):
    t = D.triples(spark, d)
    one = lambda: G.heads_with(t, "partOf", "ASIA").agg(F.count("*").alias("n"))
    return one().select(F.lit("first").alias("run"), "n").unionByName(one().select(F.lit("again").alias("run"), "n"))


@q("r22_diagnosis", f"WITH {K} SELECT 'partOf=Far East' AS leaf, count(DISTINCT head) AS n FROM kg WHERE relation = 'partOf' AND tail = 'ASIA' UNION ALL SELECT 'partOf=Nowhere', 0")
def _(spark, d):
    plan = {"op": "intersect", "args": [{"op": "constraint", "relation": "partOf", "value": v} for v in ("Far East", "Nowhere")]}
    return CO.diagnose(CO.Composer(D.triples(spark, d), D.aliases(spark)), plan)


@q("r23_step_plan", f"WITH {K} SELECT DISTINCT head AS entity FROM kg WHERE relation = 'locatedIn' AND tail IN (SELECT head FROM kg WHERE relation = 'partOf' AND tail IN ('ASIA', 'EUROPE'))")
def _(spark, d):
    steps = [{"name": "a", "op": "constraint", "relation": "partOf", "value": "Far East"}, {"name": "b", "op": "constraint", "relation": "partOf", "value": "EUROPE"}, {"name": "c", "op": "union", "args": ["$a", "$b"]}, {"name": "e", "foreach": "$c", "chain": ["locatedIn^-1"]}]
    return CO.run_steps(CO.Composer(D.triples(spark, d), D.aliases(spark)), steps)


@q("r17_parsed_program", "SELECT count(*) AS value FROM supplier WHERE s_nationkey = 7")
def _(spark, d):
    from cairn.queries.programs import kb

    return kb(spark, d).run(kopl.parse("Find(NATION_7) → Relate(located in, backward) → Count()"))


@q("x13_measure", "SELECT record_id, CAST(regexp_extract(value_text, '^(\\d+(\\.\\d+)?) ?(kW|MHz|GHz|kHz|km|kg|rpm|dBi|dB|NM)$', 1) AS DOUBLE) AS number, lower(regexp_extract(value_text, '^(\\d+(\\.\\d+)?) ?(kW|MHz|GHz|kHz|km|kg|rpm|dBi|dB|NM)$', 3)) AS unit FROM typed_records WHERE regexp_matches(value_text, '^(\\d+(\\.\\d+)?) ?(kW|MHz|GHz|kHz|km|kg|rpm|dBi|dB|NM)$')")
def _(spark, d):
    # the parser reads every form of figure; the SQL says what it must give for those printed as a plain number and a unit
    p = UN.figure_parts(F.col("value_text"))
    r = table(spark, d, "typed_records").filter(F.col("value_text").rlike(r"^\d+(\.\d+)? ?(kW|MHz|GHz|kHz|km|kg|rpm|dBi|dB|NM)$"))
    return r.select("record_id", UN.part_number(p[0]).alias("number"), UN.unit_key(UN.part_unit(p[0])).alias("unit"))


@q("x14_spec_numbers")
def _(spark, d):
    """Every document with its weight, power, pulse rate, range, year and status; tested on a fixture (the SQL engine's patterns lack look-behind)."""
    return table(spark, d, "documents").select("doc_id", UN.spec_values(F.col("text")).alias("s")).select("doc_id", "s.*").filter("text_kind is not null").drop("text_kind")


@q("x16_base_units", "SELECT 'W' AS base, 1000.0 AS by, count(*) AS n FROM typed_records WHERE unit = 'kW'")
def _(spark, d):
    u = table(spark, d, "typed_records").filter("unit = 'kW'")
    return u.groupBy(P.base_unit(F.col("unit")).alias("base"), P.factor(F.col("unit")).alias("by")).agg(F.count("*").alias("n"))


@q("x18_typed_values")
def _(spark, d):
    return table(spark, d, "typed_records").filter("value_text is not null").select("record_id", UN.typed_value(F.col("value_text")).alias("v")).select("record_id", "v.*")


# the forms that a plain pattern can read: bounds and approximations of a whole or decimal number with at most a word behind it
_PLAIN = "'^(≤ ?|up to |max\\. ?|not more than |≥ ?|min\\. ?|not less than |at least |at most |~ ?|约 ?|about |approx\\. ?)(\\d+(?:\\.\\d+)?) ?[A-Za-z°]{0,4}$'"


@q("x18_plain_forms", f"SELECT record_id, CASE WHEN regexp_matches(value_text, '^(~|约|about|approx)') THEN 'approximate' ELSE 'bound' END AS kind, CASE WHEN regexp_matches(value_text, '^(≤|up to|max|not more than|at most)') THEN '<=' WHEN regexp_matches(value_text, '^(≥|min|not less than|at least)') THEN '>=' END AS operator, CAST(regexp_extract(value_text, {_PLAIN}, 2) AS DOUBLE) AS figure FROM typed_records WHERE regexp_matches(value_text, {_PLAIN})")
def _(spark, d):
    r = table(spark, d, "typed_records").filter(F.col("value_text").rlike(_PLAIN.strip("'")))
    return r.select("record_id", UN.typed_value(F.col("value_text")).alias("v")).select("record_id", "v.kind", "v.operator", F.coalesce("v.value", "v.lower", "v.upper").alias("figure"))


@q("x31_json_path", "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def _(spark, d):
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"))


@q("x34_query_features", "SELECT id, len(regexp_extract_all(question, '\\d+')) AS n_numbers, contains(lower(question), 'compare') AS compares FROM questions")
def _(spark, d):
    return table(spark, d, "questions").select("id", F.size(F.regexp_extract_all("question", F.lit(r"\d+"), 0)).cast("long").alias("n_numbers"), F.contains(F.lower("question"), F.lit("compare")).alias("compares"))


# ---- files: written to a shared folder, read back
TRIPLE = {"head": "a", "head_type": "S", "relation": "r", "tail": "b", "tail_type": "T", "confidence": 0.5, "evidence": "e", "source": "s"}


def _json(spark, value):
    folder = shared_folder(spark, "json")
    spark.createDataFrame([(json.dumps(value),)], "value string").coalesce(1).write.text(folder)
    return folder


@q("s01_extraction_results", "SELECT 'r1' AS radar_id, 'a' AS head, 'r' AS relation, 'b' AS tail UNION ALL SELECT 'r1', 'a', 'r', 'c'")
def _(spark, d):
    p = _json(spark, [{"radar_id": "r1", "title": "t", "triples": [TRIPLE, TRIPLE | {"tail": "c"}]}, {"radar_id": "r2", "title": "u", "triples": []}])
    return cut(readers.extraction_results(spark, p).select("radar_id", "head", "relation", "tail"))


@q("s03_any_layout", "SELECT 'a' AS head, 'b' AS tail, 3::BIGINT AS n")
def _(spark, d):
    paths = [_json(spark, [TRIPLE]), _json(spark, [{"triples": [TRIPLE]}]), _json(spark, {"g": [TRIPLE]})]
    u = readers.any_layout(spark, paths[0]).unionByName(readers.any_layout(spark, paths[1])).unionByName(readers.any_layout(spark, paths[2]))
    return cut(u.groupBy("head", "tail").agg(F.count("*").alias("n")))


@q("s04_graph_sink", f"WITH {K} SELECT relation, count(*) AS n FROM kg GROUP BY 1")
def _(spark, d):
    t, folder = D.triples(spark, d), shared_folder(spark, "graph")
    readers.write_graph(table(spark, d, "nation"), t, folder)
    return spark.read.parquet(f"{folder}/edges").groupBy("relation").agg(F.count("*").alias("n"))


@q("s06_parquet_scan", "SELECT split, count(*) AS n FROM questions GROUP BY 1")
def _(spark, d):
    return table(spark, d, "questions").groupBy("split").agg(F.count("*").alias("n"))


@q("s07_strict_csv", "SELECT r_regionkey, r_name FROM region")
def _(spark, d):
    folder = shared_folder(spark, "csv")
    table(spark, d, "region").write.csv(folder, header=True)
    return readers.strict_csv(spark, folder, T_.StructType.fromDDL("r_regionkey int, r_name string"))


@q("s09_html_tables", "SELECT 1::BIGINT AS page_id, 0 AS row_no, 'a|b' AS cells UNION ALL SELECT 1, 1, '1|2'")
def _(spark, d):
    p = spark.createDataFrame([(1, "<table><tr><th>a</th><th>b</th></tr><tr><td>1</td><td><b>2</b></td></tr></table>")], "page_id long, html string")
    return readers.table_rows(p).select("page_id", "row_no", F.array_join("cells", "|").alias("cells"))


@q("h3_top_suppliers", "SELECT s_name, n_name, CAST(count(DISTINCT l_orderkey) AS BIGINT) AS n_orders FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY 1, 2")
def _(spark, d):
    li, s, n = (table(spark, d, x) for x in ("lineitem", "supplier", "nation"))
    j = li.select("l_orderkey", "l_suppkey").join(s, F.col("l_suppkey") == F.col("s_suppkey")).join(n, F.col("s_nationkey") == F.col("n_nationkey"))
    return j.groupBy("s_name", "n_name").agg(F.count_distinct("l_orderkey").alias("n_orders"))


QUERIES, SQL = q.queries, q.sql