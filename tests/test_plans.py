"""Errors, limits and invariants of the plan languages and operators."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from cairn.operators import checks as C
from cairn.operators import evaluation as E
from cairn.operators import fusion as U
from cairn.operators import graph as G
from cairn.plans import composition as CO
from cairn.plans import kopl
from cairn.plans import table_program as P


@pytest.fixture(scope="module")
def kg(spark):
    rows = [("a", "on", "x", 0.9), ("a", "on", "y", 0.8), ("b", "on", "x", 0.7), ("c", "on", "z", None), ("a", "mass", "about 12 kg", 0.9), ("b", "mass", "9 kg", 0.9), ("b", "mass", "n/a", 0.9), ("b", "self", "b", 1.0), (None, "on", "x", 0.1), ("d", "on", None, 0.1)]
    return spark.createDataFrame(rows, "head string, relation string, tail string, confidence double")


@pytest.fixture(scope="module")
def names(spark):
    return spark.createDataFrame([("ex", "q", 0), ("ex", "x", 1)], "surface string, canonical string, priority int")


def vals(df):
    return sorted(r[0] for r in df.collect())


def test_alias_is_first_hit_not_union(kg, names):
    assert vals(G.constraint(kg, "on", "ex", names)) == ["a", "b"]


def test_equivalent_only_when_empty(kg, names):
    assert vals(G.constraint(kg, "under", "x", names, [("under", "on")])) == ["a", "b"]


def test_aggregate_is_mean_of_means_with_coverage(kg, spark):
    r = G.aggregate(kg, spark.createDataFrame([("a",), ("b",), ("c",)], "entity string"), "mass", "avg").first()
    assert (r.value, r.n_set, r.n_covered) == (10.5, 3, 2)
    with pytest.raises(ValueError):
        G.aggregate(kg, kg.select(F.col("head").alias("entity")), "mass", "mode")


def test_expansion_ends_and_keeps_first_hop(kg, spark):
    k = {(r.head, r.tail): r.hop for r in G.k_hop(kg, spark.createDataFrame([("a",)], "entity string"), 3).collect()}
    assert k[("a", "x")] == 1 and k[("b", "x")] == 2


@pytest.mark.parametrize("plan", [{}, {"op": "nope"}, {"op": "intersect", "args": [{"op": "count", "arg": {"op": "constraint", "relation": "r", "value": "v"}}]}, {"op": "path"}, {"op": "aggregate", "over": {"op": "path", "start": "a"}, "attribute": "m", "func": "mode"}, {"op": "difference", "args": []}])
def test_bad_plans_raise_before_running(plan):
    with pytest.raises(CO.PlanError):
        CO.check(plan)


def test_empty_intersection_is_not_identical(kg, names):
    r = CO.Composer(kg, names).run({"op": "compare", "a": "a", "b": "b", "relation": "none"}).first()
    assert r.identical is False


@pytest.mark.parametrize("functions", [["Count"], ["Find", "And"], ["Find", "Find"], ["Find", "Nope"], ["Find", "Count", "Relate"]])
def test_bad_programs_raise(functions):
    with pytest.raises(kopl.ProgramError):
        kopl.dependencies(functions)


def test_program_text_round_trip():
    text = "Find(a) → Relate(on, forward) → Find(b) → And() → Count()"
    assert kopl.serialise(kopl.parse(text)) == text
    assert kopl.dependencies(["Find", "Relate", "Find", "And", "Count"]) == [[], [0], [], [1, 2], [3]]
    m = kopl.mutations(kopl.parse("Find(a) → Count()"), {"a": ["a", "b"]})
    assert [kopl.serialise(x) for x in m] == ["Find(b) → Count()"]


def test_program_text_with_brackets_and_commas():
    step = lambda f, *a: {"function": f, "inputs": list(a)}
    assert kopl.parse("Find(AN/SPY-1D(V)) → Count()") == [step("Find", "AN/SPY-1D(V)"), step("Count")]
    assert kopl.parse("Find(Washington, D.C.) → QueryAttr(area)")[0] == step("Find", "Washington, D.C.")
    assert kopl.parse("Find <arg> a → b, c(d) <func> QueryAttr <arg> area")[0] == step("Find", "a → b, c(d)")
    odd = [step("Find", "a, b → c\\ (d))"), step("QueryAttrQualifier", "x, y", "→", "z)"), step("VerifyStr", "(,")]
    assert kopl.parse(kopl.serialise(odd)) == odd == kopl.parse(kopl.serialise(odd, delimiters=True))
    with pytest.raises(kopl.ProgramError):
        kopl.serialise([step("Find", "a <arg> b"), step("Count")], delimiters=True)


@pytest.mark.parametrize("text", ["Find(a) → Relate(on, sideways) → Count()", "Find(a)", "Find(a) → QFilterStr(k, v) → Count()", "Find(a) → Count() → VerifyStr(3)", "Find(a) → SelectAmong(size, tallest)", "Find(a) → FilterNum(size, 3 m, ~) → Count()", "Find(a) → What() → What()", "Find(a) Count()", "", "Find(a) → QueryAttr()"])
def test_programs_that_mean_nothing_are_refused(text):
    with pytest.raises(kopl.ProgramError):
        kopl.parse(text)


def test_concepts_at_every_level(spark):
    concepts = [(f"c{i}", f"level {i}", f"c{i - 1}" if i else None) for i in range(7)] + [("x", "ring", "y"), ("y", "ring two", "x")]
    kb = kopl.KB(
        spark.createDataFrame([(f"e{i}", f"thing {i}") for i in range(7)], "entity_id string, name string"), spark.createDataFrame(concepts, "concept_id string, name string, parent_id string"),
        spark.createDataFrame([(f"e{i}", f"c{i}") for i in range(7)], "entity_id string, concept_id string"), None, None,
    )
    count = lambda name: kb.run([{"function": "FindAll"}, {"function": "FilterConcept", "inputs": [name]}, {"function": "Count"}]).first().value
    assert [count("level 0"), count("level 5"), count("ring"), count("none")] == [7, 2, 0, 0]


def test_repair_changes_one_word_of_its_role():
    schema = {"relation": {"located in", "part of"}, "attribute": {"area", "located at"}}
    like = lambda a, b: len(set(a) & set(b)) / len(set(a) | set(b))
    fix = lambda t: kopl.serialise(kopl.repaired(kopl.parse(t), schema, like))
    assert fix("Find(a) → Relate(locatd in, forward) → Count()") == "Find(a) → Relate(located in, forward) → Count()"
    for same in ("Find(a) → Relate(part of, forward) → Count()", "Find(a) → Relate(prt of, forward) → QueryAttr(aera)"):
        assert fix(same) == same


CELL = "struct<kind: string, value: double, lower: double, upper: double, lower_inclusive: boolean, upper_inclusive: boolean, operator: string, unit: string, text: string, options: array<double>>"


def cells(spark, *rows):
    return spark.createDataFrame([(c, {"v": [f"r{i}"]}) for i, c in enumerate(rows)], f"v {CELL}, evidence map<string, array<string>>")


NUM, WATT = ("number", 4.0, None, None, None, None, None, "kW", None, None), ("number", 4000.0, None, None, None, None, None, "W", None, None)
BOUND, RANGE = ("bound", 4.0, None, None, None, None, "<", "kW", None, None), ("range", None, 1.0, 2.0, True, False, None, "kW", None, None)
METRE, TEXT = ("number", 4.0, None, None, None, None, None, "m", None, None), ("text", None, None, None, None, None, None, None, "four", None)


def test_units_scale_and_ranges_close(spark):
    t = cells(spark, NUM, WATT)
    assert P.filter_(t, [P.Predicate("v", "==", 4.0, "kW")]).count() == 2
    r = cells(spark, RANGE)
    assert P.filter_(r, [P.Predicate("v", "contains", 1000.0, "W")]).count() == 1
    assert P.filter_(r, [P.Predicate("v", "contains", 2.0, "kW")]).count() == 0
    assert P.filter_(cells(spark, BOUND), [P.Predicate("v", "contains", 3.0, "kW")]).count() == 1


@pytest.mark.parametrize("bad", [METRE, BOUND, RANGE, TEXT])
def test_undecidable_comparisons_raise(spark, bad):
    with pytest.raises(PySparkException):
        P.filter_(cells(spark, bad), [P.Predicate("v", "<", 5.0, "kW")]).count()


def test_conjunction_stops_early(spark):
    assert P.filter_(cells(spark, TEXT, NUM), [P.Predicate("v.kind", "==", "number"), P.Predicate("v", ">", 1.0, "kW")]).count() == 1


def test_join_conflict_raises(spark):
    t = lambda x: spark.createDataFrame([("k", x, {"k": ["r"]})], "k string, c string, evidence map<string, array<string>>")
    assert P.join(t("1"), t("1"), ["k"]).count() == 1
    with pytest.raises(PySparkException):
        P.join(t("1"), t("2"), ["k"]).collect()


def test_distinct_joins_evidence(spark):
    t = spark.createDataFrame([("k", {"k": ["b"]}), ("k", {"k": ["a"]})], "k string, evidence map<string, array<string>>")
    assert P.distinct(t).first().evidence == {"k": ["a", "b"]}


def test_scored_join_needs_all_ids(spark):
    g, p = spark.createDataFrame([(1, "x"), (2, "y")], "id long, answer string"), spark.createDataFrame([(1, "x")], "id long, prediction string")
    with pytest.raises(PySparkException):
        C.scored_join(g, p).count()
    with pytest.raises(PySparkException):
        C.materialised(spark.createDataFrame([("q",)], "record_id string"), spark.createDataFrame([("r", 1)], "record_id string, n int")).count()


def test_components_by_brute_force(spark):
    pairs = [(i, i + 1) for i in range(0, 40) if i % 7] + [(100, 101), (101, 102), (102, 100)]
    got = {r.node: r.component for r in U.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    label = {x: x for p in pairs for x in p}
    for _ in range(50):
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
    assert got == label


def test_ranks_are_pessimistic_on_ties(spark):
    s = spark.createDataFrame([("q", c, "t", 1.0) for c in "abt"], "query string, cand string, target string, score double")
    k = spark.createDataFrame([("q", "t"), ("q", "b")], "query string, cand string")
    assert E.filtered_ranks(s, k).first()["rank"] == 2


def test_bootstrap_is_repeatable_and_covers(spark):
    df = spark.range(400).select(F.col("id"), (F.col("id") % 10).alias("x"))
    a, b = E.bootstrap(df, "x").first(), E.bootstrap(df.repartition(5), "x").first()
    assert a == b and a.low < a["mean"] < a.high and a.high - a.low < 1.5


def test_empty_inputs(spark, kg, names):
    none = kg.limit(0)
    assert G.k_hop(none, spark.createDataFrame([], "entity string"), 2).count() == 0
    assert U.components(spark.createDataFrame([], "a long, b long")).count() == 0
    assert CO.Composer(none, names).run({"op": "count", "arg": {"op": "path", "start": "a", "chain": ["on"]}}).first()["value"] == 0
