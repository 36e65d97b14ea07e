"""The typed-table engine: Scan, Expand, Project, Join, Filter, Derive, Assess, Assemble over readings.

A table is a DataFrame of value columns and `evidence`, a map from column to the record ids behind it. A cell is
the struct typed_value (kind, value, lower, upper, lower_inclusive, upper_inclusive, operator, unit, text, options).
What a comparison cannot decide is an error, not a null: predicates are columns that raise at run time, and a
conjunction is a nested CASE, so a later predicate is reached only where the earlier ones hold.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Other names of a unit, and units with their base and factor.
UNIT_NAMES = {"°": "deg", "degrees": "deg", "degree": "deg", "°C": "degC", "C": "degC", "ft.": "ft", "VDC": "V DC", "V dc": "V DC", "Watts": "W", "%RH": "% RH"}
UNIT_FACTORS = {"W": ("W", 1.0), "kW": ("W", 1e3), "mW": ("W", 1e-3), "m": ("m", 1.0), "km": ("m", 1e3), "cm": ("m", 1e-2), "mm": ("m", 1e-3), "Hz": ("Hz", 1.0), "kHz": ("Hz", 1e3), "MHz": ("Hz", 1e6), "GHz": ("Hz", 1e9), "s": ("s", 1.0), "ms": ("s", 1e-3), "us": ("s", 1e-6), "ns": ("s", 1e-9)}


def _looked_up(key: Column, table: dict, default: Column) -> Column:
    m = F.create_map(*[x for k, v in table.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(m[key], default)


def unit_name(unit: Column) -> Column:
    return _looked_up(unit, UNIT_NAMES, unit)


def base_unit(unit: Column) -> Column:
    u = unit_name(unit)
    return F.coalesce(_looked_up(u, {k: v[0] for k, v in UNIT_FACTORS.items()}, u), F.lit(""))


def factor(unit: Column) -> Column:
    return _looked_up(unit_name(unit), {k: v[1] for k, v in UNIT_FACTORS.items()}, F.lit(1.0))


def _raise(message: str, type_: str = "boolean") -> Column:
    return F.raise_error(F.lit(message)).cast(type_)


def _ordered(a: Column, op: str, b: Column) -> Column:
    """Equality with room for the rounding of unit factors."""
    near = F.abs(a - b) <= F.greatest(F.abs(a), F.abs(b)) * 1e-12
    ops = {"==": near, "!=": ~near, "<": (a < b) & ~near, "<=": (a < b) | near, ">": (a > b) & ~near, ">=": (a > b) | near}
    if op not in ops:
        raise ValueError(f"no such comparison: {op}")
    return ops[op]


def compare(cell: Column, op: str, value: float, unit: str | None = None, bound_endpoint: bool = False) -> Column:
    """A numeric cell against a number; raises on other kinds and on units of another dimension."""
    kinds = ["number", "bound"] if bound_endpoint else ["number"]
    test = _ordered(cell["value"] * factor(cell["unit"]), op, F.lit(value) * factor(F.lit(unit)))
    return (
        F.when(~cell["kind"].isin(*kinds) | cell["kind"].isNull(), _raise("a comparison needs a number or an explicit bound"))
        .when(base_unit(cell["unit"]) != base_unit(F.lit(unit)), _raise("units of different dimensions"))
        .otherwise(test)
    )


def contains(cell: Column, value: float, unit: str | None = None) -> Column:
    """Whether the number lies in the cell: a span, a bound, a list or a number."""
    k = factor(cell["unit"])
    x = F.lit(value) * factor(F.lit(unit))
    low, high, v = cell["lower"] * k, cell["upper"] * k, cell["value"] * k
    inside = F.when(F.coalesce(cell["lower_inclusive"], F.lit(True)), _ordered(x, ">=", low)).otherwise(_ordered(x, ">", low)) & F.when(F.coalesce(cell["upper_inclusive"], F.lit(True)), _ordered(x, "<=", high)).otherwise(_ordered(x, "<", high))
    bound = reduce(lambda e, o: e.when(cell["operator"] == o, _ordered(x, o, v)), ["<", "<=", ">", ">="], F.when(F.lit(False), F.lit(False)))
    return (
        F.when(base_unit(cell["unit"]) != base_unit(F.lit(unit)), _raise("units of different dimensions"))
        .when(cell["kind"] == "range", inside).when(cell["kind"] == "bound", bound)
        .when(cell["kind"] == "options", F.exists(cell["options"], lambda o: _ordered(x, "==", o * k)))
        .when(cell["kind"] == "number", _ordered(x, "==", v))
        .otherwise(_raise("containment needs a numeric domain"))
    )


@dataclass(frozen=True)
class Predicate:
    column: str
    op: str
    value: object
    unit: str | None = None
    value_mode: str | None = None

    def column_of(self) -> Column:
        c = F.col(self.column)
        if self.op == "contains":
            return contains(c, float(self.value), self.unit)
        if self.op == "in":
            return c.isin(*self.value)
        if isinstance(self.value, str):
            return {"==": c == self.value, "!=": c != self.value}[self.op]
        return compare(c, self.op, float(self.value), self.unit, self.value_mode == "bound_endpoint")


def conjunction(predicates: Sequence[Predicate]) -> Column:
    """True where all hold; a predicate that may raise is reached only where those before it hold."""
    return reduce(lambda rest, p: F.when(p.column_of(), rest).otherwise(F.lit(False)), reversed(list(predicates)), F.lit(True))


def merged_evidence(e: Column) -> Column:
    """One map from a list of maps: the record ids of equal keys are joined, sorted, distinct."""
    keys = F.array_distinct(F.flatten(F.transform(e, F.map_keys)))
    return F.map_from_entries(F.transform(F.array_sort(keys), lambda k: F.struct(k, F.array_sort(F.array_distinct(F.flatten(F.filter(F.transform(e, lambda m: m[k]), lambda x: x.isNotNull())))))))


def distinct(t: DataFrame) -> DataFrame:
    """Equal rows become one with the evidence of all. Cells are equal as canonical JSON: 1 and 1.0 of a number are, "1" and 1 are not."""
    values = [c for c in t.columns if c != "evidence"]
    own = t.select(F.to_json(F.struct(*values)).alias("_k"), *t.columns)
    g = own.groupBy("_k").agg(*[F.first(c).alias(c) for c in values], F.collect_list("evidence").alias("_e"))
    return g.select(*values, merged_evidence(F.col("_e")).alias("evidence"))


def scan(readings: DataFrame, families=None, components=None, attributes=None, subjects=None, conditions=None, absent=None, explode_subjects: bool = False) -> DataFrame:
    """Readings that match all that is given, with evidence per column."""
    t = readings
    for column, wanted in (("family_id", families), ("component", components), ("attribute", attributes)):
        if wanted is not None:
            t = t.filter(F.col(column).isin(*wanted))
    if subjects is not None:
        t = t.filter(F.arrays_overlap("subjects", F.array(*map(F.lit, subjects))))
    for k, v in (conditions or {}).items():
        t = t.filter(F.array_contains(F.transform("typed_conditions_all", lambda c: F.concat_ws("\u0001", c["dimension"], c["value"])), f"{k}\u0001{v}"))
    for k in absent or []:
        t = t.filter(~F.coalesce(F.array_contains(F.col("typed_conditions_all.dimension"), k), F.lit(False)))
    cols = ["family_id", "component", "attribute", "typed_value"]
    if explode_subjects:
        t, cols = t.withColumn("subject", F.explode("subjects")), ["subject", *cols]
    ids = F.array("record_id")
    return t.select(*cols, F.create_map(*[x for c in cols for x in (F.lit(c), ids)]).alias("evidence"))


def expand(t: DataFrame, column: str, into: str) -> DataFrame:
    """One row per item of an array column; an empty array gives none."""
    return t.withColumn(into, F.explode(column)).withColumn("evidence", F.map_concat("evidence", F.map_from_arrays(F.array(F.lit(into)), F.array(F.coalesce(F.col("evidence")[column], F.array().cast("array<string>"))))))


def project(t: DataFrame, columns: dict[str, str], keep_duplicates: bool = False) -> DataFrame:
    """New columns from dotted paths; equal rows merge their evidence."""
    e = F.map_from_arrays(F.array(*[F.lit(n) for n in columns]), F.array(*[F.coalesce(F.col("evidence")[p.split(".")[0]], F.array().cast("array<string>")) for p in columns.values()]))
    out = t.select(*[F.col(p).alias(n) for n, p in columns.items()], e.alias("evidence"))
    return out if keep_duplicates else distinct(out)


def filter_(t: DataFrame, predicates: Sequence[Predicate], negate: bool = False) -> DataFrame:
    c = conjunction(predicates)
    return t.filter(~c if negate else c)


def derive(t: DataFrame, columns: dict[str, Predicate]) -> DataFrame:
    """Boolean columns from predicates; their evidence is that of the column they look at."""
    out = t
    for n, p in columns.items():
        out = out.withColumn(n, p.column_of()).withColumn("evidence", F.map_concat("evidence", F.map_from_arrays(F.array(F.lit(n)), F.array(F.coalesce(F.col("evidence")[p.column.split(".")[0]], F.array().cast("array<string>"))))))
    return out


def join(a: DataFrame, b: DataFrame, on: Sequence[str]) -> DataFrame:
    """Natural join: other shared columns must agree, else it raises; equal rows merge their evidence."""
    shared = [c for c in a.columns if c in b.columns and c not in (*on, "evidence")]
    right = b.select(*on, *[F.col(c).alias(f"_r_{c}") for c in b.columns if c not in on])
    j = a.join(right, list(on))
    for c in shared:
        same = F.to_json(F.struct(F.col(c).alias("v"))) == F.to_json(F.struct(F.col(f"_r_{c}").alias("v")))
        j = j.withColumn(c, F.when(same, F.col(c)).otherwise(F.raise_error(F.lit(f"column {c} differs")).cast(a.schema[c].dataType)))
    only = [c for c in b.columns if c not in (*on, *shared, "evidence")]
    out = j.select(*[c for c in a.columns if c != "evidence"], *[F.col(f"_r_{c}").alias(c) for c in only], merged_evidence(F.array("evidence", "_r_evidence")).alias("evidence"))
    return distinct(out)


def assess_same_value(t: DataFrame, column: str) -> DataFrame:
    """status, all_equal: whether all cells of a column are equal after unit scaling."""
    c = F.col(column)
    key = F.when(c["kind"] == "number", F.concat_ws(" ", F.format_string("%.12e", c["value"] * factor(c["unit"])), base_unit(c["unit"]))).otherwise(F.to_json(c))
    units = F.count_distinct(F.when(c["kind"] == "number", base_unit(c["unit"])))
    equal = F.when(units > 1, _raise("units of different dimensions")).otherwise(F.count_distinct(key) <= 1)
    return t.agg(F.when(F.count("*") == 0, "not_established").otherwise("established").alias("status"), F.when(F.count("*") > 0, equal).alias("all_equal"))


def assess_listed_domain(t: DataFrame, column: str) -> DataFrame:
    """options: the distinct numbers a column lists; raises where a cell is no number."""
    c = F.col(column)
    v = F.when(c["kind"] == "number", F.concat_ws(" ", c["value"].cast("string"), c["unit"])).otherwise(F.raise_error(F.lit("a listed domain needs numbers")).cast("string"))
    return t.agg(F.array_sort(F.collect_set(v)).alias("options"))


def assess_joint_support(t: DataFrame, parameter: str, domain: str, requested: dict[str, tuple[float, str | None]]) -> DataFrame:
    """parameter, supported: each requested number against its own domain; joint support is never claimed."""
    own = F.when(F.lit(False), F.lit(False))
    for name, (value, unit) in requested.items():
        own = own.when(F.col(parameter) == name, contains(F.col(domain), value, unit))
    return t.filter(F.col(parameter).isin(*requested)).select(F.col(parameter).alias("parameter"), own.alias("supported"))


def assemble(tables: dict[str, DataFrame]) -> DataFrame:
    """output, record_id: the records each output rests on."""
    parts = [t.select(F.lit(n).alias("output"), F.explode(F.flatten(F.map_values("evidence"))).alias("record_id")).distinct() for n, t in tables.items()]
    return reduce(DataFrame.unionByName, parts)
