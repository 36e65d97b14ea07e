"""Queries of the general training-data operators (problems 1 and 3)."""

from __future__ import annotations

from cairn.operators import unit_harmoniser, wide_table
from cairn.session import table


def p1_found(spark, d):
    return unit_harmoniser.records_to_change(table(spark, d, "typed_records"), table(spark, d, "attr_schema"))


def p1_readings(spark, d):
    return unit_harmoniser.harmonise(table(spark, d, "typed_records"), table(spark, d, "attr_schema"))


def p1_conversions(spark, d):
    r = unit_harmoniser.readings(table(spark, d, "typed_records"), table(spark, d, "attr_schema"))
    return unit_harmoniser.conversions(unit_harmoniser.first_figures(r), table(spark, d, "attr_schema"))


def p3_found(spark, d):
    return wide_table.differing_cells(*(table(spark, d, t) for t in ("typed_records", "wikidata_enrich_out", "attr_schema")))


def p3_wide(spark, d):
    return wide_table.wide(*(table(spark, d, t) for t in ("typed_records", "wikidata_enrich_out", "attr_schema")))


QUERIES = {"p1_found": p1_found, "p1_readings": p1_readings, "p1_conversions": p1_conversions, "p3_found": p3_found, "p3_wide": p3_wide}
SQL: dict[str, str] = {}
