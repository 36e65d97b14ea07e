"""Printed quantities against hand-made expectations."""

import pytest
from pyspark.sql import functions as F

from cairn.functions import units as U

CASES = [
    ("9,370 MHz", [9370.0], ["mhz"]), ("81,82 mph", [81.82], ["mph"]), ("17 800 m", [17800.0], ["m"]), ("0,277 kV", [277.0], ["kv"]),
    ("-45 to 60 °C", [-45.0, 60.0], ["", "°c"]), ("from -25 up to 55 °C", [-25.0, 55.0], ["", "°c"]), ("-31 °F to 113 °F", [-31.0, 113.0], ["°f", "°f"]),
    ("-45...45 degC", [-45.0, 45.0], ["", "degc"]), ("248.15–328.15 K", [248.15, 328.15], ["", "K"]), ("8120-9183 MHz", [8120.0, 9183.0], ["", "mhz"]), ("-35 - 60 C", [-35.0, 60.0], ["", "c"]),
    ("917 MHz to 1.05 GHz", [917.0, 1.05], ["mhz", "ghz"]), ("0.75; 1.5; 3 NM", [0.75, 1.5, 3.0], ["", "", "nm"]), ("0.75, 1.5, 3 NM", [0.75, 1.5, 3.0], ["", "", "nm"]), ("12 / 24 km", [12.0, 24.0], ["", "km"]),
    ("7.64 x 10^-8 sec", [7.64e-8], ["sec"]), ("2.3e-05", [2.3e-5], [""]), ("6.64 x10^3 MHz", [6.64], ["k@mhz"]), ("7.95 10^2 MHz", [7.95], ["h@mhz"]), ("4.12 x100 Hz", [4.12], ["h@hz"]), ("0.356 10³ m", [0.356], ["k@m"]), ("1.7 thousand m", [1.7], ["k@m"]),
    ("100 Hz", [100.0], ["hz"]), ("1000 m", [1000.0], ["m"]), ("9-ft 6-in", [9.5], ["ft"]), ("9' 6\"", [9.5], ["ft"]), ("9 ft 6 in", [9.5], ["ft"]), ("9 feet 6 inches", [9.5], ["ft"]),
    ("约490 kg (0.49 tonnes)", [490.0], ["kg"]), ("36 dB(i)", [36.0], ["db(i)"]), ("5 seconds per revolution", [5.0], ["seconds per revolution"]), ("4 m per data plate", [4.0], ["m"]), ("beam width: 9.9 °", [9.9], ["°"]),
    ("≤ 0.17453 rad; option B", [0.17453], ["rad"]), ("12 mW", [12.0], ["mW"]), ("12 MW", [12.0], ["MW"]), ("500 m ASL", [500.0], ["m asl"]), ("40 kW peak", [40.0], ["kw"]), ("9 MHz, measured", [9.0], ["mhz"]),
]


@pytest.fixture(scope="module")
def parsed(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(CASES)], "i int, t string")
    p = F.filter(U.figure_parts(F.col("t")), lambda x: x.rlike(r"\d"))
    out = df.select("i", F.transform(p, U.part_number).alias("n"), F.transform(p, lambda x: F.coalesce(U.unit_key(U.part_unit(x)), F.lit(""))).alias("u")).collect()
    return {r.i: (r.n, r.u) for r in out}


@pytest.mark.parametrize("i", range(len(CASES)))
def test_printed(parsed, i):
    text, numbers, units = CASES[i]
    n, u = parsed[i]
    assert n == pytest.approx(numbers, rel=1e-9), text
    assert u == units, text


def test_known_conversions_are_consistent():
    k = U.known_names()
    assert len({r[0] for r in k}) == len(k) < 400
    to = {r[0]: r[2:] for r in U.conversions_to("kW")}
    assert to["w"] == ("id", 0.001, 0.0) and to["dbm"] == ("pow10", 1e-6, 0.0)
    assert U.conversions_to("furlongs") == []


# text -> kind, value, lower, upper, operator, options, unit
VALUES = [
    ("185 km", "number", 185.0, None, None, None, None, "km"), ("−40 °C", "number", -40.0, None, None, None, None, "°c"), ("9,370 MHz", "number", 9370.0, None, None, None, None, "mhz"), ("81,82 mph", "number", 81.82, None, None, None, None, "mph"),
    ("≤ 4 kW", "bound", None, None, 4.0, "<=", None, "kw"), ("not less than 250 Hz", "bound", None, 250.0, None, ">=", None, "hz"), ("more than 12 NM", "bound", None, 12.0, None, ">", None, "nm"), ("不超过50 kg", "bound", None, None, 50.0, "<=", None, "kg"), ("power: max. 7 kW", "bound", None, None, 7.0, "<=", None, "kw"), ("< 3 dB", "bound", None, None, 3.0, "<", None, "db"),
    ("-45 to 60 °C", "range", None, -45.0, 60.0, None, None, "°c"), ("8120-9183 MHz", "range", None, 8120.0, 9183.0, None, None, "mhz"), ("1050…917 MHz", "range", None, 917.0, 1050.0, None, None, "mhz"),
    ("24 ± 2 V", "range", None, 22.0, 26.0, None, None, "v"), ("200 V ± 10 %", "range", None, 180.0, 220.0, None, None, "v"), ("50 +/- 5 Hz", "range", None, 45.0, 55.0, None, None, "hz"),
    ("0.75; 1.5; 3 NM", "options", None, None, None, None, [0.75, 1.5, 3.0], "nm"), ("12 / 24 km", "options", None, None, None, None, [12.0, 24.0], "km"), ("1, 2, 4 km", "options", None, None, None, None, [1.0, 2.0, 4.0], "km"),
    ("2.4 x 1.2 m", "pair", None, None, None, None, [2.4, 1.2], "m"), ("约490 kg (0.49 tonnes)", "approximate", 490.0, None, None, None, None, "kg"), ("approx. 12 m", "approximate", 12.0, None, None, None, None, "m"), ("~3 dB", "approximate", 3.0, None, None, None, None, "db"),
    ("n/a", "text", None, None, None, None, None, None), ("", "text", None, None, None, None, None, None), (None, "text", None, None, None, None, None, None), ("sector scan", "text", None, None, None, None, None, None), ("7", "number", 7.0, None, None, None, None, None),
]


def test_typed_values(spark):
    df = spark.createDataFrame([(i, v[0]) for i, v in enumerate(VALUES)], "i int, t string").select("i", U.typed_value(F.col("t")).alias("v"))
    for r in df.collect():
        want, v = VALUES[r.i], r.v
        got = (v.kind, v.value, v.lower, v.upper, v.operator, v.options, v.unit)
        assert all(a == b or (isinstance(b, float) and a == pytest.approx(b)) for a, b in zip(got, want[1:])), (want, got)


def test_typed_values_agree_with_the_table(spark, data):
    """The kinds of the given readings: those printed as they were typed come out as typed."""
    t = spark.read.parquet(f"{data.replace('sf0.001', 'sf0.01')}/typed_records.parquet").filter("value_text is not null and typed_value.kind in ('number', 'range', 'options', 'bound', 'approximate')")
    n, same = t.select((U.typed_value(F.col("value_text"))["kind"] == F.col("typed_value.kind")).alias("ok")).agg(F.count("*"), F.count_if("ok")).first()
    assert n > 1000 and same >= 0.9 * n


SPECS = [
    ("The set, weighing 21 kg, entered service in 1987 and was withdrawn later.", (21.0, None, None, None, 1987, "retired")), ("A peak power of 1.5 MW and a prf of 2 kHz; its range is 12 NM.", (None, 1500.0, 2000.0, 22.224, None, None)),
    ("该雷达于1995年服役，重量为1,200 kg。", (1200.0, None, None, None, 1995, None)), ("The mass is 3 tonnes. The set is still in service.", (3000.0, None, None, None, None, "active")), ("Nothing is stated here about 12 things.", (None,) * 6), (None, (None,) * 6),
]


def test_spec_values(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(SPECS)], "i int, t string").select("i", U.spec_values(F.col("t")).alias("s"))
    for r in df.collect():
        got = (r.s.weight_kg, r.s.power_kw, r.s.prf_hz, r.s.range_km, r.s.year, r.s.status)
        want = SPECS[r.i][1]
        assert all(a == b or (isinstance(b, float) and a == pytest.approx(b)) for a, b in zip(got, want)), (SPECS[r.i], got)
        assert (r.s.text_kind is None) == all(x is None for x in want)
