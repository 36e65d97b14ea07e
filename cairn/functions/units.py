"""Printed quantities: numbers, spans, units and the known conversions.

Everything here is a Column expression, so parsing stays in generated code.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Known units. (name, dimension, view, scale, offset): the number in the
# dimension's base unit is scale * view(x) + offset, view one of id, recip (1/x), pow10 (10^(x/10)).
KNOWN_UNITS = [
    ("W", "power", "id", 1.0, 0.0), ("kW", "power", "id", 1e3, 0.0), ("MW", "power", "id", 1e6, 0.0),
    ("GW", "power", "id", 1e9, 0.0), ("mW", "power", "id", 1e-3, 0.0), ("µW", "power", "id", 1e-6, 0.0),
    ("dBW", "power", "pow10", 1.0, 0.0), ("dBm", "power", "pow10", 1e-3, 0.0), ("dBkW", "power", "pow10", 1e3, 0.0),
    ("hp", "power", "id", 745.6998715822702, 0.0),
    ("Hz", "rate", "id", 1.0, 0.0), ("kHz", "rate", "id", 1e3, 0.0), ("MHz", "rate", "id", 1e6, 0.0),
    ("GHz", "rate", "id", 1e9, 0.0), ("THz", "rate", "id", 1e12, 0.0),
    ("rpm", "rotation", "id", 1.0, 0.0), ("rps", "rotation", "id", 60.0, 0.0), ("rph", "rotation", "id", 1 / 60, 0.0),
    ("°/s", "rotation", "id", 1 / 6, 0.0), ("rad/s", "rotation", "id", 9.549296585513721, 0.0),
    ("s/rev", "rotation", "recip", 60.0, 0.0), ("min/rev", "rotation", "recip", 1.0, 0.0),
    ("m", "length", "id", 1.0, 0.0), ("km", "length", "id", 1e3, 0.0), ("cm", "length", "id", 1e-2, 0.0),
    ("mm", "length", "id", 1e-3, 0.0), ("dm", "length", "id", 0.1, 0.0), ("in", "length", "id", 0.0254, 0.0),
    ("ft", "length", "id", 0.3048, 0.0), ("yd", "length", "id", 0.9144, 0.0), ("kft", "length", "id", 304.8, 0.0),
    ("kyd", "length", "id", 914.4, 0.0), ("mi", "length", "id", 1609.344, 0.0), ("NM", "length", "id", 1852.0, 0.0),
    ("fathom", "length", "id", 1.8288, 0.0), ("FL", "length", "id", 30.48, 0.0),
    ("g", "mass", "id", 1e-3, 0.0), ("kg", "mass", "id", 1.0, 0.0), ("mg", "mass", "id", 1e-6, 0.0),
    ("t", "mass", "id", 1e3, 0.0), ("lb", "mass", "id", 0.45359237, 0.0), ("oz", "mass", "id", 0.028349523125, 0.0),
    ("cwt", "mass", "id", 50.80234544, 0.0), ("short ton", "mass", "id", 907.18474, 0.0), ("long ton", "mass", "id", 1016.0469088, 0.0),
    ("s", "time", "id", 1.0, 0.0), ("ms", "time", "id", 1e-3, 0.0), ("μs", "time", "id", 1e-6, 0.0),
    ("ns", "time", "id", 1e-9, 0.0), ("ps", "time", "id", 1e-12, 0.0), ("min", "time", "id", 60.0, 0.0), ("h", "time", "id", 3600.0, 0.0),
    ("°", "angle", "id", 1.0, 0.0), ("rad", "angle", "id", 57.29577951308232, 0.0), ("mrad", "angle", "id", 0.05729577951308232, 0.0),
    ("arcmin", "angle", "id", 1 / 60, 0.0), ("arcsec", "angle", "id", 1 / 3600, 0.0), ("gon", "angle", "id", 0.9, 0.0), ("mil", "angle", "id", 0.05625, 0.0),
    ("°C", "temperature", "id", 1.0, 0.0), ("K", "temperature", "id", 1.0, -273.15), ("°F", "temperature", "id", 5 / 9, -160 / 9), ("°R", "temperature", "id", 5 / 9, -273.15),
    ("kn", "speed", "id", 1.0, 0.0), ("km/h", "speed", "id", 1 / 1.852, 0.0), ("m/s", "speed", "id", 3600 / 1852, 0.0),
    ("mph", "speed", "id", 1.609344 / 1.852, 0.0), ("ft/s", "speed", "id", 0.3048 * 3600 / 1852, 0.0), ("ft/min", "speed", "id", 0.3048 * 60 / 1852, 0.0),
    ("V", "voltage", "id", 1.0, 0.0), ("kV", "voltage", "id", 1e3, 0.0), ("mV", "voltage", "id", 1e-3, 0.0), ("MV", "voltage", "id", 1e6, 0.0), ("µV", "voltage", "id", 1e-6, 0.0),
    ("dBi", "gain", "id", 1.0, 0.0), ("dBd", "gain", "id", 1.0, 2.15),
    ("dB", "ratio", "id", 1.0, 0.0), ("Np", "ratio", "id", 8.685889638, 0.0),
]

# Other spellings, compared without case unless the spelling holds an upper-case letter of meaning.
SPELLINGS = {
    "W": "w watt watts", "kW": "kw kilowatt kilowatts", "MW": "megawatt megawatts", "mW": "milliwatt milliwatts", "GW": "gigawatt gigawatts", "dBW": "dbw", "dBm": "dbm",
    "Hz": "hz hertz c/s pps pulses/s cps cycles/s", "kHz": "khz kilohertz kc/s kpps kcps", "MHz": "mhz megahertz mc/s", "GHz": "ghz gigahertz gc/s",
    "rpm": "rpm r/min rev/min revs/min 1/min", "rps": "rps rev/s r/s revs/s", "°/s": "°/s deg/s degrees/s", "s/rev": "s/rev s/r sec/rev|seconds per revolution|seconds/revolution",
    "m": "m metre metres meter meters mtr mtrs masl|m asl|m amsl", "km": "km kms kilometre kilometres kilometer kilometers", "cm": "cm centimetre centimetres centimeter centimeters", "mm": "mm millimetre millimetres millimeter millimeters",
    "in": "in in. inch inches \"", "ft": "ft ft. foot feet '", "yd": "yd yd. yds yard yards", "kyd": "kyd kyds", "kft": "kft", "mi": "mi mile miles|statute miles|statute mile", "NM": "nm nmi n.mi. nmile|n mile|n miles|nautical mile|nautical miles|naut mi",
    "g": "g gram grams gm", "kg": "kg kgs kilogram kilograms kilogramme kilogrammes", "t": "t tonne tonnes|metric ton|metric tons", "lb": "lb lb. lbs lbs. pound pounds", "oz": "oz ounce ounces",
    "s": "s sec sec. secs second seconds", "ms": "ms msec msecs millisecond milliseconds", "μs": "μs µs us usec μsec µsec microsec microsecond microseconds", "ns": "ns nsec nanosecond nanoseconds",
    "°": "° deg deg. degree degrees", "rad": "rad rads radian radians", "mrad": "mrad milliradian milliradians", "arcmin": "arcmin arcminute arcminutes|arc minutes|arc minute|arc min", "arcsec": "arcsec arcsecond arcseconds|arc seconds",
    "°C": "°c c degc ℃ celsius|deg c|degrees c|degree c", "°F": "°f f degf ℉ fahrenheit|deg f|degrees f", "K": "k kelvin kelvins",
    "kn": "kn kt kts knot knots", "km/h": "km/h kmh kph", "m/s": "m/s mps", "mph": "mph mi/h", "ft/s": "ft/s fps",
    "V": "v volt volts vdc vac|v dc|v ac", "kV": "kv kilovolt kilovolts", "mV": "mv millivolt millivolts",
    "dBi": "dbi db(i)", "dBd": "dbd db(d)", "dB": "db decibel decibels",
}

_CASED = {"mW", "MW", "K", "mV", "MV", "GW"}
_SCALES = {"h@": 1e2, "k@": 1e3, "m@": 1e6}


def known_names() -> list[tuple[str, str, str, float, float, str]]:
    """(unit_key, dimension, view, scale, offset, unit_name) of every known name of a unit: under 300 rows by construction."""
    rows = []
    for name, dim, view, scale, offset in KNOWN_UNITS:
        words, *phrases = SPELLINGS.get(name, "" if name in _CASED else f"|{name.lower()}").split("|")
        keys = {name.replace("µ", "μ"), *words.split(), *phrases} - {""}
        rows += [(k, dim, view, scale, offset, name) for k in sorted(keys)]
    return rows


def key_of(unit: str) -> str:
    """unit_key of a plain name."""
    key = re.sub(r"\s+", " ", unit.strip().replace("µ", "μ"))
    return key if key in _CASED else key.lower()


def conversions_to(unit: str) -> list[tuple[str, str, str, float, float]]:
    """(unit_key, unit_name, view, scale, offset): every known unit of the dimension expressed in the given one; none if it is unknown."""
    key = key_of(unit)
    own = next((r for r in known_names() if r[0] == key and r[2] == "id"), None)
    if own is None:
        return []
    return [(k, name, view, scale / own[3], (offset - own[4]) / own[3]) for k, dim, view, scale, offset, name in known_names() if dim == own[1]]


FIGURE = r"-?\d+(?:\.\d+)?(?:e[+-]?\d+)?"


def even_scales(text: Column) -> Column:
    """Number notation "a x 10^-n" becomes "ae-n"; a scale before a unit becomes h@, k@ or m@."""
    t = F.regexp_replace(text, r"(?<=\d)(?:\s+[x×]\s+10\^([+-]?\d+)|\s*[x×]?\s*10\^(-\d+))", "e$1$2")
    for mark, power, words in (("h@", "10\\^2|10²", "100|hundreds?(?: of)?"), ("k@", "10\\^3|10³", "1000|thousands?(?: of)?"), ("m@", "10\\^6|10⁶", "1000000|millions?(?: of)?")):
        figures, word = words.split("|")
        t = F.regexp_replace(t, rf"(^|\s|(?<=\d))(?:[x×]\s?(?:{power}|{figures})|{power}|{word}(?=\s))\s*(?=[\p{{L}}°])", f"$1{mark}")
    return t


def even_numbers(text: Column) -> Column:
    """Plain notation: a comma before exactly three digits (or a space) groups thousands, any other comma is a decimal point."""
    t = F.translate(text, "−", "-")
    t = F.regexp_replace(t, r"(?<=\d)[,    ](?=\d{3}(?!\d))", "")
    return F.regexp_replace(t, r"(?<=\d),(?=\d)", ".")


def figure_parts(text: Column) -> Column:
    """The parts of the first printed figure (one, the ends of a span, the items of a list), each a number and maybe a unit.

    No label, no bracketed second figure, no remark.
    """
    t = F.regexp_replace(F.trim(text), r"^[\p{L} _-]+[:：]\s*|(?<!dB)\s*[(（].*$|[;,，；]\s*\p{L}.*$", "")
    t = F.regexp_replace(
        t, r"(?i)(?<=\S)\s+(?:per\s+(?!rev|sec|s\b|min|hour|h\b).*|(?:according|measured|as|see|at|with|when|for|under|each)\b.*|peak|nominal|typ\.?|max\.?|min\.?|approx\.?)$", ""
    )
    t = even_numbers(even_scales(t))
    t = F.regexp_replace(t, r"(?i)(?<=\d)(?:[-\s]*(?:ft|feet|foot)\b\.?|')[-\s]*(?=\d+(?:\.\d+)?[-\s]*(?:in\b|inch|\"))", "ft+")
    return F.split(t, r"\s*(?:\bup to\b|\bto\b|\band\b|…|\.\.+|[–—;~]|,\s|\s/\s|(?<=\d)/(?=\d)|(?<!\de)(?<=[\d\p{L}°])-(?=\d)|\s-\s)\s*")


def part_number(part: Column) -> Column:
    """The number of one part; feet and inches count as feet."""
    feet = F.split(part, r"ft\+")
    num = lambda c: F.regexp_extract(c, FIGURE, 0).try_cast("double")
    return F.when(F.size(feet) == 2, num(F.get(feet, F.lit(0))) + num(F.get(feet, F.lit(1))) / 12).otherwise(num(part))


def part_unit(part: Column) -> Column:
    return F.when(F.contains(part, F.lit("ft+")), F.lit("ft")).otherwise(F.trim(F.regexp_replace(part, rf"^.*?{FIGURE}[-\s]*", "")))


def unit_key(text: Column) -> Column:
    """Evens out a unit's text; spellings whose case carries meaning (mW, MW, K, mV, MV, GW) keep it."""
    t = F.translate(F.trim(text), "µ", "μ")
    kept = t.rlike(r"^(?:[hkm]@)?(?:[mM][WV]|K|GW)$")
    return F.when(F.length(t) > 0, F.when(kept, t).otherwise(F.lower(F.regexp_replace(t, r"\s+", " "))))


def scale_split(key: Column) -> tuple[Column, Column]:
    """(factor of a leading h@, k@ or m@; the unit behind it)."""
    factor = F.lit(1.0)
    for mark, by in _SCALES.items():
        factor = F.when(F.startswith(key, F.lit(mark)), F.lit(by)).otherwise(factor)
    return factor, F.regexp_replace(key, "^[hkm]@", "")


def apply_view(view: Column, x: Column) -> Column:
    return F.when(view == "recip", F.when(x != 0, 1 / x)).when(view == "pow10", F.pow(F.lit(10.0), x / 10)).otherwise(x)


def invert_view(view: Column, y: Column) -> Column:
    return F.when(view == "recip", F.when(y != 0, 1 / y)).when(view == "pow10", F.when(y > 0, 10 * F.log10(y))).otherwise(y)


# What marks a bound, an approximation and a tolerance.
_MARKS = {
    "<=": r"≤|<=|⩽|up to\b|max(?:imum)?\b\.?|not (?:more|greater|over) than\b|no more than\b|at most\b|不超过|不大于|至多|最大",
    ">=": r"≥|>=|⩾|min(?:imum)?\b\.?|not (?:less|below|under) than\b|no less than\b|at least\b|不低于|不小于|不少于|至少|最小",
    "<": r"<|less than\b|below\b|under\b|小于|低于",
    ">": r">|more than\b|greater than\b|above\b|over\b|exceed(?:s|ing)\b|大于|高于|超过",
}
_ABOUT = r"~|≈|∼|about\b|approx(?:imately)?\b\.?|circa\b|ca\.|c\.|around\b|nominally\b|roughly\b|约|大约|大概|左右"
_LABEL = r"(?:[\p{L} _-]+[:：]\s*)?"
_TOLERANCE = rf"({FIGURE})\s*([^\d\s±+%]*)\s*(?:±|\+/-|\+-)\s*({FIGURE})\s*(%?)\s*(\S*)"
_PAIR = rf"({FIGURE})\s*([^\d\s×x]*)\s*[x×]\s*({FIGURE})(?!\d)(?!\^)\s*(\S*)"


def typed_value(text: Column) -> Column:
    """kind, value, lower, upper, operator, options, unit of a printed value.

    kind: number; bound (operator and the end it gives); range (two ends, or a tolerance around a number); options (a list);
    pair (a by b, as options); approximate; text (no figure). A minus sign may be any dash that no figure stands before.
    Null or blank: kind text, all else null.
    """
    t = F.trim(F.translate(text, "−", "-"))
    marked = lambda words: t.rlike(rf"(?i)^{_LABEL}(?:{words})\s*[-+]?\d")
    operator = F.lit(None).cast("string")
    for sign, words in reversed(_MARKS.items()):
        operator = F.when(marked(words), sign).otherwise(operator)
    plain = even_numbers(even_scales(t))
    inside = rf"^\D*?{_TOLERANCE}"
    tolerant, pair = plain.rlike(inside), plain.rlike(rf"^\D*?{_PAIR}")
    group = lambda pattern, k: F.regexp_extract(plain, pattern, k)
    middle, by = group(inside, 1).try_cast("double"), group(inside, 3).try_cast("double")
    by = F.when(group(inside, 4) == "%", F.abs(middle) * by / 100).otherwise(by)
    parts = F.filter(figure_parts(t), lambda p: p.rlike(r"\d"))
    n = F.transform(parts, part_number)
    units = F.filter(F.transform(parts, part_unit), lambda u: u != "")
    listed = t.rlike(r"\d\D{0,12}[;；]\s*\d|\d\s*/\s*\d")
    kind = (
        F.when(~F.coalesce(t, F.lit("")).rlike(r"\d") | (F.size(n) < 1), "text").when(tolerant, "range").when(pair, "pair")
        .when((F.size(n) > 2) | ((F.size(n) == 2) & listed), "options").when(F.size(n) == 2, "range")
        .when(operator.isNotNull(), "bound").when(t.rlike(rf"(?i)^{_LABEL}(?:{_ABOUT})\s*[-+]?\d") | t.rlike("左右$"), "approximate").otherwise("number")
    )
    at = lambda k: F.get(n, F.lit(k))
    is_ = lambda *k: kind.isin(*k)
    lower = F.when(is_("range"), F.when(tolerant, middle - by).otherwise(F.least(at(0), at(1)))).when(is_("bound") & operator.isin(">", ">="), at(0))
    upper = F.when(is_("range"), F.when(tolerant, middle + by).otherwise(F.greatest(at(0), at(1)))).when(is_("bound") & operator.isin("<", "<="), at(0))
    own = F.when(tolerant, F.coalesce(F.nullif(group(inside, 2), F.lit("")), F.nullif(group(inside, 5), F.lit("")))).when(pair, group(rf"^\D*?{_PAIR}", 4)).otherwise(F.element_at(F.when(F.size(units) > 0, units), -1))
    sides = F.array(group(rf"^\D*?{_PAIR}", 1).try_cast("double"), group(rf"^\D*?{_PAIR}", 3).try_cast("double"))
    return F.struct(
        kind.alias("kind"), F.when(is_("number", "approximate"), at(0)).alias("value"), lower.alias("lower"), upper.alias("upper"), F.when(is_("bound"), operator).alias("operator"),
        F.when(is_("options"), n).when(is_("pair"), sides).alias("options"), F.when(~is_("text"), unit_key(own)).alias("unit"),
    )


_SPECS = {
    "weight_kg": (r"(?i)(?:weigh(?:s|ing|ed)?|weight(?: of| is|:)?|mass(?: of| is|:)?|重量?[为:：]?)\s*(?:about |approx\.? |~|约)?", {"kg": 1.0, "t": 1000.0, "tonnes": 1000.0, "g": 0.001, "lb": 0.45359237}),
    "power_kw": (r"(?i)(?:power(?: of| is|:)?|功率[为:：]?)\s*(?:about |approx\.? |~|约)?", {"kW": 1.0, "MW": 1000.0, "W": 0.001}),
    "prf_hz": (r"(?i)(?:prf|pulse repetition frequency|pulse rate|脉冲重复频率)(?: of| is|:|为|：)?\s*(?:about |approx\.? |~|约)?", {"Hz": 1.0, "kHz": 1000.0, "pps": 1.0}),
    "range_km": (r"(?i)(?:range(?: of| is|:)?|距离[为:：]?|targets at|reached)\s*(?:more than |about |approx\.? |~|约)?", {"km": 1.0, "NM": 1.852, "nautical miles": 1.852, "m": 0.001}),
}


def spec_values(text: Column) -> Column:
    """weight_kg, power_kw, prf_hz, range_km, year, status of the first phrase that states each; text_kind is null where none is stated."""
    plain = even_numbers(text)
    out = []
    for name, (words, units) in _SPECS.items():
        names = sorted(units, key=len, reverse=True)
        pattern = rf"{words}({FIGURE})\s?((?-i:{'|'.join(names)}))(?![\p{{L}}\d])"
        unit, by = F.regexp_extract(plain, pattern, 2), F.lit(None).cast("double")
        for u, f in units.items():
            by = F.when(unit == u, f).otherwise(by)
        out.append((F.regexp_extract(plain, pattern, 1).try_cast("double") * by).alias(name))
    year = F.regexp_extract(text, r"(?i)(?:\b(?:in|since|from|introduced|entered service in|delivered in)\s+|于)((?:18|19|20)\d{2})(?!\d)", 1).try_cast("int").alias("year")
    word = F.lower(F.regexp_extract(text, r"(?i)\b(in service|out of service|retired|withdrawn|under development|in production|prototype)\b|(现役|退役|在研)", 0))
    status = F.when(word.isin("in service", "in production", "现役"), "active").when(word.isin("out of service", "retired", "withdrawn", "退役"), "retired").when(word != "", "development").alias("status")
    row = [*out, year, status]
    return F.struct(*row, F.when(F.coalesce(*[c.cast("string") for c in row]).isNotNull(), "spec").alias("text_kind"))
