"""Scalar text functions as Column expressions (X-05..X-44 of the inventory)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Band letters and what they are also called.
BANDS = ["HF", "VHF", "UHF", "L", "S", "C", "X", "Ku", "K", "Ka", "V", "W"]
PLATFORM_WORDS = [("naval", "ship|vessel|frigate|destroyer|carrier|submarine|boat|naval|marine|corvette"), ("ground", "ground|vehicle|truck|station|coastal|tower|site|harbou?r"), ("air", "air|aircraft|fighter|helicopter|uav|bomber|drone")]


def name_key(c: Column) -> Column:
    """A name without case and separators."""
    return F.regexp_replace(F.lower(F.trim(c)), r"[\s\-_/().]", "")


def entity_key(c: Column) -> Column:
    """Letters and digits only, without case."""
    return F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]", "")


def family_key(c: Column) -> Column:
    """Base designation: no maker prefix, no variant in brackets, no trailing variant letter."""
    t = F.upper(F.regexp_replace(c, r"\([^)]*\)", ""))
    return F.regexp_extract(t, r"([A-Z]{1,4})[- ]?(\d+)", 0)


def designation(c: Column) -> Column:
    """Maker and model as printed, e.g. ABC-123."""
    return F.regexp_extract(c, r"(?<![A-Za-z0-9_])[A-Z]{2,4}-[0-9]+[A-Z]?(?![A-Za-z0-9_])", 0)


def first_number(c: Column) -> Column:
    return F.regexp_extract(c, r"-?\d+(?:\.\d+)?", 0).try_cast("double")


def number_text(c: Column) -> Column:
    """Printed number signs evened out: minus signs, ellipses and dashes between figures."""
    t = F.translate(c, "−－～", "--~")
    t = F.regexp_replace(t, r"(?<=\d)\s*(?:…|\.{2,}|[–—~])\s*(?=-?\d)", " to ")
    return F.trim(F.regexp_replace(t, r"(?<=\d),(?=\d{3}(?!\d))", ""))


def only_number(c: Column) -> Column:
    """The number of a text with exactly one, else null."""
    found = F.regexp_extract_all(c, F.lit(r"-?\d+(?:\.\d+)?"), 0)
    return F.when(F.size(found) == 1, found[0].try_cast("double"))


def band(c: Column) -> Column:
    """A band name from text such as "x-band" or "Ku band"; null if none."""
    raw = F.regexp_extract(c, r"(?i)\b(VHF|UHF|HF|Ku|Ka|[LSCXKVW])(?=[- ]?band\b)", 1)
    out = F.lit(None).cast("string")
    for b in BANDS:
        out = F.when(F.lower(raw) == b.lower(), F.lit(b)).otherwise(out)
    return out


def band_list(c: Column) -> Column:
    """Bands of a list, two stuck letters taken apart, in order, without repeats."""
    parts = F.split(F.regexp_replace(F.upper(c), r"([LSCXVW])([LSCXVW])(?![A-Z])", "$1,$2"), r"[\s,/;&+]+")
    return F.array_distinct(F.filter(parts, lambda p: p != ""))


def platform_class(c: Column) -> Column:
    """naval before ground before air."""
    out = F.lit(None).cast("string")
    for name, words in reversed(PLATFORM_WORDS):
        out = F.when(F.lower(c).rlike(words), F.lit(name)).otherwise(out)
    return out


def tokens(c: Column, stop: Sequence[str] = ()) -> Column:
    """Lower-case ASCII words and single CJK characters without a stop list."""
    t = F.regexp_extract_all(F.lower(c), F.lit(r"[a-z0-9]+|[\x{4e00}-\x{9fff}]"), 0)
    return F.filter(t, lambda x: ~x.isin(*stop)) if stop else t


def cjk_bigrams(c: Column) -> Column:
    """CJK characters and their neighbours' bigrams."""
    chars = F.regexp_extract_all(c, F.lit(r"[\x{4e00}-\x{9fff}]"), 0)
    n = F.size(chars)
    return F.concat(chars, F.zip_with(F.slice(chars, F.lit(1), F.greatest(n - 1, F.lit(0))), F.slice(chars, F.lit(2), F.greatest(n - 1, F.lit(0))), lambda a, b: F.concat(a, b)))


def answer_tokens(c: Column) -> Column:
    """Normalised answer words."""
    return F.filter(F.split(F.trim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}.]+", " ")), " "), lambda x: x != "")


def token_f1(a: Column, b: Column) -> Column:
    """F1 of two word sets; both empty 1, one empty 0."""
    a, b = F.array_distinct(a), F.array_distinct(b)
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).when(both == 0, 0.0).otherwise(2.0 * both / (F.size(a) + F.size(b)))


def exact_match(a: Column, b: Column) -> Column:
    return F.array_join(answer_tokens(a), " ") == F.array_join(answer_tokens(b), " ")


def split_bucket(key: Column) -> Column:
    """md5 of the key modulo 100, as the whole 128-bit number gives it."""
    digits = F.split(F.md5(key), "")
    return F.aggregate(digits, F.lit(0), lambda a, c: F.when(c == "", a).otherwise(((a * 16 + F.conv(c, 16, 10).cast("int")) % 100).cast("int")))


def split_name(key: Column) -> Column:
    b = split_bucket(key)
    return F.when(b < 80, "train").when(b < 90, "dev").otherwise("test")


def canonical_hash(*cols: str) -> Column:
    return F.sha2(F.to_json(F.struct(*sorted(cols)), {"ignoreNullFields": "false"}), 256)


def wilson(hits: Column, n: Column, z: float = 1.96) -> Column:
    """struct low, high of a share."""
    p = hits / n
    d = 1 + z * z / n
    mid = (p + z * z / (2 * n)) / d
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / d
    return F.struct((mid - half).alias("low"), (mid + half).alias("high"))


def wald(hits: Column, n: Column, z: float = 1.96) -> Column:
    p = hits / n
    half = z * F.sqrt(p * (1 - p) / n)
    return F.struct(F.greatest(p - half, F.lit(0.0)).alias("low"), F.least(p + half, F.lit(1.0)).alias("high"))


def valid_number(c: Column, low: float, high: float) -> Column:
    """The number of a text if it lies in the range of what is credible."""
    v = first_number(c)
    return F.when(v.between(low, high), v)


def uri_key(c: Column) -> Column:
    """A URI without scheme, www, fragment and trailing slash, host in lower case."""
    t = F.regexp_replace(F.regexp_replace(F.trim(c), r"(?i)^[a-z]+://(?:www\.)?", ""), r"#.*$", "")
    host, rest = F.regexp_extract(t, r"^([^/]*)", 1), F.regexp_extract(t, r"^[^/]*(/.*)?$", 1)
    return F.regexp_replace(F.concat(F.lower(host), rest), "/+$", "")


def normal_vector(v: Column) -> Column:
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return F.transform(v, lambda x: x.cast("double") / norm)


def inner_product(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def rendered(head: Column, relation: Column, tail: Column, templates: dict[str, str]) -> Column:
    """A sentence per triple from its relation's template with {h} and {t}."""
    out = F.concat_ws(" ", head, relation, tail)
    for r, text in templates.items():
        out = F.when(relation == r, F.replace(F.replace(F.lit(text), F.lit("{h}"), head), F.lit("{t}"), tail)).otherwise(out)
    return out


def transliterated(c: Column, exceptions: dict[str, str] | None = None) -> Column:
    """Cyrillic to Latin, whole-word exceptions first."""
    out = c
    for k, v in (exceptions or {}).items():
        out = F.regexp_replace(out, rf"(?i)\b{k}\b", v)
    for k, v in (("щ", "shch"), ("ж", "zh"), ("х", "kh"), ("ц", "ts"), ("ч", "ch"), ("ш", "sh"), ("ю", "yu"), ("я", "ya"), ("ё", "yo")):
        out = F.replace(F.replace(out, F.lit(k), F.lit(v)), F.lit(k.upper()), F.lit(v.capitalize()))
    return F.translate(out, "абвгдезийклмнопрстуфыэАБВГДЕЗИЙКЛМНОПРСТУФЫЭъьЪЬ", "abvgdeziyklmnoprstufyeABVGDEZIYKLMNOPRSTUFYE")
