import datetime as dt

import pytest

from cairn.llm import scan_repair as S

WORDS = "the transmitter keeps the resolution because the modulator and the reflector were replaced during maintenance of the station while operators noticed interference".split()
CLEAN = "\n".join(["== History ==", *[" ".join(WORDS) + " with the moving-target display and the travelling-wave tube for detection at the station. " * 2] * 6])
SCAN = """Veltor AAA-100 Operator Manual
Issue A, 1987

The transmitter keeps the resolution because the modu-
lator and the reflect0r were replaced during mainte-
nance of the station while operators noticed the moving-
target display.
— 3 —

DOC 12 Veltor AAA-100
Range scales available (NM):
3
6
12
The rnodulator was replaced while operators noticed inter-
— 4 —
DOC 12 Veltor A.A-100

ference at the station during maintenance and hecause
1.2 Receiver and alignment
The transmitter draws 8.1 An at 24 V at the station now.
— 5 —"""
COLUMNS = "id string, family_id string, en_title string, source_kind string, raw_text_en string, raw_text_zh string, infobox map<string,string>, n_pages int, fetched_at timestamp, text string, h string"


def doc(i, text):
    return (i, None, "Veltor AAA-100", "k", text, None, None, 1, dt.datetime(2024, 1, 1), "clash", "clash")


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.createDataFrame([doc("c1", CLEAN), doc("s1", SCAN), doc("s1", SCAN), doc("n", None), doc("e", ""), doc("b", " \n "), doc(None, SCAN), doc("l", "word " * 50_000)], COLUMNS)


def test_damaged_lines(corpus):
    got = sorted((r.line_no, r.defect) for r in S.found(corpus).filter("id = 's1'").collect())
    assert got == [(4, "hyphen"), (5, "hyphen"), (5, "misread"), (8, "page_number"), (10, "header"), (15, "hyphen"), (15, "misread"), (16, "page_number"), (17, "header"), (19, "misread"), (22, "page_number")]


def test_only_scans_are_damaged(corpus):
    assert {r.id for r in S.found(corpus).select("id").distinct().collect()} == {"s1"}


def test_paragraphs(corpus):
    text = {r.id: r.text for r in S.repaired(corpus).collect()}["s1"]
    assert "because the modulator and the reflector were replaced during maintenance of the station while operators noticed the moving-target display." in text
    assert "noticed interference at the station during maintenance and because" in text
    assert "DOC 12" not in text and "— 4 —" not in text


def test_anagram_hash_shift(spark):
    from pyspark.sql import functions as F

    r = spark.range(1).select(*[S.anagram_hash(F.lit(w)).alias(f"x{i}") for i, w in enumerate(["modern", "modem", "rn", "m", "nrmode"])]).first()
    assert (r.x0 - r.x2 + r.x3) % S.PRIME == r.x1 and r.x0 != r.x1


def test_empty(corpus):
    assert S.found(corpus.limit(0)).count() == 0


def test_one_long_line_changes_nothing_else(spark):
    """A line wider than a page does not turn a scan into an article."""
    long = "a remark without any end " * 6
    assert len(long) > 131
    two = {(r.line_no, r.defect) for r in S.found(spark.createDataFrame([doc("c1", CLEAN), doc("s1", SCAN + "\n" + long)], COLUMNS)).filter("id = 's1'").collect()}
    assert {x for x in two if x[0] <= 22} == {(4, "hyphen"), (5, "hyphen"), (5, "misread"), (8, "page_number"), (10, "header"), (15, "hyphen"), (15, "misread"), (16, "page_number"), (17, "header"), (19, "misread"), (22, "page_number")}
    assert S.line_kinds(SCAN + "\n" + long, None)[:22] == S.line_kinds(SCAN, None)


def test_a_confusion_nobody_listed_is_learnt(spark):
    words = "transmitter maintenance interference display moving target detection station reflector resolution".split()
    clean = "\n".join(["== A ==", *[" ".join(words) + ". " + "The operators noticed it at the station again and again. " * 3] * 8])
    scan = "Veltor AAA-100 Operator Manual\n\n" + "\n".join(f"the operators noticed the {w.replace('t', 'þ', 1)} at the station" for w in words if "t" in w)
    got = {r.line_no for r in S.found(spark.createDataFrame([doc("c", clean), doc("s", scan)], COLUMNS)).filter("id = 's' and defect = 'misread'").collect()}
    assert got == set(range(3, 3 + sum("t" in w for w in words)))
    assert S.PRIME and not any("þ" in c for c in S.CONFUSIONS)


def test_very_long_words_are_words(spark):
    word = "electro" * 8 + "magnetic"
    clean = "\n".join(["== A ==", *[f"The {word} display was replaced during maintenance of the station while operators noticed it. " * 2] * 6])
    scan = f"Veltor AAA-100 Operator Manual\n\nthe {word[:-1]}e display was replaced\nduring maintenance of the station while the {word[:20]}-\n{word[20:]} display was replaced during maintenance of the station."
    got = {(r.line_no, r.defect) for r in S.found(spark.createDataFrame([doc("c", clean), doc("s", scan)], COLUMNS)).filter("id = 's'").collect()}
    assert got == {(3, "misread"), (4, "hyphen")}


def test_near_strings_by_pieces():
    import random

    rng = random.Random(1)
    pool = ["".join(rng.choice("abc") for _ in range(rng.randint(0, 9))) for _ in range(150)]
    found = S._Nearby([(s, i) for i, s in enumerate(pool)])
    for s in pool[:60] + ["", "a", "abcabcabc"]:
        assert {t for t, _ in found.near(s)} == {t for t in pool if S._near(s, t, 2)}
