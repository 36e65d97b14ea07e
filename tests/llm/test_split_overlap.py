import itertools

import pytest
from pyspark.sql import functions as F

from cairn.llm import split_overlap as S
from cairn.session import table

ROWS = [
    ("a1", "train", "What is the peak power of the Veltor AAA-100 at a supply voltage of 50 V?"),
    ("b1", "dev", "Please tell me: what is peek power of “Veltor AAA-100” at a supply voltage of 50 V??"),
    ("b2", "dev", "What is the average power of the Veltor AAA-100 at a supply voltage of 50 V?"),
    ("b3", "holdout", "What is the peak power of the Veltor AAA-101 at a supply voltage of 50 V?"),
    ("b4", "holdout", "What is the peak power of the Veltor AAB-100 at a supply voltage of 50 V?"),
    ("b5", "holdout", "What is the peak power of the Veltor AAA-100 at a supply voltage of -50 V?"),
    ("b6", "holdout", "WHAT IS THE PEAK POWER OF THE ＶＥＬＴＯＲ ＡＡＡ-１００ AT A SUPPLY VOLTAGE OF 50 V? Thanks!"),
    ("a2", "train", "比较Joltane VST-217与Elkhane GPR-920的工作温度。"), ("b7", "dev", "请问，比交Joltane VST-217与Elkhane GPR-920的工作温度？谢谢"), ("b8", "dev", "比较Joltane VST-217与Elkhane GPR-920的工作高度。"),
    ("a3", "train", None), ("b9", "dev", None), ("a4", "train", ""), ("c1", "dev", "  ?! "), (None, "dev", "What is the peak power of the Veltor AAA-100 at a supply voltage of 50 V?"), ("b1", "dev", "Please tell me: what is peek power of “Veltor AAA-100” at a supply voltage of 50 V??"),
]
FILL = [(f"f{i}", "train", f"{t} {n} Nord BBB-{200 + i} at a supply voltage of {i} V?") for i, (t, n) in enumerate(itertools.product(["What is the peak power of the", "What is the average power of the", "Compare the operating altitude of the", "Read the supply voltage of"], range(12)))]
ZH = [(f"z{i}", "train", f"比较Nord BBB-{300 + i}与Nord CCC-{i}的工作{'温度' if i % 2 else '高度'}。") for i in range(30)]


@pytest.fixture(scope="module")
def questions(spark):
    rows = [(i, s, "src", q, "clash") for i, s, q in ROWS + FILL + ZH]
    return spark.createDataFrame(rows, "id string, split string, source string, question string, cid string")


def test_cases(questions):
    got = {tuple(r) for r in S.found(questions).collect()}
    assert got == {("a1", "b1"), ("a1", "b6"), ("a2", "b7")}


def test_report_counts(questions):
    r = {(x.split, x.source): (x.n_pairs, x.n_eval) for x in S.report(questions).collect()}
    assert r == {("dev", "src"): (2, 2), ("holdout", "src"): (1, 1)}


def test_same_as_comparing_all_pairs(spark, data):
    """The prefix filter loses nothing that a comparison of all pairs finds."""
    texts, _ = S.classes(table(spark, data, "questions"))
    rows = [r.asDict() for r in texts.collect()]
    counts = {r.cid: [list(x) for x in r.counts] for r in S._counted(texts, texts).collect()}
    brute = set()
    for a, b in itertools.product([r for r in rows if r["train"]], [r for r in rows if r["evaluation"]]):
        if a["numbers"] == b["numbers"]:
            ga, gb = set(a["grams"]), set(b["grams"])
            near = len(ga & gb) >= 0.4 * len(ga | gb)
            if near and (a["cid"] == b["cid"] or S.same_wording(a["words"], b["words"], counts[a["cid"]], counts[b["cid"]])):
                brute.add((a["cid"], b["cid"]))
    assert {tuple(r) for r in S.class_pairs(texts).collect()} == brute


def test_hot_class_and_empty(spark, questions):
    same = spark.range(60).select(F.concat(F.lit("h"), "id").alias("id"), F.when(F.col("id") % 2 == 0, "train").otherwise("dev").alias("split"), F.lit("s").alias("source"), F.lit("One hot question about 7 things").alias("question"))
    assert S.found(same).count() == 900
    assert S.found(questions.limit(0)).count() == 0


def test_border_of_the_similarity(spark):
    """Sets of exactly the least similarity are found, whatever their sizes: same as comparing all pairs in whole numbers."""
    import random

    rng, sets = random.Random(4), []
    for k in range(120):  # n_t + n_e is a multiple of 7 and the sets share two sevenths of it
        total = 7 * rng.randint(1, 12)
        both = 2 * total // 7
        n_t = rng.randint(both, total - both)
        own = [f"{k}_{i}" for i in range(total - both)]
        shared, rest = own[:both], own[both:]
        sets += [(f"t{k}", True, shared + rest[: n_t - both]), (f"e{k}", False, shared + rest[n_t - both :])]
    rows = [(c, train, not train, [hash_(x) for x in g], ["w"]) for c, train, g in sets]
    texts = spark.createDataFrame(rows, "cid string, train boolean, evaluation boolean, grams array<long>, words array<string>")
    got = {(r.cid_t, r.cid_e) for r in S.similar(texts).collect()}
    brute = {(a[0], b[0]) for a in rows if a[1] for b in rows if b[2] if 5 * len(set(a[3]) & set(b[3])) >= 2 * len(set(a[3]) | set(b[3]))}
    assert got == brute and len(brute) >= 120


def hash_(s):
    import zlib

    return zlib.crc32(s.encode())


def test_many_courtesies_and_grouped_thousands(spark, questions):
    polite = "Please, please, kindly tell me, thank you, thanks, many thanks, sorry, hello, urgent: "
    extra = [
        ("n1", "dev", polite + "what is the peak power of the Veltor AAA-100 at a supply voltage of 50 V?"), ("n2", "dev", "kkindly plaese thakns urgnet sorrry helllo questoin plesae thankss pleasse what is the peak power of the Veltor AAA-100 at a supply voltage of 50 V?"),
        ("q1", "train", "What is the noise figure of the Ostrane AAA-777 at a distance of 1000 m?"), ("r1", "dev", "What is the noise figure of the Ostrane AAA-777 at a distance of 1,000 m?"),
        ("q2", "train", "What is the gain of the Ostrane AAA-778 at 2.5 V?"), ("r2", "dev", "What is the gain of the Ostrane AAA-778 at 2,5 V?"), ("r3", "dev", "What is the gain of the Ostrane AAA-778 at 25 V?"),
    ]
    more = spark.createDataFrame([(i, s, "src", q, "clash") for i, s, q in extra], questions.schema)
    got = {tuple(r) for r in S.found(questions.unionByName(more)).collect()}
    assert {("a1", "n1"), ("q1", "r1"), ("q2", "r2")} <= got and not any("r3" in p for p in got)


def test_word_counts_may_differ_freely():
    a = "what peak power veltor aaa 100 supply voltage 50 v".split()
    counts = lambda w: [[50, 50] for _ in w]
    b = ["plaese", "kindlyy", "thankss", "questionn", "urgentt", "thanksx", "pleasee", "kindlly", "urrgent", "quesstion"] + a
    assert S.same_wording(a, b, counts(a), counts(b)) and not S.same_wording(a, ["transmitter"] + a, counts(a), counts(a) + [[50, 50]])


def test_only_questions_of_the_same_fixed_words_meet(spark, questions):
    """Other model letters or figures never meet, so candidates grow with the questions and not with their templates."""
    texts, _ = S.classes(questions)
    of = {r.cid: r.text for r in texts.collect()}
    pairs = [(of[r.cid_t], of[r.cid_e]) for r in S.similar(texts).collect()]
    assert pairs and all("aab" not in e and "101" not in e for _, e in pairs)


def test_crowded_fixed_words_same_as_all_pairs(spark):
    """So many texts of the same fixed words that the prefix filter finds the pairs, beside some that are compared directly."""
    import random

    rng, things = random.Random(5), [f"{a}{b}" for a in ("trans", "recei", "gener", "condu", "radi") for b in ("mitter", "ver", "ator", "ctor", "ance")]
    of = lambda k, n: " ".join(rng.sample(things, n)) + f" {k}"
    rows = [(f"{k}-{i}", "train" if i % 2 else "dev", "s", of(k, 3)) for k, many in ((7, 100), (8, 6)) for i in range(many)]
    texts, _ = S.classes(spark.createDataFrame(rows, "id string, split string, source string, question string"))
    own = texts.collect()
    brute = {(a.cid, b.cid) for a in own if a.train for b in own if b.evaluation and a.numbers == b.numbers and 5 * len(set(a.grams) & set(b.grams)) >= 2 * len(set(a.grams) | set(b.grams))}
    assert {(r.cid_t, r.cid_e) for r in S.similar(texts).collect()} == brute and len(brute) > 50


def test_nothing_is_broadcast(spark, questions):
    plan = S.class_pairs(S.classes(questions)[0])._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
