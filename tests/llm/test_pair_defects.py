import collections
import random

import pytest

from cairn.llm import pair_defects as P
from cairn.session import table


@pytest.fixture(scope="module")
def pairs(spark, data):
    d = data.replace("sf0.001", "sf0.01")
    g, q = table(spark, d, "generations"), table(spark, d, "questions").select("id", "question")
    rows = g.join(q.withColumnRenamed("id", "question_id"), "question_id").select("question", "generated_text", "prediction").distinct().collect()
    rows = [tuple(r) for r in rows if r.generated_text and len(P._key(P._plain(r.generated_text))) > 5]
    random.Random(3).shuffle(rows)
    return rows


@pytest.fixture(scope="module")
def model(pairs):
    return P.fit(pairs[:350])


def test_held_out_accuracy(model, pairs):
    """Synthetic defects made from pairs that the fit has not seen."""
    sound = [p for p, v in zip(pairs[350:], P.judge(model, [p[0] for p in pairs[350:]], [p[1] for p in pairs[350:]])) if v is None]
    data, label, _, _ = P.synthetic(sound, seed=99)
    got = P.judge(model, [q for q, _ in data], [a for _, a in data])
    want = [None if k < 0 else P.LABELS[k] for k in label]
    right = sum(g == w for g, w in zip(got, want))
    assert right / len(want) > 0.93, collections.Counter((w, g) for g, w in zip(got, want) if g != w).most_common(8)


def test_recall_per_label(model, pairs):
    """At least 98 of 100 planted defects of each type are found; some of the answers taken for sound are defective themselves."""
    sound = [p for p, v in zip(pairs[350:], P.judge(model, [p[0] for p in pairs[350:]], [p[1] for p in pairs[350:]])) if v is None]
    data, label, _, _ = P.synthetic(sound, seed=5)
    got = P.judge(model, [q for q, _ in data], [a for _, a in data])
    for k, name in enumerate(P.LABELS):
        own = [g == name for g, x in zip(got, label) if x == k]
        assert sum(own) >= 0.98 * len(own), (name, sum(own), len(own))
    fine = [g is None for g, x in zip(got, label) if x < 0]
    assert sum(fine) >= 0.96 * len(fine), (sum(fine), len(fine))


def test_nothing_learnt_finds_nothing(model, pairs):
    q, a = [p[0] for p in pairs] + [Q], [p[1] for p in pairs] + [None]
    assert set(P.judge(P.fit([]), q, a)) == {None} == set(P.judge({"w": model["w"] * 0}, q, a))


Q, ZQ = "What is the peak power of the Veltor AAA-100?", "Veltor AAA-100的峰值功率是多少？"
CASES = [
    (Q, None, "empty"), (Q, "", "empty"), (Q, "​\n", "empty"), (Q, "<answer></answer>", "empty"), (Q, "...", "empty"),
    (Q, "The peak power of Veltor AAA-100 is 12 kW. This figure is taken from the data sheet and agrees wi", "truncated"), (Q, "<answer>The peak power of Veltor AAA-100 is 12 kW. It was", "truncated"),
    (Q, "I'm sorry, but I can't help with that request.", "refusal"), (ZQ, "抱歉，我无法回答这个问题。", "refusal"),
    (Q, Q, "copy"), (Q, "> " + Q, "copy"), (ZQ, "**" + ZQ + "**", "copy"), (Q, "You asked: " + Q, "copy"),
    (Q, "Veltor AAA-100的峰值功率为12 kW。该数值取自产品资料，与试验报告一致。", "language"), (ZQ, "The peak power of Veltor AAA-100 is 12 kW. This figure is taken from the data sheet.", "language"),
    (Q, "Según la ficha técnica, el valor de Veltor AAA-100 es 12 kW y las pruebas lo confirmaron.", "language"), (Q, "Согласно описанию, значение составляет 12 kW, испытания это подтвердили.", "language"), (ZQ, "資料によると、Veltor AAA-100の値は12 kWであり、試験でも確認されています。", "language"), (ZQ, "Laut Datenblatt beträgt der gesuchte Wert 12 kW, und die Prüfung hat ihn bestätigt.", "language"),
    (Q, "12 kW", None), (Q, "The peak power of Veltor AAA-100 is 12 kW.", None), (Q, Q + "\nPeak power: 12 kW.", None), (ZQ, "12 kW", None), (ZQ, "答案是 12 kW。（peak power）", None), (Q, "The sources do not record the peak power of Veltor AAA-100.", None),
]


@pytest.mark.parametrize("i", range(len(CASES)))
def test_cases(model, i):
    q, a, want = CASES[i]
    assert P.judge(model, [q], [a]) == [want]


def test_hostile_rows(spark, data):
    d = data.replace("sf0.001", "sf0.01")
    g, q = table(spark, d, "generations"), table(spark, d, "questions")
    odd = spark.createDataFrame([("odd1", "none", None), ("odd2", None, "The wind limit of Veltor AAA-100 is 12 kn."), (None, "none", None), ("odd3", "none", "The reading was confirmed during acceptance, so no condition has to be added. " * 5000)], "id string, question_id string, generated_text string")
    rows = {r.id: r.defect for r in P.found(g.unionByName(odd, allowMissingColumns=True), q).collect()}
    assert rows["odd1"] == "empty" and "odd2" not in rows and "odd3" not in rows and None not in rows
    assert P.found(g.limit(0), q.limit(0)).count() == 0


def test_judging_travels_without_the_package(model, tmp_path):
    """A worker that does not have the package can run what the plan carries."""
    import subprocess
    import sys

    from pyspark import cloudpickle

    (tmp_path / "f.pkl").write_bytes(cloudpickle.dumps(P._judge_batches(model)))
    code = "import pandas as pd\nfrom pyspark import cloudpickle\nf = cloudpickle.loads(open('f.pkl', 'rb').read())\nprint(list(next(f(iter([pd.DataFrame({'id': ['a', 'b'], 'question': ['What is it?'] * 2, 'answer': [None, '12 kW']})])))['defect']))"
    env = {k: v for k, v in __import__("os").environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=120)
    assert out.stdout.strip() == "['empty', None]", out.stderr[-800:]
