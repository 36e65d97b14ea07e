import numpy as np
import pytest

from cairn.llm import mixing as M
from cairn.session import table


@pytest.mark.parametrize("n", [3, 20, 500])
def test_flight_keeps_totals(n):
    rng = np.random.default_rng(n)
    t, p = rng.integers(1, 900, n), np.full(n, 0.37)
    q = M.flight(t, p, M.LEFT, 5)
    assert abs((q * t).sum() - (p * t).sum()) < 1e-6 and abs(q.sum() - p.sum()) < 1e-6
    assert ((q > 0) & (q < 1)).sum() <= M.LEFT and q.min() >= 0 and q.max() <= 1


def test_inclusion_probabilities_hold():
    t = np.array([10, 20, 30, 40, 50, 60, 70, 80])
    hits = np.mean([M.flight(t, np.full(8, 0.5), 2, s) for s in range(3000)], axis=0)
    assert np.abs(hits - 0.5).max() < 0.05


def test_one_by_one_keeps_totals_and_probabilities():
    """A few huge documents among many small ones: tokens in total hold in every draw, every document keeps its probability."""
    t = np.array([5000, 3000, 900, 400, 300] + [60 - i // 20 for i in range(400)])
    draws, totals = [], []
    for s in range(800):
        out, alpha, beta = M.one_by_one(t[:-12], 0.37, 0.0, (12, t[-12:].sum(), (t[-12:] ** 2.0).sum(), t[-12:].min(), t[-12:].max()), s)
        left = np.clip(alpha + beta * t[-12:], 0, 1)
        draws.append(out)
        totals.append((out * t[:-12]).sum() + (left * t[-12:]).sum())
    off = np.abs(np.array(totals) - 0.37 * t.sum())
    assert np.median(off) < 1e-6 and off.max() < 60  # at most a small document, where the line meets 0 or 1 at the end
    assert np.abs(np.mean(draws, axis=0) - 0.37).max() < 0.08


def test_probabilities_of_the_mix_hold(spark):
    """Over many mixes (other ids, so other draws) large and small documents come in as often as their share says."""
    import pandas as pd

    sizes = np.array([4000, 2500] + [40 + i % 30 for i in range(300)])
    hits = []
    for k in range(300):
        pdf = pd.DataFrame({"source": f"s{k}", "doc_id": np.arange(302), "n_tokens": sizes, "p": 0.3, "h": np.arange(302), "block": 0, "goal": 0.3 * sizes.sum(), "n0": 0.0, "n1": 0.0, "n2": 0.0, "least": None, "most": None})
        a = M._largest(pdf)
        drawn = a[(a.p == 0) | (a.p == 1)]
        b = a[(a.p > 0) & (a.p < 1)].assign(goal=0.3 * sizes.sum() - (drawn.p * drawn.n_tokens).sum())
        b = M._land(b) if len(b) else b
        assert abs((drawn.p * drawn.n_tokens).sum() + (b.p * b.n_tokens).sum() - 0.3 * sizes.sum()) < 30
        hits.append(pd.concat([drawn, b]).set_index("doc_id").p.sort_index().to_numpy())
    mean = np.mean(hits, axis=0)
    assert np.abs(mean[:2] - 0.3).max() < 0.09 and abs(mean[2:].mean() - 0.3) < 0.01


def test_shares_and_caps(spark, data):
    d = data.replace("sf0.001", "sf0.01")
    docs, targets = table(spark, d, "documents"), table(spark, d, "mix_targets")
    s = {r.source: r for r in M.shares(docs, targets).collect()}
    assert all(abs(r.actual_share - r.target_share) < 0.002 for r in s.values())
    cap = {r.source: r.max_repeats for r in targets.collect()}
    m = M.mix(docs, targets)
    assert all(r.copies <= cap[r.source] for r in m.collect())
    # as large as the caps allow: one source is used up
    assert any(r.n_copies == r.max_repeats * docs.filter(docs.source == r.source).count() for r in s.values())
    assert m.count() == m.select("doc_id").distinct().count()


def test_hostile_rows(spark):
    docs = spark.createDataFrame([(1, "a b c", "x"), (2, None, "x"), (3, "a b c d", "y"), (4, "words", None), (5, "words", "z"), (6, "a b", "x")], "doc_id long, text string, source string")
    targets = spark.createDataFrame([("x", 0.5, 2), ("y", 0.25, 3), ("gone", 0.25, 1)], "source string, target_share double, max_repeats int")
    s = {r.source: r for r in M.shares(docs, targets).collect()}
    assert s["gone"].actual_share == 0 and s["x"].n_tokens > 0 and s["y"].most_copies <= 3
    assert {r.source for r in M.mix(docs, targets).collect()} <= {"x", "y"}
    assert M.mix(docs.limit(0), targets).count() == 0
    assert M.mix(docs, targets.limit(0)).count() == 0


def test_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(M, "BLOCK", 50)
    rows = [(i, "word " * (1 + i % 17), "x" if i % 3 else "y") for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    targets = spark.createDataFrame([("x", 0.3, 1), ("y", 0.7, 2)], "source string, target_share double, max_repeats int")
    assert all(abs(r.actual_share - r.target_share) < 0.01 for r in M.shares(docs, targets).collect())
