"""Joins whose intermediate rows must not grow faster than input and result; same rows as comparing everything."""

import random
from collections import Counter

import pytest

from cairn.operators.fusion import sharing_pairs, similar
from cairn.operators.lexicon import longest_alias
from cairn.queries.kg import QUERIES as KG
from cairn.queries.more import QUERIES as MORE


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("small", [100_000, 0])
def test_longest_alias_either_way(spark, small):
    texts = [("a", "Sea  clutter and a magnetron"), ("a", "magnetron"), ("b", "sea cluttered"), ("c", "CLUTTER, sea"), (None, "the clutter"), ("d", None), ("e", "")]
    index = spark.createDataFrame([("sea clutter", "clutter"), ("clutter", "noise"), ("magnetron", "tube"), ("--", "none")], "surface string, canonical string")
    got = {tuple(r) for r in longest_alias(spark.createDataFrame(texts, "id string, text string"), index, small).collect()}
    assert got == {("a", "sea clutter", "clutter"), ("c", "clutter", "noise"), (None, "clutter", "noise")}


def test_texts_stay_where_they_are(spark, data):
    p = plan(MORE["w10_longest_alias"](spark, data))
    assert "BroadcastHashJoin" in p and "SortMergeJoin" not in p


def test_similar_same_as_all_pairs(spark):
    """With repeated names, nulls, families and ties; before, every pair of a country was made."""
    rng = random.Random(6)
    pick = lambda *x: rng.choice(x)
    rows = [(pick(i, i, i, 7, None), pick("x", "x", "y", None), pick("p", "q", None), pick(1, 2, 3), pick(1.0, 2.0)) for i in range(90)]
    family = [(a, b) for a in range(0, 90, 9) for b in range(60) if rng.random() < 0.5]
    weights, want = {"t": 0.6, "s": 0.4, "u": 0.0}, []
    by = {}
    for n, c, *x in rows:
        for m, d, *y in rows:
            if None not in (n, m, c, d) and c == d and n != m and (n, m) not in set(family):
                score = round(sum(w for w, p, q in zip(weights.values(), x, y) if p is not None and p == q), 6)
                if score > 0:
                    by.setdefault(n, []).append((-score, m))
    for n, pairs in by.items():
        want += [(n, m, -s, k) for k, (s, m) in enumerate(sorted(pairs)[:5], 1)]
    f = spark.createDataFrame(rows, "name long, country string, t string, s long, u double")
    assert Counter(map(tuple, similar(f, spark.createDataFrame(family, "a long, b long"), weights).collect())) == Counter(want)


def test_similar_parts_meet_by_features(spark, data):
    joins = [x for x in plan(KG["j19_similar_parts"](spark, data)).splitlines() if "Join" in x and "country#" in x]
    assert joins and all("p_type#" in x or "p_size#" in x for x in joins)


@pytest.mark.parametrize("least", [1, 2, 3])
def test_sharing_pairs_same_as_all_pairs(spark, least):
    """Also without confidences: that of the first shared tail that has one; before, the first tail's alone."""
    rng, best = random.Random(7), {}
    rows = [(rng.choice("abcdefghijklmnopq"), "r", rng.choice("uvwxyz"), rng.choice([None, 0.5, 0.7, 0.9])) for _ in range(70)]
    rows += [("hub", "r", t, None) for t in "uvwxyz"] + [("nul", "r", "u", None), ("nul", "r", "v", None), ("two", "r", "u", None), ("two", "r", "v", 0.8), (None, "r", "u", 0.5), ("a", "r", None, 0.5), ("a", "other", "u", 1.0)]
    for h, r, t, c in rows:
        if r == "r" and None not in (h, t):
            best.setdefault(h, {})[t] = max([x for x in (best.get(h, {}).get(t), c) if x is not None], default=None)
    want = []
    for a in best:
        for b in best:
            both = sorted(best[a].keys() & best[b].keys())
            if a != b and len(both) >= least:
                known = [min(x) for t in both if (x := [v for v in (best[a][t], best[b][t]) if v is not None])]
                want.append((a, "n", b, round(known[0] - 0.05, 4) if known else None, len(both)))
    got = sharing_pairs(spark.createDataFrame(rows, "head string, relation string, tail string, confidence double"), "r", "n", least, 0.05).collect()
    assert Counter(map(tuple, got)) == Counter(want) and (least == 3 or any(w[3] is None for w in want))
