import random

from cairn.operators import fusion as U


def test_components_of_a_long_chain(spark):
    ids = list(range(300))
    random.Random(5).shuffle(ids)
    pairs = [*zip(ids, ids[1:]), (1000, 1001), (2000, 2000), (3000, None)]
    got = {r.node: r.component for r in U.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == dict.fromkeys(ids, 0) | {1000: 1000, 1001: 1000, 2000: 2000}


def test_cover_leaves_nothing(spark):
    rng = random.Random(2)
    sets = {f"s{i:02d}": {rng.randrange(60) for _ in range(rng.randint(1, 3))} | {100 + i} for i in range(35)}
    got = [(r.turn, r.set, r.gain) for r in U.cover(spark.createDataFrame([(s, i) for s, x in sets.items() for i in x] + [(None, 1), ("n", None)], "set string, item long")).orderBy("turn").collect()]
    left, want = set().union(*sets.values()), []
    while left:
        gain, name = max((len(x & left), s) for s, x in sets.items())
        want.append((len(want) + 1, name, gain))
        left -= sets[name]
    assert got == want and len(want) > 20
    assert U.cover(spark.createDataFrame([], "set string, item long")).count() == 0
