from cairn.queries.analytics import QUERIES
from cairn.session import table


def test_every_queue_takes_turns(spark, data):
    first = {}
    for r in table(spark, data, "lineitem").select("l_suppkey", "l_partkey", "l_orderkey").collect():
        queue = first.setdefault(r.l_suppkey, {})
        queue[r.l_partkey] = min(r.l_orderkey, queue.get(r.l_partkey, r.l_orderkey))
    best = {}
    for queue, items in first.items():
        for rank, item in enumerate(sorted(items, key=lambda i: (items[i], i)), 1):
            best[item] = min((rank, queue), best.get(item, (rank, queue)))
    want = sorted((rank, queue, item) for item, (rank, queue) in best.items())[:30]
    got = [(r.item, r.rank) for r in QUERIES["t08_round_robin_all"](spark, data).collect()]
    assert sorted(got) == sorted((item, rank) for rank, _, item in want) and any(queue >= 5 for _, queue, _ in want)
