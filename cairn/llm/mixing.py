"""Problem 8: mixing sources to target weights.

Method. Cube-method balanced sampling. The size of the mix is the largest for which every source can give its
share within its cap: S = min(max_repeats * tokens / share). A document of source s then occurs share * S / tokens times on
average: the whole part of that in every case, one time more with the fraction as inclusion probability. The flight
moves these probabilities along the null space of the two constraints (tokens, documents) until each is 0 or 1; steps up and down are
drawn so that every document keeps its inclusion probability. It goes from large to small. The largest documents
move one at a time against all smaller ones at once, whose probabilities are kept as a line alpha + beta * tokens, so that
what a large document adds or misses is spread over everything that follows. Then the others move three at a time, block by block;
each block leaves a few fractions, these fly again, and the landing tries every outcome for the last dozen and takes the
one nearest to the token total. The order is the same for sources of any size: up to a block of documents goes one at a time.

Scale. Documents travel as (id, tokens), never with text. Blocks are of bounded size whatever the share of a source, so a
source with a third of all rows is many blocks; what blocks leave is a thousandth of their rows. The largest documents are found
from the counts of equal sizes. Totals are partial aggregates; per source one row comes to the driver (as many as mix_targets has).

Defined results. Documents of no listed source, or of a null source, are not in the mix. Sources without tokens cannot
contribute: the others keep their proportions. Documents without tokens are drawn like any other and add nothing.
Identical texts under several ids are several documents. An empty mix_targets or documents table gives no rows.
Runs are repeatable: draws are seeded by source and block.
"""

from __future__ import annotations

import zlib
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from cairn.llm.byte_bpe import VOCABULARY, count
from cairn.session import cut

BLOCK = 20_000
LEFT = 12


def flight(tokens: np.ndarray, p: np.ndarray, left: int, seed: int) -> np.ndarray:
    """Probabilities after the flight: all 0 or 1 but at most `left`, the smallest; totals of p and of p * tokens are kept."""
    rng = np.random.default_rng(seed)
    order = np.lexsort((rng.random(len(p)), -tokens)).tolist()  # from large to small, ties by lot
    p = p.astype(float).tolist()
    t = tokens.astype(float).tolist()
    open_ = [i for i in order if 1e-9 < p[i] < 1 - 1e-9]
    queue = iter(open_)
    active: list[int] = []
    waiting = len(open_)
    coins = iter(rng.random(3 * len(open_) + 8).tolist())
    while waiting > max(left, 2):
        while len(active) < 3:
            active.append(next(queue))
        i, j, k = active
        a, b, c = t[j] - t[k], t[k] - t[i], t[i] - t[j]
        if a == 0 and b == 0 and c == 0:
            a, b, c = 1.0, -1.0, 0.0
        up = down = float("inf")
        for x, u in ((i, a), (j, b), (k, c)):
            if u > 0:
                up, down = min(up, (1 - p[x]) / u), min(down, p[x] / u)
            elif u < 0:
                up, down = min(up, -p[x] / u), min(down, -(1 - p[x]) / u)
        step = up if next(coins) * (up + down) < down else -down
        for x, u in ((i, a), (j, b), (k, c)):
            p[x] = p[x] + step * u
            if p[x] < 1e-9:
                p[x] = 0.0
            elif p[x] > 1 - 1e-9:
                p[x] = 1.0
        active = [x for x in active if 0 < p[x] < 1]
        waiting = sum(0 < p[x] < 1 for x in (i, j, k)) + waiting - 3
    return np.array(p)


def one_by_one(tokens: np.ndarray, alpha: float, beta: float, rest: tuple, seed: int) -> tuple[np.ndarray, float, float]:
    """Draws documents from large to small, each against all that follow; (0 or 1 each, alpha and beta of those that follow).

    tokens: falling. rest: number, sum, sum of squares, least and most tokens of the documents after these. Probabilities are
    alpha + beta * tokens. A step moves the one drawn to 0 or 1 and the line of the others so that documents and tokens keep
    their totals; where that would leave [0, 1], so that tokens do; where that would, too, as far as it goes.
    """
    rng = np.random.default_rng(seed)
    t = tokens.astype(float)
    n0, n1, n2, least, most = (float(x or 0) for x in rest)
    s0 = n0 + np.arange(len(t) - 1, -1, -1)
    s1 = n1 + t.sum() - np.cumsum(t)
    s2 = n2 + (t**2).sum() - np.cumsum(t**2)
    low = min(t[-1] if len(t) else least, least if n0 else np.inf)
    coins, out = rng.random(len(t)), np.zeros(len(t))
    for i, x in enumerate(t):
        p = min(1.0, max(0.0, alpha + beta * x))
        hit = coins[i] < p
        out[i] = float(hit)
        if s0[i] < 0.5:
            break
        step = out[i] - p
        high = t[i + 1] if i + 1 < len(t) else most
        det = s0[i] * s2[i] - s1[i] ** 2
        lines = []
        if det > 1e-9 * s0[i] * s2[i]:
            lines.append(((x * s1[i] - s2[i]) / det, (s1[i] - x * s0[i]) / det))
        if s1[i] > 0:
            lines.append((-x / s1[i], 0.0))
        for a, b in lines:
            # both ways must be open, or the choice between them would not be fair
            ends = [alpha + beta * y + w * (a + b * y) for y in (low, high) for w in (1 - p, -p)]
            if min(ends) >= -1e-12 and max(ends) <= 1 + 1e-12:
                alpha, beta = alpha + step * a, beta + step * b
                break
        else:
            if s1[i] > 0:  # larger than what follows can make up for
                wanted = alpha * s1[i] + beta * s2[i] - step * x
                alpha, beta = min(1.0, max(0.0, wanted / s1[i])), 0.0
    return out, alpha, beta


def landing(tokens: np.ndarray, p: np.ndarray, missing: float) -> np.ndarray:
    """The outcome of the last fractions (at most LEFT) nearest to the missing tokens, then to the missing documents."""
    n = len(p)
    if n == 0:
        return p
    codes = (np.arange(2**n)[:, None] >> np.arange(n)) & 1
    by_tokens = np.abs(codes @ tokens - missing)
    by_count = np.abs(codes.sum(axis=1) - p.sum())
    return codes[np.lexsort((by_count, by_tokens))[0]].astype(float)


def _seed(source: str, block: int, turn: int) -> int:
    return zlib.crc32(f"{source}|{block}|{turn}".encode())


def _fly(turn: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["h", "doc_id"], kind="stable").reset_index(drop=True)
        pdf["p"] = flight(pdf["n_tokens"].to_numpy(), pdf["p"].to_numpy(), LEFT, _seed(str(pdf["source"].iloc[0]), int(pdf["block"].iloc[0]), turn))
        return pdf

    return run


def _largest(pdf: pd.DataFrame) -> pd.DataFrame:
    """Draws the largest documents of a source; the last dozen of a source that has no others stays for the landing."""
    pdf = pdf.sort_values(["n_tokens", "h", "doc_id"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
    one = pdf.iloc[0]
    rest = [one[c] for c in ("n0", "n1", "n2", "least", "most")]
    keep = LEFT if not rest[0] else 0
    t = pdf["n_tokens"].to_numpy()
    m = max(0, len(t) - keep)
    tail = t[m:].astype(float)
    if keep and len(tail):
        rest = [len(tail), tail.sum(), (tail**2).sum(), tail.min(), tail.max()]
    out, alpha, beta = one_by_one(t[:m], float(one["p"]), 0.0, rest, _seed(str(one["source"]), 0, 0))
    pdf["p"] = np.concatenate([out, np.clip(alpha + beta * tail, 0.0, 1.0)])
    pdf["alpha"], pdf["beta"] = alpha, beta
    return pdf[[c.split()[0] for c in _FIRST.split(", ")]]


def _land(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values(["h", "doc_id"], kind="stable").reset_index(drop=True)
    p = flight(pdf["n_tokens"].to_numpy(), pdf["p"].to_numpy(), LEFT, _seed(str(pdf["source"].iloc[0]), 0, 99))
    free = (p > 0) & (p < 1)
    sure = float((p[~free] * pdf["n_tokens"].to_numpy()[~free]).sum())
    p[free] = landing(pdf["n_tokens"].to_numpy()[free].astype(float), p[free], float(pdf["goal"].iloc[0]) - sure)
    pdf["p"] = p
    return pdf


_STATE = "source string, doc_id long, n_tokens long, p double, h long, block int, goal double"


_FIRST = _STATE + ", alpha double, beta double"


def plan(totals: list[tuple], targets: list[tuple]) -> dict[str, tuple[float, float]]:
    """source -> (copies of a document on average, tokens wanted). totals: (source, documents, tokens); targets: (source, share, cap)."""
    tokens = {s: t for s, _, t in totals if t}
    usable = [(s, w, m) for s, w, m in targets if s in tokens and w and m and w > 0 and m > 0]
    whole = sum(w for _, w, _ in usable)
    if not usable:
        return {}
    size = min(m * tokens[s] / (w / whole) for s, w, m in usable)
    return {s: (min(float(m), w / whole * size / tokens[s]), w / whole * size) for s, w, m in usable}


def _draw(u: DataFrame) -> DataFrame:
    """source, doc_id, n_tokens, p with every p 0 or 1: flights block by block, then a landing per source near goal."""
    columns = [c.split()[0] for c in _STATE.split(", ")]
    state = cut(u.select(*columns).groupBy("source", "block").applyInPandas(_fly(0), _STATE))
    is_open = (F.col("p") > 0) & (F.col("p") < 1)
    decided, turn = [], 0
    while (most := state.filter(is_open).groupBy("source").count().agg(F.max("count")).first()[0] or 0) > BLOCK:
        turn += 1
        decided.append(state.filter(~is_open))
        again = F.pmod(F.xxhash64("h", F.lit(turn)), F.lit(-(-most // BLOCK))).cast("int")
        state = cut(state.filter(is_open).withColumn("block", again).groupBy("source", "block").applyInPandas(_fly(turn), _STATE))
    done = reduce(DataFrame.unionByName, [*decided, state.filter(~is_open)])
    drawn = done.groupBy("source").agg(F.sum(F.col("p") * F.col("n_tokens")).alias("_drawn"))
    left = state.filter(is_open).join(F.broadcast(drawn), "source", "left").withColumn("goal", F.col("goal") - F.coalesce("_drawn", F.lit(0.0)))  # one row per source of the mix
    landed = left.select(*columns).groupBy("source").applyInPandas(_land, _STATE)
    return done.unionByName(landed).select("source", "doc_id", "n_tokens", "p")


def mix(docs: DataFrame, targets: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """doc_id, source, n_tokens, copies, target_share, actual_share of every document in the mix."""
    spark = docs.sparkSession
    wanted = targets.groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats")).filter(F.col("source").isNotNull())
    counted = cut(count(docs.join(F.broadcast(wanted.select("source")), "source", "left_semi"), ["doc_id", "source"], path))  # one row per source of the mix
    totals = [tuple(r) for r in counted.groupBy("source").agg(F.count("*"), F.sum("n_tokens")).collect()]  # one row per source of the mix
    rates = plan(totals, [tuple(r) for r in wanted.select("source", "target_share", "max_repeats").collect()])
    rows = []
    for s, n, t in totals:
        if s in rates:
            r, goal = rates[s]
            base = int(r + 1e-12)
            rows.append((s, float(base), max(0.0, r - base), goal - base * t, max(1, -(-n // BLOCK))))
    rate = F.broadcast(spark.createDataFrame(rows, "source string, base double, frac double, goal double, blocks int"))  # one row per source of the mix
    u = counted.join(rate, "source").withColumn("h", F.xxhash64("doc_id", "n_tokens")).withColumn("block", F.pmod("h", "blocks").cast("int"))
    # the largest documents of a source, at most a block: from the size up to which that many are counted
    sizes = counted.groupBy("source", "n_tokens").agg(F.count("*").alias("n"))
    falling = W.partitionBy("source").orderBy(F.col("n_tokens").desc())  # distinct sizes, not documents
    sizes = sizes.withColumn("first", F.sum("n").over(falling) <= BLOCK)
    under = F.when(~F.col("first"), F.col("n_tokens").cast("double"))
    many = lambda x: F.coalesce(F.sum(F.when(~F.col("first"), F.col("n") * x)), F.lit(0.0)).alias
    rest = sizes.groupBy("source").agg(
        F.min(F.when(F.col("first"), F.col("n_tokens"))).alias("from_size"), many(F.lit(1.0))("n0"), many(under)("n1"), many(under * under)("n2"), F.min(under).alias("least"), F.max(under).alias("most")
    )
    u = u.join(F.broadcast(rest), "source").withColumn("p", F.col("frac"))  # one row per source of the mix
    large = u.filter(F.col("n_tokens") >= F.col("from_size")).groupBy("source").applyInPandas(_largest, _FIRST)
    large = cut(large)
    line = large.groupBy("source").agg(F.first("alpha").alias("alpha"), F.first("beta").alias("beta"), F.sum(F.when(F.col("p") == 1, F.col("n_tokens"))).alias("_drawn"))
    state = [c.split()[0] for c in _STATE.split(", ")]
    small = u.filter(F.coalesce(F.col("n_tokens") < F.col("from_size"), F.lit(True))).join(F.broadcast(line), "source", "left")  # one row per source of the mix
    at = F.coalesce("alpha", "frac") + F.coalesce("beta", F.lit(0.0)) * F.col("n_tokens")
    small = small.withColumn("p", F.greatest(F.lit(0.0), F.least(F.lit(1.0), at))).withColumn("goal", F.col("goal") - F.coalesce("_drawn", F.lit(0)))
    open_ = (F.col("p") > 0) & (F.col("p") < 1)
    tail = large.filter(open_).join(F.broadcast(line.select("source", "_drawn")), "source").withColumn("goal", F.col("goal") - F.coalesce("_drawn", F.lit(0)))
    drawn = large.filter(~open_).select("source", "doc_id", "n_tokens", "p").unionByName(_draw(small)).unionByName(tail.select(*state).groupBy("source").applyInPandas(_land, _STATE).select("source", "doc_id", "n_tokens", "p"))
    both = drawn.join(rate.select("source", "base"), "source")
    taken = cut(both.withColumn("copies", (F.col("base") + F.col("p")).cast("int")).filter("copies > 0").select("doc_id", "source", "n_tokens", "copies"))
    per = taken.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("_t"))
    shares = per.crossJoin(F.broadcast(per.agg(F.sum("_t").alias("_all"))))  # one row by one row per source
    shares = shares.select("source", (F.col("_t") / F.col("_all")).alias("actual_share")).join(wanted.select("source", "target_share"), "source")
    return taken.join(F.broadcast(shares), "source").select("doc_id", "source", "n_tokens", "copies", "target_share", "actual_share")


def shares(docs: DataFrame, targets: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """Per source: documents, copies, tokens, target and actual share; sources that contribute nothing with 0."""
    m = mix(docs, targets, path).groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("copies").alias("n_copies"), F.max("copies").alias("most_copies"), F.sum(F.col("copies") * F.col("n_tokens")).alias("n_tokens"))
    whole = m.agg(F.sum("n_tokens").alias("_all"))
    out = targets.select("source", "target_share", "max_repeats").join(m, "source", "left").crossJoin(F.broadcast(whole))  # one row
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return out.select("source", "target_share", "max_repeats", zero("n_docs"), zero("n_copies"), zero("most_copies"), zero("n_tokens"), F.coalesce(F.col("n_tokens") / F.col("_all"), F.lit(0.0)).alias("actual_share"))
