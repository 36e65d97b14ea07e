"""Metrics, ranks, curves, intervals and resampling (W-*, A-14..A-21, R-12, R-13, R-35..R-37, X-32, X-33)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from cairn.session import cut


def filtered_ranks(scores: DataFrame, known: DataFrame) -> DataFrame:
    """query, target, rank: candidates that score at least the target's, other true ones left out.

    scores: query, cand, target, score; known: query, cand (true answers).
    """
    target = scores.filter(F.col("cand") == F.col("target")).select("query", "target", F.col("score").alias("_s"))
    others = scores.join(known.select("query", "cand"), ["query", "cand"], "left_anti").select("query", "score")
    return others.join(target, "query", "right").groupBy("query", "target").agg((F.count_if(F.col("score") >= F.col("_s")) + 1).alias("rank"))


def rank_metrics(ranks: DataFrame, *by: str) -> DataFrame:
    """n, mrr, hits at 1, 3 and 10."""
    return ranks.groupBy(*by).agg(F.count("*").alias("n"), F.avg(1 / F.col("rank")).alias("mrr"), *[F.avg((F.col("rank") <= k).cast("double")).alias(f"hits_{k}") for k in (1, 3, 10)])


def reciprocal_rank(ranked: DataFrame) -> DataFrame:
    """query, rr of the first hit; 0 without one. ranked: query, rank, hit."""
    return ranked.groupBy("query").agg(F.coalesce(1 / F.min(F.when(F.col("hit"), F.col("rank"))), F.lit(0.0)).alias("rr"))


def ndcg(ranked: DataFrame, k: int) -> DataFrame:
    """query, ndcg at k. ranked: query, rank, rel, n_refs; the ideal has min(k, n_refs) ones for binary relevance."""
    gain = F.sum(F.when(F.col("rank") <= k, F.col("rel") / F.log2(F.col("rank") + 1)).otherwise(0.0))
    ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(F.least(F.lit(k), F.max("n_refs")), F.lit(1)).cast("int")), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1))
    return ranked.groupBy("query").agg((gain / ideal).alias("ndcg"))


def ordered(df: DataFrame, *order: str | Column, totals: tuple[str, ...] = (), lasts: tuple[str, ...] = ()) -> DataFrame:
    """Adds _row (1, 2, ... over all rows in the order), _cum_<c> for totals and _prev_<c> for lasts, without one task holding all rows.

    Rows are range-partitioned by the order and numbered within their partition; what lies before each partition comes
    from a table with one row per partition. The order must be total.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    b = cut(df.repartitionByRange(parts, *order).withColumn("_b", F.spark_partition_id()))
    w = W.partitionBy("_b").orderBy(*order)
    so_far = w.rowsBetween(W.unboundedPreceding, 0)
    key = F.struct(*order)
    sizes = b.groupBy("_b").agg(F.count("*").alias("_n"), *[F.sum(c).alias(f"_s_{c}") for c in totals], *[F.max_by(F.struct(c), key).alias(f"_l_{c}") for c in lasts])
    before = W.partitionBy(F.lit(0)).orderBy("_b")  # one row per partition
    sizes = sizes.select(
        "_b", (F.sum("_n").over(before) - F.col("_n")).alias("_before"), *[(F.sum(f"_s_{c}").over(before) - F.col(f"_s_{c}")).alias(f"_s_{c}") for c in totals], *[F.lag(f"_l_{c}").over(before).alias(f"_l_{c}") for c in lasts]
    )
    out = b.join(F.broadcast(sizes), "_b").withColumn("_in", F.row_number().over(w))  # as many rows as partitions
    out = out.withColumn("_row", F.col("_in") + F.col("_before"))
    for c in totals:
        out = out.withColumn(f"_cum_{c}", F.sum(c).over(so_far) + F.coalesce(f"_s_{c}", F.lit(0)))
    for c in lasts:
        out = out.withColumn(f"_prev_{c}", F.when(F.col("_in") > 1, F.lag(c).over(w)).otherwise(F.col(f"_l_{c}")[c]))
    return out.drop("_b", "_before", "_in", *[f"_s_{c}" for c in totals], *[f"_l_{c}" for c in lasts])


def risk_coverage(preds: DataFrame) -> DataFrame:
    """id, conf, coverage, risk, area: risk among the most confident, and the trapezoid up to each point. preds: id, conf, correct; ties go by id."""
    p = preds.select("id", "conf", (-F.col("conf")).alias("_c"), (~F.col("correct")).cast("int").alias("wrong"))
    o = ordered(p, "_c", "id", totals=("wrong",)).crossJoin(F.broadcast(p.agg(F.count("*").alias("_all"))))  # one row
    k, n, x = F.col("_row"), F.col("_all"), F.col("_cum_wrong")
    before = (x - F.col("wrong")) / (k - 1)
    return o.select("id", "conf", (k / n).alias("coverage"), (x / k).alias("risk"), F.when(k > 1, (1 / n) * (x / k + before) / 2).otherwise(0.0).alias("area"))


def z_scores(df: DataFrame, value: str) -> DataFrame:
    s = df.agg(F.avg(value).alias("_m"), F.stddev_pop(value).alias("_s"))
    return df.crossJoin(F.broadcast(s)).withColumn("z", (F.col(value) - F.col("_m")) / (F.col("_s") + 1e-8)).drop("_m", "_s")  # one row


def nearest_rank(df: DataFrame, value: str, q: float, *by: str) -> DataFrame:
    """The q-quantile xs[min(n - 1, int(q * n))] by rank, not by interpolation."""
    r = df.filter(F.col(value).isNotNull()).select(*by, F.col(value).alias("quantile"), F.monotonically_increasing_id().alias("_t"))
    o = ordered(r, *by, "quantile", "_t")
    g = o.groupBy(*by).agg(F.min("_row").alias("_first"), F.count("*").alias("_n")) if by else o.agg(F.min("_row").alias("_first"), F.count("*").alias("_n"))
    at = F.col("_first") + F.least(F.col("_n") - 1, F.floor(F.lit(q) * F.col("_n")))
    wanted = g.select(at.alias("_row"))
    return o.join(wanted, "_row").select(*by, "quantile")


def confusion(pairs: DataFrame) -> DataFrame:
    """both, corrected, regressed, neither of two systems' answers. pairs: a, b booleans."""
    return pairs.agg(
        F.count_if(F.col("a") & F.col("b")).alias("both"), F.count_if(~F.col("a") & F.col("b")).alias("corrected"),
        F.count_if(F.col("a") & ~F.col("b")).alias("regressed"), F.count_if(~F.col("a") & ~F.col("b")).alias("neither"),
    )


def transitions(pairs: DataFrame) -> DataFrame:
    """Counts of every pair of outcomes. pairs: before, after."""
    return pairs.groupBy("before", "after").agg(F.count("*").alias("n"))


def prf(rows: DataFrame, *by: str) -> DataFrame:
    """precision, recall, f1. rows: predicted, gold booleans."""
    tp, p, g = F.count_if(F.col("predicted") & F.col("gold")), F.count_if("predicted"), F.count_if("gold")
    r = rows.groupBy(*by).agg(tp.alias("tp"), p.alias("n_predicted"), g.alias("n_gold"))
    pr, rc = F.col("tp") / F.greatest("n_predicted", F.lit(1)), F.col("tp") / F.greatest("n_gold", F.lit(1))
    return r.select(*by, "tp", "n_predicted", "n_gold", pr.alias("precision"), rc.alias("recall"), F.coalesce(2 * pr * rc / F.nullif(pr + rc, F.lit(0.0)), F.lit(0.0)).alias("f1"))


def kappa(pairs: DataFrame) -> DataFrame:
    """Cohen's kappa of two raters. pairs: a, b labels."""
    n = pairs.agg(F.count("*").alias("n"), F.avg((F.col("a") == F.col("b")).cast("double")).alias("po"))
    a = pairs.groupBy(F.col("a").alias("l")).agg(F.count("*").alias("na"))
    b = pairs.groupBy(F.col("b").alias("l")).agg(F.count("*").alias("nb"))
    e = a.join(b, "l").agg(F.sum(F.col("na") * F.col("nb")).alias("s"))
    pe = F.coalesce("s", F.lit(0)) / (F.col("n") * F.col("n"))
    return n.crossJoin(F.broadcast(e)).select("n", F.col("po").alias("agreement"), ((F.col("po") - pe) / (1 - pe)).alias("kappa"))  # one row by one row


def bootstrap(df: DataFrame, value: str, samples: int = 200, seed: int = 1, confidence: float = 0.95) -> DataFrame:
    """mean, low, high of a mean by Poisson resampling: each row counts Poisson(1) times in each sample.

    The draws are hashes of (row hash, sample), so the result is the same however rows are partitioned.
    """
    u = lambda s: (F.xxhash64("_h", s).cast("double") / 2.0**64) + 0.5
    cdf = [0.36787944, 0.73575888, 0.91969860, 0.98101184, 0.99634015, 0.99940582, 0.99991676]
    weight = lambda x: sum(((x > c).cast("int") for c in cdf), F.lit(0))
    rows = df.filter(F.col(value).isNotNull()).select(F.col(value).cast("double").alias("x"), F.xxhash64(*df.columns, F.lit(seed)).alias("_h"))
    drawn = rows.select("x", "_h", F.explode(F.sequence(F.lit(1), F.lit(samples))).alias("s")).select("s", "x", weight(u("s")).alias("w"))
    means = drawn.groupBy("s").agg((F.sum(F.col("x") * F.col("w")) / F.sum("w")).alias("m"))
    q = (1 - confidence) / 2
    return rows.agg(F.avg("x").alias("mean")).crossJoin(means.agg(F.percentile("m", q).alias("low"), F.percentile("m", 1 - q).alias("high")))  # one row by one row


def stratified(df: DataFrame, stratum: str, id_: str, n: int, seed: int = 1) -> DataFrame:
    """n rows per stratum in the order of a seeded hash; the sample is the feature."""
    w = W.partitionBy(stratum).orderBy(F.xxhash64(F.col(id_).cast("string"), F.lit(seed)), id_)
    return df.withColumn("_k", F.row_number().over(w)).filter(F.col("_k") <= n).drop("_k")


def runs(df: DataFrame, order: str, *values: str) -> DataFrame:
    """Adjacent equal rows as runs: first and last place and length. order: a unique column."""
    o = ordered(df.select(order, *values), order, lasts=values)
    same = F.col("_row") > 1
    for v in values:
        same = same & F.col(f"_prev_{v}").eqNullSafe(F.col(v))
    g = ordered(o.select(order, *values, F.when(same, 0).otherwise(1).alias("_new")), order, totals=("_new",))
    return g.groupBy("_cum__new", *values).agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("n")).drop("_cum__new")


def first_divergence(a: DataFrame, b: DataFrame) -> DataFrame:
    """id, place: the first place at which two traces differ. a, b: id, trace array<string>."""
    x = a.select("id", F.posexplode("trace").alias("place", "x"))
    y = b.select("id", F.posexplode("trace").alias("place", "y"))
    d = x.join(y, ["id", "place"], "full").filter(~F.col("x").eqNullSafe(F.col("y")))
    return d.groupBy("id").agg(F.min("place").alias("place"))


def cardinality_delta(df: DataFrame, *by: str) -> DataFrame:
    """n, mean and median size, mean gain. df: size, a, b (correctness of two systems)."""
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.avg("size").alias("mean_size"), F.percentile("size", 0.5).alias("median_size"), F.avg(F.col("b").cast("int") - F.col("a").cast("int")).alias("gain"))
