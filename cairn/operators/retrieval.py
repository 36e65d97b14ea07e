"""Lexical, vector and graph retrieval with rank fusion (engine E6; T-*, W-01, X-21..X-25, R-38)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from cairn.functions import text as T


def worded(docs: DataFrame, id_: str, words: Column) -> DataFrame:
    """doc, w, len: the words of each document; documents without words are left out."""
    w = docs.select(F.col(id_).alias("doc"), words.alias("w")).filter("doc is not null and w is not null")
    return w.withColumn("len", F.size("w")).filter("len > 0")


def bm25(docs: DataFrame, queries: DataFrame, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """query, doc, score > 0. docs: worded(); queries: query, term (distinct).

    Counts and lengths cover all documents; only occurrences of the queries' words are shuffled.
    """
    whole = docs.agg(F.count("*").alias("n"), F.avg("len").alias("mean"))
    q = queries.select("query", "term").distinct()
    posts = docs.select("doc", "len", F.explode("w").alias("term")).join(q.select("term").distinct(), "term", "left_semi")
    posts = posts.groupBy("doc", "len", "term").agg(F.count("*").alias("tf"))
    df = posts.groupBy("term").agg(F.count("*").alias("df"))
    hit = posts.join(q, "term").join(df, "term").crossJoin(F.broadcast(whole))  # one row
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    tf = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("mean")))
    return hit.groupBy("query", "doc").agg(F.sum(idf * tf).alias("score")).filter("score > 0")


def top_k(scores: DataFrame, k: int, *ties: str) -> DataFrame:
    """query, doc, score, rank with ties by the given columns (the document id if none)."""
    order = [F.desc("score"), *[F.asc(t) for t in (ties or ("doc",))]]
    r = scores.withColumn("rank", F.row_number().over(W.partitionBy("query").orderBy(*order)))
    return r.filter(F.col("rank") <= k)


def expand_terms(queries: DataFrame, triggers: DataFrame) -> DataFrame:
    """query, term: the words of a query and what its triggers add. triggers: trigger, term."""
    more = queries.join(triggers, queries["term"] == triggers["trigger"]).select("query", triggers["term"])
    return queries.select("query", "term").unionByName(more).distinct()


def vector_scores(vectors: DataFrame, queries: DataFrame) -> DataFrame:
    """query, doc, score: cosine of every vector with a stated, broadcast set of queries (checked: at most 10,000)."""
    if queries.limit(10_001).count() > 10_000:
        raise ValueError("search in blocks of at most 10,000 queries")
    v = vectors.select(F.col("vec_id").alias("doc"), T.normal_vector(F.col("embedding")).alias("_v"))
    q = queries.select(F.col("vec_id").alias("query"), T.normal_vector(F.col("embedding")).alias("_q"))
    return v.join(F.broadcast(q)).select("query", "doc", T.inner_product(F.col("_v"), F.col("_q")).alias("score"))


def fuse(lists: list[DataFrame], k: int = 60, boost: Column | None = None, by: float = 1.3) -> DataFrame:
    """query, doc, score: reciprocal ranks summed over the lists; boost multiplies where it holds."""
    parts = [x.select("query", "doc", (1.0 / (k + F.col("rank"))).alias("s"), F.lit(i).alias("list"), "rank") for i, x in enumerate(lists)]
    u = parts[0]
    for p in parts[1:]:
        u = u.unionByName(p)
    g = u.groupBy("query", "doc").agg(F.sum("s").alias("s"), F.min(F.struct("list", "rank")).alias("first_seen"))
    score = F.col("s") if boost is None else F.when(boost, F.col("s") * by).otherwise(F.col("s"))
    return g.select("query", "doc", F.round(score, 6).alias("score"), "first_seen")


def rerank(candidates: DataFrame, score: Column, threshold: float | None = None) -> DataFrame:
    """New ranks by a score column; the old rank breaks ties."""
    r = candidates.withColumnRenamed("rank", "old_rank").withColumn("new_score", score)
    if threshold is not None:
        r = r.filter(F.col("new_score") >= threshold)
    return r.withColumn("rank", F.row_number().over(W.partitionBy("query").orderBy(F.desc("new_score"), "old_rank")))


def rank_changes(reranked: DataFrame, k: int = 3) -> DataFrame:
    """The k most promoted and demoted documents per query."""
    d = reranked.withColumn("change", F.col("old_rank") - F.col("rank"))
    up, down = W.partitionBy("query").orderBy(F.desc("change"), "doc"), W.partitionBy("query").orderBy("change", "doc")
    d = d.withColumn("_u", F.row_number().over(up)).withColumn("_d", F.row_number().over(down))
    return d.filter((F.col("_u") <= k) | (F.col("_d") <= k)).select("query", "doc", "old_rank", "rank", "change")


def substring_rank(docs: DataFrame, terms: list[str], k: int) -> DataFrame:
    """The k texts that contain most terms; texts without any follow by id."""
    hits = sum((F.contains(F.lower("text"), F.lit(t.lower())).cast("int") for t in terms), F.lit(0))
    return docs.select("doc", F.coalesce(hits, F.lit(0)).alias("score")).orderBy(F.desc("score"), "doc").limit(k)


def round_robin(ranked: DataFrame, budget: int) -> DataFrame:
    """At most `budget` items from ranked queues taken in turns; an item of several queues counts where it comes first."""
    first = ranked.groupBy("item").agg(F.min(F.struct("rank", "queue")).alias("f")).select("item", "f.rank", "f.queue")
    return first.orderBy("rank", "queue", "item").limit(budget)


def hard_negatives(scored: DataFrame, answers: DataFrame, k: int = 3, depth: int = 50) -> DataFrame:
    """query, positive, negative, rank: the first of the top texts that holds the answer (else the top one) and the next k without.

    scored: query, doc, text, score; answers: query, answer.
    """
    top = top_k(scored, depth).join(answers, "query").withColumn("holds", F.contains(F.lower("text"), F.lower("answer")))
    pos = top.groupBy("query").agg(F.coalesce(F.min_by("doc", F.when(F.col("holds"), F.col("rank"))), F.min_by("doc", "rank")).alias("positive"))
    neg = top.filter(~F.col("holds")).join(pos, "query").filter(F.col("doc") != F.col("positive"))
    neg = neg.withColumn("nth", F.row_number().over(W.partitionBy("query").orderBy("rank"))).filter(F.col("nth") <= k)
    return neg.select("query", "positive", F.col("doc").alias("negative"), "nth")


def hubness(ranked: DataFrame, weight: float = 0.1) -> DataFrame:
    """query, doc, score, hub, penalised: how often a document is in top lists, and scores lowered by it."""
    hub = ranked.groupBy("doc").agg(F.count("*").alias("hub"))
    return ranked.join(hub, "doc").select("query", "doc", "score", "hub", (F.col("score") - weight * F.log1p("hub")).alias("penalised"))
