"""Queries of retrieval, metrics, text functions, sources and event time."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from cairn.functions import text as T
from cairn.operators import evaluation as E
from cairn.operators import retrieval as R
from cairn.queries.registry import Registry
from cairn.session import shared_folder, table
from cairn.sources import driver_graph as D
from cairn.sources import readers
from cairn.streaming import events as ST

q = Registry()

ASKED = [("q1", "magnetron sea clutter"), ("q2", "cheap radar repair"), ("q3", "receiver noise figure")]
_TOK = "regexp_extract_all(lower(text), '[a-z0-9]+|[\\x{4e00}-\\x{9fff}]')"
BM25 = f"""WITH w AS (SELECT doc_id AS doc, {_TOK} AS w FROM documents WHERE text IS NOT NULL), p AS (SELECT doc, term, count(*) AS tf FROM (SELECT doc, unnest(w) AS term FROM w) GROUP BY 1, 2),
 l AS (SELECT doc, len(w) AS len FROM w WHERE len(w) > 0), s AS (SELECT count(*) AS n, avg(len) AS mean FROM l), df AS (SELECT term, count(*) AS df FROM p GROUP BY 1),
 a(query, term) AS (VALUES {", ".join(f"('{i}', '{t}')" for i, x in ASKED for t in x.split())}),
 sc AS (SELECT query, p.doc, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean))) AS score FROM p JOIN a USING (term) JOIN df USING (term) JOIN l USING (doc), s GROUP BY 1, 2)"""


def _asked(spark):
    return spark.createDataFrame([(i, t) for i, x in ASKED for t in x.split()], "query string, term string")


def _bm25(spark, d):
    return R.bm25(R.worded(table(spark, d, "documents"), "doc_id", T.tokens(F.col("text"))), _asked(spark))


@q("x23_bm25", BM25 + " SELECT query, count(*) AS n, round(max(score), 4) AS best, round(sum(score), 2) AS total FROM sc WHERE score > 0 GROUP BY 1")
def _(spark, d):
    return _bm25(spark, d).groupBy("query").agg(F.count("*").alias("n"), F.round(F.max("score"), 4).alias("best"), F.round(F.sum("score"), 2).alias("total"))


@q("t01_bm25_top", BM25 + " SELECT query, doc, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(score, 6) DESC, doc) AS rank FROM sc) WHERE rank <= 10")
def _(spark, d):
    return R.top_k(_bm25(spark, d).withColumn("score", F.round("score", 6)), 10).select("query", "doc", "rank")


@q("t02_top4_ties", "SELECT o_custkey AS query, o_orderkey AS doc, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority DESC, o_orderkey) AS rank FROM orders) WHERE rank <= 4")
def _(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("query"), F.col("o_orderkey").alias("doc"), F.col("o_orderpriority").alias("score"))
    return R.top_k(o, 4).select("query", "doc", "rank")


VEC = "q AS (SELECT vec_id AS query, embedding AS e FROM embeddings WHERE vec_id % 50 = 0), sc AS (SELECT query, vec_id AS doc, round(list_cosine_similarity(e::DOUBLE[], embedding::DOUBLE[]), 5) AS score FROM embeddings, q)"


def _vectors(spark, d):
    v = table(spark, d, "embeddings")
    return R.vector_scores(v, v.filter("vec_id % 50 = 0")).withColumn("score", F.round("score", 5))


@q("x25_vector_scores", f"WITH {VEC} SELECT query, count(*) AS n, round(sum(score), 2) AS total FROM sc GROUP BY 1")
def _(spark, d):
    return _vectors(spark, d).groupBy("query").agg(F.count("*").alias("n"), F.round(F.sum("score"), 2).alias("total"))


@q("t03_vector_top", f"WITH {VEC} SELECT query, round(score, 3) AS score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM sc) WHERE rank <= 10")
def _(spark, d):
    return R.top_k(_vectors(spark, d), 10).select("query", F.round("score", 3).alias("score"), "rank")


@q("t05_filtered_search", f"WITH {VEC} SELECT query, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM sc JOIN embeddings ON doc = vec_id WHERE label = 1) WHERE rank <= 10 GROUP BY 1")
def _(spark, d):
    v = table(spark, d, "embeddings")
    s = R.vector_scores(v.filter("label = 1"), v.filter("vec_id % 50 = 0")).withColumn("score", F.round("score", 5))
    return R.top_k(s, 10).groupBy("query").agg(F.count("*").alias("n"))


def _lists(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderpriority").alias("query"), F.col("o_custkey").alias("doc"), "o_totalprice", "o_orderdate")
    g = o.groupBy("query", "doc").agg(F.max("o_totalprice").alias("p"), F.max("o_orderdate").alias("t"))
    one = R.top_k(g.select("query", "doc", F.col("p").alias("score")), 20)
    return one, R.top_k(g.select("query", "doc", F.col("t").alias("score")), 20)


LISTS = """g AS (SELECT o_orderpriority AS query, o_custkey AS doc, max(o_totalprice) AS p, max(o_orderdate) AS t FROM orders GROUP BY 1, 2),
 r AS (SELECT query, doc, row_number() OVER (PARTITION BY query ORDER BY p DESC, doc) AS a, row_number() OVER (PARTITION BY query ORDER BY t DESC, doc) AS b FROM g),
 f AS (SELECT query, doc, round(coalesce(CASE WHEN a <= 20 THEN 1.0 / (60 + a) END, 0) + coalesce(CASE WHEN b <= 20 THEN 1.0 / (60 + b) END, 0), 6) AS score, a, b FROM r WHERE a <= 20 OR b <= 20)"""


@q("w01_rank_fusion", f"WITH {LISTS} SELECT query, doc, score FROM f")
def _(spark, d):
    return R.fuse(list(_lists(spark, d))).select("query", "doc", "score")


@q("w01_rank_fusion_boosted", f"WITH {LISTS} SELECT query, doc, round(CASE WHEN doc % 2 = 0 THEN (coalesce(CASE WHEN a <= 20 THEN CAST(1.0 AS DOUBLE) / (60 + a) END, 0) + coalesce(CASE WHEN b <= 20 THEN CAST(1.0 AS DOUBLE) / (60 + b) END, 0)) * 1.3 ELSE score END, 4) AS score FROM f")
def _(spark, d):
    return R.fuse(list(_lists(spark, d)), boost=F.col("doc") % 2 == 0).select("query", "doc", F.round("score", 4).alias("score"))


@q("t04_rerank", f"WITH {LISTS}, x AS (SELECT query, doc, a FROM r WHERE a <= 20) SELECT query, doc, CAST(row_number() OVER (PARTITION BY query ORDER BY doc % 7 DESC, a) AS INTEGER) AS rank FROM x WHERE doc % 7 >= 2")
def _(spark, d):
    return R.rerank(_lists(spark, d)[0], F.col("doc") % 7, 2.0).select("query", "doc", "rank")


@q("r43_rank_changes", f"WITH {LISTS}, x AS (SELECT query, doc, a AS old_rank, row_number() OVER (PARTITION BY query ORDER BY doc % 7 DESC, a) AS rank FROM r WHERE a <= 20), y AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY old_rank - rank DESC, doc) AS u, row_number() OVER (PARTITION BY query ORDER BY old_rank - rank, doc) AS v FROM x) SELECT query, doc, CAST(old_rank - rank AS INTEGER) AS change FROM y WHERE u <= 3 OR v <= 3")
def _(spark, d):
    return R.rank_changes(R.rerank(_lists(spark, d)[0], F.col("doc") % 7)).select("query", "doc", "change")


@q("t06_substring_rank", "SELECT doc_id AS doc, CAST(contains(lower(text), 'clutter') AS INTEGER) + CAST(contains(lower(text), 'magnetron') AS INTEGER) AS score FROM documents WHERE text IS NOT NULL ORDER BY 2 DESC, 1 LIMIT 20")
def _(spark, d):
    t = table(spark, d, "documents").filter("text is not null").select(F.col("doc_id").alias("doc"), "text")
    return R.substring_rank(t, ["clutter", "magnetron"], 20)


@q("t07_candidate_pick", "SELECT o_custkey, arg_max(o_orderkey, (o_orderpriority, -o_orderkey)) AS pick FROM orders GROUP BY 1")
def _(spark, d):
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_orderpriority", -F.col("o_orderkey"))).alias("pick"))


@q("t08_round_robin", "WITH x AS (SELECT l_partkey AS item, l_suppkey AS queue, min(l_orderkey) AS k FROM lineitem WHERE l_suppkey < 5 GROUP BY 1, 2), r AS (SELECT item, queue, row_number() OVER (PARTITION BY queue ORDER BY k, item) AS rank FROM x), f AS (SELECT item, min(rank * 1000 + queue) AS z FROM r GROUP BY 1) SELECT item, CAST(z // 1000 AS INTEGER) AS rank FROM f ORDER BY z, item LIMIT 30")
def _(spark, d):
    x = table(spark, d, "lineitem").filter("l_suppkey < 5").groupBy(F.col("l_partkey").alias("item"), F.col("l_suppkey").alias("queue")).agg(F.min("l_orderkey").alias("k"))
    r = x.withColumn("rank", F.row_number().over(W.partitionBy("queue").orderBy("k", "item")))
    return R.round_robin(r.select("item", "queue", "rank"), 30).select("item", "rank")


@q("t08_round_robin_all")
def _(spark, d):
    x = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("item"), F.col("l_suppkey").alias("queue")).agg(F.min("l_orderkey").alias("k"))
    r = x.withColumn("rank", F.row_number().over(W.partitionBy("queue").orderBy("k", "item")))
    return R.round_robin(r.select("item", "queue", "rank"), 30).select("item", "rank")


@q("t09_fan_out", "SELECT n_name AS entity FROM nation ORDER BY 1 LIMIT 6")
def _(spark, d):
    return table(spark, d, "nation").select(F.col("n_name").alias("entity")).orderBy("entity").limit(6)


@q("x22_query_expansion", "WITH q AS (SELECT DISTINCT id, unnest(regexp_extract_all(lower(question), '[a-z]+')) AS term FROM questions), t AS (SELECT attribute, unnest(aliases) AS trigger FROM attr_schema) SELECT id AS query, term FROM q UNION SELECT q.id, t.attribute FROM q JOIN t ON q.term = t.trigger")
def _(spark, d):
    tr = table(spark, d, "attr_schema").select(F.col("attribute").alias("term"), F.explode("aliases").alias("trigger"))
    asked = table(spark, d, "questions").select(F.col("id").alias("query"), F.explode(F.regexp_extract_all(F.lower("question"), F.lit("[a-z]+"), 0)).alias("term"))
    return R.expand_terms(asked, tr)


@q("w07_hubness", f"WITH {VEC}, r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM sc) SELECT CAST(sum(c) AS BIGINT) AS listed, count(*) > 0 AS some FROM (SELECT doc, count(*) AS c FROM r WHERE rank <= 10 GROUP BY 1)")
def _(spark, d):
    h = R.hubness(R.top_k(_vectors(spark, d), 10))
    return h.agg(F.count("*").alias("listed"), (F.count("*") > 0).alias("some"))


@q("r38_hard_negatives")
def _(spark, d):
    s = _bm25(spark, d).join(table(spark, d, "documents").select(F.col("doc_id").alias("doc"), "text"), "doc")
    return R.hard_negatives(s, spark.createDataFrame([("q1", "rain attenuation"), ("q2", "coupon"), ("q3", "thermal drift")], "query string, answer string"))


# ---- metrics
SCORED = "s AS (SELECT o_orderpriority AS query, o_custkey AS cand, max(o_totalprice) AS score FROM orders GROUP BY 1, 2), t AS (SELECT query, min_by(cand, cand) AS target FROM s GROUP BY 1)"


def _scored(spark, d):
    s = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("query"), F.col("o_custkey").alias("cand")).agg(F.max("o_totalprice").alias("score"))
    t = s.groupBy("query").agg(F.min("cand").alias("target"))
    return s.join(t, "query"), s.filter("cand % 3 = 0").select("query", "cand")


RANKS = f"WITH {SCORED}, r AS (SELECT t.query, t.target, count(*) FILTER (s.score >= x.score AND s.cand % 3 <> 0) + 1 AS rank FROM t JOIN s x ON x.query = t.query AND x.cand = t.target LEFT JOIN s ON s.query = t.query GROUP BY 1, 2)"


@q("w02_filtered_ranks", f"{RANKS} SELECT query, target, rank FROM r")
def _(spark, d):
    return E.filtered_ranks(*_scored(spark, d))


@q("w02_rank_metrics", "WITH r AS (SELECT l_linenumber AS rank, l_returnflag AS g FROM lineitem) SELECT g, count(*) AS n, round(avg(1.0 / rank), 6) AS mrr, round(avg(CAST(rank <= 1 AS INTEGER)), 6) AS hits_1, round(avg(CAST(rank <= 3 AS INTEGER)), 6) AS hits_3, round(avg(CAST(rank <= 10 AS INTEGER)), 6) AS hits_10 FROM r GROUP BY 1")
def _(spark, d):
    r = table(spark, d, "lineitem").select(F.col("l_linenumber").alias("rank"), F.col("l_returnflag").alias("g"))
    m = E.rank_metrics(r, "g")
    return m.select("g", "n", *[F.round(c, 6).alias(c) for c in ("mrr", "hits_1", "hits_3", "hits_10")])


HITS = "x AS (SELECT o_custkey AS query, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC) AS rank, o_orderstatus = 'F' AS hit FROM orders)"


def _hits(spark, d):
    w = W.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"))
    return table(spark, d, "orders").select(F.col("o_custkey").alias("query"), F.row_number().over(w).alias("rank"), (F.col("o_orderstatus") == "F").alias("hit"))


@q("w05_reciprocal_rank", f"WITH {HITS} SELECT query, round(coalesce(1.0 / min(rank) FILTER (hit), 0), 6) AS rr FROM x GROUP BY 1")
def _(spark, d):
    return E.reciprocal_rank(_hits(spark, d)).select("query", F.round("rr", 6).alias("rr"))


@q("w06_ndcg", f"WITH {HITS}, n AS (SELECT query, count(*) FILTER (hit) AS k FROM x GROUP BY 1), i AS (SELECT k, (SELECT sum(1 / log2(z + 1)) FROM range(1, greatest(least(5, k), 1) + 1) AS u(z)) AS ideal FROM (SELECT DISTINCT k FROM n)) SELECT x.query, round(sum(CASE WHEN rank <= 5 AND hit THEN 1 / log2(rank + 1) ELSE 0 END) / max(ideal), 6) AS ndcg FROM x JOIN n USING (query) JOIN i USING (k) GROUP BY 1")
def _(spark, d):
    x = _hits(spark, d)
    x = x.withColumn("n_refs", F.count_if("hit").over(W.partitionBy("query"))).withColumn("rel", F.col("hit").cast("double"))
    return E.ndcg(x, 5).select("query", F.round("ndcg", 6).alias("ndcg"))


@q("w03_risk_coverage", "WITH x AS (SELECT s_suppkey AS id, row_number() OVER (ORDER BY s_acctbal DESC, s_suppkey) AS k, sum(CASE WHEN s_nationkey % 2 = 0 THEN 0 ELSE 1 END) OVER (ORDER BY s_acctbal DESC, s_suppkey) AS wrong, count(*) OVER () AS n FROM supplier), c AS (SELECT id, k / n AS coverage, wrong / k AS risk FROM x), a AS (SELECT id, coverage, risk, coalesce((coverage - lag(coverage) OVER (ORDER BY coverage)) * (risk + lag(risk) OVER (ORDER BY coverage)) / 2, 0) AS area FROM c) SELECT round(sum(area), 6) AS aurc, round(max(coverage) FILTER (risk <= 0.4), 4) AS covered FROM a")
def _(spark, d):
    p = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("conf"), (F.col("s_nationkey") % 2 == 0).alias("correct"))
    return E.risk_coverage(p).agg(F.round(F.sum("area"), 6).alias("aurc"), F.round(F.max(F.when(F.col("risk") <= 0.4, F.col("coverage"))), 4).alias("covered"))


@q("a16_nearest_rank", "WITH x AS (SELECT c_mktsegment, c_acctbal, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal) - 1 AS r, count(*) OVER (PARTITION BY c_mktsegment) AS n FROM customer) SELECT c_mktsegment, c_acctbal AS quantile FROM x WHERE r = least(n - 1, CAST(floor(0.9 * n) AS BIGINT))")
def _(spark, d):
    return E.nearest_rank(table(spark, d, "customer"), "c_acctbal", 0.9, "c_mktsegment")


@q("a17_percentile", "SELECT c_mktsegment, round(quantile_cont(c_acctbal, 0.9), 4) AS p90 FROM customer GROUP BY 1")
def _(spark, d):
    return table(spark, d, "customer").groupBy("c_mktsegment").agg(F.round(F.percentile("c_acctbal", 0.9), 4).alias("p90"))


@q("a15_coverage", "SELECT attribute, count(*) AS n, count(typed_value.value) AS n_value, count(unit) AS n_unit, count(DISTINCT family_id) AS n_families FROM typed_records GROUP BY 1")
def _(spark, d):
    return table(spark, d, "typed_records").groupBy("attribute").agg(F.count("*").alias("n"), F.count("typed_value.value").alias("n_value"), F.count("unit").alias("n_unit"), F.count_distinct("family_id").alias("n_families"))


@q("a18_confusion", "SELECT count(*) FILTER (a AND b) AS both, count(*) FILTER (NOT a AND b) AS corrected, count(*) FILTER (a AND NOT b) AS regressed, count(*) FILTER (NOT a AND NOT b) AS neither FROM (SELECT o_orderkey % 3 = 0 AS a, o_custkey % 2 = 0 AS b FROM orders)")
def _(spark, d):
    return E.confusion(table(spark, d, "orders").select((F.col("o_orderkey") % 3 == 0).alias("a"), (F.col("o_custkey") % 2 == 0).alias("b")))


@q("r35_transitions", "SELECT o_orderstatus AS before, o_orderpriority AS after, count(*) AS n FROM orders GROUP BY 1, 2")
def _(spark, d):
    return E.transitions(table(spark, d, "orders").select(F.col("o_orderstatus").alias("before"), F.col("o_orderpriority").alias("after")))


@q("r37_precision_recall", "SELECT g, tp, n_predicted, n_gold, round(tp / greatest(n_predicted, 1), 6) AS precision, round(tp / greatest(n_gold, 1), 6) AS recall FROM (SELECT o_orderpriority AS g, count(*) FILTER (p AND t) AS tp, count(*) FILTER (p) AS n_predicted, count(*) FILTER (t) AS n_gold FROM (SELECT *, o_orderkey % 3 = 0 AS p, o_custkey % 2 = 0 AS t FROM orders) GROUP BY 1)")
def _(spark, d):
    r = table(spark, d, "orders").select(F.col("o_orderpriority").alias("g"), (F.col("o_orderkey") % 3 == 0).alias("predicted"), (F.col("o_custkey") % 2 == 0).alias("gold"))
    return E.prf(r, "g").select("g", "tp", "n_predicted", "n_gold", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


@q("x33_kappa", "WITH x AS (SELECT l_returnflag AS a, CASE WHEN l_quantity < 25 THEN l_returnflag ELSE 'N' END AS b FROM lineitem), n AS (SELECT count(*) AS n, avg(CAST(a = b AS INTEGER)) AS po FROM x), e AS (SELECT sum(na * nb) AS s FROM (SELECT a AS l, count(*) AS na FROM x GROUP BY 1) JOIN (SELECT b AS l, count(*) AS nb FROM x GROUP BY 1) USING (l)) SELECT n, round(po, 6) AS agreement, round((po - s / (n * n)) / (1 - s / (n * n)), 6) AS kappa FROM n, e")
def _(spark, d):
    x = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("a"), F.when(F.col("l_quantity") < 25, F.col("l_returnflag")).otherwise("N").alias("b"))
    return E.kappa(x).select("n", F.round("agreement", 6).alias("agreement"), F.round("kappa", 6).alias("kappa"))


@q("x32_wilson", "WITH x AS (SELECT o_orderpriority AS g, count(*) FILTER (o_orderstatus = 'F') AS h, count(*) AS n FROM orders GROUP BY 1) SELECT g, round((h / n + 3.8416 / (2 * n) - 1.96 * sqrt(h / n * (1 - h / n) / n + 3.8416 / (4 * n * n))) / (1 + 3.8416 / n), 6) AS low, round((h / n + 3.8416 / (2 * n) + 1.96 * sqrt(h / n * (1 - h / n) / n + 3.8416 / (4 * n * n))) / (1 + 3.8416 / n), 6) AS high FROM x")
def _(spark, d):
    x = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("g")).agg(F.count_if(F.col("o_orderstatus") == "F").alias("h"), F.count("*").alias("n"))
    return x.select("g", T.wilson(F.col("h"), F.col("n")).alias("w")).select("g", F.round("w.low", 6).alias("low"), F.round("w.high", 6).alias("high"))


@q("a19_stratified", "SELECT o_orderpriority, least(count(*), 20) AS n FROM orders GROUP BY 1")
def _(spark, d):
    return E.stratified(table(spark, d, "orders"), "o_orderpriority", "o_orderkey", 20).groupBy("o_orderpriority").agg(F.count("*").alias("n"))


@q("a20_runs", "WITH x AS (SELECT event_id, event_type, CASE WHEN lag(event_type) OVER (ORDER BY event_id) IS NOT DISTINCT FROM event_type AND row_number() OVER (ORDER BY event_id) > 1 THEN 0 ELSE 1 END AS new FROM events), r AS (SELECT *, sum(new) OVER (ORDER BY event_id) AS run FROM x) SELECT event_type, min(event_id) AS first, max(event_id) AS last, count(*) AS n FROM r GROUP BY run, event_type")
def _(spark, d):
    return E.runs(table(spark, d, "events").select("event_id", "event_type"), "event_id", "event_type")


@q("a21_cardinality_delta", "SELECT o_orderpriority AS type, count(*) AS n, round(avg(o_custkey), 4) AS mean_size, round(median(o_custkey), 4) AS median_size, round(avg(CAST(o_custkey % 2 = 0 AS INTEGER) - CAST(o_orderkey % 3 = 0 AS INTEGER)), 6) AS gain FROM orders GROUP BY 1")
def _(spark, d):
    x = table(spark, d, "orders").select(F.col("o_orderpriority").alias("type"), F.col("o_custkey").alias("size"), (F.col("o_orderkey") % 3 == 0).alias("a"), (F.col("o_custkey") % 2 == 0).alias("b"))
    return E.cardinality_delta(x, "type").select("type", "n", F.round("mean_size", 4).alias("mean_size"), F.round("median_size", 4).alias("median_size"), F.round("gain", 6).alias("gain"))


@q("w09_first_divergence", "WITH x AS (SELECT o_custkey AS id, list(o_orderstatus ORDER BY o_orderkey) AS a, list(o_orderstatus ORDER BY o_orderkey DESC) AS b FROM orders GROUP BY 1), y AS (SELECT id, unnest(a) AS p, unnest(b) AS q, generate_subscripts(a, 1) - 1 AS place FROM x) SELECT id, CAST(min(place) AS INTEGER) AS place FROM y WHERE p <> q GROUP BY 1")
def _(spark, d):
    o = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderstatus"))).alias("t")).select("id", F.col("t.o_orderstatus").alias("trace"))
    return E.first_divergence(o, o.select("id", F.reverse("trace").alias("trace")))


@q("r12_bootstrap")
def _(spark, d):
    return E.bootstrap(table(spark, d, "supplier").select("s_suppkey", "s_acctbal"), "s_acctbal")


# ---- text functions
SUP = "SELECT s_suppkey, {} FROM supplier"


def fn(name, sql, source, build):
    @q(name, sql)
    def _(spark, d):
        return build(table(spark, d, source))


fn("x05_name_key", "SELECT DISTINCT regexp_replace(lower(trim(family_id)), '[\\s\\-_/().]', '', 'g') AS k FROM typed_records", "typed_records", lambda t: t.select(T.name_key(F.col("family_id")).alias("k")).distinct())
fn("x10_designation", "SELECT id, nullif(regexp_extract(question, '(?:^|[^A-Za-z0-9_])([A-Z]{2,4}-[0-9]+[A-Z]?)(?:$|[^A-Za-z0-9_])', 1), '') AS m FROM questions", "questions", lambda t: t.select("id", F.nullif(T.designation(F.col("question")), F.lit("")).alias("m")))
fn("x08_family_key", "SELECT DISTINCT s_name, regexp_extract(upper(s_name), '([A-Z]{1,4})[- ]?(\\d+)', 0) AS k FROM supplier", "supplier", lambda t: t.select("s_name", T.family_key(F.col("s_name")).alias("k")).distinct())
fn("x11_platform", "SELECT tail, CASE WHEN regexp_matches(lower(tail), 'ship|vessel|frigate|destroyer|carrier|submarine|boat|naval|marine|corvette') THEN 'naval' WHEN regexp_matches(lower(tail), 'ground|vehicle|truck|station|coastal|tower|site|harbou?r') THEN 'ground' WHEN regexp_matches(lower(tail), 'air|aircraft|fighter|helicopter|uav|bomber|drone') THEN 'air' END AS class FROM (SELECT DISTINCT tail FROM wikidata_enrich_out WHERE relation = 'deployedOn')", "wikidata_enrich_out", lambda t: t.filter("relation = 'deployedOn'").select("tail").distinct().select("tail", T.platform_class(F.col("tail")).alias("class")))
fn("x12_band", "WITH b AS (SELECT doc_id, regexp_extract(coalesce(title, '') || ' ' || coalesce(text, ''), '(?i)\\b(VHF|UHF|HF|Ku|Ka|[LSCXKVW])[- ]?band\\b', 1) AS b FROM documents) SELECT doc_id, CASE WHEN b = '' THEN NULL WHEN lower(b) IN ('ku', 'ka') THEN 'K' || lower(b[2]) ELSE upper(b) END AS band FROM b", "documents", lambda t: t.select("doc_id", T.band(F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("text", F.lit("")))).alias("band")))
fn("x15_first_number", "SELECT record_id, TRY_CAST(nullif(regexp_extract(value_text, '-?\\d+(\\.\\d+)?'), '') AS DOUBLE) AS v FROM typed_records", "typed_records", lambda t: t.select("record_id", T.first_number(F.col("value_text")).alias("v")))
def _twice(pattern: str, x: str, by: str) -> str:
    """Replaced two times, as a match takes the figure that the next one begins with."""
    for _ in range(2):
        x = f"regexp_replace({x}, '{pattern}', {by}, 'g')"
    return x


_EVEN = _twice(r"(\d)\s*(…|\.{2,}|[–—~])\s*(-?\d)", "translate(value_text, '−－～', '--~')", r"'\1 to \3'")
_EVEN = _twice(r"(\d),(\d{3})(\D|$)", _EVEN, r"'\1' || chr(1) || '\2\3'")
fn("x17_number_text", f"SELECT DISTINCT record_id, trim(replace({_EVEN}, chr(1), '')) AS t FROM typed_records WHERE value_text IS NOT NULL", "typed_records", lambda t: t.filter("value_text is not null").select("record_id", T.number_text(F.col("value_text")).alias("t")).distinct())
fn("x19_only_number", "SELECT record_id, CASE WHEN len(regexp_extract_all(value_text, '-?\\d+(?:\\.\\d+)?')) = 1 THEN CAST(regexp_extract(value_text, '-?\\d+(\\.\\d+)?') AS DOUBLE) END AS v FROM typed_records", "typed_records", lambda t: t.select("record_id", T.only_number(F.col("value_text")).alias("v")))
fn("x20_valid_number", "SELECT count(*) FILTER (v BETWEEN 1 AND 1000) AS n FROM (SELECT TRY_CAST(nullif(regexp_extract(value_text, '-?\\d+(\\.\\d+)?'), '') AS DOUBLE) AS v FROM typed_records)", "typed_records", lambda t: t.agg(F.count(T.valid_number(F.col("value_text"), 1, 1000)).alias("n")))
fn("x21_tokens", f"SELECT doc_id, CAST(len({_TOK}) AS INTEGER) AS n FROM documents WHERE text IS NOT NULL", "documents", lambda t: t.filter("text is not null").select("doc_id", F.size(T.tokens(F.col("text"))).alias("n")))
fn("x21_cjk_bigrams", "SELECT id, greatest(2 * len(regexp_extract_all(question, '[\\x{4e00}-\\x{9fff}]')) - 1, 0) AS n FROM questions", "questions", lambda t: t.select("id", F.size(T.cjk_bigrams(F.col("question"))).cast("long").alias("n")))
fn("x26_exact_match", "SELECT count(*) FILTER (trim(regexp_replace(lower(prediction), '[^\\p{L}\\p{N}.]+', ' ', 'g')) = trim(regexp_replace(lower(generated_text), '[^\\p{L}\\p{N}.]+', ' ', 'g'))) AS n FROM generations", "generations", lambda t: t.agg(F.count_if(T.exact_match(F.col("prediction"), F.col("generated_text"))).alias("n")))
fn("x30_canonical_hash", "SELECT count(DISTINCT (r_regionkey, r_name)) AS n FROM region", "region", lambda t: t.agg(F.count_distinct(T.canonical_hash("r_regionkey", "r_name")).alias("n")))
fn("x35_uri_key", "SELECT DISTINCT site, lower(site) AS k FROM documents WHERE site IS NOT NULL", "documents", lambda t: t.filter("site is not null").select("site", T.uri_key(F.concat(F.lit("https://www."), "site", F.lit("/#top"))).alias("k")).distinct())
fn("s17_rendered", "SELECT head, tail, head || ' stands on ' || tail || '.' AS sentence FROM wikidata_enrich_out WHERE relation = 'deployedOn' AND tail IS NOT NULL", "wikidata_enrich_out", lambda t: t.filter("relation = 'deployedOn' and tail is not null").select("head", "tail", T.rendered(F.col("head"), F.col("relation"), F.col("tail"), {"deployedOn": "{h} stands on {t}."}).alias("sentence")))
fn("x09_transliterated", "SELECT p_partkey, lower(p_name) AS t FROM part", "part", lambda t: t.select("p_partkey", T.transliterated(F.translate(F.lower("p_name"), "abvgdeziklmnoprstufy", "абвгдезиклмнопрстуфы")).alias("t")))
_LETTER = "substr('LSCX', {} % 4 + 1, 1)"
fn("r44_band_list", f"WITH x AS (SELECT p_partkey, {_LETTER.format('p_partkey')} AS a, {_LETTER.format('p_partkey // 4')} AS b, {_LETTER.format('p_partkey // 16')} AS c FROM part) SELECT p_partkey, a || CASE WHEN b <> a THEN '|' || b ELSE '' END || CASE WHEN c NOT IN (a, b) THEN '|' || c ELSE '' END || CASE WHEN 'X' NOT IN (a, b, c) THEN '|X' ELSE '' END AS t FROM x", "part", lambda t: t.select("p_partkey", F.array_join(T.band_list(F.concat(F.expr(_LETTER.format("p_partkey")), F.expr(_LETTER.format("(p_partkey div 4)")), F.lit(", "), F.lower(F.expr(_LETTER.format("(p_partkey div 16)"))), F.lit("/x"))), "|").alias("t")))


# ---- sources
@q("s10_key_values", "SELECT count(*) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE regexp_matches(line, '^([^:：]{2,40})[:：]\\s*(\\S.*)$') AND trim(regexp_extract(line, '^([^:：]{2,40})[:：]', 1)) <> '' OR regexp_matches(line, '^\\s*\\|\\s*([^|]+?)\\s*\\|\\s*([^|]+?)\\s*\\|\\s*$')")
def _(spark, d):
    return readers.key_values(table(spark, d, "documents"), "doc_id", "text").agg(F.count("*").alias("n"))


@q("r05_infobox", "SELECT DISTINCT id, x.k AS key, infobox[x.k] AS value FROM radar_corpus, unnest(map_keys(infobox)) AS x(k)")
def _(spark, d):
    return readers.infobox(table(spark, d, "radar_corpus"), "id")


@q("s11_sections", "SELECT id, CAST(count(*) AS BIGINT) AS n FROM (SELECT id, unnest(string_split(raw_text_en, chr(10))) AS line FROM (SELECT DISTINCT id, raw_text_en FROM radar_corpus)) WHERE regexp_matches(line, '^== [^=]+ ==$') GROUP BY 1")
def _(spark, d):
    s = readers.sections(table(spark, d, "radar_corpus").select("id", "raw_text_en").distinct(), "id", "raw_text_en")
    return s.filter("heading is not null").groupBy("id").agg(F.count("*").alias("n"))


@q("s14_load_bundle", f"WITH {D.KG} SELECT relation, count(*) AS n FROM (SELECT DISTINCT head, relation, tail FROM kg) GROUP BY 1")
def _(spark, d):
    t = D.triples(spark, d).dropDuplicates(["head", "relation", "tail"])
    nodes = table(spark, d, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("node_id"), F.col("n_name").alias("name"), F.lit("Nation").alias("type"))
    return readers.load_bundle(nodes, t.select("head", "head_type", "relation", "tail", "tail_type"))[1].groupBy("relation").agg(F.count("*").alias("n"))


@q("s15_flat_triples", "SELECT s_name AS head, 'balance' AS relation, CAST(s_acctbal AS VARCHAR) AS tail FROM supplier")
def _(spark, d):
    e = table(spark, d, "supplier").select(F.col("s_name").alias("name"), F.array(F.struct(F.lit("balance").alias("attr"), F.col("s_acctbal").cast("string").alias("value_raw"))).alias("attributes"))
    return readers.flat_triples(e)


@q("s07_chunks", "SELECT c.chunk_id AS chunk_id, min(source_id) AS source_id FROM chunks, unnest(chunks) AS x(c) GROUP BY 1")
def _(spark, d):
    c = table(spark, d, "chunks").select("source_id", F.explode("chunks").alias("c"))
    return c.groupBy(F.col("c.chunk_id").alias("chunk_id")).agg(F.min("source_id").alias("source_id"))


# ---- event time
@q("st_tumbling", "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def _(spark, d):
    return ST.tumbling(table(spark, d, "events")).withColumn("total", F.round("total", 4))


@q("st_sliding", "SELECT s AS start, event_type, count(*) AS n FROM (SELECT event_type, unnest([time_bucket(INTERVAL 30 minutes, ts), time_bucket(INTERVAL 30 minutes, ts) - INTERVAL 30 minutes]) AS s FROM events) GROUP BY 1, 2")
def _(spark, d):
    return ST.sliding(table(spark, d, "events"))


@q("st_sessions", "WITH x AS (SELECT user_id, ts, value, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 minutes THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_rank) AS k FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS event_rank FROM x)) SELECT user_id, min(ts) AS start, count(*) AS n, round(sum(value), 4) AS total FROM s GROUP BY user_id, k")
def _(spark, d):
    return ST.sessions(table(spark, d, "events")).withColumn("total", F.round("total", 4))


@q("st_running_totals", "SELECT user_id, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1")
def _(spark, d):
    e = table(spark, d, "events")
    s = ST.read_events(spark, f"{d}/events*.parquet", e.schema)
    out = shared_folder(spark, "totals")
    writer = ST.running_totals(s).writeStream.outputMode("update").option("checkpointLocation", f"{out}-state").trigger(availableNow=True)
    writer.foreachBatch(lambda df, _: df.write.mode("append").parquet(out)).start().awaitTermination()
    t = spark.read.parquet(out)
    return t.groupBy("user_id").agg(F.max("n").alias("n"), F.round(F.max_by("total", "n"), 4).alias("total"))


# ---- headline relational shapes
@q("h1_pricing", "SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= '1998-09-02' GROUP BY 1, 2")
def _(spark, d):
    li = table(spark, d, "lineitem").filter("l_shipdate <= timestamp'1998-09-02'")
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("sum_disc"), F.count("*").alias("n"))


@q("h2_revenue_by_nation", "SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
def _(spark, d):
    li, o, c, n = (table(spark, d, x) for x in ("lineitem", "orders", "customer", "nation"))
    j = li.select("l_orderkey", "l_extendedprice", "l_discount").join(o.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    return j.groupBy("n_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


QUERIES, SQL = q.queries, q.sql