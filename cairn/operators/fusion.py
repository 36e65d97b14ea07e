"""Fusion, resolution, inference and audits of triples (S-02, J-11..J-20, A-05..A-11, R-01..R-11, R-30, R-34)."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from cairn.functions import text as T
from cairn.operators.evaluation import ordered
from cairn.session import cut


# ---- merging
def keep_best(t: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key, the smallest by the given values; a partial aggregate, so a key with many rows is never one task's sort."""
    best = t.groupBy(*keys).agg(F.min_by(F.struct(*t.columns), F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)])).alias("_b"))
    return best.select("_b.*")


def merge_preferring(t: DataFrame, preferred: str) -> DataFrame:
    """Per (head, relation, tail): the preferred source's row, then the more confident, then the first source by name."""
    return keep_best(t, ["head", "relation", "tail"], [~F.coalesce(F.col("source") == preferred, F.lit(False)), F.coalesce(-F.col("confidence"), F.lit(float("inf"))), F.coalesce("source", F.lit(""))])


def fuse(t: DataFrame, tiers: dict[str, int]) -> DataFrame:
    """Duplicate facts become one: best tier, kinds and documents joined, three pieces of evidence, corroboration.

    t: head, relation, tail, tier, source_kind, doc_id, evidence.
    """
    prior = F.create_map(*[x for k, v in tiers.items() for x in (F.lit(k), F.lit(v))])
    g = t.withColumn("_h", T.name_key(F.col("head"))).withColumn("_t", T.name_key(F.col("tail"))).groupBy("_h", "relation", "_t").agg(
        F.min("head").alias("head"), F.min("tail").alias("tail"), F.max_by("tier", F.struct(F.coalesce(prior[F.col("tier")], F.lit(-1)), F.col("tier"))).alias("tier"),
        F.array_sort(F.collect_set("source_kind")).alias("kinds"), F.count_distinct("doc_id").alias("n_docs"),
        F.array_agg(F.struct("doc_id", "evidence")).alias("_e"), F.count("*").alias("n"),
    )
    three = F.transform(F.slice(F.array_sort(F.array_distinct("_e")), 1, 3), lambda e: e["evidence"])
    return g.select("head", "relation", "tail", "tier", F.array_join("kinds", "|").alias("kinds"), "n_docs", F.array_join(three, "|").alias("evidence"), ((F.size("kinds") >= 2) | (F.col("n_docs") >= 2)).alias("corroborated"), "n")


def majority(products: DataFrame, least: int = 2, share: float = 0.6) -> DataFrame:
    """maker, country, n: the country most of a maker's products have. products: maker, product, country (a product counts once)."""
    one = products.groupBy("maker", "product").agg(F.min("country").alias("country"))
    g = one.groupBy("maker", "country").agg(F.count("*").alias("n"))
    best = g.groupBy("maker").agg(F.min_by(F.struct("country", "n"), F.struct(-F.col("n"), F.col("country"))).alias("b"), F.sum("n").alias("all"))
    best = best.select("maker", "b.country", "b.n", "all")
    return best.filter((F.col("all") >= least) & (F.col("n") >= share * F.col("all")))


def merge_entities(e: DataFrame, key: Column) -> DataFrame:
    """Entities of one key become one unless their countries conflict. e: name, country, aliases array<string>."""
    g = e.withColumn("_k", key).groupBy("_k").agg(F.count_distinct("country").alias("_c"), F.count("*").alias("n"))
    j = e.withColumn("_k", key).join(g, "_k")
    j = j.withColumn("_g", F.when(F.col("_c") <= 1, F.col("_k")).otherwise(F.concat_ws("|", "_k", "name")))
    best = F.struct((F.length("name") - F.length(F.replace("name", F.lit("-"), F.lit("")))), F.length("name"), F.col("name"))
    return j.groupBy("_g").agg(F.max_by("name", best).alias("name"), F.min("country").alias("country"), F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list("aliases")))), "|").alias("aliases"), F.count("*").alias("n_merged")).drop("_g")


# ---- resolution joins
def resolve(mentions: DataFrame, entities: DataFrame, aliases: DataFrame) -> DataFrame:
    """mention, name, how: exact, then alias, then equal key, then the shortest name that holds it (by first four letters)."""
    m = mentions.select("mention").distinct().withColumn("_key", T.entity_key(F.col("mention")))
    e = entities.select("name").distinct().withColumn("_key", T.entity_key(F.col("name")))
    exact = m.join(e.select("name"), m["mention"] == e["name"]).select("mention", "name", F.lit(0).alias("how"))
    alias = m.join(aliases.select("surface", "canonical").distinct(), m["mention"] == F.col("surface")).select("mention", F.col("canonical").alias("name"), F.lit(1).alias("how"))
    key = m.join(e, "_key").select("mention", "name", F.lit(2).alias("how"))
    mb, eb = m.withColumn("_b", F.substring("_key", 1, 4)), e.withColumn("_b", F.substring("_key", 1, 4))
    holds = mb.join(eb.withColumnRenamed("_key", "_ek"), "_b").filter((F.length("_key") >= 4) & F.startswith("_ek", F.col("_key"))).select("mention", "name", F.lit(3).alias("how"))
    allm = exact.unionByName(alias).unionByName(key).unionByName(holds)
    return allm.groupBy("mention").agg(F.min(F.struct("how", F.length("name").alias("len"), "name")).alias("m")).select("mention", "m.name", "m.how")


def prefix_blocks(names: DataFrame, key: Column) -> DataFrame:
    """short, long: names in a four-letter block of which one is the other's beginning."""
    n = names.select("name").distinct().withColumn("_n", key).filter(F.length("_n") >= 4).withColumn("_b", F.substring("_n", 1, 4))
    a, b = n.select("_b", F.col("name").alias("short"), F.col("_n").alias("_s")), n.select("_b", F.col("name").alias("long"), F.col("_n").alias("_l"))
    return a.join(b, "_b").filter((F.col("_s") != F.col("_l")) & F.startswith("_l", F.col("_s"))).select("short", "long")


def grounded(claims: DataFrame, texts: DataFrame, ends: Sequence[str] = ("head", "tail"), blocks: int = 16) -> DataFrame:
    """claim, head_in, tail_in: whether any cited text holds the ends, evened out. claims: claim, doc, head, tail; texts: doc, text.

    A text is evened out once, and each of a document's distinct ends is looked for once. A document's texts lie in so many
    blocks, its ends in each of them, so one with many of both is not one task's.
    """
    n = lambda c: T.entity_key(F.col(c))
    evened = claims.select("claim", "doc", *[n(c).alias(f"_{c}") for c in ends])
    t = texts.select("doc", n("text").alias("_text")).filter("doc is not null and _text <> ''")
    needles = evened.select("doc", F.explode(F.array(*[f"_{c}" for c in ends])).alias("_key")).filter("_key <> ''").distinct()
    needles = needles.join(texts.select("doc"), "doc", "left_semi").select("doc", "_key", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("_block"))
    t = t.withColumn("_block", F.pmod(F.xxhash64("_text"), F.lit(blocks)).cast("int"))
    hits = t.join(needles, ["doc", "_block"]).filter(F.contains("_text", "_key")).select("doc", "_key").distinct()
    for c in ends:
        evened = evened.join(hits.select("doc", F.col("_key").alias(f"_{c}"), F.lit(True).alias(f"{c}_in")), ["doc", f"_{c}"], "left")
    return evened.select("claim", *[F.coalesce(f"{c}_in", F.lit(False)).alias(f"{c}_in") for c in ends])


def agreement(facts: DataFrame) -> DataFrame:
    """relation, n_facts, n_shared, n_agree of single-valued facts by more than one origin. facts: head, relation, tail, origin."""
    g = facts.groupBy("head", "relation").agg(F.count_distinct("origin").alias("o"), F.count_distinct("tail").alias("v"))
    return g.groupBy("relation").agg(F.count("*").alias("n_facts"), F.count_if(F.col("o") >= 2).alias("n_shared"), F.count_if((F.col("o") >= 2) & (F.col("v") == 1)).alias("n_agree"))


def corroboration(facts: DataFrame) -> DataFrame:
    """origins, n: facts by their number of origins."""
    return facts.groupBy("head", "relation", "tail").agg(F.count_distinct("origin").alias("origins")).groupBy("origins").agg(F.count("*").alias("n"))


# ---- inference
def sharing_pairs(t: DataFrame, relation: str, new: str, least: int = 1, penalty: float = 0.0) -> DataFrame:
    """head, relation, tail, confidence, n_shared: heads that share tails, both directions.

    The result is pairs by its nature. Heads with the same tails are one class (named by its first head); classes meet on a
    tail, where two must be shared on two of them, and only pairs of classes that share enough become pairs of heads, which
    are not shuffled again. The confidence is that of the weakest edge of the first shared tail in name order for which
    either edge has one.
    """
    e = t.filter((F.col("relation") == relation) & F.col("tail").isNotNull() & F.col("head").isNotNull()).groupBy("head", "tail").agg(F.max("confidence").alias("c"))
    own = e.groupBy("head").agg(F.array_sort(F.collect_list(F.struct("tail", F.col("c").isNotNull().alias("sure")))).alias("tails")).filter(F.size("tails") >= least)
    classes = own.groupBy("tails").agg(F.min("head").alias("cls"))
    x = classes.select("cls", "tails", F.posexplode("tails").alias("i", "x")).select("cls", "x.tail", "x.sure", *([F.explode(F.slice("tails", F.col("i") + 2, F.size("tails"))).alias("y")] if least > 1 else []))
    key = ["tail", "second"] if least > 1 else ["tail"]
    x = x.select("cls", "tail", "sure", *([F.col("y.tail").alias("second"), F.col("y.sure").alias("sure2")] if least > 1 else []))
    a, b = [x.select(*key, *[F.col(c).alias(f"{c}_{s}") for c in x.columns if c not in key]) for s in "ab"]
    tail = lambda ok, name: F.min(F.when(ok, F.col(name)))
    sure = tail(F.col("sure_a") | F.col("sure_b"), "tail")
    if least > 1:  # the last shared tail is only ever a second
        sure = F.least(sure, tail(F.col("sure2_a") | F.col("sure2_b"), "second"))
    met = a.join(b, key).filter("cls_a <= cls_b").groupBy("cls_a", "cls_b").agg(F.count("*").alias("n"), F.coalesce(sure, F.min("tail")).alias("first"))
    shared = F.round((F.sqrt(8 * F.col("n") + 1) + 1) / 2).cast("long") if least > 1 else F.col("n")  # n is the number of pairs of shared tails
    met = met.withColumn("n_shared", shared).filter(F.col("n_shared") >= least)
    named = own.join(classes, "tails").select("cls", "head").join(e, "head").groupBy("cls", "tail").agg(F.collect_list(F.struct("head", "c")).alias("heads"))
    side = lambda s: named.select(F.col("cls").alias(f"cls_{s}"), F.col("tail").alias("first"), F.col("heads").alias(f"heads_{s}"))
    p = met.join(side("a"), ["cls_a", "first"]).join(side("b"), ["cls_b", "first"])
    p = p.select("cls_a", "cls_b", "n_shared", "heads_b", F.explode("heads_a").alias("a")).select("cls_a", "cls_b", "n_shared", "a", F.explode("heads_b").alias("b"))
    p = p.filter((F.col("cls_a") != F.col("cls_b")) | (F.col("a.head") < F.col("b.head")))
    p = p.withColumn("confidence", F.round(F.least("a.c", "b.c") - penalty, 4))
    both = F.explode(F.array(F.struct(F.col("a.head").alias("head"), F.col("b.head").alias("tail")), F.struct(F.col("b.head").alias("head"), F.col("a.head").alias("tail"))))
    return p.select(both.alias("p"), "confidence", "n_shared").select("p.head", F.lit(new).alias("relation"), "p.tail", "confidence", "n_shared")


def competitors(t: DataFrame, band: str, platform: str, operator: str) -> DataFrame:
    """a < b that share a band value and a platform value and have no operator in common.

    The band join is on equality of one value; pairs are checked on arrays of each head's few values.
    """
    own = lambda r, n: t.filter(F.col("relation") == r).groupBy("head").agg(F.array_sort(F.collect_set("tail")).alias(n))
    h = own(band, "bands").join(own(platform, "platforms"), "head").join(own(operator, "ops"), "head", "left").withColumn("ops", F.coalesce("ops", F.array().cast("array<string>")))
    x = h.select("head", "bands", "platforms", "ops", F.explode("bands").alias("band"))
    a = x.select("band", *[F.col(c).alias(f"{c}_a") for c in ("head", "bands", "platforms", "ops")])
    b = x.select("band", *[F.col(c).alias(f"{c}_b") for c in ("head", "bands", "platforms", "ops")])
    p = a.join(b, "band").filter((F.col("head_a") < F.col("head_b")) & (F.col("band") == F.array_min(F.array_intersect("bands_a", "bands_b"))))
    return p.filter(F.arrays_overlap("platforms_a", "platforms_b") & ~F.arrays_overlap("ops_a", "ops_b")).select(F.col("head_a").alias("a"), F.col("head_b").alias("b"), "band")


def inverse_edges(t: DataFrame, pairs: dict[str, str], penalty: float = 0.1, floor: float = 0.5) -> DataFrame:
    """The edges read backwards under their inverse name, less sure by the penalty but not below the floor."""
    m = F.create_map(*[x for k, v in pairs.items() for x in (F.lit(k), F.lit(v))])
    e = t.filter(F.col("relation").isin(*pairs) & F.col("tail").isNotNull())
    return e.select(F.col("tail").alias("head"), m[F.col("relation")].alias("relation"), F.col("head").alias("tail"), F.round(F.greatest(F.col("confidence") - penalty, F.lit(floor)), 4).alias("confidence"))


def only_new(inferred: DataFrame, known: DataFrame) -> DataFrame:
    return inferred.join(known.select("head", "relation", "tail").distinct(), ["head", "relation", "tail"], "left_anti")


def similar(features: DataFrame, family: DataFrame, weights: dict[str, float], top: int = 5) -> DataFrame:
    """a, b, score, rank: the most similar of one country by weighted equal features, families left out.

    features: name, country and the weighted columns; family: a, b. Weights are not negative.

    Names are numbered within each country and set of equal features. Whoever comes before b there is at least as similar to
    a and named before it, so a's best are among as many first names as `top`, its own rows and its family's.
    """
    if any(w < 0 for w in weights.values()):
        raise ValueError("a negative weight would make those with more in common less similar")
    f = features.select("name", "country", *weights).filter("name is not null and country is not null")
    out = family.select("a", "b").unionByName(f.select(F.col("name").alias("a"), F.col("name").alias("b"))).distinct()
    room = out.join(f.groupBy(F.col("name").alias("b")).agg(F.count("*").alias("n")), "b").groupBy(F.col("a").alias("name")).agg((F.sum("n") + top).alias("_room"))
    a, parts = f.join(room, "name").select("country", "_room", F.col("name").alias("a"), *[F.col(c).alias(f"{c}_a") for c in weights]), []
    for k in range(1, 2 ** len(weights)):
        equal = [c for i, c in enumerate(weights) if k >> i & 1]
        worth = sum((weights[c] for c in weights if c in equal), 0.0)
        first = W.partitionBy("country", *equal)
        b = f.join(room, "name").withColumns({"_k": F.row_number().over(first.orderBy("name")), "_most": F.max("_room").over(first)}).filter("_k <= _most")
        b = b.select("country", "_k", F.col("name").alias("b"), *[F.col(c).alias(c if c in equal else f"{c}_b") for c in weights])
        j = a.withColumns({c: F.col(f"{c}_a") for c in equal}).join(b, ["country", *equal]).filter((F.col("_k") <= F.col("_room")) & (F.col("a") != F.col("b")))
        for c in weights:
            if c not in equal:  # pairs with more in common come with that set
                j = j.filter(~F.coalesce(F.col(f"{c}_a") == F.col(f"{c}_b"), F.lit(False)))
        parts.append(j.select("a", "b", F.round(F.lit(worth), 6).alias("score")))
    if not parts:
        raise ValueError("no weighted feature")
    j = reduce(DataFrame.unionByName, parts).filter("score > 0").join(family.select("a", "b"), ["a", "b"], "left_anti")
    return j.withColumn("rank", F.row_number().over(W.partitionBy("a").orderBy(F.desc("score"), "b"))).filter(F.col("rank") <= top)


def rule_matches(facts: DataFrame, rules: DataFrame) -> DataFrame:
    """id, rule: facts for which every condition of a rule holds; a missing key fails. facts: id, props map; rules: rule, cond map of key -> "a|b"."""
    holds = F.forall(F.map_entries("cond"), lambda c: F.coalesce(F.array_contains(F.split(c["value"], "\\|"), F.col("props")[c["key"]]), F.lit(False)))
    if rules.limit(10_001).count() > 10_000:
        raise ValueError("a rule table has at most 10,000 rules")
    return facts.join(F.broadcast(rules)).filter(holds).select("id", "rule")


def relabel(t: DataFrame, relation: str, new: str, evidence: str) -> DataFrame:
    """Edges of a relation take another one where all their evidence matches a pattern."""
    pure = (F.size("evidence") > 0) & F.forall("evidence", lambda e: F.coalesce(e.rlike(evidence), F.lit(False)))
    return t.withColumn("relation", F.when((F.col("relation") == relation) & pure, F.lit(new)).otherwise(F.col("relation")))


def cleaned_tails(t: DataFrame, junk: str) -> DataFrame:
    """Tails without outer marks and double spaces; junk and empty ones go."""
    c = F.trim(F.regexp_replace(F.regexp_replace("tail", r"^[\s\"'“”·,;:.]+|[\s\"'“”·,;:]+$", ""), r"\s+", " "))
    return t.withColumn("tail", c).filter((F.length("tail") > 0) & ~F.col("tail").rlike(junk))


def canonical_values(t: DataFrame, surface: DataFrame) -> DataFrame:
    """Tails replaced by the canonical value of the longest surface form they contain, compared without case.

    surface: relation, surface, canonical (a vocabulary; joined on the relation).
    """
    j = t.join(surface.withColumnRenamed("relation", "_r"), (t["relation"] == F.col("_r")) & F.contains(F.lower(t["tail"]), F.lower("surface")), "left")
    return j.groupBy(*t.columns).agg(F.max_by("canonical", F.struct(F.length("surface"), "surface")).alias("canonical")).withColumn("tail", F.coalesce("canonical", "tail")).drop("canonical")


# ---- components and audits
def components(pairs: DataFrame) -> DataFrame:
    """node, component: connected components by the smallest node; pairs: a, b.

    Large-star and small-star turns until every component is a star, so the rounds grow with the logarithm of a chain's
    length. Edges stay in the cluster, with a checkpoint a round; smallest neighbours are aggregated before they are joined.
    """
    p = cut(pairs.select("a", "b").filter("a is not null and b is not null").distinct())
    nodes = p.select(F.col("a").alias("node")).unionByName(p.select(F.col("b").alias("node"))).distinct()
    e = p.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()  # a > b
    while True:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = cut(both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").filter("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        e = cut(small.unionByName(low.select("a", F.col("m").alias("b"))).distinct())
        more = e.groupBy("a").agg(F.count("*").alias("n")).filter("n > 1").select("a")
        if more.unionByName(e.select("a").join(e.select(F.col("b").alias("a")), "a", "left_semi")).isEmpty():
            return nodes.join(e.withColumnRenamed("a", "node"), "node", "left").select("node", F.coalesce("b", "node").alias("component"))


def leakage(items: DataFrame, keys: Sequence[str]) -> DataFrame:
    """component, n_items, splits: groups of items, joined by any equal key, that lie in more than one split. items: id, split, keys."""
    p = items.select("id", F.explode(F.array(*[F.concat(F.lit(f"{k}:"), F.col(k)) for k in keys])).alias("key")).filter("key is not null")
    c = components(p.select(F.concat(F.lit("id:"), "id").alias("a"), F.col("key").alias("b")))
    own = items.select(F.concat(F.lit("id:"), "id").alias("node"), "split").join(c, "node")
    return own.groupBy("component").agg(F.count("*").alias("n_items"), F.array_join(F.array_sort(F.collect_set("split")), "|").alias("splits")).filter(F.contains("splits", F.lit("|")))


def cover(sets: DataFrame) -> DataFrame:
    """turn, set, gain: greedy set cover until no item is left; ties go to the last set by name. sets: set, item; rows with a null are ignored.

    A round takes every set that comes before all sets it shares an item with: nothing can change its gain before its turn,
    and as gains only fall, the turns are the order by gain and name.
    """
    left, rows = cut(sets.select("set", "item").filter("set is not null and item is not null").distinct()), None
    while rows is None or not left.isEmpty():
        gains = left.groupBy("set").agg(F.count("*").alias("gain"))
        first = left.join(gains, "set").groupBy("item").agg(F.max(F.struct("gain", "set")).alias("f"))
        best = cut(first.groupBy("f").agg(F.count("*").alias("n")).filter(F.col("n") == F.col("f.gain")).select("f.set", "f.gain"))
        rows = best if rows is None else cut(rows.unionByName(best))
        left = cut(left.join(left.join(best, "set", "left_semi").select("item").distinct(), "item", "left_anti"))
    o = ordered(rows, F.desc("gain"), F.desc("set"))
    return o.select(F.col("_row").cast("int").alias("turn"), "set", "gain")


def path_templates(t: DataFrame, least: int = 2) -> DataFrame:
    """r1, r2, support: two-step relation paths and how many pairs they join."""
    a = t.select("head", F.col("relation").alias("r1"), F.col("tail").alias("mid"))
    b = t.select(F.col("head").alias("mid"), F.col("relation").alias("r2"), "tail")
    # pairs are counted per middle node before they are summed, so a hub is one row per relation
    ca, cb = a.groupBy("mid", "r1").agg(F.count("*").alias("n")), b.groupBy("mid", "r2").agg(F.count("*").alias("m"))
    return ca.join(cb, "mid").groupBy("r1", "r2").agg(F.sum(F.col("n") * F.col("m")).alias("support")).filter(F.col("support") >= least)
