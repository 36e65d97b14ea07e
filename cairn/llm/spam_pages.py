"""Problem 9: keyword-stuffed and link-list pages.

Method. A text is cut into lines and these into sentences; a segment is judged by link share, tag share,
separator density, missing function words, phrase repetition (top-word and top-bigram share) and
repeated lines. The function-word and repetition thresholds are calibrated per language from the corpus: segments that
are shaped like sentences give the quantiles. A document is spam if more than half of its characters
stand in spam segments, and these hold something that is spam by itself (links, menus, tags, stuffing) or three entries.

Scale. Segments are exploded, judged by built-in expressions and summed per document; the sum is a partial
aggregate, so a page with a million lines is never in one task's memory. Line repetition is counted by a hash.
Thresholds are one row per language from one approximate-quantile aggregate over all segments.

Defined results. Null, empty and blank texts are not spam. The language is found from the segment itself (its script, and
little words of other languages in Latin script), since the lang column may be wrong; a language without calibrating
sentences is judged by the default thresholds if it is English or Chinese and else not by function words. Invisible characters
are ignored. Equal texts under several ids are judged alike. A single entry or two are no list, however long.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.session import cut

# Function words and characters.
EN_FUNCTION = "the of and is a an in to with at for by was were be been that which as on from it its has have had not but or if when after before because although since than then this these are can may must should will no both each more most also while during whose where they their there into over under between whereas both nor so he she we you i do does did how what why who only about near".split()
ZH_FUNCTION = "的了在与和后并为是把被将从对于而不也都已可应会能使其该此但及或由以即则才又再只若如因所至"
_URL = r"(?i)(?:https?://|www\.)[^\s)\"'<>\]]+"
# a list of addresses under this heading belongs to the prose that cites them
_REFERENCES = r"(?im)^\s*(?:references|bibliography|sources|see also|further reading|参考|参考资料|参考文献|来源)\s*[:：]?\s*$"
_NOT_HAN = r"[^\x{3400}-\x{9fff}]+"
# Little words of other languages in Latin script, and other scripts.
OTHER_FUNCTION = "la le les des du est et une dans sur el los las del es y según con por der das und ist von mit den für eine nach il di che della os em não het een van niet jest nie dla się och är".split()
_SCRIPTS = {"ja": r"\x{3040}-\x{30ff}", "ko": r"\x{ac00}-\x{d7af}", "cyrillic": r"\x{0400}-\x{052f}", "arabic": r"\x{0600}-\x{06ff}"}


def _ascii(c):
    """Cheap and exact: one byte a character."""
    return F.octet_length(c) == F.length(c)


def _count(c, characters: str):
    return F.length(c) - F.length(F.translate(c, characters, ""))


def segments(docs: DataFrame) -> DataFrame:
    """doc_id, seg: sentences of the lines of every text."""
    t = F.when(_ascii("text"), F.col("text")).otherwise(F.regexp_replace("text", r"\p{Cf}", ""))
    lines = docs.filter(F.col("text").isNotNull() & F.col("doc_id").isNotNull()).select(
        "doc_id", t.rlike(_REFERENCES).alias("cites"), F.explode(F.split(t, r"[\r\n]+")).alias("line")
    )
    seg = F.split("line", r"(?<=[.!?])\s+(?=\S)|(?<=[。！？])")
    return lines.select("doc_id", "cites", F.explode(seg).alias("seg")).withColumn("seg", F.trim("seg")).filter(F.length("seg") > 0)


def _once(df: DataFrame, **columns) -> DataFrame:
    """Adds columns that later expressions read by name; behind a generator they are not written out again in each of them."""
    own = F.struct(*[c.alias(n) for n, c in columns.items()])
    return df.select(*df.columns, F.explode(F.array(own)).alias("_c")).select(*df.columns, "_c.*")


def features(segs: DataFrame) -> DataFrame:
    s = segs.withColumn("n", F.length("seg"))
    seg = F.col("seg")
    linked, marked = F.contains(seg, F.lit("://")) | F.contains(F.lower(seg), F.lit("www.")), F.translate(seg, "[]()<>•»·", "") != seg
    no_url = F.when(linked, F.regexp_replace(seg, _URL, " ")).otherwise(seg)
    bare = F.trim(F.when(marked, F.regexp_replace(no_url, r"(?i)</?[a-z][^>]*>|[\[\]()<>•»·]", " ")).otherwise(no_url))
    hashes = F.contains(seg, F.lit("#"))
    s = _once(s, bare=bare, links=F.when(linked, F.regexp_count(seg, F.lit(_URL))).otherwise(0), tags=F.when(hashes, F.regexp_count(seg, F.lit(r"(?:^|\s)#\w"))).otherwise(0))
    s = _once(s, low=F.lower("bare"), plain=_ascii("bare"))
    s = _once(s, hans=F.when(F.col("plain"), F.lit("")).otherwise(F.regexp_replace("bare", _NOT_HAN, "")))
    zh = F.length("hans") * 3 > F.length("bare")
    words = F.filter(F.split("low", r"[^\p{L}\p{N}'’-]+"), lambda w: w != "")
    s = _once(s, zh=zh, w=F.when(zh, F.filter(F.split("hans", ""), lambda c: c != "")).otherwise(words))
    s = s.withColumn("nw", F.size("w"))
    fw = F.when(F.col("zh"), F.regexp_count("bare", F.lit(f"[{ZH_FUNCTION}]"))).otherwise(F.size(F.filter("w", lambda x: x.isin(*EN_FUNCTION))))
    s = s.withColumn("fw", fw / F.greatest("nw", F.lit(1)))
    # grams that repeat within the segment: 4 characters of Chinese, 2 words otherwise
    two = F.zip_with(F.slice("w", F.lit(1), F.greatest(F.col("nw") - 1, F.lit(0))), F.slice("w", F.lit(2), F.greatest(F.col("nw") - 1, F.lit(0))), lambda x, y: F.concat(x, F.lit(" "), y))
    s = _once(s, two=F.when(F.col("nw") >= 6, two))
    four = F.zip_with(F.slice("two", F.lit(1), F.col("nw") - 3), F.slice("two", F.lit(3), F.col("nw") - 3), lambda x, y: F.concat(x, y))
    s = _once(s, grams=F.when(F.col("zh"), four).otherwise(F.col("two")))
    s = s.withColumn("again", F.coalesce(1 - F.size(F.array_distinct("grams")) / F.when(F.size("grams") > 0, F.size("grams")), F.lit(0.0)))
    # what separates entries; a separator at the very end separates nothing
    signs = ",;、，；|"
    spaced = F.when(F.translate("bare", ">/»–-#", "") != F.col("bare"), F.regexp_count("bare", F.lit(r"\s[>/»–-]\s|(?:^|\s)#"))).otherwise(0)
    s = s.withColumn("seps", _count(F.col("bare"), signs) - F.when(F.right("bare", F.lit(1)).isin(list(signs)), 1).otherwise(0) + spaced)
    s = s.withColumn("menu", F.when(F.translate("seg", "|>»", "") != F.col("seg"), F.regexp_count("seg", F.lit(r"\s[|>»]\s")) >= 2).otherwise(False))
    s = s.withColumn("ends", F.col("seg").rlike(r"[.!?。！？:：][\"'”’)\]]?$"))
    s = s.withColumn("pairs", F.col("seg").rlike(r"^(?:[^:：—|]{1,40}+[:：]\s*+\S|[^—]{1,40}+—\s)") & ~F.col("seg").rlike(r"(?i)^(?:tags?|keywords?|labels?|标签|关键词|关键字)\s*[:：]"))
    digits = _count(F.col("bare"), "0123456789")
    hexes = F.when((digits == 0) & ~F.col("bare").rlike("[A-F]{8}"), F.length(F.translate("bare", "|", ""))).otherwise(F.length(F.regexp_replace("bare", r"(?:^|[\s|,])(?=[0-9A-F]*\d)[0-9A-F]+(?=$|[\s|,])|[0-9A-F]{8,}|\|", "")))
    s = s.withColumn("data", hexes * 2 < F.length("bare")).withColumn("figures", digits * 3 > F.length("bare"))
    s = s.withColumn("named", F.col("seg").rlike(r"(?i)^(?:tags?|keywords?|labels?|标签|关键词|关键字)\s*[:：]"))
    s = s.withColumn("key", F.xxhash64(F.regexp_replace(F.lower("bare"), r"[\p{N}\s]+", " ")))
    # language: by script, else by little words
    others = F.size(F.filter("w", lambda x: x.isin(*OTHER_FUNCTION)))
    lang = F.when(F.col("zh"), "zh")
    for name, letters in _SCRIPTS.items():
        lang = lang.when(~F.col("plain") & (F.length(F.regexp_replace("bare", f"[^{letters}]+", "")) * 3 > F.length("bare")), name)
    lang = lang.when((others >= 2) & (others > F.col("fw") * F.col("nw")), "latin").otherwise("en")
    # entries of a list: by what separates them, or four words to one
    s = s.withColumn("items", F.greatest(F.col("seps") + 1, F.floor(F.col("nw") / F.when(F.col("zh"), 8).otherwise(4)))).withColumn("lang", lang)
    return s.select("doc_id", "cites", "n", "key", "zh", "lang", "items", "menu", "nw", "fw", "again", "seps", "links", "tags", "ends", "pairs", "named", "data", "figures", F.length("bare").alias("n_bare"))


def thresholds(f: DataFrame) -> DataFrame:
    """lang -> least_fw, most_again: from segments that are shaped like sentences."""
    sentence = F.col("ends") & (F.col("nw") >= F.when(F.col("zh"), 12).otherwise(7)) & (F.col("links") == 0) & (F.col("seps") <= 2) & (F.col("again") < 0.2)
    return f.filter(sentence).groupBy("lang").agg(
        (F.percentile_approx("fw", 0.05, 1000) * 0.7).alias("least_fw"), F.greatest(F.percentile_approx("again", 0.99, 1000) + 0.08, F.lit(0.12)).alias("most_again")
    )


def judged(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, spam_chars, link_chars, n_segments of every document with text."""
    f = cut(features(segments(docs)))  # numbers only, read by the thresholds and by the verdict
    t = F.broadcast(thresholds(f))  # one row per language found, at most seven
    copies = f.groupBy("doc_id", "key").agg(F.count("*").alias("copies")).filter("copies >= 3")
    f = f.join(copies, ["doc_id", "key"], "left").withColumn("copies", F.coalesce("copies", F.lit(1)))
    f = f.join(t, "lang", "left").withColumns({"least_fw": F.coalesce("least_fw", F.when(F.col("lang") == "zh", 0.02).when(F.col("lang") == "en", 0.1).otherwise(0.0)), "most_again": F.coalesce("most_again", F.lit(0.2))})
    short = F.col("nw") < F.when(F.col("zh"), 10).otherwise(5)
    link = (F.col("links") > 0) & ~(F.col("cites") & (F.col("n_bare") <= 3)) & (F.col("n_bare") <= 90 * F.col("links"))  # a link at least every ninety characters of other text
    tags = (F.col("tags") >= 2) & (F.col("tags") * 2 >= F.col("nw"))
    stuffed = (F.col("again") > F.col("most_again")) & (F.col("nw") >= 8)
    stuffed = stuffed | (F.col("copies") >= 3) & ((F.col("again") > 0.04) | ~F.col("ends") & (F.col("nw") <= 10)) & (F.col("nw") >= 2) & ~F.col("pairs") & ~F.col("data")
    poor = F.col("fw") < F.col("least_fw")
    listing = poor & ((F.col("seps") >= 2) | ~F.col("ends")) & ~F.col("pairs") & ~F.col("data") & (~F.col("figures") | (F.col("seps") >= 2))
    entry = short & ~F.col("ends") & ~F.col("pairs") & ~F.col("data") & ~F.col("figures") & (F.col("fw") < 0.34)
    named = F.col("named") & (F.col("seps") >= 2) & (F.col("fw") < 0.2)
    kind = F.when(link, "link").when(F.col("menu") & ~F.col("ends") & ~F.col("data"), "menu").when(tags | named, "tags").when(stuffed, "stuffed").when(listing, "listing").when(entry, "entry")
    f = f.select("doc_id", "n", "items", kind.alias("kind"))
    return f.groupBy("doc_id").agg(
        F.sum("n").alias("n_chars"), F.sum(F.when(F.col("kind").isNotNull(), F.col("n")).otherwise(0)).alias("spam_chars"),
        F.sum(F.when(F.col("kind") == "link", F.col("n")).otherwise(0)).alias("link_chars"), F.count("*").alias("n_segments"),
        F.count_if(F.col("kind").isin("link", "menu", "tags", "stuffed")).alias("n_sure"), F.sum(F.when(F.col("kind").isin("listing", "entry"), F.col("items")).otherwise(0)).alias("n_entries"),
    )


def found(docs: DataFrame) -> DataFrame:
    """p9_found: doc_id of documents that are wholly or mainly spam."""
    is_list = (F.col("n_sure") > 0) | (F.col("n_entries") >= 3)  # one or two entries are no list
    return judged(docs).filter((F.col("spam_chars") * 2 > F.col("n_chars")) & is_list).select("doc_id")
