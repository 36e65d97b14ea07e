"""Problem 2: the same questions across splits.

Method. A question is evened out (width, case, punctuation, courtesies, little words), its shingles are the
character trigrams of what is left, each qualified by the question's numbers, since questions with other numbers
are never the same. Figures and words too short for a slip must be equal and in the same order for the alignment
below, so only questions with the same ones meet. They are compared pair by pair; where too many have the same
ones, an exact prefix filter on rare shingles (evaluation prefixes are the index, training prefixes probe it with
length and position filters) finds the pairs. All are verified on the full shingle sets and then on an alignment
of their words, which lets slips of the pen pass and nothing else.

Why character trigrams at 0.4 and not five words at 0.8: a question has about a dozen words, and two slips break
every five-word shingle; TESTDATA.md states what counts as the same question.

Scale. Exactly equal texts are one class before the join; a class with a third of all rows costs one index entry.
Only texts travel, shingles are made where they meet. No join is broadcast, so nothing passes through the driver.
Pairs of ids come from a last join of class pairs with their members.

Defined results. Null, empty or symbol-only questions match nothing. A null id is ignored. Repeated rows: one pair.
Slips: a word differs from a word that is at least `rare` times as frequent by a few strokes, or both are rare.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.session import cut, shared_folder

# Words that a polite or hasty writer adds, and little words that get dropped.
COURTESIES = ["please", "kindly", "tell", "me", "thanks", "thank", "you", "many", "quick", "question", "hi", "hello", "hey", "dear", "q", "urgent", "asap", "sorry", "could", "can", "would"]
LITTLE = ["the", "a", "an", "of", "at", "on", "in", "to", "for", "its", "it", "is", "are", "s", "do", "does", "any", "that", "by", "with", "from", "as", "our", "they", "their"]
ZH_COURTESIES = ["麻烦问一下", "麻烦您", "麻烦", "请问一下", "请问", "您好", "你好", "谢谢您", "谢谢你", "谢谢", "多谢", "急"]

SIMILAR = (2, 5)  # Jaccard 0.4 as a fraction
DIRECT = 16  # pairs a text up to which texts of the same fixed words are compared without a prefix filter
_FULL = "".join(chr(c) for c in range(0xFF01, 0xFF5F)) + "　"
_HALF = "".join(chr(c) for c in range(0x21, 0x7F)) + " "


def evened(question):
    """Words of a question: Latin words, numbers, single CJK characters, joined by one space."""
    q = F.lower(F.translate(question, _FULL, _HALF))
    q = F.regexp_replace(q, r"[\p{Cf}\p{Mn}]", "")
    q = F.regexp_replace(q, "|".join(ZH_COURTESIES), " ")
    q = F.regexp_replace(q, r"['’]s\b", " ")
    # a comma before exactly three digits groups thousands, any other comma between digits is a decimal point
    q = F.regexp_replace(F.regexp_replace(q, r"(?<=\d),(?=\d{3}(?!\d))", ""), r"(?<=\d),(?=\d)", ".")
    q = F.regexp_replace(q, r"(?<![\p{L}\p{N}.])[-−](?=\d)", " neg ")
    q = F.regexp_replace(q, r"[^\p{L}\p{N}.]+|(?<!\d)\.|\.(?!\d)", " ")
    q = F.regexp_replace(q, r"([\p{IsHan}])", " $1 ")
    q = F.regexp_replace(q, r"(?<=\d)(?=\p{L})|(?<=\p{L})(?=\d)", " ")
    drop = "|".join(sorted(COURTESIES + LITTLE, key=len, reverse=True))
    q = F.regexp_replace(q, rf"(?<![\p{{L}}\p{{N}}])(?:{drop}|[的了])(?![\p{{L}}\p{{N}}])", " ")
    return F.trim(F.regexp_replace(q, r"\s+", " "))


def _strokes(a: str, b: str, most: int) -> int:
    """Edits incl. swapped neighbours; most + 1 if there are more."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, row = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        old, before, row = before, row, [i] + [0] * len(b)
        for j, y in enumerate(b, 1):
            row[j] = min(before[j] + 1, row[j - 1] + 1, before[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                row[j] = min(row[j], old[j - 2] + 1)
    return row[-1]


def _han(w: str) -> bool:
    return len(w) == 1 and "㐀" <= w <= "鿿"


def _slip(a: str, b: str, la: int, ra: int, lb: int, rb: int, rare: int, usual: int) -> bool:
    if a == b:
        return True
    if any(c.isdigit() for c in a + b):
        return False
    if _han(a) != _han(b):
        return False
    if _han(a):
        return (la * rare <= lb and ra * rare <= rb) or (lb * rare <= la and rb * rare <= ra)
    if min(len(a), len(b)) < 4:
        return False
    most = 2 if max(len(a), len(b)) < 7 else 3
    few, many = sorted((la, lb))
    both_rare = many * 50 <= usual and min(len(a), len(b)) >= 5  # two slips of the same word
    return (few * rare <= many or both_rare) and _strokes(a, b, most) <= most


def _polite(w: str) -> bool:
    return any(_strokes(w, c, 2) <= 2 for c in COURTESIES if len(c) >= 6 and len(w) >= 5)


def same_wording(a: list[str], b: list[str], dfa: list, dfb: list, rare: int = 4) -> bool:
    """Aligns two lists of words; every step must be equal, a slip, or a courtesy that was added."""
    n, m = len(a), len(b)
    usual = max((x[0] for x in [*dfa, *dfb]), default=0)
    free_a = [_polite(w) or (k > 0 and _han(w) and a[k - 1] == w) for k, w in enumerate(a)]
    free_b = [_polite(w) or (k > 0 and _han(w) and b[k - 1] == w) for k, w in enumerate(b)]
    reach = [[False] * (m + 1) for _ in range(n + 1)]
    # state: ends reached; a CJK character may differ only if the step before it was equal
    equal = [[False] * (m + 1) for _ in range(n + 1)]
    reach[0][0] = equal[0][0] = True
    for i in range(n + 1):
        for j in range(m + 1):
            if not reach[i][j]:
                continue
            if i < n and free_a[i]:
                reach[i + 1][j] = True
                equal[i + 1][j] |= equal[i][j]
            if j < m and free_b[j]:
                reach[i][j + 1] = True
                equal[i][j + 1] |= equal[i][j]
            if i < n and j < m:
                if a[i] == b[j]:
                    reach[i + 1][j + 1] = equal[i + 1][j + 1] = True
                elif (equal[i][j] or not _han(a[i])) and _slip(a[i], b[j], dfa[i][0], dfa[i][1], dfb[j][0], dfb[j][1], rare, usual):
                    if i + 1 < n and a[i + 1][0].isdigit() and len(a[i]) <= 4:
                        continue  # a designation is never a slip
                    reach[i + 1][j + 1] = True
                    equal[i + 1][j + 1] |= not _han(a[i])
    return reach[n][m]


def _counted(texts: DataFrame, some: DataFrame) -> DataFrame:
    """cid, words, counts: for each word of the texts in `some` how often it (a CJK character: its left and right bigram) occurs in all texts."""

    def units(df):
        w = F.col("words")
        around = lambda i: F.when((i >= 0) & (i < F.size(w)), F.when(F.get(w, i).rlike(r"^\p{IsHan}$"), F.get(w, i)).otherwise(F.lit("#"))).otherwise(F.lit("#"))
        one = lambda x, i: F.when(x.rlike(r"^\p{IsHan}$"), F.array(F.concat(around(i - 1), x), F.concat(x, around(i + 1)))).otherwise(F.array(x, x))
        return df.select("cid", "weight", F.posexplode(F.transform(w, one)).alias("pos", "u")).select("cid", "weight", "pos", F.posexplode("u").alias("side", "unit"))

    freq = units(texts).groupBy("unit").agg(F.sum("weight").alias("df"))
    own = _meet(units(some), freq, "unit").groupBy("cid", "pos").agg(F.max(F.when(F.col("side") == 0, F.col("df"))).alias("l"), F.max(F.when(F.col("side") == 1, F.col("df"))).alias("r"))
    return own.groupBy("cid").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "l", "r"))), lambda x: F.array(x["l"], x["r"])).alias("counts"))


def _words(text):
    return F.split(text, " ")


def _numbers(text):
    return F.array_join(F.array_sort(F.filter(_words(text), lambda w: w.rlike(r"^\p{N}|^neg$"))), "|")


def _grams(text):
    squashed, numbers = F.regexp_replace(text, " ", ""), _numbers(text)
    n = F.greatest(F.length(squashed) - 2, F.lit(1))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), n), lambda i: F.xxhash64(numbers, F.substr(squashed, i.cast("int"), F.lit(3)))))


def _fixed(words):
    """Hash of the words that must stand on both sides in this order: figures, and words too short for a slip (see _slip) or a courtesy (see _polite)."""
    return F.xxhash64(F.array_join(F.filter(words, lambda w: w.rlike(r"^[0-9.]+$") | ((F.length(w) < 4) & ~w.rlike(r"^[\u3400-\u9fff]$"))), " "))


def _meet(a: DataFrame, b: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    """A join that is never broadcast: how small a side is depends on the questions, and the driver would hold it."""
    return a.join(b.hint("merge"), on, how)


def classes(questions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(distinct evened texts with their shingles, members: id, split, source, cid)."""
    spark = questions.sparkSession
    q = questions.select("id", "split", "source", evened(F.col("question")).alias("text")).filter((F.length("text") > 0) & F.col("id").isNotNull())
    path = shared_folder(spark, "questions")  # compressed columns: a checkpoint of the same rows is several times the input
    q.write.parquet(f"{path}/members")
    members = spark.read.parquet(f"{path}/members").withColumn("cid", F.concat_ws(".", F.xxhash64("text"), F.hash("text")))
    members.groupBy("cid").agg(F.min("text").alias("text"), F.count("*").alias("weight"), F.max(F.col("split") == "train").alias("train"), F.max(F.col("split") != "train").alias("evaluation")).write.parquet(f"{path}/texts")
    texts = spark.read.parquet(f"{path}/texts")
    texts = texts.withColumns({"words": _words("text"), "numbers": _numbers("text"), "grams": _grams("text")})
    return texts, members.drop("text")


def similar(texts: DataFrame, threshold: tuple[int, int] = SIMILAR) -> DataFrame:
    """cid_t, cid_e, w_t, w_e: pairs of a training and an evaluation text with the same fixed words whose shingles are as similar as the threshold.

    Texts of the same fixed words are compared pair by pair; where that would be more pairs than texts have shingles, the
    prefix filter finds the pairs. Both find all. texts: cid, train, evaluation, grams, words and text; without a text its
    grams and words travel in its place.
    """
    part, whole = threshold
    keyed = texts.withColumn("key", _fixed(F.col("words")))
    size = keyed.groupBy("key").agg(F.count_if("train").alias("t"), F.count_if("evaluation").alias("e"))
    large = cut(size.filter(f"t * e > {DIRECT} * (t + e)").select("key"))
    brief = "text" in texts.columns
    own = ["text"] if brief else ["grams", "words"]
    g = lambda s: _grams(F.col(f"text_{s}")) if brief else F.col(f"grams_{s}")
    w = lambda s: _words(F.col(f"text_{s}")) if brief else F.col(f"words_{s}")
    side = lambda df, s: df.filter("train" if s == "t" else "evaluation").select("key", *[F.col(c).alias(f"{c}_{s}") for c in ("cid", *own)])
    crowded = not large.isEmpty()
    pairs = _meet(_meet(side(keyed, "t"), large, "key", "left_anti") if crowded else side(keyed, "t"), side(keyed, "e"), "key").drop("key")
    if crowded:
        some = _meet(keyed, large, "key", "left_semi")
        met = _prefixes(some, threshold)
        met = _meet(met, side(some, "t").drop("key"), "cid_t")
        pairs = pairs.unionByName(_meet(met, side(some, "e").drop("key"), "cid_e"))
    full = pairs.withColumns({"g_t": g("t"), "g_e": g("e")}).withColumn("share", F.size(F.array_intersect("g_t", "g_e")))
    full = full.filter(F.expr(f"share * {whole} >= (size(g_t) + size(g_e) - share) * {part}"))
    return cut(full.select("cid_t", "cid_e", w("t").alias("w_t"), w("e").alias("w_e")))


def _prefixes(texts: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    """cid_t, cid_e: every pair of one key that can be as similar as the threshold. texts: cid, key, train, evaluation, grams.

    All bounds are whole numbers (the threshold is a fraction), so no pair at the border is lost to rounding.
    """
    part, whole = threshold
    g = texts.select("cid", "key", "train", "evaluation", F.size("grams").alias("n"), F.explode("grams").alias("g"))
    freq = g.groupBy("key", "g").agg(F.count("*").alias("df"))
    ranked = _meet(g, freq, ["key", "g"]).groupBy("cid", "key", "train", "evaluation", "n").agg(F.array_sort(F.collect_list(F.struct("df", "g"))).alias("o"))
    keep = F.expr(f"cast(n - (n * {part} + {whole - 1}) div {whole} + 1 as int)")  # so many of the rarest meet every similar set
    prefix = ranked.select("cid", "key", "train", "evaluation", "n", F.posexplode(F.slice("o", F.lit(1), keep)).alias("pos", "x")).select("cid", "key", "train", "evaluation", "n", "pos", F.col("x.g").alias("g"))
    index = prefix.filter("evaluation").select(F.col("cid").alias("cid_e"), F.col("n").alias("n_e"), F.col("pos").alias("pos_e"), "key", "g")
    probe = prefix.filter("train").select(F.col("cid").alias("cid_t"), F.col("n").alias("n_t"), F.col("pos").alias("pos_t"), "key", "g")
    need = F.expr(f"((n_e + n_t) * {part} + {part + whole - 1}) div {part + whole}")  # least number of common shingles
    met = _meet(probe, index, ["key", "g"]).filter(f"n_e * {whole} >= n_t * {part} and n_t * {whole} >= n_e * {part}")
    # the first common prefix shingle bounds the overlap: what lies before it is not shared
    met = met.groupBy("cid_t", "cid_e").agg(F.min(F.struct("pos_t", "pos_e", "n_t", "n_e")).alias("f"))
    met = met.select("cid_t", "cid_e", "f.*").filter(F.least(F.col("n_t") - F.col("pos_t"), F.col("n_e") - F.col("pos_e")) >= need)
    return met.select("cid_t", "cid_e")


def class_pairs(texts: DataFrame, threshold: tuple[int, int] = SIMILAR, rare: int = 4) -> DataFrame:
    """cid_t, cid_e: pairs of a training and an evaluation text that are the same question."""
    full = similar(texts, threshold)
    some = full.select(F.explode(F.array("cid_t", "cid_e")).alias("cid")).distinct()
    counts = _counted(texts, _meet(texts, some, "cid", "left_semi"))
    full = _meet(full, counts.select(F.col("cid").alias("cid_t"), F.col("counts").alias("d_t")), "cid_t")
    full = _meet(full, counts.select(F.col("cid").alias("cid_e"), F.col("counts").alias("d_e")), "cid_e")

    @F.pandas_udf("boolean")
    def same(w_t: pd.Series, w_e: pd.Series, d_t: pd.Series, d_e: pd.Series) -> pd.Series:
        return pd.Series([same_wording(list(a), list(b), list(x), list(y), rare) for a, b, x, y in zip(w_t, w_e, d_t, d_e)], dtype="bool")

    return full.filter((F.col("cid_t") == F.col("cid_e")) | same("w_t", "w_e", "d_t", "d_e")).select("cid_t", "cid_e")


def overlaps(questions: DataFrame, threshold: tuple[int, int] = SIMILAR) -> DataFrame:
    """id_train, id_eval, split, source, source_train: every cross-split overlap."""
    texts, members = classes(questions)
    pairs = class_pairs(texts, threshold)
    t = members.filter(F.col("split") == "train").select(F.col("cid").alias("cid_t"), F.col("id").alias("id_train"), F.col("source").alias("source_train"))
    e = members.filter(F.col("split") != "train").select(F.col("cid").alias("cid_e"), F.col("id").alias("id_eval"), "split", "source")
    return _meet(_meet(t, pairs, "cid_t"), e, "cid_e").select("id_train", "id_eval", "split", "source", "source_train").distinct()


def found(questions: DataFrame) -> DataFrame:
    """p2_found: id_a < id_b."""
    o = overlaps(questions)
    return o.select(F.least("id_train", "id_eval").alias("id_a"), F.greatest("id_train", "id_eval").alias("id_b")).filter("id_a < id_b").distinct()


def report(questions: DataFrame) -> DataFrame:
    """Overlaps per evaluation split and source."""
    o = overlaps(questions)
    return o.groupBy("split", "source").agg(F.count("*").alias("n_pairs"), F.count_distinct("id_eval").alias("n_eval"), F.count_distinct("id_train").alias("n_train"))
