"""Problem 4: text of scanned pages into continuous, readable paragraphs.

Method. Each document's lines are first told apart by their layout (title, section heading, running
header, page number, list value, body); that needs only the document itself. Words then are judged by the whole
corpus in SQL: every word has an anagram hash, the sum of its characters' hashes, so a confusion of
characters shifts the hash by a fixed difference whatever the word. Which confusions there are is learnt: rare words and
frequent words that are equal but for one or two characters at one place vote for what they differ in, and differences
that clean words show as well are left out; a short list of well-known confusions counts as learnt before. A word that clean
articles never use then is joined with the frequent words of the shifted hashes (two confusions meet half way),
candidates are verified at their places, and ranked by frequency. A divided word is judged by hyphen evidence: how often
the corpus writes the joined form and how often the hyphenated one.

Scale. One shuffle counts words (partial aggregates; a hot document is many rows, never one group), all joins are equi-joins on
hashes of distinct words, never on occurrences twice. A word has as many rows as it has places, or confusions that may be in
it. The learnt table has pairs of one or two characters, at least five words each. Whole texts are processed; a document is
one row, its layout takes time in proportion to its lines.

Defined results. Null and blank texts: no lines. The same document fetched twice (equal id and text) gives one set of
lines; equal id with another text gives both, lines counted in each. A word that no known confusion explains stays.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.session import cut

# What recognition prints, and what the page has.
CONFUSIONS = [
    ("é", "e"), ("c", "e"), ("e", "c"), ("f", "t"), ("t", "f"), ("@", "a"), ("г", "r"), ("ο", "o"), ("о", "o"), ("l", "i"), ("i", "l"),
    ("ri", "n"), ("n", "ri"), ("1", "i"), ("1", "l"), ("5", "s"), ("0", "o"), ("cl", "d"), ("d", "cl"), ("ii", "u"), ("u", "ii"),
    ("rn", "m"), ("m", "rn"), ("9", "g"), ("6", "b"), ("8", "b"), ("b", "h"), ("h", "b"), ("ll", "ti"), ("m", "in"), ("in", "m"),
    ("vv", "w"), ("w", "vv"), ("li", "h"), ("o", "c"), ("tl", "d"), ("nn", "m"), ("ni", "m"), ("a", "ο"), ("í", "i"), ("è", "e"), ("ö", "o"), ("3", "e"), ("4", "a"), ("7", "t"), ("$", "s"), ("|", "l"), ("!", "l"), ("!", "i"),
]
PRIME = 2147483647
PAGE = 130  # characters: no printed line is longer

_D = "0-9lIO"
_STYLES = [
    ("dash", re.compile(rf"[—–-]\s*([{_D}]{{1,5}})\s*[—–-]")),
    ("bracket", re.compile(rf"\[\s*([{_D}]{{1,5}})\s*\]")),
    ("page", re.compile(rf"[Pp]age\s+([{_D}]{{1,5}})(?:\s+of\s+[{_D}]{{1,5}})?")),
    ("section", re.compile(rf"([{_D}]{{1,3}})[-–]([{_D}]{{1,4}})")),
    ("roman", re.compile(r"[ivxlcIVXLC]{1,9}")),
    ("dot", re.compile(rf"([{_D}]{{1,4}})\.")),
    ("bare", re.compile(rf"([{_D}]{{1,4}})")),
]
_SURE = ("dash", "bracket", "page", "section", "roman")
_HEADING = re.compile(r"^\d+(?:\.\d+)+\s+[A-Z][^.]*[^.\s‐‑¬\u00ad-]$")
_EDITION = re.compile(r"^(?:revision|issue|edition|version|rev\.?|ed\.?)\b", re.I)
_HYPHENS = "‐‑¬\u00ad-"


def _number(s: str) -> int:
    return int(re.sub("[lI]", "1", s).replace("O", "0"))


def page_number(s: str) -> tuple[str, int] | None:
    for style, pattern in _STYLES:
        m = pattern.fullmatch(s)
        if m:
            if style == "roman":
                return style, 0
            if style == "bare" and not any(c.isdigit() for c in s):
                continue
            return style, _number(m[m.lastindex])
    return None


def _near(a: str, b: str, most: int) -> bool:
    if abs(len(a) - len(b)) > most:
        return False
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row = row, [i] + [0] * len(b)
        for j, y in enumerate(b, 1):
            row[j] = min(before[j] + 1, row[j - 1] + 1, before[j - 1] + (x != y))
        if min(row) > most:
            return False
    return row[-1] <= most


def _titles(lines: list[str], title: str | None) -> set[str]:
    """What a running header may repeat: the title, the work's full name, the name without its maker."""
    out = set()
    first = next((x.strip() for x in lines if x.strip()), "")
    for t in (title or "", first if len(first) <= 80 and not first.endswith(".") else ""):
        words = t.lower().split()
        if len(words) >= 2:
            out |= {" ".join(words), " ".join(words[:2]), " ".join(words[1:])}
    return {t for t in out if len(t) >= 5}


def is_clean(lines: list[str]) -> bool:
    """An article, not printed lines: most of its characters stand in lines longer than a page is wide."""
    sizes = [len(x) for x in lines]
    return 2 * sum(n for n in sizes if n > PAGE) > sum(sizes)


class _Nearby:
    """Strings to be found again within two edits: of three pieces of a string one at least stays as it is."""

    def __init__(self, items: list[tuple[str, int]]) -> None:
        self.pieces: dict[tuple, list] = {}
        for s, i in items:
            for k, (a, b) in enumerate(self._cuts(len(s))):
                self.pieces.setdefault((len(s), k, s[a:b]), {}).setdefault(s, []).append(i)

    @staticmethod
    def _cuts(n: int) -> list[tuple[int, int]]:
        return [(0, n // 3), (n // 3, 2 * n // 3), (2 * n // 3, n)]

    def near(self, s: str) -> Iterator[tuple[str, list[int]]]:
        """The strings within two edits of s and where they are."""
        seen = set()
        for n in range(max(0, len(s) - 2), len(s) + 3):
            for k, (a, b) in enumerate(self._cuts(n)):
                for move in (-2, -1, 0, 1, 2):
                    if a + move < 0:
                        continue
                    for t, at in self.pieces.get((n, k, s[a + move : b + move]), {}).items():
                        if t not in seen:
                            seen.add(t)
                            if _near(s, t, 2):
                                yield t, at


def line_kinds(text: str, title: str | None) -> list[str]:
    """The kind of each line: blank, body, heading, title, value, header or page_number."""
    lines = text.split("\n")
    kinds = ["blank" if not x.strip() else "body" for x in lines]
    if is_clean(lines):
        return kinds
    full = [i for i, k in enumerate(kinds) if k == "body"]
    if not full:
        return kinds
    stripped = [x.strip() for x in lines]
    lengths = [len(lines[i].rstrip()) for i in full]
    lengths = sorted([n for n in lengths if n <= PAGE] or lengths)
    width = lengths[min(len(lengths) - 1, int(len(lengths) * 0.97))]
    names = _titles(lines, title)

    def titled(s: str) -> bool:
        t = re.sub(r"^.{0,1}[dо0]?.?[oο]?.?c?.?\s+\d[\d.' ]*\s+", "", s.lower()) if re.match(r"(?i)^\W?(?:doc|d.c|do.|.oc|do|oc|dc)\W?\s*\d", s) else s.lower()
        t = re.sub(r"\s*[-–'. ]\s*\S{5,8}\s+\S{1,3}$", "", t) if re.search(r"(?i)\b\S{0,2}(?:ecti|apte|ctio|hapt|ction|sect|chap)\S{0,3}\s+\S{1,3}$", t) else t
        return any(_near(t, n, 2 if len(n) >= 9 else 1) for n in names)

    start = full[0]
    if titled(stripped[start]) or (len(stripped[start]) < 0.9 * width and not stripped[start].endswith(".") and not _HEADING.match(stripped[start]) and len(full) > 1 and _EDITION.match(stripped[full[1]])):
        kinds[start] = "title"
        if len(full) > 1 and _EDITION.match(stripped[full[1]]) and full[1] - start <= 2:
            kinds[full[1]] = "title"
    # list values: bare numbers after a line that ends with a colon
    numbered = {i: p for i in full if kinds[i] == "body" and (p := page_number(stripped[i]))}
    styles = {p[0] for p in numbered.values() if p[0] in _SURE}
    listing, last = False, None
    loose = []
    for i in full:
        if kinds[i] != "body":
            continue
        p = numbered.get(i)
        if p is None:
            edge = titled(stripped[i]) or (len(stripped[i]) < 0.8 * width and stripped[i][-1] not in ".,;" and stripped[i][:1].isupper())
            listing, last = (True, None) if stripped[i].endswith(":") else (listing and edge, last)
        elif p[0] in _SURE:
            kinds[i] = "page_number"
        elif p[0] == "bare" and listing and (last is None or p[1] > last):
            kinds[i], last = "value", p[1]
            loose.append((i, p, True))
        else:
            loose.append((i, p, False))
    if not styles:
        _loose_numbers(loose, kinds, stripped, full, width)
    else:
        for i, p, listed in loose:
            if p[0] == "bare" and not listed:
                kinds[i] = "value"
    for i in full:
        s = stripped[i]
        if kinds[i] != "body":
            continue
        if _HEADING.match(s) and not s.endswith("."):
            kinds[i] = "heading"
            continue
        pieces = [x for x in re.split(r"\s+\|\s+|\s{3,}", s) if x]
        if len(pieces) == 2 and (page_number(pieces[0]) or page_number(pieces[1])):
            kinds[i] = "header"
        elif titled(s):
            kinds[i] = "header"
    # layout: a short line without an end, in front of a word that it had room for, stands outside the text
    body = [i for i in full if kinds[i] in ("body", "heading", "value")]
    follows = {i: j for i, j in zip(body, body[1:])}
    for i in reversed(body):
        s = stripped[i]
        if kinds[i] != "body" or len(s) > 0.8 * width or s[-1] in ".!?:;,)" + _HYPHENS or not re.search(r"[A-Za-z]{2}", s):
            continue
        j = follows.get(i)
        while j is not None and kinds[j] == "header":
            j = follows.get(j)
        after = stripped[j].split()[0] if j is not None else ""
        if j is None or kinds[j] != "body" or len(s) + 1 + len(after) <= width - 1:
            kinds[i] = "header" if _at_edge(i, kinds) or _all_capitals(s) else "maybe"
    # what stands outside the text in two places, or resembles a header, is one
    maybe = [i for i in full if kinds[i] == "maybe"]
    heads = _Nearby([(x, -1) for x in {stripped[i].lower() for i in full if kinds[i] == "header"}] if maybe else [])
    others = _Nearby([(stripped[i].lower(), i) for i in maybe])
    for i in maybe:
        s = stripped[i].lower()
        if any(True for _ in heads.near(s)) or any(at[0] < i - 5 or at[-1] > i + 5 for _, at in others.near(s)):
            kinds[i] = "header"
        elif not stripped[i][:1].isupper():
            kinds[i] = "body"
    return kinds


def _all_capitals(s: str) -> bool:
    words = [w for w in re.findall(r"[A-Za-z]+", s) if len(w) > 3]
    return len(words) >= 2 and all(w[0].isupper() for w in words)


def _at_edge(i: int, kinds: list[str]) -> bool:
    """A page number, another header, a blank line or the end of the text is next to it."""
    around = [kinds[j] for j in (i - 1, i + 1) if 0 <= j < len(kinds)]
    return len(around) < 2 or any(k in ("page_number", "header", "blank") for k in around)


def _loose_numbers(loose, kinds, stripped, full, width) -> None:
    """Numbers without decoration are page numbers if they count up through the document."""
    for style in ("dot", "bare"):
        bare = {i for i, p, _ in loose if p[0] == "bare"}
        own = [(i, p[1]) for i, p, listed in loose if p[0] == style and not listed and not ({i - 1, i + 1} & bare)]
        for i in bare:
            if kinds[i] == "body" and {i - 1, i + 1} & bare:
                kinds[i] = "value"
        good = set()
        for (i, v), (j, w) in zip(own, own[1:]):
            if w == v + 1:
                good |= {i, j}
        rising, falling = Counter(v - k for k, (_, v) in enumerate(own)), Counter(v + k for k, (_, v) in enumerate(own))
        for k, (i, v) in enumerate(own):
            at = bisect_left(full, i) - 1
            while at >= 0 and kinds[full[at]] not in ("body", "heading", "value"):
                at -= 1
            before = full[at] if at >= 0 else None
            ended = before is None or stripped[before][-1:] in ".:" or kinds[before] != "body"
            room = before is not None and len(stripped[before]) + 1 + len(stripped[i]) <= width
            if i in good or (len(own) == 1 and (ended or room)) or rising[v - k] > 1 or falling[v + k] > 1:
                kinds[i] = "page_number"
            elif style == "bare":
                kinds[i] = "value"
        if style == "bare":
            sure = {v for i, v in own if kinds[i] == "page_number"}
            listed_at = {i: p[1] for i, p, listed in loose if listed}
            for i, p, listed in loose:
                if listed and p[0] == "bare" and sure and (p[1] - 1 in sure or p[1] + 1 in sure) and p[1] not in sure and (i + 1 >= len(kinds) or kinds[i + 1] == "blank" or kinds[i + 1] == "header"):
                    near = [listed_at[j] for j in (i - 2, i - 1, i + 1, i + 2) if j in listed_at]
                    if not near or all(p[1] < v or p[1] > 3 * v for v in near):
                        kinds[i] = "page_number"


_WORD = r"[^\W_]"
_FRONT = re.compile(r"^\s*([^\s]+?)(?=[\s.,;:!?)\]]|-|$)")


def _tail(line: str) -> tuple[int, str, str] | None:
    """(start, word, hyphen) of a word that the end of the line divides."""
    s = line.rstrip()
    if not s or s[-1] not in _HYPHENS:
        return None
    word = s.rsplit(None, 1)[-1]
    return (len(s) - len(word), word[:-1], s[-1]) if len(word) > 1 and word[-2] not in _HYPHENS else None


def _lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One row per line: kind, the line without the parts of a divided word, and those parts."""
    columns = ["id", "h", "line_no", "kind", "clean", "text", "rest", "left", "right", "mark", "line2"]
    for pdf in batches:
        rows = []
        for id_, h, text, title in zip(pdf["id"], pdf["h"], pdf["text"], pdf["title"]):
            kinds = line_kinds(text, title)
            lines = text.split("\n")
            clean = is_clean(lines)
            rest = list(lines)
            extra = [(None, None, None, 0)] * len(lines)
            cut_off = lambda i: i > 0 and kinds[i] == "maybe" and _tail(lines[i - 1]) is not None
            body = [i for i, k in enumerate(kinds) if k == "body" or k == "maybe" and not cut_off(i)]
            for a, b in zip(body, body[1:]):
                m = _tail(rest[a])
                f = _FRONT.match(rest[b]) if m else None
                if m and f and m[1][-1].isalpha() and (f[1][0].isalpha() or not f[1][0].isdigit()) and (b - a <= 2 or all(k != "heading" for k in kinds[a:b])):
                    extra[a] = (m[1], f[1], m[2], b + 1)
                    rest[a] = rest[a][: m[0]]
                    rest[b] = rest[b][f.end() :]
            for i, k in enumerate(kinds):
                if k != "blank":
                    rows.append((id_, h, i + 1, k, clean, lines[i], rest[i] if k in ("body", "maybe", "heading", "title") else "", *extra[i]))
            if len(rows) > 20000:
                yield pd.DataFrame(rows, columns=columns)
                rows = []
        yield pd.DataFrame(rows, columns=columns)


_LINES = "id string, h long, line_no int, kind string, clean boolean, text string, rest string, left string, right string, mark string, line2 int"
_TOKEN = r"[\p{L}\p{M}\p{N}@$|!]*\p{L}[\p{L}\p{M}\p{N}@$|!]*"


def lines(corpus: DataFrame) -> DataFrame:
    d = corpus.select("id", F.col("raw_text_en").alias("text"), F.col("en_title").alias("title")).filter(F.col("text").isNotNull() & F.col("id").isNotNull() & (F.trim("text") != ""))
    return d.groupBy("id", "text").agg(F.max("title").alias("title")).withColumn("h", F.xxhash64("text")).mapInPandas(_lines, _LINES)


def _bare(c):
    """A word as counted: lower case, no marks at its ends."""
    return F.lower(F.regexp_replace(c, r"^[^\p{L}\p{N}@$]+|[^\p{L}\p{N}@$]+$", ""))


def _last_part(c):
    return F.regexp_extract(c, r"([^-]+)$", 1)


def anagram_hash(word):
    """Sum of the characters' hashes; the order of characters does not count."""
    return F.aggregate(F.split(word, ""), F.lit(0).cast("long"), lambda a, c: F.when(c == "", a).otherwise((a + F.pmod(F.xxhash64(c), F.lit(PRIME))) % PRIME))


def _frames(words: DataFrame, col: str) -> DataFrame:
    """Each way to leave one or two neighbouring characters out of a word of which four remain: key, mid."""
    c, size = F.col(col), F.length(col)

    def leave(span: int):
        one = lambda p: F.struct(F.xxhash64(p, F.substr(c, F.lit(1), p), F.substr(c, p + span + 1)).alias("key"), F.substr(c, p + 1, F.lit(span)).alias("mid"), p.alias("p"))
        return F.when(size >= span + 4, F.transform(F.sequence(F.lit(0), size - span), one)).otherwise(F.array())

    # the position is in the key, so that both sides are cut at the same place
    f = words.select("*", F.explode(F.concat(leave(1), leave(2))).alias("_f")).select("*", "_f.*").drop("_f")
    return f


def _alternations(words: DataFrame, good: DataFrame, ratio: float) -> DataFrame:
    """seen, meant, support: in how many words of `words` the most frequent good word differs by just that."""
    w = _frames(words.select(F.col("word").alias("w"), F.col("n").alias("n_w")), "w")
    g = _frames(good.select(F.col("good").alias("g"), "n_good"), "g").withColumnRenamed("mid", "meant").drop("p")
    both = w.join(g, "key").filter((F.col("n_good") >= ratio * F.col("n_w")) & (F.col("mid") != F.col("meant")))
    rest = lambda c, mid: F.concat(F.substr(F.col(c), F.lit(1), F.col("p")), F.lit(" "), F.substr(F.col(c), F.col("p") + F.length(mid) + 1))
    least = (F.left("mid", F.lit(1)) != F.left("meant", F.lit(1))) & (F.right("mid", F.lit(1)) != F.right("meant", F.lit(1)))  # nothing in it that stays
    both = both.filter(least & (rest("w", "mid") == rest("g", "meant")))
    best = both.groupBy("w").agg(F.max_by(F.struct(F.col("mid").alias("seen"), "meant"), F.struct("n_good", "g")).alias("c"))
    return best.groupBy("c.seen", "c.meant").agg(F.count("*").alias("support"))


def confusions(counts: DataFrame, good: DataFrame, bad: DataFrame, support: int = 5, lift: float = 3.0, ratio: float = 4.0, prior: list = CONFUSIONS) -> list[tuple[str, str, int]]:
    """(seen, meant, difference of the hash) that recognition confuses, learnt from the corpus, and those known before.

    A confusion is learnt if it explains at least `support` different rare words, and `lift` times as many as the same
    difference lies between words of clean articles (so that endings like -s and -d are none).
    """
    rare = _alternations(bad.select(F.col("bad").alias("word"), F.col("n_bad").alias("n")), good, ratio)
    clean = counts.filter((F.col("n_clean") > 0) & F.col("word").rlike(r"^\p{L}+$"))
    natural = _alternations(clean, good, ratio).withColumnRenamed("support", "natural")
    size = bad.agg(F.count("*").alias("n_rare")).crossJoin(F.broadcast(clean.agg(F.count("*").alias("n_words"))))  # one row each
    t = rare.filter(F.col("support") >= support).join(natural, ["seen", "meant"], "left").crossJoin(F.broadcast(size))
    t = t.filter(F.col("support") * F.col("n_words") >= lift * F.coalesce("natural", F.lit(0)) * F.col("n_rare"))
    before = counts.sparkSession.createDataFrame(prior, "seen string, meant string")
    both = t.select("seen", "meant").unionByName(before).distinct()
    both = both.withColumn("shift", F.pmod(anagram_hash(F.col("meant")) - anagram_hash(F.col("seen")), F.lit(PRIME)))
    return sorted(tuple(r) for r in both.collect())  # pairs of one or two characters: bounded by the alphabet


def _shifted(words: DataFrame, col: str, hash_: str, table: list[tuple], forward: bool) -> DataFrame:
    """words, each with every confusion that may be in it (forward: was read, else: was meant): seen, meant, target hash."""
    lit = lambda s, m, by: F.struct(F.lit(s).alias("seen"), F.lit(m).alias("meant"), F.lit(by).cast("long").alias("shift"))
    own = F.filter(F.array(*[lit(*c) for c in table]), lambda x: F.contains(F.col(col), x["seen" if forward else "meant"]))
    j = words.select("*", F.explode(own).alias("_c")).select("*", "_c.*").drop("_c")
    return j.withColumn("target", F.pmod(F.col(hash_) + (F.col("shift") if forward else -F.col("shift")), F.lit(PRIME)))


def corrections(counts: DataFrame, least: int = 3, ratio: float = 4.0, prior: list = CONFUSIONS) -> DataFrame:
    """bad -> good, at: words that no clean article uses, explained by one or two confusions of a frequent word.

    A confusion shifts the anagram hash of any word by the same difference, so a rare word meets the frequent ones by its hash
    plus that difference; two confusions meet half way, the rare word plus one difference and the frequent one minus
    another. Then the confusions are looked for at their places, since words with equal hashes may be anagrams.
    counts: word, n, n_clean. least: how often the right word must occur; ratio: how much more often than the bad one.
    """
    good = cut(counts.filter((F.col("n") >= least) & F.col("word").rlike(r"^\p{IsLatin}{3,}$")).select(F.col("word").alias("good"), F.col("n").alias("n_good"), anagram_hash(F.col("word")).alias("h_good")))
    bad = counts.filter((F.col("n_clean") == 0) & (F.length("word") >= 3)).select(F.col("word").alias("bad"), F.col("n").alias("n_bad"))
    bad = cut(bad.withColumn("h_bad", anagram_hash(F.col("bad"))))
    table = confusions(counts, good, bad, ratio=ratio, prior=prior)
    # what lies between the equal beginning and the equal end of both words
    size = F.least(F.length("bad"), F.length("good"))
    same = lambda at: F.coalesce(F.get(F.filter(F.sequence(F.lit(1), size), lambda i: at(F.col("bad"), i) != at(F.col("good"), i)), F.lit(0)) - 1, size)
    front = same(lambda c, i: F.substr(c, i, F.lit(1)))
    back = same(lambda c, i: F.substr(c, F.length(c) - i + 1, F.lit(1)))
    inner = lambda c: F.substr(F.col(c), F.col("front") + 1, F.length(c) - F.col("front") - F.col("back"))

    def differing(df: DataFrame) -> DataFrame:
        df = df.withColumn("front", front).withColumn("back", F.least(back, size - F.col("front")))
        return df.withColumn("m_bad", inner("bad")).withColumn("m_good", inner("good"))

    one = _shifted(bad, "bad", "h_bad", table, True)
    hit = one.join(good, one["target"] == good["h_good"]).filter((F.col("n_good") >= ratio * F.col("n_bad")) & (F.col("good") != F.col("bad")))
    hit = differing(hit.select("bad", "good", "n_good", "seen", "meant")).filter((F.col("m_bad") == F.col("seen")) & (F.col("m_good") == F.col("meant")))
    pick = F.max_by(F.struct("good", (F.col("front") + 1).cast("int").alias("at")), F.struct("n_good", "good")).alias("c")
    first = cut(hit.groupBy("bad").agg(pick).select("bad", "c.good", "c.at"))
    left = bad.join(first, "bad", "left_anti")
    a = _shifted(left, "bad", "h_bad", table, True).select("bad", "n_bad", "target", F.col("seen").alias("s1"), F.col("meant").alias("m1"))
    b = _shifted(good, "good", "h_good", table, False).select("good", "n_good", "target", F.col("seen").alias("s2"), F.col("meant").alias("m2"))
    two = a.join(b, "target").filter((F.col("n_good") >= 2 * ratio * F.col("n_bad")) & (F.col("good") != F.col("bad")))
    two = two.filter(F.left("bad", F.lit(1)).isNotNull() & (F.length("bad") - F.length("s1") - F.length("s2") >= 3))  # three characters stay as they are
    two = differing(two)

    def ends(x: str, y: str):
        """The differing part begins with confusion x, ends with y, and is the same between them."""
        between = lambda c, p, q: F.substr(F.col(c), F.length(p) + 1, F.length(c) - F.length(p) - F.length(q))
        begins = F.startswith("m_bad", f"s{x}") & F.startswith("m_good", f"m{x}")
        finishes = F.endswith("m_bad", f"s{y}") & F.endswith("m_good", f"m{y}")
        fits = (F.length("m_bad") >= F.length(f"s{x}") + F.length(f"s{y}")) & (F.length("m_good") >= F.length(f"m{x}") + F.length(f"m{y}"))
        return begins & finishes & fits & (between("m_bad", f"s{x}", f"s{y}") == between("m_good", f"m{x}", f"m{y}"))

    second = two.filter(ends("1", "2") | ends("2", "1")).groupBy("bad").agg(pick).select("bad", "c.good", "c.at")
    return first.unionByName(second)


def judged(corpus: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(lines, divided words with their verdict, corrections)."""
    li = lines(corpus)
    # a line outside the text counts as a header where other documents have the same one at the edge of a page
    li = cut(li)
    heads = li.filter(F.col("kind") == "header").groupBy(F.lower(F.trim("text")).alias("head")).agg(F.count_distinct("id").alias("n")).filter("n >= 3")
    li = li.withColumn("head", F.when(F.col("kind") == "maybe", F.lower(F.trim("text")))).join(heads, "head", "left")
    li = li.withColumn("kind", F.when(F.col("kind") == "maybe", F.when(F.col("n").isNotNull(), "header").otherwise("body")).otherwise(F.col("kind")))
    li = li.withColumn("rest", F.when(F.col("kind") == "header", "").otherwise(F.col("rest"))).drop("head", "n")
    words = li.select("clean", F.explode(F.regexp_extract_all("rest", F.lit(_TOKEN), 0)).alias("w")).select(F.lower("w").alias("word"), "clean")
    split = li.filter(F.col("left").isNotNull()).select("id", "h", "line_no", "line2", "mark", "clean", _bare(_last_part(F.col("left"))).alias("l"), _bare(F.col("right")).alias("r"))
    split = split.filter((F.length("l") > 0) & (F.length("r") > 0)).withColumn("word", F.concat("l", "r"))
    counted = words.unionByName(split.select("word", "clean")).groupBy("word").agg(F.count("*").alias("n"), F.count_if("clean").alias("n_clean"))
    counted = cut(counted)
    whole = words.groupBy("word").agg(F.count("*").alias("n_whole"))
    hyph = li.select(F.explode(F.regexp_extract_all(F.lower("rest"), F.lit(r"\p{L}+(?:-\p{L}+)+"), 0)).alias("c"))
    hyph = hyph.select(F.explode(F.transform(F.sequence(F.lit(0), F.size(F.split("c", "-")) - 2), lambda i: F.array_join(F.slice(F.split("c", "-"), i + 1, F.lit(2)), "-"))).alias("pair"))
    hyph = hyph.groupBy("pair").agg(F.count("*").alias("n_hyphen"))
    fix = cut(corrections(counted))
    s = split.withColumn("pair", F.concat_ws("-", "l", "r"))
    s = s.join(whole, "word", "left").join(hyph, "pair", "left").join(fix.withColumnRenamed("bad", "word"), "word", "left")
    own = lambda c, n: whole.select(F.col("word").alias(c), F.col("n_whole").alias(n))
    s = s.join(own("l", "n_l"), "l", "left").join(own("r", "n_r"), "r", "left")
    nw, nh = F.coalesce("n_whole", F.lit(0)), F.coalesce("n_hyphen", F.lit(0))
    known = lambda c: F.coalesce(c, F.lit(0)) >= 3
    divided = F.when(nh > nw, False).when(nw > 0, True).when(F.col("good").isNotNull(), True).otherwise(~(known("n_l") & known("n_r")))
    return li, cut(s.withColumn("divided", divided & ~F.col("clean"))), fix


def found(corpus: DataFrame) -> DataFrame:
    """p4_found: id, line_no, defect."""
    li, s, fix = judged(corpus)
    edge = li.filter(F.col("kind").isin("header", "page_number")).select("id", "line_no", F.col("kind").alias("defect"))
    hyphen = s.filter("divided").select("id", "line_no", F.lit("hyphen").alias("defect"))
    tokens = li.filter(~F.col("clean") & F.col("kind").isin("body")).select("id", "line_no", F.explode(F.regexp_extract_all("rest", F.lit(_TOKEN), 0)).alias("w")).select("id", "line_no", F.lower("w").alias("bad"))
    inline = tokens.join(fix, "bad", "left_semi").select("id", "line_no")
    across = s.filter(F.col("divided") & F.col("good").isNotNull()).select("id", F.when(F.col("at") > F.length("l"), F.col("line2")).otherwise(F.col("line_no")).alias("line_no"))
    parts = s.filter(~F.col("divided") & ~F.col("clean"))
    parts = parts.select("id", "line_no", F.col("l").alias("bad")).unionByName(parts.select("id", F.col("line2").alias("line_no"), F.col("r").alias("bad")))
    misread = inline.unionByName(across).unionByName(parts.join(fix, "bad", "left_semi").select("id", "line_no")).select("id", "line_no", F.lit("misread").alias("defect"))
    return edge.unionByName(hyphen).unionByName(misread).distinct()


def _cased(good: str, like: str) -> str:
    return good.upper() if like.isupper() and len(like) > 1 else good.capitalize() if like[:1].isupper() else good


def _assembled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Paragraphs of each document from its judged lines."""
    token = re.compile(r"[^\W_]*[^\W\d_][^\W_]*|[\w@$|!]+")
    for pdf in batches:
        rows = []
        for id_, lines_ in zip(pdf["id"], pdf["lines"]):
            out: list[str] = []
            open_, before, carry = "", None, ""
            for x in sorted(lines_, key=lambda x: x["line_no"]):
                fixes = dict(x["fixes"] or {})
                if x["kind"] in ("header", "page_number"):
                    continue
                text = x["rest"] if x["kind"] in ("body", "heading", "title") else x["text"]
                text = token.sub(lambda m: _cased(fixes[m[0].lower()], m[0]) if m[0].lower() in fixes else m[0], text).replace("ﬁ", "fi").replace("ﬂ", "fl").strip()
                gap = before is not None and x["line_no"] > before + 1
                ended = open_.rstrip()[-1:] in tuple(".!?:")
                if open_ and not carry and (x["kind"] != "body" or (gap and ended)):
                    out.append(open_)
                    open_ = ""
                open_ = f"{open_}{carry}{'' if carry and text[:1] in tuple('.,;:!?)') else ' '}{text}".strip() if open_ or carry else text
                carry = ""
                if x["left"] is not None:
                    whole = x["left"] + x["right"] if x["divided"] else f"{x['left']}-{x['right']}"
                    if x["divided"] and x["good"] is not None:
                        whole = whole[: len(x["left"]) - len(x["l"])] + _cased(x["good"], x["left"][-len(x["l"]) :]) + whole[len(x["left"]) - len(x["l"]) + len(x["word"]) :]
                    carry = " " + whole if open_ else whole
                elif x["kind"] != "body":
                    out.append(open_)
                    open_ = ""
                before = x["line_no"]
            if open_ or carry:
                out.append((open_ + carry).strip())
            rows.append((id_, "\n\n".join(p for p in out if p)))
        yield pd.DataFrame(rows, columns=["id", "text"])


def repaired(corpus: DataFrame) -> DataFrame:
    """id, text: continuous paragraphs, without headers and page numbers, words joined and corrected."""
    li, s, fix = judged(corpus)
    key = ["id", "h", "line_no"]
    tokens = li.filter(~F.col("clean") & (F.col("kind") == "body")).select(*key, F.explode(F.array_distinct(F.transform(F.regexp_extract_all("rest", F.lit(_TOKEN), 0), F.lower))).alias("bad"))
    fixes = tokens.join(fix.select("bad", "good"), "bad").groupBy(*key).agg(F.map_from_entries(F.collect_list(F.struct("bad", "good"))).alias("fixes"))
    parts = s.select(*key, "divided", "good", "l", "word")
    j = li.join(fixes, key, "left").join(parts, key, "left")
    one = F.struct("line_no", "kind", "text", "rest", "left", "right", "fixes", F.coalesce("divided", F.lit(False)).alias("divided"), "good", "l", "word")
    return j.groupBy("id", "h").agg(F.collect_list(one).alias("lines")).select("id", "lines").mapInPandas(_assembled, "id string, text string")  # a document's own lines
