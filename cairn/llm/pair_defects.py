"""Problem 6: broken prompt and response pairs.

Method. A multi-label linear classifier on hashed n-grams of the answer and features of the pair, trained on
synthetic defects: sampled sound answers are truncated, replaced by the question, by an answer in another language, by a
refusal or by nothing. Thresholds are calibrated per label on held-out synthetic pairs, and the label with the largest
margin over its threshold is the verdict: what can be proved of a pair (nothing visible, the question and nothing else, an
open bracket) is a feature whose weight is learnt like any other. Rows that a first
fit calls defective are taken out of the sound examples and the classifier is fitted again, since some sampled answers
are defective themselves.

The n-grams are those of the whole answer; refusal wording is also looked for in each window of a long one.

Scale. The fit uses at most `sample_rows` pairs (a documented bound; those with the smallest hash of their id), on
the driver; the weights (under 100 kB) go to the tasks. Every pair is judged, in Arrow batches, without a shuffle
beside the join of answers with their questions.

Defined results. Null or invisible answers: `empty`. No question found: no `copy` and no `language`. Repeated rows:
one row. A null id is ignored. One defect per answer, ties of the margin in the order of LABELS. With no pair to learn from
(empty tables) nothing but the bias is known and nothing is flagged.
"""

from __future__ import annotations

import random
import re
import unicodedata
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LABELS = ["empty", "truncated", "refusal", "copy", "language"]
BUCKETS = 4096

# Ordinary refusals, combined at random for training. {a} is a thing asked for.
_OPEN_EN = ["", "", "I'm sorry, but ", "Sorry, ", "Unfortunately, ", "Apologies - ", "I regret that ", "As a language model, ", "As an AI, ", "I apologize, but ", "After some thought: ", "My apologies: "]
_CORE_EN = [
    "I can't help with that request", "I cannot help with that", "I can't assist with this", "I'm unable to answer this question", "I cannot provide details about {a}", "I won't go into {a}",
    "I must decline to answer", "I'm not able to share {a}", "this falls outside what I may discuss", "I don't feel comfortable discussing this subject", "I don't feel comfortable discussing military equipment", "I don't feel comfortable with this topic", "I'm not allowed to disclose such parameters",
    "answering would break my guidelines", "questions about {a} are something I have to refuse", "it would not be appropriate for me to reply", "I'd rather not answer that", "I will not discuss {a}", "I have to refuse", "that is not something I can talk about",
]
_WHY_EN = ["", "", "", " because of the usage policy", ", since it may be sensitive", " for safety reasons", ". Please ask the manufacturer"]
_TAIL_EN = ["", "", "", " Is there anything else you would like to know?", " Thank you for your understanding.", " Please consult the manufacturer.", " You may ask another question.", " Let me know if I can help with something else."]
_TAIL_ZH = ["", "", "", "您可以换一个问题。", "感谢您的理解。", "请咨询制造商。", "还有其他问题吗？"]
_OPEN_ZH = ["", "", "抱歉，", "对不起，", "很遗憾，", "不好意思，", "作为语言模型，", "作为人工智能，", "关于{a}，"]
_CORE_ZH = ["我无法回答这个问题", "我不能提供此类信息", "恕我不便透露{a}", "我不能协助处理该请求", "我没有权限讨论这类装备", "这一内容超出了我可以讨论的范围", "相关参数不便公开讨论，我无法作答", "我必须拒绝作答", "我不予回答", "恕难奉告", "我拒绝讨论{a}"]
_WHY_ZH = ["", "", "", "，请咨询厂家", "，因为可能涉及敏感信息", "，这不符合使用规定", "，出于安全考虑"]
_EMPTY = [None, "", " ", "\n\n", "　", "​", "﻿", "...", "…", "-", "—", "<answer></answer>", "<p></p>", "```\n```", "****", "。", "?!", "[]", "()", "> ", "#", "<br/>", "\"\"", "N​"[1:]]
_ADDED_EN = ["Sorry for the formatting of the earlier reply.", "The sources do not record the {a}.", "No value is recorded.", "The set cannot transmit below 5 °C.", "No source states it, so no value can be given.", "The value could not be confirmed by a second source."]
_ADDED_ZH = ["抱歉，前一条答复的格式有误。", "资料中没有记录{a}。", "资料未记载该数值。", "该雷达在5 °C以下不能发射。", "来源没有给出该数值。"]

# Sentences of synthetic answers in other languages ({n} a name, {v} a value), and common little words of languages.
_OTHER = [
    "D'après le manuel, la valeur de {n} est de {v} et elle est confirmée par les essais.", "Selon les archives, {n} atteint {v} ; aucune autre source ne contredit cette indication.", "La réponse est {v}, comme l'indique le constructeur.",
    "Según el manual, {n} tiene un valor de {v} y los ensayos lo confirman.", "El valor que figura en los registros es {v}, sin más condiciones.", "La respuesta es {v} para este equipo.",
    "Laut Datenblatt beträgt der Wert für {n} {v}, und die Versuche haben ihn bestätigt.", "Die Quellen nennen {v}; weitere Angaben sind nicht bekannt.", "Der Wert liegt nach dem Handbuch bei {v}.",
    "Secondo la scheda tecnica, il valore di {n} è {v} e le prove lo confermano.", "La risposta è {v}, come risulta dai documenti della ditta.",
    "De acordo com o manual, o valor de {n} é {v} e os ensaios confirmam os dados.", "A resposta é {v}, segundo os registos que temos.",
    "Volgens het gegevensblad is de waarde van {n} {v} en dat is bij de proeven bevestigd.", "Według karty danych wartość dla {n} wynosi {v} i nie jest sprzeczna z próbami.", "Enligt databladet är värdet för {n} {v} och det har bekräftats vid proven.",
    "По данным паспорта, значение для {n} составляет {v}, испытания это подтвердили.", "В источниках указано {v}, других сведений нет.", "За даними паспорта, значення для {n} становить {v}.",
    "資料によれば{n}の値は{v}で、試験でも確かめられています。", "この装置の値は{v}であると記録されています。", "자료에 따르면 {n}의 값은 {v}이며 시험에서도 확인되었습니다.", "وفقًا للوثائق فإن قيمة {n} هي {v} وقد أكدتها الاختبارات.",
]
_ENGLISH = frozenset("the of and is a an in to with at for by was were be been that which as on from it its has have had not but or if when after before than then this these are can may must should will no more most also while there they into over under so we you i do does did how what why only about other any none".split())
_LITTLE_OTHER = frozenset(
    "la le les de des du est et une un par pour dans sur selon que qui ce cette aux ne pas el los las del y es según sin lo se con por der das und ist von mit den für ein eine nach bei wird dem il di che è per gli dei della o os da em não é segundo het een van en dat niet jest nie dla się według är och för det som har vid och på".split()
) - _ENGLISH

_SPACE = re.compile(r"[\s​-‏⁠﻿]+")
_TAG = re.compile(r"</?[A-Za-z][^>]*>|```\w*|\*\*|__|^#+\s*", re.M)
_HAN = re.compile(r"[㐀-鿿]")
_NAME = re.compile(r"(?<![A-Za-z0-9])[A-Z][A-Za-z]+\s+[A-Za-z]+-\d+|(?<![A-Za-z0-9])[A-Za-z]*\d[A-Za-z0-9.,-]*")
_FIGURE = re.compile(r"\d[\d.,]*\s?[A-Za-zμ°%/]{1,4}(?![A-Za-z])")
_LATIN = re.compile(r"[A-Za-z]{3,}")
_INTRO = re.compile(r"(?:answer|response|reply|question|query|prompt|you asked|your question|the question is|the question was|you want to know|q|a|is|was|答案?|回答|问题?|问题是|[你您]问的?是?|[你您]刚才问的?是?|以下是|[你您]的问题是|[你您]的问题|是)*".replace(" ", ""))
_END = re.compile(r"[.!?。！？][\"'”’)\]）」》*_`]*(?:\s*[(（][^()（）]{1,60}[)）])?$")


_CF = regex.compile(r"\p{Cf}+")
_SCRIPT = regex.compile(r"(?P<zh>\p{Han})|(?P<kana>[\p{Hiragana}\p{Katakana}])|(?P<latin>\p{Latin}+)|(?P<more>\p{L})")


def _plain(s: str | None) -> str:
    s = s or ""
    if not s.isascii():
        s = _CF.sub("", unicodedata.normalize("NFKC", s))
    return _SPACE.sub(" ", _TAG.sub(" ", s)).strip()


def _key(s: str) -> str:
    return re.sub(r"[\W_]+", "", s.lower())


def _grams(s: str, n: int = 3) -> set[str]:
    return {s[i : i + n] for i in range(max(1, len(s) - n + 1))}


def _prose(s: str) -> tuple[int, int]:
    """(CJK characters, Latin words) outside names, figures and bracketed glosses."""
    s = _NAME.sub(" ", re.sub(r"[(（][^()（）]{0,40}[)）]", " ", s))
    return len(_HAN.findall(s)), len(_LATIN.findall(s))


def languages(s: str) -> tuple[float, float, float]:
    """Mass of (Chinese, English, any other language) in the prose of a text, in words; four characters count as three words."""
    s = _NAME.sub(" ", _FIGURE.sub(" ", re.sub(r"[(（][^()（）]{0,40}[)）]", " ", s)))
    if s.isascii():
        han = kana = more = 0
        latin = re.findall(r"[A-Za-z]{2,}", s.lower())
    else:
        found = [(m.lastgroup, m[0]) for m in _SCRIPT.finditer(s.lower())]
        han, kana, more = (sum(1 for g, _ in found if g == k) for k in ("zh", "kana", "more"))
        latin = [w for g, w in found if g == "latin" and len(w) > 1]
    ours = sum(w in _ENGLISH for w in latin)
    theirs = sum(w in _LITTLE_OTHER or not w.isascii() for w in latin)
    foreign = theirs >= 2 and theirs > ours
    japanese = kana * 5 > han
    return (0.0 if japanese else han * 0.75, 0.0 if foreign else float(len(latin)), (len(latin) if foreign else 0.0) + ((han + kana) * 0.75 if japanese else 0.0) + more / 2)


DENSE = 48
_NONE = np.array([BUCKETS])  # the bucket of an answer without n-grams; its weight stays 0
WINDOW = 240  # characters; refusals are shorter, and half of it overlaps


_WORDS = re.compile(r"[a-z']+|[㐀-鿿]")


_CODES: dict[str, int] = {}  # a plain dictionary travels with the functions to the workers, unlike a cached function


def _code(word: str) -> int:
    code = _CODES.get(word)
    if code is None:
        if len(_CODES) >= 100_000:
            _CODES.clear()
        code = _CODES[word] = zlib.crc32(word.encode())
    return code


def _buckets(words: list[str], known: set[str]) -> np.ndarray:
    """Hashed words that the question does not have, and all pairs and triples of neighbours; each bucket once."""
    h = np.fromiter(map(_code, words), dtype=np.uint64, count=len(words))
    new = h[np.fromiter((w not in known for w in words), dtype=bool, count=len(words))]
    two = h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:]
    three = two[:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + h[2:]
    g = np.concatenate([new, two, three])
    return np.unique((g ^ (g >> np.uint64(29))) % np.uint64(BUCKETS)).astype(np.int64)


def features(question: str | None, answer: str | None) -> tuple[list[float], np.ndarray, list[np.ndarray]]:
    """(dense pair features, hashed n-gram buckets of the whole answer, those of each window of a long answer)."""
    raw = answer or ""
    a, q = _plain(answer), _plain(question)
    ka, kq = _key(a), _key(q)
    d = [0.0] * DENSE
    d[0] = 1.0
    d[1] = float(len(ka) == 0)
    d[2] = float(0 < len(ka) <= 2)
    d[3] = min(len(a), 600) / 600
    whole_answer = a
    if kq and kq in ka and ka != kq and q in a:  # how the answer behind a repeated question ends
        rest = a.replace(q, " ").strip(" \n:：>\"'“”")
        a = rest if _key(rest) else a
    end = a[-1:] if a else ""
    ended = bool(_END.search(a))
    d[4] = float(ended)
    d[5] = float(end.isalnum() and not _HAN.match(end))
    d[6] = float(bool(_HAN.match(end)))
    d[7] = float(end in ",;:，；：、-–—(（/" and end != "")
    sentences = [x for x in re.split(r"(?<=[!?。！？])\s*|(?<=\.)\s+", a) if x]
    last = sentences[-1] if sentences else ""
    d[8] = float(len(sentences) > 1 and not ended)
    han, latin = _prose(a)
    verbal = latin >= 3 or han >= 6
    d[9] = float(verbal and not ended)
    d[10] = float(not verbal)
    d[11] = float(raw.count("(") + raw.count("（") > raw.count(")") + raw.count("）"))
    opened = len(re.findall(r"<[A-Za-z][^/>]*>", raw)) - len(re.findall(r"</[A-Za-z][^>]*>", raw))
    d[12] = float(opened > 0) + float(raw.count("```") % 2) + float(raw.count("**") % 2)
    a, behind = whole_answer, a
    lines = [x for x in raw.strip().split("\n") if x.strip()]
    d[13] = float(bool(lines) and re.fullmatch(r"\s*(?:\d+[.)]|[-*•])\s*", lines[-1]) is not None)
    d[14] = float(len(lines) > 1 and not ended)
    if kq:
        ga, gq = _grams(ka), _grams(kq)
        both = len(ga & gq)
        d[15] = both / max(1, len(ga | gq))
        d[16] = both / max(1, len(ga))
        d[17] = float(ka == kq)
        rest = ka.replace(kq, "")
        d[18] = float(kq in ka and _INTRO.fullmatch(rest) is not None)
        d[19] = float(kq in ka and not d[18])
        d[20] = float(kq not in ka and d[15] > 0.75 and ka[:4] == kq[:4] and 0.85 * len(kq) < len(ka) < 1.15 * len(kq))
        qh, ql = _prose(q)
        qzh = qh > 0 and qh * 2 >= ql
        d[21] = float(qzh)
        zh, en, other = languages(a)
        whole = zh + en + other
        strange = whole - (zh if qzh else en)
        d[22] = float(whole >= 3 and strange * 2 > whole)
        d[23] = float(d[22] > 0 and other * 2 > whole)
        d[24] = strange / max(1.0, whole) * float(whole >= 3)
    d[25] = float(re.search(r"\d", _NAME.sub(" ", a[:60])) is not None or re.search(r"\d+(?:\.\d+)?\s?[A-Za-zμ°%]", a) is not None)
    d[26] = min(len(last), 200) / 200
    d[27] = float(len(sentences) <= 1)
    d[28] = float(han > 0)
    d[29] = float(len(lines) > 1)
    figure_end = bool(re.search(r"\d\s*[A-Za-zμ°%]{0,4}[*_`\"”]*$", behind))
    d[30] = float(len(sentences) <= 1 and figure_end)  # only its full stop is missing
    d[31] = float(verbal and not ended and not d[30])
    # what the features above say together: a linear model cannot put them together by itself
    unclosed = bool(d[11] or d[12] or d[13])
    proved_copy = bool(d[17] or d[18] or d[20])
    d[32] = float(unclosed)
    d[33] = float(bool(ka) and ended and not unclosed)  # complete
    d[34] = float(bool(ka) and not verbal and not unclosed and not d[7])  # a bare value
    d[35] = float(proved_copy)
    d[36] = float(bool(d[31] or unclosed) and not proved_copy)  # unfinished
    d[37] = float(bool(d[22]) and not proved_copy)
    d[38] = float(d[30] and not unclosed)
    d[39] = float(not verbal and d[7] and not unclosed)
    d[40] = float(bool(ka) and not proved_copy and not d[22] and bool(d[33] or d[34] or d[38]))  # nothing wrong with its form
    text = _NAME.sub(" N ", a.lower())
    known = set(_WORDS.findall(q.lower()))
    starts = [*range(0, len(text) - WINDOW, WINDOW // 2), len(text) - WINDOW] if len(text) > WINDOW else []
    return d, _buckets(_WORDS.findall(text), known), [_buckets(_WORDS.findall(text[i : i + WINDOW]), known) for i in starts]


class Rows(NamedTuple):
    """Pairs as features: dense ones, and the buckets of all n-grams one after the other with where each row's begin."""

    dense: np.ndarray
    grams: np.ndarray
    start: np.ndarray
    size: np.ndarray
    windows: dict

    @staticmethod
    def of(pairs: list[tuple]) -> Rows:
        dense, grams, windows = np.zeros((len(pairs), DENSE), dtype=np.float32), [], {}
        for i, (q, a) in enumerate(pairs):
            dense[i], g, parts = features(q, a)
            grams.append(g if len(g) else _NONE)
            if parts:
                windows[i] = parts
        size = np.array([len(g) for g in grams], dtype=np.int64)
        return Rows(dense * 2, np.concatenate(grams) if grams else _NONE, np.cumsum(size) - size, size, windows)

    def take(self, rows: np.ndarray) -> Rows:
        size = self.size[rows]
        start = np.cumsum(size) - size
        at = np.repeat(self.start[rows] - start, size) + np.arange(size.sum())
        return Rows(self.dense[rows], self.grams[at], start, size, {i: self.windows[r] for i, r in enumerate(rows) if r in self.windows})

    @property
    def weight(self) -> np.ndarray:
        return (4.0 / np.sqrt(self.size)).astype(np.float32)

    def times(self, w: np.ndarray) -> np.ndarray:
        if not len(self.size):
            return np.zeros((0, w.shape[1]), dtype=np.float32)
        sums = [np.add.reduceat(np.ascontiguousarray(w[DENSE:, k]).take(self.grams), self.start) for k in range(w.shape[1])]
        return self.dense @ w[:DENSE] + np.stack(sums, axis=1) * self.weight[:, None]

    def turned_times(self, g: np.ndarray) -> np.ndarray:
        """The features, transposed, times g."""
        sums = [np.bincount(self.grams, weights=np.repeat(g[:, k] * self.weight, self.size), minlength=BUCKETS + 1) for k in range(g.shape[1])]
        return np.concatenate([self.dense.T @ g, np.stack(sums, axis=1).astype(np.float32)])


def _scores(x: Rows, w: np.ndarray) -> np.ndarray:
    """Scores per label; a refusal scores as in the window that most resembles one, so that a preamble of any length does not thin it out."""
    score, k = x.times(w), LABELS.index("refusal")
    for i, parts in x.windows.items():
        best = max((4.0 / np.sqrt(len(g)) * w[DENSE + g, k].sum() for g in parts if len(g)), default=-np.inf)
        score[i, k] = max(score[i, k], x.dense[i] @ w[:DENSE, k] + best)
    return score


def _asked(q: str, rng: random.Random) -> str:
    """Something the question is about: the name in it or a few of its words."""
    names = re.findall(r"[A-Z][A-Za-z]+\s+[A-Za-z]+-\d+", q)
    words = re.findall(r"[A-Za-z-]{3,}(?:\s[A-Za-z-]{3,}){0,2}|[㐀-鿿]{2,6}", q) or ["this"]
    return rng.choice(names) if names and rng.random() < 0.5 else ("the " if q.isascii() and rng.random() < 0.6 else "") + rng.choice(words)


def _topic(q: str) -> str:
    words = re.findall(r"[A-Za-z][A-Za-z -]{3,}|[㐀-鿿]{2,6}", q or "")
    return words[-1].strip() if words else "this"


def _figure_alone(part: str) -> bool:
    """One statement that breaks off behind a figure: it may as well lack nothing but its full stop."""
    a = _plain(part)
    return not re.search(r"[!?。！？]\s*|\.\s+", a) and "<answer>" not in part and re.search(r"\d\s*[A-Za-zμ°%]{0,4}[*_`\"”]*$", a) is not None


def synthetic(pairs: list[tuple], seed: int = 7) -> tuple[list[tuple], list[int], list[int]]:
    """(pairs, label or -1, index of the pair it was made from, index of the pair whose answer it is)."""
    rng = random.Random(seed)
    prose = [i for i, p in enumerate(pairs) if sum(languages(_plain(p[1]))) >= 3]  # no bare values
    zh = [i for i in prose if _HAN.search(pairs[i][0])]
    en = [i for i in prose if not _HAN.search(pairs[i][0])]
    out, label, origin, lender = [], [], [], []

    def add(q, a, k, i, j=None):
        out.append((q, a))
        label.append(k)
        origin.append(i)
        lender.append(i if j is None else j)

    for i, (q, a, value) in enumerate(pairs):
        is_zh = bool(_HAN.search(q))
        topic = _topic(q)
        add(q, a, -1, i)
        add(q, rng.choice([f"{q}\n{a}", f"{q} {a}", f"<answer>{a}</answer>", f"**{a}**", f"{a} {rng.choice(_ADDED_ZH if is_zh else _ADDED_EN).format(a=topic)}", f"{a}" + ("（" + topic + "）" if is_zh else " (" + topic + ")"), f"1. {a}\n2. {a}"]), -1, i)
        add(q, rng.choice(_ADDED_ZH if is_zh else _ADDED_EN).format(a=topic), -1, i) if i % 3 == 0 else None
        if value and i % 2 == 0:
            add(q, value, -1, i)
        first = re.split(r"(?<=[.。])\s*", a.strip())[0]
        if i % 3 == 1 and re.search(r"\d\s*[A-Za-zμ°%]{0,4}[.。]$", first):
            add(q, first.rstrip(".。"), -1, i)
        body = a.strip()
        if len(body) > 14:
            base = rng.choice([body, body, f"<answer>{body}</answer>", f"1. {body}\n2. {body}", f"{q}\n{body}", f"**{body}**"])
            for _ in range(2):
                p = rng.randint(max(8, len(base) // 5), len(base) - 2)
                part = base[:p].rstrip()
                if part and (not _END.search(part) or "<answer>" in part) and not _figure_alone(part) and _prose(part)[0] + _prose(part)[1] >= 3 and _key(_plain(part)) not in _key(_plain(q)):
                    add(q, part, 1, i)
        for _ in range(3):
            if is_zh:
                r = rng.choice(_OPEN_ZH) + rng.choice(_CORE_ZH) + rng.choice(_WHY_ZH) + rng.choice(["。", "。", "！"]) + rng.choice(_TAIL_ZH)
            else:
                r = rng.choice(_OPEN_EN) + rng.choice(_CORE_EN) + rng.choice(_WHY_EN) + rng.choice([".", ".", "!"]) + rng.choice(_TAIL_EN)
                r = r[:1].upper() + r[1:]
            r = r.format(a=_asked(q, rng))
            add(q, r, 2, i)
        if i % 2 == 0:  # behind the question, repeated up to some hundred words
            add(q, f"{q} " * (1 + i // 2 % 8) + r, 2, i)
            add(q, f"{q} " * (1 + i // 2 % 8) + a, -1, i)
        c = rng.choice([q, q, f"> {q}", f'"{q}"', f"**{q}**", q.rstrip("?？.。"), f"Q: {q}", q.upper(), q.replace(" ", "  "), f"<answer>{q}</answer>", f"“{q}”", f"- {q}", f"Answer: {q}", f"You asked: {q}", f"The question is: {q}", f"{q} {q}", f"{q}\n{q}", f"答：{q}" if is_zh else f"A: {q}", rng.choice([f"您的问题是：{q}", f"您问的是：{q}"]) if is_zh else f"Your question: {q}"])
        add(q, c, 3, i)
        other = en if is_zh else zh
        if other:
            j = rng.choice(other)
            add(q, pairs[j][1], 4, i, j)
        name = (re.findall(r"[A-Z][A-Za-z]+\s+[A-Za-z]+-\d+", q) or ["it"])[0]
        if i % 2:
            add(q, rng.choice(_OTHER).format(n=name, v=value or f"{rng.randint(2, 900)} m"), 4, i)
        if i % 4 == 0:
            add(q, rng.choice(_EMPTY), 0, i)
    return out, label, origin, lender


def _descend(x: Rows, y: np.ndarray, steps: int) -> np.ndarray:
    # wording tells a refusal; the other defects are properties of the pair, so wording that happens to go with them fades
    decay = np.full((DENSE + BUCKETS + 1, len(LABELS)), 2e-5, dtype=np.float32)
    decay[DENSE:] = 2e-3
    decay[DENSE:, LABELS.index("refusal")] = 2e-5
    w = np.zeros_like(decay)
    m, v = np.zeros_like(w), np.zeros_like(w)
    weight = np.where(y > 0, 2.0, 1.0).astype(np.float32)
    for t in range(1, steps + 1):
        p = 1 / (1 + np.exp(-np.clip(x.times(w), -30, 30)))
        g = x.turned_times((p - y) * weight) / max(1, len(y)) + decay * w
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= 0.12 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        w[-1] = 0.0
    return w


def _examples(pairs: list[tuple], seed: int) -> tuple:
    """Feature rows, labels one-hot and the indices of the pairs each row was made from."""
    data, label, origin, lender = synthetic(pairs, seed)
    y = np.zeros((len(data), len(LABELS)), dtype=np.float32)
    for i, k in enumerate(label):
        if k >= 0:
            y[i, k] = 1
    return Rows.of(data), y, np.array(origin), np.array(lender)


def fit(pairs: list[tuple], seed: int = 7, steps: int = 200) -> dict:
    """Weights, thresholds included, from (question, sound answer, bare value or None)."""
    if not pairs:  # nothing to learn from
        return {"w": np.zeros((DENSE + BUCKETS + 1, len(LABELS)), dtype=np.float32)}
    x, y, origin, lender = _examples(pairs, seed)
    half = np.array([zlib.crc32(_key(a).encode()) % 2 for _, a, _ in pairs])
    own = x.take(np.unique(origin, return_index=True)[1])  # the sampled answer itself is the first row of each pair
    bad = np.zeros(len(pairs), dtype=bool)
    for h in (0, 1):  # each half is judged by a short fit on the other, which has not learned its defective answers as sound
        other = np.flatnonzero(half[origin] != h)
        if len(other):
            bad |= (half == h) & (_scores(own, _descend(x.take(other), y[other], steps // 3)) >= -1).any(axis=1)
    if not bad.all():
        keep = np.flatnonzero(~bad[origin] & ~bad[lender])
        x, y, origin = x.take(keep), y[keep], origin[keep]
    held = origin % 5 == 0
    w = _descend(x.take(np.flatnonzero(~held)), y[~held], steps)
    score = _scores(x, w)[held]
    cuts = []
    for k in range(len(LABELS)):
        s, true = score[:, k], y[held][:, k] > 0
        # a third of the way from almost all sound to almost all defective pairs, where they lie apart; else the best F1
        low, high = (np.quantile(s[~true], 0.995), np.quantile(s[true], 0.01)) if true.any() and (~true).any() else (0.0, 0.0)
        if high > low:
            cuts.append(float(low * 2 + high) / 3)
            continue
        grid = np.unique(np.quantile(s, np.linspace(0, 1, 401))) if len(s) else np.array([0.0])
        f1 = np.array([2 * ((s >= c) & true).sum() / max(1, (s >= c).sum() + true.sum()) for c in grid])
        cuts.append(float(grid[np.argmax(f1 >= f1.max() - 0.0015)]))  # the lowest of what is as good as the best
    w[0] -= np.array(cuts, dtype=np.float32) / 2  # the thresholds become part of the bias, whose feature is 2 in every row
    return {"w": w}


def judge(model: dict, questions: list, answers: list) -> list[str | None]:
    """The label with the largest margin over its threshold; None where no label reaches its own."""
    out: list[str | None] = []
    for i in range(0, len(answers), 512):
        margin = _scores(Rows.of(list(zip(questions[i : i + 512], answers[i : i + 512]))), model["w"])
        out += [LABELS[k] if m > 0 else None for k, m in zip(margin.argmax(axis=1), margin.max(axis=1))]
    return out


def _judge_batches(model):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            defect = judge(model, [q if isinstance(q, str) else None for q in pdf["question"]], [a if isinstance(a, str) else None for a in pdf["answer"]])
            yield pd.DataFrame({"id": pdf["id"], "defect": pd.Series(defect, dtype=object, index=pdf.index)})

    return run


def train(generations: DataFrame, questions: DataFrame, sample_rows: int = 1000) -> dict:
    """Fits on at most sample_rows pairs that have a question and an answer of some length."""
    g = generations.filter(F.length("generated_text") >= 12).select(F.col("question_id").alias("qid"), "generated_text", "prediction", F.xxhash64("id", "generated_text").alias("h"))
    g = g.orderBy("h").limit(sample_rows)
    q = questions.select(F.col("id").alias("qid"), "question").filter(F.col("question").isNotNull())
    rows = g.join(q, "qid").orderBy("h").select("question", "generated_text", "prediction").collect()  # at most sample_rows rows
    pairs = [(r.question, r.generated_text, r.prediction) for r in rows if len(_key(_plain(r.generated_text))) > 5]
    return fit(pairs)


def verdicts(generations: DataFrame, questions: DataFrame, sample_rows: int = 1000) -> DataFrame:
    """id, defect (null: sound) of every answer."""
    model = train(generations, questions, sample_rows)
    q = questions.groupBy(F.col("id").alias("question_id")).agg(F.min("question").alias("question"))
    pairs = generations.select("id", "question_id", F.col("generated_text").alias("answer")).join(q, "question_id", "left").select("id", "question", "answer")
    return pairs.mapInPandas(_judge_batches(model), "id string, defect string")


def found(generations: DataFrame, questions: DataFrame) -> DataFrame:
    """p6_found: id, defect of every defective pair."""
    return verdicts(generations, questions).filter(F.col("defect").isNotNull() & F.col("id").isNotNull()).distinct()
