"""Problem 7: encoding the whole corpus with a public byte-level BPE tokenizer.

Method. The merges are compiled into a finite-state transducer that is determinised lazily. Byte-pair encoding has the
property that a sequence of tokens is the encoding of its bytes exactly if every two neighbours are (each pair,
encoded alone, gives itself back). So a word is read byte by byte; a state holds, for each place where a token that may still
grow can begin, the tokens that lead to that place. What all of them share is emitted: the lookahead is bounded by
the longest token. States and transitions are made when first needed and shared by all words of a task, so a word costs
one table look-up per byte, whatever its length. Decoding is a stream through an incremental UTF-8 state machine.

Scale. One pass, no shuffle; the vocabulary (about 1 MB, checked) is broadcast; states are bounded by a reset between words.

Defined results. Null and empty text: no ids. Text that looks like a special token is ordinary text. A null doc_id is kept.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where the public vocabulary files lie; a parameter of every function below.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
#: How a byte-level tokenizer of this kind cuts text into words before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
MOST_BROADCAST = 32_000_000


def _byte_names() -> dict[str, int]:
    """The printable character that stands for each byte in vocabulary files: printable Latin-1 stands for itself."""
    own = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    other = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(other)}


def load(path: str = VOCABULARY) -> tuple[list[bytes], dict[tuple[int, int], tuple[int, int]]]:
    """(bytes of each id, pair of ids -> (rank, id))."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    names = _byte_names()
    vocab = model["vocab"]
    tokens: list[bytes] = [b""] * (max(vocab.values()) + 1)
    for t, i in vocab.items():
        tokens[i] = bytes(names[c] for c in t)
    pairs = {}
    for rank, m in enumerate(model["merges"]):
        a, b = m if isinstance(m, list) else m.split(" ")
        pairs[vocab[a], vocab[b]] = (rank, vocab[a + b])
    return tokens, pairs


class Transducer:
    """Encodes words; its states are made as words need them."""

    def __init__(self, tokens: list[bytes], pairs: dict, most_states: int = 200_000):
        self.tokens, self.pairs, self.most_states = tokens, pairs, most_states
        self.single = {t[0]: i for i, t in enumerate(tokens) if len(t) == 1}
        # trie of the vocabulary: node -> {byte: node}, token that ends at a node
        self.child: list[dict[int, int]] = [{}]
        self.ends: list[int] = [-1]
        for i, t in enumerate(tokens):
            node = 0
            for b in t:
                nxt = self.child[node].get(b)
                if nxt is None:
                    nxt = len(self.child)
                    self.child.append({})
                    self.ends.append(-1)
                    self.child[node][b] = nxt
                node = nxt
            if t:
                self.ends[node] = i
        self._fits: dict[tuple[int, int], bool] = {}
        self.reset()

    def reset(self) -> None:
        # a state: (last token emitted, ((trie node, tokens pending up to where the node begins), ...), oldest place first)
        self.keys: dict[tuple, int] = {}
        self.states: list[tuple] = []
        self.step: list[dict[int, tuple[int, tuple[int, ...]]]] = []
        self.final: list[tuple[int, ...]] = []
        self.start = self._state((-1, ((0, ()),)))

    def _state(self, key: tuple) -> int:
        s = self.keys.get(key)
        if s is None:
            s = self.keys[key] = len(self.states)
            self.states.append(key)
            self.step.append({})
            self.final.append(key[1][-1][1])
        return s

    def merged(self, ids: list[int]) -> list[int]:
        """Byte-pair encoding by its definition, for short sequences."""
        pairs = self.pairs
        while len(ids) > 1:
            best = min((pairs[p] for p in zip(ids, ids[1:]) if p in pairs), default=None)
            if best is None:
                break
            out, i = [], 0
            while i < len(ids):
                if i + 1 < len(ids) and pairs.get((ids[i], ids[i + 1])) == best:
                    out.append(best[1])
                    i += 2
                else:
                    out.append(ids[i])
                    i += 1
            ids = out
        return ids

    def fits(self, a: int, b: int) -> bool:
        """Whether b may follow a (a = -1: begin a word) in an encoding."""
        known = self._fits.get((a, b))
        if known is None:
            single = self.single
            if a < 0:
                known = self.merged([single[x] for x in self.tokens[b]]) == [b]
            else:
                known = self.fits(-1, b) and self.merged([single[x] for x in self.tokens[a] + self.tokens[b]]) == [a, b]
            if len(self._fits) > 4_000_000:
                self._fits.clear()
            self._fits[a, b] = known
        return known

    def _make(self, state: int, byte: int) -> tuple[int, tuple[int, ...]]:
        last, places = self.states[state]
        grown, chain = [], None
        for node, before in places:
            nxt = self.child[node].get(byte)
            if nxt is None:
                continue
            if chain is None:
                token = self.ends[nxt]
                if token >= 0 and self.fits(before[-1] if before else last, token):
                    chain = (*before, token)
            if self.child[nxt]:
                grown.append((nxt, before))
        grown.append((0, chain))
        # tokens that every place shares are decided
        shared = 0
        first = grown[0][1]
        while all(len(c) > shared and c[shared] == first[shared] for _, c in grown):
            shared += 1
            if shared == len(first):
                break
        out = first[:shared]
        key = (out[-1] if out else last, tuple((n, c[shared:]) for n, c in grown))
        made = (self._state(key), out)
        self.step[state][byte] = made
        return made

    def word(self, data: bytes) -> list[int]:
        step = self.step
        s, out = self.start, []
        for b in data:
            t = step[s].get(b)
            if t is None:
                t = self._make(s, b)
            s, ids = t
            if ids:
                out += ids
        out += self.final[s]
        if len(self.states) > self.most_states:
            self.reset()
        return out


class Encoder:
    def __init__(self, tokens: list[bytes], pairs: dict, most_words: int = 100_000):
        import regex

        self.find = regex.compile(PATTERN).findall
        self.machine = Transducer(tokens, pairs)
        self.words: dict[str, list[int]] = {}
        self.most_words = most_words

    def encode(self, text: str | None) -> list[int]:
        out: list[int] = []
        if not text:
            return out
        words, machine = self.words, self.machine
        for w in self.find(text):
            ids = words.get(w)
            if ids is None:
                ids = machine.word(w.encode("utf-8", "surrogatepass"))
                if len(w) <= 24:
                    if len(words) >= self.most_words:
                        words.clear()
                    words[w] = ids
            out += ids
        return out


# UTF-8 as a machine: how many bytes follow a first byte and which second bytes it allows
def _lead(b: int) -> tuple[int, int, int] | None:
    if b < 0x80:
        return 0, 0, 0
    if 0xC2 <= b <= 0xDF:
        return 1, 0x80, 0xBF
    if 0xE0 <= b <= 0xEF:
        return 2, 0xA0 if b == 0xE0 else 0x80, 0x9F if b == 0xED else 0xBF
    if 0xF0 <= b <= 0xF4:
        return 3, 0x90 if b == 0xF0 else 0x80, 0x8F if b == 0xF4 else 0xBF
    return None


def decode(ids: Iterable[int], tokens: list[bytes]) -> Iterator[str]:
    """Text piece by piece: each id yields what is complete; bytes that form no character become U+FFFD."""
    held, more, low, high = bytearray(), 0, 0x80, 0xBF
    for i in ids:
        out = []
        for b in tokens[i]:
            if more:
                if low <= b <= high:
                    held.append(b)
                    more, low, high = more - 1, 0x80, 0xBF
                    if not more:
                        out.append(held.decode())
                        held.clear()
                    continue
                out.append("�")
                held.clear()
                more, low, high = 0, 0x80, 0xBF
            lead = _lead(b)
            if lead is None:
                out.append("�")
            elif lead[0] == 0:
                out.append(chr(b))
            else:
                held.append(b)
                more, low, high = lead
        yield "".join(out)
    if held:
        yield "�"


def _broadcast(spark, path: str):
    tokens, pairs = load(path)
    if sum(map(len, tokens)) + 24 * len(pairs) > MOST_BROADCAST:
        raise ValueError(f"{path} is too large a vocabulary to broadcast")
    return spark.sparkContext.broadcast((tokens, pairs))


def _encoded(shared, count_only: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = Encoder(*shared.value)
        for pdf in batches:
            ids = [encoder.encode(t) for t in pdf.pop("text")]
            pdf["n_tokens" if count_only else "ids"] = [len(x) for x in ids] if count_only else ids
            yield pdf

    return run


def encode(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """p7_ids: doc_id, ids."""
    shared = _broadcast(docs.sparkSession, path)
    return docs.select("doc_id", "text").mapInPandas(_encoded(shared, False), "doc_id long, ids array<int>")


def count(docs: DataFrame, keys: list[str], path: str = VOCABULARY) -> DataFrame:
    """The given columns and n_tokens of every document."""
    shared = _broadcast(docs.sparkSession, path)
    own = docs.select(*keys, "text")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema if f.name != "text") + ", n_tokens long"
    return own.mapInPandas(_encoded(shared, True), schema)


def token_totals(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """Tokens and documents per source."""
    c = count(docs, ["source"], path)
    return c.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"), F.max("n_tokens").alias("longest"))
