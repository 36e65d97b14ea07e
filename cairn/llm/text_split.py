"""Problem 5: splitting oversized items at natural boundaries.

Method. Structure-tree packing. A text is parsed into a tree: sections by the level of their headings, in them blocks
(paragraphs, lists, fenced code, tables, markup elements), in lists items, in blocks lines or sentences (sentences first
where the lines are those of a printed page), in sentences words. A subtree that fits is kept whole; neighbouring siblings that are
whole are merged to the limit; only an oversized node is descended into, and what comes out of it is never merged with
anything outside of it. Where a run has no boundary at all it is cut by force.
Each piece after the first starts with an overlap of at most `overlap` characters of what lies before it,
moved forward to a word where it can be.

Scale. One row per item in, its pieces out; no shuffle beside the removal of items delivered twice. Linear in the text;
a text within the limit is not parsed.

Defined results. Null, empty and blank texts: no pieces. Items up to the limit: one piece. Lengths are Unicode
code points as stored. Dropping the overlaps and joining the pieces gives the text back, character by character.
Fences and elements that are never closed end with the next heading or the text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT, OVERLAP = 2500, 300

_HEADING = re.compile(r"(?P<hash>#{1,6})\s+\S|(?P<wiki>={2,6})[^=\n]+=+\s*$|(?P<num>\d+(?:\.\d+){0,3})\.?\s+[^\W\d_a-z][^.!?。！？\n]{0,78}$")
_ITEM = re.compile(r"\s*(?:[-*+•·–]|\d{1,3}[.)]|[a-z][.)]|[（(]\d{1,3}[)）])\s+\S")
_FENCE = re.compile(r"\s*(```|~~~)")
_OPENS = re.compile(r"\s*<(table|ul|ol|dl|div|section|article|blockquote|pre|figure)\b[^>]*>", re.I)
_SENTENCE = re.compile(r"[.!?。！？]+[\"'”’)\]）」]*(?:\s+|(?<=[。！？”」]))")
_SPACE = re.compile(r"\s+")
_MARK = re.compile(r"[.!?。！？]|\s")


class Node(NamedTuple):
    start: int
    end: int
    kind: str  # section, paragraph, list, fence, table, markup, item, line, sentence, space, mark
    children: list | None = None
    label: str | None = None  # the boundary in front of it, if it is the first part of something larger


def _level(line: str) -> int:
    """Level of a heading line, 0 for any other line."""
    m = _HEADING.match(line)
    if not m:
        return 0
    return len(m["hash"]) if m["hash"] else len(m["wiki"]) - 1 if m["wiki"] else m["num"].count(".") + 1


def _blocks(text: str) -> list[tuple[int, int, str, int]]:
    """(start, end, kind, level of the heading it begins with) of the blocks of a text, which tile it."""
    out: list[tuple[int, int, str, int]] = []
    begin, kind, level, closing = 0, "", 0, None

    def close(at: int) -> None:
        nonlocal begin, kind, level, closing
        if at > begin:
            out.append((begin, at, kind or "paragraph", level))
        begin, kind, level, closing = at, "", 0, None

    at, blank = 0, False
    for line in text.splitlines(keepends=True):
        end = at + len(line)
        bare = line.strip()
        depth = 0 if closing and closing[0] == "fence" else _level(line.rstrip("\n"))
        if depth:
            close(at)
            level, blank = depth, False
        elif closing:  # inside a fence or an element
            if (closing[0] == "fence" and bare.startswith(closing[1])) or (closing[0] == "markup" and closing[1] in bare.lower()):
                close(end)
        elif not bare:
            blank = True
        else:
            fence, opens = _FENCE.match(line), _OPENS.match(line)
            now = "fence" if fence else "markup" if opens else "table" if bare.startswith("|") else "list" if _ITEM.match(line) or (kind == "list" and line[:1].isspace()) else "paragraph"
            own_heading = level and not kind
            if not own_heading and begin < at and (now != (kind or "paragraph") or (blank and now in ("paragraph", "table"))):
                close(at)
            kind = now
            if fence:
                closing = ("fence", fence[1])
            elif opens and f"</{opens[1].lower()}>" not in bare.lower():
                closing = ("markup", f"</{opens[1].lower()}>")
            elif opens:
                close(end)
            blank = False
        at = end
    close(len(text))
    return out


def tree(text: str) -> Node:
    """Sections within sections by their headings, blocks in them; a heading belongs to the block behind it."""
    top: list = []
    stack: list[tuple[int, int, list]] = [(0, 0, top)]  # level, start, children of the sections that are open
    ends = len(text)

    def shut(down_to: int, at: int) -> None:
        while stack[-1][0] >= down_to and len(stack) > 1:
            _, start, children = stack.pop()
            stack[-1][2].append(Node(start, at, "section", children))

    for start, end, kind, level in _blocks(text):
        if level:
            shut(level, start)
            stack.append((level, start, []))
        stack[-1][2].append(Node(start, end, kind))
    shut(1, ends)
    return Node(0, ends, "section", top)


def _cut_at(text: str, node: Node, pattern: re.Pattern, kind: str, both: bool = False) -> list[Node]:
    edges = [node.start]
    for m in pattern.finditer(text, node.start, node.end):
        for p in (m.start(), m.end()) if both else (m.end(),):
            if edges[-1] < p < node.end:
                edges.append(p)
    return [Node(a, b, kind) for a, b in zip(edges, [*edges[1:], node.end])]


def _lines(text: str, node: Node, kind: str = "line") -> list[Node]:
    return _cut_at(text, node, re.compile(r"\n\s*"), kind)


def _items(text: str, node: Node) -> list[Node]:
    """The items of a list with the lines that continue them."""
    edges = [node.start]
    for x in _lines(text, node)[1:]:
        if _ITEM.match(text, x.start, x.end):
            edges.append(x.start)
    return [Node(a, b, "item") for a, b in zip(edges, [*edges[1:], node.end])]


def _children(text: str, node: Node) -> list[Node]:
    """The parts of a node, one at least; a node that has but one part of the next kind is asked for the kind after that."""
    if node.children:
        return node.children
    if node.kind == "list":
        return _items(text, node)
    if node.kind in ("fence", "table", "markup"):
        return _lines(text, node)
    if node.kind in ("paragraph", "item"):
        lines = _lines(text, node)
        printed = len(lines) > 2 and 2 * sum(text[x.start : x.end].rstrip()[-1:] not in tuple(".!?。！？:：;；") for x in lines) > len(lines) and len(_cut_at(text, node, _SENTENCE, "")) > 2
        return [x._replace(kind="sentence") for x in _cut_at(text, node, _SENTENCE, "sentence")] if printed else lines
    if node.kind == "line":
        return _cut_at(text, node, _SENTENCE, "sentence")
    if node.kind == "sentence":
        return _cut_at(text, node, _SPACE, "space")
    return _cut_at(text, node, _MARK, "mark", both=True)


def pieces(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, int, str]]:
    """(start of overlap, start, end, boundary in front): spans of the text, in order, that tile it."""
    if len(text) <= limit:
        return [(0, 0, len(text), "start")] if text else []
    room = limit - overlap
    out: list[list] = []

    def emit(start: int, end: int, kind: str) -> None:
        out.append([start, end, "heading" if kind == "section" else kind])

    def place(nodes: list[Node], kind: str) -> None:
        """Merges whole siblings, descends into those that are too large. kind: of the node whose parts they are."""
        first, end = None, 0
        for n, x in enumerate(nodes):
            if n == 0:
                x = x._replace(label=kind)
            budget = room if out else limit
            if first is not None and x.end - first.start <= budget:
                end = x.end
                continue
            if first is not None:
                emit(first.start, end, first.label or first.kind)
                first = None
            budget = room if out else limit
            size = x.end - x.start
            if size <= budget:
                first, end = x, x.end
            elif x.kind != "mark":
                place(_children(text, x), x.label or x.kind)
            elif size <= limit:  # no boundary in it, but it fits if the overlap is shorter
                emit(x.start, x.end, x.label or x.kind)
            else:
                p = x.start
                while x.end > p:
                    q = min(x.end, p + (room if out else limit))
                    emit(p, q, "forced" if p > x.start else x.label or x.kind)
                    p = q
        if first is not None:
            emit(first.start, end, first.label or first.kind)

    place(_children(text, tree(text)), "start")
    spans = []
    for k, (a, b, kind) in enumerate(out):
        keep = 0 if k == 0 else min(overlap, limit - (b - a), a - out[k - 1][0])
        o = a - max(keep, 0)
        if o < a and not text[o - 1].isspace() and text[o - 1] not in ".!?。！？":
            m = _MARK.search(text, o, a)
            o = m.end() if m and m.end() < a else o
        spans.append((o, a, b, kind))
    return spans


def _pieces(limit: int, overlap: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["item_id", "origin", "piece_no", "n_pieces", "overlap_chars", "cut", "item_chars", "text"]
        for pdf in batches:
            rows = []
            for id_, origin, text in zip(pdf["item_id"], pdf["origin"], pdf["text"]):
                spans = pieces(text, limit, overlap)
                for k, (o, a, b, kind) in enumerate(spans):
                    rows.append((id_, origin, k + 1, len(spans), a - o, kind, len(text), text[o:b]))
                if len(rows) > 5000:
                    yield pd.DataFrame(rows, columns=columns)
                    rows = []
            yield pd.DataFrame(rows, columns=columns)

    return run


def items(corpus: DataFrame, packets: DataFrame) -> DataFrame:
    """item_id, origin, text of every text that may have to be split; what was delivered twice counts once."""
    a = corpus.select(F.col("id").alias("item_id"), F.lit("corpus").alias("origin"), F.col("raw_text_en").alias("text"))
    c = packets.select(F.explode("chunks").alias("c"))
    b = c.select(F.col("c.chunk_id").alias("item_id"), F.lit("chunk").alias("origin"), F.col("c.text").alias("text"))
    return a.unionByName(b).filter(F.col("text").isNotNull() & (F.length(F.trim("text")) > 0)).distinct()


def split(items_df: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    schema = "item_id string, origin string, piece_no int, n_pieces int, overlap_chars int, cut string, item_chars int, text string"
    return items_df.mapInPandas(_pieces(limit, overlap), schema)


def found(corpus: DataFrame, packets: DataFrame) -> DataFrame:
    """p5_found: items over the limit and whether one of their cuts is forced."""
    p = split(items(corpus, packets)).filter((F.col("item_chars") > LIMIT) & F.col("item_id").isNotNull())
    return p.groupBy("item_id").agg(F.when(F.bool_or(F.col("cut") == "forced"), "forced").otherwise("natural").alias("cut_kind"))
