import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cairn.llm import text_split as X

PART = st.sampled_from(["a", "ab", "a" * 37, "a" * 260, " ", "\n", "\n\n", ". ", ".", "。", "# h\n", "== H ==\n", "1.1 x\n", "- i\n", "　", "🙂"])


@settings(max_examples=400, deadline=None)
@given(st.lists(PART, max_size=200), st.sampled_from([(20, 0), (20, 4), (50, 10), (250, 30)]))
def test_pieces_tile_the_text(parts, size):
    text, (limit, overlap) = "".join(parts), size
    if not text.strip():
        return
    spans = X.pieces(text, limit, overlap)
    assert "".join(text[a:b] for _, a, b, _ in spans) == text
    assert all(b - o <= limit and a - o <= overlap and b > a for o, a, b, _ in spans)
    run = max(len(x) for x in re.split(r"[\s.!?。！？]", text))
    if len(text) > limit:
        assert any(k == "forced" for *_, k in spans) == (run > limit)


@pytest.mark.parametrize("run", [2499, 2500, 2501, 6000])
@pytest.mark.parametrize("around", ["{}", "x. {}", "{}.y", "{} tail" * 2, "word " * 700 + "{}"])
def test_forced_only_when_it_must(run, around):
    text = around.replace("{}", "z" * run)
    spans = X.pieces(text)
    longest = max(len(x) for x in re.split(r"[\s.!?。！？]", text))
    if len(text) > 2500:
        assert any(k == "forced" for *_, k in spans) == (longest > 2500)


def test_natural_boundaries_first():
    text = "".join(f"== S{i} ==\n" + "A sentence of some length here. " * 40 + "\n" for i in range(4))
    assert [k for *_, k in X.pieces(text)] == ["start", "heading", "heading", "heading"]


def test_linear():
    rng = random.Random(1)
    text = "".join(rng.choice(["word ", "x. ", "\n"]) for _ in range(400_000))
    assert len(X.pieces(text)) > 300


def test_items(spark):
    c = spark.createDataFrame([("a", "x" * 2600), ("a", "x" * 2600), ("b", None), ("c", "  "), (None, "y" * 2600), ("d", "w " * 1300)], "id string, raw_text_en string")
    p = spark.createDataFrame([("s", [("k1", "z" * 2501), ("k2", None)]), ("t", []), ("u", None)], "source_id string, chunks array<struct<chunk_id: string, text: string>>")
    assert {tuple(r) for r in X.found(c, p).collect()} == {("a", "forced"), ("d", "natural"), ("k1", "forced")}
    assert X.found(c.limit(0), p.limit(0)).count() == 0


def test_no_merge_across_parents():
    """What comes out of an oversized section is not merged with what stands before it."""
    text = "# A\n" + "word " * 199 + "\n# B\n## B1\n" + "word " * 199 + "\n## B2\n" + "word " * 399
    got = [text[a:b] for _, a, b, _ in X.pieces(text)]
    assert [g.split()[:2] for g in got] == [["#", "A"], ["#", "B"], ["##", "B2"]] and "# B" not in got[0] and "## B1" in got[1]
    small = "# A\n" + "word " * 50 + "\n# C\n" + "word " * 50 + "\n# B\n## B1\n" + "word " * 300 + "\n## B2\n" + "word " * 300
    assert [text_.split()[:2] for text_ in (small[a:b] for _, a, b, _ in X.pieces(small))] == [["#", "A"], ["#", "B"], ["##", "B2"]]


@pytest.mark.parametrize("opening, closing", [("```python", "```"), ("<table>", "</table>"), ("~~~", "~~~")])
def test_blocks_stay_whole(opening, closing):
    block = opening + "\n" + "\n\n".join(f"x = {i} # one. two" for i in range(60)) + "\n" + closing + "\n"
    text = "Intro text. " * 110 + "\n\n" + block + "\nAfter it. " * 90
    assert any(block in text[a:b] for _, a, b, _ in X.pieces(text))
    long = opening + "\n" + "\n\n".join(f"x = {i} # one. two" for i in range(600)) + "\n" + closing + "\n"
    assert all(text_.rstrip("\n").split("\n")[-1].endswith(("two", closing)) for text_ in (long[a:b] for _, a, b, _ in X.pieces(long)))


def test_lists_are_cut_between_items():
    text = "Steps:\n\n" + "".join(f"{i}. first line of step {i}\n   second line. It has two sentences.\n" for i in range(1, 120))
    for _, a, b, _ in X.pieces(text)[1:]:
        assert re.match(r"\d+\. first", text[a:b])


def test_headings_nest():
    n = X.tree("intro\n\n# A\na\n## A1\nb\n### A11\nc\n## A2\nd\n# B\n```\n# no heading\n```\n")
    shape = lambda x: [shape(y) for y in x.children] if x.children else x.kind
    assert shape(n) == ["paragraph", ["paragraph", ["paragraph", ["paragraph"]], ["paragraph"]], ["fence"]]
