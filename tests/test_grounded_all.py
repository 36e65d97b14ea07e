from cairn.operators.fusion import grounded
from cairn.queries.kg import QUERIES
from cairn.session import table


def test_every_relation_and_both_ends(spark, data):
    key = lambda s: "".join(c for c in s.lower() if c.isalnum())
    texts = {}
    for r in table(spark, data, "radar_corpus").select("family_id", "raw_text_en").collect():
        if r.family_id is not None and r.raw_text_en is not None:
            texts.setdefault(key(r.family_id), []).append(key(r.raw_text_en))
    want = {}
    for r in table(spark, data, "wikidata_enrich_out").select("head", "relation", "tail").distinct().collect():
        if None not in tuple(r):
            held = [any(key(x) and key(x) in t for t in texts.get(r.head, [])) for x in (r.head, r.tail)]
            want["|".join(r)] = tuple(held)
    got = {r.claim: (r.head_in, r.tail_in) for r in QUERIES["j16_grounded_all"](spark, data).collect()}
    assert got == want and len({c.split("|")[1] for c in got}) > 1
    verdict = {(True, True): "accept", (False, False): "reject"}
    assert {r.claim: r.verdict for r in QUERIES["r08_gate_all"](spark, data).collect()} == {c: verdict.get(v, "judge") for c, v in want.items()}


def test_many_texts_and_ends_of_one_document(spark):
    """A claim is one row, however many texts its document has; same as looking into every text."""
    texts = [("d", f"Text {i}: the X-{i} and y {i % 7}.") for i in range(120)] + [("e", "Nothing"), ("e", "but A-1"), (None, "x0"), ("f", None)]
    claims = [(f"c{i}", "d", f"x{i}", f"Y {i}") for i in range(200)] + [("e1", "e", "a1", "--"), ("e2", "e", None, "nothing but"), ("f1", "f", "x0", "x0"), ("n1", None, "x0", "x0"), ("u1", "unknown", "x0", "x0")]
    key = lambda s: "".join(c for c in (s or "").lower() if c.isalnum())
    held = lambda doc, end: bool(key(end)) and any(key(end) in key(t) for d, t in texts if doc is not None and d == doc)
    got = grounded(spark.createDataFrame(claims, "claim string, doc string, head string, tail string"), spark.createDataFrame(texts, "doc string, text string")).collect()
    assert sorted(tuple(r) for r in got) == sorted((c, held(d, h), held(d, t)) for c, d, h, t in claims)
