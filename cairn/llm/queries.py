"""The registered queries of the language-model operators and their SQL checks."""

from __future__ import annotations

from cairn.llm import byte_bpe, mixing, pair_defects, scan_repair, spam_pages, split_overlap, text_split
from cairn.session import table


def p2_found(spark, d):
    return split_overlap.found(table(spark, d, "questions"))


def p2_report(spark, d):
    return split_overlap.report(table(spark, d, "questions"))


def p4_found(spark, d):
    return scan_repair.found(table(spark, d, "radar_corpus"))


def p4_repaired(spark, d):
    return scan_repair.repaired(table(spark, d, "radar_corpus"))


def p5_found(spark, d):
    return text_split.found(table(spark, d, "radar_corpus"), table(spark, d, "chunks"))


def p5_pieces(spark, d):
    return text_split.split(text_split.items(table(spark, d, "radar_corpus"), table(spark, d, "chunks")))


def p9_found(spark, d):
    return spam_pages.found(table(spark, d, "documents"))


def p9_shares(spark, d):
    return spam_pages.judged(table(spark, d, "documents"))


def p6_found(spark, d):
    return pair_defects.found(table(spark, d, "generations"), table(spark, d, "questions"))


def p7_ids(spark, d):
    return byte_bpe.encode(table(spark, d, "documents"))


def p7_totals(spark, d):
    return byte_bpe.token_totals(table(spark, d, "documents"))


def p8_mix(spark, d):
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p8_shares(spark, d):
    return mixing.shares(table(spark, d, "documents"), table(spark, d, "mix_targets"))


QUERIES = {
    "p6_found": p6_found, "p7_ids": p7_ids, "p7_totals": p7_totals, "p8_mix": p8_mix, "p8_shares": p8_shares,
    "p5_found": p5_found, "p5_pieces": p5_pieces, "p9_found": p9_found, "p9_shares": p9_shares, "p4_found": p4_found, "p4_repaired": p4_repaired, "p2_found": p2_found, "p2_report": p2_report,
}
SQL: dict[str, str] = {
    "p5_found": """WITH x AS (SELECT id AS item_id, raw_text_en AS t FROM radar_corpus UNION SELECT c.chunk_id, c.text FROM chunks, unnest(chunks) AS u(c))
 SELECT item_id, CASE WHEN bool_or(list_max([length(r) FOR r IN regexp_split_to_array(t, '[\\s.!?。！？]')]) > 2500) THEN 'forced' ELSE 'natural' END AS cut_kind FROM x WHERE length(t) > 2500 AND item_id IS NOT NULL GROUP BY 1""",
}
