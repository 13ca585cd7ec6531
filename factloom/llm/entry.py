"""Queries of this subpackage, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from factloom.llm import alignment, bpe, html, language, licenses, neighbours, packing, phrases, pii, secrets, simhash, toxicity, winnow

QUERIES = {
    "op1_language_id": language.op1_language_id,
    "op1_language_id_pages": language.op1_language_id_pages,
    "op2_packing": packing.op2_packing,
    "op3_neighbours": neighbours.op3_neighbours,
    "op4_surrogates": pii.op4_surrogates,
    "op5_toxicity": toxicity.op5_toxicity,
    "op6_bpe": bpe.op6_bpe,
    "op7_simhash": simhash.op7_simhash,
    "op8_licenses": licenses.op8_licenses,
    "op9_winnowing": winnow.op9_winnowing,
    "op10_html": html.op10_html,
    "op11_alignment": alignment.op11_alignment,
    "op12_phrases": phrases.op12_phrases,
    "op13_secrets": secrets.op13_secrets,
}

ORACLES: dict[str, str] = {"op8_licenses": licenses.oracle(), "op13_secrets": secrets.oracle()}


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
