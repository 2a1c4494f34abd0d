"""The queries of the operators, over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from tenuis.llm import alignment, chat, decontaminate, html_text, jaccard, language, lexical, licenses, nbest, neighbours, pii, pseudo_lm, warc
from tenuis.llm.common import table


def decontamination(spark, sf):
    return decontaminate.report(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


def chat_formatting(spark, sf):
    return chat.report(chat.with_odd_conversation(table(spark, sf, "conversations")))


def nbest_segmentation(spark, sf):
    return nbest.segmented(table(spark, sf, "documents"))


def jaccard_join(spark, sf):
    return jaccard.report(table(spark, sf, "documents"))


def pseudo_likelihood(spark, sf):
    return pseudo_lm.report(table(spark, sf, "documents"))


def page_text(spark, sf):
    return html_text.report(table(spark, sf, "pages"))


def license_scan(spark, sf):
    return licenses.report(table(spark, sf, "documents"))


def language_id(spark, sf):
    return language.report(table(spark, sf, "documents"))


def personal_data(spark, sf):
    return pii.report(table(spark, sf, "documents"))


def nearest_neighbours(spark, sf):
    return neighbours.report(table(spark, sf, "embeddings"))


def warc_assembly(spark, sf):
    return warc.report(table(spark, sf, "pages"))


def ranked_search(spark, sf):
    return lexical.report(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


def tokenizer_alignment(spark, sf):
    return alignment.report(table(spark, sf, "documents"))


QUERIES = {
    "op1_decontamination": decontamination,
    "op2_chat_formatting": chat_formatting,
    "op3_nbest_segmentation": nbest_segmentation,
    "op4_jaccard_join": jaccard_join,
    "op5_pseudo_likelihood": pseudo_likelihood,
    "op6_page_text": page_text,
    "op7_license_scan": license_scan,
    "op8_language_id": language_id,
    "op9_personal_data": personal_data,
    "op10_nearest_neighbours": nearest_neighbours,
    "op11_warc_assembly": warc_assembly,
    "op12_ranked_search": ranked_search,
    "op13_tokenizer_alignment": tokenizer_alignment,
}

ORACLES = {
    "op1_decontamination": decontaminate.ORACLE_SQL,
    "op2_chat_formatting": chat.ORACLE_SQL,
    "op4_jaccard_join": jaccard.ORACLE_SQL,
    "op11_warc_assembly": warc.ORACLE_SQL,
    "op12_ranked_search": lexical.ORACLE_SQL,
}
