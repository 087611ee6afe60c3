"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from gleanery.llm.chat import OP5_SQL, op5_chat_format
from gleanery.llm.decontamination import OP8_SQL, op8_decontamination
from gleanery.llm.embedding_dedup import OP3_SQL, op3_embedding_dedup
from gleanery.llm.html_extract import op2_html_extract
from gleanery.llm.license_scan import OP10_SQL, op10_license_scan
from gleanery.llm.line_dedup import OP1_SQL, op1_line_dedup
from gleanery.llm.mixing import OP7_SQL, op7_mixing
from gleanery.llm.ngram_join import OP9_SQL, op9_ngram_join
from gleanery.llm.toxicity import op4_toxicity
from gleanery.llm.url_filter import OP6_SQL, op6_url_filter

QUERIES = {
    "op1_line_dedup": op1_line_dedup,
    "op2_html_extract": op2_html_extract,
    "op3_embedding_dedup": op3_embedding_dedup,
    "op4_toxicity": op4_toxicity,
    "op5_chat_format": op5_chat_format,
    "op6_url_filter": op6_url_filter,
    "op7_mixing": op7_mixing,
    "op8_decontamination": op8_decontamination,
    "op9_ngram_join": op9_ngram_join,
    "op10_license_scan": op10_license_scan,
}

#: Where SQL can express the whole result; the others are tested against brute force in tests/llm.
ORACLE_SQL = {
    "op1_line_dedup": OP1_SQL,
    "op3_embedding_dedup": OP3_SQL,
    "op5_chat_format": OP5_SQL,
    "op6_url_filter": OP6_SQL,
    "op7_mixing": OP7_SQL,
    "op8_decontamination": OP8_SQL,
    "op9_ngram_join": OP9_SQL,
    "op10_license_scan": OP10_SQL,
}
