"""Queries of this subpackage by name, and their SQL where DuckDB can express them."""

from __future__ import annotations

from accordant.llm import (
    alignment, byte_bpe, chat_format, chunk_reuse, decontaminate, filter_audit, language_id, media, quality, sharding,
    simhash, token_store, warc,
)

QUERIES = {
    "op1_decontamination": decontaminate.op1_query,
    "op2_byte_bpe": byte_bpe.op2_query,
    "op3_warc_segments": warc.op3_query,
    "op4_simhash": simhash.op4_query,
    "op5_token_store": token_store.op5_query,
    "op6_media_columns": media.op6_query,
    "op7_quality": quality.op7_query,
    "op8_language_id": language_id.op8_query,
    "op9_sharding": sharding.op9_query,
    "op10_chat_formatting": chat_format.op10_query,
    "op11_filter_audit": filter_audit.op11_query,
    "op12_chunk_reuse": chunk_reuse.op12_query,
    "op13_tokenizer_alignment": alignment.op13_query,
}

ORACLES = {
    "op3_warc_segments": warc.ORACLE,
    "op9_sharding": sharding.ORACLE,
    "op10_chat_formatting": chat_format.ORACLE,
    "op11_filter_audit": filter_audit.ORACLE,
}
