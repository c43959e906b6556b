"""Queries of the training-data operators and their SQL, for the entry module."""

from __future__ import annotations

from terrace.llm.decontaminate import OP2_SQL, op2_decontaminate
from terrace.llm.divergence import OP11_SQL, op11_divergence_audit
from terrace.llm.jaccard import OP3_SQL, op3_jaccard_join
from terrace.llm.langid import op1_language_id
from terrace.llm.licenses import op9_license_scan
from terrace.llm.lm import op8_language_model
from terrace.llm.media import op10_media_columns
from terrace.llm.merkle import OP13_SQL, op13_merkle_manifest
from terrace.llm.minhash import OP12_SQL, op12_minhash_dedup
from terrace.llm.mixing import OP4_SQL, op4_mix
from terrace.llm.pii import op7_pii
from terrace.llm.toxicity import op6_toxicity
from terrace.llm.urls import OP5_SQL, op5_url_filter

QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_decontaminate": op2_decontaminate,
    "op3_jaccard_join": op3_jaccard_join,
    "op4_mix": op4_mix,
    "op5_url_filter": op5_url_filter,
    "op6_toxicity": op6_toxicity,
    "op7_pii": op7_pii,
    "op8_language_model": op8_language_model,
    "op9_license_scan": op9_license_scan,
    "op10_media_columns": op10_media_columns,
    "op11_divergence_audit": op11_divergence_audit,
    "op12_minhash_dedup": op12_minhash_dedup,
    "op13_merkle_manifest": op13_merkle_manifest,
}
ORACLES = {"op2_decontaminate": OP2_SQL, "op3_jaccard_join": OP3_SQL, "op4_mix": OP4_SQL, "op5_url_filter": OP5_SQL, "op11_divergence_audit": OP11_SQL, "op12_minhash_dedup": OP12_SQL, "op13_merkle_manifest": OP13_SQL}
