"""Queries and SQL of the operators in this subpackage."""

from __future__ import annotations

from gridwake.llm import bpe_codec, byte_bpe, centroid_clustering, decontamination, language_model, merkle_manifest, near_dedup, pii_pseudonyms, quality_rules, rans_output, secret_scan, token_counts, warc_files

_MODULES = (quality_rules, secret_scan, rans_output, warc_files, token_counts, language_model, decontamination, pii_pseudonyms, bpe_codec, near_dedup, byte_bpe, centroid_clustering, merkle_manifest)


def queries() -> dict:
    return {name: f for m in _MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {name: text for m in _MODULES for name, text in getattr(m, "SQL", {}).items()}
