"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from . import binary_output, bpe, decontaminate, filter_audit, jaccard_join, language_model, quality, secrets, substring_dedup, suffix_dedup, token_count, url_filter, whitening

MODULES = [jaccard_join, language_model, quality, suffix_dedup, substring_dedup, token_count, secrets, binary_output, decontaminate, bpe, whitening, url_filter, filter_audit]
QUERIES = {k: f for m in MODULES for k, f in m.QUERIES.items()}
ORACLE = {k: s for m in MODULES for k, s in m.ORACLE.items()}
