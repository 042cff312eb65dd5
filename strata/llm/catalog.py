"""The queries of this package, by name."""

from strata.llm import decontamination, language_model, licenses, merkle, packing, pii, quality, simhash, substring_dedup, token_counts, toxicity, url_filter, whitening

MODULES = [simhash, quality, url_filter, decontamination, token_counts, language_model, packing, substring_dedup, pii, toxicity, whitening, licenses, merkle]
QUERIES = {k: f for m in MODULES for k, f in m.QUERIES.items()}
ORACLE_SQL = {k: q for m in MODULES for k, q in m.ORACLE_SQL.items()}
