"""Operators for training-data pipelines; ``QUERIES`` has one query for each, ``ORACLES`` the SQL twins that exist."""

from . import bpe, decontam, filter_audit, lengths, lsh_forest, native_rules, packing, pii, quality_qda, rlz, set_join, suffix, token_alignment

MODULES = (bpe, rlz, packing, suffix, pii, lengths, quality_qda, native_rules, set_join, decontam, filter_audit, lsh_forest, token_alignment)
QUERIES = {name: fn for m in MODULES for name, fn in m.QUERIES.items()}
ORACLES = {name: sql for m in MODULES for name, sql in getattr(m, "ORACLES", {}).items()}
