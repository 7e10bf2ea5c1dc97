"""The queries of this subpackage and, where SQL can say the same, their SQL."""

from __future__ import annotations

import importlib

MODULES = ("op1_compaction", "op2_line_frequency", "op3_language", "op4_packing", "op5_collision_hashing", "op6_sstable", "op7_license_scan", "op8_byte_bpe", "op9_jaccard", "op10_hidden_markov", "op11_anagram_hashing", "op12_pii", "op13_collocations")
_loaded = [importlib.import_module(f"{__package__}.{m}") for m in MODULES]
QUERIES = {k: v for m in _loaded for k, v in m.QUERIES.items()}
SQL = {k: v for m in _loaded for k, v in m.SQL.items()}
