"""The registered queries of this folder and their SQL twins."""

from __future__ import annotations

from importlib import import_module

#: (module, query, name of its SQL or None)
ENTRIES = (
    ("suffix_dedup", "op1_suffix_dedup", "OP1_SQL"),
    ("exact_dedup", "op2_exact_dedup", "OP2_SQL"),
    ("quality_rules", "op3_quality_rules", None),
    ("pseudonyms", "op4_pseudonyms", None),
    ("line_crf", "op5_line_crf", None),
    ("line_runs", "op6_line_runs", "OP6_SQL"),
    ("line_runs", "op6_line_runs_words", "OP6_WORDS_SQL"),
    ("url_filter", "op7_url_filter", "OP7_SQL"),
    ("near_dedup", "op8_near_duplicates", "OP8_SQL"),
    ("bpe", "op9_bpe", None),
    ("mixing", "op10_mixture", "OP10_SQL"),
    ("decontamination", "op11_decontamination", "OP11_SQL"),
    ("whitening", "op12_whitening", None),
    ("conversations", "op13_conversations", None),
)

QUERIES: dict = {}
ORACLES: dict = {}
for _module, _query, _sql in ENTRIES:
    _loaded = import_module(f"tremorframe.llm.{_module}")
    QUERIES[_query] = getattr(_loaded, _query)
    if _sql:
        ORACLES[_query] = getattr(_loaded, _sql)
