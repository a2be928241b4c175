"""The queries of this subpackage and the SQL that says the same where SQL can."""

from __future__ import annotations

from importlib import import_module

_MODULES = ("decontaminate", "katz", "language_id", "mixing", "nearest", "token_counts", "quality", "warc", "url_reputation", "jaccard_join", "token_alignment", "lexical_search", "secret_scan")
QUERIES: dict = {}
ORACLES: dict[str, str] = {}
for _name in _MODULES:
    _module = import_module(f"{__package__}.{_name}")
    QUERIES |= _module.QUERIES
    ORACLES |= _module.ORACLES
