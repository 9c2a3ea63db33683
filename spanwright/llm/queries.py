"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

import importlib

QUERIES, ORACLES = {}, {}
for _name, _module in {
    "op1_pii": "pii", "op2_html": "html_density", "op3_line_dedup": "line_dedup", "op4_simhash": "simhash", "op5_quality_rules": "quality",
    "op6_imatch": "imatch", "op7_packing": "packing", "op8_mixing": "mixing", "op9_language": "language", "op10_sharding": "sharding",
}.items():
    _m = importlib.import_module(f"{__package__}.{_module}")
    QUERIES[_name] = getattr(_m, _name)
    if hasattr(_m, "ORACLE"):
        ORACLES[_name] = _m.ORACLE
