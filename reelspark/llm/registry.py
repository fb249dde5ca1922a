"""All corpus queries and their SQL, by name."""

from __future__ import annotations

from importlib import import_module

MODULES = ["topk", "urls", "decontamination", "licenses", "packing", "toxicity", "simhash", "warc", "sharding", "secrets", "resampling", "manifest", "lines"]

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
for _name in MODULES:
    _module = import_module(f"reelspark.llm.{_name}")
    QUERIES |= _module.QUERIES
    ORACLES |= _module.ORACLES
