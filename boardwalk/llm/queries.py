"""All queries of this subpackage: importing the operator modules registers them."""

from importlib import import_module

from boardwalk.llm.registry import ORACLE, QUERIES

MODULES = ["bpe", "hardneg", "linedup", "lm", "middle", "mixing", "neardup", "quality", "sharding", "simjoin", "urls", "warc", "wordbpe"]

for _name in MODULES:
    import_module(f"boardwalk.llm.{_name}")

__all__ = ["ORACLE", "QUERIES"]
