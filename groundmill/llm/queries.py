"""The queries of this subpackage and the SQL they are held against."""

from groundmill.llm import leakage, near, packing, replies, splitting, truncation

MODULES = [near, truncation, leakage, replies, packing, splitting]
QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
ORACLES = {name: sql for module in MODULES for name, sql in getattr(module, "ORACLES", {}).items()}
