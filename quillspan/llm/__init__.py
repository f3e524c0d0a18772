"""Operators for training-data pipelines. Nothing else in the library imports this subpackage."""

from quillspan.llm import batch_linkage, markup, mixing, near_copies, neighbors, packing, pair_defects, personal_data, splitting, truncation

MODULES = [near_copies, splitting, neighbors, markup, batch_linkage, pair_defects, personal_data, packing, mixing, truncation]

QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
ORACLES = {name: sql for module in MODULES for name, sql in module.ORACLES.items()}
