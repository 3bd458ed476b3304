"""The registered queries of the library proper and the SQL that each must equal."""

from __future__ import annotations

from quillspark.plans import corpus, metrics, retrieval, tasks

PARTS = (retrieval, corpus, metrics, tasks)
QUERIES = {k: v for p in PARTS for k, v in p.REGISTRY.queries.items()}
ORACLES = {k: v for p in PARTS for k, v in p.REGISTRY.oracles.items()}
