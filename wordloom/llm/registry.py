"""The queries of this subpackage by name, with SQL for those that SQL can express."""

from __future__ import annotations

import corpus_pipeline
from wordloom.llm import queries_files, queries_quality, queries_text, queries_tokens

MODULES = (queries_files, queries_quality, queries_text, queries_tokens)
QUERIES: dict = {name: query for m in MODULES for name, query in m.QUERIES.items()} | {"pipeline": corpus_pipeline.run}
ORACLES: dict = {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
