"""All queries of the library by name, and their SQL twins."""

from wordloom.operators import bilingual, boards, checks, classes, contracts, corpus, derive, extracts, graphs, ladders, puzzles, resolution, rows, wiki
from wordloom.sources import extract_files, publish
from wordloom.sources import queries as sources
from wordloom.streaming import events, sessions

MODULES = (corpus, classes, bilingual, wiki, ladders, boards, contracts, derive, extracts, graphs, puzzles, resolution, rows, checks, events, sessions, sources, publish, extract_files)
QUERIES: dict = {name: query for m in MODULES for name, query in m.QUERIES.items()}
ORACLES: dict = {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
