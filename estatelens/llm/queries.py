"""All queries of this subpackage and their SQL."""

from __future__ import annotations

from estatelens.llm import alignment, backoff, balltree, bestfit, chat, fingerprints, jaccard, language, mixing, packing, repeats, toxicity, vectors

_MODULES = (alignment, backoff, balltree, bestfit, chat, fingerprints, jaccard, language, mixing, packing, repeats, toxicity, vectors)

QUERIES = {name: run for m in _MODULES for name, run in m.QUERIES.items()}
ORACLE = {name: sql for m in _MODULES for name, sql in m.ORACLE.items()}
