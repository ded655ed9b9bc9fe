"""All queries of the core by name, and the SQL that gives the same rows."""

from __future__ import annotations

from recordloom.plans import attempts, deliveries, ledger, likelihood, selection, streams, texts

MODULES = [deliveries, attempts, selection, texts, likelihood, streams, ledger]
QUERIES = {name: query for m in MODULES for name, query in m.QUERIES.items()}
ORACLES = {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
ORACLES["top_answer_likeness"] = ledger._TOP.format(ORACLES["answer_likeness"])
