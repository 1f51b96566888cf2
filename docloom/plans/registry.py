"""Every query of the document part of the library, by name, with its SQL twin where SQL can express it."""

from __future__ import annotations

from docloom.plans import citing, editing, guarding, locating, packaging, properties, staging, structures, summary

QUERIES = {}
ORACLES = {}
for module in (summary, locating, editing, structures, packaging, properties, guarding, citing, staging):
    QUERIES |= module.QUERIES
    ORACLES |= module.ORACLES
