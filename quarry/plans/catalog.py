"""Registered queries and their oracle SQL, collected from the query modules."""

from __future__ import annotations

from . import contracts, dialogs, distillation, documents, drift, models, operations, spectra, streams, synthetic, tools

MODULES = (documents, models, drift, spectra, dialogs, distillation, contracts, operations, streams, synthetic, tools)
QUERIES: dict = {}
ORACLE: dict[str, str] = {}
for _module in MODULES:
    QUERIES |= _module.R.queries
    ORACLE |= _module.R.oracle
