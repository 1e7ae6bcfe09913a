"""Named queries over the standard tables, each with its SQL oracle."""

from __future__ import annotations

from signalroom.plans import audits, hidden, marks, more, style

QUERIES: dict = {}
ORACLES: dict = {}
for _part in (hidden, style, marks, more, audits):
    QUERIES |= _part.QUERIES
    ORACLES |= _part.ORACLES
