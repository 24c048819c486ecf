"""The registered queries over the test tables, and their SQL."""

from __future__ import annotations

QUERIES: dict = {}
ORACLES: dict = {}
