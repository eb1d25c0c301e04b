"""All queries over the fixture tables."""

from __future__ import annotations

from tidemark.plans import books, temporal

QUERIES: dict = temporal.QUERIES | books.QUERIES
ORACLES: dict[str, str] = temporal.ORACLES | books.ORACLES
