"""All queries of the library by name, with their SQL for the correctness check."""

from __future__ import annotations

from . import authorization, candidates, identities, code_rules, coverage, decisions, domains, evidence, findings, flows, graphs, joins, lookups, rules, scopes, symbols, taxonomies  # noqa: F401
from .base import ORACLE_SQL, QUERIES  # noqa: F401

FLAGSHIP = "rule_scan_by_language"
