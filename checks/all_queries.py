"""Importing this module registers every query."""

from checks import decoders, equipment_checks, places, quality, retrieval, streams, summaries, writes  # noqa: F401
from checks.registry import ORACLE, QUERIES  # noqa: F401
