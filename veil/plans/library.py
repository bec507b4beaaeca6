"""The registry after every module of queries has filled it."""

from __future__ import annotations

from . import detection, incremental, joins, made, markup, pages, records, reports, texts, values  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
