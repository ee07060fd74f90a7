"""Queries of the library over the provided tables, and their SQL."""

from . import analysis, export, network, records, spans, streams, text
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "analysis", "export", "network", "records", "spans", "streams", "text"]
