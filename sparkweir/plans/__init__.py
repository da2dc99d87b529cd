"""Registered queries: each shows operators of the library on the supplied tables."""

from . import classify, deals, digests, guards, joining, landed, measures, selections, states, values  # noqa: F401
from .registry import REGISTRY, Query

__all__ = ["REGISTRY", "Query"]
