"""Queries over the operators, one module per part of the operator inventory."""

from . import daily, decisions, joins, metrics, minute, news, portfolio, regime, sources, streams, targets  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
